"""Periodic runs against a search of all lags."""

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F
from test_llm import none, odd  # noqa: F401

from tessera.llm import periodic_runs


def all_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def some_texts(rng, n):
    out = []
    for _ in range(n):
        size, letters = rng.choice([0, 1, 11, 12, 13, 30, 90]), rng.choice([1, 2, 3, 5, 30])
        w = [b"%d" % rng.randrange(letters) for _ in range(size)]
        for _ in range(rng.randint(0, 3) if size else 0):
            a, p = rng.randrange(size), rng.randint(1, 20)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
            if rng.random() < 0.5:
                b = rng.randrange(size)
                w[b:] = [b"%d" % rng.randrange(letters * 10) for _ in range(size - b)]
        out.append(w)
    return out


@pytest.mark.parametrize("rounds, pairs", [(40, 1_000_000), (0, 50), (1, 1)])
def test_runs_against_all_lags(monkeypatch, rounds, pairs):
    monkeypatch.setattr(periodic_runs, "ROUNDS", rounds)
    monkeypatch.setattr(periodic_runs, "CHUNK_PAIRS", pairs)
    many = some_texts(random.Random(rounds), 400)
    assert [[tuple(r) for r in x.tolist()] for x in periodic_runs.runs_of(many)] == [all_runs(w) for w in many]


def test_a_word_that_becomes_rare_splits_again():
    w = "x a b a b a b y a b a b a b c".split()
    starts, ends = periodic_runs.stable_segments(*_numbered([w]), least=3)
    assert [w[a:b] for a, b in zip(starts, ends, strict=True)] == [["a", "b"] * 3, ["a", "b"] * 3]
    assert [x.tolist() for x in periodic_runs.stable_segments(*_numbered([w]), least=7)] == [[], []]


def _numbered(texts):
    import numpy as np

    names = {}
    return np.array([names.setdefault(w, len(names)) for t in texts for w in t]), np.cumsum([len(t) for t in texts])


def test_columns_odd_and_empty_texts(spark, odd, none):  # noqa: F811
    texts = some_texts(random.Random(3), 60)
    df = spark.createDataFrame([(i, b" \n".join(w).decode(), "r", "c", i) for i, w in enumerate(texts)], "doc_id long, text string, Runs string, collapsed string, row long")
    out = periodic_runs.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "row", "runs", "collapsed"]
    for r in out.collect():
        want = all_runs(texts[r.doc_id])
        assert [tuple(x) for x in r.runs] == want and r.collapsed.encode() == kept(texts[r.doc_id], want) and r.row == r.doc_id
    got = periodic_runs.periodic_runs(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].runs == [] and by[i].collapsed == "" for i in (1, 2, 3))
    assert [tuple(x) for x in by[6].runs] == [(0, 9000, 3)] and by[6].collapsed == "a b c"
    assert periodic_runs.periodic_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(odd, least=6)


def test_long_texts_take_time_in_proportion():
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert len(periodic_runs.runs_of([([b"a"] * 100 + [b"b"]) * (n // 101)])[0]) == n // 101 + 1
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_planted_repeats(spark):
    ids = [i for i in range(400) if zlib.crc32(b"%d" % i) % 10 == 0][:12]
    words = [f"w{i}" for i in range(50)]
    rows = periodic_runs.planted(spark.createDataFrame([(i, " ".join(words)) for i in [*ids, 1]] + [(None, "a b")], "doc_id long, text string")).collect()
    for r in rows:
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, 50
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        want = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)] if r.doc_id is not None and h % 10 == 0 else None
        assert r.text == (" ".join(want) if want else "a b" if r.doc_id is None else " ".join(words))


def test_query_digests(spark, sf_dir):
    out = periodic_runs.op12_periodic_runs(spark, sf_dir).limit(40).collect()
    texts = {r.doc_id: (r.text or "").encode().split() for r in periodic_runs.planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).where(F.col("doc_id").isin([r.doc_id for r in out])).collect()}
    for r in out:
        runs = all_runs(texts[r.doc_id])
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(texts[r.doc_id], runs)).hexdigest()
