"""Word counts and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from test_llm import lower, none, odd  # noqa: F401

from tessera.llm import spelling_variants as sv


def count(rows, slips, least_length=5, least_count=3):
    c = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if slips and key is not None and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= least_length and n >= least_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words, factor=2):
    out, forms = {}, {}
    for w, n in words.items():
        close = [(-m, x) for x, m in words.items() if near(w, x)]
        best = min(close, default=None)
        forms[w] = best[1] if best and -best[0] >= factor * n else None
        out[w] = [n, len(close), forms[w], -best[0] if forms[w] is not None else None]
    for w, row in out.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        row.append(root)
    return {w: tuple(row) for w, row in out.items()}


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


@pytest.mark.parametrize("slips, most", [(0, 300_000), (3, 300_000), (97, 20)])
def test_counts(spark, odd, none, monkeypatch, slips, most):  # noqa: F811
    monkeypatch.setattr(sv, "TASK_WORDS", most)
    rng = random.Random(slips)
    letters = ["a", "B", "é", "É", "×", "x", "ß"]
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 4, 5, 6, 70]))) for _ in range(40)]
    rows = [(i if i % 9 else None, "".join(rng.choice(words) + rng.choice([" ", "1", "Ā", "\n", "-", "語"]) for _ in range(60))) for i in range(120)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, word long, n string").repartition(5)
    got = {r.word: r.n for r in sv.word_counts(df, slips=slips).collect()}
    assert got == count(rows, slips)
    assert {r.word: r.n for r in sv.word_counts(odd, slips=slips, least_length=1, least_count=1).collect()} == count([(r.doc_id, r.text) for r in odd.collect()], slips, 1, 1)
    assert sv.word_counts(none).count() == 0


@pytest.mark.parametrize("longest", [65, 7])
def test_variants_against_all_pairs(spark, monkeypatch, longest):
    monkeypatch.setattr(sv, "LONGEST_PREFIX", longest)
    rng = random.Random(longest)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 9))): rng.choice([3, 3, 4, 7, 20, 60, 300]) for _ in range(700)}
    words |= {"aaaaa": 5, "aaaaaa": 5, "aaaaaaa": 11, "aabaa": 10, "x" * 66: 4, "x" * 65: 9, "x" * 64: 30, "y" * 80: 3, "": 7, "q": 3}
    got = found(sv.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == variants(words)


def test_forms_lead_to_roots(spark):
    words = {"w" * (5 + i): 3 * 2**i for i in range(20)}
    got = found(sv.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {r[4] for r in got.values()} == {"w" * 24}


def test_no_words(spark):
    assert sv.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert found(sv.spelling_variants(spark.createDataFrame([("alone", 3)], "word string, n long"))) == {"alone": (3, 0, None, None, "alone")}
