"""Groups of near-duplicates against all pairs; bands and sketches against their probabilities."""

import random

import numpy as np
import pytest
from test_llm import none, odd  # noqa: F401

from tessera.llm import odd_sketch


def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else [])


def groups(rows):
    """Component of each row, by the rows' places."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if same or (both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(keys, default=None)
        out.append((-1 if key is None else key, len(sets[i]), -1 if least is None else least, key == least))
    return sorted(out)


def found(df, **options):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in odd_sketch.minhash_groups(df, **options).collect())


def some_rows(rng, n):
    """Families of texts that share most, some or few of their words; chains; copies; short texts."""
    rows, word = [], lambda: f"w{rng.randrange(4000)}"
    while len(rows) < n:
        base = [word() for _ in range(rng.choice([3, 5, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 6, 15])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                base = text
            rows.append((rng.choice([None, *[len(rows)] * 12]), " ".join(text)))
    return rows


@pytest.mark.parametrize("block, known", [(1000, 200_000), (2, 3)])
def test_groups_against_all_pairs(spark, monkeypatch, block, known):
    monkeypatch.setattr(odd_sketch, "BLOCK", block)
    monkeypatch.setattr(odd_sketch, "TEXT_BLOCK", block)
    monkeypatch.setattr(odd_sketch, "KNOWN", known)
    rows = some_rows(random.Random(block), 250)
    rows += [rows[0], rows[7], (None, rows[20][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, same string, node long").repartition(3)
    assert found(df) == groups(rows)


def test_odd_and_empty(spark, odd, none):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = found(odd)
    assert got == groups(rows)
    by = {r[0]: r for r in got}
    assert by[1] == (1, 0, 1, True) and by[2] == (2, 0, 2, True) and by[3] == (3, 0, 3, True)
    assert found(none) == []


def test_null_keys_join_what_they_are_near_to(spark):
    words = [f"w{i}" for i in range(60)]
    far, middle = [*words[:55], *(f"v{i}" for i in range(10))], words[:56]
    rows = [(5, " ".join(words)), (None, " ".join(middle)), (4, " ".join(far)), (None, "alone here it stands still")]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == groups(rows)
    assert (5, 57, 4, False) in got and (-1, 2, -1, True) in got


def test_template_group_of_unlike_texts(spark):
    """Texts that share 200 words and have 35 of their own are not linked, those with one word changed are."""
    rng = random.Random(2)
    base, rows = [f"b{i}" for i in range(200)], []
    for i in range(150):
        own = [f"o{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((2 * i, " ".join(base + own)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join(base + own[:-1] + ["changed"])))
    got = {r[0]: r[2] for r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_bands_and_sketches_follow_the_similarity():
    rng = np.random.default_rng(4)
    for s, share, close in ((0.8, 0.999, 0.999), (0.9, 0.999, 0.999), (0.3, 0.0, 0.0)):
        met = near = 0
        for _ in range(60):
            n = 400
            both = rng.integers(1 << 63, size=round(n * s), dtype=np.uint64)
            own = rng.integers(1 << 63, size=(2, (n - len(both)) // 2), dtype=np.uint64)
            x = np.stack([odd_sketch.minhashes(np.concatenate([both * np.uint64(2), o * np.uint64(2)])) for o in own])
            assert abs((x[0] == x[1]).mean() - s) < 0.15
            k, b = odd_sketch.band_keys(x), odd_sketch.odd_sketches(x)
            met += bool((k[0] == k[1]).any())
            near += int(np.bitwise_count(b[0] ^ b[1]).sum()) <= odd_sketch.most_bits(0.8)
        assert met / 60 >= share and near / 60 >= close
        if s < 0.5:
            assert met / 60 < 0.2 and near == 0
