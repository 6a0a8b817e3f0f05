"""Operators on small fixtures with values worked out by hand."""

import random
import re
import struct
import types
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import normalise, scalar
from tessera.operators import bpe, cohorts, coverage, filters, hierarchy, histogram, merge, metrics, programs, regress, samples, splits, stats, vocab
from tessera.operators.ordinal import global_rank
from tessera.sources import store


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_lattice_counts_zeros(spark):
    df = spark.createDataFrame([(1, "123", "12"), (2, "123", "12"), (3, "123", "34"), (4, "456", "34"), (5, "456", "56"), (6, "456", "56")], "id int, label_a string, label_b string")
    got = {(r.label_a, r.label_b): r.n for r in cohorts.lattice(df, ["a", "b"]).collect()}
    assert got[("123", "12")] == 2 and got[("123", "34")] == 1 and got[("123", "56")] == 0
    assert got[("456", "12")] == 0 and got[("456", "34")] == 1 and got[("456", "56")] == 2
    assert got[("123", None)] == 3 and got[(None, "56")] == 2


def test_null_labels_are_in_no_group(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "h string")
    labelled = df.withColumn("label_h", cohorts.label_in("h", ["a"]))
    assert [r.label_h for r in labelled.orderBy("h").collect()] == [None, "victimHash", "normalHash"]
    assert cohorts.select_cohort(labelled, [[("h", "victimHash"), ("h", "normalHash")]]).count() == 2


def test_constant_frames(spark):
    white = one(spark, cohorts.constant_frame_hash("ff", F.lit(2), F.lit(3)))
    import hashlib

    assert white == hashlib.sha256(b"\xff" * 24).hexdigest()
    df = spark.createDataFrame([(1, white, 2, 3), (2, "other", 2, 3), (3, None, 2, 3)], "id int, hash string, w int, h int")
    assert rows(cohorts.label_constant_frame(df, "hash", "w", "h"), "id", "label_frame") == [(1, "victimHash"), (2, "normalHash"), (3, None)]


def test_registry_and_unknown_label(spark):
    labels = cohorts.Labels()
    labels.register(lambda df: F.lit("x"), "a")
    with pytest.raises(ValueError):
        labels.register(lambda df: F.lit("y"), "a")
    with pytest.raises(ValueError):
        cohorts.select_cohort(labels.apply(spark.range(1)), [[("b", "x")]])


def test_duplicate_in_lists_fails(spark):
    lists = spark.createDataFrame([(1, "a"), (1, "b")], "id long, group string")
    with pytest.raises(Exception, match="listed twice"):
        cohorts.label_lists(spark.range(3), "id", lists, "g").collect()


def test_overlapping_splits_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, label_a string")
    splits_ = {"train": [[("a", "x")]], "test": [[("a", "x"), ("a", "y")]]}
    assert rows(cohorts.assign_splits(df, splits_), "id", "split") == [(1, "test"), (1, "train"), (2, "test")]
    cohorts.snapshot(df, f"{tmp_path}/a", splits_, ["id"])
    cohorts.snapshot(df.where("id = 1"), f"{tmp_path}/b", splits_, ["id"], post=[lambda d: d.withColumn("id", F.col("id") + 10)], test_from=f"{tmp_path}/a")
    assert rows(store.read_split(spark, f"{tmp_path}/b", "test"), "id") == [(1,), (2,)]
    assert rows(store.read_split(spark, f"{tmp_path}/b", "train"), "id") == [(11,)]
    assert rows(store.read_split(spark, f"{tmp_path}/b", "train", ("id", 1.0, 5.0)), "id") == [(2.0,)]


def test_trials(spark):
    a = F.array(*[F.lit(x) for x in (0.010, 0.012, 0.011, 0.030, 0.009)])
    assert one(spark, stats.array_mean(a)) == pytest.approx(0.0144)
    assert one(spark, stats.array_stddev(a)) == pytest.approx(0.007863841300535)
    assert one(spark, stats.array_stddev(a, sample=True)) == pytest.approx(0.008792041856133307)
    assert one(spark, stats.array_mean(stats.trimmed(a))) == pytest.approx(0.011)
    assert one(spark, stats.array_stddev(stats.trimmed(a))) == pytest.approx(0.000816496580926727)
    assert one(spark, stats.trimmed(F.array(F.lit(1.0), F.lit(2.0)))) is None


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "v double")
    assert [r.n for r in histogram.fixed_histogram(df, "v", [1, 2, 4, 10]).orderBy("bin").collect()] == [1, 2, 2]
    assert [r.value for r in stats.percentiles(df, "v", [0.85, 0.95]).orderBy("point").collect()] == pytest.approx([6.4, 8.8])


def test_metrics_by_range(spark):
    df = spark.createDataFrame([(5e-5, 6e-5), (2e-4, 1e-4), (5e-4, 5e-4), (2e-3, 3e-3), (0.05, 0.04)], "real double, pred double")
    got = {r.range: r for r in metrics.metric_suite(df, "real", "pred").collect()}
    assert got["overall"].rmse == pytest.approx(0.00449466572728162) and got["overall"].mae == pytest.approx(0.002222) and got["overall"].mape == pytest.approx(0.28)
    assert got["0.0001..0.001"].rmse == pytest.approx(7.071067811865475e-5) and got["0.0001..0.001"].mape == pytest.approx(0.25)
    assert got["0.1..1e+10"].n == 0 and got["0.1..1e+10"].rmse is None
    ranks = metrics.average_ranks(spark.createDataFrame([(1,), (2,), (2,), (5,)], "v int"), "v", [], "r")
    assert rows(ranks, "v", "r") == [(1, 1.0), (2, 2.5), (5, 4.0)]


def test_scalars(spark):
    assert one(spark, scalar.base2_digits(F.lit(13), 6)) == [1, 0, 1, 1, 0, 0]
    assert one(spark, scalar.base2_digits(F.lit(-1), 65)) == [0] * 65
    assert one(spark, scalar.id_label(F.lit("lllBR7"))) == 3740070357303
    assert one(spark, scalar.opcode_distance(F.array(*map(F.lit, (54, 248, 61, 61, 129, 253))), F.array(*map(F.lit, (54, 248, 61, 133, 253))))) == 2
    assert one(spark, scalar.mangle(F.lit("3dXttZ"))) == "3dXttZ-NLULLU" and one(spark, scalar.mangle(F.lit("3d_ttZ"))) is None
    assert one(spark, scalar.unmangle(F.lit("3dxttz-NLULLU"))) == "3dXttZ" and one(spark, scalar.unmangle(F.lit("xdxttz-NLULLU"))) is None
    assert one(spark, scalar.slug(F.lit("A b-c! é"))) == "A-b-c-é"
    ids = F.array(F.lit(7), F.lit(8))
    assert one(spark, scalar.pad_left(ids, F.lit(4))) == [1000, 1000, 7, 8] and one(spark, scalar.attention_mask(ids, F.lit(4))) == [0, 0, 1, 1]
    assert one(spark, scalar.with_special(ids)) == [1001, 7, 8] and one(spark, scalar.type_ids(ids, ids)) == [0] * 4 + [1] * 3
    assert one(spark, scalar.from_digits(scalar.digits(F.lit(1234), 10, 6), 10)) == 1234


def test_normalisers(spark):
    f, g = normalise.normaliser("log1p")
    assert one(spark, g(f(F.lit(2.5)))) == pytest.approx(2.5)
    assert one(spark, normalise.normaliser("log")[0](F.lit(0.0))) is None
    assert one(spark, normalise.on_array(normalise.normaliser("zscore", mean=1.0, stdev=2.0)[0])(F.array(F.lit(3.0)))) == [1.0]
    fit = stats.fit_normaliser(spark.createDataFrame([(3.0,)], "v double"), "v").first()
    assert (fit.mean, fit.stdev) == (3.0, 0.0)
    with pytest.raises(ValueError):
        normalise.normaliser("none such")


def test_inverse_normal(spark):
    assert one(spark, stats.inverse_normal(F.lit(0.975))) == pytest.approx(1.959963984540054, abs=1e-6)
    assert one(spark, stats.inverse_normal(F.lit(0.0))) is None


def test_trees(spark):
    nodes = spark.createDataFrame([(1, None, True, "a"), (2, 1, False, "b"), (3, 2, False, "c"), (4, 9, False, "d"), (5, 6, False, "e"), (6, 5, False, "f")], "id long, parent long, has boolean, step string")
    assert rows(hierarchy.levels(nodes), "id", "level", "problem") == [(1, 0, None), (2, 1, None), (3, 2, None), (4, 0, "dangling"), (5, None, "cycle"), (6, None, "cycle")]
    good = nodes.where("id < 4")
    assert rows(hierarchy.nearest_with(good, F.col("has"), "step"), "id", "nearest", "steps") == [(2, 1, ["b"]), (3, 1, ["b", "c"])]
    assert rows(hierarchy.descendants(good, good.where("id = 1"), cap=2), "id", "place") == [(1, 1), (2, 2)]
    assert rows(hierarchy.root_ancestor(good), "id", "root", "distance") == [(1, 1, 0), (2, 1, 1), (3, 1, 2)]


def test_merge(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "p")], "id long, k string, m string")
    b = spark.createDataFrame([(7, "x", None), (8, "z", "q"), (9, "z", "q")], "id long, k string, m string")
    merged, ids = merge.merge_dimension(a, b, ["k", "m"])
    assert rows(merged, "id", "k") == [(1, "x"), (2, "y"), (3, "z")]
    assert rows(ids, "old_id", "new_id") == [(7, 1), (8, 3), (9, 3)]
    assert rows(merge.table_diff(a, b.withColumn("id", F.col("id") - 6), "id", ["k", "m"]), "id", "status") == [(1, "same"), (2, "changed"), (3, "added")]
    facts = spark.createDataFrame([(1, 7, None), (2, 8, 1)], "id long, k long, parent long")
    got = merge.import_facts(spark.createDataFrame([(5, 1, None)], "id long, k long, parent long"), facts, {"k": ids})
    assert rows(got, "id", "k", "parent") == [(5, 1, None), (6, 1, None), (7, 3, 6)]


def test_sync_children_nulls_are_equal(spark):
    facts = spark.createDataFrame([(1, None, None), (2, 1, None)], "id long, parent long, note string")
    tree = spark.createDataFrame([(3, 1, None), (4, 1, "n"), (5, 9, "n")], "id long, parent long, note string")
    assert rows(merge.sync_children(facts, tree, ["note"]), "id") == [(4,)]


def test_not_in_drops_null_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert rows(filters.not_listed(df, "k", spark.createDataFrame([(1,)], "k int")), "k") == [(2,)]
    assert coverage.in_all_groups(spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "k int, g string"), "k", "g").collect()[0].k == 2


def test_error_numbers(spark):
    for text, number in ((None, 0), ("", 0), ("x ShaderCompilationException y", 1), ("ShaderResultInconsistencyException", 2), ("what", 100)):
        assert one(spark, filters.error_number(F.lit(text).cast("string"))) == number


def test_global_rank_and_splits(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 1000)
    got = global_rank(df, "v", "id").collect()
    assert all(r["rank"] == r.v + 1 for r in got)
    s = splits.ratio_split(df, "id", 1, [0.8, 0.05], ["a", "b", "c"])
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"a": 800, "b": 50, "c": 150}
    assert rows(splits.ratio_split(df, "id", 1, [0.8, 0.05], ["a", "b", "c"]), "id", "split") == rows(s, "id", "split")
    assert splits.verify_split(s, s, "id").count() == 0


def test_decode_binaries(spark):
    w = lambda *x: struct.pack(f"<{len(x)}I", *x)
    good = w(0x07230203, 0x10000, 0, 9, 0, 2 << 16 | 54, 1, 2 << 16 | 248, 5, 3 << 16 | 61, 7, 8, 1 << 16 | 253)
    df = spark.createDataFrame([(1, good), (2, b"xx"), (3, good[:-6]), (4, None)], "id long, b binary")
    got = programs.decode_binaries(df, "id", "b")
    assert rows(got.where("id = 1"), "inst_no", "opcode", "func_no", "block_id") == [(0, 54, 0, None), (1, 248, 0, 5), (2, 61, 0, 5), (3, 253, 0, 5)]
    assert rows(got.where("problem is not null"), "id", "problem") == [(2, "no header"), (3, "an instruction is cut short"), (4, "no header")]


def test_weighted_counts(spark):
    insts = spark.createDataFrame([(1, 10, 5), (1, 10, 6), (1, 11, 5), (1, 12, 5)], "id long, block_id long, opcode int")
    dim = spark.createDataFrame([(5, "Load", "Memory"), (6, "Add", "Arithmetic")], "opcode int, opname string, class string")
    big = 18446744073709551615
    traces = spark.createDataFrame([(1, {10: 0, 11: 1}, f"[{big}, 2]")], "id long, m map<long,int>, c string").withColumn("c", store.parse_counters(F.col("c")))
    blocks = programs.block_counts(traces, "id", "m", "c")
    got = programs.weighted_counts(insts, dim, blocks, "class", "id")
    assert {r["class"]: int(r.n) for r in got.collect()} == {"Memory": big + 2, "Arithmetic": big}
    assert rows(programs.unmapped_blocks(insts, blocks, "id"), "block_id") == [(12,)]
    plain = programs.weighted_counts(insts, dim, None, "opname", "id")
    assert {r.opname: int(r.n) for r in plain.collect()} == {"Load": 3, "Add": 1}
    assert programs.features(plain, "id", "opname", ["Add", "Load", "Mul"]).first().asDict() == {"id": 1, "total": 4.0, "Add": 1.0, "Load": 3.0, "Mul": 0.0}


def test_uniform_block(spark):
    data = struct.pack("<3f f 4f 4f 4f f 16f i f f", *range(33), 33, 34.0, 35.0)
    df = spark.createDataFrame([(1, data), (2, b"short"), (3, None)], "id int, u binary").select("id", store.unpack_struct("u").alias("u"))
    got = {r.id: r.u for r in df.collect()}
    assert got[2] is None and got[3] is None
    assert got[1].iResolution == [0.0, 1.0, 2.0] and got[1].iFrame == 33 and got[1].iFrameRate == 35.0 and len(got[1].iChannelResolution) == 16
    packed = struct.pack("<2Q", 1, 2**64 - 1)
    assert [int(x) for x in one(spark, store.unpack_counters(F.lit(packed)))] == [1, 2**64 - 1]
    assert one(spark, store.parse_trials(F.lit(""))) is None and one(spark, store.parse_block_map(F.lit('{"3": 4}'))) == {3: 4}


def test_documents(spark, tmp_path):
    import json

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "abc.json").write_text(json.dumps({"Shader": {"info": {"name": "n"}, "renderpass": [{"type": "image", "code": "c", "inputs": [{"id": "1", "src": "x.mp3", "ctype": "texture", "channel": 0}], "outputs": []}]}}))
    (tmp_path / "bcd.json").write_text(json.dumps({"Error": "Shader not found"}))
    got = store.read_documents(spark, str(tmp_path))
    assert rows(got.select("id", F.col("document.Error").isNull().alias("valid")), "id", "valid") == [("abc", True), ("bcd", False)]
    inputs = got.select("id", F.explode("document.Shader.renderpass").alias("p")).select("id", F.explode("p.inputs").alias("i")).select("id", "i.src", "i.ctype")
    assert rows(filters.check_suffix(inputs, "src", F.col("ctype"), filters.MEDIA), "problem") == [("bad suffix",)]
    (tmp_path / "a" / "bcd.json").write_text("{}")
    with pytest.raises(Exception, match="twice"):
        store.read_documents(spark, str(tmp_path)).collect()


def test_vocabulary(spark, tmp_path):
    df = spark.createDataFrame([(1, "b a\na  a"), (2, None), (3, "")], "id long, t string")
    counts = vocab.count_symbols(vocab.lines(df, "id", "t"))
    assert rows(counts, "symbol", "count") == [("</s>", 3), ("a", 3), ("b", 1)]
    v = vocab.finalise(counts, multiple=4)
    assert rows(v, "symbol", "index") == sorted([("<s>", 0), ("<pad>", 1), ("</s>", 2), ("<unk>", 3), ("a", 4), ("b", 5), ("madeupword0000", 6), ("madeupword0001", 7)], key=repr)
    lines = spark.createDataFrame([(1, "a zz b"), (2, "")], "id long, line string")
    enc = vocab.encode_lines(lines, v, ["id"])
    assert rows(enc, "id", "ids") == [(1, [4, 3, 5, 2]), (2, [2])]
    assert rows(vocab.decode_lines(enc, v, ["id"]), "id", "text") == [(1, "a <unk> b"), (2, "")]
    assert rows(vocab.encode_lines(lines, v, ["id"], eos=None, reverse=True), "id", "ids") == [(1, [5, 3, 4]), (2, [])]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "f.txt").write_text("a 3\nb 1\na 5 #fairseq:overwrite\n")
    assert rows(vocab.read_vocab(spark, f"{tmp_path}/v"), "symbol", "count") == [("a", 5), ("b", 1)]
    (tmp_path / "v" / "f.txt").write_text("a 3\na 5\n")
    with pytest.raises(Exception, match="twice"):
        vocab.read_vocab(spark, f"{tmp_path}/v").collect()


def test_bpe(spark):
    df = spark.createDataFrame([(1, "low low lower"), (2, "newest newest widest"), (3, None)], "id long, t string")
    merges = bpe.train(bpe.words(df, "t"), 6)
    words = {"low": 2, "lower": 1, "newest": 2, "widest": 1}
    parts, want = {w: list(w) for w in words}, []
    for _ in range(6):
        pairs = {}
        for w, p in parts.items():
            for x in zip(p, p[1:], strict=False):
                pairs[x] = pairs.get(x, 0) + words[w]
        n, best = max((n, tuple(-ord(c) for c in x[0] + "\0" + x[1]), x) for x, n in pairs.items())[::2]
        best = min((x for x, m in pairs.items() if m == n))
        if n < 2:
            break
        want.append(best)
        parts = {w: bpe.segment(w, {m: i for i, m in enumerate(want)}) for w in words}
    assert merges == want
    got = bpe.encode(df, "id", "t", merges)
    assert rows(bpe.decode(got, "id"), "id", "text") == [(1, "lowlowlower"), (2, "newestnewestwidest"), (3, "")]


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 5.0)], "x double, y double")
    w = regress.inverse_weight(F.col("y"))
    line = regress.line_fit(df, "x", "y", w).first()
    assert line.slope == pytest.approx(0.957142903877536) and line.intercept == pytest.approx(0.09999998142857125)
    fit = dict(regress.ols(df, ["x"], "y", w))
    assert fit["x"] == pytest.approx(line.slope) and fit["(intercept)"] == pytest.approx(line.intercept)
    dim = spark.createDataFrame([("Load", "M"), ("Store", "M")], "opname string, class string")
    table = regress.coefficient_table(spark, [("M", 2.0), ("(intercept)", 1.0)])
    assert rows(regress.project_classes(table, dim), "feature", "coef") == [("(intercept)", 1.0), ("Load", 2.0), ("Store", 2.0)]


def test_masked_examples_draw_the_same_again(spark):
    df = spark.createDataFrame([(1, list(range(5000, 5100))), (2, [5001])], "id long, ids array<int>")
    a = programs.masked_examples(df, "id", "ids", 32, 1, 0, 0.3, 100, 1003, 1000)
    assert rows(a, "id", "input_ids", "labels") == rows(a.repartition(3), "id", "input_ids", "labels")
    for r in a.collect():
        assert len(r.input_ids) == len(r.labels) == 32
        assert all(x == y or y == -100 or x == 1003 or 0 <= x < 100 for x, y in zip(r.input_ids, r.labels, strict=True))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, t string, v double")
    assert vocab.count_symbols(vocab.lines(none, "id", "t")).count() == 0
    assert metrics.metric_suite(none.withColumn("p", F.col("v")), "v", "p").count() == 6
    assert histogram.fixed_histogram(none, "v", [0, 1]).first().n == 0
    assert global_rank(none, "id").count() == 0
    assert stats.fit_normaliser(none, "v").first().mean == 0.0
    assert bpe.train(bpe.words(none, "t"), 3) == []


def brute_merges(words, n_merges):
    parts, out = {w: list(w) for w in words}, []
    for _ in range(n_merges):
        pairs = {}
        for w, p in parts.items():
            for x in zip(p, p[1:], strict=False):
                pairs[x] = pairs.get(x, 0) + words[w]
        best = min(pairs, key=lambda x: (-pairs[x], x), default=None)
        if best is None or pairs[best] < 2:
            break
        out.append(best)
        parts = {w: bpe.merged(p, *best) for w, p in parts.items()}
    return out


@pytest.mark.parametrize("words", [{"azx": 8, "az": 2, "cd": 8}, {"aaab": 5, "aab": 4, "bab": 3, "abab": 6}, {"low": 40, "lower": 31, "newest": 30, "widest": 25, "xyz": 90, "qrs": 70, "mnop": 50}])
def test_bpe_phases_give_the_merges_of_one_by_one(spark, monkeypatch, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute_merges(words, 8)
    assert bpe.train(df, 8) == want
    assert bpe.train(df, 8, most_pairs=2) == want
    monkeypatch.setattr(bpe, "STRETCHES", 1)
    assert bpe.train(df, 8) == want


def test_certain_merges():
    """A phase's merges are those of counting anew each time, whatever pairs it looks at; most need few phases."""
    rng, phases, total = random.Random(5), 0, 0
    for k in range(1500):
        words = {"".join(rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(2, 9))): rng.choice([1, 2, 2, 3, 5, 8, 20, 60]) for _ in range(rng.randint(1, 14))}
        want, done, symbols, parts = brute_merges(words, 40), [], set(), {w: list(w) for w in words}
        most = rng.choice([1, 2, 3, 6, 1000])
        while True:
            pairs = Counter()
            for w, p in parts.items():
                for x in zip(p, p[1:], strict=False):
                    pairs[x] += words[w]
            top = sorted(((n, x) for x, n in pairs.items() if n >= 2), key=lambda t: (-t[0], t[1]))
            if not top or len(done) == 40:
                break
            chosen = {x: n for n, x in top[:most]}
            floor = top[most][0] if len(top) > most else 0
            known = {a + b for a, b in chosen if a + b in symbols}
            cut = Counter()
            for w, p in parts.items():
                for st in bpe.stretches(p, chosen, known):
                    cut[st] += words[w]
            new = bpe._phase([(list(st), n) for st, n in cut.items()], chosen, floor, symbols, 40 - len(done), 2) or [top[0][1]]
            done += new
            phases, total = phases + (most == 1000), total + len(new) * (most == 1000)
            symbols |= {a + b for a, b in new}
            parts = {w: bpe.in_order(p, {m: i for i, m in enumerate(new)}) for w, p in parts.items()}
        assert done == want, (words, most)
    assert total > 5 * phases


def test_merges_above_the_pairs_left_out():
    """Stretches that end with the pairs above a count give the merges of counting anew each time."""
    rng = random.Random(6)
    for _ in range(400):
        words = {"".join(rng.choice("abcdé\x00"[: rng.randint(1, 6)]) for _ in range(rng.randint(2, 9))): rng.choice([1, 2, 2, 3, 5, 8, 20, 60]) for _ in range(rng.randint(1, 14))}
        want, done, names, most = brute_merges(words, 40), [], bpe._Symbols(), rng.choice([1, 2, 3, 6, 1000])
        symbols, n = bpe._numbered(list(words), np.array(list(words.values())))
        while len(done) < 40:
            counts = dict(zip(*(x.tolist() for x in bpe._pair_counts(symbols, n)), strict=True))
            top = sorted((-c, names.text(p >> 32), names.text(p & 0xFFFFFFFF)) for p, c in counts.items() if c >= 2)
            if not top:
                break
            floor = -top[most][0] if len(top) > most else 1
            pairs, new = {(a, b): -c for c, a, b in top[:most] if -c > floor}, []
            if pairs:
                stretch, weights = bpe._cut(symbols, n, bpe._Edges([(names.number(a), names.number(b)) for a, b in pairs]).among(symbols))
                cut = [np.frombuffer(x, np.int32) for x in stretch.to_pylist()]
                rows_ = bpe._ended(np.concatenate(cut), np.array([len(x) for x in cut])), weights
                new = bpe._phase(rows_, pairs, floor, set(names.numbers), 40 - len(done), 2, names, beside=False)
            new = new or [top[0][1:]]
            done += new
            symbols, n = next(bpe._after([(symbols, n)], [(names.number(a), names.number(b), names.number(a + b)) for a, b in new]))
        assert done == want, (words, most)


def test_what_stands_beside_a_pair_makes_no_stretches(spark, monkeypatch):
    """Pairs among many different neighbours are merged in few phases, though the driver takes few stretches."""
    rng, phases = random.Random(7), []
    pairs = rng.sample([a + b for a in "abcdefghijklm" for b in "nopqrstuvwxyz"], 30)
    words = {f"{rng.randint(0, 99):02}{pairs[int(30 * rng.random() ** 2)]}{rng.randint(0, 99):02}": 1 for _ in range(4000)}
    phase = bpe._phase
    monkeypatch.setattr(bpe, "STRETCHES", 100)
    monkeypatch.setattr(bpe, "_phase", lambda *a: phases.append(1) or phase(*a))
    assert bpe.train(spark.createDataFrame(list(words.items()), "word string, n long"), 12) == brute_merges(words, 12)
    assert len(phases) <= 3


def test_pre_tokens_are_counted_by_chunks(spark):
    """Counts of chunks' pre-tokens are those of whole texts, whatever blanks stand in them."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "Bé", "7", "'s", "'", "!", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x00", "\u00a0", "\u2028", "\u3000", "日", "𝒳", "\u0301"]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", " ", "\n \n"]], "t string").repartition(3)
    whole = df.select(F.explode(bpe.byte_words(F.col("t"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    assert rows(bpe.words(df, "t", bpe.byte_words), "word", "n") == rows(whole, "word", "n")


def test_byte_level_pieces(spark):
    texts = ["Hello  world's été\n\tx", "", None, "naïve 日本 don't  ", "\x00\x7f"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    merges = bpe.train_vocabulary(df, "t", len(bpe.SPECIALS) + 256 + 5)
    got = bpe.encode(df, "id", "t", merges, bpe.byte_words)
    assert [r.text for r in bpe.decode_bytes(got, "id").orderBy("id").collect()] == [" " + t if t and t[0] != " " else t or "" for t in texts]
    plain = bpe.encode(df, "id", "t", merges, lambda t: bpe.byte_words(t, prefix_blank=False))
    assert [r.text for r in bpe.decode_bytes(plain, "id").orderBy("id").collect()] == [t or "" for t in texts]
    ids = bpe.vocabulary(merges)
    assert len(set(bpe.byte_symbols())) == 256 and ids["[BOS]"] == 0 and ids["[MASK]"] == 6 and len(ids) == 263 + len(merges)


def test_cycles_end(spark):
    nodes = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.descendants(nodes, nodes.where("id = 1"), most=6)
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.root_ancestor(nodes, most=100)


def test_repeated_rows_on_the_right(spark):
    facts = spark.createDataFrame([(1, 10), (2, None)], "id long, k long")
    same = spark.createDataFrame([(10, 5), (10, 5)], "old_id long, new_id long")
    assert rows(merge.remap(facts, {"k": same}), "id", "k") == [(1, 5), (2, None)]
    with pytest.raises(Exception, match="different rows of one key"):
        merge.remap(facts, {"k": same.unionByName(spark.createDataFrame([(10, 6)], "old_id long, new_id long"))}).collect()
    updates = spark.createDataFrame([(1, 7), (1, 7)], "id long, k long")
    assert rows(merge.upsert(facts, updates, "id", ["k"]), "id", "k") == [(1, 7), (2, None)]


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_percentiles_against_numpy(spark, monkeypatch, small):
    import numpy as np

    monkeypatch.setattr(stats, "SMALL_COUNTS", small)

    rng = np.random.default_rng(2)
    data = [(g, float(v)) for g in "ab" for v in rng.integers(0, 40, 101 if g == "a" else 20)] + [("c", None), ("d", 3.0), (None, 8.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r.v for r in stats.exact_percentiles(df, "v", [0.0, 0.3, 0.85, 1.0], by=["g"]).collect()}
    for g in ("a", "b", "d", None):
        assert got[g] == pytest.approx(np.percentile([v for k, v in data if k == g], [0, 30, 85, 100]))
    five = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "v double")
    assert [r.value for r in stats.percentiles(five, "v", [0.85, 0.95]).orderBy("point").collect()] == pytest.approx([6.4, 8.8])
    assert all(r.value is None for r in stats.percentiles(five.where("v > 99"), "v", [0.5]).collect())
    place = {r.g: (r.median, r.place) for r in stats.groups_by_median(df.where("g is not null"), "g", "v").collect()}
    assert place["c"] == (None, 4)


def test_average_ranks(spark):
    df = spark.createDataFrame([("m", float(x)) for x in (1, 2, 2, 5)], "g string, v double")
    assert rows(metrics.average_ranks(df, "v", ["g"], "r"), "v", "r") == [(1.0, 1.0), (2.0, 2.5), (5.0, 4.0)]


def test_large_vocabularies_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b  zz a"), (2, ""), (3, None)], "id long, t string")
    words = spark.createDataFrame([("a", 4), ("b", 5), ("</s>", 2), ("<unk>", 3)], "symbol string, index long")
    for reverse in (False, True):
        small = rows(vocab.encode_lines(df, words, ["id"], "t", reverse=reverse), "id", "ids")
        monkeypatch.setattr(vocab, "SMALL_VOCAB", 1)
        assert rows(vocab.encode_lines(df, words, ["id"], "t", reverse=reverse), "id", "ids") == small
        monkeypatch.undo()
    coded = vocab.encode_lines(df, words, ["id"], "t")
    assert rows(vocab.decode_lines(coded, words, ["id"]), "id", "text") == [(1, "a b <unk> a"), (2, ""), (3, "")]
    monkeypatch.setattr(vocab, "SMALL_VOCAB", 1)
    assert rows(vocab.decode_lines(coded, words, ["id"]), "id", "text") == [(1, "a b <unk> a"), (2, ""), (3, "")]


def test_frequent_symbols_of_large_vocabularies_are_not_joined(spark, monkeypatch):
    """Of 3,000 tokens the 40 of rare symbols are joined; rows without them, null keys and what no vocabulary has stay right."""
    lines = spark.createDataFrame([(i if i else None, i % 7, " ".join(["a b c"] * 10 + ([f"rare{i}", "a", f"rare{i + 1}"] if i % 5 == 0 else []))) for i in range(100)], "id long, n int, line string")
    counts = vocab.count_symbols(lines.unionByName(lines.limit(0)))
    monkeypatch.setattr(vocab, "SMALL_VOCAB", 8)
    words = vocab.held(vocab.finalise(counts))
    assert words.whole is not None and len(words.few) == 8
    joined = []
    real = vocab._with_found
    monkeypatch.setattr(vocab, "_with_found", lambda rows, wanted, *rest: joined.append(rows.select(F.sum(F.size(wanted))).first()[0]) or real(rows, wanted, *rest))
    coded = vocab.encode_lines(lines, words, ["id", "n"])
    assert sorted((r.id or 0, r.text) for r in vocab.decode_lines(coded, words, ["id", "n"]).collect()) == sorted((r.id or 0, r.line) for r in lines.collect())
    assert len(joined) == 2 and all(n <= 40 for n in joined)
    some = spark.createDataFrame([(1, "rare5 zz b"), (2, None), (3, "zz")], "id long, line string")
    assert [vocab.decode_lines(vocab.encode_lines(some, words, ["id"], reverse=r), words, ["id"]).orderBy("id").collect()[0].text for r in (False, True)] == ["rare5 <unk> b", "b <unk> rare5"]
    assert [r.text for r in vocab.decode_lines(spark.createDataFrame([(1, [4, 10**6, None, 9]), (2, None)], "id long, ids array<long>"), words, ["id"]).orderBy("id").collect()][1] == ""


def test_lengths_are_reused_for_their_programs_only(spark, tmp_path):
    tokens = spark.createDataFrame([(1, [1, 2]), (2, None)], "id long, ids array<int>")
    lengths = programs.token_lengths(tokens, None, "id", "ids")
    assert rows(lengths, "id", "length") == [(1, 3), (2, None)]
    programs.store_lengths(lengths, f"{tmp_path}/x", "id")
    assert rows(programs.stored_lengths(tokens, f"{tmp_path}/x", "id"), "id", "length") == [(1, 3), (2, None)]
    assert programs.stored_lengths(tokens.where("id = 1"), f"{tmp_path}/x", "id") is None


def test_sync_tree(spark):
    schema = "id long, parent long, name string, kind int, note string"
    facts = spark.createDataFrame([(1, None, "r", 0, None), (2, 1, None, 7, None), (9, None, "two", 0, None), (10, None, "two", 0, None)], schema)
    tree = spark.createDataFrame([(100, None, "r", 0, None), (101, 100, None, 7, None), (102, 100, None, 7, "x"), (103, 101, None, 7, None), (104, 103, None, 7, None), (105, 100, None, 8, None), (200, None, "two", 0, None), (201, 200, None, 7, None)], schema)
    out = merge.sync_tree(facts, tree, "name", ["kind", "note"], "kind", {1: [7], 2: [7]}, 2, 5)
    assert rows(out, "tree_id", "id", "parent", "note", "status") == [(102, 11, 1, "x", 5), (103, 12, 2, None, 5)]
    only = merge.sync_tree(facts, tree, "name", ["kind", "note"], "kind", {2: [8]}, 2, 5)  # the first level takes all kinds
    assert rows(only, "tree_id", "id", "parent", "kind") == [(102, 11, 1, 7), (105, 12, 1, 8)]


def test_twins_of_a_tree_are_one_row(spark):
    schema = "id long, parent long, name string, kind int, note string"
    facts = spark.createDataFrame([(1, None, "r", 0, None)], schema)
    tree = spark.createDataFrame([(10, None, "r", 0, None), (11, 10, None, 5, None), (12, 10, None, 5, None), (13, 12, None, 6, "x"), (14, 11, None, 6, "x"), (15, 11, None, 6, "y")], schema)
    out = merge.sync_tree(facts, tree, "name", ["kind", "note"], "kind", {}, 2, 5)
    assert rows(out, "tree_id", "id", "parent", "kind", "note") == [(11, 2, 1, 5, None), (13, 3, 2, 6, "x"), (15, 4, 2, 6, "y")]


def test_stores_are_compared_by_ranges(spark, monkeypatch):
    a = spark.range(40_000).selectExpr("id", "id % 7 AS v", "cast(id AS string) AS t")
    b = a.where("id % 9001 <> 5").withColumn("v", F.when(F.col("id") % 9000 == 3, -1).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(50_000, 1, "n"), (None, 1, "n")], "id long, v long, t string"))
    a = a.unionByName(spark.createDataFrame([(None, 1, "n")], "id long, v long, t string"))
    ranges = merge.differing_ranges(a, b, "id", ["v", "t"])
    changed = {5, 9006, 18007, 27008, 36009} | {3, 9003, 18003, 27003, 36003} | {50_000}
    assert len(changed) - 1 <= ranges.count() <= len(changed)
    got = merge.table_diff(a, b, "id", ["v", "t"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")).collect()
    by = {r.status: (r.n, r.s) for r in got}
    assert by["added"] == (2, 50_000) and by["removed"] == (6, 90_035) and by["changed"] == (5, 90_015) and by["same"][0] == 40_000 - 10
    joined = merge._in_ranges(a, ranges, "id", "left_semi")
    assert joined.count() < 400
    assert merge.table_diff(a, a, "id", ["v", "t"]).where("status = 'changed'").count() == 0
    assert all(sorted(r.id for r in merge.missing_keys(a, b, "id", distinct=d).collect()) == [5, 9006, 18007, 27008, 36009] for d in (True, False))
    monkeypatch.setattr(merge, "BROADCAST_RANGES", 1)
    assert merge.table_diff(a, b, "id", ["v", "t"]).where("status = 'changed'").count() == 5
    none = a.where("1 = 0")
    assert merge.table_diff(none, none, "id", ["v"]).count() == 0 and merge.table_diff(none, b.where("id < 3"), "id", ["v"]).where("status = 'added'").count() == 3


def test_a_repeated_source_row_counts_once(spark):
    target = spark.createDataFrame([(1, "x")], "id long, k string")
    merged, ids = merge.merge_dimension(target, spark.createDataFrame([(5, "y"), (5, "y"), (6, "x")], "id long, k string"), ["k"])
    assert rows(merged, "id", "k") == [(1, "x"), (2, "y")] and rows(ids, "old_id", "new_id") == [(5, 2), (6, 1)]
    with pytest.raises(Exception, match="different rows"):
        merge.merge_dimension(target, spark.createDataFrame([(5, "y"), (5, "z")], "id long, k string"), ["k"])[0].collect()


def test_dimension_rows_are_created_once(spark, tmp_path):
    """Two batches share a dimension row, a third is the second again: each row is there once."""
    from tessera.streaming import ingest

    schema = "run_id long, ts timestamp, kind string, message string"
    feed = f"file://{tmp_path}/in"
    batch = lambda rows_: spark.createDataFrame(rows_, "run_id long, kind string, message string").selectExpr("run_id", "timestamp'2024-01-01 00:00:00' AS ts", "kind", "message").coalesce(1).write.mode("append").parquet(feed)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
        ingest.ingest(ingest.once(stream, "run_id", "ts", "1 hour"), f"file://{tmp_path}/out", {"kind": ["kind"]}, f"file://{tmp_path}/check").awaitTermination()

    batch([(1, "a", None), (2, "b", None)])
    run()
    batch([(2, "b", None), (3, "b", None), (4, "c", None)])
    run()
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for f in (last, last.parent / f".{last.name}.crc"):
        f.unlink(missing_ok=True)
    run()  # the last batch was not committed: it runs again
    kinds = spark.read.parquet(f"file://{tmp_path}/out/kind")
    assert rows(kinds, "kind") == [("a",), ("b",), ("c",)]
    assert rows(spark.read.parquet(f"file://{tmp_path}/out/run").join(kinds, "kind_id"), "run_id", "kind") == [(1, "a"), (2, "b"), (3, "b"), (4, "c")]


def test_instruction_tokens(spark):
    one = "array(named_struct('kind', 'id', 'number', {}L, 'bytes', cast(null as binary)), named_struct('kind', 'literal', 'number', cast(null as bigint), 'bytes', x'00FF'))"
    df = spark.range(1).select(programs.instruction_tokens(F.lit(61), F.expr(one.format(5))).alias("a"), programs.instruction_tokens(F.lit(61), F.expr(one.format(20000))).alias("b"))
    assert tuple(df.first()) == ([2061, 20005, 256, 511], None)


def test_a_checkpoint_folder_is_required():
    from tessera.plans.merge_queries import scratch

    def unset(master):
        context = types.SimpleNamespace(master=master, applicationId="app")
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda name, default=None: default), sparkContext=context)

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch(unset(master), "x")
    assert scratch(unset("local[8]"), "x").startswith("file:///tmp/checkpoints/app/x-")


def test_decoded_batches_of_odd_binaries(spark):
    """Against a walk word by word: several functions, labels without ids, damage, both byte orders."""
    rng = random.Random(8)
    binaries = [None, b"", b"\x03\x02#\x07", struct.pack("<5I", programs.MAGIC, 0, 0, 0, 0)]
    for _ in range(60):
        words = [programs.MAGIC, 0, 0, 9, 0]
        for _ in range(rng.randint(0, 12)):
            op, n = rng.choice([54, 248, 56, 61, 43, 5]), rng.randint(1, 4)
            words += [n << 16 | op, *(rng.randrange(99) for _ in range(n - 1))]
        if rng.random() < 0.2:
            words.append(rng.choice([0, 7 << 16 | 1]))
        data = struct.pack(f"{rng.choice('<>')}{len(words)}I", *words)
        binaries.append(data[: len(data) - rng.choice([0, 0, 2, 4])])

    def walk(data):
        data = (data or b"")[: len(data or b"") // 4 * 4]
        order = "<" if data[:4] == struct.pack("<I", programs.MAGIC) else ">"
        w = struct.unpack(f"{order}{len(data) // 4}I", data)
        if len(w) < 5 or w[0] != programs.MAGIC:
            return [(None,) * 5 + ("no header",)]
        out, i, func, block = [], 5, -1, None
        while i < len(w):
            n, op = w[i] >> 16, w[i] & 0xFFFF
            if n == 0 or i + n > len(w):
                return [*out, (None,) * 5 + ("an instruction is cut short",)]
            if op == 54:
                func, block = func + 1, None
            elif op == 248:
                block = w[i + 1] if n > 1 else None
            out.append((func if func >= 0 else None, block, len(out), op, list(w[i + 1 : i + n]), None))
            i += n
        return out

    df = spark.createDataFrame(list(enumerate(binaries)), "id long, b binary").repartition(3)
    got = [tuple(r) for r in programs.decode_binaries(df, "id", "b").collect()]
    want = [(i, *r) for i, b in enumerate(binaries) for r in walk(b)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


KINDS = {k: ("Id", [], {}) for k in ("IdRef", "IdResult", "IdResultType")} | {k: ("Literal", [], {}) for k in ("LiteralInteger", "LiteralString", "LiteralContextDependentNumber", "LiteralSpecConstantOpInteger")} | {"PairIdRefIdRef": ("Composite", ["IdRef", "IdRef"], {}), "PairLiteralIntegerIdRef": ("Composite", ["LiteralInteger", "IdRef"], {}), "Mode": ("ValueEnum", [], {7: ["LiteralInteger", "LiteralString"]}), "Mask": ("BitEnum", [], {2: ["LiteralInteger"], 4: ["IdRef", "IdRef"]})}


def test_operands_by_kind():
    from tessera.operators import operands

    grammar = operands.Grammar({1: [("IdResultType", ""), ("IdResult", ""), ("LiteralContextDependentNumber", "")], 2: [("Mask", "?")], 3: [("Mode", ""), ("IdRef", "*")], 4: [("LiteralString", ""), ("LiteralInteger", "?")], 5: [("PairIdRefIdRef", "*")], 6: [("IdResultType", ""), ("IdResult", ""), ("LiteralSpecConstantOpInteger", "")], 251: [("IdRef", ""), ("IdRef", ""), ("PairLiteralIntegerIdRef", "*")]}, frozenset(), KINDS)
    read = lambda op, words, sort=None, width=None: operands._Reader(grammar, op, words, sort, width).read()
    lit = lambda t: [256 + b for b in t.encode()]
    f = lambda x, kind: list(struct.unpack(f"<{len(struct.pack(kind, x)) // 4}I", struct.pack(kind, x)))
    text = lambda t: list(struct.unpack(f"<{len(t) // 4 + 1}I", t.ljust(len(t) // 4 * 4 + 4, b"\0")))
    assert read(1, [5, 6, *f(-3, "<i")], "signed", 32) == [20005, 20006, *lit("-3")]
    assert read(1, [5, 6, *f(-3, "<i")], "unsigned", 32) == [20005, 20006, *lit("4294967293")]
    assert read(1, [5, 6, *f(-(2**40), "<q")], "signed", 64) == [20005, 20006, *lit(str(-(2**40)))]
    assert read(1, [5, 6, *f(0.1, "<f")], "float", 32) == [20005, 20006, *lit("0.100000")]
    assert read(1, [5, 6, *f(1e10, "<d")], "float", 64) == [20005, 20006, *lit("10000000000.000000")]
    assert read(2, []) == [] and read(2, [6, 16, 1, 2]) == [*lit("6"), *lit("16"), 20001, 20002]
    assert read(3, [7, 9, *text(b"abcd"), 4, 5]) == [*lit("7"), *lit("9"), *lit("abcd"), 20004, 20005]
    assert read(4, text(b"")) == [] and read(4, [*text("né".encode()), 8]) == [*lit("né"), *lit("8")]
    assert read(5, [1, 2, 3, 4]) == [20001, 20002, 20003, 20004]
    assert read(6, [1, 2, 5, 8, 9]) == [20001, 20002, *lit("5"), 20008, 20009]
    assert read(251, [1, 2, *f(-1, "<q"), 3], "signed", 64) == [20001, 20002, *lit("-1"), 20003]
    for bad in ((1, [5, 6, 7], None, None), (1, [5, 6, 7], "float", 16), (1, [5, 6], "signed", 32), (2, [2]), (4, [0x41414141]), (5, [1]), (9, []), (2, [0, 1]), (5, [1, 20000])):
        with pytest.raises(ValueError):
            read(*bad)


def test_modules_to_tokens(spark, tmp_path):
    """Two functions of which the second is the entry; a type of the switch found through a load; each kind of damage."""
    import json

    from tessera.operators import operands

    ops = [(15, "Mode-Setting", "Model IdRef LiteralString"), (21, "Type-Declaration", "IdResult LiteralInteger LiteralInteger"), (43, "Constant-Creation", "IdResultType IdResult LiteralContextDependentNumber"), (54, "Function", "IdResultType IdResult Mask IdRef"), (55, "Function", "IdResultType IdResult"), (56, "Function", ""), (61, "Memory", "IdResultType IdResult IdRef"), (248, "Control-Flow", "IdResult"), (251, "Control-Flow", "IdRef IdRef PairLiteralIntegerIdRef*"), (71, "Annotation", "IdRef")]
    doc = {"instructions": [{"opcode": o, "opname": f"Op{o}", "class": c, "operands": [{"kind": k.rstrip("*")} | ({"quantifier": "*"} if k[-1] == "*" else {}) for k in kinds.split()]} for o, c, kinds in ops]}
    doc["operand_kinds"] = [{"category": c, "kind": k, "bases": b, "enumerants": [{"value": f"0x{v:x}", "parameters": [{"kind": p} for p in ps]} for v, ps in e.items()]} for k, (c, b, e) in KINDS.items()] + [{"category": "ValueEnum", "kind": "Model"}]
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    grammar = operands.read_grammar(spark, f"file://{tmp_path}/g.json")
    inst = lambda op, *w: [(len(w) + 1) << 16 | op, *w]
    head, name = [programs.MAGIC, 0, 0, 99, 0], [0x6E69616D, 0]
    body = inst(71, 1) + inst(21, 1, 64, 1) + inst(43, 1, 2, 5, 0) + inst(54, 1, 10, 0, 9) + inst(55, 1, 11) + inst(248, 12) + inst(61, 1, 13, 2) + inst(56) + inst(54, 1, 20, 0, 9) + inst(248, 21) + inst(61, 1, 22, 2) + inst(251, 22, 21, 0xFFFFFFFF, 0xFFFFFFFF, 21) + inst(56)
    entry = inst(15, 0, 20, *name)
    pack = lambda w: struct.pack(f"<{len(w)}I", *w)
    rows = [(1, pack(head + entry + body)), (2, pack(head + body)), (3, pack(head + entry + entry + body)), (4, pack(head + inst(15, 0, 77, *name) + body)), (5, pack(head + entry + body)[:-6]), (6, None), (7, pack(head + entry + body + inst(248, 99) + inst(999))), (8, pack(head + entry + body + inst(248, 30) + inst(61, 1, 21000, 2)))]
    blocks = spark.createDataFrame([(1, 21, 6), (1, 12, 4)], "id long, block_id long, times long")
    got = {r.id: r for r in operands.tokenise_binaries(spark.createDataFrame(rows, "id long, b binary"), "id", "b", grammar, blocks).collect()}
    lit = lambda t: [256 + b for b in t.encode()]
    types = [2021, 20001, *lit("64"), *lit("1"), 2043, 20001, 20002, *lit("5")]
    main = [2248, 20021, 2061, 20001, 20022, 20002, 2251, 20022, 20021, *lit("-1"), 20021]
    assert got[1].input_ids == types + main + [2248, 20012, 2061, 20001, 20013, 20002]
    assert [int(x) for x in got[1].trace] == [0] * len(types) + [6, 0, 6, 0, 0, 0, 6, 0, 0, 0, 0, 0] + [4, 0, 4, 0, 0, 0]
    assert {i: r.problem for i, r in got.items()} == {1: None, 2: "not one entry point", 3: "not one entry point", 4: "the entry point is no function", 5: "an instruction is cut short", 6: "no header", 7: "opcode 999 is not in the grammar", 8: "id 21000 is past the range"}
    assert all(r.input_ids is None and r.trace is None for i, r in got.items() if i > 1)
    assert operands.tokenise_binaries(spark.createDataFrame([], "id long, b binary"), "id", "b", grammar).count() == 0


def test_binaries_are_tokenised_where_they_are(spark, tmp_path):
    """Without blocks nothing is shuffled; with them rows once on each side. A null key's binary is read like any other."""
    from tessera.operators import operands

    grammar = operands.Grammar({15: [("Model", ""), ("IdRef", "")], 54: [], 248: [("IdResult", "")]}, frozenset(), KINDS | {"Model": ("ValueEnum", [], {})})
    words = [programs.MAGIC, 0, 0, 99, 0, 3 << 16 | 15, 0, 20, 5 << 16 | 54, 1, 20, 0, 9, 2 << 16 | 248, 21]
    df = spark.createDataFrame([(1, struct.pack(f"<{len(words)}I", *words)), (None, struct.pack(f">{len(words)}I", *words))], "id long, b binary")
    out = operands.tokenise_binaries(df, "id", "b", grammar)
    assert [(r.id, r.input_ids, [int(x) for x in r.trace], r.problem) for r in sorted(out.collect(), key=str)] == [(1, [2248, 20021], [0, 0], None), (None, [2248, 20021], [0, 0], None)]
    blocks = spark.createDataFrame([(1, 21, 3), (1, None, 4), (2, 21, 5)], "id long, block_id long, times long")
    counted = operands.tokenise_binaries(df, "id", "b", grammar, blocks)
    assert {r.id: [int(x) for x in r.trace] for r in counted.collect()} == {1: [3, 0], None: [0, 0]}
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (out, counted)]
    assert [p.count("Join") for p in plans] == [0, 1] and [p.count("Aggregate") for p in plans] == [0, 1]


def test_bytes_of_columns(spark):
    df = spark.createDataFrame([(1, bytes(range(256))), (2, b""), (3, None)], "id long, b binary")
    got = {r.id: r for r in df.select("id", scalar.byte_values(F.col("b")).alias("v"), store.unpack_counters(F.col("b"), 4).alias("c")).collect()}
    assert got[1].v == list(range(256)) and got[2].v == [] and got[3].v is None
    assert [int(x) for x in got[1].c] == list(struct.unpack("<64I", bytes(range(256)))) and got[2].c == [] and got[3].c is None


def ordered(seed, keys):
    import hashlib

    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}-{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("digits, most", [(4, 20_000), (1, 3)])
def test_splits_by_selection(spark, monkeypatch, digits, most):
    """The same rows as by sorting; no sort and no checkpoint in the plan."""
    from tessera.operators import ordinal

    monkeypatch.setattr(ordinal, "DIGITS", digits)
    monkeypatch.setattr(ordinal, "CELL_ROWS", most)
    keys = [*range(57), *range(40)]
    df = spark.createDataFrame([(k, "x") for k in [*keys, None]], "id long, v string")
    order = ordered(9, range(57))
    for shares, ceil, sizes in (([0.8], False, [45, 12]), ([0.8], True, [46, 11]), ([0.5, 0.25], False, [28, 14, 15]), ([0.0, 1.0], False, [0, 57, 0]), ([0.9, 0.9], True, [52, 5, 0])):
        names = ["a", "b", "c"][: len(shares) + 1]
        out = splits.ratio_split(df, "id", 9, shares, names, ceil)
        got, at = {r.id: r.split for r in out.collect()}, 0
        for name, n in zip(names, sizes, strict=True):
            assert all(got[k] == name for k in order[at : at + n])
            at += n
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Sort|rangepartitioning|Window|Join", plan)
    for n in (0, 1, 30, 56, 57, 90):
        unique = df.where("id is not null").distinct()
        assert sorted(r.id for r in splits.sample_rows(unique, "id", 9, n).collect()) == sorted(order[:n])
    twice = spark.createDataFrame([(k,) for k in range(10) for _ in range(3)], "id long")
    assert splits.sample_rows(twice, "id", 9, 5).groupBy("id").count().collect() and sorted(splits.sample_rows(twice, "id", 9, 5).collect()) == sorted([(ordered(9, range(10))[0],)] * 3 + [(ordered(9, range(10))[1],)] * 2)
    assert splits.ratio_split(df.where("1 = 0"), "id", 9, [0.5], ["a", "b"]).count() == 0


def test_first_rows_of_a_hot_group_are_taken_before_the_shuffle(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 2900, 0).otherwise(F.col("id")))
    out = splits.sample_of_group(df, ["g"], "id", 4, 2)
    assert rows(out, "g", "id", "pick") == [(0, k, i + 1) for i, k in sorted(enumerate(ordered(4, range(2900))[:2]), key=lambda x: x[1])]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_nearest_ancestors_of_a_deep_tree(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(hierarchy, "checkpointed", lambda df, f=hierarchy.checkpointed: calls.append(1) or f(df))
    n = 600
    nodes = spark.createDataFrame([(i, i - 1 if i else None, i in (0, 300, 301)) for i in range(n)] + [(1000, 999, False), (1001, 1000, False), (1002, None, False), (1003, 1002, True), (1004, 1003, None)], "id long, parent long, has boolean")
    got = {r.id: (r.nearest, r.steps) for r in hierarchy.nearest_with(nodes, F.col("has"), "id").collect()}
    want = {i: max(m for m in (0, 300, 301) if m < i) for i in range(1, n)}
    assert got == {i: (m, list(range(m + 1, i + 1))) for i, m in want.items()} | {1004: (1003, [1004])}
    assert len(calls) <= 12
    loop = spark.createDataFrame([(1, 2, False), (2, 1, False)], "id long, parent long, has boolean")
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.nearest_with(loop, F.col("has"), "id", most=50)


def test_equal_counters_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(samples, "RUN", 1000)
    df = spark.range(400).select(F.array_repeat(F.lit(7).cast("decimal(20,0)"), 50).alias("c")).unionByName(spark.createDataFrame([([1, None, 9, 9],), (None,), ([],)], "c array<long>").select(F.col("c").cast("array<decimal(20,0)>")))
    out = samples.sorted_counters(df, "c")
    got = out.withColumn("p", F.spark_partition_id()).collect()
    by = sorted((r.place, int(r.counter)) for r in got)
    assert by == [(1, 1), *((i, 7) for i in range(2, 20_002)), (20_002, 9), (20_003, 9)]
    sizes = Counter(r.p for r in got)
    assert len(sizes) == 4 and max(sizes.values()) < 12_000


def test_documents_are_named_by_their_ids(spark, tmp_path):
    from tessera.sources import named

    docs = spark.createDataFrame([("ab1", "x"), ("ab2", "é"), ("c", "one"), ("-q", "dash")], "id string, name string").select("id", F.struct(F.struct(F.struct("name").alias("info")).alias("Shader")).alias("document"))
    path = f"file://{tmp_path}/tree"
    named.write_named(docs.where("id <> '-q'"), path)
    assert sorted(str(p.relative_to(tmp_path / "tree")) for p in (tmp_path / "tree").rglob("*.json")) == ["a/b/ab1.json", "a/b/ab2.json", "c/c.json"]
    assert (tmp_path / "tree" / "_SUCCESS").read_text() == "3"
    back = lambda p, legacy=False: sorted((r.id, r.name) for r in store.read_documents(spark, p, legacy).select("id", "document.Shader.info.name").collect())
    assert back(path) == [("ab1", "x"), ("ab2", "é"), ("c", "one")]
    named.write_named(docs.where("id = 'ab1'"), path)  # again: the file is replaced
    assert back(path) == [("ab1", "x"), ("ab2", "é"), ("c", "one")]
    flat = f"file://{tmp_path}/flat"
    named.write_named(docs.where("id <> '-q'"), flat, suffix="v2")
    assert sorted(p.name for p in (tmp_path / "flat").glob("*.json")) == ["ab1-v2.json", "ab2-v2.json", "c-v2.json"] and back(flat, True) == back(path)
    named.write_named(docs.where("id = 'c'"), flat, suffix="v3")
    with pytest.raises(Exception, match="twice"):
        back(flat, True)
    for bad in (docs.unionByName(docs.where("id = 'c'")), docs.select(F.lit("a/b").alias("id"), "document"), docs.select(F.lit(None).cast("string").alias("id"), "document")):
        with pytest.raises(Exception):  # noqa: B017
            named.write_named(bad, f"file://{tmp_path}/bad")
    named.write_named(docs.where("1 = 0"), f"file://{tmp_path}/none")
    assert (tmp_path / "none" / "_SUCCESS").read_text() == "0"


def test_distances_of_blocks_are_those_of_pairs(spark):
    """Texts of one to 200 characters in blocks, empty ones and repeats too, against Spark's own distance of each pair."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    texts = spark.createDataFrame([(i, "w" if i < 70 else "v", None if i == 3 else word(rng.choice([0, 1, 63, 64, 65, 200]))) for i in range(80)], "id long, w string, t string")
    lines = spark.createDataFrame([("w", word(n)) for n in (0, 1, 64, 150, 400)] * 2 + [("v", word(90)), ("u", "a")], "w string, line string")
    blocks = scalar.in_blocks(texts, "w", "id", "t")
    assert sorted(len(r.x) for r in blocks.collect()) == [5, 10, 32, 32]
    got = lines.join(blocks, "w").select("line", F.inline(F.arrays_zip(F.col("x.id").alias("id"), scalar.block_distances(F.col("line"), F.col("x.t")).alias("d"))))
    want = lines.join(texts.where("t is not null"), "w").select("line", "id", F.levenshtein("t", "line").cast("long").alias("d"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_documents_are_read_once_in_few_tasks(spark, tmp_path):
    """400 files are read by as many tasks as parts are dealt, each once; blank, broken and hidden files, arrays and UTF-16 are as for Spark's reader."""
    from tessera.sources import named

    docs = spark.range(400).select(F.concat((F.col("id") % 7).cast("string"), F.lit("é"), F.col("id").cast("string")).alias("id"), F.struct(F.struct(F.struct(F.col("id").cast("string").alias("name")).alias("info")).alias("Shader")).alias("document"))
    flat = f"file://{tmp_path}/flat"
    named.write_named(docs, flat, suffix="v1")
    got = store.read_documents(spark, flat, legacy=True)
    assert "FileScan json" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.name) for r in got.select("id", "document.Shader.info.name").collect()) == sorted((f"{i % 7}é{i}", str(i)) for i in range(400))
    assert got.rdd.getNumPartitions() <= named.tasks(spark) and not [p for p in (tmp_path / "flat").iterdir() if p.is_dir()]
    tree = tmp_path / "tree"
    (tree / "x" / "y" / "z").mkdir(parents=True)
    (tree / "_temporary").mkdir()
    files = {"a": b'{"Error": "e"}', "x/b": b"", "x/y/c": b" \n", "x/y/z/d": b'{"Error": ', "e": b'[{"Error": "f"}]', "f": b"[]", "g": '{"Error": "é"}'.encode("utf-16"), "_h": b"{}", ".i": b"{}", "_temporary/j": b"{}", "k": b'{"Error": "k", "Shader": {"info": 3}}', "l": b"\xff\xff{", "m": b"null", "n": b'{"Error": 5}'}
    for name, data in files.items():
        (tree / f"{name}.json").write_bytes(data)
    (tree / "o.txt").write_text("{}")
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("id")
    want = spark.read.schema(store.DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(str(tree)).select(name, F.struct("Error", "Shader").alias("document"))
    assert sorted(map(str, store.read_documents(spark, str(tree)).collect())) == sorted(map(str, want.collect()))
    (tree / "p.json").write_text('[{"Error": "1"}, {"Error": "2"}]')
    with pytest.raises(Exception, match="twice"):
        store.read_documents(spark, str(tree)).collect()


def test_kernel_density_against_a_direct_sum(spark):
    import math
    import statistics

    rng = random.Random(3)
    data = [("a", rng.gauss(5, 2)) for _ in range(300)] + [("b", rng.expovariate(1)) for _ in range(80)] + [("c", 1.0), ("c", 1.0), ("d", 2.0), ("e", None), ("f", 1.0), ("f", 2.0)]
    got = {}
    for r in histogram.kernel_density(spark.createDataFrame(data, "g string, v double"), "g", "v", points=40).collect():
        got.setdefault(r.g, {})[r.place] = (r.x, r.density)
    assert set(got) == {"a", "b", "f"} and all(sorted(x) == list(range(40)) for x in got.values())
    for g, places in got.items():
        v = [x for h, x in data if h == g]
        h = statistics.stdev(v) * len(v) ** -0.2
        assert places[0][0] == pytest.approx(min(v) - 2 * h) and places[39][0] == pytest.approx(max(v) + 2 * h)
        for x, d in places.values():
            assert d == pytest.approx(sum(math.exp(-0.5 * ((x - y) / h) ** 2) for y in v) / (len(v) * h * math.sqrt(2 * math.pi)), abs=1e-6)
    assert histogram.kernel_density(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


@pytest.mark.parametrize("block", [512, 7])
def test_sparse_least_squares(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(regress, "BLOCK", block)
    monkeypatch.setattr(regress, "HELD", 3)
    rng = np.random.default_rng(2)
    x = np.where(rng.random((60, 20)) < 0.3, rng.integers(1, 9, (60, 20)), 0).astype(float)
    x[:, 7], x[:, 11] = 4.0, x[:, 3]  # one feature that does not vary, and one that is there twice
    y, w = x @ rng.normal(size=20) + rng.normal(size=60), rng.random(60) + 0.1
    long = spark.createDataFrame([(i, f"f{j:02d}", float(x[i, j])) for i in range(60) for j in range(20) if x[i, j]] + [(0, None, 1.0), (1, "f00", None), (999, "f00", 3.0)], "id long, feature string, value double")
    targets = spark.createDataFrame([(i, float(y[i]), float(w[i])) for i in range(60)] + [(70, None, 1.0)], "id long, y double, w double")
    for weight, ws in ((None, np.ones(60)), (F.col("w"), w)):
        got = dict(regress.sparse_ols(long, targets, "id", "y", weight))
        mean, mean_y = np.average(x, axis=0, weights=ws), np.average(y, weights=ws)
        root = np.sqrt(ws)[:, None]
        want = np.linalg.lstsq((x - mean) * root, (y - mean_y) * root[:, 0], rcond=1e-10)[0]
        assert [got[f"f{j:02d}"] for j in range(20)] == pytest.approx(list(want), abs=1e-6)
        assert got["(intercept)"] == pytest.approx(mean_y - mean @ want, abs=1e-6)
    assert regress.sparse_ols(long.where("1 = 0"), targets.where("1 = 0"), "id", "y") == [("(intercept)", 0.0)]
    assert regress.sparse_ols(long.where("1 = 0"), targets, "id", "y") == [("(intercept)", pytest.approx(float(np.mean(y))))]
    monkeypatch.setattr(regress, "MOST_FEATURES", 19)
    with pytest.raises(ValueError):
        regress.sparse_ols(long, targets, "id", "y")


def test_thousands_of_features(spark):
    """A design of 3,000 features, each in two rows: the fit gives the values back."""
    n = 3000
    long = spark.range(2 * n).selectExpr("id", "concat('f', id % 3000) AS feature", "cast(1 + id div 3000 AS double) AS value")
    targets = spark.range(2 * n).selectExpr("id", "cast((id % 3000 % 11) * (1 + id div 3000) + 5 AS double) AS y")
    got = dict(regress.sparse_ols(long, targets, "id", "y"))
    assert len(got) == n + 1 and got["(intercept)"] == pytest.approx(5, abs=1e-6)
    assert all(got[f"f{i}"] == pytest.approx(i % 11, abs=1e-6) for i in range(0, n, 37))


def test_rank_correlation_reads_its_rows_once(spark):
    """As the correlation of average ranks over the single rows; equal rows come many times, and each is read once."""
    import math

    rng = random.Random(5)
    data = [(g, float(x), float(x * rng.choice([1, 1, -2]) % 7)) for g in "ab" for x in (rng.randrange(9) for _ in range(60))] * 3 + [("a", None, 1.0), ("c", 1.0, 2.0), ("d", 1.0, 2.0), ("d", 1.0, 3.0)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(data, "g string, x double, y double")
    got = {r.g: r.spearman for r in metrics.spearman(df.mapInArrow(seen, df.schema), ["g"], "x", "y").collect()}
    assert read.value <= 2 * len(data)  # a checkpoint writes what it has counted
    for g in "ab":
        v = [(x, y) for h, x, y in data if h == g and x is not None]
        rank = lambda k: [sum(u[k] < w[k] for u in v) + (sum(u[k] == w[k] for u in v) + 1) / 2 for w in v]  # noqa: E731, B023
        p, q = rank(0), rank(1)
        mp, mq = sum(p) / len(p), sum(q) / len(q)
        want = sum((i - mp) * (j - mq) for i, j in zip(p, q, strict=True)) / math.sqrt(sum((i - mp) ** 2 for i in p) * sum((j - mq) ** 2 for j in q))
        assert got[g] == pytest.approx(want, abs=0.02 if g == "a" else 1e-9)  # the row without x has a rank of y
    assert got["c"] is None and math.isnan(got["d"])


def test_pieces_beside_other_columns(spark, monkeypatch):
    """Columns go along with the pieces of their row, also where batches are small, ids repeat and a task forgets words."""
    monkeypatch.setattr(bpe, "MEMORY", 2)
    texts = ["low lower é", None, "", "  low\n\tnew", "low", "\x00 a"] * 3
    df = spark.createDataFrame([(i % 4, t, f"k{i}") for i, t in enumerate(texts)], "id long, t string, k string").repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {r.k: "".join(r.pieces) for r in bpe.encode(df, "id", "t", [("l", "o"), ("lo", "w")], bpe.byte_words, keep=["k"]).collect()}
        blank = {r.k: list(r.pieces) for r in bpe.encode(df, "id", "t", [("l", "o"), ("lo", "w")], keep=["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    led = [" " + t if t and t[0] != " " else t or "" for t in texts]
    assert got == {f"k{i}": "".join(bpe.byte_symbols()[b] for b in t.encode()) for i, t in enumerate(led)}
    assert blank["k0"] == ["low", "low", "e", "r", "é"] and blank["k1"] == blank["k2"] == [] and len(blank) == len(texts)


@pytest.mark.parametrize("steps", [0, 500])
def test_sparse_least_squares_by_steps(spark, monkeypatch, steps):
    """Steps give what all moments give, the coefficients of least norm too; without enough steps the moments are taken."""
    import numpy as np

    monkeypatch.setattr(regress, "STEPPED", 5)
    monkeypatch.setattr(regress, "PIECE", 4)
    monkeypatch.setattr(regress, "STEPS", steps)
    rng = np.random.default_rng(4)
    x = np.where(rng.random((80, 15)) < 0.3, rng.integers(1, 9, (80, 15)), 0).astype(float)
    x[:, 7], x[:, 11] = 4.0, x[:, 3]
    y, w = x @ rng.normal(size=15) + rng.normal(size=80), rng.random(80) + 0.1
    long = spark.createDataFrame([(i, f"f{j:02d}", float(x[i, j])) for i in range(80) for j in range(15) if x[i, j]], "id long, feature string, value double")
    targets = spark.createDataFrame([(i, float(y[i]), float(w[i])) for i in range(80)], "id long, y double, w double")
    got = dict(regress.sparse_ols(long, targets, "id", "y", F.col("w")))
    mean, mean_y = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    want = np.linalg.lstsq((x - mean) * np.sqrt(w)[:, None], (y - mean_y) * np.sqrt(w), rcond=1e-10)[0]
    assert [got[f"f{j:02d}"] for j in range(15)] == pytest.approx(list(want), abs=1e-6)
    assert got["(intercept)"] == pytest.approx(mean_y - mean @ want, abs=1e-6)
    monkeypatch.setattr(regress, "MOST_MOMENTS", 10)
    if not steps:
        with pytest.raises(ValueError):
            regress.sparse_ols(long, targets, "id", "y", F.col("w"))


def test_more_features_than_moments(spark):
    """9,000 features, each in two rows: more than a fit by moments takes."""
    n = 9000
    long = spark.range(2 * n).selectExpr("id", "concat('f', id % 9000) AS feature", "cast(1 + id div 9000 AS double) AS value")
    targets = spark.range(2 * n).selectExpr("id", "cast((id % 9000 % 11) * (1 + id div 9000) + 5 AS double) AS y")
    got = dict(regress.sparse_ols(long, targets, "id", "y"))
    assert len(got) == n + 1 and got["(intercept)"] == pytest.approx(5, abs=1e-6)
    assert all(got[f"f{i}"] == pytest.approx(i % 11, abs=1e-6) for i in range(0, n, 37))


def test_a_hot_value_is_dealt_over_tasks(spark):
    big = spark.range(500).selectExpr("id", "if(id < 450, 'hot', cast(id AS string)) AS w")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("460", 3)], "w string, item int")
    got = merge.salted_join(big, small, "w", "id", salts=4)
    assert sorted((r.id, r.item) for r in got.collect()) == [(i, k) for i in range(450) for k in (1, 2)] + [(460, 3)]


def test_counts_in_update_mode_leave_late_rows_out(spark, tmp_path):
    from tessera.streaming import ingest

    feed = f"file://{tmp_path}/in"
    batch = lambda rows_: spark.createDataFrame(rows_, "ts string, kind string").select(F.col("ts").cast("timestamp").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(feed)

    def run():
        stream = spark.readStream.schema("ts timestamp, kind string").parquet(feed)
        ingest.store_counts(ingest.status_counts(stream, "ts", "1 day", "kind", "1 day"), f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()

    batch([("2024-01-01 10:00:00", "a"), ("2024-01-05 10:00:00", "a")])
    run()
    batch([("2024-01-05 11:00:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-05 12:00:00", "b")])  # the second is four days late
    run()
    got = ingest.stored_counts(spark, f"file://{tmp_path}/out", "kind").collect()
    assert sorted((str(r.start)[:10], r.kind, r.n) for r in got) == [("2024-01-01", "a", 1), ("2024-01-05", "a", 2), ("2024-01-05", "b", 1)]
