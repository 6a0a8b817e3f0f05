"""Vocabularies of a text corpus: counting, ordering, merging, encoding and decoding lines, files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import byte_values

from .ordinal import checkpointed, global_rank

#: Special symbols in their order, and the padding symbol's pattern.
SPECIALS = ("<s>", "<pad>", "</s>", "<unk>")
FILLER, OVERWRITE = "madeupword%04d", "#fairseq:overwrite"


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, line_no, line); a null text has no lines."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def line_tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


def count_symbols(of_lines: DataFrame, line: str = "line", eos: str = "</s>") -> DataFrame:
    """Rows (symbol, count): tokens of all lines, and one end symbol for each line."""
    tokens = of_lines.select(F.explode(F.concat(line_tokens(F.col(line)), F.array(F.lit(eos)))).alias("symbol"))
    return tokens.groupBy("symbol").agg(F.count(F.lit(1)).alias("count"))


def finalise(counts: DataFrame, threshold: int = 1, nwords: int | None = None, multiple: int = 1, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """Rows (symbol, count, index): specials first, then by count and symbol; filled up to a multiple."""
    spark, counts = counts.sparkSession, checkpointed(counts)  # the corpus is counted once
    special = spark.createDataFrame([(s, i) for i, s in enumerate(specials)], "symbol string, index long")
    first = special.join(counts, "symbol", "left").select("symbol", F.coalesce("count", F.lit(0)).alias("count"), "index")
    rest = counts.where(~F.col("symbol").isin(list(specials)) & (F.col("count") >= threshold))
    ranked = global_rank(rest, F.col("count").desc(), "symbol", name="_r")
    if nwords is not None:
        ranked = ranked.where(F.col("_r") <= nwords - len(specials))
    out = first.unionByName(ranked.select("symbol", "count", (F.col("_r") + len(specials) - 1).alias("index")))
    if multiple <= 1:
        return out
    size = out.agg(F.count(F.lit(1)).alias("_n"))
    fill = size.select("_n", F.explode(F.when(F.col("_n") % multiple != 0, F.sequence(F.lit(0), multiple - F.col("_n") % multiple - 1))).alias("_i"))
    return out.unionByName(fill.select(F.format_string(FILLER, F.col("_i").cast("int")).alias("symbol"), F.lit(0).cast("long").alias("count"), (F.col("_n") + F.col("_i")).alias("index")))


def merge_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("symbol").agg(F.sum("count").alias("count"))


#: So many symbols of a vocabulary go to every task, those of the least indexes; the others are joined.
SMALL_VOCAB = 500_000


class Held(NamedTuple):
    """(symbol, index) of the symbols that every task has, and the whole vocabulary if it has more."""

    few: list[tuple[str, int]]
    whole: DataFrame | None


def held(vocab: DataFrame) -> Held:
    """A vocabulary to be used more than once; it is worked out once."""
    known = checkpointed(vocab.select("symbol", "index").where("symbol is not null and index is not null"))
    rows = known.limit(SMALL_VOCAB + 1).collect()
    if len(rows) <= SMALL_VOCAB:
        return Held([tuple(r) for r in rows], None)
    return Held([tuple(r) for r in known.where(F.col("index") < SMALL_VOCAB).limit(SMALL_VOCAB).collect()], known)


def _with_found(rows: DataFrame, wanted: Column, whole: DataFrame | None, key: Sequence[str], on: str, value: str) -> DataFrame:
    """rows with _found: the values that a vocabulary has for their `wanted`, in that order, null for what it lacks.

    Only what is wanted is joined; rows themselves are shuffled once, by their keys, which are distinct.
    """
    if whole is None:
        return rows.withColumn("_found", F.lit(None).cast(f"array<{'long' if value == 'index' else 'string'}>"))
    long = rows.select(*key, wanted.alias("_wanted")).select(*key, F.posexplode("_wanted").alias("_at", on))
    named = long.join(whole.groupBy(on).agg(F.min(value).alias(value)), on, "left")
    got = named.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_at", F.col(value).alias("v")))).alias("_x"))
    got = got.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)], F.transform("_x", lambda x: x["v"]).alias("_found"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(key)])
    return rows.join(got, same, "left").drop(*[f"_key{i}" for i in range(len(key))])


def encode_lines(of_lines: DataFrame, vocab: DataFrame | Held, key: Sequence[str], line: str = "line", unk: str = "<unk>", eos: str | None = "</s>", reverse: bool = False) -> DataFrame:
    """Rows (key..., ids): each line's symbol indexes, unknown ones that of `unk`; the end symbol stays last.

    The SMALL_VOCAB symbols of the least indexes, in a finalised vocabulary the most frequent, are looked
    up where the lines are read; other tokens alone are joined to a larger vocabulary. A null line has
    the end symbol alone. Keys are distinct.
    """
    few, whole = vocab if isinstance(vocab, Held) else held(vocab)
    index = {s.encode(): i for s, i in few}
    if whole is not None:
        index |= {r["symbol"].encode(): r["index"] for r in whole.where(F.col("symbol").isin([unk, *([eos] if eos else [])])).collect()}
    other = index.get(unk.encode())

    def words(t: bytes | None) -> list[bytes]:
        found = (t or b"").split()  # at ASCII blanks, as \\s+ does
        return found[::-1] if reverse else found

    def strange(s: pa.Array) -> pa.Array:
        return pa.array([[w for w in words(t) if w not in index] for t in s.cast(pa.binary()).to_pylist()], pa.list_(pa.string()))

    def run(s: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, more in zip(s.cast(pa.binary()).to_pylist(), found.to_pylist(), strict=True):
            rest = iter(more or ())
            ids = [index[w] if w in index else next(rest, None) for w in words(t)]
            if other is not None:
                ids = [other if i is None else i for i in ids]
            if eos:
                ids.append(index.get(eos.encode(), other))
            out.append([i for i in ids if i is not None])
        return pa.array(out, pa.list_(pa.int64()))

    rows = of_lines.select(*key, F.col(line).alias("_line"))
    rows = _with_found(rows, F.arrow_udf(strange, "array<string>")("_line"), whole, key, "symbol", "index")
    return rows.select(*key, F.arrow_udf(run, "array<long>")("_line", "_found").alias("ids"))


def decode_lines(encoded: DataFrame, vocab: DataFrame | Held, key: Sequence[str], ids: str = "ids", drop: Sequence[str] = ("</s>",), subword: str | None = None) -> DataFrame:
    """Rows (key..., text): symbols joined by blanks, without `drop`; `subword`: a mark whose blank-followed ends are glued.

    Indexes that the vocabulary lacks are left out. As in encode_lines, only indexes that not every task
    has are joined. Keys are distinct.
    """
    few, whole = vocab if isinstance(vocab, Held) else held(vocab)
    symbol, dropped = {i: s for s, i in few}, set(drop)

    def strange(s: pa.Array) -> pa.Array:
        return pa.array([[i for i in x or [] if i is not None and i not in symbol] for x in s.to_pylist()], pa.list_(pa.int64()))

    def run(s: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for x, more in zip(s.to_pylist(), found.to_pylist(), strict=True):
            rest = iter(more or ())
            symbols = [symbol[i] if i in symbol else next(rest, None) for i in x or [] if i is not None]
            out.append(" ".join(t for t in symbols if t is not None and t not in dropped))
        return pa.array(out, pa.string())

    rows = encoded.select(*key, F.col(ids).alias("_ids"))
    rows = _with_found(rows, F.arrow_udf(strange, "array<long>")("_ids"), whole, key, "index", "symbol")
    out = rows.select(*key, F.arrow_udf(run, "string")("_ids", "_found").alias("text"))
    return out if subword is None else out.withColumn("text", F.rtrim(F.replace(F.concat(F.col("text"), F.lit(" ")), F.lit(subword + " "), F.lit(""))))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Text lines `<symbol> <count>` in the order of the index."""
    vocab.orderBy("index").select(F.concat_ws(" ", "symbol", F.col("count").cast("string"))).write.text(path)


def read_vocab(spark, path: str) -> DataFrame:
    """Rows (symbol, count) of a vocabulary file; a symbol twice is an error unless its later line has the overwrite mark, which then holds."""
    text = spark.read.text(path).withColumn("_over", F.col("value").endswith(" " + OVERWRITE))
    body = F.when(F.col("_over"), F.substring("value", 1, F.length("value") - len(OVERWRITE) - 1)).otherwise(F.col("value"))
    rows = text.select(F.regexp_extract(body, r"^(.*) (\d+)$", 1).alias("symbol"), F.regexp_extract(body, r"^(.*) (\d+)$", 2).cast("long").alias("count"), "_over")
    once = rows.groupBy("symbol").agg(F.count_if(~F.col("_over")).alias("_n"), F.max_by("count", "_over").alias("count"))
    return once.select(F.when(F.col("_n") <= 1, F.col("symbol")).otherwise(F.raise_error(F.concat(F.lit("twice: "), F.col("symbol"))).cast("string")).alias("symbol"), "count")


def byte_ids(text: Column) -> Column:
    """The UTF-8 bytes of a text as integers."""
    return byte_values(F.encode(text, "UTF-8"))


def bytes_text(ids: Column) -> Column:
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), "")), "UTF-8")
