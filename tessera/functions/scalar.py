"""Column functions on ids, names, counters, token arrays and trials."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def byte_values(data: Column) -> Column:
    """The bytes of a binary column as integers, in time proportional to them; null stays null."""
    return F.transform(F.filter(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: c != ""), F.ascii)

#: Ids of the special tokens.
PAD, BOS, EOS, MASK, SEP, UNK, CLS = 1000, 1001, 1002, 1003, 1004, 1005, 1006


def mangle(id: Column) -> Column:
    """`3dXttZ` -> `3dXttZ-NLULLU`: each character's kind (N digit, L lower, U upper), for stores blind to case.

    Null unless the id is letters and digits only.
    """
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(id, "[0-9]", "#"), "[a-z]", "%"), "[A-Z]", "U"), "#", "N")
    return F.when(id.rlike("^[0-9A-Za-z]+$"), F.concat(id, F.lit("-"), F.replace(kinds, F.lit("%"), F.lit("L"))))


def unmangle(name: Column) -> Column:
    """The id of a mangled name whose letters may have lost their case; null if the two parts do not fit."""
    body, kinds = F.split_part(name, F.lit("-"), F.lit(1)), F.split_part(name, F.lit("-"), F.lit(2))
    pairs = F.arrays_zip(F.split(body, "").alias("c"), F.split(kinds, "").alias("k"))
    cased = F.transform(pairs, lambda p: F.when(p["k"] == "U", F.upper(p["c"])).when(p["k"] == "L", F.lower(p["c"])).otherwise(p["c"]))
    fits = (F.length(body) == F.length(kinds)) & F.forall(pairs, lambda p: F.when(p["k"] == "N", p["c"].rlike("[0-9]")).when(p["k"].isin("U", "L"), p["c"].rlike("[A-Za-z]")).otherwise(p["c"] == ""))
    return F.when(fits, F.array_join(cased, ""))


def id_path(id: Column) -> Column:
    """first/second/id, for stores that spread files over folders."""
    return F.concat_ws("/", F.substring(id, 1, 1), F.substring(id, 2, 1), id)


def slug(title: Column) -> Column:
    """Letters and digits of any script, blanks as `-`, nothing else."""
    return F.regexp_replace(F.regexp_replace(title, " ", "-"), r"[^\p{L}\p{Nd}-]", "")


def flag_to_name(flag: Column) -> Column:
    """LOOP_UNROLL -> loop-unroll."""
    return F.replace(F.lower(flag), F.lit("_"), F.lit("-"))


def name_to_flag(name: Column, known: Sequence[str]) -> Column:
    """loop-unroll -> LOOP_UNROLL; NONE if it is not known."""
    flag = F.replace(F.upper(name), F.lit("-"), F.lit("_"))
    return F.when(flag.isin(list(known)), flag).otherwise("NONE")


def ticks_to_seconds(ticks: Column, period_ns: Column, cycles: Column) -> Column:
    return F.try_divide(ticks * period_ns / 1e9, cycles)


def frames_per_second(seconds: Column) -> Column:
    return F.try_divide(F.lit(1.0), seconds)


def base2_digits(x: Column, bits: int, shift: float | None = None) -> Column:
    """Bits of a non-negative counter, lowest first; bits from the 63rd on and those of negatives are 0."""
    ones = [(F.getbit(x, F.lit(i)) if i < 63 else F.lit(0)).cast("int") for i in range(bits)]
    safe = [F.when(x >= 0, b).otherwise(0) for b in ones]
    return F.array(*[b if shift is None else b + F.lit(shift) for b in safe])


def digits(x: Column, base: int, n: int) -> Column:
    """n digits in a base, lowest first."""
    return F.array(*[F.floor(x / F.lit(base**i)) % base for i in range(n)]) if base**n < 2**53 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("div", x, F.pow(F.lit(float(base)), i).cast("long")) % base)


def from_digits(a: Column, base: int) -> Column:
    return F.aggregate(F.reverse(a), F.lit(0).cast("long"), lambda s, d: s * base + d.cast("long"))


def id_label(id: Column) -> Column:
    """An integer of the id's characters in base 128."""
    return F.aggregate(F.filter(F.split(id, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s * 128 + F.ascii(c))


def with_special(ids: Column, pair: Column | None = None) -> Column:
    """BOS ids, or BOS ids EOS pair EOS."""
    if pair is None:
        return F.concat(F.array(F.lit(BOS)), ids)
    return F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)), pair, F.array(F.lit(EOS)))


def type_ids(ids: Column, pair: Column) -> Column:
    """0 for BOS, the first part and its EOS, 1 for the pair and its EOS."""
    return F.concat(F.array_repeat(F.lit(0), F.size(ids) + 2), F.array_repeat(F.lit(1), F.size(pair) + 1))


def round_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int")


def pad_left(ids: Column, length: Column, fill: int = PAD) -> Column:
    return F.concat(F.array_repeat(F.lit(fill), F.greatest(length - F.size(ids), F.lit(0))), ids)


def attention_mask(ids: Column, length: Column) -> Column:
    return pad_left(F.array_repeat(F.lit(1), F.size(ids)), length, 0)


def positions(ids: Column, length: Column) -> Column:
    """0, 1, ... over the ids; the padding has 0."""
    return pad_left(F.transform(ids, lambda x, i: i), length, 0)


def constant_like(ids: Column, value: int = 1) -> Column:
    return F.array_repeat(F.lit(value), F.size(ids))


def opcode_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of opcodes below 55,000, each taken as one character."""
    text = lambda x: F.array_join(F.transform(x, lambda c: F.decode(F.unhex(F.lpad(F.hex((c + 1).cast("long")), 4, "0")), "UTF-16BE")), "")
    return F.levenshtein(text(a), text(b))


def text_distances(texts: Sequence[str]) -> Callable[[str], list[int]]:
    """A function that gives the edit distances of one text to each of `texts`, all in one pass over it.

    Bits of one integer are the rows of the texts' distance tables, each text's apart by a bit that stays
    empty; a character of the other text moves all of them by one column (Myers 1999, Hyyro 2003).
    """
    at, low, full, rows, where = 0, 0, 0, [], {}
    for t in texts:
        ones = (1 << len(t)) - 1
        low, full = low | (1 << at if t else 0), full | ones << at
        rows.append((at, ones))
        for i, c in enumerate(t, at):
            where.setdefault(c, []).append(i)
        at += len(t) + 1
    match = {}
    for c, places in where.items():
        bits = bytearray(at // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        match[c] = int.from_bytes(bits, "little")

    def distances(text: str) -> list[int]:
        up, down = full, 0  # rows that are one more, or one less, than the row before
        for c in text:
            eq = match.get(c, 0)
            x = (((eq & up) + up) ^ up) | eq | down
            more, less = (down | (full & ~(x | up))) << 1 | low, (up & x) << 1
            x = eq | down
            up, down = (less | ~(x | more)) & full, more & x & full
        return [len(text) + (up >> i & ones).bit_count() - (down >> i & ones).bit_count() for i, ones in rows]

    return distances


#: Texts that are compared in one pass, and results that a task keeps for equal rows.
BLOCK, KEPT = 32, 256


def in_blocks(texts: DataFrame, by: str, id: str, text: str) -> DataFrame:
    """Rows (by, x): the structs (id, text) of each value of `by`, BLOCK at most to a row; null texts are left out."""
    known = texts.where(F.col(text).isNotNull())
    block = F.floor((F.row_number().over(Window.partitionBy(by).orderBy(id)) - 1) / BLOCK)
    return known.withColumn("_block", block).groupBy(by, "_block").agg(F.sort_array(F.collect_list(F.struct(id, text))).alias("x")).drop("_block")


def block_distances(text: Column, block: Column) -> Column:
    """The edit distances of a text to each of an array of texts, none of them null."""

    def run(s: pa.Array, blocks: pa.Array) -> pa.Array:
        made = lru_cache(KEPT)(text_distances)
        one = lru_cache(KEPT)(lambda t, b: made(b)(t))
        return pa.array([one(t, tuple(b)) for t, b in zip(s.to_pylist(), blocks.to_pylist(), strict=True)], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")(text, block)


def consistent(frames: Column) -> Column:
    """Aggregate: whether all frames of a run have one hash."""
    return F.count_distinct(frames) == 1
