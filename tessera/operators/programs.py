"""Programs as instruction tables: decoding, parsing, statistics weighted by traces, features, distances."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the binary format: its magic number, the words before the first instruction, opcodes that end or begin parts.
MAGIC, HEADER_WORDS, OP_FUNCTION, OP_LABEL = 0x07230203, 5, 54, 248
#: Instruction classes in the order of the feature vector.
CLASSES = ("Arithmetic", "Control-Flow", "Miscellaneous", "Debug", "Annotation", "Extension", "Mode-Setting", "Type-Declaration", "Constant-Creation", "Memory", "Function", "Image", "Conversion", "Composite", "Bit", "Relational_and_Logical", "Derivative", "Atomic", "Primitive", "Barrier", "Group", "Device-Side_Enqueue", "Pipe", "Non-Uniform", "Reserved", "@exclude")
INSTRUCTION = "func_no int, block_id long, inst_no int, opcode int, words array<long>, problem string"


def instruction_starts(words: np.ndarray) -> tuple[list[int], str | None]:
    """Where the instructions of a binary's words begin, after its header, and what is wrong at its end."""
    if len(words) < HEADER_WORDS or words[0] != MAGIC:
        return [], "no header"
    sizes, starts, i = (words >> 16).tolist(), [], HEADER_WORDS
    while i < len(sizes):
        starts.append(i)
        if sizes[i] == 0 or i + sizes[i] > len(sizes):
            return starts[:-1], "an instruction is cut short"
        i += sizes[i]
    return starts, None


def split_words(data: bytes | None) -> tuple[np.ndarray, list[int], str | None]:
    """A binary's words, in the byte order of its magic number, and its instruction_starts."""
    data = (data or b"")[: len(data or b"") // 4 * 4]
    order = "<" if data[:4] == struct.pack("<I", MAGIC) else ">"
    words = np.frombuffer(data, dtype=f"{order}u4").astype(np.int64)
    return words, *instruction_starts(words)


def decode_binaries(df: DataFrame, key: str, binary: str) -> DataFrame:
    """Rows (key, func_no, block_id, inst_no, opcode, words, problem): the instruction table of a table of binaries.

    Words are in the byte order of the magic number. A binary without header has one row with a problem,
    a damaged one its instructions up to the damage and such a row. Null and empty ones have no header.
    All instructions of a batch are sliced at once.
    """
    names = [key, "func_no", "block_id", "inst_no", "opcode", "words", "problem"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many, starts, texts, problems = [], [], [], []
            for data in b.column(1).to_pylist():
                words, at, problem = split_words(data)
                many.append(words)
                starts.append(np.array(at, dtype=np.int64))
                problems.append(problem)
            if not many:
                continue
            base = np.cumsum([0, *map(len, many)])
            flat, at = np.concatenate(many), np.concatenate([s + o for s, o in zip(starts, base, strict=False)])
            of = np.repeat(np.arange(len(many)), [len(s) for s in starts])
            size, opcode = flat[at] >> 16, flat[at] & 0xFFFF
            first = np.searchsorted(of, np.arange(len(many)))
            n = np.arange(len(at))
            number = n - first[of]
            functions = np.cumsum(opcode == OP_FUNCTION)
            func = functions - (functions - (opcode == OP_FUNCTION))[first[of]] if len(at) else functions
            opens = (opcode == OP_FUNCTION) | (opcode == OP_LABEL)
            last = np.maximum.accumulate(np.where(opens | (number == 0), n, -1)) if len(at) else n
            label = (opcode[last] == OP_LABEL) & (size[last] > 1)
            block = np.where(label, flat[np.minimum(at[last] + 1, len(flat) - 1)], 0)
            inside = np.ones(len(flat), dtype=bool)
            inside[at] = False
            inside &= np.repeat(np.array([bool(len(s)) for s in starts]), np.diff(base))
            for s, o, end in zip(starts, base, base[1:], strict=False):  # not the header, nor what is damaged
                if len(s):
                    inside[o : o + HEADER_WORDS] = False
                    inside[o + s[-1] + (flat[o + s[-1]] >> 16) : end] = False
            offsets = np.concatenate([[0], np.cumsum(size - 1)]).astype(np.int32)
            none = [i for i, x in enumerate(problems) if x]
            words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[inside]))
            columns = [pa.array((func - 1).astype(np.int32), mask=func == 0), pa.array(block, mask=~label), pa.array(number.astype(np.int32)), pa.array(opcode.astype(np.int32)), words]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), *columns, pa.nulls(len(at), pa.string())], names=names)
            if none:
                blank = [pa.nulls(len(none), c.type) for c in columns]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(none)), *blank, pa.array([problems[i] for i in none])], names=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(binary).cast("binary")).mapInArrow(run, f"`{key}` {kind}, {INSTRUCTION}")


def parse_text(df: DataFrame, key: str, text: str, comment: str = ";") -> DataFrame:
    """Rows (key, line_no, result_id, opname, operands) of disassembly lines `[%id =] Op operand...`.

    Blank lines and lines that begin with the comment mark are left out.
    """
    body = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "_line")).withColumn("_line", F.trim("_line")).where(~F.startswith("_line", F.lit(comment)) & (F.col("_line") != ""))
    words = body.withColumn("_w", F.split("_line", r"\s+"))
    named = (F.size("_w") >= 3) & (F.get("_w", F.lit(1)) == "=")
    first = F.when(named, 2).otherwise(0)
    return words.select(key, "line_no", F.when(named, F.get("_w", F.lit(0))).alias("result_id"), F.get("_w", first).alias("opname"), F.slice("_w", first + 2, F.size("_w")).alias("operands"))


def opcode_table(spark, path: str, lines: bool = False) -> DataFrame:
    """Rows (opcode, opname, class, has_result, has_type) of the instruction lists of grammar documents, a file or a line each."""
    doc = spark.read.option("multiLine", not lines).schema("instructions array<struct<opcode:int,opname:string,class:string,operands:array<struct<kind:string>>>>").json(path)
    has = lambda kind: F.coalesce(F.exists("i.operands", lambda o: o["kind"] == kind), F.lit(False))
    return doc.select(F.explode("instructions").alias("i")).select("i.opcode", "i.opname", "i.class", has("IdResult").alias("has_result"), has("IdResultType").alias("has_type"))


def block_counts(traces: DataFrame, key: str, map_col: str, counters: str) -> DataFrame:
    """Rows (key, block_id, times) of a block -> index map and its array of counters; exploded here, after any join."""
    pairs = traces.select(key, F.explode(map_col).alias("block_id", "_i"), counters)
    return pairs.select(key, "block_id", F.get(counters, F.col("_i")).alias("times"))


def weighted_counts(insts: DataFrame, dim: DataFrame | None, blocks: DataFrame | None, by: str, key: str, on: str = "opcode") -> DataFrame:
    """Rows (key, by, n): instructions by class or name, each times its block's executions; without blocks, once.

    Blocks that the trace lacks count 0. Without `dim`, `by` is a column of the instructions themselves.
    """
    on = by if dim is None else on
    cells = [key, on] if blocks is None else [key, "block_id", on]
    small = insts.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))  # before any join: a row for each opcode of a block
    named = small if dim is None else small.join(dim.select(on, by) if by != on else dim.select(on), on)
    if blocks is None:
        return named.groupBy(key, by).agg(F.sum("_n").cast("decimal(38,0)").alias("n"))
    times = F.coalesce("times", F.lit(0)).cast("decimal(20,0)")
    return named.join(blocks, [key, "block_id"], "left").groupBy(key, by).agg(F.sum((F.col("_n") * times).cast("decimal(38,0)")).alias("n"))


def unmapped_blocks(insts: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    return insts.select(key, "block_id").where("block_id is not null").distinct().join(blocks.select(key, "block_id"), [key, "block_id"], "left_anti")


def features(counts: DataFrame, key: str, by: str, names: Sequence[str]) -> DataFrame:
    """Rows (key, total, <a column per name>): a feature table; what a program lacks is 0."""
    wide = counts.groupBy(key).pivot(by, list(names)).agg(F.sum("n").cast("double")).fillna(0.0)
    total = counts.groupBy(key).agg(F.sum("n").cast("double").alias("total"))
    return total.join(wide, key)


def class_invariant(by_op: DataFrame, by_class: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Keys and classes where the opcode counts do not add up to the class counts; empty if all is well."""
    again = by_op.join(dim.select("opname", "class"), "opname").groupBy(key, "class").agg(F.sum("n").alias("_again"))
    both = again.join(by_class, [key, "class"], "full_outer")
    return both.where(~F.coalesce("_again", F.lit(0).cast("decimal(38,0)")).eqNullSafe(F.coalesce("n", F.lit(0).cast("decimal(38,0)")))).select(key, "class")


def opcode_stream(insts: DataFrame, key: str) -> DataFrame:
    """Rows (key, opcodes): a program's opcodes in order."""
    return insts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("inst_no", "opcode"))), lambda x: x["opcode"]).alias("opcodes"))


#: Where the tokens of opcodes, ids, relative ids and literal bytes begin, and the ids' end.
OPCODE_BEGIN, ID_BEGIN, RELATIVE_ZERO, LITERAL_BEGIN, ID_END = 2000, 20000, 30000, 256, 40000


def literal_tokens(literal: Column) -> Column:
    """The bytes of a literal as tokens; none for null and empty."""
    from tessera.functions.scalar import byte_values

    return F.coalesce(F.transform(byte_values(literal), lambda b: b + LITERAL_BEGIN), F.array().cast("array<int>"))


def instruction_tokens(opcode: Column, operands: Column) -> Column:
    """An opcode and its operands as tokens: arrays of structs (kind, number, bytes).

    kind `id` is the id's number, `literal` its bytes, `enum` the number itself. An id past the range
    makes the instruction's tokens null, which fails its program as token_lengths reports.
    """
    one = lambda o: F.when(o["kind"] == "id", F.array((o["number"] + ID_BEGIN).cast("int"))).when(o["kind"] == "literal", literal_tokens(o["bytes"])).otherwise(F.array(o["number"].cast("int")))
    past = F.exists(operands, lambda o: (o["kind"] == "id") & (o["number"] + ID_BEGIN >= ID_END))
    return F.when(~past, F.concat(F.array((opcode + OPCODE_BEGIN).cast("int")), F.flatten(F.transform(operands, one))))


def program_tokens(insts: DataFrame, key: str, entry: DataFrame, order: Sequence[str], tokens: str, times: str) -> DataFrame:
    """Rows (key, input_ids, trace): a program's tokens; an opcode has its block's executions, operands 0.

    The instructions before any function (types, constants) come first, with trace 0; then the entry
    function of `entry` (key, func_no); then the other functions in their order. A program with an
    instruction without tokens has null arrays.
    """
    rows = insts.join(entry.select(key, F.col("func_no").alias("_entry")), key, "left")
    section = F.when(F.col("func_no").isNull(), 0).when(F.col("func_no") == F.col("_entry"), 1).otherwise(2)
    count = F.when(section == 0, F.lit(0)).otherwise(F.coalesce(F.col(times), F.lit(0))).cast("decimal(20,0)")
    part = F.struct(section.alias("_s"), F.coalesce("func_no", F.lit(-1)).alias("_f"), *order, F.col(tokens).alias("_t"), count.alias("_c"))
    got = rows.groupBy(key).agg(F.sort_array(F.collect_list(part)).alias("_x"), F.count_if(F.col(tokens).isNull()).alias("_bad"))
    zero = F.lit(0).cast("decimal(20,0)")
    trace = F.flatten(F.transform("_x", lambda x: F.concat(F.array(x["_c"]), F.array_repeat(zero, F.size(x["_t"]) - 1))))
    good = F.col("_bad") == 0
    return got.select(key, F.when(good, F.flatten(F.transform("_x", lambda x: x["_t"]))).alias("input_ids"), F.when(good, trace).alias("trace"))


def relative_ids(uses: DataFrame, definitions: DataFrame, key: str, id: str, position: str) -> DataFrame:
    """uses with `relative`: 30000 + definition position - use position, held within the ids' range; null without a definition."""
    d = definitions.select(key, id, F.col(position).alias("_d"))
    return uses.join(d, [key, id], "left").withColumn("relative", F.greatest(F.least(RELATIVE_ZERO + F.col("_d") - F.col(position), F.lit(ID_END)), F.lit(ID_BEGIN))).drop("_d")


def token_lengths(tokens: DataFrame, known: DataFrame | None, key: str, ids: str) -> DataFrame:
    """Rows (key, length) of the programs that `known` lacks: tokens + 1, null where there are no tokens."""
    new = tokens if known is None else tokens.join(known.select(key), key, "left_anti")
    return new.select(key, (F.size(F.col(ids)) + 1).alias("length"))  # the size of null is null


def store_lengths(lengths: DataFrame, path: str, key: str) -> None:
    """Write a table of lengths, and beside it the fingerprint of the programs that it is of."""
    lengths.write.parquet(f"{path}/lengths")
    lengths.sparkSession.read.parquet(f"{path}/lengths").agg(*_fingerprint(key)).write.parquet(f"{path}/fingerprint")


def _fingerprint(key: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("digest")]


def stored_lengths(programs: DataFrame, path: str, key: str) -> DataFrame | None:
    """The stored lengths if they are of just these programs (by number and keys), else None."""
    spark = programs.sparkSession
    then, now = spark.read.parquet(f"{path}/fingerprint").first(), programs.agg(*_fingerprint(key)).first()
    return spark.read.parquet(f"{path}/lengths") if tuple(then) == tuple(now) else None


def step_table(pairs: DataFrame, opcodes: str, parent_opcodes: str) -> DataFrame:
    """pairs with distance (opcode edits to the parent), ratio (to the parent's length); unchanged ones are left out."""
    from tessera.functions.scalar import opcode_distance

    out = pairs.withColumn("distance", opcode_distance(F.col(opcodes), F.col(parent_opcodes)))
    return out.withColumn("ratio", F.try_divide(F.col("distance"), F.size(parent_opcodes))).where("distance > 0")


def size_by_group(df: DataFrame, group: str, binary: Column) -> DataFrame:
    return df.groupBy(group).agg(F.avg(F.octet_length(binary)).alias("mean_size"), F.stddev_pop(F.octet_length(binary)).alias("stdev_size"))


def bit_occupancy(counters: DataFrame, col: str) -> DataFrame:
    """Rows (bit, n): counters with each bit set, bits 0 to 62; negative counters have none."""
    sums = counters.agg(*[F.count_if((F.col(col) >= 0) & (F.getbit(F.col(col), F.lit(i)) == 1)).alias(f"b{i}") for i in range(63)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(i).alias("bit"), F.col(f"b{i}").alias("n")) for i in range(63)])))


def masked_examples(df: DataFrame, key: str, ids: str, length: int, seed: int, epoch: int, p: float, vocab_size: int, mask_id: int, pad_id: int) -> DataFrame:
    """Rows (key, input_ids, labels): a crop or right-padded array of `length`, a share p of places to predict.

    Of those 80 % are masked, 10 % random, 10 % kept; other labels are -100. All draws are hashes of
    (seed, key, epoch, place), so that a lost task draws again what it drew before.
    """
    draw = lambda what, place: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"), F.lit(str(epoch)), F.lit(what), place.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    start = F.floor(draw("crop", F.lit(0)) * (F.size(ids) - length + 1)).cast("int")
    fitted = F.when(F.size(ids) > length, F.slice(F.col(ids), start + 1, length)).otherwise(F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), F.greatest(length - F.size(ids), F.lit(0)))))
    base = df.select(key, fitted.alias("_x"))
    masked = lambda i: draw("mask", i) < p
    how = lambda i: draw("how", i)
    inputs = F.transform("_x", lambda x, i: F.when(masked(i) & (how(i) < 0.8), mask_id).when(masked(i) & (how(i) < 0.9), F.floor(draw("word", i) * vocab_size).cast("int")).otherwise(x))
    return base.select(key, inputs.alias("input_ids"), F.transform("_x", lambda x, i: F.when(masked(i), x).otherwise(-100)).alias("labels"))


def padded_batches(df: DataFrame, key: str, ids: str, size: int, multiple: int = 8) -> DataFrame:
    """df with batch and length: rows in the order of their sizes, `size` to a batch, padded to the longest of each."""
    from tessera.functions.scalar import round_up

    from .ordinal import global_rank

    ranked = global_rank(df.withColumn("_size", F.size(ids)), "_size", key, name="_r").withColumn("batch", F.floor((F.col("_r") - 1) / size))
    longest = ranked.groupBy("batch").agg(F.max("_size").alias("_most"))
    return ranked.join(longest, "batch").withColumn("length", round_up(F.col("_most"), multiple)).drop("_size", "_r", "_most")


def trace_embedding(trace: Column, length: Column, method: str, dim: int) -> Column:
    """Left-padded counters as vectors: `onehot-base2` the bits less one half, `value` the counter alone, `none` null."""
    from tessera.functions.scalar import base2_digits

    if method == "none":
        return F.lit(None).cast("array<array<double>>")
    one = {"onehot-base2": lambda c: F.transform(base2_digits(c.cast("long"), dim), lambda b: b.cast("double") - 0.5), "value": lambda c: F.array(c.cast("double"))}[method]
    vectors = F.transform(trace, one)
    return F.concat(F.array_repeat(one(F.lit(0)), F.greatest(length - F.size(trace), F.lit(0))), vectors)


def assemble_batches(df: DataFrame, key: str, ids: str, size: int, label: str | None = None, trace: str | None = None, method: str = "none", dim: int = 32, multiple: int = 8) -> DataFrame:
    """Rows (key, batch, input_ids, attention_mask, position_ids, labels, trace_embeddings) for training.

    Batches are padded_batches; ids, masks, positions and counters are padded on the left. `label`,
    whatever its name, is given as labels. A null counter array is all padding.
    """
    from tessera.functions import scalar

    b = padded_batches(df, key, ids, size, multiple)
    t = trace_embedding(F.coalesce(trace, F.array().cast("array<long>")), F.col("length"), method if trace else "none", dim)
    return b.select(key, "batch", scalar.pad_left(F.col(ids), F.col("length")).alias("input_ids"), scalar.attention_mask(F.col(ids), F.col("length")).alias("attention_mask"), scalar.positions(F.col(ids), F.col("length")).alias("position_ids"), (F.col(label) if label else F.lit(None).cast("double")).alias("labels"), t.alias("trace_embeddings"))


def pair_batches(df: DataFrame, key: str, left: str, right: str, size: int, label: str | None = None, multiple: int = 8) -> DataFrame:
    """Rows (key, batch, feature_q, feature_k, labels): pairs in batches by the left part's size, each side padded to
    its own longest. Where a batch's first pair has no right part, all its feature_k are null and labels are given."""
    b = padded_batches(df, key, left, size, multiple).withColumnRenamed("length", "_l")
    both = b.groupBy("batch").agg(F.max(F.size(right)).alias("_most"), F.min_by(F.col(right).isNull(), F.struct(F.size(left), key)).alias("_alone"))
    from tessera.functions.scalar import pad_left, round_up

    rows = b.join(both, "batch")
    k = F.when(~F.col("_alone"), pad_left(F.coalesce(right, F.array().cast("array<int>")), round_up(F.greatest("_most", F.lit(0)), multiple)))
    return rows.select(key, "batch", pad_left(F.col(left), F.col("_l")).alias("feature_q"), k.alias("feature_k"), F.when(F.col("_alone"), F.col(label) if label else F.lit(None)).alias("labels"))
