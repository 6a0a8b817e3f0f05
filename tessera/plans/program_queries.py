"""Programs: instruction tables, statistics weighted by traces, tokens and steps, over documents and line items.

Lines of documents stand for instructions (the first word is the opcode, its length its class) and
line items of an order for the instructions of a binary.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import programs
from tessera.sources import store

from .merge_queries import scratch
from .registry import query, table

_INST = """ln AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
inst AS (SELECT doc_id, line_no, regexp_split_to_array(line, '[ \\t\\n\\x0B\\f\\r]+') AS w FROM ln WHERE line <> '' AND NOT starts_with(line, ';')),
op AS (SELECT doc_id, line_no, w[1] AS opname, CASE length(w[1]) % 3 WHEN 0 THEN 'Memory' WHEN 1 THEN 'Bit' ELSE 'Image' END AS class, line_no % 4 AS block_id FROM inst WHERE w[2] IS DISTINCT FROM '=')"""


def _insts(spark, sf_dir):
    parsed = programs.parse_text(table(spark, sf_dir, "documents"), "doc_id", "text")
    n = F.length("opname") % 3
    return parsed.withColumn("class", F.when(n == 0, "Memory").when(n == 1, "Bit").otherwise("Image")).withColumn("block_id", (F.col("line_no") % 4).cast("long"))


@query(f"WITH {_INST} SELECT doc_id, CAST(line_no AS INT) AS line_no, w[1] AS opname, len(w) - 1 AS n_operands FROM inst WHERE w[2] IS DISTINCT FROM '='")
def text_parse(spark, sf_dir):
    out = programs.parse_text(table(spark, sf_dir, "documents"), "doc_id", "text").where("result_id IS NULL")
    return out.select("doc_id", "line_no", "opname", F.size("operands").cast("long").alias("n_operands"))


def _blocks(spark, sf_dir):
    """Three of four blocks are traced, as often as the document's quality label says, plus one."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    t = labels.select("doc_id", F.expr("map(0L, 0, 1L, 1, 2L, 2)").alias("m"), F.array(*[((F.col("q") + 1) * k).cast("decimal(20,0)") for k in (1, 10, 100)]).alias("c"))
    return programs.block_counts(t, "doc_id", "m", "c")


_BLOCKS = "bl AS (SELECT doc_id, (q + 1) * CASE b WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END AS times, b AS block_id FROM (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1), (SELECT unnest([0, 1, 2]) AS b))"


@query(f"WITH {_INST}, {_BLOCKS} SELECT op.doc_id, class, sum(coalesce(times, 0))::BIGINT AS n FROM op LEFT JOIN bl ON bl.doc_id = op.doc_id AND bl.block_id = op.block_id GROUP BY 1, 2")
def inst_stats_weighted(spark, sf_dir):
    insts = _insts(spark, sf_dir).where("result_id IS NULL")
    out = programs.weighted_counts(insts, None, _blocks(spark, sf_dir), "class", "doc_id")
    return out.select("doc_id", "class", F.col("n").cast("long").alias("n"))


@query(f"WITH {_INST}, {_BLOCKS} SELECT DISTINCT op.doc_id, CAST(op.block_id AS BIGINT) AS block_id FROM op WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.doc_id = op.doc_id AND bl.block_id = op.block_id)")
def unmapped_blocks(spark, sf_dir):
    return programs.unmapped_blocks(_insts(spark, sf_dir).where("result_id IS NULL"), _blocks(spark, sf_dir), "doc_id")


@query(f"""WITH {_INST} SELECT doc_id, count(*)::DOUBLE AS total, count(*) FILTER (WHERE class = 'Memory')::DOUBLE AS "Memory", count(*) FILTER (WHERE class = 'Image')::DOUBLE AS "Image", count(*) FILTER (WHERE class = 'Bit')::DOUBLE AS "Bit" FROM op GROUP BY 1""")
def feature_vectors(spark, sf_dir):
    insts = _insts(spark, sf_dir).where("result_id IS NULL")
    counts = programs.weighted_counts(insts, None, None, "class", "doc_id")
    return programs.features(counts, "doc_id", "class", ["Memory", "Image", "Bit"])


@query(f"WITH {_INST} SELECT DISTINCT doc_id, class FROM op WHERE doc_id % 7 = 0 AND block_id = 3")
def class_invariant(spark, sf_dir):
    """Opcode counts from which a block of some documents is missing do not add up to class counts."""
    insts = _insts(spark, sf_dir).where("result_id IS NULL")
    dim = store.written(insts.select("opname", "class").distinct(), scratch(spark, "instruction-names"))
    by_op = programs.weighted_counts(insts.where("NOT (doc_id % 7 = 0 AND block_id = 3)"), None, None, "opname", "doc_id")
    return programs.class_invariant(by_op, programs.weighted_counts(insts, None, None, "class", "doc_id"), dim, "doc_id")


def _binaries(spark, sf_dir):
    """A binary per order: a header, a function, a label, then each line item as an instruction of two words."""
    word = lambda c: F.concat(*[F.substring(F.lpad(F.hex(c.cast("long")), 8, "0"), 7 - 2 * k, 2) for k in range(4)])  # noqa: E731  little-endian
    head = [F.lit(programs.MAGIC), *[F.lit(0)] * 4, F.lit(2 << 16 | programs.OP_FUNCTION), F.lit(1), F.lit(2 << 16 | programs.OP_LABEL), F.col("l_orderkey")]
    items = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: F.concat(word(F.lit(2 << 16) + x["l_linenumber"] + 100), word(x["l_quantity"])))
    got = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(items, "").alias("body"))
    return got.select("l_orderkey", F.unhex(F.concat(*[word(h) for h in head], F.col("body"))).alias("binary"))


@query("SELECT l_orderkey, 0 AS func_no, l_orderkey AS block_id, CAST(1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS INT) AS inst_no, 100 + l_linenumber AS opcode, CAST(l_quantity AS BIGINT) AS word FROM lineitem")
def binary_decode(spark, sf_dir):
    out = programs.decode_binaries(_binaries(spark, sf_dir), "l_orderkey", "binary").where(~F.col("opcode").isin(programs.OP_FUNCTION, programs.OP_LABEL))
    return out.select("l_orderkey", "func_no", "block_id", "inst_no", "opcode", F.get("words", F.lit(0)).alias("word"))


@query("WITH p AS (SELECT l_orderkey, 36 + 8 * count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderpriority, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS stdev_size FROM p JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def size_by_group(spark, sf_dir):
    joined = _binaries(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = programs.size_by_group(joined, "o_orderpriority", F.col("binary"))
    return out.select("o_orderpriority", F.round("mean_size", 6).alias("mean_size"), F.round("stdev_size", 6).alias("stdev_size"))


def _word(c):
    """A 32-bit word in little-endian hex."""
    c = c.cast("long")
    byte = lambda k: F.shiftleft(F.shiftright(c, 8 * k).bitwiseAND(0xFF), 24 - 8 * k)
    return F.lpad(F.hex(byte(0).bitwiseOR(byte(1)).bitwiseOR(byte(2)).bitwiseOR(byte(3))), 8, "0")


def _instruction(opcode, *operands):
    return F.concat(_word(F.lit((len(operands) + 1) << 16 | opcode)), *[_word(o if not isinstance(o, int) else F.lit(o)) for o in operands])


def _text(c):
    """A string's words in hex, with one zero byte at least."""
    h = F.hex(F.encode(c, "UTF-8"))
    return F.rpad(h, (8 * F.floor(F.length(h) / 8) + 8).cast("int"), "0")


#: The kinds of the instructions that `_modules` writes, as a grammar document has them; 3000 is one with a string.
_GRAMMAR = [
    (1, "OpUndef", "Miscellaneous", "IdResultType IdResult"), (15, "OpEntryPoint", "Mode-Setting", "ExecutionModel IdRef LiteralString IdRef*"), (21, "OpTypeInt", "Type-Declaration", "IdResult LiteralInteger LiteralInteger"), (22, "OpTypeFloat", "Type-Declaration", "IdResult LiteralInteger"),
    (43, "OpConstant", "Constant-Creation", "IdResultType IdResult LiteralContextDependentNumber"), (54, "OpFunction", "Function", "IdResultType IdResult FunctionControl IdRef"), (56, "OpFunctionEnd", "Function", ""), (61, "OpLoad", "Memory", "IdResultType IdResult IdRef MemoryAccess?"),
    (248, "OpLabel", "Control-Flow", "IdResult"), (251, "OpSwitch", "Control-Flow", "IdRef IdRef PairLiteralIntegerIdRef*"), (3000, "OpNote", "Debug", "LiteralString"),
]
_KINDS = [("Id", k, [], []) for k in ("IdRef", "IdResult", "IdResultType")] + [("Literal", k, [], []) for k in ("LiteralInteger", "LiteralString", "LiteralContextDependentNumber")] + [("Composite", "PairLiteralIntegerIdRef", ["LiteralInteger", "IdRef"], []), ("ValueEnum", "ExecutionModel", [], []), ("BitEnum", "FunctionControl", [], []), ("BitEnum", "MemoryAccess", [], [("0x0002", [("LiteralInteger",)])])]


def _grammar(spark):
    from tessera.operators import operands

    path = scratch(spark, "operand-grammar")
    kinds = lambda text: [(k.rstrip("?*"), k[-1] if k[-1] in "?*" else None) for k in text.split()]
    row = ([(o, n, c, kinds(k)) for o, n, c, k in _GRAMMAR], _KINDS)
    schema = "instructions array<struct<opcode: int, opname: string, class: string, operands: array<struct<kind: string, quantifier: string>>>>, operand_kinds array<struct<category: string, kind: string, bases: array<string>, enumerants: array<struct<value: string, parameters: array<struct<kind: string>>>>>>"
    spark.createDataFrame([row], schema).write.json(path)
    return operands.read_grammar(spark, path)


def _modules(spark, sf_dir):
    """A module per order: types, three constants a line item, a function that loads, selects and notes; each seventh is cut short."""
    n = F.col("l_linenumber").cast("long")
    i = 100 + 3 * n
    constants = F.concat(_instruction(43, 1, i, F.col("l_quantity").cast("long") - 25), _instruction(43, 2, i + 1, F.col("l_partkey"), n), _instruction(43, 3, i + 2, F.when(n % 2 == 1, 0x3FC00000).otherwise(0xC0000000)))
    load = F.when(n % 2 == 1, _instruction(61, 1, 2000 + n, i, 2, F.col("l_suppkey"))).otherwise(_instruction(61, 1, 2000 + n, i))
    note = _text(F.concat("l_linestatus", F.lit(" "), F.col("l_linenumber").cast("string")))
    code = F.concat(load, _instruction(251, 2000 + n, 9000, F.col("l_quantity").cast("long") - 25, 9000), _word(((F.length(note) / 8 + 1) * 65536 + 3000).cast("long")), note)
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(n.alias("n"), "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", constants.alias("constants"), code.alias("code")).alias("x"))
    all_ = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    name = _text(F.concat(F.lit("order"), F.col("l_orderkey").cast("string")))
    entry = F.concat(_word(((F.length(name) / 8 + 3) * 65536 + 15).cast("long")), _word(F.lit(0)), _word(F.lit(4)), name)
    types = [_instruction(21, 1, 32, 1), _instruction(21, 2, 64, 0), _instruction(22, 3, 32)]
    joined = lambda field: F.array_join(F.transform("x", lambda x: x[field]), "")
    head = [_word(F.lit(programs.MAGIC)), *[_word(F.lit(0))] * 4]
    whole = F.concat(*head, entry, *types, joined("constants"), _instruction(54, 5, 4, 0, 6), _instruction(248, 9000), joined("code"), _instruction(56))
    return all_.select("l_orderkey", F.unhex(F.when(F.col("l_orderkey") % 7 == 0, F.substr(whole, F.lit(1), F.length(whole) - 12)).otherwise(whole)).alias("binary"))


_LITERAL = lambda t: f"array_to_string(list_transform(string_split({t}, ''), lambda c: 256 + ascii(c)), ' ')"


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber AS n, l_partkey, l_suppkey, l_quantity, l_linestatus,
  '2043 20001 ' || (20100 + 3 * l_linenumber) || ' ' || {_LITERAL("CAST(CAST(l_quantity AS BIGINT) - 25 AS VARCHAR)")} || ' 2043 20002 ' || (20101 + 3 * l_linenumber) || ' ' || {_LITERAL("CAST(l_partkey + l_linenumber * 4294967296 AS VARCHAR)")}
    || ' 2043 20003 ' || (20102 + 3 * l_linenumber) || ' ' || {_LITERAL("CASE WHEN l_linenumber % 2 = 1 THEN '1.500000' ELSE '-2.000000' END")} AS a,
  '2061 20001 ' || (22000 + l_linenumber) || ' ' || (20100 + 3 * l_linenumber) || CASE WHEN l_linenumber % 2 = 1 THEN ' 306 ' || {_LITERAL("CAST(l_suppkey AS VARCHAR)")} ELSE '' END
    || ' 2251 ' || (22000 + l_linenumber) || ' 29000 ' || {_LITERAL("CAST(CAST(l_quantity AS BIGINT) - 25 AS VARCHAR)")} || ' 29000 5000 ' || {_LITERAL("l_linestatus || ' ' || l_linenumber")} AS b FROM lineitem),
p AS (SELECT l_orderkey, count(*) AS n, '2021 20001 ' || {_LITERAL("'32'")} || ' 305 2021 20002 ' || {_LITERAL("'64'")} || ' 304 2022 20003 ' || {_LITERAL("'32'")} || ' ' || string_agg(a, ' ' ORDER BY n, l_partkey, l_suppkey, l_quantity, l_linestatus) || ' 2248 29000 ' || string_agg(b, ' ' ORDER BY n, l_partkey, l_suppkey, l_quantity, l_linestatus) AS tokens FROM i GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN l_orderkey % 7 <> 0 THEN tokens END AS tokens, CASE WHEN l_orderkey % 7 <> 0 THEN len(string_split(tokens, ' ')) END AS n_trace,
  CASE WHEN l_orderkey % 7 <> 0 THEN n * (1 + 3 * n) END AS executed, CASE WHEN l_orderkey % 7 = 0 THEN 'an instruction is cut short' END AS problem FROM p""")
def binary_tokens(spark, sf_dir):
    """Modules tokenised from their binaries by a grammar document, with the executions of their block."""
    from tessera.operators import operands

    blocks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("times")).withColumn("block_id", F.lit(9000).cast("long"))
    out = operands.tokenise_binaries(_modules(spark, sf_dir), "l_orderkey", "binary", _grammar(spark), blocks)
    text = F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ")
    total = F.aggregate("trace", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    return out.select("l_orderkey", text.alias("tokens"), F.size("trace").cast("long").alias("n_trace"), total.cast("long").alias("executed"), "problem")


_TOKENS = """i AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber % 3 = 2 THEN 1 ELSE 2 END AS s, CASE WHEN l_linenumber = 1 THEN -1 ELSE l_linenumber % 3 END AS f, l_linenumber, l_suppkey, l_partkey, l_quantity,
 CASE WHEN l_linenumber = 1 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS c, (2100 + l_linenumber) || ' ' || (20000 + l_suppkey) || ' ' || (256 + ascii(l_returnflag)) || ' ' || 7 AS t FROM lineitem)"""


def _operands():
    empty = F.lit(None).cast("binary")
    one = lambda kind, number, data: F.struct(F.lit(kind).alias("kind"), number.cast("long").alias("number"), data.alias("bytes"))
    return F.array(one("id", F.col("l_suppkey"), empty), one("literal", F.lit(None), F.col("l_returnflag").cast("binary")), one("enum", F.lit(7), empty))


_ALL_TOKENS = "bool_and(coalesce(20000 + l_suppkey < 40000, false))"


@query(f"WITH {_TOKENS} SELECT l_orderkey, CASE WHEN {_ALL_TOKENS} THEN string_agg(t, ' ' ORDER BY s, f, l_linenumber, l_suppkey, l_partkey, l_quantity, t) END AS tokens, CASE WHEN {_ALL_TOKENS} THEN string_agg(c || ' 0 0 0', ' ' ORDER BY s, f, l_linenumber, l_suppkey, l_partkey, l_quantity, t) END AS trace FROM i GROUP BY 1")
def program_tokens(spark, sf_dir):
    """Line items as instructions: the first as a type, the others of three functions, of which the third is the entry.

    Supplier numbers are ids: an order with one of 20,000 or more, past the range of ids, has no tokens. That is
    the reference's rule: its tokenizer fails on such an id (vkExecute/src/spv/Tokenizer.cpp:333-337), and the
    program is then one without tokens (vkPredict/misc/ComplexDatasetSnapshotter.py:357-363).
    """
    items = table(spark, sf_dir, "lineitem")
    insts = items.select("l_orderkey", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") % 3).alias("func_no"), "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", F.col("l_quantity").cast("long").alias("times"), programs.instruction_tokens(100 + F.col("l_linenumber"), _operands()).alias("t"))
    entry = items.select("l_orderkey", F.lit(2).alias("func_no")).distinct()
    out = programs.program_tokens(insts, "l_orderkey", entry, ["l_linenumber", "l_suppkey", "l_partkey", "l_quantity"], "t", "times")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return out.select("l_orderkey", text("input_ids").alias("tokens"), text("trace").alias("trace"))


@query("""WITH d AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, greatest(least(30000 + d.p - l.l_linenumber, 40000), 20000) AS relative FROM lineitem l JOIN d USING (l_orderkey, l_partkey)""")
def relative_ids(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return programs.relative_ids(items, items.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("l_linenumber")), "l_orderkey", "l_partkey", "l_linenumber")


def _lengths(spark, sf_dir):
    """Programs of line items whose ids are part numbers; those past 19,999 have no tokens."""
    empty = F.lit(None).cast("binary")
    operand = F.array(F.struct(F.lit("id").alias("kind"), (F.col("l_partkey") * 10 + 1000).alias("number"), empty.alias("bytes")))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).alias("func_no"), F.lit(1).alias("times"), programs.instruction_tokens(F.col("l_linenumber"), operand).alias("t"))
    return programs.program_tokens(items, "l_orderkey", items.select("l_orderkey", "func_no").distinct(), ["l_linenumber"], "t", "times")


@query("SELECT l_orderkey, CASE WHEN max(l_partkey) * 10 + 1000 < 20000 THEN 2 * count(*) + 1 END AS length FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1")
def token_lengths(spark, sf_dir):
    tokens = _lengths(spark, sf_dir)
    out = programs.token_lengths(tokens, tokens.where("l_orderkey % 4 = 0"), "l_orderkey", "input_ids")
    return out.select("l_orderkey", F.col("length").cast("long").alias("length"))


@query("SELECT 'same' AS programs, count(*) AS n, count(*) FILTER (WHERE m * 10 + 1000 >= 20000) AS failed FROM (SELECT l_orderkey, max(l_partkey) AS m FROM lineitem GROUP BY 1) UNION ALL SELECT 'fewer', 0, 0")
def lengths_reused(spark, sf_dir):
    """Stored lengths are used again for the programs that they are of, and for no other ones."""
    tokens, path = _lengths(spark, sf_dir), scratch(spark, "lengths")
    programs.store_lengths(programs.token_lengths(tokens, None, "l_orderkey", "input_ids"), path, "l_orderkey")
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    again, other = programs.stored_lengths(keys, path, "l_orderkey"), programs.stored_lengths(keys.where("l_orderkey > 1"), path, "l_orderkey")
    none = again.where("1 = 0") if other is None else other
    count = lambda df, name: df.agg(F.lit(name).alias("programs"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("length").isNull()).alias("failed"))
    return count(again, "same").unionByName(count(none, "fewer"))


@query("""SELECT o_orderkey, CASE WHEN n IS NULL THEN 'failedTokenize' WHEN n <= 9 THEN 'belowOrEqualThreshold9' ELSE 'aboveThreshold9' END AS label_length FROM orders LEFT JOIN
(SELECT l_orderkey, CASE WHEN max(l_partkey) * 10 + 1000 < 20000 THEN 2 * count(*) + 1 END AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def cohort_length(spark, sf_dir):
    from tessera.operators.cohorts import label_length

    lengths = programs.token_lengths(_lengths(spark, sf_dir), None, "l_orderkey", "input_ids").withColumnRenamed("l_orderkey", "o_orderkey")
    return label_length(table(spark, sf_dir, "orders").select("o_orderkey"), lengths, "o_orderkey", 9)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <= 4 AND max(l_partkey) * 10 + 1000 < 20000)")
def runs_within_length(spark, sf_dir):
    from tessera.operators.filters import within_length

    lengths = programs.token_lengths(_lengths(spark, sf_dir), None, "l_orderkey", "input_ids").withColumnRenamed("l_orderkey", "o_orderkey")
    return within_length(table(spark, sf_dir, "orders").select("o_orderkey"), lengths, "o_orderkey", 9)


@query("SELECT p_partkey AS opcode, p_name AS opname, p_brand AS class, p_size % 2 = 0 AS has_result, p_size % 3 = 0 AS has_type FROM part")
def grammar_table(spark, sf_dir):
    """An instruction grammar written as JSON documents and read as a dimension."""
    kinds = F.filter(F.array(F.when(F.col("p_size") % 2 == 0, F.struct(F.lit("IdResult").alias("kind"))), F.when(F.col("p_size") % 3 == 0, F.struct(F.lit("IdResultType").alias("kind"))), F.struct(F.lit("IdRef").alias("kind"))), lambda k: k.isNotNull())
    path = scratch(spark, "grammar")
    one = F.struct(F.col("p_partkey").alias("opcode"), F.col("p_name").alias("opname"), F.col("p_brand").alias("class"), kinds.alias("operands"))
    table(spark, sf_dir, "part").select(F.array(one).alias("instructions")).write.json(path)
    out = programs.opcode_table(spark, path, lines=True)
    return out.select(F.col("opcode").cast("long").alias("opcode"), "opname", "class", "has_result", "has_type")


@query("""WITH s AS (SELECT l_orderkey, string_agg(chr(CAST(33 + l_linenumber * 3 + l_quantity % 3 AS INT)), '' ORDER BY l_linenumber, l_quantity) AS a, count(*) AS n FROM lineitem GROUP BY 1)
SELECT x.l_orderkey, levenshtein(x.a, y.a) AS distance, round(levenshtein(x.a, y.a) / y.n, 6) AS ratio FROM s x JOIN s y ON y.l_orderkey = x.l_orderkey - 1 WHERE levenshtein(x.a, y.a) > 0""")
def step_table(spark, sf_dir):
    """Each order's opcodes against those of the order before."""
    insts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_quantity").alias("inst_no"), (100 + F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 3).alias("opcode"))
    stream = programs.opcode_stream(insts, "l_orderkey")
    before = stream.select((F.col("l_orderkey") + 1).alias("l_orderkey"), F.col("opcodes").alias("parent_opcodes"))
    out = programs.step_table(stream.join(before, "l_orderkey"), "opcodes", "parent_opcodes")
    return out.select("l_orderkey", F.col("distance").cast("long").alias("distance"), F.round("ratio", 6).alias("ratio"))


@query("SELECT o_orderkey, true AS parsed, CAST(CAST(o_orderkey AS HUGEINT) + CAST('18446744073709551615' AS HUGEINT) AS VARCHAR) AS total, CAST(o_orderkey AS BIGINT) AS first_block FROM orders")
def counters_decoded(spark, sf_dir):
    """JSON counters up to the greatest unsigned value, integer-keyed maps, and packed counters, decoded alike."""
    key = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("["), key, F.lit(",18446744073709551615]"))
    swapped = F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0)), lambda k: F.substring(F.lpad(F.hex("o_orderkey"), 16, "0"), 2 * k + 1, F.lit(2))), "")
    packed = F.unhex(F.concat(swapped, F.lit("FFFFFFFFFFFFFFFF")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", store.parse_counters(text).alias("c"), store.unpack_counters(packed).alias("p"), store.parse_block_map(F.concat(F.lit('{"7":'), key, F.lit("}"))).alias("m"))
    total = F.aggregate("c", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    return o.select("o_orderkey", (F.col("c") == F.col("p")).alias("parsed"), total.cast("string").alias("total"), F.try_element_at("m", F.lit(7)).cast("long").alias("first_block"))


@query("""SELECT o_orderpriority AS "environmentId", o_orderkey AS "shaderId", round(avg(l_extendedprice), 7) AS "timeMean", count(*) AS counters FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def sample_assembly(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list("l_extendedprice")).alias("results"), F.to_json(F.collect_list(F.col("l_quantity").cast("long"))).alias("counters"))
    orders = table(spark, sf_dir, "orders")
    e = orders.select(F.col("o_orderpriority").alias("environment"), F.col("o_orderkey").alias("shader"), F.col("o_orderkey").alias("trace"), "o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    shaders = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("shader_id"), F.lit(None).cast("binary").alias("fragment_spv"))
    traces = items.select(F.col("l_orderkey").alias("id"), F.lit('{"1":0}').alias("bb_idx_map"), F.col("counters").alias("bb_trace_counters"), F.lit(None).cast("binary").alias("traced_fragment_spv"))
    out = store.assemble_samples(e.select("environment", "shader", "trace", "results"), shaders, traces)
    return out.select("environmentId", "shaderId", F.round("timeMean", 7).alias("timeMean"), F.size("bbTraceCounters").cast("long").alias("counters"))
