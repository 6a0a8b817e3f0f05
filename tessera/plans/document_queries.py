"""Vocabularies, subwords, names, padding and edit distances over documents, pages, parts and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import bpe, filters, merge, programs, vocab
from tessera.sources import store

from .merge_queries import scratch
from .registry import query, table

_LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL)"
_TOKS = "tk AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS toks FROM ln)"
_COUNTS = f"{_LINES}, {_TOKS}, ct AS (SELECT symbol, count(*) AS count FROM (SELECT unnest(list_append(toks, '</s>')) AS symbol FROM tk) GROUP BY 1)"
_VOCAB = "sp(symbol, index) AS (VALUES ('<s>', 0), ('<pad>', 1), ('</s>', 2), ('<unk>', 3)), rk AS (SELECT symbol, count, row_number() OVER (ORDER BY count DESC, encode(symbol)) AS r FROM ct WHERE symbol NOT IN (SELECT symbol FROM sp) AND count >= 3), vb AS (SELECT symbol, coalesce(count, 0) AS count, CAST(index AS BIGINT) AS index FROM sp LEFT JOIN ct USING (symbol) UNION ALL SELECT symbol, count, r + 3 FROM rk WHERE r <= 1000)"


def _counts(spark, sf_dir):
    return vocab.count_symbols(vocab.lines(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(f"WITH {_COUNTS} SELECT * FROM ct")
def vocab_build(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"WITH {_COUNTS}, {_VOCAB}, n AS (SELECT count(*) AS n FROM vb) SELECT * FROM vb UNION ALL SELECT 'madeupword' || lpad(CAST(i AS VARCHAR), 4, '0'), 0, n + i FROM n, (SELECT unnest(range(8)) AS i) WHERE i < (8 - n % 8) % 8")
def vocab_finalize(spark, sf_dir):
    return vocab.finalise(_counts(spark, sf_dir), threshold=3, nwords=1004, multiple=8)


@query(f"WITH {_COUNTS}, {_VOCAB}, e AS (SELECT doc_id, line_no, unnest(list_append(toks, '</s>')) AS symbol, unnest(range(len(toks) + 1)) AS pos FROM tk) SELECT doc_id, CAST(line_no AS INT) AS line_no, string_agg(coalesce(index, 3), ' ' ORDER BY pos) AS ids FROM e LEFT JOIN vb USING (symbol) GROUP BY 1, 2")
def vocab_encode(spark, sf_dir):
    words = vocab.finalise(_counts(spark, sf_dir), threshold=3, nwords=1004)
    out = vocab.encode_lines(vocab.lines(table(spark, sf_dir, "documents"), "doc_id", "text"), words, ["doc_id", "line_no"])
    return out.select("doc_id", "line_no", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query(f"WITH {_LINES}, {_TOKS} SELECT doc_id, CAST(line_no AS INT) AS line_no, array_to_string(toks, ' ') AS text FROM tk")
def vocab_roundtrip(spark, sf_dir):
    """All symbols kept: decoding what was encoded gives the lines with single blanks."""
    lines = vocab.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    words = vocab.held(vocab.finalise(_counts(spark, sf_dir)))
    return vocab.decode_lines(vocab.encode_lines(lines, words, ["doc_id", "line_no"]), words, ["doc_id", "line_no"])


@query(f"""WITH {_COUNTS} SELECT symbol, sum(count)::BIGINT AS count FROM (SELECT * FROM ct UNION ALL SELECT symbol, count(*) FROM (SELECT unnest(list_append(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), '</s>')) AS symbol FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark)) GROUP BY 1) GROUP BY 1""")
def vocab_merge(spark, sf_dir):
    other = vocab.count_symbols(vocab.lines(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    return vocab.merge_counts(_counts(spark, sf_dir), other)


@query("SELECT p_type AS symbol, count(*) AS count FROM part GROUP BY 1")
def vocab_file(spark, sf_dir):
    """Written to a vocabulary file and read again."""
    path = scratch(spark, "vocab")
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("symbol")).agg(F.count(F.lit(1)).alias("count")).withColumn("index", F.col("count"))
    vocab.write_vocab(counts, path)
    return vocab.read_vocab(spark, path)


@query("SELECT p_partkey, p_name AS back, octet_length(encode(p_name))::INT AS n, ascii(p_name) AS first FROM part")
def byte_dictionary(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select("p_partkey", vocab.byte_ids(F.col("p_name")).alias("ids"))
    return ids.select("p_partkey", vocab.bytes_text(F.col("ids")).alias("back"), F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first"))


#: SQL has no look-ahead: a mark before the last of several blanks, where a word follows, does what `\\s+(?!\\S)` does.
_BLANK, _MARK = "[ \\t\\n\\x0B\\f\\r]", "\ue000"
_BYTE_WORDS = f"""led AS (SELECT doc_id, CASE WHEN text <> '' AND NOT starts_with(text, ' ') THEN ' ' || text ELSE coalesce(text, '') END AS t FROM documents),
spelt(s) AS (SELECT list(CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 THEN chr(b::INT) ELSE chr(256 + k::INT) END ORDER BY b) FROM (SELECT b, sum(CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 THEN 0 ELSE 1 END) OVER (ORDER BY b) - 1 AS k FROM range(256) r(b))),
raw AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(t, '({_BLANK}+)({_BLANK})([^ \\t\\n\\x0B\\f\\r])', '\\1{_MARK}\\2\\3', 'g'), '''s|''t|''re|''ve|''m|''ll|''d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^ \\t\\n\\x0B\\f\\r\\p{{L}}\\p{{N}}{_MARK}]+|{_BLANK}+')) AS w FROM led),
counted AS MATERIALIZED (SELECT w, count(*) AS n, array_to_string(list_transform(range(octet_length(encode(w))), lambda i: '{_MARK}' || s[1 + ('0x' || substr(hex(encode(w)), (1 + 2 * i)::INT, 2))::INT] || '{_MARK}'), '') AS parts FROM raw, spelt GROUP BY w, s)"""


def _merges_sql(counted: str, steps: int) -> str:
    """CTEs m0, m1, ...: the most frequent pair (a, b) of each step, and w0, w1, ...: words (w, n, parts) after it."""
    out = [f"w0 AS (SELECT w, n, parts FROM {counted})"]
    for k in range(steps):
        pairs = f"SELECT n, unnest(list_zip(l[:-2], l[2:])) AS p FROM (SELECT n, string_split(substr(parts, 2, length(parts) - 2), '{_MARK}{_MARK}') AS l FROM w{k})"
        out.append(f"m{k} AS MATERIALIZED (SELECT {k} AS step, p[1] AS a, p[2] AS b FROM ({pairs}) WHERE p[2] IS NOT NULL GROUP BY p HAVING sum(n) >= 2 ORDER BY sum(n) DESC, a, b LIMIT 1)")
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT w, n, replace(parts, '{_MARK}' || a || '{_MARK}{_MARK}' || b || '{_MARK}', '{_MARK}' || a || b || '{_MARK}') AS parts FROM w{k}, m{k})")
    return ",\n".join(out)


_ALL_MERGES = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(30))


@query(f"WITH {_BYTE_WORDS},\n{_merges_sql('counted', 30)}\nSELECT step::INT AS step, a, b, (263 + step)::INT AS id FROM ({_ALL_MERGES})")
def bpe_train(spark, sf_dir):
    """A byte-level vocabulary of thirty merges beyond the special tokens and the bytes, with their order."""
    merges = bpe.train_vocabulary(table(spark, sf_dir, "documents"), "text", len(bpe.SPECIALS) + 256 + 30)
    ids = bpe.vocabulary(merges)
    return spark.createDataFrame([(i, a, b, ids[a + b]) for i, (a, b) in enumerate(merges)], "step int, a string, b string, id int")


@query()
def bpe_vocabulary(spark, sf_dir):
    """Two thousand merges: too many steps for SQL; the first thirty are those of bpe_train."""
    merges = bpe.train_vocabulary(table(spark, sf_dir, "documents"), "text", len(bpe.SPECIALS) + 256 + 2000)
    ids = bpe.vocabulary(merges)
    return spark.createDataFrame([(i, a, b, ids[a + b]) for i, (a, b) in enumerate(merges)], "step int, a string, b string, id int")


@query(f"""WITH {_BYTE_WORDS},
{_merges_sql('counted', 30)},
p AS (SELECT doc_id, sum((length(parts) - length(replace(parts, '{_MARK}', ''))) // 2)::BIGINT AS n_pieces FROM raw JOIN w30 USING (w) GROUP BY doc_id)
SELECT doc_id, true AS back, octet_length(encode(t)) AS n_bytes, coalesce(n_pieces, 0) AS n_pieces FROM led LEFT JOIN p USING (doc_id)""")
def bpe_roundtrip(spark, sf_dir):
    """Byte-level pieces of whole texts: how many the merges leave; decoded they are the texts again, with as many symbols as bytes."""
    docs = table(spark, sf_dir, "documents")
    merges = bpe.train_vocabulary(docs, "text", len(bpe.SPECIALS) + 256 + 30)
    pieces = bpe.encode(docs, "doc_id", "text", merges, bpe.byte_words, keep=["text"]).withColumn("_all", F.array_join("pieces", ""))
    own = bpe.led(F.coalesce("text", F.lit("")))
    return pieces.select("doc_id", (bpe.unspelt(F.col("_all")) == own).alias("back"), F.length("_all").cast("long").alias("n_bytes"), F.size("pieces").cast("long").alias("n_pieces"))


@query(f"""WITH raw AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '')) AS w FROM documents),
counted AS MATERIALIZED (SELECT w, count(*) AS n, array_to_string(list_transform(string_split(w, ''), lambda c: '{_MARK}' || c || '{_MARK}'), '') AS parts FROM raw GROUP BY w),
{_merges_sql('counted', 20)},
p AS (SELECT doc_id, sum((length(parts) - length(replace(parts, '{_MARK}', ''))) // 2)::BIGINT AS n_pieces, sum((strpos(parts, '{_MARK}{_MARK}') = 0)::INT)::BIGINT AS n_whole FROM raw JOIN w20 USING (w) GROUP BY doc_id)
SELECT doc_id, coalesce(n_pieces, 0) AS n_pieces, coalesce(n_whole, 0) AS n_whole FROM documents LEFT JOIN p USING (doc_id)""")
def bpe_encode(spark, sf_dir):
    """Pieces of each text under twenty merges, and those of its words that are one piece."""
    docs = table(spark, sf_dir, "documents")
    merges = bpe.train(bpe.words(docs, "text"), 20)
    made = {a + b for a, b in merges}
    whole = F.filter(bpe.blank_words(F.coalesce("text", F.lit(""))), lambda w: (F.length(w) == 1) | w.isin(sorted(made)))
    counted = docs.select("doc_id", "text", F.size(whole).cast("long").alias("n_whole"))
    return bpe.encode(counted, "doc_id", "text", merges, keep=["n_whole"]).select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "n_whole")


@query("""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), lambda x: 5000 + strlen(x)) AS ids FROM documents)
SELECT doc_id, len(ids) + 1 AS n, 1001 AS first, list_sum(ids)::BIGINT + 1001 AS total, 2 * len(ids) + 3 AS pair_n, 1002 AS last, 2 * list_sum(ids)::BIGINT + 3005 AS pair_total FROM w""")
def special_tokens(spark, sf_dir):
    """One sequence with its mark, and the pair of a sequence with itself."""
    out = _ids(spark, sf_dir).select("doc_id", scalar.with_special(F.col("ids")).alias("one"), scalar.with_special(F.col("ids"), F.col("ids")).alias("pair"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", F.size("one").cast("long").alias("n"), F.get("one", F.lit(0)).alias("first"), total("one").alias("total"), F.size("pair").cast("long").alias("pair_n"), F.element_at("pair", F.lit(-1)).alias("last"), total("pair").alias("pair_total"))


def _ids(spark, sf_dir):
    toks = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda t: t != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(toks, lambda t: 5000 + F.octet_length(t)).alias("ids"))


@query("""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), lambda x: 5000 + strlen(x)) AS ids FROM documents),
b AS (SELECT *, (row_number() OVER (ORDER BY len(ids), doc_id) - 1) // 32 AS batch FROM w), m AS (SELECT batch, ceil(max(len(ids)) / 8) * 8 AS length FROM b GROUP BY 1)
SELECT doc_id, batch, CAST(length AS INT) AS length, CAST(length AS BIGINT) - len(ids) AS pads, (CAST(length AS BIGINT) - len(ids)) * 1000 + coalesce(list_sum(ids), 0)::BIGINT AS total, len(ids) AS mask_sum, (len(ids) * (len(ids) - 1)) // 2 AS position_sum FROM b JOIN m USING (batch)""")
def pad_batches(spark, sf_dir):
    out = programs.padded_batches(_ids(spark, sf_dir), "doc_id", "ids", 32)
    padded = out.select("doc_id", "batch", "length", scalar.pad_left(F.col("ids"), F.col("length")).alias("p"), scalar.attention_mask(F.col("ids"), F.col("length")).alias("m"), scalar.positions(F.col("ids"), F.col("length")).alias("q"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return padded.select("doc_id", "batch", "length", F.size(F.filter("p", lambda x: x == scalar.PAD)).cast("long").alias("pads"), total("p").alias("total"), total("m").alias("mask_sum"), total("q").alias("position_sum"))


@query("SELECT conv_id, turn, 2 + a + 1 AS zeros_and_ones, b + 1 AS ones FROM (SELECT conv_id, turn, strlen(role) AS a, strlen(role) + 0 AS b FROM conversations)".replace("2 + a + 1 AS zeros_and_ones", "a + b + 3 AS n"))
def pair_type_ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", vocab.byte_ids(F.col("role")).alias("a"))
    t = c.select("conv_id", "turn", scalar.type_ids(F.col("a"), F.col("a")).alias("t"))
    return t.select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x).alias("ones"))


def _unit(what: str, place: str) -> str:
    return f"(CAST('0x' || substr(md5('1-' || doc_id || '-0-{what}-' || {place}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(f"""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), lambda x: 5000 + strlen(x)) AS ids FROM documents),
c AS (SELECT doc_id, CASE WHEN len(ids) > 64 THEN ids[1 + CAST(floor({_unit('crop', '0')} * (len(ids) - 63)) AS BIGINT):64 + CAST(floor({_unit('crop', '0')} * (len(ids) - 63)) AS BIGINT)] ELSE list_concat(ids, list_transform(range(64 - len(ids)), lambda i: 1000)) END AS x FROM w),
u AS (SELECT doc_id, unnest(x) AS x, unnest(range(64)) AS i FROM c)
SELECT doc_id, count(*) FILTER (WHERE {_unit('mask', 'i')} < 0.15) AS n_masked, sum(CASE WHEN {_unit('mask', 'i')} < 0.15 THEN x ELSE -100 END)::BIGINT AS labels,
 sum(CASE WHEN {_unit('mask', 'i')} < 0.15 AND {_unit('how', 'i')} < 0.8 THEN 1003 WHEN {_unit('mask', 'i')} < 0.15 AND {_unit('how', 'i')} < 0.9 THEN floor({_unit('word', 'i')} * 40000) ELSE x END)::BIGINT AS inputs FROM u GROUP BY 1""")
def mlm_examples(spark, sf_dir):
    out = programs.masked_examples(_ids(spark, sf_dir), "doc_id", "ids", 64, 1, 0, 0.15, 40000, scalar.MASK, scalar.PAD)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("n_masked"), total("labels").alias("labels"), total("input_ids").alias("inputs"))


_PLAIN = "regexp_replace({}, '[^\\x00-\\x7F]', '?', 'g')"
_START = "string_split({0}, ' ')[1]"


@query(f"WITH {_LINES} SELECT item_id, doc_id, CAST(line_no AS INT) AS line_no, levenshtein({_PLAIN.format('b.text')}, {_PLAIN.format('line')}) AS distance FROM benchmark b JOIN ln ON {_START.format('b.text')} = {_START.format('line')}")
def edit_distance(spark, sf_dir):
    """Items against the whole lines of documents that begin with the same word; other than ASCII characters count as one."""
    plain = lambda c: F.regexp_replace(c, "[^\\x00-\\x7F]", "?")
    start = lambda c: F.try_element_at(F.split(c, " "), F.lit(1))
    b = table(spark, sf_dir, "benchmark").select("item_id", plain("text").alias("item"), start("text").alias("w"))
    lines = vocab.lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line_no", "line", start("line").alias("w"))
    near = merge.salted_join(lines, scalar.in_blocks(b, "w", "item_id", "item"), "w", "line").select("doc_id", "line_no", plain("line").alias("line"), "x")
    near = near.repartition("line").sortWithinPartitions("line")  # equal lines stand together and are compared once
    items = near.select("doc_id", "line_no", F.inline(F.arrays_zip(F.col("x.item_id").alias("item_id"), scalar.block_distances(F.col("line"), F.col("x.item")).alias("distance"))))
    return items.select("item_id", "doc_id", "line_no", "distance")


@query("SELECT page_id, CASE WHEN ends_with(split_part(split_part(url, '?', 1), '#', 1), '.html') THEN NULL WHEN strlen(u) = 0 THEN NULL ELSE 'bad suffix' END AS problem, 'page' AS kind FROM (SELECT page_id, url, url AS u FROM pages)")
def media_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)).alias("src"))
    return filters.check_suffix(pages, "src", F.lit("page"), {"page": (".html",)}).select("page_id", "problem", "kind")


@query("""WITH k AS (SELECT o_orderkey, upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 3)) || substr(md5(CAST(o_orderkey AS VARCHAR)), 4, 3) AS id FROM orders)
SELECT o_orderkey, id || '-' || translate(regexp_replace(regexp_replace(regexp_replace(id, '[0-9]', '#', 'g'), '[a-z]', '%', 'g'), '[A-Z]', 'U', 'g'), '#%', 'NL') AS mangled, id AS back, substr(id, 1, 1) || '/' || substr(id, 2, 1) || '/' || id AS path, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(6), lambda i: CAST(ascii(substr(id, 1 + i, 1)) AS BIGINT))), lambda a, c: a * 128 + c) AS label FROM k""")
def id_codec(spark, sf_dir):
    h = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    ids = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.upper(F.substring(h, 1, 3)), F.substring(h, 4, 3)).alias("id"))
    m = scalar.mangle(F.col("id"))
    return ids.select("o_orderkey", m.alias("mangled"), scalar.unmangle(F.concat(F.lower(F.substring(m, 1, 6)), F.substring(m, 7, 7))).alias("back"), scalar.id_path(F.col("id")).alias("path"), scalar.id_label(F.col("id")).alias("label"))


@query("SELECT p_partkey, replace(p_name, ' ', '-') AS slug, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN p_type ELSE 'NONE' END AS flag, lower(p_type) AS name FROM part")
def title_slug(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = scalar.flag_to_name(F.col("p_type"))
    return p.select("p_partkey", scalar.slug(F.col("p_name")).alias("slug"), scalar.name_to_flag(name, ["ECONOMY", "SMALL"]).alias("flag"), name.alias("name"))


_NAMED = "SELECT (p_partkey % 97) || 'k' || p_partkey{suffix} AS id, p_name AS name, p_size AS passes FROM part"


def _named(spark, sf_dir, suffix):
    """Parts as documents in files named by their ids, read again."""
    from tessera.sources import named, store

    path = scratch(spark, "named-documents")
    info = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("username"))
    passes = F.transform(F.sequence(F.lit(1), "p_size"), lambda i: F.struct(i.cast("string").alias("code")))
    docs = table(spark, sf_dir, "part").select(F.concat((F.col("p_partkey") % 97).cast("string"), F.lit("k"), F.col("p_partkey").cast("string")).alias("id"), F.struct(F.struct(info.alias("info"), passes.alias("renderpass")).alias("Shader")).alias("document"))
    named.write_named(docs, path, suffix)
    return store.read_documents(spark, path, legacy=suffix is not None).select("id", F.col("document.Shader.info.name").alias("name"), F.size("document.Shader.renderpass").alias("passes"))


@query(_NAMED.format(suffix=""))
def documents_nested(spark, sf_dir):
    """A tree of documents: `<first character>/<second>/<id>.json`."""
    return _named(spark, sf_dir, None)


@query(_NAMED.format(suffix=""))
def documents_flat(spark, sf_dir):
    """A flat folder of documents: `<id>-<suffix>.json`."""
    return _named(spark, sf_dir, "v1")


@query("SELECT doc_id::VARCHAR AS id, NOT (doc_id % 3 = 0) AS valid, doc_id % 2 = 0 AS imageonly, 'code ' || lang AS code FROM documents")
def json_documents(spark, sf_dir):
    """Documents written as nested JSON by id, read again with the declared schema, and their attributes."""
    docs = table(spark, sf_dir, "documents")
    image = F.struct(F.lit("image").alias("type"), F.concat(F.lit("code "), "lang").alias("code"))
    other = F.struct(F.when(F.col("doc_id") % 2 == 0, "common").otherwise("buffer").alias("type"), F.lit("").alias("code"))
    shaped = docs.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 3 == 0, "not found").alias("Error"), F.struct(F.array(image, other).alias("renderpass")).alias("Shader"))
    path = scratch(spark, "documents")
    store.write_documents(shaped, path)
    back = spark.read.schema("id string, c0 string, c1 string, " + store.DOCUMENT).json(path)
    passes = F.col("Shader.renderpass")
    return back.select("id", F.col("Error").isNull().alias("valid"), filters.only_passes(passes, ["image", "common"]).alias("imageonly"), filters.first_pass(passes, "image")["code"].alias("code"))


def _passes(spark, sf_dir):
    """A document per page: an image pass and a buffer with an input each, whose type follows the page's number."""
    p = table(spark, sf_dir, "pages")
    n = F.col("page_id") % 4
    kind = F.when(n == 0, "texture").when(n == 1, "music").when(n == 2, "cubemap").otherwise("hologram")
    source = F.concat(F.lit("/media/"), (F.col("page_id") % 10).cast("string"), F.when(F.col("page_id") % 3 == 0, ".mp3").otherwise(".jpg"))
    one = lambda t, channel: F.struct(F.lit(t).alias("type"), F.array(F.struct(F.lit(channel).alias("channel"), source.alias("src"), kind.alias("ctype"))).alias("inputs"))
    return p.select("page_id", F.array(one("image", 0), one("buffer", 1), one("image", 2)).alias("passes"))


@query("""WITH c AS (SELECT '/media/' || (page_id % 10) || CASE WHEN page_id % 3 = 0 THEN '.mp3' ELSE '.jpg' END AS src, CASE page_id % 4 WHEN 0 THEN 'texture' WHEN 1 THEN 'music' WHEN 2 THEN 'cubemap' ELSE 'hologram' END AS ctype FROM pages)
SELECT src, ctype, CASE WHEN ctype = 'hologram' THEN 'unknown type' WHEN ctype = 'music' AND src NOT LIKE '%.mp3' OR ctype <> 'music' AND src NOT LIKE '%.jpg' THEN 'bad suffix' END AS problem, 3 * count(*) AS n FROM c GROUP BY 1, 2""")
def media_list(spark, sf_dir):
    """The channels of all passes, each source once, with what is wrong with it."""
    return filters.media_list(filters.channels(_passes(spark, sf_dir), "page_id", F.col("passes")))


@query("SELECT page_id, (page_id % 3 = 1)::INT + (page_id % 5 < 2)::INT + 1 AS n, concat_ws(',', CASE WHEN page_id % 3 = 1 THEN '0' END, CASE WHEN page_id % 5 < 2 THEN '1' END, '2') AS channels FROM pages")
def passes_of_type(spark, sf_dir):
    """Of three passes the first two are images on some pages only."""
    first, second = F.col("page_id") % 3 == 1, F.col("page_id") % 5 < 2
    kinds = F.array(F.when(first, "image").otherwise("sound"), F.when(second, "image").otherwise("buffer"), F.lit("image"))
    passes = F.transform("passes", lambda p, i: F.struct(F.get(kinds, i).alias("type"), F.array(F.struct(i.alias("channel"))).alias("inputs")))
    got = _passes(spark, sf_dir).select("page_id", filters.passes_of(passes, "image").alias("p"))
    channel = F.array_join(F.transform("p", lambda p: p["inputs"][0]["channel"].cast("string")), ",")
    return got.select("page_id", F.size("p").alias("n"), channel.alias("channels"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 500 AND source IS NOT NULL")
def attributes_all(spark, sf_dir):
    named = {"english": F.col("lang") == "en", "long": F.col("n_chars") > 500, "sourced": F.col("source").isNotNull(), "old": F.lit(None).cast("boolean")}
    return filters.all_true(table(spark, sf_dir, "documents"), named, ["english", "long", "sourced"]).select("doc_id")


@query("""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), lambda x: 5000 + strlen(x)) AS ids, n_chars FROM documents),
b AS (SELECT *, (row_number() OVER (ORDER BY len(ids), doc_id) - 1) // 16 AS batch FROM w), m AS (SELECT batch, ceil(max(len(ids)) / 8) * 8 AS length FROM b GROUP BY 1)
SELECT doc_id, batch, CAST(length AS BIGINT) AS n, len(ids) AS mask, n_chars::DOUBLE AS labels, CAST(length AS BIGINT) AS vectors, round(length * -0.5 * 6 + coalesce(list_sum(list_transform(ids, lambda x: bit_count(CAST(x % 64 AS INT)))), 0), 3) AS trace FROM b JOIN m USING (batch)""")
def batch_assembly(spark, sf_dir):
    """Ids padded with their counters as centred bits; a column of any name is given as labels."""
    docs = _ids(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("seconds")), "doc_id")
    docs = docs.withColumn("counters", F.transform("ids", lambda x: x.cast("long") % 64))
    out = programs.assemble_batches(docs, "doc_id", "ids", 16, "seconds", "counters", "onehot-base2", 6)
    total = F.aggregate(F.flatten("trace_embeddings"), F.lit(0.0), lambda s, x: s + x)
    ones = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", "batch", F.size("input_ids").cast("long").alias("n"), ones.alias("mask"), "labels", F.size("trace_embeddings").cast("long").alias("vectors"), F.round(total, 3).alias("trace"))


@query("""WITH r AS (SELECT conv_id, turn, strlen(role) AS a, CASE WHEN conv_id % 2 = 0 THEN strlen(role) + 3 END AS b, turn * 1.5::DOUBLE AS y FROM conversations), k AS (SELECT *, (row_number() OVER (ORDER BY a, conv_id * 1000 + turn) - 1) // 8 AS batch FROM r),
m AS (SELECT batch, ceil(max(a) / 8) * 8 AS la, ceil(greatest(coalesce(max(b), -1), 0) / 8) * 8 AS lb, arg_min(b IS NULL, a * 1000000000 + conv_id * 1000 + turn) AS alone FROM k GROUP BY 1)
SELECT conv_id, turn, CAST(la AS BIGINT) AS q, CASE WHEN NOT alone THEN CAST(lb AS BIGINT) END AS k, CASE WHEN alone THEN y END AS labels FROM k JOIN m USING (batch)""")
def pair_batches(spark, sf_dir):
    """Pairs of token arrays in batches; some have no right part."""
    c = table(spark, sf_dir, "conversations").withColumn("left", vocab.byte_ids(F.col("role")))
    three = F.array(F.lit(1), F.lit(2), F.lit(3))
    c = c.select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "left", F.when(F.col("conv_id") % 2 == 0, F.concat("left", three)).alias("right"), (F.col("turn") * 1.5).alias("score"))
    out = programs.pair_batches(c, "id", "left", "right", 8, "score")
    return out.select(F.floor(F.col("id") / 1000).alias("conv_id"), (F.col("id") % 1000).alias("turn"), F.size("feature_q").cast("long").alias("q"), F.when(F.col("feature_k").isNotNull(), F.size("feature_k").cast("long")).alias("k"), "labels")
