"""Secret scans: fixed patterns, and a battery of randomness tests on other long tokens.

All of it is DataFrame expressions. A candidate token's encoding is inferred from its characters.
Three tests ask whether it departs from uniform random characters of that encoding: chi-squared on
the alphabet, runs about the alphabet's middle, and serial correlation. Benjamini-Hochberg within
each length class decides which candidates do; the others are reported as random.

What that level bounds is the share of random tokens among those set aside as structured, so it
bounds the secrets that are missed. It does not bound the share of structured tokens among those that
are reported: short ones, on which the tests have little power, are reported rather than missed. That
share is measured by length class in a test. Work grows with the length of a text, not with its
square: sums over many spans are taken in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, row_without, stored, table

#: Fixed values of the contract: kinds in order, their patterns, the group measured and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A candidate of the tests: a run of base64 characters of at least so many, with letters and digits.
CANDIDATE = "[A-Za-z0-9+/_=-]{24,}"
#: The alphabets of the encodings, in the order of their values.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: First lengths of the length classes, the share of false rejections borne, and steps of -log10 p.
CLASSES, FALSE_SHARE, STEP, MOST = (24, 32, 48, 64, 128), 0.1, 100, 1600


def _spans(text: Column, pattern: str, rank: int, measured: int, least: int, maybe: Column) -> Column:
    """Array of (start, rank, end, text) of a pattern's matches whose group has `least` characters.

    The parts between matches give the starts: a match begins after all parts and matches before it.
    """
    kind = "array<struct<start:int,rank:int,end:int,text:string>>"

    def placed(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["parts"], F.lit(1), F.size(x["hits"])), x["hits"], lambda p, h: F.length(p) + F.length(h))
        rows = F.arrays_zip(x["hits"].alias("hit"), x["groups"].alias("group"), running(lengths, lambda a, b: a + b).alias("end"))
        span = lambda r: F.struct((r["end"] - F.length(r["hit"])).alias("start"), F.lit(rank).alias("rank"), r["end"].alias("end"), r["hit"].alias("text"))
        return F.transform(F.filter(rows, lambda r: F.length(r["group"]) >= least), span)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = found if measured == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(measured))
    once = F.struct(F.split(text, pattern, -1).alias("parts"), found.alias("hits"), groups.alias("groups"))
    return F.when(maybe, _let(once, placed)).otherwise(F.array().cast(kind))


#: Elements of a block in running(), and pieces of a text that are cut from one part of it.
BLOCK = 128


def _in_blocks(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))


def running(a: Column, add) -> Column:
    """Running totals of an array of non-negative integers by `add`, a sum or a maximum, first in blocks and then over them."""
    begin = F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return _let(add(acc["t"], x), lambda t: F.struct(t.alias("t"), F.concat(acc["out"], F.array(t)).alias("out")))

    def over(acc: Column, block: Column) -> Column:
        return F.struct(add(acc["t"], block["t"]).alias("t"), F.concat(acc["out"], F.array(acc["t"])).alias("out"))

    def joined(blocks: Column) -> Column:
        before = F.aggregate(blocks, begin, over, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, before, lambda b, t: F.transform(b["out"], lambda v: add(t, v))))

    return F.when(F.size(a) > 0, _let(F.transform(_in_blocks(a), lambda b: F.aggregate(b, begin, step)), joined)).otherwise(F.array().cast("array<int>"))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by a logistic form that is right to about 0.0001."""
    z = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def randomness(token: Column) -> Column:
    """struct(encoding, n, p_chi2, p_runs, p_serial, p) of a token; null where it has no letter or digit.

    p is three times the least of the tests' p-values, 1 at most: small for what is not random.
    """
    return _let(F.regexp_replace(token, "=+$", ""), lambda body: F.when(body.rlike("[0-9]") & body.rlike("[A-Za-z]"), _let(_encoded(body), _tested)))


def _encoded(body: Column) -> Column:
    """struct(encoding, alphabet, plain) of a token; plain has the alphabet's characters only."""
    hexed, upper = body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), body.rlike("^[A-Z2-7]+$")
    pick = lambda a, b, c: F.when(hexed, a).when(upper, b).otherwise(c)
    names = [F.lit(k) for k in ALPHABETS]
    return F.struct(pick(*names).alias("encoding"), pick(*[F.lit(v) for v in ALPHABETS.values()]).alias("alphabet"), pick(F.lower(body), body, F.translate(body, "-_=", "+/")).alias("plain"))


def _tested(e: Column) -> Column:
    chars = F.filter(F.split(e["plain"], ""), lambda c: c != "")
    k, n = F.length(e["alphabet"]).cast("double"), F.length(e["plain"]).cast("double")
    values = F.transform(chars, lambda c: F.position(c, e["alphabet"]).cast("double") - 1.0)
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(e["plain"], c, F.lit(""))).cast("double"), F.lit(2.0)))
    return _let(F.struct(e["encoding"].alias("encoding"), k.alias("k"), n.alias("n"), squares.alias("squares"), values.alias("values")), lambda x: _let(_three_tests(x), _combined))


def _three_tests(x: Column) -> Column:
    k, n, values = x["k"], x["n"], x["values"]
    free = k - 1.0
    chi, spread = k / n * x["squares"] - n, F.lit(2.0) / (F.lit(9.0) * free)
    p_chi = _upper_tail((F.pow(chi / free, F.lit(1.0 / 3.0)) - (F.lit(1.0) - spread)) / F.sqrt(spread))
    begin = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("ones"))
    high = F.transform(values, lambda v: (v >= k / 2.0).cast("int"))
    seen = F.aggregate(high, begin, lambda a, h: F.struct(h.alias("last"), (a["runs"] + (a["last"] != h).cast("double")).alias("runs"), (a["ones"] + h.cast("double")).alias("ones")))
    both = lambda s: F.lit(2.0) * s["ones"] * (n - s["ones"]) / n
    z_runs = _let(seen, lambda s: F.coalesce(F.try_divide(F.abs(s["runs"] - both(s) - 1.0), F.sqrt(F.greatest(both(s) * (both(s) - 1.0) / (n - 1.0), F.lit(0.0)))), F.lit(12.0)))
    middle = (k - 1.0) / 2.0
    begin = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("cross"), F.lit(0.0).alias("square"))
    lag = F.aggregate(values, begin, lambda a, v: F.struct((v - middle).alias("last"), (a["cross"] + F.coalesce(a["last"] * (v - middle), F.lit(0.0))).alias("cross"), (a["square"] + (v - middle) * (v - middle)).alias("square")))
    z_lag = _let(lag, lambda a: F.abs(F.coalesce(F.try_divide(a["cross"], a["square"]), F.lit(1.0))) * F.sqrt(n))
    two = lambda z: F.least(F.lit(1.0), F.lit(2.0) * _let(z, _upper_tail))
    return F.struct(x["encoding"].alias("encoding"), n.cast("int").alias("n"), p_chi.alias("p_chi2"), two(z_runs).alias("p_runs"), two(z_lag).alias("p_serial"))


def _combined(t: Column) -> Column:
    least = F.least(F.lit(1.0), F.lit(3.0) * F.least(t["p_chi2"], t["p_runs"], t["p_serial"]))
    return F.struct(t["encoding"].alias("encoding"), t["n"].alias("n"), *[F.round(t[c], 6).alias(c) for c in ("p_chi2", "p_runs", "p_serial")], least.alias("p"))


def _class(n: Column) -> Column:
    out = F.lit(CLASSES[0])
    for c in CLASSES[1:]:
        out = F.when(n >= c, c).otherwise(out)
    return out


def _level(p: Column) -> Column:
    """Steps of -log10 p, 0 to MOST."""
    return F.least(F.floor(F.round(-F.log10(F.greatest(p, F.lit(1e-300))) * STEP, 6)), F.lit(MOST)).cast("int")


def find_spans(rows: DataFrame, *carry: str) -> DataFrame:
    """The columns `carry` of rows, with _base and _cands: arrays of spans of its column _t, _cands with their test results.

    Null texts count as empty.
    """
    t = F.coalesce(F.col("_t"), F.lit(""))
    out = rows
    sign = (F.instr(t, ":") > 0) | (F.instr(t, "=") > 0)
    out = out.withColumn("_a", _spans(t, ASSIGN, 0, 2, LEAST["assign"], sign))
    out = out.withColumn("_k", _spans(t, ACCESS, 1, 0, LEAST["access"], F.instr(t, "AKIA") > 0))
    out = out.withColumn("_h", _spans(t, "[0-9a-f]{%d,}" % LEAST["hex"], 2, 0, LEAST["hex"], t.rlike("[0-9a-f]{%d,}" % LEAST["hex"])))
    out = out.withColumn("_c", _spans(t, CANDIDATE, 3, 0, 0, t.rlike(CANDIDATE)))
    out = out.withColumn("_base", F.array_sort(F.transform(F.concat("_a", "_k", "_h"), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))))
    # In the order of their starts, bases first, a candidate is free if no base before it ends past its start and the
    # next one is no base that begins before its end: candidates do not overlap each other.
    mark = lambda a, cand: F.transform(a, lambda x: F.struct(x["start"].alias("start"), F.lit(cand).alias("cand"), x["end"].alias("end"), (x["text"] if cand else F.lit(None).cast("string")).alias("text")))
    out = out.withColumn("_o", F.when(F.size("_c") > 0, F.array_sort(F.concat(mark(F.col("_base"), 0), mark(F.col("_c"), 1)))).otherwise(F.array().cast("array<struct<start:int,cand:int,end:int,text:string>>")))
    out = out.withColumn("_m", running(F.transform("_o", lambda x: F.when(x["cand"] == 0, x["end"]).otherwise(0)), F.greatest))

    def free(x: Column, i: Column) -> Column:
        after = F.get(F.col("_o"), i + 1)
        clear = (F.coalesce(F.get(F.col("_m"), i - 1), F.lit(0)) <= x["start"]) & ~F.coalesce((after["cand"] == 0) & (after["start"] < x["end"]), F.lit(False))
        return F.when((x["cand"] == 1) & clear, x)

    fresh = F.filter(F.transform("_o", free), lambda x: x.isNotNull())
    tested = F.transform(fresh, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), randomness(c["text"]).alias("test")))
    return out.withColumn("_cands", F.filter(tested, lambda c: c["test"].isNotNull())).select(*carry, "_base", "_cands")


def rejection_levels(found: DataFrame) -> dict[int, int]:
    """For each length class, the level from which a candidate counts as not random.

    Benjamini-Hochberg at FALSE_SHARE on p-values taken in steps: the counts of a class, at most
    MOST + 1 of them, are summed from the smallest p, and the largest p that is within its count's
    share is the limit. A class without any such p rejects none.
    """
    c = found.select(F.explode("_cands.test").alias("t")).select(_class(F.col("t.n")).alias("class"), _level(F.col("t.p")).alias("level"))
    counts = c.groupBy("class", "level").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("class")
    ranked = counts.withColumn("k", F.sum("n").over(w.orderBy(F.desc("level")))).withColumn("m", F.sum("n").over(w))
    within = F.pow(F.lit(10.0), -F.col("level") / float(STEP)) <= FALSE_SHARE * F.col("k") / F.col("m")
    rows = ranked.where(within).groupBy("class").agg(F.min("level").alias("level")).collect()
    return {r["class"]: r["level"] for r in rows}


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with `secrets`: array of (start, rank, end), code points, end exclusive.

    rank numbers KINDS. Base spans all stay; the tests add candidates that no base span overlaps. Null
    and empty texts have none; repeated rows are scanned alike; very long texts are taken whole. An
    empty table gives no rows. A column of df named secrets or base_secrets is replaced.
    """
    rows = df.select(row_without(df, text, "secrets", "base_secrets").alias("row"), F.col(text).cast("string").alias("_t"))
    found = stored(find_spans(rows, "row"), "secret-spans")
    return _decide(found, rejection_levels(found)).select(*columns_of(df, text, "secrets", "base_secrets"), F.col("_base").alias("base_secrets"), "secrets")


def _decide(found: DataFrame, levels: dict[int, int]) -> DataFrame:
    """found with `secrets`: the base spans, and the candidates that the levels leave."""
    limit = F.lit(MOST + 1)

    def random(c: Column) -> Column:
        most = limit
        for k, v in sorted(levels.items()):
            most = F.when(_class(c["test"]["n"]) == k, v).otherwise(most)
        return _level(c["test"]["p"]) < most

    more = F.transform(F.filter("_cands", random), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end")))
    return found.withColumn("secrets", F.array_sort(F.concat("_base", more)))


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with each secret in its text replaced by `mark`; spans that overlap share one.

    Null texts stay null and texts without secrets stay as they are; all other columns, whatever their
    names, are given back as they were. Repeated rows are changed alike and an empty table gives no
    rows. The texts are scanned twice, for the tests' levels and for the spans, so that no text is
    shuffled.
    """
    rows = df.select(row_without(df).alias("_row"), F.col(text).alias("_text"), F.col(text).cast("string").alias("_t"))
    levels = rejection_levels(stored(find_spans(rows), "secret-spans"))
    found = _decide(find_spans(rows, "_row", "_text"), levels)
    # Kept pieces lie between the ends so far and the next start that is past them; the last one goes to the text's end.
    found = found.withColumn("_m", running(F.transform("secrets", lambda s: s["end"]), F.greatest))
    piece = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    before = lambda i: F.coalesce(F.get(F.col("_m"), i - 1), F.lit(0))
    between = F.filter(F.transform("secrets", lambda s, i: F.when(s["start"] >= before(i), piece(before(i), s["start"]))), lambda p: p.isNotNull())
    found = found.withColumn("_p", F.concat(between, F.array(piece(before(F.size("_m")), F.length("_text")))))

    def cut(block: Column) -> Column:
        first = F.get(block, F.lit(0))["a"]
        part = F.substring(F.col("_text"), first + 1, F.element_at(block, F.lit(-1))["b"] - first)
        return _let(part, lambda x: F.transform(block, lambda p: F.substring(x, p["a"] - first + 1, p["b"] - p["a"])))

    clean = F.array_join(F.flatten(F.transform(_in_blocks(F.col("_p")), cut)), mark)
    new = F.when(F.size("secrets") > 0, clean).otherwise(F.col("_text"))
    return found.select(*[(new if c == text else F.col("_row")[c]).alias(c) for c in df.columns])


def _joined(spans: Column) -> Column:
    name = lambda r: F.element_at(F.array(*[F.lit(k) for k in KINDS]), r + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat(name(s["rank"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def op5_secrets(spark, sf_dir):
    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda rank: F.size(F.filter("base_secrets", lambda s: s["rank"] == rank)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base_secrets")), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def _sql() -> str:
    """The query in SQL. Letters in either case are spelled out, as case folding differs between engines."""
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    assign = f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    kinds = [(assign, 2, LEAST["assign"]), (ACCESS, 0, LEAST["access"]), (HEX, 0, LEAST["hex"]), (CANDIDATE, 0, 0)]

    def found(rank: int, pattern: str, group: int, least: int) -> str:
        return f"""SELECT doc_id, {rank} AS rank, begun AS start, begun + length(hits[i + 1]) AS stop, hits[i + 1] AS s FROM (
  SELECT doc_id, i, hits, groups, list_sum(list_transform(parts[1:i + 1], lambda p: length(p)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i], lambda h: length(h))), 0)::BIGINT AS begun FROM (
    SELECT doc_id, parts, hits, groups, unnest(range(len(hits))) AS i FROM (
      SELECT doc_id, string_split_regex(t, '{pattern}') AS parts, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS groups FROM d))) WHERE length(groups[i + 1]) >= {least}"""

    spans = " UNION ALL ".join(found(r, *k) for r, k in enumerate(kinds))
    tail = lambda z: f"(1.0::DOUBLE / (1 + exp(1.5976 * least(greatest({z}, -12), 12) + 0.07056 * least(greatest({z}, -12), 12) ** 3)))"
    classes = "CASE " + " ".join(f"WHEN n >= {c} THEN {c}" for c in reversed(CLASSES[1:])) + f" ELSE {CLASSES[0]} END"
    name = "CASE rank " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({spans}),
c AS (SELECT doc_id, start, stop, regexp_replace(s, '=+$', '') AS body FROM f a WHERE rank = 3 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id = a.doc_id AND b.rank < 3 AND b.start < a.stop AND a.start < b.stop)),
e AS (SELECT *, CASE WHEN regexp_full_match(body, '[0-9a-f]+|[0-9A-F]+') THEN lower(body) WHEN regexp_full_match(body, '[A-Z2-7]+') THEN body ELSE translate(replace(body, '=', ''), '-_', '+/') END AS plain,
  CASE WHEN regexp_full_match(body, '[0-9a-f]+|[0-9A-F]+') THEN '{ALPHABETS["hex"]}' WHEN regexp_full_match(body, '[A-Z2-7]+') THEN '{ALPHABETS["base32"]}' ELSE '{ALPHABETS["base64"]}' END AS alphabet
  FROM c WHERE regexp_matches(body, '[0-9]') AND regexp_matches(body, '[A-Za-z]')),
v AS (SELECT doc_id, start, stop, length(alphabet)::DOUBLE AS k, length(plain)::DOUBLE AS n, list_transform(string_split(plain, ''), lambda x: strpos(alphabet, x) - 1.0::DOUBLE) AS v,
  list_sum(list_transform(list_distinct(string_split(plain, '')), lambda x: (length(plain) - length(replace(plain, x, '')))::DOUBLE ** 2)) AS squares FROM e),
q AS (SELECT *, k / n * squares - n AS chi, 2 / (9 * (k - 1)) AS spread, list_sum(list_transform(v, lambda x: CASE WHEN x >= k / 2 THEN 1.0::DOUBLE ELSE 0 END)) AS ones,
  1 + coalesce(list_sum(list_transform(range(1, len(v)), lambda i: CASE WHEN (v[i] >= k / 2) <> (v[i + 1] >= k / 2) THEN 1.0::DOUBLE ELSE 0 END)), 0) AS runs,
  coalesce(list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - (k - 1) / 2) * (v[i + 1] - (k - 1) / 2))), 0) / list_sum(list_transform(v, lambda x: (x - (k - 1) / 2) ** 2)) AS r FROM v),
z AS (SELECT *, ((chi / (k - 1)) ** (1.0::DOUBLE / 3) - (1 - spread)) / sqrt(spread) AS z1, 2 * ones * (n - ones) / n AS mean FROM q),
y AS (SELECT *, CASE WHEN mean * (mean - 1) / (n - 1) > 0 THEN abs(runs - mean - 1) / sqrt(mean * (mean - 1) / (n - 1)) ELSE 12 END AS z2, abs(r) * sqrt(n) AS z3 FROM z),
p AS (SELECT doc_id, start, stop, {classes} AS class, least(1.0, 3 * least({tail('z1')}, least(1.0, 2 * {tail('z2')}), least(1.0, 2 * {tail('z3')}))) AS p FROM y),
l AS (SELECT *, CAST(least(floor(round(-log10(greatest(p, 1e-300)) * {STEP}, 6)), {MOST}) AS INT) AS level FROM p),
g AS (SELECT class, level, sum(count(*)) OVER (PARTITION BY class ORDER BY level DESC) AS k, sum(count(*)) OVER (PARTITION BY class) AS m FROM l GROUP BY class, level),
b AS (SELECT class, min(level) AS most FROM g WHERE 10.0::DOUBLE ** (-level / {STEP}.0) <= {FALSE_SHARE} * k / m GROUP BY class),
o AS (SELECT doc_id, rank, start, stop FROM f WHERE rank < 3 UNION ALL SELECT doc_id, 3, start, stop FROM l LEFT JOIN b USING (class) WHERE most IS NULL OR level < most)
SELECT d.doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  sha256(coalesce(string_agg({name}, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256, coalesce(string_agg({name}, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id"""


SQL = _sql()
