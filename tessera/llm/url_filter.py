"""URL filtering: exact host and path rules, then pattern rules found by their rarest literal token.

A pattern rule is text with `*` (any run), `^` (one separator or the end), `|` (start or end) and
`||` (start of the host or of one of its labels); a leading `@@` makes it an exception. Each rule is
filed under one literal token, the one that fewest URLs have. A URL's tokens fetch candidate rules
by an equi-join, and only those run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, lower_ascii, row_without, table

#: Fixed values of the contract: host, path and verdict of the exact rules.
HOST_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Default pattern rules: gambling and adult hosts, log-ins, carts, trackers; exceptions start with @@.
PATTERN_RULES = ["-bets.", "-casino.", "||casino-", "||bets-", "||xxx-", "-porn.", "||adult-", "^login^", "^cart^", "^checkout^", "^wp-admin^", "^sessionid=", "^page=*^ref=", "^utm_source=feed|", "||ads.", "||track.", "@@||docs.", "@@^sitemap.xml|"]

#: More rules than this are joined by a shuffle, not a broadcast.
BROADCAST_RULES = 20_000

SEPARATOR = "(?:[^a-z0-9_.%-]|$)"


def pattern_regex(rule: str) -> str:
    """The regular expression (for find) of one pattern rule."""
    body = rule.removeprefix("@@").lower()
    out = ""
    if body.startswith("||"):
        out, body = r"^[a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        out, body = "^", body[1:]
    end = body.endswith("|")
    for c in body[: len(body) - end]:
        out += ".*" if c == "*" else SEPARATOR if c == "^" else re.escape(c) if not c.isalnum() else c
    return "(?s)" + out + ("$" if end else "")


def pattern_tokens(rule: str) -> list[str]:
    """Literal tokens that every matching URL has as whole tokens."""
    body = rule.removeprefix("@@").lower()
    edged = re.sub(r"^\|\|?", "\x00", body)
    edged = re.sub(r"\|$", "\x00", edged)
    found = []
    for m in re.finditer(r"[a-z0-9]+", edged):
        before, after = edged[m.start() - 1] if m.start() else "*", edged[m.end()] if m.end() < len(edged) else "*"
        if before != "*" and after != "*":
            found.append(m[0])
    return sorted(set(found))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without a `://` or for null."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting (host, path) rule as struct(rule, verdict), null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lower_ascii(url), "[^a-z0-9]+"), lambda t: t != ""))


def index_rules(urls: DataFrame, rules: Sequence[str], url: str = "url") -> DataFrame:
    """Rows (token, rule, regex, exception), one per pattern rule; token null where the rule has none.

    The token is the rule's literal token with the fewest URLs; ties go to the first by alphabet.
    """
    spark = urls.sparkSession
    given = spark.createDataFrame([(r, pattern_regex(r), r.startswith("@@"), pattern_tokens(r)) for r in rules], "rule string, regex string, exception boolean, tokens array<string>")
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda x: x)
    literal = given.select("rule", F.explode_outer("tokens").alias("token"))
    wanted = literal.select("token").where("token is not null").distinct()
    seen = urls.select(F.explode(url_tokens(F.col(url))).alias("token")).join(small(wanted), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = literal.join(seen, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("x"))
    return given.drop("tokens").join(rarest.select("rule", F.col("x.token").alias("token")), "rule")


def filter_urls(df: DataFrame, url: str = "url", host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """df with host, path, rule, verdict, pattern_rule, n_candidates.

    The verdict is the longest fitting exact rule's; else block if a pattern rule fits and no
    exception does; else allow. Null URLs, those without `://` and empty tables go the same way.
    Columns of df with those names are replaced; a pattern rule that is given twice counts once; of several
    that fit, the least text is reported.
    Verdicts are found once per distinct URL, so a URL that many rows share is matched once; its rows
    then meet a narrow row in the join. Rules without a token are candidates of every URL; they are
    tried on its row, without a row for each.
    """
    pattern_rules = list(dict.fromkeys(pattern_rules))
    names = ("host", "path", "rule", "verdict", "pattern_rule", "n_candidates")
    host, path = url_parts(F.col("url"))
    rows = df.select(row_without(df, *names).alias("row"), F.col(url).cast("string").alias("url")).select("row", "url", host.alias("host"), path.alias("path"))
    urls = rows.select(F.col("url").alias("_url")).where("url is not null").distinct()
    index = index_rules(urls, pattern_rules, "_url")
    small = F.broadcast if len(pattern_rules) <= BROADCAST_RULES else (lambda x: x)
    tokens = urls.select("_url", F.explode(url_tokens(F.col("_url"))).alias("token"))
    found = tokens.join(small(index.where("token is not null")), "token").select("_url", "rule", "regex", "exception")
    low = lower_ascii(F.col("_url"))
    hit = F.call_function("regexp_like", low, F.col("regex"))
    judged = found.withColumn("hit", hit).groupBy("_url").agg(F.count(F.lit(1)).alias("n_candidates"), F.min(F.when(F.col("hit") & ~F.col("exception"), F.col("rule"))).alias("_block"), F.min(F.when(F.col("hit") & F.col("exception"), F.col("rule"))).alias("_except"))
    loose = [r for r in pattern_rules if not pattern_tokens(r)]
    if loose:
        every = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(pattern_regex(r)).alias("regex"), F.lit(r.startswith("@@")).alias("exception")) for r in loose])
        hits = urls.select("_url", F.filter(every, lambda r: F.call_function("regexp_like", low, r["regex"])).alias("_l"))
        least = lambda own, exception: F.least(own, F.array_min(F.transform(F.filter("_l", lambda r: r["exception"] == exception), lambda r: r["rule"])))
        judged = hits.join(judged, "_url", "left").select("_url", (F.coalesce("n_candidates", F.lit(0)) + len(loose)).alias("n_candidates"), least(F.col("_block"), False).alias("_block"), least(F.col("_except"), True).alias("_except"))
    out = rows.join(judged, F.col("url") == F.col("_url"), "left").withColumn("exact", host_rule(F.col("host"), F.col("path"), host_rules))
    pattern = F.coalesce("_except", "_block")
    verdict = F.coalesce(F.col("exact.verdict"), F.when(F.col("_except").isNull() & F.col("_block").isNotNull(), "block").otherwise("allow"))
    return out.select(*columns_of(df, *names), "host", "path", F.col("exact.rule").alias("rule"), verdict.alias("verdict"), pattern.alias("pattern_rule"), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"))


def op8_url_filter(spark, sf_dir):
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


def _sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[0], r[1])} THEN '{(r[0] + r[1]) if k == 'rule' else r[2]}'" for r in sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1]))) + " END"
    rules = ", ".join(f"('{r}', '{pattern_regex(r)}', {str(r.startswith('@@')).lower()})" for r in PATTERN_RULES)
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(pattern, re, exc) AS (VALUES {rules}),
hits AS (SELECT u.url, min(pattern) FILTER (WHERE NOT exc) AS block_rule, min(pattern) FILTER (WHERE exc) AS except_rule
  FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL) u, rules WHERE regexp_matches(translate(u.url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), re) GROUP BY u.url)
SELECT page_id, host, path, {case('rule')} AS rule,
  coalesce({case('verdict')}, CASE WHEN block_rule IS NOT NULL AND except_rule IS NULL THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(except_rule, block_rule) AS pattern_rule
FROM parts LEFT JOIN hits USING (url)"""


SQL = _sql()
