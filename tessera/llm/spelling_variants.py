"""Spelling variants: permuterm rotations of words, sorted and scanned by the prefix they share.

A word `uxv` marked by a terminator has the rotation `v$ux`, whose last character is the one at x. All
words that differ from it there alone, in what stands at x or by having nothing there, have a rotation
that begins with `v$u` and ends at most one character later. So the words near to a word are the other
members of the ranges of its prefixes. Such a range has one member for each character of the alphabet
at most, and one without: it is scanned for counts and its two best members, and no pairs are made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remove_folder, shared_folder, table, texts

#: Runs of letters `[A-Za-z\\u00C0-\\u00FF]` in UTF-8 after lower-casing A-Z.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Words that a task counts before it sends them on; bytes up to which CRCs are advanced together.
TASK_WORDS, ADVANCED = 300_000, 64
#: Characters of a prefix that is sorted as it stands; longer ones by their MD5.
LONGEST_PREFIX = 65


def _crc_table() -> np.ndarray:
    """The effect of each byte on a reflected CRC-32."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> np.uint32(1) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


def _advanced(crcs: np.ndarray) -> np.ndarray:
    """Row n: what the CRCs before it add to the CRC of a word of n bytes."""
    t, rows = _crc_table(), [crcs]
    for _ in range(ADVANCED):
        rows.append(t[rows[-1] & np.uint32(255)] ^ rows[-1] >> np.uint32(8))
    return np.stack(rows)


def without(word: bytes, h: int) -> bytes:
    """The word without its code point h modulo its length."""
    w = word.decode()
    i = h % len(w)
    return (w[:i] + w[i + 1 :]).encode()


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", slips: int = 0, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """Rows (word, n): the words of all texts, A-Z lower-cased, with at least these code points and occurrences.

    Words are maximal runs of `[A-Za-z\\u00C0-\\u00FF]`. With slips, a word loses a code point in a text
    where slips divides h, the CRC-32 of `<key>:<word>`: the one at h modulo its length; texts without
    a key lose none. Null and empty texts have no words; repeated rows count as often as they are there.
    Tasks count their own words first, so a frequent word is one row a task.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = defaultdict(count().__next__)
        crc, size, total, slipped = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), Counter()

        def send() -> pa.RecordBatch:
            all_ = Counter(dict(zip(number, total.tolist(), strict=True)))
            all_.update(slipped)
            word, n = pa.array(list(all_), pa.binary()).cast(pa.string()), pa.array(list(all_.values()), pa.int64())
            return pa.RecordBatch.from_arrays([word, n], names=["word", "n"]).filter(pc.and_(pc.greater_equal(pc.utf8_length(word), least_length), pc.greater(n, 0)))

        for b in batches:
            runs = [RUN.findall(t.lower()) for t in texts(b, "_text")]
            known = len(number)
            at = np.fromiter(map(number.__getitem__, chain.from_iterable(runs)), dtype=np.int64)
            new = [w for _, w in zip(range(len(number) - known), reversed(number), strict=False)][::-1]
            crc = np.concatenate([crc, np.fromiter(map(zlib.crc32, new), dtype=np.uint32)])
            size = np.concatenate([size, np.fromiter(map(len, new), dtype=np.int64)])
            total = np.concatenate([total, np.zeros(len(new), dtype=np.int64)]) + np.bincount(at, minlength=len(number))
            if slips:
                ids = b.column(0).to_pylist()
                doc = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
                before = np.array([zlib.crc32(b"%d:" % i) if i is not None else 0 for i in ids], dtype=np.uint32)
                h = crc[at] ^ _advanced(before)[np.minimum(size[at], ADVANCED), doc]
                words = list(number) if (size[at] > ADVANCED).any() or (h % slips == 0).any() else []
                for i in np.flatnonzero(size[at] > ADVANCED):
                    h[i] = zlib.crc32(words[at[i]], int(before[doc[i]]))
                named = np.array([i is not None for i in ids], dtype=bool)
                for i in np.flatnonzero((h % slips == 0) & named[doc]):
                    total[at[i]] -= 1
                    slipped[without(words[at[i]], int(h[i]))] += 1
            if len(number) + len(slipped) > TASK_WORDS:
                yield send()
                number, crc, size, total, slipped = defaultdict(count().__next__), crc[:0], size[:0], total[:0], Counter()
        yield send()

    source = df.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    return source.mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """Rows (prefix, last, first, word, n): the rotations of each marked word.

    With a last character, the prefix is what is left of the rotation without it; `first` says that the
    character before it in the word is another one. Without, the whole rotation is the prefix.
    """
    i, whole = F.floor(F.col("k") / 2).cast("int"), F.col("k") % 2 == 0
    w = words.select("word", "n", F.explode(F.sequence(F.lit(0), 2 * F.length("word"))).alias("k"))
    last = F.when(whole, F.lit("")).otherwise(F.substring("word", i + 1, F.lit(1)))
    prefix = F.concat(F.substring("word", i + 1 + F.length(last), F.length("word")), F.lit("$"), F.substring("word", F.lit(1), i))
    first = ~whole & ((i == 0) | (F.substring("word", i, F.lit(1)) != last))
    return w.select(F.when(F.length(prefix) > LONGEST_PREFIX, F.md5(prefix.cast("binary"))).otherwise(prefix).alias("prefix"), last.alias("last"), first.alias("first"), "word", "n")


def spelling_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root) for rows (word, n) with distinct words.

    Two words are near if one inserted, deleted or replaced code point makes one the other; n_near
    counts them. form is the near word of largest n, on a tie the least in code-point order, if its n
    (form_n) is at least `factor` times the word's, else null; root follows forms to the last, and is the
    word itself if it has none. No words give no rows; a word without letters is as any other. Time
    grows with the square of a word's length, rows with the length.

    A pair that differs by an indel within equal characters shares several prefixes: n_near counts the
    one at the first of these characters only.
    """
    spark, paths = words.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        paths.append(shared_folder(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.parquet(paths[-1])

    words = kept(words.select("word", "n"), "variant-words")
    ranked = Window.partitionBy("prefix").orderBy(F.desc("n"), "word")
    scan = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one, whole = F.lit(1), F.col("last") == ""
    member = F.struct("n", "word")
    found = rotations(words).select(
        "word", "n", "first", whole.alias("whole"), F.row_number().over(ranked).alias("place"), F.count(one).over(scan).alias("members"), F.count_if(whole).over(scan).alias("wholes"),
        F.count_if(F.col("first")).over(scan).alias("firsts"), F.first(member).over(scan).alias("top"), F.nth_value(member, 2).over(scan).alias("next"),
    ).where("members > 1")
    near = F.when(F.col("whole"), F.col("firsts")).otherwise(F.col("members") - F.col("wholes") - 1 + F.when(F.col("first"), F.col("wholes")).otherwise(0))
    other = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top"))
    rows = found.select("word", "n", near.alias("near"), F.struct((-other["n"]).alias("n"), other["word"].alias("word")).alias("best"))
    rows = rows.unionByName(words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<n: long, word: string>").alias("best")))
    best = rows.groupBy("word").agg(F.first("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    large = -F.col("best.n") >= factor * F.col("n")
    best = kept(best.select("word", "n", "n_near", F.when(large, F.col("best.word")).alias("form"), F.when(large, -F.col("best.n")).alias("form_n")), "variant-forms")
    roots = best.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that a root is away, and a step multiplies n by the factor
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = kept(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    out = kept(best.join(roots.drop("moved"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), "variants")
    for path in paths[:-1]:
        remove_folder(spark, path)
    return out


def op11_spelling_variants(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return spelling_variants(word_counts(docs, slips=97)).select("word", "form", "root", "n", "n_near", "form_n")


SQL = """
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, run, count(*) AS c, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS bytes FROM r GROUP BY doc_id, run),
crcs AS MATERIALIZED (SELECT b, list_reduce(list_prepend(b, [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END) AS t FROM range(256) x(b)),
h AS (SELECT id, 0 AS at, CAST(4294967295 AS BIGINT) AS h FROM d UNION ALL SELECT h.id, h.at + 1, xor(h.h >> 8, t) FROM h JOIN d ON d.id = h.id AND h.at < len(d.bytes) JOIN crcs ON b = xor(h.h & 255, d.bytes[h.at + 1])),
e AS (SELECT run, c, xor(h, CAST(4294967295 AS BIGINT)) AS h FROM h JOIN d ON d.id = h.id AND h.at = len(d.bytes)),
w AS MATERIALIZED (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM e GROUP BY word HAVING sum(c) >= 3 AND length(word) >= 5),
s AS MATERIALIZED (SELECT word, n, i, substr(word, i + 2) || '$' || substr(word, 1, i) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT x.word, y.word AS other, y.n AS m FROM s x JOIN s y ON x.rest = y.rest AND x.word <> y.word
  UNION SELECT s.word, w.word, w.n FROM s JOIN w ON w.word = substr(s.word, 1, i) || substr(s.word, i + 2)
  UNION SELECT w.word, s.word, s.n FROM s JOIN w ON w.word = substr(s.word, 1, i) || substr(s.word, i + 2)),
q AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -m, o := other)) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.o END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM w LEFT JOIN q ON q.word = w.word),
g AS (SELECT word, word AS root, form AS nxt FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON f.word = g.nxt)
SELECT f.word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN g ON g.word = f.word AND g.nxt IS NULL"""
