"""Periodic runs of words: recursive frequency splitting, then a scan of lags.

A word of a run stands in it at least twice. So a word that a segment holds once is in no run of that
segment and splits it; what is left of it is split again, until every word of every segment is there
twice. Few segments of natural text survive. In these, two words q apart are compared at anchors so
close that every run of period q has one, and what agrees is extended to both sides.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, crc32_sql, table

#: Least words of a run; words that are compared at an anchor.
LEAST, GRAM = 12, 4
#: Words of the texts that are scanned together; pairs of anchors that are looked at together.
GROUP_WORDS, CHUNK_PAIRS = 200_000, 1_000_000
#: Rounds in which all segments are split at once; a segment that needs more is split by itself.
ROUNDS = 40


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the half-open ranges, and for each the number of its range."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


def _split_alone(start: int, end: int, before: np.ndarray, after: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The stable segments of one; it is looked at from both ends, so that a cut costs its smaller side."""
    todo, done = [(start, end)], []
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        for i in range((b - a + 1) // 2):
            cut = next((c for c in (a + i, b - 1 - i) if before[c] < a and after[c] >= b), None)
            if cut is not None:
                todo += [(a, cut), (cut + 1, b)]
                break
        else:
            done.append((a, b))
    return done


def stable_segments(words: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments of at least `least` words in which every word is there twice.

    `words` are the numbers of the words of several texts, `ends` where each text ends.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), ends - starts)
    key = text * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    before, after = np.full(len(words), -1), np.full(len(words), len(words))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    a, b = starts, ends.astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        a, b = (x[b - a >= least] for x in (a, b))
        at, which = _ranges(a, b)
        alone = (before[at] < a[which]) & (after[at] >= b[which])
        cut = np.bincount(which[alone], minlength=len(a)) > 0
        done.append((a[~cut], b[~cut]))
        if not cut.any():
            break
        a, b = np.sort(np.concatenate([a[cut], at[alone] + 1])), np.sort(np.concatenate([at[alone], b[cut]]))
    else:
        rest = [x for s, e in zip(a.tolist(), b.tolist(), strict=True) for x in _split_alone(s, e, before, after, least)]
        done.append(tuple(np.array(rest, dtype=np.int64).reshape(-1, 2).T))
    a, b = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(a)
    return a[order], b[order]


def _doubled(rank: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the stretches of 2 * width words from those of width words."""
    key = rank.astype(np.int64) * (int(rank.max(initial=0)) + 2)
    key[: max(0, len(rank) - width)] += rank[width:] + 1
    return np.unique(key, return_inverse=True)[1]


def lag_scan(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of the runs within the segments, by start and period.

    A run of period q has max(least, 2q) words or more, so words q apart agree at max(least - q, q)
    neighbouring places or more. Anchors stand so close that GRAM of these follow one, which makes about
    m ln(m) pairs for a segment of m words. Pairs that agree are extended by stretches whose lengths
    are powers of two. A stretch that also has a multiple of its period is reported once.
    """
    m = ends - starts
    lag, which = _ranges(np.ones_like(m), m // 2 + 1)
    step = np.maximum(least - lag, lag) - (GRAM - 1)
    anchors = np.maximum(0, (m[which] - lag - GRAM) // step + 1)
    ranks = [np.unique(words, return_inverse=True)[1]]
    for width in (1, 2):
        ranks.append(_doubled(ranks[-1], width))
    gram, hits = ranks[2], []
    cuts = np.unique([0, *np.searchsorted(np.cumsum(anchors), np.arange(CHUNK_PAIRS, anchors.sum(), CHUNK_PAIRS)), len(lag)])
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        n, row = _ranges(np.zeros(hi - lo, dtype=np.int64), anchors[lo:hi])
        row += lo
        i, q = starts[which[row]] + n * step[row], lag[row]
        agree = gram[i] == gram[i + q]
        hits.append(np.stack([i[agree], q[agree], which[row][agree]]))
    i, q, seg = np.concatenate([*hits, np.empty((3, 0), dtype=np.int64)], axis=1).astype(np.int64)
    first, last = starts[seg], ends[seg]

    def equal(k: int, at: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Whether the 2^k words from `at` are those q further on, where there is room for them."""
        fits, rank = room >= 1 << k, ranks[k]
        at = np.where(fits, at, 0)
        return fits & (rank[at] == rank[np.where(fits, at + q, 0)])

    while len(i) and (equal(len(ranks) - 1, i, last - q - i) | equal(len(ranks) - 1, i - (1 << len(ranks) - 1), i - first)).any():
        ranks.append(_doubled(ranks[-1], 1 << len(ranks) - 1))
    right, left = np.zeros_like(i), np.zeros_like(i)
    for k in range(len(ranks) - 1, -1, -1):
        right += equal(k, i + right, last - q - i - right) << k
        left += equal(k, i - left - (1 << k), i - left - first) << k
    start, end = i - left, i + q + right
    long = end - start >= np.maximum(least, 2 * q)
    runs = np.stack([start[long], end[long], q[long]], axis=1)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """For each list of words the rows (start, length, period) of its runs, by start and period."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter((n for t in texts for n in map(numbers.__getitem__, t)), dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    a, b = stable_segments(words, ends, least)
    at, _ = _ranges(a, b)
    close = np.cumsum(b - a)
    runs = lag_scan(words[at], close - (b - a), close, least)
    start, length, period = at[runs[:, 0]] if len(runs) else runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]
    text = np.searchsorted(ends, start, side="right")
    found = np.stack([start - (ends - sizes)[text] if len(runs) else start, length, period], axis=1)
    return np.split(found, np.searchsorted(text, np.arange(1, len(texts))))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by blanks, without what follows the first period of a run."""
    if len(runs):
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """df with runs, an array of (start, length, period), and collapsed, the text without the repeats.

    Words are what blanks `[\\x20\\x09-\\x0D]` part, numbered from 0. A run is a stretch of at least
    max(least, 2 * period) words that has this least period and that no neighbouring word extends;
    runs are in the order of start and period. collapsed has the words that no run contains after its
    first period, joined by one blank. Null, empty and blank texts have no runs and an empty collapsed
    text. Columns of df of these two names are replaced, all others kept; repeated rows are treated
    alike; an empty table gives no rows. least is 6 at least. No rows are shuffled.
    """
    if least < 7:
        raise ValueError("least must be 7 or more")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(column: pa.Array) -> pa.Array:
        found, short, held, size = [], [], [], 0
        for t in column.cast(pa.large_binary()):
            held.append((t.as_py() or b"").split())
            size += len(held[-1])
            if size >= GROUP_WORDS or len(found) + len(held) == len(column):
                runs = runs_of(held, least)
                found += runs
                short += [collapsed(w, r) for w, r in zip(held, runs, strict=True)]
                held, size = [], 0
        flat = np.concatenate([*found, np.empty((0, 3), dtype=np.int64)])
        offsets = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
        rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, rows), pa.array(short, pa.binary()).cast(pa.string())], names=["runs", "collapsed"])

    scan = F.arrow_udf(find, "runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return beside(df, scan(F.col(text).cast("string")), "runs", "collapsed")


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs whose texts repeat from some word on, where 10 divides the CRC-32 of the key in decimal."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int")))
    again = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return docs.withColumn(text, F.when((h % 10 == 0) & (n > 0), F.array_join(again, " ")).otherwise(F.col(text)))


def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    top = F.array_min(F.transform("runs", lambda x: F.struct((-x["length"]).alias("length"), x["start"].alias("start"), x["period"].alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "top.start", (-F.col("top.length")).alias("length"), "top.period", F.floor(-1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


SQL = f"""
WITH k AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
h AS (SELECT doc_id, words, len(words) AS n, {crc32_sql('k')} AS h FROM k),
a AS (SELECT *, h % 10 = 0 AND n > 0 AS plant, (h // 10) % greatest(n, 1) AS a, (h // 10) % 8 AS g8 FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g8) AS p FROM a),
o AS (SELECT doc_id, n, unnest(range(n)) AS i, words, plant, a, p FROM p),
t AS (SELECT doc_id, n, i, words[1 + CASE WHEN plant AND i >= a THEN a + (i - a) % p ELSE i END] AS w FROM o),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS grp FROM m),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM g GROUP BY doc_id, q, grp HAVING count(*) + q >= greatest({LEAST}, 2 * q)),
r AS (SELECT doc_id, s, l, min(q) AS q FROM s GROUP BY doc_id, s, l),
f AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, min(struct_pack(l := -l, s := s, q := q)) AS top FROM r GROUP BY doc_id),
c AS (SELECT t.doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.s + r.q AND t.i < r.s + r.l) GROUP BY t.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(-top.l AS BIGINT) AS length, CAST(top.q AS BIGINT) AS period, CAST(-1000 * top.l // top.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)"""
