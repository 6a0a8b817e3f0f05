"""Language-model scoring with a weighted backoff automaton.

Counts of training n-grams are smoothed with Dirichlet priors: an n-gram hw has probability
(c(hw) + m P(w|h')) / (c(h) + m), h' being h without its first word. In the automaton a state is a
context with a count, an arc reads a word that was seen in it and weighs log10 P(w|h), and where none
was, a failure arc of weight log10 m / (c(h) + m) leads to the state of h'. A text is read once from
left to right: the state is carried from token to token and the weights are added up.

The automaton grows with the corpus and is never brought together. Documents are put into packs; a
pack sends its distinct n-grams' hashes, by hash range, to the tasks that add up the counts, and gets
back the totals of its own n-grams, which is the part of the automaton that its texts can reach. A
pack sends each range one row at most, and no more rows than it has n-grams.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, stored, table

#: n of the longest n-grams, pseudo-counts m of the orders from 2 on, and what the unigrams add to each count.
ORDER, PRIORS, ADD = 2, (300.0, 30.0, 10.0), 0.5
#: Bytes of text of a pack, and n-grams that a counting task gets on average.
PACK_BYTES, KEYS_PER_TASK = 6 << 20, 2_000_000
END = b""  # no word is empty
#: Tokens that one lane of a walk reads: texts are walked side by side, long ones in pieces.
PIECE = 512


def held_out(key) -> bool:
    """Whether crc32 of the key as text leaves 1 when divided by 5; a null key is the empty text."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % 5 == 1


def _squeeze(a: np.ndarray) -> bytes:
    """An integer array's bytes, those of equal rank together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) if len(a) else b""


def _spread(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.empty(0, dtype=kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair (a, b)."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C159E3779B9))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Pack:
    """The tokens of some documents: word numbers one after the other, each text closed by END."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, train: np.ndarray):
        self.ids, self.hashes, self.lengths, self.train = ids, hashes, lengths, train
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        self.depth = np.arange(len(ids)) - np.repeat(self.starts, lengths)  # tokens before it in its text
        self.counted = np.repeat(train, lengths)

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For n from 1: n, sorted distinct hashes, the place of each token's n-gram, those of training tokens counted.

        The place is -1 where a text has fewer tokens before.
        """
        words = self.hashes[self.ids]
        key = words
        for n in range(1, order + 1):
            if n > 1:
                key = np.concatenate([key[:1], _mix(key[:-1], words[1:])])
            whole = self.depth >= n - 1
            distinct, at = np.unique(key[whole], return_inverse=True)
            place = np.full(len(key), -1, dtype=np.int64)
            place[whole] = at
            yield n, distinct, place, np.bincount(at[self.counted[whole]], minlength=len(distinct))


def _task_of(keys: np.ndarray, tasks: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(tasks)) >> np.uint64(32)


class Automaton:
    """States, arcs and failure arcs over the n-grams of a pack, numbered order after order.

    node[n - 1][i] is the number of the n-gram that ends at token i, -1 where its text has fewer tokens.
    As an arc it leads out of its first n - 1 words' state; arc_weight is -inf where it was not seen,
    but the empty state has an arc for every word. As a state it stands for the context of its words.
    State -1 is the empty one, in which texts begin.
    """

    def __init__(self, pack: Pack, totals: list[np.ndarray], whole: float, priors: tuple[float, ...]):
        self.order, self.node, self.pack = len(totals), [], pack
        parts, prob, before, at = [], None, 0, 0  # before, at: where the numbers of the last order and of this one begin
        for n, distinct, place, _ in pack.grams(self.order):
            c, some = totals[n - 1].astype(float), np.flatnonzero(place >= 0)
            last = np.zeros(len(distinct), dtype=np.int64)
            last[place[some]] = some  # a token at which the n-gram ends
            if n == 1:
                suffix = np.full(len(distinct), -1, dtype=np.int32)
                p = (c + ADD) / whole
                seen = np.ones(len(distinct), dtype=bool)
            else:
                suffix, context = self.node[n - 2][last], self.node[n - 2][last - 1]
                m = priors[n - 2]
                p = (c + m * prob[suffix - before]) / (held[context - before] + m)
                seen = c > 0
            own, inner = np.arange(at, at + len(distinct), dtype=np.int32), n < self.order
            back = np.log10(priors[n - 1] / (c + priors[n - 1])) if inner else np.zeros(len(distinct))
            parts.append((c, np.where(seen, np.log10(p), -np.inf), np.where(c > 0, own, np.int32(-1)) if inner else suffix, suffix, back, np.full(len(distinct), n, dtype=np.int8)))
            self.node.append(np.where(place < 0, -1, place + at).astype(np.int32))
            prob, held, before, at = p, c, at, at + len(distinct)
        self.count, self.arc_weight, self.target, self.fail, self.fail_weight, self.depth = (np.concatenate(x) for x in zip(*parts, strict=True))
        if self.order == 1:
            self.target[:] = -1
        self.table = np.stack(self.node)

    def walk(self, piece: int = PIECE) -> np.ndarray:
        """The log10 probability of each text.

        Lanes read one token each at a time. A lane starts order - 1 tokens before its piece, whose
        weights it does not add: after them it is in the state that a walk from the text's start is in.
        """
        p, lead = self.pack, self.order - 1
        parts = -(-p.lengths // piece)
        text = np.repeat(np.arange(len(parts)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = p.starts[text] + nth * piece
        start = np.maximum(begin - lead, p.starts[text])
        end = np.minimum(begin + piece, p.starts[text] + p.lengths[text])
        by = np.argsort(start - end, kind="stable")  # the longest first
        text, begin, start, end = text[by], begin[by], start[by], end[by]
        state, sums = np.full(len(text), -1, dtype=np.int64), np.zeros(len(text))
        for step in range(int((end - start).max(initial=0))):
            live = int(np.searchsorted(start - end, -step, side="left"))
            at, now = start[:live] + step, state[:live].copy()
            gain, todo = np.zeros(live), np.arange(live)
            while len(todo):
                s = now[todo]
                level = np.where(s < 0, 0, self.depth[s])
                arc = self.table[level, at[todo]]
                w = self.arc_weight[arc]
                found = w > -np.inf
                gain[todo[found]] += w[found]
                now[todo[found]] = self.target[arc[found]]
                todo, s = todo[~found], s[~found]
                gain[todo] += self.fail_weight[s]
                now[todo] = self.fail[s]
            state[:live] = now
            sums[:live] += np.where(at >= begin[:live], gain, 0.0)
        return np.bincount(text, weights=sums, minlength=len(parts))


def _packs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (pack, keys, train, lengths, ids, hashes): documents in packs of about PACK_BYTES."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            ids = np.array(stream, dtype=np.uint32)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in number], dtype=np.uint64)
            values = [[uuid.uuid4().hex], [keys], [train], [lengths], [len(ids)], [_squeeze(ids)], [hashes.tobytes()]]
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["pack", "keys", "train", "lengths", "n", "ids", "hashes"])

        number, stream, keys, train, lengths, held = {END: 0}, [], [], [], [], 0
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                w = (t or b"").lower().split()
                for x in w:
                    if x not in number:
                        number[x] = len(number)
                stream.extend(map(number.__getitem__, w))
                stream.append(0)
                keys.append(k)
                train.append(not held_out(k))
                lengths.append(len(w) + 1)
                held += len(t or b"")
                if held >= PACK_BYTES:
                    yield row()
                    number, stream, keys, train, lengths, held = {END: 0}, [], [], [], [], 0
        if keys:
            yield row()

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(build, "pack string, keys array<long>, train array<boolean>, lengths array<int>, n long, ids binary, hashes binary")


def _open(row: dict) -> Pack:
    return Pack(_spread(row["ids"], np.uint32), np.frombuffer(row["hashes"], dtype=np.uint64), np.array(row["lengths"], dtype=np.int64), np.array(row["train"], dtype=bool))


def count_grams(packs: DataFrame, order: int, tasks: int) -> DataFrame:
    """Rows (pack, n, task, totals, tokens, types): training counts of a pack's n-grams in a hash range.

    totals follow the pack's sorted hashes of that range; tokens and types, of the range's order-1
    counts, are on one row of each range, whose pack is null.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                for n, keys, _, counts in _open(row).grams(order):
                    cuts = np.searchsorted(_task_of(keys, tasks), np.arange(tasks + 1))
                    some = [t for t in range(tasks) if cuts[t] < cuts[t + 1]]
                    blobs = [(_squeeze(np.diff(keys[cuts[t] : cuts[t + 1]], prepend=np.uint64(0))), _squeeze(counts[cuts[t] : cuts[t + 1]].astype(np.uint32))) for t in some]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["pack"]] * len(some), pa.string()), pa.array([n] * len(some), pa.int32()), pa.array([x for x, _ in blobs], pa.binary()), pa.array([x for _, x in blobs], pa.binary())], names=["task", "pack", "n", "deltas", "counts"])

    def add(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["n"], r["pack"]))
        out = []
        for n in sorted({r["n"] for r in rows}):
            own = [r for r in rows if r["n"] == n]
            keys = [np.cumsum(_spread(r["deltas"], np.uint64), dtype=np.uint64) for r in own]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(at, weights=np.concatenate([_spread(r["counts"], np.uint32) for r in own]), minlength=len(distinct)).astype(np.int64)
            ends = np.cumsum([0, *map(len, keys)])
            for r, a, z in zip(own, ends, ends[1:], strict=False):
                out.append((r["pack"], n, r["task"], _squeeze(totals[at[a:z]]), 0, 0))
            if n == 1:
                out.append((None, 1, own[0]["task"], b"", int(totals.sum()), int((totals > 0).sum())))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["pack", "n", "task", "totals", "tokens", "types"])

    sent = packs.mapInArrow(send, "task int, pack string, n int, deltas binary, counts binary")
    return sent.groupBy("task").applyInArrow(add, "pack string, n int, task int, totals binary, tokens long, types long")


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, priors: tuple[float, ...] = PRIORS) -> DataFrame:
    """One row per row of df: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows that are not held out and scores all. Null and empty texts have the
    end token alone; repeated rows are counted and scored as often as they are there; a text of any
    length is in one pack whole. If nothing is learned (all held out), every token has probability 1.
    An empty table gives no rows. Scores are rounded to six places.
    """
    packs = stored(_packs(df, key, text), "lm-packs")
    tasks = max(1, math.ceil((packs.agg(F.sum("n")).first()[0] or 0) * order / KEYS_PER_TASK))
    counted = stored(count_grams(packs, order, tasks), "lm-counts")
    model = counted.where("pack is null").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    total, types = model.tokens or 0, model.types or 0
    whole = total + ADD * (types + 1)
    back = counted.where("pack is not null").groupBy("pack").agg(F.collect_list(F.struct("n", "task", "totals")).alias("back"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                p, back_ = _open(row), sorted(row["back"], key=lambda r: (r["n"], r["task"]))
                totals = [np.concatenate([np.empty(0, dtype=np.int64), *(_spread(r["totals"], np.int64) for r in back_ if r["n"] == n)]) for n in range(1, order + 1)]
                model = Automaton(p, totals, whole, priors)
                known, base = (model.count > 0).astype(np.int64), np.log10((model.count + ADD) / whole)
                sums = [np.add.reduceat(x[model.node[0]], p.starts) for x in (known, base)]
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array(~p.train), pa.array(p.lengths), pa.array(sums[0]), pa.array(np.full(len(p.lengths), total, dtype=np.int64)), pa.array(sums[1].round(6)), pa.array(model.walk().round(6))], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return packs.join(back, "pack").mapInArrow(score, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_score(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


SQL = f"""
WITH k AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
d AS (SELECT doc_id, {crc32_sql('k')} % 5 = 1 AS held_out, list_append(words, '') AS toks FROM k),
t AS (SELECT doc_id, held_out, unnest(toks) AS w, unnest(list_prepend(NULL, toks[:-2])) AS h FROM d),
c1 AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
c2 AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out AND h IS NOT NULL GROUP BY h, w),
m AS (SELECT sum(c) AS n, count(*) AS v FROM c1),
p AS (SELECT t.doc_id, t.held_out, m.n, coalesce(a.c, 0) AS c, coalesce(b.c, 0) AS ch, coalesce(g.c, 0) AS chw, (coalesce(a.c, 0) + {ADD}) / (m.n + {ADD} * (m.v + 1)) AS p1
  FROM t CROSS JOIN m LEFT JOIN c1 a ON a.w = t.w LEFT JOIN c1 b ON b.w = t.h LEFT JOIN c2 g ON g.h = t.h AND g.w = t.w)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, CAST(n AS BIGINT) AS train_tokens,
  round(sum(log10(p1)), 6) AS base_score, round(sum(log10((chw + {PRIORS[0]} * p1) / (ch + {PRIORS[0]}))), 6) AS score
FROM p GROUP BY doc_id, held_out, n"""
