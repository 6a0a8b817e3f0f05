"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read here, and a tokenizer with the same normaliser, white-space marker,
pieces, scores and byte fallback is rebuilt on the tokenizers library: a Unigram model for unigram
files, merges in the order of the merged piece's score for BPE files. All ids come from it; the
sentencepiece library is used only to verify parity.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, table

MARK = "▁"
#: Fixed values of the format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Entries of the newer half of the memory of chunks that a task keeps; chunks encoded at once; threads that encode them.
MEMORY, AT_ONCE, THREADS = 160_000, 8192, 2
_CODECS: dict = {}


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        if c < 128:
            return value, i
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: ints of varints, bytes of the other kinds."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind in (1, 2, 5):
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, i = _varint(b, i)
            if i + size > len(b):
                raise ValueError("the message is cut short")
            value, i = b[i : i + size], i + size
        else:
            raise ValueError(f"wire type {kind} is not read")
        yield tag >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces as (text, score, type), and what is needed of the trainer's and normaliser's settings."""
    out = {"pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "unk_id": 0, "charsmap": b"", "dummy_prefix": True, "trim": True, "escape": True, "suffix": False}
    for number, value in fields(data):
        if number == 1:
            f = dict(fields(value))
            out["pieces"].append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(fields(value))
            out |= {"model_type": f.get(3, UNIGRAM), "byte_fallback": bool(f.get(35, 0)), "unk_id": f.get(40, 0), "suffix": bool(f.get(24, 0))}
        elif number == 3:
            f = dict(fields(value))
            out |= {"charsmap": f.get(2, b""), "dummy_prefix": bool(f.get(3, 1)), "trim": bool(f.get(4, 1)), "escape": bool(f.get(5, 1))}
    if out["model_type"] not in (UNIGRAM, BPE) or not out["escape"] or out["suffix"]:
        raise ValueError("only unigram and BPE models with a leading white-space marker are rebuilt")
    return out


def build(model: dict):
    """The tokenizers.Tokenizer that does what the model file describes."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    if model["model_type"] == UNIGRAM:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in pieces], unk_id=model["unk_id"], byte_fallback=model["byte_fallback"]))
    else:
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        merges = []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                left, right = p[:cut], p[cut:]
                if left in ids and right in ids:
                    merges.append((-pieces[i][1], ids[left], ids[right], left, right))
        merges.sort()
        t = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, [m[3:] for m in merges], unk_token=pieces[model["unk_id"]][0], fuse_unk=True, byte_fallback=model["byte_fallback"]))
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["trim"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    own = [p for p, _, kind in pieces if kind == USER]
    if own:
        t.add_tokens([AddedToken(p, normalized=True) for p in own])
    strip = [decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return t


def chunked(model: dict) -> bool:
    """Whether a text may be encoded chunk by chunk, each one marker run and what follows it.

    True where no piece has a marker after another character (so that nothing is merged across a
    chunk's start), the prefix marker is put first, and the normaliser changes nothing else.
    """
    inner = any(MARK in p.lstrip(MARK) for p, _, kind in model["pieces"] if kind in (NORMAL, USER))
    return model["model_type"] == BPE and not inner and model["dummy_prefix"] and not model["trim"] and not model["charsmap"] and not any(kind == USER for *_, kind in model["pieces"])


class Codec:
    """Encoding, decoding and parity for one model file; a task builds it once.

    `young` and `old` hold the ids of chunks as little-endian 32-bit integers. When `young` is full it
    becomes `old`; chunks met again move back, so that frequent ones are encoded once.
    """

    def __init__(self, path: str, threads: int = THREADS):
        os.environ |= {"RAYON_NUM_THREADS": str(threads), "TOKENIZERS_PARALLELISM": "true"}  # read at the first batch of a process
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.model, self.threads = parse_model(data), threads
        self.tokenizer = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.chunked = chunked(self.model)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.unlike: set[str] = set()  # chunks that sentencepiece encodes differently
        self.lossy: set[str] = set()  # chunks that their ids do not give back

    def _encode(self, many: list[str]) -> Iterator[bytes]:
        """The rebuilt tokenizer's ids of each text; notes texts without parity and without a round trip."""
        for part in (many[i : i + AT_ONCE] for i in range(0, len(many), AT_ONCE)):
            ids = [g.ids for g in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            want = self.reference.encode(part, num_threads=self.threads)
            if ids != want:
                self.unlike.update(m for m, g, w in zip(part, ids, want, strict=True) if g != w)
            flat = [i for x in ids for i in x]
            if not self.chunked or self.decode([flat])[0] != " ".join(part):  # chunks decode one after the other
                self.lossy.update(m for m, d in zip(part, self.decode(ids), strict=True) if m != d)
            data, at = np.array(flat, dtype="<i4").tobytes(), 0
            for x in ids:
                yield data[at : at + 4 * len(x)]
                at += 4 * len(x)

    def _learn(self, chunks: set[str]) -> None:
        """Bring the ids of these chunks into `young`."""
        if len(self.young) > MEMORY:
            self.young, self.old = {}, self.young
            self.unlike, self.lossy = ({c for c in x if c in self.old} for x in (self.unlike, self.lossy))
        fresh = []
        for c in chunks.difference(self.young):
            ids = self.old.get(c)
            if ids is None:
                fresh.append(c)
            else:
                self.young[c] = ids
        if self.chunked and "" in fresh:  # a blank at the text's end: the marker alone
            fresh.remove("")
            self.young[""] = np.array([self.tokenizer.token_to_id(MARK)], dtype="<i4").tobytes()
        self.young.update(zip(fresh, self._encode(fresh), strict=True))

    def encode(self, many: list[str]) -> list[tuple[bytes, bool, bool]]:
        """Of each text: its ids, whether sentencepiece gives them too, and whether they decode to the text."""
        cut = [self._chunks(text) if self.chunked else [text] for text in many]
        self._learn(set().union(*cut))
        ids = self.young.__getitem__
        return [(b"".join(map(ids, chunks)), not self.unlike or self.unlike.isdisjoint(chunks), not self.lossy or self.lossy.isdisjoint(chunks)) for chunks in cut]

    def _chunks(self, text: str) -> list[str]:
        """The text cut before each run of blanks, less one blank, for which the prefix marker stands."""
        if not text:
            return []
        parts = text.split(" ")
        if "" not in parts:
            return parts
        chunks, blanks = [], 0
        for k, part in enumerate(parts):
            if part or k == len(parts) - 1:
                chunks.append(" " * blanks + part)
                blanks = 0
            else:
                blanks += 1
        return chunks

    def decode(self, many: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(many, skip_special_tokens=False)


def codec(path: str, threads: int = THREADS) -> Codec:
    if (path, threads) not in _CODECS:
        _CODECS[path, threads] = Codec(path, threads)
    return _CODECS[path, threads]


def encode(df: DataFrame, path: str, text: str = "text", batch_bytes: int = 1 << 20, threads: int = THREADS) -> DataFrame:
    """df with ids (array of int), n_tokens, parity and round_trip.

    ids are the rebuilt tokenizer's. parity: sentencepiece gives the same for each of the text's chunks;
    where it is false the ids stay as they are. round_trip: the tokenizer's decoder gives the text back
    from them. Null and empty texts have no ids, parity and round_trip true. Columns of df with those
    names are replaced; repeated rows are encoded alike; texts of any length are taken whole; an empty
    table gives no rows. A Python worker encodes on `threads` threads,
    unless another tokenizer of its process has started a pool before. parity and round_trip are of
    chunks where no piece crosses a blank, else of whole texts.
    """

    def run(s: pa.Array) -> pa.Array:
        c, got = codec(path, threads), []
        many, start, held = [t or "" for t in s.to_pylist()], 0, 0
        for i, t in enumerate(many):
            held += len(t)
            if held >= batch_bytes or i == len(many) - 1:
                got += c.encode(many[start : i + 1])
                start, held = i + 1, 0
        lengths = np.array([len(x) // 4 for x, _, _ in got], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(x for x, _, _ in got), dtype="<i4")))
        return pa.StructArray.from_arrays([lists, pa.array(lengths), pa.array([s for _, s, _ in got], pa.bool_()), pa.array([b for _, _, b in got], pa.bool_())], names=["ids", "n_tokens", "parity", "round_trip"])

    udf = F.arrow_udf(run, "ids array<int>, n_tokens long, parity boolean, round_trip boolean")
    return beside(df, udf(F.col(text).cast("string")), "ids", "n_tokens", "parity", "round_trip")


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of an id array; null ids give null, none give the empty text."""

    def run(s: pa.Array) -> pa.Array:
        many = s.to_pylist()
        got = codec(path).decode([x or [] for x in many])
        return pa.array([None if x is None else t for x, t in zip(many, got, strict=True)], pa.string())

    return df.withColumn(out, F.arrow_udf(run, "string")(F.col(ids)))



def op1_sentencepiece(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", "ids", "parity", "round_trip")
