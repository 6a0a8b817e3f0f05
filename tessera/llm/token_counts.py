"""Token counts through a digest cache.

The digest of a text's normalised content and a tokenizer version's digest find a stored count. Only
distinct contents that the cache lacks are encoded, and their counts are appended to it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, lookup, row_without, shared_folder, stored, table, texts

#: Entries of the memory of pieces that a task keeps; beyond it the memory starts anew.
MEMORY = 400_000
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Blank runs never lie inside a token of the tokenizers whose normaliser collapses white space.
_TOKENIZERS: dict = {}


def tokenizer_digest(path: str) -> str:
    """Identifies the vocabulary file and the library's version."""
    if path.endswith(".json"):
        import tokenizers as lib
    else:
        import sentencepiece as lib
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + lib.__version__.encode()).hexdigest()


def _splits_at_blanks(spec: dict) -> bool:
    """Whether no token of this tokenizer can span or depend on ASCII blanks around it: the white
    space normaliser makes runs one blank, and the splitting pattern drops blanks."""
    norms = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return any(n.get("type") == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " " for n in norms) and pre.get("type") == "Split" and pre.get("behavior") == "Removed" and pre.get("invert") is True and r"\s" not in pre["pattern"].get("Regex", "").replace(r"[^\s", "") and not any(" " in t["content"] for t in spec.get("added_tokens", []))


def counter(path: str):
    """A function from a list of UTF-8 texts to their token counts, as the library gives them."""
    if path in _TOKENIZERS:
        return _TOKENIZERS[path]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda many: [len(x) for x in sp.encode([t.decode() for t in many], num_threads=1)]
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        whole = lambda many: [len(x.ids) for x in t.encode_batch_fast([m.decode() for m in many], add_special_tokens=False)]
        with open(path) as f:
            apart = _splits_at_blanks(json.load(f))
        known: dict[bytes, int] = {}

        def by_piece(many: list[bytes]) -> list[int]:
            cut = [m.split() for m in many]  # at ASCII blanks; all of them are white space to the library
            if len(known) > MEMORY:
                known.clear()
            new = [p for p in dict.fromkeys(p for pieces in cut for p in pieces) if p not in known]
            known.update(zip(new, whole(new), strict=True))
            return [sum(map(known.__getitem__, pieces)) for pieces in cut]

        count = by_piece if apart else whole
    _TOKENIZERS[path] = count
    return count


def normal_form(path: str):
    """A column function that gives texts of equal count one form, as far as the tokenizer's own normaliser allows.

    Where that lower-cases and no token spans blanks, ASCII texts are lower-cased and blanks at the
    ends of all texts are dropped; an ASCII text with an added token's string in any case stays as it
    is, as the library looks for those first. For other tokenizers every text is its own form. Null is empty.
    """
    own = lambda text: F.coalesce(text, F.lit(""))
    if not path.endswith(".json"):
        return own
    with open(path) as f:
        spec = json.load(f)
    if not _splits_at_blanks(spec) or not any(n.get("type") == "Lowercase" for n in spec["normalizer"]["normalizers"]):
        return own
    added = [t["content"].lower() for t in spec.get("added_tokens", [])]

    def form(text: Column) -> Column:
        t = own(text)
        low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(t)
        special = reduce(lambda a, b: a | b, [low.contains(a) for a in added], F.lit(False))
        return F.when(special, t).otherwise(F.trim(low, F.lit(" \t\n\x0b\f\r")))

    return form


def content_digest(content: Column) -> Column:
    """SHA-256 of a content in UTF-8."""
    return F.unhex(F.sha2(content.cast("binary"), 256))


def count_tokens(df: DataFrame, path: str, cache_path: str, text: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """df with n_bytes, n_tokens; appends counts of texts not yet in the Parquet cache at cache_path.

    Null texts count as empty (0 bytes, 0 tokens). Texts of one normal form are encoded once and their
    rows share the stored count. Digests meet the cache first: where it has all of them, no text is
    shuffled, and else only those of the misses are. Columns of df named n_bytes or n_tokens are
    replaced; repeated rows count alike; an empty table gives no rows. A task that is run again gives
    the same counts; a count that two runs append twice is read once.
    """
    spark, version, form = df.sparkSession, tokenizer_digest(path), normal_form(path)
    body, rest = F.col(text).cast("string"), columns_of(df, "n_bytes", "n_tokens")
    df = df.select(row_without(df, "n_bytes", "n_tokens").alias("row"), body.alias("text"), content_digest(form(body)).alias("digest"))

    def cache() -> DataFrame:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(cache_path)
        there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        kept = spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if there else spark.createDataFrame([], CACHE_SCHEMA)
        return kept.where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            got, start, held, many = [], 0, 0, texts(batch, "_text")
            for i, t in enumerate(many):
                held += len(t)
                if held >= batch_bytes or i == len(many) - 1:
                    got += count(many[start : i + 1])
                    start, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(got), pa.string()), pa.array(got, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    digests = stored(df.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digests")
    misses = digests.join(cache(), F.col("digest") == F.col("content_digest"), "left_anti").select("digest")
    missing = misses.count()
    if missing:
        # all rows of a first run are misses, and need no look-up among them
        rows = df if missing == digests.count() else df.join(misses, "digest", "left_semi")
        texts_ = rows.groupBy("digest").agg(F.first(F.coalesce("text", F.lit(""))).alias("_text"))
        texts_.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = stored(digests.join(cache(), F.col("digest") == F.col("content_digest")).select("digest", "n", "n_tokens"), "counts")
    rows = df.select("row", "digest", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return lookup(rows, counts, "digest", "n").select(*rest, "n_bytes", "n_tokens")


def op10_token_counts(spark, sf_dir):
    """From an empty cache, so that a run's figures do not hang on the runs before it."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), shared_folder(spark, "token-counts"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
