"""WARC archives compressed by Zstandard with a shared dictionary, one frame per record.

An archive begins with a skippable frame that holds the dictionary; each record is a frame of its
own. Spark's text writer puts archives to any store that Spark writes to: its line separator is an
empty skippable frame, which readers of Zstandard pass over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, shared_folder, stored, table

#: Fixed values of the formats: the magic number of the dictionary's frame and that of a Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: An empty skippable frame, all ASCII, as the text writer's line separator.
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of a row that the writer gets, rows of a file, pages and bytes of each that train the dictionary, its size.
BLOCK, ROWS_PER_FILE, SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 65, 500, 1 << 14, 1 << 16


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has the HTTP head but not the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{f'urn:page:{page_id}' if page_id is not None else f'urn:sha1:{payload_digest(payload)}'}>", f"WARC-Date: {DATE}", "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url), f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines[3:3] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; `error` tells what is wrong with its headers, lengths or digest."""
    out = dict.fromkeys(("page_id", "target_uri", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "error"))
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    names = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
    wanted = ("warc-type", "warc-record-id", "warc-date", "content-length")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return out | {"error": "no WARC version or end of headers"}
    if missing := [k for k in wanted if k not in names]:
        return out | {"error": f"no {missing[0]}"}
    if not names["content-length"].isdigit() or len(rest) != int(names["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        return out | {"error": "content-length does not fit the frame"}
    page = lambda k: int(names[k][10:-1]) if names.get(k, "").startswith("<urn:page:") else None
    out |= {"page_id": page("warc-record-id"), "target_uri": names.get("warc-target-uri"), "record_type": names["warc-type"], "refers_to": page("warc-refers-to"), "payload_digest": names.get("warc-payload-digest", "").removeprefix("sha1:")}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    length = [v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.lower() == b"content-length"]
    if not gap or not length or not length[0].isdigit():
        return out | {"error": "no HTTP length"}
    out["payload_bytes"] = int(length[0])
    if out["record_type"] == "response":
        out["payload"] = payload
        if len(payload) != out["payload_bytes"]:
            out["error"] = "the payload's length differs"
        elif payload_digest(payload) != out["payload_digest"]:
            out["error"] = "the payload's digest differs"
    elif payload:
        out["error"] = "a revisit with a payload"
    return out


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, from its block headers."""
    params = zstandard.get_frame_parameters(bytes(data[at : at + 18]))
    i = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        if i + 3 > len(data):
            raise ValueError("a frame is cut short")
        block = int.from_bytes(data[i : i + 3], "little")
        i += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
        if block & 1:
            return i + 4 * params.has_checksum


def frames(data: memoryview) -> Iterator[bytes]:
    """The records of an archive: each frame decoded with the dictionary of the leading skippable frame."""
    at, dictionary = 0, None
    plain = zstandard.ZstdDecompressor()
    decoder = plain
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("a frame is cut short")
        magic, size = struct.unpack("<II", data[at : at + 8])
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC and at == 0:
                dictionary = bytes(data[8 : 8 + size])
                if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
                    dictionary = plain.decompress(dictionary)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = _frame_end(data, at)
            if end > len(data):
                raise ValueError("a frame is cut short")
            yield decoder.decompressobj().decompress(bytes(data[at:end]))
            at = end
        else:
            raise ValueError(f"no frame begins at {at}")


def train_dictionary(pages: DataFrame, key: str = "page_id", payload: str = "html") -> bytes:
    """A dictionary from the first SAMPLE_BYTES of SAMPLE pages, those with the least hash of their id.

    Empty where there are too few pages to train one.
    """
    few = pages.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE).distinct()
    rows = pages.join(F.broadcast(few), key, "left_semi").select(key, F.substring(payload, 1, SAMPLE_BYTES // 4).alias("t")).orderBy(key, "t").limit(SAMPLE).collect()
    samples = [r.t.encode() for r in rows if r.t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too little text
        return b""


def find_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows (key, digest, refers_to): pages whose payload, of this SHA-1, equals that of a page with a smaller id.

    A null payload counts as empty; a null key refers to the smallest and is referred to by none; a
    page that is there twice with one payload is one row, with two payloads each has its own. No pages
    give no rows. Only digests are shuffled.
    """
    text = F.coalesce(F.col(payload), F.lit(""))
    narrow = stored(pages.where(F.octet_length(text) >= least_bytes).select(F.col(key).alias("key"), F.unhex(F.sha1(text.cast("binary"))).alias("digest")), "payload-digests")
    first = narrow.groupBy("digest").agg(F.min("key").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    found = lookup(narrow, first, "digest", "n").where(F.col("key").isNull() | (F.col("key") > F.col("refers_to")))
    return found.select(F.col("key").alias(key), "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, level: int = 3) -> None:
    """Write a record per row; those of rows with a null key have ids of their own that name no page.

    A null payload or URL counts as empty. Of equal payloads of at least `least_bytes`, that with the
    smallest key is a response (each of its rows, if the table repeats it) and the others revisits.
    Files hold at most ROWS_PER_FILE rows of about BLOCK bytes, and one record more, and each begins
    with the dictionary.
    """
    pages = pages.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(url), F.lit("")).alias("u"), F.coalesce(F.col(payload), F.lit("")).alias("p"))
    dictionary = train_dictionary(pages, "k", "p")
    revisits = stored(find_revisits(pages, "k", "p", least_bytes), "revisits").withColumnRenamed("k", "own")
    same = pages["k"].eqNullSafe(revisits["own"]) & (F.unhex(F.sha1(pages["p"].cast("binary"))) == revisits["digest"])
    rows = pages.join(revisits, same, "left").select("k", "u", "p", "refers_to")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        c, sent, held = zstandard.ZstdCompressor(level=level, write_checksum=True, **options), 0, b""
        lead = dictionary_frame(dictionary) if dictionary else b""

        def row(block: bytes) -> pa.RecordBatch:
            nonlocal sent
            sent += 1
            return pa.RecordBatch.from_arrays([pa.array([lead + block if sent % ROWS_PER_FILE == 1 else block], pa.binary())], names=["value"])

        for b in batches:
            for k, u, p, to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                held += c.compress(record(k, u, p, to))
                if len(held) >= BLOCK:
                    yield row(held)
                    held = b""
        if held:
            yield row(held)

    out = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record: page_id, target_uri, record_type, refers_to, payload_digest, payload_bytes,
    payload (null unless asked for, and of revisits) and error (null where all is valid).

    A frame that cannot be decoded gives a last row with its error. An empty archive has no records.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                try:
                    for one in frames(memoryview(data.as_buffer())):
                        r = parse_record(one)
                        rows.append(r if payloads else r | {"payload": None})
                        size += len(one)
                        if size > BLOCK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    rows.append(dict.fromkeys(schema.names) | {"error": str(e)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, target_uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, error string")


def op7_warc(spark, sf_dir):
    path = shared_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    back = read_archives(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


#: Base32 in SQL: the digest's 160 bits in groups of five.
_B32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(bits, 1 + 5 * i, 1) AS INT) * 16 + CAST(substr(bits, 2 + 5 * i, 1) AS INT) * 8 + CAST(substr(bits, 3 + 5 * i, 1) AS INT) * 4 + CAST(substr(bits, 4 + 5 * i, 1) AS INT) * 2 + CAST(substr(bits, 5 + 5 * i, 1) AS INT), 1)), '')"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: substr(bin(CAST('0x1' || substr(hex, 1 + i, 1) AS BIGINT)), 2, 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM b"""
