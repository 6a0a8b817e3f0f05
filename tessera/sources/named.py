"""Documents as files named by their ids: a data source whose tasks write the files and whose driver commits.

    spark.dataSource.register(NamedDocuments)
    docs.write.format("named_documents").mode("append").save(path)

Rows are (id, text). In the nested layout a file is `<first character>/<second>/<id>.json`, in the flat
one `<id>-<suffix>.json`. Paths are those of pyarrow's file systems: local and shared folders, HDFS and
object stores. They are listed folder by folder in tasks, which read them too: neither the driver nor
Spark's file index holds all names, and no task is made for each few files.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "named_documents"
#: Bytes of documents that a task reads before it passes them on, and names that it lists before.
BATCH_BYTES, BATCH_NAMES = 16_000_000, 10_000


def tasks(spark: SparkSession) -> int:
    """Parts over which files are dealt by number: their bytes, by which Spark would join parts, are few."""
    return max(64, 4 * spark.sparkContext.defaultParallelism)


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else os.path.abspath(path))


def _inside(fs: pyarrow.fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what a folder has; as for Spark, names that begin with a dot or `_` are hidden."""
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with os.scandir(folder) as found:
            yield from ((e.name, e.is_dir()) for e in found if e.name[0] not in "._")
    else:
        yield from ((f.base_name, f.type == pyarrow.fs.FileType.Directory) for f in fs.get_file_info(pyarrow.fs.FileSelector(folder)) if f.base_name[0] not in "._")


def listed(spark: SparkSession, path: str, pattern: str, deep: bool) -> DataFrame:
    """Rows (folder, name) of the files below path whose names match a pattern of SQL's rlike, as they are now.

    Folders are relative to path. With `deep` those of each level are dealt over the tasks, which list
    them; else only path itself is listed, by one task, which passes names on as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(path)
        for b in batches:
            for folder in b.column(0).to_pylist():
                rows = []
                for name, below in _inside(fs, f"{base}/{folder}".rstrip("/") or "/"):
                    rows.append((folder, name, below))
                    if len(rows) >= BATCH_NAMES:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["folder", "name", "below"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["folder", "name", "below"])

    from tessera.operators.ordinal import checkpointed

    front, out = spark.createDataFrame([("",)], "folder string").coalesce(1), None
    while True:
        rows = front.mapInArrow(run, "folder string, name string, below boolean")
        rows = checkpointed(rows.where(F.col("name").rlike(pattern) | (F.col("below") & F.lit(deep))))
        files = rows.where("not below").select("folder", "name")
        out = files if out is None else out.unionByName(files)
        front = rows.where("below").select(F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), "name").alias("folder"))
        if not deep or front.isEmpty():
            return out
        front = front.repartition(tasks(spark))


def _texts(id: str, data: bytes) -> list[str | None]:
    """The JSON objects of a file as Spark reads them: none for a blank file, those of an array, null for what is no text."""
    try:
        text = data.decode(json.detect_encoding(data))
        if text.lstrip()[:1] != "[":
            return [text] if text.strip() else []
        found = [json.dumps(x) for x in json.loads(text)]
    except ValueError:
        return [None]
    if len(found) > 1:
        raise RuntimeError(f"twice: {id}")
    return found


def read_named(spark: SparkSession, path: str, schema: str, legacy: bool = False) -> DataFrame:
    """Rows (id, document) of the files below path, or in it if legacy: documents of the given schema.

    The id is the file's name, before the first `-` if legacy; one that two files have fails the job.
    Files are dealt over the tasks by their ids and read once.
    """
    names = listed(spark, path, r"(?s)^.*-.*\.json$" if legacy else r"(?s)^.*\.json$", not legacy)
    name = F.regexp_replace("name", r"\.json$", "")
    files = names.select((F.substring_index(name, "-", 1) if legacy else name).alias("id"), F.struct("folder", "name").alias("file"))
    one = files.repartition(tasks(spark), "id").groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.first("file").alias("file"))
    safe = F.when(F.col("_n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("twice: "), F.col("id"))).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(path)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        ids, texts, size = [], [], 0
        for b in batches:
            for id, folder, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = f"{base}/{folder}/{name}" if folder else f"{base}/{name}"
                with open(at, "rb") if local else fs.open_input_stream(at) as f:
                    data = f.read()
                for text in _texts(id, data):
                    ids.append(id)
                    texts.append(text)
                size += len(data)
                if size >= BATCH_BYTES or len(ids) >= BATCH_NAMES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["id", "text"])
                    ids, texts, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["id", "text"])

    texts = one.select(safe.alias("id"), "file.folder", "file.name").mapInArrow(run, "id string, text string")
    return texts.select("id", F.from_json("text", schema).alias("document"))


@dataclass
class Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str | None):
        self.path, self.suffix = path, suffix

    def place(self, id: str) -> tuple[str, str]:
        """Folder and name of a document's file."""
        if self.suffix is not None:
            return "", f"{id}-{self.suffix}.json"
        return f"{id[:1]}/{id[1:2]}".rstrip("/"), f"{id}.json"

    def write(self, rows: Iterator[Row]) -> Written:
        """Each file is written in a folder of the task and moved to its place, so that a task that is run again leaves whole files.

        Tasks thus do not wait for each other to make files in one folder.
        """
        fs, base = _file_system(self.path)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        own = f"{base}/.{uuid.uuid4().hex}"
        part, made, files = f"{own}/part", set(), 0
        fs.create_dir(own, recursive=True)
        try:
            for id, text in rows:
                if not id or "/" in id:
                    raise ValueError(f"no file can be named {id!r}")
                folder, name = self.place(id)
                at = f"{base}/{folder}".rstrip("/")
                if at not in made:
                    fs.create_dir(at, recursive=True)
                    made.add(at)
                with open(part, "wb") if local else fs.open_output_stream(part) as out:
                    out.write(text.encode())
                if local:
                    os.replace(part, f"{at}/{name}")
                else:
                    fs.move(part, f"{at}/{name}")
                files += 1
        finally:
            fs.delete_dir(own)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """The number of files, in a file that marks the folder as whole."""
        fs, base = _file_system(self.path)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files stay without the mark; writing again replaces them."""


class NamedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "id string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("suffix"))


def write_named(docs: DataFrame, path: str, suffix: str | None = None, id: str = "id", document: str = "document") -> None:
    """Write each document (a struct) as JSON to the file of its id; an id that two rows have fails the job.

    With `suffix` the layout is flat. Null ids, and ids that name no file, fail the job. No rows leave
    an empty folder, marked as whole.
    """
    spark = docs.sparkSession
    spark.dataSource.register(NamedDocuments)
    one = docs.repartition(tasks(spark), id).groupBy(id).agg(F.count(F.lit(1)).alias("_n"), F.first(F.to_json(document)).alias("text"))
    safe = F.when(F.col("_n") == 1, F.col(id)).otherwise(F.raise_error(F.concat(F.lit("twice: "), F.coalesce(F.col(id), F.lit("null")))).cast("string"))
    writer = one.select(safe.alias("id"), "text").write.format(FORMAT).mode("append")
    (writer if suffix is None else writer.option("suffix", suffix)).save(path)
