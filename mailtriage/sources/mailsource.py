"""A data source of message files: spark.read.format("mail"), and a sink that writes them.

One row a file: path, name, size, content, error. A file that can't be read, is empty, is over
maxMessageBytes, or is an Outlook file has an error and no content; it never fails its task. Files are
dealt to partitions in path order by their bytes, small ones together. The planner lists the folder once;
tasks open files where they run, so paths are URIs that Arrow's file systems know (file, s3, gs, hdfs).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import batches as B

SCHEMA = "path string, name string, size long, content binary, error string"
ENDINGS = "eml,txt"
PARTITION_BYTES, MESSAGE_BYTES = 64 << 20, 256 << 20
#: What a file costs besides its bytes, and the rows and bytes of a batch.
OPEN_BYTES, BATCH_ROWS, BATCH_BYTES = 64 << 10, 256, 4 << 20
#: Schemes that tasks can open by themselves.
SCHEMES = ("", "file", "s3", "s3a", "gs", "gcs", "hdfs")
_OLE = bytes.fromhex("D0CF11E0A1B11AE1")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path inside it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 'gcs': 'gs'}.get(scheme, scheme) }:{rest}")


@dataclass
class _Share(InputPartition):
    """Files of one partition: (path, size)."""

    files: list[tuple[str, int]]


def shares(files: list[tuple[str, int]], most: int) -> list[_Share]:
    """Files in order in shares of `most` bytes, of one file at least."""
    out: list[_Share] = []
    room = 0
    for path, size in files:
        if not out or size + OPEN_BYTES > room:
            out.append(_Share([]))
            room = most
        out[-1].files.append((path, size))
        room -= size + OPEN_BYTES
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("the mail source needs a path")
        self.uri = options["path"]
        self.endings = tuple("." + e.strip().lower() for e in options.get("endings", ENDINGS).split(","))
        self.share_bytes = int(options.get("maxPartitionBytes", PARTITION_BYTES))
        self.most = int(options.get("maxMessageBytes", MESSAGE_BYTES))

    def partitions(self) -> list[_Share]:
        system, path = opened(self.uri)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"no such folder: {self.uri}")
        found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file]
        named = [(f.path, f.size or 0) for f in found if f.path.lower().endswith(self.endings) and not f.base_name.startswith((".", "_"))]
        return shares(sorted(named), self.share_bytes) or [_Share([])]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.uri)
        rows: list[tuple] = []
        held = 0
        for path, size in partition.files:
            content, error = _content(system, path, size, self.most)
            rows.append((path, path.rpartition("/")[2], size, content, error))
            held += len(content or b"")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _content(system: fs.FileSystem, path: str, size: int, most: int) -> tuple[bytes | None, str | None]:
    if size > most:
        return None, f"larger than {most} bytes"
    try:
        with system.open_input_stream(path) as stream:
            content = stream.read()
    except OSError as e:
        return None, f"unreadable: {type(e).__name__}"
    if not content.strip():
        return None, "empty"
    return (None, "Outlook file") if content.startswith(_OLE) else (content, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "name", "size", "content", "error"])


class _Writer(DataSourceArrowWriter):
    """Writes each row's content as a file. A file appears whole, by a rename; a task that runs again
    writes the same names. Rows are taken from their batch a slice at a time."""

    def __init__(self, options: dict, fields: list[str]):
        if not options.get("path"):
            raise ValueError("the mail sink needs a path")
        if not {"name", "content"} <= set(fields):
            raise ValueError("the mail sink needs columns name and content")
        self.uri = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = opened(self.uri)
        system.create_dir(folder, recursive=True)
        for batch in (part for whole in batches for part in B.slices(whole)):
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"no name for a message file: {name!r}")
                waiting = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(waiting) as stream:
                    stream.write(bytes(content or b""))
                system.move(waiting, f"{folder}/{name}")
        return WriterCommitMessage()


class MailSource(DataSource):
    """Options: path, endings (eml,txt), maxPartitionBytes, maxMessageBytes."""

    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("the mail sink appends: files of other names stay")
        return _Writer(self.options, schema.fieldNames())


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The message files below a path. Stores that only Spark opens are read as binary files, with the
    same columns; there a file that can't be read fails the job."""
    scheme = path.partition(":")[0] if ":" in path else ""
    if scheme in SCHEMES:
        spark.dataSource.register(MailSource)
        return spark.read.format("mail").options(**options).load(path)
    endings = options.get("endings", ENDINGS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + endings + "}").option("recursiveFileLookup", "true").load(path)
    most = int(options.get("maxMessageBytes", MESSAGE_BYTES))
    blank = ~F.coalesce(F.make_valid_utf8(F.col("content").cast("string")).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    error = F.when(F.col("length") > most, f"larger than {most} bytes").when(blank, "empty").when(F.startswith(F.col("content"), F.lit(_OLE)), "Outlook file")
    rows = files.withColumn("error", error)
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error")


def write(messages: DataFrame, path: str) -> None:
    """Writes messages (name, content) as files below a path, a file each."""
    messages.sparkSession.dataSource.register(MailSource)
    messages.select("name", "content").write.format("mail").mode("append").save(path)
