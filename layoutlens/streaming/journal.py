"""Journals of events that are appended to, as a streaming source, and a sink that a batch enters whole and once.

`journal` reads a folder of files with a JSON row on each line that other programs go on writing to (Spark's own file source takes whole
files only). An offset is how many bytes of complete lines each file has; a batch is byte ranges, split at PART_BYTES, so it can be read again after a
failure and gives the same rows. `committed` writes rows as Parquet parts that no reader sees before the batch's one record names
them; a batch that is written again finds its record and adds nothing. Paths may be of any file system that Arrow knows; both must be
reachable from driver and executors.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PART_BYTES, BLOCK = 16_000_000, 1 << 16
RECORDS = "_batches"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _names(files: fs.FileSystem, folder: str, ending: str) -> list[fs.FileInfo]:
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name.endswith(ending)), key=lambda f: f.base_name)


class Journal(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        raise ValueError("a journal's schema must be given")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return JournalReader(self.options["path"], schema)


class Range(InputPartition):
    def __init__(self, name: str, start: int, end: int, first: int) -> None:
        self.name, self.start, self.end, self.first = name, start, end, first


class JournalReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Bytes of each file up to its last line's end; a line that is still being written waits."""
        files, folder = _opened(self.path)
        return {f.base_name: end for f in _names(files, folder, ".jsonl") if (end := self._lines_end(files, f))}

    @staticmethod
    def _lines_end(files: fs.FileSystem, info: fs.FileInfo) -> int:
        with files.open_input_file(info.path) as data:
            at = info.size
            while at > 0:
                start = max(0, at - BLOCK)
                data.seek(start)
                if (last := data.read(at - start).rfind(b"\n")) >= 0:
                    return start + last + 1
                at = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        found = []
        for name, size in sorted(end.items()):
            first = start.get(name, 0)
            found += [Range(name, a, min(a + PART_BYTES, size), first) for a in range(first, size, PART_BYTES)]
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the range: a line belongs to the range of its first byte."""
        files, folder = _opened(self.path)
        schema = to_arrow_schema(self.schema)
        with files.open_input_file(f"{folder.rstrip('/')}/{partition.name}") as raw:
            data, at = io.BufferedReader(raw, BLOCK), partition.start
            if at > partition.first:
                # The line that the byte before belongs to is the range before's.
                data.seek(at - 1)
                at += len(data.readline()) - 1
            data.seek(at)
            rows = []
            while at < partition.end and (line := data.readline()):
                at += len(line)
                if line.strip():
                    rows.append(json.loads(line))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def schema(self) -> str:
        raise ValueError("this is a sink")

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return CommittedWriter(self.options["path"], schema)


class Part(WriterCommitMessage):
    def __init__(self, name: str | None) -> None:
        self.name = name


class CommittedWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, folder = _opened(self.path)
        files.create_dir(folder, recursive=True)
        writer, name = None, f"part-{uuid.uuid4().hex}.parquet"
        for batch in iterator:
            if batch.num_rows:
                writer = writer or pq.ParquetWriter(f"{folder.rstrip('/')}/{name}", batch.schema, filesystem=files)
                writer.write_batch(batch)
        if writer:
            writer.close()
        return Part(name if writer else None)

    def _delete(self, files: fs.FileSystem, folder: str, messages: list) -> None:
        for m in messages:
            if m is not None and m.name:
                files.delete_file(f"{folder}/{m.name}")

    def commit(self, messages: list, batchId: int) -> None:
        files, folder = _opened(self.path)
        folder = folder.rstrip("/")
        record = f"{folder}/{RECORDS}/{batchId:012d}.json"
        if files.get_file_info(record).type == fs.FileType.File:
            # It came through before the query had noted that it did.
            self._delete(files, folder, messages)
            return
        files.create_dir(f"{folder}/{RECORDS}", recursive=True)
        draft = f"{folder}/{RECORDS}/{uuid.uuid4().hex}.draft"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps([m.name for m in messages if m is not None and m.name]).encode())
        files.move(draft, record)

    def abort(self, messages: list, batchId: int) -> None:
        files, folder = _opened(self.path)
        self._delete(files, folder.rstrip("/"), messages)


def committed_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that came through; parts of others, whole or broken, are not read."""
    files, folder = _opened(path)
    folder, names = folder.rstrip("/"), []
    for record in _names(files, f"{folder}/{RECORDS}", ".json"):
        with files.open_input_file(record.path) as data:
            names += json.loads(data.read())
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{name}" for name in names])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Journal)
    spark.dataSource.register(Committed)
