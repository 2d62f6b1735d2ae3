"""Files as rows: a reader of the first bytes of each file, a sink of one object for each name, and packs of small files.

Paths are those of any file system that pyarrow knows; a path without a scheme is local. Files and
folders whose names begin with a dot or an underscore are not read, as in Spark's own sources.
Folders without files, and tables without rows, give no rows and no files.
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

#: Bytes of contents in one Arrow batch of a reader.
BATCH = 4 << 20


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    local = path.removeprefix("file:")
    return fs.LocalFileSystem(), "/" + local.lstrip("/") if local.startswith("/") else local


def listed(path: str) -> list[fs.FileInfo]:
    """Files under a folder in the order of their paths. Names and sizes only, on the driver, as Spark's own file sources list them."""
    system, root = place(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    visible = lambda f: not any(part[0] in "._" for part in f.path[len(root) :].split("/") if part)
    return sorted((f for f in found if f.is_file and visible(f)), key=lambda f: f.path)


@dataclass
class Files(InputPartition):
    """Files of one task: path, length and time of change in microseconds."""

    rows: list[tuple[str, int, int]]


def _micros(info: fs.FileInfo) -> int:
    return (info.mtime_ns or 0) // 1000


class HeadReader(DataSourceReader):
    SCHEMA = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("head", pa.binary())])

    def __init__(self, path: str, size: int, per_task: int):
        self.path, self.size, self.per_task = path, size, per_task

    def partitions(self) -> list[Files]:
        rows = [(f.path, f.size, _micros(f)) for f in listed(self.path)]
        return [Files(rows[i : i + self.per_task]) for i in range(0, len(rows), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = place(self.path)
        rows, held = [], 0
        for path, length, modified in partition.rows:
            with system.open_input_file(path) as file:
                head = file.read_at(min(self.size, length), 0)
            rows.append((path, length, modified, head))
            held += len(head)
            if held >= BATCH:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), self.SCHEMA.types)], schema=self.SCHEMA)


class FileHeads(DataSource):
    """``file_heads``: path, length, modified and head, one row a file.

    Options: ``path`` (a folder), ``bytes`` (of each file, 65536), ``filesPerTask`` (1000). No more
    than ``bytes`` of a file are read, whatever its length.
    """

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length bigint, modified timestamp, head binary"

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options["path"], int(self.options.get("bytes", 65536)), int(self.options.get("filesPerTask", 1000)))


def heads(spark: SparkSession, path: str, size: int = 65536, per_task: int = 1000) -> DataFrame:
    """path, length, modified and the first ``size`` bytes of each file under a folder; an empty file has an empty head."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("path", path).option("bytes", size).option("filesPerTask", per_task).load()


@dataclass
class Staged(WriterCommitMessage):
    """A task attempt's folder."""

    folder: str


class NamedWriter(DataSourceArrowWriter):
    """Each attempt writes to a folder of its own; the commit names the folders that count, an abort removes them all."""

    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = place(self.staging)
        folder = f"{root}/attempt-{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content")):
                with system.open_output_stream(f"{folder}/{name.as_py()}") as file:
                    file.write(content.as_buffer() if content.is_valid else b"")
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = place(self.staging)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/manifest.part") as file:
            file.write("\n".join(m.folder for m in messages if m).encode())
        system.move(f"{root}/manifest.part", f"{root}/manifest")

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = place(self.staging)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)


class NamedFiles(DataSource):
    """``named_files``: the staging half of ``write_named`` (option ``staging``)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options["staging"])


def _publish(spark: SparkSession, path: str, staging: str) -> None:
    """Move the files of a committed write to their names, a task for each folder. What an earlier try has moved is no longer there to move, so it can run again."""
    system, root = place(staging)
    with system.open_input_stream(f"{root}/manifest") as file:
        folders = file.read().decode().split()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, target = place(path)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                    system.move(info.path, f"{target}/{info.base_name}")
            yield batch

    if folders:
        rows = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(len(folders))
        rows.mapInArrow(move, "folder string").write.format("noop").mode("overwrite").save()
    system.delete_dir(root)


def write_named(files: DataFrame, path: str, distinct: bool = False) -> None:
    """Write ``files`` (name, content, exported_at) as one object for each name in the folder ``path``.

    Of equal names the latest counts, of equally late ones the larger content; ``distinct`` promises
    that names differ and saves that shuffle. A null content is an empty file. Slashes in a name
    become underscores, and so do empty names and those of dots alone; rows with a null name are left out. Files of other
    names stay, a file of the same name is replaced.

    First all tasks write to folders of their own, then a manifest makes the write count, then its
    files are moved. A write that fails before leaves nothing (at most hidden folders of attempts
    that were still running); one that fails later is finished by
    ``recover``. An attempt that was lost or ran twice isn't in the manifest.
    """
    spark = files.sparkSession
    spark.dataSource.register(NamedFiles)
    clean = F.regexp_replace("name", "[/\\x00]", "_")
    rows = files.where("name IS NOT NULL").withColumn("name", F.when(clean.rlike(r"^\.*$"), F.concat(F.lit("_"), clean)).otherwise(clean))
    if not distinct:
        rows = rows.groupBy("name").agg(F.max_by("content", F.struct("exported_at", "content")).alias("content"))
    staging = f"{path}/.staging/{uuid.uuid4().hex}"
    rows.select("name", "content").write.format("named_files").option("staging", staging).mode("append").save()
    _publish(spark, path, staging)


def recover(spark: SparkSession, path: str) -> int:
    """Finish committed writes to ``path`` whose files weren't all moved; how many there were."""
    system, root = place(f"{path}/.staging")
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    left = sorted(f.path.rsplit("/", 1)[0] for f in found if f.base_name == "manifest")
    for staging in left:
        _publish(spark, path, f"{path}/.staging/{staging.rsplit('/', 1)[1]}")
    return len(left)


#: Bytes of contents after which a task begins another pack.
PACK = 256 << 20


def pack(files: DataFrame, path: str, most: int = PACK) -> DataFrame:
    """``files`` (name, content) put end to end into packs under the folder ``path``: name, pack, start and length of each.

    A small file of its own takes a block of disk and an entry of its folder, and its name passes the
    driver when the folder is listed; in a pack it takes its bytes. Every task attempt writes packs of its own, of about ``most``
    bytes or one content; only those of attempts that count are in what is returned, which stands as a table beside them. A
    null content is an empty file, rows with a null name are left out, equal names stay apart.
    """
    spark = files.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(f"{path}/packs")
        system.create_dir(root, recursive=True)
        file, target, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                    if file is None or at >= most:
                        if file is not None:
                            file.close()
                        target, at = f"{root}/{uuid.uuid4().hex}", 0
                        file = system.open_output_stream(target, buffer_size=1 << 20)
                    body = content.as_buffer() if content.is_valid else b""
                    file.write(body)
                    rows.append((name, target, at, len(body)))
                    at += len(body)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["name", "pack", "start", "length"])
        finally:
            if file is not None:
                file.close()

    index = files.where("name IS NOT NULL").select("name", "content").mapInArrow(write, "name string, pack string, start bigint, length bigint")
    index.write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def packed_heads(index: DataFrame, size: int = 65536) -> DataFrame:
    """name, length and the first ``size`` bytes of each file in ``pack``'s table; of longer files no more is read. Short neighbours are read at once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        try:
            for batch in batches:
                members = list(zip(*(batch.column(c).to_pylist() for c in ("pack", "start", "length"))))
                i = 0
                while i < len(members):
                    source, start, _ = members[i]
                    n, end = i, start
                    while n < len(members) and members[n][:2] == (source, end) and end - start < BATCH:
                        n, end = n + 1, end + members[n][2]
                        if members[n - 1][2] > size:
                            # nothing after a long file's head is wanted with it
                            end = members[n - 1][1] + size
                            break
                    if source != opened:
                        if file is not None:
                            file.close()
                        file, opened = place(source)[0].open_input_file(place(source)[1]), source
                    block = file.read_at(end - start, start)
                    heads = [block[at - start : at - start + min(size, length)] for _, at, length in members[i:n]]
                    part = batch.slice(i, n - i)
                    yield pa.RecordBatch.from_arrays([part.column("name"), part.column("length"), pa.array(heads, pa.binary())], ["name", "length", "head"])
                    i = n
        finally:
            if file is not None:
                file.close()

    return index.select("name", "pack", "start", "length").mapInArrow(read, "name string, length bigint, head binary")
