"""A Spark data source for document files: what a parser finds in them, one row per item; and a sink that writes rows as files.

    register(spark)
    spark.read.format("document_items").schema("filename string, status string, page int, text string")
        .option("parser", "package.module:function").load(folder)

A partition is a group of files of about `bytesPerPartition` bytes; files are opened where they are parsed, through any file system that Arrow
knows. The parser is named, not sent: it takes a file's bytes and the names of the columns asked for, and gives a dict per item; what was not asked for it
need not make, such as rendered pages. So a narrower schema is a cheaper read. Conditions on `filename` (equal, in) leave other files unopened.
A file that the parser refuses gives one row, with the kind of its error in `status`; one without items a row with `empty`.
"""

from __future__ import annotations

import importlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, SINK = "document_items", "document_files"
GROUP_BYTES = 16 * 2**20
#: A file counts as so many bytes more, so that many small ones make groups too.
OPEN_BYTES = 64 * 2**10
#: Bytes of files, and items, whose rows become an Arrow batch.
HELD_BYTES, HELD_ROWS = 2**20, 1000


def file_system(path: str):
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class FileGroup(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ItemReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.parser = options["path"], options["parser"]
        self.group = int(options.get("bytesPerPartition", GROUP_BYTES))
        self.schema, self.names = schema, [f.name for f in schema.fields]
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) else (set(f.value) if isinstance(f, In) else None)
            if named is not None and f.attribute == ("filename",):
                self.only = named if self.only is None else self.only & named
            else:
                yield f

    def partitions(self) -> list[FileGroup]:
        from pyarrow import fs

        where, root = file_system(self.path)
        info = where.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=True))
        groups, size = [[]], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if self.only is not None and f.base_name not in self.only:
                continue
            if groups[-1] and size + f.size + OPEN_BYTES > self.group:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size + OPEN_BYTES
        return [FileGroup(g) for g in groups if g] or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator:
        """Arrow batches of some rows, made column by column; about HELD_BYTES of files to a batch."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, held, size = to_arrow_schema(self.schema), [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(kinds)], schema=kinds)

        for length, rows in self._parsed(partition):
            held += rows
            size += length
            if size >= HELD_BYTES or len(held) >= HELD_ROWS:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    def _parsed(self, partition: FileGroup) -> Iterator[tuple[int, list[tuple]]]:
        """The size of each file, and its rows."""
        module, _, function = self.parser.partition(":")
        parse = getattr(importlib.import_module(module), function)
        where, _ = file_system(self.path)
        for path in partition.paths:
            with where.open_input_stream(path) as f:
                data = f.read()
            known = {"filename": os.path.basename(path), "path": path, "size": len(data)}
            try:
                rows = [tuple((known | {"status": "ok"} | item).get(n) for n in self.names) for item in parse(data, set(self.names))]
                rows = rows or [tuple((known | {"status": "empty"}).get(n) for n in self.names)]
            except Exception as e:  # the parser refuses the file, whatever it found before
                rows = [tuple((known | {"status": type(e).__name__}).get(n) for n in self.names)]
            yield len(data), rows


class DocumentItems(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "filename string, status string"

    def reader(self, schema: StructType) -> ItemReader:
        return ItemReader(self.options, schema)


class FileWriter(DataSourceWriter):
    """Rows (filename, content) as files. A file appears whole, by renaming; a task that is tried again writes the same files."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        where, root = file_system(self.path)
        where.create_dir(root, recursive=True)
        for row in iterator:
            temp = f"{root}/.{uuid.uuid4().hex}"
            with where.open_output_stream(temp) as f:
                f.write(bytes(row["content"]))
            where.move(temp, f"{root}/{os.path.basename(row['filename'])}")
        return WriterCommitMessage()


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return SINK

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make both known to a session, which may hand conditions to Python sources from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentItems)
    spark.dataSource.register(DocumentFiles)


def read_items(spark: SparkSession, path: str, parser: str, schema: str, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Items of the files of a folder in the columns of `schema`."""
    register(spark)
    return spark.read.format(FORMAT).schema(schema).option("parser", parser).option("bytesPerPartition", group_bytes).load(path)


def write_files(files: DataFrame, path: str) -> None:
    """Write rows (filename, content) as files of a folder."""
    register(files.sparkSession)
    files.select("filename", "content").write.format(SINK).mode("append").save(path)
