"""Data source of a folder of small text files: every file is a row, empty ones too.

Spark's own file sources leave out files without a byte. The folder is listed once, when the read is planned, and
files are dealt out to partitions by their size. Paths are local (on a cluster: mounted everywhere) or of a
file system that Arrow knows by its URI.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = "small_files"
PARTITION_BYTES, PARTITION_FILES = 32 << 20, 10_000
FILE_BYTES = 4 << 10  # what opening a file counts for
BATCH_BYTES = 4 << 20


@dataclass
class Files(InputPartition):
    paths: Sequence[str]


class SmallFiles(DataSource):
    """Rows ``(name, text)``; options ``extensions`` (separated by commas, all if empty) and ``content`` (false: text is null)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SmallFilesReader(dict(self.options))


class SmallFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.extensions = [e for e in options.get("extensions", "").split(",") if e]
        self.content = options.get("content", "true").lower() == "true"

    def _system(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            uri = self.path if "://" in self.path else "file://" + self.path[len("file:") :]
            return fs.FileSystem.from_uri(uri)
        return fs.LocalFileSystem(), self.path

    def _wanted(self, name: str) -> bool:
        parts = name.split(".")
        return not self.extensions or (len(parts) > 1 and parts[1] in self.extensions)

    def partitions(self) -> Sequence[Files]:
        system, root = self._system()
        found = system.get_file_info(fs.FileSelector(root))
        files = sorted((f.path, f.size or 0) for f in found if f.is_file and self._wanted(f.base_name))
        parts: list[list[str]] = []
        size = 0
        for path, bytes_ in files:
            cost = FILE_BYTES + (bytes_ if self.content else 0)
            if not parts or size + cost > PARTITION_BYTES or len(parts[-1]) >= PARTITION_FILES:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += cost
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        names, texts, size = [], [], 0
        for path in partition.paths:
            names.append(path.rsplit("/", 1)[-1])
            texts.append(None)
            if self.content:
                with system.open_input_stream(path) as stream:
                    texts[-1] = stream.read().decode("utf-8", "replace")
                size += len(texts[-1])
            if size > BATCH_BYTES:
                yield _batch(names, texts)
                names, texts, size = [], [], 0
        yield _batch(names, texts)


def _batch(names: list[str], texts: list[str | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["name", "text"])


def read_small_files(spark: SparkSession, folder: str, *extensions: str, content: bool = True):
    """``(name, text)`` of the files of a folder whose name has one of ``extensions`` behind its first dot."""
    spark.dataSource.register(SmallFiles)
    options = {"extensions": ",".join(extensions), "content": str(content).lower()}
    return spark.read.format(NAME).options(**options).load(folder)
