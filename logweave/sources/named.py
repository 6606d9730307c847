"""Sinks that name the files they write: rows (path, text) or the lines of paths become files below a root.

Spark's own writers choose file names; a tree of sources or seed files needs
given ones.  Every task writes its rows' files itself (below a name that no
reader takes, then renamed), so a repeated task replaces its own files and no
text passes through the driver.  File systems are those that pyarrow opens.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from logweave.sources.listing import file_system, split_uri


@dataclass
class Written(WriterCommitMessage):
    files: int


#: Folders that a task remembers to have made.
FOLDERS_KEPT = 10_000


class Folder:
    """The folder that one task writes into, a file after the other; a file has its name once it is whole."""
    def __init__(self, root: str):
        scheme, self.root = split_uri(root)
        self.system, self.begin = file_system(scheme)
        self.out, self.made, self.files = None, set(), 0

    def open(self, name: str) -> None:
        self.close()
        path = posixpath.normpath(posixpath.join(self.root, name))
        if not path.startswith(self.root.rstrip("/") + "/"):
            raise ValueError(f"{name} is not below {self.root}")
        self.path = self.begin + path
        folder, last = posixpath.split(self.path)
        if folder not in self.made:
            self.system.create_dir(folder, recursive=True)
            if len(self.made) >= FOLDERS_KEPT:
                self.made.clear()
            self.made.add(folder)
        self.aside = posixpath.join(folder, f".{last}._COPYING_")
        self.out = self.system.open_output_stream(self.aside, compression=None)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.system.move(self.aside, self.path)
            self.out, self.files = None, self.files + 1


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        folder = Folder(self.root)
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").cast(pa.binary())):
                folder.open(path)
                folder.out.write(text.as_buffer() or b"")
        folder.close()
        return Written(folder.files)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


class NamedLinesWriter(DataSourceArrowWriter):
    """Lines of one path follow each other; what a batch holds of a file is written at once."""
    def __init__(self, root: str):
        self.root = root

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        folder, last = Folder(self.root), None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column("path"))
            at = 0
            for path, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if path != last:
                    folder.open(path)
                    last = path
                folder.out.write("".join(f"{line or ''}\n" for line in batch.column("text").slice(at, end - at).to_pylist()).encode())
                at = end
        folder.close()
        return Written(folder.files)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["root"])


def write_named_files(files: DataFrame, root: str) -> None:
    """Write ``files(path, text)``: one file per row below ``root``; a null text is an empty file.  Paths must be distinct.
    A partition's files are written by one task, one after the other: many small files need many partitions, and those of a
    folder are best in one."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("path", "text").write.format("named_files").mode("append").option("root", root).save()


class NamedLines(NamedFiles):
    @classmethod
    def name(cls) -> str:
        return "named_lines"

    def writer(self, schema: StructType, overwrite: bool) -> NamedLinesWriter:
        return NamedLinesWriter(self.options["root"])


def write_named_lines(lines: DataFrame, root: str) -> None:
    """Write ``lines(path, line_number, value)``: one file per path below ``root``, its lines in the order of their numbers,
    each with a line feed; a null value is an empty line.  A file is written by one task, as a stream."""
    lines.sparkSession.dataSource.register(NamedLines)
    (lines.repartition("path").sortWithinPartitions("path", "line_number").select("path", F.col("value").alias("text"))
     .write.format("named_lines").mode("append").option("root", root).save())
