"""Source trees as a Spark data source, on any file system that the cluster names by URI.

Spark's own file readers hide names that start with a dot or an underscore, which source trees are
full of, so the tree is listed here. Like Spark's file index, the driver lists names and sizes, folders
side by side, and packs files into tasks by bytes; past a stated number of files the folders that are
left are listed and read by the tasks, so the driver holds a bounded list of any tree. Filters on the
path and the size are decided on the listing: folders that cannot hold a match are not opened, and
texts are read only of files that stay.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
    StringContains, StringEndsWith, StringStartsWith,
)

from siftwork.functions.paths import EXCLUDED_DIRS
from siftwork.operators.scan import MAX_FILE_BYTES

SCHEMA = "run_id string, file string, size long, text string, skipped string"
TASK_BYTES = 128 << 20
OPEN_BYTES = 64 << 10  # what opening a file counts for, in bytes
LISTED_FILES = 1_000_000  # names that the driver holds
BATCH_BYTES = 8 << 20
_LISTERS = 16

# Pushed filters on a column's value; all other filters are Spark's to apply.
_TESTS: dict[type[Filter], Callable[[Filter], Callable]] = {
    EqualTo: lambda f: lambda x: x == f.value,
    In: lambda f: frozenset(f.value).__contains__,
    LessThan: lambda f: lambda x: x < f.value,
    LessThanOrEqual: lambda f: lambda x: x <= f.value,
    GreaterThan: lambda f: lambda x: x > f.value,
    GreaterThanOrEqual: lambda f: lambda x: x >= f.value,
}
_TEXT_TESTS: dict[type[Filter], Callable[[Filter], Callable]] = {
    EqualTo: _TESTS[EqualTo],
    In: _TESTS[In],
    StringStartsWith: lambda f: lambda x: x.startswith(f.value),
    StringEndsWith: lambda f: lambda x: x.endswith(f.value),
    StringContains: lambda f: lambda x: f.value in x,
}


class _Part(InputPartition):
    """Files ``(path below the root, size)`` to read, and folders to list and read with all below them."""

    def __init__(self, files: list[tuple[str, int]], folders: list[str]) -> None:
        super().__init__(None)
        self.files, self.folders = files, folders


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        root = options["path"]
        # A path without a scheme is one of the machines' own file systems.
        self.root = root if "://" in root or root.startswith("file:") else os.path.abspath(root)
        self.run_id = options.get("run_id") or self._file_system()[1].rsplit("/", 1)[-1]
        self.wanted = int(options.get("partitions", "64"))
        self.max_bytes = int(options.get("max_bytes", str(MAX_FILE_BYTES)))
        self.listed = int(options.get("listed_files", str(LISTED_FILES)))
        extra = [d for d in options.get("excluded", "").split(",") if d]
        self.excluded = frozenset(EXCLUDED_DIRS) | frozenset(extra)
        self.filters: list[Filter] = []
        self.unskipped = False

    def _file_system(self) -> tuple[pyarrow.fs.FileSystem, str]:
        fs, at = pyarrow.fs.FileSystem.from_uri(self.root)
        return fs, at.rstrip("/") or "/"

    def _wanted(self) -> Callable[[str, int], bool]:
        paths = [_TEXT_TESTS[type(f)](f) for f in self.filters if f.attribute == ("file",)]
        sizes = [_TESTS[type(f)](f) for f in self.filters if f.attribute == ("size",)]
        if self.unskipped:
            sizes.append(lambda n: n <= self.max_bytes)
        return lambda file, size: all(t(size) for t in sizes) and all(t(file) for t in paths)

    def _may_hold(self) -> Callable[[str], bool]:
        """Whether a folder can hold a path that the filters keep."""
        asked = []
        for f in self.filters:
            if f.attribute == ("file",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                begins = f.value if isinstance(f, In) else (f.value,)
                asked.append((begins, isinstance(f, StringStartsWith)))

        def may(folder: str) -> bool:
            inside = folder + "/"
            return all(any(b.startswith(inside) or (prefix and inside.startswith(b)) for b in begins) for begins, prefix in asked)

        return may

    def _folder(self, fs: pyarrow.fs.FileSystem, root: str, below: str) -> tuple[list[tuple[str, int]], list[str]]:
        """Files and folders of one folder that are neither excluded nor filtered away. Links to folders are not followed."""
        keep, may = self._wanted(), self._may_hold()
        files, folders = [], []
        for e in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{below}" if below else root)):
            name = f"{below}/{e.base_name}" if below else e.base_name
            if e.base_name in self.excluded:
                continue
            if e.type == pyarrow.fs.FileType.Directory:
                if may(name) and not (isinstance(fs, pyarrow.fs.LocalFileSystem) and os.path.islink(e.path)):
                    folders.append(name)
            elif e.type == pyarrow.fs.FileType.File and keep(name, e.size):
                files.append((name, e.size))
        return sorted(files), sorted(folders)

    def partitions(self) -> list[InputPartition]:
        fs, root = self._file_system()
        files: list[tuple[str, int]] = []
        todo = [""]
        with ThreadPoolExecutor(_LISTERS) as pool:
            while todo and len(files) < self.listed:
                # A few folders at a time, so that the list ends soon after its limit.
                now, todo = todo[: 4 * _LISTERS], todo[4 * _LISTERS :]
                for found, folders in pool.map(lambda d: self._folder(fs, root, d), now):
                    files += found
                    todo += folders
        files.sort()
        cost = [OPEN_BYTES + (n if n <= self.max_bytes else 0) for _, n in files]
        most = min(TASK_BYTES, max(OPEN_BYTES, -(-sum(cost) // self.wanted)))
        out, held, size = [], [], 0
        for file, n in zip(files, cost):
            if held and size + n > most:
                out.append(_Part(held, []))
                held, size = [], 0
            held.append(file)
            size += n
        if held:
            out.append(_Part(held, []))
        tasks = min(len(todo), 8 * self.wanted)
        return [*out, *[_Part([], todo[i::tasks]) for i in range(tasks)]] or [_Part([], [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        fs, root = self._file_system()

        def files() -> Iterator[tuple[str, int]]:
            yield from partition.files
            todo = list(partition.folders)
            while todo:
                found, folders = self._folder(fs, root, todo.pop())
                yield from found
                todo += folders

        rows, size = [], 0
        for file, n in files():
            rows.append((self.run_id, file, n, *self._text(fs, f"{root}/{file}", n)))
            size += 200 + (n if n <= self.max_bytes else 0)
            if size > BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _text(self, fs: pyarrow.fs.FileSystem, path: str, size: int) -> tuple[str | None, str | None]:
        """Text, or why there is none. A file that cannot be opened or read fails the scan: a broken disk is not a clean tree."""
        if size > self.max_bytes:
            return None, "too large"
        with fs.open_input_stream(path, compression=None) as f:
            data = f.read()
        try:
            return data.decode("utf-8"), None
        except UnicodeDecodeError:
            return None, "not text"


class _FilteredTreeReader(_TreeReader):
    """The reader of sessions that push filters to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if (column == ("file",) and type(f) in _TEXT_TESTS) or (column == ("size",) and type(f) in _TESTS):
                self.filters.append(f)
            elif not (isinstance(f, IsNotNull) and column in (("file",), ("size",))):
                self.unskipped |= isinstance(f, IsNull) and column == ("skipped",)
                yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    run, file, size, text, skipped = zip(*rows)
    columns = [pa.array(run, pa.string()), pa.array(file, pa.string()), pa.array(size, pa.int64()), pa.array(text, pa.string()), pa.array(skipped, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["run_id", "file", "size", "text", "skipped"])


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_FilteredTreeReader if self.options.get("pushdown") == "true" else _TreeReader)(self.options)


def scan_files(
    spark: SparkSession,
    root: str,
    run_id: str | None = None,
    partitions: int | None = None,
    excluded: tuple[str, ...] = (),
    max_bytes: int = MAX_FILE_BYTES,
    listed_files: int = LISTED_FILES,
) -> DataFrame:
    """``(run_id, file, size, text, skipped)`` of the files under ``root``, a path or a URI.

    ``skipped`` says why a file has no text: it is larger than ``max_bytes`` or not UTF-8. Give those
    rows to ``scan.skipped_findings``. With ``spark.sql.python.filterPushdown.enabled`` (set by ``tune``),
    comparisons of ``file`` and ``size`` with fixed values are decided before any text is read.
    """
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if run_id:
        reader = reader.option("run_id", run_id)
    reader = reader.option("max_bytes", str(max_bytes)).option("listed_files", str(listed_files))
    if excluded:
        reader = reader.option("excluded", ",".join(excluded))
    n = partitions or spark.sparkContext.defaultParallelism * 4
    return reader.option("partitions", str(n)).load(root)
