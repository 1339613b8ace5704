"""Lines written as files that count only once a job has committed them.

Every task attempt writes files of its own names. The job's commit writes a manifest that names the files of the
successful attempts, in one step; readers take their files from it. What failed, repeated or lost attempts left behind is
in no manifest, so it is never read, and a job that fails leaves the rows of the commit before it.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "_manifest.json"  # a name that Spark's own readers pass over
FILE_BYTES = 128 << 20


class NotCommitted(FileNotFoundError):
    """No job has committed rows to this path."""


@dataclass
class Written(WriterCommitMessage):
    """The files of one task attempt: path below the root, rows, bytes."""

    files: list[tuple[str, int, int]] = field(default_factory=list)


def _file_system(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, at = pyarrow.fs.FileSystem.from_uri(root)
    return fs, at.rstrip("/")


def _folder(value: str | None) -> str:
    """A folder name for any text: escaped, and a digest where that is too long for a name."""
    name = "__HIVE_DEFAULT_PARTITION__" if value is None else quote(value, safe=" ")
    return f"run_id={name if len(name) <= 200 else hashlib.sha256(value.encode()).hexdigest()}"


def _listed(root: str) -> list[dict]:
    fs, at = _file_system(root)
    if fs.get_file_info(f"{at}/{MANIFEST}").type == pyarrow.fs.FileType.NotFound:
        raise NotCommitted(root)
    with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
        return [json.loads(line) for line in f.read().splitlines()]


class LinesWriter(DataSourceArrowWriter):
    """Rows ``(run_id, value)``: a line per row, in one folder per run or, without that column, in the root."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.root, self.overwrite = options["path"], overwrite
        self.most = int(options.get("file_bytes", str(FILE_BYTES)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _file_system(self.root)
        out, made = Written(), []
        stream, folder, rows = None, None, 0

        def close() -> None:
            nonlocal stream
            if stream is not None:
                out.files.append((posixpath.relpath(made[-1], root), rows, stream.tell()))
                stream.close()
                stream = None

        try:
            for batch in iterator:
                runs = [_folder(r) for r in batch.column("run_id").to_pylist()] if "run_id" in batch.schema.names else [""] * batch.num_rows
                for run, value in zip(runs, batch.column("value").to_pylist()):
                    if stream is None or run != folder or stream.tell() >= self.most:
                        close()
                        folder, rows = run, 0
                        made.append(posixpath.join(root, folder, f"part-{uuid.uuid4().hex}.json"))
                        fs.create_dir(posixpath.dirname(made[-1]), recursive=True)
                        stream = fs.open_output_stream(made[-1], compression=None)
                    stream.write(value.encode() + b"\n")
                    rows += 1
            close()
        except BaseException:
            if stream is not None:
                stream.close()
            _delete(fs, made)
            raise
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _file_system(self.root)
        files = [dict(zip(("file", "rows", "bytes"), f)) for m in messages if m is not None for f in m.files]
        try:
            before = _listed(self.root)
        except NotCommitted:
            before = []
        fs.create_dir(root, recursive=True)
        if not files and (self.overwrite or not before):
            # A file without rows, so that a reader always has one.
            files = [{"file": f"part-{uuid.uuid4().hex}.json", "rows": 0, "bytes": 0}]
            fs.open_output_stream(f"{root}/{files[0]['file']}", compression=None).close()
        made = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(made, compression=None) as f:
            f.write("".join(json.dumps(x) + "\n" for x in (files if self.overwrite else before + files)).encode())
        fs.move(made, f"{root}/{MANIFEST}")
        if self.overwrite:
            _delete(fs, [f"{root}/{x['file']}" for x in before])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _file_system(self.root)
        _delete(fs, [f"{root}/{f[0]}" for m in messages if m is not None for f in m.files])


def _delete(fs: pyarrow.fs.FileSystem, paths: list[str]) -> None:
    for path in paths:
        if fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
            fs.delete_file(path)


class CommittedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        if not {"value"} <= set(schema.names) <= {"run_id", "value"}:
            raise ValueError(f"committed lines have the columns run_id and value, not {', '.join(schema.names)}")
        return LinesWriter(self.options, overwrite)


def write_committed(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``(run_id, value)`` or ``(value)``; ``mode`` is ``overwrite`` or ``append``. One job at a time writes to a path.

    Rows are placed by run first, so that a run has few files; a large run is split.
    """
    lines.sparkSession.dataSource.register(CommittedLines)
    if "run_id" in lines.columns:
        lines = lines.hint("rebalance", "run_id").sortWithinPartitions("run_id")
    lines.write.format("committed_lines").mode(mode).save(path)


def committed_files(path: str) -> list[str]:
    """The files of the last commit, for any reader of text files; ``NotCommitted`` where there is none."""
    return [f"{path.rstrip('/')}/{x['file']}" for x in _listed(path)]


def remove_uncommitted(path: str) -> int:
    """Delete the part files that the last commit does not name, while no job writes to the path; how many there were."""
    fs, root = _file_system(path)
    try:
        named = {f"{root}/{x['file']}" for x in _listed(path)}
    except NotCommitted:
        named = set()
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True, recursive=True))
    left = [f.path for f in found if f.is_file and f.base_name.startswith("part-") and f.path not in named]
    _delete(fs, left)
    return len(left)


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The committed lines, ``value``."""
    return spark.read.text(committed_files(path))
