"""WARC archives: a writer that runs in tasks, and a Python data source that reads them.

Records are gzip members of their own. The writer puts each member's compressed size into the gzip header (the ``sl``
extra field), so the reader can step over a member without inflating it; archives without that field are read too.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from siftwork.llm.common import Scratch, text_session

ROLL_BYTES = 128 << 20  # a new archive file after so many bytes
SPLIT_BYTES = 64 << 20  # files that are smaller share a read task
LEAST_REVISIT = 100  # payloads below this are always stored
DATE = "2026-01-01T00:00:00Z"
SCHEMA = (
    "record_id string, record_type string, record_date string, target_uri string, payload_digest string, refers_to string, "
    "content_length long, http_length long, headers map<string,string>, payload binary"
)
# Columns that filters are pushed down for, and the header of each.
PUSHED = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "record_date": "warc-date",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose header tells its own compressed size and the size of the data."""
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 24 + len(packed) + len(tail)
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed + tail


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    """A WARC/1.1 record. Control characters in header values are percent-encoded."""
    lines = ["WARC/1.1"]
    for name, value in headers.items():
        if value is not None:
            lines.append(f"{name}: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value))
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(row: dict) -> bytes:
    payload = (row["html"] or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": page_urn(row["page_id"]),
        "WARC-Date": DATE,
        "WARC-Target-URI": row["url"],
        "WARC-Payload-Digest": f"sha256:{row['digest']}",
        "WARC-Refers-To": page_urn(row["refers_to"]) if revisit else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
    }
    return record(headers, http if revisit else http + payload)


def page_urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_id_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def classified(pages: DataFrame, scratch: Scratch, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to: of equal payloads of ``least`` bytes or more, the smallest
    page_id is the response and the others revisit it. Rows without page_id revisit too, if any row of their payload has
    one; a page_id that occurs twice with the smallest payload id is a response each time."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("n"))
    shared = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = scratch.keep(shared.filter("n > 1 and first is not null").select("digest", "first"), "shared")
    n = shared.count()
    # A row of the small side is about 100 bytes; beyond this count both sides are shuffled.
    rows = rows.join(F.broadcast(shared) if n <= 200_000 else shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    return rows.select("page_id", "url", "html", "digest", kind.alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_pages(rows: DataFrame, scratch: Scratch, roll_bytes: int = ROLL_BYTES) -> str:
    """Write a record per row of ``classified``; returns the path of the manifest (file, records, bytes).

    Each task attempt writes files of its own name; those in the manifest are from attempts that succeeded.
    """
    root = scratch.path("archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, at = pyarrow.fs.FileSystem.from_uri(name)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        done, out, n, size = [], None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out, n, size = fs.open_output_stream(f"{at}-{len(done)}.warc.gz", compression=None), 0, 0
                data = member(page_record(row))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    done.append((f"{name}-{len(done)}.warc.gz", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{name}-{len(done)}.warc.gz", n, size))
        if done:
            paths, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    scratch.keep(rows.mapInArrow(write, "path string, records long, bytes long"), "manifest")
    return scratch.path("manifest")


class Source:
    """A stream of bytes with look-ahead."""

    def __init__(self, file, chunk: int = 1 << 20):
        self.file, self.chunk, self.data, self.at = file, chunk, b"", 0

    def need(self, n: int) -> bool:
        """Have n bytes ahead, if the file has them."""
        while len(self.data) - self.at < n:
            more = self.file.read(max(self.chunk, n - (len(self.data) - self.at)))
            if not more:
                return False
            self.data, self.at = self.data[self.at :] + more, 0
        return True

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise ValueError("the archive ends within a record")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def skip(self, n: int) -> None:
        have = len(self.data) - self.at
        if n <= have:
            self.at += n
        else:
            self.file.seek(n - have, 1)
            self.data, self.at = b"", 0


class _Inflated:
    """The data of one gzip member, as far as it is asked for."""

    def __init__(self, source: Source):
        self.source, self.out, self.used = source, b"", 0
        self.z = zlib.decompressobj(31)
        self.skip_size = None
        if source.need(24) and source.data[source.at + 3] == 4 and source.data[source.at + 12 : source.at + 14] == b"sl":
            self.skip_size = struct.unpack("<I", source.data[source.at + 16 : source.at + 20])[0]

    def _more(self) -> bool:
        if self.z.eof or not self.source.need(1):
            return False
        piece = self.source.data[self.source.at : self.source.at + 65536]
        self.out += self.z.decompress(piece)
        eaten = len(piece) - len(self.z.unused_data)
        self.source.at += eaten
        self.used += eaten
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.out:
            if not self._more():
                raise ValueError("the archive ends within a header")
        head, _, self.out = self.out.partition(mark)
        return head

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        got, self.out = self.out[:n], self.out[n:]
        return got

    def finish(self) -> None:
        if self.skip_size and not self.z.eof:
            self.source.skip(self.skip_size - self.used)
            return
        while not self.z.eof:
            self.out = b""
            if not self._more():
                raise ValueError("the archive ends within a member")


class _Plain:
    """One record of an archive that is not compressed."""

    def __init__(self, source: Source):
        self.source, self.left = source, 0

    def until(self, mark: bytes) -> bytes:
        n = 4096
        while (at := self.source.data.find(mark, self.source.at)) < 0:
            if not self.source.need(n):
                at = self.source.data.find(mark, self.source.at)
                if at < 0:
                    raise ValueError("the archive ends within a header")
                break
            n *= 2
        head = self.source.take(at - self.source.at)
        self.source.take(len(mark))
        length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        if head.startswith(b"WARC/"):
            self.left = int(length[1]) if length else 0
        else:
            self.left -= len(head) + len(mark)
        return head

    def take(self, n: int) -> bytes:
        self.left -= n
        return self.source.take(n)

    def finish(self) -> None:
        self.source.skip(self.left)
        while self.source.need(1) and self.source.data[self.source.at] in b"\r\n":
            self.source.at += 1


def fields(head: bytes) -> dict[str, str]:
    """Header fields with lower-case names; folded lines are joined."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def records(file, wanted, payload: bool | frozenset[str]) -> Iterator[tuple]:
    """The records whose headers ``wanted`` accepts; payloads of the asked types are decoded, others stepped over."""
    source = Source(file)
    while source.need(2):
        part = _Inflated(source) if source.data[source.at : source.at + 2] == b"\x1f\x8b" else _Plain(source)
        head = fields(part.until(b"\r\n\r\n"))
        if wanted(head):
            length, kind = int(head.get("content-length", 0)), head.get("warc-type")
            http_length = body = None
            http = head.get("content-type", "").startswith("application/http")
            if http and length:
                inner = part.until(b"\r\n\r\n")
                said = fields(inner).get("content-length", "")
                http_length = int(said) if said.isdigit() else None
                length -= len(inner) + 4
            if payload is True or payload is not False and kind in payload:
                body = part.take(length)
            yield (
                *(head.get(PUSHED[c]) for c in ("record_id", "record_type", "record_date", "target_uri", "payload_digest", "refers_to")),
                int(head.get("content-length", 0)),
                http_length,
                head,
                body,
            )
        part.finish()


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(",".join(paths))
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.equal: list[tuple[str, tuple]] = []
        self.present: list[str] = []

    def pushFilters(self, filters):
        """Equality and IN on the record type and the header columns are decided on the headers alone."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name in PUSHED and isinstance(f, IsNotNull):
                self.present.append(PUSHED[name])
            elif name in PUSHED:
                self.equal.append((PUSHED[name], (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self):
        """Files are planned by size: small ones share a task."""
        if "manifest" in self.options:
            fs, at = pyarrow.fs.FileSystem.from_uri(self.options["manifest"])
            files = pq.read_table(at, filesystem=fs, columns=["path", "bytes"]).to_pylist()
            files = [(f["path"], f["bytes"]) for f in files]
        else:
            fs, at = pyarrow.fs.FileSystem.from_uri(self.options["path"])
            info = fs.get_file_info(at)
            info = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
            scheme = self.options["path"].split("://")[0] + "://" if "://" in self.options["path"] else ""
            files = [(scheme + i.path, i.size) for i in info if i.is_file and re.search(r"\.warc(\.gz)?$", i.path)]
        most, out, size = int(self.options.get("splitBytes", SPLIT_BYTES)), [], 0
        for path, n in sorted(files):
            if not out or size + n > most:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [_Files(x) for x in out] or [_Files([])]

    def read(self, partition):
        def wanted(head: dict) -> bool:
            return all(name in head for name in self.present) and all(head.get(name) in values for name, values in self.equal)

        asked = self.options.get("payload", "true")
        payload = {"true": True, "false": False}.get(asked, frozenset(asked.split(",")))
        rows, size = [], 0
        for path in partition.paths:
            fs, at = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as f:
                for row in records(f, wanted, payload):
                    rows.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


_TYPES = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.map_(pa.string(), pa.string()), pa.binary()]
_NAMES = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    cols[8] = [list(h.items()) for h in cols[8]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _NAMES)


class WarcSource(DataSource):
    """``spark.read.format("warc")``: options ``path`` (a file or folder) or ``manifest``, ``splitBytes``, and ``payload``:
    ``true``, ``false``, or the record types whose payloads are wanted, with commas."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, payload: str = "true", **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(payload=payload, **options).load()


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write a record per page, read the archives back, and tell what each record holds.

    Null html counts as empty. Sizes and digests of responses are taken from the payloads as read; those of revisits from
    their headers, which tell the full payload's. An empty table gives no archive and no rows.
    """
    spark = text_session(pages.sparkSession)
    scratch = Scratch(spark, "warc")
    read = read_warc(spark, payload="response", manifest=write_pages(classified(pages, scratch), scratch))
    stored = F.coalesce(F.col("payload"), F.lit(b""))
    revisit = F.col("record_type") == "revisit"
    return read.select(
        page_id_of(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.octet_length(stored).cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2(stored, 256)).alias("payload_digest"),
        "record_type",
        page_id_of(F.col("refers_to")).alias("refers_to"),
    )
