"""WARC archives as a PySpark Python data source (short name ``warc``).

Reading plans one partition for each archive file (writers roll to a new file at ``max_file_bytes``, so
partitions are bounded). A reader goes through a file record by record: it parses the header block first,
applies the pushed-down predicates on record type and header columns, and for records that fail them, or
when the payload is not asked for (option ``payload=none``), skips the block without decoding it. Files
ending in ``.gz`` hold one gzip member a record. The writer states each member's length in an extra field of its gzip header,
so a skipped block is passed over without inflating (or, where it is long, reading) it; in members of other writers, without that
field, it is inflated but not kept.

Writing gives each task attempt files of its own name; the names reach ``_manifest.json`` only when the whole
job commits, and readers of a folder with a manifest read what it lists. A lost executor's half-written
files are never read, and its tasks write again under new names.

Paths go through ``pyarrow.fs``: local folders, ``file://``, ``hdfs://``, ``s3://`` and ``gs://``.
"""

from __future__ import annotations

import json
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition,
                                    IsNotNull, StringStartsWith, WriterCommitMessage)

from .common import ship

MANIFEST = "_manifest.json"
MAX_FILE_BYTES = 256 << 20
ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 8 << 20

SCHEMA = ("record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, "
          "refers_to string, content_length long, headers map<string,string>, payload binary, file string")
WRITE_COLUMNS = ("record_id", "record_type", "target_uri", "date", "content_type", "payload_digest", "refers_to", "headers", "payload")

#: The archive format's header names of the columns.
HEADER_OF = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
             "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
_LOWER = {h.lower(): c for c, h in HEADER_OF.items()}
VERSION = b"WARC/1.1"

#: Fixed values of the gzip format: magic, deflate, flag of an extra field, no time, unknown system.
GZIP_HEAD = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff"
#: The extra field: 12 bytes, of them a name of our own, the length 8, and the whole member's length in 8 bytes.
EXTRA = (12).to_bytes(2, "little") + b"LL" + (8).to_bytes(2, "little")
SIZED = len(GZIP_HEAD) + len(EXTRA) + 8


def open_fs(path: str):
    """(filesystem, path inside it) of a URI or local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# ---- one record ---------------------------------------------------------------------------------


def encode_record(row: dict) -> bytes:
    """A record's bytes. Header values are percent-encoded where they hold line breaks or outer blanks."""
    payload = row["payload"] or b""
    lines = [VERSION]
    named = [(HEADER_OF[c], row[c]) for c in HEADER_OF if row.get(c) is not None]
    for name, value in [*named, *sorted((row.get("headers") or {}).items()), ("Content-Length", str(len(payload)))]:
        if value is not None and (name not in ("Content-Length",) or value == str(len(payload))):
            lines.append(f"{name}: {_quote(str(value))}".encode("utf-8", "surrogatepass"))
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _quote(value: str) -> str:
    if value.startswith("%Q") or value != value.strip() or "\r" in value or "\n" in value:
        return "%Q" + value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20").replace("\t", "%09")
    return value


def _unquote(value: str) -> str:
    if not value.startswith("%Q"):
        return value
    for code, ch in (("%0D", "\r"), ("%0A", "\n"), ("%20", " "), ("%09", "\t")):
        value = value.replace(code, ch)
    return value[2:].replace("%25", "%")


def zip_record(data: bytes) -> bytes:
    """A gzip member of ``data`` that states its own length; any gzip reader can read it."""
    z = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    end = zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    return GZIP_HEAD + EXTRA + (SIZED + len(body) + len(end)).to_bytes(8, "little") + body + end


class _Stream:
    """Bytes of a plain or gzip file, in pieces; never the whole file."""

    PIECE = 1 << 20
    STEP = 1 << 15  # compressed bytes inflated at a time

    def __init__(self, raw, zipped: bool):
        self.raw, self.zipped = raw, zipped
        self.buffer, self.inflate = bytearray(), None
        self.piece, self.at, self.read_to = b"", 0, 0  # bytes read, how many of them are used, the file's position after them
        self.member_end = None  # where the current member ends, if it says so and all of ``buffer`` is its own

    def _more(self) -> bool:
        if not self.zipped:
            piece = self.raw.read(self.PIECE)
            self.buffer += piece
            return bool(piece)
        if len(self.piece) - self.at < SIZED:  # enough for a member's header
            piece = self.raw.read(self.PIECE)
            self.piece, self.at, self.read_to = self.piece[self.at:] + piece, 0, self.read_to + len(piece)
        if self.at == len(self.piece):
            return False
        if self.inflate is None:
            self.inflate = zlib.decompressobj(31)
            head = self.piece[self.at:self.at + SIZED]
            sized = len(head) == SIZED and head.startswith(GZIP_HEAD + EXTRA) and not self.buffer
            self.member_end = self.read_to - len(self.piece) + self.at + int.from_bytes(head[-8:], "little") if sized else None
        step = self.piece[self.at:self.at + self.STEP]
        self.buffer += self.inflate.decompress(step)
        self.at += len(step)
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
            self.inflate = None
        return True

    def pass_record(self, n: int) -> None:
        """Pass the ``n`` bytes and the line ends that are left of the current record."""
        if self.member_end is None:
            self.skip(n)
            self.skip(4)
            return
        self.buffer.clear()
        start = self.read_to - len(self.piece)
        if self.member_end <= self.read_to:
            self.at = self.member_end - start
        else:
            self.raw.seek(self.member_end - 1)
            self.piece, self.at = self.raw.read(self.PIECE), 1
            if not self.piece:
                raise EOFError("an archive ends inside a record")
            self.read_to = self.member_end - 1 + len(self.piece)
        self.inflate = self.member_end = None

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before ``mark``, which is consumed too; None at the end of the file."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                if self.buffer.strip():
                    raise EOFError("an archive ends inside a record")
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[:at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise EOFError("an archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def skip(self, n: int) -> None:
        """Pass ``n`` bytes without keeping them; a plain file is not even read there."""
        while n > 0:
            have = min(n, len(self.buffer))
            del self.buffer[:have]
            n -= have
            if n and not self.zipped:
                self.raw.seek(n, 1)
                return
            if n and not self._more():
                raise EOFError("an archive ends inside a record")


def records(raw, zipped: bool, wanted, with_payload: bool) -> Iterator[dict]:
    """Records for which ``wanted(header columns)`` holds; others' payloads are skipped."""
    stream = _Stream(raw, zipped)
    while (block := stream.until(b"\r\n\r\n")) is not None:
        lines = block.decode("utf-8", "surrogatepass").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record: " + lines[0][:80])
        row: dict = dict.fromkeys(HEADER_OF)
        row["headers"] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            value = _unquote(value.strip())
            if (column := _LOWER.get(name.strip().lower())) is not None:
                row[column] = value
            else:
                row["headers"][name.strip()] = value
        length = next((int(v) for k, v in row["headers"].items() if k.lower() == "content-length"), 0)
        row["headers"] = {k: v for k, v in row["headers"].items() if k.lower() != "content-length"}
        row["content_length"] = length
        keep = wanted(row)
        if keep and with_payload:
            row["payload"] = stream.take(length)
            stream.skip(4)
        else:
            row["payload"] = None
            stream.pass_record(length)
        if keep:
            yield row


# ---- the data source ----------------------------------------------------------------------------


@dataclass
class ArchiveFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = options.get("payload", "full") != "none"
        self.tests: list[tuple[str, str, tuple]] = []  # (column, kind, values)

    def pushFilters(self, filters: list[Filter]):
        """Takes predicates on header columns; the rest go back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_OF and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADER_OF and isinstance(f, In):
                self.tests.append((column, "in", tuple(v for v in f.value if v is not None)))
            elif column in HEADER_OF and isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", (f.value,)))
            elif column in HEADER_OF and isinstance(f, IsNotNull):
                self.tests.append((column, "some", ()))
            else:
                yield f

    def partitions(self) -> list[ArchiveFile]:
        from pyarrow import fs

        system, root = open_fs(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [ArchiveFile(root)]
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                names = json.loads(f.read())["files"]
            return [ArchiveFile(f"{root}/{n}") for n in names]
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [ArchiveFile(x.path) for x in sorted(found, key=lambda x: x.path) if x.path.endswith((".warc", ".warc.gz")) and x.size]

    def _wanted(self, row: dict) -> bool:
        for column, kind, values in self.tests:
            value = row[column]
            if value is None or kind == "in" and value not in values or kind == "prefix" and not value.startswith(values[0]):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not hasattr(partition, "path"):  # an empty archive is read as one empty partition
            return
        system, _ = open_fs(self.path)
        zipped = partition.path.endswith(".gz")
        names = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")]
        types = [pa.int64() if n == "content_length" else pa.map_(pa.string(), pa.string()) if n == "headers" else
                 pa.binary() if n == "payload" else pa.string() for n in names]
        schema = pa.schema(list(zip(names, types)))
        held: list[dict] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" else r[n] for r in held], t) for n, t in zip(names, types)], schema=schema)

        with system.open_input_file(partition.path) as raw:
            for row in records(raw, zipped, self._wanted, self.with_payload):
                row["file"] = partition.path
                held.append(row)
                size += len(row["payload"] or b"")
                if len(held) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.zipped = options.get("compression", "gzip") == "gzip"
        self.max_bytes = int(options.get("maxfilebytes") or options.get("maxFileBytes") or MAX_FILE_BYTES)
        self.overwrite = overwrite

    def write(self, rows) -> Written:
        system, root = open_fs(self.path)
        system.create_dir(root, recursive=True)
        out, size, files = None, 0, []
        try:
            for r in rows:
                if out is None or size >= self.max_bytes:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.zipped)
                    out, size = system.open_output_stream(f"{root}/{files[-1]}", compression=None, buffer_size=1 << 20), 0
                data = encode_record({c: r[c] for c in WRITE_COLUMNS if c in r})
                if self.zipped:
                    data = zip_record(data)
                out.write(data)
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def _manifest(self, names: list[str]) -> None:
        system, root = open_fs(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}.new", compression=None) as f:
            f.write(json.dumps({"files": sorted(names)}).encode())
        system.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, root = open_fs(self.path)
        old: list[str] = []
        if not self.overwrite and system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                old = json.loads(f.read())["files"]
        self._manifest(old + [n for m in messages if m is not None for n in m.files])

    def abort(self, messages) -> None:
        system, root = open_fs(self.path)
        for m in messages:
            for n in m.files if m is not None else []:
                system.delete_file(f"{root}/{n}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``.

    Options: ``payload`` (read: ``full`` or ``none``), ``compression`` (write: ``gzip`` or ``none``), ``maxFileBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    # by value: the worker that plans a Python source has the driver's Python, but not the files sent to executors
    here = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(here)
    try:
        spark.dataSource.register(WarcDataSource)
    finally:
        cloudpickle.unregister_pickle_by_value(here)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return ship(spark)


# ---- pages to archives and back -----------------------------------------------------------------


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 100,
                 date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Records for ``write.format('warc')``: one per row of ``pages``.

    Of rows with equal payloads (UTF-8; null is empty) of at least ``min_revisit`` bytes, the one with the
    smallest id is a ``response`` with its payload and the others are ``revisit`` records without one, which
    name it. Rows that share that smallest id are all responses, as is a row with a null id. Every record's
    headers state its full payload's length and SHA-256. The smallest ids are found by a map-side combined
    aggregate of digests; a digest that a third of all rows share is split by the skew join.
    """
    c = lambda n: F.col(f"`{n}`")
    body = F.coalesce(F.encode(c(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(c(id_col).cast("string").alias("_id"), c(id_col).alias("_n"), c(url_col).cast("string").alias("target_uri"),
                        body.alias("payload")).withColumns({"_bytes": F.octet_length("payload").cast("long"), "_sha": F.sha2("payload", 256)})
    first = (rows.where(F.col("_bytes") >= min_revisit).groupBy(F.col("_sha").alias("_s")).agg(F.min("_n").alias("_first"), F.count("*").alias("_k"))
             .where("_k > 1 AND _first IS NOT NULL").select("_s", "_first"))
    rows = rows.join(first, F.col("_sha") == F.col("_s"), "left")
    revisit = F.coalesce(F.col("_first") != F.col("_n"), F.lit(False))
    urn = lambda x: F.concat(F.lit("<urn:page:"), x, F.lit(">"))
    headers = F.map_concat(
        F.create_map(F.lit("X-Payload-Length"), F.col("_bytes").cast("string")),
        F.when(F.col("_id").isNotNull(), F.create_map(F.lit("X-Page-Id"), F.col("_id"))).otherwise(F.expr("map()").cast("map<string,string>")),
        F.when(revisit, F.create_map(F.lit("WARC-Profile"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.expr("map()").cast("map<string,string>")))
    return rows.select(
        urn(F.coalesce("_id", F.lit(""))).alias("record_id"), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "target_uri", F.lit(date).alias("date"), F.lit("text/html; charset=utf-8").alias("content_type"),
        F.concat(F.lit("sha256:"), F.col("_sha")).alias("payload_digest"), F.when(revisit, urn(F.col("_first").cast("string"))).alias("refers_to"),
        headers.alias("headers"), F.when(revisit, F.lit(None).cast("binary")).otherwise(F.col("payload")).alias("payload"))


def write_archives(records_df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records (columns of ``WRITE_COLUMNS``) as archives under ``path``; an empty table gives an empty archive."""
    register(records_df.sparkSession)
    records_df.write.format("warc").option("compression", compression).mode("overwrite").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    return register(spark).read.format("warc").option("payload", "full" if payload else "none").load(path)
