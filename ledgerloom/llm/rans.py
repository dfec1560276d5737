"""Token ids in files coded by a static range asymmetric numeral system (rANS), as a PySpark data source (``rans``).

*Shared table.* The corpus is tokenised once and its ids are counted in full (combined by map-side sums; what reaches
the driver is one number for each id of the vocabulary). ``quantise`` turns the counts into frequencies that sum to
``2**BITS``; every file of a folder is coded by that one table, stored beside them with a checksum.

*Interleaved blocks.* A block is ``BLOCK_ROWS`` rows of ``LANES`` tokens. Each lane is a coder of its own with a 64-bit
state, all lanes step through the rows together, and their 32-bit words go to one stream in lane order. A block starts
from fresh states and needs no other block, so several are coded side by side as one numpy vector.

*Checkpoints.* The coder works from the last row back, so its states after row r are those a decoder needs before row r.
Every ``SEGMENT_ROWS`` rows they are kept: a file is a sequence of segments (states, then words), each of which can be
decoded alone. A footer holds every segment's place and the checksum of its ids, and the documents' ids and lengths.
A reader that wants some documents decodes only the segments that hold them, many side by side.

*Order.* Documents are range-partitioned and sorted by (id, hash of the text, a salt), nulls first, so rows that repeat
one id or one text are divided between tasks as well. Tasks write files of their own names; the manifest written at
commit names them in order, with the number of ids before each. A file of a failed attempt is never named, so never read.
The driver holds one manifest line a file. A task holds one batch of documents and ``GROUP`` blocks.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..sources.snapshot import materialize, remove_table
from . import tokens, warc
from .common import ship
from .warc import open_fs

BITS = 20  # frequencies sum to 2**BITS; vocabularies of a quarter of that or more get more bits
LANES = 256
SEGMENT_ROWS = 256  # rows between checkpoints: 65,536 ids
BLOCK_ROWS = 1024  # 262,144 ids
GROUP = 16  # blocks coded side by side
WINDOW = 64  # segments decoded side by side
LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
MAX_FILE_IDS = 1 << 26
IDS_A_PARTITION = 1 << 22  # ids that a reading task starts with

MANIFEST, TABLE, MAGIC = "_manifest.json", "_frequencies", b"RANSIDS1"
SEGMENT = np.dtype([("at", "<i8"), ("words", "<i4"), ("ids", "<i4"), ("crc", "<u4")])
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


# ---- the code -----------------------------------------------------------------------------------


def quantise(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to ``2**bits``: at least 1 for every id that occurs, 0 for the others."""
    there = counts > 0
    n = int(there.sum())
    if not n:
        return np.zeros(len(counts), np.uint64)
    total, spare = int(counts.sum()), (1 << bits) - n
    share = np.array([int(c) * spare // total for c in counts], np.uint64)
    freq = share + there.astype(np.uint64)
    freq[int(np.argmax(counts))] += np.uint64((1 << bits) - int(freq.sum()))
    return freq


class Table:
    """A frequency table in the forms that coding and decoding look things up in."""

    def __init__(self, freq: np.ndarray, bits: int):
        if len(freq) > 1 << 20:
            raise ValueError("more than 2**20 ids")
        self.bits, self.freq = bits, freq.astype(np.uint64)
        cum = np.cumsum(self.freq) - self.freq
        self.of_id = self.freq << np.uint64(32) | cum  # both in one look-up
        # of each of the 2**bits slots: id, frequency - 1 and place within the id's range, in one look-up
        who = np.repeat(np.arange(len(freq)), self.freq.astype(np.int64))
        w = np.uint64(bits)
        self.of_slot = (who.astype(np.uint64) << w | (self.freq[who] - np.uint64(1))) << w | (np.arange(len(who), dtype=np.uint64) - cum[who])
        self.fill = int(np.argmax(self.freq)) if len(freq) else 0  # pads the last row of a file

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        bits = max(BITS, int(len(counts)).bit_length() + 2)
        return cls(quantise(counts, bits), bits)

    def to_bytes(self) -> bytes:
        body = struct.pack("<II", self.bits, len(self.freq)) + self.freq.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        body, crc = data[:-4], struct.unpack("<I", data[-4:])[0]
        if zlib.crc32(body) != crc:
            raise ValueError("the frequency table is damaged")
        bits, _ = struct.unpack("<II", body[:8])
        return cls(np.frombuffer(body, "<u4", offset=8), bits)


def encode(ids: np.ndarray, table: Table) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Codes blocks side by side: ``ids`` is (blocks, rows, lanes); gives (states, words) for each segment of each block."""
    blocks, rows, lanes = ids.shape
    by_row = ids.transpose(1, 0, 2)
    bits, top, half, low = np.uint64(table.bits), np.uint64(63 - table.bits), np.uint64(32), np.uint64(0xFFFFFFFF)
    state = np.full(blocks * lanes, LOW)
    out: list[list] = [[] for _ in range(blocks)]
    words: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for r in range(rows - 1, -1, -1):
        both = table.of_id[by_row[r].reshape(-1).astype(np.intp)]
        f = both >> half
        full = np.flatnonzero(state >= f << top)
        high = state[full]
        words.append(high.astype(np.uint32))
        owners.append(full // lanes)
        state[full] = high >> half
        q = state // f
        state = (q << bits) + (state - q * f) + (both & low)
        if r % SEGMENT_ROWS == 0:
            stream, owner = np.concatenate(words[::-1]), np.concatenate(owners[::-1]).astype(np.uint16)
            stream = stream[np.argsort(owner, kind="stable")]
            ends = np.cumsum(np.bincount(owner, minlength=blocks))
            for b, part in enumerate(np.split(stream, ends[:-1])):
                out[b].insert(0, (state[b * lanes:(b + 1) * lanes].copy(), part))
            words, owners = [], []
    return out


def decode(states: np.ndarray, streams: list[np.ndarray], rows: int, table: Table) -> np.ndarray:
    """Decodes segments of equal ``rows`` side by side: ``states`` is (segments, lanes); gives ids as (segments, rows * lanes)."""
    n, lanes = states.shape
    stream = np.concatenate([*streams, np.zeros(1, np.uint32)])
    sizes = np.array([len(s) for s in streams], np.int64)
    at = np.cumsum(sizes) - sizes
    ends = at + sizes
    state = states.reshape(-1).astype(np.uint64)
    bits, mask, one = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(1)
    out = np.empty((rows, n * lanes), np.uint32)
    for r in range(rows):
        slot = table.of_slot[(state & mask).astype(np.intp)]
        out[r] = slot >> bits + bits
        state = ((slot >> bits & mask) + one) * (state >> bits) + (slot & mask)
        need = np.flatnonzero(state < LOW)
        if len(need):
            owner = need // lanes
            k = np.bincount(owner, minlength=n)
            place = np.arange(len(need)) + (at - (np.cumsum(k) - k))[owner]
            at = at + k
            if (at > ends).any():
                raise ValueError("a segment ends before its ids")
            state[need] = (state[need] << np.uint64(32)) | stream[place]
    return np.ascontiguousarray(out.reshape(rows, n, lanes).transpose(1, 0, 2)).reshape(n, rows * lanes)


# ---- one file -----------------------------------------------------------------------------------


class FileWriter:
    """Takes documents in order and writes one file; blocks are coded ``GROUP`` at a time."""

    def __init__(self, out, table: Table):
        self.out, self.table = out, table
        self.place = self.out.write(MAGIC)
        self.segments: list[tuple] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.doc_ids: list[int] = []
        self.nulls: list[int] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if doc_id is None:
            self.nulls.append(len(self.doc_ids))
        self.doc_ids.append(doc_id or 0)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        block = LANES * BLOCK_ROWS
        if self.n_held >= GROUP * block:
            whole = np.concatenate(self.held)
            for at in range(0, len(whole) - GROUP * block + 1, GROUP * block):
                self._code(whole[at:at + GROUP * block].reshape(GROUP, BLOCK_ROWS, LANES))
            rest = whole[len(whole) // (GROUP * block) * (GROUP * block):].copy()
            self.held, self.n_held = [rest], len(rest)

    def _code(self, ids: np.ndarray, real: int | None = None) -> None:
        """``real``: how many ids of a padded last block are documents'."""
        for b, segments in enumerate(encode(ids, self.table)):
            flat = ids[b].reshape(-1).astype("<u4")[:real]
            for k, (states, words) in enumerate(segments):
                part = flat[k * SEGMENT_ROWS * LANES:(k + 1) * SEGMENT_ROWS * LANES]
                self.segments.append((self.place, len(words), len(part), zlib.crc32(part.tobytes())))
                self.place += self.out.write(states.astype("<u8").tobytes())
                self.place += self.out.write(words.astype("<u4").tobytes())

    def close(self) -> None:
        rest = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(rest) // (LANES * BLOCK_ROWS) * (LANES * BLOCK_ROWS)
        if whole:
            self._code(rest[:whole].reshape(-1, BLOCK_ROWS, LANES))
        if len(piece := rest[whole:]):
            rows = -(-len(piece) // LANES)
            padded = np.full(rows * LANES, self.table.fill, np.uint32)
            padded[:len(piece)] = piece
            self._code(padded.reshape(1, rows, LANES), len(piece))
        footer = b"".join([
            struct.pack("<III", len(self.segments), len(self.doc_ids), len(self.nulls)), np.array(self.segments, SEGMENT).tobytes(),
            np.array(self.doc_ids, "<i8").tobytes(), np.array(self.lengths, "<i8").tobytes(), np.array(self.nulls, "<i8").tobytes()])
        self.out.write(footer + struct.pack("<QI", len(footer), zlib.crc32(footer)) + MAGIC)


class FileReader:
    """A file's footer, and the ids of any run of its segments."""

    def __init__(self, raw, size: int, table: Table):
        self.raw, self.table = raw, table
        raw.seek(size - 20)
        length, crc, magic = struct.unpack("<QI8s", raw.read(20))
        raw.seek(size - 20 - length)
        footer = raw.read(length)
        if magic != MAGIC or zlib.crc32(footer) != crc:
            raise ValueError("the footer of a token file is damaged")
        n, docs, nulls = struct.unpack("<III", footer[:12])
        self.segments = np.frombuffer(footer, SEGMENT, n, 12)
        at = 12 + n * SEGMENT.itemsize
        self.doc_ids = np.frombuffer(footer, "<i8", docs, at)
        self.lengths = np.frombuffer(footer, "<i8", docs, at + 8 * docs)
        self.null = np.zeros(docs, bool)
        self.null[np.frombuffer(footer, "<i8", nulls, at + 16 * docs)] = True
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the segments ``first`` to ``last`` - 1; they are decoded side by side and held to their checksums."""
        some = self.segments[first:last]
        begin, end = int(some["at"][0]), int(some["at"][-1]) + LANES * 8 + 4 * int(some["words"][-1])
        self.raw.seek(begin)
        data = self.raw.read(end - begin)
        states = np.stack([np.frombuffer(data, "<u8", LANES, int(a) - begin) for a in some["at"]])
        streams = [np.frombuffer(data, "<u4", int(w), int(a) - begin + LANES * 8) for a, w in zip(some["at"], some["words"])]
        rows = -(-some["ids"] // LANES)
        out: list = [None] * len(some)
        for r in np.unique(rows):  # all but a file's last have the same
            which = np.flatnonzero(rows == r)
            for i, ids in zip(which, decode(states[which], [streams[i] for i in which], int(r), self.table)):
                out[i] = ids[:int(some["ids"][i])]
                if zlib.crc32(out[i].astype("<u4").tobytes()) != some["crc"][i]:
                    raise ValueError("a segment of a token file is damaged")
        return np.concatenate(out)

    def documents(self, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
        """(number, ids) of the documents that start at the file's ids ``lo`` to ``hi`` - 1."""
        first, last = np.searchsorted(self.starts, [lo, hi], "left")
        edges = np.cumsum(self.segments["ids"])
        seg = int(np.searchsorted(edges, self.starts[first], "right")) if first < last else 0
        base = int(edges[seg - 1]) if seg else 0
        held = np.zeros(0, np.uint32)
        for d in range(int(first), int(last)):
            begin, n = int(self.starts[d]), int(self.lengths[d])
            parts = [held]
            have = base + len(held)
            while have < begin + n:
                # no further than the documents asked for
                want = int(np.searchsorted(edges, self.starts[last - 1] + self.lengths[last - 1], "left")) + 1
                to = min(len(edges), want, seg + WINDOW)
                parts.append(self.ids(seg, to))
                have += len(parts[-1])
                seg = to
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield d, held[begin - base:begin - base + n]
            held = held[begin - base + n:]
            base = begin + n


# ---- the data source ----------------------------------------------------------------------------


def _get(path: str, name: str) -> bytes:
    system, root = open_fs(path)
    with system.open_input_stream(f"{root}/{name}", compression=None) as f:
        return f.read()


def _put(path: str, name: str, data: bytes) -> None:
    system, root = open_fs(path)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}.new", compression=None) as f:
        f.write(data)
    system.move(f"{root}/{name}.new", f"{root}/{name}")


@dataclass
class Stretch(InputPartition):
    """The documents that start at the ids ``lo`` to ``hi`` - 1 of a file; ``before`` ids precede the file."""

    name: str
    lo: int
    hi: int
    before: int


class RansReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Stretch]:
        out = []
        for f in json.loads(_get(self.path, MANIFEST))["files"]:
            cuts = [*range(0, max(1, f["ids"]), IDS_A_PARTITION), f["ids"] + 1]
            out += [Stretch(f["name"], lo, hi, f["before"]) for lo, hi in zip(cuts, cuts[1:])]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not hasattr(partition, "name"):  # an empty folder is read as one empty partition
            return
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        system, root = open_fs(self.path)
        table = Table.from_bytes(_get(self.path, TABLE))
        rows: list[tuple] = []
        size = 0
        with system.open_input_file(f"{root}/{partition.name}") as raw:
            file = FileReader(raw, raw.size(), table)
            for d, ids in file.documents(partition.lo, partition.hi):
                rows.append((None if file.null[d] else int(file.doc_ids[d]), partition.before + int(file.starts[d]), len(ids), ids.astype("<u4").tobytes()))
                size += len(ids)
                if len(rows) >= 1024 or size >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list


class RansWriter(DataSourceArrowWriter):
    """Takes rows (run, place, doc_id, ids of ``width`` bytes); a file holds consecutive places of one run."""

    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options["width"])
        self.max_ids = int(options.get("maxfileids") or options.get("maxFileIds") or MAX_FILE_IDS)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_fs(self.path)
        table = Table.from_bytes(_get(self.path, TABLE))
        files, now, out, due = [], None, None, None

        def close() -> None:
            now.close()
            out.close()
            files[-1] |= {"ids": now.n_ids, "docs": len(now.doc_ids)}

        for b in batches:
            for run, place, doc_id, ids in zip(*(b.column(b.schema.get_field_index(c)) for c in ("run", "place", "doc_id", "ids"))):
                at = (run.as_py(), place.as_py())
                if now is None or at != due or now.n_ids >= self.max_ids:
                    if now is not None:
                        close()
                    files.append({"name": f"{uuid.uuid4().hex}.rans", "run": at[0], "place": at[1]})
                    out = system.open_output_stream(f"{root}/{files[-1]['name']}", compression=None, buffer_size=1 << 20)
                    now = FileWriter(out, table)
                now.add(doc_id.as_py(), np.frombuffer(ids.as_buffer(), f"<u{self.width}").astype(np.uint32))
                due = (at[0], at[1] + 1)
        if now is not None:
            close()
        return Written(files)

    def commit(self, messages) -> None:
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: (f["run"], f["place"]))
        before = 0
        for f in files:
            f["before"] = before
            before += f["ids"]
        _put(self.path, MANIFEST, json.dumps({"ids": before, "files": files}).encode())

    def abort(self, messages) -> None:
        system, root = open_fs(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                system.delete_file(f"{root}/{f['name']}")


class RansDataSource(DataSource):
    """``spark.read.format("rans").load(path)`` gives doc_id, start, n_tokens and ids (little-endian unsigned 32-bit)."""

    @classmethod
    def name(cls) -> str:
        return "rans"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RansReader:
        return RansReader(self.options)

    def writer(self, schema, overwrite: bool) -> RansWriter:
        return RansWriter(self.options)


def register(spark: SparkSession) -> SparkSession:
    # by value: the worker that plans a Python source has the driver's Python, but not the files sent to executors
    modules = [sys.modules[__name__], warc]
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    try:
        spark.dataSource.register(RansDataSource)
    finally:
        for m in modules:
            cloudpickle.unregister_pickle_by_value(m)
    return ship(spark)


# ---- documents to files and back ----------------------------------------------------------------


def _tokenise(encoder_args, end_id: int | None, width: int):
    schema = pa.schema([("run", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.worker_encoder(*encoder_args.value)
        part, place = TaskContext.get().partitionId(), 0
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                ids = [np.concatenate([enc.encode(t.as_py() or ""), end]).astype(f"<u{width}").tobytes() for t in s.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(range(place, place + len(ids)), pa.int64()),
                                                  s.column(0), pa.array(ids, pa.binary())], schema=schema)
                place += len(ids)

    return run


def _counts(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b"".join(b.column(0).slice(at, 256).to_pylist())
                seen += np.bincount(np.frombuffer(some, f"<u{width}"), minlength=size)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(seen[there], pa.int64())], names=["id", "n"])

    return run


def write_token_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                    max_file_ids: int = MAX_FILE_IDS) -> None:
    """Write every document's token ids, each followed by ``end_id``, to rANS files under ``path`` in ascending id order.

    Ids must be integers or null (null ids come first; other types are cast to long, and text that is no number is
    an error). A null or empty text is the end id alone, or nothing without one. Rows that repeat an id keep all
    their texts, in the order of a hash of the text; equal rows are all written. An empty table gives a folder without
    files that reads as no rows. Other columns and their names do not matter. The tokenised documents are written
    once under ``spark.checkpoint.dir`` (two bytes an id where the vocabulary allows) and removed at the end.
    """
    spark = register(docs.sparkSession)
    kind, data = tokens.read_tokenizer(tokenizer)
    shared = spark.sparkContext.broadcast((kind, data, tokens.prove(kind, data)))  # bounded by the vocabulary file
    size = 1 + max(_largest_id(kind, data), end_id or 0)
    width = 2 if size <= 1 << 16 else 4
    doc, text, turn, salt = (F.col(c) for c in ("doc", "text", "turn", "salt"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.select(doc, text, F.xxhash64(text).alias("turn"), F.rand(7).alias("salt"))  # rows that share doc and turn are alike: any order will do
    rows = rows.repartitionByRange(doc, turn, salt).sortWithinPartitions(doc, turn, salt).select(doc, text)
    coded = materialize(spark, rows.mapInArrow(_tokenise(shared, end_id, width), "run int, place long, doc_id long, ids binary"), compression="zstd")
    counts = coded.select("ids").mapInArrow(_counts(width, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(size, object)
    for r in counts:
        seen[r["id"]] = r["n"]
    _put(path, TABLE, Table.of(seen).to_bytes())
    coded.write.format("rans").option("width", width).option("maxFileIds", max_file_ids).mode("overwrite").save(path)
    remove_table(spark, coded)
    shared.destroy()


def _largest_id(kind: str, data: bytes) -> int:
    if kind == "model":
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=data).vocab_size() - 1
    from tokenizers import Tokenizer

    return max(Tokenizer.from_str(data.decode()).get_vocab(with_added_tokens=True).values(), default=0)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ``start`` (ids of all documents before it), n_tokens and ids of every document under ``path``."""
    return register(spark).read.format("rans").load(path)
