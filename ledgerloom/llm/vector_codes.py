"""Product-quantised vector codes, trained and assigned exactly through memoised grid cells.

A vector of integers is cut into equal parts; every part position has a codebook and a part's code is the nearest entry
(squared Euclidean distance, ties to the lower index). To find it without measuring all entries:

* the part's coarse cell is its components shifted right (a box of side ``2**shift``), hashed to 64 bits;
* a memo holds, for each cell seen by this task, the entries not dominated across its box: an entry is left out when its
  smallest distance to the box is larger than another entry's largest distance to it, so ties always survive;
* only the entries kept for a cell are measured for the parts inside it. A cell that is new, or whose hash another cell
  holds, is worked out anew (memos compare the cell's coordinates, never the hash alone).

``shift`` follows from the codebook (``cell_shift``): boxes of about a quarter of the entries' spread. Memos are bounded
(``MEMO_CELLS`` a part, in two generations) and change speed only.

Training runs a fixed number of rounds. In each, tasks send one row of exact integer sums for each (part, entry) that they
met, Spark adds them, and the driver divides: it never holds more than parts x entries rows. The integer vectors are
written once under ``spark.checkpoint.dir`` and read again in each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.snapshot import materialize
from .common import ship

MEMO_CELLS = 1 << 15  # cells of a generation, for each part position
ROWS_AT_ONCE = 4096
LIMIT = 1 << 27  # components beyond it could overflow a distance
_MIX = np.uint64(0x9E3779B97F4A7C15)


def cell_shift(entries: np.ndarray) -> int:
    """log2 of a box's side: a power of two at or below a quarter of the entries' largest standard deviation, at least 1."""
    spread = float(entries.std(axis=0).max()) if entries.size else 0.0
    return max(0, int(max(1.0, spread / 4)).bit_length() - 1)


class CellMemo:
    """The entries of one part position's codebook that a cell's parts must be measured against."""

    def __init__(self, entries: np.ndarray, shift: int | None = None, size: int = MEMO_CELLS):
        self.entries, self.size = entries, size
        self.shift = cell_shift(entries) if shift is None else shift
        width = entries.shape[1]
        with np.errstate(over="ignore"):
            self.mix = np.cumprod(np.full(width, _MIX, np.uint64)) | np.uint64(1)
        self.young: dict[int, tuple[bytes, np.ndarray]] = {}
        self.old: dict[int, tuple[bytes, np.ndarray]] = {}
        self.measured = 0  # distances worked out so far

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        low = (cells << self.shift)[:, None, :]
        high = low + ((1 << self.shift) - 1)
        near = (np.maximum(np.maximum(low - self.entries, self.entries - high), 0) ** 2).sum(2)
        far = (np.maximum(abs(self.entries - low), abs(self.entries - high)) ** 2).sum(2)
        return near <= far.min(1)[:, None]

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """(parts, entries) booleans: what must be measured."""
        cells = parts >> self.shift
        with np.errstate(over="ignore"):
            hashes = (cells.astype(np.uint64) * self.mix).sum(1, dtype=np.uint64)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        found = np.empty((len(keys), len(self.entries)), bool)
        missing = []
        for i, (key, at) in enumerate(zip(keys.tolist(), first.tolist())):
            held = self.young.get(key)
            if held is None and (held := self.old.get(key)) is not None:
                self._keep(key, held)
            if held is not None and held[0] == cells[at].tobytes():
                found[i] = held[1]
            else:
                missing.append(i)
        if missing:
            at = first[missing]
            found[missing] = self._undominated(cells[at])
            for i, a in zip(missing, at):
                self._keep(int(keys[i]), (cells[a].tobytes(), found[i].copy()))
        out = found[which]
        strangers = (cells[first][which] != cells).any(1)  # another cell with the same hash came first
        if strangers.any():
            out[strangers] = self._undominated(cells[strangers])
        return out

    def _keep(self, key: int, value: tuple[bytes, np.ndarray]) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances) of (n, width) integer parts."""
        row, entry = np.nonzero(self.candidates(parts))
        self.measured += len(row)
        away = ((parts[row] - self.entries[entry]) ** 2).sum(1)
        starts = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(away, starts) if len(parts) else np.zeros(0, np.int64)
        hit = np.flatnonzero(away == least[row])
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]] if len(hit) else hit
        return entry[hit], least


@dataclass
class Codebooks:
    """``entries``: integers, (parts, entries, components of a part)."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def whole_vectors(df: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """Rows whose vector is not null and holds only finite components, these as ``floor(scale * x)``."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    there = df.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return there.withColumn(vector_col, F.transform(v, lambda x: F.floor(x * scale)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _sums(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [CellMemo(b) for b in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                x = _matrix(b.column(0).slice(at, ROWS_AT_ONCE), parts * width)
                for p, memo in enumerate(memos):
                    piece = x[:, p * width:(p + 1) * width]
                    code, _ = memo.nearest(piece)
                    np.add.at(total[p], code, piece)
                    count[p] += np.bincount(code, minlength=entries)
        p, e, c = (a.reshape(-1) for a in np.indices(books.shape))
        n = np.broadcast_to(count[:, :, None], books.shape).reshape(-1)
        met = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(a[met], pa.int64()) for a in (p, e, c, total.reshape(-1), n)], names=["p", "e", "c", "s", "n"])

    return run


def _assign(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [CellMemo(b) for b in books]
        for b in batches:
            x = _matrix(b.column(b.schema.get_field_index("v")), parts * width)
            codes, error = np.zeros((len(x), parts), np.int32), np.zeros(len(x), np.int64)
            for p, memo in enumerate(memos):
                for at in range(0, len(x), ROWS_AT_ONCE):
                    codes[at:at + ROWS_AT_ONCE, p], away = memo.nearest(x[at:at + ROWS_AT_ONCE, p * width:(p + 1) * width])
                    error[at:at + ROWS_AT_ONCE] += away
            lists = pa.ListArray.from_arrays(pa.array(range(0, codes.size + 1, parts), pa.int32()), pa.array(codes.reshape(-1)))
            rest = [b.column(i) for i, f in enumerate(b.schema) if f.name != "v"]
            yield pa.RecordBatch.from_arrays([*rest, lists, pa.array(error)], names=[*(f.name for f in b.schema if f.name != "v"), "codes", "error"])

    return run


def encode_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = 8,
                   entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """(codes, codebooks): one row (id, label, ``codes`` array<int>, ``error`` long) for each vector that takes part.

    Components become ``floor(scale * x)``. The codebooks start as the parts of the ``entries`` smallest ids (ties by the
    vector itself, null ids first) and are trained ``rounds`` times on all vectors: nearest entry, then the floor of the
    mean; unused entries stay. Vectors that are null, hold a null or non-finite component, or whose length is not that
    of the smallest id's vector take no part; a common length that ``parts`` does not divide, or a component beyond
    ``LIMIT`` after scaling, is a ``ValueError``. Repeated rows and ids are coded each for itself; fewer vectors than
    ``entries`` give as many entries as there are vectors; an empty table gives no rows and empty codebooks. Other
    columns of ``df`` do not matter, nor their names.
    """
    spark = ship(df.sparkSession)
    label = F.lit(None).cast("int") if label_col is None else F.col(f"`{label_col}`")
    rows = whole_vectors(df.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), F.col(f"`{vector_col}`").alias("v")), "v", scale)
    rows = materialize(spark, rows)
    found = rows.select(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]
    if found is not None and found > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT} / {scale}")
    first = rows.orderBy("id", "v").limit(entries).collect()
    if not first:
        empty = rows.select("id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")).where("false")
        return empty, Codebooks(np.zeros((parts, 0, 0), np.int64))
    length = len(first[0]["v"])
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    if rows.where(F.size("v") != length).limit(1).count():
        rows = rows.where(F.size("v") == length)
        first = rows.orderBy("id", "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = books.copy()
        for r in rows.select("v").mapInArrow(_sums(books), "p long, e long, c long, s long, n long").groupBy("p", "e", "c").agg(
                F.sum(F.col("s").cast("decimal(20,0)")).alias("s"), F.sum("n").alias("n")).collect():
            books[r["p"], r["e"], r["c"]] = int(r["s"]) // r["n"]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = rows.mapInArrow(_assign(books), f"id {kind['id']}, label {kind['label']}, codes array<int>, error long")
    return coded, Codebooks(books)


def hex_code(codes: str | Column) -> Column:
    """Codes as two lower-case hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the error summed over all rows of the same label, null labels together.

    The sums are combined before the shuffle, and what is joined back is one row a label.
    """
    coded = materialize(coded.sparkSession, coded)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
