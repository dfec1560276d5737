"""Packing of documents into fixed-length token sequences by bounded-space online best-fit.

A packer keeps at most ``open_bins`` unfinished sequences. They are keyed by free space: one bit of an
integer per free space that some open bin has, and a stack of bins behind each bit. The best fit for a
piece is the lowest set bit at or above its length; if there is none a new bin opens, and when that
exceeds the bound the fullest bin closes first. Longer pieces of a batch are offered before shorter
ones, which a bounded packer rewards; nothing is held back between batches.

Level 1 runs inside the scan: each task encodes its documents, packs them as they come and writes the
rows of every bin that closes, so token ids are never shuffled. Pieces of a full sequence's length close
at once. What is still open when a task ends is marked, and level 2 packs those pieces again in groups of
about ``REGROUP`` pieces from all tasks, from their lengths only. At any input size the waste of bins
left open is thus one bounded set per ``REGROUP`` pieces.

Documents of several kinds (languages, say) can be kept apart: a packer for each kind, which share a task's
unfinished sequences, and level 2 groups of one kind each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshot import materialize
from . import tokens
from .common import ship

OPEN_BINS = 1024  # unfinished sequences of a packer; level 1 holds at most that many sequences' ids
REGROUP = 200_000  # pieces of a level 2 group, about: two numbers each
OFFERED = 2048  # pieces sorted together, longest first

PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class BestFit:
    """Bounded-space best-fit over bins of ``capacity``; ``place`` gives (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f is set: some open bin has f places free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0
        self.closed: list[int] = []  # bins closed since the caller last emptied this

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        found = stack.pop()
        if not stack:
            self.free ^= 1 << space
        return found

    def close_fullest(self) -> None:
        self.closed.append(self._take((self.free & -self.free).bit_length() - 1))
        self.n_open -= 1

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            found = self._take(space)
        else:
            if self.n_open == self.open_bins:
                self.close_fullest()
            space, found = self.capacity, self.n_bins
            self.n_bins += 1
            self.n_open += 1
        left = space - length
        if left:
            self.bins[left].append(found)
            self.free |= 1 << left
        else:
            self.closed.append(found)
            self.n_open -= 1
        return found, self.capacity - space


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, but for a shorter first piece."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


_RAW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                  ("sequence_id", pa.int64()), ("offset", pa.int64()), ("rid", pa.int64()), ("is_open", pa.bool_())])


def _level1(encoder_args, capacity: int, open_bins: int, end_id: int, kinds: bool):
    schema = _RAW.append(pa.field("kind", pa.string())) if kinds else _RAW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.worker_encoder(*encoder_args.value)
        part = TaskContext.get().partitionId() << 33
        fits: dict[str | None, BestFit] = {}  # by kind; all together keep ``open_bins`` bins
        held: dict[tuple[str | None, int], tuple[int, list[tuple]]] = {}  # (kind, bin): sequence and its rows
        rid = sequence = part
        n_open = 0
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out.clear()
            return made

        waiting: list[tuple] = []

        def close(kind: str | None) -> None:
            for done in fits[kind].closed:
                rows = held.pop((kind, done))[1]
                out.extend((*r, False, kind) if kinds else (*r, False) for r in rows)
            fits[kind].closed.clear()

        def offer() -> Iterator[pa.RecordBatch]:
            nonlocal rid, sequence, n_open
            waiting.sort(key=lambda r: -r[3])
            for doc_id, piece, start, length, ids, kind in waiting:
                if kind not in fits:
                    fits[kind] = BestFit(capacity, open_bins)
                fit = fits[kind]
                n_open -= fit.n_open
                found, offset = fit.place(length)
                n_open += fit.n_open
                if (kind, found) not in held:
                    held[kind, found] = (sequence, [])
                    sequence += 1
                into, rows = held[kind, found]
                rows.append((doc_id, piece, start, length, ids, into, offset, rid))
                rid += 1
                close(kind)
                if n_open > open_bins:  # only with several kinds
                    most = max(fits, key=lambda k: fits[k].n_open)
                    fits[most].close_fullest()
                    n_open -= 1
                    close(most)
                if len(out) >= 512:
                    yield batch()
            waiting.clear()

        for b in batches:
            for doc_id, text, kind in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist() if kinds else itertools.repeat(None)):
                ids = np.append(enc.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    waiting.append((doc_id, piece, start, length, ids[start:start + length].tobytes(), kind))
                    if len(waiting) >= OFFERED:
                        yield from offer()
        yield from offer()
        for (kind, _), (_, rows) in held.items():
            out.extend((*r, True, kind) if kinds else (*r, True) for r in rows)
            if len(out) >= 512:
                yield batch()
        if out:
            yield batch()

    return run


def _level2(capacity: int, open_bins: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fit = BestFit(capacity, open_bins)
        # an order free of the input's own, then longest first in runs that the open bins can serve
        pdf = pdf.sort_values("rid", key=lambda s: s * np.int64(-7046029254386353131)).reset_index(drop=True)
        per_run = max(1, int(open_bins * capacity / max(1.0, pdf.length.mean())))
        pdf = pdf.iloc[np.lexsort((-pdf.length.to_numpy(), np.arange(len(pdf)) // per_run))]
        placed = [fit.place(int(n)) for n in pdf.length]
        seqs, offsets = np.array(placed, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"rid": pdf.rid.to_numpy(), "sequence_id": -((int(key[0]) << 33) + seqs) - 1, "offset": offsets})

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS,
         id_col: str = "doc_id", text_col: str = "text", kind_col: str | None = None) -> DataFrame:
    """Pack every document's token ids, each followed by ``end_id``, into sequences of ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ``ids`` (little-endian unsigned 32-bit), sequence_id
    and offset; offsets within a sequence run gapless from 0. A null or empty text is the end id alone.
    Only documents longer than a sequence are cut; their first piece may be the shorter one. Repeated rows
    are packed each for itself, a null id stays null, other columns do not matter (nor their names), and an
    empty table gives no rows. The encoded pieces are written once under ``spark.checkpoint.dir``.
    With ``kind_col`` a sequence holds documents of one value of that column only (null is a value too), and
    the rows have it as a last column, as a string.
    """
    columns = [c.split()[0] for c in PIECES.split(", ")]
    if kind_col is not None and kind_col.lower() in columns:
        raise ValueError(f"kind_col can't be a column of the result: {kind_col}")
    spark = ship(docs.sparkSession)
    kind, data = tokens.read_tokenizer(tokenizer)
    shared = spark.sparkContext.broadcast((kind, data, tokens.prove(kind, data)))  # bounded by the vocabulary file
    kinds = [] if kind_col is None else [F.col(f"`{kind_col}`").cast("string")]
    raw = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"), *kinds).mapInArrow(
        _level1(shared, capacity, open_bins, end_id, bool(kinds)), PIECES + ", rid long, is_open boolean" + (", kind string" if kinds else ""))
    raw = materialize(spark, raw)
    left = raw.where("is_open")
    if kinds:
        # groups of one kind, numbered through: `first` is the number of groups of the kinds before, one row a kind
        groups = left.groupBy(F.col("kind").alias("_kind")).agg(F.greatest(F.lit(1), F.round(F.count("*") / REGROUP)).cast("long").alias("n"))
        before = F.sum("n").over(Window.orderBy("_kind").rowsBetween(Window.unboundedPreceding, -1))
        groups = groups.select("_kind", "n", F.coalesce(before, F.lit(0)).alias("first"))
        left = left.join(groups, F.col("kind").eqNullSafe(F.col("_kind"))).select("rid", "length", (F.col("first") + F.pmod(F.xxhash64("rid"), "n")).alias("g"))
    else:
        n_groups = max(1, round(left.count() / REGROUP))
        left = left.select("rid", "length", F.pmod(F.xxhash64("rid"), F.lit(n_groups)).alias("g"))
    again = left.groupBy("g").applyInPandas(_level2(capacity, open_bins), "rid long, sequence_id long, offset long")
    columns += [F.col("kind").alias(kind_col)] if kinds else []
    return (raw.where("NOT is_open").select(*columns)
            .unionByName(raw.where("is_open").drop("sequence_id", "offset").join(again, "rid").select(*columns)))
