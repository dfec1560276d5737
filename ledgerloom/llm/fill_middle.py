"""Fill-in-the-middle transformation over a boundary set built like a Roaring bitmap.

A text is cut into units, left to right over code points: a run of the letters A-Z and a-z, or any other single code
point. The offsets at which a document may be cut (0 and every unit's end) form a ``BoundarySet``: offsets are grouped
by their upper 16 bits into containers, each stored as whichever of three is smallest: a sorted *array* of lower halves,
a *bitmap* of 1,024 words, or *runs* (first, last). Cumulative cardinalities over the containers turn "the k-th boundary"
into a binary search for its container and a select inside it, and ``cuts`` gives both offsets of a document.

Where a document is cut, and in which form it is written, depends on its id alone (``draws``: groups of a SHA-256 of a
seed and the id), so a repeated or recomputed task gives the same output. Rows are independent: no shuffle.

Forms: *psm* is ``<P>prefix<S>suffix<M>middle``, *spm* is ``<S>suffix<P>prefix<M>middle``, *plain* is the text itself. No marker
overlaps another or itself, and texts that hold one stay plain, so ``restore`` finds the parts again by the first places
of the markers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

MARKERS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
ARRAY, BITMAP, RUN = "array", "bitmap", "run"
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


class BoundarySet:
    """A set of offsets below 2**32 with select; built from ascending distinct offsets."""

    def __init__(self, offsets: np.ndarray):
        upper = (offsets >> 16).astype(np.int64)
        edges = np.flatnonzero(np.diff(upper)) + 1
        self.keys = upper[np.r_[0, edges]] if len(offsets) else upper
        self.containers = [self._container((part & 0xFFFF).astype(np.uint16)) for part in np.split(offsets, edges)] if len(offsets) else []
        self.cumulative = np.cumsum([c[2] for c in self.containers], dtype=np.int64)

    @staticmethod
    def _container(low: np.ndarray) -> tuple[str, object, int]:
        breaks = np.flatnonzero(np.diff(low.astype(np.int32)) != 1)
        sizes = {ARRAY: 2 * len(low), BITMAP: 8192, RUN: 4 * (len(breaks) + 1)}
        kind = min(sizes, key=sizes.__getitem__)
        if kind == ARRAY:
            return kind, low, len(low)
        if kind == RUN:
            return kind, (low[np.r_[0, breaks + 1]], low[np.r_[breaks, len(low) - 1]]), len(low)
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        return kind, np.packbits(bits, bitorder="little").view("<u8"), len(low)

    def __len__(self) -> int:
        return int(self.cumulative[-1]) if len(self.cumulative) else 0

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        i = int(np.searchsorted(self.cumulative, k, "right"))
        kind, data, size = self.containers[i]
        return int(self.keys[i]) << 16 | self._select(kind, data, k - (int(self.cumulative[i]) - size))

    @staticmethod
    def _select(kind: str, data, k: int) -> int:
        if kind == ARRAY:
            return int(data[k])
        if kind == RUN:
            first, last = (a.astype(np.int64) for a in data)
            ends = np.cumsum(last - first + 1)
            r = int(np.searchsorted(ends, k, "right"))
            return int(last[r]) - int(ends[r] - 1 - k)
        ends = np.cumsum(np.bitwise_count(data), dtype=np.int64)
        w = int(np.searchsorted(ends, k, "right"))
        word, left = int(data[w]), k - (int(ends[w - 1]) if w else 0)
        for _ in range(left):
            word &= word - 1  # drops the lowest bit
        return 64 * w + (word & -word).bit_length() - 1

    def cuts(self, a: int, b: int) -> tuple[int, int]:
        """Offsets of the boundaries numbered ``a`` and ``b``, the smaller first."""
        return self.select(min(a, b)), self.select(max(a, b))


def boundaries(text: str) -> BoundarySet:
    """Offset 0 and the end of every unit, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    folded = points | 32
    letter = (folded >= 97) & (folded <= 122) & (points < 128)
    inside = letter[:-1] & letter[1:]  # between two letters there is no boundary
    return BoundarySet(np.r_[0, np.flatnonzero(~inside) + 1, len(points)] if len(points) else np.zeros(1, np.int64))


def draws(doc_id: int | None, seed: str = "1") -> tuple[int, int, int, int]:
    """Four 32-bit numbers that depend on the id alone; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4))


def _transform(markers: tuple[str, str, str], middle_percent: int, spm_percent: int, seed: str):
    p, s, m = markers

    def one(doc_id: int | None, text: str) -> tuple:
        h1, h2, h3, h4 = draws(doc_id, seed)
        places = boundaries(text)
        n = len(places) - 1
        if not text or any(x in text for x in markers) or h3 % 100 >= middle_percent:
            return n, "plain", None, None, text
        a, b = places.cuts(h1 % (n + 1), h2 % (n + 1))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm_percent:
            return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [one(d.as_py(), t.as_py() or "") for d, t in zip(part.column(0), part.column(1))]
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*made), types))],
                                                 names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", middle_percent: int = 90, spm_percent: int = 20,
                   seed: str = "1", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain) and output of every row.

    A text is plain when it is null or empty (output empty), holds a marker, or its third draw leaves it out
    (``100 - middle_percent`` of documents); of the others ``spm_percent`` are spm and the rest psm. Ids must be integers
    or null (other types are cast to long; text that is no number is an error); rows that share an id and a text get
    the same output, each for itself. An empty table gives no rows. Other columns, and their names, do not matter.
    Markers must differ, be non-empty and not overlap one another (checked).
    """
    _check(markers)
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_transform(tuple(markers), middle_percent, spm_percent, seed), "doc_id long, " + SCHEMA)


def _check(markers: tuple[str, str, str]) -> None:
    for x in markers:
        for y in markers:
            overlap = any(x.endswith(y[:k]) for k in range(1, min(len(x), len(y)) + (x != y)))
            if not x or overlap or (x != y and x in y) or len(set(markers)) < 3:
                raise ValueError(f"markers {x!r} and {y!r} overlap")


def restore(output: str | Column, form: str | Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of the given form was made from, rebuilt from the output alone (built-in functions)."""
    out = F.col(output) if isinstance(output, str) else output
    kind = F.col(form) if isinstance(form, str) else form
    p, s, m = markers

    def joined(first: str, second: str, prefix_first: bool) -> Column:
        # the parts end at the first place of the marker that follows them
        at = lambda x, start: F.locate(x, out, start) if isinstance(start, int) else F.call_function("locate", F.lit(x), out, start)
        a = len(first) + 1
        b = at(second, a)
        c = at(m, b + len(second))
        one = out.substr(F.lit(a), b - a)
        two = out.substr(b + len(second), c - b - len(second))
        middle = out.substr(c + len(m), F.length(out))
        return F.concat(one, middle, two) if prefix_first else F.concat(two, middle, one)

    return F.when(kind == "psm", joined(p, s, True)).when(kind == "spm", joined(s, p, False)).otherwise(out)
