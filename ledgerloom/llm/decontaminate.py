"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scanned over training text.

Benchmark items are normalised (A-Z lowered, runs of ASCII letters, digits and non-ASCII characters are
words) and cut into windows of ``n`` words; an item of fewer words is one window of its own length. The
windows' 64-bit hashes travel to every task, with the exact windows behind them. A task turns a batch of
texts into one array of word numbers (0: a word that no item has), hashes the windows free of zeros by a
few array operations, looks them up, and verifies every hit word by word. Documents are never shuffled.

The benchmark side is broadcast in blocks of at most ``BLOCK_BYTES`` of text, whatever its size: each
block is one pass over the documents that adds to the hits found so far, and passes are cut by a written
table, so no task ever holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshot import materialize
from .common import ship

BLOCK_BYTES = 8_000_000  # benchmark text broadcast at once
TEXTS_AT_ONCE = 256

#: bytes -> lower-cased word byte or space; every byte of a non-ASCII character is 0x80 or more
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def _coefficients(n: int) -> np.ndarray:
    return np.random.default_rng(n).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WindowSet:
    """Windows of benchmark items by length, as sorted hashes and, behind each hash, exact windows and items."""

    def __init__(self, items: list[tuple], n: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, list]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                found = by_length.setdefault(size, {}).setdefault(tuple(ids[i:i + size]), [])
                if not found or found[-1] != item_id:
                    found.append(item_id)
        self.by_length = {}
        for size, windows in by_length.items():
            keys = np.array(list(windows), np.uint64).reshape(-1, size)
            hashes = (keys * _coefficients(size)).sum(axis=1, dtype=np.uint64)
            self.by_length[size] = (np.unique(hashes), windows)

    def scan(self, texts: list) -> tuple[list[int], list[list], list[list]]:
        """Word counts, merged hit spans [first word, last word + 1) and item ids of each text."""
        cut = [words(t) for t in texts]
        counts = [len(w) for w in cut]
        starts = np.cumsum([0] + [c + 1 for c in counts])  # a zero between texts: no window crosses
        flat = np.zeros(starts[-1], np.uint64)
        number = self.vocabulary.get
        for s, w in zip(starts, cut):
            flat[s:s + len(w)] = [number(x, 0) for x in w]
        unknown = np.concatenate([[0], np.cumsum(flat == 0)])
        spans: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        for size, (hashes, windows) in sorted(self.by_length.items()):
            at = np.flatnonzero(unknown[size:] == unknown[:-size]) if len(flat) >= size else np.array([], np.int64)
            if not len(at):
                continue
            keys = np.zeros(len(at), np.uint64)
            for k, c in enumerate(_coefficients(size)):
                keys += flat[at + k] * c
            near = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            for i in at[hashes[near] == keys].tolist():
                if found := windows.get(tuple(flat[i:i + size].tolist())):
                    doc = int(np.searchsorted(starts, i, side="right")) - 1
                    items[doc].update(found)
                    spans[doc].append((i - int(starts[doc]), i - int(starts[doc]) + size))
        return counts, [_merged(s) for s in spans], [list(s) for s in items]


def _merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without_spans(text: str, spans) -> str:
    """The text without the words of ``spans`` and the characters between two words of a span."""
    raw = text.encode("utf-8", "surrogatepass")
    plain = raw.translate(_WORD_BYTES)
    out, kept, at, index = [], 0, 0, 0
    wanted = {a: "a" for a, _ in spans}
    lasts = {b - 1 for _, b in spans}
    for w in plain.split():
        first = plain.index(w, at)
        at = first + len(w)
        if index in wanted:
            out.append(raw[kept:first])
        if index in lasts:
            kept = at
        index += 1
    out.append(raw[kept:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_BYTES (a larger single item is a block), streamed to the driver one by one."""
    rows = benchmark.select(F.col(f"`{item_id}`"), F.col(f"`{text}`").cast("string"))
    total = rows.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    block, size = [], 0
    for r in (rows.collect() if total <= BLOCK_BYTES else rows.toLocalIterator()):
        block.append((r[0], r[1]))
        size += len((r[1] or "").encode())
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` (long), ``hit_spans`` (array of [first, last + 1) word positions, merged)
    and ``hit_items`` (array of benchmark ids whose windows occur).

    A null or empty text has no words; items without words have no window; copies of an item count each
    under its id. Null item ids are never listed, but their windows still hit. Repeated documents are
    judged each for itself, an empty table on either side gives no hits. Columns of ``docs`` pass through;
    those already named like an output column are replaced.
    """
    spark = ship(docs.sparkSession)
    item_type = benchmark.select(item_id).dtypes[0][1]
    spare = [c for c in docs.columns if c not in ("n_words", "hit_spans", "hit_items")]
    out = docs.select(*[F.col(f"`{c}`") for c in spare], F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<array<int>>").alias("hit_spans"), F.array().cast(f"array<{item_type}>").alias("hit_items"))
    for i, block in enumerate(_blocks(benchmark, item_id, item_text)):
        if i:
            out = materialize(spark, out)
        shared = spark.sparkContext.broadcast(WindowSet(block, n))
        out = _pass(out, spare, text_col, shared)
    return out


def _pass(frame: DataFrame, spare: list[str], text_col: str, shared) -> DataFrame:
    """One block's pass. A struct-returning Pandas UDF sees the text and the hits so far, no other column."""
    items = dict(frame.dtypes)["hit_items"]

    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        windows = shared.value
        for texts, spans, found in batches:
            parts = []
            for a in range(0, len(texts), TEXTS_AT_ONCE):
                part = slice(a, a + TEXTS_AT_ONCE)
                counts, new, ids = windows.scan([t if isinstance(t, str) else None for t in texts[part]])
                parts.append(pd.DataFrame({
                    "n_words": counts,
                    "hit_spans": [_merged([*map(tuple, old), *map(tuple, s)]) for old, s in zip(spans[part], new)],
                    "hit_items": [sorted({*old, *(x for x in i if x is not None)}) for old, i in zip(found[part], ids)]}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"n_words": [], "hit_spans": [], "hit_items": []})

    schema = f"n_words long, hit_spans array<array<int>>, hit_items {items}"
    hits = F.pandas_udf(scan, schema)(F.col(f"`{text_col}`").cast("string"), F.col("hit_spans"), F.col("hit_items"))
    kept = [F.col(f"`{c}`") for c in spare]
    return frame.select(*kept, hits.alias("_hits")).select(*kept, "_hits.n_words", "_hits.hit_spans", "_hits.hit_items")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """``docs`` without hits: ``remove='documents'`` drops hit documents, ``'spans'`` cuts the hit words out of
    the text (a string column) and keeps the document. Same columns as ``docs``; see ``find_contamination``."""
    text_col = options.get("text_col", "text")
    found = find_contamination(docs, benchmark, **options)
    if remove == "documents":
        return found.where(F.size("hit_spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns if c in found.columns])
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(s) else without_spans(t, s) for t, s in zip(texts, spans)], dtype=object)

    cleaned = F.when(F.size("hit_spans") > 0, F.pandas_udf(cut, "string")(F.col(f"`{text_col}`"), F.col("hit_spans"))).otherwise(F.col(f"`{text_col}`"))
    return found.withColumn(text_col, cleaned).select(*[F.col(f"`{c}`") for c in docs.columns])
