"""N-gram Jaccard self-join with multiple global orders.

A document is its set of distinct word shingles (64-bit hashes; the chance that two shingles of a compared
pair collide is below 1e-12 for sets of a thousand). If two sets reach the similarity, then under *any* total
order of the shingles their prefixes of n - ceil(t n) + 1 shingles meet. Three different orders are used, and a
pair is a candidate only if its prefixes meet in all; then its overlap is counted exactly.

Order m puts one residue class of shingles (hash modulo ``classes`` = m) first, rarest first, then all others
by hash. Places in the order bound what a pair can still share after the first shingle it meets at. Rarity is counted over all documents, but only that class has to be shuffled. The class holds more
shingles than a prefix needs, so frequent ones (shared passages, common phrases) stay out of the prefixes. A
shingle held by one document cannot meet anything: it takes up its place in the prefix and is not sent on, and
a document with a prefix's worth of such shingles, over all orders so far, is finished. Each order runs on what
the one before leaves.

Copies are joined before anything else (one representative of each equal set goes on). No list of documents is
ever turned into all its pairs:

1. in every list of documents sharing a prefix shingle, each is compared with the list's first one (as
   many comparisons as list entries), and the links found are joined into components;
2. lists whose documents are by then all in one component are done. Of short ones, the pairs that pass the
   filters (not connected, similar size, enough shingles left after the meeting, meeting in the other orders)
   are compared. Longer ones are cut into blocks, pairs of blocks are compared in tasks of bounded size,
   skipping what is already connected, and only the links that connect something leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.snapshot import materialize
from .common import free_names, ship
from .components import components

ORDERS = 3
MAX_BROADCAST_IDS = 1_000_000  # ids (48 bytes each at most) that a filter broadcasts; above, it is a shuffled join
BLOCK_DOCS = 1000
BLOCK_SHINGLES = 500_000
SHORT_LIST = 64  # documents; the pairs of shorter lists that pass all filters are compared one by one
BUNDLE = 4_000  # entries of short lists that a task filters at once, about
ROWS_AT_ONCE = 512

_MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; words are runs of anything but ASCII white space, A-Z lowered.

    A text of fewer words than ``width`` is one shingle, its whole sequence; one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    one = xxhash.xxh64_intdigest
    h = np.fromiter([one(w) for w in words], np.uint64, len(words))
    size = min(width, len(words))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - size + 1 + k] * _MULTIPLIERS[k % 64]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def prefix_length(n, percent: int):
    """n - ceil(n * percent / 100) + 1; for a number or a Column."""
    if isinstance(n, Column):
        return n - F.floor((n * percent + 99) / 100) + 1
    return n - (n * percent + 99) // 100 + 1


def _of_order(s: np.ndarray, order: int, classes: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's shingles of the order's class, and where these are too few for its prefix the others that fill it."""
    mine = s % np.uint64(classes) == np.uint64(order)
    first = s[mine]
    short = prefix_length(len(s), percent) - len(first)
    return first, s[~mine][:short] if short > 0 else s[:0]


def _keys(raw: list[bytes]) -> np.ndarray:
    """128-bit hashes of whole sets, as two signed columns."""
    return np.array([divmod(xxhash.xxh3_128_intdigest(r), 1 << 64) for r in raw], np.uint64).reshape(-1, 2).view(np.int64)


_TOP = np.uint64(1 << 63)  # flipped, unsigned hashes keep their order as signed numbers

_SETS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("tk", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()),
                   ("n0", pa.int32()), ("toks", pa.binary())])


def _to_sets(width: int, classes: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for b in batches:
            for a in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(a, ROWS_AT_ONCE)
                sets = [shingle_set(t.as_py(), width) for t in part.column(2)]
                raw = [s.tobytes() for s in sets]
                keys = _keys(raw)
                split = [_of_order(s, 0, classes, percent) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(rid, rid + len(raw))), part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(f) for f, _ in split], pa.int32()),
                    pa.array([f.tobytes() + r.tobytes() for f, r in split], pa.binary())], schema=_SETS)
                rid += len(raw)

    return run


def _again(width: int):
    """(hi, lo, sh) of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(a, ROWS_AT_ONCE)
                raw = [shingle_set(t.as_py(), width).tobytes() for t in part.column(0)]
                keys = _keys(raw)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(raw, pa.binary())], ["hi", "lo", "sh"])

    return run


def _to_tokens(order: int, classes: int, percent: int):
    """Rows (tok, rid, n, u, n0, rest) of sets given as (rid, n, u, n0, toks), or (rid, n, u, sh): the shingles of
    ``_of_order``. n0: number of class shingles; u: shingles that earlier orders found in no other set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(a, ROWS_AT_ONCE)
                rids, n, alone = (part.column(i).to_numpy() for i in range(3))
                if part.num_columns == 5:
                    toks = [np.frombuffer(raw.as_py(), np.uint64) for raw in part.column(4)]
                    n0 = part.column(3).to_numpy().astype(np.int64)
                    each = np.array([len(t) for t in toks], np.int64)
                else:
                    split = [_of_order(np.frombuffer(raw.as_py(), np.uint64), order, classes, percent) for raw in part.column(3)]
                    toks = [t for pair in split for t in pair]
                    n0 = np.array([len(f) for f, _ in split], np.int64)
                    each = n0 + np.array([len(r) for _, r in split], np.int64)
                flags = np.repeat(np.tile([False, True], len(n)), np.stack([n0, each - n0], 1).ravel())
                tok = (np.concatenate(toks) ^ _TOP).view(np.int64) if toks else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(np.repeat(rids, each)), pa.array(np.repeat(n, each).astype(np.int32)),
                                                  pa.array(np.repeat(alone, each).astype(np.int32)), pa.array(np.repeat(n0, each).astype(np.int32)), pa.array(flags)],
                                                 ["tok", "rid", "n", "u", "n0", "rest"])

    return run


def _prefixes(sets: DataFrame, order: int, classes: int, percent: int) -> DataFrame:
    """(tok, rid, pos, u): the prefix shingles under one order that at least two sets have in their prefixes, how
    many of a set's shingles come before (at least), and how many of them no other set has, by this order and
    those before. A set with too many of these has no partner and is left out. Written."""
    spark = sets.sparkSession
    given = ["n0", "toks"] if "toks" in sets.columns else ["sh"]
    tokens = sets.select("rid", "n", "u", *given).mapInArrow(_to_tokens(order, classes, percent), "tok long, rid long, n int, u int, n0 int, rest boolean")
    shared = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    # the others are cut off by hash in ``_of_order``, so their rarity must not move them
    place = F.when(F.col("rest"), 0).otherwise(F.col("df")).alias("place")
    lists = (tokens.join(shared, "tok").groupBy("rid")
             .agg(F.max("n").alias("n"), F.max("u").alias("u"), F.max("n0").alias("n0"), F.sort_array(F.collect_list(F.struct("rest", place, "tok"))).alias("all")))
    p = prefix_length(F.col("n"), percent)
    met = F.size(F.filter("all", lambda t: ~t["rest"]))
    lists = lists.select("rid", "n", "n0", "all", met.alias("met"), (F.col("u") + F.col("n0") - met).cast("int").alias("u")).where(F.col("u") < p)
    # class shingles of a single set come first and take up places
    room = F.when(F.col("n0") >= p, p - F.col("n0") + F.col("met")).otherwise(F.size("all"))
    prefix = lists.select("rid", "u", (F.col("n0") - F.col("met")).alias("before"), F.posexplode(F.slice("all", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).alias("i", "t"))
    prefix = prefix.select("t.tok", "rid", (F.col("before") + F.col("i")).cast("long").alias("pos"), "u")
    return _shared(materialize(spark, prefix))


def _shared(entries: DataFrame) -> DataFrame:
    """The entries whose shingle at least two sets have. Written."""
    common = entries.groupBy("tok").agg(F.count("*").alias("k")).where("k > 1").select("tok")
    return materialize(entries.sparkSession, entries.join(common, "tok"))


def _only(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose rid is (or with left_anti: is not) in ``ids``: a broadcast of checked size, else a shuffled join."""
    return rows.join(_small(ids), "rid", how)


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def _with_alone(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose rid is in ``ids``, with its ``u``; broadcast or shuffled as in ``_only``."""
    return rows.join(_small(ids), "rid")


def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def _meeting(pairs: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` that may link by their sizes and meet in the other orders too."""
    side = lambda s: others.select(F.col("rid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "most", "second", "third")])
    return (pairs.join(side("u"), "u").join(side("v"), "v")
            .where((F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent)
                   & (F.least("most_u", "most_v") * (100 + percent) >= (F.col("n_u") + F.col("n_v")) * percent)
                   & F.arrays_overlap("second_u", "second_v") & F.arrays_overlap("third_u", "third_v"))
            .select("u", "v"))


def _star_pairs(entries: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """(u, v), written: every list member with its list's first document, if they may link."""
    firsts = entries.groupBy("tok").agg(F.min("rid").alias("v"))
    pairs = entries.join(firsts, "tok").select(F.col("rid").alias("u"), "v").where("u != v").distinct()
    return materialize(entries.sparkSession, _meeting(pairs, others, percent))


def _candidates(rows: pd.DataFrame, percent: int, crossing: bool) -> Iterator[tuple[int, int]]:
    """Positions (i, j) within one list whose sets may link: not connected yet, of similar size, able to overlap
    enough from here on, and meeting in the other orders too. Labels may change between steps."""
    label, block, n, pos, most = (rows[c].to_numpy() for c in ("label", "block", "n", "pos", "most"))
    bit: dict[int, int] = {}
    masks, more = ([sum(1 << bit.setdefault(t, len(bit)) for t in toks) for toks in rows[c]] for c in ("second", "third"))
    for i in range(len(rows) - 1):
        near = (label[i + 1:] != label[i]) & (np.minimum(n[i + 1:], n[i]) * 100 >= np.maximum(n[i + 1:], n[i]) * percent)
        reach = np.minimum(np.minimum(n[i + 1:] - pos[i + 1:], n[i] - pos[i]), np.minimum(most[i + 1:], most[i]))
        near &= reach * (100 + percent) >= (n[i + 1:] + n[i]) * percent
        if crossing:
            near &= block[i + 1:] != block[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if masks[i] & masks[j] and more[i] & more[j] and label[i] != label[j]:
                yield i, j


def _pairs(percent: int):
    """Candidate pairs of many short lists by their first order, sizes and places."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tok", "rid"])
        edges = [0, *(np.flatnonzero(np.diff(rows["tok"].to_numpy())) + 1).tolist(), len(rows)]
        rid, label, n, pos, most = (rows[c].tolist() for c in ("rid", "label", "n", "pos", "most"))
        found = set()
        for first, last in zip(edges, edges[1:]):
            for j in range(first + 1, last):
                for i in range(first, j):
                    if label[i] == label[j] or min(n[i], n[j]) * 100 < max(n[i], n[j]) * percent:
                        continue
                    if min(n[i] - pos[i], n[j] - pos[j], most[i], most[j]) * (100 + percent) >= (n[i] + n[j]) * percent:
                        found.add((rid[j], rid[i]))
        return pd.DataFrame(sorted(found), columns=["u", "v"]).astype("int64")

    return run


def _compare(percent: int):
    """Links that connect something within one long list, or between two blocks of it. A pair that shares several
    first-order shingles is looked at in the list of the one that comes first in the order, where the bound by
    places holds (``first`` is in that order)."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid").reset_index(drop=True)
        rid, label, n = rows["rid"].to_numpy(), rows["label"].to_numpy(), rows["n"].to_numpy()
        firsts, members = rows["first"].tolist(), [set(x) for x in rows["first"]]
        found, flat, starts, marked = [], None, None, -1
        for i, j in _candidates(rows, percent, key[1] != key[2]):
            if next(t for t in firsts[i] if t in members[j]) != key[0]:
                continue
            if flat is None:
                sets = [np.frombuffer(x, np.uint64) for x in rows["sh"]]
                starts = np.cumsum([0] + [len(s) for s in sets])
                _, flat = np.unique(np.concatenate(sets), return_inverse=True)
                mark = np.zeros(flat.max() + 1, bool)
            if marked != i:
                mark[:] = False
                mark[flat[starts[i]:starts[i + 1]]] = True
                marked = i
            both = int(np.count_nonzero(mark[flat[starts[j]:starts[j + 1]]]))
            if both * 100 >= (int(n[i]) + int(n[j]) - both) * percent:
                found.append((rid[j], rid[i]))
                label[label == label[j]] = label[i]  # a view of the column that _candidates reads
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` that reach the similarity, by an exact count of their overlap."""
    side = lambda s: sets.select(F.col("rid").alias(s), F.col("n").alias(f"n_{s}"), F.col("sh").alias(f"sh_{s}"))
    checked = pairs.join(side("u"), "u").join(side("v"), "v").withColumn("both", F.pandas_udf(_overlap, "long")("sh_u", "sh_v"))
    return checked.where(F.col("both") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("both")) * percent).select("u", "v")


def _block_links(entries: DataFrame, sets: DataFrame, others: DataFrame, labels: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between documents that the star links left apart, so that all links connect alike."""
    spark = entries.sparkSession
    named = (entries.join(labels.select(F.col("node").alias("rid"), F.col("root")), "rid", "left")
             .join(others.select("rid", "n", "most"), "rid").select("tok", "rid", "pos", "n", "most", F.coalesce("root", "rid").alias("label")))
    named = materialize(spark, named)
    lists = (named.groupBy("tok").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("k"), F.sum("n").alias("s")).where("a != b")
             .select("tok", "k", F.greatest(F.ceil(F.col("k") / BLOCK_DOCS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("m")))
    open_lists = materialize(spark, named.join(lists, "tok"))

    short = open_lists.where(F.col("k") <= SHORT_LIST)
    bundles = max(1, short.count() // BUNDLE)
    short = short.withColumn("block", F.lit(0)).groupBy(F.pmod(F.xxhash64("tok"), F.lit(bundles)).alias("bundle"))
    pairs = short.applyInPandas(_pairs(percent), "u long, v long").distinct().join(tried, ["u", "v"], "left_anti")
    pairs = _meeting(pairs, others, percent)

    firsts = entries.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "tok")))["tok"].alias("first"))
    long = (open_lists.where(F.col("k") > SHORT_LIST).withColumn("block", F.pmod(F.xxhash64("rid", "tok"), F.col("m")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
            .select("tok", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "rid", "pos", "n", "most", "label", "block"))
    long = long.join(firsts, "rid").join(others.select("rid", "second", "third"), "rid").join(sets.select("rid", "sh"), "rid")
    return _verified(pairs, sets, percent).unionByName(long.groupBy("tok", "x", "y").applyInPandas(_compare(percent), "u long, v long"))


def _linked(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tk, n, hi, lo, ...) of every row, with tk the hash of its text and (hi, lo) that of its shingle set; and
    (hi, lo, component, root, known) of every set that another row has or that a link reaches. ``root`` tells components
    apart whose smallest ids (``component``) are the same."""
    if not 1 <= percent <= 99:
        raise ValueError("percent must be 1 to 99")
    spark = ship(docs.sparkSession)
    classes = max(ORDERS, 60 // (100 - percent))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keyed = source.withColumn("tk", F.xxhash64("text"))
    every = materialize(spark, keyed.select("doc_id", "tk", "text").mapInArrow(
        _to_sets(width, classes, percent), "rid long, doc_id long, tk long, n long, hi long, lo long, n0 int, toks binary"))

    equal = materialize(spark, every.where("n > 0").groupBy("hi", "lo").agg(F.min("rid").alias("first"), F.min("doc_id").alias("name"), F.count("*").alias("k")))
    copies = every.where("n > 0").select("rid", "hi", "lo").join(equal.where("k > 1"), ["hi", "lo"]).where("rid != first").select("rid")
    single = _only(every.where("n > 0"), copies, "left_anti").withColumn("u", F.lit(0))

    found = [_prefixes(single, 0, classes, percent)]
    # most documents are finished here; the whole sets of the others are made again from their texts
    ids = materialize(spark, _with_alone(single.drop("u"), found[0].select("rid", "u").distinct()).select("rid", "n", "u", "tk", "hi", "lo"))
    texts = keyed.join(_small(ids.select("tk").distinct()), "tk", "left_semi").select("text")
    sets = texts.mapInArrow(_again(width), "hi long, lo long, sh binary").dropDuplicates(["hi", "lo"])
    sets = materialize(spark, sets.join(_small(ids), ["hi", "lo"]).select("rid", "n", "u", "sh"))
    left = sets
    for order in range(1, ORDERS):
        found.append(_prefixes(left, order, classes, percent))
        left = _with_alone(sets.select("rid", "n", "sh"), materialize(spark, found[-1].select("rid", "u").distinct()))
    entries = _shared(_only(found[0].select("tok", "rid", "pos"), left.select("rid")))
    arrays = [f.groupBy("rid").agg(F.collect_list("tok").alias(c)) for f, c in zip(found[1:], ("second", "third"))]
    others = materialize(spark, left.select("rid", "n", (F.col("n") - F.col("u")).alias("most")).join(arrays[0], "rid").join(arrays[1], "rid"))

    tried = _star_pairs(entries, others, percent)
    star = components(materialize(spark, _verified(tried, left, percent)))
    more = materialize(spark, _block_links(entries, left, others, star, tried, percent))
    joined = _united(star, more)

    names = joined.join(equal.select(F.col("first").alias("node"), "name"), "node")
    names = names.join(names.groupBy("root").agg(F.min("name").alias("best")), "root").select(F.col("node").alias("first"), "best", "root")
    known = (equal.join(names, "first", "left").where("k > 1 OR best IS NOT NULL").select("hi", "lo", F.coalesce("best", "name").alias("component"),
                                                                                          F.coalesce("root", "first").alias("root"), F.lit(True).alias("known")))
    return every, materialize(spark, known)


def _united(star: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) of the components ``star`` (node, root) when the links ``more`` (u, v) join some of them: only
    what ``more`` touches goes through further rounds."""
    spark = star.sparkSession
    root = lambda s: star.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    ends = more.join(root("u"), "u", "left").join(root("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    joined = components(ends).withColumnsRenamed({"node": "of", "root": "to"})
    every = star.unionByName(joined.join(star, F.col("of") == F.col("node"), "left_anti").select(F.col("of").alias("node"), F.col("of").alias("root")))
    return materialize(spark, every.join(joined, F.col("root") == F.col("of"), "left").select("node", F.coalesce("to", "root").alias("root")))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``n_shingles`` (long) and ``component_id`` (long).

    Two documents link when 100 * |intersection| >= ``percent`` * |union| of their shingle sets (1 to 99);
    component_id is the smallest id reachable over links, the document's own included. A null or empty text, or
    one without words, has 0 shingles and links with nothing. Equal texts link, also under one id; repeated rows
    stay. Rows with a null id take part without giving a name; a component of nothing else is named null. Other
    columns are ignored; an empty table gives an empty one. Tables are written under ``spark.checkpoint.dir``.
    """
    every, known = _linked(docs, width, percent, id_col, text_col)
    out = every.select("doc_id", "n", "hi", "lo").join(known, ["hi", "lo"], "left")
    alone = (F.col("n") == 0) | F.col("known").isNull()
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id, among rows of that id the one with the
    smallest hash of its text; same columns.

    Each row is judged by its own text, also where ids repeat: rows of one id with texts that don't link all stay.
    Of several rows that stay with equal id and equal text one is kept. Rows with a null id have no name to be
    chosen by and stay, and so do those without shingles.
    """
    every, known = _linked(docs, width, percent, id_col, text_col)
    linked = materialize(docs.sparkSession, every.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "tk", "hi", "lo")
                         .join(known, ["hi", "lo"]).select("doc_id", "tk", "component", "root"))
    named = linked.where("doc_id = component").groupBy("root", "doc_id", "tk").agg(F.count("*").alias("k"))
    named = named.join(named.groupBy("root").agg(F.min("tk").alias("least")), "root")
    rid, tk, again_col = free_names(docs.columns, "_rid", "_tk", "_again")
    pair = [F.col("doc_id").alias(rid), F.col("tk").alias(tk)]
    away = linked.where("doc_id != component").select(*pair).unionByName(named.where("tk != least").select(*pair)).distinct()
    again = named.where("tk = least AND k > 1").select(*pair)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.select(*columns, F.col(f"`{id_col}`").cast("long").alias(rid), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias(tk))
    kept = kept.join(_small(away), [rid, tk], "left_anti")
    if again.isEmpty():
        return kept.select(*columns)
    marked = kept.join(again.withColumn(again_col, F.lit(True)), [rid, tk], "left")
    return marked.where(F.col(again_col).isNull()).unionByName(marked.where(F.col(again_col)).dropDuplicates([rid, tk])).select(*columns)
