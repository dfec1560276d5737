"""Exact top-k search by inner product as a Voronoi kNN join.

Pivots (k-means centres of a bounded sample) cut queries and data into Voronoi cells. Summaries then bound the
scores of a whole query cell. With pivot p and radius r around the cell's queries, every query q of the cell
has p.o - r|o| <= q.o <= p.o + r|o|:

* the k-th best lower bound among the data is a score T that every query of the cell reaches k times;
* a data cell (pivot c, radius R) whose upper bound p.c + |p|R + r(|c| + R) is below T is not needed by the
  query cell, and of the other data cells only the rows with p.o + r|o| >= T are.

Needed rows are replicated to the query cell, dealt over blocks of bounded size, and each block is solved by
one matrix product against the cell's queries. The blocks' top lists are merged by rank. Bounds are widened
by a relative 1e-9, so rounding never drops a row; results do not depend on pivots or blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshot import materialize
from .common import ship

SAMPLE = 4096  # vectors that pivots are fitted on
QUERIES_A_CELL = 256  # aimed at; a larger cell is dealt over several groups
MAX_PIVOTS = 512
ROWS_A_BLOCK = 8192
MIN_BLOCKS = 16
SLACK = 1e-9


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T).argmin(axis=1)


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct centres: four rounds of k-means from spread starting points."""
    points = np.unique(sample, axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)]
    for _ in range(4):
        cell = _nearest(points, centres)
        centres = np.array([points[cell == c].mean(axis=0) if (cell == c).any() else centres[c] for c in range(len(centres))])
    return centres


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """For every row of ``queries`` its ``k`` best rows of ``vectors`` by inner product: query_id, rank (from 1), ``id_col``, score (double).

    Both tables have a long id and a vector (array of numbers; whole numbers give exact scores up to 2^53). Rows
    with the query's own id are no candidates; ties go to the smaller id; fewer candidates give fewer rows. Rows
    with a null id, a null vector, or null or non-finite components take no part. Shorter vectors count as
    padded with zeros. Repeated candidates rank each for itself, repeated query rows give repeated lists; other
    columns are ignored; an empty table on either side gives no rows.
    """
    spark = ship(vectors.sparkSession)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & fine)

    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    data, asked = clean(vectors), clean(queries)
    n, dim = data.agg(F.count("*"), F.max(F.size("v"))).first()
    n_asked, dim_asked = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not n_asked:
        return empty
    dim = max(dim, dim_asked, 1)

    drawn = data.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").toPandas()["v"]  # a bounded, repeatable sample
    pivots = _pivots(_matrix(drawn, dim), int(np.clip(-(-n_asked // QUERIES_A_CELL), 1, MAX_PIVOTS)))
    shared = spark.sparkContext.broadcast(pivots)

    # ---- queries: cell, group inside the cell, radius
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"], dim)
            cell = _nearest(x, shared.value)
            yield b.assign(cell=cell.astype(np.int32), dist=np.sqrt(((x - shared.value[cell]) ** 2).sum(axis=1)))

    placed = materialize(spark, asked.withColumn("_q", F.monotonically_increasing_id()).mapInPandas(
        place, "id long, v array<double>, _q long, cell int, dist double"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).toPandas().sort_values("cell")  # one row a pivot
    used, radius = cells["cell"].to_numpy(), cells["r"].to_numpy() * (1 + SLACK)
    groups = -(-cells["n"].to_numpy() // QUERIES_A_CELL)  # of each used cell
    anchor = pivots[used]

    # ---- summaries of the data: each query cell's k + 1 best lower bounds, each data cell's radius
    bounds = spark.sparkContext.broadcast((pivots, anchor, radius))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, dict[int, float]] = {c: {} for c in range(len(anchor))}
        reach = np.full(len(pivots), -1.0)
        for b in batches:
            x = _matrix(b["v"], dim)
            cell = _nearest(x, pivots)
            np.maximum.at(reach, cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)))
            low = x @ bounds.value[1].T - np.sqrt((x**2).sum(axis=1))[:, None] * bounds.value[2]
            for c in range(len(anchor)):
                for i in np.argsort(-low[:, c], kind="stable")[:4 * (k + 1)]:
                    i_id = int(b["id"].iloc[i])
                    best[c][i_id] = max(best[c].get(i_id, -np.inf), low[i, c])
                best[c] = dict(sorted(best[c].items(), key=lambda e: -e[1])[:k + 1])
        rows = [(0, c, i, s) for c, found in best.items() for i, s in found.items()] + [(1, c, 0, r) for c, r in enumerate(reach) if r >= 0]
        yield pd.DataFrame(rows, columns=["kind", "c", "id", "x"])

    summary = data.mapInPandas(summarise, "kind int, c int, id long, x double")
    lows = (summary.where("kind = 0").groupBy("c", "id").agg(F.max("x").alias("x"))
            .withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("x")))).where(F.col("r") == k + 1))
    enough = np.full(len(anchor), -np.inf)
    for r in lows.collect():  # one row a pivot
        enough[r.c] = r.x
    reach = np.full(len(pivots), -1.0)
    for r in summary.where("kind = 1").groupBy("c").agg(F.max("x").alias("x")).collect():  # one row a pivot
        reach[r.c] = r.x
    norm = lambda a: np.sqrt((a**2).sum(axis=-1))
    highest = anchor @ pivots.T + norm(anchor)[:, None] * reach + radius[:, None] * (norm(pivots) + reach)
    need = (highest * (1 + SLACK) + np.abs(highest) * SLACK + SLACK >= enough[:, None]) & (reach >= 0)  # query cell x data cell

    # ---- replicate what a query cell needs, in blocks
    blocks = max(MIN_BLOCKS, -(-n // ROWS_A_BLOCK))
    plan = spark.sparkContext.broadcast((need, enough, groups))

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        need, enough, groups = plan.value
        turn = 0
        for b in batches:
            x = _matrix(b["v"], dim)
            cell, size = _nearest(x, pivots), np.sqrt((x**2).sum(axis=1))
            block = ((turn + np.arange(len(b))) % blocks).astype(np.int32)
            turn += len(b)
            for c in range(len(anchor)):
                top = x @ anchor[c] + radius[c] * size
                rows = np.flatnonzero(need[c][cell] & (top + np.abs(top) * SLACK + SLACK >= enough[c]))
                for g in range(groups[c] if len(rows) else 0):
                    yield pd.DataFrame({"id": b["id"].to_numpy()[rows], "v": b["v"].to_numpy()[rows], "cell": np.int32(c), "g": np.int32(g), "block": block[rows]})

    copies = data.mapInPandas(replicate, "id long, v array<double>, cell int, g int, block int")
    order = spark.createDataFrame(pd.DataFrame({"cell": used.astype(np.int32), "c": np.arange(len(used), dtype=np.int32), "m": groups.astype(np.int32)}), "cell int, c int, m int")
    asked_copies = (placed.join(F.broadcast(order), "cell")  # one row a pivot
                    .select("id", "v", "_q", F.col("c").alias("cell"), F.pmod(F.xxhash64("_q"), F.col("m")).cast("int").alias("g"),
                            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")))

    # ---- solve locally
    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(d):
            ids = d["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(d["v"].iloc[order], dim)
            for a in range(0, len(q), 64):
                part = q.iloc[a:a + 64]
                scores = _matrix(part["v"], dim) @ x.T
                for row, q_id, q_row in zip(scores, part["id"], part["_q"]):
                    row[ids == q_id] = -np.inf
                    if len(row) > 4 * k:  # everything at or above the k-th highest, ties included
                        at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                    else:
                        at = np.arange(len(row))
                    at = at[np.argsort(-row[at], kind="stable")][:k]
                    out += [(q_row, q_id, ids[i], row[i]) for i in at if row[i] > -np.inf]
        return pd.DataFrame(out, columns=["_q", "query_id", "id", "score"])

    keys = ["cell", "g", "block"]
    found = asked_copies.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(solve, "_q long, query_id long, id long, score double")
    best = Window.partitionBy("_q").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
