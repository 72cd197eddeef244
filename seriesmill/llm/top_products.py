"""Exact largest inner products: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ordering import positions
from .vectors import matrix, whole

#: Candidates and queries that meet in one task, and candidates compared in one step.
TILE, BLOCK, STEP = 4096, 1024, 512
#: Components stay below this, so that inner products of 512 components fit 64 bits.
MOST = 1 << 26
#: Stands for a missing id, which sorts last, and for "no bound yet".
NO_ID, NO_BOUND = (1 << 63) - 1, -(1 << 62)


def rotation(base: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of all vectors, as columns, those of the largest singular values first.

    They are the eigenvectors of the summed outer products: every task sends its
    own sum, dims x dims numbers, whatever the table.
    """
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column("v"), dims).astype(float)
            total += x.T @ x
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "x"])

    sums = base.select("v").mapInArrow(outer, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram = np.zeros((dims, dims))
    for row in sums.collect():
        gram[row["i"], row["j"]] = gram[row["j"], row["i"]] = row["x"]
    return np.linalg.eigh(gram)[1][:, ::-1]


class Best:
    """The k best candidates of each query so far, and the score a new one has to reach."""

    def __init__(self, asked: int, k: int, bound: np.ndarray):
        self.k, self.bound = k, bound.copy()
        self.query = self.id = self.score = np.zeros(0, np.int64)
        self.asked = asked

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in ((self.query, query), (self.id, ids), (self.score, score)))
        by = np.lexsort((ids, -score, query))
        query, ids, score = query[by], ids[by], score[by]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.query, self.id, self.score = query[kept], ids[kept], score[kept]
        full = rank == self.k - 1
        self.bound[query[full]] = np.maximum(self.bound[query[full]], score[full])


def search(
    queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, found: np.ndarray, ids: np.ndarray,
    turn: np.ndarray, k: int,
) -> Best:
    """The k best candidates of each query among ``found``, which come by descending length.

    A query leaves as soon as its length times that of the next candidate is
    below the score it has to reach.  For the others a growing number of
    rotated components is summed; what the rest can add is at most the product
    of the rest's lengths.  Only what may still reach the score is multiplied
    out, in whole numbers.  Bounds have a margin beyond rounding.
    """
    best = Best(len(queries), k, bound)
    if not len(queries) or not len(found):
        return best
    a, b = queries @ turn, found @ turn
    dims = a.shape[1]
    stages = sorted({max(1, dims // 8), max(1, dims // 2)})
    rest_a = np.sqrt(np.maximum(np.cumsum((a ** 2)[:, ::-1], 1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum(np.cumsum((b ** 2)[:, ::-1], 1)[:, ::-1], 0))
    margin = 1e-9 * rest_a[:, 0] * rest_b[:, 0].max() + 1e-6
    live = np.arange(len(queries))
    for lo in range(0, len(found), STEP):
        step = slice(lo, min(lo + STEP, len(found)))
        live = live[rest_a[live, 0] * rest_b[lo, 0] + margin[live] >= best.bound[live]]
        if not len(live):
            break
        first, wanted = stages[0], (best.bound[live] - margin[live])[:, None]
        partial = a[live, :first] @ b[step, :first].T
        near = partial + rest_a[live, first][:, None] * rest_b[None, step, first] >= wanted if first < dims \
            else partial >= wanted
        i, j = np.nonzero(near)
        sums = partial[i, j]
        for start, end in zip(stages, stages[1:]):
            sums = sums + np.einsum("ij,ij->i", a[live[i], start:end], b[lo + j, start:end])
            near = sums + rest_a[live[i], end] * rest_b[lo + j, end] >= wanted[i, 0]
            i, j, sums = i[near], j[near], sums[near]
        query, candidate = live[i], lo + j
        other = query_ids[query] != ids[candidate]
        query, candidate = query[other], candidate[other]
        score = np.einsum("ij,ij->i", queries[query], found[candidate])
        hit = score >= best.bound[query]
        best.add(query[hit], ids[candidate[hit]], score[hit])
    return best


def top_products(
    df: DataFrame, every: int = 50, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding",
    tile: int = TILE, block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of every query with the other rows.

    Components count as ``floor(scale * x)``.  Queries are the rows whose id
    ``every`` divides, candidates all rows with another id.  Ties go to the
    smaller id.

    1. Rows are ordered by descending length and cut into tiles, queries into
       blocks, so that a task holds at most ``tile`` and ``block`` of them.
    2. The first tile, ``tile`` rows, travels to all queries and gives each a score
       that its k-th best cannot be below.  Lengths then say how many tiles a
       query has to see: a beginning of the list.
    3. Each block meets each tile one of its queries has to see (``search``), and
       a query's best of all tiles are ranked.

    To the driver go dims x dims numbers, one length per tile and one number per
    block; lists of tiles and blocks travel with the tasks.

    Vectors that are NULL, empty, or hold a NULL or non-finite component take no
    part.  Vectors of different lengths stop the job, as do components of 2^26 or
    more after scaling.  A row with a NULL id is a candidate that sorts last.
    Rows that repeat an id are no candidates of each other; each repeated query
    is answered.  A query with fewer candidates than k has all of them, an empty
    table gives an empty result.  Other columns are not read.
    """
    spark = df.sparkSession
    kept = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("raw"))
    base = whole(kept, "raw", scale, MOST).select(
        F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), (F.col("vec_id") % every == 0).alias("asks"), "v",
        F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c).alias("size"))
    ordered = stored(positions(base, F.desc("size"), F.col("id"), name="place").withColumn(
        "tile", F.floor(F.col("place") / tile).cast("int")))
    one = ordered.select(F.size("v").alias("n")).first()
    if one is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = one["n"]
    turn = rotation(ordered, dims)
    lengths = np.sqrt(np.array([r["size"] for r in ordered.groupBy("tile").agg(
        F.max("size").alias("size")).orderBy("tile").collect()], float))
    top = ordered.where("tile = 0").orderBy("place").select("id", "v").collect()
    top_ids, top_rows = np.array([r["id"] for r in top]), np.array([r["v"] for r in top], np.int64)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                x = matrix(part.column("v"), dims)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                none = np.full(len(x), NO_BOUND)
                bound = search(x, ids, none, top_rows, top_ids, turn, k).bound
                size = np.sqrt((x.astype(float) ** 2).sum(1))
                # a tile may hold something if its longest vector can reach the score; a margin beyond rounding
                reach = bound / np.maximum(size, 1e-300) * (1 - 1e-9) - 1e-6
                reach = np.where(size == 0, np.where(bound > 0, np.inf, -np.inf), reach)
                tiles = len(lengths) - np.searchsorted(lengths[::-1], reach)
                yield pa.RecordBatch.from_arrays(
                    [part.column("ask"), part.column("id"), part.column("v"), pa.array(bound),
                     pa.array(tiles.astype(np.int32))], ["ask", "id", "v", "bound", "tiles"])

    asked = positions(ordered.where("asks").select("id", "v", "place"), F.col("place"), name="ask").select("ask", "id", "v")
    asked = stored(asked.mapInArrow(bounded, "ask long, id long, v array<long>, bound long, tiles int").withColumn(
        "block", F.floor(F.col("ask") / block).cast("int")))
    furthest = {r["block"]: r["tiles"] for r in asked.groupBy("block").agg(F.max("tiles").alias("tiles")).collect()}
    if not furthest:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tiles_of = F.lit([furthest[b] for b in range(len(furthest))])
    wanted = asked.where("tiles > 0").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    seen = ordered.select("tile", "place", "id", "v", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(len(furthest) - 1)), lambda b: F.get(tiles_of, b) > F.col("tile"))).alias("block"))

    def compare(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        candidates = candidates.sort_by("place")
        best = search(
            matrix(queries["v"], dims), queries["id"].to_numpy(), queries["bound"].to_numpy(),
            matrix(candidates["v"], dims), candidates["id"].to_numpy(), turn, k)
        return pa.table({
            "ask": queries["ask"].to_numpy()[best.query], "query_id": queries["id"].to_numpy()[best.query],
            "vec_id": best.id, "score": best.score})

    met = wanted.groupBy("block", "tile").cogroup(seen.groupBy("block", "tile")).applyInArrow(
        compare, "ask long, query_id long, vec_id long, score long")
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
