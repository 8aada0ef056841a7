"""Exact top-k by inner product as a Voronoi join.

Inner products become distances by one more component that lifts all vectors to one norm, so the nearest lifted
neighbours of a query are those with the largest products.

1. ``pivots`` vectors (those with the smallest id hash) are broadcast. Every vector goes to the cell of its nearest pivot.
2. Cells are summarised: size, radius, and the k+1 smallest distances to the pivot. From the summaries alone each query
   gets an upper bound on the distance of its k-th neighbour, and so a list of the cells that can hold a neighbour:
   those whose pivot is nearer than bound plus radius.
3. Cells are cut into blocks of about ``block`` vectors and queries into groups of about ``block``. A query group is
   copied to the blocks of its cells only, and each (block, group) is solved by one matrix product; a group's rows never
   exceed those two bounds by much, however large a cell or a set of equal vectors is.
4. The winners of the blocks are merged per query.

Products are exact: components are integers, and sums that float64 cannot hold exactly are done in Python integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdtide.llm.registry import register, table
from crowdtide.sources.storage import settle


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; only whole vectors of finite components, with an id."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    parts = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width; missing components are 0."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Exact integer products, as int64."""
    if q.shape[1] == 0 or np.abs(q).max(initial=0) * np.abs(s).max(initial=0) * q.shape[1] < 2**53:
        return (q @ s.T).astype(np.int64)
    ends = np.iinfo(np.int64)
    return np.clip(q.astype(object) @ s.T.astype(object), ends.min, ends.max).astype(np.int64)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, pivots: int = 64, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best of all other vectors for each id divisible by ``every``.

    Score: inner product of floor(scale * x), ties to the smaller vec_id. Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part. A vector shorter than another counts as ending in
    zeros. Of rows that repeat an id the least vector counts, once. With fewer candidates than ``k`` all are
    returned. Scores beyond 64 bits count as the largest or smallest number of 64 bits. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = settle(scaled(vectors, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    shape = rows.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("top"), F.count("*").alias("n")).first()
    width, top = shape["width"] or 0, math.sqrt(shape["top"] or 0.0)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toPandas()
    centre = np.unique(_matrix(chosen["v"], width), axis=0)

    def lift(x: np.ndarray, data: bool) -> np.ndarray:
        rest = np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", x, x), 0)) if data else np.zeros(len(x))
        return np.hstack([x, rest[:, None]])

    shared = spark.sparkContext.broadcast(lift(centre, True))
    slack = 1e-9 * (top + 1)

    def distances(x: np.ndarray) -> np.ndarray:
        p = shared.value
        d = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", p, p)[None, :] - 2 * x @ p.T
        return np.sqrt(np.maximum(d, 0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = distances(lift(_matrix(pdf["v"], width), True))
            cell = np.argmin(d, axis=1)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "cell": cell.astype(np.int32), "d": d[np.arange(len(d)), cell]})

    placed = settle(rows.mapInPandas(assign, "vec_id long, v array<long>, cell int, d double"), "cells")
    near = Window.partitionBy("cell").orderBy("d")
    nearest = placed.select("cell", "d").withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).select("cell", "d").toPandas()
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).toPandas()
    summary = spark.sparkContext.broadcast((sizes["cell"].to_numpy(), sizes["radius"].to_numpy(), nearest["cell"].to_numpy(), nearest["d"].to_numpy()))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells that can hold a neighbour of each query."""
        cells, radius, near_cell, near_d = summary.value
        for pdf in batches:
            d = distances(lift(_matrix(pdf["v"], width), False))
            reach = d[:, near_cell] + near_d[None, :]
            take = min(k + 1, reach.shape[1]) - 1  # one of them may be the query itself
            bound = np.partition(reach, take, axis=1)[:, take] if reach.shape[1] > k else np.full(len(pdf), np.inf)
            wanted = d[:, cells] - radius[None, :] <= bound[:, None] + slack
            q, c = np.nonzero(wanted)
            yield pd.DataFrame({"query_id": pdf["vec_id"].to_numpy()[q], "q": pdf["v"].to_numpy()[q], "cell": cells[c].astype(np.int32)})

    queries = rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    routed = queries.mapInPandas(route, "query_id long, q array<long>, cell int")
    groups = max(1, math.ceil((shape["n"] or 0) / every / block))
    blocks = {int(c): max(1, math.ceil(n / block)) for c, n in zip(sizes["cell"], sizes["n"], strict=True)}
    n_blocks = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[F.col("cell")] if blocks else F.lit(1)
    q_side = routed.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    s_side = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def solve(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        s = s.sort_values("vec_id")
        ids, data = s["vec_id"].to_numpy(), _matrix(s["v"], width)
        out = []
        for start in range(0, len(q), 512):
            part = q.iloc[start : start + 512]
            own = part["query_id"].to_numpy()
            score = _products(_matrix(part["q"], width), data)
            allowed = own[:, None] != ids[None, :]
            # candidates no worse than the k-th score, then exact order among them
            ranked = np.where(allowed, score, np.iinfo(np.int64).min)
            least = np.partition(ranked, -k, axis=1)[:, -k] if ranked.shape[1] > k else np.full(len(part), np.iinfo(np.int64).min)
            i, j = np.nonzero((ranked >= least[:, None]) & allowed)
            order = np.lexsort((ids[j], -score[i, j], i))
            i, j = i[order], j[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[place < k], j[place < k]
            out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "score": score[i, j]}))
        return pd.concat(out)

    keys = ["cell", "block", "part"]
    solved = q_side.groupBy(*keys).cogroup(s_side.select("vec_id", "v", *keys).groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@register("op8_exact_top_k", ORACLE)
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
