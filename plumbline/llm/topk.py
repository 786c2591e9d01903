"""Exact top-k by inner product: term-at-a-time accumulation over blocks of candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Rows of a block of candidates and of a block of queries: one pair of blocks is one task's dense score array.
BLOCK, QUERIES = 4096, 2048


def finite(vector: Column) -> Column:
    """True for vectors without null or non-finite components (an empty one too)."""
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))), F.lit(False))


def _sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings by term: offsets of the terms, then rows and weights, in the order of terms."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = flat != 0
    order = np.argsort(term[held], kind="stable")
    term, row, weight = term[held][order], row[held][order], flat[held][order]
    return np.searchsorted(term, np.arange(int(sizes.max(initial=0)) + 1)), term, row, weight


def accumulate(queries: list[np.ndarray], candidates: list[np.ndarray]) -> np.ndarray:
    """Integer inner products of all queries with all candidates, one term at a time.

    For each term, the queries that hold it scatter their weight times the term's postings into dense score rows.
    """
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    q_at, _, q_row, q_weight = _sparse(queries)
    c_at, _, c_row, c_weight = _sparse(candidates)
    for term in range(min(len(q_at), len(c_at)) - 1):
        qs, cs = slice(q_at[term], q_at[term + 1]), slice(c_at[term], c_at[term + 1])
        postings, weights = c_row[cs], c_weight[cs]
        if len(postings) == len(candidates):  # every candidate holds the term, in order
            for row, weight in zip(q_row[qs], q_weight[qs]):
                scores[row] += weight * weights
        else:
            for row, weight in zip(q_row[qs], q_weight[qs]):
                scores[row, postings] += weight * weights
    return scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` candidates of highest integer inner product for each query row: ``query_id, rank, vec_id, score``.

    Components become floor(scale * x). All rows are candidates but those with the query's own id; ties go to the
    smaller id. Blocks of queries meet blocks of candidates in groups of bounded size, each of which keeps its own
    k best by partition selection; a window merges those. Nothing is left out and nothing broadcast, so the queries
    may be many. Vectors that are null or hold null or non-finite components take no part; shorter ones count as
    ending in zeros; rows with a null id are not ranked; a repeated row is a candidate of its own, but the query of one
    id is asked once (of different vectors under one id, the least one). Scores must fit a long.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("asked")).where(finite(F.col("v")) & F.col("vec_id").isNotNull())
    ints = F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    rows = rows.select("vec_id", ints.alias("v"), F.coalesce("asked", F.lit(False)).alias("asked"))
    # Written, so that the count and both sides don't each read the source, and row sizes are real.
    rows = written(rows, "ints")
    n, asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-asked // QUERIES))
    slot = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    candidates = rows.select("vec_id", "v", slot.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    queries = rows.where("asked").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.select("vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        right = right.sort_values("vec_id", kind="stable")
        ids, asks = right["vec_id"].to_numpy(np.int64), left["vec_id"].to_numpy(np.int64)
        scores = accumulate([np.asarray(v, np.int64) for v in left["v"]], [np.asarray(v, np.int64) for v in right["v"]])
        out = []
        for ask, row in zip(asks, scores):
            pool = np.flatnonzero(ids != ask)
            mine = row[pool]
            if len(pool) > k:
                least = np.partition(mine, len(mine) - k)[len(mine) - k]
                above, level = np.flatnonzero(mine > least), np.flatnonzero(mine == least)
                chosen = np.concatenate([above, level[: k - len(above)]])  # ids ascend, so ties go to the smaller
                pool, mine = pool[chosen], mine[chosen]
            out.append(pd.DataFrame({"query_id": np.full(len(pool), ask), "vec_id": ids[pool], "score": mine}))
        return pd.concat(out)

    found = queries.groupBy("block", "part").cogroup(candidates.groupBy("block", "part")).applyInPandas(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
