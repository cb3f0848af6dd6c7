"""Exact top-k inner products by block-at-a-time pruning.

Components are quantised to floor(scale * x), x as double. Candidates are dealt into shards and, inside a shard, cut into
blocks of ``BLOCK`` rows in id order. A block keeps the largest and the smallest value of each component; for a query the
sum over its components of the larger of (q * largest, q * smallest) bounds every score of the block. Blocks are taken in
falling order of that bound per query and scored through the block's rows until the bound falls below the query's k-th
score so far; equal bounds are still scored, as ties go to the smaller id.

Queries and shards meet in cells of bounded size: a query block and a shard are sent to each cell they share, cells
give k rows per query, and Spark ranks those. The bounds of all sizes come from counts; nothing is sampled or capped.

Cases: vectors that are null or hold null or non-finite components take no part; a shorter vector counts as having
zeros; an empty one scores 0; rows that repeat an id are one query and candidates each, none of them its own; a null id
takes no part; fewer than k candidates are all returned; a score that leaves 64 bits wraps as long arithmetic does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import checkpointed

BLOCK, SHARD_ROWS, QUERY_ROWS = 128, 8192, 1024
NO_NAME = np.iinfo(np.int64).max


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), doubles.alias("x")).filter(
        F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad).select(
        "id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        out[i, :len(v)] = v
    return out


def _best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple]:
    """Index of the query, ids and scores of its best k, at most, among the vectors."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    exact = top < 2.0**52  # sums of whole numbers are exact in floats then, and products fast
    kind, flip = (np.float64, np.negative) if exact else (np.int64, np.invert)
    queries, vectors = queries.astype(kind), vectors.astype(kind)
    cuts = list(range(0, len(ids), BLOCK))
    high = np.array([vectors[a:a + BLOCK].max(0) for a in cuts])
    low = np.array([vectors[a:a + BLOCK].min(0) for a in cuts])
    zero = np.zeros_like(queries)
    bound = np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T
    if top >= 2.0**62:
        bound[:] = np.iinfo(np.int64).max  # sums may wrap, so nothing is pruned
    turn = np.argsort(flip(bound), axis=1, kind="stable")
    none = -np.inf if exact else np.iinfo(np.int64).min
    scores = np.full((len(queries), k), none, kind)
    names = np.full((len(queries), k), NO_NAME)
    active = np.arange(len(queries))
    for step in range(len(cuts)):
        open_ = (bound[active, turn[active, step]] >= scores[active, k - 1]) | (names[active, k - 1] == NO_NAME)
        active = active[open_]
        if not len(active):
            break
        blocks = turn[active, step]
        for block in np.unique(blocks):
            who = active[blocks == block]
            a = cuts[block]
            near = queries[who] @ vectors[a:a + BLOCK].T
            at = np.broadcast_to(ids[a:a + BLOCK], near.shape)
            own = at == query_ids[who][:, None]
            every = np.concatenate((scores[who], np.where(own, kind(none), near)), axis=1)
            names_of = np.concatenate((names[who], np.where(own, NO_NAME, at)), axis=1)
            first = np.lexsort((names_of, flip(every)), axis=1)[:, :k]
            scores[who] = np.take_along_axis(every, first, 1)
            names[who] = np.take_along_axis(names_of, first, 1)
    for i in range(len(queries)):
        real = names[i] != NO_NAME
        yield i, names[i][real].tolist(), [int(s) for s in scores[i][real]]


def search(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
           shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id, score) of the k best rows for every row where ``is_query`` (a condition on ``id``) holds."""
    rows = checkpointed(quantised(vectors, scale, id_col, vector_col))
    asked = rows.filter(is_query).distinct()
    n = rows.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked.count() // query_rows))
    candidates = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), "id", "v")
    queries = asked.select(
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "id", "v")

    def cell(table: pa.Table) -> pa.Table:
        query = np.asarray(table["query"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        ids = table["id"].to_numpy()
        values = table["v"].to_pylist()
        width = max([1, *map(len, values)])
        matrix = _matrix(values, width)
        out = []
        if query.any() and not query.all():
            asked_ids = ids[query]
            for i, names, scores in _best(matrix[query], asked_ids, matrix[~query], ids[~query], k):
                out += [(int(asked_ids[i]), j, name, score) for j, (name, score) in enumerate(zip(names, scores))]
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "place", "id", "score"])

    found = candidates.unionByName(queries).groupBy("block", "shard").applyInArrow(
        cell, "query_id long, place long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "place")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
