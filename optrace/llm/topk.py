"""Operator 1: exact top-k by inner product, blocks pruned by summed term maxima.

Vectors of integers are put in an order in which likes lie near each other and cut into blocks, ranges of
that order. A block keeps, for each term (component), its greatest and least weight, and a forward
index, the rows of the block with all their terms. For a query the maxima, each times the query's
weight of the term (minima where that is negative), add up to a bound on every score in the block.
Blocks are taken in the order of these bounds and scored through the forward index until the
bound falls below the k-th score found.

Blocks lie in shards, queries in batches; each pair of a shard and a batch is a task's group, and
the shards' results of a query, k rows each at most, are merged at the end. A first threshold for
every query comes from the block in which the query itself lies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optrace.llm.common import staged

K = 20
BLOCK, SHARD, BATCH = 256, 16384, 1024
EXACT = 2.0**53


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * component) of every component, null for vectors that take no part: null, or
    with a null or non-finite component."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(embedding.isNotNull() & fine, F.transform(wide, lambda x: F.floor(F.lit(float(scale)) * x)))


def _signature(vector: Column) -> Column:
    """The terms' signs of the first 16 components as a number: likes tend to share it."""
    head = F.slice(vector, 1, 16)
    return F.aggregate(head, F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x >= 0, 1).otherwise(0))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition is a shard; rows keep their place in it."""
    count, shard = 0, TaskContext.get().partitionId()
    for batch in batches:
        place = np.arange(count, count + batch.num_rows)
        count += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("vector"), batch.column("asks"), pa.array(np.full(len(place), shard, np.int32)), pa.array(place)],
            ["vec_id", "vector", "asks", "shard", "place"],
        )


def _matrix(vectors: list) -> np.ndarray:
    """Rows of integers, padded with zeros; floats where products stay exact, else Python integers."""
    width = max(map(len, vectors), default=0)
    most = max((abs(x) for v in vectors for x in v), default=0)
    out = np.zeros((len(vectors), width), np.float64 if most < EXACT else object)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _top(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, floor: np.ndarray, k: int, block: int) -> list[tuple]:
    """(query position, vec_id, score) of up to k best rows of one shard for each query; floor has
    scores that the k-th best of the whole table reaches at least."""
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (queries, rows))
    if queries.dtype == object or rows.dtype == object or float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * width >= EXACT:
        queries, rows = queries.astype(object), rows.astype(object)
        queries, rows = np.vectorize(int, otypes=[object])(queries), np.vectorize(int, otypes=[object])(rows)
    starts = range(0, len(rows), block)
    high = np.stack([rows[s : s + block].max(axis=0) for s in starts])
    low = np.stack([rows[s : s + block].min(axis=0) for s in starts])
    bounds = np.where(queries > 0, queries, 0) @ high.T + np.where(queries < 0, queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    found: list[list[tuple]] = [[] for _ in queries]
    kth = floor.astype(queries.dtype)
    active = np.arange(len(queries))
    for turn in range(len(starts)):
        at = order[active, turn]
        open_ = bounds[active, at] >= kth[active]
        active, at = active[open_], at[open_]
        if not len(active):
            break
        for number in np.unique(at):
            some = active[at == number]
            part = rows[number * block : (number + 1) * block]
            part_ids = row_ids[number * block : (number + 1) * block]
            scores = queries[some] @ part.T
            good = (scores >= kth[some][:, None]) & (part_ids[None, :] != ids[some][:, None])
            for i in np.flatnonzero(good.any(axis=1)):
                q = some[i]
                hit = np.flatnonzero(good[i])
                best = found[q] + list(zip((-scores[i, hit]).tolist(), part_ids[hit].tolist()))
                best.sort()
                found[q] = best[:k]
                if len(found[q]) == k:
                    kth[q] = max(kth[q], -found[q][-1][0])
    return [(q, vec_id, int(-score)) for q, best in enumerate(found) for score, vec_id in best]


def _floors(k: int, block: int):
    """(vec_id, query vector, floor) of the queries of a shard: the k-th score in their own block."""

    def run(key, frame):
        frame = frame.sort_values("place")
        out = []
        for at in range(0, len(frame), block):
            part = frame.iloc[at : at + block]
            asks = part[part["asks"]]
            if not len(asks):
                continue
            vectors, ids = asks["vector"].tolist(), asks["vec_id"].to_numpy()
            got = _top(_matrix(vectors), ids, _matrix(part["vector"].tolist()), part["vec_id"].to_numpy(), np.full(len(asks), -np.inf), k, block)
            scores: dict[int, list] = {}
            for q, _, score in got:
                scores.setdefault(q, []).append(score)
            for q, vector in enumerate(vectors):
                full = len(scores.get(q, [])) == k and abs(min(scores[q])) < EXACT
                out.append((ids[q], vector, float(min(scores[q])) if full else None))
        return pd.DataFrame(out, columns=["vec_id", "vector", "floor"])

    return run


def _answers(k: int, block: int):
    def run(key, queries, rows):
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []})
        rows = rows.sort_values("place")
        floor = queries["floor"].fillna(-np.inf).to_numpy(np.float64)
        got = _top(_matrix(queries["vector"].tolist()), queries["vec_id"].to_numpy(), _matrix(rows["vector"].tolist()), rows["vec_id"].to_numpy(), floor, k, block)
        ids, number = queries["vec_id"].to_numpy(), queries["query_row"].to_numpy()
        edge = (1 << 63) - 1
        return pd.DataFrame([(ids[q], number[q], v, max(-edge - 1, min(edge, s))) for q, v, s in got], columns=["query_id", "query_row", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, asks: Column, k: int = K, block: int = BLOCK, shard: int = SHARD, batch: int = BATCH) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of every query row (asks is
    true) with the rows of other vec_ids, ties to the smaller vec_id; all if there are fewer.

    vectors has vec_id and vector (array of long); other columns are left out, and rows without
    either take no part. Rows repeated whole count once; of rows that share a vec_id each is
    a candidate, and each query row is answered. Shorter vectors count as padded with zeros.
    Scores outside of long count as its limits."""
    clean = vectors.withColumn("asks", asks).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    clean = clean.select("vec_id", "vector", "asks").dropDuplicates(["vec_id", "vector"]).withColumn("likes", _signature(F.col("vector")))
    parts = max(1, -(-clean.count() // shard))
    ordered = clean.repartitionByRange(parts, "likes", "vec_id").sortWithinPartitions("likes", "vec_id")
    placed = staged(ordered.select("vec_id", "vector", "asks").mapInArrow(
        _placed, "vec_id long, vector array<long>, asks boolean, shard int, place long"), "blocks")
    queries = placed.groupBy("shard").applyInPandas(_floors(k, block), "vec_id long, vector array<long>, floor double")
    queries = staged(queries.withColumn("query_row", F.xxhash64("vec_id", "vector")), "queries")
    shards = placed.agg(F.max("shard")).first()[0] or 0
    batches = max(1, -(-queries.count() // batch))
    asked = queries.withColumn("batch", F.pmod("query_row", F.lit(batches)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards))))
    offered = placed.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    found = asked.groupBy("shard", "batch").cogroup(offered.groupBy("shard", "batch")).applyInPandas(
        _answers(k, block), "query_id long, query_row long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
