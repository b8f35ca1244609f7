"""Ranked lists of hits: (query_id, chunk_id, score, rank)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the behaviour that is reproduced.
RRF_K, OVERFETCH = 60, 20


def top_k(hits: DataFrame, k: int | None, digits: int | None = 6) -> DataFrame:
    """Ranks each query's hits by score, ties by chunk_id, and keeps the first k (all for None)."""
    if digits is not None:
        hits = hits.withColumn("score", F.round("score", digits))
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists."""
    union = lists[0].select("query_id", "chunk_id", "rank")
    for more in lists[1:]:
        union = union.unionByName(more.select("query_id", "chunk_id", "rank"))
    return union.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def min_max(hits: DataFrame) -> DataFrame:
    """Scores of each query scaled to 0 to 1; one half where all are equal."""
    w = W.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("norm", F.when(high == low, 0.5).otherwise((F.col("score") - low) / (high - low)))


def linear_fusion(first: DataFrame, second: DataFrame, alpha: float) -> DataFrame:
    """alpha * first + (1 - alpha) * second of the scaled scores, 0 where a list lacks the chunk; not cut to k."""
    a = min_max(first).select("query_id", "chunk_id", F.col("norm").alias("a"))
    b = min_max(second).select("query_id", "chunk_id", F.col("norm").alias("b"))
    joined = a.join(b, ["query_id", "chunk_id"], "full_outer")
    return joined.select("query_id", "chunk_id", (alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0))).alias("score"))


def positional(hits: DataFrame) -> DataFrame:
    """Replaces the score by 1 / rank."""
    return hits.withColumn("score", 1.0 / F.col("rank"))


def overfetch_rerank(hits: DataFrame, score, k: int, n: int = OVERFETCH) -> DataFrame:
    """Scores each query's first n hits anew with score(candidates) -> column and keeps the best k. The cut is below
    the scorer in the plan, so an expensive one sees no more than n rows a query."""
    candidates = hits.filter(F.col("rank") <= n).drop("score", "rank")
    return top_k(candidates.withColumn("score", score(candidates)), k)


def first_of(lists: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each query's hits from the first list that has any, with the list's name as `used`."""
    out = None
    for name, hits in lists:
        part = hits.withColumn("used", F.lit(name))
        out = part if out is None else out.unionByName(part.join(out.select("query_id").distinct(), "query_id", "left_anti"))
    return out


class Best:
    """The k best hits of each of some queries that a task has met so far, scores over floor, ties by chunk_id."""

    def __init__(self, queries: int, k: int, floor: float = -np.inf, digits: int = 6):
        self.k, self.floor, self.digits = k, floor, digits
        self.least = np.full(queries, floor)  # at most the k-th best score
        self.query, self.score, self.chunks = np.zeros(0, np.int64), np.zeros(0), None
        self.grown = 0

    def _low(self) -> np.ndarray:
        """What a score must exceed; below the k-th best by more than rounding adds."""
        return np.maximum(self.least - 2 * 10.0**-self.digits, self.floor)

    def offer(self, scores: np.ndarray, chunks: pa.Array) -> None:
        """Adds scores of all queries (down) with these chunks (across)."""
        rows = scores.shape[1]
        if rows >= self.k and len(new := np.flatnonzero(self.least == self.floor)):
            least = np.round(np.partition(scores[new], rows - self.k, axis=1)[:, rows - self.k], self.digits)
            self.least[new] = np.where(least > self.floor, least, self.floor)
        at = np.flatnonzero(~(scores <= self._low()[:, None]))
        self.add(at // rows, scores.reshape(-1)[at], at % rows, chunks)

    def add(self, query: np.ndarray, score: np.ndarray, place: np.ndarray, chunks: pa.Array) -> None:
        """Adds scores of queries with the chunks at these places."""
        score = np.round(score, self.digits)
        good = ~(score < self.least[query]) & ~(score <= self.floor)
        taken = chunks.take(pa.array(place[good]))
        self.query, self.score = np.concatenate([self.query, query[good]]), np.concatenate([self.score, score[good]])
        self.chunks = taken if self.chunks is None else pa.concat_arrays([self.chunks, taken])
        self.grown += len(taken)
        if self.grown > max(50_000, self.k * len(self.least)):
            self._cut()

    def _cut(self) -> None:
        rows = pa.table({"query": self.query, "score": self.score, "chunk": self.chunks})
        order = pc.sort_indices(rows, [("query", "ascending"), ("score", "descending"), ("chunk", "ascending")]).to_numpy()
        query = self.query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, last = order[rank < self.k], order[rank == self.k - 1]
        self.least[self.query[last]] = np.nan_to_num(self.score[last], nan=self.floor)
        self.query, self.score, self.chunks, self.grown = self.query[order], self.score[order], self.chunks.take(pa.array(order)), 0

    def rows(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """query_id (of ids), chunk_id, score of what is kept; no batch where nothing is."""
        if len(self.query):
            self._cut()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(self.query)), self.chunks, pa.array(self.score)], ["query_id", "chunk_id", "score"])
