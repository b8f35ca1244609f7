"""BM25 top k by block maxima: the same hits as scoring every posting, from fewer postings.

Chunks in order of their ids are cut into ranges. For each term of a range the largest part of a score that any chunk
gives is kept, before idf. Summed over a query's terms these bound every score in the range; the k-th best score of the
ranges with the best bounds is a threshold, and ranges whose bound does not reach it for any query are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import materialize
from . import ranking
from .bm25 import B, K1, Bm25Index

#: Chunks of a range, and ranges of a query that are read first, for each k chunks of theirs.
CHUNKS, FIRST = 64, 4
#: Scores are rounded to six digits, so a bound so much below the threshold may still reach it.
_SLACK = 2e-6
#: Most rows of a word or a number that are broadcast; beyond, tables are joined by sorting.
FEW = 100_000


def _maxima(batch: pa.RecordBatch, avgdl: float) -> pa.RecordBatch:
    """Of rows (range, dl, terms), in order of range: range, term, most, n."""
    lists = batch.column("terms")
    flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
    coded = flat.field("term").dictionary_encode()
    ranges, at = np.unique(batch.column("range").to_numpy(), return_inverse=True)
    key = np.repeat(at, sizes) * len(coded.dictionary) + coded.indices.to_numpy()
    tf, dl = flat.field("tf").to_numpy().astype(np.float64), np.repeat(batch.column("dl").to_numpy(), sizes)
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    most = np.nextafter(np.maximum.reduceat(part[order], first).astype(np.float32), np.float32(np.inf))  # a bound in fewer bytes
    place, term = np.divmod(key[first], len(coded.dictionary))
    n = np.diff(np.concatenate([first, [len(key)]]))
    return pa.RecordBatch.from_arrays([pa.array(ranges[place]), pc.take(coded.dictionary, pa.array(term)), pa.array(most), pa.array(n.astype(np.int32))], ["range", "term", "most", "n"])


def _broadcast_if_few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


@dataclass
class BlockIndex:
    """blocks (range, term, most: the largest part of a score before idf, n: postings), and the index of the chunks, whose
    rows name their range. A range that lies in two files may have two rows for a term."""

    blocks: DataFrame
    index: Bm25Index

    @classmethod
    def of(cls, index: Bm25Index, chunks: int = CHUNKS) -> BlockIndex:
        """Orders the rows of an index by chunk and cuts them; both tables are written once, and only rows of whole chunks are
        exchanged."""
        ordered = index.by_chunk().select("chunk_id", "dl", "terms").repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
        rows = materialize(ordered.withColumn("range", F.monotonically_increasing_id()).withColumn("range", F.expr(f"range div {chunks}")), "bm25-ranges")
        avgdl = index.stats.first().avgdl

        def run(batches):
            for batch in batches:
                if batch.num_rows and len(batch.column("terms").flatten()):
                    yield _maxima(batch, avgdl)

        blocks = rows.select("range", "dl", "terms").mapInArrow(run, "range bigint, term string, most float, n int")
        return cls(materialize(blocks, "bm25-blocks"), Bm25Index.of(rows, index.terms, index.stats))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        self.blocks.write.mode(mode).parquet(f"{path}/blocks")
        self.index.save(path, mode)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockIndex:
        return cls(spark.read.parquet(f"{path}/blocks"), Bm25Index.load(spark, path))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """queries (query_id, text) -> query_id, range, bound, n (postings of the query's terms) of the ranges with any. No
        posting is read: the maxima are a table of their own."""
        met = self.blocks.join(_broadcast_if_few(self.index.asked(queries)), "term")
        return met.groupBy("query_id", "range").agg(F.sum(F.greatest(F.col("weight") * F.col("most"), F.lit(0.0))).alias("bound"), F.sum("n").alias("n"))

    def hits(self, queries: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
        """The k best hits of every query among the chunks of these ranges."""
        wanted = _broadcast_if_few(ranges.select("range").distinct())
        return self.index.search(queries, k, rows=self.index.chunks.join(wanted, "range", "left_semi"))

    def plan(self, queries: DataFrame, k: int, first: int = FIRST) -> DataFrame:
        """The ranges that a search reads: query_id, range, n and whether they are read first; and those it skips (read
        false)."""
        bounds = materialize(self.bounds(queries), "bm25-bounds")
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
        opening = materialize(bounds.withColumn("first", place <= first), "bm25-opening")
        seen = self.hits(queries, opening.filter("first"), k)
        least = materialize(seen.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least")), "bm25-least")
        known = opening.join(least, "query_id", "left")
        return known.select("query_id", "range", "n", "first", (F.col("first") | (F.col("bound") >= F.coalesce("least", F.lit(0.0)) - _SLACK)).alias("read"))

    def search(self, queries: DataFrame, k: int, first: int = FIRST) -> DataFrame:
        """The k best hits of every query, as Bm25Index.search gives them."""
        read = materialize(self.plan(queries, k, first).filter("read"), "bm25-read")
        return self.hits(queries, read, k)
