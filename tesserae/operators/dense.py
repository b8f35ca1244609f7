"""Dense vector search: inner products of queries with all vectors, top k."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import materialize
from . import ranking

#: Bytes of query vectors that are broadcast at once; more are taken in blocks.
BLOCK_BYTES = 32 << 20
#: Products that a task holds at once.
CELLS = 2_000_000


def encode(texts: DataFrame, key: str, encoder: Callable[[pd.Series], Iterator], text: str = "text") -> DataFrame:
    """(key, vector) by a batch encoder (texts -> vectors), normalised to length 1; the encoder is the caller's."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        made = np.asarray(list(encoder(batch)), np.float32)
        return pd.Series(list(made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)))

    return texts.select(key, run(text).alias("vector"))


def whole(size: int) -> Column:
    """Vectors of a length, without nulls."""
    return F.col("vector").isNotNull() & (F.size("vector") == size) & ~F.exists("vector", lambda x: x.isNull())


def numbers(lists: pa.Array) -> np.ndarray:
    """The numbers of an array of lists, one after another."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def query_blocks(queries: DataFrame, size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The ids and the vectors of queries of a length, in blocks of about BLOCK_BYTES."""
    n = queries.count()
    queries = queries.filter(whole(size))
    blocks = max(1, -(-n * max(1, size) * 8 // BLOCK_BYTES))
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        table = part.select("query_id", "vector").toArrow()
        yield table.column("query_id").combine_chunks(), numbers(table.column("vector").combine_chunks()).reshape(table.num_rows, size)


def search(vectors: DataFrame, queries: DataFrame, k: int, digits: int | None = 6, cells: int = CELLS) -> DataFrame:
    """vectors (chunk_id, vector), queries (query_id, vector) -> the k largest inner products of each query with all
    vectors. Queries are a stated set: blocks of bounded size are broadcast, and every task multiplies a bounded number at
    a time and keeps k candidates a query before they are ranked together. Vectors that are null, hold a null or have another length
    than the longest query are passed over, on both sides."""
    chunk_kind, query_kind = dict(vectors.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    size = queries.agg(F.max(F.size("vector"))).first()[0] or 0
    vectors = vectors.filter(whole(size))
    out = None
    for ids, matrix in query_blocks(queries, size):
        shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches, shared=shared):
            ids, matrix = shared.value
            best = ranking.Best(len(ids), k, digits=9 if digits is None else digits)
            step = max(1, cells // max(1, len(ids)))
            for batch in batches:
                for a in range(0, batch.num_rows if len(ids) else 0, step):
                    part = batch.slice(a, step)
                    best.offer(matrix @ numbers(part.column("vector")).reshape(part.num_rows, -1).T, part.column("chunk_id"))
            yield from best.rows(ids)

        found = vectors.select("chunk_id", "vector").mapInArrow(run, f"query_id {query_kind}, chunk_id {chunk_kind}, score double")
        out = found if out is None else out.unionByName(found)
    return ranking.top_k(out, k, digits)


@dataclass
class DenseIndex:
    """vectors (chunk_id, vector), their length and the name of the encoder that made them."""

    vectors: DataFrame
    dimension: int
    encoder: str

    @classmethod
    def build(cls, texts: DataFrame, key: str, encoder: Callable[[pd.Series], Iterator], name: str, text: str = "text") -> DenseIndex:
        """Encodes every text once and writes the vectors to the shared folder."""
        vectors = materialize(encode(texts, key, encoder, text).withColumnRenamed(key, "chunk_id"), "dense-vectors")
        return cls(vectors, vectors.agg(F.max(F.size("vector"))).first()[0] or 0, name)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        self.vectors.write.mode(mode).parquet(f"{path}/vectors")
        about = self.vectors.agg(F.count("*").alias("n")).select("n", F.lit(self.dimension).alias("dimension"), F.lit(self.encoder).alias("encoder"))
        about.write.mode(mode).json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder: str | None = None) -> DenseIndex:
        """The saved index; ValueError if another encoder than the one asked for made it, or its vectors are not as told."""
        about = spark.read.schema("n long, dimension int, encoder string").json(f"{path}/about").first()
        vectors = spark.read.parquet(f"{path}/vectors")
        if encoder is not None and encoder != about.encoder:
            raise ValueError(f"{path} was made by {about.encoder}, not by {encoder}")
        n, wrong = vectors.agg(F.count("*"), F.count_if(F.coalesce(F.size("vector"), F.lit(-1)) != about.dimension)).first()
        if n != about.n or wrong:
            raise ValueError(f"{path}: {n} vectors of {about.n}, {wrong} of another length than {about.dimension}")
        return cls(vectors, about.dimension, about.encoder)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search(self.vectors, queries, k)
