"""Retrievers by name: bm25, symbol+bm25, dense, hybrid-rrf, hybrid-linear, or a caller's own, with reranking, written
passages and the rewriting of misspelt names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import bm25, dense, ranking, symbols

NAMES = ("bm25", "symbol+bm25", "dense", "hybrid-rrf", "hybrid-linear", "own")


@dataclass
class Retriever:
    """search(queries) takes (query_id, text) and, for the dense ones, a vector column, and returns query_id, chunk_id,
    score, rank for all queries at once.

    index: a BM25 index; vectors: (chunk_id, vector); found: symbol candidates; scorer: (joined hits with text and
    body) -> column, and chunks (chunk_id, text), to rerank the first OVERFETCH; passage: text -> column that writes
    a passage to search with in place of queries that are no identifiers by `classify` (they are reranked as asked);
    own: (queries, k) -> hits, for the name "own"; rewrite: whether a query that misspells one of the symbols among its
    first hits is asked again as that symbol (chunks then need chunk_type and symbols)."""

    name: str
    k: int = 10
    index: bm25.Bm25Index | None = None
    vectors: DataFrame | None = None
    found: DataFrame | None = None
    alpha: float = 0.5
    scorer: Callable[[DataFrame], Column] | None = None
    chunks: DataFrame | None = None
    passage: Callable[[Column], Column] | None = None
    classify: Callable[[Column], Column] = T.classify_query
    own: Callable[[DataFrame, int], DataFrame] | None = None
    rewrite: bool = False

    def __post_init__(self):
        if self.name not in NAMES:
            raise ValueError(f"unknown retriever {self.name!r}; known are {', '.join(NAMES)}")
        if self.k < 1:
            raise ValueError("k is at least 1")
        if (self.own is None) == (self.name == "own"):
            raise ValueError("the name own goes with a function of that name")
        if self.index is None and self.name not in ("dense", "own"):
            raise ValueError(f"{self.name} needs an index")
        if self.vectors is None and self.name in ("dense", "hybrid-rrf", "hybrid-linear"):
            raise ValueError(f"{self.name} needs vectors")
        if self.found is None and self.name == "symbol+bm25":
            raise ValueError("symbol+bm25 needs symbol candidates")
        if (self.scorer is not None or self.rewrite) and self.chunks is None:
            raise ValueError("a scorer needs the chunks' texts, and rewriting their symbols")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha lies between 0 and 1")

    def search(self, queries: DataFrame) -> DataFrame:
        if self.rewrite:
            return replace(self, rewrite=False).search(self.rewritten(queries))
        asked = queries
        if self.passage is not None:  # two branches, so the writer sees no identifiers
            kinds = queries.withColumn("_kind", self.classify(F.col("text")))
            written = kinds.filter("_kind <> 'identifier'").withColumn("text", self.passage(F.col("text")))
            asked = kinds.filter("_kind = 'identifier'").unionByName(written).drop("_kind")
        n = max(self.k, ranking.OVERFETCH) if self.scorer else self.k
        hits = self._first(asked, n)
        if self.scorer is None:
            return hits.select("query_id", "chunk_id", "score", "rank")
        joined = hits.join(self.chunks.select("chunk_id", F.col("text").alias("body")), "chunk_id").join(queries.select("query_id", "text"), "query_id")
        most = 2 * n if self.name.startswith("hybrid") else n
        return ranking.overfetch_rerank(joined, self.scorer, self.k, most).select("query_id", "chunk_id", "score", "rank")

    def rewritten(self, queries: DataFrame) -> DataFrame:
        """queries with the texts of those that misspell a symbol among their first hits replaced by it."""
        hits = replace(self, rewrite=False).search(queries)
        named = self.chunks.filter("chunk_type = 'symbol'").select("chunk_id", F.get("symbols", F.lit(0)).alias("symbol")).dropna()
        seen = queries.select("query_id", "text").join(hits.select("query_id", "chunk_id").join(named, "chunk_id"), "query_id", "left")
        fresh = symbols.rewrite_typos(seen.select("query_id", "text", "symbol"))
        return queries.join(fresh, "query_id").withColumn("text", F.col("rewritten")).select(*queries.columns)

    def _first(self, queries: DataFrame, n: int) -> DataFrame:
        lexical = lambda q: self.index.search(q.select("query_id", "text"), n)
        near = lambda q: dense.search(self.vectors, q.select("query_id", "vector"), n)
        if self.name == "own":
            return self.own(queries, n).filter(F.col("rank") <= n)
        if self.name == "bm25":
            return lexical(queries)
        if self.name == "dense":
            return near(queries)
        if self.name == "symbol+bm25":
            return symbols.route(queries.select("query_id", "text"), lambda q: symbols.lookup(q.select("query_id", "text"), self.found), lexical, n)
        if self.name == "hybrid-rrf":
            return ranking.top_k(ranking.reciprocal_rank_fusion([lexical(queries), near(queries)]), None, None)
        return ranking.top_k(ranking.linear_fusion(lexical(queries), near(queries), self.alpha), None, None)
