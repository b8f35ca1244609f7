"""Queries of the retrievers, their fusion and the evaluation of what they find."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..functions import text as T
from ..operators import blocks, bm25, cells, chunks, dense, evaluation, ranking, symbols
from .registry import query
from .text_queries import NAMES_SQL, PRIORITY_SQL, WORD_SQL

K = 10

_SCORED = """
scored AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM stats)))), 6) AS score
  FROM qtf JOIN idf USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {k})"""
HITS_SQL = f"WITH {WORD_SQL}, {_SCORED.format(k=K)}"
HITS20_SQL = f"WITH {WORD_SQL}, {_SCORED.format(k=ranking.OVERFETCH)}"

#: Documents with an id divisible by 100 as queries (their whole texts, and the vectors of those that have one).
_SELF = r"""
sq AS (SELECT doc_id AS item_id, text FROM documents WHERE doc_id % 100 = 0)"""
_SELF_WORDS = WORD_SQL.replace("FROM benchmark", "FROM sq")
_DENSE = """
dense_scored AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
dense_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense_scored) WHERE rank <= 10)"""
HYBRID_SQL = f"WITH {_SELF}, {_SELF_WORDS}, {_SCORED.format(k=K)}, {_DENSE}"
_MINMAX = """
norm AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM {t} WINDOW w AS (PARTITION BY query_id))"""


def documents(read):
    return read("documents").select(F.col("doc_id").alias("chunk_id"), "text")


def benchmark_queries(read):
    return read("benchmark").select(F.col("item_id").alias("query_id"), "text")


_indexes: dict[tuple, bm25.Bm25Index] = {}


def index_of(read) -> bm25.Bm25Index:
    """The BM25 index of the documents, built once in a session for the same files as they are now."""
    docs = documents(read)
    files = docs.sparkSession.read.format("binaryFile").load(docs.inputFiles()).select("path", "modificationTime", "length")
    key = (docs.sparkSession.sparkContext.applicationId, tables.generation(), *sorted(map(tuple, files.collect())))
    if key not in _indexes:
        _indexes[key] = bm25.Bm25Index.build(docs)
    return _indexes[key]


def bm25_hits(read, queries=None, k=K):
    return index_of(read).search(benchmark_queries(read) if queries is None else queries, k)


def self_queries(read):
    return read("documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


def dense_hits(read, k=K):
    vectors = read("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return dense.search(vectors, vectors.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), k)


@query(f"WITH {WORD_SQL} SELECT term AS token, df, round(idf, 6) AS idf FROM idf")
def term_stats(read):
    return index_of(read).terms.select(F.col("term").alias("token"), "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {WORD_SQL} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM dfs) AS vocabulary FROM stats")
def corpus_stats(read):
    index = index_of(read)
    return index.stats.select("n", F.round("avgdl", 6).alias("avgdl"), index.terms.agg(F.count("*")).scalar().alias("vocabulary"))


@query(f"{HITS_SQL} SELECT query_id, chunk_id, score, rank FROM hits")
def bm25_topk(read):
    return bm25_hits(read)


@query(f"{HITS_SQL} SELECT query_id, chunk_id, score, rank FROM hits")
def bm25_blockmax(read):
    """The same hits by block maxima."""
    return blocks.BlockIndex.of(index_of(read)).search(benchmark_queries(read), K)


@query(f"WITH {_DENSE.strip()} SELECT query_id, chunk_id, score, rank FROM dense_hits")
def dense_cells(read):
    """The hits of dense_topk from the cells that may hold them."""
    vectors = read("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    index = cells.CellIndex.build(vectors)
    return index.search(vectors.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), K)[0]


@query(f"WITH {_DENSE.strip()} SELECT query_id, chunk_id, score, rank FROM dense_hits")
def dense_topk(read):
    return dense_hits(read)


@query(f"{HYBRID_SQL} SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM hits UNION ALL SELECT query_id, chunk_id, rank FROM dense_hits) GROUP BY ALL")
def rrf_fusion(read):
    found = ranking.reciprocal_rank_fusion([bm25_hits(read, self_queries(read)), dense_hits(read)])
    return found.withColumn("score", F.round("score", 6))


def _linear(alpha: float, name: str) -> None:
    sql = f"""{HYBRID_SQL}, {_MINMAX.format(t="hits").replace("norm AS (", "na AS (", 1)}, {_MINMAX.format(t="dense_hits").replace("norm AS (", "nb AS (", 1)}
    SELECT query_id, chunk_id, round({alpha}::DOUBLE * coalesce(na.norm, 0) + {1 - alpha}::DOUBLE * coalesce(nb.norm, 0), 6) AS score FROM na FULL JOIN nb USING (query_id, chunk_id)"""

    @query(sql, name)
    def build(read):
        found = ranking.linear_fusion(bm25_hits(read, self_queries(read)), dense_hits(read), alpha)
        return found.withColumn("score", F.round("score", 6))


_linear(0.3, "linear_fusion_a03")
_linear(0.5, "linear_fusion_a05")


@query(f"{HITS_SQL}, {_MINMAX.format(t='hits')} SELECT query_id, chunk_id, round(norm, 6) AS norm FROM norm")
def minmax_normalize(read):
    return ranking.min_max(bm25_hits(read)).select("query_id", "chunk_id", F.round("norm", 6).alias("norm"))


def _overlap(read):
    """Distinct words that query and chunk share, as the stand-in scorer."""
    docs, asked = documents(read).withColumnRenamed("text", "body"), benchmark_queries(read)
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))

    def score(hits):
        return F.size(F.array_intersect(words("text"), words("body"))).cast("double")

    return lambda hits: ranking.overfetch_rerank(hits.join(docs, "chunk_id").join(asked, "query_id"), score, 5)


_RERANK = """
reranked AS (SELECT query_id, chunk_id, len(list_intersect(list_distinct(string_split(lower(b.text), ' ')), list_distinct(string_split(lower(d.text), ' '))))::DOUBLE AS score
  FROM hits JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM reranked) WHERE rank <= 5"""


@query(f"{HITS20_SQL}, {_RERANK}")
def overfetch_rerank(read):
    return _overlap(read)(bm25_hits(read, k=ranking.OVERFETCH)).select("query_id", "chunk_id", "score", "rank")


_HYDE_WORDS = WORD_SQL.replace("FROM benchmark", "FROM hq")


@query(f"WITH hq AS (SELECT item_id, CASE WHEN regexp_matches(text, '^[A-Za-z0-9._]*[A-Za-z0-9][A-Za-z0-9._]*$') THEN text ELSE 'passage ' || text || ' ' || text END AS text FROM benchmark), {_HYDE_WORDS}, {_SCORED.format(k=ranking.OVERFETCH)}, {_RERANK}")
def hyde_branch(read):
    """Searches with a written passage (identifiers with themselves) and reranks with the query as asked."""
    asked = benchmark_queries(read).withColumn("kind", T.classify_query(F.col("text")))
    same = asked.filter("kind = 'identifier'").select("query_id", "text")
    written = asked.filter("kind <> 'identifier'").select("query_id", F.concat(F.lit("passage "), "text", F.lit(" "), "text").alias("text"))
    return _overlap(read)(bm25_hits(read, same.unionByName(written), ranking.OVERFETCH)).select("query_id", "chunk_id", "score", "rank")


@query(
    f"""{HITS_SQL}, {NAMES_SQL},
    direct AS (SELECT -id - 1 AS query_id, id AS chunk_id FROM names WHERE id % 100 = 0),
    sq AS (SELECT -id - 1 AS query_id, array_to_string(string_split(fqn, '.')[2:], '.') AS text FROM names WHERE id % 100 = 0),
    s AS (SELECT query_id, id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY {PRIORITY_SQL}, module, fqn, id) AS rank FROM sq JOIN alias ON alias = text)
    SELECT query_id, chunk_id, 'symbol' AS used, rank, round(1.0::DOUBLE / rank, 6) AS score FROM s WHERE rank <= 5
    UNION ALL SELECT query_id, chunk_id, 'bm25', rank, round(1.0::DOUBLE / rank, 6) FROM hits WHERE rank <= 5"""
)
def route_queries(read):
    """Names go to the symbol index and passages to BM25."""
    from .text_queries import part_symbols, symbol_queries

    table = symbols.alias_table(part_symbols(read))
    index = index_of(read)
    asked = symbol_queries(read).withColumn("query_id", -F.col("query_id") - 1).unionByName(benchmark_queries(read))
    found = symbols.route(asked, lambda q: symbols.exact(q.select("query_id", "text"), table), lambda q: index.search(q.select("query_id", "text"), 5), 5)
    return found.select("query_id", "chunk_id", "used", "rank", F.round("score", 6).alias("score"))


@query(f"{HITS_SQL} SELECT query_id, string_agg('[' || rank || '] ' || 'doc ' || chunk_id || chr(10) || left(text, 600), chr(10) || '---' || chr(10) ORDER BY rank) AS prompt FROM hits JOIN documents ON doc_id = chunk_id WHERE rank <= 5 GROUP BY ALL")
def prompt_blocks(read):
    hits = bm25_hits(read, k=5).join(documents(read), "chunk_id")
    return chunks.prompt_blocks(hits.withColumn("title", F.concat(F.lit("doc "), F.col("chunk_id").cast("string"))))


def judged(read, k=K):
    """(queries, ranks): a query's one expected item is its passage, matched by a hit that contains it."""
    asked = benchmark_queries(read)
    hits = bm25_hits(read, k=k).join(documents(read).withColumnRenamed("text", "body"), "chunk_id")
    expected = asked.withColumn("item", F.col("query_id").cast("string"))
    return asked, evaluation.match_ranks(expected, hits.select("query_id", "rank", "body"), lambda j: F.contains(j["body"], j["text"]))


_JUDGED = """
judged AS (SELECT b.item_id AS query_id, min(rank) FILTER (WHERE contains(d.text, b.text)) AS rank FROM benchmark b LEFT JOIN hits ON query_id = b.item_id LEFT JOIN documents d ON d.doc_id = chunk_id GROUP BY ALL)"""


@query(f"{HITS_SQL}, {_JUDGED} SELECT query_id, coalesce(rank <= 5, false) AS hit_at_5, coalesce(rank <= 10, false) AS hit_at_10, rank::INT AS rank FROM judged")
def hit_per_query(read):
    return evaluation.per_query(*judged(read))


@query(f"{HITS_SQL}, {_JUDGED} SELECT query_id, coalesce(rank <= 5, false) AS hit_at_5, coalesce(rank <= 10, false) AS hit_at_10, rank::INT AS rank FROM (SELECT j.query_id, CASE WHEN j.rank IS NULL OR h.rank IS NULL THEN NULL ELSE greatest(j.rank, h.rank) END AS rank FROM judged j LEFT JOIN hits h ON h.query_id = j.query_id AND h.rank = 2)")
def hit_per_query_all(read):
    """Two items a query must both be found: its passage, and any second hit."""
    asked, first = judged(read)
    second = bm25_hits(read).filter("rank = 2").select("query_id", F.lit("second").alias("item"), "rank")
    expected = asked.select("query_id", F.lit("second").alias("item")).join(second, ["query_id", "item"], "left")
    return evaluation.per_query(asked, first.unionByName(expected), "all")


@query(f"{HITS_SQL}, {_JUDGED} SELECT count(*) AS n_queries, round(avg(coalesce(rank <= 5, false)::INT), 6) AS recall_at_5, round(avg(coalesce(rank <= 10, false)::INT), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM judged")
def hit_recall_mrr(read):
    r = evaluation.run_metrics(evaluation.per_query(*judged(read)))
    return r.select("n_queries", *[F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr")])


@query(f"{HITS_SQL}, {_JUDGED} SELECT lang, count(*) AS n, round(avg(coalesce(j.rank <= 5, false)::INT), 6) AS recall_at_5 FROM judged j JOIN hits h ON h.query_id = j.query_id AND h.rank = 1 JOIN documents d ON d.doc_id = h.chunk_id GROUP BY ALL")
def recall_by_lang(read):
    """Recall by the language of the first hit."""
    asked, ranks = judged(read)
    first = bm25_hits(read).filter("rank = 1").select("query_id", F.col("chunk_id").alias("doc_id"))
    joined = evaluation.per_query(asked, ranks).join(first, "query_id").join(read("documents").select("doc_id", "lang"), "doc_id")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit_at_5").cast("int")), 6).alias("recall_at_5"))


_TIERS = "tiers AS (SELECT l.doc_id, d.source, d.lang, quality, toxic, CASE quality * 2 + toxic WHEN 2 THEN CASE WHEN l.doc_id % 3 = 0 THEN 'partial' ELSE 'correct' END WHEN 3 THEN 'hallucination' WHEN 1 THEN 'refused' ELSE CASE WHEN l.doc_id % 2 = 0 THEN 'refused' ELSE 'wrong' END END AS tier FROM labels l JOIN documents d USING (doc_id))"
_ALL_TIERS = "['correct', 'partial', 'wrong', 'hallucination', 'refused']"


def tiers(read):
    """The labels as answer tiers."""
    code, even = F.col("quality") * 2 + F.col("toxic"), F.col("doc_id") % 2 == 0
    tier = F.when(code == 2, F.when(F.col("doc_id") % 3 == 0, "partial").otherwise("correct")).when(code == 3, "hallucination").when(code == 1, "refused").otherwise(F.when(even, "refused").otherwise("wrong"))
    return read("labels").join(read("documents").select("doc_id", "source", "lang"), "doc_id").withColumn("tier", tier)


@query(f"WITH {_TIERS} SELECT t.tier, count(x.tier) AS n, round(count(x.tier)::DOUBLE / (SELECT count(*) FROM tiers), 6) AS rate FROM (SELECT unnest({_ALL_TIERS}) AS tier) t LEFT JOIN tiers x USING (tier) GROUP BY ALL")
def tier_aggregate(read):
    return evaluation.tier_table(tiers(read)).withColumn("rate", F.round("rate", 6))


@query(
    f"""WITH {_TIERS}, r AS (SELECT lang AS run, source AS query_type, tier, quality = 1 AS h5, quality = 1 OR toxic = 0 AS h10, nullif(doc_id % 12, 0) AS rank FROM tiers)
    SELECT concat_ws(',', CASE WHEN grouping(run) = 0 THEN 'run' END, CASE WHEN grouping(query_type) = 0 THEN 'query_type' END, CASE WHEN grouping(tier) = 0 THEN 'tier' END) AS grouped, run, query_type, tier, count(*) AS n,
    round(avg(h5::INT), 6) AS recall_at_5, round(avg(h10::INT), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / rank, 0.0::DOUBLE)), 6) AS mrr
    FROM r GROUP BY GROUPING SETS ((run), (run, query_type), (run, tier), (run, query_type, tier), (query_type), (tier), ())"""
)
def run_report(read):
    """The exact columns of a report over all groups of runs (languages), query types (sources) and tiers."""
    rows = tiers(read).join(read("documents").select("doc_id", F.col("text").alias("answer")), "doc_id")
    results = rows.select(
        F.col("lang").alias("run"), F.col("source").alias("query_type"), "tier", (F.col("quality") == 1).alias("hit_at_5"), ((F.col("quality") == 1) | (F.col("toxic") == 0)).alias("hit_at_10"),
        F.nullif(F.col("doc_id") % 12, F.lit(0)).alias("rank"), (F.col("doc_id") % 97).alias("latency_seconds"), "answer",
    )
    return evaluation.run_report(results).select("grouped", "run", "query_type", "tier", "n", *[F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr")])


@query(f"WITH {_TIERS} SELECT source, " + ", ".join(f"count(*) FILTER (WHERE tier = '{t}') AS {t}" for t in T.TIERS) + ", count(*) AS n, round(count(*) FILTER (WHERE tier IN ('correct', 'partial'))::DOUBLE / count(*), 6) AS accuracy, round(count(*) FILTER (WHERE tier = 'hallucination')::DOUBLE / count(*), 6) AS hallucination_rate FROM tiers GROUP BY ALL")
def tier_by_type(read):
    r = evaluation.tier_by_type(tiers(read), "source")
    return r.withColumns({c: F.round(c, 6) for c in ("accuracy", "hallucination_rate")})


@query(
    f"""WITH {_TIERS}, c AS (SELECT count(*) FILTER (WHERE tier = 'refused' AND quality = 0) AS tp, count(*) FILTER (WHERE tier = 'refused' AND quality <> 0) AS fp,
    count(*) FILTER (WHERE tier <> 'refused' AND quality = 0) AS fn, count(*) FILTER (WHERE tier <> 'refused' AND quality <> 0) AS tn FROM tiers)
    SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c"""
)
def refusal_f1(read):
    rows = tiers(read).select((F.col("tier") == "refused").alias("p"), (F.col("quality") == 0).alias("a"))
    return evaluation.confusion(rows, "p", "a").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    """WITH m AS (SELECT count(*)::DOUBLE AS n, avg((quality = toxic)::INT) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe FROM labels)
    SELECT n::BIGINT AS n, round(po, 6) AS exact_match, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM m"""
)
def cohen_kappa(read):
    r = evaluation.agreement(read("labels"), "quality", "toxic")
    return r.withColumns({c: F.round(c, 6) for c in ("exact_match", "kappa")})


_BUCKETS = f"{_TIERS}, buckets AS (SELECT doc_id, CASE WHEN tier = 'refused' THEN CASE WHEN toxic = 1 THEN 'refused_with_hit' ELSE 'refused_without_hit' END ELSE tier END AS bucket FROM tiers)"


def buckets(read):
    return tiers(read).withColumn("bucket", evaluation.failure_bucket(F.col("tier"), F.col("toxic") == 1))


@query(f"WITH {_BUCKETS} SELECT bucket, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM tiers), 6) AS rate FROM buckets GROUP BY ALL")
def failure_triage(read):
    return evaluation.triage(buckets(read)).withColumn("rate", F.round("rate", 6))


@query(f"WITH {_BUCKETS} SELECT bucket, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS place FROM buckets) WHERE place <= 3")
def triage_samples(read):
    return evaluation.first_rows(buckets(read), "bucket", ["doc_id"]).select("bucket", "doc_id", "place")


@query(f"{HITS_SQL}, {_JUDGED} SELECT query_id FROM judged WHERE rank IS NULL")
def retrieval_miss(read):
    """Queries whose passage is in none of their hits."""
    from ..operators import corpus

    _, ranks = judged(read)
    known = ranks.select("query_id", F.lit(True).alias("chunk_id"))
    return corpus.retrieval_misses(known, ranks.select("query_id", F.col("rank").isNotNull().alias("chunk_id"))).select("query_id")


_REPLY = """reply AS (SELECT item_id AS query_id, text || ' [' || (item_id % 7) || ', 2] and [9]' || CASE WHEN item_id % 5 = 0 THEN ' [INSUFFICIENT-CONTEXT]' ELSE '' END AS answer, item_id % 5 = 0 AS refused, list_distinct([item_id % 7, 2, 9]) AS cites FROM benchmark)"""


def replies(read):
    """Answers to the benchmark's queries that cite places in the list of hits, some of which it has not, and refusals."""
    mark = F.when(F.col("query_id") % 5 == 0, " [INSUFFICIENT-CONTEXT]").otherwise("")
    return benchmark_queries(read).select("query_id", F.concat("text", F.lit(" ["), (F.col("query_id") % 7).cast("string"), F.lit(", 2] and [9]"), mark).alias("answer"))


@query(
    f"""{HITS_SQL}, {_REPLY} SELECT query_id, CASE WHEN refused THEN '' ELSE answer END AS text, refused,
    coalesce((SELECT string_agg(chunk_id::VARCHAR, ',' ORDER BY CASE rank WHEN query_id % 7 THEN 1 WHEN 2 THEN 2 ELSE 3 END) FROM hits h WHERE h.query_id = r.query_id AND rank <= 5 AND NOT refused AND list_contains(cites, rank)), '') AS cited FROM reply r"""
)
def answer_citations(read):
    """Citations as places among five hits, to chunks."""
    found = evaluation.cited_chunks(replies(read), bm25_hits(read, k=5))
    return found.select("query_id", "text", "refused", F.array_join(F.transform("cited_chunk_ids", lambda c: c.cast("string")), ",").alias("cited"))


@query(f"{HITS_SQL}, {_REPLY} SELECT h.query_id, h.chunk_id, h.rank, NOT refused AND list_contains(cites, rank) AS cited, 'https://docs.python.org/3.12/doc/' || h.chunk_id || '.html' AS url FROM hits h JOIN reply USING (query_id)")
def cited_hits(read):
    """Hits with a mark on those that the query's answer cites."""
    hits = tables.materialize(bm25_hits(read), "cited-hits")  # read twice
    url = T.public_url("3.12", F.concat(F.lit("doc/"), F.col("chunk_id").cast("string"), F.lit(".html")))
    return evaluation.mark_cited(hits, evaluation.cited_chunks(replies(read), hits)).select("query_id", "chunk_id", "rank", "cited", url.alias("url"))


@query(
    f"""{HITS_SQL}, blocks AS (SELECT query_id, string_agg('[' || rank || '] doc ' || chunk_id || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS blocks FROM hits JOIN documents ON doc_id = chunk_id WHERE rank <= 5 GROUP BY ALL)
    SELECT item_id AS query_id, sha256(CASE WHEN regexp_matches(text, '^[A-Za-z0-9._]*[A-Za-z0-9][A-Za-z0-9._]*$') THEN '{T.STRUCTURE_HINTS["identifier"]}' ELSE '{T.STRUCTURE_HINTS["natural_language"]}' END || chr(10) || chr(10)
    || coalesce('CONTEXT:' || chr(10) || blocks || chr(10) || chr(10), '') || 'QUESTION: ' || text) AS user_sha256 FROM benchmark LEFT JOIN blocks ON query_id = item_id"""
)
def grounded_prompts(read):
    """Whole prompts of the benchmark's queries over five hits."""
    asked = benchmark_queries(read).withColumn("query_type", T.classify_query(F.col("text")))
    hits = bm25_hits(read, k=5).join(documents(read), "chunk_id").withColumn("title", F.concat(F.lit("doc "), F.col("chunk_id").cast("string")))
    return chunks.grounded_prompts(asked, hits).select("query_id", F.sha2("user", 256).alias("user_sha256"))


_EXPECTED = f"""{NAMES_SQL},
eq AS (SELECT id AS query_id, array_to_string(string_split(fqn, '.')[2:], '.') AS text, fqn, id // 100 % 2 = 0 AS every, id // 100 % 3 AS mode FROM names WHERE id % 100 = 0),
eh AS (SELECT query_id, id AS chunk_id, a.fqn AS symbol, 'library/' || module || '.html#' || a.fqn AS url, row_number() OVER (PARTITION BY query_id ORDER BY {PRIORITY_SQL}, module, a.fqn, id) AS rank FROM eq JOIN alias a ON alias = text),
items AS (SELECT query_id, 'symbol' AS kind, unnest([fqn, 'no.such.name']) AS item, mode FROM eq WHERE mode < 2 UNION ALL SELECT query_id, 'symbol', fqn, mode FROM eq WHERE mode = 2
  UNION ALL SELECT query_id, 'url', CASE mode WHEN 0 THEN 'library/' || split_part(fqn, '.', 1) || '.html#' || fqn WHEN 1 THEN 'library/' || split_part(fqn, '.', 1) || '.html#else' ELSE 'library/' END, mode FROM eq),
found AS (SELECT i.query_id, kind, item, min(rank) FILTER (WHERE CASE WHEN kind = 'symbol' THEN symbol = item ELSE CASE i.mode WHEN 0 THEN url = item WHEN 1 THEN split_part(url, '#', 1) = split_part(item, '#', 1) ELSE starts_with(url, item) END END) AS rank
  FROM items i LEFT JOIN eh USING (query_id) GROUP BY ALL),
ranks AS (SELECT query_id, every, CASE WHEN every THEN CASE WHEN count(*) = count(rank) THEN max(rank) END ELSE min(rank) END AS rank FROM found JOIN eq USING (query_id) GROUP BY query_id, every)"""


def expectations(read):
    """(queries, hits): aliases with the symbols and URLs that they expect under every mode and policy, and exact hits."""
    from .text_queries import part_names, part_symbols, symbol_queries

    page = lambda name: F.concat(F.lit("library/"), F.substring_index(name, ".", 1), F.lit(".html"))
    mode = F.expr("query_id div 100 % 3")
    asked = symbol_queries(read).join(part_names(read).select(F.col("id").alias("query_id"), "fqn"), "query_id")
    url = F.when(mode == 0, F.concat(page("fqn"), F.lit("#"), "fqn")).when(mode == 1, F.concat(page("fqn"), F.lit("#else"))).otherwise("library/")
    asked = asked.select(
        "query_id", "text", F.when(mode == 2, F.array("fqn")).otherwise(F.array("fqn", F.lit("no.such.name"))).alias("expected_symbols"), F.array(url).alias("expected_urls"),
        F.when(mode == 0, "exact").when(mode == 1, "strip_anchor").otherwise("prefix").alias("url_match"), F.when(F.expr("query_id div 100 % 2 = 0"), "all").otherwise("any").alias("match_policy"),
    )
    found = symbols.exact(asked.select("query_id", "text"), symbols.alias_table(part_symbols(read)))
    return asked, found.select("query_id", "chunk_id", "rank", F.array("fqn").alias("symbols"), F.concat(page("fqn"), F.lit("#"), "fqn").alias("canonical_url"))


@query(f"WITH {_EXPECTED.strip()} SELECT query_id, kind || ':' || item AS item, rank::INT AS rank FROM found")
def expected_ranks(read):
    """The best rank of every expected symbol and URL."""
    return evaluation.item_ranks(*expectations(read))


@query(f"WITH {_EXPECTED.strip()} SELECT query_id, coalesce(rank <= 5, false) AS hit_at_5, coalesce(rank <= 10, false) AS hit_at_10, rank::INT AS rank FROM ranks")
def expected_hits(read):
    """Hits and ranks under each query's own policy."""
    asked, hits = expectations(read)
    return evaluation.per_query(asked, evaluation.item_ranks(asked, hits), F.col("match_policy"))


@query(f"WITH {_EXPECTED.strip()} SELECT query_id, chunk_id, rank::INT AS rank FROM eh JOIN eq USING (query_id) WHERE symbol = fqn OR (mode < 2 AND symbol = 'no.such.name')")
def symbol_overlap(read):
    """Hits that share a symbol with what their query expects."""
    return evaluation.symbol_hits(*expectations(read)).select("query_id", "chunk_id", "rank")


@query(
    f"""WITH {_TIERS}, j AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'wrong' ELSE tier END AS judge FROM tiers WHERE doc_id % 3 <> 0), m AS (SELECT doc_id, tier AS human FROM tiers WHERE doc_id % 4 <> 0),
    b AS (SELECT judge, human FROM j JOIN m USING (doc_id)), n AS (SELECT count(*) AS n, coalesce(avg((judge = human)::INT), 0) AS po FROM b),
    c AS (SELECT coalesce(sum(a.n * b.n)::DOUBLE / (SELECT n * n FROM n), 0) AS pe FROM (SELECT judge AS t, count(*) AS n FROM b GROUP BY ALL) a JOIN (SELECT human AS t, count(*) AS n FROM b GROUP BY ALL) b USING (t))
    SELECT n, round(po, 6) AS exact_match, round(CASE WHEN n = 0 THEN 0 WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM n, c"""
)
def judge_human_agreement(read):
    """A judge's last tiers and a person's, over the queries that both have."""
    t = tiers(read).select(F.col("doc_id").alias("query"), "tier")
    judged = t.filter("query % 3 <> 0").withColumn("tier", F.when(F.col("query") % 7 == 0, "wrong").otherwise(F.col("tier"))).withColumn("timestamp", F.lit(2))
    earlier = judged.withColumns({"tier": F.lit("correct"), "timestamp": F.lit(1)})
    r = evaluation.agreement(evaluation.common_tiers(judged.unionByName(earlier), t.filter("query % 4 <> 0")), "judge", "human")
    return r.withColumns({c: F.round(c, 6) for c in ("exact_match", "kappa")})
