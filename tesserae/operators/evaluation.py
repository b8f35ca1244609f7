"""Retrieval metrics, answer tiers, agreement and failure triage as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import TIERS


def match_ranks(expected: DataFrame, hits: DataFrame, matches) -> DataFrame:
    """expected (query_id, item), hits (query_id, rank, ...) -> query_id, item, rank: each expected item's best rank,
    null if no hit matches. matches(joined) is the condition."""
    joined = expected.join(hits, "query_id")
    best = joined.filter(matches(joined)).groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    return expected.select("query_id", "item").distinct().join(best, ["query_id", "item"], "left")


def expected_items(queries: DataFrame) -> DataFrame:
    """queries (query_id, expected_symbols, expected_urls, url_match) -> query_id, kind (symbol or url), item, url_match:
    a row for each distinct expected item; queries without any have none."""
    of = lambda kind, items: queries.select("query_id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(items)).alias("item"), "url_match")
    return of("symbol", F.col("expected_symbols")).unionByName(of("url", F.col("expected_urls")))


def item_ranks(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, symbols, canonical_url) -> query_id, item, rank: each expected item's best rank, null if
    none. A hit meets an expected symbol that is among its symbols, and an expected URL under the query's mode. Hits
    are a query's first few, so what meets by query is bounded."""
    items = expected_items(queries)
    joined = items.join(hits.select("query_id", "rank", "symbols", "canonical_url"), "query_id")
    by_url = text.url_matches(F.col("url_match"), F.col("canonical_url"), F.col("item"))
    good = F.when(F.col("kind") == "symbol", F.array_contains("symbols", F.col("item"))).otherwise(by_url)
    best = joined.filter(good).groupBy("query_id", "kind", "item").agg(F.min("rank").alias("rank"))
    return items.join(best, ["query_id", "kind", "item"], "left").select("query_id", F.concat_ws(":", "kind", "item").alias("item"), "rank")


def symbol_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, symbols) that share a symbol with those that their query expects."""
    asked = queries.select("query_id", "expected_symbols")
    return hits.join(asked, "query_id").filter(F.arrays_overlap("symbols", "expected_symbols")).drop("expected_symbols")


def per_query(queries: DataFrame, ranks: DataFrame, policy: str | Column = "any") -> DataFrame:
    """query_id, hit_at_5, hit_at_10, rank. any: the best rank of any item. all: the worst of the items' best ranks,
    null if an item has none. Without expected items: never a hit under any; under all a hit without a rank. policy may
    be a column of queries; a null or unknown one is an error."""
    told = queries.select("query_id", (F.lit(policy) if isinstance(policy, str) else policy).alias("policy"))
    known = F.when(F.col("policy").isin("any", "all"), F.col("policy"))
    told = told.withColumn("policy", F.coalesce(known, F.raise_error(F.concat(F.lit("unknown match policy: "), F.coalesce("policy", F.lit("null"))))))
    by = ranks.groupBy("query_id").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"), F.count("*").alias("items"), F.count("rank").alias("found"))
    row = told.join(by, "query_id", "left")
    every = F.when(F.col("found") == F.col("items"), F.col("worst"))
    rank = F.when(F.col("policy") == "any", F.col("best")).otherwise(every)
    hit = lambda n: F.coalesce(rank <= n, (F.col("policy") == "all") & F.col("items").isNull())
    return row.select("query_id", hit(5).alias("hit_at_5"), hit(10).alias("hit_at_10"), rank.cast("int").alias("rank"))


def run_metrics(results: DataFrame) -> DataFrame:
    """One row: n_queries, recall_at_5, recall_at_10, mrr; zeros without queries."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return results.agg(
        F.count("*").alias("n_queries"), mean(F.col("hit_at_5").cast("int")).alias("recall_at_5"), mean(F.col("hit_at_10").cast("int")).alias("recall_at_10"),
        mean(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )


def tier_table(scores: DataFrame, tier: str = "tier") -> DataFrame:
    """tier, n, rate with a row for every tier."""
    spark = scores.sparkSession
    every = spark.createDataFrame([(t,) for t in TIERS], "tier string")
    counts = scores.groupBy(F.col(tier).alias("tier")).agg(F.count("*").alias("n"))
    total = scores.filter(F.col(tier).isin(*TIERS)).agg(F.count("*")).scalar()
    return every.join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), total), F.lit(0.0)).alias("rate"))


def tier_by_type(scores: DataFrame, kind: str, tier: str = "tier") -> DataFrame:
    """kind, a count of every tier, n, accuracy = (correct + partial) / n, hallucination_rate."""
    count = lambda t: F.count_if(F.col(tier) == t)
    return scores.groupBy(kind).agg(
        *[count(t).alias(t) for t in TIERS], F.count("*").alias("n"), ((count("correct") + count("partial")) / F.count("*")).alias("accuracy"), (count("hallucination") / F.count("*")).alias("hallucination_rate")
    )


def confusion(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1; 0 where a denominator is 0."""
    p, a = F.col(predicted), F.col(actual)
    counted = rows.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    part = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.withColumns({"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2 * tp, 2 * tp + fp + fn)})


def agreement(rows: DataFrame, first: str, second: str) -> DataFrame:
    """n, exact_match and Cohen's kappa of two raters; kappa is 1 where chance alone agrees, zeros without rows."""
    pairs = rows.groupBy(F.col(first).alias("x"), F.col(second).alias("y")).agg(F.count("*").alias("n"))
    a, b = pairs.groupBy("x").agg(F.sum("n").alias("a")), pairs.groupBy("y").agg(F.sum("n").alias("b"))
    chance = a.join(b, a["x"] == b["y"]).agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("c"))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0)).alias("same"))
    po = F.coalesce(F.try_divide(F.col("same").cast("double"), F.col("n")), F.lit(0.0))
    pe = F.coalesce(F.try_divide(chance.scalar(), F.col("n").cast("double") * F.col("n")), F.lit(0.0))
    scored = total.select("n", po.alias("exact_match"), pe.alias("pe"))
    kappa = F.when(F.col("n") == 0, 0.0).when(F.col("pe") == 1, 1.0).otherwise((F.col("exact_match") - F.col("pe")) / (1 - F.col("pe")))
    return scored.select("n", "exact_match", kappa.alias("kappa"))


def failure_bucket(tier, hit):
    """The tier, with refusals told apart by whether retrieval had hit."""
    return F.when(tier == "refused", F.when(hit, "refused_with_hit").otherwise("refused_without_hit")).otherwise(tier)


def triage(rows: DataFrame, bucket: str = "bucket") -> DataFrame:
    total = rows.agg(F.count("*")).scalar()
    return rows.groupBy(bucket).agg(F.count("*").alias("n")).withColumn("rate", F.col("n") / total)


def first_rows(rows: DataFrame, group: str, order: list, n: int = 3) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)


def common_tiers(judged: DataFrame, human: DataFrame, query: str = "query", order: str = "timestamp") -> DataFrame:
    """judged (query, tier, timestamp), human (query, tier) -> query, judge, human: the queries that both have, with the
    judge's last tier; the input of agreement."""
    last = join_judgments(human.select(query, F.col("tier").alias("human")), judged.select(query, F.col("tier").alias("judge"), order), query, order)
    return last.select(query, "judge", "human")


def cited_chunks(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """answers (query_id, answer), hits (query_id, rank, chunk_id) -> query_id, text, cited_chunk_ids, refused.

    A citation is a place among the query's hits in order of rank; places that it has not are passed over. A refusal
    has no text and cites nothing."""
    listed = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"]).alias("_hits"))
    rows = answers.join(listed, "query_id", "left")
    none = F.slice("_hits", 1, 0)
    refused = text.is_refusal(F.col("answer"))
    cited = F.when(refused, none).otherwise(text.cited_chunks(text.citations(F.col("answer")), F.col("_hits")))
    empty = F.array().cast(f"array<{dict(hits.dtypes)['chunk_id']}>")
    return rows.select("query_id", F.when(refused, "").otherwise(text.without_refusal(F.col("answer"))).alias("text"), F.coalesce(cited, empty).alias("cited_chunk_ids"), refused.alias("refused"))


def mark_cited(hits: DataFrame, cited: DataFrame) -> DataFrame:
    """hits with cited: whether their query's answer (of cited_chunks) cites them."""
    ids = cited.select("query_id", F.explode("cited_chunk_ids").alias("chunk_id")).distinct().withColumn("cited", F.lit(True))
    return hits.join(ids, ["query_id", "chunk_id"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))


def join_judgments(results: DataFrame, judgments: DataFrame, query: str = "query", order: str = "timestamp") -> DataFrame:
    """results with each query's last judgment (by order); results without one go."""
    last = judgments.withColumn("_n", F.row_number().over(W.partitionBy(query).orderBy(F.desc(order)))).filter("_n = 1").drop("_n", order)
    return results.join(last, query)


def search_rows(hits: DataFrame, chunks: DataFrame, version: str, chars: int = 1500) -> DataFrame:
    """What a search returns to a user: query_id, rank, score, chunk_id, title, url, body; hits of unknown chunks go and
    ranks keep their gaps."""
    joined = hits.join(chunks.select("chunk_id", "title", "text", "canonical_url"), "chunk_id")
    return joined.select("query_id", "rank", "score", "chunk_id", "title", text.public_url(version, F.col("canonical_url")).alias("url"), text.truncate(F.col("text"), chars).alias("body"))


#: The grouping sets of a report over runs: each alone, each in a run, and all together.
REPORT_SETS = (("run",), ("run", "query_type"), ("run", "tier"), ("run", "query_type", "tier"), ("query_type",), ("tier",), ())


def run_report(results: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """results (run, query_type, tier, hit_at_5, hit_at_10, rank, latency_seconds, answer) -> a row for each group of every
    set of REPORT_SETS, each pass with one exchange: what it groups by (grouped: the columns' names), n, recall_at_5,
    recall_at_10, mrr, latency quantiles and the number of different words of the answers.

    Counts and means are exact. Latencies are kept as a sketch of quantiles and words as one of distinct values, which
    tasks merge: neither grows with the data. An empty table gives no groups. (Quantiles are off by about 1 % in rank, numbers of words by 2 %.)"""
    sets = ["run", "query_type", "tier"]
    words = F.explode_outer(F.array_distinct(F.filter(F.split(F.lower("answer"), r"\W+"), lambda w: w != "")))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    groups = [[F.col(c) for c in s] for s in REPORT_SETS]
    grouped = F.array_join(F.filter(F.array(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in sets]), lambda x: x.isNotNull()), ",").alias("grouped")
    exact = results.groupingSets(groups, *sets).agg(
        grouped, F.count("*").alias("n"), mean(F.col("hit_at_5").cast("int")).alias("recall_at_5"), mean(F.col("hit_at_10").cast("int")).alias("recall_at_10"),
        mean(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.percentile_approx(F.col("latency_seconds").cast("double"), list(quantiles), 1000).alias("latency"),
    )
    counted = results.select(*sets, words.alias("word")).groupingSets(groups, *sets).agg(grouped, F.approx_count_distinct("word", 0.02).alias("vocabulary"))
    same = [exact[c].eqNullSafe(counted[c]) for c in ("grouped", *sets)]
    columns = [exact[c] for c in ("grouped", *sets, "n", "recall_at_5", "recall_at_10", "mrr", "latency")]
    return exact.join(counted, same).select(*columns, counted["vocabulary"])
