"""Symbol index: exact and fuzzy look-up of names, routing and typo rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranking
from .fuzzy import fuzzy_join

# Fixed values of the behaviour that is reproduced.
ROLE_PRIORITY = {
    "py:class": 0, "py:exception": 0, "py:module": 0, "py:method": 1, "py:classmethod": 1, "py:staticmethod": 1,
    "py:function": 2, "py:attribute": 3, "py:data": 4,
}
UNKNOWN_PRIORITY, FUZZY_THRESHOLD, MAX_EDITS = 999, 85, 2


def role_priority(role: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROLE_PRIORITY.items() for x in pair])
    return F.coalesce(table[role], F.lit(UNKNOWN_PRIORITY))


def candidates(chunks: DataFrame, inventory: DataFrame) -> DataFrame:
    """chunks (chunk_id, chunk_type, symbols), inventory (name, role, module) -> chunk_id, fqn, role, parent_module: the
    symbol chunks, each with the inventory's first entry of its name (by role and module)."""
    first = inventory.withColumn("n", F.row_number().over(W.partitionBy("name").orderBy(role_priority(F.col("role")), F.coalesce("module", F.lit(""))))).filter("n = 1")
    own = chunks.filter("chunk_type = 'symbol'").select("chunk_id", F.element_at("symbols", 1).alias("fqn"))
    return own.join(first.select(F.col("name").alias("fqn"), "role", F.col("module").alias("parent_module")), "fqn")


def alias_table(found: DataFrame) -> DataFrame:
    """One row for each candidate and dotted suffix of its name."""
    return found.withColumn("alias", F.explode(T.aliases(F.col("fqn"))))


def ordered(hits: DataFrame) -> DataFrame:
    """Ranks by role priority, module and name."""
    w = W.partitionBy("query_id").orderBy(role_priority(F.col("role")), F.coalesce("parent_module", F.lit("")), "fqn", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w))


def exact(queries: DataFrame, table: DataFrame) -> DataFrame:
    """queries (query_id, text): the candidates of which text is an alias."""
    return ordered(queries.join(table, queries["text"] == table["alias"]).select("query_id", "chunk_id", "fqn", "role", "parent_module"))


def fuzzy(queries: DataFrame, found: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """The candidates whose name has a ratio of threshold or more with the query: those of fuzzy_join's pairs."""
    pairs = fuzzy_join(queries.select("text").distinct(), found.select(F.col("fqn").alias("name")).distinct(), threshold)
    scored = queries.select("query_id", "text").join(pairs, "text").join(found, F.col("name") == found["fqn"])
    w = W.partitionBy("query_id").orderBy(F.desc("score"), role_priority(F.col("role")), F.coalesce("parent_module", F.lit("")), "fqn", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).select("query_id", "chunk_id", "fqn", "role", "parent_module", "score", "rank")


def lookup(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Exact hits, and fuzzy ones for the queries without any."""
    direct = exact(queries, alias_table(found)).withColumn("score", F.lit(100.0))
    rest = queries.join(direct.select("query_id").distinct(), "query_id", "left_anti")
    columns = ["query_id", "chunk_id", "fqn", "role", "parent_module", "score", "rank"]
    return ranking.first_of([("exact", direct.select(*columns)), ("fuzzy", fuzzy(rest, found).select(*columns))])


def route(queries: DataFrame, symbol_hits, text_hits, k: int) -> DataFrame:
    """Identifiers go to symbol_hits(queries) first, the rest and identifiers without a hit to text_hits(queries);
    `used` names which answered and the score is 1 / rank."""
    kinds = queries.withColumn("query_type", T.classify_query(F.col("text")))
    direct = symbol_hits(kinds.filter("query_type = 'identifier'")).select("query_id", "chunk_id", "rank").filter(F.col("rank") <= k)
    rest = kinds.join(direct.select("query_id").distinct(), "query_id", "left_anti")
    found = text_hits(rest).select("query_id", "chunk_id", "rank").filter(F.col("rank") <= k)
    return ranking.positional(direct.withColumn("used", F.lit("symbol")).unionByName(found.withColumn("used", F.lit("bm25"))))


def near_names(queries: DataFrame, names: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """queries (query_id, text), names (symbol, distinct) -> query_id, text, symbol of every pair whose lower-cased forms
    are `edits` or fewer insertions, deletions and replacements apart.

    A name is cut into edits + 1 parts; as so few edits leave one of them whole, it stands in the query, moved by
    `edits` places at most. Names meet queries under (length, part, its letters) and are compared in full then."""
    parts = edits + 1
    n = F.length("low")
    cut = lambda size, k: F.floor(size * k / parts).cast("int")  # noqa: E731  where part k begins
    low = names.select("symbol", F.lower("symbol").alias("low"))
    keys = low.select("symbol", n.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "low")
    keys = keys.select("symbol", "size", "part", F.substring("low", cut(F.col("size"), F.col("part")) + 1, cut(F.col("size"), F.col("part") + 1) - cut(F.col("size"), F.col("part"))).alias("letters"))
    asked = queries.select("query_id", "text", F.lower("text").alias("low"))
    probes = asked.withColumn("size", F.explode(F.sequence(F.greatest(F.lit(0), n - edits), n + edits))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    begin = cut(F.col("size"), F.col("part"))
    probes = probes.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), begin - edits), F.greatest(F.lit(0), begin + edits))))
    probes = probes.select("query_id", "text", "size", "part", F.substring("low", F.col("at") + 1, cut(F.col("size"), F.col("part") + 1) - begin).alias("letters")).distinct()
    pairs = probes.join(keys, ["size", "part", "letters"]).select("query_id", "text", "symbol").distinct()
    return pairs.filter(F.levenshtein(F.lower("text"), F.lower("symbol")) <= edits)


def rewrite_typos(retrieved: DataFrame) -> DataFrame:
    """retrieved (query_id, text, symbol: one row per symbol of the query's top hits, or null) -> query_id, rewritten.

    The nearest symbol by Levenshtein distance of the lower-cased strings replaces the query, unless the query is one
    of the symbols as it is, the nearest is more than MAX_EDITS away, or several symbols are as near."""
    d = F.levenshtein(F.lower("text"), F.lower("symbol"))
    rows = retrieved.withColumn("d", d)
    near = rows.groupBy("query_id", "text").agg(F.min("d").alias("least"), F.max((F.col("symbol") == F.col("text")).cast("int")).alias("same"))
    best = rows.join(near.select("query_id", "least"), "query_id").filter("d = least").groupBy("query_id").agg(F.min("symbol").alias("symbol"), F.countDistinct("symbol").alias("n"))
    change = (F.col("same") == 0) & (F.col("least") <= MAX_EDITS) & (F.col("n") == 1)
    return near.join(best, "query_id", "left").select("query_id", F.when(change, F.col("symbol")).otherwise(F.col("text")).alias("rewritten"))
