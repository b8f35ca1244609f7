"""JSON Lines relations with schemas that are checked when they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import TIERS

# Fixed values of the formats.
QUERY_TYPES = ("identifier", "natural_language", "comparison", "howto", "out_of_scope")
MATCH_POLICIES, URL_MATCHES = ("any", "all"), ("exact", "strip_anchor", "prefix")

CHUNK = (
    "chunk_id string, chunk_type string, docs_version string, title string, text string, symbols array<string>, "
    "canonical_url string, anchor string, parent_module string, source_path string, source_hash string"
)
EVAL_QUERY = "query string, query_type string, expected_symbols array<string>, expected_urls array<string>, match_policy string, url_match string, notes string"
HUMAN_SCORE = "query string, tier string, notes string"
JUDGE_RECORD = "query string, tier string, notes string, raw_output string, judge_model string, judge_prompt_hash string, timestamp string"
TRAINING_ROW = "query string, query_type string, source string, retrieved_chunk_ids array<string>, answer string, refused boolean, latency_seconds double"
CORPUS_LINE = "text string, source string"


class SourceError(ValueError):
    """A row breaks its relation's rules."""


#: Where a row's line is: its file, where the part of the file that one task reads begins, and a number within the scan.
_AT = "_at"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and _at. Numbers ascend by line within a part, and parts are the same in every scan of the same files."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    return spark.read.text(path).select("value", at.alias(_AT))


def line_numbers(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows with _at -> with file and line (from 1, blank lines counted) in place of it. Large files are read in parts, in
    parallel: the lines of every part are counted, and a row's line follows from the parts before its own."""
    each = _lines(spark, path).groupBy(f"{_AT}.file", f"{_AT}.start").agg(F.min(f"{_AT}.id").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = each.select(F.col("file").alias("_file"), F.col("start").alias("_start"), "low", before.alias("before"))
    met = rows.join(parts, (F.col(f"{_AT}.file") == F.col("_file")) & (F.col(f"{_AT}.start") == F.col("_start")))
    line = F.col("before") + F.col(f"{_AT}.id") - F.col("low") + 1
    return met.withColumn("file", F.col("_file")).withColumn("line", line.cast("bigint")).drop(_AT, "_file", "_start", "low", "before")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON Lines file or folder, with where their line is in _at; blank lines are passed over, and a line that
    is no object of the schema is kept with its text in _corrupt."""
    lines = _lines(spark, path).filter(F.trim("value") != "")
    parsed = lines.select(_AT, F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.select("r.*", _AT)


def checked(rows: DataFrame, rules: dict[str, Column], unique: str | None = None, path: str | None = None) -> DataFrame:
    """rows, after one pass that counts the breaches of each rule; raises SourceError naming the first breach, and for rows
    of read_lines(path) the file and the line. Lines are counted only then."""
    wrong = {name: F.count_if(~F.coalesce(rule, F.lit(False))) for name, rule in rules.items()}
    if "_corrupt" in rows.columns:
        wrong = {"valid JSON": F.count_if(F.col("_corrupt").isNotNull())} | wrong
    found = rows.agg(*[c.alias(n) for n, c in wrong.items()]).first() if wrong else {}
    for name in wrong:
        if found[name]:
            broken = F.col("_corrupt").isNotNull() if name == "valid JSON" else ~F.coalesce(rules[name], F.lit(False))
            raise SourceError(f"{_where(rows.filter(broken), path)}{found[name]} rows break the rule: {name}")
    if unique:
        twice = rows.groupBy(unique).agg(F.count("*").alias("n")).filter("n > 1").first()
        if twice:
            raise SourceError(f"{_where(rows.filter(F.col(unique) == twice[0]), path, 1)}{unique} occurs more than once: {twice[0]!r}")
    return rows.drop("_corrupt", _AT)


def _where(rows: DataFrame, path: str | None, skip: int = 0) -> str:
    """The first of the rows (after `skip` others) in order of file and line, as text."""
    if path is None or _AT not in rows.columns:
        return f"{rows.drop(_AT).first()}: "
    first = rows.orderBy(f"{_AT}.file", f"{_AT}.start", f"{_AT}.id").limit(skip + 1).collect()[-1]
    one = rows.filter((F.col(f"{_AT}.file") == first[_AT].file) & (F.col(f"{_AT}.start") == first[_AT].start) & (F.col(f"{_AT}.id") == first[_AT].id))
    row = line_numbers(rows.sparkSession, path, one).drop("_corrupt").first()
    told = {k: v for k, v in row.asDict().items() if k not in ("file", "line") and v is not None}
    return f"{row.file}, line {row.line} ({told}): "


def _filled(column: str) -> Column:
    return F.length(F.trim(column)) > 0


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries with a query_id (a hash of the query), and defaults for the two match columns."""
    rows = read_lines(spark, path, EVAL_QUERY)
    rows = rows.withColumns({"match_policy": F.coalesce("match_policy", F.lit("any")), "url_match": F.coalesce("url_match", F.lit("strip_anchor"))})
    rules = {
        "query is filled": _filled("query"), "query_type is known": F.col("query_type").isin(*QUERY_TYPES), "expected_symbols is a list": F.col("expected_symbols").isNotNull(),
        "expected_urls is a list": F.col("expected_urls").isNotNull(), "match_policy is known": F.col("match_policy").isin(*MATCH_POLICIES), "url_match is known": F.col("url_match").isin(*URL_MATCHES),
    }
    return checked(rows, rules, path=path).withColumn("query_id", F.xxhash64("query"))


def human_scores(spark: SparkSession, path: str) -> DataFrame:
    return checked(read_lines(spark, path, HUMAN_SCORE), {"query is filled": _filled("query"), "tier is known": F.col("tier").isin(*TIERS)}, "query", path)


def judge_records(spark: SparkSession, path: str) -> DataFrame:
    needed = ("query", "tier", "raw_output", "judge_model", "judge_prompt_hash", "timestamp")
    rules = {f"{c} is present": F.col(c).isNotNull() for c in needed}
    return checked(read_lines(spark, path, JUDGE_RECORD), rules | {"tier is known": F.col("tier").isin(*TIERS)}, path=path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with unique ids."""
    return checked(read_lines(spark, path, CHUNK), {"chunk_id is filled": _filled("chunk_id"), "chunk_type is known": F.col("chunk_type").isin("symbol", "section")}, "chunk_id", path)


def training_rows(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Rows all of whose chunks are known."""
    from ..operators.corpus import without_missing

    rows = checked(read_lines(spark, path, TRAINING_ROW), {"query is filled": _filled("query")}, path=path)
    return without_missing(rows, "query", "retrieved_chunk_ids", known)


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    return checked(read_lines(spark, path, CORPUS_LINE), {}, path=path).filter(F.col("text").rlike(r"\S"))


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)
