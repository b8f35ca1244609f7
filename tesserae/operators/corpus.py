"""Corpus preparation: budgets, sampling, mixing, packing, training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import materialize

IGNORED = -100  # fixed value: the label that a loss passes over


def non_blank(text: Column) -> Column:
    return text.rlike(r"\S")


def running_before(df: DataFrame, key: str, value: Column, name: str = "before") -> DataFrame:
    """key, and the sum of value over all rows of df with a smaller key; keys are unique, of any type that has an order.

    Only keys and values are exchanged, by ranges of the key that Spark draws from a sample, so they are even however
    sparse or clustered the keys are; what is ordered as a whole are the ranges' sums."""
    dealt = df.select(key, F.coalesce(value, F.lit(0)).cast("bigint").alias("_value")).repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id())
    ranged = materialize(dealt, "running")  # its ranges are drawn once
    base = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum")).select("_range", _before("_sum", W.orderBy("_range")).alias("_base"))
    inside = ranged.withColumn("_inside", _before("_value", W.partitionBy("_range").orderBy(key)))
    return inside.join(base, "_range").select(key, (F.col("_base") + F.col("_inside")).alias(name))


def _before(value: str, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def byte_budget(docs: DataFrame, key: str, target: int, text: str = "text") -> DataFrame:
    """Rows in order of key until their bytes reach target; the last one may overshoot. Blank texts are passed over."""
    rows = docs.filter(non_blank(F.col(text)))
    return rows.join(running_before(rows, key, F.octet_length(text)).filter(F.col("before") < target), key)


def keyed_share(key: Column, seed: str) -> Column:
    """A number in [0, 2^60) from the MD5 of seed and key; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 15), 16, 10).cast("bigint")


def bernoulli_bytes(docs: DataFrame, key: str, target: int, seed: str, text: str = "text") -> DataFrame:
    """Each row with probability target / total bytes, by its key's hash, in order of key until target is reached."""
    rows = docs.filter(non_blank(F.col(text)))
    total = rows.agg(F.sum(F.octet_length(text))).scalar()
    drawn = rows.filter(keyed_share(F.col(key), seed).cast("double") / float(1 << 60) < F.least(F.lit(1.0), F.lit(float(target)) / total))
    return byte_budget(drawn, key, target, text)


def tiled(docs: DataFrame, key: str, target: int, text: str = "text") -> DataFrame:
    """docs repeated in order until target bytes: (tile, key, bytes, before)."""
    rows = docs.filter(non_blank(F.col(text))).select(key, F.octet_length(text).alias("bytes"))
    total = rows.agg(F.sum("bytes")).scalar()
    placed = rows.join(running_before(rows, key, F.col("bytes")), key).withColumn("total", total)
    tiles = placed.withColumn("tile", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.lit(float(target)) / F.col("total")).cast("int") - 1))))
    return tiles.withColumn("before", F.col("before") + F.col("tile") * F.col("total")).filter(F.col("before") < target).select("tile", key, "bytes", "before")


def seeded_shuffle(docs: DataFrame, key: str, seed: str) -> DataFrame:
    """docs in order of a seeded hash; order is the hash, ties by key. No position is numbered in one task."""
    return docs.withColumn("shuffle_key", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).orderBy("shuffle_key", key)


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, strata: int, seed: str) -> DataFrame:
    """ceil(n / strata) rows of each stratum by a seeded hash; all of a smaller one."""
    w = W.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= -(-n // strata)).drop("place")


def sample_n(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement by a seeded hash."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def first_occurrences(docs: DataFrame, value: str, key: str) -> DataFrame:
    """The smallest key of each value; values meet by their SHA-256."""
    return docs.groupBy(F.sha2(value, 256).alias("sha256")).agg(F.min(key).alias(key))


def pack(tokens: DataFrame, key: str, length: int, column: str = "tokens") -> DataFrame:
    """tokens (key unique integer, array of tokens) end to end -> segments of `length` (segment, tokens); the
    incomplete last one is dropped. Places come from the sizes alone; documents are cut where segments begin, and the
    pieces meet by segment. Tokens are written once before, as their sizes are read first."""
    sized = materialize(tokens.select(key, column, F.size(column).alias("n")), "tokens").filter("n > 0")
    placed = sized.join(running_before(sized, key, F.col("n"), "start"), key)
    pieces = placed.withColumn("segment", F.explode(F.expr(f"sequence(start div {length}, (start + n - 1) div {length})")))
    low = F.greatest(F.lit(0), F.col("segment") * length - F.col("start")).cast("int")
    high = F.least(F.col("n"), (F.col("segment") + 1) * length - F.col("start")).cast("int")
    cut = pieces.select("segment", F.struct(F.col("start"), F.slice(column, low + 1, high - low).alias("part")).alias("piece"))
    whole = cut.groupBy("segment").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["part"])).alias(column))
    return whole.filter(F.size(column) == length)


def write_segments(segments: DataFrame, path: str, length: int, vocabulary: int, mode: str = "errorifexists") -> None:
    """Segments as a table, and what a reader has to know of them as another."""
    segments.write.mode(mode).parquet(f"{path}/segments")
    about = segments.agg(F.count("*").alias("n")).select("n", F.lit(length).alias("length"), F.lit(vocabulary).alias("vocabulary"))
    about.write.mode(mode).json(f"{path}/about")


def read_segments(spark: SparkSession, path: str, length: int, vocabulary: int) -> DataFrame:
    """The segments that write_segments wrote, if they are as long and of a vocabulary as large as asked for."""
    about = spark.read.schema("n long, length int, vocabulary int").json(f"{path}/about").first()
    if (about.length, about.vocabulary) != (length, vocabulary):
        raise ValueError(f"segments of length {about.length} over {about.vocabulary} tokens, not {length} over {vocabulary}")
    return spark.read.parquet(f"{path}/segments")


def shifted(segments: DataFrame, column: str = "tokens") -> DataFrame:
    """Inputs and next-token targets of each segment."""
    n = F.size(column)
    return segments.withColumn("inputs", F.slice(column, F.lit(1), n - 1)).withColumn("targets", F.slice(column, F.lit(2), n - 1))


def training_records(pairs: DataFrame, prompt: str, answer: str, most: int) -> DataFrame:
    """Token arrays of prompt and answer -> input_ids, labels (the prompt masked), prompt_len. The head of a prompt
    that is too long goes; a row whose answer alone is longer than most goes."""
    room = most - F.size(answer)
    kept = pairs.filter(F.size(answer) <= most).withColumn("_prompt", F.when(F.size(prompt) <= room, F.col(prompt)).when(room > 0, F.slice(prompt, F.size(prompt) - room + 1, F.greatest(room, F.lit(1)))).otherwise(F.slice(prompt, 1, 0)))
    masked = F.transform("_prompt", lambda x: F.lit(IGNORED))
    return kept.withColumn("input_ids", F.concat("_prompt", answer)).withColumn("labels", F.concat(masked, answer)).withColumn("prompt_len", F.size("_prompt")).drop("_prompt")


def pad(rows: DataFrame, batch: str, pad_id: int = 0) -> DataFrame:
    """input_ids and labels filled on the right to the longest of their batch."""
    width = F.max(F.size("input_ids")).over(W.partitionBy(batch))
    more = F.col("_width") - F.size("input_ids")
    wide = rows.withColumn("_width", width)
    return wide.withColumn("labels", F.concat("labels", F.array_repeat(F.lit(IGNORED), more))).withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad_id), more))).drop("_width")


def without_missing(rows: DataFrame, key: str, ids: str, known: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """rows all of whose ids are known."""
    asked = rows.select(key, F.explode(ids).alias(chunk_id)).distinct()
    missing = asked.join(known.select(chunk_id), chunk_id, "left_anti")
    return rows.join(missing.select(key).distinct(), key, "left_anti")


def training_corpus(queries: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """queries (query_id, query, source: eval before synthetic), hits (query_id, chunk_id, rank), answers (query_id,
    answer, refused) -> one row per distinct query with its chunk ids and its rejection_reason (null if accepted)."""
    order = W.partitionBy("query").orderBy(F.when(F.col("source") == "eval", 0).otherwise(1), "query_id")
    once = queries.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
    chunks = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved_chunk_ids"))
    rows = once.join(chunks, "query_id", "left").join(answers, "query_id")
    return rows.withColumn("rejection_reason", T.reject_reason(F.col("answer"), F.col("refused")))


def retrieval_misses(known: DataFrame, hits: DataFrame) -> DataFrame:
    """known (query_id, chunk_id): queries whose known source is not among their hits."""
    return known.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
