"""The bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold

#: Bounds of a sample: rows, and bytes of their texts. Rows are chosen by hash alone, so long texts are as likely as
#: short ones; where the bytes are reached first, fewer rows are taken.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 12 << 20


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, held_out: int = 0) -> list[tuple[str, int]]:
    """At most `rows` (text, label) of labelled documents outside the held-out fold, in order of the id's hash, whole,
    as long as the texts before stay below most_bytes.

    The ids are chosen first, then the sizes of their texts are added up, so only bounded lists are broadcast and no
    text that is not taken is shuffled. Rows with a null id, label or text are passed over."""
    order = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna().filter(fold(F.col("doc_id")) != held_out)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(*order).limit(rows)
    texts = documents.select("doc_id", "text").dropna()
    sizes = texts.select("doc_id", F.octet_length("text").alias("bytes")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.sum("bytes").alias("bytes"))
    before = F.sum("bytes").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("bytes")
    taken = sizes.withColumn("before", before).filter(F.col("before") < most_bytes).select("doc_id", "label")
    found = texts.join(F.broadcast(taken), "doc_id").orderBy(*order, "text").limit(rows).select("text", "label")
    return [(r.text, r.label) for r in found.collect()]
