"""Importance resampling towards a target distribution.

Documents and target texts are bags of hashed word n-grams. A bucket's gain is the log ratio of its smoothed shares in
target and documents, a document's weight the mean gain of its n-grams, and adding Gumbel noise drawn from the id's
hash makes the highest scores a sample without replacement in proportion to the weights.

A batch's texts are joined with a separator that no word holds; one pattern finds all words of the batch in one pass;
searchsorted over the documents' offsets says whose each word is, and n-grams whose ends lie in different documents are
masked before they are counted. A task sends its counts once, so what is gathered has at most BUCKETS rows a task and
BUCKETS rows in all, whatever the data; the gains are as many numbers.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches_by_bytes, map_texts, materialize

BUCKETS, ORDER, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Most buckets, which bounds what the driver and every task hold.
MOST_BUCKETS = 1 << 20
#: Gains and noise are whole numbers of this part of a nat.
SCALE = 1000.0

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Runs of ASCII letters, digits and everything above ASCII; texts are lower-cased before.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SEPARATOR = b"\x00"


def grams(texts: list, order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """texts (str or None) -> (words of each text, bucket of each n-gram of 1 to order words, text of each n-gram)."""
    raw = [b"" if t is None else t.encode() for t in texts]
    first = np.cumsum([0] + [len(t) + 1 for t in raw])
    at, crc, words = [], [], []
    for m in _WORDS.finditer(_SEPARATOR.join(raw).translate(_LOWER)):
        at.append(m.start())
        words.append(m.group())
    whose = np.searchsorted(first, np.array(at, np.int64), "right") - 1
    found, owners = [], []
    for n in range(1, order + 1):
        # an n-gram's text goes on where the one that is a word shorter ends, and so does its checksum
        crc = [zlib.crc32(b" " + w, c) for w, c in zip(words[n - 1 :], crc, strict=False)] if crc else list(map(zlib.crc32, words)) if n == 1 else []
        within = whose[n - 1 :] == whose[: max(0, len(whose) - n + 1)]
        found.append(np.array(crc, np.int64)[within] % buckets)
        owners.append(whose[n - 1 :][within])
    return np.bincount(whose, minlength=len(texts)), np.concatenate(found), np.concatenate(owners)


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How often the n-grams of all texts fall in each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            held = batch.column("text").to_pylist()
            for a, b in batches_by_bytes(held):
                total += np.bincount(grams(held[a:b], order, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # a row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, floor(1000 ln) of the target's smoothed share over the source's; empty sides give even shares."""
    b = len(source)
    s, t = source.astype(float), target.astype(float)
    return np.floor(SCALE * np.log((t + 1.0) * (s.sum() + b) / ((s + 1.0) * (t.sum() + b)))).astype(np.int64)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise from the first 32 bits of the SHA-256 of seed and key, a whole number; a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-SCALE) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


@dataclass
class Target:
    """What was learned from documents and target: a gain for each bucket."""

    gain: np.ndarray
    order: int = ORDER

    @classmethod
    def fit(cls, documents: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> Target:
        """documents (text), target (text): all texts of both are counted."""
        if not 1 <= buckets <= MOST_BUCKETS or order < 1:
            raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS} and order 1 at least")
        return cls(gains(bucket_counts(documents, order, buckets), bucket_counts(target, order, buckets)), order)

    def score(self, documents: DataFrame, seed: int = SEED) -> DataFrame:
        """documents (doc_id, text) -> doc_id, n_words, n_features, weight, score, one row per row."""
        shared = documents.sparkSession.sparkContext.broadcast(self.gain)
        order, kind = self.order, dict(documents.dtypes)["doc_id"]

        def make():
            gain = shared.value

            def one(batch: pa.RecordBatch) -> dict:
                words, bucket, whose = grams(batch.column("text").to_pylist(), order, len(gain))
                n = np.bincount(whose, minlength=batch.num_rows)
                # exact integers: partial sums of a batch stay far below 2^53
                total = np.bincount(whose, gain[bucket], batch.num_rows).astype(np.int64)
                return {"doc_id": batch.column("doc_id"), "n_words": words, "n_features": n, "weight": np.where(n > 0, total // np.maximum(n, 1), 0)}

            return one

        scored = map_texts(documents.select("doc_id", "text"), make, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
        return scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, others), a written table -> its rows with rank: 1, 2, 3... for the
    floor(percent * N / 100) highest scores of the N rows with least_words words, ties to the smaller doc_id, else null.

    Rows are counted by score first. Scores are whole thousandths of nats, and both parts of a score are logarithms of
    counts and of a 32-bit number, so fewer than 100,000 values occur however many rows there are: that table alone is
    ordered as a whole and broadcast. The noise spreads rows over the scores (one value holds less than 4 in 10,000 of
    the rows of a weight), and only rows that may be drawn are exchanged, by score."""
    may = F.col("n_words") >= least_words
    counted = scored.filter(may).groupBy("score").agg(F.count("*").alias("n"))
    most = F.floor(counted.agg(F.sum("n")).scalar() * percent / 100).cast("bigint")
    before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = counted.select(F.col("score").alias("_score"), before.alias("_before")).withColumn("_most", most).filter("_before < _most")
    placed = scored.join(F.broadcast(base), may & (F.col("score") == F.col("_score")), "left")
    place = F.col("_before") + F.row_number().over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_words"))
    drawn = placed.filter("_before IS NOT NULL").withColumn("rank", place.cast("bigint")).withColumn("rank", F.when(F.col("rank") <= F.col("_most"), F.col("rank")))
    rest = placed.filter("_before IS NULL").withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).drop("_score", "_before", "_most")


def resample(documents: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """documents (doc_id, text), target (text) -> doc_id, n_words, n_features, weight, score and rank (null: not drawn).

    One row per input row. A null text has no words, no features and weight 0, and so has one without letters or digits.
    A null doc_id counts as the empty text in the noise and comes first among ties; rows that agree in doc_id and score
    are interchangeable. An empty target, or an empty table, leaves even shares. Texts are taken whole, whatever their
    length. Other columns of both tables are ignored."""
    scored = materialize(Target.fit(documents, target, order, buckets).score(documents, seed), "importance-scores")
    return draw(scored, percent, least_words)


def resampled_documents(documents: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The documents that are drawn, whole and with all their columns; every row of a drawn doc_id is one of them."""
    drawn = resample(documents, target, **parameters).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    return documents.join(drawn, documents["doc_id"].eqNullSafe(drawn["_id"]), "left_semi")
