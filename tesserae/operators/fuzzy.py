"""Joining strings whose ratio (twice the longest common subsequence over both lengths) reaches a threshold.

Names lie in an inverted index of positional q-grams. A ratio bounds how many characters a pair may lose on either side,
and a lost character breaks few q-grams, so a pair shares a known number of them, in the same order and moved by few
places only. Of all q-grams of a string as many as may be lost, and one more, are enough to hold a shared one: the
rarest are taken on both sides. Pairs that meet under a gram and a near place are compared: bit-parallel comparison
costs no more than counting all grams they share would.

Let s be the sum of both lengths and L the least common subsequence that the threshold asks for. A character that is
left out breaks q grams, one that is put in q - 1, so (2q - 1) L - (q - 1) s - q + 1 grams are shared. Pairs for which
two-character grams give no bound (short strings, or low thresholds) meet by their single characters.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity

#: Most frequent grams that are put last (a list of a bounded size); all others count as rare.
FREQUENT = 4096
#: Places that share a key.
PLACES = 8
_EPSILON = 1e-6


class Bounds:
    """What a threshold says about lengths and shared grams."""

    def __init__(self, threshold: float):
        if not 0 < threshold <= 100:
            raise ValueError("threshold must be over 0, and 100 at most")
        self.threshold = threshold
        gain = 3 * threshold / 200 - 1  # shared two-character grams for each character of both strings, but for a constant
        #: pairs of at least so many characters share a two-character gram
        self.both = next(s for s in range(int(4 / gain) + 8, -1, -1) if s == 0 or self.shared(s - 1, 2) < 1) if gain > 0.01 else math.inf

    def common(self, s: int) -> int:
        """Least common subsequence of strings of s characters together; scores are rounded to six digits."""
        return math.ceil((self.threshold - _EPSILON) * s / 200)

    def shared(self, s: int, q: int) -> int:
        return (2 * q - 1) * self.common(s) - (q - 1) * s - q + 1

    def partners(self, n: int) -> range:
        """Lengths that a string of n characters may be paired with."""
        reach = (200 - self.threshold + _EPSILON) / (self.threshold - _EPSILON)  # the longer over the shorter, at most
        return range(math.floor(n / reach), math.ceil(n * reach) + 1)

    @lru_cache(maxsize=4096)  # noqa: B019
    def takes(self, n: int) -> list[tuple[int, int, int, int]]:
        """For a string of n characters (q, how many grams are taken, places that a gram may move back and forward)."""
        out = []
        for q in (1, 2):
            lengths = [m for m in self.partners(n) if (n + m >= self.both) == (q == 2) and self.common(n + m) <= min(n, m)]
            if lengths and n >= q:
                least = min(self.shared(n + m, q) for m in lengths)
                out.append((q, n - q + 1 - least + 1, max(n - self.common(n + m) for m in lengths), max(m - self.common(n + m) for m in lengths)))
        return out


def taken(text: str, bounds: Bounds, frequent: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """(gram, place, back, forward) of the rarest grams of text; the empty string has the empty gram."""
    out = [] if text else [("", 0, 0, 0)]
    for q, n, back, forward in bounds.takes(len(text)):
        grams = sorted((frequent.get(text[i : i + q], 0), text[i : i + q], i) for i in range(len(text) - q + 1))
        out += [(g, i, back, forward) for _, g, i in grams[: max(0, n)]]
    return out


def _grams(text: Column, q: int) -> Column:
    n = F.length(text) - (q - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def _signatures(texts: DataFrame, column: str, bounds: Bounds, frequent: dict[str, int], spread: bool) -> DataFrame:
    """column, gram, place and the place's key: with spread all keys that the gram may have moved to."""

    @F.pandas_udf("array<struct<gram: string, place: int, key: int>>")
    def run(batch: pd.Series) -> pd.Series:
        keys = lambda i, back, forward: range((i - back) // PLACES, (i + forward) // PLACES + 1) if spread else (i // PLACES,)
        return batch.map(lambda t: [{"gram": g, "place": i, "key": k} for g, i, back, forward in taken(t, bounds, frequent) for k in keys(i, back, forward)])

    return texts.select(column, F.explode(run(column)).alias("g")).select(column, "g.*")


def candidates(texts: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """texts (text) and names (name), distinct and without nulls -> text, name: the pairs that the grams allow, every pair
    that reaches the threshold among them. The grams' order comes from counts over all names."""
    bounds = Bounds(threshold)
    counted = names.select(F.explode(F.concat(_grams(F.col("name"), 1), _grams(F.col("name"), 2))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    frequent = {r.gram: r.n for r in counted.orderBy(F.desc("n"), "gram").limit(FREQUENT).collect()}
    # names are dealt out anew: they are few bytes, of which far more is made here
    dealt = names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = _signatures(texts, "text", bounds, frequent, spread=True).withColumnRenamed("place", "at")
    met = asked.join(_signatures(dealt, "name", bounds, frequent, spread=False), ["gram", "key"])
    n, m = F.length("text"), F.length("name")
    common = F.ceil((n + m) * ((threshold - _EPSILON) / 200))
    near = (F.col("place") - F.col("at")).between(common - n, m - common)
    return met.filter((common <= F.least(n, m)) & near).select("text", "name").distinct()


def fuzzy_join(texts: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """texts (text) and names (name), each distinct -> text, name, score (the ratio, to six digits) of every pair with a
    score of threshold or more. Nulls match nothing; the empty string matches itself."""
    met = candidates(texts.filter("text IS NOT NULL"), names.filter("name IS NOT NULL"), threshold)

    def compare(batches):  # as a whole step, so that no pair is compared before it is distinct
        for batch in batches:
            pairs = list(zip(batch.column("text").to_pylist(), batch.column("name").to_pylist(), strict=True))
            scores = [round(similarity.lcs_ratio(a, b), 6) for a, b in pairs]
            good = [(a, b, x) for (a, b), x in zip(pairs, scores, strict=True) if x >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in good], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["text", "name", "score"])

    return met.mapInArrow(compare, "text string, name string, score double")
