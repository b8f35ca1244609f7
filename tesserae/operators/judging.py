"""Replies of a judge: parsing, and the places where models are plugged in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def parse_reply(replies: DataFrame, raw: str) -> DataFrame:
    """Adds tier and reason of a JSON reply, with or without a code fence; both null if it is no JSON object with a
    known tier and a textual reason."""
    found = F.from_json(T.strip_code_fence(F.col(raw)), "tier string, reason string")
    good = found["tier"].isin(*T.TIERS) & found["reason"].isNotNull()
    return replies.select("*", F.when(good, found["tier"]).alias("tier"), F.when(good, found["reason"]).alias("reason"))


def text_model(run: Callable[[pd.Series], pd.Series]) -> Callable[..., Column]:
    """A column function from a batch function of texts to texts (a generator, a judge, a passage writer)."""

    @F.pandas_udf("string")
    def call(texts: pd.Series) -> pd.Series:
        return run(texts)

    return call


def pair_scorer(run: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[..., Column]:
    """A column function from a batch function of query and text to a score (a cross-encoder)."""

    @F.pandas_udf("double")
    def call(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return run(queries, texts).astype(float)

    return call


def extract_answer(texts: pd.Series) -> pd.Series:
    """The stand-in generator: the first block's first line, cited, or a refusal of an empty prompt."""
    first = texts.fillna("").str.split("\n").str[0].str.replace(r"^\[\d+\] ", "", regex=True)
    return first.where(first.str.strip() == "", first + " [1]").where(first.str.strip() != "", T.REFUSAL_MARKER)
