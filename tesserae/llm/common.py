"""What the operators of this subpackage share: reading tables, folds, byte-level tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import clean_up, materialize, shared_folder  # noqa: F401

#: Words are runs of anything but these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows of a few numbers each that are broadcast to be joined.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, n: int) -> DataFrame:
    """df, of which n rows of a few numbers are known, with the hint to broadcast it if they are few; beyond, Spark
    joins it by sorting and splits hot keys."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def md5_int(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text as a non-negative bigint; SQL engines compute the same."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_IS_ALNUM = np.zeros(256, dtype=bool)
_IS_ALNUM[48:58] = _IS_ALNUM[65:91] = _IS_ALNUM[97:123] = _IS_ALNUM[128:] = True
_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens:
    """Words of a batch of texts, found and hashed with whole-array operations.

    data: the lower-cased bytes of all texts; bounds: n_texts + 1 offsets into them; start, end: byte ranges of the
    words; text: each word's text; hash: 64 bits of each word's lower-cased bytes; first: n_texts + 1 offsets into the
    words. Only A-Z are lower-cased. With alnum=True words are runs of ASCII letters, digits and bytes above 127."""

    def __init__(self, texts, alnum: bool = False):
        raw = [b"" if t is None else t.encode() if isinstance(t, str) else t for t in texts]
        self.bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]) if raw else np.zeros(1, np.int64)
        self.data = _LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        inside = (_IS_ALNUM if alnum else _IS_WORD)[self.data]
        n = len(inside)
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        edges = self.bounds[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.text = np.repeat(np.arange(len(raw)), np.diff(self.first))
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        powers = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
        total = int(size.sum())
        before = np.cumsum(size) - size
        place = np.arange(total) - np.repeat(before, size)
        values = _BYTE_VALUE[self.data[np.repeat(self.start, size) + place]] * powers[place]
        return mix64(np.add.reduceat(values, before) + size.astype(np.uint64))


def hash_words(words: list[str]) -> np.ndarray:
    """The hash that Tokens gives each of these words."""
    return np.concatenate([Tokens([w]).hash[:1] for w in words]) if words else np.zeros(0, np.uint64)


def batches_by_bytes(texts: list, limit: int = 2 << 20):
    """Ranges (from, to) of texts with about limit characters each; a longer text stands alone, whole."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t) if t is not None else 0
        if held and held + size > limit:
            yield at, i
            at, held = i, 0
        held += size
    if at < len(texts) or not texts:
        yield at, len(texts)


def map_texts(df: DataFrame, make, schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over df; make(batch) gets a RecordBatch with about 2 MB of texts (a longer text alone, whole) and
    returns a dict of columns or an iterator of such dicts. make is called once per task with no argument to set up,
    and returns the function that is then applied."""

    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        one = make()
        for batch in batches:
            for a, b in batches_by_bytes(batch.column(text).to_pylist() if batch.num_rows else []):
                if b > a:
                    made = one(batch.slice(a, b - a))
                    for columns in [made] if isinstance(made, dict) else made:
                        yield pa.RecordBatch.from_arrays([_column(columns[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


def _column(values, kind) -> pa.Array:
    return values.cast(kind) if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, kind)
