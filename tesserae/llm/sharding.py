"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: start = h1(shard) mod M and stride =
1 + h2(shard) mod (M - 1), which visits each slot once as M is prime. Shards take turns; at its turn a shard claims the
first slot of its order that is still free, until the table is full. A row's key is hashed to a slot and the slot's
shard is its place. Slots per shard differ by one at most, and adding or removing a shard moves few other keys.

The table has M rows whatever the data, M being a checked parameter, so it is broadcast; placement is one hash and
one lookup per row, with no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import md5_int

N_SHARDS = 64
TABLE_SIZE = 8191
#: Largest table that is broadcast.
MAX_TABLE_SIZE = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _md5_int(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(names: list[str], table_size: int) -> list[int]:
    """slot -> index of its shard's name; a setting-up step of table_size turns that no row takes part in."""
    if not _is_prime(table_size) or not len(names) <= table_size <= MAX_TABLE_SIZE:
        raise ValueError(f"table_size must be a prime from {len(names)} to {MAX_TABLE_SIZE}")
    if not names or len(set(names)) < len(names):
        raise ValueError("shard names must be distinct, and one at least")
    at = [_md5_int(f"offset:{x}") % table_size for x in names]
    step = [_md5_int(f"skip:{x}") % (table_size - 1) + 1 for x in names]
    slots, taken = [-1] * table_size, 0
    while True:
        for shard in range(len(names)):
            while slots[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % table_size
            slots[at[shard]] = shard
            taken += 1
            if taken == table_size:
                return slots


def lookup_table(spark: SparkSession, names: list[str], table_size: int) -> DataFrame:
    """The filled table as (slot int, shard int), made by a SQL literal that the optimizer folds."""
    filled = ",".join(map(str, fill_table(names, table_size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int"))


def slot_of(key: Column, table_size: int) -> Column:
    """A null key counts as the empty text."""
    return (md5_int(F.coalesce(key.cast("string"), F.lit(""))) % table_size).cast("int")


def assign_shards(df: DataFrame, key: Column | str = "doc_id", n_shards: int = N_SHARDS, table_size: int = TABLE_SIZE, names: list[str] | None = None, columns: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """df with the slot and the shard of each row's key added; existing columns of these names are replaced.

    Rows with equal keys share a shard; null keys count as the empty text; an empty df gives an empty result. Every row
    is kept once. With a key that holds a large part of the rows, key by something finer (or by an array of several
    columns as text), as its rows share a shard by definition."""
    slot, shard = columns
    key = F.col(key) if isinstance(key, str) else key
    names = names or [str(i) for i in range(n_shards)]
    placed = df.drop(shard).withColumn(slot, slot_of(key, table_size))
    found = lookup_table(df.sparkSession, names, table_size).toDF(slot, shard)
    return placed.join(F.broadcast(found), slot, "left").select(*[c for c in df.columns if c not in columns], slot, shard)


def write_shards(df: DataFrame, path: str, shard: str = "shard", files_per_shard: int = 4, mode: str = "errorifexists") -> None:
    """Writes one folder per shard with up to files_per_shard files; the row's hash deals a shard's rows to its files,
    so no task holds a whole shard."""
    salt = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(files_per_shard))
    df.withColumn("_file", salt).repartition(shard, "_file").drop("_file").write.mode(mode).partitionBy(shard).parquet(path)
