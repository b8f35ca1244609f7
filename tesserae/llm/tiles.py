"""Tiled exact comparison of 64-bit fingerprints.

Distinct fingerprints are put into tiles by their population counts in equal parts of their bits. Fingerprints within
`radius` differing bits have counts within it in all, so only tiles whose counts lie that close are paired; all other
pairs of tiles are skipped. A pair of tiles is compared exactly: exclusive-or and bit counts in numpy. Where more links
than members are found, the task passes on a spanning forest of them, so groups of near copies give edges in proportion
to their members and no link's effect on the components is lost. Tiles hold TILE fingerprints at most on average, by
hash, however many share their counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RADIUS = 2
LANES, TILE = 4, 1024


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint64 of each group of hashes (group g from first[g] to first[g + 1]): the bits that over half of them have; 0
    for an empty group."""
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        begin, hashes = first[:-1][some], hashes.astype("<u8", copy=False)
        ones = np.zeros((len(some), 64), np.int64)
        step = 1 << 18
        for at in range(0, len(hashes), step):  # 16 MB of bits at a time
            bits = np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            low, high = np.searchsorted(begin, at, "right") - 1, np.searchsorted(begin, at + len(bits))
            ones[low:high] += np.add.reduceat(bits, np.maximum(begin[low:high] - at, 0), axis=0, dtype=np.int32)
        over = (2 * ones > counts[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (member, root), of the graph on n nodes with edges i-j."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of positions in the concatenation of a and b (of a alone if same), or a forest of them."""
    a, b = a.view(np.uint64), b.view(np.uint64)  # of a signed number numpy counts the bits of its absolute value
    found = [np.zeros((2, 0), np.int64)]
    shift = 0 if same else len(a)
    held, most = 0, len(a) + (0 if same else len(b))
    for at in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        found.append(np.stack([i, j + shift]))
        held += len(i)
        if held > 4 * most:
            found = [np.stack(forest(most, *np.concatenate(found, axis=1)))]
            held = found[0].shape[1]
    pairs = np.concatenate(found, axis=1)
    return forest(most, *pairs) if pairs.shape[1] > most else (pairs[0], pairs[1])


def _steps(radius: int, lanes: int, base: int) -> list[int]:
    """Differences of a tile key (digits of this base) that lie within the radius, one of each pair of opposites, and 0."""
    found = {0: 0}  # a difference of the lanes so far -> how much of the radius it takes
    for k in range(lanes):
        found = {key + d * base**k: cost + abs(d) for key, cost in found.items() for d in range(-radius, radius + 1) if cost + abs(d) <= radius}
    return [k for k in found if k >= 0]


def near_edges(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, lanes: int = LANES) -> DataFrame:
    """nodes (fp distinct) -> a, b: edges between fingerprints that differ in `radius` bits at most, complete or, where
    they are many, with the same components. lanes: parts of a fingerprint whose bits are counted, 4, 8 or (for radii
    up to 2) 16; more of them make more keys with fewer members, and more pairs of keys.

    Pairs of tiles are made from the tiles' names alone; each side's fingerprints are fetched by name after that."""
    width, base = 64 // lanes, 64 if lanes < 9 else 8
    lane = lambda k: F.bit_count(F.shiftrightunsigned("fp", k * width).bitwiseAND((1 << width) - 1)) + radius
    key = sum((lane(k).cast("bigint") * base**k for k in range(lanes)), F.lit(0).cast("bigint"))
    keyed = nodes.select("fp", key.alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members"))
    placed = keyed.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("fp"), F.ceil(F.col("members") / tile)))
    tiles = materialize(placed.groupBy("key", "tile").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    left = tiles.select("key", F.col("tile").alias("tile_a"), F.explode(F.array(*[F.lit(s).cast("bigint") for s in _steps(radius, lanes, base)])).alias("step"))
    left = left.select((F.col("key") + F.col("step")).alias("key"), F.col("key").alias("key_a"), "tile_a", "step")
    named = left.join(tiles.select("key", F.col("tile").alias("tile_b")), "key").filter((F.col("step") != 0) | (F.col("tile_a") <= F.col("tile_b")))
    side = lambda k: tiles.select(F.col("key").alias(f"key_{k}"), F.col("tile").alias(f"tile_{k}"), F.col("fps").alias(k))
    pairs = named.withColumnRenamed("key", "key_b").join(side("a"), ["key_a", "tile_a"]).join(side("b"), ["key_b", "tile_b"])
    pairs = pairs.select("a", "b", ((F.col("step") == 0) & (F.col("tile_a") == F.col("tile_b"))).alias("same"))

    def compare(batches):
        for batch in batches:
            lists = [(batch.column(k).offsets.to_numpy(), batch.column(k).values.to_numpy()) for k in ("a", "b")]
            same = batch.column("same").to_pylist()
            out = [np.zeros((2, 0), np.int64)]
            for r in range(batch.num_rows):
                a, b = (v[o[r] : o[r + 1]] for o, v in lists)
                i, j = links(a, b, radius, same[r])
                if len(i):
                    ids = a if same[r] else np.concatenate([a, b])
                    out.append(np.stack([ids[i], ids[j]]))
            both = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return pairs.mapInArrow(compare, "a bigint, b bigint")
