"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word 3-shingles. Fingerprints within RADIUS
differing bits are found by tiles (tiles.py), and components by star rounds (components.py). Exact copies meet before
any pairing: the tiles hold distinct fingerprints only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_texts, materialize
from .components import connected_components
from .near_copies import near_copies
from .tiles import LANES, RADIUS, links, majority, near_edges  # noqa: F401

SHINGLE, SEED = 3, 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """uint64 of each text; 0 for texts without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes = [np.zeros(0, np.uint64)]
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode().translate(_LOWER).split() if text else []
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= SHINGLE:
            hashes.append(np.array([digest(joined, SEED)], np.uint64))
            counts[i] = 1
            continue
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (stops - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
        ends = (stops - 1).tolist()
        counts[i] = len(words) - SHINGLE + 1
        hashes.append(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)), np.uint64, counts[i]))
    return majority(np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)]))


def fingerprint(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, fp bigint (the fingerprint's bits)."""

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id"), "fp": pa.array(fingerprints(batch.column("text").to_pylist()).view(np.int64))}

    return map_texts(documents.select("doc_id", "text"), make, f"doc_id {dict(documents.dtypes)['doc_id']}, fp bigint")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, lanes: int = LANES) -> DataFrame:
    """documents (doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Whole texts; null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated rows stay
    repeated, in one component. Rows with a null doc_id take no part in linking; they get their fingerprint's
    component, null if no document with an id has that fingerprint. Ids may be of any type that has an order. Other
    columns are ignored; an empty table gives an empty result."""
    docs = materialize(fingerprint(documents), "simhash-fingerprints")
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    found = connected_components(near_edges(nodes.filter("first is not null"), radius, lanes=lanes), "simhash-components")
    named = materialize(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "simhash-groups")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return docs.join(named.join(least, "component").select("fp", "component_id"), "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """documents without near copies (near_copies.py: 5-word shingles, Jaccard similarity 0.8 or more): of each
    component the row with the smallest doc_id stays, with all columns (of several rows with that id, the first by the
    row's hash). Rows with a null doc_id stay."""
    first = near_copies(documents).groupBy("component").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    named = documents.join(first, "doc_id", "left_semi")
    order = W.partitionBy("doc_id").orderBy(F.xxhash64(*[c for c, kind in documents.dtypes if "map<" not in kind and "variant" not in kind]))
    named = named.withColumn("_copy", F.row_number().over(order)).filter("_copy = 1").select(*documents.columns)
    return named.unionByName(documents.filter("doc_id is null"))
