"""Near copies by SimHash and exact set similarity: texts whose sets of word 5-shingles have Jaccard similarity 0.8 or
more.

Each set has a SimHash fingerprint; fingerprints within RADIUS bits are paired by tiles (tiles.py), and every pair is
checked on the whole sets. Sets of that similarity can lie many more bits apart, too many for tiles to skip anything,
so the pairs that SimHash cannot see are found in an exact way besides, by prefix filtering in an order of shingles
that is common to all sets. It only decides how many pairs are looked at: shingles that are frequent in a sample of
documents come last. The smaller set of a similar pair shares at least 8/9 of its shingles and the larger one 4/5, so
one of the first n // 9 + 1 shingles of the smaller stands among the first n // 5 + 1 of the larger: sets are indexed by
the short prefix, and probe with the long one (sets of one size with the short one). Texts of one template with more
odd shingles than similar ones may have are indexed by odd ones alone, and never meet. Where a shared shingle stands
far earlier in one set than in the other, too few can follow, and the pair is dropped as it meets.

Equal sets are one node. Each prefix shingle first links its nodes to the one that it stands first in, so that a large
group of near copies becomes one component with links in proportion to its members; then pairs of nodes of different components
are taken as above. The sample misses small groups of a large table, and then odd shingles do not come first; so the
shingles that no other of these nodes holds are counted in the whole sets before, and nodes or pairs of which these leave
too few shingles to share do not meet. Pairs that share too few shingles of their prefixes are passed over (possible); every other is
checked on the whole sets. Components come from star rounds (components.py). Tables between the steps are deleted once
the next ones are written.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import discard
from .common import Tokens, map_texts, materialize, mix64
from .components import connected_components
from .decontaminate import gram_hashes
from .tiles import RADIUS, majority, near_edges

#: Words of a shingle; the least similarity as a fraction; steps of the sets' sizes between two that are as far apart as
#: similar ones can be.
SHINGLE, ABOVE, BELOW, STEPS = 5, 4, 5, 4
#: Documents whose shingles are counted for the order, and shingles that are kept as frequent. Neither bears on results.
SAMPLE, FREQUENT = 10_000, 200_000


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word 5-shingles of each text, ascending, and the texts' offsets into them. A shorter text
    is one shingle; a text without words has one of its own."""
    t = Tokens(texts)
    words = np.diff(t.first)
    total, whole = gram_hashes(t.hash, t.first, SHINGLE)
    grams, text = [total[whole]], [t.text[whole]]
    for size in range(SHINGLE):
        at = np.flatnonzero(words == size)
        grams.append(mix64(gram_hashes(t.hash, t.first, size)[0][t.first[at]] + np.uint64(size)) if size and len(at) else np.zeros(len(at), np.uint64))
        text.append(at)
    hashes, owner = np.concatenate(grams).view(np.int64), np.concatenate(text)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def nodes_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits that stand for each whole set."""
    raw = (hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest() for a, b in zip(first, first[1:], strict=False))
    return np.frombuffer(b"".join(raw), np.int64)


def prefixes(hashes: np.ndarray, first: np.ndarray, frequent: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of each set, in order, and the sets' offsets into them. frequent (ascending) come last, by often."""
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    count = np.zeros(len(hashes), np.int64)
    if len(frequent):
        found = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        count = np.where(frequent[found] == hashes, often[found], 0)
    order = np.lexsort((hashes, count, owner))
    keep = sizes - (ABOVE * sizes + BELOW - 1) // BELOW + 1
    inside = np.arange(len(hashes)) - np.repeat(first[:-1], sizes) < np.repeat(keep, sizes)
    return hashes[order][inside], np.concatenate([[0], np.cumsum(keep)])


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.int64()))


def frequent_shingles(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most distinct sets of the sampled documents hold, ascending, and how many do."""
    every = max(1, -(-docs.count() // sample))

    def make():
        def one(batch):
            hashes, first = shingle_sets(batch.column("text").to_pylist())
            return {"node": np.repeat(nodes_of(hashes, first), np.diff(first)), "gram": hashes}

        return one

    drawn = map_texts(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0), make, "node bigint, gram bigint").distinct()
    top = drawn.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow()
    gram, n = top.column("gram").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(gram)
    return gram[order], n[order]


def signed(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, node, n (size of the set), fp (its SimHash), prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, sample))

    def make():
        def one(batch):
            hashes, first = shingle_sets(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "node": nodes_of(hashes, first), "n": np.diff(first), "fp": majority(hashes.view(np.uint64), first).view(np.int64), "prefix": _lists(*prefixes(hashes, first, *shared.value))}

        return one

    return map_texts(docs, make, f"doc_id {dict(docs.dtypes)['doc_id']}, node bigint, n int, fp bigint, prefix array<bigint>")


def whole_sets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> node, grams."""

    def make():
        def one(batch):
            hashes, first = shingle_sets(batch.column("text").to_pylist())
            return {"node": nodes_of(hashes, first), "grams": _lists(hashes, first)}

        return one

    return map_texts(docs, make, "node bigint, grams array<bigint>")


def index_length(n: Column) -> Column:
    """How many of a set's n shingles it is indexed by."""
    return F.floor(n / F.lit(2 * ABOVE + 1)).cast("int") + 1


def near_in_size(a: str, b: str) -> Column:
    return BELOW * F.least(a, b) >= ABOVE * F.greatest(a, b)


def enough_follows(na: str, nb: str, at_a: str, at_b: str) -> Column:
    """Whether sets of na and nb shingles that share one at these places of their orders can be similar: they share those
    before and at it, and no more than follow it in either."""
    reach = F.least(at_a, at_b) + F.least(F.col(na) - F.col(at_a), F.col(nb) - F.col(at_b))
    return (ABOVE + BELOW) * reach >= ABOVE * (F.col(na) + F.col(nb))


def enough_open(na: str, nb: str, open_a: str, open_b: str) -> Column:
    """Whether sets of na and nb shingles, of which so many are held by others too, can be similar."""
    return (ABOVE + BELOW) * F.least(open_a, open_b) >= ABOVE * (F.col(na) + F.col(nb))


def open_members(members: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """members (gram, place, n, component, node) -> with open (how many shingles of the node's whole set another of these
    nodes holds too), for shingles of two components and nodes that can be similar to another by that count."""
    apart = members.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    members = materialize(members.join(apart.select("gram"), "gram"), "near-apart")
    named = nodes.select("node", "doc_id").join(members.select("node").distinct(), "node").select("doc_id").distinct()
    held = whole_sets(docs.join(named, "doc_id", "left_semi")).select("node", F.explode("grams").alias("gram")).repartition("gram")
    odd = held.groupBy("gram").agg(F.min("node").alias("node"), F.max("node").alias("last")).filter("node = last")
    odd = materialize(odd.groupBy("node").agg(F.count("*").alias("odd")), "near-odd")
    counted = members.join(odd, "node", "left").withColumn("open", F.col("n") - F.coalesce("odd", F.lit(0))).drop("odd")
    counted = materialize(counted.filter(BELOW * F.col("open") >= ABOVE * F.col("n")), "near-open")
    discard(members, odd)
    return counted


def possible(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, na, nb), a row for each shingle that the short prefix of a, the smaller, and b's long one share (of one
    size: its short one) -> a, b where the sets can be similar.

    What two sets share beyond the prefix that ends first in the order lies in the rest of that set."""
    rest = F.col("nb") - F.floor(F.col("nb") / F.lit(BELOW)) - 1
    short = lambda n: F.col(n) - index_length(F.col(n))
    most = F.when(F.col("na") == F.col("nb"), short("na")).otherwise(F.greatest(short("na"), rest))
    counted = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return counted.filter((ABOVE + BELOW) * (F.col("c") + most) >= ABOVE * (F.col("na") + F.col("nb"))).select("a", "b")


def meeting(members: DataFrame) -> DataFrame:
    """members (gram, place, n, component, node, open) -> the pairs of nodes of different components that meet under a shingle
    of a's short prefix, as (a, b, na, nb); a is the smaller set. Nodes of a component that agree in shingle, place and
    size are paired as one, with the most that one of them can share."""
    kinds = members.groupBy("gram", "component", "n", "place").agg(F.max("open").alias("open"))
    kinds = kinds.withColumn("size", F.floor(F.log("n") * (STEPS / math.log(BELOW / ABOVE))))
    near = kinds.withColumn("size", F.explode(F.transform(F.sequence(F.lit(-STEPS - 1), F.lit(0)), lambda d: F.col("size") + d)))  # sizes of smaller sets
    kind = lambda df, k: df.select("gram", "size", F.col("component").alias(f"of_{k}"), F.col("n").alias(f"n{k}"), F.col("place").alias(f"at_{k}"), F.col("open").alias(f"open_{k}"))
    same = F.col("na") == F.col("nb")
    fits = (F.col("na") <= F.col("nb")) & near_in_size("na", "nb") & (F.col("of_a") != F.col("of_b")) & (~same | (F.col("of_a") < F.col("of_b")) & (F.col("at_b") < index_length(F.col("nb"))))
    apart = kind(kinds.filter(F.col("place") < index_length(F.col("n"))), "a").join(kind(near, "b"), ["gram", "size"]).filter(fits & enough_follows("na", "nb", "at_a", "at_b") & enough_open("na", "nb", "open_a", "open_b")).drop("open_a", "open_b")
    side = lambda k: members.select("gram", F.col("component").alias(f"of_{k}"), F.col("n").alias(f"n{k}"), F.col("place").alias(f"at_{k}"), F.col("node").alias(k), F.col("open").alias(f"open_{k}"))
    pairs = apart.join(side("a"), ["gram", "of_a", "na", "at_a"]).join(side("b"), ["gram", "of_b", "nb", "at_b"])
    return pairs.filter(enough_open("na", "nb", "open_a", "open_b")).select("a", "b", "na", "nb")


def simhash_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: nodes whose fingerprints are equal (each with the first of them) or linked by tiles."""
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-fingerprints")
    equal = nodes.join(first, "fp").filter("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    side = lambda k: first.select(F.col("fp").alias(f"fp_{k}"), F.col("first").alias(k))
    linked = near_edges(first.select("fp"), radius).toDF("fp_a", "fp_b").join(side("a"), "fp_a").join(side("b"), "fp_b")
    return equal.unionByName(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar."""
    pairs = materialize(pairs, "near-pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    named = nodes.select("node", "doc_id").join(wanted, "node").select("doc_id").distinct()
    sets = materialize(whole_sets(docs.join(named, "doc_id", "left_semi")).dropDuplicates(["node"]), "near-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")

    def check(batches):
        for batch in batches:
            (xo, x), (yo, y) = ((batch.column(k).offsets.to_numpy(), batch.column(k).values.to_numpy()) for k in ("x", "y"))
            good = []
            for r in range(batch.num_rows):
                nx, ny = int(xo[r + 1] - xo[r]), int(yo[r + 1] - yo[r])
                merged = np.sort(np.concatenate([x[xo[r] : xo[r + 1]], y[yo[r] : yo[r + 1]]]), kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                good.append(BELOW * common >= ABOVE * (nx + ny - common))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good, pa.bool_())), batch.column("b").filter(pa.array(good, pa.bool_()))], ["a", "b"])

    found = materialize(both.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"), "near-links")
    discard(pairs, sets)
    return found


def near_copies(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """documents (doc_id, text) -> doc_id, component (of nodes that are linked by similar sets).

    Whole texts; null, empty and blank texts are equal. Rows with a null doc_id take no part; repeated rows stay
    repeated. Other columns are ignored; an empty table gives an empty result."""
    docs = documents.select("doc_id", "text").filter("doc_id is not null")
    sets = materialize(signed(docs, sample), "near-prefixes")
    owners = materialize(sets.select("doc_id", "node"), "near-owners")
    whole = materialize(sets.groupBy("node").agg(F.min(F.struct("doc_id", "n", "fp", "prefix")).alias("m")).select("node", "m.*"), "near-nodes")
    discard(sets)
    held = whole.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count("*").alias("members")).filter("members > 1")
    shared = materialize(whole.select("node", "n", F.posexplode("prefix").alias("place", "gram")).join(held.select("gram"), "gram"), "near-shared")
    nodes = materialize(whole.drop("prefix"), "near-nodes")
    discard(whole)

    # every node of a shingle and the one that it stands first in: that has the fewest odd shingles, and so is nearest to the
    # others of a group; what links a large group here is not paired below
    low = shared.groupBy("gram").agg(F.min(F.struct("place", "node", "n")).alias("low"))
    star = shared.join(low, "gram").select(F.col("low.node").alias("a"), F.col("node").alias("b"), F.col("low.n").alias("na"), F.col("n").alias("nb"), F.col("low.place").alias("at_a"), F.col("place").alias("at_b"))
    star = star.filter((F.col("a") != F.col("b")) & near_in_size("na", "nb") & enough_follows("na", "nb", "at_a", "at_b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = similar(star.unionByName(simhash_pairs(nodes)).distinct(), nodes, docs)
    known = connected_components(links, "near-components")
    members = materialize(shared.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-members")
    discard(shared, known)
    members = open_members(members, nodes, docs)
    further = similar(possible(meeting(members)), nodes, docs)
    discard(members)
    found = connected_components(links.unionByName(further), "near-components")
    discard(links, further, nodes)
    return owners.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
