"""How filters interact: what each of five quality rules removes at every place of every order, per part of a corpus.

Every document gets a mask of the rules that it fails; masks are counted per part, and what any of the 120 orders does at
any step follows from these counts (32 masks a part at most). Four rules look at one text. The fifth, whether a smaller
doc_id has the same text, is settled by radix tries:

* Splitting points are prefixes of texts, as long as they must be to tell a range from the one before: where one prefix
  holds more than a range's share, only that prefix is read again, eight times as long, until it splits or its texts end.
* A task keeps the smallest id that it has seen of each text (by a 128-bit digest), so of copies it sends on little more
  than one; of a row that a smaller copy in the task beats, only id and mask go on.
* The rest meet by range. A range's texts are inserted whole into a compressed trie, whose terminals hold the smallest
  id; a walk over the rows then marks those whose terminal has a smaller one. A task holds one trie at a time; a range
  is ordered by the bytes after its splitting point, and a trie of RANGE_BYTES ends where they change.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from hashlib import blake2b
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import batches_by_bytes

#: Rules by letter; a mask has the bit of each that a text fails.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5  # words; distinct words and capitals in percent
BANNED = b"#$%&*|"

COPY = 16

#: Bytes of different texts in a range; sampled texts that splitting points are chosen from; the length of prefixes at
#: first, and how much longer they get.
RANGE_BYTES, SAMPLE_TEXTS, PREFIX, LONGER = 1 << 20, 100_000, 64, 8
#: Bytes after the splitting point that a range is ordered by: where they change, a trie that is large enough ends.
HEAD = 64
#: Texts that a task remembers (forgetting them only sends a few more on), and keys that settled rows are spread over.
REMEMBERED, SPREAD = 200_000, 4096

_CAPITALS = bytes(range(65, 91))
_OTHERS = bytes(b for b in range(256) if b & 0xC0 != 0x80)


def mask_of(raw: bytes) -> int:
    """The bits of A to D for a text in UTF-8."""
    words = raw.split()  # at the six ASCII blanks, as bytes are split
    n, different = len(words), len(set(words))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    points = len(raw) - len(raw.translate(None, _OTHERS))
    banned = len(raw) - len(raw.translate(None, BANNED))
    return (n < LEAST_WORDS) | (100 * different < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | (banned > 0) << 3


class Trie:
    """A compressed trie over whole byte strings. A node is [edges by first byte: (label, node), smallest id]; an id of
    None is no id."""

    def __init__(self):
        self.root = [{}, None]

    def insert(self, text: bytes, doc_id) -> list:
        """Enters text with an id (or None) and returns its terminal, which later insertions keep up to date."""
        node, at = self.root, 0
        while at < len(text):
            edges = node[0]
            label, below = edges.get(text[at], (None, None))
            if label is None:
                below = [{}, None]
                edges[text[at]] = (text[at:], below)
                node, at = below, len(text)
            elif text.startswith(label, at):
                node, at = below, at + len(label)
            else:
                same = _common(label, text, at)
                middle = [{label[same]: (label[same:], below)}, None]
                edges[text[at]] = (label[:same], middle)
                node, at = middle, at + same
        if doc_id is not None and (node[1] is None or doc_id < node[1]):
            node[1] = doc_id
        return node


def _common(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of label text goes on with, where they are not all."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if text.startswith(label[:middle], at) else (low, middle - 1)
    return low


def splitting_points(texts: DataFrame, range_bytes: int = RANGE_BYTES, sample: int = SAMPLE_TEXTS, prefix: int = PREFIX) -> list[bytes]:
    """Prefixes that cut the different texts of `texts` (text) into ranges of about range_bytes each, in order.

    They are chosen from about `sample` different texts, taken by the texts' own hashes so that copies count once. That
    bounds what the driver reads, and only evens out the ranges: every text falls in one of them."""
    h, raw = F.xxhash64("text"), F.col("text").cast("binary")
    points: list[bytes] = []
    share, length, open_ = max(1, texts.count() // sample), prefix, None
    while open_ is None or open_:
        rows = texts.filter(F.pmod(h, F.lit(share)) == 0)
        if open_:
            rows = rows.filter(F.hex(F.substring(raw, 1, length // LONGER)).isin([x.hex().upper() for x in open_]))
        found = rows.groupBy(h.alias("h")).agg(F.first(F.substring(raw, 1, length)).alias("head"), F.max(F.octet_length("text")).alias("size")).collect()
        heads = sorted((bytes(r.head), r.size) for r in found)
        full, held = range_bytes / share, 0  # bytes of the sample that make a range
        weight: dict[bytes, list[int]] = {}
        for k, (head, size) in enumerate(heads):
            if held >= full and head != heads[k - 1][0]:
                points.append(_shortest(heads[k - 1][0], head))
                held = 0
            held += size
            w = weight.setdefault(head, [0, 0])
            w[0] += size
            w[1] += 1
        # prefixes under which more than two ranges' texts lie, longer ones that differ
        open_ = [x for x, (size, different) in weight.items() if size > 2 * full and different > 1 and len(x) == length]
        points += open_
        length *= LONGER
        share *= -(-sum(weight[x][1] for x in open_) * length // (sample * prefix)) or 1  # as many bytes again at most
    return sorted(set(points))


def _shortest(before: bytes, text: bytes) -> bytes:
    """The shortest prefix of text that is larger than before, which is smaller than text."""
    same = next((i for i, (a, b) in enumerate(zip(before, text, strict=False)) if a != b), min(len(before), len(text)))
    return text[: same + 1]


def _settle_within_tasks(points: list[bytes], rules, schema: pa.Schema):
    """Batches of (doc_id, part, text) -> (range, head, doc_id, part, mask, n, text): equal rows counted as n, with the
    bits of the first rules. Rows that a smaller id in this task beats have the last bit too and no text, nor have rows
    without an id; their range is a negative number that spreads them."""

    def run(batches):
        least: dict[bytes, object] = {}  # a text's digest -> the smallest id of it so far
        spread = 0
        for batch in batches:
            ids, parts, texts = (batch.column(c).to_pylist() for c in ("doc_id", "part", "text"))
            for a, b in batches_by_bytes(texts):
                groups: dict[bytes, dict] = {}
                for doc_id, part, text in zip(ids[a:b], parts[a:b], texts[a:b], strict=True):
                    same = groups.setdefault((text or "").encode(), {})
                    same[doc_id, part] = same.get((doc_id, part), 0) + 1
                out = []
                for raw, rows in groups.items():
                    mask, key = rules(raw), blake2b(raw, digest_size=16).digest()
                    smallest = min((i for i in (*(i for i, _ in rows), least.get(key)) if i is not None), default=None)
                    if smallest is not None:
                        if key not in least and len(least) >= REMEMBERED:
                            least.clear()
                        least[key] = smallest
                    place = bisect_right(points, raw)
                    skip = len(points[place - 1]) if place else 0
                    for (doc_id, part), n in rows.items():
                        if doc_id is not None and doc_id == smallest:
                            out.append((place, raw[skip : skip + HEAD], doc_id, part, mask, n, raw))
                        else:
                            spread += 1
                            out.append((-1 - spread % SPREAD, None, doc_id, part, mask | COPY * (doc_id is not None), n, None))
                if out:
                    yield _batch(out, schema)

    return run


def _compare_in_tries(schema: pa.Schema, range_bytes: int):
    """Batches in order of range and head, out of _settle_within_tasks -> (doc_id, part, mask, n) with all bits."""

    def run(batches):
        trie, rows, held, at = Trie(), [], 0, None

        def flagged():
            for node, doc_id, part, mask, n in rows:
                yield doc_id, part, mask | COPY * (node is not None and node[1] < doc_id), n

        for batch in batches:
            done = []
            for place, head, doc_id, part, mask, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (place, head) != at:
                    if held >= range_bytes or not at or at[0] != place:
                        done += flagged()
                        trie, rows, held = Trie(), [], 0
                    at = place, head
                if raw is None:
                    done.append((doc_id, part, mask, n))
                else:
                    rows.append((trie.insert(raw, doc_id), doc_id, part, mask, n))
                    held += len(raw)
            if done:
                yield _batch(done, schema)
        if rows:
            yield _batch(flagged(), schema)

    return run


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def document_masks(documents: DataFrame, rules: Callable[[bytes], int] = mask_of, range_bytes: int = RANGE_BYTES, sample: int = SAMPLE_TEXTS) -> DataFrame:
    """documents (doc_id, source, text) -> doc_id, part, mask, n: equal rows may be counted together as n.

    rules(text in UTF-8) gives the bits 1 to 8; the bit COPY stands for a smaller doc_id with the same text anywhere. A
    null text counts as empty, and so equals empty ones; a null source is the part ''. A null doc_id is smaller than
    none and larger than none, and rows of one doc_id are no copies of each other."""
    kind = dict(documents.dtypes)["doc_id"]
    texts = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    points = splitting_points(texts.select("text"), range_bytes, sample)
    settled = f"range int, head binary, doc_id {kind}, part string, mask int, n bigint, text binary"
    masked = f"doc_id {kind}, part string, mask int, n bigint"
    arrow = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    sent = texts.mapInArrow(_settle_within_tasks(points, rules, arrow(settled)), settled)
    return sent.repartition("range").sortWithinPartitions("range", "head").mapInArrow(_compare_in_tries(arrow(masked), range_bytes), masked)


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """masks (doc_id, part, mask, n), labels (doc_id, quality, toxic) -> part, mask, n, good, toxic. A document is good
    (or toxic) if any row of its labels says so."""
    told = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    of = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return masks.join(told, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """counts (part, mask, n, good, toxic: a row for each mask) -> part, filter_order, step and what the step's filter does."""
    orders = ",".join("".join(o) for o in permutations(letters))
    bit = F.create_map(*[F.lit(x) for i, letter in enumerate(letters) for x in (letter, 1 << i)])
    bits = lambda s: F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda m, c: m.bitwiseOR(bit[c]))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    steps = steps.withColumn("bit", bits(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("earlier", bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))
    fails = lambda m: m["mask"].bitwiseAND(F.col("bit")) != 0
    before = lambda m: m["mask"].bitwiseAND(F.col("earlier")) != 0
    total = lambda which, of="n": F.aggregate(F.filter("masks", which), F.lit(0).cast("bigint"), lambda t, m: t + m[of])
    done = steps.select(
        "part", "filter_order", "step", "bit", total(lambda m: ~fails(m) & ~before(m)).alias("kept"), total(lambda m: fails(m) & ~before(m)).alias("removed"),
        total(lambda m: fails(m) & before(m)).alias("redundant"), total(lambda m: m["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda m: fails(m) & ~before(m), "good").alias("good_lost"), total(lambda m: fails(m) & ~before(m), "toxic").alias("toxic_lost"),
    )
    return done.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")


def audit(documents: DataFrame, labels: DataFrame, rules: Callable[[bytes], int] = mask_of, letters: str = LETTERS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """documents (doc_id, source, text), labels (doc_id, quality, toxic) -> for each part, order of the filters and step:
    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, zeros included.

    letters names the filters: those of `rules` by bit, then the one against copies. What counts as equal, null and
    repeated is stated at document_masks and mask_counts. Texts are taken whole. An empty table gives an empty result,
    and other columns are ignored."""
    return interactions(mask_counts(document_masks(documents, rules, range_bytes), labels), letters)
