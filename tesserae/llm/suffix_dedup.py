"""Removal of byte strings that occur more than once, with suffix arrays over shards.

Equal texts are collapsed first: a text that occurs twice goes as a whole, and one representative of it stands for all
in what follows, with a multiplicity. Every WINDOW bytes of a text hold an anchor: the K-gram with the smallest hash
among the K-grams of that window. Equal windows have equal anchors at equal places, so all occurrences of a repeated
window meet under its anchor's hash, and an anchor that occurs once rules out every window it stands for. What could
repeat around an anchor is its context, the bytes of all windows that it is in. Contexts under one anchor that are
equal as a whole are one entry with a multiplicity, and repeat as a whole if it exceeds one. The other entries go, with
their counterparts, to shards by anchor. A shard trims each entry to what any other shares with it on either side,
concatenates them and builds their suffix array by induced sorting with permuted common prefixes (suffix.py); a window
is repeated if its class of equal prefixes holds two different places.

Groups of more than MAX_GROUP entries are taken apart first: all entries are compared with one of the group, and what
an entry shares with it on both sides of the key is repeated in both. Windows that reach beyond that on the left, and
the other ones that reach beyond it on the right, can only be shared with entries that leave the first one at the same
place with the same byte, so each entry goes on (once or twice, with its windows dealt out) to the groups of its longer
keys, until these are small. So no group is collected whole, and none is cut.

Texts are hashed once: the anchors are written as a table, and the contexts that need sorting are cut out of the texts
by their places. Anchors that occur once are dropped by a broadcast bitmap that is sized by the number of the others
(its false positives only cost time), and by a join where that bitmap would exceed MAX_BITS. Texts are known by two
hashes and their length, 64 and 60 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_texts, materialize, mix64
from .suffix import _powers, permuted_lcp, suffix_array

WINDOW, K = 200, 80
#: Most bits of the broadcast bitmap (128 MB), and bits for each anchor in it.
MAX_BITS, BITS_EACH = 1 << 30, 8
SHARD_BYTES, MAX_GROUP = 1 << 20, 2048
#: Occurrences from which an entry is looked up by broadcast instead of meeting its rows in a join.
HOT = 4096
#: Most large groups whose first entries are broadcast.
FEW_GROUPS = 10_000
_PLACE = np.uint64((1 << 23) - 1)
_VALUES = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers[: len(data)], out=sums[1:])
    return sums, inverses


def _window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = v
    rows = padded.reshape(-1, w)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, k: int = K, window: int = WINDOW, step: int = 1 << 19) -> dict[str, np.ndarray]:
    """Anchors of texts that lie one after another in data: anchor and context hashes, text, place in the text, and the
    context's bytes before the place and in all. Long buffers are taken in overlapping steps."""
    w = window - k + 1
    out = []
    for at in range(0, max(1, len(data) - window + 1), step):
        low, high = max(0, at - w), min(len(data), at + step + 2 * window)
        part = data[low:high]
        m = len(part) - k + 1
        if m < w:
            continue
        sums, inverses = _sums(part)
        grams = mix64((sums[k:] - sums[:-k]) * inverses[:m])
        minima = _window_minima((grams & ~_PLACE) | np.arange(m, dtype=np.uint64), w)
        starts = np.arange(len(minima)) + low
        text = np.searchsorted(bounds, starts, "right") - 1
        good = (starts >= at) & (starts < at + step) & (starts + window <= bounds[text + 1])
        place = np.unique((minima[good] & _PLACE).astype(np.int64))
        text = np.searchsorted(bounds, place + low, "right") - 1
        first = np.maximum(place + low - (w - 1), bounds[text])
        last = np.minimum(place + low + k + w - 1, bounds[text + 1])
        context = mix64((sums[last - low] - sums[first - low]) * inverses[first - low])
        left, size = place + low - first, last - first
        context = mix64(context ^ (left.astype(np.uint64) << np.uint64(32)) ^ size.astype(np.uint64))
        out.append((grams[place], context, text, place + low - bounds[text], left, size))
    names = ("anchor", "context", "text", "place", "left", "size")
    if not out:
        return dict(zip(names, (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4, strict=True))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    if len(out) > 1:  # an anchor of windows in two steps
        _, once = np.unique(columns[2] << np.int64(40) | columns[3], return_index=True)
        columns = [c[once] for c in columns]
    return dict(zip(names, columns, strict=True))


def place_hash(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix64(key.view(np.uint64) ^ mix64(place.astype(np.uint64) + np.uint64(1)))


def _lay(batch) -> tuple[np.ndarray, np.ndarray]:
    raw = [b"" if t is None else t.encode() for t in batch.column("text").to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def bitmap(df: DataFrame, hashes: str, bits: int) -> np.ndarray:
    """A bit set for each hash in df, as uint64 words; at most bits / 64 rows reach the driver."""
    words = df.select(F.col(hashes).bitwiseAND(bits - 1).alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, int(slot & 63))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max(1, bits // 64), np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _has(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(words) * 64 - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _match(gk: np.ndarray, data: np.ndarray, at: np.ndarray, room: np.ndarray, way: int, most: int) -> np.ndarray:
    """How many bytes from `at` on (way 1) or before it (way -1) each entry shares with some other of its group."""
    offset = np.arange(most)
    where = at[:, None] + offset if way > 0 else at[:, None] - 1 - offset
    inside = offset < room[:, None]
    rows = np.where(inside, data[np.clip(where, 0, len(data) - 1)], 0).astype(np.uint8)
    joined = np.ascontiguousarray(np.concatenate([gk.astype(">u8").view(np.uint8).reshape(-1, 8), rows], axis=1))
    order = np.lexsort(np.ascontiguousarray(np.pad(joined, ((0, 0), (0, -joined.shape[1] % 8)))).view(">u8").T[::-1])
    ranked = joined[order]
    differ = ranked[1:] != ranked[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), 8 + most) - 8
    best = np.full(len(gk), -1)
    best[order[1:]] = shared
    best[order[:-1]] = np.maximum(best[order[:-1]], shared)
    return np.minimum(best, room)


def repeated_in_shard(gk: np.ndarray, n: np.ndarray, key: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, contexts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, from, to) of the repeated stretches of the entries with n == 1. place: where the context begins in its
    text, which `key` stands for; low, high: the group's key within the context; n: the entry's multiplicity."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(c) for c in contexts], np.int64)
    base = np.cumsum(size) - size
    data = np.frombuffer(b"".join(contexts), np.uint8)
    if len(contexts) < 2:
        return none
    most = int(max((size - high).max(), low.max(), 1))
    right = _match(gk, data, base + high, size - high, 1, most)
    left = _match(gk, data, base + low, low, -1, most)
    start, stop = low - np.maximum(left, 0), high + np.maximum(right, 0)
    good = np.flatnonzero((right >= 0) & (left >= 0) & (stop - start >= window))
    if not len(good):
        return none
    sums, inverses = _sums(data)
    a, b = (base + start)[good], (base + stop)[good]
    content = mix64((sums[b] - sums[a]) * inverses[a]) ^ mix64((b - a).astype(np.uint64))
    ident = place_hash(key[good], (place + start)[good])
    _, first, which = np.unique(content, return_index=True, return_inverse=True)
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(len(first)))
    multiple = (np.minimum.reduceat(ident[order], cuts) != np.maximum.reduceat(ident[order], cuts)) | (np.maximum.reduceat((n[good] > 1)[order], cuts))
    ua, size_u = a[first], (b - a)[first]
    at = np.cumsum(size_u + 1) - size_u - 1
    total = int((size_u + 1).sum())
    t = np.zeros(total, np.uint16)
    entry = np.repeat(np.arange(len(first), dtype=np.int32), size_u)
    inside = np.arange(len(entry), dtype=np.int32) - np.repeat((np.cumsum(size_u) - size_u).astype(np.int32), size_u)
    t[at[entry] + inside] = data[ua[entry] + inside].astype(np.uint16) + 1
    sa = suffix_array(t)
    lcp = permuted_lcp(t, sa, window)
    whole = np.full(total, -1, np.int32)  # the unique string in which a window starts here
    starts = inside + window <= size_u[entry]
    whole[at[entry[starts]] + inside[starts]] = entry[starts]
    cls = np.cumsum(lcp[sa] < window, dtype=np.int32)
    ranked = np.flatnonzero(whole[sa] >= 0)
    places = sa[ranked]
    cls, of = cls[ranked], whole[places]
    who = place_hash(key[good][first][of], (place + start)[good][first][of] + places - at[of])
    cuts = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
    again = (np.minimum.reduceat(who, cuts) != np.maximum.reduceat(who, cuts)) | np.maximum.reduceat(multiple[of], cuts)
    hit = np.sort(places[np.repeat(again, np.diff(np.append(cuts, len(places))))])
    if not len(hit):
        return none
    of = whole[hit]
    fresh = np.append(True, (of[1:] != of[:-1]) | (np.diff(hit) > window))
    lows, highs = hit[fresh], hit[np.append(fresh[1:], True)] + window
    of = whole[lows]
    lows, highs = lows - at[of], highs - at[of]
    cuts, ends = np.searchsorted(of, which), np.searchsorted(of, which, "right")
    cuts[n[good] > 1] = ends[n[good] > 1]
    count = ends - cuts
    member = np.repeat(np.arange(len(good)), count)
    span = np.repeat(cuts, count) + np.arange(len(member)) - np.repeat(np.cumsum(count) - count, count)
    origin = (place + start)[good][member]
    return good[member], origin + lows[span], origin + highs[span]


_ENTRY = "gk bigint, n bigint, key bigint, key2 bigint, place bigint, low int, high int, context_bytes binary"


def shared_sides(context: bytes, low: int, high: int, other: bytes, other_low: int, other_high: int) -> tuple[int, int]:
    """How many bytes before `low` and from `high` on two contexts share around their keys."""
    out = []
    for a, b, order in ((context[:low], other[:other_low], "big"), (context[high:], other[other_high:], "little")):
        m = min(len(a), len(b))
        a, b = (a[len(a) - m :], b[len(b) - m :]) if order == "big" else (a[:m], b[:m])
        x = int.from_bytes(a, order) ^ int.from_bytes(b, order)
        out.append(((x & -x).bit_length() - 1) // 8 if x else m)
    return out[0], out[1]


def _peel(big: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Entries in large groups -> (stretches shared with the first entry of the group, entries with longer keys)."""
    entry = F.struct("key", "key2", "place", "low", "high", "n", "context_bytes")
    first = materialize(big.groupBy("gk").agg(F.min_by(entry, F.xxhash64("key", "key2", F.col("place") + F.col("low"))).alias("first")), "suffix-first")
    told = first.count() <= FEW_GROUPS

    def compare(batches):
        for batch in batches:
            rows = batch.select(["context_bytes", "low", "high", "first"]).to_pylist()
            sides = [shared_sides(r["context_bytes"], r["low"], r["high"], r["first"]["context_bytes"], r["first"]["low"], r["first"]["high"]) for r in rows]
            bare = batch.column("first")
            more = {"f_key": bare.field("key"), "f_key2": bare.field("key2"), "f_place": bare.field("place"), "f_low": bare.field("low"), "f_high": bare.field("high"), "f_n": bare.field("n")}
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            del columns["first"]
            more |= {"left": pa.array([a for a, _ in sides], pa.int32()), "right": pa.array([b for _, b in sides], pa.int32())}
            yield pa.RecordBatch.from_pydict(columns | more)

    names = [f.split()[0] for f in _ENTRY.split(", ")]
    joined = big.select(*names).join(F.broadcast(first) if told else first, "gk")
    seen = materialize(joined.mapInArrow(compare, _ENTRY + ", f_key bigint, f_key2 bigint, f_place bigint, f_low int, f_high int, f_n bigint, left int, right int"), "suffix-peeled")
    others = seen.filter("NOT (key = f_key AND key2 = f_key2 AND place + low = f_place + f_low)")
    wide = others.filter(F.col("high") - F.col("low") + F.col("left") + F.col("right") >= window)
    shared = wide.filter("n = 1").selectExpr("key", "key2", "place + low - left AS low", "place + high + right AS high")
    shared = shared.unionByName(wide.filter("f_n = 1").selectExpr("f_key AS key", "f_key2 AS key2", "f_place + f_low - left AS low", "f_place + f_high + right AS high").distinct())
    beyond = others.filter("left < low").selectExpr("xxhash64(gk, 0, substring(context_bytes, low - left, left + 1)) AS gk", "n", "key", "key2", "place", "low - left - 1 AS low", "high", "context_bytes")
    within = others.filter(f"high + right < octet_length(context_bytes) AND octet_length(context_bytes) - low + left >= {window}")
    within = within.selectExpr("xxhash64(gk, 1, substring(context_bytes, high + 1, right + 1)) AS gk", "n", "key", "key2", "place + low - left AS place", "left AS low", "high + right + 1 - low + left AS high", "substring(context_bytes, low - left + 1) AS context_bytes")
    return shared, beyond.unionByName(within)


def _take_apart(level: DataFrame, window: int, max_group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(tables of entries in groups of 2 to max_group, tables of shared stretches). Every level is written once, with
    the sizes of its groups."""
    small, spans = [], []
    while True:
        sizes = level.groupBy("gk").agg(F.count("*").alias("members")).filter("members > 1")
        level = materialize(level.join(sizes, "gk"), "suffix-level")
        small.append(level.filter(F.col("members") <= max_group).drop("members"))
        big = level.filter(F.col("members") > max_group)
        if big.isEmpty():
            return small, spans
        shared, level = _peel(big, window)
        spans.append(shared)


def _repeated_anchors(anchors_: DataFrame, max_bits: int) -> DataFrame:
    """The rows whose anchor occurs twice (some others may be left among them)."""
    counts = materialize(anchors_.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "suffix-repeated")
    bits = 1 << max(6, (BITS_EACH * counts.count()).bit_length())
    if bits > max_bits:
        return anchors_.join(counts, "anchor", "left_semi")
    seen = anchors_.sparkSession.sparkContext.broadcast(bitmap(counts, "anchor", bits))

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(_has(seen.value, batch.column("anchor").to_numpy().view(np.uint64))))

    return anchors_.mapInArrow(keep, anchors_.schema)


def repeated_spans(texts: DataFrame, window: int = WINDOW, k: int = K, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """texts (key, key2: hashes of the text, twin: whether it occurs twice, text; one row for each text) -> key, key2,
    low, high: stretches of bytes covered by repeated windows, of texts that are no twins; they may overlap."""

    def make():
        def one(batch):
            data, bounds = _lay(batch)
            a = anchors(data, bounds, k, window)
            of = pa.array(a["text"])
            return {"anchor": _signed(a["anchor"]), "context": _signed(a["context"]), **{c: batch.column(c).take(of) for c in ("key", "key2", "twin")}, "place": (a["place"] - a["left"]).astype(np.int32), "left": a["left"].astype(np.int32), "size": a["size"].astype(np.int32)}

        return one

    found = materialize(map_texts(texts.select("key", "key2", "twin", "text"), make, "anchor bigint, context bigint, key bigint, key2 bigint, twin boolean, place int, left int, size int"), "suffix-anchors")
    rows = _repeated_anchors(found, max_bits)
    first = F.min(F.struct("key", "key2", "place", "left", "size")).alias("rep")
    entries = materialize(rows.groupBy("anchor", "context").agg(F.sum(1 + F.col("twin").cast("int")).alias("n"), first).select("anchor", "context", "n", "rep.*"), "suffix-entries")
    groups = entries.groupBy("anchor").agg(F.count("*").alias("members"), F.count_if(F.col("n") == 1).alias("single")).filter("members > 1 AND single > 0").select("anchor", (F.col("members") > max_group).alias("big"))
    wanted = entries.join(groups, "anchor").groupBy("key", "key2").agg(F.collect_list(F.struct("anchor", "n", "big", "place", "left", "size")).alias("entries"))
    wanted = materialize(wanted, "suffix-wanted")
    total, n_texts = wanted.agg(F.sum(F.aggregate("entries", F.lit(0).cast("bigint"), lambda s, e: s + e["size"])), F.count("*")).first()

    def cut():
        def one(batch):
            lists = batch.column("entries")
            at = {c: lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "n", "big", "place", "left", "size")}
            bounds = lists.offsets.to_numpy()
            at = {c: v[bounds[0] : bounds[-1]] for c, v in at.items()}
            of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            stops = (at["place"] + at["size"]).tolist()
            low = at["left"]
            take = pa.array(of)
            return {
                "gk": pa.array(at["anchor"]), "n": pa.array(at["n"]), "big": pa.array(at["big"]), "key": batch.column("key").take(take), "key2": batch.column("key2").take(take), "place": pa.array(at["place"].astype(np.int64)), "low": low,
                "high": low + np.int32(k), "context_bytes": [raw[t][a:b] for t, a, b in zip(of.tolist(), at["place"].tolist(), stops, strict=True)],
            }

        return one

    named = texts.select("key", "key2", "text").join(broadcast_if_small(wanted.select("key", "key2"), n_texts), ["key", "key2"], "left_semi")
    contexts = map_texts(named.join(wanted, ["key", "key2"]), cut, _ENTRY + ", big boolean")
    contexts = materialize(contexts, "suffix-contexts")
    small, shared = _take_apart(contexts.filter("big").drop("big"), window, max_group)
    shards = max(1, -(-int(total or 0) // shard_bytes))
    parts = contexts.filter("NOT big").drop("big")
    for part in small:
        parts = parts.unionByName(part)
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("gk", F.lit(3)), F.lit(shards)))

    def sort_shard(shard: pa.Table) -> pa.Table:
        col = lambda c: shard.column(c).to_numpy()
        which, low, high = repeated_in_shard(col("gk").view(np.uint64), col("n"), col("key") ^ col("key2"), col("place"), col("low").astype(np.int64), col("high").astype(np.int64), shard.column("context_bytes").to_pylist(), window)
        which = pa.array(which)
        return pa.table([shard.column("key").take(which), shard.column("key2").take(which), pa.array(low), pa.array(high)], ["key", "key2", "low", "high"])

    sorted_ = parts.groupBy("shard").applyInArrow(sort_shard, "key bigint, key2 bigint, low bigint, high bigint")
    spans = lambda df: df.filter(F.col("size") >= window).select("key", "key2", F.col("place").cast("bigint").alias("low"), (F.col("place") + F.col("size")).cast("bigint").alias("high"))
    single = rows.filter("NOT twin")
    often = entries.filter(F.col("n") > hot).select("anchor", "context")
    often = broadcast_if_small(often, often.count())
    some = entries.filter((F.col("n") > 1) & (F.col("n") <= hot)).select("anchor", "context")
    few = single.join(often, ["anchor", "context"], "left_anti").join(some, ["anchor", "context"], "left_semi")
    for part in shared:
        sorted_ = sorted_.unionByName(part)
    return sorted_.unionByName(spans(single.join(often, ["anchor", "context"], "left_semi"))).unionByName(spans(few))


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the spans, the bytes removed, and the number of maximal runs removed."""
    kept, at, removed, runs, last = [], 0, 0, 0, -1
    for low, high in sorted(spans):
        if low > last:
            runs += 1
        low = max(low, at)
        if high > low:
            kept.append(text[at:low])
            removed += high - low
            at = high
        last = max(last, high)
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def _second_hash(text: Column) -> Column:
    """The text's CRC-32 and, in 28 more bits, its length."""
    return F.shiftleft(F.crc32(text.cast("binary")), 28).bitwiseOR(F.octet_length(text).bitwiseAND((1 << 28) - 1))


def remove_repeats(documents: DataFrame, window: int = WINDOW, k: int = K, **options) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), one
    row per row. A byte goes if a string of `window` bytes that covers it also starts elsewhere in any row.

    Null texts count as empty; texts shorter than the window keep all bytes; of equal long texts, repeated rows
    included, nothing stays. Other columns are ignored; an empty table gives an empty result. Ids may be of any type
    that has an order, and null."""
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"), _second_hash(text).alias("key2"))
    twins = keyed.filter(F.octet_length("text") >= window).groupBy("key", "key2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")
    twins = materialize(twins.select("key", "key2", "first", F.lit(True).alias("twin")), "suffix-twins")
    marked = keyed.join(broadcast_if_small(twins, twins.count()), ["key", "key2"], "left").withColumn("twin", F.col("twin").isNotNull())
    one_each = marked.filter((F.octet_length("text") >= window) & (~F.col("twin") | F.col("doc_id").eqNullSafe(F.col("first"))))

    spans = repeated_spans(one_each, window, k, **options).groupBy("key", "key2").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    spans = materialize(spans, "suffix-spans")
    known = broadcast_if_small(spans.select("key", "key2", F.lit(True).alias("touched")), spans.count())
    rest = marked.filter("NOT twin").join(known, ["key", "key2"], "left")
    n_bytes = F.octet_length("text").cast("bigint")
    none = F.lit(0).cast("bigint")
    whole = rest.filter("touched IS NULL").select("doc_id", n_bytes.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    gone = marked.filter("twin").select("doc_id", n_bytes.alias("n_bytes"), n_bytes.alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(b"").alias("kept"))

    def make():
        def one(batch):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            got = [remove_spans(t, [(s["low"], s["high"]) for s in spans]) for t, spans in zip(texts, batch.column("spans").to_pylist(), strict=True)]
            return {
                "doc_id": batch.column("doc_id"), "n_bytes": [len(t) for t in texts], "n_removed": [g[1] for g in got], "n_spans": [g[2] for g in got],
                "kept_sha256": [hashlib.sha256(g[0]).hexdigest() for g in got], "kept": [g[0] for g in got],
            }

        return one

    cut = map_texts(rest.filter("touched").join(spans, ["key", "key2"]).select("doc_id", "text", "spans"), make, f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return cut.unionByName(whole).unionByName(gone)
