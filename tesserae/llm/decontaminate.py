"""Benchmark decontamination: rare seeds, a count of shared words, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. Similarity is the score of the best local alignment of words over the
item's own (replaced, added and dropped words only lower it), and pairs from MIN_SIMILARITY on are reported. Items of
WHOLE words or fewer must stand in a document as they are: half of a few words is no passage.

A score asks for a number k of an item's words, in order, in a window of a bounded length. So of any n - k + s words of
the item s at least are among them: the rarest are its seeds, n-grams of N words (one word each: an edit after every
second word leaves no longer n-gram whole). How many documents hold a word is counted over all of them first; it only
decides which words are seeds. Where s seeds stand within a window, in the order of the item, and then k of all the
item's words do in their order (a longest common subsequence), the item is aligned. No pair that is similar enough is
passed over.

The benchmark is the query set: it is taken in blocks of bounded bytes, each block broadcast and run against all
documents, so documents are never shuffled and no pairs within a group arise.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, batches_by_bytes, map_texts, mix64

N, MIN_SIMILARITY = 1, 0.5
#: Items of so many words or fewer must occur whole; one more seed is asked for every SEEDS_APART words of an item.
WHOLE, SEEDS_APART = 4, 6
MATCH, MISMATCH, GAP = 2, -1, 1
#: Bytes of benchmark text in a block; cells of alignment computed at once.
BLOCK_BYTES, CELLS = 4 << 20, 1 << 20


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that starts at each word, and whether it lies in one text."""
    if not len(words):
        return words, np.zeros(0, bool)
    total = mix64(words)
    for k in range(1, n):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + np.append(words[k:], np.zeros(min(k, len(words)), np.uint64)))
    sizes = np.diff(first)
    left = np.repeat(first[1:], sizes) - np.arange(len(words))
    return total, left >= n


@dataclass
class Items:
    """A block of benchmark items: ids, word hashes, and what an alignment of each asks for: its least score, how many
    words (common) in a window of how many (span), how many seeds; the seeds as CSR lists of items and places in them."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    least: np.ndarray
    common: np.ndarray
    span: np.ndarray
    seeds: np.ndarray
    vocabulary: np.ndarray
    seed: np.ndarray
    seed_first: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray
    bits: list

    @classmethod
    def of(cls, rows: list[tuple], min_similarity: float = MIN_SIMILARITY, counted=None) -> Items:
        """counted(vocabulary) gives the number of documents that hold each word; without it words count as equally rare."""
        t = Tokens([text for _, text in rows], alnum=True)
        n = np.diff(t.first)
        least = np.maximum(np.ceil(MATCH * n * min_similarity - 1e-9).astype(np.int64), np.minimum(MATCH * n, MATCH * WHOLE))
        common = -(-least // MATCH)
        # what is no match costs one at least: span - matches <= 2 matches - least
        span = (MATCH + 1) * n - least
        seeds = np.minimum(common, np.maximum(1, n // SEEDS_APART))
        vocabulary = np.unique(t.hash)
        documents = np.zeros(len(vocabulary), np.int64) if counted is None else counted(vocabulary)
        rarity = documents[np.searchsorted(vocabulary, t.hash)]
        order = np.lexsort((t.hash, rarity, t.text))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - t.first[t.text[order]]
        taken = np.flatnonzero(place < (n - common + seeds)[t.text])
        taken = taken[np.lexsort((-taken, t.text[taken], t.hash[taken]))]  # of one word and item, the last place first
        seed, seed_first = np.unique(t.hash[taken], return_index=True)
        bits: list[dict[int, int]] = [{} for _ in rows]  # the places of each word of an item
        for h, i, at in zip(t.hash.tolist(), t.text.tolist(), (np.arange(len(t.hash)) - t.first[t.text]).tolist(), strict=True):
            bits[i][h] = bits[i].get(h, 0) | 1 << at
        return cls([i for i, _ in rows], t.hash, t.first, least, common, span, seeds, vocabulary, seed, np.append(seed_first, len(taken)), t.text[taken], taken - t.first[t.text[taken]], bits)

    def shared(self, i: int, words: list[int]) -> int:
        """Words of the i-th item that stand in words in their order: a row of the table is one integer."""
        places, full = self.bits[i], (1 << int(self.first[i + 1] - self.first[i])) - 1
        row = full
        for w in words:
            m = places.get(w)
            if m is not None:
                m &= row
                row = ((row + m) | (row - m)) & full
        return full.bit_count() - row.bit_count()


def in_order(places: list[int], most: int) -> bool:
    """Whether `most` of the places, at least, stand in ascending order."""
    tails: list[int] = []
    for x in places:
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
            if len(tails) >= most:
                return True
        else:
            tails[k] = x
    return False


def where_in(sorted_values: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes that are among the values, and which of them each is."""
    if not len(sorted_values) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sieve = np.zeros(1 << 16, bool)  # on the low bits first
    sieve[sorted_values & np.uint64(0xFFFF)] = True
    at = np.flatnonzero(sieve[hashes & np.uint64(0xFFFF)])
    found = np.minimum(np.searchsorted(sorted_values, hashes[at]), len(sorted_values) - 1)
    same = sorted_values[found] == hashes[at]
    return at[same], found[same]


def smith_waterman(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its window, and where in the window it ends (exclusive)."""
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda i: (len(windows[i]), len(items[i])))
    at = 0
    while at < len(order):
        width, to = len(windows[order[at]]), at + 1
        while to < len(order) and len(windows[order[to]]) * (to + 1 - at) <= CELLS:
            width, to = len(windows[order[to]]), to + 1
        part = order[at:to]
        at = to
        height = max(len(items[i]) for i in part)
        w = np.zeros((len(part), width), np.uint64)
        q = np.ones((len(part), height), np.uint64)
        for k, i in enumerate(part):
            w[k, : len(windows[i])] = windows[i]
            q[k, : len(items[i])] = items[i]
        ramp = np.arange(width, dtype=np.int32) * GAP
        row = np.zeros((len(part), width), np.int32)
        top, where = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
        for j in range(height):
            diagonal = np.concatenate([np.zeros((len(part), 1), np.int32), row[:, :-1]], axis=1) + np.where(w == q[:, j, None], np.int32(MATCH), np.int32(MISMATCH))
            new = np.maximum(np.maximum(diagonal, row - GAP), 0)
            row = np.maximum.accumulate(new + ramp, axis=1) - ramp
            here = row.argmax(axis=1)
            value = row[np.arange(len(part)), here]
            better = value > top
            top[better], where[better] = value[better], here[better] + 1
        best[part], end[part] = top, where
    return best, end


def regions(t: Tokens, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, seeds hit, first word, last word exclusive) of the parts of texts to be aligned with an item."""
    at, which = where_in(items.seed, t.hash)
    if not len(at):
        return []
    spread = np.diff(items.seed_first)[which]
    place = np.repeat(at, spread)
    entry = np.repeat(items.seed_first[which], spread) + np.arange(len(place)) - np.repeat(np.cumsum(spread) - spread, spread)
    item, text = items.seed_item[entry], t.text[place]
    order = np.argsort((text * len(items.ids) + item), kind="stable")  # places ascend within it, those in the item descend
    place, item, text, within = place[order], item[order], text[order], items.seed_at[entry[order]]
    # the last of as many seeds as are asked for, within a window of the item
    last = np.arange(len(place)) + items.seeds[item] - 1
    ends = np.minimum(last, len(place) - 1)
    good = np.flatnonzero((last < len(place)) & (item[ends] == item) & (text[ends] == text) & (place[ends] - place < items.span[item]))
    if not len(good):
        return []
    # an alignment begins less than a span before its first seed; seeds are looked at together by half a span
    half = np.maximum(1, items.span[item[good]] // 2)
    cell = place[good] // half
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(cell) != 0) | (np.diff(item[good]) != 0) | (np.diff(text[good]) != 0)])) if len(good) else good
    closes = np.append(opens[1:], len(good)) - 1
    group = text * len(items.ids) + item
    stop = np.searchsorted(group, group[good[opens]], "right")
    out = []
    for a, b, end in zip(good[opens].tolist(), good[closes].tolist(), stop.tolist(), strict=True):
        i, of = int(item[a]), int(text[a])
        span = int(items.span[i])
        end = a + int(np.searchsorted(place[a:end], place[b] + span))
        if not in_order(within[a:end].tolist(), int(items.seeds[i])):
            continue
        low, high = max(int(t.first[of]), int(place[a]) - span + 1), min(int(t.first[of + 1]), int(place[b]) + span)
        if items.shared(i, t.hash[low:high].tolist()) >= items.common[i]:
            out.append((of, i, end - a, low, high))
    return out


def find(t: Tokens, seeds: Items) -> list[tuple]:
    """(text, item, seeds hit, score, similarity, first word, last word exclusive) of each pair that is similar enough."""
    tasks = regions(t, seeds)
    if not tasks:
        return []
    queries = [seeds.words[seeds.first[i] : seeds.first[i + 1]] for _, i, *_ in tasks]
    windows = [t.hash[low:high] for *_, low, high in tasks]
    score, end = smith_waterman(queries, windows)
    similarity = score / (MATCH * np.array([len(q) for q in queries]))
    good = np.flatnonzero(score >= seeds.least[[i for _, i, *_ in tasks]])
    if not len(good):
        return []
    _, back = smith_waterman([queries[k][::-1] for k in good], [windows[k][: end[k]][::-1] for k in good])
    found: dict[tuple, tuple] = {}
    for k, length in zip(good, back, strict=True):
        text_, item_, n, low, _ = tasks[k]
        stop = low + int(end[k]) - int(t.first[text_])
        row = (int(score[k]), float(similarity[k]), stop - int(length), stop)
        old = found.get((text_, item_))
        found[text_, item_] = (max(n, old[0] if old else 0), *(row if not old or row[0] > old[1] else old[1:]))
    return [(*key, *row) for key, row in sorted(found.items())]


def document_counts(documents: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many documents hold each word of a block's vocabulary; a task sends a row a word of the block at most."""
    import pyarrow as pa

    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in batches_by_bytes(texts):
                t = Tokens(texts[a:b], alnum=True)
                at, which = where_in(known, t.hash)
                total += np.bincount(np.unique(t.text[at] * len(known) + which) % len(known), minlength=len(known)) if len(at) else 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in documents.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


def benchmark_blocks(documents: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY, block_bytes: int | None = None):
    """The items in blocks of about block_bytes of text, each small enough to broadcast, with seeds that are rare in
    documents. Null ids and texts are passed over."""
    rows = benchmark.select("item_id", "text").dropna()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(size) // (block_bytes or BLOCK_BYTES))
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        yield Items.of(sorted((r.item_id, r.text) for r in part.collect()), min_similarity, lambda words: document_counts(documents, words))


def find_leaks(documents: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """documents (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, n_seeds, score, similarity, start_word,
    end_word: a row for each document and item whose best alignment is similar enough.

    Whole texts. Null and empty texts match nothing, nor do items without words. Repeated rows and repeated
    items are each reported; a null doc_id stays null; other columns are ignored; empty tables give an empty result."""
    ids, kinds = dict(documents.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {ids}, item_id {kinds}, n_seeds int, score int, similarity double, start_word int, end_word int"
    out = None
    for items in benchmark_blocks(documents, benchmark, min_similarity):
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def make(shared=shared):
            def one(batch):
                found = find(Tokens(batch.column("text").to_pylist(), alnum=True), shared.value)
                doc = batch.column("doc_id").to_pylist()
                columns = list(zip(*found, strict=True)) if found else [[]] * 7
                return {"doc_id": [doc[i] for i in columns[0]], "item_id": [shared.value.ids[i] for i in columns[1]], "n_seeds": columns[2], "score": columns[3], "similarity": columns[4], "start_word": columns[5], "end_word": columns[6]}

            return one

        part = map_texts(documents.select("doc_id", "text"), make, schema)
        out = part if out is None else out.unionByName(part)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out


def remove_leaks(documents: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """documents without the rows that find_leaks reports, with all their columns; no row is moved."""
    import pyarrow as pa

    schema = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes)
    kept = documents
    for items in benchmark_blocks(documents, benchmark, min_similarity):
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def make(shared=shared):
            def one(batch):
                leaked = {row[0] for row in find(Tokens(batch.column("text").to_pylist(), alnum=True), shared.value)}
                clean = batch.filter(pa.array([i not in leaked for i in range(batch.num_rows)]))
                return dict(zip(clean.schema.names, clean.columns, strict=True))

            return one

        kept = map_texts(kept, make, schema)
    return kept
