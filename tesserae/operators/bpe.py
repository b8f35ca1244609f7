"""Byte-pair encoding of words: training over a distributed table of words, encoding in batches."""

from __future__ import annotations

import copy
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import materialize

SPECIAL = ("<pad>", "<unk>", "<bos>", "<eos>", "<sp>")
#: Words that a task remembers while it encodes.
MEMORY = 200_000
#: Over a table of words: words that the driver tries merges on (the most frequent, and as many of the others by hash), and
#: words that a task merges at once. Neither bears on results.
TRIED, AT_ONCE = 60_000, 100_000
#: Most symbols of distinct words that the driver trains on itself: 85 bytes each were measured (5.3 million symbols,
#: 3,000 merges), so 340 MB.
MOST_HELD = 4_000_000


def word_frequencies(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.select(F.explode(T.pretokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def _pairs(symbols: Column) -> Column:
    """Neighbouring symbols of an array as structs."""
    rest = F.greatest(F.size(symbols) - 1, F.lit(0))
    return F.arrays_zip(F.slice(symbols, F.lit(1), rest).alias("left"), F.slice(symbols, F.lit(2), rest).alias("right"))


def pair_frequencies(words: DataFrame) -> DataFrame:
    """words (token, n) -> left, right, n over neighbouring characters, weighted by the words' counts."""
    pairs = words.select("n", F.explode(_pairs(_letters(F.col("token")))).alias("p"))
    return pairs.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def characters(words: DataFrame) -> DataFrame:
    return words.select(F.explode(_letters(F.col("token"))).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))


def merge(symbols: list[str], left: str, right: str) -> list[str]:
    """Joins every left-right pair; of pairs that overlap, the one that begins first."""
    starts = [k for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair == (left, right)]
    joined: set[int] = set()
    for k in starts:
        if k - 1 not in joined:
            joined.add(k)
    return [left + right if k in joined else s for k, s in enumerate(symbols) if k - 1 not in joined]


def _next_merges(pairs: Counter, most: int) -> list[tuple[str, str]]:
    """The merges that certainly come next, in order: the most frequent pair, and further ones that share no symbol with
    those before and are more frequent than any pair that these can create."""
    ranked = sorted(((-n, p) for p, n in pairs.items() if n > 0))
    out: list[tuple[str, str]] = []
    used: set[str] = set()
    created = 0  # bounds the count of every new pair: it replaces a pair that ends or begins with a merged symbol
    by_right, by_left = Counter(), Counter()
    for (a, b), n in pairs.items():
        by_right[b], by_left[a] = max(by_right[b], n), max(by_left[a], n)
    for n, (a, b) in ranked:
        if len(out) == most or out and ({a, b} & used or created >= -n):
            break
        out.append((a, b))
        used |= {a, b}
        created = max(created, min(-n, max(by_right[a], by_left[b])))
    return out


class _Symbols:
    """All words in one array of symbols with links to the one before and the one after in its word.

    For each pair its count and the places where it arose are kept, and a heap holds (count, pair) as it was when it
    changed; an entry that says another count than the pair has now is passed over. A merge looks at the places of its
    pair and at their neighbours alone, in whole arrays."""

    def __init__(self, words: list[str], counts: np.ndarray):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        alphabet, self.symbol = np.unique(points, return_inverse=True)
        self.symbol = self.symbol.astype(np.int32)
        self.names = [chr(x) for x in alphabet.tolist()]
        self.ids = {x: i for i, x in enumerate(self.names)}
        n = len(points)
        ends = np.cumsum(sizes)
        place = np.arange(n, dtype=np.int32)
        self.after, self.before = place + 1, place - 1
        filled = sizes > 0
        self.after[ends[filled] - 1] = -1
        self.before[(ends - sizes)[filled]] = -1
        self.weight = np.repeat(counts.astype(np.int64), sizes)
        self.count: dict[tuple[int, int], int] = {}
        self.places: dict[tuple[int, int], list[np.ndarray]] = {}
        self.heap: list[tuple] = []
        self.changes: Counter | None = None  # if set, gets the changes of the counts by names
        self._add(np.flatnonzero(self.after >= 0).astype(np.int32), 1)

    def _add(self, at: np.ndarray, sign: int) -> None:
        """Counts the pairs that begin at these places, or takes them off."""
        if not len(at):
            return
        key = self.symbol[at].astype(np.int64) << 32 | self.symbol[self.after[at]]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = np.add.reduceat(self.weight[at], first)
        for k, total, a, b in zip(key[first].tolist(), sums.tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
            pair = k >> 32, k & 0xFFFFFFFF
            if self.changes is not None:
                self.changes[self.names[pair[0]], self.names[pair[1]]] += sign * total
            self.count[pair] = n = self.count.get(pair, 0) + sign * total
            if sign > 0:
                self.places.setdefault(pair, []).append(at[a:b])
            if n > 0:
                heapq.heappush(self.heap, (-n, self.names[pair[0]], self.names[pair[1]], pair))
            else:
                del self.count[pair]
                if n == 0:
                    self.places.pop(pair, None)

    def best(self) -> tuple[int, int] | None:
        """The most frequent pair; of several the smallest."""
        while self.heap and self.count.get(self.heap[0][3]) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        return self.heap[0][3] if self.heap else None

    def id_of(self, name: str) -> int:
        made = self.ids.setdefault(name, len(self.names))  # another pair may have made the same symbol
        if made == len(self.names):
            self.names.append(name)
        return made

    def merge_named(self, left: str, right: str) -> None:
        """Merges a pair of symbols, of which there may be none."""
        self.merge((self.id_of(left), self.id_of(right)))

    def told(self, pairs: dict[tuple[str, str], int]) -> None:
        """Sets the counts to those of a larger table of words; the words here then tell how they change."""
        self.count = {(self.id_of(a), self.id_of(b)): n for (a, b), n in pairs.items()}
        self.heap = [(-n, self.names[a], self.names[b], (a, b)) for (a, b), n in self.count.items()]
        heapq.heapify(self.heap)

    def merge(self, pair: tuple[int, int]) -> tuple[str, str]:
        left, right = pair
        at = np.unique(np.concatenate(self.places.get(pair) or [np.zeros(0, np.int32)]))
        at = at[(self.symbol[at] == left) & (self.after[at] >= 0)]  # a symbol that was joined to the one before has none
        at = at[self.symbol[self.after[at]] == right]
        if left == right and len(at):  # in a run every second place begins a pair
            starts = np.concatenate([[True], self.after[at[:-1]] != at[1:]])
            run = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        second = self.after[at]
        near = np.concatenate([self.before[at], at, second])
        near = near[near >= 0]
        old = np.unique(near[self.after[near] >= 0])
        self._add(old, -1)
        names = self.names[left], self.names[right]
        self.symbol[at] = self.id_of(names[0] + names[1])
        third = self.after[second]
        self.after[at] = third
        self.before[third[third >= 0]] = at[third >= 0]
        self.symbol[second], self.after[second] = -1, -1
        near = np.concatenate([self.before[at], at])
        near = near[near >= 0]
        self._add(np.unique(near[self.after[near] >= 0]), 1)
        return names


def train_held(words: list[str], counts: np.ndarray, merges: int) -> list[tuple[str, str]]:
    """The merges in order, over words that are held here."""
    made = _Symbols(words, counts)
    out: list[tuple[str, str]] = []
    while len(out) < merges and (pair := made.best()) is not None:
        out.append(made.merge(pair))
    return out


def train(words: DataFrame, merges: int, most_held: int = MOST_HELD) -> list[tuple[str, str]]:
    """words (token distinct, n) -> the merges in order; of pairs that are equally frequent the smallest.

    Up to most_held symbols of words, a size that is checked, the driver merges; beyond, train_spread does with the same
    result."""
    words = words.select("token", "n")
    if (words.agg(F.sum(F.length("token"))).first()[0] or 0) > most_held:
        return train_spread(words, merges)
    held = words.toArrow()
    return train_held(held.column("token").to_pylist(), held.column("n").to_numpy(), merges)


def _rows(df: DataFrame) -> Iterator[tuple]:
    table = df.toArrow()
    return zip(*(c.to_pylist() for c in table.columns), strict=True)


def _tried(words: DataFrame, tried: int) -> _Symbols:
    """The most frequent words, and as many of the others by hash, which stand for all of those."""
    often = words.orderBy(F.desc("n"), "token").limit(tried)
    least = often.agg(F.min("n")).first()[0] or 0
    rest = words.filter(F.col("n") < least)
    every = max(1, rest.count() // tried)
    drawn = rest.filter(F.pmod(F.xxhash64("token"), F.lit(every)) == 0).withColumn("n", F.col("n") * every)
    held = often.unionByName(drawn).toArrow()
    return _Symbols(held.column("token").to_pylist(), held.column("n").to_numpy())


def _guess(tried: _Symbols, pairs: Counter, most: int) -> list[tuple[str, str]]:
    """Merges that may come next: by the exact counts as they are, and as the words that are held change them."""
    made = copy.deepcopy(tried)
    made.told(pairs)
    out: list[tuple[str, str]] = []
    while len(out) < most and (pair := made.best()) is not None:
        out.append(made.merge(pair))
        made.count.pop(pair, None)  # those of words that are not held here are merged too
    return out


def _changes(words: DataFrame, before: list[tuple[str, str]], guess: list[tuple[str, str]], at_once: int) -> list[Counter]:
    """How each merge of a guess changes the counts of pairs over all words, after the merges before it."""

    def run(batches):
        total = [Counter() for _ in guess]
        held: list[pa.RecordBatch] = []

        def take():
            table = pa.Table.from_batches(held)
            made = _Symbols(table.column("token").to_pylist(), table.column("n").to_numpy())
            for left, right in before:
                made.merge_named(left, right)
            for step, (left, right) in enumerate(guess):
                made.changes = total[step]
                made.merge_named(left, right)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= at_once:
                take()
                held = []
        if held:
            take()
        rows = [(step, left, right, n) for step, c in enumerate(total) for (left, right), n in c.items() if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["step", "left", "right", "n"])

    found = words.mapInArrow(run, "step bigint, left string, right string, n bigint")
    out = [Counter() for _ in guess]
    for step, left, right, n in _rows(found.groupBy("step", "left", "right").agg(F.sum("n").alias("n")).filter("n <> 0")):
        out[step][left, right] = n
    return out


def _agreed(certain: list[tuple[str, str]], guess: list[tuple[str, str]]) -> int:
    """How many of the merges that certainly come next are also the next of a guess, as a whole in any order: they share no
    symbol, so words and counts after them are the same, unless one makes a symbol of another."""
    for n in range(min(len(certain), len(guess)), 0, -1):
        mine = certain[:n]
        if mine == guess[:n] or set(mine) == set(guess[:n]) and not {a + b for a, b in mine} & {x for p in mine for x in p}:
            return n
    return 0


def train_spread(words: DataFrame, merges: int, tried: int = TRIED, at_once: int = AT_ONCE) -> list[tuple[str, str]]:
    """The same over a distributed table of words.

    The driver holds the counts of distinct pairs, which the vocabulary bounds and not the data, and some words, on which
    it tries which merges may come next. One pass over all words then brings how each of these changes the counts, and
    they are taken as far as the exact counts agree; the first is always right. What they don't agree with is tried anew
    from there."""
    words = words.select("token", "n")
    counted = words.select("n", F.explode(_pairs(_letters(F.col("token")))).alias("p")).groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))
    pairs = Counter({(left, right): n for left, right, n in _rows(counted)})
    held = _tried(words, tried)
    out: list[tuple[str, str]] = []
    while len(out) < merges and pairs:
        guess = _guess(held, pairs, merges - len(out))
        changes, at = _changes(words, out, guess, at_once), 0
        while at < len(guess) and (n := _agreed(certain := _next_merges(pairs, len(guess) - at), guess[at:])):
            for change in changes[at : at + n]:
                for pair, by in change.items():
                    pairs[pair] += by
            pairs = +pairs
            out += certain[:n]
            for left, right in certain[:n]:
                held.merge_named(left, right)
            at += n
    return out


class Tokenizer:
    """Special tokens, then characters in order, then merges in order."""

    def __init__(self, alphabet: list[str], merges: list[tuple[str, str]]):
        self.alphabet = sorted(alphabet)
        self.tokens = list(dict.fromkeys([*SPECIAL, *self.alphabet, *(a + b for a, b in merges)]))
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.rank = {p: i for i, p in enumerate(merges)}

    def word(self, word: str) -> list[int]:
        """The ids of a word's symbols after all merges that apply, the earliest first."""
        s, rank, none = list(word), self.rank, len(self.rank)
        ranks = [rank.get(p, none) for p in zip(s, s[1:], strict=False)]
        while ranks and (first := min(ranks)) < none:
            k = ranks.index(first)
            left, right = s[k], s[k + 1]
            while True:  # every place of the pair, from the left; the pairs at its sides change
                s[k : k + 2] = [left + right]
                del ranks[k]
                if k:
                    ranks[k - 1] = rank.get((s[k - 1], s[k]), none)
                if k < len(ranks):
                    ranks[k] = rank.get((s[k], s[k + 1]), none)
                if first not in ranks[k + 1 :]:
                    break
                k = ranks.index(first, k + 1)
        return [self.ids.get(x, self.ids["<unk>"]) for x in s]

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Vocabulary (token, id) and merges (left, right, priority)."""
        vocabulary = spark.createDataFrame(list(self.ids.items()), "token string, id int")
        return vocabulary, spark.createDataFrame([(*p, i) for p, i in self.rank.items()], "left string, right string, priority int")

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        for name, table in zip(("vocabulary", "merges"), self.tables(spark), strict=True):
            table.write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tokenizer:
        merges = [(r.left, r.right) for r in spark.read.parquet(f"{path}/merges").orderBy("priority").collect()]
        tokens = [r.token for r in spark.read.parquet(f"{path}/vocabulary").orderBy("id").collect()]
        made = {a + b for a, b in merges}
        loaded = cls([t for t in tokens if t not in SPECIAL and t not in made], merges)
        if loaded.tokens != tokens:
            raise ValueError(f"{path} holds no tokenizer of this kind")
        return loaded


def fit(texts: DataFrame, merges: int, text: str = "text") -> Tokenizer:
    """Trains on all words of all texts; the alphabet is that of all words."""
    counted = materialize(word_frequencies(texts, text), "bpe-counts")
    return Tokenizer([r.token for r in characters(counted).select("token").collect()], train(counted, merges))


def encode(texts: DataFrame, key: str, tokenizer: Tokenizer, text: str = "text", begin: bool = False, end: bool = False) -> DataFrame:
    """(key, tokens): words' ids with <sp> between words, in batches where the texts lie; a task remembers the words that
    it has encoded. A text without words, or null, has no tokens but the asked-for marks."""
    shared = texts.sparkSession.sparkContext.broadcast(tokenizer)
    kind = dict(texts.dtypes)[key]

    def run(batches):
        made, gap = shared.value, shared.value.ids["<sp>"]
        known: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for words in batch.column("words").to_pylist():
                ids = [made.ids["<bos>"]] if begin else []
                for k, w in enumerate(words or ()):
                    if w not in known:
                        if len(known) >= MEMORY:
                            known.clear()
                        known[w] = made.word(w)
                    if k:
                        ids.append(gap)
                    ids += known[w]
                out.append(ids + ([made.ids["<eos>"]] if end else []))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.int32()))], [key, "tokens"])

    return texts.select(key, T.pretokens(F.col(text)).alias("words")).mapInArrow(run, f"`{key}` {kind}, tokens array<int>")


def decode(rows: DataFrame, tokenizer: Tokenizer, column: str = "tokens", text: str = "text") -> DataFrame:
    """rows with the text of their tokens: <sp> as a blank, without begin, end and filling."""
    pieces = F.array(*[F.lit("" if t in ("<bos>", "<eos>", "<pad>") else " " if t == "<sp>" else t) for t in tokenizer.tokens])
    return rows.withColumn(text, F.array_join(F.transform(column, lambda i: F.element_at(pieces, i + 1)), ""))
