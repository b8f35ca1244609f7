"""Language-model scoring by deleted interpolation of word bigrams.

P(w | v) = a2 c(v w) / c(v) + a1 c(w) / N + a0 / (V + 1), where the weights a depend on the bucket (power of two) of the
context's count c(v). They are learned by expectation-maximisation on held-out counts: every training token is held
out in turn, that is, judged by the counts of all the others, and tokens that agree in the context's bucket and, to an
eighth of a power of two, in both estimates are counted together, so the table of held-out counts has a bounded size
while the counts behind it cover the whole corpus. A text's words are followed by an end, which is also the context of
the next text's first word.

Nothing is broadcast but the weights. Documents are packed into blocks of about BLOCK_TOKENS tokens (hashes of the
block's words, and each token's place in them). A block asks for the counts of its distinct words and bigrams:
their hashes, with the block's training counts, go to buckets by hash, each bucket adds up what all blocks bring and
answers every block. So what is shuffled is one entry for each distinct bigram of a block, packed, and no key is hot:
a frequent word is one entry a block. A step cuts by CUT_BITS bits at most; where more buckets are needed, groups of
GROUP blocks are added up bucket by bucket and ask on in the same way, so messages stay in proportion to the blocks.
Hashes have 56 bits, by which different n-grams can fall together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, batches_by_bytes, fold, materialize, mix64

BLOCK_TOKENS, BUCKET_ENTRIES = 1_000_000, 1_000_000
CUT_BITS, GROUP = 8, 256
STEPS = 40
#: Quantised logarithms: steps of a power of two, and the mark for an estimate of 0.
FINE, NONE = 8, -100_000
END = np.uint64(0x5BD1E9955BD1E9)


def _zip(a: np.ndarray) -> bytes:
    """Byte planes of the values, compressed."""
    import zstandard

    width = a.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes())


def _unzip(b: bytes, dtype) -> np.ndarray:
    import zstandard

    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def _zip_sorted(h: np.ndarray) -> bytes:
    return _zip(np.diff(h, prepend=np.uint64(0)))


def _unzip_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unzip(b, np.uint64), dtype=np.uint64)


class Block:
    """vocabulary: hashes of the words, the most frequent first (so that ids compress); ids: of each token; sizes: tokens
    of each document, its end counted; train: its part."""

    def __init__(self, vocabulary: np.ndarray, ids: np.ndarray, sizes: np.ndarray, train: np.ndarray):
        self.vocabulary, self.ids, self.sizes, self.train = vocabulary, ids, sizes, train

    @classmethod
    def of(cls, hashes: list[np.ndarray], sizes: np.ndarray, train: np.ndarray) -> Block:
        """hashes: of the words of documents one after another; sizes: words of each document."""
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        tokens = np.insert(words >> np.uint64(8), np.cumsum(sizes), END)
        vocabulary, ids, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return cls(vocabulary[order], rank[ids], sizes + 1, train)

    @property
    def end(self) -> int:
        return int(np.flatnonzero(self.vocabulary == END)[0])

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        return bigrams(self.ids, self.end, len(self.vocabulary))

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        v, w = np.divmod(codes, len(self.vocabulary))
        return mix64(mix64(self.vocabulary[v]) * np.uint64(3) + self.vocabulary[w]) >> np.uint64(8)

    def token_train(self) -> np.ndarray:
        return np.repeat(self.train, self.sizes)


def bigrams(ids: np.ndarray, end: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigrams as context * size + word, and each token's place in them. end: the end's id, the first context."""
    codes = np.empty(len(ids), np.int64)
    codes[1:] = ids[:-1]
    codes[:1] = end
    codes *= size
    codes += ids
    return np.unique(codes, return_inverse=True)


def pack(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, train) -> blocks (block, docs, sizes, train, tokens, vocabulary, ids)."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches):
        hashes, sizes, docs, train, held, made = [], [], [], [], 0, 0

        def flush():
            nonlocal hashes, sizes, docs, train, held, made
            b = Block.of(hashes, np.concatenate(sizes), np.array(train, bool))
            row = {"block": [(TaskContext.get().partitionId() << 32) | made], "docs": [docs], "sizes": [_zip(b.sizes.astype(np.int64))], "train": [_zip(b.train.astype(np.uint8))], "tokens": [len(b.ids)], "vocabulary": [_zip(b.vocabulary)], "ids": [_zip(b.ids)]}
            hashes, sizes, docs, train, held, made = [], [], [], [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array(row["block"], pa.int64()), pa.array(row["docs"], pa.list_(id_type)), *(pa.array(row[c], t) for c, t in (("sizes", pa.binary()), ("train", pa.binary()), ("tokens", pa.int64()), ("vocabulary", pa.binary()), ("ids", pa.binary())))], list(row))

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            texts = batch.column("text").to_pylist()
            for a, z in batches_by_bytes(texts):
                if z == a:
                    continue
                t = Tokens(texts[a:z])
                hashes.append(t.hash)
                sizes.append(np.diff(t.first))
                docs += batch.column("doc_id")[a:z].to_pylist()
                train += batch.column("train")[a:z].to_pylist()
                held += len(t.hash) + z - a
                if held >= BLOCK_TOKENS:
                    yield flush()
        if docs:
            yield flush()

    return documents.mapInArrow(run, f"block bigint, docs array<{kind}>, sizes binary, train binary, tokens bigint, vocabulary binary, ids binary")


def _read(row: dict) -> Block:
    return Block(_unzip(row["vocabulary"], np.uint64), _unzip(row["ids"], np.int32), _unzip(row["sizes"], np.int64), _unzip(row["train"], np.uint8).astype(bool))


_PIECE = "bucket bigint, sender bigint, words binary, word_n binary, pairs binary, pair_n binary"
_ANSWER = "bucket bigint, sender bigint, word_n binary, pair_n binary, types bigint"


def _record(row: dict, schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(row[c], kinds[k]) for c, k in fields], [c for c, _ in fields])


def _cut(bucket: int, sender: int, parts: list[tuple[np.ndarray, np.ndarray]], bits: int, used: int):
    """A record for each piece of the ascending hashes (of words and of bigrams) cut by the next bits."""
    cuts = []
    for h, _ in parts:
        first = h >> np.uint64(56 - used - bits) & np.uint64((1 << bits) - 1)
        cuts.append(np.searchsorted(first, np.arange((1 << bits) + 1, dtype=np.uint64)))
    for k in range(1 << bits):
        (words, word_n), (pairs, pair_n) = ((h[c[k] : c[k + 1]], n[c[k] : c[k + 1]]) for (h, n), c in zip(parts, cuts, strict=True))
        if len(words) or len(pairs):
            yield _record({"bucket": [bucket << bits | k], "sender": [sender], "words": [_zip_sorted(words)], "word_n": [_zip(word_n.astype(np.uint64))], "pairs": [_zip_sorted(pairs)], "pair_n": [_zip(pair_n.astype(np.uint64))]}, _PIECE)


def _ask(blocks: DataFrame, bits: int) -> DataFrame:
    """Each block's distinct words and bigrams with its training counts, cut by the hash's first bits."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _read(row)
                train = b.token_train()
                codes, which = b.bigrams()
                parts = []
                for h, n in ((b.vocabulary, np.bincount(b.ids, train, len(b.vocabulary))), (b.hashes(codes), np.bincount(which, train, len(codes)))):
                    order = np.argsort(h)
                    parts.append((h[order], n[order]))
                yield from _cut(0, row["block"], parts, bits, 0)

    return blocks.select("block", "sizes", "train", "vocabulary", "ids").mapInArrow(run, _PIECE)


def _added(rows: list[dict], name: str, counts: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct hashes of all rows, their counts over all, and where each row's lie among them."""
    h = [_unzip_sorted(r[name]) for r in rows]
    n = np.concatenate([_unzip(r[counts], np.uint64) for r in rows])
    cuts = np.cumsum([0, *map(len, h)])
    every, which = np.unique(np.concatenate(h), return_inverse=True)
    return every, np.bincount(which, n, len(every)).astype(np.uint64), [which[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _answer(bucket: pa.Table) -> pa.Table:
    """Adds up a bucket's counts over all senders and answers each; types: its distinct training words, told to one."""
    rows = bucket.to_pylist()
    out = {"bucket": [r["bucket"] for r in rows], "sender": [r["sender"] for r in rows]}
    for name, counts in (("words", "word_n"), ("pairs", "pair_n")):
        _, total, places = _added(rows, name, counts)
        out[counts] = [_zip(total[at]) for at in places]
        if name == "words":
            out["types"] = [int((total > 0).sum())] + [0] * (len(rows) - 1)
    return pa.Table.from_batches([_record(out, _ANSWER)])


def _totals(pieces: DataFrame, senders: int, used: int, bits: int) -> DataFrame:
    """Answers to all pieces, which are cut by `used` bits so far and have to be cut by `bits` more to be few enough."""
    if not bits:
        return pieces.groupBy("bucket").applyInArrow(_answer, _ANSWER)
    step, groups = min(bits, CUT_BITS), -(-senders // GROUP)
    pieces = materialize(pieces.withColumn("team", F.pmod(F.xxhash64("sender"), F.lit(groups))), "lm-pieces")

    def combine(team: pa.Table) -> pa.Table:
        rows = team.to_pylist()
        parts = [_added(rows, name, counts)[:2] for name, counts in (("words", "word_n"), ("pairs", "pair_n"))]
        return pa.Table.from_batches(list(_cut(rows[0]["bucket"], rows[0]["team"], parts, step, used)))

    def spread(team: pa.Table, answers: pa.Table) -> pa.Table:
        rows, replies = team.to_pylist(), sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        out = {"bucket": [r["bucket"] for r in rows], "sender": [r["sender"] for r in rows], "types": [sum(r["types"] for r in replies)] + [0] * (len(rows) - 1)}
        for name, counts in (("words", "word_n"), ("pairs", "pair_n")):
            total = np.concatenate([_unzip(r[counts], np.uint64) for r in replies])
            out[counts] = [_zip(total[at]) for at in _added(rows, name, counts)[2]]
        return pa.Table.from_batches([_record(out, _ANSWER)])

    asked = pieces.groupBy("bucket", "team").applyInArrow(combine, _PIECE)
    answers = _totals(asked, groups, used + step, bits - step).withColumn("of", F.shiftright("bucket", step))
    return pieces.groupBy("bucket", "team").cogroup(answers.groupBy("of", "sender")).applyInArrow(spread, _ANSWER)


def _quantise(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.round(FINE * np.log2(np.maximum(x, 1e-300))), NONE).astype(np.int32)


def _bucket_of(count: np.ndarray) -> np.ndarray:
    """-1 for a context that was never seen, else the power of two below its count."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))), -1).astype(np.int32)


def _meet(block: pa.Table, answers: pa.Table) -> pa.Table:
    """A block with its counts (of words, and of bigrams in the order of its codes) and its held-out counts."""
    row = block.to_pylist()[0]
    b = _read(row)
    codes, which = b.bigrams()
    replies = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
    word_n = np.empty(len(b.vocabulary), np.uint64)
    word_n[np.argsort(b.vocabulary)] = np.concatenate([_unzip(r["word_n"], np.uint64) for r in replies])
    pair_n = np.empty(len(codes), np.uint64)
    pair_n[np.argsort(b.hashes(codes))] = np.concatenate([_unzip(r["pair_n"], np.uint64) for r in replies])
    mine = np.bincount(which, b.token_train(), len(codes))
    used = np.flatnonzero(mine)
    v, w = np.divmod(codes[used], len(b.vocabulary))
    context, pair, word = (x.astype(float) - 1 for x in (word_n[v], pair_n[used], word_n[w]))
    k = np.stack([_bucket_of(context), _quantise(pair / np.maximum(context, 1)), _quantise(word)])
    cells, of = np.unique(k, axis=1, return_inverse=True) if len(used) else (k, np.zeros(0, int))
    n = np.bincount(of.ravel(), mine[used], cells.shape[1])
    held = [{"b": int(x), "p2": int(y), "p1": int(z), "n": int(c)} for (x, y, z), c in zip(cells.T, n, strict=True)]
    kind = pa.list_(pa.struct([("b", pa.int32()), ("p2", pa.int32()), ("p1", pa.int32()), ("n", pa.int64())]))
    made = [block.column("docs"), block.column("sizes"), pa.array([_zip(word_n)]), pa.array([_zip(pair_n)]), pa.array([held], kind), pa.array([int(b.token_train().sum())]), pa.array([sum(r["types"] for r in replies)])]
    return pa.table([*made, block.column("ids"), pa.array([b.end], pa.int32())], ["docs", "sizes", "word_n", "pair_n", "held", "train_tokens", "types", "ids", "end"])


def learn_weights(cells: list[tuple], n: int, v: int, steps: int = STEPS) -> dict[int, np.ndarray]:
    """cells: (context bucket, quantised c(v w)/c(v), quantised c(w), tokens) -> the weights (bigram, word, uniform) of
    each bucket by expectation-maximisation."""
    out = {}
    table = np.array(cells, float).reshape(-1, 4)
    for b in np.unique(table[:, 0]):
        part = table[table[:, 0] == b]
        p = np.stack([np.where(part[:, 1] == NONE, 0, np.exp2(part[:, 1] / FINE)), np.where(part[:, 2] == NONE, 0, np.exp2(part[:, 2] / FINE)) / max(1, n - 1), np.full(len(part), 1 / (v + 1))])
        a = np.full(3, 1 / 3)
        for _ in range(steps):
            mixed = a[:, None] * p
            a = ((mixed / mixed.sum(axis=0)) * part[:, 3]).sum(axis=1) + 1e-6
            a /= a.sum()
        if b < 0:  # an unseen context has no bigram estimate
            a = np.array([0, a[1], a[2]]) / (a[1] + a[2])
        out[int(b)] = a
    return out


def score_texts(documents: DataFrame, held_out: int = 1) -> DataFrame:
    """documents (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row per row.

    Trains on the rows whose fold is not `held_out` and scores all whole texts. Null and empty texts are one end.
    Repeated rows count and appear as often as they occur; other columns are ignored; an empty table gives an empty
    result. Without training rows the score is the uniform estimate, and base_score that of counts of 0."""
    spark = documents.sparkSession
    kind = dict(documents.dtypes)["doc_id"]
    out = f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    blocks = materialize(pack(documents.select("doc_id", "text", (fold(F.col("doc_id")) != held_out).alias("train"))), "lm-blocks")
    total = blocks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total / BUCKET_ENTRIES)))))
    first = min(bits, CUT_BITS)
    answers = _totals(_ask(blocks, first), blocks.count(), first, bits - first)
    met = blocks.groupBy("block").cogroup(answers.groupBy("sender")).applyInArrow(
        _meet, f"docs array<{kind}>, sizes binary, word_n binary, pair_n binary, held array<struct<b:int,p2:int,p1:int,n:bigint>>, train_tokens bigint, types bigint, ids binary, end int"
    )
    met = materialize(met, "lm-counts")
    sums = met.agg(F.sum("train_tokens").alias("n"), F.sum("types").alias("v")).first()
    n, v = int(sums.n or 0), int(sums.v or 0)
    cells = met.select(F.explode("held").alias("h")).groupBy("h.b", "h.p2", "h.p1").agg(F.sum("h.n").alias("n"))
    weights = spark.sparkContext.broadcast(learn_weights([tuple(r) for r in cells.collect()], n, v))  # a row per bucket

    def run(batches):
        table = np.zeros((66, 3))
        for b in range(-1, 65):
            known = [k for k in weights.value if k <= b] or list(weights.value)
            table[b + 1] = weights.value[max(known) if min(known) <= b else min(known)] if known else (0, 0, 1)
        table[0, 0] = 0
        table[0] /= table[0].sum() or 1
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = _unzip(row["ids"], np.int32), _unzip(row["sizes"], np.int64)
                word_n, pair_n = _unzip(row["word_n"], np.uint64).astype(float), _unzip(row["pair_n"], np.uint64).astype(float)
                codes, which = bigrams(ids, row["end"], len(word_n))
                c, w = np.divmod(codes, len(word_n))
                a = table[_bucket_of(word_n[c]) + 1]
                p = a[:, 0] * pair_n / np.maximum(word_n[c], 1) + a[:, 1] * word_n[w] / max(1, n) + a[:, 2] / (v + 1)
                first = np.cumsum(sizes) - sizes
                base = np.log10((word_n + 0.5) / (n + 0.5 * (v + 1)))
                columns = [pa.array(row["docs"], batch.schema.field("docs").type.value_type), sizes, np.add.reduceat((word_n > 0).astype(np.int64)[ids], first), np.full(len(first), n), np.add.reduceat(base[ids], first), np.add.reduceat(np.log10(p)[which], first)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = met.select("docs", "sizes", "word_n", "pair_n", "ids", "end").mapInArrow(run, out)
    return scored.select("doc_id", (fold(F.col("doc_id")) == held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
