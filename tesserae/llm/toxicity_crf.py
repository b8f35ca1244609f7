"""Toxicity by a linear-chain conditional random field.

Token labels: in a bounded sample of labelled documents (labelled.py), words whose share among toxic documents lies
significantly above that among others mark, in toxic documents, the toxic tokens. A two-state chain (clean, toxic)
with a weight per word and transition weights is fitted to those labels by gradient ascent on its conditional
likelihood. A document's marginals come from forward-backward; its score is a calibrated combination of the largest
marginal and of the expected number of toxic tokens, and its offending spans are the runs of tokens with a marginal of
one half or more.

Forward-backward over two states is a recurrence of fractional linear maps in the ratio of the states; a batch's
documents run through it as one sequence with a reset at each start, in blocks whose maps are composed first, so a
very long document costs as much a word as a short one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, batches_by_bytes, fold, map_texts
from .labelled import SAMPLE_ROWS, labelled_sample

THRESHOLD, SPAN_THRESHOLD = 0.5, 0.5
#: Least standard score, lift and number of toxic documents of a word that marks tokens; least documents of a word with a weight.
MIN_Z, MIN_LIFT, MIN_TOXIC, MIN_DOCS = 4.0, 3.0, 4, 3
STEPS, RATE, DECAY = 40, 0.3, 1e-3


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, block: int = 256) -> np.ndarray:
    """x_t = (a_t + b_t x_{t-1}) / (c_t + d_t x_{t-1}) with x_{-1} = 1."""
    n = len(a)
    if not n:
        return np.zeros(0)
    blocks = -(-n // block)
    lay = lambda v, fill: np.ascontiguousarray(np.concatenate([v, np.full(blocks * block - n, fill)]).reshape(blocks, block).T)
    a, b, c, d = lay(a, 0.0), lay(b, 1.0), lay(c, 1.0), lay(d, 0.0)
    pb, pa, pd, pc = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for j in range(block):  # matrices [[b, a], [d, c]], the later on the left
        pb, pa, pd, pc = b[j] * pb + a[j] * pd, b[j] * pa + a[j] * pc, d[j] * pb + c[j] * pd, d[j] * pa + c[j] * pc
        scale = 1 / (pb + pa + pd + pc)
        pb, pa, pd, pc = pb * scale, pa * scale, pd * scale, pc * scale
    entry = np.empty(blocks)
    x = 1.0
    for i, (sb, sa, sd, sc) in enumerate(zip(pb.tolist(), pa.tolist(), pd.tolist(), pc.tolist(), strict=True)):
        entry[i] = x
        x = (sa + sb * x) / (sc + sd * x)
    out = np.empty((block, blocks))
    for j in range(block):
        entry = (a[j] + b[j] * entry) / (c[j] + d[j] * entry)
        out[j] = entry
    return out.T.reshape(-1)[:n]


class Chain:
    """words: sorted hashes; weight: of each for the toxic state; bias; t: log potentials (2, 2); start: log odds."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.weight = np.zeros(len(words) + 1)  # the last is any other word's and stays 0
        self.theta = np.array([-3.0, 0.0, 0.0, 1.0, 0.0])  # bias, t01, t10, t11, start
        self.calibration = np.zeros(3)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words))

    def marginals(self, ids: np.ndarray, opens: np.ndarray, pairs: bool = False):
        """P(toxic) of each token; opens marks each document's first. With pairs, also the expected transitions' gradient parts."""
        bias, t01, t10, t11, start = self.theta
        psi = np.exp(np.clip(self.weight[ids] + bias, -15, 15))
        e01, e10, e11 = np.exp(np.clip((t01, t10, t11), -10, 10))
        up = np.exp(np.clip(start, -10, 10))
        closes = np.append(opens[1:], True) if len(opens) else opens
        following = np.append(psi[1:], 1.0) if len(psi) else psi
        forward = scan(np.where(opens, psi * up, psi * e01), np.where(opens, 0.0, psi * e11), np.ones(len(psi)), np.where(opens, 0.0, e10))
        backward = scan(*(np.where(closes, r, v)[::-1] for v, r in ((e10, 1.0), (e11 * following, 0.0), (1.0, 1.0), (e01 * following, 0.0))))[::-1]
        odds = forward * backward
        p = odds / (1 + odds)
        if not pairs:
            return p
        inner = ~opens
        before, after = np.roll(forward, 1)[inner], (psi * backward)[inner]
        parts = np.stack([np.ones(len(before)), e01 * after, e10 * before, e11 * before * after])
        parts /= parts.sum(axis=0)
        return p, parts[1:].sum(axis=1)

    def fit(self, ids: np.ndarray, opens: np.ndarray, y: np.ndarray) -> Chain:
        if not len(ids):
            return self
        inner = ~opens
        prev = np.roll(y, 1)
        seen = np.array([(inner & (prev == a) & (y == b)).sum() for a, b in ((0, 1), (1, 0), (1, 1))], float)
        n, size = len(ids), len(self.weight)
        wins = np.bincount(ids, y, size)
        total = np.maximum(1.0, np.bincount(ids, minlength=size))
        memory = [np.zeros(size), np.zeros(size), np.zeros(5), np.zeros(5)]
        for step in range(1, STEPS + 1):
            p, trans = self.marginals(ids, opens, pairs=True)
            gw = (wins - np.bincount(ids, p, size)) / np.sqrt(total) - DECAY * self.weight * np.sqrt(total)
            gw[-1] = 0
            gt = np.concatenate([[(y - p).sum()], seen - trans, [(y - p)[opens].sum()]]) / n
            for g, m, v, x in ((gw, *memory[:2], self.weight), (gt, *memory[2:], self.theta)):
                m += 0.2 * (g - m)
                v += 0.05 * (g * g - v)
                x += RATE * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-9)
        return self

    def features(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per document: 1, the largest marginal, log(1 + expected number of toxic tokens)."""
        n = len(first) - 1
        full = np.flatnonzero(np.diff(first))
        largest, expected = np.zeros(n), np.zeros(n)
        if len(full):
            largest[full], expected[full] = np.maximum.reduceat(p, first[full]), np.add.reduceat(p, first[full])
        return np.stack([np.ones(n), largest, np.log1p(expected)], axis=1)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Chain:
        """Logistic regression by Newton's method with a small penalty."""
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        self.calibration = w
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30)))


def marking_words(doc_words: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that mark toxicity, and of all words that are frequent enough for a weight. Both sorted."""
    if not len(doc_words):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sizes = [len(w) for w in doc_words]
    words, inverse = np.unique(np.concatenate(doc_words), return_inverse=True)
    toxic = np.bincount(inverse, np.repeat(y, sizes), len(words))
    others = np.bincount(inverse, minlength=len(words)) - toxic
    n1, n0 = max(1, y.sum()), max(1, len(y) - y.sum())
    odds = np.log((toxic + 0.5) / (n1 - toxic + 0.5)) - np.log((others + 0.5) / (n0 - others + 0.5))
    z = odds / np.sqrt(1 / (toxic + 0.5) + 1 / (others + 0.5))
    lift = ((toxic + 0.5) / n1) / ((others + 0.5) / n0)
    return words[(z >= MIN_Z) & (lift >= MIN_LIFT) & (toxic >= MIN_TOXIC)], words[toxic + others >= MIN_DOCS]


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Chain:
    """Fits chain and calibration to at most `rows` labelled rows outside fold 0."""
    sample = labelled_sample(documents, labels, "toxic", rows)
    y = np.array([t for _, t in sample], float)
    texts = [t for t, _ in sample]
    hashes, sizes = [], []
    for a, b in batches_by_bytes(texts):
        t = Tokens(texts[a:b], alnum=True)
        hashes.append(t.hash)
        sizes.append(np.diff(t.first))
    flat, counts = np.concatenate(hashes), np.concatenate(sizes)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    marks, words = marking_words([np.unique(flat[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], y)
    chain = Chain(words)
    opens = np.zeros(len(flat), bool)
    opens[first[:-1][counts > 0]] = True
    ids = chain.ids(flat)
    token_y = (np.isin(flat, marks) & np.repeat(y > 0, counts)).astype(float)
    chain.fit(ids, opens, token_y)
    if len(y):
        chain.calibrate(chain.features(chain.marginals(ids, opens), first), y)
    return chain


def score_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS) -> DataFrame:
    """documents (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted, expected, spans.

    expected: number of toxic tokens by their marginals. spans: array of (start, stop, text), code point offsets of runs
    of tokens with a marginal of one half or more. Null texts count as empty: no spans and the base score. Repeated
    rows stay repeated; other columns are ignored; with no labels every score is one half."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, rows))  # bounded by the sample

    def make():
        chain = shared.value

        def one(batch):
            texts = batch.column("text").to_pylist()
            t = Tokens(texts, alnum=True)
            opens = np.zeros(len(t.hash), bool)
            opens[t.first[:-1][np.diff(t.first) > 0]] = True
            p = chain.marginals(chain.ids(t.hash), opens)
            x = chain.features(p, t.first)
            spans: list[list] = [[] for _ in texts]
            hot = p >= SPAN_THRESHOLD
            begins = np.flatnonzero(hot & (opens | ~np.roll(hot, 1) | (np.arange(len(hot)) == 0)))
            ends = np.flatnonzero(hot & (np.append(opens[1:], True) | ~np.roll(hot, -1))) if len(hot) else begins
            points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])  # code points before each byte
            for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
                d = t.text[i]
                start, stop = (int(points[x] - points[t.bounds[d]]) for x in (t.start[i], t.end[j]))
                spans[d].append({"start": start, "stop": stop, "text": texts[d][start:stop]})
            s = chain.score(x)
            return {"doc_id": batch.column("doc_id"), "score": s, "predicted": (s >= threshold).astype(np.int32), "expected": np.expm1(x[:, 2]), "spans": spans}

        return one

    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, score double, predicted int, expected double, spans array<struct<start:int,stop:int,text:string>>"
    scored = map_texts(documents.select("doc_id", "text"), make, schema)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "expected", "spans")
