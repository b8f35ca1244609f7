"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters look at chunks of WINDOW bytes that start every STRIDE bytes and so overlap, from a document's first
byte to its last; each filter's answers are max-pooled over the whole document, and the pooled values are combined
into one probability. The network is fitted by Adam on a bounded sample of labelled documents (labelled.py) on the
driver and applied to all documents in Arrow batches; its size does not depend on the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_texts
from .labelled import SAMPLE_ROWS, labelled_sample

WINDOW, STRIDE, FILTERS, HIDDEN = 6, 2, 16, 8
#: Passes over the sample; of a small one, as many as MIN_STEPS steps need.
EPOCHS, BATCH, RATE, MIN_STEPS = 8, 64, 0.01, 300
THRESHOLD = 0.3
#: Windows answered at once.
STEP = 1 << 17


def lay_out(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes with zeros after each, where each window starts, and each text's first window."""
    padded = [r + b"\0" * (WINDOW + len(r) % STRIDE) for r in raw]
    sizes = np.array([len(p) for p in padded], np.int64)
    counts = np.maximum(1, -(-np.array([len(r) for r in raw], np.int64) // STRIDE))
    first = np.cumsum(counts) - counts
    base = np.cumsum(sizes) - sizes
    inside = np.arange(int(counts.sum())) - np.repeat(first, counts)
    return np.frombuffer(b"".join(padded), np.uint8), np.repeat(base, counts) + STRIDE * inside, first


class ByteCnn:
    """filters: (WINDOW, 256, FILTERS); answers are pooled, shifted and rectified, then combined by a hidden layer."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": rng.normal(0, 0.15, (WINDOW, 256, FILTERS)),
            "shift": np.zeros(FILTERS),
            "mix": rng.normal(0, 0.3, (FILTERS, HIDDEN)),
            "mix0": np.zeros(HIDDEN),
            "out": rng.normal(0, 0.3, HIDDEN),
            "out0": np.zeros(1),
        }

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, ...]:
        a = np.tanh(pooled + self.p["shift"])
        h = np.tanh(a @ self.p["mix"] + self.p["mix0"])
        return a, h, 1 / (1 + np.exp(-np.clip(h @ self.p["out"] + self.p["out0"][0], -30, 30)))

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 6) -> ByteCnn:
        raw, y = [t.encode() for t in texts], np.array(labels, float)
        if not len(y):
            self.p["out"][:] = 0  # says nothing about any text
            return self
        rate = np.clip(y.mean(), 0.01, 0.99)
        self.p["out0"][:] = np.log(rate / (1 - rate))
        rng = np.random.default_rng(seed)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        epochs = max(epochs, -(-MIN_STEPS * BATCH // len(y)))
        for epoch in range(epochs):
            order = rng.permutation(len(raw))
            for at in range(0, len(order), BATCH):
                step += 1
                part = order[at : at + BATCH]
                grads = self._gradients([raw[i] for i in part], y[part])
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= RATE * (0.3 if epoch >= epochs - 2 else 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, raw: list[bytes], y: np.ndarray, step: int = STEP) -> dict[str, np.ndarray]:
        data, starts, first = lay_out(raw)
        filters = self.p["filters"].astype(np.float32)
        pooled, best = np.full((len(raw), FILTERS), -np.inf, np.float32), np.zeros((len(raw), FILTERS), np.int64)
        for at in range(0, len(starts), step):  # a long text's windows in several steps
            here = starts[at : at + step]
            answers = filters[0][data[here]]
            for k in range(1, WINDOW):
                answers += filters[k][data[here + k]]
            low, high = np.searchsorted(first, at, "right") - 1, np.searchsorted(first, at + len(here))
            cuts = np.append(np.maximum(first[low:high] - at, 0), len(here))
            for d, a, b in zip(range(low, high), cuts, cuts[1:], strict=False):
                where = answers[a:b].argmax(axis=0)
                top = answers[a + where, np.arange(FILTERS)]
                better = top > pooled[d]
                pooled[d][better], best[d][better] = top[better], (at + a + where)[better]
        pooled = pooled.astype(float)
        a, h, p = self.head(pooled)
        d = (p - y) / len(y)
        dh = d[:, None] * self.p["out"] * (1 - h * h)
        da = dh @ self.p["mix"].T * (1 - a * a)
        grads = {"out": h.T @ d, "out0": np.array([d.sum()]), "mix": a.T @ dh, "mix0": dh.sum(axis=0), "shift": da.sum(axis=0)}
        by_filter = np.zeros_like(self.p["filters"])
        for k in range(WINDOW):
            np.add.at(by_filter[k], (data[starts[best] + k], np.arange(FILTERS)), da)
        grads["filters"] = by_filter + 1e-5 * self.p["filters"]
        return grads

    def tables(self) -> list[np.ndarray]:
        """Two neighbouring bytes' part of the answers as one look-up."""
        f = self.p["filters"].astype(np.float32)
        return [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WINDOW, 2)]

    def scores(self, raw: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
        if not raw:
            return np.zeros(0)
        data, starts, first = lay_out(raw)
        pairs = (data[:-1].astype(np.uint16) << 8) | data[1:]
        pooled = np.full((len(raw), FILTERS), -np.inf, np.float32)
        for at in range(0, len(starts), STEP):
            here = starts[at : at + STEP]
            answers = tables[0][pairs[here]]
            for k in range(1, len(tables)):
                answers += tables[k][pairs[here + 2 * k]]
            low = np.searchsorted(first, at, "right") - 1
            high = np.searchsorted(first, at + len(here), "left")
            cuts = np.maximum(first[low:high] - at, 0)
            pooled[low:high] = np.maximum(pooled[low:high], np.maximum.reduceat(answers, cuts, axis=0))
        return self.head(pooled.astype(float))[2]


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ByteCnn:
    """Learns quality from at most `rows` labelled rows outside fold 0; without any, every score is one half."""
    sample = labelled_sample(documents, labels, "quality", rows)
    return ByteCnn().fit([t for t, _ in sample], [y for _, y in sample])


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS) -> DataFrame:
    """documents (doc_id, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted for every row.

    held_out: the row's fold was not learned from. Null texts count as empty and get a score like any other; repeated
    rows stay repeated; other columns are ignored; empty tables give an empty result or an untrained score."""
    model = train(documents, labels, rows)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # the same size whatever the data

    def make():
        tables = shared.value.tables()

        def one(batch):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            p = shared.value.scores(raw, tables)
            return {"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= threshold).astype(np.int32)}

        return one

    scored = map_texts(documents.select("doc_id", "text"), make, f"doc_id {dict(documents.dtypes)['doc_id']}, score double, predicted int")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS) -> DataFrame:
    """documents without the rows that score_quality predicts as 0, with all their columns; no row is moved."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, rows))

    def make():
        tables = shared.value.tables()

        def one(batch):
            good = shared.value.scores([(t or "").encode() for t in batch.column("text").to_pylist()], tables) >= threshold
            kept = batch.filter(pa.array(good))
            return dict(zip(kept.schema.names, kept.columns, strict=True))

        return one

    return map_texts(documents, make, ", ".join(f"`{c}` {t}" for c, t in documents.dtypes))
