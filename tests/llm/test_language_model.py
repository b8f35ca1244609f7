import math
import zlib
from collections import Counter

import numpy as np

from tesserae.llm import language_model as m


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + [None]


def plain(rows):
    """Counts, weights and scores by dictionaries."""
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two = Counter(), Counter()
    for t in train:
        one.update(t)
        two.update(zip([None, *t[:-1]], t, strict=True))
    n, v = sum(one.values()), len(one)
    q = lambda x: round(m.FINE * math.log2(x)) if x > 0 else m.NONE
    bucket = lambda c: math.floor(math.log2(c)) if c > 0 else -1
    cells = Counter()
    for (a, b), k in two.items():
        cells[bucket(one[a] - 1), q((two[a, b] - 1) / max(one[a] - 1, 1)), q(one[b] - 1)] += k
    weights = m.learn_weights([(*c, k) for c, k in cells.items()], n, v)
    out = {}
    for i, t in rows:
        ts = tokens(t)
        base = sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)
        s = 0.0
        for a, b in zip([None, *ts[:-1]], ts, strict=True):
            w = weights[max([k for k in weights if k <= bucket(one[a])], default=min(weights))]
            s += math.log10(w[0] * two[a, b] / max(1, one[a]) + w[1] * one[b] / n + w[2] / (v + 1))
        out[i] = (len(ts), sum(one[x] > 0 for x in ts), n, base, s)
    return out


def compare(got, rows):
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert abs(r.base_score - w[3]) < 1e-6 * max(1, abs(w[3])) and abs(r.score - w[4]) < 1e-6 * max(1, abs(w[4])), (r, w)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def test_whole_table_against_dictionaries(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = m.score_texts(docs).collect()
    compare(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than single words


def test_many_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ENTRIES", 500)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    compare(m.score_texts(docs).collect(), rows)


def test_groups_of_blocks_ask_in_several_steps(spark, monkeypatch):
    for name, value in (("BUCKET_ENTRIES", 400), ("CUT_BITS", 2), ("GROUP", 3), ("BLOCK_TOKENS", 500)):
        monkeypatch.setattr(m, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 4000").limit(60).repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    compare(m.score_texts(docs).collect(), rows)


def test_very_long_texts(spark):
    long = " ".join(f"w{i * i % 4099}" for i in range(200_000))
    rows = [(3, long), (4, "w1 w2"), (5, None)]
    compare(m.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_weights_maximise_the_held_out_likelihood():
    rng = np.random.default_rng(6)
    cells = [(3, int(p2), int(p1), int(n)) for p2, p1, n in zip(rng.choice([m.NONE, -24, -8, -2], 60), rng.integers(8, 80, 60), rng.integers(1, 50, 60), strict=True)]
    n, v = 5000, 700
    got = m.learn_weights(cells, n, v, steps=3000)[3]
    p = np.array([[0 if a == m.NONE else 2 ** (a / m.FINE), 2 ** (b / m.FINE) / (n - 1), 1 / (v + 1)] for _, a, b, _ in cells])
    k = np.array([c[3] for c in cells])
    value = lambda w: (k * np.log(p @ w)).sum()
    assert abs(got.sum() - 1) < 1e-9
    for _ in range(300):
        other = np.maximum(got + rng.normal(0, 0.02, 3), 1e-9)
        assert value(other / other.sum()) <= value(got) + 1e-3


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, " \t ", 3), (4, "A b \x1c é É", 4), (5, "a b a b", 5), (5, "a b a b", 5), (None, "b b", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = m.score_texts(df).collect()
    assert len(got) == 7
    assert [r.n_tokens for r in sorted((r for r in got if r.doc_id), key=lambda r: r.doc_id)] == [1, 1, 1, 6, 5, 5]
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    assert m.score_texts(df.limit(0)).count() == 0
    one = m.score_texts(df.filter("doc_id = 5")).first()
    assert one.train_tokens in (0, 10)
