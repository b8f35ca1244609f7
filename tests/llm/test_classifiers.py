import math
import random
import zlib

import numpy as np
import pytest

from tesserae.llm import labelled
from tesserae.llm import quality_cnn as q
from tesserae.llm import toxicity_crf as c

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(scored, labels, label):
    rows = scored.join(labels, "doc_id").filter("held_out").select("predicted", label).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def test_quality_on_held_out_documents(tables):
    docs, labels = tables
    scored = q.score_quality(docs, labels)
    p, y = held_out(scored, labels, "quality")
    assert len(y) > 500 and (p == y).mean() > 0.97 and (p[y == 1] == 1).mean() > 0.99
    assert scored.count() == docs.count()


def test_toxicity_on_held_out_documents(tables):
    docs, labels = tables
    p, y = held_out(c.score_toxicity(docs, labels), labels, "toxic")
    assert (p == y).mean() > 0.96 and (p[y == 1] == 1).mean() > 0.8 and (p[y == 0] == 0).mean() > 0.97


def test_convolution_covers_the_whole_document():
    net = q.ByteCnn()
    text = bytes(random.Random(1).choices(range(32, 127), k=5001))
    scores = net.scores([text, b"", b"x", text[:777]], net.tables())
    for t, s in zip((text, b"", b"x", text[:777]), scores, strict=True):
        padded = t + b"\0" * (q.WINDOW + len(t) % q.STRIDE)
        answers = [sum(net.p["filters"][k][padded[i + k]] for k in range(q.WINDOW)) for i in range(0, max(len(t), 1), q.STRIDE)]
        assert abs(net.head(np.max(answers, axis=0)[None])[2][0] - s) < 1e-4


def test_long_texts_are_learned_from_in_steps():
    rng = random.Random(2)
    raw, y = [bytes(rng.choices(range(97, 123), k=n)) for n in (900, 3, 40, 700)], np.array([1.0, 0, 1, 0])
    net = q.ByteCnn()
    for k, g in net._gradients(raw, y).items():
        assert np.allclose(g, net._gradients(raw, y, step=64)[k])


def test_gradients_against_differences():
    rng = random.Random(4)
    raw, y = [bytes(rng.choices(range(97, 123), k=n)) for n in (60, 31, 45)], np.array([1.0, 0, 1])
    net = q.ByteCnn()

    def loss():
        data, starts, first = q.lay_out(raw)
        ends = np.append(first[1:], len(starts))
        answers = sum(net.p["filters"][k][data[starts + k]] for k in range(q.WINDOW))
        p = net.head(np.stack([answers[a:b].max(axis=0) for a, b in zip(first, ends, strict=True)]))[2]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = net._gradients(raw, y)
    for name, at in (("out", (2,)), ("mix", (3, 1)), ("shift", (5,)), ("mix0", (0,)), ("out0", (0,)), ("filters", np.unravel_index(np.abs(grads["filters"]).argmax(), grads["filters"].shape))):
        values, losses = net.p[name][at], []
        for h in (1e-5, -1e-5):
            net.p[name][at] = values + h
            losses.append(loss())
        net.p[name][at] = values
        assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][at]) < 1e-4


def test_the_sample_is_bounded_by_bytes_not_by_length(spark):
    rows = [(i, "x" * (10 if i % 2 else 3000), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1)], "doc_id long, quality int")
    every = labelled.labelled_sample(docs, labels, "quality")
    assert len(every) == len([i for i in range(200) if zlib.crc32(str(i).encode()) % 5])
    some = labelled.labelled_sample(docs, labels, "quality", most_bytes=60_000)
    assert some == every[: len(some)] and 60_000 <= sum(len(t) for t, _ in some) < 63_001 and max(len(t) for t, _ in some) == 3000


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    chain = c.Chain(np.arange(5, dtype=np.uint64))
    chain.weight = rng.normal(0, 2, 6)
    chain.theta = rng.normal(0, 1, 5)
    bias, t01, t10, t11, start = chain.theta
    ids = rng.integers(0, 6, 11)
    opens = np.zeros(11, bool)
    opens[[0, 4, 5]] = True
    got = chain.marginals(ids, opens)
    trans = {(0, 0): 0, (0, 1): t01, (1, 0): t10, (1, 1): t11}
    for a, b in ((0, 4), (4, 5), (5, 11)):
        mass, hot = 0.0, np.zeros(b - a)
        for code in range(1 << (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            e = math.exp(sum((chain.weight[ids[a + k]] + bias) * y[k] for k in range(b - a)) + start * y[0] + sum(trans[p] for p in zip(y, y[1:], strict=False)))
            mass += e
            hot += np.array(y) * e
        assert np.allclose(got[a:b], hot / mass)


def test_scan_over_many_blocks():
    rng = np.random.default_rng(4)
    a, b, cc, d = rng.random((4, 1000)) + 0.1
    x, want = 1.0, []
    for i in range(1000):
        x = (a[i] + b[i] * x) / (cc[i] + d[i] * x)
        want.append(x)
    assert np.allclose(c.scan(a, b, cc, d, block=64), want)


def test_chain_gradients_against_differences():
    """Fitting raises the labels' likelihood, whose slope along the words' weights is labels minus marginals."""
    rng = np.random.default_rng(8)
    chain = c.Chain(np.arange(4, dtype=np.uint64))
    chain.weight, chain.theta = rng.normal(0, 1, 5), rng.normal(0, 1, 5)
    ids, opens, y = rng.integers(0, 5, 9), np.zeros(9, bool), rng.integers(0, 2, 9).astype(float)
    opens[[0, 5]] = True

    def likelihood():
        bias, t01, t10, t11, start = chain.theta
        trans, total = {(0, 0): 0, (0, 1): t01, (1, 0): t10, (1, 1): t11}, 0.0
        for a, b in ((0, 5), (5, 9)):
            score = lambda s: sum((chain.weight[ids[a + k]] + bias) * s[k] for k in range(b - a)) + start * s[0] + sum(trans[q_] for q_ in zip(s, s[1:], strict=False))  # noqa: B023, E731
            every = [score([code >> k & 1 for k in range(b - a)]) for code in range(1 << (b - a))]
            total += score(y[a:b].astype(int).tolist()) - np.log(np.exp(every).sum())
        return total

    slope = np.bincount(ids, y, 5) - np.bincount(ids, chain.marginals(ids, opens), 5)
    for k in range(4):
        value, found = chain.weight[k], []
        for h in (1e-5, -1e-5):
            chain.weight[k] = value + h
            found.append(likelihood())
        chain.weight[k] = value
        assert abs((found[0] - found[1]) / 2e-5 - slope[k]) < 1e-4
    before = likelihood()
    chain.fit(ids, opens, y)
    assert likelihood() > before


def test_spans_of_very_long_texts(spark):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        w = rng.choices(["sun", "moon", "sea", "été"], k=12)
        if i % 3 == 0:
            w[2:2], w[8:8] = ["Zédiot"], ["Zédiot"]
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    text = "été moon sea Zédiot sun " * 40_000
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(999, text)], "doc_id long, text string")
    r = c.score_toxicity(docs, labels).filter("doc_id = 999").first()
    assert len(r.spans) == 40_000 and all(text[s.start : s.stop] == s.text == "Zédiot" for s in r.spans[::997])


def test_spans_and_edge_rows(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    rows = []
    for i in range(400):
        w = rng.choices(vocab, k=30)
        if i % 4 == 0:
            w[5:5] = ["Zédiot!", "vclown"]
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(900, "", 1.0), (901, None, 1.0), (None, "a Zédiot! here", 1.0), (7, rows[7][1], 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, None)], "doc_id long, toxic int, quality int")
    got = c.score_toxicity(df, labels).collect()
    assert len(got) == 404
    text = dict((i, t) for i, t, _ in rows) | {None: "a Zédiot! here"}
    for r in got:
        assert 0 <= r.score <= 1 and all(text[r.doc_id][s.start : s.stop] == s.text for s in r.spans)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == int(r.doc_id % 4 == 0) and bool(r.spans) == (r.doc_id % 4 == 0)
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert {r.held_out for r in got} == {True, False}
    assert c.score_toxicity(df.limit(0), labels).count() == 0
    assert q.score_quality(df.limit(0), labels).count() == 0
    assert {r.score for r in c.score_toxicity(df.limit(3), labels.limit(0)).collect()} == {0.5}
    assert all(0 <= r.score <= 1 for r in q.score_quality(df, labels.limit(0)).collect())
    kept = q.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == 404


def test_without_labels_no_text_is_rejected(spark):
    df = spark.createDataFrame([(1, "some text"), (2, "junk $$$"), (3, ""), (4, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in q.score_quality(df, none).collect()} == {0.5}
    assert q.keep_good(df, none).count() == 4
