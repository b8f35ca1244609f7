import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import importance as m

TEXTS = ["", None, "One two  TWO", "\x00a\x00b", "naïve Ünits 42x", "x " * 3000, "the cat", "the cat", "?!", " ".join(f"w{i}" for i in range(400))]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[0-9a-z\x80-\U0010ffff]+", low)


def grams_of(text, order):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def bucket(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


def plain(docs, target, order, buckets, seed, percent, least):
    s = Counter(bucket(g, buckets) for _, t in docs for g in grams_of(t, order))
    t = Counter(bucket(g, buckets) for x in target for g in grams_of(x, order))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        g = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in (bucket(x, buckets) for x in grams_of(text, order))]
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        out.append([doc_id, len(words_of(text)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0], r[1]))
    drawn = {id(r): k + 1 for k, r in enumerate(may[: percent * len(may) // 100])}
    return [(*r, drawn.get(id(r))) for r in out]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_grams_do_not_cross_texts(order):
    n_words, found, whose = m.grams(TEXTS, order, 997)
    for i, text in enumerate(TEXTS):
        assert n_words[i] == len(words_of(text))
        assert Counter(found[whose == i].tolist()) == Counter(bucket(g, 997) for g in grams_of(text, order))
    assert [len(x) for x in m.grams([], order)] == [0, 0, 0]


@pytest.mark.parametrize(("order", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (2, 64, 35, 1), (1, 1, 100, 0)])
def test_matches_a_plain_version(spark, order, buckets, percent, least):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ü9"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(300)]
    docs += [(7, docs[7][1]), (7, "again"), (None, None), (None, docs[3][1]), *((1000 + i, t) for i, t in enumerate(TEXTS))]
    target = ["w1 w2 w3 w3", None, " ".join(rng.choice(vocabulary[:9], 200))]
    df = spark.createDataFrame([(*d, "x", -1) for d in docs], "doc_id long, text string, score string, rank int").repartition(5)
    got = m.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), order, buckets, 5, percent, least)
    want = plain(docs, target, order, buckets, 5, percent, least)
    key = lambda r: tuple(-(10**9) if x is None else x for x in r)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=key) == sorted(want, key=key)


def test_many_ties_are_ranked_by_id(spark):
    scored = m.materialize(spark.range(5000).selectExpr("id AS doc_id", "30L AS n_words", "id % 3 AS score"), "t")
    got = {r.doc_id: r.rank for r in m.draw(scored, 50).collect()}
    order = sorted(range(5000), key=lambda i: (-(i % 3), i))
    assert got == {i: k + 1 if k < 2500 else None for k, i in enumerate(order)}


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert m.resample(none, some).count() == 0
    assert m.resample(some, none, percent=100).collect()[0]["rank"] == 1
    assert set(m.gains(np.zeros(9), np.zeros(9))) == {0}
    with pytest.raises(ValueError):
        m.Target.fit(some, none, buckets=0)


def test_documents_near_the_target_are_drawn(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(["red", "green", "blue"] if i % 10 else ["iron", "steel", "zinc"], 40))) for i in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    drawn = m.resampled_documents(df, spark.createDataFrame([("iron steel zinc " * 50,)], "text string"), percent=10)
    assert drawn.columns == ["doc_id", "text"] and drawn.count() == 100 and drawn.filter("doc_id % 10 = 0").count() > 80
