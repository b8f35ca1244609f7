import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import common
from tesserae.llm import suffix_dedup as s


def brute(texts, window=200):
    where = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for r in raw:
        for i in range(len(r) - window + 1):
            where[r[i : i + window]] += 1
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - window + 1):
            if where[r[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        gone = np.cumsum(gone)[: len(r)] > 0
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(r) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit("clash"))
    rows = sorted(s.remove_repeats(df, **options).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts)


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(8)
    passage, line = prose(rng, 90), prose(rng, 30)[:150]
    texts = [prose(rng, rng.integers(1, 120)) + (passage[i : 300 + 3 * i] if i % 2 else line) + prose(rng, 40) for i in range(24)]
    texts += [texts[3], texts[3], None, "", "x", passage[:200], passage[:199], "a" * 900, "ab" * 400, "é" * 150, prose(rng, 200) + "\0" * 250 + prose(rng, 10)]
    doc = prose(rng, 300)
    return texts + [doc, doc[:700] + "!" + doc[700:], passage + " and again " + passage]


def test_planted_repeats(spark, planted):
    check(spark, planted)


def test_large_groups_are_split_and_hot_entries_looked_up(spark, planted):
    check(spark, planted, max_group=2, max_bits=1 << 20, shard_bytes=2000, hot=1)


def test_shared_sides():
    assert s.shared_sides(b"abKEYcd", 2, 5, b"xbKEYcz", 2, 5) == (1, 1)
    assert s.shared_sides(b"abKEYcd", 2, 5, b"KEYcd", 0, 3) == (0, 2) and s.shared_sides(b"\0\0K", 2, 3, b"\0\0\0K", 3, 4) == (2, 0)


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(21)
    base = prose(rng, 140)
    texts = [prose(rng, 30)]
    for k in range(60):
        copy = list(base)
        for _ in range(k % 4):
            copy[int(rng.integers(0, len(copy)))] = "XYZ"[int(rng.integers(0, 3))]
        texts.append(("" if k % 3 else prose(rng, 3)) + "".join(copy)[: len(copy) - (k % 5) * 37])
    check(spark, texts, max_group=3, shard_bytes=4000, hot=5)
    check(spark, ["a" * 700, "a" * 650 + "b", "b" + "a" * 650, "ab" * 300, *texts[:12]], max_group=2)


def test_joins_in_place_of_broadcasts(spark, planted, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    check(spark, planted, max_bits=0, hot=1)


def test_nulls_ties_and_other_kinds_of_ids(spark, planted):
    texts = [planted[0], planted[0], planted[3], None, "short", "short"]
    df = spark.createDataFrame([(None if i < 2 else "same", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.remove_repeats(df).collect())
    assert got == sorted(brute(texts))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    check(spark, [r.text for r in docs])


def test_steps_of_long_buffers_agree():
    rng = np.random.default_rng(3)
    data = np.frombuffer((prose(rng, 3000) + "z" * 1000).encode(), np.uint8)
    bounds = np.array([0, 5000, 5100, len(data)])
    a, b = s.anchors(data, bounds), s.anchors(data, bounds, step=1500)
    assert all(np.array_equal(a[c], b[c]) for c in a)


def test_empty_table(spark):
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
