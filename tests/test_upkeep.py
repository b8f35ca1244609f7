import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import bm25
from tesserae.streaming.upkeep import IndexGenerations, keep_up

SCHEMA = "chunk_id string, text string"


def facts(index):
    """All that an index holds, as plain values."""
    stats = index.stats.first()
    return (
        sorted(map(tuple, index.postings.select("chunk_id", "term", "tf", "dl").collect())),
        sorted((r.term, r.df, round(r.idf, 9)) for r in index.terms.collect()), stats.n, None if stats.avgdl is None else round(stats.avgdl, 9),
    )


def changes(rng, known):
    """A batch of additions, changes and deletions; known: the texts so far, kept up to date."""
    words = [f"w{i}" for i in range(12)]
    out = []
    for i in rng.sample(range(25), 9):
        text = rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 9)))])
        out.append((f"c{i}", text))
        known.pop(f"c{i}", None)
        if text is not None:
            known[f"c{i}"] = text
    return out


def test_equal_to_a_fresh_build_after_every_batch(spark, tmp_path):
    rng, known = random.Random(1), {}
    index = IndexGenerations(spark, str(tmp_path / "i"))
    assert index.compact() is None and index.index().stats.first().n == 0
    for g in range(4):
        batch = spark.createDataFrame(changes(rng, known), SCHEMA)
        assert index.apply(batch, g) and not index.apply(batch.limit(0), g)
        fresh = bm25.Bm25Index.build(spark.createDataFrame(list(known.items()), SCHEMA))
        assert facts(index.index()) == facts(fresh)
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3")], "query_id int, text string")
    want = sorted(map(tuple, fresh.search(asked, 5).collect()))
    assert sorted(map(tuple, index.index().search(asked, 5).select(*fresh.search(asked, 5).columns).collect())) == want
    assert index.compact() == 4 and index.generations() == [4] and facts(index.index()) == facts(fresh)
    assert index.apply(spark.createDataFrame([("c0", None), ("new", "w1")], SCHEMA), 5)
    known.pop("c0", None)
    assert facts(index.index()) == facts(bm25.Bm25Index.build(spark.createDataFrame([*known.items(), ("new", "w1")], SCHEMA)))


def test_an_unfinished_generation_is_not_seen(spark, tmp_path, monkeypatch):
    index = IndexGenerations(spark, str(tmp_path / "i"), "bigint")
    index.apply(spark.createDataFrame([(1, "a b")], "chunk_id long, text string"), 0)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(IndexGenerations, "_finish", fails)
        index.apply(spark.createDataFrame([(1, "c")], "chunk_id long, text string"), 1)
    assert index.generations() == [0] and [r.term for r in index.index().terms.orderBy("term").collect()] == ["a", "b"]
    assert index.apply(spark.createDataFrame([(1, "c")], "chunk_id long, text string"), 1)
    assert [r.term for r in index.index().terms.collect()] == ["c"]


def test_a_stream_of_changes(spark, tmp_path):
    source = str(tmp_path / "changes")
    batches = [[("a", "x y", 1), ("b", "y", 1), ("a", "z", 2)], [("b", None, 3), ("c", "x x", 3)], [("a", "x", 4)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, f"{SCHEMA}, at long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(f"{SCHEMA}, at long").parquet(source)
        keep_up(stream, str(tmp_path / "i"), str(tmp_path / "checkpoint"), order="at").trigger(availableNow=True).start().awaitTermination()
    index = IndexGenerations(spark, str(tmp_path / "i"))
    fresh = bm25.Bm25Index.build(spark.createDataFrame([("a", "x"), ("c", "x x")], SCHEMA))
    assert facts(index.index()) == facts(fresh) and index.live().agg(F.sum("dl")).first()[0] == 3
