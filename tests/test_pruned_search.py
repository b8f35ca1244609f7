import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import bm25, dense
from tesserae.operators.blocks import BlockIndex
from tesserae.operators.cells import CellIndex

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def topics(spark):
    """Chunks that lie by topic, as pages of a site do."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice([f"t{i // 100}w{j}" for j in range(40)] + [f"all{j}" for j in range(20)], rng.integers(1, 40))) for i in range(2000)]
    return spark.createDataFrame([(f"{i:05d}", t) for i, t in enumerate(texts)] + [("x", "")], "chunk_id string, text string")


@pytest.mark.parametrize(("k", "first", "chunks"), [(10, 4, 64), (3, 1, 16), (500, 2, 64)])
def test_block_maxima_give_the_hits_of_full_scoring(spark, topics, k, first, chunks):
    index = bm25.Bm25Index.build(topics)
    queries = [(1, "t3w1 t3w2 t3w2"), (2, "all1 all2"), (3, "t0w0 all3 nothing"), (4, "none of these"), (5, None), (6, "t7w1")]
    asked = spark.createDataFrame(queries, "query_id int, text string")
    blocks = BlockIndex.of(index, chunks)
    assert rows(blocks.search(asked, k, first)) == rows(index.search(asked, k))


def test_few_postings_are_read_of_topics(spark, topics, tmp_path):
    BlockIndex.of(bm25.Bm25Index.build(topics)).save(str(tmp_path / "b"))
    blocks = BlockIndex.load(spark, str(tmp_path / "b"))
    plan = blocks.plan(spark.createDataFrame([(1, "t3w1 all1 all2 all3")], "query_id int, text string"), 5)
    read, total = plan.agg(F.sum(F.when(F.col("read"), F.col("n"))), F.sum("n")).first()
    assert read < 0.5 * total  # of the postings of the query's terms


def test_block_maxima_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    index, asked = bm25.Bm25Index.build(docs), docs.filter("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "query_id")
    assert rows(BlockIndex.of(index, 8).search(asked, 10)) == rows(index.search(asked, 10))


@pytest.mark.parametrize(("k", "per_cell"), [(5, 20), (40, 20), (3, 5000)])
def test_cells_give_the_hits_of_a_search_of_all_vectors(spark, tmp_path, k, per_cell):
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 5, (30, 8))
    x = (middle[rng.integers(0, 30, 1500)] + rng.normal(0, 0.3, (1500, 8))).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [1.0] * 3), (9002, [None] + [1.0] * 7), (9003, x[0].tolist())]
    df = spark.createDataFrame(data, "chunk_id long, vector array<float>").repartition(4)
    asked = spark.createDataFrame([(i, v) for i, v in data if i % 100 == 0], "query_id long, vector array<float>")
    CellIndex.build(df, per_cell).save(str(tmp_path / "c"))
    got, share = CellIndex.load(spark, str(tmp_path / "c")).search(asked, k)
    assert rows(got) == rows(dense.search(df, asked, k))
    assert share < 0.6 or per_cell > 20 or k > 5


def test_cells_of_the_embeddings_and_of_nothing(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = df.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    assert rows(CellIndex.build(df, 50).search(asked, 10)[0]) == rows(dense.search(df, asked, 10))
    assert CellIndex.build(df.limit(0)).search(asked, 10)[0].count() == 0
    assert CellIndex.build(df).search(asked.limit(0), 10)[0].count() == 0


def test_a_search_in_small_steps_against_all_products(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (3000, 4)).astype(np.float32)  # many ties
    df = spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, vector array<float>").repartition(3)
    asked = df.filter("chunk_id like '%7'").withColumnRenamed("chunk_id", "query_id")
    dot = x.astype(float) @ x.astype(float).T
    want = {(f"{q:04d}", r + 1, f"{c:04d}") for q in range(7, 3000, 10) for r, c in enumerate(np.argsort(-dot[q], kind="stable")[:7])}
    for cells in (900, 10**6):
        assert {(r.query_id, r.rank, r.chunk_id) for r in dense.search(df, asked, 7, cells=cells).collect()} == want


def test_a_task_of_a_search_holds_little(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    df = spark.range(2500).selectExpr("id AS chunk_id", "array(sin(id), cos(id)) AS vector")
    runs, spread = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: (runs.append(run), spread(self, run, schema))[1])
    dense.search(df, df.withColumnRenamed("chunk_id", "query_id"), 10)
    x = np.random.default_rng(6).normal(size=20_000)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.ListArray.from_arrays(np.arange(0, 20_001, 2, dtype=np.int32), x)], ["chunk_id", "vector"])
    tracemalloc.start()
    found = sum(b.num_rows for b in runs[0](iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 25_000 and most < 150e6  # the products of the batch alone are 200 MB


def test_maxima_are_one_row_for_a_range_and_term_and_bound_every_score(spark, topics):
    index = bm25.Bm25Index.build(topics)
    blocks = BlockIndex.of(index, 16)
    assert blocks.blocks.schema.names == ["range", "term", "most", "n"]  # no postings beside those of the chunks
    ranged = blocks.index.chunks.select("chunk_id", "range")
    assert ranged.groupBy("range").count().agg(F.max("count")).first()[0] <= 16
    assert [r.chunk_id for r in ranged.orderBy("range", "chunk_id").collect()] == sorted(r.chunk_id for r in ranged.collect())
    part = F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / index.stats.first().avgdl))
    want = index.postings.join(ranged, "chunk_id").groupBy("range", "term").agg(F.max(part).alias("part"), F.count("*").alias("held"))
    both = want.join(blocks.blocks.groupBy("range", "term").agg(F.max("most").alias("most"), F.sum("n").alias("n")), ["range", "term"], "full_outer")
    assert both.filter("NOT coalesce(held = n AND most >= part AND most < part + 1e-5, false)").count() == 0
