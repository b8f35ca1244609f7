import random

from pyspark.sql import functions as F

from tesserae.operators import corpus
from tesserae.sources.catalogue import FileCatalogue


def write(spark, path, rows, files):
    size = -(-len(rows) // files)
    for k in range(files):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], "k long, text string").coalesce(1)
        part.write.mode("append").parquet(f"{path}/part={k:02d}")


def opened(df):
    """The files of the table that a plan reads."""
    return [f for f in df.inputFiles() if "/part=" in f]


def rows_of(n=400):
    rng = random.Random(1)
    return [(i * 3, rng.choice([None, "", " \t", "word " * rng.randint(1, 9), "é"])) for i in range(n)]


def test_same_rows_as_the_byte_budget_from_fewer_files(spark, tmp_path):
    rows = rows_of()
    write(spark, str(tmp_path / "t"), rows, 10)
    scan = spark.read.parquet(str(tmp_path / "t"))
    made = FileCatalogue.of(scan)
    total = made.files.agg(F.sum("bytes")).first()[0]
    assert total == sum(len(t.encode()) for _, t in rows if t and t.strip())
    made.save(str(tmp_path / "c"))
    saved = FileCatalogue.load(spark, str(tmp_path / "c"))
    for target in (0, 1, total // 10, total // 3, total - 1, total, 10 * total):
        got = saved.budget(target)
        want = corpus.byte_budget(scan.select("k", "text"), "k", target)
        assert sorted(r.k for r in got.collect()) == sorted(r.k for r in want.collect())
        assert got.columns == scan.columns
    assert len(opened(saved.budget(total // 3))) <= 5 < len(scan.inputFiles())


def test_bounds_between_files_open_no_file_more(spark, tmp_path):
    write(spark, str(tmp_path / "t"), [(i, "abcd") for i in range(100)], 10)
    made = FileCatalogue.of(spark.read.parquet(str(tmp_path / "t")))
    assert [(len(opened(made.budget(n))), made.budget(n).count()) for n in (40, 41, 44, 45, 80)] == [(1, 10), (2, 11), (2, 11), (2, 12), (2, 20)]


def test_only_new_files_are_read_again(spark, tmp_path):
    write(spark, str(tmp_path / "t"), rows_of(60), 3)
    first = FileCatalogue.of(spark.read.parquet(str(tmp_path / "t")))
    wrong = FileCatalogue(first.files.withColumn("bytes", F.lit(7).cast("bigint")), first.schema)  # would be seen if it were read again
    spark.createDataFrame([(1000, "more")], "k long, text string").coalesce(1).write.parquet(str(tmp_path / "t/part=99"))
    again = FileCatalogue.of(spark.read.parquet(str(tmp_path / "t")), known=wrong)
    assert sorted(r.bytes for r in again.files.collect()) == [4, 7, 7, 7]
    gone = FileCatalogue.of(spark.read.parquet(str(tmp_path / "t/part=99")), known=again)
    assert [r.bytes for r in gone.files.collect()] == [4]


def test_sparse_and_clustered_keys(spark):
    rng = random.Random(2)
    keys = sorted({rng.randrange(-(2**63), 2**63) for _ in range(500)} | set(range(1000)))
    df = spark.createDataFrame([(k, i % 7) for i, k in enumerate(keys)], "k long, v int").repartition(5)
    got = {r.k: r.before for r in corpus.running_before(df, "k", F.col("v")).collect()}
    total, want = 0, {}
    for i, k in enumerate(keys):
        want[k] = total
        total += i % 7
    assert got == want
    names = spark.createDataFrame([("b", 2), ("a", 1), ("c", None)], "k string, v int")
    assert {r.k: r.before for r in corpus.running_before(names, "k", F.col("v")).collect()} == {"a": 0, "b": 1, "c": 3}
