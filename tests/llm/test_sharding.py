from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.llm import sharding as s


def test_every_slot_is_claimed_evenly():
    counts = Counter(s.fill_table([str(i) for i in range(7)], 101))
    assert sum(counts.values()) == 101 and max(counts.values()) - min(counts.values()) <= 1


def test_removing_a_shard_moves_few_other_keys():
    names = [f"n{i}" for i in range(20)]
    a, b = s.fill_table(names, 2003), s.fill_table(names[:-1], 2003)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 19)
    assert moved < 0.1 * 2003


@pytest.mark.parametrize(("names", "size"), [(["a"], 100), ([], 7), (["a", "a"], 7), (["a", "b", "c"], 2), (["a"], (1 << 20) + 7)])
def test_bad_parameters(names, size):
    with pytest.raises(ValueError):
        s.fill_table(names, size)


def test_rows_and_plan(spark):
    rows = [(1, "a", 9), (1, "a", 9), (None, "b", 9), (3, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = s.assign_shards(df, n_shards=5, table_size=53)
    assert got.columns == ["doc_id", "text", "slot", "shard"] and got.count() == 4
    placed = {r.doc_id: (r.slot, r.shard) for r in got.collect()}
    table = s.fill_table([str(i) for i in range(5)], 53)
    assert all(table[a] == b for a, b in placed.values())
    assert s.assign_shards(df, F.lit(""), n_shards=5, table_size=53).first().slot == placed[None][0]
    assert s.assign_shards(df.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "hashpartitioning" not in plan


def test_shards_are_written_by_folder(spark, tmp_path):
    df = s.assign_shards(spark.range(200).withColumnRenamed("id", "doc_id"), n_shards=3, table_size=31)
    s.write_shards(df, str(tmp_path / "out"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "shard").collect())) == sorted(map(tuple, df.select("doc_id", "shard").collect()))
