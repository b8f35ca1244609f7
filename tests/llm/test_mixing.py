import re
from collections import Counter

from pyspark.sql import functions as F

from tesserae.llm import mixing as m

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """sizes: source -> words; the weights' excess shared again until none is above twice its words."""
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows, got):
    sizes, taken, target = Counter(), Counter(), {}
    source = {i: s for i, s, _ in rows}
    for i, s, t in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[s]
        assert (r.first_shard is None) == (r.taken == 0)
    want = targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 0.5


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(m.mix(docs).collect())
    check([(r.doc_id, r.source, r.text) for r in docs.collect()], got)
    assert got == sorted(m.mix(docs.repartition(7)).collect())


def test_small_blocks_and_edge_rows(spark):
    rows = [(i, f"s{i % 4}", " ".join(["w"] * (i * 7 % 50))) for i in range(300)] + [(900, None, "a b c"), (901, "empty", ""), (902, "empty", None), (903, "one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    for block in (1, 5, 64):
        check(rows, m.mix(df, block).collect())
    assert m.mix(df.limit(0)).count() == 0
    assert {(r.target, r.taken) for r in m.mix(df.filter("source = 'empty'")).collect()} == {(0.0, 0)}


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (1, "a", "z w"), (None, "a", "q"), (None, None, "q r")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = m.mix(df, 2).collect()
    assert len(got) == 5 and sum(r.taken for r in got) <= 2 * 9


def test_other_kinds_of_ids_and_wide_gaps(spark):
    rows = [(i * 10**15 - 5, f"s{i % 2}", " ".join(["w"] * (i % 30))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    check(rows, m.mix(df, 8).collect())
    named = [(f"id {i}", s, t) for i, s, t in rows]
    got = sorted(m.mix(spark.createDataFrame(named, "doc_id string, source string, text string"), 8).collect())
    check(named, got)
    assert got == sorted(m.mix(spark.createDataFrame(named[::-1], "doc_id string, source string, text string"), 8).collect())
    none = spark.createDataFrame([(None, "a", f"t{i} x y") for i in range(500)], "doc_id long, source string, text string")
    assert sum(r.taken for r in m.mix(none, 8).collect()) == 2250


def test_very_long_texts(spark):
    rows = [(1, "a", "w " * 300_000), (2, "b", "x"), (3, "a", None)]
    check(rows, m.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect())


def test_permutations_are_permutations(spark):
    for n in (1, 2, 7, 100):
        keys = m.round_keys(F.lit(3), F.lit(1), F.lit(n))
        rows = spark.range(n).select(m.permute(F.col("id"), F.lit(n), keys).alias("x"), F.col("id")).select("x", "id", m.permute(F.col("x"), F.lit(n), F.reverse(keys)).alias("back")).collect()
        assert sorted(r.x for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_documents_of_the_mix_hold_the_words_taken(spark):
    rows = [(i, f"s{i % 3}", "\n".join(f"w{i}_{k}" for k in range(i * 5 % 23))) for i in range(60)] + [(7, "s1", "twin of seven"), (None, None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("first", F.lit(1))
    taken = {(r.doc_id, r.size): r.taken for r in m.mix(df, 8).collect()}
    made = m.mixed_documents(df, 8)
    assert made.columns == df.columns
    text = {(i, len(WORDS.findall(t))): t for i, _, t in rows}
    seen = {}
    for r in made.collect():
        words = WORDS.findall(r.text)
        size = next(z for (i, z), t in text.items() if i == r.doc_id and set(words) <= set(WORDS.findall(t)))
        seen[r.doc_id, size] = len(words)
        assert r.n_chars == len(r.text) and max(Counter(words).values()) <= 2
        assert len(words) != size or r.text == text[r.doc_id, size]
    assert seen == {k: n for k, n in taken.items() if n}
