import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.operators import bm25, dense, evaluation, ranking, symbols
from tesserae.operators.retrievers import Retriever


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, score double, rank int")


def test_bm25_against_a_loop(spark, tmp_path):
    texts = ["alpha beta", "beta beta gamma", "alpha", "", "delta.Epsilon beta"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    docs = [Counter(t.lower().replace(".", " ").split()) for t in texts]
    n, avgdl = len(docs), sum(sum(d.values()) for d in docs) / len(docs)
    frequency = Counter(t for d in docs for t in d)
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in frequency.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}

    def score(query, d):
        return sum(idf.get(t, 0) * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * sum(d.values()) / avgdl)) for t in query.split())

    bm25.Bm25Index.build(df).save(str(tmp_path / "index"))
    index = bm25.Bm25Index.load(spark, str(tmp_path / "index"))
    queries = ["beta alpha alpha", "epsilon", "nothing"]
    got = index.search(spark.createDataFrame(list(enumerate(queries)), "query_id int, text string"), 3).collect()
    want = {(q, i): score(t, d) for q, t in enumerate(queries) for i, d in enumerate(docs) if score(t, d) > 0}
    best = {(q, i) for q in range(3) for i in sorted((i for p, i in want if p == q), key=lambda i: (-want[q, i], i))[:3]}
    assert {(r.query_id, r.chunk_id) for r in got} == best
    assert all(abs(r.score - want[r.query_id, r.chunk_id]) < 1e-6 for r in got)


def test_fusion(spark):
    a = hits(spark, [(1, "x", 9.0, 1), (1, "y", 3.0, 2), (1, "z", 6.0, 3)])
    b = hits(spark, [(1, "y", 0.5, 1), (1, "w", 0.5, 2)])
    rrf = {r.chunk_id: r.score for r in ranking.reciprocal_rank_fusion([a, b]).collect()}
    assert rrf["x"] == pytest.approx(1 / 61) and rrf["y"] == pytest.approx(1 / 62 + 1 / 61)
    linear = {r.chunk_id: r.score for r in ranking.linear_fusion(a, b, 0.3).collect()}
    assert linear == pytest.approx({"x": 0.3, "y": 0.35, "z": 0.15, "w": 0.35})
    assert {r.chunk_id: r.score for r in ranking.linear_fusion(a, b, 1.0).collect()}["w"] == 0
    assert ranking.reciprocal_rank_fusion([a.limit(0), b]).count() == 2


def test_dense_search(spark):
    vectors = [(i, [float(i % 3), float(i), 1.0]) for i in range(20)]
    df = spark.createDataFrame(vectors, "chunk_id int, vector array<float>").repartition(3)
    got = dense.search(df, spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, [0.0, -1.0, 0.0])], "query_id int, vector array<float>"), 4).collect()
    assert [r.chunk_id for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [2, 5, 8, 11, 0, 1, 2, 3]
    assert dense.search(df.limit(0), df.withColumnRenamed("chunk_id", "query_id"), 4).count() == 0
    made = dense.encode(spark.createDataFrame([(1, "ab")], "k int, text string"), "k", lambda texts: [[3.0, 4.0] for _ in texts]).first()
    assert list(made.vector) == pytest.approx([0.6, 0.8])


@pytest.fixture
def names(spark):
    entries = [("water", "py:function", None), ("tap.water", "py:function", "tap"), ("well.water", "py:function", "well"), ("rain.water", "py:class", "rain"), ("garden.Hedge", "py:class", "garden"), ("garden.Hedge", "py:data", "zzz")]
    chunks = [(f"symbol:{n}", "symbol", [n]) for n in dict.fromkeys(e[0] for e in entries)] + [("section:x", "section", ["water"])]
    return symbols.candidates(spark.createDataFrame(chunks, "chunk_id string, chunk_type string, symbols array<string>"), spark.createDataFrame(entries, "name string, role string, module string"))


def test_symbols(spark, names):
    asked = spark.createDataFrame([(1, "water"), (2, "garden.Hege"), (3, "nothing.like.it")], "query_id int, text string")
    exact = symbols.exact(asked, symbols.alias_table(names)).orderBy("rank").collect()
    assert [r.fqn for r in exact] == ["rain.water", "water", "tap.water", "well.water"]
    found = symbols.lookup(asked, names).collect()
    assert {(r.query_id, r.used) for r in found} == {(1, "exact"), (2, "fuzzy")}
    assert [r.fqn for r in found if r.query_id == 2] == ["garden.Hedge"]


def test_typos(spark):
    rows = [(1, "garden.Hege", "garden.Hedge"), (1, "garden.Hege", "os.path"), (2, "os.path", "os.path"), (3, "OS.path", "os.path"), (4, "abc", "abd"), (4, "abc", "abe"), (5, "zzzzzz", "abcdef"), (6, "none", None)]
    got = {r.query_id: r.rewritten for r in symbols.rewrite_typos(spark.createDataFrame(rows, "query_id int, text string, symbol string")).collect()}
    assert got == {1: "garden.Hedge", 2: "os.path", 3: "os.path", 4: "abc", 5: "zzzzzz", 6: "none"}


def test_names_within_two_edits(spark):
    rng = random.Random(7)
    names = list({"".join(rng.choices("abC.", k=rng.randint(0, 12))) for _ in range(300)})
    asked = [(i, n[: i % 5] + rng.choice(["", "a", "cb"]) + n[i % 5 + rng.randint(0, 2) :]) for i, n in enumerate(names[:80])]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    got = symbols.near_names(spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame([(n,) for n in names], "symbol string")).collect()
    assert {(r.query_id, r.symbol) for r in got} == {(i, n) for i, t in asked for n in names if distance(t.lower(), n.lower()) <= 2}


def test_expected_symbols_and_urls(spark):
    asked = spark.createDataFrame(
        [(1, ["a", "b"], [], "any", "exact"), (2, ["a", "b"], ["l/p.html#q"], "all", "strip_anchor"), (3, [], ["l/"], "any", "prefix"), (4, [], [], "all", "exact"), (5, [], [], "any", "exact"), (6, ["a"], ["a"], "all", "exact")],
        "query_id int, expected_symbols array<string>, expected_urls array<string>, match_policy string, url_match string",
    )
    found = spark.createDataFrame([(q, k, s, u) for q in range(1, 7) for k, s, u in ((1, ["x"], "k/p.html"), (4, ["c", "b"], "k/p.html"), (6, ["a"], "l/p.html#z"))], "query_id int, rank int, symbols array<string>, canonical_url string")
    ranks = evaluation.item_ranks(asked, found)
    got = {r.query_id: (r.hit_at_5, r.hit_at_10, r.rank) for r in evaluation.per_query(asked, ranks, F.col("match_policy")).collect()}
    assert got == {1: (True, True, 4), 2: (False, True, 6), 3: (False, True, 6), 4: (True, True, None), 5: (False, False, None), 6: (False, False, None)}
    assert sorted((r.query_id, r.rank) for r in evaluation.symbol_hits(asked, found).collect()) == [(1, 4), (1, 6), (2, 4), (2, 6), (6, 6)]


def test_citations_to_chunks(spark):
    answers = spark.createDataFrame([(1, "So [2], and [1, 9] [2]. "), (2, "[INSUFFICIENT-CONTEXT] [1]"), (3, "none [1]")], "query_id int, answer string")
    got = evaluation.cited_chunks(answers, hits(spark, [(1, "x", 9.0, 3), (1, "y", 3.0, 7), (2, "z", 1.0, 1)]))
    assert {r.query_id: (r.text, list(r.cited_chunk_ids), r.refused) for r in got.collect()} == {1: ("So [2], and [1, 9] [2].", ["y", "x"], False), 2: ("", [], True), 3: ("none [1]", [], False)}
    marked = evaluation.mark_cited(hits(spark, [(1, "x", 9.0, 3), (1, "w", 3.0, 8), (2, "z", 1.0, 1)]), got)
    assert {(r.query_id, r.chunk_id): r.cited for r in marked.collect()} == {(1, "x"): True, (1, "w"): False, (2, "z"): False}


def test_chunks_feed_the_retrievers(spark):
    from tesserae.operators import chunks

    html = '<section id="s"><h1>Shed</h1><p>Tools of all kinds.</p><dl class="py function"><dt id="shed.spade">spade(depth)</dt><dd>Digs a hole.</dd></dl><dl class="py function"><dt id="shed.rake">rake()</dt><dd>Gathers leaves.</dd></dl></section>'
    inventory = spark.createDataFrame([(f"shed.{n}", "py:function", f"lib/shed.html#shed.{n}", "shed") for n in ("spade", "rake")], "name string, role string, uri string, module string")
    made = chunks.build_chunks(inventory, spark.createDataFrame([("lib/shed.html", html)], "path string, html string"), "3.12").cache()
    index = bm25.Bm25Index.build(made, text=chunks.indexed_text("bm25"))
    asked = spark.createDataFrame([(1, "shed.spade"), (2, "gathers leaves"), (3, "shed.spde"), (4, "tools of")], "query_id int, text string")
    router = Retriever("symbol+bm25", 2, index, found=symbols.candidates(made, inventory))
    first = {r.query_id: r.chunk_id for r in router.search(asked).collect() if r.rank == 1}
    assert first == {1: "symbol:shed.spade", 2: "symbol:shed.rake", 3: "symbol:shed.spade", 4: "section:lib/shed#s"}
    lexical = Retriever("bm25", 3, index, chunks=made, rewrite=True)
    assert {r.query_id: r.text for r in lexical.rewritten(asked).collect()} == {1: "shed.spade", 2: "gathers leaves", 3: "shed.spade", 4: "tools of"}
    assert {r.query_id for r in lexical.search(asked).collect() if r.rank == 1 and r.chunk_id == "symbol:shed.spade"} == {1, 3}


def test_dense_index_is_saved_with_its_encoder(spark, tmp_path):
    texts = spark.createDataFrame([(1, "ab"), (2, "b")], "chunk_id int, text string")
    index = dense.DenseIndex.build(texts, "chunk_id", lambda batch: [[float(len(t)), 1.0] for t in batch], "lengths")
    index.save(str(tmp_path / "i"))
    again = dense.DenseIndex.load(spark, str(tmp_path / "i"), "lengths")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "query_id int, vector array<float>")
    assert [(r.query_id, r.chunk_id) for r in again.search(asked, 1).collect()] == [(1, 1)] and again.dimension == 2
    with pytest.raises(ValueError):
        dense.DenseIndex.load(spark, str(tmp_path / "i"), "other")


def test_common_tiers(spark):
    judged = spark.createDataFrame([("a", "wrong", 1), ("a", "correct", 2), ("b", "wrong", 1), ("c", "wrong", 1)], "query string, tier string, timestamp int")
    human = spark.createDataFrame([("a", "correct"), ("b", "correct"), ("d", "wrong")], "query string, tier string")
    both = evaluation.common_tiers(judged, human)
    assert sorted(map(tuple, both.collect())) == [("a", "correct", "correct"), ("b", "wrong", "correct")]
    assert evaluation.agreement(both, "judge", "human").first().exact_match == 0.5


def test_ranks_by_policy(spark):
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c")], "query_id int, item string")
    found = spark.createDataFrame([(1, "a", 7), (1, "a", 3), (1, "b", 6), (2, "a", 1)], "query_id int, got string, rank int")
    ranks = evaluation.match_ranks(expected, found, lambda j: j["item"] == j["got"])
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    by = lambda p: {r.query_id: (r.hit_at_5, r.hit_at_10, r.rank) for r in evaluation.per_query(queries, ranks, p).collect()}
    assert by("any") == {1: (True, True, 3), 2: (True, True, 1), 3: (False, False, None)}
    assert by("all") == {1: (False, True, 6), 2: (False, False, None), 3: (True, True, None)}


def test_metrics(spark):
    rows = spark.createDataFrame([(1, True, True, 1), (2, True, True, 2), (3, False, False, None)], "query_id int, hit_at_5 boolean, hit_at_10 boolean, rank int")
    r = evaluation.run_metrics(rows).first()
    assert (r.n_queries, r.recall_at_5, r.mrr) == (3, pytest.approx(2 / 3), pytest.approx(0.5))
    assert tuple(evaluation.run_metrics(rows.limit(0)).first()) == (0, 0.0, 0.0, 0.0)


def test_tiers_and_agreement(spark):
    rows = spark.createDataFrame([("correct", "correct"), ("wrong", "correct"), ("wrong", "wrong"), ("refused", "refused")], "tier string, other string")
    assert {r.tier: r.n for r in evaluation.tier_table(rows).collect()} == {"correct": 1, "partial": 0, "wrong": 2, "hallucination": 0, "refused": 1}
    k = evaluation.agreement(rows, "tier", "other").first()
    assert (k.n, k.exact_match, round(k.kappa, 6)) == (4, 0.75, round((0.75 - 5 / 16) / (1 - 5 / 16), 6))
    assert tuple(evaluation.agreement(rows.limit(0), "tier", "other").first()) == (0, 0.0, 0.0)
    assert evaluation.agreement(rows.filter("tier = 'refused'"), "tier", "other").first().kappa == 1.0
    assert tuple(evaluation.confusion(rows.limit(0).selectExpr("true AS p", "true AS a"), "p", "a").first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)


def test_retrievers(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "gamma alpha alpha")] + [(i, f"other{i}") for i in range(4, 10)], "chunk_id int, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5])], "chunk_id int, vector array<float>")
    asked = spark.createDataFrame([(9, "alpha beta", [0.0, 1.0])], "query_id int, text string, vector array<float>")
    index = bm25.Bm25Index.build(docs)
    for name in ("bm25", "dense", "hybrid-rrf", "hybrid-linear"):
        got = Retriever(name, 2, index, vectors).search(asked).collect()
        assert sorted(r.rank for r in got) == list(range(1, len(got) + 1)) and len(got) >= 2
    scored = Retriever("bm25", 1, index, scorer=lambda j: F.length("body").cast("double"), chunks=docs, passage=lambda t: F.concat(t, F.lit(" gamma")))
    assert [r.chunk_id for r in scored.search(asked).collect()] == [3]
    mine = Retriever("own", 1, own=lambda q, k: index.search(q.select("query_id", "text"), 5), classify=lambda t: F.lit("natural_language"))
    assert mine.search(asked).count() == 1
    for bad in ({"name": "x"}, {"name": "own"}, {"name": "bm25", "index": index, "k": 0}, {"name": "bm25", "index": index, "rewrite": True}, {"name": "bm25"}, {"name": "dense"}, {"name": "symbol+bm25", "index": index}, {"name": "bm25", "index": index, "alpha": 2}, {"name": "bm25", "index": index, "scorer": len}):
        with pytest.raises(ValueError):
            Retriever(**bad)


def test_joined_judgments_and_search_rows(spark):
    results = spark.createDataFrame([("a",), ("b",)], "query string")
    judged = spark.createDataFrame([("a", "wrong", "1"), ("a", "correct", "2"), ("c", "wrong", "1")], "query string, tier string, timestamp string")
    assert [tuple(r) for r in evaluation.join_judgments(results, judged).collect()] == [("a", "correct")]
    chunks = spark.createDataFrame([("x", "T", "b" * 30, "l/x.html")], "chunk_id string, title string, text string, canonical_url string")
    rows = evaluation.search_rows(hits(spark, [(1, "gone", 2.0, 1), (1, "x", 1.0, 2)]), chunks, "3.12", 10).collect()
    assert [(r.rank, r.url, r.body) for r in rows] == [(2, "https://docs.python.org/3.12/l/x.html", "b" * 9 + "…")]
