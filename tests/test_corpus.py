import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.operators import bpe, chunks, corpus
from tesserae.streaming import windows


def packed(text, limit, separator):
    out = []
    for p in (x for x in text.split(separator) if x.strip()):
        if out and len(out[-1]) + len(p) + len(separator) <= limit:
            out[-1] += separator + p
        else:
            out.append(p)
    return out


def train_naive(words: dict[str, int], merges: int) -> list[tuple[str, str]]:
    """The merges by counting all pairs before every one."""
    split, out = {w: list(w) for w in words}, []
    for _ in range(merges):
        pairs: Counter = Counter()
        for w, s in split.items():
            for p in zip(s, s[1:], strict=False):
                pairs[p] += words[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append(best)
        split = {w: bpe.merge(s, *best) for w, s in split.items()}
    return out


def held(words, merges):
    return bpe.train_held(list(words), np.array(list(words.values()), np.int64), merges)


def test_paragraphs(spark):
    rng = random.Random(1)
    texts = ["", "one", "a" * 50] + ["\n\n".join("x" * rng.randint(1, 30) for _ in range(20)) for _ in range(5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [list(r.p) for r in df.select("i", chunks.pack_paragraphs(F.col("t"), 40).alias("p")).orderBy("i").collect()]
    assert got == [packed(t, 40, "\n\n") for t in texts]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    for r in docs.select("text", chunks.pack_paragraphs(F.col("text"), separator="\n").alias("p")).collect():
        assert list(r.p) == packed(r.text, 1500, "\n")


HTML = """<title>t</title><nav>menu</nav><p>outside</p><section id="m"><h1>Top &amp; more<a class="headerlink" href="#m">¶</a></h1><p>Intro<br>line.</p><script>x()</script><nav>inner</nav>
<dl class="py class"><dt id="garden.Rose">class <em>Rose</em>(*petals)<a class="headerlink">¶</a></dt><dd><p>A rose.</p><dl class="py method"><dt id="garden.Rose.open">open()</dt><dd>Opens.</dd></dl></dd></dl>
<section><h2>How to plant?</h2><p>Dig.</section><section><h3>How to  plant!</h3><p>Again.</p></section><section><p>no heading</p></section><section id="none"><h2>Empty</h2></section>
<section id="long"><h2>Long</h2><pre>{long}</pre></section></section>""".replace("{long}", "\n\n".join("x" * 400 for _ in range(6)))


def test_chunks_of_an_inventory_and_pages(spark):
    entries = [("garden.Rose", "py:class", "lib/garden.html#garden.Rose", "garden"), ("garden.Rose.open", "py:method", "lib/garden.html#garden.Rose.open", "garden"), ("garden.gone", "py:data", "lib/garden.html", "garden"), ("garden.Rose", "py:attribute", "lib/other.html#x", "garden"), ("lost", "py:data", "lib/lost.html#lost", None)]
    inventory = spark.createDataFrame(entries, "name string, role string, uri string, module string")
    pages = spark.createDataFrame([("lib/garden.html", HTML), ("lib/plain.html", HTML), ("lib/null.html", None)], "path string, html string")
    made = chunks.build_chunks(inventory, pages, "3.12")
    rows = {r.chunk_id: r for r in made.collect()}
    assert len(rows) == made.count() and {r.source_path for r in rows.values()} == {"lib/garden.html"}
    rose = rows["symbol:garden.Rose"]
    assert rose.text == "class Rose (*petals)\n\nA rose. open() Opens." and (rose.title, rose.anchor, list(rose.symbols), rose.parent_module) == ("Rose", "garden.Rose", ["garden.Rose"], "garden")
    assert rows["symbol:garden.Rose.open"].text == "open()\n\nOpens." and rows["symbol:garden.gone"].text == "\n\n" and rows["symbol:garden.gone"].anchor is None
    top = rows["section:lib/garden#m"]
    assert top.text == "Intro\nline.\ninner" and top.title == "Top & more" and top.canonical_url == "lib/garden.html#m" and top.parent_module is None
    assert rows["section:lib/garden#how-to-plant"].text == "Dig." and rows["section:lib/garden#how-to-plant~2"].text == "Again."
    long = ["x" * 400] * 6
    assert [rows[f"section:lib/garden#long-{i}"].text for i in range(2)] == ["\n\n".join(long[:3]), "\n\n".join(long[3:])]
    assert len(rows) == 3 + 3 + 2 and top.source_hash == "sha256:" + hashlib.sha256(HTML.encode()).hexdigest()
    assert [r.path for r in chunks.missing_pages(inventory, pages).collect()] == ["lib/lost.html"]
    assert chunks.section_chunks(pages, "3.12").count() == 2 * 5
    assert chunks.build_chunks(inventory.limit(0), pages, "3.12").count() == 0


def test_pieces_of_long_texts():
    assert chunks.packed("a\n\nb") == ["a\n\nb"] and chunks.packed("", 1) == []
    assert chunks.packed("aa\n\nbb\n\ncccccc\n\nd", 6) == ["aa\n\nbb", "cccccc", "d"]


def test_grounded_prompts(spark):
    asked = spark.createDataFrame([(1, "what?", "natural_language"), (2, "alone", None)], "query_id int, text string, query_type string")
    hits = spark.createDataFrame([(1, 4, "B", "second"), (1, 2, "A", "first")], "query_id int, rank int, title string, text string")
    got = {r.query_id: (r.system, r.user) for r in chunks.grounded_prompts(asked, hits, "be brief").collect()}
    assert got[2] == ("be brief", "QUESTION: alone")
    assert got[1][1].endswith("CONTEXT:\n[1] A\nfirst\n---\n[2] B\nsecond\n\nQUESTION: what?") and got[1][1].startswith("Use this answer structure: definition")


def test_budgets_and_tiles(spark):
    df = spark.createDataFrame([(i, "x" * (i % 7 + 1)) for i in range(500)] + [(600, " ")], "k long, text string")
    total, want = 0, []
    for i in range(500):
        if total < 777:
            want.append(i)
        total += i % 7 + 1
    assert sorted(r.k for r in corpus.byte_budget(df, "k", 777).collect()) == want
    tiled = corpus.tiled(df, "k", 5 * total // 2).agg(F.sum("bytes").alias("b"), F.max("tile").alias("t")).first()
    assert tiled.t == 2 and 5 * total // 2 <= tiled.b < 5 * total // 2 + 7
    drawn = corpus.bernoulli_bytes(df, "k", total // 4, "s")
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, corpus.bernoulli_bytes(df.repartition(5), "k", total // 4, "s").collect()))
    assert 0 < drawn.count() < 250


def test_packing(spark):
    rng = random.Random(2)
    docs = [(i, [rng.randrange(100) for _ in range(rng.choice((0, 1, 5, 40)))]) for i in range(60)]
    flat = [t for _, d in docs for t in d]
    rows = corpus.shifted(corpus.pack(spark.createDataFrame(docs, "k long, tokens array<int>").repartition(4), "k", 17)).orderBy("segment").collect()
    assert [list(r.tokens) for r in rows] == [flat[i : i + 17] for i in range(0, len(flat) - 16, 17)]
    assert all(r.inputs == r.tokens[:-1] and r.targets == r.tokens[1:] for r in rows)


def test_training_records(spark):
    rows = [(1, [1, 2, 3], [4, 5]), (2, [1, 2, 3, 4], [5, 6]), (3, [1, 2], [3, 4, 5, 6, 7]), (4, [9], [1, 2, 3, 4, 5, 6])]
    df = spark.createDataFrame(rows, "k int, p array<int>, a array<int>").withColumn("b", F.lit(0))
    made = {r.k: r for r in corpus.training_records(df, "p", "a", 5).collect()}
    assert {k: (list(r.input_ids), list(r.labels), r.prompt_len) for k, r in made.items()} == {1: ([1, 2, 3, 4, 5], [-100] * 3 + [4, 5], 3), 2: ([2, 3, 4, 5, 6], [-100] * 3 + [5, 6], 3), 3: ([3, 4, 5, 6, 7], [3, 4, 5, 6, 7], 0)}
    padded = corpus.pad(corpus.training_records(df, "p", "a", 6), "b").collect()
    assert {len(r.input_ids) for r in padded} == {6} == {len(r.labels) for r in padded}


def test_merges():
    assert bpe.merge(list("aaaaa"), "a", "a") == ["aa", "aa", "a"] and bpe.merge(list("abcab"), "a", "b") == ["ab", "c", "ab"] and bpe.merge([], "a", "b") == []


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("abcé\U0001f600", max_size=9), st.integers(1, 5), max_size=25), st.integers(0, 40))
def test_array_trainer_makes_the_merges_of_plain_counting(words, merges):
    assert held(words, merges) == train_naive(words, merges)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("ab'", min_size=1, max_size=9), st.integers(1, 5), min_size=1, max_size=12), st.text("ab'x", max_size=14))
def test_words_are_encoded_by_the_merges_in_order(words, word):
    merges = train_naive(words, 25)
    made = bpe.Tokenizer(list("ab'"), merges)
    s = list(word)
    for pair in merges:
        s = bpe.merge(s, *pair)
    assert made.word(word) == [made.ids.get(x, made.ids["<unk>"]) for x in s]


def test_bpe_training_here_and_on_tables(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 8))): rng.randint(1, 9) for _ in range(80)} | {"don't": 5, "d'd'd'": 4}
    want = train_naive(words, 30)
    table = spark.createDataFrame(list(words.items()), "token string, n long")
    assert held(words, 30) == want == bpe.train(table, 30) == bpe.train(table, 30, most_held=0)
    assert held({}, 3) == [] == bpe.train(table.limit(0), 3, most_held=-1)


def test_bpe(spark, tmp_path):
    docs = spark.createDataFrame([(1, "low lower lowest"), (2, "new newer, low"), (3, "é"), (4, None), (5, " ")], "k long, text string")
    tokenizer = bpe.fit(docs.filter("k < 3"), 20)
    got = {r.k: list(r.tokens) for r in bpe.encode(docs, "k", tokenizer).collect()}
    assert got[3] == [tokenizer.ids["<unk>"]] and got[4] == got[5] == []
    marked = bpe.encode(docs, "k", tokenizer, begin=True, end=True)
    assert {r.k: list(r.tokens) for r in marked.collect()} == {k: [tokenizer.ids["<bos>"], *t, tokenizer.ids["<eos>"]] for k, t in got.items()}
    assert {r.k: r.text for r in bpe.decode(marked, tokenizer).filter("k < 3").collect()} == {1: "low lower lowest", 2: "new newer , low"}
    vocabulary, merges = tokenizer.tables(spark)
    assert vocabulary.count() == len(tokenizer.tokens) and merges.count() == len(tokenizer.rank)
    tokenizer.save(spark, str(tmp_path / "t"))
    again = bpe.Tokenizer.load(spark, str(tmp_path / "t"))
    assert again.tokens == tokenizer.tokens and again.rank == tokenizer.rank


def test_segments_are_read_as_they_were_written(spark, tmp_path):
    made = corpus.pack(spark.createDataFrame([(1, list(range(10)))], "k long, tokens array<int>"), "k", 4)
    corpus.write_segments(made, str(tmp_path / "s"), 4, 10)
    assert corpus.read_segments(spark, str(tmp_path / "s"), 4, 10).count() == 2
    with pytest.raises(ValueError):
        corpus.read_segments(spark, str(tmp_path / "s"), 5, 10)


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windows.windowed_metrics(stream, "1 hour", watermark="1 hour").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(str, spark.table("hours").withColumn("total", F.round("total", 6)).collect()))
    assert got == sorted(map(str, windows.windowed_metrics(events, "1 hour").withColumn("total", F.round("total", 6)).collect()))
    assert windows.sessions(events, "30 minutes").agg(F.sum("n")).first()[0] == events.count()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    docs.write.parquet(str(tmp_path / "docs"))
    new = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    windows.refresh_postings(new, str(tmp_path / "postings"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "postings")).select("chunk_id").distinct().count() == docs.count()
