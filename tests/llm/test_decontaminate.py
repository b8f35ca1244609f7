import random
import re

from tesserae.llm import decontaminate as d


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def align(a, b):
    """Best local alignment score, cell by cell."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
        row = new
        best = max(best, *row)
    return best


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return rng, ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def planted():
    rng, vocab = vocabulary(2)
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(8, 40)))) for i in range(12)] + [(50, "only two"), (51, None), (52, "")]
    docs = []
    for k in range(40):
        body = rng.choices(vocab, k=rng.randint(5, 90))
        if k % 2:
            item = words(items[k % 12][1])
            for _ in range(k % 5):
                p = rng.randrange(len(item))
                item = item[:p] + rng.choice(([], [rng.choice(vocab)], [item[p], "extra"])) + item[p + 1 :]
            body[2:2] = [w.upper() + "," if rng.random() < 0.2 else w for w in item]
        docs.append((k, " ".join(body)))
    return items, docs + [(90, ""), (91, None), (1, docs[1][1]), (None, items[3][1])]


def test_pairs_against_cell_by_cell_alignment(spark):
    items, docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' AS item_id", "1 AS score")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = [(r.doc_id, r.item_id, r.score) for r in d.find_leaks(df, bench).collect()]
    want, seeded = [], set()
    for i, t in docs:
        b = words(t)
        for k, text in items:
            a = words(text)
            if len(a) >= d.N:
                score = align(a, b)
                if score >= d.MIN_SIMILARITY * 2 * len(a):
                    want.append((i, k, score))
                grams = {tuple(b[x : x + d.N]) for x in range(len(b) - 2)}
                if sum(tuple(a[x : x + d.N]) in grams for x in range(len(a) - 2)) > (len(a) - 2) / 2:
                    seeded.add((i, k, score))  # over half of the n-grams are there, so one that is a seed
    assert set(got) <= set(want) and {w for w in want if w in seeded} <= set(got)
    assert len(got) >= 0.9 * len(want) and {1, None} <= {g[0] for g in got} and [g[0] for g in got].count(1) == 2
    kept = d.remove_leaks(df, bench)
    assert kept.columns == df.columns
    leaked = [g[0] for g in got]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in leaked)


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    items, docs = planted()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    whole = sorted(map(str, d.find_leaks(df, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 700)
    assert len(list(d.benchmark_blocks(df, bench))) > 1
    assert sorted(map(str, d.find_leaks(df, bench).collect())) == whole


def test_empty_tables(spark):
    df, bench = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), spark.createDataFrame([], "item_id int, text string")
    assert d.find_leaks(df, bench).count() == 0 and d.remove_leaks(df, bench).count() == 1
    assert d.find_leaks(df.limit(0), spark.createDataFrame([(1, "a b c d")], "item_id int, text string")).count() == 0


def test_verbatim_passages_of_the_tables_are_found(spark):
    path = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()}
    text, item = docs.select("doc_id", "text").collect(), bench.collect()
    want = {(x.doc_id, y.item_id) for x in text for y in item if y.text in x.text}
    assert want and want <= got


def test_edited_copies_that_keep_under_half_of_the_ngrams(spark):
    rng, vocab = vocabulary(7)
    item = rng.sample(vocab, 30)
    edited = [f"other{i}" if i % 5 == 2 else w for i, w in enumerate(item)]  # one word in five replaced, and no exact copy
    filler = lambda: rng.choices(vocab[:5], k=20)
    docs = [(1, " ".join(filler() + edited + filler())), (2, " ".join(filler()))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in d.find_leaks(df, bench).collect()] == [(1, 1, align(item, words(docs[0][1])))]
    with_copy = df.unionByName(spark.createDataFrame([(3, " ".join(item))], "doc_id long, text string"))
    assert {r.doc_id for r in d.find_leaks(with_copy, bench).collect()} == {1, 3}
    assert [r.doc_id for r in d.remove_leaks(with_copy, bench).collect()] == [2]


def test_copies_with_a_tenth_to_a_third_of_the_words_changed(spark):
    """Every pair of similarity 0.5 or more that shares an n-gram is found, and the others are those without one."""
    rng, vocab = vocabulary(13, 3000)
    items = [(k, rng.sample(vocab, rng.randint(20, 70))) for k in range(30)]
    docs = []
    for k, item in items:
        for share in (0.10, 0.15, 0.20, 0.25, 0.30, 0.35):
            copy = [rng.choice(vocab) if rng.random() < share else w for w in item]
            copy = [w for w in copy if rng.random() > 0.02]
            docs.append((len(docs), " ".join(rng.choices(vocab, k=15) + copy + rng.choices(vocab, k=15))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in d.find_leaks(df, spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id int, text string")).collect()}
    grams = lambda w: {tuple(w[i : i + d.N]) for i in range(len(w) - d.N + 1)}
    want, blind = {}, 0
    for i, t in docs:
        b = words(t)
        k = i // 6
        score = align(items[k][1], b)
        if score >= d.MIN_SIMILARITY * 2 * len(items[k][1]):
            if grams(items[k][1]) & grams(b):
                want[i, k] = score
            else:
                blind += 1
    assert len(want) > 100 and blind == 0 and {k: v for k, v in got.items() if k in want} == want
    assert {i for i, _ in got} >= set(range(0, len(docs), 6))


def test_very_long_texts(spark):
    rng, vocab = vocabulary(17, 2000)
    item = rng.sample(vocab, 25)
    long = rng.choices(vocab, k=150_000) + item + rng.choices(vocab, k=50_000)
    got = d.find_leaks(spark.createDataFrame([(1, " ".join(long))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")).collect()
    assert [(r.start_word, r.end_word, r.similarity) for r in got] == [(150_000, 150_025, 1.0)]


def edited(rng, vocab, item, kind, share):
    """item with about that share of its words edited, evenly spread or at random."""
    step = max(2, round(1 / share))
    out = []
    for i, w in enumerate(item):
        hit = i % step == step - 1 if kind.endswith("evenly") else rng.random() < share
        if not hit:
            out.append(w)
        elif kind.startswith("insert"):
            out += [w, rng.choice(vocab)]
        elif kind.startswith("replace"):
            out.append(rng.choice(vocab))
    return out


def test_every_pair_of_half_the_similarity_is_found(spark):
    """Recall is 1 by construction; insertions, drops and replacements of 10 to 50 % against cell-by-cell alignment."""
    rng, vocab = vocabulary(23, 2500)
    items = [(k, rng.choices(vocab, k=rng.choice([5, 8, 12, 20, 60]))) for k in range(20)]
    kinds = [f"{e} {h}" for e in ("insert", "drop", "replace") for h in ("evenly", "anywhere")]
    docs = []
    for k, item in items:
        for kind in kinds:
            for share in (0.1, 0.2, 1 / 3, 0.5):
                docs.append((len(docs), k, rng.choices(vocab, k=10) + edited(rng, vocab, item, kind, share) + rng.choices(vocab, k=10)))
    df = spark.createDataFrame([(i, " ".join(w)) for i, _, w in docs], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in d.find_leaks(df, spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id int, text string")).collect()}
    want = {}
    for i, k, w in docs:
        item = items[k][1]
        score = align(item, w)
        if score >= max(len(item), min(2 * len(item), 2 * d.WHOLE)):
            want[i, k] = score
    assert len(want) > 250 and {k: v for k, v in got.items() if k in want} == want
    assert all(docs[i][1] == k for i, k in got)  # and nothing else is


def test_named_edits_and_short_items(spark):
    rng, vocab = vocabulary(29, 3000)
    item = rng.sample(vocab, 60)
    inserted = [x for i, w in enumerate(item) for x in ([w, "new"] if i % 2 else [w])]
    replaced = [w if i % 3 else "other" for i, w in enumerate(item)]
    dropped = [w for i, w in enumerate(item) if i % 3]
    docs = [(1, inserted), (2, replaced), (3, dropped), (4, ["two", "words"]), (5, ["two", "other", "words"]), (6, item[:20])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Two words"), (3, "words"), (4, "...")], "item_id int, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 2) for r in d.find_leaks(df, bench).collect()}
    want = {(i, 1): round(align(item, w) / 120, 2) for i, w in docs if align(item, w) >= 60}
    assert got == want | {(4, 2): 1.0, (4, 3): 1.0, (5, 3): 1.0} and {1, 2, 3} <= {i for i, _ in want}


def test_seeds_are_the_rare_words(spark):
    rng, vocab = vocabulary(31)
    common, rare = vocab[:10], vocab[10:]
    docs = spark.createDataFrame([(i, " ".join(common[:9] + [rng.choice(rare[10:])])) for i in range(100)], "doc_id long, text string")
    item = [x for pair in zip(rare[:10], common, strict=True) for x in pair]
    (items,) = d.benchmark_blocks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id int, text string"))
    seeds = set(items.seed.tolist())
    assert set(d.Tokens([" ".join(rare[:10])]).hash.tolist()) <= seeds and len(seeds) == 13
    tokens = d.Tokens([r.text for r in docs.collect()], alnum=True)
    assert d.regions(tokens, items) == []  # nine common words of 20 are in every document, and none is aligned
