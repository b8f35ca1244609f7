import random

from tesserae.llm import near_copies as nc
from tesserae.llm import simhash


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def kept(rows):
    """The smallest id of each component, by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets}
    changed = True
    near = [(i, j) for i, x in sets for j, y in sets if i != j and 5 * len(x & y) >= 4 * len(x | y)]
    while changed:
        changed = False
        for i, j in near:
            if label[j] < label[i]:
                label[i], changed = label[j], True
    return set(label.values())


def planted():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = " ".join(word() for _ in range(12))
    texts = ["", None, " \t", "one", "One", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(40, 120))]
        for k in range(6):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + (" " + line if k % 2 else ""))
    return list(enumerate(texts, 1))


def test_pairs_that_two_bits_of_simhash_miss(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept(rows)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == want
    old = {r.component_id for r in simhash.near_duplicates(df).collect()}
    assert len(want) < len(old)


def test_the_sample_does_not_bear_on_results(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nc.near_copies(df, sample=7).groupBy("component").agg({"doc_id": "min"}).collect()
    assert {r[1] for r in got} == kept(rows)


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == kept([(r.doc_id, r.text) for r in docs.collect()])


def template(rng, n, size=4, odd=2):
    """n texts of one template whose odd words make them too different to be near copies."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    frame = [word() for _ in range(size)]
    return [" ".join([*frame, *(word() for _ in range(odd)), *frame]) for _ in range(n)]


def test_texts_of_one_template_are_not_all_paired(spark, monkeypatch):
    rng = random.Random(8)
    met = []
    one = nc.meeting
    monkeypatch.setattr(nc, "meeting", lambda members: (met.append(one(members).count()), one(members))[1])
    for n in (200, 400):
        # of 9, 12 and 39 words: sets of 5, 8 and 35 shingles
        rows = list(enumerate(template(rng, n, 4, 1) + template(rng, n, 5, 2) + template(rng, n, 16, 7)))
        found = nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
        assert found.select("component").distinct().count() == 3 * n
    assert met[1] <= 2 * met[0] + 10 and met[1] < 3 * 400  # in proportion to the texts


def test_sizes_at_the_bounds_against_all_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdef", k=6))
    texts = []
    for n in (5, 9, 10, 13, 14, 22, 31, 49):
        base = [word() for _ in range(n)]
        for cut in range(0, n // 4 + 1):
            texts += [" ".join(base[cut:]), " ".join(base + [word() for _ in range(cut)]), " ".join([word() for _ in range(cut // 2)] + base[cut // 2 :])]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("component").agg({"doc_id": "min"}).collect()
    assert {r[1] for r in got} == kept(rows)


def siblings(rng, n, size=80, edits=6):
    """n texts of one base, each with its own words in a few places: too different to be near copies, and two that are."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    base = [word() for _ in range(size)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for k in rng.sample(range(4, size - 4, 6), edits):
            copy[k] = word()
        texts.append(" ".join(copy))
    return [*texts, texts[0] + " " + word(), texts[n // 2] + " " + word()]


def test_siblings_that_the_sample_misses_are_not_all_paired(spark, monkeypatch):
    rng = random.Random(10)
    met = []
    one = nc.meeting
    monkeypatch.setattr(nc, "meeting", lambda members: (met.append(one(members).count()), one(members))[1])
    for n in (30, 90):
        rows = list(enumerate(siblings(rng, n)))
        got = nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), sample=1).groupBy("component").agg({"doc_id": "min"}).collect()
        assert {r[1] for r in got} == kept(rows) == set(range(n))
    assert met[1] <= 90  # all pairs would be 4,005 and more
