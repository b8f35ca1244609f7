import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tesserae.llm import filter_audit as m


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def plain(docs, labels):
    ids = {}
    for doc_id, _, text in docs:
        ids.setdefault(text or "", []).append(doc_id)
    rows = []
    for doc_id, source, text in docs:
        f = fails(text or "") | {"E": doc_id is not None and any(i is not None and i < doc_id for i in ids[text or ""])}
        told = [(q, t) for i, q, t in labels if i == doc_id and i is not None]
        rows.append((source or "", f, any(q == 1 for q, _ in told), any(t == 1 for _, t in told)))
    out = []
    for part in {r[0] for r in rows}:
        mine, shapley, steps = [r for r in rows if r[0] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            alive = mine
            for step, x in enumerate(order, 1):
                lost = [r for r in alive if r[1][x]]
                n = sum(r[1][x] for r in mine)
                alive = [r for r in alive if not r[1][x]]
                shapley[x] += len(lost)
                only = sum(r[1][x] and sum(r[1].values()) == 1 for r in mine)
                steps.append((part, order, step, len(alive), len(lost), n - len(lost), only, sum(r[2] for r in lost), sum(r[3] for r in lost)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 49, 50, 60, 80]))) for _ in range(120)]
    texts += ["same start " * 30 + word() for _ in range(60)] + ["a b " * 60, "X" * 100, "50% off", "", "\x00", "tab\tand\x0bline", "x" * 50_000, "x" * 50_001]
    texts += [t + "\n" for t in texts[:5]] + [t[:-1] for t in texts[130:140]]
    docs = [(i, rng.choice(["web", "books", "", None]), rng.choice(texts)) for i in range(500)] + [(1000 + i, "hot", "copied again and again") for i in range(300)]
    docs += [(None, "web", texts[0]), (None, None, None), (7, "web", docs[7][2]), docs[8], docs[8], (9, "news", None), (2000, "news", "")]
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 500, 2)] + [(4, 1, 1), (None, 1, 1)]
    return docs, labels


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("range_bytes", [m.RANGE_BYTES, 500])
def test_matches_a_plain_version(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(m, "REMEMBERED", 20)
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, source string, text string, part string, mask int").repartition(6)
    got = m.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), range_bytes=range_bytes)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == plain(docs, labels)


def test_trie_holds_smallest_ids():
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 8))) for _ in range(400)]
    trie, least = m.Trie(), {}
    ids = rng.sample(range(1000), 400)
    nodes = [trie.insert(t, i) for i, t in zip(ids, texts, strict=True)]
    for i, t in zip(ids, texts, strict=True):
        least[t] = min(least.get(t, i), i)
    assert [n[1] for n in nodes] == [least[t] for t in texts]
    inner, stack = 0, [trie.root]
    while stack:
        edges, least_id = stack.pop()
        inner += least_id is None and len(edges) == 1
        stack += [below for _, below in edges.values()]
    assert inner <= 1  # compressed: but for the root, a node is a terminal or branches


def test_splitting_points_follow_shared_prefixes(spark):
    start = "the same long beginning " * 40
    texts = [f"{start}{i:05d} tail" for i in range(3000)] + [f"{i:04d} other" for i in range(300)] + ["hot" * 300] * 500
    points = m.splitting_points(spark.createDataFrame([(t,) for t in texts], "text string"), range_bytes=20_000)
    assert points == sorted(set(points)) and sum(p.startswith(start.encode()) for p in points) > 10
    sizes = Counter(m.bisect_right(points, t.encode()) for t in set(texts))
    assert max(sizes[k] for k in sizes if k and points[k - 1].startswith(start.encode())) < 3 * 20_000 / len(start)
    assert m.splitting_points(spark.createDataFrame([], "text string")) == []


def test_large_range_is_cut_where_heads_change(spark):
    texts = [(i, "p", f"{i % 700:03d} text") for i in range(2000)]
    df = spark.createDataFrame(texts, "doc_id long, source string, text string")
    got = m.document_masks(df, range_bytes=100, sample=1)  # one text in 2000 is sampled: ranges are far larger than 100 bytes
    assert sorted((r.doc_id, bool(r["mask"] & m.COPY)) for r in got.collect()) == [(i, i >= 700) for i in range(2000)]


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, source string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert m.audit(docs, labels).count() == 0
    one = spark.createDataFrame([("a", "s", "x")], "doc_id string, source string, text string")
    got = m.audit(one, spark.createDataFrame([("a", 1, 0)], "doc_id string, quality int, toxic int"))
    assert got.count() == 600 and got.filter("good_lost = 1").count() == 120
