import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import simhash as s
from tesserae.llm.components import connected_components


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    words = [w.decode() for w in words]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(rows):
    """doc_id -> smallest reachable, by all pairs."""
    ids = [i for i, _ in rows]
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, f in rows:
            for j, g in rows:
                if (f ^ g).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_equal_the_definition():
    texts = ["", None, " \t\n", "One", "one TWO", "a b c", "a b c d", "É é \x1c x y z", "x " * 300, "Long " + "word" * 5000, " ".join(f"w{i % 9973}" for i in range(300_000))]
    assert s.fingerprints(texts).tolist() == [plain(t) for t in texts]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in s.near_duplicates(docs).collect()}
    want = classes(rows)
    assert got == {i: (f"{f:016x}", want[i]) for i, f in rows}


def test_links_at_the_radius_and_chains():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = list(dict.fromkeys(f for b in base for f in (b, b ^ 3, b ^ 0xF, b ^ (1 << 63), b ^ 7 << 40)))
    a = np.array(fps, np.uint64).view(np.int64)
    i, j = s.links(a, a, 2, True)
    want = {(x, y) for x in range(len(fps)) for y in range(x) if (fps[x] ^ fps[y]).bit_count() <= 2}
    assert {(max(p), min(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want


def test_tiles_find_all_components(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:120]:
        for _ in range(4):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = classes([(f, f % (1 << 64)) for f in fps])
    for lanes in (4, 8, 16):
        found = {r.node: r.component for r in connected_components(s.near_edges(df, tile=16, lanes=lanes)).collect()}
        assert {f: found.get(f, f) for f in fps} == want


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101), (7, 7), (200, 201), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 5)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_dense_groups_give_few_edges():
    a = np.unique(np.array([1 << i for i in range(64)] + [0], np.uint64)).view(np.int64)
    i, j = s.links(a, a, 2, True)
    assert len(i) == len(a) - 1


def test_edge_rows(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "same text here now", "c"), (4, "Same TEXT here now", "c"), (4, "Same TEXT here now", "c"), (None, "same text here now", "c"), (None, "a lonely one without any id", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = s.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (2, 1), (3, 3), (4, 3), (4, 3)]
    assert sorted((r.component_id or 0) for r in got if r.doc_id is None) == [0, 3]
    kept = s.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3]
    assert s.near_duplicates(df.limit(0)).count() == 0
    named = s.near_duplicates(df.withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))).collect()
    assert sorted((r.doc_id, r.component_id) for r in named if r.doc_id) == [("id-1", "id-1"), ("id-2", "id-1"), ("id-3", "id-3"), ("id-4", "id-3"), ("id-4", "id-3")]
