from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as p
from tesserae.llm import decontaminate, quality_cnn, sharding
from tesserae.llm.common import table

from .test_decontaminate import align, words
from .test_mixing import WORDS, check
from .test_near_copies import kept

SF = "/root/testdata/sf0.001"


def good(net, text):
    """The network's verdict, window by window."""
    raw = (text or "").encode()
    padded = np.frombuffer(raw + b"\0" * (quality_cnn.WINDOW + len(raw) % quality_cnn.STRIDE), np.uint8)
    starts = np.arange(0, max(len(raw), 1), quality_cnn.STRIDE)
    answers = sum(net.p["filters"][k][padded[starts + k]] for k in range(quality_cnn.WINDOW))
    return net.head(answers.max(axis=0)[None])[2][0] >= quality_cnn.THRESHOLD


def leaked(rows, items):
    """Ids of texts whose alignment with an item, cell by cell, is similar enough; both share an n-gram."""
    where = defaultdict(set)
    for k, item in items:
        w = words(item)
        for i in range(len(w) - decontaminate.N + 1):
            where[tuple(w[i : i + decontaminate.N])].add(k)
    texts, out = dict(items), set()
    for i, t in rows:
        b = words(t)
        near = set().union(*(where.get(tuple(b[x : x + decontaminate.N]), ()) for x in range(len(b))))
        if any(align(a, b) >= decontaminate.MIN_SIMILARITY * decontaminate.MATCH * len(a) for a in (words(texts[k]) for k in near)):
            out.add(i)
    return out


def stages(spark, docs, sf_dir):
    """Every stage on its own input against a plain version."""
    columns = docs.columns
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in p.STAGES[:-1]:
        before = docs.collect()
        made = stage(spark, docs, sf_dir)
        assert made.columns == columns
        after = made.collect()
        rows = [(r.doc_id, r.text) for r in before]
        if name == "quality":
            net = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
            want = {i for i, t in rows if good(net, t)}
        elif name == "near_duplicates":
            want = kept([(i, t) for i, t in rows if i is not None]) | {i for i, _ in rows if i is None}
        elif name == "decontamination":
            want = {i for i, _ in rows} - leaked(rows, items)
        if name == "mixing":
            source = {r.doc_id: r.source for r in before}
            size = {i: len(WORDS.findall(t or "")) for i, t in rows}
            total = defaultdict(int)
            for i, n in size.items():
                total[source[i]] += n
            taken = {r.doc_id: len(WORDS.findall(r.text)) for r in after}
            share = defaultdict(int)
            for i, n in taken.items():
                assert 0 < n <= 2 * size[i]
                share[source[i]] += n
            assert sum(share.values()) == pytest.approx(min(1.5 * sum(total.values()), 2 * sum(total.values())), abs=len(total))
        else:
            assert {r.doc_id for r in after} == want
            same = defaultdict(list)
            for r in before:
                same[r.doc_id].append(r)
            assert all(r in same[r.doc_id] for r in after)
        docs = spark.createDataFrame(after, docs.schema)
    placed = p.STAGES[-1][1](spark, docs, sf_dir).collect()
    filled = sharding.fill_table([str(i) for i in range(sharding.N_SHARDS)], sharding.TABLE_SIZE)
    assert len(placed) == docs.count() and all(filled[r.slot] == r.shard for r in placed)
    return placed


def test_every_stage_on_its_own_input(spark):
    placed = stages(spark, table(spark, SF, "documents"), SF)
    whole = p.run(spark, SF).collect()
    assert sorted((r.doc_id, r.shard, r.text_sha256) for r in whole) == sorted((r.doc_id, r.shard, r.text_sha256) for r in placed)


def test_nulls_long_texts_ties_and_clashing_columns(spark):
    docs = table(spark, SF, "documents").limit(40).collect()
    schema = table(spark, SF, "documents").schema
    long = " ".join(f"{w}{i % 97}" for i, w in enumerate(WORDS.findall(docs[1].text) * 3000))[:1_500_000]
    more = [(None, docs[2].text, None, None, None), (9001, None, None, None, None), (9002, "", "en", "web", 0), (9003, long, "en", None, len(long)), tuple(docs[3]), tuple(docs[3])]
    df = spark.createDataFrame([tuple(r) for r in docs] + more, schema)
    wide = df.selectExpr("*", *[f"doc_id AS {c}" for c in ("key", "node", "fp", "size", "skey", "block", "taken", "score", "component", "slot", "shard", "label")])
    for name, stage in p.STAGES[:-1]:
        wide = spark.createDataFrame(stage(spark, wide, SF).collect(), wide.schema)
        assert len(wide.columns) == 17 and wide.count() > 0, name
    assert p.STAGES[-1][1](spark, wide, SF).count() == wide.count()
    empty = df.limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
        empty = empty if "text" in empty.columns else df.limit(0)


def test_the_mix_of_a_stage_meets_its_targets(spark):
    from tesserae.llm import mixing

    docs = table(spark, SF, "documents")
    check([(r.doc_id, r.source, r.text) for r in docs.collect()], mixing.mix(docs).collect())
