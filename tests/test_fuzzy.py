import random

import pytest

from tesserae.functions.similarity import _lcs
from tesserae.operators import fuzzy, symbols


def ratio(a, b):
    return round(200 * _lcs(a, b) / (len(a) + len(b)), 6) if a or b else 100.0


def strings(seed, n, letters, most):
    rng = random.Random(seed)
    made = ["".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(n)]
    for s in made[: n // 2]:  # and some that are a few edits away
        t = list(s)
        for _ in range(rng.randint(0, 1 + len(s) // 6)):
            at = rng.randint(0, len(t))
            t[at : at + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
        made.append("".join(t))
    return sorted(set(made))


@pytest.mark.parametrize(("threshold", "letters", "most"), [(85, "abcde.", 30), (85, "ab", 9), (70, "abc", 14), (60, "abcdefgh", 12), (30, "abcd", 6), (100, "ab", 5), (92.5, "aé\U0001f600b", 40)])
def test_same_pairs_as_all_pairs(spark, threshold, letters, most):
    texts, names = strings(1, 120, letters, most), strings(2, 150, letters, most) + strings(1, 60, letters, most)
    names = sorted(set(names))
    left, right = (spark.createDataFrame([(s,) for s in x] + [(None,)], f"{c} string") for x, c in ((texts, "text"), (names, "name")))
    got = {(r.text, r.name): r.score for r in fuzzy.fuzzy_join(left, right, threshold).collect()}
    assert got == {(a, b): r for a in texts for b in names if (r := ratio(a, b)) >= threshold}


def test_grams_bound_the_candidates(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(200)]
    names = sorted({".".join(rng.choices(words, k=4)) for _ in range(3000)})
    left, right = spark.createDataFrame([(n[:7] + n[8:],) for n in names[::30]], "text string"), spark.createDataFrame([(n,) for n in names], "name string")
    n = fuzzy.candidates(left, right, 85).count()  # all lengths are near each other: by length alone 300,000
    assert 100 <= n < 60_000
    plan = fuzzy.candidates(left, right, 85)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bounds():
    b = fuzzy.Bounds(85)
    assert all(b.shared(s, 2) >= 1 for s in range(b.both, 500)) and b.shared(b.both - 1, 2) < 1
    assert fuzzy.Bounds(50).both == float("inf")
    for bad in (0, 101):
        with pytest.raises(ValueError):
            fuzzy.Bounds(bad)


def test_lookup_takes_fuzzy_hits_where_no_alias_is_exact(spark):
    rng = random.Random(4)
    names = sorted({".".join("".join(rng.choices("abcde", k=4)) for _ in range(3)) for _ in range(80)})
    found = spark.createDataFrame([(f"c{i}", n, "py:function" if i % 2 else "py:class", n.rpartition(".")[0]) for i, n in enumerate(names)], "chunk_id string, fqn string, role string, parent_module string")
    asked = [(i, n.partition(".")[2]) for i, n in enumerate(names[::5])] + [(100 + i, n[:3] + n[4:]) for i, n in enumerate(names[::3])] + [(500, "nothing like it"), (501, None), (502, names[0] + "x")]
    got = sorted((r.query_id, r.used, r.chunk_id, r.score) for r in symbols.lookup(spark.createDataFrame(asked, "query_id long, text string"), found).collect())
    want = []
    for q, t in asked:
        direct = [i for i, n in enumerate(names) if t in (n, *(n.split(".", k)[-1] for k in range(1, n.count(".") + 1)))]
        hits = [("exact", f"c{i}", 100.0) for i in direct] or [("fuzzy", f"c{i}", r) for i, n in enumerate(names) if t is not None and (r := ratio(t, n)) >= 85]
        want += [(q, *h) for h in hits]
    assert got == sorted(want) and {w[1] for w in want} == {"exact", "fuzzy"}
