import random
import re

from tesserae.operators import evaluation


def test_report_over_grouping_sets(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        answer = rng.choice([None, "", " ".join(f"Word{rng.randrange(2000)}." for _ in range(6))])
        rank = rng.choice([None, 1, 2, 7, 11])
        rows.append((rng.choice("ab"), rng.choice(["howto", "identifier", None]), rng.choice(["correct", "wrong"]), rank is not None and rank <= 5, rank is not None and rank <= 10, rank, rng.lognormvariate(0, 1), answer))
    df = spark.createDataFrame(rows, "run string, query_type string, tier string, hit_at_5 boolean, hit_at_10 boolean, rank int, latency_seconds double, answer string").repartition(7)
    got = {(r.grouped, r.run, r.query_type, r.tier): r for r in evaluation.run_report(df, (0.5, 0.9)).collect()}
    names, n = ("run", "query_type", "tier"), 0
    for grouped in evaluation.REPORT_SETS:
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[names.index(c)] if c in grouped else None for c in names), []).append(r)
        for key, mine in groups.items():
            n += 1
            r = got[",".join(grouped), *key]
            assert r.n == len(mine) and abs(r.recall_at_5 - sum(m[3] for m in mine) / len(mine)) < 1e-9 and abs(r.recall_at_10 - sum(m[4] for m in mine) / len(mine)) < 1e-9
            assert abs(r.mrr - sum(1 / m[5] if m[5] else 0 for m in mine) / len(mine)) < 1e-9
            times = sorted(m[6] for m in mine)
            for q, x in zip((0.5, 0.9), r.latency, strict=True):
                assert abs(sum(t <= x for t in times) / len(times) - q) < 0.02 + 1 / len(times)
            words = {w for m in mine for w in re.split(r"\W+", (m[7] or "").lower()) if w}
            assert abs(r.vocabulary - len(words)) <= 0.08 * len(words)  # four standard errors
    assert n == len(got)
    assert evaluation.run_report(df.limit(0)).count() == 0
