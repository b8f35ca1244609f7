"""Every named query of the engine against its SQL on the smallest tables."""

import glob
import hashlib
import html
import math
import os
import re

import duckdb
import pytest

from tesserae.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalogue.ORACLES:
        assert rows
        return
    found = sql.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_fuzzy_names_against_all_pairs(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    from tesserae.plans import text_queries

    read = lambda table: spark.read.parquet(f"{SF}/{table}.parquet")
    asked = [tuple(r) for r in text_queries._misspelt(read).select("query_id", "text").collect()]
    names = [tuple(r) for r in text_queries.part_names(read).select("id", "fqn").collect()]
    want = {(q, i): round(200 * lcs(t, n) / (len(t) + len(n)), 6) for q, t in asked for i, n in names}
    got = {(r.query_id, r.chunk_id): r.score for r in catalogue.QUERIES["symbol_fuzzy"](spark, SF).collect()}
    assert got == {k: v for k, v in want.items() if v >= 85} and len(got) >= len(asked)


def test_html_chunks_against_split_tags(spark):
    got = sorted((r.chunk_id, r.title, r.text_sha256) for r in catalogue.QUERIES["html_chunks"](spark, SF).collect())
    want = []
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if not inside:
            continue
        body = re.sub(r"<!--.*?-->|<(script|style|template)\b.*?</\1>", "", inside[1], flags=re.S)
        strings = lambda x: [t for t in (html.unescape(s).strip() for s in re.split(r"<[^>]*>", x)) if t]
        heading = re.search(r"<h([123])[^>]*>(.*?)</h\1>", body, re.S)
        if not heading or not strings(heading[2]):
            continue
        text = "\n".join(strings(body.replace(heading[0], "", 1)))
        path = r.url.split("#")[0]
        pieces = [text] if len(text) <= 1500 or "\n\n" not in text else None
        assert pieces is not None
        want += [(f"section:{path.removesuffix('.html')}#page-{r.page_id}", "".join(strings(heading[2])), hashlib.sha256(t.encode()).hexdigest()) for t in pieces if t]
    assert got == sorted(want) and want
