import pytest
from pyspark.sql import functions as F

from tesserae.functions import similarity as S
from tesserae.functions import text as T


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", function(F.col("v")).alias("r"))
    return [r.r for r in sorted(rows.collect())]


def test_analyzer(spark):
    cases = {
        "pathlib.Path.read_text": ["pathlib", "path", "read_text", "read", "text"],
        "dict.fromKeys": ["dict", "fromkeys", "from", "keys"],
        "os.path.join": ["os", "path", "join"],
        "": [],
        "BZ2File HTTPServer": ["bz2file", "bz2", "file", "httpserver", "http", "server"],
        " -- a  … __init__ ": ["a", "…", "__init__", "init"],
    }
    assert apply(spark, T.analyze, list(cases)) == list(cases.values())


def test_identifiers_and_citations(spark):
    assert apply(spark, T.classify_query, ["os.path", "how to", "...", "a_b1"]) == ["identifier", "natural_language", "natural_language", "identifier"]
    assert apply(spark, T.citations, ["x [1] y [3, 1] [0]", "[x] []", "[1,\n2]"]) == [[1, 3, 0], [], [1, 2]]
    assert apply(spark, T.without_refusal, [f"no {T.REFUSAL_MARKER} \n", "yes "]) == ["no", "yes"]


def test_uris_and_slugs(spark):
    assert apply(spark, T.uri_path, ["a.html#b#c", "a", "a#"]) == ["a.html", "a", "a"]
    assert apply(spark, T.uri_anchor, ["a.html#b#c", "a", "a#"]) == ["b#c", None, ""]
    assert apply(spark, T.slug, ["Hello, World!", "--x--"]) == ["hello-world", "x"]
    assert apply(spark, T.aliases, ["a.b.c", "x"]) == [["a.b.c", "b.c", "c"], ["x"]]
    for mode, want in (("exact", False), ("strip_anchor", True), ("prefix", True)):
        assert spark.range(1).select(T.url_matches(mode, F.lit("l/a.html#x"), F.lit("l/a.html")).alias("m")).first().m is want


def test_cuts(spark):
    assert apply(spark, lambda c: T.preview(c, 5), ["a  b\nc", "abcdefg", "abc  def"]) == ["a b c", "abcd…", "abc…"]
    assert apply(spark, lambda c: T.truncate(c, 5, "..."), ["abcdefg", "abcde"]) == ["ab...", "abcde"]
    assert apply(spark, T.strip_code_fence, ["```json\n{}\n```", " {} "]) == ["{}", "{}"]
    assert apply(spark, T.served_version, ["<title>x 3.12.4 docs</title>", "<title>none</title>"]) == ["3.12.4", None]
    assert apply(spark, T.pretokens, ["don't go, now"]) == [["don't", "go", ",", "now"]]


@pytest.mark.parametrize(("answer", "refused", "reason"), [("x", True, "refused"), (" \n", False, "empty"), ("short", False, "too_short"), ("i CANNOT say anything about this at all", False, "matches:<I cannot>"), ("long enough but without any citation", False, "no_citation"), ("long enough and with a citation [1]", False, None)])
def test_reject_reasons(spark, answer, refused, reason):
    assert spark.range(1).select(T.reject_reason(F.lit(answer), F.lit(refused)).alias("r")).first().r == reason


def test_ratios_agree(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    pairs = [("abcd", "acbd"), ("", ""), ("a", ""), ("pathlib", "pathlb"), ("élan", "elan"), ("kitten" * 15, "sitting" * 12)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", S.ratio(F.col("a"), F.col("b")).alias("r"), S.fast_ratio("a", "b").alias("f"), S.may_reach(F.col("a"), F.col("b"), 85).alias("m")).collect()
    for r in got:
        a, b = pairs[r.i]
        want = 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100
        assert abs(r.r - want) < 1e-9 and abs(r.f - want) < 1e-9 and (r.m or want < 85)


def test_prompt_parts(spark):
    assert apply(spark, T.is_question, ["why?", " ", "so"]) == [True, False, False]
    assert apply(spark, T.flatten_messages, [["a", "b"]], "array<string>") == ["a\n\nb\n"]
    assert apply(spark, T.structure_hint, ["howto", "x"]) == [T.STRUCTURE_HINTS["howto"], None]
