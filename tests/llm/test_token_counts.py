from tokenizers import Tokenizer

from tesserae.llm import token_counts as t

TEXTS = [
    "", None, "Hello, WORLD! it's 42 o'clock''s", "<|endoftext|> twice <|startoftext|>x", "ÅÉé ñandú ΑΣ ΣΑΣ İstanbul ǅ ﬁ", "a\x1cb c d\u0085e​f",
    "é ọ̈ किताब 日本語 ①②½ ٣", "👩‍👩‍👧 … -- ***", "w" * 5000, "don't we'll I'VE 'tis ' '' 'd'd", "tab\tnew\nline\r\x0b\x0c end", "ſ K Å ẞ",
]


def library():
    return Tokenizer.from_file(t.tokenizer_file())


def test_counts_equal_the_library(spark):
    rows = [(i, x, "q") for i, x in enumerate(TEXTS)] + [(2, TEXTS[2], "q")]
    got = t.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), limit=10).collect()
    assert len(got) == len(rows)
    tok = library()
    for r in got:
        x = TEXTS[r.doc_id] or ""
        assert r.n_tokens == len(tok.encode(x, add_special_tokens=False).ids), x
        assert (r.n_bytes, r.over_limit) == (len(x.encode()), r.n_tokens > 10)


def test_empty_table(spark):
    assert t.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_words_are_proven():
    whole = t.prove_whole(library())
    assert len(whole) > 30_000 and "the" in whole
    tok = library()
    assert all(len(tok.encode(w, add_special_tokens=False).ids) == 1 for w in whole[::500])


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tok = library()
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in t.count_tokens(docs).collect()} == want
