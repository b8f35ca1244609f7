"""Queries of corpus preparation: sampling, mixing, packing, tokenising, training records, and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bpe, corpus
from ..sources.catalogue import FileCatalogue
from ..streaming import windows
from .registry import query

BUDGET, SEED, SEGMENT, MERGES = 500_000, "mix-7", 257, 200
_SHARE = "('0x' || substr(md5('{seed}' || {key}::VARCHAR), 1, 15))::BIGINT"
_BYTES = "SELECT doc_id, strlen(text) AS bytes, sum(strlen(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - strlen(text) AS before FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\f\\r\\v]')"
_PRETOKENS = r"t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}\x{200c}\x{200d}'']+|[^\p{L}\p{M}\p{N}\p{Pc}\x{200c}\x{200d}''\s\p{Z}]')) AS token FROM documents), f AS (SELECT token, count(*) AS n FROM t GROUP BY ALL)"
_CHARS = "c AS (SELECT n, string_split(token, '') AS c FROM f)"


@query(f"SELECT doc_id, bytes, before FROM ({_BYTES}) WHERE before < {BUDGET}")
def byte_budget_prefix(read):
    return corpus.byte_budget(read("documents").select("doc_id", "text"), "doc_id", BUDGET).select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), "before")


@query(f"SELECT doc_id, bytes FROM ({_BYTES}) WHERE before < {BUDGET}")
def budgeted_files(read):
    """The same by a catalogue of the files, of which only those are opened that the budget reaches; the documents lie in
    order of their ids."""
    return FileCatalogue.of(read("documents")).budget(BUDGET).select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"))


@query(
    f"""WITH d AS (SELECT * FROM ({_BYTES}) WHERE {_SHARE.format(seed=SEED, key="doc_id")}::DOUBLE / 1152921504606846976.0::DOUBLE < least(1.0::DOUBLE, {BUDGET}.0::DOUBLE / (SELECT sum(bytes) FROM ({_BYTES})))),
    r AS (SELECT doc_id, sum(bytes) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - bytes AS before FROM d) SELECT doc_id, before FROM r WHERE before < {BUDGET}"""
)
def bernoulli_bytes(read):
    return corpus.bernoulli_bytes(read("documents").select("doc_id", "text"), "doc_id", BUDGET, SEED).select("doc_id", "before")


@query(
    f"""WITH p AS ({_BYTES}), total AS (SELECT sum(bytes)::BIGINT AS total FROM p),
    b AS (SELECT item_id, strlen(text) AS bytes, sum(strlen(text)) OVER (ORDER BY item_id ROWS UNBOUNDED PRECEDING)::BIGINT - strlen(text) AS before FROM benchmark),
    bt AS (SELECT sum(bytes)::BIGINT AS total FROM b),
    tiles AS (SELECT tile, item_id, bytes, before + tile * (SELECT total FROM bt) AS before FROM b, (SELECT unnest(range(greatest(1, ceil({BUDGET}.0::DOUBLE / (SELECT total FROM bt))::BIGINT))) AS tile))
    SELECT 'documents' AS part, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM p UNION ALL SELECT 'benchmark', count(*), sum(bytes)::BIGINT FROM tiles WHERE before < {BUDGET}"""
)
def tiled_mix(read):
    """All documents and the benchmark repeated to a byte target."""
    docs = read("documents").filter(corpus.non_blank(F.col("text"))).select(F.lit("documents").alias("part"), F.octet_length("text").alias("bytes"))
    more = corpus.tiled(read("benchmark"), "item_id", BUDGET).select(F.lit("benchmark").alias("part"), "bytes")
    return docs.unionByName(more).groupBy("part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(f"SELECT md5('{SEED}' || doc_id::VARCHAR) AS shuffle_key, doc_id FROM documents")
def seeded_shuffle(read):
    return corpus.seeded_shuffle(read("documents").select("doc_id"), "doc_id", SEED).select("shuffle_key", "doc_id")


@query(f"SELECT doc_id, stratum FROM (SELECT doc_id, quality * 2 + toxic AS stratum, row_number() OVER (PARTITION BY quality * 2 + toxic ORDER BY md5('{SEED}' || doc_id::VARCHAR), doc_id) AS place FROM labels) WHERE place <= 13")
def stratified_sample(read):
    rows = read("labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("stratum"))
    return corpus.stratified_sample(rows, "stratum", "doc_id", 50, 4, SEED)


@query(f"SELECT doc_id FROM documents ORDER BY md5('{SEED}' || doc_id::VARCHAR), doc_id LIMIT 100")
def uniform_sample(read):
    """A sampling operator: 100 documents."""
    return corpus.sample_n(read("documents").select("doc_id"), "doc_id", 100, SEED).select("doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def dedupe_first(read):
    return corpus.first_occurrences(read("documents"), "text", "doc_id").select("doc_id")


@query("SELECT count(*) AS n_lines, sum(strlen(text))::BIGINT AS total_bytes FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\f\\r\\v]')")
def corpus_manifest(read):
    return read("documents").filter(corpus.non_blank(F.col("text"))).agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("text")).alias("total_bytes"))


_ANSWERS = "a AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN text || ' [1]' WHEN 2 THEN 'I cannot say. ' || text || ' [2]' WHEN 3 THEN left(text, 20) ELSE '  ' END AS answer, turn = 5 AS refused FROM conversations)"


def answers(read):
    """Turns as answers: with and without citations, stock phrases, short and blank ones."""
    t = F.col("turn") % 5
    made = F.when(t == 0, F.col("text")).when(t == 1, F.concat("text", F.lit(" [1]"))).when(t == 2, F.concat(F.lit("I cannot say. "), "text", F.lit(" [2]"))).when(t == 3, F.substring("text", 1, 20)).otherwise("  ")
    return read("conversations").select("conv_id", "turn", made.alias("answer"), (F.col("turn") == 5).alias("refused"))


@query(
    f"""WITH {_ANSWERS}, s AS (SELECT *, trim(answer, ' ' || chr(10) || chr(9) || chr(13)) AS flat FROM a)
    SELECT CASE WHEN refused THEN 'refused' WHEN flat = '' THEN 'empty' WHEN length(flat) < 30 THEN 'too_short' WHEN contains(lower(answer), '[insufficient-context]') THEN 'matches:<[INSUFFICIENT-CONTEXT]>'
    WHEN contains(lower(answer), 'i am unable') THEN 'matches:<I am unable>' WHEN contains(lower(answer), 'i cannot') THEN 'matches:<I cannot>' WHEN contains(lower(answer), 'i do not have') THEN 'matches:<I do not have>'
    WHEN NOT regexp_matches(answer, '\\[\\d+\\]') THEN 'no_citation' ELSE 'accepted' END AS reason, count(*) AS n FROM s GROUP BY ALL"""
)
def sft_filter(read):
    reason = F.coalesce(T.reject_reason(F.col("answer"), F.col("refused")), F.lit("accepted"))
    return answers(read).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_PRETOKENS} SELECT token, n FROM f")
def word_freq(read):
    return bpe.word_frequencies(read("documents"))


@query(f"WITH {_PRETOKENS}, {_CHARS} SELECT token, sum(n)::BIGINT AS n FROM (SELECT unnest(c) AS token, n FROM c) WHERE token <> '' GROUP BY ALL")
def char_vocab(read):
    return bpe.characters(bpe.word_frequencies(read("documents")))


@query(f"""WITH {_PRETOKENS}, {_CHARS} SELECT p[1] AS "left", p[2] AS "right", sum(n)::BIGINT AS n FROM (SELECT unnest(list_zip(c[:-2], c[2:])) AS p, n FROM c WHERE len(c) > 1) GROUP BY ALL""")
def pair_freq(read):
    return bpe.pair_frequencies(bpe.word_frequencies(read("documents")))


@query()
def bpe_encode(read):
    """Trains on all documents' words and encodes all documents."""
    docs = read("documents")
    made = bpe.encode(docs, "doc_id", bpe.fit(docs, MERGES))
    return made.select("doc_id", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join(F.transform("tokens", lambda t: t.cast("string")), " "), 256).alias("tokens_sha256"))


_IDS = "string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+')"


def word_ids(read):
    """Documents as arrays of a number for each word."""
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return read("documents").select("doc_id", F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10)).cast("int")).alias("tokens"))


@query(
    f"""WITH w AS (SELECT doc_id, unnest({_IDS}) AS w, generate_subscripts({_IDS}, 1) AS i FROM documents),
    s AS (SELECT ('0x' || substr(md5(w), 1, 6))::INT AS id, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM w WHERE w <> '')
    SELECT pos // {SEGMENT} AS segment, arg_min(id, pos) AS first_id, arg_max(id, pos) AS last_id, sum(id)::BIGINT AS total FROM s GROUP BY ALL HAVING count(*) = {SEGMENT}"""
)
def pack_segments(read):
    made = corpus.pack(word_ids(read), "doc_id", SEGMENT)
    total = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda n, t: n + t)
    return made.select("segment", F.element_at("tokens", 1).alias("first_id"), F.element_at("tokens", -1).alias("last_id"), total.alias("total"))


def _pairs(read):
    """Each assistant turn as the answer to the turn before it, as arrays of word numbers."""
    ids = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w))
    t = read("conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), ids("text").alias("prompt"))
    return t.filter("role = 'assistant'").select("conv_id", "turn", ids("text").alias("answer")).join(before, ["conv_id", "turn"])


_PAIRS = """p AS (SELECT a.conv_id, a.turn, list_transform(string_split(b.text, ' '), lambda w: length(w)) AS prompt, list_transform(string_split(a.text, ' '), lambda w: length(w)) AS answer
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'),
    r AS (SELECT conv_id, turn, least(len(prompt), 128 - len(answer)) AS prompt_len, list_concat(CASE WHEN len(answer) = 128 THEN [] ELSE prompt[-least(len(prompt), 128 - len(answer)):] END, answer) AS ids, len(answer) AS n FROM p WHERE len(answer) <= 128)"""


@query(f"WITH {_PAIRS} SELECT conv_id, turn, prompt_len, len(ids) AS n_ids, list_sum(ids)::BIGINT AS id_sum, list_sum(ids[prompt_len + 1:])::BIGINT - 100 * prompt_len AS label_sum FROM r")
def label_mask(read):
    made = corpus.training_records(_pairs(read), "prompt", "answer", 128)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + x)
    return made.select("conv_id", "turn", "prompt_len", F.size("input_ids").cast("bigint").alias("n_ids"), total("input_ids").alias("id_sum"), total("labels").alias("label_sum"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, max(len(ids)) OVER (PARTITION BY conv_id // 8) AS n_ids, list_sum(ids[prompt_len + 1:])::BIGINT - 100 * prompt_len - 100 * (max(len(ids)) OVER (PARTITION BY conv_id // 8) - len(ids)) AS label_sum FROM r")
def pad_batch(read):
    made = corpus.training_records(_pairs(read), "prompt", "answer", 128).withColumn("batch", F.floor(F.col("conv_id") / 8))
    padded = corpus.pad(made, "batch")
    return padded.select("conv_id", "turn", F.size("input_ids").cast("bigint").alias("n_ids"), F.aggregate("labels", F.lit(0).cast("bigint"), lambda n, x: n + x).alias("label_sum"))


@query(
    f"""WITH q AS (SELECT conv_id * 100 + turn AS query_id, text AS query, CASE WHEN turn = 0 THEN 'eval' ELSE 'synthetic' END AS source FROM conversations),
    o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE source WHEN 'eval' THEN 0 ELSE 1 END, query_id) AS n FROM q),
    {_ANSWERS} SELECT query_id, source, CASE WHEN refused THEN 'refused' WHEN trim(answer) = '' THEN 'empty' WHEN length(trim(answer, ' ' || chr(10) || chr(9) || chr(13))) < 30 THEN 'too_short' WHEN contains(lower(answer), 'i cannot') THEN 'matches:<I cannot>' WHEN NOT regexp_matches(answer, '\\[\\d+\\]') THEN 'no_citation' END AS rejection_reason
    FROM o JOIN a ON a.conv_id * 100 + a.turn = o.query_id WHERE n = 1"""
)
def sft_corpus(read):
    """Distinct queries (first turns before others) with the verdict on their answers."""
    key = F.col("conv_id") * 100 + F.col("turn")
    queries = read("conversations").select(key.alias("query_id"), F.col("text").alias("query"), F.when(F.col("turn") == 0, "eval").otherwise("synthetic").alias("source"))
    hits = queries.select("query_id", F.col("query_id").alias("chunk_id"), F.lit(1).alias("rank"))
    return corpus.training_corpus(queries, hits, answers(read).select(key.alias("query_id"), "answer", "refused")).select("query_id", "source", "rejection_reason")


@query(
    """WITH w AS (SELECT doc_id, unnest([doc_id, doc_id + 1, doc_id * 2]) AS ref FROM labels)
    SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM w WHERE ref NOT IN (SELECT doc_id FROM documents))"""
)
def complete_rows(read):
    """Rows all of whose references exist."""
    rows = read("labels").select("doc_id", F.array("doc_id", F.col("doc_id") + 1, F.col("doc_id") * 2).alias("refs"))
    return corpus.without_missing(rows, "doc_id", "refs", read("documents").withColumnRenamed("doc_id", "chunk_id")).select("doc_id")


@query("SELECT (props->>'$.k')::INT AS k, event_type, count(*) AS n FROM events GROUP BY ALL")
def json_props(read):
    parsed = read("events").select("event_type", F.from_json("props", "k int").alias("p"))
    return parsed.groupBy(F.col("p.k").alias("k"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(read):
    """Windowed metrics, as the streaming form computes them."""
    return windows.windowed_metrics(read("events"), "1 hour").withColumn("total", F.round("total", 4))
