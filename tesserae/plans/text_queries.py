"""Queries of the text functions, symbol look-up and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, chunks, symbols
from .registry import query

WORD_SQL = r"""
words AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '[\s\p{Z}]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
qwords AS MATERIALIZED (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(string_split_regex(text, '[\s\p{Z}]+')) AS w FROM benchmark) WHERE w <> '' GROUP BY ALL),
distinct_words AS MATERIALIZED (SELECT w FROM words UNION SELECT w FROM qwords),
dotted AS (SELECT w, unnest(string_split(w, '.')) AS p FROM distinct_words),
marked AS (SELECT w, p, CASE WHEN regexp_matches(p, '[a-z][A-Z]|[A-Z0-9][A-Z][a-z]') THEN string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p,
  '([a-z])([A-Z])', '\1' || chr(31) || '\2', 'g'), '([a-z])([A-Z])', '\1' || chr(31) || '\2', 'g'),
  '([A-Z0-9])([A-Z][a-z])', '\1' || chr(31) || '\2', 'g'), '([A-Z0-9])([A-Z][a-z])', '\1' || chr(31) || '\2', 'g'), chr(31)) ELSE [p] END AS parts FROM dotted),
camel AS (SELECT w, unnest(CASE WHEN len(parts) > 1 THEN list_concat([p], parts) ELSE parts END) AS x FROM marked),
snake AS (SELECT w, unnest(CASE WHEN contains(x, '_') THEN list_concat([x], string_split(x, '_')) ELSE [x] END) AS x FROM camel),
word_terms AS MATERIALIZED (SELECT w, lower(x) AS term FROM snake WHERE regexp_matches(x, '[^!-/:-@\[-`{-~]')),
tf AS MATERIALIZED (SELECT doc_id, term, sum(n)::BIGINT AS tf FROM words JOIN word_terms USING (w) GROUP BY ALL),
qtf AS MATERIALIZED (SELECT item_id, term, sum(n)::BIGINT AS times FROM qwords JOIN word_terms USING (w) GROUP BY ALL),
lengths AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS dl FROM tf GROUP BY ALL),
stats AS MATERIALIZED (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM lengths)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
raw_idf AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stats),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf FROM raw_idf)"""

#: Names built from parts: type.brand.name, without blanks and number signs; the smallest key stands for equal names.
NAMES_SQL = """
names AS (SELECT translate(concat_ws('.', lower(p_type), p_brand, p_name), '# ', '__') AS fqn, min(p_partkey) AS id FROM part GROUP BY ALL),
roles AS (SELECT fqn, id, ['py:class', 'py:exception', 'py:module', 'py:method', 'py:classmethod', 'py:function', 'py:attribute', 'py:data', 'py:other'][(id % 9 + 1)::INT] AS role FROM names),
alias AS (SELECT id, fqn, role, split_part(fqn, '.', 1) AS module, array_to_string(string_split(fqn, '.')[k:], '.') AS alias
          FROM roles, (SELECT unnest([1, 2, 3]) AS k))"""
PRIORITY_SQL = "CASE role WHEN 'py:class' THEN 0 WHEN 'py:exception' THEN 0 WHEN 'py:module' THEN 0 WHEN 'py:method' THEN 1 WHEN 'py:classmethod' THEN 1 WHEN 'py:function' THEN 2 WHEN 'py:attribute' THEN 3 WHEN 'py:data' THEN 4 ELSE 999 END"
_ROLES = ("py:class", "py:exception", "py:module", "py:method", "py:classmethod", "py:function", "py:attribute", "py:data", "py:other")


def part_names(read):
    """(fqn, id) of the names built from parts."""
    fqn = F.translate(F.concat_ws(".", F.lower("p_type"), "p_brand", "p_name"), "# ", "__")
    return read("part").groupBy(fqn.alias("fqn")).agg(F.min("p_partkey").alias("id"))


def part_symbols(read):
    """Symbol chunks and an inventory over the names, joined to candidates."""
    names = part_names(read)
    chunk = names.select(F.col("id").alias("chunk_id"), F.lit("symbol").alias("chunk_type"), F.array("fqn").alias("symbols"))
    role = F.element_at(F.array(*map(F.lit, _ROLES)), (F.col("id") % 9 + 1).cast("int"))
    inventory = names.select(F.col("fqn").alias("name"), role.alias("role"), T.module_of(F.col("fqn")).alias("module"))
    return symbols.candidates(chunk, inventory)


def symbol_queries(read):
    """Each name whose id is divisible by 100, by its last two segments."""
    return part_names(read).filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.concat_ws(".", F.slice(F.split("fqn", r"\."), 2, 2)).alias("text"))


@query(f"WITH {WORD_SQL} SELECT doc_id, term AS token, tf FROM tf")
def analyze_tokens(read):
    return bm25.term_counts(read("documents"), "doc_id").select("doc_id", F.col("term").alias("token"), "tf")


_KIND = "CASE WHEN regexp_matches({c}, '^[A-Za-z0-9._]*[A-Za-z0-9][A-Za-z0-9._]*$') THEN 'identifier' ELSE 'natural_language' END"


@query(f"SELECT doc_id, {_KIND.format(c='w')} AS query_type, w AS value, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '[\\s\\p{{Z}}]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL UNION ALL SELECT doc_id, {_KIND.format(c='text')}, sha256(text), 1 FROM documents")
def classify_queries(read):
    """Every word of every document, and the whole texts (by their digests)."""
    docs = read("documents")
    words = docs.select("doc_id", F.explode(T.split_words(F.col("text"))).alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))
    whole = docs.select("doc_id", T.classify_query(F.col("text")).alias("query_type"), F.sha2("text", 256).alias("value"), F.lit(1).cast("bigint").alias("n"))
    return words.select("doc_id", T.classify_query(F.col("value")).alias("query_type"), "value", "n").unionByName(whole)


@query(f"WITH {NAMES_SQL} SELECT alias, id, fqn FROM alias")
def name_aliases(read):
    return part_names(read).select(F.explode(T.aliases(F.col("fqn"))).alias("alias"), "id", "fqn")


_SYMBOL_Q = "q AS (SELECT id AS query_id, array_to_string(string_split(fqn, '.')[2:], '.') AS text FROM names WHERE id % 100 = 0)"


@query(f"WITH {NAMES_SQL}, {_SYMBOL_Q} SELECT query_id, id AS chunk_id, fqn, row_number() OVER (PARTITION BY query_id ORDER BY {PRIORITY_SQL}, module, fqn, id) AS rank FROM q JOIN alias ON alias = text")
def symbol_exact(read):
    return symbols.exact(symbol_queries(read), symbols.alias_table(part_symbols(read))).select("query_id", "chunk_id", "fqn", "rank")


def _misspelt(read):
    names = part_names(read).filter("id % 100 = 0")
    at = (F.col("id") / 100 % F.length("fqn")).cast("int") + 1
    return names.select(F.col("id").alias("query_id"), F.concat(F.substring("fqn", F.lit(1), at - 1), F.substring("fqn", at + 1, F.length("fqn"))).alias("text"))


@query()
def symbol_fuzzy(read):
    """Names with one character left out, against all names."""
    return symbols.fuzzy(_misspelt(read), part_symbols(read)).select("query_id", "chunk_id", "score", "rank")


@query()
def symbol_lookup_fallback(read):
    """Aliases and misspelt names: exact hits first, fuzzy ones for the rest."""
    asked = symbol_queries(read).unionByName(_misspelt(read).withColumn("query_id", -F.col("query_id") - 1))
    return symbols.lookup(asked, part_symbols(read)).select("query_id", "used", "chunk_id", "score", "rank")


@query(
    f"""WITH {NAMES_SQL}, q AS (SELECT id AS query_id, left(fqn, (id // 100 % length(fqn))::INT) || substr(fqn, (id // 100 % length(fqn))::INT + 2) AS text FROM names WHERE id % 100 = 0),
    r AS (SELECT query_id, text, n.fqn AS symbol, levenshtein(lower(text), lower(n.fqn)) AS d FROM q JOIN names n ON abs(length(text) - length(n.fqn)) <= 2 WHERE levenshtein(lower(text), lower(n.fqn)) <= 2),
    m AS (SELECT query_id, min(d) AS least, bool_or(symbol = text) AS same FROM r GROUP BY ALL),
    b AS (SELECT r.query_id, min(symbol) AS symbol, count(DISTINCT symbol) AS n FROM r JOIN m ON m.query_id = r.query_id AND d = least GROUP BY ALL)
    SELECT q.query_id, CASE WHEN NOT same AND n = 1 THEN symbol ELSE text END AS rewritten FROM q LEFT JOIN m USING (query_id) LEFT JOIN b USING (query_id)"""
)
def typo_rewrite(read):
    """Misspelt names against all names that are near enough."""
    asked = _misspelt(read)
    near = symbols.near_names(asked, part_names(read).select(F.col("fqn").alias("symbol")))
    return symbols.rewrite_typos(asked.join(near.select("query_id", "symbol"), "query_id", "left"))


@query(
    """SELECT page_id, split_part(url, '#', 1) AS path, CASE WHEN contains(url, '#') THEN substr(url, strpos(url, '#') + 1) END AS anchor,
    regexp_replace(split_part(url, '#', 1), '\\.html$', '') AS key_base FROM pages"""
)
def url_split(read):
    path = T.uri_path(F.col("url"))
    return read("pages").select("page_id", path.alias("path"), T.uri_anchor(F.col("url")).alias("anchor"), T.key_base(path).alias("key_base"))


@query(
    """WITH p AS (SELECT url, split_part(url, '#', 1) AS bare, regexp_replace(url, '[^/]*$', '') AS folder FROM pages),
    pairs AS (SELECT url AS got, bare AS expected FROM p UNION ALL SELECT url, folder FROM p UNION ALL SELECT bare, url FROM p)
    SELECT m.mode, count(*) FILTER (CASE m.mode WHEN 'exact' THEN got = expected WHEN 'strip_anchor' THEN split_part(got, '#', 1) = split_part(expected, '#', 1) ELSE starts_with(got, expected) END) AS n, count(*) AS pairs
    FROM pairs, (SELECT unnest(['exact', 'strip_anchor', 'prefix']) AS mode) m GROUP BY ALL"""
)
def url_match_modes(read):
    """Each URL with its path, its folder, and its path with it, under every mode."""
    p = read("pages").select("url", T.uri_path(F.col("url")).alias("bare"), F.regexp_replace("url", "[^/]*$", "").alias("folder"))
    pairs = p.select(F.inline(F.array(F.struct(F.col("url").alias("got"), F.col("bare").alias("expected")), F.struct(F.col("url").alias("got"), F.col("folder").alias("expected")), F.struct(F.col("bare").alias("got"), F.col("url").alias("expected")))))
    modes = pairs.withColumn("mode", F.explode(F.array(*map(F.lit, ("exact", "strip_anchor", "prefix")))))
    return modes.groupBy("mode").agg(F.count_if(T.url_matches(F.col("mode"), F.col("got"), F.col("expected"))).alias("n"), F.count("*").alias("pairs"))


@query(
    """WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part)
    SELECT p_partkey, slug, 'section:' || slug || CASE WHEN count(*) OVER (PARTITION BY slug) > 1 THEN '-' || (row_number() OVER (PARTITION BY slug ORDER BY p_partkey) - 1) ELSE '' END AS chunk_id FROM s"""
)
def slug_ids(read):
    """Slugs, numbered where several rows share one."""
    from pyspark.sql import Window as W

    s = read("part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_brand", "p_name")).alias("slug"))
    number = F.row_number().over(W.partitionBy("slug").orderBy("p_partkey")) - 1
    suffix = F.when(F.count("*").over(W.partitionBy("slug")) > 1, F.concat(F.lit("-"), number.cast("string"))).otherwise("")
    return s.select("p_partkey", "slug", F.concat(F.lit("section:"), "slug", suffix).alias("chunk_id"))


@query()
def html_chunks(read):
    """The pages' articles, as sections named by their page."""
    html = F.regexp_replace("html", "<article>", F.concat(F.lit('<section id="page-'), F.col("page_id").cast("string"), F.lit('">')))
    pages = read("pages").select(T.uri_path(F.col("url")).alias("path"), F.replace(html, F.lit("</article>"), F.lit("</section>")).alias("html"))
    made = chunks.section_chunks(pages, "3.12")
    return made.select("chunk_id", "chunk_type", "title", "canonical_url", "anchor", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "source_hash")


_DOCS_SQL = """
d AS (SELECT p_partkey, p_partkey // 40 AS page, translate(concat_ws('.', lower(p_type), p_brand, p_name), '# ', '__') || '.k' || p_partkey AS name, p_type, p_name, p_size, p_brand FROM part),
h AS (SELECT page, '<html><body><nav>all parts</nav><section id="list"><h1>Page ' || page || '<a class="headerlink" href="#list">¶</a></h1><p>Parts of one page.</p><p>In ' || count(DISTINCT p_type) || ' types.</p>'
  || string_agg('<dl class="py class"><dt class="sig" id="' || name || '"><em>class</em> <code>' || p_name || '</code>(' || p_size || ')<a class="headerlink" href="#x">¶</a></dt><dd><p>' || p_type || ' in</p><p>' || p_brand || '.</p></dd></dl>', '' ORDER BY p_partkey)
  || '<section><h2>See also: page ' || (page + 1) || '</h2><ul><li>first<li>second</ul></section></section></body></html>' AS html FROM d GROUP BY page)"""


def documentation(read):
    """(inventory, pages): every part as a symbol, forty of them on a page."""
    name = F.concat(F.translate(F.concat_ws(".", F.lower("p_type"), "p_brand", "p_name"), "# ", "__"), F.lit(".k"), F.col("p_partkey").cast("string"))
    d = read("part").select("p_partkey", F.expr("p_partkey div 40").alias("page"), name.alias("name"), "p_type", "p_name", F.col("p_size").cast("string").alias("p_size"), "p_brand")
    path = F.concat(F.lit("library/p"), F.col("page").cast("string"), F.lit(".html"))
    inventory = d.select("name", F.lit("py:class").alias("role"), F.concat(path, F.lit("#"), "name").alias("uri"), T.module_of(F.col("name")).alias("module"))
    item = F.concat(F.lit('<dl class="py class"><dt class="sig" id="'), "name", F.lit('"><em>class</em> <code>'), "p_name", F.lit("</code>("), "p_size", F.lit(')<a class="headerlink" href="#x">¶</a></dt><dd><p>'), "p_type", F.lit(" in</p><p>"), "p_brand", F.lit(".</p></dd></dl>"))
    grouped = d.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("html")))).alias("items"), F.countDistinct("p_type").alias("types"))
    number = F.col("page").cast("string")
    head = F.concat(F.lit('<html><body><nav>all parts</nav><section id="list"><h1>Page '), number, F.lit('<a class="headerlink" href="#list">¶</a></h1><p>Parts of one page.</p><p>In '), F.col("types").cast("string"), F.lit(" types.</p>"))
    tail = F.concat(F.lit("<section><h2>See also: page "), (F.col("page") + 1).cast("string"), F.lit("</h2><ul><li>first<li>second</ul></section></section></body></html>"))
    html = F.concat(head, F.array_join(F.transform("items", lambda x: x["html"]), ""), tail)
    return inventory, grouped.select(path.alias("path"), html.alias("html"))


@query(
    f"""WITH {_DOCS_SQL}, c AS (SELECT 'symbol:' || name AS chunk_id, 'symbol' AS chunk_type, 'k' || p_partkey AS title, 'class ' || p_name || ' (' || p_size || ')' || chr(10) || chr(10) || p_type || ' in ' || p_brand || '.' AS text,
    name AS symbols, 'library/p' || page || '.html#' || name AS canonical_url, name AS anchor, split_part(name, '.', 1) AS parent_module, page FROM d
    UNION ALL SELECT 'section:library/p' || page || '#list', 'section', 'Page ' || page, 'Parts of one page.' || chr(10) || 'In ' || count(DISTINCT p_type) || ' types.', '', 'library/p' || page || '.html#list', 'list', NULL, page FROM d GROUP BY page
    UNION ALL SELECT DISTINCT 'section:library/p' || page || '#see-also-page-' || (page + 1), 'section', 'See also: page ' || (page + 1), 'first' || chr(10) || 'second', '', 'library/p' || page || '.html#see-also-page-' || (page + 1), 'see-also-page-' || (page + 1), NULL, page FROM d)
    SELECT chunk_id, chunk_type, '3.12' AS docs_version, title, text, symbols, canonical_url, anchor, parent_module, 'library/p' || page || '.html' AS source_path, 'sha256:' || sha256(html) AS source_hash FROM c JOIN h USING (page)"""
)
def inventory_chunks(read):
    """An inventory and its pages to chunks."""
    made = chunks.build_chunks(*documentation(read), "3.12")
    return made.withColumn("symbols", F.array_join("symbols", ","))


@query(
    """WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ps FROM documents),
    r AS (SELECT doc_id, string_split(list_reduce(ps, lambda a, x: CASE WHEN length(split_part(a, chr(30), -1)) + length(x) + 1 <= 1500 THEN a || chr(10) || x ELSE a || chr(30) || x END), chr(30)) AS pieces FROM p WHERE len(ps) > 0),
    u AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS piece_no FROM r)
    SELECT doc_id, piece_no::INT AS piece_no, length(piece)::INT AS n_chars, sha256(piece) AS piece_sha256 FROM u"""
)
def paragraph_pack(read):
    pieces = read("documents").select("doc_id", F.posexplode(chunks.pack_paragraphs(F.col("text"), separator="\n")).alias("piece_no", "piece"))
    return pieces.select("doc_id", "piece_no", F.length("piece").alias("n_chars"), F.sha2("piece", 256).alias("piece_sha256"))


@query("SELECT doc_id, sha256(text) AS source_hash, substr(sha1(text), 1, 8) AS fingerprint FROM documents")
def source_hash(read):
    return read("documents").select("doc_id", F.sha2("text", 256).alias("source_hash"), T.prompt_fingerprint(F.col("text")).alias("fingerprint"))


@query(
    """WITH c AS (SELECT conv_id, turn, text || ' [' || turn || ', 2] and [0] [x] [2]' || CASE WHEN turn % 3 = 1 THEN ' [INSUFFICIENT-CONTEXT]  ' ELSE '' END AS text FROM conversations),
    n AS (SELECT conv_id, turn, text, unnest(regexp_extract_all(text, '\\[([\\d,\\s]+)\\]', 1)) AS g, generate_subscripts(regexp_extract_all(text, '\\[([\\d,\\s]+)\\]', 1), 1) AS i FROM c),
    k AS (SELECT conv_id, turn, i, unnest(string_split(g, ',')) AS v, generate_subscripts(string_split(g, ','), 1) AS j FROM n),
    f AS (SELECT conv_id, turn, trim(v)::INT AS v, min(i * 1000 + j) AS pos FROM k GROUP BY ALL)
    SELECT c.conv_id, c.turn, string_agg(v::VARCHAR, ',' ORDER BY pos) AS cites, contains(text, '[INSUFFICIENT-CONTEXT]') AS refused,
    length(regexp_replace(replace(text, '[INSUFFICIENT-CONTEXT]', ''), '\\s+$', '')) AS n_chars FROM c JOIN f USING (conv_id, turn) GROUP BY c.conv_id, c.turn, text"""
)
def extract_citations(read):
    """Citations and refusal marks, put into the turns' texts here as the table has none."""
    mark = F.when(F.col("turn") % 3 == 1, " [INSUFFICIENT-CONTEXT]  ").otherwise("")
    text = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit(", 2] and [0] [x] [2]"), mark)
    c = read("conversations").withColumn("text", text)
    cites = F.array_join(F.transform(T.citations(F.col("text")), lambda x: x.cast("string")), ",")
    return c.select("conv_id", "turn", cites.alias("cites"), T.is_refusal(F.col("text")).alias("refused"), F.length(T.without_refusal(F.col("text"))).alias("n_chars"))


@query(
    """WITH f AS (SELECT doc_id, text, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS flat FROM documents)
    SELECT doc_id, CASE WHEN length(flat) > 280 THEN rtrim(left(flat, 279)) || '…' ELSE flat END AS preview, CASE WHEN length(text) > 1500 THEN rtrim(left(text, 1499)) || '…' ELSE text END AS body,
    CASE WHEN length(flat) > 140 THEN rtrim(left(flat, 137)) || '...' ELSE flat END AS brief FROM f"""
)
def preview_text(read):
    flat = T.preview(F.col("text"), 1 << 30)
    return read("documents").select("doc_id", T.preview(F.col("text")).alias("preview"), T.truncate(F.col("text")).alias("body"), T.truncate(flat, 140, "...").alias("brief"))


@query(
    """WITH r AS (SELECT doc_id, CASE (quality * 2 + toxic) WHEN 2 THEN '```json' || chr(10) || '{"tier": "correct", "reason": "r' || doc_id || '"}' || chr(10) || '```'
      WHEN 3 THEN '{"tier": "hallucination", "reason": "x"}' WHEN 0 THEN ' {"tier": "unknown", "reason": "x"} ' ELSE '{"tier": "wrong"' END AS raw FROM labels)
    SELECT doc_id, CASE WHEN contains(raw, '"correct"') THEN 'correct' WHEN contains(raw, 'hallucination') THEN 'hallucination' END AS tier,
    CASE WHEN contains(raw, '"correct"') THEN 'r' || doc_id WHEN contains(raw, 'hallucination') THEN 'x' END AS reason FROM r"""
)
def judge_replies(read):
    """Judge replies with and without code fences, with unknown tiers and broken JSON, built from the labels."""
    from ..operators.judging import parse_reply

    code = F.col("quality") * 2 + F.col("toxic")
    raw = F.when(code == 2, F.concat(F.lit('```json\n{"tier": "correct", "reason": "r'), F.col("doc_id").cast("string"), F.lit('"}\n```'))).when(code == 3, '{"tier": "hallucination", "reason": "x"}').when(code == 0, ' {"tier": "unknown", "reason": "x"} ').otherwise('{"tier": "wrong"')
    return parse_reply(read("labels").withColumn("raw", raw), "raw").select("doc_id", "tier", "reason")
