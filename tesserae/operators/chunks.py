"""Documents to chunks: paragraph packing, the HTML chunker, and prompts from chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.jsonl import CHUNK as CHUNK_SCHEMA
from . import symbols

MAX_CHARS = 1500  # fixed value of the behaviour that is reproduced


def pack_paragraphs(text: Column, limit: int = MAX_CHARS, separator: str = "\n\n") -> Column:
    """Paragraphs joined greedily while a piece stays within limit code points; a longer one stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def add(state: Column, p: Column) -> Column:
        fits = F.length(state["held"]) + F.length(p) + len(separator) <= limit
        return F.when(state["held"].isNull(), F.struct(state["done"].alias("done"), p.alias("held"))).when(
            fits, F.struct(state["done"].alias("done"), F.concat(state["held"], F.lit(separator), p).alias("held"))
        ).otherwise(F.struct(F.concat(state["done"], F.array(state["held"])).alias("done"), p.alias("held")))

    paragraphs = F.filter(F.split(text, separator), lambda p: F.trim(p) != "")
    finish = lambda s: F.when(s["held"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["held"])))
    return F.aggregate(paragraphs, start, add, finish)


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()

    def walk(self, skip=lambda node: False) -> Iterator:
        """Nodes and strings below this one in order, without what lies in skipped nodes."""
        todo = self.children[::-1]
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                yield at
            elif not skip(at):
                yield at
                todo += at.children[::-1]

    def find(self, *tags: str) -> _Node | None:
        return next((x for x in self.walk() if not isinstance(x, str) and x.tag in tags), None)

    def text(self, separator: str, skip=lambda node: False) -> str:
        """The trimmed strings that are not blank, joined."""
        return separator.join(t for t in (x.strip() for x in self.walk(lambda n: n.tag in _Tree.NO_TEXT or skip(n)) if isinstance(x, str)) if t)


class _Tree(HTMLParser):
    """A tree of the elements; ends that HTML lets one leave out are put in."""

    VOID = frozenset(("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"))
    NO_TEXT = frozenset(("script", "style", "template"))
    #: An opening tag -> the open elements that it ends, and those at which the search for them stops.
    ENDS = {
        "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)),
        **dict.fromkeys(("p", "div", "section", "article", "ul", "ol", "dl", "pre", "table", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "footer"), (("p",), ("section", "div", "dd", "li", "td", "article", "blockquote"))),
    }

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def _close(self, tags, stops=()) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in self.ENDS:
            self._close(*self.ENDS[tag])
        node = _Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        self._close((tag,))

    def handle_data(self, data):
        self.open[-1].children.append(data)


HEADINGS = ("h1", "h2", "h3")
_is_mark = lambda node: node.tag == "a" and node.has_class("headerlink")


def packed(text: str, limit: int = MAX_CHARS) -> list[str]:
    """A text as it is if it is short enough; else its blocks between blank lines, joined while they fit."""
    out: list[str] = []
    for block in text.split("\n\n") if len(text) > limit else [text]:
        if out and (not out[-1] or len(out[-1]) + len(block) + 2 <= limit):
            out[-1] = f"{out[-1]}\n\n{block}" if out[-1] else block
        else:
            out.append(block)
    return [piece for piece in out if piece]


def _sections(root: _Node) -> Iterator[tuple[str, str, list[str]]]:
    """(title, key, pieces) of each section with a heading and text of its own: without its heading, symbols' lists and
    the sections inside it."""
    for section in (n for n in root.walk() if not isinstance(n, str) and n.tag == "section"):
        heading = section.find(*HEADINGS)
        title = heading.text("", _is_mark) if heading else ""
        if not title:
            continue
        own = lambda n, heading=heading: n is heading or n.tag == "section" or n.tag == "dl" and n.has_class("py")
        text = section.text("\n", own)
        if text:
            key = section.attrs.get("id")
            yield title, T.slug_of(title) if key is None else key, packed(text)


def _symbols(root: _Node) -> dict[str, tuple[str, str]]:
    """Anchor of a term -> its signature and the body of the list of a symbol that it is in; the first of equal ones."""
    out: dict[str, tuple[str, str]] = {}
    todo: list[tuple[_Node, _Node | None]] = [(root, None)]
    while todo:
        node, around = todo.pop()
        if node.tag == "dl" and node.has_class("py"):
            around = node
        if node.tag == "dt" and node.attrs.get("id") and node.attrs["id"] not in out:
            body = around.find("dd") if around else None
            out[node.attrs["id"]] = node.text(" ", _is_mark), body.text(" ", _is_mark) if body else ""
        todo += [(c, around) for c in node.children[::-1] if not isinstance(c, str)]
    return out


def _distinct(ids: list[str]) -> list[str]:
    """The ids, the second and further ones of a kind numbered."""
    seen: dict[str, int] = {}
    out = []
    for x in ids:
        seen[x] = seen.get(x, 0) + 1
        out.append(x if seen[x] == 1 else f"{x}~{seen[x]}")
    return out


def page_chunks(path: str, html: str, names: list[dict], version: str) -> list[dict]:
    """The chunks of one page: of each symbol (name, uri, anchor, module) in the order given, then of the sections."""
    root = _Tree(html).root
    same = {"docs_version": version, "source_path": path, "source_hash": "sha256:" + hashlib.sha256(html.encode()).hexdigest()}
    terms = _symbols(root) if names else {}
    rows = []
    for s in names:
        signature, body = terms.get(s["name"], ("", ""))
        rows.append(same | {"chunk_id": f"symbol:{s['name']}", "chunk_type": "symbol", "title": s["name"].rpartition(".")[2], "text": f"{signature}\n\n{body}", "symbols": [s["name"]], "canonical_url": s["uri"], "anchor": s["anchor"], "parent_module": s["module"]})
    for title, key, pieces in _sections(root):
        for i, piece in enumerate(pieces):
            name = f"section:{path.removesuffix('.html')}#{key}" + (f"-{i}" if len(pieces) > 1 else "")
            rows.append(same | {"chunk_id": name, "chunk_type": "section", "title": title, "text": piece, "symbols": [], "canonical_url": f"{path}#{key}", "anchor": key, "parent_module": None})
    for row, name in zip(rows, _distinct([r["chunk_id"] for r in rows]), strict=True):
        row["chunk_id"] = name
    return rows


def _chunks_of(pages: DataFrame, version: str) -> DataFrame:
    """pages (path, html, names: array of symbols)."""
    fields = [f.strip().split(" ") for f in CHUNK_SCHEMA.split(",")]
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                made = page_chunks(row["path"] or "", row["html"] or "", row["names"] or [], version)
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema)

    return pages.select("path", "html", "names").mapInArrow(run, CHUNK_SCHEMA)


def symbol_entries(inventory: DataFrame) -> DataFrame:
    """inventory (name, role, uri, module) -> path, names: the symbols of each page by name; of several entries of a
    name the first by role and URI. A page's symbols are as many as its terms, so they fit a row."""
    first = F.min(F.struct(symbols.role_priority(F.col("role")).alias("p"), "uri", "module")).alias("e")
    once = inventory.groupBy("name").agg(first).select("name", "e.uri", "e.module")
    entry = F.struct("name", "uri", T.uri_anchor(F.col("uri")).alias("anchor"), "module")
    return once.groupBy(T.uri_path(F.col("uri")).alias("path")).agg(F.array_sort(F.collect_list(entry)).alias("names"))


def build_chunks(inventory: DataFrame, pages: DataFrame, version: str) -> DataFrame:
    """inventory (name, role, uri, module), pages (path, html; one row a path) -> the chunks of the pages that hold
    symbols, with unique ids: a chunk of every symbol, with its term's signature and body (both empty if the page has
    no such term), and the pieces of the sections. A symbol whose page is missing has none; see missing_pages."""
    return _chunks_of(pages.join(symbol_entries(inventory), "path"), version)


def missing_pages(inventory: DataFrame, pages: DataFrame) -> DataFrame:
    """The paths that the inventory names and no page has."""
    return symbol_entries(inventory).select("path").join(pages.select("path"), "path", "left_anti")


def section_chunks(pages: DataFrame, version: str) -> DataFrame:
    """pages (path, html) -> the chunks of all their sections."""
    return _chunks_of(pages.withColumn("names", F.array().cast("array<struct<name:string,uri:string,anchor:string,module:string>>")), version)


def indexed_text(kind: str) -> Column:
    """bm25: text and symbols; dense and rerank: title and text."""
    return F.concat_ws("\n\n", "text", F.array_join("symbols", " ")) if kind == "bm25" else F.concat_ws("\n\n", "title", "text")


def prompt_blocks(hits: DataFrame, chars: int | None = 600) -> DataFrame:
    """hits (query_id, rank, title, text) -> query_id, prompt: blocks in order of rank, with their ranks; texts whole for
    None."""
    body = F.col("text") if chars is None else F.substring("text", 1, chars)
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), body)
    made = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    return made.select("query_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n---\n").alias("prompt"))


#: What a model is told before the question; callers may say it in their own way.
SYSTEM = (
    "Answer from the numbered blocks of the CONTEXT only, and end every sentence that states a fact with the number of "
    f"its block, as in [1]. If no block bears on the question, answer {T.REFUSAL_MARKER} and nothing else."
)


def grounded_prompts(queries: DataFrame, hits: DataFrame, system: str = SYSTEM) -> DataFrame:
    """queries (query_id, text, query_type or null), hits (query_id, rank, title, text) -> query_id, system, user: the
    hint for the query's type, the context with whole texts, and the question; what is missing is left out."""
    places = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    joined = queries.join(prompt_blocks(places, None), "query_id", "left")
    context = F.concat(F.lit("CONTEXT:\n"), "prompt")  # null without hits
    user = F.concat_ws("\n\n", T.structure_hint(F.col("query_type")), context, F.concat(F.lit("QUESTION: "), "text"))
    return joined.select("query_id", F.lit(system).alias("system"), user.alias("user"))
