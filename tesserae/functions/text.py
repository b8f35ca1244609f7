"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the behaviour that is reproduced.
REFUSAL_MARKER = "[INSUFFICIENT-CONTEXT]"
BROKEN_PATTERNS = ("[INSUFFICIENT-CONTEXT]", "I am unable", "I cannot", "I do not have")
MIN_ANSWER_CHARS = 30
STRUCTURE_HINTS = {
    "identifier": "Use this answer structure: signature -> brief description -> example -> source citation.",
    "natural_language": "Use this answer structure: definition -> context -> example -> source citation.",
    "comparison": "Use this answer structure: bullet points for each side -> key differences -> recommended scenarios -> source citations.",
    "howto": "Use this answer structure: numbered steps -> code example -> source citation.",
    "out_of_scope": "If the question is out of scope for these documents, refuse.",
}
TIERS = ("correct", "partial", "wrong", "hallucination", "refused")
CAMEL = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z0-9])(?=[A-Z][a-z])"
IDENTIFIER = r"^[A-Za-z0-9._]*[A-Za-z0-9][A-Za-z0-9._]*$"


def split_words(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def is_cut(word: Column) -> Column:
    """Whether the analyzer cuts a word: a test without look-around, so that most words cost one pass."""
    return word.rlike(r"[._]|[a-z][A-Z]|[A-Z0-9][A-Z][a-z]")


def analyze_word(word: Column) -> Column:
    """Terms of one word, in order: cut at dots, then at case changes, then at underscores (whole forms first), lower
    case, without empty terms and terms of ASCII punctuation only. A word that nothing cuts is passed on at once."""
    camel = lambda x: F.when(x.rlike(CAMEL), F.concat(F.array(x), F.split(x, CAMEL))).otherwise(F.array(x))
    snake = lambda x: F.when(F.contains(x, F.lit("_")), F.concat(F.array(x), F.split(x, "_"))).otherwise(F.array(x))
    parts = F.flatten(F.transform(F.flatten(F.transform(F.split(word, r"\."), camel)), snake))
    parts = F.when(is_cut(word), parts).otherwise(F.array(word))
    return F.filter(F.transform(parts, F.lower), lambda x: x.rlike(r"[^\p{Punct}]"))


def analyze(text: Column) -> Column:
    """Terms of a text, in order."""
    return F.flatten(F.transform(split_words(text), analyze_word))


def is_identifier(text: Column) -> Column:
    return text.rlike(IDENTIFIER)


def classify_query(text: Column) -> Column:
    return F.when(is_identifier(text), "identifier").otherwise("natural_language")


def citations(text: Column) -> Column:
    """Numbers inside [1] or [2, 3] marks, in order of first appearance."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([\d,\s]+)\]"), 1)
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.regexp_replace(x, r"\s+", ""))))
    return F.array_distinct(F.transform(F.filter(numbers, lambda n: n.rlike(r"^\d+$")), lambda n: n.cast("int")))


def cited_chunks(cites: Column, chunk_ids: Column) -> Column:
    """The chunks that citations name, by place in the list (from 1), in order of citation; others are passed over."""
    return F.transform(F.filter(cites, lambda n: (n >= 1) & (n <= F.size(chunk_ids))), lambda n: F.element_at(chunk_ids, n))


def is_refusal(text: Column) -> Column:
    return F.contains(text, F.lit(REFUSAL_MARKER))


def without_refusal(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(REFUSAL_MARKER), F.lit("")), r"\s+$", "")


def preview(text: Column, limit: int = 280) -> Column:
    """White space collapsed, cut to limit code points with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def truncate(text: Column, limit: int = 1500, mark: str = "…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - len(mark))), F.lit(mark))).otherwise(text)


def strip_code_fence(text: Column) -> Column:
    """The text inside a leading ``` fence, trimmed; other texts trimmed."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    flat = bare(text)
    inner = F.regexp_replace(F.regexp_replace(flat, r"^```[^\n]*\n", ""), r"```$", "")
    return F.when(F.startswith(flat, F.lit("```")), bare(inner)).otherwise(flat)


def prompt_fingerprint(prompt: Column) -> Column:
    return F.substring(F.sha1(prompt), 1, 8)


def pretokens(text: Column) -> Column:
    """Words with apostrophes, and every other visible character alone."""
    return F.regexp_extract_all(text, F.lit(r"(?U)([\w']+|[^\w\s'])"), 1)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")


def slug_of(text: str) -> str:
    """slug, of one string."""
    return re.sub("[^a-z0-9]+", "-", text.lower()).strip("-")


def uri_path(uri: Column) -> Column:
    return F.substring_index(uri, "#", 1)


def uri_anchor(uri: Column) -> Column:
    """What follows the first #; empty after a final one, null without."""
    at = F.instr(uri, "#")
    return F.when(at > 0, F.substring(uri, at + 1, F.length(uri)))


def key_base(path: Column) -> Column:
    return F.regexp_replace(path, r"\.html$", "")


def url_matches(mode: Column | str, got: Column, expected: Column) -> Column:
    """exact, strip_anchor (up to the first #, both sides) or prefix (got starts with expected)."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.when(mode == "exact", got == expected).when(mode == "strip_anchor", uri_path(got) == uri_path(expected)).when(mode == "prefix", F.startswith(got, expected))


def public_url(version: str, url: Column) -> Column:
    return F.concat(F.lit(f"https://docs.python.org/{version}/"), url)


def aliases(name: Column) -> Column:
    """All dotted suffixes of a name, longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def reject_reason(answer: Column, refused: Column, require_citation: bool = True) -> Column:
    """Why an answer is no training example, the first reason that holds; null if it is one."""
    flat = F.regexp_replace(answer, r"^\s+|\s+$", "")
    out = F.when(refused, "refused").when(flat == "", "empty").when(F.length(flat) < MIN_ANSWER_CHARS, "too_short")
    for p in BROKEN_PATTERNS:
        out = out.when(F.contains(F.lower(answer), F.lit(p.lower())), f"matches:<{p}>")
    return out.when(~answer.rlike(r"\[\d+\]"), "no_citation") if require_citation else out


def expand_inventory_uri(uri: Column, name: Column) -> Column:
    """A $ in an inventory's URI stands for the symbol's name."""
    return F.replace(uri, F.lit("$"), name)


def module_of(name: Column) -> Column:
    """First dotted segment; null for a name without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", 1))


def served_version(html: Column) -> Column:
    """The version number in a page's title."""
    found = F.regexp_extract(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\b(\d+\.\d+\.\d+)\b", 1)
    return F.when(found != "", found)


def is_question(text: Column) -> Column:
    """Whether a written question is usable: filled, and with a question mark."""
    return (F.trim(text) != "") & F.contains(text, F.lit("?"))


def flatten_messages(messages: Column) -> Column:
    """An array of messages as one prompt."""
    return F.concat(F.array_join(messages, "\n\n"), F.lit("\n"))


def structure_hint(query_type: Column) -> Column:
    """The instruction for a query's type; null for others."""
    return F.create_map(*[F.lit(x) for pair in STRUCTURE_HINTS.items() for x in pair])[query_type]
