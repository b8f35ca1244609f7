"""Chat formatting into token-budgeted windows, with a mask of what counts in the loss.

A conversation becomes one or more texts ("windows") of a bounded number of tokens. Prefix sums of the turns' tokens
choose spans of whole turns: a window takes new turns while they fit, and begins with the system turn and with as many
of the turns just before as a smaller budget allows. Only assistant turns that are new in a window are in its loss mask,
so every assistant turn counts once in all windows together, and repeated ones are context.

Conversations meet by (conv_id, segment), ordered, and are formatted as they stream by: a task holds one window and its
history. Conversations of more than LONG turns are cut into segments of about that many first, so that none is one
task; each segment repeats the system turn, and history doesn't reach from one segment into the next.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import WORD, broadcast_if_small, materialize

#: Tokens of a window, and of the turns that it may repeat besides the system turn.
BUDGET, HISTORY = 1024, 256
#: A system turn leaves this part of the budget to others at least.
LEAST_ROOM = 4
#: Turns from which on a conversation is cut into segments.
LONG = 4096

# The control strings of the template. None holds a bracket but as its first character.
BEGIN = "<s>"
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
ROLE, TEXT, ROLE_END = "[ROLE]", "[TEXT]", "[/ROLE]"

_CONTROL = r"(/?(?:s>|(?:INST|SYS|ROLE|TEXT)\]))"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"\[SYS\](?P<system>.*?)\[/SYS\]|\[INST\](?P<user>.*?)\[/INST\]|\[ROLE\](?P<role>.*?)\[TEXT\](?P<other>.*?)\[/ROLE\]|(?P<assistant>.*?)</s>", re.S)

WINDOW = "segment bigint, window bigint, text string, loss array<struct<start: int, end: int>>, repeated int, n_turns int, n_tokens bigint, over_budget boolean"
DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"


def escape(text: str) -> str:
    """A backslash more inside everything that is a control string, or one with backslashes after its bracket."""
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def turn_tokens(text: Column) -> Column:
    """Words, and two for the marks of the turn. Any count of a real tokenizer serves as well."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint") + 2


def render(turns: list[tuple[str, str]], repeated: int) -> tuple[str, list[tuple[int, int]]]:
    """(role, text) of a window's turns -> its text, and the ranges of code points that the texts of its assistant turns
    after the first `repeated` turns take."""
    out, loss, at = [BEGIN], [], len(BEGIN)
    for k, (role, text) in enumerate(turns):
        opens, closes = MARKS.get(role) or (ROLE + escape(role) + TEXT, ROLE_END)
        body = escape(text)
        if role == "assistant" and k >= repeated and body:
            loss.append((at + len(opens), at + len(opens) + len(body)))
        out += [opens, body, closes]
        at += len(opens) + len(body) + len(closes)
    return "".join(out), loss


def parse(window: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered window."""
    out, at = [], len(BEGIN)
    while at < len(window):
        m = _TURN.match(window, at)
        if m is None:
            raise ValueError("not a rendered window")
        role = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["other"])) if role == "other" else (role, unescape(m[role])))
        at = m.end()
    return out


def windows(turns: Iterable[tuple[bool, str, str, int]], budget: int = BUDGET, history: int = HISTORY) -> Iterator[tuple]:
    """turns (repeats an earlier segment's, role, text, tokens) of one segment, in order -> (turns, how many of them are
    repeats, tokens) of each window. A turn that is larger than the room of a window stands in one without history."""
    system, room, told = [], budget, False
    held: list[tuple[str, str]] = []  # the window's new turns, and before them what may be repeated
    ends = [0]  # prefix sums: ends[i] tokens before held[i]
    lead = first = 0  # where the window and its new turns begin in held

    def made():
        used = sum(size for *_, size in system)
        return [(r, t) for r, t, _ in system] + held[lead:], (len(system) if told else 0) + first - lead, used + ends[-1] - ends[lead]

    for k, (copied, role, text, size) in enumerate(turns):
        if k == 0 and role == "system":
            system, told, room = [(role, text, size)], copied, max(budget - size, budget // LEAST_ROOM)
            continue
        if len(held) > first and ends[-1] + size - ends[lead] > room:
            yield made()
            told, first = True, len(held)
            old = bisect_left(ends, ends[first] - history)
            held, ends, first = held[old:], ends[old:], first - old
            lead = bisect_left(ends, ends[first] - min(history, room - size)) if size <= room else first
        held.append((role, text))
        ends.append(ends[-1] + size)
    if len(held) > first or system and not told:
        yield made()


def _in_order(batches, columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _by_key(rows: Iterable[tuple], n: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with the same first n values, without holding them."""
    return groupby(rows, lambda r: r[:n])


#: Characters of output that a task gathers before it hands them on.
_GATHER = 2 << 20


def _batches(rows: Iterable[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + (len(row[text]) if text is not None else 0)
        if size >= _GATHER:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _turns(conversations: DataFrame, tokens: Column | None) -> DataFrame:
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *([tokens.alias("size")] if tokens is not None else []))
    return rows if tokens is not None else rows.withColumn("size", turn_tokens(F.col("text")))


def _long(rows: DataFrame, long: int) -> tuple[DataFrame, int]:
    """The conversations of more than `long` turns, with what cuts them, and how many they are."""
    found = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.min(F.struct("turn", "role")).alias("head")).filter(F.col("n") > long)
    width = (F.col("high").cast("double") - F.col("low") + 1) / F.ceil(F.col("n") / F.lit(float(long)))
    found = materialize(found.select(F.col("conv_id").alias("_conv"), "low", "high", F.greatest(F.ceil(width).cast("double"), F.lit(1.0)).alias("width"), "head"), "chat-long")
    return found, found.count()


def _segments(rows: DataFrame, cut: DataFrame, n: int) -> DataFrame:
    """The turns of long conversations with their segment, and the system turn again in every further segment."""
    known = broadcast_if_small(cut, n)
    of = lambda turn: F.coalesce(F.floor((turn.cast("double") - F.col("low")) / F.col("width")), F.lit(0)).cast("bigint")
    mine = rows.join(known, rows["conv_id"].eqNullSafe(known["_conv"]))
    parts = mine.withColumn("segment", of(F.col("turn"))).withColumn("copied", F.lit(False))
    is_head = (F.col("role") == "system") & (F.col("head.role") == "system") & F.col("turn").eqNullSafe(F.col("head.turn"))
    heads = mine.filter(is_head).groupBy("conv_id", "low", "high", "width").agg(F.min(F.struct("text", "size")).alias("s"))
    more = heads.withColumn("segment", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(of(F.col("high")), F.lit(1))))).filter(F.col("segment") <= of(F.col("high")))
    columns = ["conv_id", "segment", "copied", "turn", "role", "text", "size"]
    copies = more.select("conv_id", "segment", F.lit(True).alias("copied"), F.lit(None).cast("bigint").alias("turn"), F.lit("system").alias("role"), "s.text", "s.size")
    return parts.select(*columns).unionByName(copies.select(*columns))


def _formatted(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """rows with segment and copied -> windows, those of a segment in order in one partition."""
    ddl = f"conv_id {dict(rows.dtypes)['conv_id']}, {WINDOW}"
    schema = _schema(ddl)

    def run(batches):
        def made():
            for (conv_id, segment), turns in _by_key(_in_order(batches, ["conv_id", "segment", "copied", "role", "text", "size"]), 2):
                for k, (chosen, repeated, n) in enumerate(windows((t[2:] for t in turns), budget, history)):
                    text, loss = render(chosen, repeated)
                    yield conv_id, segment, k, text, [{"start": a, "end": b} for a, b in loss], repeated, len(chosen) - repeated, n, n > budget

        return _batches(made(), schema, 3)

    # a segment that only holds the copy of a system turn has no row of its own: windows() yields none for it
    return rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", F.desc("copied"), "turn", "role", "text").mapInArrow(run, ddl)


def _flows(conversations: DataFrame, budget: int, history: int, tokens: Column | None, long: int) -> tuple[DataFrame, DataFrame | None]:
    if budget < 1 or history < 0 or long < 1:
        raise ValueError("budget and long must be 1 at least, history 0")
    rows = _turns(conversations, tokens)
    cut, n = _long(rows, long)
    whole = lambda r: r.select("conv_id", F.lit(0).cast("bigint").alias("segment"), F.lit(False).alias("copied"), "turn", "role", "text", "size")
    if not n:
        return _formatted(whole(rows), budget, history), None
    known = broadcast_if_small(cut.select("_conv"), n)
    short = rows.join(known, rows["conv_id"].eqNullSafe(known["_conv"]), "left_anti")
    return _formatted(whole(short), budget, history), _formatted(_segments(rows, cut, n), budget, history)


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None, long: int = LONG) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> a row for each window: conv_id, segment, window (counted from 0 in its
    segment), text, loss (ranges of code points), repeated and n_turns (turns that it repeats, and new ones), n_tokens,
    over_budget (a single turn, or the system turn, is too large).

    Turns are ordered by turn, role and text. A first turn of the role system is the system turn. A null text or role
    counts as empty; a null turn comes first; rows with a null conv_id are one conversation; repeated rows are turns of
    their own. Roles other than system, user and assistant have marks that name them. tokens counts each turn (turn_tokens
    by default). An empty table gives no windows. Texts are never cut. Other columns are ignored."""
    short, cut = _flows(conversations, budget, history, tokens, long)
    return short if cut is None else short.unionByName(cut)


def _read_back(formatted: DataFrame) -> DataFrame:
    """Windows that stand in order in their partition -> a row of digests for each conversation, from nothing but text,
    loss and repeated."""
    ddl = f"conv_id {dict(formatted.dtypes)['conv_id']}, {DIGEST}"
    schema = _schema(ddl)

    def run(batches):
        def made():
            for (conv_id,), rows in _by_key(_in_order(batches, ["conv_id", "text", "loss", "repeated"]), 1):
                turns, answers, n, loss, chars, k = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                for _, text, ranges, repeated in rows:
                    for role, said in parse(text)[repeated:]:
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    for r in ranges:
                        part = unescape(text[r["start"] : r["end"]])
                        answers.update(part.encode())
                        loss += len(part)
                    chars += len(text)
                    k += 1
                yield conv_id, n, turns.hexdigest(), loss, answers.hexdigest(), chars, k

        return _batches(made(), schema)

    return formatted.mapInArrow(run, ddl)


def read_back(formatted: DataFrame) -> DataFrame:
    """The windows of format_conversations, read from anywhere and in any order -> conv_id, n_turns, turns_sha256 (of role,
    newline, text, newline per turn), loss_chars, loss_sha256 (of the unescaped text under the mask), formatted_chars
    and n_windows. A digest of a whole conversation is a sequence by its nature; it takes a task the time, and no memory."""
    return _read_back(formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window"))


def formatted_digests(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None, long: int = LONG) -> DataFrame:
    """Formats and reads back. The windows of a conversation that is one segment are read where they were made; those of
    longer ones meet again."""
    short, cut = _flows(conversations, budget, history, tokens, long)
    return _read_back(short) if cut is None else _read_back(short).unionByName(read_back(cut))
