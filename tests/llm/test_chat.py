import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.llm import chat as m

PIECES = ["[INST]", "[/INST]", "</s>", "<s>", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]", "[\\INST]", "<\\\\/s>", "\\", "<", "[", "/", "ok", "é", "\n", "s>", "INST]", "\U0001f600"]
texts = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


@given(texts)
def test_escaping_is_reversible_and_hides_control_strings(text):
    hidden = m.escape(text)
    assert m.unescape(hidden) == text and not re.search(r"</?s>|\[/?(INST|SYS|ROLE|TEXT)\]", hidden)


@settings(max_examples=200)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[TEXT]"]), texts), max_size=6), st.integers(0, 6))
def test_windows_are_parsed_back(turns, repeated):
    text, loss = m.render(turns, repeated)
    assert m.parse(text) == turns
    assert [m.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns[repeated:] if r == "assistant" and t]


@settings(max_examples=300)
@given(st.booleans(), st.lists(st.integers(2, 12), max_size=30), st.integers(1, 40), st.integers(0, 15))
def test_windows_fit_and_cover_all_turns_once(has_system, sizes, budget, history):
    turns = [(False, "system", "s", 5)] * has_system + [(False, "user", str(i), n) for i, n in enumerate(sizes)]
    size = {t: n for _, _, t, n in turns}
    room, seen = max(budget - 5, budget // m.LEAST_ROOM) if has_system else budget, []
    for k, (chosen, repeated, n) in enumerate(m.windows(turns, budget, history)):
        body = chosen[1:] if has_system else chosen
        old = repeated - (has_system and k > 0)
        assert n == sum(size[t] for _, t in chosen) and (not has_system or chosen[0][0] == "system")
        used = sum(size[t] for _, t in body)
        assert used <= room or len(body) == 1 and old == 0
        assert sum(size[t] for _, t in body[:old]) <= history
        assert [t for _, t in body[:old]] == seen[len(seen) - old :]  # the turns just before
        seen += [t for _, t in body[old:]]
        rest = [str(i) for i in range(len(seen), len(sizes))]
        assert not rest or used + size[rest[0]] > room  # no turn more would have fitted
    assert seen == [str(i) for i in range(len(sizes))]


def plain(rows):
    out, ids = {}, {r[0] for r in rows}
    for conv in ids:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(6)
    text = lambda: rng.choice([None, "", " ".join(rng.choices(PIECES + ["word"] * 20, k=rng.randint(0, 30)))])
    rows = []
    for c in range(40):
        roles = ["system"] * (c % 3 == 0) + ["user", "assistant"] * rng.randint(0, 12) + [rng.choice(["user", "tool", None])] * (c % 2)
        rows += [(c, t * (1 + c % 4), role, text()) for t, role in enumerate(roles)]
    rows += [(50, 0, "system", "only a system turn"), (51, 0, "assistant", "x " * 3000), (51, 1, "assistant", "y"), (None, 1, "user", "a"), (None, None, "assistant", "first")]
    rows += [(52, 3, "assistant", "twice")] * 2 + [(52, 3, "user", "tie"), (53, 0, "system", "w " * 500), (53, 1, "user", "q"), (53, 2, "assistant", "a")]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(60, 10**12 + t, "system" if t == 0 else ["assistant", "user"][t % 2], f"long {t} </s>") for t in range(700)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("budget", "history", "long"), [(m.BUDGET, m.HISTORY, m.LONG), (40, 12, 4096), (40, 12, 6), (1, 0, 100)])
def test_digests_are_those_of_the_input(spark, budget, history, long):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, size string, segment int").repartition(5)
    got = m.formatted_digests(df, budget, history, long=long).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == plain(rows) and len(got) == len(plain(rows))
    made = m.materialize(m.format_conversations(df, budget, history, long=long), "windows")
    assert sorted(map(str, m.read_back(made.repartition(3)).collect())) == sorted(map(str, got))
    if long == 6:
        assert made.filter("conv_id = 60").select("segment").distinct().count() > 100
        assert made.filter("conv_id = 60 AND text NOT LIKE '<s>[SYS]long 0%'").count() == 0
    if budget == 40:
        assert made.filter("n_tokens > 40 AND NOT over_budget").count() == 0 and made.filter("window > 0 AND repeated = 0").count() < made.filter("window > 0").count()


def test_tokens_can_be_given(spark):
    df = spark.createDataFrame([(1, t, "user", "many words of text") for t in range(10)], "conv_id string, turn int, role string, text string")
    assert m.format_conversations(df, 10, 0, F.lit(5)).count() == 5
    assert m.format_conversations(df.limit(0)).count() == 0 and m.formatted_digests(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        m.format_conversations(df, 0)
