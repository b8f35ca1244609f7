import random

import numpy as np
import pytest

from tesserae.llm import common as c

TEXTS = ["", None, "Hello,  World\t", "one", " \n", "naïve CAFÉ 42_x", "a" * 3000, "x y\x1cz\x0b"]


@pytest.mark.parametrize("alnum", [False, True])
def test_tokens(alnum):
    t = c.Tokens(TEXTS, alnum)
    for i, text in enumerate(TEXTS):
        raw = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "").encode()
        keep = (lambda b: b > 127 or chr(b).isalnum()) if alnum else (lambda b: b not in b" \t\n\r\x0b\x0c")
        words = "".join(chr(b) if keep(b) else "\0" for b in raw).split("\0")
        want = [bytes(map(ord, w)) for w in words if w]
        mine = range(t.first[i], t.first[i + 1])
        assert [bytes(t.data[t.start[k] : t.end[k]]) for k in mine] == want and all(t.text[k] == i for k in mine)
        assert [int(t.hash[k]) for k in mine] == [int(c.Tokens([w]).hash[0]) for w in want]


def test_hashes_of_other_words_differ():
    rng = random.Random(1)
    words = {"".join(rng.choices("abAB01é ", k=rng.randint(1, 9))).replace(" ", "_").lower() for _ in range(5000)}
    assert len(np.unique(c.Tokens([" ".join(words)]).hash)) == len(words)


def test_batches_cover_all_texts():
    texts = ["x" * n for n in (5, 1, 30, 0, 2, 2)] + [None]
    ranges = list(c.batches_by_bytes(texts, 6))
    assert ranges[0][0] == 0 and ranges[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert list(c.batches_by_bytes([])) == [(0, 0)]


def test_tables_are_written_and_cleaned_up(spark):
    c.clean_up(spark)
    df = c.materialize(spark.range(5), "t")
    assert df.count() == 5 and c.shared_folder(spark).split("/")[-1] in df.inputFiles()[0]
    assert c.clean_up(spark) == 1 and c.clean_up(spark) == 0
