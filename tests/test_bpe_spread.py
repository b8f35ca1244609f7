import random

import numpy as np
import pytest

from tesserae.operators import bpe


@pytest.mark.parametrize(("letters", "tried", "at_once"), [("abc", 5, 40), ("abcdefgh", 40, 10**6), ("aab", 1, 7)])
def test_training_on_a_table_takes_few_passes(spark, monkeypatch, letters, tried, at_once):
    rng = random.Random(len(letters))
    words = {"".join(rng.choices(letters, [1 / (i + 1) for i in range(len(letters))], k=rng.randint(1, 9))): rng.randint(1, 9) ** 3 for _ in range(400)}
    want = bpe.train_held(list(words), np.array(list(words.values()), np.int64), 60)
    passes, one = [], bpe._changes
    monkeypatch.setattr(bpe, "_changes", lambda words, before, *more: (passes.append(len(before)), one(words, before, *more))[1])
    table = spark.createDataFrame(list(words.items()), "token string, n long").repartition(3)
    assert bpe.train_spread(table, 60, tried, at_once) == want
    assert len(passes) <= 30  # of 60 merges, however few words they are tried on
    passes.clear()
    assert bpe.train_spread(table, 60) == want and len(passes) == 1  # all words are tried


def test_merges_that_share_no_symbol_may_change_places():
    a, b, c = ("a", "b"), ("c", "d"), ("e", "f")
    assert bpe._agreed([a, b, c], [b, a, c]) == 3
    assert bpe._agreed([a, b], [b, c]) == 0
    assert bpe._agreed([a, ("ab", "c")], [("ab", "c"), a]) == 0  # one makes a symbol of the other
    assert bpe._agreed([a], [a, b]) == 1
