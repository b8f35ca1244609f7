"""Token counts with a whole-token shortcut.

Offline, once: every vocabulary string that ends a word is encoded alone by the library; those that give exactly one
token are proven whole. Per document: the text is normalised and cut into pre-tokens as the tokenizer's file says;
distinct pre-tokens in the proven set count one, and only the rest go through the library's merges, each distinct one
once per task. A text that contains the string of an added token is given to the library as it is.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_texts

LIMIT = 2048
#: Distinct merged pre-tokens that a task remembers before it starts anew.
MEMORY = 300_000

_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII = re.compile(_SUFFIXES + r"|[a-z]+|[0-9]|[^a-z0-9\x20\x09-\x0D]+")


def _pattern():
    import regex

    return regex.compile(_SUFFIXES + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, then the others in order.
_PLAIN = (*range(33, 127), *range(161, 173), *range(174, 256))
_BYTE = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(_PLAIN)))}


def word_of(symbol: str, end: str = "</w>") -> str | None:
    """The text of a byte-level vocabulary symbol that ends a word; None if it is no UTF-8 text."""
    if not symbol.endswith(end):
        return None
    try:
        return bytes(_BYTE[c] for c in symbol.removesuffix(end)).decode()
    except (KeyError, UnicodeDecodeError):
        return None


def prove_whole(tokenizer) -> list[str]:
    """Pre-tokens that the library, given each alone, encodes as one token, and that pre-tokenise to themselves."""
    pattern = _pattern()
    words = [w for w in map(word_of, tokenizer.get_vocab(with_added_tokens=False)) if w and pattern.findall(w) == [w]]
    normal = tokenizer.normalizer
    words = [w for w in words if normal.normalize_str(w) == w]
    return sorted(w for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class PieceCounter:
    """Counts tokens of texts; from the tokenizer's JSON and the proven words."""

    def __init__(self, spec: str, whole: list[str]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = dict.fromkeys(whole, 1)
        self.merged: dict[str, int] = {}
        self.pattern = _pattern()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def words(self, text: str) -> list[str]:
        return _ASCII.findall(text.lower()) if text.isascii() else self.pattern.findall(self.tokenizer.normalizer.normalize_str(text))

    def counts(self, texts: list[str | None]) -> list[int]:
        bags: list[Counter | int] = []
        for text in texts:
            if text and any(a in text for a in self.added):
                bags.append(len(self.tokenizer.encode(text, add_special_tokens=False).ids))
            else:
                bags.append(Counter(self.words(text or "")))
        whole, merged = self.whole, self.merged
        rest = list({w for bag in bags if not isinstance(bag, int) for w in bag if w not in whole and w not in merged})
        if len(merged) + len(rest) > MEMORY:
            merged.clear()
            rest = list({w for bag in bags if not isinstance(bag, int) for w in bag if w not in whole})
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            merged.update(zip(part, (len(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [bag if isinstance(bag, int) else sum(n * (1 if w in whole else merged[w]) for w, n in bag.items()) for bag in bags]


def count_tokens(documents: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit, one row per row.

    Whole texts, without begin, end or added special tokens; strings of special tokens inside a text count as the
    library counts them by default. Null and empty texts have 0 bytes and 0 tokens. Repeated rows stay repeated;
    other columns are ignored. path: a tokenizer file of this kind, read by the driver only."""
    from tokenizers import Tokenizer

    with open(path or tokenizer_file()) as f:
        spec = f.read()
    whole = prove_whole(Tokenizer.from_str(spec))
    shared = documents.sparkSession.sparkContext.broadcast((spec, whole))  # as large as the vocabulary file, whatever the data

    def make():
        counter = PieceCounter(*shared.value)

        def one(batch):
            texts = batch.column("text").to_pylist()
            n = counter.counts(texts)
            return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return one

    return map_texts(documents.select("doc_id", "text"), make, f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, over_limit boolean")
