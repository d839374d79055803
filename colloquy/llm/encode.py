"""Token ids of a whole corpus by a public byte-level tokenizer.

Method: forced boundaries.  Two bytes that never stand side by side inside any token of the
vocabulary can't be merged, so a text may be cut between them and the fragments encoded on their
own; the ids are the same as those of the whole.  The tokenizer's own split into words comes first,
as it looks beyond the cut.  Fragments repeat (for Chinese they are mostly single characters), so
each is encoded once a worker and kept in a table of bounded size.

Null and empty texts have an empty list of ids; strings of special tokens are ordinary text.  Whole
texts are encoded; the longest is one row of one task.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fragments kept a worker.
KEPT = 1 << 17
#: The tokenizer's split into words (fixed value of the public vocabulary).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def inside_pairs(ranks: dict[bytes, int]) -> bytearray:
    """1 at b * 256 + c if the bytes b, c stand side by side inside a token."""
    seen = bytearray(65536)
    for token in ranks:
        for b, c in zip(token, token[1:]):
            seen[b << 8 | c] = 1
    return seen


class Encoder:
    def __init__(self, path: str = VOCABULARY):
        import regex
        import tiktoken

        self.ranks = load(path)
        self.inside = inside_pairs(self.ranks)
        self.words = regex.compile(WORDS)
        self.single = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        self.known: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[bytes, tuple[int, ...]] = {}

    def fragment(self, data: bytes) -> tuple[int, ...]:
        ids = self.fragments.get(data)
        if ids is None:
            rank = self.ranks.get(data)
            ids = (rank,) if rank is not None else tuple(self.single(data))
            if len(self.fragments) >= KEPT:
                self.fragments.clear()
            self.fragments[data] = ids
        return ids

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            data, inside, out, at = word.encode(), self.inside, [], 0
            for i in range(1, len(data)):
                if not inside[data[i - 1] << 8 | data[i]]:
                    out += self.fragment(data[at:i])
                    at = i
            ids = tuple([*out, *self.fragment(data[at:])])
            if len(word) <= 32:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for w in self.words.findall(text or ""):
            out += self.word(w)
        return out


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> Encoder:
    return Encoder(path)


def ids(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of each document."""

    def work(batches):
        e = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [e.encode(t) for t in pdf["text"]]})

    return documents.select("doc_id", "text").mapInPandas(work, "doc_id long, ids array<int>")


def counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of each document with visible tokens."""

    def work(batches):
        e = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": [len(e.encode(t)) for t in pdf["text"]]})

    return documents.select("doc_id", "source", "text").mapInPandas(work, "doc_id long, source string, n_tokens long").where(F.col("n_tokens") > 0)
