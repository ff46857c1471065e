"""Sizes of texts in tokens of a public tokenizer.

The tokenizer is a byte-level BPE of 50,256 ids for many languages, read from a rank file whose
path is a parameter.  A text is cut at its blanks: a blank and what follows up to the next blank
never shares a token with what stands before, as the tokenizer's own pattern takes a blank only as
the head of a piece.  So the size is a sum over such chunks, whose sizes are kept; only texts with
two blanks in a row, where the pattern looks further, are encoded as a whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from talkweave.functions.durable import once

#: Rank file of the tokenizer, and the pattern that splits text before its merges.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks whose size a Python worker keeps; the store is emptied when it is full, which costs time only.
KEPT = 200_000

_loaded: dict[str, object] = {}


def encoding(path: str = RANKS):
    """The tokenizer of a rank file, loaded once in a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def counter(path: str = RANKS):
    """A function from text to its number of tokens."""
    encode, kept = encoding(path).encode_ordinary, {}

    def count(text: str) -> int:
        if "  " in text:
            return len(encode(text))
        first, *chunks = text.split(" ")
        try:
            return len(encode(first)) + sum(map(kept.__getitem__, chunks))
        except KeyError:
            if len(kept) > KEPT:
                kept.clear()
            for c in chunks:
                if c not in kept:
                    kept[c] = len(encode(" " + c))
            return len(encode(first)) + sum(map(kept.__getitem__, chunks))

    return count


def n_tokens(text: Column, path: str = RANKS) -> Column:
    """Number of tokens of a text column, bigint; null and empty texts have 0."""

    @F.pandas_udf("bigint")
    def sizes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for s in parts:
            yield s.map(count).astype("int64")

    return once(sizes)(F.coalesce(text, F.lit("")))
