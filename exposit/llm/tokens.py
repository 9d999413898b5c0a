"""Encoding a corpus with a public byte-level BPE tokenizer, by forced boundaries.

Two adjacent bytes that occur in no vocabulary token can never end up inside one token, so a cut
between them is certain: no merge crosses it, and the fragments on its two sides encode
independently. The table of such byte pairs follows from the vocabulary alone.

The tokenizer first splits text by a pattern, so a cut must be a match boundary of that as well. ASCII white
space after any character that is none begins a new match in every text; where the table has its byte pair, the cut is
certain in both senses. The fragments (white space, then a word) repeat all over a corpus: their ids are
remembered in a bounded dictionary, and only new ones are encoded, each alone, by the tokenizer's library.

Null and empty texts have the empty list. Special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Remembered fragments per Python worker; the dictionary starts anew beyond it.
REMEMBERED = 400_000
#: Fragments of more characters than this aren't remembered.
LONG = 48
#: The split pattern published with the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ForcedBoundaryEncoder(dict):
    """Ids of text by the ranks of a byte-level BPE vocabulary; maps a fragment to its ids."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        inside = bytearray(65536)
        for token in self.ranks:
            for a, b in zip(token, token[1:]):
                inside[a << 8 | b] = 1
        self.inside = bytes(inside)
        self.split = regex.compile(PATTERN).findall
        self.whole = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        # ASCII white space after any other character is a match boundary of the pattern. The cut is also forced
        # unless the character ends in a byte that some token has before white space; what can end so isn't cut after.
        spaces = [c for c in map(chr, range(128)) if c.isspace()]
        loose = {a for c in spaces for a in range(256) if inside[a << 8 | ord(c)] and chr(a) not in spaces}
        kept = [c for c in map(chr, range(128, 0x10000)) if not "\ud800" <= c <= "\udfff" and (c.encode()[-1] in loose or c.isspace())]
        kept += [c for c in map(chr, range(128)) if ord(c) in loose]
        uncut = "".join(map(re.escape, kept)) + "\U00010000-\U0010ffff"
        white = "".join(map(re.escape, spaces))
        self.fragments = re.compile(f"[{white}]*[^{white}]+(?:(?<=[{uncut}])[{white}]+[^{white}]*)*|[{white}]+").findall

    def __missing__(self, fragment: str) -> tuple[int, ...]:
        ids = tuple(self.whole(fragment))
        if len(fragment) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[fragment] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.fragments(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.__getitem__, self.fragments(text))))


_ENCODERS: dict[str, ForcedBoundaryEncoder] = {}


def encoder(path: str) -> ForcedBoundaryEncoder:
    """The encoder of this process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ForcedBoundaryEncoder(path)
    return _ENCODERS[path]


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>) of every row of ``df``. Null or empty text: an empty list.

    Narrow: one pass over the scan, no shuffle. Rows are kept as they are, repeated keys too; other
    columns are ignored whatever their names.
    """
    path = f"{tokenizers}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [own.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens int); 0 for null and empty text."""
    path = f"{tokenizers}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({key: pdf.iloc[:, 0], "n_tokens": [own.count(t) if t else 0 for t in pdf.iloc[:, 1]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, n_tokens int")
