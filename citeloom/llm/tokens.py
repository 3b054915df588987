"""Token counts of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.frames import nonempty

#: Vocabulary file: lines of a base64 token and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of this vocabulary (fixed value), and the same for ASCII text in ``re``'s terms.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
#: Distinct pieces remembered per worker.
REMEMBERED = 500_000


class TokenCounter(dict):
    """Counts tokens; remembers the count of each piece of ASCII text, as pieces are encoded one by one."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if b}
        self.encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not text.isascii():
            return len(self.encode(text))
        if len(self) > REMEMBERED:
            self.clear()
        return sum(map(self.__getitem__, _ASCII.findall(text)))


def token_counts(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens) of every row with text; null and blank texts are left out."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one file of about a megabyte

    @nonempty
    def count(batches):
        counter = TokenCounter(shared.value)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "tokens": [counter.count(t) for t in pdf["text"]]})

    rows = docs.select(key, F.col(text).alias("text")).where(F.col("text").rlike(r"\S"))
    return rows.mapInPandas(count, f"{key} {dict(docs.dtypes)[key]}, tokens bigint")
