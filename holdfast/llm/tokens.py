"""Sizes of texts in tokens of a public byte-level BPE vocabulary; nothing is trained here."""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.batches import map_columns

#: Where the vocabulary is by default; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern by which this vocabulary's tokenizer cuts a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Every cut of the pattern lies within one of these pieces.
_PIECE = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")


class TokenCounter(dict):
    """Exact token counts; the counts of pieces that recur are kept, up to a million of them."""

    def __init__(self, vocabulary: str = VOCABULARY):
        super().__init__()
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, _PIECE.findall(text))) if text else 0


_counters: dict[str, TokenCounter] = {}


def counter(vocabulary: str) -> TokenCounter:
    """One counter for each worker process and vocabulary."""
    if vocabulary not in _counters:
        _counters[vocabulary] = TokenCounter(vocabulary)
    return _counters[vocabulary]


def sized(documents: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, text_key, tokens)`` of documents with an id and a text that has tokens.

    ``text_key`` is the MD5 of the text, the same for copies.
    """

    def run(ids, sources, keys, texts):
        c = counter(vocabulary)
        for i, s, k, t in zip(ids, sources, keys, texts):
            n = c.count(t)
            if n:
                yield i, s, k, n

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), F.md5(text_col).alias("text_key"), F.col(text_col).alias("text"))
    rows = rows.where("doc_id IS NOT NULL AND length(text) > 0")
    return map_columns(rows, run, "doc_id bigint, source string, text_key string, tokens bigint")
