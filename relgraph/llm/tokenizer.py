"""Encoding of a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter, with this default.
TOKENIZER_DIR = os.environ.get("RELGRAPH_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary splits a text into words before merging bytes.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of up to so many bytes are merged by scanning their rank array; longer ones, where the scan would take
#: quadratic time, with a heap. Both give the same ids.
SHORT_WORD = 128
#: Words kept with their ids while a task runs; words beyond are merged again when they recur.
CACHED_WORDS = 200_000
_NO_RANK = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id; the id is also the rank of the merge that makes the token."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a contiguous rank array.

    ``at`` holds the boundaries of the parts, ``rank[i]`` the rank of the parts i and i + 1 joined. The least rank,
    leftmost first, loses the boundary between its two parts, and only its two neighbours get new ranks.
    """
    n = len(word)
    at = list(range(n + 1))
    rank = [ranks.get(word[i : i + 2], _NO_RANK) for i in range(n - 1)]
    while rank:
        least = min(rank)
        if least == _NO_RANK:
            break
        i = rank.index(least)
        del at[i + 1], rank[i]
        if i < len(rank):
            rank[i] = ranks.get(word[at[i] : at[i + 2]], _NO_RANK)
        if i > 0:
            rank[i - 1] = ranks.get(word[at[i - 1] : at[i + 1]], _NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(at, at[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word: a heap of adjacent ranks over linked parts, in n log n time."""
    n = len(word)
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    end = list(range(1, n + 1))  # end of the part that starts at i; 0 once the part is gone
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not end[i] or j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        end[i], end[j] = stop, 0
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            r = ranks.get(word[i : end[nxt[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0:
            p = prv[i]
            r = ranks.get(word[p : end[i]])
            if r is not None:
                heapq.heappush(heap, (r, p, end[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return ids


class Encoder:
    """Encodes texts to ids, without special tokens: their strings in a text are ordinary text."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.words = regex.compile(WORD_PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            ids = [whole]
        else:
            ids = merge_short(raw, self.ranks) if len(raw) <= SHORT_WORD else merge_long(raw, self.ranks)
        if len(self.cache) < CACHED_WORDS and len(raw) <= SHORT_WORD:
            self.cache[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.cache.get
        for w in self.words(text):
            out += known(w) or self.word(w)
        return out


def encode_corpus(df: DataFrame, key: str, text: str, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """Ids of every text: columns key, ids (list of int).

    A null or empty text gives an empty list; blanks are text. Repeated rows come out as often as they are stored, a
    null key stays null. Texts are encoded whole, whatever their length. Other columns are ignored; an empty table
    gives no rows. The vocabulary file (under 1 MB) is read once by the driver and sent to the workers.
    """
    spark = df.sparkSession
    with open(os.path.join(folder, vocabulary), "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = (x.split() for x in raw.value.split(b"\n") if x.strip())
        encoder = Encoder({base64.b64decode(token): int(rank) for token, rank in lines})
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "ids": [encoder.encode(t) for t in pdf["t"]]})

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("k", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(encode, schema).withColumnRenamed("k", key)
