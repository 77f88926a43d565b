"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens; the symbols of a pre-token form a linked list, and a heap holds the
ranked adjacent pairs. Popping the pair of least rank (leftmost among equals), merging it and pushing
its new neighbours goes on until the heap is empty. Tokens are the initial symbols less the merges
made; no identifiers are produced. Counts of short pre-tokens are cached in each worker up to a bound.

Defined results: a null or empty text has 0 bytes and 0 tokens. The strings of special tokens inside a
text count as one token, as the library has it by default. Rows are counted each on its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.llm.common import text_batches

CACHE_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, free = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in shown:
            shown[b], free = chr(free), free + 1
    return [shown[b] for b in range(256)]


class MergeCounter:
    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        specials = [t["content"] for t in data["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.find = regex.compile(pattern).findall
        self.symbols = byte_symbols()
        self.cache: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Number of tokens of one pre-token."""
        sym = [self.symbols[b] for b in word.encode()]
        n, rank = len(sym), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # an older pair, gone since
            sym[i], sym[j], after[i] = left + right, "", after[j]
            merges += 1
            if (k := after[i]) < n:
                before[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heappush(heap, (r, i, sym[i], sym[k]))
            if (p := before[i]) >= 0 and (r := rank.get((sym[p], sym[i]))) is not None:
                heappush(heap, (r, p, sym[p], sym[i]))
        return n - merges

    def words(self, words: list[str]) -> int:
        cache = self.cache
        try:
            return sum([cache[w] for w in words])
        except KeyError:
            pass
        if len(cache) > CACHE_WORDS:
            cache.clear()
        total = 0
        for w in words:
            c = cache.get(w)
            if c is None:
                c = self.merged(w)
                if len(w) <= 64:
                    cache[w] = c
            total += c
        return total

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(self.words(self.find(p)) for p in parts)


@lru_cache(2)
def counter(path: str, pattern: str) -> MergeCounter:
    return MergeCounter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def batches(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path, pattern)
        for texts in frames:
            yield pd.Series([c.count(t or "") for t in texts], dtype="int64")

    counted = text_batches(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.pandas_udf(batches, "long")("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
