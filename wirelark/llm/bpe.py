"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points of a batch become an array of classes; a finite automaton over those classes says where
a pre-token starts. The automaton runs as a scan of its transition functions: each position's
function is an element of the finite monoid that the class functions generate, composition is one
table lookup, and the scan goes block by block (fold each block, scan the folds, then walk all blocks
side by side). No regular expression is involved. The slices between boundaries feed a cache of merged
words; the merges of a word that is not in the cache run on its bytes by rank. Ids keep their lengths
in bytes, so each token's place in the text is known, and decoding is a table lookup.

Defined results: a null or empty text has no tokens and decodes to nothing; lone surrogates can't occur
in Spark strings. Each row is encoded on its own, so ties and repeated rows need no rule.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.llm.common import text_batches

#: Classes of code points, after a look at the next one or two.
LETTER, NUMBER, OTHER, SPACE, SPACE_LAST, BLANK, BLANK_LAST, SHORT, LONG, BREAK = range(10)
#: States: nothing open, an open run of letters, numbers, others or white space, a space that joins
#: what follows, and one or two letters of a contraction to come.
IDLE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, JOINING, ONE_MORE, TWO_MORE = range(8)
CACHE_WORDS = 400_000
BATCH_CHARS = 1 << 20
BLOCK = 128


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of each code point: letter, number, white space or other.

    The regex library serves as the table of properties: its Unicode version is that of the libraries to
    match, while Python's own is older by thousands of letters. No text is searched by it.
    """
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\p{White_Space}"))
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    for kind, pattern in kinds:
        for m in regex.finditer(pattern + "+", points):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[32] = SPACE
    return table


def step(state: int, kind: int) -> tuple[int, bool]:
    """(next state, whether a pre-token starts here)."""
    if kind == BREAK:
        return IDLE, True
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return IDLE, False
    if kind in (SPACE, BLANK):
        return IN_BLANKS, state != IN_BLANKS
    if kind == SPACE_LAST:
        return JOINING, True
    if kind == BLANK_LAST:
        return IDLE, True
    if kind in (SHORT, LONG) and state not in (IN_OTHERS, JOINING):
        return (ONE_MORE if kind == SHORT else TWO_MORE), True
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(kind, IN_OTHERS)
    return run, state not in (run, JOINING)


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, product table, image of each state under each element, start flag by state and class)."""
    states, classes = range(8), range(10)
    elements: dict[tuple[int, ...], int] = {tuple(states): 0}
    own = [elements.setdefault(tuple(step(s, c)[0] for s in states), len(elements)) for c in classes]
    while True:
        known = list(elements)
        for f in known:
            for g in known:
                elements.setdefault(tuple(g[s] for s in f), len(elements))
        if len(elements) == len(known):
            break
    product = np.array([[elements[tuple(g[s] for s in f)] for g in known] for f in known], np.uint16)
    return np.array(own, np.uint16), product, np.array(known, np.uint8), np.array([[step(s, c)[1] for c in classes] for s in states])


def classify(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Classes of the code points of texts laid end to end; firsts are where texts begin."""
    kinds = class_table()[points]
    ends = np.zeros(len(points) + 2, bool)  # is there no further character of this text
    ends[firsts] = True
    ends[len(points) :] = True
    following = np.concatenate([kinds[1:], [BREAK]])
    blank = (kinds == SPACE) | (kinds == BLANK)
    last = blank & ~ends[1:-1] & (following != SPACE) & (following != BLANK)
    kinds[last & (kinds == SPACE)] = SPACE_LAST
    kinds[last & (kinds == BLANK)] = BLANK_LAST
    quotes = np.flatnonzero(points == 39)
    if quotes.size:
        one = np.where(ends[quotes + 1], 0, points[np.minimum(quotes + 1, len(points) - 1)])
        two = np.where((one == 0) | ends[quotes + 2], 0, points[np.minimum(quotes + 2, len(points) - 1)])
        kinds[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kinds[quotes[pairs]] = LONG
    return kinds


def starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each position, from the state IDLE, by a blocked scan of transition functions."""
    own, product, image, flags = monoid()
    n = len(kinds)
    rows = max(1, -(-n // BLOCK))
    padded = np.full(rows * BLOCK, BREAK, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    folds = own[columns[0]]
    for c in columns[1:]:
        folds = product[folds, own[c]]
    shift = 1  # inclusive scan of the folds by doubling
    scan = folds.copy()
    while shift < rows:
        scan[shift:] = product[scan[:-shift], scan[shift:]]
        shift *= 2
    state = np.full(rows, IDLE, np.uint8)
    state[1:] = image[scan[:-1], IDLE]
    out = np.empty((BLOCK, rows), bool)
    moves = np.array([[step(s, c)[0] for c in range(10)] for s in range(8)], np.uint8)
    for j, c in enumerate(columns):
        out[j] = flags[state, c]
        state = moves[state, c]
    return out.T.reshape(-1)[:n]


def pre_tokens(texts: list[str]) -> list[list[str]]:
    """The pre-tokens of each text."""
    joined = "".join(texts)
    firsts = np.cumsum([0, *map(len, texts)])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return [[] for _ in texts]
    sizes = np.diff(firsts)
    heads = firsts[:-1][sizes > 0]
    kinds = classify(points, heads)
    # a BREAK ahead of each text, so that one scan starts each from IDLE
    places = np.arange(1, len(kinds) + 1) + np.repeat(np.arange(len(heads)), sizes[sizes > 0])
    spread = np.full(len(kinds) + len(heads), BREAK, np.uint8)
    spread[places] = kinds
    at = np.flatnonzero(starts(spread)[places])
    edges = [*at.tolist(), len(points)]
    words = [joined[a:b] for a, b in zip(edges, edges[1:])]
    split = np.searchsorted(at, firsts).tolist()
    return [words[a:b] for a, b in zip(split, split[1:])]


class Vocabulary:
    """Ranks of byte strings, with a bounded cache of merged words as little-endian id bytes."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.cache: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[bytes]:
        """Merge adjacent pieces of least rank, leftmost first, until no pair is a token. Long words use a heap."""
        if word in self.ranks:
            return [word]
        if len(word) > 64:
            return self.merge_long(word)
        get, none = self.ranks.get, 1 << 60
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def merge_long(self, word: bytes) -> list[bytes]:
        from heapq import heapify, heappop, heappush

        n = len(word)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.ranks.get(word[i : end[after[i]]])) is not None:
                    heappush(heap, (r, i, end[after[i]]))
            if (p := before[i]) >= 0 and (r := self.ranks.get(word[p:stop])) is not None:
                heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(word[i : end[i]])
            i = after[i]
        return out

    def ids(self, words: list[str]) -> bytes:
        """The ids of words as little-endian 32-bit integers."""
        cache = self.cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            pass
        if len(cache) > CACHE_WORDS:
            cache.clear()
        fresh = {}
        for w in set(words).difference(cache):
            fresh[w] = np.array([self.ranks[p] for p in self.merge(w.encode())], "<u4").tobytes()
            if len(w) <= 64:
                cache[w] = fresh[w]
        return b"".join([cache.get(w) or fresh[w] for w in words])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, scanned in batches of bounded size."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= BATCH_CHARS):
                size, stop = size + len(texts[stop]), stop + 1
            out += [np.frombuffer(self.ids(words), "<u4") for words in pre_tokens(texts[at:stop])]
            at = stop
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in its text, and the length of the text at the end."""
        return np.cumsum([0, *(len(self.tokens[i]) for i in ids.tolist())])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, ids, offsets (bytes; the text's length last), decoded (binary)."""

    def batches(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for texts in frames:
            ids = v.encode_batch([t or "" for t in texts])
            yield pd.DataFrame({"ids": [i.astype(np.int32) for i in ids], "offsets": [v.offsets(i) for i in ids], "decoded": [v.decode(i) for i in ids]})

    made = F.pandas_udf(batches, "ids array<int>, offsets array<long>, decoded binary")("text")
    return text_batches(docs).select("doc_id", made.alias("x")).select("doc_id", "x.*")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids stay in the worker."""

    def batches(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for texts in frames:
            ids = v.encode_batch([t or "" for t in texts])
            yield pd.DataFrame({"n_tokens": [len(i) for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids], "decoded_sha256": [hashlib.sha256(v.decode(i)).hexdigest() for i in ids]})

    made = F.pandas_udf(batches, "n_tokens long, ids_sha256 string, decoded_sha256 string")("text")
    return text_batches(docs).select("doc_id", made.alias("x")).select("doc_id", "x.*")
