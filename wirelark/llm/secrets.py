"""Secret scans: fixed forms plus a randomness test battery.

Fixed forms are assignments, access keys and long hex runs. Further candidates are tokens of 16 or more
letters, digits and ``+/_=-`` whose encoding (hex, letters of one or both cases, base 32, base 36, base 64) is
inferred from the characters used; digits alone are numbers, not keys. Each candidate is tested against uniform
draws from its alphabet: chi-squared for the use of the alphabet, runs of character classes (of halves of the
alphabet where it is one class) and serial correlation, all two-sided. The three p-values make one sum of
logarithms, small for random tokens.

What that sum is for ordinary text is calibrated on the corpus: a model of character pairs, counted over all
words of all documents but the candidates, draws words that are joined by separators, by capitals or by nothing to the
least length of each length band. A candidate's p-value is the share of such tokens with as small a sum;
beyond the least drawn a power law fitted to the lower tail goes on. Benjamini-Hochberg control runs over
all candidates of the corpus within each band of lengths, so that short tokens, of which there are many,
don't pay for long ones or profit from them; its counts are a histogram of bounded size.

Defined results: a null or empty text has no spans and the digest of the empty string. Spans are code
points, end exclusive. A candidate that touches a fixed form's span is not reported again. Repeated
rows are reported each, and count in the corpus-wide control as often as they occur.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.llm.common import materialise, text_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Kinds in output order; the last is the battery's.
KINDS = ("assign", "access", "hex", "random")
#: Least lengths of the bands.
BANDS = (16, 20, 28, 40, 64, 128)
ALNUM = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)
#: Letters per thousand of ordinary English text, a to z: the prior of the character model, worth PRIOR characters.
ENGLISH = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
PRIOR = 5000
#: Tokens drawn for a band, and the share of them that the tail is fitted to.
DRAWN, TAIL = 20_000, 0.01
#: p-values are kept as the whole number of tenths of -log10, up to this.
LEVELS = 400
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,stop:int>>, more array<struct<start:int,kind:int,stop:int,band:int,level:int>>"


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def classes(codes: np.ndarray) -> np.ndarray:
    """0 digits, 1 upper, 2 lower case, 3 others."""
    return np.select([(codes >= 48) & (codes <= 57), (codes >= 65) & (codes <= 90), (codes >= 97) & (codes <= 122)], [0, 1, 2], 3)


def alphabets() -> list[tuple[np.ndarray, np.ndarray]]:
    """(place of each byte in the alphabet or -1, class sizes) of the encodings, narrowest first."""
    named = [b"0123456789", b"0123456789abcdef", b"0123456789ABCDEF", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"234567ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    named += [bytes(ALNUM[:36]), bytes(ALNUM[:10]) + bytes(ALNUM[36:]), bytes(ALNUM[10:]), bytes(ALNUM), bytes(ALNUM) + b"+/", bytes(ALNUM) + b"-_", bytes(ALNUM) + b"+/-_"]
    out = []
    for letters in named:
        codes = np.sort(np.frombuffer(letters, np.uint8))
        place = np.full(256, -1)
        place[codes] = np.arange(len(codes))
        out.append((place, np.bincount(classes(codes), minlength=4)))
    return out


ALPHABETS = alphabets()
erfc = np.vectorize(math.erfc, otypes=[float])


def battery(codes: np.ndarray) -> np.ndarray:
    """For tokens of one length (rows of bytes) the sum of -2 log p of the three tests; inf where a token is of no encoding or of digits alone."""
    n = codes.shape[1]
    total = np.full(len(codes), np.inf)
    todo = np.ones(len(codes), bool)
    for place, sizes in ALPHABETS:
        size = int(sizes.sum())
        x = place[codes]
        own = todo & (x >= 0).all(axis=1)
        todo &= ~own
        if size == 10 or not own.any():
            continue
        x, kinds = x[own], classes(codes[own])
        used = np.apply_along_axis(np.bincount, 1, x, minlength=size)
        chi = size / n * (used.astype(float) ** 2).sum(axis=1) - n
        tests = [(chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)]
        halves = kinds if (sizes > 0).sum() > 1 else x * 2 // size
        change = 1 - float(((sizes / size) ** 2).sum()) if (sizes > 0).sum() > 1 else 0.5
        runs = (halves[:, 1:] != halves[:, :-1]).sum(axis=1)
        tests.append((runs - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change)))
        y = x - (size - 1) / 2
        tests.append((y[:, 1:] * y[:, :-1]).sum(axis=1) / ((size * size - 1) / 12) / math.sqrt(n - 1))
        total[own] = sum(-2 * np.log(np.maximum(erfc(np.abs(z) / math.sqrt(2)), 1e-300)) for z in tests)
    return total


def token_score(token: str) -> float:
    body = token.rstrip("=")
    return float(battery(np.frombuffer(body.encode(), np.uint8)[None, :])[0]) if len(body) >= BANDS[0] else math.inf


def pair_counts(docs: DataFrame) -> np.ndarray:
    """Counts of adjacent letters and digits over all texts without their candidates, by place in ALNUM; 62 is a word's edge."""
    width = len(ALNUM) + 1
    place = np.full(256, width - 1)
    place[ALNUM] = np.arange(width - 1)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width * width, np.int64)
        for f in frames:
            for text in f.text.dropna():
                x = place[np.frombuffer((" " + TOKEN.sub(" ", text) + " ").encode(), np.uint8)]
                total += np.bincount(x[:-1] * width + x[1:], minlength=width * width)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    made = text_batches(docs).select("text").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(width * width)
    for r in made.collect():  # a row for each pair of characters, 3,969 at most
        out[r.cell] = r.n
    return out.reshape(width, width)


def ordinary_tokens(pairs: np.ndarray, n: int, length: int, rng: np.random.Generator) -> np.ndarray:
    """n tokens of words drawn by pairs of characters, joined in one of several ways each."""
    edge = len(ALNUM)
    prior = np.zeros(edge + 1)
    prior[36:edge] = ENGLISH
    prior[:10], prior[edge] = 2, 200  # digits are rare, words have some five letters
    chance = pairs + PRIOR / (edge + 1) * prior / prior.sum()
    chance[edge, edge] = 0
    cumulated = np.cumsum(chance / chance.sum(axis=1, keepdims=True), axis=1)
    draw = lambda state: np.minimum((cumulated[state] < rng.random(n)[:, None]).sum(axis=1), edge)
    joiner = rng.choice(np.frombuffer(b"-_/+\0\1", np.uint8), n)  # \0: capitals, \1: nothing
    out, state = np.empty((n, length), np.uint8), np.full(n, edge)
    upper = np.arange(edge + 1)
    upper[36:edge] -= 26
    for k in range(length):
        at = draw(state)
        begin = (at == edge) & (joiner < 2)  # the next word follows at once
        if begin.any():
            at = np.where(begin, draw(np.full(n, edge)), at)
        shown = np.where(begin & (joiner == 0), upper[at], at)
        out[:, k] = np.where(at == edge, joiner, ALNUM[np.minimum(shown, edge - 1)])
        state = at
    return out


@dataclass
class Null:
    """The sums of ordinary tokens of each band: sorted, and the power of the lower tail."""

    sums: list[np.ndarray]
    power: list[float]

    @staticmethod
    def of(pairs: np.ndarray, seed: int = 19) -> Null:
        rng = np.random.default_rng(seed)
        made = Null([], [])
        for length in BANDS:
            x = battery(ordinary_tokens(pairs, DRAWN, length, rng))
            x = np.sort(x[np.isfinite(x)])
            low = x[: max(2, int(TAIL * len(x)))]
            made.sums.append(x)
            made.power.append(1 / max(float(np.log(low[-1] / np.maximum(low, 1e-9))[:-1].mean()), 1e-6))
        return made

    def level(self, band: int, score: float) -> float:
        """-log10 of the share of ordinary tokens of a band with a sum of score or less."""
        x = self.sums[band]
        tail = max(2, int(TAIL * len(x)))
        if score >= x[tail - 1]:
            return -math.log10((1 + np.searchsorted(x, score, side="right")) / (1 + len(x)))
        return -math.log10(tail / len(x)) + self.power[band] * math.log10(x[tail - 1] / max(score, 1e-9))


def candidates(text: str, taken: list[tuple[int, int, int]], null: Null) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, stop, band, level) of the tokens of an encoding; fixed spans, sorted, aren't touched."""
    out, i, reached = [], 0, 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][0] < b:
            reached, i = max(reached, taken[i][2]), i + 1
        if reached > a or math.isinf(score := token_score(m[0])):
            continue
        band = sum(len(m[0].rstrip("=")) >= k for k in BANDS) - 1
        out.append((a, len(KINDS) - 1, b, band, min(LEVELS, int(10 * null.level(band, score)))))
    return out


def scan_batches(frames: Iterator[pd.Series], null: Null) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for texts in frames:
        rows = []
        for t in texts:
            spans = fixed_spans(t or "")
            counts = [sum(k == i for _, k, _ in spans) for i in range(3)]
            more = candidates(t or "", spans, null)
            rows.append((*counts, hashlib.sha256(listed(spans).encode()).hexdigest(), [dict(start=a, kind=k, stop=b) for a, k, b in spans], [dict(start=a, kind=k, stop=b, band=d, level=p) for a, k, b, d, p in more]))
        yield pd.DataFrame(rows, columns=names)


def discovery_levels(found: DataFrame, rate: float) -> dict[int, int]:
    """Least level of each band that Benjamini-Hochberg accepts at the false-discovery rate; its counts have bands x levels cells."""
    cells = found.select(F.explode("more").alias("x")).groupBy("x.band", "x.level").count().collect()
    out = {}
    for band in {r.band for r in cells}:
        own = np.zeros(LEVELS + 1, np.int64)
        for r in cells:
            if r.band == band:
                own[r.level] = r["count"]
        above = np.cumsum(own[::-1])[::-1]
        ok = np.flatnonzero((above > 0) & (10.0 ** (-np.arange(LEVELS + 1) / 10) * own.sum() <= rate * np.maximum(above, 1)))
        if ok.size:
            out[band] = int(ok[0])
    return out


def secret_spans(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    null = Null.of(pair_counts(docs))

    def scan(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from scan_batches(frames, null)

    found = materialise(text_batches(docs).select("doc_id", F.pandas_udf(scan, SCHEMA)("text").alias("x")).select("doc_id", "x.*"))
    levels = discovery_levels(found, rate)
    passed = lambda x: F.exists(F.array(*(F.struct(F.lit(b).alias("band"), F.lit(v).alias("level")) for b, v in levels.items())), lambda c: (c.band == x.band) & (x.level >= c.level)) if levels else F.lit(False)
    more = F.transform(F.filter("more", passed), lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.stop.alias("stop")))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.array_sort(F.concat("base", more)), lambda x: F.concat_ws(":", F.get(names, x.kind), x.start, x.stop))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"))
