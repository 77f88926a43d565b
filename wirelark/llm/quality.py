"""Quality rules with risk-controlled thresholds.

Each rule is a number per document, put on a fixed grid; a document fails a rule when its grid
value exceeds the cutoff of its stratum (its language). Cutoffs come from labelled holdouts.
Each stratum has one sequence over all rules: a path from cutoffs that reject nothing to stricter ones,
one rule and grid step at a time. A part of the stratum's good holdouts and its bad ones propose the
path; the other good ones certify it, step by step, while the exact binomial tail says that all rules
together reject at most ``risk`` of good documents. The first failure ends the sequence, so it needs no
correction of its own, and no part of the risk is set aside for a rule. The confidence is shared out over
the strata by Bonferroni. Of the certified steps the one that gains most on labelled bad documents is used.

Defined results: a null or empty text has no words and fails the base rule; a null language is a
stratum of its own. A stratum whose good holdouts are too few for the exact bound (217 where four strata
share a confidence of 0.95 and the risk is 0.02), or that has no bad ones, rejects nothing by these rules:
others' cutoffs aren't certified for it. So only the base rule rejects there, as with an empty label table. Labelled
doc_ids are taken as independent draws: those of equal or alike texts count each. Repeated rows are judged alike,
each on its own. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.llm.common import WORD, materialise, text_batches

WINDOW = 8
LEVELS = 256
SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\x0c\r"
#: Rules, in output order; each has the grid value 0 to LEVELS - 1.
RULES = ("symbols", "repeated_lines", "repeated_words", "long_words", "short_words")
STAT_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"r_{x} int" for x in RULES)


def repeated_window_words(ids: np.ndarray) -> int:
    """Words inside WINDOW-word windows that occur at least twice. Linear hashes rule out most texts; equality is exact."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) ** 3 | 1) & 0xFFFFFFFFFFFFFFFF)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * factor + ids[j : j + n].astype(np.uint64)
    if np.unique(mixed).size == n:
        return 0
    codes, span = ids.astype(np.int64), 1
    while span < WINDOW:  # codes of windows of doubled length
        pairs = codes[:-span] * np.int64(len(ids) + 1) + codes[span:]
        codes, span = np.unique(pairs, return_inverse=True)[1].astype(np.int64), 2 * span
    starts = np.flatnonzero(np.bincount(codes)[codes] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """Base counts and the grid values of the rules for one whole text."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    chars, symbols = sum(map(len, words)), sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(SEPARATORS):
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    repeats = 0
    if n > WINDOW:
        known: dict[str, int] = {}
        repeats = repeated_window_words(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n))
    mean = chars / n if n else 0.0
    grid = (50 * symbols / max(n, 1), 255 * dups / max(lines, 1), 255 * repeats / max(n, 1), 20 * mean, 255 - 20 * mean if n else 0)
    return n, chars, symbols, dups, repeats, *(int(min(max(x, 0), LEVELS - 1)) for x in grid)


def stat_batches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in STAT_SCHEMA.split(", ")]
    for batch in texts:
        yield pd.DataFrame([text_stats(t) for t in batch], columns=names)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log_c = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i])
    return float(min(1.0, np.exp(log_c + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def certified_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, level: float, price: float) -> int:
    """The most useful certified cutoff of a grid with the given counts; the last level (rejects nothing) where none is."""
    n_good, n_bad = int(good.sum()), int(bad.sum())
    best, gain = len(good) - 1, 0.0
    if not n_good or not n_bad or (1 - risk) ** n_good > level:
        return best
    wrong, right = 0, 0
    for cut in range(len(good) - 2, -1, -1):
        wrong, right = wrong + int(good[cut + 1]), right + int(bad[cut + 1])
        if wrong > risk * n_good or binomial_tail(wrong, n_good, risk) > level:
            break
        if right / n_bad - price * wrong / n_good > gain:
            best, gain = cut, right / n_bad - price * wrong / n_good
    return best


def least_holdout(sizes: dict[int, int], risk: float, miss: float) -> tuple[int, float]:
    """(fewest good holdouts of a stratum that can certify, its level), where the strata that can share miss. sizes: strata by number of good holdouts."""
    best, strata = (0, 0.0), 0
    for n in sorted(sizes, reverse=True):
        strata += sizes[n]
        if (1 - risk) ** n <= miss / strata:
            best = n, miss / strata
    return best


def proposed_path(good: np.ndarray, bad: np.ndarray, price: float) -> list[tuple[int, int]]:
    """(rule, cutoff) of each step, by what rules reject of the proposing holdouts (counts by rule and level).

    The next run of steps is the one that rejects most bad documents for each good one; it stops where none is worth its price.
    """
    n_good, n_bad = max(int(good[0].sum()), 1), int(bad[0].sum())
    at, path = [LEVELS - 1] * len(good), []
    while n_bad:
        best = None
        for rule, cut in enumerate(at):
            right, wrong = np.cumsum(bad[rule, cut:0:-1]), np.cumsum(good[rule, cut:0:-1])
            worth = np.where(right / n_bad > price * wrong / n_good, right / (wrong + 1), 0)
            if worth.size and worth.max() > 0 and (best is None or worth.max() > best[0]):
                best = float(worth.max()), rule, cut - 1 - int(worth.argmax())
        if best is None:
            return path
        _, rule, to = best
        # levels that hold no bad document are no steps of their own
        path += [(rule, cut) for cut in range(at[rule] - 1, to - 1, -1) if bad[rule, cut + 1]]
        at[rule] = to
    return path


def as_counts(f: pd.DataFrame) -> np.ndarray:
    """Counts by rule and level of (rule, level, count)."""
    out = np.zeros((len(RULES), LEVELS), np.int64)
    np.add.at(out, (f.rule.to_numpy(), f.level.to_numpy()), f["count"].to_numpy())
    return out


def select_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = 0.02, confidence: float = 0.95, price: float = 3.0) -> DataFrame:
    """stratum and c_<rule>: the cutoffs of the strata that certify some; others reject nothing.

    stats: doc_id, lang and the rule columns. risk: allowed rate of false rejections by all rules together.
    All strata with as many good holdouts as the exact bound needs take part. A quarter of a stratum's
    good holdouts (drawn by a hash of doc_id), or what can be spared, proposes its path.
    """
    spark = stats.sparkSession
    cutoffs = "stratum string, " + ", ".join(f"c_{r} int" for r in RULES)
    holdout = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = materialise(stats.select("doc_id", "lang", *(f"r_{r}" for r in RULES)).join(holdout, "doc_id").withColumn("stratum", F.coalesce("lang", F.lit(""))))
    # rows of a doc_id that occurs more than once are one holdout: they aren't independent
    held = held.groupBy("stratum", "doc_id").agg(F.min("quality").alias("quality"), *(F.max(f"r_{r}").alias(f"r_{r}") for r in RULES))
    own = held.groupBy("stratum").agg(F.count_if(F.col("quality") == 1).alias("n"), F.count_if(F.col("quality") == 0).alias("bad")).where("n > 0 and bad > 0")
    needed = lambda p: math.ceil(math.log(p) / math.log1p(-risk))
    # with so many holdouts any number of strata could certify, so more are counted alike and few numbers come to the driver
    sizes = {r.n: r["count"] for r in own.groupBy(F.least("n", F.lit(needed(1e-15))).alias("n")).count().collect()}
    least, level = least_holdout(sizes, risk, 1 - confidence)
    if not least:
        return F.broadcast(spark.createDataFrame([], cutoffs))
    spare = F.when(F.col("n") >= needed(level) + 60, F.least(F.lit(0.25), 1 - 1.05 * needed(level) / F.col("n"))).otherwise(0.0)
    part = held.join(own.where(F.col("n") >= least).select("stratum", spare.alias("share")), "stratum")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    part = materialise(part.withColumn("part", F.when(F.col("quality") == 0, 0).when(drawn, 1).otherwise(2)))  # bad, proposing, certifying
    levels = F.explode(F.array(*(F.struct(F.lit(i).alias("rule"), F.col(f"r_{r}").alias("level")) for i, r in enumerate(RULES))))
    cells = part.where("part < 2").select("stratum", "part", levels.alias("x")).groupBy("stratum", "part", "x.rule", "x.level").count()

    def propose(f: pd.DataFrame) -> pd.DataFrame:
        path = proposed_path(as_counts(f[f.part == 1]), as_counts(f[f.part == 0]), price)
        first = np.full((len(RULES), LEVELS), len(path) + 1)  # the step from which a rule rejects a level
        for step, (rule, cut) in reversed(list(enumerate(path, 1))):
            first[rule, cut + 1 :] = step
        return pd.DataFrame({"stratum": [f.stratum.iat[0]], "rules": [[r for r, _ in path]], "cuts": [[c for _, c in path]], "first": [first.ravel().tolist()]})

    paths = materialise(cells.groupBy("stratum").applyInPandas(propose, "stratum string, rules array<int>, cuts array<int>, first array<int>"))
    step = F.least(*(F.get("first", F.col(f"r_{r}") + i * LEVELS) for i, r in enumerate(RULES)))
    steps = part.where("part != 1").join(paths.select("stratum", "first"), "stratum").groupBy("stratum", "part", step.alias("step")).count()

    def certify(f: pd.DataFrame) -> pd.DataFrame:
        rules, cuts = f.rules.iat[0], f.cuts.iat[0]
        counts = np.zeros((2, len(rules) + 1), np.int64)  # by quality and steps from the end; those that no step rejects come first
        np.add.at(counts, (np.where(f.part == 2, 1, 0), len(rules) + 1 - f.step.to_numpy()), f["count"].to_numpy())
        taken = len(rules) - certified_cutoff(counts[1], counts[0], risk, level, price)
        at = [LEVELS - 1] * len(RULES)
        for rule, cut in zip(rules[:taken], cuts[:taken]):
            at[rule] = cut
        return pd.DataFrame([(f.stratum.iat[0], *at)], columns=["stratum", *(f"c_{r}" for r in RULES)])

    return materialise(steps.join(paths.select("stratum", "rules", "cuts"), "stratum").groupBy("stratum").applyInPandas(certify, cutoffs))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add base_failed and kept. cuts has a row for each stratum with cutoffs of its own."""
    passed = F.lit(True)
    for r in RULES:
        passed &= F.col(f"r_{r}") <= F.coalesce(F.col(f"c_{r}"), F.lit(LEVELS - 1))
    joined = stats.join(cuts, F.coalesce("lang", F.lit("")) == F.col("stratum"), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passed).drop("stratum", *(f"c_{r}" for r in RULES))


def with_stats(docs: DataFrame) -> DataFrame:
    """docs with the columns of STAT_SCHEMA added."""
    return text_batches(docs).withColumn("_s", F.pandas_udf(stat_batches, STAT_SCHEMA)("text")).select(*(docs[c] for c in docs.columns), "_s.*")


def quality_verdicts(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, lang, base counts, rule grid values, base_failed, kept."""
    stats = materialise(with_stats(docs.select("doc_id", "lang", "text")).drop("text"))
    return judged(stats, select_cutoffs(stats, labels, **how))


def quality_filter(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The kept documents with all their columns; texts are read again rather than shuffled or stored."""
    own = docs.select("doc_id", "lang", "text")
    cutoffs = select_cutoffs(materialise(with_stats(own).drop("text")), labels, **how)
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "lang", "text")  # other columns may have any names
    return judged(with_stats(whole), cutoffs).where("kept").select("_doc.*")
