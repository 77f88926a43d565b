"""Personal data: fixed forms, and identifiers found by bootstrapped contextual extraction.

Everything runs as DataFrame expressions. The fixed forms (email, ip, card, phone) are seed entities.
The context of a seed induces lexical patterns: the word before it, the two words before it, the word after it, and
the word before it together with its outline, digits and letters folded. Other text of an identifier's
outline under the same patterns is an instance: words and groups of numbers that hold at least four digits in all,
and addresses that spell out at and dot ("jane(at)host.org", "jane at host dot org"), which count for email
alone. Fewer digits are taken for no identifier. The bipartite graph of patterns and instances is scored in
rounds: a pattern's confidence for a kind is the mean of its instances' scores with a prior against it, an
instance's is that of its best pattern before it and its best after it combined as independent evidence; seeds
keep a score of 1. Instances whose score passes the threshold count as seeds of further patterns in the next round,
so generations of patterns and instances follow. Instances under a pattern that ends above the threshold,
with enough different seeds, become spans of that kind.

The graph is built of distinct (pattern, instance) pairs of patterns with enough instances, so a pattern or an
instance that occurs in a third of all texts weighs one edge per counterpart. Texts are read once; only spans and
candidates are stored and shuffled. Places and contexts come from the text between matches, folded in
chunks, so that a text of very many numbers takes time in proportion to its length.

Defined results: a null or empty text has no spans and the digest of the empty string. Spans are code
points, end exclusive. Spans of one kind don't overlap; those of different kinds may. A candidate that
holds part of a fixed form is no candidate. Repeated rows each have their own spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.llm.common import join_spread, materialise

#: Kinds in output order.
KINDS = ("email", "ip", "card", "phone")
# The forms, with atomic loops and starts at run ends: the same leftmost matches, in linear time.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text may hold the form at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: An address with at and dot spelt out.
SPELT = r"[A-Za-z0-9._%+-]++(?: ?[(\[{<](?i:at)[)\]}>] ?| (?i:at) )[A-Za-z0-9-]++(?:(?:\.| ?[(\[{<](?i:dot)[)\]}>] ?| (?i:dot) )[A-Za-z0-9-]++)++"
GROUP = r"[0-9](?:[()./-]*+[0-9])*+\)?+"
#: Spelt addresses, groups of numbers with single spaces between, words that hold at least four digits.
CANDIDATE = rf"(?<![^ \t-\r])(?:{SPELT}|[+(]*+{GROUP}(?: [+(]?+{GROUP}(?=[.,;:!?)\]]*+(?:[ \t-\r]|$)))++|(?:[^ \t-\r0-9]*+[0-9]){{4}}[^ \t-\r]*+)"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: How far around a span its words are looked for, in code points.
REACH = 48
#: Elements of an array that are folded at once, and code points of a text that are cut from at once.
CHUNK, CUT = 256, 1024
#: Stands in for the characters of fixed forms where candidates are sought.
COVER = "\0"
SPAN = "struct<start:int,stop:int,hit:string,before:string,after:string>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def spelt(x: Column) -> Column:
    return x.rlike(rf"^{SPELT}$")


def passes(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits(x)).between(12, 19) & F.call_function("luhn_check", digits(x))
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    return F.lit(True)


def chunked(items: Column) -> Column:
    last = F.floor((F.size(items) - 1) / CHUNK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * CHUNK + 1, CHUNK))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(F.array(items), 1, 0))


def running(chunks: Column, after: Callable[[Column, Column], Column], made: Callable[[Column, Column], Column], kind: str) -> Column:
    """array<kind> of made(state, x) for each x of chunks of an array; the state is an int, at first 0, and after(state, x) follows it.

    Arrays grow by copies here, so a fold of all items would take time by their square; chunks bound that.
    """
    none = F.array().cast(f"array<{kind}>")
    states = F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, c: F.struct(F.aggregate(c, a["at"], after).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
        lambda a: a["all"],
    )
    grown = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("all")), lambda a, x: F.struct(after(a["at"], x).alias("at"), F.concat(a["all"], F.array(made(a["at"], x))).alias("all")), lambda a: a["all"])
    return F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), states.alias("s")), lambda z: grown(z["c"], z["s"])))


def pieces(text: Column, form: str) -> Column:
    """array<struct<gap, hit, before, after>>: text up to each leftmost match, the match, and what is around it; one element more ends the text."""
    gaps, hits = F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0))
    return F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))


def located(df: DataFrame, name: str, text: str, form: str, where: Column) -> DataFrame:
    """df with name: array<SPAN> of the leftmost matches of form in the column text, in rows where ``where`` holds."""
    at = "_p" + name
    near = lambda i, side: F.coalesce(F.get(F.col(at), i)[side], F.lit(""))
    before = lambda i: F.right(F.concat(F.right(near(i - 1, "gap"), F.lit(REACH)), near(i - 1, "hit"), F.right(near(i, "gap"), F.lit(REACH))), F.lit(REACH))
    after = lambda i: F.left(F.concat(F.left(near(i + 1, "gap"), F.lit(REACH)), near(i + 1, "hit"), F.left(near(i + 2, "gap"), F.lit(REACH))), F.lit(REACH))
    parted = df.withColumn(at, F.when(where & F.col(text).rlike(form), pieces(F.col(text), form)))
    told = F.transform(at, lambda x, i: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), before(i).alias("before"), after(i).alias("after")))
    # a column of its own: what is named in a lambda is worked out for every element
    parted = parted.withColumn(at + "t", F.when(F.col(at).isNotNull(), F.slice(told, 1, F.size(at) - 1)))
    parted = parted.withColumn(at + "c", F.when(F.col(at).isNotNull(), chunked(F.col(at + "t"))))
    start = lambda s, x: s + F.length(x["gap"])
    stop = lambda s, x: s + F.length(x["gap"]) + F.length(x["hit"])
    span = lambda s, x: F.struct(start(s, x).alias("start"), stop(s, x).alias("stop"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))
    found = F.when(F.col(at).isNotNull(), running(F.col(at + "c"), stop, span, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))
    return parted.withColumn(name, found).drop(at, at + "t", at + "c")


def covered(text: Column, kind: str) -> Column:
    """text with the matches of a kind's form that pass its test covered."""
    over = lambda x: F.concat(x["gap"], F.coalesce(F.when(passes(kind, x["hit"]), F.repeat(F.lit(COVER), F.length(x["hit"]))).otherwise(x["hit"]), F.lit("")))
    return F.array_join(F.transform(pieces(text, FORMS[kind]), over), "")


def outline(hit: Column) -> Column:
    """Digits folded to 9, letters to a, runs to one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[0-9]+", "9"), r"\p{L}+", "a"), r"[.,;:!?)\]]+$", "")


def patterns(x: Column) -> Column:
    """array<struct<side, pattern>> of a span: its words before and after, and its outline with the word before."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "), "[0-9]+", "9"), " "), lambda w: w != "")
    ahead, behind = words(x["before"]), words(x["after"])
    one, two, next_ = F.get(ahead, F.size(ahead) - 1), F.get(ahead, F.size(ahead) - 2), F.get(behind, F.lit(0))
    named = ((0, F.concat(F.lit("b:"), one)), (0, F.concat(F.lit("bb:"), two, F.lit(" "), one)), (0, F.concat(F.lit("bs:"), one, F.lit(" "), outline(x["hit"]))), (1, F.concat(F.lit("a:"), next_)))
    return F.filter(F.array(*(F.struct(F.lit(side).alias("side"), p.alias("pattern")) for side, p in named)), lambda p: p["pattern"].isNotNull())


def passing(kind: str) -> Column:
    return F.filter(f"_{kind}", lambda x: passes(kind, x["hit"]))


def of_kind(kind: str) -> Column:
    """The matches of a form as (start, kind, stop, hit, before, after)."""
    i = F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(f"_{kind}", lambda x: F.struct(x["start"].alias("start"), i, x["stop"].alias("stop"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after")))


def scanned(docs: DataFrame, *carried: str) -> DataFrame:
    """Per row: carried columns, base (start, kind, stop, hit, before, after) and cand (start, stop, hit, before, after)."""
    found = docs.select(*carried, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for kind, form in FORMS.items():
        found = located(found, f"_{kind}", "text", form, F.contains("text", F.lit(HINTS[kind])) if HINTS[kind] else F.lit(True))
    found = found.withColumns({f"_{kind}": passing(kind) for kind in KINDS})
    found = found.withColumn("base", F.array_sort(F.concat(*map(of_kind, KINDS)))).withColumn("_free", F.col("text"))
    for kind in ("email", "phone", "ip", "card"):
        found = found.withColumn("_free", F.when(F.size(f"_{kind}") > 0, covered(F.col("_free"), kind)).otherwise(F.col("_free")))
    found = located(found, "cand", "_free", CANDIDATE, F.lit(True))
    held = F.filter("cand", lambda c: ~F.contains(c["hit"], F.lit(COVER)) & ((F.length(digits(c["hit"])) >= 4) | spelt(c["hit"])))
    return found.withColumn("cand", held).select(*carried, "base", "cand")


def confident_patterns(found: DataFrame, rounds: int, least_seeds: int, threshold: float, prior: float) -> DataFrame:
    """pattern, kind, confidence, n (occurrences) of the patterns whose confidence passes; one kind per pattern."""
    edge = lambda x, kind: [F.xxhash64(f"{x}.hit").alias("item"), kind.cast("int").alias("kind"), spelt(F.col(f"{x}.hit")).alias("spelt"), F.explode(patterns(F.col(x))).alias("p")]
    seeds = found.select(F.explode("base").alias("x")).select(*edge("x", F.col("x.kind")))
    others = found.select(F.explode("cand").alias("x")).select(*edge("x", F.lit(None)))
    pairs = materialise(seeds.union(others).groupBy("p.side", "p.pattern", "item").agg(F.max("kind").alias("kind"), F.some("spelt").alias("spelt"), F.count("*").alias("times")))
    # fewer instances than seeds needed never make a pattern; n: the occurrences of one
    wide = materialise(pairs.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("times").alias("occurrences")).where(F.col("n") >= least_seeds))
    edges = materialise(join_spread(pairs, wide, ["pattern"], pairs.count()))
    size = edges.count()
    fits = ~F.col("spelt") | (F.col("for") == KINDS.index("email"))
    believed = scores = None
    for _ in range(rounds):
        known = edges.withColumn("seed", F.col("kind"))
        if believed is not None:
            known = edges.join(believed.where(F.col("belief") >= threshold).groupBy("item").agg(F.max_by("for", F.struct("belief", "for")).alias("found")), "item", "left").withColumn("seed", F.coalesce("kind", "found")).drop("found")
        kinds = known.groupBy("pattern").agg(F.mode("seed", deterministic=True).alias("for"), F.count("seed").alias("seeds"), F.count("*").alias("n")).where(F.col("seeds") >= least_seeds).select("pattern", "for", "n")
        now = join_spread(known, kinds, ["pattern"], size).where(F.col("kind").isNotNull() | fits)
        belief = F.lit(0.0)
        if believed is not None:
            now, belief = now.join(believed, ["item", "for"], "left"), F.coalesce("belief", F.lit(0.0))
        now = now.withColumn("score", F.when(F.col("kind").isNull(), belief).otherwise((F.col("kind") == F.col("for")).cast("double")))
        scores = materialise(now.groupBy("pattern", "for").agg((F.sum("score") / (F.count("*") + prior)).alias("confidence"), F.count("*").alias("n"), F.max("occurrences").alias("occurrences")))
        told = join_spread(edges.where("kind is null").drop("occurrences"), scores.drop("occurrences"), ["pattern"], size).where(fits)
        sides = told.groupBy("item", "for", "side").agg(F.max("confidence").alias("confidence"))
        believed = materialise(sides.groupBy("item", "for").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("belief")))
    return scores.where(F.col("confidence") >= threshold).select("pattern", F.col("for").alias("kind"), "confidence", F.col("occurrences").alias("n"))


def extensions(found: DataFrame, *key: str, rounds: int = 3, least_seeds: int = 5, threshold: float = 0.8, prior: float = 1.0) -> DataFrame:
    """key and more: the spans that confident patterns add to rows of found, as (start, kind, stop); each of the kind of its best pattern."""
    known = materialise(confident_patterns(found, rounds, least_seeds, threshold, prior))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = found.select(*key, F.explode("cand").alias("x")).select(*key, "x.start", "x.stop", spelt(F.col("x.hit")).alias("spelt"), F.explode(patterns(F.col("x"))).alias("p")).select(*key, "start", "stop", "spelt", "p.pattern")
    hits = join_spread(hits, known, ["pattern"], total).where(~F.col("spelt") | (F.col("kind") == KINDS.index("email")))
    best = hits.groupBy(*key, "start", "stop").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    # written first, so that its size is known: rows are shuffled only where it is too large to broadcast
    return materialise(best.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("more")))


def plain(base: str = "base") -> Column:
    return F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))


def personal_data(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = materialise(scanned(docs, "doc_id").withColumn("_row", F.monotonically_increasing_id()))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")
    both = F.when(F.col("more").isNull(), plain()).otherwise(F.array_sort(F.concat(plain(), "more")))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    counts = [count(i) for i in range(len(KINDS))]
    return found.join(extensions(found, "_row", **how), "_row", "left").select("doc_id", *counts, F.sha2(listed(plain()), 256).alias("base_sha256"), listed(both).alias("spans"))


def redacted(docs: DataFrame, **how) -> DataFrame:
    """docs with every span replaced by its kind in brackets, [EMAIL] and so on; n_chars follows. Texts stay null where null.

    Texts are scanned twice rather than stored or shuffled: once for the patterns, once to redact. Rows
    find their added spans by two hashes of id and text; equal rows have equal spans.
    """
    columns = docs.columns
    whole = docs.select(F.struct(*columns).alias("_doc"), F.col("text"), F.col("doc_id"))  # other columns may have any names
    keyed = whole.withColumn("_raw", F.col("text")).withColumns({f"_h{i}": F.xxhash64(F.lit(i), "doc_id", "text") for i in (1, 2)})
    found = materialise(scanned(keyed, "_h1", "_h2"))  # no filter: its push through these columns would copy them many times
    more = extensions(found, "_h1", "_h2", **how)
    rows = scanned(keyed, "_doc", "_raw", "_h1", "_h2").join(more, ["_h1", "_h2"], "left")
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.coalesce("_raw", F.lit(""))
    # a text is cut from its blocks: a piece is sought in those that hold it, not from the text's beginning
    cut = lambda start, stop: F.substring(F.array_join(F.slice("_blocks", F.floor(start / CUT).cast("int") + 1, F.floor(stop / CUT).cast("int") - F.floor(start / CUT).cast("int") + 1), ""), start % CUT + 1, stop - start)
    shown = lambda at, x: F.when(x["start"] < at, "").otherwise(F.concat(cut(at, x["start"]), F.get(tags, x["kind"])))
    rows = rows.withColumn("_spans", F.array_sort(F.concat(plain(), F.coalesce("more", none)))).withColumn("_chunks", F.when(F.size("_spans") > 0, chunked(F.col("_spans"))))
    rows = rows.withColumn("_blocks", F.when(F.size("_spans") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))
    parts = F.array_join(running(F.col("_chunks"), lambda at, x: F.greatest(at, x["stop"]), shown, "string"), "")
    end = F.array_max(F.transform("_spans", lambda x: x["stop"]))
    made = rows.withColumn("_text", F.when(F.size("_spans") > 0, F.concat(parts, cut(end, F.length(text)))).otherwise(F.col("_raw")))
    size = F.when(F.col("_text").isNull(), F.col("_doc.n_chars")).otherwise(F.length("_text").cast("long")) if "n_chars" in columns else None
    changed = {"text": F.col("_text"), "n_chars": size}
    return made.select(*(changed[c].alias(c) if c in changed else F.col("_doc").getField(c).alias(c) for c in columns))
