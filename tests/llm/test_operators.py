"""Every operator against a brute-force form, and on null, empty, long, tied, repeated and clashing input."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wirelark.llm import ann, bpe, packing, pii, quality, secrets, sharding, simhash, tokencount, warc

SF = "/root/testdata/sf0.001"
JSON, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "", "en", "s", 0), (2, None, None, None, None), (None, "the end " * 9, "en", None, 1), (4, "same text here", "en", "s", 1), (4, "same text here", "en", "s", 1), (5, "same text here", "fr", "s", 1), (6, "x" * 200_000, "en", "s", 1), (7, "word " * 40_000, "en", "s", 1), (8, "日本 é 😀\n\t a@b.co +1 (555) 123-4567 <|endoftext|>", "en", "s", 1), (9, " \n\t ", "en", "s", 1)]
QUIRKS = ["spans", "kept", "shard", "part", "slot", "fp0", "node", "_row", "x", "count", "base", "more", "level", "stratum", "sequence_id"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({q: F.lit("clash") for q in QUIRKS})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, odd):
    random.seed(1)
    texts = [r.text for r in docs.collect()] + [t for _, t, *_ in ODD] + [" ".join(random.choice("abc") for _ in range(random.randrange(60))) for _ in range(300)]
    assert all(quality.text_stats(t)[:5] == brute_stats(t) for t in texts)
    out = quality.quality_verdicts(odd, labels(spark)).collect()
    assert len(out) == len(ODD) and not any(r.kept for r in out if r.n_words < 20) and all(r.kept == (not r.base_failed) for r in out)


def test_quality_guarantee(spark):
    random.seed(2)
    n = 4000
    rows = [(i, " ".join(["word%d" % random.randrange(999) for _ in range(30)] + (["#"] * 60 if i % 4 == 0 else [])), random.choice(["en", "fr"]), "s", 1) for i in range(n)]
    d = spark.createDataFrame(rows, DOCS)
    out = quality.quality_verdicts(d, labels(spark, [(i, int(i % 4 > 0), 0) for i in range(0, n, 2)])).collect()
    bad = [r.kept for r in out if r.doc_id % 4 == 0]
    good = [r.kept for r in out if r.doc_id % 4]
    assert sum(bad) == 0 and sum(good) >= 0.98 * len(good)


def test_cutoffs_hold_their_risk():
    """Over 200 holdouts drawn alike, the certified cutoff rejects more than the risk of all good documents no oftener than the level says."""
    rng = np.random.default_rng(18)
    chance = 0.97 ** np.arange(256)[::-1] + 0.002
    good_p = chance[::-1] / chance.sum()
    worse = 0
    for _ in range(200):
        good, bad = rng.multinomial(500, good_p), rng.multinomial(200, np.full(256, 1 / 256))
        cut = quality.certified_cutoff(good, bad, 0.02, 0.05, 1.0)
        worse += good_p[cut + 1 :].sum() > 0.02
    assert worse <= 0.05 * 200 + 3 * math.sqrt(0.05 * 0.95 * 200)


def test_quality_by_stratum(spark):
    """320 good labels certify cutoffs of their own; 100 don't, and another language's cutoffs don't apply there."""
    random.seed(12)
    text = lambda mark: " ".join(f"{mark}w{random.randrange(10**6)}" for _ in range(40))
    made = [("en", 1, 1600), ("en", 0, 300), ("fr", 1, 320), ("fr", 0, 100), ("de", 1, 100), ("de", 0, 30), (None, 0, 30)]
    rows = [(lang, good, text("" if good and lang != "de" else "##")) for lang, good, n in made for _ in range(n)]
    d = spark.createDataFrame([(i, t, lang, "s", 1) for i, (lang, _, t) in enumerate(rows)], DOCS)
    out = {r.doc_id: r.kept for r in quality.quality_verdicts(d, labels(spark, [(i, good, 0) for i, (_, good, _) in enumerate(rows)])).collect()}
    share = lambda lang, good: np.mean([out[i] for i, (a, b, _) in enumerate(rows) if (a, b) == (lang, good)])
    assert share("en", 0) == share("fr", 0) == 0 and share("en", 1) >= 0.98 and share("fr", 1) >= 0.98
    assert share("de", 1) == share("de", 0) == share(None, 0) == 1


def test_binomial_tail():
    assert abs(quality.binomial_tail(2, 10, 0.3) - sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(3))) < 1e-12
    g = np.zeros(256, int)
    g[3] = 100
    assert quality.certified_cutoff(g, g, 0.004, 0.001, 1) == 255


def test_quality_filter_keeps_columns(spark, odd, empty):
    assert quality.quality_filter(odd, labels(spark)).columns == odd.columns
    assert quality.quality_filter(empty, labels(spark)).count() == 0


def brute_nearest(v, ids, q, k):
    s = (v * q).cumsum(axis=1)[:, -1]
    return s


@pytest.mark.parametrize("n,dup", [(900, 0), (900, 300), (15, 0)])
def test_nearest(spark, n, dup):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 8)).astype(np.float32)
    if dup:
        v[:dup] = v[0]
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(n)] + [(9001, None, 0), (9002, [0.0] * 8, 0), (9003, [float("nan")] * 8, 0), (9004, [1.0] * 7, 0), (9005, [1.0, None] + [0.0] * 6, 0), (None, [1.0] * 8, 0), (9006, [float("inf")] * 8, 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("list", F.lit(1))
    got = {}
    for r in ann.nearest(e, e.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in range(0, n, 20):
        s = (v.astype(float) * v[q].astype(float)).cumsum(axis=1)[:, -1]
        want = sorted((-s[i], i) for i in range(n) if i != q)[:20]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, min(20, n - 1) + 1)) and all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
        assert all(abs(sc - s[i]) < 1e-12 for _, i, sc in mine)
        hits, total = hits + len({i for _, i in want} & {i for _, i, _ in mine}), total + len(want)
    assert hits >= 0.9 * total


@pytest.mark.parametrize("same", [True, False])
def test_nearest_of_repeated_rows(spark, same):
    """A near vec_id of many rows, equal or not, takes one place of the twenty."""
    rng = np.random.default_rng(3)
    v = np.abs(rng.normal(size=(200, 8)))
    v[1] = 9.0
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(200)] * 2 + [(1, [9.0 - (0.0 if same else 0.001 * j)] * 8, 0) for j in range(60)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    some = ann.nearest(e, e.where("vec_id % 50 = 0"), k=20).groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).collect()
    assert len(some) == 4 and all(r.n == 20 for r in some)
    got = ann.nearest(e, e.where("vec_id % 50 = 0"), k=20, lists=1).collect()  # one list: an exhaustive search
    for q in range(0, 200, 50):
        s = v.astype(np.float32).astype(float) @ v[q].astype(np.float32).astype(float)
        assert [r.vec_id for r in sorted(got) if r.query_id == q] == sorted((i for i in range(200) if i != q), key=lambda i: -s[i])[:20]


@pytest.mark.parametrize("kind,n", [("clustered", 6000), ("unclustered", 3000)])
def test_lists_are_selected(spark, kind, n):
    """At the defaults: many lists, some vectors in several, few lists probed where there are clusters; recall against brute force."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    v = (centres[rng.integers(0, 40, n)] + 0.6 * rng.normal(size=(n, 32)) if kind == "clustered" else rng.normal(size=(n, 32))).astype(np.float32)
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    placed, probes, _ = ann.placed_and_probed(e, e.where("vec_id % 20 = 0"), 20, None, 100_000, 3, 0.1, 0.96)
    homes = [len(r.lists) for r in placed.select("lists").collect()]
    probed = [len(r.lists) for r in probes.select("lists").collect()]
    lists = placed.selectExpr("explode(lists) AS l").distinct().count()
    assert lists >= 25 and 0.03 < np.mean([h > 1 for h in homes]) < 0.5
    assert np.mean(probed) < (lists / 3 if kind == "clustered" else 0.9 * lists)
    got = {}
    for r in ann.nearest(e, e.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = v.astype(float)
    want = {q: set(sorted((i for i in range(n) if i != q), key=lambda i, s=x @ x[q]: (-s[i], i))[:20]) for q in range(0, n, 20)}
    assert sum(len(want[q] & got[q]) for q in want) >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("kind,n", [("far queries", 4000), ("unit", 4000)])
def test_recall_on_other_rows(spark, kind, n):
    """Queries unlike the rows, and vectors of one length without clusters: recall is calibrated on the queries themselves."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=(n, 64))
    if kind == "unit":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    else:
        v[np.arange(n) % 20 > 0] = v[np.arange(n) % 20 > 0] * 0.1 + 3 * np.eye(64)[0]
    v = v.astype(np.float32)
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(e, e.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = v.astype(float)
    want = {q: set(sorted((i for i in range(n) if i != q), key=lambda i, s=x @ x[q]: (-s[i], i))[:20]) for q in range(0, n, 20)}
    assert sum(len(want[q] & got[q]) for q in want) >= 0.95 * 20 * len(want)


def test_true_neighbours():
    """Brute force over batches: best score of a repeated vec_id, equal vectors by vec_id, lists of what is found."""
    rng = np.random.default_rng(1)
    v, ids = rng.normal(size=(300, 4)), np.r_[np.arange(250), np.arange(50)]
    v[60:120] = v[60]
    f = pd.DataFrame({"vec_id": ids, "embedding": list(v), "lists": [np.array([i]) for i in range(300)]})
    got = ann.true_neighbours(np.array([7, 60]), v[[7, 60]], iter([f[:100], f[100:100], f[100:]]), 5)
    for at, own in enumerate((7, 60)):
        s = (v * v[own]).cumsum(axis=1)[:, -1]
        best = {}
        for i in sorted(range(300), key=lambda i: -s[i]):
            best.setdefault(int(ids[i]), i)
        want = sorted((-s[i], j, i) for j, i in best.items() if j != own)[:5]
        mine = got[got["at"] == at]
        assert list(zip(-mine.score, mine.vec_id)) == [w[:2] for w in want]
        assert all((v[h[0]] == v[w[2]]).all() for h, w in zip(mine.lists, want))


def test_nearest_of_doubles(spark):
    """Scores are those of the vectors as they are, in double precision and of any size."""
    rows = [(i, [0.1 * i + 1e-12, 1.0 + 1e-13 * i, 1e39 if i % 2 else 0.3]) for i in range(40)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = np.array([x for _, x in rows])
    for r in ann.nearest(e, e.where("vec_id % 20 = 0"), k=5).collect():
        assert r.score == (v[r.vec_id] * v[r.query_id]).cumsum()[-1]


def test_nearest_of_nothing(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ann.nearest(e, e).count() == 0


def test_sharding(spark, docs, odd, empty):
    tree = sharding.HashTree.even(2, 2, 2)
    for d in (docs, odd):
        rows = sharding.sharded(d, tree).collect()
        assert len(rows) == d.count()
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        assert all(r.grown_shard in (r.shard, 8) for r in rows)
        texts = {r.doc_id: r.text for r in d.collect()}
        assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r["size"] == len((texts[r.doc_id] or "").encode()) + 1 for r in rows)
    assert sharding.sharded(empty, tree).count() == 0


def test_shards_are_the_least_draws(spark):
    """The descent, computed once more from the hashes of key and child."""
    import struct

    import xxhash

    tree = sharding.HashTree.even(2, 2, 2).reweighted(3, 2.5)

    def weight(node):
        return float(node[1]) if isinstance(node[0], int) else sum(map(weight, node))

    def least(key, nodes, names):
        draws = []
        for node, name in zip(nodes, names):
            h = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
            draws.append((-math.log(((h >> 11) + 0.5) / 2**53) / weight(node), node))
        return min(draws, key=lambda d: d[0])[1]

    def shard(key, regions):
        region = least(key, regions, [f"0:{i}" for i in range(len(regions))])
        rack = least(key, region, [f"1:{regions.index(region)}.{i}" for i in range(len(region))])
        return least(key, rack, [f"2:{s}" for s, _ in rack])[0]

    rows = spark.range(-500, 500).select("id", tree.shard_of(F.col("id")).alias("s"), tree.with_shard(2.0).shard_of(F.col("id")).alias("g")).collect()
    assert all(r.s == shard(r.id, tree.regions) and r.g == shard(r.id, tree.with_shard(2.0).regions) for r in rows)


def test_reweighting_moves_within_its_subtree(spark):
    tree = sharding.HashTree.even(2, 2, 2)
    r = spark.range(4000).select(tree.shard_of(F.col("id")).alias("a"), tree.reweighted(5, 3.0).shard_of(F.col("id")).alias("b")).where("a != b").collect()
    assert r and all(x.b >= 4 for x in r) and not any(x.a == 5 for x in r)


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


FORMS = dict(email=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", ip=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", card=r"[0-9]([\x20-]?[0-9])+", phone=r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    out = []
    for i, (k, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[k]:
                out.append((m.start(), i, m.end(), k))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_base(spark, docs, odd, empty):
    random.seed(3)
    al = ["a", "1", "12", "255", "256", "0", ".", "@", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "a@b.c", "x_", "1.2.3.4", "é", "😀", "\n", "%", "+1 (555) 123-4567"]
    texts = ["".join(random.choice(al) for _ in range(random.randrange(25))) for _ in range(2000)] + [t for _, t, *_ in ODD] + [r.text for r in docs.collect()] + ["1" * 50_000, "a@" + "b." * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert all(got[i].base_sha256 == hashlib.sha256(brute_pii(t).encode()).hexdigest() for i, t in enumerate(texts))
    assert all(set(filter(None, brute_pii(t).split(","))) <= set(got[i].spans.split(",")) for i, t in enumerate(texts))
    assert pii.personal_data(odd).count() == len(ODD) and pii.personal_data(empty).count() == 0


def test_pii_finds_unseen_identifiers(spark):
    seen = [(i, f"please ring +1 (555) 123-{4000 + i} now", "en", "s", 1) for i in range(40)]
    new = [(100, "please ring 0049/30/998877 now", "en", "s", 1), (101, "year 2024/2025 came", "en", "s", 1)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(seen + new, DOCS)).collect()}
    assert got[100].spans == "phone:12:26" and got[100].n_phone == 0 and got[101].spans == ""


def test_pii_finds_spaced_and_spelt_identifiers(spark):
    seen = [(i, f"please ring +1 (555) 123-{4000 + i} or mail u{i}@host.org now", "en", "s", 1) for i in range(60)]
    texts = ["ring 030 1234567", "ring 0171 5551234 today", "ring 5 10 times", "mail jane(at)host.org", "mail jane at host dot org, please", "ring jane(at)host.org", "walk 030 1234567"]
    rows = seen + [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[100 + i] for i in range(len(texts))] == ["phone:5:16", "phone:5:17", "", "email:5:21", "email:5:25", "", ""]


def test_pii_instances_are_seeds_of_further_patterns(spark):
    made = [(f"ring +1 (555) 123-{4000 + i}") for i in range(200)] + [f"ring 0049/30/{998800 + i} or dial 0049/30/{998800 + i}" for i in range(9)] + ["dial 0049/30/111111"]
    got = [r.spans for r in pii.personal_data(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(made)], DOCS)).orderBy("doc_id").collect()]
    assert got[-1] == "phone:5:19"


def test_redaction(spark, odd):
    rows = {(r.doc_id, r.text): r for r in pii.redacted(odd).collect()}
    text = next(t for (i, t) in rows if i == 8)
    assert "[EMAIL]" in text and "[PHONE]" in text and "@" not in text and pii.redacted(odd).columns == odd.columns
    assert sum(r.text is None for r in rows.values()) == 1


def brute_components(texts, ids, size, bits):
    import xxhash

    fps = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sh = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in sh]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(f"{f:016x}", least.get(find(i))) for i, f in enumerate(fps)]


def test_simhash(spark, docs, odd, empty):
    for d in (docs, odd):
        rows = d.collect()
        want = brute_components([r.text for r in rows], [r.doc_id for r in rows], 3, 2)
        got = simhash.near_duplicates(d).select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("f"), "component_id").collect()
        key = lambda x: tuple(-1 if v is None else v for v in x)
        assert sorted(((r.doc_id, r.f, r.component_id) for r in got), key=lambda x: str(key(x))) == sorted(((r.doc_id, *w) for r, w in zip(rows, want)), key=lambda x: str(key(x)))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits,per_shard", [(2, 50), (6, 200), (2, 10**6)])
def test_simhash_shards_lose_no_link(spark, bits, per_shard):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << int(k)) for k in rng.integers(0, 63, 12)), *(base ^ np.uint64(5 << int(k)) for k in rng.integers(0, 60, 6))]))
    links = np.array([np.bitwise_count(x ^ fps) for x in fps]) <= bits
    want = simhash.forest(len(fps), *np.nonzero(links))
    df = spark.createDataFrame([(int(x.view(np.int64)), 1, int(x.view(np.int64))) for x in fps], "node long, n_shingles long, fp0 long")
    edges = simhash.shard_links(df.withColumn("least", F.lit(1).cast("long")), ["fp0"], simhash.Link(bits), per_shard, 64)
    roots = {r.node.node: r.root.node for r in simhash.components(edges).collect()}
    got = [roots.get(int(x.view(np.int64)), int(x.view(np.int64))) for x in fps]
    assert len({(a, b) for a, b in zip(got, want.tolist())}) == len(set(got)) == len(set(want.tolist()))


def test_joins_beyond_what_is_broadcast(spark):
    """Hot and other keys of a table too large to broadcast join as they would otherwise."""
    from wirelark.llm.common import join_spread

    left = spark.range(6000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = [sorted(map(tuple, join_spread(left, right, ["k"], 6000, most).select("k", "id", "m").collect())) for most in (10**6, 0)]
    assert got[0] == got[1] and len(got[0]) == 6000


def test_dedup_keeps_one_of_each_group(spark, odd):
    random.seed(6)
    text = [f"w{random.randrange(10**6)}" for _ in range(300)]
    near = text.copy()
    near[150] = "changed"
    rows = [(1, " ".join(text), "en", "s", 1), (2, " ".join(text), "en", "s", 1), (3, " ".join(near), "en", "s", 1), (4, " ".join(random.choice(text) + "x" for _ in range(300)), "en", "s", 1), (1, " ".join(text), "en", "s", 1)]
    assert sorted(r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, DOCS)).collect()) == [1, 4]
    assert simhash.deduplicated(odd).columns == odd.columns


def test_dedup_of_a_doc_id_with_several_texts(spark):
    random.seed(13)
    a, b, c = (" ".join(f"w{random.randrange(10**6)}" for _ in range(300)) for _ in range(3))
    # 5 is the least of a's group but not of b's; 1 is the least of b's and of c's
    rows = [(5, a), (6, a), (1, b), (5, b), (1, c), (1, c), (7, c)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    assert sorted((r.doc_id, r.text) for r in simhash.deduplicated(d).collect()) == sorted([(5, a), (1, b), (1, c)])


def awkward_texts():
    random.seed(7)
    al = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "a", "Z", "1", "½", "!", "é", "日", " ", "\x1c", "\x85", "😀", "́", "_", "<|endoftext|>"]
    return ["".join(random.choice(al) for _ in range(random.randrange(30))) for _ in range(3000)] + ["a" * 20_000, "ab" * 3000 + " " * 3000 + "x", "!" * 5000, "", None]


def test_token_counts(spark, odd, empty):
    lib, mine = Tokenizer.from_file(JSON), tokencount.MergeCounter(JSON, P.PATTERN)
    texts = awkward_texts()
    assert [mine.count(t or "") for t in texts] == [len(e.ids) for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = tokencount.token_counts(odd, JSON, P.PATTERN).collect()
    assert len(rows) == len(ODD) and all(r.over_limit == (r.n_tokens > 512) for r in rows) and tokencount.token_counts(empty, JSON, P.PATTERN).count() == 0


def test_bpe_equals_library(spark, odd, empty):
    v = bpe.vocabulary(MULTI)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    texts = [t or "" for t in awkward_texts()]
    ids = v.encode_batch(texts)
    assert all(i.tolist() == enc.encode_ordinary(t) and v.decode(i) == t.encode() and v.offsets(i)[-1] == len(t.encode()) for i, t in zip(ids, texts))
    points = ["a" + chr(c) + "1" + chr(c) + " " + chr(c) for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert all(i.tolist() == enc.encode_ordinary(t) for i, t in zip(v.encode_batch(points), points))
    assert bpe.digests(odd, MULTI).count() == len(ODD) and bpe.digests(empty, MULTI).count() == 0
    assert bpe.encoded(odd, MULTI).where("doc_id = 5").first().decoded == b"same text here"


def optimum(sizes, cap):
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def rec(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= cap:
                rec(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        rec(i + 1, [*bins, sizes[i]])

    rec(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    random.seed(8)
    for _ in range(200):
        cap = random.choice([10, 15, 20])
        sizes = [random.randint(1, cap) for _ in range(random.randint(1, 8))]
        counts, plan = np.bincount(sizes, minlength=cap + 1).astype(np.int64), packing.Plan(cap)
        packing.reduce_instance(counts, plan)
        rest = [s for s in range(cap + 1) for _ in range(counts[s])]
        assert sum(m for _, m in plan.sequences) + (optimum(rest, cap) if rest else 0) == optimum(sizes, cap)


def test_packing(spark, docs, odd, empty):
    lib = Tokenizer.from_file(JSON)
    for d in (docs, odd):
        rows, texts = packing.pack(d, JSON, P.PATTERN).collect(), d.collect()
        want = sorted(len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in texts)
        assert sum(r.length for r in rows) == sum(want) and max(r.length for r in rows) <= 2048
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(by) <= math.ceil(sum(want) / 2048) * 1.1 + 1
    one = next(r for r in rows if r.doc_id == 5)
    ids = np.array([*lib.encode("same text here", add_special_tokens=False).ids, 0], "<u4")
    assert one.ids_crc32 == zlib.crc32(ids.tobytes()) and (one.piece, one.start, one.length) == (0, 0, len(ids))
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 7)
    assert all(n == 2048 for _, _, n in long[1:]) and all(b[1] == a[1] + a[2] for a, b in zip(long, long[1:]))
    assert packing.pack(empty, JSON, P.PATTERN).count() == 0


def test_packing_of_large_ids_beside_nulls(spark):
    ids = [2**60 + 1, None, 2**60 + 3, -(2**62) - 1]
    rows = packing.pack(spark.createDataFrame([(i, "word " * 5000) for i in ids], "doc_id long, text string").coalesce(1), JSON, P.PATTERN).collect()
    assert {r.doc_id for r in rows} == set(ids) and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    full = [r.sequence_id for r in rows if r.length == 2048]
    assert full and len(set(full)) == len(full) and not set(full) & {r.sequence_id for r in rows if r.length < 2048}


def brute_secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, docs, odd, empty):
    random.seed(9)
    al = ["password", "PassWd", "ſecret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", "x"]
    texts = ["".join(random.choice(al) for _ in range(random.randrange(20))) for _ in range(3000)] + [r.text for r in docs.collect()] + [t for _, t, *_ in ODD]
    got = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i].base_sha256 == hashlib.sha256(brute_secrets(t).encode()).hexdigest() for i, t in enumerate(texts))
    assert secrets.secret_spans(odd).count() == len(ODD) and secrets.secret_spans(empty).count() == 0


def test_random_tokens_stand_out(spark):
    random.seed(10)
    abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(i, "see " + "".join(random.choice(abc) for _ in range(64)) + " there", "en", "s", 1) for i in range(50)] + [(100 + i, f"see release-notes-for-version-{i}-of-the-long-named-thing-here there", "en", "s", 1) for i in range(50)] + [(200, "see abcdefghijklmnopqrstuvwxyz0123456789 there", "en", "s", 1)]
    got = {r.doc_id: r.spans for r in secrets.secret_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(got[i] == "random:4:68" for i in range(50)) >= 45 and not any(got[i] for i in range(100, 150)) and got[200] == ""


def test_discoveries_are_mostly_true(spark):
    """Keys among slugs and joined names of ordinary words: the realised share of false discoveries, and the keys found."""
    random.seed(15)
    abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = "release notes for the long named version of thing here report data summary index page team user account sample api test build main feature branch fix".split()
    plain = lambda: ("-" if random.random() < 0.5 else "").join((w.capitalize() if random.random() < 0.5 else w) + (str(random.randrange(99)) if random.random() < 0.3 else "") for w in random.choices(words, k=7))
    made = [("".join(random.choices(abc, k=40 + 24 * (i % 2))), True) for i in range(200)] + [(plain(), False) for _ in range(1500)]
    rows = [(i, f"{' '.join(random.choices(words, k=30))} {t} {' '.join(random.choices(words, k=9))}") for i, (t, _) in enumerate(made)]
    got = {r.doc_id for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string"), rate=0.05).where("spans != ''").collect()}
    false = sum(not made[i][1] for i in got)
    found = [sum(i in got for i in range(k, 200, 2)) for k in (0, 1)]  # of 40 and of 64 characters
    assert false <= 0.05 * max(len(got), 1) and found[0] >= 35 and found[1] >= 90


def test_null_holds_for_ordinary_tokens():
    """Of tokens drawn by the model itself about a share p has a p-value of p or less (twice that at most, as drawn)."""
    rng = np.random.default_rng(16)
    pairs = np.zeros((63, 63))
    null = secrets.Null.of(pairs)
    for band, length in enumerate(secrets.BANDS[:4]):
        sums = secrets.battery(secrets.ordinary_tokens(pairs, 20_000, length, rng))
        levels = np.array([null.level(band, x) for x in sums[np.isfinite(sums)]])
        assert all((levels >= k).mean() <= 2 * 10**-k for k in (1, 2, 3))


def test_warc(spark):
    big = "<p>" + "y" * 2000
    rows = [(1, "http://a/ b", big), (2, "u", big), (3, "u", "small"), (4, "u", "small"), (5, None, None), (None, "u", big), (2, "u", big), (6, "u\r\nX: 1", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if r.page_id in (1, None) else ("response", None))
    assert warc.round_trip(pages.where("page_id = 99")).count() == 0
    decisions = [sorted(map(str, warc.with_decisions(pages, 1000, most).collect())) for most in (10, 0)]
    assert decisions[0] == decisions[1] and len(decisions[0]) == len(rows)


def test_large_payload(spark):
    """A payload of many read steps and inflated buffers comes back whole, after and before others."""
    random.seed(14)
    big = "".join(chr(random.randrange(32, 0x2FFF)) for _ in range(2_000_000))
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(["a", big, "b", big, "z" * 3_000_000])], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert [got[i].record_type for i in range(5)] == ["response", "revisit", "response", "response", "response"] and got[1].refers_to == 3
    assert got[3].payload_digest == got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and got[4].payload_bytes == 3_000_000


@pytest.mark.parametrize("harm", ["cut", "flip", "digest"])
def test_damaged_archives(harm):
    import io

    data = bytearray(warc.record(1, "u", b"hello" * 50) + warc.record(2, "u", b"x"))
    assert [r[0] for r in warc.read_records(io.BytesIO(bytes(data)))] == [1, 2]
    if harm == "cut":
        data = data[:-9]
    elif harm == "flip":
        data[60] ^= 255
    else:
        raw = zlib.decompress(warc.record(1, "u", b"hello"), 31).replace(b"hello", b"hallo")
        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = gz.compress(raw) + gz.flush()
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(bytes(data))))


def test_pipeline(spark, odd, empty, tmp_path):
    import corpus_pipeline as pipe

    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd, empty):
        docs = start
        for name, stage in pipe.STAGES:
            before = docs.columns
            docs = stage(spark, docs, str(tmp_path))
            assert name == "packing" or docs.columns == before
    rows = pipe.run(spark, SF).collect()
    kept = {r.doc_id for r in rows}
    assert 0 < len(kept) < 200 and max(r.length for r in rows) <= 2048


COLUMNS = {
    "op1_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op5_simhash": "doc_id fingerprint component_id",
    "op6_tokencount": "doc_id n_bytes n_tokens over_limit",
    "op8_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_registered_queries(spark, docs, name):
    """The queries as registered: their columns, a row for each document, and what brute force gives."""
    from wirelark.llm import queries

    out = queries.queries()[name](spark, SF)
    rows, texts = out.collect(), {r.doc_id: r.text or "" for r in docs.collect()}
    assert out.columns == COLUMNS[name].split() and sorted(r.doc_id for r in rows) == sorted(texts)
    lib, enc = Tokenizer.from_file(JSON), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(MULTI).ranks, special_tokens={})
    digest = lambda x: hashlib.sha256(x).hexdigest()
    holds = {
        "op1_quality": lambda r, t: tuple(r)[1:6] == brute_stats(t) and r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept),
        "op3_sharding": lambda r, t: (r["size"], r.text_crc32, r.law) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "key") and r.grown_shard in (r.shard, 8),
        "op4_pii": lambda r, t: r.base_sha256 == digest(brute_pii(t).encode()) and set(filter(None, brute_pii(t).split(","))) <= set(r.spans.split(",")),
        "op5_simhash": lambda r, t: len(r.fingerprint) == 16 and r.component_id <= r.doc_id,
        "op6_tokencount": lambda r, t: (r.n_bytes, r.n_tokens) == (len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)),
        "op8_secrets": lambda r, t: r.base_sha256 == digest(brute_secrets(t).encode()) and set(filter(None, brute_secrets(t).split(","))) <= set(r.spans.split(",")),
        "op10_bpe": lambda r, t: (r.ids_sha256, r.decoded_sha256) == (digest(np.array(enc.encode_ordinary(t), "<u4").tobytes()), digest(t.encode())),
    }[name]
    assert all(holds(r, texts[r.doc_id]) for r in rows)
