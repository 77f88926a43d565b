"""SimHash near-duplicates by a vantage-point tree over fingerprints.

A fingerprint has one or more 64-bit words; a bit is 1 if it is set in more than half of the XXH64 values
(seed 42 for the first word) of the text's word shingles. Distinct fingerprints are dealt to shards by
a vantage-point tree grown on a bounded sample: each node compares the Hamming distance to its pivot
with a threshold, and fingerprints within the link radius below the threshold go to both sides. By the
triangle inequality any two fingerprints that link meet in at least one shard. Where links also need
texts of like length, the length is a second metric that nodes may take (its vantage point is length
zero). Shards that stay large are met block by block. A task splits its own fingerprints by further
pivots in the same way and compares exactly what is left. Shards return spanning forests rather
than pairs, so output stays linear in dense groups, and components are found by alternating star
contraction over those forests. A vertex is a fingerprint's least doc_id and hash, so the root of a
component holds its least doc_id. Documents learn their component by a join on the fingerprint in
which fingerprints of very many copies are broadcast.

Defined results: a null or empty text, or one of separators only, has fingerprint zero, which links
like any other. A text of fewer words than the shingle length is one shingle. Equal texts share a
fingerprint and so a component. component_id ignores null doc_ids; it is null where all are null.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.llm.common import WORD_BYTES, join_spread, materialise, text_batches

BITS = 64
CHUNK = 1 << 16
TILE = 512
#: Fingerprints that the driver holds to shape the tree, at most.
SAMPLE = 1 << 20
#: Stands for a null doc_id among vertices, as the greatest one.
NO_ID = (1 << 63) - 1


def bit_counts(shingles: list[bytes], seed: int) -> np.ndarray:
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(x, seed) for x in shingles]), ">u8").astype("<u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, size: int, seeds: tuple[int, ...] = (42,)) -> tuple[int, ...]:
    """(number of shingles, one word of fingerprint as a signed 64-bit integer for each seed) of a whole text."""
    words = WORD_BYTES.findall((text or "").encode("utf-8", "replace").lower())
    if not words:
        return 0, *(0 for _ in seeds)
    joined = b" ".join(words)
    edges = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts, ends = [0, *(edges[:-1] + 1).tolist()], edges.tolist()
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] or [ends[-1]]
    counts = np.zeros((len(seeds), BITS), np.int64)
    for at in range(0, n, CHUNK):
        shingles = [joined[a:b] for a, b in zip(starts[at : min(n, at + CHUNK)], last[at : at + CHUNK])]
        for i, seed in enumerate(seeds):
            counts[i] += bit_counts(shingles, seed)
    return n, *np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def with_fingerprints(docs: DataFrame, shingle: int, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """docs with n_shingles and a word column fp0, fp1, ... for each seed."""
    names = ["n_shingles", *(f"fp{i}" for i in range(len(seeds)))]

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([fingerprint(t, shingle, seeds) for t in batch], columns=names, dtype="int64")

    made = F.pandas_udf(batches, ", ".join(f"{c} long" for c in names))("text")
    return text_batches(docs).withColumn("_p", made).select(*(docs[c] for c in docs.columns), "_p.*")


@dataclass
class Points:
    """Fingerprints (n x words) and, where links need like lengths, logarithms of the numbers of shingles."""

    fps: np.ndarray
    lengths: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.fps)

    def at(self, k: np.ndarray) -> Points:
        return Points(self.fps[k], None if self.lengths is None else self.lengths[k])

    def distances(self, pivot: np.ndarray | None) -> np.ndarray:
        """Hamming distances to a pivot; distances in length from length zero where there is none."""
        if pivot is None:
            return self.lengths
        return np.bitwise_count(self.fps ^ pivot).sum(axis=1, dtype=np.int64)


@dataclass(frozen=True)
class Link:
    """Fingerprints link at ``bits`` differing bits or fewer and, if ``ratio`` is set, with the shorter at least ratio of the longer."""

    bits: int
    ratio: float = 0.0

    def radius(self, pivot: np.ndarray | None) -> float:
        return self.bits if pivot is not None else self.reach

    @property
    def reach(self) -> float:
        return -np.log(self.ratio) * (1 + 1e-12)


@dataclass
class VantageTree:
    """Internal nodes in lists; children >= 0 are nodes, others leaves ~k. blocks: of each leaf."""

    pivot: list[np.ndarray | None]
    limit: list[float]
    inner: list[int]
    outer: list[int]
    blocks: list[int]

    def routes(self, points: Points, link: Link) -> list[tuple[np.ndarray, int]]:
        """(positions, leaf) for every leaf that some of points belong to."""
        todo, out = [(np.arange(len(points)), 0 if self.pivot else ~0)], []
        while todo:
            at, node = todo.pop()
            if not at.size:
                continue
            if node < 0:
                out.append((at, ~node))
                continue
            d = points.at(at).distances(self.pivot[node])
            todo.append((at[d <= self.limit[node]], self.inner[node]))
            todo.append((at[d > self.limit[node] - link.radius(self.pivot[node])], self.outer[node]))
        return out


def split(points: Points, link: Link, rng: np.random.Generator) -> tuple[np.ndarray | None, float] | None:
    """(pivot, limit) of the candidate split that leaves least to compare, or None where none saves a fifth."""
    best = None
    sample = points if len(points) <= 4096 else points.at(rng.choice(len(points), 4096, replace=False))
    pivots = [*points.fps[rng.choice(len(points), min(4, len(points)), replace=False)], *([None] if points.lengths is not None else [])]
    for pivot in pivots:
        d = np.sort(sample.distances(pivot))
        limits = np.unique(np.quantile(d, np.linspace(0.05, 0.95, 37), method="lower"))
        inside = np.searchsorted(d, limits, side="right") / len(d)
        outside = 1 - np.searchsorted(d, limits - link.radius(pivot), side="right") / len(d)
        left = inside**2 + outside**2  # pairs on the two sides, copies included
        k = int(left.argmin())
        if best is None or left[k] < best[2]:
            best = pivot, float(limits[k]), float(left[k])
    return best[:2] if best and best[2] < 0.8 else None


def grow(sample: Points, leaves: int, link: Link, scale: float = 1.0, block: int = 65_536, seed: int = 7) -> VantageTree:
    """Split the fullest leaf until there are enough. scale: points of the whole for each of the sample."""
    rng = np.random.default_rng(seed)
    tree = VantageTree([], [], [], [], [])
    open_leaves: list[tuple] = [(-len(sample), 0, sample, -1, 0)]  # by size; a number; its sample, parent, side
    done, number = [], itertools.count(1)
    while open_leaves and len(open_leaves) + len(done) < leaves:
        _, _, own, parent, side = heapq.heappop(open_leaves)
        cut = split(own, link, rng) if len(own) >= 16 else None
        if cut is None:
            done.append((own, parent, side))
            continue
        node = len(tree.pivot)
        tree.pivot.append(cut[0]), tree.limit.append(cut[1]), tree.inner.append(0), tree.outer.append(0)
        if parent >= 0:
            (tree.inner, tree.outer)[side][parent] = node
        d = own.distances(cut[0])
        for side, at in enumerate((d <= cut[1], d > cut[1] - link.radius(cut[0]))):
            heapq.heappush(open_leaves, (-int(at.sum()), next(number), own.at(at), node, side))
    for k, (own, parent, side) in enumerate(done + [x[2:] for x in open_leaves]):
        if parent >= 0:
            (tree.inner, tree.outer)[side][parent] = ~k
        tree.blocks.append(max(1, round(len(own) * scale / block)))
    return tree


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least member of each one's component, of points 0 to n - 1 under links a-b and earlier labels."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        if not (x != y).any():
            return label
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def local_components(points: Points, link: Link, sides: np.ndarray | None = None, seed: int = 11) -> np.ndarray:
    """Labels of the components of distinct fingerprints under links; where sides are given, under links between sides."""
    rng = np.random.default_rng(seed)
    label, todo = np.arange(len(points)), [np.arange(len(points))]

    def compare(p: np.ndarray, q: np.ndarray) -> None:
        nonlocal label
        far = np.zeros((len(p), len(q)), np.uint16)
        for w in range(points.fps.shape[1]):
            far += np.bitwise_count(points.fps[p, w][:, None] ^ points.fps[q, w][None, :])
        x, y = np.nonzero(far <= link.bits)
        a, b = p[x], q[y]
        if points.lengths is not None:
            near = np.abs(points.lengths[a] - points.lengths[b]) <= link.reach
            a, b = a[near], b[near]
        label = forest(len(points), a, b, label)

    def tiles(at: np.ndarray) -> list[np.ndarray]:
        return [at[i : i + TILE] for i in range(0, len(at), TILE)]

    while todo:
        at = todo.pop()
        cut = split(points.at(at), link, rng) if len(at) > TILE else None
        if cut is not None:
            d = points.at(at).distances(cut[0])
            todo += [at[d <= cut[1]], at[d > cut[1] - link.radius(cut[0])]]
            continue
        if points.lengths is not None:
            at = at[np.argsort(points.lengths[at], kind="stable")]
        ones, others = (tiles(at), tiles(at)) if sides is None else (tiles(at[~sides[at]]), tiles(at[sides[at]]))
        for i, p in enumerate(ones):
            for q in others[i if sides is None else 0 :]:
                if points.lengths is None or points.lengths[q[0]] - points.lengths[p[-1]] <= link.reach and points.lengths[p[0]] - points.lengths[q[-1]] <= link.reach:
                    compare(p, q)
    return label


def as_points(f: pd.DataFrame, words: list[str], link: Link) -> Points:
    fps = np.ascontiguousarray(f[words].to_numpy("int64")).view(np.uint64)
    return Points(fps, np.log(np.maximum(f.n_shingles.to_numpy("int64"), 1)) if link.ratio else None)


def shard_links(distinct: DataFrame, words: list[str], link: Link, per_shard: int, max_shards: int) -> DataFrame:
    """Links (u, v), v < u, of vertices that span the components of distinct (least, node, n_shingles, words); a vertex is (least, node)."""
    spark = distinct.sparkSession
    n = distinct.count()
    leaves = min(max_shards, max(1, n // per_shard))
    sample = min(SAMPLE, max(SAMPLE // 16, 64 * leaves))
    share = min(1.0, 1.2 * sample / max(n, 1))
    rows = distinct.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample).toPandas().sort_values("node")
    tree = grow(as_points(rows, words, link), leaves, link, n / max(len(rows), 1))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            points, nodes = as_points(f, words, link), f.node.to_numpy("int64")
            for at, leaf in tree.routes(points, link):
                blocks = tree.blocks[leaf]
                own = (nodes[at].view(np.uint64) % np.uint64(blocks)).astype(np.int64)
                for other in range(blocks):
                    yield f.iloc[at].assign(shard=leaf, low=np.minimum(own, other), high=np.maximum(own, other), side=own > other)

    def link_up(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["least", "node"])
        least, node = f.least.to_numpy("int64"), f.node.to_numpy("int64")
        label = local_components(as_points(f, words, link), link, None if f.low.iat[0] == f.high.iat[0] else f.side.to_numpy(bool))
        far = np.flatnonzero(label != np.arange(len(label)))
        to = label[far]
        return pd.DataFrame({"ul": least[far], "un": node[far], "vl": least[to], "vn": node[to]})

    own = ", ".join(f"{c} long" for c in ("least", "node", "n_shingles", *words))
    parts = max(sum(b * (b + 1) // 2 for b in tree.blocks), spark.sparkContext.defaultParallelism)
    key = ["shard", "low", "high"]
    routed = distinct.select("least", "node", "n_shingles", *words).mapInPandas(route, own + ", shard int, low int, high int, side boolean")
    found = routed.repartition(min(parts, 4 * max_shards), *key).groupBy(key).applyInPandas(link_up, "ul long, un long, vl long, vn long")
    return found.select(vertex("ul", "un").alias("u"), vertex("vl", "vn").alias("v"))


def vertex(least: str, node: str) -> Column:
    return F.struct(F.col(least).alias("least"), F.col(node).alias("node"))


def components(links: DataFrame) -> DataFrame:
    """node, root (the least reachable node) for every node of links (u, v), by star contraction.

    Large-star steps hang each node's larger neighbours on its least one, small-star steps its
    smaller ones; both keep components, and about log(n) rounds leave one star per component. A star's
    centre with many rays is no task's work: minima are partial aggregates, and the rays of centres that
    hold much of the whole learn them by broadcast.
    """
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    state = [F.count("*").alias("rows"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")]
    now = edges.agg(*state).first()
    while now.rows:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_spread(both, low, ["u"], 2 * now.rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # u has only smaller neighbours now: they hang on the least of them, and so does u
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_spread(large, low, ["u"], now.rows)
        hung = small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v")).where("u != v").distinct()
        edges, before = materialise(hung), now
        now = edges.agg(*state).first()
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def fingerprint_components(prints: DataFrame, words: list[str], link: Link, per_shard: int = 16_384, max_shards: int = 65_536) -> DataFrame:
    """The words, n (their rows), root (of the component) and component_id of every distinct fingerprint of prints (doc_id, n_shingles, words)."""
    node = F.col(words[0]) if len(words) == 1 else F.xxhash64(*words)
    first = F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("least")
    distinct = materialise(prints.groupBy(*words).agg(first, F.min("n_shingles").alias("n_shingles"), F.count("*").alias("n")).withColumn("node", node))
    roots = materialise(components(shard_links(distinct, words, link, per_shard, max_shards)))
    own = distinct.select(*words, "n", vertex("least", "node").alias("own"))
    named = own.join(roots.withColumnRenamed("node", "own"), "own", "left").select(*words, "n", F.coalesce("root", "own").alias("root"))
    return named.withColumn("component_id", F.nullif("root.least", F.lit(NO_ID)))


def near_duplicates(docs: DataFrame, shingle: int = 3, link: Link = Link(2), seeds: tuple[int, ...] = (42,), **how) -> DataFrame:
    """One row per document: doc_id, its fingerprint's words fp0, ... (signed), component_id (the least doc_id of its component)."""
    words = [f"fp{i}" for i in range(len(seeds))]
    prints = materialise(with_fingerprints(docs.select("doc_id", "text"), shingle, seeds).drop("text"))
    found = materialise(fingerprint_components(prints, words, link, **how))
    return join_spread(prints, found, words, prints.count()).select("doc_id", *words, "component_id")


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seeds: tuple[int, ...] = (42, 1, 2, 3), **how) -> DataFrame:
    """docs with one document of each component kept: that of least doc_id.

    Links need an estimated Jaccard similarity of shingles of at least ``similarity``: the share of
    differing bits is the angle between texts over pi, which similarity bounds, and the numbers of
    shingles must be within the same ratio. Rows that share a kept doc_id and component stay as one.
    Documents without doc_id stay.
    """
    bits = int(BITS * len(seeds) * np.arccos(2 * similarity / (1 + similarity)) / np.pi + 0.5)
    words = [f"fp{i}" for i in range(len(seeds))]
    own = docs.select("doc_id", "text").withColumns({"h1": F.xxhash64(F.lit(1), "text"), "h2": F.xxhash64(F.lit(2), "text")})  # a row is known by its doc_id and text
    prints = materialise(with_fingerprints(own, shingle, seeds).drop("text"))
    parts = materialise(fingerprint_components(prints, words, Link(bits, similarity), **how))
    rows = prints.count()
    found = materialise(join_spread(prints, parts, words, rows).select("doc_id", "h1", "h2", "root", "component_id"))
    far = F.col("doc_id") != F.col("component_id")
    ids = found.groupBy("doc_id").agg(F.every(far).alias("all"), F.some(far).alias("any"), F.count("*").alias("n"))
    # written first, so that their sizes are known: texts are shuffled only where they are too large to broadcast
    dropped = materialise(ids.where("all").select("doc_id"))
    in_part = materialise(join_spread(found.where(far), ids.where("any and not all").select("doc_id", "n"), ["doc_id"], rows).select("doc_id", "h1", "h2").distinct())
    kept_ids = found.where("doc_id = component_id").select("doc_id", "h1", "h2", "root")
    repeated = materialise(join_spread(kept_ids, kept_ids.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), ["root"], rows).select("doc_id", "h1", "h2", "root").distinct())
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_id"), *(F.xxhash64(F.lit(i), "text").alias(f"_h{i}") for i in (1, 2)))  # other columns may have any names
    same = lambda df: (F.col("_id") == df["doc_id"]) & (F.col("_h1") == df["h1"]) & (F.col("_h2") == df["h2"])
    kept = rows.join(dropped, F.col("_id") == dropped["doc_id"], "left_anti")
    if not in_part.isEmpty():
        kept = kept.join(in_part, same(in_part), "left_anti")
    if repeated.isEmpty():
        return kept.select("_doc.*")
    # the rows that share a kept doc_id and component, few as they are, go through a grouping of their own
    one = kept.join(repeated, same(repeated)).groupBy("root").agg(F.min_by("_doc", F.struct("_h1", "_h2")).alias("_doc"))
    return kept.join(repeated, same(repeated), "left_anti").select("_doc.*").unionByName(one.select("_doc.*"))
