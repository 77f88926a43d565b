"""Approximate nearest neighbours by balanced posting lists.

Lists are the leaves of a balanced recursive two-means split of a bounded sample, so each stands for
about as many vectors; there are as many lists as a list has vectors, up to a bound. Vectors are scaled and
lifted to a sphere, where the largest inner product is the least distance. Every vector goes to its nearest list,
and, when it lies near the boundary to another - its projection on the line between the two centroids is
close to the middle - to a few more, in directions that differ. Centroids are found through a graph
of near centroids held in memory: a best-first walk to the nearest, then outwards over all centroids
whose distance is within a ratio of the nearest. A query takes the lists within the ratio, however
many, so the ratio alone decides what is pruned. The ratio is calibrated on the index as it is: a bounded
number of the queries themselves, drawn by a hash, ask for their true neighbours among all rows, by brute
force, and the ratio is the least whose probes reach the wanted share of them; where none does, every list is
probed. On vectors without clusters that share needs most lists; on clustered ones few.

A group of lists and its queries are cut into blocks of bounded size which are met pairwise by one task
each, so a common vector costs many small tasks rather than one large one. Inner products are ranked in
double precision; equal vectors get equal scores, as each score is summed in the same order.

Defined results: vectors that are null, empty, zero, of another than the commonest length, or that
hold null or non-finite components take no part, nor do rows without vec_id. Rows that repeat a
vec_id are one candidate (its best score counts) and one query. Fewer candidates than k give them all.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelark.llm.common import materialise

#: Components of a block of vectors, and of its queries. Small lists share a block, so that a query's finds are merged before they leave it.
VECTOR_BLOCK, QUERY_BLOCK = 1 << 20, 1 << 18
#: Components that the driver holds of the sample, and of the centroids that are broadcast.
SAMPLE_BLOCK, CENTROID_BLOCK = 1 << 23, 1 << 22
#: Queries of the calibration, and rows of the rough products made at once.
CALIBRATED, ROWS = 256, 512
#: Rows of the sample that shape no list, an eighth of it at most: lists stay as they were when these calibrated the ratio.
UNUSED = 256
#: Centroids that a walk keeps in view before it may end, walks side by side, and centroids left at once.
WALK, WALKERS, STEPS = 16, 512, 4


@dataclass
class CentroidGraph:
    """Centroids of vectors lifted so that nearest in distance is largest in inner product, linked to near ones; entries: an upper layer; floor: a squared distance below which all count as alike."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    floor: float = 0.0

    def reach(self, nearest: np.ndarray, ratio: float) -> np.ndarray:
        """The largest squared distances within the ratio of the nearest ones."""
        return np.maximum(nearest, self.floor) * ratio * ratio

    def within(self, x: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the centroids within ratio of the nearest distance, and at least ``least`` walked to: (ids, squared distances), nearest first.

        All rows walk side by side. A walk starts at the nearest entries and leaves the nearest centroid of
        its pool next, until none that is left could matter. Rows end with distance inf.
        """
        c, n = self.centroids, len(self.centroids)
        least = min(least, n)
        width = min(n, 4 * least)
        ids, d = np.zeros((len(x), n if width == n else 0), np.int64), np.full((len(x), n if width == n else 0), np.inf)
        todo = np.arange(len(x))
        while todo.size:
            pool, far = self._walk(x[todo], ratio, least, width)
            if width > ids.shape[1]:
                ids, d = (np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=v) for a, v in ((ids, 0), (d, np.inf)))
            ids[todo, :width], d[todo, :width] = pool, far
            # a pool that is full of centroids within the ratio may have lost some
            todo = todo[(far[:, -1] <= self.reach(far[:, 0], ratio)) & (width < n)]
            width = min(n, 4 * width)
        return ids, d

    def _walk(self, x: np.ndarray, ratio: float, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        c, n = self.centroids, len(self.centroids)
        begin = self.entries
        d = (x**2).sum(axis=1)[:, None] + (c[begin] ** 2).sum(axis=1) - 2 * x @ c[begin].T
        first = np.argsort(d, axis=1)[:, : min(8, width)]
        ids = np.zeros((len(x), width), np.int64)
        far, left = np.full((len(x), width), np.inf), np.zeros((len(x), width), bool)
        ids[:, : first.shape[1]] = begin[first]
        far[:, : first.shape[1]] = ((c[ids[:, : first.shape[1]]] - x[:, None]) ** 2).sum(axis=2)
        seen = np.zeros((len(x), n), bool)
        np.put_along_axis(seen, ids[:, : first.shape[1]], True, axis=1)
        rows = np.arange(len(x))
        while rows.size:
            f = far[rows]
            pending = np.where(left[rows], np.inf, f)
            at = np.argpartition(pending, min(STEPS, width) - 1, axis=1)[:, :STEPS]
            e = np.take_along_axis(pending, at, axis=1)
            near = np.partition(f, least - 1, axis=1)[:, least - 1]
            go = np.isfinite(e) & (e <= np.maximum(self.reach(f.min(axis=1), ratio), near)[:, None])
            walks = go.any(axis=1)
            rows, at, go = rows[walks], at[walks], go[walks]
            if not rows.size:
                break
            r = rows[:, None]
            left[r, at] |= go
            from_ = ids[r, at]
            fresh = np.sort(np.where(go[:, :, None], self.links[from_], from_[:, :, None]).reshape(len(rows), -1), axis=1)
            known = seen[r, fresh]
            known[:, 1:] |= fresh[:, 1:] == fresh[:, :-1]
            seen[r, fresh] = True
            e = np.full(fresh.shape, np.inf)
            i, j = np.nonzero(~known)
            e[i, j] = ((c[fresh[i, j]] - x[rows[i]]) ** 2).sum(axis=1)
            both, all_ids = np.hstack([far[rows], e]), np.hstack([ids[rows], fresh])
            done = np.hstack([left[rows], known])
            keep = np.argpartition(both, width - 1, axis=1)[:, :width]
            far[rows], ids[rows], left[rows] = (np.take_along_axis(a, keep, axis=1) for a in (both, all_ids, done))
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)


def balanced_lists(sample: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Means of the leaves of a recursive split into like halves along the line between two means, then moved to the means of what is nearest to them."""
    leaves = [sample]
    while len(leaves) < lists:
        leaves.sort(key=len)
        own = leaves.pop()
        if len(own) < 4:
            leaves.append(own)
            break
        a, b = own[rng.choice(len(own), 2, replace=False)]
        for _ in range(4):
            near = ((own - a) ** 2).sum(axis=1) <= ((own - b) ** 2).sum(axis=1)
            if near.all() or not near.any():
                break
            a, b = own[near].mean(axis=0), own[~near].mean(axis=0)
        order = np.argsort(own @ (b - a), kind="stable")
        half = int(min(max(near.sum(), 0.3 * len(own)), 0.7 * len(own)))
        leaves += [own[order[:half]], own[order[half:]]]
    means = np.array([x.mean(axis=0) for x in leaves])
    for _ in range(3):
        norms = (means**2).sum(axis=1)
        at = np.concatenate([(norms - 2 * sample[i : i + 1024] @ means.T).argmin(axis=1) for i in range(0, len(sample), 1024)])
        order = np.argsort(at, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        means = np.add.reduceat(sample[order], begin) / np.diff(np.r_[begin, len(at)])[:, None]
    return means


def make_graph(centroids: np.ndarray, degree: int = 16) -> CentroidGraph:
    """Each centroid linked to its nearest ones and to a few drawn at random, which keep the graph connected."""
    n = len(centroids)
    rng = np.random.default_rng(5)
    norms = (centroids**2).sum(axis=1)
    near = min(degree, n - 1)
    links = np.zeros((n, near + 4), np.int64)
    for i in range(0, n, 1024):
        d = norms[i : i + 1024, None] + norms[None, :] - 2 * centroids[i : i + 1024] @ centroids.T
        links[i : i + 1024, :near] = np.argsort(d, axis=1)[:, 1 : near + 1]
    links[:, near:] = rng.integers(0, n, (n, 4))
    links[:, -1] = (np.arange(n) + 1) % n
    # a link that repeats another leads to itself, which a walk has seen
    repeats = np.array([[k in row[:i] for i, k in enumerate(row)] for row in links.tolist()])
    links = np.where(repeats, np.arange(n)[:, None], links)
    return CentroidGraph(centroids, links, np.sort(rng.permutation(n)[: 4 * math.isqrt(n)]))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", "embedding").where(ok & finite)


def stacked(embeddings: pd.Series) -> np.ndarray:
    return np.array(embeddings.tolist(), dtype=np.float64)


@dataclass
class Lists:
    """Centroids of lifted vectors, and how vectors and queries find theirs. scale: the largest component; top: of the squared norms."""

    graph: CentroidGraph
    scale: float
    top: float
    copies: int
    margin: float
    ratio: float = 1.0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.hstack([x, np.sqrt(np.maximum(self.top - (x**2).sum(axis=1), 0))[:, None]])

    def aimed(self, q: np.ndarray) -> np.ndarray:
        """Queries on the sphere: a query's length doesn't change its ranking."""
        q = q / np.abs(q).max(axis=1, keepdims=True)
        return np.hstack([q * (math.sqrt(self.top) / np.linalg.norm(q, axis=1, keepdims=True)), np.zeros((len(q), 1))])

    def homes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists of vectors: the nearest, and those whose boundary a vector is close to, in directions that differ."""
        c, out = self.graph.centroids, []
        for i in range(0, len(x), WALKERS):
            ids, d = self.graph.within(self.lifted(x[i : i + WALKERS]), 1.0, WALK)
            ids, d = ids[:, :WALK], d[:, :WALK]
            lines = c[ids] - c[ids[:, :1]]
            size = (lines**2).sum(axis=2)
            # 0 on the boundary between the two lists, 1 at the nearest centroid
            close = (d - d[:, :1] <= self.margin * size) & (size > 0) & np.isfinite(d)
            for own, near, line, norm in zip(ids, close, lines, size):
                taken: list[int] = []
                for k in np.flatnonzero(near):
                    if len(taken) == self.copies - 1:
                        break
                    if all(line[k] @ line[t] <= 0.5 * math.sqrt(norm[k] * norm[t]) for t in taken):
                        taken.append(int(k))
                out.append(own[[0, *taken]].astype(np.int32))
        return out

    def probes(self, q: np.ndarray, held: np.ndarray, k: int) -> list[np.ndarray]:
        """The lists of queries: those within the ratio, and beyond it until they hold k candidates. held: vec_ids by list, each counted once."""
        if self.ratio == math.inf:
            return [np.arange(len(held), dtype=np.int32)] * len(q)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(q)
        todo, least = np.arange(len(q)), WALK
        while todo.size:
            short = []
            for i in range(0, len(todo), WALKERS):
                at = todo[i : i + WALKERS]
                ids, d = self.graph.within(self.aimed(q[at]), self.ratio, least)
                inside = (d <= self.graph.reach(d[:, :1], self.ratio)).sum(axis=1)
                enough = 1 + (np.cumsum(np.where(np.isfinite(d), held[ids], 0), axis=1) < k + 1).sum(axis=1)
                for j, n in enumerate(np.maximum(inside, enough)):
                    found = int(np.isfinite(d[j]).sum())
                    out[at[j]] = ids[j, : min(n, found)].astype(np.int32)
                    if n > found and least < len(held):
                        short.append(at[j])
            todo, least = np.array(short, np.int64), 4 * least
        return out

    def calibrate(self, q: np.ndarray, at: np.ndarray, homes: list[np.ndarray], held: np.ndarray, k: int, recall: float) -> None:
        """Set ratio to about the least at which probes reach the share recall of true neighbours: of query q[at[i]], one in the lists homes[i]."""
        if not len(at):
            return
        aimed, c = self.aimed(q), self.graph.centroids
        d = np.maximum((aimed**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * aimed @ c.T, 0)
        nearest = self.graph.reach(d.min(axis=1), 1.0)
        needed = np.sort([max(1.0, d[i, own].min() / nearest[i]) for i, own in zip(at, homes)])
        low, high = math.ceil(recall * len(needed)) - 1, len(needed)
        place = low
        while low < high:
            # walks may miss lists that these distances count on, so the probes themselves are measured
            self.ratio = math.sqrt(float(needed[place])) * (1 + 1e-9)
            probed = [set(p.tolist()) for p in self.probes(q, held, k)]
            reached = np.mean([not probed[i].isdisjoint(own.tolist()) for i, own in zip(at, homes)]) >= recall
            low, high = (low, place) if reached else (place + 1, high)
            place = (low + high) // 2
        self.ratio = math.sqrt(float(needed[high])) * (1 + 1e-9) if high < len(needed) else math.inf


def fit(vectors: DataFrame, n: int, dim: int, scale: float, top: float, lists: int | None, sample_rows: int, copies: int, margin: float) -> Lists:
    """Lists from at most sample_rows vectors (fewer where they are wide), drawn by a hash of vec_id; equal ones count once."""
    most = max(1024, min(sample_rows, SAMPLE_BLOCK // dim))
    rows = vectors.select("embedding", F.xxhash64("vec_id", F.lit(3)).alias("h")).orderBy("h").limit(most).toPandas()
    x = stacked(rows.embedding)
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    x = x[min(UNUSED, len(x) // 8) :]
    made = Lists(None, scale, top, copies, margin)
    wanted = min(lists or math.isqrt(n), max(1, CENTROID_BLOCK // dim), max(1, len(x) // 4))
    made.graph = make_graph(balanced_lists(made.lifted(x), wanted, np.random.default_rng(2)))
    made.graph.floor = 1e-12 * top
    return made


def first_copies(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Positions of rows, those of equal vectors only for their k + 1 least ids: no others can be among the k nearest."""
    same = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    if same.size == 0 or same.max() + 1 == len(same):
        return np.arange(len(ids))
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    fresh = np.r_[True, (s[1:] != s[:-1]) | (i[1:] != i[:-1])]  # repeats of a row go too
    order, s = order[fresh], s[fresh]
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    place = np.arange(len(s)) - np.repeat(begin, np.diff(np.r_[begin, len(s)]))
    return np.sort(order[place <= k])


def list_pairs(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, vector) positions of one list that may be among the k best vec_ids of a query; ids ascend.

    bound: the k-th best rough product of each query so far, raised here. Near misses of rough products pass.
    """
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    alone = len(first) == len(ids)
    widest = np.sqrt((v**2).sum(axis=1).max())
    for at in range(0, len(q), ROWS):
        part = slice(at, at + ROWS)
        rough = q[part] @ v.T
        rough[asked[part, None] == ids[None, :]] = -np.inf
        each = rough if alone else np.maximum.reduceat(rough, first, axis=1)
        if len(first) >= k:
            bound[part] = np.maximum(bound[part], np.partition(each, len(first) - k, axis=1)[:, len(first) - k])
        slack = 8 * q.shape[1] * np.finfo(float).eps * widest * np.sqrt((q[part] ** 2).sum(axis=1))
        a, b = np.nonzero((rough >= (bound[part] - slack)[:, None]) & (rough > -np.inf))
        yield a + at, b


def scores_of(q: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of q[a] and v[b], each summed in one fixed order."""
    step = max(1, (1 << 22) // q.shape[1])
    return np.concatenate([np.zeros(0), *((v[b[i : i + step]] * q[a[i : i + step]]).cumsum(axis=1)[:, -1] for i in range(0, len(a), step))])


def k_best(x: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best vec_ids of each query x, nearest first, ties by vec_id; the best score of each vec_id counts."""
    if not len(x):
        return np.zeros(0, np.int64)
    order = np.lexsort((-scores, ids, x))
    y, i = x[order], ids[order]
    order = order[np.r_[True, (y[1:] != y[:-1]) | (i[1:] != i[:-1])]]
    order = order[np.lexsort((ids[order], -scores[order], x[order]))]
    y = x[order]
    begin = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    return order[np.arange(len(y)) - np.repeat(begin, np.diff(np.r_[begin, len(y)])) < k]


def meet(f: pd.DataFrame, g: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best vec_ids of a block of vectors (vec_id, embedding, list) for each of its queries (query_id, embedding, lists), ties by vec_id."""
    asked, q = f.query_id.to_numpy(), stacked(f.embedding)
    takers = f.lists.explode()
    takers = pd.Series(np.repeat(np.arange(len(f)), f.lists.map(len))).groupby(takers.to_numpy(np.int64)).apply(np.array).to_dict()
    bound = np.full(len(q), -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for name, own in g.groupby("list"):
        at = takers.get(name)
        if at is None:
            continue
        own = own.sort_values("vec_id", kind="stable")
        ids, v = own.vec_id.to_numpy(), stacked(own.embedding)
        keep = first_copies(ids, v, k)
        ids, v = ids[keep], v[keep]
        limits = bound[at]
        for a, b in list_pairs(asked[at], q[at], ids, v, k, limits):
            found.append((at[a], ids[b], scores_of(q, v, at[a], b)))
        bound[at] = limits
    if not found:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    x, ids, scores = (np.concatenate(c) for c in zip(*found))
    keep = k_best(x, ids, scores, k)
    return pd.DataFrame({"query_id": asked[x[keep]], "vec_id": ids[keep], "score": scores[keep]})


def true_neighbours(asked: np.ndarray, q: np.ndarray, frames: Iterator[pd.DataFrame], k: int) -> pd.DataFrame:
    """at, vec_id, score, lists: the k best vec_ids of frames (vec_id, embedding, lists) for each query, by brute force; at: the query's position."""
    bound = np.full(len(q), -np.inf)
    best = pd.DataFrame({"at": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "lists": np.zeros(0, object)})
    for f in frames:
        if f.empty:
            continue
        f = f.sort_values("vec_id", kind="stable")
        ids, v = f.vec_id.to_numpy(), stacked(f.embedding)
        keep = first_copies(ids, v, k)
        ids, v, lists = ids[keep], v[keep], f.lists.to_numpy()[keep]
        found = [pd.DataFrame({"at": a, "vec_id": ids[b], "score": scores_of(q, v, a, b), "lists": lists[b]}) for a, b in list_pairs(asked, q, ids, v, k, bound)]
        best = pd.concat([best, *found], ignore_index=True)
        best = best.iloc[k_best(best["at"].to_numpy(), best.vec_id.to_numpy(), best.score.to_numpy(), k)]
    return best


def placed_and_probed(embeddings: DataFrame, queries: DataFrame, k: int, lists: int | None, sample_rows: int, copies: int, margin: float, recall: float) -> tuple[DataFrame, DataFrame, int] | None:
    """(vec_id, embedding, lists) of vectors and of queries, and the dimension; None where no vector takes part."""
    rows = valid(embeddings)
    # norms by way of the largest component, which doesn't overflow
    sized = rows.select(F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("x")).withColumn("most", F.array_max("x"))
    norm = F.col("most") * F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most"))))
    sizes = sized.groupBy("dim").agg(F.count("*").alias("n"), F.max("most").alias("scale"), F.max(norm).alias("norm")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return None
    dim, n, scale = sizes[0].dim, sizes[0].n, sizes[0].scale
    top = min((sizes[0].norm / scale) ** 2, float(dim))
    rows = rows.where(F.size("embedding") == dim).distinct()  # copies of a row are one candidate
    asked = valid(queries).where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    made = fit(rows, n, dim, scale, top, lists, sample_rows, copies, margin)

    def to_lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(lists=made.homes(stacked(f.embedding)))

    kind = f"vec_id long, embedding {embeddings.schema['embedding'].dataType.simpleString()}, lists array<int>"
    placed = materialise(rows.mapInPandas(to_lists, kind))
    held = np.zeros(len(made.graph.centroids), np.int64)
    for r in placed.groupBy("vec_id").agg(F.min(F.get("lists", F.lit(0))).alias("list")).groupBy("list").count().collect():
        held[r.list] = r["count"]
    some = asked.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(max(32, min(CALIBRATED, QUERY_BLOCK // dim))).toPandas()
    if len(some):
        ids, q = some.vec_id.to_numpy(np.int64), stacked(some.embedding)

        def to_neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield true_neighbours(ids, q, frames, k)

        near = placed.mapInPandas(to_neighbours, "at long, vec_id long, score double, lists array<int>").groupBy("at", "vec_id").agg(F.max("score").alias("score"), F.max_by("lists", "score").alias("lists"))
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k).select("at", "lists").toPandas()
        made.calibrate(q, near["at"].to_numpy(np.int64), [np.array(x, np.int64) for x in near.lists], held, k, recall)

    def to_probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(lists=made.probes(stacked(f.embedding), held, k))

    return placed, materialise(asked.mapInPandas(to_probes, kind)), dim


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, lists: int | None = None, sample_rows: int = 100_000, copies: int = 3, margin: float = 0.1, recall: float = 0.96) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found among embeddings for each row of queries (vec_id, embedding).

    lists: as many as a list has vectors by default; bounded by CENTROID_BLOCK, as centroids are broadcast.
    At most sample_rows vectors shape the lists; every vector is indexed. copies: lists of a vector
    at most; margin: how close to a boundary it takes more than one, of the way from boundary to
    centroid; recall: wanted of the true neighbours of the calibration's queries.
    """
    spark = embeddings.sparkSession
    made = placed_and_probed(embeddings, queries, k, lists, sample_rows, copies, margin, recall)
    if made is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed, probes, dim = made
    # one row per list: lists in order fill groups of a block of vectors; larger ones are cut
    loads = placed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).join(probes.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("m")), "list").toPandas().sort_values("list")
    loads["grp"] = (loads.n.cumsum() - 1) // max(1, VECTOR_BLOCK // dim)
    per_group = loads.groupby("grp").agg(n=("n", "sum"), m=("m", "sum"))
    loads["nv"] = loads.grp.map(-(-per_group.n // max(1, 2 * VECTOR_BLOCK // dim)))
    loads["nq"] = loads.grp.map(-(-per_group.m.clip(upper=probes.count()) // max(1, QUERY_BLOCK // dim)))
    dims = [F.broadcast(spark.createDataFrame(loads[["list", "grp", "nv", "nq"]].astype("int64"), "list int, grp int, nv int, nq int")) for _ in range(2)]
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    vs = placed.select("vec_id", "embedding", F.explode("lists").alias("list")).join(dims[0], "list").withColumn("bv", F.pmod(F.xxhash64("vec_id", "embedding"), "nv").cast("int")).withColumn("bq", every("nq")).drop("nv", "nq")
    # a query goes to a group once, with its lists there
    taken = probes.select("vec_id", F.explode("lists").alias("list")).join(dims[1], "list").groupBy("vec_id", "grp", "nv", "nq").agg(F.collect_list("list").alias("lists"))
    qs = probes.drop("lists").join(taken, "vec_id").withColumn("bq", F.pmod(F.xxhash64("vec_id"), "nq").cast("int")).withColumn("bv", every("nv")).select(F.col("vec_id").alias("query_id"), "embedding", "lists", "grp", "bv", "bq")
    block = ["grp", "bv", "bq"]
    found = qs.groupBy(block).cogroup(vs.groupBy(block)).applyInPandas(lambda f, g: meet(f, g, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
