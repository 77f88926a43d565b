"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Pieces differ only by length, so the instance is a table of counts per length (at most ``capacity``
numbers, whatever the corpus). The plan is made on that table: for the longest piece, feasible sets
that dominate every other feasible set holding it are fixed for good - alone when nothing fits beside
it, with its best partner when that fills the sequence or when only one more piece fits, with its best
partner or pair when at most two fit and the classic dominance tests hold - and the rest is packed by
best-fit decreasing, many equal sequences at a time. Pieces of a length are then numbered without
gaps, and the plan says where the r-th piece of a length goes. Pieces of full length are sequences as they are.

Defined results: a null or empty text is one piece of one token (the end token). Repeated rows and
equal doc_ids are pieces of their own. No documents give no pieces.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wirelark.llm.common import materialise, text_batches
from wirelark.llm.tokencount import byte_symbols

#: A length is numbered in parts of SMALL_PART pieces, in up to PARTS of them, and in more parts only of LARGE_PART
#: pieces: a common length is no single task's work, and few sizes of parts come to the driver.
SMALL_PART, PARTS, LARGE_PART = 4096, 64, 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class JsonTokenizer:
    """Ids as the tokenizers library gives them for a byte-level BPE file, without added begin or end tokens.

    Where the file's ids follow its merges, as in this family of vocabularies, they are the ranks that
    tiktoken takes, which cuts and merges several times faster; tests hold both to the same ids. Other
    files go to the tokenizers library itself. Strings of special tokens become their ids in both.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocab = {t: i for t, i in data["model"]["vocab"].items() if t not in added}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        merged = [vocab[a + b] for a, b in pairs]
        self.specials = set(added)
        if merged == sorted(merged) and len(vocab) == len(merged) + 256 and merged[0] > max(vocab[c] for c in byte_of):
            ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items()}
            self.fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        else:
            self.fast, self.lib = None, Tokenizer.from_file(path)
            self.lib.no_padding(), self.lib.no_truncation()

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text as little-endian 32-bit integers."""
        if self.fast:
            return self.fast.encode_to_numpy(text, allowed_special=self.specials, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(2)
def tokenizer(path: str, pattern: str) -> JsonTokenizer:
    return JsonTokenizer(path, pattern)


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece of each document: PIECES. Only longer documents are cut; the first piece is the short one."""

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        end = np.array([end_id], "<u4")
        for t in tables:
            rows, of = [], []
            for i, text in enumerate(t.column("text").to_pylist()):
                ids = np.append(tok.ids(text or ""), end)
                n = len(ids)
                first = n % capacity or capacity
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity) if k else 0
                    rows.append((k, start, stop - start, zlib.crc32(ids[start:stop])))
                    of.append(i)
            made = np.array(rows, np.int64).reshape(-1, 4).T
            # ids stay in their column: nulls beside large numbers would turn into floats elsewhere
            columns = [t.column("doc_id").take(pa.array(of, pa.int64())), pa.array(made[0], pa.int32()), *map(pa.array, made[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, PIECES)


class Plan:
    """Sequences as (contents: lengths in place order, how many alike)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sequences: list[tuple[tuple[int, ...], int]] = []

    def fix(self, counts: np.ndarray, contents: tuple[int, ...]) -> None:
        """As many sequences of these contents as the counts allow."""
        need: dict[int, int] = defaultdict(int)
        for s in contents:
            need[s] += 1
        m = min(int(counts[s]) // k for s, k in need.items())
        for s, k in need.items():
            counts[s] -= m * k
        self.sequences.append((contents, m))

    def placements(self) -> dict[str, np.ndarray]:
        """For the ranks of each length: arrays length, rank (from), sequence (of that rank), offset; sorted."""
        used: dict[int, int] = defaultdict(int)
        rows, base = [], 0
        for contents, m in self.sequences:
            offset = 0
            for s in contents:
                rows.append((s, used[s], base, offset))
                used[s] += m
                offset += s
            base += m
        made = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return dict(zip(("length", "rank", "sequence", "offset"), made.T))


def best_pair(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, int, int] | None:
    """(x, y, most): x >= y of greatest sum within room, and the greatest lesser member of any feasible pair."""
    best, most, j = None, 0, len(sizes) - 1
    for i, y in enumerate(sizes):
        while j >= i and sizes[j] + y > room:
            j -= 1
        if j < i:
            break
        if j == i and counts[y] < 2:
            continue
        x = int(sizes[j])
        most = max(most, int(y))
        if best is None or x + y > sum(best):
            best = x, int(y)
    return (*best, most) if best else None


def reduce_instance(counts: np.ndarray, plan: Plan) -> None:
    """Fix dominating sets of one to three pieces, from the longest length down; lengths without one are left."""
    c = plan.capacity
    for j in range(c, 0, -1):
        while counts[j]:
            counts[j] -= 1  # one piece of length j looks for company
            sizes = np.flatnonzero(counts)
            smallest = np.repeat(sizes[:3], np.minimum(counts[sizes[:3]], 3))[:3]
            fits = int((j + np.cumsum(smallest) <= c).sum())
            a = int(sizes[np.searchsorted(sizes, c - j, side="right") - 1]) if fits else 0
            chosen: tuple[int, ...] | None = None
            if fits == 0:
                chosen = (j,)
            elif j + a == c or fits == 1:
                chosen = (j, a)
            elif fits == 2:
                pair = best_pair(sizes[sizes <= c - j], counts, c - j)
                if pair is None or a >= pair[0] + pair[1]:
                    chosen = (j, a)
                elif pair[0] == a and pair[1] >= pair[2]:
                    chosen = (j, pair[0], pair[1])
            counts[j] += 1
            if chosen is None:
                break
            plan.fix(counts, chosen)


def best_fit(counts: np.ndarray, plan: Plan) -> None:
    """Best-fit decreasing over counts: groups of alike open sequences are filled together."""
    c = plan.capacity
    open_groups: dict[int, list[list]] = defaultdict(list)  # room left -> [contents, how many]
    rooms: list[int] = []

    def put(contents: tuple[int, ...], m: int, room: int) -> None:
        if not m:
            return
        if room == 0:
            plan.sequences.append((contents, m))
            return
        if not open_groups[room]:
            bisect.insort(rooms, room)
        open_groups[room].append([contents, m])

    for s in range(c, 0, -1):
        n = int(counts[s])
        while n:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                contents, m = open_groups[room].pop()
                if not open_groups[room]:
                    rooms.pop(at)
            else:
                room, contents, m = c, (), -(-n // (c // s))
            q = room // s  # best fit fills one sequence as far as it goes
            full = min(m, n // q)
            put(contents + (s,) * q, full, room - q * s)
            n, m = n - full * q, m - full
            if m and n:
                put(contents + (s,) * n, 1, room - n * s)
                n, m = 0, m - 1
            if contents:
                put(contents, m, room)
    for room in rooms:
        plan.sequences += [(contents, m) for contents, m in open_groups[room]]


def make_plan(counts: np.ndarray, capacity: int) -> Plan:
    """counts[s]: pieces of length s, 0 to capacity."""
    plan, rest = Plan(capacity), counts.astype(np.int64).copy()
    reduce_instance(rest, plan)
    best_fit(rest, plan)
    return plan


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: PIECES, sequence_id, offset."""
    # the row number is stored, so pieces with equal ids and contents are told apart alike by every task
    made = materialise(pieces(docs, path, pattern, capacity, end_id).withColumn("_row", F.monotonically_increasing_id()))
    spark, names = made.sparkSession, [f.split()[0] for f in PIECES.split(", ")]
    # a piece of full length is a sequence, whose number needs no count
    whole = made.where(F.col("length") == capacity).select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.where(F.col("length") < capacity)
    lengths = rest.groupBy("length").count().toPandas().astype("int64")  # fewer than capacity rows
    if not len(lengths):
        return whole
    counts = np.zeros(capacity + 1, np.int64)
    counts[lengths.length] = lengths["count"]
    table = make_plan(counts, capacity).placements()
    # each length is numbered in parts of bounded size, whose sizes are counted in turn
    lengths["parts"] = np.maximum(np.minimum(PARTS, 1 + lengths["count"] // SMALL_PART), 1 + lengths["count"] // LARGE_PART)
    parts = F.broadcast(spark.createDataFrame(lengths[["length", "parts"]], "length long, parts long"))
    rest = rest.join(parts, "length").withColumn("part", F.pmod(F.xxhash64("_row"), F.col("parts"))).drop("parts")
    sizes = rest.groupBy("length", "part").count().toPandas().astype("int64").sort_values(["length", "part"])
    sizes["first"] = sizes.groupby("length")["count"].cumsum() - sizes["count"]
    first = F.broadcast(spark.createDataFrame(sizes[["length", "part", "first"]], "length long, part long, first long"))
    shift = 40
    keys = (table["length"] << shift) | table["rank"]

    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (lengths.to_numpy(np.int64) << shift) | ranks.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": table["sequence"][at] + ranks.to_numpy(np.int64) - table["rank"][at], "offset": table["offset"][at]})

    place.__annotations__ = {"lengths": pd.Series, "ranks": pd.Series, "return": pd.DataFrame}
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "_row")
    ranked = rest.withColumn("own", F.row_number().over(order) - 1).join(first, ["length", "part"])
    placed = ranked.withColumn("x", F.pandas_udf(place, "sequence_id long, offset long")("length", F.col("first") + F.col("own")))
    return placed.select(*names, "x.*").unionByName(whole)
