"""IPv4 fragmentation and reassembly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.functions import checksum as ck
from wirelark.functions.bytesx import bits, put, take, uint


def fragments(df: DataFrame, mtu: int, packet: str = "packet") -> DataFrame:
    """One row per fragment of each IPv4 packet (bytes from the IP header on): number, offset, more, fragment.

    Packets that fit stay whole; with DF set and too long they give no rows and keep an error in ``error``.
    Options are copied to later fragments where their copy bit is set; single-byte options end the copying.
    """
    b = F.col(packet)
    head = 4 * uint(b, 0).bitwiseAND(15)
    whole = F.length(b) <= mtu
    df_set = bits(uint(b, 6), 6, 1) == 1
    step = F.floor((F.lit(mtu) - head) / 8) * 8
    x = df.withColumns({"_head": head.cast("int"), "_whole": whole, "error": F.when(df_set & ~whole, "DF is set"), "_step": F.when(whole, F.length(b)).otherwise(step).cast("int")})
    size = F.length(b) - F.col("_head")
    last = F.when(F.col("error").isNotNull(), F.lit(-1)).when(F.col("_whole"), 0).otherwise(F.floor((size - 1) / F.col("_step")))
    x = x.withColumn("number", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last.cast("int")))))
    start = F.col("number") * F.col("_step")
    data = take(b, F.col("_head") + start, F.col("_step"))
    more = (F.col("_head") + start + F.col("_step") < F.length(b)) & ~F.col("_whole") | (uint(b, 6).bitwiseAND(0x20) != 0)
    before = F.concat(take(b, 0, 2), put(F.col("_head") + F.length(data), 2), take(b, 4, 2), put(uint(b, 6, 2).bitwiseAND(0xC000) + F.when(more, 0x2000).otherwise(0) + uint(b, 6, 2).bitwiseAND(0x1FFF) + F.floor(start / 8), 2), take(b, 8, 2))
    after = take(b, 12, F.col("_head") - 12)
    made = F.concat(before, put(ck.internet_checksum(F.concat(before, put(0, 2), after)), 2), after, data)
    out = F.when(F.col("_whole"), b).otherwise(made)
    return x.select(*df.columns, "error", "number", start.alias("offset"), more.alias("more"), F.when(F.col("error").isNull(), out).alias("fragment"))


def fragment_fields(b: Column) -> dict[str, Column]:
    head = 4 * uint(b, 0).bitwiseAND(15)
    return {"src": take(b, 12, 4), "dst": take(b, 16, 4), "ident": uint(b, 4, 2), "proto": uint(b, 9), "start": 8 * uint(b, 6, 2).bitwiseAND(0x1FFF), "more": uint(b, 6).bitwiseAND(0x20) != 0, "size": uint(b, 2, 2) - head}


def is_fragment(b: Column) -> Column:
    return (uint(b, 6, 2).bitwiseAND(0x3FFF)) != 0


def is_first(b: Column) -> Column:
    return (uint(b, 6, 2).bitwiseAND(0x1FFF) == 0) & (uint(b, 6).bitwiseAND(0x20) != 0)


def is_last(b: Column) -> Column:
    return (uint(b, 6, 2).bitwiseAND(0x1FFF) != 0) & (uint(b, 6).bitwiseAND(0x20) == 0)


def gaps(df: DataFrame, key: list[str]) -> DataFrame:
    """Fragments (key, start, size) that don't begin where the one before ends, found by lag over the sorted fragments."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy("start")
    due = F.coalesce(F.lag(F.col("start") + F.col("size")).over(w), F.lit(0))
    return df.withColumn("due", due).where(F.col("start") != F.col("due"))


def reassemble(df: DataFrame, fragment: str = "fragment") -> DataFrame:
    """src, dst, ident, proto, complete, packet of each fragment group.

    Complete means that the sorted fragments run from 0 to the end of the one without MF without gap or
    overlap. The header is that of the first, with length, flags and checksum mended. A group holds at
    most 65535 bytes of a packet; repeated fragments make it incomplete.
    """
    f = df.select(F.struct(*(c.alias(k) for k, c in fragment_fields(F.col(fragment)).items())).alias("k"), F.col(fragment).alias("f")).select("k.*", "f")
    key = ["src", "dst", "ident", "proto"]

    def build(g: pd.DataFrame) -> pd.DataFrame:
        from wirelark.functions.checksum import word_sums

        g = g.sort_values("start", kind="stable")
        due, complete = 0, not g.more.iat[-1]
        for start, size in zip(g.start, g["size"]):
            complete &= start == due
            due = start + size
        packet = None
        if complete:
            first = g.f.iat[0]
            head = bytearray(first[: 4 * (first[0] & 15)])
            body = b"".join(x[4 * (x[0] & 15) :][:n] for x, n in zip(g.f, g["size"]))
            head[2:4] = (len(head) + len(body)).to_bytes(2, "big")
            head[6:8] = ((int.from_bytes(head[6:8], "big")) & 0xC000).to_bytes(2, "big")
            head[10:12] = b"\0\0"
            import numpy as np

            total = int(word_sums(np.frombuffer(bytes(head), np.uint8), np.array([0]), np.array([len(head)]))[0])
            while total >> 16:
                total = (total & 0xFFFF) + (total >> 16)
            head[10:12] = (0xFFFF - total).to_bytes(2, "big")
            packet = bytes(head) + body
        return pd.DataFrame([(*(g[c].iat[0] for c in key), bool(complete), packet)], columns=[*key, "complete", "packet"])

    return f.groupBy(*key).applyInPandas(build, "src binary, dst binary, ident long, proto long, complete boolean, packet binary")
