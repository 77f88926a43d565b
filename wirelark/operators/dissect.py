"""Dissection: frames to layers and typed header structs.

One Arrow pass finds where the layers lie; header structs are Column expressions over those places, and
columns that a query doesn't use are pruned. A frame that breaks off keeps the layers before the break
and says so in parse_error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.functions.bytesx import lit, put, take
from wirelark.operators import protocols
from wirelark.operators.layout import ERRORS, KINDS, layout

LAYER = "array<struct<kind:string,start:int,end:int>>"
#: Protocol structs that dissect can add, by column name.
PROTOCOLS = protocols.PROTOCOLS


def layer(kind: Column | str, start: Column | int, end: Column | int) -> Column:
    return F.struct(lit(kind).alias("kind") if isinstance(kind, Column) else F.lit(kind).alias("kind"), lit(start).cast("int").alias("start"), lit(end).cast("int").alias("end"))


def layers_of(*parts: Column) -> Column:
    """The layers that aren't NULL."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def dissect(df: DataFrame, with_protocols: tuple[str, ...] | list[str] = (), frame: str = "frame", root: str = "ethernet", extended: bool = False) -> DataFrame:
    """df with layers, parse_error, the link, network and transport structs, payload_start, and the structs of with_protocols.

    root: ethernet, ipv4, ipv6, or one of the radio roots (dot11, radiotap, dot15d4, zwave), whose frames
    become a single layer. extended: read 802.1Q tags, which are payload otherwise.
    """
    keep = df.columns
    b = F.col(frame)
    if root in ("dot11", "radiotap", "dot15d4", "zwave"):
        kind = {"dot11": "Dot11", "radiotap": "RadioTap", "dot15d4": "Dot15d4", "zwave": "ZWave"}[root]
        out = df.withColumn("layers", F.when(F.length(b) > 0, F.array(layer(kind, 0, F.length(b)))).otherwise(F.array().cast(LAYER))).withColumn("parse_error", F.lit(None).cast("string"))
        return out.withColumns({p: PROTOCOLS[p][1](b, F) for p in with_protocols if p in PROTOCOLS})
    s = df.withColumn("_l", layout(b, root, extended))
    at = lambda f: F.when(F.col(f"_l.{f}") >= 0, F.col(f"_l.{f}").cast("int"))
    name = lambda f: F.when(F.col(f"_l.{f}") > 0, F.get(F.array(*map(F.lit, KINDS)), F.col(f"_l.{f}").cast("int")))
    s = s.withColumns({
        "parse_error": F.when(F.col("_l.error") > 0, F.get(F.array(*map(F.lit, ERRORS)), F.col("_l.error").cast("int"))),
        "l3_start": at("l3"), "l4_start": F.when(F.col("_l.error") == 0, at("l4")), "payload_start": at("l5"), "vlan_id": at("vlan"), "app": name("app"),
        "_n": F.length(b), "_net": name("net"), "_tp": name("tp"), "_l4": at("l4"), "_end": at("app_end"), "_cotp": at("cotp_end"), "_box": at("box"), "_s7": name("s7"), "_in": at("inner"), "_itp": name("inner_tp"), "_iend": at("inner_end"),
    })
    n, l3, l4, l5, tp, net, app = (F.col(c) for c in ("_n", "l3_start", "_l4", "payload_start", "_tp", "_net", "app"))
    cend, box, end, ok = F.col("_cotp"), F.col("_box"), F.col("_end"), F.col("parse_error").isNull()
    nothing = F.lit(None).cast("struct<kind:string,start:int,end:int>")
    both = F.col("_itp").isin("TCP", "UDP") & (F.col("_iend") < n)
    s = s.withColumn(
        "layers",
        layers_of(
            F.when(n >= 14, layer("Ethernet", 0, 14)) if root == "ethernet" else nothing,
            F.when(l3 > 14, layer("Dot1Q", 14, l3)) if extended else nothing,
            F.when(net == "Raw", layer("Raw", l3, n)).when(l4.isNotNull(), layer(net, l3, l4)),
            F.when(ok & tp.isNotNull(), layer(tp, l4, F.coalesce(l5, n))),
            F.when(F.col("_in").isNotNull(), layer("IPv4", l4 + 8, F.col("_in"))),
            F.when(F.col("_itp").isNotNull(), layer(F.col("_itp"), F.col("_in"), F.col("_iend"))),
            F.when(both, layer("Raw", F.col("_iend"), n)),
            F.when(app.isNotNull(), layer(app, l5, end)),
            F.when(cend.isNotNull(), layer("COTP", l5 + 4, cend)),
            F.when(F.col("_s7").isNotNull(), layer(F.col("_s7"), cend, box)),
            F.when(app.isin("SSH", "TLS") & (end < n), layer("Raw", end, n)),
        ),
    )
    whole = l4.isNotNull()
    made = {"ether": F.when(n >= 14, protocols.ether(take(b, 0, 14)))} if root == "ethernet" else {}
    made |= {
        "arp": F.when(whole & (net == "ARP"), protocols.arp(take(b, l3, n))),
        "ipv4": F.when(whole & (net == "IPv4"), protocols.ipv4(take(b, l3, n))),
        "ipv6": F.when(whole & (net == "IPv6"), protocols.ipv6(take(b, l3, 40))),
        "tcp": F.when(ok & (tp == "TCP"), protocols.tcp(take(b, l4, n))),
        "udp": F.when(ok & (tp == "UDP"), protocols.udp(take(b, l4, 8))),
        "icmp": F.when(ok & (tp == "ICMP"), protocols.icmp(take(b, l4, n))),
        "icmpv6": F.when(ok & (tp == "ICMPv6"), protocols.icmpv6(take(b, l4, n))),
    }
    chosen = {}
    for c in with_protocols:
        kind, built = PROTOCOLS[c]
        if kind in ("COTP", "S7Comm"):
            start, stop, here = (l5 + 4, cend, cend.isNotNull()) if kind == "COTP" else (cend, box, F.col("_s7") == "S7Comm")
            chosen[c] = F.when(here, built(take(b, start, stop - start), F))
        elif kind == "Raw":
            chosen[c] = F.when(has_layer("Raw"), F.struct(layer_bytes("Raw", frame).alias("load")))
        else:
            chosen[c] = F.when(app == kind, built(take(b, l5, end - l5), F))
    s = s.withColumns(made | chosen)
    core = ("layers", "parse_error", "app", "vlan_id", "l3_start", "l4_start", "payload_start")
    out = [c for c in keep if c not in made and c not in chosen and c not in core and c != "layout"]
    return s.select(*out, *core, F.col("_l").alias("layout"), *made, *chosen)


def has_layer(kind: str) -> Column:
    return F.exists("layers", lambda x: x["kind"] == kind)


def layer_bytes(kind: str, frame: str = "frame") -> Column:
    """Bytes of the first layer of a kind."""
    first = F.try_element_at(F.filter("layers", lambda x: x["kind"] == kind), F.lit(1))
    return take(F.col(frame), first["start"], first["end"] - first["start"])


def payload(kind: str, frame: str = "frame") -> Column:
    """Bytes after the first layer of a kind."""
    first = F.try_element_at(F.filter("layers", lambda x: x["kind"] == kind), F.lit(1))
    return take(F.col(frame), first["end"], F.length(frame))


def split_padding(frame: str = "frame") -> Column:
    """STRUCT<packet, padding>: what the IPv4 or ARP lengths cover of a frame, and the trailing pad bytes."""
    n = F.length(frame)
    end = F.coalesce(F.col("l3_start") + F.col("ipv4.len").cast("int"), F.when(F.col("arp").isNotNull(), F.col("l3_start") + 28), n)
    end = F.least(F.greatest(end, F.lit(14)), n)
    return F.struct(take(F.col(frame), 0, end).alias("packet"), take(F.col(frame), end, n - end).alias("padding"))


def layer_names() -> Column:
    return F.transform("layers", lambda x: x["kind"])


def field(name: str, df: DataFrame) -> Column:
    """Unqualified field: that of the first layer, in stack order, that has the name."""
    order = [c for c in ("ether", "arp", "ipv4", "ipv6", "tcp", "udp", "icmp", "icmpv6", *PROTOCOLS) if c in df.columns]
    having = [F.col(f"{c}.{name}").cast("string") for c in order if name in df.schema[c].dataType.fieldNames()]
    if not having:
        raise ValueError(f"no layer has a field {name}")
    return F.coalesce(*having)


def field_names(df: DataFrame) -> list[str]:
    """Ordered distinct union of the field names of all layers."""
    seen: dict[str, None] = {}
    for c in ("ether", "arp", "ipv4", "ipv6", "tcp", "udp", "icmp", "icmpv6", *PROTOCOLS):
        if c in df.columns:
            seen |= dict.fromkeys(df.schema[c].dataType.fieldNames())
    return list(seen)


def write_field(frame: Column, start: Column, off: int, size: int, value: Column) -> Column:
    """frame with an integer field of a layer overwritten; lengths and checksums stay as they are."""
    at = start + off
    return F.when(start.isNotNull() & (F.length(frame) >= at + size), F.concat(take(frame, 0, at), put(value, size), take(frame, at + size, F.length(frame)))).otherwise(frame)


def summary() -> Column:
    """Layer names but the last joined by " / ", then a summary of the last."""
    last = F.try_element_at(layer_names(), F.lit(-1))
    ends = F.when(last == "TCP", F.format_string("TCP %d > %d %s", F.col("tcp.sport"), F.col("tcp.dport"), protocols.flags_text(F.col("tcp.flags"))))
    ends = ends.when(last == "UDP", F.format_string("UDP %d > %d", F.col("udp.sport"), F.col("udp.dport")))
    ends = ends.when(last == "ARP", F.format_string("ARP op %d %s > %s", F.col("arp.op"), F.col("arp.psrc"), F.col("arp.pdst")))
    ends = ends.when(last == "IPv4", F.format_string("IPv4 %s > %s", F.col("ipv4.src"), F.col("ipv4.dst"))).when(last == "IPv6", F.format_string("IPv6 %s > %s", F.col("ipv6.src"), F.col("ipv6.dst")))
    ends = ends.when(last == "ICMP", F.format_string("ICMP type %d code %d", F.col("icmp.type"), F.col("icmp.code"))).otherwise(last)
    return F.when(F.size("layers") == 0, "").otherwise(F.concat_ws(" / ", F.slice(layer_names(), 1, F.greatest(F.size("layers") - 1, F.lit(0))), ends))


def show(df: DataFrame) -> Column:
    """All layer structs that are present, as JSON."""
    cols = [c for c in ("ether", "arp", "ipv4", "ipv6", "tcp", "udp", "icmp", "icmpv6", *PROTOCOLS) if c in df.columns]
    return F.to_json(F.struct(*cols))


def parse_batch(df: DataFrame, frame: str = "frame") -> DataFrame:
    """All frames dissected; those that fail keep what was found."""
    return dissect(df, frame=frame)


def parse_ok(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Only the frames without a parse error."""
    return dissect(df, frame=frame).where("parse_error is null")

