"""Request-reply matching: an equi-join on a symmetric key, then what remains of "answers" as a filter.

Inputs are packets with the columns a protocol needs; ``pair`` keeps, for each request, the earliest
later reply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ICMP request types and their replies.
ICMP_REPLIES = {8: 0, 13: 14, 15: 16, 17: 18}


def req(c: str) -> Column:
    return F.col(f"req.{c}")


def rep(c: str) -> Column:
    return F.col(f"rep.{c}")


def swapped() -> list[Column]:
    """Addresses and protocol of a reply are those of its request, the other way round."""
    return [req("src") == rep("dst"), req("dst") == rep("src")]


def tcp_answers() -> Column:
    """Whether rep answers req (columns flags, seq, ack, sport, dport, payload_len); differences don't wrap."""
    bit = lambda c, n: c.bitwiseAND(n) != 0
    f, g = rep("flags"), req("flags")
    syn, ack, rst = bit(f, 2), bit(f, 16), bit(f, 4)
    ok = ~bit(g, 4) & ~(syn & ~ack) & ~(syn & ack & ~bit(g, 2))
    near = (bit(g, 2) & ~bit(g, 16)) | (F.abs(req("ack") - rep("seq")) <= 2)
    fits = (rst & ~ack) | (F.abs(req("seq") - rep("ack")) <= 2 + req("payload_len"))
    return ok & near & fits


def arp_answers() -> Column:
    return (rep("op") == req("op") + 1) & (rep("psrc") == req("pdst"))


def icmp_answers() -> Column:
    reply = F.lit(False)
    for a, b in ICMP_REPLIES.items():
        reply = reply | (req("type") == a) & (rep("type") == b)
    return reply


def rules(protocol: str) -> tuple[list[tuple[str, str]], Column | None]:
    """Join columns (request, reply) and the residual predicate of a protocol; None where the columns say all."""
    swap = [("src", "dst"), ("dst", "src")]
    ports = [("sport", "dport"), ("dport", "sport")]
    table = {
        "dot11_auth": ([("addr1", "addr2"), ("addr2", "addr1"), ("algorithm", "algorithm")], rep("seqnum") == req("seqnum") + 1),
        "ethernet": ([("type", "type")], None),
        "arp": ([("hwtype", "hwtype"), ("ptype", "ptype"), ("pdst", "psrc")], arp_answers()),
        "ipv4": ([*swap, ("proto", "proto")], None),
        "ipv6": ([*swap, ("nh", "nh")], None),
        "tcp": ([*swap, *ports], tcp_answers()),
        "udp": ([*swap, ("sport", "dport")], None),
        "icmp": ([*swap, ("id", "id"), ("seq", "seq")], icmp_answers()),
        "icmpv6": ([*swap, ("id", "id"), ("seq", "seq")], (req("type") == 128) & (rep("type") == 129)),
        "dns": ([*swap, *ports, ("dns_id", "dns_id")], None),
        # their packets say nothing more about what answers what
        **{p: ([*swap, *ports], None) for p in ("ftp", "smtp", "pop3", "imap", "tftp", "dnp3")},
        "dot3": (swap, None),
        "dot15d4": ([("seqnum", "seqnum")], req("ackreq") & (rep("frametype") == 2)),
        "dot11": ([("addr1", "addr2"), ("addr2", "addr1")], req("subtype").isin(0, 2, 4) & (rep("subtype") == req("subtype") + 1) | (req("subtype") == 11) & (rep("subtype") == 11)),
        "zwave": ([("home_id", "home_id"), ("src", "dst"), ("dst", "src")], None),
        "raw": ([("load", "load")], None),
    }
    if protocol not in table:
        raise ValueError(f"no pairing for {protocol}")
    return table[protocol]


def answers(requests: DataFrame, replies: DataFrame, protocol: str) -> DataFrame:
    """All (req, rep) struct pairs of which the reply answers the request."""
    keys, residual = rules(protocol)
    a = requests.select(F.struct("*").alias("req"), *(F.col(x).alias(f"_k{i}") for i, (x, _) in enumerate(keys)))
    residual = F.lit(True) if residual is None else residual
    b = replies.select(F.struct("*").alias("rep"), *(F.col(y).alias(f"_k{i}") for i, (_, y) in enumerate(keys)))
    return a.join(b, [f"_k{i}" for i in range(len(keys))]).where(residual).select("req", "rep")


def pair(packets: DataFrame, protocol: str, order: str = "packet_index") -> DataFrame:
    """Each request with the earliest reply after it.

    Where the keys say all, one sort of requests and replies does; else the pairs of a key are met and filtered.
    """
    keys, residual = rules(protocol)
    if residual is None:
        names = [f"_k{i}" for i in range(len(keys))]
        side = lambda i: packets.select(*(F.col(k[i]).alias(n) for n, k in zip(names, keys)), F.col(order).alias("at")).dropna(subset=names)
        found = first_after(side(0), side(1), names, "at", strictly=True).where("reply_at is not null")
        return found.select(F.col("at").alias("request_index"), F.col("reply_at").alias("reply_index"))
    both = answers(packets, packets, protocol).where(rep(order) > req(order))
    first = both.groupBy(req(order).alias("request_index")).agg(F.min(rep(order)).alias("reply_index"))
    return first


def first_after(requests: DataFrame, replies: DataFrame, keys: list[str], order: str, strictly: bool = False) -> DataFrame:
    """requests with reply_<order>: the next later reply of the same keys, by one sort instead of a join.

    Rows run backwards, so the reply last seen is the next one, and each row is looked at once. A reply of the
    same order counts as later unless strictly.
    """
    both = requests.select(*keys, F.col(order), F.lit(True).alias("asks")).unionByName(replies.select(*keys, F.col(order), F.lit(False).alias("asks")))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("asks").desc() if strictly else F.col("asks")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"reply_{order}", F.last(F.when(~F.col("asks"), F.col(order)), ignorenulls=True).over(w)).where("asks").drop("asks")


def neighbours_asof(packets: DataFrame, arp_replies: DataFrame, ttl_ns: int = 120_000_000_000) -> DataFrame:
    """packets (ip, ts_ns, packet_index) with mac: the latest ARP claim for the address not older than ttl_ns.

    Claims and packets are sorted together once; the running last claim is an as-of join without a range join.
    """
    claims = arp_replies.select("ip", "ts_ns", F.lit(-1).cast("bigint").alias("packet_index"), F.col("mac").alias("claimed"), F.col("ts_ns").alias("claimed_ns"))
    asks = packets.select("ip", "ts_ns", "packet_index", F.lit(None).cast("string").alias("claimed"), F.lit(None).cast("bigint").alias("claimed_ns"))
    w = Window.partitionBy("ip").orderBy("ts_ns", "packet_index").rowsBetween(Window.unboundedPreceding, 0)
    last = claims.unionByName(asks).withColumns({"mac": F.last("claimed", True).over(w), "at": F.last("claimed_ns", True).over(w)}).where("packet_index >= 0")
    return last.select("packet_index", "ip", "ts_ns", F.when(F.col("ts_ns") - F.col("at") <= ttl_ns, F.col("mac")).alias("mac"))


def arp_conflicts(claims: DataFrame, window_ns: int) -> DataFrame:
    """Addresses claimed by more than one MAC within a window."""
    w = F.floor(F.col("ts_ns") / window_ns).alias("window")
    return claims.groupBy("ip", w).agg(F.count_distinct("mac").alias("macs"), F.array_sort(F.collect_set("mac")).alias("claimed_by")).where("macs > 1")


def routes(packets: DataFrame, networks: DataFrame, longest: bool = False) -> DataFrame:
    """packets (dst_ip) with the network (net, prefix, route_order) that holds the destination: the first in order, or the longest prefix.

    Destinations are made distinct first, and networks joined by prefix length as an equality, so that
    nothing is compared pairwise; the number of distinct prefix lengths is at most 33.
    """
    from wirelark.functions.net import network

    lengths = networks.select("prefix").distinct()
    asked = packets.select("dst_ip").distinct().join(F.broadcast(lengths)).withColumn("_n", network(F.col("dst_ip"), F.col("prefix")))
    nets = networks.withColumn("_n", network(F.col("net"), F.col("prefix")))
    found = asked.join(nets, ["prefix", "_n"])
    best = F.struct(-F.col("prefix"), F.col("route_order")) if longest else F.struct("route_order", F.col("prefix"))
    chosen = found.groupBy("dst_ip").agg(F.min_by(F.struct("net", "prefix", "route_order"), best).alias("route"))
    return packets.join(chosen, "dst_ip", "left").select(*packets.columns, "route.net", "route.prefix", "route.route_order")


def interface_routes(packets: DataFrame, interfaces: DataFrame, gateway: int | None = None) -> DataFrame:
    """packets (dst_ip) with interface, next_hop and is_local, as a host chooses its way out.

    interfaces: name, net, prefix, route_order, up, loopback. Loopback destinations go to the loopback; broadcast
    and multicast ones out of the default interface, the first that is up, without a gateway; others out of
    the first one up whose network holds them, else through the gateway out of the default interface. All
    are null where there is no way. Interfaces are few: those of one host.
    """
    usable = interfaces.where("up AND NOT loopback")
    found = routes(packets, usable.select("net", "prefix", "route_order"))
    names = F.broadcast(usable.select("route_order", F.col("name").alias("_name")))
    default = F.broadcast(interfaces.agg(F.min_by(F.when(F.col("up") & ~F.col("loopback"), F.col("name")), F.when(F.col("up") & ~F.col("loopback"), F.col("route_order"))).alias("_default"), F.min_by(F.when(F.col("loopback"), F.col("name")), F.when(F.col("loopback"), F.col("route_order"))).alias("_lo")))
    dst, none = F.col("dst_ip"), F.lit(None)
    back, cast = F.shiftright(dst, 24) == 127, (dst == 0xFFFFFFFF) | (F.shiftright(dst, 28) == 14)
    held, away = F.col("_name").isNotNull(), F.lit(gateway is not None) & F.col("_default").isNotNull()
    name = F.when(back, F.col("_lo")).when(cast, F.col("_default")).when(held, F.col("_name")).when(away, F.col("_default"))
    local = back | cast | held
    hop = F.when(local, dst).when(away, F.lit(gateway).cast("bigint"))
    out = found.join(names, "route_order", "left").join(default)
    return out.select(*packets.columns, name.alias("interface"), F.when(name.isNotNull(), hop).alias("next_hop"), F.when(name.isNotNull(), local).otherwise(none).alias("is_local"))


def destination_macs(routed: DataFrame, neighbours: DataFrame) -> DataFrame:
    """interface_routes() rows with mac: of broadcast and multicast by their rule, of others what neighbours (ip, mac), one row an address, knows of the next hop."""
    dst = F.col("dst_ip")
    group = F.concat(F.lit("01:00:5e:"), F.lower(F.concat_ws(":", *(F.lpad(F.hex(F.shiftright(dst, s).bitwiseAND(m)), 2, "0") for s, m in ((16, 127), (8, 255), (0, 255))))))
    known = neighbours.select(F.col("ip").alias("next_hop"), F.col("mac").alias("_mac"))
    mac = F.when(dst == 0xFFFFFFFF, "ff:ff:ff:ff:ff:ff").when(F.shiftright(dst, 28) == 14, group).otherwise(F.col("_mac"))
    return routed.join(known, "next_hop", "left").select(*routed.columns, mac.alias("mac"))


def dhcp_leases(messages: DataFrame) -> DataFrame:
    """Lease intervals from DHCP packets (client, ip, ts_ns, lease_time, msg_type): each ACK holds until it runs out, is renewed or released."""
    w = Window.partitionBy("client").orderBy("ts_ns")
    events = messages.where("msg_type in (5, 7, 4)").withColumn("next_ns", F.lead("ts_ns").over(w))
    end = F.col("ts_ns") + F.col("lease_time") * F.lit(1_000_000_000)
    return events.where("msg_type = 5").select("client", "ip", F.col("ts_ns").alias("from_ns"), F.least(end, F.coalesce("next_ns", end)).alias("until_ns"))
