"""Conversations: canonical keys, per-direction statistics, TCP states, ICMP counters, idle tests.

Statistics are partial aggregates over the flow key; nothing gathers a flow's packets. The TCP state of a
flow is found in two steps, so that one elephant flow is not one task's work: packets of a stretch of
the capture are folded to the function that maps each starting state to a final one, and the functions
of a flow's stretches are applied in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wirelark.functions.bytesx import ip_text, take
from wirelark.functions.net import flag
from wirelark.operators.dissect import dissect
from wirelark.shared import written

STATES = "LISTEN SYN_SENT SYN_RCVD ESTABLISHED FIN_WAIT_1 FIN_WAIT_2 CLOSE_WAIT CLOSING LAST_ACK TIME_WAIT CLOSED".split()
KEY = ["addr_a", "port_a", "addr_b", "port_b", "protocol"]
#: Packets of the capture per stretch of the state fold.
STRETCH = 65_536


@dataclass(frozen=True)
class FlowConfig:
    """Limits and options. Memory budgets and spill folders have no meaning here: Spark spills by itself."""

    max_ooo_fragments: int = 100
    max_reassembly_buffer: int = 16 << 20
    track_max_packet_len: bool = False
    track_max_flow_len: bool = False
    packet_indices: bool = True
    ordered: bool = True
    reassemble: bool = False
    on_unparsed: str = "skip"
    compat_icmpv6: bool = False
    tcp_established_timeout_s: int = 86_400
    tcp_half_open_timeout_s: int = 5
    udp_timeout_s: int = 120
    memory_budget: int | None = None
    spill_dir: str | None = None

    def __post_init__(self) -> None:
        if self.on_unparsed not in ("skip", "fail"):
            raise ValueError("on_unparsed is 'skip' or 'fail'")


def step(state: str, syn: bool, ack: bool, fin: bool, rst: bool, forward: bool) -> str:
    """The state after a packet."""
    if rst:
        return "CLOSED"
    moves = {
        "LISTEN": ("SYN_SENT", syn and not ack),
        "SYN_SENT": ("SYN_RCVD", syn and ack),
        "SYN_RCVD": ("ESTABLISHED", ack and not syn),
        "ESTABLISHED": ("FIN_WAIT_1" if forward else "CLOSE_WAIT", fin),
        "FIN_WAIT_1": ("TIME_WAIT" if fin and ack else "FIN_WAIT_2" if ack else "CLOSING", ack or fin),
        "FIN_WAIT_2": ("TIME_WAIT", fin),
        "CLOSE_WAIT": ("LAST_ACK", fin),
        "CLOSING": ("TIME_WAIT", ack),
        "LAST_ACK": ("CLOSED", ack),
    }
    after, moved = moves.get(state, (state, False))
    return after if moved else state


def symbol(flags: Column, forward: Column) -> Column:
    """What the state machine sees of a packet, 0 to 31."""
    parts = [flag(flags, "S"), flag(flags, "A"), flag(flags, "F"), flag(flags, "R"), forward]
    return sum((F.when(p, 1 << i).otherwise(0) for i, p in enumerate(parts)), F.lit(0)).cast("int")


def transitions() -> Column:
    """ARRAY<INT>: the next state at state * 32 + symbol, made from step()."""
    return F.array(*(F.lit(STATES.index(step(s, *(bool(k >> i & 1) for i in range(5))))) for s in STATES for k in range(32)))


def packets(df: DataFrame, frame: str = "frame", on_unparsed: str = "skip") -> DataFrame:
    """One row per packet that belongs to a flow: the key, forward, packet_index, ts_ns, len, and what flows use of the headers.

    df needs packet_index, ts_ns and a frame, or the columns that dissect adds. Frames without IP, or whose TCP or UDP header is
    missing, belong to no flow; frames of under 14 bytes are skipped, or fail the query with on_unparsed="fail".
    """
    d = df if "l4_start" in df.columns else dissect(df, frame=frame)
    b, l4 = F.col(frame), F.col("l4_start")
    if on_unparsed == "fail":
        d = d.where(F.when(F.length(b) >= 14, True).otherwise(F.raise_error(F.lit("packet is not parsed"))))
    number = F.col("layout.proto")
    d = d.where((F.col("layout.forward") >= 0) & (~number.isin(6, 17) | l4.isNotNull()))
    name = F.when(number == 6, "TCP").when(number == 17, "UDP").when(number == 1, "ICMP").when(number == 58, "ICMPv6").otherwise(F.concat(F.lit("Other:"), number))
    known = lambda c: F.when(F.col(f"layout.{c}") >= 0, F.col(f"layout.{c}")).alias(c)
    is_tcp = number == 6
    return d.select(
        # protocols without a name of their own are told apart by number
        "layout.addr_a", F.col("layout.port_a").cast("int").alias("port_a"), "layout.addr_b", F.col("layout.port_b").cast("int").alias("port_b"), name.alias("protocol"),
        (F.col("layout.forward") == 1).alias("forward"), "packet_index", "ts_ns", F.length(b).alias("len"), *(F.when(is_tcp, F.col(f"layout.{c}")).alias(c) for c in ("flags", "seq", "ack", "window")),
        F.when(is_tcp, F.length(b) - F.col("payload_start")).alias("payload_len"), F.when(is_tcp, take(b, F.col("payload_start"), F.length(b))).alias("payload"), *map(known, ("icmp_type", "icmp_code", "icmp_id", "icmp_seq")),
    )


def tcp_states(p: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """KEY, tcp_state and tcp_packets of the TCP flows of packets()."""
    table = transitions()
    own = p.where("protocol = 'TCP'").select(*KEY, "packet_index", symbol(F.col("flags"), F.col("forward")).alias("sym"), F.floor(F.col("packet_index") / stretch).alias("stretch"))
    start = F.array(*map(F.lit, range(len(STATES))))
    folded = own.groupBy(*KEY, "stretch").agg(F.array_sort(F.collect_list(F.struct("packet_index", "sym"))).alias("xs"))
    moves = folded.select(*KEY, "stretch", F.size("xs").cast("bigint").alias("n"), F.aggregate("xs", start, lambda acc, x: F.transform(acc, lambda s: F.get(table, s * 32 + x["sym"]))).alias("moves"))
    whole = moves.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("stretch", "moves"))).alias("ms"), F.sum("n").alias("tcp_packets"))
    last = F.aggregate("ms", F.lit(0), lambda s, m: F.get(m["moves"], s))
    return whole.select(*KEY, F.get(F.array(*map(F.lit, STATES)), last).alias("tcp_state"), "tcp_packets")


def endpoints(p: DataFrame) -> DataFrame:
    """KEY and per direction initial_seq, next_seq, last_ack, window: an ordered fold of each TCP flow's packets."""
    table = transitions()
    side = "struct<initial_seq:bigint,next_seq:bigint,last_ack:bigint,window:bigint>"
    zero = F.struct(F.lit(None).cast("bigint").alias("initial_seq"), F.lit(0).cast("bigint").alias("next_seq"), F.lit(0).cast("bigint").alias("last_ack"), F.lit(0).cast("bigint").alias("window")).cast(side)
    xs = p.where("protocol = 'TCP'").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("packet_index", "forward", "flags", "seq", "ack", "window", "payload_len", symbol(F.col("flags"), F.col("forward")).alias("sym")))).alias("xs"))
    low = lambda c: c.bitwiseAND(0xFFFFFFFF)

    def change(e: Column, s: Column, x: Column) -> Column:
        syn, ack, fin, rst = (flag(x["flags"], c) for c in "SAFR")
        opens = (s == 0) & syn & ~ack
        answers = (s == 1) & syn & ack
        open_ = s == 3
        live = ~rst
        first = F.when(live & (opens | answers), x["seq"]).otherwise(e["initial_seq"])
        after = F.when(live & (opens | answers), low(x["seq"] + 1)).when(live & open_, low(x["seq"] + x["payload_len"] + F.when(fin, 1).otherwise(0))).otherwise(e["next_seq"])
        acked = F.when(live & (answers | open_ | (s == 2) & ack & ~syn), x["ack"]).otherwise(e["last_ack"])
        return F.struct(first.alias("initial_seq"), after.alias("next_seq"), acked.alias("last_ack"), x["window"].alias("window")).cast(side)

    def fold(a: Column, x: Column) -> Column:
        return F.struct(
            F.get(table, a["s"] * 32 + x["sym"]).alias("s"),
            F.when(x["forward"], change(a["f"], a["s"], x)).otherwise(a["f"]).alias("f"),
            F.when(x["forward"], a["r"]).otherwise(change(a["r"], a["s"], x)).alias("r"),
        )

    done = xs.select(*KEY, F.aggregate("xs", F.struct(F.lit(0).alias("s"), zero.alias("f"), zero.alias("r")), fold).alias("a"))
    return done.select(*KEY, *(F.col(f"a.{d}.{c}").alias(f"{c}_{n}") for d, n in (("f", "fwd"), ("r", "rev")) for c in ("initial_seq", "next_seq", "last_ack", "window")))


def status_of(tcp_state: Column) -> Column:
    return F.when(tcp_state.isin("CLOSED", "TIME_WAIT"), "Closed").when(tcp_state.isin("FIN_WAIT_1", "FIN_WAIT_2", "CLOSE_WAIT", "CLOSING", "LAST_ACK"), "HalfClosed").otherwise("Active")


def flow_stats(p: DataFrame, config: FlowConfig = FlowConfig()) -> DataFrame:
    """KEY and the statistics of each flow of packets()."""
    fwd, idx = F.col("forward"), F.col("packet_index")
    icmp = F.col("protocol").isin("ICMP") if config.compat_icmpv6 else F.col("protocol").isin("ICMP", "ICMPv6")
    start, last = F.min_by("ts_ns", "packet_index"), F.max_by("ts_ns", "packet_index")
    seen = lambda d: F.coalesce(F.max_by(F.when(d, F.col("ts_ns")), F.when(d, idx)), start)
    latest = lambda c: F.max_by(F.when(icmp, F.col(c)), F.when(icmp & F.col(c).isNotNull(), idx))
    total = lambda c, d: F.sum(F.when(d, F.col(c)).otherwise(0)).cast("bigint")
    most = lambda on, d: F.max(F.when(d, F.col("len"))) if on else F.max(F.lit(None).cast("int"))
    return p.groupBy(*KEY).agg(
        start.alias("start_ns"), last.alias("last_ns"), F.min("packet_index").alias("first_index"), seen(fwd).alias("forward_last_ns"), seen(~fwd).alias("reverse_last_ns"),
        F.count_if(fwd).alias("forward_packets"), F.count_if(~fwd).alias("reverse_packets"), total("len", fwd).alias("forward_bytes"), total("len", ~fwd).alias("reverse_bytes"), F.count("*").alias("total_packets"), F.sum("len").cast("bigint").alias("total_bytes"),
        most(config.track_max_packet_len, fwd).alias("forward_max_packet_len"), most(config.track_max_packet_len, ~fwd).alias("reverse_max_packet_len"), most(config.track_max_flow_len, F.lit(True)).alias("max_flow_len"),
        *([F.sort_array(F.collect_list("packet_index")).alias("packet_indices")] if config.packet_indices else []),
        F.max_by("icmp_type", F.when(F.col("icmp_type").isNotNull(), idx)).alias("icmp_type"), F.max_by("icmp_code", F.when(F.col("icmp_code").isNotNull(), idx)).alias("icmp_code"), latest("icmp_id").alias("icmp_identifier"), latest("icmp_seq").alias("icmp_last_seq"),
        F.count_if(icmp & F.col("icmp_type").isin(8, 128)).alias("icmp_request_count"), F.count_if(icmp & F.col("icmp_type").isin(0, 129)).alias("icmp_reply_count"),
    )


def conversations(df: DataFrame, config: FlowConfig = FlowConfig()) -> DataFrame:
    """All flows of packets (packet_index, ts_ns, frame) with the public columns, ordered by start and first packet unless the config leaves that to the sink.

    Packets are dissected once: what flows need of them is written, without payloads, and read for each fold.
    """
    from wirelark.operators.reassembly import tcp_streams

    p = packets(df, on_unparsed=config.on_unparsed)
    slim = written(p.drop("payload"))
    out = flow_stats(slim, config).join(tcp_states(slim), KEY, "left")
    if config.reassemble:
        out = out.join(tcp_streams(p, config), KEY, "left")
    else:
        none = F.lit(None)
        out = out.withColumns({"dropped_segments_fwd": none.cast("bigint"), "dropped_segments_rev": none.cast("bigint"), "reassembled_forward": none.cast("binary"), "reassembled_reverse": none.cast("binary")})
    tcp = F.col("protocol") == "TCP"
    dropped = [F.when(tcp, F.coalesce(f"dropped_segments_{d}", F.lit(0))) for d in ("fwd", "rev")]
    is_icmp = F.col("protocol").isin("ICMP", "ICMPv6")
    none = lambda t: F.lit(None).cast(t)
    rows = out.select(
        ip_text(F.col("addr_a")).alias("src_addr"), ip_text(F.col("addr_b")).alias("dst_addr"), F.col("port_a").alias("src_port"), F.col("port_b").alias("dst_port"), F.when(F.col("protocol").startswith("Other"), "Other").otherwise(F.col("protocol")).alias("protocol"),
        status_of(F.col("tcp_state")).alias("status"), (F.col("start_ns") / 1e9).alias("start_time"), (F.greatest(F.lit(0), F.col("last_ns") - F.col("start_ns")) / 1e9).alias("duration"),
        "forward_packets", "reverse_packets", "forward_bytes", "reverse_bytes", "total_packets", "total_bytes", "forward_max_packet_len", "reverse_max_packet_len", "max_flow_len", *(["packet_indices"] if config.packet_indices else []), "tcp_state",
        (dropped[0] + dropped[1]).alias("dropped_segments"), dropped[0].alias("dropped_segments_fwd"), dropped[1].alias("dropped_segments_rev"), none("bigint").alias("zwave_home_id"), none("bigint").alias("zwave_command_count"), none("bigint").alias("zwave_ack_count"),
        "icmp_type", "icmp_code", "icmp_identifier", F.when(is_icmp, F.col("icmp_request_count")).alias("icmp_request_count"), F.when(is_icmp, F.col("icmp_reply_count")).alias("icmp_reply_count"), "icmp_last_seq", "reassembled_forward", "reassembled_reverse",
        "start_ns", "last_ns", "forward_last_ns", "reverse_last_ns", "first_index", none("int").alias("vlan_id"), "addr_a", "addr_b",
    )
    return rows.orderBy("start_ns", "first_index") if config.ordered else rows


def extract_flows(spark, path: str, config: FlowConfig = FlowConfig(), anonymization=None) -> DataFrame:
    """Conversations of a capture file or folder of captures."""
    from wirelark.operators.anonymize import anonymize_flows
    from wirelark.sources.pcap import read_capture

    found = conversations(read_capture(spark, path), config)
    return found if anonymization is None else anonymize_flows(found, anonymization, config.ordered)


def extract_flows_from_packets(df: DataFrame, config: FlowConfig = FlowConfig(), anonymization=None) -> DataFrame:
    """Conversations of frames with packet_index; each packet's time is its index in seconds."""
    from wirelark.operators.anonymize import anonymize_flows

    found = conversations(df.withColumn("ts_ns", F.col("packet_index") * F.lit(1_000_000_000)), config)
    return found if anonymization is None else anonymize_flows(found, anonymization, config.ordered)


def timeout_ns(protocol: Column, tcp_state: Column, config: FlowConfig = FlowConfig()) -> Column:
    """Idle limit in ns; NULL for flows that never expire."""
    half = tcp_state.isin("SYN_SENT", "SYN_RCVD", "LISTEN")
    seconds = F.when(protocol == "TCP", F.when(tcp_state.isin("CLOSED", "TIME_WAIT"), F.lit(None).cast("bigint")).when(half, config.tcp_half_open_timeout_s).otherwise(config.tcp_established_timeout_s)).otherwise(config.udp_timeout_s)
    return seconds * F.lit(1_000_000_000)


def is_idle(now_ns: Column, config: FlowConfig = FlowConfig()) -> Column:
    """Whether a flow of conversations() has been silent for longer than its limit."""
    return F.coalesce(now_ns - F.col("last_ns") > timeout_ns(F.col("protocol"), F.col("tcp_state"), config), F.lit(False))


def evict_idle(flows: DataFrame, now_ns: int, config: FlowConfig = FlowConfig()) -> DataFrame:
    """The flows that stay."""
    return flows.where(~is_idle(F.lit(now_ns), config))


def split_on_idle(p: DataFrame, limit_s: int = 120) -> DataFrame:
    """packets() with segment: a flow starts anew after a silence longer than the limit."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEY).orderBy("packet_index")
    gap = F.col("ts_ns") - F.lag("ts_ns").over(w) > limit_s * 1_000_000_000
    return p.withColumn("_new", F.when(gap, 1).otherwise(0)).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def zwave_flows(df: DataFrame) -> DataFrame:
    """Flows of Z-Wave frames (packet_index, ts_ns, zwave struct): home and node pair, commands and acknowledgements."""
    z = df.where("zwave is not null").select("packet_index", "ts_ns", F.length("frame").alias("len"), "zwave.*")
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return z.groupBy("home_id", a.alias("node_a"), b.alias("node_b")).agg(F.count("*").alias("total_packets"), F.sum("len").alias("total_bytes"), F.count_if(F.col("headertype") != 3).alias("zwave_command_count"), F.count_if(F.col("headertype") == 3).alias("zwave_ack_count"), F.min_by("ts_ns", "packet_index").alias("start_ns"), F.max_by("ts_ns", "packet_index").alias("last_ns"))


def packets_with_flows(p: DataFrame, flows: DataFrame) -> DataFrame:
    """Packet indices joined back to the flows that hold them."""
    return flows.select("src_addr", "dst_addr", "src_port", "dst_port", "protocol", F.explode("packet_indices").alias("packet_index")).join(p, "packet_index")


def observed(p: DataFrame, name: str = "packets") -> tuple[DataFrame, Observation]:
    """packets() with running totals of what an action reads of them: packets, bytes, span_ns, unkeyed; ``.get`` waits for the action."""
    seen = Observation(name)
    totals = [F.count("*").alias("packets"), F.sum("len").alias("bytes"), (F.max("ts_ns") - F.min("ts_ns")).alias("span_ns"), F.count_if(F.col("addr_a").isNull()).alias("unkeyed")]
    return p.observe(seen, *totals), seen


def summary_text() -> Column:
    """One line for a conversation."""
    return F.format_string("%s:%d <-> %s:%d %s %s packets=%d bytes=%d", "src_addr", "src_port", "dst_addr", "dst_port", "protocol", "status", "total_packets", "total_bytes")
