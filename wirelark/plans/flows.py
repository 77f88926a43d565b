"""Queries over conversations: keys, statistics, states, reassembly, pairing, anonymisation, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wirelark.functions.bytesx import ip4_long, ip4_text, take
from wirelark.operators import anonymize as anon
from wirelark.operators import build, flow, pairing
from wirelark.plans import derived
from wirelark.plans.base import packets_sql, quad, query
from wirelark.plans.frames import folder

QUERIES: dict = {}

K = """k AS (SELECT *, src_ip < dst_ip AS fwd, least(src_ip, dst_ip) AS ka, greatest(src_ip, dst_ip) AS kb, CASE WHEN src_ip < dst_ip THEN sport ELSE dport END AS pa,
  CASE WHEN src_ip < dst_ip THEN dport ELSE sport END AS pb, ((flags >> 1) & 1) + 2 * ((flags >> 4) & 1) + 4 * (flags & 1) + 8 * ((flags >> 2) & 1) + CASE WHEN src_ip < dst_ip THEN 16 ELSE 0 END AS sym FROM p)"""
FSM = """list_reduce(list(sym ORDER BY packet_index), lambda s, x: CASE WHEN (x & 8) <> 0 THEN 10 WHEN s = 0 AND (x & 3) = 1 THEN 1 WHEN s = 1 AND (x & 3) = 3 THEN 2 WHEN s = 2 AND (x & 3) = 2 THEN 3
  WHEN s = 3 AND (x & 4) <> 0 THEN CASE WHEN (x & 16) <> 0 THEN 4 ELSE 6 END WHEN s = 4 AND (x & 6) = 6 THEN 9 WHEN s = 4 AND (x & 2) <> 0 THEN 5 WHEN s = 4 AND (x & 4) <> 0 THEN 7 WHEN s = 5 AND (x & 4) <> 0 THEN 9
  WHEN s = 6 AND (x & 4) <> 0 THEN 8 WHEN s = 7 AND (x & 2) <> 0 THEN 9 WHEN s = 8 AND (x & 2) <> 0 THEN 10 ELSE s END, 0)"""
STATE_NAMES = "[" + ", ".join(f"'{s}'" for s in flow.STATES) + "]"
SRC, DST = f"{quad('ka')} AS src_addr", f"{quad('kb')} AS dst_addr"


def tcp(spark, sf):
    return flow.packets(derived.plain_tcp_frames(spark, sf).select("packet_index", "ts_ns", "frame"))


def named(df):
    return df.withColumns({"src_addr": ip4_text(F.col("addr_a")), "dst_addr": ip4_text(F.col("addr_b"))}).withColumnsRenamed({"port_a": "src_port", "port_b": "dst_port"})


@query(QUERIES, packets_sql(f"SELECT {SRC}, {DST}, pa AS src_port, pb AS dst_port, {STATE_NAMES}[{FSM} + 1] AS tcp_state, count(*) AS total_packets FROM k GROUP BY ka, kb, pa, pb", K))
def flow_tcp_state(spark, sf):
    """Flagship: frames are synthesised, dissected, keyed and folded to conversations with their TCP states."""
    return named(flow.tcp_states(tcp(spark, sf))).withColumnRenamed("tcp_packets", "total_packets").select("src_addr", "dst_addr", "src_port", "dst_port", "tcp_state", "total_packets")


@query(QUERIES, packets_sql(f"""SELECT {SRC}, {DST}, pa AS src_port, pb AS dst_port, count(*) AS total_packets, CAST(sum(len) AS BIGINT) AS total_bytes, arg_min(ts_ns, packet_index) AS start_ns, arg_max(ts_ns, packet_index) AS last_ns,
  count(*) FILTER (fwd) AS forward_packets, count(*) FILTER (NOT fwd) AS reverse_packets, CAST(coalesce(sum(len) FILTER (fwd), 0) AS BIGINT) AS forward_bytes, CAST(coalesce(sum(len) FILTER (NOT fwd), 0) AS BIGINT) AS reverse_bytes,
  coalesce(arg_max(ts_ns, packet_index) FILTER (fwd), arg_min(ts_ns, packet_index)) AS forward_last_ns FROM k GROUP BY ka, kb, pa, pb""", K))
def flow_stats(spark, sf):
    s = named(flow.flow_stats(tcp(spark, sf), flow.FlowConfig(packet_indices=False)))
    return s.select("src_addr", "dst_addr", "src_port", "dst_port", "total_packets", "total_bytes", "start_ns", "last_ns", "forward_packets", "reverse_packets", "forward_bytes", "reverse_bytes", "forward_last_ns")


@query(QUERIES, packets_sql(f"SELECT {SRC}, {DST}, pa AS src_port, pb AS dst_port, max(len) FILTER (fwd) AS forward_max, max(len) FILTER (NOT fwd) AS reverse_max, max(len) AS flow_max FROM k GROUP BY ka, kb, pa, pb", K))
def flow_maxlen(spark, sf):
    s = named(flow.flow_stats(tcp(spark, sf), flow.FlowConfig(packet_indices=False, track_max_packet_len=True, track_max_flow_len=True)))
    return s.select("src_addr", "dst_addr", "src_port", "dst_port", F.col("forward_max_packet_len").alias("forward_max"), F.col("reverse_max_packet_len").alias("reverse_max"), F.col("max_flow_len").alias("flow_max"))


@query(QUERIES, packets_sql(f"SELECT {SRC}, {DST}, pa AS src_port, pb AS dst_port, string_agg(packet_index::VARCHAR, ',' ORDER BY packet_index) AS indices FROM k GROUP BY ka, kb, pa, pb", K))
def flow_packet_indices(spark, sf):
    s = named(flow.flow_stats(tcp(spark, sf)))
    return s.select("src_addr", "dst_addr", "src_port", "dst_port", F.array_join("packet_indices", ",").alias("indices"))


STATUS = f"CASE WHEN {FSM} IN (9, 10) THEN 'Closed' WHEN {FSM} BETWEEN 4 AND 8 THEN 'HalfClosed' ELSE 'Active' END"


@query(QUERIES, packets_sql(f"SELECT status, count(*) AS flows FROM (SELECT {STATUS} AS status FROM k GROUP BY ka, kb, pa, pb) GROUP BY status", K))
def flow_status(spark, sf):
    return flow.tcp_states(tcp(spark, sf)).groupBy(flow.status_of(F.col("tcp_state")).alias("status")).agg(F.count("*").alias("flows"))


@query(QUERIES, packets_sql(f"""SELECT {SRC}, {DST}, pa AS src_port, pb AS dst_port, status, total_packets, duration_us FROM (SELECT ka, kb, pa, pb, {STATUS} AS status, count(*) AS total_packets,
  greatest(0, arg_max(ts_ns, packet_index) - arg_min(ts_ns, packet_index)) // 1000 AS duration_us FROM k GROUP BY ka, kb, pa, pb)""", K))
def extract_flows_file(spark, sf):
    """A capture written to disk, read back, and turned into conversations."""
    from wirelark.sources import pcap

    path = folder(spark)
    pcap.write_capture(derived.plain_tcp_frames(spark, sf).select("packet_index", "ts_ns", "frame"), path, "pcap", single=True)
    c = flow.extract_flows(spark, path, flow.FlowConfig(packet_indices=False, ordered=False))
    return c.select("src_addr", "dst_addr", "src_port", "dst_port", "status", "total_packets", F.floor(F.greatest(F.lit(0), F.col("last_ns") - F.col("start_ns")) / 1000).alias("duration_us"))


@query(QUERIES, packets_sql(f"SELECT {SRC}, {DST}, pa AS src_port, pb AS dst_port, coalesce(arg_max(4096 + event_id % 100, packet_index) FILTER (fwd), 0) AS window_fwd FROM k GROUP BY ka, kb, pa, pb", K))
def flow_endpoint_window(spark, sf):
    """Last window of the forward endpoint, from the ordered endpoint fold."""
    p = derived.packets(spark, sf)
    seg = build.tcp(F.lit(bytearray()), F.col("src_ip"), F.col("dst_ip"), F.col("sport"), F.col("dport"), F.col("seq"), F.col("ack"), F.col("flags"), window=F.lit(4096) + F.col("event_id") % 100, with_checksum=False)
    frames = p.select("packet_index", "ts_ns", build.ethernet(build.ipv4(seg, F.col("src_ip"), F.col("dst_ip"), 6)).alias("frame"))
    e = named(flow.endpoints(flow.packets(frames)))
    return e.select("src_addr", "dst_addr", "src_port", "dst_port", "window_fwd")


@query(QUERIES, packets_sql(f"""SELECT {SRC}, {DST}, user_id % 65536 AS ident, count(*) FILTER (outbound) AS requests, count(*) FILTER (NOT outbound) AS replies, arg_max(event_id % 65536, packet_index) AS last_seq FROM k GROUP BY ka, kb, user_id % 65536""", K))
def flow_icmp_counts(spark, sf):
    s = flow.flow_stats(flow.packets(derived.icmp_frames(spark, sf).select("packet_index", "ts_ns", "frame")), flow.FlowConfig(packet_indices=False))
    return named(s).select("src_addr", "dst_addr", F.col("icmp_identifier").alias("ident"), F.col("icmp_request_count").alias("requests"), F.col("icmp_reply_count").alias("replies"), F.col("icmp_last_seq").alias("last_seq"))


@query(QUERIES, packets_sql("SELECT home_id, node_a, node_b, count(*) AS total_packets, count(*) FILTER (event_id % 3 > 0) AS commands, count(*) FILTER (event_id % 3 = 0) AS acks FROM (SELECT 1000 + user_id % 5 AS home_id, least(1 + user_id % 7, 10 + event_id % 4) AS node_a, greatest(1 + user_id % 7, 10 + event_id % 4) AS node_b, event_id FROM p) GROUP BY ALL"))
def flow_zwave(spark, sf):
    from wirelark.operators import dissect as dis

    p = derived.packets(spark, sf)
    one, two = 1 + F.col("user_id") % 7, 10 + F.col("event_id") % 4
    src, dst = F.when(F.col("outbound"), one).otherwise(two), F.when(F.col("outbound"), two).otherwise(one)
    frame = F.when(F.col("event_id") % 3 == 0, build.zwave(1000 + F.col("user_id") % 5, src, dst, 0, 0, F.lit(bytearray()), ack=True)).otherwise(build.zwave(1000 + F.col("user_id") % 5, src, dst, 0x25, 1, F.lit(bytearray(b"\xff"))))
    z = flow.zwave_flows(dis.dissect(p.select("packet_index", "ts_ns", frame.alias("frame")), ["zwave"], root="zwave"))
    return z.select("home_id", "node_a", "node_b", "total_packets", F.col("zwave_command_count").alias("commands"), F.col("zwave_ack_count").alias("acks"))


@query(QUERIES, packets_sql(f"SELECT {SRC}, {DST}, pa AS src_port, pb AS dst_port FROM (SELECT ka, kb, pa, pb, arg_max(ts_ns, packet_index) AS last_ns, {FSM} AS st FROM k GROUP BY ka, kb, pa, pb) WHERE NOT (1706000000000000000 - last_ns > CASE WHEN st IN (9, 10) THEN 9223372036854775807 WHEN st < 3 THEN 5000000000 ELSE 86400000000000 END)", K))
def flow_idle_evict(spark, sf):
    c = flow.conversations(derived.plain_tcp_frames(spark, sf).select("packet_index", "ts_ns", "frame"), flow.FlowConfig(packet_indices=False))
    return flow.evict_idle(c, 1706000000000000000).select("src_addr", "dst_addr", "src_port", "dst_port")


@query(QUERIES, packets_sql(f"""SELECT {SRC}, {DST}, pa AS src_port, pb AS dst_port, segment, count(*) AS packets FROM (SELECT *, CAST(sum(CASE WHEN gap > 86400000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY ka, kb, pa, pb ORDER BY packet_index) AS BIGINT) AS segment FROM
  (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY ka, kb, pa, pb ORDER BY packet_index) AS gap FROM k)) GROUP BY ka, kb, pa, pb, segment""", K))
def flow_split_on_idle(spark, sf):
    s = flow.split_on_idle(tcp(spark, sf), 86_400)
    return named(s.groupBy(*flow.KEY, "segment").agg(F.count("*").alias("packets"))).select("src_addr", "dst_addr", "src_port", "dst_port", "segment", "packets")


@query(QUERIES, packets_sql("SELECT count(*) AS joined, count(DISTINCT packet_index) AS packets FROM k", K))
def packet_flow_backref(spark, sf):
    p = derived.plain_tcp_frames(spark, sf).select("packet_index", "ts_ns", "frame")
    c = flow.conversations(p)
    return flow.packets_with_flows(p.select("packet_index"), c).agg(F.count("*").alias("joined"), F.countDistinct("packet_index").alias("packets"))


@query(QUERIES, "SELECT l_orderkey, string_agg('[' || l_linenumber || ':' || l_partkey || ']', '' ORDER BY l_linenumber, l_partkey) AS stream FROM lineitem GROUP BY l_orderkey")
def tcp_reassembly(spark, sf):
    """Order lines as TCP segments that arrive backwards after a handshake, put together per stream."""
    from pyspark.sql import Window

    from wirelark.operators.reassembly import tcp_streams

    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.format_string("[%d:%d]", "l_linenumber", "l_partkey").alias("text"), "l_partkey")
    li = li.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")))
    w = Window.partitionBy("l_orderkey").orderBy("n")
    size = F.length("text")
    data = li.select("l_orderkey", (F.lit(100_000) - F.col("n")).alias("at"), F.lit(True).alias("forward"), F.lit(24).alias("flags"), (F.lit(1001) + F.sum(size).over(w) - size).alias("seq"), F.col("text").cast("binary").alias("payload"))
    keys = li.select("l_orderkey").distinct()
    shake = keys.select("l_orderkey", F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(fwd).alias("forward"), F.lit(flags).alias("flags"), F.lit(seq).cast("bigint").alias("seq")) for i, fwd, flags, seq in ((0, True, 2, 1000), (1, False, 18, 5000), (2, True, 16, 1001))))).alias("x")).select("l_orderkey", "x.*", F.lit(bytearray()).alias("payload"))
    rows = data.unionByName(shake).select(take(F.unhex(F.lpad(F.hex("l_orderkey"), 8, "0")), 0, 4).alias("addr_a"), F.lit(1).alias("port_a"), F.lit(bytearray(4)).alias("addr_b"), F.lit(2).alias("port_b"), F.lit("TCP").alias("protocol"), F.col("at").cast("bigint").alias("packet_index"), "forward", F.col("flags").cast("bigint").alias("flags"), "seq", "payload", F.length("payload").alias("payload_len"))
    return tcp_streams(rows).select(F.conv(F.hex("addr_a"), 16, 10).cast("bigint").alias("l_orderkey"), F.col("reassembled_forward").cast("string").alias("stream"))


def abstract(spark, sf):
    p = derived.packets(spark, sf)
    return p.select("packet_index", F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "sport", "dport", "flags", "seq", "ack", F.col("pay").alias("payload_len"), (F.col("user_id") % 65536).alias("id"), (F.floor(F.col("event_id") / 16) % 65536).alias("seq16"), F.when(F.col("outbound"), 8).otherwise(0).alias("type"), (F.col("event_id") % 65536).alias("dns_id"))


SELF = "FROM p q JOIN p r ON r.src_ip = q.dst_ip AND r.dst_ip = q.src_ip"


@query(QUERIES, packets_sql(f"SELECT q.packet_index AS request_index, min(r.packet_index) AS reply_index {SELF} AND r.sport = q.dport AND r.dport = q.sport AND r.packet_index > q.packet_index WHERE (q.flags & 4) = 0 AND NOT ((r.flags & 18) = 2) AND NOT ((r.flags & 18) = 18 AND (q.flags & 2) = 0) AND ((q.flags & 18) = 2 OR abs(q.ack - r.seq) <= 2) AND ((r.flags & 20) = 4 OR abs(q.seq - r.ack) <= 2 + q.pay) GROUP BY 1"))
def answers_tcp(spark, sf):
    return pairing.pair(abstract(spark, sf), "tcp")


@query(QUERIES, packets_sql(f"SELECT q.packet_index AS request_index, min(r.packet_index) AS reply_index {SELF} AND r.dport = q.sport AND r.packet_index > q.packet_index GROUP BY 1"))
def answers_udp(spark, sf):
    return pairing.pair(abstract(spark, sf), "udp")


@query(QUERIES, packets_sql(f"SELECT q.packet_index AS request_index, min(r.packet_index) AS reply_index {SELF} AND r.user_id % 65536 = q.user_id % 65536 AND r.event_id // 16 % 65536 = q.event_id // 16 % 65536 AND r.packet_index > q.packet_index WHERE q.outbound AND NOT r.outbound GROUP BY 1"))
def answers_icmp(spark, sf):
    return pairing.pair(abstract(spark, sf).withColumn("seq", F.col("seq16")), "icmp")


@query(QUERIES, packets_sql("SELECT q.packet_index AS request_index, min(r.packet_index) AS reply_index FROM p q JOIN p r ON r.src_ip = q.dst_ip AND r.packet_index > q.packet_index WHERE q.outbound AND NOT r.outbound GROUP BY 1"))
def answers_arp(spark, sf):
    a = derived.packets(spark, sf).select("packet_index", F.lit(1).alias("hwtype"), F.lit(2048).alias("ptype"), F.when(F.col("outbound"), 1).otherwise(2).alias("op"), F.col("src_ip").alias("psrc"), F.col("dst_ip").alias("pdst"))
    asks, gives = a.where("op = 1"), a.where("op = 2").select(F.col("psrc").alias("pdst"), "packet_index")
    return pairing.first_after(asks.select("pdst", "packet_index"), gives, ["pdst"], "packet_index").where("reply_packet_index is not null").select(F.col("packet_index").alias("request_index"), F.col("reply_packet_index").alias("reply_index"))


@query(QUERIES, "SELECT conv_id, turn AS asked, (SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'assistant' AND b.turn > a.turn) AS answered FROM conversations a WHERE role = 'user'")
def turn_pairing(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    r = pairing.first_after(c.where("role = 'user'").select("conv_id", "turn"), c.where("role = 'assistant'").select("conv_id", "turn"), ["conv_id"], "turn")
    return r.select("conv_id", F.col("turn").alias("asked"), F.col("reply_turn").alias("answered"))


@query(QUERIES, packets_sql("""SELECT packet_index, CASE WHEN ts_ns - cts <= 86400000000000 THEN mac END AS mac FROM (SELECT a.packet_index, a.ts_ns, c.ts_ns AS cts, c.mac FROM (SELECT packet_index, ts_ns, dst_ip AS ip FROM p WHERE event_type <> 'click') a ASOF LEFT JOIN
  (SELECT src_ip AS ip, ts_ns, max(lpad(user_id::VARCHAR, 12, '0')) AS mac FROM p WHERE event_type = 'click' GROUP BY 1, 2) c ON a.ip = c.ip AND a.ts_ns >= c.ts_ns)"""))
def arp_neighbor_asof(spark, sf):
    p = derived.packets(spark, sf)
    claims = p.where("event_type = 'click'").groupBy(F.col("src_ip").alias("ip"), "ts_ns").agg(F.max(F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("mac"))
    asks = p.where("event_type <> 'click'").select(F.col("dst_ip").alias("ip"), "ts_ns", "packet_index")
    return pairing.neighbours_asof(asks, claims, 86_400_000_000_000).select("packet_index", "mac")


@query(QUERIES, packets_sql("SELECT ip, w AS window, count(DISTINCT mac) AS macs FROM (SELECT dst_ip AS ip, ts_ns // 86400000000000 AS w, user_id % 10 AS mac FROM p) GROUP BY 1, 2 HAVING count(DISTINCT mac) > 1"))
def arp_conflict(spark, sf):
    c = derived.packets(spark, sf).select(F.col("dst_ip").alias("ip"), "ts_ns", (F.col("user_id") % 10).alias("mac"))
    return pairing.arp_conflicts(c, 86_400_000_000_000).select("ip", "window", "macs")


NETS = "nets AS (SELECT n_nationkey AS route_order, 167772160 + (n_nationkey % 3) * 65536 + n_nationkey * 256 AS net, 16 + n_nationkey % 9 AS prefix FROM nation)"
HELD = "((p.dst_ip >> CAST(32 - prefix AS INT)) = (net >> CAST(32 - prefix AS INT)))"


def networks(spark, sf):
    n = F.col("n_nationkey")
    return spark.read.parquet(f"{sf}/nation.parquet").select(n.alias("route_order"), (F.lit(167772160).cast("bigint") + (n % 3) * 65536 + n * 256).alias("net"), (F.lit(16) + n % 9).alias("prefix"))


@query(QUERIES, packets_sql(f"SELECT packet_index, route_order FROM (SELECT packet_index, route_order, row_number() OVER (PARTITION BY packet_index ORDER BY route_order) AS n FROM p LEFT JOIN nets ON {HELD}) WHERE n = 1", NETS))
def cidr_route_first_match(spark, sf):
    return pairing.routes(derived.packets(spark, sf).select("packet_index", F.col("dst_ip")), networks(spark, sf)).select("packet_index", "route_order")


@query(QUERIES, packets_sql(f"SELECT packet_index, route_order, prefix FROM (SELECT packet_index, route_order, prefix, row_number() OVER (PARTITION BY packet_index ORDER BY prefix DESC, route_order) AS n FROM p LEFT JOIN nets ON {HELD}) WHERE n = 1", NETS))
def cidr_route_lpm(spark, sf):
    return pairing.routes(derived.packets(spark, sf).select("packet_index", F.col("dst_ip")), networks(spark, sf), longest=True).select("packet_index", "route_order", "prefix")


GEN = "CASE WHEN {p} <= 1023 THEN {w} WHEN {p} <= 49151 THEN 1024 ELSE 49152 END"


@query(QUERIES, packets_sql(f"SELECT packet_index, {GEN.format(p='sport', w='CASE WHEN sport <= 1023 AND (dport > 1023 OR sport < dport) THEN sport ELSE 0 END')} AS src_port, {GEN.format(p='dport', w='CASE WHEN dport <= 1023 AND (sport > 1023 OR dport <= sport) THEN dport ELSE 0 END')} AS dst_port FROM p"))
def anon_ports(spark, sf):
    p = derived.packets(spark, sf).select("packet_index", F.col("sport").alias("src_port"), F.col("dport").alias("dst_port"))
    return anon.anonymize_ports(p, "preserve_well_known")


SHIFT = anon.epoch_offset_ns(7)


@query(QUERIES, packets_sql(f"SELECT packet_index, ts_ns + {SHIFT} AS start_ns FROM p"))
def anon_epoch_shift(spark, sf):
    p = derived.packets(spark, sf).select("packet_index", F.col("ts_ns").alias("start_ns"))
    return anon.anonymize_times(p, anon.Policy(timestamp_mode="epoch_shift", seed=7), ("start_ns",))


@query(QUERIES, packets_sql("SELECT packet_index, true AS kept_prefix, true AS repeats FROM p"))
def anon_cryptopan_prefix(spark, sf):
    """Source and destination share as many leading bits after anonymisation as before, and equal addresses stay equal."""
    from wirelark.functions.bytesx import put, uint

    p = derived.packets(spark, sf).select("packet_index", put(F.col("src_ip"), 4).alias("a"), put(F.col("dst_ip"), 4).alias("b"), put(F.col("src_ip"), 4).alias("c"))
    q = anon.anonymize_addresses(p, ["a", "b"], bytes(range(32))).withColumn("x", uint(F.col("a"), 0, 4).bitwiseXOR(uint(F.col("b"), 0, 4)))
    lead = lambda x: F.when(x == 0, 32).otherwise(31 - F.floor(F.log2(x)))
    before = p.select("packet_index", uint(F.col("a"), 0, 4).bitwiseXOR(uint(F.col("b"), 0, 4)).alias("y"))
    n = q.groupBy("c").agg(F.countDistinct("a").alias("n"))
    return q.join(before, "packet_index").join(n, "c").select("packet_index", (lead(F.col("x")) == lead(F.col("y"))).alias("kept_prefix"), (F.col("n") == 1).alias("repeats"))


@query(QUERIES, packets_sql("SELECT packet_index, 4 AS kept FROM p WHERE pay >= 4"))
def anon_truncate(spark, sf):
    p = derived.packets(spark, sf).where("pay >= 4").select("packet_index", derived.filler(F.col("pay")).alias("reassembled_forward"))
    return anon.anonymize_payloads(p, anon.Policy(payload_mode="truncate_to", truncate_to=4)).select("packet_index", F.length("reassembled_forward").alias("kept"))


@query(QUERIES, packets_sql("SELECT count(*) AS flows, CAST(sum(n) AS BIGINT) AS packets FROM (SELECT count(*) AS n FROM k GROUP BY ka, kb, pa, pb)", K))
def anon_flows(spark, sf):
    """A whole policy over conversations: nothing is lost or merged."""
    c = flow.conversations(derived.plain_tcp_frames(spark, sf).select("packet_index", "ts_ns", "frame"), flow.FlowConfig(packet_indices=False))
    return anon.anonymize_flows(c, anon.Policy.ml_optimized(seed=3)).agg(F.count("*").alias("flows"), F.sum("total_packets").alias("packets"))


@query(QUERIES, packets_sql(f"SELECT {SRC}, {DST}, pa AS src_port, pb AS dst_port, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes, count(*) FILTER (fwd) AS forward_packets FROM k GROUP BY ka, kb, pa, pb", K))
def stream_flow_stats(spark, sf):
    """The events read as a stream, through frames and dissection, to running flow totals."""
    from wirelark.streaming import flows as live

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, sf))
    p = derived.framed(derived.abstract_packets(files))
    table = f"flows_{uuid.uuid4().hex}"
    live.run_once(live.running_stats(flow.packets(p.select("packet_index", "ts_ns", "frame"))), table, "complete", folder(spark))
    return named(spark.table(table)).select("src_addr", "dst_addr", "src_port", "dst_port", "packets", "bytes", "forward_packets")


def _stream_folder(spark, sf: str) -> str:
    """A folder of the events to stream from: the driver's file is read and written once to the shared place."""
    path = folder(spark)
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(path)
    return path


@query(QUERIES, packets_sql(f"SELECT {quad('src_ip')} AS src, count(*) AS packets FROM p GROUP BY src_ip ORDER BY packets DESC, src_ip LIMIT 10"))
def topk_talkers(spark, sf):
    p = derived.packets(spark, sf)
    return p.groupBy("src_ip").agg(F.count("*").alias("packets")).orderBy(F.desc("packets"), "src_ip").limit(10).select(ip4_long(F.col("src_ip")).alias("src"), "packets")
