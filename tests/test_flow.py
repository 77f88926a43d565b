import random
import struct

import pytest
from pyspark.sql import functions as F

from wirelark.functions.bytesx import put
from wirelark.operators import anonymize as anon
from wirelark.operators import build, flow, pairing
from wirelark.operators.reassembly import Stream, reassemble
from wirelark.sources import pcap
from wirelark.streaming import flows as live

A, Z = 0x0A000001, 0x0A000002
FLAG = {"S": 2, "SA": 18, "A": 16, "FA": 17, "R": 4, "PA": 24, "F": 1}


def frames(spark, rows):
    """rows: (outbound, flags, seq, payload)"""
    df = spark.createDataFrame([(i, i * 10**9, o, FLAG[f], s, bytearray(p)) for i, (o, f, s, p) in enumerate(rows)], "packet_index long, ts_ns long, o boolean, f int, s long, p binary")
    side = lambda a, b: F.when(F.col("o"), a).otherwise(b)
    seg = build.tcp(F.col("p"), side(A, Z), side(Z, A), side(40000, 80), side(80, 40000), F.col("s"), 0, F.col("f"), with_checksum=False)
    return df.select("packet_index", "ts_ns", build.ethernet(build.ipv4(seg, side(A, Z), side(Z, A), 6)).alias("frame"))


SHAKE = [(True, "S", 100, b""), (False, "SA", 500, b""), (True, "A", 101, b"")]


@pytest.mark.parametrize(
    "rows,state,status",
    [(SHAKE, "ESTABLISHED", "Active"), (SHAKE[:1], "SYN_SENT", "Active"), ([SHAKE[0], (False, "R", 0, b"")], "CLOSED", "Closed"), ([*SHAKE, (True, "FA", 101, b"")], "FIN_WAIT_1", "HalfClosed"), ([*SHAKE, (True, "FA", 101, b""), (False, "A", 501, b"")], "FIN_WAIT_2", "HalfClosed"), ([*SHAKE, (True, "FA", 101, b""), (False, "A", 501, b""), (False, "FA", 501, b"")], "TIME_WAIT", "Closed"), ([(True, "PA", 5, b"x")] * 3, "LISTEN", "Active")],
)
def test_states(spark, rows, state, status):
    r = flow.conversations(frames(spark, rows)).collect()
    assert len(r) == 1 and (r[0].tcp_state, r[0].status, r[0].packet_indices) == (state, status, list(range(len(rows))))


def test_stretches_agree_with_one_fold(spark):
    random.seed(4)
    rows = [(random.random() < 0.5, random.choice(list(FLAG)), 1, b"") for _ in range(200)]
    rows = [r if r[1] != "R" else (r[0], "A", 1, b"") for r in rows]
    p = flow.packets(frames(spark, rows))
    assert {flow.tcp_states(p, n).first().tcp_state for n in (1, 7, 10_000)} == {flow.tcp_states(p).first().tcp_state}


def test_reassembled_stream(spark):
    rows = [*SHAKE, (True, "PA", 106, b"world"), (True, "PA", 101, b"hello"), (False, "PA", 501, b"ok"), (True, "PA", 103, b"llowo")]
    r = flow.conversations(frames(spark, rows), flow.FlowConfig(reassemble=True)).first()
    assert (bytes(r.reassembled_forward), bytes(r.reassembled_reverse), r.dropped_segments) == (b"helloworld", b"ok", 0)


def test_stream_rules():
    s = Stream(2, 100)
    s.expected = 10
    assert s.add(20, b"b") and s.add(30, b"c") and not s.add(40, b"d") and s.add(5, b"abcde") and s.add(8, b"xxyy") and bytes(s.done) == b"yy"
    w = Stream(5, 100)
    w.expected = 2**32 - 2
    assert w.add(2**32 - 2, b"abcd") and bytes(w.done) == b"abcd" and w.expected == 2
    assert reassemble([], 1, 1) == (None, None, 0, 0)


def test_icmp_and_v6_flows(spark):
    src, dst = b"\xfd" + bytes(14) + b"\x02", b"\xfd" + bytes(14) + b"\x01"
    echo = lambda kind, a, b: build.ethernet(build.ipv6(build.icmpv6(F.lit(bytearray(a)), F.lit(bytearray(b)), kind, 0, F.concat(put(7, 2), put(kind, 2))), F.lit(bytearray(a)), F.lit(bytearray(b)), 58), 0x86DD)
    df = spark.range(2).select(F.col("id").alias("packet_index"), F.col("id").alias("ts_ns"), F.when(F.col("id") == 0, echo(128, src, dst)).otherwise(echo(129, dst, src)).alias("frame"))
    r = flow.conversations(df).collect()
    assert len(r) == 1 and (r[0].src_addr, r[0].dst_addr, r[0].protocol, r[0].icmp_identifier, r[0].icmp_request_count, r[0].icmp_reply_count, r[0].reverse_packets) == ("fd00::1", "fd00::2", "ICMPv6", 7, 1, 1, 1)


def test_short_frames_are_skipped_or_fail(spark):
    df = spark.createDataFrame([(0, 0, bytearray(5))], "packet_index long, ts_ns long, frame binary")
    assert flow.conversations(df).count() == 0
    with pytest.raises(Exception, match="not parsed"):
        flow.packets(df, on_unparsed="fail").collect()


def test_idle_boundary(spark):
    c = flow.conversations(frames(spark, SHAKE[:1]))
    assert flow.evict_idle(c, 5_000_000_000).count() == 1 and flow.evict_idle(c, 5_000_000_001).count() == 0


@pytest.mark.parametrize("order,magic,unit", [("<", 0xA1B2C3D4, 1000), (">", 0xA1B2C3D4, 1000), ("<", 0xA1B23C4D, 1), (">", 0xA1B23C4D, 1)])
def test_capture_magics_and_cut_tail(spark, tmp_path, order, magic, unit):
    body = struct.pack(order + "I2Hi3I", magic, 2, 4, 0, 0, 65535, 1) + struct.pack(order + "4I", 3, 5, 2, 60) + b"ab" + struct.pack(order + "4I", 4, 0, 9, 9) + b"cut"
    (tmp_path / "x.pcap").write_bytes(body)
    r = pcap.read_capture(spark, str(tmp_path / "x.pcap")).collect()
    assert len(r) == 1 and (r[0].ts_ns, r[0].orig_len, bytes(r[0].frame), r[0].link_type) == (3 * 10**9 + 5 * unit, 60, b"ab", 1)


def test_capture_modes_and_stretches(spark, tmp_path):
    (tmp_path / "bad.pcap").write_bytes(b"nope")
    assert pcap.read_capture(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no capture"):
        pcap.read_capture(spark, str(tmp_path), mode="FAILFAST").count()
    data = pcap.pcap_header() + b"".join(pcap.pcap_record(i * 1000, 10, b"x" * 10) for i in range(100))
    (tmp_path / "bad.pcap").write_bytes(data)
    r = spark.read.format("pcap").option("stretchBytes", 500).load(str(tmp_path))
    assert r.rdd.getNumPartitions() > 3 and sorted(x.packet_index for x in r.collect()) == list(range(100))


def test_pcapng_blocks(spark, tmp_path):
    data = pcap.pcapng_header(nanoseconds=True) + pcap.pcapng_record(1_000_000_007, 99, b"abc", True) + struct.pack("<IIII", 3, 20, 4, 0x64636261) + struct.pack("<I", 20)
    (tmp_path / "x.pcapng").write_bytes(data)
    r = pcap.read_capture(spark, str(tmp_path / "x.pcapng")).orderBy("packet_index").collect()
    assert [(x.ts_ns, x.orig_len, bytes(x.frame)) for x in r] == [(1_000_000_007, 99, b"abc"), (0, 4, b"abcd")]


def test_policy_checks():
    for bad in ({"ip_mode": "x"}, {"crypto_pan_key": b"short"}, {"port_mode": "all"}):
        with pytest.raises(ValueError):
            anon.Policy(**bad)
    with pytest.raises(ValueError):
        flow.FlowConfig(on_unparsed="x")


def test_address_pseudonyms(spark):
    df = spark.createDataFrame([(bytearray([10, 0, 0, i]), bytearray(bytes([0xFD]) + bytes(14) + bytes([i]))) for i in range(8)], "a binary, b binary")
    key = bytes(range(32))
    r = anon.anonymize_addresses(df, ["a", "b"], key).collect()
    assert len({bytes(x.a)[:3] for x in r}) == 1 and len({bytes(x.a) for x in r}) == 8 and len({bytes(x.b)[:15] for x in r}) == 1
    again = anon.anonymize_addresses(df, ["a"], key).collect()
    other = anon.anonymize_addresses(df, ["a"], bytes(32)).collect()
    assert {bytes(x.a) for x in again} == {bytes(x.a) for x in r} != {bytes(x.a) for x in other}


def test_durations_survive_a_shift(spark):
    c = flow.conversations(frames(spark, SHAKE))
    a = anon.anonymize_flows(c, anon.Policy.ml_optimized(seed=1)).first()
    assert a.duration == c.first().duration and a.start_ns != c.first().start_ns and a.dst_port in (80, 49152, 0, 1024)


def test_neighbour_ttl(spark):
    claims = spark.createDataFrame([(1, 0, "aa")], "ip long, ts_ns long, mac string")
    asks = spark.createDataFrame([(1, 120_000_000_000, 0), (1, 120_000_000_001, 1)], "ip long, ts_ns long, packet_index long")
    assert [r.mac for r in pairing.neighbours_asof(asks, claims).orderBy("packet_index").collect()] == ["aa", None]


def test_stream_emits_idle_flows(spark, tmp_path):
    later = frames(spark, [*SHAKE]).unionByName(frames(spark, [(True, "S", 1, b"")]).select(F.lit(9).cast("long").alias("packet_index"), F.lit(10**15).alias("ts_ns"), "frame"))
    later.select("packet_index", "ts_ns", "frame").coalesce(1).sortWithinPartitions("packet_index").write.parquet(str(tmp_path / "in"))
    p = flow.packets(spark.readStream.schema("packet_index long, ts_ns long, frame binary").parquet(str(tmp_path / "in")))
    live.run_once(live.running_stats(p), "running", "complete", str(tmp_path / "c1"))
    assert spark.table("running").first().packets == 4
    live.run_once(live.windowed_stats(p), "windows", "append", str(tmp_path / "c2"))
    live.run_once(live.tracked_flows(p), "tracked", "append", str(tmp_path / "c3"))
    assert spark.table("windows").count() >= 1 and spark.table("tracked").count() <= 1


def test_sniffer_stops_where_told(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap.pcap_header() + b"".join(pcap.pcap_record(i, 60, bytes([i]) * 60) for i in range(5)))
    seen = live.sniff(spark, str(tmp_path), str(tmp_path / "cp"), stop_filter=lambda r: r.packet_index == 2)
    assert [r.packet_index for r in seen] == [0, 1, 2]
