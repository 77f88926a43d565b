"""Queries over application layers, nested records, bindings and pseudonyms, each from frames built of event columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.functions import bytesx as B
from wirelark.functions import hpack, walkers, x509
from wirelark.operators import anonymize as anon
from wirelark.operators import build
from wirelark.operators import dissect as dis
from wirelark.operators.bindings import Bindings
from wirelark.plans import derived
from wirelark.plans.base import packets_sql, quad, query

QUERIES: dict = {}
EVENT_MAC = "'02:00:00:00:' || lpad(lower(hex((user_id >> 8) & 255)), 2, '0') || ':' || lpad(lower(hex(user_id & 255)), 2, '0')"


def event_ids() -> tuple[Column, Column]:
    """event_id and user_id; made on use, as columns need a session."""
    return F.col("event_id"), F.col("user_id")


def over_udp(df: DataFrame, body: Column, sport: int, dport: int, *keep: str) -> DataFrame:
    return df.withColumn("_b", body).select(*keep, build.ethernet(build.ipv4(build.udp(F.col("_b"), 1, 2, sport, dport, with_checksum=False), 1, 2, 17)).alias("frame"))


def over_tcp(df: DataFrame, body: Column, sport: int, dport: int, *keep: str) -> DataFrame:
    return df.withColumn("_b", body).select(*keep, build.ethernet(build.ipv4(build.tcp(F.col("_b"), 1, 2, sport, dport, flags=24, with_checksum=False), 1, 2, 6)).alias("frame"))


def payload() -> Column:
    return B.take(F.col("frame"), F.col("payload_start"), F.length("frame"))


@query(QUERIES, f"SELECT event_id, 1 AS op, event_id % 4294967296 AS xid, {EVENT_MAC} AS chaddr, 1 + event_id % 8 AS msg_type, {quad('167772160 + user_id')} AS requested_ip, 3600 + event_id % 100 AS lease_time FROM events")
def dhcp_fields(spark, sf):
    e, u = event_ids()
    options = {53: B.put(1 + e % 8, 1), 50: B.put(u + 167772160, 4), 51: B.put(3600 + e % 100, 4)}
    body = build.dhcp(1, e % 4294967296, F.concat(B.raw("02000000"), B.put(u, 2)), options)
    d = dis.dissect(over_udp(derived.events(spark, sf), body, 68, 67, "event_id"), ["dhcp"])
    return d.select("event_id", "dhcp.op", "dhcp.xid", "dhcp.chaddr", "dhcp.msg_type", "dhcp.requested_ip", "dhcp.lease_time")


@query(QUERIES, "SELECT event_id, 'DNP3' AS app, event_id % 65520 AS dst, user_id % 1000 AS src, event_id % 64 AS transport_seq, event_id % 16 AS app_seq, 1 + event_id % 5 AS app_func FROM events")
def dnp3_fields(spark, sf):
    e, u = event_ids()
    body = F.concat(B.put(0xC0 + e % 64, 1), B.put(0xC0 + e % 16, 1), B.put(1 + e % 5, 1))
    d = dis.dissect(over_tcp(derived.events(spark, sf), build.dnp3(0xC4, e % 65520, u % 1000, body), 40000, 20000, "event_id"), ["dnp3"])
    return d.select("event_id", "app", "dnp3.dst", "dnp3.src", "dnp3.transport_seq", "dnp3.app_seq", "dnp3.app_func")


@query(QUERIES, "SELECT event_id, 2 AS version, event_id % 65536 AS tunnel_id, user_id % 65536 AS session_id FROM events")
def l2tp_fields(spark, sf):
    e, u = event_ids()
    d = dis.dissect(over_udp(derived.events(spark, sf), build.l2tp(e % 65536, u % 65536, B.raw("FF03")), 1701, 1701, "event_id"), ["l2tp"])
    return d.select("event_id", "l2tp.version", "l2tp.tunnel_id", "l2tp.session_id")


@query(QUERIES, "SELECT event_id, 'QUIC' AS app, 1 AS version, 2 AS long_packet_type, lower(lpad(hex(event_id), 16, '0')) AS dcid, lower(lpad(hex(user_id), 8, '0')) AS scid FROM events")
def quic_fields(spark, sf):
    e, u = event_ids()
    body = build.quic_long(2, 1, F.concat(B.put(0, 4), B.put(e, 4)), B.put(u, 4), B.raw("0401020304"))
    d = dis.dissect(over_udp(derived.events(spark, sf), body, 40000, 443, "event_id"), ["quic"])
    return d.select("event_id", "app", "quic.version", "quic.long_packet_type", B.hexstr(F.col("quic.dst_conn_id")).alias("dcid"), B.hexstr(F.col("quic.src_conn_id")).alias("scid"))


@query(QUERIES, "SELECT event_id, 'PADDING,PING,CRYPTO,STREAM' AS frames, 12 + event_id % 40 AS bytes FROM events")
def quic_frame_list(spark, sf):
    """Cleartext frames: padding, a ping, a CRYPTO frame of 12 bytes and a STREAM frame that fills up."""
    e, _ = event_ids()
    body = F.concat(B.raw("000000" + "01" + "06000C" + "AA" * 12 + "0805"), F.repeat(F.lit("s"), (e % 40).cast("int")).cast("binary"))
    made = derived.events(spark, sf).select("event_id", walkers.quic_frames(body).alias("f"))
    data = F.aggregate(F.filter("f", lambda x: x["frame"].isin("CRYPTO", "STREAM")), F.lit(0).cast("bigint"), lambda a, x: a + x["length"])
    return made.select("event_id", F.array_join(F.transform("f", lambda x: x["frame"]), ",").alias("frames"), data.alias("bytes"))


@query(QUERIES, "SELECT event_id, 'SSH' AS app, 'SSH-2.0-client_' || user_id AS banner FROM events")
def ssh_banners(spark, sf):
    _, u = event_ids()
    line = build.ssh_banner(F.concat(F.lit("client_"), u))
    d = dis.dissect(over_tcp(derived.events(spark, sf), line, 40000, 22, "event_id"), ["ssh"])
    return d.select("event_id", "app", F.col("ssh.version_string").alias("banner"))


HOST, PATH = "regexp_extract(url, '^https?://([^/:]+)', 1)", "coalesce(nullif(regexp_extract(url, '^https?://[^/]+(/.*)$', 1), ''), '/')"


@query(QUERIES, f"SELECT page_id, 'GET' AS method, {PATH} AS path, {HOST} AS authority, '1' AS streams FROM pages")
def http2_requests(spark, sf):
    """Header blocks of literals and of table entries, in HTTP/2 frames behind the preface, read through HPACK."""
    host = F.regexp_extract("url", "^https?://([^/:]+)", 1)
    path = F.coalesce(F.nullif(F.regexp_extract("url", "^https?://[^/]+(/.*)$", 1), F.lit("")), F.lit("/"))
    more = lambda n: F.when(n < 128, B.put(n, 1)).otherwise(F.concat(B.put(n % 128 + 128, 1), B.put(F.floor(n / 128), 1)))
    size = lambda n: F.when(n < 127, B.put(n, 1)).otherwise(F.concat(B.put(127, 1), more(n - 127)))
    literal = lambda first, s: F.concat(B.put(first, 1), size(F.octet_length(s)), s.cast("binary"))
    block = F.concat(B.raw("8287"), literal(4, path), literal(0x41, host), B.raw("BE"))  # the last refers to the table's newest entry
    frames = F.concat(F.lit(bytearray(b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n")), B.raw("000000040000000000"), B.put(F.length(block), 3), B.raw("010500000001"), block)
    p = over_tcp(spark.read.parquet(f"{sf}/pages.parquet"), frames, 40000, 443, "page_id")
    d = dis.dissect(p).where("app = 'HTTP2'").select("page_id", hpack.http2_headers(payload()).alias("h"))
    value = lambda name: F.get(F.filter("h", lambda x: x["name"] == name), F.lit(0))["value"]
    return d.select("page_id", value(":method").alias("method"), value(":path").alias("path"), F.get(F.filter("h", lambda x: x["name"] == ":authority"), F.lit(1))["value"].alias("authority"), F.array_join(F.array_distinct(F.transform("h", lambda x: x["stream"])), ",").alias("streams"))

@query(QUERIES, "SELECT event_id, 1 + event_id % 1000 AS increment, user_id % 100 AS error_code, event_id % 2147483648 AS last_stream, 1 + event_id % 256 AS weight FROM events")
def http2_control_frames(spark, sf):
    e, u = event_ids()
    window = F.concat(B.raw("000004080000000001"), B.put(1 + e % 1000, 4))
    away = F.concat(B.raw("000008070000000000"), B.put(e % 2147483648, 4), B.put(u % 100, 4))
    priority = F.concat(B.raw("000005020000000003"), B.raw("80000001"), B.put(e % 256, 1))
    made = derived.events(spark, sf).select("event_id", hpack.http2_control(F.concat(window, away, priority)).alias("c"))
    of = lambda kind: F.get(F.filter("c", lambda x: x["type"] == kind), F.lit(0))
    return made.select("event_id", of(8)["increment"].alias("increment"), of(7)["error_code"].alias("error_code"), of(7)["last_stream"].alias("last_stream"), of(2)["weight"].alias("weight"))


def der(tag: int, body: Column) -> Column:
    """A DER element of up to 255 bytes."""
    size = lambda n: F.when(n < 128, B.put(n, 1)).otherwise(F.concat(B.put(0x81, 1), B.put(n, 1)))
    return B.let(body, lambda v: F.concat(B.put(tag, 1), size(F.length(v)), v))


@query(QUERIES, "SELECT event_id, 'host' || user_id || '.example' AS subject_cn, 'CA ' || event_id % 7 AS issuer_cn, lower(lpad(hex(event_id), 8, '0')) AS serial, '240101000000Z' AS not_before FROM events")
def tls_certificate_names(spark, sf):
    """Certificate messages built element by element, sent as TLS records and read back."""
    e, u = event_ids()
    name = lambda s: der(0x30, der(0x31, der(0x30, F.concat(B.raw("0603550403"), der(0x0C, s.cast("binary"))))))
    times = F.lit(bytearray(b"\x30\x1e\x17\x0d240101000000Z\x17\x0d250101000000Z"))
    ev = derived.events(spark, sf).select("event_id", "user_id", name(F.concat(F.lit("CA "), e % 7)).alias("i"), name(F.concat(F.lit("host"), u, F.lit(".example"))).alias("s"))
    ev = ev.withColumn("t", der(0x30, F.concat(B.raw("A003020102"), der(2, B.put(e, 4)), B.raw("300506032A8648"), F.col("i"), times, F.col("s"), B.raw("3000"))))
    ev = ev.withColumn("c", der(0x30, F.concat("t", B.raw("300506032A8648"), B.raw("030100"))))
    n = F.length("c")
    record = build.tls_record(22, F.concat(B.raw("0B"), B.put(n + 6, 3), B.put(n + 3, 3), B.put(n, 3), F.col("c")))
    d = dis.dissect(over_tcp(ev, record, 443, 40000, "event_id")).where("app = 'TLS'").select("event_id", F.get(x509.tls_certificates(payload()), F.lit(0)).alias("x"))
    return d.select("event_id", "x.subject_cn", "x.issuer_cn", "x.serial", "x.not_before")


@query(QUERIES, "SELECT event_id, '0,44,60' AS headers, 40 + 8 + 8 + 16 AS ends_at, event_id % 65536 AS ident, 129 AS icmp_type FROM events")
def ipv6_extension_chain(spark, sf):
    """Hop-by-hop, fragment and destination headers ahead of an echo reply."""
    e, u = event_ids()
    src, dst = B.raw("FD" + "00" * 14 + "01"), B.raw("FD" + "00" * 14 + "02")
    msg = build.icmpv6(src, dst, 129, 0, F.concat(B.put(e % 65536, 2), B.put(u % 65536, 2)))
    chain = F.concat(B.raw("2C00" + "00" * 6), B.raw("3C00" + "00" * 6), B.raw("3A01" + "00" * 14), msg)
    made = derived.events(spark, sf).select("event_id", build.ipv6(chain, src, dst, 0).alias("p")).withColumn("x", walkers.ipv6_extensions(F.col("p")))
    last = F.get("x", F.size("x") - 1)
    end = last["start"] + last["length"]
    return made.select("event_id", F.array_join(F.transform("x", lambda h: h["header"]), ",").alias("headers"), end.alias("ends_at"), B.uint(F.col("p"), end + 4, 2).alias("ident"), B.uint(F.col("p"), end).alias("icmp_type"))


@query(QUERIES, f"SELECT event_id, {EVENT_MAC} AS src, 3 + event_id % 40 AS len FROM events")
def dot3_frames(spark, sf):
    """802.3 frames, told from Ethernet by their length field."""
    e, u = event_ids()
    frame = build.dot3(F.concat(B.raw("424203"), F.repeat(F.lit("x"), (e % 40).cast("int")).cast("binary")), src=F.concat(B.raw("02000000"), B.put(u, 2)))
    from wirelark.operators.protocols import dot3

    return derived.events(spark, sf).select("event_id", frame.alias("frame")).select("event_id", dot3(F.col("frame")).alias("d")).where("d.len < 1536").select("event_id", "d.src", "d.len")


@query(QUERIES, "SELECT event_id, 2 AS version, 65664 + 64 * (event_id % 3) AS first_cipher, 16 AS challenge_bytes FROM events")
def sslv2_hellos(spark, sf):
    e, _ = event_ids()
    body = F.concat(B.raw("010002000300000010"), B.put(65664 + 64 * (e % 3), 3), B.raw("CC" * 16))
    made = derived.events(spark, sf).select("event_id", x509.sslv2_client_hello(F.concat(B.put(0x8000 + F.length(body), 2), body)).alias("h"))
    return made.select("event_id", "h.version", F.get("h.ciphers", F.lit(0)).alias("first_cipher"), F.length("h.challenge").alias("challenge_bytes"))


@query(QUERIES, packets_sql("SELECT coalesce(CASE dport WHEN 80 THEN 'HTTP' WHEN 443 THEN 'TLS' WHEN 53 THEN 'DNS' WHEN 22 THEN 'Shell' WHEN 8080 THEN NULL END, 'unbound') AS upper, count(*) AS packets FROM p GROUP BY 1"))
def layer_bindings(spark, sf):
    """Next layers of dissected frames by the bindings registry: one added, one of the defaults replaced (HTTP on port 80 alone)."""
    known = Bindings()
    known.register("TCP", "Shell", "dport", 22)
    known.register("TCP", "HTTP", "dport", 80)
    d = dis.dissect(derived.plain_tcp_frames(spark, sf)).select("tcp.dport")
    bound = known.dimension(spark).where("lower = 'TCP' AND field = 'dport'").select(F.col("value").alias("dport"), "upper")
    return d.join(F.broadcast(bound), "dport", "left").groupBy(F.coalesce("upper", F.lit("unbound")).alias("upper")).agg(F.count("*").alias("packets"))


@query(QUERIES, packets_sql("SELECT packet_index, CASE dport WHEN 80 THEN 'HTTP' WHEN 8080 THEN 'HTTP' WHEN 443 THEN 'TLS' WHEN 53 THEN 'DNS' END AS upper, 'IPv4' AS above_ethernet, 'TCP' AS above_ip FROM p"))
def next_layers(spark, sf):
    """Next layers by the default bindings, as Columns."""
    known = Bindings()
    d = dis.dissect(derived.plain_tcp_frames(spark, sf).select("packet_index", "frame"))
    return d.select("packet_index", known.next_layer("TCP", "dport", F.col("tcp.dport")).alias("upper"), known.next_layer("Ethernet", "type", F.col("ether.type")).alias("above_ethernet"), known.next_layer("IPv4", "proto", F.col("ipv4.proto")).alias("above_ip"))


@query(QUERIES, "SELECT event_id, 128 - CAST(floor(log2(1 + event_id % 1000)) AS INT) - 1 AS shared_bits FROM events")
def anon_cryptopan_v6(spark, sf):
    """Pseudonyms of two IPv6 addresses share as many leading bits as the addresses."""
    e, u = event_ids()
    wide = lambda low: F.concat(B.raw("FD00000000000000"), B.put(0, 4), B.put(low, 4))
    other = u.bitwiseXOR(1 + e % 1000)
    p = derived.events(spark, sf).select("event_id", wide(u).alias("a"), wide(other).alias("b"))
    q = anon.anonymize_addresses(p, ["a", "b"], bytes(range(32)))
    words = [B.uint(F.col("a"), 4 * i, 4).bitwiseXOR(B.uint(F.col("b"), 4 * i, 4)) for i in range(4)]
    shared = F.lit(128)
    for i, w in reversed(list(enumerate(words))):
        shared = F.when(w != 0, 32 * i + 31 - F.floor(F.log2(w))).otherwise(shared)
    return q.select("event_id", shared.cast("int").alias("shared_bits"))


@query(QUERIES, "SELECT event_id, 1 + event_id % 5000 AS sent, true AS masked FROM events")
def anon_sequence_offsets(spark, sf):
    """Sequence numbers shifted by an offset of each flow's direction keep their distances."""
    e, u = event_ids()
    start = (e * 7919) % 4294967296
    p = derived.events(spark, sf).select("event_id", u.alias("addr_a"), F.lit(1).alias("addr_b"), start.alias("initial_seq_fwd"), ((start + 1 + e % 5000) % 4294967296).alias("next_seq_fwd"), start.alias("was"))
    q = anon.anonymize_sequences(p, 5)
    return q.select("event_id", F.pmod(F.col("next_seq_fwd") - F.col("initial_seq_fwd"), F.lit(4294967296)).alias("sent"), (F.col("initial_seq_fwd") != F.col("was")).alias("masked"))


@query(QUERIES, f"SELECT event_id, '02:00:00' AS oui, lower(substr(sha256(unhex('73616C74020000' || '00' || lpad(hex(user_id & 65535), 4, '0'))), 1, 6)) AS low FROM events")
def anon_mac_hash(spark, sf):
    """The lower half of a MAC as a salted hash, its upper half kept."""
    _, u = event_ids()
    mac = F.concat(B.raw("02000000"), B.put(u, 2))
    h = anon.mac_hash(mac, b"salt", keep_oui=True)
    return derived.events(spark, sf).select("event_id", B.hexstr(B.take(h, 0, 3), ":").alias("oui"), B.hexstr(B.take(h, 3, 3)).alias("low"))


ROUTE = """SELECT packet_index, CASE WHEN d >> 24 = 127 THEN 'lo' WHEN d = 4294967295 OR d >> 28 = 14 THEN 'eth0' WHEN d >> 16 = 2561 THEN 'eth1' WHEN d >> 8 = 655360 THEN 'eth0' ELSE 'eth0' END AS interface,
  CASE WHEN d >> 24 = 127 OR d = 4294967295 OR d >> 28 = 14 OR d >> 16 = 2561 OR d >> 8 = 655360 THEN d ELSE 167772161 END AS next_hop, d >> 24 = 127 OR d = 4294967295 OR d >> 28 = 14 OR d >> 16 = 2561 OR d >> 8 = 655360 AS is_local
  FROM (SELECT packet_index, CASE event_id % 5 WHEN 0 THEN 2130706433 WHEN 1 THEN 4294967295 WHEN 2 THEN 3758096384 + user_id ELSE dst_ip END AS d FROM p)"""


@query(QUERIES, packets_sql(f"SELECT packet_index, interface, next_hop, is_local, CASE WHEN next_hop = 4294967295 THEN 'ff:ff:ff:ff:ff:ff' WHEN next_hop = 167772161 THEN '02:00:00:00:00:01' END AS mac FROM ({ROUTE}) WHERE next_hop >> 28 <> 14 UNION ALL SELECT packet_index, interface, next_hop, is_local, '01:00:5e:' || concat_ws(':', lpad(lower(hex((next_hop >> 16) & 127)), 2, '0'), lpad(lower(hex((next_hop >> 8) & 255)), 2, '0'), lpad(lower(hex(next_hop & 255)), 2, '0')) FROM ({ROUTE}) WHERE next_hop >> 28 = 14"))
def interface_selection(spark, sf):
    """The way out of a host for loopback, broadcast, multicast, local and remote destinations, and the MAC to send to."""
    from wirelark.operators import pairing

    known = [("lo", 2130706432, 8, 0, True, True), ("eth9", 167837696, 16, 1, False, False), ("eth0", 167772160, 24, 2, True, False), ("eth1", 167837696, 16, 3, True, False)]
    interfaces = spark.createDataFrame(known, "name string, net bigint, prefix int, route_order int, up boolean, loopback boolean")
    neighbours = spark.createDataFrame([(167772161, "02:00:00:00:00:01")], "ip bigint, mac string")
    e, u = event_ids()
    dst = F.when(e % 5 == 0, 2130706433).when(e % 5 == 1, 4294967295).when(e % 5 == 2, 3758096384 + u).otherwise(F.col("dst_ip"))
    p = derived.packets(spark, sf).select("packet_index", dst.cast("bigint").alias("dst_ip"))
    return pairing.destination_macs(pairing.interface_routes(p, interfaces, 167772161), neighbours).select("packet_index", "interface", "next_hop", "is_local", "mac")
