"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelark.functions import bytesx as B
from wirelark.functions import checksum as ck
from wirelark.functions import net
from wirelark.operators import build
from wirelark.plans import derived
from wirelark.plans.base import packets_sql, quad, query

QUERIES: dict = {}


def events(spark: SparkSession, sf: str) -> DataFrame:
    return derived.packets(spark, sf)


WORDS = "(17664 + {len} + {id} + 0 + (64 * 256 + {proto}) + (src_ip >> 16) + (src_ip & 65535) + (dst_ip >> 16) + (dst_ip & 65535))"
FOLD = "(65535 - ((({w}) & 65535) + (({w}) >> 16)))"


@query(QUERIES, packets_sql(f"SELECT event_id, {FOLD.format(w=WORDS.format(len='40 + pay', id='event_id % 65536', proto=6))} AS checksum, true AS valid FROM p"))
def ipv4_header_checksum(spark, sf):
    d = derived.plain_tcp_frames(spark, sf)
    head = B.take(F.col("frame"), 14, 20)
    return d.select("event_id", ck.ipv4_checksum(head).alias("checksum"), ck.verify_ipv4_checksum(head).alias("valid"))


@query(QUERIES, packets_sql("""SELECT event_id, CASE WHEN c = 0 THEN 65535 ELSE c END AS checksum, true AS valid FROM (SELECT event_id, 65535 - ((s & 65535) + (s >> 16)) AS c FROM (
  SELECT event_id, (src_ip >> 16) + (src_ip & 65535) + (dst_ip >> 16) + (dst_ip & 65535) + 17 + 2 * (8 + pay % 64) + sport + dport + 30840 * ((pay % 64) // 2) + CASE WHEN (pay % 64) % 2 = 1 THEN 30720 ELSE 0 END AS s FROM p)
  )""".replace("65535 - ((s & 65535) + (s >> 16))", "65535 - ((((s & 65535) + (s >> 16)) & 65535) + (((s & 65535) + (s >> 16)) >> 16))")))
def udp_checksum(spark, sf):
    d = derived.udp_frames(spark, sf)
    b = F.col("frame")
    src, dst, gram = B.take(b, 26, 4), B.take(b, 30, 4), B.take(b, 34, F.length(b))
    return d.select("event_id", ck.udp_checksum(src, dst, gram).alias("checksum"), ck.verify_udp_checksum(src, dst, gram).alias("valid"))


@query(QUERIES, packets_sql("SELECT event_id, true AS tcp_valid FROM p"))
def tcp_checksum(spark, sf):
    b = F.col("frame")
    return derived.tcp_frames(spark, sf).select("event_id", ck.verify_tcp_checksum(B.take(b, 26, 4), B.take(b, 30, 4), B.take(b, 34, F.length(b))).alias("tcp_valid"))


@query(QUERIES, packets_sql("SELECT event_id, true AS same, true AS same32 FROM p"))
def checksum_incremental(spark, sf):
    """An updated checksum equals the one computed afresh after a TTL and an address change."""
    d = derived.plain_tcp_frames(spark, sf)
    head = B.take(F.col("frame"), 14, 20)
    old = B.uint(head, 8, 2)
    changed = F.concat(B.take(head, 0, 8), B.put(old - 256, 2), B.take(head, 10, 10))
    moved = F.concat(B.take(head, 0, 12), B.put(F.col("dst_ip"), 4), B.take(head, 16, 4))
    c = B.uint(head, 10, 2)
    return d.select("event_id", (ck.incremental_update(c, old, old - 256) == ck.ipv4_checksum(changed)).alias("same"), (ck.incremental_update_32(c, F.col("src_ip"), F.col("dst_ip")) == ck.ipv4_checksum(moved)).alias("same32"))


def crc_sql(poly: int, init: int, out: int) -> str:
    """A reflected 16-bit CRC of the byte list l: a fold over the table that the polynomial gives."""
    table = ck.reflected_table(poly).tolist()
    return f"xor(list_reduce(l, lambda c, x: xor(c >> 8, {table}[(xor(c, x) & 255) + 1]::BIGINT), {init}::BIGINT), {out}::BIGINT)"


BYTES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ((instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)::BIGINT)"
#: A CRC-32 is a fold as well, of 32 bits.
CRC32 = f"xor(list_reduce(l, lambda c, x: xor(c >> 8, {ck.reflected_table(0xEDB88320).tolist()}[(xor(c, x) & 255) + 1]::BIGINT), 4294967295::BIGINT), 4294967295::BIGINT)"


@query(QUERIES, f"SELECT doc_id, {crc_sql(0xA001, 0xFFFF, 0)} AS modbus, {crc_sql(0x8408, 0, 0)} AS kermit, {crc_sql(0xA6BC, 0, 0xFFFF)} AS dnp3, {CRC32} AS crc32 FROM (SELECT doc_id, {BYTES} AS l FROM documents)")
def crc16_families(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    b = F.col("text").cast("binary")
    return docs.select("doc_id", ck.modbus_crc16(b).alias("modbus"), ck.ccitt_kermit(b).alias("kermit"), ck.dnp3_crc(b).alias("dnp3"), ck.crc32_ieee(b).alias("crc32"))


@query(QUERIES, "SELECT c_custkey, (256 - s % 256) % 256 AS lrc, true AS lrc_valid, x AS zwave_sum FROM (SELECT c_custkey, list_sum(l)::BIGINT AS s, list_reduce(l, lambda a, y: xor(a, y), 255::BIGINT) AS x FROM (SELECT c_custkey, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT) AS l FROM customer))")
def byte_sums(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    b = F.col("c_name").cast("binary")
    lrc = ck.modbus_lrc(b)
    return c.select("c_custkey", lrc.alias("lrc"), ck.verify_modbus_lrc(F.concat(b, B.put(lrc, 1))).alias("lrc_valid"), ck.zwave_checksum(b).alias("zwave_sum"))


@query(QUERIES, packets_sql(f"""SELECT event_id, {quad('src_ip')} AS src, {quad('src_ip & (4294967295 - ((1::BIGINT << (32 - pl)) - 1))')} AS network, {quad('src_ip | ((1::BIGINT << (32 - pl)) - 1)')} AS broadcast,
  CASE WHEN pl = 32 THEN 0 WHEN pl = 31 THEN 1 ELSE (1::BIGINT << (32 - pl)) - 2 END AS hosts, pl AS prefix FROM (SELECT *, 8 + event_id % 25 AS pl FROM p)"""))
def cidr_math(spark, sf):
    p = events(spark, sf).withColumn("pl", (8 + F.col("event_id") % 25).cast("int"))
    ip, pl = F.col("src_ip"), F.col("pl")
    return p.select("event_id", B.ip4_long(ip).alias("src"), B.ip4_long(net.network(ip, pl)).alias("network"), B.ip4_long(net.broadcast_address(ip, pl)).alias("broadcast"), net.host_count(pl).alias("hosts"), net.mask_prefix(net.prefix_mask(pl)).alias("prefix"))


@query(QUERIES, "SELECT event_id, CASE WHEN t <= 32 THEN 32 WHEN t <= 64 THEN 64 WHEN t <= 128 THEN 128 ELSE 255 END AS origin, CASE WHEN t <= 32 THEN 32 WHEN t <= 64 THEN 64 WHEN t <= 128 THEN 128 ELSE 255 END - t AS hops FROM (SELECT event_id, event_id % 256 AS t FROM events)")
def ttl_hops(spark, sf):
    t = (F.col("event_id") % 256).cast("int")
    return events(spark, sf).select("event_id", net.original_ttl(t).alias("origin"), net.hops(t).alias("hops"))


@query(QUERIES, "SELECT l_orderkey, l_linenumber, port, CASE WHEN port <= 1023 THEN 'well_known' WHEN port <= 49151 THEN 'registered' ELSE 'dynamic' END AS class, CASE WHEN port <= 1023 THEN 0 WHEN port <= 49151 THEN 1024 ELSE 49152 END AS general FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 7919 + l_suppkey) % 65536 AS port FROM lineitem)")
def port_category(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    port = (F.col("l_partkey") * 7919 + F.col("l_suppkey")) % 65536
    return li.select("l_orderkey", "l_linenumber", port.alias("port"), net.port_class(port).alias("class"), net.generalize_port(port, F.lit(False)).alias("general"))


SERVICE_SQL = ", ".join(f"({p}, '{n}')" for p, n in net.SERVICES.items())


@query(QUERIES, packets_sql("SELECT event_id, coalesce(n, 'unknown') AS service FROM p LEFT JOIN s ON s.port = p.b_port", f"s(port, n) AS (VALUES {SERVICE_SQL})"))
def service_lookup(spark, sf):
    """Lookup join with the small services dimension."""
    dim = net.dimension(spark, net.SERVICES, "port", "n")
    p = events(spark, sf)
    return p.join(F.broadcast(dim), p.b_port == dim.port, "left").select("event_id", F.coalesce("n", F.lit("unknown")).alias("service"))


PROTO_SQL = ", ".join(f"({p}, '{n}')" for p, n in net.PROTOCOLS.items())


@query(QUERIES, f"SELECT event_id, n AS proto_name, x AS back FROM (SELECT event_id, event_id % 140 AS x FROM events) JOIN (VALUES {PROTO_SQL}) AS t(no, n) ON no = x")
def proto_lookup(spark, sf):
    x = (F.col("event_id") % 140).cast("int")
    d = events(spark, sf).select("event_id", net.named(x, net.PROTOCOLS).alias("proto_name"))
    return d.where("proto_name is not null").withColumn("back", net.numbered(F.col("proto_name"), net.PROTOCOLS))


@query(QUERIES, "SELECT event_id, concat(" + ", ".join(f"CASE WHEN (f >> {i}) & 1 = 1 THEN '{c}' ELSE '' END" for i, c in enumerate(net.TCP_FLAGS)) + ") AS flags, f AS back FROM (SELECT event_id, event_id % 512 AS f FROM events)")
def tcp_flags_text(spark, sf):
    f = (F.col("event_id") % 512).cast("int")
    d = events(spark, sf).select("event_id", net.flags_text(f).alias("flags"))
    return d.withColumn("back", net.flags_bits(F.col("flags")))


@query(QUERIES, "SELECT event_id, (f & 2) != 0 AND (f & 16) = 0 AS syn, (f & 18) = 18 AS syn_ack, (f & 16) != 0 AND (f & 7) = 0 AS pure_ack, (f & 192) != 0 AS ecn FROM (SELECT event_id, event_id % 512 AS f FROM events)")
def tcp_flag_tests(spark, sf):
    f = (F.col("event_id") % 512).cast("int")
    return events(spark, sf).select("event_id", net.is_syn(f).alias("syn"), net.is_syn_ack(f).alias("syn_ack"), net.is_pure_ack(f).alias("pure_ack"), net.is_ecn(f).alias("ecn"))


@query(QUERIES, "SELECT o_orderkey, v, CASE WHEN v < 64 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 1073741824 THEN 4 ELSE 8 END AS size FROM (SELECT o_orderkey, (o_orderkey * 7919) % (1::BIGINT << CAST(o_orderkey % 60 AS INT) + 1) AS v FROM orders)")
def varint_quic(spark, sf):
    v = (F.col("o_orderkey") * 7919) % F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("o_orderkey") % 60 + 1).cast("int"))
    d = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", v.alias("x")).withColumn("b", net.put_quic_varint(F.col("x")))
    return d.select("o_orderkey", net.quic_varint(F.col("b")).cast("bigint").alias("v"), F.length("b").alias("size"))


@query(QUERIES, "SELECT o_orderkey, v, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 ELSE 4 END AS size FROM (SELECT o_orderkey, (o_orderkey * 7919) % (1::BIGINT << CAST(o_orderkey % 27 AS INT) + 1) AS v FROM orders)")
def varint_mqtt(spark, sf):
    v = (F.col("o_orderkey") * 7919) % F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("o_orderkey") % 27 + 1).cast("int"))
    d = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", v.alias("x")).withColumn("b", net.put_mqtt_length(F.col("x")))
    r = net.mqtt_length(F.col("b"), 0)
    return d.select("o_orderkey", r["value"].alias("v"), r["size"].alias("size"))


@query(QUERIES, "SELECT doc_id, lower(hex(encode(text))) AS hexed, true AS same FROM documents")
def hex_roundtrip(spark, sf):
    b = F.col("text").cast("binary")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", B.hexstr(b).alias("hexed"), (B.parse_hex(B.hexstr(b, ":")) == b).alias("same"))


LINE = "lpad(lower(hex(i * 16)), 4, '0') || '  ' || rpad(lower(list_aggregate(l[16 * i + 1 : 16 * i + 16], 'string_agg', ' ')), 47, ' ') || '  ' || list_aggregate(list_transform(l[16 * i + 1 : 16 * i + 16], lambda h: CASE WHEN h BETWEEN '20' AND '7E' THEN chr((instr('0123456789ABCDEF', h[1]) - 1)::INT * 16 + instr('0123456789ABCDEF', h[2])::INT - 1) ELSE '.' END), 'string_agg', '')"


@query(QUERIES, f"SELECT item_id, coalesce(list_aggregate(list_transform(range((len(l) + 15) // 16), lambda i: {LINE}), 'string_agg', chr(10)), '') AS dump FROM (SELECT item_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM benchmark)")
def hexdump(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", B.hexdump(F.col("text").cast("binary")).alias("dump"))


@query(QUERIES, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE NULL END AS first_diff, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS diffs FROM customer")
def byte_diff(spark, sf):
    """Names against themselves, or with the first and last byte changed."""
    b = F.col("c_name").cast("binary")
    other = F.when(F.col("c_custkey") % 3 == 0, F.concat(B.put(1, 1), B.take(b, 1, F.length(b) - 2), B.put(1, 1))).otherwise(b)
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", B.first_difference(b, other).alias("first_diff"), F.size(B.differing(b, other)).alias("diffs"))


@query(QUERIES, "SELECT event_id, (x >> 5) & 7 AS high3, (x >> 2) & 15 AS mid4, x & 3 AS low2, (x >> 8) & 255 AS swapped_low FROM (SELECT event_id, event_id % 65536 AS x FROM events)")
def bit_fields(spark, sf):
    b = B.put(F.col("event_id") % 65536, 2)
    return events(spark, sf).select("event_id", B.bit_field(b, 8, 3).alias("high3"), B.bit_field(b, 10, 4).alias("mid4"), B.bit_field(b, 8, 2, msb_first=False).alias("low2"), B.uint(B.swap(b, 2), 1).alias("swapped_low"))


@query(QUERIES, "SELECT event_id, lower(concat_ws(':', '01', '00', '5e', lpad(hex((ip >> 16) & 127), 2, '0'), lpad(hex((ip >> 8) & 255), 2, '0'), lpad(hex(ip & 255), 2, '0'))) AS mac, 'multicast' AS class, ip >> 28 = 14 AS multicast FROM (SELECT event_id, 3758096384 + (event_id * 7919) % 536870912 AS ip FROM events)")
def multicast_macs(spark, sf):
    ip = F.lit(3758096384) + (F.col("event_id") * 7919) % 536870912
    mac = net.ip4_multicast_mac(ip)
    return events(spark, sf).select("event_id", B.mac_text(mac).alias("mac"), net.mac_class(mac).alias("class"), net.ip4_multicast(ip).alias("multicast"))


@query(QUERIES, "SELECT c_custkey, greatest(60, length(c_name)) AS padded, ((length(c_name) + 7) // 8) * 8 AS aligned FROM customer")
def padding(spark, sf):
    b = F.col("c_name").cast("binary")
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.length(B.ethernet_min_frame(b)).alias("padded"), B.align(F.length(b), 8).alias("aligned"))


@query(QUERIES, "SELECT page_id, host, string_split(host, '.')[1] AS first_label, length(host) + 2 AS size FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages)")
def dns_name_codec(spark, sf):
    """Host names encoded as labels and decoded again."""
    from wirelark.functions.walkers import dns_name_at

    host = F.regexp_extract("url", "^https?://([^/:]+)", 1)
    d = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", host.alias("h")).withColumn("b", build.dns_name(F.col("h")))
    return d.select("page_id", dns_name_at(F.col("b"), F.lit(0))["name"].alias("host"), F.try_element_at(F.split(F.col("h"), r"\."), F.lit(1)).alias("first_label"), F.length("b").alias("size"))
