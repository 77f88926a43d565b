"""Queries over frames: building, dissecting, capture files, protocol fields, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelark import shared
from wirelark.functions import bpf, walkers
from wirelark.functions import bytesx as B
from wirelark.operators import build, custom
from wirelark.operators import dissect as dis
from wirelark.operators import fragment as frag
from wirelark.plans import derived
from wirelark.plans.base import packets_sql, quad, query
from wirelark.sources import pcap

QUERIES: dict = {}


def folder(spark) -> str:
    """A fresh folder in the place all executors share."""
    return shared.fresh_path(spark, "captures")


@query(QUERIES, packets_sql(f"SELECT event_id, 'Ethernet/IPv4/TCP' || CASE WHEN pay > 0 THEN '/Raw' ELSE '' END AS layers, {quad('src_ip')} AS src, {quad('dst_ip')} AS dst, sport, dport, seq, ack, flags, 40 + pay AS total_len, event_id % 65536 AS ident FROM p"))
def frame_roundtrip_tcp(spark, sf):
    d = dis.dissect(derived.plain_tcp_frames(spark, sf).select("event_id", "frame"))
    return d.select("event_id", F.array_join(dis.layer_names(), "/").alias("layers"), "ipv4.src", "ipv4.dst", "tcp.sport", "tcp.dport", "tcp.seq", "tcp.ack", "tcp.flags", F.col("ipv4.len").alias("total_len"), F.col("ipv4.id").alias("ident"))


@query(QUERIES, packets_sql(f"SELECT event_id, {quad('src_ip')} AS src, {quad('dst_ip')} AS dst, sport, dport, 8 + pay % 64 AS udp_len FROM p"))
def frame_roundtrip_udp(spark, sf):
    d = dis.dissect(derived.udp_frames(spark, sf).select("event_id", "frame"))
    return d.select("event_id", "ipv4.src", "ipv4.dst", "udp.sport", "udp.dport", F.col("udp.len").alias("udp_len"))


@query(QUERIES, packets_sql("SELECT event_id, CASE WHEN outbound THEN 8 ELSE 0 END AS icmp_type, user_id % 65536 AS ident, event_id % 65536 AS seq FROM p"))
def frame_roundtrip_icmp(spark, sf):
    d = dis.dissect(derived.icmp_frames(spark, sf).select("event_id", "frame"))
    return d.select("event_id", F.col("icmp.type").alias("icmp_type"), F.col("icmp.id").alias("ident"), "icmp.seq")


@query(QUERIES, packets_sql(f"SELECT event_id, CASE WHEN outbound THEN 1 ELSE 2 END AS op, {quad('src_ip')} AS psrc, {quad('dst_ip')} AS pdst, '02:00:00:00:' || lpad(lower(hex((user_id >> 8) & 255)), 2, '0') || ':' || lpad(lower(hex(user_id & 255)), 2, '0') AS hwsrc FROM p"))
def frame_roundtrip_arp(spark, sf):
    mac = F.concat(B.raw("02000000"), B.put(F.col("user_id"), 2))
    body = build.arp(F.when(F.col("outbound"), 1).otherwise(2), mac, F.col("src_ip"), build.BROADCAST, F.col("dst_ip"))
    d = dis.dissect(derived.packets(spark, sf).select("event_id", build.ethernet(body, 0x0806).alias("frame")))
    return d.select("event_id", "arp.op", "arp.psrc", "arp.pdst", "arp.hwsrc")


@query(QUERIES, packets_sql("SELECT event_id, 58 AS nh, 64 AS hlim, 'fd00::' || lower(hex(user_id + 1)) AS src, 'fd00:0:0:1::' || lower(hex(event_id % 8 + 1)) AS dst, 128 AS icmp_type, user_id % 65536 AS ident FROM p"))
def frame_roundtrip_ipv6(spark, sf):
    src, dst = F.concat(B.raw("FD00000000000000"), B.put(0, 4), B.put(F.col("user_id") + 1, 4)), F.concat(B.raw("FD00000000000001"), B.put(0, 4), B.put(F.col("event_id") % 8 + 1, 4))
    msg = build.icmpv6(src, dst, 128, 0, F.concat(B.put(F.col("user_id") % 65536, 2), B.put(F.col("event_id") % 65536, 2)))
    d = dis.dissect(derived.packets(spark, sf).select("event_id", build.ethernet(build.ipv6(msg, src, dst, 58), 0x86DD).alias("frame")))
    return d.select("event_id", "ipv6.nh", "ipv6.hlim", "ipv6.src", "ipv6.dst", F.col("icmpv6.type").alias("icmp_type"), F.col("icmpv6.id").alias("ident"))


CAPTURE_SQL = packets_sql("SELECT packet_index, ts_ns, 54 + pay AS cap_len, 54 + pay AS orig_len, 1 AS link_type FROM p")


def capture(spark, sf, fmt: str):
    path = folder(spark)
    frames = derived.plain_tcp_frames(spark, sf).select("packet_index", "ts_ns", "frame")
    pcap.write_capture(frames, path, fmt, single=True)
    return pcap.read_capture(spark, path).select("packet_index", "ts_ns", "cap_len", "orig_len", "link_type")


@query(QUERIES, CAPTURE_SQL)
def pcap_roundtrip(spark, sf):
    return capture(spark, sf, "pcap")


@query(QUERIES, CAPTURE_SQL)
def pcapng_roundtrip(spark, sf):
    return capture(spark, sf, "pcapng")


@query(QUERIES, packets_sql("SELECT packet_index, ts_ns FROM p WHERE packet_index < 100"))
def pcap_limit(spark, sf):
    path = folder(spark)
    pcap.write_capture(derived.plain_tcp_frames(spark, sf).select("packet_index", "ts_ns", "frame"), path, "pcap", single=True)
    return pcap.read_capture(spark, path, count=100).select("packet_index", "ts_ns")


@query(QUERIES, packets_sql("SELECT kind, count(*) AS packets FROM (SELECT unnest(['Ethernet', 'IPv4', 'TCP'] || CASE WHEN pay > 0 THEN ['Raw'] ELSE [] END) AS kind FROM p) GROUP BY kind"))
def layer_presence_counts(spark, sf):
    d = dis.dissect(derived.plain_tcp_frames(spark, sf))
    return d.select(F.explode(dis.layer_names()).alias("kind")).groupBy("kind").agg(F.count("*").alias("packets"))


@query(QUERIES, packets_sql("SELECT hierarchy, count(*) AS packets, CAST(sum(54 + pay) AS BIGINT) AS bytes FROM (SELECT pay, 'Ethernet/IPv4/TCP' || CASE WHEN pay > 0 THEN '/Raw' ELSE '' END AS hierarchy FROM p) GROUP BY hierarchy"))
def protocol_hierarchy(spark, sf):
    d = dis.dissect(derived.plain_tcp_frames(spark, sf))
    return d.groupBy(F.array_join(dis.layer_names(), "/").alias("hierarchy")).agg(F.count("*").alias("packets"), F.sum(F.length("frame")).alias("bytes"))


@query(QUERIES, packets_sql("SELECT event_id, '00:00:00:00:00:00' AS src, CAST(sport AS VARCHAR) AS sport FROM p"))
def field_coalesce_src(spark, sf):
    """Unqualified names: src is the link layer's."""
    d = dis.dissect(derived.plain_tcp_frames(spark, sf).select("event_id", "frame"))
    return d.select("event_id", dis.field("src", d).alias("src"), dis.field("sport", d).alias("sport"))


@query(QUERIES, packets_sql(f"SELECT event_id, 17 AS ttl, {quad('src_ip')} AS src FROM p"))
def field_write(spark, sf):
    """A field written in place; lengths and checksums stay."""
    d = dis.dissect(derived.plain_tcp_frames(spark, sf).select("event_id", "frame"))
    w = d.select("event_id", dis.write_field(F.col("frame"), F.col("l3_start"), 8, 1, F.lit(17)).alias("frame"))
    return dis.dissect(w).select("event_id", "ipv4.ttl", "ipv4.src")


@query(QUERIES, packets_sql(f"SELECT event_id, 'Ethernet / IPv4 / ' || CASE WHEN pay > 0 THEN 'TCP / Raw' ELSE 'TCP ' || sport || ' > ' || dport || ' ' || concat(CASE WHEN flags & 1 > 0 THEN 'F' ELSE '' END, CASE WHEN flags & 2 > 0 THEN 'S' ELSE '' END, CASE WHEN flags & 4 > 0 THEN 'R' ELSE '' END, CASE WHEN flags & 8 > 0 THEN 'P' ELSE '' END, CASE WHEN flags & 16 > 0 THEN 'A' ELSE '' END) END AS summary FROM p"))
def packet_summary(spark, sf):
    d = dis.dissect(derived.plain_tcp_frames(spark, sf).select("event_id", "frame"))
    return d.select("event_id", dis.summary().alias("summary"))


FILTERS = {
    "bpf_tcp_port": ("tcp port 80 and greater 100", "(sport = 80 OR dport = 80) AND 54 + pay >= 100"),
    "bpf_net_or": ("src net 10.1.0.0/16 and not (port 22 or portrange 100-200)", "src_ip >> 16 = 2561 AND NOT (sport = 22 OR dport = 22 OR sport BETWEEN 100 AND 200 OR dport BETWEEN 100 AND 200)"),
    "bpf_host": ("host 10.0.0.7 or (dst host 10.1.0.3 and dst port domain)", "src_ip = 167772167 OR dst_ip = 167772167 OR (dst_ip = 167837699 AND dport = 53)"),
}


def bpf_query(text: str):
    return lambda spark, sf: dis.dissect(derived.plain_tcp_frames(spark, sf)).where(bpf.compile_filter(text)).select("event_id")


for _name, (_text, _sql) in FILTERS.items():
    QUERIES[_name] = (bpf_query(_text), packets_sql(f"SELECT event_id FROM p WHERE {_sql}"))


@query(QUERIES, "SELECT doc_id, n AS fragments, n = 1 OR true AS complete, true AS same FROM (SELECT doc_id, CASE WHEN octet_length(encode(text)) + 20 <= 576 THEN 1 ELSE (octet_length(encode(text)) + 551) // 552 END AS n FROM documents)")
def ipv4_fragment_reassemble(spark, sf):
    """Texts as IPv4 payloads, cut to an MTU of 576 and put together again.

    A text too long for one packet goes in several of like size, cut where fragments are: the addresses are
    the halves of the row's number, ident is the part's. A null text is carried as an empty one and, as in
    the SQL, has no number of fragments.
    """
    where = folder(spark)  # written, so that a row keeps its number
    spark.read.parquet(f"{sf}/documents.parquet").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("t")).write.parquet(where)
    docs = spark.read.parquet(where)
    key, step, most = F.col("row"), 552, 118  # bytes of a fragment, fragments of a packet
    sent = docs.select("row", F.coalesce("t", F.lit(bytearray())).alias("t")).withColumn("n", F.greatest(F.ceil(F.length("t") / step), F.lit(1))).withColumn("parts", F.ceil(F.col("n") / most))
    cut = lambda k: (step * F.floor(k * F.col("n") / F.col("parts"))).cast("int")
    parts = sent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    body = B.take(F.col("t"), cut(F.col("part")), cut(F.col("part") + 1) - cut(F.col("part")))
    p = parts.select("row", "part", build.ipv4(body, F.shiftrightunsigned(key, 32), key.bitwiseAND(0xFFFFFFFF), 253, ident=F.col("part")).alias("packet"))
    f = frag.fragments(p, 576)
    counts = f.groupBy("row").agg(F.count("*").alias("fragments"))
    back = frag.reassemble(f.select("fragment")).select((F.shiftleft(B.uint(F.col("src"), 0, 4), 32).bitwiseOR(B.uint(F.col("dst"), 0, 4))).alias("row"), "ident", "complete", B.take(F.col("packet"), 20, 65_535).alias("body"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("ident", "body"))), F.lit(bytearray()), lambda a, x: F.concat(a, x["body"]))
    whole = back.groupBy("row").agg(F.every("complete").alias("complete"), joined.alias("back"))
    got = docs.join(counts, "row", "left").join(whole, "row", "left")
    same = F.coalesce(F.col("back") == F.coalesce("t", F.lit(bytearray())), F.lit(False))
    return got.select("doc_id", F.when(F.col("t").isNotNull(), F.col("fragments")).alias("fragments"), F.coalesce("complete", F.lit(False)).alias("complete"), same.alias("same"))


@query(QUERIES, "SELECT l_orderkey, count(*) AS gaps FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber + 1, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS due FROM lineitem WHERE l_linenumber % 3 <> 0) WHERE l_linenumber <> due GROUP BY l_orderkey")
def fragment_gap_detect(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber % 3 <> 0").select("l_orderkey", F.col("l_linenumber").alias("start"), F.lit(1).alias("size"))
    return frag.gaps(li, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("gaps"))


@query(QUERIES, "SELECT page_id, 'GET' AS method, path AS uri, 'HTTP/1.1' AS version, host, 'page ' || page_id AS agent FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '^https?://[^/]+(/.*)$', 1), ''), '/') AS path FROM pages)")
def http_request_parse(spark, sf):
    """Requests built from page addresses, sent through frames and read back."""
    host = F.regexp_extract("url", "^https?://([^/:]+)", 1)
    path = F.coalesce(F.nullif(F.regexp_extract("url", "^https?://[^/]+(/.*)$", 1), F.lit("")), F.lit("/"))
    body = build.http_request("GET", path, host, {"User-Agent": F.concat(F.lit("page "), F.col("page_id"))})
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", build.ethernet(build.ipv4(build.tcp(body, 1, 2, 40000, 80, flags=24, with_checksum=False), 1, 2, 6)).alias("frame"))
    d = dis.dissect(p, ["http"])
    from wirelark.operators.protocols import http_header

    return d.select("page_id", "http.method", "http.uri", "http.version", http_header(F.col("http.headers"), "host").alias("host"), http_header(F.col("http.headers"), "user-agent").alias("agent"))


@query(QUERIES, "SELECT page_id, host AS qname, 'A' AS qtype, true AS is_response, (167772160 + page_id % 250) AS answer FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages)")
def dns_answer_parse(spark, sf):
    host = F.regexp_extract("url", "^https?://([^/:]+)", 1)
    body = build.dns_answer_a(F.col("page_id") % 65536, host, F.lit(167772160) + F.col("page_id") % 250)
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", build.ethernet(build.ipv4(build.udp(body, 1, 2, 53, 40000, with_checksum=False), 1, 2, 17)).alias("frame"))
    d = dis.dissect(p, ["dns"]).select("page_id", "dns", walkers.dns_records(B.take(F.col("frame"), F.col("payload_start"), F.length("frame"))).alias("rr"))
    from wirelark.functions.net import DNS_TYPES, named

    first = F.get("rr.questions", F.lit(0))
    return d.select("page_id", first["name"].alias("qname"), named(first["type"], DNS_TYPES).alias("qtype"), F.col("dns.qr").alias("is_response"), B.parse_ip4(F.get("rr.answers", F.lit(0))["text"]).alias("answer"))


LINES = "SELECT conv_id, turn, text FROM conversations"


@query(QUERIES, "SELECT conv_id, turn, 'MAIL' AS command, 'FROM:<u' || conv_id || '@example.com>' AS args, 'u' || conv_id || '@example.com' AS mailfrom FROM conversations")
def smtp_commands(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    line = F.concat(F.lit("mail FROM:<u"), F.col("conv_id"), F.lit("@example.com>\r\n")).cast("binary")
    p = c.select("conv_id", "turn", build.ethernet(build.ipv4(build.tcp(line, 1, 2, 40000, 25, flags=24, with_checksum=False), 1, 2, 6)).alias("frame"))
    return dis.dissect(p, ["smtp"]).select("conv_id", "turn", "smtp.command", "smtp.args", "smtp.mailfrom")


@query(QUERIES, "SELECT conv_id, turn, 200 + turn AS reply_code, 'Turn ' || turn AS reply_text, turn % 2 = 0 AS is_multiline FROM conversations")
def ftp_replies(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    line = F.concat(F.col("turn") + 200, F.when(F.col("turn") % 2 == 0, "-").otherwise(" "), F.lit("Turn "), F.col("turn"), F.lit("\r\n")).cast("binary")
    p = c.select("conv_id", "turn", build.ethernet(build.ipv4(build.tcp(line, 1, 2, 21, 40000, flags=24, with_checksum=False), 1, 2, 6)).alias("frame"))
    return dis.dissect(p, ["ftp"]).select("conv_id", "turn", "ftp.reply_code", "ftp.reply_text", "ftp.is_multiline")


@query(QUERIES, "SELECT conv_id, turn, 'a' || turn AS tag, 'OK' AS status, 'done ' || conv_id AS args, '+OK' AS pop3_raw, 'ready ' || conv_id AS pop3_text FROM conversations")
def imap_pop3_lines(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    frame = lambda line, port: build.ethernet(build.ipv4(build.tcp(line.cast("binary"), 1, 2, port, 40000, flags=24, with_checksum=False), 1, 2, 6))
    i = frame(F.concat(F.lit("a"), F.col("turn"), F.lit(" ok done "), F.col("conv_id"), F.lit("\r\n")), 143)
    p = frame(F.concat(F.lit("+OK ready "), F.col("conv_id"), F.lit("\r\n")), 110)
    d = dis.dissect(c.select("conv_id", "turn", i.alias("frame"), p.alias("other")), ["imap"]).select("conv_id", "turn", "imap", "other")
    return dis.dissect(d, ["pop3"], frame="other").select("conv_id", "turn", "imap.tag", "imap.status", "imap.args", F.substring("pop3.raw", 1, 3).alias("pop3_raw"), F.col("pop3.response_text").alias("pop3_text"))


@query(QUERIES, "SELECT event_id, event_id % 65536 AS trans_id, event_id % 250 AS unit_id, 3 AS func_code, event_id % 1000 AS start_addr, 1 + event_id % 100 AS quantity FROM events")
def modbus_fields(spark, sf):
    e = derived.events(spark, sf)
    x = F.col("event_id")
    body = build.modbus(x % 65536, x % 250, 3, F.concat(B.put(x % 1000, 2), B.put(1 + x % 100, 2)))
    d = dis.dissect(e.select("event_id", build.ethernet(build.ipv4(build.tcp(body, 1, 2, 40000, 502, flags=24, with_checksum=False), 1, 2, 6)).alias("frame")), ["modbus"])
    return d.select("event_id", "modbus.trans_id", "modbus.unit_id", "modbus.func_code", "modbus.start_addr", "modbus.quantity")


@query(QUERIES, "SELECT event_id, 3 AS msg_type, 'sensor/' || user_id AS topic, event_type AS value FROM events")
def mqtt_publish(spark, sf):
    e = derived.events(spark, sf)
    body = build.mqtt_publish(F.concat(F.lit("sensor/"), F.col("user_id")), F.col("event_type").cast("binary"))
    d = dis.dissect(e.select("event_id", build.ethernet(build.ipv4(build.tcp(body, 1, 2, 40000, 1883, flags=24, with_checksum=False), 1, 2, 6)).alias("frame")), ["mqtt"])
    return d.select("event_id", "mqtt.msg_type", "mqtt.topic", F.col("mqtt.value").cast("string").alias("value"))


@query(QUERIES, "SELECT event_id, 1 AS ver, 2 + event_id % 3 AS code_class, event_id % 65536 AS msg_id, lower(hex(encode(event_type))) AS payload FROM events")
def coap_fields(spark, sf):
    e = derived.events(spark, sf)
    x = F.col("event_id")
    body = build.coap(1, F.shiftleft((2 + x % 3).cast("int"), 5), x % 65536, B.put(x, 4), F.col("event_type").cast("binary"))
    d = dis.dissect(e.select("event_id", build.ethernet(build.ipv4(build.udp(body, 1, 2, 40000, 5683, with_checksum=False), 1, 2, 17)).alias("frame")), ["coap"])
    return d.select("event_id", "coap.ver", "coap.code_class", "coap.msg_id", B.hexstr(F.col("coap.payload")).alias("payload"))


@query(QUERIES, "SELECT event_id, 'Ethernet/IPv4/TCP/TPKT/COTP/S7Comm' AS layers, 1 AS rosctr, event_id % 65536 AS pdu_ref, 4 AS function FROM events")
def s7_stack(spark, sf):
    x = F.col("event_id")
    body = build.tpkt(build.cotp_data(build.s7comm(1, x % 65536, B.raw("0401"), B.raw("00"))))
    d = dis.dissect(derived.events(spark, sf).select("event_id", build.ethernet(build.ipv4(build.tcp(body, 1, 2, 40000, 102, flags=24, with_checksum=False), 1, 2, 6)).alias("frame")), ["tpkt", "cotp", "s7comm"])
    return d.select("event_id", F.array_join(dis.layer_names(), "/").alias("layers"), "s7comm.rosctr", "s7comm.pdu_ref", "s7comm.function")


@query(QUERIES, "SELECT o_orderkey, o_orderkey % 256 AS kind, o_custkey % 65536 AS ref, o_orderkey AS serial, left(o_orderpriority, 8) AS label FROM orders")
def custom_proto_roundtrip(spark, sf):
    """A protocol declared at run time, built and parsed."""
    proto = custom.Protocol("OrderNote", [custom.ByteField("kind", 1), custom.ShortField("ref", 0), custom.IntField("serial", 0), custom.StrLenField("label", b"", 8)])
    o = spark.read.parquet(f"{sf}/orders.parquet")
    b = proto.build(kind=F.col("o_orderkey") % 256, ref=F.col("o_custkey") % 65536, serial=F.col("o_orderkey"), label=F.substring("o_orderpriority", 1, 8).cast("binary"))
    return o.select("o_orderkey", proto.parse(b).alias("x")).select("o_orderkey", "x.kind", "x.ref", "x.serial", F.rtrim(F.regexp_replace(F.col("x.label").cast("string"), "\u0000+$", "")).alias("label"))


@query(QUERIES, packets_sql("SELECT event_id, 34 + 8 + pay % 64 AS packet_len, greatest(0, 60 - (42 + pay % 64)) AS pad_len FROM p"))
def payload_padding(spark, sf):
    """Frames padded to the Ethernet minimum and split again."""
    d = dis.dissect(derived.udp_frames(spark, sf).select("event_id", B.ethernet_min_frame(F.col("frame")).alias("frame")))
    x = dis.split_padding()
    return d.select("event_id", F.length(x["packet"]).alias("packet_len"), F.length(x["padding"]).alias("pad_len"))


@query(QUERIES, "SELECT page_id, host AS sni, 'h2' AS alpn, 771 AS version FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages)")
def tls_sni(spark, sf):
    """Client hellos built around page hosts, sent as TLS records and read back."""
    host = F.regexp_extract("url", "^https?://([^/:]+)", 1)
    n = F.octet_length(host)
    sni = F.concat(B.put(0, 2), B.put(n + 5, 2), B.put(n + 3, 2), B.put(0, 1), B.put(n, 2), host.cast("binary"))
    ext = F.concat(sni, B.raw("001000050003026832"))
    body = F.concat(B.raw("0303" + "00" * 32 + "00" + "00021301" + "0100"), B.put(F.length(ext), 2), ext)
    record = build.tls_record(22, F.concat(B.put(1, 1), B.put(F.length(body), 3), body))
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", record.alias("_r")).select("page_id", build.ethernet(build.ipv4(build.tcp(F.col("_r"), 1, 2, 40000, 443, flags=24, with_checksum=False), 1, 2, 6)).alias("frame"))
    d = dis.dissect(p).where("app = 'TLS'").select("page_id", walkers.tls_client_hello(B.take(F.col("frame"), F.col("payload_start"), F.length("frame"))).alias("h"))
    return d.select("page_id", "h.sni", F.get("h.alpn", F.lit(0)).alias("alpn"), "h.version")


@query(QUERIES, packets_sql("SELECT event_id, 500 + event_id % 1000 AS mss, event_id % 15 AS wscale, true AS sack_permitted, event_id % 4294967296 AS ts_val FROM p"))
def tcp_options_parse(spark, sf):
    x = F.col("event_id")
    opts = F.concat(B.raw("0204"), B.put(500 + x % 1000, 2), B.raw("0303"), B.put(x % 15, 1), B.raw("0402"), B.raw("080A"), B.put(x, 4), B.put(0, 4), B.raw("00"))
    seg = build.tcp(F.lit(bytearray()), 1, 2, 40000, 80, options=opts, with_checksum=False)
    d = dis.dissect(derived.events(spark, sf).select("event_id", build.ethernet(build.ipv4(seg, 1, 2, 6)).alias("frame")))
    return d.select("event_id", walkers.tcp_option_values(B.take(F.col("frame"), F.col("l4_start"), F.length("frame"))).alias("o")).select("event_id", "o.mss", "o.wscale", "o.sack_permitted", "o.ts_val")


@query(QUERIES, "SELECT event_id, 1 AS opcode, 'RRQ' AS op_name, 'f' || event_id AS filename, 'octet' AS mode FROM events")
def tftp_requests(spark, sf):
    body = build.tftp_request(1, F.concat(F.lit("f"), F.col("event_id")))
    d = dis.dissect(derived.events(spark, sf).select("event_id", build.ethernet(build.ipv4(build.udp(body, 1, 2, 40000, 69, with_checksum=False), 1, 2, 17)).alias("frame")), ["tftp"])
    return d.select("event_id", "tftp.opcode", "tftp.op_name", "tftp.filename", "tftp.mode")


@query(QUERIES, "SELECT event_id, 12 AS type, event_id % 65536 AS tid, event_type AS data FROM events")
def mqttsn_publish(spark, sf):
    body = build.mqttsn(12, F.concat(B.put(0, 1), B.put(F.col("event_id") % 65536, 2), B.put(0, 2), F.col("event_type").cast("binary")))
    d = dis.dissect(derived.events(spark, sf).select("event_id", build.ethernet(build.ipv4(build.udp(body, 1, 2, 40000, 1883, with_checksum=False), 1, 2, 17)).alias("frame")), ["mqttsn"])
    return d.select("event_id", "mqttsn.type", "mqttsn.tid", F.col("mqttsn.data").cast("string").alias("data"))


@query(QUERIES, "SELECT event_id, 'I' AS type, event_id % 32768 AS tx, 30 AS type_id, 7 AS common_addr, event_id % 1000 AS ioa FROM events")
def iec104_fields(spark, sf):
    x = F.col("event_id")
    asdu = F.concat(B.raw("1E010300"), B.put_le(F.lit(7), 2), B.put_le(x % 1000, 3), B.raw("0100000000000000"))
    d = dis.dissect(derived.events(spark, sf).select("event_id", build.ethernet(build.ipv4(build.tcp(build.iec104_i((x % 32768).cast("int"), F.lit(0), asdu), 1, 2, 40000, 2404, flags=24, with_checksum=False), 1, 2, 6)).alias("frame")), ["iec104"])
    return d.select("event_id", "iec104.type", "iec104.tx", "iec104.type_id", "iec104.common_addr", "iec104.ioa")


@query(QUERIES, "SELECT event_id, 1 AS frametype, event_id % 256 AS seqnum, 4660 AS dest_panid, event_id % 65536 AS src_short FROM events")
def dot15d4_fields(spark, sf):
    """802.15.4 data frames with short addresses, from their own root."""
    x = F.col("event_id")
    frame = F.concat(B.put_le(F.lit(0x8841), 2), B.put(x % 256, 1), B.put_le(F.lit(0x1234), 2), B.put_le(F.lit(1), 2), B.put_le(x % 65536, 2), B.raw("0000"))
    d = dis.dissect(derived.events(spark, sf).select("event_id", frame.alias("frame")), ["dot15d4"], root="dot15d4")
    return d.select("event_id", F.col("dot15d4.fcf_frametype").alias("frametype"), "dot15d4.seqnum", "dot15d4.dest_panid", F.col("dot15d4.src_addr_short").alias("src_short"))


@query(QUERIES, "SELECT event_id, 2 AS type, 8 AS subtype, '02:00:00:00:' || lpad(lower(hex((user_id >> 8) & 255)), 2, '0') || ':' || lpad(lower(hex(user_id & 255)), 2, '0') AS addr2 FROM events")
def dot11_fields(spark, sf):
    """802.11 QoS data frames, from their own root."""
    frame = F.concat(B.raw("88010000" + "FF" * 6), B.raw("02000000"), B.put(F.col("user_id"), 2), B.raw("FF" * 6), B.raw("0000"))
    d = dis.dissect(derived.events(spark, sf).select("event_id", frame.alias("frame")), ["dot11"], root="dot11")
    return d.select("event_id", "dot11.type", "dot11.subtype", "dot11.addr2")
