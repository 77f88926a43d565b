import random

import pytest
from pyspark.sql import functions as F

from wirelark.functions import bpf
from wirelark.operators import build, custom, fragment
from wirelark.operators import dissect as dis

A, Z = 0x0A000001, 0x0A000002


def lit(data: bytes):
    return F.lit(bytearray(data))


def tcp(payload: bytes, sport=40000, dport=80, flags=24):
    return build.ethernet(build.ipv4(build.tcp(lit(payload), A, Z, sport, dport, flags=flags), A, Z, 6))


def udp(payload: bytes, sport=40000, dport=53):
    return build.ethernet(build.ipv4(build.udp(lit(payload), A, Z, sport, dport), A, Z, 17))


def kinds(spark, frame, protocols=(), **how):
    return dis.dissect(spark.range(1).select(frame.alias("frame")), list(protocols), **how).select("*", dis.layer_names().alias("kinds")).first()


CASES = [
    (lambda: tcp(b"SSH-2.0-x\r\nrest", dport=22), "Ethernet IPv4 TCP SSH Raw"),
    (lambda: tcp(b"\x00\x01\x00\x00\x00\x06\x01\x03\x00\x00\x00\x01", dport=502), "Ethernet IPv4 TCP Modbus"),
    (lambda: tcp(b"\x30\x05\x00\x01a12", dport=1883), "Ethernet IPv4 TCP MQTT"),
    (lambda: tcp(b"220 hello\r\n", sport=21), "Ethernet IPv4 TCP FTP"),
    (lambda: tcp(b"220", sport=21), "Ethernet IPv4 TCP Raw"),
    (lambda: tcp(b"EHLO x\r\n", dport=587), "Ethernet IPv4 TCP SMTP"),
    (lambda: tcp(b"+OK\r\n", sport=110), "Ethernet IPv4 TCP POP3"),
    (lambda: tcp(b"a1 LOGIN u p\r\n", dport=143), "Ethernet IPv4 TCP IMAP"),
    (lambda: tcp(b"\x03\x00\x00\x07\x02\xf0\x80", dport=102), "Ethernet IPv4 TCP TPKT COTP"),
    (lambda: tcp(b"\x68\x04\x07\x00\x00\x00", dport=2404), "Ethernet IPv4 TCP IEC104"),
    (lambda: tcp(b"\x05\x64\x05\xc0\x01\x00\x00\x04\x00\x00", dport=20000), "Ethernet IPv4 TCP DNP3"),
    (lambda: tcp(b"\x16\x03\x03\x00\x02ab" + b"tail", dport=443), "Ethernet IPv4 TCP TLS Raw"),
    (lambda: tcp(b"\x80\x01\x02\x03\x04", dport=9), "Ethernet IPv4 TCP TLS"),
    (lambda: tcp(b"\x00\x00\x00\x04\x00\x00\x00\x00\x00", dport=9), "Ethernet IPv4 TCP HTTP2"),
    (lambda: tcp(b"OPTIONS * HTTP/1.1\r\n\r\n", dport=8080), "Ethernet IPv4 TCP HTTP"),
    (lambda: tcp(b""), "Ethernet IPv4 TCP"),
    (lambda: udp(b"12345678"), "Ethernet IPv4 UDP Raw"),
    (lambda: udp(bytes(12)), "Ethernet IPv4 UDP DNS"),
    (lambda: udp(b"\xc0", dport=443), "Ethernet IPv4 UDP QUIC"),
    (lambda: udp(b"\x00\x02", dport=1701), "Ethernet IPv4 UDP L2TP"),
    (lambda: udp(b"\x02\x18", dport=1883), "Ethernet IPv4 UDP MQTTSN"),
    (lambda: udp(b"\x00\x01f\0octet\0", dport=69), "Ethernet IPv4 UDP TFTP"),
    (lambda: udp(b"\x40\x01\x00\x01", dport=5683), "Ethernet IPv4 UDP CoAP"),
    (lambda: udp(bytes(236) + b"\x63\x82\x53\x63\x35\x01\x05\xff", dport=67), "Ethernet IPv4 UDP DHCP"),
    (lambda: build.ethernet(build.ipv4(build.icmp(3, 1, None, build.ipv4(build.udp(lit(b"x"), A, Z, 1, 2), A, Z, 17)), Z, A, 1)), "Ethernet IPv4 ICMP IPv4 UDP Raw"),
]


@pytest.mark.parametrize("make,expect", CASES, ids=[e.split()[-1] + str(i) for i, (_, e) in enumerate(CASES)])
def test_layers(spark, make, expect):
    assert " ".join(kinds(spark, make()).kinds) == expect


@pytest.mark.parametrize("data,layers,error", [(b"", [], None), (bytes(13), [], None), (bytes(14), ["Ethernet"], None), (bytes(12) + b"\x08\x00" + b"\x44" + bytes(30), ["Ethernet"], "IPv4: header length"), (bytes(12) + b"\x08\x06" + bytes(4), ["Ethernet"], "ARP: too short"), (bytes(12) + b"\x81\x00" + bytes(8), ["Ethernet", "Raw"], None)])
def test_broken_frames(spark, data, layers, error):
    r = kinds(spark, lit(data))
    assert (r.kinds, r.parse_error) == (layers, error)


def test_random_bytes_never_fail(spark):
    random.seed(3)
    rows = [(bytearray(bytes(12) + random.choice([b"\x08\x00\x45", b"\x86\xdd\x60", b"\x08\x06"]) + bytes(random.randrange(256) for _ in range(random.randrange(90)))),) for _ in range(400)]
    d = dis.dissect(spark.createDataFrame([*rows, (None,)], "frame binary"), list(dis.PROTOCOLS))
    assert len(d.drop("layout").collect()) == 401


def test_vlan_and_roots(spark):
    inner = build.ipv4(build.udp(lit(b"x"), A, Z, 1, 2), A, Z, 17)
    r = kinds(spark, build.dot1q(inner, 7), extended=True)
    assert r.kinds == ["Ethernet", "Dot1Q", "IPv4", "UDP", "Raw"] and r.vlan_id == 7
    assert kinds(spark, inner, root="ipv4").kinds == ["IPv4", "UDP", "Raw"]


def test_dhcp_fields(spark):
    body = b"\x02\x01\x06\x00" + (77).to_bytes(4, "big") + bytes(8) + b"\x0a\x00\x00\x09" + bytes(8) + b"\x02\0\0\0\0\x01" + bytes(202) + b"\x63\x82\x53\x63\x35\x01\x05\x33\x04\x00\x00\x0e\x10\x06\x08\x08\x08\x08\x08\x01\x01\x01\x01\xff"
    r = kinds(spark, udp(body, 67, 68), ["dhcp"]).dhcp
    assert (r.xid, r.yiaddr, r.chaddr, r.msg_type, r.lease_time, r.dns) == (77, "10.0.0.9", "02:00:00:00:00:01", 5, 3600, "8.8.8.8,1.1.1.1")


@pytest.mark.parametrize("text", ["tcp port", "host 1.2.3", "port 99999", "(tcp", "foo", "tcp and", "portrange 1", "len ~ 3", "ether host 1:2"])
def test_bad_filters(spark, text):
    with pytest.raises(ValueError):
        bpf.validate_filter(text)


@pytest.mark.parametrize("text,hit", [("", True), ("tcp", True), ("udp or tcp port http", True), ("not tcp", False), ("src host 10.0.0.1 && dst net 10.0.0.0/8", True), ("ether dst ff:ff:ff:ff:ff:ff", True), ("less 10", False), ("len >= 54", True), ("ip proto 6", True), ("vlan", False), ("dst portrange 79-81", True)])
def test_filters(spark, text, hit):
    d = dis.dissect(spark.range(1).select(tcp(b"").alias("frame")))
    assert bool(d.where(bpf.compile_filter(text)).count()) is hit


def test_custom_protocol(spark):
    p = custom.Protocol("T", [custom.ByteField("a", 9), custom.ShortField("b", 5), custom.LongField("c"), custom.StrLenField("d", b"zz", 3)])
    b = p.build(b=258, d=b"xyz!")
    r = spark.range(1).select(p.parse(b).alias("x"), p.parse(lit(b"\x01\x02")).alias("y"), p.parse(lit(b"")).alias("z")).first()
    assert (r.x.a, r.x.b, bytes(r.x.d)) == (9, 258, b"xyz") and (r.y.a, r.y.b) == (1, None) and (r.z.a, bytes(r.z.d)) == (9, b"zz")
    assert custom.get_protocol("T") is p and "T" in custom.list_protocols()
    with pytest.raises(TypeError):
        p.build(nope=1)


@pytest.mark.parametrize("drop,complete", [(None, True), (0, False), (1, False), (3, False)])
def test_fragments(spark, drop, complete):
    p = spark.range(1).select(build.ipv4(lit(bytes(range(200))), A, Z, 17, ident=5).alias("packet"))
    f = fragment.fragments(p, 76)
    assert f.count() == 4
    r = fragment.reassemble(f.where(F.lit(drop is None) | (F.col("number") != (drop if drop is not None else -1)))).first()
    assert r.complete is complete and (not complete or bytes(r.packet) == bytes(p.first().packet))


def test_fragment_df(spark):
    p = spark.range(1).select(build.ipv4(lit(bytes(200)), A, Z, 17, flags=2).alias("packet"))
    assert fragment.fragments(p, 76).first().error == "DF is set"


def test_fragment_query_returns_every_text(spark, tmp_path):
    import duckdb

    from wirelark.plans import frames

    sizes = [0, 1, 552, 553, 556, 557, 65_136, 65_137, 65_515, 65_516, 65_136 + 553, 133_719]
    texts = [(i, ("é" * (n // 2) + "x")[: n - n // 2]) for i, n in enumerate(sizes)] + [(50, None), (51, "twice"), (51, "twice"), (51, "other"), (None, "no id"), (2**40, "far")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run, sql = frames.QUERIES["ipv4_fragment_reassemble"]
    want = duckdb.sql(sql.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(str, map(tuple, run(spark, str(tmp_path)).collect()))) == sorted(map(str, want)) and len(want) == len(texts)
