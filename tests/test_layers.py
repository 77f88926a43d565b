"""HPACK, certificates, bindings: examples of the specifications, round trips, damaged input."""

import random

from wirelark.functions import hpack, x509
from wirelark.operators.bindings import Bindings


def test_huffman_code_is_complete():
    assert len(hpack.codes()) == 257 and sum(2**-n for _, n in hpack.codes().values()) == 1 and len(hpack.TABLE) == 61


def test_hpack_examples():
    """RFC 7541, C.4.1 to C.4.3, and integers of C.1."""
    assert hpack.huffman_encode(b"www.example.com").hex() == "f1e3c2e5f23a6ba0ab90f4ff"
    assert hpack.encode_integer(10, 5) == bytes([10]) and hpack.encode_integer(1337, 5) == bytes([31, 154, 10]) and hpack.decode_integer(bytes([31, 154, 10]), 0, 5) == (1337, 3)
    t = hpack.Headers()
    assert t.decode(bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff")) == [(":method", "GET"), (":scheme", "http"), (":path", "/"), (":authority", "www.example.com")]
    assert t.decode(bytes.fromhex("828684be5886a8eb10649cbf"))[-1] == ("cache-control", "no-cache")
    assert t.decode(bytes.fromhex("828785bf408825a849e95ba97d7f8925a849e95bb8e8b4bf"))[-1] == ("custom-key", "custom-value") and t.size == 164


def test_hpack_round_trip():
    random.seed(1)
    a, b = hpack.Headers(200), hpack.Headers(200)
    for _ in range(300):
        headers = [(random.choice([":path", "cookie", "x-" + random.choice("abc")]), "".join(map(chr, random.choices(range(32, 300), k=random.randrange(40))))) for _ in range(5)]
        assert b.decode(a.encode(headers, random.random() < 0.5)) == headers and a.entries == b.entries
    for n in (0, 30, 31, 32, 127, 128, 255, 16383, 2**40):
        for prefix in range(1, 9):
            assert hpack.decode_integer(hpack.encode_integer(n, prefix), 0, prefix)[0] == n


def test_damaged_blocks_are_read_as_far_as_they_go():
    random.seed(2)
    for _ in range(500):
        hpack.http2_headers.plain(bytes([0, 0, 20, 1, 4, 0, 0, 0, 1]) + random.randbytes(20))
        hpack.http2_control.plain(random.randbytes(60))
        x509.certificate_fields(random.randbytes(60))
        x509.sslv2_client_hello.plain(random.randbytes(40))


def der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")) + body


def certificate(subject: str, issuer: str) -> bytes:
    name = lambda s: der(0x30, der(0x31, der(0x30, der(6, b"\x55\x04\x0a"), der(12, b"Org"))), der(0x31, der(0x30, der(6, x509.COMMON_NAME), der(12, s.encode()))))
    algorithm = der(0x30, der(6, b"\x2a\x86\x48"))
    times = der(0x30, der(0x17, b"240101000000Z"), der(0x17, b"250101000000Z"))
    return der(0x30, der(0x30, der(0xA0, der(2, b"\2")), der(2, b"\x12\x34"), algorithm, name(issuer), times, name(subject), der(0x30, b"k" * 200)), algorithm, der(3, b"s" * 64))


def test_certificates():
    import base64

    chain = [certificate("host.example", "Middle CA"), certificate("Middle CA", "Root CA")]
    body = b"".join(len(c).to_bytes(3, "big") + c for c in chain)
    message = b"\x0b" + (len(body) + 3).to_bytes(3, "big") + len(body).to_bytes(3, "big") + body
    want = {"subject_cn": "host.example", "issuer_cn": "Middle CA", "serial": "1234", "not_before": "240101000000Z", "not_after": "250101000000Z"}
    got = x509.tls_certificates.plain(message)
    assert got[0] == want and [c["issuer_cn"] for c in got] == ["Middle CA", "Root CA"]
    pem = "".join(f"-----BEGIN CERTIFICATE-----\n{base64.encodebytes(c).decode()}-----END CERTIFICATE-----\n" for c in chain)
    assert x509.pem_chain(pem) == chain


def test_sslv2_hello():
    body = bytes([1, 0, 2, 0, 6, 0, 0, 0, 16]) + bytes([1, 0, 128, 7, 0, 192]) + b"c" * 16
    got = x509.sslv2_client_hello.plain(bytes([0x80, len(body)]) + body)
    assert got == {"version": 2, "ciphers": [0x010080, 0x0700C0], "session_id": b"", "challenge": b"c" * 16}


def test_bindings(spark):
    from pyspark.sql import functions as F

    b = Bindings()
    assert b.infer("Ethernet", "type", 0x0806) == "ARP" and b.find("TCP", "HTTP").value == 80 and b.infer("TCP", "dport", 9) is None
    b.register("TCP", "HTTP", "dport", 9)
    assert b.infer("TCP", "dport", 9) == "HTTP" and b.infer("TCP", "dport", 8080) is None and len(b.below("HTTP")) == 1
    rows = spark.range(1).select(b.next_layer("UDP", "dport", F.lit(53)).alias("a"), b.next_layer("UDP", "dport", F.lit(54)).alias("c")).first()
    assert (rows.a, rows.c) == ("DNS", None)
    assert b.dimension(spark).where("lower = 'TCP' AND value = 9").first().upper == "HTTP"


def test_builders_are_read_back(spark):
    from pyspark.sql import functions as F

    from wirelark.functions import bytesx as B
    from wirelark.operators import build
    from wirelark.operators import dissect as dis
    from wirelark.operators import flow

    over = lambda body, port: build.ethernet(build.ipv4(build.tcp(body, 1, 2, 40000, port, flags=24, with_checksum=False), 1, 2, 6))
    one = spark.range(1).select(over(build.text_line("USER", F.lit("ann")), 21).alias("frame"))
    r = dis.dissect(one, ["ftp"]).select("ftp.command", "ftp.args").first()
    assert (r.command, r.args) == ("USER", "ann")
    r = dis.dissect(spark.range(1).select(over(build.text_reply(250, F.lit("ok"), more=True), 25).alias("frame")), ["smtp"]).select("smtp.reply_code", "smtp.is_multiline").first()
    assert (r.reply_code, r.is_multiline) == (250, True)
    radio = spark.range(1).select(build.dot15d4_data(0x1234, 1, 7, F.lit(bytearray(b"x")), seq=9).alias("frame"))
    r = dis.dissect(radio, ["dot15d4"], root="dot15d4").select("dot15d4.seqnum", "dot15d4.dest_panid", "dot15d4.src_addr_short").first()
    assert tuple(r) == (9, 0x1234, 7)
    mac = lambda x: B.raw("0200000000" + x)
    r = dis.dissect(spark.range(1).select(build.dot11_data(mac("01"), mac("02"), mac("03"), F.lit(bytearray())).alias("frame")), ["dot11"], root="dot11").select("dot11.type", "dot11.subtype", "dot11.addr2").first()
    assert tuple(r) == (2, 8, "02:00:00:00:00:02")
    frames = spark.range(3).select(F.col("id").alias("packet_index"), F.lit(5).cast("bigint").alias("ts_ns"), over(F.lit(bytearray(b"abc")), 80).alias("frame"))
    p, seen = flow.observed(flow.packets(frames))
    p.write.format("noop").mode("overwrite").save()
    assert seen.get["packets"] == 3 and seen.get["bytes"] == 3 * 57
