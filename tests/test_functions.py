import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from wirelark.functions import bytesx as B
from wirelark.functions import checksum as ck
from wirelark.functions import net, walkers


def one(spark, data, *cols):
    return spark.createDataFrame([(bytearray(data),)], "b binary").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_integers_and_ends(spark):
    b = F.col("b")
    r = one(spark, b"\x01\x02\x03\xff", B.uint(b, 0, 2), B.uint_le(b, 0, 2), B.uint(b, 3), B.uint(b, 3, 2), B.sint(b, 3, 1), B.bit_field(b, 12, 4), B.hexstr(b, ":"), B.mac_text(b))
    assert tuple(r)[:6] == (0x0102, 0x0201, 255, None, -1, 2) and r.c6 == "01:02:03:ff"


def test_ip6_text_is_canonical(spark):
    random.seed(1)
    rows = [bytes(random.choice([0, 0, 0, 1, 255]) for _ in range(16)) for _ in range(300)] + [bytes(16), bytes(15) + b"\1"]
    got = spark.createDataFrame([(bytearray(x),) for x in rows], "b binary").select("b", B.ip6_text(F.col("b")).alias("t")).collect()
    assert all(r.t == str(ipaddress.ip_address(bytes(r.b))) for r in got)


def test_crc_check_values(spark):
    b = F.col("b")
    r = one(spark, b"123456789", ck.modbus_crc16(b), ck.ccitt_kermit(b), ck.dnp3_crc(b), ck.crc32_ieee(b))
    assert tuple(r) == (0x4B37, 0x2189, 0xEA82, 0xCBF43926)


@pytest.mark.parametrize("data", [b"", b"\x01", b"\x00\x01\xf2\x03\xf4\xf5\xf6\xf7", bytes(range(255))])
def test_internet_checksum(spark, data):
    words = data + b"\0" * (len(data) % 2)
    total = sum(int.from_bytes(words[i : i + 2], "big") for i in range(0, len(words), 2))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    assert one(spark, data, ck.internet_checksum(F.col("b"))).c0 == 0xFFFF - total


def test_checksum_of_null_and_offsets(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (None,), (bytearray(b"d"),)], "b binary").coalesce(1)
    assert [r.c for r in df.select(ck.internet_checksum(F.col("b")).alias("c")).collect()][1] is None


def test_names_and_flags(spark):
    r = spark.range(1).select(net.flags_text(F.lit(0x1FF)).alias("a"), net.flags_bits(F.lit("SA")).alias("b"), net.numbered(F.lit("UDP"), net.PROTOCOLS).alias("c"), net.host_count(F.lit(31)).alias("d"), net.prefix_mask(F.lit(0)).alias("e"), B.parse_mac(F.lit("x")).alias("f"), B.parse_ip4(F.lit("1.2.3.256")).alias("g")).first()
    assert tuple(r) == ("FSRPAUECN", 18, 17, 1, 0, None, None)


def test_mqtt_length_bad(spark):
    assert one(spark, b"\x80\x80\x80\x80\x01", net.mqtt_length(F.col("b"), 0)).c0 is None


def test_walkers_never_raise():
    random.seed(2)
    plain = [w.plain for w in vars(walkers).values() if hasattr(w, "plain")]
    assert len(plain) > 12
    for _ in range(300):
        b = bytes(random.randrange(256) for _ in range(random.randrange(60)))
        for w in plain:
            w(b)


def test_dns_names_and_loops():
    assert walkers.name_at(b"\x03www\x07example\x00\xc0\x00", 13) == ("www.example", 15)
    assert walkers.name_at(b"\xc0\x00", 0)[0] is None
    assert walkers.bitmap_types(walkers.make_bitmap([1, 2, 15, 257])) == [1, 2, 15, 257]


def test_tls_hello():
    host = b"example.org"
    sni = b"\0\0" + (len(host) + 5).to_bytes(2, "big") + (len(host) + 3).to_bytes(2, "big") + b"\0" + len(host).to_bytes(2, "big") + host
    alpn = b"\0\x10\0\x05\0\x03\x02h2"
    body = b"\x03\x03" + bytes(32) + b"\0" + b"\0\x02\x13\x01" + b"\x01\0" + (len(sni + alpn)).to_bytes(2, "big") + sni + alpn
    msg = b"\x01" + len(body).to_bytes(3, "big") + body
    r = walkers.tls_client_hello.plain(b"\x16\x03\x01" + len(msg).to_bytes(2, "big") + msg)
    assert (r["sni"], r["alpn"], r["ciphers"]) == ("example.org", ["h2"], [0x1301])


def test_hkdf_rfc5869_case_1():
    okm = walkers.hkdf_expand(walkers.hkdf_extract(bytes(range(13)), b"\x0b" * 22), bytes(range(0xF0, 0xFA)), 42)
    assert okm.hex().startswith("3cb25f25faacd57a90434f64d0362f2a")


def test_crc16_of_batches():
    """Values of all lengths side by side equal a fold of each byte."""
    import random

    from wirelark.functions.checksum import crc16_of, reflected_table

    random.seed(3)
    values = [random.randbytes(random.choice([0, 1, 5, 40, 41, 300])) for _ in range(100)] + [None, random.randbytes(5000)]
    for poly, init, out in ((0xA001, 0xFFFF, 0), (0xA6BC, 0, 0xFFFF)):
        table, want = reflected_table(poly).tolist(), []
        for v in values:
            c = init
            for x in v or b"":
                c = (c >> 8) ^ table[(c ^ x) & 255]
            want.append(None if v is None else c ^ out)
        assert crc16_of(values, poly, init, out) == want
    assert crc16_of([], 0xA001, 0, 0) == [] and crc16_of([b"123456789"], 0xA001, 0xFFFF, 0) == [0x4B37]
