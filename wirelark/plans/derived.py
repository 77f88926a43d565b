"""Packets derived from the driver's tables, by arithmetic that Spark and DuckDB evaluate alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelark.operators import build

PORTS = [80, 443, 22, 53, 8080, 25, 110, 143]
FLAGS = {"signup": 2, "view": 18, "click": 16, "purchase": 17}

#: The same view as packets(), for DuckDB.
PACKETS_SQL = """
p0 AS (
  SELECT event_id AS packet_index, epoch_us(ts) * 1000 AS ts_ns, 167772160 + user_id AS a_ip, 167837696 + event_id % 8 AS b_ip,
    40000 + user_id % 1000 AS a_port, [80, 443, 22, 53, 8080, 25, 110, 143][event_id % 8 + 1] AS b_port, (event_id // 8) % 2 = 0 AS outbound,
    CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 18 WHEN 'click' THEN 16 WHEN 'purchase' THEN 17 ELSE CASE WHEN event_id % 5 = 0 THEN 4 ELSE 24 END END AS flags,
    CAST(floor(value) AS BIGINT) AS pay, event_id, user_id, event_type, value FROM events),
p AS (
  SELECT *, CASE WHEN outbound THEN a_ip ELSE b_ip END AS src_ip, CASE WHEN outbound THEN b_ip ELSE a_ip END AS dst_ip, CASE WHEN outbound THEN a_port ELSE b_port END AS sport,
    CASE WHEN outbound THEN b_port ELSE a_port END AS dport, 54 + pay AS len, (event_id * 1000) % 4294967296 AS seq, (event_id * 77) % 4294967296 AS ack FROM p0)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abstract_packets(events(spark, sf_dir))


def abstract_packets(e: DataFrame) -> DataFrame:
    """Abstract packets: addresses as BIGINT, ports, flags, seq, ack, pay (payload length)."""
    eid, uid = F.col("event_id"), F.col("user_id")
    kind = F.when(F.col("event_type") == "error", F.when(eid % 5 == 0, 4).otherwise(24))
    for name, bits in FLAGS.items():
        kind = F.when(F.col("event_type") == name, bits).otherwise(kind)
    p = e.select(
        eid.alias("packet_index"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), (uid + 167772160).alias("a_ip"), (eid % 8 + 167837696).alias("b_ip"), (uid % 1000 + 40000).cast("int").alias("a_port"),
        F.get(F.array(*map(F.lit, PORTS)), (eid % 8).cast("int")).alias("b_port"), (F.floor(eid / 8) % 2 == 0).alias("outbound"), kind.cast("int").alias("flags"), F.floor("value").alias("pay"), "event_id", "user_id", "event_type", "value",
    )
    out = F.col("outbound")
    pick = lambda a, b: F.when(out, F.col(a)).otherwise(F.col(b))
    return p.withColumns({"src_ip": pick("a_ip", "b_ip"), "dst_ip": pick("b_ip", "a_ip"), "sport": pick("a_port", "b_port"), "dport": pick("b_port", "a_port"), "seq": (F.col("event_id") * 1000) % 4294967296, "ack": (F.col("event_id") * 77) % 4294967296})


def filler(n: Column) -> Column:
    """n bytes of payload."""
    return F.repeat(F.lit("x"), n.cast("int")).cast("binary")


def in_ipv4(p: DataFrame, segment: Column, proto: int, ident: Column | int = 1) -> DataFrame:
    """p with frame: the segment in IPv4 and Ethernet, built in steps so that no step is evaluated twice."""
    packet = build.ipv4(F.col("_seg"), F.col("src_ip"), F.col("dst_ip"), proto, ident=ident)
    return p.withColumn("_seg", segment).withColumn("frame", build.ethernet(packet)).drop("_seg")


def tcp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packets() with an Ethernet/IPv4/TCP frame each."""
    p = packets(spark, sf_dir)
    seg = build.tcp(filler(F.col("pay")), F.col("src_ip"), F.col("dst_ip"), F.col("sport"), F.col("dport"), F.col("seq"), F.col("ack"), F.col("flags"))
    return in_ipv4(p, seg, 6, F.col("event_id") % 65536)


def plain_tcp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As tcp_frames, without the transport checksum: flows don't look at it."""
    return framed(packets(spark, sf_dir))


def framed(p: DataFrame) -> DataFrame:
    seg = build.tcp(filler(F.col("pay")), F.col("src_ip"), F.col("dst_ip"), F.col("sport"), F.col("dport"), F.col("seq"), F.col("ack"), F.col("flags"), with_checksum=False)
    return in_ipv4(p, seg, 6, F.col("event_id") % 65536)


def udp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    p = p.withColumn("_pay", filler(F.col("pay") % 64))
    return in_ipv4(p, build.udp(F.col("_pay"), F.col("src_ip"), F.col("dst_ip"), F.col("sport"), F.col("dport")), 17).drop("_pay")


def icmp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Echo requests one way and replies the other, id by user, seq by event."""
    p = packets(spark, sf_dir)
    msg = build.icmp_echo(F.col("user_id") % 65536, F.col("event_id") % 65536, F.when(F.col("outbound"), 0).otherwise(1), filler(F.col("pay") % 32))
    return in_ipv4(p, msg, 1)
