"""Relational queries over packet tables: what Spark brings along, in the shapes that traffic reports need."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wirelark.plans import derived
from wirelark.plans.base import packets_sql, query

QUERIES: dict = {}


@query(QUERIES, packets_sql("SELECT b_port, event_type, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes, grouping(b_port) AS g1, grouping(event_type) AS g2 FROM p GROUP BY ROLLUP (b_port, event_type)"))
def traffic_rollup(spark, sf):
    p = derived.packets(spark, sf).withColumn("len", F.col("pay") + 54)
    return p.rollup("b_port", "event_type").agg(F.count("*").alias("packets"), F.sum("len").alias("bytes"), F.grouping("b_port").cast("bigint").alias("g1"), F.grouping("event_type").cast("bigint").alias("g2"))


@query(QUERIES, packets_sql("SELECT ts_ns // 60000000000 AS minute, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes FROM p GROUP BY 1"))
def bytes_per_minute(spark, sf):
    p = derived.packets(spark, sf)
    return p.groupBy(F.expr("ts_ns div 60000000000").alias("minute")).agg(F.count("*").alias("packets"), F.sum(F.col("pay") + 54).alias("bytes"))


@query(QUERIES, packets_sql("SELECT packet_index, ts_ns - lag(ts_ns) OVER (PARTITION BY src_ip ORDER BY packet_index) AS gap_ns, row_number() OVER (PARTITION BY src_ip ORDER BY packet_index) AS n FROM p"))
def interarrival(spark, sf):
    w = Window.partitionBy("src_ip").orderBy("packet_index")
    return derived.packets(spark, sf).select("packet_index", (F.col("ts_ns") - F.lag("ts_ns").over(w)).alias("gap_ns"), F.row_number().over(w).cast("bigint").alias("n"))


@query(QUERIES, packets_sql("SELECT DISTINCT src_ip AS ip FROM p WHERE flags = 2 INTERSECT SELECT dst_ip FROM p WHERE flags = 18"))
def opened_and_answered(spark, sf):
    p = derived.packets(spark, sf)
    return p.where("flags = 2").select(F.col("src_ip").alias("ip")).intersect(p.where("flags = 18").select("dst_ip"))


@query(QUERIES, packets_sql("SELECT DISTINCT src_ip AS ip FROM p WHERE src_ip NOT IN (SELECT dst_ip FROM p WHERE flags = 4)"))
def never_reset(spark, sf):
    p = derived.packets(spark, sf)
    return p.select(F.col("src_ip").alias("ip")).distinct().join(p.where("flags = 4").select(F.col("dst_ip").alias("ip")).distinct(), "ip", "left_anti")


@query(QUERIES, packets_sql("SELECT b_port, count(DISTINCT user_id) AS users, CAST(quantile_disc(len, 0.5) AS BIGINT) AS median_len FROM p GROUP BY b_port"))
def port_users(spark, sf):
    p = derived.packets(spark, sf)
    return p.groupBy("b_port").agg(F.countDistinct("user_id").alias("users"), F.expr("percentile_disc(0.5) within group (order by pay + 54)").cast("bigint").alias("median_len"))


@query(QUERIES, packets_sql("SELECT count(*) FILTER (flags = 2) AS syn, count(*) FILTER (len > 200) AS large, count(*) AS packets FROM p"))
def par_count(spark, sf):
    p = derived.packets(spark, sf)
    return p.agg(F.count_if(F.col("flags") == 2).alias("syn"), F.count_if(F.col("pay") + 54 > 200).alias("large"), F.count("*").alias("packets"))
