"""Flow tracking over unbounded packet streams.

Event time comes from ts_ns. Aggregates use a watermark; the TCP states of flows are kept as arbitrary
keyed state with event-time timeouts, which are the idle limits. Unlike the batch form, which never
splits a flow, a stream emits a flow when it has been idle for its limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wirelark.operators.flow import KEY, STATES, FlowConfig, step, symbol

STATE = "state int, last_index long, start_ns long, last_ns long, packets long, bytes long"
KEYS = "addr_a binary, port_a int, addr_b binary, port_b int, protocol string"
OUT = KEYS + ", tcp_state string, start_ns long, last_ns long, packets long, bytes long"


def timed(p: DataFrame) -> DataFrame:
    return p.withColumn("event_time", F.timestamp_micros((F.col("ts_ns") / 1000).cast("bigint")))


def windowed_stats(p: DataFrame, window: str = "1 minute", slide: str | None = None, late: str = "2 minutes") -> DataFrame:
    """Packets and bytes of each flow per tumbling or sliding window; later packets than the watermark are dropped."""
    t = timed(p).withWatermark("event_time", late)
    w = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    return t.groupBy(w.alias("w"), *KEY).agg(F.count("*").alias("packets"), F.sum("len").alias("bytes")).select(F.col("w.start").alias("window_start"), *KEY, "packets", "bytes")


def session_stats(p: DataFrame, gap: str = "120 seconds", late: str = "2 minutes") -> DataFrame:
    """Packets and bytes of each flow's sessions: the idle limit as a session window."""
    t = timed(p).withWatermark("event_time", late)
    return t.groupBy(F.session_window("event_time", gap).alias("w"), *KEY).agg(F.count("*").alias("packets"), F.sum("len").alias("bytes")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *KEY, "packets", "bytes")


def running_stats(p: DataFrame) -> DataFrame:
    """Flow totals so far, for complete or update output."""
    return p.groupBy(*KEY).agg(F.count("*").alias("packets"), F.sum("len").alias("bytes"), F.count_if("forward").alias("forward_packets"))


def limit_ms(protocol: str, state: int, config: FlowConfig) -> int:
    if protocol != "TCP":
        return 1000 * config.udp_timeout_s
    return 1000 * (config.tcp_half_open_timeout_s if STATES[state] in ("LISTEN", "SYN_SENT", "SYN_RCVD") else config.tcp_established_timeout_s)


def tracked_flows(p: DataFrame, config: FlowConfig = FlowConfig(), late: str = "10 seconds") -> DataFrame:
    """Flows emitted once they are idle past their limit: KEY, tcp_state, start_ns, last_ns, packets, bytes."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            s, _, start, last, n, size = held.get
            held.remove()
            yield pd.DataFrame([(*key, STATES[s] if key[4] == "TCP" else None, start, last, n, size)], columns=[c.split()[0] for c in OUT.split(", ")])
            return
        s, top, start, last, n, size = held.get if held.exists else (0, -1, None, None, 0, 0)
        for f in frames:
            f = f.sort_values("packet_index")
            for index, ts, length, sym in zip(f["packet_index"], f["ts_ns"], f["len"], f["sym"]):
                s = STATES.index(step(STATES[s], *(bool(int(sym) >> i & 1) for i in range(5))))
                start = int(ts) if start is None else start
                top, last, n, size = int(index), int(ts), n + 1, size + int(length)
        held.update((s, top, start, last, n, size))
        held.setTimeoutTimestamp(max(last // 1_000_000 + limit_ms(key[4], s, config), held.getCurrentWatermarkMs() + 1))

    sym = F.when(F.col("protocol") == "TCP", symbol(F.col("flags"), F.col("forward"))).otherwise(0)
    t = timed(p).withWatermark("event_time", late).select(*KEY, "packet_index", "ts_ns", "len", sym.alias("sym"), "event_time")
    return t.groupBy(*KEY).applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_once(out: DataFrame, table: str, mode: str, checkpoint: str) -> None:
    """Process what there is into an in-memory table and stop."""
    out.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Sniffer:
    """Live capture over a rotation folder: a streaming query with filter, count, timeout and stop test.

    prn is called with each batch's rows; stop_filter with each row, and the row that stops it is kept.
    """

    def __init__(self, spark, folder: str, checkpoint: str, filter: str | None = None, count: int = 0, prn=None, stop_filter=None, most_files: int = 0):
        from wirelark.functions.bpf import compile_filter
        from wirelark.operators.dissect import dissect
        from wirelark.sources.pcap import stream_captures

        d = dissect(stream_captures(spark, folder, most_files))
        self.packets = d.where(compile_filter(filter)) if filter else d
        self.checkpoint, self.count, self.prn, self.stop_filter, self.rows, self.query = checkpoint, count, prn, stop_filter, [], None

    def _batch(self, df: DataFrame, _: int) -> None:
        for row in df.orderBy("source_file", "packet_index").toLocalIterator():
            if self.count and len(self.rows) >= self.count:
                self.done = True
                return
            self.rows.append(row)
            if self.prn:
                self.prn(row)
            if self.stop_filter and self.stop_filter(row):
                self.done = True
                return

    def start(self, once: bool = False) -> Sniffer:
        self.done = False
        w = self.packets.writeStream.foreachBatch(lambda df, n: None if self.done else self._batch(df, n)).option("checkpointLocation", self.checkpoint)
        self.query = (w.trigger(availableNow=True) if once else w).start()
        return self

    def wait(self, timeout: float | None = None) -> list:
        """Rows captured when the query ends, the time is up, or a stop test holds."""
        import time

        end = None if timeout is None else time.monotonic() + timeout
        while self.query.isActive and not self.done and (end is None or time.monotonic() < end):
            self.query.awaitTermination(0.2)
        self.stop()
        return self.rows

    def stop(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()

    def stats(self) -> dict:
        last = self.query.lastProgress if self.query else None
        return {"received": len(self.rows), "input_rows": last["numInputRows"] if last else 0}

    def __enter__(self) -> Sniffer:
        return self.start()

    def __exit__(self, *_) -> None:
        self.stop()


def sniff(spark, folder: str, checkpoint: str, filter: str | None = None, count: int = 0, timeout: float | None = None, prn=None, stop_filter=None) -> list:
    """Packets captured until count, timeout or the stop test; without any of them, what is there now."""
    s = Sniffer(spark, folder, checkpoint, filter, count, prn, stop_filter)
    return s.start(once=timeout is None).wait(timeout)
