"""TCP stream reassembly per flow and direction, in capture order.

Only flows that reach ESTABLISHED and carry payload are gathered; the rest never leave the statistics.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.functions.net import TCP_FLAGS
from wirelark.operators.flow import KEY, FlowConfig, step

WRAP = 1 << 32


def ahead(a: int, b: int) -> int:
    """How far a is past b modulo 2^32, as a signed number."""
    d = (a - b) % WRAP
    return d - WRAP if d >= WRAP // 2 else d


@dataclass
class Stream:
    """One direction's bytes in order, and the segments that wait for a gap to fill."""

    most_segments: int
    most_bytes: int
    expected: int | None = None
    done: bytearray = field(default_factory=bytearray)
    waiting: dict[int, bytes] = field(default_factory=dict)
    order: list[int] = field(default_factory=list)
    held: int = 0
    count: int = 0

    def add(self, seq: int, data: bytes) -> bool:
        """Take a segment; False where it had to be dropped."""
        if self.expected is None:
            self.expected = seq
        gap = ahead(seq, self.expected)
        if ahead((seq + len(data)) % WRAP, self.expected) <= 0:
            return True
        if gap <= 0:
            self.extend(data[-gap:])
            self.drain()
            return True
        if self.count >= self.most_segments or self.held + len(data) > self.most_bytes:
            return False
        if seq not in self.waiting:
            bisect.insort(self.order, seq)
        # a segment that comes again replaces the bytes but counts again
        self.waiting[seq] = data
        self.held, self.count = self.held + len(data), self.count + 1
        return True

    def extend(self, data: bytes) -> None:
        self.done += data
        self.expected = (self.expected + len(data)) % WRAP

    def drain(self) -> None:
        """Release waiting segments from the highest start at or below the expected number, in plain numeric order."""
        while (at := bisect.bisect_right(self.order, self.expected)) > 0:
            seq = self.order.pop(at - 1)
            data = self.waiting.pop(seq)
            self.held, self.count = self.held - len(data), self.count - 1
            if ahead((seq + len(data)) % WRAP, self.expected) > 0:
                self.extend(data[-ahead(seq, self.expected) or 0 :])


class Conversation:
    """The state of one TCP flow and its two streams."""

    def __init__(self, most_segments: int, most_bytes: int):
        self.state, self.first = "LISTEN", {}
        self.streams = {d: Stream(most_segments, most_bytes) for d in (True, False)}
        self.dropped = {True: 0, False: 0}

    def packet(self, forward: bool, flags: int, seq: int, payload: bytes) -> None:
        syn, ack, fin, rst = (bool(flags >> TCP_FLAGS.index(c) & 1) for c in "SAFR")
        if self.state == "ESTABLISHED" and not rst and payload and not self.streams[forward].add(seq, payload):
            self.dropped[forward] += 1
        if not rst and (self.state == "LISTEN" and syn and not ack or self.state == "SYN_SENT" and syn and ack):
            self.first[forward] = seq
        after = step(self.state, syn, ack, fin, rst, forward)
        if self.state == "SYN_RCVD" and after == "ESTABLISHED":
            for d, s in self.first.items():
                if self.streams[d].expected is None:
                    self.streams[d].expected = (s + 1) % WRAP
        self.state = after

    def result(self) -> tuple[bytes | None, bytes | None, int, int]:
        return bytes(self.streams[True].done) or None, bytes(self.streams[False].done) or None, self.dropped[True], self.dropped[False]


def reassemble(rows, most_segments: int, most_bytes: int) -> tuple[bytes | None, bytes | None, int, int]:
    """(forward, reverse, dropped forward, dropped reverse) of rows (forward, flags, seq, payload) in capture order."""
    c = Conversation(most_segments, most_bytes)
    for forward, flags, seq, payload in rows:
        c.packet(bool(forward), int(flags), int(seq), payload)
    return c.result()


def tcp_streams(p: DataFrame, config: FlowConfig = FlowConfig()) -> DataFrame:
    """KEY, reassembled_forward, reassembled_reverse and dropped_segments_fwd/rev of flows of packets().

    Packets are sorted by flow and index within partitions and streamed through, so a task holds one
    flow's state at a time, not the flow's packets.
    """
    tcp = p.where("protocol = 'TCP'").select(*KEY, "packet_index", "forward", "flags", "seq", "payload", "payload_len")
    opened = (F.col("flags").bitwiseAND(2) != 0) & (F.col("flags").bitwiseAND(16) == 0)
    able = tcp.groupBy(*KEY).agg(F.max("payload_len").alias("m"), F.max(F.when(opened, 1).otherwise(0)).alias("o")).where("m > 0 and o = 1").select(*KEY)
    segments, most = config.max_ooo_fragments, config.max_reassembly_buffer
    names = [*KEY, "reassembled_forward", "reassembled_reverse", "dropped_segments_fwd", "dropped_segments_rev"]

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, flow = None, None
        for f in frames:
            out = []
            for *key, forward, flags, seq, payload in zip(*(f[c] for c in KEY), f["forward"], f["flags"], f["seq"], f["payload"]):
                if key != own:
                    if flow is not None:
                        out.append((*own, *flow.result()))
                    own, flow = key, Conversation(segments, most)
                flow.packet(bool(forward), int(flags), int(seq), payload)
            yield pd.DataFrame(out, columns=names)
        if flow is not None:
            yield pd.DataFrame([(*own, *flow.result())], columns=names)

    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in KEY) + ", reassembled_forward binary, reassembled_reverse binary, dropped_segments_fwd long, dropped_segments_rev long"
    return tcp.join(able, KEY, "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, "packet_index").mapInPandas(build, schema)
