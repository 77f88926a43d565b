"""Capture files as a Spark data source: batch and streaming reader, and writer, of pcap and pcapng.

Files are read through the file system of their URI, one partition per stretch of a capture. A short
walk over record headers finds the stretches, so that a large capture is read by many tasks; the walk
reads headers only, in steps. Truncated tails end a file.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "packet_index bigint, ts_ns bigint, ts timestamp, cap_len int, orig_len bigint, link_type int, interface_id bigint, comment string, source_file string, frame binary"
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
#: Magic numbers: (byte order, nanoseconds per fraction unit).
MAGICS = {b"\xa1\xb2\xc3\xd4": (">", 1000), b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1)}
NG_MAGIC = b"\x0a\x0d\x0d\x0a"
MOST_RECORD = 64 << 20
STRETCH_BYTES = 64 << 20
ROWS = 4096


class CaptureError(ValueError):
    pass


def detect_format(magic: bytes) -> str:
    """'pcap' or 'pcapng' from the first four bytes."""
    if magic in MAGICS:
        return "pcap"
    if magic == NG_MAGIC:
        return "pcapng"
    raise CaptureError(f"no capture file: starts with {magic.hex()}")


@dataclass
class Record:
    ts_ns: int
    orig_len: int
    link_type: int
    interface: int | None
    data: bytes


class PcapRecords:
    """Records of a classic capture from a byte offset on; (offset, record) pairs."""

    def __init__(self, f, header: bytes):
        if len(header) < 24:
            raise CaptureError("capture header is cut")
        self.f, (self.order, self.unit) = f, MAGICS[header[:4]]
        self.link = struct.unpack(self.order + "I", header[20:24])[0]

    def read(self, at: int, stop: int | None, headers_only: bool = False) -> Iterator[tuple[int, Record]]:
        self.f.seek(at)
        while stop is None or at < stop:
            head = self.f.read(16)
            if len(head) < 16:
                return
            sec, frac, size, orig = struct.unpack(self.order + "4I", head)
            if size > MOST_RECORD:
                raise CaptureError(f"record of {size} bytes at {at}")
            if headers_only:
                self.f.seek(at + 16 + size)
                data = b""
            else:
                data = self.f.read(size)
                if len(data) < size:
                    return
            yield at, Record(sec * 1_000_000_000 + frac * self.unit, orig, self.link, None, data)
            at += 16 + size


def pcapng_records(f) -> Iterator[Record]:
    """Packets of enhanced and simple packet blocks; other blocks are passed over."""
    order, interfaces = "<", []
    while len(head := f.read(8)) == 8:
        if head[:4] == NG_MAGIC:
            magic = f.read(4)
            order = "<" if magic == b"\x4d\x3c\x2b\x1a" else ">"
            size = struct.unpack(order + "I", head[4:])[0]
            f.read(max(0, size - 12))
            interfaces = []
            continue
        kind, size = struct.unpack(order + "2I", head)
        if size < 12 or size > MOST_RECORD:
            raise CaptureError(f"block of {size} bytes")
        body = f.read(size - 8)
        if len(body) < size - 8:
            return
        if kind == 1:
            link = struct.unpack(order + "H", body[:2])[0]
            unit, at = (10**9, 10**6), 8
            while at + 4 <= len(body) - 4:
                code, n = struct.unpack(order + "2H", body[at : at + 4])
                if code == 0:
                    break
                if code == 9:
                    r = body[at + 4]
                    unit = (10**9, 2 ** (r & 127) if r & 128 else 10**r)
                at += 4 + n + (-n % 4)
            interfaces.append((link, unit))
        elif kind == 6:
            which, high, low, cap, orig = struct.unpack(order + "5I", body[:20])
            link, (ns, ticks) = interfaces[which] if which < len(interfaces) else (1, (10**9, 10**6))
            yield Record((high << 32 | low) * ns // ticks, orig, link, which, body[20 : 20 + cap])
        elif kind == 3:
            orig = struct.unpack(order + "I", body[:4])[0]
            data = body[4 : len(body) - 4][:orig]
            yield Record(0, orig, interfaces[0][0] if interfaces else 1, 0, data)


def store_of(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def capture_files(path: str) -> list[str]:
    """The capture itself, or the captures in a folder by name."""
    from pyarrow import fs

    store, own = store_of(path)
    info = store.get_file_info(own)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise CaptureError(f"no such capture: {path}")
    names = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(own)) if i.type == fs.FileType.File and i.base_name.lower().endswith((".pcap", ".pcapng", ".cap")))
    return [f"{path.rstrip('/')}/{n}" for n in names]


@dataclass
class Stretch(InputPartition):
    """Records of a file from a byte offset up to another, numbered from first."""

    path: str
    first: int
    start: int
    stop: int | None


def stretches(path: str, size: int = STRETCH_BYTES) -> list[Stretch]:
    """A classic capture cut at record starts; a pcapng file whole."""
    store, own = store_of(path)
    with store.open_input_file(own) as f:
        head = f.read(24)
        if not head:
            return []
        if detect_format(head[:4]) == "pcapng" or f.size() <= size:
            return [Stretch(path, 0, 24, None)]
        cuts, index = [(24, 0)], 0
        for at, _ in PcapRecords(f, head).read(24, None, headers_only=True):
            if at - cuts[-1][0] >= size:
                cuts.append((at, index))
            index += 1
    return [Stretch(path, n, at, cuts[i + 1][0] if i + 1 < len(cuts) else None) for i, (at, n) in enumerate(cuts)]


ARROW = pa.schema([("packet_index", pa.int64()), ("ts_ns", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("cap_len", pa.int32()), ("orig_len", pa.int64()), ("link_type", pa.int32()), ("interface_id", pa.int64()), ("comment", pa.string()), ("source_file", pa.string()), ("frame", pa.binary())])


def batches(stretch: Stretch, mode: str, limit: int | None, since_ns: int | None = None, until_ns: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a stretch; times out of bounds are left out before rows are made."""
    store, own = store_of(stretch.path)
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ARROW.types)], schema=ARROW)

    with store.open_input_file(own) as raw:
        head = raw.read(24)
        if len(head) < 4:
            return
        if detect_format(head[:4]) == "pcap":
            found = (r for _, r in PcapRecords(raw, head).read(stretch.start, stretch.stop))
        else:
            raw.seek(0)
            found = pcapng_records(io.BufferedReader(raw, 1 << 20))
        index = stretch.first
        try:
            for r in found:
                if limit is not None and index >= limit:
                    break
                if (since_ns is None or r.ts_ns >= since_ns) and (until_ns is None or r.ts_ns <= until_ns):
                    rows.append((index, r.ts_ns, r.ts_ns // 1000, len(r.data), r.orig_len, r.link_type, r.interface, None, stretch.path, r.data))
                index += 1
                if len(rows) == ROWS:
                    yield made()
                    rows = []
        except (CaptureError, struct.error) as e:
            if mode == "FAILFAST":
                raise CaptureError(f"{stretch.path}: {e}") from e
    if rows:
        yield made()


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "PERMISSIVE").upper()
        self.count = int(options.get("count", 0)) or None
        self.size = int(options.get("stretchbytes", STRETCH_BYTES))
        self.since: int | None = None
        self.until: int | None = None
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")

    def pushFilters(self, filters):
        """Bounds on ts_ns are applied before rows are made; Spark applies the rest."""
        for f in filters:
            bound = isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo))
            if bound and f.attribute == ("ts_ns",) and isinstance(f.value, int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.since = max(self.since or f.value, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.until = min(self.until if self.until is not None else f.value, f.value)
            yield f

    def partitions(self) -> list[Stretch]:
        found = []
        for path in capture_files(self.path):
            try:
                found += stretches(path, self.size)
            except CaptureError:
                if self.mode == "FAILFAST":
                    raise
        return found or [Stretch("", 0, 0, None)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from batches(partition, self.mode, self.count, self.since, self.until)


class PcapStream(DataSourceStreamReader):
    """New captures of a rotation folder; an offset is the number of captures seen, by name."""

    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "PERMISSIVE").upper()
        self.most = int(options.get("maxfilespertrigger", 0))
        self.seen = 0

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        there = len(capture_files(self.path))
        self.seen = min(there, self.seen + self.most) if self.most else there
        return {"files": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.seen = max(self.seen, end["files"])
        return [s for path in capture_files(self.path)[start["files"] : end["files"]] for s in stretches(path)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        yield from batches(partition, self.mode, None)

    def commit(self, end: dict) -> None:
        pass


def pcap_header(link_type: int = 1, snaplen: int = 65535, nanoseconds: bool = False) -> bytes:
    return struct.pack("<I2Hi3I", 0xA1B23C4D if nanoseconds else 0xA1B2C3D4, 2, 4, 0, 0, snaplen, link_type)


def pcap_record(ts_ns: int, orig_len: int, data: bytes, nanoseconds: bool = False) -> bytes:
    sec, ns = divmod(ts_ns, 1_000_000_000)
    return struct.pack("<4I", sec, ns if nanoseconds else ns // 1000, len(data), orig_len) + data


def pcapng_header(link_type: int = 1, snaplen: int = 65535, nanoseconds: bool = False) -> bytes:
    section = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    option = struct.pack("<HHB3xHH", 9, 1, 9, 0, 0) if nanoseconds else b""
    size = 20 + len(option)
    return section + struct.pack("<IIHHI", 1, size, link_type, 0, snaplen) + option + struct.pack("<I", size)


def pcapng_record(ts_ns: int, orig_len: int, data: bytes, nanoseconds: bool = False) -> bytes:
    ticks, pad = ts_ns if nanoseconds else ts_ns // 1000, -len(data) % 4
    size = 32 + len(data) + pad
    return struct.pack("<IIIIIII", 6, size, 0, ticks >> 32, ticks & 0xFFFFFFFF, len(data), orig_len) + data + b"\0" * pad + struct.pack("<I", size)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class PcapWriter(DataSourceWriter):
    """One capture per task under a folder; a task's rows go in the order of the partition."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.ng = options["path"], options.get("format", "pcapng" if options["path"].endswith(".pcapng") else "pcap") == "pcapng"
        self.ns, self.link = options.get("nanoseconds", "false") == "true", int(options.get("linktype", 1))
        self.names = schema.fieldNames()
        if "frame" not in self.names:
            raise ValueError("a capture needs a column frame")

    def write(self, rows) -> Written:
        from uuid import uuid4

        store, own = store_of(self.path)
        store.create_dir(own, recursive=True)
        name = f"part-{uuid4().hex}.{'pcapng' if self.ng else 'pcap'}"
        head, rec = (pcapng_header, pcapng_record) if self.ng else (pcap_header, pcap_record)
        any_row = False
        with store.open_output_stream(f"{own}/.{name}") as out:
            out.write(head(self.link, 65535, self.ns))
            for r in rows:
                d = r.asDict()
                if d["frame"] is None:
                    continue
                any_row, data = True, bytes(d["frame"])
                out.write(rec(d.get("ts_ns") or 0, d.get("orig_len") or len(data), data, self.ns))
        if not any_row:
            store.delete_file(f"{own}/.{name}")
        return Written([name] if any_row else [])

    def commit(self, messages) -> None:
        store, own = store_of(self.path)
        for m in messages:
            for name in m.files if m else []:
                store.move(f"{own}/.{name}", f"{own}/{name}")

    def abort(self, messages) -> None:
        store, own = store_of(self.path)
        for m in messages:
            for name in m.files if m else []:
                store.delete_file(f"{own}/.{name}")


class PcapDataSource(DataSource):
    """Format "pcap": options path, count, mode, stretchBytes; writing: format (pcap or pcapng), nanoseconds, linkType."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def lowered(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> PcapReader:
        return PcapReader(self.lowered())

    def streamReader(self, schema: StructType) -> PcapStream:
        return PcapStream(self.lowered())

    def writer(self, schema: StructType, overwrite: bool) -> PcapWriter:
        return PcapWriter(self.lowered(), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_capture(spark: SparkSession, path: str, count: int = 0, mode: str = "PERMISSIVE") -> DataFrame:
    """Packets of a capture or a folder of captures; count 0 reads all."""
    register(spark)
    df = spark.read.format("pcap").option("count", count).option("mode", mode).load(path)
    return df.limit(count) if count else df


rdpcap = read_capture


def stream_captures(spark: SparkSession, folder: str, max_files: int = 0) -> DataFrame:
    """Packets of captures as they appear in a rotation folder."""
    register(spark)
    return spark.readStream.format("pcap").option("maxFilesPerTrigger", max_files).load(folder)


def write_capture(df: DataFrame, path: str, fmt: str | None = None, nanoseconds: bool = False, single: bool = False) -> None:
    """Captures under a folder, one per partition; single: one capture in packet order, written by one task."""
    register(df.sparkSession)
    cols = [c for c in ("packet_index", "ts_ns", "orig_len", "frame") if c in df.columns]
    out = df.select(*cols)
    if single:
        out = out.coalesce(1).sortWithinPartitions("packet_index") if "packet_index" in cols else out.coalesce(1)
    w = out.write.format("pcap").mode("append").option("nanoseconds", str(nanoseconds).lower())
    (w.option("format", fmt) if fmt else w).save(path)


wrpcap = write_capture


def wrpcap_packets(df: DataFrame, path: str, fmt: str | None = None) -> None:
    """Plain frames: time zero, original length as captured."""
    write_capture(df.withColumns({"ts_ns": F.lit(0).cast("bigint"), "orig_len": F.length("frame").cast("bigint")}), path, fmt)


def wrpcapng(df: DataFrame, path: str) -> None:
    write_capture(df, path, "pcapng")
