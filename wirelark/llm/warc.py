"""WARC archives: a writer of one gzip member per record and a sequential reader.

The writer runs per partition and streams records into archives in the folder all executors share,
each under a fresh name; only the names that successful tasks return are read, so retried tasks leave
no false records. The reader inflates an archive step by step with zlib, frames each record by its
Content-Length, and verifies block and payload digests as it goes; it holds one buffer, not the archive.

Defined results: a null html is an empty payload. Of equal payloads of at least ``least_bytes`` bytes
the record with the largest page_id is the response and the others revisit it; rows that repeat that
page_id are responses too, and where all page_ids are null all are responses. Damaged or cut archives
raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.llm.common import fresh_path, materialise, text_batches

STEP = 1 << 16
#: Digests that occur more than once are broadcast up to this number of them (about 100 bytes each).
MOST_BROADCAST = 500_000
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def uri_page(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One gzip member holding a response record, or a revisit record without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if 33 <= ord(c) < 127 else f"%{ord(c):02X}" if ord(c) < 128 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", page_uri(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", sha1_label(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", sha1_label(hashlib.sha1(block).digest())),
        *([("WARC-Refers-To", page_uri(refers_to)), ("WARC-Profile", PROFILE)] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head.encode()) + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush()


class Member:
    """One gzip member of a stream, inflated as it is asked for."""

    def __init__(self, stream: BinaryIO, rest: bytes):
        self.stream, self.gz, self.pending, self.out = stream, zlib.decompressobj(31), rest, b""

    def fill(self) -> bool:
        """Inflate a little more; False at the end of the member."""
        while not self.gz.eof:
            data = self.pending or self.stream.read(STEP)
            if not data:
                raise ValueError("archive ends inside a record")
            try:
                made = self.gz.decompress(data, STEP)
            except zlib.error as e:
                raise ValueError(f"damaged record: {e}") from e
            self.pending = self.gz.unconsumed_tail or self.gz.unused_data
            if made:
                self.out += made
                return True
        return False

    def line(self) -> bytes:
        while (at := self.out.find(b"\r\n")) < 0:
            if not self.fill():
                raise ValueError("record ends inside its header")
        got, self.out = self.out[:at], self.out[at + 2 :]
        return got

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.out and not self.fill():
                raise ValueError("record is shorter than its Content-Length")
            piece, self.out = self.out[:n], self.out[n:]
            n -= len(piece)
            yield piece

    def close(self) -> bytes:
        """Check the end of the record; what follows the member."""
        while self.fill():
            pass
        if self.out != b"\r\n\r\n":
            raise ValueError("record isn't followed by two line ends")
        return self.pending


def headers(member: Member) -> dict[str, str]:
    found = {}
    while line := member.line():
        name, _, value = line.decode().partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def read_records(stream: BinaryIO) -> Iterator[tuple]:
    """Rows of RECORDS of one archive, verified."""
    rest = b""
    while rest or (rest := stream.read(STEP)):
        member = Member(stream, rest)
        if member.line() != b"WARC/1.1":
            raise ValueError("no WARC record")
        h = headers(member)
        length, whole, payload, http, size = int(h["content-length"]), hashlib.sha1(), hashlib.sha1(), b"", None
        seen = 0
        for piece in member.take(length):
            whole.update(piece)
            if size is None:
                http += piece
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                lines = http[:at].decode("latin-1").lower().split("\r\n")
                size = int(next(x for x in lines if x.startswith("content-length:")).split(":")[1])
                piece = http[at + 4 :]
            payload.update(piece)
            seen += len(piece)
        if sha1_label(whole.digest()) != h["warc-block-digest"]:
            raise ValueError("block digest differs")
        revisit = h["warc-type"] == "revisit"
        if not revisit and (seen != size or sha1_label(payload.digest()) != h["warc-payload-digest"]):
            raise ValueError("payload digest differs")
        rest = member.close()
        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
        yield uri_page(h["warc-record-id"]), size, digest, h["warc-type"], uri_page(h["warc-refers-to"]) if revisit else None


def with_decisions(pages: DataFrame, least_bytes: int, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, html, revisit, refers_to.

    Only digests are shuffled; those that occur more than once are broadcast, and payloads stay where they
    are read. Where more than ``most_broadcast`` digests repeat, large payloads are joined by digest, the
    digests of very many pages still by broadcast; small payloads never are.
    """
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), (F.coalesce(F.octet_length("html"), F.lit(0)) >= least_bytes).alias("large"))
    counted = rows.where("large").groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("kept"))
    shared = materialise(counted.where("n > 1"))
    sizes = shared.agg(F.count("*").alias("digests"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if sizes.digests <= most_broadcast:
        known = F.broadcast(shared.select(F.col("digest").alias("shared"), "kept"))
        joined = rows.join(known, (F.col("digest") == F.col("shared")) & F.col("large"), "left")
    else:
        heavy = F.col("n") >= max(1000, sizes.rows // 10_000)  # at most 10,000
        named = shared.select(F.col("digest").alias("shared"), "kept", heavy.alias("heavy"))
        often = F.broadcast(named.where("heavy").select("shared", "kept"))
        first = rows.join(often, (F.col("digest") == F.col("shared")) & F.col("large"), "left").drop("shared")
        done = first.where("kept IS NOT NULL OR NOT large")
        others = first.where("kept IS NULL AND large").drop("kept").join(named.where("NOT heavy").select("shared", "kept"), F.col("digest") == F.col("shared"), "left")
        joined = done.unionByName(others.drop("shared"))
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("kept")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page into archives under folder (a URI); one row per archive: MANIFEST."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, count, size = None, "", 0, 0
        for f in frames:
            for page, url, html, revisit, refers in zip(f.page_id, f.url, f.html, f.revisit, f.refers_to):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                made = record(None if pd.isna(page) else int(page), url, (html or "").encode(), None if pd.isna(refers) else int(refers), bool(revisit))
                out.write(made)
                count, size = count + 1, size + len(made)
                if size >= archive_bytes:
                    out.close()
                    yield pd.DataFrame({"archive": [name], "records": [count]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [name], "records": [count]})

    # Page numbers go as decimals: pandas would turn a column with nulls into floats.
    rows = with_decisions(text_batches(pages), least_bytes).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialise(rows.mapInPandas(write, MANIFEST))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives named in a manifest: RECORDS. Each archive is read in one pass by one task."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for f in frames:
            for name, count in zip(f.archive, f.records):
                rows, total = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for row in read_records(stream):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, total = [], total + 10_000
                if total + len(rows) != count:
                    raise ValueError(f"{name}: {total + len(rows)} records, {count} written")
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    archives = max(1, manifest.count())
    return manifest.repartition(archives).mapInPandas(read, RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write pages to fresh archives in the shared folder and read them back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes), folder)
