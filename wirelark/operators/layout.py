"""Where the layers of frames lie: one vectorised pass over an Arrow batch of frames.

The bytes of a batch stay in Arrow's buffer; header bytes are gathered for all frames at once with numpy.
Only payloads on text-protocol ports are looked at one by one. The result is a struct of small
integers per frame, from which Catalyst expressions slice whatever a query asks for.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelark.functions.detect import FTP_COMMANDS, HTTP2_PREFACE, HTTP_METHODS, IMAP_COMMANDS, IMAP_STATUSES, MQTTSN_TYPES, POP3_COMMANDS, SMTP_COMMANDS

#: Layer kinds by number; 0 is none.
KINDS = ["", "Ethernet", "IPv4", "IPv6", "ARP", "Raw", "TCP", "UDP", "ICMP", "ICMPv6", "SSH", "Modbus", "MQTT", "FTP", "SMTP", "POP3", "IMAP", "TPKT", "IEC104", "DNP3", "TLS", "HTTP2", "HTTP", "DNS", "QUIC", "L2TP", "MQTTSN", "TFTP", "DHCP", "CoAP", "S7Comm"]
NUMBER = {k: i for i, k in enumerate(KINDS)}
ERRORS = ["", "IPv4: too short", "IPv4: header length", "IPv4: header cut", "IPv6: too short", "ARP: too short", "TCP: too short", "UDP: too short", "ICMP: too short"]
#: Places are -1 where there is none.
FIELDS = "error net l3 l4 proto tp l5 sport dport seq ack flags window app app_end box cotp_end s7 inner inner_tp inner_end vlan icmp_type icmp_code icmp_id icmp_seq forward port_a port_b".split()
SCHEMA = ", ".join(f"{f} long" for f in FIELDS) + ", addr_a binary, addr_b binary"
ICMP_ERRORS = np.array([3, 4, 5, 11, 12])
DIGITS = re.compile(rb"[0-9]{3}")
IMAP_TAG = re.compile(rb"([A-Za-z0-9]+) ([^ \n]*)")


class Frames:
    """A batch of byte strings in one buffer."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data, self.starts, self.sizes = np.append(data, np.zeros(8, np.uint8)), starts, sizes
        self.rows = np.arange(len(sizes))

    @staticmethod
    def of(batch: pa.Array) -> Frames:
        batch = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
        kind = np.int64 if pa.types.is_large_binary(batch.type) else np.int32
        _, offsets, data = batch.buffers()
        at = np.frombuffer(offsets, kind)[batch.offset : batch.offset + len(batch) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return Frames(raw, at[:-1], np.diff(at))

    def get(self, at: np.ndarray, n: int = 1, little: bool = False) -> np.ndarray:
        """Unsigned integer of n bytes at each frame's own place; -1 past the end or where the place is negative."""
        ok = (at >= 0) & (at + n <= self.sizes)
        where = np.where(ok, self.starts + at, 0)
        total = np.zeros(len(at), np.int64)
        for i in range(n):
            total = total | (self.data[where + i].astype(np.int64) << (8 * (i if little else n - 1 - i)))
        return np.where(ok, total, -1)

    def slices(self, at: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Byte strings at each frame's own place; NULL where the size is 0."""
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(self.starts + at - offsets[:-1], sizes) + np.arange(offsets[-1])
        made = self.data[where].tobytes()
        valid = np.packbits(sizes > 0, bitorder="little").tobytes()
        return pa.Array.from_buffers(pa.binary(), len(sizes), [pa.py_buffer(valid), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(made)])

    def bytes(self, row: int, at: int) -> bytes:
        return self.data[self.starts[row] + at : self.starts[row] + self.sizes[row]].tobytes()


def first_word(b: bytes) -> str | None:
    try:
        words = b.decode().split()
    except UnicodeDecodeError:
        return None
    return words[0].upper() if words else ""


def is_text_protocol(kind: str, b: bytes) -> bool:
    """The tests of FTP, SMTP, POP3 and IMAP payloads."""
    if kind == "POP3":
        return b.startswith((b"+OK", b"-ERR")) or first_word(b) in POP3_COMMANDS
    if len(b) < 3:
        return False
    if kind == "IMAP":
        if b.startswith((b"* ", b"+ ")) or b == b"+\r\n":
            return True
        if first_word(b) is None or not (m := IMAP_TAG.match(b)):
            return False
        return m[2].rstrip(b"\r").decode().upper() in {*IMAP_STATUSES, *IMAP_COMMANDS}
    if DIGITS.match(b):
        return b[3:4] in ((b" ", b"-", b"\r", b"\n") if kind == "FTP" else (b" ", b"-", b"\r", b"\n", b""))
    return first_word(b) in (FTP_COMMANDS if kind == "FTP" else SMTP_COMMANDS)


def mqtt_length_ok(f: Frames, at: np.ndarray) -> np.ndarray:
    ok, open_ = np.zeros(len(at), bool), np.ones(len(at), bool)
    for i in range(4):
        x = f.get(np.where(at >= 0, at + i, -1))
        ok |= open_ & (x >= 0) & (x < 128)
        open_ &= x >= 128
    return ok


def tcp_app(f: Frames, at: np.ndarray, sport: np.ndarray, dport: np.ndarray) -> np.ndarray:
    """Kind number of TCP payloads at at (-1: none)."""
    size = np.where(at >= 0, f.sizes - at, 0)
    app = np.where(size > 0, NUMBER["Raw"], 0)
    port = lambda *ps: np.isin(sport, ps) | np.isin(dport, ps)
    look = lambda off, n=1: f.get(np.where(at >= 0, at + off, -1), n)
    left = size > 0

    def settle(kind: str, yes: np.ndarray) -> None:
        nonlocal left
        app[left & yes] = NUMBER[kind]
        left = left & ~yes

    def texts(kind: str, *ports: int) -> None:
        rows = np.flatnonzero(left & port(*ports))
        yes = np.zeros(len(at), bool)
        for r in rows:
            yes[r] = is_text_protocol(kind, f.bytes(r, int(at[r])))
        settle(kind, yes)

    w0, b0, b1 = look(0, 4), look(0), look(1)
    pad = look(4)
    settle("SSH", port(22) & ((w0 == 0x5353482D) | (w0 >= 12) & (w0 <= 35000) & (pad >= 4) & (pad < w0)))
    mlen = look(4, 2)
    settle("Modbus", port(502) & (size >= 8) & (look(2, 2) == 0) & (mlen >= 2) & (mlen + 6 <= size + 256))
    settle("MQTT", port(1883) & (size >= 2) & (b0 >= 16) & mqtt_length_ok(f, np.where(at >= 0, at + 1, -1)))
    texts("FTP", 21), texts("SMTP", 25, 587, 465), texts("POP3", 110), texts("IMAP", 143)
    settle("TPKT", port(102) & (size >= 4) & (look(0, 2) == 0x0300))
    settle("IEC104", port(2404) & (size >= 6) & (b0 == 0x68))
    settle("DNP3", port(20000) & (look(0, 2) == 0x0564))
    version = look(1, 2)
    known = (version >= 0x300) & (version <= 0x304) | (version >= 0x7F00) & (version <= 0x7FFF)
    settle("TLS", (size >= 5) & np.where((b0 >= 20) & (b0 <= 24), known & (look(3, 2) <= 18437), b0 >= 0x80))
    preface = look(0, 4) == int.from_bytes(HTTP2_PREFACE[:4].encode(), "big")
    for r in np.flatnonzero(preface & left):
        preface[r] = f.bytes(r, int(at[r])).startswith(HTTP2_PREFACE.encode())
    settle("HTTP2", preface | (size >= 9) & (look(0, 3) <= 16384) & (look(3) <= 9) & (look(5) < 0x80))
    http = look(0, 5) == int.from_bytes(b"HTTP/", "big")
    for m in HTTP_METHODS:
        head = f"{m} ".encode()
        n = min(len(head), 7)
        same = look(0, n) == int.from_bytes(head[:n], "big")
        if len(head) > n:
            same &= look(n, len(head) - n) == int.from_bytes(head[n:], "big")
        http |= same
    settle("HTTP", http)
    return app


def udp_app(f: Frames, at: np.ndarray, sport: np.ndarray, dport: np.ndarray) -> np.ndarray:
    """Kind number of UDP payloads at at (-1: none)."""
    size = np.where(at >= 0, f.sizes - at, 0)
    app = np.where(size > 0, NUMBER["Raw"], 0)
    port = lambda *ps: np.isin(sport, ps) | np.isin(dport, ps)
    look = lambda off, n=1: f.get(np.where(at >= 0, at + off, -1), n)
    b0 = look(0)
    long = b0 == 1
    sn = np.where(long, look(1, 2), b0)
    sn_kind = np.where(long, look(3), look(1))
    op, token = look(0, 2), b0 & 15
    rules = [
        ("DNS", port(53, 5353) & (size >= 12)), ("QUIC", port(443, 4433) & (b0 >= 0) & ((b0 & 0x40) != 0)), ("L2TP", port(1701) & (size >= 2) & ((look(1) & 15) == 2)),
        ("MQTTSN", port(1883) & (size >= 2) & (sn >= np.where(long, 4, 2)) & (sn <= size) & np.isin(sn_kind, MQTTSN_TYPES)), ("TFTP", port(69) & (op >= 1) & (op <= 5)), ("DHCP", port(67, 68) & (look(236, 4) == 0x63825363)),
        ("CoAP", port(5683, 5684) & (size >= 4) & ((b0 >> 6) == 1) & (token <= 8) & (size >= token + 4)), ("DNP3", port(20000) & (look(0, 2) == 0x0564)),
    ]
    left = size > 0
    for kind, yes in rules:
        app[left & yes] = NUMBER[kind]
        left &= ~yes
    return app


def lay_out(f: Frames, root: str, extended: bool) -> dict[str, np.ndarray]:
    """FIELDS of every frame."""
    n = f.sizes
    none = np.full(len(n), -1, np.int64)
    out = {k: none.copy() for k in FIELDS}
    pick = lambda yes, a, b=-1: np.where(yes, a, b)
    if root == "ethernet":
        kind = f.get(none + 13, 2)
        tagged = (kind == 0x8100) & extended
        l3 = pick(n >= 14, pick(tagged, 18, 14))
        out["vlan"] = pick(tagged & (f.get(none + 15, 2) >= 0), f.get(none + 15, 2) & 0xFFF)
        kind = pick(tagged, f.get(none + 17, 2), kind)
    else:
        l3, kind = none + 1, none + 1 + (0x0800 if root == "ipv4" else 0x86DD)
    v4, v6, arp = kind == 0x0800, kind == 0x86DD, kind == 0x0806
    net = pick(v4, NUMBER["IPv4"], pick(v6, NUMBER["IPv6"], pick(arp, NUMBER["ARP"], pick((l3 >= 0) & (n > l3) & (kind >= 0), NUMBER["Raw"], 0))))
    first = f.get(l3)
    ihl = 4 * (first & 15)
    hard, prot = f.get(pick(l3 >= 0, l3 + 4)), f.get(pick(l3 >= 0, l3 + 5))
    arp_end = l3 + 8 + 2 * hard + 2 * prot
    error = pick(v4, pick(n < l3 + 20, 1, pick(ihl < 20, 2, pick(n < l3 + ihl, 3, 0))), pick(v6 & (n < l3 + 40), 4, pick(arp & ((hard < 0) | (prot < 0) | (n < arp_end)), 5, 0)))
    l4 = pick((error == 0) & (l3 >= 0), pick(v4, l3 + ihl, pick(v6, l3 + 40, pick(arp, arp_end, -1))))
    inside = (l4 >= 0) & (v4 | v6)
    proto = pick(inside, f.get(pick(v4, l3 + 9, pick(v6, l3 + 6))))
    tp = pick(inside, pick(proto == 6, NUMBER["TCP"], pick(proto == 17, NUMBER["UDP"], pick(v4 & (proto == 1), NUMBER["ICMP"], pick(v6 & (proto == 58), NUMBER["ICMPv6"], pick(n > l4, NUMBER["Raw"], 0))))), pick(arp & (l4 >= 0) & (n > l4), NUMBER["Raw"], 0))
    tcp, udp, icmp = tp == NUMBER["TCP"], tp == NUMBER["UDP"], (tp == NUMBER["ICMP"]) | (tp == NUMBER["ICMPv6"])
    error = pick(error > 0, error, pick(tcp & (n < l4 + 20), 6, pick(udp & (n < l4 + 8), 7, pick(icmp & (n < l4 + 8), 8, 0))))
    fine = error == 0
    word = f.get(pick(tcp & fine, l4 + 12), 2)
    l5 = pick(fine & tcp, np.minimum(l4 + 4 * (word >> 12), n), pick(fine & udp, l4 + 8))
    ported = l5 >= 0
    sport, dport = f.get(pick(ported, l4), 2), f.get(pick(ported, l4 + 2), 2)
    app = pick(tcp, tcp_app(f, pick(ported & tcp, l5), sport, dport), udp_app(f, pick(ported & udp, l5), sport, dport))
    is_ = lambda k: app == NUMBER[k]
    look = lambda yes, at, size=1: f.get(pick(yes, at), size)
    end = n.copy()
    ssh = is_("SSH")
    end = pick(ssh, np.minimum(l5 + 4 + look(ssh, l5, 4), n), end)
    for r in np.flatnonzero(ssh):
        b = f.bytes(r, int(l5[r]))
        if b.startswith(b"SSH-"):
            stop = b.find(b"\r\n")
            end[r] = n[r] if stop < 0 else l5[r] + stop + 2
    end = pick(is_("TLS"), np.minimum(l5 + 5 + look(is_("TLS"), l5 + 3, 2), n), end)
    tpkt = is_("TPKT")
    end = pick(tpkt, l5 + 4, end)
    stop = np.minimum(l5 + look(tpkt, l5 + 2, 2), n)
    cotp = tpkt & (l5 + 4 < stop) & (n >= l5 + 6)
    box = pick(cotp, stop)
    cend = pick(cotp, np.minimum(l5 + 5 + look(cotp, l5 + 4), n))
    more = cotp & (cend < box)
    s7 = more & (look(cotp, l5 + 5) >= 0xF0) & (n >= cend + 10) & (look(more, cend) == 0x32)
    kind4 = look(fine & (tp == NUMBER["ICMP"]), l4)
    at = l4 + 8
    ihl2 = 4 * (look(np.isin(kind4, ICMP_ERRORS) & (n > at), at) & 15)
    inner = pick(np.isin(kind4, ICMP_ERRORS) & (n >= at + 20) & (ihl2 >= 20) & (n >= at + ihl2), at + ihl2)
    held = inner >= 0
    p2 = look(held, l4 + 17)
    itp = pick(held, pick(p2 == 6, NUMBER["TCP"], pick(p2 == 17, NUMBER["UDP"], pick(p2 == 1, NUMBER["ICMP"], pick(n > inner, NUMBER["Raw"], 0)))), 0)
    iend = pick(itp == NUMBER["TCP"], pick(n >= inner + 20, np.minimum(inner + 4 * (look(held, inner + 12) >> 4), n)), pick(itp == NUMBER["UDP"], pick(n >= inner + 8, inner + 8), pick(itp == NUMBER["ICMP"], pick(n >= inner + 8, n), n)))
    itp = pick(iend >= 0, itp, 0)
    out |= {"error": error, "net": net, "l3": l3, "l4": l4, "proto": proto, "tp": tp, "l5": l5, "sport": sport, "dport": dport, "app": app, "app_end": end, "box": box, "cotp_end": cend, "inner": inner, "inner_tp": itp, "inner_end": iend}
    out |= {"seq": look(fine & tcp, l4 + 4, 4), "ack": look(fine & tcp, l4 + 8, 4), "flags": pick(word >= 0, word & 0x1FF), "window": look(fine & tcp, l4 + 14, 2), "s7": pick(more, pick(s7, NUMBER["S7Comm"], NUMBER["Raw"]), 0)}
    message = icmp & fine
    out |= {"icmp_type": look(message, l4), "icmp_code": look(message, l4 + 1), "icmp_id": look(message, l4 + 4, 2), "icmp_seq": look(message, l4 + 6, 2)}
    # the flow key: the lesser address, then the lesser port, comes first
    echo = v4 & np.isin(out["icmp_type"], (0, 8)) | v6 & np.isin(out["icmp_type"], (128, 129))
    sp = pick(ported, sport, pick(echo, out["icmp_id"], np.maximum(out["icmp_type"], 0)))
    dp = pick(ported, dport, pick(echo, out["icmp_id"], np.maximum(out["icmp_code"], 0)))
    src, dst = pick(inside, pick(v4, l3 + 12, l3 + 8)), pick(inside, pick(v4, l3 + 16, l3 + 24))
    order = [(look(inside & v4, src, 4), look(inside & v4, dst, 4))] + [(look(inside & v6, src + 8 * i, 8).view(np.uint64), look(inside & v6, dst + 8 * i, 8).view(np.uint64)) for i in (0, 1)]
    forward, open_ = np.zeros(len(n), bool), inside.copy()
    for a, b in order:
        forward |= open_ & (a < b)
        open_ &= a == b
    forward |= open_ & (sp <= dp)
    size = pick(inside, pick(v4, 4, 16), 0)
    out |= {"forward": pick(inside, forward), "port_a": pick(forward, sp, dp), "port_b": pick(forward, dp, sp)}
    out["addr_a"], out["addr_b"] = f.slices(pick(forward, src, dst), size), f.slices(pick(forward, dst, src), size)
    return out


def layout(frame: Column, root: str = "ethernet", extended: bool = False) -> Column:
    """STRUCT of FIELDS; a NULL frame is an empty one."""

    def batch(frames: pa.Array) -> pa.Array:
        made = lay_out(Frames.of(frames), root, extended)
        return pa.StructArray.from_arrays([*(pa.array(made[k], pa.int64()) for k in FIELDS), made["addr_a"], made["addr_b"]], names=[*FIELDS, "addr_a", "addr_b"])

    batch.__annotations__ = {"frames": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, SCHEMA)(F.coalesce(frame, F.lit(bytearray())))
