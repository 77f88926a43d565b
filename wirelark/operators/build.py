"""Frame construction: each function returns the bytes of a layer; ``/`` of a stack is nesting here.

Lengths, checksums and next-protocol fields are filled in as the layers are put together.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelark.functions import checksum as ck
from wirelark.functions.bytesx import put, put_le, take

Value = Column | int | str
ZERO_MAC, BROADCAST = "00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff"


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def mac(x: Value) -> Column:
    """6 bytes of a MAC given as bytes or as text literal."""
    return F.unhex(F.lit(x.replace(":", ""))) if isinstance(x, str) else x


def raw(x: Column | bytes | str) -> Column:
    if isinstance(x, Column):
        return x.cast("binary")
    return F.lit(bytearray(x.encode() if isinstance(x, str) else x))


def ethernet(payload: Column, ethertype: Value = 0x0800, src: Value = ZERO_MAC, dst: Value = BROADCAST) -> Column:
    return F.concat(mac(dst), mac(src), put(col(ethertype), 2), payload)


def dot1q(payload: Column, vlan: Value, ethertype: Value = 0x0800, src: Value = ZERO_MAC, dst: Value = BROADCAST) -> Column:
    return ethernet(F.concat(put(col(vlan), 2), put(col(ethertype), 2), payload), 0x8100, src, dst)


def dot3(payload: Column, src: Value = ZERO_MAC, dst: Value = BROADCAST) -> Column:
    return F.concat(mac(dst), mac(src), put(F.length(payload), 2), payload)


def arp(op: Value, hwsrc: Value, psrc: Value, hwdst: Value, pdst: Value) -> Column:
    """Addresses as 6 bytes and as BIGINT."""
    return F.concat(put(1, 2), put(0x0800, 2), put(6, 1), put(4, 1), put(col(op), 2), mac(hwsrc), put(col(psrc), 4), mac(hwdst), put(col(pdst), 4))


def ipv4(payload: Column, src: Value, dst: Value, proto: Value, ttl: Value = 64, ident: Value = 1, flags: Value = 0, frag: Value = 0, tos: Value = 0, options: Column | None = None) -> Column:
    """src and dst are BIGINT; options must be a multiple of 4 bytes."""
    opts = F.lit(bytearray()) if options is None else options
    words = F.lit(5) + (F.length(opts) / 4).cast("int")
    before = F.concat(put(words + 0x40, 1), put(col(tos), 1), put(words * 4 + F.length(payload), 2), put(col(ident), 2), put(F.shiftleft(col(flags).cast("bigint"), 13) + col(frag), 2), put(col(ttl), 1), put(col(proto), 1))
    after = F.concat(put(col(src), 4), put(col(dst), 4), opts)
    return F.concat(before, put(ck.internet_checksum(F.concat(before, put(0, 2), after)), 2), after, payload)


def ipv6(payload: Column, src: Column, dst: Column, next_header: Value, hop_limit: Value = 64, traffic_class: Value = 0, flow_label: Value = 0) -> Column:
    """src and dst are 16 bytes."""
    word = F.lit(6 << 28).cast("bigint") + F.shiftleft(col(traffic_class).cast("bigint"), 20) + col(flow_label)
    return F.concat(put(word, 4), put(F.length(payload), 2), put(col(next_header), 1), put(col(hop_limit), 1), src, dst, payload)


def address(x: Value | Column) -> Column:
    """4 bytes of a BIGINT address; 16-byte addresses as they are."""
    return put(col(x), 4)


def tcp(payload: Column, src: Value, dst: Value, sport: Value, dport: Value, seq: Value = 0, ack: Value = 0, flags: Value = 2, window: Value = 8192, urgent: Value = 0, options: Column | None = None, v6: bool = False, with_checksum: bool = True) -> Column:
    """The checksum takes BIGINT addresses, or 16-byte ones with v6."""
    opts = F.lit(bytearray()) if options is None else options
    words = F.lit(5) + (F.length(opts) / 4).cast("int")
    before = F.concat(put(col(sport), 2), put(col(dport), 2), put(col(seq), 4), put(col(ack), 4), put(F.shiftleft(words, 12) + col(flags), 2), put(col(window), 2))
    after = F.concat(put(col(urgent), 2), opts, payload)
    if not with_checksum:
        return F.concat(before, put(0, 2), after)
    a, b = (src, dst) if v6 else (address(src), address(dst))
    return F.concat(before, put(ck.transport_checksum(a, b, 6, F.concat(before, put(0, 2), after)), 2), after)


def udp(payload: Column, src: Value, dst: Value, sport: Value, dport: Value, v6: bool = False, with_checksum: bool = True) -> Column:
    head = F.concat(put(col(sport), 2), put(col(dport), 2), put(F.length(payload) + 8, 2))
    if not with_checksum:
        return F.concat(head, put(0, 2), payload)
    a, b = (src, dst) if v6 else (address(src), address(dst))
    return F.concat(head, put(ck.udp_checksum(a, b, F.concat(head, put(0, 2), payload)), 2), payload)


def icmp(kind: Value, code: Value = 0, rest: Column | None = None, payload: Column | None = None) -> Column:
    """rest: the four bytes after the checksum."""
    body = F.concat(put(0, 4) if rest is None else rest, F.lit(bytearray()) if payload is None else payload)
    head = F.concat(put(col(kind), 1), put(col(code), 1))
    return F.concat(head, put(ck.internet_checksum(F.concat(head, put(0, 2), body)), 2), body)


def icmp_echo(ident: Value, seq: Value, reply: Value = 0, payload: Column | None = None) -> Column:
    return icmp(F.when(col(reply).cast("int") == 1, 0).otherwise(8), 0, F.concat(put(col(ident), 2), put(col(seq), 2)), payload)


def icmpv6(src: Column, dst: Column, kind: Value, code: Value = 0, rest: Column | None = None, payload: Column | None = None) -> Column:
    body = F.concat(put(0, 4) if rest is None else rest, F.lit(bytearray()) if payload is None else payload)
    head = F.concat(put(col(kind), 1), put(col(code), 1))
    return F.concat(head, put(ck.transport_checksum(src, dst, 58, F.concat(head, put(0, 2), body)), 2), body)


def dns_name(name: Column) -> Column:
    """Labels with their lengths, and the root."""
    labels = F.filter(F.split(name, r"\."), lambda x: x != "")
    return F.concat(F.aggregate(labels, F.lit(bytearray()), lambda a, x: F.concat(a, put(F.octet_length(x), 1), x.cast("binary"))), put(0, 1))


def dns_query(ident: Value, name: Column, qtype: Value = 1, recursion: bool = True) -> Column:
    return F.concat(put(col(ident), 2), put(0x0100 if recursion else 0, 2), put(1, 2), put(0, 6), dns_name(name), put(col(qtype), 2), put(1, 2))


def dns_answer_a(ident: Value, name: Column, ip: Value, ttl: Value = 60) -> Column:
    """A response with one A record whose name points at the question."""
    return F.concat(put(col(ident), 2), put(0x8180, 2), put(1, 2), put(1, 2), put(0, 4), dns_name(name), put(1, 2), put(1, 2), put(0xC00C, 2), put(1, 2), put(1, 2), put(col(ttl), 4), put(4, 2), put(col(ip), 4))


def http_request(method: Value, uri: Column, host: Column, headers: dict[str, Column] | None = None, body: Column | None = None) -> Column:
    lines = [F.concat_ws(" ", col(method), uri, F.lit("HTTP/1.1")), F.concat(F.lit("Host: "), host), *(F.concat(F.lit(f"{k}: "), v) for k, v in (headers or {}).items())]
    head = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).cast("binary")
    return head if body is None else F.concat(head, body)


def http_response(status: Value, reason: Value, headers: dict[str, Column] | None = None, body: Column | None = None) -> Column:
    lines = [F.concat_ws(" ", F.lit("HTTP/1.1"), col(status).cast("string"), col(reason)), *(F.concat(F.lit(f"{k}: "), v) for k, v in (headers or {}).items())]
    head = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).cast("binary")
    return head if body is None else F.concat(head, body)


def tls_record(kind: Value, fragment: Column, version: Value = 0x0303) -> Column:
    return F.concat(put(col(kind), 1), put(col(version), 2), put(F.length(fragment), 2), fragment)


def text_line(*words: Value) -> Column:
    """A line of FTP, SMTP, POP3 or IMAP: words with spaces between, CR and LF."""
    return F.concat(F.concat_ws(" ", *(col(w).cast("string") for w in words)), F.lit("\r\n")).cast("binary")


def text_reply(code: Value, words: Value, more: bool = False) -> Column:
    """A reply line of FTP or SMTP; more: others follow."""
    return F.concat(col(code).cast("string"), F.lit("-" if more else " "), col(words), F.lit("\r\n")).cast("binary")


def ssh_banner(software: Value) -> Column:
    return F.concat(F.lit("SSH-2.0-"), col(software), F.lit("\r\n")).cast("binary")


def dhcp(op: Value, xid: Value, hardware: Column, options: dict[int, Column], yiaddr: Value = 0, flags: Value = 0) -> Column:
    """hardware: 6 bytes; options: bytes by number, the end option follows."""
    head = F.concat(put(col(op), 1), put(0x010600, 3), put(col(xid), 4), put(0, 2), put(col(flags), 2), put(0, 4), put(col(yiaddr), 4), put(0, 4), put(0, 4), hardware, F.lit(bytearray(10 + 192)), put(0x63825363, 4))
    return F.concat(head, *(F.concat(put(n, 1), put(F.length(v), 1), v) for n, v in options.items()), put(255, 1))


def http2_frame(kind: Value, flags: Value, stream: Value, payload: Column) -> Column:
    return F.concat(put(F.length(payload), 3), put(col(kind), 1), put(col(flags), 1), put(col(stream), 4), payload)


def dot11_data(to: Column, source: Column, bssid: Column, payload: Column, qos: bool = True, seq: Value = 0) -> Column:
    """A data frame between stations; addresses of 6 bytes."""
    return F.concat(put(0x8800 if qos else 0x0800, 2), put(0, 2), to, source, bssid, put_le(F.shiftleft(col(seq).cast("bigint"), 4), 2), *([put(0, 2)] if qos else []), payload)


def dot15d4_data(pan: Value, dst: Value, src: Value, payload: Column, seq: Value = 0, with_fcs: bool = False) -> Column:
    """A data frame of short addresses in one network."""
    frame = F.concat(put_le(F.lit(0x8841), 2), put(col(seq), 1), put_le(col(pan), 2), put_le(col(dst), 2), put_le(col(src), 2), payload)
    return F.concat(frame, put_le(ck.ccitt_kermit(frame), 2)) if with_fcs else frame


def modbus(trans: Value, unit: Value, func: Value, data: Column) -> Column:
    return F.concat(put(col(trans), 2), put(0, 2), put(F.length(data) + 2, 2), put(col(unit), 1), put(col(func), 1), data)


def mqtt(kind: Value, body: Column, flags: Value = 0) -> Column:
    from wirelark.functions.net import put_mqtt_length

    return F.concat(put(F.shiftleft(col(kind), 4) + col(flags), 1), put_mqtt_length(F.length(body)), body)


def mqtt_publish(topic: Column, value: Column) -> Column:
    return mqtt(3, F.concat(put(F.octet_length(topic), 2), topic.cast("binary"), value))


def mqttsn(kind: Value, body: Column) -> Column:
    return F.concat(put(F.length(body) + 2, 1), put(col(kind), 1), body)


def coap(kind: Value, code: Value, ident: Value, token: Column, payload: Column | None = None) -> Column:
    tail = F.lit(bytearray()) if payload is None else F.concat(put(0xFF, 1), payload)
    return F.concat(put(F.lit(0x40) + F.shiftleft(col(kind), 4) + F.length(token), 1), put(col(code), 1), put(col(ident), 2), token, tail)


def tftp_request(op: Value, filename: Column, mode: Value = "octet") -> Column:
    return F.concat(put(col(op), 2), filename.cast("binary"), put(0, 1), col(mode).cast("binary"), put(0, 1))


def tftp_data(block: Value, data: Column) -> Column:
    return F.concat(put(3, 2), put(col(block), 2), data)


def tpkt(payload: Column) -> Column:
    return F.concat(put(0x0300, 2), put(F.length(payload) + 4, 2), payload)


def cotp_data(payload: Column) -> Column:
    return F.concat(put(2, 1), put(0xF0, 1), put(0x80, 1), payload)


def s7comm(rosctr: Value, pdu_ref: Value, params: Column, data: Column) -> Column:
    return F.concat(put(0x32, 1), put(col(rosctr), 1), put(0, 2), put(col(pdu_ref), 2), put(F.length(params), 2), put(F.length(data), 2), params, data)


def iec104_i(tx: Value, rx: Value, asdu: Column) -> Column:
    return F.concat(put(0x68, 1), put(F.length(asdu) + 4, 1), put_le(F.shiftleft(col(tx), 1), 2), put_le(F.shiftleft(col(rx), 1), 2), asdu)


def dnp3(control: Value, dst: Value, src: Value, body: Column) -> Column:
    """Link header with its CRC; body blocks of 16 bytes get CRCs of their own on the wire, which callers add."""
    head = F.concat(put(0x0564, 2), put(F.length(body) + 5, 1), put(col(control), 1), put_le(col(dst), 2), put_le(col(src), 2))
    return F.concat(head, put_le(ck.dnp3_crc(head), 2), body)


def l2tp(tunnel: Value, session: Value, payload: Column) -> Column:
    return F.concat(put(0x0002, 2), put(col(tunnel), 2), put(col(session), 2), payload)


def quic_long(kind: Value, version: Value, dcid: Column, scid: Column, payload: Column) -> Column:
    return F.concat(put(F.lit(0xC0) + F.shiftleft(col(kind), 4), 1), put(col(version), 4), put(F.length(dcid), 1), dcid, put(F.length(scid), 1), scid, payload)


def zwave(home: Value, src: Value, dst: Value, cmd_class: Value, cmd: Value, data: Column, seqn: Value = 1, ack: bool = False) -> Column:
    body = F.lit(bytearray()) if ack else F.concat(put(col(cmd_class), 1), put(col(cmd), 1), data)
    head = F.concat(put(col(home), 4), put(col(src), 1), put(3 if ack else 0x41, 1), put(col(seqn), 1), put(F.length(body) + 10, 1), put(col(dst), 1), body)
    return F.concat(head, put(ck.zwave_checksum(head), 1))


def rewrite_dst_mac(frame: Column, to: Value) -> Column:
    return F.concat(mac(to), take(frame, 6, F.length(frame)))

