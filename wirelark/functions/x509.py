"""Certificates of TLS handshakes and PEM texts, and SSLv2 hellos."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

from wirelark.functions.walkers import u, walker

#: Fixed value: the object identifier of a common name, 2.5.4.3.
COMMON_NAME = bytes([0x55, 4, 3])
FIELDS = "subject_cn:string,issuer_cn:string,serial:string,not_before:string,not_after:string"


def element(b: bytes, at: int) -> tuple[int, int, int]:
    """(tag, start, stop) of the DER element at a place; IndexError where it is cut."""
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 128:
        size = n & 127
        n, at = u(b, at, size), at + size
    if at + n > len(b):
        raise IndexError("element is cut")
    return tag, at, at + n


def elements(b: bytes, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    while start < stop:
        tag, a, z = element(b, start)
        yield tag, a, z
        start = z


def common_name(b: bytes, start: int, stop: int) -> str | None:
    """The last common name of a Name's content."""
    found = None
    for _, a, z in elements(b, start, stop):
        for _, c, d in elements(b, a, z):
            (_, o, p), (tag, v, w) = list(elements(b, c, d))[:2]
            if b[o:p] == COMMON_NAME:
                found = b[v:w].decode("utf-16-be" if tag == 30 else "utf-8", "replace")
    return found


def certificate_fields(der: bytes) -> dict:
    """FIELDS of a DER certificate; NULLs where it can't be read. Times are as written."""
    out = dict.fromkeys(x.split(":")[0] for x in FIELDS.split(","))
    try:
        _, a, _ = element(der, 0)
        _, a, z = element(der, a)
        parts = [p for p in elements(der, a, z) if p[0] != 0xA0]  # without the version
        (_, s, t), _, (_, i, j), (_, v, w), (_, c, d) = parts[:5]
        first, last = list(elements(der, v, w))[:2]
        out |= {"serial": der[s:t].hex(), "issuer_cn": common_name(der, i, j), "subject_cn": common_name(der, c, d), "not_before": der[first[1] : first[2]].decode("ascii", "replace"), "not_after": der[last[1] : last[2]].decode("ascii", "replace")}
    except (IndexError, ValueError):
        pass
    return out


def pem_chain(text: str) -> list[bytes]:
    """The DER certificates of a PEM text, in order."""
    return [base64.b64decode(re.sub(r"\s", "", m)) for m in re.findall(r"-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----", text, re.S)]


@walker(f"array<struct<{FIELDS}>>")
def tls_certificates(b: bytes) -> list:
    """The certificates of a Certificate handshake message (up to TLS 1.2), with or without its record header."""
    h = b[5:] if b[:1] == b"\x16" else b
    if len(h) < 7 or h[0] != 11:
        return []
    at, end, out = 7, min(len(h), 7 + u(h, 4, 3)), []
    while at + 3 <= end:
        n = u(h, at, 3)
        out.append(certificate_fields(h[at + 3 : at + 3 + n]))
        at += 3 + n
    return out


@walker(f"array<struct<{FIELDS}>>")
def pem_certificates(b: bytes) -> list:
    return [certificate_fields(x) for x in pem_chain(b.decode("ascii", "replace"))]


@walker("struct<version:int,ciphers:array<int>,session_id:binary,challenge:binary>")
def sslv2_client_hello(b: bytes) -> dict:
    """An SSLv2 CLIENT-HELLO in a two-byte record; NULLs where it is none."""
    out = dict.fromkeys(("version", "ciphers", "session_id", "challenge"))
    if len(b) < 11 or not b[0] & 128 or b[2] != 1:
        return out
    specs, ident, challenge = u(b, 5, 2), u(b, 7, 2), u(b, 9, 2)
    if specs % 3 or len(b) < 11 + specs + ident + challenge:
        return out
    at = 11 + specs
    return {"version": u(b, 3, 2), "ciphers": [u(b, 11 + i, 3) for i in range(0, specs, 3)], "session_id": b[at : at + ident], "challenge": b[at + ident : at + ident + challenge]}
