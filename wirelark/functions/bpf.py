"""Capture-filter expressions compiled to a boolean Column over dissected packets.

Grammar: terms joined by and, or, not (also &&, ||, !) and parentheses. A term is [src|dst] host|net|port|
portrange X, a protocol word (ether, ip, ip6, arp, tcp, udp, icmp, icmp6, vlan) alone or before one of
these, ether [src|dst] host MAC, less N, greater N, or len with a comparison. Packets are those of dissect().
"""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelark.functions.bytesx import take
from wirelark.functions.net import SERVICES
from wirelark.operators.layout import NUMBER

TOKEN = re.compile(r"\s*(\(|\)|&&|\|\||!=|!|>=|<=|==|=|>|<|[^\s()!&|<>=]+)")
PROTOCOLS = ("ip", "ip6", "arp", "tcp", "udp", "icmp", "icmp6", "vlan", "ether")


def layout(name: str) -> Column:
    return F.col(f"layout.{name}")


def present(proto: str) -> Column:
    """Whether a packet has a layer, from its layout alone."""
    net = {"ip": "IPv4", "ip6": "IPv6", "arp": "ARP"}
    if proto in net:
        return (layout("net") == NUMBER[net[proto]]) & (layout("l4") >= 0)
    if proto == "vlan":
        return layout("vlan") >= 0
    if proto == "ether":
        return layout("l3") >= 14
    kind = NUMBER[{"tcp": "TCP", "udp": "UDP", "icmp": "ICMP", "icmp6": "ICMPv6"}[proto]]
    return (layout("tp") == kind) & (layout("error") == 0)


def address(side: str, kind: str) -> Column:
    """The bytes of an address; NULL for packets of another kind."""
    places = {"ip": {"src": 12, "dst": 16}, "ip6": {"src": 8, "dst": 24}, "arp": {"src": 14, "dst": 24}, "ether": {"src": 6, "dst": 0}}
    size = {"ip": 4, "arp": 4, "ip6": 16, "ether": 6}[kind]
    start = F.lit(0) if kind == "ether" else layout("l3").cast("int")
    return F.when(present(kind), take(F.col("frame"), start + places[kind][side], size))


def raw(b: bytes) -> Column:
    return F.lit(bytearray(b))


class FilterError(ValueError):
    pass


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            if not (m := TOKEN.match(text, at)):
                raise FilterError(f"can't read filter at {text[at:]!r}")
            self.tokens.append(m[1].lower() if not re.search("[A-F]", m[1]) else m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def next(self, what: str = "a word") -> str:
        if (t := self.peek()) is None:
            raise FilterError(f"filter ends where {what} is due")
        self.at += 1
        return t

    def accept(self, *words: str) -> str | None:
        return self.next() if self.peek() in words else None

    def parse(self) -> Column:
        if not self.tokens:
            return F.lit(True)
        found = self.either()
        if self.peek() is not None:
            raise FilterError(f"unexpected {self.peek()!r}")
        return found

    def either(self) -> Column:
        found = self.both()
        while self.accept("or", "||"):
            found = found | self.both()
        return found

    def both(self) -> Column:
        found = self.negated()
        while self.accept("and", "&&"):
            found = found & self.negated()
        return found

    def negated(self) -> Column:
        if self.accept("not", "!"):
            return ~self.negated()
        if self.accept("("):
            found = self.either()
            if not self.accept(")"):
                raise FilterError("a parenthesis isn't closed")
            return found
        return self.term()

    def number(self) -> int:
        t = self.next("a number")
        if not t.isdigit():
            raise FilterError(f"{t!r} is no number")
        return int(t)

    def term(self) -> Column:
        word = self.next()
        if word in ("less", "greater"):
            n = self.number()
            return F.length("frame") <= n if word == "less" else F.length("frame") >= n
        if word == "len":
            op, n = self.next("a comparison"), self.number()
            size = F.length("frame")
            ops = {">": size > n, "<": size < n, ">=": size >= n, "<=": size <= n, "=": size == n, "==": size == n, "!=": size != n}
            if op not in ops:
                raise FilterError(f"{op!r} is no comparison")
            return ops[op]
        proto = word if word in PROTOCOLS else None
        if proto:
            here = present(proto)
            if proto == "vlan" and (self.peek() or "").isdigit():
                return here & (layout("vlan") == self.number())
            if self.peek() not in ("src", "dst", "host", "net", "port", "portrange", "proto"):
                return here
            word = self.next()
        else:
            here = F.lit(True)
        side = None
        if word in ("src", "dst"):
            side, word = word, self.next("host, net, port or portrange")
            if word not in ("host", "net", "port", "portrange"):
                self.at, word = self.at - 1, "host"
        if word == "proto":
            return here & (layout("proto") == self.number())
        test = {"host": self.host, "net": self.net, "port": self.port, "portrange": self.portrange}.get(word)
        if test is None:
            raise FilterError(f"unexpected {word!r}")
        return here & test(side, proto)

    def sides(self, side: str | None, test) -> Column:
        """test of the source, the destination or either."""
        found = [F.coalesce(test(s), F.lit(False)) for s in ([side] if side else ["src", "dst"])]
        return found[0] if len(found) == 1 else found[0] | found[1]

    def host(self, side: str | None, proto: str | None) -> Column:
        name = self.next("an address")
        if proto == "ether":
            mac = name.lower().replace("-", ":")
            if not re.fullmatch(r"([0-9a-f]{2}:){5}[0-9a-f]{2}", mac):
                raise FilterError(f"{name!r} is no MAC")
            return self.sides(side, lambda s: address(s, "ether") == raw(bytes.fromhex(mac.replace(":", ""))))
        try:
            ip = ipaddress.ip_address(name)
        except ValueError as e:
            raise FilterError(f"{name!r} is no address") from e
        if ip.version == 6:
            return self.sides(side, lambda s: address(s, "ip6") == raw(ip.packed))
        return self.sides(side, lambda s: F.coalesce(address(s, "ip"), address(s, "arp")) == raw(ip.packed))

    def net(self, side: str | None, proto: str | None) -> Column:
        name = self.next("a network")
        if self.accept("mask"):
            name = f"{name}/{self.next('a mask')}"
        elif "/" not in name:
            parts = name.split(".")
            name = ".".join(parts + ["0"] * (4 - len(parts))) + f"/{8 * len(parts)}"
        try:
            net = ipaddress.ip_network(name, strict=False)
        except ValueError as e:
            raise FilterError(f"{name!r} is no network") from e
        low, high = raw(net.network_address.packed), raw(net.broadcast_address.packed)
        kinds = ("ip6",) if net.version == 6 else ("ip", "arp")
        return self.sides(side, lambda s: F.coalesce(*(address(s, k) for k in kinds)).between(low, high))

    def service(self, t: str) -> int:
        if t.isdigit() and int(t) < 65536:
            return int(t)
        found = next((p for p, n in SERVICES.items() if n == t), None)
        if found is None:
            raise FilterError(f"{t!r} is no port")
        return found

    def ports(self, side: str | None, proto: str | None, test) -> Column:
        own = {"src": "sport", "dst": "dport"}
        here = present(proto) if proto in ("tcp", "udp") else layout("sport") >= 0
        return self.sides(side, lambda s: here & test(layout(own[s])))

    def port(self, side: str | None, proto: str | None) -> Column:
        n = self.service(self.next("a port"))
        return self.ports(side, proto, lambda c: c == n)

    def portrange(self, side: str | None, proto: str | None) -> Column:
        t = self.next("a port range")
        low, dash, high = t.partition("-")
        if not dash:
            raise FilterError(f"{t!r} is no port range")
        a, b = self.service(low), self.service(high)
        return self.ports(side, proto, lambda c: c.between(a, b))


def compile_filter(text: str) -> Column:
    """The Column of a filter; FilterError (a ValueError) for a bad one."""
    return Parser(text).parse()


def validate_filter(text: str) -> None:
    compile_filter(text)
