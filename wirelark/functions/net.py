"""Network arithmetic: CIDR, TTL, ports, TCP flags, address classes, names of numbers, variable lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelark.functions.bytesx import bits, lit, put, take, uint, uint64

# Fixed values from the IANA registries and the RFCs.
ETHERTYPES = {0x0800: "IPv4", 0x0806: "ARP", 0x8100: "802.1Q", 0x86DD: "IPv6", 0x8863: "PPPoE Discovery", 0x8864: "PPPoE Session", 0x8847: "MPLS", 0x888E: "EAPOL", 0x88A8: "802.1ad", 0x88CC: "LLDP"}
PROTOCOLS = {0: "hopopt", 1: "icmp", 2: "igmp", 4: "ipv4", 6: "tcp", 8: "egp", 17: "udp", 41: "ipv6", 43: "ipv6-route", 44: "ipv6-frag", 47: "gre", 50: "esp", 51: "ah", 58: "ipv6-icmp", 59: "ipv6-nonxt", 60: "ipv6-opts", 88: "eigrp", 89: "ospf", 103: "pim", 112: "vrrp", 115: "l2tp", 132: "sctp", 136: "udplite"}
SERVICES = {7: "echo", 20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "domain", 67: "bootps", 68: "bootpc", 69: "tftp", 80: "http", 88: "kerberos", 102: "iso-tsap", 110: "pop3", 123: "ntp", 143: "imap", 161: "snmp", 162: "snmptrap", 179: "bgp", 389: "ldap", 443: "https", 445: "microsoft-ds", 465: "submissions", 500: "isakmp", 502: "mbap", 514: "syslog", 587: "submission", 636: "ldaps", 853: "domain-s", 993: "imaps", 995: "pop3s", 1701: "l2tp", 1883: "mqtt", 2404: "iec-104", 3306: "mysql", 3389: "ms-wbt-server", 5353: "mdns", 5432: "postgresql", 5683: "coap", 5684: "coaps", 6379: "redis", 8080: "http-alt", 8883: "secure-mqtt", 20000: "dnp"}
ICMP_TYPES = {0: "echo-reply", 3: "dest-unreach", 4: "source-quench", 5: "redirect", 8: "echo-request", 9: "router-advertisement", 10: "router-solicitation", 11: "time-exceeded", 12: "parameter-problem", 13: "timestamp-request", 14: "timestamp-reply", 15: "information-request", 16: "information-response", 17: "address-mask-request", 18: "address-mask-reply"}
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 13: "HINFO", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 35: "NAPTR", 39: "DNAME", 41: "OPT", 43: "DS", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA", 64: "SVCB", 65: "HTTPS", 250: "TSIG", 252: "AXFR", 255: "ANY", 257: "CAA", 32769: "DLV"}
DNS_RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED", 6: "YXDOMAIN", 7: "YXRRSET", 8: "NXRRSET", 9: "NOTAUTH", 10: "NOTZONE"}
DHCP_TYPES = {1: "discover", 2: "offer", 3: "request", 4: "decline", 5: "ack", 6: "nak", 7: "release", 8: "inform"}
TFTP_OPS = {1: "RRQ", 2: "WRQ", 3: "DATA", 4: "ACK", 5: "ERROR"}
MODBUS_FUNCTIONS = {1: "Read Coils", 2: "Read Discrete Inputs", 3: "Read Holding Registers", 4: "Read Input Registers", 5: "Write Single Coil", 6: "Write Single Register", 7: "Read Exception Status", 8: "Diagnostics", 15: "Write Multiple Coils", 16: "Write Multiple Registers", 22: "Mask Write Register", 23: "Read/Write Multiple Registers", 24: "Read FIFO Queue", 43: "Encapsulated Interface Transport"}
MQTT_TYPES = {1: "CONNECT", 2: "CONNACK", 3: "PUBLISH", 4: "PUBACK", 5: "PUBREC", 6: "PUBREL", 7: "PUBCOMP", 8: "SUBSCRIBE", 9: "SUBACK", 10: "UNSUBSCRIBE", 11: "UNSUBACK", 12: "PINGREQ", 13: "PINGRESP", 14: "DISCONNECT", 15: "AUTH"}
TLS_TYPES = {20: "change_cipher_spec", 21: "alert", 22: "handshake", 23: "application_data", 24: "heartbeat"}
#: Flag letters from bit 0 up; the ninth is NS.
TCP_FLAGS = "FSRPAUECN"
TTL_STARTS = (32, 64, 128, 255)


def named(x: Column, names: dict[int, str], otherwise: Column | None = None) -> Column:
    """The name of a number from one of the tables above."""
    table = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
    found = F.try_element_at(table, x.cast("int"))
    return found if otherwise is None else F.coalesce(found, otherwise)


def numbered(s: Column, names: dict[int, str]) -> Column:
    """The number of a name, in any case."""
    table = F.create_map(*(F.lit(v) for n, s in names.items() for v in (s.lower(), n)))
    return F.try_element_at(table, F.lower(s))


def dimension(spark, names: dict[int, str], key: str, value: str):
    """A lookup table as a DataFrame, small by construction."""
    return spark.createDataFrame(sorted(names.items()), f"{key} int, {value} string")


def prefix_mask(prefix: Column) -> Column:
    return F.when(prefix <= 0, F.lit(0)).otherwise(F.lit(0xFFFFFFFF) - (F.call_function("shiftleft", F.lit(1).cast("bigint"), (32 - prefix).cast("int")) - 1)).cast("bigint")


def mask_prefix(mask: Column) -> Column:
    return F.bit_count(mask).cast("int")


def network(ip: Column, prefix: Column) -> Column:
    return ip.bitwiseAND(prefix_mask(prefix))


def broadcast_address(ip: Column, prefix: Column) -> Column:
    return ip.bitwiseOR(F.lit(0xFFFFFFFF) - prefix_mask(prefix))


def host_count(prefix: Column) -> Column:
    """Usable hosts: 2^(32-p) - 2, but 1 for /31 and 0 for /32."""
    return F.when(prefix >= 32, 0).when(prefix == 31, 1).otherwise(F.lit(0xFFFFFFFF) - prefix_mask(prefix) - 1).cast("bigint")


def in_network(ip: Column, net: Column, prefix: Column) -> Column:
    return network(ip, prefix) == network(net, prefix)


def original_ttl(ttl: Column) -> Column:
    """The least usual starting TTL that is not below ttl."""
    out = F.lit(TTL_STARTS[-1])
    for start in reversed(TTL_STARTS[:-1]):
        out = F.when(ttl <= start, start).otherwise(out)
    return out


def hops(ttl: Column) -> Column:
    return original_ttl(ttl) - ttl


def port_class(port: Column) -> Column:
    return F.when(port <= 1023, "well_known").when(port <= 49151, "registered").otherwise("dynamic")


def generalize_port(port: Column, keep_well_known: Column) -> Column:
    """The first port of its class; a well-known one stays where asked for."""
    start = F.when(port <= 1023, 0).when(port <= 49151, 1024).otherwise(49152)
    return F.when(keep_well_known & (port <= 1023), port).otherwise(start)


def flags_text(flags: Column) -> Column:
    return F.concat(*(F.when(bits(flags, i, 1) == 1, c).otherwise("") for i, c in enumerate(TCP_FLAGS)))


def flags_bits(s: Column) -> Column:
    total = F.lit(0)
    for i, c in enumerate(TCP_FLAGS):
        total = total + F.when(F.contains(F.upper(s), F.lit(c)), 1 << i).otherwise(0)
    return total


def flag(flags: Column, letter: str) -> Column:
    return bits(flags, TCP_FLAGS.index(letter), 1) == 1


def is_syn(flags: Column) -> Column:
    return flag(flags, "S") & ~flag(flags, "A")


def is_syn_ack(flags: Column) -> Column:
    return flag(flags, "S") & flag(flags, "A")


def is_pure_ack(flags: Column) -> Column:
    return flag(flags, "A") & ~flag(flags, "S") & ~flag(flags, "F") & ~flag(flags, "R")


def is_ecn(flags: Column) -> Column:
    return flag(flags, "E") | flag(flags, "C")


def mac_class(mac: Column) -> Column:
    first = uint(mac, 0)
    return F.when(mac == F.unhex(F.lit("FF" * 6)), "broadcast").when(mac == F.unhex(F.lit("00" * 6)), "zero").when(bits(first, 0, 1) == 1, "multicast").when(bits(first, 1, 1) == 1, "local").otherwise("unicast")


def ip4_multicast(ip: Column) -> Column:
    return F.shiftright(ip, 28) == 14


def ip6_multicast(b: Column) -> Column:
    return uint(b, 0) == 0xFF


def ip4_multicast_mac(ip: Column) -> Column:
    """01:00:5e and the low 23 bits of the address."""
    return F.concat(F.unhex(F.lit("01005E")), put(ip.bitwiseAND(0x7FFFFF), 3))


def ip6_multicast_mac(b: Column) -> Column:
    return F.concat(F.unhex(F.lit("3333")), take(b, 12, 4))


def solicited_node(b: Column) -> Column:
    """ff02::1:ff and the last three bytes of the address."""
    return F.concat(F.unhex(F.lit("FF0200000000000000000001FF")), take(b, 13, 3))


def quic_varint(b: Column, off: int | Column = 0) -> Column:
    """Value of a QUIC variable-length integer; DECIMAL as it reaches 62 bits."""
    first = uint(b, off)
    size = F.shiftright(first, 6)
    dec = "decimal(20,0)"
    return F.when(size == 0, first.cast(dec)).when(size == 1, (uint(b, off, 2).bitwiseAND(0x3FFF)).cast(dec)).when(size == 2, (uint(b, off, 4).bitwiseAND(0x3FFFFFFF)).cast(dec)).when(size == 3, uint64(b, off) - F.lit(str(3 << 62)).cast(dec))


def quic_varint_length(value: Column) -> Column:
    return F.when(value < 1 << 6, 1).when(value < 1 << 14, 2).when(value < 1 << 30, 4).when(value < F.lit(1 << 62), 8)


def put_quic_varint(value: Column) -> Column:
    v = value.cast("bigint")
    wide = F.unhex(F.lpad(F.hex(v.bitwiseOR(F.lit(-(1 << 62)))), 16, "0"))
    return F.when(v < 1 << 6, put(v, 1)).when(v < 1 << 14, put(v + (1 << 14), 2)).when(v < 1 << 30, put(v + (2 << 30), 4)).otherwise(wide)


def mqtt_length(b: Column, off: int | Column) -> Column:
    """(value, size) of a base-128 little-endian length of at most 4 bytes; NULL for a longer or cut one."""
    out, value = F.lit(None).cast("struct<value:bigint,size:int>"), [uint(b, lit(off) + i) for i in range(4)]
    for n in range(4, 0, -1):
        total = sum((F.shiftleft(value[i].bitwiseAND(127), 7 * i) for i in range(1, n)), value[0].bitwiseAND(127))
        more = F.lit(True)
        for i in range(n - 1):
            more = more & (value[i] >= 128)
        out = F.when(more & (value[n - 1] < 128), F.struct(total.alias("value"), F.lit(n).alias("size"))).otherwise(out)
    return out


def put_mqtt_length(value: Column) -> Column:
    v = value.cast("bigint")
    digit = lambda i: F.shiftright(v, 7 * i).bitwiseAND(127)
    forms = [F.concat(*(put(digit(i) + (128 if i < n - 1 else 0), 1) for i in range(n))) for n in range(1, 5)]
    return F.when(v < 1 << 7, forms[0]).when(v < 1 << 14, forms[1]).when(v < 1 << 21, forms[2]).when(v < 1 << 28, forms[3])
