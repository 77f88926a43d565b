"""Payload tests of the application cascades, as boolean Columns over the payload bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelark.functions.bytesx import latin, text, uint
from wirelark.functions.net import mqtt_length

# Command words of the protocols' RFCs.
FTP_COMMANDS = "USER PASS ACCT CWD CDUP SMNT QUIT REIN PORT PASV TYPE STRU MODE RETR STOR STOU APPE ALLO REST RNFR RNTO ABOR DELE RMD MKD PWD LIST NLST SITE SYST STAT HELP NOOP FEAT OPTS EPRT EPSV MDTM SIZE MLST MLSD AUTH PROT PBSZ CCC".split()
SMTP_COMMANDS = "EHLO HELO MAIL RCPT DATA RSET VRFY EXPN HELP NOOP QUIT AUTH STARTTLS BDAT".split()
POP3_COMMANDS = "USER PASS QUIT STAT LIST RETR DELE NOOP RSET TOP UIDL APOP AUTH CAPA STLS".split()
IMAP_COMMANDS = "CAPABILITY NOOP LOGOUT AUTHENTICATE LOGIN STARTTLS SELECT EXAMINE CREATE DELETE RENAME SUBSCRIBE UNSUBSCRIBE LIST LSUB STATUS APPEND CHECK CLOSE EXPUNGE SEARCH FETCH STORE COPY UID IDLE NAMESPACE ENABLE".split()
IMAP_STATUSES = "OK NO BAD BYE PREAUTH".split()
HTTP_METHODS = "GET POST HEAD PUT DELETE OPTIONS PATCH CONNECT TRACE".split()
HTTP2_PREFACE = "PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
MQTTSN_TYPES = [0, 1, 2, *range(4, 17), *range(18, 25), *range(26, 30), 254]


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def first_word(b: Column) -> Column:
    """The first whitespace-separated word in upper case; NULL for bytes that aren't UTF-8."""
    return F.upper(F.regexp_extract(text(b), r"^[ \t\n\x0c\r]*([^ \t\n\x0c\r]*)", 1))


def starts(b: Column, s: str) -> Column:
    return yes(F.startswith(latin(F.substring(b, 1, len(s))), F.lit(s)))


def coded(b: Column) -> Column:
    return latin(F.substring(b, 1, 3)).rlike("^[0-9]{3}$")


def code_end(b: Column) -> Column:
    return uint(b, 3).isin(32, 45, 13, 10)


def ssh(b: Column) -> Column:
    size, pad = uint(b, 0, 4), uint(b, 4)
    return starts(b, "SSH-") | yes(size.between(12, 35000) & (pad < size) & (pad >= 4))


def modbus(b: Column) -> Column:
    size = uint(b, 4, 2)
    return yes((F.length(b) >= 8) & (uint(b, 2, 2) == 0) & (size >= 2) & (size + 6 <= F.length(b) + 256))


def mqtt(b: Column) -> Column:
    return yes((F.length(b) >= 2) & (uint(b, 0) >= 16) & mqtt_length(b, 1).isNotNull())


def ftp(b: Column) -> Column:
    return yes((F.length(b) >= 3) & F.when(coded(b), yes(code_end(b))).otherwise(first_word(b).isin(FTP_COMMANDS)))


def smtp(b: Column) -> Column:
    return yes((F.length(b) >= 3) & F.when(coded(b), (F.length(b) < 4) | yes(code_end(b))).otherwise(first_word(b).isin(SMTP_COMMANDS)))


def pop3(b: Column) -> Column:
    return starts(b, "+OK") | starts(b, "-ERR") | yes(first_word(b).isin(POP3_COMMANDS))


def imap(b: Column) -> Column:
    line = F.regexp_extract(text(b), r"^([^\n]*)", 1)
    tag = F.regexp_extract(line, r"^([A-Za-z0-9]+) ([^ ]*)", 1)
    word = F.upper(F.regexp_replace(F.regexp_extract(line, r"^([A-Za-z0-9]+) ([^ ]*)", 2), "\r$", ""))
    return yes((F.length(b) >= 3) & (starts(b, "* ") | starts(b, "+ ") | (b == F.lit(bytearray(b"+\r\n"))) | yes((tag != "") & word.isin(*IMAP_STATUSES, *IMAP_COMMANDS))))


def tpkt(b: Column) -> Column:
    return yes((F.length(b) >= 4) & (uint(b, 0, 2) == 0x0300))


def iec104(b: Column) -> Column:
    return yes((F.length(b) >= 6) & (uint(b, 0) == 0x68))


def dnp3(b: Column) -> Column:
    return yes((F.length(b) >= 2) & (uint(b, 0, 2) == 0x0564))


def tls(b: Column) -> Column:
    kind, version = uint(b, 0), uint(b, 1, 2)
    record = (version.between(0x0300, 0x0304) | version.between(0x7F00, 0x7FFF)) & (uint(b, 3, 2) <= 5 + 16384 + 2048)
    return yes((F.length(b) >= 5) & F.when(kind.between(20, 24), record).otherwise(kind >= 0x80))


def http2(b: Column) -> Column:
    return starts(b, HTTP2_PREFACE) | yes((F.length(b) >= 9) & (uint(b, 0, 3) <= 16384) & (uint(b, 3) <= 9) & (uint(b, 5) < 0x80))


def http_request(b: Column) -> Column:
    return yes(latin(F.substring(b, 1, 8)).rlike("^(" + "|".join(HTTP_METHODS) + ") "))


def http(b: Column) -> Column:
    return http_request(b) | starts(b, "HTTP/")


def dns(b: Column) -> Column:
    return F.length(b) >= 12


def quic(b: Column) -> Column:
    return yes(uint(b, 0).bitwiseAND(0x40) != 0)


def l2tp(b: Column) -> Column:
    return yes(uint(b, 1).bitwiseAND(0x0F) == 2)


def mqttsn(b: Column) -> Column:
    head = F.when(uint(b, 0) == 1, 3).otherwise(1)
    size = F.when(uint(b, 0) == 1, uint(b, 1, 2)).otherwise(uint(b, 0))
    return yes((F.length(b) >= 2) & (size >= head + 1) & (size <= F.length(b)) & uint(b, head).isin(MQTTSN_TYPES))


def tftp(b: Column) -> Column:
    return yes(uint(b, 0, 2).between(1, 5))


def dhcp(b: Column) -> Column:
    return yes((F.length(b) >= 240) & (uint(b, 236, 4) == 0x63825363))


def coap(b: Column) -> Column:
    token = uint(b, 0).bitwiseAND(15)
    return yes((F.shiftright(uint(b, 0), 6) == 1) & (token <= 8) & (F.length(b) >= token + 4))


def s7comm(b: Column) -> Column:
    return yes((F.length(b) >= 10) & (uint(b, 0) == 0x32))


#: (layer, ports of either side or None, test), in the order that counts.
TCP_CASCADE = [
    ("SSH", [22], ssh), ("Modbus", [502], modbus), ("MQTT", [1883], mqtt), ("FTP", [21], ftp), ("SMTP", [25, 587, 465], smtp), ("POP3", [110], pop3), ("IMAP", [143], imap),
    ("TPKT", [102], tpkt), ("IEC104", [2404], iec104), ("DNP3", [20000], dnp3), ("TLS", None, tls), ("HTTP2", None, http2), ("HTTP", None, http),
]
UDP_CASCADE = [("DNS", [53, 5353], dns), ("QUIC", [443, 4433], quic), ("L2TP", [1701], l2tp), ("MQTTSN", [1883], mqttsn), ("TFTP", [69], tftp), ("DHCP", [67, 68], dhcp), ("CoAP", [5683, 5684], coap), ("DNP3", [20000], dnp3)]


def cascade(b: Column, sport: Column, dport: Column, rules: list) -> Column:
    """The first layer whose ports and test hold; Raw otherwise, NULL for an empty payload."""
    out = F
    for layer, ports, test in rules:
        here = test(b) if ports is None else (sport.isin(ports) | dport.isin(ports)) & test(b)
        out = out.when(here, layer)
    return F.when(F.length(b) > 0, out.otherwise("Raw"))
