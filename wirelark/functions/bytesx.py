"""Columns over BINARY: unsigned integers, bit fields, slices, address texts, and back to bytes.

All of them are Catalyst expressions. Offsets are 0-based and may be Columns; a read past the end is NULL.
Unsigned 8- to 48-bit values are BIGINT, 64-bit values DECIMAL(20,0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Offset = int | Column


def lit(x: Offset) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x with x evaluated once: lambdas evaluate what they enclose anew for every element."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def take(b: Column, off: Offset, n: Offset) -> Column:
    """n bytes at off, or what there is of them."""
    return F.substring(b, lit(off) + 1, lit(n))


def uint(b: Column, off: Offset, n: int = 1) -> Column:
    """Big-endian unsigned integer of n bytes (1 to 7)."""
    return F.when(F.length(b) >= lit(off) + n, F.conv(F.hex(take(b, off, n)), 16, 10).cast("bigint"))


def uint_le(b: Column, off: Offset, n: int) -> Column:
    """Little-endian unsigned integer of n bytes (1 to 7)."""
    total = uint(b, off)
    for i in range(1, n):
        total = total + F.shiftleft(uint(b, lit(off) + i), 8 * i)
    return total


def uint64(b: Column, off: Offset) -> Column:
    return F.when(F.length(b) >= lit(off) + 8, F.conv(F.hex(take(b, off, 8)), 16, 10).cast("decimal(20,0)"))


def sint(b: Column, off: Offset, n: int) -> Column:
    """Big-endian two's-complement integer of n bytes (1 to 7)."""
    u = uint(b, off, n)
    return F.when(u >= (1 << (8 * n - 1)), u - (1 << (8 * n))).otherwise(u)


def bits(x: Column, shift: int, width: int) -> Column:
    """width bits of x from bit shift, bit 0 being the least."""
    return F.shiftright(x, shift).bitwiseAND((1 << width) - 1)


def bit_field(b: Column, first: int, width: int, msb_first: bool = True) -> Column:
    """width bits (1 to 32) from bit number first of a buffer; bits of a byte count from its high end, or from its low end."""
    if msb_first:
        start, stop = first // 8, (first + width - 1) // 8 + 1
        return bits(uint(b, start, stop - start), 8 * stop - first - width, width)
    start, stop = first // 8, (first + width - 1) // 8 + 1
    return bits(uint_le(b, start, stop - start), first - 8 * start, width)


def set_bits(x: Column, shift: int, width: int, value: Column) -> Column:
    mask = ((1 << width) - 1) << shift
    return x.bitwiseAND(~mask).bitwiseOR(F.shiftleft(value.cast("bigint").bitwiseAND((1 << width) - 1), shift))


def put(x: Column | int, n: int) -> Column:
    """x modulo 2^(8n) as n big-endian bytes (n up to 7)."""
    x = F.lit(x) if isinstance(x, int) else x
    return F.unhex(F.lpad(F.hex(x.cast("bigint").bitwiseAND((1 << (8 * n)) - 1)), 2 * n, "0"))


def put_le(x: Column | int, n: int) -> Column:
    x = (F.lit(x) if isinstance(x, int) else x).cast("bigint")
    return F.concat(*(put(F.shiftright(x, 8 * i), 1) for i in range(n)))


def swap(b: Column, n: int) -> Column:
    """n bytes in reverse order."""
    return F.concat(*(take(b, n - 1 - i, 1) for i in range(n)))


def raw(hexes: str) -> Column:
    return F.unhex(F.lit(hexes))


def text(b: Column) -> Column:
    """Bytes as UTF-8 text; NULL where they aren't."""
    return F.try_validate_utf8(b.cast("string"))


def latin(b: Column) -> Column:
    """Bytes as text, one character each."""
    return F.decode(b, "ISO-8859-1")


def hexstr(b: Column, sep: str = "") -> Column:
    plain = F.lower(F.hex(b))
    return plain if not sep else F.regexp_replace(plain, "(..)(?=.)", "$1" + sep)


def parse_hex(s: Column) -> Column:
    """Bytes of hex digits; spaces, colons and dashes don't count; NULL for anything else."""
    return F.unhex(F.regexp_replace(s, "[ :-]", ""))


def mac_text(b: Column) -> Column:
    return hexstr(b, ":")


def parse_mac(s: Column) -> Column:
    """6 bytes of a MAC written with colons, dashes or dots; NULL for anything else."""
    digits = F.regexp_replace(s, "[:.-]", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{12}$"), F.unhex(digits))


def ip4_text(b: Column) -> Column:
    return F.when(F.length(b) == 4, F.concat_ws(".", *(uint(b, i).cast("string") for i in range(4))))


def ip4_long(x: Column) -> Column:
    """Dotted quad of a BIGINT address."""
    return F.concat_ws(".", *(bits(x, s, 8).cast("string") for s in (24, 16, 8, 0)))


def parse_ip4(s: Column) -> Column:
    """BIGINT of a dotted quad; NULL for anything else."""
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    parts = F.split(s, r"\.")
    total = F.lit(0).cast("bigint")
    for i in range(4):
        total = total * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint")
    return F.when(s.rlike(rf"^{octet}(\.{octet}){{3}}$"), total)


def ip6_text(b: Column) -> Column:
    """RFC 5952: lower case, no leading zeros, the first longest run of two or more zero groups as ::."""
    groups = [F.regexp_replace(F.lower(F.hex(take(b, 2 * i, 2))), "^0{1,3}(?=.)", "") for i in range(8)]

    def shortened(full: Column) -> Column:
        out = full
        for run in range(2, 9):  # the last that applies is the longest
            zeros = rf"^(|.*?:)0(?::0){{{run - 1}}}(:.*|)$"
            out = F.when(full.rlike(zeros), F.regexp_replace(full, rf"^(|.*?):?(?<![0-9a-f])0(?::0){{{run - 1}}}(?![0-9a-f]):?(.*)$", "$1::$2")).otherwise(out)
        return out

    return F.when(F.length(b) == 16, let(F.concat_ws(":", *groups), shortened))


def ip_text(b: Column) -> Column:
    return F.coalesce(ip4_text(b), ip6_text(b))


def hexdump(b: Column) -> Column:
    """Lines of 16 bytes: offset, hex pairs, printable ASCII."""

    def line(v: Column, i: Column) -> Column:
        part = take(v, i * 16, 16)
        shown = F.regexp_replace(latin(part), r"[^\x20-\x7e]", ".")
        return F.concat(F.lpad(F.lower(F.hex(i * 16)), 4, "0"), F.lit("  "), F.rpad(hexstr(part, " "), 47, " "), F.lit("  "), shown)

    return let(b, lambda v: F.when(F.length(v) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(v) - 1) / 16).cast("int")), lambda i: line(v, i)), "\n")))


def hex_preview(b: Column, most: int) -> Column:
    return F.concat(hexstr(take(b, 0, most), " "), F.when(F.length(b) > most, "...").otherwise(""))


def ascii_preview(b: Column, most: int) -> Column:
    return F.concat(F.regexp_replace(latin(take(b, 0, most)), r"[^\x20-\x7e]", "."), F.when(F.length(b) > most, "...").otherwise(""))


def byte_array(b: Column) -> Column:
    """ARRAY<BIGINT> of the bytes."""
    return let(b, lambda v: F.when(F.length(v) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.length(v) - 1), lambda i: uint(v, i))))


def differing(a: Column, b: Column) -> Column:
    """Offsets at which two buffers differ; the longer one's tail differs."""

    def places(v: Column) -> Column:
        longer = F.greatest(F.length(v["a"]), F.length(v["b"]))
        found = F.filter(F.sequence(F.lit(0), longer - 1), lambda i: ~take(v["a"], i, 1).eqNullSafe(take(v["b"], i, 1)))
        return F.when(longer == 0, F.array().cast("array<int>")).otherwise(found)

    return let(F.struct(a.alias("a"), b.alias("b")), places)


def first_difference(a: Column, b: Column) -> Column:
    """The first differing offset; NULL for equal buffers."""
    return F.try_element_at(differing(a, b), F.lit(1))


def pad_to(b: Column, n: Offset) -> Column:
    """Zero bytes appended up to n bytes."""
    return F.concat(b, F.unhex(F.repeat(F.lit("00"), F.greatest(lit(n) - F.length(b), F.lit(0)))))


def align(n: Column, to: int) -> Column:
    return (F.floor((n + (to - 1)) / to) * to).cast("bigint")


def ethernet_min_frame(b: Column) -> Column:
    return pad_to(b, 60)


def random_bytes(key: Column, n: int, seed: int) -> Column:
    """n bytes that depend on key and seed alone, so that retried tasks agree."""
    words = [put(F.xxhash64(key, F.lit(seed), F.lit(i)), 4) for i in range(-(-n // 4))]
    return take(F.concat(*words), 0, n)


def random_mac(key: Column, seed: int) -> Column:
    """A locally administered unicast MAC."""
    b = random_bytes(key, 6, seed)
    return F.concat(put(uint(b, 0).bitwiseAND(0xFC).bitwiseOR(2), 1), take(b, 1, 5))
