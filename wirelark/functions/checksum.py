"""Checksums and CRCs over BINARY columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelark.functions.bytesx import let, put, take, uint


def word_sums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the big-endian 16-bit words of each byte string of a buffer; an odd last byte is a high byte."""
    place = np.arange(len(data)) & 1
    wide = data.astype(np.int64)
    even = np.concatenate([[0], np.cumsum(np.where(place == 0, wide << 8, wide))])  # high bytes at even places
    odd = np.concatenate([[0], np.cumsum(np.where(place == 1, wide << 8, wide))])
    ends = starts + sizes
    return np.where(starts & 1, odd[ends] - odd[starts], even[ends] - even[starts])


def folded(total: np.ndarray) -> np.ndarray:
    """Word sums with their carries added in."""
    while (total >> 16).any():
        total = (total & 0xFFFF) + (total >> 16)
    return total


def internet_checksum(b: Column, never_zero: bool = False) -> Column:
    """RFC 1071 checksum of whole buffers, an Arrow batch at once; never_zero gives 0xFFFF for 0."""

    def batch(values: pa.Array) -> pa.Array:
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        _, offsets, data = values.buffers()
        kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
        at = np.frombuffer(offsets, kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[: at[-1]] if data is not None else np.zeros(0, np.uint8)
        made = 0xFFFF - folded(word_sums(raw, at[:-1], np.diff(at)))
        if never_zero:
            made = np.where(made == 0, 0xFFFF, made)
        return pa.array(made, pa.int64(), mask=values.is_null().to_numpy(zero_copy_only=False))

    batch.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, "long")(b)


def fold(total: Column) -> Column:
    """A small sum of words with its carries added in."""
    return let(total, lambda t: let(t.bitwiseAND(0xFFFF) + F.shiftright(t, 16), lambda x: x.bitwiseAND(0xFFFF) + F.shiftright(x, 16)))


def verify_checksum(b: Column) -> Column:
    """Whether a buffer that holds its checksum sums to zero."""
    return internet_checksum(b) == 0


def pseudo_header(src: Column, dst: Column, proto: Column | int, length: Column) -> Column:
    """IPv4 or IPv6 pseudo-header, by the length of the addresses."""
    proto = F.lit(proto) if isinstance(proto, int) else proto
    # length in 2 or 4 bytes, then zeros: the words, and so their sum, are the same
    return F.concat(src, dst, put(length, 4), put(0, 3), put(proto, 1))


def transport_checksum(src: Column, dst: Column, proto: Column | int, segment: Column, never_zero: bool = False) -> Column:
    return internet_checksum(F.concat(pseudo_header(src, dst, proto, F.length(segment)), segment), never_zero)


def without(b: Column, off: int) -> Column:
    """b with the 16-bit word at off zeroed."""
    return F.concat(take(b, 0, off), put(0, 2), take(b, off + 2, F.length(b)))


def ipv4_checksum(header: Column) -> Column:
    return internet_checksum(without(header, 10))


def verify_ipv4_checksum(header: Column) -> Column:
    return internet_checksum(header).isin(0, 0xFFFF)


def tcp_checksum(src: Column, dst: Column, segment: Column) -> Column:
    return transport_checksum(src, dst, 6, without(segment, 16))


def verify_tcp_checksum(src: Column, dst: Column, segment: Column) -> Column:
    return transport_checksum(src, dst, 6, segment) == 0


def udp_checksum(src: Column, dst: Column, datagram: Column) -> Column:
    """A computed 0 is sent as 0xFFFF."""
    return transport_checksum(src, dst, 17, without(datagram, 6), never_zero=True)


def verify_udp_checksum(src: Column, dst: Column, datagram: Column) -> Column:
    """Zero means none: fine over IPv4, wrong over IPv6."""
    sent = uint(datagram, 6, 2)
    return F.when(sent == 0, F.length(src) == 4).otherwise(udp_checksum(src, dst, datagram) == sent)


def icmp_checksum(message: Column) -> Column:
    return internet_checksum(without(message, 2))


def verify_icmp_checksum(message: Column) -> Column:
    return verify_checksum(message)


def icmpv6_checksum(src: Column, dst: Column, message: Column) -> Column:
    return transport_checksum(src, dst, 58, without(message, 2))


def verify_icmpv6_checksum(src: Column, dst: Column, message: Column) -> Column:
    return transport_checksum(src, dst, 58, message) == 0


def incremental_update(check: Column, old: Column, new: Column) -> Column:
    """RFC 1624: the checksum after a 16-bit word changes."""
    return F.lit(0xFFFF) - fold((F.lit(0xFFFF) - check) + (F.lit(0xFFFF) - old) + new)


def incremental_update_32(check: Column, old: Column, new: Column) -> Column:
    high = incremental_update(check, F.shiftright(old, 16).bitwiseAND(0xFFFF), F.shiftright(new, 16).bitwiseAND(0xFFFF))
    return incremental_update(high, old.bitwiseAND(0xFFFF), new.bitwiseAND(0xFFFF))


def reflected_table(poly: int) -> np.ndarray:
    """The byte table of a reflected CRC, from its rule."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ poly, t >> 1)
    return t


def crc16_of(values: list[bytes | None], poly: int, init: int, out: int) -> list[int | None]:
    """A reflected 16-bit CRC of each value: all long enough are folded side by side, the last few one by one."""
    table = reflected_table(poly)
    order = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: -len(values[i]))
    sizes = np.array([len(values[i]) for i in order], np.int64)
    flat = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
    begin = np.cumsum(sizes) - sizes
    c = np.full(len(order), init, np.uint32)
    at, active = 0, int((sizes > 0).sum())
    while active >= 16:
        c[:active] = (c[:active] >> 8) ^ table[(c[:active] ^ flat[begin[:active] + at]) & 0xFF]
        at += 1
        active = int(np.searchsorted(-sizes, -at, side="left"))  # those longer than at
    few, result = table.tolist(), [None] * len(values)
    for k, i in enumerate(order):
        x = int(c[k])
        if k < active:
            for byte in values[i][at:]:
                x = (x >> 8) ^ few[(x ^ byte) & 0xFF]
        result[i] = x ^ out
    return result


def crc16(poly: int, init: int, out: int):
    """Column function of a reflected 16-bit CRC, batched over Arrow."""

    def build(b: Column) -> Column:
        def batch(values: pd.Series) -> pd.Series:
            return pd.Series(crc16_of(values.tolist(), poly, init, out), dtype="Int64")

        return F.pandas_udf(batch, "long")(b)

    return build


modbus_crc16 = crc16(0xA001, 0xFFFF, 0)
ccitt_kermit = crc16(0x8408, 0, 0)
dnp3_crc = crc16(0xA6BC, 0, 0xFFFF)


def byte_fold(b: Column, start: int, step) -> Column:
    return let(b, lambda v: F.when(F.length(v) == 0, F.lit(start).cast("bigint")).otherwise(F.aggregate(F.sequence(F.lit(0), F.length(v) - 1), F.lit(start).cast("bigint"), lambda a, i: step(a, uint(v, i)))))


def modbus_lrc(b: Column) -> Column:
    """Two's complement of the byte sum."""
    return (-byte_fold(b, 0, lambda a, x: a + x)).bitwiseAND(0xFF)


def verify_modbus_lrc(b: Column) -> Column:
    return byte_fold(b, 0, lambda a, x: a + x).bitwiseAND(0xFF) == 0


def zwave_checksum(b: Column) -> Column:
    return byte_fold(b, 0xFF, lambda a, x: a.bitwiseXOR(x))


def crc32_ieee(b: Column) -> Column:
    return F.crc32(b)


def verify_fcs(b: Column, stored_le: Column) -> Column:
    """802.15.4 frame check sequence against its two little-endian bytes."""
    return ccitt_kermit(b) == uint(stored_le, 0) + uint(stored_le, 1) * 256
