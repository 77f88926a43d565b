"""Flow anonymisation: keyed, repeatable column transforms over conversations.

Addresses are anonymised once each: distinct addresses are transformed and joined back, which takes the
place of a per-address cache. Random offsets are drawn from the seed on the driver.
"""

from __future__ import annotations

import hashlib
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelark.functions.bytesx import ip_text, put, take, uint
from wirelark.functions.net import generalize_port

DAY_NS = 86_400_000_000_000
MODES = {"ip_mode": ("none", "crypto_pan"), "mac_mode": ("none", "salted_hash", "preserve_oui"), "port_mode": ("none", "preserve_well_known", "categorize"), "timestamp_mode": ("none", "epoch_shift", "epoch_shift_jitter"), "tcp_seq_mode": ("none", "random_offset"), "payload_mode": ("none", "truncate_all", "truncate_to")}


@dataclass(frozen=True)
class Policy:
    """What to anonymise; the default changes nothing."""

    ip_mode: str = "none"
    mac_mode: str = "none"
    port_mode: str = "none"
    timestamp_mode: str = "none"
    tcp_seq_mode: str = "none"
    payload_mode: str = "none"
    crypto_pan_key: bytes | None = None
    hash_salt: bytes | None = None
    jitter_ms: int = 0
    truncate_to: int = 0
    seed: int = 0

    def __post_init__(self) -> None:
        for name, allowed in MODES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")
        if self.crypto_pan_key is not None and len(self.crypto_pan_key) != 32:
            raise ValueError("crypto_pan_key has 32 bytes")

    @staticmethod
    def ml_optimized(**more) -> Policy:
        return Policy(**({"ip_mode": "crypto_pan", "mac_mode": "salted_hash", "port_mode": "preserve_well_known", "timestamp_mode": "epoch_shift", "tcp_seq_mode": "random_offset", "payload_mode": "truncate_all"} | more))

    @staticmethod
    def maximum_privacy(**more) -> Policy:
        return Policy(**({"ip_mode": "crypto_pan", "mac_mode": "salted_hash", "port_mode": "categorize", "timestamp_mode": "epoch_shift_jitter", "jitter_ms": 5, "tcp_seq_mode": "random_offset", "payload_mode": "truncate_all"} | more))

    def key(self) -> bytes:
        """The address key; derived from the seed where none is given."""
        return self.crypto_pan_key or hashlib.sha256(f"wirelark:{self.seed}".encode()).digest()


def crypto_pan(address: Column, key: bytes) -> Column:
    """Prefix-preserving pseudonym of a 4- or 16-byte address.

    For each bit, a block of the address bits before it and the pad's bits after them is encrypted with
    AES; the block's first bit is XORed to the address. Key bytes 0 to 15 are the AES key, 16 to 31 the pad.
    """
    aes, pad = F.lit(bytearray(key[:16])), key[16:]

    def build(size: int) -> Column:
        def bit(i: Column) -> Column:
            whole, part = (i / 8).cast("int"), (i % 8).cast("int")
            mask = F.get(F.array(*(F.lit((0xFF00 >> k) & 0xFF) for k in range(8))), part)
            there, filler = uint(F.col("_a"), whole), uint(F.lit(bytearray(pad)), whole)
            mixed = there.bitwiseAND(mask).bitwiseOR(filler.bitwiseAND(F.lit(255) - mask))
            block = F.concat(take(F.col("_a"), 0, whole), put(mixed, 1), take(F.lit(bytearray(pad)), whole + 1, 16))
            return F.shiftright(uint(F.aes_encrypt(block, aes, F.lit("ECB"), F.lit("PKCS")), 0), 7)

        octets = []
        for o in range(size):
            flips = F.aggregate(F.sequence(F.lit(8 * o), F.lit(8 * o + 7)), F.lit(0).cast("bigint"), lambda a, i: a * 2 + bit(i))
            octets.append(put(uint(F.col("_a"), o).bitwiseXOR(flips), 1))
        return F.concat(*octets)

    return F.when(F.length("_a") == 4, build(4)).otherwise(build(16))


def anonymize_addresses(df: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    """BINARY address columns replaced by their pseudonyms."""
    every = df.select(F.explode(F.array(*columns)).alias("_a")).where("_a is not null").distinct()
    table = every.select(F.col("_a"), crypto_pan(F.col("_a"), key).alias("_p"))
    out = df
    for c in columns:
        out = out.join(table.select(F.col("_a").alias(c), F.col("_p").alias(f"_{c}")), c, "left").withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return out.select(*df.columns)


def server_sides(a: Column, b: Column) -> tuple[Column, Column]:
    """Which port is the server's: the well-known one, else the lesser; the second on a tie."""
    first = F.when((a <= 1023) & (b > 1023), True).when((b <= 1023) & (a > 1023), False).otherwise(a < b)
    return first, ~first


def anonymize_ports(df: DataFrame, mode: str) -> DataFrame:
    if mode == "none":
        return df
    a, b = server_sides(F.col("src_port"), F.col("dst_port"))
    keep = (a, b) if mode == "preserve_well_known" else (F.lit(False), F.lit(False))
    return df.withColumns({"src_port": generalize_port(F.col("src_port"), keep[0]), "dst_port": generalize_port(F.col("dst_port"), keep[1])})


def epoch_offset_ns(seed: int) -> int:
    """One shift for a session, 30 to 365 days."""
    return random.Random(f"epoch:{seed}").randrange(30 * DAY_NS, 365 * DAY_NS)


def anonymize_times(df: DataFrame, policy: Policy, columns: tuple[str, ...] = ("start_ns", "last_ns", "forward_last_ns", "reverse_last_ns")) -> DataFrame:
    if policy.timestamp_mode == "none":
        return df
    shift = epoch_offset_ns(policy.seed)
    jitter = policy.jitter_ms if policy.timestamp_mode == "epoch_shift_jitter" else 0
    own = [c for c in columns if c in df.columns]
    moved = {c: F.col(c) + shift + (F.pmod(F.xxhash64("addr_a", "addr_b", "src_port", "dst_port", "first_index", F.lit(c), F.lit(policy.seed)), F.lit(jitter + 1)) * 1_000_000 if jitter else 0) for c in own}
    out = df.withColumns(moved)
    if "start_time" in df.columns:
        out = out.withColumns({"start_time": F.col("start_ns") / 1e9, "duration": F.greatest(F.lit(0), F.col("last_ns") - F.col("start_ns")) / 1e9})
    return out


def anonymize_sequences(df: DataFrame, seed: int) -> DataFrame:
    """Endpoint columns (initial_seq_fwd, ...) shifted by an offset per flow and direction; last_ack by the peer's."""
    low = lambda c: c.bitwiseAND(0xFFFFFFFF)
    key = [c for c in ("addr_a", "addr_b", "port_a", "port_b", "src_port", "dst_port", "protocol") if c in df.columns]
    off = {d: low(F.xxhash64(*key, F.lit(d), F.lit(seed))) for d in ("fwd", "rev")}
    peer = {"fwd": "rev", "rev": "fwd"}
    moved = {f"{c}_{d}": low(F.col(f"{c}_{d}") + off[d]) for d in off for c in ("initial_seq", "next_seq")} | {f"last_ack_{d}": low(F.col(f"last_ack_{d}") + off[peer[d]]) for d in off}
    return df.withColumns({k: v for k, v in moved.items() if k in df.columns})


def anonymize_payloads(df: DataFrame, policy: Policy) -> DataFrame:
    if policy.payload_mode == "none":
        return df
    cut = lambda c: F.lit(None).cast("binary") if policy.payload_mode == "truncate_all" else take(F.col(c), 0, policy.truncate_to)
    return df.withColumns({c: cut(c) for c in ("reassembled_forward", "reassembled_reverse") if c in df.columns})


def mac_hash(mac: Column, salt: bytes, keep_oui: bool = False) -> Column:
    """48 bits of a salted hash of a MAC; optionally only of its lower half."""
    h = F.unhex(F.substring(F.sha2(F.concat(F.lit(bytearray(salt)), mac), 256), 1, 12))
    return F.concat(take(mac, 0, 3), take(h, 0, 3)) if keep_oui else h


def hash_u64(data: Column, salt: bytes) -> Column:
    """A salted hash of bytes as an unsigned 64-bit number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(bytearray(salt)), data), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def anonymize_flows(flows: DataFrame, policy: Policy, ordered: bool = True) -> DataFrame:
    """Conversations under a policy: addresses, ports, times, sequence numbers, payloads, in this order. Rows keep their order columns."""
    out = flows
    if policy.ip_mode == "crypto_pan":
        out = anonymize_addresses(out, ["addr_a", "addr_b"], policy.key()).withColumns({"src_addr": ip_text(F.col("addr_a")), "dst_addr": ip_text(F.col("addr_b"))})
    out = anonymize_times(anonymize_ports(out, policy.port_mode), policy)
    if policy.tcp_seq_mode == "random_offset":
        out = anonymize_sequences(out, policy.seed)
    out = anonymize_payloads(out, policy)
    return out.orderBy("start_ns", "first_index") if ordered else out


def anonymize_packets(df: DataFrame, policy: Policy, frame: str = "frame") -> DataFrame:
    """Frames with both MACs hashed, as the policy's mac_mode says."""
    if policy.mac_mode == "none":
        return df
    salt = policy.hash_salt or hashlib.sha256(f"salt:{policy.seed}".encode()).digest()
    b, keep = F.col(frame), policy.mac_mode == "preserve_oui"
    return df.withColumn(frame, F.when(F.length(b) >= 14, F.concat(mac_hash(take(b, 0, 6), salt, keep), mac_hash(take(b, 6, 6), salt, keep), take(b, 12, F.length(b)))).otherwise(b))
