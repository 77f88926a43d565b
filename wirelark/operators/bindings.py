"""Which layer follows which: a registry of bindings, and its uses as lookups, as a join and as a Column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Binding:
    """upper follows lower where the lower layer's field has the value."""

    lower: str
    upper: str
    field: str
    value: int


#: Lower layer, field, and the upper layers by value.
DEFAULTS = [
    ("Ethernet", "type", {0x0806: "ARP", 0x0800: "IPv4", 0x86DD: "IPv6", 0x8100: "Dot1Q", 0x88A8: "Dot1AD", 0x88E7: "Dot1AH", 122: "LLC"}),
    ("Dot3", "len", {0: "LLC"}),
    ("Dot1Q", "type", {0x0806: "ARP", 0x0800: "IPv4", 0x86DD: "IPv6", 0x8100: "Dot1Q", 0x88A8: "Dot1AD", 0x88E7: "Dot1AH"}),
    ("Dot1AD", "type", {0x88A8: "Dot1AD", 0x8100: "Dot1Q", 0x88E7: "Dot1AH"}),
    ("IPv4", "proto", {6: "TCP", 17: "UDP", 1: "ICMP"}),
    ("IPv6", "nh", {6: "TCP", 17: "UDP", 58: "ICMPv6"}),
    ("TCP", "dport", {443: "TLS", 53: "DNS", 80: "HTTP", 8080: "HTTP", 8000: "HTTP", 8008: "HTTP", 8888: "HTTP", 502: "Modbus", 1883: "MQTT"}),
    ("UDP", "dport", {53: "DNS", 443: "QUIC", 4433: "QUIC", 1701: "L2TP", 1883: "MQTTSN"}),
]


@dataclass
class Bindings:
    """Bindings in order; where several fit, the first holds."""

    known: list[Binding] = field(default_factory=lambda: [Binding(lower, upper, name, value) for lower, name, by in DEFAULTS for value, upper in by.items()])

    def register(self, lower: str, upper: str, field: str, value: int) -> None:
        """Add a binding; it replaces all those of the same two layers."""
        self.known = [b for b in self.known if (b.lower, b.upper) != (lower, upper)] + [Binding(lower, upper, field, value)]

    def find(self, lower: str, upper: str) -> Binding | None:
        return next((b for b in self.known if (b.lower, b.upper) == (lower, upper)), None)

    def above(self, lower: str) -> list[Binding]:
        return [b for b in self.known if b.lower == lower]

    def below(self, upper: str) -> list[Binding]:
        return [b for b in self.known if b.upper == upper]

    def infer(self, lower: str, field: str, value: int) -> str | None:
        return next((b.upper for b in self.known if (b.lower, b.field, b.value) == (lower, field, value)), None)

    def dimension(self, spark: SparkSession) -> DataFrame:
        """lower, field, value, upper: one row for each field value."""
        first = {(b.lower, b.field, b.value): b.upper for b in reversed(self.known)}
        return spark.createDataFrame([(*k, v) for k, v in first.items()], "lower string, field string, value bigint, upper string")

    def next_layer(self, lower: str, field: str, value: Column) -> Column:
        """The upper layer of a field's value; NULL where none is bound."""
        out = F.lit(None).cast("string")
        for b in reversed(self.above(lower)):
            if b.field == field:
                out = F.when(value == b.value, b.upper).otherwise(out)
        return out
