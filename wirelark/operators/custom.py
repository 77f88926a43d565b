"""Protocols declared at run time: field lists that compile to build and parse expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelark.functions.bytesx import pad_to, put, take, uint, uint64, uint_le


@dataclass(frozen=True)
class Field:
    name: str
    default: int | bytes
    size: int
    kind: str = "int"


def ByteField(name: str, default: int = 0) -> Field:
    return Field(name, default, 1)


def ShortField(name: str, default: int = 0) -> Field:
    return Field(name, default, 2)


def IntField(name: str, default: int = 0) -> Field:
    return Field(name, default, 4)


def LongField(name: str, default: int = 0) -> Field:
    return Field(name, default, 8, "long")


def LEField(name: str, size: int, default: int = 0) -> Field:
    """A little-endian integer of 2 to 7 bytes."""
    return Field(name, default, size, "le")


def StrLenField(name: str, default: bytes = b"", length: int = 0) -> Field:
    return Field(name, default, length, "bytes")


_registry: dict[str, Protocol] = {}


class Protocol:
    """Fields one after the other. Building takes Columns or literals by name; unknown names are a TypeError."""

    def __init__(self, name: str, fields: list[Field]):
        names = [f.name for f in fields]
        if len(set(names)) != len(names):
            raise ValueError("field names repeat")
        self.name, self.fields = name, fields
        _registry[name] = self

    def __len__(self) -> int:
        return sum(f.size for f in self.fields)

    def encode(self, f: Field, value: Column) -> Column:
        if f.kind == "bytes":
            return pad_to(take(value.cast("binary"), 0, f.size), f.size)
        if f.kind == "le":
            return F.concat(*(put(F.shiftright(value.cast("bigint"), 8 * i), 1) for i in range(f.size)))
        if f.kind == "long":
            return F.unhex(F.lpad(F.hex(value.cast("bigint")), 16, "0"))
        return put(value, f.size)

    def build(self, payload: Column | None = None, **values: Column | int | bytes) -> Column:
        unknown = set(values) - {f.name for f in self.fields}
        if unknown:
            raise TypeError(f"{self.name} has no field {', '.join(sorted(unknown))}")
        lit = lambda v: v if isinstance(v, Column) else F.lit(bytearray(v) if isinstance(v, bytes) else v)
        parts = [self.encode(f, lit(values.get(f.name, f.default))) for f in self.fields]
        return F.concat(*parts, *([payload] if payload is not None else []))

    def parse(self, b: Column) -> Column:
        """STRUCT of the fields. Fields past the end keep their defaults; an integer that is cut is NULL, bytes are what there is."""
        out, at = [], 0
        for f in self.fields:
            gone = F.length(b) <= at
            read = {"bytes": lambda: take(b, at, f.size), "le": lambda: uint_le(b, at, f.size), "long": lambda: uint64(b, at)}.get(f.kind, lambda: uint(b, at, f.size))()
            default = F.lit(bytearray(f.default) if isinstance(f.default, bytes) else f.default)
            out.append(F.when(gone, default.cast("binary") if f.kind == "bytes" else default).otherwise(read).alias(f.name))
            at += f.size
        return F.struct(*out)

    def payload(self, b: Column) -> Column:
        return take(b, len(self), F.length(b))

    def show(self, b: Column) -> Column:
        return F.to_json(self.parse(b))


def get_protocol(name: str) -> Protocol:
    return _registry[name]


def list_protocols() -> list[str]:
    return sorted(_registry)


def stack(*layers: Column) -> Column:
    """Layers one inside the other: bytes end to end."""
    return F.concat(*layers)
