"""Column types: annotations for schema fields, their Spark types, and value codecs.

A field is annotated with an alias (``Int64``, ``Array[String]``) or declared with a
type string (``"timestamp(6)"``, ``"array<int64>"``). Types without a Spark
counterpart in every session (UUID, JSON, and TIME, which is off by default and not in
Parquet) are strings that carry a tag in the field's metadata, and a codec turns
Python values into stored ones and back.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from dataclasses import dataclass
from decimal import Decimal as PyDecimal
from typing import Any

from pyspark.sql import types as T

TAG = "typeloom.type"


@dataclass(frozen=True)
class ColumnType:
    """A declared type: its name, its Spark type and, for containers, the types inside."""

    name: str
    spark: T.DataType
    inner: tuple[ColumnType, ...] = ()
    fields: tuple[str, ...] = ()

    def __str__(self) -> str:
        if self.name == "struct":
            return "struct<" + ",".join(f"{n}:{t}" for n, t in zip(self.fields, self.inner)) + ">"
        return f"{self.name}<{','.join(map(str, self.inner))}>" if self.inner else self.name

    def metadata(self) -> dict[str, str]:
        return {TAG: str(self)}

    # Python value -> stored value, and back

    def encode(self, value: Any) -> Any:
        if value is None:
            return None
        match self.name:
            case "uuid":
                return str(uuid.UUID(str(value)))
            case "time":
                return value.isoformat("microseconds")
            case "json":
                return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
            case "array":
                return [self.inner[0].encode(v) for v in value]
            case "map":
                return {self.inner[0].encode(k): self.inner[1].encode(v) for k, v in value.items()}
            case "struct":
                got = value if isinstance(value, dict) else vars(value)
                return tuple(t.encode(got.get(n)) for n, t in zip(self.fields, self.inner))
            case "float32" | "float64":
                return float(value)
            case "binary":
                return bytearray(value)
        return value

    def decode(self, value: Any) -> Any:
        if value is None:
            return None
        match self.name:
            case "uuid":
                return uuid.UUID(value)
            case "time":
                return dt.time.fromisoformat(value)
            case "json":
                return json.loads(value)
            case "array":
                return [self.inner[0].decode(v) for v in value]
            case "map":
                return {self.inner[0].decode(k): self.inner[1].decode(v) for k, v in value.items()}
            case "struct":
                return {n: t.decode(v) for n, t, v in zip(self.fields, self.inner, value)}
            case "binary":
                return bytes(value)
        return value


#: Simple type names and their Spark types.
SIMPLE: dict[str, T.DataType] = {
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "time": T.StringType(),
    "uuid": T.StringType(),
    "json": T.StringType(),
}
DEFAULT_DECIMAL = (18, 3)


def simple(name: str) -> ColumnType:
    return ColumnType(name, SIMPLE[name])


def array_of(item: ColumnType) -> ColumnType:
    return ColumnType("array", T.ArrayType(item.spark), (item,))


def map_of(key: ColumnType, value: ColumnType) -> ColumnType:
    return ColumnType("map", T.MapType(key.spark, value.spark), (key, value))


def struct_of(fields: dict[str, ColumnType]) -> ColumnType:
    return ColumnType("struct", T.StructType([T.StructField(n, t.spark) for n, t in fields.items()]), tuple(fields.values()), tuple(fields))


def decimal_of(precision: int, scale: int) -> ColumnType:
    return ColumnType(f"decimal({precision},{scale})", T.DecimalType(precision, scale))


def parse(text: str) -> ColumnType:
    """Read a type string."""
    text = text.strip()
    if m := re.fullmatch(r"(array|map|struct)<(.*)>", text, re.S):
        parts = _split(m[2])
        if m[1] == "array" and len(parts) == 1:
            return array_of(parse(parts[0]))
        if m[1] == "map" and len(parts) == 2:
            return map_of(parse(parts[0]), parse(parts[1]))
        if m[1] == "struct":
            return struct_of({n.strip(): parse(t) for n, t in (p.split(":", 1) for p in parts)})
    if m := re.fullmatch(r"decimal(?:\((\d+)\s*,\s*(\d+)\))?", text):
        return decimal_of(*(map(int, m.groups()) if m[1] else DEFAULT_DECIMAL))
    if re.fullmatch(r"timestamp\(\d\)", text):  # Spark keeps microseconds always
        return ColumnType(text, T.TimestampNTZType())
    if text in SIMPLE:
        return simple(text)
    raise ValueError(f"unknown type: {text!r}")


def _split(text: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(text[at:i])
            at = i + 1
    return [*parts, text[at:]]


def of_spark(kind: T.DataType, tag: str | None = None) -> ColumnType:
    """The declared type of a Spark column; a tag tells UUID and JSON from strings."""
    if tag:
        found = parse(tag)
        if found.spark == kind:
            return found
    if isinstance(kind, T.ArrayType):
        return array_of(of_spark(kind.elementType))
    if isinstance(kind, T.MapType):
        return map_of(of_spark(kind.keyType), of_spark(kind.valueType))
    if isinstance(kind, T.StructType):
        return struct_of({f.name: of_spark(f.dataType) for f in kind})
    if isinstance(kind, T.DecimalType):
        return decimal_of(kind.precision, kind.scale)
    if isinstance(kind, T.TimestampType):
        return simple("timestamp")
    for name, spark in SIMPLE.items():
        if spark == kind:
            return simple(name)
    if isinstance(kind, T.NullType):
        return ColumnType("null", kind)
    return ColumnType(kind.simpleString(), kind)


def spark_type(declared: str | type | ColumnType | T.DataType) -> T.DataType:
    """The Spark type of a type string, alias, Python type or Spark type."""
    if isinstance(declared, T.DataType):
        return declared
    if isinstance(declared, ColumnType):
        return declared.spark
    if isinstance(declared, str):
        return parse(declared).spark
    return PYTHON[declared].spark


class Alias:
    """What a schema field is annotated with."""

    def __init__(self, declared: ColumnType):
        self.declared = declared

    def __repr__(self) -> str:
        return str(self.declared)

    def __or__(self, other: Any) -> Alias:  # `Int64 | None`: every column can be null anyway
        return self

    __ror__ = __or__


class _ArrayAlias:
    def __getitem__(self, item: Any) -> Alias:
        return Alias(array_of(declared_of(item)))


class _MapAlias:
    def __getitem__(self, items: Any) -> Alias:
        return Alias(map_of(declared_of(items[0]), declared_of(items[1])))


class _StructAlias:
    """``Struct[SomeTypedDict]`` or ``Struct[{"name": String}]``."""

    def __getitem__(self, fields: Any) -> Alias:
        named = fields if isinstance(fields, dict) else __import__("typing").get_type_hints(fields)
        return Alias(struct_of({n: declared_of(t) for n, t in named.items()}))


Int8, Int16, Int32, Int64 = (Alias(simple(f"int{n}")) for n in (8, 16, 32, 64))
Float32, Float64 = Alias(simple("float32")), Alias(simple("float64"))
Boolean, String, Binary = Alias(simple("boolean")), Alias(simple("string")), Alias(simple("binary"))
Date, Timestamp, UUID, JSON = Alias(simple("date")), Alias(simple("timestamp")), Alias(simple("uuid")), Alias(simple("json"))
Time = Alias(simple("time"))
Decimal = Alias(decimal_of(*DEFAULT_DECIMAL))
Array, Map, Struct = _ArrayAlias(), _MapAlias(), _StructAlias()

#: Categories, for signatures only: they name no column type.
Integer, Floating, Numeric, DateCompatible = (f"category:{n}" for n in ("integer", "floating", "numeric", "date compatible"))

PYTHON = {int: simple("int64"), float: simple("float64"), bool: simple("boolean"), str: simple("string"), bytes: simple("binary"), dt.date: simple("date"), dt.datetime: simple("timestamp"), uuid.UUID: simple("uuid"), PyDecimal: decimal_of(*DEFAULT_DECIMAL)}


def declared_of(annotation: Any) -> ColumnType:
    if isinstance(annotation, Alias):
        return annotation.declared
    if isinstance(annotation, ColumnType):
        return annotation
    if isinstance(annotation, str):
        return parse(annotation)
    if annotation in PYTHON:
        return PYTHON[annotation]
    raise KeyError(f"{annotation!r} is no column type")
