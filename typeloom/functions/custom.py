"""Checksums, JSON, UUIDs and digit checks."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.methods import ValueMethod

#: Fixed value: the multiplier of the compatible integer hash.
HASH_MULTIPLIER = 0xD6E8FEB86659FD93
_MASK = (1 << 63) - 1


def _bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once, however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _times(x: Column, by: int) -> Column:
    """The low 64 bits of a product, from limbs of 16 bits: in ANSI mode a product that wraps is an error."""
    limbs = [F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    factors = [F.lit(by >> 16 * i & 0xFFFF).cast("bigint") for i in range(4)]
    sums = [functools.reduce(operator.add, [limbs[i] * factors[m - i] for i in range(m + 1)]) for m in range(4)]
    word = F.lit(0xFFFFFFFF).cast("bigint")
    low = sums[0] + F.shiftleft(sums[1].bitwiseAND(F.lit(0xFFFF)), 16)
    high = F.shiftrightunsigned(sums[1], 16) + sums[2] + F.shiftleft(sums[3].bitwiseAND(F.lit(0xFFFF)), 16)
    return _bound(low, lambda v: F.shiftleft((high + F.shiftrightunsigned(v, 32)).bitwiseAND(word), 32).bitwiseOR(v.bitwiseAND(word)))


def compatible_hash(column: Column) -> Column:
    """A 64-bit finaliser of integers (two rounds of shift and multiply). Null stays null, which a checksum passes over."""
    x = column.cast("bigint")
    for _ in range(2):
        x = _bound(x, lambda v: _bound(v.bitwiseXOR(F.shiftrightunsigned(v, 32)), lambda w: _times(w, HASH_MULTIPLIER)))
    return _bound(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 32)))


def hashed(column: Column, kind: T.DataType | None = None) -> Column:
    """xxhash64; maps are hashed by their sorted entries."""
    if isinstance(kind, T.MapType):
        column = F.array_sort(F.map_entries(column))
    return F.xxhash64(column)


class Hash(ValueMethod):
    """xxhash64, or with ``compatible`` the in-process engine's numbers for integers (as signed ones)."""

    def __init__(self, compatible: bool = False):
        self.compatible = compatible

    def apply(self, column: Column) -> Column:
        return compatible_hash(column) if self.compatible else hashed(column)


class ColumnChecksum(ValueMethod):
    """A checksum of a column's values that does not depend on their order.

    ``compatible`` gives the numbers of the in-process engine for integers; else
    xxhash64 is used, which is faster. Two equal values cancel out.
    """

    def __init__(self, where: Column | None = None, compatible: bool = False):
        self.where, self.compatible = where, compatible

    def apply(self, column: Column) -> Column:
        value = compatible_hash(column) if self.compatible else hashed(column)
        if self.where is not None:
            value = F.when(self.where, value)
        return F.bit_xor(value).bitwiseAND(F.lit(_MASK))


class JsonParse(ValueMethod):
    """JSON text to a variant."""

    def apply(self, column: Column) -> Column:
        return F.parse_json(column)


class JsonFormat(ValueMethod):
    def apply(self, column: Column) -> Column:
        return F.to_json(column)


class JsonGet(ValueMethod):
    """A value inside a variant: a path such as ``$.key.array[0]`` and a type. What is not there, or of another type, is null."""

    def __init__(self, path: str, kind: str = "string"):
        self.path, self.kind = path, kind

    def apply(self, column: Column) -> Column:
        return F.try_variant_get(column, self.path, self.kind)


class IntToUUID(ValueMethod):
    """A 64-bit number, by its two's complement, in the low half of a UUID."""

    def apply(self, column: Column) -> Column:
        digits = F.lpad(F.lower(F.hex(column.cast("bigint"))), 32, "0")
        return F.concat_ws("-", *[F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


class LuhnCheck(ValueMethod):
    """Is the last digit the check digit of the others? False for what is not digits."""

    def apply(self, column: Column) -> Column:
        return F.call_function("luhn_check", column)


def struct(**fields: Any) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def map_of(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)
