"""Scalar operators: conditions, nulls, logic, casts and what deferred chains find on columns."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from typeloom.methods import ArgsMethod, ValueMethod, as_value
from typeloom.types import spark_type


class IfElse(ValueMethod):
    """``condition @ IfElse(a, b)``; a null condition takes the second."""

    def __init__(self, yes: Any, no: Any):
        self.yes, self.no = yes, no

    def apply(self, column: Column) -> Column:
        return F.when(column, as_value(self.yes)).otherwise(as_value(self.no))


class Cases(ValueMethod):
    """``default @ Cases((condition, value), ...)``: the left side is what holds if no condition does."""

    def __init__(self, *cases: tuple[Column, Any]):
        self.cases = cases

    def __rmatmul__(self, default: Any) -> Column:
        return self.apply(as_value(default))

    def apply(self, column: Column) -> Column:
        out: Any = F
        for condition, value in self.cases:
            out = out.when(condition, as_value(value))
        return out.otherwise(column)


class FillNull(ArgsMethod):
    def apply(self, column: Column) -> Column:
        return F.coalesce(column, *self.columns())


class Greatest(ArgsMethod):
    """Nulls count for nothing."""

    def apply(self, column: Column) -> Column:
        return F.greatest(column, *self.columns()) if self.args else column


class Least(ArgsMethod):
    def apply(self, column: Column) -> Column:
        return F.least(column, *self.columns()) if self.args else column


class And(ArgsMethod):
    def apply(self, column: Column) -> Column:
        return functools.reduce(operator.and_, self.columns(), column)


class Or(ArgsMethod):
    def apply(self, column: Column) -> Column:
        return functools.reduce(operator.or_, self.columns(), column)


def literal(value: Any, kind: Any = None) -> Column:
    return F.lit(value) if kind is None else F.lit(value).cast(spark_type(kind))


def cast(column: Column, kind: Any) -> Column:
    return column.cast(spark_type(kind))


def try_cast(column: Column, kind: Any) -> Column:
    return column.try_cast(spark_type(kind))


def identical_to(column: Column, other: Any) -> Column:
    """Equality for which null equals null."""
    return column.eqNullSafe(as_value(other))


def _truncate(column: Column, unit: str) -> Column:
    unit = {"Y": "YEAR", "Q": "QUARTER", "M": "MM", "W": "WEEK", "D": "DAY"}.get(unit, unit)
    return F.date_trunc({"MM": "MONTH"}.get(unit, unit), column)


def _hashbytes(column: Column, how: str = "sha256") -> Column:
    known = {"md5": F.md5, "sha1": F.sha1, "sha224": lambda c: F.sha2(c, 224), "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384), "sha512": lambda c: F.sha2(c, 512)}
    if how not in known:
        raise ValueError(f"unknown digest: {how}")
    return known[how](column)


#: What a deferred chain finds by name on columns before the Column's own methods.
COLUMN_FUNCTIONS: dict[str, Callable] = {
    "fill_null": lambda c, *v: F.coalesce(c, *map(as_value, v)),
    "coalesce": lambda c, *v: F.coalesce(c, *map(as_value, v)),
    "nullif": lambda c, v: F.nullif(c, as_value(v)),
    "ifelse": lambda c, a, b: IfElse(a, b).apply(c),
    "cast": cast, "try_cast": try_cast, "identical_to": identical_to,
    "lower": F.lower, "upper": F.upper, "length": F.length, "ceil": F.ceil, "floor": F.floor, "abs": F.abs, "round": F.round, "isnan": F.isnan,
    "pow": lambda c, n: F.pow(c, as_value(n)),
    "hashbytes": _hashbytes,
    "day": F.dayofmonth, "month": F.month, "year": F.year, "truncate": _truncate, "date": lambda c: c.cast("date"),
    "time": lambda c: F.date_format(c, "HH:mm:ss.SSSSSS"),
    "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "count": F.count, "collect": F.collect_list,
    "arbitrary": lambda c: F.any_value(c, F.lit(True)),
    "argmax": lambda c, key: F.max_by(c, as_value(key)), "argmin": lambda c, key: F.min_by(c, as_value(key)),
    "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor, "all": F.bool_and, "any": F.bool_or, "nunique": F.count_distinct,
    "map": F.transform, "filter": F.filter, "keys": F.map_keys, "values": F.map_values, "repeat": lambda c, n: F.flatten(F.array_repeat(c, n)),
}
