"""Joins on key columns of the same names.

Tables are joined from the left. A right column whose name is taken gets the suffix
``_right``; keys appear once. Named columns of both sides can be resolved into one:
``arbitrary`` takes the first that is not null, ``max`` and ``min`` the greater or
lesser (nulls count for nothing); this only concerns columns that do collide. Keys of
an outer join are those of either side. No keys: every row meets every row.

A name that would occur twice in the result is an error.
"""

from __future__ import annotations

from collections.abc import Iterable
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.methods import TableMethod
from typeloom.operators.relational import named
from typeloom.schema import frame

SUFFIX = "_right"


class JoinMethod(str, Enum):
    INNER, LEFT, OUTER, ANTI, SEMI, ANY_INNER, ANY_LEFT, CROSS = "inner", "left", "outer", "anti", "semi", "any_inner", "any_left", "cross"


_SPARK = {"inner": "inner", "left": "left", "outer": "full_outer", "anti": "left_anti", "semi": "left_semi", "any_inner": "inner", "any_left": "left", "cross": "cross"}


def _one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The least row of each key, so that reruns agree."""
    from typeloom.operators.relational import distinct

    return distinct(df, on=keys)


def _join_two(left: DataFrame, right: DataFrame, keys: list[str], how: JoinMethod, resolve: dict[str, Any]) -> DataFrame:
    if how in (JoinMethod.ANY_INNER, JoinMethod.ANY_LEFT):
        right = _one_per_key(right, keys)
    if how in (JoinMethod.ANTI, JoinMethod.SEMI):
        return left.join(right.select(*[named(k) for k in keys]), keys, _SPARK[how.value]) if keys else left.join(right, F.lit(True), _SPARK[how.value])
    taken = [c for c in right.columns if c in left.columns and c not in keys]
    clash = [c for c in taken if c + SUFFIX in left.columns or c + SUFFIX in right.columns]
    if clash:
        raise ValueError(f"the join would have two columns of the same name: {sorted(c + SUFFIX for c in clash)}")
    for c in taken:
        right = right.withColumnRenamed(c, c + SUFFIX)
    if not keys:
        joined = left.crossJoin(right) if how in (JoinMethod.CROSS, JoinMethod.INNER) else left.join(right, F.lit(True), _SPARK[how.value])
    else:
        joined = left.join(right, keys, _SPARK[how.value])  # a using join gives either side's keys if it is a full one
    out: list[Column] = []
    for c in [*left.columns, *(c for c in right.columns if c not in keys)]:
        base = c.removesuffix(SUFFIX)
        if c in resolve and c in taken:
            out.append(resolve[c](named(c), named(c + SUFFIX)).alias(c))
        elif not (c.endswith(SUFFIX) and base in resolve and base in taken):
            out.append(named(c))
    return joined.select(*out)


def join(table: Any, *others: Any, keys: Iterable[str] = (), how: JoinMethod | str = JoinMethod.INNER, arbitrary: Iterable[str] = (), max: Iterable[str] = (), min: Iterable[str] = ()) -> DataFrame:
    method, keys = JoinMethod(how), list(keys)
    resolve: dict[str, Any] = {**{c: F.coalesce for c in arbitrary}, **{c: F.greatest for c in max}, **{c: F.least for c in min}}
    out = frame(table)
    for other in others:
        out = _join_two(out, frame(other), keys, method, resolve)
    return out


class Join(TableMethod):
    """``left @ Join(right, ..., keys=[...])``; the classes below name the kinds."""

    method = JoinMethod.INNER

    def __init__(self, *tables: Any, keys: Iterable[str] = (), arbitrary: Iterable[str] = (), max: Iterable[str] = (), min: Iterable[str] = (), how: JoinMethod | str | None = None):
        self.tables, self.how = tables, JoinMethod(how or self.method)
        self.options = {"keys": list(keys), "arbitrary": tuple(arbitrary), "max": tuple(max), "min": tuple(min)}

    def apply(self, df: DataFrame) -> DataFrame:
        return join(df, *self.tables, how=self.how, **self.options)


class InnerJoin(Join):
    method = JoinMethod.INNER


class LeftJoin(Join):
    method = JoinMethod.LEFT


class OuterJoin(Join):
    method = JoinMethod.OUTER


class AntiJoin(Join):
    method = JoinMethod.ANTI


class SemiJoin(Join):
    method = JoinMethod.SEMI


class OuterJoinParallel(Join):
    """Full joins in pairs, then pairs of pairs: the depth grows with the logarithm of the tables."""

    method = JoinMethod.OUTER

    def apply(self, df: DataFrame) -> DataFrame:
        level = [df, *map(frame, self.tables)]
        while len(level) > 1:
            level = [join(*level[i : i + 2], how=JoinMethod.OUTER, **self.options) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]
