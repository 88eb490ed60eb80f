"""The ``@`` algebra: operators on tables, columns and schemas, and deferred chains.

``DataFrame`` and ``Column`` know no ``@``, so ``df @ Method()`` reaches
``Method.__rmatmul__``; nothing is patched.
"""

from __future__ import annotations

import functools
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.schema import Schema, Table, frame


class TableMethod:
    """An operator from a table to a table. Subclasses give ``apply``."""

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __rmatmul__(self, table: Any) -> DataFrame:
        if isinstance(table, type):
            return NotImplemented
        return self.apply(frame(table))

    def __call__(self, table: Any) -> DataFrame:
        return self.apply(frame(table))

    def as_expression_schema(self, origin: type[Schema], preserves_schema: bool = False) -> type[Schema]:
        """An expression class whose table is this operator's result on ``origin``."""
        from typeloom.plans.model import TableMethodExpression

        return TableMethodExpression(origin, self, preserves_schema).as_expression_schema()


class ValueMethod:
    """An operator from a column (or a column's name) to a column. Subclasses give ``apply``."""

    def apply(self, column: Column) -> Column:
        raise NotImplementedError

    def __rmatmul__(self, column: Any) -> Column:
        return self.apply(as_column(column))

    def __call__(self, column: Any) -> Column:
        return self.apply(as_column(column))


class SelfMethod(ValueMethod):
    """A value operator whose result has the type of its input."""


class ArgsMethod(ValueMethod):
    """A value operator with further columns or literals as arguments."""

    def __init__(self, *args: Any):
        self.args = args

    def columns(self) -> list[Column]:
        return [as_value(a) for a in self.args]


class SchemaMethod:
    """An operator from a schema class to a new expression class: ``SomeSchema @ Method()``."""

    def apply_to_schema(self, schema: type[Schema]) -> type[Schema]:
        raise NotImplementedError


def as_column(value: Any) -> Column:
    """Columns stay; names become columns; other values become literals."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def as_value(value: Any) -> Column:
    """Columns stay; everything else, strings too, is a literal."""
    return value if isinstance(value, Column) else F.lit(value)


class Deferred:
    """A recorded chain of attributes, items and calls, replayed by ``value @ chain``.

    A step's name is looked up among the table operators of this library first (so
    ``deferred.rename({"new": "old"})`` means ours) and on the object otherwise.
    """

    def __init__(self, steps: tuple = ()):
        object.__setattr__(self, "_steps", steps)

    def __getattr__(self, name: str) -> Deferred:
        if name.startswith("__"):
            raise AttributeError(name)
        return Deferred((*self._steps, ("attribute", name)))

    def __getitem__(self, key: Any) -> Deferred:
        return Deferred((*self._steps, ("item", key)))

    def __call__(self, *args: Any, **kw: Any) -> Deferred:
        return Deferred((*self._steps, ("call", (args, kw))))

    def __rmatmul__(self, value: Any) -> Any:
        return functools.reduce(_replay, self._steps, value.df if isinstance(value, Table) else value)

    def __repr__(self) -> str:
        out = "deferred"
        for kind, what in self._steps:
            if kind == "attribute":
                out += f".{what}"
            elif kind == "item":
                out += f"[{what!r}]"
            else:
                out += "(" + ", ".join([*map(repr, what[0]), *(f"{k}={v!r}" for k, v in what[1].items())]) + ")"
        return out


def _replay(value: Any, step: tuple) -> Any:
    kind, what = step
    if kind == "attribute":
        if isinstance(value, DataFrame):
            from typeloom.operators import relational

            if what in relational.TABLE_FUNCTIONS:
                return functools.partial(relational.TABLE_FUNCTIONS[what], value)
        if isinstance(value, Column):
            from typeloom.functions import scalar

            if what in scalar.COLUMN_FUNCTIONS:
                return functools.partial(scalar.COLUMN_FUNCTIONS[what], value)
        return getattr(value, what)
    if kind == "item":
        return value[what]
    args, kw = what
    return value(*args, **kw)


deferred = Deferred()


def defer(_type: type) -> Deferred:
    """A chain for values of a type; the type is a hint for readers and tools only."""
    return Deferred()
