"""Transforms that can be undone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from typeloom import types as tt
from typeloom.methods import SchemaMethod
from typeloom.operators.relational import named
from typeloom.plans.model import IdentityTableExpression, SingleInputTableExpression
from typeloom.schema import Schema, Table, generated


@dataclass(frozen=True)
class RevertibleTableExpression(SingleInputTableExpression):
    """``forward`` makes the table of the new class, and ``backward`` that of the origin again."""

    def forward(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def backward(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def build(self, *inputs: Table) -> DataFrame:
        return self.forward(inputs[0].df)

    def __call__(self, table: Table) -> Table:
        return Table(self.forward(table.df), self.as_expression_schema())

    def revert_call(self, table: Table) -> Table:
        return Table(self.backward(table.df), self.origin)


def revert_expression(schema: type[Schema]) -> RevertibleTableExpression | None:
    """The transform that made a class, if it can be undone."""
    made_by = getattr(schema, "origin_expression", None)
    return made_by if isinstance(made_by, RevertibleTableExpression) else None


def revert_all(table: Table) -> Table:
    """Undo transforms until a schema that no revertible one made."""
    while (made_by := revert_expression(table.schema)) is not None:
        table = made_by.revert_call(table)
    return table


class AsRevertible(SchemaMethod):
    """``Schema @ AsRevertible(SomeTransform)``."""

    def __init__(self, transform: type[RevertibleTableExpression]):
        self.transform = transform

    def apply_to_schema(self, schema: type[Schema]) -> type[Schema]:
        return self.transform(schema).as_expression_schema()


@dataclass(frozen=True)
class ExpressionExport(RevertibleTableExpression, IdentityTableExpression):
    """The same table under the same name."""

    def forward(self, df: DataFrame) -> DataFrame:
        return df

    def backward(self, df: DataFrame) -> DataFrame:
        return df

    def build(self, *inputs: Table) -> DataFrame:
        return inputs[0].df

    def generated_class_name(self) -> str:
        return self.origin.__name__


@dataclass(frozen=True)
class UUIDToStringExport(RevertibleTableExpression):
    """UUID columns as plain strings. They are strings already, so only the declared type changes."""

    def _as(self, df: DataFrame, kinds: dict[str, tt.ColumnType]) -> DataFrame:
        return df.select(*[named(c).alias(c, metadata=k.metadata()) for c, k in kinds.items()])

    def forward(self, df: DataFrame) -> DataFrame:
        return self._as(df, {c: tt.simple("string") if k.name == "uuid" else k for c, k in self.origin.types().items()})

    def backward(self, df: DataFrame) -> DataFrame:
        return self._as(df, self.origin.types())

    def output_schema(self) -> type[Schema]:
        return generated(self.generated_class_name(), self.forward(self_empty(self.origin)))


def self_empty(schema: type[Schema]) -> DataFrame:
    from typeloom.plans.model import abstract

    return abstract(schema).df
