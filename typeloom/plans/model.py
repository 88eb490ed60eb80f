"""Expressions: schema classes that know how to build their table from other tables."""

from __future__ import annotations

import functools
import inspect
import typing
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import DataFrame

from typeloom.schema import Schema, Table, generated, session


class Expression(Schema):
    """A schema whose table ``from_expression`` makes from typed input tables.

    Each parameter is annotated ``Table[SomeSchema]``; the evaluator looks these up.
    A DataFrame or a Table may be returned.
    """

    @classmethod
    def from_expression(cls, *inputs: Table) -> Table | DataFrame:
        raise NotImplementedError(f"{cls.__name__} has no from_expression")

    @classmethod
    def input_schemas(cls) -> dict[str, type[Schema]]:
        """Parameter names and the schemas they ask for."""
        function = cls.from_expression
        scope = vars(inspect.getmodule(function)) if inspect.getmodule(function) else {}
        local = getattr(cls, "_scope", {})
        found = {}
        for name, p in inspect.signature(function).parameters.items():
            hint = eval(p.annotation, {**scope, **local}) if isinstance(p.annotation, str) else p.annotation  # noqa: S307
            args = typing.get_args(hint)
            if not args or not isinstance(args[0], type):
                raise TypeError(f"{cls.__name__}.from_expression: {name} is not annotated as Table[...]")
            found[name] = args[0]
        return found

    @classmethod
    def build(cls, inputs: Iterable[Table]) -> Table:
        made = cls.from_expression(*inputs)
        df = made.df if isinstance(made, Table) else made
        names = list(cls.types())
        if set(names) - set(df.columns):
            raise ValueError(f"{cls.__name__} lacks columns: {sorted(set(names) - set(df.columns))}")
        return Table(df.select(*names), cls)


def is_expression(schema: type[Schema]) -> bool:
    return isinstance(schema, type) and issubclass(schema, Expression)


def abstract(schema: type[Schema]) -> Table:
    """An empty table that cannot be fetched; enough to see what a transform makes of it."""
    return Table(session().createDataFrame([], schema.struct_type()), schema, abstract=True)


@dataclass(frozen=True)
class GenericExpression:
    """A value object that makes an expression class: equal objects make the same class."""

    def input_schemas(self) -> tuple[type[Schema], ...]:
        raise NotImplementedError

    def build(self, *inputs: Table) -> DataFrame:
        raise NotImplementedError

    def generated_class_name(self) -> str:
        return type(self).__name__ + "Of" + "".join(s.__name__ for s in self.input_schemas())

    def output_schema(self) -> type[Schema]:
        """The schema of the result, seen by running on empty tables."""
        return generated(self.generated_class_name(), self.build(*map(abstract, self.input_schemas())))

    def as_expression_schema(self) -> type[Expression]:
        return _class_of(self)


@functools.cache
def _class_of(made_by: GenericExpression) -> type[Expression]:
    output = made_by.output_schema()
    inputs = made_by.input_schemas()

    class Made(Expression):
        table_schema: ClassVar[dict] = output.types()
        origin_expression: ClassVar[Any] = made_by

        @classmethod
        def from_expression(cls, *tables: Table) -> DataFrame:
            return made_by.build(*tables)

        @classmethod
        def input_schemas(cls) -> dict[str, type[Schema]]:
            return {f"input_{i}": s for i, s in enumerate(inputs)}

    name = made_by.generated_class_name()
    fields = {f: "Any" for f in output.__dict__.get("__annotations__", {})}
    return type(Made)(name, (Made,), {"__annotations__": fields, "__module__": __name__, "table_schema": output.types()})


@dataclass(frozen=True)
class TableExpression(GenericExpression):
    """A generic expression over tables that are given when it is made."""


@dataclass(frozen=True)
class SingleInputTableExpression(TableExpression):
    origin: type[Schema]

    def input_schemas(self) -> tuple[type[Schema], ...]:
        return (self.origin,)


@dataclass(frozen=True)
class IdentityTableExpression(SingleInputTableExpression):
    """Another class over the same table; the schema stays."""

    def build(self, *inputs: Table) -> DataFrame:
        return inputs[0].df

    def output_schema(self) -> type[Schema]:
        return self.origin


@dataclass(frozen=True)
class TableMethodExpression(SingleInputTableExpression):
    """A table operator as an expression."""

    method: Any
    preserves_schema: bool = False

    def build(self, *inputs: Table) -> DataFrame:
        return self.method.apply(inputs[0].df)

    def output_schema(self) -> type[Schema]:
        return self.origin if self.preserves_schema else super().output_schema()

    def generated_class_name(self) -> str:
        return type(self.method).__name__ + "Of" + self.origin.__name__
