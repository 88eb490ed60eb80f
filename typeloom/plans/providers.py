"""Where tables come from: a provider gives the table of a schema, or None."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from typeloom.plans.model import abstract
from typeloom.schema import DbSchema, Schema, Table, session, tables_of_rows

Provider = Callable[[type[Schema]], "Table | None"]


def provider_of_tables(*tables: Table) -> Provider:
    return {t.schema: t for t in tables}.get


def provider_from_rows(rows: Iterable[Schema], empty: Iterable[type[Schema]] = ()) -> Provider:
    return tables_of_rows(rows, empty).get


def chain_providers(*providers: Provider) -> Provider:
    """The first that has the table."""

    def first(schema: type[Schema]) -> Table | None:
        for p in providers:
            if (found := p(schema)) is not None:
                return found
        return None

    return first


class EmptyTableProvider:
    """An empty table of any schema."""

    def __call__(self, schema: type[Schema]) -> Table:
        return Table(session().createDataFrame([], schema.struct_type()), schema)


class AbstractTableProvider:
    """Tables with a schema and no rows, which cannot be fetched."""

    def __call__(self, schema: type[Schema]) -> Table:
        return abstract(schema)

    @staticmethod
    def from_reference(table: Table) -> Table:
        return abstract(table.schema)


@dataclass(frozen=True)
class DbTableProvider:
    """Tables of the catalog, for schemas that are bound to one."""

    spark: SparkSession | None = None

    def __call__(self, schema: type[Schema]) -> Table | None:
        if not issubclass(schema, DbSchema):
            return None
        return Table((self.spark or session()).table(schema.full_name()).select(*schema.types()), schema)


@dataclass(frozen=True)
class FilteredTableProvider:
    """A provider for some schemas only, by their classes; exclusion comes first."""

    provider: Any
    include: tuple[type, ...] = (Schema,)
    exclude: tuple[type, ...] = field(default=())

    def __call__(self, schema: type[Schema]) -> Table | None:
        if self.exclude and issubclass(schema, self.exclude):
            return None
        return self.provider(schema) if issubclass(schema, self.include) else None
