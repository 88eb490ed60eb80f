"""Typed schemas: one class is a relation type and a row type."""

from __future__ import annotations

import dataclasses
import re
import sys
import typing
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any, ClassVar, Generic, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom import types as tt

S = TypeVar("S", bound="Schema")


class this_:
    """``this.a`` and ``this["a"]`` are columns by name; ``this.count()`` counts rows."""

    def __getitem__(self, name: str) -> Column:
        return F.col(f"`{name}`" if "." in name else name)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def count(self) -> Column:
        return F.count(F.lit(1))


this = this_()


def safe_name(name: str) -> str:
    """A Python name for a column name."""
    import keyword

    made = re.sub(r"\W", "_", name)
    made = f"_{made}" if made[:1].isdigit() else made
    return f"{made}_" if keyword.iskeyword(made) else made


def snake_case(name: str) -> str:
    """Each capital begins a word: ``UUIDTable`` is ``u_u_i_d_table``."""
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


class Columns:
    """Column names by attribute: ``Schema.cols.amount == "amount"``."""

    def __init__(self, names: dict[str, str]):
        self.__dict__.update(names)

    def __iter__(self) -> Iterator[str]:
        return iter(self.__dict__.values())


class _OfClass:
    def __init__(self, make):
        self.make = make

    def __get__(self, _, owner):
        return self.make(owner)


class SchemaMeta(type):
    """``SomeSchema @ Method()`` lets the method make a new class of the schema."""

    def __matmul__(cls, method: Any) -> Any:
        if hasattr(method, "apply_to_schema"):
            return method.apply_to_schema(cls)
        return NotImplemented


class Schema(metaclass=SchemaMeta):
    """Base of all schemas. Subclasses are frozen dataclasses; every field may be null.

    ``table_schema`` (name to type) comes from the annotations unless a class gives
    it itself, which also allows columns whose names are not Python names.
    """

    table_schema: ClassVar[dict[str, Any]]

    def __init_subclass__(cls, **kw: Any):
        super().__init_subclass__(**kw)
        hints = cls.__dict__.get("__annotations__", {})
        for name, hint in hints.items():
            if not str(hint).startswith("ClassVar") and name not in cls.__dict__ and name != "table_schema":
                setattr(cls, name, None)
        dataclass(frozen=True)(cls)

    @classmethod
    def types(cls) -> dict[str, tt.ColumnType]:
        """Column names and declared types, in order."""
        if "_types" in cls.__dict__:
            return cls.__dict__["_types"]
        given = next((c.__dict__["table_schema"] for c in cls.__mro__ if "table_schema" in c.__dict__), None)
        if given is not None:
            found = {n: tt.declared_of(t) for n, t in given.items()}
        else:
            scope = vars(sys.modules.get(cls.__module__, tt)) | vars(tt)
            found = {f.name: tt.declared_of(eval(f.type, scope) if isinstance(f.type, str) else f.type) for f in dataclasses.fields(cls)}  # noqa: S307
        cls._types = found
        return found

    cols: ClassVar[Columns] = _OfClass(lambda cls: Columns(dict(zip([f.name for f in dataclasses.fields(cls)] or map(safe_name, cls.types()), cls.types()))))

    @classmethod
    def struct_type(cls) -> T.StructType:
        return T.StructType([T.StructField(n, t.spark, True, t.metadata()) for n, t in cls.types().items()])

    @classmethod
    def of_rows(cls: type[S], rows: Iterable[S], spark: SparkSession | None = None) -> Table[S]:
        """A literal table of the rows."""
        kinds = list(cls.types().values())
        values = [tuple(t.encode(v) for t, v in zip(kinds, row.values())) for row in rows]
        return Table((spark or session()).createDataFrame(values, cls.struct_type()), cls)

    @classmethod
    def of(cls: type[S], df: DataFrame) -> Table[S]:
        return Table(df, cls)

    def values(self) -> tuple:
        return tuple(getattr(self, f.name) for f in dataclasses.fields(self))

    @classmethod
    def of_values(cls: type[S], values: Iterable[Any]) -> S:
        return cls(*(t.decode(v) for t, v in zip(cls.types().values(), values)))


class DbSchema(Schema):
    """A schema that is bound to a table of the catalog."""

    table_name: ClassVar[str]
    namespace: ClassVar[tuple[str, ...]] = ()

    @classmethod
    def full_name(cls) -> str:
        return ".".join(f"`{p}`" for p in (*cls.namespace, cls.table_name))


@dataclass(frozen=True)
class Table(Generic[S]):
    """A DataFrame and its schema class. An abstract table has a schema only and cannot be fetched."""

    df: DataFrame
    schema: type[S]
    abstract: bool = False

    @property
    def cols(self) -> Columns:
        return self.schema.cols

    def __matmul__(self, method: Any) -> DataFrame:
        return method.__rmatmul__(self.df)


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("there is no active Spark session")
    return found


def frame(table: Table | DataFrame) -> DataFrame:
    return table.df if isinstance(table, Table) else table


def rows_of(table: Table[S]) -> Iterator[S]:
    """Typed rows of a table, streamed partition by partition."""
    if table.abstract:
        raise ValueError(f"{table.schema.__name__} is abstract: it has a schema and no rows")
    names = list(table.schema.types())
    for row in table.df.select(*[F.col(f"`{n}`") for n in names]).toLocalIterator(prefetchPartitions=True):
        yield table.schema.of_values(row)


def tables_of_rows(rows: Iterable[Schema], empty: Iterable[type[Schema]] = (), spark: SparkSession | None = None) -> dict[type[Schema], Table]:
    """One table for each class among the rows, and empty ones besides. The order of rows means nothing."""
    grouped: dict[type[Schema], list[Schema]] = {c: [] for c in empty}
    for row in rows:
        grouped.setdefault(type(row), []).append(row)
    return {c: c.of_rows(r, spark) for c, r in grouped.items()}


def generated(name: str, df: DataFrame, base: type = Schema, **members: Any) -> type[Schema]:
    """A schema class with the columns of a DataFrame."""
    declared = {f.name: tt.of_spark(f.dataType, (f.metadata or {}).get(tt.TAG)) for f in df.schema}
    fields = {safe_name(n): "Any" for n in declared}
    return type(base)(name, (base,), {"__annotations__": fields, "table_schema": declared, "__module__": __name__, **members})
