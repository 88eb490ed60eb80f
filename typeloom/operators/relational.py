"""Projections, shape and null operators. Each works out its output columns by name before it builds the plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.methods import TableMethod, as_value
from typeloom.schema import frame
from typeloom.types import spark_type


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def ordered_names(existing: Iterable[str], new: Iterable[str]) -> list[str]:
    """Existing columns in the table's order, then new ones in theirs."""
    existing = list(existing)
    return [*existing, *(n for n in new if n not in existing)]


class Select(TableMethod):
    """Keep columns and add expressions.

    No names: all columns. The order is that of the table, whatever the order of the
    names; names that the table lacks are ignored. ``expr`` replaces columns in their
    place and appends new ones; ``drop`` comes last.
    """

    def __init__(self, *names: str, expr: Mapping[str, Any] | None = None, drop: Iterable[str] = ()):
        self.names, self.expr, self.drop = names, dict(expr or {}), tuple(drop)

    def apply(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if not self.names or c in self.names or c in self.expr]
        out = [n for n in ordered_names(kept, self.expr) if n not in self.drop]
        return df.select(*[as_value(self.expr[n]).alias(n) if n in self.expr else named(n) for n in out])


def select(table: Any, *names: str | Mapping[str, Any], drop: Iterable[str] = ()) -> DataFrame:
    """Function form of ``Select``; with nothing but a dict the result has only its expressions."""
    exprs = {k: v for n in names if isinstance(n, Mapping) for k, v in n.items()}
    plain = [n for n in names if isinstance(n, str)]
    if exprs and not plain and not drop:
        return frame(table).select(*[as_value(v).alias(k) for k, v in exprs.items()])
    return Select(*plain, expr=exprs, drop=drop).apply(frame(table))


def mutate(df: DataFrame, **exprs: Any) -> DataFrame:
    return Select(expr=exprs).apply(df)


def rename(df: DataFrame, names: Mapping[str, str] | None = None, **more: str) -> DataFrame:
    """From new to old names. A column whose name is taken over by another goes."""
    new_of = {old: new for new, old in {**(names or {}), **more}.items()}
    if missing := new_of.keys() - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    out = [(c, new_of.get(c, c)) for c in df.columns if c in new_of or c not in new_of.values()]
    return df.select(*[named(old).alias(new) for old, new in out])


def relocate(df: DataFrame, *names: str, before: str | None = None, after: str | None = None) -> DataFrame:
    """Move columns in front of or behind another one, or to the front."""
    rest = [c for c in df.columns if c not in names]
    at = rest.index(before) if before else rest.index(after) + 1 if after else 0
    return df.select(*[named(c) for c in [*rest[:at], *names, *rest[at:]]])


def cast(df: DataFrame, kinds: Mapping[str, Any]) -> DataFrame:
    return df.select(*[named(c).cast(spark_type(kinds[c])).alias(c) if c in kinds else named(c) for c in df.columns])


def distinct(df: DataFrame, on: str | Iterable[str] | None = None, keep: str | None = "first") -> DataFrame:
    """Distinct rows, or one row for each value of ``on``.

    ``first`` and ``last`` follow the order of the remaining columns, so the result
    does not depend on partitions; ``None`` keeps only rows whose key is unique.
    """
    if on is None:
        return df.distinct()
    keys = [on] if isinstance(on, str) else list(on)
    if keep is None:
        single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
        return df.join(single, _same(df, single, keys), "left_semi")
    rest = [named(c) for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    if all(_orderable(f.dataType) for f in df.schema if f.name not in keys):
        # least or greatest row by partial aggregation: no sort, and hot keys are combined before the shuffle
        best = (F.min if keep == "first" else F.max)(F.struct(*rest)).alias("_row")
        picked = df.groupBy(*[named(k) for k in keys]).agg(best)
        return picked.select(*[named(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])
    order = [F.xxhash64(*[F.array_sort(F.map_entries(c)) if isinstance(df.schema[n].dataType, T.MapType) else c for n, c in zip((n for n in df.columns if n not in keys), rest)])]
    order = order if keep == "first" else [o.desc() for o in order]
    numbered = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where("_at = 1").drop("_at")


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return False
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return all(_orderable(f.dataType) for f in kind) if isinstance(kind, T.StructType) else True


def _same(a: DataFrame, b: DataFrame, keys: Iterable[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def drop_null(df: DataFrame, subset: str | Iterable[str] | None = None, how: str = "any") -> DataFrame:
    names = [subset] if isinstance(subset, str) else list(subset or df.columns)
    return df.na.drop(how=how, subset=names)


def fill_null(df: DataFrame, value: Any) -> DataFrame:
    """Fill all columns of the value's type, or columns by name."""
    if isinstance(value, Mapping):
        return df.select(*[F.coalesce(named(c), as_value(value[c])).alias(c) if c in value else named(c) for c in df.columns])
    return df.na.fill(value)


def union(df: DataFrame, *others: Any) -> DataFrame:
    """All rows of all tables, columns by name."""
    for other in others:
        df = df.unionByName(frame(other))
    return df


def force_cast(df: DataFrame, kinds: Mapping[str, Any]) -> DataFrame:
    """Exactly the declared columns, in order, cast to their types. Spark removes casts that do nothing."""
    return df.select(*[named(c).cast(spark_type(k)).alias(c) for c, k in kinds.items()])


class Desc:
    """``"column" @ Desc()``: descending, nulls last unless told otherwise."""

    def __init__(self, nulls_first: bool = False):
        self.nulls_first = nulls_first

    def __rmatmul__(self, value: Any) -> Column:
        column = named(value) if isinstance(value, str) else value
        return column.desc_nulls_first() if self.nulls_first else column.desc_nulls_last()


def order_by(df: DataFrame, *keys: Any) -> DataFrame:
    """Ascending with nulls last, unless a key says otherwise."""
    return df.orderBy(*[named(k).asc_nulls_last() if isinstance(k, str) else k for k in keys])


# Nulls by type


def numeric_default(kind: T.DataType) -> Any:
    """0 for numbers and false for booleans; None for types without a default."""
    if isinstance(kind, T.BooleanType):
        return False
    return 0 if isinstance(kind, T.NumericType) else None


class FillNulls(TableMethod):
    """Put a default of its type where a column is null; types without a default stay as they are."""

    def __init__(self, *names: str, default_provider: Callable[[T.DataType], Any] = numeric_default):
        self.names, self.provider = names, default_provider

    def apply(self, df: DataFrame) -> DataFrame:
        return fill_nulls(df, *self.names, default_provider=self.provider)


def fill_nulls(table: Any, *names: str, default_provider: Callable[[T.DataType], Any] = numeric_default, array_length: int | None = None) -> DataFrame:
    """As ``FillNulls``; with ``array_length``, a null array becomes that many defaults of its element type."""
    df = frame(table)
    out = []
    for f in df.schema:
        column = named(f.name)
        if not names or f.name in names:
            if isinstance(f.dataType, T.ArrayType) and array_length is not None:
                default = default_provider(f.dataType.elementType)
                if default is not None:
                    column = F.coalesce(column, F.array_repeat(F.lit(default).cast(f.dataType.elementType), array_length))
            elif (default := default_provider(f.dataType)) is not None:
                column = F.coalesce(column, F.lit(default).cast(f.dataType))
        out.append(column.alias(f.name))
    return df.select(*out)


#: What a deferred chain finds by name on tables before the DataFrame's own methods.
TABLE_FUNCTIONS: dict[str, Callable] = {
    "mutate": mutate, "rename": rename, "relocate": relocate, "cast": cast, "distinct": distinct, "drop_null": drop_null,
    "fill_null": fill_null, "union": union, "order_by": order_by,
    "aggregate": lambda df, by=(), having=None, **metrics: _aggregate(df, by, having, metrics),
}


def _aggregate(df: DataFrame, by: Any, having: Column | None, metrics: Mapping[str, Any]) -> DataFrame:
    from typeloom.operators.aggregate import Aggregate

    return Aggregate([by] if isinstance(by, str) else by, expr=metrics, having=having).apply(df)
