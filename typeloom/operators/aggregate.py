"""Grouped aggregation with named metrics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.methods import TableMethod
from typeloom.operators.relational import named, ordered_names
from typeloom.schema import frame


class Aggregate(TableMethod):
    """Group by keys and compute metrics.

    Keys come first; then metrics whose names the table has, in the table's order;
    then new ones. One name in several places: arbitrary gives way to sum, sum to
    min, min to max and max to ``expr``. No keys: one row, even of an empty table.
    No metrics: the distinct keys. ``arbitrary`` takes some value that is not null.
    """

    def __init__(self, by: Iterable[str] = (), expr: Mapping[str, Column] | None = None, arbitrary: Iterable[str] = (), sum: Iterable[str] = (), min: Iterable[str] = (), max: Iterable[str] = (), having: Column | None = None):
        self.by = list(by)
        self.metrics: dict[str, Column] = {}
        for names, function in ((arbitrary, lambda c: F.any_value(c, F.lit(True))), (sum, F.sum), (min, F.min), (max, F.max)):
            self.metrics.update({n: function(named(n)) for n in names})
        self.metrics.update(expr or {})
        self.having = having

    def apply(self, df: DataFrame) -> DataFrame:
        keys = [named(k) for k in self.by]
        if not self.metrics:
            return df.select(*keys).distinct()
        order = [n for n in ordered_names((c for c in df.columns if c in self.metrics), self.metrics)]
        metrics = [self.metrics[n].alias(n) for n in order]
        out = df.groupBy(*keys).agg(*metrics) if keys else df.agg(*metrics)
        return out if self.having is None else out.where(self.having)


def aggregate(table: Any, by: Iterable[str] = (), expr: Mapping[str, Column] | None = None, **kw: Any) -> DataFrame:
    return Aggregate(by, expr, **kw).apply(frame(table))


def collect(column: Any) -> Column:
    """All values that are not null, as an array in no certain order."""
    return F.collect_list(column)


def argmax(value: Any, key: Any) -> Column:
    return F.max_by(value, key)
