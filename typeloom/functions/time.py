"""Dates and the clock."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.methods import ValueMethod, as_value
from typeloom.schema import Schema, Table, session
from typeloom.types import simple


class StartOfMonth(ValueMethod):
    """The first day of the month, as a date."""

    def apply(self, column: Column) -> Column:
        return F.trunc(column, "MM")


class MonthsSince(ValueMethod):
    """Month boundaries between two dates: from January 20th to February 1st it is one."""

    def __init__(self, start: Any):
        self.start = start

    def apply(self, column: Column) -> Column:
        start = as_value(self.start)
        return ((F.year(column) - F.year(start)) * 12 + F.month(column) - F.month(start)).cast("bigint")


class DaysSince(ValueMethod):
    def __init__(self, start: Any):
        self.start = start

    def apply(self, column: Column) -> Column:
        return F.datediff(column, as_value(self.start)).cast("bigint")


class AddMonths(ValueMethod):
    """The first day of the month that is so many months away."""

    def __init__(self, months: Any):
        self.months = months

    def apply(self, column: Column) -> Column:
        return F.add_months(F.trunc(column, "MM"), as_value(self.months).cast("int"))


class AddDays(ValueMethod):
    def __init__(self, days: Any):
        self.days = days

    def apply(self, column: Column) -> Column:
        return F.date_add(column.cast("date"), as_value(self.days).cast("int"))


#: The clock, which tests replace.
clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def now() -> Column:
    """The time as a constant of the plan: every query that is built from it sees the same one."""
    return F.lit(clock()).cast("timestamp_ntz")


class TimestampNow(Schema):
    """A table of one row, the time of the run. It is read once, on the driver."""

    table_schema = {"timestamp": "timestamp(6)"}
    timestamp: Any = None

    @classmethod
    def as_of(cls, at: dt.datetime, spark: SparkSession | None = None) -> Table[TimestampNow]:
        return Table((spark or session()).range(1).select(F.lit(at).cast(simple("timestamp").spark).alias("timestamp")), cls)

    @classmethod
    def current(cls, spark: SparkSession | None = None) -> Table[TimestampNow]:
        return cls.as_of(clock(), spark)


def as_scalar(table: Table | DataFrame) -> Column:
    """The value of a table of one row and one column, as a scalar subquery."""
    return (table.df if isinstance(table, Table) else table).scalar()
