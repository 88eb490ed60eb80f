"""Resolving expressions: inputs are found by type, each intermediate once per evaluation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.functions.time import TimestampNow
from typeloom.operators.relational import named
from typeloom.plans.incremental import BucketedInputsExpression, ChecksumBuckets, as_incremented_buckets
from typeloom.plans.model import Expression, is_expression
from typeloom.plans.providers import Provider, chain_providers
from typeloom.schema import Schema, Table


class Resolver:
    """A provider that builds expressions from what other providers give."""

    def __init__(self, *providers: Provider):
        self.known = chain_providers(*providers)
        self.built: dict[type[Schema], Table] = {}
        self.trace: list[type[Schema]] = []

    def __call__(self, schema: type[Schema]) -> Table:
        if schema in self.built:
            return self.built[schema]
        found = self.known(schema)
        if found is None:
            found = self.build(schema)
        self.built[schema] = found
        return found

    def build(self, schema: type[Schema]) -> Table:
        if not is_expression(schema):
            path = " <- ".join(s.__name__ for s in [schema, *reversed(self.trace)])
            raise ValueError(f"there is no table for {path}")
        if schema in self.trace:
            raise ValueError("expressions depend on each other: " + " <- ".join(s.__name__ for s in [*self.trace, schema]))
        self.trace.append(schema)
        try:
            return schema.build([self(s) for s in schema.input_schemas().values()])
        finally:
            self.trace.pop()


def from_expression(target: type[Expression], *inputs: Table, providers: Iterable[Provider] = ()) -> Table:
    """Build ``target`` from input tables. It is built even if it is among them; inputs that nothing asks for are an error."""
    used: set[type[Schema]] = set()
    given = {t.schema: t for t in inputs}

    def look(schema: type[Schema]) -> Table | None:
        used.add(schema)
        return given.get(schema)

    made = Resolver(look, *providers).build(target)
    if unused := [s.__name__ for s in given if s not in used]:
        raise ValueError(f"There are unused input schemas: {sorted(unused)}")
    return made


def evaluate(target: type[Expression], *providers: Provider) -> Table:
    return Resolver(*providers).build(target)


def evaluate_incremental(target: type[Expression], input_providers: Iterable[Provider], prior_providers: Iterable[Provider]) -> Table:
    """All of the target, recomputing only what changed since the prior table; without one, everything."""
    prior = chain_providers(*prior_providers)(target)
    if prior is None:
        return Resolver(*input_providers).build(target)
    return merge_increment(target, prior, construct_increment(target, prior, input_providers))


def construct_increment(target: type[Expression], prior: Table, input_providers: Iterable[Provider]) -> Table:
    """The rows of the target that are new: changed buckets, or an expression over these alone."""
    if issubclass(target, ChecksumBuckets):
        resolver = Resolver(*input_providers)
        return target.construct_increment(resolver.build(target), prior, resolver(TimestampNow))
    if not issubclass(target, BucketedInputsExpression):
        raise TypeError(f"{target.__name__} is not incremental")
    resolver = Resolver(*input_providers)
    buckets = target.bucketed_inputs_params().buckets

    def changed(schema: type[Schema]) -> Table | None:
        if schema is not buckets:
            return None
        return as_incremented_buckets(resolver(buckets), prior)

    return Resolver(changed, *input_providers).build(target)


def merge_increment(target: type[Expression], prior: Table, increment: Table) -> Table:
    """The newest row of each key, whole; of equal times the increment's, and a row without a time is the oldest.

    The keys of the increment are small beside the prior table. Prior rows with other
    keys are kept by an anti-join with these keys, and the few prior rows that share
    one are compared with the increment by an aggregation. Neither join has the prior
    table on its right side, so Spark can broadcast the keys by their size.
    """
    params = target.incremental_params()
    keys = list(params.group_by)
    names = list(target.types())
    old, new = prior.df.select(*names), increment.df.select(*names)
    place = F.struct(F.col("_row")[params.updated_at_col].isNotNull(), F.col("_row")[params.updated_at_col], F.col("_new"))

    def rows(df: DataFrame, is_new: bool) -> DataFrame:
        return df.select(*[named(k) for k in keys], F.struct(*map(named, names)).alias("_row"), F.lit(is_new).alias("_new"))

    if not keys:
        return Table(rows(old, False).unionByName(rows(new, True)).agg(F.max_by("_row", place).alias("_row")).where("_row IS NOT NULL").select("_row.*"), target)
    touched = new.select(*[named(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & old[k].eqNullSafe(touched[f"_{k}"])
    both = rows(old.join(touched, same, "left_semi"), False).unionByName(rows(new, True))
    newest = both.groupBy(*map(named, keys)).agg(F.max_by("_row", place).alias("_row")).select("_row.*")
    return Table(old.join(touched, same, "left_anti").unionByName(newest), target)


def repeated_keys(target: type[Expression], table: Table) -> DataFrame:
    """The keys with more than one row, and how many (``n``)."""
    keys = list(target.incremental_params().group_by)
    counted = table.df.groupBy(*map(named, keys)) if keys else table.df.groupBy()
    return counted.agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_increment(target: type[Expression], table: Table) -> None:
    """Every key has one row; else an error."""
    if found := repeated_keys(target, table).limit(1).collect():
        raise ValueError(f"{target.__name__} has more than one row for {found[0].asDict()}")
