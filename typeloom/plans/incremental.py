"""Incremental relations by checksums of buckets.

Inputs are grouped into buckets by key columns; a bucket's checksum is the XOR of
the checksums of its other columns. Comparing with the buckets of the last run tells
which changed. A relation over *bucketed inputs* is then computed from the inputs of
changed buckets alone, and merged into the last result.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.custom import ColumnChecksum
from typeloom.functions.time import TimestampNow
from typeloom.methods import SchemaMethod
from typeloom.operators.relational import named
from typeloom.plans.model import Expression, SingleInputTableExpression
from typeloom.schema import Schema, Table


@dataclass(frozen=True)
class IncrementalParams:
    group_by: tuple[str, ...]
    updated_at_col: str = "checksum_updated_at"


@dataclass(frozen=True)
class ChecksumParams(IncrementalParams):
    inputs: type[Schema] | None = None
    checksum_col: str = "checksum"
    #: Checksums with the numbers of the in-process engine; they hold for integers.
    compatible: bool = False


@dataclass(frozen=True)
class BucketedInputsParams(IncrementalParams):
    inputs: type[Schema] | None = None
    buckets: type[Schema] | None = None


class IncrementalExpression(Expression):
    """An expression whose rows are keyed and carry the time of their last change."""

    @classmethod
    def incremental_params(cls) -> IncrementalParams:
        raise NotImplementedError


def bucket_checksums(inputs: DataFrame, params: ChecksumParams, at: Column) -> DataFrame:
    """Keys, time and checksum of each bucket."""
    rest = sorted(c for c in inputs.columns if c not in params.group_by)
    if not rest:
        raise ValueError("there is no column beside the keys to take a checksum of")
    checksum = functools.reduce(lambda a, b: a.bitwiseXOR(b), [ColumnChecksum(compatible=params.compatible).apply(named(c)) for c in rest])
    grouped = inputs.groupBy(*map(named, params.group_by)).agg(checksum.alias(params.checksum_col))
    return grouped.select(*map(named, params.group_by), at.alias(params.updated_at_col), named(params.checksum_col))


def changed_buckets(current: DataFrame, prior: DataFrame, params: ChecksumParams, at: Column) -> DataFrame:
    """Buckets whose checksum is another than before. A bucket that is gone is there once more, with checksum 0."""
    keys, checksum = list(params.group_by), params.checksum_col
    new = current.select(*map(named, keys), F.coalesce(named(checksum), F.lit(0)).alias("_new"))
    old = prior.select(*map(named, keys), named(checksum).alias("_old"))
    both = new.join(old, keys, "full_outer") if keys else new.join(old, F.lit(True), "full_outer")
    now = F.coalesce(F.col("_new"), F.lit(0))
    return both.where(~now.eqNullSafe(F.col("_old"))).select(*map(named, keys), at.alias(params.updated_at_col), now.alias(checksum))


class ChecksumBuckets(IncrementalExpression):
    """Buckets of ``checksum_params().inputs``. Subclasses give the parameters and the columns (keys, time, checksum)."""

    @classmethod
    def checksum_params(cls) -> ChecksumParams:
        raise NotImplementedError

    @classmethod
    def incremental_params(cls) -> IncrementalParams:
        return cls.checksum_params()

    @classmethod
    def input_schemas(cls) -> dict[str, type[Schema]]:
        return {"inputs": cls.checksum_params().inputs, "timestamp": TimestampNow}

    @classmethod
    def from_expression(cls, inputs: Table, timestamp: Table) -> DataFrame:
        return bucket_checksums(inputs.df, cls.checksum_params(), F.lit(_clock_of(timestamp)).cast("timestamp_ntz"))

    @classmethod
    def construct_increment(cls, current: Table, prior: Table, timestamp: Table) -> Table:
        """The buckets that changed, stamped with the run's time: there may be no current bucket to take it from."""
        at = F.lit(_clock_of(timestamp)).cast("timestamp_ntz")
        return Table(changed_buckets(current.df, prior.df, cls.checksum_params(), at), cls)


def _clock_of(timestamp: Table) -> Any:
    """The run's one time, as a constant: a clock inside the plan would be read again by each query."""
    return timestamp.df.first()[0] if not timestamp.abstract else None


def as_incremented_buckets(buckets: Table, target: Table, from_start: bool = False) -> Table:
    """Buckets that changed after the target's last change.

    A target that is there and empty lets no bucket pass, unless ``from_start``.
    """
    params = buckets.schema.incremental_params()
    at = params.updated_at_col
    last = target.df.agg(F.max(named(at))).scalar()
    passes = named(at) > last
    if from_start:
        passes = F.coalesce(passes, F.lit(True))
    return Table(buckets.df.where(passes), buckets.schema)


class AsIncrementedBuckets(SchemaMethod):
    """``Buckets @ AsIncrementedBuckets(Target)``: an expression of the buckets newer than the target."""

    def __init__(self, target: type[Schema]):
        self.target = target

    def apply_to_schema(self, schema: type[Schema]) -> type[Schema]:
        return IncrementedBuckets(schema, self.target).as_expression_schema()


@dataclass(frozen=True)
class IncrementedBuckets(SingleInputTableExpression):
    target: type[Schema]

    def input_schemas(self) -> tuple[type[Schema], ...]:
        return self.origin, self.target

    def build(self, *inputs: Table) -> DataFrame:
        return as_incremented_buckets(Table(inputs[0].df, self.origin), inputs[1]).df

    def output_schema(self) -> type[Schema]:
        return self.origin


def bucketed_inputs(buckets: DataFrame, inputs: DataFrame, params: ChecksumParams) -> DataFrame:
    """The inputs of the buckets, with the buckets' time. A bucket without inputs is one row of nulls."""
    keys = list(params.group_by)
    some = buckets.select(*map(named, keys), named(params.updated_at_col))
    return some.join(inputs, keys, "left") if keys else some.join(inputs, F.lit(True), "left")


@dataclass(frozen=True)
class BucketedInputs(SingleInputTableExpression):
    def input_schemas(self) -> tuple[type[Schema], ...]:
        return self.origin, self.origin.checksum_params().inputs

    def build(self, *inputs: Table) -> DataFrame:
        return bucketed_inputs(inputs[0].df, inputs[1].df, self.origin.checksum_params())


class AsBucketedInputs(SchemaMethod):
    """``Buckets @ AsBucketedInputs()``: the class of the buckets' inputs."""

    def apply_to_schema(self, schema: type[Schema]) -> type[Schema]:
        return BucketedInputs(schema).as_expression_schema()


class BucketedInputsExpression(IncrementalExpression):
    """A relation over inputs by bucket. Where it asks for its inputs, it gets them with the buckets' time."""

    @classmethod
    def bucketed_inputs_params(cls) -> BucketedInputsParams:
        raise NotImplementedError

    @classmethod
    def incremental_params(cls) -> IncrementalParams:
        return cls.bucketed_inputs_params()

    @classmethod
    def input_schemas(cls) -> dict[str, type[Schema]]:
        params = cls.bucketed_inputs_params()
        asked = super().input_schemas()
        if params.inputs not in asked.values():
            raise TypeError(f"{cls.__name__} does not take its inputs, {params.inputs.__name__}")
        return {n: params.buckets @ AsBucketedInputs() if s is params.inputs else s for n, s in asked.items()}
