"""Vertical partitioning of a table's value columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame

from typeloom.methods import TableMethod
from typeloom.operators.joins import OuterJoinParallel
from typeloom.operators.relational import named
from typeloom.schema import Schema, frame


class PartitionPolicy(Protocol):
    def split(self, names: Sequence[str]) -> list[list[str]]: ...


@dataclass(frozen=True)
class BySize:
    """Groups of so many columns."""

    size: int

    def split(self, names: Sequence[str]) -> list[list[str]]:
        return [list(names[i : i + self.size]) for i in range(0, len(names), self.size)]


@dataclass(frozen=True)
class ByNumberOfBuckets:
    """So many groups, as even as can be."""

    buckets: int

    def split(self, names: Sequence[str]) -> list[list[str]]:
        n, k = len(names), max(1, min(self.buckets, len(names)))
        cuts = [i * n // k for i in range(k + 1)]
        return [list(names[a:b]) for a, b in zip(cuts, cuts[1:])]


class PartitionColumns(TableMethod):
    """Split value columns into groups, each with the keys, and join the groups again.

    The same table comes out where keys are unique and not null; null keys never meet,
    and repeated keys multiply rows.
    """

    def __init__(self, keys: Iterable[str], policy: PartitionPolicy):
        self.keys, self.policy = list(keys), policy

    def apply(self, df: DataFrame) -> DataFrame:
        groups = self.policy.split([c for c in df.columns if c not in self.keys])
        if len(groups) < 2:
            return df
        parts = [df.select(*map(named, [*self.keys, *g])) for g in groups]
        return OuterJoinParallel(*parts[1:], keys=self.keys).apply(parts[0]).select(*map(named, df.columns))

    def partition(self, schema: type[Schema]) -> type[Schema]:
        """An expression class over ``schema`` with the same columns."""
        return self.as_expression_schema(schema, preserves_schema=True)


def partition_columns(table: Any, keys: Iterable[str], policy: PartitionPolicy) -> DataFrame:
    return PartitionColumns(keys, policy).apply(frame(table))
