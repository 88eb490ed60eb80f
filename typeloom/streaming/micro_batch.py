"""Incremental relations over a stream: each micro-batch is one incremental run.

The engine's own incremental processing is batch-wise; a Structured Streaming query
drives it with ``foreachBatch``. State is in stores, as in batch runs. The rows of a
batch are a part of the inputs' table under the batch's number; a batch that is run
again after a failure writes the same part again, so rows count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from typeloom.functions.time import TimestampNow
from typeloom.plans.evaluate import evaluate_incremental
from typeloom.plans.incremental import ChecksumBuckets
from typeloom.plans.model import Expression
from typeloom.plans.providers import Provider, provider_of_tables
from typeloom.schema import Schema, Table


def run_increment(inputs: Table, buckets: type[ChecksumBuckets], targets: Iterable[type[Expression]], store, now: Table | None = None, providers: Iterable[Provider] = ()) -> None:
    """One incremental run: buckets first, then the targets, all kept in ``store``."""
    clock = now or TimestampNow.current(inputs.df.sparkSession)
    tables = provider_of_tables(inputs, clock)
    updated = evaluate_incremental(buckets, [tables, *providers], [store])
    store.write_table(updated)
    current = provider_of_tables(inputs, clock, store(buckets))
    for target in targets:
        store.write_table(evaluate_incremental(target, [current, *providers], [store]))


def start(stream: DataFrame, schema: type[Schema], store, buckets: type[ChecksumBuckets], targets: Iterable[type[Expression]], checkpoint: str, clock: Callable[[], Table] | None = None, **trigger) -> StreamingQuery:
    """Add each micro-batch as a part to the inputs' table in ``store`` (a Parquet store) and bring the targets up to date."""
    targets = list(targets)

    def batch(df: DataFrame, number: int) -> None:
        replace(store, suffix=f"batch={number}").write_table(Table(df.select(*schema.types()), schema))
        run_increment(store(schema), buckets, targets, store, clock() if clock else None)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
