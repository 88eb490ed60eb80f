"""Table stores: a folder per schema, Parquet inside."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from typeloom.operators.relational import named
from typeloom.schema import Schema, Table, rows_of, session, snake_case

log = logging.getLogger(__name__)
FILE_BYTES = 64 << 20


class Connection:
    """A session with typed reads, writes and fetches."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or session()

    def read_parquet(self, path: str, schema: type[Schema]) -> Table:
        """The declared columns only, in their order."""
        return Table(self.spark.read.parquet(path).select(*[named(c) for c in schema.types()]), schema)

    def write_parquet(self, table: Table | DataFrame, path: str, **options) -> None:
        (table.df if isinstance(table, Table) else table).write.options(**options).parquet(path)

    def fetch_table(self, table: Table) -> Iterator[Schema]:
        return rows_of(table)

    def evaluate(self, value):
        """Rows of a table as dicts; a (table, column) pair as a list of its values; a table of one value by ``scalar``."""
        if isinstance(value, tuple):
            table, column = value
            return [r[0] for r in (table.df if isinstance(table, Table) else table).select(column).toLocalIterator()]
        df = value.df if isinstance(value, Table) else value
        if isinstance(value, Table) and value.abstract:
            raise ValueError(f"{value.schema.__name__} is abstract: it has a schema and no rows")
        return [r.asDict(recursive=True) for r in df.toLocalIterator()]

    def scalar(self, df: DataFrame):
        row = df.first()
        return None if row is None else row[0]


class TableStore(Protocol):
    def __call__(self, schema: type[Schema]) -> Table | None: ...
    def __contains__(self, schema: type[Schema]) -> bool: ...
    def write_table(self, table: Table) -> None: ...


class NullTableStore:
    """Takes everything, has nothing."""

    def __call__(self, schema: type[Schema]) -> None:
        return None

    def __contains__(self, schema: type[Schema]) -> bool:
        return False

    def write_table(self, table: Table) -> None:
        pass


def force_cast_table(table: Table) -> Table:
    """Declared columns in declared types."""
    kinds = table.schema.types()
    return Table(table.df.select(*[named(c).cast(k.spark).alias(c, metadata=k.metadata()) for c, k in kinds.items()]), table.schema)


@dataclass
class ParquetTableStore:
    """Tables under ``root/<snake_case(class)>``; nested ``key=value`` folders are read, too.

    A write goes to a staging folder first, so a table may be written that was read
    from the same place. It replaces the files of the table's own folder, or with
    ``suffix`` (``tenant=5``) those of that part; parts beneath the folder stay. New
    files move in before old ones go, so a crash in between leaves rows twice and
    loses none. Paths are those of any file system that Spark knows.
    """

    root: str
    suffix: str = ""
    profile: bool = False
    spark: SparkSession | None = None

    def _session(self) -> SparkSession:
        return self.spark or session()

    def folder(self, schema: type[Schema]) -> str:
        return f"{self.root.rstrip('/')}/{snake_case(schema.__name__)}"

    def _path(self, path: str):
        p = self._session()._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._session()._jsc.hadoopConfiguration())

    def __contains__(self, schema: type[Schema]) -> bool:
        p, fs = self._path(self.folder(schema))
        return bool(fs.exists(p)) and self.size_stats(schema)["files"] > 0

    def __call__(self, schema: type[Schema]) -> Table | None:
        if schema not in self:
            return None
        df = self._session().read.option("recursiveFileLookup", "true").parquet(self.folder(schema))
        return Table(df.select(*[named(c).cast(k.spark).alias(c, metadata=k.metadata()) for c, k in schema.types().items()]), schema)

    def write_table(self, table: Table) -> None:
        staged = f"{self.root.rstrip('/')}/_staging/{uuid.uuid4().hex}"
        stored = force_cast_table(table).df
        rows_per_file = max(1, FILE_BYTES // max(1, sum(f.dataType.jsonValue() is not None and 16 for f in stored.schema)))
        stored.write.option("maxRecordsPerFile", rows_per_file).parquet(staged)
        target = self.folder(table.schema) + (f"/{self.suffix}" if self.suffix else "")
        source, fs = self._path(staged)
        goal, _ = self._path(target)
        before = [f.getPath() for f in fs.listStatus(goal) if f.isFile()] if fs.exists(goal) else []
        fs.mkdirs(goal)
        jvm = self._session()._jvm
        for f in fs.listStatus(source):
            # names of parts are unique per write
            if f.getPath().getName().endswith(".parquet") and not fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(goal, f.getPath().getName())):
                raise OSError(f"{f.getPath()} could not be moved to {target}")
        for path in before:
            fs.delete(path, False)
        fs.delete(source, True)
        if self.profile:
            plan = stored._jdf.queryExecution().toString()
            out = fs.create(self._path(f"{target}/_profile.json")[0], True)
            out.write(json.dumps({"schema": table.schema.__name__, "plan": plan}).encode())
            out.close()
        log.info("%s: %s", target, self.size_stats(table.schema))

    def size_stats(self, schema: type[Schema]) -> dict[str, int]:
        """Files and bytes of a table."""
        p, fs = self._path(self.folder(schema))
        files, size = 0, 0
        if fs.exists(p):
            found = fs.listFiles(p, True)
            while found.hasNext():
                f = found.next()
                if f.getPath().getName().endswith(".parquet"):
                    files, size = files + 1, size + f.getLen()
        return {"files": files, "bytes": size}


LocalTableStore = ParquetTableStore


def merge_into(path: str, increment: DataFrame, keys: list[str], strategy: str = "merge", spark: SparkSession | None = None) -> DataFrame:
    """A table after one of the merge strategies: append, merge and delete+insert (by key), or insert_overwrite (by the keys as partitions)."""
    old = (spark or session()).read.parquet(path)
    if strategy == "append":
        return old.unionByName(increment, allowMissingColumns=True)
    if strategy in ("merge", "delete+insert", "insert_overwrite", "microbatch"):
        gone = increment.select(*map(named, keys)).distinct()
        return old.join(gone, keys, "left_anti").unionByName(increment, allowMissingColumns=True)
    raise ValueError(f"unknown strategy: {strategy}")
