"""Model specifications, their templated SQL, and snapshots of slowly changing rows.

A model compiles to a query in pipe form: each operator adds one ``|>`` step to a
``SqlRelation``, which also carries an empty DataFrame so that names and types are
checked as they are built. Leaves are tokens that become ``{{ ref("x") }}``,
``{{ source("s", "t") }}`` or ``{{ this }}``.
"""

from __future__ import annotations

import importlib
import inspect
import pkgutil
import re
from dataclasses import dataclass, field, fields, replace
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.operators.relational import named
from typeloom.plans.incremental import ChecksumBuckets, IncrementalExpression
from typeloom.plans.model import Expression, is_expression
from typeloom.schema import DbSchema, Schema, snake_case

# The columns of a snapshot, and the one that marks deleted rows.
SNAPSHOT_COLUMNS = {"dbt_scd_id": "string", "dbt_updated_at": "timestamp_ntz", "dbt_valid_from": "timestamp_ntz", "dbt_valid_to": "timestamp_ntz"}
DELETED_COLUMN = "dbt_is_deleted"


class Materialized(str, Enum):
    TABLE, VIEW, INCREMENTAL, EPHEMERAL, MATERIALIZED_VIEW = "table", "view", "incremental", "ephemeral", "materialized_view"


class Strategy(str, Enum):
    APPEND, MERGE, DELETE_INSERT, INSERT_OVERWRITE, MICROBATCH = "append", "merge", "delete+insert", "insert_overwrite", "microbatch"


class OnSchemaChange(str, Enum):
    IGNORE, FAIL, APPEND_NEW_COLUMNS, SYNC_ALL_COLUMNS = "ignore", "fail", "append_new_columns", "sync_all_columns"


class HardDeletes(str, Enum):
    IGNORE, INVALIDATE, NEW_RECORD = "ignore", "invalidate", "new_record"


@dataclass(frozen=True)
class GeneralConfig:
    database: str | None = None
    schema: str | None = None
    alias: str | None = None
    tags: tuple[str, ...] | None = None
    kwargs: dict[str, Any] = field(default_factory=dict)

    def with_namespace(self, *namespace: str) -> GeneralConfig:
        return replace(self, **dict(zip(("database", "schema"), namespace[-2:] if len(namespace) > 1 else (None, *namespace))))

    def add_tags(self, *tags: str) -> GeneralConfig:
        return replace(self, tags=(*(self.tags or ()), *tags))


@dataclass(frozen=True)
class ModelConfig(GeneralConfig):
    materialized: Materialized = Materialized.TABLE
    incremental_strategy: Strategy | None = None
    unique_key: tuple[str, ...] | None = None
    on_schema_change: OnSchemaChange | None = None

    def __post_init__(self):
        if self.incremental_strategy not in (None, Strategy.APPEND) and not self.unique_key:
            raise ValueError("an incremental strategy needs a unique key")


@dataclass(frozen=True)
class SnapshotConfig(GeneralConfig):
    strategy: str = "timestamp"
    unique_key: tuple[str, ...] = ()
    updated_at: str | None = None
    check_cols: tuple[str, ...] | str | None = None
    hard_deletes: HardDeletes = HardDeletes.IGNORE

    def __post_init__(self):
        if self.strategy == "timestamp" and not self.updated_at:
            raise ValueError("the timestamp strategy needs updated_at")
        if self.strategy == "check" and not self.check_cols:
            raise ValueError("the check strategy needs check_cols")


@dataclass(frozen=True)
class ModelSpec:
    expression: type[Schema]
    config: GeneralConfig = ModelConfig()
    name: str | None = None
    prefix: str = ""

    @property
    def table_name(self) -> str:
        return self.name or self.prefix + snake_case(self.expression.__name__)


@dataclass(frozen=True)
class SourceSpec:
    db_schema: type[DbSchema]
    source_name: str | None = None

    @property
    def source(self) -> str:
        return self.source_name or self.db_schema.namespace[1 if len(self.db_schema.namespace) > 1 else 0]


@dataclass(frozen=True)
class ModelResolver:
    """Finds the expressions of a package."""

    package: str

    def expressions(self) -> list[type[Expression]]:
        root = importlib.import_module(self.package)
        modules = [root, *(importlib.import_module(m.name) for m in pkgutil.walk_packages(getattr(root, "__path__", []), f"{self.package}."))]
        found = {c for m in modules for _, c in inspect.getmembers(m, inspect.isclass) if is_expression(c) and c.__module__ == m.__name__}
        return sorted(found, key=lambda c: (c.__module__, c.__name__))

    def incrementals(self) -> list[type[Expression]]:
        return [c for c in self.expressions() if issubclass(c, IncrementalExpression)]

    def checksums(self) -> list[type[Expression]]:
        return [c for c in self.expressions() if issubclass(c, ChecksumBuckets)]

    def checksum_inputs(self) -> list[type[Schema]]:
        return [c.checksum_params().inputs for c in self.checksums()]


# SQL


def column_sql(column: Column | str) -> str:
    """SQL text of a column expression."""
    if isinstance(column, str):
        return f"`{column}`"
    return column._jc.node().sql() if hasattr(column._jc, "node") else column._jc.toString()


@dataclass(frozen=True)
class SqlRelation:
    """A query in pipe form, and an empty DataFrame with its schema."""

    text: str
    df: DataFrame

    def step(self, text: str, df: DataFrame) -> SqlRelation:
        return SqlRelation(f"{self.text}\n|> {text}", df)

    def where(self, condition: str) -> SqlRelation:
        return self.step(f"WHERE {condition}", self.df.where(condition))

    def select(self, *names: str, **exprs: str) -> SqlRelation:
        out = [*(f"`{n}`" for n in names), *(f"{e} AS `{n}`" for n, e in exprs.items())]
        return self.step(f"SELECT {', '.join(out)}", self.df.selectExpr(*out))

    def mutate(self, **exprs: str) -> SqlRelation:
        old = {n: e for n, e in exprs.items() if n in self.df.columns}
        new = {n: e for n, e in exprs.items() if n not in old}
        out = self
        if old:
            out = out.step("SET " + ", ".join(f"`{n}` = {e}" for n, e in old.items()), out.df.withColumns({n: F.expr(e) for n, e in old.items()}))
        if new:
            out = out.step("EXTEND " + ", ".join(f"{e} AS `{n}`" for n, e in new.items()), out.df.withColumns({n: F.expr(e) for n, e in new.items()}))
        return out

    def drop(self, *names: str) -> SqlRelation:
        return self.step("DROP " + ", ".join(f"`{n}`" for n in names), self.df.drop(*names))

    def aggregate(self, by: list[str], **metrics: str) -> SqlRelation:
        out = ", ".join(f"{e} AS `{n}`" for n, e in metrics.items())
        keys = f" GROUP BY {', '.join(f'`{k}`' for k in by)}" if by else ""
        df = self.df.groupBy(*map(named, by)).agg(*[F.expr(e).alias(n) for n, e in metrics.items()])
        return self.step(f"AGGREGATE {out}{keys}", df)

    def join(self, other: SqlRelation, keys: list[str], how: str = "INNER") -> SqlRelation:
        using = f" USING ({', '.join(f'`{k}`' for k in keys)})" if keys else " ON TRUE"
        spark_how = {"INNER": "inner", "LEFT": "left", "FULL OUTER": "full_outer", "LEFT ANTI": "left_anti", "LEFT SEMI": "left_semi"}[how]
        df = self.df.join(other.df, keys, spark_how) if keys else self.df.join(other.df, F.lit(True), spark_how)
        body = other.text.replace("\n", "\n  ")
        return self.step(f"{how} JOIN (\n  {body}\n){using}", df)

    def union_all(self, other: SqlRelation) -> SqlRelation:
        ordered = other.select(*self.df.columns)
        return self.step("UNION ALL (\n  " + ordered.text.replace("\n", "\n  ") + "\n)", self.df.unionByName(other.df))

    def order_by(self, *keys: str) -> SqlRelation:
        return self.step("ORDER BY " + ", ".join(keys), self.df.orderBy(*[F.expr(k) if " " not in k else F.expr(k.split()[0]) for k in keys]))


def token(schema: type[Schema]) -> str:
    return f"__ref__{schema.__name__}__"


def leaf(schema: type[Schema]) -> SqlRelation:
    from typeloom.plans.model import abstract

    columns = ", ".join(f"`{c}`" for c in schema.types())
    return SqlRelation(f"FROM {token(schema)}\n|> SELECT {columns}", abstract(schema).df)


def references(text: str, models: dict[type[Schema], ModelSpec | SourceSpec], this_model: type[Schema] | None = None) -> str:
    """Put template references where tokens are."""
    by_name = {s.__name__: (s, m) for s, m in models.items()}

    def put(m: re.Match) -> str:
        if this_model is not None and m[1] == this_model.__name__:
            return "{{ this }}"
        if m[1] not in by_name:
            raise ValueError(f"there is no model or source for {m[1]}")
        schema, spec = by_name[m[1]]
        if isinstance(spec, SourceSpec):
            return f'{{{{ source("{spec.source}", "{schema.table_name}") }}}}'
        return f'{{{{ ref("{spec.table_name}") }}}}'

    return re.sub(r"__ref__(\w+?)__", put, text)


def config_template(config: GeneralConfig) -> str:
    """``{{ config(...) }}``: what is None is left out, and further arguments are merged in."""
    given: dict[str, Any] = {f.name: getattr(config, f.name) for f in fields(config) if f.name != "kwargs"} | config.kwargs

    def text(v: Any) -> str:
        if isinstance(v, Enum):
            return repr(v.value)
        if isinstance(v, (tuple, list)):
            return "[" + ", ".join(map(text, v)) + "]"
        return repr(v)

    return "{{ config(" + ", ".join(f"{k}={text(v)}" for k, v in given.items() if v is not None) + ") }}"


def compile_model(spec: ModelSpec, full: SqlRelation, models: dict[type[Schema], ModelSpec | SourceSpec], increment: SqlRelation | None = None) -> str:
    """A model's template: its configuration and query; for an incremental one, both queries under a condition."""
    body = references(full.text, models)
    if isinstance(spec.config, SnapshotConfig):
        return f"{{% snapshot {spec.table_name} %}}\n{config_template(spec.config)}\n{body}\n{{% endsnapshot %}}\n"
    if increment is not None:
        part = references(increment.text, models, this_model=spec.expression)
        body = f"{{% if is_incremental() %}}\n{part}\n{{% else %}}\n{body}\n{{% endif %}}"
    return f"{config_template(spec.config)}\n{body}\n"


# Snapshots


def snapshot_columns(origin: DataFrame, hard_deletes: HardDeletes = HardDeletes.IGNORE, rename: dict[str, str] | None = None) -> DataFrame:
    """An empty table with the columns of a snapshot of ``origin``; ``rename`` gives other names to its own columns."""
    extra = dict(SNAPSHOT_COLUMNS)
    if hard_deletes == HardDeletes.NEW_RECORD:
        extra[DELETED_COLUMN] = "string"
    names = rename or {}
    out = origin.where(F.lit(False)).select(*map(named, origin.columns), *[F.lit(None).cast(kind).alias(names.get(c, c)) for c, kind in extra.items()])
    if len(set(out.columns)) < len(out.columns):
        raise ValueError("a column of the snapshot has the name of a column of its origin")
    return out


def snapshot(prior: DataFrame | None, current: DataFrame, config: SnapshotConfig, at: Any) -> DataFrame:
    """The next state of a snapshot: changed rows are closed and opened anew, new ones opened; gone ones as ``hard_deletes`` says."""
    keys, names = list(config.unique_key), current.columns
    time = F.lit(at).cast("timestamp_ntz")
    stamp = named(config.updated_at).cast("timestamp_ntz") if config.strategy == "timestamp" else time
    with_flag = config.hard_deletes == HardDeletes.NEW_RECORD
    scd = F.md5(F.concat_ws("|", *[F.coalesce(named(k).cast("string"), F.lit("")) for k in keys], stamp.cast("string")))
    fresh = current.select(*map(named, names), scd.alias("dbt_scd_id"), stamp.alias("dbt_updated_at"), stamp.alias("dbt_valid_from"), F.lit(None).cast("timestamp_ntz").alias("dbt_valid_to"), *([F.lit("False").alias(DELETED_COLUMN)] if with_flag else []))
    if prior is None:
        return fresh
    closed, open_ = prior.where("dbt_valid_to IS NOT NULL"), prior.where("dbt_valid_to IS NULL")
    compared = [config.updated_at] if config.strategy == "timestamp" else [c for c in names if c not in keys] if config.check_cols == "all" else list(config.check_cols)
    now = fresh.select(*[named(k) for k in keys], F.struct(*fresh.columns).alias("_new"))
    both = open_.select(*[named(k) for k in keys], F.struct(*open_.columns).alias("_old")).join(now, keys, "full_outer")
    changed = F.lit(False)
    for c in compared:
        changed = changed | (F.col("_new")[c] > F.col("_old")[c] if config.strategy == "timestamp" else ~F.col("_new")[c].eqNullSafe(F.col("_old")[c]))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(changed, "changed").otherwise("same")
    both = both.withColumn("_state", state)
    if with_flag:
        both = both.withColumn("_state", F.when((F.col("_state") == "gone") & (F.col("_old")[DELETED_COLUMN] == "True"), "same").otherwise(F.col("_state")))
    out_names = fresh.columns
    old = lambda end: both.select("_state", *[F.col("_old")[c].alias(c) if c != "dbt_valid_to" else end.alias(c) for c in out_names])
    kept = old(F.lit(None).cast("timestamp_ntz")).where("_state = 'same'" + (" OR _state = 'gone'" if config.hard_deletes == HardDeletes.IGNORE else "")).drop("_state")
    ended = old(F.when(F.col("_state") == "changed", F.col("_new")["dbt_valid_from"]).otherwise(time)).where("_state = 'changed'" + ("" if config.hard_deletes == HardDeletes.IGNORE else " OR _state = 'gone'")).drop("_state")
    opened = both.where("_state IN ('new', 'changed')").select("_new.*")
    out = closed.select(*out_names).unionByName(kept).unionByName(ended).unionByName(opened)
    if with_flag:
        deleted = both.where("_state = 'gone'").select(*[F.col("_old")[c].alias(c) if c not in ("dbt_updated_at", "dbt_valid_from", "dbt_valid_to", DELETED_COLUMN) else {"dbt_valid_to": F.lit(None).cast("timestamp_ntz"), DELETED_COLUMN: F.lit("True")}.get(c, time).alias(c) for c in out_names])
        out = out.unionByName(deleted)
    return out
