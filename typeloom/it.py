"""One import for authors of expressions: ``from typeloom import it``."""

from typeloom.functions.custom import ColumnChecksum, Hash, IntToUUID, JsonFormat, JsonGet, JsonParse, LuhnCheck
from typeloom.functions.scalar import And, Cases, FillNull, Greatest, IfElse, Least, Or, identical_to, literal, try_cast
from typeloom.functions.time import AddDays, AddMonths, DaysSince, MonthsSince, StartOfMonth, TimestampNow, as_scalar, now
from typeloom.methods import ArgsMethod, SchemaMethod, SelfMethod, TableMethod, ValueMethod, defer, deferred
from typeloom.operators.aggregate import Aggregate, aggregate, argmax, collect
from typeloom.operators.joins import AntiJoin, InnerJoin, Join, JoinMethod, LeftJoin, OuterJoin, OuterJoinParallel, SemiJoin, join
from typeloom.operators.partition import ByNumberOfBuckets, BySize, PartitionColumns, PartitionPolicy, partition_columns
from typeloom.operators.relational import Desc, FillNulls, Select, distinct, drop_null, fill_null, fill_nulls, force_cast, mutate, numeric_default, order_by, relocate, rename, select, union
from typeloom.plans.evaluate import check_increment, construct_increment, evaluate, evaluate_incremental, from_expression, merge_increment
from typeloom.plans.incremental import AsBucketedInputs, AsIncrementedBuckets, BucketedInputsExpression, BucketedInputsParams, ChecksumBuckets, ChecksumParams, IncrementalExpression, IncrementalParams
from typeloom.plans.model import Expression, GenericExpression, IdentityTableExpression, SingleInputTableExpression, TableExpression
from typeloom.plans.providers import AbstractTableProvider, DbTableProvider, EmptyTableProvider, FilteredTableProvider, chain_providers, provider_from_rows, provider_of_tables
from typeloom.plans.revertible import AsRevertible, ExpressionExport, RevertibleTableExpression, UUIDToStringExport, revert_all
from typeloom.schema import DbSchema, Schema, Table, rows_of, tables_of_rows, this
from typeloom.sources.store import Connection, LocalTableStore, NullTableStore, ParquetTableStore
from typeloom.types import JSON, UUID, Array, Binary, Boolean, Date, Decimal, Float32, Float64, Int8, Int16, Int32, Int64, Map, String, Struct, Time, Timestamp

__all__ = [n for n in dir() if not n.startswith("_")]
