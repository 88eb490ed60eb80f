"""A query for each operator of the engine, over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import functools
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions.custom import ColumnChecksum, Hash, IntToUUID, JsonFormat, JsonGet, JsonParse, LuhnCheck, map_of, struct
from typeloom.functions.scalar import And, Cases, FillNull, Greatest, IfElse, Least, Or, identical_to, literal, try_cast
from typeloom.functions.time import AddDays, AddMonths, DaysSince, MonthsSince, StartOfMonth, TimestampNow, as_scalar
from typeloom.methods import deferred
from typeloom.operators import relational as rel
from typeloom.operators.aggregate import Aggregate, argmax, collect
from typeloom.operators.joins import AntiJoin, InnerJoin, JoinMethod, LeftJoin, OuterJoin, OuterJoinParallel, join
from typeloom.operators.partition import BySize, PartitionColumns
from typeloom.operators.relational import Desc, FillNulls, Select, fill_nulls, select
from typeloom.plans.evaluate import construct_increment, evaluate_incremental, from_expression, repeated_keys
from typeloom.plans.incremental import AsBucketedInputs, BucketedInputsExpression, BucketedInputsParams, ChecksumBuckets, ChecksumParams, as_incremented_buckets
from typeloom.plans.model import Expression
from typeloom.plans.models import snapshot_columns
from typeloom.plans.providers import EmptyTableProvider, provider_of_tables
from typeloom.plans.revertible import AsRevertible, UUIDToStringExport, revert_all
from typeloom.schema import Schema, Table, this
from typeloom.sources.store import Connection, ParquetTableStore, merge_into
from typeloom.types import UUID, Date, Float64, Int32, Int64, String, Timestamp

T0, T1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def register(function: Callable[[Tables], DataFrame]) -> Callable:
        name = function.__name__.removeprefix("q_")

        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return function

    return register


# Schemas and expressions


class Orders(Schema):
    o_orderkey: Int64
    o_custkey: Int64
    o_orderstatus: String
    o_totalprice: Float64
    o_orderdate: Timestamp
    o_orderpriority: String


class MonthlyAmounts(Expression):
    month: Date
    amount_cents: Int64

    @classmethod
    def from_expression(cls, orders: Table[Orders]) -> DataFrame:
        cents = F.round(this[orders.cols.o_totalprice] * 100).cast("bigint")
        monthly = orders @ Select(expr={"month": orders.cols.o_orderdate @ StartOfMonth(), "amount_cents": cents})
        return monthly @ Aggregate(by=["month"], sum=["amount_cents"])


class OrderKeys(Schema):
    o_custkey: Int64
    o_orderkey: Int64


class OrderKeyBuckets(ChecksumBuckets):
    o_custkey: Int64
    checksum_updated_at: Timestamp
    checksum: Int64

    @classmethod
    def checksum_params(cls) -> ChecksumParams:
        return ChecksumParams(group_by=("o_custkey",), inputs=OrderKeys, compatible=True)


class OrderMarks(ChecksumBuckets):
    """As OrderKeyBuckets, with this engine's own checksums."""

    o_custkey: Int64
    checksum_updated_at: Timestamp
    checksum: Int64

    @classmethod
    def checksum_params(cls) -> ChecksumParams:
        return ChecksumParams(group_by=("o_custkey",), inputs=OrderKeys)


class OrderCounts(BucketedInputsExpression):
    o_custkey: Int64
    checksum_updated_at: Timestamp
    n: Int64

    @classmethod
    def bucketed_inputs_params(cls) -> BucketedInputsParams:
        return BucketedInputsParams(group_by=("o_custkey",), inputs=OrderKeys, buckets=OrderMarks)

    @classmethod
    def from_expression(cls, inputs: Table[OrderKeys]) -> DataFrame:
        return inputs @ Aggregate(by=["o_custkey", "checksum_updated_at"], expr={"n": F.count("o_orderkey")})


class NationNames(Schema):
    n_nationkey: Int32
    n_name: String


class RegionRow(Schema):
    r_regionkey: Int32
    r_name: String


class Pair(Schema):
    id: Int32
    name: String


class OrderUuid(Schema):
    o_orderkey: Int64
    u: UUID


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) AS amount_cents FROM orders GROUP BY 1")
def q_flagship_monthly_amounts(t: Tables) -> DataFrame:
    return from_expression(MonthlyAmounts, Orders.of(t.orders)).df


@query("SELECT p_size, CAST(p_size AS DOUBLE)*2 AS circumference_k, pow(p_size,2) AS area_k FROM part")
def q_circle(t: Tables) -> DataFrame:
    return select(t.part, {"p_size": this.p_size, "circumference_k": this.p_size.cast("double") * 2, "area_k": this.p_size**2})


# Projections


@query("SELECT o_orderkey, o_custkey, o_orderkey+1 AS next_key FROM orders")
def q_select_subset(t: Tables) -> DataFrame:
    return t.orders @ Select("o_custkey", "o_orderkey", expr={"next_key": this.o_orderkey + 1})


@query("SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey, 1 AS one FROM nation")
def q_select_replace(t: Tables) -> DataFrame:
    return t.nation @ Select(expr={"n_name": F.upper("n_name"), "one": F.lit(1)})


@query("SELECT n_nationkey, n_name FROM nation")
def q_select_drop(t: Tables) -> DataFrame:
    return t.nation @ Select(drop=["n_regionkey"])


@query("SELECT n_nationkey*2 AS twice FROM nation")
def q_select_only_expr(t: Tables) -> DataFrame:
    return select(t.nation, {"twice": this.n_nationkey * 2})


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus='F' AND o_totalprice>1000) OR o_orderpriority LIKE '1%'")
def q_filter_and_or(t: Tables) -> DataFrame:
    wanted = (this.o_orderstatus == "F") @ And(this.o_totalprice > 1000) @ Or(this.o_orderpriority.like("1%"))
    return t.orders.where(wanted) @ Select("o_orderkey")


@query("SELECT DISTINCT o_custkey AS customer FROM orders WHERE o_totalprice > 1000")
def q_deferred_chain(t: Tables) -> DataFrame:
    return t.orders @ deferred.filter(this.o_totalprice > 1000).select("o_custkey").rename({"customer": "o_custkey"}).distinct()


@query("SELECT n_name AS nation, n_nationkey, n_regionkey FROM nation")
def q_relocate_rename(t: Tables) -> DataFrame:
    return t.nation @ deferred.rename({"nation": "n_name"}).relocate("nation", before="n_nationkey")


@query("SELECT CAST(p_partkey AS INTEGER) AS p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part")
def q_force_cast(t: Tables) -> DataFrame:
    return rel.force_cast(t.part, {"p_partkey": "int32", "p_size": "int64"})


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def q_distinct_rows(t: Tables) -> DataFrame:
    return rel.distinct(t.lineitem.select("l_returnflag", "l_linestatus"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def q_distinct_on(t: Tables) -> DataFrame:
    return rel.distinct(t.orders.select("o_custkey", "o_orderkey"), on="o_custkey")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1")
def q_distinct_unique(t: Tables) -> DataFrame:
    return rel.distinct(t.orders.select("o_custkey", "o_orderkey"), on="o_custkey", keep=None).select("o_custkey")


@query("SELECT o_orderkey, nullif(o_orderstatus,'F') AS st FROM orders WHERE nullif(o_orderstatus,'F') IS NOT NULL")
def q_drop_null(t: Tables) -> DataFrame:
    return rel.drop_null(select(t.orders, {"o_orderkey": this.o_orderkey, "st": F.nullif("o_orderstatus", F.lit("F"))}), "st")


@query("SELECT p_partkey, coalesce(nullif(p_size,1),0) AS size, coalesce(CASE WHEN p_size>5 THEN p_size>20 END, false) AS big, nullif(p_brand,'x') AS brand FROM part")
def q_fill_nulls(t: Tables) -> DataFrame:
    holes = select(t.part, {"p_partkey": this.p_partkey, "size": F.nullif("p_size", F.lit(1)), "big": F.when(this.p_size > 5, this.p_size > 20), "brand": F.nullif("p_brand", F.lit("x"))})
    return holes @ FillNulls()


@query("SELECT p_partkey, CAST(list_sum(coalesce(CASE WHEN p_size>5 THEN [1,1] END,[0,0])) AS BIGINT) AS s FROM part")
def q_fill_nulls_array(t: Tables) -> DataFrame:
    holes = select(t.part, {"p_partkey": this.p_partkey, "a": F.when(this.p_size > 5, F.array(F.lit(1), F.lit(1)))})
    return select(fill_nulls(holes, array_length=2), {"p_partkey": this.p_partkey, "s": F.aggregate("a", F.lit(0).cast("bigint"), lambda x, y: x + y)})


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def q_partition_columns(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority") @ PartitionColumns(["o_orderkey"], BySize(1))


# Sources


@query("SELECT * FROM (VALUES (1,'a'),(2,NULL)) AS t(id, name)")
def q_literal_table(t: Tables) -> DataFrame:
    return Pair.of_rows([Pair(1, "a"), Pair(2, None)], t.spark).df


@query("SELECT n_nationkey, n_name FROM nation WHERE false")
def q_empty_table(t: Tables) -> DataFrame:
    return EmptyTableProvider()(NationNames).df


@query("SELECT r_regionkey, r_name FROM region")
def q_parquet_roundtrip(t: Tables) -> DataFrame:
    store = ParquetTableStore(_scratch(t.spark), spark=t.spark)
    store.write_table(Connection(t.spark).read_parquet(f"{t.sf_dir}/region.parquet", RegionRow))
    return store(RegionRow).df


def _scratch(spark: SparkSession) -> str:
    """A folder that all executors see: the one of spark.checkpoint.dir, or a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="typeloom-")
    return f"{base.rstrip('/')}/typeloom-store-{uuid.uuid4().hex}"


# Joins


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey=c_custkey")
def q_inner_join(t: Tables) -> DataFrame:
    customers = t.customer.select("c_custkey", "c_name") @ deferred.rename({"o_custkey": "c_custkey"})
    return t.orders.select("o_orderkey", "o_custkey") @ InnerJoin(customers, keys=["o_custkey"])


@query("SELECT a.n_nationkey, a.n_name, b.n_name AS n_name_right FROM nation a JOIN (SELECT n_nationkey, lower(n_name) AS n_name FROM nation) b USING (n_nationkey)")
def q_join_collision(t: Tables) -> DataFrame:
    nation = t.nation.select("n_nationkey", "n_name")
    return nation @ InnerJoin(nation @ Select(expr={"n_name": F.lower("n_name")}), keys=["n_nationkey"])


@query("SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey=n.n_nationkey LEFT JOIN region r ON n.n_regionkey=r.r_regionkey")
def q_left_join_multi(t: Tables) -> DataFrame:
    supplier = rel.rename(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), {"n_nationkey": "s_nationkey"})
    with_nation = supplier @ LeftJoin(t.nation, keys=["n_nationkey"])
    regions = rel.rename(t.region, {"n_regionkey": "r_regionkey"})
    return with_nation @ LeftJoin(regions, keys=["n_regionkey"]) @ deferred.select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT a.k, coalesce(a.s,b.s) AS s, greatest(a.hi,b.hi) AS hi, least(a.lo,b.lo) AS lo FROM (SELECT o_orderkey AS k, nullif(o_orderstatus,'F') AS s, o_totalprice AS hi, o_custkey AS lo FROM orders) a LEFT JOIN (SELECT l_orderkey AS k, max(l_returnflag) AS s, max(l_extendedprice) AS hi, min(l_suppkey) AS lo FROM lineitem GROUP BY 1) b ON a.k=b.k")
def q_join_resolve(t: Tables) -> DataFrame:
    a = select(t.orders, {"k": this.o_orderkey, "s": F.nullif("o_orderstatus", F.lit("F")), "hi": this.o_totalprice, "lo": this.o_custkey})
    b = rel.rename(t.lineitem, {"k": "l_orderkey"}) @ Aggregate(by=["k"], expr={"s": F.max("l_returnflag"), "hi": F.max("l_extendedprice"), "lo": F.min("l_suppkey")})
    return a @ LeftJoin(b, keys=["k"], arbitrary=["s"], max=["hi"], min=["lo"])


# The same joins over whole tables: keys without a match are those that the tables do not share by nature


def _user_events(t: Tables, *names: str) -> DataFrame:
    return t.events.select(F.col("user_id").alias("c_custkey"), *names)


@query("SELECT c_custkey, c_name, event_id FROM customer LEFT JOIN events ON c_custkey=user_id")
def q_left_join(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name") @ LeftJoin(_user_events(t, "event_id"), keys=["c_custkey"])


@query("SELECT coalesce(a.k,b.k) AS k, a.orders, b.lines FROM (SELECT CAST(o_orderdate AS DATE) AS k, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY 1) a FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS k, CAST(count(*) AS BIGINT) AS lines FROM lineitem GROUP BY 1) b ON a.k=b.k")
def q_outer_join(t: Tables) -> DataFrame:
    a = select(t.orders, {"k": this.o_orderdate.cast("date")}) @ Aggregate(by=["k"], expr={"orders": this.count()})
    b = select(t.lineitem, {"k": this.l_shipdate.cast("date")}) @ Aggregate(by=["k"], expr={"lines": this.count()})
    return a @ OuterJoin(b, keys=["k"])


@query("SELECT k, max(a) AS a, max(b) AS b, max(c) AS c, max(d) AS d FROM (SELECT n_nationkey AS k, n_name AS a, NULL AS b, NULL AS c, NULL AS d FROM nation UNION ALL SELECT s_suppkey, NULL, s_name, NULL, NULL FROM supplier UNION ALL SELECT c_custkey, NULL, NULL, c_name, NULL FROM customer UNION ALL SELECT p_partkey, NULL, NULL, NULL, p_name FROM part) u GROUP BY k")
def q_outer_join_parallel(t: Tables) -> DataFrame:
    named = [(t.nation, "n_nationkey", "n_name"), (t.supplier, "s_suppkey", "s_name"), (t.customer, "c_custkey", "c_name"), (t.part, "p_partkey", "p_name")]
    parts = [select(table, {"k": this[key].cast("bigint"), n: this[name]}) for n, (table, key, name) in zip("abcd", named)]
    return parts[0] @ OuterJoinParallel(*parts[1:], keys=["k"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id=c_custkey)")
def q_anti_join(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name") @ AntiJoin(_user_events(t), keys=["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id=c_custkey)")
def q_semi_join(t: Tables) -> DataFrame:
    return join(t.customer.select("c_custkey", "c_name"), _user_events(t), keys=["c_custkey"], how=JoinMethod.SEMI)


@query("SELECT c_custkey, m.event_id FROM customer LEFT JOIN (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1) m ON c_custkey=m.user_id")
def q_any_left_join(t: Tables) -> DataFrame:
    return join(t.customer.select("c_custkey"), _user_events(t, "event_id"), keys=["c_custkey"], how=JoinMethod.ANY_LEFT)


@query("SELECT c_custkey, m.event_id FROM customer JOIN (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1) m ON c_custkey=m.user_id")
def q_any_inner_join(t: Tables) -> DataFrame:
    return join(t.customer.select("c_custkey"), _user_events(t, "event_id"), keys=["c_custkey"], how=JoinMethod.ANY_INNER)


@query("SELECT n_nationkey, TIMESTAMP '2025-01-01' AS \"timestamp\" FROM nation")
def q_timestamp_join(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey") @ InnerJoin(TimestampNow.as_of(T0, t.spark))


# Aggregation


@query("SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS l_quantity, min(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def q_aggregate_basic(t: Tables) -> DataFrame:
    lines = t.lineitem @ Select(expr={"l_quantity": this.l_quantity.cast("bigint")})
    return lines @ Aggregate(by=["l_returnflag"], sum=["l_quantity"], min=["l_suppkey"], max=["l_partkey"], expr={"n": this.count()})


@query("SELECT CAST(count(*) AS BIGINT) AS n, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey < 0")
def q_aggregate_global(t: Tables) -> DataFrame:
    return t.orders.where(this.o_orderkey < 0) @ Aggregate(max=["o_orderkey"], expr={"n": this.count()})


@query("SELECT o_orderpriority FROM orders GROUP BY 1")
def q_aggregate_keys_only(t: Tables) -> DataFrame:
    return t.orders @ Aggregate(by=["o_orderpriority"])


@query("SELECT s_nationkey, any_value(n_name) AS n_name FROM supplier JOIN nation ON s_nationkey=n_nationkey GROUP BY 1")
def q_aggregate_arbitrary(t: Tables) -> DataFrame:
    nations = rel.rename(t.nation, {"s_nationkey": "n_nationkey"})
    return t.supplier @ InnerJoin(nations, keys=["s_nationkey"]) @ Aggregate(by=["s_nationkey"], arbitrary=["n_name"])


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")
def q_aggregate_having(t: Tables) -> DataFrame:
    return t.orders @ Aggregate(by=["o_custkey"], expr={"n": this.count()}, having=this.n > 10)


@query("SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY 1")
def q_aggregate_collect(t: Tables) -> DataFrame:
    return t.nation @ Aggregate(by=["n_regionkey"], expr={"names": F.array_join(F.sort_array(collect("n_name")), ",")})


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderdate::VARCHAR || '#' || lpad(o_orderkey::VARCHAR, 12, '0')) AS latest FROM orders GROUP BY 1")
def q_argmax(t: Tables) -> DataFrame:
    return t.orders @ Aggregate(by=["o_custkey"], expr={"latest": argmax("o_orderkey", F.struct("o_orderdate", "o_orderkey"))})


@query("SELECT l_returnflag, bit_and(l_orderkey) AS ba, bool_and(l_quantity>0) AS allpos FROM lineitem GROUP BY 1")
def q_reductions_misc(t: Tables) -> DataFrame:
    return t.lineitem @ Aggregate(by=["l_returnflag"], expr={"ba": this.l_orderkey @ deferred.bit_and(), "allpos": (this.l_quantity > 0) @ deferred.all()})


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) - 10 FROM orders)")
def q_scalar_subquery(t: Tables) -> DataFrame:
    return t.orders.where(this.o_orderkey > as_scalar(select(t.orders @ Aggregate(max=["o_orderkey"]), {"m": this.o_orderkey - 10}))) @ Select("o_orderkey")


@query("SELECT CAST(bit_xor(hash(CAST(o_custkey AS BIGINT))) % 9223372036854775808 AS BIGINT) AS checksum FROM orders")
def q_column_checksum(t: Tables) -> DataFrame:
    return t.orders @ Aggregate(expr={"checksum": this.o_custkey @ ColumnChecksum(compatible=True)})


@query("SELECT o_orderkey, CAST(hash(o_orderkey) % 9223372036854775808 AS BIGINT) AS h FROM orders")
def q_row_hash(t: Tables) -> DataFrame:
    return select(t.orders, {"o_orderkey": this.o_orderkey, "h": (this.o_orderkey @ Hash(compatible=True)).bitwiseAND((1 << 63) - 1)})


# Order and set operations


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def q_order_by_desc(t: Tables) -> DataFrame:
    return rel.order_by(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice" @ Desc(), "o_orderkey").limit(10)


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def q_union_all(t: Tables) -> DataFrame:
    return rel.union(select(t.nation, {"name": this.n_name}), select(t.region, {"name": this.r_name}))


# Scalars


@query("SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 1 ELSE 2 END AS v FROM orders")
def q_ifelse(t: Tables) -> DataFrame:
    return select(t.orders, {"o_orderkey": this.o_orderkey, "v": (this.o_orderstatus == "F") @ IfElse(1, 2)})


@query("SELECT p_partkey, CASE WHEN p_size>40 THEN 'L' WHEN p_size>20 THEN 'M' ELSE 'S' END AS bucket FROM part")
def q_cases(t: Tables) -> DataFrame:
    return select(t.part, {"p_partkey": this.p_partkey, "bucket": "S" @ Cases((this.p_size > 40, "L"), (this.p_size > 20, "M"))})


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus,'F'), nullif(o_orderpriority,'x'), 'none') AS v FROM orders")
def q_coalesce(t: Tables) -> DataFrame:
    return select(t.orders, {"o_orderkey": this.o_orderkey, "v": F.nullif("o_orderstatus", F.lit("F")) @ FillNull(F.nullif("o_orderpriority", F.lit("x")), "none")})


@query("SELECT l_orderkey, l_linenumber, greatest(l_partkey, l_suppkey) AS g, least(l_partkey, nullif(l_suppkey,1)) AS l FROM lineitem")
def q_greatest_least(t: Tables) -> DataFrame:
    return select(t.lineitem, {"l_orderkey": this.l_orderkey, "l_linenumber": this.l_linenumber, "g": this.l_partkey @ Greatest(this.l_suppkey), "l": this.l_partkey @ Least(F.nullif("l_suppkey", F.lit(1)))})


@query("SELECT p_partkey, nullif(p_size,1) IS NOT DISTINCT FROM NULL AS same FROM part")
def q_identical_to(t: Tables) -> DataFrame:
    return select(t.part, {"p_partkey": this.p_partkey, "same": identical_to(F.nullif("p_size", F.lit(1)), literal(None, "int32"))})


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, TRY_CAST(p_brand AS INTEGER) AS i FROM part")
def q_cast_try_cast(t: Tables) -> DataFrame:
    return select(t.part, {"p_partkey": this.p_partkey, "s": this.p_size @ deferred.cast("string"), "i": try_cast(this.p_brand, "int32")})


@query("SELECT p_partkey, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, isnan(p_retailprice) AS nan FROM part")
def q_numeric_misc(t: Tables) -> DataFrame:
    price = this.p_retailprice
    return select(t.part, {"p_partkey": this.p_partkey, "c": price @ deferred.ceil(), "f": price @ deferred.floor(), "nan": price @ deferred.isnan()})


@query("SELECT p_partkey, lower(p_name) AS l, sha256(p_name) AS h FROM part")
def q_string_misc(t: Tables) -> DataFrame:
    return select(t.part, {"p_partkey": this.p_partkey, "l": this.p_name @ deferred.lower(), "h": this.p_name @ deferred.hashbytes()})


@query("SELECT o_orderkey, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(o_orderdate AS DATE) AS dt FROM orders")
def q_date_misc(t: Tables) -> DataFrame:
    return select(t.orders, {"o_orderkey": this.o_orderkey, "d": this.o_orderdate @ deferred.day(), "dt": this.o_orderdate @ deferred.date()})


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders")
def q_start_of_month(t: Tables) -> DataFrame:
    return select(t.orders, {"o_orderkey": this.o_orderkey, "m": this.o_orderdate @ StartOfMonth()})


@query("SELECT o_orderkey, date_diff('month', DATE '1995-01-20', CAST(o_orderdate AS DATE)) AS m FROM orders")
def q_months_since(t: Tables) -> DataFrame:
    return select(t.orders, {"o_orderkey": this.o_orderkey, "m": this.o_orderdate @ MonthsSince(dt.date(1995, 1, 20))})


@query("SELECT o_orderkey, date_diff('day', DATE '1995-01-20', CAST(o_orderdate AS DATE)) AS d FROM orders")
def q_days_since(t: Tables) -> DataFrame:
    return select(t.orders, {"o_orderkey": this.o_orderkey, "d": this.o_orderdate @ DaysSince(dt.date(1995, 1, 20))})


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey%25-12 AS INTEGER)) AS DATE) AS m FROM orders")
def q_add_months(t: Tables) -> DataFrame:
    return select(t.orders, {"o_orderkey": this.o_orderkey, "m": this.o_orderdate @ AddMonths(this.o_orderkey % 25 - 12)})


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_days(CAST(o_orderkey%100 AS INTEGER)) AS DATE) AS d FROM orders")
def q_add_days(t: Tables) -> DataFrame:
    return select(t.orders, {"o_orderkey": this.o_orderkey, "d": this.o_orderdate @ AddDays(this.o_orderkey % 100)})


@query("SELECT event_id, CAST(json_extract(CAST(props AS JSON), '$.k') AS BIGINT) AS k FROM events")
def q_json_roundtrip(t: Tables) -> DataFrame:
    again = this.props @ JsonParse() @ JsonFormat() @ JsonParse()
    return select(t.events, {"event_id": this.event_id, "k": again @ JsonGet("$.k", "bigint")})


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def q_json_extract(t: Tables) -> DataFrame:
    return select(t.events, {"event_id": this.event_id, "k": this.props @ JsonParse() @ JsonGet("$.k", "double")})


@query("SELECT o_orderkey, CAST(CAST(lpad(hex(o_orderkey - 100), 32, '0') AS UUID) AS VARCHAR) AS u FROM orders")
def q_int_to_uuid(t: Tables) -> DataFrame:
    return select(t.orders, {"o_orderkey": this.o_orderkey, "u": (this.o_orderkey - 100) @ IntToUUID()})


@query("SELECT o_orderkey, CAST(CAST(lpad(hex(o_orderkey), 32, '0') AS UUID) AS VARCHAR) AS u FROM orders")
def q_revertible_uuid(t: Tables) -> DataFrame:
    origin = OrderUuid.of(select(t.orders, {"o_orderkey": this.o_orderkey, "u": this.o_orderkey @ IntToUUID()}))
    exported = from_expression(OrderUuid @ AsRevertible(UUIDToStringExport), origin)
    return revert_all(exported).df


@query("SELECT o_orderkey, list_sum(list_transform(split(reverse(CAST(o_orderkey AS VARCHAR)),''), lambda d, i: CASE WHEN i%2=0 THEN CASE WHEN CAST(d AS BIGINT)*2>9 THEN CAST(d AS BIGINT)*2-9 ELSE CAST(d AS BIGINT)*2 END ELSE CAST(d AS BIGINT) END)) % 10 = 0 AS ok FROM orders")
def q_luhn_check(t: Tables) -> DataFrame:
    return select(t.orders, {"o_orderkey": this.o_orderkey, "ok": this.o_orderkey.cast("string") @ LuhnCheck()})


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x>0)) AS BIGINT) AS n_pos, embedding[1] AS first FROM embeddings")
def q_array_ops(t: Tables) -> DataFrame:
    positive = this.embedding @ deferred.filter(lambda x: x > 0)
    return select(t.embeddings, {"vec_id": this.vec_id, "n_pos": F.size(positive).cast("bigint"), "first": this.embedding[0]})


@query("SELECT n_nationkey, array_to_string(map_keys(MAP([n_name],[n_regionkey])), ',') AS k FROM nation")
def q_map_ops(t: Tables) -> DataFrame:
    made = map_of(F.array("n_name"), F.array("n_regionkey"))
    return select(t.nation, {"n_nationkey": this.n_nationkey, "k": F.array_join(made @ deferred.keys(), ",")})


@query("SELECT n_nationkey, struct_extract({'amount': n_regionkey, 'name': n_name}, 'name') AS name FROM nation")
def q_struct_ops(t: Tables) -> DataFrame:
    return select(t.nation, {"n_nationkey": this.n_nationkey, "name": struct(amount=this.n_regionkey, name=this.n_name)["name"]})


# Incremental relations


#: The table had orders before the first date when it was last looked at; those before the second have been archived since.
MONTH_AGO, ARCHIVED = dt.datetime(2001, 7, 1), dt.datetime(2000, 1, 1)


class PricedOrders(Schema):
    o_custkey: Int64
    o_orderkey: Int64
    cents: Int64


class PricedBuckets(ChecksumBuckets):
    o_custkey: Int64
    checksum_updated_at: Timestamp
    checksum: Int64

    @classmethod
    def checksum_params(cls) -> ChecksumParams:
        return ChecksumParams(group_by=("o_custkey",), inputs=PricedOrders, compatible=True)


def _keys(t: Tables, where: Any = None) -> Table:
    rows = t.orders if where is None else t.orders.where(where)
    return OrderKeys.of(rows.select("o_custkey", "o_orderkey"))


@query("SELECT o_custkey, TIMESTAMP '2025-01-01' AS checksum_updated_at, xor(CAST(bit_xor(hash(o_orderkey)) % 9223372036854775808 AS BIGINT), CAST(bit_xor(hash(CAST(round(o_totalprice*100) AS BIGINT))) % 9223372036854775808 AS BIGINT)) AS checksum FROM orders GROUP BY 1")
def q_checksum_buckets(t: Tables) -> DataFrame:
    priced = PricedOrders.of(select(t.orders, {"o_custkey": this.o_custkey, "o_orderkey": this.o_orderkey, "cents": F.round(this.o_totalprice * 100).cast("bigint")}))
    return from_expression(PricedBuckets, priced, TimestampNow.as_of(T0, t.spark)).df


def _first_run(t: Tables) -> Table:
    return from_expression(OrderKeyBuckets, _keys(t, this.o_orderdate < MONTH_AGO), TimestampNow.as_of(T0, t.spark))


@query("WITH t0 AS (SELECT o_custkey, CAST(bit_xor(hash(o_orderkey)) % 9223372036854775808 AS BIGINT) AS c FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-01' GROUP BY 1), t1 AS (SELECT o_custkey, CAST(bit_xor(hash(o_orderkey)) % 9223372036854775808 AS BIGINT) AS c FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1) SELECT coalesce(t1.o_custkey,t0.o_custkey) AS o_custkey, TIMESTAMP '2025-01-02' AS checksum_updated_at, coalesce(t1.c,0) AS checksum FROM t1 FULL JOIN t0 ON t1.o_custkey=t0.o_custkey WHERE coalesce(t1.c,0) IS DISTINCT FROM t0.c")
def q_checksum_increment(t: Tables) -> DataFrame:
    return construct_increment(OrderKeyBuckets, _first_run(t), [provider_of_tables(_keys(t, this.o_orderdate >= ARCHIVED), TimestampNow.as_of(T1, t.spark))]).df


@query("SELECT DISTINCT o_custkey, TIMESTAMP '2025-01-02' AS checksum_updated_at, CAST(0 AS BIGINT) AS checksum FROM orders")
def q_checksum_increment_emptied(t: Tables) -> DataFrame:
    prior = from_expression(OrderKeyBuckets, _keys(t), TimestampNow.as_of(T0, t.spark))
    return construct_increment(OrderKeyBuckets, prior, [provider_of_tables(_keys(t, F.lit(False)), TimestampNow.as_of(T1, t.spark))]).df


class CustomerUpdates(ChecksumBuckets):
    o_custkey: Int64
    updated_at: Timestamp

    @classmethod
    def checksum_params(cls) -> ChecksumParams:
        return ChecksumParams(group_by=("o_custkey",), updated_at_col="updated_at", inputs=OrderKeys)


@query("SELECT o_custkey, max(l_shipdate) AS updated_at FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY 1 HAVING max(l_shipdate) > (SELECT max(o_orderdate) FROM orders)")
def q_incremented_buckets(t: Tables) -> DataFrame:
    lines = select(t.lineitem, {"o_orderkey": this.l_orderkey, "updated_at": this.l_shipdate})
    shipped = t.orders.select("o_orderkey", "o_custkey") @ InnerJoin(lines, keys=["o_orderkey"]) @ Aggregate(by=["o_custkey"], max=["updated_at"])
    target = select(t.orders, {"updated_at": this.o_orderdate})
    return as_incremented_buckets(CustomerUpdates.of(shipped), Table(target, CustomerUpdates)).df


@query("SELECT c_custkey AS o_custkey, TIMESTAMP '2025-01-02' AS checksum_updated_at, event_id AS o_orderkey FROM customer LEFT JOIN events ON c_custkey=user_id")
def q_bucketed_inputs(t: Tables) -> DataFrame:
    buckets = select(t.customer, {"o_custkey": this.c_custkey, "checksum_updated_at": F.lit(T1).cast("timestamp_ntz"), "checksum": F.lit(1).cast("bigint")})
    inputs = select(t.events, {"o_custkey": this.user_id, "o_orderkey": this.event_id})
    return from_expression(OrderKeyBuckets @ AsBucketedInputs(), OrderKeyBuckets.of(buckets.distinct()), OrderKeys.of(inputs)).df


@query("WITH t0 AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, bit_xor(hash(o_orderkey)) AS c FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-01' GROUP BY 1), t1 AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, bit_xor(hash(o_orderkey)) AS c FROM orders GROUP BY 1) SELECT t1.o_custkey, CASE WHEN t0.c IS NOT DISTINCT FROM t1.c THEN TIMESTAMP '2025-01-01' ELSE TIMESTAMP '2025-01-02' END AS checksum_updated_at, CASE WHEN t0.c IS NOT DISTINCT FROM t1.c THEN t0.n ELSE t1.n END AS n FROM t1 LEFT JOIN t0 ON t1.o_custkey=t0.o_custkey")
def q_incremental_merge(t: Tables) -> DataFrame:
    store = ParquetTableStore(_scratch(t.spark), spark=t.spark)
    for at, inputs in ((T0, _keys(t, this.o_orderdate < MONTH_AGO)), (T1, _keys(t))):  # two runs, each with what the last one stored
        store.write_table(evaluate_incremental(OrderMarks, [provider_of_tables(inputs, TimestampNow.as_of(at, t.spark))], [store]))
        store.write_table(evaluate_incremental(OrderCounts, [provider_of_tables(inputs, store(OrderMarks))], [store]))
    return store(OrderCounts).df


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def q_check_increment(t: Tables) -> DataFrame:
    """Orders as if each were a bucket of its customer: what the check finds."""
    rows = select(t.orders, {"o_custkey": this.o_custkey, "checksum_updated_at": this.o_orderdate, "n": this.o_orderkey})
    return repeated_keys(OrderCounts, Table(rows, OrderCounts))


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS dbt_scd_id, CAST(NULL AS TIMESTAMP) AS dbt_updated_at, CAST(NULL AS TIMESTAMP) AS dbt_valid_from, CAST(NULL AS TIMESTAMP) AS dbt_valid_to FROM nation WHERE false")
def q_snapshot_schema(t: Tables) -> DataFrame:
    return snapshot_columns(NationNames.of(t.nation.select("n_nationkey", "n_name")).df)


@query("SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '2001-07-01' THEN 'new' ELSE 'old' END AS src FROM orders")
def q_incremental_strategies(t: Tables) -> DataFrame:
    path = _scratch(t.spark)
    select(t.orders, {"o_orderkey": this.o_orderkey, "src": F.lit("old")}).write.parquet(path)
    fresh = select(t.orders.where(this.o_orderdate >= MONTH_AGO), {"o_orderkey": this.o_orderkey, "src": F.lit("new")})
    return merge_into(path, fresh, ["o_orderkey"], "merge", t.spark)
