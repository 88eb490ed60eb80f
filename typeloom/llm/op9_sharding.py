"""Sharding by extendible hashing.

A document's hash is the first 60 bits of the MD5 of its id. A directory is indexed
by leading bits: it starts with one bucket for everything, and only buckets with
more than ``SHARD_BYTES`` bytes of text split, on one more bit, until all fit.

Sums of bytes are taken once for the cells of ``bits`` leading bits, where ``bits``
is chosen from the total so that cells are far smaller than a shard; the sums of
shorter prefixes follow from them. A cell's shard is the shortest of its prefixes
that fits. Cells that are still too large (a hot id, say) are summed again with
``STEP`` more bits, and only they. Sums are combined before the shuffle, so hot
cells are no heavier than others.

A document that is larger than a shard by itself is a shard of its own once its
bucket has no other document. Rows whose hashes are equal cannot be parted by bits;
if they exceed a shard together, they are dealt out in order (by text hash and a
number within it) by running sums over groups of bounded size, and the parts are
numbered behind the prefix. Rows of the directory: about 64 per shard.

Results for odd input: a null text has no bytes; a null id is hashed as the empty
string; repeated rows count each time; an empty table gives an empty table; other
columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.llm.common import durable, table

SHARD_BYTES = 32 << 20
HASH_BITS, STEP, CELLS_PER_SHARD = 60, 12, 64


def hash_of(id_column: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def first_bits(total: int, limit: int) -> int:
    """Leading bits of the cells that are summed first."""
    return min(HASH_BITS, max(4, (CELLS_PER_SHARD * total // limit).bit_length()))


def prefix(hashed: Column, bits: int) -> Column:
    return F.shiftright(hashed, HASH_BITS - bits)


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(cell, bits, depth): cells of ``bits`` leading bits, and how many of them their shard uses; null where no prefix fits. Rows: hash, bytes."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits, done, least = first_bits(total, limit), None, 0
    todo = rows
    while True:
        cells = durable(todo.groupBy(prefix(F.col("hash"), bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "cells")
        level = cells.withColumn("depth", F.lit(None).cast("int"))
        for depth in range(bits, least - 1, -1):
            up = F.shiftright("cell", bits - depth)
            fits = cells.groupBy(up.alias("up")).agg(F.sum("bytes").alias("all"), F.sum("n").alias("alone")).where((F.col("all") <= limit) | (F.col("alone") == 1)).select("up")
            level = level.join(fits, F.shiftright(level["cell"], bits - depth) == fits["up"], "left").select("cell", F.when(F.col("up").isNotNull(), F.lit(depth)).otherwise(F.col("depth")).alias("depth"))
        level = durable(level, "directory").withColumn("bits", F.lit(bits))
        tight = level.where("depth IS NULL")
        if bits == HASH_BITS or tight.isEmpty():
            return (level if done is None else done.unionByName(level)), bits
        fine = level.where("depth IS NOT NULL")
        done = fine if done is None else done.unionByName(fine)
        todo = todo.join(tight.select(F.col("cell").alias("c")), prefix(F.col("hash"), bits) == F.col("c"), "left_semi")
        least, bits = bits + 1, min(HASH_BITS, bits + STEP)


def assign(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, depth and shard (the prefix as bits, and a number behind it for rows that bits cannot part)."""
    rows = durable(_hashed(docs, id_col, text_col), "hashed")
    named = _named(rows, directory(rows, limit)[0], limit)
    return named.select("doc_id", F.col("bytes").alias("n_bytes"), F.col("depth").cast("int").alias("depth"), "shard")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all columns of ``docs`` as Parquet, a folder per shard; returns the name of the folders' column.

    That is ``shard``, with underscores behind it where a column of ``docs`` has the
    name. Its values are those of ``assign`` behind an ``s``, so that readers keep
    their zeros. A shard is written by one task, as a file unless the session bounds
    the records of one.
    """
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    cells = directory(durable(_hashed(docs, id_col, text_col), "hashed"), limit)[0]
    named = _named(_hashed(docs, id_col, text_col, whole=True), cells, limit)
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    named.select(*columns, F.concat(F.lit("s"), F.col("shard")).alias(name)).repartition(name).write.partitionBy(name).parquet(path)
    return name


def _hashed(docs: DataFrame, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """doc_id, hash, bytes and salt of each row, and the row itself if ``whole``."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    return docs.select(F.col(id_col).alias("doc_id"), hash_of(F.col(id_col)).alias("hash"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), F.xxhash64(text_col).alias("salt"), *row)


def _named(rows: DataFrame, cells: DataFrame, limit: int) -> DataFrame:
    """``rows`` with depth and shard."""
    kept = rows.columns
    sizes = [r.bits for r in cells.select("bits").distinct().collect()]  # one for each round of splits
    parts = []
    for bits in sizes:
        own = cells.where(F.col("bits") == bits).select(F.col("cell").alias("c"), "depth")
        parts.append(rows.join(own, prefix(F.col("hash"), bits) == F.col("c")).select(*kept, "depth"))
    joined = parts[0] if parts else rows.withColumn("depth", F.lit(None).cast("int"))
    for p in parts[1:]:
        joined = joined.unionByName(p)
    named = joined.where("depth IS NOT NULL").withColumn("part", F.lit(None).cast("long"))
    stuck = joined.where("depth IS NULL")
    if not stuck.isEmpty():
        named = named.unionByName(_deal(stuck, limit))
    bits_of = F.lpad(F.conv(F.col("hash").cast("string"), 10, 2), HASH_BITS, "0")
    return named.withColumn("shard", F.concat(F.substring(bits_of, F.lit(1), F.col("depth")), F.coalesce(F.concat(F.lit("-"), F.col("part").cast("string")), F.lit(""))))


def _deal(stuck: DataFrame, limit: int) -> DataFrame:
    """Number the parts of rows with equal hashes: running sums within 256 groups of each hash, each closed off for itself."""
    group = F.pmod(F.xxhash64("salt", F.monotonically_increasing_id()), F.lit(256)).cast("int")
    fixed = durable(stuck.withColumn("group", group), "stuck")
    order = Window.partitionBy("hash", "group").orderBy("salt", "bytes")
    running = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a part takes what begins in one half of the limit: with rows of up to half of it, it fits; larger rows are parts of their own
    small = F.col("bytes") <= limit // 2
    step = F.when(small, F.floor((running - F.col("bytes")) / F.lit(max(1, limit // 2)))).otherwise(F.lit(-1) - F.row_number().over(order))
    dealt = fixed.withColumn("step", step)
    numbers = dealt.groupBy("hash", "group", "step").agg(F.count(F.lit(1)).alias("k")).withColumn("part", F.row_number().over(Window.partitionBy("hash").orderBy("group", "step")).cast("long")).drop("k")
    return dealt.join(numbers, ["hash", "group", "step"]).withColumn("depth", F.lit(HASH_BITS)).select(*stuck.columns, "part")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def _oracle(limit: int = SHARD_BYTES, deepest: int = 24) -> str:
    """The shortest prefix that fits, by sums at each depth."""
    depths = f"range(0, {deepest + 1})"
    return f"""
WITH h AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash FROM documents),
l AS (SELECT unnest({depths}) AS depth),
s AS (SELECT depth, hash >> ({HASH_BITS} - depth) AS p, sum(n_bytes) AS b, count(*) AS n FROM h, l GROUP BY 1, 2),
f AS (SELECT h.doc_id, h.n_bytes, h.hash, min(s.depth) AS depth FROM h, l, s WHERE s.depth = l.depth AND s.p = h.hash >> ({HASH_BITS} - l.depth) AND (s.b <= {limit} OR s.n = 1) GROUP BY ALL)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(depth AS INTEGER) AS depth, substr(lpad(bin(hash), {HASH_BITS}, '0'), 1, CAST(depth AS INTEGER)) AS shard FROM f"""


#: A limit at which the small tables split, too.
SMALL_BYTES = 256 << 10


def sharding_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), SMALL_BYTES)


QUERIES = {"op9_sharding": op9_sharding, "sharding_small": sharding_small}
ORACLES = {"op9_sharding": _oracle(), "sharding_small": _oracle(SMALL_BYTES)}
