"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker looks at in one go; bounds the scratch memory of vectorised passes.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch, unless the application sets the limit: ten thousand texts a batch fill the executors' memory.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs on this machine (tests), a temporary one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="typeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a reader of it.

    This cuts the lineage: a lost executor costs the tasks that it ran, not the
    stages before. The table goes when the Python driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/typeloom-{label}-{uuid.uuid4().hex}"
    spark.sparkContext._jvm.System.gc()  # as in sweep; one step later the second time
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made._typeloom_path = path
    return made


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of earlier steps, in whose stead there are tables by now.

    It does so when the driver's JVM finds them unreachable, which takes two rounds.
    """
    for _ in range(2):
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def rest(spark: SparkSession) -> None:
    """Let the executors' JVMs collect garbage, upon which they give heap back to the system that Python workers of later tasks need.

    One short task per core. Memory is all that hangs on it: an executor that gets none goes on as it is.
    """
    cores = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def release(made: DataFrame) -> None:
    """Remove a table that ``durable`` wrote, once nothing will read it again."""
    _remove(made.sparkSession, made._typeloom_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has already ended
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` has about ``most`` bytes in each piece (one long text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // most
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


_kept: dict[str, object] = {}


def kept(name: str, make):
    """``make()``, which a worker keeps for later tasks of the same ``map_arrow(..., keeps=name)``."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def keep_only(name: str | None) -> None:
    """Drop what other operators' tasks left in this worker: vocabularies and memories that nobody asks for again would add up."""
    for other in [k for k in _kept if k != name]:
        del _kept[other]


def map_arrow(df: DataFrame, function, schema: str, keeps: str | None = None) -> DataFrame:
    """``mapInArrow``, after which a worker gives memory back: it is kept for later tasks, and others run beside it meanwhile.

    Of what ``kept`` made, only ``keeps`` outlives the start of another function's task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from typeloom.llm.common import give_back, keep_only

        keep_only(keeps)
        try:
            yield from function(batches)
        finally:
            give_back()

    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(BATCH_LIMIT):
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Least and most bits of a membership bitmap: 4 MB to 32 MB.
LEAST_BITS, MOST_BITS = 1 << 25, 1 << 28
_SEGMENT = 32768  # bits in one bitmap_construct_agg value


def membership_bitmap(keys: DataFrame, key: str, bits: int | None = None) -> np.ndarray:
    """A bitmap of the int64 column ``key`` modulo ``bits``: 16 bits a row of ``keys`` if not given, between LEAST_BITS and MOST_BITS.

    It tells for sure that a key is absent; it may say that an absent key is
    present. It only spares shuffles: whoever uses it joins exactly afterwards.
    At most ``bits / 32768`` rows of 4 KB reach the driver.
    """
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    slot = F.pmod(F.col(key), F.lit(bits))
    found = keys.select((slot.cast("long")).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    out = np.zeros((bits + _SEGMENT) // 8, dtype=np.uint8)
    for row in found.collect():
        # bucket numbers are 1-based: value v > 0 is bit (v - 1) % 32768 of bucket 1 + (v - 1) / 32768; 0 and below go to bucket 0
        at = row.b * (_SEGMENT // 8)
        out[at : at + _SEGMENT // 8] = np.frombuffer(row.m, dtype=np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For int64 keys: may they be among those that ``membership_bitmap`` got?"""
    slot = keys.astype(np.int64) % (len(bitmap) * 8 - _SEGMENT)
    number = np.where(slot > 0, 1 + (slot - 1) // _SEGMENT, 0)
    position = np.where(slot > 0, (slot - 1) % _SEGMENT, (-slot) % _SEGMENT)
    return (bitmap[number * (_SEGMENT // 8) + position // 8] >> (position % 8).astype(np.uint8)) & 1 == 1


def crc_mod4(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
