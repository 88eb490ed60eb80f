"""Canonical exact digests of documents.

A text is brought to a canonical form (compatibility normalisation, case folding,
runs of white space to one blank, trimmed) and hashed with 128-bit xxhash. Texts
with equal hashes are a bucket. Inside buckets the canonical bytes are compared:
the least and the greatest text of a bucket are found by an aggregation that is
combined before the shuffle, and a bucket whose two differ holds a collision. The
fingerprints of such a bucket are made longer by half the SHA-256 of the text.

Likeness of two fingerprints is 1 if they are equal and 0 otherwise: the digest is
exact and does not know nearness.

Only texts that may have a twin go into the comparison: hashes that occur twice are
gathered in a bitmap of fixed size (4 MB), and the aggregation gets the texts whose
bits are set. A group of copies with a third of all rows thus makes one row for each
map task.

The edited text needs the beginning of the next document in order of ids. Documents
are range-partitioned by id (one shuffle of the texts) and each task walks its range
in order. The last document of a range meets the first of the next range in a second
step over one row per range end.

Results for odd input: null text counts as empty; empty texts share one fingerprint;
rows that tie on the id are ordered by text; a null id comes first; a single row is
its own next document; an empty table gives an empty table; other columns do not
matter.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.llm.common import column, durable, in_bitmap, map_arrow, membership_bitmap, slices, table


def canonical(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(text: str | None) -> str:
    """128 bits of the canonical form, as 32 hexadecimal digits."""
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by as many of ``following``, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _low(hexadecimal: str) -> int:
    """The low half of a digest as a signed number."""
    return int.from_bytes(bytes.fromhex(hexadecimal[16:]), "big", signed=True)


def fingerprint(text: str | None, collided: np.ndarray | None = None) -> str:
    """The digest; with 128 bits more if the bitmap of collided digests has it."""
    form = canonical(text).encode("utf-8", "surrogatepass")
    found = xxhash.xxh3_128_hexdigest(form)
    if collided is not None and in_bitmap(collided, np.array([_low(found)]))[0]:
        return f"{found}-{hashlib.sha256(form).hexdigest()[:32]}"
    return found


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, canonical) of the texts that may share a digest with another row; equal ones of an Arrow batch once."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([_low(digest(t)) for t in column(batch, "text").to_pylist()], pa.int64())], ["low"])

    twice = map_arrow(rows, digests, "low long").groupBy("low").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = docs.sparkSession.sparkContext.broadcast(membership_bitmap(twice, "low"))

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            forms = [canonical(t) for t in column(batch, "text").to_pylist()]
            found = [xxhash.xxh3_128_hexdigest(t.encode("utf-8", "surrogatepass")) for t in forms]
            hit = in_bitmap(shared.value, np.array([_low(f) for f in found], dtype=np.int64))
            kept = list(dict.fromkeys((f, t) for f, t, h in zip(found, forms, hit) if h))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in kept]), pa.array([t for _, t in kept])], ["digest", "canonical"])

    return map_arrow(rows, texts, "digest string, canonical string")


def collisions(pairs: DataFrame) -> DataFrame:
    """The digests of (digest, canonical) rows whose texts are not all the same, byte for byte."""
    return pairs.groupBy("digest").agg(F.min("canonical").alias("a"), F.max("canonical").alias("b")).where("a <> b").select("digest")


def collided_bitmap(digests: DataFrame) -> np.ndarray | None:
    """None if there are none, which is all but sure."""
    low = durable(digests.select(F.conv(F.substring("digest", 17, 16), 16, -10).cast("long").alias("low")), "collisions")
    return None if low.isEmpty() else membership_bitmap(low, "low")


def edits(docs: DataFrame, collided: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint and next_fingerprint for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "next_fingerprint", "range", "end", "text"]
    schema = "doc_id long, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, next_fingerprint string, range int, end string, text string"
    shared = docs.sparkSession.sparkContext.broadcast(collided)

    def made(doc_id: int | None, text: str, own: str, following: str, next_own: str) -> tuple:
        changed = edited(text, following)
        return doc_id, len(text), own, hashlib.sha256(changed.encode()).hexdigest(), fingerprint(changed, shared.value), next_own, None, None, None

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, last = TaskContext.get().partitionId(), None
        for batch in slices(batches, "text"):
            out = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                own = fingerprint(text, shared.value)
                if last is None:
                    out.append((doc_id, len(text), own, None, None, None, at, "first", text))
                else:
                    out.append(made(*last, text, own))
                last = doc_id, text, own
            yield batch_of(out)
        if last is not None:
            yield batch_of([(last[0], len(last[1]), last[2], None, None, None, at, "last", last[1])])

    walked = durable(map_arrow(rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text"), walk, schema), "ranges")
    ends = walked.where("range IS NOT NULL")
    # a row per range: which range comes next, and after the last the first
    ranges = ends.where("end = 'first'").select("range")
    order = Window.orderBy("range")
    following = ranges.select("range", F.lead("range").over(order).alias("next"), F.min("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("least"))
    following = following.select("range", F.coalesce("next", "least").alias("next"))
    firsts = ends.where("end = 'first'").select(F.col("range").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    pairs = ends.where("end = 'last'").select("doc_id", "text", "fingerprint", "range").join(following, "range").join(firsts, "next").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_of([made(*row) for row in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")))])

    done = walked.where("range IS NULL").unionByName(map_arrow(pairs, meet, schema))
    return done.drop("range", "end", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's columns for each row of ``docs``."""
    collided = collided_bitmap(collisions(candidates(docs, text_col)))
    made = edits(docs, collided, id_col, text_col)
    alike = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("edited_fingerprint").alias("near_edited"), alike("next_fingerprint").alias("near_next"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLES: dict[str, str] = {}
