"""Corpus pipeline: five stages over ``documents``, each a corpus operator.

``STAGES`` holds (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which a runner may write as Parquet and reread for the next.
All but the last return the columns of their input.

Decisions:

- ``language``: documents that are ``und`` (no letter) go, and those that no
  language's classifier accepts (score below one half). Learned from the input's
  labelled rows whose crc32 of the id modulo 4 is not 2.
- ``quality``: documents that fail the rules, or whose host is refused, go.
- ``ngram_join``: shingles of five words, similarity 0.8; the least id of a
  component stays. Rows of equal id and text count as one.
- ``substring_dedup``: later occurrences of passages are cut out of the texts, and
  ``n_chars`` follows. A text that loses everything stays as an empty one.
- ``packing``: the result has a row per piece, as ``op8_packing``.

Results for odd input: as the operators say; an empty table passes through all
stages as an empty table; further columns are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import op3_ngram_join, op4_substring_dedup, op5_language, op6_quality, op8_packing
from typeloom.llm.common import durable, rest

LEAST_SCORE = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """A name like ``name`` that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _rested(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun on executors whose JVMs gave back the heap that the stage before grew: its Python workers stand beside them."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest(spark)
        return stage(spark, docs, sf_dir)

    return run


@_rested
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op5_language.train(docs, ~op5_language.held_out(F.col("doc_id")))
    lang, score = _free(docs, "language"), _free(docs, "score")
    found = op5_language.identify(docs, model, lang, score)
    return found.where((F.col(lang) != op5_language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


@_rested
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_quality.keep_good(docs)


@_rested
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = op3_ngram_join.Join(5, 8, 10).run(docs)
    kept = durable(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct(), "kept")
    mark = _free(docs, "text_hash")
    own = docs.withColumn(mark, F.xxhash64("text"))
    return own.join(kept, own["doc_id"].eqNullSafe(kept["_kept"]), "left_semi").dropDuplicates(["doc_id", mark]).drop(mark)


@_rested
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = _free(docs, "removed")
    cut = op4_substring_dedup.dedup(docs, removed_col=spans).drop(spans)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


@_rested
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality), ("ngram_join", ngram_join), ("substring_dedup", substring_dedup), ("packing", packing)]

#: Kernels, packing and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
