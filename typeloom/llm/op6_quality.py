"""Quality rules with host verdicts, in DataFrame functions only.

Each document gets counts and two rules of its own. Hosts (``source``) are then
judged: the rule failures of a host are a rate that is shrunk towards the rate of
all hosts by a beta prior, whose two parameters come from the mean and the variance
of the hosts' rates (method of moments). A document stays if it passes its own
rules and its host's shrunken rate does not exceed ``HOST_LIMIT``.

Words are maximal runs of characters other than blank, tab, line feed, vertical
tab, form feed and carriage return. Windows of three words are compared by 64-bit
hashes; that two different windows of one text agree has a chance below 1e-9 for a
text of 100,000 words.

The documents' counts are written to the shared folder before hosts are judged, so
texts are read once. Failures are summed before the shuffle, so that a host with a
third of all documents is no heavier than others; only hosts that are refused are
joined back to documents, and Spark splits that join where a host is hot.

Results for odd input: a null or empty text has no words and fails; a null source
is a host of its own; repeated rows count each time; one host, or hosts that do
not differ, get a prior of ``PRIOR_CAP`` documents; an empty table gives an empty
table. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.common import durable, table

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: A host goes if its shrunken rate of failures is beyond this.
HOST_LIMIT = 0.8
#: The prior weighs at most and at least so many documents.
PRIOR_CAP, PRIOR_FLOOR = 10_000.0, 1.0
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_counts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, host, the five counts and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    d = d.select(
        "doc_id",
        "host",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0).alias("lines"),
        F.array_remove(F.split("text", "[ \\t-\\r]+"), "").alias("words"),
    )
    d = d.select(
        "doc_id",
        "host",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.when(F.size("words") < 4, F.array().cast("array<bigint>")).otherwise(_windows(F.col("words"))).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    by_hash = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("by_hash", F.when(repeats, by_hash)).withColumn("places", F.when(F.col("by_hash").isNotNull(), _repeated_places(F.col("by_hash"))))
    d = d.withColumn("n_repeat_words", F.when(F.col("places").isNotNull(), _covered(F.col("places"))).otherwise(F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return d.select("doc_id", "host", *COUNTS, failed.alias("base_failed"))


def _windows(words: Column) -> Column:
    """A hash of each three words in a row."""
    return F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _repeated_places(by_hash: Column) -> Column:
    """Sorted places of the windows whose hash stands before or behind them in the sorted array."""
    found = F.filter(by_hash, lambda x, k: F.coalesce(x["h"] == F.get(by_hash, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(by_hash, k + 1)["h"], F.lit(False)))
    return F.sort_array(F.transform(found, lambda x: x["i"]))


def _covered(places: Column) -> Column:
    """Words in the union of the windows [i, i + 3)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"), (i + 3).alias("end")), lambda a: a["n"])


def host_rates(counts: DataFrame) -> DataFrame:
    """host, n, failures and the shrunken rate. ``counts`` has host and base_failed."""
    hosts = durable(counts.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures")), "hosts")
    rate = F.col("failures") / F.col("n")
    # one row: the moments of the hosts' rates
    mean, variance = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    weight, mean = prior_weight(mean, variance), mean or 0.0
    return hosts.withColumn("rate", (F.col("failures") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight)))


def prior_weight(mean: float | None, variance: float | None) -> float:
    """Of the beta prior (both parameters together), by the method of moments."""
    if not mean or not variance:
        return PRIOR_CAP
    return min(PRIOR_CAP, max(PRIOR_FLOOR, mean * (1 - mean) / variance - 1))


def refused_hosts(counts: DataFrame) -> DataFrame:
    return host_rates(counts).where(F.col("rate") > HOST_LIMIT).select(F.col("host").alias("refused_host"), "rate")


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of ``docs``."""
    counts = durable(document_counts(docs, id_col, host_col, text_col), "quality")
    refused = refused_hosts(counts)
    joined = counts.join(refused, counts["host"].eqNullSafe(refused["refused_host"]), "left")
    return joined.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("rate").isNull()).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; texts are not shuffled unless many hosts are refused."""
    refused = durable(refused_hosts(document_counts(docs, id_col, host_col, text_col)), "refused")
    own = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    counted = document_counts_of_rows(own.select(F.col("_row"), F.col(host_col).alias("host"), F.col(text_col).alias("text")))
    # a generator, since Spark would move a condition on a plain column below the arrays that it is computed from, and compute those for each element
    good = counted.select("_row", "host", F.explode(F.array(~F.col("base_failed"))).alias("passed")).where("passed")
    return good.join(refused, good["host"].eqNullSafe(refused["refused_host"]), "left_anti").select("_row.*")


def document_counts_of_rows(rows: DataFrame) -> DataFrame:
    """``document_counts`` where the id is a whole row."""
    return document_counts(rows, "_row", "host", "text").withColumnRenamed("doc_id", "_row")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op6_quality": op6_quality}
ORACLES = {
    "op6_quality": """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, source, t, ws, lines,
         list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri
  FROM w),
r AS (
  SELECT *, map_from_entries(list_transform(list_filter(map_entries(list_histogram(tri)), lambda e: e.value > 1), lambda e: (e.key, true))) AS dup FROM g),
c AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(range(1, len(ws) + 1), lambda i: dup[tri[i]] OR (i > 1 AND dup[tri[i - 1]]) OR (i > 2 AND dup[tri[i - 2]]))) AS BIGINT) AS n_repeat_words
  FROM r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS BIGINT)) AS f FROM b GROUP BY 1),
m AS (SELECT avg(CAST(f AS DOUBLE) / n) AS mean, var_pop(CAST(f AS DOUBLE) / n) AS v FROM h),
p AS (SELECT coalesce(mean, 0) AS mean, CASE WHEN mean > 0 AND v > 0 THEN least(10000.0, greatest(1.0, mean * (1 - mean) / v - 1)) ELSE 10000.0 END AS weight FROM m),
k AS (SELECT source, (f + mean * weight) / (n + weight) > 0.8 AS refused FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT refused AS kept
FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source"""
}
