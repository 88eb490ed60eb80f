"""Language identification with string kernels.

The kernel of two texts is a blended-spectrum presence kernel: the number of
character n-grams (lengths 1 to ``MAX_N``) that both have, over the geometric mean
of how many each has. Labelled texts are represented by their kernels with
landmark texts, whitened (Nyström), and one ridge regression per language is
fitted on that, one against the rest. N-grams are hashed into ``DIMENSIONS`` slots.

The kernel with a landmark is a sum over the n-grams of a text, so landmarks,
whitening and regression fold into one matrix of slots by languages, and a batch of
texts is scored by one sparse matrix product (rows of that matrix summed per text).

Model bounds, both parameters: ``PER_LANGUAGE`` labelled texts of each language are
fitted (chosen by a hash of the id), ``LANDMARKS`` of all of them are landmarks.
The driver sees these and no more. Everything else reads all rows and whole texts.

Results for odd input: null text, or text without a letter, is ``und`` with score
0; rows with null ids are predicted and never learned from; ties between languages
go to the first in order; without any labelled row every text with a letter is
``und``, too; repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.common import column, crc_mod4, map_arrow, slices, table

MAX_N, DIMENSIONS = 4, 1 << 16
PER_LANGUAGE, LANDMARKS, RIDGE = 400, 256, 1e-2
#: Text bytes that are scored in one go: their n-grams' weights take some ten times as many.
SLICE = 1 << 20
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def spectrum(text: str | None) -> np.ndarray:
    """Slots of the n-grams that a text has. Case counts for nothing, and all that is no letter is one blank."""
    if not text:
        return np.empty(0, np.int64)
    text = _OTHER.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, text)):
        return np.empty(0, np.int64)
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    seen = np.zeros(DIMENSIONS, dtype=bool)
    grams = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, MAX_N + 1):
        if len(codes) < n:
            break
        # the hash of an n-gram extends that of the (n-1)-gram at the same place
        grams = (grams[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        seen[(grams ^ (grams >> np.uint64(29))) >> np.uint64(20) & np.uint64(DIMENSIONS - 1)] = True
    return np.flatnonzero(seen)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text."""
        sets = [spectrum(t) for t in texts]
        sizes = np.array([len(s) for s in sets])
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = np.flatnonzero(sizes)
        if not len(some) or not self.languages:
            return names, scores
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        margins = np.add.reduceat(self.weights[np.concatenate([sets[i] for i in some])], starts, axis=0) / np.sqrt(sizes[some])[:, None]
        best = margins.argmax(axis=1)
        for i, k in zip(some, best):
            names[i] = self.languages[k]
        scores[some] = np.clip((1 + margins[np.arange(len(some)), best]) / 2, 0, 1)
        return names, scores


def fit(labelled: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From (language, slots) pairs; the first ``landmarks``, dealt over the languages in turn, are landmarks."""
    languages = sorted({lang for lang, _ in labelled})
    if not languages:
        return Model([], np.zeros((DIMENSIONS, 0)))
    turn: dict[str, int] = {}
    order = []
    for k, (lang, _) in enumerate(labelled):
        order.append((turn.setdefault(lang, 0), lang, k))
        turn[lang] += 1
    chosen = [k for _, _, k in sorted(order)[:landmarks]]
    presence = np.zeros((DIMENSIONS, len(chosen)), dtype=np.float32)
    for j, k in enumerate(chosen):
        presence[labelled[k][1], j] = 1 / np.sqrt(len(labelled[k][1]))
    kernels = np.stack([presence[s].sum(axis=0, dtype=np.float64) / np.sqrt(len(s)) for _, s in labelled])
    among = kernels[chosen]
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    used = values > 1e-6 * values.max()
    whitening = vectors[:, used] / np.sqrt(values[used])
    features = kernels @ whitening
    targets = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in labelled])
    weights = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ targets)
    return Model(languages, presence @ (whitening @ weights))


def train(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Fit on a sample of the rows that ``may_learn`` allows and whose ``lang`` is known."""
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not sizes:
        return fit([])
    # a hash below a language's bound takes some more than wanted; the least hashes of them are used
    hashed = F.xxhash64("doc_id", F.lit("language sample")).bitwiseAND((1 << 53) - 1)
    bound = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1 << 53, int((1.2 * per_language + 20) / n * (1 << 53))))) for lang, n in sorted(sizes.items())])
    sample = rows.select("lang", hashed.alias("h"), "text").where((F.col("h") < bound) & F.col("text").isNotNull())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = [spectrum(t).astype(np.int32) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "lang"), column(batch, "h"), pa.array(found, pa.list_(pa.int32()))], ["lang", "h", "slots"])

    taken: dict[str, int] = {}
    labelled = []
    for r in sorted(map_arrow(sample, run, "lang string, h long, slots array<int>").collect(), key=lambda r: (r.h, r.lang, r.slots)):
        if r.slots and taken.setdefault(r.lang, 0) < per_language:
            taken[r.lang] += 1
            labelled.append((r.lang, np.array(r.slots)))
    return fit(labelled, landmarks)


def identify(docs: DataFrame, model: Model, language_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``docs``, and language and score. Columns are taken by place, so their names may be anything else."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from typeloom.llm.op5_language import Model

        m = Model(*shared.value)
        for batch in slices(batches, "text", SLICE):
            languages, scores = m.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*names, language_col, score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, run, f"{schema}, `{language_col}` string, `{score_col}` double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod4(doc_id) == 2, F.lit(False))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = train(docs, ~held_out(F.col("doc_id")))
    text = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(text, model).drop("text")


QUERIES = {"op5_language": op5_language}
ORACLES: dict[str, str] = {}
