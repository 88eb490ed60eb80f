"""Removal of passages that stand elsewhere already, by hashing of units.

A unit is a sentence of a line: lines end at line feeds, and a sentence ends behind
``.``, ``!`` or ``?`` (with closing quotes or brackets) where white space follows, or
behind a full-width stop, whatever follows. In scripts without blanks between words
(Han, kana, Thai, Lao, Khmer, Burmese) a letter counts as a word where units are cut.
A sentence of more than ``WINDOW`` words is cut further at places that its words
choose: before the word with the least hash of each window of ``WINDOW`` words
(winnowing), so units have ``WINDOW`` words at most, and a passage has the same cuts
wherever it stands but for its two edges, whatever surrounds it.
A whole line is thus a run of units, and a passage that was put into the middle of
a line or of a sentence is a run as well, without the words before its first cut and
behind its last: ``WINDOW`` words on a side at most. Units are normalised (Unicode
compatibility form, case folded, white space to one blank) and hashed to 128 bits:
words of a batch together by array operations, and a unit by its words and their
places. Only words with other than ASCII and lower-case Latin-1 letters, and texts
with scripts without blanks, full-width stops or odd white space, are looked at one
by one.

Occurrences of equal digests are ranked by document id and place, and the first
stays. Runs of units that are not first (nothing but white space between them) are
removed if they have ``MIN_WORDS`` words or more together, where two
letters of scripts without blanks count as one. Lines are hashed whole as well, and a
line that is not the first of its kind is removed at any length; what stays everywhere
are shorter runs that are part of a line, and the edges above. What is removed is told
as offsets (code points) into the original text; ``words`` there are those between
white space.

One pass gives each digest once per document to an aggregation that is combined
before the shuffle, so a line that a third of all documents have makes one row per
map task. Digests found more than once set bits of a bitmap of fixed size; a second
pass gives only units whose bits are set, and these are joined exactly with the
repeated digests (Spark splits that join at hot digests). Spans are gathered by
document, which is bounded by the document, and joined to the texts.

Results for odd input: null text stays null, and empty text empty; a unit without a
word is never removed; in a table with repeated rows the later ones lose what the
first has (equal ids are told apart by a hash of the text; rows that are equal in id
and text are treated alike, as one document); a null id ranks last; an empty table
gives an empty table; other columns are kept whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.common import column, durable, in_bitmap, map_arrow, membership_bitmap, release, slices, sweep, table
from typeloom.llm.shingles import Shingler, U, mix, utf8_of, words_of

MIN_WORDS = 20
#: Bytes of text whose units are made in one go.
SLICE = 1 << 20
#: Words of a window in which the least hash makes a cut.
WINDOW = 8
_STOPS, _CLOSERS = "。！？．｡", "[\"'”’»)\\]」』）》】〉]*"
_STOP = re.compile(rf"[.!?]+{_CLOSERS}\Z")
_WIDE_STOP = re.compile(rf"[{_STOPS}][.!?{_STOPS}]*{_CLOSERS}\Z")
#: A letter of a script without blanks, with the marks that belong to it.
_LETTER = r"[\u0e01-\u0e30\u0e32\u0e33\u0e40-\u0e46\u0e81-\u0eb0\u0eb2\u0eb3\u0ebd-\u0ec6\u1000-\u102a\u103f\u1050-\u1055\u1780-\u17b3\u3005-\u3007\u3041-\u3096\u309d-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]"
_MARKS = r"[\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1\u0eb4-\u0ebc\u0ec8-\u0ecd\u102b-\u103e\u1056-\u1059\u17b4-\u17d3\u3099-\u309c\uff9e\uff9f\ufe00-\ufe0f]*"
_SPACELESS = re.compile(_LETTER)
#: Words of texts that are looked at one by one: a letter of such a script, or a run without white space that ends behind full-width stops.
_WORD = re.compile(rf"{_LETTER}{_MARKS}|(?:(?!{_LETTER})[^\s{_STOPS}])*?[.!?]*[{_STOPS}][.!?{_STOPS}]*{_CLOSERS}|(?:(?!{_LETTER})[^\s{_STOPS}])+")
_BY_HAND = re.compile(rf"{_LETTER}|[{_STOPS}\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_CLOSER, _DOT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_CLOSER[list(b"\"')]")] = _DOT[list(b".!?")] = True
LAST = (1 << 63) - 1
LINE = -1
#: What is added to the places of words, so that lines and units have different digests.
_PLACES = {"unit": U(0x1F83D9ABFB41BD6B), "line": U(0x5BE0CD19137E2179)}


@lru_cache(None)
def _hashers() -> tuple[Shingler, Shingler]:
    return Shingler(1, 11), Shingler(1, 12)


def _hash_forms(forms: list[str]) -> np.ndarray:
    """Two hashes of each form; those of the same word among bytes are the same."""
    data = [f.encode("utf-8", "surrogatepass") or b" " for f in forms]
    ends = np.cumsum([len(d) for d in data])
    whole = np.frombuffer(b"".join(data), dtype=np.uint8)
    return np.stack([h.hash_words(whole, np.concatenate([[0], ends[:-1]]), ends - 1) for h in _hashers()], axis=1)


class Words:
    """Words of some texts, as arrays: number of the text, begin and end (code points), two hashes, is it the last of a
    sentence, number of its line, does it stand behind white space, is it a letter of a script without blanks."""

    def __init__(self, text, begin, end, hashes, stop, line, blank, letter):
        self.text, self.begin, self.end, self.hashes, self.stop, self.line, self.blank, self.letter = text, begin, end, hashes, stop, line, blank, letter


def words_by_bytes(texts: pa.Array) -> Words:
    offsets, whole = utf8_of(texts)
    begins, ends = words_of(whole, offsets, _SPACE)
    if not len(begins):
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.empty((0, 2), U), none.astype(bool), none, none.astype(bool), none.astype(bool))
    hashes = np.stack([h.hash_words(whole, begins, ends) for h in _hashers()], axis=1)
    last = ends.copy()
    while len(more := np.flatnonzero(_CLOSER[whole[last]] & (last > begins))):
        last[more] -= 1
    stop = _DOT[whole[last]]
    # bytes that are neither ASCII nor of a letter from U+00E0 to U+00FF
    other = whole >= 0x80
    latin = np.flatnonzero(whole[:-1] == 0xC3)
    latin = latin[(whole[latin + 1] >= 0xA0) & (whole[latin + 1] < 0xC0)]
    other[latin] = other[latin + 1] = False
    seen = np.concatenate([[0], np.cumsum(other)])
    odd = np.flatnonzero(seen[ends + 1] > seen[begins])
    if len(odd):
        data = whole.tobytes()
        raw = [data[a:b] for a, b in zip(begins[odd].tolist(), (ends[odd] + 1).tolist())]
        number = {w: i for i, w in enumerate(dict.fromkeys(raw))}
        plain = [w.decode("utf-8", "surrogatepass") for w in number]
        which = np.array([number[w] for w in raw])
        hashes[odd] = _hash_forms(list(map(normal, plain)))[which]
        stop[odd] = np.array([_STOP.search(w) is not None for w in plain])[which]
    at = np.concatenate([[0], np.cumsum((whole & 0xC0) != 0x80)])  # code points before each byte
    text = np.searchsorted(offsets, begins, side="right") - 1
    start = at[offsets[text]]
    line = np.concatenate([[0], np.cumsum(whole == 10)])[begins] + text
    return Words(text, at[begins] - start, at[ends + 1] - start, hashes, stop, line, np.ones(len(text), dtype=bool), np.zeros(len(text), dtype=bool))


def words_by_hand(texts: list[str]) -> Words:
    rows: list[tuple] = []
    forms: dict[str, int] = {}
    line = 0
    for k, text in enumerate(texts):
        before = 0
        for m in _WORD.finditer(text):
            begin, end = m.span()
            word = m[0]
            line += text.count("\n", before, begin)
            before = begin
            stop = _WIDE_STOP.search(word) is not None or (_STOP.search(word) is not None and (end == len(text) or text[end].isspace()))
            rows.append((k, begin, end, forms.setdefault(normal(word), len(forms)), stop, line, not begin or text[begin - 1].isspace(), _SPACELESS.match(word) is not None))
        line += text.count("\n", before) + 1
    columns = [np.array(c) for c in zip(*rows)] if rows else [np.empty(0, np.int64)] * 8
    hashes = _hash_forms(list(forms))[columns[3]] if rows else np.empty((0, 2), U)
    return Words(*columns[:3], hashes, *columns[4:])


def cuts(hashes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Which words have the least hash of a window of WINDOW words within a sentence (of equals the rightmost)?"""
    out = np.zeros(len(hashes), dtype=bool)
    if len(hashes) >= WINDOW:
        inside = np.flatnonzero(sentence[WINDOW - 1 :] == sentence[: 1 - WINDOW])
        windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[inside, ::-1]
        out[inside + WINDOW - 1 - windows.argmin(axis=1)] = True
    return out


def keyed(texts: pa.Array) -> dict[str, np.ndarray]:
    """Units and lines of texts: text (its number), begin, end, words, weight, high, low, and unit (its number in the text, or LINE).

    ``weight`` is twice the words between white space and once the letters of scripts without blanks.
    """
    plain = texts.to_pylist()
    by_hand = np.array([bool(t) and not t.isascii() and _BY_HAND.search(t) is not None for t in plain], dtype=bool)
    found = [_units(words_by_bytes(texts.filter(pa.array(~by_hand))), np.flatnonzero(~by_hand))]
    if by_hand.any():
        which = np.flatnonzero(by_hand)
        found.append(_units(words_by_hand([plain[i] for i in which.tolist()]), which))
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def _units(w: Words, numbers: np.ndarray) -> dict[str, np.ndarray]:
    """``numbers``: those of the texts among all."""
    names = ("text", "begin", "end", "words", "weight", "high", "low", "unit")
    n = len(w.text)
    if not n:
        return {k: np.empty(0, np.int64) for k in names}
    new_line = np.concatenate([[True], w.line[1:] != w.line[:-1]])  # a line has words of one text
    new_sentence = new_line.copy()
    new_sentence[1:] |= w.stop[:-1].astype(bool)
    sentence = np.cumsum(new_sentence)
    sizes = np.bincount(sentence)
    new_unit = new_sentence | (cuts(w.hashes[:, 0], sentence) & (sizes[sentence] > WINDOW))
    made = []
    for kind, first in (("unit", np.flatnonzero(new_unit)), ("line", np.flatnonzero(new_line))):
        last = np.append(first[1:], n) - 1
        place = np.arange(n) - np.repeat(first, last - first + 1)
        salt = mix(place.astype(U) * U(0x9E3779B97F4A7C15) + _PLACES[kind])
        high, low = (mix(np.add.reduceat(mix(w.hashes[:, j] ^ salt), first) + (last - first).astype(U)).view(np.int64) for j in (0, 1))
        words, letters = (np.add.reduceat(x.astype(np.int64), first) for x in (w.blank, w.letter))
        text = w.text[first]
        if kind == "unit":
            begun = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            number = np.arange(len(first)) - np.repeat(begun, np.diff(np.append(begun, len(first))))
        else:
            number = np.full(len(first), LINE)
        made.append((numbers[text], w.begin[first], w.end[last], words, 2 * words + letters, high, low, number))
    return {k: np.concatenate([m[i] for m in made]).astype(np.int64) for i, k in enumerate(names)}


def units(text: str) -> list[tuple[int, int]]:
    """Begin and end of each unit of one text."""
    found = keyed(pa.array([text]))
    return sorted((b, e) for b, e, k in zip(found["begin"].tolist(), found["end"].tolist(), found["unit"].tolist()) if k != LINE)


def normal(unit: str) -> str:
    if not unit.isascii():
        unit = unicodedata.normalize("NFKC", unit)
    return " ".join(unit.casefold().split())


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans. A span that was whole lines takes its line feed along."""
    out, at, n = [], 0, len(text)
    for begin, end in spans:
        i, j = begin, end
        while i and text[i - 1] in " \t":
            i -= 1
        while j < n and text[j] in " \t":
            j += 1
        if (not i or text[i - 1] == "\n") and j < n and text[j] == "\n":
            end = j + 1
        elif end < n and text[end] in " \t" and (not begin or text[begin - 1].isspace()):
            end += 1
        out.append(text[at:max(at, begin)])
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def spans_of(doc: np.ndarray, unit: np.ndarray, begin: np.ndarray, end: np.ndarray, words: np.ndarray, weight: np.ndarray, min_words: int) -> dict[int, list[tuple[int, int, int]]]:
    """Begin, end and words of what each document loses, from its later units and lines, a place of the arrays for each."""
    order = np.lexsort((unit, doc))
    doc, unit, begin, end, words, weight = (x[order] for x in (doc, unit, begin, end, words, weight))
    line = unit == LINE
    goes = [(doc[line], begin[line], end[line], words[line])]
    doc, unit, begin, end, words, weight = (x[~line] for x in (doc, unit, begin, end, words, weight))
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (unit[1:] != unit[:-1] + 1)]))
        run = np.add.reduceat(weight, first) >= 2 * min_words
        last = np.append(first[1:], len(doc)) - 1
        goes.append((doc[first][run], begin[first][run], end[last][run], np.maximum(1, np.add.reduceat(words, first))[run]))
    out: dict[int, list[tuple[int, int, int]]] = {}
    for d, b, _, e, w in sorted((d, b, -e, e, w) for x in goes for d, b, e, w in zip(*(c.tolist() for c in x))):
        own = out.setdefault(d, [])
        if own and e <= own[-1][1]:
            continue
        if own and b < own[-1][1]:  # white space or stops that only normalising makes equal
            own[-1] = (own[-1][0], e, max(own[-1][2], w))
        else:
            own.append((b, e, w))
    return out


def removals(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, spans): spans are begin, end and words of what each document loses. Documents that lose nothing have no row."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("text <> ''")

    def first_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = keyed(column(batch, "text"))
            of = pa.array(found["text"])
            yield pa.RecordBatch.from_arrays([pa.array(found["high"]), pa.array(found["low"]), column(batch, "doc_id").take(of), column(batch, "text_hash").take(of), pa.array(found["begin"])], ["high", "low", "doc_id", "text_hash", "begin"])

    place = F.struct("doc_id", "text_hash", "begin")
    seen = map_arrow(rows, first_pass, "high long, low long, doc_id long, text_hash long, begin long")
    repeated = durable(seen.groupBy("high", "low").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("high", "low", "first"), "repeated")
    shared = docs.sparkSession.sparkContext.broadcast(membership_bitmap(repeated, "low"))
    sweep(docs.sparkSession)

    def second_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = keyed(column(batch, "text"))
            hit = in_bitmap(shared.value, found["low"])
            of = pa.array(found["text"][hit])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(of), column(batch, "text_hash").take(of), *(pa.array(found[c][hit]) for c in names)], ["doc_id", "text_hash", *names])

    names = ["high", "low", "begin", "end", "words", "weight", "unit"]
    again = map_arrow(rows, second_pass, "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in names))
    later = again.join(repeated, ["high", "low"]).where(F.struct("doc_id", "text_hash", "begin") > F.col("first"))
    of_doc = later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("unit", "begin", "end", "words", "weight")).alias("units"))

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = column(batch, "units")
            flat = found.flatten()
            names = [flat.type.field(i).name for i in range(flat.type.num_fields)]
            one = dict(zip(names, (x.to_numpy(zero_copy_only=False) for x in flat.flatten())))
            doc = np.repeat(np.arange(batch.num_rows), found.value_lengths().to_numpy(zero_copy_only=False))
            out = spans_of(doc, one["unit"], one["begin"], one["end"], one["words"], one["weight"], min_words)
            if out:
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
                of = pa.array(list(out), pa.int64())
                spans = pa.array([[{"begin": b, "end": e, "words": w} for b, e, w in x] for x in out.values()], kind)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(of), column(batch, "text_hash").take(of), spans], ["doc_id", "text_hash", "spans"])

    made = durable(map_arrow(of_doc, runs, "doc_id long, text_hash long, spans array<struct<begin:long,end:long,words:long>>"), "spans")
    release(repeated)
    return made


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed") -> DataFrame:
    """All columns of ``docs`` with ``text_col`` cut, and ``removed_col``: the spans that went, as offsets into the original text."""
    spans = removals(docs, min_words, id_col, text_col)
    names, told = docs.columns, removed_col
    sweep(docs.sparkSession)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text_col).alias("h"))
    found = spans.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "spans")
    joined = own.join(found, ["d", "h"], "left").select(*[F.col("row").getField(c) for c in names], "spans")
    at = names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not s else cut(t, [(x["begin"], x["end"]) for x in s]) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*names, told])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(joined.toDF(*[f"c{i}" for i in range(len(names))], "spans"), run, f"{schema}, `{told}` array<struct<begin:long,end:long,words:long>>")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.coalesce("removed", F.array().cast("array<struct<begin:long,end:long,words:long>>")).alias("removed"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES: dict[str, str] = {}
