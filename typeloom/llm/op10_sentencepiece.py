"""SentencePiece encoding and decoding with a score-ordered agenda.

A merge-type vocabulary is applied as the library does it: the normalised text
starts as single characters, an agenda (heap) holds every adjacent pair whose
join is a piece, and the pair with the best score, leftmost among equals, is
joined next. No piece of such a vocabulary has the word mark after another
character, and most stops and line ends stand beside no letter in any piece, so
the text falls into chunks that merge independently; ``Segmenter`` reads both
facts off the vocabulary and takes the whole text as one chunk where the first
does not hold. Chunks repeat, so each worker keeps a bounded memory of them.

New chunks that begin with the word mark and are longer than it are also encoded by
the sentencepiece library, many in a call, and both must agree; others, such as line
ends and what follows them, are held only against the operator's own byte table.

Results for odd input: null text counts as empty; an empty text gives the end id
alone and decodes to the empty text; equal texts give equal rows, and repeated
rows stay; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.common import column, kept, map_arrow, slices, table

MARK = "▁"
#: Chunks that a worker remembers, and code points of the longest one remembered.
REMEMBERED, LONGEST = 400_000, 64
#: Up to so many characters the agenda is a list, beyond it a heap. No pair: a score behind all others.
SHORT, NEVER = 40, float("inf")
#: New chunks are checked against the library so many at a time.
CHECK_BATCH = 4096


class Segmenter:
    """Encoder for one vocabulary file. ``encode`` gives the ids of a text without an end id."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        kinds = [(self.library.is_control(i), self.library.is_unknown(i), self.library.is_byte(i), self.library.is_unused(i)) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if kinds[i][2]}
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.ids = {self.pieces[i]: i for i in range(n) if not any(kinds[i])}
        self.rank = {p: -self.library.get_score(i) for p, i in self.ids.items()}
        self.special = {i for i in range(n) if kinds[i][0] or kinds[i][1]}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k[2] else (b"" if k[0] else p.replace(MARK, " ").encode()) for p, k in zip(self.pieces, kinds)]
        self.end = self.library.eos_id()
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank)
        self.chunks = self._chunk_pattern() if self.splits else re.compile("(?s).+")
        self.remembered = remembered
        self.memory: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.library_agrees = self._checks_normaliser()

    def _chunk_pattern(self) -> re.Pattern:
        """Cut before marks, and between two characters that stand next to each other in no piece.

        The second kind of cut is made between a set of separators (line ends,
        stops and the like) and all other characters: those of the candidates
        that no piece has beside a character outside the set.
        """
        pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1) if MARK not in p[i : i + 2]}
        apart = {chr(c) for c in range(128) if not chr(c).isalnum()}
        while mixed := {c for a, b in pairs if (a in apart) != (b in apart) for c in (a, b) if c in apart}:
            apart -= mixed
        inside = "".join(map(re.escape, sorted(apart)))
        return re.compile(f"{MARK}*[{inside}]+|{MARK}*[^{inside}{MARK}]+|{MARK}+" if apart else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def _checks_normaliser(self) -> bool:
        """Is normalising nothing but a leading blank and marks for blanks?"""
        probe = "  ﬁ ½́ A b\tc\n "
        return self.library.decode(self.library.encode(probe)) == probe and self.library.encode(probe) == self._by_chunks(probe)

    def _by_chunks(self, text: str) -> list[int]:
        return [i for chunk in self.split(text) for i in self.agenda(chunk)]

    def split(self, text: str) -> list[str]:
        return self.chunks.findall(MARK + text.replace(" ", MARK)) if text else []

    def agenda(self, chunk: str) -> list[int]:
        """Ids of a chunk: the best-scored adjacent pair, leftmost among equals, is joined until no pair is a piece."""
        ids: list[int] = []
        for s in self._join_short(chunk) if len(chunk) <= SHORT else self._join_long(chunk):
            if found := self.ids.get(s):
                ids.append(found)
            else:
                ids.extend(self.byte_ids[b] for b in s.encode("utf-8", "replace"))
        return ids

    def _join_short(self, chunk: str) -> list[str]:
        """The agenda is a list by position: for some dozen pairs its least entry is found sooner than a heap is kept."""
        get, symbols = self.rank.get, list(chunk)
        agenda = [get(chunk[i : i + 2], NEVER) for i in range(len(chunk) - 1)]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            joined = symbols[i] + symbols[i + 1]
            symbols[i] = joined
            del symbols[i + 1], agenda[i]
            if i:
                agenda[i - 1] = get(symbols[i - 1] + joined, NEVER)
            if i < len(agenda):
                agenda[i] = get(joined + symbols[i + 1], NEVER)
        return symbols

    def _join_long(self, chunk: str) -> list[str]:
        """The agenda is a heap and the symbols a linked list."""
        get, symbols = self.rank.get, list(chunk)
        n = len(symbols)
        heap = [(score, i, chunk[i : i + 2]) for i in range(n - 1) if (score := get(chunk[i : i + 2], NEVER)) != NEVER]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            # stale if either side has changed since: then the two no longer spell the piece
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, None
            k = after[i] = after[j]
            h = before[i]
            if k < n:
                before[k] = i
                if (score := get(joined + symbols[k], NEVER)) != NEVER:
                    heapq.heappush(heap, (score, i, joined + symbols[k]))
            if h >= 0 and (score := get(symbols[h] + joined, NEVER)) != NEVER:
                heapq.heappush(heap, (score, h, symbols[h] + joined))
        return [s for s in symbols if s is not None]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces and bytes are strung together and the leading blank goes."""
        ids = list(ids)
        try:
            text = b"".join(self.bytes_of[i] for i in ids).decode("utf-8")
        except UnicodeDecodeError:  # ids that no text has: the library says how such bytes show
            return self.library.decode(ids)
        if any(i in self.special for i in ids) and not all(i in (self.end,) for i in ids if i in self.special):
            return self.library.decode(ids)
        return text[1:] if text.startswith(" ") else text

    def learn(self, chunks: Iterable[str], into: dict[str, str]) -> None:
        """Segment new chunks and hold ids and decoded text against the library, in one call for many."""
        chunks = list(chunks)
        for at in range(0, len(chunks), CHECK_BATCH):
            part = chunks[at : at + CHECK_BATCH]
            ours = list(map(self.agenda, part))
            # the library puts a mark before a text, so a chunk loses its own first
            marked = [i for i, c in enumerate(part) if c[0] == MARK and len(c) > 1]
            for i, theirs in zip(marked, self.library.encode([part[i][1:].replace(MARK, " ") for i in marked], num_threads=1)):
                if theirs != ours[i]:
                    raise ValueError(f"the agenda and the library differ on {part[i]!r}: {ours[i]} and {theirs}")
            for c, ids in zip(part, ours):
                if b"".join([self.bytes_of[i] for i in ids]) != c.replace(MARK, " ").encode("utf-8", "replace"):
                    raise ValueError(f"the ids of {c!r} do not decode to it: {ids}")
                into[c] = " ".join(map(str, ids))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: ids without the end id, as a count and as a string, and the decoded text."""
        parts = [self.split(t) for t in texts]
        wanted = {c for p in parts for c in p}
        new = [c for c in wanted if c not in self.memory]
        if len(self.memory) + len(new) > self.remembered:  # what is still in use moves back over from the older half
            self.memory, self.older = {}, self.memory
            new = list(wanted)
        memory, older = self.memory, self.older
        if older:
            memory.update((c, older[c]) for c in new if c in older)
            new = [c for c in new if c not in older]
        passing: dict[str, str] = {}
        self.learn((c for c in new if len(c) <= LONGEST), memory)
        self.learn((c for c in new if len(c) > LONGEST), passing)
        known = memory if not passing else passing | {c: memory[c] for c in wanted if c in memory}
        for p in parts:
            ids = " ".join([known[c] for c in p])
            yield ids.count(" ") + 1 if ids else 0, ids, "".join(p).replace(MARK, " ")[1:]


def segmenter(path: str) -> Segmenter:
    return kept(f"pieces of {path}", lambda: Segmenter(path))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text. Columns: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from typeloom.llm.op10_sentencepiece import segmenter

        s = segmenter(vocabulary)
        for batch in slices(batches, "text"):
            texts = column(batch, "text").to_pylist()
            rows = []
            for n, ids, decoded in s.encode_all(texts) if s.library_agrees else ((len(i), " ".join(map(str, i)), s.decode(i)) for i in s.library.encode(texts, num_threads=1)):
                ids = f"{ids} {s.end}" if ids else str(s.end)
                rows.append((n + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *([list(map(int, ids.split())), decoded] if with_ids else [])))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), run, schema, f"pieces of {vocabulary}")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLES: dict[str, str] = {}
