"""Best-fit-decreasing packing of token sequences.

1. One pass tokenises every whole text and cuts documents that are longer than a
   sequence; a row per piece (no ids) is written to the shared folder.
2. Best-fit decreasing looks at lengths only, and there are at most ``capacity``
   of them. So the pieces are counted by length, and the driver packs the counts:
   lengths in descending order, each into the tightest open bins, which a segment
   tree over remaining capacities finds in logarithmic time. Bins with the same
   remainder are handled together as intervals of bin numbers, so the work depends
   on the capacity alone and the result is that of packing one piece at a time.
3. Each piece gets its rank among the pieces of its length (ranks within buckets,
   plus the sizes of the buckets before), and the plan turns a rank into a bin and
   a place in it.

Bound of the plan, which is broadcast: each length makes at most three new
intervals, and a bin holds at most sqrt(2 * capacity) different lengths; so for a
capacity of 4096 at most 12,288 * 90 rows of 48 bytes. Measured plans have some
thousand rows.

Results for odd input: a null or empty text is the end id alone; repeated rows are
packed each for itself; a null id is kept; ties between equal lengths go by id and
piece; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.llm.common import column, durable, kept, map_arrow, slices, table

CAPACITY, END_ID = 4096, 1
#: Text bytes that are split into chunks in one go; the list of them takes some 15 times that.
CHUNK_BYTES = 1 << 20
#: White-space separated chunks that a worker remembers (two halves of so many), and the longest one remembered.
REMEMBERED, LONGEST = 150_000, 48
#: Control characters that Python takes for white space and the tokenizer does not.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Code points from here on go to the library: its Unicode tables and Python's may be of different versions. Below it are the Latin blocks, which have no unassigned ones.
BEYOND = "\u0250"
#: Words inside chunks that a worker remembers besides.
WORDS = 100_000
_PARTS = re.compile(r"[^\W\d_]+|[\W_]+|\d")
#: The visible character that stands for each byte in byte-level vocabularies: its own where it has one, else the next from 256 on.
_OWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_VISIBLE = [chr(b) if b in _OWN else chr(256 + sum(x not in _OWN for x in range(b))) for b in range(256)]


class ChunkTokenizer:
    """Ids of whole texts by the tokenizers library, with a memory of chunks.

    It holds for tokenizers that drop white space and split at it (the vocabulary
    is asked when it is loaded); others get each text whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        probe = " Ab  c's\td1\nÉ ́x "
        self.chunked = self._whole(probe) == b"".join(map(self._whole, probe.split()))
        self.letters_plain = self.chunked and all(self._whole(w.upper()) == self._model(w) for w in ("the", "thblein", "zq", "\u00e9t\u00e9\u00f1", "\u0142\u01e7"))
        self.letters_plain = self.letters_plain and self._whole("a.b,,1\u00e9!") == b"".join(map(self._whole, ("a", ".", "b", ",,", "1", "\u00e9", "!")))
        self.words: dict[str, bytes] = {}
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _model(self, word: str) -> bytes:
        """Ids of a word that is nothing but letters, straight from the merges."""
        if not word.isascii():
            word = "".join([_VISIBLE[b] for b in word.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.library.model.tokenize(word)])

    def _plain(self, chunk: str) -> bytes | None:
        """Ids of a chunk of words and stops, where neither normalising nor an apostrophe has a say."""
        if "'" in chunk or not chunk.isascii() and (max(chunk) >= BEYOND or not unicodedata.is_normalized("NFC", chunk)):
            return None
        low = chunk.lower()
        if len(low) != len(chunk):
            return None
        if low.isalpha():
            return self._model(low)
        out, words = [], self.words
        for part in _PARTS.findall(low):
            if (found := words.get(part)) is None:
                found = self._model(part) if part.isalpha() else self._whole(part)
                if len(words) < WORDS and len(part) <= LONGEST:
                    words[part] = found
            out.append(found)
        return b"".join(out)

    def _learn(self, chunks: list[str], into: dict[str, bytes]) -> None:
        rest = []
        for c in chunks:
            found = self._plain(c) if self.letters_plain else None
            if found is None:
                rest.append(c)
            else:
                into[c] = found
        for c, found in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False)):
            into[c] = np.array(found.ids, dtype="<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.chunked:
            return [self._whole(t) for t in texts]
        parts: list[list[str] | bytes] = []
        for t in texts:
            if any(s in t for s in self.special) or any(c in t for c in ODD_SPACE):
                parts.append(self._whole(t))
            else:
                parts.append((t.lower() if t.isascii() else t).split())
        wanted = {c for p in parts if type(p) is list for c in p}
        new = [c for c in wanted if c not in self.memory]
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory, self.older = {}, self.memory
            new = list(wanted)
        memory, older = self.memory, self.older
        if older:
            memory.update([(c, older[c]) for c in new if c in older])
            new = [c for c in new if c not in older]
        passing: dict[str, bytes] = {}
        self._learn([c for c in new if len(c) <= LONGEST], memory)
        self._learn([c for c in new if len(c) > LONGEST], passing)
        known = memory if not passing else passing | {c: memory[c] for c in wanted if c in memory}
        return [p if type(p) is bytes else b"".join([known[c] for c in p]) for p in parts]


def tokenizer(path: str) -> ChunkTokenizer:
    return kept(f"chunks of {path}", lambda: ChunkTokenizer(path))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from typeloom.llm.op8_packing import tokenizer

        t, end = tokenizer(vocabulary), end_id.to_bytes(4, "little")
        for batch in slices(batches, "text", CHUNK_BYTES):
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, data in enumerate(t.encode_all(column(batch, "text").to_pylist())):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    of.append(row), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])],
                ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), run, schema, f"chunks of {vocabulary}")


class Openings:
    """Segment tree over remaining capacities: how many open bins have each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.leaves
        while i:
            self.open[i] += n
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remainder of an open bin that is ``length`` or more."""
        i = length + self.leaves
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` pieces of each length.

    Rows (length, rank, n, each, bin, place): the pieces of a length from ``rank``
    on, ``n`` of them, go ``each`` to a bin from ``bin`` on, from ``place`` on.
    """
    tree, at, plan, bins = Openings(capacity), {}, [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            at.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                # so many new bins as the rest of this length fills
                room, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                # a bin that takes one piece is then the tightest, so it is filled before the next
                first, n = at[room].pop()
                tree.add(room, -n)
                each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full * each, each, first, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                plan.append((length, rank, left, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, n - full)
    return plan


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length. A frequent length is spread over all buckets."""
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    within = spread.withColumn("within", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    return within.join(before, ["bucket", "length"]).withColumn("rank", F.col("before") + F.col("within")).drop("before", "within", "bucket")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id``, ``piece``, ``ids_crc32`` and ``length`` (1 to ``capacity``)."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    plan = np.array(sorted(plan_bins(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(plan)
    rows = ranked(pieces, max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    names = [c for c in rows.columns if c != "rank"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        key = p[:, 0] * (1 << 48) + p[:, 1]
        for batch in batches:
            length, rank = (column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = p[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(row[:, 4] + k // row[:, 3]), pa.array(row[:, 5] + k % row[:, 3] * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(names).schema)
    return map_arrow(rows, run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    pieces = durable(token_pieces(docs, vocabulary, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
