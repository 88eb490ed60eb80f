"""N-gram Jaccard join with signature trees.

Documents are linked when the Jaccard similarity of their shingle sets is
``numerator / denominator`` or more. The result is the connected component of each
document; every link between different sets is accounted for, none is sampled.

1. *Sets.* One pass makes the shingle set of each whole text and, of it, a digest.
   Documents with equal sets are one class from here on. Two independent digests
   are made; should equal first ones have different second ones, the pass is made
   again with another seed. The same pass counts shingles in a table of fixed size
   (``COUNTERS``, by hash), over all sets.
2. *Candidates.* Shingles have one order for all sets: rarest first by those
   counters, then by hash. Of two similar sets, the first n - ceil(t * n) + 1
   shingles of each (its prefix) have one in common, whatever the order is, so the
   counters decide on cost and never on results: what many texts share comes last
   and is seldom in a prefix. Keys that occur once go by a count alone, and of keys
   with the same members one stays. Within each group of a key, parity sketches
   (their differing bits are a lower bound of the differing shingles) and sizes rule
   out pairs that cannot be similar; what is left makes components, the clusters,
   and similar sets are always in one cluster. A group of more than ``GATHERED``
   rows is never gathered: all of it is tied to its first member, unchecked.
3. *Signature trees.* A worker takes one cluster. Its sets, in order of size, are
   the leaves of a tree whose nodes hold the OR of bitmaps of hashes and the range
   of sizes. A dual traversal goes through pairs of nodes and drops those whose
   largest possible overlap is too small for their sizes, those whose size ranges
   do not fit, and those that are one component already. Pairs of leaves are
   compared exactly.
4. *Large clusters* (beyond ``CLUSTER_SETS`` sets or ``CLUSTER_HASHES`` hashes) are
   not given to one worker. All their sets are first compared with one pivot, the
   set with most ties. Those that are similar to it are one component and need no
   comparison with each other; the rest is compared with all, dealt into pairs of
   chunks of bounded size. The links found go through ``components``.

Results for odd input: null or empty text, or text without words, has no shingles
and is linked with nothing, itself its component; repeated rows and equal texts are
one component; a null id is linked like others and never the least of a component,
unless all its ids are null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.common import column, durable, in_bitmap, map_arrow, membership_bitmap, release, slices, table
from typeloom.llm.components import components
from typeloom.llm.shingles import Shingler, U, mix, set_digest

#: What a worker takes as one cluster.
CLUSTER_SETS, CLUSTER_HASHES = 4096, 4 << 20
LEAF = 8
#: Rows of a key's group that a worker gathers.
GATHERED = 512
#: Bytes of text that are made into sets in one go; the scratch arrays have some 100 times as many.
SLICE = 1 << 20
#: Counters of shingles: 4 MB as broadcast, with counts on a scale of 256 steps.
COUNTERS, COUNTER_PARTS = 1 << 22, 64
#: Members of clusters (40 bytes each) are broadcast to the sets up to so many.
BROADCAST_MEMBERS = 400_000
#: Digests that a task remembers so as to give keys of a class once.
REMEMBERED = 200_000
U32 = np.uint32(1)
FIRST_DIGEST, SECOND_DIGEST = 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179


def prefix(hashes: np.ndarray, ranks: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles of a set, so many that similar sets have one of them in common. ``ranks`` is the scale of counters."""
    most = len(hashes) - -(-num * len(hashes) // den) + 1
    order = (ranks[counter_of(hashes)].astype(U) << U(56)) | (hashes >> U(8))
    # shingles that tie with the last one come along, so that ties cannot differ between sets
    return hashes[order <= np.partition(order, most - 1)[most - 1]]


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> U(20)) & U(COUNTERS - 1)).astype(np.int64)


def scale(counts: np.ndarray) -> np.ndarray:
    """Counts to 256 steps, in order."""
    return np.minimum(255, 8 * np.log2(counts + 1.0)).astype(np.uint8)


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def sketch(hashes: np.ndarray) -> bytes:
    """A bit for each of some slots: is the number of shingles in it odd? At least as many bits as shingles, up to 16,384."""
    width = min(1 << 14, max(64, 1 << (len(hashes) - 1).bit_length()))
    return np.packbits(np.bincount((hashes & U(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


class Node:
    __slots__ = ("members", "bits", "least", "most", "excess", "children", "one")

    def __init__(self, members, bits, least, most, excess, children):
        self.members, self.bits, self.least, self.most, self.excess, self.children, self.one = members, bits, least, most, excess, children, len(members) == 1


class Forest:
    """The sets of a cluster (one list, or two to be compared with each other), and the links found among them."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []
        self.compared = 0
        width = 64
        while width < 4 * max(map(len, sets)) and width < 1 << 16:
            width *= 2
        self.bits = np.zeros((len(sets), width // 64), dtype=U)
        for row, s in zip(self.bits, sets):
            slot = s & U(width - 1)
            np.bitwise_or.at(row, (slot >> U(6)).astype(np.int64), U(1) << (slot & U(63)))
        self.excess = np.array([len(s) for s in sets]) - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def tree(self, members: list[int]) -> Node:
        """Members in order of size; a node holds the OR of its bitmaps, the range of sizes, and the most hashes that share bits in a set."""
        members = sorted(members, key=lambda i: len(self.sets[i]))
        level = []
        for at in range(0, len(members), LEAF):
            own = members[at : at + LEAF]
            level.append(Node(own, np.bitwise_or.reduce(self.bits[own], axis=0), len(self.sets[own[0]]), len(self.sets[own[-1]]), int(self.excess[own].max()), ()))
        while len(level) > 1:
            level = [self._parent(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]

    @staticmethod
    def _parent(pair: list[Node]) -> Node:
        if len(pair) == 1:
            return pair[0]
        a, b = pair
        return Node(a.members + b.members, a.bits | b.bits, a.least, b.most, max(a.excess, b.excess), (a, b))

    def joined(self, node: Node) -> bool:
        """Is the node one component? Once it is, it stays so."""
        if not node.one:
            if node.children:
                node.one = all(map(self.joined, node.children)) and self.find(node.children[0].members[0]) == self.find(node.children[1].members[0])
            else:
                node.one = len({self.find(i) for i in node.members}) == 1
        return node.one

    def may_match(self, a: Node, b: Node) -> bool:
        """Is the maximum possible overlap of a set below ``a`` and one below ``b`` enough for their least sizes?"""
        num, den = self.num, self.den
        if a.most * den < num * b.least or b.most * den < num * a.least:
            return False
        most = int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.excess, b.excess)
        return most * (num + den) >= num * (a.least + b.least)

    def compare(self, i: int, j: int) -> None:
        x, y = self.find(i), self.find(j)
        if x == y:
            return
        a, b = self.sets[i], self.sets[j]
        if min(len(a), len(b)) * self.den < self.num * max(len(a), len(b)):
            return
        most = int(np.bitwise_count(self.bits[i] & self.bits[j]).sum()) + min(self.excess[i], self.excess[j])
        if most * (self.num + self.den) < self.num * (len(a) + len(b)):
            return
        self.compared += 1
        if similar(a, b, self.num, self.den):
            self.parent[max(x, y)] = min(x, y)
            self.links.append((i, j))

    def within(self, root: Node) -> None:
        """All pairs below one node: near ones first, since what they join need not be looked at again."""
        if root.children:
            for child in root.children:
                self.within(child)
            self.between(*root.children)
        else:
            for k, i in enumerate(root.members):
                for j in root.members[k + 1 :]:
                    self.compare(i, j)

    def between(self, a: Node, b: Node) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self.joined(a) and self.joined(b) and self.find(a.members[0]) == self.find(b.members[0]):
                continue
            if not self.may_match(a, b):
                continue
            if a.children and (not b.children or len(a.members) >= len(b.members)):
                todo += [(c, b) for c in a.children]
            elif b.children:
                todo += [(a, c) for c in b.children]
            else:
                for i in a.members:
                    for j in b.members:
                        self.compare(i, j)


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows with the same keys, which come one after another."""
    now, held = None, []
    for batch in batches:
        columns = [column(batch, c) for c in names]
        plain = [c.to_pylist() if not pa.types.is_list(c.type) else c for c in columns]
        ids = list(zip(*(column(batch, k).to_pylist() for k in keys)))
        for i, key in enumerate(ids):
            if key != now and held:
                yield now, held
                held = []
            now = key
            # copied: a part of an Arrow batch would hold all of it
            held.append(tuple(c[i].values.to_numpy(zero_copy_only=False).copy().view(U) if isinstance(c, pa.Array) else c[i] for c in plain))
    if held:
        yield now, held


def _edges(pairs: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def plausible_pairs(rows: list[tuple[int, int, bytes]], num: int, den: int) -> list[tuple[int, int]]:
    """Of rows (set, size, sketch): links that connect all pairs whose sizes and sketches do not rule out the similarity."""
    if len(rows) == 2:  # the most frequent case
        (i, n, x), (j, m, y) = rows
        if min(n, m) * den < num * max(n, m):
            return []
        if len(x) == len(y):
            differ = (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()
            return [(i, j)] if differ * (den + num) <= (den - num) * (n + m) else []
    rows = sorted(rows, key=lambda r: r[1])
    sizes = np.array([r[1] for r in rows])
    widths = np.array([len(r[2]) // 8 for r in rows])  # in words of 64 bits; they grow with the size
    parent = np.arange(len(rows))
    out = []
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        first, last = int(own[0]), int(np.searchsorted(sizes, sizes[own[-1]] * den // num, side="right"))
        # a wider sketch is folded: bit i of it is bit i modulo the width
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(r[2], dtype=U).reshape(-1, width), axis=0) for r in rows[first:last]])
        for i in own.tolist():
            end = int(np.searchsorted(sizes, sizes[i] * den // num, side="right"))
            later = np.flatnonzero(parent[i + 1 : end] != parent[i]) + i + 1
            if not len(later):
                continue
            differ = np.bitwise_count(bits[later - first] ^ bits[i - first]).sum(axis=1).astype(np.int64)
            for j in later[differ * (den + num) <= (den - num) * (sizes[later] + sizes[i])].tolist():
                if parent[j] != parent[i]:
                    parent[parent == parent[j]] = parent[i]
                    out.append((rows[i][0], rows[j][0]))
    return out


class Join:
    """One join: shingles of ``k`` words, similarity ``num / den``."""

    def __init__(self, k: int, num: int, den: int, cluster_sets: int = CLUSTER_SETS, cluster_hashes: int = CLUSTER_HASHES):
        self.k, self.num, self.den, self.cluster_sets, self.cluster_hashes = k, num, den, cluster_sets, cluster_hashes

    def signatures(self, docs: DataFrame, seed: int, first: int = FIRST_DIGEST) -> DataFrame:
        """id, n, cls, second digest and mark of each row; and for each task the parts of its counters (part, counts), with n null."""
        k = self.k
        names = ["id", "n", "cls", "second", "mark", "part", "counts"]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, seen, counts = Shingler(k, seed), set(), np.zeros(COUNTERS, dtype=np.uint32)
            for batch in slices(batches, "text", SLICE):
                ns, cls, second = [], [], []
                for found in s.sets(column(batch, "text")):
                    c = set_digest(found, first)
                    ns.append(len(found)), cls.append(c), second.append(set_digest(found, SECOND_DIGEST))
                    if len(found) and c not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(c)
                        counts[counter_of(found)] += U32
                n = len(ns)
                yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(ns, pa.int64()), pa.array(cls, pa.int64()), pa.array(second, pa.int64()), column(batch, "mark"), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            if seen:
                parts = [_packed(x) for x in np.split(counts, COUNTER_PARTS)]
                none = pa.nulls(COUNTER_PARTS, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(range(COUNTER_PARTS), pa.int32()), pa.array(parts, pa.binary())], names)

        return durable(map_arrow(docs, run, "id long, n long, cls long, second long, mark long, part int, counts binary"), "signatures")

    @staticmethod
    def ranks(signatures: DataFrame) -> np.ndarray:
        """The counters of all tasks, added up and brought to a scale: 4 MB."""

        def add(keys: list[str]):
            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                now, total = None, None

                def done() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([_packed(total)], pa.binary())], ["part", "counts"])

                for batch in batches:
                    for *key, packed in zip(*(column(batch, c).to_pylist() for c in (*keys, "counts"))):
                        if key != now:
                            if now is not None:
                                yield done()
                            now, total = key, np.zeros(COUNTERS // COUNTER_PARTS, dtype=np.uint32)
                        more = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint32)
                        total += np.minimum(more, 0xFFFFFFFF - total)
                if now is not None:
                    yield done()

            return run

        # first within some groups of tasks, so that no task reads the counters of all
        parts = signatures.where("part IS NOT NULL").select("part", "counts").withColumn("lot", F.pmod(F.xxhash64("counts"), F.lit(16)).cast("int"))
        some = map_arrow(parts.repartition("part", "lot").sortWithinPartitions("part", "lot"), add(["part", "lot"]), "part int, counts binary")
        every = map_arrow(some.repartition("part").sortWithinPartitions("part"), add(["part"]), "part int, counts binary")
        out = np.zeros(COUNTERS, dtype=np.uint8)
        size = COUNTERS // COUNTER_PARTS

        def scaled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [scale(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=np.uint32)).tobytes() for x in column(batch, "counts").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(batch, "part"), pa.array(found, pa.binary())], ["part", "counts"])

        for row in map_arrow(every, scaled, "part int, counts binary").collect():
            out[row.part * size : (row.part + 1) * size] = np.frombuffer(row.counts, dtype=np.uint8)
        return out

    def prefixes(self, docs: DataFrame, ranks: np.ndarray, seed: int) -> DataFrame:
        """row, cls, n, sketch and keys of each class, once per task."""
        k, num, den = self.k, self.num, self.den
        shared = docs.sparkSession.sparkContext.broadcast(ranks)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, seen = Shingler(k, seed), set()
            for batch in slices(batches, "text", SLICE):
                kept, cls = [], []
                for found in s.sets(column(batch, "text")):
                    c = set_digest(found, FIRST_DIGEST) if len(found) else None
                    if c is not None and c not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(c)
                        kept.append(found), cls.append(c)
                if kept:
                    keys = [prefix(f, shared.value, num, den).view(np.int64) for f in kept]
                    flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]), pa.int32()), pa.array(np.concatenate(keys)))
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array([len(f) for f in kept], pa.int64()), pa.array([sketch(f) for f in kept], pa.binary()), flat], ["cls", "n", "sketch", "keys"])

        # rows get small numbers of their own, which the shuffle of keys compresses better than digests
        return durable(map_arrow(docs.select("text"), run, "cls long, n long, sketch binary, keys array<long>").withColumn("row", F.monotonically_increasing_id()), "prefixes")

    def candidate_ties(self, prefixes: DataFrame) -> DataFrame:
        """(key, row, first, size): rows that share a key, each with the least of its group and the group's size. Of groups with the same rows one is left."""
        spark = prefixes.sparkSession

        def with_keys_of(kept: DataFrame) -> DataFrame:
            """(key, row) for the keys of ``kept``, and some others."""
            shared = spark.sparkContext.broadcast(membership_bitmap(kept, "key"))

            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    keys, rows = column(batch, "keys"), column(batch, "row").to_numpy()
                    flat = keys.flatten().to_numpy()
                    hit = in_bitmap(shared.value, flat)
                    yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), pa.array(np.repeat(rows, keys.value_lengths().to_numpy())[hit])], ["key", "row"])

            return map_arrow(prefixes.select("row", "keys"), run, "key long, row long")

        repeated = durable(prefixes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"), "repeated")
        groups = with_keys_of(repeated).groupBy("key").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("row")).alias("rows")).where("size > 1")
        kept = durable(groups.groupBy("first", "size", "rows").agg(F.min("key").alias("key")).select("key", "first", "size"), "groups")
        release(repeated)
        tied = durable(with_keys_of(kept).join(kept, "key"), "tied")
        release(kept)
        return tied

    def plausible_ties(self, prefixes: DataFrame, tied: DataFrame) -> DataFrame:
        """(a, b): classes that share a key and whose sizes and sketches allow the similarity; enough pairs to connect all such."""
        num, den, most = self.num, self.den, min(GATHERED, self.cluster_sets)
        spark = tied.sparkSession
        sketches = prefixes.select("row", "n", "sketch")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        dealt = tied.where(F.col("size") <= most).select("key", "row").join(sketches, "row").repartition(parts, "key").sortWithinPartitions("key")

        def connect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: set[tuple[int, int]] = set()
            for _, rows in _runs(batches, ["key"], ["row", "n", "sketch"]):
                kept.update(plausible_pairs(rows, num, den))
                if len(kept) >= 100_000:
                    yield _edges(kept)
                    kept = set()
            if kept:
                yield _edges(kept)

        large = tied.where((F.col("size") > most) & F.expr("row <> first")).select(F.col("first").alias("a"), F.col("row").alias("b"))
        ties = map_arrow(dealt, connect, "a long, b long").unionByName(large).distinct()
        cls = prefixes.select("row", "cls")
        named = ties.join(cls.toDF("a", "x"), "a").join(cls.toDF("b", "y"), "b")
        return durable(named.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "plausible")

    def sets_of(self, docs: DataFrame, members: DataFrame, seed: int) -> DataFrame:
        """(cls, hashes) for texts with the marks of ``members``; some others may come along, and a class once per task."""
        k = self.k
        shared = docs.sparkSession.sparkContext.broadcast(membership_bitmap(members, "mark"))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, seen = Shingler(k, seed), set()
            for batch in slices(batches, "text", SLICE):
                batch = batch.filter(pa.array(in_bitmap(shared.value, column(batch, "mark").to_numpy())))
                cls, kept = [], []
                for found in s.sets(column(batch, "text")) if batch.num_rows else ():
                    c = set_digest(found, FIRST_DIGEST)
                    if len(found) and c not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(c)
                        cls.append(c), kept.append(found)
                if kept:
                    flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in kept])]), pa.int32()), pa.array(np.concatenate(kept).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), flat], ["cls", "hashes"])

        return map_arrow(docs.select("text", "mark"), run, "cls long, hashes array<long>")

    def cluster_links(self, sets: DataFrame) -> DataFrame:
        """(cls, label) within clusters of bounded size: rows cluster, cls, hashes."""
        num, den = self.num, self.den

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in _runs(batches, ["cluster"], ["cls", "hashes"]):
                own = dict(rows)
                cls = sorted(own)
                f = Forest([own[c] for c in cls], num, den)
                f.within(f.tree(list(range(len(cls)))))
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array([cls[f.find(i)] for i in range(len(cls))], pa.int64())], ["cls", "label"])

        # a number of partitions is given, as their work is far more than their bytes tell
        parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), sets.sparkSession.sparkContext.defaultParallelism)
        dealt = sets.select("cluster", "cls", "hashes").repartition(parts, "cluster").sortWithinPartitions("cluster")
        return map_arrow(dealt, run, "cls long, label long")

    def large_links(self, sets: DataFrame, ties: DataFrame) -> DataFrame:
        """(a, b): links of large clusters, enough of them to connect what is connected. Rows cluster, size, hash_total, cls, hashes."""
        num, den = self.num, self.den
        degree = ties.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("degree"))
        sets = durable(sets.dropDuplicates(["cls"]), "large")
        chunks = F.greatest(F.ceil(F.col("size") / self.cluster_sets), F.ceil(F.col("hash_total") / self.cluster_hashes)).cast("int")
        sets = sets.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
        best = sets.select("cluster", "cls").join(degree, "cls").groupBy("cluster").agg(F.max_by("cls", F.struct("degree", "cls")).alias("cls"))
        pivots = sets.join(best.select("cls"), "cls", "left_semi").select("cluster", F.col("cls").alias("pivot"), F.col("hashes").alias("pivot_hashes"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

        def to_pivot(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, pivot = column(batch, "hashes"), column(batch, "pivot_hashes")
                near = [similar(own[i].values.to_numpy(zero_copy_only=False), pivot[i].values.to_numpy(zero_copy_only=False), num, den) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([column(batch, "cls"), column(batch, "pivot"), pa.array(near, pa.bool_())], ["cls", "pivot", "near"])

        met = durable(map_arrow(sets.select("cluster", "chunk", "cls", "hashes").join(pivots, ["cluster", "chunk"]).select("cls", "pivot", "hashes", "pivot_hashes"), to_pivot, "cls long, pivot long, near boolean"), "pivots")
        rest = sets.join(met.where("NOT near").select("cls"), "cls", "left_semi")
        every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        left = rest.select("cluster", F.col("chunk").alias("r"), every.alias("g"), F.lit(0).alias("side"), "cls", "hashes")
        # a chunk of the whole goes where there is a chunk of the rest
        filled = rest.select("cluster", F.col("chunk").alias("r")).distinct()
        right = sets.join(filled, "cluster").select("cluster", "r", F.col("chunk").alias("g"), F.lit(1).alias("side"), "cls", "hashes")

        def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in _runs(batches, ["cluster", "r", "g"], ["side", "cls", "hashes"]):
                a, b = [i for i, r in enumerate(rows) if r[0] == 0], [i for i, r in enumerate(rows) if r[0] == 1]
                if not a or not b:
                    continue
                f = Forest([r[2] for r in rows], num, den)
                where: dict[int, int] = {}
                for i, r in enumerate(rows):  # a set may stand on both sides
                    f.parent[i] = where.setdefault(r[1], i)
                f.between(f.tree(a), f.tree(b))
                if f.links:
                    yield pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i, _ in f.links], pa.int64()), pa.array([rows[j][1] for _, j in f.links], pa.int64())], ["a", "b"])

        dealt = left.unionByName(right).repartition("cluster", "r", "g").sortWithinPartitions("cluster", "r", "g")
        found = map_arrow(dealt, pairs, "a long, b long")
        return durable(met.where("near AND cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b")).unionByName(found), "links")

    @staticmethod
    def members(labels: DataFrame, classes: DataFrame) -> DataFrame:
        """(cluster, cls, mark, size, hash_total) from component labels."""
        clusters = labels.select(F.col("node").alias("cls"), F.col("label").alias("cluster")).join(classes.select("cls", "n", "mark"), "cls")
        totals = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("hash_total"))
        return durable(clusters.drop("n").join(totals, "cluster"), "members")

    def run(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_shingles, component_id for each row of ``docs``."""
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
        seed = 0
        while True:
            signatures = self.signatures(rows, seed)
            own = signatures.where("n IS NOT NULL")
            classes = durable(own.where("n > 0").groupBy("cls").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.min("mark").alias("mark"), F.min("second").alias("s"), F.max("second").alias("t")), "classes")
            if classes.where("s <> t").isEmpty():
                break
            release(signatures), release(classes)
            seed += 1  # two sets had one digest
        prefixes = self.prefixes(rows, self.ranks(signatures), seed)
        tied = self.candidate_ties(prefixes)
        ties = self.plausible_ties(prefixes, tied)
        release(prefixes), release(tied)
        members = self.members(components(ties), classes)
        large = (F.col("size") > self.cluster_sets) | (F.col("hash_total") > self.cluster_hashes)
        few = members.count() <= BROADCAST_MEMBERS  # else Spark shuffles both sides
        told = members.drop("mark")
        sets = durable(self.sets_of(rows, members, seed).join(F.broadcast(told) if few else told, "cls"), "sets")
        labels = self.cluster_links(sets.where(~large))
        if not members.where(large).isEmpty():
            labels = labels.unionByName(components(self.large_links(sets.where(large), ties)).select(F.col("node").alias("cls"), "label"))
        labels = durable(labels, "components")
        for done in (sets, ties, members):
            release(done)
        least = labels.join(classes, "cls").groupBy("label").agg(F.min("least").alias("component"))
        # a table, so that both sides of the last join are plain and Spark can split it at hot classes
        of_class = durable(classes.join(labels.join(least, "label"), "cls", "left").select("cls", F.coalesce("component", "least").alias("component")), "classified")
        joined = own.select("id", "n", "cls").join(of_class, "cls", "left")
        return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Join(3, 9, 10).run(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and the reach of each document.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1, 2"""

QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLES = {"op3_ngram_join": ORACLE}
