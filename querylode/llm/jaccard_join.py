"""N-gram Jaccard join by prefix trees.

Documents are sets of word shingles; two are linked when 100 * intersection >= percent * union. All
elements have one global order: rare ones first, then by hash. A pair that reaches the bound must share one
of the first (rarest) n - ceil(percent * n / 100) + 1 elements of each, so only sets that share one of
those meet. How common an element is, by a few levels, is kept in bitmaps of fixed size; elements of the lowest level
are in one set only and meet nothing. What the bitmaps confuse only moves an element in the order, which is the same for
all sets, or lets a lone element through, so no link is lost; at sizes where they fill up the order becomes that of hashes.

Equal sets are one node, named by the 128-bit hash of the set. Nodes that share a rare element form a run; of runs with the same nodes one stays, that of
the rarest element.
1. Star rounds: each run's members meet one centre of it; the links found are merged into components, and only runs that
   hold several components go on. So a large group of near copies costs a few comparisons a member, not all its pairs.
2. Tree round: each run left is stored as a prefix tree of its members' rare elements and walked with each member. Sets with a
   common beginning share the partial overlap; a subtree ends where the overlap and what remains of either side cannot reach the bound,
   and a pair that shares a rarer element than the run's own is left to that one's run. A run of more than RUN_BLOCK members
   is dealt as pairs of blocks, so no task holds more than two blocks of a hot run.
The pairs that come out are compared in whole: the sets that meet one node are a prefix tree too, walked with that node's set.
Texts are read and hashed again for each pass (sizes, counts, rare elements, the few whole sets that are compared): less than moving
the sets, which are larger than the texts.

Defined results: a null or empty text, or one without words, has no shingles and is a component of its own; fewer
words than the shingle's length are one shingle; rows with the same doc_id count as one document
(a link of any of its texts is a link of all); rows with a null doc_id link as others do, but give a component no name, so theirs is null if it has no
other; long texts are whole; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylode.llm.common import doc_text, drop_settled, release, settle, small_batches, table
from querylode.llm.shingles import shingle_sets

#: Distinct sets from which an element moves up one level of commonness; below the first it is taken to be alone.
LEVELS = (2, 6, 64, 1024)
#: Bits of an element's hash by which it is counted, and bits of each level's bitmap (2**26: 8 MB).
KEY_BITS, BITMAP_BITS = 36, 26
#: Rounds with a single centre for each run, before the rest of each run is a tree.
STAR_ROUNDS = 2
#: Members that one comparison holds, and members of a run that a tree holds.
CHUNK, RUN_BLOCK = 256, 512
#: Links that one file of the components' tables holds.
LINKS_A_FILE = 100_000
#: Elements that a task holds before it sends its counts on.
HELD = 1 << 20


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, sig (128-bit hash of the set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(len(s), xxhash.xxh3_128_digest(s)) for s in shingle_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in told], pa.int64()), pa.array([sig for _, sig in told], pa.binary())], ["doc_id", "n", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, sig binary")


def id_bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for the low bits of each doc_id; the driver gets the bitmap's words only, 2**(bits - 6) at most."""
    slot = F.col("doc_id").bitwiseAND((1 << bits) - 1)
    words = ids.where("doc_id IS NOT NULL").groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(doc_id & 63 AS INT))")).alias("mask")).toArrow()
    bitmap = np.zeros(1 << max(bits - 6, 0), np.uint64)
    bitmap[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return bitmap


def wanted_rows(batch: pa.RecordBatch, bitmap: np.ndarray, bits: int) -> pa.RecordBatch:
    """The rows whose doc_id is in the bitmap, or null."""
    ids = batch.column("doc_id")
    slots = ids.fill_null(0).to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)
    held = ((bitmap[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1)).astype(bool)
    return batch.filter(pa.array(held | ids.is_null().to_numpy(zero_copy_only=False)))


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the bytes of their gaps, lowest bytes first, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T[:6]).tobytes(), 1)


def unpacked_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(6, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :6] = planes.T
    return np.cumsum(gaps.view(np.uint64).ravel())


def common_levels(docs: DataFrame, k: int, levels: tuple[int, ...], bits: int, heads) -> np.ndarray:
    """For each level a bitmap of the elements that so many of the sets in the bitmap heads hold, by the first bits of their hash.

    All elements are counted, by the first KEY_BITS bits. Tasks send sorted keys, packed, to the
    bucket of their range, so each key costs about 2 bytes on the way and a bucket holds as many as any other. A bucket's range is
    a piece of each bitmap, so the driver gets the bitmaps once over.
    """
    spark = docs.sparkSession
    buckets = min(1 << max(8, int(4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()), 1 << (bits - 6))
    edges = np.array([(i << KEY_BITS) // buckets for i in range(1, buckets)], np.uint64)
    piece, fold = (1 << bits) // buckets, np.uint64(KEY_BITS - bits)
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            parts = [(i, part) for i, part in enumerate(np.split(keys, np.searchsorted(keys, edges))) if len(part)]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([packed_keys(part) for _, part in parts], pa.binary())], schema=schema)

        size = 0
        for batch in batches:
            for found in shingle_sets(wanted_rows(batch, heads.value, bits).column("text"), k):
                if len(found):
                    held.append(found >> np.uint64(64 - KEY_BITS))
                    size += len(found)
                if size >= HELD:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def common() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            rows = []
            for level, least in enumerate(levels):
                hit = np.zeros(piece, bool)
                hit[(keys[times >= least] >> fold).astype(np.int64) - at * piece] = True
                if hit.any():
                    rows.append((level, at, zstandard.compress(np.packbits(hit, bitorder="little").tobytes(), 1)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["level", "bucket", "piece"])

        for batch in batches:
            for bucket, keys in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                if bucket != at and held:
                    yield common()
                    held = []
                at = bucket
                held.append(unpacked_keys(keys))
        if held:
            yield common()

    sent = docs.mapInArrow(send, "bucket int, keys binary").repartition("bucket").sortWithinPartitions("bucket")
    pieces = sent.mapInArrow(count, "level int, bucket int, piece binary").toArrow()
    bitmaps = np.zeros((len(levels), (1 << bits) // 8), np.uint8)
    for level, bucket, blob in zip(*(c.to_pylist() for c in pieces.columns), strict=True):
        bitmaps[level, bucket * piece // 8 : (bucket + 1) * piece // 8] = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return bitmaps.view(np.uint64)


def commonness(found: np.ndarray, bitmaps: np.ndarray, bits: int) -> np.ndarray:
    slot = found >> np.uint64(64 - bits)
    return ((bitmaps[:, slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).sum(axis=0).astype(np.int8)


def ranked(els: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Elements as numbers that rise as the global order does; the last bits of their hashes go, which can only make two of them one."""
    return ((level.astype(np.uint64) << np.uint64(59)) | (els >> np.uint64(5))).view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def rare_rows(docs: DataFrame, k: int, percent: int, bitmaps, bits: int, heads) -> DataFrame:
    """sig, n, els and places of every row whose doc_id is in the bitmap heads: the rare elements that other sets may hold, the rarest first, as numbers that rise, and how many elements of the set are rarer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, sizes, els, places = [], [], [], []
            for s in shingle_sets(wanted_rows(batch, heads.value, bits).column("text"), k):
                if not len(s):
                    continue
                level = commonness(s, bitmaps.value, bits)
                order = np.argsort(level, kind="stable")[: prefix_length(len(s), percent)]
                place = np.flatnonzero(level[order] > 0)
                if len(place):
                    sigs.append(xxhash.xxh3_128_digest(s))
                    sizes.append(len(s))
                    els.append(ranked(s[order[place]], level[order[place]]))
                    places.append(place.astype(np.int32))
            if sigs:
                ends = pa.array(np.cumsum([0, *map(len, els)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (els, places)]
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), *lists], ["sig", "n", "els", "places"])

    return docs.mapInArrow(run, "sig binary, n long, els array<long>, places array<int>")


def whole_sets(docs: DataFrame, k: int, bitmaps, bits: int, wanted) -> DataFrame:
    """sig and the whole set, common elements first (8 bytes an element), of every row whose doc_id is in the bitmap wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in shingle_sets(wanted_rows(batch, wanted.value, bits).column("text"), k) if len(s)]
            if sets:
                blobs = [s[np.argsort(-commonness(s, bitmaps.value, bits), kind="stable")].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(blobs, pa.binary())], ["sig", "els"])

    return docs.mapInArrow(run, "sig binary, els binary")


def distinct_runs(elements: DataFrame) -> DataFrame:
    """el: the rarest element of each distinct group of sets that share one (sets are told apart by two sums of hashes).

    A pair's rarest common element is also the rarest that all sets which share it have in common, so no pair's run goes. Near copies share dozens of elements, and
    mostly as the same group.
    """
    sums = [F.sum(F.xxhash64("sig", F.lit(1)).bitwiseAND((1 << 40) - 1)).alias("h1"), F.bit_xor(F.xxhash64("sig")).alias("h2")]
    groups = elements.groupBy("el").agg(F.count("*").alias("members"), *sums).where("members > 1")
    return groups.groupBy("members", "h1", "h2").agg(F.min("el").alias("el")).select("el")


def least_overlap(n: int, m: int, percent: int) -> int:
    """The smallest overlap x of sets of n and m elements with 100 * x >= percent * (n + m - x)."""
    return -(-percent * (n + m) // (100 + percent))


class PrefixTree:
    """Ordered sets as a prefix tree: a node holds the elements its sets have in common after their parent's, what ends there, and the sizes below it."""

    __slots__ = ("els", "ends", "children", "least", "most")

    def __init__(self, sets: list[tuple[object, np.ndarray]], depth: int = 0):
        """sets: sorted, so that equal beginnings stand together; all agree up to depth."""
        self.least, self.most = min(len(s) for _, s in sets), max(len(s) for _, s in sets)
        first, last = sets[0][1], sets[-1][1]
        m = min(len(first), len(last), self.least)
        differ = np.flatnonzero(first[depth:m] != last[depth:m])
        upto = depth + int(differ[0]) if len(differ) else m
        self.els = first[depth:upto]
        self.ends = [key for key, s in sets if len(s) == upto]
        self.children: list[PrefixTree] = []
        rest = [x for x in sets if len(x[1]) > upto]
        at = 0
        for i in range(1, len(rest) + 1):
            if i == len(rest) or rest[i][1][upto] != rest[at][1][upto]:
                self.children.append(PrefixTree(rest[at:i], upto))
                at = i

    @classmethod
    def of(cls, sets: list[tuple[object, bytes]]) -> PrefixTree:
        arrays = [(key, np.frombuffer(els, np.uint64)) for key, els in sets]
        return cls(sorted(arrays, key=lambda x: x[1].astype(">u8").tobytes()))

    def linked(self, probe: bytes, percent: int) -> list:
        """Keys of the sets that reach the bound with the probe."""
        want = np.sort(np.frombuffer(probe, np.uint64))
        n, found, open_ = len(want), [], [(self, 0, 0)]
        while open_:
            node, depth, overlap = open_.pop()
            if node.most * 100 < percent * n or 100 * n < percent * node.least:
                continue  # all sets below are too small or too large
            need = least_overlap(n, max(node.least, -(-percent * n // 100)), percent)
            at, dead = 0, False
            while at < len(node.els):  # in steps, so that a long node ends early
                step = node.els[at : at + 64]
                where = np.minimum(np.searchsorted(want, step), n - 1)
                overlap += int((want[where] == step).sum())
                at += len(step)
                if overlap + min(node.most - depth - at, n - overlap) < need:
                    dead = True  # nothing below reaches the bound
                    break
            if dead:
                continue
            depth += len(node.els)
            if overlap >= least_overlap(n, depth, percent):
                found += node.ends
            open_ += [(child, depth, overlap) for child in node.children]
        return found


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked. The members b of a centre a come in chunks of bounded size, each with the centre's set."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n_pairs")).withColumn("chunks", F.ceil(F.col("n_pairs") / CHUNK).cast("int"))
    keyed = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b")
    members = keyed.join(sets.select(F.col("sig").alias("b"), "els"), "b").select("a", "chunk", F.lit(1).alias("role"), "b", "els")
    probes = counts.join(sets.select(F.col("sig").alias("a"), "els"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), F.col("a").alias("b"), "els")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, probe = None, [], None

        def settled() -> list[tuple[bytes, bytes]]:
            return [(key[0], b) for b in PrefixTree.of(held).linked(probe, percent)] if held and probe else []

        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for a, chunk, role, b, els in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, chunk) != key or len(held) >= 2 * CHUNK:
                    out += settled()
                    if (a, chunk) != key:
                        key, probe = (a, chunk), None
                    held = []
                if role:
                    held.append((b, els))
                else:
                    probe = els
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], schema=schema)
        if out := settled():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], schema=schema)

    dealt = members.unionByName(probes).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")
    return dealt.mapInArrow(run, "a binary, b binary")


class RunTree:
    """The rare elements of a run's members, from the run's own on, as a prefix tree, the rarest first."""

    __slots__ = ("children", "ends", "least", "rest")

    def __init__(self):
        self.children: dict[int, RunTree] = {}
        self.ends: list[tuple] = []
        self.least, self.rest = 1 << 62, 0  # of the sets below: the smallest size, and the most elements that come after this node's

    @staticmethod
    def member(of: int, sig: object, n: int, comp: object, els: list[int], places: list[int]) -> tuple:
        """(sig, size, component, elements from `of` on, their places, elements before)"""
        at = bisect.bisect_left(els, of)
        return sig, n, comp, els[at:], places[at:], frozenset(els[:at])

    def add(self, member: tuple) -> None:
        node, n = self, member[1]
        node.least, node.rest = min(node.least, n), max(node.rest, n)
        for el, place in zip(member[3], member[4], strict=True):
            node = node.children.setdefault(el, RunTree())
            node.least, node.rest = min(node.least, n), max(node.rest, n - place - 1)
        node.ends.append(member)

    def partners(self, probe: tuple, percent: int) -> Iterator:
        """The sigs of members, in other components, that may reach the bound with the probe and whose rarest common element is the run's own."""
        _, n, comp, els, places, early = probe
        place = dict(zip(els, places, strict=True))
        last = els[-1]  # what comes later may be in the probe, too, beyond its rare elements, so it is no loss from there on
        open_ = [(self, 0, n, -1)]
        while open_:
            node, overlap, left, frozen = open_.pop()
            for sig, m, other, _, b_places, b_early in node.ends:
                rest = min(left, m - b_places[-1] - 1 if frozen < 0 else frozen)
                if other != comp and 100 * min(n, m) >= percent * max(n, m) and overlap + rest >= least_overlap(n, m, percent) and early.isdisjoint(b_early):
                    yield sig
            for el, child in node.children.items():
                at, now, rest = overlap, left, child.rest
                if el > last:
                    rest = node.rest if frozen < 0 else frozen
                elif el in place:
                    at, now = overlap + 1, n - place[el] - 1
                if at + min(rest, now) >= least_overlap(n, max(child.least, -(-percent * n // 100)), percent):
                    open_.append((child, at, now, rest if el > last else -1))


def tree_pairs(runs: DataFrame, rare: DataFrame, percent: int, block: int) -> DataFrame:
    """x, y (x < y): pairs of different components in the runs (el, sig, comp) that may reach the bound."""
    blocks = runs.groupBy("el").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("sig", "el"), F.col("blocks")).cast("int")
    dealt = runs.select("el", "sig", "comp").join(blocks, "el").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(rare.select("sig", "n", "els", "places"), "sig").select("el", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "sig", "n", "comp", "els", "places")
    schema = pa.schema([("x", pa.binary()), ("y", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, stored, same = None, RunTree(), [], True

        def record(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], schema=schema)

        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for el, lo, hi, side, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (el, lo, hi) != key:
                    key, tree, same = (el, lo, hi), RunTree(), lo == hi
                one = RunTree.member(el, *member)
                # a block by itself: each member meets those before it; two blocks: the second meets the first, which comes first
                if same or side:
                    out += [(min(one[0], b), max(one[0], b)) for b in tree.partners(one, percent)]
                if same or not side:
                    tree.add(one)
                if len(out) >= 4096:
                    yield record(out)
                    out = []
            if out:
                yield record(out)

    # as many tasks as there are partitions: walking the trees takes far longer than their size tells
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "el", "lo", "hi").sortWithinPartitions("el", "lo", "hi", "side").mapInArrow(run, "x binary, y binary")


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node it is connected with) of every node of links (a, b).

    Each round hangs a node's neighbours and its own label on the smallest of them and then follows one label further; the
    forest gets shallower by about half each round. Rounds are written out, so none is computed twice, in as many files as the links need: few links
    make small tables, which Spark then broadcasts by their size instead of exchanging both sides.
    """
    found = settle(links.select("a", "b").where("a <> b"), "links")
    files = min(found.count() // LINKS_A_FILE + 1, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = settle(found.union(found.select(F.col("b"), F.col("a"))).distinct().coalesce(files), "links")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")).coalesce(files), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        pulled = settle(labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")).coalesce(files), "labels")
        # the old label's node learns of the smaller one too
        told = pulled.groupBy(F.col("old").alias("node")).agg(F.min("comp").alias("told"))
        lower = settle(pulled.join(told, "node", "left").select("node", "old", F.least("comp", F.coalesce("told", "comp")).alias("comp")).coalesce(files), "labels")
        jumped = lower.join(lower.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp"))
        after = settle(jumped.coalesce(files), "labels")
        for done in (labels, pulled, lower):
            drop_settled(done)
        labels = after.select("node", "comp")
        if after.where("old <> comp").isEmpty():
            drop_settled(both)
            drop_settled(found)
            return labels


def joined(labels: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Labels after more links: only links between different components, as links of their names, are followed."""
    if labels is None:
        return components(fresh)
    ends = fresh.select(F.col("a").alias("node")).union(fresh.select("b")).distinct()
    every = labels.unionByName(ends.join(labels, "node", "left_anti").withColumn("comp", F.col("node")))
    every = settle(every, "every")
    name = lambda side: every.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp"))
    between = fresh.join(name("a"), "a").join(name("b"), "b").where("a_comp <> b_comp").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct()
    between = settle(between, "between")
    if between.isEmpty():
        return every
    names = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("name"))
    return settle(every.join(names, "comp", "left").select("node", F.coalesce("name", "comp").alias("comp")), "labels")


def jaccard_components(documents: DataFrame, k: int = 5, percent: int = 80, levels: tuple[int, ...] = LEVELS, bits: int = BITMAP_BITS, stars: int = STAR_ROUNDS, block: int = RUN_BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with an equal set) of every row of documents."""
    if not 50 <= percent <= 100:
        raise ValueError("the bound must lie between 50 and 100 percent")
    spark = documents.sparkSession
    small_batches(spark)
    docs = doc_text(documents)
    rows = settle(set_rows(docs, k), "sets")
    classes = settle(rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("class_id")), "classes")
    heads = spark.sparkContext.broadcast(id_bitmap(classes.select(F.col("class_id").alias("doc_id")), bits))
    bitmaps = spark.sparkContext.broadcast(common_levels(docs, k, levels, bits, heads))
    rare = settle(rare_rows(docs, k, percent, bitmaps, bits, heads).dropDuplicates(["sig"]), "rare")
    release(spark)

    elements = rare.select("sig", "n", F.explode(F.arrays_zip("els", "places")).alias("e")).select(F.col("e.els").alias("el"), "sig", "n", F.col("e.places").alias("place"))
    runs = settle(elements.join(distinct_runs(elements), "el"), "runs")
    # how many of a set's rare elements others have: an original has more such than its altered copies
    degrees = runs.groupBy("sig").agg((F.count("*") / F.first("n")).alias("degree"))
    runs = settle(runs.join(degrees, "sig").withColumn("comp", F.col("sig")), "runs")
    wanted = spark.sparkContext.broadcast(id_bitmap(classes.join(runs, "sig", "left_semi").select(F.col("class_id").alias("doc_id")), bits))
    sets = settle(whole_sets(docs, k, bitmaps, bits, wanted).dropDuplicates(["sig"]), "whole")
    release(spark)

    repeated = rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = settle(rows.join(repeated, "doc_id").select("doc_id", "sig", "n").distinct(), "repeated")
    links = repeated.where("n > 0").join(repeated.where("n > 0").groupBy("doc_id").agg(F.min("sig").alias("a")), "doc_id").select("a", F.col("sig").alias("b")).where("a <> b")
    links = settle(links, "found")
    labels = None if links.isEmpty() else joined(None, links)
    if labels is not None:
        runs = relabelled(runs, labels)
    tried = None
    for stage in range(stars + 1):
        if stage < stars:
            # the first centre is the likeliest original; later ones are any members, others in each run
            order = -F.col("degree") if stage == 0 else F.xxhash64("sig", "el", F.lit(stage)).cast("double")
            centres = runs.groupBy("el").agg(F.min(F.struct(order.alias("o"), F.col("sig").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"), F.col("place").alias("ap"))).alias("c")).select("el", "c.a", "c.an", "c.ac", "c.ap")
            met = runs.select("el", F.col("sig").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"), F.col("place").alias("bp")).join(centres, "el")
            # before its first common element a pair shares nothing, so no more than what comes from there on
            met = met.where(f"ac <> bc AND 100 * least(an, bn) >= {percent} * greatest(an, bn) AND {100 + percent} * least(an - ap, bn - bp) >= {percent} * (an + bn)")
            pairs = met.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("a").alias("a"))
        else:
            pairs = tree_pairs(runs, rare, percent, block).distinct().withColumn("a", F.col("x"))
        if tried is not None:
            pairs = pairs.join(tried, ["x", "y"], "left_anti")
        pairs = settle(pairs.select("x", "y", "a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b")), "pairs")
        fresh = settle(verify(pairs.select("a", "b"), sets, percent), "found")
        if not fresh.isEmpty():
            labels = joined(labels, fresh)
            if stage < stars:
                runs = relabelled(runs, labels)
        tried = pairs.select("x", "y") if tried is None else tried.unionByName(pairs.select("x", "y"))
        release(spark)

    # what the comparisons read goes before the result's own exchanges come
    for done in (sets, runs, rare):
        drop_settled(done)
    release(spark)
    comps = classes.select("sig", "class_id", F.col("class_id").alias("component_id"))
    if labels is not None:
        named = labels.join(classes, labels["node"] == classes["sig"])
        named = named.join(named.groupBy("comp").agg(F.min("class_id").alias("component_id")), "comp").select("sig", "component_id")
        comps = classes.join(named, "sig", "left").select("sig", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    out = rows.join(comps, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
    if not repeated.where("n = 0").isEmpty():  # a text without words goes where the document's others are
        of = out.join(repeated.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"), "class_id")
    return out


def relabelled(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """The runs that hold several components, each member with its own."""
    known = runs.drop("comp").join(labels.select(F.col("node").alias("sig"), "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    known = settle(known, "known")
    mixed = known.groupBy("el").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("el")
    out = settle(known.join(mixed, "el"), "open")
    drop_settled(known)
    drop_settled(runs)
    return out


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """The documents that are the smallest doc_id of their component, with all columns. Rows with a null doc_id, which come last, or with a doc_id that
    repeats are documents of their own, in the order of hashes of what they hold; of rows of one doc_id without words one stays."""
    odd = documents.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        stay = jaccard_components(documents, **options).where("doc_id = component_id").select("doc_id")
        return documents.join(stay, "doc_id", "left_semi").select(*documents.columns)
    key = "row_key_"
    held = [F.xxhash64("text"), F.xxhash64(*[c for c, kind in documents.dtypes if "map<" not in kind and kind != "variant"])]
    dealt = documents.withColumns({f"{key}{k}": h for k, h in enumerate(held)})
    order = [F.col("doc_id").asc_nulls_last(), F.col(f"{key}0"), F.col(f"{key}1")]
    # numbers rise from task to task and within each
    rows = settle(dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()).drop(f"{key}0", f"{key}1"), "rows")
    found = jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), **options).where("doc_id = component_id").select(F.col("doc_id").alias(key), "n_shingles")
    stay = settle(found, "stay")
    empty = rows.where("doc_id IS NOT NULL").join(stay.where("n_shingles = 0"), key, "left_semi").groupBy("doc_id").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = rows.join(stay.where("n_shingles = 0"), key, "left_semi").join(empty, "doc_id").where(F.col(key) > F.col("first")).select(key)
    return rows.join(stay, key, "left_semi").join(again, key, "left_anti").select(*documents.columns)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: The same rows by an equal join of all shingles and the closure of all links: for small tables.
ORACLE = r"""WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\x0c\r]+') AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) END AS s FROM words),
classes AS (SELECT s, min(doc_id) AS class_id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
els AS (SELECT class_id, n, unnest(s) AS el FROM classes),
shared AS (SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS x FROM els a JOIN els b ON a.el = b.el AND a.class_id < b.class_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * x >= 80 * (na + nb - x)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(least(classes.class_id, least_of.b), sets.doc_id) AS component_id, coalesce(classes.class_id, sets.doc_id) AS class_id
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN least_of ON least_of.a = classes.class_id"""
