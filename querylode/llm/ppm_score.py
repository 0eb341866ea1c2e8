"""LM scoring by prediction by partial matching over bytes, beside the word model it is measured against.

The model reads a text as its words, A-Z lower-cased, one blank apart, and an end byte. A byte's contexts are the up to ORDER bytes before it,
across words; before the first byte stand ORDER end bytes. Each context counts the bytes that followed it in training. A byte is
coded in its longest context that was seen: with d distinct followers of n in all, one of count c has (c - 1/2) / n, and the escape
d / (2 n); after an escape the next shorter context is tried, without the bytes that longer ones would have coded. What no context
knows is spread evenly over the bytes left. The model is trained first and then fixed, so a byte's code length
depends on its gram (its longest context and itself) alone, and is computed once for each distinct gram of the corpus.

Documents are taken in blocks: pages of compressed text, and the block's distinct words and grams with their counts in training, as packed
sorted keys dealt to buckets by their hash. A bucket adds up what all blocks hold, key by key, so a hot word or gram costs one entry a
block, and every bucket has as many. What is gathered grows with the corpus. Grams then meet by the last two bytes of their context, which fix all shorter ones:
such a tail has at most 2**24 grams, and is one trie of contexts, whose nodes of order 2 to ORDER are computed in dense rows. The orders below are at most 65,792 rows,
which go to every task. Counts of words and codes of grams go back through the buckets to the blocks that hold them, which score their pages.
A bucket's task holds the bucket's distinct keys and passes the blocks by one at a time.

Words are told apart by 64-bit hashes. Defined results: a null or empty text is one end token; rows with the same doc_id
train and are scored each; a row with a null doc_id trains nothing and is held out; long texts are whole; extra columns are left
out; an empty table gives an empty result; without training documents every count is zero and bytes are spread evenly.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylode.llm.common import doc_text, drop_settled, release, settle, small_batches, table
from querylode.llm.shingles import mix, word_hashes, word_spans

ORDER = 4
#: Bytes of text in a block and in a page, about.
BLOCK, PAGE = 16 << 20, 1 << 20
END = b"\n"
PAGES, WORDS, GRAMS = 0, 1, 2

KEYED_DDL = "block long, kind int, part int, doc_ids array<long>, held array<boolean>, text binary, keys binary, n binary"
KEYED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("text", pa.binary()), ("keys", pa.binary()), ("n", pa.binary())])
SCORE_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def stream(text: bytes | None) -> bytes:
    """The bytes that the model reads."""
    return b" ".join((text or b"").lower().split()) + END


def packed(values: np.ndarray, gaps: bool = False) -> bytes:
    """8-byte values by planes of their bytes, compressed; sorted ones as their gaps."""
    values = np.ascontiguousarray(values).view(np.uint64)
    if gaps:
        values = np.diff(values, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(blob: bytes, gaps: bool = False) -> np.ndarray:
    values = np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if gaps else values


def read_page(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the words of each text, the gram of each byte to code, the bytes of each text."""
    pad = END * ORDER
    raw = np.frombuffer(pad + pad.join(streams), np.uint8)
    lens = np.array([len(s) for s in streams], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lens + ORDER)])
    starts, ends, rows = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends, lower=False)
    coded = np.ones(len(raw), bool)
    coded[(offsets[:-1, None] + np.arange(ORDER)).ravel()] = False
    at = np.flatnonzero(coded)
    grams = np.zeros(len(at), np.uint64)
    for k in range(ORDER, -1, -1):
        grams = grams << np.uint64(8) | raw[at - k]
    return words, np.diff(rows), grams, lens


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), minlength=len(found)).astype(np.int64)


def bucket_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys if kind == WORDS else mix(keys)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(kind: int, keys: np.ndarray, values: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, its keys, their values) of sorted keys."""
    where = bucket_of(kind, keys, buckets)
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(buckets + 1))
    for i in range(buckets):
        part = order[edges[i] : edges[i + 1]]
        if len(part):
            yield i, keys[part], values[part]


def blocks(docs: DataFrame, block: int, page: int, buckets: int) -> DataFrame:
    """Rows of pages (part is the page's number) and of a block's words and grams (part is the bucket) with their counts in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        streams: list[bytes] = []
        sums: dict[int, tuple[list, list]] = {WORDS: ([], []), GRAMS: ([], [])}
        size = done = pages = 0

        def rows(*many: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*many, strict=True), KEYED, strict=True)], schema=KEYED)

        def page_row() -> pa.RecordBatch:
            held = [held_out(i) for i in ids]
            words, n_words, grams, n_grams = read_page(streams)
            trains = ~np.array(held)
            for kind, keys, of in ((WORDS, words, n_words), (GRAMS, grams, n_grams)):
                at, found = pd.factorize(keys)
                sums[kind][0].append(found)
                sums[kind][1].append(np.bincount(at, np.repeat(trains, of), minlength=len(found)))
            return rows((number, PAGES, pages, list(ids), held, zstandard.compress(b"".join(streams), 3), None, None))

        def key_rows() -> Iterator[pa.RecordBatch]:
            for kind, (keys, counts) in sums.items():
                if any(map(len, keys)):
                    found, n = summed(keys, counts)
                    yield rows(*((number, kind, i, None, None, None, packed(k, True), packed(c)) for i, k, c in by_bucket(kind, found, n, buckets)))
                keys.clear()
                counts.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ids.append(doc_id)
                streams.append(stream(text))
                size += len(streams[-1])
                if size >= page:
                    yield page_row()
                    pages, done, size = pages + 1, done + size, 0
                    ids.clear()
                    streams.clear()
                    if done >= block:
                        yield from key_rows()
                        number, pages, done = number + 1, 0, 0
        if ids:
            yield page_row()
            done += size
        if done:
            yield from key_rows()

    return docs.mapInArrow(run, KEYED_DDL)


def bucket_sums(keyed: DataFrame) -> DataFrame:
    """kind, part, keys, n, total, known: each bucket's distinct keys with their sums over all blocks, the sum of all and how many are above 0."""
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("total", pa.int64()), ("known", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts, size = None, [], [], 0

        def row() -> pa.RecordBatch:
            found, n = summed(keys, counts)
            values = (at[0], at[1], packed(found, True), packed(n), int(n.sum()), int((n > 0).sum()))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for kind, part, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (kind, part) != at:
                    if keys:
                        yield row()
                    at, keys, counts, size = (kind, part), [], [], 0
                keys.append(unpacked(k, True))
                counts.append(unpacked(n).astype(np.float64))
                size += len(keys[-1])
                if size > 2 * len(keys[0]) + 1_000_000:
                    found, total = summed(keys, counts)
                    keys, counts, size = [found], [total.astype(np.float64)], len(found)
        if keys:
            yield row()

    rows = keyed.where(F.col("kind") > PAGES).select("kind", "part", "keys", "n").repartition("kind", "part").sortWithinPartitions("kind", "part")
    return rows.mapInArrow(run, "kind int, part int, keys binary, n binary, total long, known long")


def code_rows(orders: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of the 256 bytes in each of many contexts. orders: the followers' counts (contexts x 256) from the longest context to the empty one."""
    out = np.zeros(orders[0].shape)
    mass = np.zeros((len(out), 1))
    free = np.ones(out.shape, bool)  # not coded by a longer context
    for counts in orders:
        seen = free & (counts > 0)
        total = np.where(seen, counts, 0).sum(axis=1, keepdims=True)
        known = total > 0
        total = np.maximum(total, 1)
        out = np.where(seen, mass + np.log10(np.where(seen, counts - 0.5, 1) / total), out)
        mass = mass + np.where(known, np.log10(np.maximum(seen.sum(axis=1, keepdims=True), 1) / (2 * total)), 0)
        free &= ~seen
    return np.where(free, mass - np.log10(np.maximum(free.sum(axis=1, keepdims=True), 1)), out)


def dense(keys: np.ndarray, n: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Counts of the bytes that follow each of the sorted contexts; keys: context and byte."""
    out = np.zeros((len(contexts), 256))
    np.add.at(out, (np.searchsorted(contexts, keys >> np.uint64(8)), (keys & np.uint64(255)).astype(np.int64)), n)
    return out


def tail_codes(grams: np.ndarray, n: np.ndarray, low: Callable[[int], tuple[np.ndarray, np.ndarray]], step: int = 256) -> np.ndarray:
    """Codes of sorted grams that share the last two bytes of their context; low: counts after one byte, and after none."""
    contexts = np.unique(grams >> np.uint64(8))
    tail = int(contexts[0]) & 0xFFFF
    third = contexts & np.uint64(0xFFFFFF)
    order3 = np.unique(third)
    counts3 = dense(grams & np.uint64(0xFFFFFFFF), n, order3)
    counts2 = counts3.sum(axis=0, keepdims=True)
    counts1, counts0 = low(tail & 255)
    out = np.zeros(len(grams))
    edges = np.searchsorted(grams >> np.uint64(8), contexts[::step])
    for i, (a, b) in enumerate(zip(edges, [*edges[1:], len(grams)], strict=True)):
        part = contexts[i * step : (i + 1) * step]
        shape = (len(part), 256)
        orders = [dense(grams[a:b], n[a:b], part), counts3[np.searchsorted(order3, third[i * step : (i + 1) * step])], *(np.broadcast_to(c, shape) for c in (counts2, counts1, counts0))]
        rows = code_rows(orders)
        out[a:b] = rows[np.searchsorted(part, grams[a:b] >> np.uint64(8)), (grams[a:b] & np.uint64(255)).astype(np.int64)]
    return out


def gram_codes(sums: DataFrame, buckets: int) -> DataFrame:
    """kind, part, keys, values (8-byte codes) of all grams."""
    spark = sums.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist(), strict=True):
                grams, counts = unpacked(keys, True).view(np.int64), unpacked(n).view(np.int64)
                for at in range(0, len(grams), 65536):
                    part = grams[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(part >> 8 & 0xFFFF), pa.array(part), pa.array(counts[at : at + 65536])], ["tail", "gram", "n"])

    grams = settle(sums.where(F.col("kind") == GRAMS).select("keys", "n").mapInArrow(spread, "tail long, gram long, n long"), "grams")
    short = grams.groupBy(F.expr("gram & 65535").alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 65,536 rows
    table1 = np.zeros((256, 256))
    keys = short["key"].to_numpy()
    table1[keys >> 8, keys & 255] = short["n"].to_numpy()
    told = spark.sparkContext.broadcast(table1)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = told.value
        none = after.sum(axis=0)
        at, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            grams, n = (np.concatenate(x) for x in zip(*held, strict=True))
            grams = grams.view(np.uint64)
            code = tail_codes(grams, n, lambda byte: (after[byte], none))
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(GRAMS, grams, buckets).astype(np.int32)), pa.array(grams.view(np.int64)), pa.array(code)], ["part", "gram", "code"])

        for batch in batches:
            tails, grams, n = (c.to_numpy() for c in batch.columns)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(tails)) + 1, [len(tails)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a < b:
                    if tails[a] != at and held:
                        yield from done()
                        held = []
                    at = tails[a]
                    held.append((grams[a:b], n[a:b]))
        if held:
            yield from done()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def row() -> pa.RecordBatch:
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([GRAMS], pa.int32()), pa.array([at], pa.int32()), pa.array([packed(keys, True)], pa.binary()), pa.array([packed(values)], pa.binary())], ["kind", "part", "keys", "values"])

        for batch in batches:
            parts, keys, values = (c.to_numpy() for c in batch.columns)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a < b:
                    if parts[a] != at and held:
                        yield row()
                        held = []
                    at = int(parts[a])
                    held.append((keys[a:b], values[a:b]))
        if held:
            yield row()

    coded = grams.repartition("tail").sortWithinPartitions("tail", "gram").mapInArrow(codes, "part int, gram long, code double")
    out = settle(coded.repartition("part").sortWithinPartitions("part", "gram").mapInArrow(pack, "kind int, part int, keys binary, values binary"), "codes")
    drop_settled(grams)
    return out


def answers(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """block, kind, keys, values: what is known of the keys that each block holds."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = values = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for kind, _, block, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is None:  # comes first in its bucket
                    keys, values = unpacked(k, True), unpacked(v)
                else:
                    out.append((block, kind, k, packed(values[np.searchsorted(keys, unpacked(k, True))])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    asked = keyed.where(F.col("kind") > PAGES).select("kind", "part", "block", "keys", F.lit(None).cast("binary").alias("values"))
    both = asked.unionByName(known.select("kind", "part", F.lit(None).cast("long").alias("block"), "keys", "values"))
    return both.repartition("kind", "part").sortWithinPartitions("kind", "part", F.col("block").asc_nulls_first()).mapInArrow(run, "block long, kind int, keys binary, values binary")


def score(documents: DataFrame, block: int = BLOCK, page: int = PAGE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of documents."""
    spark = documents.sparkSession
    small_batches(spark)
    # a bucket's task holds the bucket's distinct keys; more than some thousands would leave a block few keys for each
    buckets = min(max(32, int(spark.conf.get("spark.sql.shuffle.partitions"))), 8192)
    keyed = settle(blocks(doc_text(documents), block, page, buckets), "blocks")
    sums = settle(bucket_sums(keyed), "sums")
    ends = keyed.where(F.col("kind") == PAGES).agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)).alias("n")).first()["n"]
    told = sums.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    trained, distinct = told["n"] + ends, told["v"] + (ends > 0)
    codes = gram_codes(sums, buckets)
    release(spark)
    known = sums.where(F.col("kind") == WORDS).select("kind", "part", "keys", F.col("n").alias("values")).unionByName(codes)
    answered = settle(answers(keyed, known), "answers")
    drop_settled(sums)
    drop_settled(codes)
    release(spark)

    floor = math.log10(trained + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held_keys, found = None, {}, {}
        for batch in batches:
            for block, kind, keys, values, doc_ids, held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at:
                    at, held_keys, found = block, {WORDS: ([], []), GRAMS: ([], [])}, {}
                if kind != PAGES:  # these come first in their block
                    held_keys[kind][0].append(unpacked(keys, True))
                    held_keys[kind][1].append(unpacked(values))
                    continue
                for k in [*held_keys]:
                    keys, values = (np.concatenate([*x, np.zeros(0, np.uint64)]) for x in held_keys.pop(k))
                    found[k] = pd.Index(keys), values.view(np.int64 if k == WORDS else np.float64)
                words, n_words, grams, n_grams = read_page([s + END for s in zstandard.decompress(text).split(END)[:-1]])
                c = found[WORDS][1][found[WORDS][0].get_indexer(words)] if len(words) else np.zeros(0, np.int64)
                code = found[GRAMS][1][found[GRAMS][0].get_indexer(grams)]
                of_word, of_gram = np.repeat(np.arange(len(doc_ids)), n_words), np.repeat(np.arange(len(doc_ids)), n_grams)
                base = np.bincount(of_word, np.log10(c + 1.0) - floor, minlength=len(doc_ids)) + math.log10(ends + 1.0) - floor
                seen = np.bincount(of_word, c > 0, minlength=len(doc_ids)).astype(np.int64) + (ends > 0)
                ppm = np.bincount(of_gram, code, minlength=len(doc_ids))
                columns = (doc_ids, held, n_words + 1, seen, np.full(len(doc_ids), trained), base, ppm)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, SCORES, strict=True)], schema=SCORES)

    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("doc_ids", "array<long>"), ("held", "array<boolean>"), ("text", "binary"))]
    texts = keyed.where(F.col("kind") == PAGES).select("block", "kind", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("values"), "doc_ids", "held", "text")
    both = answered.select("block", "kind", "keys", "values", *nothing).unionByName(texts)
    return both.repartition("block").sortWithinPartitions("block", F.col("kind") == PAGES).mapInArrow(run, SCORE_DDL)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
