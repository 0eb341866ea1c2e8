"""Benchmark decontamination: a BM25 index of test items, searched by every passage with block-max WAND.

Items (cut into segments of at most SEGMENT words) are the indexed documents and passages of the corpus the queries. A score is a share
of the segment's own score, so one threshold serves all. Passages are windows of three chunks of 32 words, one beginning at
each chunk, so any segment lies whole in some passage.

All passages of a batch go through the blocks of segments together: for each passage the terms' largest impacts in a block (block maxima) are added up, and a block is a pivot only where that bound reaches the threshold;
all others are skipped, and only a pivot's segments are scored. Terms that many items hold are not expanded
but allowed for by the most they can add to the block, except in segments that reach the threshold by such terms alone. What is above it is verified against the text: enough of the item's 3-word shingles must occur near the
passage, of its question and of its answer each. A part of one or two words is one shingle, which counts only beside a shingle
of the other part, as a word alone occurs anywhere.

The index is the benchmark, which has a checked size: beyond MAX_INDEX_BYTES of text it is searched slice by slice, each a pass over the documents. Document frequencies, the mean length and which terms are common
are those of the whole benchmark, so slicing changes no score and no result.

Defined results: null or empty texts and items have no terms and no leaks; items and rows of documents that repeat are
reported each; long texts are searched whole; extra columns are left out; an empty table
on either side gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylode.llm.common import doc_text, settle, small_batches, table
from querylode.llm.shingles import combined, text_buffer, word_hashes, word_spans

CHUNK, CHUNKS = 32, 3
SEGMENT = CHUNK * (CHUNKS - 1)
BLOCK = 8
K1, B = 1.2, 0.75
#: Least share of a segment's own score, and of the shingles of question and answer.
THRESHOLD, OVERLAP = 0.6, 0.5
#: Terms in more than this share of the segments are allowed for by a bound only.
COMMON = 0.1
#: Words between a part of fewer than WIDTH words and the other part's nearest shingle, at most.
WIDTH, BESIDE = 3, 16
MAX_INDEX_BYTES = 32 << 20

_ANSWER = re.compile(r"\banswers?\s*:|\ba\s*:\s", re.I)


def question_and_answer(text: str) -> tuple[str, str]:
    """At the word "answer:" if there is one, else after the last question mark, else in the middle."""
    if m := _ANSWER.search(text):
        parts = text[: m.start()], text[m.end() :]
    else:
        at = text.rfind("?") + 1
        parts = text[:at], text[at:]
    if all(p.split() for p in parts):
        return parts
    words = text.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


def hashed(texts: list[str]) -> list[np.ndarray]:
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    starts, ends, rows = word_spans(raw, offsets, signs=True)
    words = word_hashes(raw, starts, ends)
    return [words[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]


def grams(words: np.ndarray) -> np.ndarray:
    return combined(words, min(WIDTH, len(words))) if len(words) else words


def shares(words: np.ndarray, parts: list[np.ndarray], widths: list[int]) -> list[float]:
    """The share of each part's distinct shingles of its width that occur in the words; of a short part, beside the other's."""
    runs = [combined(words, w) if w else words[:0] for w in widths]
    places = [np.flatnonzero(np.isin(r, p)) for r, p in zip(runs, parts, strict=True)]
    held = []
    for k, (run, part, at) in enumerate(zip(runs, parts, places, strict=True)):
        if 0 < widths[k] < WIDTH and widths[1 - k]:
            other = places[1 - k]
            # the last that begins at or before this one, and the first that begins after it
            after = np.searchsorted(other, at, "right")
            gap = np.full((2, len(at)), BESIDE + 1)
            gap[0, after > 0] = at[after > 0] - other[after[after > 0] - 1] - widths[1 - k]
            gap[1, after < len(other)] = other[after[after < len(other)]] - at[after < len(other)] - widths[k]
            at = at[gap.min(axis=0, initial=BESIDE + 1) <= BESIDE]
        held.append(len(np.unique(run[at])) / len(part) if len(part) else 1.0)
    return held


def segments_of(words: np.ndarray) -> list[np.ndarray]:
    return np.array_split(words, max(1, -(-len(words) // SEGMENT))) if len(words) else []


class Index:
    """Impacts by term of segments and, at most, of blocks of them. told: segments, words, and each term's segments of the whole benchmark, where the items are a slice of it."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, told: tuple[int, int, dict[int, int]] | None = None):
        self.threshold = threshold
        self.items = [item_id for item_id, _ in items]
        words = hashed([text or "" for _, text in items])
        parts = [hashed(list(question_and_answer(text or ""))) for _, text in items]
        self.parts = [[np.unique(grams(p)) for p in pair] for pair in parts]
        self.widths = [[min(WIDTH, len(p)) for p in pair] for pair in parts]
        self.length = [len(w) for w in words]
        self.item_of: list[int] = []
        segments: list[np.ndarray] = []
        for i, w in enumerate(words):
            for part in segments_of(w):
                self.item_of.append(i)
                segments.append(part)
        n = len(segments)
        self.terms = np.unique(np.concatenate([*segments, np.zeros(0, np.uint64)]))
        of_all, total, held = told or (n, sum(map(len, segments)), Counter(int(t) for s in segments for t in np.unique(s)))
        mean = total / max(1, of_all)
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, s in enumerate(segments):
            terms, times = np.unique(s, return_counts=True)
            idf = np.array([math.log(1 + (of_all - held[int(t)] + 0.5) / (held[int(t)] + 0.5)) for t in terms])
            impact = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * len(s) / mean))
            for t, x in zip(np.searchsorted(self.terms, terms).tolist(), (impact / impact.sum()).tolist(), strict=True):
                postings[t].append((k, x))
        self.segment_impacts = [dict(postings[t]) for t in range(len(self.terms))]
        blocks = -(-n // BLOCK)
        slack = np.zeros(n)
        common = [held[int(t)] > max(1, COMMON * of_all) for t in self.terms]
        for t in np.flatnonzero(common).tolist():
            for k, x in postings[t]:
                slack[k] += x
        # a segment that its common terms alone may report is found by all of its terms
        whole = slack >= threshold - 1e-9
        slack[whole] = 0.0
        rows: list[list[tuple[int, float]]] = []
        for t in range(len(self.terms)):
            most: dict[int, float] = {}
            for k, x in postings[t]:
                if not common[t] or whole[k]:
                    most[k // BLOCK] = max(most.get(k // BLOCK, 0.0), x)
            rows.append(sorted(most.items()))
        self.blocks, self.n = blocks, n
        self.begin = np.cumsum([0, *map(len, rows)])
        self.block = np.array([b for r in rows for b, _ in r], np.int64)
        self.most = np.array([x for r in rows for _, x in r])
        self.needed = threshold - np.array([slack[b * BLOCK : (b + 1) * BLOCK].max() for b in range(blocks)]) - 1e-9

    def candidates(self, term: np.ndarray, chunk: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first chunk, block) of passages whose bound reaches the threshold. term: of each known word, chunk: its chunk's number, joined: for each chunk how many chunks its passage has."""
        counts = self.begin[term + 1] - self.begin[term]
        total = int(counts.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.repeat(self.begin[term] - np.cumsum(counts) + counts, counts) + np.arange(total)
        keys, where = np.unique(np.repeat(chunk, counts) * self.blocks + self.block[at], return_inverse=True)
        sums = np.bincount(where, self.most[at])
        # each chunk counts for the passages that begin there or up to two chunks before, in the same document
        c, b = np.divmod(keys, self.blocks)
        firsts, blocks, parts = [], [], []
        for back in range(CHUNKS):
            first = c - back
            ok = first >= 0
            ok[ok] &= joined[first[ok]] > back
            firsts.append(first[ok])
            blocks.append(b[ok])
            parts.append(sums[ok])
        keys, where = np.unique(np.concatenate(firsts) * self.blocks + np.concatenate(blocks), return_inverse=True)
        bound = np.bincount(where, np.concatenate(parts), minlength=len(keys))
        c, b = np.divmod(keys, self.blocks)
        held = bound >= self.needed[b]
        return c[held], b[held]

    def scores(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """Segments of the block with their scores for a passage's distinct terms, from the threshold up."""
        total = defaultdict(float)
        low, high = block * BLOCK, (block + 1) * BLOCK
        for t in terms:
            impacts = self.segment_impacts[t]
            if len(impacts) <= BLOCK:
                for k, x in impacts.items():
                    if low <= k < high:
                        total[k] += x
            else:
                for k in range(low, min(high, self.n)):
                    if x := impacts.get(k):
                        total[k] += x
        return [(k, x) for k, x in total.items() if x >= self.threshold - 1e-9]


def search(column: pa.Array, index: Index, overlap: float) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(row, item_id, score, question's and answer's overlap, passage's first word) of the best passage for each row and item it leaks."""
    raw, offsets = text_buffer(column)
    starts, ends, rows = word_spans(raw, offsets, signs=True)
    if not len(starts) or not index.n:
        return
    words = word_hashes(raw, starts, ends)
    term = np.searchsorted(index.terms, words)
    term[term == len(index.terms)] = 0
    known = np.flatnonzero(index.terms[term] == words)
    lengths = np.diff(rows)
    chunks = -(-lengths // CHUNK)
    first_chunk = np.concatenate([[0], np.cumsum(chunks)])
    row_of_word = np.repeat(np.arange(len(lengths)), lengths)
    chunk = first_chunk[row_of_word[known]] + (known - rows[row_of_word[known]]) // CHUNK
    row_of_chunk = np.repeat(np.arange(len(lengths)), chunks)
    joined = first_chunk[row_of_chunk + 1] - np.arange(first_chunk[-1])
    best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    last, terms = -1, []
    for c, block in zip(*(x.tolist() for x in index.candidates(term[known], chunk, joined)), strict=True):
        row = int(row_of_chunk[c])
        begin = int(rows[row]) + (c - int(first_chunk[row])) * CHUNK
        end = min(begin + CHUNK * CHUNKS, int(rows[row + 1]))
        if c != last:
            a, b = np.searchsorted(known, (begin, end))
            last, terms = c, np.unique(term[known[a:b]]).tolist()
        for k, score in index.scores(terms, block):
            i = index.item_of[k]
            if (row, i) in best and best[row, i][0] >= score:
                continue
            reach = max(0, index.length[i] - SEGMENT)
            near = words[max(int(rows[row]), begin - reach) : min(int(rows[row + 1]), end + reach)]
            held = shares(near, index.parts[i], index.widths[i])
            if min(held) >= overlap:
                best[row, i] = (score, held[0], held[1], begin - int(rows[row]))
    for (row, i), found in best.items():
        yield row, index.items[i], *found


DDL = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())])


def whole_counts(items: DataFrame) -> tuple[DataFrame, int, int]:
    """(slice, term, segments that hold it in the whole benchmark) of every slice's terms; the benchmark's segments and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: Counter = Counter()
            n = total = 0
            for part, words in zip(batch.column("slice").to_pylist(), hashed(batch.column("text").to_pylist()), strict=True):
                for segment in segments_of(words):
                    n, total = n + 1, total + len(segment)
                    rows.update((part, int(t)) for t in np.unique(segment).view(np.int64))
            columns = [[p for p, _ in rows] + [-1, -2], [t for _, t in rows] + [0, 0], [*rows.values(), n, total]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["slice", "term", "n"])

    found = settle(items.mapInArrow(run, "slice long, term long, n long").groupBy("slice", "term").agg(F.sum("n").alias("n")), "terms")
    sums = {r["slice"]: r["n"] for r in found.where("slice < 0").collect()}
    terms = found.where("slice >= 0")
    return settle(terms.select("slice", "term").join(terms.groupBy("term").agg(F.sum("n").alias("n")), "term"), "held"), sums.get(-1, 0), sums.get(-2, 0)


def indexes(benchmark: DataFrame, threshold: float, max_bytes: int = MAX_INDEX_BYTES) -> Iterator[Index]:
    """The benchmark's index, in as many slices as its size asks for; the driver holds one slice at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    slices = max(1, -(-size // max_bytes))
    if slices == 1:
        yield Index([(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()], threshold)
        return
    items = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    counts, n, total = whole_counts(items.select("slice", "text"))
    for k in range(slices):
        part = [(r.item_id, r.text) for r in items.where(F.col("slice") == k).orderBy("item_id", "text").collect()]
        held = counts.where(F.col("slice") == k).select("term", "n").toArrow()
        yield Index(part, threshold, (n, total, dict(zip(held["term"].to_numpy().view(np.uint64).tolist(), held["n"].to_pylist(), strict=True))))


def find_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, max_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """A row for each document and item that it leaks; one pass over the documents for each slice, no shuffle."""
    spark = documents.sparkSession
    small_batches(spark)
    docs, found = doc_text(documents), None
    for index in indexes(benchmark, threshold, max_bytes):
        told = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                if rows := [(ids[row], *x) for row, *x in search(batch.column("text"), told.value, overlap)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

        part = docs.mapInArrow(run, DDL)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaking(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of documents, all columns, that leak no item; a filter within the scan."""
    small_batches(documents.sparkSession)

    def clean_of(told):
        @F.arrow_udf("boolean")
        def clean(texts: pa.Array) -> pa.Array:
            leaks = {row for row, *_ in search(texts, told.value, overlap)}
            return pa.array([row not in leaks for row in range(len(texts))], pa.bool_())

        return clean

    kept = documents
    for index in indexes(benchmark, threshold):
        kept = kept.where(clean_of(documents.sparkSession.sparkContext.broadcast(index))(F.col("text")))
    return kept


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
