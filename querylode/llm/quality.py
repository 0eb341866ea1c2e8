"""Quality rules: bands of zstandard compression ratios over whole documents and fixed chunks.

A text that compresses too well repeats itself; one that hardly compresses is noise (keys, base64,
shuffled symbols). How well clean prose compresses depends on its length, so each band belongs to a range of
lengths, half an octave each. A document is rejected if its whole ratio leaves its band, or if more than a
set share of its fixed chunks leave theirs. Short documents also fail the base rules.

The bands are learnt from all labelled documents, whose ratios are counted where they are; only counts of bins and single ratios come to the driver. In each range a band holds
all but a few in a thousand of the good texts, with a margin; labelled bad texts only decide whether a band's low end is worth more than the wide one that holds without labels.
Ranges with few good texts keep the wide band.

Defined results: a null or empty text has no words and fails the base rules; repeated rows
are judged alike; nothing is cut from long texts; extra columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylode.llm.common import BLANKS, CONTINUATION, doc_rows, doc_text, record_batches, settle, small_batches, table

SYMBOLS = b"#*$%&|<>"
NOT_IN_WORDS = CONTINUATION + BLANKS


@dataclass(frozen=True)
class Bands:
    """Compressed bytes per byte: texts of at least `size` bytes must lie within low and high; the last band that applies counts."""

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 2.0),
        (256, 0.46, 0.90),
        (512, 0.45, 0.78),
        (1024, 0.44, 0.70),
        (2048, 0.42, 0.64),
        (4096, 0.395, 0.61),
        (8192, 0.38, 0.58),
        (16384, 0.36, 0.55),
        (65536, 0.33, 0.53),
    )
    chunk: tuple[tuple[int, float, float], ...] = ((0, 0.0, 2.0), (1024, 0.42, 0.72), (2048, 0.40, 0.66), (4096, 0.375, 0.63))
    chunk_bytes: int = 4096
    #: The share of chunks that may leave their band.
    loose: float = 0.34
    level: int = 3

    @staticmethod
    def outside(bands: tuple[tuple[int, float, float], ...], size: int, ratio: float) -> bool:
        low, high = next((low, high) for least, low, high in reversed(bands) if size >= least)
        return not low <= ratio <= high


DEFAULT = Bands()
MIN_WORDS = 50
#: Good texts that a range needs.
FEWEST = 100
#: Labels that may be broadcast, so that only labelled texts are measured. With more of them all texts are, and the numbers are dealt by doc_id.
BROADCAST = 1_000_000
#: Where ranges of lengths begin, half an octave each: from 256 bytes to 16 MB, where the last ends.
EDGES = tuple(round(2 ** (step / 2)) for step in range(16, 49))
#: Bins of ratios for each unit: a power of two, so that bins are exact.
BINS = 4096
#: The share of good texts that may lie beyond either end of a band, and how far an end moves out from there.
BEYOND, MARGIN = 0.002, 0.008
#: How much further chunks may lie from the band of texts of their length: they begin and end anywhere.
CHUNK_MARGIN = 0.012


def learn_bands(documents: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int | None = None, wide: Bands = DEFAULT, broadcast: int = BROADCAST) -> Bands:
    """Bands from labels (doc_id, quality: 1 for good) of the rows that `allowed` (a condition on doc_id) lets in: all of them, or `sample` by a hash. Null, unknown or no labels teach nothing."""
    spark = documents.sparkSession
    small_batches(spark)
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    if allowed is not None:
        told = told.where(allowed)
    told = told.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if sample is not None:
        told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    told = settle(told, "labels")
    texts = doc_text(documents)
    few = told.count() <= broadcast
    if few:
        texts = texts.join(F.broadcast(told.select("doc_id")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=wide.level, write_content_size=False, write_checksum=False)
        schema = pa.schema([("doc_id", pa.int64()), ("range", pa.int32()), ("ratio", pa.float64())])
        for batch in batches:
            rows = []
            for doc_id, text in doc_rows(batch):
                if not base_failed(text.split()):
                    rows.append((doc_id, bisect_right(EDGES, len(text)) - 1, len(packer.compress(text)) / len(text)))
            yield from record_batches(rows, schema)

    measured = texts.mapInArrow(run, "doc_id long, range int, ratio double").join(F.broadcast(told) if few else told, "doc_id")
    counted = settle(measured.groupBy("range", (F.col("quality") == 1).alias("good"), "ratio").agg(F.count("*").alias("n")), "ratios")
    return fit_bands(counted, wide)


def fit_bands(counted: DataFrame, wide: Bands = DEFAULT) -> Bands:
    """Bands from how often each ratio occurs: range, ratio, good, n."""
    bad = F.when(~F.col("good"), F.col("ratio"))
    totals = {r.range: r for r in counted.groupBy("range").agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.min(bad).alias("least"), F.max(bad).alias("most")).collect()}
    if not totals:
        return wide
    ends = quantiles(counted.where("good"), {k: r.good for k, r in totals.items() if 0 <= k < len(EDGES) - 1 and r.good >= FEWEST}, (BEYOND, 1 - BEYOND))
    found = []
    for k, least in enumerate(EDGES[:-1]):
        low, high = next((low, high) for size, low, high in reversed(wide.whole) if least >= size)
        if k in ends:
            learnt_low, learnt_high = ends[k][0] - MARGIN, ends[k][1] + MARGIN
            if totals[k].least is not None and totals[k].least < learnt_low:
                low = learnt_low
            if totals[k].most is not None and totals[k].most > learnt_high:
                high = learnt_high
            # no band is narrower than the good texts that it was learnt from allow
            low, high = min(low, learnt_low), max(high, learnt_high)
        found.append((least, low, high))
    whole = ((0, *wide.whole[0][1:]), *found)
    chunk = (*((size, low - CHUNK_MARGIN, high + CHUNK_MARGIN) for size, low, high in whole if size <= 2 * wide.chunk_bytes),)
    return replace(wide, whole=whole, chunk=chunk)


def quantiles(counted: DataFrame, totals: dict[int, int], shares: tuple[float, ...]) -> dict[int, list[float]]:
    """Exact quantiles, as numpy's, of the ratios of each range: range, ratio, n, and how many there are. Counts of bins tell which bins hold the ratios that are wanted; only those are put in order."""
    if not totals:
        return {}
    places = {(k, share): divmod((n - 1) * share, 1) for k, n in totals.items() for share in shares}
    ranks = {(k, min(int(at) + i, totals[k] - 1)) for (k, _), (at, _) in places.items() for i in (0, 1)}
    binned = counted.where(F.col("range").isin(*totals)).withColumn("bin", F.floor(F.col("ratio") * BINS))
    bins = defaultdict(list)
    for r in binned.groupBy("range", "bin").agg(F.sum("n").alias("n")).collect():
        bins[r.range].append((r.bin, r.n))
    wanted = []
    for k, held in bins.items():
        here, before = sorted(rank for of, rank in ranks if of == k), 0
        for at, n in sorted(held):
            wanted += [(k, at, rank, before) for rank in here if before <= rank < before + n]
            before += n
    spark = counted.sparkSession
    rows = F.broadcast(spark.createDataFrame(wanted, "range int, bin long, rank long, before long"))
    upto = F.sum("n").over(Window.partitionBy("range", "bin").orderBy("ratio"))
    ordered = binned.join(rows.select("range", "bin").distinct(), ["range", "bin"]).withColumn("upto", upto).join(rows, ["range", "bin"])
    ratio = {(r.range, r.rank): r.ratio for r in ordered.where("rank < before + upto AND rank >= before + upto - n").select("range", "rank", "ratio").collect()}
    between = lambda k, at, rest: float(np.quantile([ratio[k, int(at)], ratio[k, min(int(at) + 1, totals[k] - 1)]], rest))
    return {k: [between(k, *places[k, share]) for share in shares] for k in totals}


def repeats(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0  # covered: the words before this index are counted
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


def base_failed(words: list[bytes], again: int | None = None) -> bool:
    return len(words) < MIN_WORDS or 100 * (repeats(words) if again is None else again) > 50 * len(words)


def duplicate_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    held = [line for line in lines if line.strip(BLANKS)]
    return len(held) - len(set(held))


def ratios(text: bytes, packer: zstandard.ZstdCompressor, bands: Bands) -> tuple[float, int, int]:
    """The whole text's ratio, how many chunks it has and how many of them leave their band. A last chunk of less than half the length joins the one before."""
    size = len(text)
    if not size:
        return 0.0, 0, 0
    whole = len(packer.compress(text)) / size
    n = max(1, (size + bands.chunk_bytes // 2) // bands.chunk_bytes)
    if n == 1:
        return whole, 1, int(Bands.outside(bands.chunk, size, whole))
    view, bad = memoryview(text), 0
    for k in range(n):
        part = view[k * bands.chunk_bytes : size if k == n - 1 else (k + 1) * bands.chunk_bytes]
        bad += Bands.outside(bands.chunk, len(part), len(packer.compress(part)) / len(part))
    return whole, n, bad


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("whole_ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64())]
)
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, whole_ratio double, n_chunks long, n_bad_chunks long"


def measure(doc_id: int, text: bytes, packer: zstandard.ZstdCompressor, bands: Bands) -> tuple:
    words = text.split()
    n, again = len(words), repeats(words)
    whole, chunks, bad = ratios(text, packer, bands)
    failed = base_failed(words, again)
    kept = not failed and not Bands.outside(bands.whole, len(text), whole) and bad <= bands.loose * chunks
    chars = len(text.translate(None, NOT_IN_WORDS))
    return doc_id, n, chars, len(text) - len(text.translate(None, SYMBOLS)), duplicate_lines(text), again, failed, kept, whole, chunks, bad


def judge(docs: DataFrame, bands: Bands = DEFAULT) -> DataFrame:
    """The measures and verdict of every row of docs; one pass, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        for batch in batches:
            yield from record_batches((measure(i, text, packer, bands) for i, text in doc_rows(batch)), SCHEMA)

    return doc_text(docs).mapInArrow(run, DDL)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return judge(documents, learn_bands(documents, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"))))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels teach nothing, so that they can tell how well the bands do."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def keep_good(docs: DataFrame, bands: Bands = DEFAULT) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is kept; a filter within the scan, so no join by an id that may repeat."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        return pd.Series([measure(0, (t or "").encode(), packer, bands)[7] for t in texts], dtype=bool)

    return docs.where(kept(F.col("text")))
