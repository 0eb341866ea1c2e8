"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of lexicon words (a fixed list, and words and word beginnings learnt from labels),
how many of them stand near the second person, and shares of capitals, exclamation, repeated signs and obfuscated
words. Labels are learnt from a sample of at most SAMPLE labelled rows, taken in the order of a hash of doc_id and dealt into three
parts: one for the lexicon, one for the trees, one for the calibration. Then every text is scored in one pass without a shuffle.

Defined results: a null or empty text gets the score of features that are all zero; rows with the same doc_id are scored
each; of several labels of a doc_id the largest counts; null labels are left out; with no labels at all, or of one kind only, the score is the
base rate; long texts are read whole; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylode.llm import boosting
from querylode.llm.common import doc_text, settle, small_batches, table
from querylode.llm.shingles import text_buffer, word_hashes, word_spans

#: The most labelled rows that are learnt from.
SAMPLE = 20_000
#: The most learnt lexicon entries of each length, and how often one must occur at least in toxic texts.
ENTRIES, LEAST = 2000, 5
#: Bytes of a word's beginning that are looked up too.
STEMS = (4, 5, 6)
NEAR = 4

#: Fixed words.
LEXICON = "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown dumb fool ugly garbage filth filthy vermin freak creep jerk bastard bitch whore slut damn hell shit fuck fucking asshole crap hate kill die retard imbecile pig rat coward liar shut".split()
SECOND_PERSON = "you your yours you're u ur yourself du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes tú ti vosotros".split()


def hashes(words: list[str]) -> np.ndarray:
    raw, offsets = text_buffer(pa.array(words, pa.string()))
    starts, ends, _ = word_spans(raw, offsets, signs=True)
    return np.unique(word_hashes(raw, starts, ends))


FIXED, PERSONS = hashes(LEXICON), hashes(SECOND_PERSON)
NAMES = ("log_words", "fixed_density", "fixed_count", "learnt_density", "learnt_count", "learnt_weight", "learnt_most", "stem_density", "stem_count", "stem_most", "near_person", "person_density", "capitals", "capital_words", "exclaims", "questions", "repeated_signs", "obfuscated", "sign_share", "digit_share", "mean_word")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SIGN = ~(_LETTER | _DIGIT | _BLANK)


@dataclass(frozen=True)
class Lexicon:
    """Learnt hashes, sorted, with log-odds: whole words, and word beginnings of each length of STEMS."""

    words: np.ndarray
    weights: np.ndarray
    stems: tuple[tuple[np.ndarray, np.ndarray], ...]


def weights_of(found: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(found))
    at = np.searchsorted(known, found)
    at[at == len(known)] = 0
    return np.where(known[at] == found, weights[at], 0.0)


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of features for each text."""
    raw, offsets = text_buffer(column)
    starts, ends, rows = word_spans(raw, offsets, signs=True)
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)), np.float64)
    if not len(raw):
        return out
    size, words = np.maximum(np.diff(offsets), 1), np.maximum(np.diff(rows), 1)
    sums = lambda values, edges: np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[edges])

    def most(values: np.ndarray) -> np.ndarray:
        top = np.zeros(n)
        held = np.flatnonzero(values)
        np.maximum.at(top, np.searchsorted(rows, held, side="right") - 1, values[held])
        return top

    hashed = word_hashes(raw, starts, ends)
    learnt = weights_of(hashed, lexicon.words, lexicon.weights)
    stem = np.zeros(len(hashed))
    for length, (known, weights) in zip(STEMS, lexicon.stems, strict=True):
        long = np.flatnonzero(ends - starts > length)
        if len(long) and len(known):
            stem[long] = np.maximum(stem[long], weights_of(word_hashes(raw, starts[long], starts[long] + length), known, weights))
    fixed = np.isin(hashed, FIXED)
    hits = fixed | (learnt > 0) | (stem > 0)
    person = np.isin(hashed, PERSONS)
    reach = np.concatenate([[0], np.cumsum(person)])
    row = np.searchsorted(rows, np.arange(len(hashed)), side="right") - 1
    i = np.arange(len(hashed))
    low, high = np.maximum(i - NEAR, rows[row]), np.minimum(i + NEAR + 1, rows[row + 1])
    near = hits & (reach[high] > reach[low])
    byte = raw
    upper, sign = _UPPER[byte], _SIGN[byte]
    inner = np.zeros(len(raw), bool)  # a sign or digit between letters of one word
    if len(raw) > 2:
        inner[1:-1] = (sign[1:-1] & (byte[1:-1] != 39) & (byte[1:-1] != 45) | _DIGIT[byte[1:-1]]) & _LETTER[byte[:-2]] & _LETTER[byte[2:]]
    twice = np.zeros(len(raw), bool)
    twice[1:] = sign[1:] & (byte[1:] == byte[:-1])
    capitals = np.concatenate([[0], np.cumsum(upper)])
    shouted = (capitals[ends] - capitals[starts] == ends - starts) & (ends - starts > 1)
    columns = [
        np.log1p(np.diff(rows)), sums(fixed, rows) / words, sums(fixed, rows), sums(learnt > 0, rows) / words, sums(learnt > 0, rows), sums(learnt, rows) / words, most(learnt),
        sums(stem > 0, rows) / words, sums(stem > 0, rows), most(stem), sums(near, rows), sums(person, rows) / words, sums(upper, offsets) / size, sums(shouted, rows) / words,
        sums(byte == 33, offsets) / size, sums(byte == 63, offsets) / size, sums(twice, offsets) / size, sums(inner, offsets) / words, sums(sign, offsets) / size, sums(_DIGIT[byte], offsets) / size, sums(_LETTER[byte], offsets) / words,
    ]
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    booster: boosting.Booster
    isotonic: boosting.Isotonic

    def scores(self, column: pa.Array) -> np.ndarray:
        return np.clip(self.isotonic(self.booster.logits(features(column, self.lexicon))), 0.0, 1.0)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and beginnings that toxic texts hold much more often than others: at least 8 times as likely, by documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            starts, ends, rows = word_spans(raw, offsets, signs=True)
            toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
            row = np.repeat(np.arange(len(toxic)), np.diff(rows))
            for length in (0, *STEMS):
                held = np.flatnonzero(ends - starts > length)
                if not len(held):
                    continue
                hashed = word_hashes(raw, starts[held], starts[held] + length if length else ends[held])
                order = np.lexsort((row[held], hashed))
                h, r = hashed[order], row[held][order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                keys, where = np.unique(h[first], return_inverse=True)
                bad = np.bincount(where, toxic[r[first]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), length, np.int32)), pa.array(keys.view(np.int64)), pa.array(bad.astype(np.int64)), pa.array((np.bincount(where) - bad).astype(np.int64))], ["length", "hash", "bad", "good"])

    counts = sample.select("text", "toxic").mapInArrow(run, "length int, hash long, bad long, good long").groupBy("length", "hash").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count("*").alias("all")).first()
    odds = F.log(((F.col("bad") + 0.5) / (n["bad"] + 1.0)) / ((F.col("good") + 0.5) / (n["all"] - n["bad"] + 1.0)))
    told = counts.where(F.col("bad") >= LEAST).withColumn("weight", odds).where(F.col("weight") >= float(np.log(8)))
    parts = []
    for length in (0, *STEMS):
        best = told.where(F.col("length") == length).orderBy(F.desc("weight"), F.desc("bad"), "hash").limit(ENTRIES).select("hash", "weight").toArrow()
        keys, weights = best["hash"].to_numpy().view(np.uint64), best["weight"].to_numpy()
        order = np.argsort(keys)
        parts.append((keys[order], weights[order]))
    return Lexicon(*parts[0], tuple(parts[1:]))


def train(documents: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learns from labels (doc_id, toxic) of the rows that `allowed` (a condition on doc_id) lets in."""
    spark = documents.sparkSession
    small_batches(spark)
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if allowed is not None:
        told = told.where(allowed)
    # at most `sample` rows of two numbers each, so it can be broadcast at any size of the input
    picked = told.groupBy("doc_id").agg(F.least(F.max("toxic"), F.lit(1)).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # one row for each doc_id, however often it occurs
    one = doc_text(documents).join(F.broadcast(settle(picked, "labels")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = settle(one.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5))), "sample")
    lexicon = learn_lexicon(rows.where("part < 2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"), lexicon)
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("toxic"), values], ["doc_id", "part", "toxic", "x"])

    seen = rows.where("part >= 2").select("doc_id", "part", "toxic", "text").mapInArrow(run, "doc_id long, part long, toxic int, x array<double>").orderBy("doc_id", "x").toArrow()
    x = np.array(seen["x"].to_pylist(), np.float64).reshape(-1, len(NAMES))
    y, part = seen["toxic"].to_numpy().astype(np.float64), seen["part"].to_numpy()
    booster = boosting.fit(x[part < 4], y[part < 4])
    return Model(lexicon, booster, boosting.calibrate(booster.logits(x[part == 4]), y[part == 4]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    small_batches(documents.sparkSession)
    told = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(told.value.scores(batch.column("text")))], ["doc_id", "score"])

    return doc_text(documents).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
