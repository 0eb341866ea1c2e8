"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an insert adds a document's count, a delete takes
it off, a revision does both. A batch of deltas is aggregated first, so what is kept is a few rows for each
batch, and totals() only adds those up. A batch is committed once: its rows and then its marker are written under names of their own, and the
marker is renamed to the batch's, which fails if there is one; a batch that is sent again, or whose writer was lost at any point before, changes nothing.
compact() folds committed batches into one. It first claims each batch for the fold, which only one fold can; a batch no longer counts once the fold that claimed it is
committed, so folds at the same time take different batches, and one that is lost leaves its batches as they were.

Defined results: a null text counts as empty (no tokens, one document); null sources and languages are keys of
their own; rows with the same doc_id count each; extra columns stay beside the counts, but one with a count's name gives way to it; empty batches commit and
change nothing; keys whose documents and tokens are all taken off again stay with zeros; an empty table gives no totals.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylode.llm.common import scratch, settle, small_batches, table
from querylode.llm.tokens import encoder

KEYS = ("source", "lang", "version")
DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"


def token_counts(documents: DataFrame, vocabularies: dict[str, str], texts: dict[str, str] | None = None) -> DataFrame:
    """The rows of documents with <prefix><version> for each vocabulary and text column (by default n_<version> of text); all columns stay, but the texts."""
    texts = texts or {"text": "n_"}
    small_batches(documents.sparkSession)
    made = [f"{prefix}{version}" for prefix in texts.values() for version in vocabularies]
    taken = {x.lower() for x in (*made, *texts)}
    stay = [c for c in documents.columns if c.lower() not in taken]
    kept = documents.select(*[F.col(f"`{c}`") for c in stay], *[F.col(f"`{c}`").cast("string").alias(f"_text_{i}") for i, c in enumerate(texts)])
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(stay)]), *(f"`{m}` bigint" for m in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [encoder(p) for p in vocabularies.values()]
        for batch in batches:
            columns = list(batch.columns[: len(stay)])
            for column in batch.columns[len(stay) :]:
                whole = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
                columns += [pa.array(coder.counts(whole)) for coder in coders]
            yield pa.RecordBatch.from_arrays(columns, [*stay, *made])

    return kept.mapInArrow(run, out)


def signed(counts: DataFrame, version: str, sign: int, column: str | None = None, times: str | None = None) -> DataFrame:
    """The deltas of inserting (1) or deleting (-1) the counted documents; times: a column with how many documents a row stands for. Partial sums come before the exchange, so a hot source costs no more than others."""
    n, many = F.col(f"`{column or f'n_{version}'}`"), F.col(times) if times else F.lit(1)
    return counts.groupBy("source", "lang").agg((F.sum(many) * sign).alias("n_docs"), (F.sum(n * many) * sign).alias("n_tokens")).select("source", "lang", F.lit(version).alias("version"), "n_docs", "n_tokens")


def revised(before: DataFrame, after: DataFrame, version: str) -> DataFrame:
    return signed(before, version, -1).unionByName(signed(after, version, 1))


class Ledger:
    """Committed batches of deltas in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        path = self._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path, path.getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, *parts: str) -> str:
        path, fs = self._path(*parts)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, content: str, *parts: str) -> bool:
        """Writes a small file whole or not at all; False if it is there already."""
        hadoop = self._jvm.org.apache.hadoop.fs
        last, fs = self._path(*parts)
        first, _ = self._path("unfinished", uuid.uuid4().hex)
        stream = fs.create(first, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        fs.mkdirs(last.getParent())
        keep = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        keep[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            hadoop.FileContext.getFileContext(first.toUri(), self._conf).rename(first, last, keep)
        except Exception:
            if not fs.exists(last):
                raise
            fs.delete(first, False)
            return False  # another writer was first
        return True

    def live(self) -> list[str]:
        """Batches that count: all committed ones but those that a committed fold has claimed."""
        claimed = self._names("claimed")  # read before the committed ones: a fold that comes between finds its batches counted once, by themselves
        committed = self._names("committed")
        folded = {m for m in claimed if m in committed and self._read("claimed", m) in committed}
        return [m for m in committed if m not in folded]

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch; False, and no change, if it is there already."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError("a batch is named by letters, digits, - and _")
        marker, fs = self._path("committed", batch)
        if fs.exists(marker):
            return False
        data = f"data/{batch}-{uuid.uuid4().hex}"
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.parquet(f"{self.folder}/{data}")
        return self._put(json.dumps({"data": data}), "committed", batch)

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """source, lang, version, n_docs, n_tokens over all live batches, or those named."""
        paths = [f"{self.folder}/{json.loads(self._read('committed', m))['data']}" for m in (self.live() if batches is None else batches)]
        if not paths:
            return self.spark.createDataFrame([], DELTAS)
        return self.spark.read.schema(DELTAS).parquet(*paths).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> str | None:
        """Folds the live batches that no other fold has claimed into one, which is committed as a batch itself."""
        name = f"fold-{uuid.uuid4().hex}"
        taken = self._names("claimed")
        free = [m for m in self.live() if m not in taken]
        if len(free) < 2:
            return None
        mine = [m for m in free if self._put(name, "claimed", m)]
        if not mine:
            return None
        self.commit(name, self.totals(mine))
        return name


def without_copies(counts: DataFrame, columns: list[str]) -> DataFrame:
    """digest, source, lang, the columns (equal where the digest is), stay and gone: how many documents keep a text (those of its smallest doc_id) and how many others repeat it.

    Rows are summed by all keys and the doc_id, and then by all keys, before a digest's come together, so one with a third of all rows has as many rows there as it has sources and languages.
    """
    values = [F.first(f"`{c}`").alias(c) for c in columns]
    each = counts.groupBy("digest", "source", "lang", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id")).agg(F.count("*").alias("rows"), *values)
    groups = each.groupBy("digest", "source", "lang").agg(F.min(F.struct("id", "rows")).alias("least"), F.sum("rows").alias("rows"), *values)
    groups = settle(groups, "groups")
    firsts = groups.groupBy("digest").agg(F.min("least.id").alias("first"))
    stay = F.when(F.col("least.id") == F.col("first"), F.col("least.rows")).otherwise(0)
    return groups.join(firsts, "digest").select("digest", "source", "lang", *[f"`{c}`" for c in columns], stay.alias("stay"), (F.col("rows") - stay).alias("gone"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a corpus after four batches: all documents counted by two vocabularies, exact copies deleted (those of the smallest doc_id stay; a null doc_id comes last), and the rest revised to their texts without repeated lines. The first batch is sent twice."""
    import public_tokenizers

    vocabularies = {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.json"), "word_bpe_49k": public_tokenizers.path("word_bpe_49k.json")}
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("text").cast("string").alias("text"))
    unique_lines = F.array_join(F.array_distinct(F.split(F.col("text"), "\n")), "\n")
    rows = docs.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).withColumn("shorter", F.when(unique_lines != F.col("text"), unique_lines)).withColumn("revised", F.col("shorter").isNotNull())
    counts = settle(token_counts(rows, vocabularies, {"text": "n_", "shorter": "s_"}), "counts")
    groups = settle(without_copies(counts, ["revised", *(f"{p}_{v}" for p in "ns" for v in vocabularies)]), "copies")
    ledger = Ledger(spark, scratch(spark, "token-ledger"))
    for version in vocabularies:
        inserted = signed(counts, version, 1)
        ledger.commit(f"insert-{version}", inserted)
        ledger.commit(f"insert-{version}", inserted)
        ledger.commit(f"copies-{version}", signed(groups.where("gone > 0"), version, -1, times="gone"))
        kept = groups.where("revised AND stay > 0")
        ledger.commit(f"lines-{version}", signed(kept, version, -1, times="stay").unionByName(signed(kept, version, 1, f"s_{version}", "stay")))
    return ledger.totals()
