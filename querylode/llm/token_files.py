"""Token files: concatenated ids with Elias-Fano coded document boundaries.

A shard holds documents of ascending doc_id, those without one first: a fixed header, their ids one after the other (2 or 4 bytes each, as
the vocabulary needs), and two Elias-Fano sequences: the doc_ids and where each document begins and the last ends.
Such a sequence keeps the low bits of its values packed and the high bits in unary, about 2 + log2(range / count) bits a value;
the position of every 64th one bit is kept in 4 bytes, so any offset is found without a table of 64-bit
numbers.

Writers put a shard under a name of their own and report it in the manifest, a small Parquet table
that only finished tasks reach: a repeated task leaves an unlisted file behind and nothing else. Readers take
the manifest's shards, whole, or one document of them by its range of bytes alone. Files go through pyarrow's file systems (local paths, HDFS, S3, GCS) to the shared folder.

Defined results: a null or empty text is the end id alone; rows with the same doc_id follow one another, in the order of their texts' hashes and then texts, also where they are
many and lie in several tasks; rows without doc_id come before all others, in the same order; extra columns are left out; an empty table gives an empty
manifest and result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylode.llm.common import doc_text, scratch, settle, small_batches, table
from querylode.llm.tokens import encoder

MAGIC = b"QLTOKEN2"
#: magic, bytes an id, documents, those without doc_id, ids, smallest doc_id, bytes of the two sequences, crc32 of all that follows.
HEADER = struct.Struct("<8sHIIQqQQI")
#: Ids after which a writer begins a new shard.
SHARD_IDS = 1 << 23
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0 up."""

    HEAD = struct.Struct("<IBII")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        ones[high] = 1
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(ones, bitorder="little"), high[::SAMPLE].astype("<u4"))

    def tobytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, low, high = cls.HEAD.unpack_from(raw)
        at = cls.HEAD.size
        bits = np.frombuffer(raw, np.uint8)
        return cls(n, low_bits, bits[at : at + low], bits[at + low : at + low + high], np.frombuffer(raw, "<u4", offset=at + low + high))

    def _low(self, i: int) -> int:
        value = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return value

    def __getitem__(self, i: int) -> int:
        """The i-th value: its high part is the position of the i-th one, searched from the sample before."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        here = int(self.high[byte]) & (0xFF << (at & 7)) & 0xFF
        while (found := here.bit_count()) <= rest:
            rest -= found
            byte += 1
            here = int(self.high[byte])
        for _ in range(rest):
            here &= here - 1
        position = (byte << 3) + (here & -here).bit_length() - 1
        return (position - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        values = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits and self.n:
            low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            values += (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return values


class Shard:
    """A shard's bytes, read."""

    def __init__(self, raw: bytes):
        magic, width, n, nameless, ids, least, first, second, crc = HEADER.unpack_from(raw)
        if magic != MAGIC or zlib.crc32(memoryview(raw)[HEADER.size :]) != crc:
            raise ValueError("not a whole token shard")
        at = HEADER.size
        self.ids = np.frombuffer(raw, f"<u{width}", count=ids, offset=at)
        at += width * ids
        self.least, self.n, self.nameless = least, n, nameless
        self.doc_ids = EliasFano.frombytes(raw[at : at + first])
        self.bounds = EliasFano.frombytes(raw[at + first : at + first + second])

    def names(self) -> list[int | None]:
        return [None] * self.nameless + (self.doc_ids.all() + self.least).tolist()

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        return None if i < self.nameless else self.least + self.doc_ids[i - self.nameless], self.ids[self.bounds[i] : self.bounds[i + 1]]


class OpenShard:
    """A shard of which only the header, the two sequences and the documents asked for are read."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        magic, self.width, self.n, self.nameless, ids, self.least, first, second, _ = HEADER.unpack(file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size + self.width * ids
        self.doc_ids = EliasFano.frombytes(file.read_at(first, at))
        self.bounds = EliasFano.frombytes(file.read_at(second, at + first))

    def find(self, doc_id: int) -> range:
        """The places of a doc_id, by halving over what select gives."""
        edges = []
        for least in (doc_id, doc_id + 1):
            low, high = 0, self.doc_ids.n
            while low < high:
                middle = (low + high) // 2
                if self.least + self.doc_ids[middle] < least:
                    low = middle + 1
                else:
                    high = middle
            edges.append(low + self.nameless)
        return range(*edges)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds[i], self.bounds[i + 1]
        return np.frombuffer(self.file.read_at((b - a) * self.width, HEADER.size + a * self.width), f"<u{self.width}")


def shard_bytes(doc_ids: list[int | None], lens: list[int], ids: bytes, width: int) -> bytes:
    """doc_ids: those that are null first, then ascending."""
    nameless = sum(d is None for d in doc_ids)
    named = doc_ids[nameless:]
    least = named[0] if named else 0
    names = EliasFano.of(np.array(named, np.int64).astype(np.uint64) - np.uint64(least & (1 << 64) - 1)).tobytes()
    bounds = EliasFano.of(np.cumsum([0, *lens])).tobytes()
    body = b"".join((ids, names, bounds))
    return HEADER.pack(MAGIC, width, len(doc_ids), nameless, len(ids) // width, least, len(names), len(bounds), zlib.crc32(body)) + body


MANIFEST_DDL = "path string, first_doc long, first_hash long, last_doc long, turn long, n_docs long, n_ids long"
MANIFEST = pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("first_doc", "first_hash", "last_doc", "turn", "n_docs", "n_ids"))])


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("/"):
        uri = uri.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write_tokens(documents: DataFrame, folder: str, vocabulary: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes shards to the folder in ascending order of doc_id and returns the manifest: path, first_doc, first_hash, last_doc, turn, n_docs, n_ids, start (ids of all shards before)."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        coder = encoder(vocabulary)
        end, width = np.array([end_id], coder.dtype).tobytes(), coder.dtype.itemsize
        doc_ids: list[int | None] = []
        raws: list[bytes] = []
        first = 0

        def put() -> pa.RecordBatch:
            path = f"{root}/{uuid.uuid4().hex}.tok"
            ids = b"".join(raws)
            with fs.open_output_stream(path) as out:
                out.write(shard_bytes(doc_ids, [len(r) // width for r in raws], ids, width))
            row = ([path], [doc_ids[0]], [first], [doc_ids[-1]], [turn], [len(doc_ids)], [len(ids) // width])
            doc_ids.clear()
            raws.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, MANIFEST, strict=True)], schema=MANIFEST)

        size = turn = 0
        for batch in batches:
            for doc_id, hashed, raw in zip(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), coder.encode([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]), strict=True):
                if not doc_ids:
                    first = hashed
                doc_ids.append(doc_id)
                raws.append(raw + end)
                size += len(raw) // width + 1
                if size >= shard_ids:
                    yield put()
                    size, turn = 0, turn + 1
        if doc_ids:
            yield put()

    keyed = doc_text(documents).withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    ordered = keyed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")  # nulls come first
    manifest = settle(ordered.mapInArrow(run, MANIFEST_DDL), "manifest")
    # one row for each shard; rows with one doc_id and hash are never in two tasks, but may be in several shards of one, in turn
    earlier = Window.orderBy(F.col("first_doc").asc_nulls_first(), "first_hash", "turn").rowsBetween(Window.unboundedPreceding, -1)
    return settle(manifest.select("*", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("start")), "shards")


READ_DDL = "doc_id long, start long, n_tokens long, ids binary"
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """Every document of the manifest's shards: doc_id, start (ids of all documents before), n_tokens, ids (little-endian, 4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(path) as f:
                    shard = Shard(f.read())
                names, bounds = shard.names(), shard.bounds.all()
                for at in range(0, shard.n, 512):
                    ends = bounds[at : at + 513].tolist()
                    if shard.bounds[at] != ends[0] or len(shard.document(at)[1]) != ends[1] - ends[0]:
                        raise ValueError("select and the whole sequence differ")
                    blobs = [shard.ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                    columns = [names[at : at + 512], np.array(ends[:-1]) + start, np.diff(ends), blobs]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, READ, strict=True)], schema=READ)

    return shards.select("path", "start").repartition(max(1, shards.count())).mapInArrow(run, READ_DDL)  # a shard for each task


def read_document(shards: DataFrame, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of each row with a doc_id: of its shards only the sequences and the document's own bytes are read."""
    fs, _ = filesystem(folder)
    out = []
    for row in shards.where((F.coalesce("first_doc", F.lit(doc_id)) <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("start").collect():  # as many as hold it
        with fs.open_input_file(row["path"]) as file:
            shard = OpenShard(file)
            out += [shard.document(i) for i in shard.find(doc_id)]
    return out


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "token-files")
    shards = write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_tokens(shards, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
