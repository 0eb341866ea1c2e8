"""What the text operators share: scratch space, Arrow batches, hashing of words."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's word: a run of anything but these six ASCII blanks, which is what bytes.split() splits on.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes that continue a UTF-8 character; deleting them leaves one byte for each code point.
CONTINUATION = bytes(range(0x80, 0xC0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder: spark.checkpoint.dir, or below the warehouse where that is unset and driver and executors are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there, and a lost executor costs no recomputation above it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Deletes what settle() wrote for df, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner see which shuffles and broadcasts nothing refers to any more, so their files go before the query ends."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Texts can be long, so an Arrow batch holds at most so many bytes (or one row); how many rows of other queries go in a batch stays as it is, and so does a smaller setting of the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > size:
        spark.conf.set(key, str(size))


def doc_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """(doc_id, UTF-8 of the text; a null text is empty) of a batch with columns doc_id and text."""
    ids = batch.column("doc_id").to_pylist()
    for doc_id, text in zip(ids, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
        yield doc_id, text or b""


def doc_text(df: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator needs, so the scan prunes the rest and clashing extra columns don't matter."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def record_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Memo(dict):
    """A dictionary that fills itself from a function, and starts anew at a bound so that a worker's memory stays bounded."""

    def __init__(self, function, bound: int = 400_000):
        super().__init__()
        self.function, self.bound = function, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.function(key)
        return value
