"""SQL files and inline statements as records."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylode.functions.text import fingerprint
from querylode.plans.lexer import STATES, effects, pieces, statements
from querylode.scratch import settled

RECORDS = ("fingerprint", "sql", "file", "line", "record_ord", "statement_id", "namespace", "occurrences", "total_query_time", "max_rows_examined", "query_time", "lock_time", "rows_sent", "rows_examined", "notes", "raw_interpolation")


def as_records(df: DataFrame) -> DataFrame:
    """Every column that records have, null where this input has none."""
    kinds = {"line": "int", "record_ord": "long", "occurrences": "long", "max_rows_examined": "long", "rows_sent": "long", "rows_examined": "long", "total_query_time": "decimal(38,6)", "query_time": "decimal(18,6)", "lock_time": "decimal(18,6)", "notes": "array<string>", "raw_interpolation": "boolean"}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in RECORDS])


SPLIT = pa.list_(pa.struct([("sql", pa.string()), ("line", pa.int32())]))


def _split(texts: pa.Array) -> pa.Array:
    return pa.array([[{"sql": sql, "line": line} for sql, line in statements(text or "")] for text in texts.to_pylist()], SPLIT)


def records_from_texts(texts: DataFrame) -> DataFrame:
    """Columns file, value: a record for each statement between `;` outside quotes, comments and parentheses."""
    split = F.arrow_udf(_split, "array<struct<sql:string,line:int>>")
    spread = texts.select("file", F.posexplode(split("value")).alias("pos", "s"))
    return _records(spread.select("file", F.col("s.sql").alias("sql"), F.col("s.line").alias("line"), F.col("pos").alias("record_ord")))


def _records(found: DataFrame) -> DataFrame:
    return as_records(found.select("file", "sql", "line", "record_ord", fingerprint("sql").alias("fingerprint"), F.lit(1).alias("occurrences")))


#: Characters of a chunk: whole lines, so one long line may be more.
CHUNK = 1 << 20
CHUNKS = "file string, at long, value string, lines long, effects array<struct<state:string,a:long,b:long>>"
#: kind: where in its chunk a part lies. A head goes up to the first `;`, or to the chunk's end if there is none (cut tells), and holds how many whole statements follow it and if a tail does.
PARTS = "file string, at long, kind int, pos long, line long, skip long, sql string, cut boolean, tail boolean"
HEAD, WHOLE, TAIL = 0, 1, 2


def _tables(rows: Iterator[tuple], names: tuple[str, ...], kinds: list[pa.DataType], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most so many characters, or one row."""
    schema, held, size = pa.schema(list(zip(names, kinds, strict=True))), [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        size += 64 + sum(len(value) for value in row if isinstance(value, str))
        if size >= most:
            yield make()
            held, size = [], 0
    if held:
        yield make()


def _chunks(size: int):
    """The lines of a file's blocks as chunks, each with its number of lines and what it does to quotes, comments and parentheses that are open where it begins.

    A chunk's place is its block's first byte and its number in the block: as no chunk is empty, places grow through the file.
    """
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("state", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        block, n, held, length = None, 0, [], 0

        def chunk() -> tuple:
            text = "".join(held)
            return block[0], block[1] + n, text, len(held), [dict(zip(("state", "a", "b"), e, strict=True)) for e in effects(text)]

        for batch in batches:
            for place, lines in _by_block(batch):
                if place != block:
                    if held:
                        yield chunk()
                    block, n, held, length = place, 0, [], 0
                for line in lines:
                    held.append(line + "\n")
                    length += len(line) + 1
                    if length >= size:
                        yield chunk()
                        n, held, length = n + 1, [], 0
        if held:
            yield chunk()

    return lambda batches: _tables(rows(batches), ("file", "at", "value", "lines", "effects"), kinds)


def _by_block(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """((file, block), lines) in a batch, whose rows of one block are neighbours."""
    file, block, lines = batch.column("file"), batch.column("block"), batch.column("value")
    begins = 0
    while begins < len(batch):
        place = file[begins].as_py(), block[begins].as_py()
        ends = len(batch)
        if (file[ends - 1].as_py(), block[ends - 1].as_py()) != place:
            here = pc.and_(pc.equal(file.slice(begins), place[0]), pc.equal(block.slice(begins), place[1]))
            ends = begins + pc.index(here, False).as_py()
        yield place, lines.slice(begins, ends - begins).to_pylist()
        begins = ends


def _in_order(rows: pa.Table) -> list[dict]:
    return sorted(rows.to_pylist(), key=itemgetter("at"))


def _openings(rows: pa.Table) -> pa.Table:
    """What is open where each chunk of a file begins, and its first line's number."""
    state, depth, line, out = "", 0, 1, []
    for row in _in_order(rows):
        out.append({"file": row["file"], "at": row["at"], "state": state, "depth": depth, "first_line": line})
        effect = row["effects"][STATES.index(state)]
        state, depth, line = effect["state"], max(depth + effect["a"], effect["b"]), line + row["lines"]
    return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("at", pa.int64()), ("state", pa.string()), ("depth", pa.int64()), ("first_line", pa.int64())]))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The statements of chunks: whole ones, and what belongs to one that other chunks begin or end."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                file, at, text = row["file"], row["at"], row["value"]
                head, *more = pieces(text, row["state"], row["depth"])
                tail = more.pop() if more else None
                whole = [p for p in more if p.begin is not None]
                has_tail = tail is not None and tail.begin is not None
                line, counted = row["first_line"], 0

                def line_of(begin: int) -> int:
                    nonlocal line, counted
                    line, counted = line + text.count("\n", counted, begin), begin
                    return line

                skip = -1 if head.begin is None else head.begin
                yield file, at, HEAD, len(whole), line_of(max(skip, 0)), skip, text[: head.end], tail is not None, has_tail
                for i, p in enumerate(whole):
                    yield file, at, WHOLE, i, line_of(p.begin), 0, text[p.begin : p.end].strip(), True, False
                if has_tail:
                    yield file, at, TAIL, 0, line_of(tail.begin), 0, text[tail.begin :], True, True

    yield from _tables(rows(), ("file", "at", "kind", "pos", "line", "skip", "sql", "cut", "tail"), [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()])


def _ordinals(heads: pa.Table) -> pa.Table:
    """For each chunk of a file how many statements come before the one that its head belongs to, its first whole one, and its tail."""
    opened, begun, out = 0, False, []
    for row in _in_order(heads):
        head, begun = opened, begun or row["skip"] >= 0
        first = head + begun
        if row["cut"]:
            opened, begun = first + row["pos"], row["tail"]
        out.append({"file": row["file"], "at": row["at"], "head_ord": head, "whole_ord": first, "tail_ord": opened})
    return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("at", "head_ord", "whole_ord", "tail_ord"))]))


def _joined(parts: pa.Table) -> pa.Table:
    """One statement of its parts; what comes before its first token is none of it."""
    rows = sorted(parts.to_pylist(), key=itemgetter("at", "kind"))
    first = next((i for i, row in enumerate(rows) if row["skip"] >= 0), None)
    out = []
    if first is not None:
        begin, *rest = rows[first:]
        sql = begin["sql"][begin["skip"] :] + "".join(row["sql"] for row in rest)
        out.append({"file": begin["file"], "sql": sql.strip(), "line": begin["line"], "record_ord": begin["record_ord"]})
    return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("sql", pa.string()), ("line", pa.int64()), ("record_ord", pa.int64())]))


def read_sql_files(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Records of a file, or of all files in a folder. A file of any size is read by many tasks, of which none holds more than a chunk of lines or a statement.

    What is open where a chunk begins (a quote, a comment, parentheses) follows from what each chunk before does to it, one small row a chunk.
    Chunks are written out first, so that all steps have the same.
    """
    lines = spark.read.format("text").option("lineSep", "\n").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    chunks = settled(lines.mapInArrow(_chunks(chunk), CHUNKS), "sql-chunks")
    openings = chunks.select("file", "at", "lines", "effects").groupBy("file").applyInArrow(_openings, "file string, at long, state string, depth long, first_line long")
    texts = chunks.select("file", "at", "value").join(F.broadcast(openings), ["file", "at"])
    parts = settled(texts.mapInArrow(_parts, PARTS), "sql-parts")
    heads = parts.where(F.col("kind") == HEAD).select("file", "at", "pos", "skip", "cut", "tail")
    ordinals = heads.groupBy("file").applyInArrow(_ordinals, "file string, at long, head_ord long, whole_ord long, tail_ord long")
    placed = parts.select("file", "at", "kind", "pos", "line", "skip", "sql").join(F.broadcast(ordinals), ["file", "at"])
    whole = placed.where(F.col("kind") == WHOLE).select("file", "sql", "line", (F.col("whole_ord") + F.col("pos")).alias("record_ord"))
    open_parts = placed.where(F.col("kind") != WHOLE).select("file", "at", "kind", "line", "skip", "sql", F.when(F.col("kind") == HEAD, F.col("head_ord")).otherwise(F.col("tail_ord")).alias("record_ord"))
    joined = open_parts.groupBy("file", "record_ord").applyInArrow(_joined, "file string, sql string, line long, record_ord long")
    return _records(whole.unionByName(joined))


def inline_sql(spark: SparkSession, text: str) -> DataFrame:
    return records_from_texts(spark.createDataFrame([(None, text)], "file string, value string"))
