"""Mixture-controlled packing by deficit round-robin over the sources' queues.

Documents become token ids with an end id and are dealt into one long stream, cut into sequences of `window` tokens, so
only the very last sequence can need padding. The order in the stream follows target shares of the sources: for each
window every source with tokens left is credited its share of the room, the source with the most credit sends next, and
what it sends is taken off. Credit left over, or overdrawn, carries to the next window.

A source is one queue over the whole table: a token's place in it is what the source has before, in earlier tasks and earlier in its own (sums over the tasks).
What each source has sent when the stream is so long follows from the shares and the queues' lengths alone: it rises by its share until a source runs dry, whose share
then goes to the others, up to the last (Schedule). So the stream is dealt in lots of about `block` tokens, each from the ranges of the queues that
the schedule gives it, wherever in the table they lie: rows go to their lots in one exchange, and a lot carries in as deficit what rounding has left. No lot is larger than
another, however unlike the sources or the partitions are.

Without given targets a source's share is its part of all tokens. Sources without a target come when those with one are dry, in equal shares. Every document is packed whole, cut where windows, turns and lots
end. The order of a queue is that of the table's partitions, so another layout of the same rows gives other sequences of the same mixture.

Defined results: a null text is empty, and an empty text is the end id alone; a null source is a queue of its own
name ""; a row with a null or repeated doc_id is packed like any other; extra columns are left out; an empty table
gives an empty result. Sources are names of queues: the driver and each task hold a few numbers for each.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylode.llm.common import doc_text, settle, small_batches, table
from querylode.llm.tokens import encoder

WINDOW = 1024
#: Tokens of a block of encoded documents, and of a lot of the stream, about.
BLOCK = 1 << 18
#: The least that a source sends in its turn, if it has as much, so that documents aren't cut to crumbs.
TURN = 128
BLOCK_DDL = "part int, before long, sent map<string,long>, own map<string,long>, doc_ids array<long>, sources array<string>, lens array<long>, ids binary"
PIECE_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("source", pa.string()), ("ids", pa.binary())])
PIECE_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


def encoded_blocks(documents: DataFrame, vocabulary: str, end_id: int, block: int) -> DataFrame:
    """Blocks of encoded documents, with what each source has sent in the same task before."""
    docs = doc_text(documents, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    maps = pa.map_(pa.string(), pa.int64())
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("sent", maps), ("own", maps), ("doc_ids", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("lens", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(vocabulary), TaskContext.get().partitionId()
        end, width = np.array([end_id], coder.dtype).tobytes(), coder.dtype.itemsize
        sent: dict[str, int] = {}
        before = 0
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal before
            own: dict[str, int] = {}
            for _, source, raw in held:
                own[source] = own.get(source, 0) + len(raw) // width
            out = (part, before, list(sent.items()), list(own.items()), [h[0] for h in held], [h[1] for h in held], [len(h[2]) // width for h in held], b"".join(h[2] for h in held))
            for source, n in own.items():
                sent[source] = sent.get(source, 0) + n
            before += sum(own.values())
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

        for batch in batches:
            raws = coder.encode([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            for doc_id, source, raw in zip(batch.column("doc_id").to_pylist(), batch.column("source").to_pylist(), raws, strict=True):
                raw += end
                held.append((doc_id, source, raw))
                size += len(raw) // width
                if size >= block:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return docs.mapInArrow(run, BLOCK_DDL)


class Schedule:
    """What each source has sent when the stream is so long: lines between the places where a source runs dry."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None, lot: int):
        self.names, self.lot = sorted(totals), lot
        left = {s: float(totals[s]) for s in self.names}
        weights = {s: float(totals[s] if targets is None else targets.get(s, 0.0)) for s in self.names}
        self.total = sum(totals.values())
        self.at, sent = [0.0], {s: [0.0] for s in self.names}
        while active := [s for s in self.names if left[s] > 0]:
            weight = sum(weights[s] for s in active)
            rates = {s: weights[s] / weight if weight > 0 else 1 / len(active) for s in active}
            step = min(left[s] / rates[s] for s in active if rates[s] > 0)
            for s in active:
                left[s] = 0.0 if rates[s] > 0 and left[s] / rates[s] <= step * (1 + 1e-12) else left[s] - rates[s] * step
            self.at.append(self.at[-1] + step)
            for s in self.names:
                sent[s].append(totals[s] - left[s])
        self.at[-1] = float(self.total)
        self.sent = {s: np.array(x) for s, x in sent.items()}
        self.lots = -(-self.total // lot)

    def ideal(self, source: str, lots: np.ndarray) -> np.ndarray:
        return np.interp(np.minimum(lots * float(self.lot), self.total), self.at, self.sent[source])

    def borders(self, source: str, lots: np.ndarray) -> np.ndarray:
        """What the source has sent before each of the lots: whole tokens, never falling."""
        return np.floor(self.ideal(source, lots) + 0.5).astype(np.int64)

    def cuts(self, source: str, begin: int, end: int) -> tuple[int, np.ndarray]:
        """The lot of the token at `begin` of the source's queue, and the places up to `end` where later lots begin."""
        knots, at = self.sent[source], np.array(self.at)
        low = max(0, int(np.interp(begin, knots, at) // self.lot) - 2)
        high = int(at[np.searchsorted(knots, min(end, knots[-1]), "left")] // self.lot) + 2
        lots = np.arange(low, min(high, self.lots) + 1)
        borders = self.borders(source, lots)
        first = int(np.searchsorted(borders, begin, "right")) - 1
        return int(lots[first]), borders[first + 1 : np.searchsorted(borders, end, "left")]

    def share(self, source: str, lot: int) -> float:
        """The source's part of what is sent where the lot begins."""
        k = min(int(np.searchsorted(self.at, lot * float(self.lot), "right")), len(self.at) - 1)
        return float((self.sent[source][k] - self.sent[source][k - 1]) / (self.at[k] - self.at[k - 1]))

    def begin(self, lot: int) -> int:
        return int(sum(self.borders(s, np.array([lot]))[0] for s in self.names))


def carried(blocks: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """For each task of the first pass what its sources have sent before it, one row for each task; and the sources' totals."""
    own = settle(blocks.select("part", F.explode("own").alias("source", "tokens")).groupBy("part", "source").agg(F.sum("tokens").alias("tokens")), "own")
    of_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    sent = own.select("part", "source", F.coalesce(F.sum("tokens").over(of_source), F.lit(0)).alias("sent"))
    told = sent.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("source", "sent"))).alias("sent_before"))
    totals = {r["source"]: r["n"] for r in own.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a row for each source
    return settle(told, "carried"), totals


LOT_DDL = "lot long, source string, place long, doc_ids array<long>, starts array<long>, lens array<long>, doc_tokens array<long>, ids binary"
LOTS = pa.schema([("lot", pa.int64()), ("source", pa.string()), ("place", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("doc_ids", "starts", "lens", "doc_tokens")), ("ids", pa.binary())])


def lot_rows(blocks: DataFrame, schedule) -> DataFrame:
    """For each block, source and lot the pieces of documents that go there, and where in the source's queue they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = schedule.value
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.array(row["lens"], np.int64)
                width = len(row["ids"]) // int(lens.sum())
                begins = np.concatenate([[0], np.cumsum(lens)])
                sources = np.array(row["sources"], object)
                sent, before = dict(row["sent"]), dict(row["sent_before"])
                out = []
                for source in sorted(set(row["sources"])):
                    mine = np.flatnonzero(sources == source)
                    place = before.get(source, 0) + sent.get(source, 0)
                    ends = place + np.cumsum(lens[mine])
                    lot, borders = plan.cuts(source, place, int(ends[-1]))
                    # pieces end where documents or lots do; a border that repeats is a lot with nothing of this source
                    edges = np.unique(np.concatenate([[place], ends, borders]))
                    of = np.searchsorted(ends, edges[:-1], "right")
                    start = edges[:-1] - (ends[of] - lens[mine[of]])
                    size = np.diff(edges)
                    to = lot + np.searchsorted(borders, edges[:-1], "right")
                    for each in np.unique(to):
                        at = np.flatnonzero(to == each)
                        docs = mine[of[at]]
                        raw = b"".join(row["ids"][a * width : b * width] for a, b in zip((begins[docs] + start[at]).tolist(), (begins[docs] + start[at] + size[at]).tolist(), strict=True))
                        out.append((int(each), source, int(edges[at[0]]), [row["doc_ids"][d] for d in docs], start[at].tolist(), size[at].tolist(), lens[docs].tolist(), raw))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), LOTS, strict=True)], schema=LOTS)

    return blocks.mapInArrow(run, LOT_DDL)


def dealt(sources: list[str], lens: list[int], shares: dict[str, float], deficits: dict[str, float], begin: int, window: int, turn: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document's index, start, length, sequence, offset) of each piece of a block that begins at so many tokens of the stream."""
    queues: dict[str, deque[int]] = {}
    for i, source in enumerate(sources):
        queues.setdefault(source, deque()).append(i)
    credit = {s: deficits.get(s, 0.0) for s in sorted(queues)}
    cut = dict.fromkeys(queues, 0)  # of each queue's first document, what is sent
    at = begin
    while queues:
        room = window - at % window
        weight = sum(shares.get(s, 0.0) for s in queues)
        for s in queues:
            credit[s] += room * (shares.get(s, 0.0) / weight if weight > 0 else 1 / len(queues))
        while room and queues:
            s = max(sorted(queues), key=credit.__getitem__)
            left = min(room, max(turn, math.ceil(credit[s])))
            queue = queues[s]
            while left and queue:
                i = queue[0]
                n = min(left, lens[i] - cut[s])
                yield i, cut[s], n, at // window, at % window
                at, room, left = at + n, room - n, left - n
                credit[s] -= n
                cut[s] += n
                if cut[s] == lens[i]:
                    queue.popleft()
                    cut[s] = 0
            if not queue:
                del queues[s]


def pack(documents: DataFrame, vocabulary: str, end_id: int = 0, targets: dict[str, float] | None = None, window: int = WINDOW, block: int = BLOCK, turn: int = TURN) -> DataFrame:
    """A row for each piece: doc_id, start (ids of its document before it), length, doc_tokens, sequence_id, offset (in the sequence), source, ids (little-endian, 4 bytes each)."""
    spark = documents.sparkSession
    small_batches(spark)
    blocks = settle(encoded_blocks(documents, vocabulary, end_id, block), "blocks")
    before, totals = carried(blocks)
    schedule = spark.sparkContext.broadcast(Schedule(totals, targets, block))  # a few numbers for each source

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, lot, held = schedule.value, None, []

        def deal() -> pa.RecordBatch:
            doc_ids, starts, lens, tokens = ([x for r in held for x in r[n]] for n in ("doc_ids", "starts", "lens", "doc_tokens"))
            sources = [r["source"] for r in held for _ in r["lens"]]
            ids = np.concatenate([np.frombuffer(r["ids"], f"<u{len(r['ids']) // sum(r['lens'])}") for r in held]).astype("<u4")
            begins = np.cumsum([0, *lens]).tolist()
            here = np.array([lot])
            owed = {s: float(plan.ideal(s, here)[0] - plan.borders(s, here)[0]) for s in set(sources)}
            shares = {s: plan.share(s, lot) for s in owed}
            pieces = list(dealt(sources, lens, shares, owed, plan.begin(lot), window, turn))
            columns = [[doc_ids[p[0]] for p in pieces], [starts[p[0]] + p[1] for p in pieces], [p[2] for p in pieces], [tokens[p[0]] for p in pieces], [p[3] for p in pieces], [p[4] for p in pieces]]
            columns += [[sources[p[0]] for p in pieces], [ids[begins[p[0]] + p[1] : begins[p[0]] + p[1] + p[2]].tobytes() for p in pieces]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE_SCHEMA, strict=True)], schema=PIECE_SCHEMA)

        for batch in batches:
            for row in batch.to_pylist():
                if row["lot"] != lot:
                    if held:
                        yield deal()
                    lot, held = row["lot"], []
                held.append(row)
        if held:
            yield deal()

    rows = lot_rows(blocks.join(before, "part").select("sent", "sent_before", "doc_ids", "sources", "lens", "ids"), schedule)
    return rows.repartition("lot").sortWithinPartitions("lot", "source", "place").mapInArrow(run, PIECE_DDL)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
