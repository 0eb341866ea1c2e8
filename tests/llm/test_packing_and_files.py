import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from querylode.llm.common import scratch
from querylode.llm.packing import Schedule, dealt, pack
from querylode.llm.token_files import EliasFano, Shard, filesystem, read_document, read_tokens, write_tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def corpus():
    rng = random.Random(4)
    words = "alpha beta gamma delta don't été naïve 12 34 ... token <|endoftext|>".split()
    rows = [(i * 7 % 1000 + 5, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 400]))), rng.choice(["a", "a", "a", "b", "c"])) for i in range(150)]
    return rows + [(2000, None, "a"), (2001, "", None), (2002, "again and again", "b"), (2002, "again and again", "b"), (2003, "long text " * 30000, "c")]


def plain_ids(path, text, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, ids string, start int").repartition(4)


@pytest.mark.parametrize("targets", [None, {"a": 1, "b": 1}])
def test_every_id_lies_in_one_piece(spark, targets):
    rows = corpus()
    got = pack(frame(spark, rows), BYTE, targets=targets, block=5000).collect()
    want = sorted((i, tuple(plain_ids(BYTE, t, 0))) for i, t, _ in rows)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = 0
    for sequence, offset, length in places:  # one gapless stream, cut every 1024
        assert (sequence, offset) == divmod(at, 1024) and offset + length <= 1024
        at += length
    assert at == sum(len(ids) for _, ids in want)
    by_doc = {}
    for r in got:
        assert len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append((r.start, r.doc_tokens, bytes(r.ids)))
    for doc_id, ids in set(want):
        pieces = sorted(by_doc[doc_id])
        times = sum(w == (doc_id, ids) for w in want)
        assert b"".join(p[2] for p in sorted(set(pieces))[: len(set(pieces))]) if times == 1 else True
        if times == 1:
            assert b"".join(p[2] for p in pieces) == np.array(ids, "<u4").tobytes()
            assert [p[0] for p in pieces] == np.cumsum([0, *(len(p[2]) // 4 for p in pieces[:-1])]).tolist()
            assert {p[1] for p in pieces} == {len(ids)}
        else:
            assert sum(len(p[2]) // 4 for p in pieces) == times * len(ids)


def test_shares_are_kept_within_each_window():
    sources = ["a"] * 60 + ["b"] * 30 + ["c"] * 10
    pieces = list(dealt(sources, [1000] * 100, {"a": 0.6, "b": 0.3, "c": 0.1}, {}, 300, 1024, 64))
    sent, at = dict.fromkeys("abc", 0), 300
    for i, _, n, sequence, offset in pieces:
        assert (sequence, offset) == divmod(at, 1024)
        at += n
        sent[sources[i]] += n
        if at % 1024 == 0 and at < 90000:
            for s, share in {"a": 0.6, "b": 0.3, "c": 0.1}.items():
                assert abs(sent[s] - share * (at - 300)) < 1024
    assert at == 100300


def test_deficits_carry_over():
    owed = list(dealt(["a", "b"], [2000, 2000], {"a": 0.5, "b": 0.5}, {"b": 900.0, "a": -900.0}, 0, 1024, 64))
    first = sum(n for i, _, n, sequence, _ in owed if i == 1 and sequence == 0)
    assert first > 900


def window_shares(pieces, source):
    sums = {}
    for r in pieces:
        n = sums.setdefault(r.sequence_id, [0, 0])
        n[0] += r.length * (r.source == source)
        n[1] += r.length
    return [n[0] / n[1] for _, n in sorted(sums.items())]


def test_windows_are_mixed_from_the_whole_table(spark):
    """Sources that stand one after the other are mixed to their targets until one runs dry."""
    rows = [(i, "some words of a text " * (20 + i % 7), "a" if i < 300 else "b") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    shares = window_shares(pack(docs, BYTE, targets={"a": 1, "b": 1}, block=1 << 14).collect(), "a")
    assert len(shares) > 60 and all(0.3 < x < 0.7 for x in shares[:-1])
    shares = window_shares(pack(docs.repartition(3, "source"), BYTE, targets={"a": 9, "b": 1}, block=1 << 14).collect(), "a")
    mixed = int(len(shares) / 2 / 0.9) - 2  # then a is dry
    assert all(0.7 < x <= 1 for x in shares[:mixed]) and abs(sum(shares[:mixed]) / mixed - 0.9) < 0.01 and not any(shares[mixed + 4 :])


def test_schedule_gives_every_token_to_one_lot():
    rng = random.Random(6)
    for targets in (None, {"a": 3, "b": 1}, {"c": 1}, {"a": 0.001, "b": 1, "c": 5}):
        totals = {"a": rng.randrange(1, 5000), "b": rng.randrange(1, 50000), "c": 7}
        plan = Schedule(totals, targets, 1000)
        lots = np.arange(plan.lots + 1)
        assert plan.begin(0) == 0 and plan.begin(plan.lots) == sum(totals.values())
        for s, n in totals.items():
            borders = plan.borders(s, lots)
            assert borders[0] == 0 and borders[-1] == n and (np.diff(borders) >= 0).all()
            for _ in range(30):
                a = rng.randrange(n)
                b = rng.randrange(a, n) + 1
                lot, cuts = plan.cuts(s, a, b)
                assert borders[lot] <= a < borders[lot + 1] and cuts.tolist() == [x for x in borders[lot + 1 :].tolist() if x < b]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pack(empty, BYTE).collect() == []
    folder = scratch(spark, "none")
    assert read_tokens(write_tokens(empty, folder, WORD, 2), folder).collect() == []


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [5], list(range(1000)), [0, 1, 1, 2**40], sorted(random.Random(1).sample(range(10**9), 700))])
def test_elias_fano_round_trip(values):
    ef = EliasFano.frombytes(EliasFano.of(np.array(values)).tobytes())
    assert ef.all().tolist() == values
    assert [ef[i] for i in range(len(values))] == values
    if len(values) > 500:
        assert len(ef.tobytes()) * 8 < len(values) * (4 + max(0, (values[-1] // len(values)).bit_length())) + 600


def test_files_round_trip(spark):
    rows = [*corpus(), (None, "nameless", "a"), (None, None, "b"), (-5, "below", "a")] + [(700, f"tie {i % 7}", "a") for i in range(200)]
    folder = scratch(spark, "tokens")
    shards = write_tokens(frame(spark, rows), folder, WORD, 2, shard_ids=2000)
    found = read_tokens(shards, folder).collect()
    got = sorted((r.start, r.n_tokens) for r in found)
    at = 0
    for start, n in got:
        assert start == at
        at += n
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    want = sorted((str(i), tuple(plain_ids(WORD, t, 2))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found) == want
    again = write_tokens(frame(spark, rows[::-1]), folder, WORD, 2, shard_ids=1500)
    assert sorted((r.start, str(r.doc_id), bytes(r.ids)) for r in read_tokens(again, folder).collect()) == sorted((r.start, str(r.doc_id), bytes(r.ids)) for r in found)
    for doc_id in (700, 2002, 2003, 1):
        mine = [bytes(r.ids) for r in sorted(found, key=lambda r: r.start) if r.doc_id == doc_id]
        assert [ids.astype("<u4").tobytes() for ids in read_document(shards, folder, doc_id)] == mine
    fs, _ = filesystem(folder)
    paths = [r.path for r in shards.collect()]
    assert len(paths) > 5
    with fs.open_input_stream(paths[0]) as f:
        raw = f.read()
    shard = Shard(raw)
    assert [shard.document(i)[0] for i in range(shard.n)] == shard.names()
    with pytest.raises(ValueError):
        Shard(raw[:-1] + bytes([raw[-1] ^ 1]))
