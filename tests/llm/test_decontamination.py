import math
import random
import re
from collections import Counter

from querylode.llm.decontamination import drop_leaking, find_leaks, question_and_answer


def words(rng, n):
    return [rng.choice("bel dor fan gim hol jat kem lor mip nus".split()) + rng.choice("a e i o u".split()) + rng.choice("st rk nd lm".split()) * rng.randrange(3) for _ in range(n)]


def setting():
    rng = random.Random(9)
    items = [(100 + i, " ".join(words(rng, rng.choice([6, 15, 40, 150])))) for i in range(30)] + [(7, "what is it? it is " + " ".join(words(rng, 20))), (8, None), (9, ""), (10, items_twice := " ".join(words(rng, 12))), (11, items_twice)]
    docs, leaks = [], set()
    for d in range(60):
        body = words(rng, rng.choice([0, 20, 150, 700]))
        if d % 3 == 0:
            item_id, text = rng.choice(items[:30])
            at = rng.randrange(len(body) + 1)
            leaked = text.split()
            if d % 2 and len(leaked) > 30:
                leaked[4] = "changed"
            body = body[:at] + [w.upper() if d % 4 == 0 else w for w in leaked] + body[at:]
            leaks.add((d, item_id))
        docs.append((d, ", ".join(body) if d % 5 == 0 else " ".join(body)))
    docs += [(900, None), (901, ""), (902, items_twice), (902, items_twice), (903, "bela " * 60000 + items[3][1])]
    return items, docs, leaks | {(902, 10), (902, 11), (903, items[3][0])}


def brute(items, docs, threshold=0.6, overlap=0.5):
    """All passages against all segments by plain BM25 over words, one at a time. An item's segments are as equal in length as can be."""
    segments = []
    for item_id, text in items:
        w = plain_words(text or "")
        n = -(-len(w) // 64)
        at = 0
        for k in range(n):
            size = len(w) // n + (k < len(w) % n)
            segments.append((item_id, text, len(w), w[at : at + size]))
            at += size
    mean = sum(len(s) for *_, s in segments) / len(segments)
    held = Counter(t for *_, s in segments for t in set(s))
    gain = lambda t, s: math.log(1 + (len(segments) - held[t] + 0.5) / (held[t] + 0.5)) * s.count(t) * 2.2 / (s.count(t) + 1.2 * (0.25 + 0.75 * len(s) / mean))
    gains = [{t: gain(t, s) for t in set(s)} for *_, s in segments]
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for d, text in docs:
        w = plain_words(text or "")
        for begin in range(0, len(w), 32):
            passage = set(w[begin : begin + 96])
            for (item_id, item, length, _), g in zip(segments, gains, strict=True):
                if sum(x for t, x in g.items() if t in passage) >= (threshold - 1e-9) * sum(g.values()):
                    reach = max(0, length - 64)
                    near = w[max(0, begin - reach) : begin + 96 + reach]
                    parts = [plain_words(p) for p in question_and_answer(item)]
                    if all(not p or len(runs(p, min(3, len(p))) & runs(near, min(3, len(p)))) >= overlap * len(runs(p, min(3, len(p)))) for p in parts):
                        out.add((d, item_id))
    return out


def test_equals_brute_force_and_finds_what_was_planted(spark):
    items, docs, planted = setting()
    documents = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    got = find_leaks(documents, benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found == brute(items, docs)
    assert planted <= found
    assert all(r.score <= 1.0001 for r in got)
    whole = sorted(tuple(r)[:2] + (round(r.score, 9),) for r in got)
    sliced = find_leaks(documents, benchmark, max_bytes=2000).collect()
    assert sorted(tuple(r)[:2] + (round(r.score, 9),) for r in sliced) == whole
    kept = drop_leaking(documents, benchmark)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in found}


def test_empty_tables(spark):
    documents = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(documents, none).collect() == []
    assert find_leaks(documents.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []
    assert drop_leaking(documents, none).count() == 1


def test_questions_and_answers():
    assert question_and_answer("How far? Ten miles.") == ("How far?", " Ten miles.")
    assert question_and_answer("Q: how far Answer: ten") == ("Q: how far ", " ten")
    assert question_and_answer("a b c") == ("a b", "c")


def plain_words(text):
    return re.findall(r"[0-9a-z]+", text.lower())


def holds_run(text, item):
    w, i = plain_words(text), plain_words(item)
    return any(w[k : k + len(i)] == i for k in range(len(w) - len(i) + 1))


def test_whole_copies_of_items_with_short_parts(spark):
    rng = random.Random(4)
    questions = ["Which town on the river Ouse holds the winter fair", "Who painted the blue horses of Sindelsdorf", "Is the moon of Pluto larger than Ceres"]
    items = list(enumerate([f"{questions[0]}? Answer: Paris", f"{questions[1]}? Answer: B", f"{questions[2]}? Yes", f"{questions[0]} in May? Answer: New York", "Capital? The largest town of Gelderland", "Why? Because", "zirconium flute", "amber quartz violin", "seven grey geese flew south"]))
    docs = [(d, " ".join([*words(rng, at), *(w.upper() if d % 2 else w for w in text.split()), *words(rng, 120)])) for at in (0, 20, 95, 300) for d, (_, text) in ((10 * at + i, items[i]) for i in range(len(items)))]
    far = (9000, " ".join([questions[0], *words(rng, 40), "Paris"]))
    apart = (9001, " ".join(["Why", *words(rng, 40), "because"]))
    docs += [far, apart, (9002, questions[1] + "?"), (9003, " ".join(words(rng, 200)))]
    planted = {(d, i) for d, text in docs for i, item in items if holds_run(text, item)}
    assert len(planted) == 4 * len(items)
    found = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert planted <= found
    assert not {d for d, _ in found} & {9000, 9001, 9002, 9003}


def test_repeated_items_and_slices(spark):
    rng = random.Random(12)
    twice, often = " ".join(words(rng, 20)), " ".join(words(rng, 30))
    few = [(1, twice), (2, twice)]
    many = [(i, often if i % 5 == 0 else " ".join(words(rng, 25))) for i in range(60)]
    docs = [(1, " ".join([*words(rng, 50), twice, *words(rng, 70)])), (2, " ".join([*words(rng, 10), often])), (3, " ".join(words(rng, 200)))]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    for items in (few, many, few + [(100 + i, t) for i, t in many]):
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        planted = {(d, i) for d, text in docs for i, item in items if holds_run(text, item)}
        assert len(planted) >= 2
        for max_bytes in (1 << 20, 700):
            assert {(r.doc_id, r.item_id) for r in find_leaks(documents, benchmark, max_bytes=max_bytes).collect()} == planted
