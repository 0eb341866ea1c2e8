import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from querylode.llm.ppm_score import ORDER, code_rows, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows():
    rng = random.Random(8)
    parts = "th on er ing tion é ß".split()
    out = [(i, " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(rng.choice([0, 1, 9, 80]))).title()) for i in range(80)]
    return out + [(500, None), (501, ""), (502, "zz top 日本"), (502, "zz top 日本"), (503, "w" * 3000), (504, "the " * 20000), (None, "never\n\tseen  before")]


def brute(data):
    """Counts and codes of whole byte streams, byte by byte."""
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data]
    words = [[*WORD.findall(lower(t)), None] for _, t in data]
    streams = [b"\n" * ORDER + " ".join(w[:-1]).encode() + b"\n" for w in words]
    counts, follow = Counter(), {}
    for h, tokens, s in zip(held, words, streams, strict=True):
        if not h:
            counts.update(tokens)
            for at in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    follow.setdefault(s[at - k : at], Counter())[s[at]] += 1
    n, v = sum(counts.values()), len(counts)
    memo = {}

    def code(gram):
        past, x = gram[:-1], gram[-1]
        mass, excluded = 0.0, set()
        for k in range(ORDER, -1, -1):
            f = {b: c for b, c in follow.get(past[ORDER - k :], {}).items() if b not in excluded}
            if not f:
                continue
            total = sum(f.values())
            if x in f:
                return mass + math.log10((f[x] - 0.5) / total)
            mass += math.log10(len(f) / (2 * total))
            excluded |= set(f)
        return mass - math.log10(256 - len(excluded))

    def ppm(s):
        total = 0.0
        for at in range(ORDER, len(s)):
            gram = s[at - ORDER : at + 1]
            if gram not in memo:
                memo[gram] = code(gram)
            total += memo[gram]
        return total

    out = []
    for (i, _), h, tokens, s in zip(data, held, words, streams, strict=True):
        out.append((i, h, len(tokens), sum(counts[x] > 0 for x in tokens), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), ppm(s)))
    return out


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, *r))


@pytest.mark.parametrize("block, page", [(3000, 700), (1 << 24, 1 << 20)])
def test_equals_brute_force(spark, block, page):
    data = rows()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in data], "doc_id long, text string, score double").repartition(3)
    got, want = by_id(score(docs, block=block, page=page).collect()), by_id(brute(data))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_words_out_of_order_score_lower(spark):
    rng = random.Random(5)
    phrases = ["the old road turned north", "we could see a small house", "smoke still rose from its chimney", "people from town liked to tell"]
    data = [(i, " ".join(rng.choice(phrases) for _ in range(20))) for i in range(60)]
    plain = " ".join(phrases * 3)
    mixed = plain.split()
    rng.shuffle(mixed)
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = {r.doc_id: r for r in score(spark.createDataFrame([*data, (held[0], plain), (held[1], " ".join(mixed))], "doc_id long, text string")).collect()}
    a, b = got[held[0]], got[held[1]]
    assert a.base_score == pytest.approx(b.base_score) and a.score > 0.7 * b.score


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(2)
    orders = [rng.integers(0, 4, (6, 256)) * (rng.random((6, 256)) < share) for share in (0.01, 0.0, 0.1, 0.5, 0.7)]
    orders[0][3] = 0
    assert np.power(10.0, code_rows(orders)).sum(axis=1) == pytest.approx(np.ones(6))
    assert np.power(10.0, code_rows([np.zeros((1, 256))] * 5)).sum() == pytest.approx(1)


def test_no_training_documents(spark):
    got = score(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, round(r.score, 9)) for r in got) == [(1, 0, 0, 0.0, round(-math.log10(256), 9)), (3, 0, 0, 0.0, round(-4 * math.log10(256), 9))]


def test_empty_table(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
