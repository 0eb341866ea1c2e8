import random
import re

import numpy as np
import pyarrow as pa

from querylode.llm import boosting, toxicity
from querylode.llm.shingles import hashed_words


def corpus(n=600):
    rng = random.Random(12)
    parts = "ba con de fi gor hu in jo ka lem mo nor pa qui res".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            bad = ["idiot", "moron"] if i % 8 == 0 else ["zorgl" + rng.choice(["a", "en", "ist"]), "zorglum"]
            for b in bad:
                words.insert(rng.randrange(len(words)), "you " + b)
        docs.append((i, " ".join(words), 9))
        labels.append((i, int(toxic), 1))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    edges = [(5000, None, 0), (5001, "", 0), (5002, "YOU IDIOT!!! m0ron", 0), (5003, "word " * 30000, 0), (5003, "word " * 30000, 0)]
    documents = spark.createDataFrame(docs + edges, "doc_id long, text string, toxic int")
    told = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (7, None, 1)], "doc_id long, toxic int, quality int")
    from pyspark.sql import functions as F

    model = toxicity.train(documents, told, ~toxicity.held_out(F.col("doc_id")))
    got = toxicity.score(documents, model).join(spark.createDataFrame(labels, "doc_id long, toxic int, q int"), "doc_id", "left").where(toxicity.held_out(F.col("doc_id")) | (F.col("doc_id") >= 5000)).collect()
    assert all(0 <= r.score <= 1 for r in got) and sum(r.doc_id >= 5000 for r in got) == 5
    judged = [r for r in got if r.toxic is not None]
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in judged) >= 0.95 * len(judged) > 50
    assert toxicity.score(documents.limit(0), model).collect() == []


def test_without_labels(spark):
    documents = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.train(documents, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= toxicity.score(documents, model).first().score <= 1


def test_features_do_not_depend_on_the_batch():
    texts = ["You are an IDIOT!!", None, "", "x1y a.b", "éa you moron", " "]
    none = np.zeros(0, np.uint64), np.zeros(0)
    lexicon = toxicity.Lexicon(*none, (none,) * len(toxicity.STEMS))
    together = toxicity.features(pa.array(texts, pa.string()), lexicon)
    for row, text in zip(together, texts, strict=True):
        assert np.allclose(row, toxicity.features(pa.array([text], pa.string()), lexicon)[0])
    named = dict(zip(toxicity.NAMES, together[0], strict=True))
    assert named["fixed_count"] == named["near_person"] == 1 and named["repeated_signs"] > 0


def plain_features(text, lexicon):
    """The features by plain loops over the characters of a text, in the order of NAMES."""
    raw = (text or "").encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"(?:[0-9A-Za-z]|[\x80-\xff])+", raw)]
    hashes = [int(hashed_words(pa.array([raw[a:b].decode("utf-8", "replace")]))[0][0]) for a, b in words]
    known = dict(zip(lexicon.words.tolist(), lexicon.weights.tolist(), strict=True))
    fixed = [h in toxicity.FIXED.tolist() for h in hashes]
    person = [h in toxicity.PERSONS.tolist() for h in hashes]
    learnt = [known.get(h, 0.0) for h in hashes]
    n, size = max(1, len(words)), max(1, len(raw))
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    hits = [f or w > 0 for f, w in zip(fixed, learnt, strict=True)]
    near = sum(h and any(person[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, h in enumerate(hits))
    return {
        "fixed_count": sum(fixed), "near_person": near, "exclaims": raw.count(b"!") / size, "questions": raw.count(b"?") / size,
        "capitals": sum(65 <= c <= 90 for c in raw) / size, "capital_words": sum(b - a > 1 and all(65 <= c <= 90 for c in raw[a:b]) for a, b in words) / n,
        "fixed_density": sum(fixed) / n, "learnt_count": sum(w > 0 for w in learnt), "learnt_density": sum(w > 0 for w in learnt) / n, "person_density": sum(person) / n, "mean_word": sum(map(letter, raw)) / n,
    }


def test_features_equal_plain_loops():
    rng = random.Random(3)
    tokens = ["You", "your", "are", "an", "IDIOT", "moron!!", "nice", "été", "zorg", "STOP", "a-b", "it's", "x1y", "??", "word.", "\n", "you,", "stupid", "1234"]
    texts = [" ".join(rng.choice(tokens) for _ in range(rng.randrange(0, 60))) for _ in range(40)] + [None, "", "!!!"]
    key = hashed_words(pa.array(["zorg"]))[0]
    lexicon = toxicity.Lexicon(key, np.array([2.5]), ((np.zeros(0, np.uint64), np.zeros(0)),) * len(toxicity.STEMS))
    got = toxicity.features(pa.array(texts, pa.string()), lexicon)
    for row, text in zip(got, texts, strict=True):
        named = dict(zip(toxicity.NAMES, row, strict=True))
        for name, want in plain_features(text, lexicon).items():
            assert np.isclose(named[name], want), (name, text)


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    booster = boosting.fit(x[:1200], y[:1200])
    assert ((booster.logits(x[1200:]) > 0) == y[1200:]).mean() > 0.95
    steps = boosting.calibrate(booster.logits(x[:1200]), y[:1200])
    grid = steps(np.linspace(-10, 10, 200))
    assert (np.diff(grid) >= 0).all() and 0 <= grid[0] < 0.2 and 0.8 < grid[-1] <= 1
    assert len(boosting.fit(x, np.zeros(2000)).trees) == 0
