import random

import numpy as np
import pytest

from querylode.llm.jaccard_join import ORACLE, PrefixTree, RunTree, components, jaccard_components, keep_one, prefix_length


def brute(rows, k=5, percent=80):
    """doc_id -> (set size, component) from plain Python sets, all pairs."""
    sets = {}
    for doc_id, text in rows:
        words = [bytes(w) for w in (text or "").encode().lower().split()]
        wide = min(k, len(words))
        sets.setdefault(doc_id, []).append({tuple(words[i : i + wide]) for i in range(len(words) - wide + 1)} if words else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}, {(i, len(s)) for i in ids for s in sets[i]}


def near_copies(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and to in is it for on with as at by an be".split()) + str(rng.randrange(300))
    common = [word() for _ in range(40)]
    base = [[word() for _ in range(rng.randrange(4, 120))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.4:
            words += common
        rows.append((i * 3, " ".join(words).title() if rng.random() < 0.1 else " ".join(words)))
    return rows


EDGES = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "One  TWO"), (1005, "one two three"), (1006, "été ÉTÉ x y z w"), (1007, "été été x y z w"), (1008, "a b c d e f"), (1008, "a b c d e f"), (1009, "long " * 20000)]


@pytest.mark.parametrize("seed", [1])
def test_equals_brute_force(spark, seed):
    rows = near_copies(seed) + EDGES
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n long")
    got = jaccard_components(docs, levels=(3, 9), bits=12).collect()
    comps, sizes = brute(rows)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes
    assert {r.doc_id: r.component_id for r in got} == comps


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(docs).collect() == []


def test_one_of_each_group_stays(spark):
    rows = near_copies(5, 60) + EDGES
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in brute(rows)[0].values()})


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 120)] + [(119, 50)]
    found = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(31)} == {0}
    assert {found[i] for i in (50, *range(100, 120))} == {50}


def test_tree_prunes_nothing_that_links():
    rng = random.Random(3)
    sets = []
    for key in range(200):
        size = rng.randrange(1, 200)
        sets.append((key, sorted(rng.sample(range(260), size))))
    sets += [(1000 + k, s) for k, s in sets[:20]] + [(2000 + k, s[: len(s) // 2 + 1]) for k, s in sets[:20]]
    blob = lambda s: np.array(s, np.uint64).tobytes()
    tree = PrefixTree.of([(k, blob(s)) for k, s in sets])
    for _, probe in sets[::7]:
        want = {k for k, s in sets if 100 * len(set(s) & set(probe)) >= 60 * len(set(s) | set(probe))}
        assert set(tree.linked(blob(probe), 60)) == want


def test_run_tree_finds_each_pair_in_one_run():
    rng = random.Random(4)
    members = []
    for key in range(150):  # sets of 0.., ordered by their elements; the rarest first
        whole = sorted({*rng.sample(range(60), rng.randrange(8, 30)), *range(40, 55)})
        rare = whole[: prefix_length(len(whole), 60)]
        members.append((key, len(whole), key, rare, list(range(len(rare))), set(whole)))
    found = []
    for el in range(60):
        tree = RunTree()
        for m in members:
            if el in m[3]:
                one = RunTree.member(el, *m[:5])
                found += [(b, m[0]) for b in tree.partners(one, 60)]
                tree.add(one)
    assert len(found) == len(set(found))
    want = {(a[0], b[0]) for i, b in enumerate(members) for a in members[:i] if 100 * len(a[5] & b[5]) >= 60 * len(a[5] | b[5])}
    assert want <= set(found)


@pytest.mark.parametrize("stars, block", [(0, 4), (1, 1024)])
def test_trees_alone_find_all_links(spark, stars, block):
    rows = near_copies(7, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_components(docs, levels=(2, 9), bits=12, stars=stars, block=block).collect()} == brute(rows)[0]


def test_repeated_ids_are_one_document(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(12))
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (7, text("b")), (7, ""), (8, None), (9, text("z"))]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), levels=(3, 9), bits=12).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 3), (7, 3), (8, 8), (9, 9)]


def test_members_link_where_no_centre_does(spark):
    words = [f"word{i}" for i in range(13)]
    rows = [(1, " ".join([*words, "last"])), (2, " ".join([*words, "other"]))]
    rows += [(10 + i, " ".join(words[i : i + 5])) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    comps = brute(rows)[0]
    assert comps[2] == 1
    assert {r.doc_id: r.component_id for r in jaccard_components(docs, levels=(3, 9), bits=12).collect()} == comps


def test_null_and_repeated_ids_stay(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(12))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (1, text("a")), (2, text("d")), (2, text("e")), (2, text("d")), (3, ""), (3, None), (4, text("e")), (None, None)]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"), levels=(3, 9), bits=12)
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted([(None, text("b")), (None, text("c")), (None, ""), (1, text("a")), (2, text("d")), (2, text("e")), (3, "")], key=str)


def test_sql_gives_the_same_rows(spark):
    import duckdb
    import pandas as pd

    rows = near_copies(3, 60) + [e for e in EDGES if e[0] != 1008] + [(1008, "a b c d e f"), (1010, "a b c d e f")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(con.execute(ORACLE).fetchall())
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), levels=(2, 9), bits=12).select("doc_id", "n_shingles", "component_id", "class_id").collect()
    assert sorted(map(tuple, got)) == want
