import random

import pytest
from pyspark.sql import functions as F

from querylode.functions import text as T

CASES = {
    "SELECT o.* FROM orders o WHERE o.user_id = 42 AND n='a''b -- x' # y\n LIMIT 20;": "select o.* from orders o where o.user_id=? and n=? limit ?",
    "select count(*) from t1 where a>-3 and b = +7.5e-3 /* c */ and t_2024.x=1": "select count(*)from t1 where a>? and b=? and t_2024.x=?",
    "SELECT a FROM t WHERE k IN (1, 'x',3) AND c between -1 and 5": "select a from t where k in(?)and c between -? and ?",
    "select a -- one\n from t where x = #{id} and y = \"q\" ": "select a from t where x=#{id} and y=?",
    "a /* open": "a",
    "": "",
}


def test_fingerprints(spark):
    df = spark.createDataFrame([(k, v) for k, v in CASES.items()] + [(None, None)], "sql string, want string")
    for r in df.select("sql", "want", T.fingerprint("sql").alias("got")).collect():
        assert r.got == r.want, r.sql


def test_layout_and_values_do_not_matter(spark):
    rng = random.Random(5)
    pairs = []
    for i in range(200):
        a, b, c = rng.randrange(1000), rng.random(), "".join(rng.choice("ab'\\c -#") for _ in range(5)).replace("\\", "").replace("'", "''")
        tight = f"select x from t{i} where a={a} and b<={b:.3f} and c='{c}' and d in(1,2)"
        loose = f"SELECT  x\n FROM t{i} /* z */ WHERE a = {a + 1}\n AND b <= 7.25 AND c = 'other' -- end\n AND d IN ( 4 , 5,6 );"
        pairs.append((tight, loose))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", T.fingerprint("a").alias("x"), T.fingerprint("b").alias("y")).collect():
        assert r.x == r.y, r.a


@pytest.mark.parametrize(("columns", "want"), [(["a", "b"], "idx_t_a_b"), (["x" * 70], "idx_t_" + "x" * 58), (["a-b!"], "idx_t_ab")])
def test_index_names(spark, columns, want):
    df = spark.createDataFrame([("t", columns)], "t string, c array<string>")
    assert df.select(T.index_name("t", "c")).first()[0] == want


def test_key_sizes(spark):
    rows = [("int", None, None, 4.0), ("varchar", 10, "utf8mb4", 40.0), ("varchar", 10, "latin1", 10.0), ("char", None, "utf8", 3.0), ("text", None, None, float("inf")), ("datetime", None, None, 8.0), ("geometry", None, None, 8.0)]
    df = spark.createDataFrame(rows, "k string, n int, cs string, want double")
    for r in df.select("k", "want", T.key_bytes(F.col("k"), F.col("n"), F.col("cs")).alias("got")).collect():
        assert r.got == r.want, r.k


def test_evidence(spark):
    df = spark.createDataFrame([("select 1 -- x\n from   t",), ("x" * 300,), (None,)], "s string")
    got = [r[0] for r in df.select(T.evidence("s")).collect()]
    assert got == ["select 1 from t", "x" * 199 + "…", None]
