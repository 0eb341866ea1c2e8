import json
import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from querylode.analysis import Options, analyse, input_kind, load
from querylode.operators import findings as after
from querylode.operators import probes
from querylode.sources import catalog, sinks
from querylode.sources.mapper import mapper_statements
from querylode.sources.slow_log import read_slow_log
from querylode.streaming.windows import windowed_costs

LOG = """mysqld, Version: 8.0. started with:
Tcp port: 3306
Time                 Id Command    Argument
# Time: 2026-01-01T00:00:01.500000Z
# User@Host: app[app] @ h [1.2.3.4]  Id: 1
# Query_time: 1.500000  Lock_time: 0.000100 Rows_sent: 1  Rows_examined: 100
use shop;
SET timestamp=1;
SELECT * FROM goods
WHERE kind = 'a' AND price > 5;
# User@Host: app[app] @ h [1.2.3.4]  Id: 2
# Query_time: 3.000000  Lock_time: 0.000100 Rows_sent: 1  Rows_examined: 50
SELECT * FROM goods WHERE kind = 'b' AND price > 7;
# Time: 2026-01-01T00:00:09.000000Z
# User@Host: root[root] @ h []  Id: 3
# Query_time: 9.000000  Lock_time: 0.000000 Rows_sent: 0  Rows_examined: 0
# administrator command: Quit;
# Time: 2026-01-01T00:09:00.000000Z
# User@Host: app[app] @ h []  Id: 4
# Query_time: 0.100000  Lock_time: 0.000000 Rows_sent: 0  Rows_examined: 7
SELECT unterminated FROM goods
"""

SCHEMA = {
    "tables": [
        {
            "name": "Goods", "charset": "utf8mb4",
            "columns": [{"name": "id", "type": "bigint"}, {"name": "kind", "type": "varchar", "length": 20}, {"name": "price", "type": "int"}, {"name": "made", "type": "datetime"}, {"name": "code", "type": "varchar", "length": 30}, {"name": "body", "type": "text"}, {"name": "is_old", "type": "tinyint"}],
            "indexes": [{"name": "PRIMARY", "columns": ["id"], "unique": True, "primary": True}, {"name": "idx_three", "columns": ["kind", "made", "price"]}, {"name": "idx_fun", "columns": [None]}, {"name": "u_code", "columns": ["code"], "unique": True}],
        }
    ]
}

SQL = """SELECT * FROM goods WHERE kind = 'a' AND price > 5;
SELECT * FROM goods WHERE YEAR(made) = 2026;
SELECT * FROM goods WHERE code = 5;
SELECT id, kind FROM goods WHERE price = 1 ORDER BY made LIMIT 20000, 10;
SELECT * FROM goods WHERE body = 'x';
SELECT * FROM goods WHERE id = 1;
SELECT * FROM goods WHERE is_old = 1;
SELECT * FROM goods g WHERE g.price = 1 OR g.made = 2;
SELECT * FROM goods_${x} WHERE a = 1;
SELECT * FROM goods WHERE code LIKE '%z';
SELECT * FROM unknown WHERE a = 1 AND b = 2;
SELECT * FROM unknown WHERE b = 2 AND a = 1 AND c = 3;
SELECT * FROM unknown WHERE b = 2 AND a = 1;
this is not sql"""


@pytest.fixture(scope="module")
def schema(spark):
    return catalog.catalog_from_json(spark, json.dumps(SCHEMA))


@pytest.fixture(scope="module")
def analysed(spark, schema):
    result = analyse(load(spark, SQL, "sql", inline=True), schema)
    return result, result.findings.collect()


def test_slow_log(spark, tmp_path):
    (tmp_path / "slow.log").write_text(LOG)
    events = read_slow_log(spark, str(tmp_path / "slow.log")).orderBy("event_ord").collect()
    assert [(e.line, e.ignored, e.user, e.db) for e in events] == [(9, False, "app", "shop"), (13, False, "app", None), (None, True, "root", None), (21, False, "app", None)]
    assert events[0].query_time == Decimal("1.5") and events[0].ts == datetime(2026, 1, 1, 0, 0, 1, 500000) and events[1].ts is None
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    split = read_slow_log(spark, str(tmp_path / "slow.log"))
    assert spark.read.format("text").option("lineSep", "\n# Time: ").load(str(tmp_path / "slow.log")).rdd.getNumPartitions() > 3
    assert sorted(map(str, split.collect())) == sorted(map(str, events))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    record, other = sorted(load(spark, str(tmp_path / "slow.log")).collect(), key=lambda r: r.record_ord)
    assert (record.occurrences, record.total_query_time, record.max_rows_examined, record.line, record.query_time, record.rows_examined) == (2, Decimal("4.5"), 100, 9, Decimal("3"), 50)
    assert other.fingerprint == "select unterminated from goods"


def test_rules(analysed):
    found = {(f.rule, f.line): f for f in analysed[1]}
    assert found["SIA003", 1].ddl == ["ALTER TABLE `goods` ADD INDEX `idx_goods_kind_price` (`kind`, `price`);"]
    year = found["SIA004", 2]
    assert year.rewrite == "made >= '2026-01-01 00:00:00' AND made < '2027-01-01 00:00:00'" and year.severity == "error"
    assert found["SIA005", 3].rewrite == "SELECT * FROM goods WHERE code = '5'"
    assert found["SIA006", 4].rewrite == "SELECT t.`id`, t.`kind` FROM (SELECT `id` FROM `goods` WHERE price = 1 ORDER BY made LIMIT 20000, 10) AS page JOIN `goods` t ON t.`id` = page.`id` ORDER BY t.`made`;"
    assert found["SIA002", 5].ddl == ["ALTER TABLE `goods` ADD INDEX `idx_goods_body` (`body`(64));"]
    assert not [f for f in analysed[1] if f.line == 6]
    flag = found["SIA001", 7]
    assert flag.severity == "info" and flag.low_cardinality_risk
    assert found["SIA001", 8].ddl == [] and "UNION ALL" in found["SIA001", 8].message
    assert found["SIA001", 9].ddl == [] and "run time" in found["SIA001", 9].message
    assert found["SIA004", 10].severity == "info"


def test_redundant_indexes_go(analysed):
    kept = [f for f in analysed[1] if f.table == "unknown"]
    assert [f.index_columns for f in kept] == [["b", "a", "c"]] or sorted(tuple(f.index_columns) for f in kept) == [("a", "b"), ("b", "a", "c")]


def test_ranking_and_accounts(analysed):
    result, found = analysed
    severities = [f.severity for f in found]
    assert severities == sorted(severities, key=["error", "warn", "info"].index)
    skipped = {(s.rule, s.reason): s["count"] for s in result.skipped.collect()}
    assert skipped["SIA007", "no Rows_examined in this input (slow log only)"] == 14
    assert skipped["SIA001", "no table could be identified"] == 1
    assert after.exit_code(result.findings) == 1 and after.exit_code(result.findings.limit(0)) == 0


def test_reports(analysed):
    result, found = analysed
    report = json.loads(sinks.report_json(result.findings, result.skipped, result.notes, result.records).first()[0])
    assert len(report["findings"]) == len(found) and report["by_severity"]["error"] == sum(f.severity == "error" for f in found)
    lines = [r[0] for r in sinks.annotations(result.findings).collect()]
    assert lines[0].startswith("::error title=SIA") and all("\n" not in x for x in lines)
    script = "\n".join(r[0] for r in sinks.migration(result.findings).collect())
    assert script.count("ADD INDEX `idx_goods_kind_price`") == 1 and "DROP" not in script and "-- rewrite: " in script
    text = sinks.text_report(result.findings, result.skipped, result.notes, 3)
    assert "3 shown" in text and "not evaluated: SIA007" in text
    assert sinks.inventory(result.records).count() == 14


def test_options_and_missing_catalog(spark):
    result = analyse(load(spark, SQL, "sql", inline=True), None, Options(rules=("sia001", "SIA005"), min_severity="info"))
    assert {f.rule for f in result.findings.collect()} == {"SIA001"}
    assert {s.reason for s in result.skipped.where("rule = 'SIA005'").collect()} == {"needs a catalog to know existing indexes"}


@pytest.mark.parametrize(("change", "said"), [({"tables": []}, "at least one"), ({"tables": [{"name": "x", "columns": [], "indexes": []}]}, "columns"), ({"tables": [{"columns": [{"name": "a", "type": "int"}], "indexes": []}]}, "name"), ({"tables": [{"name": "x", "columns": [{"name": "a", "type": "int"}], "indexes": [{"name": "i", "columns": []}]}]}, "part")])
def test_catalogs_are_all_or_nothing(spark, change, said):
    with pytest.raises(catalog.CatalogError, match=said):
        catalog.catalog_from_json(spark, json.dumps(change))


MAPPER = """<mapper namespace="a.B">
 <!-- two
 lines -->
 <sql id="cols">id, <choose><when test="x">kind</when><otherwise>price</otherwise></choose></sql>
 <select id="page" parameterType="Q">SELECT <include refid="cols"/> FROM goods
  <where><if test="a">AND kind = #{a}</if> <if test="b">AND id IN <foreach open="(" close=")" item="i" collection="l">#{i}</foreach></if></where> LIMIT #{o}, #{n}</select>
 <update id="up">UPDATE goods <set><if test="a">kind = #{a},</if><if test="b">price = #{b},</if></set> WHERE made &lt; #{m} <![CDATA[ AND price > 3 ]]></update>
 <select id="raw">SELECT 1 FROM t_${suffix} WHERE a = ${v}</select>
</mapper>"""


def test_mappers(spark, tmp_path):
    page, raw, update = mapper_statements(MAPPER)
    assert [v["label"] for v in page["variants"]] == ["when[0]", "otherwise"]
    assert page["variants"][0]["sql"] == "SELECT id, kind FROM goods WHERE kind = ? AND id IN ( ? ) LIMIT ?, ?" and page["line"] == 5
    assert update["variants"][0]["sql"] == "UPDATE goods SET kind = ?, price = ? WHERE made < ? AND price > 3"
    assert raw["raw_interpolation"] and raw["variants"][0]["sql"].startswith("SELECT 1 FROM t_")
    assert mapper_statements("<beans/>") == [] and mapper_statements(None) == []
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.xml").write_text(MAPPER)
    (tmp_path / "node_modules" / "b.xml").write_text(MAPPER)
    (tmp_path / "c.xml").write_text("<beans/>")
    assert sorted(r.statement_id for r in load(spark, str(tmp_path)).collect()) == ["page#otherwise", "page#when[0]", "raw", "up"]


def test_kinds(tmp_path):
    assert [input_kind(x) for x in ("a.xml", "a.json", "a.slow", "a.sql", "# Query_time: 1\n", "SELECT 1")] == ["mapper", "schema", "slowlog", "sql", "slowlog", "sql"]
    assert input_kind(str(tmp_path), True) == "mapper"


def test_probes(spark):
    df = spark.createDataFrame([(i, i % 7, None if i % 5 else "ab") for i in range(100)], "k long, v long, s string")
    same = probes.differences(df, F.expr("v + 1 = 3"), F.expr("v = 2"), "k").first()
    assert same.n_before == same.n_after and same.n_differ == 0
    assert probes.differences(df, F.expr("s = 'ab'"), F.expr("k > 50"), "k").first().n_differ > 0
    order = [F.desc("v"), F.desc("k")]
    page = [tuple(r) for r in probes.page_by_offset(df, order, 20, 5).collect()]
    assert sorted(page) == sorted(tuple(r) for r in probes.page_by_join(df, "k", order, 20, 5, "v").select(*df.columns).collect())
    last = probes.page_by_offset(df, order, 19, 1).first()
    assert page == [tuple(r) for r in probes.page_after(df, "v", "k", last.v, last.k, 5).collect()]
    assert probes.key_differences(df.where("k < 5"), df.where("k < 6"), ["k"]).collect() == [(5, 2)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(datetime(2026, 1, 1, 0, i), f"select {i} from t", Decimal("1.5"), i) for i in range(12)]
    events = spark.createDataFrame(rows, "ts timestamp, sql string, query_time decimal(18,6), rows_examined long")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = windowed_costs(stream).writeStream.outputMode("complete").format("memory").queryName("costs").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("costs").collect())) == sorted(map(tuple, windowed_costs(events).collect()))


def test_sql_files_are_read_in_chunks(spark, tmp_path):
    """Whatever is open where a chunk or a block begins, statements, lines and their order are those of the whole text."""
    from querylode.plans.lexer import statements
    from querylode.sources.sql_text import read_sql_files

    rng = random.Random(11)
    parts = [
        "select 1;\n", "select a -- it's;\n from t;\n", "insert into t values ('x;\n y''s \\\n z');\n", "/* one; it's\n two */ select (2;\n);\n", 'select "a;\n\\";\n', "select `b\n;` from u", ";\n;;\n",
        "# (; note\n", "select #{x\n;y} from v;\r\n", "\n", "select é, \n b", "; select 3; ", "))\n", "/*\n*/\n",
    ]
    texts = {f"{i}.sql": "".join(rng.choice(parts) for _ in range(600)) for i in range(3)} | {"open.sql": "select 1;\nselect 'a;\n" * 3 + "'b;\n" * 900, "line.sql": "a;b;(c;d) -- e;", "none.sql": "\n -- x\n", "empty.sql": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for size in (1, 300, 1 << 20):
            got = {}
            for r in read_sql_files(spark, str(tmp_path), size).collect():
                got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.record_ord, r.sql, r.line, r.occurrences))
            for name, text in texts.items():
                assert sorted(got.get(name, [])) == [(i, sql, line, 1) for i, (sql, line) in enumerate(statements(text))], (name, size)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_long_texts_are_split_in_linear_time():
    from querylode.plans import lexer

    class Counted(str):
        looked = 0

        def count(self, part, begin=0, end=None):
            Counted.looked += (len(self) if end is None else end) - begin
            return super().count(part, begin, len(self) if end is None else end)

    text = Counted("select a\nfrom t where k = 'x;';\n" * 2000)
    assert lexer.statements(text)[-1] == ("select a\nfrom t where k = 'x;'", 3999) and Counted.looked <= len(text)
