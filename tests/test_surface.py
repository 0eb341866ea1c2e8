import json
import random

import pytest
from pyspark.sql import functions as F

from querylode import catalogue, polish
from querylode.__main__ import main
from querylode.analysis import Options, Rule, analyse, load
from querylode.functions import text as T
from querylode.functions.language import resolve_lang, translated
from querylode.operators import findings as after
from querylode.operators.rules import finding
from querylode.sources import catalog, seed, sinks
from querylode.streaming.windows import bursts

SQL = "SELECT * FROM goods WHERE kind = 'a' AND price > 5; SELECT id FROM goods WHERE code = 5 ORDER BY price LIMIT 20000, 10; TRUNCATE goods"
SCHEMA = {"tables": [{"name": "goods", "columns": [{"name": "id", "type": "bigint"}, {"name": "kind", "type": "varchar", "length": 20}, {"name": "price", "type": "int"}, {"name": "code", "type": "varchar", "length": 30}], "indexes": [{"name": "PRIMARY", "columns": ["id"], "unique": True, "primary": True}]}]}


def test_command_line(spark, tmp_path, capsys):
    schema = tmp_path / "schema.json"
    schema.write_text(json.dumps(SCHEMA))
    assert main(["analyze", SQL, "--schema", str(schema), "--top", "1", "--rules", "sia001,SIA005"], spark) == 1
    said = capsys.readouterr().out
    assert "1 shown" in said and "error 3" in said and "SIA006" not in said
    assert main(["analyze", SQL, "--rules", "SIA006", "--lang", "zh_CN.UTF-8"], spark) == 0
    assert "显示" in capsys.readouterr().out
    assert main(["analyze", SQL, "--format", "json"], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["report_version"] == 1 and not report["truncated"] and json.loads(report["options"])["deep_offset"] == 10_000 and len(report["rules"]) == 7
    assert main(["analyze", SQL, "--format", "github", "--fail-on", "info"], spark) == 1
    lines = capsys.readouterr().out.splitlines()
    assert any(x.startswith("::notice title=note::truncate") for x in lines) and any("not evaluated%3A SIA002" in x for x in lines)
    assert main(["list", SQL], spark) == 0 and "truncate statements are not analysed" in capsys.readouterr().out
    assert main(["rules"], spark) == 0 and len(capsys.readouterr().out.splitlines()) == 7
    assert main(["analyze", str(tmp_path / "none.log")], spark) == 2 and capsys.readouterr().err


def test_failing_rules_are_named_and_the_rest_goes_on(spark):
    def plan(b, o):
        raise KeyError("no such column")

    late = Rule("X2", "fails on rows", False, False, lambda b, o: finding(b, "X2", "warn", F.raise_error(F.lit("broken"))))
    fine = Rule("X3", "says one thing", False, False, lambda b, o: finding(b.limit(1), "X3", "error", F.lit("here")))
    result = analyse(load(spark, SQL, "sql", inline=True), None, Options(rules=("SIA001",)), (Rule("X1", "fails", False, False, plan), late, fine))
    assert [r for r, _ in result.errors] == ["X1", "X2"] and "no such column" in result.errors[0][1]
    assert {f.rule for f in result.findings.collect()} == {"SIA001", "X3"}
    assert after.exit_code(result.findings, errors=result.errors) == 2
    assert "failed: X1" in sinks.text_report(result.findings, result.skipped, result.notes, errors=result.errors)


def test_tool_results_and_texts_for_models(spark):
    result = analyse(load(spark, SQL, "sql", inline=True), None, polish=polish.with_notes)
    told = sinks.tool_result(result.findings, result.skipped, result.notes, 1)["structuredContent"]
    assert told["truncated"] and told["total"] == result.findings.count() > 1 == len(told["findings"])
    assert all(f.note == polish.NOTES[f.rule] for f in result.findings.collect())
    prompts = [r.prompt for r in polish.with_prompts(result.findings).collect()]
    assert all("Rule: SIA" in p for p in prompts) and not any("'a'" in p for p in prompts)
    assert after.usable(result.records).count() == 2


def test_languages(spark):
    assert [resolve_lang("zh"), resolve_lang(None, {"LANG": "zh_CN.UTF-8"}), resolve_lang("en", {"LANG": "zh_CN"}), resolve_lang(None, {})] == ["zh", "zh", "en", "en"]
    row = spark.createDataFrame([("empty statement", "unknown words")], "a string, b string").select(translated("a", "zh"), translated("b", "zh"), translated("a", "en")).first()
    assert list(row) == ["空语句", "unknown words", "empty statement"]


def test_whole_parts_are_replaced_once(spark):
    rows = [("a = 5 and aa = 5 and a = 50", "a = 5", "X", "X and aa = 5 and a = 50"), ("xa = 5 and t.a = 5 and a = 5", "a = 5", "X", "xa = 5 and t.a = 5 and X"), ("a  =\n5", "a = 5", "$1\\", "$1\\"), ("b = 1", "a = 5", "X", "X"), ("a = '5$' or c", "a = '5$'", "Y", "Y or c"), ("a = 5.5", "a = 5", "X", "X"), ("x\\Ey a = 5", "\\Ey a = 5", "Z", "xZ")]
    got = spark.createDataFrame(rows, "s string, p string, b string, want string").select("s", "want", T.replaced_once(F.col("s"), F.col("p"), F.col("b")).alias("got")).collect()
    for r in got:
        assert r.got == r.want, r.s


def test_unique_index(spark):
    assert spark.range(1).select(T.add_index_ddl(F.lit("t"), F.array(F.lit("a")), True)).first()[0] == "ALTER TABLE `t` ADD UNIQUE INDEX `idx_t_a` (`a`);"


def test_clipped_texts(spark):
    texts = ["", "a" * 200, "a" * 201, "\n" * 300, "é" * 250, "日" * 199 + "xy"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(T.clipped("s")).collect()]
    assert got == [t if len(t) <= 200 else t[:199] + "…" for t in texts]


def test_catalogs_round_trip(spark):
    known = catalog.catalog_from_json(spark, json.dumps(SCHEMA))
    value = [r["value"] for r in catalog.catalog_json(known).collect()]
    assert catalog.catalog_from_json(spark, f'{{"tables": [{", ".join(value)}]}}').collect() == known.collect()


def test_seeded_tables(spark):
    tables = seed.shop(spark, 50)
    assert {n: t.count() for n, t in tables.items()} == {"orders": 50, "order_item": 100, "users": 5, "user_address": 45}
    assert tables["orders"].where("user_id NOT BETWEEN 1 AND 5 OR order_no IS NULL").isEmpty()
    assert seed.edge_rows(spark).count() == 10


def test_reports_are_bounded(spark):
    result = analyse(load(spark, SQL, "sql", inline=True))
    report = json.loads(sinks.report_json(result.findings, result.skipped, result.notes, result.records, most=1).first()[0])
    assert report["truncated"] and len(report["findings"]) == 1


def test_bursts_of_a_stream(spark, tmp_path):
    from datetime import datetime

    rows = [(datetime(2026, 1, 1, 0, m), f"select {m} from t") for m in (0, 2, 4, 30, 31)]
    events = spark.createDataFrame(rows, "ts timestamp, sql string")
    assert sorted(r.occurrences for r in bursts(events).collect()) == [2, 3]
    events.write.parquet(str(tmp_path / "in"))
    run = bursts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("bursts").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.occurrences for r in spark.table("bursts").collect()) == [2, 3]


def statement(rng):
    table, column = rng.choice("orders customer part ghost".split()), lambda: rng.choice("o_orderkey o_custkey o_orderstatus o_totalprice c_name p_size nothing".split())
    test = lambda: rng.choice(["{} = 5", "{} = 'x'", "{} > ?", "{} IN (1, 2)", "{} LIKE '%a'", "YEAR({}) = 2020", "{} IS NULL", "({} = 1 OR {} = 2)", "{} BETWEEN 1 AND 2", "NOT ({} = 3)"]).replace("{}", column())
    tests = f" {rng.choice(['AND', 'OR', 'AND'])} ".join(test() for _ in range(rng.randrange(1, 5)))
    return rng.choice([f"SELECT * FROM {table} WHERE {tests}", f"SELECT {column()} FROM {table} t WHERE {tests} ORDER BY {column()} LIMIT 20000, 5", f"UPDATE {table} SET a = 1 WHERE {tests}", f"DELETE FROM {table} WHERE {tests}", f"SELECT x FROM (SELECT {column()} AS x FROM {table} WHERE {tests}) d", f"SELECT * FROM {table} WHERE (({tests}", f"{tests} FROM"])


def test_no_statement_ends_the_run(spark):
    """Generated statements, whole and broken: every one is a record, and advice is complete SQL."""
    rng = random.Random(17)
    texts = [statement(rng) for _ in range(400)] + ["", ";", "'", "/*", "SELECT", "((((", "`", "SELECT * FROM", "\x00", "SELECT * FROM t WHERE a = '" + "x" * 20000]
    from querylode.sources.sql_text import records_from_texts

    records = records_from_texts(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, value string"))
    result = analyse(records, catalogue.orders_catalog(spark, "/root/testdata/sf0.001"))
    found = result.findings.collect()
    assert result.errors == [] and len(found) > 50
    for f in found:
        for ddl in f.ddl:
            assert ddl.startswith("ALTER TABLE `") and ddl.endswith(");") and ddl.count("(") == ddl.count(")")


@pytest.mark.parametrize("name", ["parse_kinds", "nested_or", "mapper_scan", "coverage"])
def test_named_queries_have_sql(name):
    assert name in catalogue.queries() and name in catalogue.oracle_sql()
