"""Named queries over the driver's tables, each with equivalent SQL.

The tables hold no SQL text, so workloads are made from their rows: every row becomes a statement, a log entry or a finding.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylode.analysis import analyse
from querylode.functions import text as T
from querylode.operators import findings as after
from querylode.operators import probes
from querylode.operators.buckets import buckets, statements
from querylode.operators.rules import Options, run_rules
from querylode.operators.workload import patterns, payoff, spread
from querylode.plans.parser import MERGED, parsed
from querylode.scratch import folder
from querylode.sources import seed, sinks
from querylode.sources.catalog import catalog_from_json, catalog_of_information_schema, catalog_of_tables, no_catalog
from querylode.sources.mapper import mapper_records, read_mappers, statements_from_texts
from querylode.sources.slow_log import read_slow_log, slow_events
from querylode.sources.sql_text import as_records, read_sql_files, records_from_texts
from querylode.streaming.windows import bursts, windowed_costs

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """The events as entries of a slow log."""
    sql = F.concat(F.lit("SELECT * FROM "), "event_type", F.lit(" WHERE user_id = "), F.col("user_id").cast("string"), F.lit(" LIMIT "), _k().cast("string"), F.lit(", 20"))
    return _t(spark, sf, "events").select(
        F.lit("events").alias("file"), F.col("event_id").alias("event_ord"), F.lit(1).alias("line"), "ts", F.col("value").cast("decimal(18,2)").cast("decimal(18,6)").alias("query_time"),
        F.lit(None).cast("decimal(18,6)").alias("lock_time"), F.lit(None).cast("bigint").alias("rows_sent"), _k().alias("rows_examined"), sql.alias("sql"), F.lit(False).alias("ignored"),
    )


LOG = """WITH log AS (SELECT event_id, ts, event_type, user_id, value::DECIMAL(18,2) AS query_time, (props->>'$.k')::BIGINT AS k,
  'SELECT * FROM ' || event_type || ' WHERE user_id = ' || user_id || ' LIMIT ' || (props->>'$.k') || ', 20' AS sql FROM events),
marked AS (SELECT *, 'select * from ' || lower(event_type) || ' where user_id=? limit ?,?' AS fingerprint FROM log)
"""


@query("fingerprint_rank", LOG + "SELECT fingerprint, count(*)::BIGINT AS occurrences, sum(query_time)::DOUBLE AS total_query_time, max(k) AS max_rows_examined, arg_min(sql, event_id) AS first_sql, first(k ORDER BY query_time DESC, event_id) AS worst_rows FROM marked GROUP BY 1")
def fingerprint_rank(spark, sf):
    found = patterns(event_log(spark, sf)).orderBy(F.desc("total_query_time"), "record_ord")
    return found.select("fingerprint", "occurrences", F.col("total_query_time").cast("double").alias("total_query_time"), "max_rows_examined", F.col("sql").alias("first_sql"), F.col("rows_examined").alias("worst_rows"))


@query("literal_mask", "SELECT o_orderkey, regexp_replace(regexp_replace('SELECT x FROM t1 WHERE k IN (' || o_orderkey || ', ' || o_custkey || ', 7) AND d > -5.5e3 AND s = ''' || o_orderstatus || ''' AND t_2024.a = ' || o_custkey, '''[^'']*''|-?\\b[0-9]+(\\.[0-9]+)?(e[0-9]+)?\\b', '?', 'g'), 'IN \\(\\?(, \\?)*\\)', 'IN (?)', 'g') AS masked FROM orders")
def literal_mask(spark, sf):
    text = F.concat(F.lit("SELECT x FROM t1 WHERE k IN ("), "o_orderkey", F.lit(", "), "o_custkey", F.lit(", 7) AND d > -5.5e3 AND s = '"), "o_orderstatus", F.lit("' AND t_2024.a = "), "o_custkey")
    return spread(_t(spark, sf, "orders")).select("o_orderkey", T.fold_in_lists(T.mask_literals(text)).alias("masked"))


@query("comment_strip", "SELECT p_partkey, 'SELECT ' || p_size || ' FROM p WHERE b = ''' || p_brand || ' -- x'' AND 1' AS bare FROM part")
def comment_strip(spark, sf):
    text = F.concat(F.lit("SELECT /* size */"), "p_size", F.lit(" FROM p # note\n WHERE b = '"), "p_brand", F.lit(" -- x' -- done\n AND 1 "))
    return _t(spark, sf, "part").select("p_partkey", F.regexp_replace(T.one_line(text), "SELECT +", "SELECT ").alias("bare"))


@query("evidence_clip", "WITH t AS (SELECT o_orderkey, repeat(o_orderpriority || ',', 30) AS x FROM orders) SELECT o_orderkey, CASE WHEN length(x) > 200 THEN x[1:199] || '…' ELSE x END AS evidence FROM t")
def evidence_clip(spark, sf):
    return spread(_t(spark, sf, "orders")).select("o_orderkey", T.evidence(F.repeat(F.concat("o_orderpriority", F.lit(",")), F.lit(30))).alias("evidence"))


@query("statement_split", "SELECT p_partkey, unnest([1, 2]) AS pos, unnest(['SELECT a FROM p WHERE k = ' || p_partkey, 'UPDATE p SET n = ''x;' || p_brand || ''' WHERE k = ' || p_partkey]) AS statement FROM part")
def statement_split(spark, sf):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("SELECT a FROM p WHERE k = "), k, F.lit(";\n -- two;\nUPDATE p SET n = 'x;"), "p_brand", F.lit("' WHERE k = "), k, F.lit(" ; # end"))
    found = records_from_texts(_t(spark, sf, "part").select(k.alias("file"), text.alias("value")))
    return found.select(F.col("file").cast("bigint").alias("p_partkey"), (F.col("record_ord") + 1).cast("int").alias("pos"), F.col("sql").alias("statement"))


_PLACED = """, placed AS (SELECT *, sum(4 + (event_id % 3 <> 1)::INT + (event_id % 2 = 0)::INT + (event_id % 5 = 0)::INT) OVER (PARTITION BY event_type ORDER BY event_id) AS upto FROM log)
"""


def log_text(spark: SparkSession, sf: str) -> DataFrame:
    """file, event_id, text: the events as lines of one log for each type. Every third event has no time line, every second a SET line, statements have two lines, and every fifth event is followed by an administrator command."""
    log = event_log(spark, sf).join(_t(spark, sf, "events").select(F.col("event_id").alias("event_ord"), "user_id", "event_type"), "event_ord")
    i = F.col("event_ord")
    text = F.concat_ws(
        "\n", F.when(i % 3 != 1, F.concat(F.lit("# Time: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))), F.concat(F.lit("# User@Host: app"), "user_id", F.lit("[app] @ db [10.0.0.1]  Id: 7")),
        F.concat(F.lit("# Query_time: "), F.col("query_time").cast("string"), F.lit("  Lock_time: 0.000100 Rows_sent: 1  Rows_examined: "), F.col("rows_examined").cast("string")),
        F.when(i % 2 == 0, F.concat(F.lit("SET timestamp="), i.cast("string"), F.lit(";"))), F.regexp_replace("sql", " LIMIT", "\nLIMIT"),
    )
    text = F.concat(text, F.lit(";"), F.when(i % 5 == 0, F.lit("\n# administrator command: Quit;")).otherwise(F.lit("")))
    return log.select(F.col("event_type").alias("file"), i.alias("event_id"), text.alias("text"))


@query("slowlog_parse", LOG.replace("marked AS", "unused AS").rstrip() + _PLACED + "SELECT event_type AS log, (upto - 1 - (event_id % 5 = 0)::INT)::BIGINT AS line, query_time::DOUBLE AS query_time, k AS rows_examined, 'app' || user_id AS app, CASE WHEN event_id % 3 <> 1 THEN ts END AS ts, replace(sql, ' LIMIT', chr(10) || 'LIMIT') AS sql FROM placed")
def slowlog_parse(spark, sf):
    texts = log_text(spark, sf)
    above = F.sum(F.size(F.split("text", "\n"))).over(Window.partitionBy("file").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    lines = texts.withColumn("above", F.coalesce(above, F.lit(0))).select("file", "above", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    found = slow_events(lines.select("file", (F.col("above") + F.col("pos") + 1).alias("line"), "text")).where("NOT ignored")
    return found.select(F.col("file").alias("log"), F.col("line").cast("bigint").alias("line"), F.col("query_time").cast("double").alias("query_time"), "rows_examined", F.col("user").alias("app"), F.col("ts").cast("timestamp").alias("ts"), "sql")


@query("slowlog_file", LOG + ", one AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM log) SELECT n * 4 AS line, query_time::DOUBLE AS query_time, k AS rows_examined, sql FROM one")
def slowlog_file(spark, sf):
    log = event_log(spark, sf)
    text = F.concat_ws("\n", F.concat(F.lit("# Time: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), F.lit("# User@Host: app[app] @ db []  Id: 7"), F.concat(F.lit("# Query_time: "), F.col("query_time").cast("string"), F.lit("  Lock_time: 0.1 Rows_sent: 1  Rows_examined: "), F.col("rows_examined").cast("string")), F.concat("sql", F.lit(";")))
    path = folder(spark, "slow-log")
    log.select("event_ord", text.alias("value")).coalesce(1).sortWithinPartitions("event_ord").select("value").write.text(path)  # one file, so that lines have numbers
    return read_slow_log(spark, path).where("NOT ignored").select(F.col("line").cast("bigint").alias("line"), F.col("query_time").cast("double").alias("query_time"), "rows_examined", "sql")


@query("sql_file_scan", "SELECT 3 * row_number() OVER (ORDER BY p_partkey) - 1 AS line, 'SELECT a FROM p' || chr(10) || 'WHERE k = ' || p_partkey || ' AND b = ''' || p_brand || ';''' AS statement FROM part")
def sql_file_scan(spark, sf):
    text = F.concat(F.lit("-- "), "p_brand", F.lit(";\nSELECT a FROM p\nWHERE k = "), F.col("p_partkey").cast("string"), F.lit(" AND b = '"), "p_brand", F.lit(";';"))
    path = folder(spark, "sql-file")
    _t(spark, sf, "part").select("p_partkey", text.alias("value")).coalesce(1).sortWithinPartitions("p_partkey").select("value").write.text(path)
    return read_sql_files(spark, path).select(F.col("line").cast("bigint").alias("line"), F.col("sql").alias("statement"))


@query("bursts", LOG + ", cut AS (SELECT *, ts - lag(ts) OVER (PARTITION BY fingerprint ORDER BY ts) >= INTERVAL 30 MINUTE AS gap FROM marked), numbered AS (SELECT *, sum(coalesce(gap, false)::INT) OVER (PARTITION BY fingerprint ORDER BY ts) AS burst FROM cut) SELECT min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, fingerprint, count(*)::BIGINT AS occurrences FROM numbered GROUP BY fingerprint, burst")
def burst_runs(spark, sf):
    return bursts(event_log(spark, sf), "30 minutes")


ROLES = [("where-eq", "c_nationkey"), ("where-in", "c_mktsegment"), ("where-range", "c_acctbal"), ("where-range", "c_name"), ("where-null", "c_phone"), ("join-on", "o_custkey"), ("join-on", "c_custkey")]


@query("parse_roles", "SELECT scope, col, (SELECT count(*) FROM customer)::BIGINT AS n FROM (VALUES " + ", ".join(f"('{s}', '{c}')" for s, c in ROLES) + ") v(scope, col)")
def parse_roles(spark, sf):
    sql = F.concat(
        F.lit("SELECT c.c_name FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = "), "c_nationkey", F.lit(" AND (c.c_mktsegment = '"), "c_mktsegment",
        F.lit("' OR c.c_mktsegment = 'X') AND c.c_acctbal BETWEEN "), F.col("c_acctbal").cast("string"), F.lit(" AND 5 AND c.c_name LIKE '%x' AND c.c_phone IS NULL"),
    )
    refs = spread(_t(spark, sf, "customer")).select(F.explode(F.get(parsed(sql), F.lit(0))["columns"]).alias("r"))
    return refs.groupBy(F.col("r.scope").alias("scope"), F.col("r.column").alias("col")).agg(F.count("*").alias("n"))


@query("subquery_fold", "SELECT * FROM (SELECT 'outer' AS part, count(*)::BIGINT AS records, sum(1)::BIGINT AS occurrences FROM part UNION ALL SELECT 'body', count(DISTINCT p_brand)::BIGINT, count(*)::BIGINT FROM part)")
def subquery_fold(spark, sf):
    sql = F.concat(F.lit("SELECT a FROM p"), F.col("p_partkey").cast("string"), F.lit(" WHERE b IN (SELECT b FROM t"), F.translate("p_brand", "0123456789# ", "abcdefghij__"), F.lit("x WHERE z = 1)"))
    records = as_records(_t(spark, sf, "part").select(sql.alias("sql"), T.fingerprint(sql).alias("fingerprint"), F.col("p_partkey").alias("record_ord"), F.lit(1).alias("occurrences")))
    read = statements(records).groupBy(F.when(F.col("parsed.subquery"), "body").otherwise("outer").alias("part"))
    return read.agg(F.count("*").alias("records"), F.sum("occurrences").alias("occurrences"))


@query("advice_without_catalog", LOG + "SELECT 'SIA001' AS rule, 'info' AS severity, event_type AS tbl, 'ALTER TABLE `' || event_type || '` ADD INDEX `idx_' || event_type || '_user_id` (`user_id`);' AS ddl, count(*)::BIGINT AS occurrences FROM log GROUP BY event_type")
def advice_without_catalog(spark, sf):
    found = analyse(as_records(patterns(event_log(spark, sf)))).findings
    return found.select("rule", "severity", F.col("table").alias("tbl"), F.array_join("ddl", " ").alias("ddl"), "occurrences")


def orders_catalog(spark: SparkSession, sf: str) -> DataFrame:
    tables = {n: _t(spark, sf, n) for n in ("orders", "customer", "part")}
    snapshot = json.loads(catalog_of_tables(tables, {"orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"]}))
    for t in snapshot["tables"]:
        if t["name"] == "orders":
            t["indexes"].append({"name": "idx_cust", "columns": ["o_custkey", "o_orderstatus", "o_orderdate"]})
    return catalog_from_json(spark, json.dumps(snapshot))


def _of_orders(spark: SparkSession, sf: str, sql: Column, options: Options = Options(), rows: int | None = None) -> DataFrame:
    """Findings of one statement for each order, by pattern."""
    source = _t(spark, sf, "orders").select(sql.alias("sql"), F.lit("orders").alias("file"), F.col("o_orderkey").alias("event_ord"), F.lit(1).alias("line"), F.lit(False).alias("ignored"), F.lit("1").cast("decimal(18,6)").alias("query_time"), F.lit(None).cast("decimal(18,6)").alias("lock_time"), F.lit(None).cast("bigint").alias("rows_sent"), F.lit(rows).cast("bigint").alias("rows_examined"))
    read = statements(as_records(patterns(source)))
    return run_rules(buckets(read, orders_catalog(spark, sf)), options, True)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("rule", "severity", F.col("table").alias("tbl"), F.array_join("ddl", " ").alias("ddl"), "rewrite", "occurrences")


#: What the first order has: it is the statement that stands for its pattern.
_FIRST = "(SELECT {} FROM orders ORDER BY o_orderkey LIMIT 1)"
_ONE = "SELECT '{rule}' AS rule, '{severity}' AS severity, 'orders' AS tbl, {ddl} AS ddl, {rewrite} AS rewrite, count(*)::BIGINT AS occurrences FROM orders"


@query("leftmost_gap", _ONE.format(rule="SIA003", severity="warn", ddl="'ALTER TABLE `orders` ADD INDEX `idx_orders_o_custkey_o_orderdate` (`o_custkey`, `o_orderdate`);'", rewrite="NULL::VARCHAR"))
def leftmost_gap(spark, sf):
    sql = F.concat(F.lit("SELECT o_orderkey FROM orders WHERE o_custkey = "), F.col("o_custkey").cast("string"), F.lit(" AND o_orderdate > '2020-01-01'"))
    return _shown(_of_orders(spark, sf, sql, Options(rules=("SIA003",))))


@query("covering_extension", _ONE.format(rule="SIA007", severity="error", ddl="'ALTER TABLE `orders` ADD INDEX `idx_orders_o_custkey_o_orderstatus_o_orderdate_o_totalprice` (`o_custkey`, `o_orderstatus`, `o_orderdate`, `o_totalprice`);'", rewrite="NULL::VARCHAR"))
def covering_extension(spark, sf):
    sql = F.concat(F.lit("SELECT o_totalprice FROM orders WHERE o_orderstatus = '"), "o_orderstatus", F.lit("' AND o_custkey = "), F.col("o_custkey").cast("string"))
    return _shown(_of_orders(spark, sf, sql, Options(rules=("sia007",)), 1_000_000))


@query("implicit_cast_detect", _ONE.format(rule="SIA005", severity="error", ddl="''", rewrite=f"'SELECT o_orderkey FROM orders WHERE xo_orderpriority = 57 AND o_orderpriority = ''5'' AND o_custkey = ' || {_FIRST.format('o_custkey')} || ' AND o_orderpriority = 57'"))
def implicit_cast_detect(spark, sf):
    sql = F.concat(F.lit("SELECT o_orderkey FROM orders WHERE xo_orderpriority = 57 AND o_orderpriority = 5 AND o_custkey = "), "o_custkey", F.lit(" AND o_orderpriority = 57"))
    return _shown(_of_orders(spark, sf, sql, Options(rules=("SIA005",))).where(F.col("message").contains("o_orderpriority = 5 ")))


@query("missing_index_advice", _ONE.format(rule="SIA001", severity="error", ddl="'ALTER TABLE `orders` ADD INDEX `idx_orders_o_orderstatus_o_orderdate_o_totalprice` (`o_orderstatus`, `o_orderdate`, `o_totalprice`);'", rewrite="NULL::VARCHAR"))
def missing_index_advice(spark, sf):
    sql = F.concat(F.lit("SELECT * FROM orders o WHERE o.o_totalprice > "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" AND o.o_orderstatus = '"), "o_orderstatus", F.lit("' ORDER BY o.o_orderdate DESC"))
    return _shown(_of_orders(spark, sf, sql, Options(rules=("SIA001",))))


@query("prefix_index_advice", _ONE.format(rule="SIA002", severity="warn", ddl="'ALTER TABLE `orders` ADD INDEX `idx_orders_o_orderpriority` (`o_orderpriority`(128));'", rewrite="NULL::VARCHAR"))
def prefix_index_advice(spark, sf):
    sql = F.concat(F.lit("SELECT 1 FROM orders WHERE o_orderpriority = '"), "o_orderpriority", F.lit("'"))
    return _shown(_of_orders(spark, sf, sql, Options(rules=("SIA002",), prefix_bytes=1000)))


@query("deep_pagination_advice", _ONE.format(rule="SIA006", severity="warn", ddl="''", rewrite="'SELECT t.`o_orderkey`, t.`o_totalprice` FROM (SELECT `o_orderkey` FROM `orders` WHERE o_custkey = ' || " + _FIRST.format("o_custkey") + " || ' ORDER BY o_totalprice DESC LIMIT ' || " + _FIRST.format("50000 + o_orderkey") + " || ', 10) AS page JOIN `orders` t ON t.`o_orderkey` = page.`o_orderkey` ORDER BY t.`o_totalprice` DESC;'"))
def deep_pagination_advice(spark, sf):
    sql = F.concat(F.lit("SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_custkey = "), "o_custkey", F.lit(" ORDER BY o.o_totalprice DESC LIMIT "), (F.col("o_orderkey") + 50000).cast("string"), F.lit(", 10"))
    return _shown(_of_orders(spark, sf, sql, Options(rules=("SIA006",))))


@query("sargable_rewrites", "SELECT * FROM (VALUES ('DATE(o_orderdate) = ''1995-03-15''', 'o_orderdate >= ''1995-03-15 00:00:00'' AND o_orderdate < ''1995-03-16 00:00:00'''), ('YEAR(o_orderdate) = 1995', 'o_orderdate >= ''1995-01-01 00:00:00'' AND o_orderdate < ''1996-01-01 00:00:00'''), ('LEFT(o_orderpriority, 3) = ''1-U''', 'o_orderpriority LIKE ''1-U%'''), ('o_orderkey + 1 = 5', 'o_orderkey = 4'), ('DATE(o_orderdate) = ?', 'o_orderdate >= DATE(?) AND o_orderdate < DATE(?) + INTERVAL 1 DAY'), ('LEFT(o_orderpriority, 4) = ''1-U''', NULL), ('DATE(o_orderdate) = ''1995-03-15 10:00:00''', NULL)) v(predicate, rewrite)")
def sargable_rewrites(spark, sf):
    predicates = ["DATE(o_orderdate) = '1995-03-15'", "YEAR(o_orderdate) = 1995", "LEFT(o_orderpriority, 3) = '1-U'", "o_orderkey + 1 = 5", "DATE(o_orderdate) = ?", "LEFT(o_orderpriority, 4) = '1-U'", "DATE(o_orderdate) = '1995-03-15 10:00:00'"]
    texts = spark.createDataFrame([(p, f"SELECT * FROM orders WHERE {p}") for p in predicates], "file string, value string")
    found = run_rules(buckets(statements(records_from_texts(texts)), orders_catalog(spark, sf)), Options(rules=("SIA004",)), True)
    return found.select(F.col("file").alias("predicate"), "rewrite")


@query("catalog_join", "SELECT * FROM (VALUES ('customer', 'c_name', 'varchar', 1020.0::DOUBLE), ('orders', 'o_orderdate', 'datetime', 8.0), ('orders', 'nothing', NULL, NULL), ('part', 'p_size', 'int', 4.0)) v(tbl, col, kind, key_bytes)")
def catalog_join(spark, sf):
    wanted = spark.createDataFrame([("Customer", "c_name"), ("orders", "o_orderdate"), ("orders", "nothing"), ("PART", "p_size")], "t string, col string").withColumn("tbl", F.lower("t"))
    columns = orders_catalog(spark, sf).select(F.col("name").alias("tbl"), "charset", F.explode("columns").alias("c")).select("tbl", F.col("c.name").alias("col"), F.col("c.type").alias("kind"), T.key_bytes(F.col("c.type"), F.col("c.length"), F.col("charset")).alias("key_bytes"))
    return wanted.join(columns, ["tbl", "col"], "left").select("tbl", "col", "kind", "key_bytes")


@query("prefix_selectivity", "SELECT 'part' AS tbl, count(DISTINCT left(p_name, 6)) / count(DISTINCT p_name)::DOUBLE AS ratio FROM part UNION ALL SELECT 'customer', count(DISTINCT left(c_name, 14)) / count(DISTINCT c_name)::DOUBLE FROM customer")
def prefix_selectivity(spark, sf):
    return probes.prefix_selectivity(_t(spark, sf, "part"), "p_name", 6).select(F.lit("part").alias("tbl"), "ratio").unionByName(probes.prefix_selectivity(_t(spark, sf, "customer"), "c_name", 14).select(F.lit("customer").alias("tbl"), "ratio"))


@query("flag_selectivity", "SELECT 'orders' AS tbl, count(DISTINCT (o_orderstatus, o_orderpriority)) / count(*)::DOUBLE AS ratio FROM orders UNION ALL SELECT 'lineitem', count(DISTINCT (l_returnflag, l_linestatus)) / count(*)::DOUBLE FROM lineitem")
def flag_selectivity(spark, sf):
    return probes.selectivity(_t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select(F.lit("orders").alias("tbl"), "ratio").unionByName(probes.selectivity(_t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select(F.lit("lineitem").alias("tbl"), "ratio"))


EQUIVALENCES = {
    "date": ("orders", "to_date(o_orderdate) = DATE '1995-03-15'", "o_orderdate >= TIMESTAMP '1995-03-15 00:00:00' AND o_orderdate < TIMESTAMP '1995-03-16 00:00:00'", "o_orderdate::DATE = DATE '1995-03-15'"),
    "year": ("lineitem", "year(l_shipdate) = 1995", "l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00'", None),
    "left": ("orders", "left(o_orderpriority, 3) = '1-U'", "o_orderpriority LIKE '1-U%'", None),
    "arithmetic": ("lineitem", "l_orderkey + 1 > 500", "l_orderkey > 499", None),
    "dead date": ("events", "CAST(to_date(ts) AS TIMESTAMP) = TIMESTAMP '2024-01-05 10:00:00'", "false", "(ts::DATE)::TIMESTAMP = TIMESTAMP '2024-01-05 10:00:00'"),
    "or": ("orders", "o_orderstatus = 'F' OR o_orderstatus = 'P'", "o_orderstatus IN ('F', 'P')", None),
}


@query("rewrite_equivalence", " UNION ALL ".join(f"SELECT '{n}' AS shape, count(*) FILTER (WHERE {d or b})::BIGINT AS n_before, count(*) FILTER (WHERE {a})::BIGINT AS n_after, count(*) FILTER (WHERE coalesce({d or b}, false) <> coalesce({a}, false))::BIGINT AS n_differ FROM {t}" for n, (t, b, a, d) in EQUIVALENCES.items()))
def rewrite_equivalence(spark, sf):
    out = None
    for name, (table, before, rewritten, _) in EQUIVALENCES.items():
        one = probes.differences(_t(spark, sf, table), F.expr(before), F.expr(rewritten), "").select(F.lit(name).alias("shape"), "n_before", "n_after", "n_differ")
        out = one if out is None else out.unionByName(one)
    return out


_PAGE = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20 OFFSET "


@query("deep_page_offset", _PAGE + "1000")
def deep_page_offset(spark, sf):
    return probes.page_by_offset(_t(spark, sf, "orders"), [F.desc("o_totalprice"), F.desc("o_orderkey")], 1000, 20).select("o_orderkey", "o_totalprice")


@query("deferred_join", _PAGE + "1000")
def deferred_join(spark, sf):
    return probes.page_by_join(_t(spark, sf, "orders"), "o_orderkey", [F.desc("o_totalprice"), F.desc("o_orderkey")], 1000, 20, "o_totalprice").select("o_orderkey", "o_totalprice")


@query("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 250000 OR o_totalprice = 250000 AND o_orderkey < 100 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20")
def keyset_page(spark, sf):
    return probes.page_after(_t(spark, sf, "orders"), "o_totalprice", "o_orderkey", 250000.0, 100, 20).select("o_orderkey", "o_totalprice")


@query("or_to_union_all", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'P' OR o_totalprice < 2000")
def or_to_union_all(spark, sf):
    return probes.union_of_alternatives(_t(spark, sf, "orders"), F.col("o_custkey") == 7, F.col("o_orderstatus") == "P", F.col("o_totalprice") < 2000).select("o_orderkey")


@query("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_exists(spark, sf):
    return probes.with_match(_t(spark, sf, "customer"), _t(spark, sf, "orders").where("o_totalprice > 100000"), F.expr("c_custkey = o_custkey")).select("c_custkey")


@query("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_not_exists(spark, sf):
    return probes.without_match(_t(spark, sf, "customer"), _t(spark, sf, "orders").where("o_totalprice > 200000"), F.expr("c_custkey = o_custkey")).select("c_custkey")


def derived_findings(spark: SparkSession, sf: str) -> DataFrame:
    """A finding for each part: the table is its brand, the columns depend on its size, and it costs its price."""
    a, b, c = F.lit("a"), F.lit("b"), F.lit("c")
    shape = F.col("p_size") % 5
    columns = F.when(shape == 0, F.array(a)).when(shape == 1, F.array(a, b)).when(shape == 2, F.array(b, a)).when(shape == 3, F.array(a, b, c)).otherwise(F.array(b))
    return _t(spark, sf, "part").select(
        F.lit("SIA001").alias("rule"), F.when(F.col("p_size") % 3 == 0, "error").otherwise("warn").alias("severity"), F.concat(F.lit("stmt"), (F.col("p_size") % 10).cast("string")).alias("fingerprint"),
        F.lit(None).cast("double").alias("query_time"), (F.col("p_retailprice") * 100).cast("bigint").alias("rows_examined"), F.lit(1).cast("bigint").alias("occurrences"),
        F.regexp_replace("p_brand", "#", "_").alias("table"), F.array(T.add_index_ddl(F.regexp_replace("p_brand", "#", "_"), columns)).alias("ddl"), F.lit(None).cast("string").alias("rewrite"), columns.alias("index_columns"),
        F.col("p_partkey").alias("record_ord"), F.lit(0).alias("body_ord"), F.lit(0).alias("table_ord"), F.lit(0).alias("part"), F.lit("m").alias("message"),
        F.concat(F.lit("/w/a,"), "p_brand", F.lit(".sql")).alias("file"), F.col("p_size").cast("int").alias("line"),
    )


DERIVED = """WITH d AS (SELECT p_partkey, replace(p_brand, '#', '_') AS tbl, CASE WHEN p_size % 3 = 0 THEN 'error' ELSE 'warn' END AS severity, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS sev,
  'stmt' || (p_size % 10) AS fp, CASE p_size % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'a,b' WHEN 2 THEN 'b,a' WHEN 3 THEN 'a,b,c' ELSE 'b' END AS cols, round(CAST(trunc(p_retailprice * 100) AS BIGINT) / 1e6 + 1, 9) AS payoff FROM part),
u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY tbl, fp, cols ORDER BY sev DESC, p_partkey) = 1)
"""


@query("dedup_findings", DERIVED + "SELECT tbl, fp, cols, severity, p_partkey AS record_ord FROM u")
def dedup_findings(spark, sf):
    return after.deduplicated(derived_findings(spark, sf)).select(F.col("table").alias("tbl"), F.col("fingerprint").alias("fp"), F.array_join("index_columns", ",").alias("cols"), "severity", "record_ord")


@query("redundant_index_drop", DERIVED + ", s AS (SELECT *, list_sort(string_split(cols, ',')) AS cset FROM u QUALIFY row_number() OVER (PARTITION BY tbl, list_sort(string_split(cols, ',')) ORDER BY sev DESC, payoff DESC, p_partkey) = 1) SELECT tbl, cols, severity, p_partkey AS record_ord FROM s n WHERE NOT EXISTS (SELECT 1 FROM s w WHERE w.tbl = n.tbl AND length(w.cols) > length(n.cols) AND starts_with(w.cols, n.cols || ','))")
def redundant_index_drop(spark, sf):
    found = after.without_redundant(after.with_payoff(after.deduplicated(derived_findings(spark, sf))))
    return found.select(F.col("table").alias("tbl"), F.array_join("index_columns", ",").alias("cols"), "severity", "record_ord")


@query("payoff_rank", LOG + "SELECT event_id, round(query_time::DOUBLE * k * 3 + k / 1e6 + 3, 6) AS payoff FROM log")
def payoff_rank(spark, sf):
    return event_log(spark, sf).select(F.col("event_ord").alias("event_id"), F.round(payoff(F.col("query_time"), F.col("rows_examined"), F.lit(3)), 6).alias("payoff"))


@query("severity_summary", DERIVED + "SELECT count(*) FILTER (WHERE severity = 'error')::BIGINT AS error, count(*) FILTER (WHERE severity = 'warn')::BIGINT AS warn, 0::BIGINT AS info FROM u")
def severity_summary(spark, sf):
    return after.severity_counts(after.deduplicated(derived_findings(spark, sf)))


@query("skip_accounting", "WITH n AS (SELECT count(DISTINCT event_type)::BIGINT AS n FROM events) SELECT rule, 'needs a catalog to know existing indexes' AS reason, n AS count, n AS total FROM n, (VALUES ('SIA002'), ('SIA003'), ('SIA005'), ('SIA007')) v(rule)")
def skip_accounting(spark, sf):
    return analyse(as_records(patterns(event_log(spark, sf)))).skipped


@query("migration_ddl", DERIVED + ", b AS (SELECT tbl, cols, arg_max(severity, sev) AS severity FROM u GROUP BY 1, 2) SELECT '-- SIA001 ' || severity || ': m' || chr(10) || 'ALTER TABLE `' || tbl || '` ADD INDEX `idx_' || lower(tbl) || '_' || replace(cols, ',', '_') || '` (`' || replace(cols, ',', '`, `') || '`);' AS value FROM b")
def migration_ddl(spark, sf):
    return sinks.migration(after.with_payoff(after.deduplicated(derived_findings(spark, sf))))


@query("windowed_fingerprint", LOG + "SELECT date_trunc('day', ts) AS window_start, fingerprint, count(*)::BIGINT AS occurrences, sum(query_time)::DOUBLE AS total_query_time, max(k) AS max_rows_examined FROM marked GROUP BY 1, 2")
def windowed_fingerprint(spark, sf):
    found = windowed_costs(event_log(spark, sf), "1 day")
    return found.withColumn("total_query_time", F.col("total_query_time").cast("double"))


@query("catalog_dump", "SELECT * FROM (VALUES ('customer', 'c_custkey', 1), ('customer', 'c_name', 2), ('customer', 'c_nationkey', 3), ('customer', 'c_acctbal', 4), ('customer', 'c_mktsegment', 5)) v(tbl, col, pos)")
def catalog_dump(spark, sf):
    dumped = catalog_from_json(spark, catalog_of_tables({"customer": _t(spark, sf, "customer")}))
    return dumped.select(F.col("name").alias("tbl"), F.posexplode("columns").alias("i", "c")).select("tbl", F.col("c.name").alias("col"), (F.col("i") + 1).alias("pos"))


def _per(spark: SparkSession, sf: str, table: str, key: str, *choices: Column) -> DataFrame:
    """k, sql: a statement for each row of a table, of the choices in turn."""
    sql = choices[-1]
    for i, choice in reversed(list(enumerate(choices[:-1]))):
        sql = F.when(F.col(key) % len(choices) == i, choice).otherwise(sql)
    return _t(spark, sf, table).select(F.col(key).cast("bigint").alias("k"), "*", sql.alias("sql"))


def _refs(read: DataFrame, *columns: str) -> DataFrame:
    """How often each scope and column occurs in parsed statements."""
    refs = read.select(*columns, F.explode("p.columns").alias("r"))
    return refs.groupBy(*columns, F.col("r.scope").alias("scope"), F.col("r.column").alias("col")).agg(F.count("*").alias("n"))


_KINDS = ("CASE n_nationkey % 6 " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(6)) + " END").format


@query("parse_kinds", f"SELECT n_nationkey::BIGINT AS k, {_KINDS(*[repr(x) for x in ('select', 'update', 'delete', 'insert', 'insert', 'select')])} AS kind, 't' || n_regionkey AS tbl, {_KINDS(1, 2, 1, 0, 0, 1)}::BIGINT AS predicates, {_KINDS(repr('n_name'), *[repr('')] * 5)} AS grouping, {_KINDS(repr('n_key desc'), *[repr('')] * 5)} AS ordering FROM nation")
def parse_kinds(spark, sf):
    k, t = F.col("n_nationkey").cast("string"), F.concat(F.lit("t"), F.col("n_regionkey").cast("string"))
    source = _per(
        spark, sf, "nation", "n_nationkey", F.concat(F.lit("SELECT n_name, count(*) FROM "), t, F.lit(" WHERE n_key = "), k, F.lit(" GROUP BY n_name ORDER BY n_key DESC")),
        F.concat(F.lit("UPDATE "), t, F.lit(" SET n_name = 'x' WHERE n_key = "), k, F.lit(" AND a > 1 LIMIT 5")), F.concat(F.lit("DELETE FROM "), t, F.lit(" WHERE n_key = "), k),
        F.concat(F.lit("INSERT INTO "), t, F.lit(" (a, b) SELECT x, y FROM r WHERE z = "), k), F.concat(F.lit("REPLACE INTO "), t, F.lit(" VALUES ("), k, F.lit(")")), F.concat(F.lit("SELECT a FROM "), t, F.lit(" WHERE n_key = "), k, F.lit(" UNION ALL SELECT b FROM r WHERE z = 1 AND y = 2")),
    )
    p = source.withColumn("p", F.get(parsed("sql"), F.lit(0)))
    conditions = F.size(F.filter("p.columns", lambda c: c["scope"].startswith("where"))).cast("bigint")
    ordering = F.array_join(F.transform("p.order_by", lambda c: F.concat(c["column"], F.when(c["desc"], " desc").otherwise(""))), ",")
    return p.select("k", "p.kind", F.get("p.tables", F.lit(0))["name"].alias("tbl"), conditions.alias("predicates"), F.array_join(F.transform("p.group_by", lambda c: c["column"]), ",").alias("grouping"), ordering.alias("ordering"))


@query("merged_refused", "SELECT p_partkey::BIGINT AS k, 1 + p_partkey % 2 AS statements, 1 - p_partkey % 2 AS refused FROM part")
def merged_refused(spark, sf):
    texts = _t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("file"), F.concat(F.lit("SELECT a FROM t1 WHERE x = "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 1, ";").otherwise(""), F.lit("\nUPDATE t2 SET b = 1")).alias("value"))
    read = records_from_texts(texts).select("file", F.get(parsed("sql"), F.lit(0)).alias("p"))
    return read.groupBy(F.col("file").cast("bigint").alias("k")).agg(F.count("*").alias("statements"), F.count_if(F.array_contains("p.notes", MERGED)).alias("refused"))


@query("derived_bodies", "SELECT '' AS tbl, 'where-eq x' AS refs, count(*)::BIGINT AS occurrences FROM customer UNION ALL SELECT 't' || c_nationkey, 'where-eq o_status', count(*)::BIGINT FROM customer GROUP BY c_nationkey")
def derived_bodies(spark, sf):
    sql = F.concat(F.lit("SELECT x FROM (SELECT o_key AS x FROM t"), "c_nationkey", F.lit(" WHERE o_status = '"), "c_mktsegment", F.lit("') d WHERE d.x = "), F.col("c_custkey").cast("string"))
    records = as_records(_t(spark, sf, "customer").select(sql.alias("sql"), T.fingerprint(sql).alias("fingerprint"), F.col("c_custkey").alias("record_ord"), F.lit(1).alias("occurrences")))
    refs = F.array_join(F.transform("parsed.columns", lambda c: F.concat_ws(" ", c["scope"], c["column"])), ",")
    read = statements(records).select(F.coalesce(F.get("parsed.tables", F.lit(0))["name"], F.lit("")).alias("tbl"), refs.alias("refs"), "occurrences")
    return read.groupBy("tbl", "refs").agg(F.sum("occurrences").alias("occurrences"))


@query("exists_bodies", "SELECT subquery, scope, col, n FROM (SELECT false AS subquery, 'where-eq' AS scope, 'c_nationkey' AS col, count(*)::BIGINT AS n FROM customer UNION ALL SELECT true, 'where-eq', 'o_key', count(*)::BIGINT FROM customer UNION ALL SELECT true, 'where-eq', CASE WHEN c_custkey % 2 = 0 THEN 'o_a' ELSE 'o_b' END, count(*)::BIGINT FROM customer GROUP BY c_custkey % 2)")
def exists_bodies(spark, sf):
    body = lambda column: F.concat(F.lit(f"EXISTS (SELECT 1 FROM o WHERE o_key = c_key AND {column} = '"), "c_mktsegment", F.lit("') AND c_nationkey = "), "c_nationkey")
    source = _per(spark, sf, "customer", "c_custkey", F.concat(F.lit("SELECT c_name FROM c WHERE "), body("o_a")), F.concat(F.lit("SELECT c_name FROM c WHERE NOT "), body("o_b")))
    read = source.select(F.explode(parsed("sql")).alias("p"))
    return _refs(read.select("p", F.col("p.subquery").alias("subquery")), "subquery")


@query("using_join", "SELECT 'join-on' AS scope, 'k' AS col, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'join-on', 'k' || n_regionkey, count(*)::BIGINT FROM nation GROUP BY n_regionkey UNION ALL SELECT 'where-eq', 'x', count(*)::BIGINT FROM nation")
def using_join(spark, sf):
    sql = F.concat(F.lit("SELECT * FROM orders o JOIN lineitem l USING (k, k"), "n_regionkey", F.lit(") WHERE o.x = "), "n_nationkey")
    return _refs(_t(spark, sf, "nation").select(F.get(parsed(sql), F.lit(0)).alias("p")))


@query("nested_or", "SELECT 'where-or' AS scope, unnest(['a', 'b', 'c' || n_regionkey, 'd']) AS col, count(*)::BIGINT AS n FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey, n_nationkey % 2 UNION ALL SELECT unnest(['where-in', 'where-eq']), unnest(['a' || n_regionkey, 'b']), count(*)::BIGINT FROM nation WHERE n_nationkey % 2 = 1 GROUP BY n_regionkey".replace("SELECT 'where-or'", "SELECT scope, col, sum(n)::BIGINT AS n FROM (SELECT 'where-or'", 1) + ") GROUP BY 1, 2")
def nested_or(spark, sf):
    r, k = F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")
    either = F.concat(F.lit("SELECT x FROM t WHERE (a = 1 AND (b = 2 OR c"), r, F.lit(" = "), k, F.lit(")) OR d = 4"))
    one = F.concat(F.lit("SELECT x FROM t WHERE (a"), r, F.lit(" = 1 OR (a"), r, F.lit(" = 2 OR a"), r, F.lit(" = "), k, F.lit(")) AND b = 4"))
    return _refs(_per(spark, sf, "nation", "n_nationkey", either, one).select(F.get(parsed("sql"), F.lit(0)).alias("p")))


@query("degraded_statements", "SELECT CASE p_partkey % 4 WHEN 2 THEN 'select' ELSE 'unknown' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'truncate statements are not analysed' WHEN 1 THEN 'empty statement' WHEN 2 THEN '' ELSE 'call statements are not analysed' END AS note, count(*)::BIGINT AS n FROM part GROUP BY p_partkey % 4")
def degraded_statements(spark, sf):
    k = F.col("p_partkey").cast("string")
    source = _per(spark, sf, "part", "p_partkey", F.concat(F.lit("TRUNCATE p"), k), F.lit("((("), F.concat(F.lit("SELECT * FROM t WHERE a = 'open AND b = "), k), F.concat(F.lit("CALL f("), k))
    read = source.select(F.get(parsed("sql"), F.lit(0)).alias("p"))
    return read.groupBy("p.kind", F.array_join("p.notes", "; ").alias("note")).agg(F.count("*").alias("n"))


def mapper_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A mapper file for each nation."""
    xml = F.concat(
        F.lit('<mapper namespace="m.'), "n_name", F.lit('">\n<sql id="cols">id, <choose><when test="x">a'), "n_regionkey", F.lit("</when><otherwise>b</otherwise></choose></sql>\n"),
        F.lit('<select id="page" parameterType="Q">SELECT <include refid="cols"/> FROM t'), "n_nationkey", F.lit(' <where><if test="a">AND kind = #{a}</if> <if test="b">AND id IN <foreach open="(" close=")">#{i}</foreach></if></where></select>\n'),
        F.lit('<update id="up">UPDATE t <set><if test="a">kind = #{a},</if></set> WHERE made &lt; #{m}</update>\n'), F.when(F.col("n_nationkey") % 5 == 0, F.lit('<delete id="old">DELETE FROM t WHERE a = ${raw}</delete>\n')).otherwise(""), F.lit("</mapper>"),
    )
    return _t(spark, sf, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".xml")).alias("file"), xml.alias("value"))


@query("mapper_scan", """WITH v AS (SELECT n_nationkey || '.xml' AS file, 'm.' || n_name AS namespace, n_regionkey AS r, n_nationkey AS k FROM nation)
SELECT file, namespace, 'page#when[0]' AS id, 3 AS line, 'SELECT id, a' || r || ' FROM t' || k || ' WHERE kind = ? AND id IN ( ? )' AS sql FROM v UNION ALL
SELECT file, namespace, 'page#otherwise', 3, 'SELECT id, b FROM t' || k || ' WHERE kind = ? AND id IN ( ? )' FROM v UNION ALL SELECT file, namespace, 'up', 4, 'UPDATE t SET kind = ? WHERE made < ?' FROM v UNION ALL SELECT file, namespace, 'old', 5, 'DELETE FROM t WHERE a = ?' FROM v WHERE k % 5 = 0""")
def mapper_scan(spark, sf):
    return mapper_records(statements_from_texts(mapper_texts(spark, sf))).select("file", "namespace", F.col("statement_id").alias("id"), "line", "sql")


@query("note_histogram", "SELECT 'a part of the statement is built at run time (${})' AS note, count(*)::BIGINT AS count FROM nation WHERE n_nationkey % 5 = 0")
def note_histogram(spark, sf):
    return after.notes(statements(mapper_records(statements_from_texts(mapper_texts(spark, sf)))))


@query("already_covered", "SELECT 'orders' AS tbl, 'o_orderpriority' AS cols, count(*)::BIGINT AS occurrences FROM orders WHERE o_orderkey % 3 = 2")
def already_covered(spark, sf):
    status = F.concat(F.lit("SELECT * FROM orders WHERE o_custkey = "), "o_custkey", F.lit(" AND o_orderstatus = '"), "o_orderstatus", F.lit("'"))
    lookup = F.concat(F.lit("SELECT * FROM orders WHERE o_orderkey = "), "o_orderkey")
    free = F.concat(F.lit("SELECT * FROM orders WHERE o_orderpriority = '"), "o_orderpriority", F.lit("'"))
    sql = F.when(F.col("o_orderkey") % 3 == 0, status).when(F.col("o_orderkey") % 3 == 1, lookup).otherwise(free)
    return _of_orders(spark, sf, sql, Options(rules=("SIA001",))).select(F.col("table").alias("tbl"), F.array_join("index_columns", ",").alias("cols"), "occurrences")


@query("severity_gate", "SELECT 'orders' AS tbl, 'error' AS severity, count(*)::BIGINT AS occurrences FROM orders WHERE o_orderkey % 2 = 0")
def severity_gate(spark, sf):
    named = lambda table: F.concat(F.lit(f"SELECT * FROM {table} WHERE o_totalprice > "), F.col("o_custkey").cast("string"))
    found = _of_orders(spark, sf, F.when(F.col("o_orderkey") % 2 == 0, named("orders")).otherwise(named("elsewhere_")), Options(rules=("SIA001",), min_severity="warn"))
    return found.select(F.col("table").alias("tbl"), "severity", "occurrences")


@query("functional_index", _ONE.format(rule="SIA004", severity="error", ddl="'ALTER TABLE `orders` ADD INDEX `idx_orders_o_orderdate` ((YEAR(o_orderdate)));'", rewrite="(SELECT 'o_orderdate >= ''' || y || '-01-01 00:00:00'' AND o_orderdate < ''' || (y + 1) || '-01-01 00:00:00''' FROM (SELECT year(o_orderdate) AS y FROM orders ORDER BY o_orderkey LIMIT 1))"))
def functional_index(spark, sf):
    sql = F.concat(F.lit("SELECT * FROM orders o WHERE YEAR(o.o_orderdate) = "), F.year("o_orderdate").cast("string"))
    return _shown(_of_orders(spark, sf, sql, Options(rules=("SIA004",)))).withColumn("rewrite", F.replace("rewrite", F.lit("o.o_"), F.lit("o_")))


@query("equality_roles", "SELECT n_nationkey::BIGINT AS k, 'o_s' || n_regionkey || ',o_t,o_key' AS equality, 'o_in' AS in_list, 'o_r' AS ranges FROM nation")
def equality_roles(spark, sf):
    sql = F.concat(F.lit("SELECT * FROM orders o JOIN c ON o.o_key = c.c_key WHERE o.o_t IS NULL AND o.o_r > 3 AND o.o_in IN (1, 2) AND o.o_s"), "n_regionkey", F.lit(" = "), "n_nationkey")
    records = as_records(_t(spark, sf, "nation").select(sql.alias("sql"), F.col("n_nationkey").cast("string").alias("fingerprint"), F.col("n_nationkey").alias("record_ord"), F.lit(1).alias("occurrences")))
    b = buckets(statements(records), orders_catalog(spark, sf)).where("key = 'orders'")
    names = lambda c: F.array_join(F.transform(c, lambda r: r["column"]), ",")
    return b.select(F.col("record_ord").alias("k"), names("equality").alias("equality"), names("in_list").alias("in_list"), names("ranges").alias("ranges"))


@query("finding_rank", DERIVED + "SELECT tbl, p_partkey AS record_ord, row_number() OVER (PARTITION BY tbl ORDER BY sev DESC, payoff DESC, p_partkey)::INT AS place FROM u")
def finding_rank(spark, sf):
    found = after.with_payoff(after.deduplicated(derived_findings(spark, sf)))
    return found.select(F.col("table").alias("tbl"), "record_ord", F.row_number().over(Window.partitionBy("table").orderBy(*after.ranking())).alias("place"))


@query("coverage", DERIVED + """, s AS (SELECT tbl, list_sort(string_split(cols, ',')) AS cset, arg_max(cols, (sev, payoff, -p_partkey)) AS cols, arg_max(fp, (sev, payoff, -p_partkey)) AS fp, list(DISTINCT fp) AS fps FROM u GROUP BY 1, 2),
a AS (SELECT n.tbl, n.cols, n.fps, (SELECT w.cols FROM s w WHERE w.tbl = n.tbl AND starts_with(w.cols, n.cols || ',') ORDER BY length(w.cols) DESC, w.cols LIMIT 1) AS wide FROM s n)
SELECT s.tbl, s.cols, array_to_string(list_sort(list_filter(list_distinct(list_concat(s.fps, coalesce((SELECT flatten(list(a.fps)) FROM a WHERE a.tbl = s.tbl AND a.wide = s.cols), []))), lambda x: x <> s.fp)), ',') AS covered FROM s JOIN a ON a.tbl = s.tbl AND a.cols = s.cols WHERE a.wide IS NULL""")
def coverage(spark, sf):
    found = after.without_redundant(after.with_payoff(after.deduplicated(derived_findings(spark, sf))))
    return found.select(F.col("table").alias("tbl"), F.array_join("index_columns", ",").alias("cols"), F.array_join("covered", ",").alias("covered"))


@query("review_annotations", DERIVED + "SELECT '::' || CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END || ' file=a%2C' || p.p_brand || '.sql,line=' || p.p_size || ',title=SIA001 ' || tbl || '::m%0AALTER TABLE `' || tbl || '` ADD INDEX `idx_' || lower(tbl) || '_' || replace(cols, ',', '_') || '` (`' || replace(cols, ',', '`, `') || '`);' AS value FROM u JOIN part p USING (p_partkey)")
def review_annotations(spark, sf):
    return sinks.annotations(after.with_payoff(after.deduplicated(derived_findings(spark, sf))), "/w")


@query("findings_as_json", DERIVED + "SELECT p_partkey AS line_of, tbl, severity, cols FROM (SELECT p.p_size::BIGINT AS p_partkey, tbl, severity, cols FROM u JOIN part p USING (p_partkey))")
def findings_as_json(spark, sf):
    rows = sinks.findings_json(after.with_payoff(after.deduplicated(derived_findings(spark, sf))))
    at = lambda path: F.get_json_object("value", path)
    return rows.select(at("$.line").cast("bigint").alias("line_of"), at("$.table").alias("tbl"), at("$.severity").alias("severity"), F.array_join(F.from_json(at("$.index_columns"), "array<string>"), ",").alias("cols"))


@query("inventory_list", "SELECT 'select' AS kind, 't' || n_regionkey || ', u' AS tables, 3 AS n_predicates, 'x DESC' AS order_by, '5, ' || n_regionkey AS \"limit\", count(*)::BIGINT AS n FROM nation GROUP BY n_regionkey")
def inventory_list(spark, sf):
    r = F.col("n_regionkey").cast("string")
    sql = F.concat(F.lit("SELECT * FROM t"), r, F.lit(" JOIN u ON u.a = b WHERE c = "), "n_nationkey", F.lit(" ORDER BY x DESC LIMIT 5, "), r)
    listed = sinks.inventory(statements(as_records(_t(spark, sf, "nation").select(sql.alias("sql"), F.col("n_nationkey").cast("string").alias("fingerprint"), F.col("n_nationkey").alias("record_ord"), F.lit(1).alias("occurrences")))))
    return listed.groupBy("kind", "tables", "n_predicates", "order_by", "limit").agg(F.count("*").alias("n"))


PREDICATES = {
    "DATE(o_orderdate) = '1995-03-15'": ("orders", "o_orderdate::DATE = DATE '1995-03-15'"),
    "YEAR(l_shipdate) = 1995": ("lineitem", "year(l_shipdate) = 1995"),
    "LEFT(o_orderpriority, 3) = '1-U'": ("orders", "left(o_orderpriority, 3) = '1-U'"),
    "l_orderkey + 1 > 500": ("lineitem", "l_orderkey + 1 > 500"),
    "p_size - 3 <= 11": ("part", "p_size - 3 <= 11"),
}
EDGES = {"LEFT(code, 2) = 'ab'": "left(code, 2) = 'ab'", "LEFT(code, 2) = 'a%'": "left(code, 2) = 'a%'", "DATE(made) = '2024-02-29'": "made::DATE = DATE '2024-02-29'", "YEAR(made) = 2024": "year(made) = 2024", "amount + 1 = 6": "amount + 1 = 6", "amount - 0.5 > 4.49": "amount - 0.5 > 4.49"}


def emitted(spark: SparkSession, predicates: list[str]) -> dict[str, str]:
    """What SIA004 makes of each predicate: as many rows as there are predicates."""
    texts = spark.createDataFrame([(p, f"SELECT * FROM t WHERE {p}") for p in predicates], "file string, value string")
    found = run_rules(buckets(statements(records_from_texts(texts)), no_catalog(spark)), Options(rules=("SIA004",)), False)
    return {r["file"]: r["rewrite"] for r in found.where("rewrite IS NOT NULL").select("file", "rewrite").collect()}


_SAME = "SELECT '{name}' AS predicate, count(*) FILTER (WHERE {duck})::BIGINT AS n_before, count(*) FILTER (WHERE {duck})::BIGINT AS n_after, 0::BIGINT AS n_differ FROM {table}"


@query("emitted_rewrites", " UNION ALL ".join(_SAME.format(name=p.replace("'", "''"), duck=duck, table=t) for p, (t, duck) in PREDICATES.items()))
def emitted_rewrites(spark, sf):
    forms, out = emitted(spark, list(PREDICATES)), None
    for predicate, (table, _) in PREDICATES.items():
        one = probes.differences(_t(spark, sf, table), F.expr(predicate), F.expr(forms[predicate]), "").select(F.lit(predicate).alias("predicate"), "n_before", "n_after", "n_differ")
        out = one if out is None else out.unionByName(one)
    return out


_EDGE_ROWS = "(VALUES ('ab', 5.00, TIMESTAMP '2024-02-29 00:00:00'), ('abc', 4.00, '2024-02-29 23:59:59'), ('a%', 6.00, '2024-03-01 00:00:00'), ('a_c', -5.00, '2023-12-31 23:59:59'), ('AB', 5.50, '2024-01-01 00:00:00'), (NULL, NULL, NULL), ('', 0.00, '2024-12-31 12:00:00'), ('ab ', 5.00, '2025-01-01 00:00:00'), ('a''b', 10.00, '1999-12-31 23:59:59'), ('ba', 4.99, '2024-02-28 23:59:59')) e(code, amount, made)"


@query("edge_rewrites", " UNION ALL ".join(_SAME.format(name=p.replace("'", "''"), duck=duck, table=_EDGE_ROWS) for p, duck in EDGES.items()))
def edge_rewrites(spark, sf):
    forms, rows, out = emitted(spark, list(EDGES)), seed.edge_rows(spark), None
    for predicate in EDGES:
        one = probes.differences(rows, F.expr(predicate), F.expr(forms[predicate]), "").select(F.lit(predicate).alias("predicate"), "n_before", "n_after", "n_differ")
        out = one if out is None else out.unionByName(one)
    return out


@query("seeded_shop", """SELECT 'orders' AS tbl, (SELECT max(o_orderkey) FROM orders)::BIGINT AS n, sum((i * 13 % 100000 / 100)::DECIMAL(12, 2))::DOUBLE AS amount, count(DISTINCT i * 7919 % greatest(1, (SELECT max(o_orderkey) FROM orders) // 10))::BIGINT AS users FROM range(1, (SELECT max(o_orderkey) + 1 FROM orders)) r(i)
UNION ALL SELECT 'order_item', 2 * (SELECT max(o_orderkey) FROM orders), sum((i * 29 % 20000 / 100)::DECIMAL(12, 2))::DOUBLE, 0 FROM range(1, 2 * (SELECT max(o_orderkey) FROM orders) + 1) r(i)""")
def seeded_shop(spark, sf):
    tables = seed.shop(spark, _t(spark, sf, "orders").agg(F.max("o_orderkey").alias("n")).first()["n"])
    first = tables["orders"].agg(F.lit("orders").alias("tbl"), F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"), F.countDistinct("user_id").alias("users"))
    return first.unionByName(tables["order_item"].agg(F.lit("order_item").alias("tbl"), F.count("*").alias("n"), F.sum("price").cast("double").alias("amount"), F.lit(0).cast("bigint").alias("users")))


@query("information_schema_dump", """SELECT lower(r_name) AS tbl, 'utf8mb4' AS charset, r_regionkey::BIGINT * 10 AS row_estimate, string_agg(lower(n_name), ',' ORDER BY n_nationkey DESC) AS columns,
'PRIMARY(' || arg_max(lower(n_name), n_nationkey) || ');idx(' || string_agg(CASE WHEN n_nationkey % 4 = 0 THEN '-' ELSE lower(n_name) END, ',' ORDER BY n_nationkey) || ')' AS indexes FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey""")
def information_schema_dump(spark, sf):
    both = _t(spark, sf, "region").join(_t(spark, sf, "nation"), F.expr("n_regionkey = r_regionkey")).withColumn("table_name", F.col("r_name"))
    tables = _t(spark, sf, "region").select(F.col("r_name").alias("table_name"), F.lit("utf8mb4_general_ci").alias("table_collation"), (F.col("r_regionkey") * 10).alias("table_rows"))
    columns = both.select("table_name", F.col("n_name").alias("column_name"), (-F.col("n_nationkey")).alias("ordinal_position"), F.lit("VARCHAR").alias("data_type"), F.lit(30).alias("character_maximum_length"), F.lit("NO").alias("is_nullable"), F.lit("utf8mb4").alias("character_set_name"))
    index = both.select("table_name", F.lit("idx").alias("index_name"), F.col("n_nationkey").alias("seq_in_index"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("column_name"), F.lit(None).cast("int").alias("sub_part"), F.lit(1).alias("non_unique"))
    last = both.groupBy("table_name").agg(F.max_by("n_name", "n_nationkey").alias("column_name")).select("table_name", F.lit("PRIMARY").alias("index_name"), F.lit(1).alias("seq_in_index"), "column_name", F.lit(None).cast("int").alias("sub_part"), F.lit(0).alias("non_unique"))
    found = catalog_of_information_schema(tables, columns, index.unionByName(last))
    shown = F.array_join(F.transform("indexes", lambda x: F.concat(x["name"], F.lit("("), F.array_join(x["columns"], ",", "-"), F.lit(")"))), ";")
    return found.select(F.col("name").alias("tbl"), "charset", "row_estimate", F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("columns"), shown.alias("indexes"))


@query("dynamic_tables", "SELECT p_partkey, p_partkey % 5 < 4 AND p_partkey % 5 > 0 AS dynamic FROM part")
def dynamic_tables(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 1, F.concat(F.lit("t_${x}_"), k)).when(k % 5 == 2, F.concat(F.lit("t"), k, F.lit("_"))).when(k % 5 == 3, F.concat(F.lit("t?"), k)).otherwise(F.concat(F.lit("t_"), k))
    return _t(spark, sf, "part").select("p_partkey", T.is_dynamic_table(name).alias("dynamic"))


@query("mapper_discovery", "SELECT 'm.' || n_name AS namespace, count(*)::BIGINT AS n FROM nation, range(4) r(i) WHERE i < 3 OR n_nationkey % 5 = 0 GROUP BY n_name")
def mapper_discovery(spark, sf):
    path = folder(spark, "mappers")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    texts = [(r["file"], r["value"]) for r in mapper_texts(spark, sf).collect()]  # 25 small files
    for name, text in [*((f"a/{n}", t) for n, t in texts), ("target/x.xml", texts[0][1]), ("b/beans.xml", "<beans/>"), ("b/notes.txt", texts[0][1])]:
        stream = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        stream.write(bytearray(text.encode()))
        stream.close()
    return read_mappers(spark, path).groupBy("namespace").agg(F.count("*").alias("n"))


@query("skip_reasons", """WITH n AS (SELECT n_nationkey % 4 AS kind FROM nation), r AS (SELECT 'SIA00' || i AS rule FROM range(1, 8) t(i))
SELECT rule, reason, count(*)::BIGINT AS count, (SELECT count(*) FROM n)::BIGINT AS total FROM (SELECT rule, CASE WHEN rule = 'SIA007' THEN 'no Rows_examined in this input (slow log only)' WHEN rule = 'SIA006' AND kind = 0 THEN 'the OFFSET is a bound parameter, so its size is not visible statically'
WHEN kind = 1 THEN 'several statements arrived merged (no '';'' between them); not analysed' WHEN kind = 2 THEN 'no table could be identified' END AS reason FROM n, r) WHERE reason IS NOT NULL GROUP BY rule, reason""")
def skip_reasons(spark, sf):
    k = F.col("n_nationkey").cast("string")
    source = _per(spark, sf, "nation", "n_nationkey", F.concat(F.lit("SELECT a FROM t WHERE b = "), k, F.lit(" LIMIT ?, 10")), F.concat(F.lit("SELECT a FROM t WHERE b = "), k, F.lit(" UPDATE u SET c = 1")), F.concat(F.lit("SELECT "), k), F.concat(F.lit("SELECT a FROM t WHERE b = "), k, F.lit(" LIMIT 10")))
    records = as_records(source.select("sql", F.col("k").cast("string").alias("fingerprint"), F.col("k").alias("record_ord"), F.lit(1).alias("occurrences")))
    return after.skipped(statements(records), Options(), True)


@query("prefix_lengths", "SELECT p_partkey, greatest(8, least(p_size, floor(3072 / CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END), 128))::BIGINT AS modern, greatest(8, least(p_size * 10, floor(600 / CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END), 128))::BIGINT AS old FROM part")
def prefix_lengths(spark, sf):
    charset = F.element_at(F.array(F.lit("utf8mb4"), F.lit("utf8"), F.lit("latin1")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", T.prefix_chars(F.col("p_size").cast("long"), charset, 3072, 8).alias("modern"), T.prefix_chars(F.col("p_size").cast("long") * 10, charset, 600, 5.7).alias("old"))


@query("key_sizes", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 4 WHEN 1 THEN 4 * p_size WHEN 2 THEN p_size WHEN 3 THEN 3 * p_size WHEN 4 THEN 8 ELSE 3 END::DOUBLE AS bytes FROM part")
def key_sizes(spark, sf):
    at = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", T.key_bytes(at("int", "varchar", "varchar", "char", "datetime", "date"), F.col("p_size"), at("utf8mb4", "utf8mb4", "latin1", "utf8", "utf8", "utf8")).alias("bytes"))


@query("date_rollover", "SELECT n_nationkey::BIGINT AS k, 'd >= ''' || strftime(DATE '1995-02-01' + (n_nationkey + 9)::INT, '%Y-%m-%d') || ' 00:00:00'' AND d < ''' || strftime(DATE '1995-02-01' + (n_nationkey + 10)::INT, '%Y-%m-%d') || ' 00:00:00''' AS rewrite FROM nation")
def date_rollover(spark, sf):
    texts = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("file"), F.concat(F.lit("SELECT * FROM t WHERE DATE(d) = '1995-2-"), F.col("n_nationkey") + 10, F.lit("'")).alias("value"))
    found = run_rules(buckets(statements(records_from_texts(texts).withColumn("fingerprint", F.col("file"))), no_catalog(spark)), Options(rules=("SIA004",)), False)
    return found.select(F.col("file").cast("bigint").alias("k"), "rewrite")


@query("oversized_columns", "SELECT 'orders' AS tbl, 'o_totalprice' AS cols, true AS told, count(*)::BIGINT AS occurrences FROM orders")
def oversized_columns(spark, sf):
    sql = F.concat(F.lit("SELECT * FROM orders WHERE o_orderpriority = '"), "o_orderpriority", F.lit("' AND o_totalprice > "), F.col("o_custkey"))
    found = _of_orders(spark, sf, sql, Options(rules=("SIA001",), prefix_bytes=1000))
    return found.select(F.col("table").alias("tbl"), F.array_join("index_columns", ",").alias("cols"), F.col("message").contains("Left out as too long for a key: o_orderpriority").alias("told"), "occurrences")
