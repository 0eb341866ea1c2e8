"""Statements and, for each of their tables, the columns by role: nested array expressions over the parsed record, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylode.functions.text import fingerprint
from querylode.operators.workload import folded, spread
from querylode.plans.parser import parsed
from querylode.scratch import settled

PREDICATES = ("where-eq", "where-in", "where-range", "where-like-prefix", "where-null", "join-on")


def statements(records: DataFrame) -> DataFrame:
    """Records with `parsed`; each subquery is a record of its own behind its statement, with the statement's cost.

    A body that repeats is one record, or adds its runs to the first statement that is the same text.
    """
    every = spread(records).withColumn("_all", parsed("sql"))
    bodies = every.select(*records.columns, F.posexplode("_all").alias("body_ord", "parsed"))
    if "notes" in records.columns:  # what the source had to say of the statement comes first
        told = F.coalesce("notes", F.array().cast("array<string>"))
        bodies = bodies.withColumn("parsed", F.col("parsed").withField("notes", F.array_union(told, F.col("parsed.notes"))))
    each = settled(bodies, "statements")  # read several times below
    outer = each.where("body_ord = 0")
    bodies = each.where("body_ord > 0").withColumn("fingerprint", fingerprint("parsed.full_sql")).withColumn("sql", F.col("parsed.full_sql")).withColumn("statement_id", F.concat("statement_id", F.lit("#subquery")))
    bodies = folded(bodies).select(*outer.columns)
    first = outer.groupBy("fingerprint").agg(F.min("record_ord").alias("record_ord"))
    extra = bodies.join(first.select("fingerprint", F.col("record_ord").alias("_first")), "fingerprint").select("fingerprint", F.col("_first").alias("record_ord"), F.col("occurrences").alias("_runs"), F.col("total_query_time").alias("_time"), F.col("max_rows_examined").alias("_rows"))
    grown = outer.join(extra, ["fingerprint", "record_ord"], "left").select(
        *[c for c in outer.columns if c not in ("occurrences", "total_query_time", "max_rows_examined")],
        (F.col("occurrences") + F.coalesce("_runs", F.lit(0))).alias("occurrences"),
        F.when(F.col("_time").isNull(), F.col("total_query_time")).otherwise(F.coalesce("total_query_time", F.lit(0)) + F.col("_time")).cast("decimal(38,6)").alias("total_query_time"),
        F.greatest("max_rows_examined", "_rows").alias("max_rows_examined"),
    )
    alone = bodies.join(first, "fingerprint", "left_anti").select(*grown.columns).withColumn("total_query_time", F.col("total_query_time").cast("decimal(38,6)"))
    return grown.unionByName(alone)


def _is(*words: str):
    return lambda r: r["scope"].isin(*words)


def columns_of(refs: Column) -> Column:
    return F.array_distinct(F.transform(refs, lambda r: r["column"]))


def buckets(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """A row for each statement and table: the refs by role (equality, in_list, ranges, ordering, grouping, or_branches, wrapped), is_driving, and the catalog's table (null if unknown)."""
    p = "parsed."
    tables = F.transform(p + "tables", lambda t: F.struct(t["name"].alias("name"), F.lower(t["name"]).alias("key"), F.lower(t["alias"]).alias("alias")))
    made = records.withColumn("_tables", tables)

    def keyed(r: Column) -> Column:
        named = F.get(F.filter("_tables", lambda t: (t["alias"] == r["table"]) | (t["key"] == r["table"])), F.lit(0))["key"]
        only = F.when(F.size("_tables") == 1, F.get("_tables", F.lit(0))["key"])
        return F.when(r["table"].isNull(), only).otherwise(named)

    def visible(r: Column) -> Column:
        return ~(F.array_contains(p + "select_aliases", r["column"]) & ~F.array_contains(p + "select_columns", r["column"]))

    refs = F.transform(F.filter(F.concat(p + "columns", p + "order_by", p + "group_by"), visible), lambda r, i: F.struct(keyed(r).alias("key"), i.alias("i"), *[r[c].alias(c) for c in ("raw", "column", "scope", "op", "desc", "wrapped", "parameterized", "value_text", "predicate_text")]))
    spread = made.withColumn("_refs", refs).select("*", F.posexplode(F.array_distinct(F.transform("_tables", lambda t: t["key"]))).alias("table_ord", "key"))
    own = F.filter("_refs", lambda r: r["key"] == F.col("key"))
    spread = spread.withColumn("_own", own).withColumn("table", F.get(F.filter("_tables", lambda t: t["key"] == F.col("key")), F.lit(0))["name"])
    plain = F.filter("_own", lambda r: ~r["wrapped"])
    rank = lambda r: F.when(r["scope"] == "where-eq", 0).when(r["scope"] == "where-null", 1).otherwise(2)
    equal = F.filter(plain, _is("where-eq", "where-null", "where-like-prefix", "join-on"))
    equal = F.transform(F.array_sort(F.transform(equal, lambda r: F.struct(rank(r).alias("rank"), r["i"].alias("i"), r.alias("r")))), lambda s: s["r"])
    out = spread.select(
        *records.columns, "table_ord", "key", "table", (F.col("table_ord") == 0).alias("is_driving"),
        equal.alias("equality"), F.filter(plain, _is("where-in")).alias("in_list"), F.filter(plain, _is("where-range")).alias("ranges"),
        F.filter(plain, _is("order-by")).alias("ordering"), F.filter(plain, _is("group-by")).alias("grouping"),
        F.filter("_own", _is("where-or")).alias("or_branches"), F.filter("_own", lambda r: r["wrapped"] & r["scope"].isin(*PREDICATES, "where-or")).alias("wrapped"),
    )
    known = catalog.select(F.col("name").alias("key"), F.struct("name", "charset", "columns", "indexes").alias("cat"))
    return out.join(known, "key", "left")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
