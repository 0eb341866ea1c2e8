"""After the rules: deduplication, ranking, dropping of redundant indexes, and the account of what was skipped and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylode.operators.buckets import first_by
from querylode.operators.rules import Options, chosen, severity_rank
from querylode.operators.workload import payoff
from querylode.plans.parser import MERGED, UNPARSED
from querylode.scratch import settled

ORDER = ("record_ord", "body_ord", "table_ord", "rule", "part")


def deduplicated(findings: DataFrame) -> DataFrame:
    """One finding for each rule, table, statement, set of DDL and rewrite: the most severe, the first of equals."""
    keyed = findings.withColumn("_ddl", F.array_join(F.array_sort("ddl"), "\n")).withColumn("_rewrite", F.coalesce("rewrite", F.lit("")))
    kept = first_by(keyed, ["rule", "table", "fingerprint", "_ddl", "_rewrite"], severity_rank("severity").desc(), *[F.col(c) for c in ORDER])
    return kept.drop("_ddl", "_rewrite")


def with_payoff(findings: DataFrame) -> DataFrame:
    return findings.withColumn("payoff", F.round(payoff(F.col("query_time"), F.col("rows_examined"), F.col("occurrences")), 9))


def ranking() -> list:
    return [severity_rank("severity").desc(), F.desc("payoff"), F.col("rule"), *[F.col(c) for c in ORDER if c != "rule"]]


def _rank_keys() -> list:
    """ranking() as values of which the least is the best."""
    return [(-severity_rank("severity")).alias("_severity"), (-F.col("payoff")).alias("_payoff"), F.col("rule"), *[F.col(c) for c in ORDER if c != "rule"]]


def without_redundant(findings: DataFrame) -> DataFrame:
    """Of indexes with the same columns in another order the best ranked stays; one that begins another's columns goes, and the longest survivor says what it covers."""
    none = F.array().cast("array<string>")
    indexed = findings.where(F.size("index_columns") > 0)
    others = findings.where("index_columns IS NULL OR size(index_columns) = 0").withColumn("covered", none)
    partial = F.exists("ddl", lambda d: d.rlike(r"\(\s*`?\w+`?\s*\(\s*\d+\s*\)\s*\)"))
    indexed = indexed.withColumn("_partial", partial).withColumn("_set", F.when(F.col("_partial"), F.concat_ws("\n", "ddl", "fingerprint")).otherwise(F.array_join(F.array_sort("index_columns"), ",")))
    # one row for each table and set of columns: the best ranked finding, and whose fingerprints it stands for
    best = F.min_by(F.struct(*findings.columns, "_partial"), F.struct(*_rank_keys()))
    sets = indexed.groupBy("table", "_set").agg(best.alias("_best"), F.collect_set("fingerprint").alias("_all"))
    kept = sets.select("_set", "_all", "_best.*")
    # each beginning of each index, so beginnings are found by an equal join and not among all indexes of a table
    longer = F.explode(F.sequence(F.lit(1), F.size("index_columns") - 1))
    wide = kept.where(~F.col("_partial") & (F.size("index_columns") > 1)).select("table", F.col("_set").alias("wide_set"), F.size("index_columns").alias("_width"), longer.alias("_n"), "index_columns")
    wide = wide.select("table", "wide_set", "_width", F.slice("index_columns", 1, F.col("_n")).alias("index_columns"))
    longest = wide.groupBy("table", "index_columns").agg(F.min_by("wide_set", F.struct(-F.col("_width"), F.col("wide_set"))).alias("wide_set"))
    gone = kept.join(longest, ["table", "index_columns"]).select("table", "_set", "wide_set", "_all")
    absorbed = gone.select("table", F.col("wide_set").alias("_set"), F.explode("_all").alias("covers")).groupBy("table", "_set").agg(F.collect_set("covers").alias("_covers"))
    stay = kept.join(gone.select("table", "_set"), ["table", "_set"], "left_anti").join(absorbed, ["table", "_set"], "left")
    covered = F.array_sort(F.array_remove(F.array_union("_all", F.coalesce("_covers", none)), F.col("fingerprint")))
    return stay.withColumn("covered", covered).select(*findings.columns, "covered").unionByName(others)


def finished(findings: DataFrame) -> DataFrame:
    """Deduplicated, cleared and ranked."""
    return without_redundant(settled(with_payoff(deduplicated(findings)), "deduplicated")).orderBy(*ranking())


def skipped(records: DataFrame, options: Options, has_schema: bool) -> DataFrame:
    """rule, reason, count, total of the statements that a rule could not judge; the first reason that holds counts."""
    rules = records.sparkSession.createDataFrame([(r.id, r.needs_schema, r.needs_metrics, i) for i, r in enumerate(chosen(options))], "rule string, needs_schema boolean, needs_metrics boolean, rule_ord int")
    p = "parsed."
    reason = (
        F.when(F.col("needs_schema") & F.lit(not has_schema), "needs a catalog to know existing indexes")
        .when(F.col("needs_metrics") & F.col("rows_examined").isNull(), "no Rows_examined in this input (slow log only)")
        .when((F.col("rule") == "SIA006") & F.col(p + "limit").isNotNull() & ~F.col(p + "limit.literal"), "the OFFSET is a bound parameter, so its size is not visible statically")
        .when(F.exists(p + "notes", lambda n: n.startswith(UNPARSED)), "statement failed to parse")
        .when(F.array_contains(p + "notes", MERGED), "several statements arrived merged (no ';' between them); not analysed")
        .when(F.size(p + "tables") == 0, "no table could be identified")
    )
    # seven rules at most beside custom ones: a cross join with a table of fixed size
    each = records.crossJoin(F.broadcast(rules)).withColumn("reason", reason)
    total = each.groupBy("rule").agg(F.count("*").alias("total"))
    counted = each.where("reason IS NOT NULL").groupBy("rule", "reason").agg(F.count("*").alias("count"), F.min("record_ord").alias("first"))
    return counted.join(total, "rule").select("rule", "reason", "count", "total", "first").orderBy(F.desc("count"), "rule", "first").drop("first")


def notes(records: DataFrame, most: int = 5) -> DataFrame:
    """note, count of the records that carry it: the most frequent."""
    each = records.select(F.explode(F.array_distinct("parsed.notes")).alias("note"))
    return each.groupBy("note").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "note").limit(most)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn", "info")])


def exit_code(findings: DataFrame, fail_on: str = "error", errors: list | tuple = ()) -> int:
    """2 if something failed, 1 if there is a finding of at least this severity, else 0."""
    if errors:
        return 2
    least = {"info": 0, "warn": 1, "error": 2}[fail_on]
    return int(not findings.where(severity_rank("severity") >= least).isEmpty())


def usable(records: DataFrame) -> DataFrame:
    """Statements of a kind that the parser knows."""
    return records.where(F.col("parsed.kind") != "unknown")
