"""From events to query patterns: the fingerprint aggregate, ranking, and folding of repeated bodies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylode.functions.text import fingerprint

COST = "query_time", "lock_time", "rows_sent", "rows_examined"


#: Bytes of input from which too few partitions are dealt anew.
LEAST_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows on as many partitions as there are cores, if a file that doesn't split has left them on fewer: what follows costs far more than the exchange. Only a plain scan is dealt anew; anything else has its own partitions."""
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = re.findall(r"^[ :+-]*(\w+)", plan.toString(), re.M)
    if set(nodes) - {"Project", "Filter", "Relation"} or int(str(plan.stats().sizeInBytes())) < LEAST_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def patterns(events: DataFrame) -> DataFrame:
    """One row for each fingerprint: occurrences, total_query_time, max_rows_examined, the first sql, file and line, and the cost of the slowest event (the first of equals).

    All aggregates combine on the map side, so a hot pattern sends one row from each task.
    """
    first = F.struct("file", "event_ord")
    worst = F.max_by(F.struct(*COST), F.struct(F.coalesce("query_time", F.lit(-1)), -F.col("event_ord")))
    grouped = spread(events).where("sql IS NOT NULL AND NOT coalesce(ignored, false)").groupBy(fingerprint("sql").alias("fingerprint"))
    found = grouped.agg(
        F.count("*").alias("occurrences"), F.sum("query_time").alias("total_query_time"), F.max("rows_examined").alias("max_rows_examined"),
        F.min_by(F.struct("sql", "file", "line", "event_ord"), first).alias("first"), worst.alias("worst"),
    )
    found = found.where("fingerprint <> ''")  # after the aggregate: before it the whole chain of expressions would run twice a row
    return found.select("fingerprint", "occurrences", "total_query_time", "max_rows_examined", "first.sql", "first.file", "first.line", F.col("first.event_ord").alias("record_ord"), *[F.col(f"worst.{c}").alias(c) for c in COST])


def ranked(records: DataFrame) -> DataFrame:
    return records.orderBy(F.desc_nulls_last("total_query_time"), "file", "record_ord")


def payoff(query_time: Column, rows: Column, occurrences: Column) -> Column:
    """What an index may be worth: time by rows by runs, with rows and runs alone where there is no time."""
    time, rows, runs = (F.coalesce(c.cast("double"), F.lit(d)) for c, d in ((query_time, 0.0), (rows, 0.0), (occurrences, 1.0)))
    return time * rows * runs + rows / F.lit(1e6) + runs


def folded(records: DataFrame) -> DataFrame:
    """Records with the same fingerprint as one: runs and time add up, rows are the greatest, the rest is of the first by (record_ord, body_ord)."""
    order = F.struct("record_ord", "body_ord")
    rest = [c for c in records.columns if c not in ("fingerprint", "occurrences", "total_query_time", "max_rows_examined")]
    found = records.groupBy("fingerprint").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("total_query_time").alias("total_query_time"), F.max("max_rows_examined").alias("max_rows_examined"), F.min_by(F.struct(*rest), order).alias("first")
    )
    return found.select("fingerprint", "occurrences", "total_query_time", "max_rows_examined", *[F.col(f"first.{c}").alias(c) for c in rest])
