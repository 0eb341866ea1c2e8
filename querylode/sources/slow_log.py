"""MySQL slow query logs as a DataFrame of events, by running sums instead of a state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TIME, _USER, _COST = r"(?i)^# Time:", r"(?i)^# User@Host:", r"(?i)^# Query_time:"
# Fixed values of the server's log format: lines that belong to no statement.
_NOISE = r"(?i)^\s*$|^SET timestamp=|^SET @@|^USE\s|started with:\s*$|^Tcp port:|^Time\s+Id\s+Command|^# administrator command|^\s*administrator command"


def _number(line: Column, name: str, kind: str) -> Column:
    return F.nullif(F.regexp_extract(line, rf"(?i){name}:\s*([0-9.]+)", 1), F.lit("")).try_cast(kind)


def log_units(spark: SparkSession, path: str) -> DataFrame:
    """file, unit, line, text of every line of a log. A unit begins at each `# Time:` line, so files of any size split between tasks and no task holds more than a unit.

    Lines are numbered within the file: the lines of the blocks before, and of the units before in the block, are added up.
    """
    read = spark.read.format("text").option("lineSep", "\n# Time: ").load(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    rows = rows.withColumn("lines", F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit(""))) + 1)
    in_block = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.sum("lines").alias("lines"))
    base = blocks.select("file", "block", F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = rows.withColumn("above", F.coalesce(F.sum("lines").over(in_block), F.lit(0))).join(base, ["file", "block"]).withColumn("above", F.col("base") + F.col("above"))
    # the separator is taken off every unit but a file's first
    whole = F.when(F.col("above") == 0, F.col("value")).otherwise(F.concat(F.lit("# Time: "), "value"))
    spread = placed.select("file", F.col("above").alias("unit"), "above", F.posexplode(F.split(whole, "\r?\n")).alias("pos", "text"))
    return spread.select("file", "unit", (F.col("above") + F.col("pos") + 1).alias("line"), "text")


def slow_events(lines: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """file, event_ord (its first line), line (of its SQL), ts, user, host, db, query_time, lock_time, rows_sent, rows_examined, sql, ignored of every event.

    A `# Time:` line begins an event, `# User@Host:` one only where none is open, and a statement's `;` at the end of a line closes it.
    An event without SQL is ignored (administrator commands). Lines with equal keys are one text; keys may split a file only where an event begins.
    """
    keys = tuple(dict.fromkeys(("file", *keys)))
    text = F.col("text")
    is_noise = text.rlike(_NOISE)
    marked = lines.select(
        *keys, "line", "text", text.rlike(_TIME).alias("is_time"), text.rlike(_USER).alias("is_user"),
        (~text.startswith("#") & ~is_noise).alias("is_sql"), (~text.startswith("#") & ~is_noise & text.rlike(r";\s*$")).alias("closes"),
    )
    by_line = Window.partitionBy(*keys).orderBy("line")
    before = by_line.rowsBetween(Window.unboundedPreceding, -1)
    # a user line begins an event if nothing but a closed statement, or another event's cost line, came since the last beginning
    last = F.last(F.when(F.col("is_time") | F.col("is_user") | F.col("is_sql") | F.col("closes"), F.when(F.col("is_time") | F.col("is_user"), "open").when(F.col("closes"), "closed").otherwise("sql")), True).over(before)
    begins = F.col("is_time") | F.col("is_user") & (F.coalesce(last, F.lit("closed")) == "closed")
    placed = marked.withColumn("begins", begins.cast("int"))
    event = F.sum("begins").over(by_line) + F.coalesce(F.sum(F.col("closes").cast("int")).over(before), F.lit(0))
    placed = placed.withColumn("event_ord", event.cast("long"))
    line_of = lambda what: F.min(F.when(what, F.col("line")))
    header = lambda pattern: F.max(F.when(text.rlike(pattern), text))
    sql_lines = F.array_sort(F.collect_list(F.when(F.col("is_sql"), F.struct("line", "text"))))
    events = placed.groupBy(*keys, "event_ord").agg(
        line_of(F.col("is_sql")).alias("line"), header(_TIME).alias("time_line"), header(_USER).alias("user_line"), header(_COST).alias("cost_line"),
        F.max(F.when(text.rlike(r"(?i)^USE\s"), text)).alias("use_line"), sql_lines.alias("sql_lines"),
        F.max(text.rlike(r"^#")).alias("has_header"), F.min("line").alias("first_line"),
    )
    cost, user = F.col("cost_line"), F.col("user_line")
    return events.where("has_header OR line IS NOT NULL").select(
        "file", F.col("first_line").cast("long").alias("event_ord"), "line",
        F.try_to_timestamp(F.regexp_extract("time_line", r"(?i)^# Time:\s*(\S+)", 1)).alias("ts"),
        F.nullif(F.regexp_extract(user, r"(?i)^# User@Host:\s*([^\[\s]*)", 1), F.lit("")).alias("user"),
        F.nullif(F.regexp_extract(user, r"@\s*([^\s\[]*)", 1), F.lit("")).alias("host"),
        F.nullif(F.regexp_extract("use_line", r"(?i)^USE\s+`?([^`;\s]+)", 1), F.lit("")).alias("db"),
        _number(cost, "Query_time", "decimal(18,6)").alias("query_time"), _number(cost, "Lock_time", "decimal(18,6)").alias("lock_time"),
        _number(cost, "Rows_sent", "bigint").alias("rows_sent"), _number(cost, "Rows_examined", "bigint").alias("rows_examined"),
        F.regexp_replace(F.array_join(F.transform("sql_lines", lambda s: s["text"]), "\n"), r";\s*$", "").alias("sql"), F.col("line").isNull().alias("ignored"),
    )


def read_slow_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log, or of all logs in a folder."""
    return slow_events(log_units(spark, path), ("file", "unit"))
