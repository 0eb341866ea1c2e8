"""The whole run: any input to findings, with what was skipped and noted."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylode.operators import findings as after
from querylode.operators.buckets import buckets, statements
from querylode.operators.rules import Options, Rule, run_rules
from querylode.operators.workload import patterns
from querylode.scratch import settled
from querylode.sources import catalog as catalogs
from querylode.sources.mapper import read_mappers
from querylode.sources.slow_log import read_slow_log, slow_events
from querylode.sources.sql_text import as_records, inline_sql, read_sql_files


@dataclass(frozen=True)
class Analysis:
    findings: DataFrame
    records: DataFrame
    skipped: DataFrame
    notes: DataFrame
    options: Options
    errors: list[tuple[str, str]]


def is_folder(spark: SparkSession, path: str) -> bool | None:
    """Whether a path in any store is a folder; None if there is nothing."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(at).isDirectory() if fs.exists(at) else None


def input_kind(source: str, folder: bool | None = None) -> str:
    """By suffix or folder, else by what the text looks like. folder: whether the source is one, where that is known."""
    suffix = os.path.splitext(source)[1].lower() if "\n" not in source else ""
    if suffix in (".xml", ".json", ".log", ".slow", ".sql"):
        return {".xml": "mapper", ".json": "schema", ".sql": "sql"}.get(suffix, "slowlog")
    if folder:
        return "mapper"
    return "slowlog" if re.search(r"query[-_]?time", source, re.I) else "sql"


def load(spark: SparkSession, source: str, kind: str | None = None, inline: bool = False) -> DataFrame:
    """Records of a path or, inline, of a text. A source that is no path but reads as a statement or a log is taken as text."""
    folder = None
    if not inline and "\n" not in source:
        try:
            folder = is_folder(spark, source)
        except Exception:  # no path at all
            folder = None
    inline = inline or folder is None and (re.search(r"\s", source.strip()) is not None)
    kind = kind or input_kind(source, folder)
    if kind == "mapper":
        return read_mappers(spark, source)
    if kind == "slowlog":
        if inline:
            lines = spark.createDataFrame([(source,)], "value string").select(F.lit(None).cast("string").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "text"))
            return as_records(patterns(slow_events(lines.select("file", (F.col("pos") + 1).alias("line"), "text"))))
        return as_records(patterns(read_slow_log(spark, source)))
    if kind != "sql":
        raise ValueError(f"no workload: {kind}")
    return inline_sql(spark, source) if inline else read_sql_files(spark, source)


def analyse(records: DataFrame, catalog: DataFrame | None = None, options: Options = Options(), custom: tuple[Rule, ...] = (), polish: Callable[[DataFrame], DataFrame] | None = None) -> Analysis:
    """Runs the rules. Custom rules come as functions of buckets; `polish` may add columns to findings, but what it does to others is undone."""
    spark = records.sparkSession
    known = catalog if catalog is not None else catalogs.no_catalog(spark)
    errors: list[tuple[str, str]] = []
    read = settled(statements(records), "records")
    raw = settled(run_rules(buckets(read, known), options, catalog is not None, custom, errors), "raw")
    found = settled(after.finished(raw), "findings").orderBy(*after.ranking())
    if polish:
        try:
            added = polish(found)
            keys = ["rule", *[c for c in after.ORDER if c != "rule"]]
            found = found.join(added.select(*keys, *[c for c in added.columns if c not in found.columns]), keys, "left").orderBy(*after.ranking())
        except Exception as error:
            errors.append(("polish", f"{type(error).__name__}: {error}"))
    return Analysis(found, read, after.skipped(read, options, catalog is not None), after.notes(read), options, errors)
