"""Reports: JSON, annotations of a code review, migration SQL, an inventory, and plain text."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylode.functions.language import translated
from querylode.operators.buckets import first_by
from querylode.operators.findings import _rank_keys, ranking, severity_counts
from querylode.operators.rules import RULES, severity_rank

REPORT_VERSION = 1
PUBLIC = ("rule", "severity", "table", "ddl", "rewrite", "index_columns", "low_cardinality_risk", "covered", "message", "sql", "fingerprint", "file", "line", "statement_id", "query_time", "rows_examined", "occurrences", "payoff")


def findings_json(findings: DataFrame) -> DataFrame:
    """A row `value` of JSON for each finding: a distributed sink."""
    return findings.select(F.to_json(F.struct(*[c for c in PUBLIC if c in findings.columns])).alias("value"))


def report_json(findings: DataFrame, skipped: DataFrame, notes: DataFrame, records: DataFrame, options=None, errors: list | tuple = (), most: int = 10_000) -> DataFrame:
    """One row `value`: the whole report for people to read, with the best `most` findings and whether there are more; findings_json writes them all."""
    shown = findings.orderBy(*ranking()).limit(most)
    best = F.struct(*[k.alias(f"_{i}") for i, k in enumerate(_rank_keys())], F.struct(*[c for c in PUBLIC if c in findings.columns]).alias("f"))
    parts = [
        shown.agg(F.transform(F.array_sort(F.collect_list(best)), lambda x: x["f"]).alias("findings")),
        severity_counts(findings).select(F.struct("error", "warn", "info").alias("by_severity"), (F.col("error") + F.col("warn") + F.col("info") > most).alias("truncated")),
        skipped.agg(F.collect_list(F.struct("rule", "reason", "count", "total")).alias("skipped")),
        notes.agg(F.collect_list(F.struct("note", "count")).alias("notes")),
        records.agg(F.count("*").alias("analysed")),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # one row each
    rules = F.array(*[F.struct(F.lit(r.id).alias("id"), F.lit(r.title).alias("title"), F.lit(r.needs_schema).alias("needs_schema"), F.lit(r.needs_metrics).alias("needs_metrics")) for r in RULES])
    told = F.lit(json.dumps(asdict(options)) if options else None).cast("string").alias("options")
    failed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(m).alias("message")) for r, m in errors]) if errors else F.array().cast("array<struct<rule:string,message:string>>")
    return row.select(F.to_json(F.struct(F.lit(REPORT_VERSION).alias("report_version"), told, rules.alias("rules"), "analysed", "by_severity", "truncated", "skipped", "notes", failed.alias("errors"), "findings")).alias("value"))


def _escaped(text: Column, within_property: bool) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if within_property else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def annotations(findings: DataFrame, workspace: str = "", notes: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """A row `value` for each finding, as continuous integration shows them beside the code; then one for each note and for each rule that could not judge all."""
    root = workspace.rstrip("/") + "/"
    path = F.regexp_replace(F.coalesce("file", F.lit("")), r"^file:/+", "/")
    path = F.when(F.lit(len(root) > 1) & path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warn", "warning").otherwise("notice")
    place = F.concat_ws(",", F.when(path != "", F.concat(F.lit("file="), _escaped(path, True))), F.when((path != "") & F.col("line").isNotNull(), F.concat(F.lit("line="), F.col("line").cast("string"))), F.concat(F.lit("title="), _escaped(F.concat_ws(" ", "rule", "table"), True)))
    body = F.concat_ws("\n", "message", F.array_join("ddl", "\n"), "rewrite")
    lines = findings.orderBy(*ranking()).select(F.concat(F.lit("::"), level, F.lit(" "), place, F.lit("::"), _escaped(body, False)).alias("value"))
    if notes is not None:
        lines = lines.unionAll(notes.select(F.concat(F.lit("::notice title=note::"), _escaped(F.concat("note", F.lit(" ("), F.col("count").cast("string"), F.lit(")")), False)).alias("value")))
    if skipped is not None:
        lines = lines.unionAll(skipped.select(F.concat(F.lit("::notice title="), _escaped(F.concat(F.lit("not evaluated: "), "rule"), True), F.lit("::"), _escaped(F.concat("reason", _cover()), False)).alias("value")))
    return lines


def migration(findings: DataFrame) -> DataFrame:
    """`value`: each DDL once, under its most severe reason, by table; rewrites as comments. Nothing is dropped."""
    each = findings.select("*", F.posexplode("ddl").alias("ddl_ord", "one"))
    ddl = first_by(each, ["one"], severity_rank("severity").desc(), *ranking()[1:])
    why = F.concat(F.lit("-- "), "rule", F.lit(" "), "severity", F.lit(": "), F.regexp_replace("message", r"\s*\n\s*", " "))
    lines = ddl.select("table", F.lit(0).alias("kind"), F.col("one").alias("key"), F.concat(why, F.lit("\n"), F.col("one")).alias("value"))
    advice = findings.where("size(ddl) = 0 AND rewrite IS NOT NULL").select("table", F.lit(1).alias("kind"), F.col("rewrite").alias("key"), F.concat(why, F.lit("\n-- rewrite: "), F.regexp_replace("rewrite", r"\s*\n\s*", " ")).alias("value"))
    return lines.unionByName(advice.dropDuplicates(["table", "key"])).orderBy("table", "kind", "key").select("value")


def inventory(records: DataFrame) -> DataFrame:
    """What was read: line, kind, tables, predicates, ordering, limit, fingerprint, notes of each record."""
    p = "parsed."
    return records.orderBy("file", "record_ord", "body_ord").select(
        "file", "line", "statement_id", F.col(p + "kind").alias("kind"), F.array_join(F.transform(p + "tables", lambda t: t["name"]), ", ").alias("tables"),
        F.size(F.filter(p + "columns", lambda c: c["scope"].startswith("where") | (c["scope"] == "join-on"))).alias("n_predicates"),
        F.col(p + "order_by_text").alias("order_by"), F.col(p + "limit.raw").alias("limit"), "fingerprint", F.array_join(p + "notes", "; ").alias("notes"),
    )


def _cover() -> Column:
    """Of how many statements a rule could judge only some."""
    return F.when(F.col("count") < F.col("total"), F.concat(F.lit(", on "), F.col("count").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" statements"))).otherwise("")


HEADINGS = {"en": ("{n} finding(s), {shown} shown", "no findings", "nothing left out", "note", "not evaluated", "failed"), "zh": ("共 {n} 条建议，显示 {shown} 条", "没有建议", "没有遗漏", "说明", "未评估", "失败")}


def text_report(findings: DataFrame, skipped: DataFrame, notes: DataFrame, top: int = 50, lang: str = "en", errors: list | tuple = ()) -> str:
    """For a terminal: the first findings, their severities, and everything that was not judged."""
    rows = findings.orderBy(*ranking()).limit(top).collect()
    found, none, whole, note, missed, failed = HEADINGS[lang]
    out = []
    for i, r in enumerate(rows, 1):
        where = ":".join(str(x) for x in (r.file, r.line) if x is not None)
        out += [f"{i}. [{r.severity}] {r.rule} {r.table} {where}".rstrip(), f"   {r.message}", *(f"   {d}" for d in r.ddl), *([f"   rewrite: {r.rewrite}"] if r.rewrite else [])]
    counts = severity_counts(findings).first()
    total = counts["error"] + counts["warn"] + counts["info"]
    told = [f"{note}: {n['text']} ({n['count']})" for n in notes.select(translated("note", lang).alias("text"), "count").collect()]
    told += [f"{missed}: {s['rule']} ({s['text']}{s['cover']})" for s in skipped.select("rule", translated("reason", lang).alias("text"), _cover().alias("cover")).collect()]
    told += [f"{failed}: {rule} ({message})" for rule, message in errors]
    if total:
        out += [found.format(n=total, shown=len(rows)), ", ".join(f"{k} {counts[k]}" for k in ("error", "warn", "info"))]
    else:
        out.append(none if told else f"{none}, {whole}")
    return "\n".join(out + told)


def tool_result(findings: DataFrame, skipped: DataFrame, notes: DataFrame, top: int = 50) -> dict:
    """What a tool server hands to its caller: the text, and the first findings as data, with how many there are and whether some are left out."""
    rows = findings_json(findings.orderBy(*ranking()).limit(top)).collect()
    total = findings.count()
    listed = [json.loads(r["value"]) for r in rows]
    return {"content": [{"type": "text", "text": text_report(findings, skipped, notes, top)}], "structuredContent": {"findings": listed, "total": total, "truncated": total > len(listed)}}
