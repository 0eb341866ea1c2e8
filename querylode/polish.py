"""Texts for a language model that may explain findings: prompts, and canned notes where there is no model. Neither changes advice: analyse() takes added columns only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTES = {
    "SIA001": "Without an index the server reads the whole table for each run of this statement.",
    "SIA002": "A prefix index stays within the key's size; how many characters it needs is a matter of the data.",
    "SIA003": "An index serves its columns from the left; a gap ends its use.",
    "SIA004": "An index holds a column's values, not those of an expression on it.",
    "SIA005": "Types that differ are converted row by row, which no index can follow.",
    "SIA006": "Rows before the offset are read and thrown away for every page.",
    "SIA007": "With all columns in the index the table's rows need not be read.",
}


def with_prompts(findings: DataFrame) -> DataFrame:
    """Adds `prompt`: what a model is asked of each finding. It holds the pattern, not the literals."""
    prompt = F.concat_ws(
        "\n", F.lit("Explain this index advice to a developer in two sentences. Do not change its SQL."), F.concat(F.lit("Rule: "), "rule", F.lit(", severity: "), "severity"),
        F.concat(F.lit("Statement: "), "fingerprint"), F.concat(F.lit("Finding: "), "message"), F.when(F.size("ddl") > 0, F.concat(F.lit("DDL: "), F.array_join("ddl", " "))),
    )
    return findings.withColumn("prompt", prompt)


def with_notes(findings: DataFrame) -> DataFrame:
    """Adds `note`: a fixed sentence for each rule."""
    note = F.lit(None).cast("string")
    for rule, text in NOTES.items():
        note = F.when(F.col("rule") == rule, text).otherwise(note)
    return findings.withColumn("note", note)
