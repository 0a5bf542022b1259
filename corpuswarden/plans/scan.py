"""The pattern-rule scan and the findings row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from corpuswarden.plans.facts import extract, rule_probe


def findings_row(check: str, file: str, line: str, snippet: str,
                 confidence: str) -> list[Column]:
    """Columns of a finding, from expressions over the current row."""
    return [
        F.col("repo"), F.expr(check).alias("check_id"), F.expr(file).alias("file"),
        F.expr(f"cast({line} as int)").alias("line"), F.expr(snippet).alias("snippet"),
        F.lit(confidence).alias("confidence"), F.lit("").alias("evidence"),
    ]


def as_findings(facts: DataFrame, confidence: str = "SUSPECTED",
                confirmed: str | None = None) -> DataFrame:
    """Facts that already are findings: `a` holds the check.

    Rows for which the condition `confirmed` holds are confirmed.
    """
    columns = findings_row("a", "rel", "line", "snippet", confidence)
    if confirmed:
        columns[-2] = F.expr(f"if({confirmed}, 'CONFIRMED', '{confidence}')").alias("confidence")
    return facts.select(*columns)


def rule_scan(files: DataFrame, checks: Iterable[str] | None = None) -> DataFrame:
    """Findings of the pattern rules, one per (repo, check, file, line)."""
    return as_findings(extract(files, lambda c: rule_probe(c, checks)))
