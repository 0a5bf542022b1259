"""Findings sinks and loaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuswarden.catalog import CHECK_IDS
from corpuswarden.functions import text as tx
from corpuswarden.operators.findings import catalog_enrich
from corpuswarden.schema import CONFIDENCES, FINDINGS, REPO_RUNS, SCHEMA_VERSION


def findings_sink(findings: DataFrame) -> DataFrame:
    """Rows as they are stored: versioned, trimmed and enriched from the catalog.

    An unknown check or confidence fails the job, as it would be lost in the join.
    """
    known = F.col("check_id").isin(*CHECK_IDS) & F.col("confidence").isin(*CONFIDENCES)
    checked = findings.where(F.when(known, F.lit(True)).otherwise(F.raise_error(
        F.concat(F.lit("unknown check or confidence: "), "check_id")).cast("boolean")))
    return catalog_enrich(checked).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "repo", "check_id", "file", "line",
        F.expr(tx.snippet("snippet")).alias("snippet"), "confidence", "evidence",
        "severity", "fix_class", "title", "domain")


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet",
                   mode: str = "errorifexists") -> None:
    findings_sink(findings).write.mode(mode).format(fmt).save(path)


def findings_load(stored: DataFrame) -> DataFrame:
    """Stored rows in the findings schema, with the defaults for what is missing."""
    have = set(stored.columns)
    defaults = {"confidence": "SUSPECTED", "evidence": ""}
    columns = []
    for field in FINDINGS:
        default = F.lit(defaults.get(field.name)).cast(field.dataType)
        value = F.coalesce(field.name, default) if field.name in have else default
        columns.append(value.cast(field.dataType).alias(field.name))
    return stored.select(*columns)


def read_findings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return findings_load(spark.read.schema(FINDINGS).format(fmt).load(path))


def findings_append(existing: DataFrame, new: DataFrame) -> DataFrame:
    return findings_load(existing).unionByName(findings_load(new))


def notes_append(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Coverage notes of each repository with the new ones added once, order kept."""
    added = new.groupBy("repo").agg(F.array_sort(F.collect_set("note")).alias("added"))
    nothing = F.expr("cast(array() as array<string>)")
    return existing.join(added, "repo", "full").select(
        "repo", F.array_distinct(F.concat(
            F.coalesce("notes", nothing), F.coalesce("added", nothing))).alias("notes"))


DOCUMENT = (
    "schemaVersion int, coverage struct<scanned_files:bigint,skipped:array<string>,"
    "notes:array<string>,stack:array<string>>, findings array<struct<check_id:string,"
    "file:string,line:int,snippet:string,confidence:string,evidence:string>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Findings documents, one JSON file per repository, named after it."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)[.]json$", 1)
    return (
        spark.read.schema(DOCUMENT).option("multiLine", "true").json(path)
        .withColumn("repo", F.url_decode(name))
    )


def document_findings(documents: DataFrame) -> DataFrame:
    """The findings of stored documents, with the defaults for what is missing."""
    rows = documents.select("repo", F.explode("findings").alias("f")).select("repo", "f.*")
    return findings_load(rows)


def document_coverage(documents: DataFrame) -> DataFrame:
    return documents.select("repo", "coverage.*")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A log of scan results, one JSON line per repository."""
    return spark.read.schema(REPO_RUNS).json(path)
