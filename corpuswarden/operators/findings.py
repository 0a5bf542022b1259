"""Operators on a findings table: enrich, dedup, count, gate, order, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpuswarden.catalog import CHECKS, DOMAINS, checks, fix_class_of, severity_of
from corpuswarden.schema import FIX_CLASSES, SEVERITIES

KEY = ["repo", "check_id", "file", "line"]
MAX_BLOCKING = 5
MAX_GATE_ROWS = 20


def catalog_enrich(findings: DataFrame) -> DataFrame:
    """Severity, fix class, title and domain of each finding; the catalog has 64 rows."""
    catalog = checks(findings.sparkSession).select(
        "check_id", "severity", "fix_class", "title", "domain")
    return findings.join(F.broadcast(catalog), "check_id")


def finding_dedup(matches: DataFrame, order: list[str]) -> DataFrame:
    """One row per finding key, the first by `order`; combined before the shuffle."""
    rest = [c for c in matches.columns if c not in KEY + order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return matches.groupBy(*KEY).agg(first).select(*KEY, *[f"first.{c}" for c in rest])


def _counts(findings: DataFrame, repos: DataFrame | None, column, values) -> DataFrame:
    counted = findings.withColumn("_of", column).groupBy("repo").agg(
        *[F.count_if(F.col("_of") == v).alias(v) for v in values])
    if repos is None:
        return counted
    return repos.select("repo").join(counted, "repo", "left").na.fill(0, list(values))


def severity_counts(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Findings per severity, zero-filled; `repos` adds repositories without findings."""
    return _counts(findings, repos, severity_of(), SEVERITIES)


def fix_plan(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    return _counts(findings, repos, fix_class_of(), FIX_CLASSES)


def verdict(findings: DataFrame, repos: DataFrame, confirmed_only: bool = True) -> DataFrame:
    """The release verdict; suspected findings do not count unless asked to."""
    if confirmed_only:
        findings = findings.where("confidence = 'CONFIRMED'")
    worst = findings.groupBy("repo").agg(F.min(severity_of()).alias("worst"))
    # The three verdicts.
    said = (F.when(F.col("worst") == "P0", "DO NOT SHIP")
            .when(F.col("worst") == "P1", "SHIP WITH CAUTION").otherwise("CLEAR"))
    return repos.select("repo").join(worst, "repo", "left").select("repo", said.alias("verdict"))


def _blocks(findings: DataFrame, fail_on: str, only: list[str]) -> DataFrame:
    severity = severity_of()
    blocking = findings.withColumn("severity", severity).where(
        F.col("severity").isNotNull() & (F.col("severity") <= fail_on))
    return blocking.where(F.col("check_id").isin(only)) if only else blocking


def gate(findings: DataFrame, repos: DataFrame, fail_on: str = "P0",
         only: list[str] | None = None) -> DataFrame:
    """Whether a repository is blocked; confidence and unknown checks do not matter."""
    counted = _blocks(findings, fail_on, only or []).groupBy("repo").agg(
        F.count("*").alias("blocking"))
    return repos.select("repo").join(counted, "repo", "left").select(
        "repo", F.coalesce("blocking", F.lit(0)).alias("blocking"),
        (F.coalesce("blocking", F.lit(0)) > 0).alias("blocked"))


def gate_rows(findings: DataFrame, fail_on: str = "P0", only: list[str] | None = None,
              shown: int = MAX_GATE_ROWS) -> DataFrame:
    """The blocking rows a gate prints; the rank limit is applied before the shuffle."""
    place = F.row_number().over(Window.partitionBy("repo").orderBy(
        "severity", "check_id", "file", "line", "snippet"))
    return (_blocks(findings, fail_on, only or []).withColumn("place", place)
            .where(f"place <= {shown}")
            .select("repo", "severity", "check_id", "file", "line", "place"))


def per_file_collapse(findings: DataFrame) -> DataFrame:
    """O3: the console calls of a file become one finding with their number."""
    return findings.where("check_id = 'O3'").groupBy("repo", "check_id", "file").agg(
        F.min("line").alias("line"), F.count("*").alias("n"),
    ).selectExpr("repo", "check_id", "file", "line",
                 "concat(n, ' console calls in one file') as snippet",
                 "'SUSPECTED' as confidence", "'' as evidence")


def finding_order(findings: DataFrame) -> DataFrame:
    """Severity, check, file, line; for sinks only."""
    return findings.withColumn("severity", severity_of()).orderBy(
        "severity", "check_id", "file", "line", "repo", "snippet")


def _ranked(confirmed: DataFrame, shown: int) -> DataFrame:
    order = Window.partitionBy("repo").orderBy("severity", "check_id", "file", "line", "snippet")
    return (confirmed.where("severity in ('P0', 'P1')")
            .withColumn("place", F.row_number().over(order)).where(f"place <= {shown}"))


def blocking_top(findings: DataFrame, shown: int = MAX_BLOCKING) -> DataFrame:
    """The first confirmed P0/P1 findings of each repository and how many more exist."""
    blocking = findings.where("confidence = 'CONFIRMED'").withColumn(
        "severity", severity_of()).where("severity in ('P0', 'P1')")
    totals = blocking.groupBy("repo").agg(F.count("*").alias("total"))
    return _ranked(blocking, shown).join(totals, "repo").select(
        "repo", "place", "severity", "check_id", "file", "line", "snippet",
        F.greatest(F.col("total") - shown, F.lit(0)).alias("more"))


def blocking_advice(findings: DataFrame, shown: int = MAX_BLOCKING) -> DataFrame:
    """The rows of `blocking_top` with why they matter and what mends them."""
    catalog = checks(findings.sparkSession).select("check_id", "title", "fix_class", "why", "fix")
    return blocking_top(findings, shown).join(F.broadcast(catalog), "check_id")


def audit_table(findings: DataFrame, shown: int = MAX_BLOCKING,
                coverage: DataFrame | None = None) -> DataFrame:
    """The report as rows: blocking, the rest by domain, suspected, coverage.

    A key among the blocking rows is not listed again. `part` orders the sections.
    `coverage` is what `coverage_summary` returns; its figures and notes become rows
    without a check.
    """
    rated = findings.withColumn("severity", severity_of())
    confirmed = rated.where("confidence = 'CONFIRMED'")
    columns = ["repo", "check_id", "file", "line", "snippet"]
    lead = _ranked(confirmed, shown).select(*columns, "place")
    domain = F.create_map(*[F.lit(v) for pair in DOMAINS.items() for v in pair])[
        F.substring("check_id", 1, 1)]
    rest = confirmed.join(lead.select(*KEY).distinct(), KEY, "left_anti")
    suspected = rated.where("confidence <> 'CONFIRMED'")

    def section(part: int, name, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(part).alias("part"), name.alias("section"), *columns)

    table = (
        section(1, F.lit("Blocking"), lead)
        .unionByName(section(2, domain, rest))
        .unionByName(section(3, F.lit("Suspected"), suspected))
    )
    if coverage is None:
        return table
    said = coverage.selectExpr("repo", f"""explode(concat(
        array(concat(scanned_files, ' files and {sum(c[4] for c in CHECKS)} checks')),
        if(size(stack) > 0, array(concat('built with ', array_join(stack, ', '))), array()), notes,
        if(skipped_total > 0, array(concat(skipped_total, ' files left out: ', array_join(skipped, ', '),
           if(skipped_total > size(skipped), ', ...', ''))), array()))) as snippet""")
    return table.unionByName(said.selectExpr(
        "4 as part", "'Coverage' as section", "repo", "cast(null as string) as check_id",
        "cast(null as string) as file", "cast(null as int) as line", "snippet"))


def run_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Status of each finding key between two runs, with the whole newer row.

    Both runs go through one aggregation on the key: duplicates collapse before the
    shuffle and no join is needed.
    """
    payload = F.struct("snippet", "confidence", "evidence")
    both = previous.select(*KEY, F.lit(1).alias("run"), payload.alias("row")).unionByName(
        current.select(*KEY, F.lit(2).alias("run"), payload.alias("row")))
    met = both.groupBy(*KEY).agg(
        F.expr("max(row) filter (where run = 1)").alias("old"),
        F.expr("max(row) filter (where run = 2)").alias("new"))
    status = (F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "fixed")
              .otherwise("unchanged"))
    return met.select(*KEY, status.alias("status"), F.coalesce("new", "old").alias("row")).select(
        *KEY, "status", "row.*")


def diff_counts(previous: DataFrame, current: DataFrame) -> DataFrame:
    return run_diff(previous, current).groupBy("repo").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("new", "fixed", "unchanged")])


def recall_precision(expected: DataFrame, found: DataFrame,
                     advisory: tuple[str, ...] = ()) -> DataFrame:
    """Per repository: expected, hit and missed checks, checks nobody expected, and ratios.

    `recall` is null where nothing was expected, `precision` where nothing was found.
    """
    want = expected.select("repo", "check_id").distinct().withColumn("wanted", F.lit(True))
    have = found.where(~F.col("check_id").isin(*advisory)).select(
        "repo", "check_id").distinct().withColumn("found", F.lit(True))
    met = want.join(have, ["repo", "check_id"], "full").na.fill(False, ["wanted", "found"])
    return met.groupBy("repo").agg(
        F.count_if("wanted").alias("expected"),
        F.count_if(F.col("wanted") & F.col("found")).alias("hit"),
        F.count_if(F.col("wanted") & ~F.col("found")).alias("missed"),
        F.count_if(~F.col("wanted") & F.col("found")).alias("unexpected"),
    ).withColumn("recall", F.expr("if(expected > 0, hit / expected, null)")).withColumn(
        "precision", F.expr("if(hit + unexpected > 0, hit / (hit + unexpected), null)"))


def site_recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Per repository and check: whether a finding sits in one of the expected files."""
    hit = found.select("repo", "check_id", "file").distinct().withColumn("hit", F.lit(True))
    return (
        expected.select("repo", "check_id", "file").distinct()
        .join(hit, ["repo", "check_id", "file"], "left")
        .groupBy("repo", "check_id")
        .agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("on_site"))
    )
