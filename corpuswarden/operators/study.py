"""Corpus statistics over one row per scanned repository."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame, Window, functions as F

from corpuswarden.catalog import HISTORY_CHECKS, severity_of
from corpuswarden.schema import SEVERITIES
from corpuswarden.session import sized_join, write_once

SEGMENTS = ("supabase", "firebase", "nextjs", "express")
MIN_SEGMENT = 10
ACCURACY = 10_000  # of the sketch of quantiles: ranks are right to a ten-thousandth
BRACKET = 5 / ACCURACY  # share of the values on each side of the middle that is kept
SETTLE = 200_000  # different values of a column that reach the driver, at most


def pseudonymise(repos: DataFrame) -> DataFrame:
    """A short digest in place of the repository's name."""
    return repos.withColumn("repo", F.substring(F.sha2("repo", 256), 1, 12))


def repo_runs(findings: DataFrame, stack: DataFrame, file_counts: DataFrame) -> DataFrame:
    """One row per repository from an audit; history checks stay out."""
    counted = findings.where(~F.col("check_id").isin(*HISTORY_CHECKS))
    per_repo = counted.withColumn("_sev", severity_of()).groupBy("repo").agg(
        F.array_sort(F.collect_set("check_id")).alias("checks"),
        F.struct(*[F.count_if(F.col("_sev") == s).alias(s) for s in SEVERITIES]).alias("severity"),
        F.count("*").alias("total"))
    zero = F.struct(*[F.lit(0).cast("long").alias(s) for s in SEVERITIES])
    nothing = F.expr("cast(array() as array<string>)")
    joined = file_counts.join(per_repo, "repo", "left").join(stack, "repo", "left")
    return pseudonymise(joined).select(
        F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"),
        F.col("repo").alias("id"), F.coalesce("checks", nothing).alias("checks"),
        F.coalesce("severity", zero).alias("severity"),
        F.coalesce("total", F.lit(0)).alias("total"), "files",
        F.coalesce("stack", nothing).alias("stack"), F.lit(None).cast("double").alias("seconds"))


def _scanned(runs: DataFrame) -> DataFrame:
    return runs.where("ok")


def _share(counts: DataFrame, runs: DataFrame) -> DataFrame:
    """Percentage of the scanned repositories; the total is one scalar subquery."""
    total = _scanned(runs).agg(F.count("*")).scalar()
    return counts.withColumn("pct", 100.0 * F.col("repos") / total)


def check_prevalence(runs: DataFrame) -> DataFrame:
    """Per check: how many scanned repositories show it, and their share."""
    hits = (
        _scanned(runs).select(F.explode(F.array_distinct("checks")).alias("check_id"))
        .where(~F.col("check_id").isin(*HISTORY_CHECKS))
        .groupBy("check_id").agg(F.count("*").alias("repos"))
    )
    return _share(hits, runs)


def critical_prevalence(runs: DataFrame) -> DataFrame:
    return check_prevalence(runs).where(severity_of() == "P0")


def domain_prevalence(runs: DataFrame) -> DataFrame:
    """Per domain: repositories with at least one of its checks."""
    history = ", ".join(f"'{c}'" for c in HISTORY_CHECKS)
    domains = (f"array_distinct(transform(filter(checks, c -> c not in ({history})), "
               f"c -> left(c, 1)))")
    hits = (
        _scanned(runs).select(F.explode(F.expr(domains)).alias("domain"))
        .groupBy("domain").agg(F.count("*").alias("repos"))
    )
    return _share(hits, runs)


def stack_counts(runs: DataFrame) -> DataFrame:
    return (_scanned(runs).select(F.explode(F.array_distinct("stack")).alias("tag"))
            .groupBy("tag").agg(F.count("*").alias("repos")))


def exact_medians(df: DataFrame, columns: dict[str, str]) -> dict[str, float | None]:
    """Exact medians of expressions over `df`; values that are no finite numbers do not count.

    The values are written once. A mergeable sketch of quantiles brackets the middle ranks
    between two values, and a second pass counts the few different values between them:
    three jobs, whatever the magnitudes. Only where the bracket may hold more than `SETTLE`
    values, beyond some hundred million rows, it is counted and sketched once more, and
    each time a thousandth of the values is left. Nothing is sorted, and at most `SETTLE`
    values of a column and their counts reach the driver.
    """
    kept = write_once(df.selectExpr(*[f"if(abs(cast({e} as double)) < double('inf'), cast({e} as double), null) as `{n}`"
                                      for n, e in columns.items()]))
    bounds = _sketched(kept, {name: (f"`{name}`", 0.5, 0.5) for name in columns})
    ranks = {name: ((n + 1) // 2, n // 2 + 1) for name, (n, _, _) in bounds.items()}
    wide = {name: b for name, b in bounds.items() if 2 * BRACKET * b[0] > SETTLE}
    while wide:
        # How many values stand below the bracket, at its lower end and between its ends.
        counted = kept.selectExpr(*[
            f"struct(count_if(`{c}` < double('{low!r}')) as below, count_if(`{c}` = double('{low!r}')) as low, "
            f"count_if(`{c}` > double('{low!r}') and `{c}` < double('{high!r}')) as inside) as `{c}`"
            for c, (_, low, high) in wide.items()]).first()
        again = {}
        for name, (_, low, high) in wide.items():
            start, inside = counted[name]["below"] + counted[name]["low"], counted[name]["inside"]
            first, last = (r - start for r in ranks[name])
            if inside > SETTLE and last >= 1 and first <= inside:
                again[name] = (f"if(`{name}` > double('{low!r}') and `{name}` < double('{high!r}'), `{name}`, null)",
                               max(first, 1) / inside, min(last, inside) / inside)
        narrower = _sketched(kept, again) if again else {}
        # The ends stay in sight where a rank may be one of them.
        for name, (n, low, high) in narrower.items():
            start, inside = counted[name]["below"] + counted[name]["low"], counted[name]["inside"]
            bounds[name] = (n, wide[name][1] if ranks[name][0] <= start else low,
                            wide[name][2] if ranks[name][1] > start + inside else high)
        wide = {name: bounds[name] for name in narrower if 2 * BRACKET * narrower[name][0] > SETTLE}
    return _settled(kept, bounds, ranks)


def _sketched(kept: DataFrame, parts: dict[str, tuple[str, float, float]]) -> dict[str, tuple[int, float, float]]:
    """(count, lower, upper) of expressions, with the ranks from one share to another between."""
    made = kept.selectExpr(*[
        f"struct(count({e}) as n, percentile_approx({e}, array({max(first - BRACKET, 0.0)}D, "
        f"{min(last + BRACKET, 1.0)}D), {ACCURACY}) as ends) as `{name}`"
        for name, (e, first, last) in parts.items()]).first()
    return {name: (made[name]["n"], *made[name]["ends"]) for name in parts if made[name]["n"]}


def _settled(kept: DataFrame, bounds: dict[str, tuple[int, float, float]],
             ranks: dict[str, tuple[int, int]]) -> dict[str, float | None]:
    """The means of the values at the ranks, from the counts of the values within the bounds."""
    if not bounds:
        return dict.fromkeys(kept.columns)
    seen = ", ".join(
        f"if(`{name}` <= double('{high!r}'), named_struct('k', '{k}', "
        f"'v', if(`{name}` < double('{low!r}'), null, `{name}`)), null)"
        for k, (name, (_, low, high)) in enumerate(bounds.items()))
    rows = kept.selectExpr(f"explode(array_compact(array({seen}))) as s").groupBy("s.k", "s.v").count().collect()
    medians: dict[str, float | None] = dict.fromkeys(kept.columns)
    for k, name in enumerate(bounds):
        own = [row for row in rows if row["k"] == str(k)]
        below = sum(row["count"] for row in own if row["v"] is None)
        held = sorted((row["v"], row["count"]) for row in own if row["v"] is not None)
        ends = list(accumulate((n for _, n in held), initial=below))
        if not below < ranks[name][0] <= ranks[name][1] <= ends[-1]:
            raise RuntimeError(f"{name}: the sketch missed the middle")
        values = [held[bisect_left(ends, rank) - 1][0] for rank in ranks[name]]
        medians[name] = (values[0] + values[1]) / 2
    return medians


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """Exact median of a column as one row."""
    value = exact_medians(df, {"median": f"`{column}`"})["median"]
    return df.sparkSession.range(1).select(F.lit(value).cast("double").alias("median"))


def corpus_summary(runs: DataFrame) -> DataFrame:
    """The headline figures as one row; repositories without findings count."""
    narrow = write_once(runs.selectExpr(
        "ok", "files", "total", "seconds", *[f"severity.{s} as {s.lower()}" for s in SEVERITIES]))
    medians = exact_medians(narrow.where("ok"), {
        "median_findings": "total", "median_p0": "p0", "median_seconds": "seconds"})
    return narrow.agg(
        F.count("*").alias("repos_attempted"),
        F.count_if("ok").alias("repos_scanned"),
        F.count_if(~F.col("ok")).alias("repos_failed"),
        F.expr("sum(files) filter (where ok)").alias("files_scanned"),
        F.expr("avg(total) filter (where ok)").alias("mean_findings"),
        F.expr("100.0D * count_if(ok and p0 > 0) / count_if(ok)").alias("pct_with_p0"),
        *[F.expr(f"sum({s.lower()}) filter (where ok)").alias(f"total_{s.lower()}") for s in SEVERITIES],
    ).select("*", *[F.lit(value).cast("double").alias(name) for name, value in medians.items()])


def segment_report(runs: DataFrame, minimum: int = MIN_SEGMENT, top: int = 10) -> DataFrame:
    """Per stack segment: size, P0 share, and its most common P0/P1 checks.

    Segments are unequal, so checks are counted per (segment, check) and only those
    few dozen counts are ranked.
    """
    tagged = _scanned(runs).select(
        F.explode(F.array_distinct("stack")).alias("tag"),
        (F.col("severity.P0") > 0).alias("critical"), "checks",
    ).where(F.col("tag").isin(*SEGMENTS))
    sizes = tagged.groupBy("tag").agg(
        F.count("*").alias("repos"), F.count_if("critical").alias("critical"),
    ).where(f"repos >= {minimum}")
    hits = (
        tagged.select("tag", F.explode(F.array_distinct("checks")).alias("check_id"))
        .where(severity_of().isin("P0", "P1") & ~F.col("check_id").isin(*HISTORY_CHECKS))
        .groupBy("tag", "check_id").agg(F.count("*").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "check_id"))
    return (
        sizes.join(hits, "tag")
        .withColumn("place", place).where(f"place <= {top}")
        .selectExpr("tag", "repos", "100.0D * critical / repos as pct_with_p0", "place",
                    "check_id", "100.0D * n / repos as pct")
    )


def failure_reasons(runs: DataFrame) -> DataFrame:
    return runs.where("not ok").groupBy("reason").agg(F.count("*").alias("repos"))


def most_common_checks(runs: DataFrame, checks: int = 25, stacks: int = 12) -> DataFrame:
    """The top of the check and stack lists, one table."""
    top_checks = check_prevalence(runs).orderBy(F.desc("repos"), "check_id").limit(checks)
    top_stacks = stack_counts(runs).orderBy(F.desc("repos"), "tag").limit(stacks)
    return (
        top_checks.select(F.lit("check").alias("list"), F.col("check_id").alias("name"), "repos")
        .unionByName(top_stacks.select(F.lit("stack").alias("list"), F.col("tag").alias("name"),
                                       "repos"))
    )


def sampled_repos(repos: DataFrame, count: int, seed: int) -> DataFrame:
    """A repeatable sample: the smallest digests of seed and name."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), "repo"))
    return (repos.select("repo").distinct().withColumn("draw", draw)
            .orderBy("draw", "repo").limit(count))


def stratified_sample(findings: DataFrame, repos: DataFrame, count: int = 40,
                      per_check: int = 10, seed: int = 99, severity: str = "P0") -> DataFrame:
    """The first findings of each check of one severity within a sample of repositories."""
    chosen = sampled_repos(repos, count, seed)
    place = F.row_number().over(Window.partitionBy("check_id").orderBy(
        "draw", "repo", "file", "line", "snippet"))
    return (
        sized_join(findings.where(severity_of() == severity), chosen, "repo")
        .withColumn("place", place).where(f"place <= {per_check}")
        .select("check_id", "place", "repo", "file", "line",
                F.substring("snippet", 1, 160).alias("snippet"))
    )


def sample_accounting(runs: DataFrame, count: int, seed: int) -> DataFrame:
    """Requested, attempted, scanned and failed repositories of a sample."""
    named = runs.withColumnRenamed("id", "repo")
    chosen = sampled_repos(named, count, seed)
    return sized_join(named, chosen, "repo").agg(
        F.lit(count).alias("requested"), F.count("*").alias("attempted"),
        F.count_if("ok").alias("scanned"), F.count_if(~F.col("ok")).alias("failed"))
