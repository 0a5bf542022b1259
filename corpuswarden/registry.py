"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuswarden.functions import paths, shapes, text as tx
from corpuswarden.operators import (
    config_checks as config, dependency_checks as deps, findings as fnd,
    history_checks as history, project_checks as project, schema_checks as schema,
    structure, study,
)
from corpuswarden.plans import audit
from corpuswarden.plans.facts import extract
from corpuswarden.plans.plugins import Check, Plugin, plugged
from corpuswarden.plans.rulebook import RULE_CHECKS, Rule
from corpuswarden.plans.scan import findings_row, rule_scan
from corpuswarden.plans.store import FactStore, digests
from corpuswarden.session import sized_join, workspace, write_once
from corpuswarden.sources import archives, corpora as src, findings_io as io, findings_table, tree
from corpuswarden.streaming import rescan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function
    return register


def over_facts(name: str, operator, *probes) -> None:
    """An operator over facts of all files; evidence used twice is written once."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(write_once(extract(src.all_files(spark, sf_dir), *probes)))
    QUERIES[name] = run


def over_flags(name: str, operator) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = extract(src.all_files(spark, sf_dir), project.flag_probe, project.file_probe)
        return operator(project.repo_flags(facts))
    QUERIES[name] = run


def over_findings(name: str, operator) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(src.event_findings(spark, sf_dir))


def over_runs(name: str, operator) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(src.runs(spark, sf_dir))


# ---- files ------------------------------------------------------------------------------

@query("ingest_files")
def ingest_files(spark, sf_dir):
    return tree.ingest_files(src.raw_files(spark, sf_dir))


@query("read_archives")
def read_archives(spark, sf_dir):
    """All files written to archives, one folder per repository, and read by ranges of members."""
    root = f"{workspace(spark).folder}/archives-{uuid.uuid4().hex}"
    archives.write_archives(src.repo_bytes(spark, sf_dir), root)
    return archives.read_archives(spark, root).select(
        "repo", "rel", "length", F.md5("content").alias("digest"))


@query("skipped_files")
def skipped_files(spark, sf_dir):
    return tree.skipped_files(src.raw_files(spark, sf_dir), tree.USUAL_MAX_BYTES, tree.USUAL_SNIFF_BYTES)


@query("path_ignore")
def path_ignore(spark, sf_dir):
    return tree.path_ignore(src.raw_files(spark, sf_dir)).select("repo", "rel", "length")


@query("path_is_test")
def path_is_test(spark, sf_dir):
    return src.all_files(spark, sf_dir).selectExpr(
        "repo", "rel", f"{paths.is_test('rel')} as is_test")


@query("file_cap")
def file_cap(spark, sf_dir):
    """The cap over written files: they are counted, ranked and cut from one table."""
    files = write_once(src.all_files(spark, sf_dir).unionByName(src.line_files(spark, sf_dir)))
    return tree.file_cap(files, tree.USUAL_MAX_FILES)


@query("cap_notes")
def cap_notes(spark, sf_dir):
    files = src.all_files(spark, sf_dir).unionByName(src.line_files(spark, sf_dir))
    return tree.cap_notes(files.select("repo", "rel"), tree.USUAL_MAX_FILES)


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, so that every engine prints them alike."""
    return df.withColumns({c: F.array_join(c, "; ") for c in columns})


@query("stack_tags")
def stack_tags(spark, sf_dir):
    """Paths come from the raw listing, texts from what is left after the ignore rules."""
    raw = tree.as_raw(src.repo_bytes(spark, sf_dir))
    facts = extract(tree.ingest_files(tree.path_ignore(raw)), tree.stack_probe)
    return _joined(tree.stack_tags(facts, raw.select("repo", "rel")), "stack")


@query("coverage_summary")
def coverage_summary(spark, sf_dir):
    """Of the audited files, with the usual limits; documents also come as stored bytes."""
    stored = tree.as_raw(src.repo_bytes(spark, sf_dir))
    raw = stored.unionByName(src.raw_files(spark, sf_dir))
    paths, listed = raw.select("repo", "rel"), tree.path_ignore(raw)
    limits = (tree.USUAL_MAX_BYTES, tree.USUAL_SNIFF_BYTES)
    files = tree.ingest_files(listed, *limits)
    facts = audit.corpus_facts(files, paths, audit.COVERAGE_PROBES)
    return _joined(tree.coverage_summary(
        files.select("repo"), tree.skipped_files(listed, *limits),
        audit.coverage_notes(facts, paths, src.audit_commits(spark, sf_dir)),
        tree.stack_tags(facts, paths)), "skipped", "notes", "stack")


@query("corpus_list")
def corpus_list(spark, sf_dir):
    return tree.corpus_list(src.listed_names(spark, sf_dir))


# ---- matching ---------------------------------------------------------------------------

SETTING = r"(?:process\.env|os\.getenv\()[.\"']*([A-Z][A-Z0-9_]{2,})"


@query("rule_matches")
def rule_matches(spark, sf_dir):
    """Every match with its line, its group and the text after it."""
    found, m = tx.matches("text", SETTING, {"match": 0, "name": 1}, window=25)
    return (
        src.all_files(spark, sf_dir).where(f"text rlike {tx.regex(SETTING)}")
        .select("repo", "rel", F.posexplode(F.expr(found)).alias("place", "m"))
        .selectExpr("repo", "rel", "place + 1 as place", f"{m['line']} as line",
                    f"{m['match']} as matched", f"{m['name']} as name", f"{m['tail']} as tail")
    )


@query("line_number")
def line_number(spark, sf_dir):
    """Line of every sentence end in the documents."""
    return (
        src.doc_files(spark, sf_dir)
        .select("repo", "rel", F.explode(F.expr(tx.match_lines("text", r"\.\s"))).alias("line"))
        .groupBy("repo", "rel", "line").agg(F.count("*").alias("n"))
    )


@query("snippet")
def snippet(spark, sf_dir):
    """Trimmed source lines of the documents that name a secret."""
    lines = tx.matching_lines("text", "(?i)password|token")
    picked = tx.let("s", f"named_struct('l', {tx.lines('text')}, 'n', {lines})",
                    "transform(s.n, i -> named_struct('line', i, 'snippet', "
                    + tx.snippet("element_at(s.l, i)") + "))")
    return (src.doc_files(spark, sf_dir).select("repo", "rel", F.explode(F.expr(picked)).alias("s"))
            .selectExpr("repo", "rel", "s.line", "s.snippet"))


def over_lines(name: str, columns: list[str]) -> None:
    """A predicate over every line of all files."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return (
            src.all_files(spark, sf_dir)
            .select("repo", "rel", F.posexplode(F.expr(tx.lines("text"))).alias("i", "line"))
            .selectExpr("repo", "rel", "i + 1 as place", *columns)
        )
    QUERIES[name] = run


QUOTED_VALUE = r'"([^"\s]{3,})"'


def over_values(name: str, columns: list[str]) -> None:
    """A predicate over every quoted value of all files."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = src.all_files(spark, sf_dir)
        values = F.expr(f"regexp_extract_all(text, {tx.quote(QUOTED_VALUE)}, 1)")
        return (files.select("repo", "rel", F.posexplode(values).alias("i", "value"))
                .selectExpr("repo", "rel", "i + 1 as place", "value", *columns))
    QUERIES[name] = run


over_values("shannon_entropy", [f"round({shapes.entropy('value')}, 6) as entropy"])
over_values("credential_shape", [f"{shapes.is_credential('value')} as credential"])
over_values("known_example", [f"{shapes.is_known_example('value')} as example"])
over_values("jwt_public", [f"{shapes.is_public_jwt('value')} as public"])
over_lines("sensitive_log_arg", [f"{shapes.logs_sensitive('line')} as leaks"])
over_lines("service_role_client", [f"{shapes.uses_service_key('line')} as reachable"])
over_lines("non_constant_interp", [f"{shapes.interpolates_variable('line')} as variable"])
QUERIES["numeric_group_threshold"] = lambda spark, sf_dir: (
    src.all_files(spark, sf_dir)
    .select("repo", "rel", F.posexplode(F.expr("regexp_extract_all(text, '(\\\\d+)', 1)"))
            .alias("i", "digits"))
    .selectExpr("repo", "rel", "i + 1 as place", "digits",
                f"{shapes.below('digits', 30000)} as aggressive"))


@query("guard_absent")
def guard_absent(spark, sf_dir):
    """Each fetch call and whether a status test follows within 200 characters."""
    found, m = tx.matches("text", r"fetch\(", {}, window=200)
    guard = tx.matches_regex(m["tail"], r"\.ok\b|\.status\b|statusText")
    return (src.all_files(spark, sf_dir)
            .select("repo", "rel", F.posexplode(F.expr(found)).alias("i", "m"))
            .selectExpr("repo", "rel", "i + 1 as place", f"not {guard} as unguarded"))


@query("rule_scope")
def rule_scope(spark, sf_dir):
    """Which path families each file belongs to."""
    families = {"is_js": paths.JS, "is_py": paths.PY, "is_code": paths.CODE,
                "is_config": paths.CONFIG, "is_doc": paths.DOC_SUFFIXES}
    return src.all_files(spark, sf_dir).selectExpr(
        "repo", "rel", *[f"{paths.has_suffix('rel', s)} as {n}" for n, s in families.items()],
        f"{paths.has_part('rel', paths.TEST_MARKERS)} as has_test_marker")


@query("server_path")
def server_path(spark, sf_dir):
    return src.all_files(spark, sf_dir).selectExpr(
        "repo", "rel", f"{paths.has_part('rel', paths.SERVER_MARKERS)} as on_server")


# ---- the rule scan ----------------------------------------------------------------------

def _rule_query(check: str) -> Query:
    return lambda spark, sf_dir: rule_scan(src.all_files(spark, sf_dir), [check]).drop(
        "confidence", "evidence")


for _check in RULE_CHECKS:
    QUERIES[f"rule_{_check}"] = _rule_query(_check)


@query("rule_scan")
def whole_rule_scan(spark, sf_dir):
    return rule_scan(src.all_files(spark, sf_dir)).drop("confidence", "evidence")


@query("severity_counts")
def severity_counts(spark, sf_dir):
    """The flagship: scan every file with every rule, count by repository and severity."""
    return fnd.severity_counts(rule_scan(src.all_files(spark, sf_dir)))


# ---- checks over several files ----------------------------------------------------------

SQL_PROBES = (schema.sql_probe, schema.chain_probe, project.flag_probe)
over_facts("rls_missing", schema.rls_missing, *SQL_PROBES)
over_facts("permissive_policy", schema.permissive_policy, *SQL_PROBES)
over_facts("public_bucket", schema.public_bucket, *SQL_PROBES)
over_facts("unindexed_filter", schema.unindexed_filter, *SQL_PROBES)
over_facts("uses_supabase", schema.uses_supabase, project.flag_probe)
over_facts("open_rules", config.open_rules, schema.open_rules_probe)
over_facts("secret_file_unignored", config.secret_file_unignored,
           audit.root_texts_probe, config.secret_file_probe)
over_facts("sourcemaps_on", config.sourcemaps_on, config.sourcemap_probe)
over_facts("debug_on", config.debug_on, config.debug_probe)
over_facts("env_first_site", config.first_sites, config.setting_probe)
over_facts("env_undocumented", config.env_undocumented, config.setting_probe)
over_flags("is_web_project", lambda flags: flags.select("repo", "web"))
over_flags("no_error_boundary", project.no_error_boundary)
over_flags("no_headers", project.no_headers)
over_flags("no_tracker", project.no_tracker)
over_flags("no_health", project.no_health)
over_flags("no_ci", project.no_ci)
over_facts("no_tests", lambda facts: project.no_tests(project.repo_flags(facts), facts),
           audit.root_texts_probe, project.flag_probe, project.file_probe)
QUERIES["no_lockfile"] = lambda spark, sf_dir: deps.no_lockfile(
    src.all_files(spark, sf_dir).select("repo", "rel"))
over_facts("install_script", deps.install_script, deps.install_script_probe)
over_facts("dependency_extract", deps.dependency_extract, deps.dependency_probe)
QUERIES["registry_missing"] = lambda spark, sf_dir: deps.registry_missing(
    src.dependencies(spark, sf_dir), src.registry(spark, sf_dir))
QUERIES["typosquat"] = lambda spark, sf_dir: deps.typosquat(
    src.dependencies(spark, sf_dir), src.registry(spark, sf_dir))
QUERIES["history_depth"] = lambda spark, sf_dir: history.history_depth(
    src.history_repos(spark, sf_dir), src.commits(spark, sf_dir))
QUERIES["secret_in_history"] = lambda spark, sf_dir: history.secret_in_history(
    src.added_paths(spark, sf_dir))

# ---- structure --------------------------------------------------------------------------

over_facts("name_families", structure.name_families, structure.module_probe)
over_facts("orphan_modules", structure.orphan_modules, structure.module_probe,
           structure.import_probe)
over_facts("comment_runs", structure.comment_runs, structure.comment_run_probe)
QUERIES["oversized_files"] = lambda spark, sf_dir: structure.oversized_files(
    extract(src.modules(spark, sf_dir), structure.size_probe))
QUERIES["sliding_lines"] = lambda spark, sf_dir: structure.sliding_lines(
    src.all_files(spark, sf_dir))
QUERIES["clone_blocks"] = lambda spark, sf_dir: structure.clone_blocks(
    src.all_files(spark, sf_dir))
QUERIES["clone_blocks_documents"] = lambda spark, sf_dir: structure.clone_blocks(
    src.doc_files(spark, sf_dir), None)


@query("findings_all")
def findings_all(spark, sf_dir):
    """The whole audit of all files: every check, history and registry included."""
    files = src.all_files(spark, sf_dir)
    return audit.findings_all(
        files, files.select("repo", "rel"), commits=src.audit_commits(spark, sf_dir),
        added_paths=src.audit_added_paths(spark, sf_dir), registry=src.audit_registry(spark, sf_dir))


@query("audit_from_bytes")
def audit_from_bytes(spark, sf_dir):
    """From stored bytes to findings: ignore rules, decoding, every check."""
    raw = tree.as_raw(src.repo_bytes(spark, sf_dir))
    return audit.findings_all(
        tree.ingest_files(tree.path_ignore(raw)), raw.select("repo", "rel"),
        commits=src.audit_commits(spark, sf_dir), added_paths=src.audit_added_paths(spark, sf_dir),
        registry=src.audit_registry(spark, sf_dir))


@query("audit_of_changes")
def audit_of_changes(spark, sf_dir):
    """The whole audit after a second scan, which read only the files that changed since the first."""
    store = FactStore(spark, f"{workspace(spark).folder}/store-{uuid.uuid4().hex}")
    for files in (src.all_files(spark, sf_dir), src.later_files(spark, sf_dir)):
        files = write_once(files, compression="zstd")
        store.update(digests(files), lambda wanted: sized_join(files, wanted, ["repo", "rel"], "left_semi"))
    return store.findings(
        files.select("repo", "rel"), lambda wanted: sized_join(files, wanted, ["repo", "rel"], "left_semi"),
        commits=src.audit_commits(spark, sf_dir), added_paths=src.audit_added_paths(spark, sf_dir),
        registry=src.audit_registry(spark, sf_dir))


# ---- a plugin -----------------------------------------------------------------------------

def created_twice(facts: DataFrame, listing: DataFrame) -> DataFrame:
    """Tables that more than one file of a repository creates, at the first of them."""
    return facts.where("kind = 'table'").groupBy("repo", "a").agg(
        F.count_distinct("rel").alias("n"), F.min(F.struct("rel", "line")).alias("site")).where("n > 1").select(
        *findings_row("'Q2'", "site.rel", "site.line", "concat(n, ' files create table ', a)", "CONFIRMED"))


HOUSE = Plugin(
    "house",
    (Check("Q1", "P3", "auto", "Weak digest", domain="House rules"),
     Check("Q2", "P2", "assisted", "Table created in several files")),
    rules=(Rule("Q1", r"createHash\(\s*[\"']md5[\"']\s*\)", ("createHash(",), suffixes=paths.JS),),
    operators=(created_twice,))


@query("own_checks")
def own_checks(spark, sf_dir):
    """What a caller's own rule and check find in the whole audit of all files."""
    files = src.all_files(spark, sf_dir)
    with plugged(spark, HOUSE):
        found = audit.findings_all(files, files.select("repo", "rel"))
    return found.where(F.col("check_id").isin("Q1", "Q2"))


QUERIES["history_notes"] = lambda spark, sf_dir: history.history_notes(
    src.history_repos(spark, sf_dir), src.commits(spark, sf_dir))


# ---- findings ---------------------------------------------------------------------------

over_findings("catalog_enrich", lambda f: fnd.catalog_enrich(f).drop("title"))
over_findings("findings_sink", lambda f: io.findings_sink(f).drop("title"))
over_findings("findings_load", lambda f: io.findings_load(f.drop("confidence", "evidence")))
QUERIES["findings_append"] = lambda spark, sf_dir: io.findings_append(
    src.findings_prev(spark, sf_dir), src.findings_cur(spark, sf_dir))
QUERIES["finding_dedup"] = lambda spark, sf_dir: fnd.finding_dedup(
    src.raw_matches(spark, sf_dir), ["rule", "offset"])
QUERIES["severity_counts_filled"] = lambda spark, sf_dir: fnd.severity_counts(
    src.event_findings(spark, sf_dir), src.user_repos(spark, sf_dir))
QUERIES["fix_plan"] = lambda spark, sf_dir: fnd.fix_plan(
    src.event_findings(spark, sf_dir), src.user_repos(spark, sf_dir))
QUERIES["verdict"] = lambda spark, sf_dir: fnd.verdict(
    src.event_findings(spark, sf_dir), src.user_repos(spark, sf_dir))
QUERIES["gate"] = lambda spark, sf_dir: fnd.gate(
    src.event_findings(spark, sf_dir), src.user_repos(spark, sf_dir), "P1", ["S1", "R2", "ZZ"])
over_findings("gate_rows", lambda f: fnd.gate_rows(f, "P1"))
over_findings("per_file_collapse", fnd.per_file_collapse)
over_findings("finding_order", fnd.finding_order)
over_findings("blocking_top", fnd.blocking_top)
over_findings("blocking_advice", lambda f: fnd.blocking_advice(f).drop("title"))


@query("audit_table")
def audit_table(spark, sf_dir):
    """The report with its coverage section: a repository's findings as its skipped files."""
    findings = src.event_findings(spark, sf_dir)
    users = src.user_repos(spark, sf_dir)
    notes = users.selectExpr("repo", "if(length(repo) % 2 = 0, 'even', 'odd') as note")
    stack = users.selectExpr("repo", "array(left(repo, 1)) as stack")
    skipped = findings.selectExpr("repo", "concat(file, ':', line, ':', check_id) as rel",
                                  "'binary' as reason").distinct()
    return fnd.audit_table(findings, coverage=tree.coverage_summary(
        users.select("repo"), skipped, notes, stack))


QUERIES["run_diff"] = lambda spark, sf_dir: fnd.run_diff(
    src.findings_prev(spark, sf_dir), src.findings_cur(spark, sf_dir))


@query("stored_diff")
def stored_diff(spark, sf_dir):
    """The diff with a run that is kept in buckets of its key."""
    name = f"findings_{uuid.uuid4().hex}"
    findings_table.store(src.findings_prev(spark, sf_dir), name, f"{workspace(spark).folder}/{name}")
    return findings_table.diff(spark.table(name), src.findings_cur(spark, sf_dir))


QUERIES["diff_counts"] = lambda spark, sf_dir: fnd.diff_counts(
    src.findings_prev(spark, sf_dir), src.findings_cur(spark, sf_dir))
QUERIES["recall_precision"] = lambda spark, sf_dir: fnd.recall_precision(
    src.findings_prev(spark, sf_dir), src.findings_cur(spark, sf_dir), ("O3", "T2", "H8"))
QUERIES["site_recall"] = lambda spark, sf_dir: fnd.site_recall(
    src.findings_prev(spark, sf_dir), src.findings_cur(spark, sf_dir))

# ---- corpus study -----------------------------------------------------------------------

over_runs("check_prevalence", study.check_prevalence)
over_runs("critical_prevalence", study.critical_prevalence)
over_runs("domain_prevalence", study.domain_prevalence)
over_runs("corpus_summary", study.corpus_summary)
over_runs("stack_counts", study.stack_counts)
over_runs("segment_report", study.segment_report)
over_runs("failure_reasons", study.failure_reasons)
over_runs("most_common_checks", study.most_common_checks)
over_runs("sample_accounting", lambda r: study.sample_accounting(r, 40, 99))
QUERIES["pseudonymise"] = lambda spark, sf_dir: study.pseudonymise(
    src.user_repos(spark, sf_dir))
QUERIES["stratified_sample"] = lambda spark, sf_dir: study.stratified_sample(
    src.event_findings(spark, sf_dir), src.user_repos(spark, sf_dir), 400)


@query("repo_runs")
def repo_runs(spark, sf_dir):
    """Scan results built from an audit's findings, with pseudonymous ids."""
    findings = src.event_findings(spark, sf_dir)
    files = src.user_repos(spark, sf_dir).select("repo", F.length("repo").cast("long").alias("files"))
    stack = src.user_repos(spark, sf_dir).selectExpr("repo", "array(left(repo, 1)) as stack")
    runs = study.repo_runs(findings, stack, files).select("*", "severity.*")
    return _joined(runs, "checks", "stack").drop("severity", "seconds", "reason")


@query("exact_median")
def exact_median(spark, sf_dir):
    """Exact median of a continuous column of the largest table."""
    return study.exact_median(src.table(spark, sf_dir, "lineitem"), "l_extendedprice")


# ---- streaming --------------------------------------------------------------------------

@query("stream_rule_scan")
def stream_rule_scan(spark, sf_dir):
    """The rule scan over a stream of file batches, run until the input is used up."""
    return rescan.replay(src.all_files(spark, sf_dir))
