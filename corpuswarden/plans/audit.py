"""The whole audit: one pass over the texts, then joins over the facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from corpuswarden.operators import (
    config_checks, dependency_checks, history_checks, project_checks, schema_checks, structure,
)
from corpuswarden.operators.findings import per_file_collapse
from corpuswarden.plans.facts import FileColumns, extract, rule_probe
from corpuswarden.plans.scan import as_findings
from corpuswarden.schema import FINDINGS
from corpuswarden.session import write_once
from corpuswarden.sources import tree

ROOT_TEXTS = (".gitignore", "package.json")


def root_texts_probe(c: FileColumns) -> str:
    return config_checks.root_probe(c, ROOT_TEXTS)


# What only a path tells; it holds for files that are not scanned too.
PATH_PROBES = (
    project_checks.file_probe,
    project_checks.path_flag_probe,
    config_checks.secret_file_probe,
)
PROBES = (
    rule_probe,
    root_texts_probe,
    config_checks.sourcemap_probe,
    config_checks.debug_probe,
    config_checks.setting_probe,
    schema_checks.sql_probe,
    schema_checks.open_rules_probe,
    schema_checks.chain_probe,
    project_checks.flag_probe,
    dependency_checks.dependency_probe,
    dependency_checks.install_script_probe,
    dependency_checks.broken_lock_probe,
    structure.module_probe,
    structure.import_probe,
    structure.comment_run_probe,
    structure.size_probe,
    structure.block_probe,
    tree.stack_probe,
)

# What plugins add to the probes and to the checks over all facts.
OWN_PROBES: list = []
OWN_OPERATORS: list = []

# Checks computed inside one file and reported as confirmed.
CONFIRMED_LOCAL = ("S6", "D9", "P5")


# What coverage notes and stack tags need.
COVERAGE_PROBES = (
    root_texts_probe,
    schema_checks.sql_probe,
    project_checks.flag_probe,
    dependency_checks.broken_lock_probe,
    tree.stack_probe,
)


def all_probes() -> tuple:
    """The probes of the whole audit, plugins included."""
    return (*PROBES, *OWN_PROBES)


def corpus_facts(files: DataFrame, paths: DataFrame | None = None, probes=None) -> DataFrame:
    """The probes' evidence, written once and partitioned by kind.

    `paths` is every (repo, rel) there is; those that are not ignored count as present
    whether or not their text is among `files`. Without it the files are all there is.
    """
    named = path_facts(files if paths is None else paths)
    found = extract(files, *(all_probes() if probes is None else probes))
    return write_once(found.unionByName(named), partition_by="kind")


def path_facts(paths: DataFrame) -> DataFrame:
    """What the paths alone tell, of those that are not ignored."""
    listed = tree.path_ignore(paths)
    return extract(listed.selectExpr("repo", "rel", "'' as text"), *PATH_PROBES)


def findings_all(files: DataFrame | Callable[[DataFrame], DataFrame], paths: DataFrame, facts: DataFrame | None = None,
                 commits: DataFrame | None = None, added_paths: DataFrame | None = None,
                 registry: DataFrame | None = None) -> DataFrame:
    """All checks this engine computes, over all of `files` (repo, rel, text).

    `paths` is the raw listing (repo, rel), ignored files included: lockfiles and some
    folders are never scanned but count. History and registry checks take part when
    their tables are given. Facts are read once per kind: what one file or one
    repository settles comes from two projections, and each check over several files
    is one aggregation or one join with it.
    """
    facts = corpus_facts(files, paths) if facts is None else facts
    state = repo_state(facts, paths, commits)
    users = state.where("supabase").select("repo")
    secrets = facts.where("kind = 'secret'").join(
        state.selectExpr("repo", f"{config_checks.ignore_rules('ignore_text')} as rules"), "repo", "left")
    parts = [
        single_file_findings(facts),
        per_file_collapse(as_findings(facts.where("kind = 'rule' and a = 'O3'"))),
        single_repo_findings(state, commits is not None),
        config_checks.env_undocumented(facts),
        config_checks.uncovered(secrets),
        schema_checks.rls_missing(facts, users),
        schema_checks.gated(facts, "D2", "D4", users=users),
        schema_checks.unindexed_filter(facts),
        structure.name_families(facts),
        structure.orphan_modules(facts),
        structure.most_repeated(facts.where("kind = 'block'").selectExpr(
            "repo", "rel", "line", "a as digest"), files),
    ]
    parts += [operator(facts, paths).select(FINDINGS.names) for operator in OWN_OPERATORS]
    if added_paths is not None:
        parts.append(history_checks.secret_in_history(added_paths))
    if registry is not None:
        parts.append(dependency_findings(facts, registry, state))
    return _union(parts)


def repo_state(facts: DataFrame, paths: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """One row per repository with all that whole-repository checks look at, written once."""
    state = project_checks.repo_state(facts).join(
        dependency_checks.root_manifests(paths), "repo", "left")
    if commits is not None:
        state = state.join(history_checks.history_of(commits), "repo", "left")
    return write_once(state)


def single_file_findings(facts: DataFrame) -> DataFrame:
    """Findings that one file settles by itself, but for console calls, which collapse."""
    found = facts.where("kind = 'local' or (kind = 'rule' and a <> 'O3')")
    sure = (F.col("kind") == "local") & F.col("a").isin(*CONFIRMED_LOCAL)
    return as_findings(found.withColumn("sure", sure), "SUSPECTED", "sure")


def single_repo_findings(state: DataFrame, history: bool) -> DataFrame:
    """Findings that one row of `repo_state` settles."""
    script = f"if(npm, {project_checks.test_script('package_text')}, null)"
    made = project_checks.absences() + [
        project_checks.weak_tests("script"),
        project_checks.lacking("manifest is not null and not locked", "P3", "manifest",
                               "concat(manifest, ' is not accompanied by a lockfile')")]
    if history:
        made.append(project_checks.lacking(
            history_checks.NO_DEPTH, "H1", "'.'", history_checks.DEPTH_TEXT))
    return project_checks.repo_findings(state.withColumn("script", F.expr(script)), *made)


def declared_dependencies(facts: DataFrame) -> DataFrame:
    """(repo, ecosystem, name, manifest) for the registry checks."""
    return dependency_checks.dependency_extract(facts).join(
        dependency_checks.manifest_of(facts), "repo")


def dependency_findings(facts: DataFrame, registry: DataFrame,
                        state: DataFrame | None = None) -> DataFrame:
    """P1 and P2 against a registry snapshot (ecosystem, name)."""
    if state is None:
        declared = declared_dependencies(facts)
    else:
        manifests = state.selectExpr("repo", f"{dependency_checks.MANIFEST} as manifest")
        declared = dependency_checks.dependency_extract(facts).join(manifests, "repo")
    declared = write_once(declared)
    return dependency_checks.registry_missing(declared, registry).unionByName(
        dependency_checks.typosquat(declared, registry))


def coverage_notes(facts: DataFrame, paths: DataFrame,
                   commits: DataFrame | None = None) -> DataFrame:
    """Why checks did not apply: (repo, note)."""
    state = project_checks.repo_state(facts).select("repo", "web", "supabase", "tables").join(
        dependency_checks.root_manifests(paths), "repo", "left").join(
        paths.where("rel = '.gitignore'").selectExpr("repo", "true as ignored").distinct(), "repo", "left")
    said = state.selectExpr("repo", """explode(filter(array(
        if(not web, 'serves no web pages: X2, O4 and O5 (headers, errors, health) do not apply', null),
        if(tables and not supabase, 'no hosted database in use: D1, D2 and D4 (row security) do not apply', null),
        if(not tables, 'no tables are created: nothing to check for row security and indexes', null),
        if(ignored is null, 'there is no ignore file', null),
        if(manifest is null, 'no manifest: dependencies are checked in part only', null)
        ), n -> n is not null)) as note""")
    notes = [said, config_checks.missing_example_notes(facts), dependency_checks.broken_lock_notes(facts)]
    if commits is not None:
        repos = facts.where("kind = 'file'").select("repo")
        notes.append(history_checks.history_notes(repos, commits))
    return _union(notes)


def _union(parts: list[DataFrame]) -> DataFrame:
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united
