"""Manifests, lockfiles, registry lookups and near-miss names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuswarden.functions import shapes, text as tx
from corpuswarden.plans.facts import FileColumns, fact, when
from corpuswarden.plans.scan import as_findings, findings_row
from corpuswarden.session import sized_join, write_once

# Manifests, lockfiles, sections, local references, popular names.
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "Pipfile")
LOCKFILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "poetry.lock",
             "requirements.lock", "uv.lock", "Pipfile.lock")
SECTIONS = ("dependencies", "devDependencies", "optionalDependencies")
LOCAL_REFERENCE = r"^(file:|link:|workspace:|git\+)"
REQUIREMENT = r"^([A-Za-z0-9][A-Za-z0-9._-]*)"
PYPROJECT_KEY = r"(?m)^[^\S\n]*+[\"']?([A-Za-z0-9][A-Za-z0-9._-]{1,})[\"']?\s*[=><~\"']"
PYPROJECT_FIELDS = ("name", "version", "description", "requires-python", "readme")
POPULAR = (
    "react", "next", "express", "lodash", "axios", "requests", "numpy", "pandas", "typescript",
    "vite", "zod", "prisma", "supabase", "fastapi", "django", "flask", "dotenv", "chalk",
    "moment", "uuid", "jsonwebtoken", "bcrypt", "stripe",
)

# Where a name was declared; the highest wins. pyproject never overrides.
FROM_PYPROJECT, FROM_NPM, FROM_REQUIREMENTS = 1, 2, 3


def dependency_probe(c: FileColumns) -> str:
    """Declared names; `b` is the rank of the manifest they come from."""
    sections = "from_json(_text, 'struct<" + ",".join(
        f"{s}:map<string,string>" for s in SECTIONS) + ">')"
    names = ", ".join(
        f"map_keys(map_filter(coalesce(d.{s}, map()), (k, v) -> "
        f"not coalesce(v, 'None') rlike {tx.quote(LOCAL_REFERENCE)}))" for s in SECTIONS)
    npm = tx.let("d", sections, f"transform(flatten(array({names})), "
                                f"n -> {fact('dependency', 'n', str(FROM_NPM))})")

    line = tx.strip("l")
    declared = (f"filter(transform({tx.lines(c.text)}, l -> "
                f"regexp_extract({line}, {tx.quote(REQUIREMENT)}, 1)), n -> n <> '')")
    requirements = f"transform({declared}, n -> {fact('dependency', 'n', str(FROM_REQUIREMENTS))})"

    fields = ", ".join(tx.quote(f) for f in PYPROJECT_FIELDS)
    keys = (f"filter(regexp_extract_all({c.text}, {tx.regex(PYPROJECT_KEY)}, 1), "
            f"n -> n not in ({fields}))")
    pyproject = f"transform({keys}, n -> {fact('dependency', 'n', str(FROM_PYPROJECT))})"
    return (f"concat({when(c.rel + chr(32) + '= ' + tx.quote('package.json'), npm)}, "
            f"{when(c.rel + ' = ' + tx.quote('requirements.txt'), requirements)}, "
            f"{when(c.rel + ' = ' + tx.quote('pyproject.toml'), pyproject)})")


def dependency_extract(facts: DataFrame) -> DataFrame:
    """One row per (repo, name) with the ecosystem of the manifest that wins."""
    return (
        facts.where("kind = 'dependency'").groupBy("repo", F.col("a").alias("name"))
        .agg(F.max("b").alias("rank"))
        .selectExpr("repo", f"if(rank = '{FROM_NPM}', 'npm', 'pypi') as ecosystem", "name")
    )


def install_script_probe(c: FileColumns) -> str:
    """P5: locked packages that run an install script."""
    packages = ("coalesce(from_json(_text, 'struct<packages:map<string,string>>').packages, "
                "cast(map() as map<string,string>))")
    runs = ("coalesce(get_json_object(v, '$.hasInstallScript'), '') "
            "not in ('', 'false', '0', 'null')")
    found = (f"transform(map_keys(map_filter({packages}, (k, v) -> {runs})), k -> "
             + fact("local", tx.quote("P5"), line="1",
                    snippet=tx.snippet("concat(if(k = '', 'root', k), ' executes code when installed')"))
             + ")")
    return when(f"{c.rel} = 'package-lock.json' and contains(_text, 'hasInstallScript')", found)


def broken_lock_probe(c: FileColumns) -> str:
    """A root package lock that cannot be read, so that P5 has nothing to look at."""
    return when(f"{c.rel} = 'package-lock.json' and get_json_object(_text, '$') is null",
                f"array({fact('broken_lock')})")


def broken_lock_notes(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'broken_lock'").selectExpr(
        "repo", "'package-lock.json cannot be parsed: P5 (install scripts) does not apply' as note").distinct()


def install_script(facts: DataFrame) -> DataFrame:
    return as_findings(facts.where("kind = 'local' and a = 'P5'"), "CONFIRMED")


def no_lockfile(tree: DataFrame) -> DataFrame:
    """P3: a manifest at the top of the repository and none of the lockfiles.

    `tree` is every path (repo, rel), ignored ones included: a lockfile is not scanned
    but it counts.
    """
    return root_manifests(tree).where("manifest is not null and not locked").select(
        *findings_row("'P3'", "manifest", "1",
                      "concat(manifest, ' is not accompanied by a lockfile')", "CONFIRMED"))


def root_manifests(tree: DataFrame) -> DataFrame:
    """(repo, locked, manifest) of repositories with a manifest or a lockfile at the top."""
    listed = ", ".join(tx.quote(n) for n in MANIFESTS + LOCKFILES)
    locks = ", ".join(tx.quote(n) for n in LOCKFILES)
    order = f"array({', '.join(tx.quote(m) for m in MANIFESTS)})"
    return (
        tree.where(f"rel in ({listed})").groupBy("repo")
        .agg(F.expr(f"bool_or(rel in ({locks}))").alias("locked"),
             F.expr(f"min(nullif(array_position({order}, rel), 0))").alias("first"))
        .selectExpr("repo", "locked", f"get({order}, cast(first as int) - 1) as manifest")
    )


# The manifest dependency findings are reported against; `npm`: whether the first one exists.
MANIFEST = "if(npm, 'package.json', 'requirements.txt')"


def manifest_of(facts: DataFrame) -> DataFrame:
    """The manifest dependency findings are reported against."""
    return (
        facts.where("kind = 'file'").groupBy("repo")
        .agg(F.expr("bool_or(rel = 'package.json')").alias("npm"))
        .selectExpr("repo", f"{MANIFEST} as manifest")
    )


def registry_missing(deps: DataFrame, registry: DataFrame) -> DataFrame:
    """P1: declared names the registry snapshot does not hold.

    Names repeat across repositories, so a popular one is a hot key. The distinct
    declared names meet the registry first; only unknown names go back to the rows.
    """
    unknown = (
        deps.select("ecosystem", "name").distinct()
        .join(registry.select("ecosystem", "name").distinct(), ["ecosystem", "name"], "left_anti")
    )
    return sized_join(deps, unknown, ["ecosystem", "name"], "left_semi").select(*findings_row(
        "'P1'", "manifest", "1",
        "concat('the ', ecosystem, ' registry has no package ', name)", "CONFIRMED"))


def typosquat(deps: DataFrame, registry: DataFrame) -> DataFrame:
    """P2: registered names one edit from a popular one.

    Distances are computed once per distinct registered name; the names are written
    first, as Catalyst would move the test back below the distinct and run it per row.
    The near misses are few and go back to the rows by a size-checked join, as one of
    them may be a hot key.
    """
    likely = shapes.may_be_one_edit_from("name", POPULAR)
    declared = write_once(deps.select("ecosystem", "name").distinct())
    names = declared.where(likely).join(
        registry.select("ecosystem", "name").distinct(), ["ecosystem", "name"], "left_semi")
    near = names.withColumn("popular", F.expr(shapes.one_edit_from("name", POPULAR))).where(
        "popular is not null")
    return sized_join(deps, near, ["ecosystem", "name"]).select(*findings_row(
        "'P2'", "manifest", "1", "concat(name, ' differs by one edit from ', popular)",
        "SUSPECTED"))
