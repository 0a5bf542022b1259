"""Whole-repository existence checks: one aggregation per repository over flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuswarden.functions import paths, text as tx
from corpuswarden.plans.facts import FileColumns, fact
from corpuswarden.plans.scan import findings_row

# Markers searched in texts and paths.
SUPABASE = r"(?i)supabase|auth\.uid\(\)|auth\.role\(\)|storage\.buckets"
SUPABASE_SUFFIXES = (".sql", ".ts", ".js", ".tsx", ".jsx")
BOUNDARY = ("componentDidCatch", "getDerivedStateFromError", "ErrorBoundary", "error.tsx",
            "error.jsx", "errorElement")
HEADERS = r"(?i)content-security-policy|strict-transport-security|x-frame-options"
HEADER_SUFFIXES = (".js", ".ts", ".mjs", ".json", ".toml", ".yml", ".yaml", ".conf")
TRACKER = ("@sentry", "bugsnag", "rollbar", "datadog", "honeybadger", "posthog")
HEALTH = r"(?i)/(health|healthz|readyz|ping|status)\b"
WEB_DEPENDENCY = (r"\b(next|react|vue|svelte|astro|express|fastify|koa|hapi|nestjs|remix|nuxt"
                  r"|fastapi|django|flask|starlette|rails|laravel)\b")
WEB_PATH = (r"(?i)(^|/)(pages|app|routes|api|views|controllers|public|static)/"
            r"|\.(tsx|jsx|vue|svelte|astro)$|(^|/)(server|main|index|wsgi|asgi)\.[jt]s$")
WEB_CONFIG = (r"(?i)^(next|vite|nuxt|svelte|astro|remix|vue|angular|gatsby)\.config\.[jt]s$"
              r"|^(vercel\.json|netlify\.toml|manage\.py|wsgi\.py|asgi\.py|Procfile"
              r"|firebase\.json|serverless\.yml)$")
WEB_MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "Gemfile", "composer.json")
NODE_TESTS = r"(?i)(^|/)(tests?|__tests__)/|\.(test|spec)\.[jt]sx?$"
CI_FILES = (".gitlab-ci.yml", ".circleci/config.yml")
PLACEHOLDER_TEST = r"no test specified|exit 1"


def flag_probe(c: FileColumns) -> str:
    """The repository-wide properties one file establishes."""
    def literal(needles) -> str:
        return tx.any_of(tx.contains_any(c.rel, needles), tx.contains_any(c.text, needles))

    def either(pattern: str, needles) -> str:
        in_text = tx.all_of(c.holds(needles, fold=True), tx.matches_regex(c.text, pattern))
        return tx.any_of(tx.matches_regex(c.rel, pattern), in_text)

    name = paths.basename(c.rel)
    manifests = ", ".join(tx.quote(m) for m in WEB_MANIFESTS)
    flags = {
        "supabase": tx.any_of(
            f"{c.rel} = 'supabase'", f"startswith({c.rel}, 'supabase/')",
            f"({c.rel} = 'package.json' and contains({c.low}, 'supabase'))",
            tx.all_of(c.suffix(SUPABASE_SUFFIXES),
                      c.holds(("supabase", "auth.", "storage."), fold=True),
                      tx.matches_regex(c.text, SUPABASE))),
        "web": tx.any_of(
            tx.matches_regex(name, WEB_CONFIG), tx.matches_regex(c.rel, WEB_PATH),
            f"({c.rel} in ({manifests}) and {tx.matches_regex(c.text, WEB_DEPENDENCY)})"),
        "react": tx.any_of(f"endswith({c.rel}, '.tsx')", f"endswith({c.rel}, '.jsx')"),
        "boundary": literal(BOUNDARY),
        "headers": tx.all_of(c.suffix(HEADER_SUFFIXES), either(HEADERS, ("-policy", "-security", "-options"))),
        "tracker": literal(TRACKER),
        "health": either(HEALTH, ("/health", "/readyz", "/ping", "/status")),
        "next_config": f"{c.rel} = 'next.config.js'",
        "node_tests": tx.matches_regex(c.rel, NODE_TESTS),
        "any_tests": tx.any_of(f"startswith({c.rel}, 'tests/')", f"contains({c.rel}, 'test_')"),
        "ci": _is_workflow(c.rel),
    }
    listed = ", ".join(f"if({test}, '{flag}', null)" for flag, test in flags.items())
    return f"transform(filter(array({listed}), f -> f is not null), f -> {fact('flag', 'f')})"


def file_probe(c: FileColumns) -> str:
    """One fact per file, so that every repository takes part in absence checks."""
    return f"array({fact('file')})"


FLAGS = ("supabase", "web", "react", "boundary", "headers", "tracker", "health",
         "next_config", "node_tests", "any_tests", "ci")


def _flag_columns() -> list:
    return [F.expr(f"coalesce(bool_or(kind = 'flag' and a = '{f}'), false)").alias(f) for f in FLAGS]


def repo_flags(facts: DataFrame) -> DataFrame:
    """One row per repository with every flag; partial aggregation keeps it small."""
    return facts.where("kind in ('file', 'flag')").groupBy("repo").agg(*_flag_columns())


def repo_state(facts: DataFrame) -> DataFrame:
    """One row per repository: its flags, the texts of its root files, what it holds."""
    def root(name: str) -> str:
        return f"max(if(kind = 'root' and a = '{name}', snippet, null))"

    return facts.where("kind in ('file', 'flag', 'root', 'table')").groupBy("repo").agg(
        *_flag_columns(), F.expr(root(".gitignore")).alias("ignore_text"),
        F.expr(root("package.json")).alias("package_text"),
        F.expr("bool_or(kind = 'file' and rel = 'package.json')").alias("npm"),
        F.expr("bool_or(kind = 'table')").alias("tables"))


def path_flag_probe(c: FileColumns) -> str:
    """The properties a path establishes whether or not its file is scanned."""
    flags = {
        "node_tests": tx.matches_regex(c.rel, NODE_TESTS),
        "any_tests": tx.any_of(f"startswith({c.rel}, 'tests/')", f"contains({c.rel}, 'test_')"),
        "ci": _is_workflow(c.rel),
    }
    listed = ", ".join(f"if({test}, '{flag}', null)" for flag, test in flags.items())
    return f"transform(filter(array({listed}), f -> f is not null), f -> {fact('flag', 'f')})"


def _is_workflow(rel: str) -> str:
    return tx.any_of(f"startswith({rel}, '.github/workflows/')",
                     *[f"{rel} = {tx.quote(f)}" for f in CI_FILES])


# What each missing property is reported as.
ABSENCE = {
    "R1": ("react and not boundary", "'src'",
           "rendering errors are caught nowhere"),
    "X2": ("web and not headers", "if(next_config, 'next.config.js', '.')",
           "security headers are set nowhere"),
    "O4": ("web and not tracker", "'.'", "no service collects errors"),
    "O5": ("web and not health", "'.'", "no endpoint reports health"),
    "T3": ("not ci", "'.'", "no workflow runs on changes"),
}


def lacking(condition: str, check: str, file: str, text: str) -> str:
    """A finding of a repository's row if the condition holds, else null."""
    return (f"if({condition}, named_struct('check', '{check}', 'file', {file}, "
            f"'text', {text}), null)")


def repo_findings(state: DataFrame, *made: str) -> DataFrame:
    """The findings that one row per repository gives, all in one projection."""
    listed = f"filter(array({', '.join(made)}), m -> m is not null)"
    return state.select("repo", F.explode(F.expr(listed)).alias("m")).select(
        *findings_row("m.check", "m.file", "1", "m.text", "CONFIRMED"))


def absences(*wanted: str) -> list[str]:
    return [lacking(condition, check, file, tx.quote(text))
            for check, (condition, file, text) in ABSENCE.items() if check in (wanted or ABSENCE)]


def absence_findings(flags: DataFrame, *wanted: str) -> DataFrame:
    """Properties a repository lacks, all from one row of flags."""
    return repo_findings(flags, *absences(*wanted))


def no_error_boundary(flags: DataFrame) -> DataFrame:
    return absence_findings(flags, "R1")


def no_headers(flags: DataFrame) -> DataFrame:
    return absence_findings(flags, "X2")


def no_tracker(flags: DataFrame) -> DataFrame:
    return absence_findings(flags, "O4")


def no_health(flags: DataFrame) -> DataFrame:
    return absence_findings(flags, "O5")


def no_ci(flags: DataFrame) -> DataFrame:
    return absence_findings(flags, "T3")


def _quoted(value: str) -> str:
    """Single quotes, or double quotes around a value that holds only single ones."""
    safe = f"replace({value}, {tx.quote(chr(92))}, {tx.quote(chr(92) * 2)})"
    single, double = tx.quote("'"), tx.quote('"')
    return (f"if(contains({value}, {single}) and not contains({value}, {double}), "
            f"concat({double}, {safe}, {double}), "
            f"concat({single}, replace({safe}, {single}, {tx.quote(chr(92) + chr(39))}), {single}))")


def weak_tests(script: str) -> str:
    """T1 of a repository's row; `script` is its test script, null without a manifest."""
    weak = f"not node_tests or {script} = '' or {script} rlike {tx.quote(PLACEHOLDER_TEST)}"
    text = (f"if({script} is null, 'there are no tests', concat('tests are run by ', "
            f"{_quoted(script)}, ', test files: ', if(node_tests, 'some', 'none')))")
    return lacking(f"if({script} is null, not any_tests, {weak})", "T1",
                   f"if({script} is null, '.', 'package.json')", text)


def test_script(manifest: str) -> str:
    """The test script a manifest's text names, empty if it names none."""
    return tx.strip(f"coalesce(get_json_object({manifest}, '$.scripts.test'), '')")


def no_tests(flags: DataFrame, facts: DataFrame) -> DataFrame:
    """T1: a manifest with no tests or only a placeholder script, or no tests at all."""
    manifests = facts.where("kind = 'root' and a = 'package.json'").selectExpr(
        "repo", f"{test_script('snippet')} as script")
    return repo_findings(flags.join(manifests, "repo", "left"), weak_tests("script"))
