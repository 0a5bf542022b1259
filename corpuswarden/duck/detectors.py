"""Checks over several lines or files, in DuckDB's SQL over the code corpus."""

from __future__ import annotations

from corpuswarden.duck.corpora import ALL, EVERY, lit
from corpuswarden.duck.rules import (
    JS, PY, RULES, ends, is_test, line_of, located, re_hit, rule_findings, strip,
)

# Suffixes of modules.
MODULES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py"]


def names(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def row(check: str, file: str, line: str, snippet: str, confidence: str) -> str:
    return (f"repo, '{check}' AS check_id, {file} AS file, ({line})::INTEGER AS line, "
            f"{snippet} AS snippet, '{confidence}' AS confidence, '' AS evidence")


BASE = "regexp_extract(rel, '[^/]*$')"
LINES = """
code_lines_all AS (
  SELECT repo, rel, text, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line,
         unnest(string_split(text, chr(10))) AS l FROM code_files)"""

# ---- flags ------------------------------------------------------------------------------

# Markers of platforms and web projects.
SUPABASE = (f"(rel = 'supabase' OR starts_with(rel, 'supabase/') OR (rel = 'package.json' AND "
            f"contains(lower(text), 'supabase')) OR ({ends(['.sql', '.ts', '.js', '.tsx', '.jsx'])}"
            f" AND " + re_hit("text", r"(?i)supabase|auth\.uid\(\)|auth\.role\(\)|storage\.buckets")
            + "))")
WEB = "(" + " OR ".join([
    re_hit(BASE, r"(?i)^(next|vite|nuxt|svelte|astro|remix|vue|angular|gatsby)\.config\.[jt]s$"
                 r"|^(vercel\.json|netlify\.toml|manage\.py|wsgi\.py|asgi\.py|Procfile"
                 r"|firebase\.json|serverless\.yml)$"),
    re_hit("rel", r"(?i)(^|/)(pages|app|routes|api|views|controllers|public|static)/"
                  r"|\.(tsx|jsx|vue|svelte|astro)$|(^|/)(server|main|index|wsgi|asgi)\.[jt]s$"),
    "(rel IN " + names(["package.json", "requirements.txt", "pyproject.toml", "Gemfile",
                        "composer.json"]) + " AND "
    + re_hit("text", r"\b(next|react|vue|svelte|astro|express|fastify|koa|hapi|nestjs|remix|nuxt"
                     r"|fastapi|django|flask|starlette|rails|laravel)\b") + ")",
]) + ")"


def marker(pattern: str) -> str:
    return f"({re_hit('text', pattern)} OR {re_hit('rel', pattern)})"


def flags(source: str) -> str:
    return f"""
flags AS (SELECT repo, bool_or({SUPABASE}) AS supabase, bool_or({WEB}) AS web,
  bool_or(ends_with(rel, '.tsx') OR ends_with(rel, '.jsx')) AS react,
  bool_or({marker(r'componentDidCatch|getDerivedStateFromError|ErrorBoundary|error\.tsx|error\.jsx|errorElement')}) AS boundary,
  bool_or({ends(['.js', '.ts', '.mjs', '.json', '.toml', '.yml', '.yaml', '.conf'])} AND
          {marker('(?i)content-security-policy|strict-transport-security|x-frame-options')}) AS headers,
  bool_or({marker('@sentry|bugsnag|rollbar|datadog|honeybadger|posthog')}) AS tracker,
  bool_or({marker(r'(?i)/(health|healthz|readyz|ping|status)\b')}) AS health,
  bool_or(rel = 'next.config.js') AS next_config,
  bool_or({re_hit('rel', r'(?i)(^|/)(tests?|__tests__)/|\.(test|spec)\.[jt]sx?$')}) AS node_tests,
  bool_or(starts_with(rel, 'tests/') OR contains(rel, 'test_')) AS any_tests,
  bool_or(starts_with(rel, '.github/workflows/') OR rel IN ('.gitlab-ci.yml', '.circleci/config.yml')) AS ci,
  bool_or(rel = '.gitignore') AS ignored, bool_or(rel IN ('.env.example', '.env.sample', '.env.template')) AS example,
  bool_or(rel IN ('package.json', 'requirements.txt', 'pyproject.toml', 'Pipfile')) AS manifest
  FROM {source} GROUP BY repo)"""


# What each missing property is reported as, in words of our own.
ABSENCE = {
    "no_error_boundary": ("R1", "react AND NOT boundary", "'src'",
                          "rendering errors are caught nowhere"),
    "no_headers": ("X2", "web AND NOT headers",
                   "CASE WHEN next_config THEN 'next.config.js' ELSE '.' END",
                   "security headers are set nowhere"),
    "no_tracker": ("O4", "web AND NOT tracker", "'.'", "no service collects errors"),
    "no_health": ("O5", "web AND NOT health", "'.'", "no endpoint reports health"),
    "no_ci": ("T3", "NOT ci", "'.'", "no workflow runs on changes"),
}


def absence(name: str) -> str:
    check, condition, file, said = ABSENCE[name]
    return f"SELECT {row(check, file, '1', lit(said), 'CONFIRMED')} FROM flags WHERE {condition}"


NO_TESTS = f"""SELECT {row('T1', "CASE WHEN script IS NULL THEN '.' ELSE 'package.json' END", '1',
    "CASE WHEN script IS NULL THEN 'there are no tests' ELSE 'tests are run by ''' || script || ''', test files: ' || CASE WHEN node_tests THEN 'some' ELSE 'none' END END",
    'CONFIRMED')}
  FROM flags LEFT JOIN (SELECT repo, trim(coalesce(TRY(json_extract_string(text, '$.scripts.test')), '')) AS script
                        FROM code_files WHERE rel = 'package.json') USING (repo)
  WHERE CASE WHEN script IS NULL THEN NOT any_tests
        ELSE NOT node_tests OR script = '' OR regexp_matches(script, 'no test specified|exit 1') END"""

# ---- schema -----------------------------------------------------------------------------

IS_SQL = f"ends_with(lower(rel), '.sql') AND NOT {is_test()}"
# Statement patterns, managed schemas, column calls.
SCHEMA = ",".join([
    located("created", "code_files",
            r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?(?:\"?(\w+)\"?\.)?\"?(\w+)\"?\s*\(",
            IS_SQL, 2),
    located("secured", "code_files",
            r"(?is)alter\s+table\s+(?:\"?\w+\"?\.)?\"?(\w+)\"?\s+enable\s+row\s+level\s+security",
            IS_SQL, 1),
    located("policies", "code_files",
            r"(?is)create\s+policy\s+.*?on\s+(?:\"?\w+\"?\.)?\"?(\w+)\"?(.*?);", IS_SQL, 2),
    located("buckets", "code_files", r"(?is)storage\.buckets[^;]*?\btrue\b", IS_SQL),
    located("indexes", "code_files",
            r"(?is)create\s+(?:unique\s+)?index[^;]*?on\s+(?:\"?\w+\"?\.)?\"?(\w+)\"?\s*\(([^)]*)\)",
            IS_SQL, 2),
    located("chains", "code_files",
            r"\.from\(\s*[\"'](\w+)[\"']\s*\)((?:\s*\.\w+\([^)]*\))*)", "true", 2),
    f"""
tables AS (SELECT repo, lower(v2) AS name, rel, {line_of('start_at')} AS line FROM created
           WHERE NOT starts_with(v2, '_') AND lower(coalesce(v, '')) NOT IN ('auth', 'storage', 'extensions')),
index_columns AS (SELECT repo, lower(v) AS name,
                  trim({strip("unnest(string_split(v2, ','))")}, '"') AS col FROM indexes)""",
])
COLUMN = r"\.(?:eq|neq|gt|gte|lt|lte|like|ilike|order)\(\s*[\"'](\w+)[\"']"
RLS = f"""SELECT {row('D1', 'rel', 'line', "'table ' || name || ' is created, row security is never switched on'", 'CONFIRMED')}
  FROM (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY rel DESC, line DESC) AS k FROM tables)
  WHERE k = 1 AND (repo || '|' || name) NOT IN (SELECT repo || '|' || lower(v) FROM secured)
    AND repo IN (SELECT repo FROM flags WHERE supabase)"""
POLICY = f"""SELECT {row('D2', 'rel', line_of('start_at'), f"substr({strip('string_split(' + strip('m') + ', chr(10))[1]')}, 1, 240)", 'CONFIRMED')}
  FROM policies WHERE {re_hit('v2', r'(?is)using\s*\(\s*true\s*\)|with\s+check\s*\(\s*true\s*\)')}
    AND {re_hit('v2', r'(?is)\bfor\s+(all|insert|update|delete)\b')}
    AND repo IN (SELECT repo FROM flags WHERE supabase)"""
BUCKET = f"""SELECT {row('D4', 'rel', line_of('start_at'), f"substr({strip('m')}, 1, 120)", 'CONFIRMED')}
  FROM buckets WHERE repo IN (SELECT repo FROM flags WHERE supabase)"""
UNINDEXED = f"""SELECT {row('C2', 'rel', 'line', "'no index on ' || name || '.' || col || ', which queries filter or sort by'", 'SUSPECTED')}
  FROM (SELECT repo, rel, lower(v) AS name, {line_of('start_at')} AS line,
               unnest(list_distinct(regexp_extract_all(v2, {lit(COLUMN)}, 1))) AS col FROM chains)
  WHERE col <> 'id' AND (repo || '|' || name) IN (SELECT repo || '|' || name FROM tables)
    AND (repo || '|' || name || '|' || col) NOT IN (SELECT repo || '|' || name || '|' || col FROM index_columns)"""

OPEN_RULES_CTE = located("opened", "code_files", r"(?im)^\s*allow\s+[\w,\s]*:\s*if\s+true\s*;",
                         f"ends_with(lower(rel), '.rules') AND NOT {is_test()}")
LEAD = r"start_at + length(regexp_extract(m, '^\s*'))"
OPEN_RULES = (f"SELECT {row('D9', 'rel', line_of(LEAD), strip('m'), 'CONFIRMED')} FROM opened")

# ---- configuration ----------------------------------------------------------------------

# Secret files, source-map and debug switches, platform settings.
SECRET = (f"NOT {is_test()} AND ({BASE} IN " + names(
    [".env", ".env.local", ".env.production", "credentials.json", "serviceAccount.json",
     "service-account.json"]) + " OR ends_with(rel, '.pem') OR ends_with(rel, '.key'))")
SECRET_UNIGNORED = f"""SELECT {row('S3', 'rel', '1', "rel || ' holds secrets and no ignore rule covers it'", 'CONFIRMED')}
  FROM (SELECT repo, rel, {BASE} AS name FROM code_files WHERE {SECRET}) f
  WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT repo, trim(l) AS pat FROM code_lines_all
                   WHERE rel = '.gitignore' AND trim(l) <> '' AND NOT starts_with(l, '#')) g
    WHERE g.repo = f.repo AND (pat = name OR (starts_with(pat, '*') AND ends_with(name, substr(pat, 2)))
                               OR rtrim(pat, '/') = rtrim(name, '/')))"""
SOURCEMAP_CTE = located(
    "maps", "code_files", r"productionBrowserSourceMaps\s*:\s*true|sourcemap\s*:\s*true"
    r"|GENERATE_SOURCEMAP\s*=\s*true",
    f"NOT {is_test()} AND {BASE} IN " + names(
        ["next.config.js", "next.config.mjs", "next.config.ts", "vite.config.js",
         "vite.config.ts", ".env", ".env.production"]))
SOURCEMAP = f"SELECT {row('S6', 'rel', line_of('start_at'), 'm', 'CONFIRMED')} FROM maps WHERE idx = 1"
DEBUG_CTE = located(
    "debugs", "code_files", r"(?im)^\s*(?:DEBUG|debug)\s*[:=]\s*(?:True|true)\s*,?\s*$",
    ends([".py", ".env", ".toml", ".yml", ".yaml", ".json"]) + " AND NOT contains(rel, 'example')")
DEBUG = f"SELECT {row('X1', 'rel', line_of(LEAD), strip('m'), 'SUSPECTED')} FROM debugs WHERE idx = 1"

PLATFORM = names(["NODE_ENV", "PORT", "HOST", "CI", "PATH", "HOME", "TZ", "PWD", "LANG", "VERCEL",
                  "VERCEL_ENV", "VERCEL_URL", "VERCEL_REGION", "NEXT_RUNTIME", "NETLIFY",
                  "RAILWAY_ENVIRONMENT", "RENDER", "FLY_APP_NAME", "AWS_REGION",
                  "GITHUB_ACTIONS", "PYTHONPATH", "DYNO"])
SETTING_CTE = ",".join([
    located("reads_js", "code_files", r"(?:process\.env|import\.meta\.env)\.([A-Z][A-Z0-9_]{2,})",
            f"{ends(JS)} AND NOT {is_test()}", 1),
    located("reads_py", "code_files",
            r"os\.(?:environ\.get|getenv)\(\s*[\"']([A-Z][A-Z0-9_]{2,})[\"']",
            f"{ends(PY)} AND NOT {is_test()}", 1),
    f"""
reads AS (SELECT repo, v AS name, rel AS file, {line_of('start_at')} AS line FROM reads_js
          UNION ALL SELECT repo, v, rel, {line_of('start_at')} FROM reads_py),
first_reads AS (SELECT repo, name, file, line FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY file, line) AS k FROM reads) WHERE k = 1),
documented AS (SELECT repo, regexp_extract(l, '^\\s*([A-Z][A-Z0-9_]*)\\s*=', 1) AS name FROM code_lines_all
               WHERE rel IN ('.env.example', '.env.sample', '.env.template'))""",
])
SETTINGS = f"""SELECT {row('S5', 'file', 'line', "name || ' is used by the code, but no example file names it'", 'CONFIRMED')}
  FROM first_reads WHERE name NOT IN {PLATFORM} AND NOT starts_with(name, 'VERCEL_')
    AND NOT starts_with(name, 'NEXT_RUNTIME')
    AND (repo || '|' || name) NOT IN (SELECT repo || '|' || name FROM documented)"""

# ---- dependencies -----------------------------------------------------------------------

# Manifests, lockfiles, sections, fields that are no packages.
MANIFESTS = ["package.json", "requirements.txt", "pyproject.toml", "Pipfile"]
LOCKS = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "poetry.lock",
         "requirements.lock", "uv.lock", "Pipfile.lock"]
NO_LOCKFILE = f"""SELECT {row('P3', 'first', '1', "first || ' is not accompanied by a lockfile'", 'CONFIRMED')}
  FROM (SELECT repo, arg_min(rel, list_position([{', '.join(lit(m) for m in MANIFESTS)}], rel))
                     FILTER (WHERE rel IN {names(MANIFESTS)}) AS first,
               bool_or(rel IN {names(LOCKS)}) AS locked FROM code_files GROUP BY repo)
  WHERE first IS NOT NULL AND NOT locked"""
_PACKAGES = ("(SELECT repo, rel, unnest(map_entries(json_extract(text, '$.packages')::MAP(VARCHAR, JSON))) AS e "
             "FROM code_files WHERE rel = 'package-lock.json' AND json_valid(text))")
INSTALL = f"""SELECT {row('P5', 'rel', '1', "CASE WHEN e.key = '' THEN 'root' ELSE e.key END || ' executes code when installed'", 'CONFIRMED')}
  FROM {_PACKAGES} WHERE json_extract_string(e.value, '$.hasInstallScript') = 'true'"""
_NPM = " UNION ALL ".join(
    f"SELECT repo, name, 2 AS rank FROM (SELECT repo, text, unnest(json_keys(text, '$.{s}')) AS name "
    f"FROM code_files WHERE rel = 'package.json' AND json_valid(text)) WHERE NOT regexp_matches("
    f"json_extract_string(text, '$.{s}.\"' || name || '\"'), '^(file:|link:|workspace:|git\\+)')"
    for s in ("dependencies", "devDependencies", "optionalDependencies"))
_PYPROJECT = r"(?m)^\s*[\"']?([A-Za-z0-9][A-Za-z0-9._-]{1,})[\"']?\s*[=><~\"']"
DEPENDENCIES = f"""
declared AS (
  {_NPM}
  UNION ALL SELECT repo, name, 3 FROM (SELECT repo, regexp_extract(trim(l), '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1) AS name
    FROM code_lines_all WHERE rel = 'requirements.txt') WHERE name <> ''
  UNION ALL SELECT repo, name, 1 FROM (SELECT repo, unnest(regexp_extract_all(text, {lit(_PYPROJECT)}, 1)) AS name
    FROM code_files WHERE rel = 'pyproject.toml')
    WHERE name NOT IN ('name', 'version', 'description', 'requires-python', 'readme'))"""

# ---- structure --------------------------------------------------------------------------

IS_MODULE = ends(MODULES)
STEM = rf"regexp_replace({BASE}, '\.[^.]+$', '')"
PARENT = "CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '.' END"
# Leftover suffixes, imports, entry points, comments that look like code, limits.
LEFTOVER = (r"(?i)[-_. ]?(?:fixed|new|old|final|copy|backup|bak|v\d+|\d+|updated|temp|tmp"
            r"|test2)$")
BARE = (f"list_reduce(list_prepend({STEM}, list_transform(range(length({STEM})), lambda n: '')), "
        f"lambda s, n: regexp_replace(s, {lit(LEFTOVER)}, ''))")
FAMILIES = f"""SELECT {row('H2', 'leftover', '1', "'looks like a copy of ' || original || ' (common name ' || regexp_extract(family, '[^/]*$') || ')'", 'CONFIRMED')}
  FROM (SELECT repo, family, count(*) AS n, last(rel ORDER BY size, rel) AS leftover,
               first(rel ORDER BY size, rel) AS original
        FROM (SELECT repo, rel, length({STEM}) AS size,
                     regexp_replace({PARENT} || '/' || lower({BARE}), '^[./]+', '') AS family
              FROM code_files WHERE {IS_MODULE} AND NOT {is_test()}) GROUP BY repo, family)
  WHERE n >= 2"""
IMPORT = (r"(?:from\s+[\"']([^\"']+)[\"']|require\(\s*[\"']([^\"']+)[\"']\s*\)"
          r"|import\s+[\"']([^\"']+)[\"'])")
PY_IMPORT = r"(?m)^\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))"
ENTRY = (r"(?i)(^|/)(page|layout|route|error|loading|not-found|middleware|index|main|app|conftest"
         r"|setup|manage|wsgi|asgi|__init__)\.(?:[jt]sx?|py)$"
         r"|(^|/)(pages|routes|migrations|supabase|scripts|tests?)/"
         r"|(^|/)[\w.-]+\.config\.[jt]sx?$|(^|/)(sentry|instrumentation)[\w.]*\.[jt]s$")
_CLIMBED = r"regexp_replace(regexp_replace(folder || s, '(^|/)\./', '\1', 'g'), '[^/]+/\.\./', '')"
IMPORTS_CTE = f"""
specs AS (SELECT repo, rel, CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '/') ELSE '' END AS folder,
    unnest(list_concat({', '.join(f'regexp_extract_all(text, {lit(p)}, {g})' for p, gs in ((IMPORT, (1, 2, 3)), (PY_IMPORT, (1, 2))) for g in gs)})) AS s
  FROM code_files WHERE {IS_MODULE}),
targets AS (SELECT DISTINCT repo, CASE WHEN starts_with(s, '.') THEN {_CLIMBED}
    WHEN regexp_matches(s, '^[@~#$][\\w.-]*/') THEN regexp_replace(s, '^[@~#$][\\w.-]*/', '')
    ELSE replace(s, '.', '/') END AS target FROM specs WHERE s <> '')"""
ORPHANS = f"""SELECT {row('H3', 'rel', '1', "'no import reaches this module'", 'CONFIRMED')}
  FROM code_files f WHERE {IS_MODULE} AND NOT {is_test()} AND NOT {re_hit('rel', ENTRY)}
    AND NOT {re_hit('text', r'(?m)^\s*if\s+__name__\s*==\s*["' + chr(39) + r']__main__["' + chr(39) + ']')}
    AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.repo = f.repo AND target <> ''
                    AND ends_with(regexp_replace(f.rel, '\\.[^.]*$', ''), target))"""
CODE_LIKE = r"[;{}()=]|^\s*(?:const|let|var|def|return|if|for|while|class|import|export)\b"
COMMENT_RUNS = f"""SELECT {row('H6', 'rel', 'first', "n || ' lines of commented-out code in a row'", 'SUSPECTED')}
  FROM (SELECT repo, rel, min(line) AS first, count(*) AS n FROM (
          SELECT repo, rel, line, line - row_number() OVER (PARTITION BY repo, rel ORDER BY line) AS island
          FROM code_lines_all WHERE NOT {is_test()} AND {re_hit('l', r'^\s*(?://|#)\s*(.*)$')}
            AND {re_hit("regexp_extract(l, '^\\s*(?://|#)\\s*(.*)$', 1)", CODE_LIKE)})
        GROUP BY repo, rel, island) WHERE n >= 5"""


def oversized(limit: int) -> str:
    n = "(len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END)"
    return (f"SELECT {row('H7', 'rel', '1', f'{n} || ' + lit(' lines'), 'SUSPECTED')} "
            f"FROM code_files WHERE {IS_MODULE} AND NOT {is_test()} AND {n} > {limit}")


def windows(source: str, scope: str) -> str:
    clean = strip("regexp_replace(l, '\\s+', ' ', 'g')")
    return f"""
wl AS (SELECT repo, rel, generate_subscripts(string_split(body, chr(10)), 1)::INTEGER AS line,
              unnest(string_split(body, chr(10))) AS l
       FROM (SELECT repo, rel, regexp_replace(text, '\\n$', '') AS body FROM {source} WHERE {scope})),
wc AS (SELECT repo, rel, line, {clean} AS a, lead({clean}, 1) OVER w AS b, lead({clean}, 2) OVER w AS c
       FROM wl WINDOW w AS (PARTITION BY repo, rel ORDER BY line)),
blocks AS (SELECT repo, rel, line, a || chr(10) || b || chr(10) || c AS body FROM wc
           WHERE c IS NOT NULL AND length(a) + length(b) + length(c) >= 60)"""


CLONES_CTE = """
dups AS (SELECT repo, body, count(*) AS n,
         array_agg(rel || ':' || line ORDER BY rel, line) AS sites, first(rel ORDER BY rel, line) AS rel1,
         first(line ORDER BY rel, line) AS line1 FROM blocks GROUP BY repo, body HAVING count(*) >= 3),
ranked_dups AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, body) AS k,
                count(*) OVER (PARTITION BY repo) AS groups FROM dups)"""
_CLONE_TEXT = ("substr('the same block at ' || n || ' places (' || array_to_string(sites[1:3], ', ') || ')' || "
               "CASE WHEN groups > 1 THEN ', besides ' || (groups - 1) || ' other blocks' ELSE '' END, 1, 240)")
CLONES = f"SELECT {row('H8', 'rel1', 'line1', _CLONE_TEXT, 'SUSPECTED')} FROM ranked_dups WHERE k = 1"
CODE_WINDOWS = windows("code_files", f"NOT {is_test()} AND {IS_MODULE}")

# ---- queries ----------------------------------------------------------------------------

HEAD = f"WITH {EVERY}, {LINES}"
QUERIES = {
    "rls_missing": f"{HEAD}, {flags('code_files')}, {SCHEMA} {RLS}",
    "permissive_policy": f"{HEAD}, {flags('code_files')}, {SCHEMA} {POLICY}",
    "public_bucket": f"{HEAD}, {flags('code_files')}, {SCHEMA} {BUCKET}",
    "unindexed_filter": f"{HEAD}, {SCHEMA} {UNINDEXED}",
    "uses_supabase": f"{HEAD}, {flags('code_files')} SELECT repo FROM flags WHERE supabase",
    "open_rules": f"{HEAD}, {OPEN_RULES_CTE} {OPEN_RULES}",
    "secret_file_unignored": f"{HEAD} {SECRET_UNIGNORED}",
    "sourcemaps_on": f"{HEAD}, {SOURCEMAP_CTE} {SOURCEMAP}",
    "debug_on": f"{HEAD}, {DEBUG_CTE} {DEBUG}",
    "env_first_site": f"{HEAD}, {SETTING_CTE} SELECT * FROM first_reads",
    "env_undocumented": f"{HEAD}, {SETTING_CTE} {SETTINGS}",
    "is_web_project": f"WITH {ALL}, {flags('all_files')} SELECT repo, web FROM flags",
    **{name: f"WITH {ALL}, {flags('all_files')} {absence(name)}" for name in ABSENCE},
    "no_tests": f"{HEAD}, {flags('code_files')} {NO_TESTS}",
    "no_lockfile": f"{HEAD} {NO_LOCKFILE}",
    "install_script": f"{HEAD} {INSTALL}",
    "dependency_extract": f"""{HEAD}, {DEPENDENCIES} SELECT repo, name,
        CASE WHEN max(rank) = 2 THEN 'npm' ELSE 'pypi' END AS ecosystem FROM declared GROUP BY repo, name""",
    "name_families": f"{HEAD} {FAMILIES}",
    "orphan_modules": f"{HEAD}, {IMPORTS_CTE} {ORPHANS}",
    "comment_runs": f"{HEAD} {COMMENT_RUNS}",
    "oversized_files": f"""WITH {ALL.replace("code_files", "code_part")},
        code_files AS (SELECT * FROM all_files UNION ALL SELECT source, 'src/m' || doc_id || '.py',
                       replace(text, ' ', chr(10)) FROM documents) {oversized(600)}""",
    "sliding_lines": f"{HEAD}, {CODE_WINDOWS} SELECT * FROM blocks",
    "clone_blocks": f"{HEAD}, {CODE_WINDOWS}, {CLONES_CTE} {CLONES}",
    "clone_blocks_documents": f"WITH {ALL}, {windows('doc_files', f'NOT {is_test()}')}, {CLONES_CTE} {CLONES}",
}

_O3 = ("SELECT repo, 'O3' AS check_id, file, min(line)::INTEGER AS line, "
       "count(*) || ' console calls in one file' AS snippet, 'SUSPECTED' AS confidence, "
       "'' AS evidence FROM rule_findings WHERE check_id = 'O3' GROUP BY repo, file")

# The whole audit; `listing` holds all paths, `code_files` the files that are scanned.
REPO_OF_ORDER = ("CASE WHEN o_custkey % 5 = 0 THEN 'docs_src' || (o_custkey % 20) "
                 "WHEN o_custkey % 7 = 0 THEN 'pages' ELSE 'r' || (o_custkey % 90) END")


def whole_audit(scanned: str) -> str:
    from corpuswarden.duck.tables import POPULAR, added_cte, history_finding, package, secret_added

    head = EVERY.replace("code_files AS (SELECT * FROM all_files)",
                         f"listing AS (SELECT repo, rel FROM all_files),\n"
                         f"code_files AS (SELECT * FROM all_files WHERE {scanned})")
    listed = NO_LOCKFILE.replace("FROM code_files", "FROM listing")
    return " ".join([
        f"WITH {head}, {LINES}, {flags('code_files')}, {SCHEMA}, {OPEN_RULES_CTE}, {SOURCEMAP_CTE}, {DEBUG_CTE},",
        f"{SETTING_CTE}, {IMPORTS_CTE}, {CODE_WINDOWS}, {CLONES_CTE}, {DEPENDENCIES},",
        f"""wanted AS (SELECT repo, name, CASE WHEN max(rank) = 2 THEN 'npm' ELSE 'pypi' END AS ecosystem
              FROM declared GROUP BY repo, name),
            top AS (SELECT repo, CASE WHEN bool_or(rel = 'package.json') THEN 'package.json' ELSE 'requirements.txt' END AS file
              FROM code_files GROUP BY repo),
            known AS (SELECT DISTINCT {package('p_partkey')} AS name FROM part WHERE p_brand <> 'Brand#3'),
            asked AS (SELECT wanted.*, file FROM wanted JOIN top USING (repo)),
            {added_cte(REPO_OF_ORDER)},""",
        rule_findings([r[0] for r in RULES], "code_files"),
        "SELECT *, 'SUSPECTED' AS confidence, '' AS evidence FROM rule_findings WHERE check_id <> 'O3'",
        *[f"UNION ALL {part}" for part in (
            _O3, SETTINGS, RLS, POLICY, BUCKET, UNINDEXED, OPEN_RULES, SECRET_UNIGNORED, SOURCEMAP,
            DEBUG, listed, INSTALL, FAMILIES, ORPHANS, COMMENT_RUNS, oversized(600), CLONES,
            NO_TESTS, *[absence(n) for n in ABSENCE], secret_added(),
            history_finding("(SELECT DISTINCT repo FROM code_files)",
                            f"SELECT {REPO_OF_ORDER} AS repo, o_orderkey AS id, o_custkey % 90 < 3 AS shallow FROM orders"),
            """SELECT repo, 'P1' AS check_id, file, 1 AS line, 'the ' || ecosystem || ' registry has no package ' || name
               AS snippet, 'CONFIRMED' AS confidence, '' AS evidence FROM asked WHERE name NOT IN (SELECT name FROM known)""",
            f"""SELECT repo, 'P2' AS check_id, file, 1 AS line, name || ' differs by one edit from ' || min(popular) AS snippet,
               'SUSPECTED' AS confidence, '' AS evidence
               FROM asked, (SELECT unnest([{POPULAR[1:-1]}]) AS popular)
               WHERE damerau_levenshtein(name, popular) = 1 AND name IN (SELECT name FROM known)
               GROUP BY repo, ecosystem, name, file""",
        )],
    ])
