"""Files, matching, findings and study operators in DuckDB's SQL."""

from __future__ import annotations

from corpuswarden.catalog import ADVICE, CHECKS
from corpuswarden.sources import corpora as src
from corpuswarden.duck.corpora import ALL, DOCS, EVERY, LARGE, LATER_DOCS, _fill, _pick, lit
from corpuswarden.duck.detectors import LINES, REPO_OF_ORDER, SCHEMA, flags, names, whole_audit
from corpuswarden.duck.rules import (
    CREDENTIAL, CODECFG, DOCS as DOC_SUFFIXES, EXAMPLE, JS, PY, ROLE, RULES, SERVER, TP, VARIABLE,
    ends, holds, is_test, line_of, located, re_hit, rule_findings, sensitive, strip,
)

CATALOG = ("catalog AS (SELECT * FROM (VALUES "
           + ", ".join(f"('{c[0]}', '{c[1]}', '{c[2]}')" for c in CHECKS)
           + ") t(check_id, severity, fix_class))")

# ---- views ------------------------------------------------------------------------------

RAW = f"""
raw AS (SELECT source AS repo,
  {_fill(_pick(src.RAW_PATHS, f'doc_id % {len(src.RAW_PATHS)}'), {'n': 'doc_id::VARCHAR'})} AS rel,
  strlen(text) + CASE WHEN doc_id % 13 = 0 OR doc_id % 7 = 0 THEN 1 ELSE 0 END AS length,
  doc_id % 13 = 0 OR contains(substr(text, 1, 4096), chr(0)) AS zero,
  CASE WHEN doc_id % 13 = 0 THEN chr(0) || text WHEN doc_id % 7 = 0 THEN text || chr(65533) ELSE text END AS text
  FROM documents),
classed AS (SELECT *, CASE WHEN length > 2000000 THEN length || ' bytes exceed the limit'
                           WHEN zero THEN 'binary' END AS reason FROM raw)"""
IGNORED = (
    "(list_has_any(string_split(rel, '/'), ['node_modules', '.git', '.next', '.nuxt', '.svelte-kit', "
    "'dist', 'build', 'out', 'coverage', 'venv', '.venv', 'env', '__pycache__', '.pytest_cache', "
    "'target', 'vendor', '.turbo', '.vercel', '.cache', 'Pods', '.terraform']) OR "
    + ends([".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".pdf", ".zip", ".gz", ".tar",
            ".mp4", ".mov", ".mp3", ".woff", ".woff2", ".ttf", ".eot", ".lock", ".pyc", ".so",
            ".dylib", ".dll", ".wasm", ".map", ".min.js", ".min.css"]) + ")")


def package(key: str) -> str:
    return (f"CASE WHEN {key} % 4 = 0 THEN [{', '.join(lit(p) for p in src.PACKAGES)}]"
            f"[({key} // 4 % {len(src.PACKAGES)}) + 1] ELSE 'lib-' || {key} END")


DEPS = f"""
deps AS (SELECT DISTINCT 'd' || l_suppkey AS repo, CASE WHEN l_partkey % 8 < 4 THEN 'npm' ELSE 'pypi' END AS ecosystem,
  {package('l_partkey')} AS name, 'package.json' AS file FROM lineitem),
registry AS (SELECT CASE WHEN p_partkey % 8 < 4 THEN 'npm' ELSE 'pypi' END AS ecosystem,
  {package('p_partkey')} AS name FROM part WHERE p_brand <> 'Brand#3')"""
POPULAR = names(["react", "next", "express", "lodash", "axios", "requests", "numpy", "pandas",
                 "typescript", "vite", "zod", "prisma", "supabase", "fastapi", "django", "flask",
                 "dotenv", "chalk", "moment", "uuid", "jsonwebtoken", "bcrypt", "stripe"])


def added_cte(repo: str) -> str:
    return f"""
added AS (SELECT {repo} AS repo,
  {_fill(_pick(src.ADDED, f'o_orderkey % {len(src.ADDED)}'), {'n': 'o_orderkey::VARCHAR'})} AS path FROM orders),
pats AS (SELECT unnest(['.env', '.env.local', '.env.production', 'credentials.json', 'serviceAccount.json',
                        'id_rsa', '*.pem']) AS pat)"""


def secret_added() -> str:
    harmless = re_hit("path", r"(?i)(cacert|ca-bundle|ca-certificates|fullchain|/certifi/|node_modules/|\.venv/"
                              r"|site-packages/|vendor/)")
    return f"""SELECT repo, 'S4' AS check_id, min(path) AS file, 1 AS line,
       min(path) || ' was once added to the history' AS snippet, 'CONFIRMED' AS confidence, '' AS evidence
FROM added, pats WHERE (path = pat OR starts_with(path, pat || '/') OR (pat = '*.pem' AND ends_with(path, '.pem')))
  AND NOT {harmless} GROUP BY repo, pat"""


def history_finding(repos: str, commits: str) -> str:
    return f"""SELECT repo, 'H1' AS check_id, '.' AS file, 1 AS line,
  CASE WHEN n IS NULL THEN 'not under version control' ELSE 'only ' || n || ' commit(s) in its history' END AS snippet,
  'CONFIRMED' AS confidence, '' AS evidence
FROM {repos} LEFT JOIN (SELECT repo, count(id) AS n, bool_or(shallow) AS shallow FROM ({commits}) GROUP BY repo) USING (repo)
WHERE n IS NULL OR (n = 1 AND NOT shallow)"""


HISTORY = """SELECT kind || n AS repo, CASE WHEN n % 23 = 0 THEN NULL ELSE id END AS id, n % 10 = 0 AS shallow
  FROM (SELECT 'h' AS kind, o_custkey AS n, o_orderkey AS id FROM orders
        UNION ALL SELECT 'k', l_orderkey, l_partkey FROM lineitem)"""
HISTORY_REPOS = """(SELECT 'h' || c_custkey AS repo FROM customer UNION SELECT 'k' || o_orderkey FROM orders)"""
EVENT_CHECK = _pick(src.EVENT_CHECKS, f"(event_id * 5 + user_id) % {len(src.EVENT_CHECKS)}")


def found(name: str, where: str = "true") -> str:
    return f"""
{name} AS (SELECT 'u' || user_id AS repo, {EVENT_CHECK} AS check_id, 'src/f' || (event_id % 7) || '.ts' AS file,
  (floor(value)::BIGINT % 20 + 1)::INTEGER AS line, event_type AS snippet,
  CASE WHEN event_id % 3 = 0 THEN 'CONFIRMED' ELSE 'SUSPECTED' END AS confidence, '' AS evidence
  FROM events WHERE {where})"""


REPOS = """
repos AS (SELECT 'u' || user_id AS repo FROM events UNION SELECT 'c' || c_custkey FROM customer)"""
PREV, CUR = "ts < TIMESTAMP '2024-01-16'", "ts >= TIMESTAMP '2024-01-11'"
F = f"WITH {CATALOG}, {REPOS}, {found('f')}, rated AS (SELECT * FROM f JOIN catalog USING (check_id))"
TWO = f"WITH {CATALOG}, {found('prev', PREV)}, {found('cur', CUR)}"

SEVERITY_SUMS = ", ".join(
    f"count(CASE WHEN severity = '{s}' AND check_id NOT IN ('H1', 'S4') THEN 1 END) AS {s.lower()}"
    for s in ("P0", "P1", "P2", "P3"))
RUNS = f"""WITH {CATALOG},
per_user AS (SELECT user_id, list_sort(list(DISTINCT check_id) FILTER (WHERE check_id NOT IN ('H1', 'S4'))) AS checks,
  {SEVERITY_SUMS}, count(CASE WHEN check_id NOT IN ('H1', 'S4') THEN 1 END) AS total,
  max(event_id % 50 + 1) AS files, max(value) AS seconds
  FROM (SELECT *, {EVENT_CHECK} AS check_id FROM events) JOIN catalog USING (check_id) GROUP BY user_id),
runs AS (SELECT user_id % 11 <> 0 AS ok,
    CASE WHEN user_id % 11 <> 0 THEN NULL ELSE {_pick(src.REASONS, f'user_id // 11 % {len(src.REASONS)}')} END AS reason,
    'u' || user_id AS id, checks, p0, p1, p2, p3, total, files,
    list_filter(string_split({_pick(src.STACKS, f'user_id % {len(src.STACKS)}')}, ','), lambda t: t <> '') AS stack, seconds
  FROM per_user
  UNION ALL SELECT true, NULL, 's' || s_suppkey, []::VARCHAR[], 0, 0, 0, 0, 0, s_suppkey % 40, ['npm'], s_acctbal
  FROM supplier),
done AS (SELECT * FROM runs WHERE ok), n AS (SELECT count(*) AS n FROM done),
hits AS (SELECT check_id, count(*) AS repos FROM (SELECT unnest(checks) AS check_id FROM done) GROUP BY 1),
tags AS (SELECT tag, count(*) AS repos FROM (SELECT unnest(stack) AS tag FROM done) GROUP BY 1)"""
SAMPLE_DRAW = "md5('99:' || repo)"


def values(source: str = "all_files") -> str:
    pattern = lit(r'"([^"\s]{3,})"')
    return f"""WITH {ALL},
vals AS (SELECT repo, rel, generate_subscripts(regexp_extract_all(text, {pattern}, 1), 1)::INTEGER AS place,
         unnest(regexp_extract_all(text, {pattern}, 1)) AS v FROM {source})
SELECT repo, rel, place, v AS value, """


TAGGED = f"""
tagged AS (
        SELECT repo, 'npm' AS tag FROM code_files WHERE rel IN ('package.json', 'package-lock.json')
        UNION SELECT repo, tag FROM (SELECT repo, unnest(list_concat(
            coalesce(json_keys(text, '$.dependencies'), []), coalesce(json_keys(text, '$.devDependencies'), []))) AS name
          FROM code_files WHERE rel = 'package.json' AND json_valid(text))
          JOIN (VALUES ('next', 'nextjs'), ('react', 'react'), ('vite', 'vite'), ('express', 'express'),
            ('@supabase/supabase-js', 'supabase'), ('firebase', 'firebase'), ('firebase-admin', 'firebase'),
            ('prisma', 'prisma'), ('@prisma/client', 'prisma'), ('drizzle-orm', 'drizzle'),
            ('fastapi', 'fastapi'), ('django', 'django')) t(name, tag) USING (name)
        UNION SELECT repo, tag FROM code_files JOIN (VALUES ('pnpm-lock.yaml', 'pnpm'), ('yarn.lock', 'yarn'),
          ('bun.lockb', 'bun')) t(rel, tag) USING (rel)
        UNION SELECT repo, 'python' FROM code_files WHERE rel IN ('requirements.txt', 'pyproject.toml', 'Pipfile')
        UNION SELECT repo, tag FROM code_files, (VALUES ('fastapi'), ('django')) t(tag)
          WHERE rel IN ('requirements.txt', 'pyproject.toml', 'Pipfile') AND contains(lower(text), tag)
        UNION SELECT repo, 'supabase' FROM code_files WHERE starts_with(rel, 'supabase/')
        UNION SELECT repo, 'vercel' FROM code_files WHERE rel = 'vercel.json' OR starts_with(rel, '.vercel/')
        UNION SELECT repo, 'firebase' FROM code_files WHERE rel IN ('firestore.rules', 'firebase.json'))"""

SETTING = r"(?:process\.env|os\.getenv\()[.\"']*([A-Z][A-Z0-9_]{2,})"
QUERIES = {
    # files
    "ingest_files": f"WITH {RAW} SELECT repo, rel, text FROM classed",
    "read_archives": f"WITH {ALL} SELECT repo, rel, strlen(text) AS length, md5(text) AS digest FROM all_files",
    "skipped_files": f"WITH {RAW} SELECT repo, rel, reason FROM classed WHERE reason IS NOT NULL",
    "path_ignore": f"WITH {RAW} SELECT repo, rel, length::INTEGER AS length FROM raw WHERE NOT {IGNORED}",
    "path_is_test": f"WITH {ALL} SELECT repo, rel, {is_test()} AS is_test FROM all_files",
    "file_cap": f"""WITH {LARGE} SELECT repo, rel, text FROM (
        SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rel) AS k FROM large_files) WHERE k <= 20000""",
    "cap_notes": f"""WITH {LARGE} SELECT repo, 'only the first 20000 of ' || count(*) || ' files were scanned' AS note
        FROM large_files GROUP BY repo HAVING count(*) > 20000""",
    "stack_tags": f"""WITH {EVERY}, {TAGGED}
      SELECT repo, coalesce(string_agg(tag, '; ' ORDER BY tag), '') AS stack
      FROM (SELECT DISTINCT repo FROM code_files) LEFT JOIN tagged USING (repo) GROUP BY repo""",
    "coverage_summary": f"""WITH {EVERY.replace("code_files AS (SELECT * FROM all_files)", "")}{RAW.strip()},
      listed AS (SELECT repo, rel, text, CASE WHEN strlen(text) > 2000000 THEN strlen(text) || ' bytes exceed the limit'
                   WHEN contains(substr(text, 1, 4096), chr(0)) THEN 'binary' END AS reason FROM all_files
                 UNION ALL SELECT repo, rel, text, reason FROM classed),
      unignored AS (SELECT * FROM listed WHERE NOT {IGNORED}),
      code_files AS (SELECT repo, rel, text FROM listed),
      kept AS (SELECT repo, rel, text FROM unignored WHERE reason IS NULL),
      {TAGGED}, {flags('kept')},
      created AS (SELECT DISTINCT repo FROM kept WHERE ends_with(lower(rel), '.sql') AND NOT {is_test()}
        AND regexp_matches(text, '(?is)create\\s+table\\s+(?:if\\s+not\\s+exists\\s+)?(?:"?\\w+"?\\.)?"?\\w+"?\\s*\\(')),
      above AS (SELECT repo, bool_or(rel = '.gitignore') AS ignored,
                       bool_or(rel IN ('package.json', 'requirements.txt', 'pyproject.toml', 'Pipfile')) AS manifest
                FROM listed GROUP BY repo),
      past AS (SELECT {REPO_OF_ORDER} AS repo, count(*) AS n, bool_or(o_custkey % 90 < 3) AS shallow FROM orders GROUP BY 1),
      state AS (SELECT f.repo, f.web, f.supabase, f.example, a.ignored, a.manifest, p.n, p.shallow, c.repo IS NOT NULL AS tables,
                       b.repo IS NOT NULL AS broken
                FROM flags f LEFT JOIN above a USING (repo) LEFT JOIN past p USING (repo) LEFT JOIN created c USING (repo)
                LEFT JOIN (SELECT repo FROM kept WHERE rel = 'package-lock.json' AND NOT json_valid(text)) b USING (repo)),
      said AS (SELECT repo, unnest(list_filter([
          CASE WHEN NOT web THEN 'serves no web pages: X2, O4 and O5 (headers, errors, health) do not apply' END,
          CASE WHEN tables AND NOT supabase THEN 'no hosted database in use: D1, D2 and D4 (row security) do not apply' END,
          CASE WHEN NOT tables THEN 'no tables are created: nothing to check for row security and indexes' END,
          CASE WHEN NOT ignored THEN 'there is no ignore file' END,
          CASE WHEN NOT manifest THEN 'no manifest: dependencies are checked in part only' END,
          CASE WHEN NOT example THEN 'no example settings: each setting the code reads counts as undocumented' END,
          CASE WHEN broken THEN 'package-lock.json cannot be parsed: P5 (install scripts) does not apply' END,
          CASE WHEN n IS NULL THEN 'not under version control: S4 (history) does not apply' END,
          CASE WHEN shallow THEN 'shallow copy: the depth of the history (H1) is unknown' END,
          CASE WHEN n > 0 THEN 'history: only the paths of added files were looked at' END
        ], lambda x: x IS NOT NULL)) AS note FROM state)
      SELECT repo, coalesce(scanned, 0) AS scanned_files, coalesce(total, 0) AS skipped_total,
             coalesce(skipped, '') AS skipped, coalesce(notes, '') AS notes, coalesce(stack, '') AS stack
      FROM (SELECT repo, count(*) FILTER (WHERE reason IS NULL) AS scanned,
                   count(*) FILTER (WHERE reason IS NOT NULL) AS total FROM unignored GROUP BY repo)
      LEFT JOIN (SELECT repo, string_agg(rel || ' (' || reason || ')', '; ' ORDER BY rel) AS skipped FROM (
          SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rel) AS k FROM unignored WHERE reason IS NOT NULL)
          WHERE k <= 5 GROUP BY repo) USING (repo)
      LEFT JOIN (SELECT repo, string_agg(note, '; ' ORDER BY note) AS notes FROM (SELECT DISTINCT * FROM said) GROUP BY repo) USING (repo)
      LEFT JOIN (SELECT repo, string_agg(tag, '; ' ORDER BY tag) AS stack FROM tagged GROUP BY repo) USING (repo)""",
    "corpus_list": """SELECT name, marker, position FROM (
        SELECT trim(name) AS name, marker, position,
               row_number() OVER (PARTITION BY trim(name) ORDER BY marker, position) AS k
        FROM (SELECT o_orderpriority AS marker, o_orderkey AS position, o_orderstatus = 'P' AS fork,
                CASE WHEN o_custkey % 17 = 0 THEN NULL WHEN o_custkey % 19 = 0 THEN '  '
                     ELSE ' owner' || (o_custkey % 40) || '/app' || o_custkey || ' ' END AS name FROM orders)
        WHERE trim(name) <> '' AND NOT fork) WHERE k = 1""",

    # matching
    "rule_matches": f"""WITH {ALL}, {located('s', 'all_files', SETTING, 'true', 1)}
        SELECT repo, rel, idx::INTEGER AS place, {line_of('start_at')} AS line, m AS matched, v AS name,
               substr(text, stop::BIGINT + 1, 25) AS tail FROM s""",
    "line_number": f"""WITH {DOCS}, {located('s', 'doc_files', r'[.][[:space:]]', 'true')}
        SELECT repo, rel, line, count(*) AS n FROM (SELECT repo, rel, {line_of('start_at')} AS line FROM s)
        GROUP BY ALL""",
    "snippet": f"""WITH {DOCS}, code_files AS (SELECT * FROM doc_files), {LINES}
        SELECT repo, rel, line, substr({strip('l')}, 1, 240) AS snippet FROM code_lines_all
        WHERE regexp_matches(l, '(?i)password|token')""",
    "shannon_entropy": f"{values()} round(list_entropy(string_split(v, '')), 6) AS entropy FROM vals",
    "credential_shape": f"{values()} {CREDENTIAL} AS credential FROM vals",
    "known_example": f"{values()} {re_hit('v', EXAMPLE)} AS example FROM vals",
    "jwt_public": f"{values()} coalesce({ROLE} = 'anon', false) AS public FROM vals",
    "sensitive_log_arg": f"""WITH {EVERY}, {LINES} SELECT repo, rel, line AS place, {sensitive('l')} AS leaks
        FROM code_lines_all""",
    "service_role_client": f"""WITH {EVERY}, {LINES} SELECT repo, rel, line AS place,
        NOT {re_hit('l', r'(?i)<[a-z]+>|you need|add the|copy the|paste|set up|configure')}
        AND {re_hit('l', r'process\.env|import\.meta\.env|createClient|eyJ|=|:')}
        AND NOT (contains(l, 'process.env.') AND NOT contains(l, 'NEXT_PUBLIC')) AS reachable
        FROM code_lines_all""",
    "non_constant_interp": f"""WITH {EVERY}, {LINES} SELECT repo, rel, line AS place,
        {VARIABLE} AS variable FROM (SELECT repo, rel, line, l AS m FROM code_lines_all)""",
    "numeric_group_threshold": f"""WITH {EVERY} SELECT repo, rel, place::INTEGER AS place, digits,
        coalesce(TRY_CAST(digits AS HUGEINT) < 30000, false) AS aggressive
        FROM (SELECT repo, rel, generate_subscripts(regexp_extract_all(text, '\\d+'), 1) AS place,
                     unnest(regexp_extract_all(text, '\\d+')) AS digits FROM code_files)""",
    "guard_absent": f"""WITH {EVERY}, {located('s', 'code_files', r'fetch\(', 'true')}
        SELECT repo, rel, idx::INTEGER AS place,
               NOT {re_hit('substr(text, stop::BIGINT + 1, 200)', r'\.ok\b|\.status\b|statusText')} AS unguarded
        FROM s""",
    "rule_scope": f"""WITH {ALL} SELECT repo, rel, {ends(JS)} AS is_js, {ends(PY)} AS is_py,
        {ends(CODECFG[:-7])} AS is_code, {ends(CODECFG[-7:])} AS is_config, {ends(DOC_SUFFIXES)} AS is_doc,
        {holds(TP)} AS has_test_marker FROM all_files""",
    "server_path": f"WITH {ALL} SELECT repo, rel, {holds(SERVER)} AS on_server FROM all_files",
    "rule_scan": f"WITH {ALL}, {rule_findings([r[0] for r in RULES])} SELECT * FROM rule_findings",
    "severity_counts": f"""WITH {ALL}, {CATALOG}, {rule_findings([r[0] for r in RULES])}
        SELECT repo, {', '.join(f"count(CASE WHEN severity = '{s}' THEN 1 END) AS {s}" for s in ('P0', 'P1', 'P2', 'P3'))}
        FROM rule_findings JOIN catalog USING (check_id) GROUP BY repo""",

    # dependencies and history
    "registry_missing": f"""WITH {DEPS} SELECT repo, 'P1' AS check_id, file, 1 AS line,
        'the ' || ecosystem || ' registry has no package ' || name AS snippet,
        'CONFIRMED' AS confidence, '' AS evidence FROM deps
        WHERE (ecosystem || '|' || name) NOT IN (SELECT ecosystem || '|' || name FROM registry)""",
    "typosquat": f"""WITH {DEPS} SELECT repo, 'P2' AS check_id, file, 1 AS line,
        name || ' differs by one edit from ' || popular AS snippet, 'SUSPECTED' AS confidence, '' AS evidence
        FROM (SELECT repo, ecosystem, name, file, min(popular) AS popular
              FROM deps, (SELECT unnest([{POPULAR[1:-1]}]) AS popular)
              WHERE damerau_levenshtein(name, popular) = 1 GROUP BY ALL)
        WHERE (ecosystem || '|' || name) IN (SELECT ecosystem || '|' || name FROM registry)""",
    "history_depth": history_finding(HISTORY_REPOS, HISTORY),
    "history_notes": f"""SELECT repo, unnest(list_filter([
          CASE WHEN n IS NULL THEN 'not under version control: S4 (history) does not apply' END,
          CASE WHEN n = 0 THEN 'the history cannot be read: H1 and S4 do not apply' END,
          CASE WHEN n > 0 AND shallow THEN 'shallow copy: the depth of the history (H1) is unknown' END,
          CASE WHEN n > 0 THEN 'history: only the paths of added files were looked at' END
        ], lambda x: x IS NOT NULL)) AS note
        FROM {HISTORY_REPOS}
        LEFT JOIN (SELECT repo, count(id) AS n, bool_or(shallow) AS shallow FROM ({HISTORY}) GROUP BY repo) USING (repo)""",
    "secret_in_history": f"WITH {added_cte("'h' || o_custkey")} {secret_added()}",

    # findings
    "catalog_enrich": f"{F} SELECT *, left(check_id, 1) AS domain FROM rated",
    "findings_sink": f"{F} SELECT 1 AS schema_version, *, left(check_id, 1) AS domain FROM rated",
    "findings_load": f"{F} SELECT * REPLACE ('SUSPECTED' AS confidence) FROM f",
    "findings_append": f"{TWO} SELECT * FROM prev UNION ALL SELECT * FROM cur",
    "finding_dedup": f"""SELECT repo, check_id, file, line, snippet FROM (
        SELECT *, row_number() OVER (PARTITION BY repo, check_id, file, line ORDER BY rule, off, snippet) AS k FROM (
          SELECT 's' || l_suppkey AS repo, {_pick(src.EVENT_CHECKS, f'l_partkey % {len(src.EVENT_CHECKS)}')} AS check_id,
                 'f' || (l_partkey % 5) AS file, l_quantity::INTEGER AS line, l_linenumber AS rule,
                 l_orderkey AS off, l_returnflag || l_linestatus AS snippet FROM lineitem)) WHERE k = 1""",
    "severity_counts_filled": f"""{F} SELECT repo, {', '.join(f"count(CASE WHEN severity = '{s}' THEN 1 END) AS {s}" for s in ('P0', 'P1', 'P2', 'P3'))}
        FROM repos LEFT JOIN rated USING (repo) GROUP BY repo""",
    "fix_plan": f"""{F} SELECT repo, {', '.join(f"count(CASE WHEN fix_class = '{s}' THEN 1 END) AS {s}" for s in ('auto', 'assisted', 'manual'))}
        FROM repos LEFT JOIN rated USING (repo) GROUP BY repo""",
    "verdict": f"""{F} SELECT repo, CASE min(severity) WHEN 'P0' THEN 'DO NOT SHIP' WHEN 'P1' THEN 'SHIP WITH CAUTION'
          ELSE 'CLEAR' END AS verdict
        FROM repos LEFT JOIN (SELECT * FROM rated WHERE confidence = 'CONFIRMED') USING (repo) GROUP BY repo""",
    "gate": f"""{F} SELECT repo, count(check_id) AS blocking, count(check_id) > 0 AS blocked
        FROM repos LEFT JOIN (SELECT * FROM rated WHERE severity <= 'P1' AND check_id IN ('S1', 'R2', 'ZZ')) USING (repo)
        GROUP BY repo""",
    "gate_rows": f"""{F} SELECT repo, severity, check_id, file, line, place::INTEGER AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY repo ORDER BY severity, check_id, file, line, snippet) AS place
        FROM rated WHERE severity <= 'P1') WHERE place <= 20""",
    "per_file_collapse": f"""{F} SELECT repo, check_id, file, min(line) AS line,
        count(*) || ' console calls in one file' AS snippet, 'SUSPECTED' AS confidence, '' AS evidence
        FROM f WHERE check_id = 'O3' GROUP BY repo, check_id, file""",
    "finding_order": f"{F} SELECT * EXCLUDE (fix_class) FROM rated ORDER BY severity, check_id, file, line",
    "blocking_top": f"""{F} SELECT repo, place::INTEGER AS place, severity, check_id, file, line, snippet,
        greatest(n - 5, 0) AS more FROM (
          SELECT *, row_number() OVER (PARTITION BY repo ORDER BY severity, check_id, file, line, snippet) AS place,
                 count(*) OVER (PARTITION BY repo) AS n
          FROM rated WHERE confidence = 'CONFIRMED' AND severity IN ('P0', 'P1')) WHERE place <= 5""",
    "blocking_advice": f"""{F}, advice AS (SELECT * FROM (VALUES {", ".join(
            f"({lit(c)}, {lit(why)}, {lit(fix)})" for c, (why, fix) in ADVICE.items())}) t(check_id, why, fix))
        SELECT repo, place::INTEGER AS place, severity, check_id, file, line, snippet, greatest(n - 5, 0) AS more,
               fix_class, why, fix FROM (
          SELECT *, row_number() OVER (PARTITION BY repo ORDER BY severity, check_id, file, line, snippet) AS place,
                 count(*) OVER (PARTITION BY repo) AS n
          FROM rated WHERE confidence = 'CONFIRMED' AND severity IN ('P0', 'P1')) JOIN advice USING (check_id)
        WHERE place <= 5""",
    "audit_table": f"""{F}, lead AS (SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY repo ORDER BY severity, check_id, file, line, snippet) AS place
          FROM rated WHERE confidence = 'CONFIRMED' AND severity IN ('P0', 'P1')) WHERE place <= 5),
        domains AS (SELECT * FROM (VALUES ('S', 'Secrets and settings'), ('D', 'Data access'),
          ('A', 'Sign-in and sessions'), ('R', 'Failures and their handling'), ('C', 'Cost and speed'),
          ('P', 'Dependencies'), ('O', 'Logs and monitoring'), ('H', 'Leftover code'), ('X', 'Deployment'), ('T', 'Tests')) t(d, section))
        SELECT 1 AS part, 'Blocking' AS section, repo, check_id, file, line, snippet FROM lead
        UNION ALL SELECT 2, section, r.repo, r.check_id, r.file, r.line, r.snippet
          FROM rated r JOIN domains ON d = left(r.check_id, 1)
          ANTI JOIN lead l ON l.repo = r.repo AND l.check_id = r.check_id AND l.file = r.file AND l.line = r.line
          WHERE r.confidence = 'CONFIRMED'
        UNION ALL SELECT 3, 'Suspected', repo, check_id, file, line, snippet FROM rated WHERE confidence <> 'CONFIRMED'
        UNION ALL SELECT 4, 'Coverage', repo, NULL, NULL, NULL, unnest(list_filter(['1 files and 48 checks',
            'built with ' || left(repo, 1), CASE WHEN length(repo) % 2 = 0 THEN 'even' ELSE 'odd' END,
            n || ' files left out: ' || shown || CASE WHEN n > 5 THEN ', ...' ELSE '' END], lambda x: x IS NOT NULL))
          FROM repos LEFT JOIN (SELECT repo, count(*) AS n,
                 array_to_string(list_sort(list(rel || ' (binary)'))[1:5], ', ') AS shown
               FROM (SELECT DISTINCT repo, file || ':' || line || ':' || check_id AS rel FROM f) GROUP BY repo) USING (repo)""",
    "run_diff": f"""{TWO}, o AS (SELECT * FROM (SELECT *, row_number() OVER (
            PARTITION BY repo, check_id, file, line ORDER BY snippet DESC, confidence DESC) AS k FROM prev) WHERE k = 1),
        n AS (SELECT * FROM (SELECT *, row_number() OVER (
            PARTITION BY repo, check_id, file, line ORDER BY snippet DESC, confidence DESC) AS k FROM cur) WHERE k = 1)
        SELECT repo, check_id, file, line, CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'fixed'
          ELSE 'unchanged' END AS status, CASE WHEN n.k = 1 THEN n.snippet ELSE o.snippet END AS snippet,
          CASE WHEN n.k = 1 THEN n.confidence ELSE o.confidence END AS confidence,
          CASE WHEN n.k = 1 THEN n.evidence ELSE o.evidence END AS evidence
        FROM o FULL JOIN n USING (repo, check_id, file, line)""",
    "diff_counts": f"""{TWO}, o AS (SELECT DISTINCT repo, check_id, file, line, 1 AS p FROM prev),
        n AS (SELECT DISTINCT repo, check_id, file, line, 1 AS c FROM cur)
        SELECT repo, count(CASE WHEN p IS NULL THEN 1 END) AS new, count(CASE WHEN c IS NULL THEN 1 END) AS fixed,
               count(CASE WHEN p = 1 AND c = 1 THEN 1 END) AS unchanged
        FROM o FULL JOIN n USING (repo, check_id, file, line) GROUP BY repo""",
    "recall_precision": f"""{TWO}, w AS (SELECT DISTINCT repo, check_id, true AS w FROM prev),
        h AS (SELECT DISTINCT repo, check_id, true AS h FROM cur WHERE check_id NOT IN ('O3', 'T2', 'H8'))
        SELECT repo, count(w) AS expected, count(CASE WHEN w AND h THEN 1 END) AS hit, count(CASE WHEN w AND h IS NULL THEN 1 END) AS missed,
               count(CASE WHEN w IS NULL THEN 1 END) AS unexpected,
               CASE WHEN count(w) > 0 THEN count(CASE WHEN w AND h THEN 1 END)::DOUBLE / count(w) END AS recall,
               CASE WHEN count(h) > 0 THEN count(CASE WHEN w AND h THEN 1 END)::DOUBLE / count(h) END AS precision
        FROM w FULL JOIN h USING (repo, check_id) GROUP BY repo""",
    "site_recall": f"""{TWO} SELECT repo, check_id, bool_or(hit IS NOT NULL) AS on_site
        FROM (SELECT DISTINCT repo, check_id, file FROM prev)
        LEFT JOIN (SELECT DISTINCT repo, check_id, file, 1 AS hit FROM cur) USING (repo, check_id, file)
        GROUP BY repo, check_id""",

    # study
    "check_prevalence": f"{RUNS} SELECT check_id, repos, 100.0::DOUBLE * repos / n AS pct FROM hits, n",
    "critical_prevalence": f"""{RUNS} SELECT check_id, repos, 100.0::DOUBLE * repos / n AS pct
        FROM hits JOIN catalog USING (check_id), n WHERE severity = 'P0'""",
    "domain_prevalence": f"""{RUNS} SELECT domain, repos, 100.0::DOUBLE * repos / n AS pct FROM (
        SELECT domain, count(*) AS repos FROM (SELECT DISTINCT id, left(check_id, 1) AS domain
          FROM (SELECT id, unnest(checks) AS check_id FROM done)) GROUP BY 1), n""",
    "corpus_summary": f"""{RUNS} SELECT count(*) AS repos_attempted, count(CASE WHEN ok THEN 1 END) AS repos_scanned,
        count(CASE WHEN NOT ok THEN 1 END) AS repos_failed, (sum(files) FILTER (WHERE ok))::BIGINT AS files_scanned,
        avg(total) FILTER (WHERE ok) AS mean_findings,
        100.0::DOUBLE * count(CASE WHEN ok AND p0 > 0 THEN 1 END) / count(CASE WHEN ok THEN 1 END) AS pct_with_p0,
        {', '.join(f'(sum({s}) FILTER (WHERE ok))::BIGINT AS total_{s}' for s in ('p0', 'p1', 'p2', 'p3'))},
        median(total) FILTER (WHERE ok) AS median_findings, median(p0) FILTER (WHERE ok) AS median_p0,
        median(seconds) FILTER (WHERE ok) AS median_seconds FROM runs""",
    "stack_counts": f"{RUNS} SELECT * FROM tags",
    "segment_report": f"""{RUNS}, seg AS (SELECT unnest(stack) AS tag, p0, checks FROM done),
        sized AS (SELECT tag, count(*) AS repos, count(CASE WHEN p0 > 0 THEN 1 END) AS critical FROM seg
                  WHERE tag IN ('supabase', 'firebase', 'nextjs', 'express') GROUP BY tag HAVING count(*) >= 10),
        seg_hits AS (SELECT tag, check_id, count(*) AS n FROM (SELECT tag, unnest(checks) AS check_id FROM seg)
                     JOIN catalog USING (check_id) WHERE severity IN ('P0', 'P1') GROUP BY 1, 2)
        SELECT tag, repos, 100.0::DOUBLE * critical / repos AS pct_with_p0, place::INTEGER AS place, check_id,
               100.0::DOUBLE * n / repos AS pct
        FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, check_id) AS place
              FROM seg_hits JOIN sized USING (tag)) WHERE place <= 10""",
    "failure_reasons": f"{RUNS} SELECT reason, count(*) AS repos FROM runs WHERE NOT ok GROUP BY reason",
    "most_common_checks": f"""{RUNS}
        SELECT 'check' AS list, check_id AS name, repos FROM (SELECT * FROM hits ORDER BY repos DESC, check_id LIMIT 25)
        UNION ALL SELECT 'stack', tag, repos FROM (SELECT * FROM tags ORDER BY repos DESC, tag LIMIT 12)""",
    "sample_accounting": f"""{RUNS} SELECT 40 AS requested, count(*) AS attempted, count(CASE WHEN ok THEN 1 END) AS scanned,
        count(CASE WHEN NOT ok THEN 1 END) AS failed FROM (SELECT * FROM runs ORDER BY md5('99:' || id), id LIMIT 40)""",
    "pseudonymise": f"WITH {REPOS} SELECT left(sha256(repo), 12) AS repo FROM repos",
    "stratified_sample": f"""{F}, chosen AS (SELECT repo, {SAMPLE_DRAW} AS draw FROM repos ORDER BY draw, repo LIMIT 400)
        SELECT check_id, place::INTEGER AS place, repo, file, line, left(snippet, 160) AS snippet FROM (
          SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY draw, repo, file, line, snippet) AS place
          FROM rated JOIN chosen USING (repo) WHERE severity = 'P0') WHERE place <= 10""",
    "repo_runs": f"""{F} SELECT true AS ok, left(sha256(repo), 12) AS id,
        coalesce(string_agg(DISTINCT check_id, '; ' ORDER BY check_id) FILTER (WHERE counted), '') AS checks,
        {', '.join(f"count(CASE WHEN counted AND severity = '{s}' THEN 1 END) AS {s}" for s in ('P0', 'P1', 'P2', 'P3'))},
        count(CASE WHEN counted THEN 1 END) AS total, any_value(length(repo)) AS files, left(repo, 1) AS stack
        FROM (SELECT *, check_id NOT IN ('H1', 'S4') AS counted FROM repos LEFT JOIN rated USING (repo)) GROUP BY repo""",
    "exact_median": "SELECT median(l_extendedprice) AS median FROM lineitem",
    "stream_rule_scan": f"""WITH {EVERY}, {rule_findings([r[0] for r in RULES], 'code_files')}
        SELECT *, 'SUSPECTED' AS confidence, '' AS evidence FROM rule_findings""",
}
QUERIES["findings_all"] = whole_audit("true")
QUERIES["audit_from_bytes"] = whole_audit(f"NOT {IGNORED}")
QUERIES["stored_diff"] = QUERIES["run_diff"]
QUERIES["own_checks"] = f"""WITH {EVERY}, {LINES}, {SCHEMA}
    SELECT repo, 'Q1' AS check_id, rel AS file, line, substr({strip('l')}, 1, 240) AS snippet,
           'SUSPECTED' AS confidence, '' AS evidence
    FROM code_lines_all WHERE regexp_matches(l, 'createHash\\([[:space:]]*["'']md5["''][[:space:]]*\\)')
      AND {ends(JS)} AND NOT {is_test()} AND NOT {holds(TP)} AND NOT {ends(DOC_SUFFIXES)}
    UNION ALL SELECT repo, 'Q2', min(rel), arg_min(line, (rel, line)), n || ' files create table ' || name, 'CONFIRMED', ''
    FROM (SELECT *, (SELECT count(DISTINCT o.rel) FROM tables o WHERE o.repo = t.repo AND o.name = t.name) AS n FROM tables t)
    WHERE n > 1 GROUP BY repo, name, n"""
QUERIES["audit_of_changes"] = whole_audit("true").replace(DOCS, LATER_DOCS)
