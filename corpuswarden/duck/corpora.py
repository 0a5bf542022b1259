"""The derived views once more, in DuckDB's SQL, for the side-by-side check."""

from corpuswarden.sources import templates as tpl


def lit(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _fill(text: str, values: dict[str, str]) -> str:
    for name, value in values.items():
        text = f"replace({text}, {lit('{' + name + '}')}, {value})"
    return text


def _pick(options, position: str) -> str:
    return f"[{', '.join(lit(o) for o in options)}][({position}) + 1]"


REPO = "CASE WHEN g % 3 = 0 THEN 'r0' ELSE 'r' || g END"
BLOCK, GROUP = tpl.LINES_PER_FILE, tpl.LINES_PER_FILE * tpl.FILES_PER_GROUP

_LINE = _fill(
    _pick(tpl.LINES, f"(event_id * {tpl.STRIDE} + (event_id // {BLOCK}) * 13) % {len(tpl.LINES)}"),
    {
        "id": "event_id::VARCHAR", "h": "md5(event_id::VARCHAR)",
        "U16": "upper(substr(md5(event_id::VARCHAR), 1, 16))",
        "m3": "(event_id % 3)::VARCHAR", "m5": "(event_id % 5)::VARCHAR",
        "m7": "(event_id % 7)::VARCHAR",
        "c": f"((event_id // {GROUP}) * {tpl.FILES_PER_GROUP} + 1)::VARCHAR",
    },
)
_REL = _fill(_pick(tpl.PATHS, f"b % {tpl.FILES_PER_GROUP}"),
             {"b": "b::VARCHAR", "s": f"(g * {tpl.FILES_PER_GROUP} + 1)::VARCHAR"})
_ROOT = " UNION ALL ".join(
    f"SELECT repo, {_fill(lit(rel), {'g': 'g::VARCHAR'})} AS rel, "
    f"{_fill(_pick(texts, f'g % {len(texts)}'), {'g': 'g::VARCHAR'})} AS text FROM root_groups"
    for rel, texts in tpl.ROOT_FILES
)

CODE = f"""
code_lines AS (SELECT event_id, event_id // {BLOCK} AS b, event_id // {GROUP} AS g,
                      {_LINE} AS line FROM events),
code_texts AS (SELECT b, g, string_agg(line, chr(10) ORDER BY event_id) AS text
               FROM code_lines GROUP BY b, g),
root_groups AS (SELECT {REPO} AS repo, min(g) AS g
                FROM (SELECT DISTINCT event_id // {GROUP} AS g FROM events) GROUP BY 1),
root_files AS (SELECT * FROM ({_ROOT}) WHERE text IS NOT NULL),
code_files AS (SELECT {REPO} AS repo, {_REL} AS rel, text FROM code_texts
               UNION ALL SELECT * FROM root_files)"""

DOCS = """
doc_files AS (SELECT 'docs_' || source AS repo, 'notes/doc_' || doc_id || '.conf' AS rel, text
              FROM documents)"""

# The documents some time later.
LATER_DOCS = """
doc_files AS (SELECT 'docs_' || source AS repo,
  CASE WHEN doc_id % 77 = 1 THEN 'moved/doc_' ELSE 'notes/doc_' END || doc_id || '.conf' AS rel,
  CASE WHEN doc_id % 50 = 0 THEN text || chr(10) || 'auth_token = "' || md5(doc_id::VARCHAR) || '"' || chr(10)
       ELSE text END AS text FROM documents)"""

PAGES = """
page_files AS (SELECT 'pages' AS repo, 'pages/' || page_id || '.html' AS rel, html AS text
               FROM pages)"""

ALL = f"""{CODE}, {DOCS}, {PAGES},
all_files AS (SELECT * FROM code_files UNION ALL SELECT * FROM doc_files
              UNION ALL SELECT * FROM page_files)"""

# All files and the line items as files.
LARGE = ALL + """,
line_files AS (SELECT DISTINCT unnest(['status_' || l_linestatus, 'flag_' || l_returnflag]) AS repo,
  'src/' || l_orderkey || '/' || l_partkey || '.' || l_linenumber || '.ts' AS rel,
  'export const n = ' || l_linenumber AS text FROM lineitem),
large_files AS (SELECT * FROM all_files UNION ALL SELECT * FROM line_files)"""

# All files under the name by which the checks read them.
EVERY = ALL.replace("code_files", "code_part") + """,
code_files AS (SELECT * FROM all_files)"""
