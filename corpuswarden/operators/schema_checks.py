"""Database checks: row level security, policies, buckets, rules files, indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuswarden.functions import text as tx
from corpuswarden.plans.facts import FileColumns, fact, when
from corpuswarden.plans.rulebook import LEAD
from corpuswarden.plans.scan import as_findings, findings_row

# Statement patterns.
CREATE_TABLE = (r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?(?:\"?(\w+)\"?\.)?"
                r"\"?(\w+)\"?\s*\(")
ENABLE_RLS = (r"(?is)alter\s+table\s+(?:\"?\w+\"?\.)?\"?(\w+)\"?\s+enable\s+row\s+level"
              r"\s+security")
POLICY = r"(?is)create\s+policy\s++(?>.*?on\s+(?:\"?\w+\"?\.)?\"?(\w+)\"?)(.*?);"
POLICY_SKIP = r"(?is)create\s+policy\s.*+"
GRANTS_ALL = r"(?is)using\s*\(\s*true\s*\)|with\s+check\s*\(\s*true\s*\)"
WRITE_VERB = r"(?is)\bfor\s+(all|insert|update|delete)\b"
PUBLIC_BUCKET = r"(?is)storage\.buckets[^;]*?\btrue\b"
PUBLIC_BUCKET_SKIP = r"(?i)storage\.buckets[^;]*+"
CREATE_INDEX = (r"(?is)create\s+(?:unique\s+)?index[^;]*?on\s+(?:\"?\w+\"?\.)?\"?(\w+)\"?"
                r"\s*\(([^)]*)\)")
CREATE_INDEX_SKIP = r"(?i)create\s+(?:unique\s+)?index[^;]*+"
OPEN_RULE = r"(?i)allow\s+[\w,\s]*+:\s*+if\s++true\s*+;"
OPEN_RULE_SKIP = r"(?i)allow\s[\w,\s]*+"
FROM_CALL = r"\.from\(\s*[\"'](\w+)[\"']\s*\)"
CHAINED_CALL = r"\s*\.\w+\([^)]*\)"
COLUMN_CALL = r"\.(?:eq|neq|gt|gte|lt|lte|like|ilike|order)\(\s*[\"'](\w+)[\"']"
MANAGED_SCHEMAS = ("auth", "storage", "extensions")


def sql_probe(c: FileColumns) -> str:
    """Tables, enabled row security, open write policies, public buckets, indexes."""
    tables, t = tx.matches(c.text, CREATE_TABLE, {"schema": 1, "name": 2}, name="t")
    own = (f"not startswith({t['name']}, '_') and lower({t['schema']}) not in "
           f"({', '.join(tx.quote(s) for s in MANAGED_SCHEMAS)})")
    table_facts = (f"transform(filter({tables}, t -> {own}), "
                   f"t -> {fact('table', 'lower(' + t['name'] + ')', line=t['line'])})")

    secured = (f"transform(array_distinct(regexp_extract_all({c.text}, {tx.regex(ENABLE_RLS)}, 1)),"
               f" t -> {fact('rls', 'lower(t)')})")

    policies, p = tx.matches(c.text, POLICY, {"match": 0, "body": 2}, name="p", skip=POLICY_SKIP)
    is_open = tx.all_of(tx.matches_regex(p["body"], GRANTS_ALL),
                        tx.matches_regex(p["body"], WRITE_VERB))
    first_line = tx.snippet(f"substring_index({tx.strip(p['match'])}, {tx.quote(chr(10))}, 1)")
    policy_facts = (f"transform(filter({policies}, p -> {is_open}), "
                    f"p -> {fact('gated', tx.quote('D2'), line=p['line'], snippet=first_line)})")

    buckets, b = tx.matches(c.text, PUBLIC_BUCKET, {"match": 0}, name="b", skip=PUBLIC_BUCKET_SKIP)
    bucket = fact("gated", tx.quote("D4"), line=b["line"], snippet=tx.snippet(b["match"], 120))

    indexes, i = tx.matches(tx.until_last(c.text, ")"), CREATE_INDEX, {"table": 1, "columns": 2},
                            name="i", skip=CREATE_INDEX_SKIP)
    column = f"btrim({tx.strip('col')}, '\"')"
    index_facts = (f"flatten(transform({indexes}, i -> transform(split({i['columns']}, ','), "
                   f"col -> {fact('index', 'lower(' + i['table'] + ')', column)})))")

    found = [
        when(f"contains({c.low}, 'table')", f"concat({table_facts}, {secured})"),
        when(f"contains({c.low}, 'policy')", policy_facts),
        when(f"contains({c.low}, 'storage.buckets')", f"transform({buckets}, b -> {bucket})"),
        when(f"contains({c.low}, 'index')", index_facts),
    ]
    return when(f"{c.suffix(('.sql',))} and not {c.test}", f"concat({', '.join(found)})")


def open_rules_probe(c: FileColumns) -> str:
    """Rules files that allow everything."""
    found, o = tx.matches(c.text, OPEN_RULE, {"match": 0}, name="o", lead=LEAD, skip=OPEN_RULE_SKIP)
    finding = fact("local", tx.quote("D9"), line=o["line"], snippet=tx.snippet(o["match"]))
    return when(
        f"{c.suffix(('.rules',))} and not {c.test} and {c.holds(('allow',), fold=True)}",
        f"transform({found}, o -> {finding})")


def chain_probe(c: FileColumns) -> str:
    """Columns filtered or ordered in each `.from('table')` call chain.

    A chain is matched call by call: a link must start where the last match ended.
    One pattern for a whole chain would recurse once per link.
    """
    text = f"concat('x', {c.text})"
    pattern = rf"\G{CHAINED_CALL}|{FROM_CALL}"
    calls, k = tx.matches(text, pattern, {"match": 0, "table": 1}, name="k")
    cut = tx.quote(tx.MARK)
    chains = (f"split(array_join(transform(v.calls, k -> if({k['table']} <> '', "
              f"concat({cut}, {k['match']}), {k['match']})), ''), {cut})")
    starts = f"filter(v.calls, k -> {k['table']} <> '')"
    heads = f"arrays_zip({starts}, slice({chains}, 2, greatest(size({chains}) - 1, 0)))"
    columns = f"array_distinct(regexp_extract_all(h.`1`, {tx.regex(COLUMN_CALL)}, 1))"
    head = {name: "h.`0`" + value[1:] for name, value in k.items()}
    per_chain = fact("chain", f"lower({head['table']})", "col", head["line"])
    found = f"flatten(transform({heads}, h -> transform({columns}, col -> {per_chain})))"
    return when(f"contains({c.text}, '.from(')",
                tx.let("v", f"named_struct('calls', {calls})", found))


def uses_supabase(facts: DataFrame) -> DataFrame:
    """Repositories that use the hosted database: one row each."""
    return facts.where("kind = 'flag' and a = 'supabase'").select("repo").distinct()


def rls_missing(facts: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """D1: tables for which no statement of the repository enables row security.

    Both sides meet in one aggregation on (repo, table), so nothing is joined until
    the answer is small. The last file that creates a table is its site.
    """
    tables = (
        facts.where("kind in ('table', 'rls')")
        .groupBy("repo", "a")
        .agg(F.expr("max(struct(rel, line)) filter (where kind = 'table')").alias("site"),
             F.expr("bool_or(kind = 'rls')").alias("secured"))
        .where("site is not null and not secured")
    )
    users = uses_supabase(facts) if users is None else users
    return tables.join(users, "repo", "left_semi").select(*findings_row(
        "'D1'", "site.rel", "site.line",
        "concat('table ', a, ' is created, row security is never switched on')", "CONFIRMED"))


def gated(facts: DataFrame, *checks: str, users: DataFrame | None = None) -> DataFrame:
    """Findings of the named checks in the repositories they apply to."""
    found = facts.where((F.col("kind") == "gated") & F.col("a").isin(*checks))
    users = uses_supabase(facts) if users is None else users
    return as_findings(found.join(users, "repo", "left_semi"), "CONFIRMED")


def permissive_policy(facts: DataFrame) -> DataFrame:
    return gated(facts, "D2")


def public_bucket(facts: DataFrame) -> DataFrame:
    return gated(facts, "D4")


def unindexed_filter(facts: DataFrame) -> DataFrame:
    """C2: filtered or ordered columns of created tables that no index covers.

    Tables and indexes meet in one aggregation; a table's indexed columns stay with it.
    """
    tables = facts.where("kind in ('table', 'index')").groupBy("repo", "a").agg(
        F.bool_or(F.col("kind") == "table").alias("created"),
        F.collect_set(F.expr("if(kind = 'index', b, null)")).alias("indexed")).where("created")
    return (
        facts.where("kind = 'chain' and b <> 'id'").join(tables, ["repo", "a"])
        .where("not array_contains(indexed, b)")
        .select(*findings_row("'C2'", "rel", "line",
                              "concat('no index on ', a, '.', b, ', which queries filter or sort by')",
                              "SUSPECTED"))
    )
