"""Views that turn the given tables into the inputs the checks work on.

Every view is a projection or a group of bounded size, so it grows with its table.
One repository holds a third of all groups, as a hot key would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuswarden.catalog import severity_of
from corpuswarden.functions.text import quote
from corpuswarden.schema import SEVERITIES
from corpuswarden.session import spread
from corpuswarden.sources import templates as tpl


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fill(text: str, values: dict[str, str]) -> str:
    for name, value in values.items():
        text = f"replace({text}, {quote('{' + name + '}')}, {value})"
    return text


def _pick(options, position: str) -> str:
    listed = ", ".join("null" if o is None else quote(o) for o in options)
    return f"element_at(array({listed}), cast({position} as int) + 1)"


REPO = "if(g % 3 = 0, 'r0', concat('r', g))"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 32 events become files, groups of 16 files become repositories."""
    count = len(tpl.LINES)
    blocks = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"event_id div {tpl.LINES_PER_FILE} as b",
        f"event_id div {tpl.LINES_PER_FILE * tpl.FILES_PER_GROUP} as g",
    )
    numbered = spread(blocks, "b").withColumn("h", F.expr("md5(cast(event_id as string))"))
    line = _fill(
        _pick(tpl.LINES, f"pmod(event_id * {tpl.STRIDE} + b * 13, {count})"),
        {
            "id": "cast(event_id as string)", "h": "h", "U16": "upper(substring(h, 1, 16))",
            "m3": "cast(event_id % 3 as string)", "m5": "cast(event_id % 5 as string)",
            "m7": "cast(event_id % 7 as string)",
            "c": f"cast(g * {tpl.FILES_PER_GROUP} + 1 as string)",
        },
    )
    texts = (
        numbered.select("event_id", "b", "g", F.expr(line).alias("line"))
        .groupBy("b", "g")
        .agg(F.expr("listagg(line, '\\n') within group (order by event_id)").alias("text"))
    )
    rel = _fill(_pick(tpl.PATHS, f"b % {tpl.FILES_PER_GROUP}"),
                {"b": "cast(b as string)",
                 "s": f"cast(g * {tpl.FILES_PER_GROUP} + 1 as string)"})
    lined = texts.selectExpr(f"{REPO} as repo", f"{rel} as rel", "text")
    return lined.unionByName(root_files(spark, sf_dir))


def root_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests and settings of each repository, in variants chosen by its number."""
    groups = (
        table(spark, sf_dir, "events")
        .selectExpr(f"event_id div {tpl.LINES_PER_FILE * tpl.FILES_PER_GROUP} as g")
        .distinct()
        .selectExpr(f"{REPO} as repo", "g")
        .groupBy("repo").agg(F.min("g").alias("g"))
    )
    variants = ", ".join(
        f"named_struct('rel', {_fill(quote(rel), {'g': 'cast(g as string)'})}, "
        f"'text', {_fill(_pick(texts, f'g % {len(texts)}'), {'g': 'cast(g as string)'})})"
        for rel, texts in tpl.ROOT_FILES
    )
    return (
        groups.select("repo", F.explode(F.expr(f"array({variants})")).alias("f"))
        .select("repo", "f.rel", "f.text")
        .where("text is not null")
    )


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as configuration files, one repository per source."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.selectExpr("concat('docs_', source) as repo",
                           "concat('notes/doc_', doc_id, '.conf') as rel", "text")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages, all in one repository."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return pages.selectExpr("'pages' as repo", "concat('pages/', page_id, '.html') as rel",
                            "html as text")


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        code_files(spark, sf_dir)
        .unionByName(doc_files(spark, sf_dir))
        .unionByName(page_files(spark, sf_dir))
    )


def later_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files some time later: some documents got a line, some moved to another folder."""
    moved = "if(doc_id % 77 = 1, 'moved/doc_', 'notes/doc_')"
    text = "if(doc_id % 50 = 0, concat(text, '\\nauth_token = \"', md5(cast(doc_id as string)), '\"\\n'), text)"
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id").selectExpr(
        "concat('docs_', source) as repo", f"concat({moved}, doc_id, '.conf') as rel", f"{text} as text")
    return code_files(spark, sf_dir).unionByName(docs).unionByName(page_files(spark, sf_dir))


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as short files of two large repositories each, by status and by return flag."""
    unnamed = "l_orderkey is null or l_partkey is null or l_linenumber is null"  # then the path is null
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "explode(array(concat('status_', l_linestatus), concat('flag_', l_returnflag))) as repo",
        f"if({unnamed}, null, l_orderkey) as o", f"if({unnamed}, null, l_partkey) as p", "l_linenumber as n").distinct()
    return lines.selectExpr("repo", "concat('src/', o, '/', p, '.', n, '.ts') as rel",
                            "concat('export const n = ', n) as text")


def repo_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file as stored bytes: (repo, rel, content)."""
    return all_files(spark, sf_dir).selectExpr("repo", "rel", "cast(text as binary) as content")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as modules, a word a line, beside all files."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.selectExpr(
        "source as repo", "concat('src/m', doc_id, '.py') as rel",
        "replace(text, ' ', '\\n') as text").unionByName(all_files(spark, sf_dir))


# ---- tables that are not files ----------------------------------------------------------

RAW_PATHS = ["src/d{n}.md", "node_modules/x{n}.js", "a/dist/{n}.js", "img/{n}.PNG",
             "js/{n}.min.js", "lock{n}/yarn.lock", "lib/{n}.py", "docs/env/{n}.txt"]


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored bytes: some start with a zero byte, some end in a bad one."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    content = ("case when doc_id % 13 = 0 then concat(X'00', cast(text as binary)) "
               "when doc_id % 7 = 0 then concat(cast(text as binary), X'FF') "
               "else cast(text as binary) end")
    rel = _fill(_pick(RAW_PATHS, f"doc_id % {len(RAW_PATHS)}"), {"n": "cast(doc_id as string)"})
    return docs.selectExpr("source as repo", f"{rel} as rel", f"{content} as content").selectExpr(
        "repo", "rel", "octet_length(content) as length", "content")


# Names for derived dependencies: popular ones, one-edit variants and others.
PACKAGES = ["react", "recat", "lodash", "lodahs", "axios", "axois", "requests", "reqeusts",
            "numpy", "numppy", "zod", "zodd", "uuid", "uid", "express", "expres", "flask",
            "flasks", "moment", "momnet", "stripe", "strpie", "chalk", "halk", "next", "nest"]


def _package(key: str) -> str:
    listed = ", ".join(quote(p) for p in PACKAGES)
    return (f"if({key} % 4 = 0, element_at(array({listed}), cast({key} div 4 % {len(PACKAGES)} "
            f"as int) + 1), concat('lib-', {key}))")


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repository (supplier) and package (part)."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('d', l_suppkey) as repo", "if(l_partkey % 8 < 4, 'npm', 'pypi') as ecosystem",
        f"{_package('l_partkey')} as name", "'package.json' as manifest",
    ).distinct()


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts the registry knows: all but those of one brand."""
    return table(spark, sf_dir, "part").where("p_brand <> 'Brand#3'").selectExpr(
        "if(p_partkey % 8 < 4, 'npm', 'pypi') as ecosystem",
        f"{_package('p_partkey')} as name")


def history_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository per customer, whose orders are its commits, and per order, with line items."""
    return table(spark, sf_dir, "customer").selectExpr("concat('h', c_custkey) as repo").unionByName(
        table(spark, sf_dir, "orders").selectExpr("concat('k', o_orderkey) as repo"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth repository is a shallow copy, some cannot be read."""
    orders = table(spark, sf_dir, "orders").selectExpr("'h' as kind", "o_custkey as n", "o_orderkey as id")
    lines = table(spark, sf_dir, "lineitem").selectExpr("'k' as kind", "l_orderkey as n", "l_partkey as id")
    return orders.unionByName(lines).selectExpr(
        "concat(kind, n) as repo", "if(n % 23 = 0, null, cast(id as string)) as commit_id", "n % 10 = 0 as shallow")


# The repository of an order in the whole audit: the numbered ones, those of documents,
# and the pages; repositories without orders have no history.
AUDITED = ("case when o_custkey % 5 = 0 then concat('docs_src', o_custkey % 20) "
           "when o_custkey % 7 = 0 then 'pages' else concat('r', o_custkey % 90) end")


def audit_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        f"{AUDITED} as repo", "cast(o_orderkey as string) as commit_id", "o_custkey % 90 < 3 as shallow")


def audit_added_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fill(_pick(ADDED, f"o_orderkey % {len(ADDED)}"), {"n": "cast(o_orderkey as string)"})
    return table(spark, sf_dir, "orders").selectExpr(f"{AUDITED} as repo", f"{path} as path")


def audit_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with the packages the manifests name, in both ecosystems."""
    known = registry(spark, sf_dir)
    names = known.select("name").distinct()
    return names.select(F.explode(F.array(F.lit("npm"), F.lit("pypi"))).alias("ecosystem"), "name")


ADDED = ["src/a{n}.ts", ".env", "certs/a{n}.pem", "vendor/x{n}.pem", "config/.env",
         "etc/cacert{n}.pem", "credentials.json", ".env/part{n}", "id_rsa"]


def added_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fill(_pick(ADDED, f"o_orderkey % {len(ADDED)}"), {"n": "cast(o_orderkey as string)"})
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('h', o_custkey) as repo", f"{path} as path")


# Checks that derived findings are spread over, of every severity and domain.
EVENT_CHECKS = ["S1", "S5", "D1", "D8", "A2", "A3", "R2", "R5", "C3", "C5", "P1", "P3", "O1",
                "O3", "O5", "H1", "H2", "H8", "X1", "T1", "T2", "S4", "C2"]


def event_findings(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Events as findings; keys repeat within a repository."""
    check = _pick(EVENT_CHECKS, f"(event_id * 5 + user_id) % {len(EVENT_CHECKS)}")
    return table(spark, sf_dir, "events").where(where).selectExpr(
        "concat('u', user_id) as repo", f"{check} as check_id",
        "concat('src/f', event_id % 7, '.ts') as file",
        "cast(floor(value) % 20 + 1 as int) as line", "event_type as snippet",
        "if(event_id % 3 = 0, 'CONFIRMED', 'SUSPECTED') as confidence", "'' as evidence")


def user_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of the derived findings, and customers as ones without any."""
    users = table(spark, sf_dir, "events").selectExpr("concat('u', user_id) as repo")
    quiet = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) as repo")
    return users.unionByName(quiet).distinct()


def findings_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_findings(spark, sf_dir, "ts < timestamp '2024-01-16 00:00:00'")


def findings_cur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_findings(spark, sf_dir, "ts >= timestamp '2024-01-11 00:00:00'")


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rule matches before dedup."""
    check = _pick(EVENT_CHECKS, f"l_partkey % {len(EVENT_CHECKS)}")
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('s', l_suppkey) as repo", f"{check} as check_id",
        "concat('f', l_partkey % 5) as file", "cast(l_quantity as int) as line",
        "l_linenumber as rule", "l_orderkey as offset",
        "concat(l_returnflag, l_linestatus) as snippet")


STACKS = ["nextjs,react,npm", "express,npm", "supabase,react,npm", "python,fastapi",
          "firebase,react,npm", "", "supabase,nextjs,npm"]
REASONS = ["clone-failed", "TimeoutExpired", "UnicodeDecodeError"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan result per user, and one without findings per supplier."""
    check = _pick(EVENT_CHECKS, f"(event_id * 5 + user_id) % {len(EVENT_CHECKS)}")
    rows = table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id", "value", f"{check} as check_id")
    per_user = rows.groupBy("user_id").agg(
        F.expr("array_sort(collect_set(if(check_id in ('H1', 'S4'), null, check_id)))").alias("checks"),
        F.struct(*[F.count_if((severity_of() == s)
                              & ~F.col("check_id").isin("H1", "S4")).alias(s)
                   for s in SEVERITIES]).alias("severity"),
        F.count_if(~F.col("check_id").isin("H1", "S4")).alias("total"),
        F.max(F.expr("event_id % 50 + 1")).alias("files"), F.max("value").alias("seconds"))
    tags = _pick(STACKS, f"user_id % {len(STACKS)}")
    noisy = per_user.selectExpr(
        "user_id % 11 <> 0 as ok",
        f"if(user_id % 11 <> 0, null, {_pick(REASONS, f'user_id div 11 % {len(REASONS)}')}) as reason",
        "concat('u', user_id) as id", "checks", "severity", "total", "files",
        f"filter(split({tags}, ','), t -> t <> '') as stack", "seconds")
    quiet = table(spark, sf_dir, "supplier").selectExpr(
        "true as ok", "cast(null as string) as reason", "concat('s', s_suppkey) as id",
        "cast(array() as array<string>) as checks",
        "named_struct('P0', 0L, 'P1', 0L, 'P2', 0L, 'P3', 0L) as severity", "0L as total",
        "s_suppkey % 40 as files", "array('npm') as stack", "s_acctbal as seconds")
    return noisy.unionByName(quiet)


def listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as search hits: one marker per priority, names repeat, some are forks."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority as marker", "o_orderkey as position",
        "case when o_custkey % 17 = 0 then null when o_custkey % 19 = 0 then '  ' "
        "else concat(' owner', o_custkey % 40, '/app', o_custkey, ' ') end as full_name",
        "o_orderstatus = 'P' as fork")
