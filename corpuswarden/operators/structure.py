"""Checks of module structure: copies, orphans, commented code, size, clones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from corpuswarden.functions import paths, text as tx
from corpuswarden.plans.facts import FileColumns, fact, when
from corpuswarden.plans.scan import as_findings, findings_row
from corpuswarden.session import sized_join, write_once

# Limits and patterns.
MAX_LINES = 600
MIN_RUN = 5
WINDOW = 3
MIN_BLOCK_CHARS = 60
MIN_SITES = 3
LEFTOVER = (r"(?i)[-_. ]?(fixed|new|old|final|copy|backup|bak|v\d+|\d+|updated|temp|tmp"
            r"|test2)$")
IMPORT = (r"(?:from\s+[\"']([^\"']+)[\"']|require\(\s*[\"']([^\"']+)[\"']\s*\)"
          r"|import\s+[\"']([^\"']+)[\"'])")
PY_IMPORT = r"(?m)^[^\S\n]*+(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))"
ALIAS = r"^[@~#$][\w.-]*/"
COMMENT = r"^\s*(?://|#)\s*(.*)$"
CODE_LIKE = (r"[;{}()=]|^\s*(?:const|let|var|def|return|if|for|while|class|import|export)\b")
ENTRYPOINT = (
    r"(?i)(^|/)(page|layout|route|error|loading|not-found|middleware|index|main|app|conftest"
    r"|setup|manage|wsgi|asgi|__init__)\.(?:[jt]sx?|py)$"
    r"|(^|/)(pages|routes|migrations|supabase|scripts|tests?)/"
    r"|(^|/)[\w.-]+\.config\.[jt]sx?$|(^|/)(sentry|instrumentation)[\w.]*\.[jt]s$"
)
MAIN_GUARD = r"(?m)^[^\S\n]*+if\s+__name__\s*==\s*[\"']__main__[\"']"


# ---- module names ---------------------------------------------------------------------

def module_probe(c: FileColumns) -> str:
    """Modules; `b` is 'test', 'exempt' (loaded by name or run directly) or 'plain'."""
    exempt = tx.any_of(
        tx.matches_regex(c.rel, ENTRYPOINT),
        tx.all_of(f"contains({c.text}, '__main__')", tx.matches_regex(c.text, MAIN_GUARD)))
    role = f"case when {c.test} then 'test' when {exempt} then 'exempt' else 'plain' end"
    return when(c.suffix(paths.MODULES), f"array({fact('module', b=role)})")


def name_families(facts: DataFrame) -> DataFrame:
    """H2: modules of one directory whose names differ only by leftover suffixes.

    Suffixes are taken off one by one until none is left; each takes a character at
    least, so a name's length bounds the steps.
    """
    stem = paths.stem("rel")
    bare = (f"aggregate(sequence(1, greatest(length({stem}), 1)), {stem}, "
            f"(s, _) -> regexp_replace(s, {tx.regex(LEFTOVER)}, ''))")
    family = f"regexp_replace(concat({paths.parent('rel')}, '/', lower({bare})), '^[./]+', '')"
    return (
        facts.where("kind = 'module' and b <> 'test'")
        .selectExpr("repo", "rel", f"{family} as family", f"length({stem}) as size")
        .groupBy("repo", "family")
        .agg(F.count("*").alias("n"), F.expr("max(struct(size, rel)).rel").alias("leftover"),
             F.expr("min(struct(size, rel)).rel").alias("original"))
        .where("n >= 2")
        .select(*findings_row(
            "'H2'", "leftover", "1",
            "concat('looks like a copy of ', original, ' (common name ', "
            "substring_index(family, '/', -1), ')')", "CONFIRMED"))
    )


# ---- imports --------------------------------------------------------------------------

def import_probe(c: FileColumns) -> str:
    """Import targets of each module, resolved to a path without suffix."""
    specs = ", ".join(
        [f"regexp_extract_all({c.text}, {tx.regex(IMPORT)}, {g})" for g in (1, 2, 3)]
        + [f"regexp_extract_all({c.text}, {tx.regex(PY_IMPORT)}, {g})" for g in (1, 2)])
    folder = f"if(contains({c.rel}, '/'), concat({paths.parent(c.rel)}, '/'), '')"
    target = (
        f"case when startswith(s, '.') then {paths.normalise('concat(' + folder + ', s)')} "
        f"when s rlike {tx.regex(ALIAS)} then regexp_replace(s, {tx.regex(ALIAS)}, '') "
        f"else replace(s, '.', '/') end")
    found = (f"array_distinct(transform(filter(flatten(array({specs})), s -> s <> ''), "
             f"s -> {target}))")
    return when(
        tx.all_of(c.suffix(paths.MODULES), c.holds(("from", "import", "require"))),
        f"transform(filter({found}, t -> t <> ''), t -> {fact('import', 't')})")


def endings(stems: DataFrame, targets: DataFrame) -> DataFrame:
    """(repo, rel, ending): the endings of a stem that are as long as a target of its repository."""
    lengths = targets.groupBy("repo").agg(F.collect_set(F.length("ending")).alias("lengths"))
    of_lengths = "transform(filter(lengths, n -> n <= length(stem)), n -> right(stem, n))"
    return sized_join(stems, lengths, "repo").select(
        "repo", "rel", F.explode(F.expr(of_lengths)).alias("ending"))


def orphan_modules(facts: DataFrame) -> DataFrame:
    """H3: plain modules that no import target of the repository ends.

    A target reaches a module when the module's path ends with it, at any character.
    Endings are matched as equal keys: first at path separators, which settles most
    modules with a few keys each. For those still unmatched an ending is made only of each
    length that a target of the repository has, so a module has as many keys as there
    are different lengths, however long its path is.
    """
    targets = facts.where("kind = 'import'").selectExpr("repo", "a as ending").distinct()
    stems = facts.where("kind = 'module' and b = 'plain'").selectExpr(
        "repo", "rel", f"{paths.without_suffix('rel')} as stem")

    at_separators = ("transform(sequence(1, size(split(stem, '/'))), "
                     "n -> substring_index(stem, '/', -n))")
    named = (
        stems.select("repo", "rel", F.explode(F.expr(at_separators)).alias("ending"))
        .join(targets, ["repo", "ending"], "left_semi")
    )
    unnamed = write_once(stems.join(named, ["repo", "rel"], "left_anti"))
    ended = endings(unnamed, targets).join(targets, ["repo", "ending"], "left_semi")
    return unnamed.join(ended, ["repo", "rel"], "left_anti").select(*findings_row(
        "'H3'", "rel", "1", "'no import reaches this module'", "CONFIRMED"))


# ---- lines of one file ----------------------------------------------------------------

def comment_run_probe(c: FileColumns, min_run: int = MIN_RUN) -> str:
    """H6: runs of comment lines that look like code, from their first and last lines."""
    body = f"regexp_extract(l, {tx.regex(COMMENT)}, 1)"
    is_code = tx.all_of(tx.matches_regex("l", COMMENT), tx.matches_regex(body, CODE_LIKE))
    edge = ("filter(transform(v, (is, i) -> if(is and not coalesce(get(v, i {0} 1), false), "
            "i + 1, null)), n -> n is not null)")
    runs = tx.let("v", f"transform({tx.lines(c.text)}, l -> {is_code})",
                  f"filter(arrays_zip({edge.format('-')}, {edge.format('+')}), "
                  f"r -> r.`1` - r.`0` + 1 >= {min_run})")
    finding = fact("local", tx.quote("H6"), line="r.`0`", snippet=(
        "concat(r.`1` - r.`0` + 1, ' lines of commented-out code in a row')"))
    return when(
        tx.all_of(f"not {c.test}", tx.contains_any(c.text, ("//", "#"))),
        f"transform({runs}, r -> {finding})")


def size_probe(c: FileColumns, max_lines: int = MAX_LINES) -> str:
    """H7: modules with more lines than the limit; a final newline starts no line."""
    newline = tx.quote("\n")
    count = (f"(length({c.text}) - length(replace({c.text}, {newline}, '')) + "
             f"if({c.text} = '' or endswith({c.text}, {newline}), 0, 1))")
    finding = fact("local", tx.quote("H7"), line="1", snippet=f"concat({count}, ' lines')")
    return when(f"{c.suffix(paths.MODULES)} and not {c.test} and {count} > {max_lines}",
                f"array({finding})")


def comment_runs(facts: DataFrame) -> DataFrame:
    return as_findings(facts.where("kind = 'local' and a = 'H6'"))


def oversized_files(facts: DataFrame) -> DataFrame:
    return as_findings(facts.where("kind = 'local' and a = 'H7'"))


# ---- repeated blocks ------------------------------------------------------------------

def _blocks(text: str, size: int, min_chars: int) -> str:
    """Blocks of `size` lines with blanks collapsed: an array of (line, frame)."""
    newline = tx.quote("\n")
    ended = f"if(endswith({text}, {newline}), left({text}, length({text}) - 1), {text})"
    one_blank = f"regexp_replace(l, {tx.regex(r'[\s]+')}, ' ')"
    cleaned = f"transform({tx.lines(ended)}, l -> {tx.strip(one_blank)})"
    frames = (f"transform(sequence(1, size(v) - {size - 1}), "
              f"i -> named_struct('line', i, 'frame', slice(v, i, {size})))")
    long_enough = (f"filter({frames}, w -> aggregate(w.frame, 0, (n, l) -> n + length(l)) "
                   f">= {min_chars})")
    return tx.let("v", cleaned, f"if(size(v) >= {size}, {long_enough}, array())")


def _block_scope(suffixes) -> str:
    scope = f"not {paths.is_test('rel')}"
    return f"{scope} and {paths.has_suffix('rel', suffixes)}" if suffixes else scope


def sliding_lines(files: DataFrame, suffixes=paths.MODULES, size: int = WINDOW,
                  min_chars: int = MIN_BLOCK_CHARS) -> DataFrame:
    """Blocks of `size` consecutive lines with blanks collapsed: (repo, rel, line, body).

    A file is one row, so the frame slides inside the row and nothing is shuffled.
    """
    return (
        files.where(_block_scope(suffixes))
        .select("repo", "rel", F.explode(F.expr(_blocks("text", size, min_chars))).alias("w"))
        .select("repo", "rel", "w.line", F.array_join("w.frame", "\n").alias("body"))
    )


def block_probe(c: FileColumns) -> str:
    """H8: the digest and the line of every block of a module."""
    digest = "md5(array_join(w.frame, '\\n'))"
    found = _blocks(c.text, WINDOW, MIN_BLOCK_CHARS)
    return when(f"not {c.test} and {c.suffix(paths.MODULES)}",
                f"transform({found}, w -> {fact('block', digest, line='w.line')})")


def clone_blocks(files: DataFrame, suffixes=paths.MODULES) -> DataFrame:
    """H8 of a files table by itself: its blocks are cut here."""
    blocks = write_once(sliding_lines(files, suffixes).selectExpr(
        "repo", "rel", "line", "md5(body) as digest"))
    return most_repeated(blocks, files)


def most_repeated(blocks: DataFrame,
                  files: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """H8: the most repeated of `blocks` (repo, rel, line, digest), one finding per repository.

    Digests are counted before the shuffle, and those of the winning blocks meet their
    sites. The texts are read once more, only to fetch the winning blocks: of those
    repeated equally often the first in order is reported. `files` may be a function from
    the wanted (repo, rel) to their texts.
    """
    repeated = write_once(
        blocks.groupBy("repo", "digest").agg(F.count("*").alias("n")).where(f"n >= {MIN_SITES}"))
    best = repeated.groupBy("repo").agg(F.max("n").alias("n"), F.count("*").alias("groups"))
    winners = repeated.join(best, ["repo", "n"]).select("repo", "digest", "n", "groups")
    sites = sized_join(blocks, winners, ["repo", "digest"])
    first = sites.selectExpr(
        "*", "row_number() over (partition by repo, digest order by rel, line) as place",
    ).where(f"place <= {MIN_SITES}")
    listed = first.groupBy("repo", "digest", "n", "groups").agg(
        F.expr("array_sort(collect_list(struct(rel, line)))").alias("sites")).selectExpr(
        "*", "sites[0].rel as rel", "sites[0].line as line")
    if callable(files):
        listed = write_once(listed)
        files = files(listed.select("repo", "rel").distinct())
    held = sized_join(files.select("repo", "rel", "text"), listed, ["repo", "rel"])
    body = f"array_join(filter({_blocks('text', WINDOW, MIN_BLOCK_CHARS)}, w -> w.line = line)[0].frame, '\\n')"
    named = "array_join(transform(best.sites, s -> concat(s.rel, ':', s.line)), ', ')"
    more = "if(groups > 1, concat(', besides ', groups - 1, ' other blocks'), '')"
    return (
        held.withColumn("body", F.expr(body)).groupBy("repo", "n", "groups")
        .agg(F.expr("min(struct(body, sites))").alias("best"))
        .select(*findings_row(
            "'H8'", "best.sites[0].rel", "best.sites[0].line",
            tx.snippet(f"concat('the same block at ', n, ' places (', {named}, ')', {more})"),
            "SUSPECTED"))
    )
