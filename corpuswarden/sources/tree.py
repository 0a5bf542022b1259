"""From stored bytes to the files table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpuswarden.functions import paths, text as tx
from corpuswarden.plans.facts import FileColumns, fact, when
from corpuswarden.session import sized_join, write_once

# Limits a caller may ask for; without one nothing is left out.
USUAL_MAX_BYTES = 2_000_000
USUAL_MAX_FILES = 20_000
USUAL_SNIFF_BYTES = 4096

# Paths of a repository among which a bound for its last kept one is looked for.
BOUND_PATHS = 200_000

# Stack tags by dependency, lockfile, python marker and root entry.
DEPENDENCY_TAGS = {
    "next": "nextjs", "react": "react", "vite": "vite", "express": "express",
    "@supabase/supabase-js": "supabase", "firebase": "firebase", "firebase-admin": "firebase",
    "prisma": "prisma", "@prisma/client": "prisma", "drizzle-orm": "drizzle",
    "fastapi": "fastapi", "django": "django",
}
LOCK_TAGS = {"pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "package-lock.json": "npm",
             "bun.lockb": "bun"}
PYTHON_MARKERS = ("requirements.txt", "pyproject.toml", "Pipfile")
PYTHON_TAGS = ("fastapi", "django")
ROOT_TAGS = {"vercel.json": "vercel", "firestore.rules": "firebase", "firebase.json": "firebase"}
FOLDER_TAGS = {"supabase/": "supabase", ".vercel/": "vercel"}


def as_raw(stored: DataFrame) -> DataFrame:
    """Raw files from a table (repo, rel, content): every name counts, hidden ones too."""
    return stored.selectExpr("repo", "rel", "cast(octet_length(content) as bigint) as length", "content")


def path_ignore(raw: DataFrame) -> DataFrame:
    """Drop ignored directories, suffixes and minified files."""
    return raw.where(f"not {paths.is_ignored('rel')}")


def classify(raw: DataFrame, max_bytes: int | None = None,
             sniff_bytes: int | None = None) -> DataFrame:
    """Files with a `reason` when they cannot be scanned, a `text` when they can.

    A file is too large beyond `max_bytes`, whether or not it was read, and binary with a
    zero among its first `sniff_bytes`; without these limits every file that was read
    has a text.
    """
    reasons = ["when content is null then 'not readable'"]
    if max_bytes is not None:
        reasons.insert(0, f"when length > {max_bytes} then concat(length, ' bytes exceed the limit')")
    if sniff_bytes is not None:
        reasons.append(f"when position(X'00' in substring(content, 1, {sniff_bytes})) > 0 then 'binary'")
    return raw.selectExpr("repo", "rel", "length", "content",
                          f"case {' '.join(reasons)} end as reason").selectExpr(
        "repo", "rel", "cast(length as bigint) as length", "reason",
        "if(reason is null, make_valid_utf8(cast(content as string)), null) as text")


def ingest_files(raw: DataFrame, max_bytes: int | None = None,
                 sniff_bytes: int | None = None) -> DataFrame:
    """The files table: bytes decoded, without the files that have a reason not to be."""
    return classify(raw, max_bytes, sniff_bytes).where("reason is null").select("repo", "rel", "text")


def skipped_files(raw: DataFrame, max_bytes: int | None = None,
                  sniff_bytes: int | None = None) -> DataFrame:
    return classify(raw, max_bytes, sniff_bytes).where("reason is not null").select("repo", "rel", "reason")


def file_cap(files: DataFrame, limit: int | None = None, salts: int = 256) -> DataFrame:
    """The first `limit` paths of each repository, or all without a limit.

    It counts paths before any file is skipped, so it goes between `path_ignore` and
    `ingest_files`. Only repositories over the limit are ranked, on their paths alone, written
    once, and only up to a path that is known to have `limit` others before it. Each of a
    repository's `salts` slices keeps its own first paths, so the final ranking of
    the largest repository sees at most `salts * limit` short rows. The texts stay
    where they are: they meet only the last kept path of each ranked repository.
    """
    if limit is None:
        return files
    counts = write_once(files.groupBy("repo").agg(F.count("*").alias("n")).where(f"n > {limit}"))
    narrow = write_once(files.select("repo", "rel").join(counts.select("repo"), "repo", "left_semi"))
    near = sized_join(narrow, _bounds(narrow, counts, limit), "repo", "left").where(
        f"bound is null or {UP_TO_BOUND}").select("repo", "rel")
    salted = near.withColumn("salt", F.pmod(F.xxhash64("rel"), F.lit(salts)))
    in_slice = Window.partitionBy("repo", "salt").orderBy("rel")
    overall = Window.partitionBy("repo").orderBy("rel")
    cut = (
        salted.withColumn("place", F.row_number().over(in_slice)).where(f"place <= {limit}")
        .withColumn("place", F.row_number().over(overall)).where(f"place <= {limit}")
        .groupBy("repo").agg(F.max("rel").alias("last"))
    )
    kept = sized_join(files, cut, "repo", "left").where("last is null or rel <= last")
    return kept.select(*files.columns)


# A path without a name is ranked before all others.
UP_TO_BOUND = "(rel is null or rel <= bound)"


def _bounds(narrow: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    """(repo, bound) of repositories far over the limit: `limit` paths or more lie up to the bound.

    About `BOUND_PATHS` of a repository's paths, chosen by their hash, are ranked, and the one
    somewhat beyond where the last kept path should lie is taken. Then all paths up to it are
    counted. A repository where they are too few gets no bound, and is ranked whole.
    """
    share = f"least(1, {BOUND_PATHS} / n)"
    guess = f"cast({limit} * {share} + 6 * sqrt({limit} * {share}) + 10 as int)"
    large = counts.where(f"n > 4 * {limit}").selectExpr("repo", f"{share} as share", f"{guess} as guess")
    place = F.row_number().over(Window.partitionBy("repo").orderBy("rel"))
    guessed = (
        sized_join(narrow, large, "repo").where("pmod(xxhash64(rel), 1000000000) < share * 1000000000")
        .withColumn("place", place).where("place = guess").select("repo", F.col("rel").alias("bound"))
    )
    return (
        sized_join(narrow, guessed, "repo").where(UP_TO_BOUND)
        .groupBy("repo").agg(F.count("*").alias("n"), F.first("bound").alias("bound"))
        .where(f"n >= {limit}").select("repo", "bound")
    )


def cap_notes(files: DataFrame, limit: int = USUAL_MAX_FILES) -> DataFrame:
    """Coverage note of each repository over the limit."""
    return (
        files.groupBy("repo").agg(F.count("*").alias("n")).where(f"n > {limit}")
        .selectExpr("repo", f"concat('only the first {limit} of ', n, ' files were scanned') as note")
    )


def stack_probe(c: FileColumns) -> str:
    """Tags that the text of a manifest contributes to its repository's stack."""
    def options(tags: dict[str, str]) -> str:
        return "map(" + ", ".join(f"{tx.quote(k)}, {tx.quote(v)}" for k, v in tags.items()) + ")"

    sections = "from_json(_text, 'struct<dependencies:map<string,string>,devDependencies:" \
               "map<string,string>>')"
    declared = tx.let(
        "d", sections,
        "concat(map_keys(coalesce(d.dependencies, map())), "
        "map_keys(coalesce(d.devDependencies, map())))")
    from_manifest = (f"if(rel = 'package.json', transform({declared}, "
                     f"n -> element_at({options(DEPENDENCY_TAGS)}, n)), "
                     f"cast(array() as array<string>))")
    markers = ", ".join(tx.quote(m) for m in PYTHON_MARKERS)
    python = [f"if(rel in ({markers}) and contains(_low, '{t}'), '{t}', null)" for t in PYTHON_TAGS]
    tags = f"concat({from_manifest}, array({', '.join(python)}))"
    return f"transform(filter({tags}, t -> t is not null), t -> {fact('stack', 't')})"


def stack_tags(facts: DataFrame, paths: DataFrame) -> DataFrame:
    """Sorted distinct tags per repository; at most a dozen and a half tags exist.

    Lockfiles, folders and root files tell by their paths (repo, rel), ignored ones
    included; manifests tell by their texts.
    """
    markers = ", ".join(tx.quote(m) for m in PYTHON_MARKERS)
    named = ({"package.json": "npm"} | LOCK_TAGS | ROOT_TAGS).items()
    tests = [f"if(rel = {tx.quote(n)}, '{t}', null)" for n, t in named]
    tests += [f"if(startswith(rel, '{f}'), '{t}', null)" for f, t in FOLDER_TAGS.items()]
    tests.append(f"if(rel in ({markers}), 'python', null)")
    told = paths.select("repo", F.expr(f"array_compact(array({', '.join(tests)}))").alias("tags")).select(
        "repo", F.explode_outer("tags").alias("tag"))
    read = facts.where("kind = 'stack'").select("repo", F.col("a").alias("tag"))
    return told.unionByName(read).groupBy("repo").agg(
        F.array_sort(F.collect_set("tag")).alias("stack"))


def coverage_summary(files: DataFrame, skipped: DataFrame, notes: DataFrame,
                     stack: DataFrame, shown: int = 5) -> DataFrame:
    """Per repository: scanned files, skipped total and first few, notes, stack.

    Skipped files are unbounded, so only the first `shown` per repository are listed;
    notes are a handful of fixed sentences.
    """
    scanned = files.groupBy("repo").agg(F.count("*").alias("scanned_files"))
    totals = skipped.groupBy("repo").agg(F.count("*").alias("skipped_total"))
    first = (
        skipped.withColumn("place", F.row_number().over(
            Window.partitionBy("repo").orderBy("rel")))
        .where(f"place <= {shown}")
        .groupBy("repo")
        .agg(F.expr("transform(array_sort(collect_list(struct(rel, reason))), "
                    "s -> concat(s.rel, ' (', s.reason, ')'))").alias("skipped"))
    )
    noted = notes.groupBy("repo").agg(F.array_sort(F.collect_set("note")).alias("notes"))
    nothing = F.expr("cast(array() as array<string>)")
    return (
        scanned.join(totals, "repo", "full").join(first, "repo", "left")
        .join(noted, "repo", "left").join(stack, "repo", "left")
        .select("repo", F.coalesce("scanned_files", F.lit(0)).alias("scanned_files"),
                F.coalesce("skipped_total", F.lit(0)).alias("skipped_total"),
                F.coalesce("skipped", nothing).alias("skipped"),
                F.coalesce("notes", nothing).alias("notes"),
                F.coalesce("stack", nothing).alias("stack"))
    )


def corpus_list(listed: DataFrame, limit: int | None = None) -> DataFrame:
    """Names in first-seen order from (marker, position, full_name, fork).

    Blank and missing names and forks are left out; a name found under several
    markers keeps its first place.
    """
    first = (
        listed.selectExpr("marker", "position", f"{tx.strip('full_name')} as name", "fork")
        .where("name is not null and name <> '' and not coalesce(fork, false)")
        .groupBy("name").agg(F.expr("min(struct(marker, position))").alias("seen"))
        .selectExpr("name", "seen.marker as marker", "seen.position as position")
    )
    if limit is None:
        return first
    return first.orderBy("marker", "position", "name").limit(limit)


def read_corpus_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank trimmed lines of a list file."""
    return spark.read.text(path).selectExpr(f"{tx.strip('value')} as name").where("name <> ''")
