"""Checks over version history kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuswarden.functions import text as tx
from corpuswarden.plans.scan import findings_row

# Secret paths, and paths that look like one but hold no key.
SECRET_PATHS = (".env", ".env.local", ".env.production", "credentials.json",
                "serviceAccount.json", "id_rsa")
SECRET_GLOBS = ("*.pem",)
NOT_A_SECRET = (r"(?i)(cacert|ca-bundle|ca-certificates|fullchain|/certifi/|node_modules/"
                r"|\.venv/|site-packages/|vendor/)")


# H1 of a row of `history_of`: no history at all, or a single commit in a complete copy.
NO_DEPTH = "commits is null or (commits = 1 and not shallow)"
DEPTH_TEXT = ("if(commits is null, 'not under version control', concat('only ', commits, "
              "' commit(s) in its history'))")


def history_of(commits: DataFrame) -> DataFrame:
    """(repo, commits, shallow) from (repo, commit_id, shallow).

    A row whose id is null stands for a history that could not be read.
    """
    return commits.groupBy("repo").agg(
        F.count("commit_id").alias("commits"), F.expr("bool_or(shallow)").alias("shallow"))


def history_depth(repos: DataFrame, commits: DataFrame) -> DataFrame:
    """H1: no history at all, or a single commit in a complete copy."""
    return (
        repos.select("repo").distinct().join(history_of(commits), "repo", "left")
        .where(NO_DEPTH).select(*findings_row("'H1'", "'.'", "1", DEPTH_TEXT, "CONFIRMED"))
    )


def history_notes(repos: DataFrame, commits: DataFrame) -> DataFrame:
    """Coverage notes on history: (repo, note)."""
    return repos.select("repo").distinct().join(history_of(commits), "repo", "left").selectExpr(
        "repo", """explode(filter(array(
            if(commits is null, 'not under version control: S4 (history) does not apply', null),
            if(commits = 0, 'the history cannot be read: H1 and S4 do not apply', null),
            if(commits > 0 and shallow, 'shallow copy: the depth of the history (H1) is unknown', null),
            if(commits > 0, 'history: only the paths of added files were looked at', null)
        ), x -> x is not null)) as note""")


def secret_in_history(added_paths: DataFrame) -> DataFrame:
    """S4: per repository and secret pattern, the first path ever added.

    A plain pattern is a path from the top, or a directory of that name; a glob
    reaches into every directory.
    """
    plain = [f"if(path = {tx.quote(p)} or startswith(path, {tx.quote(p + '/')}), "
             f"{tx.quote(p)}, null)" for p in SECRET_PATHS]
    globs = [f"if(endswith(path, {tx.quote(g[1:])}), {tx.quote(g)}, null)" for g in SECRET_GLOBS]
    patterns = f"filter(array({', '.join(plain + globs)}), p -> p is not null)"
    return (
        added_paths.where(f"not path rlike {tx.quote(NOT_A_SECRET)}")
        .select("repo", "path", F.explode(F.expr(patterns)).alias("pattern"))
        .groupBy("repo", "pattern").agg(F.min("path").alias("path"))
        .select(*findings_row("'S4'", "path", "1",
                              "concat(path, ' was once added to the history')",
                              "CONFIRMED"))
    )
