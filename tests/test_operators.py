"""Ingest, findings, study, sinks and streaming operators."""

import io
import os
import random
import statistics
import tarfile
import time
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpuswarden.catalog import CHECKS, DOMAINS, checks
from corpuswarden.functions import paths
from corpuswarden.operators import findings as fnd, study
from corpuswarden.plans import audit
from corpuswarden.plans.rulebook import RULE_CHECKS
from corpuswarden.plans.scan import rule_scan
from corpuswarden.schema import FINDINGS, REPO_RUNS
from corpuswarden.session import Workspace, settings, sized_join, workspace
from corpuswarden.sources import archives, corpora, findings_io, tree
from corpuswarden.streaming import rescan


@pytest.fixture
def findings(spark):
    def make(*rows):
        return spark.createDataFrame(
            [(r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else "s",
              r[5] if len(r) > 5 else "CONFIRMED", "") for r in rows], FINDINGS)
    return make


def repos(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "repo string")


# ---- catalog ----------------------------------------------------------------------------

def test_catalog(spark):
    rows = checks(spark).collect()
    assert len(rows) == 64 and sum(r.implemented for r in rows) == 48
    counts = {d: sum(r.domain == d for r in rows) for d in DOMAINS}
    assert counts == {"S": 6, "D": 9, "A": 6, "R": 9, "C": 8, "P": 5, "O": 5, "H": 8, "X": 5, "T": 3}
    assert {c[0] for c in CHECKS if c[3] in ("static", "config") and not c[4]} == {"X5"}
    assert set(RULE_CHECKS) <= {c[0] for c in CHECKS if c[4]}


# ---- files ------------------------------------------------------------------------------

HIDDEN = {".env": b"A=1", ".gitignore": b"x", ".github/workflows/ci.yml": b"on: push", "pkg/__init__.py": b"",
          "pages/_app.tsx": b"x", "__tests__/a.test.ts": b"y", "yarn.lock": b"", "src/a.ts": b"caf\xe9", "b.dat": b"\x00z"}


def packed(folder, repo, files, kind):
    folder.mkdir(parents=True, exist_ok=True)
    if kind == "zip":
        with zipfile.ZipFile(folder / f"{repo}.zip", "w") as held:
            for name, data in files.items():
                held.writestr(name, data)
    else:
        with tarfile.open(folder / f"{repo}.{kind}", "w:gz" if kind == "tgz" else "w") as held:
            for name, data in files.items():
                info = tarfile.TarInfo("./" + name)
                info.size = len(data)
                held.addfile(info, io.BytesIO(data))


def test_archives_keep_every_name(spark, tmp_path, monkeypatch):
    root = tmp_path / "src" / "my corpus+1"
    packed(root, "a", HIDDEN, "zip")
    packed(root, "b.v2", HIDDEN, "tar")
    packed(root / "src", "part-0", {"src/src/x.ts": b"1"}, "tgz")
    (root / "broken.zip").write_bytes(b"PK nothing")
    (root / "notes.txt").write_bytes(b"not an archive")
    raw = archives.read_archives(spark, str(root))
    got = {(r.repo, r.rel): (r.length, r.content) for r in raw.collect()}
    assert {rel for repo, rel in got if repo == "a"} == {rel for repo, rel in got if repo == "b.v2"} == set(HIDDEN)
    assert got["a", "src/a.ts"] == (4, b"caf\xe9") and got["src", "src/src/x.ts"] == (1, b"1")
    assert [r.reason for r in tree.skipped_files(raw).collect()] == ["not readable"]
    texts = {r.rel: r.text for r in tree.ingest_files(raw.where("repo = 'a'")).collect()}
    assert texts.keys() == HIDDEN.keys() and texts["src/a.ts"] == "caf" + chr(0xFFFD)
    assert "yarn.lock" not in {r.rel for r in tree.path_ignore(raw).collect()}


def test_nothing_is_left_out_without_a_limit(spark, make_files):
    stored = spark.createDataFrame([("a", k, bytearray(v)) for k, v in {
        **HIDDEN, "big.txt": b"x" * 50, "late.txt": b"k" * 10 + b"\x00"}.items()],
        "repo string, rel string, content binary")
    raw = tree.as_raw(stored)
    assert tree.ingest_files(raw).count() == raw.count() and tree.skipped_files(raw).count() == 0
    gone = {r.rel: r.reason for r in tree.skipped_files(raw, 40, 4).collect()}
    assert gone == {"big.txt": "50 bytes exceed the limit", "b.dat": "binary"}
    assert tree.skipped_files(raw, None, 11).count() == 2
    files = make_files({"a": {f"f{i}": "x" for i in range(9)}})
    assert tree.file_cap(files).count() == 9


def test_test_paths(spark):
    cases = {"tests/a.py": True, "src/latest/a.ts": False, "src/contest/a.ts": False,
             "a/__mocks__/b.js": True, "x/test_y.py": True, "x/y_test.py": True, "a.spec.tsx": True,
             "protester.ts": False, "conftest.py": True, "Fixtures/a": True, "a/testdata/b": True}
    df = spark.createDataFrame([(c,) for c in cases], "rel string").selectExpr(
        "rel", f"{paths.is_test('rel')} as t")
    assert {r.rel: r.t for r in df.collect()} == cases


def test_path_arithmetic(spark):
    import posixpath
    cases = ["a/./b", "a/../b", "../a", "a/b/../../..", "a//b", "./x", "a/b/..", "", "..", "a/../../b"]
    df = spark.createDataFrame([(c,) for c in cases], "p string").selectExpr(
        "p", f"{paths.normalise('p')} as n")
    assert {r.p: r.n for r in df.collect()} == {c: posixpath.normpath(c) for c in cases}


def test_file_cap_is_exact(make_files):
    random.seed(3)
    names = random.sample(range(1000), 60)
    files = make_files({"big": {f"f{n:04d}": "x" for n in names}, "small": {"z": "x", "y": "x"}})
    kept = tree.file_cap(files, limit=17, salts=4).collect()
    assert sorted(r.rel for r in kept if r.repo == "big") == sorted(f"f{n:04d}" for n in names)[:17]
    assert sum(r.repo == "small" for r in kept) == 2
    assert [r.note for r in tree.cap_notes(files, 17).collect()] == [
        "only the first 17 of 60 files were scanned"]


@pytest.mark.parametrize("looked_at", [100, 10_000])
def test_file_cap_ranks_paths_up_to_a_bound(spark, make_files, monkeypatch, looked_at):
    monkeypatch.setattr(tree, "BOUND_PATHS", looked_at)
    files = make_files({"big": {f"f{n:04d}": "x" for n in range(900)}, "over": {f"g{n}": "x" for n in range(30)},
                        "small": {"z": "x"}}).unionByName(spark.createDataFrame(
        [("same", "a", "x")] * 300 + [("big", None, "x"), (None, "n", "x")], "repo string, rel string, text string"))
    counts = files.groupBy("repo").agg(F.count("*").alias("n")).where("n > 17")
    bounds = {r.repo: r.bound for r in tree._bounds(files.select("repo", "rel"), counts, 17).collect()}
    assert "over" not in bounds and "f0015" <= bounds["big"] < "f0800"
    kept = tree.file_cap(files, 17, salts=4).collect()
    assert sorted(r.rel for r in kept if r.repo == "big") == [f"f{n:04d}" for n in range(16)]
    assert sorted(r.rel for r in kept if r.repo == "over") == sorted(f"g{n}" for n in range(30))[:17]
    assert sum(r.repo == "same" for r in kept) == 300  # all at the last kept path
    assert sum(r.repo in ("small", None) for r in kept) == 2


def test_a_bound_with_too_few_paths_is_not_used(make_files, monkeypatch):
    files = make_files({"big": {f"f{n:04d}": "x" for n in range(900)}})
    monkeypatch.setattr(tree, "sized_join", lambda left, right, *how: left.join(
        right.withColumn("bound", F.lit("f0003")) if "bound" in right.columns and not how[1:] else right, *how))
    counts = files.groupBy("repo").agg(F.count("*").alias("n"))
    assert tree._bounds(files.select("repo", "rel"), counts, 17).collect() == []
    assert len(tree.file_cap(files, 17, salts=4).collect()) == 17


def test_line_files_are_distinct_by_their_names(spark, tmp_path):
    rows = [(1, 23, 4, "N", "O"), (1, 23, 4, "R", "O"), (12, 3, 4, "N", "O"), (None, 23, 4, "N", "O"),
            (5, None, 4, "N", "O"), (1, 23, None, "N", None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, "
                                "l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    made = {(repo, rel, f"export const n = {n}" if n else None)
            for o, p, n, flag, status in rows
            for repo in (f"flag_{flag}", f"status_{status}" if status else None)
            for rel in [f"src/{o}/{p}.{n}.ts" if o and p and n else None]}
    got = [tuple(r) for r in corpora.line_files(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == made


def test_stack_tags(make_files):
    listed = make_files({
        "web": {"package.json": '{"dependencies": {"next": "1"}, "devDependencies": {"prisma": "1"}}',
                "yarn.lock": "", "supabase/config.toml": ""},
        "py": {"requirements.txt": "FastAPI==1", ".vercel/x": "", "bun.lockb": ""},
        "none": {"a.md": ""}, "broken": {"package.json": "{"}})
    facts = audit.corpus_facts(tree.path_ignore(listed), listed)
    got = {r.repo: r.stack for r in tree.stack_tags(facts, listed).collect()}
    assert got == {"web": ["nextjs", "npm", "prisma", "supabase", "yarn"],
                   "py": ["bun", "fastapi", "python", "vercel"], "none": [], "broken": ["npm"]}


def test_corpus_list(spark, tmp_path):
    rows = [(1, 1, "a/x", False), (1, 2, None, False), (2, 1, "a/x", False), (2, 2, " b/y ", False),
            (1, 3, "c/z", True), (1, 4, "  ", False)]
    listed = spark.createDataFrame(rows, "marker int, position int, full_name string, fork boolean")
    assert sorted(r.name for r in tree.corpus_list(listed).collect()) == ["a/x", "b/y"]
    assert [r.name for r in tree.corpus_list(listed, 1).collect()] == ["a/x"]
    (tmp_path / "list.txt").write_text("a/x\n\n  b/y  \n")
    assert tree.read_corpus_list(spark, str(tmp_path / "list.txt")).count() == 2


def test_coverage_summary(spark, make_files):
    files = make_files({"a": {"x": "1", "y": "2"}})
    skipped = spark.createDataFrame([("a", f"s{i}", "binary") for i in range(7)] + [("b", "q", "binary")],
                                    "repo string, rel string, reason string")
    notes = spark.createDataFrame([("a", "n"), ("a", "n")], "repo string, note string")
    stack = spark.createDataFrame([("a", ["npm"])], "repo string, stack array<string>")
    rows = {r.repo: r for r in tree.coverage_summary(files, skipped, notes, stack).collect()}
    assert (rows["a"].scanned_files, rows["a"].skipped_total) == (2, 7)
    assert rows["a"].skipped == [f"s{i} (binary)" for i in range(5)]
    assert rows["a"].notes == ["n"] and rows["a"].stack == ["npm"]
    assert rows["b"].scanned_files == 0


# ---- findings ---------------------------------------------------------------------------

def test_counts_include_quiet_repositories(spark, findings):
    f = findings(("a", "S1", "x", 1), ("a", "O3", "x", 2), ("a", "O3", "x", 3))
    rows = {r.repo: (r.P0, r.P1, r.P2, r.P3)
            for r in fnd.severity_counts(f, repos(spark, "a", "b")).collect()}
    assert rows == {"a": (1, 0, 0, 2), "b": (0, 0, 0, 0)}
    plan = {r.repo: (r.auto, r.assisted, r.manual)
            for r in fnd.fix_plan(f, repos(spark, "a", "b")).collect()}
    assert plan == {"a": (0, 2, 1), "b": (0, 0, 0)}


def test_verdict_and_gate_differ_on_suspected_findings(spark, findings):
    f = findings(("a", "S1", "x", 1, "s", "SUSPECTED"), ("b", "R2", "x", 1), ("c", "ZZ", "x", 1))
    every = repos(spark, "a", "b", "c", "d")
    assert {r.repo: r.verdict for r in fnd.verdict(f, every).collect()} == {
        "a": "CLEAR", "b": "SHIP WITH CAUTION", "c": "CLEAR", "d": "CLEAR"}
    assert {r.repo for r in fnd.verdict(f, every, False).collect()
            if r.verdict == "DO NOT SHIP"} == {"a"}
    assert {r.repo for r in fnd.gate(f, every).collect() if r.blocked} == {"a"}
    assert {r.repo for r in fnd.gate(f, every, "P1").collect() if r.blocked} == {"a", "b"}
    assert {r.repo for r in fnd.gate(f, every, "P3", ["R2"]).collect() if r.blocked} == {"b"}
    assert fnd.gate_rows(f, "P1").count() == 2


def test_diff(findings):
    old = findings(("a", "S1", "x", 1, "old"), ("a", "S2", "x", 1), ("b", "S1", "x", 1))
    new = findings(("a", "S1", "x", 1, "new"), ("a", "S1", "y", 1), ("a", "S1", "y", 1))
    assert {r.confidence for r in fnd.run_diff(old, new).collect()} == {"CONFIRMED"}
    assert set(fnd.run_diff(old, new).columns) == {*FINDINGS.names, "status"}
    rows = {(r.repo, r.check_id, r.file): (r.status, r.snippet) for r in fnd.run_diff(old, new).collect()}
    assert rows == {("a", "S1", "x"): ("unchanged", "new"), ("a", "S2", "x"): ("fixed", "s"),
                    ("b", "S1", "x"): ("fixed", "s"), ("a", "S1", "y"): ("new", "s")}


def test_blocking_and_sections(findings):
    f = findings(*[("a", "S1", f"f{i}", 1) for i in range(7)], ("a", "T1", "z", 1),
                 ("a", "S2", "q", 1, "s", "SUSPECTED"))
    top = fnd.blocking_top(f).collect()
    assert len(top) == 5 and {r.more for r in top} == {2}
    table = fnd.audit_table(f).groupBy("part", "section").count().collect()
    assert {(r.part, r.section, r["count"]) for r in table} == {
        (1, "Blocking", 5), (2, "Secrets and settings", 2), (2, "Tests", 1), (3, "Suspected", 1)}
    assert fnd.finding_order(f).first().severity == "P0"


def test_report_tells_what_was_covered(spark, findings):
    coverage = spark.createDataFrame([("a", 4, 7, ["x (binary)"], ["n"], ["npm"]), ("b", 0, 0, [], [], [])],
                                     "repo string, scanned_files long, skipped_total long, skipped array<string>, "
                                     "notes array<string>, stack array<string>")
    rows = fnd.audit_table(findings(("a", "S1", "x", 1)), coverage=coverage).where("part = 4").collect()
    assert {(r.repo, r.snippet) for r in rows} == {
        ("a", "4 files and 48 checks"), ("a", "built with npm"), ("a", "n"),
        ("a", "7 files left out: x (binary), ..."), ("b", "0 files and 48 checks")}


def test_recall(findings):
    want = findings(("a", "S1", "x", 1), ("a", "S2", "x", 1), ("a", "S3", "x", 1))
    have = findings(("a", "S1", "y", 1), ("a", "S2", "x", 9), ("a", "H7", "x", 1), ("a", "D1", "x", 1))
    row = fnd.recall_precision(want, have, ("H7",)).first()
    assert (row.expected, row.hit, row.missed, row.unexpected) == (3, 2, 1, 1)
    assert row.recall == row.precision == 2 / 3
    assert {r.check_id: r.on_site for r in fnd.site_recall(want, have).collect()} == {
        "S1": False, "S2": True, "S3": False}


def test_sink_and_load(spark, findings, tmp_path):
    f = findings(("a", "S1", "x", 1, "  padded " + "y" * 300))
    for fmt in ("parquet", "json"):
        findings_io.write_findings(f, str(tmp_path / fmt), fmt)
        stored = spark.read.format(fmt).load(str(tmp_path / fmt)).first()
        assert (stored.schema_version, stored.severity, stored.fix_class, stored.domain) == (
            1, "P0", "manual", "S")
        back = findings_io.read_findings(spark, str(tmp_path / fmt), fmt)
        assert back.columns == FINDINGS.names and len(back.first().snippet) == 240
    bare = spark.createDataFrame([("a", "S1", "x", 1, "s")],
                                 "repo string, check_id string, file string, line int, snippet string")
    row = findings_io.findings_append(bare, f).where("snippet = 's'").first()
    assert (row.confidence, row.evidence) == ("SUSPECTED", "")
    with pytest.raises(Exception, match="unknown check"):
        findings_io.findings_sink(findings(("a", "Q9", "x", 1))).collect()


def test_stored_documents_and_logs(spark, tmp_path):
    import json
    (tmp_path / "docs").mkdir()
    document = {"schemaVersion": 1, "coverage": {"scanned_files": 3, "skipped": [], "notes": ["n"],
                                                 "stack": ["npm"]},
                "findings": [{"check_id": "S1", "file": "x", "line": 2, "snippet": "s",
                              "severity": "P0", "title": "t"}]}
    (tmp_path / "docs" / "app.json").write_text(json.dumps(document, indent=2))
    docs = findings_io.read_documents(spark, str(tmp_path / "docs"))
    assert tuple(findings_io.document_findings(docs).first()) == ("app", "S1", "x", 2, "s", "SUSPECTED", "")
    assert findings_io.document_coverage(docs).first().scanned_files == 3
    (tmp_path / "log.jsonl").write_text(
        '{"ok": true, "id": "a", "checks": ["S1"], "severity": {"P0": 1, "P1": 0, "P2": 0, "P3": 0},'
        ' "total": 1, "files": 2, "stack": [], "seconds": 1.5}\n{"ok": false, "reason": "clone-failed"}\n')
    row = study.corpus_summary(findings_io.read_runs(spark, str(tmp_path / "log.jsonl"))).first()
    assert (row.repos_scanned, row.repos_failed, row.median_seconds) == (1, 1, 1.5)


def test_notes_are_added_once(spark):
    old = spark.createDataFrame([("a", ["x", "y"])], "repo string, notes array<string>")
    new = spark.createDataFrame([("a", "y"), ("a", "z"), ("b", "w")], "repo string, note string")
    assert {r.repo: r.notes for r in findings_io.notes_append(old, new).collect()} == {
        "a": ["x", "y", "z"], "b": ["w"]}


# ---- study ------------------------------------------------------------------------------

@pytest.mark.parametrize("size", [1, 2, 3, 10, 501, 4000])
def test_median_is_exact(spark, size):
    random.seed(size)
    values = [random.choice([random.random(), 0.5, 7.0]) for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert study.exact_median(df, "x").first().median == statistics.median(values)


def test_medians_of_odd_values(spark):
    values = [1e-300, -1e300, 1e300, float("nan"), None, 0.0, 5e-324, 3.0, 3.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    kept = [v for v in values if v is not None and abs(v) < 1e308]
    assert study.exact_median(df, "x").first().median == statistics.median(kept)
    assert study.exact_median(df.where("x is null"), "x").first().median is None


def test_summary_reads_the_runs_a_few_times(spark):
    runs = spark.createDataFrame([(True, None, "a", [], (1, 0, 0, 0), 3, 2, [], 1.0)], REPO_RUNS)
    plan = study.corpus_summary(runs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 6 and "Window" not in plan


def test_study_figures(spark):
    def run(name, checks_, p0, total, stack, ok=True):
        return (ok, None if ok else "clone-failed", name, checks_,
                {"P0": p0, "P1": total - p0, "P2": 0, "P3": 0}, total, 10, stack, 1.0)
    runs = spark.createDataFrame(
        [run(f"n{i}", ["S1", "R2", "H1"], 1, 4, ["nextjs"]) for i in range(12)]
        + [run(f"q{i}", [], 0, 0, []) for i in range(3)] + [run("bad", [], 0, 0, [], False)], REPO_RUNS)
    shares = {r.check_id: r.pct for r in study.check_prevalence(runs).collect()}
    assert shares == {"S1": 80.0, "R2": 80.0}
    assert {r.domain for r in study.domain_prevalence(runs).collect()} == {"S", "R"}
    assert [r.check_id for r in study.critical_prevalence(runs).collect()] == ["S1"]
    row = study.corpus_summary(runs).first()
    assert (row.repos_attempted, row.repos_scanned, row.repos_failed) == (16, 15, 1)
    assert (row.median_findings, row.mean_findings, row.pct_with_p0) == (4.0, 3.2, 80.0)
    segments = study.segment_report(runs).collect()
    assert {(r.tag, r.repos, r.check_id) for r in segments} == {("nextjs", 12, "S1"), ("nextjs", 12, "R2")}
    assert study.failure_reasons(runs).first().repos == 1


def test_sample_is_repeatable_and_bounded(spark, findings):
    f = findings(*[(f"r{i}", "S1", f"f{j}", 1) for i in range(30) for j in range(5)])
    every = f.select("repo")
    first = study.stratified_sample(f, every, 10, 7, seed=1).collect()
    again = study.stratified_sample(f.repartition(5), every, 10, 7, seed=1).collect()
    assert len(first) == 7 and sorted(map(tuple, first)) == sorted(map(tuple, again))
    assert sorted(map(tuple, first)) != sorted(
        map(tuple, study.stratified_sample(f, every, 10, 7, seed=2).collect()))


def test_a_run_leaves_nothing_behind(spark, make_files, tmp_path):
    files = make_files({"a": {"package.json": "{}", "src/a.ts": "fetch(u)\n" * 40}})
    with Workspace(spark) as run:
        found = audit.findings_all(files, files).collect()
        folder = Path(run.folder.removeprefix("file:"))
        assert found and any(folder.iterdir())
    assert not folder.exists() and workspace(spark) is not run


# ---- joins, audit, streaming ------------------------------------------------------------

def test_sized_join_has_another_way(spark):
    left = spark.range(100).selectExpr("id % 10 as k", "id")
    right = spark.range(10).selectExpr("id as k", "id * 2 as v")
    small = sized_join(left, right, "k")
    large = sized_join(left, right, "k", max_rows=3)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert "Broadcast" in small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()


PLANTED = {
    "package.json": '{"dependencies": {"next": "1", "@supabase/supabase-js": "2"}}',
    ".env": "A=1", "next.config.js": "productionBrowserSourceMaps: true",
    "supabase/m/1.sql": "create table t (id int, a int);\ncreate policy p on t for all using (true);\n"
                        "insert into storage.buckets values ('x', true);",
    "src/app/page.tsx": "import x from './lib'\nsetInterval(f, 100)\nq.select('*')",
    "src/app/lib.ts": "console.log('k', apiKey)\nconsole.log(1)\nprocess.env.SOME_KEY",
    "src/app/api/x/route.ts": "const r = await fetch(u)\nclient.from('t').eq('a', 1)\n// TODO x",
    "src/lib/dead.ts": "try {} catch (e) {}", "src/lib/dead-old.ts": "redirect(req.query.to)",
}


def test_audit_of_a_planted_tree(make_files):
    files = make_files(PLANTED)
    found = audit.findings_all(files, files).collect()
    assert {r.check_id for r in found} >= {
        "S3", "S5", "S6", "D1", "D2", "D4", "R1", "R2", "R3", "R5", "C2", "C3", "C5", "O1", "O3",
        "O4", "O5", "H2", "H3", "H5", "P3", "T1", "T3", "X2", "X3"}
    console = [r for r in found if r.check_id == "O3"]
    assert [(r.line, r.snippet) for r in console] == [(1, "2 console calls in one file")]


def test_audit_is_the_same_beside_other_repositories(spark, make_files):
    noise = {f"n{i}": {f"src/{j}.ts": "fetch(u)\n" for j in range(6)} for i in range(5)}
    one, many = make_files({"p": PLANTED}), make_files({"p": PLANTED, **noise}).repartition(7)
    alone = audit.findings_all(one, one)
    among = audit.findings_all(many, many).where("repo = 'p'")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, among.collect()))


def test_a_lockfile_counts_though_it_is_ignored(make_files):
    listed = make_files({"a": {"package.json": "{}", "yarn.lock": ""}, "b": {"package.json": "{}"}})
    found = audit.findings_all(tree.path_ignore(listed), listed).where("check_id = 'P3'").collect()
    assert [r.repo for r in found] == ["b"]


def test_unscanned_files_count_by_their_paths(make_files):
    listed = make_files({"a": {".github/workflows/ci.yml": "", "keys/x.pem": "", "tests/test_a.py": "", "b.py": "",
                               "node_modules/y.pem": ""}})
    found = audit.findings_all(listed.where("rel = 'b.py'"), listed).collect()
    assert {(r.check_id, r.file) for r in found if r.check_id in ("S3", "T3", "T1")} == {("S3", "keys/x.pem")}


def test_coverage_notes(spark, make_files):
    files = make_files({"a": {"x.py": "1"}, "b": {".gitignore": "", "web.tsx": ""}, "c": {"package-lock.json": "{"}})
    commits = spark.createDataFrame([("a", "1", True), ("b", None, False)],
                                    "repo string, commit_id string, shallow boolean")
    facts = audit.corpus_facts(files)
    notes = {(r.repo, r.note.split(":")[0]) for r in audit.coverage_notes(facts, files, commits).collect()}
    assert ("a", "serves no web pages") in notes and ("b", "serves no web pages") not in notes
    assert ("a", "there is no ignore file") in notes and ("b", "there is no ignore file") not in notes
    assert ("c", "package-lock.json cannot be parsed") in notes
    assert {("a", "shallow copy"), ("a", "history"), ("b", "the history cannot be read"),
            ("c", "not under version control")} <= notes


def test_stream_equals_batch_and_survives_a_repeat(spark, make_files, tmp_path):
    files = make_files({f"r{i}": {"a.ts": f"fetch(u{i})\nredirect(req.query.x)"} for i in range(9)})
    want = sorted(map(tuple, rule_scan(files).collect()))
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    files.where("repo < 'r5'").repartition(3).write.parquet(inbox)

    def drain(state):
        rescan.stream_rule_scan(
            rescan.read_batches(spark, inbox, 1), out, str(tmp_path / state)).awaitTermination()
        return sorted(map(tuple, rescan.stored(spark, out).collect()))

    assert len(drain("s1")) == 10
    files.where("repo >= 'r5'").repartition(2).write.mode("append").parquet(inbox)
    assert drain("s1") == want
    assert drain("s2") == want


@pytest.mark.parametrize("settle", [200_000, 2])
def test_medians_of_any_magnitude_in_three_jobs(spark, monkeypatch, settle):
    monkeypatch.setattr(study, "SETTLE", settle)
    pick = random.Random(settle)
    shapes = {
        "far": [10.0 ** pick.uniform(-300, 300) * pick.choice([1, -1]) for _ in range(4001)],
        "even": [pick.gauss(0, 1) for _ in range(4000)],
        "ties": [1.0] * 1500 + [2.0] * 2000 + [pick.uniform(1, 2) for _ in range(500)],
        "halves": [1.0] * 2000 + [7.0] * 2000,
        "few": [3.0, 1.0], "none": [],
    }
    rows = [tuple(values[i] if i < len(values) else None for values in shapes.values()) for i in range(4001)]
    df = spark.createDataFrame(rows, ", ".join(f"`{name}` double" for name in shapes)).repartition(5)
    jobs = []
    first = type(df).first
    monkeypatch.setattr(type(df), "first", lambda self: jobs.append(1) or first(self))
    got = study.exact_medians(df, {name: f"`{name}`" for name in shapes})
    assert got == {name: statistics.median(values) if values else None for name, values in shapes.items()}
    assert len(jobs) == 1 if settle > 1000 else 2 <= len(jobs) <= 7  # besides writing and settling


def test_stream_state_is_bounded(spark, make_files, tmp_path):
    """Keys older than the horizon leave the state, and a key that comes back is stored again."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(lo, hi, state, horizon):
        make_files({f"r{i}": {"a.ts": f"fetch(u{i})\nredirect(req.query.x)"} for i in range(lo, hi)}).coalesce(
            1).write.mode("append").parquet(inbox)
        running = rescan.stream_rule_scan(rescan.read_batches(spark, inbox), out, str(tmp_path / state), horizon=horizon)
        running.awaitTermination()
        return running.recentProgress[-1].stateOperators[0].numRowsTotal

    short = [arrive(5 * k, 5 * k + 5, "short", "1 millisecond") for k in range(4)]
    assert max(short) <= 20  # the keys of one or two batches, of 40 in all
    assert arrive(0, 5, "short", "1 millisecond") <= 20
    assert rescan.stored(spark, out).count() == 40
    raw = spark.read.parquet(f"{out}/run=*/batch=*")
    assert raw.count() == 50  # the last batch was stored once more, and counts once
    long = arrive(20, 25, "long", "1 day")
    assert long == 50 and rescan.stored(spark, out).count() == 50


def test_stream_repeats_within_the_horizon_store_nothing(spark, make_files, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    files = make_files({"a.ts": "fetch(u)\nredirect(req.query.x)"})
    for _ in range(3):
        files.write.mode("append").parquet(inbox)
        rescan.stream_rule_scan(rescan.read_batches(spark, inbox), out, str(tmp_path / "s")).awaitTermination()
    assert spark.read.parquet(f"{out}/run=*/batch=*").count() == rule_scan(files).count() == 2


def test_stream_scans_files_that_come_late(spark, make_files, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    for rel, age in (("new.ts", 0), ("old.ts", 90 * 86_400)):
        before = set(inbox.glob("*.parquet"))
        make_files({rel: "fetch(u)"}).coalesce(1).write.mode("append").parquet(str(inbox))
        for part in set(inbox.glob("*.parquet")) - before:
            os.utime(part, (time.time() - age, time.time() - age))
        rescan.stream_rule_scan(rescan.read_batches(spark, str(inbox)), out, str(tmp_path / "s"),
                                horizon="1 second").awaitTermination()
    assert {r.file for r in rescan.stored(spark, out).collect()} == {"new.ts", "old.ts"}


def test_a_replay_makes_batches_by_bytes(spark, make_files, monkeypatch):
    started, start = [], rescan.stream_rule_scan
    monkeypatch.setattr(rescan, "stream_rule_scan", lambda *given: started.append(start(*given)) or started[-1])
    files = make_files({f"r{i}": {"a.ts": f"fetch(u{i})\nredirect(req.query.x)"} for i in range(30)})
    want = sorted(map(tuple, rule_scan(files).collect()))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    with settings(spark, {"spark.sql.shuffle.partitions": 64}):
        for parts, batch_bytes, batches in ((30, rescan.BATCH_BYTES, 1), (3, 1, 3)):
            found = rescan.replay(files.repartition(parts), batch_bytes=batch_bytes)
            assert sorted(map(tuple, found.collect())) == want
            told = started[-1].recentProgress
            assert sum(t.numInputRows > 0 for t in told) == batches
            assert told[0].stateOperators[0].numShufflePartitions == 12  # three a core, of four
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    assert spark.conf.get("spark.sql.shuffle.partitions") == held


def test_a_batch_reads_no_stored_findings(spark, make_files, tmp_path):
    stream = rescan.new_findings(rescan.read_batches(spark, str(tmp_path)))
    assert stream.isStreaming
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert plan.count("StreamingRelation") == 1 and "Join" not in plan
