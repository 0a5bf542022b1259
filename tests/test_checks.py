"""Checks over several files, on small trees."""

from corpuswarden.operators import (
    config_checks as config, dependency_checks as deps, history_checks as history,
    project_checks as project, schema_checks as schema, structure,
)
from corpuswarden.plans import audit
from corpuswarden.plans.facts import extract


def facts(files):
    return audit.corpus_facts(files)


def shown(df):
    return sorted((r.repo, r.file, r.line) for r in df.collect())


def test_row_security(make_files):
    found = schema.rls_missing(facts(make_files({
        "open": {"supabase/m/1.sql": "create table public.a (id int);\ncreate table b (id int);",
                 "supabase/m/2.sql": "create table a (id int);\n"
                                     "alter table b enable row level security;"},
        "plain": {"db/1.sql": "create table a (id int);"},
        "tests": {"supabase/x.md": "", "tests/1.sql": "create table a (id int);"},
        "managed": {"supabase/1.sql": 'create table auth.users (id int); create table _x (id int);'},
    })))
    assert shown(found) == [("open", "supabase/m/2.sql", 1)]


def test_policies_and_buckets(make_files):
    f = facts(make_files({"supabase/1.sql":
        "create policy p on t for all using (true);\n"
        "create policy q on t for select using (true);\n"
        "insert into storage.buckets (id, public) values ('x', true);"}))
    assert shown(schema.permissive_policy(f)) == [("r", "supabase/1.sql", 1)]
    assert shown(schema.public_bucket(f)) == [("r", "supabase/1.sql", 3)]


def test_unindexed_columns(make_files):
    f = facts(make_files({
        "db/1.sql": "create table t (id int, a int, b int);\ncreate index i on t (a, \"c\");",
        "src/q.ts": "\nx.from('t').select('z').eq('a', 1)\n  .eq('b', 2).order('c').gt('id', 3)",
        "src/o.ts": ".from('other').eq('b', 1)",
    }))
    rows = schema.unindexed_filter(f).collect()
    assert [(r.file, r.line, r.snippet) for r in rows] == [
        ("src/q.ts", 2, "no index on t.b, which queries filter or sort by")]


def test_a_very_long_call_chain_is_read_to_its_end(make_files):
    chain = ".from('t')" + ".eq('id', 1)" * 20_000 + ".eq('last', 1)"
    f = facts(make_files({"db/1.sql": "create table t (id int);", "src/q.ts": "x" + chain}))
    assert [r.snippet for r in schema.unindexed_filter(f).collect()] == [
        "no index on t.last, which queries filter or sort by"]


def test_a_from_call_inside_a_chain_is_a_link(make_files):
    f = facts(make_files({"db/1.sql": "create table a (id int); create table b (id int);",
                          "q.ts": "x.from('a').from('b').eq('c', 1)\nfrom.from('b').lt('d', 1)"}))
    assert sorted(r.snippet for r in schema.unindexed_filter(f).collect()) == [
        "no index on a.c, which queries filter or sort by", "no index on b.d, which queries filter or sort by"]


def test_open_rules(make_files):
    f = facts(make_files({"x.rules": "a {\n\n  allow read, write: if true;\n}"}))
    assert shown(config.open_rules(f)) == [("r", "x.rules", 3)]


def test_secret_files(make_files):
    f = facts(make_files({
        "bare": {".env": "A=1", "tests/.env": "A=1"},
        "equal": {".env": "A=1", ".gitignore": "# x\n.env\n"},
        "glob": {"k/a.pem": "", ".gitignore": "*.pem"},
        "literal": {".env": "A=1", ".gitignore": ".env*\n/.env"},
        "comment": {".env": "A=1", ".gitignore": "#.env"},
    }))
    assert [r[0] for r in shown(config.secret_file_unignored(f))] == ["bare", "comment", "literal"]


def test_settings(make_files):
    f = facts(make_files({
        ".env.example": "KNOWN_KEY=\n  OTHER_KEY = 1",
        "src/b.ts": "x\nprocess.env.FIRST_KEY + process.env.SECOND_KEY",
        "src/a.ts": "process.env.KNOWN_KEY\nprocess.env.SECOND_KEY; process.env.NODE_ENV",
        "a.py": "os.getenv('OTHER_KEY'); os.environ.get(\"PY_KEY\")",
        "tests/a.ts": "process.env.TEST_KEY",
    }))
    rows = {r.snippet.split()[0]: (r.file, r.line) for r in config.env_undocumented(f).collect()}
    assert rows == {"FIRST_KEY": ("src/b.ts", 2), "SECOND_KEY": ("src/a.ts", 2),
                    "PY_KEY": ("a.py", 1)}
    assert config.missing_example_notes(f).count() == 0


def test_source_maps_and_debug(make_files):
    f = facts(make_files({"next.config.js": "a\nsourcemap: true\nsourcemap: true",
                          "a.yml": "x: 1\n\n  debug: true\nDEBUG: true", "example.yml": "debug: true"}))
    assert shown(config.sourcemaps_on(f)) == [("r", "next.config.js", 2)]
    assert shown(config.debug_on(f)) == [("r", "a.yml", 3)]


def test_existence_checks(make_files):
    f = facts(make_files({
        "web": {"src/a.tsx": "x", "next.config.js": ""},
        "done": {"src/a.tsx": "<ErrorBoundary>", "vercel.json": '"X-Frame-Options"',
                 "b.ts": "import '@sentry/x'; get('/healthz')", ".github/workflows/c.yml": ""},
        "tool": {"lib/x.py": "1", "tests/test_x.py": ""},
    }))
    flags = project.repo_flags(f)
    assert shown(project.no_error_boundary(flags)) == [("web", "src", 1)]
    assert shown(project.no_headers(flags)) == [("web", "next.config.js", 1)]
    assert [r[0] for r in shown(project.no_tracker(flags))] == ["web"]
    assert [r[0] for r in shown(project.no_health(flags))] == ["web"]
    assert [r[0] for r in shown(project.no_ci(flags))] == ["tool", "web"]
    assert [r[0] for r in shown(project.no_tests(flags, f))] == ["done", "web"]


def test_test_scripts(make_files):
    def manifest(script):
        return '{"scripts": {"test": "%s"}}' % script
    f = facts(make_files({
        "good": {"package.json": manifest("vitest"), "a.test.ts": ""},
        "placeholder": {"package.json": manifest("echo 'no test specified' && exit 1"),
                        "a.test.ts": ""},
        "broken": {"package.json": "{", "a.test.ts": ""},
        "untested": {"package.json": manifest("vitest")},
    }))
    rows = {r.repo: r.snippet for r in project.no_tests(project.repo_flags(f), f).collect()}
    assert rows == {
        "placeholder": "tests are run by \"echo 'no test specified' && exit 1\", test files: some",
        "broken": "tests are run by '', test files: some",
        "untested": "tests are run by 'vitest', test files: none",
    }


def test_dependencies(spark, make_files):
    files = make_files({
        "package.json": '{"dependencies": {"recat": "1", "local": "file:../x", "both": "1"},'
                        '"optionalDependencies": {"@s/opt": "2"}}',
        "requirements.txt": "# c\n-r x\nboth>=1\n  reqeusts==2 \n",
        "pyproject.toml": 'name = "x"\nboth = "1"\nnumppy = ">=1"\n',
    })
    f = facts(files)
    declared = {(r.name, r.ecosystem) for r in deps.dependency_extract(f).collect()}
    assert declared == {("recat", "npm"), ("both", "pypi"), ("@s/opt", "npm"),
                        ("reqeusts", "pypi"), ("numppy", "pypi")}
    registry = spark.createDataFrame(
        [("npm", "recat"), ("pypi", "both"), ("pypi", "reqeusts"), ("pypi", "numppy")],
        "ecosystem string, name string")
    rows = sorted((r.check_id, r.file, r.snippet)
                  for r in audit.dependency_findings(f, registry).collect())
    assert rows == [
        ("P1", "package.json", "the npm registry has no package @s/opt"),
        ("P2", "package.json", "numppy differs by one edit from numpy"),
        ("P2", "package.json", "recat differs by one edit from react"),
        ("P2", "package.json", "reqeusts differs by one edit from requests"),
    ]


def test_near_names_against_brute_force(spark):
    from corpuswarden.functions import shapes
    words = ("react", "zod", "next", "uuid")

    def one_edit(a, b):
        if a == b:
            return False
        edits = {b[:i] + b[i + 1:] for i in range(len(b))}
        letters = set(a)
        edits |= {b[:i] + c + b[i + 1:] for i in range(len(b)) for c in letters}
        edits |= {b[:i] + c + b[i:] for i in range(len(b) + 1) for c in letters}
        edits |= {b[:i] + b[i + 1] + b[i] + b[i + 2:] for i in range(len(b) - 1)}
        return a in edits

    names = ["", "z", "zo", "od", "zd", "ozd", "zdo", "zod", "zood", "zodx", "recat", "raect",
             "eract", "reactt", "rect", "text", "nest", "nxet", "uid", "uuuid", "uudi", "newt"]
    df = spark.createDataFrame([(n,) for n in names], "name string").selectExpr(
        "name", f"{shapes.may_be_one_edit_from('name', words)} as likely",
        f"{shapes.one_edit_from('name', words)} as near")
    for row in df.collect():
        want = min((w for w in words if one_edit(row.name, w)), default=None)
        assert row.near == want, row
        assert row.likely or want is None


def test_lockfiles_and_install_scripts(make_files):
    files = make_files({
        "bare": {"requirements.txt": "", "package.json": "{}"},
        "locked": {"package.json": "{}", "package-lock.json":
                   '{"packages": {"": {"hasInstallScript": true}, "n/a": {"hasInstallScript": true},'
                   ' "n/b": {}}}'},
    })
    f = facts(files)
    assert shown(deps.no_lockfile(files)) == [("bare", "package.json", 1)]
    assert sorted(r.snippet for r in deps.install_script(f).collect()) == [
        "n/a executes code when installed", "root executes code when installed"]


def test_history(spark):
    repos = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "repo string")
    commits = spark.createDataFrame(
        [("a", "1", False), ("b", "1", True), ("c", "1", False), ("c", "2", False)],
        "repo string, commit_id string, shallow boolean")
    rows = {r.repo: r.snippet for r in history.history_depth(repos, commits).collect()}
    assert rows == {"a": "only 1 commit(s) in its history",
                    "d": "not under version control"}
    paths = spark.createDataFrame(
        [("a", p) for p in ("x/b.pem", "a c.pem", "vendor/z.pem", ".env", "sub/.env", "id_rsa")],
        "repo string, path string")
    assert sorted(r.file for r in history.secret_in_history(paths).collect()) == [
        ".env", "a c.pem", "id_rsa"]


def test_name_families(make_files):
    f = facts(make_files({"src/Cart.tsx": "", "src/Cart-final-v2.tsx": "", "src/Other.tsx": "",
                          "lib/Cart.tsx": "", "tests/a.ts": "", "tests/a-old.ts": "",
                          ".github/x.ts": "", "github/x2.ts": ""}))
    rows = sorted((r.file, r.snippet) for r in structure.name_families(f).collect())
    assert rows == [
        ("github/x2.ts", "looks like a copy of .github/x.ts (common name x)"),
        ("src/Cart-final-v2.tsx", "looks like a copy of src/Cart.tsx (common name cart)"),
    ]


def test_leftover_suffixes_go_one_by_one(make_files):
    f = facts(make_files({
        "a": {"src/test22.ts": "", "src/test.ts": ""}, "b": {"src/mytest22.ts": "", "src/mytest.ts": ""},
        "c": {"src/xtest2.ts": "", "src/x.ts": ""}, "d": {"src/final.ts": "", "src/old-copy.ts": ""}}))
    assert {r.repo: r.file for r in structure.name_families(f).collect()} == {
        "a": "src/test22.ts", "b": "src/mytest22.ts", "c": "src/xtest2.ts", "d": "src/old-copy.ts"}


def test_endings_are_as_many_as_lengths(spark):
    stems = spark.createDataFrame([("a", "x", "q" * 5000), ("a", "y", "ab"), ("b", "z", "abc")],
                                  "repo string, rel string, stem string")
    targets = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "xyz"), ("a", "k" * 40)],
                                    "repo string, ending string")
    rows = structure.endings(stems, targets).collect()
    assert sorted((r.repo, r.rel, len(r.ending)) for r in rows) == [
        ("a", "x", 1), ("a", "x", 3), ("a", "x", 40), ("a", "y", 1)]


def test_orphans(make_files):
    f = facts(make_files({
        "src/app/page.tsx": "import { a } from './used'\nimport b from '@/ui/button'\nimport '@/'",
        "src/app/used.ts": "", "src/ui/button.tsx": "", "src/dead.ts": "",
        "src/deep/x/y.ts": "require('../../lib/reached')", "lib/reached.js": "", "src/lib/reached.js": "",
        "tool.py": "if __name__ == '__main__':\n  run()", "pkg/mod.py": "", "main.py": "import pkg.mod",
        "tests/z.test.ts": "import '../src/covered'", "src/covered.ts": "",
        "src/suffixed.ts": "", "src/n.ts": "from 'fixed'",
    }))
    assert [r[1] for r in shown(structure.orphan_modules(f))] == [
        "lib/reached.js", "src/dead.ts", "src/deep/x/y.ts", "src/n.ts"]


def test_module_endings_match_at_any_character(make_files):
    f = facts(make_files({"src/a.ts": "import 'tton'", "src/button.ts": "", "src/b.ts": "x"}))
    assert [r[1] for r in shown(structure.orphan_modules(f))] == ["src/a.ts", "src/b.ts"]


def test_comment_runs(make_files):
    code = "// a = 1;\n" * 5
    f = facts(make_files({"a.ts": "x\n" + code + "y\n" + code + "# b()\n", "b.ts": "// words\n" * 9,
                          "c.ts": "// a = 1;\n" * 4, "tests/d.ts": code}))
    rows = sorted((r.file, r.line, r.snippet) for r in structure.comment_runs(f).collect())
    assert rows == [("a.ts", 2, "5 lines of commented-out code in a row"),
                    ("a.ts", 8, "6 lines of commented-out code in a row")]


def test_sizes(make_files):
    f = extract(make_files({"a.ts": "x\n" * 10, "b.ts": "x\n" * 10 + "x", "c.md": "x\n" * 99}),
                lambda c: structure.size_probe(c, 10))
    assert [(r.file, r.snippet) for r in structure.oversized_files(f).collect()] == [
        ("b.ts", "11 lines")]


def test_clones_against_brute_force(make_files):
    import random
    random.seed(5)
    pool = [f"line {i} of some shared code, padded a bit" for i in range(4)] + ["", "}"]
    files = {f"src/f{i}.ts": "\n".join(random.choices(pool, k=25)) + "\n" for i in range(12)}
    blocks = {}
    for rel, text in files.items():
        rows = text.splitlines()
        for i in range(len(rows) - 2):
            window = [" ".join(r.split()) for r in rows[i:i + 3]]
            if sum(map(len, window)) >= 60:
                blocks.setdefault("\n".join(window), []).append((rel, i + 1))
    repeated = {b: sorted(s) for b, s in blocks.items() if len(s) >= 3}
    worst = min(repeated, key=lambda b: (-len(repeated[b]), b))
    sites = repeated[worst]
    want = (f"the same block at {len(sites)} places ({', '.join(f'{r}:{n}' for r, n in sites[:3])})"
            f", besides {len(repeated) - 1} other blocks")
    row = structure.clone_blocks(make_files(files)).collect()
    assert [(r.file, r.line, r.snippet) for r in row] == [(*sites[0], want)]
