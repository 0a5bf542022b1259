"""A second scan reads what changed and finds what a whole audit finds."""

import random
import zipfile

import pytest

from corpuswarden.plans import audit, store as stores
from corpuswarden.plans.rulebook import RULES
from corpuswarden.plans.store import FactStore, digests
from corpuswarden.session import settings
from corpuswarden.sources import archives, tree


def tree_of(n, seed=0):
    pick = random.Random(seed)
    lines = ['api_key = "a8f5f167f44f4964e6c998dee827110c"', "fetch(u)", "console.log(token)", "import './f3'",
             "create table t1 (id int);", "x = 1", "const u = process.env.VAR_ONE", 'q.from("t1").eq("owner", 1)']
    files = {f"r{k % 3}": {} for k in range(3)}
    for k in range(n):
        rel = f"src/f{k}.{pick.choice(['ts', 'py', 'sql'])}"
        files[f"r{k % 3}"][rel] = "\n".join(pick.choices(lines, k=6)) + f"\n// {k}"
    block = "\n".join(f"const repeated{i} = compute(something, other{i});" for i in range(4))
    for k in range(4):
        files["r0"][f"lib/c{k}.ts"] = block
    files["r1"]["package.json"] = '{"dependencies":{"@supabase/supabase-js":"2"}}'
    return files


class Counting:
    """A loader that remembers which texts it was asked for."""

    def __init__(self, files):
        self.files, self.asked = files, []

    def __call__(self, wanted):
        self.asked.append(sorted(map(tuple, wanted.collect())))
        return self.files.join(wanted, ["repo", "rel"], "left_semi")


def rows(df):
    return sorted(map(str, df.collect()))


def test_only_changes_are_read(spark, make_files, tmp_path):
    now = tree_of(60)
    store = FactStore(spark, str(tmp_path / "store"))

    def check(expected_changes, compact=False):
        files = make_files(now)
        paths, load = files.select("repo", "rel"), Counting(files)
        store.update(digests(files), load)
        assert load.asked == [sorted(expected_changes)]
        assert rows(store.facts()) == rows(audit.extract(files, *audit.PROBES))
        if compact:
            store.compact()
            assert len(store.generations()) == 1
        found = store.findings(paths, load)
        assert rows(found) == rows(audit.findings_all(files, paths))
        assert len(load.asked) == 2 and len(load.asked[1]) <= 12  # sites of the blocks that repeat most
        return found.count()

    check([(repo, rel) for repo in now for rel in now[repo]])
    check([])
    old = now["r2"]["src/f5.py" if "src/f5.py" in now["r2"] else next(iter(now["r2"]))]
    changed = next(iter(now["r2"]))
    before = now["r2"][changed]
    now["r2"][changed] = 'token = "Zx9-Qw7-8fK2-mN4pLs"\nfetch(a)'
    gone = list(now["r1"])[2]
    del now["r1"][gone]
    now["r0"]["src/new.ts"] = "redirect(req.query.to)"
    check([("r2", changed), ("r0", "src/new.ts")])
    now["r2"][changed] = before  # a version that comes back is known
    now["r1"]["moved/" + gone] = old
    check([("r1", "moved/" + gone)], compact=True)
    now["r0"]["src/last.ts"] = "fetch(b)"
    check([("r0", "src/last.ts")])


def test_an_update_that_broke_off_is_made_again(spark, make_files, tmp_path):
    files = make_files(tree_of(9))
    store = FactStore(spark, str(tmp_path / "store"))

    def broken(wanted):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.update(digests(files), broken)
    assert store.generations() == []
    assert store.update(digests(files), Counting(files)) == 0
    assert rows(store.facts()) == rows(audit.extract(files, *audit.PROBES))


def test_other_probes_are_another_store(spark, make_files, tmp_path, monkeypatch):
    files = make_files({"a.ts": "fetch(u)"})
    first = FactStore(spark, str(tmp_path))
    first.update(digests(files), Counting(files))
    monkeypatch.setitem(RULES[0].__dict__, "pattern", "AKIA[0-9]{16}")
    second = FactStore(spark, str(tmp_path))
    assert second.path != first.path and second.generations() == []
    load = Counting(files)
    second.update(digests(files), load)
    assert load.asked == [[("r", "a.ts")]]


def test_no_files(spark, make_files, tmp_path):
    store = FactStore(spark, str(tmp_path))
    empty = make_files({"a.ts": "x"}).where("false")
    assert store.update(digests(empty), Counting(empty)) == 0
    assert store.facts().collect() == [] and store.changed(digests(empty)).collect() == []


def test_archives_tell_what_changed_without_being_read(spark, tmp_path):
    root, store = tmp_path / "corpus", FactStore(spark, str(tmp_path / "store"))
    files = {f"src/f{k}.ts": f"fetch(u{k})".encode() for k in range(20)}

    def pack():
        root.mkdir(exist_ok=True)
        with zipfile.ZipFile(root / "a.zip", "w", zipfile.ZIP_DEFLATED) as held:
            for name, data in files.items():
                held.writestr(name, data)

    def update():
        held = archives.list_archives(spark, str(root))
        index = archives.member_index(held)
        asked = []

        def load(wanted):
            asked.extend(r.rel for r in wanted.collect())
            return tree.ingest_files(archives.read_members(index.join(wanted, ["repo", "rel"], "left_semi")))

        store.update(archives.listing(index, held), load)
        return sorted(asked)

    pack()
    assert len(update()) == 20
    files["src/f3.ts"], files["src/new.ts"] = b"fetch(w3)", b"redirect(req.query.x)"
    del files["src/f9.ts"]
    pack()
    assert update() == ["src/f3.ts", "src/new.ts"]
    assert {r.rel for r in store.facts().where("kind = 'rule'").collect()} == set(files)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_stored_facts_stay_where_they_lie(spark, make_files, tmp_path, monkeypatch, most):
    monkeypatch.setattr(stores, "BROADCAST_ROWS", most)
    now, store = tree_of(30), FactStore(spark, str(tmp_path / "store"))
    written = []
    monkeypatch.setattr(stores, "write_once", lambda df, partition_by=None, write=stores.write_once: (
        written.append(df.count()) if partition_by else None) or write(df, partition_by))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": -1}):  # as with large tables
        for _ in range(2):
            files = make_files(now).unionByName(spark.createDataFrame(
                [("r0", "src/none.ts", None), (None, "src/x.ts", "fetch(u)")], "repo string, rel string, text string"))

            def load(wanted):
                return files.join(wanted, ["repo", "rel"], "left_semi")

            store.update(digests(files), load)
            now["r2"][next(iter(now["r2"]))] = "fetch(a)"
            del now["r0"][next(iter(now["r0"]))]
        facts = store.facts()
        named, read = files.select("repo", "rel").where("repo is not null"), files.where("repo is not null and text is not null")
        assert rows(facts) == rows(audit.extract(read, *audit.PROBES))
        plan = facts._jdf.queryExecution().sparkPlan().toString()
        assert ("SortMergeJoin" in plan) == (most == 0) and ("BroadcastHashJoin" in plan) == (most > 0)
        found = store.findings(named, load)
        assert rows(found) == rows(audit.findings_all(read, named))
    paths = audit.path_facts(named).count()
    assert written == [paths if most else paths + facts.count()]
