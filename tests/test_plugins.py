"""A caller's rule and check come out of the whole audit; bad ones are refused."""

import pytest
from pyspark.sql import functions as F

from corpuswarden import catalog
from corpuswarden.operators import findings as fnd
from corpuswarden.plans import audit, plugins
from corpuswarden.plans.facts import fact, when
from corpuswarden.plans.plugins import Check, Plugin, PluginError, plugged
from corpuswarden.plans.rulebook import RULES, Rule
from corpuswarden.plans.scan import findings_row, rule_scan
from corpuswarden.plans.store import FactStore
from corpuswarden.sources import findings_io

RULE = Rule("Z1", r"legacyCall\(", ("legacyCall(",), suffixes=(".ts",))


def long_probe(c):
    return when(f"length({c.text}) > 40", f"array({fact('local', repr('Z2'), line='1', snippet=repr('long'))}, "
                                          f"{fact('house.long', 'length(_text)')})")


def several_long(facts, paths):
    return facts.where("kind = 'house.long'").groupBy("repo").agg(
        F.count("*").alias("n"), F.min("rel").alias("rel")).where("n > 1").select(
        *findings_row("'Z3'", "rel", "1", "concat(n, ' long files')", "CONFIRMED"))


HOUSE = Plugin("house", (Check("Z1", "P1", "auto", "Old call", "It goes.", "Use the new one.", domain="House"),
                         Check("Z2", "P3", "manual", "Long"), Check("Z3", "P0", "manual", "Many long")),
               rules=(RULE,), probes=(long_probe,), operators=(several_long,))


def files_of(make_files):
    return make_files({"a": {"x.ts": "legacyCall(1)\n" + "y" * 50, "y.ts": "z" * 60, "x.py": "legacyCall(1)"},
                       "b": {"x.ts": "a\nlegacyCall(2)"}})


def test_findings_of_a_plugin(spark, make_files, tmp_path):
    files, before = files_of(make_files), (list(catalog.CHECKS), list(RULES), dict(catalog.DOMAINS))
    paths = files.select("repo", "rel")
    plain = sorted(map(str, audit.findings_all(files, paths).collect()))
    with plugged(spark, HOUSE):
        found = audit.findings_all(files, paths)
        scanned = rule_scan(files, ["Z1"])
        counts = {r.repo: r.P0 for r in fnd.severity_counts(found).collect()}
        blocked = fnd.gate(found, paths.select("repo").distinct(), "P0").collect()
        stored = findings_io.findings_sink(found).where("check_id = 'Z1'").collect()
        store = FactStore(spark, str(tmp_path))
    assert FactStore(spark, str(tmp_path)).path != store.path
    assert (catalog.CHECKS, RULES, catalog.DOMAINS) == before
    own = sorted((r.repo, r.check_id, r.file, r.line, r.confidence) for r in found.where("check_id like 'Z%'").collect())
    assert own == [("a", "Z1", "x.ts", 1, "SUSPECTED"), ("a", "Z2", "x.ts", 1, "SUSPECTED"),
                   ("a", "Z2", "y.ts", 1, "SUSPECTED"), ("a", "Z3", "x.ts", 1, "CONFIRMED"),
                   ("b", "Z1", "x.ts", 2, "SUSPECTED")]
    assert sorted(map(str, found.where("check_id not like 'Z%'").collect())) == plain
    assert scanned.count() == 2 and counts["a"] == 1 and len(blocked) == 2
    assert {(r.title, r.severity, r.domain) for r in stored} == {("Old call", "P1", "Z")}
    assert sorted(map(str, audit.findings_all(files, paths).collect())) == plain


def check(**changes):
    return Check(**{"id": "Z1", "severity": "P1", "fix_class": "auto", "title": "t", "domain": "House"} | changes)


BAD = {
    "taken": Plugin("p", (check(id="S1"),)),
    "twice": Plugin("p", (check(), check())),
    "capital letter": Plugin("p", (check(id="zz"),)),
    "severity": Plugin("p", (check(severity="P9"),)),
    "fix class": Plugin("p", (check(fix_class="never"),)),
    "domain": Plugin("p", (check(domain=""),)),
    "without a check": Plugin("p", (check(),), rules=(Rule("Z9", "a", ("a",)),)),
    "literals": Plugin("p", (check(),), rules=(Rule("Z1", "a", ()),)),
    "lower case": Plugin("p", (check(),), rules=(Rule("Z1", "(?i)a", ("A",), fold=True),)),
    "pattern": Plugin("p", (check(),), rules=(Rule("Z1", "a(", ("a",)),)),
    "probes": Plugin("p", (check(),), probes=(lambda c: "nothing(" + c.text + ")",)),
    "columns of a finding": Plugin("p", (check(),), operators=(lambda facts, paths: facts,)),
}


@pytest.mark.parametrize("said", BAD)
def test_bad_plugins_are_refused(spark, said):
    before = list(catalog.CHECKS), list(RULES)
    with pytest.raises(PluginError, match="taken" if said == "twice" else said.replace("fix class", "severity or fix class")):
        with plugged(spark, BAD[said]):
            pass
    assert (catalog.CHECKS, RULES) == before


def test_slow_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(plugins, "TRIAL_SECONDS", 0.3)
    slow = Rule("Z1", r"open\([^)]*\)\s*end", ("open(",))
    with pytest.raises(PluginError, match="grows faster"):
        plugins.validate(spark, Plugin("p", (check(),), rules=(slow,)))
    fast = Rule("Z1", r"open\([^)]*+\)\s*+end", ("open(",), skip_over=r"open\([^)]*+(?:\)|\z)")
    plugins.validate(spark, Plugin("p", (check(),), rules=(fast,)))


def test_plugins_nest(spark, make_files):
    other = Plugin("other", (check(id="Y1", domain="Other"),), rules=(Rule("Y1", "z{9}", ("zzz",)),))
    with plugged(spark, HOUSE), plugged(spark, other):
        found = rule_scan(files_of(make_files))
    assert {r.check_id for r in found.collect()} >= {"Z1", "Y1"}
    assert "Y" not in catalog.DOMAINS and "Z" not in catalog.DOMAINS
