import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from corpuswarden.llm import url_filter as uf

URLS = ["http://a.com/x", "HTTPS://WWW.Example.COM/en/1", "http://example.com/en/2", "http://example.com/EN/2",
        "http://shop.example.com/en/", "http://com/", "http://com", "http://notcom/", "http://a.net/es/1",
        "http://a.net/fr/1?x=/es/", "http://a.net/de/#/fr/", "http://net/fr/", "a.com/x", "://", "", None,
        "http://a.com?x=1", "http://a.com#y", "x://y://a.com/", "http://é.COM/ñ?", "http://a.com/x", "😀://😀.com/😀",
        "http://" + "b." * 3000 + "com/" + "c" * 5000, "http://line\nbreak.com/\n"]


def brute_parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def brute_rule(host, path):
    fits = []
    for verdict, rule in uf.RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def pages_of(spark, urls):
    rows = [u if isinstance(u, tuple) else (k, u) for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string").selectExpr(
        "*", "'h' as host", "1 as gram", "2 as id", "3 as yes", "'t' as rule", "4 as score")


def some_urls(n, seed=0):
    pick = random.Random(seed)
    return ["http://{}{}.example.{}/{}/{}".format(
        pick.choice(["www.", "m.", "blog.", ""]), pick.choice(["good", "fine", "casino", "ads"]),
        pick.choice(["com", "net", "org"]), pick.choice(["en", "es", "fr", "de"]), pick.randrange(300))
        for _ in range(n)]


def duck(rows):
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    return con.sql(uf.ORACLE).fetchall()


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda row: [str(value) for value in row])


def test_rules_and_parts(spark):
    got = uf.report(pages_of(spark, URLS)).collect()
    assert len(got) == len(URLS)
    for row in got:
        host, path = brute_parts(URLS[row.page_id])
        rule, verdict = brute_rule(host, path)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict in ({verdict} if verdict else {"allow", "block"})


def test_equals_sql(spark, monkeypatch):
    rows = list(enumerate([u for u in URLS if u is None or len(u) < 99] + some_urls(600))) + [
        (None, "http://a.com/x"), (3, "http://fine.example.org/es/7"), (3, "http://fine.example.org/es/7")]
    expected = ordered(duck(rows))
    assert ordered(uf.report(pages_of(spark, rows)).collect()) == expected
    monkeypatch.setattr(uf, "BROADCAST_GRAMS", 0)
    assert ordered(uf.report(pages_of(spark, rows)).collect()) == expected


def test_model_matches_brute_force(spark):
    urls = [(u, 1 + k % 2, k % 3) for k, u in enumerate(sorted(set(some_urls(60, 2))))]
    for order in (0, 2):
        counts = [Counter(), Counter()]
        for url, *both in urls:
            padded = "\x02" * order + url + "\x03"
            for i in range(len(url) + 1):
                for side in (0, 1):
                    counts[side][padded[i:i + order + 1]] += both[side]
        alphabet = {gram[-1] for gram in counts[0]}
        # For every order the counts of (context, character), from which each model is smoothed.
        tables = [[defaultdict(Counter) for _ in range(order + 1)] for _ in (0, 1)]
        for side in (0, 1):
            for gram, n in counts[side].items():
                for k in range(order + 1):
                    tables[side][k][gram[order - k:order]][gram[-1]] += n

        def chance(side, gram):
            p = 1 / len(alphabet)
            for k in range(order + 1):
                after = tables[side][k][gram[order - k:order]]
                total, kinds = sum(after.values()), sum(n > 0 for n in after.values())
                p = (after[gram[-1]] + kinds * p) / (total + kinds) if total else p
            return p

        got = {r.gram: r.gain for r in uf.model(
            spark.createDataFrame(urls, "url string, yes long, no long"), order).collect()}
        assert set(got) == set(counts[0])
        for gram, gain in got.items():
            assert gain == pytest.approx(1e6 * math.log(chance(0, gram) / chance(1, gram)), abs=1.01)


def test_unseen_urls_follow_their_likes(spark):
    """Hosts ending in .org have no rule; the words in them decide."""
    pick = random.Random(5)
    good = ["http://{}{}.com/{}".format(pick.choice(["garden", "bread", "river"]), pick.randrange(99), k) for k in range(200)]
    bad = ["http://{}{}.net/es/{}".format(pick.choice(["casino", "xxxads", "jackpot"]), pick.randrange(99), k) for k in range(200)]
    new = ["http://garden7.org/q", "http://bread55.org/q", "http://casino7.org/q", "http://jackpot3.org/q"]
    rows = uf.judge(pages_of(spark, good + bad + new)).where("id >= 400").orderBy("id").collect()
    assert [row.verdict for row in rows] == ["allow", "allow", "block", "block"]


def test_empty_and_one_sided_tables(spark):
    assert uf.report(pages_of(spark, [])).collect() == []
    only = uf.report(pages_of(spark, ["http://a.org/", "http://b.org/"])).collect()
    assert {(row.score, row.verdict) for row in only} == {(0, "allow")}
