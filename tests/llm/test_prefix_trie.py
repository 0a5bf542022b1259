import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from corpuswarden.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
           "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, heads=True):
    """{conv_id: [(role, text)]} of the contract; equal turns by the digest, as documented."""
    def digest(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()

    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    own = {conv: [turn for _, turn in sorted(turns)] for conv, turns in own.items()}
    if not heads:
        return own
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        leader = conv - (conv % 20 if conv >= 0 else -(-conv % 20))
        out[conv] = own.get(leader, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(set)
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(conv)
    children, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        words = len([w for w in re.split("[\x20\x09-\x0D]+", node[-1][1]) if w]) if node else 0
        for d in range(len(node) + 1):
            below[node[:d]][0] += children[node] == 0
            below[node[:d]][1] += (len(who) - 1) * words
    rows = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(node))
        rows.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node],
                     *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return ordered(rows)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda row: [str(value) for value in row])


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "'k' as key", "1 as leader", "2 as turns", "3 as depth", "'w' as words", "4 as t")


def random_rows(n, seed, copies=0):
    pick, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(pick.choice([0, 1, 2, 3, 5, 9])):
            rows.append((conv * pick.choice([1, 1, 7]) % 500 - 40, pick.choice([turn, turn, None]),
                         pick.choice(["user", "assistant", None]), pick.choice(["a", "b c", "  d\te f\n", "", None])))
    for conv in range(copies):
        rows += [(1000 + conv, turn, "user", f"copy {turn}") for turn in range(6)]
    pick.shuffle(rows)
    return rows


ODD = [(None, 0, "user", "no id"), (-20, 0, "a", "x"), (-21, 0, "a", "y"), (-21, 1, "a", "z"), (7, 1, None, None),
       (7, 1, None, None), (7, None, "user", "first"), (20, 5, "", ""), (21, 0, "user", "only"),
       (2**62, 0, "user", "large"), (8, 0, "1:a", "b"), (9, 0, "1", ":ab")]


def deep(n):
    rows = [(5, turn, "user", f"w {turn % 3}") for turn in range(n)]
    return rows + [(c, turn, "user", f"w {turn % 3}") for c in (6, 7) for turn in range(n // c)]


@pytest.mark.parametrize("rows", [
    ODD, random_rows(300, 1), random_rows(120, 2, copies=90) + ODD, deep(700)], ids=["odd", "random", "copies", "deep"])
def test_report_matches_brute_force_and_sql(spark, rows):
    expected = brute(rebuilt(rows))
    assert ordered(pt.report(table(spark, rows)).select(COLUMNS).collect()) == expected
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = con.sql(f"select {', '.join(COLUMNS)} from ({pt.ORACLE})").fetchall()
    assert ordered(got) == expected


@pytest.mark.parametrize("per_shard", [1, 2, 7, 64])
def test_many_shards_make_the_same_trie(spark, per_shard):
    rows = random_rows(150, 3, copies=60) + ODD + deep(90)
    lists = pt.sequences(table(spark, rows))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = pt.nodes(lists, per_shard).select(COLUMNS).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ordered(got) == brute(rebuilt(rows, heads=False))


def test_end_lists_of_shards(spark):
    rows = random_rows(150, 4, copies=40)
    convs = rebuilt(rows, heads=False)
    parts = pt.shard_nodes(pt.sequences(table(spark, rows)), 16).collect()
    assert sorted(c for part in parts for c in part.ends) == sorted(convs)
    assert all(part.depth == len(convs[c]) for part in parts for c in part.ends)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(pt, "BROADCAST_EDGES", 0)
    rows = random_rows(80, 6) + ODD
    got = pt.nodes(pt.sequences(table(spark, rows)), 8).select(COLUMNS).collect()
    assert ordered(got) == brute(rebuilt(rows, heads=False))


def test_empty_table(spark):
    assert pt.report(table(spark, [])).collect() == []
    assert pt.report(table(spark, [(None, 0, "user", "x")])).collect() == []
