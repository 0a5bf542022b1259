import hashlib
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from corpuswarden.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[s:s + size]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for window, ids in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s:s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found |= {str(i) for i in ids if i is not None}
        out[doc] = (len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r[0]: tuple(r)[1:6] for r in dc.report(d, b).collect()}


LONG = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [(1, LONG.upper() + "!"), (2, f"x {LONG} y {LONG} z"), (3, None), (4, ""), (5, "short item"),
        (6, "ÉTÉ un deux " * 30), (7, "a. Short, ITEM b short item"), (8, "--- \n"),
        (9, "two three four five six seven eight nine ten")]
ITEMS = [(1, LONG), (2, LONG), (10, "Short item"), (None, "un deux ÉTÉ un deux ÉTÉ un deux ÉTÉ un"),
         (3, None), (4, "")]


def test_matches_brute_force(spark):
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=6),
       st.lists(st.lists(st.sampled_from("ab"), max_size=14), max_size=4))
def test_random_words(spark, docs, items):
    docs = [(k, " ".join(d)) for k, d in enumerate(docs)]
    items = [(k, " ".join(i)) for k, i in enumerate(items)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert run(spark, [], ITEMS) == {}
    assert {k: v[1] for k, v in run(spark, DOCS, []).items()} == {k: 0 for k, _ in DOCS}
    assert dc.remove_documents(docs_of([LONG]), none).count() == 1


def test_repeated_rows_and_long_text(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of([(1, LONG), (1, LONG), (1, "clean"), (2, "word " * 60_000 + LONG)])
    rows = sorted((r.id, r.n_words, r.n_hit) for r in dc.scan(docs, items).collect())
    assert rows == [(1, 1, 0), (1, 12, 12), (1, 12, 12), (2, 60_012, 12)]


@pytest.mark.parametrize("extra", [False, True])
def test_removal_keeps_columns(spark, docs_of, extra):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(["clean text", f"Before, {LONG.title()}. After!", None, "clean text"], extra)
    kept = dc.remove_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    cut = dc.remove_spans(docs, items)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {
        0: "clean text", 1: "Before, After!", 2: None, 3: "clean text"}


def test_plan_is_native(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    windows = dc.durable(dc.windows_of(items))
    plan = dc._found(docs_of([LONG]), windows, 10, "doc_id", "text")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Cartesian" not in plan
    plan = dc.scan(docs_of([LONG]), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_many_hits_take_time_in_proportion(spark):
    """Disjoint hits of one text are merged without copying what was merged before."""
    items = [(1, "aa bb cc dd ee ff gg hh ii jj")]

    def seconds(n):
        docs = [(1, " x ".join([items[0][1]] * n))]
        began = time.monotonic()
        assert run(spark, docs, items)[1][:2] == (11 * n - 1, 10 * n)
        return time.monotonic() - began

    seconds(100)
    assert seconds(32_000) < 6 * max(seconds(8_000), 1.0)


def test_spans_are_disjoint_and_whole(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f x a b a b c x"), (2, "a b"), (3, "x"), (4, "")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "c d e"), (3, "a b"), (4, "f")], "item_id long, text string")
    got = {r.id: ([(s.start, s.end) for s in r.spans], list(r["items"])) for r in dc.scan(docs, items).collect()}
    assert got == {1: ([(1, 7), (8, 13)], ["1", "2", "3", "4"]), 2: ([(0, 2)], ["3"]), 3: ([], []), 4: ([], [])}


def test_broadcast_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 10)
    windows = dc.durable(dc.windows_of(spark.createDataFrame(ITEMS, "item_id long, text string")))
    found = dc._found(spark.createDataFrame(DOCS, "doc_id long, text string"), windows, 10, "doc_id", "text")
    assert "Broadcast" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)
