import random
import re

import duckdb

from corpuswarden.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["Released under the MIT License.", None, "", "nothing here of note",
         "apache license, APACHE-LICENSE apache\nlicense", "cc by cc by-nc", "gnu general public licence",
         "x GNU General Public License, mit license", "mit" * 10, "CC BY" * 3]


def test_base_places_match_brute_force(docs_of):
    rows = {r.doc_id: r for r in ls.report(docs_of(TEXTS)).collect()}
    for doc, text in enumerate(TEXTS):
        w = WORD.findall((text or "").lower())
        places = [(s, label) for label, phrase in ls.PHRASES for s in range(len(w))
                  if w[s:s + len(phrase.split())] == phrase.split()]
        starts = [s for s, _ in places]
        row = rows[doc]
        assert (row.n_words, row.n_base) == (len(w), len(places)), text
        assert (row.first_word, row.last_word) == (min(starts, default=None), max(starts, default=None))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(row.base_labels.split(",")) <= set(row.labels.split(",")) or not places
        assert 0 <= row.score <= 1 and (row.score == 1 or not places)


def test_notices_survive_small_changes(docs_of):
    mit = dict(ls.NOTICES)["mit-text"]
    words = mit.split()
    changed = " ".join(words[:12] + ["indeed"] + words[12:20] + words[21:])
    rows = {r.doc_id: r for r in ls.report(docs_of([
        mit, f"intro {changed} outro", " ".join(words[:6]), mit.upper() + " " + mit])).collect()}
    assert rows[0].labels == rows[1].labels == rows[3].labels == "mit-text"
    assert rows[0].score == 1 and 0.7 <= rows[1].score < 1
    assert rows[2].labels == "" and 0 < rows[2].score < 0.7
    spans = {r.id: r.spans for r in ls.scan(docs_of([f"intro {changed} outro"])).collect()}[0]
    assert [(s.start, s.end) for s in spans] == [(1, 1 + len(changed.split()))]


def test_repeated_rows_clashes_and_empty_table(spark, docs_of):
    docs = docs_of([(1, "mit license"), (1, "mit license"), (None, "cc by"), (2, "w " * 50_000 + "mit license")],
                   extra=True)
    rows = sorted((str(r.doc_id), r.n_base, r.first_word) for r in ls.report(docs).collect())
    assert rows == [("1", 1, 0), ("1", 1, 0), ("2", 1, 50_000), ("None", 1, 0)]
    assert ls.report(docs_of([])).count() == 0


def test_plan_is_native(docs_of):
    plan = ls.report(docs_of(["x"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "BroadcastHashJoin" in plan


def notice_k(text):
    return next(k for t, _, k, w in ls.templates() if t.startswith("notice") and " ".join(w) == text)


def test_every_notice_survives_a_word_added_or_removed_anywhere(docs_of):
    """An added word anywhere; a missing one where the notice is long enough to stay itself."""
    cases = []
    for label, text in ls.NOTICES:
        words, k = text.split(), notice_k(text)
        grams = len(words) - k + 1
        for at in range(1, len(words)):
            split = sum(o < at < o + k for o in range(grams))
            cases.append((label, words[:at] + ["zzz"] + words[at:], (grams - split) / grams))
        for at in range(len(words)):
            gone = sum(o <= at < o + k for o in range(grams))
            cases.append((label, words[:at] + words[at + 1:], (grams - gone) / grams))
            if len(words) >= ls.SHORT:
                assert cases[-1][2] >= ls.MIN_COVERAGE
    rows = {r.id: r for r in ls.scan(docs_of(["xx yy " + " ".join(w) + " xx" for _, w, _ in cases])).collect()}
    lost = []
    for k, (label, words, least) in enumerate(cases):
        found = [s.coverage for s in rows[k].spans if s.label == label]
        must = "zzz" in words or least >= ls.MIN_COVERAGE
        if must and not (len(found) == 1 and found[0] >= least - 1e-9):
            lost.append((label, " ".join(words), least, found))
    assert not lost, (len(lost), lost[:3])
    assert sum("zzz" in words for _, words, _ in cases) == sum(len(t.split()) - 1 for _, t in ls.NOTICES)


def test_sql_has_the_same_definition(spark, docs_of):
    """Notices changed at random, with far diagonals between their parts, beside DuckDB."""
    rng, texts = random.Random(9), list(TEXTS)
    notices = [text.split() for _, text in ls.NOTICES]
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 3)):
            part = list(rng.choice(notices))
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(part) + 1)
                part[at:at + rng.randint(0, 2)] = rng.choices(["zzz", "the", "license", "you", "may"], k=rng.randint(0, 2))
            words += part + ["yy"] * rng.randint(0, 3)
        texts.append(" ".join(words))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    result = con.execute(ls.ORACLE)
    names = [d[0] for d in result.description]
    want = {row[0]: row for row in result.fetchall()}
    for row in ls.report(docs_of(texts)).select(names).collect():
        assert tuple(row)[:-1] == want[row.doc_id][:-1] and abs(row.score - want[row.doc_id][-1]) < 1e-12


def test_licenses_of_one_family_are_told_apart(docs_of):
    by = dict(ls.NOTICES)
    rows = {r.doc_id: set(r.labels.split(",")) for r in ls.report(docs_of([
        by["bsd-2-clause"], by["bsd-2-clause"] + " " + by["bsd-3-clause"], by["lgpl-notice"], by["agpl-notice"],
        "this program is free software you can " + by["lgpl-notice"].replace("lesser ", "")])).collect()}
    assert "bsd-2-clause" in rows[0] and "bsd-3-clause" not in rows[0] and "bsd-3-clause" in rows[1]
    assert "lgpl-notice" in rows[2] and "agpl-notice" in rows[3] and "gpl-notice" in rows[4]
