import hashlib
import random

import numpy as np
import pytest
import regex

from corpuswarden.llm import fill_middle as fm


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text, n = text or "", len(text or "")
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, n, form, a, b - a, sha(s + p + m if form == "spm" else p + s + m), sha(text)


TEXTS = ["", None, "a", "été 😀 " * 40, "has <S> inside", "<", "<P", "S>", "a<b>c<" * 70,
         "line\nline\r\n\x00end", "x" * 200_000, "漢字" * 4097, "́é"] + [
    "".join(random.Random(k).choices("ab<>PSM é😀\n", k=k)) for k in range(120)]


def test_matches_brute_force(spark, docs_of):
    rows = [(k, text) for k, text in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id"), (-7, "minus")]
    got = fm.report(docs_of(rows, extra=True)).collect()
    key = lambda row: [str(value) for value in row]
    assert sorted(map(tuple, got), key=key) == sorted((brute(*row) for row in rows), key=key)
    assert {row.form for row in got} == {"plain", "psm", "spm"}


def test_restores_every_text(spark, docs_of):
    docs = docs_of(TEXTS)
    for unit in (None, r"\w+|\W", r"[^\n]*\n", r"\d"):
        made = fm.rearrange(docs, seed=9, unit=unit)
        rows = made.select("id", "form", fm.restored(made["output"], made["form"]).alias("text"),
                           "prefix_chars").collect()
        assert {row.id: row.text for row in rows} == {k: t or "" for k, t in enumerate(TEXTS)}
        if unit == r"[^\n]*\n":  # cuts stand at the ends of lines only
            for row in rows:
                assert row.prefix_chars in (None, 0, len(row.text)) or row.text[row.prefix_chars - 1] == "\n"


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 5000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 9, n).astype(np.int32)
    lanes = fm.SkipList(widths)
    ends = np.append(0, np.cumsum(widths))
    assert [lanes.point(rank) for rank in range(n + 1)] == ends.tolist()


def test_units_cover_the_text():
    for pattern in (None, regex.compile(r"\w+"), regex.compile(r"z"), regex.compile(r"\w*")):
        for text in TEXTS:
            points = fm.unit_points(text or "", pattern)
            assert points.sum(dtype=np.int64) == len(text or "") and (points > 0).all()


def test_empty_table(spark, docs_of):
    assert fm.report(docs_of([])).collect() == []


def test_marks_must_not_overlap(spark, docs_of):
    for marks in (("ab", "bc", "x"), ("a", "ab", "c"), ("a", "a", "b"), ("", "a", "b"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fm.rearrange(docs_of([]), marks=marks)
