"""Fill-in-middle: texts cut at two ranks and rearranged so that the middle comes last.

A text is a row of units: code points, or the matches of a pattern, each with the text
before it. An indexable skip list lies over the units. Every node of a lane carries how
many units and how many code points it spans; a node of the next lane spans `FAN` of them.
From the highest lane down, nodes that end at or before a rank are passed and their widths
add up, so a rank is reached in a few steps and the code points passed are the exact
place of the cut.

Rows are independent: there is no shuffle, and a task holds one batch of texts and the
lanes of one text. Null and empty texts are plain. A null id draws like an empty one.
Repeated rows get the same result, rows of one id the same draws. Very long texts are cut
whole; their lowest lane takes a byte or four a unit. Other columns take no part.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

FAN = 64  # nodes of a lane under one node of the next
MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
PLAIN_FROM = 90  # of 100 draws, those from here on leave a text plain
SPM_BELOW = 20  # of 100 draws, those below put the suffix first


class SkipList:
    """Lanes over the units of a text, each node with its widths in units and code points."""

    def __init__(self, points: np.ndarray):
        self.units = len(points)
        self.lanes = [(np.ones(len(points), np.int8), points)]
        while len(self.lanes[-1][0]) > FAN:
            starts = np.arange(0, len(self.lanes[-1][0]), FAN)
            self.lanes.append(tuple(
                np.add.reduceat(width, starts, dtype=np.int64) for width in self.lanes[-1]))

    def point(self, rank: int) -> int:
        """Code points before the unit of this rank; all of them for the number of units."""
        node = passed = points = 0
        for units, widths in reversed(self.lanes):
            ends = np.cumsum(units[node:node + FAN], dtype=np.int64)
            steps = int(np.searchsorted(ends, rank - passed, side="right"))
            if steps:
                passed += int(ends[steps - 1])
                points += int(widths[node:node + steps].sum(dtype=np.int64))
            node = (node + steps) * FAN
        return points


def unit_points(text: str, pattern: regex.Pattern | None) -> np.ndarray:
    """Code points of every unit; what follows the last match belongs to the last unit."""
    if pattern is None:
        return np.ones(len(text), np.int8)
    ends = [match.end() for match in pattern.finditer(text) if match.end() > match.start()]
    if text and (not ends or ends[-1] < len(text)):
        ends = ends[:-1] + [len(text)]
    return np.diff(np.array(ends, np.int32), prepend=np.int32(0))


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks that could overlap, so that an output has only the marks put into it."""
    for a, b in product(marks, repeat=2):
        if not a or (a != b and a in b) or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
            raise ValueError(f"marks {a!r} and {b!r} could be confused")
    if len(set(marks)) < 3:
        raise ValueError("three different marks are needed")


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}")
            for i in range(4)]


def rearrange(docs: DataFrame, seed: int = 1, unit: str | None = None,
              marks: tuple[str, str, str] = MARKS, plain_from: int = PLAIN_FROM,
              spm_below: int = SPM_BELOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) per row of `docs`.

    `n` counts units. The cuts are two draws modulo n + 1. The form is `plain` for a text
    that is empty, holds a mark or is drawn so, else `spm` (suffix, prefix, middle) or
    `psm`; a plain output is the text, and its widths are null.
    """
    check_marks(marks)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                       *draws(F.col(f"`{id_col}`"), seed))
    prefix_mark, suffix_mark, middle_mark = marks

    def one(text, h1, h2, h3, h4, pattern):
        lanes = SkipList(unit_points(text, pattern))
        n = lanes.units
        if not text or h3 % 100 >= plain_from or any(mark in text for mark in marks):
            return n, "plain", None, None, text
        first, last = sorted((lanes.point(h1 % (n + 1)), lanes.point(h2 % (n + 1))))
        prefix = prefix_mark + text[:first]
        middle = middle_mark + text[first:last]
        suffix = suffix_mark + text[last:]
        if h4 % 100 < spm_below:
            return n, "spm", first, last - first, suffix + prefix + middle
        return n, "psm", first, last - first, prefix + suffix + middle

    def run(batches):
        pattern = regex.compile(unit) if unit is not None else None
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("text", "h1", "h2", "h3", "h4")]
            made = list(zip(*(one(*row, pattern) for row in zip(*columns)))) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(values, kind) for values, kind in zip(made, kinds))],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, "
                                "middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text an output was made from: its parts are what stands between the marks."""
    prefix_mark, suffix_mark, middle_mark = marks

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    middle = F.substring_index(output, middle_mark, -1)
    return (F.when(form == "psm", F.concat(between(prefix_mark, suffix_mark), middle,
                                           between(suffix_mark, middle_mark)))
            .when(form == "spm", F.concat(between(prefix_mark, middle_mark), middle,
                                          between(suffix_mark, prefix_mark)))
            .otherwise(output))


def report(docs: DataFrame) -> DataFrame:
    """Widths, form and the digests of output and rebuilt text, by code points."""
    output = F.col("output")
    return rearrange(docs).select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(restored(output, F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
with d as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n,
         sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
h as (
  select doc_id, text, n, cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as r1,
         cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as r2,
         cast('0x' || substr(h, 17, 8) as bigint) % 100 as r3,
         cast('0x' || substr(h, 25, 8) as bigint) % 100 as r4 from d),
f as (
  select *, least(r1, r2) as a, greatest(r1, r2) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>')
                   or contains(text, '<M>') or r3 >= 90 then 'plain'
              when r4 < 20 then 'spm' else 'psm' end as form from h)
select doc_id, cast(n as bigint) as n, form,
       case when form <> 'plain' then cast(a as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
       sha256(case form
         when 'plain' then text
         when 'psm' then '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1)
                         || '<M>' || substr(text, a + 1, b - a)
         else '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a)
              || '<M>' || substr(text, a + 1, b - a) end) as output_sha256,
       sha256(text) as restored_sha256
from f
"""
