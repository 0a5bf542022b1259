"""Secrets in texts: fixed patterns, and windows of high entropy in candidate strings.

Candidates are runs of key characters of at least a window's length. A window slides over
a candidate and its Shannon entropy is kept by incremental counts: a character that
enters or leaves changes one term of the sum. Windows over the threshold of their
character class are merged to a span: a class with fewer characters can reach less
entropy and has a lower one. The class of a window inside a piece between separators is
its own, so what stands before a key changes nothing. An allow-list suppresses
candidates that are known not to be secrets; a suppressed candidate's long pieces, and
what follows its leading words, are judged for themselves, so no word beside a key hides it.

A batch of texts is scanned as one byte array, so texts without a keyword or a candidate
cost no work per row. Rows are independent: nothing is shuffled. The time grows with the
length of a text and the number of its spans, a very long text of keys included.

Defined results: a null or empty text has no spans; positions are code points, ends are
exclusive; spans are ordered by start, then by kind; an entropy span that overlaps a
span of a fixed pattern is left out; a window of equal entropy to the threshold counts;
repeated rows give repeated results; other columns are ignored by `scan` and kept by
`redact`, where a null text stays null.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The kinds in their order, and their patterns and least lengths.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

# What a text must hold, in lower case, for ASSIGN to match; checked on whole batches.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

WINDOW = 24
# Least bits a character of a window, by its class. Of random windows 99.5 % of hex digits
# of one case, 99.8 % of letters of one case with digits and 95.7 % of base64 reach them.
HEX_BITS = 3.0
CASE_BITS = 3.5
MIXED_BITS = 4.0
MASK = "[REDACTED]"

CANDIDATE = np.zeros(256, dtype=bool)
CANDIDATE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

# Candidates that are no secrets: words, identifiers, paths, digests of published files,
# example keys, numbers, and runs of an alphabet.
ALLOWED = (
    re.compile(rb"[^0-9]*"),
    re.compile(rb"[0-9+/_=-]*"),
    re.compile(rb"[A-Za-z]+[0-9]{0,4}([-_=]([A-Za-z]+[0-9]{0,4}|[0-9]{0,8}))+"),
    re.compile(rb"/?([a-z0-9_=-]*/)+[a-z0-9_=-]*"),
    re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(rb".*(example|sample|placeholder).*", re.IGNORECASE),
    re.compile(rb"(.{1,8}?)\1+.{0,7}"),
)
# A published digest: its name and a value of its very form, whatever words stand before.
DIGEST = re.compile(
    rb"([A-Za-z0-9]+[-_=/]+)*?(sha1-([0-9a-f]{40}|[A-Za-z0-9+/]{27}=)|sha256-([0-9a-f]{64}|[A-Za-z0-9+/]{43}=)"
    rb"|sha384-([0-9a-f]{96}|[A-Za-z0-9+/]{64})|sha512-([0-9a-f]{128}|[A-Za-z0-9+/]{86}==))")
LABELS = re.compile(rb"(?:[A-Za-z]+[0-9]{0,4}[-_=/]+)*+")
ALPHABETS = (b"abcdefghijklmnopqrstuvwxyz0123456789", b"0123456789abcdefghijklmnopqrstuvwxyz",
             b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/",
             b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
             b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789abcdef0123456789abcdef")
IS_HEX = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
PIECE = re.compile(rb"[A-Za-z0-9]{%d,}" % WINDOW)
WORD = re.compile(rb"[A-Za-z]+[0-9]{0,4}")
# The kind of each key character: digit, a-f, g-z, A-F, G-Z, separator.
DIGIT, LOW_HEX, LOW, HIGH_HEX, HIGH, SEPARATOR = range(6)
CHARACTER = bytes(
    DIGIT if b in b"0123456789" else LOW_HEX if b in b"abcdef" else HIGH_HEX if b in b"ABCDEF"
    else LOW if chr(b).islower() else HIGH if chr(b).isupper() else SEPARATOR for b in range(256))

SLICE_BYTES = 4 << 20  # text scanned at a time


def allowed(candidate: bytes) -> bool:
    return any(p.fullmatch(candidate) for p in ALLOWED) or any(candidate in a for a in ALPHABETS)


def entropy_spans(candidate: bytes, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows whose entropy reaches the threshold of their class."""
    if len(candidate) < window or DIGEST.fullmatch(candidate):
        return []
    start = 0
    if allowed(candidate):
        start = LABELS.match(candidate).end()
        if start == 0 or allowed(candidate[start:]):
            start = len(candidate)
    rest = candidate[start:]
    whole = bool(IS_HEX.fullmatch(candidate))
    found = [start + at for at in _windows(rest, window, HEX_BITS if IS_HEX.fullmatch(rest) else MIXED_BITS, False)]
    for m in () if whole else PIECE.finditer(candidate):
        piece = m.group()
        if not (WORD.fullmatch(piece) or piece.isdigit() or allowed(piece)):
            bits = HEX_BITS if IS_HEX.fullmatch(piece) else MIXED_BITS
            found += [m.start() + at for at in _windows(piece, window, bits, True)]
    spans: list[tuple[int, int]] = []
    for start in sorted(found):
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], start + window)
        else:
            spans.append((start, start + window))
    return spans


def _windows(text: bytes, window: int, bits: float, own: bool) -> list[int]:
    """Starts of the windows of at least `bits`; with `own`, or of what their own class asks for."""
    # Entropy is log2(window) - sum(c * log2(c)) / window; `weight` is c * log2(c) by count.
    weight = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    most, most_case, most_hex = ((log2(window) - b) * window + 1e-9 for b in (bits, CASE_BITS, HEX_BITS))
    counts, total, found, last = [0] * 256, 0.0, [], [-1] * 6
    for at, byte in enumerate(text):
        counts[byte] += 1
        total += weight[counts[byte]] - weight[counts[byte] - 1]
        last[CHARACTER[byte]] = at
        if at >= window:
            old = text[at - window]
            counts[old] -= 1
            total += weight[counts[old]] - weight[counts[old] + 1]
        start = at - window + 1
        if start < 0 or total > most_hex:
            continue
        if total <= most:
            found.append(start)
        elif own and last[DIGIT] >= start:
            lower, upper = max(last[LOW_HEX], last[LOW]) >= start, max(last[HIGH_HEX], last[HIGH]) >= start
            if lower != upper and (total <= most_case or max(last[LOW], last[HIGH]) < start):
                found.append(start)
    return found


def _batch(texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(row, spans) of the rows that have any; a span is (start, kind, end, start of the value)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1)
        yield from _slice(everything[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], low)
        low = high


def _slice(data: np.ndarray, offsets: np.ndarray, base: int):
    raw, ends = data.tobytes(), offsets.tolist()
    row_of = lambda at: bisect_right(ends, at) - 1
    lower, keyed, access = raw.lower(), set(), set()
    for needle, text, rows in [(k, lower, keyed) for k in KEYWORDS] + [(b"AKIA", raw, access)]:
        at = text.find(needle)
        while at >= 0:
            row = row_of(at)
            rows.add(row)
            at = text.find(needle, ends[row + 1])
    # Edges of the runs of key characters; a run never goes on into the next text.
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = CANDIDATE[data]
    step = np.diff(inside)
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = stops - starts >= min(WINDOW, HEX_LEAST)
    runs: dict[int, list[tuple[int, int]]] = {}
    for start, stop in zip(starts[long].tolist(), stops[long].tolist()):
        while start < stop:
            row = row_of(start)
            part = min(stop, ends[row + 1])
            if part - start >= min(WINDOW, HEX_LEAST):
                runs.setdefault(row, []).append((start, part))
            start = part
    for row in sorted(keyed | access | runs.keys()):
        spans = _row(raw, ends[row], ends[row + 1], runs.get(row, ()), row in keyed, row in access)
        if spans:
            yield base + row, spans


def _row(raw: bytes, low: int, high: int, runs, keyed: bool, access: bool):
    spans = []
    text = raw[low:high].decode("utf-8", "replace") if keyed or access else ""
    if keyed:
        spans += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text)
                  if len(m.group(2)) >= ASSIGN_LEAST]
    if access:
        spans += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= ACCESS_LEAST]
    random = []
    for start, stop in runs:
        run = raw[start:stop]
        for m in HEX.finditer(run.decode("ascii")):
            if m.end() - m.start() >= HEX_LEAST:
                spans.append((start + m.start() - low, 2, start + m.end() - low, start + m.start() - low))
        random += [(start + a - low, start + b - low) for a, b in entropy_spans(run)]
    if runs and not raw[low:high].isascii():
        # Runs are ASCII, so only what stands before one tells bytes and code points apart.
        before = np.cumsum(np.frombuffer(raw[low:high], np.uint8) & 0xC0 == 0x80)
        shift = lambda at: at - int(before[at])
        spans = [(shift(s), k, shift(s) + e - s, shift(s)) if k == 2 else (s, k, e, v) for s, k, e, v in spans]
        random = [(shift(start), shift(start) + stop - start) for start, stop in random]
    base = sorted(spans)
    starts, furthest = [s for s, *_ in base], list(accumulate((e for _, _, e, _ in base), max))
    for start, stop in random:
        earlier = bisect_left(starts, stop)
        if not earlier or furthest[earlier - 1] <= start:
            spans.append((start, 3, stop, start))
    return sorted(spans)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType()), T.StructField("value", T.IntegerType())])


SPAN_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int32())])


@F.arrow_udf(T.ArrayType(SPAN))
def secret_spans(texts: pa.Array) -> pa.Array:
    """Spans (kind, start, end, value): `value` is where the secret itself starts."""
    out: list[list] = [[] for _ in range(len(texts))]
    for row, spans in _batch(texts):
        out[row] = [dict(kind=KINDS[k], start=s, end=e, value=v) for s, k, e, v in spans]
    return pa.array(out, pa.list_(SPAN_ARROW))


@F.arrow_udf(T.StringType())
def masked(texts: pa.Array) -> pa.Array:
    """The text with every secret's value replaced by a mark; null where nothing changes."""
    out = [None] * len(texts)
    for row, spans in _batch(texts):
        text, parts, done = texts[row].as_py(), [], 0
        for start, end in sorted((v, e) for _, _, e, v in spans):
            if end <= done:
                continue
            if start >= done:
                parts += [text[done:start], MASK]
            done = end
        out[row] = "".join(parts) + text[done:]
    return pa.array(out, pa.string())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) per row of `docs`."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), secret_spans(
        F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """`docs` with the secrets' values masked; `length_col` follows where a text changed."""
    new = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      masked(F.col(f"`{text_col}`")).alias("new"))
    old = F.col(f"row.`{text_col}`")
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text_col: F.coalesce("new", old)}
    if length_col in columns:
        kind = docs.schema[length_col].dataType
        columns[length_col] = F.coalesce(F.length("new").cast(kind), columns[length_col])
    return new.select(*[c.alias(name) for name, c in columns.items()])


def report(docs: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return scan(docs).select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))
