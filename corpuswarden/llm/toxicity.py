"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Folding maps capitals, accents, homoglyphs and digit or sign substitutions to plain
letters, one character for one. Entries are whole words, word stems, and exception
phrases inside which nothing counts. The weights of stems and of words, each over the
length of the text, give the score through a logistic curve.

Whole words come from a short general list. Stems and weights, and the curve, are
learned from labels: at most `SAMPLE` documents of each class, counted in Spark, a
document once however many rows repeat its id; the lexicon has at most `STEMS` stems.
Documents are scored row by row with no shuffle, very long ones whole.

Defined results: a null or empty text has no matches and the least score; ids that are
null count as held out; without labels of both classes the general list alone is used,
with a fixed curve; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpuswarden.llm.common import durable
from corpuswarden.llm.labelled import held_out, training_rows

SAMPLE = 4000       # documents of each class that are learned from, at most
STEMS = 2000        # learned stems, at most
STEM_LENGTHS = range(4, 9)
LEAST_WEIGHT = 3.0  # natural logarithm of how much more frequent a stem is in toxic texts
MOST_HITS = 10      # of a stem that count in one document
LEAST_SHARE = 0.01  # of the toxic documents of the sample that hold a stem
WORD_WEIGHT = 4.0
LEAST_LENGTH = 10   # words that a shorter text counts as
# The curve without labels: bias, and the factors of the stems' weight a word and of the
# whole words' weight a word.
DEFAULT_CURVE = (-4.0, 1.0, 3.0)

# General insults, and phrases in which one of them is none.
WORDS = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "trash", "pathetic",
    "worthless", "disgusting", "clown", "clowns", "scum", "imbecile", "dumb", "dumbass", "jerk",
    "bastard", "bitch", "asshole", "retard", "filth", "vermin", "degenerate", "cretin", "scumbag",
)
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash collection", "clown fish", "circus clown",
    "pond scum", "dumb waiter", "dumb bell", "sore loser", "knee jerk", "jerk chicken",
)


def _folding() -> dict[int, str]:
    """One plain letter for each letter that looks like it."""
    table = {}
    for code in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if len(plain) == 1 and plain.isascii():
            table[code] = plain
    pairs = ("аa еe оo рp сc хx уy іi ѕs јj кk мm тt вb нh ԁd ɡg αa οo ιi νv ρp τt υu κk εe "
             "АA ЕE ОO РP СC ХX УY ІI ЅS КK МM ТT ВB НH ΑA ΟO ΙI ΡP ΤT ΚK ΕE ΒB ΝN ΜM")
    table |= {ord(pair[0]): pair[1].lower() for pair in pairs.split()}
    return table | {ord(digit): letter for digit, letter in zip("0134578", "oieastb")}


FOLDING = _folding()
SIGNS = re.compile(r"[$@!](?=[^\W\d_])")
SIGN_LETTERS = {"$": "s", "@": "a", "!": "i"}


def fold(text: str) -> str:
    """The text in plain small letters; it keeps its length."""
    text = text.translate(FOLDING)
    if "$" in text or "@" in text or "!" in text:
        text = SIGNS.sub(lambda m: SIGN_LETTERS[m.group()], text)
    return text


@dataclass(frozen=True)
class Lexicon:
    stems: tuple[tuple[str, float], ...] = ()
    words: tuple[str, ...] = WORDS
    exceptions: tuple[str, ...] = EXCEPTIONS


@lru_cache(maxsize=4)
def automaton(lexicon: Lexicon):
    entries: dict[str, tuple] = {stem: (stem, "stem", weight) for stem, weight in lexicon.stems}
    entries |= {word: (word, "word", WORD_WEIGHT) for word in map(fold, lexicon.words)}
    entries |= {phrase: (phrase, "exception", 0.0) for phrase in map(fold, lexicon.exceptions)}
    machine = ahocorasick.Automaton()
    for entry in entries.values():
        machine.add_word(entry[0], entry)
    if len(machine):
        machine.make_automaton()
    return machine


def matches(text: str, lexicon: Lexicon) -> list[tuple[int, int, float, bool]]:
    """(start, end, weight, whole word) of what counts; of entries that start together the heaviest."""
    machine, folded = automaton(lexicon), fold(text)
    if not len(machine):
        return []
    found: dict[int, tuple[int, float, bool]] = {}
    spared = []
    for last, (entry, kind, weight) in machine.iter(folded):
        start, end = last + 1 - len(entry), last + 1
        if start and folded[start - 1].isalnum():
            continue
        if kind != "stem" and folded[end:end + 1].isalnum():
            continue
        if kind == "exception":
            spared.append((start, end))
        elif start not in found or found[start][1] < weight:
            found[start] = (end, weight, kind == "word")
    return [(start, end, weight, whole) for start, (end, weight, whole) in found.items()
            if not any(a <= start and end <= b for a, b in spared)]


def features(text: str, found) -> tuple[float, float]:
    """The weights of stems and of whole words, a hundred words, damped.

    Both are divided by the length, so a text has the features of any part of it that is
    like the whole.
    """
    stems = sum(w for _, _, w, whole in found if not whole)
    words = sum(w for _, _, w, whole in found if whole)
    length = max(len(text.split()), LEAST_LENGTH)
    return float(np.log1p(100 * stems / length)), float(np.log1p(100 * words / length))


def learn_stems(rows: DataFrame, n_toxic: int) -> tuple[tuple[str, float], ...]:
    """Stems much more frequent, word for word, in toxic texts of `rows` (text, y)."""
    def run(batches):
        word = re.compile(r"[^\W\d_]+")
        for batch in batches:
            hits: Counter = Counter()
            for text, y in zip(batch["text"], batch["y"]):
                own = Counter(word.findall(fold(text)))
                stems = Counter()
                for w, n in own.items():
                    for length in STEM_LENGTHS:
                        if len(w) >= length:
                            stems[w[:length]] += n
                for stem, n in stems.items():
                    hits[stem, y, "n"] += min(n, MOST_HITS)
                    hits[stem, y, "docs"] += 1
                hits["", y, "n"] += sum(own.values())
            stems = sorted({stem for stem, _, _ in hits})
            yield pd.DataFrame({"stem": stems, **{
                f"{what}{y}": [hits[s, y, what] for s in stems] for what in ("n", "docs") for y in (0, 1)}})

    counted = rows.mapInPandas(run, "stem string, n0 long, n1 long, docs0 long, docs1 long").groupBy(
        "stem").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "docs1")])
    total = counted.where("stem = ''").first()
    if total is None or not total["n0"] or not total["n1"]:
        return ()
    weight = F.log((F.col("n1") + 0.5) / total["n1"]) - F.log((F.col("n0") + 0.5) / total["n0"])
    strong = counted.where(F.col("stem") != "").withColumn("weight", F.round(weight, 6)).where(
        (F.col("weight") >= LEAST_WEIGHT) & (F.col("docs1") >= max(3, LEAST_SHARE * n_toxic)))
    best = strong.orderBy(F.desc("weight"), "stem").limit(STEMS).collect()
    kept: dict[str, float] = {}
    plain = [fold(w) for w in WORDS]
    for row in sorted(best, key=lambda r: (len(r["stem"]), r["stem"])):
        stem, own = row["stem"], row["weight"]
        shorter = [kept[stem[:n]] for n in range(4, len(stem)) if stem[:n] in kept]
        if not any(w.startswith(stem) for w in plain) and own > max(shorter, default=0) + 0.7:
            kept[stem] = own
    return tuple(sorted(kept.items()))


def fit_curve(x: np.ndarray, y: np.ndarray, sizes: dict[int, int]) -> tuple[float, ...]:
    """Logistic regression by Newton's method, each class weighted to its size."""
    full = np.column_stack([np.ones(len(x)), x])
    share = np.array([sizes[v] / max(1, (y == v).sum()) for v in (0, 1)])
    weight = share[y] / share[y].mean()
    beta, ridge = np.zeros(full.shape[1]), np.diag([1e-3] + [0.05] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        gradient = full.T @ (weight * (y - p)) - ridge @ beta
        hessian = (full * (weight * p * (1 - p))[:, None]).T @ full + ridge
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(beta)), gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon = Lexicon()
    curve: tuple[float, ...] = DEFAULT_CURVE


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE,
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows, sizes = training_rows(docs, labels, label, per_class, id_col, text_col)
    if len(sizes) < 2:
        return Model()
    rows = durable(rows.groupBy("id", "y").agg(F.min("text").alias("text")))  # one row an id
    lexicon = Lexicon(learn_stems(rows, min(per_class, sizes[1])))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array([features(t, matches(t, lexicon)) for t in (x.as_py() for x in texts)],
                        pa.list_(pa.float64()))

    # At most `per_class` rows of two numbers a class reach the driver.
    seen = rows.select("y", measured("text").alias("x")).collect()
    if len({row["y"] for row in seen}) < 2:
        return Model(lexicon)
    x, y = np.array([row["x"] for row in seen]), np.array([row["y"] for row in seen])
    order = np.lexsort((*x.T, y))
    return Model(lexicon, fit_curve(x[order], y[order], sizes))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) per row of `docs`; spans are (start, end, weight) of the matches."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                         T.StructField("weight", T.DoubleType())])
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    lexicon, (bias, *factors) = model.lexicon, model.curve

    @F.arrow_udf(kind)
    def scored(texts: pa.Array) -> pa.Array:
        scores, spans = [], []
        for text in (t.as_py() for t in texts):
            found = matches(text, lexicon)
            z = bias + float(np.dot(factors, features(text, found)))
            scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            spans.append([dict(start=s, end=e, weight=w) for s, e, w, _ in sorted(found)])
        listed = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())])
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.array(spans, pa.list_(listed))], ["score", "spans"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), scored(text).alias("s")).select("id", "s.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_matches"))
