"""Quality by attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. A passage is described by shares of
character classes and by measures of its words, and encoded by one layer. Gated
attention, learned from document labels alone, weighs the passages; the weighted sum of
the encodings gives the score.

Passages are described with array operations over whole batches of texts, every passage
of every document. The model is fitted on at most `SAMPLE` labelled documents of each
class, and no more than have `SAMPLE_PASSAGES` passages together, in the order of their
ids' hashes; all passages of these documents are used, some numbers each brought to the
driver. Scoring uses all passages, row by row, with no shuffle; a very long text is
described a slice at a time.

Defined results: a null or empty text is a bag of one passage without words; ids that
are null count as held out; without labels of both classes every score is the share of
good labels, or 0.5 without any; repeated rows give repeated results; other columns are
ignored by `score` and kept by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpuswarden.llm.common import durable, whole_row
from corpuswarden.llm.labelled import held_out, training_rows

PASSAGE = 64         # words
SAMPLE = 3000        # documents of each class that are learned from, at most
SAMPLE_PASSAGES = 500_000  # passages of all of them, at most; 72 bytes each
HIDDEN, GATE = 16, 8
EPOCHS, STEP, DECAY = 150, 0.02, 1e-4
THRESHOLD = 0.3
SLICE_BYTES = 1 << 19  # text described at a time; what it takes is some dozen times as much

CLASSES = ("upper", "lower", "high", "digit", "space", "line", "mark", "bar", "bang", "sign")


def _classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("sign"), dtype=np.uint8)
    for name, members in (("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", b"abcdefghijklmnopqrstuvwxyz"),
                          ("high", bytes(range(128, 256))), ("digit", b"0123456789"), ("space", b" \t\r"),
                          ("line", b"\n"), ("mark", b".,;:'\"()-"), ("bar", b"|"), ("bang", b"!?")):
        table[list(members)] = CLASSES.index(name)
    return table


CLASS = _classes()
POWERS = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64), dtype=np.uint64)
N_FEATURES = len(CLASSES) + 8


def describe(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, owner) of all passages of the texts that lie one after another in `data`.

    Each text has a passage at least; words are runs of bytes that are not white space.
    """
    n = len(offsets) - 1
    kind = CLASS[data]
    blank = (kind == CLASSES.index("space")) | (kind == CLASSES.index("line"))
    before = np.ones(len(data), dtype=bool)
    before[1:] = blank[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(~blank & before)
    owner = np.searchsorted(offsets, starts, "right") - 1
    per_text = np.bincount(owner, minlength=n)
    first_word = np.cumsum(per_text) - per_text
    rank = np.arange(len(starts)) - first_word[owner]
    # Passages: one per PASSAGE words, and one for a text without words.
    of_text = np.maximum(1, -(-per_text // PASSAGE))
    first_passage = np.cumsum(of_text) - of_text
    total = int(of_text.sum())
    passage = first_passage[owner] + rank // PASSAGE
    # Every byte belongs to the passage of the last word that began in its text.
    byte_starts = np.empty(total, dtype=np.int64)
    byte_starts[first_passage] = offsets[:-1]
    begins = (rank % PASSAGE == 0) & (rank > 0)
    byte_starts[passage[begins]] = starts[begins]
    sizes = np.diff(byte_starts, append=offsets[-1])
    of_byte = np.repeat(np.arange(total), sizes)
    shares = np.bincount(of_byte * len(CLASSES) + kind, minlength=total * len(CLASSES)).reshape(
        total, -1) / np.maximum(sizes, 1)[:, None]
    words = np.bincount(passage, minlength=total)
    some = np.maximum(words, 1)
    sums = lambda x: np.bincount(passage, weights=x, minlength=total)
    if len(starts):
        solid = ~blank
        word_of = np.cumsum(solid & before) - 1
        place = np.minimum(np.arange(len(data)) - starts[np.maximum(word_of, 0)], 63)
        value = np.where(solid, (data.astype(np.uint64) + np.uint64(1)) * POWERS[np.maximum(place, 0)], np.uint64(0))
        hashes = np.add.reduceat(value, starts)
        lengths = np.add.reduceat(solid.astype(np.int64), starts)
        again = np.zeros(len(starts), dtype=bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        mixed = lambda x: hashes ^ (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        new_in_text, new_in_passage = _firsts(mixed(owner)), _firsts(mixed(passage))
        capital = kind[starts] == CLASSES.index("upper")
    else:
        lengths = again = new_in_text = new_in_passage = capital = np.zeros(0)
    log_words = np.log1p(per_text)[np.repeat(np.arange(n), of_text)]
    own = np.column_stack([
        shares, words / PASSAGE, sums(lengths) / some / 10, sums(again) / some,
        sums(new_in_text) / some, sums(new_in_passage) / some, sums(capital) / some,
        sums(np.minimum(lengths, 40) == 1) / some, log_words / 10])
    return own.astype(np.float32), np.repeat(np.arange(n), of_text)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its kind."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.ones(len(keys), dtype=bool)
    first[order[1:]] = ordered[1:] != ordered[:-1]
    return first


def bags(texts: pa.Array):
    """(first row, features, owner) for slices of a batch of texts."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1)
        yield low, high, *describe(everything[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        low = high


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Encoder (w, b), gates (v, u, a) and output (c, d) over standardised features."""
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def forward(self, features: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p, x = self.parts, (features - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        starts = np.searchsorted(owner, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        weight = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return dict(x=x, h=h, t=t, g=g, weight=weight, z=z, out=_sigmoid(z @ p["c"] + p["d"]))

    def scores(self, features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return self.forward(features, owner, n)["out"]

    def gradients(self, f: dict, owner: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        dz = error[:, None] * p["c"][None, :]
        dh = f["weight"][:, None] * dz[owner]
        pull = (f["h"] * dz[owner]).sum(axis=1)
        starts = np.searchsorted(owner, np.arange(len(error)))
        de = f["weight"] * (pull - np.add.reduceat(f["weight"] * pull, starts)[owner])
        dt = de[:, None] * p["a"][None, :] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["a"][None, :] * f["t"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        return dict(w=f["x"].T @ dh, b=dh.sum(axis=0), v=f["h"].T @ dt, u=f["h"].T @ dg,
                    a=(f["t"] * f["g"]).T @ de, c=f["z"].T @ error, d=error.sum(keepdims=True))


def train(features: np.ndarray, owner: np.ndarray, y: np.ndarray, sizes: dict[int, int]) -> Model:
    """Adam on the whole sample, each class weighted to its size."""
    random = np.random.default_rng(7)
    shape = {"w": (N_FEATURES, HIDDEN), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,)}
    parts = {k: random.normal(0, 0.3, s) for k, s in shape.items()} | {"b": np.zeros(HIDDEN), "d": np.zeros(1)}
    features = features.astype(np.float64)
    model = Model(features.mean(axis=0), features.std(axis=0) + 1e-3, parts)
    share = np.array([sizes[v] / max(1, (y == v).sum()) for v in (0, 1)])
    weight = share[y] / share[y].sum()
    first = {k: np.zeros_like(v) for k, v in parts.items()}
    second = {k: np.zeros_like(v) for k, v in parts.items()}
    for epoch in range(1, EPOCHS + 1):
        f = model.forward(features, owner, len(y))
        gradients = model.gradients(f, owner, weight * (f["out"] - y))
        for k, part in parts.items():
            g = gradients[k] + DECAY * part
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            part -= STEP * (first[k] / (1 - 0.9 ** epoch)) / (np.sqrt(second[k] / (1 - 0.999 ** epoch)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE,
        id_col: str = "doc_id", text_col: str = "text") -> Model | float:
    """The model, or a constant score if the labels don't hold both classes."""
    rows, sizes = training_rows(docs, labels, label, per_class, id_col, text_col)

    @F.arrow_udf(T.BinaryType())
    def described(texts: pa.Array) -> pa.Array:
        out = []
        for low, high, features, owner in bags(texts):
            ends = np.searchsorted(owner, np.arange(high - low + 1))
            out += [features[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        return pa.array(out, pa.binary())

    if len(sizes) == 2:
        bags_of = durable(rows.groupBy("id", "y").agg(F.min("text").alias("text")).select(
            "id", "y", described("text").alias("x")))
        # `per_class` short rows of each class; a document that doesn't fit in is left out whole.
        order = Window.orderBy(F.xxhash64(F.col("id").cast("string")), "id")
        passages = F.octet_length("x") / (4 * N_FEATURES)
        seen = bags_of.withColumn("passages", passages).where(f"passages <= {SAMPLE_PASSAGES}").withColumn(
            "so_far", F.sum("passages").over(order)).where(f"so_far <= {SAMPLE_PASSAGES}").collect()
        seen = sorted(seen, key=lambda row: str(row["id"]))
        y = np.array([row["y"] for row in seen])
        if len(set(y.tolist())) == 2:
            parts = [np.frombuffer(row["x"], np.float32).reshape(-1, N_FEATURES) for row in seen]
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            return train(np.concatenate(parts), owner, y, sizes)
    return sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5


def scored_text(model: Model | float):
    """A function from texts to scores."""
    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        if not isinstance(model, Model):
            return pa.array(np.full(len(texts), float(model)))
        out = np.zeros(len(texts))
        for low, high, features, owner in bags(texts):
            out[low:high] = model.scores(features, owner, high - low)
        return pa.array(out)
    return run


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row of `docs`."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), scored_text(model)(text).alias("score"))


def keep_good(docs: DataFrame, model: Model | float, text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` whose score reaches the threshold, with all their columns."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(whole_row(docs).alias("row"), scored_text(model)(text).alias("score")).where(
        F.col("score") >= threshold).select("row.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
