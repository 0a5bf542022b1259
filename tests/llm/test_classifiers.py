import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpuswarden.llm import labelled, quality, toxicity


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def prose(rng, n=60):
    return " ".join(rng.choice(["the", "river", "runs", "über", "old", "stones", "and", "quiet", "hills", "sings"])
                    for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def table(spark):
    rng, rows = random.Random(1), []
    for k in range(400):
        text, toxic, good = prose(rng, rng.randint(20, 150)), 0, 1
        if k % 4 == 0:
            words = text.split()
            for _ in range(max(3, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "M0RON", "grumplich", "grumpfurt", "ѕcum"]))
            text, toxic = " ".join(words), 1
        if k % 5 == 0:
            text, good = " ".join(w + rng.choice(["%%%", "&&&", "$$$"]) for w in text.split()), 0
        rows.append((k, text, toxic, good))
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, g, t) for k, _, t, g in rows], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_folding_keeps_length_and_meaning():
    for text, plain in [("ÍDIÓT", "idiot"), ("m0r0n", "moron"), ("ѕсum", "scum"), ("$tupid!!", "stupid!!"),
                        ("id!ot", "idiot"), ("ＬＯＳＥＲ", "loser"), ("straße", "straße")]:
        assert toxicity.fold(text) == plain and len(toxicity.fold(text)) == len(text)


def test_boundaries_exceptions_and_weights():
    found = lambda t, *stems: [(s, e) for s, e, *_ in toxicity.matches(t, toxicity.Lexicon(stems))]
    assert found("You idiot, IDIOT!") == [(4, 9), (11, 16)]
    assert found("idiotic unidiot") == [] and found("the trash can is trash") == [(17, 22)]
    assert found("a clown fish and a clown") == [(19, 24)]
    assert found("grumpfurt agrumpf", ("grumpf", 3.0)) == [(0, 6)]
    assert found("") == []


def test_toxicity_on_held_out_documents(table):
    docs, labels, rows = table
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    assert len(got) == len(rows)
    test = [(got[k], toxic) for k, _, toxic, _ in rows if held(k)]
    assert all(r.held_out for r, _ in test) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.predicted == toxic for r, toxic in test]) >= 0.97


def test_held_out_labels_are_never_read(spark, table):
    docs, labels, rows = table
    lies = spark.createDataFrame([(k, 1 - g if held(k) else g, 1 - t if held(k) else t)
                                  for k, _, t, g in rows], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        first = {r.doc_id: r.score for r in module.report(docs, labels).collect()}
        assert first == {r.doc_id: r.score for r in module.report(docs, lies).collect()}


def test_quality_on_held_out_documents(table):
    docs, labels, rows = table
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    test = [(got[k], good) for k, _, _, good in rows if held(k)]
    assert np.mean([r.predicted == good for r, good in test]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_passages_do_not_depend_on_neighbours_or_slices(monkeypatch):
    rng = random.Random(2)
    texts = ["", " \n ", "x", "é" * 500, "a " * 300, prose(rng, 64), prose(rng, 65), prose(rng, 1000)]
    def all_of(values):
        out = []
        for low, high, features, owner in quality.bags(pa.array(values)):
            out += [features[owner == k] for k in range(high - low)]
        return out
    together = all_of(texts)
    assert [len(p) for p in together] == [1, 1, 1, 1, 5, 1, 2, 16]
    for text, passages in zip(texts, together):
        assert np.array_equal(all_of([text])[0], passages)
    monkeypatch.setattr(quality, "SLICE_BYTES", 100)
    assert all(np.array_equal(a, b) for a, b in zip(all_of(texts), together))


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    x, owner, y = rng.normal(size=(9, quality.N_FEATURES)), np.repeat([0, 1, 2], [4, 2, 3]), np.array([1, 0, 1])
    shape = {"w": (quality.N_FEATURES, 3), "v": (3, 2), "u": (3, 2), "a": (2,), "c": (3,), "b": (3,), "d": (1,)}
    parts = {k: rng.normal(0, 0.5, s) for k, s in shape.items()}
    model = quality.Model(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES), parts)
    loss = lambda: -np.sum(y * np.log(model.scores(x, owner, 3)) + (1 - y) * np.log(1 - model.scores(x, owner, 3)))
    f = model.forward(x, owner, 3)
    gradients = model.gradients(f, owner, f["out"] - y)
    for name, part in parts.items():
        flat = part.reshape(-1)
        for at in range(0, len(flat), max(1, len(flat) // 5)):
            old = flat[at]
            flat[at] = old + 1e-5
            up = loss()
            flat[at] = old - 1e-5
            assert abs((up - loss()) / 2e-5 - gradients[name].reshape(-1)[at]) < 1e-5
            flat[at] = old


def test_odd_rows_and_missing_labels(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "idiot"), (3, "idiot " * 30_000), (3, "idiot " * 30_000)], extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        rows = module.report(docs, none).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert module.report(docs_of([]), none).count() == 0
        one = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, None, 7)], "doc_id long, quality int, toxic int")
        assert module.report(docs, one).count() == 5
    scores = {r.doc_id: r for r in toxicity.report(docs, none).collect()}
    assert scores[3].predicted == 1 and scores[1].score == scores[2].score < 0.5 and scores[None].held_out
    kept = quality.keep_good(docs, 1.0)
    assert kept.columns == docs.columns and kept.count() == 5 and quality.keep_good(docs, 0.1).count() == 0


def test_sample_is_bounded_and_outside_the_held_out_fold(table):
    docs, labels, _ = table
    rows, sizes = labelled.training_rows(docs, labels, "toxic", 7)
    ids = [(r.id, r.y) for r in rows.collect()]
    assert sum(y for _, y in ids) == 7 and len(ids) == 14 and not any(held(k) for k, _ in ids)
    assert sizes[0] + sizes[1] == sum(not held(k) for k in range(400))


def test_toxicity_of_equal_density_is_equal(spark, docs_of):
    part = "some idiot met the old grumpling river and found it calm today "
    docs = docs_of([part * n for n in (1, 2, 10, 100, 1000)])
    model = toxicity.Model(toxicity.Lexicon((("grumpl", 3.5),)))
    scores = [r.score for r in toxicity.score(docs, model).orderBy("id").collect()]
    assert max(scores) - min(scores) < 1e-9 and scores[0] > 0.5


def test_repeated_rows_are_learned_from_once(spark, table):
    docs, labels, _ = table
    many = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id < 20"))
    for module in (toxicity, quality):
        one = {r.doc_id: round(r.score, 9) for r in module.report(docs, labels).collect()}
        assert {r.doc_id: round(r.score, 9) for r in module.report(many, labels).collect()} == one


def test_all_passages_of_sampled_documents_are_used(spark, monkeypatch):
    """The one odd passage of a long document stands anywhere, and its label depends on it."""
    rng, rows = random.Random(4), []
    for k in range(240):
        words = prose(rng, 64 * 150).split()
        if k % 2:
            at = rng.randrange(len(words) - 300)
            words[at:at + 300] = [w + "%%%" for w in words[at:at + 300]]
        rows.append((k, " ".join(words), k % 2))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda x, owner, y, sizes: seen.append(np.bincount(owner)) or train(x, owner, y, sizes))
    got = {r.doc_id: r.predicted for r in quality.report(docs, labels).collect()}
    assert (seen[0] == 150).all() and len(seen[0]) == sum(not held(k) for k in range(240))
    assert np.mean([got[k] == y for k, _, y in rows if held(k)]) >= 0.95
    monkeypatch.setattr(quality, "SAMPLE_PASSAGES", 150 * 20)
    quality.fit(docs, labels)
    assert (seen[1] == 150).all() and len(seen[1]) == 20  # documents are left out whole
