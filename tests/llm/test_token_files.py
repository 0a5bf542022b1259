import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuswarden.llm import token_files as tf

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.mark.parametrize("dtype", [np.uint16, np.uint32])
@pytest.mark.parametrize("n,kinds", [(0, 5), (1, 5), (3000, 1), (5000, 3), (20_000, 40), (500, 400)])
def test_grammar_round_trip(n, kinds, dtype):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, kinds, n).astype(np.uint32)
    cuts = np.unique(np.append(rng.integers(0, n + 1, 9), n)) if n else np.array([0])
    symbols, ends, rules = tf.compress(ids, cuts, 1000, dtype)
    lengths = tf.lengths_of(rules, 1000)
    grammar = tf.Grammar(rules, lengths, 1000)
    assert np.array_equal(grammar.expand(symbols), ids)
    starts = np.append(0, ends)
    for k, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        low = cuts[k - 1] if k else 0
        assert np.array_equal(grammar.expand(symbols[a:b]), ids[low:cuts[k]])
    if n > 2000:
        assert len(symbols) < n  # something repeats
        assert np.array_equal(grammar.ids_between(symbols, 17, 1900), ids[17:1900])
    for r, (left, right) in enumerate(rules.tolist()):
        one = lambda s: 1 if s < 1000 else int(lengths[s - 1000])
        assert one(left) + one(right) == lengths[r]


def texts():
    rng = random.Random(6)
    return [None, "", "a b c", "x " * 3000, "é\n\n ü", "<|endoftext|>"] + [
        " ".join(rng.choice(["the", "of", "Straße", "123", "foo,"]) for _ in range(rng.randint(0, 80)))
        for _ in range(60)]


def expected():
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    return [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts()]


def test_files_hold_every_id_in_order(spark, docs_of, tmp_path):
    docs = docs_of([(k * 3 - 20, t) for k, t in enumerate(texts())], extra=True)
    target = f"file://{tmp_path}/ids"
    tf.write(docs, target, PATH, PATTERN, shard_ids=500)
    want, at = expected(), 0
    rows = {r.doc_id: r for r in tf.report(spark, target).collect()}
    stored = {r.id: r for r in tf.read(spark, target).collect()}
    assert len(rows) == len(want)
    for k, ids in enumerate(want):
        row = rows[k * 3 - 20]
        assert (row.start, row.n_tokens) == (at, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert stored[k * 3 - 20].token_ids == ids
        at += len(ids)
    assert spark.read.parquet(target).count() > 5
    flat = [i for ids in want for i in ids]
    parts = sorted(tf.read_range(spark, target, 100, 4000).collect(), key=lambda r: r["at"])
    assert [i for p in parts for i in p.token_ids] == flat[100:4000]


def test_repeated_and_null_ids_and_empty_table(spark, docs_of, tmp_path):
    docs = docs_of([(1, "b"), (1, "a"), (None, "c"), (1, "a")])
    tf.write(docs, f"file://{tmp_path}/a", PATH, PATTERN)
    rows = sorted(tf.report(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start) for r in rows] == [(None, 0), (1, 2), (1, 4), (1, 6)]
    tf.write(docs_of([]), f"file://{tmp_path}/b", PATH, PATTERN)
    assert tf.report(spark, f"file://{tmp_path}/b").count() == 0


def test_added_tokens_as_the_library_has_them_by_default(spark, docs_of, tmp_path, monkeypatch):
    from corpuswarden.llm import queries

    held = texts() + ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext|"]
    folder = str(tmp_path)
    docs_of(held).write.parquet(f"file://{folder}/documents.parquet")
    monkeypatch.setattr(queries, "shared_dir", lambda spark: f"file://{folder}/shared")
    rows = {r.doc_id: r for r in queries.op4_token_files(spark, f"file://{folder}").collect()}
    library, at = Tokenizer.from_file(PATH), 0
    for k, text in enumerate(held):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (rows[k].start, rows[k].n_tokens) == (at, len(ids)), text
        assert rows[k].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()), text
        at += len(ids)
