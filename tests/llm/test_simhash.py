import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpuswarden.llm import golay, simhash
from corpuswarden.llm.components import components


def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    shingles = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked(fps, bits=3):
    """Smallest index reachable from each fingerprint."""
    root = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return root


def test_every_word_is_near_one_codeword():
    words = np.arange(1 << golay.LENGTH)[::97]
    errors = golay.ERRORS[golay.syndrome(words)]
    near = [(e >= 0) & (np.bitwise_count(np.abs(e)) <= 3) for e in errors.T]
    assert (sum(n.astype(int) for n in near) == 1).all()
    assert set((golay.ERRORS >= 0).sum(axis=1)) == {1, 6}


def test_words_one_bit_apart_share_a_key():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << golay.LENGTH, 400)
    for bit in range(golay.LENGTH):
        for a, b in zip(golay.keys(words), golay.keys(words ^ (1 << bit))):
            assert set(a[a >= 0]) & set(b[b >= 0])


def test_links_lose_no_pair(spark):
    rng, fps = random.Random(2), []
    for _ in range(60):
        base = rng.getrandbits(64)
        fps += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(4)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3}
    assert got == want


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 300)]
    rng = random.Random(3)
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and got[300] == 0
    assert {got[k] for k in range(100, 140)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(80)] for _ in range(5)]
    out = [None, "", " \t\n", "Two words", "two WORDS", "two\twords", "ÉTÉ", "été"]
    for b in base:
        for _ in range(4):
            c = list(b)
            c[rng.randrange(len(c))] = word()
            out.append(" ".join(c))
        out.append("  ".join(b))
        out.append(" ".join(b).upper())
    return out


def test_groups_match_brute_force(docs_of):
    rows = texts()
    fps = [fingerprint(t) for t in rows]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(docs_of(rows)).collect()}
    assert got == {k: (f"{f:016x}", r) for k, (f, r) in enumerate(zip(fps, linked(fps)))}


def test_keep_one_of_each_group(docs_of):
    rows = texts() + [texts()[-1]] * 3
    docs = docs_of([(k + 5, t) for k, t in enumerate(rows)] + [(5 + len(rows) - 1, rows[-1])] * 2, extra=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {r + 5 for r in linked([fingerprint(t) for t in rows])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_repeated_smallest_row_is_kept_once(docs_of):
    docs = docs_of([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "other words")])
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == [(1, "a b c d"), (None, "other words")]
    assert simhash.groups(docs.where(F.lit(False))).count() == 0


def test_long_text(docs_of):
    text = " ".join(f"w{k % 997}" for k in range(100_000))
    row = simhash.groups(docs_of([text])).first()
    assert int(row.fingerprint, 16) == fingerprint(text)
