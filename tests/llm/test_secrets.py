import random
import re
import time
from math import log2

import pyarrow as pa
import pytest

from corpuswarden.llm import secrets as sc

TEXTS = [
    None, "", "nothing", 'password = "hunter2hunter2"', "PASSWD:abc", "token: token=short secret=é",
    "api_key='abcdefgh' apikey: ABCDEFGH12 api__key=abcdefgh", "AKIA" + "A1" * 8 + " AKIAshort xAKIA" + "Z" * 12,
    "é" + "0123456789abcdef" * 3 + "g" + "deadbeef" * 4 + "DEADBEEF" * 4, "secretly = nothing1",
    "İſecret=12345678 toKen=12345678 token\n=12345678", "password=" + "x" * 40_000 + " " + "ab" * 50,
]


def brute(text):
    text, out = text or "", []
    for m in sc.ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            out.append((m.start(), "assign", m.end()))
    out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], sc.KINDS.index(s[1])))


def test_base_spans_match_brute_force(docs_of):
    rows = {r.doc_id: r for r in sc.report(docs_of(TEXTS)).collect()}
    for k, text in enumerate(TEXTS):
        base, row = brute(text), rows[k]
        assert [getattr(row, f"n_{kind}") for kind in sc.KINDS[:3]] == [
            sum(s[1] == kind for s in base) for kind in sc.KINDS[:3]], text
        kept = [s for s in row.spans.split(",") if s and not s.startswith("entropy")]
        assert kept == [f"{kind}:{s}:{e}" for s, kind, e in base]


def test_slices_and_offsets_do_not_matter(monkeypatch):
    texts = pa.array([t or "" for t in TEXTS * 3])
    whole = dict(sc._batch(texts))
    monkeypatch.setattr(sc, "SLICE_BYTES", 50)
    assert dict(sc._batch(texts)) == whole
    part = dict(sc._batch(texts.slice(5, 10)))
    assert part == {k - 5: v for k, v in whole.items() if 5 <= k < 15}


def entropy(s):
    return -sum(s.count(c) / len(s) * log2(s.count(c) / len(s)) for c in set(s))


@pytest.mark.parametrize("alphabet", ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_windows_match_entropy_of_each_slice(alphabet):
    rng = random.Random(5)
    for _ in range(60):
        s = "".join(rng.choice(alphabet[:rng.randint(8, len(alphabet))]) for _ in range(rng.randint(20, 70)))
        raw = s.encode()
        bits = sc.HEX_BITS if sc.IS_HEX.fullmatch(raw) else sc.MIXED_BITS
        inside = set()
        if not sc.allowed(raw):
            for a in range(len(s) - sc.WINDOW + 1):
                if entropy(s[a:a + sc.WINDOW]) >= bits - 1e-9:
                    inside |= set(range(a, a + sc.WINDOW))
        assert {x for a, b in sc.entropy_spans(raw) for x in range(a, b)} == inside


def test_entropy_kind_and_allow_list(docs_of):
    key = "Zx81kQp0vLr7TnY3wBc5Jm2Hd9Sf4Ga6"
    allowed = ["550e8400-e29b-41d4-a716-446655440000", "integrity=sha256-" + key + key[:11] + "=", "my-long-identifier-name-2-is-fine",
               "src/long/path/to/some/module_3/file_name", "abcdefghijklmnopqrstuvwxyz0123456789",
               "aB3xaB3xaB3xaB3xaB3xaB3xaB3xaB3x", "Donaudampfschifffahrtsgesellschaft", "1234567890123456789012345"]
    rows = [r.spans for r in sc.report(docs_of([f"é {key}.", *allowed])).orderBy("doc_id").collect()]
    assert rows == [f"entropy:2:{2 + len(key)}"] + [""] * len(allowed)


@pytest.mark.parametrize("before", ["example/", "sample_id=", "x-example-", "sha256-", "placeholder=", "a/b/c/",
                                    "my-long-name-", "sha256-digest/"])
@pytest.mark.parametrize("after", ["", "-example", "/sample", "=placeholder"])
def test_words_beside_a_key_hide_nothing(before, after):
    rng, found = random.Random(3), 0
    for alphabet in ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789",
                     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
        for _ in range(100):
            key = "".join(rng.choice(alphabet) for _ in range(40))
            inside = {x for a, b in sc.entropy_spans((before + key + after).encode()) for x in range(a, b)}
            found += sum(x in inside for x in range(len(before), len(before) + 40)) >= 36
    assert found >= 285


def test_digests_are_no_secrets():
    rng = random.Random(4)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for name, digits, chars, end in (("sha1", 40, 27, "="), ("sha256", 64, 43, "="), ("sha384", 96, 64, ""), ("sha512", 128, 86, "==")):
        hexed = "".join(rng.choice("0123456789abcdef") for _ in range(digits))
        based = "".join(rng.choice(b64) for _ in range(chars)) + end
        for value in (hexed, based):
            for before in ("", "integrity=", "a/b-"):
                assert sc.entropy_spans(f"{before}{name}-{value}".encode()) == [], (name, value)


def slow_spans(text):
    """The spans of one text, every place decoded and every pair compared."""
    raw, out = text.encode(), [(s, sc.KINDS.index(k), e) for s, k, e in brute(text)]
    base = list(out)
    for m in re.finditer(rb"[A-Za-z0-9+/_=-]{24,}", raw):
        for a, b in sc.entropy_spans(m.group()):
            s = len(raw[:m.start() + a].decode())
            if all(s + b - a <= x or y <= s for x, _, y in base):
                out.append((s, 3, s + b - a))
    return sorted(out)


def test_many_spans_match_pair_by_pair():
    rng = random.Random(6)
    for trial in range(20):
        parts = []
        for _ in range(60):
            key = "".join(rng.choice("0123456789abcdefXYZ" if rng.random() < .5 else "0123456789abcdef")
                          for _ in range(rng.choice([20, 24, 32, 40])))
            parts.append(rng.choice(["", "é😀 ", "password=", "token: ", "AKIA", "x-", "\n"]) + key)
        text = rng.choice([" ", "é", "", "."]).join(parts)
        got = dict(sc._batch(pa.array([text]))).get(0, [])
        assert [(s, k, e) for s, k, e, _ in got] == slow_spans(text)


@pytest.mark.parametrize("alphabet", ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
def test_a_text_of_many_keys_takes_linear_time(alphabet):
    rng = random.Random(7)

    def seconds(n):
        text = "é " + " ".join("".join(rng.choices(alphabet, k=40)) for _ in range(n))
        began = time.process_time()
        found = dict(sc._batch(pa.array([text])))
        assert len(found[0]) > 0.98 * n
        return time.process_time() - began

    seconds(500)
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.1)


def test_redaction(docs_of):
    docs = docs_of(["token = 'abcdefgh12' ok", "clean", None, "x " + "0123456789abcdef" * 2], extra=True).selectExpr(
        "*", "length(text) as n_chars")
    new = sc.redact(docs, length_col="n_chars")
    assert new.columns == docs.columns
    assert [(r.text, r.n_chars) for r in new.orderBy("doc_id").collect()] == [
        ("token = '[REDACTED]' ok", 23), ("clean", 5), (None, None), ("x [REDACTED]", 12)]


def test_allow_list_is_linear():
    assert sc.allowed(b"a-" * 20_000 + b"Z9xZ9xZ9xZ9xZ9x!") in (True, False)
    assert not sc.allowed(b"a1b-" * 9 + b"Z9x" * 3 + b"aaaaabbbbbbccccc")


def test_repeated_rows_and_empty_table(docs_of):
    assert sc.scan(docs_of([(1, TEXTS[3]), (1, TEXTS[3]), (None, TEXTS[3])])).count() == 3
    assert sc.scan(docs_of([])).count() == 0


@pytest.mark.parametrize("prefix", ["", "x-", "sig=", "id_", "a/b+", "0x", "Key9="])
@pytest.mark.parametrize("alphabet,least", [
    ("0123456789abcdef", 24), ("0123456789ABCDEF", 24), ("0123456789ABCDEF", 64),
    ("abcdefghijklmnopqrstuvwxyz0123456789", 24), ("abcdefghijklmnopqrstuvwxyz0123456789", 40),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 32),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 40)])
def test_keys_of_every_class_are_found_behind_a_prefix(prefix, alphabet, least):
    rng, found, trials = random.Random(8), 0, 300
    for _ in range(trials):
        key = "".join(rng.choice(alphabet) for _ in range(least))
        spans = sc.entropy_spans((prefix + key).encode())
        inside = {x for a, b in spans for x in range(a, b)}
        # Almost all of the key, as a window at its edge may be one that falls short.
        covered = sum(x in inside for x in range(len(prefix), len(prefix) + least))
        found += covered >= 0.9 * least
    assert found >= (0.9 if len(alphabet) == 62 else 0.95) * trials


def test_names_and_numbers_behind_a_prefix_are_no_keys():
    for name in [b"x-550e8400-e29b-41d4-a716-446655440000", b"id=1234567890123456789012345678901",
                 b"x9_/donaudampfschifffahrtsgesellschaft12", b"n-123456789012345678901234567"]:
        assert sc.entropy_spans(name) == [], name
