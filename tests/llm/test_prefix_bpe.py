import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from corpuswarden.llm import pieces, prefix_bpe as pb

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABET = "aeiou tnsrl'sd\n\t  .,!?0129éüßñ日本語中文привет مرحبا 🎉 \x1c\x85ǅ²½"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pb.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return pb.coder_of(PATH)


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_encodes_as_the_library(library):
    encoder = pb.encoder_of(PATH, PATTERN)
    words = ["hello", "Straße", "it's", "12345", "foo.bar", "naïve", "don't!", "x"]
    plain = [" ".join(random.Random(k).choices(words, k=9)).replace("x ", "x\n") for k in range(200)]
    for text in random_texts(3000, 1) + plain + ["", " ", "\n", "a\n\nb", "a  b", " a", "a ", "'s", "a's b"]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text), repr(text)


def test_every_prefix_has_its_own_last_token(coder):
    tik = tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=coder.ranks, special_tokens={})
    for piece in ["internationalisation", "aaaaaaaaaaaaaaaa", "thththththth", "übergrößenträger"]:
        raw = piece.encode()
        last = coder.extend(raw, [])
        for end in range(1, len(raw) + 1):
            ids = coder.tokens(last[:end])
            assert ids[-1] == last[end - 1] and coder.decode(ids) == raw[:end]
            if piece.isascii():
                assert ids == tik.encode_ordinary(piece[:end])


def test_appends_and_edits(library, coder):
    rng, text = random.Random(3), pb.EncodedText(coder, PATTERN)
    for step in range(400):
        start = rng.randint(0, len(text.text))
        end = min(len(text.text), start + rng.randint(0, 6))
        new = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 8)))
        text.append(new) if step % 3 == 0 else text.replace(start, end, new)
        assert text.ids() == library.encode_ordinary(text.text)


def test_append_computes_only_new_prefixes(coder, monkeypatch):
    table = coder.extend(b"international", [])
    before = list(table)
    assert coder.extend(b"internationalise", table)[:len(before)] == before


def test_bounded_cache_gives_equal_results(library, monkeypatch):
    monkeypatch.setattr(pb, "PAIRS", 5)
    coder = pb.PrefixBPE(pb.load_ranks(PATH))
    encoder = pieces.TextEncoder(PATTERN, lambda p: np.array(coder.encode(p.encode()), "<u4").tobytes(),
                                 limit=7)
    for text in random_texts(150, 9):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_query_and_round_trip(library, docs_of):
    texts = [None, "", "<|endoftext|> x", "word " * 40_000] + random_texts(40, 5)
    docs = docs_of([*enumerate(texts), (1, ""), (None, "é")], extra=True)
    rows = pb.report(docs, PATH, PATTERN).collect()
    assert len(rows) == len(texts) + 2
    for row in rows:
        text = "é" if row.doc_id is None else texts[row.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = pb.encode(docs, PATH, PATTERN)
    back = {r.id: bytes(r.decoded).decode() for r in pb.decode(encoded, PATH).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(texts))
    with_ids = pb.round_trip(docs, PATH, PATTERN).collect()
    assert all(r.n_tokens == len(r.ids) for r in with_ids)
    assert pb.report(docs_of([]), PATH, PATTERN).count() == 0
