import random

import numpy as np
import pytest

from corpuswarden.llm import chunk_dedup as cd


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuvwyzé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_gear_hash_equals_the_rolling_one():
    data = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    h, out = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(cd.GEAR[b])) & 0xFFFF
        out.append(h)
    assert cd.gear_hashes(data).tolist() == out


@pytest.mark.parametrize("text", ["", "a", "é" * 9000, "ab" * 9000, "日本語" * 4000, words(random.Random(2), 4000)])
def test_chunks_cover_the_text_and_cut_whole_characters(text):
    raw = text.encode()
    counts, places, _ = cd._slice(raw, np.array([0, len(raw)]))
    assert counts.sum() == len(places)
    at = 0
    for place in places.tolist():
        start, size, words = (int(x) for x in cd.unpack(np.int64(place)))
        assert start == at and 0 < size <= cd.MOST + 3
        part = raw[start:start + size].decode()
        own = len(part.split()) - (start > 0 and not raw[start - 1:start].isspace() and not part[:1].isspace())
        assert words == min(own, cd.MOST_WORDS)
        at += size
    assert at == len(raw)


def test_chunks_do_not_depend_on_neighbouring_texts():
    rng = random.Random(3)
    texts = [words(rng, rng.randint(0, 60)).encode() for _ in range(40)] + [b""]
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    counts, places, digests = cd._slice(b"".join(texts), offsets)
    at = 0
    for text, n in zip(texts, counts):
        _, own_places, own_digests = cd._slice(text, np.array([0, len(text)]))
        assert own_places.tolist() == places[at:at + n].tolist()
        assert own_digests.tolist() == digests[at:at + n].tolist()
        at += n


def test_digests_resist_insertions():
    rng = random.Random(4)
    text = words(rng, 400)
    _, _, before = cd._slice(text.encode(), np.array([0, len(text.encode())]))
    moved = (text[:500] + " inserted " + text[500:]).encode()
    _, _, after = cd._slice(moved, np.array([0, len(moved)]))
    assert len(set(before.tolist()) - set(after.tolist())) <= 4


def planted(rng):
    passages = [words(rng, rng.randint(51, 80)) for _ in range(25)]
    rows, holders = [], {}
    for k in range(100):
        text = words(rng, rng.randint(0, 80))
        if k % 2 == 0:
            p = rng.randrange(25)
            holders.setdefault(p, []).append(k)
            text = f"{text} {passages[p]} {words(rng, rng.randint(0, 60))}"
        rows.append((k, text))
    return rows, {k for ks in holders.values() if len(ks) > 1 for k in ks}, passages


def test_finds_planted_passages_and_spares_the_rest(docs_of):
    rows, want, _ = planted(random.Random(5))
    got = {r.doc_id for r in cd.report(docs_of(rows, extra=True)).collect() if r.repeated}
    assert got <= want and len(got) >= 0.95 * len(want)


def longest_shared(texts):
    """Per text the most words in a row that some other text holds too."""
    out = []
    cut = [t.split() for t in texts]
    for k, own in enumerate(cut):
        grams = {n: {tuple(w[i:i + n]) for j, w in enumerate(cut) if j != k for i in range(len(w) - n + 1)}
                 for n in (25, 51)}
        out.append(max([n for n in (25, 51) if any(
            tuple(own[i:i + n]) in grams[n] for i in range(len(own) - n + 1))], default=0))
    return out


SHORT = ("the of and a to in is you that it he was for on are as with his they I at be this have from or one had by "
         "word but not what all were we when your can said there use an each which she do how their if will up").split()


@pytest.mark.parametrize("made", ["short", "long", "lines"])
def test_passages_match_true_common_substrings(docs_of, made):
    """51 words in a row that another text holds are found, 24 or fewer never are."""
    rng = random.Random(10)

    def some(n):
        if made == "long":
            return " ".join("".join(rng.choice("abcdefghiklmnoprstuvwyz") for _ in range(rng.randint(8, 15))) for _ in range(n))
        return " ".join(rng.choice(SHORT) for _ in range(n))

    shared = [some(51 if k % 2 else 24 if made != "lines" else 11) for k in range(120)]
    texts = []
    for k in range(360):
        text = some(rng.randint(1, 60)) + " "
        if made == "lines":  # two common lines in a row are no passage
            text += f"\n{shared[0]}\n{shared[2]}\n" if k % 3 else ""
        if k % 3:
            text += shared[rng.randrange(120)] + " "
        texts.append(text + some(rng.randint(1, 60)))
    truth = longest_shared(texts)
    got = {r.doc_id: r.repeated for r in cd.report(docs_of(texts)).collect()}
    holders = [k for k, n in enumerate(truth) if n == 51]
    others = [k for k, n in enumerate(truth) if n == 0 or made == "lines" and n < 51]
    assert len(holders) > 50 and len(others) > 100
    assert sum(got[k] for k in holders) >= 0.99 * len(holders)
    assert sum(got[k] for k in others) <= 0.02 * len(others)


def test_spans_lie_in_shared_text(docs_of):
    rows, _, passages = planted(random.Random(6))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, ""), (204, "x")]
    texts = {k: (t or "").encode() for k, t in rows}
    for row in cd.scan(docs_of(rows)).collect():
        raw = texts[row.id]
        for name, others in (("repeated", lambda k: k != row.id), ("removable", lambda k: k < row.id)):
            for span in row[name]:
                part = raw[span["start"]:span["end"]]
                assert part and any(part in text for k, text in texts.items() if others(k))


def test_pairs_and_not_single_chunks_repeat(docs_of):
    rng = random.Random(12)
    one, two = words(rng, 300), words(rng, 300)
    mixed = one.split()
    mixed[1::2] = two.split()[1::2]  # every second word from elsewhere: no two chunks stay together
    rows = cd.report(docs_of([one, " ".join(mixed)])).collect()
    assert not any(r.repeated for r in rows)


def test_long_texts_and_writing_without_spaces(docs_of):
    rng = random.Random(13)
    kanji = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(400))
    long = words(rng, 60_000)
    texts = [f"a {kanji}", f"b {kanji} c", long, "x" + long[100:], "y" * 200_000, "z" + "y" * 200_000]
    got = {r.doc_id: r for r in cd.report(docs_of(texts)).collect()}
    assert all(got[k].repeated for k in range(6))
    assert got[3].removable_bytes >= 0.99 * len(long.encode()) and got[2].removable_bytes == 0


def test_removal_keeps_the_first_document(docs_of):
    rng = random.Random(7)
    passage = words(rng, 120)
    docs = docs_of([(1, f"start {passage}"), (2, f"{words(rng, 30)} {passage} end"), (3, None), (4, passage)], extra=True)
    new = cd.remove_repeats(docs)
    assert new.columns == docs.columns
    texts = {r.doc_id: r.text for r in new.collect()}
    assert texts[1] == f"start {passage}" and texts[3] is None
    assert texts[2].endswith("end") and len(texts[2]) < len(passage) and len(texts[4]) < 120


def test_equal_ids_are_one_document(spark, docs_of):
    text = words(random.Random(8), 100)
    same = cd.report(docs_of([(1, text), (1, text), (None, text)])).collect()
    assert len(same) == 3 and not any(r.repeated for r in same)
    assert cd.report(docs_of([])).count() == 0
