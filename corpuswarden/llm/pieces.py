"""Texts encoded piece by piece, with a bounded cache of what pieces encode to."""

from __future__ import annotations

import string
from collections.abc import Callable

import regex

LIMIT = 600_000  # pieces of one generation of a cache
MARKS = string.punctuation
# White space other than the plain space and the line break.
ODD_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def _plain(text: str) -> bool:
    """Whether words are separated by single spaces or line breaks and by nothing else."""
    return bool(text) and not (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n " in text or " \n" in text
        or "\n\n" in text or any(space in text for space in ODD_SPACES))


class Pieces(dict):
    """piece -> packed ids; a missing piece is encoded and kept.

    A full cache becomes the old generation, from which a piece that comes again is
    taken over. So pieces in use stay, and the many that occur once are let go.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int = LIMIT):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Words(Pieces):
    """Words between spaces; letters and the run of marks after them are two matches."""

    def __init__(self, letters: Callable[[str], bytes], other: Callable[[str], bytes], marks: Pieces):
        super().__init__(self._encode, marks.limit)
        self.letters, self.other, self.marks = letters, other, marks

    def _encode(self, piece: str) -> bytes:
        if piece.isalpha():
            return self.letters(piece)
        word = piece.rstrip(MARKS)
        if word.isalpha():
            return self[word] + self.marks[piece[len(word):]]
        return self.other(piece)


class TextEncoder:
    """Packed ids of whole texts, for tokenizers that split a text by a pattern first.

    The byte-level pattern starts a new match at a space between two characters that
    are not white space, and makes a single line break a match of its own. So a text
    whose only white space is single spaces and line breaks between words is encoded
    word by word, a word taking the space before it. Any other text is split by the
    pattern itself.

    `encode` takes one match. `spaced` takes the letters of a match that begins with a
    space, and `split` a word with marks inside, if the tokenizer has its own way.
    """

    def __init__(self, pattern: str, encode: Callable[[str], bytes],
                 spaced: Callable[[str], bytes] | None = None,
                 split: Callable[[str], bytes] | None = None, limit: int = LIMIT):
        self.find = regex.compile(pattern).findall
        self.matches = Pieces(encode, limit)
        spaced, split = spaced or (lambda word: encode(" " + word)), split or self._split
        self.first = Words(encode, split, self.matches)
        self.rest = Words(spaced, lambda word: split(" " + word), self.matches)

    def _split(self, text: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        if not _plain(text):
            return self._split(text)
        rest, out = self.rest.__getitem__, []
        for line in text.split("\n"):
            words = iter(line.split(" "))
            out.append(self.first[next(words)])
            out.extend(map(rest, words))
            out.append(self.matches["\n"])
        return b"".join(out[:-1])
