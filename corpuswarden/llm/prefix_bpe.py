"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a prefix ends in one token, and what stands before that token is the
encoding of a shorter prefix. So one token per prefix holds all encodings. The last
token of a prefix is found among the vocabulary's tokens that end there: it is the one
that stays apart from the last token of the prefix before it. Two tokens stay apart if
no merge across their border would have come before the merges that made them.

The table allows exact appends (only new prefixes are computed) and re-encoding near an
edit (the table up to the edit stays valid). Documents are encoded match by match of
the splitting pattern; rows are independent and nothing is shuffled.

Defined results: a null text is empty, an empty text has no ids and decodes to nothing;
repeated rows give repeated results; other columns are ignored. Texts that hold a
special token's string are encoded as plain text. A very long text is encoded match by match,
so beside it and its ids a task holds one match's table.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from corpuswarden.llm.pieces import TextEncoder

# What a task remembers at most; a fifth of a GB in all.
PAIRS = 1 << 18      # pairs of tokens
PIECES = 200_000     # pieces of one generation of a cache


class PrefixBPE:
    """Encoder for a vocabulary of byte strings with ranks, which are also the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        # Every ending of a usable token; its id, or -1 if it is no usable token itself.
        self.endings: dict[bytes, int] = {}
        for token, rank in ranks.items():
            if len(token) == 1 or self._build(token, rank):
                for at in range(1, len(token)):
                    self.endings.setdefault(token[at:], -1)
                self.endings[token] = rank
        self._apart: dict[int, bool] = {}

    def _build(self, token: bytes, rank: int) -> bool:
        """Merge a token from its bytes; its last merge is kept. Some are never reached."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best[0] >= rank:
                return False
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return True

    def apart(self, left: int, right: int) -> bool:
        """Whether `left` and `right` side by side stay two tokens; the answer is remembered.

        The merges are undone from the latest: first the pair itself must not merge,
        then the pair that stood at the border before the later of the two was made,
        and so on. A merge at the border counts if it comes before the one just undone;
        of equal ranks the one further left comes first.
        """
        key = left << 32 | right
        before, apart = len(self.ranks) + 1 << 8, True
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < before:
                apart = False
                break
            undo_left = left in self.halves and (left > right or right not in self.halves)
            if undo_left:
                before, left = left, self.halves[left][1]
            elif right in self.halves:
                before, right = right + 1, self.halves[right][0]
            else:
                break
        if len(self._apart) >= PAIRS:
            self._apart.clear()
        self._apart[key] = apart
        return apart

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Complete `last`, the last token of each prefix of `piece` that is known so far."""
        ending, known, apart = self.endings.get, self._apart.get, self.apart
        for end in range(len(last) + 1, len(piece) + 1):
            start = end - 1
            while True:
                token = ending(piece[start:end])
                if token is None:
                    raise ValueError("the vocabulary does not hold every byte")
                if token >= 0:
                    if not start:
                        break
                    left = last[start - 1]
                    fits = known(left << 32 | token)
                    if fits or (fits is None and apart(left, token)):
                        break
                start -= 1
            last.append(token)
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """Ids of the whole piece, read backwards from its last token."""
        ids, end = [], len(last)
        while end:
            token = last[end - 1]
            ids.append(token)
            end -= len(self.bytes_of[token])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        return self.tokens(self.extend(piece, []))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EncodedText:
    """A text with its prefix tables, for appends and edits.

    The pattern looks one character ahead and never back, and it splits white space
    before a word in two. So an edit changes no match further back than two before its
    own, and once a new match starts where an old one did, the rest is the same.
    """

    def __init__(self, coder: PrefixBPE, pattern: str, text: str = ""):
        self.coder, self.pattern = coder, regex.compile(pattern)
        self.text, self.pieces, self.tables = "", [], []
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, new: str) -> None:
        starts, at = [], 0
        for piece in self.pieces:
            starts.append(at)
            at += len(piece)
        low = max(0, bisect_right(starts, start) - 3)
        moved = len(new) - (end - start)
        old = {s + moved: k for k, s in enumerate(starts) if s >= end}
        self.text = self.text[:start] + new + self.text[end:]
        pieces, tables, high = [], [], len(self.pieces)
        for match in self.pattern.finditer(self.text, starts[low] if starts else 0):
            if match.start() >= start + len(new) and match.start() in old:
                high = old[match.start()]
                break
            near = low + len(pieces)
            pieces.append(match.group())
            tables.append(self._table(match.group().encode(), near))
        self.pieces[low:high], self.tables[low:high] = pieces, tables

    def _table(self, piece: bytes, near: int) -> list[int]:
        """The table of `piece`, on from what it shares with the old piece at its place."""
        shared = 0
        if near < len(self.pieces):
            old = self.pieces[near].encode()
            while shared < min(len(old), len(piece)) and old[shared] == piece[shared]:
                shared += 1
        return self.coder.extend(piece, self.tables[near][:shared] if shared else [])

    def ids(self) -> list[int]:
        return [token for table in self.tables for token in self.coder.tokens(table)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def coder_of(path: str) -> PrefixBPE:
    return PrefixBPE(load_ranks(path))


@lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> TextEncoder:
    coder = coder_of(path)
    return TextEncoder(pattern, lambda piece: array("I", coder.encode(piece.encode())).tobytes(),
                       limit=PIECES)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, ids) per row of `docs`; ids is an array of int."""
    rows = _rows(docs, id_col, text_col)

    def run(batches):
        encoder = encoder_of(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(encoder.encode(t), "<i4") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, decoded) per row of (id, ids); decoded is binary, a null array is empty."""
    def run(batches):
        coder = coder_of(path)
        for batch in batches:
            decoded = [coder.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(decoded, pa.binary())], ["id", "decoded"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, ids): a text is encoded and its ids decoded.

    The decoded bytes, and without `with_ids` the ids, stay in the task that made them.
    """
    rows = _rows(docs, id_col, text_col)

    def run(batches):
        encoder, coder = encoder_of(path, pattern), coder_of(path)
        for batch in batches:
            n, ids_sha, decoded_sha, kept = [], [], [], []
            for text in batch.column("text"):
                packed = encoder.encode(text.as_py())
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                decoded = coder.decode(np.frombuffer(packed, "<u4").tolist())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                kept.append(packed)
            columns = {"id": batch.column("id"), "n_tokens": pa.array(n, pa.int64()),
                       "ids_sha256": pa.array(ids_sha, pa.string()),
                       "decoded_sha256": pa.array(decoded_sha, pa.string())}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(n)), pa.int32()),
                    pa.array(np.frombuffer(b"".join(kept), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                           + ", ids array<int>" * with_ids)


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return round_trip(docs, path, pattern, with_ids=False).withColumnRenamed("id", "doc_id")
