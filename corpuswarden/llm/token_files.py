"""Token ids in files compressed by a grammar, for random access.

Documents are put in order of their ids and cut into shards. In a shard, frequent pairs
of symbols are replaced by new symbols, round after round (Re-Pair, many pairs a round):
a rule is a pair of symbols, and each rule stores how many ids it expands to. No pair
crosses the end of a document, so any document, or any range of ids, is decoded from its
own symbols.

A file row is one shard: its place in the order, the document ids, the symbols each
document takes and the ids they expand to, the rules with their expansion lengths, and
the symbols. Parquet holds the rows, so they are written and read by Spark on any store,
and a lost task writes its shards again. A shard has about SHARD_IDS ids, or one longer
document; nothing larger is ever in one place.

Defined results: a null or empty text has only the end id; documents with equal ids
stand next to each other, by length and text; null ids come first; an empty table gives an empty
file; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from corpuswarden.llm.common import sized
from corpuswarden.llm.pieces import TextEncoder

SHARD_IDS = 1 << 20
BROADCAST_SHARDS = 500_000  # starts of shards, 16 bytes each, that are broadcast at most
ROUNDS = 8
LEAST_COUNT = 12        # a pair that occurs less often gets no rule
RULES_A_ROUND = 4096
HASH_BITS = 18
MULTIPLIERS = (0x9E3779B1, 0x9E3779B97F4A7C15)  # spread pairs over the counting table


def _byte_letters() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: itself if it prints."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, dtype=np.uint16
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends, rules): `ends` are where documents end; rule r makes symbol vocabulary + r.

    A round counts all pairs in a hashed table, keeps one pair per cell, counts those
    exactly, and replaces the most frequent. The greatest symbol of `dtype` marks the
    ends while pairs are counted.
    """
    border = np.iinfo(dtype).max
    symbols = np.insert(ids.astype(dtype), ends, border)
    rules = np.zeros((0, 2), dtype=dtype)
    wide, shift, factor = (np.uint32, 16, MULTIPLIERS[0]) if dtype == np.uint16 else (
        np.uint64, 32, MULTIPLIERS[1])
    size = 1 << HASH_BITS
    for _ in range(ROUNDS):
        room = min(RULES_A_ROUND, border - vocabulary - len(rules))
        if room <= 0 or len(symbols) < 2:
            break
        pairs = symbols[:-1].astype(wide)
        pairs <<= wide(shift)
        pairs |= symbols[1:]
        cells = (pairs * wide(factor) >> wide(2 * shift - HASH_BITS)).astype(np.intp)
        # Only cells that are full enough can hold a frequent pair.
        near = np.flatnonzero((np.bincount(cells, minlength=size) >= LEAST_COUNT)[cells])
        pairs, cells = pairs[near], cells[near]
        kept = np.zeros(size, dtype=wide)
        kept[cells] = pairs
        same = np.flatnonzero(kept[cells] == pairs)
        met = cells[same]
        counts = np.bincount(met, minlength=size)
        best = np.flatnonzero(counts >= LEAST_COUNT)
        inside = (kept[best] >> wide(shift) != border) & (kept[best] & wide(border) != border)
        best = best[inside]
        best = best[np.argsort(-counts[best], kind="stable")][:room]
        if not len(best):
            break
        made = np.zeros(size, dtype=dtype)
        made[best] = vocabulary + len(rules) + np.arange(len(best))
        new = made[met]
        picked = np.flatnonzero(new)
        at, new = near[same[picked]], new[picked]
        # Of pairs that overlap, the first, third, ... of a run are replaced.
        close = np.flatnonzero(at[1:] - at[:-1] == 1) + 1
        if len(close):
            starts = np.flatnonzero(np.append(True, close[1:] - close[:-1] > 1))
            run = np.repeat(close[starts], np.append(starts[1:], len(close)) - starts)
            taken = close[(close - run) % 2 == 0]
            at, new = np.delete(at, taken), np.delete(new, taken)
        symbols[at] = new
        stay = np.ones(len(symbols), dtype=bool)
        stay[at + 1] = False
        symbols = symbols[stay]
        added = kept[best]
        rules = np.concatenate([rules, np.stack(
            [(added >> wide(shift)).astype(dtype), added.astype(dtype)], axis=1)])
    marks = np.flatnonzero(symbols == border)
    return np.delete(symbols, marks), marks - np.arange(len(marks)), rules


def _blocks(rules: np.ndarray, vocabulary: int):
    """(start, stop) of runs of rules that use only symbols made before the run: rounds."""
    latest = rules.max(axis=1).astype(np.int64) - vocabulary if len(rules) else np.zeros(0, np.int64)
    start = 0
    while start < len(rules):
        later = np.flatnonzero(latest[start:] >= start)
        stop = start + int(later[0]) if len(later) else len(rules)
        yield start, stop
        start = stop


def lengths_of(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """How many ids each rule expands to."""
    lengths = np.ones(vocabulary + len(rules), dtype=np.uint32)
    for start, stop in _blocks(rules, vocabulary):
        lengths[vocabulary + start:vocabulary + stop] = lengths[rules[start:stop]].sum(axis=1)
    return lengths[vocabulary:]


class Grammar:
    """Expands symbols of one shard."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, vocabulary: int):
        self.lengths = np.concatenate([np.ones(vocabulary, np.int64), lengths.astype(np.int64)])
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths)[:-1]])
        self.ids = np.zeros(int(self.lengths.sum()), dtype=np.uint32)
        self.ids[:vocabulary] = np.arange(vocabulary)
        for start, stop in _blocks(rules, vocabulary):
            made = self.expand(rules[start:stop].ravel())
            at = self.starts[vocabulary + start]
            self.ids[at:at + len(made)] = made

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        lengths = self.lengths[symbols]
        ends = np.cumsum(lengths)
        if not len(ends):
            return np.zeros(0, dtype=np.uint32)
        offset = np.repeat(self.starts[symbols] - (ends - lengths), lengths)
        return self.ids[offset + np.arange(ends[-1])]

    def ids_between(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of what `symbols` expand to, touching only symbols that reach in."""
        ends = np.cumsum(self.lengths[symbols])
        low, high = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[low - 1]) if low else 0
        return self.expand(symbols[low:high])[start - before:stop - before]


def symbol_type(vocabulary: int):
    """Two bytes a symbol if they leave room for a few thousand rules, else four."""
    return np.uint16 if vocabulary + 4096 < 1 << 16 else np.uint32


class AddedTokens:
    """Encodes texts that hold an added token by the library itself, all others by `plain`."""

    def __init__(self, tokenizer: Tokenizer, plain: TextEncoder, kind: str):
        self.tokenizer, self.plain, self.kind = tokenizer, plain, kind
        self.added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.plain.encode(text)


@lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str, added_tokens: bool = False) -> tuple[TextEncoder | AddedTokens, int]:
    """The library's tokenizer, asked once for each piece while the cache holds it.

    Its splitter and its model are called directly, as `encode` does, but without the
    offsets and masks that `encode` makes. A word of letters is one piece, which only
    has to be spelled in the tokenizer's characters for bytes. With `added_tokens` the
    ids are those of `encode` as the library has it by default.
    """
    tokenizer = Tokenizer.from_file(path)
    cut, tokenize = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
    vocabulary, space = tokenizer.get_vocab_size(), BYTE_LETTERS[0x20]
    kind = np.dtype(symbol_type(vocabulary)).char

    def packed(tokens) -> bytes:
        return array(kind, [token.id for token in tokens]).tobytes()

    def spelled(word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)

    def split(text: str) -> bytes:
        return packed([token for piece, _ in cut(text) for token in tokenize(piece)])

    def encode(match: str) -> bytes:
        return packed(tokenize(spelled(match))) if match.isalpha() else split(match)

    def spaced(word: str) -> bytes:
        return packed(tokenize(space + spelled(word)))

    plain = TextEncoder(pattern, encode, spaced, split)
    return AddedTokens(tokenizer, plain, kind) if added_tokens else plain, vocabulary


def _ids_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def shards(docs: DataFrame, path: str, pattern: str, end_id: int = 2, id_col: str = "doc_id",
           text_col: str = "text", shard_ids: int = SHARD_IDS, added_tokens: bool = False) -> DataFrame:
    """One row per shard, in the order of (part, shard).

    The strings of the tokenizer's added tokens are plain text, or with `added_tokens`
    the tokens themselves, as the library's `encode` takes them by default.
    """
    kind = _ids_type(docs, id_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ordered = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).repartitionByRange(
        F.col("id").asc_nulls_first(), F.octet_length("text")).sortWithinPartitions(
        F.col("id").asc_nulls_first(), F.octet_length("text"), "text")
    placed = ordered.select("id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        encoder, vocabulary = encoder_of(path, pattern, added_tokens)
        dtype = np.dtype(symbol_type(vocabulary))
        end, width = np.array([end_id], dtype).tobytes(), dtype.itemsize
        state = {"ids": [], "packed": [], "n": 0, "shard": 0, "type": None}

        def flush(part: int):
            lengths = np.array([len(p) // width for p in state["packed"]], dtype=np.int64)
            everything = np.frombuffer(b"".join(state["packed"]), dtype)
            symbols, ends, rules = compress(everything, np.cumsum(lengths), vocabulary, dtype.type)
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([state["shard"]], pa.int32()),
                pa.array([vocabulary], pa.int32()), pa.array([width], pa.int32()),
                pa.array([int(lengths.sum())], pa.int64()),
                pa.array([state["ids"]], pa.list_(state["type"])),
                pa.array([lengths], pa.list_(pa.int64())),
                pa.array([np.diff(ends, prepend=0)], pa.list_(pa.int64())),
                pa.array([rules.tobytes()], pa.binary()),
                pa.array([lengths_of(rules, vocabulary).tobytes()], pa.binary()),
                pa.array([symbols.tobytes()], pa.binary())],
                ["part", "shard", "vocabulary", "width", "n_ids", "ids", "doc_ids_count",
                 "doc_symbols", "rules", "rule_lengths", "symbols"])
            state.update(ids=[], packed=[], n=0, shard=state["shard"] + 1)
            return row

        part = 0
        for batch in batches:
            part, state["type"] = batch.column("part")[0].as_py() if len(batch) else part, batch.schema.field("id").type
            for one, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                packed = encoder.encode(text.as_py()) + end
                if state["n"] and state["n"] + len(packed) // width > shard_ids:
                    yield flush(part)
                state["ids"].append(one)
                state["packed"].append(packed)
                state["n"] += len(packed) // width
        if state["packed"]:
            yield flush(part)

    return placed.mapInArrow(run, (
        f"part int, shard int, vocabulary int, width int, n_ids long, ids array<{kind}>, "
        "doc_ids_count array<long>, doc_symbols array<long>, rules binary, rule_lengths binary, "
        "symbols binary"))


def write(docs: DataFrame, target: str, path: str, pattern: str, **options) -> None:
    shards(docs, path, pattern, **options).write.parquet(target)


def files(spark: SparkSession, target: str) -> DataFrame:
    """The shards with `start`, the ids before each.

    Totals go through one window per part, and one over the parts, of which there are as
    many as tasks that wrote. They are sent to the shards, which stay where they are, as
    long as there are few enough of them.
    """
    stored = spark.read.parquet(target)
    sizes = stored.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(
        Window.orderBy("part")) - F.col("n")).alias("before_part"))
    within = Window.partitionBy("part").orderBy("shard")
    starts = sizes.withColumn("before", F.sum("n_ids").over(within) - F.col("n_ids")).join(
        parts, "part").select("part", "shard", (F.col("before") + F.col("before_part")).alias("start"))
    return stored.join(sized(starts, BROADCAST_SHARDS)[0], ["part", "shard"])


def _shard(row: dict) -> tuple[Grammar, np.ndarray]:
    dtype = np.uint16 if row["width"] == 2 else np.uint32
    rules = np.frombuffer(row["rules"], dtype).reshape(-1, 2)
    grammar = Grammar(rules, np.frombuffer(row["rule_lengths"], np.uint32), row["vocabulary"])
    return grammar, np.frombuffer(row["symbols"], dtype)


def _decoded(stored: DataFrame, of_ids, out: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """A row per document of the shards: (id, start, n_tokens) and what `of_ids` makes of its ids."""
    kind = stored.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            plain = [n for n in batch.schema.names if n not in ("ids", "doc_ids_count", "doc_symbols")]
            for k, row in enumerate(batch.select(plain).to_pylist()):
                grammar, symbols = _shard(row)
                counts = batch.column("doc_ids_count")[k].values.to_numpy()
                first = np.cumsum(counts) - counts
                everything = grammar.expand(symbols)
                made = [of_ids(everything[a:a + n]) for a, n in zip(first.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[k].values, pa.array(row["start"] + first, pa.int64()),
                     pa.array(counts, pa.int64()),
                     *[pa.array([m[k] for m in made], t) for k, (_, _, t) in enumerate(out)]],
                    ["id", "start", "n_tokens", *[name for name, _, _ in out]])

    return stored.mapInArrow(run, f"id {kind}, start long, n_tokens long, " + ", ".join(
        f"{name} {sql}" for name, sql, _ in out))


def read(spark: SparkSession, target: str) -> DataFrame:
    """(id, start, n_tokens, token_ids) of every document in the files."""
    return _decoded(files(spark, target), lambda ids: (ids.astype(np.int32),), [
        ("token_ids", "array<int>", pa.list_(pa.int32()))])


def read_range(spark: SparkSession, target: str, start: int, stop: int) -> DataFrame:
    """(at, token_ids): ids `start` to `stop` of the whole sequence, one row per shard they touch.

    Only the shards that reach into the range are decoded, and in them only the symbols
    that do.
    """
    stored = files(spark, target).where((F.col("start") < stop) & (
        F.col("start") + F.col("n_ids") > start))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grammar, symbols = _shard(row)
                low = max(start, row["start"])
                ids = grammar.ids_between(symbols, low - row["start"],
                                          min(stop, row["start"] + row["n_ids"]) - row["start"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([low], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))],
                    ["at", "token_ids"])

    return stored.mapInArrow(run, "at long, token_ids array<int>")


def report(spark: SparkSession, target: str) -> DataFrame:
    """What the files hold per document: doc_id, start, n_tokens and the CRC of the ids."""
    return _decoded(files(spark, target), lambda ids: (zlib.crc32(ids),), [
        ("ids_crc32", "long", pa.int64())]).withColumnRenamed("id", "doc_id")
