"""Passages that repeat across documents, found by content-defined chunks.

A gear rolling hash of the last 16 bytes decides where a text is cut, so equal passages
are cut alike wherever they stand, whatever was inserted before them. Two neighbouring
chunks are compared by one digest: a chunk alone is a few words that any other text may
hold by chance. A run of neighbouring chunks that another document holds too is a repeated
passage if it can be long enough: the passage goes on into the chunks at both ends of
the run, so their words count as well, and a passage of `LEAST_WORDS` is never too
short for the test. The document with the smallest id keeps passages, and they can be
cut from the others.

A task cuts a batch of texts as one byte array. Digests are aggregated to their first
and last document before they are shuffled, only repeated ones are joined back to the
chunks, both sides by a plain shuffle on the digest, and the chunks of one document meet
again under its key. No group of occurrences is collected.

Defined results: a null or empty text has one empty chunk, which never repeats; rows
with equal ids are one document, so what only they share does not repeat across
documents; rows with a null id are told apart from no other and never make a passage
repeat; rows that repeat an id and a text each get the same result; other columns are
ignored by `scan` and kept by `remove_repeats`. Very long texts are cut whole, a slice of
them at a time never, so a task holds the longest one. Positions are bytes of the UTF-8
text. Words are what stands between white space; of writing without it ten bytes count
as one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from corpuswarden.llm.common import durable, whole_row

RATE = 20        # a byte in so many ends a chunk
LEAST = 6        # a cut this close to the cut position before is dropped
MOST = 4096      # a chunk is cut at this length
WINDOW = 16      # bytes the rolling hash covers, as many as it has bits
LEAST_WORDS = 51  # words that a run and the chunks at its ends must have to be a passage
WORD_BYTES = 10   # bytes that count as a word where there are fewer words
SLICE_BYTES = 4 << 20
# A place packs the start of a chunk, its words (up to MOST_WORDS) and its length.
LENGTH_BITS, WORD_BITS = 13, 7
MOST_WORDS = (1 << WORD_BITS) - 1
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

# One pseudo-random number per byte value.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=42) & 0xFFFF for b in range(256)], np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, the sum of GEAR[b] << k over the bytes b, k places back.

    Doubling the window four times gives what shifting in one byte after another does.
    """
    h, width = GEAR[data], 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint16(width)
        h, width = wider, width * 2
    return h


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, texts) of all chunks of the texts that lie one after another in `data`.

    A cut needs a full window inside its own text, stands before a whole character, and
    is dropped if another possible cut is less than LEAST bytes before it.
    """
    cut = np.flatnonzero(gear_hashes(data) < (1 << 16) // RATE) + 1 if len(data) else np.zeros(0, np.int64)
    cut = cut[cut < len(data)]
    text = np.searchsorted(offsets, cut, "right") - 1
    cut = cut[(cut - offsets[text] >= WINDOW) & (data[cut] & 0xC0 != 0x80)]
    cut = cut[np.diff(cut, prepend=-LEAST) >= LEAST]
    starts = np.union1d(offsets[:-1], cut)
    sizes = np.diff(starts, append=offsets[-1])
    if len(sizes) and sizes.max() > MOST:
        extra = (sizes - 1) // MOST
        base = np.repeat(starts, extra)
        step = np.arange(len(base)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        forced = base + step * MOST
        for _ in range(3):  # not inside a character
            forced = np.where(data[forced] & 0xC0 == 0x80, forced - 1, forced)
        starts = np.union1d(starts, forced)
    return starts, np.searchsorted(offsets, starts, "right") - 1


def pack(starts: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (starts << WORD_BITS | np.minimum(words, MOST_WORDS)) << LENGTH_BITS | lengths


def unpack(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, words) of chunks."""
    return (places >> LENGTH_BITS + WORD_BITS, places & (1 << LENGTH_BITS) - 1,
            places >> LENGTH_BITS & MOST_WORDS)


def pair_digests(digests: np.ndarray) -> np.ndarray:
    """A digest of each chunk and the next one, from the digests of both."""
    d = digests.view(np.uint64)
    x = d[:-1] * np.uint64(0x9E3779B97F4A7C15) + d[1:]
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(31)).view(np.int64)


def _slice(raw: bytes, offsets: np.ndarray):
    """Per text of a slice the packed places and the digests of its chunks.

    The digest that stands with a chunk is that of the chunk and the next; the last
    chunk of a text has none, and 0 stands for it.
    """
    filled = np.flatnonzero(np.diff(offsets))
    compact = np.append(offsets[filled], offsets[-1])
    data = np.frombuffer(raw, np.uint8)
    starts, owner = chunk_starts(data, compact)
    ends = np.append(starts[1:], compact[-1])
    digests = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(
        starts.tolist(), ends.tolist())], dtype=np.uint64).view(np.int64)
    spaces = SPACES[data]
    begins = ~spaces
    begins[1:] &= spaces[:-1]
    begins[compact[:-1]] = ~spaces[compact[:-1]]  # a text begins a word too
    words = np.append(np.int32(0), np.cumsum(begins, dtype=np.int32))
    places = pack(starts - compact[owner], ends - starts, words[ends] - words[starts])
    pairs = np.zeros(len(digests), np.int64)
    pairs[:-1] = pair_digests(digests)
    pairs[np.append(np.flatnonzero(np.diff(owner)), len(owner) - 1) if len(owner) else []] = 0
    counts = np.zeros(len(offsets) - 1, np.int64)
    counts[filled] = np.bincount(owner, minlength=len(filled)) if len(filled) else 0
    return counts, places, pairs


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc, n_bytes, places, digests) per row of `docs`.

    `doc` is equal for rows that repeat an id and a text; a place packs a chunk's start
    and length.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(
        F.col(f"`{id_col}`"), F.xxhash64(text)).alias("doc"), text.alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data, low, parts = texts.buffers()[2], 0, []
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1)
                raw = bytes(data[offsets[low]:offsets[high]]) if data is not None else b""
                parts.append(_slice(raw, offsets[low:high + 1] - offsets[low]))
                low = high
            counts, places, digests = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, int)] * 3
            ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("doc"), pa.array(np.diff(offsets), pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(places, pa.int64())),
                pa.ListArray.from_arrays(ends, pa.array(digests, pa.int64()))],
                ["id", "doc", "n_bytes", "places", "digests"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, doc long, n_bytes long, places array<long>, digests array<long>")


def _runs(places: np.ndarray, met: np.ndarray, least: int) -> tuple[int, list[dict]]:
    """How many chunks repeat, and the passages among them.

    `places` are all chunks of a text and `met` the numbers of those that repeat with the next one.
    """
    if not len(met):
        return 0, []
    starts, lengths, words = unpack(places)
    sizes = np.maximum(words, lengths // WORD_BYTES)
    inside = np.zeros(len(starts) + 2, bool)  # with room at both ends
    inside[met + 1] = inside[met + 2] = True
    edges = np.flatnonzero(np.diff(inside))
    total = np.concatenate([[0, 0], np.cumsum(sizes), [sizes.sum()]])
    found = []
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):  # chunks low to high - 1
        # With the chunk before the run and the one after it. A cut in the first bytes of a
        # passage depends on what stands before, so as many more bytes are taken to be like it.
        size, length = total[high + 1] - total[low + 1], starts[high - 1] + lengths[high - 1] - starts[low]
        if total[high + 2] - total[low] + -(-(WINDOW + LEAST) * size // length) >= least:
            found.append(dict(start=int(starts[low]), end=int(starts[high - 1] + lengths[high - 1])))
    return int(inside.sum()), found


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("n", T.LongType()), T.StructField("spans", SPANS)])


def passages(least: int):
    @F.pandas_udf(FOUND)
    def of_places(places: pd.Series, met: pd.Series) -> pd.DataFrame:
        made = [_runs(np.asarray(p, np.int64), np.asarray(m, np.int64), least) for p, m in zip(places, met)]
        return pd.DataFrame(made, columns=["n", "spans"])
    return of_places


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row of `docs`: (id, doc, n_bytes, n_chunks, n_repeated, repeated, removable).

    `repeated` are the passages other documents hold too, `removable` those of them
    that a document with a smaller id holds.
    """
    # The numbers of the rows are written with them, so they stay when a task runs again.
    cut = durable(chunks(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    each = cut.select("row", "id", F.posexplode("digests").alias("at", "digest")).where("digest <> 0")
    known = durable(each.groupBy("digest").agg(
        F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"))
    met = each.select("row", "at", "digest").join(known, "digest").select("row", "at", "first")
    of_row = met.groupBy("row").agg(F.collect_list(F.struct("at", "first")).alias("met"))
    rows = cut.select("row", "id", "doc", "n_bytes", "places").join(of_row, "row", "left")
    none = F.expr("cast(array() as array<int>)")
    later = F.transform(F.filter("met", lambda m: m["first"] < F.col("id")), lambda m: m["at"])
    runs = passages(least_words)
    found = rows.select(
        "id", "doc", "n_bytes", F.size("places").cast("long").alias("n_chunks"),
        runs("places", F.coalesce(F.col("met.at"), none)).alias("all"),
        runs("places", F.coalesce(later, none)).alias("later"))
    return found.select("id", "doc", "n_bytes", "n_chunks", F.col("all.n").alias("n_repeated"),
                        F.col("all.spans").alias("repeated"), F.col("later.spans").alias("removable"))


@F.pandas_udf(T.StringType())
def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, cut in zip(texts, spans):
        if text is not None and cut is not None and len(cut):
            raw, at, parts = text.encode(), 0, []
            for span in cut:
                parts.append(raw[at:span["start"]])
                at = span["end"]
            text = (b"".join(parts) + raw[at:]).decode()
        out.append(text)
    return pd.Series(out, dtype=object)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` with repeated passages cut from the texts of all but their first document."""
    found = scan(docs, id_col, text_col, least_words).where(F.size("removable") > 0).select(
        F.col("id").alias("met_id"), F.col("doc").alias("met_doc"), "removable").dropDuplicates(["met_id", "met_doc"])
    rows = docs.select(whole_row(docs).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(
        F.col(f"`{id_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("doc"))
    met = rows.join(found, F.col("id").eqNullSafe(F.col("met_id")) & (F.col("doc") == F.col("met_doc")), "left")
    new = met.select("row", without(F.col(f"row.`{text_col}`"), F.col("removable")).alias("new"))
    return new.select(*[(F.col("new") if c == text_col else F.col(f"row.`{c}`")).alias(c)
                        for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    def bytes_of(spans: str):
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))

    listed = F.array_join(F.transform("repeated", lambda s: F.concat_ws(
        ":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scan(docs).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_chunks", F.col("n_repeated").alias("n_repeated_chunks"),
        F.size("repeated").cast("long").alias("n_passages"), bytes_of("repeated").alias("repeated_bytes"),
        bytes_of("removable").alias("removable_bytes"), listed.alias("passages"),
        (F.size("repeated") > 0).alias("repeated"))
