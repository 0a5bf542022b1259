"""SimHash near-duplicates found through Golay-code keys.

A fingerprint has 64 bits; equal fingerprints are one node. Two fingerprints within 3
bits agree on at least one of four 16-bit blocks. The other 48 bits are two halves of
24, and one of these holds at most one of the 3 errors. So they share a key (block,
half, exact block, Golay key of the half's first 23 bits). Nodes are joined on these
keys, every candidate is verified on all 64 bits, and documents take the component of
their fingerprint.

A key of one block and one half holds 28 bits. Each node has 8 to 48 keys, and only
distinct fingerprints are joined, so large groups of copies cost one node.

Defined results: a null text, an empty one or one of separators only has fingerprint
zero and is linked like any other; fewer words than a shingle make one shingle; rows
that repeat an id and a text are each returned by `groups`, and `keep_one` keeps one of
them; a null id is returned, and is a group's smallest only if all its ids are null;
other columns are ignored by `groups` and kept by `keep_one`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpuswarden.llm import golay
from corpuswarden.llm.common import ascii_lower, durable, split_words, whole_row
from corpuswarden.llm.components import components

SHINGLE = 3
MAX_BITS = 3  # what the keys are complete for
# Fixed value: what separates words in the contract.
BREAKS = r"[\x20\x09-\x0D]+"
BLOCK = 1 << 16  # shingles counted at a time


def _fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in more than half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[at:at + BLOCK], dtype="<i8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def majority(hashes: pa.Array) -> pa.Array:
    values, ends = np.asarray(hashes.flatten()), np.cumsum([0, *map(len, hashes)])
    return pa.array([_fingerprint(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id, digest, fp) per row of `docs`."""
    text = F.col(f"`{text_col}`")
    parts = docs.select(F.col(f"`{id_col}`").alias("id"),
                        F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"),
                        split_words(ascii_lower(text), BREAKS).alias("w"))
    last = F.greatest(F.size("w") - shingle, F.lit(0))
    hashes = F.when(F.size("w") == 0, F.expr("cast(array() as array<bigint>)")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
            F.concat_ws(" ", *[F.get("w", i + k) for k in range(shingle)]))))
    return parts.select("id", "digest", majority(hashes).alias("fp"))


@F.arrow_udf(T.ArrayType(T.LongType()))
def fuzzy_keys(fps: pa.Array) -> pa.Array:
    """Keys of each fingerprint: block, half, exact block and Golay key, packed."""
    bits = fps.to_numpy(zero_copy_only=False).view(np.uint64)
    blocks = [(bits >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64) for b in range(4)]
    packed = []
    for exact in range(4):
        x, y, z = (blocks[b] for b in range(4) if b != exact)
        rest = x | y << 16 | z << 32
        for half in range(2):
            code = golay.keys(rest >> 24 * half & 0x7FFFFF)
            key = (exact * 2 + half) << 28 | blocks[exact] << 12
            packed.append(np.where(code == golay.NONE, golay.NONE, key[:, None] | code))
    rows = np.concatenate(packed, axis=1)
    used = rows != golay.NONE
    ends = np.append(0, np.cumsum(used.sum(axis=1)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows[used], pa.int64()))


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints `nodes` (fp) within `max_bits`."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys are complete for at most {MAX_BITS} bits")
    keyed = durable(nodes.select("fp", F.explode(fuzzy_keys("fp")).alias("key")))
    left = keyed.select("key", F.col("fp").alias("a"))
    right = keyed.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & near
                     ).select("a", "b").distinct()


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, digest, fp, component) per row of `docs`; component is the group's smallest id."""
    rows = durable(fingerprints(docs, id_col, text_col, shingle))
    nodes = durable(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = durable(rooted.join(smallest, "root").select(F.col("fp").alias("node"), "component"))
    return rows.join(named, rows["fp"] == named["node"]).select("id", "digest", "fp", "component")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component) per row of `docs`."""
    return members(docs, id_col, text_col, shingle, max_bits).select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group with all its columns: that of the smallest id."""
    found = durable(members(docs, id_col, text_col, shingle, max_bits))
    first = found.groupBy("component").agg(F.min(F.struct(
        F.col("id").isNull().alias("last"), "id", "digest")).alias("kept")).select("kept.id", "kept.digest")
    rows = docs.select(
        whole_row(docs).alias("row"), F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("digest"))
    kept = rows.join(first, rows["id"].eqNullSafe(first["id"]) & (rows["digest"] == first["digest"]),
                     "left_semi")
    return kept.groupBy("id", "digest").agg(F.first("row").alias("row")).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    return groups(docs).select(F.col("id").alias("doc_id"), "fingerprint",
                               F.col("component").alias("component_id"))
