"""Prefix trie of conversations, from vertical bitmaps in shards.

A node is a distinct sequence of first turns, its members the conversations that start
with it. Conversations are put in the order of their turns' digests, which is the order of
a depth-first walk, and cut into shards of consecutive ones. In a shard every (position,
turn) has a bitset of the conversations that hold it; from the root down a node's bitset
is intersected with the postings of the next position, so children, counts and end lists
come from bits.

A node is whole in its shard unless it holds the shard's first or last conversation: only
those, the two paths at a shard's edges, can go on in a neighbour. Their counts are summed
over shards by the digest of their path. What is distinct among them, leaves and repeated
words, is counted on the first edge that has the node and summed upwards along that edge,
which holds all its ancestors. So no subtree is ever collected, however many members a
node has.

Conversations with equal turns, thousands of them or a third of all, are consecutive and
ordered by id, so they spread over shards like any others. Texts are hashed where they are
read; what moves is 16 bytes and a number per turn. One conversation's digests are one row, as
a document's text is. The digest of a node's end list takes the ids one after the other:
for a node in many shards one task runs through them, with one list of a shard in memory.

Null conversation ids take no part; null roles and texts are empty. Turns are ordered by
number, null first, equal numbers by digest; a repeated row is one turn more. Very long
texts are hashed and counted whole. An empty table gives the root alone, with no member:
no row. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corpuswarden.llm.common import split_words
from corpuswarden.session import write_once

SHARD = 8192  # conversations of a shard at most
SHARD_TURNS = 100_000  # turns from which on a shard is closed
BROADCAST_EDGES = 100_000  # nodes on the edges of shards, a digest and an id each
DIGEST = 16  # bytes of a turn's and of a path's digest
BREAKS = r"[\x20\x09-\x0D]+"  # between the words that are counted

NODES = ("edge long, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, "
         "n_convs long, n_children long, n_leaves long, saved long, words long, deeper boolean, "
         "shard long, ends array<long>")


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) with the turns' (digest, words) in their order."""
    role, text = (F.coalesce(F.col(f"`{name}`"), F.lit("")) for name in (role_col, text_col))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(framed, 256)), 1, DIGEST)
    rows = conversations.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"),
                 F.size(split_words(text, BREAKS)).alias("words")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: t.dropFields("turn"))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def shared_heads(lists: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """`lists` with the first h turns of each taken from the first conversation of its block.

    The block of an id holds the ids of equal quotient by `block`; h is the CRC-32 of the
    id modulo `most`. A missing first conversation gives no turns.
    """
    leader = F.col("conv_id") - F.col("conv_id") % block
    heads = lists.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("leader"), F.slice("turns", 1, most - 1).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    none = F.slice("turns", 1, 0)
    joined = lists.withColumn("leader", leader).join(heads, "leader", "left")
    return joined.select("conv_id", F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), n),
        F.slice("turns", n + 1, F.size("turns"))).alias("turns"))


@dataclass
class Node:
    """A node on the way through a shard, with what was found below it so far."""

    base: int  # the first member, where the bits begin
    members: int
    depth: int
    ids: list[int]  # of the members that end here
    children: Iterator[tuple[int, int]]
    least: int | None  # the smallest id of a member
    whole_children: int = 0
    leaves: int = 0  # of whole nodes in the subtree
    saved: int = 0
    waiting: list[dict] = field(default_factory=list)  # rows of whole children


class Shard:
    """Consecutive conversations, their postings and the walk over their nodes."""

    def __init__(self) -> None:
        self.convs: list[int] = []
        self.paths: list[bytes] = []
        self.words: list[list[int]] = []
        self.turns = 0

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        self.convs.append(conv)
        self.paths.append(path)
        self.words.append(words)
        self.turns += len(words)

    def _turn(self, conv: int, at: int) -> bytes:
        return self.paths[conv][at * DIGEST:(at + 1) * DIGEST]

    def _index(self) -> tuple[dict[tuple[int, bytes], tuple[int, int]], dict[int, int]]:
        """The bitset of every (position, turn), and of the conversations of every length.

        A posting's bits begin at its first conversation, so that a turn that occurs once
        takes one bit. Its conversations are mostly consecutive: runs of them are set at once.
        """
        runs: dict[tuple[int, bytes], list[list[int]]] = {}
        ended: dict[int, int] = {}
        for conv, words in enumerate(self.words):
            ended[len(words)] = ended.get(len(words), 0) | 1 << conv
            for at in range(len(words)):
                own = runs.setdefault((at, self._turn(conv, at)), [])
                if own and own[-1][1] == conv:
                    own[-1][1] = conv + 1
                else:
                    own.append([conv, conv + 1])
        return {key: (own[0][0], sum((1 << end - own[0][0]) - (1 << start - own[0][0])
                                     for start, end in own))
                for key, own in runs.items()}, ended

    def _children(self, base: int, members: int, at: int, postings) -> Iterator[tuple[int, int]]:
        """(first conversation, bits from it on) of the members, by their turn at position `at`."""
        while members:
            skip = (members & -members).bit_length() - 1
            base, members = base + skip, members >> skip
            start, bits = postings[at, self._turn(base, at)]
            child = members & bits >> base - start
            members ^= child
            yield base, child

    def _keys(self, conv: int) -> list[bytes]:
        """The digest of every prefix of a conversation's path, the empty one first."""
        keys = [bytes(DIGEST)]
        for at in range(len(self.words[conv])):
            keys.append(hashlib.sha256(keys[-1] + self._turn(conv, at)).digest()[:DIGEST])
        return keys

    def nodes(self, shard: int) -> Iterator[dict]:
        """Rows of `NODES`: whole nodes, and those on both edges with what is whole below them."""
        postings, ended = self._index()
        edges = (0, len(self.convs) - 1)
        keys = [self._keys(conv) for conv in edges]

        def enter(base: int, members: int, depth: int) -> Node:
            over = members & ended.get(depth, 0) >> base
            ids = [self.convs[base + bit] for bit in _bits(over)]
            return Node(base, members, depth, ids, self._children(base, members ^ over, depth, postings),
                        min(ids, default=None))

        stack = [enter(0, (1 << len(self.convs)) - 1, 0)]
        while stack:
            node = stack[-1]
            child = next(node.children, None)
            if child is not None:
                stack.append(enter(*child, node.depth + 1))
                continue
            stack.pop()
            depth, n = node.depth, node.members.bit_count()
            held = [side for side, conv in enumerate(edges)
                    if conv >= node.base and node.members >> conv - node.base & 1]
            words = self.words[node.base][depth - 1] if depth else 0
            if not held:
                node.leaves = node.leaves or 1
                node.saved += (n - 1) * words
            for row in node.waiting:  # whole children learn their parent's smallest member
                row["parent_key"], row["parent_conv_id"] = (
                    (keys[held[0]][depth], None) if held else (None, node.least))
                yield row
            common = {"depth": depth, "words": words, "shard": shard}
            counts = {"conv_id": node.least, "n_convs": n, "n_children": node.whole_children,
                      "n_leaves": node.leaves, "saved": node.saved, "ends": node.ids}
            for side in held:  # a node on both edges is counted on the first
                mine = counts if side == held[0] else dict.fromkeys(counts, 0) | {
                    "conv_id": None, "ends": []}
                yield common | mine | {
                    "edge": 2 * shard + side, "key": keys[side][depth],
                    "parent_key": keys[side][depth - 1] if depth else None, "parent_conv_id": None,
                    "deeper": depth < len(keys[side]) - 1}
            if stack:
                parent = stack[-1]
                parent.least = node.least if parent.least is None else min(parent.least, node.least)
                parent.leaves += node.leaves
                parent.saved += node.saved
                if not held:
                    parent.whole_children += 1
                    parent.waiting.append(common | counts | {
                        "edge": None, "key": None, "deeper": node.whole_children > 0})


def _bits(bitset: int) -> list[int]:
    """Places of the bits that are set."""
    raw = np.frombuffer(bitset.to_bytes((bitset.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


KINDS = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(),
         "array<long>": pa.list_(pa.int64())}
ARROW = pa.schema([(name, KINDS[kind]) for name, kind in map(str.split, NODES.split(", "))])
ROWS = 10_000  # of a batch of nodes


def _walk(batches: Iterator[pa.RecordBatch], per_shard: int) -> Iterator[pa.RecordBatch]:
    """The nodes of shards cut from one task's conversations, which come in order."""
    def written(shard: Shard, number: int) -> Iterator[pa.RecordBatch]:
        rows = shard.nodes(number)
        while some := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_pylist(some, ARROW)

    number, shard = TaskContext.get().partitionId() << 32, Shard()
    for batch in batches:
        for conv, path, words in zip(*(column.to_pylist() for column in batch.columns)):
            shard.add(conv, path, words)
            if len(shard.convs) >= per_shard or shard.turns >= SHARD_TURNS:
                yield from written(shard, number)
                number, shard = number + 1, Shard()
    if shard.convs:
        yield from written(shard, number)


def shard_nodes(lists: DataFrame, per_shard: int = SHARD) -> DataFrame:
    """Rows of `NODES`, written once: whole nodes, and parts of those on the edges of shards.

    `ends` are the ids that end at a node in a shard; shards and the ids in them ascend.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = write_once(lists.select("conv_id", path.alias("path"), F.transform(
        "turns", lambda t: t["words"]).alias("words")))
    ordered = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return write_once(ordered.select("conv_id", "path", "words").mapInArrow(
        lambda batches: _walk(batches, per_shard), NODES))


def end_digests(parts: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, shard, ends): SHA-256 of the ids in order, comma-joined."""
    def run(batches):
        digests = ((key, hashlib.sha256(), group) for key, group in groupby((
            pair for batch in batches for pair in zip(batch.column("key").to_pylist(), batch.column("ends"))),
            key=itemgetter(0)))
        for key, digest, group in digests:
            comma = ""
            for _, ids in group:
                digest.update((comma + ",".join(map(str, ids.as_py()))).encode())
                comma = ","
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()),
                                              "ends_sha256": [digest.hexdigest()]})

    return parts.repartition("key").sortWithinPartitions("key", "shard").select("key", "ends").mapInArrow(
        run, "key binary, ends_sha256 string")


def nodes(lists: DataFrame, per_shard: int = SHARD) -> DataFrame:
    """A row per node of (conv_id, turns), with counts over its members and its subtree.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256). `saved_tokens` are the words that a store of the trie saves below a
    node: its members but one, times the words of its last turn, over the subtree.
    """
    parts = shard_nodes(lists, per_shard)
    edges = parts.where("edge is not null")
    merged = write_once(edges.groupBy("key").agg(
        F.min("edge").alias("owner"), F.first("parent_key").alias("parent_key"),
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
        F.first("words").alias("words"), F.max("deeper").alias("deeper")))
    # On its owner's edge a node adds its own leaf and words to itself and all above it,
    # and itself to the children of its parent.
    leaf = (~F.col("deeper") & (F.col("n_children") == 0)).cast("long")
    own = merged.select("key", F.col("owner").alias("edge"), leaf.alias("leaf"),
                        ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    up = Window.partitionBy("edge").orderBy(F.desc("depth"))
    upward = edges.select("edge", "key", "depth").join(own, ["key", "edge"], "left").select(
        "key", F.sum(F.coalesce("leaf", F.lit(0))).over(up).alias("leaf"),
        F.sum(F.coalesce("own", F.lit(0))).over(up).alias("own"),
        F.lag(F.col("leaf").isNotNull().cast("long"), 1, 0).over(up).alias("child"))
    added = upward.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"),
                                      F.sum("child").alias("child"))
    parents = write_once(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")))
    if parents.count() <= BROADCAST_EDGES:
        parents = F.broadcast(parents)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
               "ends_sha256"]
    digests = end_digests(edges.where(F.size("ends") > 0).select("key", "shard", "ends"))
    nobody = F.sha2(F.lit(""), 256)
    spread = merged.join(added, "key").join(digests, "key", "left").join(parents, "parent_key", "left").select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs",
        (F.col("n_children") + F.col("child")).alias("n_children"),
        (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
    whole = parts.where("edge is null").join(parents, "parent_key", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.sha2(F.array_join("ends", ","), 256).alias("ends_sha256"))
    return whole.select(*columns).unionByName(spread.select(*columns))


def report(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that share their heads within blocks of twenty ids."""
    return nodes(shared_heads(sequences(conversations)))


ORACLE = r"""
with t as (
  select conv_id, turn, length(w) as words, left(sha256(strlen(role) || ':' || role || text), 32) as digest
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
               list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
        from conversations where conv_id is not null)),
o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, digest) as rn from t),
crc as (  -- CRC-32 bit by bit
  select conv_id, conv_id - conv_id % 20 as leader, n, xor(list_reduce(
           list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''),
                                                   lambda c: cast(ascii(c) as bigint))),
           lambda crc, byte: list_reduce(
             list_prepend(xor(crc, byte), range(8)),
             lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 as h
  from (select conv_id, count(*) as n from o group by 1)),
heads as (
  select crc.*, least(h, coalesce(l.n, 0)) as given
  from crc left join (select conv_id, count(*) as n from o group by 1) l on l.conv_id = leader),
turns as (
  select heads.conv_id, o.rn as depth, digest, words from heads join o on o.conv_id = leader and o.rn <= given
  union all
  select heads.conv_id, given + o.rn - h, digest, words from heads join o on o.conv_id = heads.conv_id and o.rn > h),
paths as (
  select conv_id, depth, words, string_agg(digest, '') over (
           partition by conv_id order by depth rows unbounded preceding) as path from turns
  union all select conv_id, 0, 0, '' from heads),
lengths as (select conv_id, max(depth) as depth from paths group by 1),
nodes as (
  select path, depth, count(*) as n, min(conv_id) as conv_id, any_value(words) as words,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id)
                         filter (l.conv_id is not null), '')) as ends
  from paths left join lengths l using (conv_id, depth) group by all),
kids as (
  select left(path, length(path) - 32) as path, count(*) as kids from nodes where depth > 0 group by 1),
own as (
  select n.*, coalesce(kids, 0) as kids, (n - 1) * words as saved from nodes n left join kids using (path)),
sums as (
  select p.path, sum(saved) as saved, count(*) filter (kids = 0) as leaves
  from own join paths p on p.conv_id = own.conv_id and p.depth <= own.depth group by 1)
select own.conv_id, own.depth, up.conv_id as parent_conv_id, own.n as n_convs, own.kids as n_children,
       leaves as n_leaves, cast(sums.saved as bigint) as saved_tokens, own.ends as ends_sha256
from own join sums using (path)
left join nodes up on own.depth > 0 and up.path = left(own.path, length(own.path) - 32)
"""
