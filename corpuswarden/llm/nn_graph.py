"""Approximate nearest neighbours by NN-descent and greedy search of the graph.

Building: vectors meet in small blocks of random cells, which gives every node some
neighbours to begin with. Then, round after round, the neighbours of a node (and the
nodes it is a neighbour of) are joined and compared with each other, since neighbours
of neighbours are likely to be neighbours; each node keeps its nearest `degree`. Pairs
of which neither is new were compared before and are skipped. Rounds go on until few
neighbours change: five of them for 10,000 vectors, six for 50,000.

Search: a query keeps its nearest `beam` nodes seen so far; the unexpanded ones are
expanded together by a join with the graph, until all are expanded.

Every step is a join or a bounded top list per key, on durable tables of ids, distances
and vectors. Building compares vectors kept in single precision, in units of the median
of their greatest components, so that a few far vectors don't cost the others their
precision; search uses the original ones in double precision. Equal vectors are one node, so groups of copies cost nothing
and are found by their smallest ids.

Defined results: vectors that are null, zero, of another length than most, or that hold
null or non-finite components take no part, neither as queries nor as candidates; rows
that repeat an id and a vector count once; null ids take no part; fewer candidates than
asked for are all returned; equal distances are ordered by id; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpuswarden.llm.common import durable

DEGREE = 20
REVERSE = 20        # nodes a node is a neighbour of that take part, the nearest ones
TREES = 5           # random partitions to begin with
BLOCK = 256         # nodes compared all with all in one block, about
FIRST = 12          # neighbours kept of one block
LEAST_CHANGED = 0.05  # share of the edges that a round must change for another one
MOST_ROUNDS = 100   # never reached but by a fault: a round changes about two thirds of the one before
BEAM = 400
CELL_SAMPLE = 4096  # vectors that set the borders of the random cells, at most
PIVOTS = 256        # nodes that queries without a start begin from
BROADCAST_QUERIES = 50_000
FARTHEST = 1e30     # components are kept up to here for building, in units of the median
SEED = 11


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 1), kind)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct (id, vec) of the vectors that take part; -0.0 becomes 0.0."""
    kind = vectors.schema[vec_col].dataType.elementType
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vec")).where(
        "id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) "
        "and abs(x) < double('inf')) and exists(vec, x -> x <> 0)")
    most = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("vec") == (most["n"] if most else 0))
    return rows.select("id", F.transform("vec", lambda x: (x + F.lit(0.0).cast(kind))).alias("vec"))


class Index:
    """nodes (id, vec, ids, single) and graph (id, near): `ids` are the smallest ids that share a vector."""

    def __init__(self, nodes: DataFrame, graph: DataFrame, keep: int):
        self.nodes, self.graph, self.keep = nodes, graph, keep


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: int = 11,
          degree: int = DEGREE) -> Index:
    """Index of `vectors`; of each group of equal vectors the `keep` smallest ids can be found."""
    rows = usable(vectors, id_col, vec_col).dropDuplicates(["id", "vec"])
    # The filter on the row number keeps `keep` rows of a key in each task before the shuffle.
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(
        F.col("n") <= keep)
    grouped = ranked.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    greatest = F.array_max(F.transform("vec", lambda x: F.abs(x))).cast("double")
    scale = grouped.agg(F.percentile_approx(greatest, 0.5)).first()[0] or 1.0

    @F.pandas_udf(T.BinaryType())
    def single(vecs: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series([np.clip(np.asarray(v, np.float64) / scale, -FARTHEST, FARTHEST).astype(
                np.float32).tobytes() for v in vecs])

    nodes = durable(grouped.select(F.col("ids")[0].alias("id"), "vec", "ids", single("vec").alias("single")))
    n = nodes.count()
    edges = _top(_cells(nodes, n, min(FIRST, degree)).withColumn("new", F.lit(True)), degree)
    edges = durable(edges)
    changed, rounds = degree * n if n > BLOCK else 0, 0
    while changed >= LEAST_CHANGED * degree * n and changed:
        edges = durable(_round(nodes, edges, degree))
        changed, rounds = edges.where("new").count(), rounds + 1
        if rounds > MOST_ROUNDS:
            raise RuntimeError(f"the graph does not settle: {changed} edges changed in round {rounds}")
    near = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).union(
        _reverse(edges, 2 * REVERSE).select("b", "a")).distinct()
    graph = durable(near.groupBy("id").agg(F.collect_list("near").alias("near")))
    return Index(nodes, graph, keep)


def _top(edges: DataFrame, degree: int) -> DataFrame:
    """The nearest `degree` of each node among (a, b, d, new); of equal pairs the old one."""
    single = edges.groupBy("a", "b").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return single.withColumn("place", place).where(F.col("place") <= degree).drop("place")


def _reverse(edges: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("b").orderBy("d", "a"))
    return edges.withColumn("place", place).where(F.col("place") <= most).drop("place")


def _pairs(column: str, kind: T.DataType, least_new: bool, first: int):
    """A function for mapInArrow: compares the members of each group in `column`."""
    def nearest(singles: np.ndarray) -> np.ndarray:
        vecs = singles.astype(np.float64)
        own = (vecs * vecs).sum(axis=1)
        d = own[:, None] + own[None, :] - 2 * vecs @ vecs.T
        np.fill_diagonal(d, np.inf)
        return np.maximum(d, 0)

    def run(batches):
        for batch in batches:
            groups = batch.column(column)
            a, b, far = [], [], []
            members = groups.flatten()
            ids = np.asarray(members.field("id"))
            raw = members.field("single")
            vecs = np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(
                len(ids), -1) if len(ids) else np.zeros((0, 1), np.float32)
            ends = np.append(0, np.cumsum([len(g) for g in groups]))
            if least_new:
                new = np.asarray(members.field("new").to_numpy(zero_copy_only=False), bool)
                limit = np.asarray(members.field("limit").to_numpy(zero_copy_only=False), np.float64)
            for low, high in zip(ends[:-1], ends[1:]):
                if high - low < 2:
                    continue
                d = nearest(vecs[low:high])
                if least_new:
                    fresh = new[low:high]
                    good = (d < limit[low:high, None]) & (fresh[:, None] | fresh[None, :])
                    x, y = np.nonzero(good)
                else:
                    most = min(first, high - low - 1)
                    y = np.argpartition(d, most - 1, axis=1)[:, :most].ravel()
                    x = np.repeat(np.arange(high - low), most)
                a.append(ids[low + x])
                b.append(ids[low + y])
                far.append(d[x, y])
            join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(join(a, ids.dtype), batch.schema.field(column).type.value_type.field("id").type),
                 pa.array(join(b, ids.dtype), batch.schema.field(column).type.value_type.field("id").type),
                 pa.array(join(far, np.float64), pa.float64())], ["a", "b", "d"])

    return run, f"a {kind.simpleString()}, b {kind.simpleString()}, d double"


def _cells(nodes: DataFrame, n: int, first: int) -> DataFrame:
    """Candidates (a, b, d): in each random partition a node is compared with one block of its cell.

    A cell is where a vector lies to the borders of some random directions, each border
    the median of a bounded sample. Cells larger than a block are dealt to blocks by hash.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, n / BLOCK)))))
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(CELL_SAMPLE).select("single").collect()
    if not sample:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d")).limit(0)
    known = np.stack([np.frombuffer(row["single"], np.float32) for row in sample])
    directions = np.random.default_rng(SEED).normal(size=(known.shape[1], TREES * max(1, bits))).astype(np.float32)
    borders = np.median(known @ directions, axis=0)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def cells(singles: pd.Series) -> pd.Series:
        x = np.stack([np.frombuffer(v, np.float32) for v in singles])
        above = (x @ directions > borders).reshape(len(x), TREES, -1)
        codes = (above * (1 << np.arange(above.shape[2]))).sum(axis=2) if bits else np.zeros((len(x), TREES), int)
        return pd.Series(list(codes.astype(np.int64)))

    placed = durable(nodes.select("id", "single", F.posexplode(cells("single")).alias("tree", "cell")))
    sizes = placed.groupBy("tree", "cell").count()
    blocks = F.ceil(F.col("count") / BLOCK)
    dealt = placed.join(sizes, ["tree", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("id", "tree"), blocks))
    groups = dealt.groupBy("tree", "cell", "block").agg(
        F.collect_list(F.struct("id", "single")).alias("members")).select("members")
    run, schema = _pairs("members", nodes.schema["id"].dataType, False, first)
    return groups.mapInArrow(run, schema)


def _round(nodes: DataFrame, edges: DataFrame, degree: int) -> DataFrame:
    """Edges after comparing the neighbours of every node with each other."""
    limits = edges.groupBy("a").agg(F.max("d").alias("limit"), F.count("*").alias("n"))
    known = nodes.join(limits, nodes["id"] == limits["a"], "left").select("id", "single", F.when(
        F.col("n") >= degree, F.col("limit")).otherwise(F.lit(float("inf"))).alias("limit"))
    around = edges.select(F.col("a").alias("center"), F.col("b").alias("id"), "new").union(
        _reverse(edges, REVERSE).select("b", "a", "new")).groupBy("center", "id").agg(
        F.max("new").alias("new"))
    groups = around.join(known, "id").groupBy("center").agg(F.collect_list(
        F.struct("id", "single", "limit", "new")).alias("members")).where(
        F.exists("members", lambda m: m["new"])).select("members")
    run, schema = _pairs("members", nodes.schema["id"].dataType, True, 0)
    # A pair is often found around several centres; each task keeps it once before the shuffle.
    found = groups.mapInArrow(run, schema).withColumn("new", F.lit(True))
    return _top(edges.withColumn("new", F.lit(False)).union(found), degree)


def _measured(pairs: DataFrame, kind: T.DataType) -> DataFrame:
    """(query, id, d) of rows (query, id, vec, target), in double precision."""
    def run(batches):
        for batch in batches:
            gap = _matrix(batch.column("vec")) - _matrix(batch.column("target"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), batch.column("id"),
                 pa.array(np.sqrt(np.einsum("ij,ij->i", gap, gap)), pa.float64())], ["query", "id", "d"])

    query = pairs.schema["query"].dataType.simpleString()
    return pairs.select("query", "id", "vec", "target").mapInArrow(
        run, f"query {query}, id {kind.simpleString()}, d double")


def search(index: Index, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """Nearest nodes (query, id, d) of `queries` (query, target, start), at least k of the index if it has them.

    `start` is a node to begin from; where it is null, the nearest of a bounded sample
    of nodes are.
    """
    kind = index.nodes.schema["id"].dataType
    vectors = index.nodes.select("id", "vec")
    targets = durable(queries.select("query", "target"))
    if targets.count() <= BROADCAST_QUERIES:
        targets = F.broadcast(targets)
    pivots = index.nodes.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("id").collect()
    some = F.array(*[F.lit(row["id"]) for row in pivots]) if pivots else F.array().cast(T.ArrayType(kind))
    lost = queries.where("start is null").select("query", F.explode(some).alias("id"))
    begin = queries.where("start is not null").select("query", F.col("start").alias("id")).union(lost)
    seen = _measured(begin.join(vectors, "id").join(targets, "query"), kind)
    state = durable(_nearest(seen.withColumn("open", F.lit(True)), beam))
    while True:
        found = state.where("open").join(index.graph, "id").select("query", F.explode("near").alias("id")).distinct()
        new = found.join(state.select("query", "id"), ["query", "id"], "left_anti")
        far = _measured(new.join(vectors, "id").join(targets, "query"), kind)
        state = durable(_nearest(state.withColumn("open", F.lit(False)).union(
            far.withColumn("open", F.lit(True))), beam))
        if not state.where("open").limit(1).count():
            return state.select("query", "id", "d")


def _nearest(rows: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def neighbours(vectors: DataFrame, wanted: Column, k: int = 10, id_col: str = "vec_id",
               vec_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """(query, rank, id, d): the k nearest other rows of each row for which `wanted` holds.

    `wanted` is a condition on the column `id`. Rows of equal vectors are searched once.
    """
    index = build(vectors, id_col, vec_col, keep=k + 1)
    asked = usable(vectors, id_col, vec_col).where(wanted).distinct()
    by_vec = index.nodes.select(F.col("id").alias("node"), "vec")
    asked = durable(asked.join(by_vec, "vec").select("id", "node", "vec"))
    starts = asked.groupBy("node").agg(F.first("vec").alias("target")).select(
        F.col("node").alias("query"), "target", F.col("node").alias("start"))
    nodes = _nearest(search(index, starts, k, beam), k + 1)
    listed = nodes.join(index.nodes.select("id", "ids"), "id").select(
        F.col("query").alias("node"), "d", F.explode("ids").alias("found"))
    # The k + 1 best of a node serve all queries that share it.
    best = durable(listed.withColumn("place", F.row_number().over(
        Window.partitionBy("node").orderBy("d", "found"))).where(F.col("place") <= k + 1).drop("place"))
    own = asked.select(F.col("id").alias("query"), "node").join(best, "node").where("found <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "found"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query", "rank", F.col("found").alias("id"), "d")


def report(vectors: DataFrame) -> DataFrame:
    return neighbours(vectors, F.col("id") % 100 == 0).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("d").alias("score"))
