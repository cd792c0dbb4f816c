"""Operator 1, approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Distinct vectors are the nodes; copies come back in at the end, so a vector that
many rows share costs one node. Nodes are dealt by hash into about
sqrt(nodes) / 8 shards, each with a graph of its own. Every round of NN-descent
is a Spark job: edges and reversed edges are grouped by the node they meet in
(neighbours of neighbours), joined with the shard's vectors, compared, and the
better pairs merged into each node's K best; only lists with a new neighbour are
compared again, until fewer than SETTLED of the edges change. Queries, in blocks,
meet each shard's graph and search it greedily with a beam of BEAM from the best of its leaders, nodes that have every other node for a
neighbour of one of them, so no cluster is out of reach however small; scores are then taken in double precision.

Cases: rows whose vec_id is null or whose vector is null, empty, zero or holds
null or non-finite components take no part; vectors of different lengths are not
compared; rows of equal vec_id and vector count once; rows of one vec_id but
different vectors are queries (with a list each) and candidates each; equal scores
are ordered by vec_id, also where a shard keeps only some of those that tie; with
fewer candidates than asked for all are returned; an empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .common import discard, saved

K, BEAM, SETTLED = 24, 160, 0.01
#: Queries in a block.
BLOCK = 20_000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), node (hash of the vector) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select(F.col("vec_id").cast("long"), v.alias("v"), F.xxhash64(F.transform(v, lambda x: x + F.lit(0.0))).alias("node")).dropDuplicates(["vec_id", "node"])


def _least_ids(rows: DataFrame, many: int) -> DataFrame:
    """node, ids: the `many` least vec_ids of each node, found in parts of 64 so that a common vector's rows are spread."""
    part = Window.partitionBy("node", "part").orderBy("vec_id")
    top = rows.select("node", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).withColumn("r", F.row_number().over(part)).where(F.col("r") <= many)
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= many)
    return top.groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(dtype, copy=False)


def shard_nodes(rows: DataFrame) -> DataFrame:
    """shard, idx (0 up, in the shard, by least vec_id), node, v, low (least vec_id) of the distinct vectors."""
    nodes = saved(rows.groupBy("node").agg(F.first("v").alias("v"), F.min("vec_id").alias("low")), "nodes")
    shards = max(1, round(math.sqrt(nodes.count()) / 8))
    dealt = nodes.withColumn("shard", F.size("v") * F.lit(1 << 32) + F.pmod(F.xxhash64("node"), F.lit(shards)))
    out = saved(dealt.withColumn("idx", (F.row_number().over(Window.partitionBy("shard").orderBy("low", "node")) - 1).cast("int")), "shards")
    discard(nodes)
    return out


_EDGES = "shard long, owner int, other int, score float, new boolean"


def _start(k: int):
    """Random neighbours of every node of a shard."""

    def run(nodes: pa.Table) -> pa.Table:
        idx, v = nodes["idx"].to_numpy(), _matrix(nodes["v"], np.float32)
        n = len(idx)
        place = np.empty(n, np.int64)
        place[idx] = np.arange(n)
        v = v[place]
        owner = np.repeat(np.arange(n), min(k, n))
        other = np.random.default_rng(n).integers(0, n, len(owner))
        keep = owner != other
        owner, other = owner[keep], other[keep]
        score = np.einsum("ij,ij->i", v[owner], v[other])
        return _edges(nodes["shard"][0].as_py(), owner, other, score)

    return run


def _edges(shard: int, owner: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.Table:
    n = len(owner)
    return pa.table({"shard": pa.array(np.full(n, shard, np.int64)), "owner": pa.array(owner.astype(np.int32)), "other": pa.array(other.astype(np.int32)), "score": pa.array(score.astype(np.float32)), "new": pa.array(np.ones(n, bool))})


def _padded(lists: list[list], width: int, fill) -> np.ndarray:
    out = np.full((len(lists), width), fill)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _compare(nodes: pa.Table, met: pa.Table) -> pa.Table:
    """One shard: its vectors, and for each node the neighbours that meet in it."""
    shard = (nodes if nodes.num_rows else met)["shard"][0].as_py()
    if not met.num_rows:
        return _edges(shard, *np.zeros((3, 0)))
    v = np.empty((nodes.num_rows, len(nodes["v"][0])), np.float32)
    v[nodes["idx"].to_numpy()] = _matrix(nodes["v"], np.float32)
    worst = np.full(nodes.num_rows, -np.inf, np.float32)
    worst[nodes["idx"].to_numpy()] = nodes["worst"].to_numpy()
    near, new = met["near"].to_pylist(), met["fresh"].to_pylist()
    width = max(map(len, near))
    return _edges(shard, *graph.local_join(v, _padded(near, width, -1).astype(np.int32), _padded(new, width, False), worst))


def _best(edges: DataFrame, k: int) -> DataFrame:
    once = edges.groupBy("shard", "owner", "other").agg(F.max("score").alias("score"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("shard", "owner").orderBy(F.desc("score"), "other"))
    return once.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def neighbour_graph(nodes: DataFrame, k: int = K) -> DataFrame:
    """shard, owner, other, score and new (found in the last round): each node's k best found by NN-descent."""
    edges = saved(_best(nodes.groupBy("shard").applyInArrow(_start(k), _EDGES), k), "edges")
    while True:
        back = edges.select("shard", F.col("other").alias("owner"), F.col("owner").alias("other"), "new")
        turn = F.row_number().over(Window.partitionBy("shard", "owner").orderBy(F.desc("new"), F.xxhash64("owner", "other")))
        both = edges.select("shard", "owner", "other", "new").unionByName(back.withColumn("r", turn).where(F.col("r") <= k).drop("r"))
        met = both.groupBy("shard", "owner", "other").agg(F.max("new").alias("new")).groupBy("shard", "owner").agg(F.collect_list("other").alias("near"), F.collect_list("new").alias("fresh"))
        met = met.where(F.array_contains("fresh", True)).select("shard", "near", "fresh")
        worst = edges.groupBy("shard", F.col("owner").alias("idx")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
        known = nodes.join(worst, ["shard", "idx"], "left").select("shard", "idx", "v", F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst"))
        found = known.groupBy("shard").cogroup(met.groupBy("shard")).applyInArrow(_compare, _EDGES)
        before, edges = edges, saved(_best(edges.withColumn("new", F.lit(False)).unionByName(found), k), "edges")
        discard(before)
        n = edges.agg(F.count("*").alias("all"), F.count_if("new").alias("new")).first()
        if n["new"] <= SETTLED * n["all"]:
            return edges


_HITS = "query long, node long, low long, score double"


def _search(beam: int, many: int):
    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        n = shard.num_rows
        if not n or not queries.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "low": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        order = np.argsort(shard["idx"].to_numpy())
        exact = _matrix(shard["v"])[order]
        names, low = shard["node"].to_numpy()[order], shard["low"].to_numpy()[order]
        lists = [shard["around"][i].as_py() or [] for i in order.tolist()]
        around = _padded(lists, max(1, *map(len, lists)), -1).astype(np.int64)
        start = graph.leaders(around)
        v, q = exact.astype(np.float32), _matrix(queries["v"])
        who = queries["query"].to_numpy()
        out = []
        for a in range(0, len(q), 256):
            ids, _ = graph.greedy_search(v, around, q[a : a + 256].astype(np.float32), start, beam)
            s = np.where(ids >= 0, np.einsum("ij,ikj->ik", q[a : a + 256], exact[np.maximum(ids, 0)]), -np.inf)
            # nodes are numbered by their least vec_id, so what ties is kept in that order
            top = np.lexsort((np.maximum(ids, 0), -s))[:, :many]
            ids, s = np.take_along_axis(ids, top, 1), np.take_along_axis(s, top, 1)
            i, j = np.nonzero(ids >= 0)
            out.append((who[a + i], names[ids[i, j]], low[ids[i, j]], s[i, j]))
        return pa.table({k: pa.array(np.concatenate(x)) for k, x in zip(("query", "node", "low", "score"), zip(*out, strict=True), strict=True)})

    return run


def nearest(vectors: DataFrame, every: int = 20, top: int = 20, k: int = K, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found of each row whose vec_id is divisible by `every`."""
    rows = saved(usable(vectors), "usable")
    nodes = shard_nodes(rows)
    graph_ = neighbour_graph(nodes, k)
    edges = graph_.drop("new")
    back = edges.select("shard", F.col("other").alias("owner"), F.col("owner").alias("other"), "score")
    best = F.row_number().over(Window.partitionBy("shard", "owner").orderBy(F.desc("score"), "other"))
    around = edges.unionByName(back.withColumn("r", best).where(F.col("r") <= k).drop("r")).groupBy("shard", F.col("owner").alias("idx")).agg(F.collect_set("other").alias("around"))
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = saved(asked.groupBy(F.col("node").alias("query")).agg(F.first("v").alias("v")), "queries")
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    shards = nodes.select("shard", F.size("v").alias("dim")).distinct()
    # every query against every shard, in blocks; there are about sqrt(nodes) / 8 shards
    told = saved(queries.withColumn("dim", F.size("v")).join(F.broadcast(shards), "dim").select("shard", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"), "query", "v"), "told")
    whole = nodes.join(around, ["shard", "idx"], "left").withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    hits = whole.groupBy("shard", "block").cogroup(told.groupBy("shard", "block")).applyInArrow(_search(beam, top + 1), _HITS)
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "low"))
    hits = saved(hits.withColumn("r", first).where(F.col("r") <= top + 1).drop("r"), "hits")
    discard(nodes, graph_, queries, told)
    ids = _least_ids(rows, top + 1)
    found = hits.join(ids, "node").join(asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")), "query")
    each = found.select("query_id", "query", "node", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id or node <> query")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
