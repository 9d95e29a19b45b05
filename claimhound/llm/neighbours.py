"""Approximate nearest neighbours (op9): a navigable small-world graph per shard.

Equal vectors are one class that keeps its smallest vec_ids, as many as any
result can need. Classes are dealt to shards of about ``SHARD_ROWS`` by a hash,
so a cluster of near copies is spread evenly. A shard's hierarchical graph is
stored as flat arrays of neighbours, a layer each. Queries are dealt in blocks,
every block meets every shard once, and the best of all shards are merged.

As a shard is bounded, its graph is built from blocked matrix products instead
of one search per insertion: in insertion order, each vector picks diverse
neighbours among all earlier ones, and lists that grow too long are thinned by
the same rule. Searching is the usual descent and then a beam over layer 0.

Vectors that are null, empty, zero, or hold null or non-finite components take
no part. Vectors of different lengths are never compared. Repeated rows (same
vec_id and vector) count once; rows of one vec_id with different vectors are
queries of their own, and none is a candidate for the other; ties go to the
smaller vec_id; an empty table, or a query without candidates, gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimhound.llm.staging import staged, table

SHARD_ROWS = 4096
QUERY_ROWS = 4096
#: Neighbours in upper layers; layer 0 has twice as many.
LINKS = 16
CHOOSE_FROM = 64
BEAM = 192
#: Beam entries that are expanded in one step, and queries in one matrix.
EXPAND, TOGETHER = 4, 128


def _choose(sims: np.ndarray, picked: np.ndarray, unit: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` diverse neighbours of each row, -1 where there are fewer.

    ``picked``: candidates by falling similarity ``sims`` (-1: none). One is
    taken if it is nearer to the row than to any taken before; what room is
    left goes to the nearest of the others.
    """
    valid = picked >= 0
    vectors = unit[np.maximum(picked, 0)]
    between = vectors @ vectors.transpose(0, 2, 1)
    taken = np.zeros(picked.shape, dtype=bool)
    closest = np.full(picked.shape, -np.inf)
    for k in range(picked.shape[1]):
        take = valid[:, k] & (sims[:, k] > closest[:, k]) & (taken.sum(axis=1) < most)
        taken[:, k] = take
        closest[take] = np.maximum(closest[take], between[take, k])
    order = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(np.where(valid, picked, -1), order, axis=1)


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(sims, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def build_layer(unit: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of the vectors of one layer, given in insertion order."""
    n = len(unit)
    forward = np.full((n, LINKS), -1, dtype=np.int32)
    for a in range(0, n, 256):
        sims = unit[a : a + 256] @ unit[: a + 256].T
        later = np.arange(sims.shape[1]) >= np.arange(a, a + len(sims))[:, None]
        sims[later] = -np.inf
        at = _top(sims, CHOOSE_FROM)
        near = np.take_along_axis(sims, at, axis=1)
        chosen = _choose(near, np.where(np.isfinite(near), at, -1), unit, LINKS)
        forward[a : a + len(sims), : chosen.shape[1]] = chosen
    ends = np.nonzero(forward >= 0)
    a, b = ends[0], forward[ends].astype(np.int64)
    pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
    a, b = pairs // n, pairs % n
    out = np.full((n, most), -1, dtype=np.int32)
    sims = np.einsum("ij,ij->i", unit[a], unit[b])
    order = np.lexsort((-sims, a))
    a, b, sims = a[order], b[order], sims[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    wide = np.full((n, CHOOSE_FROM), -1, dtype=np.int64)
    wide_sims = np.full((n, CHOOSE_FROM), -np.inf)
    near = place < CHOOSE_FROM
    wide[a[near], place[near]], wide_sims[a[near], place[near]] = b[near], sims[near]
    for lo in range(0, n, 256):
        chosen = _choose(wide_sims[lo : lo + 256], wide[lo : lo + 256], unit, most)
        out[lo : lo + 256, : chosen.shape[1]] = chosen
    return out


class Graph:
    """A shard: unit vectors, and per layer its nodes and their neighbours (as node numbers)."""

    def __init__(self, unit: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]):
        self.unit, self.nodes, self.links = unit, nodes, links

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 0) -> Graph:
        """``unit`` in insertion order; a layer holds a 1/LINKS part of the one below."""
        chance = np.random.default_rng(seed).random(len(unit))
        levels = np.floor(-np.log(1 - chance) / np.log(LINKS)).astype(int)
        nodes, links = [], []
        for level in range(int(levels.max()) + 1):
            here = np.flatnonzero(levels >= level).astype(np.int32)
            found = build_layer(unit[here], LINKS if level else 2 * LINKS)
            nodes.append(here)
            links.append(np.where(found >= 0, here[np.maximum(found, 0)], -1).astype(np.int32))
        return cls(unit, nodes, links)

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
        """The ``k`` nearest found for each unit query, nearest first; -1 where there are fewer."""
        parts = [
            self._search(queries[a : a + TOGETHER], k, beam)
            for a in range(0, len(queries), TOGETHER)
        ]
        return np.concatenate(parts) if parts else np.zeros((0, k), dtype=np.int64)

    def _search(self, queries: np.ndarray, k: int, beam: int) -> np.ndarray:
        n, rows = len(self.unit), np.arange(len(queries))
        at = np.full(len(queries), self.nodes[-1][0], dtype=np.int64)
        for level in range(len(self.nodes) - 1, 0, -1):
            moving = True
            while moving:
                found = self.links[level][np.searchsorted(self.nodes[level], at)]
                found = np.concatenate((at[:, None], np.where(found >= 0, found, at[:, None])), 1)
                sims = np.einsum("qd,qkd->qk", queries, self.unit[found])
                best = found[rows, sims.argmax(axis=1)]
                moving, at = bool((best != at).any()), best
        beam = min(max(beam, k), n)
        ids = np.full((len(queries), beam), -1, dtype=np.int64)
        sims = np.full((len(queries), beam), -np.inf)
        open_ = np.zeros((len(queries), beam), dtype=bool)
        seen = np.zeros((len(queries), n + 1), dtype=bool)
        seen[:, n] = True
        ids[:, 0], sims[:, 0], open_[:, 0] = at, np.einsum("qd,qd->q", queries, self.unit[at]), True
        seen[rows, at] = True
        while open_.any():
            step = min(EXPAND, beam)
            first = np.argsort(~open_, axis=1, kind="stable")[:, :step]
            chosen = np.take_along_axis(open_, first, axis=1)
            np.put_along_axis(open_, first, False, axis=1)
            source = np.where(chosen, np.take_along_axis(ids, first, axis=1), 0)
            found = np.where(chosen[:, :, None], self.links[0][source], -1).reshape(len(rows), -1)
            found = np.sort(np.where(found >= 0, found, n), axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = n
            new = ~np.take_along_axis(seen, found, axis=1)
            q, j = np.nonzero(new)
            seen[q, found[q, j]] = True
            near = np.full(found.shape, -np.inf)
            near[q, j] = np.einsum("ij,ij->i", queries[q], self.unit[found[q, j]])
            all_ids = np.concatenate((ids, np.where(new, found, -1)), axis=1)
            all_sims = np.concatenate((sims, near), axis=1)
            all_open = np.concatenate((open_, new), axis=1)
            keep = _top(all_sims, beam)
            ids, sims, open_ = (
                np.take_along_axis(x, keep, axis=1) for x in (all_ids, all_sims, all_open)
            )
        out = np.full((len(queries), k), -1, dtype=np.int64)
        out[:, : min(k, beam)] = ids[:, :k]
        return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision on the vectors as given."""
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double), size of the rows that take part, each once."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v"))
    return rows.where(_usable(F.col("v"))).distinct().withColumn("size", F.size("v"))


def vector_classes(rows: DataFrame, keep: int) -> DataFrame:
    """v, size, members: each different vector with its ``keep`` smallest vec_ids."""
    first = Window.partitionBy("size", "v").orderBy(F.col("vec_id").asc_nulls_last())
    some = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
    return some.groupBy("size", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))


INDEX = "size int, shard int, v binary, members array<array<long>>, nodes array<binary>, links array<binary>"


def build_index(classes: DataFrame) -> DataFrame:
    """One row per shard of ``classes`` (size, shard, v, members), with its graph."""

    def built(data: pa.Table) -> pa.Table:
        matrix = _matrix(data["v"])
        order = sorted(range(len(matrix)), key=lambda i: zlib.crc32(matrix[i]))  # insertion order
        data, matrix = data.take(pa.array(order)), matrix[order]
        graph = Graph.build(_unit(matrix))
        row = {
            "size": data["size"][0].as_py(),
            "shard": data["shard"][0].as_py(),
            "v": matrix.tobytes(),
            "members": data["members"].to_pylist(),
            "nodes": [x.tobytes() for x in graph.nodes],
            "links": [x.tobytes() for x in graph.links],
        }
        return pa.Table.from_pylist([row], schema=INDEX_SCHEMA)

    return classes.groupBy("size", "shard").applyInArrow(built, INDEX)


INDEX_SCHEMA = pa.schema(
    [
        ("size", pa.int32()),
        ("shard", pa.int32()),
        ("v", pa.binary()),
        ("members", pa.list_(pa.list_(pa.int64()))),
        ("nodes", pa.list_(pa.binary())),
        ("links", pa.list_(pa.binary())),
    ]
)
FOUND = "query_id long, query_key long, vec_id long, score double"


def _found_in(shard: dict, queries: pa.Table, k: int) -> pa.Table:
    """The best ``k`` vectors of one shard for each query."""
    matrix = np.frombuffer(shard["v"]).reshape(-1, shard["size"])
    nodes = [np.frombuffer(x, dtype=np.int32) for x in shard["nodes"]]
    links = [
        np.frombuffer(x, dtype=np.int32).reshape(len(at), -1)
        for x, at in zip(shard["links"], nodes, strict=True)
    ]
    asked = _matrix(queries["v"])
    found = Graph(_unit(matrix), nodes, links).search(_unit(asked), k + 1)
    query_ids, keys = queries["query_id"].to_pylist(), queries["query_key"].to_pylist()
    q, j = np.nonzero(found >= 0)
    scores = cosine(asked[q], matrix[found[q, j]])
    rows: list[list[tuple]] = [[] for _ in query_ids]
    for i, c, score in zip(q.tolist(), found[q, j].tolist(), scores.tolist(), strict=True):
        for vec_id in shard["members"][c]:
            if vec_id != query_ids[i]:
                rows[i].append((-score, vec_id))
    out = [
        (query_ids[i], keys[i], vec_id, -s)
        for i, found_by in enumerate(rows)
        for s, vec_id in sorted(found_by, key=lambda r: (r[0], r[1] is None, r[1] or 0))[:k]
    ]
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    return pa.table(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
        names=["query_id", "query_key", "vec_id", "score"],
    )


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5) -> DataFrame:
    """For each row of ``queries``: query_id, rank, vec_id, score of the ``k`` nearest found.

    Both have vec_id and embedding. A class keeps k + 1 ids, as a query's own
    id is no candidate.
    """
    classes = staged(vector_classes(usable_vectors(vectors), k + 1), "vector-classes")
    sizes = classes.groupBy("size").agg(
        F.ceil(F.count("*") / F.lit(SHARD_ROWS)).cast("int").alias("shards")
    )
    spread = F.pmod(F.xxhash64("v"), F.col("shards")).cast("int")
    dealt = classes.join(F.broadcast(sizes), "size")  # a row per vector length
    dealt = dealt.select("size", spread.alias("shard"), "v", "members")
    index = staged(build_index(dealt), "vector-shards")

    asked = usable_vectors(queries).select(
        F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query_key"), "v", "size"
    )
    asked = staged(asked, "vector-queries")
    blocks = asked.groupBy("size").agg(
        F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("blocks")
    )
    counts = F.broadcast(sizes.join(blocks, "size"))  # a row per vector length
    block = F.pmod(F.xxhash64("query_id", "query_key"), F.col("blocks")).cast("int").alias("block")
    every_shard = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    left = index.join(counts, "size").select(*index.columns, every_block)
    right = asked.join(counts, "size").select(*asked.columns, block, every_shard)

    def met(shards: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(shards) or not len(queries):
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})
        return _found_in(shards.slice(0, 1).to_pylist()[0], queries, k)

    names = ["query_id", "query_key", "vec_id", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    keys = ["size", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, FOUND)
    best = Window.partitionBy("query_id", "query_key").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last()
    )
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_small_world(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
