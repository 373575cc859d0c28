"""Exact top-k search by inner product with M-trees of stored pages.

Vectors are scaled to integers. One more component, the root of what a vector's
squared length lacks to the longest one's, turns the largest inner product into
the smallest Euclidean distance, which is a metric. Rows are dealt to cells by
the nearest of a bounded number of pivots, each cell with its covering radius,
and large cells evenly to shards. Each shard is loaded into an M-tree whose pages
(at most `PAGE` entries) hold pivots with covering radii and the distances of
entries to the page's own pivot. Pages go to the shared folder.

A query first walks one shard of its own cell. The k-th best found there bounds
what can still count, and the query goes on only to shards of cells whose ball
that bound does not rule out. In each meeting it walks the tree best-first, and
stored parent distances rule out entries by the triangle inequality before their
distance is computed. The best of all shards are merged. Bounds have a margin for
rounding and ties are never cut, so the results are exact; scores are computed in
whole numbers.

Cases: vectors that are null or hold null or non-finite components take no part,
nor do rows without id; rows repeated in full count once; rows that share an id
never find each other; shorter vectors are filled up with 0; equal scores go to
the smaller id; scores that may not fit a long are an error; with fewer than k
others all are given; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

PAGE, SHARD_ROWS, LEAST_CELLS, LEAST_ROWS, QUERY_BLOCK = 64, 4096, 32, 256, 4096
#: Pivots of cells are far apart rows of a bounded sample.
MOST_CELLS, SAMPLE = 512, 8192
SCALE = 1024
PAGES = "cell int, part int, page int, leaf boolean, refs array<long>, vectors binary, radius array<double>, parent_distance array<double>"
PAGES_ARROW = pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("page", pa.int32()), ("leaf", pa.bool_()), ("refs", pa.list_(pa.int64())), ("vectors", pa.binary()), ("radius", pa.list_(pa.float64())), ("parent_distance", pa.list_(pa.float64()))])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of whole numbers, filled up with 0 to dim components."""
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        row = np.asarray(v.values)
        out[i, : len(row)] = row
    return out.astype(np.int64)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors as points whose distances order inner products."""
    x = vectors.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))[:, None]])


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Indices of at most n points, each the one that lies farthest from those before it."""
    chosen, nearest, at = [], np.full(len(points), np.inf), 0
    while len(chosen) < min(n, len(points)):
        chosen.append(at)
        nearest = np.minimum(nearest, distances(points, points[at]))
        at = int(np.argmax(nearest))
        if nearest[at] == 0:
            break
    return np.array(chosen, dtype=np.int64)


def load_tree(ids: np.ndarray, vectors: np.ndarray, points: np.ndarray) -> list[dict]:
    """Pages of a tree, page 0 the root; top down, with far apart pivots taking the entries nearest to them."""
    pages: list[dict] = []

    def page(rows: np.ndarray, pivot: np.ndarray) -> int:
        me = len(pages)
        pages.append({})
        if len(rows) <= PAGE:
            pages[me] = {"page": me, "leaf": True, "refs": ids[rows].tolist(), "vectors": vectors[rows].tobytes(), "radius": [0.0] * len(rows), "parent_distance": distances(points[rows], pivot).tolist()}
            return me
        want = min(PAGE, -(-len(rows) * 2 // PAGE))
        pivots, nearest, owner = [], np.full(len(rows), np.inf), np.zeros(len(rows), dtype=np.int64)
        at = int(np.argmax(distances(points[rows], pivot)))
        while len(pivots) < want:
            d = distances(points[rows], points[rows[at]])
            owner[d < nearest] = len(pivots)
            nearest = np.minimum(nearest, d)
            pivots.append(rows[at])
            at = int(np.argmax(nearest))
            if nearest[at] == 0:
                break
        groups = [rows[owner == g] for g in range(len(pivots))]
        if max(map(len, groups)) == len(rows):  # copies of one vector: pages of equal size
            groups = [rows[i : i + PAGE] for i in range(0, len(rows), PAGE)] if len(rows) <= PAGE * PAGE else np.array_split(rows, PAGE)
            pivots = [g[0] for g in groups]
        refs, radius = [], []
        for p, g in zip(pivots, groups, strict=True):
            radius.append(float(distances(points[g], points[p]).max()) if len(g) else 0.0)
            refs.append(page(g, points[p]))
        pages[me] = {"page": me, "leaf": False, "refs": refs, "vectors": vectors[pivots].tobytes(), "radius": radius, "parent_distance": distances(points[pivots], pivot).tolist()}
        return me

    if len(ids):
        page(np.arange(len(ids)), points.mean(axis=0))
    return pages


def search(tree: dict[int, dict], query_id: int, query: np.ndarray, k: int, longest: float, slack: float, floor: int | None = None, seen: list[int] | None = None) -> list[tuple[int, int]]:
    """(score, -vec_id) of the k best in a tree that reach the floor, best-first; seen counts pages and distances."""
    point = np.append(query.astype(np.float64), 0.0)
    base = float((point * point).sum()) + longest
    reach = lambda score: math.sqrt(max(0.0, base - 2 * float(score))) + slack
    best: list[tuple[int, int]] = []
    limit = math.inf if floor is None else reach(floor)
    queue: list[tuple[float, int, float]] = [(0.0, 0, math.nan)]
    while queue:
        low, number, from_parent = heapq.heappop(queue)
        if low > limit:
            break
        page = tree[number]
        if seen is not None:
            seen[0] += 1
        near = np.ones(len(page["refs"]), dtype=bool) if math.isnan(from_parent) or limit == math.inf else ~(np.abs(from_parent - page["parent_distance"]) - page["radius"] > limit)
        if page["leaf"]:
            rows = np.flatnonzero(near & (page["refs"] != query_id))
            scores = page["vectors"][rows] @ query
            if floor is not None:
                rows, scores = rows[scores >= floor], scores[scores >= floor]
            if len(best) == k:
                rows, scores = rows[scores >= best[0][0]], scores[scores >= best[0][0]]
            for s, i in zip(scores.tolist(), page["refs"][rows].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                limit = min(limit, reach(best[0][0]))
        else:
            rows = np.flatnonzero(near)
            d = distances(page["points"][rows], point)
            if seen is not None:
                seen[1] += len(rows)
            for r, x in zip(rows.tolist(), d.tolist(), strict=True):
                low = max(0.0, x - page["radius"][r])
                if not low > limit:
                    heapq.heappush(queue, (low, int(page["refs"][r]), x))
    return best


def dealer(pivots: np.ndarray, dim: int, longest: float):
    """Function that names each row's cell, the nearest pivot, and the distance to it."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                points = lifted(matrix(pa.chunked_array([part.column(1)]), dim), longest)
                nearest, cell = np.full(len(points), np.inf), np.zeros(len(points), dtype=np.int32)
                for n, pivot in enumerate(pivots):
                    d = distances(points, pivot)
                    cell[d < nearest] = n
                    nearest = np.minimum(nearest, d)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(nearest)], names=["vec_id", "v", "q", "cell", "distance"])

    return run


def router(pivots: np.ndarray, radii: np.ndarray, dim: int, longest: float, slack: float):
    """Function that gives each query (vec_id, v, floor) a row for every cell whose ball its floor does not rule out."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                queries = matrix(pa.chunked_array([part.column(1)]), dim).astype(np.float64)
                floors = part.column(2).to_pylist()
                own = (queries * queries).sum(axis=1)
                limit = np.array([math.inf if f is None else math.sqrt(max(0.0, o + longest - 2 * float(f))) + slack for o, f in zip(own, floors, strict=True)])
                points = np.hstack([queries, np.zeros((len(queries), 1))])
                rows, cells = [], []
                for n, pivot in enumerate(pivots):
                    met = np.flatnonzero(~(distances(points, pivot) - radii[n] - slack > limit))
                    rows.append(met)
                    cells.append(np.full(len(met), n, dtype=np.int32))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), *(c.take(at) for c in part.columns)], names=["cell", "vec_id", "v", "floor"])

    return run


def top_k(rows: DataFrame, k: int = 10, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows with the largest inner product for each query row."""
    value = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    finite = F.forall(F.col(vector_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = store(rows.where(finite).select(F.col(id_col).cast("long").alias("vec_id"), value.alias("v"), (is_query if is_query is not None else F.col(id_col) % 100 == 0).alias("q")).where("vec_id is not null").dropDuplicates(["vec_id", "v"]), "vectors")
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest"), F.sum(F.col("q").cast("long")).alias("q")).first()
    dim, longest = int(size.dim or 1), float(size.longest or 0.0)
    if not longest < 2.0**62:
        raise ValueError("scores may not fit a long")
    blocks = max(1, -(-int(size.q or 0) // QUERY_BLOCK))
    slack = 1e-6 * (1 + math.sqrt(longest))

    sample = vectors.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow()
    points = lifted(matrix(sample["v"], dim), longest)
    pivots = points[far_apart(points, min(MOST_CELLS, max(1, -(-size.n // SHARD_ROWS), min(LEAST_CELLS, size.n // LEAST_ROWS))))]
    dealt = store(vectors.select("vec_id", "v", "q").mapInArrow(dealer(pivots, dim, longest), "vec_id long, v array<double>, q boolean, cell int, distance double"), "cells")
    cells = {r.cell: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}  # at most MOST_CELLS
    radii = np.array([cells[c].radius if c in cells else -math.inf for c in range(len(pivots))])
    shards = [-(-cells[c].n // SHARD_ROWS) if c in cells else 0 for c in range(len(pivots))]
    n_shards = F.element_at(F.array(*map(F.lit, shards or [0])), F.col("cell") + 1)
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "v"), n).cast("int")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        data = matrix(table["v"], dim)
        tree = load_tree(np.asarray(table["vec_id"]), data, lifted(data, longest))
        return pa.Table.from_pylist([{"cell": key[0].as_py(), "part": key[1].as_py(), **p} for p in tree], schema=PAGES_ARROW)

    def meet(key: tuple, pages: pa.Table, queries: pa.Table) -> pa.Table:
        tree, found = {}, []
        for p in pages.to_pylist() if len(queries) else ():
            data = np.frombuffer(p["vectors"], dtype=np.int64).reshape(len(p["refs"]), dim)
            tree[p["page"]] = {"leaf": p["leaf"], "refs": np.array(p["refs"]), "vectors": data, "radius": np.array(p["radius"]), "parent_distance": np.array(p["parent_distance"])} | ({} if p["leaf"] else {"points": lifted(data, longest)})
        if tree:
            for i, q, floor in zip(queries["vec_id"].to_pylist(), matrix(queries["v"], dim), queries["floor"].to_pylist(), strict=True):
                found += [(i, -j, s) for s, j in search(tree, i, q, k, longest, slack, floor)]
        return pa.Table.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], schema=FOUND)

    pages = store(dealt.select("cell", spread(n_shards).alias("part"), "vec_id", "v").groupBy("cell", "part").applyInArrow(build, PAGES), "m-tree")
    places = ["cell", "part", "block"]

    def meetings(asked: DataFrame) -> DataFrame:
        asked = asked.select("cell", "part", spread(F.lit(blocks)).alias("block"), "vec_id", "v", "floor")
        blocks_of = asked.select("cell", "part", F.col("block").alias("for_block")).distinct()
        copies = pages.join(blocks_of, ["cell", "part"])  # a page for each block of queries that comes to its shard
        return copies.groupBy("cell", "part", "for_block").cogroup(asked.groupBy(*places)).applyInArrow(meet, "query_id long, vec_id long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)

    queries = dealt.where("q").select("vec_id", "v", "cell")
    near = store(meetings(queries.select("cell", F.lit(0).alias("part"), "vec_id", "v", F.lit(None).cast("long").alias("floor"))).distinct(), "near")
    floors = ranked(near).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    routed = queries.select("vec_id", "v").join(floors, "vec_id", "left").select("vec_id", "v", "floor").mapInArrow(router(pivots, radii, dim, longest, slack), "cell int, vec_id long, v array<double>, floor long")
    on = routed.where(n_shards > 0).select("cell", F.explode(F.sequence(F.lit(0), n_shards - 1)).alias("part"), "vec_id", "v", "floor")
    on = on.join(queries.select("cell", F.lit(0).alias("part"), "vec_id", "v"), ["cell", "part", "vec_id", "v"], "left_anti")
    return ranked(near.unionByName(meetings(store(on, "routed"))).distinct()).select("query_id", "rank", "vec_id", "score")
