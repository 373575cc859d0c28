import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import mtree
from plumbline.llm.queries import ORACLE_SQL, QUERIES

ROWS = "vec_id long, embedding array<float>, rank string"


def brute(rows, is_query, k=10):
    fit = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fit[i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)] = True
    out = []
    for q in sorted({i for i, _ in fit if is_query(i)}):
        best = {}
        for i, v in fit:
            if i != q:
                for j, w in fit:
                    if j == q:
                        s = sum(a * b for a, b in zip(v, w))
                        best[s, i] = True
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(best, key=lambda b: (-b[0], b[1]))[:k])]
    return out


def test_ties_copies_nulls_and_many_pages(spark, monkeypatch):
    monkeypatch.setattr(mtree, "LEAST_ROWS", 100)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # one vector many times: more than a page of ties
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8), (2100, [0.25, 1.0]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], ROWS)
    got = mtree.top_k(df, is_query=F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(brute(rows, lambda i: i % 100 == 0))


def test_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0], ""), (1, [2.0], ""), (2, [-1.0], "")], ROWS)
    assert [(r.rank, r.vec_id, r.score) for r in mtree.top_k(df).sort("rank").collect()] == [(1, 1, 1024 * 2048), (2, 2, -1024 * 1024)]
    assert mtree.top_k(df.limit(0)).count() == 0 and mtree.top_k(df.where("vec_id = 0")).count() == 0


def test_tree_keeps_its_invariants_and_prunes():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 900, (30, 6))
    vectors = (centres[rng.integers(0, 30, 4000)] + rng.normal(0, 20, (4000, 6))).astype(np.int64)
    longest = float((vectors.astype(float) ** 2).sum(axis=1).max())
    points = mtree.lifted(vectors, longest)
    pages = {p["page"]: p for p in mtree.load_tree(np.arange(4000), vectors, points)}
    seen = []

    def under(number):
        p = pages[number]
        assert len(p["refs"]) <= mtree.PAGE
        return p["refs"] if p["leaf"] else [i for r in p["refs"] for i in under(r)]

    for p in pages.values():
        if not p["leaf"]:
            pivots = np.frombuffer(p["vectors"], dtype=np.int64).reshape(-1, 6)
            for ref, pivot, radius in zip(p["refs"], mtree.lifted(pivots, longest), p["radius"], strict=True):
                assert mtree.distances(points[under(ref)], pivot).max() <= radius + 1e-6
    seen = under(0)
    assert sorted(seen) == list(range(4000))


def test_bounds_spare_pages_and_cells():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 900, (40, 6))
    vectors = (centres[np.repeat(np.arange(40), 100)] + rng.normal(0, 5, (4000, 6))).astype(np.int64)
    longest = float((vectors.astype(float) ** 2).sum(axis=1).max())
    points = mtree.lifted(vectors, longest)
    pages = mtree.load_tree(np.arange(4000), vectors, points)
    tree = {p["page"]: {"leaf": p["leaf"], "refs": np.array(p["refs"]), "vectors": (v := np.frombuffer(p["vectors"], dtype=np.int64).reshape(-1, 6)), "radius": np.array(p["radius"]), "parent_distance": np.array(p["parent_distance"]), "points": mtree.lifted(v, longest)} for p in pages}
    slack = 1e-6 * (1 + math.sqrt(longest))
    queries = vectors[np.argsort(-(points[:, :-1] ** 2).sum(axis=1))[:20]]  # the longest ones lie near their own neighbours
    seen = [0, 0]
    for n, q in enumerate(queries):
        scores = vectors @ q
        want = sorted(((int(s), -i) for i, s in enumerate(scores)), reverse=True)[:10]
        assert sorted(mtree.search(tree, -1, q, 10, longest, slack, None, seen), reverse=True) == want
        assert sorted(mtree.search(tree, -1, q, 10, longest, slack, want[-1][0]), reverse=True) == want
    assert seen[0] < 0.2 * 20 * len(pages) and seen[1] < 0.2 * 20 * 4000
    pivots = points[mtree.far_apart(points, 40)]
    dealt = [b for b in mtree.dealer(pivots, 6, longest)(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(vectors.astype(float).tolist()), pa.array([True] * 4000)], names=["vec_id", "v", "q"])]))]
    cell, distance = (np.concatenate([np.asarray(b.column(c)) for b in dealt]) for c in (3, 4))
    radii = np.array([distance[cell == c].max() for c in range(len(pivots))])
    floors = [sorted((vectors @ q).tolist())[-10] for q in queries]
    asked = pa.RecordBatch.from_arrays([pa.array(np.arange(20)), pa.array(queries.astype(float).tolist()), pa.array(floors)], names=["vec_id", "v", "floor"])
    routed = [r for b in mtree.router(pivots, radii, 6, longest, slack)(iter([asked])) for r in b.to_pylist()]
    assert len(routed) < 0.3 * 20 * len(pivots)
    for n, q in enumerate(queries):
        best = set(cell[vectors @ q >= floors[n]].tolist())
        assert best <= {r["cell"] for r in routed if r["vec_id"] == n}


def test_scores_beyond_a_long_are_an_error(spark):
    with pytest.raises(ValueError, match="fit a long"):
        mtree.top_k(spark.createDataFrame([(0, [3e6] * 4, ""), (1, [1e9, 0.0], "")], ROWS))


def test_query(same):
    same(QUERIES["op8_top_k"], ORACLE_SQL["op8_top_k"])
