import random
import time
from fractions import Fraction

from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import integrity
from plumbline.operators.routing import ambiguous_rules, indexed, route

RULE = "rule_index int, match map<string,string>, priority int, target_id string, rule_set string"


def maps(rng, keys="abcd", most=4):
    return {k: rng.choice("xyz") for k in rng.sample(keys, rng.randint(0, min(most, len(keys))))}


def test_routes_and_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    rules = [(i, maps(rng), rng.randint(0, 3), f"t{i}", rng.choice("pq")) for i in range(120)]
    requests = [(r, maps(rng, "abcdef")) for r in range(150)] + [(150, {}), (151, {"a": None})]
    table = spark.createDataFrame(rules, RULE)
    for some in (rules, [r for r in rules if r[1]], []):
        want = {}
        for rid, meta in requests:
            met = [(p, -i, t) for i, m, p, t, _ in some if all(meta.get(k) == v for k, v in m.items())]
            want[rid] = max(met)[2] if met else "none"
        got = route(spark.createDataFrame(requests + requests[:5], "request_id int, metadata map<string,string>"), spark.createDataFrame(some, RULE), "none").collect()
        assert len(got) == len(requests) and dict(map(tuple, got)) == want
    pairs = {}
    for i, m, p, _, s in rules:
        over = [j for j, n, q, _, t in rules if j != i and q == p and s == t and all(m[k] == n[k] for k in m.keys() & n.keys())]
        if over:
            pairs[i] = (len(over), min(over))
    assert {r.rule_index: (r.overlaps, r.first_overlap) for r in ambiguous_rules(table, "rule_set").collect()} == pairs
    assert ambiguous_rules(table.limit(0), "rule_set").count() == 0


def test_a_hundred_thousand_rules(spark):
    n = 100_000
    rules = spark.range(n).select(F.col("id").cast("int").alias("rule_index"), F.create_map(F.lit("env"), F.lit("prod"), F.lit("user"), F.concat(F.lit("u"), (F.col("id") % 50_000).cast("string"))).alias("match"), (F.col("id") % 3).cast("int").alias("priority"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("target_id"))
    requests = spark.range(3000).select(F.col("id").alias("request_id"), F.create_map(F.lit("env"), F.lit("prod"), F.lit("user"), F.concat(F.lit("u"), F.col("id").cast("string"))).alias("metadata"))
    assert indexed(requests, rules).where("key <> 'user'").count() == 0
    got = {r.request_id: r.target_id for r in route(requests, rules, "none").collect()}
    assert got == {i: f"t{max((i, i + 50_000), key=lambda k: (k % 3, -k))}" for i in range(3000)}


def brute_cyclic(edges):
    left = {(w, n, u) for w, n, u in edges if u is not None}
    while True:
        now = {(w, n, u) for w, n, u in left if any((w, u) == (x, m) for x, m, _ in left)}
        if now == left:
            return {(w, n) for w, n, _ in left}
        left = now


def test_workflow_cycles(spark):
    rng = random.Random(5)
    edges = [(f"w{w}", str(rng.randrange(12)), rng.choice([None, *map(str, range(14))])) for w in range(25) for _ in range(rng.randint(1, 16))]
    edges += [("pair", "a", "b"), ("pair", "b", "a"), ("pair", "c", "a"), ("pair", "c", "d"), ("self", "a", "a"), ("fine", "a", "b"), ("fine", "a", "b"), ("fine", "b", None)]
    got = {tuple(r) for r in integrity.cyclic(spark.createDataFrame(edges, "workflow string, node string, needs string")).collect()}
    assert got == brute_cyclic(edges) and len(got) > 20
    n = 10_000
    chain = spark.range(n).select(F.explode(F.array(F.lit("open"), F.lit("closed"))).alias("workflow"), F.col("id").alias("node"), (F.col("id") + 1).alias("needs"))
    chain = chain.unionByName(spark.createDataFrame([("closed", n, n // 2)], "workflow string, node long, needs long"))
    start = time.perf_counter()
    assert integrity.cyclic(chain).groupBy("workflow").count().collect() == [("closed", n + 1)]
    assert time.perf_counter() - start < 300


def test_tails_against_fractions():
    rng = random.Random(7)
    for c, b in [(rng.randint(0, 3000), rng.randint(0, 3000)) for _ in range(60)] + [(501 + k, 501) for k in range(5)] + [(2000, 501), (5000, 4900), (4000, 4000), (0, 0), (3, 0)]:
        exact = scalars.mcnemar_tail(c, b)
        low, high = scalars.mcnemar_bounds(c, b)
        if exact > Fraction(1, 10**300):
            assert Fraction(low) <= exact <= Fraction(high) and high - low <= 1e-9 * high
            near = [exact, exact + Fraction(1, 10**12) * exact, exact - Fraction(1, 10**12) * exact, exact * Fraction(9, 10)]
            assert [scalars.tail_exceeds(c, b, x) for x in near] == [False, False, True, True]
    start = time.perf_counter()
    low, high = scalars.mcnemar_bounds(501_000, 499_000)
    assert 0.0228 < low <= high < 0.0229 and high - low < 1e-9 and not scalars.tail_exceeds(501_000, 499_000, Fraction(1, 20)) and scalars.tail_exceeds(501_000, 499_000, Fraction(2, 100))
    assert time.perf_counter() - start < 1
