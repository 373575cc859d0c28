import hashlib
import random

from plumbline.operators import evaluation, integrity


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(n, tree="t"):
    return [(tree, f"d{k % 7}/f{k}", k, sha(str(k)), k % 2 == 0) for k in range(n)]


def frame(spark, some):
    return spark.createDataFrame(some, "tree string, path string, size long, sha256 string, executable boolean")


def plain_root(some, depth):
    """The root by recursion over the digests of paths."""

    def node(prefix, mine):
        if len(prefix) == depth:
            return sha("".join(sha("\x1f".join((p, str(size), s, str(x).lower()))) for _, p, size, s, x in sorted(mine, key=lambda r: r[1])))
        below = sorted({sha(r[1])[: len(prefix) + 1] for r in mine})
        return sha("".join(b + node(b, [r for r in mine if sha(r[1]).startswith(b)]) for b in below))

    return node("", some)


def test_roots_against_recursion_and_the_order_of_rows(spark):
    some = rows(150) + rows(40, "u")
    mixed = some[:]
    random.Random(1).shuffle(mixed)
    for depth in (1, 3):
        got = {r.tree: r.tree_sha256 for r in integrity.tree_digest(frame(spark, mixed), "tree", depth=depth).collect()}
        assert got == {t: plain_root([r for r in some if r[0] == t], depth) for t in "tu"}
    assert integrity.tree_digest(frame(spark, []), "tree").count() == 0


def test_a_change_touches_one_way_up_and_shows_in_proofs(spark):
    some = rows(200)
    path = some[17][1]
    for other in ((*some[17][:3], sha("x"), some[17][4]), (*some[17][:4], not some[17][4])):
        before, after = (integrity.tree_nodes(frame(spark, x), "tree") for x in (some, [*some[:17], other, *some[18:]]))
        assert sorted(r.prefix for r in integrity.changed_nodes(before, after, "tree").collect()) == [sha(path)[:k] for k in range(4)]
        leaf = [r for r in some if sha(r[1])[:3] == sha(path)[:3]]
        ok = integrity.leaf_proofs(frame(spark, leaf), before, "tree").first()
        assert ok.ok and ok.leaf == sha(path)[:3] and [s.level for s in ok.steps] == [0, 1, 2]
        assert not integrity.leaf_proofs(frame(spark, leaf), after, "tree").first().ok
        assert not integrity.leaf_proofs(frame(spark, [(*r[:2], 1 + r[2], *r[3:]) for r in leaf]), before, "tree").first().ok


def test_a_repeated_or_unknown_prediction_is_a_fault_and_counts_once(spark):
    state = "array<struct<key:string,value:string>>"
    expected = spark.createDataFrame([("t", "p1", [("a", "1")]), ("t", "p2", [])], f"task_id string, probe_id string, expected {state}")
    given = spark.createDataFrame([("t", "p1", [("a", "1")], "s"), ("t", "p1", [("a", "1")], "s"), ("t", "p2", [], "s"), ("t", "p2", [("b", "2")], "s"), ("t", "p9", [], "other")], f"task_id string, probe_id string, active_constraints {state}, public_corpus_sha256 string")
    assert [(r.total, r.submitted, r.correct) for r in evaluation.dialogue_score(expected, given).where("task_id = 't'").collect()] == [(2, 2, 1)]
    declared = spark.createDataFrame([("t", "a")], "task_id string, key string")
    faults = evaluation.dialogue_faults(expected, declared, given, "s")
    assert sorted(map(tuple, faults.collect())) == [("t", "p1", "repeated"), ("t", "p2", "repeated"), ("t", "p2", "undeclared key"), ("t", "p9", "another corpus"), ("t", "p9", "unknown probe")]
    split = spark.createDataFrame([("e", "sealed_test")], "example_id string, role string")
    truth = spark.createDataFrame([("e", "1")], "example_id string, outputs string")
    twice = spark.createDataFrame([("e", "1"), ("e", "1")], "example_id string, outputs string")
    assert [(r.correct, r.total) for r in evaluation.sealed_score(split, truth, twice).collect()] == [(1, 1)]
    assert [(r.correct, r.total) for r in evaluation.sealed_score(split, truth, twice.unionByName(truth.selectExpr("example_id", "'0' as outputs"))).collect()] == [(0, 1)]
