import random

from pyspark.sql import functions as F

from plumbline.llm.mixing import leaf_budgets, mix, take
from plumbline.llm.queries import ORACLE_SQL, QUERIES

LEAVES = "domain string, lang string, source string, tokens long"


def budgets(spark, rows, weights, budget, epochs=1):
    got = leaf_budgets(spark.createDataFrame(rows, LEAVES), weights, F.lit(budget), epochs).collect()
    return {(r.domain, r.lang, r.source): r.leaf_budget for r in got}


def test_shortage_goes_to_siblings_before_other_domains(spark):
    rows = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("b", "en", "s3", 1000)]
    assert budgets(spark, rows, {}, 400) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 190, ("b", "en", "s3"): 200}
    rows = [("a", "en", "s1", 10), ("a", "en", "s2", 20), ("b", "en", "s3", 1000)]
    assert budgets(spark, rows, {}, 400) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 20, ("b", "en", "s3"): 370}
    assert budgets(spark, rows, {}, 5000) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 20, ("b", "en", "s3"): 1000}
    assert budgets(spark, rows, {"domain": {"a": 3, "b": 1}}, 40, 2) == {("a", "en", "s1"): 15, ("a", "en", "s2"): 15, ("b", "en", "s3"): 10}
    assert budgets(spark, rows, {"domain": {"b": 0}}, 400) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 20, ("b", "en", "s3"): 0}


def test_weights_of_zero_promise_nothing(spark):
    rows = [("a", "en", "s", 100), ("a", "de", "s", 1000), ("b", "en", "s", 2000)]
    assert budgets(spark, rows, {"lang": {"de": 0}}, 1000) == {("a", "en", "s"): 100, ("a", "de", "s"): 0, ("b", "en", "s"): 900}


def test_random_trees_spend_what_they_can(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(d, l, s, rng.choice([0, 7, 50, 900, 4000])) for d in "abc" for l in ("en", "de", "fr") for s in ("s0", "s1", "s2") if rng.random() < 0.8]
        weights = {"domain": {d: rng.choice([0, 1, 3]) for d in "abc"}, "lang": {x: rng.choice([0, 2, 5]) for x in ("en", "de")}, "source": {"s0": rng.choice([0, 1, 4])}}
        of = lambda level, name: weights[level].get(name, 1)  # noqa: B023, E731
        able = sum(2 * t for d, l, s, t in rows if of("domain", d) * of("lang", l) * of("source", s))
        for budget in (333, 5000, 10**6):
            got = budgets(spark, rows, weights, budget, 2)
            assert all(0 <= got[d, l, s] <= 2 * t and (got[d, l, s] == 0 or of("domain", d) * of("lang", l) * of("source", s)) for d, l, s, t in rows)
            assert min(budget, able) - 3 * len(rows) <= sum(got.values()) <= min(budget, able)


def test_ids_that_are_null_are_drawn_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"w{i} w w", "en", "src0") for i in range(100)], "doc_id long, text string, lang string, source string")
    a, b = ({r.text for r in take(d, F.lit("d"), {}, F.floor(F.col("total") / 2)).collect()} for d in (docs, docs.repartition(5)))
    assert a == b and len(a) == 50


def test_prefix_fits_and_epochs_repeat(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 5 + 1), "en", "src0", "x") for i in range(200)], "doc_id long, text string, lang string, source string, tokens string")
    m = mix(docs, F.lit("d"), {}, F.floor(F.col("total") * 3 / 2), max_epochs=3).collect()
    total = sum(r.tokens for r in m)
    taken = sum(r.tokens * r.copies for r in m)
    assert {r.copies for r in m} == {1, 2} and total * 3 // 2 - 5 < taken <= total * 3 // 2
    again = mix(docs.repartition(7), F.lit("d"), {}, F.floor(F.col("total") * 3 / 2), max_epochs=3).collect()
    assert {(r.doc_id, r.copies) for r in m} == {(r.doc_id, r.copies) for r in again}


def test_nulls_empty_texts_and_empty_table(spark):
    schema = "doc_id long, text string, lang string, source string, copies int"
    docs = spark.createDataFrame([(None, None, None, None, 1), (1, "", "en", None, 2), (1, "", "en", None, 2), (2, "a b", None, "s", 3)], schema)
    assert mix(docs, F.lit(None).cast("string"), {}, F.col("total")).count() == 4
    kept = take(docs, F.col("source"), {}, F.col("total"))
    assert kept.columns == docs.columns and 2 in [r.doc_id for r in kept.collect()]
    assert take(docs.limit(0), F.col("source"), {}, F.col("total")).count() == 0


def test_query(same):
    same(QUERIES["op4_mixing"], ORACLE_SQL["op4_mixing"])
