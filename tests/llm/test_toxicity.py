import os
import random
import zlib

import pytest

from plumbline.llm.queries import QUERIES
from plumbline.llm.toxicity import drop_toxic, fit, subwords, toxicity, train

BAD = ["idiot", "moron", "worthless", "pathetic"]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["la", "mi", "to", "ren", "sa", "du", "ko"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 300))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_misspellings(spark):
    rows = corpus()
    docs, labels = frames(spark, rows + [(10_000, "la mi to idioot sa moronn ko du", 0), (10_001, "la mi to ren sa ko du lami", 0)])
    got = {r.doc_id: r for r in toxicity(docs, labels.where("doc_id < 10000")).collect()}
    held = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert sum(y == p for y, p in held) / len(held) >= 0.9 and len(held) > 40
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert got[10_000].score > got[10_001].score and got[10_000].predicted == 1 and got[10_001].predicted == 0


def test_held_out_labels_teach_nothing(spark):
    rows = corpus(120)
    docs, labels = frames(spark, rows)
    turned = spark.createDataFrame([(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: r.score for r in toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_edges(spark):
    rows = corpus(80)
    docs, labels = frames(spark, rows)
    odd = spark.createDataFrame([(None, "la mi", 0.1), (500, None, 0.1), (501, " \n", 0.1), (502, "la " * 100_000, 0.1), (502, "la " * 100_000, 0.1)], docs.schema)
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity(odd.unionByName(docs), labels).collect()]
    assert len(got) == 85 and all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, p in got)
    assert {s for i, s, _ in got if i in (500, 501)} == {0.0}
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity(docs, labels.withColumn("toxic", labels.toxic * 0)).collect()} == {0.0}
    kept = drop_toxic(odd.unionByName(docs), labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, _, p in got if not p)


def test_the_text_that_teaches_does_not_hang_on_the_order_of_rows(spark):
    rows = corpus(150)
    docs, labels = frames(spark, rows + [(i, "la mi to " + rng_text, y) for (i, _, y), (_, rng_text, _) in zip(rows, corpus(150, 5), strict=True)])
    a, b = (train(d, labels).bucket for d in (docs, docs.orderBy(docs.text.desc()).repartition(3)))
    assert (a == b).all() and a.any()


def languages(seed=2):
    """Texts in four made-up languages; the small ones have 20 to 60 toxic texts, and toxic words that only begin alike."""
    rng = random.Random(seed)
    parts = {"a": ["la", "mi", "to", "ren"], "b": ["ouk", "vez", "ji", "pag"], "c": ["sch", "eit", "urg", "wo"], "d": ["ñor", "iez", "ada", "quo"]}
    begin = {"a": "idiot", "b": "zakré", "c": "dumpf", "d": "bobos"}
    rows = []
    for lang, clean, toxic in (("a", 900, 150), ("b", 200, 40), ("c", 200, 60), ("d", 120, 25)):
        word = lambda: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))  # noqa: E731, B023
        for k in range(clean + toxic):
            words = [word() for _ in range(rng.randint(20, 250))]
            if k < toxic:
                for _ in range(max(2, len(words) // 30)):
                    words[rng.randrange(len(words))] = begin[lang] + rng.choice(parts[lang]) * rng.randint(0, 2)
            rows.append((len(rows), " ".join(words), int(k < toxic), lang))
    return rows


def test_toxic_words_of_small_languages_are_found(spark):
    rows = languages()
    docs, labels = frames(spark, [r[:3] for r in rows])
    got = {r.doc_id: r.predicted for r in toxicity(docs, labels).where("held_out").collect()}
    for lang in "abcd":
        toxic = [got[i] for i, _, y, k in rows if i in got and k == lang and y]
        assert toxic and sum(toxic) >= 0.8 * len(toxic), lang
    clean = [got[i] for i, _, y, _ in rows if i in got and not y]
    assert sum(clean) <= 0.03 * len(clean)


def test_a_text_labelled_twice_is_toxic_if_any_label_says_so(spark):
    rows = corpus(150)
    docs, labels = frames(spark, rows)
    twice = labels.unionByName(labels.withColumn("toxic", labels.toxic * 0))
    assert {r.doc_id: r.score for r in toxicity(docs, twice).collect()} == {r.doc_id: r.score for r in toxicity(docs, labels).collect()}


def test_accuracy_of_the_scores_on_what_was_held_out(spark):
    rows = corpus(600, 3)
    docs, labels = frames(spark, rows)
    held = toxicity(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r.predicted for r in held if r.toxic) >= 0.9 * sum(r.toxic for r in held)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.05 * len(held)
    good, bad = ([r.score for r in held if r.toxic == k] for k in (0, 1))
    assert sum(x < y for x in good for y in bad) >= 0.95 * len(good) * len(bad)


def test_fit_without_texts_and_shared_subwords():
    assert fit([], []).prior == 0.0 and fit(["", "a"], [1, 1]).prior == 1.0
    assert len({*subwords("idiot")} & {*subwords("idioot")}) >= 4


def test_query_against_the_labels(spark):
    """Held-out toxic texts of every language are found, and clean ones left alone."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = QUERIES["op10_toxicity"](spark, sf).cache()
    assert scored.count() == docs.count() and not scored.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count()
    held = scored.where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    scored.unpersist()
    for lang in ("en", "de", "fr", "es"):
        toxic = [r.predicted for r in held if r.toxic and r.lang == lang]
        assert sum(toxic) >= 0.55 * len(toxic), lang
    toxic, clean = ([r.predicted for r in held if r.toxic == k] for k in (1, 0))
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.03 * len(clean)
