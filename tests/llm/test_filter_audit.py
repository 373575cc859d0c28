import random
from collections import Counter
from itertools import permutations

from plumbline.llm.filter_audit import audit, failures
from plumbline.llm.queries import ORACLE_SQL, QUERIES

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    out = [""]
    for c in text:
        if c in SPACE:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def masks(rows):
    """(id, part, mask) by brute force."""
    out = []
    for i, text, lang in rows:
        t = text or ""
        w = words_of(t)
        e = any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in rows)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), e)
        out.append((i, lang or "", sum(f << k for k, f in enumerate(fails))))
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *y in labels if y[k] == 1 and i is not None} for k in (0, 1))
    found = masks(rows)
    out = Counter()
    for part in {p for _, p, _ in found}:
        removed_of = Counter()
        lines = []
        for order in permutations(range(5)):
            name, left = "".join("ABCDE"[k] for k in order), [(i, m) for i, p, m in found if p == part]
            for s, k in enumerate(order):
                here = [(i, m) for i, m in left if m >> k & 1]
                fails = sum(m >> k & 1 for _, p, m in found if p == part)
                left = [(i, m) for i, m in left if not m >> k & 1]
                removed_of[k] += len(here)
                alone = sum(m == 1 << k for _, p, m in found if p == part)
                lines.append((k, part, name, s + 1, len(left), len(here), fails - len(here), alone, sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)))
        for k, *line in lines:
            out[(*line, removed_of[k])] += 1
    return out


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, 7, "x") for i, t, lang in rows], "doc_id long, text string, lang string, mask int, part string")


def corpus(n, seed=3):
    rng = random.Random(seed)
    texts = []
    for _ in range(n // 3):
        w = [rng.choice(["La", "mi", "TO", "ren", "sa#", "du", "kö"][: rng.randint(1, 7)]) + str(rng.randrange(9 ** rng.randint(1, 4))) for _ in range(rng.choice([0, 1, 5, 199, 200, 260]))]
        texts.append(rng.choice([" ", "\n", "\x1c", "\xa0 "]).join(w))
    hot = texts[0]
    rows = [(i, rng.choice([hot, rng.choice(texts), None, ""]), rng.choice(["en", "de", "", None])) for i in range(n)]
    return rows + [(None, hot, "en"), (None, None, "fr"), (None, "alone", "fr"), (None, "alone", "fr"), (5, rows[5][1], rows[5][2]), (3, hot, "de"), (n + 1, "long " * 100_000, "en")]


def test_every_order_step_and_count_against_brute_force(spark):
    rows = corpus(240)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 240, 3)] + [(6, 0, 1), (9, None, None), (None, 1, 1)]
    got = audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert Counter(map(tuple, got)) == brute(rows, labels)
    assert len(got) == 600 * len({r.part for r in got})


def test_groups_that_span_tasks_keep_their_first_row(spark):
    rows = [(i, "one text" if i % 3 else f"text {i // 6}", "en") for i in range(3000)] + [(i, "one text", "en") for i in (1, 4, 2999)] + [(None, "one text", "en")] * 3
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert Counter(map(tuple, failures(documents(spark, rows).repartition(5)).collect())) == Counter(masks_fast(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def masks_fast(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    return [(i, p, 1 + 16 * (t in least and (i is None or i > least[t]))) for i, t, p in rows]


def test_empty_tables(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, labels).count() == 0
    rows = audit(documents(spark, [(1, None, None)]), labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows if r.filter_order == "ABCDE") == 1


def test_query(same):
    same(QUERIES["op13_filter_audit"], ORACLE_SQL["op13_filter_audit"])
