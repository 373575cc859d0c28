import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import katz
from plumbline.llm.queries import QUERIES

END = b"\n"


class Brute:
    """n-grams as tuples in dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = {n: collections.Counter() for n in range(1, order + 1)}
        self.after = collections.defaultdict(set)
        for t in texts:
            for gram in self.grams(t):
                for n in range(1, order + 1):
                    self.counts[n][gram[-n:]] += 1
                    self.after[gram[-n:-1]].add(gram[-1])
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.above = collections.Counter()
        for n in range(2, order + 1):
            for gram, c in self.counts[n].items():
                self.above[gram[:-1]] += c
        of = lambda c: [collections.Counter(c.values())[r] for r in range(1, katz.K + 2)]
        self.m = katz.Discounts({n: [*of(c), sum(c.values()), len(c)] for n, c in self.counts.items()})

    @staticmethod
    def split(text):
        return [*(text or "").encode().lower().split(), END]

    def grams(self, text):
        padded = [END] * (self.order - 1) + self.split(text)
        return [tuple(padded[i : i + self.order]) for i in range(len(padded) - self.order + 1)]

    def seen(self, gram):
        c, n = self.counts[len(gram)][gram], len(gram)
        return (self.m.of[n][c] if c <= katz.K else 1) * c / ((self.above[gram[:-1]] if n > 1 else self.n) + katz.KEPT)

    def alpha(self, h):
        if not self.above[h]:
            return 1.0
        return (1 - sum(self.seen((*h, w)) for w in self.after[h])) / (1 - sum(self.p((*h[1:], w)) for w in self.after[h]))

    def p(self, gram):
        if self.counts[len(gram)][gram]:
            return self.seen(gram)
        return self.m.unknown if len(gram) == 1 else self.alpha(gram[:-1]) * self.p(gram[1:])

    def score(self, text):
        return sum(math.log10(self.p(g)) for g in self.grams(text))

    def base(self, text):
        return sum(math.log10((self.counts[1][(x,)] + 1) / (self.n + self.v + 1)) for x in self.split(text))


def check(rows, got, held, order=katz.ORDER):
    b = Brute([t for i, t in rows if not held(i)], order)
    by = {(r.doc_id, r.n_tokens, round(r.score, 6)): r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        w = b.split(t)
        r = by[i, len(w), round(b.score(t), 6)]
        assert r.held_out == held(i) and r.n_known == sum(b.counts[1][(x,)] > 0 for x in w) and r.train_tokens == b.n
        assert r.base_score == pytest.approx(b.base(t), rel=1e-9) and r.score == pytest.approx(b.score(t), rel=1e-9)
    return b


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    b = check(rows, QUERIES["op5_katz"](spark, sf).collect(), lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    sums_to_one(b, [(), (END,), (b"the",), *[(w,) for (w,) in list(b.counts[1])[5:8]]])


def sums_to_one(b, histories):
    """Over the vocabulary and the unknown word."""
    words = [w for (w,) in b.counts[1]] + [b"never seen"]
    for h in histories:
        assert sum(b.p((*h, w)) for w in words) == pytest.approx(1)


def test_longer_orders_back_off_recursively(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefg") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for order in (1, 3, 4):
        got = katz.katz_scores(docs, F.col("doc_id") % 4 == 1, order=order).collect()
        b = check(rows, got, lambda i: i % 4 == 1, order)
        if order == 3:
            sums_to_one(b, [(), (END,), (END, END), (b"a", b"b"), (b"aa", b"g"), (b"zz", b"a"), (b"a", b"zz")])


def test_a_stored_model_scores_other_texts(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))
    first, later = [(i, text()) for i in range(80)], [(i, text()) for i in range(500, 530)] + [(600, "x y a b"), (601, None)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    model = katz.train(frame(first).repartition(3), order=3)
    got = {r.doc_id: r.score for r in model.score(frame(later).repartition(2)).collect()}
    b = Brute([t for _, t in first], 3)
    assert got == {i: pytest.approx(b.score(t), rel=1e-9) for i, t in later}


def test_nulls_repeats_and_small_chunks(spark, monkeypatch):
    rows = [(1, "A b\tA"), (2, None), (2, None), (3, ""), (None, "a b a b c"), (5, "zz É é\x0bq"), (5, "zz É é\x0bq"), (6, "x " * 3000)]
    monkeypatch.setattr(katz, "CHUNK_ROWS", 2)
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, score int").coalesce(1)
    check(rows, katz.katz_scores(docs, F.col("doc_id") == 5).collect(), lambda i: i == 5)


def test_slices_of_a_batch_without_nulls(spark, monkeypatch):
    rows = [(i, f"W{i} b\tA{i % 3} {'c ' * (i % 4)}") for i in range(30)]
    monkeypatch.setattr(katz, "CHUNK_ROWS", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check(rows, katz.katz_scores(docs, F.col("doc_id") % 5 == 1).collect(), lambda i: i % 5 == 1)


def test_a_batch_of_more_rows_than_a_chunk(spark):
    rows = [(i, f"A{i % 50} b c{i % 7}") for i in range(katz.CHUNK_ROWS + 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check(rows, katz.katz_scores(docs, F.col("doc_id") % 5 == 1).collect(), lambda i: i % 5 == 1)


def wide(seed):
    """Texts of words of which most are in few texts, with copies, one-word and empty ones."""
    rng = random.Random(seed)
    text = lambda: " ".join(f"w{int(300 * rng.random() ** 3)}" for _ in range(rng.choice([0, 1, 5, 40])))
    rows = [(i, text()) for i in range(90)]
    return rows + [(i + 100, rows[i][1]) for i in range(0, 90, 9)]


def test_questions_leave_out_what_only_their_chunk_knows(spark, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_ROWS", 8)
    rows, held = wide(11), lambda i: i % 4 == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    chunks, folder = katz.chunks_of(docs, F.col("doc_id") % 4 == 1, "doc_id", "text")
    _, answers, parts = katz.learned(chunks, folder, 2, False)
    asked = katz.questions(chunks, folder, 3, 1, answers).agg(F.sum("n_hist").alias("h"), F.sum("n_grams").alias("g"), F.sum(F.col("totals")[katz.K + 1]).alias("own")).first()
    b, texts = Brute([t for i, t in rows if not held(i)], 3), dict(rows)
    of_chunks = [katz.Chunk(folder, c.asDict(), 1).doc_ids for c in chunks.collect()]
    trigrams = [{g for i in ids for g in b.grams(texts[i])} | {(END, END, END)} for ids in of_chunks]
    holders = collections.Counter(h for grams in trigrams for h in {g[1:] for g in grams})
    hist = grams = own = 0
    for ids, every in zip(of_chunks, trigrams):
        needed = {g[:2] for g in every if g[:2] == (END, END) or holders[g[:2]] > 1 and b.counts[2][g[:2]]}
        hist, grams = hist + len(needed), grams + sum(g[:2] in needed for g in every)
        inside = Brute([texts[i] for i in ids if not held(i)], 3)
        own += sum(n for g, n in inside.counts[3].items() if g[:2] not in needed)
    assert (asked.h, asked.g, asked.own) == (hist, grams, own) and own > 0
    told = katz.told_to_chunks(answers, False).where("kinds IS NOT NULL OR low IS NOT NULL")
    assert told.count() == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_where_chunks_know_most_of_their_own_histories(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "CHUNK_ROWS", 8)
    monkeypatch.setattr(katz, "OWNER_ITEMS", 300)
    rows = wide(12)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(rows, katz.katz_scores(docs, F.col("doc_id") % 4 == 1, order=order).collect(), lambda i: i % 4 == 1, order)
    model = katz.train(docs, order=order)
    later = [(i, t) for i, t in wide(13)]
    got = {r.doc_id: r.score for r in model.score(spark.createDataFrame(later, "doc_id long, text string")).collect()}
    b = Brute([t for _, t in rows], order)
    assert got == {i: pytest.approx(b.score(t), rel=1e-9) for i, t in later}


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = katz.katz_scores(docs, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score, r.base_score) == (3, 0, 0, 0.0, 0.0)
    assert katz.katz_scores(docs.limit(0), F.lit(False)).count() == 0


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (katz.unpack_sorted(katz.pack_sorted(keys), 1000) == keys).all()
    assert len(katz.unpack(katz.pack(np.empty(0, dtype=np.uint64)), 0)) == 0


def test_better_than_the_base_on_what_was_held_out(spark, sf):
    r = QUERIES["op5_katz"](spark, sf).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b
