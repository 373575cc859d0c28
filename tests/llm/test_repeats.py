import hashlib
import random
import re
import zlib

import numpy as np

from plumbline.llm.queries import QUERIES
from plumbline.llm.repeats import Suffixes, blocks, periodic_runs, runs_in, runs_of_texts


def brute_runs(w):
    """All maximal stretches with smallest period q and at least max(6, 4q) words."""
    out = []
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def altered(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    if doc_id is None or not w:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text, plant=True):
    w = altered(doc_id if plant else None, text)
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def words(rng):
    """Random words over a small alphabet, periodic pieces within, nested and cut short."""
    n, letters = rng.randint(0, 120), rng.randint(1, 4)
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        root = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
        piece = (root * rng.randint(2, 9))[: rng.randint(1, 70)]
        at = rng.randint(0, len(w))
        w[at:at] = piece * rng.choice([1, 1, 2, 5])
    return w


def test_runs_of_random_texts_against_brute_force():
    rng = random.Random(4)
    texts = [words(rng) for _ in range(700)] + [[], [1] * 6, [1] * 5, [1, 2] * 4, [1, 2] * 3 + [1], [7] * 300, [1, 1, 2] * 40]
    flat, doc = np.array([x for t in texts for x in t]), np.array([d for d, t in enumerate(texts) for _ in t])
    got = [tuple(map(int, r)) for r in zip(*runs_of_texts(flat, doc), strict=True)]
    want, at = [], 0
    for t in texts:
        want += [(s + at, n, q) for s, n, q in brute_runs(t)]
        at += len(t)
    assert got == want and len(want) > 300


def test_every_run_without_the_four_grams():
    rng = random.Random(5)
    for _ in range(150):
        t = words(rng)
        s, n, q = runs_in(np.array([*t, 99]))
        assert sorted(zip(s.tolist(), n.tolist(), q.tolist(), strict=True), key=lambda r: (r[0], r[2])) == brute_runs(t)


def test_blocks_are_the_longest_that_began_before():
    rng = random.Random(6)
    for _ in range(50):
        t = [*words(rng), 99]
        starts = blocks(Suffixes(np.array(t))).tolist()
        at, want = 0, []
        while at < len(t):
            want.append(at)
            best = max((next((k for k in range(len(t)) if at + k >= len(t) or t[j + k] != t[at + k])) for j in range(at)), default=0)
            at += max(1, best)
        assert starts == [*want, len(t)]


def test_cases(spark):
    rng = random.Random(8)
    join = lambda w: "".join(f"w{x}" + rng.choice([" ", "\n", " \t\x0b"]) for x in w)
    rows = [(i, join(words(rng)), 1, 2) for i in range(120)] + [(None, "a " * 9, 1, 2), (200, None, 1, 2), (201, "", 1, 2), (202, " \n ", 1, 2), (203, "a\xa0b \x1c a\xa0b " * 8, 1, 2), (203, "a\xa0b \x1c a\xa0b " * 8, 1, 2), (204, "a b c d e", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, runs int")
    key = lambda r: (r[0] is None, r[0], r)
    assert sorted(map(tuple, periodic_runs(docs, planted=True).collect()), key=key) == sorted((expected(i, t) for i, t, *_ in rows), key=key)
    spans = {r.doc_id: r for r in periodic_runs(docs, spans=True).collect()}
    assert [tuple(x) for x in spans[None].runs] == [(0, 9, 1)] and spans[None].collapsed == "a" and spans[201].collapsed == ""
    assert periodic_runs(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    root = [f"r{i}" for i in range(5000)]
    texts = {1: " ".join(root * 12), 3: "x " * 100_000, 4: " ".join(f"u{i}" for i in range(200_000)), 6: " ".join(["a", "b"] * 30_000 + root * 4)}
    got = {r.doc_id: tuple(r)[1:6] for r in periodic_runs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: (1, 0, 60_000, 5000, 12_000), 3: (1, 0, 100_000, 1, 100_000_000), 4: (0, None, None, None, None), 6: (2, 0, 60_000, 2, 30_000_000)}


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    short = [r for r in docs if len((r.text or "").split()) <= 1500]  # the brute force is cubic at worst; the rest is compared by a quadratic one below
    assert len(short) > 0.9 * len(docs)
    for r in short:
        assert got[r.doc_id] == expected(r.doc_id, r.text)
    for r in docs:
        w = np.unique(altered(r.doc_id, r.text), return_inverse=True)[1] if r.text else np.empty(0, int)
        longest = max((m for q in range(1, len(w) // 4 + 1) for m in [longest_of(w, q)] if m >= max(6, 4 * q)), default=None)
        assert got[r.doc_id][3] == longest


def longest_of(w, q):
    """Words of the longest stretch of period q, by numpy."""
    same = np.r_[False, w[q:] == w[:-q], False].astype(np.int8)
    turn = np.flatnonzero(np.diff(same))
    return int((turn[1::2] - turn[::2]).max()) + q if len(turn) else 0
