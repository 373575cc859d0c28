import itertools
import random

import numpy as np
import xxhash

from plumbline.llm import simhash
from plumbline.llm.queries import QUERIES


def brute_print(text, words=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, max_bits=2):
    """prints: (id, fingerprint) rows; the smallest id of each row's component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= max_bits:
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [least[find(i)] for i in range(len(prints))]


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op6_simhash"](spark, sf).collect()}
    prints = [(d.doc_id, brute_print(d.text)) for d in docs]
    for (doc, fp), root in zip(prints, brute_components(prints), strict=True):
        assert got[doc].fingerprint == format(fp, "016x") and got[doc].component_id == root


def nodes_of(spark, prints):
    return spark.createDataFrame([(i, format(p, "016x")) for i, p in enumerate(prints)], "node long, fingerprint string")


def test_links_of_dense_clusters_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 20)
    rng = random.Random(3)
    prints = set()
    for _ in range(4):  # many prints that share most blocks, some near each other and some not
        base = rng.getrandbits(64)
        for _ in range(120):
            prints.add(base ^ sum(1 << rng.randrange(24) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1)
    prints = [*prints, *(rng.getrandbits(64) for _ in range(100))]
    links = simhash.close_links(nodes_of(spark, prints), 64, 2, 4, 2, [])
    assert all((prints[r.a] ^ prints[r.b]).bit_count() >= 0 for r in links.collect())
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    want = brute_components(list(enumerate(prints)))
    assert [roots.get(i, i) for i in range(len(prints))] == want


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert all(roots[i] == 0 for i in range(1, 301)) and roots[901] == 900


def test_nulls_short_texts_repeats_and_clashing_columns(spark):
    rows = [(5, None, "a"), (4, "", "b"), (4, "", "b"), (9, "one", "c"), (8, "ONE", "d"), (7, "one two", "e"), (None, "one", "f"), (3, " \t\n", "g"), (2, "w " * 50_000, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id or -1), r.component_id) for r in got) == [(-1, 8), (2, 2), (3, 3), (4, 3), (4, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(6))
    rows, families = [], 12
    for f in range(families):
        words = [word() for _ in range(250)]
        for k in range(6):
            copy = list(words)
            for at in rng.sample(range(250), k // 2):
                copy[at] = word()
            rows.append((f * 10 + k, " ".join(copy)))
    rows += [(1000 + i, " ".join(word() for _ in range(rng.randint(5, 200)))) for i in range(60)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {f * 10 for f in range(families)} | {1000 + i for i in range(60)}


def test_lanes_are_further_bits_of_the_hashes():
    h = np.array([1, 2, 3], dtype=np.uint64)
    assert len(simhash.fingerprint(h, 4)) == 32 and simhash.fingerprint(h, 4)[:8] == simhash.fingerprint(h)
    assert simhash.fingerprint(np.empty(0, dtype=np.uint64)) == b"\0" * 8


def test_forest_connects_what_all_pairs_connect_closest_first():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 60, (2, 400))
    bits = rng.integers(0, 9, 400)
    kept = simhash.forest(60, pairs, bits)
    for most in range(9):
        whole = simhash.settle(np.arange(60), pairs[:, bits <= most])
        some = simhash.settle(np.arange(60), pairs[:, kept[bits[kept] <= most]])
        assert (whole == some).all()
    assert len(kept) < 120  # at most one pair for each cluster and round


def test_similarity_is_exact(spark):
    rng = random.Random(4)
    words = [f"w{rng.getrandbits(40)}" for _ in range(104)]  # a hundred shingles of five words
    far, near = list(words), list(words)
    far[50:58] = [f"x{i}" for i in range(8)]  # 12 of 100 shingles go: 88 of 112, below 0.8
    near[50:56] = [f"y{i}" for i in range(6)]  # 10 of 100 go: 90 of 110, above it
    rows = [(1, " ".join(words)), (2, " ".join(far)), (3, " ".join(near))]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {1, 2}


def kept_of(spark, texts):
    return {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_equal_fingerprints_are_held_against_the_similarity(spark):
    rng = random.Random(5)
    body = lambda n: " ".join(f"w{rng.getrandbits(40)}" for _ in range(n))
    line = "one two three four five six seven eight nine "
    texts = ["spam " * 1000 + body(300) for _ in range(2)] + [line * 200 + body(150) for _ in range(2)]
    assert kept_of(spark, texts) == {0, 1, 2, 3}
    assert kept_of(spark, ["spam " * 1000, "spam " * 900, texts[0], "spam " * 50 + texts[0]]) == {0, 2}


def test_no_pair_hangs_on_which_candidates_connect_a_family(spark, monkeypatch):
    rng = random.Random(11)
    token = lambda: f"w{rng.getrandbits(40)}"
    base = [token() for _ in range(1004)]
    texts = []
    for k in range(250):  # a family at J of about 0.76, and in it pairs at 0.8018
        copy = list(base)
        for at in rng.sample(range(200), 14):
            copy[at * 5 + 4] = token()
        texts.append(copy)
        if k % 10 == 0:
            pair = list(copy)
            for at in rng.sample([i for i in range(200) if copy[i * 5 + 4] == base[i * 5 + 4]], 22):
                pair[at * 5 + 4] = token()
            texts.append(pair)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    assert len(root) - len(set(root)) >= 25
    rows = [" ".join(t) for t in texts]
    assert kept_of(spark, rows) == set(root)
    monkeypatch.setattr(simhash, "MEET", 16)
    assert kept_of(spark, rows) == set(root)


def test_recall_of_short_texts_repeats_and_pairs_at_the_threshold(spark):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    texts, last = [], lambda: [texts.append(" ".join(w)) for w in pair]
    for _ in range(150):
        body = words(8)
        pair = (body, [*body, *words(1)])  # J 4/5
        last()
    for _ in range(150):
        body = words(60)
        pair = ([*body, *["spam"] * 400], [*body, *["ham"] * 400])  # J 56/66
        last()
    for _ in range(300):
        body = words(404)
        pair = (body, [*words(44), *body[44:]])  # J 356/444 = 0.802
        last()
    kept = kept_of(spark, texts)
    gone = [i for i in range(0, len(texts), 2) if i in kept and i + 1 not in kept]
    assert len([i for i in gone if i < 300]) == 150 and len([i for i in gone if 300 <= i < 600]) == 150
    assert len([i for i in gone if i >= 600]) >= 297


def test_near_pairs_are_those_of_brute_force_and_only_across_sides():
    import numpy as np

    from plumbline.llm import simhash

    r = np.random.default_rng(3)
    for lanes, max_bits in ((1, 2), (1, 20), (2, 40), (4, 64), (4, 100)):
        sizes = [1, 2, 5, simhash.SMALL - 1, simhash.SMALL, 70, 300, 1100]
        keys, n = np.repeat(np.arange(len(sizes)), sizes), sum(sizes)
        prints = r.integers(0, 1 << 64, (n, lanes), dtype=np.uint64)
        for _ in range(2 * n):  # near ones, also by chains, and opposites: all bits differ
            a = int(r.integers(n))
            b = int(r.choice(np.flatnonzero(keys == keys[a])))
            prints[b] = prints[a]
            for bit in r.integers(0, 64 * lanes, int(r.integers(0, 2 * max_bits))):
                prints[b, bit // 64] ^= np.uint64(1 << int(bit) % 64)
        prints[-1] = ~prints[-2]
        sides = np.zeros(n, dtype=np.int32)
        sides[-400:] = 1  # of the last key
        i, j = np.triu_indices(n, 1)
        same = keys[i] == keys[j]
        i, j = i[same], j[same]
        bits = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1)
        near = bits <= max_bits
        for side in (sides, 0 * sides, 0 * sides + 1):
            meet = near & ((keys[i] != len(sizes) - 1) | (side[i] != side[j]) | (side.min() == side.max()))
            got = [(p, b) for p, b in simhash.near(keys, side, prints, max_bits)]
            pairs = sorted((*map(int, p[:, k]), int(b[k])) for p, b in got for k in range(len(b)))
            assert pairs == sorted(zip(i[meet].tolist(), j[meet].tolist(), bits[meet].tolist()))
            want = simhash.settle(np.arange(n), np.stack([i[meet], j[meet]]))
            for find in (simhash.spanning, simhash.linked):
                a, b = find(keys, side, np.arange(n), prints, max_bits)
                assert (simhash.settle(np.arange(n), np.stack([a, b])) == want).all()
    assert [x for x in simhash.near(np.empty(0, np.int64), np.empty(0, np.int32), np.empty((0, 4), np.uint64), 64)] == []


def test_chunks_of_a_hot_key_connect_all_that_it_connects(spark, monkeypatch):
    import numpy as np

    from plumbline.llm import simhash

    monkeypatch.setattr(simhash, "CHUNK", 40)
    r = np.random.default_rng(5)
    prints = r.integers(0, 1 << 64, (300, 1), dtype=np.uint64) >> np.uint64(16)  # the first block is the same for all
    for k in range(1, 300, 2):
        prints[k] = prints[k - 1] ^ np.uint64(1 << int(r.integers(40)))
    nodes = spark.createDataFrame([(k, f"{int(p):016x}") for k, p in enumerate(prints[:, 0])], "node long, fingerprint string")
    for find in (simhash.linked, simhash.spanning):
        links = simhash.close_links(nodes, 64, 2, 4, 1, [], find).collect()
        label = simhash.settle(np.arange(300), np.array([(x.a, x.b) for x in links]).T)
        i, j = np.triu_indices(300, 1)
        near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1) <= 2
        assert (label == simhash.settle(np.arange(300), np.stack([i[near], j[near]]))).all()
