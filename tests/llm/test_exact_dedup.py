import hashlib
import random
import re

import pyarrow as pa

from plumbline.llm import exact_dedup as exact_dedup_module
from plumbline.llm.exact_dedup import DIGESTS, Directory, Entry, build_index, drop_copies, exact_dedup, lookup
from plumbline.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, key string, norm int"


def brute(rows):
    classes = {}
    for i, (doc_id, text, *_) in enumerate(rows):
        classes.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    return {i: (rows[min(c)[3]][0], len(c), i == min(c)[3], hashlib.sha256(norm.encode()).hexdigest()) for norm, c in classes.items() for *_, i in c}


def test_against_brute_force_with_nulls_copies_and_clashing_columns(spark):
    rows = [(1, "a b", "x", 1), (2, "ab", "x", 2), (3, None, "x", 3), (4, "", "x", 4), (5, " \t\n\r\f\v", "x", 5), (None, "a  b", "x", 6), (7, "ab", "y", 7), (7, "ab", "y", 7), (8, "é b", "z", 8), (9, "x" * 200_000, "z", 9), (10, "x" * 100_000 + " " + "x" * 100_000, "z", 9), (11, "a\x0b\x0cb", None, None), (12, "a\x1fb", None, None)]
    got = exact_dedup(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    want = brute(rows)
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == sorted((rows[i][0] or -1, *w) for i, w in want.items())


def test_copies_over_many_partitions_leave_one_row_each(spark):
    rows = [(i, f"text {i % 7}", "k", i) for i in range(400)]
    kept = drop_copies(spark.createDataFrame(rows, DOCS).repartition(13))
    assert kept.columns == ["doc_id", "text", "key", "norm"]
    assert sorted(r.doc_id for r in kept.collect()) == list(range(7))


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup(empty).count() == 0 and drop_copies(empty).count() == 0


def keys_of(n):
    keys = [int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:8], "big") >> 4 | 5 << 60 for i in range(n)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def test_directory_doubles_splits_and_keeps_chains_together():
    d = Directory(4, 3)
    keys = keys_of(300)
    keys += [keys[0]] * 9  # one key, many texts: no split can part them
    for i, k in enumerate(keys):
        d.insert(k, Entry(b"%d" % i, "", 1, (0, False, i, i, i), [i]))
    assert all(d.find(k, b"%d" % i).reps == [i] and d.find(k, b"none") is None for i, k in enumerate(keys))
    top, *pages = d.pages(5)
    assert 1 << d.depth == len(top["slots"]) == len(d.slots) and len(pages) > 50
    assert sorted(r for p in pages for e in p["entries"] for r in e["reps"]) == list(range(309))
    for p in pages:
        assert len({e["key"] for e in p["entries"]}) <= 3
        assert all(top["slots"][d.bits(e["key"], d.depth)] == p["bucket"] for e in p["entries"])


def owned(rows, capacity=4):
    batch = pa.RecordBatch.from_pylist([dict(zip(("key_range", "key", "norm", "text_sha256", "rep_row", "n", "best_chars", "best_id", "best_row"), r, strict=True)) for r in rows])
    out = [p for b in exact_dedup_module.owner(1, capacity)(iter([batch])) for p in b.to_pylist()]
    return sorted((e["keep_id"], e["group_size"], sorted(e["reps"])) for p in out if p["entries"] for e in p["entries"])


def test_owner_finds_equals_in_any_order_and_only_by_its_directory(monkeypatch):
    keys = keys_of(40)
    rows = [(1 if k < 0 else 0, k, b"t%d" % (i % 20), "", i, 1, 9, i, i) for i, k in enumerate([*keys[:20], *keys[:20]])]
    want = owned(sorted(rows))
    assert [n for _, n, _ in want] == [2] * 20
    for seed in range(5):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        assert owned(sorted(mixed, key=lambda r: r[0])) == want
    monkeypatch.setattr(Directory, "find", lambda *_: None)
    assert [n for _, n, _ in owned(sorted(rows))] == [1] * 40


def test_long_lists_of_copies_go_on_in_further_pages(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup_module, "PAGE_REPS", 3)
    key = keys_of(1)[0]
    assert owned([(1 if key < 0 else 0, key, b"t", "", i, 1, 9, i, i) for i in range(10)]) == [(0, 10, [0, 1, 2]), (0, 10, [3, 4, 5]), (0, 10, [6, 7, 8]), (0, 10, [9])]


def test_equal_keys_are_told_apart_by_their_bytes(spark):
    cells = [(1, 1, "s", 42, 1, b"one", 1, 3, 1, 1), (2, 2, "s", 42, 2, b"two", 1, 3, 2, 2), (3, 3, "s", 42, 3, b"one", 1, 4, 3, 3)]
    pages = build_index(spark.createDataFrame(cells, DIGESTS)).where("entries is not null").collect()
    index = {rep: e for p in pages for e in p.entries for rep in e.reps}
    assert index[1].keep_row == index[3].keep_row == 3 and index[1].group_size == 2
    assert index[2].keep_row == 2 and index[2].chain != index[1].chain


def test_later_batches_are_looked_up_in_the_pages(spark):
    docs = spark.createDataFrame([(i, f"text {i % 90}", "k", i) for i in range(300)], DOCS).repartition(3)
    digests = docs.select(docs.doc_id.alias("row_id"), "doc_id", "text").mapInArrow(exact_dedup_module.digest_rows, DIGESTS)
    index = build_index(digests, capacity=2)
    later = spark.createDataFrame([(1000 + i, f"te xt\t{i}", "k", i) for i in range(120)] + [(5000, None, "k", 1)], DOCS)
    got = {r.doc_id: r.keep_id for r in lookup(index, later).collect()}
    assert got == {1000 + i: i if i < 90 else None for i in range(120)} | {5000: None}


def test_query(same):
    same(QUERIES["op1_exact_dedup"], ORACLE_SQL["op1_exact_dedup"])
