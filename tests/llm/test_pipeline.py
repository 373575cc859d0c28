import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ba", "re", "mo", "ti", "lu", "san", "ke"]) for _ in range(rng.randint(2, 4)))
    text = lambda n=150: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        t = text()
        if i % 3 == 0:
            t = " ".join(w if rng.random() > 0.04 else "worthless" for w in t.split()) + " worthless"
        rows.append((i, t, "en", f"src{i % 5}", len(t)))
        labels.append((i, 1, int(i % 3 == 0)))
    clean = [r for r in rows if r[0] % 3]
    for k in range(10):
        rows.append((1000 + k, clean[k][1].replace(" ", "  "), "en", "src1", 1))  # exact copies but for white space
    for k in range(10, 20):
        w = clean[k][1].split()
        w[70] = "changed"
        rows.append((1000 + k, " ".join(w), "en", "src1", 1))
    rows += [(2000, None, None, None, None), (2001, "", "en", "src0", 0)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if n < 4:
            assert docs.columns == columns
        docs.write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        ids.append({r.doc_id for r in docs.collect()})
    all_clean = {r[0] for r in clean}
    assert all_clean <= ids[0] and not any(i % 3 == 0 for i in ids[0] if i < 300)
    norm = lambda t: re.sub(r"\s", "", t or "")
    by = {r[0]: norm(r[1]) for r in rows}
    assert len({by[i] for i in ids[1]}) == len(ids[1])
    assert len(ids[1]) - len(ids[2]) == 10
    assert ids[3] <= ids[2] and len(ids[3]) >= 0.85 * len(ids[2]) - 1 and ids[4] == ids[3]


def test_run_is_its_stages(spark, sf):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} == set(got.columns) and got.count() > 0


def written(spark, folder, rows, schema, labels):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"{folder}"


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, bucket int, score double, toxic int, `__row` long, ids array<int>"


def test_stages_keep_clashing_columns_and_take_nulls(spark, tmp_path):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(i, words(i), None if i % 2 else "en", "src1" if i % 3 else None, None, "k", i, 1, 0.5, 1, 7, [1]) for i in range(20)]
    rows += [rows[3], (None, words(4), "en", "src1", 1, None, None, None, None, None, None, None), (50, None, None, None, None, None, None, None, None, None, None, None), (51, "", "en", "s", 0, "k", 1, 1, 1.0, 1, 1, []), (52, "long " * 200_000, "en", "s", 0, "k", 1, 1, 1.0, 1, 1, [])]
    folder = written(spark, f"file://{tmp_path}/a", rows, CLASHING, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        counts.append(docs.count())
    assert counts[:3] == [25, 22, 22] and 0 < counts[3] <= 22  # without labels nothing is toxic; two copies and one of two empty texts go
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.count() == counts[3]


def test_stages_on_an_empty_table(spark, tmp_path):
    folder = written(spark, f"file://{tmp_path}/b", [], CLASHING, [(1, 1, 1), (2, 1, 0)])
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_the_run_against_plain_python(spark, tmp_path):
    """Exact copies, near copies by Jaccard similarity of five-word shingles, and the tokens that the library gives; the mixture takes nine tenths."""
    import hashlib
    import itertools

    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(60)) for _ in range(40)]
    texts += [texts[k].replace(" ", "\n", 3) for k in range(5)] + [f"{texts[k]} {word()}" for k in range(5, 10)] + [f"{texts[k]} " + " ".join(word() for _ in range(30)) for k in range(10, 15)]
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    folder = written(spark, f"file://{tmp_path}/c", rows, "doc_id long, text string, lang string, source string, n_chars long", [])
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    sets = [shingles(t) for t in texts]
    linked = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert linked == {(k, 40 + k) for k in range(10)}
    got = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in got}
    assert not any({i, j} <= kept for i, j in linked) and len(kept) >= 0.9 * 45 - 4
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got:
        ids = encode.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
