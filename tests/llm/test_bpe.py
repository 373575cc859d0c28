import hashlib
import random

import pytest

from plumbline.llm.bpe import Encoder, decode, default_tokenizer, encode
from plumbline.llm.queries import QUERIES
from plumbline.llm.token_counts import at_limits, histogram, lengths, quantiles

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def encoder():
    with open(default_tokenizer(), encoding="utf-8") as f:
        return Encoder(f.read())


def test_same_as_the_library_on_random_texts(encoder, library):
    rng = random.Random(5)
    parts = [*"aaabbcde  \n\t'strEÉñß1290.,!?中🙂  ́", "<|endoftext|>", "the", "ing", "'ll", " don't", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        got = encoder.encode(text).tolist()
        assert got == want, text
        assert encoder.decode(got) == library.decode(want, skip_special_tokens=False)


def test_compatible_pairs_are_those_the_library_keeps(encoder, library):
    rng = random.Random(6)
    plain = [i for i, n in encoder.names.items() if n.isascii() and n.isalpha()]
    for _ in range(3000):
        a, b = rng.choice(plain), rng.choice(plain)
        ids = library.encode(encoder.names[a] + encoder.names[b], add_special_tokens=False).ids
        assert encoder.compatible(a, b) == (ids == [a, b])


def test_long_piece_in_linear_time(encoder, library):
    text = "ab" * 60_000
    assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_frames_with_nulls_and_clashing_columns(spark, library):
    rows = [(1, "Hello world", 0), (None, None, 1), (2, "", 2), (2, "Hello world", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    tokens = encode(docs, decoded=True)
    got = tokens.collect()
    assert [list(r.ids) for r in got] == [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    assert [r.decoded for r in got] == [t or "" for _, t, _ in rows]
    assert [r.text for r in decode(tokens).collect()] == [t or "" for _, t, _ in rows]
    assert encode(docs.limit(0)).count() == 0


def test_query_against_the_library(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op3_bpe"](spark, sf).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_histogram_answers_every_limit(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()]
    hist = histogram(lengths(docs)).cache()
    for r in hist.collect():
        assert r.n_docs == sizes.count(r.length) and r.docs_longer == sum(s > r.length for s in sizes) and r.tokens_longer == sum(s for s in sizes if s > r.length)
        assert r.docs_within + r.docs_longer == len(sizes) and r.tokens_truncated == sum(min(s, r.length) for s in sizes) and r.tokens_total == sum(sizes)
    for r in at_limits(hist, [0, 1, 128, 777, 10**6]).collect():
        assert (r.docs_over, r.tokens_truncated) == (sum(s > r.context_limit for s in sizes), sum(min(s, r.context_limit) for s in sizes))
    for r in quantiles(hist, [0.01, 0.5, 1.0]).collect():
        assert r.length == min(x for x in sizes if sum(s <= x for s in sizes) >= r.fraction * len(sizes))


def test_histogram_of_nothing_and_of_nulls(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert [(r.length, r.n_docs) for r in histogram(lengths(docs)).collect()] == [(0, 3)]
    assert histogram(lengths(docs.limit(0))).count() == 0
