import collections

import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm.queries import QUERIES
from plumbline.llm.token_counts import at_limits, histogram, lengths, quantiles

DOCS = "doc_id long, text string, length int, n_docs int, block int"


def brute(counts):
    """length -> (documents, longer ones, their tokens, tokens with each document cut there)."""
    return {n: (k, sum(c > n for c in counts), sum(c for c in counts if c > n), sum(min(c, n) for c in counts)) for n, k in collections.Counter(counts).items()}


def rows_of(hist):
    return {r.length: (r.n_docs, r.docs_longer, r.tokens_longer, r.tokens_truncated) for r in hist.collect()}


def test_query_against_the_library(spark, sf):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = [len(encode.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    hist = QUERIES["op7_token_counts"](spark, sf)
    assert rows_of(hist) == brute(counts)
    assert {(r.docs_within + r.docs_longer, r.tokens_total) for r in hist.collect()} == {(len(counts), sum(counts))}


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    rows = [(1, None, 5, 1, 1), (None, "", 5, 1, 1), (3, "a b", 5, 1, 1), (3, "a b", 5, 1, 1), (4, "word " * 50_000, 5, 1, 1)]
    counted = lengths(spark.createDataFrame(rows, DOCS))
    counts = [r.n_tokens for r in counted.collect()]
    hist = histogram(counted)
    assert rows_of(hist) == brute(counts) and max(counts) >= 50_000
    limits = [0, 1, 2, 3, 10_000, 10**6]
    assert {r.context_limit: (r.docs_over, r.tokens_truncated) for r in at_limits(hist, limits).collect()} == {n: (sum(c > n for c in counts), sum(min(c, n) for c in counts)) for n in limits}
    assert {r.fraction: r.length for r in quantiles(hist, [0.4, 0.8, 1.0]).collect()} == {0.4: 0, 0.8: 2, 1.0: max(counts)}


def test_empty_table(spark):
    hist = histogram(lengths(spark.createDataFrame([], DOCS)))
    assert hist.count() == 0
    assert [(r.docs_over, r.tokens_truncated) for r in at_limits(hist, [7]).collect()] in ([], [(0, 0)])
