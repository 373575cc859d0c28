"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the
word itself, hashed into a fixed number of buckets, so an unseen misspelling
shares most of its vectors with the word it hides. A document is the mean of
its words; buckets and softmax are trained together, the classes weighing alike.
Only buckets that texts of one label hold more often than those of the other are
trained, however rare they are in both. The model is the mean of a few fits that each
leave out another part of the sample; that part tells when to stop. As the model is linear, a task
needs no vectors: each word adds one number to a document's log odds.

The model is fitted on at most `most[k]` labelled rows of label k (the smallest
hashes of their ids) by one task, and only the weights come to the driver; every
document is scored, whole, in the tasks. The border between the labels is where
the parts left out are told apart best, false alarms weighing more than misses.

Cases: a null or blank text scores 0; texts of any length are scored whole, and
those fitted are held at once by the fitting task; rows without a label or with a
null one teach nothing; a document labelled twice counts as toxic if any label
says so; of different texts with one id, the one with the smallest hash teaches;
a null id is held out; without both labels every text that has words scores the
share of label 1 (0 if there is none); equal texts have equal scores, and a score
of exactly one half is toxic; repeated rows are scored each; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store

BUCKETS, DIM = 1 << 17, 4
#: A bucket is trained if |t| of the shares of texts that hold it, label against label, is at least the first (or among the LEAST_USED largest); the means are scaled so that embeddings stay near 1.
TELLING, SCALE = 3.5, 50.0
GRAMS = (3, 4, 5, 6, 8)
#: Fits whose mean is the model.
FITS = 3
#: Words whose weight a task remembers.
CACHED_WORDS = 500_000
LEAST_USED, FALSE_ALARM = 20, 4.0
EDGES = "\"'`.,;:!?()[]{}<>|*#%&$~_-–—…«»“”‘’/\\+=@^"


def subwords(word: str) -> list[int]:
    """Buckets of the word and its n-grams of characters, without the punctuation around it."""
    framed = f"<{word.strip(EDGES)}>"
    raw = framed.encode("utf-8", "surrogatepass")
    size, digest = len(framed), zlib.crc32
    at = range(size + 1) if len(raw) == size else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in framed)]
    found = [digest(raw) & BUCKETS - 1]
    for n in GRAMS:
        if n < size:
            found += [digest(raw[at[i] : at[i + n]]) & BUCKETS - 1 for i in range(size - n + 1)]
    return found


def bags(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of a batch: word indices of all texts in a row, the distinct words, and the number of words in each text."""
    trimmed = pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    lists = pc.utf8_split_whitespace(trimmed)
    sizes = np.where(np.asarray(pc.utf8_length(trimmed)) > 0, np.asarray(pc.list_value_length(lists)), 0)
    flat = pc.list_flatten(lists)
    flat = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    return np.asarray(flat.indices), flat.dictionary.to_pylist(), sizes


def gram_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' buckets in a row, and how many each word has."""
    flat, sizes = array("i"), np.empty(len(words), dtype=np.int32)
    for i, w in enumerate(words):
        found = subwords(w)
        flat.extend(found)
        sizes[i] = len(found)
    return np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32), sizes


@dataclass
class Weights:
    """bucket: what each bucket adds to the log odds of label 1; prior: the score of all texts where nothing could be learned."""

    bucket: np.ndarray
    bias: float
    prior: float | None = None


class Groups:
    """Sums the rows of each group; the order of the rows is found once."""

    def __init__(self, groups: np.ndarray, n: int) -> None:
        self.order = np.argsort(groups, kind="stable").astype(np.int32)
        self.there, self.starts = np.unique(groups[self.order], return_index=True)
        self.n = n

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, values.shape[1]), np.float32)
        if len(self.there):
            out[self.there] = np.add.reduceat(values[self.order], self.starts, axis=0)
        return out


@dataclass
class Sample:
    """The labelled texts as arrays: the share of a text that each of its words is, and the buckets of each word in a row."""

    y: np.ndarray
    there: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    share: np.ndarray
    gram: np.ndarray
    n_grams: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.n_grams, dtype=np.int64) - self.n_grams

    def presence(self, fold: np.ndarray) -> np.ndarray:
        """[fold, label, bucket]: how many texts hold the bucket. A few documents at a time, as a document has a cell for each of its words' n-grams."""
        out, starts, n = np.zeros((FITS, 2, BUCKETS)), self.starts, self.n_grams
        for lo in range(0, len(self.y), 50):
            d, w = (c[(self.doc >= lo) & (self.doc < lo + 50)] for c in (self.doc, self.word))
            cell = np.unique(np.repeat(d.astype(np.int64), n[w]) * BUCKETS + self.gram[np.repeat(starts[w] - np.cumsum(n[w]) + n[w], n[w]) + np.arange(int(n[w].sum()))])
            at = cell // BUCKETS
            np.add.at(out, (fold[at], self.y[at], cell % BUCKETS), 1)
        return out


def learn(sample: Sample, used: np.ndarray, tuning: np.ndarray, epochs: int, rate: float, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray]:
    """What each bucket adds to the log odds of label 1, the bias, and the log odds of all texts of the sample: full-batch Adam on the softmax and on the used buckets; of all epochs, the one that does best on the tuning texts."""
    y, n = sample.y, len(sample.y)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    keep = np.flatnonzero(place[sample.gram] >= 0)
    heard, of_word = np.unique(np.searchsorted(sample.starts, keep, side="right") - 1, return_inverse=True)
    gram = place[sample.gram[keep]]
    part = (SCALE / sample.n_grams[heard][of_word]).astype(np.float32)[:, None]
    nth = np.full(len(sample.n_grams), -1, np.int32)
    nth[heard] = np.arange(len(heard))
    inside = nth[sample.word] >= 0
    doc, word, share = sample.doc[inside], nth[sample.word[inside]], sample.share[inside][:, None]
    by_word, by_doc, to_word, to_gram = Groups(of_word, len(heard)), Groups(doc, n), Groups(word, len(heard)), Groups(gram, len(used))

    weight = [np.where(k & sample.there, np.where(y == 1, 1 / max(1, (k & (y == 1)).sum()), 1 / max(1, (k & (y == 0)).sum())), 0).astype(np.float32) for k in (~tuning, tuning if tuning.any() else ~tuning)]
    params = [rng.normal(0, 0.05, (len(used), DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    best: tuple[float, list[np.ndarray], np.ndarray] = (np.inf, params, np.zeros((n, 2), np.float32))
    for step in range(1, epochs + 1):
        e, w, b = params
        vec = by_doc(by_word(e[gram] * part)[word] * share)
        logits = vec @ w + b
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-(weight[1] * np.log(p[np.arange(n), y] + 1e-12)).sum())
        if loss < best[0]:
            best = (loss, [q.copy() for q in params], logits)
        d = p * weight[0][:, None]
        d[np.arange(n), y] -= weight[0]
        d_word = to_word((d @ w.T).astype(np.float32)[doc] * share)
        grads = [to_gram(d_word[of_word] * part), vec.T @ d, d.sum(axis=0)]
        for q, g, m in zip(params, grads, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            q -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)).astype(np.float32)
    e, w, b = best[1]
    bucket = np.zeros(BUCKETS, np.float32)
    bucket[used] = SCALE * (e @ (w[:, 1] - w[:, 0]))
    return bucket, float(b[1] - b[0]), (best[2][:, 1] - best[2][:, 0]).astype(float)


def border_between(logit: np.ndarray, toxic: np.ndarray) -> float:
    """Where misses and false alarms, as shares of their labels and false alarms FALSE_ALARM times, are fewest; of equal places the middle of the widest."""
    by = np.argsort(logit, kind="stable")
    logit, toxic = np.clip(logit[by], -50, 50), toxic[by]
    cost = np.r_[0, np.cumsum(toxic)] / max(1, toxic.sum()) + FALSE_ALARM * np.r_[np.cumsum(~toxic[::-1])[::-1], 0] / max(1, (~toxic).sum())
    step = np.r_[-50, logit, 50]
    least = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = least[np.argmax(step[least + 1] - step[least])]
    return float(step[k] + step[k + 1]) / 2


def fit(texts: list[str], labels: list[int], epochs: int = 80, rate: float = 0.05, seed: int = 7) -> Weights:
    """The mean of FITS fits, each of which leaves out another part of the sample to choose its buckets and its epoch by the rest; what they say of the texts that they left out sets the border."""
    y = np.asarray(labels, dtype=np.int64)
    at, words, sizes = bags(pa.array(texts, pa.string()))
    there = sizes > 0
    if len(set(y[there].tolist())) < 2:
        return Weights(np.zeros(BUCKETS, np.float32), 0.0, float(y.mean()) if len(y) else 0.0)
    cells, count = np.unique(np.repeat(np.arange(len(y)), sizes) * len(words) + at, return_counts=True)
    doc, word = (cells // len(words)).astype(np.int32), (cells % len(words)).astype(np.int32)
    sample = Sample(y, there, doc, word, (count / sizes[doc]).astype(np.float32), *gram_table(words))
    del cells, count, at, words
    rng = np.random.default_rng(seed)
    fold = np.empty(len(y), np.int64)
    for k in (0, 1):  # each label is dealt evenly
        mine = rng.permutation(np.flatnonzero(y == k))
        fold[mine] = np.arange(len(mine)) % FITS
    presence = sample.presence(fold)
    bucket, bias, said = np.zeros(BUCKETS, np.float32), 0.0, np.zeros(len(y))
    for left_out in range(FITS):
        tuning = fold == left_out
        if len(set(y[~tuning & there].tolist())) < 2:
            tuning = np.zeros(len(y), bool)
        docs = np.array([[((y == k) & ~tuning & there).sum()] for k in (0, 1)], dtype=float)
        among = (presence.sum(axis=0) - (presence[left_out] if tuning.any() else 0) + 0.5) / (docs + 1)
        t = np.abs(among[1] - among[0]) / np.sqrt((among * (1 - among) / (docs + 1)).sum(axis=0))
        used = np.union1d(np.flatnonzero(t >= TELLING), np.argsort(-t, kind="stable")[:LEAST_USED])
        b, c, logit = learn(sample, used, tuning, epochs, rate, rng)
        bucket, bias = bucket + b / FITS, bias + c / FITS
        said[fold == left_out] = logit[fold == left_out]
    return Weights(bucket, bias - border_between(said[there], y[there] == 1))


def scorer(model):
    weights_of: dict[str, float] = {}

    def score(texts: pa.Array, weights: Weights) -> np.ndarray:
        at, words, sizes = bags(texts)
        out = np.zeros(len(sizes))
        if not len(at):
            return out
        if weights.prior is not None:
            out[sizes > 0] = weights.prior
            return out
        new = [w for w in words if w not in weights_of]
        if len(weights_of) + len(new) > CACHED_WORDS:
            weights_of.clear()
            new = words
        if new:
            grams, sizes_of = gram_table(new)
            total = np.add.reduceat(weights.bucket[grams].astype(np.float64), np.cumsum(sizes_of) - sizes_of)
            weights_of.update(zip(new, (total / sizes_of).tolist(), strict=True))
        added = np.fromiter(map(weights_of.__getitem__, words), dtype=np.float64, count=len(words))[at]
        some = sizes > 0
        logit = np.add.reduceat(added, (np.cumsum(sizes) - sizes)[some]) / sizes[some] + weights.bias
        out[some] = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(part.column(1), model.value))], names=["doc_id", "score"])

    return run


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; of a null id 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0)) % folds


FITTED = "bucket binary, bias double, prior double"


def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one task that fits: its rows are the bounded sample, (doc_id, text, toxic)."""
    rows = sorted((r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)), key=lambda r: r[0])
    w = fit([r[1] or "" for r in rows], [r[2] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([w.bucket.tobytes()]), pa.array([w.bias], pa.float64()), pa.array([w.prior], pa.float64())], names=["bucket", "bias", "prior"])


def train(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (3000, 1500), folds: int = 5, held_out_fold: int = 0) -> Weights:
    """Weights learned from at most most[k] rows of label k outside the held-out fold."""
    known = docs.select("doc_id").join(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id").where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), folds) != held_out_fold)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = store(known.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), "labelled")
    chosen = None
    for k in (0, 1):
        part = known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[k])
        chosen = part if chosen is None else chosen.union(part)
    ids = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # sum(most) ids at most
    sample = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.first("toxic").alias("toxic"))
    row = sample.repartition(1).mapInArrow(fitting, FITTED).first()
    drop_stored(known)
    if row is None:  # nothing is labelled
        return fit([], [])
    return Weights(np.frombuffer(row.bucket, np.float32), row.bias, row.prior)


def toxicity(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (3000, 1500), folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most, folds, held_out_fold))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scorer(model), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns. Scores go by text, so rows are scored where they stand."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    run = scorer(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["doc_id", "text"])
            scores = np.concatenate([np.empty(0), *(np.asarray(part.column(1)) for part in run(iter([texts])))])
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(keep, docs.schema)
