"""Language-model scores by Katz backoff over word n-grams.

Counts of every order are Good-Turing discounted; what the discounts leave in a
history is spread over the words never seen after it, in proportion to their
probability of the next lower order, by a backoff weight that makes every history
sum to exactly one:

    P(w|h) = d(c(hw)) c(hw) / (c(h) + KEPT)         if c(hw) > 0
           = alpha(h) P(w|h')                       otherwise, h' being h without its first word
    P(w)   = d(c(w)) c(w) / (N + KEPT)              if c(w) > 0, the rest for a word never seen
    alpha(h) = (1 - sum of P(w|h) seen) / (1 - sum of P(w|h') of the words seen after h), 1 for a history never seen

KEPT, a tenth of a count, leaves mass where all of a history's followers are
frequent. A text begins after as many ends as its histories need.

How it runs: documents become chunks of word numbers, written into the shared
folder as blobs with a small table of their places. Order by order, a chunk sends
its distinct n-grams, grouped by history, to the owners of ranges of history
hashes, as sorted and packed 64-bit hashes of histories and the numbers of the
words that follow, which the owners of words have given. An n-gram that no other
chunk has asked for, held-out texts included, or that training has not, is told to be
the chunk's own. As a history in the next order it needs no owner: what follows it is
known without asking, and only the counts of counts of its n-grams are sent (for a
model that is to be kept, all are asked). An owner adds up the training counts of its
histories and makes of them a page of the model: histories, followers, counts, and for each
history the counts of counts and the lower-order mass that its weight is made of;
pages are stored only for a model that is to be kept.
It answers each chunk in the order it asked. When all orders are told, a chunk
scores its tokens by recursion over the orders. Only a few counts of counts reach
the driver. The pages of all orders are a `Model`, which can score other texts.

Cases: a null text is empty and scores its end; a null id counts as the empty id
for the fold; texts of any length are read whole, and one with more tokens than a
chunk is a chunk of its own; repeated rows count and are scored each; without
training rows every token is unknown with probability one; an empty table gives
an empty result; other columns, whatever their names, are ignored. Different
histories with one 64-bit hash would share their counts: expected below one pair
for a billion histories.
"""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, place_of, qualified, remove, shared_dir, store

K, KEPT = 5, 0.1
ORDER = 3
CHUNK_TOKENS, CHUNK_ROWS, OWNER_ITEMS, MOST_TASKS = 1_200_000, 2048, 2_000_000, 4096
END = b"\n"  # no word holds white space
FOLLOWER_BITS = 40
CHUNKS = "chunk long, file string, start long, size long, n_words long, n_tokens long"
CHUNKS_ARROW = pa.schema([("chunk", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])
BLOB_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("n_words", pa.int32()), ("tokens", pa.binary()), ("n_tokens", pa.int64())])
#: A chunk's histories in one owner's range: their hashes, how many followers each has, and of these the numbers, training counts and lower-order counts; above: the lower-order count of each history. One row of a chunk has the totals of its own histories.
ASKED = "n int, part int, chunk long, n_hist long, n_grams long, hist binary, sizes binary, words binary, counts binary, lower binary, above binary, totals array<long>"
ASKED_ARROW = pa.schema([("n", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("n_hist", pa.int64()), ("n_grams", pa.int64()), *((c, pa.binary()) for c in ("hist", "sizes", "words", "counts", "lower", "above")), ("totals", pa.list_(pa.int64()))])
#: A page of the model (chunk null), or an answer to a chunk: counts of its n-grams (0: its own count is all there is) and histories as asked, of words their numbers, and what the weights are made of where the chunk may need one.
TOLD = "n int, part int, chunk long, n_hist long, n_grams long, hist binary, sizes binary, words binary, counts binary, above binary, kinds binary, low binary, totals array<long>"
TOLD_ARROW = pa.schema([("n", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("n_hist", pa.int64()), ("n_grams", pa.int64()), *((c, pa.binary()) for c in ("hist", "sizes", "words", "counts", "above", "kinds", "low")), ("totals", pa.list_(pa.int64()))])
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes, low bytes first; as many planes as the largest needs."""
    values = np.ascontiguousarray(values, dtype="<u8")
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = data[0]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :planes] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(planes, n).T
    return out.view("<u8").reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n), dtype=np.uint64)


def ints(data: bytes, n: int) -> np.ndarray:
    return unpack(data, n).astype(np.int64)


def floats(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="<f8")


def pack_floats(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, dtype="<f8").tobytes())


# Chunks ----------------------------------------------------------------------


def write_chunks(folder: str):
    """Function over (doc_id, held, text) rows that writes their chunks, word numbers by frequency and each document closed by the end, and gives the chunks' places. Files have names of their own for each attempt."""

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (b.slice(at, CHUNK_ROWS) for b in batches for at in range(0, b.num_rows, CHUNK_ROWS)):
            # Trimmed first: a slice that was cast keeps offsets that do not begin at 0, of which Arrow's ascii_lower makes other texts.
            text = pc.ascii_lower(pc.ascii_trim_whitespace(pc.fill_null(batch.column(2), "").cast(pa.large_string())))
            lists = pc.ascii_split_whitespace(text)
            sizes = np.where(np.asarray(pc.binary_length(text)) > 0, np.asarray(pc.list_value_length(lists)), 0).astype(np.int64)
            total = np.cumsum(sizes + 1)
            cuts = [0]
            while cuts[-1] < len(sizes):
                done = total[cuts[-1] - 1] if cuts[-1] else 0
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, done + CHUNK_TOKENS, side="right"))))
            for lo, hi in zip(cuts, cuts[1:]):
                flat = pc.list_flatten(lists.slice(lo, hi - lo))
                flat = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
                index, words = np.asarray(flat.indices), [w.as_py() for w in flat.dictionary.cast(pa.large_binary())]
                order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), dtype=np.int64)
                rank[order] = np.arange(len(words))
                tokens = np.zeros(len(index) + hi - lo, dtype=np.int64)  # 0 is the end
                inside = np.ones(len(tokens), dtype=bool)
                inside[np.cumsum(sizes[lo:hi] + 1) - 1] = False
                tokens[inside] = rank[index] + 1
                listed = b"\n".join(words[i] for i in order)
                yield {"doc_ids": batch.column(0).slice(lo, hi - lo).to_pylist(), "held": batch.column(1).slice(lo, hi - lo).to_pylist(), "sizes": (sizes[lo:hi] + 1).tolist(), "words": zstandard.ZstdCompressor(level=3).compress(listed), "n_words": len(words), "tokens": pack(tokens), "n_tokens": len(tokens)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, file, out, start, made = TaskContext.get().partitionId(), "", None, 0, 0
        for row in blobs(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, BLOB_ARROW) as writer:
                writer.write_batch(pa.RecordBatch.from_pylist([row], schema=BLOB_ARROW))
            blob = sink.getvalue()
            if out is None:
                system, base = place_of(folder)
                system.create_dir(base, recursive=True)
                file = f"chunks-{task:06d}-{uuid.uuid4().hex[:12]}.bin"
                out = system.open_output_stream(f"{base}/{file}", compression=None)
            out.write(blob)
            yield pa.RecordBatch.from_pylist([{"chunk": task << 20 | made, "file": file, "start": start, "size": blob.size, "n_words": row["n_words"], "n_tokens": row["n_tokens"]}], schema=CHUNKS_ARROW)
            start, made = start + blob.size, made + 1
        if out is not None:
            out.close()

    return run


@dataclass
class Grams:
    """The distinct n-grams of a chunk: history (an n-gram of the order below; for words none), last word, what they are without their first word, hash, training count; and the n-gram that ends at each token."""

    history: np.ndarray | None
    word: np.ndarray
    lower: np.ndarray | None
    hashes: np.ndarray
    counts: np.ndarray
    place: np.ndarray
    pad: int  # what stands before a document's first token
    # Set by groups(): entries by history in the order of the histories' hashes.
    order: np.ndarray | None = None
    starts: np.ndarray | None = None
    sizes: np.ndarray | None = None
    asked: np.ndarray | None = None

    def groups(self, hashes: np.ndarray) -> None:
        """hashes: of the order below."""
        starts = np.flatnonzero(np.append(True, self.history[1:] != self.history[:-1]))
        sizes = np.diff(np.append(starts, len(self.history)))
        hashes = hashes[self.history[starts]]
        by_hash = np.argsort(hashes)
        self.asked, self.sizes = hashes[by_hash], sizes[by_hash]
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.order = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[by_hash] - self.starts, self.sizes)


class Chunk:
    """A chunk's distinct n-grams of the orders up to one."""

    def __init__(self, folder: str, ref: dict, upto: int) -> None:
        system, base = place_of(folder)
        with system.open_input_file(f"{base}/{ref['file']}") as f:
            [row] = pa.ipc.open_stream(f.read_at(ref["size"], ref["start"])).read_all().to_pylist()
        self.number, self.doc_ids = ref["chunk"], row["doc_ids"]
        self.doc_sizes = np.array(row["sizes"], dtype=np.int64)
        self.held = np.array(row["held"], dtype=bool)
        listed = zstandard.ZstdDecompressor().decompress(row["words"]) if row["n_words"] else b""
        words = [END, *(listed.split(b"\n") if row["n_words"] else [])]
        self.tokens = ints(row["tokens"], row["n_tokens"])
        self.away = np.repeat(self.held, self.doc_sizes)
        self.first = np.zeros(len(self.tokens), dtype=bool)
        self.first[np.cumsum(self.doc_sizes) - self.doc_sizes] = True
        hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64)
        self.grams = {1: Grams(None, np.arange(len(words)), None, hashes, np.bincount(self.tokens[~self.away], minlength=len(words)), self.tokens, 0)}
        for n in range(2, upto + 1):
            self.grams[n] = self.longer(self.grams[n - 1], len(words))

    def longer(self, below: Grams, n_words: int) -> Grams:
        history = np.append(0, below.place[:-1])
        history[self.first] = below.pad
        code = np.append(history * n_words + self.tokens, below.pad * n_words)
        order = np.argsort(code)  # any of a code's entries may stand for it, so np.unique's slower stable order is not needed
        code = code[order]
        fresh = np.append(True, code[1:] != code[:-1])
        codes, index = code[fresh], order[fresh]
        place = np.empty(len(code), dtype=np.int32)
        place[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        pad, place = int(place[-1]), place[:-1]
        history, word = codes // n_words, codes % n_words
        lower = np.append(below.place, below.pad)[index]
        mixed = below.hashes[history]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self.grams[1].hashes[word]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        out = Grams(history, word, lower, mixed ^ (mixed >> np.uint64(29)), np.bincount(place[~self.away], minlength=len(codes)), place, pad)
        out.groups(below.hashes)
        return out


def cut(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted hashes in each owner's range; parts is a power of two."""
    bits = parts.bit_length() - 1
    edges = np.searchsorted(hashes, np.arange(parts, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, dtype=np.int64)
    for part, (lo, hi) in enumerate(zip(edges.tolist(), [*edges[1:].tolist(), len(hashes)])):
        if hi > lo:
            yield part, lo, hi


class Told:
    """What a chunk knows when the owners have answered: for each order the count of every n-gram and of its history, and the weights' parts where it may need them."""

    def __init__(self, chunk: Chunk, answers: list[dict], whole: bool = False) -> None:
        """whole: its own histories were asked too. Answers may come without the weights' parts."""
        self.chunk = chunk
        self.whole = whole
        self.counts: dict[int, np.ndarray] = {}
        self.own: dict[int, np.ndarray] = {}  # n-grams of which no other chunk knows more
        self.above: dict[int, np.ndarray] = {}
        self.weights: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({a["n"] for a in answers}):
            rows = sorted((a for a in answers if a["n"] == n), key=lambda a: a["part"])
            g = chunk.grams[n]
            counts = np.concatenate([ints(a["counts"], a["n_grams"]) for a in rows])
            if n == 1:
                by_hash = np.argsort(g.hashes, kind="stable")
                self.take(1, by_hash, counts)
                self.words = np.empty(len(counts), dtype=np.uint64)
                self.words[by_hash] = np.concatenate([unpack(a["words"], a["n_grams"]) for a in rows])
                continue
            asked = self.asked(n)
            self.take(n, g.order[np.repeat(asked, g.sizes)], counts)
            above = chunk.grams[n - 1].counts[g.history[g.order[g.starts]]]
            above[asked] = np.concatenate([ints(a["above"], a["n_hist"]) for a in rows])
            self.above[n] = np.empty(len(g.counts), dtype=np.int64)
            self.above[n][g.order] = np.repeat(above, g.sizes)
            if rows[0]["low"] is not None:
                open_ = may_back_off(g.counts[g.order], g.starts)
                kinds = np.concatenate([ints(a["kinds"], len(floats(a["low"])) * K) for a in rows]).reshape(-1, K)
                self.weights[n] = (asked, open_, kinds, np.concatenate([floats(a["low"]) for a in rows]))

    def take(self, n: int, grams: np.ndarray, counts: np.ndarray) -> None:
        """counts: as told of these n-grams."""
        mine = self.chunk.grams[n].counts
        self.counts[n], self.own[n] = mine.copy(), np.ones(len(mine), dtype=bool)
        self.counts[n][grams] = np.where(counts > 0, counts, mine[grams])
        self.own[n][grams] = counts == 0

    def asked(self, n: int) -> np.ndarray:
        """Which histories, in the order of their hashes, are asked about. The padding always is: what it counts as an n-gram is not what its followers count."""
        g = self.chunk.grams[n]
        history = g.history[g.order[g.starts]]
        return ~self.own[n - 1][history] | (history == self.chunk.grams[n - 1].pad) | self.whole

    def weight(self, n: int, model: Discounts) -> np.ndarray:
        """log10 of the backoff weight of each history, in the order asked, where it may be needed; else 0."""
        g = self.chunk.grams[n]
        asked, open_, told_kinds, told_low = self.weights[n]
        mine = np.repeat(open_ & ~asked, g.sizes) & (g.counts[g.order] > 0)
        grams = g.order[mine]
        of, counts = np.repeat(np.cumsum(open_) - 1, g.sizes)[mine], g.counts[grams]
        many, rare, lower = int(open_.sum()), counts <= K, g.lower[grams]
        kinds = np.bincount(of[rare] * K + counts[rare] - 1, minlength=many * K).reshape(many, K)
        low = np.bincount(of, model.seen(self.counts[n - 1][lower], self.above[n - 1][lower] if n > 2 else counts, n - 1), many).astype(float)  # of nothing, numpy gives whole numbers
        kinds[asked[open_]], low[asked[open_]] = told_kinds, told_low
        out = np.zeros(len(g.starts))
        out[open_] = model.weight(n, self.above[n][g.order][g.starts][open_], kinds, low)
        return out


def may_back_off(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which histories have a follower that the chunk has not seen in training: the ones whose weight it may need."""
    return np.minimum.reduceat(counts, starts) == 0 if len(starts) else np.zeros(0, dtype=bool)


def tally(counts: np.ndarray) -> list[int]:
    """How many n-grams occur 1 to K + 1 times, all occurrences, and distinct n-grams."""
    return [*np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2].tolist(), int(counts.sum()), len(counts)]


def ask(folder: str, n: int, parts: int, whole: bool = False):
    """Function of a chunk (with the answers of the orders below) that asks for its n-grams; whole: also for those of its own histories."""

    def rows(ref: dict, answers: list[dict]) -> list[dict]:
        c = Chunk(folder, ref, n)
        g, out = c.grams[n], []
        if n == 1:
            order = np.argsort(g.hashes, kind="stable")
            keys, counts = g.hashes[order], g.counts[order]
            for part, lo, hi in cut(keys, parts):
                out.append({"n": 1, "part": part, "chunk": c.number, "n_hist": 0, "n_grams": hi - lo, "hist": pack_sorted(keys[lo:hi]), "counts": pack(counts[lo:hi])})
            return out
        told = Told(c, answers, whole)
        asked = told.asked(n)
        entries = np.repeat(asked, g.sizes)
        own = g.counts[g.order[~entries]]
        totals: list[int] | None = tally(own[own > 0])
        order, hashes, sizes = g.order[entries], g.asked[asked], g.sizes[asked]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        words, counts, lower = told.words[g.word[order]], g.counts[order], told.counts[n - 1][g.lower[order]]
        above = told.above[n - 1][g.lower[order[starts]]] if n > 2 else np.zeros(len(starts), dtype=np.int64)
        for part, lo, hi in cut(hashes, parts):  # never none: the padding is asked
            a, b = int(starts[lo]), int(ends[hi - 1])
            out.append({"n": n, "part": part, "chunk": c.number, "n_hist": hi - lo, "n_grams": b - a, "hist": pack_sorted(hashes[lo:hi]), "sizes": pack(sizes[lo:hi]), "words": pack(words[a:b]), "counts": pack(counts[a:b]), "lower": pack(np.where(counts[a:b] > 0, lower[a:b], 0)), "above": pack(above[lo:hi]), "totals": totals})
            totals = None
        return out

    def run(key: tuple, refs: pa.Table, answers: pa.Table) -> pa.Table:
        told = answers.to_pylist()
        return pa.Table.from_pylist([r for ref in refs.to_pylist() for r in rows(ref, told)], schema=ASKED_ARROW)

    def run_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ref in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(rows(ref, []), schema=ASKED_ARROW)

    return run_first if n == 1 else run


# Owners ----------------------------------------------------------------------


def discounts(of_counts: list[int]) -> np.ndarray:
    """Katz's discount of counts 1 to K from the numbers of entries that occur 1 to K + 1 times; where these give none between 0 and 1, half a count is taken off."""
    n = [0, *of_counts]
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    out = np.ones(K + 1)
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


class Discounts:
    """What all tasks know of a model: the discounts of each order, all tokens, distinct words, and the chance of a word never seen."""

    def __init__(self, totals: dict[int, list[int]]) -> None:
        """totals: of each order the numbers of n-grams that occur 1 to K + 1 times, all occurrences, and distinct n-grams."""
        self.tokens, self.types = totals[1][K + 1], totals[1][K + 2]
        self.of = {n: discounts(t[: K + 1]) for n, t in totals.items()}
        taken = sum((1 - self.of[1][r]) * r * totals[1][r - 1] for r in range(1, K + 1))
        self.unknown = (KEPT + taken) / (self.tokens + KEPT)

    def discounted(self, counts: np.ndarray, n: int) -> np.ndarray:
        return np.where(counts <= K, self.of[n][np.minimum(counts, K)], 1.0) * counts

    def word(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounted(counts, 1) / (self.tokens + KEPT), self.unknown)

    def seen(self, counts: np.ndarray, history: np.ndarray, n: int) -> np.ndarray:
        return self.word(counts) if n == 1 else self.discounted(counts, n) / (history + KEPT)

    def weight(self, n: int, history: np.ndarray, kinds: np.ndarray, low: np.ndarray) -> np.ndarray:
        """log10 of the backoff weight of histories: what their discounts leave, over what their followers leave in the order below; 0 for one never seen."""
        taken = kinds @ ((1 - self.of[n][1:]) * np.arange(1, K + 1))
        return np.where(history > 0, np.log10((KEPT + taken) / (history + KEPT)) - np.log10(np.maximum(1 - low, 1e-300)), 0.0)


@dataclass
class Page:
    """An owner's histories and their followers with counts, keys sorted: the place of the history, then the follower's number."""

    hist: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    above: np.ndarray
    kinds: np.ndarray
    low: np.ndarray
    shared: np.ndarray  # n-grams that more than one chunk has asked for

    def find(self, hist: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of histories, which are there, places of their followers, which are there."""
        at = np.minimum(np.searchsorted(self.hist, hist), max(0, len(self.hist) - 1))
        known = self.hist[at] == hist if len(self.hist) else np.zeros(len(hist), dtype=bool)
        key = np.repeat(at.astype(np.uint64), sizes) << np.uint64(FOLLOWER_BITS) | words
        place = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return at, known, place, (self.keys[place] == key) & np.repeat(known, sizes) if len(self.keys) else np.zeros(len(key), dtype=bool)

    def answer(self, hist: np.ndarray, sizes: np.ndarray, words: np.ndarray, asked: np.ndarray) -> dict:
        """What a chunk is told that asked for followers of histories; asked: its own training counts."""
        at, known, place, there = self.find(hist, sizes, words)
        open_ = may_back_off(asked, np.cumsum(sizes) - sizes)
        of = lambda values: np.where(known.reshape(-1, *[1] * (values.ndim - 1)), values[at], 0) if len(values) else np.zeros((len(hist), *values.shape[1:]), values.dtype)
        return {"n_hist": len(hist), "n_grams": len(words), "counts": pack(np.where(there & self.shared[place], self.counts[place], 0) if len(self.counts) else np.zeros(len(words))), "above": pack(of(self.above)), "kinds": pack(of(self.kinds)[open_].reshape(-1)), "low": pack_floats(of(self.low)[open_])}

    def row(self) -> dict:
        """The page as it is stored."""
        sizes = np.bincount((self.keys >> np.uint64(FOLLOWER_BITS)).astype(np.int64), minlength=len(self.hist))
        return {"chunk": None, "n_hist": len(self.hist), "n_grams": len(self.keys), "hist": pack_sorted(self.hist), "sizes": pack(sizes), "words": pack(self.keys & np.uint64((1 << FOLLOWER_BITS) - 1)), "counts": pack(self.counts), "above": pack(self.above), "kinds": pack(self.kinds.reshape(-1)), "low": pack_floats(self.low)}

    @staticmethod
    def read(row: dict) -> Page:
        h, g = row["n_hist"], row["n_grams"]
        keys = np.repeat(np.arange(h, dtype=np.uint64), ints(row["sizes"], h)) << np.uint64(FOLLOWER_BITS) | unpack(row["words"], g)
        return Page(unpack_sorted(row["hist"], h), keys, ints(row["counts"], g), ints(row["above"], h), ints(row["kinds"], h * K).reshape(-1, K), floats(row["low"]), np.ones(g, dtype=bool))


def page_of(rows: list[dict], n: int, model: Discounts) -> tuple[Page, list[int]]:
    """The page of an owner's asked rows, of what occurs in training, and its counts of counts with those that came with the rows."""
    hist, words, counts, lower, above, away = [], [], [], [], [], []
    for r in rows:
        c = ints(r["counts"], r["n_grams"])
        mine, sizes = c > 0, ints(r["sizes"], r["n_hist"])
        h, w = np.repeat(unpack_sorted(r["hist"], r["n_hist"]), sizes), unpack(r["words"], r["n_grams"])
        away.append((h[~mine], w[~mine]))
        hist.append(h[mine])
        words.append(w[mine])
        counts.append(c[mine])
        lower.append(ints(r["lower"], r["n_grams"])[mine])
        above.append(np.repeat(ints(r["above"], r["n_hist"]), sizes)[mine])
    hist, words, counts, lower, above = (np.concatenate(x) for x in (hist, words, counts, lower, above))
    names, at = np.unique(hist, return_inverse=True)
    if len(names) >= 1 << 64 - FOLLOWER_BITS:
        raise ValueError("too many histories for one owner")
    key = at.astype(np.uint64) << np.uint64(FOLLOWER_BITS) | words
    order = np.argsort(key)  # chunks agree on lower and above
    ordered = key[order]
    fresh = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    total = np.add.reduceat(counts[order], fresh) if len(key) else counts
    one = order[fresh]
    of = at[one]
    kinds = np.zeros((len(names), K), dtype=np.int64)
    rare = total <= K
    np.add.at(kinds, (of[rare], total[rare] - 1), 1)
    mass = model.seen(lower[one], above[one], n - 1)
    page = Page(names, ordered[fresh], total, np.bincount(of, total, len(names)).astype(np.int64), kinds, np.bincount(of, mass, len(names)), np.diff(np.append(fresh, len(key))) > 1)
    for h, w in away:  # held-out texts ask too
        *_, place, there = page.find(h, np.ones(len(h), dtype=np.int64), w)
        page.shared[place[there]] = True
    return page, np.sum([tally(total), *(r["totals"] for r in rows if r["totals"])], axis=0).tolist()


def word_page(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The distinct words of an owner, their training counts, which more than one chunk has asked for, and the counts of counts."""
    keys, counts = np.concatenate([unpack_sorted(r["hist"], r["n_grams"]) for r in rows]), np.concatenate([ints(r["counts"], r["n_grams"]) for r in rows])
    names, at = np.unique(keys, return_inverse=True)
    total, chunks = np.bincount(at, counts, len(names)).astype(np.int64), np.bincount(at, minlength=len(names))
    known = total > 0
    return names[known], total[known], chunks[known] > 1, tally(total[known])


def word_numbers(total: np.ndarray, part: int, parts: int) -> np.ndarray:
    """The numbers of an owner's words, frequent ones first, that no other owner gives; from 1, as 0 is any word that training has not."""
    out = np.empty(len(total), dtype=np.uint64)
    out[np.argsort(-total, kind="stable")] = np.arange(len(total), dtype=np.uint64) * np.uint64(parts) + np.uint64(part + 1)
    return out


def looked_up(names: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(names, keys), max(0, len(names) - 1))
    return np.where(names[at] == keys, values[at], 0) if len(names) else np.zeros(len(keys), dtype=values.dtype)


def owner(n: int, parts: int, model: Discounts | None, keep: bool = True):
    """Function of an owner of a range of histories: makes its page (of which it gives the totals alone if it need not keep it) and answers every chunk; or, given a stored page, only answers."""

    def told(part: int, rows: list[dict], stored: list[dict]) -> Iterator[dict]:
        shared = {"n": n, "part": part}
        if n == 1:
            if stored:
                names, total = unpack_sorted(stored[0]["hist"], stored[0]["n_grams"]), ints(stored[0]["counts"], stored[0]["n_grams"])
                common = np.ones(len(names), dtype=bool)
            else:
                names, total, common, totals = word_page(rows)
                yield shared | {"chunk": None, "totals": totals} | ({"n_hist": 0, "n_grams": len(names), "hist": pack_sorted(names), "counts": pack(total)} if keep else {})
            numbers = word_numbers(total, part, parts)
            for r in rows:
                keys = unpack_sorted(r["hist"], r["n_grams"])
                yield shared | {"chunk": r["chunk"], "n_hist": 0, "n_grams": r["n_grams"], "counts": pack(looked_up(names, np.where(common, total, 0), keys)), "words": pack(looked_up(names, numbers, keys))}
            return
        if stored:
            page = Page.read(stored[0])
        else:
            page, totals = page_of(rows, n, model)
            yield shared | (page.row() if keep else {"chunk": None}) | {"totals": totals}
        for r in rows:
            yield shared | {"chunk": r["chunk"]} | page.answer(unpack_sorted(r["hist"], r["n_hist"]), ints(r["sizes"], r["n_hist"]), unpack(r["words"], r["n_grams"]), ints(r["counts"], r["n_grams"]))

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(told(key[0].as_py(), asked.sort_by("chunk").to_pylist(), [])), schema=TOLD_ARROW)

    def run_stored(key: tuple, asked: pa.Table, pages: pa.Table) -> pa.Table:
        rows = asked.sort_by("chunk").to_pylist()
        empty = {"n_hist": 0, "n_grams": 0, **{c: pack(np.zeros(0)) for c in ("hist", "sizes", "words", "counts", "above", "kinds")}, "low": pack_floats(np.zeros(0))}
        return pa.Table.from_pylist(list(told(rows[0]["part"], rows, pages.to_pylist() or [empty])) if rows else [], schema=TOLD_ARROW)

    return run, run_stored


# Scores ----------------------------------------------------------------------


def score(folder: str, model: Discounts, upto: int):
    """Function of a chunk and all its answers: the scores of its documents."""

    def of_chunk(ref: dict, answers: list[dict]) -> list[pa.Array]:
        c = Chunk(folder, ref, upto)
        told = Told(c, answers)
        count = told.counts[1]
        chance = np.log10(model.word(count))
        for n in range(2, upto + 1):
            g, joint, above = c.grams[n], told.counts[n], told.above[n]
            spread = np.empty(len(joint))
            spread[g.order] = np.repeat(told.weight(n, model), g.sizes)
            chance = np.where(joint > 0, np.log10(np.maximum(model.seen(joint, above, n), 1e-300)), spread + chance[g.lower])
        doc = np.repeat(np.arange(len(c.doc_sizes)), c.doc_sizes)
        per = lambda v: np.bincount(doc, v, len(c.doc_sizes))
        base = np.log10((count + 1) / (model.tokens + model.types + 1))
        return [pa.array(c.doc_ids, pa.int64()), pa.array(c.held), pa.array(c.doc_sizes), pa.array(per(count[c.tokens] > 0).astype(np.int64)), pa.array(per(base[c.tokens])), pa.array(per(chance[c.grams[upto].place]))]

    names = [c.split()[0] for c in SCORED.split(", ")]

    def run(key: tuple, refs: pa.Table, answers: pa.Table) -> pa.Table:
        told = answers.to_pylist()
        tables = [pa.Table.from_arrays(of_chunk(ref, told), names=names) for ref in refs.to_pylist()]
        return pa.concat_tables(tables) if tables else pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)

    return run


def parts_for(items: int) -> int:
    """A power of two of owners, so that each has a bounded number of entries."""
    return 1 << max(0, math.ceil(math.log2(max(1, items / OWNER_ITEMS))))


@dataclass
class Model:
    """A trained model: the stored pages of each order, in how many parts they are, and what all tasks know."""

    pages: dict[int, DataFrame]
    parts: dict[int, int]
    known: Discounts

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_tokens, n_known, base_score, score of the texts of any table."""
        chunks, folder = chunks_of(docs, F.lit(True), id_col, text_col)
        answers: dict[int, DataFrame] = {}
        for n in self.pages:
            asked = questions(chunks, folder, n, self.parts[n], answers)
            told = asked.groupBy("part").cogroup(dealt(self.pages[n], "part", self.parts[n]).groupBy("part")).applyInArrow(owner(n, self.parts[n], self.known)[1], TOLD)
            answers[n] = store(told.withColumn("page", F.lit(False)), f"told-{n}")
        return scored(chunks, folder, self.known, answers).select("doc_id", "n_tokens", "n_known", "base_score", "score")


def chunks_of(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The stored places of the chunks of docs, and the folder of their blobs."""
    spark = docs.sparkSession
    folder = qualified(spark, f"{shared_dir(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    return store(rows.mapInArrow(write_chunks(folder), CHUNKS), "chunk-places"), folder


def told_to_chunks(answers: dict[int, DataFrame], weights: bool) -> DataFrame:
    """The answers of all orders, without the pages; what weights are made of only for scores, as questions need none."""
    out = None
    for a in answers.values():
        rows = a.where("not page").select("n", "part", "chunk", "n_hist", "n_grams", "words", "counts", "above", *(F.col(c) if weights else F.lit(None).cast("binary").alias(c) for c in ("kinds", "low")))
        out = rows if out is None else out.unionByName(rows)
    return out


def dealt(rows: DataFrame, column: str, values: int) -> DataFrame:
    """Rows dealt by a column that has so many values, to as many tasks, so that these grow with the data."""
    return rows.repartition(max(1, min(MOST_TASKS, values)), column)


def questions(chunks: DataFrame, folder: str, n: int, parts: int, answers: dict[int, DataFrame], whole: bool = False) -> DataFrame:
    """What the chunks ask for in an order, given the answers of those below; whole: also of their own histories."""
    many = chunks.count()
    by_chunk = dealt(chunks, "chunk", many)
    if n == 1:
        asked = by_chunk.mapInArrow(ask(folder, 1, parts), ASKED)
    else:
        asked = by_chunk.groupBy("chunk").cogroup(dealt(told_to_chunks(answers, False), "chunk", many).groupBy("chunk")).applyInArrow(ask(folder, n, parts, whole), ASKED)
    return dealt(asked, "part", parts)


def scored(chunks: DataFrame, folder: str, model: Discounts, answers: dict[int, DataFrame]) -> DataFrame:
    many = chunks.count()
    told = dealt(told_to_chunks(answers, True), "chunk", many)
    return dealt(chunks, "chunk", many).groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score(folder, model, max(answers)), SCORED)


def unused_shuffles(spark: SparkSession) -> None:
    """Have Spark's context cleaner delete the shuffle files that no table refers to; it hears of them when the driver's JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def learned(chunks: DataFrame, folder: str, order: int, keep: bool) -> tuple[Discounts, dict[int, DataFrame], dict[int, int]]:
    """Discounts, stored answers of each order, with the pages if they are to be kept, and the parts, of chunks. What an order's questions took of the shuffle's disk is given back when it is told."""
    size = chunks.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words")).first()
    parts = {n: parts_for(int((size.words if n == 1 else size.tokens) or 0)) for n in range(1, order + 1)}
    answers: dict[int, DataFrame] = {}
    totals = {n: [0] * (K + 3) for n in parts}
    for n in parts:
        model = Discounts(totals) if n > 1 else None
        answers[n] = store(questions(chunks, folder, n, parts[n], answers, keep).groupBy("part").applyInArrow(owner(n, parts[n], model, keep)[0], TOLD).withColumn("page", F.col("chunk").isNull()), f"ngrams-{n}", "page")
        sums = answers[n].where("page").agg(*(F.sum(F.col("totals")[i]).alias(f"t{i}") for i in range(K + 3))).first()
        totals[n] = [int(t or 0) for t in sums]
        unused_shuffles(chunks.sparkSession)
    return Discounts(totals), answers, parts


def train(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of all the texts of a table; its pages stay in the shared folder."""
    chunks, folder = chunks_of(docs, F.lit(False), id_col, text_col)
    known, answers, parts = learned(chunks, folder, order, keep=True)
    pages = {n: store(a.where("page").drop("page"), f"model-{n}") for n, a in answers.items()}
    for a in (*answers.values(), chunks):
        drop_stored(a)
    remove(docs.sparkSession, folder)
    return Model(pages, parts, known)


def katz_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; rows with held_out teach nothing. Scores are stored; what they were made of goes."""
    chunks, folder = chunks_of(docs, held_out, id_col, text_col)
    known, answers, _ = learned(chunks, folder, order, keep=False)
    out = store(scored(chunks, folder, known, answers), "scores")
    for a in (*answers.values(), chunks):
        drop_stored(a)
    remove(docs.sparkSession, folder)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score")
