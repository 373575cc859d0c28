"""Periodic runs of words: the linear method of Gusfield and Stoye for tandem repeats, run in every task over the texts of a batch.

1. Lempel-Ziv blocks. A square (a root said twice) that occurs for the first time
   has its centre in a block and ends in that block or the next, so common
   extensions around the borders of the blocks give squares that cover the
   leftmost occurrence of every kind of square.
2. From the place of each in the suffix tree, walks over suffix links roll the
   square on by a word as long as what comes occurs, until they meet a place that
   is marked already. Then the tree is marked with the whole vocabulary of squares.
3. The leaves below a mark are the square's occurrences. Occurrences of one root
   length that start word by word merge into runs.

Squares whose root is itself a repetition are left out in step 1: their runs have
a smaller period. Suffix arrays, common extensions and the links of the tree are
numpy; the blocks, the tree and the walks are loops of constant steps.

Only words that a repeated four-gram of their text covers go through this, many
texts in one array with distinct separators. No run is lost by that: a run of
period q and at least max(6, 4q) words has each of its four-grams a second time,
q words on or back, so it lies whole in one stretch of such words, and a word that
would extend it would be covered too.

Cases: a null or blank text has no words and no runs, and an empty text is what
stays; a null id leaves a text as it is, as there is nothing to derive a period
from; a text of any length is handled whole, in one task; rows that repeat are
answered each; runs of equal length go by start, then period; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words and so many periods; texts of so many bytes are handled together; border pairs are extended so many at once.
LEAST_WORDS, LEAST_PERIODS, BYTES_AT_ONCE, PAIRS_AT_ONCE = 6, 4, 4 << 20, 1 << 20
GRAM = 4


class Suffixes:
    """Suffix order of an integer text whose last item occurs nowhere else, with longest common extensions of any two positions in both directions.

    ranks[k] numbers the different substrings of 2^k items, as doubling finds them.
    """

    def __init__(self, text: np.ndarray) -> None:
        self.n = n = len(text)
        self.ranks = [np.unique(text, return_inverse=True)[1].astype(np.int32)]
        self.text, width = self.ranks[0], 1
        while int(self.ranks[-1].max()) + 1 < n:
            r = self.ranks[-1]
            key = r.astype(np.int64) * (n + 1)
            key[:-width] += r[width:] + 1
            self.ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
            width *= 2
        self.rank = self.ranks[-1]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items from a on equal those from b on; a and b differ everywhere."""
        a, b, far = a.astype(np.int64), b.astype(np.int64), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            step = (self.ranks[k][a + far] == self.ranks[k][b + far]).astype(np.int64) << k
            far += step
        return far

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items before a equal those before b; a and b differ everywhere."""
        far = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a - far - (1 << k), b - far - (1 << k)
            fits = (x >= 0) & (y >= 0)
            far += (fits & (self.ranks[k][np.where(fits, x, 0)] == self.ranks[k][np.where(fits, y, 0)])).astype(np.int64) << k
        return far


def blocks(suffixes: Suffixes) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the text's end: each block is the longest piece that began before, or one new item."""
    n = suffixes.n
    before, after, stack = [-1] * n, [-1] * n, []
    for p in suffixes.order.tolist():
        while stack and stack[-1] > p:
            after[stack.pop()] = p
        if stack:
            before[p] = stack[-1]
        stack.append(p)
    longest, here = np.zeros(n, np.int64), np.arange(n)
    for other in (np.array(before), np.array(after)):
        known = np.flatnonzero(other >= 0)
        longest[known] = np.maximum(longest[known], suffixes.ahead(here[known], other[known]))
    sizes, starts, at = longest.tolist(), [], 0
    while at < n:
        starts.append(at)
        at += max(1, sizes[at])
    return np.array([*starts, n])


def covering_squares(suffixes: Suffixes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of squares with primitive roots from which, rolled on word by word, the leftmost occurrence of every kind of square is reached."""
    n = suffixes.n
    lo, hi, over = starts[:-1], starts[1:], np.append(starts[2:], n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for left in (True, False):
        sizes = (over if left else hi) - lo
        ends = np.cumsum(sizes)
        for first in range(0, int(ends[-1]), PAIRS_AT_ONCE):
            nth = np.arange(first, min(first + PAIRS_AT_ONCE, int(ends[-1])))
            b = np.searchsorted(ends, nth, side="right")
            k = nth - (ends[b] - sizes[b]) + 1
            x = lo[b] if left else hi[b] - k
            inside = x + k < n
            x, k = x[inside], k[inside]
            begin = np.maximum(x - np.minimum(suffixes.behind(x, x + k), k), 0)
            square = begin <= np.minimum(x, x + suffixes.ahead(x, x + k) - k)
            found.append((begin[square], k[square]))
    s, k = (np.concatenate([f[c] for f in found]) for c in (0, 1))
    s, k = np.unique(np.stack([s, k]), axis=1) if len(s) else (s, k)
    least = np.arange(int(k.max(initial=1)) + 1)  # smallest prime factors
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            multiples = np.arange(p * p, len(least), p)
            least[multiples] = np.minimum(least[multiples], p)
    primitive, rest = np.ones(len(s), bool), k.copy()
    while (rest > 1).any():
        at = np.flatnonzero(rest > 1)
        p = least[rest[at]]
        d = k[at] // p
        primitive[at[suffixes.ahead(s[at], s[at] + d) >= 2 * k[at] - d]] = False
        rest[at] //= p
    return s[primitive], k[primitive]


class SuffixTree:
    """Nodes 0 to n-1 are the leaves in suffix order, n is the root, inner nodes follow. low and high: the leaves below a node."""

    def __init__(self, suffixes: Suffixes) -> None:
        self.suffixes, n = suffixes, suffixes.n
        order = suffixes.order
        shared = suffixes.ahead(order[:-1], order[1:]).tolist()
        depth, low, high, parent = (n - order).tolist() + [0], [*range(n), 0], [*range(n), n - 1], [n] * n + [-1]
        stack, top = [n], n
        for j, d in enumerate(shared):  # of leaves j and j + 1
            if depth[top] < d:
                depth.append(d), low.append(j), high.append(j), parent.append(top)
                top = len(depth) - 1
                stack.append(top)
                parent[j] = top
                continue
            parent[j] = top
            while depth[top] > d:
                high[top] = j
                under = stack[-2]
                if depth[under] < d:
                    depth.append(d), low.append(low[top]), high.append(j), parent.append(under)
                    under = stack[-1] = len(depth) - 1
                else:
                    stack.pop()
                parent[top], top = under, under
        parent[n - 1] = top
        for v in stack[1:]:
            high[v] = n - 1
        self.root, self.depth, self.low, self.high, self.parent = n, depth, low, high, parent
        self.ancestors = [np.array([*parent[:n], n, *parent[n + 1 :]])]
        while (self.ancestors[-1] != n).any():
            self.ancestors.append(self.ancestors[-1][self.ancestors[-1]])
        self.depths, self.lows, self.highs = np.array(depth), np.array(low), np.array(high)
        inner = np.arange(n + 1, len(depth))
        links = self.locus(order[self.lows[inner]] + 1, self.depths[inner] - 1)
        self.link = dict(zip(inner.tolist(), links.tolist(), strict=True))
        self.link[n] = n
        child = np.delete(np.arange(len(depth)), n)
        above = self.ancestors[0][child]
        self.width = n + 1
        self.child = dict(zip((above * self.width + suffixes.text[order[self.lows[child]] + self.depths[above]]).tolist(), child.tolist(), strict=True))

    def locus(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The highest nodes on the ways to the suffixes from start on that have at least size items."""
        at = self.suffixes.rank[start].astype(np.int64)
        for up in reversed(self.ancestors):
            higher = up[at]
            at = np.where(self.depths[higher] >= size, higher, at)
        return at

    def vocabulary(self, start: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, root length) of every kind of square: from those given, by walks over suffix links."""
        depth, low, parent, link, child, width, top = self.depth, self.low, self.parent, self.link, self.child, self.width, self.root
        text, order = self.suffixes.text.tolist(), self.suffixes.order.tolist()
        marks: set[tuple[int, int]] = set()
        for v, k in zip(self.locus(start, 2 * root).tolist(), root.tolist(), strict=True):
            size = 2 * k
            while (v, k) not in marks:
                marks.add((v, k))
                s = order[low[v]]
                leads, s = text[s], s + 1
                u = parent[v]
                at = link[u] if u != top else top
                while depth[at] < size - 1:  # down to the rest of the square; its words are known to be there
                    at = child[at * width + text[s + depth[at]]]
                if depth[at] > size - 1:
                    if text[order[low[at]] + size - 1] != leads:
                        break
                    v = at
                else:
                    v = child.get(at * width + leads, -1)
                    if v < 0:
                        break
        both = np.array(sorted(marks), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def occurrences(self, node: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, root length) of all leaves below the nodes."""
        sizes = self.highs[node] - self.lows[node] + 1
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.suffixes.order[np.repeat(self.lows[node], sizes) + within], np.repeat(root, sizes)


def runs_in(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least LEAST_WORDS and LEAST_PERIODS periods in an integer text whose last item occurs nowhere else."""
    suffixes = Suffixes(text)
    squares = covering_squares(suffixes, blocks(suffixes))
    if not len(squares[0]):
        return (np.empty(0, np.int64),) * 3
    tree = SuffixTree(suffixes)
    start, root = tree.occurrences(*tree.vocabulary(*squares))
    by = np.lexsort((start, root))
    start, root = start[by], root[by]
    begins = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (start[1:] != start[:-1] + 1)])
    ends = np.r_[begins[1:], len(start)] - 1
    length, period = start[ends] - start[begins] + 2 * root[begins], root[begins]
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    return start[begins][long], length[long], period[long]


def stretches(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[from, to) of the stretches of words that four-grams said twice in their text cover, if long enough for a run. Four-grams are compared by 64-bit hashes: two that collide only make a stretch longer."""
    n = len(words)
    if n < LEAST_WORDS:
        return (np.empty(0, np.int64),) * 2
    h = (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    h = h[: n - GRAM + 1].copy()
    for j in range(GRAM):
        h = (h ^ mixed[j : n - GRAM + 1 + j]) * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(32)
    at = np.flatnonzero(doc[: n - GRAM + 1] == doc[GRAM - 1 :])
    bits = max(10, int(n).bit_length() + 3)
    bucket = (h[at] >> np.uint64(64 - bits)).astype(np.int64)
    at = at[np.bincount(bucket, minlength=1 << bits)[bucket] > 1]
    _, back, count = np.unique(h[at], return_inverse=True, return_counts=True)
    at = at[count[back] > 1]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + GRAM, -1)
    covered = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    lo, hi = turn[::2], turn[1::2]
    cuts = np.flatnonzero(np.diff(doc)) + 1  # texts that touch are cut apart
    inner = cuts[(covered[cuts - 1] & covered[cuts])] if len(cuts) else cuts
    lo, hi = np.sort(np.r_[lo, inner]), np.sort(np.r_[hi, inner])
    long = hi - lo >= LEAST_WORDS
    return lo[long], hi[long]


def runs_of_texts(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of many texts: words of all texts in a row, and the text that each is in. Ordered by start, then period."""
    lo, hi = stretches(words, doc)
    if not len(lo):
        return (np.empty(0, np.int64),) * 3
    sizes = hi - lo
    ends = np.cumsum(sizes + 1)
    place = np.empty(int(ends[-1]), np.int64)  # of each item in the texts
    text = np.empty(int(ends[-1]), np.int64)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, source = np.repeat(ends - sizes - 1, sizes) + within, np.repeat(lo, sizes) + within
    place[at], text[at] = source, words[source]
    place[ends - 1], text[ends - 1] = -1, int(words.max()) + 1 + np.arange(len(ends))  # a separator of its own behind each stretch
    start, length, period = runs_in(text)
    start = place[start]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def periodic(n: int, doc_id: int | None) -> np.ndarray | None:
    """Where each word of a text of n words comes from, if its id asks for a planted period."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def found_in(ids: pa.Array, texts: pa.Array, planted: bool, spans: bool) -> pa.RecordBatch:
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(trimmed)
    sizes = np.where(np.asarray(pc.binary_length(trimmed)) > 0, np.asarray(pc.list_value_length(lists)), 0).astype(np.int64)
    flat = pc.list_flatten(lists)
    flat = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    words, ends = np.asarray(flat.indices).astype(np.int64), np.cumsum(sizes)
    begins, doc_ids = ends - sizes, ids.to_pylist()
    if planted:
        words = words.copy()
        for lo, hi, i in zip(begins.tolist(), ends.tolist(), doc_ids, strict=True):
            source = periodic(hi - lo, i)
            if source is not None:
                words[lo:hi] = words[lo:hi][source]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start, length, period = runs_of_texts(words, doc)
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    kept = np.cumsum(dropped[:-1]) == 0
    offsets = np.r_[0, np.cumsum(np.bincount(doc[kept], minlength=len(sizes)))].astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), flat.dictionary.take(pa.array(words[kept]))), " ")
    of_doc = np.searchsorted(doc[start], np.arange(len(sizes) + 1))
    columns: list[list] = [[] for _ in range(6)]
    rows = []
    for d in range(len(sizes)):
        part = slice(of_doc[d], of_doc[d + 1])
        mine = list(zip((start[part] - begins[d]).tolist(), length[part].tolist(), period[part].tolist(), strict=True))
        s, n, q = min(mine, key=lambda r: (-r[1], r[0], r[2])) if mine else (None, None, None)
        said = "".join(f"{a},{b},{c}\n" for a, b, c in mine)
        for column, value in zip(columns, (len(mine), s, n, q, 1000 * n // q if mine else None, sha256(said.encode()).hexdigest()), strict=True):
            column.append(value)
        if spans:
            rows.append([{"start": a, "length": b, "period": c} for a, b, c in mine])
    numbers = [pa.array(c, pa.int64()) for c in columns[:5]]
    hashes = pa.array([sha256(t.as_buffer() or b"").hexdigest() for t in collapsed.cast(pa.binary())])
    out = [ids, *numbers, pa.array(columns[5], pa.string()), hashes]
    names = [c.split(" ")[0] for c in FOUND.split(", ")]
    if spans:
        out += [pa.array(rows, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), collapsed]
        names += ["runs", "collapsed"]
    return pa.RecordBatch.from_arrays(out, names=names)


def periodic_runs(docs: DataFrame, planted: bool = False, spans: bool = False) -> DataFrame:
    """FOUND for every row of docs; spans adds the runs themselves and the text without what repeats. planted: some texts are first made periodic, as their ids say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES_AT_ONCE)))
                yield found_in(batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), planted, spans)
                at = end

    schema = FOUND + (", runs array<struct<start: long, length: long, period: long>>, collapsed string" if spans else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
