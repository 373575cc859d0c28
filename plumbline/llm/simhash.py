"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint has a bit for each bit of its shingles' hashes that is
set in over half of them. Fingerprints that are close share a block of bits: the
bits are cut into `blocks`, and each choice of `agree` blocks is a key. If at
most blocks - agree bits differ, some key is the same. Equal fingerprints (equal
sets of shingles where links are held against a similarity) are one node, so a
text with a third of all rows is one. Nodes are dealt by key,
those with one key are compared by Hamming distance, and the links found go to a
distributed search for connected components (hooking and shortcutting; every
round is written to the shared folder).

A key that more than `CHUNK` nodes share is not skipped: its nodes are split into
chunks; each chunk meets itself, and every two chunks meet, in groups of their own,
so memory stays bounded and no link is lost. A group gives each node one link to a node in its
cluster, not all its pairs. Where links are also held against a similarity, those
that pass are joined first; then all other pairs of a cluster of close nodes whose
ends are still apart are held against it, so none hangs on which links were given.
Fingerprints are then of distinct shingles, and texts of few shingles, whose bits
say little, are found by the shingles that they share (a prefix filter, exact).

Cases: a null text is empty; a text without words has fingerprint zero, linked
like any other; fewer words than a shingle make one shingle; a null id is a
document, but never the smallest id of a component unless all ids in it are
null; repeated rows have one node and are given each; texts of any length count whole,
and the shingles of one are held at once; a bit that is set in exactly half of
the hashes is 0; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, numbered, store

SEED, CHUNK, FLUSH = 42, 2048, 200_000
#: Pairs whose bits are counted at once, by 8 bytes; keys of fewer rows than SMALL are compared together.
TILE, SMALL = 1 << 17, 32
#: Nodes of a chunk whose sets of shingles meet those of another chunk.
MEET = 512
#: Texts of at most so many shingles are also found by a shingle they share.
FEW = 80
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of words, single-spaced; the sequence itself if it is shorter."""
    tokens = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=n)


def lane(hashes: np.ndarray, nth: int) -> np.ndarray:
    """Further 64 bits of each hash, for longer fingerprints; the hash itself for lane 0."""
    if not nth:
        return hashes
    x = hashes + np.uint64(nth * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # most significant first


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """8 bytes a lane, most significant bit first."""
    out = bytearray()
    for nth in range(lanes):
        big = np.ascontiguousarray(lane(hashes, nth).astype(">u8")).view(np.uint8).reshape(-1, 8)
        counts = np.concatenate([np.bincount(big[:, k], minlength=256) @ BITS for k in range(8)])
        out += np.packbits(2 * counts > len(hashes)).tobytes()
    return bytes(out)


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row_id (row_col, or a number given here), doc_id and fingerprint (hexadecimal) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "").cast(pa.binary())
            made = [fingerprint(shingle_hashes(t.as_py(), words), lanes).hex() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["row_id", "doc_id", "fingerprint"])

    rows = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "row_id long, doc_id long, fingerprint string")


def signatures(docs: DataFrame, words: int, lanes: int, id_col: str, text_col: str, row_col: str) -> DataFrame:
    """row_id, doc_id, fingerprint of the distinct shingles, digest of them and, up to `FEW`, they themselves, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, digests, few = [], [], []
            for t in pc.fill_null(batch.column(2), "").cast(pa.binary()):
                hashes = np.unique(shingle_hashes(t.as_py(), words))
                made.append(fingerprint(hashes, lanes).hex())
                digests.append(xxhash.xxh3_128_hexdigest(hashes.tobytes()))
                few.append(hashes.view(np.int64) if len(hashes) <= FEW else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array(digests, pa.string()), pa.array(few, pa.list_(pa.int64()))], names=["row_id", "doc_id", "fingerprint", "digest", "few"])

    rows = docs.select(F.col(row_col).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "row_id long, doc_id long, fingerprint string, digest string, few array<long>")


def packed(hexes: pa.Array) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    raw = bytes.fromhex("".join(hexes.to_pylist()))
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(len(hexes), -1)


def block_keys(bits: int, blocks: int, agree: int):
    """Function that gives each node a row for each choice of blocks, with the key of their bits."""
    edges = [round(bits * b / blocks) for b in range(blocks + 1)]
    choices = list(itertools.combinations(range(blocks), agree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 2048) for k in range(0, batch.num_rows, 2048)):
                words = packed(part.column(1))
                flat = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1)
                value = [flat[:, lo:hi].astype(np.int64) @ (1 << np.arange(hi - lo, dtype=np.int64)) for lo, hi in zip(edges, edges[1:])]
                keys = np.empty((len(words), len(choices)), dtype=np.int64)
                for c, chosen in enumerate(choices):
                    key = np.full(len(words), c, dtype=np.uint64)
                    for b in chosen:
                        key = lane((key * np.uint64(0x9E3779B97F4A7C15)) ^ value[b].astype(np.uint64), 1)
                    keys[:, c] = key.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), part.column(0).take(pa.array(np.repeat(np.arange(len(words)), len(choices)))), part.column(1).take(pa.array(np.repeat(np.arange(len(words)), len(choices))))], names=["key", "node", "fingerprint"])

    return run


def tiles(prints: np.ndarray, low: np.ndarray, high: np.ndarray | None, max_bits: int) -> Iterator[np.ndarray]:
    """Pairs of rows with at most max_bits differing bits in their first 192, and some that differ in more: each of low with each of high, or all pairs of low. Bits are counted for a tile of pairs at a time, word by word, in bytes (so of three words at most: four could sum up to 256), and no row is gathered for a pair."""
    words = range(min(3, prints.shape[1]))
    left = [np.ascontiguousarray(prints[low, w]) for w in words]
    right = left if high is None else [np.ascontiguousarray(prints[high, w]) for w in words]
    wide = len(right[0])
    tall = max(1, min(len(low), TILE // wide))
    held = [np.empty(tall * wide, dtype=kind) for kind in (np.uint64, np.uint8, np.uint8)]
    for top in range(0, len(low), tall):
        end, start = min(top + tall, len(low)), top if high is None else 0
        differ, bits, more = (x[: (end - top) * (wide - start)].reshape(end - top, -1) for x in held)
        for w in words:
            np.bitwise_xor(left[w][top:end, None], right[w][None, start:], out=differ)
            np.bitwise_count(differ, out=more if w else bits)
            if w:
                np.add(bits, more, out=bits)
        a, b = np.nonzero(bits <= max_bits)
        a, b = a + top, b + start
        if high is None:
            a, b = a[b > a], b[b > a]
        yield np.stack([low[a], (low if high is None else high)[b]])


def near(keys: np.ndarray, sides: np.ndarray, prints: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key with at most max_bits differing bits, and these, for rows sorted by key and side. Of a key of `SMALL` rows or more that has both sides only pairs across them: those of one side meet elsewhere."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, dtype=np.int64)
    sizes = np.diff(edges)

    def close(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.bitwise_count(prints[pairs[0]] ^ prints[pairs[1]]).sum(axis=1).astype(np.int64)
        return pairs[:, bits <= max_bits], bits[bits <= max_bits]

    few = np.repeat(sizes < SMALL, sizes)
    last = np.repeat(edges[1:], sizes)
    for step in range(1, SMALL - 1):
        low = np.flatnonzero(few & (last > np.arange(len(keys)) + step))
        if not len(low):
            break
        yield close(np.stack([low, low + step]))
    for k in np.flatnonzero(sizes >= SMALL).tolist():
        rows = np.arange(edges[k], edges[k + 1])
        other = sides[rows] != 0
        across = other.any() and not other.all()
        for pairs in tiles(prints, rows[~other] if across else rows, rows[other] if across else None, max_bits):
            if pairs.shape[1]:
                yield close(pairs)


def linked(keys: np.ndarray, sides: np.ndarray, nodes: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key and side: each node and the least node of its cluster among the rows with its key."""
    label = np.arange(len(keys))
    found: list[np.ndarray] = []
    for pairs, _ in near(keys, sides, prints, max_bits):
        found.append(pairs)
        if sum(f.shape[1] for f in found) > 2_000_000:
            label = settle(label, np.concatenate(found, axis=1))
            found = []
    if found:
        label = settle(label, np.concatenate(found, axis=1))
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return nodes[moved], nodes[label[moved]]


def forest(n: int, pairs: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indices of pairs that connect what all of them connect, at every number of differing bits: closer pairs first."""
    label, chosen = np.arange(n), [np.empty(0, dtype=np.int64)]
    order = np.argsort(bits, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(bits[order])) + 1):
        while True:
            a, b = label[pairs[0, level]], label[pairs[1, level]]
            cross = a != b
            if not cross.any():
                break
            level, a, b = level[cross], a[cross], b[cross]
            pick = np.unique(np.unique(np.concatenate([a, b]), return_index=True)[1] % len(level))  # one pair for each cluster
            chosen.append(level[pick])
            label = settle(label, pairs[:, level[pick]])
    return np.concatenate(chosen)


def spanning(keys: np.ndarray, sides: np.ndarray, nodes: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key and side: pairs of nodes of one key with at most max_bits differing bits that connect what all such pairs that meet here connect."""
    held = [(np.empty((2, 0), dtype=np.int64), np.empty(0, dtype=np.int64))]
    many = 0

    def kept() -> tuple[np.ndarray, np.ndarray]:
        pairs, bits = np.concatenate([p for p, _ in held], axis=1), np.concatenate([b for _, b in held])
        chosen = forest(len(keys), pairs, bits)
        return pairs[:, chosen], bits[chosen]

    for pairs, bits in near(keys, sides, prints, max_bits):
        held.append((pairs, bits))
        many += len(bits)
        if many > 2_000_000:
            held = [kept()]
            many = len(held[0][1])
    pairs, _ = kept()
    return nodes[pairs[0]], nodes[pairs[1]]


def settle(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Labels after joining the rows of each pair: the least row of each cluster."""
    while True:
        a, b = label[pairs[0]], label[pairs[1]]
        if (a == b).all():
            return label
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label != label[label]).any():
            label = label[label]


def compare(max_bits: int, find=linked):
    """Function over rows (key, side, node, fingerprint) sorted by key and side: links inside each key. A key has a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list) -> pa.RecordBatch:
            keys, sides, nodes, prints = (np.concatenate([p[k] for p in parts]) for k in range(4))
            a, b = find(keys, sides, nodes, prints, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=PAIR)

        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(0))
            new = (keys, np.asarray(batch.column(1)), np.asarray(batch.column(2)), packed(batch.column(3)))
            rows += len(keys)
            if rows < FLUSH or keys[0] == keys[-1]:
                held.append(new)
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            held.append(tuple(x[:cut] for x in new))
            yield flush(held)
            held, rows = [tuple(x[cut:] for x in new)], len(keys) - cut
        if held:
            yield flush(held)

    return run


def close_links(nodes: DataFrame, bits: int, max_bits: int, blocks: int, agree: int, used: list[DataFrame], find=linked) -> DataFrame:
    """Links a, b between nodes (node, fingerprint) that connect exactly what Hamming distances of max_bits or fewer connect within shared keys; with find=spanning each link is a pair that close. Adds to `used` the stored tables that they are read from."""
    keyed = store(nodes.select("node", "fingerprint").mapInArrow(block_keys(bits, blocks, agree), "key long, node long, fingerprint string"), "blocks")
    hot = store(keyed.groupBy("key").count().where(F.col("count") > CHUNK).select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "hot-keys")
    used += [keyed, hot]
    chunk = F.pmod(F.xxhash64("node", "key"), F.col("chunks")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("i"), F.greatest(c, F.col("chunk")).alias("j")))
    cold = keyed.join(hot, "key", "left_anti").select("key", F.lit(0).alias("side"), "node", "fingerprint")
    split = keyed.join(hot, "key").withColumn("chunk", chunk).select("key", "chunk", F.explode(every).alias("pair"), "node", "fingerprint").select(F.xxhash64("key", "pair.i", "pair.j").alias("key"), (F.col("chunk") > F.col("pair.i")).cast("int").alias("side"), "node", "fingerprint")
    dealt = cold.unionByName(split).repartition("key").sortWithinPartitions("key", "side", "node")
    return dealt.mapInArrow(compare(max_bits, find), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that links reach, for every node with a link. Large-star and small-star steps until nothing changes."""
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        new = store(small, "small-star")
        same = new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        drop_stored(large)
        drop_stored(edges)
        edges = new
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def shingle_sets(rows: DataFrame, words: int, text_col: str, row_col: str) -> DataFrame:
    """node and the sorted distinct shingle hashes of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in pc.fill_null(part.column(1), "").cast(pa.binary())]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))], names=["node", "shingles"])

    return rows.select(F.col(row_col).alias("node"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "node long, shingles array<long>")


def similar(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links whose sets of shingles have a Jaccard similarity of at least `similarity`; empty sets are alike."""
    both = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where((common >= similarity * (F.size("x") + F.size("y") - common)) | (F.size("x") + F.size("y") == 0)).select("a", "b")


def few_links(nodes: DataFrame, similarity: float, used: list[DataFrame]) -> DataFrame:
    """Links a, b that connect all pairs of sets (node, few) with the similarity, among others: such sets share one of their rarest shingles, of which each is asked for as many as the similarity leaves out, and one more. Adds to `used` the stored tables that they are read from."""
    each = store(nodes.where("few is not null").select("node", F.size("few").alias("n"), F.explode("few").alias("shingle")), "few-shingles")
    counts = each.groupBy("shingle").agg(F.count("*").alias("times"))
    rarest = Window.partitionBy("node").orderBy("times", "shingle")
    asked = each.join(counts, "shingle").withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1)
    asked = store(asked.where("times > 1").select("node", "shingle"), "rare-shingles")
    used += [each, asked]
    least = asked.groupBy("shingle").agg(F.min("node").alias("a"))
    return asked.join(least, "shingle").where("a < node").select("a", F.col("node").alias("b")).distinct()


def passing(nodes: np.ndarray, roots: np.ndarray, flat: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs that connect, beside what has one root already, what all pairs of sets with the similarity connect. flat: the sets in a row."""
    ids = np.unique(flat, return_inverse=True)[1]
    ends = np.cumsum(sizes)
    label = np.unique(roots, return_inverse=True)[1]
    flag, found = np.zeros(int(ids.max(initial=-1)) + 1, dtype=bool), []
    for i in range(len(nodes) - 1):
        if not sizes[i]:
            continue
        lo, hi = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        others = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (lo >= similarity * hi))
        if not len(others):
            continue
        mine = ids[ends[i] - sizes[i] : ends[i]]
        flag[mine] = True
        if len(others) < 8:
            common = np.array([np.count_nonzero(flag[ids[ends[j] - sizes[j] : ends[j]]]) for j in others.tolist()])
        else:
            upto = np.append(0, np.cumsum(flag[ids[ends[i] :]]))
            common = upto[ends[others] - ends[i]] - upto[ends[others] - sizes[others] - ends[i]]
        flag[mine] = False
        for j in others[common >= similarity * (sizes[i] + sizes[others] - common)].tolist():
            if label[j] != label[i]:
                found.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return found


def meeting(similarity: float):
    """Function over rows (meet, node, root, shingles) sorted by meet, a bounded number for each: the links found in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            sets = whole.column("shingles").combine_chunks()
            pairs = passing(np.asarray(whole.column("node")), np.asarray(whole.column("root")), np.asarray(sets.flatten()), np.asarray(pc.list_value_length(sets)).astype(np.int64), similarity)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=PAIR)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            meet = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(np.diff(meet)) + 1).tolist(), len(meet)]
            for lo, hi in zip(edges, edges[1:]):
                if held and hi > lo and held[-1].column(0)[0].as_py() != meet[lo]:
                    yield found(held)
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield found(held)

    return run


def left_apart(links: DataFrame, passed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between nodes that candidate links connect and those that passed do not: all pairs of a cluster of candidates with different roots are held against the similarity. Clusters are cut into chunks of at most about `MEET` nodes, and every two chunks meet, but for chunks of one root."""
    of_links, of_passed = (components(x) for x in (links, passed))
    members = sets.select("node").join(of_links.withColumnRenamed("root", "cluster"), "node", "left").join(of_passed, "node", "left")
    members = store(members.select("node", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("root", "node").alias("root")), "members")
    sizes = members.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    apart = sizes.groupBy("cluster").agg(F.count("*").alias("roots"), F.sum("n").alias("nodes")).where("roots > 1 and nodes > 2").select("cluster")
    held = F.when(F.col("n") > MEET, F.col("root").cast("string")).otherwise("")
    sizes = store(sizes.join(apart, "cluster", "left_semi").select("cluster", "root", "n", held.alias("of")), "roots")
    pools = sizes.groupBy("cluster", "of").agg(F.ceil(F.sum("n") / MEET).cast("int").alias("chunks"))
    chunks = store(pools.select("cluster", "of", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k")), "chunks")
    a, b = (chunks.select("cluster", F.struct("of", "k").alias(x)) for x in "ab")
    meets = a.join(b, "cluster").where("a <= b and (a.of <> b.of or a.of = '')").select("cluster", "a", "b", F.xxhash64("cluster", "a", "b").alias("meet"))
    places = meets.select("cluster", "a.*", "meet").unionByName(meets.where("a <> b").select("cluster", "b.*", "meet"))
    placed = members.join(sizes.select("cluster", "root", "of"), ["cluster", "root"]).join(pools, ["cluster", "of"]).withColumn("k", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = placed.join(places, ["cluster", "of", "k"]).select("meet", "node", "root").join(sets, "node").select("meet", "node", "root", "shingles")
    return dealt.repartition("meet").sortWithinPartitions("meet", "node").mapInArrow(meeting(similarity), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, lanes: int = 1, blocks: int = 4, agree: int = 2, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row_id, doc_id, fingerprint, component_id (smallest id that links reach), component_row (the row of that id) for every row. With a similarity, links are also held against it exactly; row_col must then name the rows."""
    used: list[DataFrame] = []
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first")
    if similarity is None:
        same = "fingerprint"
        prints = store(fingerprints(docs, words, lanes, id_col, text_col, row_col), "fingerprints")
        nodes = store(prints.groupBy(same).agg(first).select(same, F.col("first.row_id").alias("node"), "first"), "nodes")
        links = close_links(nodes, 64 * lanes, max_bits, blocks, agree, used)
    else:
        same = "digest"
        prints = store(signatures(docs, words, lanes, id_col, text_col, row_col), "fingerprints")
        nodes = store(prints.groupBy(same).agg(first, F.min("fingerprint").alias("fingerprint"), F.min("few").alias("few")).select(same, "fingerprint", "few", F.col("first.row_id").alias("node"), "first"), "nodes")
        close = close_links(nodes, 64 * lanes, max_bits, blocks, agree, used, spanning).unionByName(few_links(nodes, similarity, used))
        close = store(close.distinct(), "close-pairs")
        ends = close.select(F.col("a").alias(row_col)).unionByName(close.select(F.col("b").alias(row_col))).distinct()
        sets = store(shingle_sets(docs.join(ends, row_col, "left_semi"), words, text_col, row_col), "shingle-sets")
        passed = store(similar(close, sets, similarity), "passed")
        links = store(passed.unionByName(left_apart(close, passed, sets, similarity)), "similar-pairs")
        used += [close, sets, passed, links]
    roots = components(links)
    for t in used:
        drop_stored(t)
    placed = nodes.join(roots, "node", "left").select(same, "first", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("first"))
    classes = placed.select(same, "root").join(least, "root").select(same, F.col("first.doc_id").alias("component_id"), F.col("first.row_id").alias("component_row"))
    return prints.join(classes, same).select("row_id", "doc_id", "fingerprint", "component_id", "component_row")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = 64, lanes: int = 4, blocks: int = 30, agree: int = 1) -> DataFrame:
    """The rows of docs that stay, one of each component, with their columns.

    256-bit fingerprints of distinct five-word shingles: a Jaccard similarity of 0.8 makes 39 bits differ on average, with a standard deviation of 6. Pairs of up to 29 bits always share one of the 30 blocks; a pair that differs in 39 bits does with a probability of 0.999, one in 50 bits of 0.99. Pairs of up to 64 bits connect nodes to clusters, and so do rare shingles of texts of up to 80 shingles, where no pair is missed; in each cluster, every pair not yet connected by pairs that passed is held against the similarity itself."""
    rows, row = numbered(docs)
    stay = near_duplicates(rows, words, max_bits, lanes, blocks, agree, similarity, row_col=row).where("row_id = component_row").select(F.col("row_id").alias(row))
    return rows.join(stay, row, "left_semi").select(*(rows[c] for c in docs.columns))
