"""Exact deduplication with an extendible-hash index on shared files.

Texts are equal when identical after deleting ASCII white space. The first pass
normalises and digests each row and collapses the copies inside one Arrow batch
(comparing bytes), so that a text holding a third of all rows travels once per
batch. These representatives are dealt by key range to owner tasks, in no order
inside a range. An owner looks each one up in the range's extendible hash: the
directory's slot for the key's next bits names a bucket, the bucket holds a chain
for each key, and the chain's texts are compared byte by byte. What is found
joins its class; what is not is inserted. A bucket with more than `capacity` keys
splits on the next bit, and a split at full depth doubles the directory. The
finished directories and buckets are pages in the shared folder: rows find their
class in them by their representative, and texts of a later batch by lookup().

Cases: a null text is the empty text; empty texts are equal to each other; texts
of any length are compared whole, and a range's distinct texts are held at once
by its owner; a null id loses against any other id; rows repeated in full count
each, and exactly one row of a class stays; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, numbered, store

KEY_BITS = 64
DIGESTS = "row_id long, doc_id long, text_sha256 string, key long, rep_row long, norm binary, n long, best_chars long, best_id long, best_row long"
#: A directory page has the slots of a range, as numbers of buckets; a bucket page has entries. Long lists of an entry's representatives go on in further entries and pages.
INDEX = "key_range int, range_bits int, depth int, slots array<int>, bucket int, entries array<struct<key:long,chain:int,text_sha256:string,keep_row:long,keep_id:long,group_size:long,reps:array<long>>>"
PAGE_REPS = 4096


def better(chars: int, doc_id: int | None, row: int) -> tuple:
    """Sorts the row that stays first: most code points, smallest id, then first row."""
    return (-chars, doc_id is None, doc_id or 0, row)


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normalise and digest; a copy of a text seen in the batch points at its representative and carries no text."""
    for batch in batches:
        text = pc.fill_null(batch.column(2), "")
        rows, ids, chars = batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.utf8_length(text).to_pylist()
        seen: dict[bytes, list[int]] = {}
        norms: list[bytes | None] = []
        keys, hexes, reps = [], [], []
        size: list[int] = []
        best: list[tuple] = []
        for i, raw in enumerate(text.cast(pa.binary())):
            norm = raw.as_py().translate(None, SPACE)
            digest = hashlib.sha256(norm).digest()
            chain = seen.setdefault(digest, [])
            rep = next((j for j in chain if norms[j] == norm), i)
            hexes.append(digest.hex())
            reps.append(rep)
            mine = better(chars[i], ids[i], rows[i])
            size.append(1)
            best.append((mine, i))
            if rep == i:
                chain.append(i)
                norms.append(norm)
                keys.append(int.from_bytes(digest[:8], "big", signed=True))
            else:
                norms.append(None)
                keys.append(None)
                size[rep] += 1
                best[rep] = min(best[rep], (mine, i))
        won = [best[i][1] for i in range(len(rows))]
        masked = lambda values: [v if r == i else None for i, (v, r) in enumerate(zip(values, reps, strict=True))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(hexes, pa.string()), pa.array(keys, pa.int64()), pa.array([rows[r] for r in reps], pa.int64()), pa.array(norms, pa.binary()),
                pa.array(masked(size), pa.int64()), pa.array(masked([chars[w] for w in won]), pa.int64()), pa.array(masked([ids[w] for w in won]), pa.int64()), pa.array(masked([rows[w] for w in won]), pa.int64()),
            ],
            names=[c.split()[0] for c in DIGESTS.split(", ")],
        )


@dataclass(slots=True)
class Entry:
    """A class of equal texts: its digest, size, the row that stays so far, and the representatives met."""

    text: bytes
    text_sha256: str
    n: int
    best: tuple
    reps: list[int]


@dataclass(slots=True)
class Bucket:
    """The chains of the keys that share `depth` bits after those of the range."""

    depth: int
    chains: dict[int, list[Entry]]


class Directory:
    """Extendible hash of one key range, which shares the first base_bits bits."""

    def __init__(self, base_bits: int, capacity: int) -> None:
        self.base, self.capacity, self.depth = base_bits, capacity, 0
        self.slots = [Bucket(0, {})]

    def bits(self, key: int, depth: int) -> int:
        """The depth bits of the key after those of the range."""
        return ((key & (1 << KEY_BITS) - 1) >> KEY_BITS - self.base - depth) & (1 << depth) - 1

    def bucket(self, key: int) -> Bucket:
        return self.slots[self.bits(key, self.depth)]

    def find(self, key: int, text: bytes) -> Entry | None:
        """The entry of a text: along the chain of its key, by bytes."""
        return next((e for e in self.bucket(key).chains.get(key, ()) if e.text == text), None)

    def insert(self, key: int, entry: Entry) -> None:
        while True:
            bucket = self.bucket(key)
            if key in bucket.chains or len(bucket.chains) < self.capacity:
                bucket.chains.setdefault(key, []).append(entry)
                return
            self.split(bucket)

    def split(self, bucket: Bucket) -> None:
        if bucket.depth == self.depth:
            self.slots = [b for b in self.slots for _ in range(2)]
            self.depth += 1
        depth = bucket.depth + 1
        halves = [Bucket(depth, {}), Bucket(depth, {})]
        for k, chain in bucket.chains.items():
            halves[self.bits(k, depth) & 1].chains[k] = chain
        for at, b in enumerate(self.slots):
            if b is bucket:
                self.slots[at] = halves[at >> self.depth - depth & 1]

    def pages(self, key_range: int) -> Iterator[dict]:
        """The directory's page and those of its buckets."""
        number = {id(b): n for n, b in enumerate({id(b): b for b in self.slots}.values())}
        shared = {"key_range": key_range, "range_bits": self.base}
        yield shared | {"depth": self.depth, "slots": [number[id(b)] for b in self.slots], "bucket": None, "entries": None}
        for b in {id(b): b for b in self.slots}.values():
            held, reps = [], 0
            for key, chain in b.chains.items():
                for place, e in enumerate(chain):
                    for at in range(0, len(e.reps), PAGE_REPS):
                        part = e.reps[at : at + PAGE_REPS]
                        held.append({"key": key, "chain": place, "text_sha256": e.text_sha256, "keep_row": e.best[3], "keep_id": e.best[4], "group_size": e.n, "reps": part})
                        reps += len(part)
                        if reps >= PAGE_REPS:
                            yield shared | {"depth": b.depth, "slots": None, "bucket": number[id(b)], "entries": held}
                            held, reps = [], 0
            if held:
                yield shared | {"depth": b.depth, "slots": None, "bucket": number[id(b)], "entries": held}


def owner(base_bits: int, capacity: int):
    """Function of an owner task; its rows come range by range, in any order inside one."""

    def flush(part: int, directory: Directory) -> Iterator[pa.RecordBatch]:
        pages = list(directory.pages(part))
        for at in range(0, len(pages), 64):
            yield pa.RecordBatch.from_pylist(pages[at : at + 64], schema=INDEX_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, directory = None, None
        for batch in batches:
            for r in (r for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist()):
                if part != r["key_range"]:
                    if directory:
                        yield from flush(part, directory)
                    part, directory = r["key_range"], Directory(base_bits, capacity)
                mine = (*better(r["best_chars"], r["best_id"], r["best_row"])[:3], r["best_row"], r["best_id"])
                known = directory.find(r["key"], r["norm"])
                if known:
                    known.n += r["n"]
                    known.best = min(known.best, mine, key=lambda b: b[:4])
                    known.reps.append(r["rep_row"])
                else:
                    directory.insert(r["key"], Entry(r["norm"], r["text_sha256"], r["n"], mine, [r["rep_row"]]))
        if directory:
            yield from flush(part, directory)

    return run


ENTRY_ARROW = pa.struct([("key", pa.int64()), ("chain", pa.int32()), ("text_sha256", pa.string()), ("keep_row", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("reps", pa.list_(pa.int64()))])
INDEX_ARROW = pa.schema([("key_range", pa.int32()), ("range_bits", pa.int32()), ("depth", pa.int32()), ("slots", pa.list_(pa.int32())), ("bucket", pa.int32()), ("entries", pa.list_(ENTRY_ARROW))])


def build_index(digests: DataFrame, capacity: int = 256) -> DataFrame:
    """Directory and bucket pages of the stored digests, in the shared folder."""
    reps = digests.where("norm is not null").select("key", "norm", "text_sha256", "rep_row", "n", "best_chars", "best_id", "best_row")
    base = max(1, min(30, math.ceil(math.log2(max(1, reps.count()) / (4 * capacity) + 1))))
    ranges = F.expr(f"cast(shiftrightunsigned(key, {KEY_BITS - base}) as int)")
    dealt = reps.select(ranges.alias("key_range"), "*").repartition("key_range").sortWithinPartitions("key_range")
    return store(dealt.mapInArrow(owner(base, capacity), INDEX), "hash-index")


def lookup(index: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256, keep_id (null where the index has no such text) of rows of a later batch: each text's slot in its range's directory, the slot's bucket, and in that the key; texts are told apart by key and SHA-256, as the index keeps no texts."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(digest_rows, DIGESTS).select("doc_id", "text_sha256")
    rows = rows.withColumn("key", F.expr("cast(conv(substring(text_sha256, 1, 16), 16, -10) as long)"))
    bits = index.agg(F.max("range_bits").alias("b")).first().b or 1
    directories = index.where("slots is not null").select("key_range", "depth", "slots")
    slot = F.expr(f"cast(case when depth = 0 then 0 else shiftrightunsigned(shiftleft(key, {bits}), 64 - depth) end as int)")
    placed = rows.withColumn("key_range", F.expr(f"cast(shiftrightunsigned(key, {KEY_BITS - bits}) as int)")).join(directories, "key_range", "left").withColumn("bucket", F.get("slots", slot))
    entries = index.where("entries is not null").select("key_range", "bucket", F.explode("entries").alias("e")).select("key_range", "bucket", "e.key", "e.text_sha256", "e.keep_id").distinct()
    return placed.join(entries, ["key_range", "bucket", "key", "text_sha256"], "left").select("doc_id", "text_sha256", "keep_id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 256, row_col: str | None = None) -> DataFrame:
    """One row per input row: row_id (row_col, or a number given here), doc_id, keep_id, group_size, kept, text_sha256, key_range, bucket, depth."""
    narrow = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digests = store(narrow.mapInArrow(digest_rows, DIGESTS), "digests")
    pages = build_index(digests, capacity).where("entries is not null").select("key_range", "bucket", "depth", F.explode("entries").alias("e"))
    classes = pages.select(F.explode("e.reps").alias("rep_row"), "e.keep_row", "e.keep_id", "e.group_size", "key_range", "bucket", "depth")
    return digests.select("row_id", "doc_id", "text_sha256", "rep_row").join(classes, "rep_row").select("row_id", "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256", "key_range", "bucket", "depth")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 256) -> DataFrame:
    """The rows of docs that stay, with their columns."""
    rows, row = numbered(docs)
    stay = exact_dedup(rows, id_col, text_col, capacity, row).where("kept").select(F.col("row_id").alias(row))
    return rows.join(stay, row, "left_semi").select(*(rows[c] for c in docs.columns))
