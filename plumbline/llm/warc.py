"""WARC records in seekable Zstandard bundles.

Each task groups its records into frames of about a megabyte, each compressed on
its own, and writes runs of frames as bundle files into the shared folder. A
bundle closes with a seek table, a skippable frame that lists every frame's
sizes, so that any Zstandard reader unpacks a bundle and a seeking one opens a
single frame. A stored map gives each record identifier its bundle, frame, and
offset inside the unpacked frame. Readers open a bundle at its closing seek
table, unpack the frames they need, cut each record out at the place that the map
names, and check identifier and digest.

Files are written and read inside the tasks by pyarrow's file systems (file,
hdfs, s3, gs), under names of their own for each attempt; the map, which Spark
commits, names the ones that count, so a lost executor or a second attempt leaves
nothing that is read.

Of records with equal payloads of at least `min_bytes`, the one with the
smallest page id is the response, the others are revisits without payload.

Cases: a null payload is empty; a null page id is larger than any other; rows
that repeat the smallest id are responses each; records without page id, and
those of a payload that some page id has twice, get identifiers by their place,
so that every identifier is of one record, and such revisits name the page id
only; a
payload of any length lies in one frame; a null url leaves the target out, and
control characters in one are percent-encoded; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import place_of, qualified, shared_dir, store

FRAME_BYTES, BUNDLE_FRAMES, BUNDLE_RECORDS, MOST_READERS = 1 << 20, 64, 20_000, 4096
#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BUNDLES = "bundle string, n_frames int, records array<struct<record_id:string,page_id:long,frame:int,frame_offset:long,length:long>>"
RECORDS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"
SPACE_OF_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:plumbline:pages")


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    return f"urn:uuid:{uuid.uuid5(SPACE_OF_IDS, f'{page_id}:{digest}:{place}')}"


def record(identifier: str, page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_to_id: str | None, date: str) -> bytes:
    """One record; the HTTP head of a revisit still tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (b"" if refers_to is not None else payload)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{identifier}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
        if refers_to_id is not None:
            fields.append(("WARC-Refers-To", f"<{refers_to_id}>"))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of each record in unpacked bytes."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        yield at, fields, raw[start:stop]
        at = stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame: packed and unpacked size of each frame."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle) -> list[tuple[int, int, int]]:
    """(offset in the file, packed size, unpacked size) of each frame of an open bundle, from its end."""
    size = bundle.seek(0, 2)
    bundle.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", bundle.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    bundle.seek(size - 9 - 8 * n)
    at, out = 0, []
    for packed, unpacked in struct.iter_unpack("<II", bundle.read(8 * n)):
        out.append((at, packed, unpacked))
        at += packed
    return out


class BundleWriter:
    """A bundle file: frames as they fill, the seek table at the end; and the map of its records."""

    def __init__(self, folder: str, name: str, level: int) -> None:
        system, base = place_of(folder)
        system.create_dir(base, recursive=True)
        self.name, self.packer = name, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.file = system.open_output_stream(f"{base}/{name}", compression=None)
        self.sizes: list[tuple[int, int]] = []
        self.records: list[dict] = []
        self.raw: list[bytes] = []
        self.at = 0

    @property
    def full(self) -> bool:
        return len(self.sizes) >= BUNDLE_FRAMES or len(self.records) >= BUNDLE_RECORDS

    def add(self, identifier: str, page_id: int | None, raw: bytes) -> None:
        self.records.append({"record_id": identifier, "page_id": page_id, "frame": len(self.sizes), "frame_offset": self.at, "length": len(raw)})
        self.raw.append(raw)
        self.at += len(raw)
        if self.at >= FRAME_BYTES:
            self.frame()

    def frame(self) -> None:
        if self.raw:
            data = self.packer.compress(b"".join(self.raw))
            self.file.write(data)
            self.sizes.append((len(data), self.at))
            self.raw, self.at = [], 0

    def close(self) -> pa.RecordBatch:
        self.frame()
        self.file.write(seek_table(self.sizes))
        self.file.close()
        return pa.RecordBatch.from_pylist([{"bundle": self.name, "n_frames": len(self.sizes), "records": self.records}], schema=BUNDLES_ARROW)


def pack(folder: str, date: str, level: int):
    """Function over rows (page_id, url, payload, size, digest, refers_to, repeats) that writes bundles and gives their map rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, attempt, n = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        bundle = None
        for batch in batches:
            payloads = batch.column(2)
            for i, (page, url, size, digest, refers, repeats) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)), strict=True)):
                bundle = bundle or BundleWriter(folder, f"part-{task:06d}-{attempt}-{n:09d}.warc.zst", level)
                identifier = record_id(page, digest, f"{task}:{n}" if repeats or page is None else "")
                target = record_id(refers, digest) if refers is not None and not repeats else None
                bundle.add(identifier, page, record(identifier, page, url, payloads[i].as_py().encode() if refers is None else b"", size, digest, refers, target, date))
                n += 1
                if bundle.full:
                    yield bundle.close()
                    bundle = None
        if bundle:
            yield bundle.close()

    return run


BUNDLES_ARROW = pa.schema([("bundle", pa.string()), ("n_frames", pa.int32()), ("records", pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("length", pa.int64())])))])
RECORDS_ARROW = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())])


def write_bundles(pages: DataFrame, folder: str | None = None, min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> tuple[str, DataFrame]:
    """Write pages (page_id, url, html) as bundles into a folder that all executors see (a new one in the shared folder); returns the folder and the stored map of its bundles."""
    spark = pages.sparkSession
    folder = qualified(spark, folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha2(F.col("payload").cast("binary"), 256).alias("digest"))
    each = rows.groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    classes = each.groupBy("digest").agg(F.min("page_id").alias("first"), F.bool_or(F.col("n") > 1).alias("repeats"), F.sum("n").alias("n"), F.first("size").alias("size"))
    classes = classes.where("n > 1").select("digest", F.when(F.col("size") >= min_bytes, F.col("first")).alias("first"), "repeats")
    refers = F.when(F.col("page_id").isNull() | (F.col("first") < F.col("page_id")), F.col("first"))
    dealt = rows.join(classes, "digest", "left").select("page_id", "url", "payload", "size", "digest", refers.alias("refers_to"), F.coalesce("repeats", F.lit(False)).alias("repeats"))
    return folder, store(dealt.mapInArrow(pack(folder, date, level), BUNDLES), "warc-map")


def record_map(bundles: DataFrame) -> DataFrame:
    """record_id to bundle, frame, and place in the unpacked frame."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.record_id", "r.page_id", "bundle", "r.frame", "r.frame_offset", "r.length")


def cells(identifier: str, raw: bytes, payloads: bool) -> dict:
    """The columns of one record, which must be the one of that identifier and hold what its digest says."""
    [(_, fields, block)] = parse(raw)
    if fields["WARC-Record-ID"] != f"<{identifier}>":
        raise ValueError(f"{fields['WARC-Record-ID']} lies where the map has {identifier}")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    if response:
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{identifier}: the payload isn't the one that was written")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return {"record_id": identifier, "page_id": page and int(page), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": refers and int(refers), "payload_bytes": size, "payload_digest": digest, "payload": payload.decode() if payloads and response else None}


def unpack(folder: str, payloads: bool, whole: bool):
    """Function over rows (bundle, records) that reads the records at their places; whole: they are all that the bundle has, which is checked against its seek table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        system, base = place_of(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                places: dict[int, list[dict]] = {}
                for r in batch.column(1)[i].as_py():
                    places.setdefault(r["frame"], []).append(r)
                with system.open_input_file(f"{base}/{batch.column(0)[i].as_py()}") as file:
                    table = read_seek_table(file)
                    if whole and (len(table) != len(places) or any(unpacked != sum(r["length"] for r in places[n]) for n, (_, _, unpacked) in enumerate(table))):
                        raise ValueError("the map and the seek table don't agree")
                    for n, wanted in sorted(places.items()):
                        at, packed, unpacked = table[n]
                        file.seek(at)
                        raw = unpacker.decompress(file.read(packed), max_output_size=unpacked)
                        yield pa.RecordBatch.from_pylist([cells(r["record_id"], raw[r["frame_offset"] : r["frame_offset"] + r["length"]], payloads) for r in wanted], schema=RECORDS_ARROW)

    return run


def read_records(archive: tuple[str, DataFrame], payloads: bool = True) -> DataFrame:
    """Every record, read back from the bundles; sizes and digests of responses are those of what was read."""
    folder, bundles = archive
    readers = max(1, min(MOST_READERS, bundles.count()))
    return bundles.select("bundle", "records").repartition(readers, "bundle").mapInArrow(unpack(folder, payloads, True), RECORDS)


def seek_records(archive: tuple[str, DataFrame], ids: DataFrame) -> DataFrame:
    """The records with the given record_id, unpacking only the frames that hold them."""
    folder, bundles = archive
    places = record_map(bundles).join(ids.select("record_id").distinct(), "record_id").groupBy("bundle").agg(F.collect_list(F.struct("record_id", "page_id", "frame", "frame_offset", "length")).alias("records"))
    return places.mapInArrow(unpack(folder, True, False), RECORDS)
