import hashlib
import io

import pytest
import zstandard

from plumbline.llm.queries import ORACLE_SQL, QUERIES
from plumbline.llm.warc import parse, read_records, read_seek_table, record_map, seek_records, write_bundles

PAGES = "page_id long, url string, html string, digest string"


def test_round_trip_with_revisits_and_edges(spark, tmp_path):
    long = "payload é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(3, "http://a/1", long), (1, "http://a/2", long), (2, "http://a/\r\n3", long), (4, None, None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", long), (1, "http://a/2", long), (8, "u", "z" * 3_000_000), (None, "u", None), (None, "u", None)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    archive = write_bundles(pages, f"file://{tmp_path}/bundles")
    got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in read_records(archive).collect())
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == long and i != 1
        want.append((i or -1, "revisit" if revisit else "response", 1 if revisit else None, len(raw), hashlib.sha256(raw).hexdigest(), None if revisit else html or ""))
    key = lambda w: (w[0], w[1], w[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    # The bundles are files: unpacked whole, and a frame at a time by the seek table.
    files, records = {f.name: f.read_bytes() for f in (tmp_path / "bundles").iterdir() if f.suffix == ".zst"}, 0
    for data in files.values():
        whole = b""
        for at, packed, unpacked in read_seek_table(io.BytesIO(data)):
            part = zstandard.ZstdDecompressor().decompress(data[at : at + packed])
            assert len(part) == unpacked
            whole += part
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as r:
            assert r.read() == whole
        records += len(list(parse(whole)))
    assert records == len(rows)
    # Every identifier is of one record, and the map's place of each is right.
    places = record_map(archive[1]).collect()
    assert len({p.record_id for p in places}) == len(rows)
    for p in places:
        at, packed, _ = read_seek_table(io.BytesIO(files[p.bundle]))[p.frame]
        raw = zstandard.ZstdDecompressor().decompress(files[p.bundle][at : at + packed])
        [(_, fields, _)] = parse(raw[p.frame_offset : p.frame_offset + p.length])
        assert fields["WARC-Record-ID"] == f"<{p.record_id}>" and fields.get("X-Page-ID") == (None if p.page_id is None else str(p.page_id))
    # Any record by its identifier, from its frame only.
    one = record_map(archive[1]).where("page_id = 8").select("record_id")
    assert [(r.page_id, len(r.payload)) for r in seek_records(archive, one).collect()] == [(8, 3_000_000)]


def test_revisits_name_the_record_of_their_response(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "same " * 40, "") for i in range(5)], PAGES)
    write_bundles(pages, f"file://{tmp_path}/b")
    fields = [f for file in (tmp_path / "b").glob("*.zst") for _, f, _ in parse(zstandard.ZstdDecompressor().stream_reader(file.read_bytes(), read_across_frames=True).read())]
    [response] = [f["WARC-Record-ID"] for f in fields if f["WARC-Type"] == "response"]
    assert [f["WARC-Refers-To"] for f in fields if f["WARC-Type"] == "revisit"] == [response] * 4


def test_a_map_that_lies_is_noticed(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(i, "u", "text " * i, "") for i in range(50)], PAGES)
    folder, bundles = write_bundles(pages, f"file://{tmp_path}/b")
    moved = bundles.withColumn("records", F.transform("records", lambda r: r.withField("frame_offset", r["frame_offset"] + 1)))
    with pytest.raises(Exception, match="WARC|substring|unpack|map"):
        read_records((folder, moved)).collect()
    fewer = bundles.withColumn("records", F.slice("records", 1, 3))
    with pytest.raises(Exception, match="seek table"):
        read_records((folder, fewer)).collect()


def test_empty_table(spark):
    archive = write_bundles(spark.createDataFrame([], PAGES))
    assert archive[1].count() == 0 and read_records(archive).count() == 0


def test_query(same):
    same(QUERIES["op9_warc"], ORACLE_SQL["op9_warc"])
