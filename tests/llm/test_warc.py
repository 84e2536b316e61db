"""Operator 13: bundles read back, by any Zstandard decoder too, and its defined results."""

from __future__ import annotations

import hashlib
import io
from pathlib import Path

import pytest
import zstandard

from pixelweave.llm import warc
from tests.compare import connect, rows_of


def bundles(path) -> list[Path]:
    return sorted(p for p in Path(f"{path}/bundles").iterdir() if p.name.startswith("part-"))


def test_query_against_sql(spark, sf):
    got = warc.op13_warc(spark, sf)
    ref = connect(sf).execute(warc.OP13_SQL)
    assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in ref.description], ref.fetchall())


BIG = "x" * 600 + "é" * 300
PAGES = [
    (1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, "http://a/3", BIG), (7, None, "short"), (8, "u v\n", "short"), (9, "", None), (10, "u", ""),
    (11, "u", "y" * 1000), (12, "u", "y" * 1000), (13, "u", "z" * 999), (14, "u", "z" * 999), (None, "u", BIG), (None, "u", "w" * 2000), (None, "u", "w" * 2000), (20, "u", "r" * 1500), (20, "u", "r" * 1500),
    (21, "u", "WARC/1.1\r\n\r\n" * 200),
]


def expected(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "").encode() == body]
        first = max(same) if same and len(body) >= 1000 else page
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("frame_bytes,frames,hot", [(1 << 20, 128, 4096), (3000, 2, 4096), (1, 3, 0), (3000, 2, 1)])
def test_round_trip(spark, tmp_path, monkeypatch, frame_bytes, frames, hot):
    """Every way of cutting and looking up gives the same records; hot groups and others are told alike."""
    monkeypatch.setattr(warc, "HOT", hot) if hot else monkeypatch.setattr(warc, "HOT", 0)
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    warc.write_bundles(rows, f"file://{tmp_path}/w", frame_bytes, frames)
    found = warc.read_records(spark, f"file://{tmp_path}/w")
    got = [(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.to) for r in found.select("*", warc.page_of(found.record_id).alias("page"), warc.page_of(found.refers_to).alias("to")).collect()]
    assert sorted(got, key=str) == expected(PAGES)
    bodies = {r.payload_digest: bytes(r.payload) for r in found.where("record_type = 'response'").collect()}
    assert all(hashlib.sha1(b).hexdigest() == d for d, b in bodies.items()) and {d for _, _, d, _, _ in got} == set(bodies)
    for p in bundles(f"{tmp_path}/w"):
        content = p.read_bytes()
        table = warc.seek_table(content)
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        assert plain == b"".join(warc.read_frame(content, e) for e in table if e[2])
        assert sum(e[1] for e in table) + 8 + 12 * len(table) + 9 == len(content)
        assert content[-4:] == bytes.fromhex("b1ea928f")


def test_lookup_by_the_index(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_bundles(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3), path, 2000, 2)
    ids = spark.createDataFrame([("<urn:page:5>",), ("<urn:page:3>",), ("<urn:page:99>",), ("<urn:page:5>",)], "record_id string")
    got = {r.record_id: r for r in warc.lookup(spark, path, ids).collect()}
    assert set(got) == {"<urn:page:5>", "<urn:page:3>"}
    assert bytes(got["<urn:page:5>"].payload) == BIG.encode() and got["<urn:page:3>"].refers_to == "<urn:page:5>" and got["<urn:page:3>"].payload is None
    index = spark.read.parquet(f"{path}/index")
    assert index.count() == len(PAGES)
    for r in index.collect():
        content = next(p for p in bundles(f"{tmp_path}/w") if p.name == r.bundle).read_bytes()
        frame = warc.read_frame(content, warc.seek_table(content)[r.frame])
        assert next(warc.parse_records(frame[r.offset : r.offset + r.length]))[2][0] == r.record_id


def test_long_records_end_a_bundle_early(spark, tmp_path):
    import random

    rnd = random.Random(4)
    rows = [(i, "u", "".join(rnd.choices("abcdefghijklmnop", k=200_000))) for i in range(12)]
    warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w", 1000, 50, 300_000)
    assert len(bundles(f"{tmp_path}/w")) == 4 and max(p.stat().st_size for p in bundles(f"{tmp_path}/w")) < 500_000
    assert warc.read_records(spark, f"file://{tmp_path}/w").count() == 12


def test_damage_is_found(spark, tmp_path):
    warc.write_bundles(spark.createDataFrame(PAGES[:3], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    content = bytearray(bundles(f"{tmp_path}/w")[0].read_bytes())
    with pytest.raises(ValueError):
        warc.seek_table(bytes(content[:-1]))
    frame = warc.read_frame(bytes(content), warc.seek_table(bytes(content))[0]).replace(b"xxx", b"xyx", 1)
    with pytest.raises(ValueError, match="damaged"):
        list(warc.parse_records(frame))


def test_empty_table_and_extra_columns(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/a/pages.parquet")
    assert warc.op13_warc(spark, f"{tmp_path}/a").collect() == []
    spark.createDataFrame([(1, "u", "h", "k", 2)], "page_id long, url string, html string, payload string, refers_to int").write.parquet(f"{tmp_path}/b/pages.parquet")
    assert [r.page_id for r in warc.op13_warc(spark, f"{tmp_path}/b").collect()] == [1]
