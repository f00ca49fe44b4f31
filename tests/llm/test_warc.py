import hashlib
import os

import zstandard

from catalift.functions.names import scratch_dir
from catalift.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, payload int, same string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def _pages():
    big = "<p>größe</p>" * 200
    rows = [(i, f"http://x/{i}", f"<b>{i}</b>" * (1 + i * 13 % 400)) for i in range(60)]
    rows += [(100 + i, "http://same", big) for i in range(20)] + [(200 + i, None, "small") for i in range(5)]
    rows += [(300, "http://a\r\nb", None), (301, "", ""), (None, "u", big), (302, "http://long", "y" * 3_000_000)]
    return rows + [(119, "http://same", big), (5, "again", "other")]


def _want(rows):
    first = {}
    for p, _, html in rows:
        if p is not None and len((html or "").encode()) >= 1000:
            first[html] = max(p, first.get(html, p))
    out = []
    for p, _, html in rows:
        data = (html or "").encode()
        refers = first.get(html) if p is not None and first.get(html, p) != p else None
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = _pages()
    got = warc.roundtrip(_frame(spark, rows).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == _want(rows)


def test_frames_stand_alone_and_records_are_found(spark):
    rows = _pages()
    folder = scratch_dir(spark)
    index = warc.write_archives(_frame(spark, rows).repartition(2), folder, frame_bytes=2000, bundle_bytes=300)
    files = sorted(os.listdir(folder))
    assert {r.file for r in index.select("file").distinct().collect()} == set(files) and len(files) > 3
    frames = 0
    for name in files:
        with open(f"{folder}/{name}", "rb") as f:
            data = f.read()
        parts = warc.frames_of(data)
        plain = b"".join(warc.read_frame(data, p) for p in parts)
        frames += len(parts)
        # any reader of Zstandard reads the whole bundle and skips the table
        reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
        assert reader.read() == plain
    assert frames > len(files)
    # what a lost task left behind is not opened
    with open(f"{folder}/lost.warc.zst", "wb") as f:
        f.write(b"cut short")
    read = {r.record_id: r for r in warc.read_archives(spark, index, folder).collect()}
    texts = {p: html for p, _, html in rows}
    for p in (7, 119, 302):
        assert read[f"urn:page:{p}"].payload == texts[p].encode()
    assert read["urn:page:100"].payload is None and read["urn:page:100"].refers_to == 119
    assert read["urn:page:300"].url == "http://a%0D%0Ab"
    some = warc.fetch(spark, index, folder, ["urn:page:7", "urn:page:100", "urn:page:none"]).collect()
    assert {r.page_id: r.payload for r in some} == {7: texts[7].encode(), 100: None}
    assert warc.fetch(spark, index, folder, ["urn:page:none"]).count() == 0


def test_empty(spark):
    assert warc.roundtrip(_frame(spark, [])).count() == 0
