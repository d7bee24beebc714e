import hashlib
import random
import struct

import pyarrow.fs as pafs
import pytest
import zstandard

from mnemospark.llm import warc
from mnemospark.llm.common import new_folder


def pages(rng):
    same, small = "s" * 1500, "é" * 300
    rows = [(i, rng.choice(["http://a.example/x", "ftp://b\r\nc", None]), rng.choice([same, small, "x" * rng.randint(0, 3000), None, "", "\r\n\r\nWARC/1.1\r\n" * 200])) for i in rng.sample(range(10_000), 80)]
    return rows + [(20_000, None, "long " * 600_000), (20_001, "u", "é" * 500), (20_002, "u", "é" * 500), (20_003, "u", "é" * 499 + "a"), (20_004, "u", "é" * 499 + "a")]


def test_round_trip(spark):
    rows = pages(random.Random(3))
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, digest string, frame int").repartition(5)
    folder = new_folder(spark, "warc-test")
    index = warc.write_bundles(warc.with_revisits(df), folder)
    got = {r.record_id: r for r in warc.read_records(index, folder).collect()}
    top = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 1000:
            top[h] = max(top.get(h, i), i)
    assert len(got) == len(rows)
    for i, u, h in rows:
        h = (h or "").encode()
        refers = top.get(h, i) if top.get(h, i) != i else None
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(h), hashlib.sha1(h).hexdigest(), refers)
        assert r.record_type == ("response" if refers is None else "revisit") and bytes(r.payload) == (h if refers is None else b"")
        assert r.url == (u or "").replace("\r", "%0D").replace("\n", "%0A")
    some = [rows[0][0], 20_000]
    assert sorted(r.record_id for r in warc.lookup(index, folder, some).collect()) == sorted(some)
    # any Zstandard reader reads the whole bundle; the seek table is a skippable frame with the footer last
    bundle = index.first().bundle
    data = open(folder.removeprefix("file://") + "/" + bundle, "rb").read()
    assert struct.unpack("<I", data[-4:])[0] == warc.SEEKABLE_MAGIC
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).readall() for _ in range(1))
    mine = index.where(index.bundle == bundle).collect()
    assert sum(r.length for r in mine) == len(whole) and whole.startswith(b"WARC/1.1\r\n")


def test_frames_are_independent(tmp_path):
    fs = pafs.LocalFileSystem()
    w = warc.BundleWriter(fs, str(tmp_path / "b"))
    records = [warc.record_bytes(i, "u", b"p" * 300_000, hashlib.sha1(b"p" * 300_000).hexdigest(), None) for i in range(10)]
    at = [w.add(r) for r in records]
    w.close()
    r = warc.BundleReader(fs, str(tmp_path / "b"))
    assert len(r.frames) > 2
    for (frame, offset, length), want in reversed(list(zip(at, records, strict=True))):
        assert r.frame(frame)[offset : offset + length] == want
    with pytest.raises(ValueError):
        warc.parse_record(records[0].replace(b"ppp", b"qqq", 1))


def test_null_and_repeated_ids_and_no_rows(spark):
    same = "z" * 1000
    rows = [(None, "u", same), (None, None, None), (4, "u", same), (4, "u", same), (3, "u", same)]
    folder = new_folder(spark, "warc-test")
    index = warc.write_bundles(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")), folder)
    got = sorted((r.record_id or 0, r.record_type, r.refers_to or 0) for r in warc.read_records(index, folder).collect())
    assert got == [(0, "response", 0), (0, "response", 0), (3, "revisit", 4), (4, "response", 0), (4, "response", 0)]
    index = warc.write_bundles(warc.with_revisits(spark.createDataFrame([], "page_id long, url string, html string")), new_folder(spark, "warc-test"))
    assert warc.read_records(index, folder).count() == 0
