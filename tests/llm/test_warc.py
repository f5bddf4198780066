import hashlib
import io
import random
from collections import Counter

import pytest
import zstandard as zstd
from fixtures import SF
from pyspark.sql import functions as F

from lineweave.llm import warc

PAGES = "page_id long, url string, html string"


def rows():
    r = random.Random(2)
    page = lambda n: "<p>" + " ".join(r.choice(["wörd", "漢字", "text", "<b>x</b>"]) for _ in range(n)) + "</p>"
    big = [page(400) for _ in range(20)]
    out = [(i, f"http://h{i % 7}.example/{i}", r.choice(big)) for i in range(120)]
    out += [(200 + i, "http://x/", page(n)) for i, n in enumerate((0, 1, 5, 200, 60_000))]
    out += [(300, None, None), (301, "", ""), (302, "a\r\nX: y", "é" * 500), (303, " =?x ", "é" * 500), (304, "=?utf-8?B?AA==?=", "x" * 999), (305, "t\tb", "x" * 999), (306, "ü漢 字", "x" * 1000), (307, "u", "x" * 1000)]
    out += [(None, "n", "z" * 1500), (None, "n", "y" * 1500), (400, "z", "z" * 1500), (400, "z", "z" * 1500), (-5, "z", "z" * 1500)]
    return out


def frame(spark, data=None):
    df = spark.createDataFrame(rows() if data is None else data, PAGES)
    return df.withColumns({"payload": F.lit(1), "key": F.lit("k"), "last": F.lit(0), "record_id": F.lit(None).cast("int"), "times": F.lit(2.0)})


def brute(data):
    last = {}
    for i, _, html in data:
        if len((html or "").encode()) >= 1000:
            last[html] = max(last.get(html, -(10**20)), -(10**20) if i is None else i)
    out = Counter()
    for i, url, html in data:
        raw = (html or "").encode()
        at = last.get(html, -(10**20))
        revisit = at != -(10**20) and at != i
        out[i, url, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", at if revisit else None, None if revisit else html or ""] += 1
    return out


@pytest.mark.parametrize("dictionary", [None, b""])
def test_round_trip(spark, tmp_path, dictionary):
    path = f"file://{tmp_path}/a"
    warc.write_pages(frame(spark), path, dictionary=dictionary)
    got = warc.read_pages(spark, path)
    assert Counter(map(tuple, got.collect())) == brute(rows())
    short = Counter(k[:6] for k in brute(rows()).elements())
    assert Counter(map(tuple, warc.read_pages(spark, path, payload=False).collect())) == short


def test_files(spark, tmp_path):
    """The leading frame holds a dictionary, without which no record decodes; frames are records."""
    warc.write_pages(spark.read.parquet(f"{SF}/pages.parquet"), f"file://{tmp_path}/a")
    for path in tmp_path.glob("a/*.warc.zst"):
        raw = path.read_bytes()
        assert int.from_bytes(raw[:4], "little") == 0x184D2A5D
        size = int.from_bytes(raw[4:8], "little")
        dictionary = zstd.ZstdDecompressor().decompress(raw[8 : 8 + size])
        first = raw[8 + size :]
        with pytest.raises(zstd.ZstdError):
            zstd.ZstdDecompressor().decompressobj().decompress(first)
        plain = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary)).decompressobj().decompress(first)
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and plain.endswith(b"\r\n\r\n")
        frames = list(warc.Frames(io.BytesIO(raw)))
        assert all(x.startswith(b"WARC/1.1\r\n") and x.count(b"WARC-Record-ID: ") == 1 for _, x in frames)
        assert [at for at, _ in frames][0] == 8 + size


def archive(record, cut=None, extra=b""):
    raw = zstd.ZstdCompressor().compress(record) + extra
    return raw[:cut]


GOOD = warc.page_record("<urn:x-page:1>", "u", "response", hashlib.sha1(b"abc").hexdigest(), 3, b"abc", None, "2024-01-01T00:00:00Z")
BROKEN = {
    "cut off": archive(GOOD, -3),
    "no frame": archive(GOOD, None, b"garbage!"),
    "no WARC header": archive(b"HTTP" + GOOD),
    "no warc-date": archive(GOOD.replace(b"WARC-Date", b"WARC-Then")),
    "header line": archive(GOOD.replace(b"WARC-Type: ", b"WARC Type ")),
    "Content-Length": archive(GOOD + b"\r\n"),
    "block digest": archive(GOOD.replace(b"abc", b"abd")),
    "payload length": archive(warc.page_record("<x>", "u", "response", hashlib.sha1(b"abc").hexdigest(), 4, b"abc", None, "d")),
    "payload digest": archive(warc.page_record("<x>", "u", "response", "00" * 20, 3, b"abc", None, "d")),
    "two records": archive(GOOD + GOOD),
    "dictionary": (0x184D2A5D).to_bytes(4, "little") + (4).to_bytes(4, "little") + b"abcd" + archive(GOOD),
    "skippable": (0x184D2A5D).to_bytes(4, "little") + (400).to_bytes(4, "little") + b"abcd",
}


@pytest.mark.parametrize("what", sorted(BROKEN))
def test_broken_archives(tmp_path, what):
    (tmp_path / "x.warc.zst").write_bytes(BROKEN[what])
    with pytest.raises(warc.WarcError):
        list(warc.read_file(f"file://{tmp_path}", "x.warc.zst"))


def test_foreign_archives(spark, tmp_path):
    """Files without a list or a dictionary, with other skippable frames and record types, cut anywhere."""
    other = warc.encode_record({"WARC-Type": "metadata", "WARC-Record-ID": "<m>", "WARC-Date": "d"}, b"x: y")
    skip = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    (tmp_path / "b.warc.zst").write_bytes(skip + archive(GOOD) + archive(other) + skip + archive(GOOD.replace(b"WARC/1.1", b"WARC/1.0").replace(b"<urn:x-page:1>", b"<urn:uuid:7>")))
    got = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert [(r.record_id, r.payload_bytes, bytes(r.payload)) for r in got] == [("<urn:x-page:1>", 3, b"abc"), ("<urn:uuid:7>", 3, b"abc")]


def test_rotation_append_and_unlisted_files(spark, tmp_path):
    path, pages = f"file://{tmp_path}/a", frame(spark)
    spark.dataSource.register(warc.WarcZst)
    for _ in range(2):
        warc.page_records(pages).coalesce(1).write.format("warc_zst").mode("append").option("maxbytes", 3000).save(path)
    assert len(list(tmp_path.glob("a/*.warc.zst"))) > 4
    (tmp_path / "a" / "part-of-a-lost-task.warc.zst").write_bytes(b"half")
    once = brute(rows())
    assert Counter(map(tuple, warc.read_pages(spark, path).collect())) == once + once
    warc.page_records(pages).write.format("warc_zst").mode("overwrite").save(path)
    assert Counter(map(tuple, warc.read_pages(spark, path).collect())) == once


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write_pages(frame(spark, []), path)
    assert warc.read_pages(spark, path).collect() == []
