import hashlib
import random
import zlib

import pytest

from ledgerlake.llm import media, warc
from ledgerlake.llm.common import open_store, read_manifest, shared_dir


def test_chunks_round_trip():
    for payload in (b"", b"x", b"\r\n" * 3000, bytes(range(256)) * 100):
        assert warc.dechunked(warc.chunked(payload, 1000)) == payload
    for broken in (b"", b"5\r\nabc", b"3\r\nabcXX0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n0\r\n", b"-3\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


def test_trailers_are_skipped():
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nX-Sum: 1\r\n\r\n") == b"abc"


def rewritten(path, change):
    """Changes the bytes of the first archive of path."""
    e = max(read_manifest(path), key=lambda e: e["bytes"])
    store, name = open_store(f"{path}/{e['file']}")
    with store.open_input_file(name) as src:
        data = change(src.read())
    with store.open_output_stream(name, compression=None) as out:
        out.write(data)


def test_broken_records_become_rows_with_errors(spark):
    rows = [(i, "u", f"page {i} " * 40) for i in range(30)]
    broken = [b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx", b"no head", warc.record({"WARC-Type": "response", "WARC-Record-ID": "<a>", "X-Archive-Key": "n/a"}, b""),
              b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <b>\r\nContent-Length: 99\r\n\r\nshort"]

    def heads(data):
        return data[:0] + b"".join(warc._gzip(b) for b in broken) + data

    def damaged(data):
        second = data.index(warc._MAGIC, 10)
        return data[: second + 40] + bytes(20) + data[second + 60 :]

    def cut(data):
        return data[:-30]

    for change, lost, errors in ((heads, 0, 4), (damaged, 1, 1), (cut, 1, 1)):
        path = shared_dir(spark, "w")
        df = spark.createDataFrame([(a, b, c.encode()) for a, b, c in rows], "id long, url string, payload binary").coalesce(1)
        warc.write_warc(df, path)
        rewritten(path, change)
        entries = read_manifest(path)
        store, name = open_store(f"{path}/{entries[0]['file']}")
        entries[0]["bytes"] = store.get_file_info(name).size
        warc.write_manifest(path, entries)
        got = warc.payloads(warc.read_warc(spark, path)).collect()
        whole = {r.key for r in got if r.error is None}
        assert len(whole) == 30 - lost and sum(r.error is not None for r in got) == errors
        assert all(r.payload is None for r in got if r.error is not None)


def test_numbers_out_of_range_are_errors_and_other_records_pass_through(spark):
    head = {"WARC-Record-ID": "<x>"}
    odd = [warc.record(head | {"WARC-Type": "response"} | f, b"") for f in (
        {"WARC-Segment-Number": "99999999999"}, {"WARC-Segment-Number": "0"}, {"X-Archive-Key": str(1 << 63)}, {"X-Archive-Refers-To-Key": "-" + "9" * 30}, {"WARC-Segment-Total-Length": "-1"}, {"X-Archive-Key": "--1"},
    )]
    odd.append(warc.record(head | {"WARC-Type": "response"}, b"HTTP/1.1 200 OK\r\nContent-Length: " + b"9" * 30 + b"\r\n\r\nx"))
    odd.append(warc.record(head | {"WARC-Type": "response"}, b"no message"))
    plain = [warc.record(head | {"WARC-Type": "warcinfo"}, b"software: x"), warc.record(head | {"WARC-Type": "metadata", "X-Archive-Key": "5"}, b""), warc.record(head | {"WARC-Type": "response", "X-Archive-Key": "6"}, b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc")]
    path = shared_dir(spark, "w")
    warc.write_warc(spark.createDataFrame([(1, "u", b"page" * 40)], "id long, url string, payload binary").coalesce(1), path)
    rewritten(path, lambda data: b"".join(warc._gzip(b) for b in [*odd, *plain]) + data)
    entries = read_manifest(path)
    store, name = open_store(f"{path}/{entries[0]['file']}")
    entries[0]["bytes"] = store.get_file_info(name).size
    warc.write_manifest(path, entries)
    got = warc.payloads(warc.read_warc(spark, path)).collect()
    assert sum(r.error is not None for r in got) == len(odd) and all(len(r.error) > len("broken message: ") for r in got if r.error)
    assert sorted((r.record_type, bytes(r.payload), r.n_bytes) for r in got if r.error is None and r.key != 1) == [("metadata", b"", 0), ("response", b"abc", 3), ("warcinfo", b"software: x", 11)]


def pages():
    rng = random.Random(1)
    big = "big é page " * 9000
    same = "s" * 1000
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://c\r\nX: y", "small"), (4, "d", "small"), (5, "e", same), (6, "f", same), (6, "f", same), (7, "g", big), (8, "h", big), (None, "n", same), (9, "i", "\r\n0\r\n\r\n" * 4000)]
    return rows + [(100 + i, "u", "".join(rng.choices("abcdefgh <>\r\n", k=rng.randint(0, 60_000)))) for i in range(20)]


def expected(rows):
    largest = {}
    for key, _, html in rows:
        if key is not None:
            largest[html or ""] = max(key, largest.get(html or "", key))
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        first = largest.get(html or "")
        revisit = len(data) >= 1000 and first is not None and key != first
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def write(spark, rows, segment):
    from pyspark.sql import functions as F

    path = shared_dir(spark, "w")
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "id long, url string, html string, digest int").repartition(3)
    warc.write_warc(df.select("id", "url", F.encode("html", "UTF-8").alias("payload"), "digest"), path, segment)
    return path


@pytest.mark.parametrize("segment", [300, 16 << 10, 1 << 30])
def test_archives_round_trip(spark, segment):
    rows = pages()
    read = warc.payloads(warc.read_warc(spark, write(spark, rows, segment))).collect()
    got = sorted(((r.key, r.n_bytes, hashlib.sha1(r.payload).hexdigest() if r.payload is not None else r.digest, r.record_type, r.refers_to) for r in read), key=str)
    assert got == expected(rows)
    assert all(r.error is None for r in read)


def test_every_range_gives_each_member_once(spark):
    path = write(spark, pages(), 5000)
    for e in read_manifest(path):
        uri = f"{path}/{e['file']}"
        whole = list(warc.members(uri, 0, e["bytes"]))
        for step in (997, 20_011, 1 << 20):
            parts = [m for at in range(0, e["bytes"], step) for m in warc.members(uri, at, min(at + step, e["bytes"]))]
            assert parts == whole


def test_missing_segments_are_told(spark):
    spark.dataSource.register(warc.WarcArchives)
    path = write(spark, [(1, "a", "x" * 5000), (2, "b", "y" * 5000)], 1000)
    for e in read_manifest(path):
        store, name = open_store(f"{path}/{e['file']}")
        with store.open_input_file(name) as src:
            data = src.read()
        kept, at = [], 0
        while at < len(data):
            z = zlib.decompressobj(31)
            text = z.decompress(data[at:])
            end = len(data) - len(z.unused_data)
            if b"WARC-Segment-Number: 3\r" not in text:
                kept.append(data[at:end])
            at = end
        with store.open_output_stream(name, compression=None) as out:
            out.write(b"".join(kept) + b"")
        e["bytes"] = sum(map(len, kept))
        warc.write_manifest(path, [e] if len(read_manifest(path)) == 1 else [dict(x, bytes=e["bytes"]) if x["file"] == e["file"] else x for x in read_manifest(path)])
    read = warc.payloads(warc.read_warc(spark, path)).collect()
    assert {(r.key, r.error, r.payload) for r in read} == {(1, "a segment is missing or repeated", None), (2, "a segment is missing or repeated", None)}


def test_empty_pages(spark):
    path = write(spark, [], 1000)
    assert warc.payloads(warc.read_warc(spark, path)).count() == 0


# media


def test_png_round_trip():
    for payload in (b"", b"a", b" " * 192, bytes(range(256)) * 30):
        samples = media.padded(payload)
        image = media.to_png(samples)
        assert len(samples) % 192 == 0 and len(samples) > 0 and media.from_png(image) == samples
        with pytest.raises((ValueError, zlib.error)):
            media.from_png(image[:40] + b"\x00\x01" + image[42:])


def test_media_round_trip(spark):
    texts = [None, "", " ", "é" * 100, "x" * 300_000, "same", "same", "\x00\x01 text"]
    rows = [(i if i else None, t, "z") for i, t in enumerate(texts)]
    path = shared_dir(spark, "m")
    df = spark.createDataFrame(rows, "id long, text string, image string").selectExpr("id", "encode(coalesce(text, ''), 'UTF-8') AS payload", "image").repartition(3)
    media.write_media(df, path)
    got = {r.id: r for r in media.with_feature(media.read_media(spark, path)).collect()}
    for key, text, _ in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[key]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), None)
    assert (got[5].media_sha256, got[5].feature) == (got[6].media_sha256, got[6].feature)
    empty = shared_dir(spark, "m")
    media.write_media(df.limit(0), empty)
    assert media.read_media(spark, empty).count() == 0


def test_a_member_is_tried_again_alone():
    image = media.to_png(media.padded(b"hello"))
    entry = media.np.array([(1, 1, 10, len(image), 5, zlib.crc32(image))], media._ENTRY)[0]
    calls = []

    def flaky(uri, offset, length):
        calls.append((offset, length))
        if len(calls) == 1:
            raise OSError("lost")
        return image

    assert media.member("u", entry, b"damaged", flaky, 0)[1:] == (media.padded(b"hello"), None)
    assert calls == [(10, len(image))] * 2
    assert media.member("u", entry, None, lambda *_: b"", 0)[2] == "ValueError: checksum differs"
