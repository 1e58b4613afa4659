"""Zstandard WARC archives: exact round trips, and archives that are broken."""

import hashlib
import random

import pytest
import zstandard

from emberlog.llm import warc
from emberlog.storage import new_path

PAGES = "page_id long, url string, html string, digest string, row long"
BIG = "x" * 998 + "é"  # 1000 bytes


def pages_rows():
    rnd = random.Random(4)
    rows = [(i, f"http://h/{i}", "<p>" + " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(300)) + f"{i}</p>", "x", 1) for i in range(40)]
    rows += [(100 + i, "http://copy/", BIG, None, None) for i in range(7)] + [(106, "http://again/", BIG, None, None)]
    rows += [(200 + i, "http://small/", "y" * 999, None, None) for i in range(3)]
    rows += [(300, None, None, None, None), (301, "a\r\nWARC-Type: metadata b", "", None, None), (None, "n", BIG, None, None), (-5, "m", "z" * 3_000_000, None, None), (None, "n", "q" * 2000, None, None), (None, "n", "q" * 2000, None, None)]
    return rows


def expected(rows):
    best, out = {}, []
    for k, (i, _, html, *_rest) in enumerate(rows):
        if len((html or "").encode()) >= 1000:
            best[html] = max(best.get(html, (float("-inf"), float("-inf"))), (float("-inf") if i is None else i, -k))
    for k, (i, _, html, *_rest) in enumerate(rows):
        data = (html or "").encode()
        first = best.get(html) if len(data) >= 1000 else None
        revisit = first is not None and first[1] != -k
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first[0] if revisit and first[0] > float("-inf") else None))
    return sorted(out, key=repr)


def test_round_trip_equals_brute_force(spark):
    rows = pages_rows()
    got = warc.round_trip(spark.createDataFrame(rows, PAGES))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("trained", [True, False])
def test_archives_hold_every_payload_and_are_plain_zstandard(spark, trained):
    rows = warc.records(spark.createDataFrame(pages_rows(), PAGES).repartition(2))
    dictionary = warc.train_dictionary(rows, size=2048) if trained else None
    assert (dictionary is not None) == trained
    path = new_path(spark, "warc")
    warc.write_archives(rows, path, dictionary, archive_bytes=20_000)
    read = warc.read_archives(spark, path).collect()
    payloads = sorted(bytes(r.payload).decode() for r in read if r.type == "response")
    once = [h for _, _, h, *_ in pages_rows() if h not in (BIG, "q" * 2000)] + [BIG, "q" * 2000]  # others revisit these
    assert payloads == sorted(h or "" for h in once)
    assert {r.target_uri for r in read} >= {"a%0D%0AWARC-Type:%20metadata%20b", "http://copy/", "n"}
    assert all(r.headers["WARC-Refers-To-Target-URI"] == "http://again/" or r.refers_to.startswith(("urn:page:106:", "urn:page::")) for r in read if r.type == "revisit")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()
    assert len(files) > 2  # archives are bounded
    for f in files:
        content, made = bytes(f.content), None
        assert (content[:4] == warc.DICTIONARY) == trained
        if trained:
            size = int.from_bytes(content[4:8], "little")
            made = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8 : 8 + size]))
            content = content[8 + size :]
        plain = zstandard.ZstdDecompressor(dict_data=made).stream_reader(content, read_across_frames=True).read()
        assert plain.count(b"WARC/1.1\r\n") == sum(r.archive == f.path for r in read)


def record(**change):
    payload = change.pop("payload", b"<p>hello</p>")
    out = warc.one_record("urn:page:1:0", "http://h/", payload, hashlib.sha1(payload).hexdigest(), len(payload), change.pop("refers_to", None), None, "2020-01-01T00:00:00Z")
    for old, new in change.pop("swap", []):
        assert old in out
        out = out.replace(old, new)
    return out


def frame(data, dictionary=None):
    return warc._compressor(dictionary).compress(data)


def errors(content):
    out = []
    for _, _, _, data in warc.frames_of(content):
        try:
            if isinstance(data, warc.BadRecord):
                raise data
            warc.parse_record(data)
            out.append(None)
        except warc.BadRecord as e:
            out.append(str(e))
    return out


@pytest.mark.parametrize(
    "swap, says",
    [
        ([(b"WARC/1.1", b"WARC/9.9")], "version"),
        ([(b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b"")], "without WARC-Date"),
        ([(b"Content-Length: 12\r\n", b"Content-Length: 13\r\n")], "block digest"),
        ([(b"hello", b"hallo")], "block digest"),
        ([(b"\r\n\r\n<p>hello</p>\r\n\r\n", b"\r\n\r\n<p>hello</p>\r\n\r\nmore")], "does not end"),
        ([(b"Content-Length: 12\r\n", b"Content-Length: +2\r\n")], "block digest"),
        ([(b"WARC-Type: response", b"WARC-Type response")], "bad field"),
        ([(b"WARC-Block-Digest", b"X-Digest"), (b"Content-Length: 12\r\n", b"Content-Length: 11\r\n")], "payload of 12 bytes"),
        ([(b"WARC-Block-Digest", b"X-Digest"), (b"hello", b"hallo")], "payload digest"),
        ([(b"WARC-Type: response", b"WARC-Type: revisit")], "revisit with a payload"),
    ],
)
def test_records_that_lie_are_found(swap, says):
    assert [e is not None and says in e for e in errors(frame(record(swap=swap)) + frame(record()))] == [True, False]


def test_archives_that_are_broken():
    good = frame(record())
    for whole in (b"", warc.EMPTY_FRAME.encode(), good + good, warc.EMPTY_FRAME.encode() + good):
        assert not any(errors(whole))
    assert errors(good + good[: len(good) // 2]) == [None, "truncated frame"]
    assert errors(good + b"plain text")[1].startswith("no frame")
    assert errors(good + warc.DICTIONARY + b"\xff\0\0\0abc")[1].startswith("truncated skippable")
    assert "does not lead" in errors(good + warc.dictionary_frame(b"abc" * 99) + good)[1]
    spoilt = bytearray(good)
    spoilt[len(spoilt) // 2] ^= 0xFF
    assert errors(bytes(spoilt) + good)[0] is not None
    raw = bytes(range(256)) * 8  # a dictionary that is not compressed itself, and a frame that needs it
    lead = warc.DICTIONARY + len(raw).to_bytes(4, "little") + raw
    assert errors(lead + frame(record(payload=raw[:1500]), raw)) == [None]


def test_strict_reading_stops_and_other_reading_tells(spark):
    path = new_path(spark, "warc")
    rows = warc.records(spark.createDataFrame(pages_rows()[:3], PAGES).coalesce(1)).selectExpr("record_id", "uri", "payload", "repeat('0', 40) AS digest", "bytes", "refers_to", "refers_uri")
    warc.write_archives(rows, path)
    assert [r.error for r in warc.read_archives(spark, path, strict=False).collect()] == ["payload digest differs"] * 3
    with pytest.raises(Exception, match="payload digest differs"):
        warc.read_archives(spark, path).collect()


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
