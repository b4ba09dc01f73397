"""Archives written and read back."""

import base64
import hashlib
import io
import zlib

import pyarrow.fs
import pytest

from leakscan.llm import warc
from tests.llm.helpers import words


def pages(spark, rows):
    return spark.createDataFrame(rows, "key long, uri string, payload binary").repartition(3)


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


LONG = words(1, 60_000).encode()
ROWS = [
    (1, "http://a/é x", b"<html>one</html>"),
    (2, "http://a/2\r\nWARC-Type: metadata", None),
    (3, None, b""),
    (4, "http://a/4", LONG),
    (5, "http://a/5", b"\r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "http://a/6", b"<html>one</html>"),
    (7, "http://a/7", LONG),
    (7, "http://a/7", LONG),
    (9, "http://a/9", b"\x00\xff\x00"),
    (None, "http://a/none", b"<html>one</html>"),
]


@pytest.mark.parametrize("chunk,smallest", [(64 << 10, 0), (1000, 0), (64 << 10, 5)])
def test_round_trip(spark, chunk, smallest):
    options = warc.WarcOptions(chunk_bytes=chunk, archive_bytes=50_000, smallest_revisit=smallest, batch_bytes=10_000)
    archives = warc.write_archives(pages(spark, ROWS), warc.archive_folder(spark), options)
    assert sum(r["records"] for r in archives.collect()) == len(ROWS)
    chunks = [r.asDict() for r in warc.read_archives(spark, archives, options).withColumns({"key": warc.record_key("record_id"), "of": warc.record_key("refers_to")}).collect()]
    firsts = {}
    for key, _, payload in ROWS:
        payload = payload or b""
        if len(payload) >= smallest and key is not None:
            firsts[payload] = min(firsts.get(payload, key), key)
    for key, _, payload in {r[0]: r for r in ROWS}.values():
        payload = payload or b""
        own = sorted((c for c in chunks if c["key"] == key), key=lambda c: (c["chunk"], c["total_bytes"]))
        last = [c for c in own if c["last"]]
        first = firsts.get(payload, key)
        assert {(c["payload_bytes"], c["payload_digest"]) for c in last} == {(len(payload), sha(payload))}
        assert {c["record_type"] for c in own} == {"response" if key == first else "revisit"}
        assert {c["of"] for c in own} == {None if key == first else first}
        copies = len([r for r in ROWS if r[0] == key])
        if key == first:
            assert b"".join(c["data"] for c in own[::copies]) == payload
            assert len(own) == copies * max(1, -(-len(payload) // chunk)) and all(len(c["data"]) <= chunk for c in own)
            at = b""
            for c in own[::copies]:
                at += c["data"]
                assert (c["total_bytes"], c["total_sha1"]) == (len(at), sha(at))
        else:
            assert b"".join(c["data"] for c in own) == b""
    uris = {c["key"]: c["target_uri"] for c in chunks}
    assert uris[1] == "http://a/%C3%A9%20x" and "\r" not in uris[2] and uris[3] == "urn:record:3"


def test_empty_table(spark):
    archives = warc.write_archives(pages(spark, []), warc.archive_folder(spark))
    assert archives.count() == 0 and warc.read_archives(spark, archives).count() == 0


def records(*blocks):
    return b"".join(zlib.compress(b, wbits=31) for b in blocks)


def test_foreign_records():
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello"
    page = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:x:2>\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    found = list(warc.record_chunks(io.BytesIO(records(info, page)), warc.WarcOptions(chunk_bytes=3)))
    assert b"".join(c["data"] for c in found if c["record_id"] == "urn:x:1") == b"abcde"
    assert [c["data"] for c in found if c["record_id"] == "urn:x:2"] == [b"hel", b"lo"]
    assert found[-1]["payload_digest"] == sha(b"hello") and found[-1]["last"]


def test_damage_is_reported(spark):
    options = warc.WarcOptions()
    archives = warc.write_archives(pages(spark, ROWS[:1]), warc.archive_folder(spark), options)
    path = archives.first()["path"]
    filesystem, name = pyarrow.fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    with filesystem.open_input_stream(name, compression=None) as f:
        whole = f.read()
    plain = zlib.decompress(whole, 31)
    with pytest.raises(ValueError, match="digest"):
        list(warc.record_chunks(io.BytesIO(records(plain.replace(b"<html>one", b"<html>two"))), options))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.record_chunks(io.BytesIO(records(plain[:-20])), options))
