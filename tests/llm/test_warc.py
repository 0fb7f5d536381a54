"""Archives: exact round trips, revisits, and every kind of broken file."""

import base64
import hashlib
import struct
from collections import Counter

import pytest
import zstandard

from siren.llm import warc
from siren.llm.files import read_binary
from siren.llm.warc import WarcError, archived, dictionary_frame, parse, read_archive, read_archives, record, write_archives

PAGES = [
    (1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (9, None, "<p>same</p>"), (4, "u\r\nX: y", "<p>é \r\n\r\n</p>"),
    (5, "", None), (6, "http://c", ""), (7, "http://d", "x" * 300_000), (None, "http://e", "<p>same</p>"),
    (None, "http://f", "alone"), (8, "http://g", "twice"), (8, "http://g", "twice"), (3, "http://h", "twice"),
]


def table(spark, rows):
    return spark.createDataFrame([(*row, b"?", "z") for row in rows], "page_id long, url string, html string, payload binary, sha1 string")


def expected(rows, least):
    best = {}
    for page_id, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if page_id is None else page_id)
    out = Counter()
    for page_id, _, html in rows:
        payload = (html or "").encode()
        revisit = len(payload) >= least and best[html or ""] >= 0 and page_id != best[html or ""]
        sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out[page_id, len(payload), sha1, "revisit" if revisit else "response", best[html or ""] if revisit else None] += 1
    return out


@pytest.mark.parametrize("least", [0, 6])
def test_archived(spark, least):
    rows = archived(table(spark, PAGES).repartition(3), least).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected(PAGES, least)


def test_no_pages(spark):
    assert archived(table(spark, [])).count() == 0


def test_files_are_plain_zstd(spark, tmp_path, monkeypatch):
    """Any reader that knows the dictionary reads the frames one after the other."""
    monkeypatch.setattr(warc, "TRAINED_BYTES", 2_000)
    pages = [(k, f"http://x/{k}", f"<html><body>page {k} of many similar pages</body></html>" * 5) for k in range(300)]
    write_archives(table(spark, pages).coalesce(1), str(tmp_path / "w"))
    (content,) = [bytes(r.content) for r in read_binary(spark, str(tmp_path / "w")).collect()]
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(zstandard.decompress(content[8 : 8 + size]))
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(content[8 + size :], read_across_frames=True)
    assert reader.read().count(b"WARC/1.1\r\n") == 300
    assert read_archives(spark, str(tmp_path / "w")).count() == 300
    assert sorted(f["page_id"] for f in read_archive(content)) == list(range(300))


def archive(records):
    frame, dictionary = dictionary_frame(records)
    compressor = zstandard.ZstdCompressor(dict_data=dictionary)
    return frame + b"".join(compressor.compress(r) + warc.SEPARATOR.encode() for r in records)


def test_round_trip_and_broken_files():
    payload = b"<p>\r\n\r\n</p>"
    records = [record(1, "http://a", payload, warc.digest(payload), None), record(None, None, payload, warc.digest(payload), 1)]
    whole = archive(records)
    one, two = read_archive(whole)
    assert (one["page_id"], one["payload"], one["url"], one["record_type"]) == (1, payload, "http://a", "response")
    assert (two["page_id"], two["payload"], two["refers_to"], two["payload_bytes"]) == (None, b"", 1, len(payload))
    for broken in (whole[8:], whole[:-1], whole[:-12], whole[:30], b"", whole + b"zz", whole + b"zzzzzzzzz"):
        with pytest.raises((WarcError, zstandard.ZstdError)):
            list(read_archive(broken))


@pytest.mark.parametrize(
    ("old", "new"),
    [
        (b"WARC/1.1", b"WARX/1.1"), (b"WARC-Date: ", b"WARC-Dat: "), (b"WARC-Type: response", b"WARC-Type: other"),
        (b"<urn:page:1>", b"urn:page:1"), (b"sha1:", b"md5:"), (b"payload", b"Payload"), (b"HTTP/1.1 200", b"HTTX/1.1 200"),
        (b"Content-Length: 7\r\n", b"Content-Length: 8\r\n"), (b"\r\nWARC-Date:", b"\r\nno colon\r\nWARC-Date:"),
    ],
)
def test_invalid_records(old, new):
    raw = record(1, "http://a", b"payload", warc.digest(b"payload"), None)
    assert parse(raw)["payload"] == b"payload" and old in raw
    with pytest.raises(ValueError):
        parse(raw.replace(old, new, 1))


def test_revisit_needs_profile_and_no_payload():
    raw = record(1, None, b"payload", warc.digest(b"payload"), 2)
    with pytest.raises(WarcError):
        parse(raw.replace(b"WARC-Profile", b"WARC-Other"))
    length = int(raw.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0])
    longer = raw.replace(b"Content-Length: %d\r\n" % length, b"Content-Length: %d\r\n" % (length + 1), 1)
    with pytest.raises(WarcError):
        parse(longer[:-4] + b"x\r\n\r\n")
