"""WARC archives with one Zstandard frame per record and a dictionary in a leading skippable frame.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed; each record is
one frame, compressed with the dictionary and carrying its content size. Between records stand empty skippable frames,
which every reader passes over: they are the separator of the writer that puts the bytes into the store.

Of records with equal payloads (same SHA-1 and length), the one with the largest id is a ``response``; the others are
``revisit`` records that hold the headers only and name the response.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siren.llm.files import read_binary, write_binary
from siren.llm.rows import slices
from siren.session import new_path

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame (0x184D2A50), as text.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: The dictionary is trained on so many of a file's first bytes.
DICTIONARY_BYTES = 64 * 1024
TRAINED_BYTES = 2_000_000
READ_BYTES = 32 * 1024
SALTS = 32
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """An archive that does not keep to the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    """A header value: control characters would break the header, so they are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, response: int | None) -> bytes:
    """One record: a response, or a revisit of the record ``response``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if response is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    head += [f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response"]
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if response is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{response}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header line: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _urn(value: str) -> int | None:
    if not value.startswith("<urn:page:") or not value.endswith(">"):
        raise WarcError(f"not a record id: {value[:80]!r}")
    return int(value[10:-1]) if value != "<urn:page:>" else None


def parse(raw: bytes) -> dict:
    """A record's fields; its lengths, headers and digest are checked."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not blank or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC header")
    fields = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise WarcError(f"no {name}")
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"the block has not the stated {length[:20]} bytes")
    http, blank, payload = rest[:-4].partition(b"\r\n\r\n")
    status, _, http_lines = http.partition(b"\r\n")
    if not blank or not status.startswith(b"HTTP/"):
        raise WarcError("no HTTP header")
    stated = _headers(http_lines).get("content-length", "")
    algorithm, _, sha1 = fields["warc-payload-digest"].partition(":")
    if algorithm != "sha1" or len(sha1) != 32 or not stated.isdigit():
        raise WarcError("no SHA-1 payload digest or payload length")
    kind = fields["warc-type"]
    refers_to = None
    if kind == "response":
        if len(payload) != int(stated) or digest(payload) != sha1:
            raise WarcError("the payload is not the stated one")
    elif kind == "revisit":
        if payload or fields.get("warc-profile") != PROFILE or "warc-refers-to" not in fields:
            raise WarcError("a revisit with a payload, or without profile or response")
        refers_to = _urn(fields["warc-refers-to"])
    else:
        raise WarcError(f"a record of type {kind[:40]!r}")
    return {
        "page_id": _urn(fields["warc-record-id"]), "payload_bytes": int(stated), "payload_digest": sha1,
        "record_type": kind, "refers_to": refers_to, "url": fields.get("warc-target-uri"), "payload": payload,
    }


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressionDict]:
    """The leading skippable frame and its dictionary; where too little is there to train one, the samples serve."""
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        trained = zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n")
    body = zstandard.compress(trained.as_bytes(), 9)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body, trained


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of a file: the dictionary from its leading skippable frame, then one record per frame."""
    magic, size = struct.unpack_from("<II", content) if len(content) >= 8 else (0, 0)
    if magic != DICTIONARY_MAGIC or 8 + size > len(content):
        raise WarcError("no dictionary in a leading skippable frame")
    dictionary = zstandard.ZstdCompressionDict(zstandard.decompress(content[8 : 8 + size]))
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    view, at = memoryview(content), 8 + size
    while at < len(content):
        if at + 8 > len(content):
            raise WarcError("the file ends within a frame")
        magic, size = struct.unpack_from("<II", content, at)
        if magic in SKIPPABLE:
            at += 8 + size
            if at > len(content):
                raise WarcError("the file ends within a skippable frame")
            continue
        if magic != FRAME_MAGIC:
            raise WarcError("no frame where one should begin")
        stated = zstandard.frame_content_size(view[at : at + 18])
        frame, raw = decompressor.decompressobj(), b""
        while not frame.eof and at < len(content):
            piece = view[at : at + READ_BYTES]
            raw += frame.decompress(piece)
            at += len(piece) - len(frame.unused_data)
        if not frame.eof or stated != len(raw):
            raise WarcError("a frame is cut off or has not its stated length")
        yield parse(raw)


def _judged(pages: DataFrame, least_bytes: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Each row with its payload, its digest and, for a revisit, the id of the response."""
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumns({"_sha1": F.unhex(F.sha1("payload")), "_bytes": F.length("payload").cast("long")})
    groups = rows.where(F.col("_bytes") >= least_bytes).groupBy("_sha1", "_bytes")
    shared = groups.agg(F.max("page_id").alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    shared = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    revisits = F.col("_best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_best"))
    return salted.join(shared, ["_sha1", "_bytes", "_salt"], "left").select(
        "page_id", "url", "payload", F.col("_sha1").alias("sha1"), F.when(revisits, F.col("_best")).alias("response")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    least_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> None:
    """One record per row, in one file per partition.

    Payloads are in UTF-8, NULL counts as empty. Of equal payloads of at least ``least_bytes`` those with the largest
    id are responses, the others revisit that id. NULL ids are smallest; where all are NULL, all stay responses. Rows
    that repeat the largest id are all responses. No rows, no files.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["content"])

        def compressed(records: list[bytes]) -> pa.RecordBatch:
            return out([compressor.compress(r) for r in records])

        compressor, held, size = None, [], 0
        for batch in batches:
            for part in slices(batch, "payload", 8_000_000):
                columns = [part.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "response")]
                for page_id, url, payload, sha1, response in zip(*columns, strict=True):
                    name = base64.b32encode(sha1).decode()
                    held.append(record(page_id, url, payload, name, response))
                    size += len(held[-1])
                if compressor is None and size >= TRAINED_BYTES:
                    frame, dictionary = dictionary_frame([r[:TRAINED_BYTES] for r in held])
                    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
                    yield out([frame])
                if compressor is not None:
                    yield compressed(held)
                    held = []
        if compressor is None and held:
            frame, dictionary = dictionary_frame(held)
            compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
            yield out([frame])
        if held:
            yield compressed(held)

    judged = _judged(pages, least_bytes, id_col, url_col, payload_col)
    write_binary(judged.mapInArrow(frames, "content binary"), "content", path, separator=SEPARATOR)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all files: what the headers say, after every check. A broken file is an error."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[list] = []
                for found in read_archive(content.as_py()):
                    rows.append([found[n] for n in names])
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return read_binary(spark, path).select("content").mapInArrow(records, PAGES)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
