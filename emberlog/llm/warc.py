"""WARC archives in Zstandard: one frame a record, and the dictionary in a leading skippable frame.

The reader takes the dictionary from the archive's first frame, decodes each further frame as one
record and checks its version, mandatory fields, lengths and digests. A frame or record that fails is a
row with an ``error`` (or stops the job, where ``strict``); the frames after it are read where its
end can be told.

Archives are written by Spark's own text writer, so that tasks commit their files and lost ones leave
nothing: a row is a frame, and what the writer puts after each row is an empty skippable frame,
which every decoder passes over.

Defined cases: a null html is an empty payload; a null url gives way to the record's id; of records with
equal payloads of at least ``least_bytes`` the one with the greatest page_id is the response (null ids
only where there is no other; of rows that repeat an id, one); smaller payloads are never revisits;
payloads of any length are one frame; an empty table gives no archive and no records; columns other than
page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small_or_shuffled, stored

# Fixed values of the formats.
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x5d\x2a\x4d\x18"
SKIPPABLE = [bytes([0x50 + k]) + b"\x2a\x4d\x18" for k in range(16)]
#: An empty skippable frame; it is what the text writer puts after each row.
EMPTY_FRAME = "\x50\x2a\x4d\x18\0\0\0\0"
VERSIONS = ("WARC/1.0", "WARC/1.1")
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes that are fed to the decoder at once, and payload bytes of a batch of records.
FEED, BATCH = 1 << 16, 1 << 24

RECORDS = (
    "archive string, place long, frame_bytes long, type string, record_id string, date string, target_uri string, refers_to string, "
    "headers map<string,string>, http_headers map<string,string>, payload binary, payload_bytes long, payload_digest string, error string"
)


class BadRecord(ValueError):
    """A record or frame that does not hold what it says."""


# ---- writing


def record_id(page_id: Column, row: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"))


def records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """One row per page: record_id, uri, payload, digest, bytes, refers_to and refers_uri (null but for revisits).

    Digests are grouped, which pre-aggregates copies; only pages that are revisits are joined back, by
    row, and they carry no payload.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", payload.alias("payload"))
    rows = stored(rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes")), "warc-rows")
    rows = rows.withColumn("record_id", record_id(F.col("page_id"), F.col("row"))).withColumn("uri", F.coalesce("url", "record_id"))
    large = rows.where(F.col("bytes") >= least_bytes)
    groups = large.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "row", "record_id", "uri")).alias("first"))
    groups = stored(groups.where("n > 1").select(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), "first"), "warc-groups")
    same = (F.col("digest") == F.col("_digest")) & (F.col("bytes") == F.col("_bytes"))
    copies = large.select("row", "digest", "bytes").join(small_or_shuffled(groups, groups.count(), 100_000), same).where(F.col("row") != F.col("first.row"))
    copies = stored(copies.select(F.col("row").alias("_row"), F.col("first.record_id").alias("refers_to"), F.col("first.uri").alias("refers_uri")), "warc-revisits")
    rows = rows.join(small_or_shuffled(copies, copies.count(), 100_000), F.col("row") == F.col("_row"), "left")
    return rows.select("record_id", "uri", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "bytes", "refers_to", "refers_uri")


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _plain(uri: str) -> str:
    """A URI without characters that would end a header line."""
    return quote(uri, safe="!#$%&'()*+,/:;=?@[]~^|{}\"<>\\`-._")


def one_record(record_id: str, uri: str, payload: bytes | None, digest: str, size: int, refers_to: str | None, refers_uri: str | None, date: str) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": _plain(uri)}
    if refers_to is None:
        block += payload or b""
    else:
        fields |= {"WARC-Profile": IDENTICAL_PAYLOAD, "WARC-Refers-To": f"<{refers_to}>", "WARC-Refers-To-Target-URI": _plain(refers_uri or ""), "WARC-Refers-To-Date": date}
    fields |= {"WARC-Payload-Digest": _base32(digest), "WARC-Block-Digest": _base32(hashlib.sha1(block).hexdigest())}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def train_dictionary(rows: DataFrame, size: int = 1 << 16, sample: int = 512, most_bytes: int = 1 << 15) -> bytes | None:
    """A dictionary of about ``sample`` (never over twice as many) whole payloads of at most ``most_bytes``; none if they are too few."""
    fit = rows.where("payload is not null and bytes between 1 and " + str(most_bytes))
    share = min(1.0, sample / max(fit.count(), 1))
    drawn = fit.where(F.pmod(F.xxhash64("record_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("payload").limit(2 * sample).collect()
    try:
        return zstandard.train_dictionary(size, [bytes(r.payload) for r in drawn]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame that leads an archive: the dictionary, itself compressed."""
    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return DICTIONARY + len(body).to_bytes(4, "little") + body


def _compressor(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_archives(rows: DataFrame, path: str, dictionary: bytes | None = None, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 1 << 26) -> None:
    """Writes ``rows`` (as ``records`` gives them) below ``path``: an archive for each ``archive_bytes`` of a task's payloads.

    The dictionary (bounded by ``train_dictionary``) is broadcast.
    """
    shared = rows.sparkSession.sparkContext.broadcast(dictionary)

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, archive, place, filled = _compressor(shared.value), 0, 0, archive_bytes
        for pdf in batches:
            out: list[tuple[int, int, bytes]] = []
            for r in pdf.itertuples(index=False):
                if filled >= archive_bytes:
                    archive, place, filled = archive + 1, 0, 0
                    if shared.value:
                        out.append((archive, place, dictionary_frame(shared.value)))
                record = one_record(r.record_id, r.uri, r.payload, r.digest, r.bytes, r.refers_to, r.refers_uri, date)
                place, filled = place + 1, filled + len(record)
                out.append((archive, place, made.compress(record)))
            yield pd.DataFrame(out, columns=["archive", "place", "frame"])

    cut = rows.mapInPandas(frames, "archive int, place long, frame binary").sortWithinPartitions("archive", "place")
    cut.select("archive", F.col("frame").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", EMPTY_FRAME).text(path)


# ---- reading


def frames_of(content) -> Iterator[tuple[int, int, bytes | None, bytes | BadRecord]]:
    """(offset, length, magic, content or failure) of each frame; content is decoded but for skippable frames.

    A frame whose end cannot be told ends the archive.
    """
    view, at, dictionary = memoryview(content), 0, None
    while at < len(view):
        magic = bytes(view[at : at + 4])
        if magic in SKIPPABLE:
            end = at + 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            if len(view) < at + 8 or end > len(view):
                yield at, len(view) - at, magic, BadRecord("truncated skippable frame")
                return
            if magic == DICTIONARY:
                try:
                    if at:
                        raise BadRecord("dictionary frame that does not lead the archive")
                    body = bytes(view[8:end])
                    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body) if body[:4] == FRAME else body)
                except (zstandard.ZstdError, BadRecord) as e:
                    yield at, end - at, magic, BadRecord(f"dictionary: {e}")
            at = end
            continue
        if magic != FRAME:
            yield at, len(view) - at, magic, BadRecord("no frame where one should begin")
            return
        reader, parts, end, failed = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), [], at, None
        try:
            while not reader.eof and end < len(view):
                fed = view[end : end + FEED]
                parts.append(reader.decompress(fed))
                end += len(fed) - len(reader.unused_data)
        except zstandard.ZstdError as e:
            failed = BadRecord(f"frame: {e}")
        if failed is None and not reader.eof:
            failed = BadRecord("truncated frame")
        if failed is not None:
            yield at, len(view) - at, magic, failed
            return
        yield at, end - at, magic, b"".join(parts)
        at = end


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    """The first line and the fields of a header; lines that begin with white space go on the one before."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    out, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadRecord(f"bad field {line[:40]!r}")
        out[name] = value.strip()
    return first, out


def _get(fields: dict[str, str], name: str) -> str | None:
    return next((v for k, v in fields.items() if k.lower() == name.lower()), None)


def _length(fields: dict[str, str], what: str) -> int | None:
    value = _get(fields, "Content-Length")
    if value is not None and not (value.isascii() and value.isdigit()):
        raise BadRecord(f"{what} length {value[:20]!r} is no number")
    return None if value is None else int(value)


def _check_digest(told: str | None, data: bytes, what: str) -> None:
    if told and told.lower().startswith("sha1:") and hex_digest(told) != hashlib.sha1(data).hexdigest():
        raise BadRecord(f"{what} digest differs")


def hex_digest(told: str) -> str:
    """The hexadecimal SHA-1 of 'sha1:' and 40 hexadecimal or 32 base-32 characters."""
    value = told.partition(":")[2].strip()
    try:
        return (bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())).hex()
    except ValueError as e:
        raise BadRecord(f"digest {told[:40]!r} cannot be read") from e


def _bare(value: str | None) -> str | None:
    return value and value.removeprefix("<").removesuffix(">")


def parse_record(data: bytes) -> dict:
    """One record of a frame, checked: version, mandatory fields, lengths, digests, nothing before or after it."""
    cut = data.find(b"\r\n\r\n")
    if cut < 0:
        raise BadRecord("header without end")
    version, fields = _fields(data[:cut])
    if version not in VERSIONS:
        raise BadRecord(f"unknown version {version[:20]!r}")
    missing = [m for m in MANDATORY if _get(fields, m) is None]
    if missing:
        raise BadRecord(f"without {', '.join(missing)}")
    size = _length(fields, "block")
    block, rest = data[cut + 4 : cut + 4 + size], data[cut + 4 + size :]
    if len(block) != size or rest != b"\r\n\r\n":
        raise BadRecord(f"block of {size} bytes does not end the frame")
    _check_digest(_get(fields, "WARC-Block-Digest"), block, "block")
    kind, told = _get(fields, "WARC-Type"), _get(fields, "WARC-Payload-Digest")
    http, payload = {}, block
    if (_get(fields, "Content-Type") or "").startswith("application/http"):
        end = block.find(b"\r\n\r\n")
        if end < 0:
            raise BadRecord("HTTP header without end")
        _, http = _fields(block[:end])
        payload = block[end + 4 :]
    of = _length(http, "payload")
    out = {
        "type": kind, "record_id": _bare(_get(fields, "WARC-Record-ID")), "date": _get(fields, "WARC-Date"), "target_uri": _get(fields, "WARC-Target-URI"),
        "refers_to": _bare(_get(fields, "WARC-Refers-To")), "headers": list(fields.items()), "http_headers": list(http.items()),
    }
    if kind == "revisit":
        if payload:
            raise BadRecord("revisit with a payload")
        if out["refers_to"] is None or told is None:
            raise BadRecord("revisit that does not say of what")
        return out | {"payload": None, "payload_bytes": of, "payload_digest": hex_digest(told)}
    if of is not None and of != len(payload):
        raise BadRecord(f"payload of {len(payload)} bytes, not {of}")
    _check_digest(told, payload, "payload")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}


def read_archives(spark: SparkSession, path: str, strict: bool = True, payloads: bool = True) -> DataFrame:
    """One row per record (``RECORDS``), and one per frame that is none, with ``error``, unless ``strict``.

    ``payloads`` False leaves the payloads out once they are checked. An archive is read by one task, so
    writers bound its size (``archive_bytes``).
    """
    text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
    kinds = {"string": text, "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pairs}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                out, held, archive = [], 0, archive.as_py()
                for place, length, _, data in frames_of(content.as_buffer()):
                    row = {"archive": archive, "place": place, "frame_bytes": length}
                    try:
                        if isinstance(data, BadRecord):
                            raise data
                        row |= parse_record(data)
                        held += len(row["payload"] or b"") if payloads else 200
                        row["payload"] = row["payload"] if payloads else None
                    except BadRecord as e:
                        if strict:
                            raise ValueError(f"{archive} at byte {place}: {e}") from e
                        row["error"] = str(e)
                    out.append(row)
                    if held >= BATCH:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def page_of(urn: str) -> Column:
    """The page_id in a record's id."""
    return F.regexp_extract(urn, r"^urn:page:(-?\d*):", 1).try_cast("long")


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Writes the archives of ``pages`` to the shared folder and reads them: one row per page."""
    spark = pages.sparkSession
    rows = records(pages, least_bytes)
    path = new_path(spark, "warc")
    write_archives(rows, path, train_dictionary(rows))
    read = read_archives(spark, path, payloads=False)
    return read.select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of("refers_to").alias("refers_to"),
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, row_number() OVER () AS place FROM pages
), g AS (
  SELECT page_id, h, strlen(h) AS n, place, first_value(place) OVER w AS first_place, first_value(page_id) OVER w AS first_id
  FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST, place)
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n < 1000 OR place = first_place THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n >= 1000 AND place <> first_place THEN first_id END AS refers_to
FROM g
"""
