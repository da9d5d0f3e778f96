"""WARC archives whose records are Zstandard frames under one dictionary.

Pages are dealt into archives by a hash. Each archive is one file in the shared
folder: a leading skippable frame that holds the dictionary, built from the
archive's own records, then one Zstandard frame per record, compressed with it.
Any record can be read alone, by its offset.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with the
smallest ``page_id`` is a response, the others are revisits that name it and
hold no payload; smaller payloads are always responses. Payload is the html in
UTF-8, null as empty.

A task writes a file of its own name and renames it, so a repeated or lost
attempt leaves the archive whole. The folder must be one that Python can write
to on every executor (a shared mount, ``file:``).
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm import common as C

MIN_REVISIT = 100
ARCHIVE_BYTES = 8_000_000  # payload per archive, on average
SAMPLE_BYTES, DICT_BYTES, LEVEL = 2_000_000, 112_640, 5
# fixed values: skippable frame that holds a dictionary, revisit profile, the one date of these records
DICT_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _line(value) -> str:
    """A header value: no line breaks."""
    return re.sub(r"[\r\n]+", " ", "" if value is None else str(value))


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{_line(page_id)}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on the records up to SAMPLE_BYTES; too few to train on serve as they are."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r[:SAMPLE_BYTES])
        size += len(sample[-1])
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, size // 10)), sample, k=256, d=8)
    except zstandard.ZstdError:
        raw = b"".join(sample)[:DICT_BYTES]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if raw else None


def archive(records: list[bytes]) -> bytes:
    """The file: dictionary frame, then a frame per record."""
    made = dictionary(records)
    out = []
    if made is not None:
        raw = made.as_bytes()
        out.append(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=made)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def read_records(data: bytes):
    """(headers, body) of each record of an archive."""
    made, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8:8 + size]
        trained = raw[:4] == b"\x37\xa4\x30\xec"
        made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO if trained else zstandard.DICT_TYPE_RAWCONTENT)
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=made)
    view = memoryview(data)
    while at < len(data):
        frame = reader.decompressobj()
        raw = frame.decompress(view[at:])
        at = len(data) - len(frame.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        yield fields, rest[:int(fields["Content-Length"])]


def _local(folder: str) -> str:
    parts = urlsplit(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"archives are written through a mounted folder; {folder} is not one")
    return unquote(parts.path)


def _writer(folder: str):
    def write(pages: pa.Table, refs: pa.Table) -> pa.Table:
        n = pages["g"][0].as_py() if len(pages) else refs["g"][0].as_py()
        to = {(p, d): r for p, d, r in zip(refs["page_id"].to_pylist(), refs["digest"].to_pylist(), refs["refers_to"].to_pylist())}
        pages = pages.sort_by([("page_id", "ascending"), ("html", "ascending")])
        records = []
        for p, url, html in zip(pages["page_id"].to_pylist(), pages["url"].to_pylist(), pages["html"]):
            payload = html.as_buffer().to_pybytes() if html.is_valid else b""
            digest = hashlib.sha256(payload).hexdigest()
            records.append(_record(p, url, payload, digest, to.get((p, digest))))
        data = archive(records)
        path = os.path.join(_local(folder), f"part-{n:06d}.warc.zst")
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return pa.table({"archive": pa.array([os.path.basename(path)]), "records": pa.array([len(records)], pa.int64()),
                         "bytes": pa.array([len(data)], pa.int64())})
    return write


def revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the pages (page_id, payload) that revisit another."""
    slim = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n")).where(
        F.col("page_id").isNotNull() & (F.col("n") >= MIN_REVISIT))
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    return slim.join(C.keep(first), "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to")


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives into ``folder``; a row per archive."""
    C.prepare(pages.sparkSession)
    os.makedirs(_local(folder), exist_ok=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    n = C.n_parts(C.total_bytes(rows, "html"), archive_bytes)
    refs = C.grouped(C.keep(revisits(rows.select("page_id", payload.alias("payload")))), n, "page_id")
    return C.keep(C.grouped(rows, n, "page_id").groupBy("g").cogroup(refs.groupBy("g")).applyInArrow(
        _writer(folder), "archive string, records long, bytes long"))


def _parse(batches):
    for b in batches:
        for content in b.column("content"):
            rows = []
            for head, body in read_records(content.as_buffer().to_pybytes()):
                page = re.match(r"<urn:page:(-?\d+)>", head["WARC-Record-ID"])
                to = re.match(r"<urn:page:(-?\d+)>", head.get("WARC-Refers-To", ""))
                whole = head["WARC-Type"] == "response"
                rows.append((int(page[1]) if page else None, head["WARC-Target-URI"], head["WARC-Type"], int(to[1]) if to else None,
                             len(body) if whole else int(head["X-Payload-Length"]),
                             hashlib.sha256(body).hexdigest() if whole else head["WARC-Payload-Digest"].removeprefix("sha256:"), body if whole else None))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_READ)


_READ = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]


def read(spark, folder: str) -> DataFrame:
    """The records of all archives in ``folder``; size and digest of a response are taken from its payload as read."""
    C.prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("content")
    return files.mapInArrow(_parse, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """``pages`` written as dictionary-compressed WARC archives and read back."""
    folder = f"{C.prepare(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(C.table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {"op6_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN octet_length(body) >= {MIN_REVISIT} AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(body) >= {MIN_REVISIT} AND page_id > first_id THEN first_id END AS refers_to FROM q"""}
