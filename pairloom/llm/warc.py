"""Zstandard-compressed WARC archives with a shared dictionary.

An archive begins with a skippable frame that holds the dictionary; after it,
each record is one zstd frame of its own.  Archives are rows (archive, content)
so that they live in whatever store Spark writes to; ``spark.read.format
("binaryFile")`` gives the same columns for archives kept as files.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import cut, table

#: Magic number of the skippable frame that holds a dictionary; fixed by the format.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: Payload bytes from which equal payloads are revisits.
LEAST_REVISIT = 100
ARCHIVES = "archive string, content binary"
RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2026-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {''.join(c if c >= ' ' else ' ' for c in url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes], dictionary_bytes: int = 16_384, level: int = 3) -> bytes:
    """One archive: the dictionary's frame, then a frame for each record."""
    raw = _dictionary(records, dictionary_bytes)
    out = [struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw]
    known = zstandard.ZstdCompressionDict(raw) if raw else None
    pen = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
    return b"".join([*out, *map(pen.compress, records)])


def _dictionary(records: list[bytes], size: int, sample: int = 200, each: int = 4096) -> bytes:
    """Trained on at most ``sample`` records, evenly spread, of at most ``each`` bytes; the first record's head if they are too few to train on."""
    step = max(1, len(records) // sample)
    samples = [r[:each] for r in records[::step]][:sample]
    if len(samples) >= 20:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass  # samples too alike or too small: plain content serves
    return samples[0][: size // 4] if samples and len(samples[0]) >= 8 else b""


def unpack(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one for each frame; anything else is an error."""
    at, known = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", content, 4)[0]
        raw, at = content[8 : 8 + size], 8 + size
        if len(raw) != size:
            raise ValueError("the dictionary's frame is cut short")
        if raw[:4] == FRAME_MAGIC:  # the format allows a compressed dictionary
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known = zstandard.ZstdCompressionDict(raw) if raw else None
    view = memoryview(content)
    while at < len(content):
        if content[at : at + 4] != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        reader = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        parts, here = [], at
        while not reader.eof:
            if here >= len(content):
                raise ValueError("the last frame is cut short")
            parts.append(reader.decompress(view[here : here + 65_536]))
            here = min(here + 65_536, len(content))
        at = here - len(reader.unused_data)
        yield b"".join(parts)


#: Records that archives have besides pages; fixed by the format.
OTHER_TYPES = ("warcinfo", "request", "metadata", "resource", "conversion", "continuation")


def parse(record: bytes) -> dict | None:
    """The fields of a response or revisit record, None for one of OTHER_TYPES; headers, lengths and digest are validated.

    Anything that is not as it should be is a ValueError.
    """
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip() or name.lower() in fields:
            raise ValueError(f"bad header line {line[:60]!r}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"header without {', '.join(sorted(missing))}")
    if not fields["content-length"].isdecimal():
        raise ValueError("Content-Length is no number")
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n" or len(rest) != length + 4:
        raise ValueError("Content-Length is not the block's")
    kind = fields["warc-type"]
    if kind in OTHER_TYPES:
        return None
    if kind not in ("response", "revisit"):
        raise ValueError(f"unknown record type {kind[:60]!r}")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    lengths = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if len(lengths) != 1 or not lengths[0].isdigit():
        raise ValueError("the HTTP head has no length of the payload")
    if "warc-payload-digest" not in fields:
        raise ValueError("header without warc-payload-digest")
    sizes, digest = [int(lengths[0])], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (sizes != [len(payload)] or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload is not the one that was digested")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields or fields.get("warc-profile") != PROFILE):
        raise ValueError("a revisit has a payload or no response")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "record_type": kind,
        "payload_bytes": sizes[0],
        "payload_digest": digest,
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
        "url": fields.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
    }


def _page(urn: str) -> int | None:
    text = urn.strip("<>")
    number = text.removeprefix("urn:page:")
    if number == text or (number and not number.removeprefix("-").isdecimal()):
        raise ValueError(f"the id names no page: {text[:60]!r}")
    return int(number) if number else None


def write_archives(pages: DataFrame, archive_bytes: int = 8_000_000, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives (archive, content) with a record for every row of ``pages``; each holds about ``archive_bytes`` of records.

    Of rows with equal payloads of at least LEAST_REVISIT bytes, those with the
    smallest key are responses and the others revisit it.  Null html is an
    empty payload; a null key is a response of its own; rows that repeat the
    smallest key are responses too.  Payloads meet by digest, one row for each
    digest on one side, so a hot payload is split by adaptive execution; what a
    revisit repeats is dropped before anything is packed.  A payload of any
    length is one record, and makes its archive longer.  Control characters of
    a url read as spaces, and spaces around it are not kept, as a header line
    can't have them.  Other columns are not read; an empty table gives no
    archives.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload")
    ).withColumns({"length": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    first = cut(  # staged, so that the join below has a shuffle of its own and can split a payload that many pages share
        pages.select(F.col(key).cast("long").alias("page_id"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
        .where(F.octet_length("payload") >= LEAST_REVISIT)
        .groupBy(F.sha2("payload", 256).alias("digest"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    again = F.col("first") < F.col("page_id")
    records = rows.join(first, "digest", "left").select(
        "page_id", "url", F.when(again, F.lit(None)).otherwise(F.col("payload")).alias("payload"), "digest", "length", F.when(again, F.col("first")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def full() -> pa.RecordBatch:
            content = pack(held)
            name = hashlib.sha256(content).hexdigest()[:32] + ".warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page, url, payload, digest, length, refers_to in zip(*batch.columns, strict=True):
                record = _record(page.as_py(), url.as_py(), payload.as_py() or b"", digest.as_py(), length.as_py(), refers_to.as_py())
                held.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield full()
                    held, size = [], 0
        if held:
            yield full()

    return records.mapInArrow(run, ARCHIVES)


def read_archives(archives: DataFrame, content: str = "content", payloads: bool = True) -> DataFrame:
    """Responses and revisits of archives; with ``payloads`` also what responses hold (a revisit's is its response's).

    Other records are read over.  An archive is read by one task, record by
    record, so what is held is its content and one batch of records.
    """
    names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["url", "payload"] if payloads else [])]
    kinds = {"record_type": pa.string(), "payload_digest": pa.string(), "url": pa.string(), "payload": pa.binary()}
    schema = ", ".join(x for x in RECORDS.split(", ") if x.split()[0] in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for record in unpack(archive.as_py()):
                    if (row := parse(record)) is None:
                        continue
                    rows.append(row)
                    size += len(record)
                    if size >= 8_000_000:
                        yield out(rows)
                        rows, size = [], 0
                yield out(rows)

    def out(rows: list[dict]) -> pa.RecordBatch:
        order = [x.split()[0] for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.int64())) for c in order], order)

    return archives.select(content).mapInArrow(run, schema)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """A record for every page, written and read back."""
    archives = cut(write_archives(table(spark, sf_dir, "pages")))
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM r
"""
