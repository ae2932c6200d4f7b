"""WARC archives compressed with Zstandard: one frame per record, and a dictionary in
a leading skippable frame.

``write`` finds, for each payload, the record with the smallest id (aggregated before
the shuffle) and writes the others as revisits of it.  Spark's text writer puts the
frames into files, one archive per partition, so any file system that Spark writes
will do; the bytes it puts after every row are an empty skippable frame.  ``read``
loads the dictionary of an archive, decodes frame by frame, and checks the headers,
lengths and digests of each record; a fault raises ``ValueError``.

Defined results: a null payload is empty; a null url is left out; a null id counts as
larger than any other; rows that repeat the smallest id of a payload are all
responses; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import column, small_batches

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\0\0\0\0"  # 0x184D2A50, no bytes
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of an archive's dictionary, and of the records that it is trained on.
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 1 << 20


def _uri(key) -> str:
    return f"<urn:x-page:{'' if key is None else key}>"


def _record(key, url, payload: bytes | None, size: int, digest: str, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", _uri(key)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=-._~")))
    if payload is None:
        head += [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
             ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few samples: their bytes themselves
        raw = b"".join(samples)[:DICTIONARY_BYTES].ljust(16, b"\r\n")
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
          least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for every row into archives below ``path``.  Of records with
    equal payloads of at least ``least_bytes``, that with the smallest key is a
    response, and the others revisit it."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"), F.sha1(body.cast("binary")).alias("sha1"),
                        F.octet_length(body).cast("long").alias("size"))
    first = rows.groupBy("sha1").agg(F.min("key").alias("first_key"))
    revisit = (F.col("size") >= least_bytes) & ~F.col("key").eqNullSafe(F.col("first_key"))
    known = rows.join(first, "sha1").select(
        "key", "url", "size", "sha1", F.when(~revisit, F.col("payload").cast("binary")).alias("payload"),
        F.when(revisit, F.col("first_key")).alias("refers_to"))

    def frames(batches):
        waiting, size, press = [], 0, None

        def start():
            known = _dictionary(waiting)
            raw = known.as_bytes()
            return struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw, zstandard.ZstdCompressor(
                level=6, dict_data=known, write_checksum=True, write_content_size=True)

        for batch in small_batches(batches, "payload"):
            out = []
            for r in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                record = _record(r["key"], r["url"], r["payload"], r["size"], digest, r["refers_to"], date)
                if press is None:
                    waiting.append(record)
                    size += len(record)
                    if size < SAMPLE_BYTES:
                        continue
                    lead, press = start()
                    out += [lead, *map(press.compress, waiting)]
                else:
                    out.append(press.compress(record))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
        if press is None and waiting:
            lead, press = start()
            yield pa.RecordBatch.from_arrays([pa.array([lead, *map(press.compress, waiting)], pa.binary())], ["frame"])

    (known.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", EMPTY_FRAME).option("compression", "none").text(path))


def records(archive: bytes):
    """The decoded records of an archive, one per frame."""
    view, at, decoder = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError(f"{len(view) - at} stray bytes at {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(view):
                raise ValueError(f"the frame at {at} is cut off")
            if magic == DICTIONARY_FRAME:
                if at:
                    raise ValueError(f"a dictionary at {at}, not at the start")
                raw = view[8:8 + size].tobytes()
                if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
                    raw = decoder.decompress(raw)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        frame, out, end = decoder.decompressobj(), [], at
        try:
            while not frame.eof:
                if end >= len(view):
                    raise ValueError(f"the frame at {at} is cut off")
                out.append(frame.decompress(view[end:end + (32 << 10)]))
                end = min(end + (32 << 10), len(view))
        except zstandard.ZstdError as e:
            raise ValueError(f"the frame at {at}: {e}") from e
        at = end - len(frame.unused_data)
        yield b"".join(out)


def _headers(raw: bytes, first: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    start, *lines = head.split(b"\r\n")
    if not gap or not start.startswith(first):
        raise ValueError(f"no {first.decode()} header: {raw[:40]!r}")
    out = {}
    for line in lines:
        name, colon, value = line.decode().partition(": ")
        if not colon or name.lower() in out:
            raise ValueError(f"bad header line {line!r}")
        out[name.lower()] = value
    return out, rest


def parse(record: bytes) -> dict:
    """A checked record: key, url, record_type, payload, payload_bytes, payload_digest,
    refers_to (keys as text, empty for null)."""
    head, rest = _headers(record, b"WARC/1.1")
    try:
        kind, uri, length, digest = (head[k] for k in ("warc-type", "warc-record-id", "content-length", "warc-payload-digest"))
    except KeyError as e:
        raise ValueError(f"a record without {e}") from e
    if kind not in ("response", "revisit") or not digest.startswith("sha1:"):
        raise ValueError(f"a record of type {kind} with digest {digest}")
    if len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"{uri}: a block of {len(rest) - 4} bytes; Content-Length is {length}")
    http, payload = _headers(rest[:-4], b"HTTP/1.1")
    size, digest = int(http["content-length"]), digest[5:]
    if kind == "response":
        if len(payload) != size:
            raise ValueError(f"{uri}: a payload of {len(payload)} bytes; Content-Length is {size}")
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{uri}: the payload's digest is not {digest}")
    elif payload or "warc-refers-to" not in head:
        raise ValueError(f"{uri}: a revisit with a payload or without what it refers to")
    key = lambda x: x.removeprefix("<urn:x-page:").removesuffix(">")
    return {"key": key(uri), "url": unquote(head["warc-target-uri"]) if "warc-target-uri" in head else None,
            "record_type": kind, "payload": payload if kind == "response" else None, "payload_bytes": size,
            "payload_digest": digest, "refers_to": key(head["warc-refers-to"]) if kind == "revisit" else None}


def read(spark: SparkSession, path: str, key: str = "page_id", key_type: str = "long", payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``; ``payloads``: whether to return
    them (they are decoded and checked in any case)."""
    names = ["key", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    schema = T.StructType([T.StructField(n, {"payload": T.BinaryType(), "payload_bytes": T.LongType()}.get(n, T.StringType()))
                           for n in names if payloads or n != "payload"])
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}

    def run(batches):
        for batch in small_batches(batches, "content", 1):
            for archive in column(batch, "content"):
                out, size = [], 0
                for record in records(archive.as_buffer()):
                    out.append(parse(record))
                    size += len(record)
                    if size > 8 << 20 or len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, pa.schema([(n, kinds.get(n, pa.string())) for n in names])).select(schema.names)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, pa.schema([(n, kinds.get(n, pa.string())) for n in names])).select(schema.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = files.mapInArrow(run, schema)
    as_key = lambda c: F.when(F.col(c) != "", F.col(c)).cast(key_type)
    return found.select(as_key("key").alias(key), *[c for c in schema.names if c not in ("key", "refers_to")],
                        as_key("refers_to").alias("refers_to"))
