import base64
import hashlib
import struct
from collections import defaultdict

import pytest

from callscope.llm import queries, warc


def expected(rows):
    by = defaultdict(list)
    for key, _, html in rows:
        by[(html or "").encode()].append(key)
    out = []
    for payload, keys in by.items():
        real = [k for k in keys if k is not None]
        first = min(real) if real else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(k, len(payload), digest, "response" if k == first else "revisit", None if k == first else first) for k in keys]
    return sorted(out, key=str)


def test_query_small(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op3_warc(spark, sf_small).collect()), key=str) == expected(rows)


def test_round_trip_edge_cases(spark, tmp_path):
    rows = [(5, "http://a/ü?x=1 2", "same"), (3, None, "same"), (3, "http://b\r\nX: y", "same"), (None, "u", "same"), (9, "u", None),
            (8, "u", ""), (7, "u", "long " * 400_000), (1, "u", "\0\r\n\r\n<é>"), (None, "u", "alone")]
    rows += [(100 + i, f"http://c/{i}", f"<p>page {i} text</p>" * 5) for i in range(300)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, size int").repartition(3)
    path = str(tmp_path / "w")
    warc.write(df, path)
    got = warc.read(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert sorted((r.url or "" for r in got)) == sorted(r[1] or "" for r in rows)
    texts = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    assert set(texts.values()) == {(r[2] or "").encode() for r in rows}
    path = str(tmp_path / "least")
    warc.write(df, path, least_bytes=5)
    assert {r.record_type for r in warc.read(spark, path).collect() if r.payload_bytes < 5} == {"response"}
    path = str(tmp_path / "none")
    warc.write(df.limit(0), path)
    assert warc.read(spark, path).count() == 0


def test_archives_are_checked(spark, tmp_path):
    path = tmp_path / "w"
    warc.write(spark.createDataFrame([(i, "u", f"text {i} " * 9) for i in range(50)], "page_id long, url string, html string").coalesce(1), str(path))
    (raw,) = [p.read_bytes() for p in path.glob("part-*")]
    assert struct.unpack_from("<I", raw)[0] == warc.DICTIONARY_FRAME
    good = list(warc.records(raw))
    assert len(good) == 50 and all(warc.parse(r) for r in good)
    for bad in (raw[:-20], raw + b"xyz", raw[:len(raw) // 2] + b"\0" + raw[len(raw) // 2 + 1:]):
        with pytest.raises(ValueError):
            [warc.parse(r) for r in warc.records(bad)]
    for bad in (good[0].replace(b"Content-Length: ", b"Content-Length: 1"), good[0].replace(b"text", b"next"),
                good[0].replace(b"WARC/1.1", b"WARC/9"), good[0].replace(b"WARC-Type: response", b"WARC-Type: other")):
        with pytest.raises(ValueError):
            warc.parse(bad)
