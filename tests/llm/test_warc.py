import io
from collections import Counter

import pytest

from tallyline.llm import warc


def brute(rows):
    first, seen = {}, Counter()
    for k, _, h in rows:
        p = (h or "").encode()
        seen[p] += 1
        if k is not None:
            first[p] = min(first.get(p, k), k)
    for k, _, h in rows:
        p = (h or "").encode()
        again = seen[p] > 1 and k is not None and first[p] != k
        yield k, len(p), warc.base32_sha1(p), "revisit" if again else "response", first[p] if again else None


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/é\r\nx", "<p>é</p>"), (3, "u", "<p>é</p>"), (9, None, None), (8, "v", ""), (1, "w", "q" * 700_000), (1, "w", "z"), (None, "n", "only"), (None, "n", "<p>é</p>"), (3, "u", "<p>é</p>"), (20, "u", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    out = warc.round_trip(pages, f"file://{tmp_path}/w")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect())
    assert got == Counter(brute(rows))
    assert {r.url for r in out.collect()} == {r[1] or "" for r in rows}
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def archive(*payloads):
    return b"".join(warc.gzip_member(warc.record(i, "u", p, warc.base32_sha1(p))) for i, p in enumerate(payloads))


def test_reader_frames_and_verifies():
    raw = archive(b"", b"a\r\n\r\nb", bytes(range(256)) * 4000)
    got = [(h["WARC-Record-ID"], n, p) for h, n, p in warc.read_records(io.BytesIO(raw), with_payload=True)]
    assert [g[2] for g in got] == [b"", b"a\r\n\r\nb", bytes(range(256)) * 4000]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(raw[:-9])))
    bad = warc.gzip_member(warc.record(1, "u", b"abc", warc.base32_sha1(b"abd")))
    with pytest.raises(ValueError, match="payload digest"):
        list(warc.read_records(io.BytesIO(bad)))
    assert list(warc.read_records(io.BytesIO(b""))) == []
