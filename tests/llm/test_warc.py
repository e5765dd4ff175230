import gzip
import hashlib
import io
import random

import pytest

from cadenza.llm import common, warc


def make(n, rnd):
    pages = []
    for k in range(n):
        body = bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 3, 5000]))) + b"\r\n\r\nWARC/1.1\r\n" * rnd.randint(0, 3)
        pages.append((str(k), body))
    return pages


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_normaliser(piece, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", piece)
    rnd = random.Random(piece)
    pages = make(25, rnd)
    records = [b"".join(warc.record(k, "http://x/é", b, hashlib.sha1(b).hexdigest(), len(b), None)) for k, b in pages]
    mono = gzip.compress(b"".join(records[:20])) + gzip.compress(b"".join(records[20:]))
    out = io.BytesIO()
    index = list(warc.normalise(io.BytesIO(mono), out))
    raw = out.getvalue()
    assert gzip.decompress(raw) == b"".join(records)
    for entry, want, (k, b) in zip(index, records, pages, strict=True):
        member = raw[entry["offset"] : entry["offset"] + entry["length"]]
        assert gzip.decompress(member) == want
        fields, payload = warc.read_member(member)
        assert b"".join(payload) == b and fields["x-page-id"] == k
        assert entry["id"] == warc.record_id(k)


def test_broken_archive():
    whole = b"".join(warc.record("1", None, b"abc", "x", 3, None))
    with pytest.raises(ValueError):
        list(warc.normalise(io.BytesIO(gzip.compress(whole[:-6])), io.BytesIO()))
    assert list(warc.normalise(io.BytesIO(b""), io.BytesIO())) == []


def test_round_trip_with_revisits(spark):
    big, other = "é" * 700, "z" * 2000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (None, "u", other), (9, "u", big), (9, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = common.scratch(spark, "warc")
    files = warc.archive(df, folder, file_bytes=500)
    got = warc.read_back(files, folder).collect()
    assert len(got) == len(rows) == sum(r.records for r in files.collect())
    want = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, x in rows if x == h and len(raw) >= 1000]
        top = max((j for j in same if j is not None), default=None)
        revisit = len(same) > 1 and i != top
        want[str(i) if i is not None else None] = (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", str(top) if revisit else None)
    for r in got:
        assert (r.size, r.digest, r.record_type, r.refers) == want[r.page]
        if r.record_type == "response":
            assert (r.own_digest, r.own_size) == (r.digest, r.size)
    again = warc.normalise_archives(warc.write_archives(warc.with_revisits(df), folder), folder)  # a second attempt at everything leaves other files
    names = [r.file for r in again.collect()]
    assert not set(names) & {r.file for r in files.collect()} and sorted(r.digest for r in warc.read_back(files, folder).collect()) == sorted(r.digest for r in got)
    text_ids = spark.createDataFrame([("-", "u", big, 1), (None, "u", big, 2)], "page_id string, url string, html string, digest int")
    folder = common.scratch(spark, "warc")
    assert {(r.page, r.record_type, r.refers) for r in warc.read_back(warc.archive(text_ids, folder), folder).collect()} == {("-", "response", None), (None, "revisit", "-")}
    none = common.scratch(spark, "warc")
    assert warc.read_back(warc.archive(df.where("false"), none), none).count() == 0
