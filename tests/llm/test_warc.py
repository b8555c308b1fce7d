"""Archives: there and back, damage, odd rows, large groups of equal payloads."""

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from framewalk.llm import common, warc


def rows_of(data):
    return list(warc.salvage(warc.Archive(io.BytesIO(data), len(data))))


def made(n, packed, size=400):
    rng = random.Random(n)
    out = []
    for k in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.randrange(size)))
        one = warc.record("response", f"urn:page:{k}", f"http://x/{k}", "2020-01-01T00:00:00Z", payload, warc.base32(hashlib.sha1(payload).digest()), None)
        out.append(warc.member(one) if packed else one)
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archives(packed):
    parts = made(50, packed)
    found = rows_of(b"".join(parts))
    assert [r["record_id"] for r in found] == [f"urn:page:{k}" for k in range(50)]
    assert [r["length"] for r in found] == list(map(len, parts))
    assert all("problem" not in r and r["payload_bytes"] == len(r["payload"]) for r in found)


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("small", [True, False])
def test_damage(packed, small, monkeypatch):
    """Whatever is done to one place: the records that it does not touch are found, and gaps and records make up the archive."""
    if small:  # chunks shorter than a record
        monkeypatch.setattr(warc, "CHUNK", 64)
        monkeypatch.setattr(warc, "PIECE", 16)
    parts = made(30, packed)
    whole = b"".join(parts)
    starts = [sum(map(len, parts[:k])) for k in range(31)]
    rng = random.Random(5)
    for _ in range(60 if small else 200):
        a = rng.randrange(len(whole))
        b = min(len(whole), a + rng.choice([1, 1, 3, 50, 900]))
        kind = rng.choice(["flip", "cut", "insert", "end"])
        if kind == "flip":
            data = whole[:a] + bytes(x ^ 0x5A for x in whole[a:b]) + whole[b:]
        elif kind == "cut":
            data = whole[:a] + whole[b:]
        elif kind == "insert":
            data, b = whole[:a] + rng.randbytes(b - a) + whole[a:], a
        else:
            data, b = whole[:a], len(whole)
        found = rows_of(data)
        place = 0
        for r in found:
            assert r["offset"] == place
            place += r["length"]
        assert place == len(data)
        left = {f"urn:page:{k}" for k in range(30) if starts[k + 1] <= a or starts[k] >= max(b, a + (kind == "insert"))}
        ids = [r["record_id"] for r in found if "problem" not in r]
        assert left <= set(ids) and (len(ids) == len(set(ids)) or not packed)
        if packed and kind in ("flip", "insert"):  # plain heads have no checksum
            assert any("problem" in r for r in found) and set(ids) <= {f"urn:page:{k}" for k in range(30)}


def test_a_damaged_record_that_holds_a_record_is_passed_over():
    inner = warc.record("response", "urn:page:99", None, "d", b"inner", warc.base32(hashlib.sha1(b"inner").digest()), None)
    outer = warc.record("response", "urn:page:1", None, "d", b"page " + inner, "A" * 32, None)  # a digest of something else
    last = warc.record("response", "urn:page:2", None, "d", b"last", warc.base32(hashlib.sha1(b"last").digest()), None)
    found = rows_of(outer + last)
    assert [r.get("problem") for r in found] == ["payload digest", None]
    assert found[1]["record_id"] == "urn:page:2"
    cut = rows_of(b"junk" + last[:-1])
    assert [r["problem"] for r in cut] == ["no member or version line"]
    assert rows_of(b"") == [] and rows_of(b"WARC/1.1\r\n")[0]["problem"] == "header cut off"


def test_other_forms():
    """What other writers make: hex digests, folded lines, lower-case names, several records in a member, other record types."""
    info = b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 7\r\n\r\na: b\r\n\r" + b"\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nab\r\n0\r\n\r\n"
    chunked = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID:\t<urn:x:2>\r\nWARC-Target-URI: http://a/\r\n b\r\nWARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"ab").digest()) + b"\r\nWARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode() + b"\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    for data in (info + chunked, gzip.compress(info + chunked), gzip.compress(info) + gzip.compress(b"") + gzip.compress(chunked)):
        found = rows_of(data)
        assert [(r["record_type"], r["record_id"], r["target_uri"]) for r in found] == [("warcinfo", "urn:x:1", None), ("response", "urn:x:2", "http://a/ b")]
        assert found[0]["payload"] == b"a: b\r\n\r"
    odd = chunked.replace(b"sha1:" + hashlib.sha1(block).hexdigest().encode(), b"md5:00")
    assert rows_of(odd)[0]["payload_bytes"] == 12


def test_searches_are_linear():
    data = b"WARC/1.1\r\nA" * 60_000 + b"\x1f\x8b\x08" * 60_000
    found = rows_of(data)
    assert len(found) == 1 and found[0]["length"] == len(data)


PAGES = [(1, "http://a/ b\n", "same"), (2, None, "same"), (3, "http://c/é", None), (4, "u", ""), (5, "u", "é" * 1000), (None, "n", "same"), (None, "n", "alone"), (None, "n", "alone"), (9, "r", "twice"), (9, "r", "twice"), (8, "r", "twice"), (-3, "r", "WARC/1.1\r\n\r\n")]


def wanted(pages):
    last = {}
    for p, _, h in pages:
        if p is not None:
            last[h or ""] = max(p, last.get(h or "", p))
    out = []
    for p, _, h in pages:
        data, top = (h or "").encode(), last.get(h or "")
        again = top is not None and (p is None or p < top)
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("most", [1_000_000, 0])
def test_pages_there_and_back(spark, tmp_path, monkeypatch, compress, most):
    monkeypatch.setattr(common, "BROADCAST_NUMBERS", most)
    monkeypatch.setattr(common, "HEAVY", 3)
    frame = spark.createDataFrame([(*p, 1, "x", 2) for p in PAGES], "page_id long, url string, html string, _key int, record_id string, payload int")
    warc.archive_pages(frame, f"{tmp_path}/w", compress=compress)
    back = warc.read_warc(spark, f"{tmp_path}/w")
    assert warc.gaps(back).count() == 0
    page = F.substring_index("record_id", ":", -1).try_cast("long")
    of = F.substring_index("refers_to", ":", -1).try_cast("long")
    got = back.select(page, "payload_bytes", "payload_digest", "record_type", of)
    assert sorted(map(tuple, got.collect()), key=repr) == wanted(PAGES)
    texts = {r["record_id"]: bytes(r["payload"]).decode() for r in back.where("record_type = 'response'").collect()}
    assert texts["urn:page:5"] == "é" * 1000 and texts["urn:page:-3"] == "WARC/1.1\r\n\r\n" and texts["urn:page:4"] == ""
    uris = {r["record_id"]: r["target_uri"] for r in back.collect()}
    assert uris["urn:page:1"] == "http://a/%20b%0A" and uris["urn:page:2"] is None and uris["urn:page:3"] == "http://c/é"


def test_long_and_no_pages(spark, tmp_path):
    long = "".join(random.Random(1).choices("abcdefgh", k=1 << 20)) * 17  # a member whose length's last byte is not zero
    frame = spark.createDataFrame([(1, "u", long), (2, "v", "short"), (3, "w", long + "!")], "page_id long, url string, html string").coalesce(1)
    warc.archive_pages(frame, f"{tmp_path}/long")
    back = warc.read_warc(spark, f"{tmp_path}/long").select("record_id", F.length("payload"), "problem").collect()
    assert sorted(map(tuple, back)) == [("urn:page:1", len(long), None), ("urn:page:2", 5, None), ("urn:page:3", len(long) + 1, None)]
    warc.archive_pages(frame.limit(0), f"{tmp_path}/none")
    assert warc.read_warc(spark, f"{tmp_path}/none").count() == 0


def test_gaps_are_logged(spark, tmp_path):
    parts = made(20, True)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "a" / "two.warc.gz").write_bytes(b"".join(parts[:5]) + b"?" * 77 + b"".join(parts[5:19]) + parts[19][:-9])
    back = warc.read_warc(spark, f"{tmp_path}/a", payload=False)
    assert warc.records(back).count() == 39 and back.where("payload is not null").count() == 0
    start = sum(map(len, parts[:5]))
    got = [tuple(r)[1:] for r in warc.gaps(back).orderBy("offset").collect()]
    assert got == [(start, 77, "no member or version line"), (sum(map(len, parts[:19])) + 77, len(parts[19]) - 9, "member cut off")]
