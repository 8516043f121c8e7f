import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest

from cohortloom.llm import warc
from cohortloom.llm.queries import registry
from tests.compare import connect, differences

SCHEMA = "page_id long, url string, html string"


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    """Brute force: the response of each payload is the row with the largest key."""
    out = []
    for key, _, html in rows:
        text = html or ""
        same = [k for k, _, h in rows if (h or "") == text and k is not None]
        owner = max(same, default=None)
        again = len(text.encode()) >= least and owner is not None and key != owner
        out.append((key, len(text.encode()), sha1(text), "revisit" if again else "response", owner if again else None))
    return sorted(out, key=repr)


def read_back(archives, **how):
    found = warc.read_archives(archives, **how).filter("record_type != 'warcinfo'")
    assert found.filter("problem IS NOT NULL").count() == 0
    return [r.asDict() for r in found.collect()]


def key(name):
    inside = name[len("<urn:page:") : -1] if name else ""
    return int(inside) if inside else None


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip_with_odd_pages_and_a_hot_payload(spark, least):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdé \r\n") for _ in range(1_500_000))
    rows = [
        (1, "http://a.example/x y", "<p>é</p>"), (2, None, None), (3, "", ""), (None, "http://b.example", "<p>é</p>"),
        (5, "http://c.example\r\nWARC-Type: x", long), (6, "http://d.example", "\r\n\r\nWARC/1.1\r\n"),
        (7, "http://d.example", "abc"), (8, "http://d.example", "abc"), (None, None, "only null keys"),
        (1, "http://a.example/x y", "<p>é</p>"),
        *((100 + i, "http://hot.example", "the same page") for i in range(700)),
        *((1000 + i, f"http://e.example/{i}", f"page {i}") for i in range(1400)),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS key", "1 AS n", "'y' AS digest", "0 AS owner")
    archives = warc.write_archives(frame.repartition(5), least_bytes=least, max_bytes=40_000)
    assert archives.count() > 3 and archives.agg({"records": "sum"}).first()[0] == len(rows)
    found = read_back(archives, with_payload=True)
    got = [
        (key(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], key(r["refers_to"]))
        for r in found
    ]
    assert sorted(got, key=repr) == expected(rows, least)
    texts = {k: h or "" for k, _, h in rows}
    for r in found:
        if r["record_type"] == "response" and key(r["record_id"]) is not None:
            assert r["payload"].decode() == texts[key(r["record_id"])]
        assert "\n" not in r["target_uri"]
    empty = warc.write_archives(frame.limit(0))
    assert empty.count() == 0 and warc.read_archives(empty).count() == 0


def sample(n=5, size=1000):
    rng = random.Random(9)
    bodies = [bytes(rng.randrange(256) for _ in range(size)) for _ in range(n)]
    members = [
        warc.page_record(str(i), f"http://x.example/{i}", b, hashlib.sha1(b).digest(), None, "2020-01-01T00:00:00Z")
        for i, b in enumerate(bodies)
    ]
    return bodies, members


def test_standard_tools_read_the_members():
    bodies, members = sample()
    whole = gzip.decompress(b"".join(members))
    assert whole.count(b"WARC/1.1\r\n") == 5 and all(b in whole for b in bodies)
    assert all(zlib.decompressobj(31).decompress(m).endswith(b + b"\r\n\r\n") for m, b in zip(members, bodies))


def test_pieces_of_any_size_give_the_same_records(monkeypatch):
    bodies, members = sample()
    for piece in (1, 2, 7, 100, 1 << 20):
        monkeypatch.setattr(warc, "PIECE", piece)
        found = list(warc.records(io.BytesIO(b"".join(members)), True))
        assert [r["payload"] for r in found] == bodies
        assert [r["offset"] for r in found] == [sum(map(len, members[:i])) for i in range(5)]
        assert all(r["problem"] is None for r in found)


def test_damage_is_reported_and_the_rest_is_read():
    bodies, members = sample()
    for at in range(10, len(members[2]), 97):
        broken = bytearray(members[2])
        broken[at] ^= 0x55
        found = list(warc.records(io.BytesIO(b"".join([*members[:2], bytes(broken), *members[3:]])), True))
        sound = [r["payload"] for r in found if r["problem"] is None]
        assert [b for i, b in enumerate(bodies) if i != 2] == [b for b in sound if b != bodies[2]]
        assert len([r for r in found if r["problem"]]) == 1
    for cut in (1, 10, 500):
        found = list(warc.records(io.BytesIO(b"".join(members)[:-cut]), True))
        assert [r["payload"] for r in found[:4]] == bodies[:4] and len(found) == 5 and found[4]["problem"]
    assert list(warc.records(io.BytesIO(b""))) == []


def remade(member, change):
    return gzip.compress(change(gzip.decompress(member)))


def problem(member):
    (found,) = warc.records(io.BytesIO(member))
    return found["problem"]


def test_framing_and_digests_are_checked():
    (body,), (member,) = sample(1)
    assert problem(remade(member, lambda w: w)) is None
    assert problem(remade(member, lambda w: w.replace(body, body[:-1] + bytes([body[-1] ^ 1])))) == "block digest differs"
    assert problem(remade(member, lambda w: w[:-5])) == "block shorter than its content length"
    assert problem(remade(member, lambda w: w[:-2])) == "no record end after the block"
    assert problem(remade(member, lambda w: w + b"more")) == "no record end after the block"
    without = lambda w: b"\r\n".join(x for x in w.split(b"\r\n") if not x.startswith(b"WARC-Block"))
    other = hashlib.sha1(b"other").digest()
    record = warc.page_record("1", "u", body, other, None, "d")
    assert problem(record) == "payload digest differs" and problem(remade(record, without)) == "payload digest differs"
    assert problem(remade(member, lambda w: w.replace(b"Content-Length: 1", b"Content-Length: x", 1))) == "no content length"
    assert problem(gzip.compress(b"something else\r\n")) == "no record begins here"


def test_query_equals_sql(spark):
    name = "op12_warc"
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert differences(registry.queries[name](spark, sf), connect(sf), registry.sql[name]) is None
