import gzip
import hashlib
import random
import uuid

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavox.llm import archives as a
from stratavox.llm.store import fresh_path
from tests.conftest import SF, SF2


def brute(rows):
    """What the contract says of (page_id, html) rows."""
    payloads = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, p in payloads:
        if i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, p in payloads:
        again = len(p) >= 100 and i is not None and first[p] < i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def records_of(spark, path):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()
    return [r for f in files for r in a.read_warc(bytes(f.content))]


def test_query_matches_brute_force(spark):
    for sf in (SF, SF2):
        rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
        assert rows_of(a.op7_warc(spark, sf)) == brute(rows)


def test_odd_pages_round_trip(spark):
    long, rng = "é<p>WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>\n\n" * 4, random.Random(2)
    exact = "x" * 100
    rows = [
        (5, "http://h/a b", long), (3, "http://h/ü\n", long), (9, None, long), (3, "http://h/again", long), (1, "http://h/", None), (2, "", ""), (7, "u", exact), (8, "u", exact),
        (10, "u", exact[:99]), (11, "u", exact[:99]), (None, "u", exact), (None, None, None), (-4, "u", "neg" * 50), (2**62, "u", "neg" * 50), (12, "u", "".join(rng.choice("ab\r\n") for _ in range(300_000))),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = fresh_path(spark, "warc")
    a.write_archives(df, path)
    assert rows_of(a.read_archives(spark, path)) == brute([(i, h) for i, _, h in rows])
    path = fresh_path(spark, "warc")
    a.write_archives(df.limit(0), path)
    assert a.read_archives(spark, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sampled_from([1, 2]), st.lists(st.tuples(st.text(max_size=20), st.binary(max_size=60)), max_size=6), st.booleans())
def test_arc_round_trip(version, pages, zipped):
    data = a.arc_version_block(version) + b"".join(a.arc_record(version, u, c, date="20090102030405") for u, c in pages)
    head, *records = a.read_arc(gzip.compress(data) if zipped else data)
    assert head.version == version and head.fields["URL"].startswith("filedesc:")
    assert [r.content for r in records] == [c for _, c in pages]
    assert all(set(r.fields) == set(a.ARC_FIELDS[version].split()) for r in records)


def test_arc_header_with_a_space_in_its_url():
    body = a.arc_version_block(1) + b"http://h/a b 1.2.3.4 20010203040506 text/html 3\nabc\n"
    _, r = a.read_arc(body)
    assert r.fields["URL"] == "http://h/a b" and r.fields["Archive-date"] == "20010203040506"


@pytest.mark.parametrize("data", [b"junk", b"http://h/ 1.2.3.4 1 text/html 3\nabc\n", a.arc_version_block(1) + b"u i d t 99\nabc\n", a.arc_version_block(2) + b"u i d t 1\nx\n", a.arc_version_block(1) + b"u i d t x\n"])
def test_broken_arc(data):
    with pytest.raises(a.ArchiveError):
        list(a.read_arc(data))


def test_conversion_of_each_kind():
    data = a.arc_version_block(2) + a.arc_record(2, "http://h/", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody", date="20010203040506") + a.arc_record(2, "ftp://h/f", b"raw")
    warc = b"".join(a.to_warc(r, k) + b"\r\n\r\n" for k, r in enumerate(a.read_arc(data)))
    info, response, resource = a.read_warc(warc)
    assert [x[0]["WARC-Type"] for x in (info, response, resource)] == ["warcinfo", "response", "resource"]
    assert response[0]["WARC-Date"] == "2001-02-03T04:05:06Z" and response[0]["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"body").hexdigest()
    assert response[1].endswith(b"body") and resource[1] == b"raw" and resource[0]["Content-Type"] == "text/html"
    assert uuid.UUID(response[0]["WARC-Record-ID"][10:-1]).version == 8


def test_damage_is_noticed():
    good = a.to_warc(next(iter(a.read_arc(a.arc_version_block(1))))) + b"\r\n\r\n"
    assert len(list(a.read_warc(good))) == 1
    for bad in (good[:-1], good.replace(b"software", b"softwarE"), b"x" + good):
        with pytest.raises(a.ArchiveError):
            list(a.read_warc(bad))


@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.text(max_size=10))
def test_identifiers_carry_the_page(page_id, url):
    assert a.page_of(a.record_id(page_id, url)) == page_id


def test_every_revisit_names_a_response_of_its_payload(spark):
    """WARC-Refers-To is the WARC-Record-ID of a response in the archive, whatever the urls."""
    same, other = "é<p>" * 50, "y" * 100
    rows = [
        (5, "http://h/a b", same), (3, "http://h/ü\n", same), (9, None, same), (3, "http://h/again", same), (None, "http://h/0", same), (7, None, other), (8, "http://h/8", other),
        (12, "http://h/12", other), (20, "", "z" * 200), (21, "http://h/21", "z" * 200),
    ]
    path = fresh_path(spark, "warc")
    a.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    records = [headers for headers, _ in records_of(spark, path)]
    responses = {h["WARC-Record-ID"]: h for h in records if h["WARC-Type"] == "response"}
    revisits = [h for h in records if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 5
    for h in revisits:
        first = responses[h["WARC-Refers-To"]]
        assert first["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and first["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"]


def test_files_are_gzip_members_rolled_and_of_both_versions(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", f"page {i} " * 20) for i in range(700)]
    seen, plain = [], a.read_arc
    monkeypatch.setattr(a, "read_arc", lambda data: seen.append(data) or plain(data))
    members = list(a._converted([pa.RecordBatch.from_pylist([{"i": i, "u": u, "h": h.encode(), "f": None, "g": None} for i, u, h in rows])]))
    assert {d.split(b"\n")[1][:1] for d in seen} == {b"1", b"2"} and len(members) == 701
    monkeypatch.setattr(a, "RUN_BYTES", 4000)
    runs = [b.column(0)[0].as_py() + b"\0" for b in a._runs(iter(members))]
    assert len(runs) > 5 and gzip.decompress(b"".join(runs)) == b"".join(map(gzip.decompress, members))
    assert [h["WARC-Type"] for r in runs for h, _ in a.read_warc(r)].count("response") == 700


def test_bytes_that_are_no_text(spark):
    rows = [(i, f"http://h/{i}", bytes(range(256)) * 3 + bytes([i // 2])) for i in range(8)]
    path = fresh_path(spark, "warc")
    a.write_archives(spark.createDataFrame(rows, "page_id long, url string, html binary"), path)
    got = rows_of(a.read_archives(spark, path))
    assert [(r[0], r[2], r[3]) for r in got] == [(i, hashlib.sha256(h).hexdigest(), "revisit" if i % 2 else "response") for i, _, h in rows]
    assert sorted(b.partition(a.RECORD_END)[2] for h, b in records_of(spark, path) if h["WARC-Type"] == "response") == sorted(h for i, _, h in rows if not i % 2)


def test_many_payloads_with_copies_are_joined(spark, monkeypatch):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    monkeypatch.setattr(a, "MAX_SENT", 0)
    path = fresh_path(spark, "warc")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    a.write_archives(pages.union(pages), path)
    assert rows_of(a.read_archives(spark, path)) == brute(rows + rows)


def test_conversion_of_files(spark, tmp_path):
    image = bytes(range(256)) * 500
    for version, zipped in ((1, False), (2, True)):
        parts = [a.arc_version_block(version), a.arc_record(version, "http://h/i.png", b"HTTP/1.0 200 OK\r\n\r\n" + image), a.arc_record(version, "ftp://h/f", b"raw\n\n")]
        (tmp_path / f"{version}.arc").write_bytes(b"".join(map(gzip.compress, parts)) if zipped else b"".join(parts))
    path = fresh_path(spark, "warc")
    a.convert_arcs(spark, str(tmp_path), path)
    found = records_of(spark, path)
    assert sorted(h["WARC-Type"] for h, _ in found) == ["resource"] * 2 + ["response"] * 2 + ["warcinfo"] * 2
    assert all(b.endswith(image) for h, b in found if h["WARC-Type"] == "response")
    assert len({h["WARC-Record-ID"] for h, _ in found}) == 6


@pytest.mark.parametrize("cut", [1, 5, 30])
def test_a_cut_gzip_is_noticed(cut):
    data = gzip.compress(a.arc_version_block(1) + a.arc_record(1, "u", b"content"))
    with pytest.raises(a.ArchiveError):
        list(a.read_arc(data[:-cut]))
