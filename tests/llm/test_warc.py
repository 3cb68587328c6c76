"""ARC to WARC: both versions, plain and packed archives, revisits, damage, edge cases."""

import hashlib
import io

import oracle
import pytest
from pyspark.sql import functions as F

from weftline.llm import warc

BIG = "x" * 99 + "é"  # 101 bytes
PAGES = [(7, "http://a.example/é b", BIG), (3, None, BIG), (3, "http://a.example/", BIG), (9, "http://b.example/", BIG + "\r\n\r\nHTTP/1.1"), (1, "u", None), (2, "u", ""), (4, "u", "short"), (5, "u", "short"), (None, "u", BIG), (10, "u", BIG + "\r\n\r\nHTTP/1.1"), (11, "u", "y" * 100), (12, "u", "y" * 99), (13, "u", "y" * 99), (14, "u", "long\n" * 90_000), (15, "", "<html> </html>" * 9)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "k", 1) for p in PAGES], "page_id long, url string, html string, key string, archive int").repartition(3)


def want(pages):
    first = {}
    for k, _, body in pages:
        if k is not None and len((body or "").encode()) >= 100:
            first[body] = min(k, first.get(body, k))
    out, seen = [], set()
    for k, _, body in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        data = (body or "").encode()
        again = k is not None and len(data) >= 100 and body in seen
        if k is not None:
            seen.add(body)
        out.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("version", [1, 2, None])
def test_archive(spark, pages, tmp_path, version):
    manifest, directory = warc.archive(pages, str(tmp_path), version=version, archive_bytes=500)
    rows = warc.read_warc(manifest, directory).collect()
    assert sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_key) for r in rows), key=str) == want(PAGES)
    by_id = {r.record_id: r for r in rows}
    assert len(by_id) == len(rows)
    for r in rows:
        assert r.stamp == "2000-01-01T00:00:00Z"
        if r.record_type == "revisit":
            assert r.payload is None and by_id[r.refers_to].record_type == "response" and by_id[r.refers_to].payload_digest == r.payload_digest and by_id[r.refers_to].key == r.refers_to_key
        else:
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    assert {r.target_uri for r in rows if r.key == 7} == {"http://a.example/é%20b"} and None in {r.target_uri for r in rows if r.key == 3}


def test_empty_table(spark, pages, tmp_path):
    manifest, directory = warc.archive(pages.limit(0), str(tmp_path))
    assert warc.read_warc(manifest, directory).count() == 0


def legacy(version, records, packed, per_member=1):
    """An ARC file as other tools write it: (url, ip, date, type, content)."""
    head = warc.arc_record(version, b"n.arc", 0, b"filedesc://n.arc", b"19990102", b"text/plain", b"%d 0 Some Origin\n%s\n" % (version, warc.FIELDS[version]))
    tail = b"" if version == 1 else b" 404 abc - 12 n.arc"
    made = [head] + [b"\n%s %s %s %s%s %d\n%s\n" % (u, ip, d, t, tail, len(c), c) for u, ip, d, t, c in records]
    if not packed:
        return b"".join(made)
    return b"".join(warc.gz(b"".join(made[k : k + per_member])) for k in range(0, len(made), per_member))


RECORDS = [
    (b"http://x.example/a b c", b"10.0.0.1", b"19970101123456", b"text/html; charset=x", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nfiledesc://no 1.1.1.1 19990101 t 3\n"),
    (b"dns:x.example", b"::1", b"199701011234", b"text/dns", b"20 lines\n"),
    (b"ftp://x.example/", b"1.2.3.4", b"19970101", b"no-type", b""),
    (b"http://y.example/", b"1.2.3.4", b"19970101000001", b"text/html", b"HTTP/1.0 200 OK\nA: b\n\nbody"),
    (b"http://z.example/", b"1.2.3.4", b"19970101000001", b"text/html", b"HTTP/1.0 200 OK"),
]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed,per_member", [(False, 1), (True, 1), (True, 3)])
def test_foreign_archives(version, packed, per_member):
    found = list(warc.arc_records(io.BytesIO(legacy(version, RECORDS, packed, per_member))))
    assert found[0].url == b"filedesc://n.arc" and found[0].version == version and found[0].origin == b"Some Origin"
    assert [(r.url, r.ip, r.date, r.type, r.content) for r in found[1:]] == RECORDS
    assert [r.timestamp for r in found[1:]] == ["1997-01-01T12:34:56Z", "1997-01-01T12:34:00Z", "1997-01-01T00:00:00Z", "1997-01-01T00:00:01Z", "1997-01-01T00:00:01Z"]
    kinds = []
    for r in found[1:]:
        row = warc.parse_warc("w", 0, warc.to_warc(r, "n.arc", "<i>"))
        kinds.append(row[2])
        assert row[-1] == r.split()[1]
    assert kinds == ["response", "resource", "resource", "response", "response"]
    assert found[4].split() == (b"HTTP/1.0 200 OK\nA: b\n\n", b"body")
    assert len({(r.offset, r.inner) for r in found}) == len(found)


def test_truncated_and_damaged():
    data = legacy(1, RECORDS[:1], False)
    cut_short = list(warc.arc_records(io.BytesIO(data[:-10])))[1]
    assert b"WARC-Truncated: unspecified" in warc.to_warc(cut_short, "n", "<i>")
    with pytest.raises(ValueError, match="version block"):
        list(warc.arc_records(io.BytesIO(data[data.index(b"http://") :])))
    with pytest.raises(ValueError, match="version 7"):
        list(warc.arc_records(io.BytesIO(data.replace(b"\n1 0", b"\n7 0"))))
    with pytest.raises(OSError, match="cut short"):
        list(warc.arc_records(io.BytesIO(legacy(1, RECORDS, True)[:-4])))
    made = warc.to_warc(list(warc.arc_records(io.BytesIO(data)))[1], "n", "<i>")
    with pytest.raises(OSError, match="damaged"):
        warc.parse_warc("w", 0, made.replace(b"body", b"bodx"))


def test_repeats_of_a_given_table(spark, tmp_path):
    """The given pages hold no repeated payload: each fourth gets that of an earlier one."""
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    again = real.select((F.col("page_id") + 10_000 - 2 * F.col("page_id") % 3).alias("page_id"), "url", "html").filter("page_id % 2 = 0")
    both = real.union(again).union(again)
    manifest, directory = warc.archive(both, str(tmp_path))
    con = oracle.connect("/root/testdata/sf0.001")
    con.execute("CREATE OR REPLACE VIEW real_pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    con.execute("CREATE OR REPLACE VIEW again AS SELECT page_id + 10000 - 2 * page_id % 3 AS page_id, url, html FROM real_pages WHERE (page_id + 10000 - 2 * page_id % 3) % 2 = 0")
    con.execute("CREATE OR REPLACE VIEW pages AS SELECT * FROM real_pages UNION ALL FROM again UNION ALL FROM again")
    rows = warc.read_warc(manifest, directory, payloads=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))
    assert oracle.difference(rows, con, warc.SQL) == ""
    assert rows.filter("record_type = 'revisit'").count() > 20
