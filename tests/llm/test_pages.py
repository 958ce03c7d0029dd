import base64
import gzip
import hashlib
import os

import pytest

from skeinmill.llm import url_reputation, warc

PAGE = "page_id long, url string, html string, archive string, body string, host string, path string, bad int, response_id long, sha1 string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", 1, 2, "e") for r in rows], PAGE)


def test_rules_hosts_and_paths(spark):
    urls = ["HTTP://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://org", "http://org/", "http://x.com/fr/", "http://xcom/fr/", "http://x.com/de/1", None, "no scheme", "a://b://c/d", "http://u@h.co.uk:80?x=/y", "http://example.org/es"]
    empty = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: r for r in url_reputation.filter_urls(pages(spark, [(i, u, "") for i, u in enumerate(urls)]), empty).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("org", "", None, "allow"),
        ("org", "/", "org/", "allow"), ("x.com", "/fr/", "com/fr/", "allow"), ("xcom", "/fr/", None, "allow"), ("x.com", "/de/1", "com/de/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("u@h.co.uk:80", "", None, "allow"), ("example.org", "/es", "org/", "allow"),
    ]


def test_sparse_hosts_are_not_blocked_and_bad_ones_are(spark):
    rows = [(i, f"http://bad.site.net/{i}", "") for i in range(60)] + [(100 + i, f"http://h{i}.fine.net/", "") for i in range(60)] + [(200, "http://new.site.net/", ""), (201, "http://once.fine.net/", "")]
    outcomes = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(201, 1), (201, 0), (None, 1), (5, None)]
    got = {r.page_id: r.verdict for r in url_reputation.filter_urls(pages(spark, rows), spark.createDataFrame(outcomes, "page_id long, bad int"), rules=()).collect()}
    assert got[0] == "block" and got[201] == "allow" and got[100] == "allow"
    assert len(got) == len(rows)
    assert url_reputation.filter_urls(pages(spark, []), spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_round_trip_through_archives(spark, tmp_path):
    big = "x\u00e9" * 3_000_000
    rows = [(1, "http://a/\r\nb", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c", ""), (5, "http://d", big), (6, "http://e", "WARC/1.1\r\n\r\nsame\r\n\r\n"), (None, "http://f", "same"), (2, "http://b", "same"), (7, "\u00fc://x", "solo")]
    mono = warc.write_monolithic(pages(spark, rows).repartition(2), archive_bytes=1 << 20)
    norm = warc.normalise_archives(mono)
    got = warc.read_archives(norm).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.page_id)
        data = html.encode()
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.payload == (data if r.record_type == "response" else None)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to) == ("revisit", 2) and by[2].record_type == "response"
    assert (by[3].record_type, by[3].refers_to) == ("revisit", 4) and by[None].refers_to == 2
    warc.export_archives(norm, str(tmp_path / "out"))
    files = sorted(f for f in os.listdir(tmp_path / "out") if f.endswith(".gz"))
    assert sum(gzip.open(tmp_path / "out" / f).read().count(b"WARC-Record-ID") for f in files) == len(rows)
    again = warc.normalise_archives(warc.load_archives(spark, str(tmp_path / "out")))
    assert sorted(map(repr, warc.read_archives(again).collect())) == sorted(map(repr, got))
    index = warc.offset_index(norm).collect()
    assert len(index) == len(rows) and all(r.length > 0 for r in index)


def test_a_changed_payload_is_found(spark):
    norm = warc.normalise_archives(warc.write_monolithic(pages(spark, [(1, "u", "first page"), (2, "u", "second page")]).coalesce(1))).collect()
    for old, new in ((b"second", b"secund"), (b"first page", b"first pag")):
        members, lines, offset = [], [], 0
        for line in norm[0].sidecar.splitlines():
            at, size, *rest = line.split(" ")
            member = gzip.compress(gzip.decompress(norm[0].body[int(at) : int(at) + int(size)]).replace(old, new.ljust(len(old))))
            lines.append(f"{offset} {len(member)} {' '.join(rest)}\n")
            members.append(member)
            offset += len(member)
        broken = spark.createDataFrame([("a", b"".join(members), "".join(lines))], "archive string, body binary, sidecar string")
        with pytest.raises(Exception, match="not the one its header names"):
            warc.read_archives(broken).collect()


def test_smallest_payloads_and_empty_table(spark):
    rows = [(i, "u", "tiny" if i < 3 else "long enough") for i in range(6)]
    got = warc.read_archives(warc.normalise_archives(warc.write_monolithic(pages(spark, rows), min_bytes=8))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id < 3) == [(i, "response", None) for i in range(3)]
    assert sum(r.record_type == "revisit" for r in got) == 2
    assert warc.write_monolithic(pages(spark, [])).count() == 0
