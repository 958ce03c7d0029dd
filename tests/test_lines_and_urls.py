"""Line documents against a sequential reader, and addresses against the standard library."""

import hashlib
import ipaddress
import json
import os

from pyspark.sql import functions as F

from skeinmill.operators.ingest import is_public_url
from skeinmill.sources import objects


def sequential(folder):
    """One pass, file after file by name: lines first, then whole texts."""
    seen, out = set(), []
    for name in sorted(os.listdir(folder)):
        if name.endswith(".jsonl"):
            with open(f"{folder}/{name}", encoding="utf-8") as f:
                for n, line in enumerate(f, 1):
                    raw = line.strip()
                    h = hashlib.md5(raw.encode()).hexdigest()
                    if not raw or h in seen:
                        continue
                    seen.add(h)
                    try:
                        data = json.loads(raw)
                        key, text = data.get("id", f"{name}_line{n}"), data.get("text", "")
                    except (ValueError, AttributeError):
                        continue
                    if key:
                        out.append((str(key), text if isinstance(text, str) else ""))
    for name in sorted(os.listdir(folder)):
        if name.endswith(".txt"):
            with open(f"{folder}/{name}", encoding="utf-8") as f:
                raw = f.read()
            h = hashlib.md5(raw.encode()).hexdigest()
            if h not in seen:
                seen.add(h)
                out.append((name, raw.strip()))
    return sorted(out)


def test_line_documents(spark, tmp_path):
    one = '{"id": "a", "text": "x"}'
    (tmp_path / "1.jsonl").write_bytes(f'{one}\r\n{one}\n{one} \n\n \t\n{{"id": null, "text": "n"}}\n{{"id": "", "text": "e"}}\n{{"id": 0}}\n{{"id": 7, "text": "seven"}}\n{{"id": false}}\n{{"text": "no id"}}\n[1]\n"s"\n{{broken\n{{"id": "t", "text": null}}'.encode())
    (tmp_path / "2.jsonl").write_text(f'{{"text": "no id"}}\n　{one}\n{{"text": "other é"}}\n')
    (tmp_path / "a.txt").write_text(one)  # equal to a line
    (tmp_path / "b.txt").write_text(" text\n")
    (tmp_path / "c.txt").write_text(" text\n")
    (tmp_path / "d.txt").write_text("text\n\nand more ")
    (tmp_path / "notes.md").write_text("not read")
    got = sorted((r.doc_id, r.text) for r in objects.load_line_documents(spark, str(tmp_path)).collect())
    assert got == sequential(str(tmp_path))


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(json.dumps({"text": f"{i} " + "y" * (i % 50)}) + ("\n" if i % 3 else "\r\n") for i in range(5000)))
    (tmp_path / "small.jsonl").write_text('{"text": "only"}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = objects.numbered_lines(spark, str(tmp_path), "*.jsonl")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = sorted((r.file, r.line_no, r.line) for r in lines.collect())
        documents = sorted((r.doc_id, r.text) for r in objects.load_line_documents(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with open(tmp_path / "big.jsonl") as f:
        want = [("big.jsonl", n, line.rstrip("\n")) for n, line in enumerate(f, 1)]
    assert got == [*want, ("small.jsonl", 1, '{"text": "only"}')]
    assert documents == sequential(str(tmp_path))


HOSTS = {
    "2130706433": "127.0.0.1", "0x7f.1": "127.0.0.1", "0177.0.0.1": "127.0.0.1", "0x08080808": "8.8.8.8", "8.8.2056": "8.8.8.8", "010.8.8.8": "8.8.8.8", "8.8.8.8.": "8.8.8.8", "0": "0.0.0.0",
}
V4 = "100.64.0.1 100.63.255.255 100.128.0.0 224.0.0.1 223.255.255.255 10.0.0.1 11.0.0.1 9.255.255.255 172.16.0.1 172.32.0.1 172.15.0.1 192.168.1.1 192.169.0.1 169.254.0.1 198.18.0.1 198.20.0.1 198.51.100.7 203.0.113.9 192.0.2.1 255.255.255.255 1.1.1.1".split()
V6 = "::1 :: fe80::1 fc00::1 ff02::1 2606:4700:4700::1111 2001:db8::1 2001:4860:4860::8888 2002:7f00:1:: 2001:10::1 2a00:1450:4001:82a::200e ::ffff:127.0.0.1 ::ffff:8.8.8.8 ::ffff:7f00:1 ::ffff:808:808 0:0:0:0:0:ffff:10.0.0.1".split()


def test_addresses(spark):
    want = {f"http://{h}/": ipaddress.ip_address(a).is_global for h, a in HOSTS.items()}
    want |= {f"https://{a}:8080/x?y": ipaddress.ip_address(a).is_global and not ipaddress.ip_address(a).is_multicast for a in V4}
    want |= {f"http://[{a}]:80/": ipaddress.ip_address(a).is_global and not ipaddress.ip_address(a).is_multicast for a in V6}
    want |= {
        "HTTP://example.com/": True, "https://Example.COM": True, "http://localhost:1/": False, "http://a.localhost./": False, "http://u:p@x.com/": False, "http://u@8.8.8.8/": False, "ftp://x.com/": False, "http://": False,
        "http:///x": False, "http://256.1.1.1/": False, "http://1.2.3.4.5/": False, "http://0x/": False, "http://08.1.1.1/": False, "http://4294967296/": False, "http://x.1/": False, "http://a b/": False, "http://[::1/": False, "http://[2606:4700::1::2]/": False,
        "http://10.0.0.1\\@x.com/": False, "http://[3fff:1::1]/": False, "": False, "http://xn--bcher-kva.example?x": True, "http://1.example.com/": True,
    }
    rows = spark.createDataFrame([(u,) for u in want] + [(None,)], "url string").select("url", is_public_url(F.col("url")).alias("ok")).collect()
    assert {r.url: r.ok for r in rows if r.url is not None} == want
    assert [r.ok for r in rows if r.url is None] == [False]
