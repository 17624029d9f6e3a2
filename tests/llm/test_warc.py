import gzip
import hashlib
import os

from embra.llm import warc

SCHEMA = "page_id long, url string, html string, key string, digest string, shard int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "d", 1) for i, u, h in rows], SCHEMA)


def cases():
    big = "é" * 600  # 1200 bytes
    rows = [(i * 3, f"http://x/{i}", f"<p>{i}</p>" * (i + 1)) for i in range(60)]
    rows += [(1000 + i, f"http://c/{i}", big) for i in range(20)]
    rows += [(1019, "http://again", big), (None, "http://none", big), (None, None, "null key"),
             (2000, None, None), (2001, "http://e", ""), (2002, "http://e2", ""), (2003, "a\r\nb", "x" * 999),
             (2004, "u", "x" * 999), (2005, "u", "y" * 1000), (2006, "u", "y" * 1000), (2007, "long", "z " * 300000),
             (None, "n1", "n" * 2000), (None, "n2", "n" * 2000)]
    return rows


def expected(rows):
    last, n = {}, {}
    for k, _, h in rows:
        if len((h or "").encode()) >= 1000:
            n[h] = n.get(h, 0) + 1
            if k is not None:
                last[h] = max(last.get(h, k), k)
    out, whole = [], set()
    for k, _, h in rows:
        data = (h or "").encode()
        kind, to = "response", None
        if n.get(h, 0) > 1 and h in last:
            if k == last[h] and h not in whole:
                whole.add(h)
            else:
                kind, to = "revisit", last[h]
        out.append((k, len(data), hashlib.sha1(data).hexdigest(), kind, to))
    return sorted(out, key=str)


def records(df):
    return sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                   for r in df.collect()), key=str)


def files_of(folder):
    return {n: open(f"{folder}/{n}", "rb").read() for n in os.listdir(folder) if n.endswith(".gz")}


def test_round_trip_with_nulls_repeats_and_small_payloads(spark, tmp_path):
    rows = cases()
    folder = str(tmp_path / "w")
    files = warc.write_archives(pages(spark, rows), folder, shard_bytes=5000, file_bytes=1500)
    assert records(warc.read_archives(spark, folder, files)) == expected(rows)
    found = files_of(folder)
    manifest = {r["name"]: r for r in files.collect()}
    assert set(found) == set(manifest) and len(found) > 5
    for name, data in found.items():
        assert hashlib.sha1(data).hexdigest() == manifest[name]["sha1"]
        assert len(data) == manifest[name]["bytes"]
        assert len(data) <= 1500 or manifest[name]["records"] == 1
        text = gzip.decompress(data)  # any gzip reader takes the members one after another
        assert text.count(b"WARC/1.1\r\n") == manifest[name]["records"]
    assert sum(r["records"] for r in manifest.values()) == len(rows)


def test_same_bytes_whatever_the_partitioning(spark, tmp_path):
    rows = cases()
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write_archives(pages(spark, rows).repartition(1), a, shard_bytes=5000)
    warc.write_archives(pages(spark, rows[::-1]).repartition(7), b, shard_bytes=5000)
    assert files_of(a) == files_of(b)


def test_payloads_come_back(spark, tmp_path):
    folder = str(tmp_path / "w")
    files = warc.write_archives(pages(spark, [(1, "u", "<b>é\r\n\r\n</b>"), (2, None, None)]), folder)
    got = {r["key"]: (r["url"], bytes(r["payload"])) for r in
           warc.read_archives(spark, folder, files, payload=True).collect()}
    assert got == {1: ("u", "<b>é\r\n\r\n</b>".encode()), 2: ("about:blank", b"")}


def test_bounds_refine_uneven_keys(spark):
    rows = spark.createDataFrame([(k, 10) for k in range(1000)] + [(10**12, 10)], "key long, bytes long")
    bounds = warc.shard_bounds(rows, 100)
    assert len(bounds) == 100 and bounds[:3] == [10, 20, 30] and 999 < bounds[-1] <= 10**12
    assert warc.shard_bounds(rows.limit(0), 100) == []


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "w")
    files = warc.write_archives(pages(spark, []), folder)
    assert files.count() == 0 and warc.read_archives(spark, folder, files).count() == 0
