"""Deterministic sharded WARC writer, and the reader of what it wrote.

Shard bounds come from an exact histogram of payload bytes over the key range
(the boundary bins are refined, as ids may be uneven), so the same table gives
the same shards, files and bytes on every run, however Spark deals its rows.
Each task sorts its records by key and rolls to a new file when the compressed
size of the current one reaches a limit.  Record headers, ids and digests are
regenerated from the rows; every record is a gzip member of its own.  Files are
committed through temporary names and a manifest (:mod:`.files`).

Of records with equal payloads of some length the one with the largest key is
written whole; the others are revisit records that carry its HTTP header (with
the payload length), the payload digest and a reference.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage
from .files import TempFiles, commit, one_task_per_file, open_fs

SHARD_BYTES = 32 << 20    # payload of a shard
FILE_BYTES = 16 << 20     # compressed size at which a file is closed
MIN_REVISIT = 1000        # shorter payloads are always written whole
READ_BYTES = 1 << 20
BIN_BITS = 10             # a level of the key histogram has 2^BIN_BITS bins
DATE = "2000-01-01T00:00:00Z"  # records carry a fixed date unless one is given

# fixed texts of the format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_SCHEMA = "tmp string, name string, records long, bytes long, sha1 string"


def shard_bounds(rows: DataFrame, shard_bytes: int) -> list[int]:
    """Ascending keys at which shards after the first begin, from ``rows (key, bytes)``.

    Bins of equal key width are summed; bins above the shard size are cut into finer
    bins until single keys are left.  Only bins reach the driver: 2^BIN_BITS for the
    range and for each bin above the shard size.
    """
    r = rows.agg(F.min("key"), F.max("key")).first()
    if r[0] is None:
        return []
    todo, bins = [(r[0], r[1] - r[0] + 1)], []
    while todo:
        low, width = todo.pop()
        step = max(1, -(-width >> BIN_BITS))
        part = rows.filter((F.col("key") >= low) & (F.col("key") <= low + width - 1))
        b = F.floor((F.col("key") - F.lit(low)) / F.lit(step)) if step > 1 else F.col("key") - F.lit(low)
        for x in part.groupBy(b.cast("long").alias("b")).agg(F.sum("bytes").alias("n")).collect():
            at = low + x["b"] * step
            if x["n"] > shard_bytes and step > 1:
                todo.append((at, min(step, low + width - at)))
            else:
                bins.append((at, x["n"]))
    bounds, size = [], 0
    for at, n in sorted(bins):
        if size and size + n > shard_bytes:
            bounds.append(at)
            size = 0
        size += n
    return bounds


def _payload(pages: DataFrame, payload: str):
    return F.coalesce(F.encode(F.col(f"`{payload}`").cast("string"), "UTF-8"), F.encode(F.lit(""), "UTF-8"))


def revisits(digests: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``digests (key, digest, bytes)`` -> ``(key, digest, last)`` of the payloads that occur
    more than once: ``last`` is the largest key, whose record is written whole."""
    groups = digests.filter(F.col("bytes") >= min_revisit).groupBy("digest").agg(
        F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1 and last is not null")
    return digests.join(groups, "digest").select("key", "digest", "last").distinct()


def _record(kind: str, key, url: str | None, payload: bytes, number: int, refers, date: str) -> bytes:
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(payload)}\r\n\r\n").encode()
    if kind == "response":
        block += payload
    name = "none" if key is None else str(key)
    # same key, url and place among the records of the key: same record id
    record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}|{number}|{url or ''}")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date),
            ("WARC-Target-URI", (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")),
            ("WARC-Page-Key", name),
            ("WARC-Payload-Digest", f"sha1:{sha}"),
            ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")]
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE),
                 ("WARC-Refers-To-Key", "none" if refers is None else str(refers))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in head], b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without time stamp or name."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url",
                   payload: str = "html", min_revisit: int = MIN_REVISIT,
                   shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
                   date: str = DATE, level: int = 6) -> DataFrame:
    """Write one record per row and return the manifest (name, records, bytes, sha1 of
    the file).  Files are named by shard and place in the shard.

    Defined cases: a null or empty payload is a record with an empty payload; a null
    url is about:blank; null keys come first, in the first shard, and revisit a
    keyed record with their payload if there is one (without one they are written
    whole); among rows that share key and payload the first is the response and the
    others revisit it; an empty table writes no file.  Other columns are not read.
    """
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("key"),
                        F.col(f"`{url}`").cast("string").alias("url"), _payload(pages, payload).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = stage(rows.select("key", "digest", F.octet_length("payload").cast("long").alias("bytes")),
                   "warc-digests")
    bounds = shard_bounds(narrow.filter("key is not null").groupBy("key").agg(
        F.sum("bytes").alias("bytes")), shard_bytes)
    # number of bounds at or below the key
    edges = F.from_json(F.lit(str(bounds)), "array<long>")
    shard = F.coalesce(F.size(F.filter(edges, lambda x: x <= F.col("key"))), F.lit(0)).cast("int")
    # payloads are shuffled once: what is known of a shared payload travels to the
    # same place as a row of its own, just before the records it concerns
    marks = revisits(narrow, min_revisit).select(
        "key", "digest", F.lit(0).alias("kind"), "last", F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("payload"))
    records = rows.select("key", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("last"),
                          "url", "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        temp, done, open_ = TempFiles(folder), [], None
        key_now, number, refers = object(), 0, [object()] * 4

        def close(f):
            f["out"].close()
            done.append({"tmp": f["tmp"], "name": f["name"], "records": f["records"], "bytes": f["bytes"],
                         "sha1": f["sha1"].hexdigest()})

        for b in batches:
            for row in zip(*b.columns):  # one payload at a time
                at, k, digest, mark, last, url, body = (x.as_py() for x in row)
                if k != key_now:
                    key_now, number = k, 0
                if mark == 0:
                    refers[:] = [k, digest, last, False]
                    continue
                kind, to = "response", None
                if refers[:2] == [k, digest]:
                    if k == refers[2] and not refers[3]:
                        refers[3] = True
                    else:
                        kind, to = "revisit", refers[2]
                data = gzip_member(_record(kind, k, url, body, number, to, date), level)
                number += 1
                if open_ and (open_["shard"] != at or open_["bytes"] + len(data) > file_bytes):
                    close(open_)
                    open_ = {"shard": at, "n": open_["n"] + 1} if open_["shard"] == at else None
                if not open_ or "out" not in open_:
                    n = open_["n"] if open_ else 0
                    tmp, out = temp.create()
                    open_ = {"shard": at, "n": n, "tmp": tmp, "out": out, "records": 0, "bytes": 0,
                             "sha1": hashlib.sha1(), "name": f"pages-{at:06d}-{n:04d}.warc.gz"}
                open_["out"].write(data)
                open_["sha1"].update(data)
                open_["records"] += 1
                open_["bytes"] += len(data)
        if open_:
            close(open_)
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema(
            [("tmp", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()),
             ("sha1", pa.string())]))

    ordered = marks.unionByName(records).select(shard.alias("shard"), "*") \
        .repartitionByRange(len(bounds) + 1, "shard").sortWithinPartitions(
        "shard", F.col("key").asc_nulls_first(), "digest", "kind", "url")
    return commit(ordered.mapInArrow(write, FILE_SCHEMA), folder)


def _members(stream) -> Iterator[bytes]:
    """Decompressed gzip members of a stream."""
    z, parts, data = zlib.decompressobj(31), [], stream.read(READ_BYTES)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data = z.unused_data or stream.read(READ_BYTES)
            z, parts = zlib.decompressobj(31), []
        else:
            data = stream.read(READ_BYTES)
    if parts and any(parts):
        raise EOFError("the last record is cut off")


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """-> WARC headers, HTTP headers, payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError(f"not a record: {version[:20]!r}")
    warc = dict(x.decode().split(": ", 1) for x in lines)
    block = rest[:int(warc["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("wrong record length")
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    if warc["WARC-Block-Digest"] != f"sha1:{digest}":
        raise ValueError("wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.decode().split(": ", 1) for x in http.split(b"\r\n")[1:]), payload


def read_archives(spark: SparkSession, folder: str, files: DataFrame, payload: bool = False) -> DataFrame:
    """Records of the files of a manifest: ``key``, ``url``, ``record_type``,
    ``payload_bytes`` and ``payload_digest`` (of the full payload; checked against the
    bytes of responses), ``refers_to`` and, with ``payload=True``, the payload."""
    schema = "key long, url string, record_type string, payload_bytes long, payload_digest string, " \
             "refers_to long" + ", payload binary" * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        names = [x.split(" ")[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def number(text: str | None):
            return None if text in (None, "none") else int(text)

        for b in batches:
            for name in b.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for record in _members(f):
                        warc, http, body = parse_record(record)
                        digest = base64.b32decode(warc["WARC-Payload-Digest"][5:]).hex()
                        if warc["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError("wrong payload digest")
                        rows.append((number(warc["WARC-Page-Key"]), warc["WARC-Target-URI"], warc["WARC-Type"],
                                     int(http["Content-Length"]), digest,
                                     number(warc.get("WARC-Refers-To-Key")), body)[:len(names)])
                        if len(rows) == 1000:
                            yield _table(rows, names, types)
                            rows = []
                if rows:
                    yield _table(rows, names, types)

    return one_task_per_file(files.select("name")).mapInArrow(read, schema)


def _table(rows: list, names: list, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
