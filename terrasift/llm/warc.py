"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page id into shards whose bounds come from exact byte counts, so they depend on the rows alone.
A task writes its shards one after another, each record a gzip member of its own, and starts a new file when the current
one has reached the compressed size. Files are written under a temporary name and renamed when complete; the manifest,
written last, names the files that count. The same rows give the same bytes, so a repeated task replaces equal files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.session import cut, scratch

_NAMES = uuid.UUID("6f9b0c52-32a5-4c39-9d4c-0b4f7f1f2f55")
SMALL = 8 << 20
MANIFEST = "shard int, seq int, name string, bytes long, records long, sha1 string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int | None, str | None] | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit (``refers``: page id and url of the response) keeps the HTTP header and leaves the payload out."""
    d = digest(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers else head + payload
    uri = lambda u: quote(u or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id, d)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {uri(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{d}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers[0], d)}", f"WARC-Refers-To-Target-URI: {uri(refers[1])}"]
        if refers[0] is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers[0]}")
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def shard_bounds(df: DataFrame, key: str, size: str, target: int, fan: int = 1024) -> list[int]:
    """Upper bounds (inclusive) of key ranges of about ``target`` bytes, by exact counts: ranges that are too large are cut finer."""

    def cells(lo: int, hi: int) -> list[tuple[int, int, int]]:
        width = max(1, -(-(hi - lo + 1) // fan))
        cell = F.floor((F.col(key).cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("long")
        rows = df.filter(F.col(key).between(lo, hi)).groupBy(cell.alias("c")).agg(F.sum(size).alias("s")).collect()
        out = []
        for r in sorted(rows):
            a, b = lo + r.c * width, min(hi, lo + (r.c + 1) * width - 1)
            out += cells(a, b) if r.s > 4 * target and b > a else [(a, b, r.s)]
        return out

    ends = df.agg(F.min(key), F.max(key)).first()
    if ends[0] is None:
        return []
    bounds, held = [], 0
    for _, b, s in cells(ends[0], ends[1]):
        held += s
        if held >= target:
            bounds.append(b)
            held = 0
    return bounds


def planned(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, own, ref_id, ref_url): of equal payloads the row with the largest id is the response, the others
    refer to it. Payloads are equal if both their SHA-1 and SHA-256 are. Of repeats of the response's id the writer keeps one.

    The table of repeated payloads is broadcast up to SMALL bytes, so the pages are shuffled only once, to their shards.
    """
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumn("own", F.unhex(F.concat(F.sha1(F.col("html").cast("binary")), F.sha2(F.col("html").cast("binary"), 256))))
    twice = rows.groupBy("own").agg(F.max(F.struct("page_id", "url")).alias("r"), F.count(F.lit(1)).alias("c"), F.max(F.octet_length("url")).alias("long")).filter("c > 1")
    twice = cut(twice.select("own", F.col("r.page_id").alias("ref_id"), F.col("r.url").alias("ref_url"), F.lit(True).alias("copies"), "long"))
    held = twice.agg(F.sum(F.coalesce("long", F.lit(0)) + 80)).first()[0] or 0
    twice = twice.drop("long")
    return rows.join(F.broadcast(twice) if held <= SMALL else twice, "own", "left")


def write(pages: DataFrame, out: str, *, shard_bytes: int = 256 << 20, file_bytes: int = 64 << 20, level: int = 4, date: str = "1970-01-01T00:00:00Z", **columns: str) -> DataFrame:
    """Write the archives and the manifest to the shared folder ``out``; the manifest's rows (MANIFEST) are returned.

    Rows without an id are sorted first. A null payload is empty; control characters and spaces of an url are escaped, a null
    url is about:blank. The date is given, not the clock's, so the bytes can be repeated. Of several rows with the response's id and
    payload the first one is the response.
    """
    rows = planned(pages, **columns)
    raw = pages.select(F.col(columns.get("id", "page_id")).cast("long").alias("page_id"), (F.coalesce(F.octet_length(columns.get("html", "html")), F.lit(0)) + 600).cast("long").alias("size"))
    bounds = np.array(shard_bounds(raw, "page_id", "size", shard_bytes), np.int64)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, page_id.to_numpy(np.int64)).astype("int32"))

    shard = shard_of(F.coalesce("page_id", F.lit(-(2**63)))) if len(bounds) else F.lit(0)
    dealt = rows.withColumn("shard", shard).repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "own")

    def work(batches):
        fs, base = pafs.FileSystem.from_uri(out) if "://" in out or out.startswith("file:") else (pafs.LocalFileSystem(), out)
        fs.create_dir(f"{base}/_temporary", recursive=True)
        done, state, previous = [], None, None

        def close(s):
            s["file"].close()
            name = f"{s['shard']:06d}-{s['seq']:05d}.warc.gz"
            fs.move(s["tmp"], f"{base}/{name}")
            done.append((s["shard"], s["seq"], name, s["bytes"], s["records"], s["sha"].hexdigest()))

        for b in batches:
            for shard, page_id, url, html, own, copies, ref_id, ref_url in zip(*(b.column(n).to_pylist() for n in ("shard", "page_id", "url", "html", "own", "copies", "ref_id", "ref_url")), strict=True):
                if state and (state["shard"] != shard or state["bytes"] >= file_bytes):
                    close(state)
                    state = {"seq": state["seq"] + 1} if state["shard"] == shard else None
                if state is None or "file" not in state:
                    tmp = f"{base}/_temporary/{uuid.uuid4().hex}"
                    state = {"shard": shard, "seq": state["seq"] if state else 0, "tmp": tmp, "file": fs.open_output_stream(tmp, compression=None), "bytes": 0, "records": 0, "sha": hashlib.sha1()}
                first = ref_id == page_id and previous != (page_id, own)
                previous = page_id, own
                refers = (ref_id, ref_url) if copies and not first else None
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(page_id, url, html.encode(), refers, date)) + z.flush()
                state["file"].write(member)
                state["sha"].update(member)
                state["bytes"] += len(member)
                state["records"] += 1
        if state:
            close(state)
        cols = list(zip(*done, strict=True)) or [()] * 6
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["shard", "seq", "name", "bytes", "records", "sha1"])

    dealt.mapInArrow(work, MANIFEST).write.mode("overwrite").parquet(f"{out}/manifest")
    return pages.sparkSession.read.parquet(f"{out}/manifest")


def _records(stream):
    """(headers, block) of each record of an open archive, one at a time."""
    z = gzip.GzipFile(fileobj=stream)
    reader = io.BufferedReader(z, 1 << 16)
    while True:
        line = reader.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := reader.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, reader.read(int(headers["content-length"]))


def read(spark, out: str) -> DataFrame:
    """The records of all files of the manifest, with digests checked: page_id, url, record_type, payload_digest, payload_bytes,
    refers_to, html (null for a revisit). A file whose bytes differ from the manifest's raises."""
    files = spark.read.parquet(f"{out}/manifest").select("name", "sha1")
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, html string"

    def work(batches):
        fs, base = pafs.FileSystem.from_uri(out) if "://" in out or out.startswith("file:") else (pafs.LocalFileSystem(), out)
        for b in batches:
            for name, sha1 in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = hashlib.sha1()
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    while part := f.read(1 << 20):
                        seen.update(part)
                if seen.hexdigest() != sha1:
                    raise ValueError(f"{name} differs from the manifest")
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    rows: list[tuple] = []
                    held = 0
                    for h, block in _records(f):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        if digest(block) != h["warc-block-digest"][5:] or h["warc-type"] == "response" and digest(payload) != h["warc-payload-digest"][5:]:
                            raise ValueError(f"a record of {name} differs from its digest")
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        page, ref = h.get("x-page-id"), h.get("x-refers-to-page-id")
                        rows.append((page and int(page), h["warc-target-uri"], h["warc-type"], h["warc-payload-digest"][5:], size, ref and int(ref), payload.decode() if h["warc-type"] == "response" else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    def _batch(rows):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        cols = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "html"])

    # one part per file, which Spark must not put together: a row is a name, the work is a file
    return files.repartition(max(1, files.count()), "name").mapInArrow(work, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), out, shard_bytes=16 << 20, file_bytes=4 << 20)
    return read(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Digests as numbers would need base32, which SQL lacks: hexadecimal SHA-1 is turned into it bit by bit.
SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM r)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, i * 5 + j + 1, 1) AS INT) * (16 >> j))) AS INT) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM b"""
