"""WARC archives: written with an index of offsets, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, lean, materialize

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"
#: Bytes of archives that one task reads, about.
READ_BYTES = 4 << 20
INDEX = "record_key long, url string, record_type string, digest string, file string, offset long, length long"


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path with a scheme, and the path within it."""
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def clean(value: str | None) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value or "")


def record_id(key: int | None) -> str:
    return f"<urn:page:{'none' if key is None else key}>"


def record(kind: str, key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit holds the HTTP head alone, whose Content-Length is still the payload's."""
    block = HTTP % len(payload) + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Target-URI: {clean(url)}", "WARC-Date: 2000-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record, with its payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line, "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    key = lambda name: None if name not in fields or fields[name] == record_id(None) else int(fields[name][len("<urn:page:") : -1])
    return {"key": key("WARC-Record-ID"), "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": key("WARC-Refers-To"), "bytes": size, "payload": payload if fields["WARC-Type"] == "response" else None}


def plan_records(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """``pages`` with record_type and refers_to: first holders of a payload are responses, others revisit them.

    Only keys, sizes and digests are grouped; a payload that many pages share meets in one minimum.
    """
    digest = F.sha1(F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8"))
    size = F.octet_length(F.coalesce(F.col(payload), F.lit("")))
    rows = pages.withColumn("_digest", digest)
    copies = pages.select(F.col(key).alias("_k"), digest.alias("_digest"), size.alias("_size")).where(F.col("_size") >= least)
    first = copies.groupBy("_digest").agg(F.min("_k").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null").select("_digest", "_first")
    marked = rows.join(first, "_digest", "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col(key)), F.col("_first"))
    return marked.withColumn("_refers", refers).drop("_first", "_digest")


def write_archives(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write one record for each row of ``pages`` to gzip archives below ``root``; returns their index (INDEX).

    Every task writes a file of its own name, member by member, and reports the offset and length of each
    record; the index is kept as Parquet, so only files of tasks that Spark has committed are ever
    named in it and a repeated task leaves at most an unnamed file. Null payload is empty, null url an empty
    header; rows that share the smallest key of a payload are all responses; a null key is written as
    none; extra columns are ignored; an empty table gives an empty index.
    """
    planned = plan_records(pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.col(payload).alias("p")), "k", "p", least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        fs.create_dir(base, recursive=True)
        name, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                rows = []
                for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                    for r in part.to_pylist():
                        body = (r["p"] or "").encode()
                        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                        kind = "response" if r["_refers"] is None else "revisit"
                        member = gzip.compress(record(kind, r["k"], r["u"], body, digest, r["_refers"]), 4, mtime=0)
                        out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                        out.write(member)
                        rows.append((r["k"], r["u"], kind, digest, name, offset, len(member)))
                        offset += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return materialize(planned.select("k", "u", "p", "_refers").mapInArrow(lean(run), INDEX), "warc-index")


def coalesce_ranges(index: DataFrame, gap: int = 4096, most: int = 4 << 20) -> DataFrame:
    """(file, start, stop, members) of sorted neighbouring records no more than ``gap`` bytes apart, about ``most`` bytes each.

    Repeated index rows count once; an empty index gives none; other columns than file, offset and length are ignored."""
    order = Window.partitionBy("file").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    cut = before.isNull() | (F.col("offset") - before > gap) | (F.floor(F.col("offset") / most) != F.floor(F.lag("offset").over(order) / most))
    runs = index.select("file", "offset", "length").distinct().withColumn("cut", cut.cast("int")).withColumn("run", F.sum("cut").over(order))
    return runs.groupBy("file", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("members"))


def read_archives(index: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """Records that ``index`` selects, read back from the archives below ``root``: one read for each coalesced range.

    Returns key, record_type, digest, refers_to, payload_bytes, digest_ok (the payload's own digest,
    null for revisits) and payload binary (null for revisits, or for all if ``payloads`` is false). Ranges are dealt to tasks by the bytes
    that there are to read. Index rows that repeat a record are read once; an empty index gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        names = ["key", "record_type", "digest", "refers_to", "payload_bytes", "digest_ok", "payload"]
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        for batch in batches:
            for span in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                with fs.open_input_file(f"{base}/{span['file']}") as f:
                    raw = f.read_at(span["stop"] - span["start"], span["start"])
                rows = []
                for m in span["members"]:
                    at = m["offset"] - span["start"]
                    r = parse(gzip.decompress(raw[at : at + m["length"]]))
                    own = None if r["payload"] is None else base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == r["digest"] and len(r["payload"]) == r["bytes"]
                    rows.append((r["key"], r["type"], r["digest"], r["refers_to"], r["bytes"], own, r["payload"] if payloads else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    total = index.agg(F.sum("length")).first()[0] or 0
    spans = coalesce_ranges(index).select("file", "start", "stop", "members").repartition(1 + total // READ_BYTES, "file", "start")
    return spans.mapInArrow(lean(run), "key long, record_type string, digest string, refers_to long, payload_bytes long, digest_ok boolean, payload binary")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write archives to a fresh folder of the shared storage and read every record back."""
    root = fresh_path(pages.sparkSession, "warc")
    index = write_archives(pages, root, key, url, payload, least)
    return read_archives(index, root, payloads=False)
