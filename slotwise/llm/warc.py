"""WARC archives, index first.

Writing: payload digests decide which records are responses and which only revisit one; the digest
table alone is shuffled and aggregated, and only payloads that repeat come back by join. Each task
then writes one archive of gzip members to the shared folder and returns an index row per record:
archive, offset, length, url, digest. The index is written out before anything reads it, so a lost
executor cannot make it point elsewhere; an attempt that died leaves an archive that no row names.

A response record holds an HTTP head and the payload. Record ids are UUIDs made from page ids, so that a
revisit can name the record it refers to; rows repeating a page id share one.

Reading: selected index rows are dealt to as many tasks as their bytes ask for, sorted by archive and
offset, near ones are coalesced into one byte-range read of bounded size, and each record is parsed from
its slice.

Null html is an empty payload, a null url leaves its header out, and rows repeating the largest page
id of a payload are all responses. Empty tables make no archives. Archives go through Arrow's file
systems, so the folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.arrow import column
from slotwise.session import scratch_path, ship_package, written

_LONG, _STRING = T.LongType(), T.StringType()
INDEX = T.StructType([T.StructField("archive", _STRING), T.StructField("offset", _LONG), T.StructField("length", _LONG), T.StructField("url", _STRING), T.StructField("payload_digest", _STRING), T.StructField("page_id", _LONG), T.StructField("record_type", _STRING)])
READ = T.StructType([T.StructField("page_id", _LONG), T.StructField("url", _STRING), T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", _LONG), T.StructField("payload_digest", _STRING), T.StructField("record_type", _STRING), T.StructField("refers_to", _LONG)])


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):  # Spark also writes file:/x for file:///x
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def _header(text: str) -> str:
    return re.sub(r"[\r\n]+", " ", text)


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. A revisit has no block; its headers say how long its payload was."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = b"" if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """A READ row from one gzip member; the digest and length of a response are those of what was read."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    _, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda name: int(fields[name]) if name in fields else None
    revisit = fields["WARC-Type"] == "revisit"
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    digest = stated if revisit else hashlib.sha1(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"digest of {fields['WARC-Record-ID']} is {digest}, not {stated}")
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload": None if revisit else payload, "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID")}


def plan_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", least_bytes: int = 1000) -> DataFrame:
    """pages as page_id, url, html with payload_digest and refers_to (null for responses)."""
    p = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("payload_digest", F.sha1(F.col("html").cast("binary"))).withColumn("_bytes", F.octet_length("html").cast("long"))
    first = p.where(F.col("_bytes") >= least_bytes).groupBy("payload_digest", "_bytes").agg(F.max("page_id").alias("_response"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = p.join(first, ["payload_digest", "_bytes"], "left")
    return joined.select("page_id", "url", "html", "payload_digest", F.when(F.coalesce(F.col("page_id"), F.lit(-(1 << 62))) < F.col("_response"), F.col("_response")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", **columns: object) -> DataFrame:
    """Writes archives of all pages under folder (default: a new one in the shared folder) and returns the index, written out too."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = folder or scratch_path(spark, "warc")
    planned = plan_revisits(pages, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _filesystem(folder)
        out, at = None, 0
        name = f"{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                rows: list[list] = [[] for _ in INDEX]
                for row in zip(*[column(batch, c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to")], strict=True):
                    page, url, html, digest, refers = row
                    if out is None:
                        files.create_dir(top, recursive=True)
                        out = files.open_output_stream(f"{top}/{name}", compression=None)
                    member = record(page, url, html.encode("utf-8"), digest, refers, refers is not None, date)
                    out.write(member)
                    for to, x in zip(rows, (f"{folder}/{name}", at, len(member), url, digest, page, "response" if refers is None else "revisit"), strict=True):
                        to.append(x)
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for r, f in zip(rows, INDEX, strict=True)], names=INDEX.names)
        finally:
            if out is not None:
                out.close()

    return written(planned.mapInArrow(run, INDEX), "warc-index")


def read_warc(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records that index rows name. Neighbours up to `gap` bytes apart share a read of at most `most` bytes or one record."""
    ship_package(index.sparkSession)
    wanted = index.select("archive", "offset", "length").withColumn("_part", F.expr(f"offset div {most}"))
    tasks = -(-(index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]) // (4 * most))
    parts = wanted.repartition(max(1, tasks), "archive", "_part").sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int]] = []
        where = None

        def flush() -> pa.RecordBatch:
            files, path = _filesystem(where)
            begin = group[0][0]
            with files.open_input_file(path) as f:
                data = f.read_at(max(a + n for a, n in group) - begin, begin)
            rows = [parse(data[a - begin : a - begin + n]) for a, n in group]
            group.clear()
            return pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)

        for batch in batches:
            for archive, offset, length in zip(*[column(batch, c).to_pylist() for c in ("archive", "offset", "length")], strict=True):
                if group and (archive != where or offset - group[-1][0] - group[-1][1] > gap or offset + length - group[0][0] > most):
                    yield flush()
                where = archive
                group.append((offset, length))
        if group:
            yield flush()

    return parts.mapInArrow(run, READ)


_READ_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
