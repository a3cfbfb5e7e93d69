"""WARC archives, index first.

Writing: each task appends gzip members, one record each, to archives of its own in the shared
folder and returns an index row per record: file, offset, length, URL, digest. A payload that occurs
again becomes a revisit record, which names the response and keeps its HTTP headers, not its body.
Reading: index rows of the wanted records are grouped by stretches of a file, sorted and coalesced
into byte ranges; only these are read.

Files get a new name at every attempt and the index names those of the attempt that counted, so that
repeated tasks are harmless. Of records with equal payloads, that with the largest page_id is the
response. The digests that repeat are looked up in a table that is broadcast while small; of a larger one,
the much repeated digests are. Reading is dealt to tasks by the archives' bytes. Cases: null html is an empty payload; a null page_id is the smallest; rows that
repeat the response's page_id and payload are responses too; null URLs are empty; an empty table
writes nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words

#: Smaller payloads are always written out.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
#: Ranges that are this near are read as one; ranges are read up to the second number of bytes.
GAP, RANGE_BYTES = 64 << 10, 4 << 20
#: Bytes of archive for which one reading task is made.
TASK_BYTES = 8 << 20
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"
DATE = "2024-01-01T00:00:00Z"


def _uri(page_id: int | None) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_uri(page_id)}>", f"WARC-Date: {DATE}", "WARC-Target-URI: " + " ".join(url.split()), f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_uri(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + press.flush()


def parse(member: bytes) -> dict:
    """Headers and payload of a record, checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda uri: int(x) if (x := uri.strip("<>").rpartition(":")[2]) else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None}


def _write(folder: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        out, uri, at = None, "", 0
        try:
            for rb in words.batches(rows, "html", 16 << 20):
                found = []
                for r in rb.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        uri, at = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        system, path = shared.open_fs(uri)
                        out = system.open_output_stream(path, compression=None)
                    data = record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"], r["record_type"] == "revisit")
                    out.write(data)
                    found.append((r["page_id"], uri, at, len(data), r["url"], r["digest"], r["record_type"], r["refers_to"]))
                    at += len(data)
                if out is not None:
                    out.flush()
                names = [x.split()[0] for x in INDEX.split(", ")]
                kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all rows; the index, stored."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    again = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = F.col("first")
    revisit = first.isNotNull() & ~F.col("page_id").eqNullSafe(first)
    found = shared.joined(rows, shared.stored(spark, again, "repeated"), "digest", "n", "left")
    typed = found.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, first).alias("refers_to"))
    return shared.stored(spark, typed.mapInArrow(_write(shared.shared_dir(spark, "warc")), INDEX), "warc-index")


def ranges(offsets: list[tuple[int, int]], gap: int = GAP, most: int = RANGE_BYTES) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) coalesced into (begin, end, which)."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (at, length) in enumerate(offsets):
        if out and at - out[-1][1] <= gap and at + length - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(out[-1][1], at + length), [*out[-1][2], i])
        else:
            out.append((at, at + length, [i]))
    return out


def _read(payloads: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        for rb in rows:
            for r in rb.to_pylist():
                system, path = shared.open_fs(r["file"])
                wanted = [(x["offset"], x["length"]) for x in r["records"]]
                with system.open_input_file(path) as src:
                    for begin, end, which in ranges(wanted):
                        src.seek(begin)
                        data = src.read(end - begin)
                        got = [parse(data[wanted[i][0] - begin : wanted[i][0] - begin + wanted[i][1]]) for i in which]
                        cols = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
                        arrays = [pa.array([g[k] for g in got], t) for k, t in cols.items()]
                        if payloads:
                            arrays.append(pa.array([g["payload"] for g in got], pa.binary()))
                        yield pa.RecordBatch.from_arrays(arrays, [*cols, *["payload"] * payloads])

    return run


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records that the index rows name. payloads: also the responses' bodies (of revisits, empty)."""
    stretch = F.expr(f"offset div {RANGE_BYTES}")
    tasks = -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES) or 1
    dealt = index.select("file", stretch.alias("stretch"), "offset", "length").repartition(tasks, "file", "stretch")
    groups = dealt.groupBy("file", "stretch").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return groups.select("file", "records").mapInArrow(_read(payloads), kinds + (", payload binary" if payloads else ""))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages and read all records back."""
    return read_records(write_archives(spark, pages))
