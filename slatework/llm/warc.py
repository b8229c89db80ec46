"""WARC archives with the index first: write records, keep their byte ranges, read only what is selected.

``write`` puts every page into gzip-member WARC files, one or more per task, and records file, offset, length,
URL and digest of each record in an index table. Of pages with equal payloads the one with the smallest id
is a response record, the others are revisit records that refer to it and hold no payload. The index is the
commit: files of lost or repeated attempts are in no index and never read. ``read`` sorts the selected
index rows by file and offset, joins neighbouring byte ranges and reads each range once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatework.llm.text import arrow_batches
from slatework.scratch import materialize, scratch_path

#: A new file begins beyond this many bytes.
FILE_BYTES = 1 << 30
#: Ranges with at most this gap are read together, up to this many bytes at once.
GAP, MOST = 64 << 10, 8 << 20
#: Compressed bytes that a task reads.
TASK_BYTES = 64 << 20
#: Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, type string, page string"


@dataclass(frozen=True)
class Archive:
    """Where the files are, and their index: file, offset, length, url, digest, type, page."""

    path: str
    index: DataFrame


def base32(digest: bytes) -> str:
    """The bare upper-case form that WARC digests use."""
    return base64.b32encode(digest).decode()


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page: str, url: str | None, payload: bytes, refers_to: str | None, when: str) -> tuple[bytes, str]:
    """A record as bytes, and its payload digest; a revisit (``refers_to`` given) holds the HTTP head only."""
    digest = base32(hashlib.sha1(payload).digest())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {when}"]
    head += [f"WARC-Target-URI: {_one_line(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(WARC headers, payload) of one record's bytes; the HTTP head is taken off."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _page(urn: str | None) -> str | None:
    return urn[len("<urn:page:") : -1] if urn else None


def roles(pages: DataFrame, least: int, page: str, html: str) -> DataFrame:
    """slot, sha, first: which page's record a payload of at least ``least`` bytes refers to.

    Only ids and digests are shuffled. Counts per digest are combined before the shuffle, so a payload may
    have any number of copies.
    """
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    light = pages.select(F.col(page).alias("page"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size"))
    first = light.where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page").alias("first"), F.count("*").alias("n"))
    return first.where("n > 1").select("sha", "size", "first")


def write(
    pages: DataFrame,
    path: str | None = None,
    least: int = 0,
    when: str = "2024-01-01T00:00:00Z",
    page: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> Archive:
    """A record per row. Payloads of fewer than ``least`` bytes are always response records.

    A null html is an empty payload, a null url leaves the target out. Rows with a null id come after all
    others, so they are responses only among themselves. Of rows with equal id and payload one is
    the response. Extra columns are ignored. An empty table gives an empty archive.
    ``path`` must be a folder that all executors and the driver reach (default: the shared scratch folder).
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    rows = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"))
    shared = materialize(roles(pages, least, page, html), "warc-roles")
    # Decided on light rows, then brought to the payloads by id, which deals evenly whatever the copies.
    slot = F.concat_ws("/", F.coalesce(F.col("page").cast("string"), F.lit("null")), "sha")
    light = rows.select(slot.alias("slot"), "sha", "size").join(shared, ["sha", "size"]).select("slot", "first").distinct()
    light = materialize(light, "warc-decisions")
    held = rows.withColumn("slot", slot).join(light.withColumn("shared", F.lit(True)), "slot", "left")
    held = held.withColumn("turn", F.row_number().over(Window.partitionBy("slot").orderBy("url")))
    own = F.col("page").eqNullSafe(F.col("first")) & (F.col("turn") == 1)
    refers = F.when(F.col("shared") & ~own, F.coalesce(F.col("first").cast("string"), F.concat(F.lit("null-"), "sha")))
    name = F.coalesce(F.col("page").cast("string"), F.concat(F.lit("null-"), "sha"))
    held = held.select(name.alias("page"), "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, (fs, base) = TaskContext.get().partitionId(), pafs.FileSystem.from_uri(path)
        out, at, name = None, 0, ""
        for batch in batches:
            found: list[list] = [[] for _ in range(7)]
            for r in zip(*batch.columns):
                number, link, body, refers_to = (x.as_py() for x in r)
                if out is None or at > FILE_BYTES:
                    if out:
                        out.close()
                    fs.create_dir(base, recursive=True)
                    name, at = f"{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data, digest = record(number, link, body, refers_to, when)
                data = gzip.compress(data, 6, mtime=0)
                out.write(data)
                for x, v in zip(found, (name, at, len(data), link, digest, "response" if refers_to is None else "revisit", number)):
                    x.append(v)
                at += len(data)
            kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds)], [f.split()[0] for f in INDEX.split(", ")])
        if out:
            out.close()

    with arrow_batches(spark, 512):
        return Archive(path, materialize(held.mapInArrow(run, INDEX), "warc-index"))


def _ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Neighbouring index rows that one read serves."""
    some: list[dict] = []
    for r in rows:
        if some and (r["file"] != some[-1]["file"] or r["offset"] - some[-1]["offset"] - some[-1]["length"] > GAP or r["offset"] + r["length"] - some[0]["offset"] > MOST):
            yield some
            some = []
        some.append(r)
    if some:
        yield some


def read(archive: Archive, selected: DataFrame | None = None) -> DataFrame:
    """The selected index rows' records: page, url, type, refers_to, digest (as stored), payload (null in revisits).

    ``selected`` has index columns (default: all). Rows are dealt by file and offset, so a task reads few, long ranges.
    """
    path = archive.path
    rows = (archive.index if selected is None else selected).select("file", "offset", "length")
    # The number of tasks follows the bytes to read, which the few bytes of the index do not show.
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(-(-total // TASK_BYTES), rows.sparkSession.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        name, source = None, None
        for batch in batches:
            for some in _ranges(batch.to_pylist()):
                if some[0]["file"] != name:
                    if source:
                        source.close()
                    name = some[0]["file"]
                    source = fs.open_input_file(f"{base}/{name}")
                start = some[0]["offset"]
                data = source.read_at(some[-1]["offset"] + some[-1]["length"] - start, start)
                found: list[list] = [[] for _ in range(6)]
                for r in some:
                    head, payload = parse(gzip.decompress(data[r["offset"] - start : r["offset"] - start + r["length"]]))
                    response = head["WARC-Type"] == "response"
                    values = (_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], _page(head.get("WARC-Refers-To")), head["WARC-Payload-Digest"][5:], payload if response else None)
                    for x, v in zip(found, values):
                        x.append(v)
                kinds = (*[pa.string()] * 5, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds)], ["page", "url", "type", "refers_to", "digest", "payload"])
        if source:
            source.close()

    return rows.mapInArrow(run, "page string, url string, type string, refers_to string, digest string, payload binary")


def resolve(archive: Archive) -> DataFrame:
    """page, type, refers_to, payload_bytes and payload_digest of every record, from the archives read back.

    Digests and sizes are computed from the payloads read; a revisit's are those of the record it refers to.
    """
    back = read(archive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = [None if p is None else len(p) for p in b.column(4).to_pylist()]
            digest = [d if p is None else base32(hashlib.sha1(p).digest()) for d, p in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(size, pa.int64()), pa.array(digest, pa.string())], ["page", "type", "refers_to", "size", "digest"])

    light = back.select("page", "type", "refers_to", "digest", "payload").mapInArrow(run, "page string, type string, refers_to string, size long, digest string")
    light = materialize(light, "warc-read")
    responses = light.where("type = 'response'").select(F.col("page").alias("to"), F.col("digest").alias("to_digest"), F.col("size").alias("to_size")).distinct()
    revisits = light.where("type = 'revisit'").join(responses, (F.col("refers_to") == F.col("to")) & (F.col("digest") == F.col("to_digest")), "left")
    revisits = revisits.select("page", "type", "refers_to", F.col("to_size").alias("size"), "digest")
    done = light.where("type = 'response'").select("page", "type", "refers_to", "size", "digest").unionByName(revisits)
    return done.select("page", "type", "refers_to", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
