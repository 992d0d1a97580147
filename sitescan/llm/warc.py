"""WARC archives: a writer that stores equal payloads once, and a reader that splits archives at any byte.

Each record is a gzip member of its own. The writer's tasks put archives, under names of their own attempt, into a folder
that all executors share; only the files of attempts that ended well are listed in the manifest, so a lost or repeated
task leaves nothing behind that is read. The reader cuts the listed files into byte ranges. A task scans its range for the
gzip magic, takes a candidate for a member only if its first bytes decode to a WARC version line and the whole member
decodes with a right checksum, and owns the records that start inside its range; the last may end beyond it. A payload may itself hold
archives, whose members look like records where a range starts inside it; so of archives with more than one range it is first found where
the records of each range end (a number for each range), and a range is read only from where all records that start before it end.

A null page is an empty payload, a null url leaves out the target, a null page_id its header. Rows that repeat a page_id
give a record each. Length and digest of a response are those of the payload that was read. The writer keeps a page's id in a header of its
own, X-Page-ID; such a record whose other headers do not fit its payload stops the job with its name. Line breaks in a url are
percent-encoded. Columns other than page_id, url and html are ignored; no rows give an empty archive.

The reader takes archives of any writer: record ids are text, header names have any case and may be folded, digests any algorithm, and
records of all types are returned. `intact` says whether a record is whole and has the payload that its digest stands for (null where
that cannot be told: no digest, one of an unknown algorithm, or a record that says that it was cut off).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, written

MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
_HEAD_END = re.compile(rb"\r?\n\r?\n")
#: Digests in hexadecimal or base 32, by algorithm.
_DIGESTS = {"sha1", "sha224", "sha256", "sha384", "sha512", "md5"}
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, record_id string, refers_to_id string, intact boolean, payload binary"


def plan_records(pages: DataFrame, least_bytes: int = 1000, most_sent: int = 200_000) -> DataFrame:
    """page_id, url, payload, payload_digest (SHA-1, hexadecimal), refers_to: of equal payloads of at least `least_bytes` bytes the
    one with the largest page_id is kept, the others refer to it.

    Only the digests that occur more than once travel: up to `most_sent` of them (48 bytes each) to the pages, more by a join."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    # counted before the shuffle, so a payload that a third of all pages share is one row; a join back is split by Spark
    shared = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    shared = written(shared.filter("n > 1").drop("n"), "shared")
    if shared.count() <= most_sent:
        shared = F.broadcast(shared)
    rows = rows.join(shared, "payload_digest", "left")
    return rows.select("page_id", "url", "payload", "payload_digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = lambda i: f"<urn:uuid:{uuid.uuid4() if i is None else uuid.uuid5(uuid.NAMESPACE_OID, f'page {i}')}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {name(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers)}", f"X-Refers-To-Page-ID: {refers}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str, roll_bytes: int = 1 << 30) -> DataFrame:
    """Write the rows of `plan_records` as *.warc.gz under `folder`; returns the manifest (path, bytes, records), read back.

    `folder` is a URI that pyarrow.fs opens on every executor (file on a shared mount, hdfs, s3, gs)."""
    spark = records.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)  # its path on that file system
        fs.create_dir(root, recursive=True)
        out, path, size, count = None, "", 0, 0
        done = []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                page, url, payload, digest, refers = (x.as_py() for x in row)
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, count = f"{folder}/{name}", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = gz.compress(_record(page, url, payload, digest, refers)) + gz.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= roll_bytes:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["path", "bytes", "records"])

    rows = records.select("page_id", "url", "payload", "payload_digest", "refers_to")
    rows.mapInArrow(run, "path string, bytes long, records long").write.parquet(f"{folder}/manifest")
    return spark.read.schema("path string, bytes long, records long").parquet(f"{folder}/manifest")


def _member(buffer: bytearray, at: int, fill) -> tuple[bytes, int] | None:
    """The decoded member at `at` and its length; None if there is none. `fill()` appends to the buffer, or is false at the end."""
    gz = zlib.decompressobj(31)
    out, pos, step = bytearray(), at, 512
    try:
        while not gz.eof:
            part = bytes(buffer[pos : pos + step])
            if not part:
                if not fill():
                    return None
                continue
            out += gz.decompress(part)
            pos, step = pos + len(part) - len(gz.unused_data), 1 << 16
            if not out.startswith(b"WARC/1."[: len(out)]):
                return None
        return (bytes(out), pos - at) if out.startswith(b"WARC/1.") else None
    except zlib.error:
        return None


def _headers(raw: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that starts with white space goes on the one before."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", raw).decode("utf-8", "replace").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in reversed(lines)) if _}


def _digest(text: str | None) -> tuple[str | None, str | None]:
    """Algorithm and hexadecimal value of a digest header; the value as it stands, without an algorithm, if it can't be read."""
    kind, _, value = (text or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind in _DIGESTS:
        size = hashlib.new(kind).digest_size
        try:
            if len(value) == 2 * size:
                return kind, bytes.fromhex(value).hex()
            return kind, base64.b32decode(value.upper() + "=" * (-len(value) % 8))[:size].hex()
        except ValueError:
            pass
    return None, text or None


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}|-?9[0-9]{18}", text) else None


def _fields(raw: bytes) -> tuple:
    m = _HEAD_END.search(raw)
    h = _headers(raw[: m.start()])
    size = _number(h.get("content-length")) or 0
    block = raw[m.end() : m.end() + size]
    whole = len(block) >= size
    kind, payload, length = h.get("warc-type", "").lower(), block, None
    if h.get("content-type", "").replace(" ", "").lower().startswith("application/http") and (http := re.search(rb"\r?\n\r?\n", block)):
        payload, length = block[http.end() :], _number(_headers(block[: http.start()]).get("content-length"))
    name, page = h.get("warc-record-id"), _number(h.get("x-page-id"))
    algorithm, digest = _digest(h.get("warc-payload-digest"))
    intact = None
    if kind == "revisit":
        intact = whole or None
    else:
        if algorithm and "warc-truncated" not in h:
            intact = whole and hashlib.new(algorithm, payload).hexdigest() == digest
        read = hashlib.sha1(payload).hexdigest()
        if page is not None and (not whole or intact is False or length not in (None, len(payload))):
            raise ValueError(f"record {name}: {len(payload)} bytes with SHA-1 {read}, but its headers say {length} and {digest}")
        length, digest = len(payload), read
    return (page, h.get("warc-target-uri"), kind, _number(h.get("x-refers-to-page-id")), digest, length, name, h.get("warc-refers-to"), intact, None if kind == "revisit" else payload)


def members_in(source, start: int, end: int) -> Iterator[tuple[bytes, int]]:
    """The members of an open archive that start in [start, end) and hold a record's headers: decoded, and where they end."""
    source.seek(start)
    buffer, base, at = bytearray(), start, start

    def fill() -> bool:
        part = source.read(_READ)
        buffer.extend(part)
        return bool(part)

    while at < end:
        i = buffer.find(MAGIC, at - base)
        if i < 0:
            at = max(at, base + len(buffer) - len(MAGIC) + 1)
            if base + len(buffer) >= end + len(MAGIC) - 1 or not fill():
                return
            continue
        at = base + i
        if at >= end:
            return
        found = _member(buffer, i, fill)
        if found is None or not _HEAD_END.search(found[0]):
            at += 1
            continue
        at += found[1]
        yield found[0], at
        if at - base > _READ:
            del buffer[: at - base]
            base = at


def records_in(source, start: int, end: int) -> Iterator[tuple]:
    """The records of an open archive that start in [start, end); `start` must not lie inside a record."""
    return (_fields(raw) for raw, _ in members_in(source, start, end))


def _entered(ranges: DataFrame, split_bytes: int) -> DataFrame:
    """`ranges` (path, bytes, start) with enter: where the range's own records may begin, which is behind all records that start before it.

    What a range finds inside a record of an earlier range ends inside that record too, so the latest end of the earlier ranges is right even
    where they took such members for records. The last range of an archive is not looked at, and an archive of one range not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, starts = (batch.column(i).to_pylist() for i in range(2))
            exits = []
            for path, start in zip(paths, starts, strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                exit_ = 0
                with fs.open_input_file(name) as f:
                    for _, exit_ in members_in(f, start, start + split_bytes):
                        pass
                exits.append(exit_)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exits, pa.int64())], ["path", "start", "exit"])

    followed = ranges.filter(F.col("start") + split_bytes < F.col("bytes")).select("path", "start")
    exits = _dealt(followed).mapInArrow(run, "path string, start long, exit long")
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return ranges.join(exits, ["path", "start"], "left").withColumn("enter", F.greatest("start", F.max("exit").over(before))).drop("exit")


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges are a few bytes each; they are dealt out over the cluster so that no task reads a whole archive."""
    return ranges.repartition(max(1, ranges.sparkSession.sparkContext.defaultParallelism * 2), "path", "start")


def read_warc(manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """All records of the archives listed with path and bytes: page_id and refers_to (of records with these headers), url, record_type,
    payload_digest (SHA-1 of the payload; of revisits, what the header says), payload_bytes, record_id, refers_to_id, intact, payload (null for
    revisits, whose payload is stored with the record they refer to)."""
    cuts = F.expr(f"explode(sequence(0L, greatest(bytes - 1, 0L), {int(split_bytes)}L))")
    ranges = manifest.select("path", "bytes").distinct().filter("bytes > 0").select("path", "bytes", cuts.alias("start"))
    stop = F.least(F.col("start") + split_bytes, F.col("bytes"))
    ranges = _entered(ranges, split_bytes).select("path", "start", "enter", stop.alias("stop")).filter("enter < stop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, _, enter, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    rows: list[tuple] = []
                    held = 0
                    for row in records_in(f, enter, stop):
                        rows.append(row)
                        held += len(row[9] or b"")
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return _dealt(ranges).mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def through_warc(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write the pages to archives in the shared folder and read all their records back."""
    small_batches(pages.sparkSession)
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_warc(write_warc(plan_records(pages, least_bytes), folder))
