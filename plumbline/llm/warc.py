"""WARC archives: writing with segmentation and chunked transfer framing, and reading back by segment reassembly.

Continuation records are grouped by the identifier of their origin, ordered by segment number and verified against the
total length; then the chunked framing is decoded. Records without continuations are decoded where they are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import join_unique, shared_dir, ship, spool, uri_of

VERSION = b"WARC/1.1"
DATE = b"2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
NAME = "urn:plumbline:page:"


@dataclass(frozen=True)
class Layout:
    """Sizes in bytes of chunks of the transfer coding, of segments, and of archive files (before compression)."""

    chunk: int = 4096
    segment: int = 16384
    file: int = 1 << 26


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode().rstrip("=")


def encode_chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(piece := payload[i : i + size]), piece) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def decode_chunked(data: bytes) -> bytes:
    """The payload; extensions and trailers are passed over, anything else out of place raises ValueError."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line doesn't end")
        n = int(data[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if n == 0:
            break
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk isn't as long as it says")
        out.append(data[at : at + n])
        at += n + 2
    if data.find(b"\r\n", at) < 0:
        raise ValueError("last chunk doesn't end")
    return b"".join(out)


def _record(kind: bytes, name: str, headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [VERSION, b"WARC-Type: " + kind, b"WARC-Record-ID: <" + name.encode() + b">", b"WARC-Date: " + DATE, *(k + b": " + v for k, v in headers), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # every record is a gzip member of its own
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def records_of(name: str, url: str | None, payload: bytes, refers_to: str | None, layout: Layout) -> Iterator[bytes]:
    """The compressed records of one page: a revisit without payload, or a response with its continuations."""
    uri = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode())
    common = [(b"WARC-Target-URI", uri), (b"WARC-Payload-Digest", b"sha1:" + digest_of(payload).encode())]
    if refers_to is not None:
        profile = (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record(b"revisit", name, [*common, profile, (b"WARC-Refers-To", b"<" + refers_to.encode() + b">")], HTTP + b"\r\n")
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + encode_chunked(payload, layout.chunk)
    if len(block) <= layout.segment:
        yield _record(b"response", name, common, block)
        return
    count = -(-len(block) // layout.segment)
    for k in range(count):
        part = block[k * layout.segment : (k + 1) * layout.segment]
        number = (b"WARC-Segment-Number", b"%d" % (k + 1))
        if k == 0:
            yield _record(b"response", name, [*common, number], part)
        else:
            total = [(b"WARC-Segment-Total-Length", b"%d" % len(block))] if k == count - 1 else []
            yield _record(b"continuation", f"{name}:{k + 1}", [(b"WARC-Segment-Origin-ID", b"<" + name.encode() + b">"), number, *total], part)


def place_of(uri: str):
    """File system and path of a URI; file: with any number of slashes, or a bare path, is on this machine."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def write_archives(pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """path (a URI), records: the .warc.gz files written to the shared folder for name, url, payload (binary) and refers_to.

    A file only counts once its task has given its name, so a task that is lost and run again leaves no double records.
    """
    ship(pages.sparkSession)
    folder = f"{uri_of(pages.sparkSession, shared_dir(pages.sparkSession))}/archives-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place_of(folder)
        system.create_dir(root, recursive=True)
        done, out, name_of_file, size, n = [], None, "", 0, 0
        for batch in batches:
            for name, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name_of_file, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name_of_file}", compression=None)
                for record in records_of(name, url, payload, refers_to, layout):
                    out.write(record)
                    n += 1
                size += len(payload)
                if size >= layout.file:
                    out.close()
                    done.append((f"{folder}/{name_of_file}", n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name_of_file}", n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return spool(pages.select("name", "url", "payload", "refers_to").mapInArrow(run, "path string, records long"), "manifest")


def parse_records(stream) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers (lower-case names) and block of each record of a .warc.gz stream, read piecewise."""
    unpack, pending, raw = zlib.decompressobj(31), b"", b""
    while True:
        raw = raw or stream.read(1 << 20)
        if not raw:
            if pending.strip():
                raise ValueError("archive ends within a record")
            return
        parts = [pending]
        while raw:
            parts.append(unpack.decompress(raw))
            if not unpack.eof:
                raw = b""
                break
            raw, unpack = unpack.unused_data, zlib.decompressobj(31)
            if sum(map(len, parts)) > 1 << 20:
                break
        pending, at = b"".join(parts), 0
        while True:
            end = pending.find(b"\r\n\r\n", at)
            if end < 0:
                break
            lines = pending[at:end].split(b"\r\n")
            if not lines[0].startswith(b"WARC/"):
                raise ValueError("no WARC record where one should begin")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
            stop = end + 4 + int(headers[b"content-length"])
            if len(pending) < stop + 4:
                break
            yield headers, pending[end + 4 : stop]
            at = stop + 4
        pending = pending[at:]


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return decode_chunked(body) if b"transfer-encoding: chunked" in head.lower() else body


#: Tasks that read archives at most; beyond that a task reads several, one after another.
READERS = 20_000
READ = T.StructType([T.StructField(n, t) for n, t in (("name", T.StringType()), ("kind", T.StringType()), ("refers_to", T.StringType()), ("stated", T.StringType()), ("segment", T.IntegerType()), ("total", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("block", T.BinaryType()))])


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    names = [f.name for f in READ.fields]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        rows.clear()
        return batch

    def bare(x: bytes | None) -> str | None:
        return x.strip(b"<>").decode() if x is not None else None

    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, where = place_of(path)
            with system.open_input_stream(where, compression=None) as stream:
                for h, block in parse_records(stream):
                    kind, segment = h[b"warc-type"].decode(), int(h.get(b"warc-segment-number", b"0"))
                    stated = (h.get(b"warc-payload-digest") or b"").removeprefix(b"sha1:").decode() or None
                    total = int(h[b"warc-segment-total-length"]) if b"warc-segment-total-length" in h else None
                    name = bare(h.get(b"warc-segment-origin-id") or h[b"warc-record-id"])
                    if kind == "response" and not segment:
                        payload = _payload(block)
                        rows.append((name, kind, None, stated, 0, None, len(payload), digest_of(payload), None))
                    else:
                        rows.append((name, kind, bare(h.get(b"warc-refers-to")), stated, segment, total, None, None, block if segment else None))
                        size += len(block)
                    if len(rows) >= 5000 or size > 1 << 24:
                        yield flush()
                        size = 0
    yield flush()


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for name, stated, parts in zip(*(c.to_pylist() for c in batch.columns)):
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                raise ValueError(f"{name}: segments are missing or repeated")
            block = b"".join(p["block"] for p in parts)
            if parts[-1]["total"] != len(block):
                raise ValueError(f"{name}: {len(block)} bytes, the last segment says {parts[-1]['total']}")
            payload = _payload(block)
            out.append((name, stated, len(payload), digest_of(payload)))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["name", "stated", "payload_bytes", "payload_digest"])


def read_archives(manifest: DataFrame, strict: bool = True) -> DataFrame:
    """name, record_type, refers_to, payload_bytes, payload_digest of every page in the files of manifest (column path, URIs).

    Missing, repeated or short segments, broken framing and digests that differ from the stated ones fail the job. A revisit
    gets size and digest from the response that it refers to; hot responses are joined by broadcast of at most 1,000 rows. A revisit
    whose response isn't among the files fails the job too; if not strict, it keeps its stated digest and has no size.
    Every file is read by a task of its own, up to READERS tasks; a manifest without files gives an empty table.
    """
    ship(manifest.sparkSession)
    files = manifest.select("path")
    read = spool(files.repartition(min(max(1, files.count()), READERS)).mapInArrow(_read_files, READ), "records")
    single = read.where("kind = 'response' and segment = 0").select("name", "stated", "payload_bytes", "payload_digest")
    parts = read.where("segment > 0").groupBy("name").agg(F.max("stated").alias("stated"), F.array_sort(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"))
    joined = parts.select("name", "stated", "parts").mapInArrow(_reassemble, "name string, stated string, payload_bytes long, payload_digest string")
    verified = F.when(F.col("stated").isNull() | (F.col("stated") == F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload digest differs: "), F.col("name"))))
    responses = spool(single.unionByName(joined).withColumn("payload_digest", verified).drop("stated"), "responses")
    revisits = read.where("kind = 'revisit'").select("name", "refers_to", "stated")
    uses = revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    targets = uses.join(responses.withColumnRenamed("name", "refers_to"), "refers_to", "left").withColumn("known", F.col("payload_digest").isNotNull())
    if strict:
        targets = targets.withColumn("known", F.when(F.col("known"), True).otherwise(F.raise_error(F.concat(F.lit("no response for revisits of "), F.coalesce("refers_to", F.lit("no record"))))))
    same = F.when(~F.col("known") | (F.col("stated") == F.col("payload_digest")), F.col("stated")).otherwise(F.raise_error(F.concat(F.lit("revisit of another payload: "), F.col("name"))))
    seen = join_unique(revisits, spool(targets, "targets"), "refers_to", "n")
    if not strict:
        seen = seen.unionByName(revisits.where("refers_to IS NULL").withColumn("known", F.lit(False)), allowMissingColumns=True)
    return responses.select("name", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "payload_bytes", "payload_digest").unionByName(seen.select("name", F.lit("revisit").alias("record_type"), "refers_to", "payload_bytes", same.alias("payload_digest")))


def archive_pages(pages: DataFrame, layout: Layout = Layout(), least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id_col, payload_bytes, payload_digest, record_type, refers_to: every page written to archives and read back from them.

    Of rows with equal payloads of at least least_bytes the smallest id is the response and the others revisit it. A null payload is
    empty. Repeated rows of one id and payload share one record and are all given out; a null id with a repeated payload counts as a
    revisit of the smallest id, and as a response if no row of that payload has an id. Ids of any type that a string can be cast back
    to are allowed, with any characters. A payload of any length is held whole by the task that writes or joins it, as the record format
    does. An empty table gives an empty result; extra columns are left behind.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    source = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha", F.sha2("payload", 256))
    marks = spool(source.select("page", "sha", F.length("payload").alias("size")), "marks")
    copies = spool(marks.groupBy("page", "sha").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    repeated = not copies.isEmpty()
    if repeated:
        source = source.dropDuplicates(["page", "sha"])
    owners = spool(marks.groupBy("sha").agg(F.min("page").alias("owner"), F.count(F.lit(1)).alias("n")), "owners")
    placed = join_unique(marks, owners.where("n > 1"), "sha", "n")
    again = placed.where((F.col("size") >= least_bytes) & ~F.col("page").eqNullSafe(F.col("owner"))).select("page", "sha", "owner").distinct()

    def name_of(c: str) -> Column:
        return F.concat(F.lit(NAME), F.coalesce(F.concat(F.lit("id-"), F.url_encode(F.col(c).cast("string"))), F.lit("null")), F.lit(":"), F.col("sha"))

    joined = source.alias("s").join(again.alias("a"), F.col("s.page").eqNullSafe(F.col("a.page")) & (F.col("s.sha") == F.col("a.sha")), "left").select("s.page", "s.url", "s.payload", "s.sha", "a.owner")
    ready = joined.select(name_of("page").alias("name"), "url", "payload", F.when(F.col("owner").isNotNull(), name_of("owner")).alias("refers_to"))
    found = read_archives(write_archives(ready, layout))
    part = lambda c, i: F.regexp_extract(c, f"^{NAME}(id-)?([^:]*):(.*)", i)
    page = lambda c: F.when(part(c, 1) == "id-", F.url_decode(part(c, 2))).try_cast(pages.schema[id_col].dataType)
    out = found.select(page(F.col("name")).alias(id_col), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"), part(F.col("name"), 3).alias("sha"))
    if repeated:
        on = out[id_col].eqNullSafe(copies["page"]) & (out["sha"] == copies["sha"])
        times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long"))))
        out = out.join(copies, on, "left").select(out["*"], times.alias("time")).drop("time")
    return out.drop("sha")
