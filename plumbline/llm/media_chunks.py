"""Media columns by content-defined chunking.

A payload is cut where a rolling gear hash over its last 32 bytes hits a pattern, so equal passages give equal chunks wherever they
stand. Digests of chunks are counted by Spark; a chunk that occurs once is stored with its payload, every other one once in
a table of shared chunks. Payloads are put together again from their ordered chunk lists and verified.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import arrow_schema, groups, join_unique, map_texts, release, ship, spool, texts_of

UNIT, PAD = 576, b"\xff"
_rng = np.random.default_rng(20240607)
GEAR = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)
HEADER = 44
SPARSE = 32


@dataclass(frozen=True)
class Cuts:
    """Sizes of chunks in bytes; the mean is a power of two over the least.

    The filter of repeated digests has at least SPARSE bits for each of them, so it doesn't fill up. bits bounds what is broadcast:
    where more would be needed, repeated chunks are told apart by a join of digests instead. What is stored differs only in
    a few chunks that occur once; what is read back doesn't differ.
    """

    least: int = 256
    mean: int = 1024
    most: int = 8192
    bits: int = 1 << 29


def payload_of(text: str) -> tuple[bytes, int]:
    data = text.encode()
    n = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data + PAD * (n - len(data)), len(data)


def wave_header(n: int) -> bytes:
    """Of n 8-bit samples, one channel, 8000 a second."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + n) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n & 0xFFFFFFFF)


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte the sum over the last 32 bytes of their gear values, each shifted by its distance, modulo 2**32."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cut(data: bytes, cuts: Cuts = Cuts()) -> list[bytes]:
    marks = (np.flatnonzero(gear_hashes(data) < np.uint32((1 << 32) // cuts.mean)) + 1).tolist()
    out, at, n = [], 0, len(data)
    for m in [*marks, n]:
        while m - at > cuts.most:
            out.append(data[at : at + cuts.most])
            at += cuts.most
        if m - at >= cuts.least or m == n > at:
            out.append(data[at:m])
            at = m
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def _slot(d: bytes, bits: int) -> int:
    return int.from_bytes(d[:8], "big", signed=True) % bits


def _digests(cuts: Cuts) -> Callable[[list[str]], dict]:
    return lambda texts: {"digests": [[digest(c) for c in cut(payload_of(t)[0], cuts)] for t in texts]}


LISTED = [T.StructField("digests", T.ArrayType(T.BinaryType()))]


def repeated_digests(docs: DataFrame, cuts: Cuts, id_col: str, text_col: str) -> DataFrame:
    """d, n: the digests of all chunks that occur more than once, and how often."""
    listed = map_texts(docs, id_col, text_col, partial(_digests, cuts), LISTED)
    return listed.select(F.explode("digests").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def filter_of(repeated: DataFrame, bits: int) -> np.ndarray:
    """Bits of the slots of the digests.

    Other digests may fall on a set bit too: their chunks then just go to the shared table. Nothing depends on that but cost.
    """
    slot = F.pmod(F.conv(F.hex(F.substring("d", 1, 8)), 16, -10).cast("long"), F.lit(bits))
    words = repeated.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot as int) & 31)")).alias("v"))
    out = np.zeros(bits // 32, np.int32)
    found = words.toArrow()
    out[found.column("w").to_numpy()] = found.column("v").to_numpy()
    return out.view(np.uint32)


def _has(bits: np.ndarray, d: bytes) -> bool:
    s = _slot(d, len(bits) * 32)
    return bool(bits[s >> 5] >> np.uint32(s & 31) & np.uint32(1))


def _with_places(docs: DataFrame, cuts: Cuts, id_col: str, text_col: str, repeated: DataFrame) -> DataFrame:
    """docs (id, text) with places, the numbers of the chunks of a text that are repeated, by joining digests; a text is shuffled once."""
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    keyed = docs.withColumn("key of text", key)
    listed = spool(map_texts(keyed, "key of text", text_col, partial(_digests, cuts), LISTED).groupBy("key of text").agg(F.first("digests").alias("digests"), F.count(F.lit(1)).alias("copies")), "lists")
    chunks = listed.select("key of text", F.posexplode("digests").alias("seq", "d"))
    places = join_unique(chunks, repeated, "d", "n").groupBy("key of text").agg(F.collect_list("seq").alias("places"))
    every = spool(listed.select("key of text", "copies").join(places, "key of text", "left").select("key of text", "copies", F.coalesce("places", F.expr("array()").cast("array<int>")).alias("places")), "places")
    return spool(join_unique(keyed, every, "key of text", "copies").select(id_col, text_col, "places"), "placed")


def _away(places: list[int] | None, bits: np.ndarray | None, names: list[bytes]) -> list[bool]:
    """For each chunk of a payload whether it goes to the shared table."""
    if places is None:
        return [_has(bits, d) for d in names]
    known = set(places)
    return [i in known for i in range(len(names))]


def _packs(batches: Iterator[pa.RecordBatch], cuts: Cuts, repeated, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows of id, text and places to packs."""
    bits, arrow = repeated and repeated.value, None
    for batch in batches:
        arrow = arrow or arrow_schema(schema, batch.schema.field(0).type)
        for a, b in groups(batch.column(1), 4_000_000):
            rows = batch.slice(a, b - a)
            out: dict[str, list] = {"n_bytes": [], "sha": [], "header": [], "missing": [], "chunks": []}
            for t, places in zip(texts_of(rows.column(1)), rows.column(2).to_pylist()):
                payload, n = payload_of(t)
                pieces = cut(payload, cuts)
                names = [digest(c) for c in pieces]
                away = _away(places, bits, names)
                out["n_bytes"].append(n)
                out["sha"].append(digest(payload))
                out["header"].append(wave_header(len(payload)))
                out["missing"].append([{"seq": i, "d": d} for i, (d, x) in enumerate(zip(names, away)) if x])
                out["chunks"].append([None if x else c for c, x in zip(pieces, away)])
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(out[f.name], f.type) for f in list(arrow)[1:])], schema=arrow)


def _shared(batches: Iterator[pa.RecordBatch], cuts: Cuts, repeated) -> Iterator[pa.RecordBatch]:
    bits, seen = repeated and repeated.value, {}
    for batch in batches:
        for t, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pieces = cut(payload_of(t or "")[0], cuts)
            names = [digest(c) for c in pieces]
            for c, d, x in zip(pieces, names, _away(places, bits, names)):
                if x:
                    seen[d] = (seen[d][0] + 1, c) if d in seen else (1, c)
            if len(seen) > 20_000:
                yield _shared_batch(seen)
    yield _shared_batch(seen)


def _shared_batch(seen: dict) -> pa.RecordBatch:
    names, found = [*seen], [*seen.values()]
    seen.clear()
    return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.binary())], names=["d", "n", "chunk"])


def store(docs: DataFrame, cuts: Cuts = Cuts(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: packs (id_col, n_bytes, sha, header, missing, chunks) and shared (d, n, chunk).

    chunks is the ordered list of a payload's chunks, null where missing names one of the shared table by its digest. n counts
    a shared chunk's uses. Null texts are empty ones; repeated rows repeat in packs only.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    twice = spool(repeated_digests(source, cuts, id_col, text_col), "repeated")
    bits, bitmap = max(1 << 16, 1 << (SPARSE * twice.count()).bit_length()), None
    if bits <= cuts.bits:
        bitmap = spark.sparkContext.broadcast(filter_of(twice, bits))
        placed = source.withColumn("places", F.lit(None).cast("array<int>"))
    else:
        placed = _with_places(source, cuts, id_col, text_col, twice)
    B = T.BinaryType()
    missing = T.ArrayType(T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("d", B)]))
    schema = T.StructType([T.StructField(id_col, source.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("sha", B), T.StructField("header", B), T.StructField("missing", missing), T.StructField("chunks", T.ArrayType(B))])
    packs = spool(placed.mapInArrow(partial(_packs, cuts=cuts, repeated=bitmap, schema=schema), schema), "packs")
    parts = placed.select(text_col, "places").mapInArrow(partial(_shared, cuts=cuts, repeated=bitmap), "d binary, n long, chunk binary")
    shared = spool(parts.groupBy("d").agg(F.sum("n").alias("n"), F.first("chunk").alias("chunk")), "shared")
    release(twice)
    return packs, shared


def describe(header: bytes, payload: bytes) -> tuple:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of a payload that was read back."""
    samples = np.frombuffer(payload, np.uint8)
    level = samples.astype(np.int16) - 128
    crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
    feature = f"sum={int(samples.sum(dtype=np.int64))};energy={int((level.astype(np.int64) ** 2).sum())};crossings={crossings}"
    media = hashlib.sha256(header)
    media.update(payload)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(header) + len(payload), media.hexdigest(), feature


FEATURES = [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]


def _assemble(batches: Iterator[pa.RecordBatch], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows of a key, sha, header, chunks and the fetched chunks by place, to the key and what describe() says."""
    for batch in batches:
        keys, out = batch.column(0), []
        arrow = arrow_schema(schema, keys.type)
        for i in range(batch.num_rows):
            sha, header, chunks, fetched = (batch.column(k)[i].as_py() for k in range(1, 5))
            for f in fetched or ():
                chunks[f["seq"]] = f["chunk"]
            if any(c is None for c in chunks) or digest(payload := b"".join(chunks)) != sha:
                raise ValueError("a stored payload can't be put together again")
            out.append(describe(header, payload))
        columns = list(zip(*out)) or [[]] * len(FEATURES)
        yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)


def load(packs: DataFrame, shared: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_bytes and the features of every payload, read back from the two tables and verified by digest.

    Payloads without shared chunks never leave their place. Of the others each different one is put together once,
    however many copies it has; hot chunks and hot copies are joined by broadcast of at most 1,000 rows.
    """
    ship(packs.sparkSession)
    id_type = packs.schema[id_col].dataType
    none = F.lit(None).cast("array<struct<seq:int,chunk:binary>>").alias("fetched")
    own = T.StructType([T.StructField("key", T.StructType([T.StructField("id", id_type), T.StructField("n_bytes", T.LongType())])), *FEATURES])
    alone = packs.where("size(missing) = 0").select(F.struct(F.col(id_col).alias("id"), "n_bytes").alias("key"), "sha", "header", "chunks", none)
    names = [f.name for f in FEATURES]
    alone = alone.mapInArrow(partial(_assemble, schema=own), own).select(F.col("key.id").alias(id_col), F.col("key.n_bytes").alias("n_bytes"), *names)
    apart = packs.where("size(missing) > 0")
    uses = spool(apart.groupBy("sha").agg(F.count(F.lit(1)).alias("uses"), F.first("missing").alias("missing")), "uses")
    needs = uses.select("sha", F.explode("missing").alias("m")).select("sha", F.col("m.seq").alias("seq"), F.col("m.d").alias("d"))
    fetched = join_unique(needs, shared, "d", "n").groupBy("sha").agg(F.collect_list(F.struct("seq", "chunk")).alias("fetched"))
    whole = apart.select("sha", "header", "chunks").dropDuplicates(["sha"]).join(fetched, "sha")
    by_sha = T.StructType([T.StructField("key", T.BinaryType()), *FEATURES])
    known = whole.select(F.col("sha").alias("key"), "sha", "header", "chunks", "fetched").mapInArrow(partial(_assemble, schema=by_sha), by_sha)
    known = spool(known.withColumnRenamed("key", "sha").join(uses.select("sha", "uses"), "sha"), "features")
    return alone.unionByName(join_unique(apart.select(id_col, "n_bytes", "sha"), known, "sha", "uses").select(id_col, "n_bytes", *names))


def media_features(docs: DataFrame, cuts: Cuts = Cuts(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text of docs as 8-bit samples, read it back, and describe it: one row per input row.

    A null text is empty: one unit of padding. Repeated rows and null ids keep their rows, equal texts get equal values; an empty table
    gives an empty result; extra columns are left behind, whatever their names. A text of any length is held whole by one task at a time.
    """
    return load(*store(docs, cuts, id_col, text_col), id_col)
