"""Stable identifiers, blob hashes and byte spans, in Python for extractors and as Columns for plans."""

from __future__ import annotations

import hashlib
from json.encoder import encode_basestring

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("path", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("blob_hash", T.StringType())])


def stable_id(*parts: str) -> str:
    return hashlib.sha256(f"[{', '.join(map(encode_basestring, parts))}]".encode()).hexdigest()[:24]


def blob_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class Blob:
    """A file's bytes with its hash, made once, and spans over it."""

    def __init__(self, path: str, data: bytes):
        self.path, self.data, self.hash = path, data, blob_hash(data)

    def span(self, start: int, end: int) -> dict:
        last = max(start, end - 1)
        first_line = self.data.count(b"\n", 0, start) + 1
        return {"path": self.path, "start_line": first_line, "end_line": first_line + self.data.count(b"\n", start, last), "start_byte": start, "end_byte": end, "blob_hash": self.hash}


def json_string(part: Column) -> Column:
    """A string as JSON text, with control characters spelled in lower case as Python does."""
    quoted = F.to_json(F.struct(part.alias("x")))
    body = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    lowered = F.transform(F.split(body, r"(?=\\u00[0-9A-F]{2})"), lambda p: F.when(p.rlike(r"^\\u00[0-9A-F]{2}"), F.concat(F.lower(F.substring(p, 1, 6)), F.substring(p, 7, 2147483647))).otherwise(p))
    return F.when(body.rlike(r"\\u00"), F.array_join(lowered, "")).otherwise(body)


def stable_id_column(*parts: Column) -> Column:
    """stable_id over Columns; null if any part is."""
    joined = F.concat(F.lit("["), *[x for i, p in enumerate(parts) for x in ([F.lit(", ")] if i else []) + [json_string(p)]], F.lit("]"))
    return F.substring(F.sha2(joined, 256), 1, 24)


def git_blob_id(content: Column) -> Column:
    """The object id under which git stores these bytes."""
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.length(content).cast("string")).cast("binary"), F.unhex(F.lit("00")), content))


def text_hash(text: Column) -> Column:
    """SHA-256 of a text that is the same whether its lines end in CR LF or LF."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256)


def base_hashes(path: Column, digest: Column) -> Column:
    """Aggregate: a map from each path to its digest."""
    return F.map_from_entries(F.array_sort(F.collect_set(F.struct(path.alias("p"), digest.alias("d")))))
