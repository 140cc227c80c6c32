"""Extraction as table functions over files(repo_id, head_sha, path, content)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.tables import ship, written
from plumbline.functions.text import has_suffix
from plumbline.operators.code_facts import read_source
from plumbline.operators.doc_claims import read_document
from plumbline.operators.schemas import SCANNED_CODE, SCANNED_DOCS


#: Files of which a task holds the rows at once.
CHUNK = 200


def to_arrow(values: list, kind: pa.DataType) -> pa.Array:
    """Dicts, lists and plain values as an Arrow array, leaf by leaf: several times as fast as pyarrow's way over whole dicts."""
    if pa.types.is_struct(kind):
        leaves = [to_arrow([None if v is None else v.get(f.name) for v in values], f.type) for f in kind]
        return pa.StructArray.from_arrays(leaves, fields=list(kind), mask=pa.array([v is None for v in values], pa.bool_()))
    if pa.types.is_list(kind):
        ends = pa.array(accumulate((len(v or ()) for v in values), initial=0), pa.int32())
        return pa.ListArray.from_arrays(ends, to_arrow([x for v in values for x in v or ()], kind.value_type), type=kind, mask=pa.array([v is None for v in values], pa.bool_()))
    return pa.array(values, kind)


def _map_files(files: DataFrame, read: Callable[[str, str, bytes], dict], schema: T.StructType) -> DataFrame:
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = [read(*row) for row in zip(*(c.to_pylist() for c in batch.slice(at, CHUNK).columns))]
                yield pa.RecordBatch.from_arrays([to_arrow([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    return files.select("repo_id", "path", "content").mapInArrow(run, schema)


def _rows(scanned: DataFrame, column: str) -> DataFrame:
    return scanned.select(F.explode(column).alias("row")).select("row.*")


def _tables(files: DataFrame, read: Callable[[str, str, bytes], dict], schema: T.StructType, store: str | None) -> list[DataFrame]:
    tables = [c for c in schema.names if c != "repo_id"]
    if store:
        scanned = written(_map_files(files, read, schema), store)
        return [_rows(scanned, c) for c in tables]
    return [_rows(_map_files(files, read, T.StructType([schema[c]])), c) for c in tables]


@dataclass(frozen=True)
class Code:
    entities: DataFrame
    facts: DataFrame
    imports: DataFrame
    diagnostics: DataFrame


@dataclass(frozen=True)
class Docs:
    claims: DataFrame
    diagnostics: DataFrame


def extract_code(files: DataFrame, store: bool = False) -> Code:
    """Entities, facts, import aliases and diagnostics of all .py files; a file that doesn't parse gives a diagnostic only.

    With store the files are read once and the result is written; else every table that is used reads them again, and hands on its own
    rows alone.
    """
    return Code(*_tables(files.where(F.col("path").endswith(".py")), read_source, SCANNED_CODE, "code" if store else None))


def extract_claims(files: DataFrame, store: bool = False) -> Docs:
    """Claims and diagnostics of all .md files; store as in extract_code."""
    return Docs(*_tables(files.where(F.col("path").endswith(".md")), read_document, SCANNED_DOCS, "docs" if store else None))


def source_files(files: DataFrame) -> DataFrame:
    return files.where(has_suffix(F.col("path"), ".py", ".md"))
