"""Repository snapshots as tables: admission of files, differences between versions, offsets of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.tables import in_order

MAX_FILE, MAX_TOTAL = 1 << 20, 50 << 20


def file_verdict(path: Column, size: Column, mode: Column | None = None, content: Column | None = None, include: list[str] | None = None, exclude: list[str] | None = None, max_file: int = MAX_FILE) -> Column:
    """Why a file is not read, or null: the first of UNSUPPORTED, EXCLUDED, UNSAFE_PATH, SYMLINK, FILE_TOO_LARGE, NOT_TEXT."""
    out = F.when(~X.has_suffix(path, ".py", ".md"), "UNSUPPORTED").when(X.has_skipped_part(path), "EXCLUDED")
    if include:
        out = out.when(~X.matches_any(path, include), "EXCLUDED")
    if exclude:
        out = out.when(X.matches_any(path, exclude), "EXCLUDED")
    out = out.when(~X.is_safe_path(path), "UNSAFE_PATH")
    if mode is not None:
        out = out.when(mode == "120000", "SYMLINK")
    out = out.when(size > max_file, "FILE_TOO_LARGE")
    if content is not None:
        out = out.when(~F.is_valid_utf8(content.cast("string")) | (F.locate("\x00", content.cast("string")) > 0), "NOT_TEXT")
    return out


def admit(files: DataFrame, max_total: int = MAX_TOTAL, keys: list[str] | None = None, path: str = "path", size: str = "size") -> DataFrame:
    """files with admitted: in path order a file is taken if it still fits; one that doesn't takes nothing from the budget.

    This is a fold, not a running sum: the sizes of one repository (keys) go by one after another, contents don't.
    """
    keys = keys or ["repo_id"]

    def start() -> Callable[[int], bool]:
        used = 0

        def take(n: int) -> bool:
            nonlocal used
            fits = used + n <= max_total
            used += n * fits
            return fits

        return take

    return files.join(in_order(files, keys, path, size, "admitted", start), [*keys, path])


def changed_paths(base: DataFrame, head: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """keys and change (ADDED, REMOVED, MODIFIED) between two versions of a table of digests."""
    a, b = base.select(*keys, F.col(digest).alias("old")), head.select(*keys, F.col(digest).alias("new"))
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").otherwise("MODIFIED")
    return a.join(b, keys, "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select(*keys, change.alias("change"))


def files_hash(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, files_hash: one digest over the ordered path:hash list of a snapshot."""
    keys = keys or ["repo_id"]
    part = F.to_json(F.array(F.concat("path", F.lit(":"), "blob_hash")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", part.alias("part")))), lambda r: F.substring(r["part"], F.lit(2), F.length(r["part"]) - 2))
    return files.groupBy(*keys).agg(F.substring(F.sha2(F.concat(F.lit("["), F.array_join(ordered, ", "), F.lit("]")), 256), 1, 24).alias("files_hash"))


def line_offsets(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line (from 0), start_byte, bytes of each line (without its line feed)."""
    lines = docs.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "content"))
    before = W.partitionBy(*keys).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return lines.select(*keys, "line", F.coalesce(F.sum(F.octet_length("content") + 1).over(before), F.lit(0)).alias("start_byte"), F.octet_length("content").alias("bytes"))


def heading_context(lines: DataFrame, keys: list[str], levels: int = 6) -> DataFrame:
    """lines (with line, level of a heading or null, and title) with context, the open headings joined by blanks, and nearest.

    A heading of some level closes those of its level and below: per level the last heading counts unless a shallower or equal one came later.
    """
    up_to = W.partitionBy(*keys).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    out = lines
    for k in range(1, levels + 1):
        here = F.struct("line", "title")
        out = out.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, here), ignorenulls=True).over(up_to))
        out = out.withColumn(f"cut{k}", F.last(F.when(F.col("level") < k, F.col("line")), ignorenulls=True).over(up_to))
    opened = [F.when(F.coalesce(F.col(f"h{k}.line") > F.col(f"cut{k}"), F.col(f"h{k}").isNotNull()), F.col(f"h{k}.title")) for k in range(1, levels + 1)]
    return out.select(*lines.columns, F.concat_ws(" ", *opened).alias("context"), F.coalesce(*reversed(opened)).alias("nearest"))


def as_of_binding(events: DataFrame, keys: list[str], order: list[str], value: Column) -> Column:
    """The last value set at or before a row, in order, for each key."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
