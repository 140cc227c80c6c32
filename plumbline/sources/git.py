"""Git repositories as a Spark data source: spark.read.format("git_files").option("repo", …).option("ref", …).load()

One row for each file of a commit: path, mode, object id, size and content. Paths are listed on the driver, without reading
anything; contents are read by the executors in batches, one process of git for each batch.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.functions.tables import ship

BATCH = 500


class SourceError(Exception):
    """A fault with a short code that a report can carry."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def run_git(repo: str, *args: str, stdin: bytes = b"") -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], input=stdin, capture_output=True, timeout=30)
    if done.returncode:
        raise SourceError("GIT_FAILED", done.stderr.decode(errors="replace").strip()[:300])
    return done.stdout


def resolve_ref(repo: str, ref: str) -> str:
    """The commit that a ref names; refs that look like options are refused."""
    if not ref or ref.startswith("-") or "\0" in ref:
        raise SourceError("MISSING_REF", repr(ref))
    try:
        return run_git(repo, "rev-parse", "--quiet", "--verify", f"{ref}^{{commit}}").decode().strip()
    except SourceError as e:
        raise SourceError("MISSING_REF", ref) from e


def is_dirty(repo: str) -> bool:
    return bool(run_git(repo, "status", "--porcelain").strip())


def changed_paths(repo: str, base: str, head: str) -> list[str]:
    out = run_git(repo, "diff", "-z", "--name-only", resolve_ref(repo, base), resolve_ref(repo, head))
    return sorted(p.decode() for p in out.split(b"\0") if p)


def list_tree(repo: str, sha: str) -> list[tuple[str, str, str, int]]:
    """path, mode, object id, size of all files of a commit."""
    rows = []
    for line in run_git(repo, "ls-tree", "-lrz", sha).split(b"\0"):
        head, tab, path = line.partition(b"\t")
        if tab:
            mode, kind, oid, size = head.decode().split()
            if kind == "blob":
                rows.append((path.decode(errors="surrogateescape"), mode, oid, int(size)))
    return rows


def read_blobs(repo: str, oids: list[str]) -> Iterator[bytes]:
    out = run_git(repo, "cat-file", "--batch", stdin="".join(f"{o}\n" for o in oids).encode())
    at = 0
    for _ in oids:
        end = out.index(b"\n", at)
        size = int(out[at:end].split()[2])
        yield out[end + 1 : end + 1 + size]
        at = end + 2 + size


@dataclass
class Batch(InputPartition):
    rows: list


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo, self.most = options["repo"], int(options.get("max_file_bytes", 1 << 20))
        self.sha = resolve_ref(self.repo, options.get("ref", "HEAD"))
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s)

    def partitions(self) -> list[InputPartition]:
        rows = [r for r in list_tree(self.repo, self.sha) if not self.suffixes or r[0].endswith(self.suffixes)]
        return [Batch(rows[i : i + BATCH]) for i in range(0, len(rows), BATCH)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        wanted = [r for r in partition.rows if r[1] != "120000" and r[3] <= self.most]
        found = dict(zip((r[0] for r in wanted), read_blobs(self.repo, [r[2] for r in wanted]))) if wanted else {}
        for path, mode, oid, size in partition.rows:
            yield self.sha, path, mode, oid, size, found.get(path)


class GitSource(DataSource):
    """Contents of symbolic links and of files over max_file_bytes are null; the other columns are there for diagnostics."""

    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return "head_sha string, path string, mode string, object_id string, size long, content binary"

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


def read_repository(spark: SparkSession, repo: str, ref: str = "HEAD", repo_id: str | None = None, **options: str) -> DataFrame:
    """files(repo_id, head_sha, path, content, mode, size) of a commit."""
    ship(spark)
    spark.dataSource.register(GitSource)
    loaded = spark.read.format("git_files").options(repo=repo, ref=ref, **options).load()
    name = repo_id or f"{repo.rstrip('/').rsplit('/', 1)[-1]}@{resolve_ref(repo, ref)[:12]}"
    return loaded.select(F.lit(name).alias("repo_id"), "head_sha", "path", "content", "mode", "size")


def working_paths(repo: str) -> list[tuple[str, str | None, str | None]]:
    """path, mode (100644, 120000 for links and what lies behind one, null if missing) and link target of tracked and new unignored files."""
    root, out = os.path.realpath(repo), []
    for p in sorted({x.decode(errors="surrogateescape") for x in run_git(repo, "ls-files", "--exclude-standard", "--others", "--cached", "-z").split(b"\0") if x}):
        full = os.path.join(root, p)
        if not os.path.lexists(full):
            out.append((p, None, None))
        else:
            out.append((p, "100644" if os.path.realpath(full) == full else "120000", os.readlink(full) if os.path.islink(full) else None))
    return out


def read_working_tree(spark: SparkSession, repo: str, repo_id: str = "working-tree", suffixes: str = "") -> DataFrame:
    """files of the tracked and the new unignored paths as they lie on disk, with mode and size.

    Links aren't followed: they have mode 120000 and their target's name as content, as in a commit. Missing files have no mode.
    """
    sha = resolve_ref(repo, "HEAD")
    root = os.path.realpath(repo)
    ends = tuple(s for s in suffixes.split(",") if s)
    rows = [r for r in working_paths(repo) if r[0].endswith(ends)] if ends else working_paths(repo)
    listed = spark.createDataFrame(rows, "path string, mode string, link string")
    on_disk = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(f"*{e}" for e in ends) + "}" if ends else "*").load(f"file://{root}")
    on_disk = on_disk.select(F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/+", "/").alias("full"), "content", F.col("length").alias("size"))
    on_disk = on_disk.select(F.substring("full", len(root) + 2, 2147483647).alias("path"), "content", "size")
    read = listed.join(on_disk, "path", "left")
    content = F.when(F.col("mode") == "100644", F.col("content")).otherwise(F.col("link").cast("binary"))
    return read.select(F.lit(repo_id).alias("repo_id"), F.lit(sha).alias("head_sha"), "path", content.alias("content"), "mode", F.coalesce("size", F.lit(0)).alias("size"))
