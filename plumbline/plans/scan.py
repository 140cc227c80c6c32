"""The whole plan: files to entities, facts and claims, to candidates, judgments, verified findings, patches and status."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tables import written
from plumbline.operators import align as A
from plumbline.operators import ignore, judge, metrics, patch, snapshot, verify
from plumbline.operators.exports import with_exports
from plumbline.operators.extract import Code, extract_claims, extract_code

METHODS = ("rules", "no_alignment", "no_verifier", "full", "llm", "no_static")


@dataclass(frozen=True)
class Config:
    """method: rules is the whole plan; no_alignment and no_verifier leave out a step, for comparisons.

    full asks the provider (made in each worker by provider()) about claims that the rules leave undecided, llm and no_static about all
    claims; no_static shows it no facts, so it can't prove a conflict.
    """

    top_k: int = 5
    method: str = "rules"
    exports: bool = True
    ignores: list[ignore.Rule] = field(default_factory=list)
    scan_date: date = date(2000, 1, 1)
    include: list[str] = field(default_factory=lambda: ["**/*.py", "**/*.md"])
    exclude: list[str] = field(default_factory=list)
    max_file_bytes: int = snapshot.MAX_FILE
    max_total_bytes: int = snapshot.MAX_TOTAL
    fail_on: str = "confirmed"
    require_complete: bool = False
    provider: Callable[[], judge.Provider] | None = None

    def __post_init__(self) -> None:
        if self.fail_on not in ("none", "confirmed"):
            raise ValueError("fail_on must be none or confirmed")
        if not (1 <= self.max_file_bytes <= 10 << 20 and 1 <= self.max_total_bytes <= 500 << 20):
            raise ValueError("max_file_bytes and max_total_bytes must be at least 1 and at most 10 and 500 MiB")
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if self.method in ("full", "llm", "no_static") and self.provider is None:
            raise ValueError(f"method {self.method} needs a provider")
        if not 1 <= self.top_k <= 100:
            raise ValueError("top_k must be from 1 to 100")


def config_hash(config: Config) -> str:
    """A digest of everything in a config that changes what a scan finds."""
    known = {f.name: getattr(config, f.name) for f in fields(config) if f.name not in ("provider", "fail_on", "require_complete")}
    return hashlib.sha256(json.dumps(known, default=str, sort_keys=True).encode()).hexdigest()[:24]


@dataclass(frozen=True)
class Report:
    """The tables of a scan. Extraction and judgments are written once; what follows from them is lazy.

    verify is the second reading of the files that findings and rejected rest on; it is called once, when one of them is first asked for.
    """

    files: DataFrame
    code: Code
    entities: DataFrame
    facts: DataFrame
    claims: DataFrame
    candidates: DataFrame
    judgments: DataFrame
    verify: Callable[[], tuple[DataFrame, DataFrame]]
    diagnostics: DataFrame
    repositories: DataFrame

    @cached_property
    def _verified(self) -> tuple[DataFrame, DataFrame]:
        return self.verify()

    @property
    def findings(self) -> DataFrame:
        return self._verified[0]

    @property
    def rejected(self) -> DataFrame:
        return self._verified[1]

    @property
    def status(self) -> DataFrame:
        """repo_id, status of every repository that was offered, also where none of its files was read."""
        bad = metrics.run_status(self.diagnostics, ["repo_id"])
        return self.repositories.select("repo_id").distinct().join(bad, "repo_id", "left").select("repo_id", F.coalesce("status", F.lit("COMPLETED")).alias("status"))


#: What a diagnostic says of a file that isn't read, and whether the run is then incomplete.
VERDICTS = {
    "EXCLUDED": ("EXCLUDED", "left out by the scan's settings", False),
    "UNSAFE_PATH": ("UNSAFE_PATH", "the path leaves the repository or can't be trusted", True),
    "SYMLINK": ("SYMLINK_SKIPPED", "links aren't followed", True),
    "MISSING_FILE": ("MISSING_FILE", "the file can't be read", True),
    "FILE_TOO_LARGE": ("LIMIT_EXCEEDED", "over the limit of bytes for a file", True),
    "BUDGET": ("LIMIT_EXCEEDED", "over the limit of bytes for a run", True),
    "NOT_TEXT": ("UNREADABLE_TEXT", "not UTF-8 text", True),
}


def admitted(files: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """The files that a scan reads, and a diagnostic for every other .py and .md file.

    files has mode and size besides the columns of a scan; content may be null where a source didn't read it. The byte budget of each
    repository is spent in path order on the files that pass everything else.
    """
    verdict = snapshot.file_verdict(F.col("path"), F.col("size"), F.col("mode"), None, config.include, config.exclude, config.max_file_bytes)
    broken = F.when(F.col("content").isNull(), "MISSING_FILE").when(~F.is_valid_utf8(F.col("content").cast("string")) | (F.locate("\x00", F.col("content").cast("string")) > 0), "NOT_TEXT")
    judged = written(files.select("repo_id", "path", "size", F.coalesce(verdict, broken).alias("verdict")), "verdicts")
    fits = written(snapshot.admit(judged.where("verdict IS NULL").drop("verdict"), config.max_total_bytes), "admitted")
    kept = files.join(fits.where("admitted").select("repo_id", "path"), ["repo_id", "path"], "left_semi").select("repo_id", "head_sha", "path", "content")
    refused = judged.where("verdict IS NOT NULL AND verdict <> 'UNSUPPORTED'").select("repo_id", "path", "verdict").unionByName(fits.where("NOT admitted").select("repo_id", "path", F.lit("BUDGET").alias("verdict")))
    said = F.create_map(*[x for k, (code, text, cut) in VERDICTS.items() for x in (F.lit(k), F.struct(F.lit(code).alias("code"), F.lit(text).alias("message"), F.lit(cut).alias("cut")))])
    diagnostics = refused.withColumn("said", said[F.col("verdict")]).select("repo_id", "said.code", "said.message", F.lit("repository").alias("stage"), "path", F.lit(False).alias("retryable"), F.col("said.cut").alias("affects_completeness"))
    return kept, diagnostics


def scan(files: DataFrame, config: Config = Config(), code: Code | None = None) -> Report:
    """files(repo_id, head_sha, path, content) of any number of repositories, each scanned by itself.

    code is what an earlier scan read from the very same .py files; without it they are read.

    Where files has mode and size too, as sources give it, it is admitted by the config's limits first; else it counts as admitted.
    """
    everything, refused = files, None
    if {"mode", "size"} <= set(files.columns):
        files, refused = admitted(files, config)
    code, docs = code or extract_code(files, store=True), extract_claims(files, store=True)
    facts = with_exports(code.facts, code.imports) if config.exports else code.facts
    aligned = A.align_by_property(docs.claims, facts, config.top_k) if config.method == "no_alignment" else A.align(docs.claims, facts, config.top_k)
    aligned = written(aligned, "aligned")
    judged = written(_judged(aligned, config), "judged")

    def verified() -> tuple[DataFrame, DataFrame]:
        checked = _verified(judged, files, config)
        heads = written(files.select("repo_id", "head_sha").distinct(), "heads")
        found = verify.findings(checked.join(heads, "repo_id"), F.col("head_sha"))
        return ignore.apply_rules(found, config.ignores, config.scan_date), verify.rejected(checked)

    diagnostics = code.diagnostics.unionByName(docs.diagnostics)
    return Report(files, code, code.entities, facts, docs.claims, A.candidates(aligned), judged, verified, diagnostics.unionByName(refused) if refused is not None else diagnostics, everything.select("repo_id", "head_sha").distinct())


def _verified(judged: DataFrame, files: DataFrame, config: Config) -> DataFrame:
    """Conflicts of judged, checked by parsing files again once, and only documents in doubt and the code of their repositories."""
    doubted = judged.where("decision = 'INCONSISTENT'")
    if config.method == "no_verifier":
        return doubted.withColumn("reject", F.lit(None).cast("string"))
    doubt = written(doubted.select("repo_id", F.col("span.path").alias("path")).distinct(), "doubt")
    fresh = extract_code(files.join(F.broadcast(doubt.select("repo_id").distinct()), "repo_id", "left_semi"), store=config.exports)
    fresh_facts = with_exports(fresh.facts, fresh.imports) if config.exports else written(fresh.facts, "fresh")
    fresh_claims = written(extract_claims(files.join(doubt, ["repo_id", "path"], "left_semi")).claims, "again")
    return verify.verify(judged, files, fresh_claims, fresh_facts)


def _judged(aligned: DataFrame, config: Config) -> DataFrame:
    ruled = judge.judge(aligned)
    if config.provider is None or config.method not in ("full", "llm", "no_static"):
        return ruled
    asked = aligned
    if config.method == "full":
        ruled = written(ruled, "ruled")
        asked = aligned.join(ruled.where("decision = 'UNCERTAIN'").select("repo_id", "claim_id"), ["repo_id", "claim_id"], "left_semi")
    if config.method == "no_static":
        asked = aligned.where("rank = 1").withColumn("fact", F.lit(None).cast(aligned.schema["fact"].dataType))
    return judge.with_answers(ruled, judge.judge_with_provider(asked, config.provider))


def rescan(report: Report, patched: DataFrame, config: Config) -> Report:
    """A scan of a report's files after edits of documents: these are read again, code has the same bytes and isn't."""
    return scan(patched, config, report.code)


def propose_patches(report: Report, config: Config = Config()) -> DataFrame:
    """Patches of a report's findings, each proven by a second scan of the patched files without suppression rules."""

    def proof(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        again = rescan(report, files, Config(config.top_k, "rules", config.exports, [], config.scan_date))
        return again.judgments, again.findings

    return patch.propose(report.findings, report.files, proof)
