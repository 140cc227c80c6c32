"""Applying a proven patch to a working tree: guards, atomic replacement, and everything put back if any step fails."""

from __future__ import annotations

import hashlib
import json
import os
import stat
import tempfile
from pathlib import Path

from plumbline.sources.git import SourceError


def patch_id_of(finding_ids: list[str]) -> str:
    return hashlib.sha256(json.dumps(["patch", *finding_ids], ensure_ascii=False).encode()).hexdigest()[:24]


def target_of(root: Path, relative: str) -> Path:
    """The file of a patch's path: a Markdown file within root that no link leads to."""

    def refuse(why: str) -> SourceError:
        return SourceError("UNSAFE_PATCH", f"{relative}: {why}")

    parts = relative.split("/")
    if not relative.endswith(".md") or any(c in relative for c in "\\:\0") or {"", "..", ".", ".git"} & set(parts):
        raise refuse("not a plain path of a Markdown file")
    place = root
    for i, part in enumerate(parts):
        place = place / part
        try:
            mode = place.lstat().st_mode
        except OSError as e:
            raise refuse("missing or out of reach") from e
        if not (stat.S_ISREG(mode) if i == len(parts) - 1 else stat.S_ISDIR(mode)):
            raise refuse("a link or no regular file")
    return place


def replace_file(path: Path, data: bytes) -> None:
    """The new content appears at once or not at all; the mode stays."""
    handle, name = tempfile.mkstemp(prefix=".plumbline-", dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(name, stat.S_IMODE(path.stat().st_mode))
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def spliced(data: bytes, edits: list[dict]) -> bytes:
    end = len(data)
    for e in sorted(edits, key=lambda e: e["start_byte"], reverse=True):
        if not 0 <= e["start_byte"] <= e["end_byte"] <= end:
            raise SourceError("INVALID_PATCH", "edits overlap or pass the file's end")
        data = data[: e["start_byte"]] + e["new_text"].encode() + data[e["end_byte"] :]
        end = e["start_byte"]
    return data


def apply_patch(repo: str, proposal: dict) -> list[str]:
    """Paths written. proposal: patch_id, finding_ids, validation, edits, and base_hashes, the SHA-256 of each file before.

    INVALID_PATCH: not validated, or its ids, paths or edits don't belong together. STALE_PATCH: a file isn't what it was, or changed meanwhile.
    """
    ids, edits = proposal.get("finding_ids") or [], proposal.get("edits") or []
    if proposal.get("validation") != "VALIDATED" or not edits or not ids or len(set(ids)) < len(ids) or proposal.get("patch_id") != patch_id_of(ids):
        raise SourceError("INVALID_PATCH", "a validated patch with its own findings is needed")
    paths = sorted({e["path"] for e in edits})
    if set(paths) != set(proposal.get("base_hashes") or {}):
        raise SourceError("INVALID_PATCH", "its files and its edits differ")
    root = Path(repo).resolve()
    before = {p: target_of(root, p).read_bytes() for p in paths}
    for p in paths:
        if hashlib.sha256(before[p]).hexdigest() != proposal["base_hashes"][p]:
            raise SourceError("STALE_PATCH", p)
    after = {p: spliced(before[p], [e for e in edits if e["path"] == p]) for p in paths}
    done: list[str] = []
    try:
        for p in paths:
            if target_of(root, p).read_bytes() != before[p]:
                raise SourceError("STALE_PATCH", p)
            replace_file(root / p, after[p])
            done.append(p)
    except BaseException:
        for p in reversed(done):
            replace_file(root / p, before[p])
        raise
    return paths
