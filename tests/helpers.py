"""Files in, tables out."""

from plumbline.operators.schemas import FILES
from plumbline.plans.scan import Config, scan


def files(spark, content: dict[str, str | bytes], repo: str = "repo", sha: str = "a" * 40):
    rows = [(repo, sha, p, bytearray(c.encode() if isinstance(c, str) else c)) for p, c in content.items()]
    return spark.createDataFrame(rows, FILES)


def many(spark, cases: list[dict[str, str | bytes]]):
    """Each case is a repository of its own, so that one scan answers all."""
    out = [(f"{i:03d}", "a" * 40, p, bytearray(c.encode() if isinstance(c, str) else c)) for i, case in enumerate(cases) for p, c in case.items()]
    return spark.createDataFrame(out, FILES)


def decisions(spark, cases, config: Config = Config()) -> list[list[tuple[str, str]]]:
    """For each case the (decision, reason) of its claims, in order."""
    report = scan(many(spark, cases), config)
    found = {}
    for r in report.judgments.orderBy("repo_id", "span.path", "seq").collect():
        found.setdefault(r.repo_id, []).append((r.decision, r.reason_code))
    return [found.get(f"{i:03d}", []) for i in range(len(cases))]


def states(value: str, heading: str = "`connect`") -> str:
    return f"## {heading}\n\n`timeout` 默认值为 `{value}`。\n"


def example(code: str) -> str:
    return f"# Use\n\n```python\n{code}\n```\n"
