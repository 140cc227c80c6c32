"""Closure of facts over unique module-level imports: a fact is also known under the names that re-export it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ids import stable_id_column
from plumbline.functions.tables import written
from plumbline.functions.text import dotted_prefixes

IDENTITY = ["repo_id", "subject", "property", "fact_kind", "entity_id", "span_path", "span_start", "span_end"]


def _keyed(facts: DataFrame) -> DataFrame:
    return facts.withColumns({"span_path": F.col("span.path"), "span_start": F.col("span.start_byte"), "span_end": F.col("span.end_byte")})


def with_exports(facts: DataFrame, imports: DataFrame, rounds: int = 64) -> DataFrame:
    """facts and their exported copies, with the import's span added to their provenance.

    Semi-naive: every round joins only the facts that the last one found, by equality with each dotted prefix of their subject, and an
    anti-join drops those known already, so cycles end. Of several ways to one fact the one with the smallest id stays. Chains longer than
    rounds raise an error rather than being cut.
    """
    if imports.isEmpty():
        return facts
    links = imports.select("repo_id", F.concat_ws(".", "source_module", "name").alias("source"), F.concat_ws(".", "module", "binding").alias("exported"), F.col("path").alias("target_path"), F.col("span").alias("link"))
    known = written(facts, "facts")
    last, parts = known, [known]
    for _ in range(rounds):
        reached = last.withColumn("source", F.explode(dotted_prefixes(F.col("subject")))).join(links, ["repo_id", "source"])
        subject = F.concat("exported", F.substring("subject", F.length("source") + 1, F.lit(2147483647)))
        moved = reached.withColumn("new_subject", subject).select(*[c for c in facts.columns if c not in ("fact_id", "subject", "provenance")], stable_id_column(F.lit("export"), F.col("target_path"), F.col("new_subject"), F.col("fact_id")).alias("fact_id"), F.col("new_subject").alias("subject"), F.concat("provenance", F.array("link")).alias("provenance"))
        fresh = _keyed(moved.select(facts.columns))
        fresh = fresh.groupBy(IDENTITY).agg(F.min_by(F.struct(*facts.columns), "fact_id").alias("row"))
        seen = _keyed(parts[0] if len(parts) == 1 else parts[0].unionByName(_union(parts[1:]))).select(IDENTITY)
        last = written(fresh.join(seen, IDENTITY, "left_anti").select("row.*"), "exports")
        if last.isEmpty():
            return _union(parts)
        parts.append(last)
    raise ValueError(f"re-exports form chains of more than {rounds} links")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def module_closure(edges: DataFrame, source: str, target: str) -> DataFrame:
    """source, target, hops: every node that each node reaches, over fewest edges.

    Semi-naive: a round extends only the pairs that the last one found, and an anti-join drops those known already. So there are as many
    rounds as the longest of the shortest ways has edges, cycles end, and no ways are listed, only pairs. A node reaches itself by an
    edge of its own alone.
    """
    links = written(edges.select(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target")).where("source IS NOT NULL AND target IS NOT NULL").distinct(), "edges")
    last = links.withColumn("hops", F.lit(1))
    found, hops = [last], 1
    onward = links.select(F.col("source").alias("target"), F.col("target").alias("next"))
    while not last.isEmpty():
        hops += 1
        reached = last.join(onward, "target").select("source", F.col("next").alias("target")).where("source <> target").distinct()
        last = written(reached.join(_union(found), ["source", "target"], "left_anti").withColumn("hops", F.lit(hops)), "reach")
        found.append(last)
    return _union(found)
