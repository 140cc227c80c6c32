"""Queries over every row of their tables, against brute force on small fixtures."""

from plumbline.operators import snapshot
from plumbline.operators.align import align
from plumbline.operators.exports import module_closure
from plumbline.plans import relational


def test_request_budget_takes_every_event(spark, tmp_path):
    events = [(1_000_000 - i, (7, 99, 100, 1499)[i % 4], float(i * 37 % 90) + 0.5) for i in range(160)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for user in (7, 99, 100, 1499):
        n = used = refused = 0
        for cost in [int(v * 10) for _, u, v in sorted(events) if u == user]:
            if n < 20 and used + cost <= 5_000:
                n, used = n + 1, used + cost
            else:
                refused += 1
        want[user] = (n, refused, 160 * 6)
    assert {r.user_id: (r.granted, r.refused, r.requests) for r in relational.request_budget(spark, str(tmp_path)).collect()} == want


def parts(spark, folder):
    rows = [(i, f"{('cold', 'small', 'large')[i % 3]} {('ring', 'widget')[i % 2]}", ("ECONOMY", "LARGE")[i % 4 // 2], i % 7 + 1, float(i * 31 % 50)) for i in range(1, 121)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return rows


def symbols(rows):
    """Facts (id, subject, property, path, number) and claims (id, subject, property, hint)."""
    facts = [(f"f{k:09d}", f"m{k % 97}.{name.replace(' ', '.')}", kind, f"s{size % 3}", k) for k, name, kind, size, _ in rows]
    claims = []
    for k, name, kind, size, _ in rows:
        dotted = name.replace(" ", ".")
        subject = "" if k % 41 == 0 else (dotted, dotted.split(".")[-1], f"m{k % 97}.{dotted}")[k % 3]
        claims.append((str(k), subject, kind, f"s{size % 3}" if k % 4 == 0 else None))
    return facts, claims


def test_alignment_claims_every_part(spark, tmp_path):
    facts, claims = symbols(parts(spark, tmp_path))
    want = []
    for claim, subject, kind, hint in claims:
        near = [f for f in facts if f[2] == kind and subject and (f[1] == subject or f[1].endswith("." + subject))]
        near = [f for f in near if f[1] == subject] or near
        ids = sorted(f[0] for f in near if hint in (None, f[3]))
        reason = "AMBIGUOUS" if len(ids) > 1 else "MATCH" if ids else "NO_CANDIDATE"
        want += [(claim, f, i + 1, len(ids), reason) for i, f in enumerate(ids[:3] or [None])]
    got = [tuple(r) for r in relational.align_candidates(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r[0] for r in got} == {str(k) for k in range(1, 121)}
    assert {r[4] for r in got} == {"AMBIGUOUS", "MATCH", "NO_CANDIDATE"}
    first = {kind: sorted((f[3], f[4], f[0]) for f in facts if f[2] == kind)[:3] for kind in ("ECONOMY", "LARGE")}
    want = [(claim, f, i + 1) for claim, _, kind, _ in claims for i, (_, _, f) in enumerate(first[kind])]
    assert sorted(tuple(r) for r in relational.align_property_only(spark, str(tmp_path)).collect()) == sorted(want)


def test_recall_scores_every_part(spark, tmp_path):
    rows = parts(spark, tmp_path)
    ranks = []
    for k, _, kind, size, price in rows:
        if k % 30:
            ranks.append(1 + sum((p, x) < (price, k) for x, _, t, s, p in rows if (t, s) == (kind, size)))
    want = {k: (sum(r <= k for r in ranks), 120, round(sum(r <= k for r in ranks) / 120, 9)) for k in (1, 3, 5, 10)}
    assert {r.k: (r.hits, r.targets, r.recall) for r in relational.recall_at_k(spark, str(tmp_path)).collect()} == want


def test_closure_of_a_complete_graph(spark):
    edges = spark.range(30).selectExpr("id a").crossJoin(spark.range(30).selectExpr("id b")).where("a <> b").union(spark.createDataFrame([(29, 40), (40, 41), (41, 41), (50, None)], "a long, b long"))
    got = {(r.source, r.target): r.hops for r in module_closure(edges, "a", "b").collect()}
    want = {(str(a), str(b)): 1 for a in range(30) for b in range(30) if a != b} | {("40", "41"): 1, ("41", "41"): 1}
    want |= {(str(a), "40"): 1 if a == 29 else 2 for a in range(30)} | {(str(a), "41"): 2 if a == 29 else 3 for a in range(30)}
    assert got == want
    assert module_closure(edges.limit(0), "a", "b").collect() == []


def test_folds_are_linear_and_in_order(spark):
    files = spark.range(60_000).selectExpr("'r' repo_id", "lpad(cast(id as string), 9, '0') path", "id % 7 size").union(spark.createDataFrame([("s", "b", 5), ("s", "a", 9), ("s", "c", 1)], "repo_id string, path string, size long"))
    got = {(r.repo_id, r.path): r.admitted for r in snapshot.admit(files, max_total=100).collect()}
    used, want = 0, {}
    for i in range(60_000):
        want["r", f"{i:09d}"] = used + i % 7 <= 100
        used += i % 7 * want["r", f"{i:09d}"]
    assert got == want | {("s", "a"): True, ("s", "b"): True, ("s", "c"): True}
    assert snapshot.admit(files.limit(0)).collect() == []


def test_a_common_name_is_not_aligned_pair_by_pair(spark):
    facts = spark.range(10_000).selectExpr("'r' repo_id", "'f' || lpad(cast(id as string), 9, '0') fact_id", "'m' || id || '.item' subject", "'size' property", "named_struct('path', 'p' || id % 3) span", "cast(id as int) seq")
    claims = spark.range(10_000).selectExpr("'r' repo_id", "cast(id as string) claim_id", "case when id = 7 then 'm7.item' when id = 8 then '' else 'item' end subject", "'size' predicate", "case when id % 2 = 0 then 'p' || id % 4 end source_hint")
    out = align(claims, facts, 2)
    got = out.groupBy("matches", "reason").count().collect()
    assert {(r.matches, r["count"]) for r in got} == {(10_000, 2 * 4_999), (3_334, 2 * 2_499), (3_333, 2 * 2_500), (1, 1), (0, 1)}
    rows = {r.claim_id: (r.fact.fact_id, r["rank"]) for r in out.where("claim_id in ('1', '7') and rank = 1").collect()}
    assert rows == {"1": ("f000000000", 1), "7": ("f000000007", 1)}
