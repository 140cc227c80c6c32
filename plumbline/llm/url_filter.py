"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes are counted by host, registered domain and suffix. Each level is a beta-binomial whose prior is the
level above; how strongly it pulls is estimated from how much the level's rates scatter. A host is blocked if even the
lower bound of its posterior rate of bad pages is high. Stated rules come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import join_unique, spool


@dataclass(frozen=True)
class Rule:
    """verdict for all urls of host and its subdomains whose path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))
#: Second labels under which names are registered, by top-level label; any other suffix is the last label alone.
SECOND_LEVELS = {
    "ae": "ac co gov net org", "ar": "com edu gob gov int mil net org", "at": "ac co gv or", "au": "asn com edu gov id net org", "bd": "ac com edu gov net org",
    "br": "art blog com edu gov ind inf jus leg mil net org", "cn": "ac com edu gov mil net org", "co": "com edu gov mil net nom org", "cy": "ac com gov net org",
    "ec": "com edu fin gob gov info med net org", "eg": "com edu eun gov net org", "es": "com edu gob nom org", "gh": "com edu gov org", "gr": "com edu gov net org",
    "hk": "com edu gov idv net org", "hu": "co info org", "id": "ac co desa go mil my net or sch web", "il": "ac co gov idf k12 muni net org",
    "in": "ac co edu firm gen gov ind mil net nic org res", "jp": "ac ad co ed go gr lg ne or", "ke": "ac co go info me ne or sc", "kr": "ac co go mil ne or pe re",
    "lk": "ac com edu gov net org", "mx": "com edu gob net org", "my": "com edu gov mil name net org", "ng": "com edu gov net org sch", "np": "com edu gov net org",
    "nz": "ac co cri geek gen govt health iwi maori mil net org school", "pe": "com edu gob mil net nom org", "ph": "com edu gov net ngo org", "pk": "com edu fam gov net org web",
    "pl": "com edu gov info net org waw", "pt": "com edu gov nome org", "ro": "com info nom org", "rs": "ac co edu gov in org", "sa": "com edu gov med net org sch",
    "sg": "com edu gov net org per", "th": "ac co go in mi net or", "tr": "av bel biz com edu gen gov info k12 mil name net org pol web", "tw": "club com ebiz edu game gov idv mil net org",
    "ua": "com edu gov in kiev kyiv lviv net org", "uk": "ac co gov ltd me net nhs org plc police sch", "uy": "com edu gub mil net org", "ve": "co com edu gob info mil net org web",
    "vn": "ac com edu gov health info int name net org pro", "za": "ac co edu gov law mil net nom org school web",
}
LONG_SUFFIXES = tuple(sorted(f"{second}.{top}" for top, seconds in SECOND_LEVELS.items() for second in seconds.split()))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does; among equals in length the name decides."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _strength(children: DataFrame) -> float:
    """Prior strength (pseudo-counts) of one level by moments, from n, bad, and the parent's n_up, bad_up of each child."""
    n, rate, up = F.col("n"), F.col("bad") / F.col("n"), F.col("bad_up") / F.col("n_up")
    p = F.sum("bad") / F.sum("n")
    pq = F.greatest(p * (1 - p), F.lit(1e-9))
    free = F.count(F.lit(1)) - F.sum(n / F.col("n_up"))
    spread = F.sum(n * (rate - up) * (rate - up)) - pq * free
    room = pq * (F.sum("n") - F.sum(n * n / F.col("n_up")) - free)
    rho = F.least(F.greatest(F.when(room > 1e-9, spread / room).otherwise(F.lit(0.0)), F.lit(1e-3)), F.lit(0.999))
    return float(children.agg(F.coalesce((1 - rho) / rho, F.lit(999.0))).first()[0])


def reputations(outcomes: DataFrame, suffixes_of_two: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """host, rows, mean, low: posterior mean and lower bound (one normal deviation of 1.645) of each host's rate of bad pages.

    outcomes: host and bad (1, 0, or null for unlabelled pages). Counts are reduced before they are shuffled. A host without
    labelled pages has its domain's prior, a domain its suffix's, a suffix the overall rate; with no labels at all that is 1/2.
    """
    labelled = F.col("bad").isNotNull().cast("long")
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("rows"), F.sum(labelled).alias("n"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0).cast("long"))).alias("bad"))
    hosts = spool(hosts.select("host", domain_of(F.col("host"), suffixes_of_two).alias("domain"), suffix_of(F.col("host"), suffixes_of_two).alias("suffix"), "rows", "n", "bad"), "hosts")
    domains = spool(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("members")), "domains")
    suffixes = spool(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("members")), "suffixes")
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()

    def posterior(frame: DataFrame, mean_up: Column) -> DataFrame:
        return frame.withColumn("c", F.lit(_strength(frame.where("n > 0")))).withColumn("mean_up", mean_up).withColumn("mean", (F.col("bad") + F.col("c") * F.col("mean_up")) / (F.col("n") + F.col("c")))

    suffixes = posterior(suffixes.withColumn("n_up", F.lit(total["n"])).withColumn("bad_up", F.lit(total["bad"])), F.lit((total["bad"] + 1.0) / (total["n"] + 2.0)))
    domains = _children(domains, suffixes, "suffix", posterior)
    hosts = _children(hosts, domains, "domain", posterior)
    a_b = F.col("n") + F.col("c")
    low = F.col("mean") - 1.645 * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (a_b + 1))
    return hosts.select("host", "rows", "mean", low.alias("low"))


def _children(frame: DataFrame, up: DataFrame, key: str, posterior) -> DataFrame:
    above = up.select(key, F.col("n").alias("n_up"), F.col("bad").alias("bad_up"), F.col("mean").alias("mean_of_up"), F.col("members").alias("members_of_up"))
    return posterior(join_unique(frame, above, key, "members_of_up"), F.col("mean_of_up"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, most_bad: float = 0.5, id_col: str = "page_id", url_col: str = "url", suffixes_of_two: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """id_col, host, path, rule, verdict (allow or block), rate (posterior mean of bad pages) for every row of pages.

    outcomes: id_col and bad (0 or 1; null is unlabelled); several labels of one page count once, as bad if any is.
    Null urls and urls without "://" have empty host and path and are judged with the reputation of the empty host.
    Repeated rows and null ids stay; an empty table gives an empty result; extra columns are left behind, whatever their names; urls of any
    length are read whole. A hot host is joined by broadcast of at most 1,000 hosts. suffixes_of_two are the public suffixes of two
    labels; under any other the last label is the suffix.
    """
    parsed = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = outcomes.where(F.col("bad").isNotNull()).groupBy(id_col).agg(F.max("bad").alias("bad"))
    hosts = spool(reputations(parsed.join(known, id_col, "left").select("host", "bad"), suffixes_of_two), "reputations")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("low") > most_bad, F.lit("block")).otherwise(F.lit("allow"))
    return join_unique(parsed, hosts, "host", "rows").select(id_col, "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("mean", 6).alias("rate"))
