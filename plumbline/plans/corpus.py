"""Repositories made from the part table: the answer to every scan of them follows from the part's key.

Part k has pkg/pK.py with a function item and docs/pK.md that states a default value of it. The key decides what is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = "0123456789abcdef0123456789abcdef01234567"
REPOS = 8
#: Parts of one task, so that a task's work doesn't grow with the table.
ROWS = 50_000


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("string").alias("size"), F.col("p_brand").alias("brand"))
    tasks = max(spark.sparkContext.defaultParallelism, rows.count() // ROWS)
    return rows.repartition(tasks, "k")  # three short columns, before each row becomes files to parse


def _k() -> Column:
    return F.col("k").cast("string")


def _size() -> Column:
    return F.when(F.col("k") % 17 == 0, "factory()").otherwise(F.col("size"))


def _files(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    return rows.select(F.concat(F.lit("repo"), (F.col("k") % REPOS).cast("string")).alias("repo_id"), F.lit(HEAD).alias("head_sha"), path.alias("path"), content.cast("binary").alias("content"))


def code_text() -> Column:
    return F.concat(F.lit("def item(size="), _size(), F.lit(", brand='"), F.col("brand"), F.lit("'):\n    pass\n"))


def doc_text() -> Column:
    value = F.when(F.col("k") % 7 == 0, (F.col("size").cast("int") + 1).cast("string")).otherwise(F.col("size"))
    owner = F.when(F.col("k") % 19 == 0, F.concat(F.lit("p"), _k(), F.lit(".item"))).otherwise(F.concat(F.lit("pkg.p"), _k(), F.lit(".item")))
    heading = F.concat(F.when(F.col("k") % 11 == 0, "Legacy ").otherwise(""), F.lit("`"), owner, F.lit("`"))
    verb = F.when(F.col("k") % 13 == 0, " usually defaults to ").otherwise(" defaults to ")
    return F.concat(F.lit("## "), heading, F.lit("\n\n`size`"), verb, F.lit("`"), value, F.lit("`.\n"))


def default_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    at = lambda folder, end: F.concat(F.lit(folder), _k(), F.lit(end))
    twins = _files(rows.where("k % 19 = 0"), at("alt/p", ".py"), code_text())
    return _files(rows, at("pkg/p", ".py"), code_text()).unionByName(twins).unionByName(_files(rows, at("docs/p", ".md"), doc_text()))


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    update = F.when(F.col("k") % 7 == 0, "CFG.update(other)\n").when(F.col("k") % 5 == 0, "CFG.update(size=1)\n").otherwise("")
    text = F.concat(F.lit("CFG = {'size': "), _size(), F.lit(", 'brand': '"), F.col("brand"), F.lit("'}\n"), update)
    return _files(parts(spark, sf_dir), F.concat(F.lit("conf/p"), _k(), F.lit(".py")), text)


def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("| `size` | `"), F.col("size"), F.lit("` |\n| brand | "), F.lit("'"), F.col("brand"), F.lit("' |\n| a\\|b | 1 |\n"))
    text = F.concat(F.lit("# `pkg.p"), _k(), F.lit(".item`\n\n| Parameter | Default |\n|---|---|\n"), row)
    return _files(parts(spark, sf_dir), F.concat(F.lit("docs/t"), _k(), F.lit(".md")), text)


#: Arguments of the example by k % 6, and what binding them to item(size=…, brand=…) gives.
CALLS = {0: ("", "CALL_ACCEPTED"), 1: ("1, brand='x'", "CALL_ACCEPTED"), 2: ("1, 2, 3", "CALL_BINDING_ERROR"), 3: ("1, size=2", "CALL_BINDING_ERROR"), 4: ("colour=3", "CALL_BINDING_ERROR"), 5: ("*rest", "DYNAMIC_CALL")}


def call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    arguments = F.element_at(F.array(*[F.lit(a) for a, _ in CALLS.values()]), (F.col("k") % 6 + 1).cast("int"))
    text = F.concat(F.lit("# Use\n\n```python\nfrom pkg.p"), _k(), F.lit(" import item\nitem("), arguments, F.lit(")\n```\n"))
    code = F.concat(F.lit("def item(size="), F.col("size"), F.lit(", brand='"), F.col("brand"), F.lit("'):\n    pass\n"))
    return _files(rows, F.concat(F.lit("docs/c"), _k(), F.lit(".md")), text).unionByName(_files(rows, F.concat(F.lit("pkg/p"), _k(), F.lit(".py")), code))


def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions define f; nations re-export it from their region, suppliers from their nation as g."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    file = lambda df, path, text: df.select(F.lit("geo").alias("repo_id"), F.lit(HEAD).alias("head_sha"), path.alias("path"), text.cast("binary").alias("content"))
    r, n, s = F.col("r_regionkey").cast("string"), F.col("n_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    regions = file(read("region"), F.concat(F.lit("geo/r"), r, F.lit(".py")), F.concat(F.lit("def f(x="), r, F.lit("): pass\n")))
    nations = file(read("nation"), F.concat(F.lit("geo/n"), n, F.lit(".py")), F.concat(F.lit("from .r"), F.col("n_regionkey").cast("string"), F.lit(" import f\n")))
    suppliers = file(read("supplier"), F.concat(F.lit("sup/s"), s, F.lit(".py")), F.concat(F.lit("from geo.n"), F.col("s_nationkey").cast("string"), F.lit(" import f as g\n")))
    return regions.unionByName(nations).unionByName(suppliers)


def part_key(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("long")
