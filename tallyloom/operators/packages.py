"""Package documents -> package table, lookups and presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import text as X

# Text fields and list fields of a package record, in output order.
TEXT_FIELDS = [
    "name", "version", "summary", "description", "author", "author_email", "maintainer", "maintainer_email", "license",
    "home_page", "project_url", "download_url", "requires_python", "platform", "keywords",
]
LIST_FIELDS = ["classifiers", "requires_dist"]
SHOWN_VERSIONS = 10

SCHEMA = (
    "info struct<" + ",".join(f"{f}:string" for f in TEXT_FIELDS) + "," + ",".join(f"{f}:array<string>" for f in LIST_FIELDS)
    + ",project_urls:map<string,string>>, releases map<string,string>, urls array<struct<packagetype:string,python_version:string>>"
)


def parse(docs: DataFrame, text: str = "doc") -> DataFrame:
    """Document text -> struct ``p``. Release keys keep the order they have in the document."""
    return docs.withColumn("p", F.from_json(text, SCHEMA))


def last_versions(keys: Column, n: int = SHOWN_VERSIONS) -> Column:
    return F.slice(keys, F.greatest(F.size(keys) - n + 1, F.lit(1)), n)


def distinct_types(urls: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(urls, lambda u: F.coalesce(u["packagetype"], F.lit("")))))


def distinct_pythons(urls: Column) -> Column:
    versions = F.filter(F.transform(urls, lambda u: u["python_version"]), lambda v: v.isNotNull() & (v != ""))
    return F.array_sort(F.array_distinct(versions))


def release_keys(p: Column) -> Column:
    return F.coalesce(F.map_keys(p["releases"]), F.array().cast("array<string>"))


def format_packages(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """The 21-column package table beside the ``keep`` columns."""
    p, info = F.col("p"), F.col("p.info")
    texts = [(X.preview(info[f]) if f == "description" else F.coalesce(info[f], F.lit(""))).alias(f) for f in TEXT_FIELDS]
    lists = [F.coalesce(info[f], F.array().cast("array<string>")).alias(f) for f in LIST_FIELDS]
    urls = p["urls"]
    download = F.when(F.size(urls) > 0, F.struct(
        F.size(urls).alias("files_count"), distinct_types(urls).alias("file_types"), distinct_pythons(urls).alias("python_versions")))
    return parsed.select(
        *keep, *texts, *lists, F.coalesce(info["project_urls"], F.create_map().cast("map<string,string>")).alias("project_urls"),
        F.size(release_keys(p)).alias("total_versions"), last_versions(release_keys(p)).alias("available_versions"), download.alias("download_info"))


def lookup(requested: DataFrame, packages: DataFrame) -> DataFrame:
    """Requested names (package_name) joined to packages (name_key, ...), with ``error`` and ``error_type`` where none is found."""
    name = F.col("package_name")
    keyed = requested.withColumn("name_key", X.normal_package_name(name))
    valid = keyed.where("name_key IS NOT NULL").join(packages.withColumn("_found", F.lit(True)), "name_key", "left")
    error = F.when(F.col("_found").isNull(), F.concat(F.lit("Package '"), F.col("name_key"), F.lit("' not found on PyPI")))
    kind = F.when(F.col("_found").isNull(), "PackageNotFoundError")
    answered = valid.withColumn("error", error).withColumn("error_type", kind).drop("_found", "name_key")
    # names without a key go around the join, where they would all meet in one task
    invalid = keyed.where("name_key IS NULL").drop("name_key").withColumn(
        "error", F.concat(F.lit("Invalid package name: '"), F.coalesce(name, F.lit("None")), F.lit("'"))).withColumn(
        "error_type", F.lit("InvalidPackageNameError"))
    return answered.unionByName(invalid, allowMissingColumns=True)


def presence(requested: DataFrame, installed: DataFrame, upgrade_lines: DataFrame, available: DataFrame) -> DataFrame:
    """(package) against installed (package), lines ``name/...`` of upgrades (line) and available (package)."""
    upgradable = upgrade_lines.select(F.substring_index("line", "/", 1).alias("package")).distinct()
    df = requested.join(installed.select("package").distinct().withColumn("_i", F.lit(True)), "package", "left")
    df = df.join(upgradable.withColumn("_u", F.lit(True)), "package", "left")
    df = df.join(available.select("package").distinct().withColumn("_a", F.lit(True)), "package", "left")
    return df.select(
        "package", F.when(F.col("_i"), "installed").otherwise("not installed").alias("installed"),
        F.coalesce("_u", F.lit(False)).alias("upgradable"), F.when(F.col("_a"), "available").otherwise("not available").alias("available"))
