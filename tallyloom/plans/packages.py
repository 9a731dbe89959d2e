"""Package queries. One document per part; its releases and files follow from the size of the part."""

from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import packages as P
from tallyloom.plans.base import Tables, query
from tallyloom.plans.texts import RAW_NAME
from tallyloom.session import work_folder

NAME = "concat(replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '-' END), '_', CAST(p_partkey AS STRING))"


def documents(t: Tables):
    """(p_partkey, package_name, doc): every 5th document has no files, every 7th no description and no releases."""
    key = F.col("p_partkey")
    texts = t.documents.select(F.col("doc_id").alias("p_partkey"), "text")
    info = F.struct(
        F.expr(NAME).alias("name"), F.concat(F.lit("1."), "p_size").alias("version"), F.col("p_type").alias("summary"),
        F.when(key % 7 != 0, F.col("text")).alias("description"), F.when(key % 2 == 0, F.col("p_brand")).alias("author"),
        F.when(key % 4 == 0, F.array("p_brand", "p_type")).alias("classifiers"),
        F.when(key % 6 == 0, F.create_map(F.lit("home"), F.concat(F.lit("https://h/"), key.cast("string")))).alias("project_urls"))
    count = F.sequence(F.lit(1), F.greatest("p_size", F.lit(1)))
    keys = F.transform(count, lambda i: F.concat((F.lit(60) - i).cast("string"), F.lit("."), (i % 3).cast("string")))
    releases = F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit("[]")))
    urls = F.transform(count, lambda i: F.struct(
        F.when(i % 3 == 0, "sdist").otherwise("bdist_wheel").alias("packagetype"),
        F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("cp3"), (i % 5).cast("string"))).alias("python_version")))
    doc = F.to_json(F.struct(info.alias("info"), F.when(key % 7 != 0, releases).alias("releases"), F.when(key % 5 != 0, urls).alias("urls")))
    return t.part.join(texts, "p_partkey", "left").select("p_partkey", F.expr(NAME).alias("package_name"), doc.alias("doc"))


SQL = f"""d AS (SELECT p_partkey, {NAME} AS name, p_size, p_type, p_brand, text,
    CASE WHEN p_partkey % 7 = 0 THEN [] ELSE [concat(60 - i, '.', i % 3) FOR i IN range(1, greatest(p_size, 1) + 1)] END AS rel,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE range(1, greatest(p_size, 1) + 1) END AS u
  FROM part LEFT JOIN documents ON doc_id = p_partkey),
  k AS (SELECT p_partkey, name, concat('1.', p_size) AS version, p_type AS summary,
    CASE WHEN p_partkey % 7 = 0 OR text IS NULL THEN '' WHEN length(text) > 500 THEN concat(left(text, 500), '...') ELSE text END AS description,
    CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS author, '' AS license,
    CASE WHEN p_partkey % 4 = 0 THEN concat(p_brand, ',', p_type) ELSE '' END AS classifiers,
    CASE WHEN p_partkey % 6 = 0 THEN concat('https://h/', p_partkey) END AS home_link,
    CAST(len(rel) AS BIGINT) AS total_versions, array_to_string(rel[-10:], ',') AS available_versions,
    CAST(len(u) AS BIGINT) AS files_count,
    array_to_string(list_sort(list_distinct([CASE WHEN i % 3 = 0 THEN 'sdist' ELSE 'bdist_wheel' END FOR i IN u])), ',') AS file_types,
    array_to_string(list_sort(list_distinct([concat('cp3', i % 5) FOR i IN u IF i % 2 = 1])), ',') AS python_versions FROM d)"""


def table(t: Tables):
    return P.format_packages(P.parse(documents(t)), ["p_partkey"])


def flat(df, keep):
    joined = lambda c: F.array_join(c, ",")
    return df.select(
        *keep, "name", "version", "summary", "description", "author", "license", joined("classifiers").alias("classifiers"),
        F.try_element_at("project_urls", F.lit("home")).alias("home_link"), F.col("total_versions").cast("long").alias("total_versions"),
        joined("available_versions").alias("available_versions"), F.col("download_info.files_count").cast("long").alias("files_count"),
        joined("download_info.file_types").alias("file_types"), joined("download_info.python_versions").alias("python_versions"))


@query("k6_package_format", f"WITH {SQL} SELECT * FROM k")
def k6(t: Tables):
    return flat(table(t), ["p_partkey"])


@query("s7_package_doc_scan", f"WITH {SQL} SELECT name, version, total_versions FROM k")
def s7(t: Tables):
    """Documents are stored as JSON lines and read back with a declared schema, so reading needs no inference pass."""
    folder = work_folder(t.spark, "package-docs")
    documents(t).select("doc").write.text(folder)
    docs = t.spark.read.schema(P.SCHEMA).json(folder)
    return docs.select("info.name", "info.version", F.size(F.coalesce(F.map_keys("releases"), F.array().cast("array<string>"))).cast("long").alias("total_versions"))


@query("a6_distinct_sets", f"WITH {SQL} SELECT p_partkey, file_types, python_versions FROM k")
def a6(t: Tables):
    p = P.parse(documents(t))
    return p.select("p_partkey", F.array_join(P.distinct_types(F.col("p.urls")), ",").alias("file_types"),
                    F.array_join(P.distinct_pythons(F.col("p.urls")), ",").alias("python_versions"))


@query("a7_map_sizes", f"WITH {SQL} SELECT p_partkey, total_versions, coalesce(files_count, 0) AS files_count FROM k")
def a7(t: Tables):
    p = P.parse(documents(t))
    return p.select("p_partkey", F.size(P.release_keys(F.col("p"))).cast("long").alias("total_versions"),
                    F.greatest(F.coalesce(F.size("p.urls"), F.lit(0)), F.lit(0)).cast("long").alias("files_count"))


@query("l4_last_versions", f"WITH {SQL} SELECT p_partkey, available_versions FROM k")
def l4(t: Tables):
    p = P.parse(documents(t))
    return p.select("p_partkey", F.array_join(P.last_versions(P.release_keys(F.col("p"))), ",").alias("available_versions"))


def normal_sql(column: str) -> str:
    return f"CASE WHEN regexp_matches({column}, '^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?$') THEN regexp_replace(lower({column}), '[-_.]+', '-', 'g') END"


REQUEST = f"CASE WHEN p_partkey % 2 = 0 THEN upper({NAME}) ELSE {RAW_NAME} END"


@query("k7_package_lookup", f"""
WITH {SQL}, r AS (SELECT p_partkey AS request, {REQUEST} AS package_name FROM part), n AS (SELECT *, {normal_sql('package_name')} AS nk FROM r),
  kk AS (SELECT *, {normal_sql('name')} AS nk FROM k)
SELECT n.package_name, kk.name, kk.version, CASE WHEN kk.nk IS NOT NULL THEN NULL WHEN n.nk IS NULL THEN concat('Invalid package name: ''', n.package_name, '''')
    ELSE concat('Package ''', n.nk, ''' not found on PyPI') END AS error,
  CASE WHEN kk.nk IS NOT NULL THEN NULL WHEN n.nk IS NULL THEN 'InvalidPackageNameError' ELSE 'PackageNotFoundError' END AS error_type
FROM n LEFT JOIN kk ON n.nk = kk.nk""")
def k7(t: Tables):
    packages = table(t).select(X.normal_package_name(F.col("name")).alias("name_key"), "name", "version")
    return P.lookup(t.part.select(F.expr(REQUEST).alias("package_name")), packages)


@query("j4_presence_status", """
WITH i AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40),
     u AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48)
SELECT concat('pkg', p_partkey) AS package, CASE WHEN i.k IS NOT NULL THEN 'installed' ELSE 'not installed' END AS installed,
       u.k IS NOT NULL AS upgradable, CASE WHEN p_retailprice > 1000 THEN 'available' ELSE 'not available' END AS available
FROM part LEFT JOIN i ON i.k = p_partkey LEFT JOIN u ON u.k = p_partkey""")
def j4(t: Tables):
    name = lambda c: F.concat(F.lit("pkg"), F.col(c).cast("string"))
    lines = t.lineitem
    return P.presence(
        t.part.select(name("p_partkey").alias("package")),
        lines.where("l_returnflag = 'R' AND l_quantity > 40").select(name("l_partkey").alias("package")),
        lines.where("l_quantity > 48").select(F.concat(name("l_partkey"), F.lit("/stable 2.0 amd64")).alias("line")),
        t.part.where("p_retailprice > 1000").select(name("p_partkey").alias("package")))
