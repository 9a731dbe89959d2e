"""One place to keep named results and to reach the operators: ``Workspace(spark)``.

Every workspace has a Spark session of its own, so views of one are not seen by another. Nothing here collects tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions import helpers, numbers as N, text as X
from tallyloom.operators import codesearch, joblog, named, packages, payloads, symbols
from tallyloom.operators.registry import KEPT_ON_RESET
from tallyloom.session import prepare
from tallyloom.sources import codefiles, files


class Workspace:
    def __init__(self, spark: SparkSession):
        self.spark = prepare(spark.newSession())
        self.tables: dict[str, DataFrame] = {}
        self.languages = list(X.SYMBOL_LANGUAGES)
        helpers.register(self.spark)

    # named results

    def save(self, name: str, df: DataFrame, command: str = "") -> DataFrame:
        """Keeps df under name, replacing what had it, and gives the status row."""
        if df.sparkSession is not self.spark:
            raise ValueError("the table belongs to another session; read it through workspace.spark")
        self.tables[name] = df
        return named.save(df, name, command)

    def query(self, sql: str, save_as: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(status row, cleaned JSON records). A failing query gives success = false and leaves the names as they were."""
        status, records = named.run_sql(self.spark, sql, save_as)
        if save_as and status.first().success:
            self.tables[save_as] = self.spark.table(save_as)
        return status, records

    def inventory(self) -> DataFrame:
        return named.inventory(self.tables)

    def summary(self, name: str, order: list[str]) -> DataFrame:
        return named.result_summary(self.tables[name], order)

    def records(self, name: str) -> DataFrame:
        return N.json_records(self.tables[name])

    def reset(self, keep: int = KEPT_ON_RESET) -> list[str]:
        """Drops all names but the first ``keep`` public ones, in the order they were saved."""
        kept = [n for n in self.tables if not n.startswith("_")][:keep]
        for name in [n for n in self.tables if n not in kept]:
            self.spark.catalog.dropTempView(name)
            del self.tables[name]
        return kept

    def snapshot(self, folder: str) -> list[str]:
        return named.snapshot(self.tables, folder)

    def restore(self, folder: str) -> list[str]:
        """Takes in what a snapshot holds; gives the names that could not be read."""
        found, lost = named.restore(self.spark, folder)
        self.tables.update(found)
        return lost

    # sources

    def read_csv(self, path: str, schema: str | None = None, **options) -> DataFrame:
        return files.read_csv(self.spark, path, schema, **options)

    def typed_rows(self, payload_table: DataFrame, schema: str | None = None) -> DataFrame:
        return payloads.records_to_rows(payload_table, schema)

    # code

    def configure_languages(self, wanted: list[str]) -> list[str]:
        """Sets the languages that searches cover. Any unknown name rejects the whole request."""
        asked = [w.strip().lower() for w in wanted if w.strip()]
        unknown = [w for w in asked if w not in X.SYMBOL_LANGUAGES]
        if unknown or not asked:
            raise ValueError(f"unknown languages: {unknown}" if unknown else "no language given")
        self.languages = asked
        return asked

    def index_code(self, root: str, folder: str) -> "CodeIndex":
        """Parses the code below root once and writes files and symbols below folder, to be searched many times."""
        found, bad = codefiles.readable(codefiles.scan_code_files(self.spark, root))
        found.write.mode("overwrite").parquet(f"{folder}/files")
        stored = self.spark.read.parquet(f"{folder}/files")
        parsed, errors = symbols.extract(stored)
        symbols.with_owner(parsed).write.mode("overwrite").partitionBy("language").parquet(f"{folder}/symbols")
        bad.unionByName(errors).write.mode("overwrite").parquet(f"{folder}/errors")
        return CodeIndex(self, root, folder)

    # packages and jobs

    def package_lookup(self, names: DataFrame, documents: DataFrame) -> DataFrame:
        """(package_name) against (doc): package rows, with error and error_type where there is none."""
        table = packages.format_packages(packages.parse(documents), [])
        keyed = table.withColumn("name_key", X.normal_package_name(F.col("name")))
        return packages.lookup(names, keyed)

    def log_pages(self, requests: DataFrame, folder: str) -> DataFrame:
        return joblog.log_page(requests, files.read_logs(self.spark, folder))


class CodeIndex:
    """Symbols of one code base, read back from where they were written."""

    def __init__(self, workspace: Workspace, root: str, folder: str):
        self.workspace, self.root = workspace, root
        read = workspace.spark.read
        self.files, self.symbols, self.errors = (read.parquet(f"{folder}/{n}") for n in ("files", "symbols", "errors"))

    def register(self) -> list[str]:
        """Table functions over this index for the workspace's SQL, in the languages that searches cover now; gives their names."""
        within = self.workspace.languages
        return helpers.register_code(codesearch.in_languages(self.symbols, within), codesearch.in_languages(self.files, within))

    def find_methods(self, name: str, class_name: str = "") -> DataFrame:
        return codesearch.find_methods(self.symbols, self.files, name, class_name, self.workspace.languages)

    def find_classes(self, name: str) -> DataFrame:
        return codesearch.find_classes(self.symbols, self.files, name, self.workspace.languages)

    def methods(self) -> DataFrame:
        return codesearch.list_methods(codesearch.in_languages(self.symbols, self.workspace.languages))

    def classes(self) -> DataFrame:
        return codesearch.list_classes(codesearch.in_languages(self.symbols, self.workspace.languages))

    def stats(self) -> DataFrame:
        return codesearch.codebase_stats(self.files, self.root, self.workspace.languages)
