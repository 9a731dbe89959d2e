"""Helper functions registered by name in every workspace, as SQL functions that Catalyst inlines: scalar ones, and table
functions over an index of code, which can be called with constants or, by LATERAL, with columns of a table. Either way a
search is a filter or a join of the index, of which only the files of found symbols are read for their text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, types as T

HELPERS = {
    "tl_clean_number(x DOUBLE) RETURNS STRING":
        "CASE WHEN x IS NULL OR isnan(x) THEN NULL WHEN x = double('Infinity') THEN 'Infinity' WHEN x = double('-Infinity') THEN '-Infinity' ELSE string(round(x, 10)) END",
    "tl_preview(s STRING) RETURNS STRING": "CASE WHEN length(s) > 500 THEN concat(left(s, 500), '...') ELSE coalesce(s, '') END",
    "tl_package_name(s STRING) RETURNS STRING":
        "CASE WHEN s RLIKE '^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?$' THEN regexp_replace(lower(s), '[-_.]+', '-') END",
    "tl_megabytes(n BIGINT) RETURNS DOUBLE": "round(n / 1048576D, 2)",
    "tl_first_line(s STRING) RETURNS STRING": "substring_index(s, '\\n', 1)",
    "tl_is_table(s STRING) RETURNS BOOLEAN": "coalesce(schema_of_variant(try_parse_json(s)) LIKE 'ARRAY%', FALSE)",
    "tl_json_text(s STRING, f STRING) RETURNS STRING": "get_json_object(s, concat('$.', f))",
    "tl_epoch(t TIMESTAMP) RETURNS BIGINT": "unix_seconds(t)",
}
#: Views that the table functions read: symbols with class_name, and files.
SYMBOLS, FILES = "tl_symbols", "tl_files"
_FOUND = "name STRING, implementation STRING, file_path STRING, line_start BIGINT, line_end BIGINT, doc_comment STRING, class_name STRING, result_type STRING"
_SEARCH = f"""SELECT s.name, CAST(substring(encode(f.content, 'UTF-8'), CAST(s.start_byte + 1 AS INT), CAST(s.end_byte - s.start_byte AS INT)) AS STRING),
    s.path, s.line_start, s.line_end, s.doc_comment, s.class_name, s.kind FROM {SYMBOLS} s JOIN {FILES} f ON s.path = f.path"""
TABLE_FUNCTIONS = {
    f"tl_find_methods(wanted STRING) RETURNS TABLE ({_FOUND})": f"{_SEARCH} WHERE s.kind = 'method' AND s.name = wanted",
    f"tl_find_methods_of(wanted STRING, owner STRING) RETURNS TABLE ({_FOUND})": f"{_SEARCH} WHERE s.kind = 'method' AND s.name = wanted AND s.class_name = owner",
    f"tl_find_classes(wanted STRING) RETURNS TABLE ({_FOUND})": f"{_SEARCH} WHERE s.kind = 'class' AND s.name = wanted",
    "tl_methods() RETURNS TABLE (method_name STRING, class_name STRING, file_path STRING)": f"SELECT name, class_name, path FROM {SYMBOLS} WHERE kind = 'method'",
    "tl_classes() RETURNS TABLE (class_name STRING, file_path STRING)": f"SELECT name, path FROM {SYMBOLS} WHERE kind = 'class'",
    "tl_code_stats() RETURNS TABLE (language STRING, file_count BIGINT)": f"SELECT language, count(*) FROM {FILES} GROUP BY language",
}
# JSON-schema type -> column type.
TYPES = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(),
         "array": T.ArrayType(T.VariantType()), "object": T.MapType(T.StringType(), T.VariantType())}


def register(spark: SparkSession) -> list[str]:
    for head, body in HELPERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in HELPERS]


def register_code(symbols: DataFrame, files: DataFrame) -> list[str]:
    """Makes the table functions search ``symbols`` (as ``with_owner`` gives them) and ``files`` (path, language, content) in
    their session. Both should be stored tables, as every call reads them. A later index takes the place of an earlier one."""
    symbols.createOrReplaceTempView(SYMBOLS)
    files.createOrReplaceTempView(FILES)
    for head, body in TABLE_FUNCTIONS.items():
        symbols.sparkSession.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in TABLE_FUNCTIONS]


def schema_struct(text: str) -> T.StructType:
    """JSON schema text -> row schema, required properties first and not nullable."""
    doc = json.loads(text)
    required = set(doc.get("required", []))
    props = doc.get("properties", {})
    ordered = [p for p in props if p in required] + [p for p in props if p not in required]
    return T.StructType([T.StructField(p, TYPES.get(props[p].get("type", "string"), T.VariantType()), p not in required) for p in ordered])
