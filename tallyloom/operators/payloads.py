"""Payload text -> typed rows.

A payload table has ``payload_id`` and ``payload`` (text). ``classify`` decides which shape each payload has; one function
per shape turns the payloads of that shape into rows. Payloads are values of one row, so no step here groups rows.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyloom.functions import text as X


def _shape(value: Column) -> Column:
    return F.schema_of_variant(value)


def unwrap_text(payload: Column) -> Column:
    """Undo JSON strings that hold text again. Every nesting doubles the escapes, so log2(length) rounds are enough."""

    def step(text: Column, _: Column) -> Column:
        parsed = F.try_parse_json(text)
        return F.when(_shape(parsed) == "STRING", F.try_variant_get(parsed, "$", "string")).otherwise(text)

    quoted = F.ltrim(payload).startswith('"')
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.length(payload) + 2)).cast("int"))
    return F.when(quoted, F.aggregate(rounds, payload, step)).otherwise(payload)


def classify(payloads: DataFrame) -> DataFrame:
    """Adds ``text`` (payload with JSON quoting undone), ``value`` (VARIANT, null when not JSON) and ``kind``.

    kind: null, records, rows, columns, object, nested, scalar, csv.
    """
    df = payloads.withColumn("text", unwrap_text(F.col("payload")))
    df = df.withColumn("value", F.try_parse_json("text"))
    shape = _shape(F.col("value"))
    items = F.try_variant_get("value", "$", "array<variant>")
    entries = F.map_values(F.try_variant_get("value", "$", "map<string,variant>"))
    lists = F.transform(entries, lambda x: F.try_variant_get(x, "$", "array<variant>"))
    all_lists = F.forall(entries, lambda x: _shape(x).startswith("ARRAY"))
    one_length = F.size(F.array_distinct(F.transform(lists, F.size))) <= 1
    flat = F.forall(entries, lambda x: ~_shape(x).startswith("ARRAY") & ~_shape(x).startswith("OBJECT"))
    array_kind = (
        F.when(F.size(items) == 0, "scalar")
        .when(F.forall(items, lambda x: _shape(x).startswith("OBJECT")), "records")
        .when(F.forall(items, lambda x: _shape(x).startswith("ARRAY")), "rows")
        .otherwise("scalar")
    )
    object_kind = F.when(all_lists & one_length, "columns").when(flat, "object").otherwise("nested")
    kind = (
        F.when(F.col("text").isNull() | (shape == "VOID"), "null")
        .when(F.col("value").isNull(), F.when(X.trim(F.col("text")) == "", "scalar").otherwise("csv"))
        .when(shape.startswith("ARRAY"), array_kind)
        .when(shape.startswith("OBJECT"), object_kind)
        .otherwise("scalar")
    )
    return df.withColumn("kind", kind)


def convertible(value: Column) -> Column:
    """Objects without any list value stay objects; everything else becomes a table."""
    entries = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
    has_list = F.exists(entries, lambda x: _shape(x).startswith("ARRAY"))
    return F.when(_shape(value).startswith("OBJECT"), has_list).otherwise(F.lit(True))


def infer_schema(payloads: DataFrame) -> T.DataType:
    """One schema over all payloads: the union of keys. Only this one schema text reaches the driver."""
    text = payloads.select(F.schema_of_variant_agg(F.try_parse_json("payload")).alias("s")).first().s
    names: list[str] = []  # quoted field names are put aside, so that only types are changed

    def aside(found: re.Match) -> str:
        names.append(found[0])
        return f"`{len(names) - 1}`"

    text = re.sub(r"`(?:[^`]|``)*`|\w+(?=: )", aside, text)
    text = re.sub(r"DECIMAL\((\d+),\s*(\d+)\)", lambda m: m[0] if m[2] == "0" else "DOUBLE", text)  # whole numbers stay whole
    text = re.sub(r"\bOBJECT\b", "STRUCT", re.sub(r"\bVOID\b", "STRING", text))
    return T.DataType.fromDDL(re.sub(r"`(\d+)`", lambda m: names[int(m[1])], text))


def records_to_rows(payloads: DataFrame, schema: T.DataType | str | None = None) -> DataFrame:
    """Array of objects -> one row per object; keys missing in an object are null. Without a schema, payloads of another
    shape are left out (``rejected`` names them); with no payload at all there are no columns and no rows."""
    if schema is None:
        payloads = classify(payloads).where("kind = 'records'").select("payload_id", F.col("text").alias("payload"))
        if payloads.isEmpty():
            return payloads.select("payload_id")
        schema = infer_schema(payloads)
    parsed = payloads.select("payload_id", F.from_json("payload", schema).alias("r"))
    return parsed.select("payload_id", F.inline("r"))


def header_rows(payloads: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Array of arrays, the first one naming the columns -> one row per further array, always row-wise. Of columns with
    the same name the first counts; cells beyond the names are left out, cells that lack are null."""
    cells = payloads.select("payload_id", F.from_json("payload", "array<array<string>>").alias("a"))
    rows = cells.where(F.size("a") > 1).select(
        "payload_id", F.element_at("a", 1).alias("h"), F.posexplode(F.slice("a", 2, F.size("a") - 1)).alias("row_no", "cell")
    )
    return rows.select("payload_id", "row_no", *[named_cell(F.col("h"), F.col("cell"), n).try_cast(t).alias(n) for n, t in columns.items()])


def named_cell(names: Column, cells: Column, name: str) -> Column:
    """The cell below the first column of that name, null where there is none."""
    at = F.array_position(names, name)
    return F.when(at > 0, F.get(cells, (at - 1).cast("int")))


def rejected(payloads: DataFrame) -> DataFrame:
    """payload_id and reason of payloads that give no rows: text that starts like JSON and is none, a list without a header
    below it, lists of unequal length, and lists that mix objects with other values."""
    known = classify(payloads)
    items = F.try_variant_get("value", "$", "array<variant>")
    lists = F.map_values(F.try_variant_get("value", "$", "map<string,variant>"))
    some_lists = F.forall(lists, lambda x: _shape(x).startswith("ARRAY")) & (F.size(lists) > 0)
    reason = (
        F.when(F.col("value").isNull() & F.ltrim("text").rlike(r"^[\[{]"), "malformed JSON")
        .when((F.col("kind") == "rows") & (F.size(items) < 2), "a single list")
        .when((F.col("kind") == "nested") & some_lists, "lists of unequal length")
        .when((F.col("kind") == "scalar") & F.exists(items, lambda x: _shape(x).startswith("OBJECT")), "objects and other values mixed")
    )
    return known.select("payload_id", reason.alias("reason")).where("reason IS NOT NULL")


def column_lists(payloads: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Object of equally long lists -> rows. Payloads whose lists differ in length are left to ``whole_result``."""
    ddl = ", ".join(f"{n} array<{t}>" for n, t in columns.items())
    s = payloads.select("payload_id", F.from_json("payload", ddl).alias("s"))
    sizes = F.array_distinct(F.array(*[F.size(f"s.{n}") for n in columns]))
    zipped = F.arrays_zip(*[F.col(f"s.{n}").alias(n) for n in columns])
    return s.where(F.size(sizes) == 1).select("payload_id", F.inline(zipped))


def object_row(payloads: DataFrame, schema: T.DataType | str) -> DataFrame:
    return payloads.select("payload_id", F.from_json("payload", schema).alias("s")).select("payload_id", "s.*")


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs -> dotted columns; lists are kept whole."""

    def walk(prefix: str, path: str, dtype: T.DataType) -> list[Column]:
        if isinstance(dtype, T.StructType):
            out = []
            for f in dtype.fields:
                name = f"{prefix}{sep}{f.name}" if prefix else f.name
                out += walk(name, f"{path}.`{f.name}`" if path else f"`{f.name}`", f.dataType)
            return out
        return [F.col(path).alias(prefix)]

    return df.select(*walk("", "", df.schema))


def whole_result(payloads: DataFrame) -> DataFrame:
    """Anything that is no table -> one row whose ``result`` holds the value."""
    value = F.coalesce(F.try_parse_json("payload"), F.col("payload").cast("variant"))
    return payloads.select("payload_id", value.alias("result"))


def matrix_columns(df: DataFrame, column: str, width: int) -> list[Column]:
    """The first ``width`` items as columns. A longer row is an error, since its rest would be lost."""
    whole = F.when(F.size(column) > width, F.raise_error(F.concat(F.lit(f"{column} has more than {width} items: "), F.size(column).cast("string"))).cast("array<double>")).otherwise(F.col(column).cast("array<double>"))
    return [F.get(whole, F.lit(i)).alias(f"column_{i}") for i in range(width)]


# A record may hold quoted line ends: runs of unquoted text and quoted parts, up to an unquoted line end.
CSV_RECORD = r'[^"\r\n]*+(?:"[^"]*+"[^"\r\n]*+)*+'


# A cell starts the record or follows a comma outside quotes, and ends before the next such comma.
CSV_CELL = r'(?:(?<=^)|(?<=,))(?:"(?:[^"]|"")*+"|[^,"][^,]*+|)(?=,|$)'


def csv_rows(payloads: DataFrame, columns: dict[str, str]) -> DataFrame:
    """CSV text whose first record names the columns -> rows. Columns are taken by name, in any order and whatever the width of
    the text; of columns with the same name the first counts, and columns without a name only take their place."""
    records = F.filter(F.regexp_extract_all("payload", F.lit(CSV_RECORD), F.lit(0)), lambda r: r != "")
    df = payloads.select("payload_id", records.alias("r")).where(F.size("r") > 1)
    df = df.select("payload_id", F.element_at("r", 1).alias("h"), F.posexplode(F.slice("r", 2, F.size("r") - 1)).alias("row_no", "line"))
    names, cells = csv_cells(F.col("h")), csv_cells(F.col("line"))
    df = df.select("payload_id", "row_no", names.alias("names"), cells.alias("cells"))
    return df.select("payload_id", "row_no", *[named_cell(F.col("names"), F.col("cells"), n).try_cast(t).alias(n) for n, t in columns.items()])


def csv_cells(record: Column) -> Column:
    """All cells of one record: quoted ones without their quotes, empty ones null."""
    raw = F.regexp_extract_all(record, F.lit(CSV_CELL), F.lit(0))
    unquoted = lambda c: F.replace(F.regexp_replace(c, r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda c: F.when(c.startswith('"'), unquoted(c)).when(c != "", c))


def typed_or_rejected(df: DataFrame, value: Column, properties: dict[str, dict], required: list[str]) -> DataFrame:
    """JSON-schema properties -> typed columns beside ``df``; ``missing`` lists required properties without a value.

    Required properties come first. Rows with ``missing`` not empty are the rejects. Unknown types stay VARIANT.
    """
    spark_type = {  # fixed values: JSON-schema type -> column type
        "string": "string", "integer": "bigint", "number": "double", "boolean": "boolean",
        "array": "array<variant>", "object": "map<string,variant>",
    }
    ordered = [p for p in properties if p in required] + [p for p in properties if p not in required]
    cols, lacking = [], []
    for name in ordered:
        kind = spark_type.get(properties[name].get("type", "string"), "variant")
        quote = '"' if "'" in name else "'"
        c = F.try_variant_get(value, f"$[{quote}{name}{quote}]", kind)
        if name in required:
            lacking.append(F.when(c.isNull(), F.lit(name)))
        elif properties[name].get("default") is not None:
            default = F.parse_json(F.lit(json.dumps(properties[name]["default"])))
            c = F.coalesce(c, F.try_variant_get(default, "$", kind))
        cols.append(c.alias(name))
    missing = F.array_compact(F.array(*lacking)) if lacking else F.array().cast("array<string>")
    return df.select("*", *cols, missing.alias("missing"))


def schema_catalog(tools: DataFrame) -> DataFrame:
    """(server, tool, description, schema text) -> one row per tool parameter."""
    v = tools.select("server", "tool", "description", F.try_parse_json("schema").alias("v"))
    v = v.select(
        "server", "tool", "description",
        F.coalesce(F.try_variant_get("v", "$.required", "array<string>"), F.array().cast("array<string>")).alias("req"),
        F.explode(F.try_variant_get("v", "$.properties", "map<string,variant>")).alias("param", "info"),
    )
    return v.select(
        "server", "tool", F.concat_ws("_", "server", "tool").alias("full_name"), "param",
        F.coalesce(F.try_variant_get("info", "$.type", "string"), F.lit("any")).alias("type"),
        F.array_contains("req", F.col("param")).alias("required"),
        F.coalesce(F.try_variant_get("info", "$.description", "string"), F.lit("")).alias("param_description"),
        "description",
    )


def config_entries(configs: DataFrame) -> DataFrame:
    """(config_id, config text) -> (config_id, server, key, value): the environment block of every server."""
    v = configs.select("config_id", F.try_parse_json("config").alias("v"))
    servers = F.coalesce(F.try_variant_get("v", "$.mcpServers", "map<string,variant>"), F.try_variant_get("v", "$", "map<string,variant>"))
    v = v.select("config_id", F.explode(servers).alias("server", "body"))
    v = v.select("config_id", "server", F.explode(F.try_variant_get("body", "$.env", "map<string,variant>")).alias("key", "raw"))
    return v.select("config_id", "server", "key", F.try_variant_get("raw", "$", "string").alias("value"))


def fill_placeholders(entries: DataFrame, environment: DataFrame) -> DataFrame:
    """``${NAME}`` values are looked up in environment (name, env_value); names that are missing give empty text."""
    is_ref = F.coalesce(F.col("value").rlike(r"(?s)^\$\{.*\}$"), F.lit(False))
    plain = entries.where(~is_ref)  # goes around the join, where it would all meet in one task
    refs = entries.where(is_ref).withColumn("name", F.regexp_extract("value", r"(?s)^\$\{(.*)\}$", 1))
    filled = refs.join(environment, "name", "left").withColumn("value", F.coalesce("env_value", F.lit("")))
    return plain.select("config_id", "server", "key", "value").unionByName(filled.select("config_id", "server", "key", "value"))
