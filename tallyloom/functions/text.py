"""Text functions as column expressions. All of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File suffix -> language.
LANGUAGE_BY_SUFFIX = {
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".py": "python", ".js": "javascript",
    ".ts": "typescript", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".cs": "csharp",
    ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php",
}
# Languages whose classes and methods are extracted.
SYMBOL_LANGUAGES = ["java", "kotlin", "python", "typescript", "javascript", "cpp", "rust"]
# Marker and limits of printed output.
TRUNCATED_MARKER = "\n... (output truncated)"
OUTPUT_LIMIT = 50_000
TRACEBACK_LIMIT = 8_192
DESCRIPTION_LIMIT = 500
WHITESPACE = " \t\n\r\x0b\x0c"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-case text from the last dot of the file name; empty when the only dot leads the name."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+?(\.[^.]+)$", 1))


def lookup(key: Column, table: dict[str, str], default: str | None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def language_of(path: Column) -> Column:
    return lookup(suffix(path), LANGUAGE_BY_SUFFIX, "unknown")


def parser_language(language: Column) -> Column:
    """The language itself when symbols can be extracted from it, else null."""
    return F.when(F.lower(language).isin(SYMBOL_LANGUAGES), F.lower(language))


def truncate_marked(text: Column, limit: int = OUTPUT_LIMIT) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(TRUNCATED_MARKER))).otherwise(text)


def preview(text: Column, limit: int = DESCRIPTION_LIMIT) -> Column:
    cut = F.concat(F.substring(text, 1, limit), F.lit("..."))
    return F.coalesce(F.when(F.length(text) > limit, cut).otherwise(text), F.lit(""))


def head_chars(text: Column, limit: int = TRACEBACK_LIMIT) -> Column:
    return F.substring(text, 1, limit)


def right_trim(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def output_or_null(text: Column) -> Column:
    return F.nullif(right_trim(text), F.lit(""))


def lines(text: Column) -> Column:
    """Array of lines without their ends; a final line end opens no further line, and empty text has no line."""
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    parts = F.split(F.when(text.contains("\r"), plain).otherwise(text), "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def last_line(text: Column) -> Column:
    return F.substring_index(trim(text), "\n", -1)


def exception_type(text: Column) -> Column:
    return F.when(trim(text) != "", trim(F.substring_index(last_line(text), ":", 1)))


def exception_message(text: Column) -> Column:
    line = last_line(text)
    colon = F.instr(line, ":")
    after = trim(F.substring(line, colon + 1, F.length(line)))
    return F.when(trim(text) != "", F.when(colon > 0, after).otherwise(""))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def requirement_names(spec: Column) -> Column:
    """Requirement list -> names: version marks are cut off; a git address gives its repository name or nothing."""
    words = F.filter(F.split(spec, r"\s+"), lambda w: w != "")

    def cut(word: Column) -> Column:
        for mark in ("==", ">=", "<=", ">", "<", "@"):
            word = F.substring_index(word, mark, 1)
        return word

    def named(word: Column) -> Column:
        return F.when(~word.startswith("git+"), word).when(word.contains(".git"), repository_name(word))

    return F.filter(F.transform(F.transform(words, cut), named), lambda w: w.isNotNull())


def repository_name(address: Column) -> Column:
    return F.replace(F.substring_index(address, "/", -1), F.lit(".git"), F.lit(""))


PACKAGE_NAME = r"^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?$"  # fixed pattern of a valid name


def package_name_valid(name: Column) -> Column:
    return F.coalesce(name.rlike(PACKAGE_NAME), F.lit(False))


def normal_package_name(name: Column) -> Column:
    return F.when(package_name_valid(name), F.regexp_replace(F.lower(name), r"[-_.]+", "-"))


def name_from_url(url: Column) -> Column:
    return F.when(url.contains("/"), F.try_element_at(F.split(url, "/"), F.lit(-2))).otherwise("unknown")


def http_outcome(status: Column) -> Column:
    return (
        F.when(status == 200, "ok")
        .when(status == 404, "not found")
        .when(status == 429, "rate limit")
        .when(status >= 500, "server error")
        .otherwise("unexpected")
    )


def retry_seconds(status: Column, header: Column) -> Column:
    return F.when(status == 429, header.try_cast("bigint"))


# Text found in a syntax message -> advice, first match wins.
SYNTAX_ADVICE = [
    (("unexpected eof", "eol while scanning"), "Check for unclosed quotes, parentheses, or brackets"),
    (("invalid syntax",), "Check for typos in keywords or operators"),
    (("indentation",), "Check indentation consistency (spaces vs tabs)"),
    (("unmatched",), "Check for unmatched parentheses or brackets"),
]


def syntax_advice(message: Column) -> Column:
    low = F.lower(message)
    chain = F
    for needles, advice in SYNTAX_ADVICE:
        hit = low.contains(needles[0])
        for needle in needles[1:]:
            hit = hit | low.contains(needle)
        chain = chain.when(hit, advice)
    return chain


def tool_name(server: Column, tool: Column) -> Column:
    return F.concat_ws("_", F.lit("external"), server, tool)


def default_text(text: Column, fallback: Column | str) -> Column:
    """The fallback where text is missing or empty."""
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(F.nullif(text, F.lit("")), other)


def default_array(values: Column, fallback: Column) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(fallback)


def asks_for_help(command: Column) -> Column:
    low = F.lower(command)
    return low.contains("--help") | low.contains("-h") | low.contains("help")


def spans_lines(command: Column) -> Column:
    return command.contains("\n") | command.contains("<<") | command.contains("$(")


def glob_match(name: Column, pattern: str, include_private: bool = False) -> Column:
    """Case-insensitive file-name pattern; names that start with ``_`` only on request."""
    import fnmatch

    regex = fnmatch.translate(pattern.lower()).replace("(?>", "(?:").replace("\\z", "\\Z")
    hit = F.lower(name).rlike("^" + regex)
    return hit if include_private else hit & ~name.startswith("_")


# Names that never count as a user's own.
RESERVED_NAMES = ["In", "Out", "exit", "quit", "get_ipython", "_ih", "_oh", "_dh", "_sh", "_ip"]


def user_name_visible(name: Column) -> Column:
    private = name.startswith("_") & ~name.isin("_", "__", "___") & ~name.startswith("_i")
    return ~name.isin(RESERVED_NAMES) & ~private


def decode_utf8_ignore(data: Column) -> Column:
    """Bytes -> text, dropping invalid sequences and keeping genuine U+FFFD characters.

    Valid bytes are only relabelled. Otherwise each byte becomes one Latin-1 character, U+FFFD and the escape character
    U+E000 are rewritten as escape pairs, invalid sequences turn into U+FFFD and are removed, and the pairs are undone.
    """
    raw = data.cast("string")
    esc = ""
    as_chars = F.decode(data, "ISO-8859-1")

    def chars(ch: str) -> str:
        return ch.encode("utf-8").decode("latin-1")

    marked = F.replace(as_chars, F.lit(chars(esc)), F.lit(chars(esc) + "0"))
    marked = F.replace(marked, F.lit(chars("�")), F.lit(chars(esc) + "1"))
    clean = F.make_valid_utf8(F.encode(marked, "ISO-8859-1").cast("string"))
    clean = F.replace(clean, F.lit("�"), F.lit(""))
    clean = F.replace(clean, F.lit(esc + "1"), F.lit("�"))
    clean = F.replace(clean, F.lit(esc + "0"), F.lit(esc))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(clean)
