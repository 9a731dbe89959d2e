"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Numbers and dates that are valid in their format are permuted within it by a keyed Feistel network: the result is of the same
format and as valid, different values stay different, and equal values get equal pseudonyms in all documents. Addresses and
secrets, which have no numeric format, become keyed hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Days of 400 years, after which the calendar repeats, as the product of the two halves that are permuted.
DAYS = (189, 773)
FIRST_DAY = "1800-01-01"

#: What is looked for. A number never continues a longer run of letters or digits.
BEFORE, AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": BEFORE + r"(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,64}" + AFTER,
    "iban": BEFORE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?" + AFTER,
    "ip": r"(?<![\p{L}\p{N}]|[0-9]\.)(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "date": BEFORE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})" + AFTER,
    "card": BEFORE + r"(?:[0-9]{4}[ -]){3}[0-9]{1,7}" + AFTER + "|" + BEFORE + r"[0-9]{13,19}" + AFTER,
    "ssn": BEFORE + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + AFTER,
    "phone": r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}" + AFTER + "|"
             + r"(?<![\p{L}\p{N}+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + AFTER,
}
ANY = "|".join(PATTERNS.values())
DATES = {r"^[0-9]{4}-": "yyyy-MM-dd", r"\.": "dd.MM.yyyy", "/": "MM/dd/yyyy"}


def keyed(key: str, *parts: Column | str, digits: int = 15) -> Column:
    """The first hexadecimal digits of a keyed hash of the parts."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit(key)), 256), 1, digits)


def number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def feistel(left: Column, right: Column, most_left: Column, most_right: Column, key: str, kind: str) -> Column:
    """Permutes pairs (left, right) below (most_left, most_right): each round adds a keyed hash of one half to the other,
    modulo that half's size, which can be undone; so no value is met twice and none leaves the format."""
    sizes = (most_left.cast("string"), most_right.cast("string"))

    def turn(state: Column, k: Column) -> Column:
        l, r = state["l"], state["r"]
        with_r = number(keyed(key, kind, *sizes, k.cast("string"), r.cast("string")))
        with_l = number(keyed(key, kind, *sizes, k.cast("string"), l.cast("string")))
        return F.when(k % 2 == 0, F.struct(((l + with_r % most_left) % most_left).alias("l"), r.alias("r"))).otherwise(
            F.struct(l.alias("l"), ((r + with_l % most_right) % most_right).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), start, turn)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once only."""
    return F.element_at(F.transform(F.array(value), then), 1)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Another string of as many digits (at least 2)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
    halves = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n), size(half), size(n - half), key, kind)
    return bound(halves, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, F.lit("0")), F.lpad(s["r"].cast("string"), n - half, F.lit("0"))))


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by those of ``digits``."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(s["rest"], 1, 1)).alias("out"), F.substr(s["rest"], F.lit(2)).alias("rest"))).otherwise(
        F.struct(F.concat(s["out"], c).alias("out"), s["rest"].alias("rest")))
    start = F.struct(F.lit("").alias("out"), digits.alias("rest"))
    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def luhn(body: Column) -> Column:
    """The check digit that makes ``body`` and it valid."""
    each = F.transform(F.reverse(F.split(body, "")), lambda c, i: bound(
        c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0)))
    total = F.aggregate(each, F.lit(0), lambda a, b: a + b)
    return ((10 - total % 10) % 10).cast("string")


def card(value: Column, key: str) -> Column:
    """Valid card numbers keep a valid check digit; other long numbers are permuted as a whole."""
    def of(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        valid = luhn(body) == F.right(digits, F.lit(1))
        checked = bound(permuted_digits(body, key, "card"), lambda b: F.concat(b, luhn(b)))
        return F.when(valid, checked).otherwise(permuted_digits(digits, key, "number"))

    return refill(value, bound(only_digits(value), of))


def remainder97(text: Column) -> Column:
    """Remainder by 97 of a number whose letters stand for 10 to 35."""
    def step(rest: Column, c: Column) -> Column:
        two = F.conv(c, 36, 10).cast("int")
        return F.when(two > 9, rest * 100 + two).otherwise(rest * 10 + two) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def iban(value: Column, key: str) -> Column:
    """Valid account numbers keep country, letters and valid check digits; what is no account number stays."""
    def of(plain: Column) -> Column:
        country, rest = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
        valid = remainder97(F.concat(rest, F.substring(plain, 1, 4))) == 1
        digits = only_digits(rest)

        def new(body: Column) -> Column:
            check = F.lpad((98 - remainder97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
            return refill(value, F.concat(check, only_digits(body)))

        done = bound(refill(rest, bound(F.lpad(digits, F.greatest(F.length(digits), F.lit(2)), F.lit("0")), lambda d: long_digits(d, key))), new)
        return F.when(valid & (F.length(digits) > 1), done).otherwise(value)

    return bound(F.regexp_replace(value, " ", ""), of)


def long_digits(digits: Column, key: str) -> Column:
    """Digit strings too long for one permutation: the last 18 are permuted, then the first 18."""
    def tail(d: Column) -> Column:
        n = F.length(d)
        cut = F.greatest(n - 18, F.lit(0))
        return F.concat(F.substring(d, F.lit(1), cut), permuted_digits(F.substr(d, cut + 1), key, "account"))

    head = lambda d: F.concat(permuted_digits(F.substring(d, 1, 18), key, "accounts"), F.substr(d, F.lit(19)))
    return bound(bound(digits, tail), lambda d: F.when(F.length(d) > 18, head(d)).otherwise(d))


def ip(value: Column, key: str) -> Column:
    octets = lambda o, k: F.get(o, F.lit(k)).cast("long")
    half = F.lit(1 << 16).cast("long")
    halves = bound(F.split(value, r"\."), lambda o: feistel(octets(o, 0) * 256 + octets(o, 1), octets(o, 2) * 256 + octets(o, 3), half, half, key, "ip"))
    return bound(halves, lambda s: F.concat_ws(".", *[x.cast("string") for h in (s["l"], s["r"]) for x in (F.shiftright(h, 8), h % 256)]))


def date(value: Column, key: str) -> Column:
    """Existing days of the years 1800 to 2199 become another such day; what is no day stays."""
    def moved(form: str) -> Callable[[Column], Column]:
        def of(day: Column) -> Column:
            at = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
            new = feistel(F.floor(at / DAYS[1]), at % DAYS[1], F.lit(DAYS[0]).cast("long"), F.lit(DAYS[1]).cast("long"), key, "date")
            text = bound(new, lambda s: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAYS[1] + s["r"]).cast("int")), form))
            return F.when((at >= 0) & (at < DAYS[0] * DAYS[1]), text)

        return of

    out = value
    for mark, form in DATES.items():
        new = bound(F.try_to_timestamp(value, F.lit(form)).cast("date"), moved(form))
        out = F.when(value.rlike(mark), F.coalesce(new, value)).otherwise(out)
    return out


def ssn(value: Column, key: str) -> Column:
    """Valid numbers only: the areas without 666, and the groups and serials without 0, are permuted as one range."""
    serials = 99 * 9999
    part = lambda d, at, n: F.substring(d, at, n).cast("long")

    def of(digits: Column) -> Column:
        area = part(digits, 1, 3)
        left = area - 1 - F.when(area > 666, 1).otherwise(0)
        right = (part(digits, 4, 2) - 1) * 9999 + part(digits, 6, 4) - 1
        new = feistel(left, right, F.lit(898).cast("long"), F.lit(serials).cast("long"), key, "ssn")
        return bound(new, lambda s: F.format_string(
            "%03d-%02d-%04d", s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0), F.floor(s["r"] / 9999) + 1, s["r"] % 9999 + 1))

    return bound(only_digits(value), of)


def phone(value: Column, key: str) -> Column:
    """All digits but the country code are permuted."""
    code = F.regexp_extract(value, r"^(\+1(?=[^0-9])|\+[0-9]{1,3}(?=[ .(-])|\+)?", 1)
    rest = F.substr(value, F.length(code) + 1)
    return F.concat(code, refill(rest, permuted_digits(only_digits(rest), key, "phone")))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match of ``ANY``."""
    whole = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(F.contains(value, F.lit("@")), F.concat(F.lit("u"), keyed(key, "email", F.lower(value), digits=12), F.lit("@mail.example")))
        .when(whole("secret"), F.substring(F.concat(keyed(key, "secret", F.lower(value), digits=64)), F.lit(1), F.length(value)))
        .when(whole("iban"), iban(value, key))
        .when(whole("ip"), ip(value, key))
        .when(whole("date"), date(value, key))
        .when(whole("card"), card(value, key))
        .when(whole("ssn"), ssn(value, key))
        .otherwise(phone(value, key))
    )


def protect(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``; other columns are untouched.

    Null and empty texts stay as they are, and so does every text without a match. Repeated rows are treated alike. A text
    is cut at its matches and joined again around their pseudonyms, whatever its length."""
    found = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    gaps = F.split(F.col(text), ANY, -1)
    new = F.transform(found, lambda v: pseudonym(v, key))
    joined = F.array_join(F.zip_with(gaps, new, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    return docs.withColumn(text, F.when(F.col(text).rlike("[0-9@]"), joined).otherwise(F.col(text)))
