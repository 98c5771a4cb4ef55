"""Column expressions for text, vectors, intervals and proportions; all stay in the JVM."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054  # fixed value: the normal distribution's 97.5 % point


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Text.
def tokens(text: Column | str) -> Column:
    """Runs of letters, digits and section signs of the text in lower case (STR-4)."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}§]+)"), F.lit(1))


def squeezed(text: Column | str) -> Column:
    """White space as single spaces, trimmed (STR-1 without composition)."""
    return F.trim(F.regexp_replace(col(text), r"[ \t\n\x0B\f\r]+", " "))


def line_key(line: Column | str) -> Column:
    """A line with its digits masked, for finding repeated headers and footers (STR-2)."""
    return F.regexp_replace(F.lower(F.trim(col(line))), r"[0-9]+", "#")


def token_estimate(text: Column | str) -> Column:
    """STR-9."""
    return F.greatest(F.lit(1), F.ceil(F.length(col(text)) / 4)).cast("bigint")


def initials(name: Column | str) -> Column:
    """STR-14."""
    parts = F.slice(F.split(F.trim(col(name)), r" +"), 1, 2)
    return F.upper(F.concat_ws("", F.transform(parts, lambda p: F.substring(p, 1, 1))))


def safe_name(name: Column | str) -> Column:
    """A file name with only letters, digits, dots, dashes and underscores (STR-15)."""
    return F.regexp_replace(F.regexp_replace(F.trim(col(name)), r"[^\p{L}\p{N}._-]+", "_"), r"^[._]+", "")


# Vectors.
def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 for a vector of length 0 (MTH-1)."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def unit(a: Column | str) -> Column:
    """The vector at length 1; the first axis for one of length 0 (MTH-5)."""
    first = F.transform(col(a), lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))
    return F.when(norm(a) == 0, first).otherwise(F.transform(col(a), lambda x: x.cast("double") / norm(a)))


# Numbers.
def six(x: Column | str) -> Column:
    """Six decimals, halves up (MTH-3)."""
    return F.floor(col(x) * 1e6 + 0.5) / 1e6


def wilson(k: Column | str, n: Column | str) -> tuple[Column, Column]:
    """The 95 % interval of a proportion, exact at none and all; null without cases (AGG-11)."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p, z2 = k / n, Z95 * Z95
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low = F.when(n == 0, None).when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half))
    high = F.when(n == 0, None).when(k == n, 1.0).otherwise(F.least(F.lit(1.0), middle + half))
    return low, high


def rrf(*ranks: Column | str, k: int = 60) -> Column:
    """Reciprocal rank fusion of ranks that may be null (MTH-2)."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(1.0 / (k + col(r)), F.lit(0.0))
    return out


def gain(grades: Column | str) -> Column:
    """Discounted cumulative gain of grades in rank order (AGG-9)."""
    terms = F.transform(col(grades), lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + F.lit(2.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


# Dates and half-open intervals; a null end is open.
def holds(start: Column | str, end: Column | str, day: Column | datetime.date) -> Column:
    """DAT-3."""
    day = F.lit(day) if isinstance(day, datetime.date) else day
    return F.coalesce((col(start) <= day) & (col(end).isNull() | (day < col(end))), F.lit(False))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """DAT-4; an empty interval overlaps nothing."""
    far = F.lit(datetime.date(9999, 12, 31))
    a1, b1 = F.coalesce(a1, far), F.coalesce(b1, far)
    return (a0 < b1) & (b0 < a1) & (a0 < a1) & (b0 < b1)


def temporal_status(start: Column | str, end: Column | str, today: datetime.date) -> Column:
    """DAT-5."""
    return F.when(col(start) > F.lit(today), "future").when(col(end) <= F.lit(today), "historical").otherwise("current")


def copenhagen_day(ts: Column | str) -> Column:
    """DAT-1."""
    return F.to_date(F.from_utc_timestamp(col(ts), "Europe/Copenhagen"))


def strict_date(text: Column | str) -> Column:
    """A date written YYYY-MM-DD that exists, else null (DAT-2)."""
    return F.when(col(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col(text), "yyyy-MM-dd"))


def backoff_seconds(attempts: Column | str, base: int = 30) -> Column:
    """DAT-6."""
    return (F.pow(F.lit(2), F.greatest(col(attempts) - 1, F.lit(0))) * base).cast("bigint")


# Names, headings and JSON.
#: What letters look like that were decoded wrongly, and how headings and lists are numbered.
MOJIBAKE = "Ã[¦¸¥†˜…]|�"
SECTION = r"^§\s*(\d+(?:\.\d+)*)"
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+\p{L}"
LIST_MARK = r"^\s*(?:[-•–*]|\d+[.)]|[a-zæøå][.)])\s+"


def garbled(text: Column | str) -> Column:
    """Whether a text holds wrongly decoded letters (STR-3)."""
    return F.coalesce(col(text).rlike(MOJIBAKE), F.lit(False))


def section_number(line: Column | str) -> Column:
    """A line's section or heading number, or null (STR-7)."""
    found = F.coalesce(F.nullif(F.regexp_extract(col(line), SECTION, 1), F.lit("")), F.nullif(F.regexp_extract(col(line), NUMBERED, 1), F.lit("")))
    return found


def listed(line: Column | str) -> Column:
    """Whether a line is an item of a list (STR-7)."""
    return F.coalesce(col(line).rlike(LIST_MARK), F.lit(False))


def heading_chain(headings: Column | str, text: Column | str) -> Column:
    """Headings joined by a guillemet, empty ones left out, and the text on the next line (STR-8)."""
    chain = F.array_join(F.filter(col(headings), lambda h: F.coalesce(F.trim(h) != "", F.lit(False))), " › ")
    return F.concat_ws("\n", F.nullif(chain, F.lit("")), col(text))


def unbroken(lines: Column | str) -> Column:
    """Lines as one text: a line that ends in a letter and a hyphen goes on without both where the next begins
    with a small letter; all others are joined by a space (STR-6)."""
    return F.regexp_replace(F.regexp_replace(F.array_join(col(lines), "\n"), r"(\p{L})-\n(?=\p{Ll})", "$1"), "\n", " ")


def stable_uuid(name: Column | str) -> Column:
    """A UUID of version 4's form made of a name's hash (MTH-9)."""
    h = F.sha2(col(name), 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def restored(text: Column | str, values: Column | str) -> Column:
    """A text with its placeholders as what the map says they stand for (STR-12); unknown ones stay."""
    pieces = F.regexp_extract_all(col(text), F.lit(r"(?s)(\[[A-Z]+-[0-9]+\]|\[|[^\[]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(col(values), p), p)), "")


def lexemes(text: Column | str) -> Column:
    """array<struct<token, positions>> of a text's tokens, by token (UDF-3)."""
    found = F.transform(tokens(text), lambda t, i: F.struct(t.alias("token"), (i + 1).alias("at")))
    names = F.array_sort(F.array_distinct(tokens(text)))
    return F.transform(names, lambda n: F.struct(n.alias("token"), F.transform(F.filter(found, lambda f: f["token"] == n), lambda f: f["at"]).alias("positions")))


def merged_json(left: Column | str, right: Column | str, without: tuple[str, ...] = ()) -> Column:
    """Entries of both objects as a map of texts, the right one's where both have a key, less some keys (JSN-3)."""
    a, b = (F.coalesce(F.from_json(col(x), "map<string,string>"), F.create_map().cast("map<string,string>")) for x in (left, right))
    a = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k) & ~k.isin(list(without)))
    return F.map_concat(a, F.map_filter(b, lambda k, _: ~k.isin(list(without))))


def holds_object(objects: Column | str, **fields: object) -> Column:
    """Whether an array of structs has one with all these fields (JSN-4)."""

    def fits(x: Column) -> Column:
        made = F.lit(True)
        for k, v in fields.items():
            made = made & x[k].eqNullSafe(F.lit(v))
        return made

    return F.coalesce(F.exists(col(objects), fits), F.lit(False))


def json_kind(text: Column | str, path: str) -> Column:
    """The kind of what lies at a path: number, string, boolean, object, array or null (JSN-5); null if nothing does."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(col(text)), path, "variant"))
    return (
        F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "VOID", "null")
    )


def paired(left: Column | str, right: Column | str) -> Column:
    """Two arrays joined by position, as long as the shorter (JOIN-15)."""
    n = F.least(F.size(col(left)), F.size(col(right)))
    return F.transform(F.slice(col(left), 1, n), lambda x, i: F.struct(x.alias("left"), F.get(col(right), i).alias("right")))
