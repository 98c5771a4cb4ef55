"""Functions that Spark has no built-in for, as Arrow and pandas functions on whole batches."""

from __future__ import annotations

import functools
import json
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"(?:[^\W_]|§)+")
#: Abbreviations after which a full stop ends no sentence, an end of a sentence, and how the next one may begin
#: (fixed values).
ABBREVIATIONS = frozenset(
    "bl.a. f.eks. jf. pkt. nr. stk. kr. ca. dvs. mv. m.v. inkl. ekskl. evt. "
    "osv. mht. iht. vedr. ift. pga. p.t. o.l. m.m. s. t.o.m. fr.o.m.".split()
)
SENTENCE_START = "A-ZÆØÅ0-9§\"'("
_SHORT = "|".join(x.replace(".", r"\.") for x in sorted(ABBREVIATIONS))
#: A sentence with the space after it, for Java's and Python's patterns alike (STR-5): it ends at its marks, a closing sign
#: included, where space and a possible beginning follow, but not after an abbreviation; the last ends with the text.
SENTENCE = rf"""(?s).+?(?:(?<=[.!?]["')\]]?)(?<!(?:^|\s)(?i:{_SHORT}))\s+(?=[{SENTENCE_START}])|(?!.))"""
_SENTENCE = regex.compile(SENTENCE)


def by_value(f, kind: str, text: Column | str) -> Column:
    """f of each value of a column, in batches; f gets None for null."""

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(f)

    return run(text)


def nfc(text: Column | str) -> Column:
    """Composed characters, single spaces, trimmed (UDF-1)."""
    return by_value(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).split()), "string", text)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Spans of sentences without the space after them."""
    spans = [(m.start(), m.start() + len(m[0].rstrip())) for m in _SENTENCE.finditer(text)]
    return [x for x in spans if x[1] > x[0]]


def sentences(text: Column | str) -> Column:
    """Spans of sentences, worked out in the JVM by the same pattern (UDF-6)."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    parts = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def one(state: Column, part: Column) -> Column:
        span = F.struct(state["at"].alias("start"), (state["at"] + F.length(F.regexp_replace(part, r"\s+$", ""))).cast("int").alias("end"))
        return F.struct((state["at"] + F.length(part)).cast("int").alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), one, lambda s: s["spans"])
    return F.filter(spans, lambda x: x["end"] > x["start"])


def fnv1a(token: str) -> int:
    """32-bit FNV-1a over UTF-16 code units (MTH-4)."""
    h = 2166136261
    for unit in memoryview(token.encode("utf-16-le")).cast("H"):
        h = (h ^ unit) * 16777619 & 0xFFFFFFFF
    return h


def _folded(state: np.ndarray, units: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """FNV-1a carried on from each state over a run of units, all runs at once."""
    state = state.copy()
    for j in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > j)
        state[at] = (state[at] ^ units[begin[at] + j]) * 16777619 & 0xFFFFFFFF
    return state


def embeddings(texts: list[str], dims: int) -> np.ndarray:
    """Signed hashes of each text's tokens and neighbouring pairs of them, at length 1, to six decimals; the first
    axis for a text without tokens (DOC-4). All tokens of all texts are hashed at once."""
    parts = [TOKEN.findall(unicodedata.normalize("NFC", x).lower()) for x in texts]
    words = [w.encode("utf-16-le") for p in parts for w in p]
    row = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    out = np.zeros(len(texts) * dims)
    if words:
        units = np.frombuffer(b"".join(words), dtype="<u2").astype(np.uint64)
        sizes = np.array([len(w) // 2 for w in words])
        begin = np.cumsum(sizes) - sizes
        one = _folded(np.full(len(words), 2166136261, dtype=np.uint64), units, begin, sizes)
        next_one = np.flatnonzero(row[1:] == row[:-1]) + 1
        spaced = (one[next_one - 1] ^ 32) * 16777619 & 0xFFFFFFFF
        h = np.concatenate([one, _folded(spaced, units, begin[next_one], sizes[next_one])])
        at = np.concatenate([row, row[next_one]]) * dims + (h % dims).astype(np.int64)
        out = np.bincount(at, np.where(h >> 31, -1.0, 1.0), len(out))
    out = out.reshape(len(texts), dims)
    size = np.sqrt((out * out).sum(axis=1))
    out[size == 0, 0] = size[size == 0] = 1.0
    return np.floor(out / size[:, None] * 1e6 + 0.5) / 1e6


def embed(text: str, dims: int) -> np.ndarray:
    return embeddings([text], dims)[0]


def hash_embedding(text: Column | str, dims: int = 256) -> Column:
    """UDF-4."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        made = [embeddings(x[i : i + 500].fillna("").tolist(), dims) for i in range(0, len(x), 500)]
        return pd.Series([row for part in made for row in part], index=x.index)

    return run(text)


#: Days of a year as DDMM, and what is masked, by kind (fixed values). \d and \s are ASCII's. What stands before a number is
#: looked at, but not masked.
DAY = "(?:(?:0[1-9]|[12][0-9])(?:0[1-9]|1[0-2])|30(?:0[13-9]|1[0-2])|31(?:0[13578]|1[02]))"
PERSONAL = {
    "email": r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}.-]+\.[\p{L}]{2,}",
    "konto": r"\bDK\d{2}(?: ?\d{4}){3} ?\d{2}\b|(?<![\d-])\d{4}[ -]\d{6,10}(?![\d-])",
    "cpr": rf"(?<![\d-]){DAY}\d{{2}}-?\d{{4}}(?![\d-])",
    "cvr": r"(?<=\b(?i:cvr(?:[- ]?(?:nr|nummer))?)\.?\s*:?\s*)\d{2} ?\d{2} ?\d{2} ?\d{2}(?!\d)",
    "telefon": r"\+45[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}(?!\d)|(?<![\d,.-])\d{2} \d{2} \d{2} \d{2}(?![\d,.])"
    r"|(?<=\b(?i:tlf|telefonnummer|telefon|mobil)\.?(?:nr\.?)?\s*:?\s*)\d{8}(?!\d)",
}
#: What every text with something to mask has, names aside.
LIKELY = re.compile(r"@|DK\d\d|\d\d[ -]?\d\d")


@functools.lru_cache(maxsize=64)
def personal(names: tuple[str, ...] = ()) -> regex.Pattern:
    """All kinds as one pattern that takes the leftmost, then the longest match; names of persons are a kind too."""
    kinds = "|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PERSONAL.items())
    known = "|".join(regex.escape(x) for x in sorted({x.strip() for x in names}) if len(x) > 1)
    person = rf"|(?P<person>(?<![\p{{L}}\p{{N}}])(?i:{known})(?![\p{{L}}\p{{N}}]))" if known else ""
    return regex.compile(f"(?p)(?:{kinds}){person}", regex.ASCII)


def mask(text: str, names: tuple[str, ...] = ()) -> tuple[str, dict[str, int], dict[str, str]]:
    """The text with personal data as placeholders, the same for the same value; counts by kind; and what the
    placeholders stand for. Of overlapping matches the earliest counts, then the longest (STR-11)."""
    if not LIKELY.search(text) and not any(x.strip() for x in names):
        return text, {}, {}
    count: dict[str, int] = {}
    held: dict[str, dict[str, str]] = {}
    made: dict[str, str] = {}

    def placeholder(m: regex.Match) -> str:
        kind, value = m.lastgroup, m[0]
        count[kind] = count.get(kind, 0) + 1
        known = held.setdefault(kind, {})
        key = known.setdefault(value.lower(), f"[{kind.upper()}-{len(known) + 1}]")
        made.setdefault(key, value)
        return key

    return personal(names).sub(placeholder, text), count, made


def redacted(text: Column | str, names: tuple[str, ...] = ()) -> Column:
    """struct<text, counts> (UDF-8)."""

    @F.pandas_udf("struct<text:string,counts:map<string,bigint>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in texts:
            made = [mask(t or "", names) for t in x]
            yield pd.DataFrame({"text": [m[0] for m in made], "counts": [m[1] for m in made]})

    return run(text)


def number(x: float | int) -> str:
    """A number as JavaScript prints it (MTH-7)."""
    if isinstance(x, int) and abs(x) < 10**21:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    mantissa, _, e = repr(x).partition("e")
    sign = "-" if x < 0 else ""
    whole, _, part = mantissa.lstrip("-").partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(e or 0)
    all_digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    all_digits = all_digits.rstrip("0")
    n = len(all_digits)
    if n <= point <= 21:
        return sign + all_digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + all_digits[:point] + "." + all_digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + all_digits
    power = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + all_digits[0] + ("." + all_digits[1:] if n > 1 else "") + power


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and JavaScript's numbers (JSN-6)."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode())
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return number(value)


def canonical_json(text: Column | str) -> Column:
    """UDF-5; null for text that is no JSON."""

    def one(x: str | None) -> str | None:
        try:
            return canonical(json.loads(x))
        except (TypeError, ValueError):
            return None

    return by_value(one, "string", text)
