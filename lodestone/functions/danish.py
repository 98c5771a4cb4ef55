"""Danish stems and stop words, as column expressions.

The stemmer follows the published description of the Danish algorithm of the Snowball project: endings are looked
for in R1, the part after the first consonant that follows a vowel, and not before the fourth letter. Here a bar
marks where R1 begins, and each step is one pattern on the marked word."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.columns import col

#: Vowels, letters that may stand before a genitive s, and endings, as published.
VOWELS = "aeiouyæåø"
CONSONANTS = "bcdfghjklmnpqrstvwxz"
BEFORE_S = "abcdfghjklmnoprtvyzå"
ENDINGS = (
    "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens "
    "ers ets erets et eret"
).split()
DERIVED = "ig lig elig els".split()
#: Words that are not indexed as stems.
STOP_WORDS = (
    "og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over da fra du ud "
    "sin dem os op man hans hvor eller hvad skal selv her alle vil blev kunne ind når være dog noget ville jo deres efter ned skulle denne "
    "end dette mit også under have dig anden hende mine alt meget sit sine vor mod disse hvis din nogle hos blive mange ad bliver hendes "
    "været thi jer sådan"
).split()


def _pair(word: Column) -> Column:
    """gd, dt, gt and kt lose their last letter."""
    return F.regexp_replace(word, r"(\|.*(?:g(?=[dt]$)|[dk](?=t$))).$", "$1")


def danish_stem(token: Column | str) -> Column:
    """The stem of a token in lower case (UDF-2)."""
    token = col(token)
    head = F.length(F.regexp_extract(token, f"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]", 0))
    size = F.length(token)
    begin = F.when((size < 3) | (head == 0), size).otherwise(F.greatest(head, F.lit(3)))
    marked = F.concat(F.left(token, begin), F.lit("|"), F.substring(token, begin + 1, size))
    first = F.regexp_replace(marked, rf"^([^|]*\|.*?)(?:{'|'.join(ENDINGS)}|(?<=[{BEFORE_S}]\|?)s)$", "$1")
    second = F.regexp_replace(_pair(first), r"(i\|?g)(\|?)s(\|?)t$", "$1$2$3")
    less = F.regexp_replace(second, rf"^([^|]*\|.*?)(?:{'|'.join(DERIVED)})$", "$1")
    third = F.when(less != second, _pair(less)).otherwise(F.regexp_replace(second, r"(\|.*løs)t$", "$1"))
    single = F.regexp_replace(third, rf"(\|.*([{CONSONANTS}]))\2$", "$1")
    fourth = F.when(single != third, single).otherwise(F.regexp_replace(third, rf"([{CONSONANTS}])\|\1$", "$1|"))
    return F.replace(fourth, F.lit("|"), F.lit(""))


_HEAD = re.compile(f"[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]")
_ENDINGS, _DERIVED = (tuple(sorted(x, key=len, reverse=True)) for x in (ENDINGS, DERIVED))


def _short(word: str, begin: int) -> str:
    return word[:-1] if len(word) - begin >= 2 and word.endswith(("gd", "dt", "gt", "kt")) else word


@lru_cache(1 << 17)
def stem_of(word: str) -> str:
    """What danish_stem gives, for words that Python has at hand."""
    head = _HEAD.match(word)
    p = len(word) if len(word) < 3 or head is None else max(head.end(), 3)
    ending = next((e for e in _ENDINGS if len(e) <= len(word) - p and word.endswith(e)), None)
    if ending:
        word = word[: -len(ending)]
    elif len(word) > p and len(word) > 1 and word[-1] == "s" and word[-2] in BEFORE_S:
        word = word[:-1]
    word = _short(word, p)
    if len(word) > p and word.endswith("igst"):
        word = word[:-2]
        p = min(p, len(word))
    derived = next((e for e in _DERIVED if len(e) <= len(word) - p and word.endswith(e)), None)
    if derived:
        word = _short(word[: -len(derived)], p)
    elif len(word) - p >= 4 and word.endswith("løst"):
        word = word[:-1]
    if len(word) > p and len(word) > 1 and word[-1] in CONSONANTS and word[-1] == word[-2]:
        word = word[:-1]
    return word
