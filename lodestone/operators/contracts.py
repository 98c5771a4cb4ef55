"""Output contracts of answers: which rule an answer breaks first, in the order in which it is read (EVL-5).

An answer is JSON; the evidence that was sent with its question is three lists of ids. All of it is one expression in
the JVM on the parsed answer, whatever its shape: nothing has to fit a schema.

Fixed values: the contracts' ids and the codes of breaches; texts of at most 4,000 letters, lists of at most 20 entries,
paragraphs of 60 segments, 5 examples and 10 citations of a criterion. Defined cases: what is no JSON, and null, is
malformed; an unknown contract is too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.columns import col

CONTRACTS = ["copilot.answer.v1", "learn.explain.v1", "practice.roleplay_turn.v1", "practice.feedback.v1", "advise.suggest.v1", "assessment.evaluate.v1"]
KINDS, VERDICTS = ["answer", "conflict", "insufficient"], ["met", "partial", "not_met"]
LONGEST, ENTRIES, SEGMENTS, EXAMPLES, CITES = 4000, 20, 60, 5, 10


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _let(v: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(v), with v worked out once, however often the rule names it."""
    return F.get(F.transform(F.array(v), rule), F.lit(0))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _string(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _text(v: Column) -> Column:
    return F.when(~_is(v, "STRING"), "malformed").when(F.length(_string(v)) > LONGEST, "too_long")


def _items(v: Column) -> Column:
    return F.coalesce(F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def _list(v: Column, most: int) -> Column:
    return F.when(~_is(v, "ARRAY"), "malformed").when(F.size(_items(v)) > most, "too_long")


def _first(codes: Column) -> Column:
    return F.get(F.filter(codes, lambda x: x.isNotNull()), F.lit(0))


def _cited(v: Column, ids: Column) -> Column:
    return F.coalesce(_text(v), F.when(~F.array_contains(ids, _string(v)), "unknown_citation"))


def _segment(v: Column, ids: Column) -> Column:
    def said(cite: Column) -> Column:
        return F.when(cite.isNotNull(), _cited(cite, ids)).otherwise(_let(_at(v, "$.text"), _text))

    return F.when(~_is(v, "OBJECT"), "malformed").otherwise(_let(_at(v, "$.cite"), said))


def _each(v: Column, most: int, rule: Callable[[Column], Column]) -> Column:
    return _let(v, lambda x: F.coalesce(_list(x, most), _first(F.transform(_items(x), rule))))


def _paragraph(v: Column, ids: Column) -> Column:
    return _each(v, SEGMENTS, lambda s: _segment(s, ids))


def _cites(v: Column) -> Column:
    return F.filter(F.transform(_items(v), lambda s: _let(_at(s, "$.cite"), _string)), lambda x: x.isNotNull())


def _paragraphs(v: Column, ids: Column) -> Column:
    return _each(v, ENTRIES, lambda p: _paragraph(p, ids))


def _nothing(v: Column) -> Column:
    return F.when(F.size(_items(v)) == 0, "malformed")


def _uncited(v: Column) -> Column:
    return F.when(F.exists(_items(v), lambda p: F.size(_cites(p)) == 0), "uncited_paragraph")


def _copilot(raw: Column, ids: Column, historical: Column, conflict: Column) -> Column:
    kind, old = _string(_at(raw, "$.kind")), _at(raw, "$.historical")
    head = F.when(~F.coalesce(kind.isin(KINDS), F.lit(False)) | ~_is(old, "BOOLEAN"), "malformed")

    def marks(cited: Column) -> Column:
        """What is against the ids that each paragraph cites."""
        every = F.flatten(cited)
        unmarked = F.arrays_overlap(every, historical) & ~F.coalesce(F.try_variant_get(old, "$", "boolean"), F.lit(False))
        bare = F.when(F.exists(cited, lambda p: F.size(p) == 0), "uncited_paragraph")
        return F.coalesce(bare, F.when(unmarked, "missing_historical_marker"), F.when(F.arrays_overlap(every, conflict) & (kind != "conflict"), "conflict_not_flagged"))

    def rest(paragraphs: Column) -> Column:
        return F.coalesce(_nothing(paragraphs), _let(F.transform(_items(paragraphs), _cites), marks))

    return F.coalesce(head, _let(_at(raw, "$.paragraphs"), lambda x: F.coalesce(_paragraphs(x, ids), F.when(kind != "insufficient", rest(x)))))


def _learn(raw: Column, ids: Column) -> Column:
    def read(paragraphs: Column) -> Column:
        return F.coalesce(_paragraphs(paragraphs, ids), _nothing(paragraphs), _uncited(paragraphs))

    def example(v: Column) -> Column:
        marked = F.coalesce(F.try_variant_get(_at(v, "$.fictional"), "$", "boolean"), F.lit(False)) & _is(_at(v, "$.fictional"), "BOOLEAN")
        return F.when(~_is(v, "OBJECT"), "malformed").when(~marked, "example_not_marked").otherwise(_text(_at(v, "$.text")))

    def given(examples: Column) -> Column:
        return F.when(examples.isNotNull() & ~_is(examples, "VOID"), _each(examples, EXAMPLES, example))

    return F.coalesce(_let(_at(raw, "$.paragraphs"), read), _let(_at(raw, "$.examples"), given))


def _advise(raw: Column, ids: Column) -> Column:
    def one(v: Column) -> Column:
        right = _is(v, "OBJECT") & F.coalesce(_string(_at(v, "$.status")) == "ai_suggestion", F.lit(False))
        said = _let(_at(v, "$.segments"), lambda x: F.coalesce(_paragraph(x, ids), F.when(F.size(_cites(x)) == 0, "uncited_paragraph")))
        return F.when(~right, "malformed").otherwise(said)

    return _let(_at(raw, "$.suggestions"), lambda x: F.coalesce(_each(x, ENTRIES, one), _nothing(x)))


def _assess(raw: Column, ids: Column) -> Column:
    def one(v: Column) -> Column:
        right = _is(v, "OBJECT") & F.coalesce(_string(_at(v, "$.verdict")).isin(VERDICTS), F.lit(False))
        cited = _let(_at(v, "$.cites"), lambda x: F.coalesce(_each(x, CITES, lambda c: _cited(c, ids)), F.when(F.size(_items(x)) == 0, "uncited_paragraph")))
        return F.when(~right, "malformed").otherwise(F.coalesce(cited, _text(_at(v, "$.criterion"))))

    return _each(_at(raw, "$.criteria"), ENTRIES, one)


def contract_breach(contract: Column | str, answer: Column | str, ids: Column | str, historical: Column | str, conflict: Column | str) -> Column:
    """The first breach of an answer's contract, or null. answer: JSON; ids, historical, conflict: what was sent, and what of it is
    of a former version or in an open conflict."""
    ids, historical, conflict = (F.coalesce(col(x), F.array().cast("array<string>")) for x in (ids, historical, conflict))

    def breach(raw: Column) -> Column:
        turn = F.when(F.contains(F.to_json(raw), F.lit('"cite"')), "unexpected_citation").otherwise(_text(_at(raw, "$.reply")))
        points = _let(_at(raw, "$.points"), lambda x: F.coalesce(_paragraphs(x, ids), _nothing(x)))
        rules = [_copilot(raw, ids, historical, conflict), _learn(raw, ids), turn, points, _advise(raw, ids), _assess(raw, ids)]
        made = F.when(~_is(raw, "OBJECT"), F.lit("malformed"))
        for name, rule in zip(CONTRACTS, rules, strict=True):
            made = made.when(col(contract) == name, rule)
        return made.otherwise("malformed")

    return _let(F.try_parse_json(col(answer)), breach)
