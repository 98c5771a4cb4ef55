"""Answers against their contracts, and conflicts as of a day."""

import datetime
import json

from lodestone.operators.contracts import CONTRACTS, contract_breach
from lodestone.operators.evidence import conflicts_on

COPILOT, LEARN, TURN, FEEDBACK, ADVISE, ASSESS = CONTRACTS
CITE, OLD, HOT, FOREIGN, TEXT = {"cite": "e1"}, {"cite": "old"}, {"cite": "hot"}, {"cite": "e9"}, {"text": "so"}


def copilot(*paragraphs, kind="answer", historical=False):
    return {"kind": kind, "historical": historical, "paragraphs": list(paragraphs)}


CASES = [
    (COPILOT, copilot([TEXT, CITE], [CITE]), None),
    (COPILOT, copilot([TEXT, CITE], [TEXT]), "uncited_paragraph"),
    (COPILOT, copilot([TEXT, FOREIGN]), "unknown_citation"),
    (COPILOT, copilot(), "malformed"),
    (COPILOT, copilot([TEXT], kind="insufficient"), None),
    (COPILOT, copilot([FOREIGN], kind="insufficient"), "unknown_citation"),
    (COPILOT, copilot([CITE], kind="other"), "malformed"),
    (COPILOT, copilot([CITE], historical="no"), "malformed"),
    (COPILOT, copilot([OLD]), "missing_historical_marker"),
    (COPILOT, copilot([OLD], historical=True), None),
    (COPILOT, copilot([HOT]), "conflict_not_flagged"),
    (COPILOT, copilot([HOT], kind="conflict"), None),
    (COPILOT, copilot([OLD, HOT]), "missing_historical_marker"),
    (COPILOT, copilot([{"text": "x" * 4001}, CITE]), "too_long"),
    (COPILOT, copilot(*[[CITE]] * 21), "too_long"),
    (COPILOT, copilot([CITE] * 61), "too_long"),
    (COPILOT, copilot([{"text": 1}, FOREIGN]), "malformed"),
    (COPILOT, copilot([FOREIGN, {"text": 1}]), "unknown_citation"),
    (COPILOT, copilot("text"), "malformed"),
    (COPILOT, [], "malformed"),
    (LEARN, {"paragraphs": [[CITE]]}, None),
    (LEARN, {"paragraphs": [[CITE]], "examples": None}, None),
    (LEARN, {"paragraphs": [[CITE]], "examples": [{"text": "x", "fictional": True}, {"text": "y"}]}, "example_not_marked"),
    (LEARN, {"paragraphs": [[CITE]], "examples": [{"text": "x", "fictional": True}] * 6}, "too_long"),
    (LEARN, {"paragraphs": [[TEXT]], "examples": [3]}, "uncited_paragraph"),
    (LEARN, {"paragraphs": [[CITE]], "examples": [3]}, "malformed"),
    (TURN, {"reply": "Hello"}, None),
    (TURN, {"reply": "Hello", "more": [{"cite": "e1"}]}, "unexpected_citation"),
    (TURN, {"reply": 5}, "malformed"),
    (FEEDBACK, {"points": [[TEXT], [CITE]]}, None),
    (FEEDBACK, {"points": []}, "malformed"),
    (ADVISE, {"suggestions": [{"status": "ai_suggestion", "segments": [CITE]}]}, None),
    (ADVISE, {"suggestions": [{"status": "ai_suggestion", "segments": [TEXT]}]}, "uncited_paragraph"),
    (ADVISE, {"suggestions": [{"status": "done", "segments": [CITE]}]}, "malformed"),
    (ADVISE, {"suggestions": []}, "malformed"),
    (ASSESS, {"criteria": [{"criterion": "c", "verdict": "met", "cites": ["e1", "old"]}]}, None),
    (ASSESS, {"criteria": [{"criterion": "c", "verdict": "met", "cites": []}]}, "uncited_paragraph"),
    (ASSESS, {"criteria": [{"criterion": "c", "verdict": "met", "cites": ["e9"]}]}, "unknown_citation"),
    (ASSESS, {"criteria": [{"criterion": "c", "verdict": "best", "cites": ["e1"]}]}, "malformed"),
    (ASSESS, {"criteria": [{"criterion": 1, "verdict": "met", "cites": ["e1"]}]}, "malformed"),
    (ASSESS, {"criteria": []}, None),
    ("other", {}, "malformed"),
]


def test_contracts(spark):
    rows = [(i, c, json.dumps(a), ["e1", "old", "hot"], ["old"], ["hot"]) for i, (c, a, _) in enumerate(CASES)] + [(900, COPILOT, "{no", [], [], []), (901, COPILOT, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, contract string, answer string, ids array<string>, historical array<string>, conflict array<string>")
    got = {r.i: r.code for r in df.select("i", contract_breach("contract", "answer", "ids", "historical", "conflict").alias("code")).collect()}
    assert [got[i] for i in range(len(CASES))] == [x for *_, x in CASES] and got[900] == got[901] == "malformed"


def test_conflicts_on_a_day(spark):
    d = datetime.date
    versions = spark.createDataFrame(
        [(1, "a", "published", d(2020, 1, 1), None), (2, "b", "published", d(2020, 1, 1), d(2024, 1, 1)), (3, "c", "published", d(2020, 1, 1), None), (4, "d", "withdrawn", d(2020, 1, 1), None)],
        "version long, document string, status string, valid_from date, valid_to date",
    )
    chunks = spark.createDataFrame([(1, 11), (1, 12), (3, 31), (4, 41)], "version long, chunk_id long")
    passages = spark.createDataFrame(
        [(7, "left", 1, 11), (7, "right", 2, 21), (8, "left", 1, None), (8, "right", 3, 31), (9, "left", 1, None), (9, "right", 3, None), (6, "left", 1, None), (6, "right", 4, None)],
        "conflict long, side string, version long, chunk_id long",
    )
    conflicts = spark.createDataFrame([(7, "open"), (8, "open"), (9, "resolved"), (6, "open")], "conflict long, status string")

    def on(day, *readable):
        made = conflicts_on(chunks, passages, conflicts, versions, spark.createDataFrame([(x,) for x in readable], "version long"), day)
        return sorted(map(tuple, made.collect()), key=str)

    assert on(d(2022, 1, 1), 1, 2, 3, 4) == sorted([(11, False, 7, "b", 2, 21), (11, False, 8, "c", 3, 31), (12, False, 8, "c", 3, 31), (31, False, 8, "a", 1, None)], key=str)
    assert on(d(2024, 1, 1), 1, 2, 3) == sorted([(11, False, 8, "c", 3, 31), (12, False, 8, "c", 3, 31), (31, False, 8, "a", 1, None)], key=str)
    assert on(d(2022, 1, 1), 1) == sorted([(11, True, None, None, None, None), (12, True, None, None, None, None)], key=str)


def test_no_way_around_the_filter(spark):
    import pytest
    from lodestone.sources.secured import SecuredReader

    d = datetime.date
    versions = spark.createDataFrame([(1, "a", "published", d(2020, 1, 1), None), (2, "b", "published", d(2020, 1, 1), None), (3, "a", "draft", d(2020, 1, 1), None), (4, "a", "published", d(2010, 1, 1), d(2020, 1, 1))],
                                     "version long, document string, status string, valid_from date, valid_to date")
    tables = {"versions": versions, "chunks": spark.createDataFrame([(v, f"t{v}") for v in (1, 2, 3, 4, 5)], "version long, text string"), "people": spark.createDataFrame([("x",)], "name string")}
    a, none = spark.createDataFrame([("a",)], "document string"), spark.createDataFrame([], "document string")
    reader = SecuredReader(tables.__getitem__, a, none, d(2024, 1, 1))
    assert [r.version for r in reader.table("versions").collect()] == [1] and [r.text for r in reader.table("chunks").collect()] == ["t1"]
    assert sorted(r.text for r in SecuredReader(tables.__getitem__, a, a, d(2024, 1, 1)).table("chunks").collect()) == ["t1", "t4"]
    assert not hasattr(reader, "tables") and SecuredReader(tables.__getitem__, none, none, d(2024, 1, 1)).table("chunks").count() == 0
    with pytest.raises(PermissionError):
        reader.table("people")


MODEL = {"model_id": "m", "provider": "p", "model": "x", "version": "1", "dimensions": 8}
GOOD = {
    "set": "s", "mode": "current", "as_of": datetime.date(2024, 1, 1), "schema": 2, "algorithm": "a1", "fingerprint": "f" * 64, "dev_override": False, "role": "authenticated", "user": "u",
    "embedder": MODEL | {"production": True, "grade": "production"}, "active": MODEL, "reranker": {"production": True, "grade": "production", "id": "cross", "version": "2"},
    "configuration": {"status": "active", "ready": True, "not_ready": [], "approved": True, "tier": "pilot", "model_id": "m", "reranker_id": "cross", "reranker_version": "2", "fingerprint": "f" * 64, "algorithm": "a1",
                      "chunkers": ["c1"], "scope": [{"product": "house", "type": "terms"}]},
}
OWN = {"set": "s", "document": "d", "version": "1", "status": "published", "withdrawn": False, "authoritative": True, "valid_from": datetime.date(2020, 1, 1), "valid_to": None, "temporal_status": "current",
       "chunker": "c1", "product": "house", "document_type": "terms"}
SETS = (
    "set string, mode string, as_of date, schema int, algorithm string, fingerprint string, dev_override boolean, role string, user string, "
    "embedder struct<production:boolean,grade:string,model_id:string,provider:string,model:string,version:string,dimensions:int>, active struct<model_id:string,provider:string,model:string,version:string,dimensions:int>, "
    "reranker struct<production:boolean,grade:string,id:string,version:string>, configuration struct<status:string,ready:boolean,not_ready:array<string>,approved:boolean,tier:string,model_id:string,reranker_id:string,"
    "reranker_version:string,fingerprint:string,algorithm:string,chunkers:array<string>,scope:array<struct<product:string,type:string>>>"
)
ITEMS = "set string, document string, version string, status string, withdrawn boolean, authoritative boolean, valid_from date, valid_to date, temporal_status string, chunker string, product string, document_type string"


def _in(part, **changed):
    return {part: GOOD[part] | changed}


GRADES = {
    "good": ({}, [OWN, OWN | {"document": "e"}], []),
    "empty": ({}, [], []),
    "other_model": (_in("active", version="2"), [OWN], ["P1"]),
    "no_embedder": ({"embedder": None}, [OWN], ["P1"]),
    "development_embedder": (_in("embedder", production=False), [OWN], ["P1"]),
    "no_reranker": (_in("reranker", id="none"), [OWN], ["P2"]),
    "other_reranker": (_in("configuration", reranker_version="3"), [OWN], ["P2"]),
    "suspended": (_in("configuration", status="suspended"), [OWN], ["P3"]),
    "not_ready": (_in("configuration", not_ready=["uncertainty"]), [OWN], ["P3"]),
    "outside_pilot": ({}, [OWN | {"product": "car"}], ["P3"]),
    "standard": (_in("configuration", tier="standard"), [OWN | {"product": "car"}], []),
    "outside_standard": (_in("configuration", tier="standard"), [OWN | {"document_type": "guide"}], ["P3"]),
    "runtime": ({"fingerprint": "e" * 64}, [OWN], ["P4"]),
    "withdrawn": ({}, [OWN, OWN | {"document": "e", "withdrawn": True}], ["P5"]),
    "two_versions": ({}, [OWN, OWN | {"version": "2"}], ["P5"]),
    "past": ({}, [OWN | {"temporal_status": "historical"}], ["P5"]),
    "past_as_of": ({"mode": "as_of"}, [OWN | {"temporal_status": "historical"}], []),
    "not_valid": ({}, [OWN | {"valid_to": datetime.date(2024, 1, 1)}], ["P5"]),
    "service": ({"role": "service"}, [OWN], ["P6"]),
    "nobody": ({"user": None}, [OWN], ["P6"]),
    "chunker": ({}, [OWN | {"chunker": None}], ["P7"]),
    "override": ({"dev_override": True}, [OWN], ["P8"]),
    "schema": ({"schema": 1}, [OWN], ["P9"]),
    "no_configuration": ({"configuration": None}, [OWN], ["P1", "P2", "P3", "P4", "P7", "P9"]),
}


def test_grades(spark):
    from lodestone.operators.grading import graded

    sets = [GOOD | changed | {"set": name} for name, (changed, _, _) in GRADES.items()]
    items = [x | {"set": name} for name, (_, some, _) in GRADES.items() for x in some]
    got = {r.set: (r.grade, r.unmet) for r in graded(spark.createDataFrame(sets, SETS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {name: ("development" if unmet else "production", unmet) for name, (_, _, unmet) in GRADES.items()}


def test_a_set_meets_its_items_without_what_it_was_made_of(spark):
    from lodestone.operators.grading import graded

    plan = graded(spark.createDataFrame([], SETS), spark.createDataFrame([OWN | {"set": "s"}], ITEMS))._jdf.queryExecution().analyzed().toString()
    above = plan[: plan.rindex("Join LeftOuter")]
    assert "embedder" not in above and "fingerprint" not in above


def test_an_answer_is_parsed_once(spark):
    """An answer's parts are bound where they are read, so a rule that names one twice doesn't read it again."""
    df = spark.createDataFrame([("x", "{}", [], [], [])], "contract string, answer string, ids array<string>, historical array<string>, conflict array<string>")
    made = df.select(contract_breach("contract", "answer", "ids", "historical", "conflict").alias("code"))
    assert made._jdf.queryExecution().analyzed().toString().count("try_parse_json") == 1
