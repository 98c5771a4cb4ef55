"""Structure and chunks of paged documents, on a made document whose every block and chunk is known."""

import pytest
from lodestone.functions.python import sentence_spans, sentences
from lodestone.operators.ordered import carried, ranks
from lodestone.operators.sections import Room, section_chunks
from lodestone.operators.structure import heading_paths, structured
from pyspark.sql import functions as F

LINES = "doc string, page int, line int, text string, size double, bold boolean, x double, y double, runs array<struct<text:string,x:double>>"


def page(number, *lines, doc="d"):
    """Lines of a page: text and what is given of size, bold, indent, before (space) and cells."""
    y, rows = 780.0, []
    for i, (text, given) in enumerate(lines):
        size = given.get("size", 10.0)
        y -= given.get("before", 0) + size * 1.4
        cells = given.get("cells")
        runs = [(c, float(x)) for c, x in cells] if cells else [(text, 60.0)]
        rows.append((doc, number, i, " ".join(c for c, _ in cells) if cells else text, size, given.get("bold", False), 60.0 + given.get("indent", 0), y, runs))
    return rows


def head(text, size=13.0):
    return text, {"size": size, "bold": True, "before": 10}


def row(*cells):
    return "", {"cells": list(zip(cells, (60, 260, 380)))}


TERMS = [
    *page(1,
        head("Rules of the Test Society (made up)", 16.0),
        head("§ 1 Members"),
        ("The rules hold for members and guests, jf. § 4 stk. 2. They don't hold for", {"before": 4}),
        ("visitors, unless that was agreed.", {}),
        head("§ 2 Places"),
        ("The rules hold in the house, f.eks. in the hall. The rules end at the gar-", {"before": 4}),
        ("den gate.", {}),
    ),
    *page(2,
        head("§ 3 Fees"),
        ("The fees are listed below.", {"before": 4}),
        row("Who", "Fee", "Due"), row("Member", "10 kr.", "May"), row("Guest", "5 kr.", "June"),
        head("§ 4 Exceptions"),
        head("4.1 Children", 11.0),
        ("Children pay nothing. They come", {"before": 4}),
        ("with their parents.", {}),
        head("4.2 Others", 11.0),
        ("Nobody may bring:", {"before": 4}),
        ("• animals that are larger", {"indent": 10}),
        ("than a cat", {"indent": 20}),
        ("• noise", {"indent": 10}),
        ("This holds at all times.", {"before": 8}),
    ),
    *page(3, head("§ 5 Complaints"), ("A complaint goes to the board, which answers it in a month and sends the", {"before": 4})),
    *page(5, ("answer by letter. The board may ask for more.", {}), head("§ 6 End"), ("Membership ends in May.", {"before": 4})),
]


def made(spark, rows, pages=None):
    lines = spark.createDataFrame(rows, LINES).repartition(3)
    every = spark.createDataFrame(pages, "doc string, page int") if pages else None
    return structured(lines, every)


@pytest.fixture(scope="module")
def terms(spark):
    return made(spark, TERMS, [("d", n) for n in range(1, 6)] + [("empty", 1)])


def document(pieces):
    """The pieces' texts, each at its place."""
    text = ""
    for r in sorted(pieces, key=lambda r: r.start):
        text += "\n" * (r.start - len(text)) + r.text
        assert text[r.start : r.end] == r.text
    return text


def test_headings(terms):
    rows = terms.pieces.filter("kind = 'heading'").orderBy("start").collect()
    assert [(r.text, r.level, r.section_number) for r in rows] == [
        ("Rules of the Test Society (made up)", 1, None), ("§ 1 Members", 2, "1"), ("§ 2 Places", 2, "2"), ("§ 3 Fees", 2, "3"), ("§ 4 Exceptions", 2, "4"),
        ("4.1 Children", 3, "4.1"), ("4.2 Others", 3, "4.2"), ("§ 5 Complaints", 2, "5"), ("§ 6 End", 2, "6"),
    ]


def test_blocks(terms):
    rows = terms.pieces.orderBy("start").collect()
    text = document(rows)
    assert "They don't hold for visitors" in text and "at the garden gate." in text and "sends the answer by letter." in text
    assert [r.text for r in rows if r.kind == "list"] == ["• animals that are larger than a cat", "• noise"]
    assert [r.text for r in rows if r.kind == "table"] == ["Who | Fee | Due", "Member | 10 kr. | May", "Guest | 5 kr. | June"]
    assert len({r.block for r in rows if r.kind == "table"}) == len({r.block for r in rows if r.kind == "list"}) == 1
    assert sorted({r.block for r in rows}) == list(range(len({r.block for r in rows})))
    for before, r in zip(rows, rows[1:], strict=False):
        assert r.start - before.end == (1 if r.block == before.block else 2)
    assert [r.uncertain for r in terms.tables.collect()] == [False]


def test_pages(terms):
    rows = terms.pages.orderBy("doc", "page").collect()
    text = document(terms.pieces.collect())
    spans = {(r.doc, r.page): (r.start, r.end, r.has_text) for r in rows}
    assert spans["empty", 1] == (0, 0, False)
    assert not spans["d", 4][2] and spans["d", 4][0] == spans["d", 4][1] == spans["d", 3][1] == spans["d", 5][0]
    assert text[slice(*spans["d", 2][:2])].startswith("§ 3 Fees") and text[slice(*spans["d", 5][:2])].endswith("in May.")
    assert spans["d", 1][0] == 0 and spans["d", 5][1] == len(text)


def test_paths(terms):
    paths = {tuple(r.path): [x for x in r.numbers if x] for r in heading_paths(terms.pieces).collect()}
    top = "Rules of the Test Society (made up)"
    assert paths[top, "§ 4 Exceptions", "4.2 Others"] == ["4", "4.2"] and paths[top, "§ 6 End"] == ["6"] and len(paths) == 9


def test_chunks(terms):
    rows = section_chunks(terms.pieces).orderBy("chunk_index").collect()
    text = document(terms.pieces.collect())
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(text[r.char_start : r.char_end] == r.text and r.char_count == len(r.text) for r in rows)
    children = next(r for r in rows if "pay nothing" in r.text)
    assert children.heading == "4.1 Children" and children.heading_path[1:] == ["§ 4 Exceptions", "4.1 Children"] and children.section_number == "4.1" and children.page_start == 2
    complaint = next(r for r in rows if "A complaint" in r.text)
    assert (complaint.page_start, complaint.page_end) == (3, 5)
    listed = next(r for r in rows if "noise" in r.text)
    assert (listed.kind, listed.text) == ("list", "Nobody may bring:\n\n• animals that are larger than a cat\n• noise")
    assert rows[rows.index(listed) + 1].text == "This holds at all times."
    assert [r.text for r in rows if r.kind == "table"] == ["Who | Fee | Due\nMember | 10 kr. | May\nGuest | 5 kr. | June"]


def test_a_long_list_repeats_its_lead(spark):
    lines = [head("§ 7 Other exceptions"), ("Nor may anybody bring:", {"before": 4})]
    lines += [(f"• forbidden thing number {i}, which only this test knows", {"indent": 10}) for i in range(24)]
    rows = section_chunks(made(spark, page(1, *lines)).pieces, Room(target=400, most=800)).orderBy("chunk_index").collect()
    assert len(rows) > 3 and {r.kind for r in rows} == {"list"}
    assert rows[0].lead_in is None and rows[0].text.startswith("Nor may anybody bring:\n\n• forbidden")
    assert all(r.lead_in == "Nor may anybody bring:" and r.text.startswith("• forbidden") and r.char_count <= 400 for r in rows[1:])
    assert sum(r.text.count("•") for r in rows) == 24


def test_a_long_table_repeats_its_header(terms):
    rows = [r for r in section_chunks(terms.pieces, Room(target=30, most=60)).orderBy("chunk_index").collect() if r.kind == "table"]
    assert [(r.text, r.lead_in) for r in rows] == [("Who | Fee | Due", None), ("Member | 10 kr. | May", "Who | Fee | Due"), ("Guest | 5 kr. | June", "Who | Fee | Due")]


@pytest.fixture(scope="module")
def duties(spark):
    lines = [head("§ 8 Duties")]
    lines += [(f"A member has to keep duty number {i}. It holds for the whole year.", {"before": 8}) for i in range(1, 13)]
    lines += [head("§ 9 Rights"), ("A member has a right to advice.", {"before": 4})]
    return made(spark, page(1, *lines)).pieces


def test_chunks_overlap_within_a_section_only(duties):
    rows = section_chunks(duties, Room(target=400, most=800)).orderBy("chunk_index").collect()
    own = [r for r in rows if r.section_number == "8"]
    assert len(own) > 1 and own[0].overlap_chars == 0
    for before, r in zip(own, own[1:], strict=False):
        assert 0 < r.overlap_chars <= 60 and len(sentence_spans(r.text[: r.overlap_chars])) <= 2
        assert r.char_start + r.overlap_chars - 2 == before.char_end
    assert [r.overlap_chars for r in rows if r.section_number == "9"] == [0]


def test_a_long_paragraph_is_cut_at_sentences(spark):
    text = " ".join(f"This is sentence number {i} of a long paragraph." for i in range(40))
    rows = section_chunks(made(spark, page(1, head("§ 1 Long"), (text, {"before": 4}))).pieces, Room(target=120, most=150)).orderBy("chunk_index").collect()
    assert len(rows) == 20 and all(r.text.endswith(".") and r.char_count - r.overlap_chars <= 120 for r in rows)


def test_sections_dont_depend_on_other_documents(spark, terms):
    alone = {str(r) for r in section_chunks(terms.pieces).drop("doc").collect()}
    both = made(spark, [*TERMS, *[("d2", *r[1:]) for r in TERMS]]).pieces
    for doc in ("d", "d2"):
        assert {str(r) for r in section_chunks(both).filter(F.col("doc") == doc).drop("doc").collect()} == alone


def test_odd_lines(spark):
    rows = [("d", 1, 0, None, None, None, None, None, None), ("d", 1, 1, "", 10.0, True, 0.0, 0.0, []), ("d", 1, 2, "plain", None, None, None, None, None)]
    got = made(spark, rows).pieces.collect()
    assert [(r.kind, r.text, r.start) for r in got] == [("paragraph", "plain", 0)]
    assert section_chunks(made(spark, rows[:2], [("d", 1)]).pieces).collect() == []


def test_sentences_are_the_same_in_the_jvm(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(80).collect()]
    texts += ["Se ca. 5 kr. Ja! Og f.eks. Nej? (Ok.) \"Slut.\" x. ", "", "   ", "a. B.\n\nC jf. D", None, "Ét ord! 𝒜bc. Næste"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("i", sentences("text").alias("s")).collect():
        assert [(x.start, x.end) for x in r.s] == sentence_spans(texts[r.i] or "")


def test_running_values(spark):
    rows = [(g, i, (i * 7) % 5, None if i % 3 else f"v{i}") for g in ("a", None) for i in range(200)] + [("b", 0, 9, None)]
    df = spark.createDataFrame(rows, "g string, i int, n int, v string").repartition(7)
    got = {(r.g, r.i): (r.before_n, r.top_n, r.prev_v) for r in carried(df, ["g"], ["i"], ["n"], ["n"], ["v"]).collect()}
    for g in ("a", None):
        mine = [r for r in rows if r[0] == g]
        for i in range(200):
            earlier = mine[:i]
            assert got[g, i] == (sum(r[2] for r in earlier), max((r[2] for r in earlier), default=None), next((r[3] for r in reversed(earlier) if r[3]), None))
    assert got["b", 0] == (0, None, None)


def test_ranks(spark):
    rows = [("a", float(i % 50)) for i in range(501)] + [("b", 1.0), ("b", None), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {(r.g, r.p): r.v for r in ranks(df, ["g"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    import math

    for g in ("a", "b", None):
        mine = sorted(v for k, v in rows if k == g and v is not None)
        for p in (0.0, 0.5, 0.95, 1.0):
            assert got[g, p] == mine[max(1, math.ceil(p * len(mine) - 1e-9)) - 1]


def test_headers_go_without_a_row_for_each_line(spark):
    """A page's lines stay in its row: a row of each would work out the whole page again for every line of it."""
    from lodestone.operators.review import without_headers

    body = [f"own {i} line" for i in "abc"]
    rows = [("h", i, "\n".join(["Top 1", *[f"{x} {chr(97 + i)}" for x in body], f"page {i}"])) for i in range(4)]
    rows += [("h", 3, "Top 2\nlater"), (None, 1, "Top 1\nx"), ("h", 9, None), ("other", 1, "Top 1")]
    made = without_headers(spark.createDataFrame(rows, "host string, page int, text string"), "host", "page")
    got = {(r.host, r.page): (r.text, r.removed) for r in made.collect()}
    assert got["h", 0] == ("own a line a\nown b line a\nown c line a", 2)
    assert got["h", 3] == ("later\nown a line d\nown b line d\nown c line d", 3)
    assert got[None, 1] == ("Top 1\nx", 0) and got["h", 9] == ("", 0) and got["other", 1] == ("Top 1", 0)
    assert "posexplode" not in made._jdf.queryExecution().optimizedPlan().toString()
