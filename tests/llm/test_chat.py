import duckdb
import pytest
from lodestone.llm.chat import OP8_SQL, dialogues, segments

ROWS = [
    (1, 0, "system", "Be kind.", "x"),
    (1, 1, "ann", "Hi 😀", "x"),
    (1, 2, "bob", "Hello", "x"),
    (1, 3, "ann", None, "x"),
    (1, 3, "ann", None, "x"),
    (1, 4, None, "who?", "x"),
    (1, None, "cy", "late", "x"),
    (None, 1, "ann", "lost", "x"),
    (2, 0, "system", "alone", "x"),
    (3, 5, "unknown", "named so", "x"),
    (3, 5, None, "named so", "x"),
] + [(4, i, "abc"[i % 3], f"turn {i}", "x") for i in range(50)]


@pytest.mark.parametrize("reach", [1, 7, 1024])
def test_segments_equal_sql(spark, reach):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, seq string")
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar, seq varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?, ?)", ROWS)
    key = lambda r: str(tuple(r))
    want = con.execute(OP8_SQL).fetchall()
    made = segments(df, reach)
    assert made.columns == [c[0] for c in con.execute(OP8_SQL).description]
    assert sorted(map(tuple, made.collect()), key=key) == sorted(want, key=key)


def test_dialogues_and_spans(spark):
    df = spark.createDataFrame(ROWS[:4], "conv_id long, turn long, role string, text string, seq string")
    rows = {r.speaker: r for r in dialogues(df).collect()}
    assert rows["bob"].text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nHi 😀<|im_end|>\n"
        "<|im_start|>assistant\nHello<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    )
    assert [rows["bob"].text[s.start : s.end] for s in rows["bob"].spans] == ["Hello<|im_end|>"]
    assert [rows["ann"].text[s.start : s.end] for s in rows["ann"].spans] == ["Hi 😀<|im_end|>", "<|im_end|>"]


def test_turns_without_a_number_and_very_many_participants(spark):
    rows = [(1, None, name, text) for name, text in (("bob", "x"), ("ann", "y"), ("ann", None), (None, "z"))]
    rows += [(2, i, f"p{i:03d}", "w" * (i % 5)) for i in range(150)]
    made = segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), reach=40).collect()
    one = sorted((r.speaker, r.seq, r.shown_role, r.shown_name) for r in made if r.conv_id == 1)
    assert one[:4] == [("ann", 0, "assistant", None), ("ann", 1, "assistant", None), ("ann", 2, "user", "bob"), ("ann", 3, "user", "unknown")]
    assert len(one) == 8 and {r.turn for r in made if r.conv_id == 1} == {None}
    many = [r for r in made if r.conv_id == 2]
    assert len(many) == 150 * 150 and sum(r.mask_start is not None for r in many) == 150
    texts = {}
    for r in sorted(many, key=lambda r: (r.speaker, r.seq)):
        assert r.seg_start == len(texts.setdefault(r.speaker, ""))
        texts[r.speaker] += r.segment


def test_empty(spark):
    assert segments(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
