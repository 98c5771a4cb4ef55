"""Rules that the given tables don't show, on small tables made for them."""

from lodestone.plans import registry


def rows(spark, tmp_path, name, **tables):
    for t, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    return registry.queries()[name](spark, str(tmp_path)).collect()


def test_headers_of_each_source_and_of_any_length(spark, tmp_path):
    long = "Report of the year, " + "part of a header that is far longer than eighty characters, " * 2 + "page "
    data = []
    for i in range(8):
        src = "src1" if i < 4 else "src2"
        top = f"{long}{i}" if i < 4 else f"body line {i}"
        middle = [f"own words {'abcdefgh'[i]}{j}x" for j in "klm"]
        data.append((i, src, "\n".join([top, "", *middle[:2], "in the middle", *middle[2:], f"line {'abcdefgh'[i]}", f"Footer {i}" if i >= 4 else f"end {'abcdefgh'[i]}"])))
    data += [(8, "src1", ""), (9, "src1", "\n \n"), (10, "src1", None), (11, "src1", ""), (12, "src1", "")]  # no text
    made = rows(spark, tmp_path, "header_footer", documents=(data, "doc_id long, source string, text string"))
    got = {(r.source, r.line, r.pages) for r in made}
    assert got == {("src1", (long + "#").lower(), 4), ("src2", "footer #", 4), ("src2", "body line #", 4)}


def test_short_passages_and_those_that_begin_inside_a_word(spark, tmp_path):
    docs = [
        (1, "en", 'He said "alpha beta gamma delta epsilon zeta eta theta iota" and left.'),
        (2, "en", "one two\nthree  four five six seven"),
        (3, "en", "unrelated (alpha beta) words, onetwo"),
        (4, "en", None),
    ]
    passages = ["alpha beta gamma delta epsilon zeta eta theta iota", "alpha beta", "two", "two three four", "one two three four five six", "lpha beta gamma del", "nowhere", "", "beta alpha", "three four five six seven", "said \"alpha beta gamma delta epsilon zeta"]
    items = [(i, p) for i, p in enumerate(passages)]
    made = rows(spark, tmp_path, "passage_hits", documents=(docs, "doc_id long, lang string, text string"), benchmark=(items, "item_id long, text string"))
    plain = {(i, d) for i, p in items for d, _, t in docs if p and p in " ".join((t or "").split())}
    assert {(r.item_id, r.doc_id) for r in made} == plain
    assert {i for i, _ in plain} == {0, 1, 2, 3, 4, 5, 9, 10}
