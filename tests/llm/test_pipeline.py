import corpus_pipeline
import numpy as np
import public_tokenizers
import zstandard
from lodestone.llm.quality import Bands, judge
from test_packing import check as check_packing
from test_passages import plain as plain_passages
from test_similar import plain_groups
from tokenizers import Tokenizer


def kept_rows(rows):
    """One row of each group of similar texts: (doc_id, text) of the smallest id."""
    of = plain_groups([(r.doc_id, r.text) for r in rows])
    return [r for r in rows if of[r.doc_id] == r.doc_id]


def test_stages_equal_plain_python(spark, documents, sf_dir):
    press, bands = zstandard.ZstdCompressor(level=3, write_content_size=False), Bands()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "SimHash near-dedup", "substring dedup", "packing"]
    docs, rows = documents, documents.collect()
    stage = dict(corpus_pipeline.STAGES)

    docs = stage["quality rules"](spark, docs, sf_dir)
    rows = [r for r in rows if judge((r.text or "").encode(), bands, press)[6]]
    assert docs.columns == documents.columns and sorted(docs.collect()) == sorted(rows)

    docs = stage["SimHash near-dedup"](spark, docs, sf_dir)
    rows = kept_rows(rows)
    assert docs.columns == documents.columns and sorted(docs.collect()) == sorted(rows)

    docs = stage["substring dedup"](spark, docs, sf_dir)
    want = sorted((r.doc_id, x[3], r.lang, r.source) for r, x in zip(rows, plain_passages([r.text for r in rows])))
    got = docs.collect()
    assert docs.columns == documents.columns
    assert sorted((r.doc_id, r.text.split(), r.lang, r.source) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)

    made = stage["packing"](spark, docs, sf_dir).collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check_packing(made, [(r.doc_id, r.text) for r in got], model)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sum(r.length for r in whole) == sum(r.length for r in made)
    assert {r.doc_id for r in whole} == {r.doc_id for r in made}


def test_odd_rows(spark, odd_docs, no_docs, sf_dir):
    base = odd_docs.selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as bigint) n_chars", "'clash' component_id", "'clash' fp")
    for docs in (base, base.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, sf_dir)
            assert made.columns == docs.columns
            assert made.count() <= docs.count()
        corpus_pipeline.packing(spark, docs, sf_dir).count()
    rows = corpus_pipeline.near_dedup(spark, base, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in rows if r.doc_id in (2, 3, 4)) == ["2", "4"]
    assert sum(r.doc_id is None for r in rows) == 1
