from collections import Counter
import random
import re
import string

from lodestone.llm.quality import quality_rules, repeated_words

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = re.findall(WORD, text)
    n = len(words)
    grams = [tuple(words[i : i + 5]) for i in range(n - 4)]
    count = Counter(grams)
    again = len({i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)})
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, again, n < 10 or 100 * again > 20 * n


def test_base_columns_equal_a_plain_count(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        want = sorted((str(r.doc_id), *plain(r.text)) for r in docs.collect())
        rows = quality_rules(docs).collect()
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality_rules(no_docs).count() == 0


def test_repeated_words():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(40))]
        assert repeated_words([w.encode() for w in words]) == plain(" ".join(words))[4]


def test_bands_part_junk_from_prose(spark, documents):
    rng = random.Random(4)
    noise = " ".join("".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(60)) for _ in range(60))
    parts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(2, 5))) for _ in range(3000)]
    dull = " ".join("ab ac ad ae".split()[rng.randrange(4)] for _ in range(3000))
    rows = quality_rules(spark.createDataFrame([(1, noise), (2, dull), (3, " ".join(parts))], "doc_id long, text string")).collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert not kept[1] and not kept[2]


def test_clean_documents_stay(spark, sf_dir):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality = 1")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels, "doc_id")
    rows = quality_rules(docs).filter("not base_failed").collect()
    assert rows and all(r.kept for r in rows)
