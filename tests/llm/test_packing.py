import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from lodestone.llm.packing import Packer, WordEncoder, pack
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


def check(rows, docs, model, size=4096):
    """Every id lies in exactly one piece, and sequences are gapless. Returns the share of padding."""
    want = Counter()
    for doc_id, text in docs:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want[doc_id, ids.tobytes()] += 1
    cover, sequences = defaultdict(list), defaultdict(list)
    by_id = defaultdict(list)
    for doc_id, ids in want:
        by_id[doc_id].append(ids)
    for r in rows:
        fits = [x for x in by_id[r.doc_id] if len(x) == 4 * r.doc_tokens and zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32]
        assert fits, r
        cover[r.doc_id, fits[0]].extend(range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: Counter(v) for k, v in cover.items()} == {k: Counter({i: n for i in range(len(k[1]) // 4)}) for k, n in want.items()}
    for x in sequences.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end and length > 0
            end += length
        assert end <= size
    held = sum(r.length for r in rows)
    return len(sequences) * size / held - 1 if held else 0


def test_documents_are_packed_whole_with_little_padding(documents, model):
    rows = pack(documents, PATH).collect()
    waste = check(rows, [(r.doc_id, r.text) for r in documents.collect()], model)
    assert waste < 4096 / sum(r.length for r in rows) + 1e-9  # under one window


def test_odd_rows(odd_docs, no_docs, model):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for size in (64, 4096):
        check(pack(odd_docs, PATH, size=size).collect(), docs, model, size)
    assert pack(no_docs, PATH).count() == 0


def test_word_cache_gives_the_ids_of_whole_texts(documents, model):
    encoder = WordEncoder(PATH, words=50)
    for start in range(0, 200, 20):
        batch = [r.text for r in documents.orderBy("doc_id").collect()[start : start + 20]]
        got = [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(batch)]
        assert got == [x.ids for x in model.encode_batch(batch, add_special_tokens=False)]


def test_placement_minimises_squares():
    rng = np.random.default_rng(1)
    packer = Packer(32, 0)
    for i in range(300):
        size = int(rng.integers(1, 32))
        before = packer.level.copy()
        packer.add(i, bytes(4 * size))
        best = min(
            int((after[1:32] ** 2).sum())
            for h in range(0, 33 - size)
            if h == 0 or before[h]
            for after in [before.copy()]
            if [after.__setitem__(h, after[h] - (h > 0)), after.__setitem__(h + size, after[h + size] + 1)]
        )
        assert int((packer.level[1:32] ** 2).sum()) == best


def test_levelling_keeps_every_id():
    rng = np.random.default_rng(2)
    for n, grain in itertools.product((0, 1, 2, 3, 50), (1, 4)):
        packer = Packer(16, 0, grain, max_open=7)
        sizes = rng.integers(1, 40, n)
        for i, s in enumerate(sizes):
            packer.add(i, bytes(4 * int(s)))
        rows = [r for made in (packer.rows(), packer.rest()) for b in made for r in b.to_pylist()]
        assert sum(len(x) for x in packer.at.values()) <= 1
        assert sorted((r["doc_id"], r["start"] + i) for r in rows for i in range(r["length"])) == [(i, k) for i, s in enumerate(sizes) for k in range(s)]
        open_ids = sum(r["length"] for r in rows if r["rest_ids"] is not None)
        assert sum(r["length"] for r in rows) - open_ids == 16 * len({r["sequence_id"] for r in rows if r["rest_ids"] is None})


def test_most_windows_close_without_levelling():
    rng = np.random.default_rng(3)
    packer = Packer(4096, 0, grain=64)
    sizes = np.minimum(rng.lognormal(6, 1, 4000).astype(int) + 1, 20_000)
    for i, s in enumerate(sizes):
        packer.add(i, bytes(4 * int(s)))
    assert packer.settled == 0 and packer.open < 200
    rows = [r for made in (packer.rows(), packer.rest()) for b in made for r in b.to_pylist()]
    assert packer.settled < 0.15 * len({r["sequence_id"] for r in rows})
    assert sorted((r["doc_id"], r["start"] + i) for r in rows for i in range(r["length"])) == [(i, k) for i, s in enumerate(sizes) for k in range(s)]
    assert sum(r["start"] % 4096 > 0 for r in rows) < 0.4 * len(sizes)  # cuts


def test_case_of_words_and_special_strings(model):
    encoder = WordEncoder(PATH)
    batch = ["ÀÉÎ STRASSE Ünlü's X<|ENDOFTEXT|> <|endoftext|>Y", "µ ß ÿ I'LL DON'T", "ΣΑΣ İI ﬁ", "It's <|StartOfText|>", "A\xa0B\x85C\xadD", "".join(map(chr, range(1, 256)))]
    assert encoder.folds
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(batch)]
    assert got == [x.ids for x in model.encode_batch(batch, add_special_tokens=False)]
