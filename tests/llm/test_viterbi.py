import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from lodestone.llm.viterbi import Codec, Vocabulary, coding, decoded, encoded, merged

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  two  spaces ", "tab\tand\nlines\r\n;\r", "你好 世界😀", "naïve é", "aaaaaaaaaaaaaaaaaaa", "        deep    run                    x", "<s> </s> <unk> <0x0A>", "x" * 5000, "http://www.example.com/a?b=c&d=e"]


@pytest.fixture(scope="module")
def bpe():
    return Vocabulary(PATH)


@pytest.fixture(scope="module")
def unigram():
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(PATH, "rb").read())
    spec.trainer_spec.model_type = 1
    for p in spec.pieces:
        if p.score < -1e6:
            p.score = -40000.0
        p.score = p.score / 1024  # sums stay exact in the library's 32-bit numbers
    return Vocabulary(proto=spec.SerializeToString())


def ids(codec, text):
    return np.frombuffer(codec.encode(text), dtype="<u4").tolist()


def test_bpe_ids_are_the_library_s(bpe, documents):
    codec = Codec(bpe, cache=500)
    for text in ODD + [r.text for r in documents.collect()]:
        assert ids(codec, text) == bpe.model.encode(text)
        assert codec.decode(codec.encode(text)).decode() == text


def test_random_strings(bpe, unigram):
    rng = random.Random(5)
    for v in (bpe, unigram):
        codec = Codec(v)
        for _ in range(300):
            text = "".join(rng.choice("abehnorst  .,\té-_=") for _ in range(rng.randrange(60)))
            assert ids(codec, text) == v.model.encode(text), (v.kind, text)


def test_unigram_ids_are_the_library_s(unigram, documents):
    codec = Codec(unigram)
    for text in ODD[:-2] + [r.text[:800] for r in documents.limit(60).collect()]:
        assert ids(codec, text) == unigram.model.encode(text)


def test_streaming_commits_with_a_bounded_window(bpe):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(3000))
    for step in (1, 7, 3000):
        stream = Codec(bpe).stream()
        got = b"".join(x for i in range(0, len(text), step) for x in stream.feed(text[i : i + step]))
        assert len(shown(bpe, got)) > 2800 and stream.commits > 5 and stream.held <= 8 * bpe.longest
        got += b"".join(stream.close())
        assert [bpe.piece[p] for p in np.frombuffer(got, dtype="<u4").tolist()] == merged(text, bpe.score)


def shown(v, got):
    return "".join(v.piece[p] for p in np.frombuffer(got, dtype="<u4").tolist())


def test_parts_of_any_size_give_the_same_ids(bpe, unigram):
    """Spaces, runs of them and long stretches cut anywhere, with a cache too small for most."""
    rng = random.Random(7)
    for v in (bpe, unigram):
        for _ in range(80):
            text = "".join(rng.choice(["a", "be", "the", "ing", " ", "  ", "é", "😀", "x" * 60, "deep"]) for _ in range(rng.randrange(80)))
            codec, plain = Codec(v, cache=5), v.model.normalize(text)
            stream, at, got = codec.stream(), 0, []
            while at < len(plain):
                n = rng.choice((1, 2, 5, 40))
                got += stream.feed(plain[at : at + n])
                at += n
            got += stream.close()
            assert np.frombuffer(b"".join(got), dtype="<u4").tolist() == v.model.encode(text)
            assert ids(Codec(v, step=20), text) == v.model.encode(text)


def test_documents_are_streamed_with_commits(bpe, documents):
    """Long texts in parts: ids are settled all along, the lattice and what waits stay small."""
    text = " ".join(r.text for r in documents.limit(150).collect())
    codec = Codec(bpe, step=1000)
    assert len(list(codec.normalised(text))) > len(text) // 1200
    stream, got, most = codec.stream(), [], 0
    for part in codec.normalised(text):
        got += stream.feed(part)
        most = max(most, len(stream.waits) + len(stream.text))
    got += stream.close()
    assert stream.commits > len(text) // 20 and stream.held < 8 * bpe.longest and most < 2000
    assert np.frombuffer(b"".join(got), dtype="<u4").tolist() == bpe.model.encode(text)
    assert codec.checked(text)[1:] == (len(b"".join(got)) // 4, zlib.crc32(b"".join(got)), codec.decode(b"".join(got)).decode() == text)


def test_frames(spark, odd_docs, no_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted((str(r.doc_id), len(x := model.encode(r.text or "")), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for r in odd_docs.collect())
    rows = coding(odd_docs, PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == want and all(r.round_trip for r in rows)
    back = decoded(encoded(odd_docs, PATH), PATH)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in odd_docs.collect())
    assert coding(no_docs, PATH).count() == 0
