import public_tokenizers
import sentencepiece
from lodestone.llm.token_counts import safe_parts, token_counts
from tokenizers import Tokenizer


def test_counts_are_the_library_s(documents, odd_docs, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for docs in (documents, odd_docs):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect())
        for size in (16, 300, 1 << 16):
            rows = token_counts(docs, path, long_text=size).collect()
            assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
            assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)
    assert token_counts(no_docs, path).count() == 0


def test_counts_by_a_tokenizers_file(odd_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    want = sorted((str(r.doc_id), len(model.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts(odd_docs, path).collect()) == want


def test_parts_join_to_the_text():
    for text in ("", "a", "a b", "  a  b   c d e ", "x" * 50, "a b c d e f g h i j"):
        for size in (1, 2, 5):
            parts = safe_parts(text, size)
            assert " ".join(parts) == text
            assert all(x[:1] != " " for x in parts[1:]) and all(x[-1:] != " " for x in parts[:-1])
