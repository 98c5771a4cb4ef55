"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are encoded in batches balanced by bytes. Long texts are first split at safe boundaries, places that
no piece of the vocabulary can span, so that the parts' counts add up to the count of the whole text. Where
a vocabulary has no such places, texts are encoded whole.

Defined cases: a null or empty text has no tokens. Repeated rows give repeated results. Other columns are
ignored. An empty table gives an empty result. Nothing is truncated.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import by_bytes, table, texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
PIECE_SPACE = "▁"


def safe_parts(text: str, size: int) -> list[str]:
    """The text in parts of about `size` characters, cut at single spaces between two other characters; the
    space goes, for the encoder puts one before each part."""
    parts, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and (at + 1 >= len(text) or text[at - 1] == " " or text[at + 1] == " "):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        parts.append(text[start:at])
        start = at + 1
    parts.append(text[start:])
    return parts


def piece_counter(path: str, long_text: int) -> Callable[[list[str]], list[int]]:
    """Counts by a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.piece_size()))
    inside = any(PIECE_SPACE in x.lstrip(PIECE_SPACE) for x in pieces)
    probe = "a  b c"
    plain = model.normalize(probe) == PIECE_SPACE + probe.replace(" ", PIECE_SPACE)
    size = long_text if plain and not inside else None

    def count(batch: list[str]) -> list[int]:
        parts = [safe_parts(x, size) if size and len(x) > size else [x] for x in batch]
        lengths = iter(map(len, model.encode([y for x in parts for y in x], num_threads=1)))
        return [sum(next(lengths) for _ in x) for x in parts]

    return count


def json_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by a tokenizers file, texts whole: its splitting rules are not known here."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda batch: [len(x.ids) for x in model.encode_batch_fast(batch, add_special_tokens=False)]


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 4096, batch_bytes: int = 1 << 20, long_text: int = 1 << 16
) -> DataFrame:
    """One row of SCHEMA per row of docs (doc_id, text). vocabulary: a .model (sentencepiece) or .json
    (tokenizers) file that every executor has at this path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = json_counter(vocabulary) if vocabulary.endswith(".json") else piece_counter(vocabulary, long_text)
        for batch in by_bytes(batches, "text", batch_bytes):
            column = pc.fill_null(batch.column("text"), "")
            n = pa.array(count(column.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(column).cast(pa.int64()), n, pc.greater(n, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs).mapInArrow(run, SCHEMA)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
