"""SentencePiece encoding and decoding: streaming Viterbi.

A text comes to the lattice in chunks. The lattice keeps one best path for each boundary and looks back no
farther than the longest piece. Whenever the paths of all boundaries that later pieces can still start from
meet in one boundary, the ids up to there are committed and forgotten, so memory doesn't grow with the text.
One place where they always meet is a boundary that no piece of the vocabulary can cross; most vocabularies
have no piece that holds the space mark after other characters, so with them every word's end is one. The
lattice then starts anew, whatever came before, and what it committed from one such place to the next is kept
in a bounded cache: a stretch seen before is committed without a lattice.

Which path is best depends on the model's kind. For a unigram model it is the highest sum of piece scores. For
a BPE model a path is admissible if each two neighbours are what the merges make of their own text; one path
to each boundary is, and it is what merging the whole prefix gives. So the ids are the library's for both.

Texts are normalised in chunks, too, cut at single spaces between ASCII letters or digits, which no rule of
normalisation joins; a text without such places, or of a model without the leading space mark, is normalised
as a whole. The counts and checks of a text are taken from its ids as they are committed.

Defined cases: a null or empty text has no ids. Unknown characters become byte pieces, or the unknown id where
the model has none. Repeated rows give repeated results. Other columns are ignored. An empty table gives an
empty result. Texts are encoded whole; decoding gives back any text that the model normalises to itself and
that holds no space mark (U+2581).
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_bytes, table, texts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the unigram model
SCHEMA = "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, round_trip boolean"


class Vocabulary:
    """Pieces, scores and rules of a sentencepiece model file. kind: "bpe" or "unigram"."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(proto)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.kind = {1: "unigram", 2: "bpe"}[spec.trainer_spec.model_type]
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        self.shown: list[bytes] = []
        self.unknown = self.model.unk_id()
        for i in range(self.model.piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.shown.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i):
                self.shown.append(b"")
            elif self.model.is_unknown(i):
                self.shown.append(" ⁇ ".encode())
            else:
                self.id[piece], self.score[piece] = i, self.model.get_score(i)
                self.shown.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.id), default=1)
        self.piece = {i: x for x, i in self.id.items()}
        self.scores = {i: self.score[x] for x, i in self.id.items()}
        self.least = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.spaced = any(SPACE in x.lstrip(SPACE) for x in self.id)

    def ids(self, piece: str) -> list[int]:
        if (i := self.id.get(piece)) is not None:
            return [i]
        return [self.byte.get(b, self.unknown) for b in piece.encode()] if self.byte else [self.unknown]


def merged(text: str, score: dict[str, float]) -> list[str]:
    """The pieces of a short text by merging its best pair again and again, the first of equals."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Stream:
    """Ids of a normalised text, fed in parts of any size. found: ids committed between two boundaries that no
    piece crosses, by their text; shared by streams. commits: how often paths met and ids were settled before
    the text's end. held: the largest lattice."""

    STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def __init__(self, vocabulary: Vocabulary, pairs: dict[int, bool], found: "Found"):
        self.v, self.pairs, self.found = vocabulary, pairs, found
        self.waits = ""  # what may go on in the next part
        self.open = False  # whether its beginning is in the lattice
        self.commits = self.held = 0
        self._anew()

    def _anew(self) -> None:
        self.text = ""  # from the last committed boundary on
        self.last: list[int] = [-1]  # the last piece of the best path to each boundary; -1: none, or unknown
        self.size: list[int] = [0]  # and its length
        self.sum: list[float] = [0.0]

    def feed(self, more: str) -> Iterator[bytes]:
        """Takes in more text; yields little-endian unsigned 32-bit ids as they are settled."""
        more, self.waits = self.waits + more, ""
        if self.open:  # the stretch in the lattice goes on up to the next boundary that no piece crosses
            end = len(more) if self.v.spaced else self._crossed(more)
            yield from self._extended(more[:end])
            if end == len(more):
                return
            more = more[end:]
            self.open = False
            yield self._settled()
        stretches = [more] if self.v.spaced else self.STRETCH.findall(more)
        if not stretches:
            return
        self.waits = stretches.pop()
        ids = list(map(self.found.young.get, stretches))
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    ids[i] = self._stretch(stretches[i])
        self.commits += len(ids)
        yield b"".join(ids)
        if len(self.waits) > self.found.longest:
            text, self.waits, self.open = self.waits, "", True
            yield from self._extended(text)

    def close(self) -> Iterator[bytes]:
        if self.open:
            yield from self._extended(self.waits)
            yield self._settled()
        elif self.waits:
            yield self._stretch(self.waits)
        self.waits, self.open = "", False

    def _crossed(self, more: str) -> int:
        """How much of `more` belongs to the stretch in the lattice."""
        at, end = 0, len(more)
        if self.text.endswith(SPACE):
            while at < end and more[at] == SPACE:
                at += 1
        at = more.find(SPACE, at)
        return end if at < 0 else at

    def _stretch(self, text: str) -> bytes:
        """Ids of a whole stretch, which begins and ends where no piece crosses."""
        if (ids := self.found.get(text)) is None:
            ids = b"".join([*self._extended(text), self._settled()])
            self.found.add(text, ids)
        return ids

    def _settled(self) -> bytes:
        """The ids of all that is in the lattice, which is then empty."""
        done = self._commit(len(self.last) - 1)
        self._anew()
        return done

    def _extended(self, more: str) -> Iterator[bytes]:
        """Takes text into the lattice and commits where the paths meet."""
        longest, step = self.v.longest, 3 * self.v.longest
        for at in range(0, len(more), step):
            self.text += more[at : at + step]
            self._extend()
            self.held = max(self.held, len(self.last))
            if len(self.last) > 4 * longest and (done := self._meeting()):
                self.commits += 1
                yield self._commit(done)

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the text of both pieces gives just them."""
        if len(self.pairs) >= 1_200_000:
            self.pairs.clear()
        x, y = self.v.piece[a], self.v.piece[b]
        known = self.pairs[a << 20 | b] = merged(x + y, self.v.score) == [x, y]
        return known

    def _extend(self) -> None:
        """The best path to each boundary that has none yet."""
        text, last, size, longest, known = self.text, self.last, self.size, self.v.longest, self.v.id.get
        if self.v.kind == "bpe":
            pairs = self.pairs.get
            for end in range(len(last), len(text) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    piece = known(text[start:end])
                    if piece is None:
                        continue
                    old = last[start]
                    if old >= 0:
                        fits = pairs(old << 20 | piece)
                        if not (self._fits(old, piece) if fits is None else fits):
                            continue
                    last.append(piece)
                    size.append(end - start)
                    break
                else:  # no piece holds an unknown character, so none is merged with it
                    last.append(-1)
                    size.append(1)
            return
        total, least, score = self.sum, self.v.least, self.v.scores
        for end in range(len(last), len(text) + 1):
            best, from_, path = -1, end - 1, total[end - 1] + least
            first = known(text[end - 1 : end]) is not None
            for start in range(max(0, end - longest), end):
                piece = known(text[start:end])
                if piece is not None and (first or total[start] + score[piece] > path):
                    if best < 0 or total[start] + score[piece] > path:
                        best, from_, path = piece, start, total[start] + score[piece]
            last.append(best)
            size.append(end - from_)
            total.append(path)

    def _meeting(self) -> int:
        """The last boundary that all paths still open go through."""
        n = len(self.last) - 1
        at = set(range(max(0, n - self.v.longest + 1), n + 1))
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - self.size[far])
        return at.pop()

    def _commit(self, end: int) -> bytes:
        out, at = [], end
        while at:
            if self.last[at] >= 0:
                out.append(self.last[at])
            else:
                out += self.v.ids(self.text[at - 1])[::-1]
            at -= self.size[at]
        self.text = self.text[end:]
        self.last, self.size = self.last[end:], self.size[end:]  # the first is the last piece committed
        if self.v.kind == "unigram":
            base = self.sum[end]
            self.sum = [x - base for x in self.sum[end:]]
        return array("I", out[::-1]).tobytes()


class Found:
    """A cache of two generations: of at most 2 * `most` stretches of up to `longest` characters."""

    def __init__(self, most: int, longest: int):
        self.most, self.longest = most, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, text: str) -> bytes | None:
        if (ids := self.young.get(text)) is None and (ids := self.old.get(text)) is not None:
            self.add(text, ids)
        return ids

    def add(self, text: str, ids: bytes) -> None:
        if len(text) <= self.longest:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[text] = ids


class Codec:
    """Encodes and decodes whole texts with bounded memory besides the text."""

    GAP = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")

    def __init__(self, vocabulary: Vocabulary, cache: int = 800_000, longest: int = 48, step: int = 1 << 16):
        self.v, self.step = vocabulary, step
        self.pairs: dict[int, bool] = {}
        self.found = Found(cache, longest)
        normal = vocabulary.model.normalize
        self.parted = vocabulary.prefix and normal("a b1 2") == normal("a") + normal("b1 2")

    def stream(self) -> Stream:
        return Stream(self.v, self.pairs, self.found)

    def normalised(self, text: str) -> Iterator[str]:
        """The normalised text in parts of about `step` characters."""
        at, end = 0, len(text)
        while self.parted and end - at > self.step and (gap := self.GAP.search(text, at + self.step)):
            yield self.v.model.normalize(text[at : gap.start()])
            at = gap.end()  # the space comes back as the part's leading one
        yield self.v.model.normalize(text[at:] if at else text)

    def encoded(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids, as they are committed."""
        stream = self.stream()
        for part in self.normalised(text):
            yield from stream.feed(part)
        yield from stream.close()

    def encode(self, text: str) -> bytes:
        return b"".join(self.encoded(text))

    def shown(self, ids: bytes) -> bytes:
        """UTF-8 of some of a text's ids, with the leading space."""
        return b"".join(map(self.v.shown.__getitem__, array("I", ids)))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of a text's ids."""
        made = self.shown(ids)
        return made[1:] if self.v.prefix and made[:1] == b" " else made

    def checked(self, text: str) -> tuple[int, int, int, bool]:
        """UTF-8 bytes, number of ids, their CRC-32, and whether they decode to the text."""
        plain, count, check, same = text.encode(), 0, 0, True
        at = -1 if self.v.prefix else 0
        for ids in self.encoded(text):
            count, check = count + len(ids) // 4, zlib.crc32(ids, check)
            if same and ids:
                made = self.shown(ids)
                if at < 0:
                    made, at = (made[1:] if made[:1] == b" " else made), 0
                same = plain.startswith(made, at)
                at += len(made)
        return len(plain), count, check, same and max(at, 0) == len(plain)


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One for all tasks of a worker process, which so share its caches."""
    return Codec(Vocabulary(path))


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs (doc_id, text). vocabulary: a sentencepiece model file
    that every executor has at this path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for batch in by_bytes(batches, "text", 1 << 20):
            ids = [np.frombuffer(codec.encode(x or ""), dtype="<i4") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) for every row of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for batch in batches:
            made = [codec.decode(np.array(x or [], dtype="<u4").tobytes()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def coding(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row of SCHEMA per row of docs: the number of ids, their CRC-32, and whether they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for batch in by_bytes(batches, "text", 1 << 20):
            rows = [(d, *codec.checked(t or "")) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return texts(docs).mapInArrow(run, SCHEMA)


def op10_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return coding(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
