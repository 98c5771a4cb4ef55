"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens are words, lower-cased in ASCII, and an end for each text. The model predicts units: the end and the
most frequent words, each a unit of its own, and classes of all other words by their shape. A word's
probability is its unit's times its share of the unit's count in the corpus, with one added, so a text's
probabilities are normalised over all words, one unseen word of each class included, as in the base.

The model adds up the vectors of the last `order` units and the mean vector of all units before, each scaled
by a vector of its place, and compares the sum with vectors of what may follow (Mnih and Hinton, 2007). Units,
in order of their counts, form groups of `members`; a unit's probability is its group's times its own within
the group, each normalised exactly by batched matrix products (Mnih and Hinton, 2009), so thousands of units
cost what a hundred would. Groups and members are learnt by noise-contrastive estimation, the noise drawn from
the counts of groups and of members.

Training goes in rounds, each over all learning texts: these are dealt into `fraction` parts, and for one part
after the other each task fits a copy on its share, then the copies are averaged, weighted by tokens.

Counts cover all learning texts and grow with the corpus. At most the `head` most frequent words travel to the
tasks with their counts; all other words meet their counts in a join. Texts are read twice: for counts, and as
unit ids, from which the model learns and scores.

Defined cases: a null or empty text is the end alone. Rows without an id are scored but not learnt from, and
not held out. Repeated rows are learnt and scored as often as they occur. Other columns are ignored. An empty
table gives an empty result; without learning texts every word is unseen.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, table, texts

END = b"\n"  # no word holds it
CLASSES = 48
ENCODED = (
    "row long, doc_id long, held_out boolean, learn boolean, part int, n_tokens long, n_known long, base double, "
    "inner double, rare array<struct<word:binary,n:long>>, units binary"
)
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"


@dataclass(frozen=True)
class Shape:
    """words: those that are units of their own, the end included; up to 65,000. members: units in a group. noise: groups
    drawn for each batch of tokens; inner: members drawn in each group. rounds: how often all learning texts
    are trained on. fraction: the parts of a round, with an average after each. batch: tokens of a step.
    head: words at most whose counts travel to the tasks."""

    words: int = 2000
    members: int = 64
    size: int = 16
    order: int = 4
    noise: int = 32
    inner: int = 16
    rounds: int = 1
    fraction: int = 16
    rate: float = 0.25
    damping: float = 1e-2
    batch: int = 1024
    head: int = 1 << 18

    @property
    def groups(self) -> int:
        return -(-(self.words + CLASSES) // self.members)

    @property
    def units(self) -> int:
        """With those that fill the last group up, which never occur."""
        return self.groups * self.members

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        """Of context vectors, mean vectors, unit vectors, places, unit biases, group vectors and group biases."""
        table = (self.units, self.size)
        return [table, table, table, (self.order + 1, self.size), (self.units,), (self.groups, self.size), (self.groups,)]

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        return [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), self.shapes, strict=True)]


def word_class(word: bytes) -> int:
    """The class of a word that is no unit by itself: by length, last character and first non-ASCII one."""
    long = min(len(word) // 6, 2)
    last = 0 if word[-1:].isalnum() or word[-1] >= 128 else 1
    other = 0
    if not word.isascii():
        at = next(i for i, b in enumerate(word) if b >= 128)
        other = 1 + sum(word[at : at + 2]) % 7
    return (long * 2 + last) * 8 + other


def learning(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(False))


def word_codes(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, the end among them; one text after the other, its words' places there, with
    an end; how many these are for each text."""
    whole = pc.fill_null(column.cast(pa.large_string()), "").take(pa.array(range(len(column)), pa.int64()))  # ascii_lower goes wrong on slices
    split = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    found = split.flatten().dictionary_encode()
    words, codes = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
    text = np.repeat(np.arange(len(column)), split.value_lengths().to_numpy())
    end = found.dictionary.index("").as_py()
    if end < 0:
        end = len(words)
        words.append(END)
    else:  # space at either side of a text and an empty text give empty words
        words[end] = END
        keep = codes != end
        codes, text = codes[keep], text[keep]
    made = np.full(len(codes) + len(column), end, dtype=np.int64)
    made[np.arange(len(codes)) + text] = codes
    return words, made, np.bincount(text, minlength=len(column)) + 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all texts; each task adds up what it has before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in by_bytes(batches, "text", 1 << 22):
            words, codes, _ = word_codes(batch.column("text"))
            for word, n in zip(words, np.bincount(codes, minlength=len(words)).tolist(), strict=True):
                held[word] = held.get(word, 0) + n
            if len(held) > 500_000:
                yield told()
                held.clear()
        yield told()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


BLOCK = 32  # units of a text that share one mean


class Blocks:
    """A run of texts' units in blocks that begin anew with each text. before: how many units of its text are
    before each; of: each unit's block; starts: where the blocks begin; text: the first block of each one's text;
    cross: by text but the first, the units just before it, last to first."""

    def __init__(self, begin: np.ndarray, order: int = 0):
        n = len(begin)
        self.before = np.arange(n) - begin
        new = self.before % BLOCK == 0
        self.starts, self.of = np.flatnonzero(new), np.cumsum(new) - 1
        self.text = self.of[begin[self.starts]]
        self.seen = np.maximum(self.before[self.starts], 1).astype(np.float32)[:, None]
        later = self.starts[self.before[self.starts] == 0][1:]
        self.cross = np.maximum(later[:, None] - np.arange(1, order + 1), 0)

    def means(self, rows: np.ndarray) -> np.ndarray:
        """For each block the mean of its text's rows before it; zero for a text's first."""
        run = np.zeros((len(self.starts) + 1, rows.shape[1]))
        np.cumsum(np.add.reduceat(rows, self.starts, axis=0), axis=0, dtype=np.float64, out=run[1:])
        return (run[:-1] - run[self.text]).astype(np.float32) / self.seen

    def given_back(self, rows: np.ndarray) -> np.ndarray:
        """For each block what its units' rows in means() get, if each unit's mean gets a row of `rows`: the sums
        of all later blocks of its text."""
        run = np.zeros((len(self.starts) + 1, rows.shape[1]))
        np.cumsum(np.add.reduceat(rows, self.starts, axis=0) / self.seen, axis=0, dtype=np.float64, out=run[1:])
        last = np.append(np.flatnonzero(np.diff(self.text)), len(self.starts) - 1)
        end = last[np.searchsorted(last, np.arange(len(self.starts)))] + 1
        return (run[end] - run[1:]).astype(np.float32)


def context(tables: list[np.ndarray], ids: np.ndarray, begin: np.ndarray, order: int) -> tuple[np.ndarray, Blocks, np.ndarray, np.ndarray]:
    """For a run of texts' units: the predicted vectors, their blocks, the blocks' means, and the units' own
    context vectors. begin: where each unit's text begins."""
    near, mean, place = tables[0], tables[1], tables[3]
    n, blocks = len(ids), Blocks(begin, order)
    means = blocks.means(mean.take(ids, axis=0))
    made, held = (means * place[order]).take(blocks.of, axis=0), near.take(ids, axis=0)
    left = held.copy()
    for k in range(min(order, n - 1)):
        left[blocks.cross[:, k]] = 0  # the k + 1st after them is of another text
        made[k + 1 :] += left[: n - k - 1] * place[k]
    return made, blocks, means, held


def _log_sums(score: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logarithms of each row's sum of exponentials of score + bias; overwrites score. Rows are shifted by their
    largest sum only where one might leave what a float holds."""
    if max(-score.min(), score.max(), abs(bias.max())) < 40:
        np.exp(score, out=score)
        return np.log(score @ np.exp(bias))
    score += bias
    top = score.max(axis=1)
    score -= top[:, None]
    np.exp(score, out=score)
    return np.log(score.sum(axis=1)) + top


def log_probabilities(tables: list[np.ndarray], ids: np.ndarray, begin: np.ndarray, order: int) -> np.ndarray:
    """Natural logarithms of each unit's normalised probability given those before it in its text."""
    unit, bias, group, group_bias = tables[2], tables[4], tables[5], tables[6]
    members = len(unit) // len(group)
    out = np.empty(len(ids))
    if not len(ids):
        return out
    made = context(tables, ids, begin, order)[0]
    of = ids // members
    for i in range(0, len(ids), 4096):
        score, there = made[i : i + 4096] @ group.T, of[i : i + 4096]
        own = (score[np.arange(len(score)), there] + group_bias[there]).astype(np.float64)
        out[i : i + 4096] = own - _log_sums(score, group_bias)
    rank = np.argsort(of.astype(np.uint16), kind="stable")
    edges = np.flatnonzero(np.diff(of[rank], prepend=-1))
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(ids)).tolist(), strict=True):
        for i in range(a, b, 4096):
            some = rank[i : min(b, i + 4096)]
            low = of[some[0]] * members
            score, there = made.take(some, axis=0) @ unit[low : low + members].T, ids[some]
            own = (score[np.arange(len(some)), there - low] + bias[there]).astype(np.float64)
            out[some] += own - _log_sums(score, bias[low : low + members])
    return out


def _sigma(score: np.ndarray) -> np.ndarray:
    """The logistic function; overwrites score."""
    np.clip(score, -30, 30, out=score)
    np.negative(score, out=score)
    np.exp(score, out=score)
    score += 1
    return np.reciprocal(score, out=score)


def _added(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to those of `to` at `at`, repeats included."""
    flat = at[:, None] * to.shape[1] + np.arange(to.shape[1])
    np.add.at(to.reshape(-1), flat.ravel(), rows.ravel())


PAD = 32  # rows of a product within a group


class Trainer:
    """Noise-contrastive estimation with AdaGrad, of groups and of members within their group. The noise is
    drawn once for each batch of tokens, for the members once in each group."""

    def __init__(self, shape: Shape, tables: list[np.ndarray], share: np.ndarray, seed: int):
        self.shape, self.tables = shape, [x.astype(np.float32).copy() for x in tables]
        self.rng = np.random.default_rng(seed)
        self.square = [np.full(x.shape, shape.damping, dtype=np.float32) for x in self.tables]
        self.seen = 0
        by_group = share.reshape(shape.groups, shape.members)
        self.group_share = by_group.sum(axis=1)
        self.group_reach = np.cumsum(self.group_share, dtype=np.float64)
        self.group_reach /= self.group_reach[-1]
        inside = by_group / self.group_share[:, None]
        self.group_shift = np.log(shape.noise * self.group_share).astype(np.float32)
        self.shift = np.log(shape.inner * inside).astype(np.float32).ravel()
        self.reach = np.cumsum(inside, axis=1) + np.arange(shape.groups)[:, None]  # group g's lie in g to g + 1

    def members_drawn(self) -> np.ndarray:
        """(groups, inner): units drawn from each group's members by their shares."""
        s, low = self.shape, np.arange(self.shape.groups)[:, None]
        at = np.searchsorted(self.reach.ravel(), low + np.sort(self.rng.random((s.groups, s.inner)), axis=1))
        return np.clip(at, low * s.members, (low + 1) * s.members - 1)

    def step(self, ids: np.ndarray, begin: np.ndarray, drawn: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        s, (near, mean, unit, place, bias, group, group_bias) = self.shape, self.tables
        made, blocks, means, held = context(self.tables, ids, begin, s.order)
        noise, others = drawn or (np.searchsorted(self.group_reach, self.rng.random(s.noise), side="right"), self.members_drawn())
        n, rank = len(ids), np.argsort(ids.astype(np.uint16), kind="stable")  # by group too
        ranked = ids[rank]
        of = ranked // s.members
        back, rows = np.empty(n, dtype=np.int64), np.arange(n)
        back[rank] = rows

        # The last column is for the biases, the last row for places that no unit takes.
        wide = np.zeros((n + 1, s.size + 1), dtype=np.float32)
        wide[:n, : s.size], wide[:n, s.size] = made.take(rank, axis=0), 1
        made = np.ascontiguousarray(wide[:n, : s.size])

        # A group that is drawn several times is scored once and weighs as often.
        level = group_bias - self.group_shift
        often = np.bincount(noise, minlength=s.groups)
        some = np.flatnonzero(often)
        slopes = np.zeros((n, s.groups), dtype=np.float32)
        slopes[:, some] = _sigma(made @ group[some].T + level[some]) * -often[some].astype(np.float32)
        slopes[rows, of] += _sigma(-np.einsum("ij,ij->i", made, group.take(of, axis=0)) - level[of])
        slope = slopes @ group
        g_group = slopes.T @ wide[:n]
        g_group, g_group_bias = g_group[:, : s.size], g_group[:, s.size]

        # Each group's units stand in blocks of PAD rows, so that one batched product scores all groups.
        size = np.bincount(of, minlength=s.groups)
        filled = -(-size // PAD)
        first = np.cumsum(filled) - filled
        at = rows + (first * PAD - np.cumsum(size) + size)[of]
        taken = np.full(int(filled.sum()) * PAD, n)
        taken[at] = rows
        block_group = np.repeat(np.arange(s.groups), filled)
        packed = wide.take(taken, axis=0).reshape(-1, PAD, s.size + 1)
        level = bias - self.shift
        far = np.concatenate([unit[others], level[others][:, :, None]], axis=2).take(block_group, axis=0)
        own = unit.take(ranked, axis=0)
        d_good = _sigma(-np.einsum("ij,ij->i", made, own) - level[ranked])
        d_bad = _sigma(packed @ far.transpose(0, 2, 1))
        slope -= (d_bad @ far[:, :, : s.size]).reshape(-1, s.size).take(at, axis=0)
        own *= d_good[:, None]
        slope += own
        g_unit, g_bias = np.zeros_like(unit), np.bincount(ranked, d_good, s.units)
        g_far, drawn_from = d_bad.transpose(0, 2, 1) @ packed, others.take(block_group, axis=0).ravel()
        _added(g_unit, drawn_from, -g_far[:, :, : s.size])
        g_bias -= np.bincount(drawn_from, g_far[:, :, s.size].ravel(), s.units)
        made *= d_good[:, None]
        _added(g_unit, ranked, made)

        # The slopes go on to what made the predictions: the units before, and the means of all of them.
        d_made = slope.take(back, axis=0)
        g_place, d_near, one = np.zeros_like(place), np.zeros_like(held), np.ones(n, dtype=np.float32)
        for k in range(min(s.order, n - 1)):
            held[blocks.cross[:, k]] = 0
            g_place[k] = one[k + 1 :] @ (d_made[k + 1 :] * held[: n - k - 1])
        for k in reversed(range(min(s.order, n - 1))):
            d_near[: n - k - 1] += d_made[k + 1 :] * place[k]
            d_near[blocks.cross[:, : k + 1]] = 0
        g_place[s.order] = np.einsum("ij,ij->j", np.add.reduceat(d_made, blocks.starts, axis=0), means)
        d_mean = blocks.given_back(d_made) * place[s.order]
        new = np.diff(ranked, prepend=-1) > 0
        touched, of = ranked[new], (np.cumsum(new) - 1)[back]
        g_near, g_mean = np.zeros((2, len(touched), s.size), dtype=np.float32)
        _added(g_near, of, d_near)
        _added(g_mean, of, d_mean.take(blocks.of, axis=0))

        # Units that don't occur have no slopes in the first two tables.
        slopes = (g_near, g_mean, g_unit, g_place, g_bias.astype(np.float32), g_group, g_group_bias)
        for t, g in enumerate(slopes):
            x, q = self.tables[t], self.square[t]
            g *= np.float32(1 / n)
            if t < 2:
                now = q.take(touched, axis=0) + g * g
                q[touched] = now
            else:
                q += g * g
                now = q
            g *= np.float32(s.rate)
            g /= np.sqrt(now)
            if t < 2:
                x[touched] += g
            else:
                x += g
        self.seen += n


class Words:
    """What a task knows of words: the head's places, and each place's unit and logarithms. classes: each class's
    unit. unit: that of each of the first `single` words."""

    def __init__(self, words: list[bytes], counts: np.ndarray, unit: np.ndarray, classes: np.ndarray, total: int, distinct: int, class_sums: np.ndarray):
        self.place = {w: i for i, w in enumerate(words)}
        single = len(unit)
        kind = np.array([word_class(w) for w in words[single:]], dtype=np.int64)
        self.classes = classes
        self.unit = np.concatenate([unit, classes[kind]])
        self.base_floor = np.log10(total + distinct + 1.0)
        self.class_floor = np.log10(class_sums[:, 0] + class_sums[:, 1] + 1.0)
        self.base = np.log10(counts + 1.0) - self.base_floor
        self.inner = np.concatenate([np.zeros(single), np.log10(counts[single:] + 1.0) - self.class_floor[kind]])

    def coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words: units, places (-1 beyond the head), base logarithms, and logarithms within the unit; of
        words beyond the head the latter two lack that of the count with one added."""
        place = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        unit, base, inner = self.unit[place], self.base[place], self.inner[place]
        far = np.flatnonzero(place < 0)
        kind = np.fromiter((word_class(words[i]) for i in far), dtype=np.int64, count=len(far))
        unit[far], base[far], inner[far] = self.classes[kind], -self.base_floor, -self.class_floor[kind]
        return unit, place, base, inner


_held: dict[str, Words] = {}


def words_of(name: str, *given) -> Words:
    """One for all tasks of a worker process."""
    if name not in _held:
        _held.clear()
        _held[name] = Words(*given)
    return _held[name]


def head_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, by count, then word: all from a count on that at most `most`
    reach. Counts are first counted in steps of a 64th of a doubling, so one small table meets the driver."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    left, least = most, None
    for at, n in counts.groupBy(step.alias("at")).agg(F.count("*")).orderBy(F.desc("at")).collect():
        if n > left:
            break
        left, least = left - n, at
    if least is None:
        return []
    rows = counts.filter(step >= least).toArrow()
    return sorted(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def score_texts(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    spark = docs.sparkSession
    rows = texts(docs)
    counts = cut(word_counts(rows.filter(learning(F.col("doc_id")))), "counts")
    total, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())

    # The end is a unit in any case.
    found = dict(head_words(counts, shape.head))
    end = found.pop(END, None) or (counts.filter(F.col("word") == F.lit(bytearray(END))).agg(F.max("n")).first()[0] or 0)
    words, numbers = [END, *found], np.array([end, *found.values()], dtype=np.float64)
    single = min(len(words), shape.words)
    own = set(words[:single])

    def class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES, 2), dtype=np.int64)
        for batch in batches:
            for w, n in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns), strict=True):
                if w not in own:
                    sums[word_class(w)] += (n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["class", "n", "words"])

    class_sums = np.zeros((CLASSES, 2), dtype=np.int64)
    for c, n, v in counts.mapInArrow(class_rows, "class int, n long, words long").groupBy("class").agg(F.sum("n"), F.sum("words")).collect():
        class_sums[c] = n, v

    # Units in order of their counts; those that stand for nothing come last.
    share = np.zeros(shape.units)
    share[:single] = numbers[:single] + 1
    share[single : single + CLASSES] = class_sums[:, 0] + 1
    order = np.argsort(-share, kind="stable")
    unit = np.empty(shape.units, dtype=np.int64)
    unit[order] = np.arange(shape.units)
    share = np.maximum(share[order], 0.01)
    share /= share.sum()

    name = uuid.uuid4().hex
    known = spark.sparkContext.broadcast((words, numbers, unit[:single], unit[single : single + CLASSES], total, distinct, class_sums))  # `head` words at most
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out")
    part = F.coalesce(F.crc32(F.concat(F.lit("round "), F.col("doc_id").cast("string")).cast("binary")) % shape.fraction, F.lit(0)).cast("int")
    own_rows = rows.select("doc_id", "text", held_out, learning(F.col("doc_id")).alias("learn"), part.alias("part"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = words_of(name, *known.value)
        row = TaskContext.get().partitionId() << 40
        for batch in by_bytes(batches, "text", 1 << 21):
            distinct_words, codes, sizes = word_codes(batch.column("text"))
            unit, place, base, inner = lexicon.coded(distinct_words)
            seen = ((place >= 0) & (known.value[1][place] > 0)).astype(np.int64)
            ids = unit.astype("<u2")[codes].tobytes()
            edge = np.cumsum(sizes) - sizes
            far, rare, often, ends = np.flatnonzero((place < 0)[codes]), [], [], [0]
            for lo, hi in zip(np.searchsorted(far, edge).tolist(), np.searchsorted(far, edge + sizes).tolist(), strict=True):
                found = Counter(codes[far[lo:hi]].tolist())
                rare += (distinct_words[c] for c in found)
                often += found.values()
                ends.append(len(rare))
            rare = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(often, pa.int64())], ["word", "n"])
            columns = [
                pa.array(range(row, row + batch.num_rows), pa.int64()),
                *(batch.column(c) for c in ("doc_id", "held_out", "learn", "part")),
                pa.array(sizes, pa.int64()),
                *(pa.array(np.add.reduceat(x[codes], edge)) for x in (seen, base, inner)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare),
                pa.array([ids[2 * lo : 2 * (lo + n)] for lo, n in zip(edge.tolist(), sizes.tolist(), strict=True)], pa.binary()),
            ]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ENCODED.split(", ")])

    encoded = cut(own_rows.mapInArrow(encode, ENCODED), "encoded")
    tables = fit(encoded.filter("learn").select("part", "units"), share, shape)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "units", 1 << 17):
            sizes = batch.column("n_tokens").to_numpy()
            edge = np.cumsum(sizes) - sizes
            ids = np.frombuffer(b"".join(batch.column("units").to_pylist()), dtype="<u2").astype(np.int64)
            made = log_probabilities(tables, ids, np.repeat(edge, sizes), shape.order) / np.log(10)
            model = np.add.reduceat(made, edge) + batch.column("inner").to_numpy()
            names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(model)], [*names, "model"])

    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "units").mapInArrow(score, SCORED)

    # A rare word's share is (count + 1) over the floor already taken; of unseen words the count is 0.
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("tf"))
    more = rare.join(counts, "word").groupBy("row").agg(F.sum("tf").alias("known"), F.sum(F.col("tf") * F.log10(F.col("n") + F.lit(1.0))).alias("gain"))
    known_more, gain = F.coalesce("known", F.lit(0)), F.coalesce("gain", F.lit(0.0))
    return scored.join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + known_more).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"),
        (F.col("model") + gain).alias("score"),
    )


def fitted(trainer: Trainer, texts_units: Iterator[np.ndarray]) -> None:
    """Takes the trainer through texts, in batches; a very long text's parts begin anew."""
    shape = trainer.shape
    held, size = [], 0

    def step() -> None:
        sizes = np.array([len(x) for x in held])
        trainer.step(np.concatenate(held), np.repeat(np.cumsum(sizes) - sizes, sizes))
        held.clear()

    for unit in texts_units:
        for i in range(0, len(unit), shape.batch):
            held.append(unit[i : i + shape.batch])
            size += len(held[-1])
            if size >= shape.batch:
                step()
                size = 0
    if held:
        step()


def fit(learn: DataFrame, share: np.ndarray, shape: Shape, together: int = 64, slices: int = 8) -> list[np.ndarray]:
    """The model's tables after all rounds. learn: part, units. Copies are added up by slices of their numbers,
    first `together` tasks', then all; what reaches the driver is one model, whatever the corpus."""
    rng = np.random.default_rng(11)
    tables = [rng.normal(0, 0.1, s).astype(np.float32) for s in shape.shapes]
    tables[3][:] = 1.0
    tables[4][:] = np.log(share)
    tables[6][:] = np.log(share.reshape(shape.groups, shape.members).sum(axis=1))

    def added(table: pa.Table) -> tuple[int, bytes]:
        made = sum(np.frombuffer(x, dtype="<f8") for x in table.column("made").to_pylist())
        return sum(table.column("n").to_pylist()), made.tobytes()

    def some(key: tuple, table: pa.Table) -> pa.Table:
        n, made = added(table)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "made": pa.array([made], pa.binary())})

    for turn in range(shape.rounds * shape.fraction):
        start = tables

        def train(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            trainer = Trainer(shape, start, share, (turn << 32) + task)
            fitted(trainer, (np.frombuffer(x, dtype="<u2").astype(np.int64) for batch in batches for x in batch.column("units").to_pylist()))
            if trainer.seen:
                flat = np.concatenate([x.ravel() for x in trainer.tables]).astype("<f8") * trainer.seen
                parts = [x.tobytes() for x in np.array_split(flat, slices)]
                columns = [pa.array(range(slices), pa.int32()), pa.array([task // together] * slices, pa.int64()), pa.array([trainer.seen] * slices, pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "block", "n", "made"])

        chosen = learn.filter(F.col("part") == turn % shape.fraction).select("units")
        made = chosen.mapInArrow(train, "slice int, block long, n long, made binary")
        made = made.groupBy("slice", "block").applyInArrow(some, "slice int, n long, made binary")
        made = made.groupBy("slice").applyInArrow(some, "slice int, n long, made binary").toArrow().sort_by("slice")
        if made.num_rows:
            flat = np.concatenate([np.frombuffer(x, dtype="<f8") for x in made.column("made").to_pylist()])
            tables = [x.astype(np.float32) for x in shape.split(flat / made.column("n")[0].as_py())]
    return tables


def op3_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
