import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lodestone.llm import language_model as lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def base(rows):
    learn = Counter(t for d, x in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for t in tokens(x))
    n, v = sum(learn.values()), len(learn)
    out = []
    for d, x in rows:
        ts = tokens(x)
        out.append((str(d), d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(ts), sum(learn[t] > 0 for t in ts), n, sum(math.log10((learn[t] + 1) / (n + v + 1)) for t in ts)))
    return sorted(out, key=lambda r: (r[0], r[5]))


@pytest.mark.parametrize("head", [5, 1 << 18])
def test_base_equals_a_plain_count(odd_docs, no_docs, documents, head):
    shape = lm.Shape(words=4, rounds=1, fraction=1, head=head)
    for docs in (odd_docs, documents.limit(80)):
        want = base([(r.doc_id, r.text) for r in docs.collect()])
        rows = sorted(lm.score_texts(docs, shape).collect(), key=lambda r: (str(r.doc_id), r.base_score))
        assert [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [x[:5] for x in want]
        assert [r.base_score for r in rows] == pytest.approx([x[5] for x in want], rel=1e-9)
    assert lm.score_texts(no_docs, shape).count() == 0


def test_probabilities_are_normalised():
    shape, rng = lm.Shape(words=6, size=5), np.random.default_rng(0)
    tables = [rng.normal(0, 0.5, s).astype(np.float32) for s in shape.shapes]
    ids = rng.integers(0, shape.units, 9)
    for last in range(9):
        total = 0.0
        for u in range(shape.units):
            ids[last] = u
            total += math.exp(lm.log_probabilities(tables, ids, np.zeros(9, dtype=np.int64), shape.order)[last])
        assert total == pytest.approx(1, abs=1e-4)


def test_gradients_are_those_of_the_objective():
    shape, rng = lm.Shape(words=4, size=3, noise=5, inner=3, members=8, rate=1.0), np.random.default_rng(1)
    share = rng.dirichlet(np.ones(shape.units))
    tables = [rng.normal(0, 0.5, s) for s in shape.shapes]
    ids, begin = rng.integers(0, shape.units, 12), np.repeat([0, 7], [7, 5])
    noise, others = rng.integers(0, shape.groups, 5), np.arange(shape.groups)[:, None] * 8 + np.array([rng.permutation(8)[:3] for _ in range(shape.groups)])
    by_group = share.reshape(shape.groups, 8)
    group_shift = np.log(shape.noise * by_group.sum(1))
    shift = np.log(shape.inner * by_group / by_group.sum(1)[:, None]).ravel()

    def objective(tables):
        made = lm.context(tables, ids, begin, shape.order)[0]
        of = ids // 8
        parts = [
            ((made * tables[5][of]).sum(1) + (tables[6] - group_shift)[of], made @ tables[5][noise].T + (tables[6] - group_shift)[noise]),
            ((made * tables[2][ids]).sum(1) + (tables[4] - shift)[ids], np.einsum("ij,ikj->ik", made, tables[2][others[of]]) + (tables[4] - shift)[others[of]]),
        ]
        return sum(-np.log1p(np.exp(-good)).sum() - np.log1p(np.exp(bad)).sum() for good, bad in parts) / len(ids)

    trainer = lm.Trainer(shape, tables, share, 3)
    trainer.square = [np.full_like(x, 1e-12) for x in trainer.square]
    start = [x.copy() for x in trainer.tables]
    trainer.step(ids, begin, (noise, others))
    for t in range(7):
        for at in list(np.ndindex(tables[t].shape))[:: max(1, tables[t].size // 25)]:
            moved = [x.copy() for x in tables]
            moved[t][at] += 1e-3
            up = objective(moved)
            moved[t][at] -= 2e-3
            slope = (up - objective(moved)) / 2e-3
            assert math.sqrt(trainer.square[t][at]) == pytest.approx(abs(slope), rel=0.05, abs=2e-3)
            if abs(slope) > 1e-2:
                assert (trainer.tables[t][at] > start[t][at]) == (slope > 0)


def test_members_are_drawn_by_their_shares():
    shape = lm.Shape(words=4, members=8, inner=4)
    share = np.random.default_rng(1).dirichlet(np.ones(shape.units))
    trainer = lm.Trainer(shape, [np.zeros(s) for s in shape.shapes], share, 3)
    drawn = np.concatenate([trainer.members_drawn() for _ in range(4000)], axis=1)
    for g in range(shape.groups):
        part = share[8 * g : 8 * g + 8]
        assert np.bincount(drawn[g], minlength=shape.units)[8 * g : 8 * g + 8] / drawn.shape[1] == pytest.approx(part / part.sum(), abs=0.02)
        assert (drawn[g] // 8 == g).all()


def test_head_words_fit_the_bound(spark):
    rows = [(bytes([97 + i % 26, 97 + i // 26]), 1 + i // 3) for i in range(400)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    for most in (0, 2, 30, 500):
        found = lm.head_words(counts, most)
        assert len(found) <= most and len(found) >= min(most, 400) - 30
        assert found == sorted(rows, key=lambda x: (-x[1], x[0]))[: len(found)]


def test_held_out_texts_are_predicted_better_than_by_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm.score_texts(docs, lm.Shape(fraction=1, rounds=3)).collect() if r.held_out]
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.1


def test_registered_shape_learns_from_all_texts(spark):
    shape, docs = lm.Shape(), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm.score_texts(docs, shape).collect() if r.held_out]
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.1  # 0.03 from 2 parts of 16


def plain_slopes(shape, tables, share, texts, noise, others):
    """The slopes of a step, unit by unit."""
    near, mean, unit, place, bias, group, group_bias = (x.astype(float) for x in tables)
    got = [np.zeros(x.shape) for x in tables]
    by_group = share.reshape(shape.groups, shape.members)
    group_shift = np.log(shape.noise * by_group.sum(1))
    shift = np.log(shape.inner * by_group / by_group.sum(1)[:, None]).ravel()
    for t in texts:
        for i, u in enumerate(t):
            g, old = u // shape.members, t[: i // lm.BLOCK * lm.BLOCK]
            last = [(k, t[i - 1 - k]) for k in range(shape.order) if i > k]
            means = mean[old].mean(0) if len(old) else np.zeros(shape.size)
            made = sum((place[k] * near[v] for k, v in last), place[shape.order] * means)
            pairs = [(5, g, 1), *((5, q, -1) for q in noise), (2, u, 1), *((2, v, -1) for v in others[g])]
            back = np.zeros(shape.size)
            for table, at, sign in pairs:
                rows, low = (group, group_bias - group_shift) if table == 5 else (unit, bias - shift)
                d = sign / (1 + np.exp(sign * (made @ rows[at] + low[at])))
                back += d * rows[at]
                got[table][at] += d * made
                got[6 if table == 5 else 4][at] += d
            for k, v in last:
                got[0][v] += back * place[k]
                got[3][k] += back * near[v]
            got[3][shape.order] += back * means
            for v in old:
                got[1][v] += back * place[shape.order] / len(old)
    return [x / sum(map(len, texts)) for x in got]


@pytest.mark.parametrize("sizes", [(1,), (1, 1, 2, 3, 70, 5, 40), (1,) * 9, (100,)])
def test_a_step_has_the_slopes_of_a_plain_sum(sizes):
    shape, rng = lm.Shape(words=4, size=3, noise=9, inner=5, members=8, rate=1.0), np.random.default_rng(len(sizes))
    share = rng.dirichlet(np.ones(shape.units))
    tables = [rng.normal(0, 0.5, s) for s in shape.shapes]
    texts = [rng.integers(0, shape.units // 2, n).tolist() for n in sizes]
    noise, others = rng.integers(0, 3, 9), np.arange(shape.groups)[:, None] * 8 + rng.integers(0, 8, (shape.groups, 5))
    trainer = lm.Trainer(shape, tables, share, 3)
    trainer.square = [np.full_like(x, 1e-20) for x in trainer.square]
    start = [x.copy() for x in trainer.tables]
    trainer.step(np.concatenate(texts), np.repeat(np.cumsum(sizes) - sizes, sizes), (noise, others))
    for x, old, q, want in zip(trainer.tables, start, trainer.square, plain_slopes(shape, tables, share, texts, noise, others), strict=True):
        assert np.sqrt(q) == pytest.approx(np.abs(want), rel=1e-3, abs=1e-6)
        far = np.abs(want) > 1e-5
        assert (np.sign(x - old) == np.sign(want))[far].all()


def test_a_group_drawn_again_is_not_scored_again(monkeypatch):
    shape, rng, done = lm.Shape(), np.random.default_rng(2), []
    trainer = lm.Trainer(shape, [rng.normal(0, 0.1, s) for s in shape.shapes], np.full(shape.units, 1 / shape.units), 3)
    exp = np.exp
    monkeypatch.setattr(np, "exp", lambda x, **given: (done.append(x.size), exp(x, **given))[1])
    n = 2048
    trainer.step(rng.integers(0, shape.units, n), np.zeros(n, dtype=np.int64), (np.zeros(shape.noise, dtype=np.int64), trainer.members_drawn()))
    assert sum(done) < n * (shape.noise + shape.inner)  # one group, the own ones, members in padded blocks


@pytest.mark.parametrize("reach", [1, 30, 300])
def test_sums_of_exponentials_of_any_size(reach):
    rng = np.random.default_rng(reach)
    score, bias = rng.normal(0, reach, (50, 7)).astype(np.float32), rng.normal(0, 5, 7).astype(np.float32)
    want = np.logaddexp.reduce(score.astype(float) + bias, axis=1)
    assert lm._log_sums(score, bias) == pytest.approx(want, rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("rows", [[""], [None], ["a"], [" A b\x0b\x0cA  ", "", None, "\n", "a\x1cB\u00a0c \u0130x \u00c9 \r\tb", "b b b"], ["x y", "Y"]])
def test_words_of_a_batch_are_coded_once(rows):
    words, codes, sizes = lm.word_codes(pa.array(["-", *rows], pa.string())[1:])
    assert len(set(words)) == len(words) == len(set(codes.tolist()))
    assert [words[c].decode() for c in codes] == [t for x in rows for t in tokens(x)]
    assert sizes.tolist() == [len(tokens(x)) for x in rows]
