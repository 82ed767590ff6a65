"""The language model against brute force: exact base scores, gradients against differences, and a plain forward pass of each document."""

import math
import timeit
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import language_model, recurrent, registry
from lexigrid.llm.common import words

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    rows = {r.doc_id: r for r in registry.QUERIES["op7_language_model"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    split = {k: [*words(t), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    c = Counter(w for k, ws in split.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in split.items():
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9) and r.score < 0
    out = [k for k in rows if held[k]]
    assert sum(rows[k].score for k in out) > sum(rows[k].base_score for k in out)


def network(size=60):
    net = recurrent.Network(np.arange(size)[::-1] + 1.0)
    rng = np.random.default_rng(3)
    net.weights = [w.astype(np.float64) + 0.3 * rng.standard_normal(w.shape) for w in net.weights]
    return net


def documents(size=60):
    rng = np.random.default_rng(1)
    return [np.append(rng.integers(2, size, n), recurrent.END).astype(np.int32) for n in (40, 3, 1, 0, 57)]


def plain(net, ids):
    """Word by word, with the outcomes' whole distribution written out."""
    table, gates, own, cw, cb, ww, wb = net.weights
    sigmoid, k = lambda x: 1 / (1 + math.e**-x), recurrent.HIDDEN
    soft = lambda x: np.exp(x) / np.exp(x).sum()
    h, given, total = np.zeros(k), net.start, 0.0
    for y in ids:
        a = table[given]
        g = sigmoid(a[: 2 * k] + h @ gates)
        c = np.tanh(a[2 * k :] + (g[k:] * h) @ own)
        h = (1 - g[:k]) * h + g[:k] * c
        of_class = soft(h @ cw + cb)
        p = np.concatenate([of_class[i] * soft(ww[x:z] @ h + wb[x:z]) for i, (x, z) in enumerate(zip(net.edges[:-1], net.edges[1:], strict=True))])
        assert p.sum() == pytest.approx(1)
        total += math.log(p[y])
        given = y
    return total


def test_plain_forward_pass():
    """Also: the state is carried over windows, and documents side by side don't touch each other."""
    net, docs = network(), documents()
    assert np.allclose(recurrent.scored(net, docs), [plain(net, d) for d in docs], rtol=1e-9)
    assert recurrent.scored(net, []).tolist() == []


def test_gradients_against_differences():
    net, docs = network(), documents()
    target = np.concatenate(docs)[:96].astype(np.int32)
    given, fresh = recurrent._given(net, target, np.cumsum([0] + [len(d) for d in docs[:-1]]))
    shape = lambda x: x.reshape(6, 16).T
    real = shape(np.arange(96) < 90)
    h = np.random.default_rng(2).standard_normal((6, recurrent.HIDDEN)) * 0.3
    loss = lambda: -net.window(h, shape(given), shape(fresh), shape(target), real, False)[1].sum()
    grads = net.window(h, shape(given), shape(fresh), shape(target), real, True)[2]
    rng = np.random.default_rng(4)
    for w, (at, g) in zip(net.weights, grads, strict=True):
        whole = np.zeros_like(w)
        whole[at] = g
        for _ in range(25):
            i = tuple(rng.integers(0, s) for s in w.shape)
            w[i] += 1e-6
            up = loss()
            w[i] -= 2e-6
            down = loss()
            w[i] += 1e-6
            assert whole[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("short", [False, True])
def test_sums_of_groups(short):
    """Long groups and short ones, whatever their order."""
    rng = np.random.default_rng(5)
    count = rng.integers(1, recurrent.LONG + 1 if short else 60, 80)
    first, rows = np.cumsum(count) - count, rng.standard_normal((count.sum(), 7))
    assert np.allclose(recurrent._sums(rows, first), np.add.reduceat(rows, first, axis=0))


def test_sums_are_cheap():
    """The sums of a window's gradients by word, of words as frequent as in text, take less time than reduceat's."""
    ids = np.sort(np.random.default_rng(6).zipf(1.3, recurrent.STREAMS * recurrent.STEPS) % 10_000)
    first, rows = np.flatnonzero(np.diff(ids, prepend=-1)), np.ones((len(ids), 3 * recurrent.HIDDEN), np.float32)
    own, plain_ = (min(timeit.repeat(f, number=1, repeat=30)) for f in (lambda: recurrent._sums(rows, first), lambda: np.add.reduceat(rows, first, axis=0)))
    assert own < 0.9 * plain_


def test_training_learns():
    net = recurrent.Network(np.ones(60))
    docs = [np.array([*([5, 9, 30] * 10), recurrent.END], np.int32)] * 20
    before = recurrent.scored(net, docs[:1])[0]
    for _ in range(60):
        recurrent.taught(net, docs)
    assert recurrent.scored(net, docs[:1])[0] > before / 4


def test_scores_do_not_depend_on_splits(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD", 20_000)
    monkeypatch.setattr(language_model, "PER_OUTCOME", 1)
    monkeypatch.setattr(language_model, "FAN_IN", 2)
    monkeypatch.setattr(language_model, "PIECE", 1 << 16)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a, b = ({r.doc_id: r.score for r in language_model.score(docs.repartition(n, "doc_id"), F.col("doc_id") % 7 == 2).collect()} for n in (1, 5))
    assert a == pytest.approx(b, rel=1e-4)


def test_rare_words_are_joined(spark, monkeypatch):
    """Base scores stay exact where the list of frequent words is short, ends within a count, or words are long."""
    monkeypatch.setattr(language_model, "FREQUENT", 5)
    rows = [(k, f"a b c d e {'x' * 100} f{k} f{k // 2}") for k in range(40)] + [(100, f"a f3 zz {'x' * 100} " + "y" * 100)]
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    c = Counter(w for k, t in rows if k < 100 for w in [*t.split(), None])
    n, v = sum(c.values()), len(c)
    for k, t in rows:
        ws = [*t.split(), None]
        assert got[k].n_known == sum(c[w] > 0 for w in ws)
        assert got[k].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)


def test_vocabulary_grows(spark):
    """Of 1,000 words, each often enough, the network tells also the last ones apart: another order has another score."""
    w = [f"w{k:04d}" for k in range(1000)]
    rows = [(k, " ".join(w)) for k in range(400)] + [(1000, "w0990 w0999 w0995"), (1001, "w0999 w0995 w0990")]
    got = {r.doc_id: r.score for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 1000).collect()}
    assert abs(got[1000] - got[1001]) > 1e-6
