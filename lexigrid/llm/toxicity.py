"""Toxicity: a linear classifier over character n-grams, each scaled by its naive Bayes log-count ratio."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import released, table

SIZES = (3, 4, 5, 6, 8)
BITS = 20
#: The bound of what is learnt from: labelled rows of each class.
MAX_PER_CLASS = 3000
#: Texts of the sample that an n-gram occurs in at least; standard errors at which a log-count ratio counts whole.
LEAST, WHOLE = 3, 4.0
PARTS = 6
#: Features of the sample that the fit handles at a time.
CHUNK = 1 << 21


def gram_cells(text: str | None) -> np.ndarray:
    """The hash cells of all n-grams of characters (code points of the lower-cased whole text, blanks collapsed), as often as they occur."""
    plain = " " + " ".join(text.lower().split()) + " " if text else ""
    data = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [np.zeros(0, np.uint32)], data
    for n in range(2, max(SIZES) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint32(16777619) + data[n - 1 :] + np.uint32(n)
        if n in SIZES:
            out.append((h * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition: how many texts of each class have each cell."""
    seen, docs = np.zeros((2, 1 << BITS), np.int32), [0, 0]
    for batch in batches:
        for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
            docs[y] += 1
            seen[y, np.unique(gram_cells(text))] += 1
    cell = np.flatnonzero(seen.any(axis=0)).astype(np.int32)
    yield pa.record_batch({"cell": pa.array([cell.tobytes()], pa.binary()), "n": pa.array([seen[:, cell].tobytes()], pa.binary()), "neg": [docs[0]], "pos": [docs[1]]})


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all counts each cell's naive Bayes log-count ratio, less where it is within WHOLE standard errors of 0; 0 for rare cells."""
    df, docs = np.zeros((2, 1 << BITS), np.int32), [0, 0]
    for batch in batches:
        for cell, n, neg, pos in zip(*(batch[k].to_pylist() for k in ("cell", "n", "neg", "pos")), strict=True):
            df[:, np.frombuffer(cell, np.int32)] += np.frombuffer(n, np.int32).reshape(2, -1)
            docs[0], docs[1] = docs[0] + neg, docs[1] + pos
    yield pa.record_batch({"ratio": pa.array([scaled_ratios(df, docs).tobytes()], pa.binary())})


def scaled_ratios(df: np.ndarray, docs: list[int]) -> np.ndarray:
    p, q = df[1] + 0.5, df[0] + 0.5
    ratio = np.log(p / (docs[1] + 1)) - np.log(q / (docs[0] + 1))
    ratio *= np.minimum(1, np.abs(ratio) / np.sqrt(1 / p + 1 / q) / WHOLE)
    return np.where(df.sum(axis=0) >= LEAST, ratio, 0).astype(np.float32)


class Sample:
    """Texts as rows of ascending cells: products with a vector of cells, and back, CHUNK features at a time.

    Held as the cells' low 16 bits, and how many of each row have each value of the high ones: two bytes a feature.
    """

    def __init__(self, rows: Iterable[np.ndarray], lengths: np.ndarray) -> None:
        self.ends, high = np.concatenate([[0], np.cumsum(lengths)]), 1 << (BITS - 16)
        self.low, self.parts = np.empty(self.ends[-1], np.uint16), np.zeros((len(lengths), high), np.int32)
        for k, r in enumerate(rows):
            self.low[self.ends[k] : self.ends[k + 1]] = r & 0xFFFF
            self.parts[k] = np.bincount(r >> 16, minlength=high)
        cuts = np.searchsorted(self.ends, np.arange(CHUNK, self.ends[-1] + CHUNK, CHUNK), side="right") - 1
        self.cuts = np.unique(np.concatenate([[0], cuts, [len(lengths)]]))

    def _cells(self, a: int, b: int) -> np.ndarray:
        high = np.tile(np.arange(self.parts.shape[1], dtype=np.int32) << 16, b - a)
        return np.repeat(high, self.parts[a:b].ravel()) + self.low[self.ends[a] : self.ends[b]]

    def sums(self, v: np.ndarray) -> np.ndarray:
        """Each row's sum of v over its cells."""
        out, full = np.zeros(len(self.ends) - 1), np.diff(self.ends) > 0
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            if (some := np.flatnonzero(full[a:b]) + a).size:
                out[some] = np.add.reduceat(v.take(self._cells(a, b)), self.ends[some] - self.ends[a])
        return out

    def back(self, e: np.ndarray) -> np.ndarray:
        """Each cell's sum of e over the rows that have it."""
        out, size = np.zeros(1 << BITS), np.diff(self.ends)
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            out += np.bincount(self._cells(a, b), weights=np.repeat(e[a:b], size[a:b]), minlength=1 << BITS)
        return out.astype(np.float32)


def fit(sample: Sample, y: np.ndarray, ratio: np.ndarray, l2: float = 1.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """(weights of cells, bias): logistic regression over features ratio * presence, both classes of one weight, by limited-memory BFGS."""
    n = len(y)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(sample.sums(x[:-1] * ratio) + x[-1], -50, 50)
        e = weight * (1 / (1 + np.exp(-z)) - y)
        value = float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * l2 * (x[:-1] @ x[:-1]) / n)
        return value, np.append(sample.back(e) * ratio + x[:-1] * np.float32(l2 / n), np.float32(e.sum()))

    x, past = np.zeros(len(ratio) + 1, np.float32), []
    value, g = loss(x)
    for _ in range(steps):
        d, kept = -g, []
        for s, u in reversed(past):
            kept.append((s @ d) / (u @ s))
            d = d - kept[-1] * u
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.float32(1), np.sqrt(g @ g))
        for (s, u), k in zip(past, reversed(kept), strict=True):
            d += (k - (u @ d) / (u @ s)) * s
        t, slope = np.float32(1), g @ d
        while True:
            after, g_after = loss(x + t * d)
            if after <= value + 1e-4 * t * slope or t < 1e-6:
                break
            t /= np.float32(2)
        if (s := t * d) @ (u := g_after - g) > 1e-12:
            past = [*past[-4:], (s, u)]
        x, done = x + t * d, abs(value - after) < 1e-3 * value
        value, g = after, g_after
        if done:
            break
    return (x[:-1] * ratio).astype(np.float32), float(x[-1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(weights of cells, bias) learnt from labels (doc_id, toxic 0/1) and the texts of docs (doc_id, text).

    Of each class MAX_PER_CLASS rows at most serve, those with the smallest hash of doc_id; all n-grams that occur in LEAST of their texts
    are features. A doc_id with several labels is toxic if one says so; rows that repeat a doc_id all serve; null ids, labels and
    other values of toxic don't. Without labels of both classes, or any rows, weights are 0 and the bias gives the smoothed share of toxic labels.
    Other columns, whatever their names, play no part.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return np.zeros(1 << BITS, np.float32), float(np.log((total.get(1, 0) + 1) / (total.get(0, 0) + 1)))
    first = lambda y: known.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_PER_CLASS)
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in first(0).unionByName(first(1)).collect()], "doc_id long, y int")  # 2 * MAX_PER_CLASS at most
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y").repartition(PARTS)
    counts = sample.mapInArrow(released(_counts), "cell binary, n binary, neg long, pos long").repartition(1)
    ratio = np.frombuffer(counts.mapInArrow(released(_ratios), "ratio binary").collect()[0]["ratio"], np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(ratio.tobytes())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's cells as compressed differences: the whole sample goes to one task."""
        used, codec = np.frombuffer(sent.value, np.float32) != 0, pa.Codec("zstd")
        for batch in batches:
            cells = [np.unique(gram_cells(t)) for t in batch["text"].to_pylist()]
            cells = [c[used[c]].astype(np.int32) for c in cells]
            packed = [codec.compress(np.diff(c, prepend=np.int32(0)).tobytes(), asbytes=True) for c in cells]
            yield pa.record_batch({"f": pa.array(packed, pa.binary()), "n": pa.array([len(c) for c in cells], pa.int32()), "y": batch["y"]})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, codec = [*batches], pa.Codec("zstd")
        n, y = (np.concatenate([np.asarray(b[c]) for b in got]) for c in ("n", "y"))
        f = [x for b in got for x in b["f"]]
        order = sorted(range(len(n)), key=lambda k: (n[k], y[k], f[k].as_buffer().to_pybytes()[:64]))
        cells = (np.cumsum(np.frombuffer(codec.decompress(f[k].as_buffer(), 4 * int(n[k])), np.int32), dtype=np.int32) for k in order)
        # one empty text more, as a clean one: where nothing tells classes apart, nothing is toxic
        sample = Sample(chain(cells, [np.zeros(0, np.int32)]), np.append(n[order], 0))
        del f, got
        w, b = fit(sample, np.append(y[order], 0.0), np.frombuffer(sent.value, np.float32))
        yield pa.record_batch({"w": pa.array([w.tobytes()], pa.binary()), "b": pa.array([b])})

    learnt = sample.mapInArrow(released(rows), "f binary, n int, y int").repartition(1).mapInArrow(released(learn), "w binary, b double").collect()[0]
    return np.frombuffer(learnt["w"], np.float32), float(learnt["b"])


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str]) -> DataFrame:
    """docs' columns `keep`, score (0 to 1) and predicted (1 from 0.5 on): each n-gram of a whole text counts once.

    An empty or null text gets the bias alone; repeated rows are scored each, copies alike; an empty table gives no rows; columns that aren't kept,
    whatever their names, play no part.
    """
    sent, bias = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model[0]).tobytes()), model[1]
    name = "text" if "text" in keep else "__text"
    kept = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(name))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, last = np.frombuffer(sent.value, np.float32), np.zeros(1 << BITS, np.int32)

        def logit(text: str | None) -> float:
            cells = gram_cells(text)
            nth = np.arange(len(cells), dtype=np.int32)
            last[cells] = nth  # of a cell's places the last one stays, and counts
            return float(weights[cells[last[cells] == nth]].sum(dtype=np.float64)) + bias

        for batch in batches:
            z = np.array([logit(t) for t in batch.column(name).to_pylist()], float)
            s = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.record_batch([*(batch.column(k) for k in keep), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(released(rows), ", ".join(f"`{k}` {types[k]}" for k in keep) + ", score double, predicted int")


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; learnt from labels of those whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0))
    return score(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
