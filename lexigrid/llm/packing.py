"""Packing token ids into sequences: cutting stock by column generation over a histogram of piece lengths."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import released, table, written

SEQUENCE, GRAIN, END_ID = 4096, 64, 2
#: Pre-tokens kept per worker process for good, and beyond these at a time.
CACHE, RECENT = 200_000, 50_000
#: Texts with other characters, with separators on which libraries differ, or with a special token's opening, go to the library whole.
_UNSURE = re.compile("[\x1c-\x1f\x85İƀ-\U0010ffff]|<\\|")
_LETTER, _NUMBER = "a-zªµºß-öø-ſ", "0-9²³¹¼½¾"
#: The vocabulary file's own pre-tokeniser, for lower-cased text of the characters that are left.
_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
_STATE: dict = {}


class PreTokens(dict):
    """From a pre-token to its ids in bytes. The first CACHE pre-tokens stay; later ones go again, RECENT at a time."""

    def __init__(self, tok) -> None:
        super().__init__()
        self.tok, self.recent = tok, []

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = np.array(self.tok.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) > CACHE:
            self.recent.append(piece)
            if len(self.recent) > RECENT:
                for p in self.recent:
                    del self[p]
                self.recent.clear()
        return ids


#: The normaliser and the pre-tokeniser that _PIECE and lower() stand for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _known(tok) -> bool:
    """Whether a tokenizer cuts texts as _PIECE does."""
    said = json.loads(tok.to_str())
    first = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return said["normalizer"] == NORMALIZER and first.get("pattern") == {"Regex": SPLIT} and first.get("behavior") == "Removed"


def tokenizer(path: str) -> tuple:
    """The library's tokenizer, and its results by pre-token; None for these where the file cuts texts in another way."""
    if path not in _STATE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _STATE[path] = (tok, PreTokens(tok) if _known(tok) else None)
    return _STATE[path]


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """Each whole text's ids, and END_ID, as little-endian unsigned 32-bit integers.

    Byte-pair merges never cross a pre-token, so that the ids of each distinct pre-token come from the library once and from a
    cache then; texts for which that isn't sure, and all texts with other vocabulary files than that of word pairs, go to the library whole.
    """
    tok, cache = tokenizer(path)
    end, out = np.array([END_ID], "<u4").tobytes(), []
    for text in texts:
        if not text:
            out.append(end)
        elif cache is None or _UNSURE.search(text):
            out.append(np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + end)
        else:
            out.append(b"".join(map(cache.__getitem__, _PIECE.findall(text.lower()))) + end)
    return out


def cuts(n: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, a multiple of GRAIN, and what is left."""
    full, rest = divmod(n, SEQUENCE)
    main = rest - rest % GRAIN
    out = [(i * SEQUENCE, SEQUENCE) for i in range(full)]
    return out + [(a, b) for a, b in ((full * SEQUENCE, main), (full * SEQUENCE + main, rest - main)) if b]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of docs (doc_id, text), numbered within their partition and length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                out: list[tuple] = []
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), token_bytes(some.column("text").to_pylist(), path), strict=True):
                    for start, length in cuts(len(ids) // 4):
                        met[length] = nth = met.get(length, -1) + 1
                        out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, part, nth))
                cols = list(zip(*out, strict=True)) if out else [[]] * 7
                yield pa.record_batch([pa.array(c, pa.int32() if k == 5 else pa.int64()) for k, c in enumerate(cols)], names=[x.split()[0] for x in PIECE.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(released(rows), PIECE)


def _price(sizes: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack by dynamic programming: the best value in `room`, and how many of each size give it."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fit = np.searchsorted(sizes, w, "right")
        best[w] = best[w - 1]
        if fit:
            gain = best[w - sizes[:fit]] + value[:fit]
            k = int(gain.argmax())
            if gain[k] > best[w] + 1e-12:
                best[w], last[w] = gain[k], k
    count, w = np.zeros(len(sizes)), room
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            count[last[w]] += 1
            w -= sizes[last[w]]
    return float(best[room]), count


def patterns(demand: dict[int, int], room: int = SEQUENCE, gap: float = 2e-4, steps: int = 3000) -> list[tuple[dict[int, int], int]]:
    """(how many pieces of each length, how many sequences of this kind) that together hold demand {length: count} exactly.

    The linear program's basis starts from one pattern per length; the knapsack prices columns with its duals, until the bound
    room for improvement is under `gap`. Counts are rounded down, and what is left is packed first-fit by falling length.
    """
    sizes = np.array(sorted(k for k, n in demand.items() if n), int)
    if not len(sizes):
        return []
    d = np.array([demand[int(k)] for k in sizes], float)
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / (room // sizes))
    for _ in range(steps):
        x, dual = inverse @ d, inverse.sum(axis=0)
        value, column = _price(sizes, np.maximum(dual, 0), room)
        if value <= 1 + gap:
            break
        u = inverse @ column
        ratio = np.where(u > 1e-9, np.maximum(x, 0) / np.where(u > 1e-9, u, 1), np.inf)
        r = int(ratio.argmin())
        basis[:, r] = column
        pivot = inverse[r] / u[r]
        inverse = inverse - np.outer(u, pivot)
        inverse[r] = pivot
    x = inverse @ d  # rounding below keeps the counts exact, whatever this lacks in precision
    out, left = [], d.astype(np.int64)
    for k in np.argsort(-x, kind="stable"):
        column = basis[:, k].astype(np.int64)
        n = int(min([np.floor(max(0.0, x[k]) + 1e-9), *(left[i] // column[i] for i in np.flatnonzero(column))]))
        if n:
            out.append(({int(sizes[i]): int(column[i]) for i in np.flatnonzero(column)}, n))
            left = left - n * column
    bins: list[list] = []
    for i in range(len(sizes) - 1, -1, -1):
        size, n = int(sizes[i]), int(left[i])
        for b in bins:
            if n and (fit := min(n, b[0] // size)):
                b[0], n = b[0] - fit * size, n - fit
                b[1][size] = b[1].get(size, 0) + fit
        if n:
            per = room // size
            if n // per:
                out.append(({size: per}, n // per))
            if n % per:
                bins.append([room - n % per * size, {size: n % per}])
    return out + [(b[1], 1) for b in bins]


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by falling pattern: ranks before it, pieces in a sequence, first sequence, offset there."""
    rows: dict[int, list] = {}
    first = 0
    for counts, n in plan:
        at = 0
        for size in sorted(counts, reverse=True):
            rows.setdefault(size, []).append((n * counts[size], counts[size], first, at))
            at += size * counts[size]
        first += n
    out = {}
    for size, r in rows.items():
        a = np.array(r, np.int64)
        out[size] = (np.concatenate([[0], a[:, 0].cumsum()]), a[:, 1], a[:, 2], a[:, 3])
    return out


PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are cut at multiples of 4096 and GRAIN only, so there are some 128 lengths, whatever the data; their histogram is all
    that the linear program needs. Every piece then finds its place from its rank among the pieces of its length. A null or
    empty text is the end id alone; repeated rows are packed each; an empty table gives no rows; other columns, whatever their names, play no part.
    """
    cut = written(pieces(docs, path), "pack-pieces")
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    demand = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # 4096 lengths at most
    places = _places(patterns(demand))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("before"))
    ranked = cut.join(ranks, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("part", "before", "nth")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            seq, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                ends, each, first, offset = places[int(size)]
                own = np.flatnonzero(length == size)
                p = np.searchsorted(ends, rank[own], "right") - 1
                q = rank[own] - ends[p]
                seq[own], at[own] = first[p] + q // each[p], offset[p] + q % each[p] * size
            yield pa.record_batch([*(batch.column(k) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(seq), pa.array(at)], names=[x.split()[0] for x in PLACED.split(", ")])

    return ranked.mapInArrow(released(rows), PLACED)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in sequences of 4096."""
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())
