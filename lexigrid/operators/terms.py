"""Documents' own terms: each row is cut, counted and grouped by itself, in flat arrays; no token is a row and none is shuffled.

All functions take docs with the id `doc_id` and an Analyzer. Letters (ALPHA, lower-cased, nothing else) are cut from the text's bytes; of any
other analyzer the token arrays come from its column expression. Stems are no part of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.text import ALPHA, Analyzer

#: Bytes of text, and rows, that are cut at a time; terms that are looked up in a list rather than joined.
SLICE, ROWS, FREQUENT = 1 << 23, 1 << 16, 1 << 16
#: Cells of terms by groups up to which counts go into a flat array.
DENSE = 1 << 23
_LETTER = np.array([b if 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)


class Cut:
    """Some rows' tokens: `batch` has the rows, `n` their numbers of tokens, `terms` the distinct terms, `codes` one of these for each token."""

    def __init__(self, batch: pa.RecordBatch, n: np.ndarray, tokens: pa.Array):
        d = tokens.dictionary_encode()
        self.batch, self.n, self.terms, self.codes = batch, n, d.dictionary, np.asarray(d.indices, np.int64)

    def groups(self) -> None:
        """The (row, term) pairs, by row: `row`, `code`, `tf`, `first` and `last` position; `pos` has all positions, `ends` where each group's end."""
        n, size = len(self.codes), max(1, len(self.terms))
        bits = max(1, n).bit_length()
        key = np.repeat(np.arange(len(self.n), dtype=np.int64) * size, self.n) + self.codes
        key = np.sort((key << bits) | np.arange(n))
        at, key = key & ((1 << bits) - 1), key >> bits
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[:n] if n else np.zeros(0, np.int64)
        self.row, self.code = key[begins] // size, key[begins] % size
        self.pos = (at - np.repeat(np.cumsum(self.n) - self.n, self.n)[at]).astype(np.int32)
        self.ends = np.append(begins, n).astype(np.int32)
        self.tf = np.diff(self.ends).astype(np.int64)
        self.first, self.last = self.pos[begins], self.pos[self.ends[1:] - 1]


def _letters(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Texts without nulls -> the number of each one's words of ASCII letters, and these in lower case."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    low = _LETTER[data]
    inside = low != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    begin[heads] = inside[heads]
    starts = np.append(np.flatnonzero(begin[inside]), np.count_nonzero(inside)).astype(np.int32)
    n = np.diff(np.searchsorted(np.flatnonzero(begin), off))
    return n, pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(low[inside]))


def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[Cut]:
    """Batches whose last column is a text to be cut at letters, or an array of tokens -> their rows, cut, a slice at a time."""
    for whole in batches:
        col = whole.column(whole.num_columns - 1)
        lists = pa.types.is_list(col.type) or pa.types.is_large_list(col.type)
        size = pc.fill_null(pc.list_value_length(col) if lists else pc.binary_length(col), 0)
        ends, i = np.cumsum(np.asarray(size, np.int64)) * (8 if lists else 1), 0
        while i < len(ends):
            j = int(min(max(i + 1, np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, "right")), i + ROWS, len(ends)))
            part = whole.slice(i, j - i)
            own = part.column(part.num_columns - 1)
            n, tokens = (np.asarray(size, np.int64)[i:j], own.flatten()) if lists else _letters(pc.fill_null(own, ""))
            yield Cut(part, n, tokens)
            i = j


def rows(docs: DataFrame, analyzer: Analyzer | None, field: str, keep: tuple[str, ...], f, schema: T.StructType | str) -> DataFrame:
    """f(Cut) -> a record batch, over all rows of docs with the columns `keep`. Without an analyzer, field is an array of tokens."""
    if analyzer and analyzer.stemmer:
        raise ValueError("terms are cut without stems")
    plain = analyzer and analyzer.pattern == ALPHA and analyzer.lower and not analyzer.stop
    text: Column = F.col(field).cast("string") if plain else analyzer.tokens(F.col(field)) if analyzer else F.coalesce(field, F.array().cast("array<string>"))

    def run(batches):
        for cut in cuts(batches):
            yield f(cut)

    return docs.select(*keep, text.alias("__text")).mapInArrow(run, schema)


def _types(docs: DataFrame, keep: tuple[str, ...]) -> list[T.StructField]:
    return [T.StructField(c, docs.schema[c].dataType) for c in keep]


def _kept(batch: pa.RecordBatch, keep: tuple[str, ...], at: np.ndarray) -> list[pa.Array]:
    at = pa.array(at)
    return [batch.column(c).take(at) for c in keep]


def occurrences(docs: DataFrame, analyzer: Analyzer, field: str, keep: tuple[str, ...], named: dict[str, str]) -> DataFrame:
    """(keep..., pos, term): a row for each token that `named` has, under its name there."""
    words, names = pa.array(list(named), pa.string()), pa.array(list(named.values()), pa.string())

    def f(c: Cut) -> pa.RecordBatch:
        place = np.asarray(pc.fill_null(pc.index_in(c.terms, value_set=words), -1), np.int64)[c.codes]
        at = np.flatnonzero(place >= 0)
        row = np.repeat(np.arange(len(c.n)), c.n)[at]
        pos = at - (np.cumsum(c.n) - c.n)[row]
        return pa.RecordBatch.from_arrays([*_kept(c.batch, keep, row), pa.array(pos.astype(np.int32)), names.take(pa.array(place[at]))], [*keep, "pos", "term"])

    return rows(docs, analyzer, field, keep, f, T.StructType([*_types(docs, keep), T.StructField("pos", T.IntegerType()), T.StructField("term", T.StringType())]))


def words(docs: DataFrame, analyzer: Analyzer, field: str) -> DataFrame:
    """(term): the distinct terms of slices."""
    return rows(docs, analyzer, field, (), lambda c: pa.RecordBatch.from_arrays([c.terms], ["term"]), "term string")


def repeated(docs: DataFrame) -> DataFrame | None:
    """The ids (doc_id) of several rows; None where each row has its own."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("doc_id").alias("__id"))
    return None if ids.isEmpty() else ids


def _apart(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    return docs.join(ids, same, "left_anti"), docs.join(ids, same, "left_semi")


def single(docs: DataFrame, field: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., field): rows of one id, and of the same `keep`, as one text, for whatever doesn't ask for positions."""
    docs = docs.select("doc_id", *keep, field)
    ids = repeated(docs)
    if ids is None:
        return docs
    own, shared = _apart(docs, ids)
    return own.unionByName(shared.groupBy("doc_id", *keep).agg(F.array_join(F.collect_list(F.coalesce(field, F.lit(""))), "\n").alias(field)))


def postings(docs: DataFrame, analyzer: Analyzer, field: str, positions: bool = True) -> DataFrame:
    """(term, doc_id, tf, first_pos, last_pos, positions ascending), the last one if asked for. Only rows of a repeated id are shuffled."""
    fields = [T.StructField("term", T.StringType()), *_types(docs, ("doc_id",)), T.StructField("tf", T.LongType()), T.StructField("first_pos", T.IntegerType()), T.StructField("last_pos", T.IntegerType())]
    fields += [T.StructField("positions", T.ArrayType(T.IntegerType()))] if positions else []
    names = [x.name for x in fields]

    def f(c: Cut) -> pa.RecordBatch:
        c.groups()
        out = [c.terms.take(pa.array(c.code)), *_kept(c.batch, ("doc_id",), c.row), pa.array(c.tf), pa.array(c.first), pa.array(c.last)]
        out += [pa.ListArray.from_arrays(pa.array(c.ends), pa.array(c.pos))] if positions else []
        return pa.RecordBatch.from_arrays(out, names)

    cut = lambda d: rows(d, analyzer, field, ("doc_id",), f, T.StructType(fields))
    ids = repeated(docs)
    if ids is None:
        return cut(docs)
    own, shared = _apart(docs, ids)
    more = [F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")] if positions else []
    merged = cut(shared).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), *more)
    return cut(own).unionByName(merged)


def totals(docs: DataFrame, analyzer: Analyzer | None, field: str, by: tuple[str, ...] = (), first: bool = False) -> DataFrame:
    """(by..., term, df, cf), with first also f, the smallest (doc_id, pos): sums of slices, to be summed. df counts rows: see single()."""
    keep = (*by, "doc_id") if first else by
    fields = [*_types(docs, by), T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("cf", T.LongType())]
    fields += [T.StructField("f", T.StructType([*_types(docs, ("doc_id",)), T.StructField("pos", T.IntegerType())]))] if first else []
    names = [x.name for x in fields]

    def f(c: Cut) -> pa.RecordBatch:
        c.groups()
        cell = np.zeros(c.batch.num_rows, np.int64)
        for name in by:
            d = pc.dictionary_encode(c.batch.column(name), null_encoding="encode")
            _, cell = np.unique(cell * max(1, len(d.dictionary)) + np.asarray(d.indices), return_inverse=True)
        size = max(1, len(c.terms))
        some = np.zeros(cell.max(initial=0) + 1, np.int64)
        some[cell] = np.arange(len(cell))
        at = cell[c.row] * size + c.code if by else c.code
        if len(some) * size <= DENSE:
            df = np.bincount(at, minlength=len(some) * size)
            key = np.flatnonzero(df)
            df, cf = df[key], np.bincount(at, c.tf, len(some) * size)[key].astype(np.int64)
        else:
            key, at, df = np.unique(at, return_inverse=True, return_counts=True)
            cf = np.bincount(at, c.tf, len(key)).astype(np.int64)
        out = [*_kept(c.batch, by, some[key // size]), c.terms.take(pa.array(key % size)), pa.array(df), pa.array(cf)]
        if first:
            rank = np.asarray(pc.rank(c.batch.column("doc_id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64)
            order = np.lexsort((c.first, rank[c.row], at))
            best = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
            out.append(pa.StructArray.from_arrays([*_kept(c.batch, ("doc_id",), c.row[best]), pa.array(c.first[best])], ["doc_id", "pos"]))
        return pa.RecordBatch.from_arrays(out, names)

    return rows(docs, analyzer, field, keep, f, T.StructType(fields))


def vectorizer(docs: DataFrame, tokens: str, output: str, size: int, least: int = 1, share: float = 1.0):
    """The model of a CountVectorizer over an array<string> column: of the terms that at least `least` documents and at most that share of them
    have, the `size` most frequent ones. Its own fit caches all tokens, and a task reads its whole part of them."""
    from pyspark.ml.feature import CountVectorizerModel

    sums = totals(docs, None, tokens).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where(F.col("df") >= least)
    sums = sums.where(F.col("df") <= share * docs.count()) if share < 1 else sums
    listed = sums.orderBy(F.desc("cf"), "term").limit(size).select("term").toArrow()["term"].to_pylist()
    return CountVectorizerModel.from_vocabulary(listed, inputCol=tokens, outputCol=output)


def lengths(docs: DataFrame, analyzer: Analyzer, field: str) -> DataFrame:
    """(doc_id, len): each row's number of tokens."""
    f = lambda c: pa.RecordBatch.from_arrays([*_kept(c.batch, ("doc_id",), np.arange(len(c.n))), pa.array(c.n.astype(np.int64))], ["doc_id", "len"])
    return rows(docs, analyzer, field, ("doc_id",), f, T.StructType([*_types(docs, ("doc_id",)), T.StructField("len", T.LongType())]))


def top(stats: DataFrame, *values: str) -> pa.Table:
    """(term, values...) of the FREQUENT terms of most documents, from (term, df, values...): looked up in a list, so that only rarer terms are joined."""
    return stats.orderBy(F.desc("df"), "term").limit(FREQUENT).select("term", *values).toArrow()


def rare(docs: DataFrame, analyzer: Analyzer, field: str, listed: pa.Table, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., term, tf): of each row the terms that the list doesn't have."""
    known = listed["term"].combine_chunks()

    def f(c: Cut) -> pa.RecordBatch:
        c.groups()
        on = np.asarray(pc.is_in(c.terms, value_set=known).to_numpy(zero_copy_only=False), bool)
        at = np.flatnonzero(~on[c.code])
        return pa.RecordBatch.from_arrays([*_kept(c.batch, keep, c.row[at]), c.terms.take(pa.array(c.code[at])), pa.array(c.tf[at])], [*keep, "term", "tf"])

    return rows(docs, analyzer, field, keep, f, T.StructType([*_types(docs, keep), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


def looked_up(c: Cut, listed: pa.Table) -> np.ndarray:
    """The place in the list of each group's term, or -1."""
    place = pc.fill_null(pc.index_in(c.terms, value_set=listed["term"].combine_chunks()), -1)
    return np.asarray(place, np.int64)[c.code]
