"""Repeated passages: bytes under a string of fixed length that also starts earlier, by threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import in_order, mixed, ROLLER, table, written

#: Bytes of an anchor; bytes of text that a transform gets on average; distinct segments of an anchor beyond which they are parted.
ANCHOR, BUCKET, HOT = 24, 1 << 19, 20_000
#: Windows of a part: of those that show which segments a transform needs, and of hot anchors' parts, in turn.
WIDTH, FINER = 20, (8, 1)
BROADCAST_IDS = 1 << 19
_BITS = 20


def anchored(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of runs of windows data[s : s + length] that share their anchor.

    A window's anchor is its leftmost ANCHOR-gram of least hash: equal windows have equal anchors at equal places.
    """
    out: list[tuple] = []
    width = length - ANCHOR + 1
    step = (1 << _BITS) - width
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    for at in range(0, n, step):
        block = data[at : min(len(data), at + step + length - 1)]
        start = np.arange(len(block) - ANCHOR + 1)
        h = ROLLER.slices(block, start, start + ANCHOR)
        least = (h >> np.uint64(_BITS) << np.uint64(_BITS)) | start.astype(np.uint64)
        got = 1
        while got * 2 <= width:
            least = np.minimum(least[:-got], least[got:])
            got *= 2
        if got < width:
            least = np.minimum(least[: len(least) - (width - got)], least[width - got :])
        place = (least & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        out.append((h[place[first]], first + at, np.diff(np.append(first, len(place)))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def parted(data: np.ndarray, h: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """(run, anchor hash, first window, number of windows) of the parts of runs of windows (anchor hash h, first window lo, number n).

    A part has the windows whose start is from k * width to k * width + width - 1 bytes before their anchor. Its own, longer anchor is what
    all such windows have in common, so that equal windows are in parts of one anchor. With a width of 1 that is the window itself, whatever
    h is. Otherwise runs whose first window doesn't have h have no parts.
    """
    if width == 1:
        run = np.repeat(np.arange(len(n)), n)
        lo = lo[run] + np.arange(len(run)) - np.repeat(n.cumsum() - n, n)
        return run, ROLLER.slices(data, lo, lo + length), lo, np.ones_like(lo)
    gram = ROLLER.slices(data, np.arange(len(data) - ANCHOR + 1), np.arange(ANCHOR, len(data) + 1))
    hit = gram[lo[:, None] + np.arange(length - ANCHOR + 1)] == h[:, None]
    run = np.flatnonzero(hit.any(axis=1))
    far = hit[run].argmax(axis=1)
    near = far - n[run] + 1
    count = far // width - near // width + 1
    of = np.repeat(np.arange(len(run)), count)
    k = (far // width)[of] - (np.arange(len(of)) - np.repeat(count.cumsum() - count, count))
    least, most = np.maximum(k * width, near[of]), np.minimum(k * width + width - 1, far[of])
    run, place = run[of], (lo[run] + far)[of]
    return run, ROLLER.slices(data, place - k * width, place - (k + 1) * width + 1 + length), place - most, most - least + 1


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.zeros(0, np.uint8)


def repeats(segments: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, segment, offset) of all windows of `length` bytes in segments: equal windows are one group.

    A suffix array of the joined segments, sorted by length + 1 symbols at least, gives the transform. From the interval of all suffixes, each
    step extends intervals backward by every byte that precedes them; the value of a step is the length that neighbours on an interval's
    new edge have in common. Steps end below `length`: edges not met by then have longer common prefixes, and part no groups.
    """
    size = np.array([len(s) for s in segments])
    n = int(size.sum() + len(size))
    text = np.zeros(n, np.uint16)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    inside = np.ones(n, bool)
    inside[begin + size] = False
    text[inside] = np.concatenate(segments).astype(np.uint16) + 1
    key, k = np.zeros(n, np.int64), 0
    while k < 7:
        key = (key << 9) | np.roll(text, -k).astype(np.int64)
        k += 1
    while True:
        order = np.argsort(key)
        new = np.concatenate([[0], (np.diff(key[order]) != 0).cumsum()])
        if k > length or new[-1] == n - 1:
            break
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * n + np.roll(rank, -k)
        k *= 2
    bwt = text[order - 1]
    back = np.empty(n, np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    edge = np.zeros(n + 1, bool)
    edge[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for step in range(length):
        count = high - low
        at = np.repeat(low - np.concatenate([[0], count.cumsum()[:-1]]), count) + np.arange(count.sum())
        to, of = back[at], np.repeat(np.arange(len(low)), count)
        o = np.argsort(to)
        to, of, ch = to[o], of[o], bwt[at[o]]
        cut = np.flatnonzero((to[1:] != to[:-1] + 1) | (of[1:] != of[:-1]) | (ch[1:] != ch[:-1]))
        low, high = to[np.concatenate([[0], cut + 1])], to[np.append(cut, len(to) - 1)] + 1
        fresh = ~edge[high]
        if step == 0:  # the last symbol's interval ends at n, as the first one does
            fresh |= high == n
        low, high = low[fresh], high[fresh]
        edge[high] = True
        if not len(low):
            break
    group = edge[:n].cumsum()
    seg = np.searchsorted(begin, order, "right") - 1
    off = order - begin[seg]
    whole = off <= size[seg] - length
    return group[whole], seg[whole], off[whole]


def needed(segments: list[np.ndarray], h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, number of windows) of what can have an equal window elsewhere: from a segment's first to its last part that
    has its anchor in common with another part. Segments that don't have the anchor h stay whole."""
    n = np.array([len(s) for s in segments]) - length + 1
    begin = np.concatenate([[0], np.cumsum(n + length - 1)[:-1]])
    run, key, lo, of = parted(np.concatenate(segments), h, begin, n, length, WIDTH)
    first, last = np.zeros(len(n), np.int64), n.copy()
    first[run], last[run] = n[run], 0
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    met = count[at] > 1
    run, lo, of = run[met], (lo - begin[run])[met], of[met]
    np.minimum.at(first, run, lo)
    np.maximum.at(last, run, lo + of)
    some = np.flatnonzero(first < last)
    return some, first[some], last[some] - first[some]


def late_runs(segments: list[np.ndarray], rank: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, windows) of runs of windows that also start earlier, in the order (rank, first + offset)."""
    group, seg, off = repeats(segments, length)
    o = np.lexsort((first[seg] + off, rank[seg], group))
    group, seg, off = group[o], seg[o], off[o]
    # equal windows at one place, in segments that overlap, are one window
    again = np.concatenate([[False], group[1:] == group[:-1]])
    lead = np.maximum.accumulate(np.where(~again, np.arange(len(group)), 0))
    late = again & ((rank[seg] != rank[seg[lead]]) | (first[seg] + off != first[seg[lead]] + off[lead]))
    seg, start = seg[late], first[seg[late]] + off[late]
    o = np.lexsort((start, seg))
    return _runs(seg[o], start[o])


def _runs(seg: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(seg):
        return seg, start, start
    cut = np.concatenate([[0], np.flatnonzero((seg[1:] != seg[:-1]) | (start[1:] != start[:-1] + 1)) + 1])
    return seg[cut], start[cut], np.diff(np.append(cut, len(seg)))


_ANCHORS = "h long, seg long, ord long, lo int, n int, again boolean"


def _known(out: list[tuple]) -> pa.RecordBatch:
    """Columns (h, seg, ord, lo, n) of a batch's texts -> rows; again: an earlier row has the same h and seg."""
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    o = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
    cols = [c[o] for c in cols]
    again = np.concatenate([[False], (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])])
    # what repeats within the batch is known to be late here: dealt by its place, it crowds no anchor's task
    place = mixed(cols[2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + cols[3].astype(np.uint64)).view(np.int64)
    cols[0] = np.where(again, place, cols[0])
    return pa.record_batch([*map(pa.array, cols), pa.array(again)], names=["h", "seg", "ord", "lo", "n", "again"])


def _anchors(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ord_, text in zip(batch.column("ord").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = _bytes(text)
                h, lo, n = anchored(data, length)
                if len(h):
                    seg = ROLLER.slices(data, lo, lo + n + length - 1)
                    out.append((h.view(np.int64), seg.view(np.int64), np.full(len(h), ord_), lo.astype(np.int32), n.astype(np.int32)))
            if out:
                yield _known(out)

    return rows


def _parts(length: int, width: int):
    """Texts with segments of hot anchors -> the segments' parts, as _anchors() gives segments."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ord_, text, hot in zip(batch.column("ord").to_pylist(), batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                data = _bytes(text)
                h, lo, n = (np.array([w[k] for w in hot], np.int64) for k in ("h", "lo", "n"))
                _, h, lo, n = parted(data, h.view(np.uint64), lo, n, length, width)
                seg = ROLLER.slices(data, lo, lo + n + length - 1)
                out.append((h.view(np.int64), seg.view(np.int64), np.full(len(h), ord_), lo.astype(np.int32), n.astype(np.int32)))
            if out:
                yield _known(out)

    return rows


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order (h, seg, ord, lo), those whose h has another row, and those with again; first: no row of its h and seg before it, nor again."""
    names, kinds = ["h", "seg", "ord", "lo", "n", "again"], (np.int64, np.int64, np.int64, np.int32, np.int32, bool)
    last, had, later_last = [np.zeros(0, k) for k in kinds], False, False  # the last row, and whether it has its h, and seg, from the row before

    def given(cols: list[np.ndarray], keep: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([*(pa.array(c[keep]) for c in cols[:5]), pa.array(~(later | cols[5])[keep])], names=[*names[:5], "first"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for x, k in zip(last, names, strict=True)]
        link = cols[0][1:] == cols[0][:-1]
        before = np.concatenate([[had], link])
        later = np.concatenate([[later_last], link & (cols[1][1:] == cols[1][:-1])])
        yield given([c[:-1] for c in cols], before[:-1] | link | cols[5][:-1], later[:-1])
        last, had, later_last = [c[-1:] for c in cols], bool(before[-1]), bool(later[-1])
    yield given(last, np.full(len(last[0]), had) | last[5], np.full(len(last[0]), later_last))


def _segments(length: int, buckets: int):
    """Texts with their anchors in conflict -> the segments' bytes, dealt to buckets by anchor."""
    names, kinds = ["bucket", "h", "ord", "lo", "bytes"], [pa.int64()] * 4 + [pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for ord_, text, wanted in zip(batch.column("ord").to_pylist(), batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    h, lo = w["h"], w["lo"]
                    for column, value in zip(out, (h % (1 << 64) % buckets, h, ord_, lo, data[lo : lo + w["n"] + length - 1]), strict=True):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)
                    out = [[] for _ in names]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    return rows


def _expand(length: int):
    def bucket(part: pa.Table) -> pa.Table:
        rank, first, h = (np.asarray(part[c]) for c in ("ord", "lo", "h"))
        segments = [np.frombuffer(x, np.uint8) for x in part["bytes"].to_pylist()]
        some, skip, n = needed(segments, h.view(np.uint64), length)
        rank, first = rank[some], first[some] + skip
        segments = [segments[k][a : a + m + length - 1] for k, a, m in zip(some.tolist(), skip.tolist(), n.tolist(), strict=True)]
        seg, lo, n = late_runs(segments, rank, first, length) if segments else (np.zeros(0, np.int64),) * 3
        return pa.table({"ord": rank[seg], "lo": pa.array(lo, pa.int64()), "n": pa.array(n, pa.int64())})

    return bucket


def cut_out(data: bytes, lo: np.ndarray, n: np.ndarray, length: int) -> tuple[int, int, str]:
    """(bytes removed, maximal runs of them, digest of what is kept) when windows lo .. lo + n - 1 go."""
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, lo, 1)
    np.add.at(mark, lo + n + length - 1, -1)
    gone = mark.cumsum()[:-1] > 0
    starts = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()


def _removed(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, late in zip(batch.column("text").to_pylist(), batch.column("late").to_pylist(), strict=True):
                lo, n = (np.array([x[k] for x in late], np.int64) for k in ("lo", "n"))
                out.append(cut_out(text.encode("utf-8", "surrogatepass"), lo, n, length))
            yield pa.record_batch([batch.column("ord"), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["ord", "n_removed", "n_spans", "kept_sha256"])

    return rows


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs joined to ids (ord, ...): with a broadcast of the ids alone, by which texts are picked before they move, if these are few."""
    if ids.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids.select("ord")), "ord", "left_semi")
    return docs.join(ids, "ord")


def _wanted(clash: DataFrame) -> DataFrame:
    return clash.groupBy("ord").agg(F.collect_list(F.struct("h", "lo", "n")).alias("at"))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is every byte under a string of `length` bytes that also starts earlier: in a smaller doc_id, or the same document. A
    null text counts as empty; texts shorter than `length` stay whole. If doc_ids repeat or are null, rows are told apart by their
    text and ordered by doc_id (null first), then a hash of the text; rows that repeat a doc_id and its text share one result. An
    empty table gives no rows; other columns, whatever their names, play no part.
    1. A window's anchor is its minimizer; runs of windows with one anchor are segments. Anchors that occur once have no repeats.
    2. Of equal segments (by 64-bit hash) all but the earliest are repeats.
    3. An anchor with more than HOT unequal segments has them parted: fewer windows each, with longer anchors, for which steps 1 and 2
       are done again; in the end a window is its own anchor.
    4. Where an anchor has unequal segments, their bytes go to a bucket, in which a Burrows-Wheeler transform finds equal windows among
       those parts that share more than the anchor. Buckets grow in number with the data.
    5. Texts with repeats are read again and cut.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "text")
    repeated = base.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() > 0
    if repeated:
        own = base.select("doc_id", F.xxhash64("text").alias("__sha")).distinct()
        own = in_order(own.withColumnRenamed("doc_id", "__id"), [F.col("__id").asc_nulls_first(), F.col("__sha")], "ord")
        rows = base.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__sha"))).select("doc_id", "ord", "text")
    else:
        rows = base.select("doc_id", F.col("doc_id").alias("ord"), "text")
    texts = rows.select("ord", "text").where(f"octet_length(text) >= {length}")
    texts = texts.dropDuplicates(["ord"]) if repeated else texts
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors, late, clashes, total = texts.mapInArrow(_anchors(length), _ANCHORS), [], [], 0
    for finer in (*FINER, None):
        anchors = anchors.repartition(parts, "h").sortWithinPartitions("h", "seg", "ord", "lo")
        met = written(anchors.mapInArrow(_repeated, "h long, seg long, ord long, lo int, n int, first boolean"), "repeats-anchors")
        late.append(met.where("not first").select("ord", F.col("lo").cast("long").alias("lo"), F.col("n").cast("long").alias("n")))
        if finer is None:
            break  # windows of one anchor are equal
        heads = met.where("first").groupBy("h").agg(F.count("*").alias("segs")).where("segs > 1")
        clash = written(met.where("first").join(heads, "h").select("h", "ord", "lo", "n", (F.col("segs") > HOT).alias("hot")), "repeats-clashes")
        size, hot = clash.agg(F.sum(F.when(~F.col("hot"), F.col("n") + length)), F.max("hot")).first()
        clashes, total = [*clashes, clash.where("not hot")], total + int(size or 0)
        if not hot:
            break
        parting = written(_wanted(clash.where("hot")), "repeats-hot")
        anchors = _texts(texts, parting).select("ord", "text", "at").mapInArrow(_parts(length, finer), _ANCHORS)
    buckets = max(parts, -(-total // BUCKET))
    wanted = written(_wanted(reduce(DataFrame.unionByName, clashes)), "repeats-wanted")
    segments = _texts(texts, wanted).select("ord", "text", "at").mapInArrow(_segments(length, buckets), "bucket long, h long, ord long, lo long, bytes binary")
    found = segments.groupBy("bucket").applyInArrow(_expand(length), "ord long, lo long, n long")
    late = reduce(DataFrame.unionByName, late, found)
    late = written(late.groupBy("ord").agg(F.collect_list(F.struct("lo", "n")).alias("late")), "repeats-late")
    cut = _texts(texts, late).select("ord", "text", "late").mapInArrow(_removed(length), "ord long, n_removed long, n_spans long, kept_sha256 string")
    whole = rows.select("doc_id", "ord", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    out = whole.join(cut, "ord", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, strings of 100 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"), 100)


OP5_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, CAST(2 * s + 1 AS BIGINT), 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM b)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY m ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
cut AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM late),
run AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM cut) GROUP BY doc_id, k),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a, z FROM run),
sums AS (SELECT doc_id, sum(z - a) AS n, count(*) AS k, max(z) AS last FROM run GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(b.h, CAST(2 * f + 1 AS BIGINT), CAST(2 * (a - f) AS BIGINT)), '' ORDER BY a) AS h FROM gap g JOIN b ON b.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT b.doc_id, CAST(len(b.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(s.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.k, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN s.doc_id IS NULL THEN b.h ELSE k.h || substr(b.h, CAST(2 * s.last + 1 AS BIGINT)) END)) AS kept_sha256
FROM b LEFT JOIN sums s ON s.doc_id = b.doc_id LEFT JOIN kept k ON k.doc_id = b.doc_id
"""
