"""Language-model scores: a gated recurrent network over the whole of every document, beside an add-one unigram base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import released, table, written
from lexigrid.llm.recurrent import END, UNKNOWN, Network, scored, shapes, taught

#: The network's outcomes: LEAST of them, and GROWTH * tokens ** POWER where that is more.
LEAST, GROWTH, POWER = 768, 6, 0.4
#: Frequent words (and all of the network's) are looked up in a list that every task has, of words of LONGEST bytes at most; all others are joined.
FREQUENT, LONGEST = 1 << 18, 64
#: Training tokens of a shard: SHARD, or PER_OUTCOME for each outcome, so that weights stay small beside what they are learnt from.
SHARD, PER_OUTCOME = 1 << 20, 512
#: Tokens of the common start; tokens that are trained, or scored, at a time.
WARM, CHUNK, FLUSH = 1 << 20, 1 << 18, 1 << 21
#: Shards whose weights are averaged at a time, and bytes of weights in a row.
FAN_IN, PIECE = 16, 1 << 20


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, with A-Z in lower case, and where each text's begin (and the end). Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, edges = lists.flatten(), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
    full = np.asarray(pc.binary_length(flat)) > 0  # blanks at a text's ends give empty strings
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[edges]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's words with their counts; a word can come more than once."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    held, rows = [], 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in batches:
        counts = _split(batch.column("text"))[0].value_counts()
        held.append(pa.table({"word": counts.field("values").cast(pa.binary()), "n": counts.field("counts")}))
        rows += len(counts)
        if rows > 1 << 20:
            held = [merged()]
            rows = held[0].num_rows
            if rows > 1 << 19:
                yield from held[0].cast(schema).to_batches(1 << 16)
                held, rows = [], 0
    if held:
        yield from merged().cast(schema).to_batches(1 << 16)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and counts -> one row: the words in the order of falling counts and their counts, as an Arrow stream."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    got = pa.concat_tables([schema.empty_table(), *(pa.table(b.columns, schema) for b in batches)])
    got = got.sort_by([("n", "descending"), ("word", "ascending")])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, got.schema) as out:
        out.write_table(got)
    yield pa.record_batch({"blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _listed(blob: bytes) -> tuple[pa.Array, np.ndarray]:
    got = pa.ipc.open_stream(blob).read_all().combine_chunks()
    words = got["word"].combine_chunks() if got.num_rows else pa.array([], pa.binary())
    return words.view(pa.string()), np.asarray(got["n"], np.int64)


def frequent(found: DataFrame) -> bytes:
    """The most frequent words of found (word binary, n long) and their counts: FREQUENT at most, all of a count or none."""
    short = found.where(F.length("word") <= LONGEST)
    # exact counts, and parts of an octave beyond: so few groups that the driver can hold them
    cell = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log2("n") * 64)).cast("long")
    cells = sorted(((r[0], r[1]) for r in short.groupBy(cell.alias("c")).count().collect()), reverse=True)
    total, least = 0, None
    for c, n in cells:
        if (total := total + n) > FREQUENT:
            break
        least = c
    some = short.where(cell >= least) if least is not None else short.where("false")
    row = some.repartition(1).mapInArrow(_list, "blob binary").first()
    return bytes(row["blob"]) if row else next(_list(iter([])))["blob"][0].as_py()


def _ids(blob, size: int):
    """Documents -> the network's ids of each (END last, little-endian int32), what is known of the words outside it, and rare words' hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = _listed(blob.value)
        log = np.log10(counts + 1.0)
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            flat, edges = _split(batch.column("text"))
            rank = np.asarray(pc.fill_null(pc.index_in(flat, words), -1))
            n = len(edges) - 1
            doc = np.repeat(np.arange(n), np.diff(edges))
            common, outside = rank >= 0, (rank >= size - 2) | (rank < 0)
            logs = np.where(common, log[rank] if len(log) else 0.0, 0.0)
            ids = np.empty(len(rank) + n, "<i4")
            ends = edges[1:] + np.arange(n)
            ids[ends] = END
            ids[np.delete(np.arange(len(ids)), ends)] = np.where(outside, UNKNOWN, rank + 2)
            rare = np.flatnonzero(~common)
            hashes = [xxhash.xxh64_intdigest(w, 42) for w in flat.take(pa.array(rare)).cast(pa.binary()).to_pylist()]
            hashes = pa.array(np.array(hashes, np.uint64).view(np.int64))
            blobs = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * np.concatenate([[0], ends + 1])).astype(np.int32)), pa.py_buffer(ids)])
            per = lambda x: np.bincount(doc, weights=x, minlength=n)
            whole = lambda x: pa.array(per(x).astype(np.int64))
            columns = {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "row": pa.array((part << 33) + nth + np.arange(n)),
                "n_tokens": pa.array(np.diff(edges) + 1),
                "n_common": whole(common),
                "log_common": pa.array(per(logs)),
                "log_outside": pa.array(per(np.where(outside, logs, 0.0))),
                "n_outside": whole(outside),
                "ids": blobs,
                "rare": pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, edges).astype(np.int32)), hashes),
            }
            nth += n
            yield pa.record_batch(columns)

    return rows


FACTS = "row long, n_tokens long, n_common long, log_common double, log_outside double, n_outside long, ids binary, rare array<long>"


def _docs(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<i4") for x in column]


def _train(start, counts: np.ndarray | None):
    """A shard's training documents -> its weights, in pieces, with its tokens. start: a broadcast of weights, or None for those that counts give."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(counts) if start is None else Network(weights=_unpacked(start.value))
        chunk, tokens, n = [], 0, 0
        for batch in batches:
            for d in _docs(batch.column("ids")):
                chunk.append(d.copy())
                n += len(d)
                if n >= CHUNK:
                    taught(net, chunk)
                    chunk, tokens, n = [], tokens + n, 0
        taught(net, chunk)
        if tokens + n:
            part, flat = TaskContext.get().partitionId(), np.concatenate([w.ravel() for w in net.weights]).astype("<f4").tobytes()
            for k in range(0, len(flat), PIECE):
                yield pa.record_batch({"node": [part], "piece": [k // PIECE], "n": [tokens + n], "blob": pa.array([flat[k : k + PIECE]], pa.binary())})

    return rows


def _unpacked(blob: tuple[int, bytes]) -> list[np.ndarray]:
    """The weights of a network of so many outcomes from their bytes."""
    size, flat = blob[0], np.frombuffer(blob[1], "<f4")
    out = []
    for s in shapes(size):
        n = int(np.prod(s))
        out.append(flat[:n].reshape(s).copy())
        flat = flat[n:]
    return out


def _mean(part: pa.Table) -> pa.Table:
    part = part.sort_by("node")
    n = np.asarray(part["n"], np.float64)
    total = sum(np.frombuffer(b.as_py(), "<f4").astype(np.float64) * x for b, x in zip(part["blob"], n, strict=True))
    mean = pa.array([(total / n.sum()).astype("<f4").tobytes()], pa.binary())
    first = [pa.array([part[c][0].as_py()], pa.int64()) for c in ("to", "piece")]
    return pa.table([*first, pa.array([int(n.sum())], pa.int64()), mean], names=["node", "piece", "n", "blob"])


def _score(weights):
    """Documents, those of like lengths together -> the natural log-probability of each one's ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights=_unpacked(weights.value))
        for batch in batches:
            docs = _docs(batch.column("ids"))
            ends = np.cumsum([len(d) for d in docs])
            cuts = np.searchsorted(ends, np.arange(FLUSH, ends[-1] + FLUSH, FLUSH)) + 1 if len(docs) else []
            p, at = [], 0
            for cut in np.unique(np.minimum(cuts, len(docs))).tolist():
                p.append(scored(net, docs[at:cut]))
                at = cut
            yield batch.drop_columns(["ids"]).append_column("net", pa.array(np.concatenate([np.zeros(0), *p])))

    return rows


def _pieces(rows: DataFrame) -> bytes:
    return b"".join(bytes(r["blob"]) for r in rows.orderBy("piece").select("blob").collect())


def learnt(rows: DataFrame, size: int, counts: np.ndarray, tokens: int):
    """A broadcast of the network's (size, weights) after one pass over the training rows (doc_id, n_tokens, ids).

    Rows are dealt to shards by a hash, in order of it within a shard: what is learnt does not depend on how the table is split. Every
    shard goes on from a common start, learnt in one task from some WARM tokens (the lowest part of the hash's range, without texts of
    an eighth of that; all rows train in their shard). The shards' weights are averaged by tokens in a tree, piece by piece, so that no task holds more than FAN_IN pieces. One network is what the driver gets.
    """
    context = rows.sparkSession.sparkContext
    schema = "node long, piece long, n long, blob binary"
    # copies without a doc_id are told apart by where they stand, so that no shard gets them all
    at = F.xxhash64("doc_id", "ids", F.when(F.col("doc_id").isNull(), F.col("row")))
    rows = rows.select("n_tokens", "ids", at.alias("at"))
    share = min(1.0, WARM / max(1, tokens))
    warm = rows.where((F.col("n_tokens") <= WARM // 8) & (F.col("at") / F.lit(2.0**64) + 0.5 <= share)).dropDuplicates(["at"])
    warm = warm.select("at", "ids").repartition(1).sortWithinPartitions("at").mapInArrow(released(_train(None, counts)), schema)
    plain = np.concatenate([w.ravel() for w in Network(counts).weights]).astype("<f4").tobytes()
    start = context.broadcast((size, _pieces(warm) or plain))
    shards = max(1, round(tokens / max(SHARD, PER_OUTCOME * size)))
    dealt = rows.repartition(shards, "at").sortWithinPartitions("at").select("ids")
    parts = written(dealt.mapInArrow(released(_train(start, None)), schema), "lm-train")
    width = (parts.agg(F.max("node")).first()[0] or 0) + 1
    while width > 1:
        parts = parts.withColumn("to", F.floor(F.col("node") / FAN_IN).cast("long")).groupBy("to", "piece").applyInArrow(_mean, schema)
        width = -(-width // FAN_IN)
    return context.broadcast((size, _pieces(parts) or start.value[1]))


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt where held_out is not true.

    Tokens are words and one end per document, also of an empty or null text. base_score: add-one unigrams with exact counts of all
    training tokens (up to 64-bit hashes of rare words). score: the network's log10 probability of the whole text; a word outside its
    vocabulary, which grows with the training tokens, has the network's probability of an unknown word times its own add-one share
    among these, so that both scores are of one set of outcomes.
    All training documents train the network. Without any the weights are the initial ones and N is 0; an empty table gives no rows. Rows
    that repeat count and are scored each; ties, and other columns whatever their names, play no part.
    """
    context = docs.sparkSession.sparkContext
    all_ = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    train = all_.where("not held_out")
    found = train.select("text").mapInArrow(released(_counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = written(found, "lm-words")
    n_docs = train.count()
    words, kinds = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = words + n_docs, kinds + (n_docs > 0)
    blob = frequent(found)
    counts = _listed(blob)[1]
    size = min(max(LEAST, int(GROWTH * n**POWER)), max(LEAST, len(counts) + 2))
    inside = counts[: size - 2]
    rough = np.zeros(size)
    rough[2 : 2 + len(inside)] = inside
    rough[UNKNOWN], rough[END] = words - int(inside.sum()), n_docs
    listed = context.broadcast(blob)
    rows = written(all_.mapInArrow(released(_ids(listed, size)), f"doc_id {dict(all_.dtypes)['doc_id']}, held_out boolean, {FACTS}"), "lm-ids")
    weights = learnt(rows.where("not held_out"), size, rough, n)
    facts = rows.drop("rare")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in facts.drop("ids").schema) + ", net double"
    net = facts.sortWithinPartitions(F.col("n_tokens").desc()).mapInArrow(released(_score(weights)), schema)
    # the few words not in the list: their counts by a join, summed for each row
    least = F.length("word") > LONGEST if len(counts) else F.lit(True)
    if len(counts):
        least = least | (F.col("n") < int(counts[-1]))
    others = found.where(least).select(F.xxhash64("word").alias("h"), "n")
    rare = rows.select("row", F.explode("rare").alias("h")).join(others, "h").groupBy("row")
    rare = rare.agg(F.sum(F.log10(F.col("n") + 1)).alias("log_rare"), F.count("*").alias("n_rare"))
    outside = (words - int(inside.sum())) + (kinds - len(inside)) + 1
    known = F.lit(1 if n_docs else 0)
    out = net.join(rare, "row", "left").withColumn("log_rare", F.coalesce("log_rare", F.lit(0.0)))
    end = float(np.log10(n_docs + 1.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + known).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_common") + end + F.col("log_rare") - F.col("n_tokens") * float(np.log10(n + v + 1.0))).alias("base_score"),
        (F.col("net") / float(np.log(10)) + F.col("log_outside") + F.col("log_rare") - F.col("n_outside") * float(np.log10(max(1, outside)))).alias("score"),
    )


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learnt from those whose crc32(doc_id) mod 7 is not 2."""
    return score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
