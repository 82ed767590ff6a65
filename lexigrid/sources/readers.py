"""Readers: XML, JSON lines, delimited text, paragraphs, word lists, queries, packet captures, files in chunks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trec_xml(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, headline, body), trimmed; a missing child is null."""
    raw = spark.read.format("xml").option("rowTag", "DOC").schema("DOCNO string, HEADLINE string, TEXT string").load(path)
    return raw.select(F.trim("DOCNO").try_cast("long").alias("doc_id"), F.trim("HEADLINE").alias("headline"), F.trim("TEXT").alias("body"))


def news_json(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, headline, body) of JSON lines with nested fields."""
    return spark.read.schema("id string, fields struct<headline:string, bodyText:string>").json(path).select(F.col("id").alias("doc_id"), F.col("fields.headline").alias("headline"), F.col("fields.bodyText").alias("body"))


def corpus_tsv(spark: SparkSession, path: str, names: dict[str, int]) -> DataFrame:
    """(corpus, corpus_id, text); an unknown name raises when the row is read."""
    rows = spark.read.schema("corpus string, text string").option("sep", "\t").option("quote", "").csv(path)
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rows.select("corpus", F.coalesce(F.try_element_at(known, F.col("corpus")), F.raise_error(F.concat(F.lit("unknown corpus "), F.col("corpus"))).cast("int")).alias("corpus_id"), "text")


def verse_csv(spark: SparkSession, path: str, first_new: int = 40) -> DataFrame:
    """(corpus, text): books before first_new are corpus 1, others 2. Columns by place: the book is the second, the text the fifth."""
    rows = spark.read.option("header", True).csv(path)
    book = F.col(f"`{rows.columns[1]}`").cast("int")
    return rows.select(F.when(book < first_new, 1).otherwise(2).alias("corpus"), F.col(f"`{rows.columns[4]}`").alias("text"))


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, text) of pieces between blank lines, of one file; empty pieces are dropped after numbering."""
    pieces = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n\n")).alias("ordinal", "text"))
    return pieces.where("text <> ''")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def run_csv(spark: SparkSession, path: str) -> DataFrame:
    """(system, query, rank, doc_id) of a run of one file whose order is the rank."""
    rows = csv_table(spark, path, "system_number int, query_number int, doc_number long").withColumn("__n", F.monotonically_increasing_id())
    rank = F.row_number().over(Window.partitionBy("system_number", "query_number").orderBy("__n"))
    return rows.select(F.col("system_number").alias("system"), F.col("query_number").alias("query"), rank.alias("rank"), F.col("doc_number").alias("doc_id"))


def lines(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(line_no, line) of one file, from line `skip` on, numbered from 0 at the file's start."""
    every = F.split("value", "\r?\n")
    # a last line that is empty is the end of the one before
    kept = F.transform(F.array(every), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))[0]
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(kept).alias("line_no", "line"))
    return rows.where(F.col("line_no") >= skip)


def word_list(spark: SparkSession, path: str) -> frozenset[str]:
    """The distinct lines of a list of words; a list is small by its nature."""
    return frozenset(r[0] for r in spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r$", ""))).where("trim(value) <> ''").collect())


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text) of lines `<int> <text>`; of a repeated id the last counts."""
    rows = lines(spark, path).select("line_no", F.regexp_extract("line", r"^(\d+) (.*)$", 1).try_cast("int").alias("qid"), F.regexp_extract("line", r"^(\d+) (.*)$", 2).alias("text"))
    return rows.where("qid is not null").groupBy("qid").agg(F.max_by("text", "line_no").alias("text"))


def sentence_lines(rows: DataFrame) -> DataFrame:
    """(line_no, line `<doc_id> tok tok`) -> (doc_id, line_no, tokens)."""
    parts = F.split("line", " ", -1)
    return rows.select(F.get(parts, F.lit(0)).try_cast("long").alias("doc_id"), "line_no", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("tokens"))


def by_document(sentences: DataFrame) -> DataFrame:
    """(doc_id, sentences, tokens): a document's sentences in the order of their lines, and flat."""
    out = sentences.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "tokens"))).alias("s"))
    return out.select("doc_id", F.transform("s", lambda x: x["tokens"]).alias("sentences"), F.flatten(F.transform("s", lambda x: x["tokens"])).alias("tokens"))


def file_chunks(spark: SparkSession, path: str, size: int = 1024, first: int = 0) -> DataFrame:
    from lexigrid.operators.transfer import chunks

    return chunks(spark.read.format("binaryFile").load(path).select(F.col("path").alias("transfer_id"), "content"), size, first)


PACKET = "seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, proto int, flags int, ip_version int, bytes long"


def pcap(spark: SparkSession, path: str) -> DataFrame:
    """Packets of capture files: Ethernet frames with IPv4 or IPv6; ports and flags of TCP. bytes: after the IP header. A file is decoded in one task."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PACKET.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows = list(_packets(bytes(content)))
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, PACKET)


def _packets(data: bytes) -> Iterator[tuple]:
    order = "<" if data[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    fraction = 1e-9 if data[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e-6
    at, seq = 24, 0
    while at + 16 <= len(data):
        sec, frac, kept, _ = struct.unpack_from(f"{order}IIII", data, at)
        frame, at = data[at + 16 : at + 16 + kept], at + 16 + kept
        row = _frame(frame)
        if row:
            yield (seq, sec + frac * fraction, *row)
        seq += 1


def _frame(f: bytes) -> tuple | None:
    import ipaddress

    kind = int.from_bytes(f[12:14], "big") if len(f) >= 34 else 0
    if kind == 0x0800:
        head = (f[14] & 15) * 4
        proto, size, src, dst, at = f[23], int.from_bytes(f[16:18], "big") - head, f[26:30], f[30:34], 14 + head
    elif kind == 0x86DD and len(f) >= 54:
        proto, size, src, dst, at = f[20], int.from_bytes(f[18:20], "big"), f[22:38], f[38:54], 54
    else:
        return None
    ports = struct.unpack_from(">HH", f, at) if proto in (6, 17) and len(f) >= at + 4 else (None, None)
    flags = f[at + 13] if proto == 6 and len(f) >= at + 14 else None
    return str(ipaddress.ip_address(src)), str(ipaddress.ip_address(dst)), *ports, proto, flags, 4 if kind == 0x0800 else 6, size
