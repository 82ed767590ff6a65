import struct

import pytest
from pyspark.sql import functions as F

from lexigrid.functions.text import Analyzer
from lexigrid.operators import index, transfer
from lexigrid.sources import readers, sinks


def test_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<root><DOC><DOCNO> 7 </DOCNO><HEADLINE> H </HEADLINE><TEXT>\nbody\n</TEXT></DOC><DOC><DOCNO>8</DOCNO></DOC></root>")
    rows = {r.doc_id: r for r in readers.trec_xml(spark, str(tmp_path / "d.xml")).collect()}
    assert rows[7].headline == "H" and rows[7].body.strip() == "body" and rows[8].body is None


def test_json_tsv_csv(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"id": "a", "fields": {"headline": "h", "bodyText": "b"}}\n{"id": "c"}\n')
    assert {tuple(r) for r in readers.news_json(spark, str(tmp_path / "n.json")).collect()} == {("a", "h", "b"), ("c", None, None)}
    (tmp_path / "c.tsv").write_text("OT\tin the \"beginning\nNT\tword\n")
    assert {tuple(r) for r in readers.corpus_tsv(spark, str(tmp_path / "c.tsv"), {"OT": 1, "NT": 2}).collect()} == {("OT", 1, 'in the "beginning'), ("NT", 2, "word")}
    with pytest.raises(Exception, match="unknown corpus"):
        readers.corpus_tsv(spark, str(tmp_path / "c.tsv"), {"OT": 1}).collect()
    (tmp_path / "v.csv").write_text("id,b,c,v,t\n1,39,1,1,old\n2,40,1,1,new\n")
    assert {tuple(r) for r in readers.verse_csv(spark, str(tmp_path / "v.csv")).collect()} == {(1, "old"), (2, "new")}
    (tmp_path / "r.csv").write_text("system_number,query_number,doc_number\n1,1,30\n1,1,10\n")
    assert [(r["rank"], r.doc_id) for r in readers.run_csv(spark, str(tmp_path / "r.csv")).orderBy("rank").collect()] == [(1, 30), (2, 10)]


def test_text_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("one\n\n\n\ntwo\nlines")
    assert [tuple(r) for r in readers.paragraphs(spark, str(tmp_path / "p.txt")).collect()] == [(0, "one"), (2, "two\nlines")]
    (tmp_path / "l.txt").write_bytes(b"a\r\nb\r\nc\r\n")
    assert [tuple(r) for r in readers.lines(spark, str(tmp_path / "l.txt"), 1).collect()] == [(1, "b"), (2, "c")]
    assert readers.word_list(spark, str(tmp_path / "l.txt")) == {"a", "b", "c"}
    (tmp_path / "q.txt").write_text("1 first one\n2 b AND c\n1 last\n")
    assert {tuple(r) for r in readers.queries(spark, str(tmp_path / "q.txt")).collect()} == {(1, "last"), (2, "b AND c")}
    (tmp_path / "s.txt").write_text("0 a b\n0 c\n1 d\n")
    s = readers.by_document(readers.sentence_lines(readers.lines(spark, str(tmp_path / "s.txt"))))
    assert {r.doc_id: r.tokens for r in s.collect()} == {0: ["a", "b", "c"], 1: ["d"]}


def test_chunks(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(bytes(range(250)) * 10)
    c = readers.file_chunks(spark, str(tmp_path / "f.bin")).orderBy("seq").collect()
    assert [len(r.payload) for r in c] == [1024, 1024, 452] and [r.is_last for r in c] == [False, False, True]
    assert b"".join(bytes(r.payload) for r in c) == bytes(range(250)) * 10


def test_pcap(spark, tmp_path):
    v4 = b"\0" * 12 + b"\x08\0" + bytes([0x45, 0]) + struct.pack(">H", 60) + b"\0" * 5 + bytes([6]) + b"\0\0" + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + struct.pack(">HH", 1234, 80) + b"\0" * 9 + bytes([2]) + b"\0" * 6
    v6 = b"\0" * 12 + b"\x86\xdd" + b"\x60\0\0\0" + struct.pack(">HBB", 20, 6, 64) + b"\0" * 15 + b"\1" + b"\0" * 15 + b"\2" + struct.pack(">HH", 1, 2) + b"\0" * 9 + bytes([18]) + b"\0" * 6
    arp = b"\0" * 12 + b"\x08\x06" + b"\0" * 40
    rec = lambda f, s: struct.pack("<IIII", s, 500000, len(f), len(f)) + f
    (tmp_path / "t.pcap").write_bytes(b"\xd4\xc3\xb2\xa1" + b"\0" * 20 + rec(v4, 1) + rec(arp, 2) + rec(v6, 3))
    rows = readers.pcap(spark, str(tmp_path / "t.pcap")).orderBy("seq").collect()
    assert [(r.seq, r.src_ip, r.dst_port, r.flags, r.ip_version, r.bytes) for r in rows] == [(0, "10.0.0.1", 80, 2, 4, 40), (2, "::1", 2, 18, 6, 20)]
    assert rows[0].ts == 1.5


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a"), (2, "a")], "doc_id long, body string")
    p = index.postings(Analyzer().explode(docs, "body"))
    sinks.index_dump(p, str(tmp_path / "i"))
    assert text_of(tmp_path / "i") == "a:2\n\t1: 1\n\t2: 0\nb:1\n\t1: 0\n"
    sinks.table(p, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    rows = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 3, 0.25)], "qid int, rank int, doc_id long, score double")
    sinks.ranked_results(rows, str(tmp_path / "r"))
    assert text_of(tmp_path / "r") == "1,5,0.5000\n1,3,0.2500\n"
    sinks.boolean_results(rows.select("qid", "doc_id"), str(tmp_path / "b"))
    assert text_of(tmp_path / "b") == "1, 3\n1, 5\n"
    old = spark.createDataFrame([("a", 1, 9), ("b", 1, 1)], "id string, v int, n int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2)], "id string, v int, n int")
    assert {tuple(r)[:2] for r in sinks.upsert(old, new, "id", "n").collect()} == {("a", 3), ("b", 1)}
    s = spark.createDataFrame([(0, 0, ["a", "b"]), (1, 1, ["c"])], "doc_id long, line_no long, tokens array<string>")
    sinks.sentence_file(s, str(tmp_path / "s"))
    assert text_of(tmp_path / "s") == "0 a b\n1 c\n"
    sinks.json_lines(s.select("doc_id"), str(tmp_path / "j"))
    assert "doc_id" in text_of(tmp_path / "j")
    sinks.bucketed(p.select("term", "doc_id", "tf"), "postings_bucketed", "term", 4)
    assert spark.table("postings_bucketed").where(F.col("term") == "a").count() == 2
    assert transfer.in_window(F.lit(1), F.lit(1), 1) is not None
