"""Sources and sinks as queries: a table goes out through a writer, comes back through a reader, and is compared with SQL over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.operators import evaluate, ranked, terms, transfer
from lexigrid.plans.table_queries import EVAL, runs
from lexigrid.plans.text_queries import PLAIN, TOK, docs, term_dfs, tokens
from lexigrid.sources import readers, sinks
from lexigrid.sources.readers import table
from lexigrid.storage import place

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


#: A text on one line, as _items() has it.
_ONE_LINE = "replace(\"text\", chr(10), ' ')"


def _items(spark, sf) -> DataFrame:
    """Benchmark items, each on one line, in one partition by item_id."""
    text = F.translate("text", "\n", " ").alias("text")
    return table(spark, sf, "benchmark").select("item_id", text).coalesce(1).sortWithinPartitions("item_id")


def _text(rows: DataFrame, what: str, one_file: bool = False) -> str:
    """A text column as lines of text files."""
    at = place(rows.sparkSession, what)
    (rows.coalesce(1) if one_file else rows).write.text(at)
    return at


@query("io_trec_xml", "SELECT p_partkey AS doc_id, p_name AS headline, p_type AS body FROM part")
def io_trec_xml(spark, sf):
    element = lambda tag, c: F.concat(F.lit(f"<{tag}> "), F.col(c).cast("string"), F.lit(f" </{tag}>"))
    doc = F.concat(F.lit("<DOC>"), element("DOCNO", "p_partkey"), element("HEADLINE", "p_name"), element("TEXT", "p_type"), F.lit("</DOC>"))
    rows = table(spark, sf, "part").select(F.lit(1).alias("at"), doc.alias("value"))
    ends = spark.createDataFrame([(0, "<root>"), (2, "</root>")], "at int, value string")
    whole = rows.unionByName(ends).coalesce(1).sortWithinPartitions("at").select("value")
    return readers.trec_xml(spark, _text(whole, "io-xml"))


@query("io_news_json", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS headline, md5(text) AS body FROM documents")
def io_news_json(spark, sf):
    at = place(spark, "io-json")
    fields = F.struct(F.col("source").alias("headline"), F.col("text").alias("bodyText"))
    sinks.json_lines(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), fields.alias("fields")), at)
    return readers.news_json(spark, at).select("doc_id", "headline", F.md5("body").alias("body"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "io_corpus_tsv",
    f"SELECT c_mktsegment AS corpus, CAST(list_position({SEGMENTS}, c_mktsegment) AS INTEGER) AS corpus_id, c_name AS \"text\" FROM customer",
)
def io_corpus_tsv(spark, sf):
    at = place(spark, "io-tsv")
    table(spark, sf, "customer").select("c_mktsegment", "c_name").write.option("sep", "\t").csv(at)
    return readers.corpus_tsv(spark, at, {name: k + 1 for k, name in enumerate(SEGMENTS)})


@query("io_verse_csv", "SELECT CASE WHEN p_size < 40 THEN 1 ELSE 2 END AS corpus, p_name AS \"text\" FROM part")
def io_verse_csv(spark, sf):
    at = place(spark, "io-verses")
    sinks.csv(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_name"), at)
    return readers.verse_csv(spark, at)


@query("io_paragraphs", f"SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS ordinal, md5({_ONE_LINE}) AS \"text\" FROM benchmark")
def io_paragraphs(spark, sf):
    """The file's items, each of one line, with a blank line after each."""
    at = place(spark, "io-paragraphs")
    _items(spark, sf).select(F.concat("text", F.lit("\n")).alias("value")).write.text(at)
    return readers.paragraphs(spark, at).select("ordinal", F.md5("text").alias("text")).where(F.col("text") != F.md5(F.lit("")))


@query("io_lines", f"SELECT CAST(item_id AS INTEGER) AS line_no, md5({_ONE_LINE}) AS line FROM (SELECT row_number() OVER (ORDER BY item_id) - 1 AS item_id, \"text\" FROM benchmark) WHERE item_id >= 3")
def io_lines(spark, sf):
    return readers.lines(spark, _text(_items(spark, sf).select("text"), "io-lines"), 3).select("line_no", F.md5("line").alias("line"))


@query("io_query_file", f"SELECT CAST(item_id AS INTEGER) AS qid, md5({_ONE_LINE}) AS \"text\" FROM benchmark")
def io_query_file(spark, sf):
    rows = _items(spark, sf).select(F.concat_ws(" ", "item_id", "text").alias("value"))
    return readers.queries(spark, _text(rows, "io-queries", True)).select("qid", F.md5("text").alias("text"))


@query("io_word_list", "SELECT DISTINCT p_type AS word FROM part")
def io_word_list(spark, sf):
    rows = table(spark, sf, "part").select(F.concat("p_type", F.lit("\r")).alias("value"))
    words = readers.word_list(spark, _text(rows, "io-words"))
    return spark.createDataFrame([(w,) for w in sorted(words)], "word string")


_TURNS = "s AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations)"


@query("io_sentences", f"WITH {_TURNS} SELECT conv_id AS doc_id, CAST(count(*) AS INTEGER) AS sentences, CAST(sum(len(w)) AS INTEGER) AS n_tokens, md5(string_agg(array_to_string(w, ' '), ' ' ORDER BY turn)) AS digest FROM s WHERE len(w) > 0 GROUP BY conv_id")
def io_sentences(spark, sf):
    """A sentence file `<id> word word`, read back by document."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), words.alias("tokens"))
    at = place(spark, "io-sentences")
    sinks.sentence_file(rows.where(F.size("tokens") > 0).coalesce(1), at)
    found = readers.by_document(readers.sentence_lines(readers.lines(spark, at)))
    return found.select("doc_id", F.size("sentences").alias("sentences"), F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("io_file_chunks", "SELECT 1 AS files, sum(octet_length(encode(\"text\")) + 1)::BIGINT AS bytes, ceil(sum(octet_length(encode(\"text\")) + 1) / 1024)::BIGINT AS chunks FROM benchmark")
def io_file_chunks(spark, sf):
    """A file in chunks of 1024 bytes: their number, and that they make up the file again."""
    at = _text(table(spark, sf, "benchmark").select("text"), "io-chunks", True)
    got = readers.file_chunks(spark, f"{at}/part-*")
    whole = transfer.completeness(got).where("complete")
    sizes = got.groupBy("transfer_id").agg(F.sum(F.octet_length("payload")).alias("bytes"), F.count("*").alias("chunks"))
    return sizes.join(whole, "transfer_id").agg(F.count("*").cast("int").alias("files"), F.sum("bytes").alias("bytes"), F.sum("chunks").alias("chunks"))


@query("io_boolean_results", f"WITH {TOK} SELECT DISTINCT '1, ' || doc_id AS value FROM tok WHERE term = 'der'")
def io_boolean_results(spark, sf):
    rows = tokens(spark, sf, ["der"]).select(F.lit(1).alias("qid"), "doc_id").distinct()
    at = place(spark, "io-boolean")
    sinks.boolean_results(rows, at)
    return spark.read.text(at)


@query(
    "io_ranked_results",
    f"""WITH {TOK}, c AS (SELECT doc_id, round(count(*) / 7.0::DOUBLE, 4) AS score FROM tok WHERE term = 'ther' GROUP BY doc_id),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c) SELECT '4,' || doc_id || ',' || printf('%.4f', score) AS value FROM r WHERE rank <= 150""",
)
def io_ranked_results(spark, sf):
    rows = tokens(spark, sf, ["ther"]).groupBy("doc_id").agg(F.round(F.count("*") / F.lit(7.0), 4).alias("score"))
    at = place(spark, "io-ranked")
    sinks.ranked_results(ranked.top_k(rows.withColumn("qid", F.lit(4)), ["qid"], "score", 150), at)
    return spark.read.text(at)


@query(
    "io_metrics_csv",
    f"""WITH {EVAL}, mm AS (SELECT system, query::VARCHAR AS query, {', '.join(evaluate.METRICS)} FROM e UNION ALL SELECT system, 'mean', {', '.join(f'avg({c})' for c in evaluate.METRICS)} FROM e GROUP BY system)
SELECT CAST(system AS INTEGER) AS system, query, {', '.join(f'round({c}, 3) AS {c}' for c in evaluate.METRICS)} FROM mm""",
)
def io_metrics_csv(spark, sf):
    """Rows per query and a mean row per system, to three places."""
    at = place(spark, "io-metrics")
    sinks.metrics(evaluate.metrics(*runs(spark, sf)), at)
    return readers.csv_table(spark, at, "system int, query string, " + ", ".join(f"{m} double" for m in evaluate.METRICS))


_CLASSES = ["de", "en", "es", "fr"]


@query(
    "io_classification_csv",
    f"""WITH p AS (SELECT lang AS label, source AS split, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS pred FROM documents),
g AS (SELECT s.split, c.class FROM (SELECT DISTINCT split FROM p) s, (SELECT unnest({_CLASSES}) AS class) c),
k AS (SELECT g.split, g.class, count(*) FILTER (label = class) AS real, count(*) FILTER (pred = class) AS said, count(*) FILTER (label = class AND pred = class) AS tp FROM g JOIN p USING (split) GROUP BY ALL),
r AS (SELECT split, class, coalesce(tp::DOUBLE / nullif(said, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(real, 0), 0) AS r FROM k),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM r)
SELECT 'baseline' AS system, split, {', '.join(f"round(max({m}) FILTER (class = '{c}'), 3) AS {m}_{c}" for c in _CLASSES for m in "prf")}, {', '.join(f"round(avg({m}), 3) AS {m}_macro" for m in "prf")} FROM f GROUP BY split""",
)
def io_classification_csv(spark, sf):
    """A row per system and split: precision, recall and F1 of each class, and their means."""
    pred = F.when(F.col("doc_id") % 7 == 0, "en").otherwise(F.col("lang"))
    rows = table(spark, sf, "documents").select(F.lit("baseline").alias("system"), F.col("source").alias("split"), F.col("lang").alias("label"), pred.alias("pred"))
    at = place(spark, "io-classes")
    report = evaluate.report(rows, _CLASSES)
    sinks.csv(report, at)
    return readers.csv_table(spark, at, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in report.schema))


@query("io_index_dump", f"WITH {TOK}, p AS (SELECT term, doc_id, string_agg(pos, ', ' ORDER BY pos) AS s FROM tok GROUP BY term, doc_id) SELECT term || ':' || count(*) AS line FROM p GROUP BY term UNION ALL SELECT chr(9) || doc_id || ': ' || s FROM p")
def io_index_dump(spark, sf):
    at = place(spark, "io-index")
    sinks.index_dump(terms.postings(docs(spark, sf), PLAIN, "text"), at, term_dfs(spark, sf))
    return spark.read.text(at).withColumnRenamed("value", "line")


@query("io_upsert", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def io_upsert(spark, sf):
    """Events in two commits; of each user the last event stays."""
    rows = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "event_type")
    early = sinks.upsert(None, rows.where("event_id % 2 = 0"), "user_id", "at")
    at = place(spark, "io-upsert")
    sinks.table(early, at)
    both = spark.read.parquet(at).unionByName(rows.where("event_id % 2 = 1"))
    return sinks.upsert(None, both, "user_id", "at").select("user_id", "event_id", "event_type")


@query("io_joined_lines", "SELECT array_to_string(string_split(p_type, ' '), ' ') AS value FROM part")
def io_joined_lines(spark, sf):
    at = place(spark, "io-joined")
    sinks.joined_lines(table(spark, sf, "part").select(F.col("p_partkey").alias("line_no"), F.split("p_type", " ").alias("tokens")), at)
    return spark.read.text(at)
