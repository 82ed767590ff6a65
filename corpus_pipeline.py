"""A corpus from raw documents: toxicity, near duplicates, personal data, mixing, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import jaccard_join, mixing, packing, pii, toxicity
from lexigrid.llm.common import numbered, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WEIGHTS = [5, 2, 1]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of those at hand, doesn't call toxic.

    A score of just 0.5 says nothing (without labels all texts have it): such documents stay. Null and empty texts have the bias alone; repeated
    rows are judged alike; rows with a null doc_id are judged, not learnt from. As in all stages but the last, an empty table gives an
    empty table, and other columns than COLUMNS, whatever their names, are left out.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model, COLUMNS).where("score <= 0.5").select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id.

    Null, empty and blank texts have no shingles and all stay. Repeated rows are copies: one stays. Rows whose doc_ids repeat or are null
    are told apart by numbers in the order of doc_id (null first) and a digest of the text.
    """
    rows = numbered(docs.select(COLUMNS), "__row")
    groups = jaccard_join.join_components(rows.select(F.col("__row").alias("doc_id"), "text"), 5, 80, 100)
    kept = written(groups.where("doc_id = component_id").select(F.col("doc_id").alias("__row")), "pipeline-kept")
    few = kept.count() <= jaccard_join.BROADCAST_IDS
    return rows.join(F.broadcast(kept) if few else kept, "__row", "left_semi").select(COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars counts the new text's characters.

    Null and empty texts stay as they are (n_chars of a null text is null); repeated rows change alike.
    """
    return pii.anonymise(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's mix takes it; of the one on a budget's edge, its first words only.

    Null, empty and blank texts have no words and are taken no time; a null source is a source; ties of the sampling keys go to the smaller
    number (doc_id, or where these repeat or are null, the place in their order). Copies of a row keep its doc_id.
    """
    rows = numbered(docs.select(COLUMNS), "__row")
    taken = mixing.mix(rows.select(F.col("__row").alias("doc_id"), "text", "source"), WEIGHTS)
    rows = rows.join(taken.select(F.col("doc_id").alias("__row"), "size", "epochs", "part"), "__row")
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    last = F.when(F.col("part") == F.col("size"), F.col("text")).otherwise(some)
    whole = F.array_repeat(F.col("text"), F.col("epochs").cast("int"))
    texts = F.when(F.col("part") > 0, F.concat(whole, F.array(last))).otherwise(whole)
    return rows.withColumn("text", F.explode(texts)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 4096: one row a piece. A null or empty text is its end id; each of repeated rows is packed."""
    return packing.pack(docs, packing.default_vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("pii_surrogates", pii_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Neither the classifier nor the tokenizer can be said in SQL; tests/llm has brute-force versions of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a table in the shared folder between any two."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
