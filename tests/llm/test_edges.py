"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: a defined result and no crash, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrid.llm import embedding_dedup, jaccard_join, language_model, mixing, packing, pii, secrets, suffix_dedup, topk_search, toxicity
from lexigrid.llm.common import numbered

LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, "a plain text of a few words here", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \t\n ", "en", "", 4), (5, LONG, "en", "s", 1),
    (6, "a plain text of a few words here", "en", "t", 1), (6, "a plain text of a few words here", "en", "t", 1), (6, "another text under one id", "en", "t", 1), (None, "no id at all", "en", "s", 1), (None, None, "en", "s", 1), (9, "x" * 50_000, "en", "s", 1), (10, "😀".encode("utf-16", "surrogatepass").decode("utf-16") + " \x00 İı ſ", "en", None, 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["score", "size", "node", "h", "ord", "row", "rep", "key", "id", "n", "__row", "__again", "__entities", "predicted", "component", "n_entities", "sha", "type", "canon", "n_low", "held_out", "ids", "v", "cell", "at"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (5, None, 1), (6, 0, 1), (6, 0, 0), (None, 1, 1), (77, 1, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "secrets": lambda d, labels: secrets.scan(d),
    "toxicity": lambda d, labels: toxicity.score(d, toxicity.train(d, labels), ["doc_id"]),
    "packing": lambda d, labels: packing.pack(d, packing.default_vocabulary()),
    "pii": lambda d, labels: pii.anonymise(d),
    "suffix": lambda d, labels: suffix_dedup.remove_repeats(d, 100),
    "lm": lambda d, labels: language_model.score(d, F.col("doc_id") % 7 == 2),
    "jaccard": lambda d, labels: jaccard_join.join_components(d, 4, 85, 100),
    "mixing": lambda d, labels: mixing.mix(d, [5, 2, 1]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_each(docs, labels, name):
    got = OPERATORS[name](docs, labels).collect()
    if name == "packing":
        assert sum(r.length for r in got if r.start == 0) and {r.doc_id for r in got} == {r[0] for r in ROWS}
    else:
        assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(none, labels, name):
    assert OPERATORS[name](none, labels).collect() == []


def test_no_labels(docs, labels):
    got = OPERATORS["toxicity"](docs, labels.where("false")).collect()
    assert {r["score"] for r in got} == {0.5}


def test_values(docs, labels):
    s = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, 100).collect()}
    assert s[2].n_bytes == 0 and s[2].kept_sha256 == hashlib.sha256(b"").hexdigest() and s[5].n_removed > 300_000 and s[9].n_removed == 49_999
    j = jaccard_join.join_components(docs, 4, 85, 100)
    assert {(r.doc_id, r.component_id) for r in j.collect()} >= {(1, 1), (6, 1), (6, 6), (2, 2), (3, 3), (4, 4), (None, None)}
    t = {r.doc_id: r.text for r in pii.anonymise(docs).collect()}
    assert t[5] == LONG and t[2] is None and t[3] == ""
    w = language_model.score(docs, F.lit(False)).collect()
    assert {r.n_tokens for r in w if r.doc_id in (2, 3, 4)} == {1}


def test_pipeline_stages(spark, docs, labels, tmp_path):
    at = str(tmp_path)
    labels.write.parquet(f"{at}/labels.parquet")
    docs.drop("__row").write.parquet(f"{at}/documents.parquet")
    for d in (spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/documents.parquet").where("false")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            n = d.count()
            d = stage(spark, d, at)
            d = spark.createDataFrame(d.collect(), d.schema)
            if k < 4:
                assert d.columns == corpus_pipeline.COLUMNS
            if k == 2:
                assert d.count() == n
    assert corpus_pipeline.run(spark, at).count() > 0


VECTORS = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.01], 1), (12, [float("inf"), 1.0], 1), (13, [1e-200, 0.0], 1)]


def test_vectors(spark):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(v, 0.93).collect()
    assert len(got) == len(VECTORS)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (4, 1, True) and by[2] == (4, 1, False) and by[11] == (4, 1, False) and by[13] == (4, 1, False)
    assert all(by[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 12))
    assert embedding_dedup.near_duplicates(v.where("false"), 0.93).collect() == []
    assert embedding_dedup.near_duplicates(v.select("*", *[F.lit("x").alias(c) for c in CLASH if c != "v"]), 0.93).count() == len(VECTORS)
    q = v.select("vec_id", F.col("embedding").alias("v")).select("*", *[F.lit("x").alias(c) for c in [*CLASH, "own", "times", "block", "shard"] if c != "v"])
    top = topk_search.top_k(q, q.where("vec_id in (1, 3, 10)"), 3).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(top, key=lambda r: (r.query_id, r["rank"]))] == [(1, 1, 2), (1, 2, 2), (1, 3, 8)]
    assert topk_search.top_k(q.where("false"), q, 2).collect() == [] == topk_search.top_k(q, q.where("false"), 2).collect()


@pytest.mark.parametrize("shard", [3, 16384])
def test_top_k_with_repeated_ids(spark, shard):
    """Every row but the query's own is a candidate, also one of the query's id; rows of one id and one vector stay as many as they are."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 2)]) for i in rng.integers(0, 12, 60)] + [(1, [3.0, 3.0])] * 4
    asks = [k for k, r in enumerate(rows) if r[0] % 4 == 1]
    want = []
    for k in asks:
        found = sorted((-sum(x * y for x, y in zip(rows[k][1], v, strict=True)), i) for n, (i, v) in enumerate(rows) if n != k)[:5]
        want += [(rows[k][0], rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = [tuple(r) for r in topk_search.top_k(df, df.where("vec_id % 4 = 1"), 5, 4, shard, 2).collect()]
    assert sorted(got) == sorted(want)


def test_numbers_in_order(spark):
    """Repeated and null ids: numbers without a gap, by doc_id and the text's digest; a key of many rows is more than one partition's."""
    rows = [(None, "x")] * 300 + [(k % 7, f"t{k % 3}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = numbered(df.withColumn("digest", F.xxhash64("text")), "row").collect()
    assert sorted(r["row"] for r in got) == list(range(1, 401))
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.digest)
    by = sorted(got, key=lambda r: r["row"])
    assert [key(r) for r in by] == sorted(map(key, got)) and [r.doc_id for r in by[:300]] == [None] * 300
    assert {r.doc_id: r["row"] for r in numbered(df.where("doc_id > 0").dropDuplicates(["doc_id"]), "row").collect()} == {k: k for k in range(1, 7)}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_vocabulary(name):
    """Ids are the library's also for a file that cuts texts in another way."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = ["Hello, World!  It's 2024 now.", " Ünïcödé ДА\n\n漢字 x", "", None, "a'LL b"]
    want = [np.array([*(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids if t else []), packing.END_ID], "<u4").tobytes() for t in texts]
    assert packing.token_bytes(texts, path) == want
