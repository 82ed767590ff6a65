"""Terms counted within rows: equal to tokens as rows, with nothing shuffled by document."""

import pytest
from pyspark.sql import functions as F

from lexigrid import catalog
from lexigrid.functions.text import ALNUM, Analyzer
from lexigrid.operators import index, terms

SF = "/root/testdata/sf0.001"
TEXTS = [(1, "b A b"), (1, "a c"), (2, None), (3, ""), (4, "Ä x1y É-zz  ZZ"), (None, "a"), (None, "q a"), (5, "end"), (6, "the next"), (7, " a")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("analyzer", [Analyzer(), Analyzer(ALNUM, stop=frozenset(["a"])), Analyzer(lower=False)])
def test_postings_are_those_of_tokens(texts, analyzer, monkeypatch):
    monkeypatch.setattr(terms, "SLICE", 4)
    want = sorted(map(repr, index.postings(analyzer.explode(texts, "text")).select("term", "doc_id", "tf", "positions").collect()))
    got = terms.postings(texts, analyzer, "text")
    assert sorted(map(repr, got.select("term", "doc_id", "tf", "positions").collect())) == want
    assert all((r.first_pos, r.last_pos) == (r.positions[0], r.positions[-1]) for r in got.collect())


def test_postings_summary_shuffles_nothing(spark):
    """all pairs went through a shuffle and a sort."""
    assert "Exchange" not in plan(catalog.QUERIES["postings_summary"](spark, SF))


def test_index_dump_shuffles_only_heads(spark):
    """postings were shuffled, and again for the heads."""
    dump = plan(catalog.QUERIES["index_dump"](spark, SF))
    assert "collect_list" not in dump and dump.count("Exchange hashpartitioning") == 1


def test_merge_shuffles_only_shared_documents(spark, texts):
    """F8: postings of all documents were shuffled twice."""
    assert "Exchange" not in plan(catalog.QUERIES["index_merge"](spark, SF))
    p = index.postings(Analyzer().explode(texts.where("doc_id in (5, 6)"), "text"))
    later = p.where("doc_id = 6").withColumn("positions", F.transform("positions", lambda x: x + 1))
    got = {(r.term, r.doc_id): (r.tf, r.positions) for r in index.merge(p, later).collect()}
    assert got == {("end", 5): (1, [0]), ("the", 6): (2, [0, 1]), ("next", 6): (2, [1, 2])}


def test_dump_parts_frequent_terms(spark, tmp_path):
    """a term's lines were one task's; and lines are in order over the files."""
    from lexigrid.sources import sinks

    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the").alias("text"))
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.index_dump(terms.postings(rows, Analyzer(), "text"), str(tmp_path / "dump"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    files = [f.read_text().splitlines() for f in sorted((tmp_path / "dump").glob("part-*"))]
    assert sum(files, []) == ["the:4000"] + [f"\t{k}: 0" for k in range(4000)] and max(map(len, files)) < 3000


def test_stems_of_listed_terms_alone(spark):
    """all tokens met their stems in a join, which a frequent word made one task's."""
    from lexigrid.functions.stem import porter
    from lexigrid.functions.text import stemmed
    from lexigrid.plans import text_queries

    words = [r.term for r in text_queries.tokens(spark, SF).select("term").distinct().collect()]
    words += ["relational", "hopping", "responsibility", "sensibiliti", "cries", "hoped", "sky", "happy", "activiti", "vietnamization"]
    assert all(w.startswith(porter(w)[:-2]) for w in words)
    a, d = Analyzer(stemmer="porter"), text_queries.docs(spark, SF)
    got = a.explode(d, "text", only=["ther", "ton"])
    want = stemmed(Analyzer().explode(d, "text")).where(F.col("term").isin("ther", "ton")).select("doc_id", "pos", "term")
    assert "Join" not in plan(got) and sorted(got.collect()) == sorted(want.collect()) != []


def test_candidates_are_no_rows(spark):
    """each candidate carried two vectors through a join. More queries and members than a tile has give the same."""
    from lexigrid.operators import vectors
    from lexigrid.plans import table_queries

    v, q = table_queries.embeddings(spark, SF), table_queries.asked(spark, SF)
    lead = vectors.leaders(v)
    one = vectors.pruned_search(v, lead, vectors.followers(v, lead), q, 5)
    assert "FlatMapGroupsInArrow" in plan(one)
    assert sorted(one.collect()) == sorted(vectors.pruned_search(v, lead, vectors.followers(v, lead), q, 5, query_block=2, shard=7).collect())


@pytest.mark.parametrize("name", ["bag_of_words", "doc_vector_idf", "chi_feature_filter", "chi_own_label"])
def test_rare_terms_are_joined(spark, monkeypatch, name):
    """the result doesn't depend on how many terms are looked up; with all of them, no join has tokens."""
    values = lambda: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in catalog.QUERIES[name](spark, SF).collect())
    whole = values()
    for n in (1, 50):
        monkeypatch.setattr(terms, "FREQUENT", n)
        assert values() == whole


def test_bags_of_repeated_ids_and_unknown_words(spark, texts):
    """as bag() over tokens."""
    from lexigrid.operators import learn

    t = Analyzer().explode(texts, "text")
    v = learn.vocabulary_of(texts.where("doc_id <> 4"), Analyzer(), "text")
    assert sorted(map(repr, v.select("term", "term_id").collect())) == sorted(map(repr, learn.vocabulary(t.where("doc_id <> 4")).collect()))
    got = learn.bag_of(texts, Analyzer(), "text", v)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, learn.bag(t, v.select("term", "term_id")).collect()))


def test_growth_of_a_vocabulary_without_token_rows(spark, texts):
    """tokens were rows three times."""
    from lexigrid.operators import laws

    known = texts.where("doc_id is not null and doc_id <> 1")
    got, want = laws.heaps_of(known, Analyzer(), "text", 2), laws.heaps(Analyzer().explode(known, "text"), 2)
    assert sorted(got.collect()) == sorted(want.collect()) != []
    assert "regexp_extract_all" not in plan(catalog.QUERIES["heaps"](spark, SF))


def test_topics_cache_no_tokens_and_sum_few_matrices(spark):
    """the fit cached all tokens, and iterations summed a matrix for each part of the input."""
    from pyspark.ml.feature import CountVectorizer

    from lexigrid.operators import corpus

    d = spark.createDataFrame([(k, "x", [w for i, w in enumerate("abcdefgh") if k % (i + 1) == 0] + ["a"]) for k in range(60)], "doc_id long, corpus string, tokens array<string>").repartition(40)
    model, vocabulary, distributed = corpus.topics(d, "tokens", k=2, iterations=2)
    theirs = CountVectorizer(inputCol="tokens", outputCol="v", minDF=15, maxDF=0.6).fit(d).vocabulary
    assert sorted(vocabulary) == sorted(theirs) != []
    assert distributed.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism and "tokens" not in distributed.columns


def test_split_moves_no_rows(spark):
    """rows went through a shuffle with their texts; also where a repeated id stands on the edge, the number is exact."""
    from lexigrid.operators import learn

    rows = spark.range(101).select(F.col("id").alias("row_id"), F.lit("text").alias("text"))
    assert "hashpartitioning" not in plan(learn.split(rows))
    assert learn.split(rows).where("split = 'dev'").count() == 11
    same = spark.range(50).select(F.lit(7).alias("row_id"))
    assert learn.split(same).where("split = 'dev'").count() == 5


def test_word_vectors_are_trained_by_all_cores(spark, monkeypatch):
    """one task trained on all tokens."""
    from pyspark.ml.feature import Word2Vec

    from lexigrid.operators import learn

    seen, fit = [], Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, d: seen.append(self.getNumPartitions()) or fit(self, d))
    learn.word_vectors(spark.createDataFrame([(["a", "b"] * 9,)] * 9, "tokens array<string>"), "tokens", size=4)
    assert seen == [spark.sparkContext.defaultParallelism] and seen[0] > 1
