import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexigrid.functions import maths
from lexigrid.functions.stem import porter
from lexigrid.functions.text import ALNUM, Analyzer, first_digit, line_pipeline, sentences
from lexigrid.operators import corpus, evaluate, index, laws, learn, ledger, network, quality, ranked, transfer, vectors
from lexigrid.operators.boolean import Search, parse
from lexigrid.operators.vectors import search

DOCS = [
    (1, "Hot pease", "porridge hot"),
    (2, None, "pease porridge cold"),
    (3, "", ""),
    (4, "the of", "the"),
    (5, "some like it", "hot some like it cold"),
    (6, "nine days", "old pease 9days"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, headline string, body string")


@pytest.fixture(scope="module")
def find(docs):
    s = Search(docs, Analyzer(ALNUM, stop=frozenset(["the", "of"])), "headline", "body")
    return lambda q: sorted(r[0] for r in s.answer(q).collect())


def test_boolean(find):
    assert find("pease") == [1, 2, 6]
    assert find("NOT pease") == [3, 4, 5]
    assert find("pease AND hot") == [1]
    assert find("cold OR old") == [2, 5, 6]
    assert find("pease AND NOT hot") == [2, 6]
    assert find("nine OR hot AND cold") == [5, 6]
    assert find("(nine OR hot) AND NOT cold") == [1, 6]
    assert find("the") == [] and find("zzz") == [] and find("the AND hot") == []


def test_phrase_and_proximity(find):
    assert find('"pease porridge"') == [1, 2]  # over headline and body
    assert find('"pease porridge hot"') == [1]
    assert find('NOT "pease porridge"') == [3, 4, 5, 6]
    assert find("#1(hot, porridge)") == [1]
    assert find("#3(porridge, hot)") == [1]
    assert find("#2(hot, hot)") == [1, 5]
    assert find("NOT #3(porridge, hot)") == [2, 3, 4, 5, 6]
    inside = [set(find(q)) for q in ('"some like"', "#1(some, like)", "#5(some, like)", "some AND like")]
    assert all(a <= b for a, b in zip(inside, inside[1:]))
    assert find("NOT NOT pease") == find("pease")


def test_parse_errors():
    for bad in ("a AND", "OR b", "(a", "a )"):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        parse("a AND b OR c", strict=True)


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "thy": "thy", "is": "is"}
    assert {w: porter(w) for w in pairs} == pairs


def test_stemmed_search(spark, docs):
    s = Search(docs, Analyzer(stemmer="porter"), "headline", "body")
    assert sorted(r[0] for r in s.answer("likes AND it").collect()) == [5]


def test_index(spark, docs):
    a = Analyzer(ALNUM)
    t = a.explode(docs, "headline", "body")
    p = index.postings(t)
    row = {(r.term, r.doc_id): list(r.positions) for r in p.collect()}
    assert row["hot", 1] == [0, 3] and row["pease", 2] == [0]
    half = [index.postings(t.where(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    assert sorted(map(repr, index.merge(*half).collect())) == sorted(map(repr, p.select("term", "doc_id", "tf", "positions").collect()))
    assert p.agg(F.sum("tf")).first()[0] == t.count()
    lines = [r.line for r in index.dump_lines(p).where("term = 'pease'").orderBy(F.col("doc_id").asc_nulls_first()).collect()]
    assert lines == ["pease:3", "\t1: 1", "\t2: 0", "\t6: 3"]


def test_ranked(spark, docs):
    n = docs.agg(F.count("*").alias("n"))
    t = Analyzer(ALNUM).explode(docs, "headline", "body")
    out = ranked.ranked(t, [(7, ["hot", "hot", "zzz"])], n, 5).collect()
    w = 2 * math.log10(6 / 2)
    assert [(r.qid, r["rank"], r.doc_id, r.score) for r in out] == [(7, 1, 1, round(w * (1 + math.log10(2)), 4)), (7, 2, 5, round(w, 4))]


def ndcg(rels, all_, k):
    d = lambda i: 1 if i == 1 else math.log2(i)
    return sum(r / d(i) for i, r in enumerate(rels[:k], 1)) / sum(r / d(i) for i, r in enumerate(sorted(all_, reverse=True)[:k], 1))


def test_metrics(spark):
    run = spark.createDataFrame([(1, 1, i, i) for i in range(1, 25)] + [(1, 2, i, i) for i in range(1, 5)] + [(2, 1, i, 100 + i) for i in range(1, 61)], "system int, query int, rank int, doc_id long")
    rel = spark.createDataFrame([(1, 2, 3), (1, 5, 1), (1, 22, 2), (1, 99, 1), (2, 3, 2)], "query int, doc_id long, rel int")
    got = {(r.system, r.query): r for r in evaluate.metrics(run, rel).collect()}
    x = got[1, 1]
    assert (x.p10, x.r50, x.rprec) == (0.2, 0.75, 0.25)
    assert x.ap == pytest.approx((1 / 2 + 2 / 5 + 3 / 22) / 4)
    rels = [3 if i == 2 else 1 if i == 5 else 2 if i == 22 else 0 for i in range(1, 25)]
    assert x.ndcg10 == pytest.approx(ndcg(rels, [3, 1, 2, 1], 10)) and x.ndcg20 == pytest.approx(ndcg(rels, [3, 1, 2, 1], 20))
    assert got[1, 2].p10 == 0.1 and got[1, 2].ap == pytest.approx(1 / 3) and got[1, 2].ndcg10 > 0
    assert {(r.system, r.query): r.ndcg10 for r in evaluate.metrics(run, rel, strict=True).collect()}[1, 2] == 0
    assert got[2, 1].ap == 0 and got[2, 2].p10 == 0 and len(got) == 4
    assert evaluate.with_means(evaluate.metrics(run, rel)).where("query is null").count() == 2


def test_t_distribution():
    assert maths.t_cdf_two_sided(2.262157, 9) == pytest.approx(0.05, abs=1e-6)
    assert maths.t_cdf_two_sided(0.0, 9) == pytest.approx(1.0)


def test_scores(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, pred string")
    got = {r["class"]: (r.p, r.r, r.f) for r in evaluate.scores(p).collect()}
    assert got["a"] == (0.5, 0.5, 0.5) and got["b"][:2] == (0.5, 1.0) and got["c"] == (0, 0, 0)


def test_corpus(spark):
    t = spark.createDataFrame([("x", 1, "u"), ("x", 2, "u"), ("y", 1, "u"), ("y", 1, "v"), ("y", 2, "v")], "corpus string, doc_id long, term string")
    sizes = spark.createDataFrame([("x", 3), ("y", 2)], "corpus string, n_docs long")
    cells = corpus.contingency(index.frequencies(t), sizes)
    rows = {(r.term, r.corpus): (r.n11, r.n10, r.n01, r.n00) for r in cells.collect()}
    assert rows["u", "x"] == (2, 1, 1, 1) and rows["v", "x"] == (0, 2, 3, 0)
    assert all(sum(v) == 5 for v in rows.values())
    s = corpus.scored(cells).collect()
    assert all(r.mi >= -1e-12 for r in s)
    assert {(r.term, r.corpus): r.chisq for r in s}["v", "x"] == pytest.approx(5.0)


def test_laws(spark):
    t = spark.createDataFrame([(d, p, term) for d, terms in ((1, "abab"), (2, "bcd"), (3, ""), (4, "dae")) for p, term in enumerate(terms)], "doc_id long, pos int, term string")
    got = {r.n: r.distinct_terms for r in laws.heaps(t, 3).collect()}
    assert got == {3: 2, 6: 3, 9: 4}
    assert [r.term for r in laws.zipf(laws.word_count(t), 2).orderBy("rank").collect()] == ["a", "b"]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 1.0])], "vec_id long, vec array<double>")
    q = v.where("vec_id = 1").select(F.col("vec_id").alias("qid"), F.col("vec").alias("qvec"))
    assert [(r.vec_id, r.sim) for r in search(v, q, 4).orderBy("rank").collect()] == [(4, 1.0), (5, 0.707107), (2, -1.0), (3, -1.0)]
    lead = vectors.leaders(v)
    assert lead.count() == 2
    got = {(r.qid, r.vec_id): r.sim for r in vectors.pruned_search(v, lead, vectors.followers(v, lead), q, 4).collect()}
    full = {(r.qid, r.vec_id): r.sim for r in search(v, q, 4).collect()}
    assert set(got) <= set(full) and all(full[k] == got[k] for k in got)


PACKET = "seq long, outbound boolean, proto int, flags int, ip_version int, src_ip long, src_port int, dst_ip long, dst_port int, bytes long"


def packet(seq, out, flags=16, proto=6, a=1, b=2, bytes_=10, version=4):
    ends = (a, 10, b, 20) if out else (b, 20, a, 10)
    return (seq, out, proto, flags, version, *ends, bytes_)


def test_flows(spark):
    p = spark.createDataFrame([packet(1, True), packet(2, False, bytes_=5), packet(3, True, b=3), packet(4, True, version=6)], PACKET)
    assert sorted(r.bytes for r in network.flow_bytes(p).collect()) == [10, 10, 15]
    rows = [packet(1, False), packet(2, True), packet(3, False), packet(4, False, a=9), packet(5, False, a=9, proto=17)]
    assert [r.allowed for r in network.allowed(spark.createDataFrame(rows, PACKET)).orderBy("seq").collect()] == [False, True, True, False, True]
    rows = [packet(0, False)] + [packet(1, False, flags=2)] + [packet(k, k % 2 == 0) for k in range(2, 15)] + [packet(15, False, flags=2), packet(16, True)]
    got = [r.seq for r in network.mirrored(spark.createDataFrame(rows, PACKET)).where("mirrored").orderBy("seq").collect()]
    assert got == list(range(1, 11)) + [15, 16]


def test_rollup(spark):
    base = 10 << 24
    p = spark.createDataFrame([(base + 1, 50), (base + 2, 3), (base + 3, 3), (base + 200, 40), (99, 4)], "src_ip long, bytes long")
    got = sorted((r.net, r.plen, r.bytes) for r in network.prefix_rollup(p, 0.05).collect())
    assert got == [(0, 0, 4), (base + 1, 32, 50), (base + 2, 31, 6), (base + 200, 32, 40)]
    assert sum(x[2] for x in got) == 100


def test_prefix_and_bits(spark):
    r = spark.range(1).select(
        maths.common_prefix(maths.ipv4(F.lit("10.0.0.0")), maths.ipv4(F.lit("10.0.128.0"))).alias("a"), maths.common_prefix(F.lit(5).cast("long"), F.lit(5).cast("long"), 24).alias("b"),
        maths.unpack_bits(F.lit(0b101_110), 3, 3).alias("c"), maths.big_endian(F.unhex(F.lit("0102"))).alias("d"), F.hex(maths.to_big_endian(F.lit(258), 2)).alias("e"), first_digit(F.lit(907)).alias("f"),
    ).first()
    assert tuple(r) == (16, 24, 5, 258, "0102", 9)


def test_transfers(spark):
    c = spark.createDataFrame([(1, 0, False, "a", 3), (1, 1, True, "b", 1), (1, 0, False, "A", 9), (2, 1, True, "y", 1), (3, 0, False, "p", 1), (3, 2, True, "r", 2)], "transfer_id long, seq int, is_last boolean, payload string, at long")
    assert [tuple(r) for r in transfer.reassembled(c, "at").collect()] == [(1, "ab")]
    got = {r.transfer_id: (r.complete, r.in_order) for r in transfer.completeness(c).collect()}
    assert got == {1: (True, 2), 2: (False, 0), 3: (False, 1)}
    last = {(r.transfer_id, r.seq): r.payload for r in transfer.deduplicated(c, "at", "last").collect()}
    assert last[1, 0] == "A"


def test_ledger(spark):
    e = spark.createDataFrame([(1, "a", "t", 5), (2, "a", "t", -7), (3, "a", "t", 4), (1, "b", "t", -2)], "seq long, account string, asset string, delta long")
    got = {r.account: (r.balance, r.ever_negative) for r in ledger.balances(e).collect()}
    assert got == {"a": (2, True), "b": (-2, True)}
    o = spark.createDataFrame([(1, 10, "x", 5, "y", 6), (2, 10, "x", 5, "y", 7)], "offer_id long, block long, give_asset string, give_amount long, want_asset string, want_amount long")
    a = spark.createDataFrame([(8, 61, "x", 5, "y", 6), (9, 60, "x", 5, "y", 6), (7, 5, "x", 5, "y", 7)], "accept_id long, block long, give_asset string, give_amount long, want_asset string, want_amount long")
    assert [tuple(r) for r in ledger.matched(o, a).collect()] == [(1, 9)]
    ev = spark.createDataFrame([("p", 1, "commit"), ("p", 31, "reveal"), ("q", 1, "commit"), ("q", 32, "reveal")], "player string, block long, kind string")
    assert [tuple(r) for r in ledger.revealed(ev).collect()] == [("p", 31)]


def test_splits(spark):
    rows = spark.range(101).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("c"))
    assert learn.split(rows).where("split = 'dev'").count() == 11
    assert {r.c: r["count"] for r in learn.split(rows, by="c").where("split = 'dev'").groupBy("c").count().collect()} == {0: 6, 1: 5}
    assert [r.n for r in learn.balanced_parts(spark.range(10), "id", 4).orderBy("part").collect()] == [3, 3, 2, 2]
    assert [(r.first, r.last, r.n) for r in learn.balanced_parts(spark.range(0, 70, 10), "id", 3).orderBy("part").collect()] == [(0, 20, 3), (30, 40, 2), (50, 60, 2)]


def test_bags(spark):
    t = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (2, 0, "b"), (2, 1, "z")], "doc_id long, pos int, term string")
    v = learn.vocabulary(t.where("doc_id = 1"))
    assert {r.term: r.term_id for r in v.collect()} == {"b": 0, "a": 1}
    bag = {(r.doc_id, r.term_id): r.n for r in learn.bag(t, v).collect()}
    assert bag == {(1, 0): 1, (1, 1): 1, (2, 0): 1, (2, 2): 1}
    assert {r.term for r in learn.unbagged(learn.bag(t, v), v).collect()} == {"a", "b", "OOV_term"}


def test_quality(spark):
    d = spark.createDataFrame([("1", "x"), ("q", "x"), ("1", "x"), (None, "y")], "n string, k string")
    assert quality.not_numeric(d, "n").count() == 1 and quality.duplicates(d, "n", "k", count="copies").collect()[0].copies == 2
    assert quality.missing(d, spark.createDataFrame([("1",), ("2",)], ["n"]), spark.createDataFrame([("x",), ("y",)], ["k"])).count() == 3 and quality.outside(d, "k", ["x"]).count() == 1


def test_text_forms(spark):
    lines = spark.createDataFrame([(0, "The Cat,"), (1, "..."), (2, "the")], "line_no long, line string")
    got = line_pipeline(lines, Analyzer(stop=frozenset(["the"]))).collect()
    assert [(r.line_no, r.tokens) for r in got] == [(0, ["cat"])]
    r = spark.range(1).select(sentences(F.lit("A head"), F.lit("One two. Three.")).alias("s")).first()
    assert [len(x) for x in r.s] == [2, 2, 1]
    assert Row(a=1).a == 1


def test_word_tables(spark):
    from lexigrid.functions.text import lemmatised

    t = spark.createDataFrame([(1, "mice"), (1, "cat")], "doc_id long, term string")
    assert {r.term for r in lemmatised(t, spark.createDataFrame([("mice", "mouse")], "term string, lemma string")).collect()} == {"mouse", "cat"}
    w = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 4.0])], "term string, vec array<double>")
    q = spark.createDataFrame([(1, "a"), (1, "b"), (1, "zz")], "qid int, term string")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "term string, df long")
    assert vectors.query_vectors(q, w, df).first().qvec == [0.5, 1.0]
    known = spark.createDataFrame([("b", [9.0, 9.0])], "term string, vec array<double>")
    assert {r.term: r.vec for r in vectors.initialised(w, known).collect()} == {"a": [1.0, 0.0], "b": [9.0, 9.0]}


def test_throughput(spark):
    c = spark.createDataFrame([(1, 0, 1000, 0.0), (1, 0, 1000, 1.0), (1, 1, 2000, 2.0)], "transfer_id long, seq int, bytes long, ts double")
    assert tuple(transfer.throughput(c).first()) == (1, 2.0, 1)


def test_support_vectors_and_corpus_topics(spark):
    """On held-out documents the linear machine tells the languages apart; topic masses of a corpus sum to 1, one is the largest."""
    from lexigrid import catalog

    rows = catalog.QUERIES["svm_predict"](spark, "/root/testdata/sf0.001").collect()
    right, every = (sum(r.n for r in rows if ok(r)) for ok in (lambda r: r.label == r.pred, lambda r: True))
    assert every >= 20 and right / every > 0.7
    mass = catalog.QUERIES["lda_corpus_topics"](spark, "/root/testdata/sf0.001").collect()
    for c in {r.corpus for r in mass}:
        own = [r for r in mass if r.corpus == c]
        assert len(own) == 20 and sum(r.mass for r in own) == pytest.approx(1, abs=1e-4) and sum(r.largest for r in own) == 1
        assert next(r.mass for r in own if r.largest) == max(r.mass for r in own)


def test_unicode_words_on_both_sides(spark):
    """A query word is cut as the index cuts it, with and without Unicode classes."""
    from lexigrid.functions.text import WORD

    docs = spark.createDataFrame([(1, "naïve café"), (2, "na ve"), (3, "ДОМ дом")], "doc_id long, text string")
    find = lambda p, q: sorted(r[0] for r in Search(docs, Analyzer(p), "text").answer(q).collect())
    assert find(WORD, "naïve") == [1] and find(WORD, "дом") == [3] and find(r"\w+", "naïve") == [1, 2] and find(r"\w+", "дом") == []


def test_topics_and_word_vectors_are_whole(spark, monkeypatch):
    """20 topics; 300 dimensions, also for words met three times."""
    from lexigrid import catalog
    from lexigrid.plans import text_queries

    sf, models, train = "/root/testdata/sf0.001", [], learn.word_vectors
    assert catalog.QUERIES["lda_topics"](spark, sf).count() == 200
    monkeypatch.setattr(learn, "word_vectors", lambda *a, **k: models.append(train(*a, **k)) or models[0])
    assert catalog.QUERIES["word2vec_neighbours"](spark, sf).count() == 10
    counts = text_queries.tokens(spark, sf).groupBy("term").count().where("count >= 3").count()
    assert models[0].getVectors().count() == counts and models[0].getVectorSize() == 300
