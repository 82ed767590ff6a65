"""Queries over judgements, vectors, packets, transfers, ledgers and checks; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.operators import evaluate, learn, ledger, network, quality, ranked, transfer, vectors
from lexigrid.plans.text_queries import TOK, docs, n_docs, tokens
from lexigrid.sources.readers import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# --- rankings -----------------------------------------------------------------------------------------------------------
ASKED = [(1, ["ther"]), (2, ["tion", "ing"]), (3, ["haon", "der"]), (4, ["que"])]
_ASKED = ", ".join(f"({q}, '{t}')" for q, terms in ASKED for t in terms)
RUNS = f"""{TOK}, n AS (SELECT count(*) AS n FROM documents), a(query, term) AS (VALUES {_ASKED}),
tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
m AS (SELECT query, doc_id, tf, df, n.n, n_chars FROM a JOIN tf USING (term) JOIN df USING (term) JOIN documents USING (doc_id), n),
sc AS (SELECT 1 AS system, query, doc_id, round(sum((1 + log10(tf)) * log10(n / df)), 4) AS s FROM m GROUP BY query, doc_id
 UNION ALL SELECT 2, query, doc_id, round(sum(tf * log10(n / df)), 4) FROM m GROUP BY query, doc_id
 UNION ALL SELECT 3, query, doc_id, round(sum(tf::DOUBLE) / max(n_chars) * 1000, 4) FROM m GROUP BY query, doc_id),
runs AS (SELECT system, query, doc_id, row_number() OVER (PARTITION BY system, query ORDER BY s DESC, doc_id) AS rank FROM sc),
run AS (SELECT * FROM runs WHERE rank <= 100),
q AS (SELECT DISTINCT query, doc_id, quality + 2 * toxic AS rel FROM m JOIN labels USING (doc_id) WHERE quality + 2 * toxic > 0)"""
EVAL = f"""{RUNS}, ideal AS (SELECT query, rel, row_number() OVER (PARTITION BY query ORDER BY rel DESC, doc_id) AS i FROM q),
best AS (SELECT query, count(*) AS r, sum(CASE WHEN i <= 10 THEN rel / CASE WHEN i = 1 THEN 1 ELSE log2(i) END END) AS i10, sum(CASE WHEN i <= 20 THEN rel / CASE WHEN i = 1 THEN 1 ELSE log2(i) END END) AS i20 FROM ideal GROUP BY query),
h AS (SELECT system, query, rank, coalesce(rel, 0) AS rel, (coalesce(rel, 0) > 0)::INT AS hit FROM run LEFT JOIN q USING (query, doc_id)),
c AS (SELECT *, sum(hit) OVER (PARTITION BY system, query ORDER BY rank) AS cum FROM h),
e AS (SELECT system, query, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) / 10.0::DOUBLE AS p10, sum(CASE WHEN rank <= 50 THEN hit ELSE 0 END) / max(r)::DOUBLE AS r50,
 sum(CASE WHEN rank <= r THEN hit ELSE 0 END) / max(r)::DOUBLE AS rprec, sum(hit * cum / rank::DOUBLE) / max(r) AS ap,
 sum(CASE WHEN rank <= 10 THEN rel / CASE WHEN rank = 1 THEN 1 ELSE log2(rank) END ELSE 0 END) / max(i10) AS ndcg10,
 sum(CASE WHEN rank <= 20 THEN rel / CASE WHEN rank = 1 THEN 1 ELSE log2(rank) END ELSE 0 END) / max(i20) AS ndcg20
 FROM c JOIN best USING (query) GROUP BY system, query)"""


def runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    only = sorted({t for _, terms in ASKED for t in terms})
    asked = F.broadcast(spark.createDataFrame([(q, t) for q, terms in ASKED for t in terms], "query int, term string"))
    tf = tokens(spark, sf, only).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    chars = table(spark, sf, "documents").select("doc_id", "n_chars")
    m = tf.join(F.broadcast(df), "term").join(asked, "term").crossJoin(F.broadcast(n_docs(spark, sf))).join(chars, "doc_id")
    idf = F.log10(F.col("n") / F.col("df"))
    sums = m.groupBy("query", "doc_id").agg(F.round(F.sum((1 + F.log10("tf")) * idf), 4).alias("s1"), F.round(F.sum(F.col("tf") * idf), 4).alias("s2"), F.round(F.sum(F.col("tf").cast("double")) / F.max("n_chars") * 1000, 4).alias("s3"))
    long = sums.select("query", "doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("system"), F.col(f"s{k}").alias("s")) for k in (1, 2, 3)])).alias("x")).select("x.system", "query", "doc_id", "x.s")
    rel = F.col("quality") + 2 * F.col("toxic")
    qrels = m.select("query", "doc_id").distinct().join(table(spark, sf, "labels"), "doc_id").where(rel > 0).select("query", "doc_id", rel.alias("rel"))
    return ranked.top_k(long, ["system", "query"], "s", 100).select("system", "query", "rank", "doc_id"), qrels


def _metrics(spark, sf) -> DataFrame:
    return evaluate.metrics(*runs(spark, sf))


for _name, _cols in {"eval_p10": ["p10"], "eval_r50": ["r50"], "eval_rprec": ["rprec"], "eval_ap": ["ap"], "eval_ndcg": ["ndcg10", "ndcg20"]}.items():
    query(_name, f"WITH {EVAL} SELECT CAST(system AS INTEGER) AS system, CAST(query AS INTEGER) AS query, {', '.join(f'round({c}, 6) AS {c}' for c in _cols)} FROM e")(
        lambda spark, sf, cols=_cols: _metrics(spark, sf).select("system", "query", *[F.round(c, 6).alias(c) for c in cols])
    )


_AT = "sum(CASE WHEN rank <= {k} THEN rel / CASE WHEN rank = 1 THEN 1 ELSE log2(rank) END ELSE 0 END) / max(i{k})"
_STRICT = ", ".join(f"round(CASE WHEN coalesce(max(rank), 0) < {k} THEN 0 ELSE {_AT.format(k=k)} END, 6) AS ndcg{k}" for k in (10, 20))


@query("eval_ndcg_strict", f"WITH {EVAL} SELECT CAST(system AS INTEGER) AS system, CAST(query AS INTEGER) AS query, {_STRICT} FROM c JOIN best USING (query) GROUP BY system, query")
def eval_ndcg_strict(spark, sf):
    """nDCG as 0 where fewer were retrieved than its depth."""
    return evaluate.metrics(*runs(spark, sf), strict=True).select("system", "query", *[F.round(c, 6).alias(c) for c in ("ndcg10", "ndcg20")])


@query("eval_means", f"WITH {EVAL} SELECT CAST(system AS INTEGER) AS system, {', '.join(f'round(avg({c}), 6) AS {c}' for c in evaluate.METRICS)} FROM e GROUP BY system")
def eval_means(spark, sf):
    return evaluate.rounded(evaluate.means(_metrics(spark, sf)), 6)


@query("eval_t_stat", f"""WITH {EVAL}, mm AS (SELECT system, avg(ap) AS m FROM e GROUP BY system), b AS (SELECT system AS best FROM mm ORDER BY m DESC, system LIMIT 1),
d AS (SELECT b.best, e.system AS other, x.ap - e.ap AS d, e.ap FROM e, b, e x WHERE x.system = b.best AND x.query = e.query AND e.system <> b.best),
g AS (SELECT best, other, count(d) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd, avg(ap) AS m FROM d GROUP BY best, other)
SELECT CAST(best AS INTEGER) AS best, CAST(other AS INTEGER) AS other, CAST(n AS BIGINT) AS n, round(mean_diff, 6) AS mean_diff, round(mean_diff / (sd / sqrt(n)), 4) AS t,
 round(1 - 2 / pi() * (abs(mean_diff / (sd / sqrt(n))) / sqrt(3) / (1 + pow(mean_diff / (sd / sqrt(n)), 2) / 3) + atan(abs(mean_diff / (sd / sqrt(n))) / sqrt(3))), 6) AS p
FROM g WHERE sd > 0 ORDER BY m DESC, other LIMIT 1""")
def eval_t_stat(spark, sf):
    """The SQL has the distribution's closed form for the three degrees of freedom that four queries give."""
    rows = evaluate.with_p(evaluate.paired(_metrics(spark, sf), "ap"))
    return rows.select("best", "other", "n", *[F.round(c, places).alias(c) for c, places in (("mean_diff", 6), ("t", 4), ("p", 6))])


# --- classification -----------------------------------------------------------------------------------------------------
MARKS = {"en": "the", "de": "der", "es": "que", "fr": "les"}
PRED = f"""{TOK}, c AS (SELECT doc_id, {', '.join(f"sum((term = '{w}')::INT) AS {k}" for k, w in MARKS.items())} FROM tok GROUP BY doc_id),
p AS (SELECT lang AS label, CASE WHEN coalesce(en, 0) >= greatest(coalesce(de, 0), coalesce(es, 0), coalesce(fr, 0)) THEN 'en' WHEN de >= greatest(es, fr) THEN 'de' WHEN es >= fr THEN 'es' ELSE 'fr' END AS pred, d.doc_id FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id)"""


def predictions(spark, sf) -> DataFrame:
    times = lambda word: F.size(F.filter("w", lambda t: t == word))
    n = {k: times(w) for k, w in MARKS.items()}
    rows = docs(spark, sf).select("doc_id", F.col("lang").alias("label"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    rows = rows.select("doc_id", "label", *[v.alias(k) for k, v in n.items()])
    pred = F.expr("case when en >= greatest(de, es, fr) then 'en' when de >= greatest(es, fr) then 'de' when es >= fr then 'es' else 'fr' end")
    return rows.select("doc_id", "label", pred.alias("pred"))


PRF = f"""{PRED}, l AS (SELECT label AS class, count(*) AS real, sum((label = pred)::INT) AS tp FROM p GROUP BY label), s AS (SELECT pred AS class, count(*) AS said FROM p GROUP BY pred),
r AS (SELECT class, coalesce(tp::DOUBLE / nullif(said, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(real, 0), 0) AS r FROM l FULL JOIN s USING (class)), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM r)"""


@query("prf_class", f'WITH {PRF} SELECT class AS "class", round(p, 6) AS p, round(r, 6) AS r, round(f, 6) AS f FROM f')
def prf_class(spark, sf):
    return evaluate.scores(predictions(spark, sf)).select("class", *[F.round(c, 6).alias(c) for c in "prf"])


@query("prf_macro", f"WITH {PRF} SELECT round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(f), 6) AS f FROM f")
def prf_macro(spark, sf):
    return evaluate.macro(evaluate.scores(predictions(spark, sf))).select(*[F.round(c, 6).alias(c) for c in "prf"])


@query("confusion", f"WITH {PRED} SELECT label, pred, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL")
def confusion(spark, sf):
    return evaluate.confusion(predictions(spark, sf))


@query("misclassified", f"WITH {PRED} SELECT doc_id, label, pred FROM p WHERE label <> pred")
def misclassified(spark, sf):
    return evaluate.misclassified(predictions(spark, sf))


_H = "('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT"


@query("split_counts", f"WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY {_H}, doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT CASE WHEN k <= ceil(0.1 * n) THEN 'dev' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM h GROUP BY 1")
def split_counts(spark, sf):
    rows = learn.split(table(spark, sf, "documents").select(F.col("doc_id").alias("row_id")))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query("split_stratified", f"WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, CASE WHEN k <= ceil(0.1 * n) THEN 'dev' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM h GROUP BY 1, 2")
def split_stratified(spark, sf):
    rows = learn.split(table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang"), by="lang")
    return rows.groupBy("lang", "split").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query("balanced_partitions", "WITH p AS (SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) AS part FROM documents) SELECT CAST(part AS INTEGER) AS part, min(doc_id) AS first, max(doc_id) AS last, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY part")
def balanced_partitions(spark, sf):
    return learn.balanced_parts(table(spark, sf, "documents").select("doc_id"), "doc_id", 7)


@query("renumber_ids", "SELECT CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 99 AS BIGINT) AS id, o_orderkey AS canonical_id FROM orders")
def renumber_ids(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return learn.renumbered(rows, "at", 100).select("id", "canonical_id")


@query("svm_predict")
def svm_predict(spark, sf):
    from lexigrid.functions.text import Analyzer

    parts = learn.split(docs(spark, sf).select(F.col("doc_id").alias("row_id"), "lang", "text"), 0.2)
    train, dev = (parts.where(F.col("split") == s).select("row_id", "lang", Analyzer().tokens(F.col("text")).alias("tokens")) for s in ("train", "dev"))
    model = learn.linear_svm(train, "tokens", "lang")
    return evaluate.confusion(learn.predicted(model, dev).withColumnRenamed("lang", "label"))


# --- vectors ------------------------------------------------------------------------------------------------------------
VEC = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), qs AS (SELECT vec_id AS qid, v AS qv FROM v WHERE vec_id % 20 = 0),
ld AS (SELECT vec_id, v FROM v ORDER BY ('0x' || substr(md5('leader:' || vec_id), 1, 8))::BIGINT, vec_id LIMIT (SELECT floor(sqrt(count(*)))::BIGINT FROM v)),
fo AS (SELECT * FROM (SELECT v.vec_id AS follower_id, ld.vec_id AS leader_id, round(list_cosine_similarity(v.v, ld.v), 6) AS sim FROM v, ld WHERE v.vec_id NOT IN (SELECT vec_id FROM ld)) QUALIFY row_number() OVER (PARTITION BY follower_id ORDER BY sim DESC, leader_id) <= 3)"""


def embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def asked(spark, sf) -> DataFrame:
    return embeddings(spark, sf).where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("vec").alias("qvec"))


@query("cosine_topk", f"WITH {VEC} SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM (SELECT qid, vec_id, round(list_cosine_similarity(qv, v), 6) AS sim FROM qs, v WHERE qid <> vec_id)) WHERE rank <= 10")
def cosine_topk(spark, sf):
    return vectors.search(embeddings(spark, sf), asked(spark, sf), 10)


@query("leader_assign", f"WITH {VEC} SELECT follower_id, leader_id, sim FROM fo")
def leader_assign(spark, sf):
    v = embeddings(spark, sf)
    return vectors.followers(v, vectors.leaders(v))


@query("mean_cluster_size", f"WITH {VEC} SELECT avg(n) AS mean_size FROM (SELECT count(*) AS n FROM fo GROUP BY leader_id)")
def mean_cluster_size(spark, sf):
    v = embeddings(spark, sf)
    return vectors.mean_cluster_size(vectors.followers(v, vectors.leaders(v)))


@query("pruned_search", f"""WITH {VEC}, nr AS (SELECT qid, vec_id AS leader_id FROM (SELECT qid, vec_id, round(list_cosine_similarity(qv, v), 6) AS sim FROM qs, ld WHERE qid <> vec_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) <= 3),
c AS (SELECT qid, leader_id AS vec_id FROM nr UNION SELECT qid, follower_id FROM nr JOIN fo USING (leader_id)),
s AS (SELECT c.qid, c.vec_id, round(list_cosine_similarity(qv, v), 6) AS sim FROM c JOIN qs ON qs.qid = c.qid JOIN v ON v.vec_id = c.vec_id WHERE c.qid <> c.vec_id)
SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def pruned_search(spark, sf):
    v = embeddings(spark, sf)
    lead = vectors.leaders(v)
    return vectors.pruned_search(v, lead, vectors.followers(v, lead), asked(spark, sf), 5)


# --- packets ------------------------------------------------------------------------------------------------------------
PKT = """p AS (SELECT event_id AS seq, 167772160 + (user_id * 7919) % 4096 AS a, 167772160 + (user_id * 104729 + event_id % 3) % 4096 AS b, event_id % 2 = 0 AS outbound,
 1000 + user_id % 50 AS ap, 80 + event_id % 3 AS bp, CASE WHEN event_type = 'error' THEN 17 ELSE 6 END AS proto, CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 18 ELSE 16 END AS flags,
 CAST(floor(value) AS BIGINT) + 40 AS bytes FROM events),
k AS (SELECT *, CASE WHEN outbound THEN a ELSE b END AS src_ip, CASE WHEN outbound THEN ap ELSE bp END AS src_port, CASE WHEN outbound THEN b ELSE a END AS dst_ip, CASE WHEN outbound THEN bp ELSE ap END AS dst_port FROM p),
c AS (SELECT *, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_ip ELSE dst_ip END AS lo_ip, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_port ELSE dst_port END AS lo_port,
 CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN dst_ip ELSE src_ip END AS hi_ip, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN dst_port ELSE src_port END AS hi_port FROM k)"""
FLOWS = f"{PKT}, f AS (SELECT lo_ip, lo_port, hi_ip, hi_port, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS packets FROM c WHERE proto = 6 GROUP BY ALL)"


def packets_of(events: DataFrame) -> DataFrame:
    """Events as packets: two ends from user_id, the direction and one port from event_id, protocol and flags from the type."""
    p = events.select(
        F.col("event_id").alias("seq"), "ts", (F.lit(167772160) + F.col("user_id") * 7919 % 4096).cast("long").alias("a"), (F.lit(167772160) + (F.col("user_id") * 104729 + F.col("event_id") % 3) % 4096).cast("long").alias("b"),
        (F.col("event_id") % 2 == 0).alias("outbound"), (1000 + F.col("user_id") % 50).cast("long").alias("ap"), (80 + F.col("event_id") % 3).cast("long").alias("bp"), F.when(F.col("event_type") == "error", 17).otherwise(6).alias("proto"),
        F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 18).otherwise(16).alias("flags"), (F.floor("value") + 40).cast("long").alias("bytes"),
    )
    side = lambda x, y, name: F.when(F.col("outbound"), F.col(x)).otherwise(F.col(y)).alias(name)
    return p.select("seq", "ts", "outbound", "proto", "flags", "bytes", F.lit(4).alias("ip_version"), side("a", "b", "src_ip"), side("ap", "bp", "src_port"), side("b", "a", "dst_ip"), side("bp", "ap", "dst_port"))


def packets(spark, sf) -> DataFrame:
    return packets_of(table(spark, sf, "events"))


@query("flow_bytes", f"WITH {FLOWS} SELECT * FROM f")
def flow_bytes(spark, sf):
    return network.flow_bytes(network.tcp(packets(spark, sf))).drop("ip_version")


@query("flow_topn", f"WITH {FLOWS} SELECT lo_ip, hi_ip, bytes FROM f ORDER BY bytes DESC, lo_ip, lo_port, hi_ip, hi_port LIMIT 100")
def flow_topn(spark, sf):
    return network.top_flows(network.flow_bytes(network.tcp(packets(spark, sf)))).select("lo_ip", "hi_ip", "bytes")


@query("flow_histogram", f"WITH {FLOWS}, e AS (SELECT min(bytes) AS l, max(bytes) AS h FROM f) SELECT CAST(least(19, floor((bytes - l) / (h - l)::DOUBLE * 20)) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM f, e GROUP BY 1")
def flow_histogram(spark, sf):
    return network.histogram(network.flow_bytes(network.tcp(packets(spark, sf))), "bytes", 20)


@query("source_bytes", f"WITH {PKT} SELECT src_ip, CAST(sum(bytes) AS BIGINT) AS bytes, CAST((SELECT sum(bytes) FROM k) AS BIGINT) AS total FROM k GROUP BY src_ip")
def source_bytes(spark, sf):
    return network.source_bytes(packets(spark, sf))


def _rollup_sql(share: float) -> str:
    out, prev = [f"r32 AS (SELECT src_ip AS net, sum(bytes) AS bytes FROM k GROUP BY src_ip)"], "r32"
    for plen in range(31, -1, -1):
        size = 1 << (32 - plen)
        out.append(f"r{plen} AS (SELECT net // {size} * {size} AS net, sum(bytes) AS bytes FROM r{plen + 1} WHERE bytes < {share} * (SELECT t FROM tt) GROUP BY 1)")
    rows = " UNION ALL ".join(f"SELECT net, {plen} AS plen, bytes FROM r{plen} WHERE bytes > 0" + (f" AND bytes >= {share} * (SELECT t FROM tt)" if plen else "") for plen in range(32, -1, -1))
    return f"WITH {PKT}, tt AS (SELECT sum(bytes) AS t FROM k), {', '.join(out)} SELECT CAST(net AS BIGINT) AS net, CAST(plen AS INTEGER) AS plen, CAST(bytes AS BIGINT) AS bytes FROM ({rows})"


@query("prefix_rollup", _rollup_sql(0.05))
def prefix_rollup(spark, sf):
    return network.prefix_rollup(packets(spark, sf), 0.05)


@query("fw_allow", f"WITH {PKT}, o AS (SELECT *, coalesce(max((outbound AND proto = 6)::INT) OVER (PARTITION BY lo_ip, lo_port, hi_ip, hi_port ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opened FROM c) SELECT seq, proto <> 6 OR outbound OR opened = 1 AS allowed FROM o")
def fw_allow(spark, sf):
    return network.allowed(packets(spark, sf)).select("seq", "allowed")


@query("mirror_first10", f"""WITH {PKT}, o AS (SELECT *, sum((flags & 2 <> 0 AND flags & 16 = 0 AND NOT outbound AND proto = 6)::INT) OVER (PARTITION BY lo_ip, lo_port, hi_ip, hi_port ORDER BY seq) AS epoch FROM c),
m AS (SELECT *, row_number() OVER (PARTITION BY lo_ip, lo_port, hi_ip, hi_port, epoch ORDER BY seq) AS nth FROM o) SELECT seq, epoch > 0 AND nth <= 10 AS mirrored FROM m""")
def mirror_first10(spark, sf):
    return network.mirrored(packets(spark, sf), 10).select("seq", "mirrored")


# --- transfers ----------------------------------------------------------------------------------------------------------
CHUNKS = """h AS (SELECT conv_id AS transfer_id, turn AS seq, text AS payload, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last, ('0x' || substr(md5('c:' || conv_id || ':' || turn), 1, 4))::BIGINT AS z FROM conversations),
ch AS (SELECT transfer_id, seq, payload, is_last, z AS arrived FROM h WHERE z % 11 <> 0 UNION ALL SELECT transfer_id, seq, payload || '#', is_last, z + 100000 FROM h WHERE z % 11 <> 0 AND z % 5 = 0)"""


def chunks(spark, sf) -> DataFrame:
    """Turns as chunks that arrive in the order of a hash; some are lost, and some arrive twice."""
    t = table(spark, sf, "conversations")
    last = t.groupBy("conv_id").agg(F.max("turn").alias("m"))
    z = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("c"), "conv_id", "turn")), 1, 4), 16, 10).cast("long")
    rows = t.join(last, "conv_id").select(F.col("conv_id").alias("transfer_id"), F.col("turn").alias("seq"), F.col("text").alias("payload"), (F.col("turn") == F.col("m")).alias("is_last"), z.alias("arrived")).where("arrived % 11 <> 0")
    again = rows.where("arrived % 5 = 0").withColumn("payload", F.concat("payload", F.lit("#"))).withColumn("arrived", F.col("arrived") + 100000)
    return rows.unionByName(again)


@query("dedup_reassemble", f"""WITH {CHUNKS}, d AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY transfer_id, seq ORDER BY arrived) = 1),
w AS (SELECT transfer_id FROM d GROUP BY transfer_id HAVING count(*) = max(CASE WHEN is_last THEN seq END) + 1) SELECT transfer_id, string_agg(payload, '' ORDER BY seq) AS content FROM d WHERE transfer_id IN (SELECT transfer_id FROM w) GROUP BY transfer_id""")
def dedup_reassemble(spark, sf):
    return transfer.reassembled(chunks(spark, sf), "arrived")


@query("dedup_last", f"""WITH {CHUNKS} SELECT transfer_id, seq, payload FROM ch QUALIFY row_number() OVER (PARTITION BY transfer_id, seq ORDER BY arrived DESC) = 1""")
def dedup_last(spark, sf):
    """Of each chunk the copy that came last."""
    return transfer.deduplicated(chunks(spark, sf), "arrived", keep="last").select("transfer_id", "seq", "payload")


@query("transfer_complete", f"""WITH {CHUNKS}, d AS (SELECT transfer_id, seq, bool_or(is_last) AS is_last FROM ch GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY transfer_id ORDER BY seq) - 1 AS k FROM d)
SELECT transfer_id, CAST(count(*) AS BIGINT) AS received, CAST(coalesce(max(CASE WHEN is_last THEN seq END) + 1, -1) AS BIGINT) AS expected, coalesce(count(*) = max(CASE WHEN is_last THEN seq END) + 1, false) AS complete, CAST(sum((seq = k)::INT) AS BIGINT) AS in_order FROM n GROUP BY transfer_id""")
def transfer_complete(spark, sf):
    return transfer.completeness(chunks(spark, sf)).fillna(-1, ["expected"])


# --- ledgers ------------------------------------------------------------------------------------------------------------
LEDGER = """m AS (SELECT o_orderkey AS seq, 'c' || o_custkey AS s, 'c' || (o_custkey * 31 % 1000) AS r, o_orderstatus AS asset, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders),
e AS (SELECT seq, s AS account, asset, -amount AS delta FROM m UNION ALL SELECT seq, r, asset, amount FROM m)"""


def entries(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    moves = o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("c"), "o_custkey").alias("sender"), F.concat(F.lit("c"), F.col("o_custkey") * 31 % 1000).alias("receiver"), F.col("o_orderstatus").alias("asset"), F.floor("o_totalprice").cast("decimal(38,0)").alias("amount"))
    return ledger.transfers(moves)


@query("ledger_balance", f"WITH {LEDGER}, b AS (SELECT *, sum(delta) OVER (PARTITION BY account, asset ORDER BY seq, delta ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT account, asset, CAST(sum(delta) AS BIGINT) AS balance, CAST(min(run) AS BIGINT) AS lowest, min(run) < 0 AS ever_negative FROM b GROUP BY account, asset")
def ledger_balance(spark, sf):
    return ledger.balances(entries(spark, sf)).select("account", "asset", *[F.col(c).cast("long").alias(c) for c in ("balance", "lowest")], "ever_negative")


@query("ledger_supply", f"WITH {LEDGER} SELECT asset, CAST(sum(delta) AS BIGINT) AS supply FROM e GROUP BY asset")
def ledger_supply(spark, sf):
    return ledger.supply(entries(spark, sf)).select("asset", F.col("supply").cast("long").alias("supply"))


# --- checks -------------------------------------------------------------------------------------------------------------
@query("dq_duplicates", "SELECT l_orderkey, l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_duplicates(spark, sf):
    return quality.duplicates(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query("dq_domain", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def dq_domain(spark, sf):
    return quality.outside(table(spark, sf, "events"), "event_type", ["view", "click", "purchase"]).select("event_id", "event_type")


@query(
    "dq_completeness",
    """SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type)""",
)
def dq_completeness(spark, sf):
    """The grid of all users and all types that the table has."""
    events = table(spark, sf, "events")
    return quality.missing(events, events.select("user_id").distinct(), events.select("event_type").distinct())


@query("json_ids", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_ids(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
