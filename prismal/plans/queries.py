"""Registered queries of the engine's own operators over the driver's tables, with their SQL twins.

Each query runs over whole tables.  Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal.config import variant
from prismal.functions import arrays as A
from prismal.functions import ids as I
from prismal.functions import text as X
from prismal.operators import bootstraps as B
from prismal.operators import checks as Q
from prismal.operators import coverage as C
from prismal.operators import metrics as M
from prismal.operators import physics as P
from prismal.operators import references as J
from prismal.operators import resample as R
from prismal.operators import shuffles as H
from prismal.operators import subsets
from prismal.operators import vectors as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CFG = variant()


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# ---------------------------------------------------------------- vectors

_LONG = "SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"


@query(f"""
WITH long AS ({_LONG}), tr AS (SELECT * FROM long WHERE vec_id % 5 <> 0), te AS (SELECT * FROM long WHERE vec_id % 5 = 0),
labels_ AS (SELECT DISTINCT label AS l FROM tr),
w AS (SELECT l, k, avg(CASE WHEN label = l THEN v END) AS p, avg(CASE WHEN label <> l THEN v END) AS q FROM tr, labels_ GROUP BY l, k),
s AS (SELECT vec_id, any_value(te.label) AS label, l, round(sum((v - (p + q) / 2) * (p - q)), 9) AS s FROM te JOIN w USING (k) GROUP BY vec_id, l),
r AS (SELECT *, rank() OVER (PARTITION BY l ORDER BY s) + (count(*) OVER (PARTITION BY l, s) - 1) / 2.0 AS rk FROM s)
SELECT CAST(l AS INTEGER) AS label, round((sum(CASE WHEN label = l THEN rk ELSE 0 END) - count_if(label = l) * (count_if(label = l) + 1) / 2.0) / (count_if(label = l) * count_if(label <> l)), 6) AS auroc
FROM r GROUP BY l""")
def mass_mean_auroc(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    s = V.mass_mean_probe(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0"), "embedding", "label", "vec_id")
    return M.auroc(s.withColumn("score", F.round("score", 9)), "y", "score", "label").select("label", r6(F.col("auroc"), "auroc"))


_CENTROID = f"""
long AS ({_LONG}), tr AS (SELECT * FROM long WHERE vec_id % 5 <> 0), te AS (SELECT * FROM long WHERE vec_id % 5 = 0),
c AS (SELECT k, avg(v) AS c FROM tr GROUP BY k),
m AS (SELECT label AS pred, k, avg(v) - any_value(c) AS m FROM tr JOIN c USING (k) GROUP BY label, k),
mn AS (SELECT pred, sqrt(sum(m * m)) AS n FROM m GROUP BY pred),
x AS (SELECT vec_id, label, k, v - c AS x FROM te JOIN c USING (k)),
xn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM x GROUP BY vec_id),
sim AS (SELECT x.vec_id, any_value(x.label) AS truth, m.pred, round(sum(x * m) / (any_value(xn.n) * any_value(mn.n)), 12) AS s
        FROM x JOIN m USING (k) JOIN xn USING (vec_id) JOIN mn USING (pred) GROUP BY x.vec_id, m.pred),
best AS (SELECT vec_id, truth, pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, pred) AS r FROM sim) WHERE r = 1)"""


@query(f"WITH {_CENTROID} SELECT truth AS label, pred, count(*) AS n FROM best GROUP BY 1, 2")
def centroid_confusion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    p = V.nearest_centroid(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0"), "embedding", "label", "vec_id")
    return M.confusion(p, "truth", "pred")


@query(f"WITH {_CENTROID} SELECT truth AS label, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n FROM best GROUP BY 1")
def centroid_recall(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    p = V.nearest_centroid(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0"), "embedding", "label", "vec_id")
    return M.class_recall(p, "truth", "pred").select("label", r6(F.col("recall"), "recall"), "n")


@query(f"""
WITH {_CENTROID}, t AS (SELECT truth, count(*) AS n, count_if(truth = pred) AS hit FROM best GROUP BY 1), s AS (SELECT pred, count(*) AS said FROM best GROUP BY 1)
SELECT round(sum(hit) / sum(n), 6) AS accuracy, round(avg(hit / n), 6) AS balanced_accuracy, round(avg(2.0 * hit / (n + coalesce(said, 0))), 6) AS macro_f1
FROM t LEFT JOIN s ON truth = pred""")
def centroid_report(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    p = V.nearest_centroid(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0"), "embedding", "label", "vec_id")
    return M.multiclass_report(p, "truth", "pred").select(*(r6(F.col(c), c) for c in ("accuracy", "balanced_accuracy", "macro_f1")))


_UNIT = "(SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS u FROM embeddings)"


@query(f"""
WITH u AS {_UNIT}, s AS (SELECT q.vec_id AS query_id, b.vec_id AS id, b.label, round(list_dot_product(q.u, b.u), 12) AS sim FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= 5)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM n""")
def cosine_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.cosine_neighbours(e.filter("vec_id % 20 = 0"), e, "embedding", "vec_id", 5).select("query_id", "id", "rank", r6(F.col("sim"), "sim"))


@query(f"""
WITH u AS {_UNIT}, s AS (SELECT q.vec_id AS query_id, b.vec_id AS id, b.label, round(list_dot_product(q.u, b.u), 12) AS sim FROM u q JOIN u b ON q.vec_id <> b.vec_id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= 5),
v AS (SELECT query_id, label AS pred, round(sum(1 / greatest(1 - sim, 1e-12)), 6) AS w FROM n GROUP BY 1, 2)
SELECT query_id, pred FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, pred) AS r FROM v) WHERE r = 1""")
def neighbour_vote(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = V.cosine_neighbours(e, e, "embedding", "vec_id", 5)
    return V.neighbour_vote(near.join(e.select(F.col("vec_id").alias("id"), "label"), "id"), "label")


@query(f"""
WITH long AS ({_LONG}), g AS (SELECT label, vec_id % 7 AS g, k, avg(v) AS v FROM long GROUP BY 1, 2, 3), m AS (SELECT label, k, avg(v) AS m FROM g GROUP BY 1, 2)
SELECT vec_id, round(sum((v - m) * (v - m)), 6) AS energy, round(sum(v - m), 6) AS total FROM long JOIN m USING (label, k) GROUP BY vec_id""")
def domain_centred(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("g", F.col("vec_id") % 7)
    c = V.centre_by_domain(e, "embedding", "label", "g")
    return c.select("vec_id", r6(A.dot(F.col("centred"), F.col("centred")), "energy"), r6(A.total(F.col("centred")), "total"))


@query(f"""
WITH long AS ({_LONG}), st AS (SELECT k, avg(v) AS m, CASE WHEN stddev_pop(v) <= 1e-6 THEN 1 ELSE stddev_pop(v) END AS s FROM long WHERE vec_id % 5 <> 0 GROUP BY k)
SELECT vec_id, round(sum((v - m) / s), 6) AS total, round(sqrt(sum(((v - m) / s) * ((v - m) / s))), 6) AS length FROM long JOIN st USING (k) GROUP BY vec_id""")
def standardised(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    z = V.standardise(e.filter("vec_id % 5 <> 0"), e, "embedding")
    return z.select("vec_id", r6(A.total(F.col("z")), "total"), r6(A.norm(F.col("z")), "length"))


@query("""
WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT vec_id, v, list_avg(v) AS m FROM a),
s AS (SELECT vec_id, v, m, greatest(sqrt(list_avg(list_transform(v, lambda x: (x - m) * (x - m)))), 1e-12) AS sd FROM m)
SELECT vec_id, round((list_max(v) - m) / sd, 6) AS top, round(list_sum(list_transform(v, lambda x: sqrt(greatest(x, 0)))), 6) AS roots FROM s""")
def row_standardised(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = A.doubles(F.col("embedding"))
    return e.select("vec_id", r6(F.array_max(A.standard_rows(v)), "top"), r6(A.total(A.root(v)), "roots"))


@query(f"""
WITH u AS {_UNIT}
SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_dot_product(a.u, b.u), 6) AS sim FROM u a JOIN u b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0
WHERE list_dot_product(a.u, b.u) >= 0.4 - 1e-12""")
def near_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.near_pairs(e.filter("vec_id % 5 = 0"), e.filter("vec_id % 5 <> 0"), "embedding", "vec_id", 0.4).select("left_id", "right_id", r6(F.col("sim"), "sim"))


@query(f"""
WITH long AS ({_LONG}), m AS (SELECT vec_id % 2 AS side, label, k, avg(v) AS m FROM long GROUP BY 1, 2, 3), n AS (SELECT side, label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1, 2),
s AS (SELECT a.label AS key_a, b.label AS key_b, sum(a.m * b.m) / (any_value(na.n) * any_value(nb.n)) AS sim FROM m a JOIN m b ON a.k = b.k AND a.side = 0 AND b.side = 1
      JOIN n na ON na.side = 0 AND na.label = a.label JOIN n nb ON nb.side = 1 AND nb.label = b.label GROUP BY 1, 2),
c AS (SELECT label FROM n WHERE side = 0 INTERSECT SELECT label FROM n WHERE side = 1)
SELECT key_a, key_b, round(sim, 6) AS sim, CAST(rank() OVER (PARTITION BY key_a ORDER BY round(sim, 9) DESC) AS INTEGER) AS rank, key_a = key_b AS same FROM s
WHERE key_a IN (SELECT label FROM c) AND key_b IN (SELECT label FROM c)""")
def similarity_ranks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("side", (F.col("vec_id") % 2).cast("string"))
    return C.similarity_table(e, "embedding", "side", "0", "1", "label").select("key_a", "key_b", r6(F.col("sim"), "sim"), "rank", "same")


@query(f"""
WITH f AS ({_LONG}), med AS (SELECT label, k, quantile_cont(v, 0.5) AS m FROM f GROUP BY 1, 2),
r AS (SELECT label, vec_id, corr(v, m) AS r FROM f JOIN med USING (label, k) GROUP BY 1, 2), keep AS (SELECT vec_id FROM r WHERE r >= -0.05)
SELECT label, CAST(k AS INTEGER) AS k, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS p90, count(*) AS n, (SELECT count(*) FROM embeddings e WHERE e.label = f.label) AS n_all
FROM f JOIN keep USING (vec_id) GROUP BY label, k""")
def consensus_curve(spark, sf_dir):
    c = C.consensus(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", -0.05, "label")
    return c.select("label", F.posexplode(F.arrays_zip("mean", "p90")).alias("k", "z"), "n", "n_all").select("label", "k", r6(F.col("z.mean"), "mean"), r6(F.col("z.p90"), "p90"), "n", "n_all")


# ---------------------------------------------------------------- scored documents

_LABELLED = "(SELECT d.doc_id, d.source, d.lang, l.toxic, l.quality, CAST(length(d.text) AS DOUBLE) AS score FROM documents d JOIN labels l USING (doc_id))"


def _labelled(spark, sf_dir) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # texts are measured before the join, which then moves no text
    d = d.select("doc_id", "source", "lang", F.length("text").cast("double").alias("score"))
    return d.join(lab, "doc_id").select("doc_id", "source", "lang", "toxic", "quality", "score")


@query(f"""
WITH d AS {_LABELLED}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM d)
SELECT lang, round((sum(CASE WHEN toxic = 1 THEN rk ELSE 0 END) - count_if(toxic = 1) * (count_if(toxic = 1) + 1) / 2.0) / nullif(count_if(toxic = 1) * count_if(toxic = 0), 0), 6) AS auroc,
       CAST(count_if(toxic = 1) AS DOUBLE) AS n_pos, CAST(count_if(toxic = 0) AS DOUBLE) AS n_neg
FROM r GROUP BY lang""")
def length_auroc_by_lang(spark, sf_dir):
    return M.auroc(_labelled(spark, sf_dir), "toxic", "score", "lang").select("lang", r6(F.col("auroc"), "auroc"), "n_pos", "n_neg")


@query(f"""
WITH d AS {_LABELLED}, l AS (SELECT score, count_if(quality = 1) AS p, count_if(quality = 0) AS n FROM d GROUP BY 1),
c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM l WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(p * tp / (tp + fp)) / sum(p), 6) AS auprc FROM c""")
def length_average_precision(spark, sf_dir):
    return M.average_precision(_labelled(spark, sf_dir), "quality", "score").select(r6(F.col("auprc"), "auprc"))


@query(f"""
WITH d AS {_LABELLED}, l AS (SELECT score, CAST(count_if(quality = 1) AS DOUBLE) AS p, CAST(count_if(quality = 0) AS DOUBLE) AS n FROM d GROUP BY 1
  UNION ALL SELECT 0.5, 0, 0), m AS (SELECT score, sum(p) AS p, sum(n) AS n FROM l GROUP BY 1),
c AS (SELECT score, round((sum(p) OVER w / sum(p) OVER () + 1 - sum(n) OVER w / sum(n) OVER ()) / 2, 12) AS ba FROM m WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT score AS threshold, round(ba, 6) AS balanced_accuracy FROM c ORDER BY ba DESC, score LIMIT 1""")
def length_threshold(spark, sf_dir):
    return M.best_threshold(_labelled(spark, sf_dir), "quality", "score").select("threshold", r6(F.col("balanced_accuracy"), "balanced_accuracy"))


@query(f"""
WITH d AS (SELECT toxic, least(score / 20000.0, 1.0) AS p FROM {_LABELLED}), b AS (SELECT least(greatest(floor(p * 10), 0), 9) AS b, count(*) AS c, avg(p) AS m, avg(toxic) AS r FROM d GROUP BY 1)
SELECT round(sum(c * abs(m - r)) / sum(c), 6) AS ece FROM b""")
def length_calibration(spark, sf_dir):
    d = _labelled(spark, sf_dir).withColumn("p", F.least(F.col("score") / 20000.0, F.lit(1.0)))
    return M.calibration_error(d, "toxic", "p").select(r6(F.col("ece"), "ece"))


@query(f"""
WITH d AS {_LABELLED}, l AS (SELECT score, CAST(count_if(quality = 1) AS DOUBLE) AS p, CAST(count_if(quality = 0) AS DOUBLE) AS n FROM d GROUP BY 1),
c AS (SELECT sum(p) OVER w / sum(p) OVER () AS t, sum(n) OVER w / sum(n) OVER () AS f FROM l WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(coalesce(max(CASE WHEN f <= 0.05 THEN t END), 0), 6) AS tpr FROM c""")
def length_tpr(spark, sf_dir):
    return M.tpr_at_fpr(_labelled(spark, sf_dir), "quality", "score", 0.05).select(r6(F.col("tpr"), "tpr"))


@query(f"""
WITH d AS {_LABELLED}
SELECT source, round(avg(score), 6) AS score, CAST(avg(toxic) >= 0.5 AS INTEGER) AS label, CAST(avg(CASE WHEN score > 2000 THEN 1.0 ELSE 0.0 END) >= 0.5 AS INTEGER) AS pred, count(*) AS n
FROM d GROUP BY source""")
def group_mean_vote(spark, sf_dir):
    d = _labelled(spark, sf_dir).withColumn("pred", (F.col("score") > 2000).cast("int"))
    return M.group_vote(d, "source", "toxic", "pred", "score").select("source", r6(F.col("score"), "score"), "label", "pred", "n")


@query(f"""
WITH d AS (SELECT source, lang, CASE WHEN score > 2000 THEN 'long' ELSE 'short' END AS pred FROM {_LABELLED}),
a AS (SELECT source, lang AS v, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM d GROUP BY source, lang),
b AS (SELECT source, pred AS v, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, pred) AS r FROM d GROUP BY source, pred)
SELECT a.source, a.v AS label, b.v AS pred FROM a JOIN b USING (source) WHERE a.r = 1 AND b.r = 1""")
def group_majority_vote(spark, sf_dir):
    d = _labelled(spark, sf_dir).withColumn("pred", F.when(F.col("score") > 2000, "long").otherwise("short"))
    return M.group_vote(d, "source", "lang", "pred")


@query(f"WITH d AS {_LABELLED}, c AS (SELECT source, toxic, count(*) AS n FROM d GROUP BY 1, 2) SELECT source, round(max(n) / sum(n), 6) AS majority_rate FROM c GROUP BY source")
def majority_by_source(spark, sf_dir):
    return M.majority_rate(_labelled(spark, sf_dir), "toxic", "source").select("source", r6(F.col("majority_rate"), "majority_rate"))


@query(f"""
WITH d AS {_LABELLED}, m AS (SELECT source, avg(toxic) AS score FROM d WHERE doc_id % 5 <> 0 GROUP BY 1), s AS (SELECT d.toxic, round(m.score, 12) AS score FROM d JOIN m USING (source) WHERE doc_id % 5 = 0),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT round((sum(CASE WHEN toxic = 1 THEN rk ELSE 0 END) - count_if(toxic = 1) * (count_if(toxic = 1) + 1) / 2.0) / nullif(count_if(toxic = 1) * count_if(toxic = 0), 0), 6) AS auroc FROM r""")
def source_confound(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    rate = d.filter("doc_id % 5 <> 0").groupBy("source").agg(F.round(F.avg("toxic"), 12).alias("rate"))
    return M.auroc(d.filter("doc_id % 5 = 0").join(F.broadcast(rate), "source"), "toxic", "rate").select(r6(F.col("auroc"), "auroc"))


@query(f"""
WITH d AS {_LABELLED}, r AS (SELECT lang, rank() OVER a + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS a, rank() OVER b + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2.0 AS b
  FROM d WINDOW a AS (PARTITION BY lang ORDER BY score), b AS (PARTITION BY lang ORDER BY quality))
SELECT lang, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS rho, count(*) AS n FROM r GROUP BY lang""")
def rank_correlation(spark, sf_dir):
    return P.rank_correlation(_labelled(spark, sf_dir), "score", "quality", "lang").select("lang", r6(F.col("rho"), "rho"), "n")


# ---------------------------------------------------------------- texts

@query(f"SELECT doc_id, {X.estimate_tokens_sql('text')} AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("n_tokens"))


@query(f"""
WITH t AS (SELECT source, {X.estimate_tokens_sql('text')} AS n FROM documents)
SELECT source, count(*) AS n, CAST(min(n) AS INTEGER) AS tokens_min, CAST(max(n) AS INTEGER) AS tokens_max, round(quantile_cont(n, 0.1), 6) AS tokens_p10, round(quantile_cont(n, 0.5), 6) AS tokens_median,
       round(quantile_cont(n, 0.9), 6) AS tokens_p90, round(quantile_cont(n, 0.75) - quantile_cont(n, 0.25), 6) AS tokens_iqr
FROM t GROUP BY source""")
def token_spread(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", X.estimate_tokens(F.col("text")).alias("tokens"))
    s = C.spread(d, "tokens", "source")
    return s.select("source", "n", "tokens_min", "tokens_max", *(r6(F.col(c), c) for c in ("tokens_p10", "tokens_median", "tokens_p90", "tokens_iqr")))


@query("""
WITH d AS (SELECT text, lang, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '3' THEN 'test' ELSE 'train' END AS split FROM documents),
g AS (SELECT text, count(DISTINCT split) AS s, count(DISTINCT lang) AS l FROM d GROUP BY text)
SELECT 'exact_duplicates' AS "check", CASE WHEN count_if(s > 1 AND l <= 1) > 0 THEN 'FAIL' WHEN count_if(s > 1 AND l > 1) > 0 THEN 'WARN' ELSE 'PASS' END AS status,
       CAST(count_if(s > 1 AND l <= 1) AS VARCHAR) || ' texts of one label and ' || CAST(count_if(s > 1 AND l > 1) AS VARCHAR) || ' of several labels are in several splits' AS detail
FROM g""")
def duplicates_across_splits(spark, sf_dir):
    split = F.when(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "3", "test").otherwise("train")
    d = table(spark, sf_dir, "documents").withColumn("split", split)
    return Q.exact_duplicates(d, "text", "lang", "split", "doc_id").select("check", "status", "detail")


@query("""
SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z])(idiot|moron|password)($|[^A-Za-z])') OR regexp_matches(text, '(?i)api_key')""")
def forbidden_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(X.term_pattern(["idiot", "moron", "password", "api_key"]))).select("doc_id")


@query("""
WITH t AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM documents d JOIN labels l USING (doc_id)) AS k)
SELECT * FROM (
  SELECT 'toxic' AS label, count_if(toxic = 1) AS total, count_if(toxic = 1 AND lang = 'en') AS usable, round(count_if(toxic = 1) / count(*), 6) AS fraction,
         CASE WHEN count_if(toxic = 1) = 0 THEN 'unused' WHEN count_if(toxic = 1 AND lang = 'en') = 0 THEN 'NO SUPPORT' WHEN count_if(toxic = 1 AND lang = 'en') < 100 THEN 'thin' ELSE 'ok' END AS status
  FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'quality', count_if(quality = 1), count_if(quality = 1 AND lang = 'en'), round(count_if(quality = 1) / count(*), 6),
         CASE WHEN count_if(quality = 1) = 0 THEN 'unused' WHEN count_if(quality = 1 AND lang = 'en') = 0 THEN 'NO SUPPORT' WHEN count_if(quality = 1 AND lang = 'en') < 100 THEN 'thin' ELSE 'ok' END
  FROM documents LEFT JOIN labels USING (doc_id))""")
def label_support(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    s = C.label_support(d, ["toxic", "quality"], F.col("lang") == "en")
    return s.select("label", "total", "usable", r6(F.col("fraction"), "fraction"), "status")


@query("""
SELECT page_id, concat_ws('; ', CASE WHEN regexp_matches(html, '(?i)<script') THEN 'script' END, CASE WHEN regexp_matches(html, '(?i)track\\(') THEN 'tracker' END, CASE WHEN length(html) > 5000 THEN 'long' END) AS leaks
FROM pages WHERE regexp_matches(html, '(?i)<script') OR regexp_matches(html, '(?i)track\\(') OR length(html) > 5000""")
def page_leaks(spark, sf_dir):
    h = F.col("html")
    return Q.legacy_leaks(table(spark, sf_dir, "pages"), {"script": h.rlike("(?i)<script"), "tracker": h.rlike(r"(?i)track\("), "long": F.length(h) > 5000}, "page_id").withColumnRenamed("id", "page_id")


# ---------------------------------------------------------------- events as signals

@query("""
WITH h AS (SELECT event_type AS g, floor(value / 5) AS b, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY 1, 2), p AS (SELECT g, b, c / sum(c) OVER (PARTITION BY g) AS p FROM h),
g AS (SELECT DISTINCT g FROM p)
SELECT x.g AS a, y.g AS b, round(coalesce(sum(CASE WHEN q.p IS NULL THEN 0 ELSE least(p.p, q.p) END), 0), 6) AS overlap FROM g x JOIN g y ON x.g < y.g LEFT JOIN p ON p.g = x.g LEFT JOIN p q ON q.g = y.g AND q.b = p.b GROUP BY 1, 2""")
def histogram_overlap(spark, sf_dir):
    return C.histogram_overlap(table(spark, sf_dir, "events"), "value", "event_type", 0.0, 5.0).select("a", "b", r6(F.col("overlap"), "overlap"))


@query("""
WITH v AS (SELECT DISTINCT user_id, value AS v FROM events WHERE value IS NOT NULL), n AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY user_id ORDER BY v) > 5 THEN 1 ELSE 0 END AS s FROM v),
c AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS cluster FROM n), e AS (SELECT e.user_id, e.value, c.cluster FROM events e JOIN c ON c.user_id = e.user_id AND c.v = e.value)
SELECT user_id, CAST(cluster AS BIGINT) AS cluster, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS n FROM e GROUP BY 1, 2""")
def gap_clusters(spark, sf_dir):
    c = C.gap_clusters(table(spark, sf_dir, "events"), "value", 5.0, "user_id")
    return c.select("user_id", "cluster", r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"), r6(F.col("median"), "median"), "n")


@query("""
WITH l AS (SELECT DISTINCT round(value) AS p, event_type AS a FROM events), d AS (SELECT DISTINCT p FROM l), n AS (SELECT *, CASE WHEN p - lag(p) OVER (ORDER BY p) > 3 THEN 1 ELSE 0 END AS s FROM d),
c AS (SELECT p, sum(s) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS c FROM n), m AS (SELECT quantile_cont(v.p, 0.5) AS median FROM (SELECT round(value) AS p FROM events) v JOIN c USING (p) GROUP BY c.c)
SELECT round(median, 6) AS median, round(count(DISTINCT a) / (SELECT count(DISTINCT event_type) FROM events), 6) AS share FROM m JOIN l ON abs(l.p - m.median) <= 3 GROUP BY median
HAVING count(DISTINCT a) >= 0.5 * (SELECT count(DISTINCT event_type) FROM events)""")
def shared_positions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.round("value").alias("p"), "event_type")
    return C.shared_positions(e, "p", "event_type", 3.0, 0.5).select(r6(F.col("median"), "median"), r6(F.col("share"), "share"))


@query("""
WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events), m AS (SELECT user_id, quantile_cont(d, 0.5) AS m FROM d WHERE d IS NOT NULL GROUP BY 1)
SELECT user_id, round(1.4826 * quantile_cont(abs(d - m), 0.5) / sqrt(2), 6) AS noise FROM d JOIN m USING (user_id) WHERE d IS NOT NULL GROUP BY 1""")
def robust_noise(spark, sf_dir):
    # a user's values in time
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e")).filter(F.size("e") > 1)
    return e.select("user_id", r6(A.robust_noise(F.transform("e", lambda x: x["value"])), "noise"))


@query("""
WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT vec_id, list_transform(range(2, len(v) + 1), lambda i: v[i] - v[i - 1]) AS d FROM a),
m AS (SELECT vec_id, d, list_median(d) AS m FROM d)
SELECT vec_id, round(1.4826 * list_median(list_transform(d, lambda x: abs(x - m))) / sqrt(2), 6) AS noise FROM m""")
def signal_noise(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(A.robust_noise(A.doubles(F.col("embedding"))), "noise"))


@query("""
WITH p AS (SELECT event_id, event_type, user_id, value, round(value) AS pos FROM events),
b AS (SELECT 20.0 AS pos, 15.0 AS h UNION ALL SELECT 50.0, 60.0),
n AS (SELECT p.*, b.pos AS bpos, b.h, row_number() OVER (PARTITION BY event_id ORDER BY abs(p.pos - b.pos), b.pos, b.h) AS r FROM p LEFT JOIN b ON abs(p.pos - b.pos) <= 5)
SELECT user_id, count_if(bpos IS NULL OR (value - h >= 0.1 AND value >= 1.5 * h)) AS n_kept, count_if(bpos IS NOT NULL AND NOT (value - h >= 0.1 AND value >= 1.5 * h)) AS n_dropped
FROM n WHERE r = 1 GROUP BY user_id""")
def explained_peaks(spark, sf_dir):
    peak = F.array(F.struct(F.round("value").alias("position"), F.col("value").alias("intensity"), F.lit(1.0).alias("width")))
    bands = F.array(*(F.struct(F.lit(a).alias("position"), F.lit(b).alias("height")) for a, b in ((20.0, 15.0), (50.0, 60.0))))
    e = table(spark, sf_dir, "events").select("user_id", A.split_explained(peak, bands, 5.0, 0.1, 1.5).alias("s"))
    return e.groupBy("user_id").agg(F.sum(F.size("s.kept")).alias("n_kept"), F.sum(F.size("s.dropped")).alias("n_dropped"))


@query("""
SELECT event_id, printf('%.0f', round_even(value, 0)) || ' ' || CAST(round_even(value, 2) AS DECIMAL(18, 2)) AS text FROM events""")
def value_text(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", X.fixed(v, 0), X.fixed(v, 2)).alias("text"))


# ---------------------------------------------------------------- joins and ids on the star schema

@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def customers_without_events(spark, sf_dir):
    return J.only_in(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), table(spark, sf_dir, "events").withColumnRenamed("user_id", "k"), "k").withColumnRenamed("k", "c_custkey")


@query("""
WITH s AS (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem), k AS (SELECT l_partkey FROM s GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem))
SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM k) GROUP BY 1""")
def parts_on_every_side(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    return J.complete_keys(li, "l_partkey", "l_returnflag").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey AS id, o_custkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_order(spark, sf_dir):
    return J.first_per_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")


@query("""
WITH i AS (SELECT *, CASE event_type WHEN 'click' THEN 'Cell_' WHEN 'view' THEN 'CB_' ELSE '' END || 'u' || (user_id % 7) || '_' || event_type || '_' || (event_id % 10) AS id FROM events)
SELECT event_id, id, CASE WHEN starts_with(id, 'CB_') THEN 'substrate_only' WHEN starts_with(id, 'Cell_') THEN 'cell' ELSE 'standard' END AS kind,
       regexp_replace(id, '_[0-9]+$', '') AS grp, CASE WHEN len(string_split(id, '_')) >= 3 THEN string_split(id, '_')[2] ELSE '?' END AS strain,
       CASE WHEN starts_with(id, 'Cell_') THEN 'CB_' || substr(id, 6) ELSE 'CB_' || id END AS pair, regexp_replace(regexp_replace(id, '^(Cell|CB)_', ''), '_[0-9]+$', '') AS cond
FROM i""")
def sample_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    prefix = F.when(F.col("event_type") == "click", "Cell_").when(F.col("event_type") == "view", "CB_").otherwise("")
    i = e.withColumn("id", F.concat(prefix, F.lit("u"), (F.col("user_id") % 7).cast("string"), F.lit("_"), "event_type", F.lit("_"), (F.col("event_id") % 10).cast("string")))
    c = F.col("id")
    return i.select("event_id", "id", I.kind(c).alias("kind"), I.group(c).alias("grp"), I.strain(c).alias("strain"), I.pair_name(c).alias("pair"), I.condition(c).alias("cond"))


@query("""
WITH i AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a FROM part WHERE p_partkey % 20 = 0), b AS (SELECT n_nationkey AS other, ['small', CASE WHEN n_nationkey % 2 = 0 THEN 'ring' ELSE 'widget' END, 'N' || n_nationkey] AS b FROM nation),
s AS (SELECT p_partkey AS id, other, len(list_intersect(a, b)) AS k, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS sim FROM i, b), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS r FROM s WHERE k > 0)
SELECT i.p_partkey AS id, CAST(max(CASE WHEN r = 1 THEN other END) AS BIGINT) AS nearest, round(max(CASE WHEN r = 1 THEN sim END), 6) AS sim, count(*) FILTER (sim >= 0.5) AS n_over FROM i LEFT JOIN t ON t.id = i.p_partkey GROUP BY 1""")
def nearest_sets(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("items"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.array(F.lit("small"), F.when(F.col("n_nationkey") % 2 == 0, "ring").otherwise("widget"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).alias("items"))
    return C.nearest_by_jaccard(p, n, "items", "id").select("id", "nearest", r6(F.col("sim"), "sim"), "n_over")


@query(f"""
WITH d AS {_LABELLED}, r AS (SELECT *, CASE WHEN score > 2000 THEN 1 ELSE 0 END AS pred, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM d),
l AS (SELECT lang, score, count_if(quality = 1) AS p, count_if(quality = 0) AS n FROM d GROUP BY 1, 2),
c AS (SELECT lang, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM l WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT lang, sum(p * tp / (tp + fp)) / sum(p) AS auprc FROM c GROUP BY lang),
a AS (SELECT lang, (sum(CASE WHEN quality = 1 THEN rk ELSE 0 END) - count_if(quality = 1) * (count_if(quality = 1) + 1) / 2.0) / nullif(count_if(quality = 1) * count_if(quality = 0), 0) AS auroc,
      (avg(CASE WHEN quality = 1 THEN pred END) + avg(CASE WHEN quality = 0 THEN 1 - pred END)) / 2 AS ba FROM r GROUP BY lang)
SELECT lang, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(ba, 6) AS balanced_accuracy FROM a JOIN ap USING (lang)""")
def binary_report(spark, sf_dir):
    d = _labelled(spark, sf_dir).withColumn("pred", (F.col("score") > 2000).cast("int"))
    return M.binary_report(d, "quality", "score", "pred", "lang").select("lang", *(r6(F.col(c), c) for c in ("auroc", "auprc", "balanced_accuracy")))


@query(f"""
WITH d AS (SELECT lang AS label, CASE WHEN score > 4000 THEN 'en' WHEN score > 2000 THEN 'de' ELSE 'fr' END AS pred FROM {_LABELLED}), c AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS l)
SELECT a.l AS label, b.l AS pred, count(d.label) AS n FROM c a CROSS JOIN c b LEFT JOIN d ON d.label = a.l AND d.pred = b.l GROUP BY 1, 2""")
def square_confusion(spark, sf_dir):
    s = F.col("score")
    d = _labelled(spark, sf_dir).withColumn("pred", F.when(s > 4000, "en").when(s > 2000, "de").otherwise("fr"))
    return M.confusion(d, "lang", "pred", ["de", "en", "es", "fr"])


@query("""
WITH p AS (SELECT p_partkey, p_retailprice AS nu, p_size * 2.0 AS s, p_size / 60.0 AS rho FROM part WHERE p_retailprice > 1), i AS (SELECT *, s * rho / (3 * (1 + rho)) AS g2 FROM p)
SELECT p_partkey, round(power(1e7 / 785.0 - nu, 4) / nu / (1 - exp(-1.4387769 * nu / 298.15)) / 1e12, 6) AS factor, round(greatest((s - 7 * g2) / 45, 0), 6) AS a2, round(greatest(g2, 0), 6) AS g2 FROM i""")
def line_factors(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_retailprice > 1")
    i = A.invariants_from_activity(F.col("p_size") * 2.0, F.col("p_size") / 60.0)
    return p.select("p_partkey", r6(A.scattering_factor(F.col("p_retailprice")) / 1e12, "factor"), r6(i["a2"], "a2"), r6(i["g2"], "g2"))


@query("""
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'F1' WHEN 'assistant' THEN 'F1.snv' ELSE 'F10' END AS feature, role <> 'system' AS in_family,
       'kind: ' || role || '; text: ' || CASE WHEN text = '' OR text IS NULL THEN 'NA' ELSE text END AS tagged
FROM conversations""")
def tagged_turns(spark, sf_dir):
    f = F.when(F.col("role") == "user", "F1").when(F.col("role") == "assistant", "F1.snv").otherwise("F10")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", f.alias("feature"), I.family(f, "F1").alias("in_family"), X.tagged_text({"kind": F.col("role"), "text": F.col("text")}).alias("tagged"))

# ---------------------------------------------------------------- peak lists, features and checks

# a user's events as peaks: the event's number as position, its value as intensity
_PEAKS = "SELECT user_id, CAST(event_id AS DOUBLE) AS pos, value AS h, CAST(event_id % 7 AS DOUBLE) AS w FROM events"
_CHUNK = "printf('%.0f', pos) || ' ' || CAST(round_even(greatest(h, 0), 2) AS DECIMAL(18, 2)) || ' ' || printf('%.0f', w)"


def _peak_lists(spark, sf_dir) -> DataFrame:
    """``id, peaks`` of every user; lists are as long as a user has events."""
    peak = F.struct(F.col("event_id").cast("double").alias("position"), F.col("value").alias("intensity"), (F.col("event_id") % 7).cast("double").alias("width"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_list(peak).alias("peaks"))


@query(f"""
SELECT user_id AS id, string_agg({_CHUNK}, ' | ' ORDER BY pos) AS text, string_agg(printf('%.0f', pos), ' | ' ORDER BY pos) AS positions, count(*) AS n_back,
       round(sum(CAST(round_even(greatest(h, 0), 2) AS DOUBLE)), 4) AS total FROM ({_PEAKS}) GROUP BY 1""")
def peak_texts(spark, sf_dir):
    t = _peak_lists(spark, sf_dir).select("id", X.peaks_text(F.col("peaks"), CFG).alias("text"))
    back = X.parse_peaks(F.col("text"), CFG)
    return t.select("id", "text", X.keep_fields(F.col("text"), CFG, "position").alias("positions"), F.size(back).cast("bigint").alias("n_back"),
                    F.round(A.total(F.transform(back, lambda p: p["intensity"])), 4).alias("total"))


@query(f"""
WITH p AS ({_PEAKS}), b AS (SELECT user_id, CAST(least(greatest(floor((pos - 500) / 10), 0), 124) AS INTEGER) AS k, max(CAST(round_even(h, 2) AS DOUBLE)) AS h FROM p GROUP BY 1, 2),
g AS (SELECT user_id, k FROM (SELECT DISTINCT user_id FROM p), (SELECT unnest(range(0, 125)) AS k))
SELECT g.user_id AS id, 'F1' AS feature, CAST(g.k AS INTEGER) AS k, round(greatest(coalesce(h, 0), 0), 6) AS v FROM g LEFT JOIN b ON b.user_id = g.user_id AND b.k = g.k
UNION ALL SELECT g.user_id, 'F1pos', CAST(g.k AS INTEGER), CASE WHEN coalesce(h, 0) > 0 THEN 1.0 ELSE 0.0 END FROM g LEFT JOIN b ON b.user_id = g.user_id AND b.k = g.k""")
def raster_features(spark, sf_dir):
    from prismal.operators import features as E

    records = _peak_lists(spark, sf_dir).select("id", X.peaks_text(F.col("peaks"), CFG).alias("text"))
    return E.feature_set(records, CFG, None, ("F1", "F1pos")).select("id", "feature", F.posexplode("v").alias("k", "v")).select("id", "feature", "k", r6(F.col("v"), "v"))


@query(f"""
WITH p AS ({_PEAKS}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h DESC, pos) AS r FROM p), s AS (SELECT * FROM r WHERE r <= 3)
SELECT user_id, CAST(pos AS BIGINT) AS event_id, round(h, 6) AS value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS INTEGER) AS place,
       round(w / sqrt(1.0 / 0.3 - 1.0), 6) AS fwhm FROM s""")
def strongest_events(spark, sf_dir):
    # equal ones count in the order of the list
    ordered = _peak_lists(spark, sf_dir).select("id", F.array_sort("peaks").alias("peaks"))
    top = ordered.select(F.col("id").alias("user_id"), F.posexplode(A.top_by_intensity(F.col("peaks"), 3)).alias("place", "p"))
    return top.select("user_id", F.col("p.position").cast("bigint").alias("event_id"), r6(F.col("p.intensity"), "value"), "place", r6(A.lorentz_fwhm(F.col("p.width"), 0.7), "fwhm"))


@query(f"""
WITH p AS ({_PEAKS}), k AS (SELECT * FROM p WHERE NOT (abs(pos - 600) <= 40 OR abs(pos - 2000) <= 40))
SELECT user_id AS id, count(*) AS n, count_if(pos BETWEEN 500 AND 900 OR pos BETWEEN 1500 AND 1600) AS n_inside FROM k GROUP BY 1""")
def masked_peaks(spark, sf_dir):
    kept = _peak_lists(spark, sf_dir).select("id", F.explode(A.mask_peaks(F.col("peaks"), F.array(F.lit(600.0), F.lit(2000.0)), 40.0)).alias("p"))
    inside = A.inside(F.col("p.position"), [(500, 900), (1500, 1600)])
    return kept.groupBy("id").agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"))


@query(f"""
WITH p AS (SELECT e.event_type AS g, {_PEAKS.split('SELECT ', 1)[1].replace('FROM events', 'FROM events e')}), l AS (SELECT g, user_id, count(*) AS n, arg_max(pos, (h, -pos)) AS top FROM p GROUP BY 1, 2)
SELECT l.g AS event_type, l.records, round(l.pm, 6) AS peaks_median, round(e.im, 6) AS intensity_median, round(e.weak, 6) AS weak_share, round(e.fm, 6) AS fwhm_median, round(e.low, 6) AS low_share, round(l.sm, 6) AS strongest_median
FROM (SELECT g, count(*) AS records, quantile_cont(n, 0.5) AS pm, quantile_cont(top, 0.5) AS sm FROM l GROUP BY 1) l
JOIN (SELECT g, quantile_cont(h, 0.5) AS im, avg(CASE WHEN h < 20 THEN 1.0 ELSE 0.0 END) AS weak, quantile_cont(w, 0.5) AS fm, avg(CASE WHEN pos < 900 THEN 1.0 ELSE 0.0 END) AS low FROM p GROUP BY 1) e USING (g)""")
def peak_statistics(spark, sf_dir):
    peak = F.struct(F.col("event_id").cast("double").alias("position"), F.col("value").alias("intensity"), (F.col("event_id") % 7).cast("double").alias("width"))
    lists = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.array_sort(F.collect_list(peak)).alias("peaks"))
    s = C.text_stats(lists, "peaks", "event_type", 20.0, 900.0)
    return s.select("event_type", "records", *(r6(F.col(c), c) for c in ("peaks_median", "intensity_median", "weak_share", "fwhm_median", "low_share", "strongest_median")))


@query("""
WITH s AS (SELECT 'x' || vec_id || 'y' AS id, label, vec_id FROM embeddings)
SELECT 'split_disjoint' AS "check", CASE WHEN count_if(k > 1) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, '0 repeated ids, ' || CAST(count_if(k > 1) AS VARCHAR) || ' groups in several splits' AS detail
FROM (SELECT label, count(DISTINCT vec_id % 5 = 0) AS k FROM s GROUP BY label)""")
def splits_by_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"))
    return Q.split_disjoint(e).select("check", "status", "detail")


@query(f"""
WITH t AS (SELECT {X.estimate_tokens_sql('text')} + 32 AS n FROM conversations)
SELECT 'token_budget' AS "check", CASE WHEN count_if(n > 200) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
       'median ' || CAST(CAST(quantile_cont(n, 0.5) AS DECIMAL(18, 1)) AS VARCHAR) || ', most ' || CAST(max(n) AS VARCHAR) || ', ' || CAST(count_if(n > 200) AS VARCHAR) || ' over 200' AS detail FROM t""")
def conversation_budget(spark, sf_dir):
    return Q.token_budget(table(spark, sf_dir, "conversations"), 200, "text", "conv_id", 32).select("check", "status", "detail")


@query(f"""
WITH t AS (SELECT user_id AS id, string_agg({_CHUNK}, ' | ' ORDER BY pos) AS text FROM ({_PEAKS}) GROUP BY 1), u AS (SELECT id, CASE WHEN id % 3 = 0 THEN text || ' |' ELSE text END AS text FROM t)
SELECT 'grammar' AS "check", 'FAIL' AS status, CAST(count_if(id % 3 = 0) AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) || ' texts are off the grammar' AS detail FROM u
UNION ALL SELECT 'blank_control', CASE WHEN count(*) < 5 THEN 'SKIP' WHEN avg(CAST(toxic = quality AS INTEGER)) > 0.5 + 0.1 THEN 'FAIL' ELSE 'PASS' END,
  'accuracy ' || CAST(CAST(avg(CAST(toxic = quality AS INTEGER)) AS DECIMAL(18, 3)) AS VARCHAR) || ' on ' || CAST(count(*) AS VARCHAR) || ' blanks, chance 0.500' FROM labels""")
def audit(spark, sf_dir):
    t = _peak_lists(spark, sf_dir).select("id", X.peaks_text(F.col("peaks"), CFG).alias("text"))
    t = t.withColumn("text", F.when(F.col("id") % 3 == 0, F.concat("text", F.lit(" |"))).otherwise(F.col("text")))
    return Q.run_all(Q.grammar(t, CFG), Q.blank_control(table(spark, sf_dir, "labels"), "toxic", "quality", 0.5)).select("check", "status", "detail")


@query("""
WITH t AS (SELECT conv_id, turn, role, 'Turn: ' || text || chr(10) || 'Who?' AS prompt, length(text) AS n FROM conversations)
SELECT conv_id, turn, prompt, 6 AS start, CAST(n + 6 AS INTEGER) AS stop, '(' || role || '/' || conv_id || ')' AS tag, role IN ('user', 'assistant') AS yes FROM t""")
def prompts(spark, sf_dir):
    p = X.prompt(F.col("text"), "Turn: {text}\nWho?")
    cell = F.when(F.col("role") == "user", " Yes\t").when(F.col("role") == "assistant", "✅").otherwise("no")
    c = table(spark, sf_dir, "conversations").withColumn("p", p)
    return c.select("conv_id", "turn", F.col("p.prompt").alias("prompt"), F.col("p.start").alias("start"), F.col("p.stop").alias("stop"), X.combo_tag(F.col("role"), F.col("conv_id").cast("string")).alias("tag"), X.truthy(cell).alias("yes"))


@query("""
SELECT 'l-' || c_mktsegment AS name, lower(c_mktsegment) AS bare, replace(c_name || '_x', '_', ' ') AS shown FROM customer""")
def names(spark, sf_dir):
    n = F.concat(F.lit("l-"), F.col("c_mktsegment"))
    pretty = X.pretty(F.concat(F.lit("fg_"), F.col("c_name"), F.lit("_x")))
    return table(spark, sf_dir, "customer").select(n.alias("name"), X.bare_name(F.concat(F.lit(" L-"), F.col("c_mktsegment"), F.lit(" "))).alias("bare"), pretty.alias("shown"))


@query(f"""
WITH c AS (SELECT vec_id, label, embedding FROM embeddings), refs AS (SELECT * FROM ({_LONG}) WHERE vec_id % 2 = 1), m AS (SELECT label, k, avg(v) AS m, count(*) AS n FROM refs GROUP BY 1, 2)
SELECT l.vec_id, 'mean(g' || l.label || ', n=' || any_value(m.n) || ')' AS ref_label, round(sum(l.v * m.m), 6) AS dot FROM ({_LONG}) l JOIN m ON m.label = l.label AND m.k = l.k WHERE l.vec_id % 2 = 0 GROUP BY l.vec_id, l.label""")
def reference_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    name = lambda p: F.concat(F.lit(p), F.col("label").cast("string"), F.lit("_"), F.col("vec_id").cast("string"))
    v = A.doubles(F.col("embedding")).alias("v")
    samples, refs = e.filter("vec_id % 2 = 0").select("vec_id", name("Cell_g").alias("id"), v), e.filter("vec_id % 2 = 1").select(name("CB_g").alias("id"), v)
    return J.find_reference(samples, refs, "v").select("vec_id", "ref_label", r6(A.dot(F.col("v"), F.col("ref")), "dot"))


@query("""
SELECT o_orderkey AS id, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def last_order(spark, sf_dir):
    return J.last_per_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice")


@query("""
WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, round(list_max(v), 6) AS top, round(list_sum(list_transform(v, lambda x: x / list_max(v))), 6) AS scaled,
       round(list_sum(list_transform(range(2, len(v) + 1), lambda i: abs(v[i] - v[i - 1]))), 6) AS rough, round(list_median(v), 6) AS middle FROM a WHERE list_max(v) > 0""")
def vector_shapes(spark, sf_dir):
    v = F.col("v")
    e = table(spark, sf_dir, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("v")).filter(F.array_max("v") > 0)
    rough = A.total(F.transform(A.differences(v), lambda x: F.abs(x)))
    return e.select("vec_id", r6(F.array_max(v), "top"), r6(A.total(A.scale_to_max(v)), "scaled"), r6(rough, "rough"), r6(A.median(v), "middle"))


@query("""
WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), i AS (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM a),
t AS (SELECT unnest(range(-7, 8)) AS d), s AS (SELECT 4.0 / (2 * sqrt(2 * ln(2))) AS s), w AS (SELECT d, exp(-0.5 * power(d / s, 2)) AS w FROM t, s WHERE abs(d) <= CAST(floor(4 * s + 0.5) AS INTEGER)),
n AS (SELECT d, w / (SELECT sum(w) FROM w) AS w FROM w)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS k, round(sum(w * v[least(greatest(i + d, 1), len(v))]), 6) AS v FROM i, n GROUP BY 1, 2""")
def broadened(spark, sf_dir):
    from prismal.functions import signal as S

    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(S.broaden(A.doubles(F.col("embedding")), 4.0, 1.0)).alias("k", "v")).select("vec_id", "k", r6(F.col("v"), "v"))


@query("""
WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), i AS (SELECT vec_id, v, unnest(range(3, len(v) - 1)) AS i FROM a)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS k, round((-3 * v[i - 2] + 12 * v[i - 1] + 17 * v[i] + 12 * v[i + 1] - 3 * v[i + 2]) / 35, 6) AS v FROM i""")
def smoothed(spark, sf_dir):
    # the inner points of a window of five and an order of three have a closed form
    from prismal.functions import signal as S

    e = table(spark, sf_dir, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("y"))
    cfg = CFG | {"grid_step": 1.0, "smooth": {"window_cm": 3, "polyorder": 3}}
    out = e.select("vec_id", F.size("y").alias("n"), F.posexplode(S.smooth(F.col("y"), cfg)).alias("k", "v"))
    return out.filter((F.col("k") >= 2) & (F.col("k") < F.col("n") - 2)).select("vec_id", "k", r6(F.col("v"), "v"))


@query("""
WITH g AS (SELECT unnest(range(500, 1751)) AS x), p AS (SELECT p_partkey, p_retailprice AS f, p_size AS h FROM part)
SELECT p_partkey, round(max(h * 25 / (power(x - f, 2) + 25)), 6) AS top, round(sum(h * 25 / (power(x - f, 2) + 25)), 4) AS area FROM p, g GROUP BY 1""")
def rendered_lines(spark, sf_dir):
    from prismal.functions import signal as S

    one = lambda c: F.array(F.col(c).cast("double"))
    p = table(spark, sf_dir, "part").select("p_partkey", S.render(one("p_retailprice"), one("p_size"), F.array(F.lit(10.0)), CFG).alias("y"))
    return p.select("p_partkey", r6(F.array_max("y"), "top"), F.round(A.total(F.col("y")), 4).alias("area"))


@query("""
WITH a AS (SELECT source, max(toxic) AS y, avg(CAST(length(text) AS DOUBLE)) AS s FROM documents JOIN labels USING (doc_id) GROUP BY source || '/' || (doc_id % 40), source),
p AS (SELECT s AS pos FROM a WHERE y = 1), n AS (SELECT s AS neg FROM a WHERE y = 0)
SELECT count(*) AS n_pairs, round(avg(CASE WHEN abs(pos - neg) <= 1e-12 THEN 0.5 WHEN pos > neg THEN 1.0 ELSE 0.0 END), 6) AS wins FROM p, n""")
def pairs_won(spark, sf_dir):
    # pairs of a few hundred analytes
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("a", F.concat_ws("/", "source", (F.col("doc_id") % 40).cast("string")))
    s = d.groupBy("a").agg(F.avg(F.length("text").cast("double")).alias("s"))
    pairs = R.leave_pair_out(d, "a", "toxic")
    pairs = pairs.join(s.select(F.col("a").alias("pos"), F.col("s").alias("pos_score")), "pos").join(s.select(F.col("a").alias("neg"), F.col("s").alias("neg_score")), "neg")
    return R.pair_wins(pairs).agg(F.count("*").alias("n_pairs"), r6(F.avg("win"), "wins"))


@query(f"""
WITH u AS {_UNIT}
SELECT a.vec_id, count(b.vec_id) AS n_links FROM u a LEFT JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.4 - 1e-12 GROUP BY 1""")
def near_links(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.link_counts(e, "embedding", "vec_id", 0.4).withColumnRenamed("id", "vec_id")


# ---------------------------------------------------------------- without a SQL twin

@query(f"""
WITH d AS (SELECT coalesce(lang, '-') AS lang, source, CAST(quality >= 0.5 AS INTEGER) AS y, score, CAST(score >= 300 AS INTEGER) AS pred FROM {_LABELLED}),
s AS (SELECT 'all' AS subset, lang, source, y, score, pred FROM d UNION ALL SELECT 'long', lang, source, y, score, pred FROM d WHERE score >= 200
      UNION ALL SELECT 'all@source', lang, source, CAST(avg(y) >= 0.5 AS INTEGER), avg(score), CAST(avg(pred) >= 0.5 AS INTEGER) FROM d GROUP BY lang, source),
r AS (SELECT *, rank() OVER (PARTITION BY subset, lang ORDER BY score) + (count(*) OVER (PARTITION BY subset, lang, score) - 1) / 2.0 AS rk FROM s),
one AS (SELECT subset, lang, count(*) AS n_test, count(DISTINCT source) AS n_test_groups, sum(y) AS p, count(*) - sum(y) AS n,
               sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS up, (avg(CASE WHEN y = 1 THEN pred END) + avg(CASE WHEN y = 0 THEN 1 - pred END)) / 2 AS ba FROM r GROUP BY subset, lang),
lv AS (SELECT subset, lang, score, sum(y) AS p, count(*) - sum(y) AS n FROM s GROUP BY subset, lang, score),
cum AS (SELECT subset, lang, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM lv WINDOW w AS (PARTITION BY subset, lang ORDER BY score DESC)),
ap AS (SELECT subset, lang, sum(p * tp / (tp + fp)) / nullif(sum(p), 0) AS ap FROM cum GROUP BY subset, lang),
m AS (SELECT subset, lang, n_test, n_test_groups, 'auroc' AS metric, (up - p * (p + 1) / 2.0) / nullif(p * n, 0) AS value FROM one
      UNION ALL SELECT subset, lang, n_test, n_test_groups, 'balanced_accuracy', ba FROM one
      UNION ALL SELECT subset, lang, n_test, n_test_groups, 'auprc', ap FROM one JOIN ap USING (subset, lang))
SELECT lang, subset, metric, round(value, 6) AS value, n_test, n_test_groups FROM m""")
def subset_report(spark, sf_dir):
    d = _labelled(spark, sf_dir).select(
        F.coalesce("lang", F.lit("-")).alias("lang"), F.col("source").alias("grp"), (F.col("quality") >= 0.5).cast("int").alias("y"), "score", (F.col("score") >= 300).cast("int").alias("pred"))
    out = subsets.subset_metrics(d, {"all": F.lit(True), "long": F.col("score") >= 200}, ["lang"], 0, vote=("grp", "source"), vote_subsets=["all"])
    return out.select("lang", "subset", "metric", r6(F.col("value"), "value"), "n_test", "n_test_groups")


@query(f"""
WITH labelled AS {_LABELLED}, ci AS ({B.area_interval_sql("SELECT source AS grp, quality AS y, score FROM labelled", 1000, 7)})
SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, n_ok FROM ci""")
def bootstrap_interval(spark, sf_dir):
    ci = B.area_interval(_labelled(spark, sf_dir), "source", "quality", "score", 1000, 7)
    return ci.select(r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"), "n_ok")


@query(f"""
WITH labelled AS {_LABELLED}, areas AS ({H.null_areas_sql("SELECT doc_id AS grp, quality AS y, score FROM labelled", 1000, 3)}),
r AS (SELECT auroc FROM areas WHERE perm < 0)
SELECT round(any_value(r.auroc), 6) AS auroc, CAST(1 + count_if(a.auroc >= r.auroc - 1e-12) AS DOUBLE) / (1 + count(*)) AS p, round(avg(a.auroc), 6) AS null_mean, CAST(count(*) AS INTEGER) AS n_perm
FROM areas a, r WHERE a.perm >= 0""")
def permutation_test(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    found = H.against_null(H.null_areas(d, "doc_id", "quality", "score", 1000, None, 3))
    return found.select(r6(F.col("auroc"), "auroc"), "p", r6(F.col("null_mean"), "null_mean"), "n_perm")


@query()
def crc_subsample(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(I.in_subsample(F.col("doc_id").cast("string"), 0.2)).select("doc_id")


# ---------------------------------------------------------------- kernels on whole signals

_POINTS = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS y, len(embedding) AS n, unnest(range(len(embedding))) AS k FROM embeddings)"


def _points(df: DataFrame, signal, name: str = "v") -> DataFrame:
    return df.select("vec_id", F.posexplode(signal).alias("k", name)).select("vec_id", "k", r6(F.col(name), name))


@query(f"""
WITH t AS (SELECT j, exp(-0.5 * power(j / (6 / (2 * sqrt(2 * ln(2)))), 2)) AS w FROM range(-10, 11) r(j)), s AS (SELECT sum(w) AS s FROM t)
SELECT vec_id, CAST(k AS INTEGER) AS k, round(sum(w / s * y[least(greatest(k + j, 0), n - 1) + 1]), 6) AS v FROM {_POINTS}, t, s GROUP BY vec_id, k""")
def signal_broadened(spark, sf_dir):
    from prismal.functions import signal as S

    return _points(table(spark, sf_dir, "embeddings"), S.broaden(A.doubles(F.col("embedding")), 6.0, 1.0))


@query(f"""
WITH p AS (SELECT vec_id, k, y, least(greatest(k, 5), n - 6) AS c FROM {_POINTS}),
m AS (SELECT vec_id, k, any_value(k - c) AS off, sum(j * y[c + j + 1]) / 110.0 AS one, (11 * sum(j * j * y[c + j + 1]) - 110 * sum(y[c + j + 1])) / 9438.0 AS two FROM p, range(-5, 6) r(j) GROUP BY vec_id, k)
SELECT vec_id, CAST(k AS INTEGER) AS k, round(one + 2 * off * two, 6) AS v FROM m""")
def signal_derivative(spark, sf_dir):
    from prismal.functions import signal as S

    return _points(table(spark, sf_dir, "embeddings"), S.derivative(A.doubles(F.col("embedding"))))


def _window(e: DataFrame) -> list[float]:
    return [0.0, float(e.agg(F.max(F.size("embedding"))).first()[0] - 1)]


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS y, len(embedding) AS n FROM embeddings), g AS (SELECT vec_id, y, unnest(range(2 * n - 1)) AS k FROM e)
SELECT vec_id, CAST(k AS INTEGER) AS k, round((y[k // 2 + 1] + y[(k + 1) // 2 + 1]) / 2, 6) AS v FROM g""")
def signal_resampled(spark, sf_dir):
    from prismal.functions import signal as S

    e = table(spark, sf_dir, "embeddings")
    x = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("double"))
    return _points(e, S.interpolate(x, A.doubles(F.col("embedding")), {"window": _window(e), "grid_step": 0.5}))


@query(f"""
SELECT vec_id, CAST(k AS INTEGER) AS k, round(sum(abs(y[i + 1]) * 4.0 / ((k - i) * (k - i) + 4.0)), 6) AS v
FROM (SELECT *, unnest(range(n)) AS i FROM {_POINTS}) GROUP BY vec_id, k""")
def lines_drawn(spark, sf_dir):
    from prismal.functions import signal as S

    e = table(spark, sf_dir, "embeddings")
    at = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("double"))
    heights = F.transform(A.doubles(F.col("embedding")), lambda h: F.abs(h))
    widths = F.transform("embedding", lambda _: F.lit(4.0))
    return _points(e, S.render(at, heights, widths, {"window": _window(e), "grid_step": 1.0}))


@query()
def signal_peaks(spark, sf_dir):
    from prismal.functions import signal as S

    e = table(spark, sf_dir, "embeddings")
    cfg = variant() | {"window": _window(e), "smooth": {"window_cm": 5, "polyorder": 2}}
    y = F.transform(A.doubles(F.col("embedding")), lambda x: F.abs(x))
    return e.select("vec_id", X.peaks_text(S.find_peaks(y, cfg), cfg).alias("text"))


@query(f"""
WITH p AS (SELECT vec_id, k, n, abs(y[k + 1]) AS v FROM {_POINTS}),
q AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
m AS (SELECT vec_id, k, n, v FROM q WHERE v > before AND v > after),
b AS (SELECT vec_id, m.k, m.n, m.v, coalesce(max(p.k) FILTER (p.k < m.k AND p.v > m.v), -1) AS lo, coalesce(min(p.k) FILTER (p.k > m.k AND p.v > m.v), m.n) AS hi FROM m JOIN p USING (vec_id) GROUP BY 1, 2, 3, 4),
h AS (SELECT vec_id, b.k, b.v, b.v - greatest(min(p.v) FILTER (p.k > lo AND p.k < b.k), min(p.v) FILTER (p.k > b.k AND p.k < hi)) AS prominence FROM b JOIN p USING (vec_id) GROUP BY vec_id, b.k, b.v),
c AS (SELECT vec_id, h.k, h.v, prominence, h.v - prominence / 2 AS level, max(p.k) FILTER (p.k < h.k AND p.v <= h.v - prominence / 2) AS a, min(p.k) FILTER (p.k > h.k AND p.v <= h.v - prominence / 2) AS b FROM h JOIN p USING (vec_id) GROUP BY ALL),
x AS (SELECT c.*, p.v AS va FROM c JOIN p ON p.vec_id = c.vec_id AND p.k = a), y AS (SELECT x.*, p.v AS va1 FROM x JOIN p ON p.vec_id = x.vec_id AND p.k = a + 1),
z AS (SELECT y.*, p.v AS vb FROM y JOIN p ON p.vec_id = y.vec_id AND p.k = b), u AS (SELECT z.*, p.v AS vb1 FROM z JOIN p ON p.vec_id = z.vec_id AND p.k = b - 1)
SELECT vec_id, CAST(k AS INTEGER) AS k, round(prominence, 6) AS prominence, round(a + (level - va) / (va1 - va), 4) AS lo, round(b - (level - vb) / (vb1 - vb), 4) AS hi FROM u""")
def peak_shapes(spark, sf_dir):
    """Prominence and half-prominence extent of every maximum of the absolute values."""
    from prismal.functions import signal as S

    e = table(spark, sf_dir, "embeddings")
    y = F.transform(A.doubles(F.col("embedding")), lambda x: F.abs(x))
    p = e.select("vec_id", F.explode(S.peak_shapes(y)).alias("p"))
    ends = (F.round(F.col(f"p.{a}"), 4).alias(b) for a, b in (("left", "lo"), ("right", "hi")))
    return p.select("vec_id", F.col("p.at").cast("int").alias("k"), r6(F.col("p.prominence"), "prominence"), *ends)


@query(f"""
WITH m AS (SELECT label, k, avg(y[k + 1]) AS r FROM {_POINTS} JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY 1, 2),
l AS (SELECT label, list(r ORDER BY k) AS r FROM m GROUP BY 1),
t AS (SELECT vec_id, k, n, y[k + 1] AS v, r, d / 4.0 AS d, k - d / 4.0 AS x FROM {_POINTS} JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) JOIN l USING (label), range(-4, 5) s(d)),
c AS (SELECT vec_id, k, n, v, d, r, least(greatest(x, 0), n - 1) AS x FROM t),
i AS (SELECT vec_id, k, v, d, (1 - (x - floor(x))) * r[CAST(floor(x) AS INTEGER) + 1] + (x - floor(x)) * r[CAST(ceil(x) AS INTEGER) + 1] AS r FROM c),
f AS (SELECT vec_id, d, greatest(0, sum(r * v) / sum(r * r)) AS s FROM i WHERE k BETWEEN 5 AND 25 OR k BETWEEN 35 AND 60 GROUP BY 1, 2),
e AS (SELECT vec_id, d, s, sum(power(v - s * r, 2)) AS err FROM i JOIN f USING (vec_id, d) WHERE k BETWEEN 5 AND 25 OR k BETWEEN 35 AND 60 GROUP BY 1, 2, 3),
b AS (SELECT vec_id, d, s FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(err, 9), d) = 1)
SELECT vec_id, round(s, 6) AS scale, d AS shift, round(sum(power(v - s * r, 2)), 6) AS rest FROM b JOIN i USING (vec_id, d) GROUP BY 1, 2, 3""")
def reference_subtracted(spark, sf_dir):
    """Every vector less the mean of its label, moved by at most one point and scaled: factor, shift and what is left."""
    from prismal.functions import signal as S

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("y"))
    means = V.mean_vectors(e, "y", "label").select("label", F.col("mean").alias("ref"))
    cfg = {"window": _window(table(spark, sf_dir, "embeddings")), "grid_step": 1.0, "substrate": {"fit_regions": [[5, 25], [35, 60]], "max_shift_cm": 1.0, "error_decimals": 9}}
    out = e.join(means, "label").select("vec_id", S.subtract_reference(F.col("y"), F.col("ref"), cfg).alias("s"))
    return out.select("vec_id", r6(F.col("s.scale"), "scale"), F.col("s.shift").alias("shift"), r6(A.dot(F.col("s.rest"), F.col("s.rest")), "rest"))


@query()
def signal_baseline(spark, sf_dir):
    """Asymmetric least squares baselines; iterated, so tests hold it against dense solutions."""
    from prismal.functions import signal as S

    return _points(table(spark, sf_dir, "embeddings"), S.baseline(A.doubles(F.col("embedding")), 50.0, 0.05, 10))


@query(f"""
WITH x AS (SELECT vec_id, label, CAST(label AS INTEGER) % 2 AS y, k, v FROM ({_LONG})), s AS (SELECT label, y, k, sum(v) AS s, count(*) AS n FROM x GROUP BY 1, 2, 3),
t AS (SELECT k, sum(s) AS t, sum(n) AS m, sum(CASE WHEN y = 1 THEN s ELSE 0 END) AS t1, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS m1 FROM s GROUP BY k),
p AS (SELECT a.label AS pos, b.label AS neg, k, (t - a.s - b.s) / (m - a.n - b.n) AS c, (t1 - a.s) / (m1 - a.n) AS p1, (t - t1 - b.s) / (m - m1 - b.n) AS p0
  FROM s a JOIN s b USING (k) JOIN t USING (k) WHERE a.y = 1 AND b.y = 0),
w AS (SELECT pos, neg, k, c, (p1 - c) / sqrt(sum(power(p1 - c, 2)) OVER q) - (p0 - c) / sqrt(sum(power(p0 - c, 2)) OVER q) AS w FROM p WINDOW q AS (PARTITION BY pos, neg)),
u AS (SELECT vec_id, pos, neg, label, sum((v - c) * w) / sqrt(sum(power(v - c, 2))) AS sc FROM x JOIN w USING (k) WHERE label = pos OR label = neg GROUP BY 1, 2, 3, 4),
r AS (SELECT pos, neg, avg(CASE WHEN label = pos THEN sc END) AS a, avg(CASE WHEN label = neg THEN sc END) AS b FROM u GROUP BY 1, 2)
SELECT CAST(pos AS VARCHAR) AS pos, CAST(neg AS VARCHAR) AS neg, round(a, 6) AS pos_score, round(b, 6) AS neg_score, CASE WHEN a > b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS win FROM r""")
def pairs_held_out(spark, sf_dir):
    """Centroid models told apart by odd and even labels, each fitted without one label of either kind."""
    from prismal.operators import pairs_out as O

    e = table(spark, sf_dir, "embeddings").select("label", (F.col("label") % 2).cast("int").alias("y"), "embedding")
    return O.centroid_pairs(e, "embedding", "y", "label").select("pos", "neg", r6(F.col("pos_score"), "pos_score"), r6(F.col("neg_score"), "neg_score"), "win")


@query()
def logistic_auroc(spark, sf_dir):
    from prismal.operators import estimators as E

    e = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") == 1).cast("int"))
    model = E.make("logistic")(e.filter("vec_id % 5 <> 0"), "embedding", "y", c=0.1)
    return M.auroc(model.apply(e.filter("vec_id % 5 = 0")), "y", "score").select(F.round("auroc", 4).alias("auroc"), "n_pos", "n_neg")


@query()
def plsda_report(spark, sf_dir):
    from prismal.operators import estimators as E

    e = table(spark, sf_dir, "embeddings")
    model = E.make("plsda")(e.filter("vec_id % 5 <> 0"), "embedding", "label", k=5)
    return M.multiclass_report(model.apply(e.filter("vec_id % 5 = 0")), "label", "pred")


@query()
def refit_permutation_test(spark, sf_dir):
    from prismal.plans import experiments as X

    part = F.col("vec_id") % 20
    rows = table(spark, sf_dir, "embeddings").select("embedding", F.concat_ws("-", "label", part).alias("grp"), (F.col("label") == 0).cast("int").alias("y"), (part % 5).alias("fold"))
    found = X.refit_permutation(rows, "embedding", "y", "grp", "fold", X.Context())
    return found.select(r6(F.col("auroc"), "auroc"), r6(F.col("p"), "p"), r6(F.col("null_mean"), "null_mean"), "n_perm")


@query()
def refitted_nulls(spark, sf_dir):
    from functools import reduce

    from prismal.plans import experiments as X

    part = F.col("vec_id") % 20
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat_ws("-", "label", part).alias("grp"), (F.col("label") == 0).cast("int").alias("y"), (part % 5).alias("fold"))
    each = []
    for model in ("logistic", "plsda", "knn"):
        found = X.refit_permutation(rows, "embedding", "y", "grp", "fold", X.Context(), model=model)
        each.append(found.select(F.lit(model).alias("model"), r6(F.col("auroc"), "auroc"), r6(F.col("p"), "p"), r6(F.col("null_mean"), "null_mean"), "n_perm"))
    return reduce(lambda a, b: a.unionByName(b), each)


@query()
def joint_probes(spark, sf_dir):
    from prismal.plans import ladder

    # the halves of a vector stand for two layers, one-against-rest labels for a record's labels
    e = table(spark, sf_dir, "embeddings").withColumn("v", A.doubles(F.col("embedding")))
    half = F.floor(F.size("v") / 2).cast("int")
    layers = F.array(F.struct(F.lit(0).alias("source"), F.slice("v", F.lit(1), half).alias("v")), F.struct(F.lit(1).alias("source"), F.slice("v", half + 1, half).alias("v")))
    names = [f"is_{k}" for k in range(5)]
    rows = e.select("vec_id", *((F.col("label") == k).cast("int").alias(n) for k, n in enumerate(names)), F.explode(layers).alias("l")).select("vec_id", *names, "l.*")
    part = F.col("vec_id") % 5
    probes = ladder.joint_probes(rows.filter(part > 1), rows.filter(part == 1), names)
    test = rows.filter(part == 0).select("*", F.concat(F.lit("R"), (F.col("vec_id") % 2).cast("string")).alias("rung"), F.col("vec_id").alias("analyte"))
    return ladder.joint_rungs(probes, test).select("label", "rung", "source", F.round("auroc", 4).alias("auroc"), "n_pos", "n_neg")
