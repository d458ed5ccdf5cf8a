"""Clusters, trained models, networks and embeddings."""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import functions as F

from ..functions import isax
from ..operators import clusters as C, embed as E, features as X, learn as L, neural as N, patterns as T, rules as R
from ..functions.runtime import durable
from ..operators.score import score
from ..sources.tables import table
from .base import KEYS, PANEL
from .q_features import qty_panel, supervised_sql
from .q_forecast import H, ORIGIN
from .q_patterns import SBC_SQL, VARIATION_SQL
from .registry import query

CUT = dt.date(2001, 2, 1)  # first period that is forecast
PROFILE = ["adi", "cv2", "cv", "mean", "zero_share"]

# ---- clustering ---------------------------------------------------------------------------------


def stored_panel(spark, sf):
    """The panel, written once: the steps below read it several times."""
    return durable(qty_panel(spark, sf))


def wide_profile(spark, sf):
    return durable(T.wide_profile(qty_panel(spark, sf), KEYS).select(*KEYS, *PROFILE))


def z_profile(spark, sf):
    return C.cluster_input(wide_profile(spark, sf), PROFILE, KEYS)


Z_SQL = PANEL + f""", {SBC_SQL}, {VARIATION_SQL},
prof AS (SELECT p_brand, c_nationkey, avg(qty) AS mean, avg(CASE WHEN qty = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS zero_share
         FROM panel GROUP BY ALL),
wide AS (SELECT p_brand, c_nationkey, adi, cv2, cv, mean, zero_share, segment
         FROM sbc JOIN cv USING (p_brand, c_nationkey) JOIN prof USING (p_brand, c_nationkey)),
z AS (SELECT p_brand, c_nationkey, segment, {", ".join(
    f"CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN coalesce(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 0.0) ELSE 0.0 END AS {c}"
    for c in PROFILE)} FROM wide)"""


@query("cluster_input", Z_SQL + f" SELECT p_brand, c_nationkey, {', '.join(PROFILE)} FROM z", rounded=" ".join(PROFILE))
def _(spark, sf):
    return z_profile(spark, sf)


@query("kmeans_segments", rounded=" ".join(PROFILE))
def _(spark, sf):
    return C.kmeans(z_profile(spark, sf), KEYS, PROFILE, 4)[0]


@query("bisecting_segments", rounded=" ".join(PROFILE))
def _(spark, sf):
    return C.bisecting(z_profile(spark, sf), KEYS, PROFILE, 4)[0]


@query("gmm_segments", rounded="p_0 p_1 p_2")
def _(spark, sf):
    return C.gmm(z_profile(spark, sf), KEYS, PROFILE, 3)[0].select(*KEYS, "cluster", "p_0", "p_1", "p_2")


@query("choose_k", rounded="silhouette cost")
def _(spark, sf):
    return C.choose_k(z_profile(spark, sf), KEYS, PROFILE, [2, 3, 4, 5])


NEAR_SQL = Z_SQL + f""",
cent AS (SELECT segment, {", ".join(f"avg({c}) AS {c}" for c in PROFILE)} FROM z GROUP BY segment),
dist AS (SELECT z.p_brand, z.c_nationkey, z.segment AS rule, cent.segment AS cluster,
                {" + ".join(f"power(z.{c} - cent.{c}, 2)" for c in PROFILE)} AS d, {", ".join(f"z.{c}" for c in PROFILE)}
         FROM z CROSS JOIN cent),
near AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY p_brand, c_nationkey ORDER BY round(d, 10), cluster) = 1)"""


def near_profile(spark, sf):
    """Series assigned to the mean profile of each rule-based class."""
    wide = wide_profile(spark, sf)
    z = C.cluster_input(wide, PROFILE, KEYS)
    rule = R.classify_sbc(wide).select(*KEYS, F.col("segment").alias("rule"))
    labelled = durable(z.join(rule, KEYS))
    return C.assign(labelled, C.centroids_of(labelled, "rule", PROFILE), "rule", PROFILE)


@query("nearest_centroid", NEAR_SQL + " SELECT p_brand, c_nationkey, rule, cluster, sqrt(d) AS distance FROM near", rounded="distance")
def _(spark, sf):
    return near_profile(spark, sf).select(*KEYS, "rule", "cluster", "distance")


@query("cluster_profile", NEAR_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT cluster, '{c}' AS feature, count(*) AS size, avg({c}) AS mean, quantile_cont({c}, 0.25) AS q1, "
    f"quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM near GROUP BY cluster" for c in PROFILE),
    rounded="mean q1 median q3")
def _(spark, sf):
    return C.cluster_profile(near_profile(spark, sf), "cluster", PROFILE)


@query("partition_agreement", NEAR_SQL + """,
cells AS (SELECT rule, cluster, count(*) AS n FROM near GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS ab,
             (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY rule)) AS a,
             (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY cluster)) AS b,
             (SELECT CAST(sum(n) AS BIGINT) FROM cells) AS n_rows)
SELECT n_rows, (n_rows * (n_rows - 1) / 2 + 2 * ab - a - b) / (n_rows * (n_rows - 1) / 2) AS rand_index FROM s""",
    rounded="rand_index")
def _(spark, sf):
    return C.agreement(near_profile(spark, sf), "rule", "cluster")


@query("partition_contingency", NEAR_SQL + " SELECT rule, cluster, count(*) AS n FROM near GROUP BY ALL")
def _(spark, sf):
    return C.contingency(near_profile(spark, sf), "rule", "cluster")


# ---- trained models -----------------------------------------------------------------------------

COLS = X.feature_names()


def matrix(spark, sf):
    """Feature matrix of all rows; heads and series without a sale yet lack some features."""
    return durable(X.supervised(qty_panel(spark, sf), KEYS, "month", h=1))


def split(sup):
    return sup.where(F.col("period") < F.lit(CUT)), sup.where(F.col("period") >= F.lit(CUT))


def trained(spark, sf, fit, name):
    train, test = split(matrix(spark, sf))
    return L.predict(fit(train, KEYS, COLS), test, KEYS, name)


@query("ml_linear", rounded="yhat")
def _(spark, sf):
    return trained(spark, sf, partial(L.fit_linear, reg=0.1, en=0.5), "linear")


@query("ml_forest", rounded="yhat")
def _(spark, sf):
    return trained(spark, sf, L.fit_forest, "forest")


@query("ml_gbt", rounded="yhat")
def _(spark, sf):
    return trained(spark, sf, L.fit_gbt, "gbt")


@query("ml_count_glm", rounded="yhat")
def _(spark, sf):
    train, test = split(matrix(spark, sf))
    one = lambda family: L.predict(L.fit_glm(train, KEYS, COLS, family), test, KEYS, family)
    return one("poisson").unionByName(one("tweedie"))


@query("ml_direct", rounded="yhat")
def _(spark, sf):
    return L.direct(stored_panel(spark, sf), KEYS, "month", ORIGIN, H, partial(L.fit_linear, reg=0.1))


@query("ml_recursive", rounded="yhat")
def _(spark, sf):
    return L.recursive(stored_panel(spark, sf), KEYS, "month", ORIGIN, H, L.fit_gbt)


@query("feature_importance", rounded="importance")
def _(spark, sf):
    train, _ = split(matrix(spark, sf))
    return L.importance(L.fit_gbt(train, KEYS, COLS), spark)


@query("ml_backtest", rounded="mae rmse wape smape bias rmsle")
def _(spark, sf):
    p = stored_panel(spark, sf)
    sup = X.supervised(p, KEYS, "month", h=1)
    cuts = [dt.date(2000, 2, 1), dt.date(2000, 8, 1), CUT]
    fc = L.backtest_model(sup, KEYS, COLS, cuts, dt.date(2001, 8, 1), partial(L.fit_linear, reg=0.1), "linear")
    return score(fc, KEYS, ["model", "cut"], actual=p)


@query("hurdle_forecast", rounded="p_sold size yhat")
def _(spark, sf):
    train, test = split(matrix(spark, sf))
    return L.hurdle(train, test, KEYS, COLS)


@query("residual_model", rounded="base yhat")
def _(spark, sf):
    train, test = split(matrix(spark, sf))
    return L.residual(train, test, KEYS, COLS, "mean_12", L.fit_gbt)


# ---- networks -----------------------------------------------------------------------------------

LOOK = 12
CSV = lambda c: F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",")


@query("lookback_windows", PANEL + """,
b AS (SELECT p_brand, c_nationkey, lag(period) OVER w AS origin, lead(period, 2) OVER w AS period, lead(qty, 2) OVER w AS target,
             list(qty) OVER (PARTITION BY p_brand, c_nationkey ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x
      FROM panel WINDOW w AS (PARTITION BY p_brand, c_nationkey ORDER BY period))
SELECT p_brand, c_nationkey, origin, 3 AS h, period, target,
       array_to_string(list_transform(x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS lookback
FROM b WHERE len(x) = 12 AND target IS NOT NULL""")
def _(spark, sf):
    w = L.windows(qty_panel(spark, sf), KEYS, LOOK, h=3)
    return w.withColumn("lookback", CSV("lookback"))


def one_step(spark, sf):
    w = durable(L.windows(qty_panel(spark, sf), KEYS, LOOK))
    return w.where(F.col("period") < F.lit(CUT)), w.where(F.col("period") >= F.lit(CUT))


@query("demand_bins", PANEL + """,
t AS (SELECT qty AS target FROM (
        SELECT *, row_number() OVER (PARTITION BY p_brand, c_nationkey ORDER BY period) AS i FROM panel)
      WHERE i > 12 AND period < DATE '2001-02-01'),
q AS (SELECT list_distinct(quantile_cont(target, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS b FROM t),
x AS (SELECT target, CAST(len(list_filter(b, lambda v: target > v)) AS INTEGER) AS bin FROM t, q)
SELECT bin, count(*) AS n, min(target) AS lo, max(target) AS hi, avg(target) AS mean FROM x GROUP BY bin""", rounded="mean")
def _(spark, sf):
    return N.bins(one_step(spark, sf)[0], 8)


@query("nn_bins_forecast", rounded="yhat")
def _(spark, sf):
    train, test = one_step(spark, sf)
    return N.predict_nn_bins(test, KEYS, LOOK, N.fit_nn_bins(train, KEYS, LOOK))


@query("nn_regression")
def _(spark, sf):
    # Score of the network against the mean of its window, on the held-out periods.
    train, test = one_step(spark, sf)
    net = N.fit_nn(train, LOOK)
    fc = N.predict_nn(test, KEYS, net)
    mean = F.aggregate("lookback", F.lit(0.0), lambda s, x: s + x) / LOOK
    base = test.select(*KEYS, "origin", F.lit("window_mean").alias("model"), "h", "period", mean.alias("yhat"))
    out = score(fc.unionByName(base), KEYS, ["model"], actual=test.withColumnRenamed("target", "qty"))
    return out.withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "wape", "smape", "bias", "rmsle")})


@query("nn_score", rounded="yhat", digits=3)
def _(spark, sf):
    train, test = one_step(spark, sf)
    return N.predict_nn(test, KEYS, N.fit_nn(train, LOOK, epochs=20))


# ---- embeddings ---------------------------------------------------------------------------------


@query("embed_pca", rounded="pc_1 pc_2 pc_3")
def _(spark, sf):
    w = durable(E.scaled_windows(L.windows(qty_panel(spark, sf), KEYS, LOOK), LOOK))
    return E.embed_pca(w.select(*KEYS, "period", "emb"), KEYS, 3)[0].drop("emb")


SAX_SQL = PANEL + """,
s AS (SELECT *, avg(qty) OVER p AS m, stddev_pop(qty) OVER p AS sd, count(*) OVER p AS n,
             row_number() OVER (PARTITION BY p_brand, c_nationkey ORDER BY period) - 1 AS i
      FROM panel WINDOW p AS (PARTITION BY p_brand, c_nationkey)),
g AS (SELECT p_brand, c_nationkey, CAST(floor(i * 16 / n) AS INTEGER) AS segment,
             avg(CASE WHEN sd > 1e-12 THEN (qty - m) / sd ELSE 0.0 END) AS z FROM s GROUP BY ALL),
l AS (SELECT *, CASE WHEN z < -0.6744897501960817 THEN 'a' WHEN z < 0 THEN 'b' WHEN z < 0.6744897501960817 THEN 'c' ELSE 'd' END AS letter
      FROM g)
"""


@query("sax_words", SAX_SQL + "SELECT p_brand, c_nationkey, string_agg(letter, '' ORDER BY segment) AS word FROM l GROUP BY ALL")
def _(spark, sf):
    return E.sax(qty_panel(spark, sf), KEYS, 16, 4).select(*KEYS, "word")


@query("embed_word2vec", rounded="emb_1 emb_2 emb_3 emb_4")
def _(spark, sf):
    words = durable(E.sax(qty_panel(spark, sf), KEYS, 16, 4))
    emb, _ = E.embed_word2vec(words, KEYS, 4)
    return E.add_embeddings(emb.select(*KEYS, "word"), emb, KEYS, 4)


@query("embed_stats", Z_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT p_brand, c_nationkey, {i} AS dim, {c} AS value FROM z" for i, c in enumerate(PROFILE)), rounded="value")
def _(spark, sf):
    emb = E.embed_stats(wide_profile(spark, sf), KEYS, PROFILE)
    return emb.select(*KEYS, F.posexplode("emb").alias("dim", "value"))


@query("similar_topk", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_cosine_similarity(a.e, b.e), 9) AS similarity
      FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT query_id, neighbour_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) AS INTEGER) AS rank
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) <= 5""", rounded="similarity")
def _(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return E.topk(v, v, 5, "vec_id", "embedding")


def label_means(spark, sf):
    """The mean vector of each label."""
    v = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = v.groupBy("label", "i").agg(F.avg("x").cast("float").alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "x")))
    return mean.groupBy("label").agg(F.transform(ordered, lambda p: p["x"]).alias("embedding"))


@query("similar_lsh", rounded="distance")
def _(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    q = label_means(spark, sf).select(F.col("label").cast("bigint").alias("id"), F.col("embedding").alias("emb"))
    return E.lsh_pairs(v, q, d=0.95, bucket=0.5)


ANALOG_TAIL = """,
f AS (SELECT p_brand, c_nationkey, j, any_value(qm) + any_value(qd) * avg((nxt[j] - m) / d) AS yhat FROM top, range(1, 7) AS r(j) GROUP BY ALL),
flat AS (SELECT p_brand, c_nationkey, avg(qty) FILTER (WHERE period > DATE '2000-01-01') AS flat FROM panel
         WHERE period <= DATE '2001-01-01' GROUP BY ALL)
SELECT p_brand, c_nationkey, DATE '2001-01-01' AS origin, '{name}' AS model, CAST(j AS INTEGER) AS h,
       CAST(DATE '2001-01-01' + to_months(CAST(j AS INTEGER)) AS DATE) AS period, coalesce(yhat, flat) AS yhat
FROM (SELECT * FROM flat, range(1, 7) AS r(j)) LEFT JOIN f USING (p_brand, c_nationkey, j)"""
ANALOG_SQL = PANEL + """,
w AS (SELECT p_brand, c_nationkey, period, list(qty) OVER b AS x, list(qty) OVER f AS nxt FROM panel WHERE period <= DATE '2001-01-01'
      WINDOW b AS (PARTITION BY p_brand, c_nationkey ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
             f AS (PARTITION BY p_brand, c_nationkey ORDER BY period ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
u AS (SELECT *, list_avg(x) AS m, list_stddev_pop(x) AS d FROM w WHERE len(x) = 12),
c AS (SELECT *, list_transform(x, lambda v: (v - m) / d) AS z FROM u WHERE d > 1e-9),
pairs AS (
  SELECT q.p_brand, q.c_nationkey, q.m AS qm, q.d AS qd, k.nxt, k.m, k.d, k.period AS kp,
         concat_ws('|', k.p_brand, k.c_nationkey, k.period) AS kid, round(list_cosine_similarity(q.z, k.z), 9) AS sim
  FROM c q JOIN c k ON len(k.nxt) = 6 AND {match} WHERE q.period = DATE '2001-01-01'),
top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY p_brand, c_nationkey ORDER BY sim DESC, {tie}) <= 3)
"""


@query("analog_forecast_own", ANALOG_SQL.replace("{match}", "q.p_brand = k.p_brand AND q.c_nationkey = k.c_nationkey").replace(
    "{tie}", "kp DESC") + ANALOG_TAIL.replace("{name}", "analog_own"), rounded="yhat")
def _(spark, sf):
    return E.analog_own(qty_panel(spark, sf), KEYS, "month", ORIGIN, H, LOOK, 3)


@query("analog_forecast", ANALOG_SQL.replace("{match}", "true").replace("{tie}", "kid") + ANALOG_TAIL.replace("{name}", "analog"),
       rounded="yhat")
def _(spark, sf):
    return E.analog(qty_panel(spark, sf), KEYS, "month", ORIGIN, H, LOOK, 3)


@query("analog_indexed", ANALOG_SQL.replace("{match}", "true").replace("{tie}", "kid") + ANALOG_TAIL.replace("{name}", "analog_indexed"),
       rounded="yhat")
def _(spark, sf):
    return E.analog_indexed(qty_panel(spark, sf), KEYS, "month", ORIGIN, H, LOOK, 3)


@query("similar_indexed", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_cosine_similarity(a.e, b.e), 9) AS similarity
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, neighbour_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) AS INTEGER) AS rank
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) <= 5""", rounded="similarity")
def _(spark, sf):
    # a search through the index: its queries are the vectors whose id is divisible by 20
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return isax.topk(v, v.where("vec_id % 20 = 0"), 5, "vec_id", "embedding").drop("compared")


@query("embed_clusters")
def _(spark, sf):
    # Clusters of the vectors against the label they came with.
    v = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    out, _ = E.embed_clusters(v, ["vec_id"], 10, emb="embedding")
    return C.agreement(out, "label", "cluster")


KNOWN_Z = Z_SQL.replace("FROM panel", "FROM known").replace(PANEL, PANEL + ", known AS (SELECT * FROM panel WHERE period < DATE '2000-01-01')", 1)


@query("embed_features", KNOWN_Z + f""", {supervised_sql(1)}
SELECT s.*, {", ".join(f"z.{c} AS emb_{i + 1}" for i, c in enumerate(PROFILE))}
FROM supervised s LEFT JOIN z USING (p_brand, c_nationkey) WHERE origin IS NOT NULL AND period >= DATE '2000-01-01'""", rounded=" ".join([f"emb_{i}" for i in range(1, 6)] + ["mean_3", "sd_3", "zero_share_3", "mean_12", "sd_12", "zero_share_12"]))
def _(spark, sf):
    return embedded_features(stored_panel(spark, sf), dt.date(2000, 1, 1))


def embedded_features(p, cut):
    """Features of the periods from ``cut`` on, with embeddings that know the periods before it only."""
    wide = durable(T.wide_profile(p.where(F.col("period") < F.lit(cut)), KEYS).select(*KEYS, *PROFILE))
    rows = X.supervised(p, KEYS, "month").where(F.col("period") >= F.lit(cut))
    return E.add_embeddings(rows, E.embed_stats(wide, KEYS, PROFILE), KEYS, len(PROFILE))
