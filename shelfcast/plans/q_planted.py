"""Trained models and clusters on labels planted in the given tables, so that SQL knows the answer.

The labels are functions of panel rows that a model of the kind can represent exactly; a model that
finds them gives them back for later periods.
"""

from __future__ import annotations

import datetime as dt
from functools import partial

import numpy as np
from pyspark.sql import functions as F

from ..functions.columns import as_col
from ..functions.runtime import durable
from ..operators import clusters as C, density as D, embed as E, forecast as FC, hybrid as Y, learn as L, neural as N, patterns as T, rules as R
from ..operators.score import score
from ..sources.tables import table
from .base import KEYS, PANEL
from .q_features import qty_panel, supervised_sql
from .q_forecast import H, MODELS, ORIGIN, fc_sql
from .q_models import ANALOG_SQL, ANALOG_TAIL, COLS, LOOK, SAX_SQL, label_means, matrix, split
from .q_patterns import VARIATION_SQL
from .registry import query

SUP = PANEL + ", " + supervised_sql(1)
FRAME = "p_brand, c_nationkey, origin, '{}' AS model, h, period"
LATER = "FROM supervised WHERE origin IS NOT NULL AND period >= DATE '2001-02-01'"
STEP_SQL = "CASE WHEN month <= 6 THEN 10.0::DOUBLE ELSE 40.0::DOUBLE END"


def step():
    return F.when(F.col("month") <= 6, 10.0).otherwise(40.0)


def planted(spark, sf, label, fit, cols, name):
    train, test = split(matrix(spark, sf))
    return L.predict(fit(train.withColumn("label", label), KEYS, cols), test, KEYS, name)


@query("planted_linear", SUP + f"""
SELECT {FRAME.format('linear')}, 5 + 0.5 * lag_1 + 0.25 * lag_12 + 0.125 * month AS yhat {LATER}""", rounded="yhat", digits=3)
def _(spark, sf):
    col = lambda c: F.coalesce(c, F.lit(0.0))
    label = 5 + 0.5 * col("lag_1") + 0.25 * col("lag_12") + 0.125 * F.col("month")
    return planted(spark, sf, label, L.fit_linear, ["lag_1", "lag_12", "month"], "linear")


@query("planted_forest", SUP + f" SELECT {FRAME.format('forest')}, {STEP_SQL} AS yhat {LATER}", rounded="yhat")
def _(spark, sf):
    return planted(spark, sf, step(), L.fit_forest, ["month"], "forest")


@query("planted_gbt", SUP + f" SELECT {FRAME.format('gbt')}, {STEP_SQL} AS yhat {LATER}", rounded="yhat")
def _(spark, sf):
    return planted(spark, sf, step(), partial(L.fit_gbt, trees=3), COLS, "gbt")


@query("planted_importance", SUP + """
SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature, importance FROM (
  SELECT 'month' AS feature, CASE WHEN corr(CAST(month <= 6 AS INTEGER), month) <> 0 THEN 1.0::DOUBLE END AS importance FROM supervised
  UNION ALL SELECT 'zero_share_12', 0.0 UNION ALL SELECT 'zero_share_12_missing', 0.0)""", rounded="importance")
def _(spark, sf):
    train, _ = split(matrix(spark, sf))
    train = train.withColumn("label", step()).withColumn("zero_share_12", F.when(F.col("period") > F.lit(dt.date(1996, 6, 1)), F.col("zero_share_12")))
    return L.importance(L.fit_gbt(train, KEYS, ["month", "zero_share_12"], trees=2), spark)


@query("planted_residual", SUP + f"""
SELECT {FRAME.format('residual')}, mean_12 AS base, mean_12 + {STEP_SQL} AS yhat {LATER}""", rounded="base yhat")
def _(spark, sf):
    train, test = split(matrix(spark, sf))
    train = train.withColumn("label", F.col("mean_12") + step())
    return L.residual(train, test, KEYS, COLS, "mean_12", partial(L.fit_gbt, trees=3))


@query("planted_hurdle", SUP + f"""
SELECT {FRAME.format('hurdle')}, CAST(month > 6 AS BOOLEAN) AS sold, 40.0::DOUBLE AS size {LATER}""", rounded="size")
def _(spark, sf):
    # Nothing is sold in the first half of a year; what is sold has one size.
    train, test = split(matrix(spark, sf))
    label = F.when(F.col("month") <= 6, 0.0).otherwise(40.0)
    half = (F.col("month") > 6).cast("double")
    out = L.hurdle(train.withColumns({"label": label, "half": half}), test.withColumn("half", half), KEYS, ["half", "month"])
    return out.select(*KEYS, "origin", "model", "h", "period", (F.col("p_sold") > 0.5).alias("sold"), "size")


@query("planted_count_glm", SUP + f"""
SELECT {FRAME.format('poisson')}, exp(1 + 0.125 * month) AS yhat {LATER}
UNION ALL SELECT {FRAME.format('tweedie')}, exp(1 + 0.125 * month) AS yhat {LATER}""", rounded="yhat", digits=3)
def _(spark, sf):
    # Demand whose logarithm is a line in the month: what a log link holds exactly.
    label = F.exp(1 + 0.125 * F.col("month"))
    one = lambda family: planted(spark, sf, label, partial(L.fit_glm, family=family), ["month"], family)
    return one("poisson").unionByName(one("tweedie"))


@query("planted_nn_bins", PANEL + """,
b AS (SELECT p_brand, c_nationkey, lag(period) OVER w AS origin, period, row_number() OVER w AS i FROM panel
      WINDOW w AS (PARTITION BY p_brand, c_nationkey ORDER BY period))
SELECT p_brand, c_nationkey, origin, 'nn_bins' AS model, 1 AS h, period, CASE WHEN c_nationkey % 2 = 0 THEN 10.0::DOUBLE ELSE 40.0::DOUBLE END AS yhat
FROM b WHERE i > 12 AND period >= DATE '2001-02-01'""", rounded="yhat", digits=0)
def _(spark, sf):
    # Series of two levels: the bin of the next demand is that of the window.
    level = F.when(F.col("c_nationkey") % 2 == 0, 10.0).otherwise(40.0)
    rows = durable(L.windows(qty_panel(spark, sf).withColumn("qty", level), KEYS, LOOK))
    train, test = split(rows)
    return N.predict_nn_bins(test, KEYS, LOOK, N.fit_nn_bins(train, KEYS, LOOK, n_bins=2))


def yearly(spark, sf):
    """The panel with demand that depends on the month alone."""
    qty = F.when(F.month("period") <= 6, 10.0).otherwise(40.0)
    return durable(qty_panel(spark, sf).withColumn("qty", qty))


YEARLY_SQL = PANEL + """
SELECT p_brand, c_nationkey, DATE '2001-01-01' AS origin, '{}' AS model, CAST(h AS INTEGER) AS h,
       CAST(DATE '2001-01-01' + to_months(CAST(h AS INTEGER)) AS DATE) AS period,
       CASE WHEN month(DATE '2001-01-01' + to_months(CAST(h AS INTEGER))) <= 6 THEN 10.0::DOUBLE ELSE 40.0::DOUBLE END AS yhat
FROM (SELECT DISTINCT p_brand, c_nationkey FROM panel), range(1, 7) AS r(h)"""


@query("planted_direct", YEARLY_SQL.format("direct"), rounded="yhat")
def _(spark, sf):
    return L.direct(yearly(spark, sf), KEYS, "month", ORIGIN, H, partial(L.fit_gbt, trees=2))


@query("planted_recursive", YEARLY_SQL.format("recursive"), rounded="yhat")
def _(spark, sf):
    return L.recursive(yearly(spark, sf), KEYS, "month", ORIGIN, H, partial(L.fit_gbt, trees=2))


FORWARD = N.Net(w1=np.array([[0.5]] + [[0.0]] * 11), b1=np.array([0.1]), w2=np.array([0.8]), b2=0.2, mean=0.0, sd=1.0)


@query("network_forward", PANEL + """,
b AS (SELECT p_brand, c_nationkey, lag(period) OVER w AS origin, period,
             list(qty) OVER (PARTITION BY p_brand, c_nationkey ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x
      FROM panel WINDOW w AS (PARTITION BY p_brand, c_nationkey ORDER BY period))
SELECT p_brand, c_nationkey, origin, 'nn' AS model, 1 AS h, period,
       greatest(exp(0.8 * tanh(0.5 * ln(1 + x[1]) + 0.1) + 0.2) - 1, 0) AS yhat
FROM b WHERE len(x) = 12""", rounded="yhat")
def _(spark, sf):
    # A network of given weights: one hidden unit that looks at the oldest value.
    return N.predict_nn(L.windows(qty_panel(spark, sf), KEYS, LOOK), KEYS, FORWARD)


@query("network_steps", PANEL + """,
t AS (SELECT p_brand, c_nationkey, list(qty ORDER BY period) AS x FROM panel
      WHERE period > DATE '2000-01-01' AND period <= DATE '2001-01-01' GROUP BY ALL)
SELECT p_brand, c_nationkey, DATE '2001-01-01' AS origin, 'nn' AS model, CAST(h AS INTEGER) AS h,
       CAST(DATE '2001-01-01' + to_months(CAST(h AS INTEGER)) AS DATE) AS period,
       greatest(exp(0.8 * tanh(0.5 * ln(1 + x[h]) + 0.1) + 0.2) - 1, 0) AS yhat
FROM t, range(1, 7) AS r(h)""", rounded="yhat")
def _(spark, sf):
    return N.forecast_nn(qty_panel(spark, sf), KEYS, "month", ORIGIN, H, LOOK, net=FORWARD)


FOLDS_2 = [dt.date(2000, 1, 1), dt.date(2000, 7, 1)]
BOUND = {"keys": KEYS, "freq": "month", "H": H}


def linear(reg):
    return lambda p, origin: L.direct(p, origin=origin, fit=partial(L.fit_linear, reg=reg), **BOUND)


@query("ml_backtest_steps", rounded="mae rmse wape smape bias rmsle", digits=3)
def _(spark, sf):
    """Trained, network and classical models by origin and step, in one table."""
    p = durable(qty_panel(spark, sf))
    trained = {
        "linear": linear(0.1),
        "gbt": lambda k, o: L.recursive(k, origin=o, fit=partial(L.fit_gbt, trees=5), **BOUND),
        "network": lambda k, o: N.forecast_nn(k, origin=o, L=LOOK, epochs=5, **BOUND),
    }
    fc = L.backtest_steps(p, FOLDS_2, trained).unionByName(FC.forecast(p, KEYS, "month", FOLDS_2, H, MODELS))
    return score(fc, KEYS, ["model", "origin", "h"], actual=p)


@query("planted_tune", PANEL + """,
y AS (SELECT p_brand, c_nationkey FROM panel GROUP BY ALL)
SELECT 'gbt' AS model, count(*) * 12 AS n, 0.0::DOUBLE AS rmse, CAST(1 AS INTEGER) AS rank FROM y""", rounded="rmse")
def _(spark, sf):
    # Demand that depends on the month alone: trees find it, a mean with heavy penalty does not.
    grid = {"flat": linear(1e6), "gbt": lambda k, o: L.direct(k, origin=o, fit=partial(L.fit_gbt, trees=2), **BOUND)}
    return L.tune(yearly(spark, sf), KEYS, FOLDS_2, grid).where("rank = 1")


# ---- clusters: four groups of series, far from each other ----------------------------------------

GROUPS_SQL = PANEL + """,
m AS (SELECT p_brand, c_nationkey, avg(qty) AS mean FROM panel GROUP BY ALL)
SELECT p_brand, c_nationkey, min(p_brand || '|' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) OVER (PARTITION BY c_nationkey % 4) AS cluster FROM m"""


def grouped(spark, sf, fit):
    """Clusters under the name of their first series."""
    means = qty_panel(spark, sf).groupBy(*KEYS).agg(F.avg("qty").alias("mean"))
    group = F.col("c_nationkey") % 4
    spots = means.select(*KEYS, (F.col("mean") / 1000 + (group % 2) * 100).alias("x"), (F.floor(group / 2) * 100.0).alias("y"))
    found = durable(fit(durable(spots)).select(*KEYS, "cluster"))
    name = F.concat_ws("|", "p_brand", F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    first = found.groupBy("cluster").agg(F.min(name).alias("first"))
    return found.join(first, "cluster").select(*KEYS, F.col("first").alias("cluster"))


@query("planted_kmeans", GROUPS_SQL)
def _(spark, sf):
    return grouped(spark, sf, lambda df: C.kmeans(df, KEYS, ["x", "y"], 4)[0])


@query("planted_bisecting", GROUPS_SQL)
def _(spark, sf):
    return grouped(spark, sf, lambda df: C.bisecting(df, KEYS, ["x", "y"], 4)[0])


@query("planted_gmm", GROUPS_SQL)
def _(spark, sf):
    return grouped(spark, sf, lambda df: C.gmm(df, KEYS, ["x", "y"], 4)[0])


@query("planted_density", PANEL + """,
m AS (SELECT p_brand, c_nationkey, avg(qty) AS mean FROM panel GROUP BY ALL)
SELECT p_brand, c_nationkey, 'core' AS kind,
       min('{"p_brand":"' || p_brand || '","c_nationkey":' || c_nationkey || '}') OVER (PARTITION BY c_nationkey % 3) AS cluster FROM m""")
def _(spark, sf):
    # Three dense spots far from each other.
    means = qty_panel(spark, sf).groupBy(*KEYS).agg(F.avg("qty").alias("mean"))
    spots = means.select(*KEYS, (F.col("mean") / 1e6 + F.col("c_nationkey") % 3 * 10).alias("x"), (F.col("c_nationkey") / 1000).alias("y"))
    return D.density_clusters(durable(spots), KEYS, ["x", "y"], 1.0, 5)


@query("planted_embed_clusters", """
SELECT vec_id, min(vec_id) OVER (PARTITION BY label % 4) AS cluster FROM embeddings""")
def _(spark, sf):
    # Vectors near one of four corners, by label; the given numbers are the noise.
    v = table(spark, sf, "embeddings")
    corner = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == F.col("label") % 4, 10.0).otherwise(0.0) + F.get("embedding", i).cast("double"))
    found = durable(E.embed_clusters(v.select("vec_id", corner.alias("emb")), ["vec_id"], 4)[0].select("vec_id", "cluster"))
    first = found.groupBy("cluster").agg(F.min("vec_id").alias("first"))
    return found.join(first, "cluster").select("vec_id", F.col("first").alias("cluster"))


@query("planted_choose_k", PANEL + """
SELECT CAST(1 AS INTEGER) AS rank, CAST(count(DISTINCT c_nationkey % 4) AS INTEGER) AS k FROM panel""")
def _(spark, sf):
    best = None

    def fit(df):
        nonlocal best
        best = C.choose_k(df, KEYS, ["x", "y"], [2, 3, 4, 5])
        return df.withColumn("cluster", F.lit(0))

    grouped(spark, sf, fit)
    return best.where("rank = 1").select("rank", "k")


# ---- embeddings -----------------------------------------------------------------------------------


@query("pca_keeps_length", PANEL + """,
b AS (SELECT p_brand, c_nationkey, lag(period) OVER w AS origin, period,
             list(qty) OVER (PARTITION BY p_brand, c_nationkey ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x
      FROM panel WINDOW w AS (PARTITION BY p_brand, c_nationkey ORDER BY period))
SELECT p_brand, c_nationkey, period, CASE WHEN list_stddev_pop(x) > 1e-9 THEN 12.0::DOUBLE ELSE 0.0::DOUBLE END AS length
FROM b WHERE len(x) = 12""", rounded="length", digits=4)
def _(spark, sf):
    # All twelve components of a window together are a rotation.
    w = durable(E.scaled_windows(L.windows(qty_panel(spark, sf), KEYS, LOOK), LOOK))
    pcs = E.embed_pca(w.select(*KEYS, "period", "emb"), KEYS, LOOK)[0]
    return pcs.select(*KEYS, "period", sum(F.col(f"pc_{i + 1}") * F.col(f"pc_{i + 1}") for i in range(LOOK)).alias("length"))


@query("word2vec_per_word", SAX_SQL + """, words AS (SELECT p_brand, c_nationkey, string_agg(letter, '' ORDER BY segment) AS word FROM l GROUP BY ALL)
SELECT word, count(*) AS series, CAST(1 AS BIGINT) AS vectors FROM words GROUP BY word""")
def _(spark, sf):
    # Series with one word have one vector.
    emb, _ = E.embed_word2vec(durable(E.sax(qty_panel(spark, sf), KEYS, 16, 4)), KEYS, 4)
    near = F.transform("emb", lambda x: F.round(x, 9))
    return emb.groupBy("word").agg(F.count("*").alias("series"), F.count_distinct(near).alias("vectors"))


@query("similar_lsh_recall", """
WITH m AS (SELECT label, i, CAST(avg(embedding[i]) AS FLOAT) AS x FROM embeddings, range(1, 65) AS r(i) GROUP BY ALL),
q AS (SELECT label, CAST(list(x ORDER BY i) AS DOUBLE[]) AS e FROM m GROUP BY label)
SELECT CAST(q.label AS BIGINT) AS query_id, count(*) AS within, true AS found FROM q
JOIN embeddings v ON list_distance(q.e, CAST(v.embedding AS DOUBLE[])) <= 0.95 GROUP BY ALL""")
def _(spark, sf):
    # found: at least nine tenths of the vectors within the distance, and none that is not.
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    q = durable(label_means(spark, sf).select(F.col("label").cast("bigint").alias("id"), F.col("embedding").alias("emb")))
    got = E.lsh_pairs(v, q, d=0.95, bucket=1.0, tables=12).groupBy("query_id").agg(F.count("*").alias("n"))
    # the exact side: each vector meets all queries, which one row holds
    every = q.agg(F.collect_list(F.struct("id", "emb"))).scalar()
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d))
    near = v.select("emb", F.explode(every).alias("q")).where(apart(F.col("emb"), F.col("q.emb")) <= 0.95)
    exact = near.groupBy(F.col("q.id").alias("query_id")).agg(F.count("*").alias("within"))
    return exact.join(got, "query_id", "left").select(
        "query_id", "within", F.coalesce((F.col("n") >= 0.9 * F.col("within")) & (F.col("n") <= F.col("within")), F.lit(False)).alias("found")
    )


# ---- hybrid over other segments and other models ----------------------------------------------------

FRAMES_SQL = ANALOG_SQL.replace("{match}", "q.p_brand = k.p_brand AND q.c_nationkey = k.c_nationkey").replace("{tie}", "kp DESC") + (
    ANALOG_TAIL.replace("{name}", "analog_own")
)


def _frames_sql() -> str:
    """Routed by XYZ class at the origin over a classical and an analog frame."""
    head, tail = FRAMES_SQL.rsplit("\nSELECT p_brand, c_nationkey, DATE '2001-01-01' AS origin", 1)
    analog = "SELECT p_brand, c_nationkey, DATE '2001-01-01' AS origin" + tail
    known = VARIATION_SQL.replace("FROM panel", "FROM known")
    return head + f""",
analog AS ({analog}),
known AS (SELECT * FROM panel WHERE period <= DATE '2001-01-01'), {known},
{fc_sql([ORIGIN])},
picks AS (SELECT p_brand, c_nationkey, xyz AS segment, CASE xyz WHEN 'X' THEN 'ses' ELSE 'analog_own' END AS pick FROM xyz),
either AS (SELECT p_brand, c_nationkey, h, model, yhat FROM fc UNION ALL SELECT p_brand, c_nationkey, h, model, yhat FROM analog)
SELECT p_brand, c_nationkey, segment, DATE '2001-01-01' AS origin, CAST(DATE '2001-01-01' + to_months(CAST(h AS INTEGER)) AS DATE) AS period,
       CAST(h AS INTEGER) AS h, pick AS model, yhat, 'routed' AS source
FROM picks JOIN either ON picks.p_brand = either.p_brand AND picks.c_nationkey = either.c_nationkey AND pick = model"""


@query("hybrid_run_models", _frames_sql().replace("SELECT p_brand, c_nationkey, segment, DATE", "SELECT picks.p_brand, picks.c_nationkey, segment, DATE"), rounded="yhat")
def _(spark, sf):
    p = durable(qty_panel(spark, sf))
    known = p.where(F.col("period") <= as_col(ORIGIN))
    xyz = R.classify_xyz(T.variation(known, KEYS)).select(*KEYS, F.col("xyz").alias("segment"))
    analog = E.analog_own(p, KEYS, "month", ORIGIN, H, LOOK, 3)
    cfg = Y.HybridConfig(
        keys=KEYS, freq="month", origin=ORIGIN, horizon=H, origins=[dt.date(2000, 1, 1)], models=MODELS,
        routing={"X": "ses"}, other="analog_own", frames=(analog,), segments=xyz,
    )
    return Y.hybrid(p, cfg)


@query("hybrid_run_trained", rounded="yhat")
def _(spark, sf):
    """Classes from clusters, and linear, tree, analog and classical forecasts that compete by backtest."""
    p = durable(qty_panel(spark, sf))
    past = dt.date(2000, 7, 1)
    wide = durable(T.wide_profile(p.where(F.col("period") <= as_col(past)), KEYS))
    cols = ["adi", "cv2", "zero_share"]
    segments, _ = C.kmeans(C.cluster_input(wide, cols, KEYS), KEYS, cols, 3)
    frames = []
    for origin in (past, ORIGIN):
        frames.append(L.direct(p, KEYS, "month", origin, H, partial(L.fit_linear, reg=0.1), name="linear"))
        frames.append(L.recursive(p, KEYS, "month", origin, H, partial(L.fit_gbt, trees=5), name="gbt"))
        frames.append(E.analog_own(p, KEYS, "month", origin, H, LOOK, 3))
    cfg = Y.HybridConfig(
        keys=KEYS, freq="month", origin=ORIGIN, horizon=H, origins=[past], models={m: MODELS[m] for m in ("ses", "croston", "snaive")},
        routing={"0": "best", "1": "combined"}, other="best", frames=tuple(frames),
        segments=segments.select(*KEYS, F.col("cluster").cast("string").alias("segment")),
    )
    return Y.hybrid(p, cfg)
