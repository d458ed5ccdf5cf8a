"""Machine-learning forecasts: one global model over all series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import as_col, shift_period
from . import boost
from .clusters import steady_order
from .features import SeriesRows
from .panel import by_series
from .score import score

Fit = Callable[[DataFrame, list[str], list[str]], object]


FILLED, MISSING = "filled_", "_missing"


def _pipeline(sup: DataFrame, keys: list[str], cols: list[str], *stages, label: str = "label"):
    """Fit fill + assembler + stages. A missing feature counts as 0, and features that lack a value in
    some training row have a flag beside them, so every row can be learned from and scored."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    train = sup.where(F.col(label).isNotNull()).select(*keys, "period", *cols, label)
    absent = lambda c: f"(`{c}` IS NULL OR isnan(CAST(`{c}` AS DOUBLE)))"
    lacks = train.agg(*[F.coalesce(F.max(F.expr(absent(c))), F.lit(False)).alias(c) for c in cols]).first()
    flagged = [c for c in cols if lacks[c]]
    fill = [f"CASE WHEN {absent(c)} THEN 0.0D ELSE CAST(`{c}` AS DOUBLE) END AS `{FILLED}{c}`" for c in cols]
    flags = [f"CAST({absent(c)} AS DOUBLE) AS `{c}{MISSING}`" for c in flagged]
    inputs = [f"{FILLED}{c}" for c in cols] + [f"{c}{MISSING}" for c in flagged]
    filled = SQLTransformer(statement=f"SELECT *, {', '.join(fill + flags)} FROM __THIS__")
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    return Pipeline(stages=[filled, assembler, *stages]).fit(steady_order(train, keys))


def feature_names(model) -> list[str]:
    """Names of the features of a fitted model, flags of missing values included."""
    if isinstance(model, boost.Trees):
        return model.names
    return [c.removeprefix(FILLED) for c in model.stages[1].getInputCols()]


def fit_linear(sup: DataFrame, keys: list[str], cols: list[str], reg: float = 0.0, en: float = 0.0):
    """Ridge (en = 0) to lasso (en = 1) regression."""
    from pyspark.ml.regression import LinearRegression

    return _pipeline(sup, keys, cols, LinearRegression(labelCol="label", predictionCol="yhat", regParam=reg, elasticNetParam=en))


def fit_forest(sup: DataFrame, keys: list[str], cols: list[str], trees: int = 20, depth: int = 5, seed: int = 1):
    from pyspark.ml.regression import RandomForestRegressor

    return _pipeline(sup, keys, cols, RandomForestRegressor(labelCol="label", predictionCol="yhat", numTrees=trees, maxDepth=depth, seed=seed))


def fit_gbt(sup: DataFrame | SeriesRows, keys: list[str], cols: list[str], trees: int = 20, depth: int = 4, seed: int = 1):
    """Boosted trees; rows held as series may outgrow the executors' memory and are learned from in packed blocks."""
    if isinstance(sup, SeriesRows):
        return boost.fit(sup, cols, trees, depth, seed, MISSING)
    from pyspark.ml.regression import GBTRegressor

    return _pipeline(sup, keys, cols, GBTRegressor(labelCol="label", predictionCol="yhat", maxIter=trees, maxDepth=depth, seed=seed))


def fit_glm(sup: DataFrame, keys: list[str], cols: list[str], family: str = "poisson", power: float = 1.5):
    """Poisson or Tweedie regression with log link on standardised features."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import GeneralizedLinearRegression

    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    glm = GeneralizedLinearRegression(labelCol="label", featuresCol="scaled", predictionCol="yhat", family=family, regParam=1e-6, maxIter=25)
    if family == "tweedie":
        glm = glm.setVariancePower(power).setLinkPower(0.0)
    else:
        glm = glm.setLink("log")
    return _pipeline(sup, keys, cols, scaler, glm)


def predict(model, sup: DataFrame, keys: list[str], name: str, floor: float | None = 0.0) -> DataFrame:
    """Forecast frame from a fitted model; demand below ``floor`` is raised to it (None: left)."""
    yhat = F.col("yhat") if floor is None else F.greatest(F.col("yhat"), F.lit(floor))
    return model.transform(sup).select(
        *keys, "origin", F.lit(name).alias("model"), "h", "period", yhat.alias("yhat")
    )


def importance(model, spark) -> DataFrame:
    """Importance of each feature of a fitted tree model, ranked. One row per feature."""
    values = model.importances() if isinstance(model, boost.Trees) else model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(feature_names(model), map(float, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(rows)], "rank int, feature string, importance double")


# ---- several steps ahead ----------------------------------------------------------------------


def lookback_features(look: Column, L: int, target: Column) -> dict[str, Column]:
    """Features of a lookback array (oldest first): the same for training rows and for forecasts."""
    total = lambda n: F.aggregate(F.slice(look, -n, n), F.lit(0.0), lambda s, x: s + x)
    zeros = F.size(F.filter(look, lambda x: x == 0)).cast("double")
    out = {f"lag_{k}": F.element_at(look, -k) for k in range(1, L + 1)}
    out |= {f"mean_{n}": total(n) / n for n in (3, 6, L) if n <= L}
    return out | {"zero_share": zeros / L, "month": F.month(target)}


def lookback_names(L: int) -> list[str]:
    return [f"lag_{k}" for k in range(1, L + 1)] + [f"mean_{n}" for n in dict.fromkeys((3, 6, L)) if n <= L] + ["zero_share", "month"]


def windows(panel: DataFrame, keys: list[str], L: int, h: int = 1) -> DataFrame:
    """Lookback array of the L rows up to ``origin`` and the target h steps later; short heads dropped."""
    w = by_series(keys)
    df = panel.select(
        *keys,
        F.lag("period").over(w).alias("origin"),
        F.lit(h).alias("h"),
        F.lead("period", h - 1).over(w).alias("period"),
        F.collect_list("qty").over(w.rowsBetween(-L, -1)).alias("lookback"),
        F.lead("qty", h - 1).over(w).alias("target"),
    )
    return df.where((F.size("lookback") == L) & F.col("target").isNotNull())


def tails(panel: DataFrame, keys: list[str], freq: str, origin, L: int) -> DataFrame:
    """The last L values of each series up to ``origin``; only those rows are read.

    A shorter series had no demand before, so zeros stand in front.
    """
    at = as_col(origin)
    recent = panel.where((F.col("period") <= at) & (F.col("period") > shift_period(at, -L, freq)))
    ordered = F.sort_array(F.collect_list(F.struct("period", F.col("qty").alias("y"))))
    out = recent.groupBy(*keys).agg(F.transform(ordered, lambda p: p["y"]).alias("_y"))
    lookback = F.concat(F.array_repeat(F.lit(0.0), L - F.size("_y")), "_y")
    return out.select(*keys, lookback.alias("lookback"), at.alias("origin"))


def _training(panel: DataFrame, keys: list[str], origin, L: int, h: int) -> DataFrame:
    """Windows whose target is known at ``origin``, with their features."""
    rows = windows(panel.where(F.col("period") <= as_col(origin)), keys, L, h)
    feats = lookback_features(F.col("lookback"), L, F.col("period"))
    return rows.select(*keys, "period", F.col("target").alias("label"), *[c.alias(n) for n, c in feats.items()])


def direct(panel: DataFrame, keys: list[str], freq: str, origin, H: int, fit: Fit, L: int = 12, name: str = "direct") -> DataFrame:
    """One model per horizon."""
    names = lookback_names(L)
    tail = tails(panel, keys, freq, origin, L)
    out = None
    for h in range(1, H + 1):
        model = fit(_training(panel, keys, origin, L, h), keys, names)
        rows = tail.withColumns({"h": F.lit(h), "period": shift_period("origin", h, freq)})
        rows = rows.withColumns(lookback_features(F.col("lookback"), L, F.col("period")))
        fc = predict(model, rows, keys, name)
        out = fc if out is None else out.unionByName(fc)
    return out


def recursive(panel: DataFrame, keys: list[str], freq: str, origin, H: int, fit: Fit, L: int = 12, name: str = "recursive") -> DataFrame:
    """One one-step model fed with its own forecasts.

    The state of a series is the array of its last L values. Each step scores it and shifts the
    forecast in, so all H steps are one narrow job: no shuffle and no stored round in between.
    """
    model = fit(_training(panel, keys, origin, L, 1), keys, lookback_names(L))
    state = tails(panel, keys, freq, origin, L)
    steps = []
    for h in range(1, H + 1):
        feats = lookback_features(F.col("lookback"), L, shift_period("origin", h, freq))
        scored = model.transform(state.withColumns(feats))
        value = F.greatest(F.col("yhat"), F.lit(0.0))
        steps.append(f"_f{h}")
        state = scored.select(*keys, "origin", *steps[:-1], value.alias(f"_f{h}"), "lookback")
        state = state.withColumn("lookback", F.concat(F.slice("lookback", 2, L - 1), F.array(f"_f{h}")))
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_f{h}").alias("yhat")) for h in range(1, H + 1)])
    return state.select(*keys, "origin", F.lit(name).alias("model"), F.inline(pairs)).select(
        *keys, "origin", "model", "h", shift_period("origin", F.col("h"), freq).alias("period"), "yhat"
    )


# ---- hybrids of models ------------------------------------------------------------------------


def hurdle(train: DataFrame, rows: DataFrame, keys: list[str], cols: list[str], seed: int = 1, name: str = "hurdle") -> DataFrame:
    """P(demand > 0) × E(size | demand > 0): a logistic model and boosted trees on nonzero rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    occurs = LogisticRegression(labelCol="sold", probabilityCol="_p", predictionCol="_sold", rawPredictionCol="_raw", regParam=1e-3)
    sold = train.withColumn("sold", (F.col("label") > 0).cast("double"))
    chance = _pipeline(sold, keys, cols, occurs, label="sold")
    size = fit_gbt(train.where(F.col("label") > 0), keys, cols, seed=seed)
    # both models name their features alike
    out = size.transform(chance.transform(rows).select(*rows.columns, "_p"))
    p = vector_to_array("_p")[1]
    return out.select(
        *keys, "origin", F.lit(name).alias("model"), "h", "period",
        p.alias("p_sold"), F.greatest(F.col("yhat"), F.lit(0.0)).alias("size"),
        (p * F.greatest(F.col("yhat"), F.lit(0.0))).alias("yhat"),
    )


def residual(
    train: DataFrame, rows: DataFrame, keys: list[str], cols: list[str], base: str, fit: Fit, name: str = "residual"
) -> DataFrame:
    """Baseline forecast (column ``base``) plus a model of what it misses; without a baseline that is 0."""
    missed = train.where(F.col(base).isNotNull()).withColumn("label", F.col("label") - F.col(base))
    model = fit(missed, keys, cols)
    out = model.transform(rows)
    return out.select(
        *keys, "origin", F.lit(name).alias("model"), "h", "period",
        F.col(base).alias("base"), F.greatest(F.coalesce(base, F.lit(0.0)) + F.col("yhat"), F.lit(0.0)).alias("yhat"),
    )


def backtest_model(
    sup: DataFrame, keys: list[str], cols: list[str], cuts: list, step_end, fit: Fit, name: str
) -> DataFrame:
    """Forecasts of a trained model from several cutoffs: trained before each, applied up to the next."""
    out = None
    for cut, end in zip(cuts, [*cuts[1:], step_end]):
        model = fit(sup.where(F.col("period") < as_col(cut)), keys, cols)
        rows = sup.where((F.col("period") >= as_col(cut)) & (F.col("period") < as_col(end)))
        fc = predict(model, rows, keys, name).withColumn("cut", as_col(cut))
        out = fc if out is None else out.unionByName(fc)
    return out


Forecasts = Callable[[DataFrame, object], DataFrame]


def backtest_steps(panel: DataFrame, origins: list, models: dict[str, Forecasts]) -> DataFrame:
    """Forecast frames of trained models from several origins, each model trained anew on what is known there.

    A model is a function of the panel up to the origin and the origin (``direct``, ``recursive``, a
    network or an analog with its other arguments bound), so all of them can be scored beside classical
    models, by origin and step.
    """
    out = None
    for origin in origins:
        known = panel.where(F.col("period") <= as_col(origin))
        for name, make in models.items():
            fc = make(known, origin).withColumn("model", F.lit(name))
            out = fc if out is None else out.unionByName(fc)
    return out


def tune(panel: DataFrame, keys: list[str], origins: list, grid: dict[str, Forecasts], metric: str = "rmse") -> DataFrame:
    """Candidates scored on time-ordered folds, best first (rank 1). One row per candidate."""
    s = score(backtest_steps(panel, origins, grid), keys, ["model"], actual=panel).select("model", "n", metric)
    best_first = W.orderBy(F.round(metric, 9).asc_nulls_last(), "model")  # one row per candidate
    return s.withColumn("rank", F.row_number().over(best_first))
