"""Demand forecasting.

A series is folded as an array of its days: at most as long as the calendar, whatever the volume of sales, since
sales are added up per day first. Folds run in the JVM (`aggregate`), one row per series, so series spread freely.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalar import ratio
from marketlens.operators.ordered import exact_quantiles, materialise
from marketlens.operators.windows import series

ALPHAS = (0.1, 0.2, 0.3, 0.5, 0.7)
SMOOTHING = (0.1, 0.3, 0.5)
ETS_SETS = ((0.1, 0.05, 0.1), (0.2, 0.1, 0.2), (0.4, 0.1, 0.3))
DAMPING = 0.98


def series_arrays(train: DataFrame, key: str = "unique_id") -> DataFrame:
    """One row per series with its values in day order (`ys`)."""
    pairs = F.sort_array(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y"))))
    return train.groupBy(key).agg(F.transform(pairs, lambda p: p["y"]).alias("ys"))


def tail_mean(ys: Column, n: int) -> Column:
    last = F.slice(ys, -F.least(F.lit(n), F.size(ys)), F.lit(n))
    return F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last)


def naive_predictions(train: DataFrame, test: DataFrame, key: str = "unique_id") -> DataFrame:
    """Last value, last week repeated, mean of the last 28 days; the overall mean for a series without history.

    `test`: key, ds, y. Adds h (1 for the first test day) and one column per model, never negative.
    """
    overall = train.agg(F.avg("y")).scalar()
    origin = train.agg(F.max("ds")).scalar()
    d = test.join(series_arrays(train, key), key, "left").withColumn("h", F.datediff("ds", origin))
    ys, known = F.col("ys"), F.col("ys").isNotNull()
    week = F.slice(ys, -F.least(F.lit(7), F.size(ys)), F.lit(7))
    seasonal = F.get(week, (F.col("h") - 1) % F.size(week))
    clip = lambda c: F.greatest(F.when(known, c).otherwise(overall), F.lit(0.0))
    return d.withColumns({"naive": clip(F.element_at(ys, -1)), "seasonal_naive7": clip(seasonal), "moving_average28": clip(tail_mean(ys, 28))}).drop("ys")


def backtest_windows(spark, last_day, backs: Sequence[int], length: int = 30) -> DataFrame:
    """Test windows counted back from the last day: window, start, end. Training is strictly before `start`."""
    import datetime as dt
    rows = []
    for i, back in enumerate(backs, 1):
        start = last_day - dt.timedelta(days=back - 1)
        rows.append((i, start, min(start + dt.timedelta(days=length - 1), last_day)))
    return spark.createDataFrame(rows, "window int, start date, end date")


def backtest_naive(days: DataFrame, windows: DataFrame, key: str = "unique_id") -> DataFrame:
    """The naive family on every window in one plan.

    The starts of the windows cut the calendar into gaps. Of each gap a series keeps its last 28 rows, one window function for all gaps; only these meet the
    windows that start later, which keep the last 28 of them, however long ago: a series may have gaps or have ended. `windows`: one row per window, a handful.
    """
    starts = sorted({r["start"] for r in windows.select("start").collect()})
    passed = sum(((F.col("ds") >= F.lit(s)).cast("int") for s in starts), F.lit(0))
    before = windows.withColumn("_before", F.array_position(F.array(*[F.lit(s) for s in starts]), F.col("start")).cast("int"))
    w = F.broadcast(before.withColumn("_gap", F.explode(F.sequence(F.lit(0), F.col("_before") - 1))).select("window", "_gap"))
    gaps = days.select(key, "ds", "y").withColumn("_gap", passed).filter(F.col("_gap") < len(starts))
    newest = lambda by: F.row_number().over(Window.partitionBy(key, by).orderBy(F.desc("ds")))
    recent = (gaps.withColumn("_r", newest("_gap")).filter(F.col("_r") <= 28).join(w, "_gap")
              .withColumn("_r", newest("window")).filter(F.col("_r") <= 28))
    pairs = F.sort_array(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y"))))
    arrays = recent.groupBy(key, "window").agg(F.transform(pairs, lambda p: p["y"]).alias("ys"))
    totals = gaps.groupBy("_gap").agg(F.sum("y").alias("_t"), F.count("y").alias("_n"))
    overall = totals.join(w, "_gap").groupBy("window").agg((F.sum("_t") / F.sum("_n")).alias("_g"))
    test = (days.select(key, "ds", "y").join(F.broadcast(windows), F.col("ds").between(F.col("start"), F.col("end")))
            .withColumn("h", F.datediff("ds", "start") + 1).drop("start", "end"))
    d = test.join(arrays, [key, "window"], "left").join(F.broadcast(overall), "window", "left")
    ys, known = F.col("ys"), F.col("ys").isNotNull()
    week = F.slice(ys, -F.least(F.lit(7), F.size(ys)), F.lit(7))
    clip = lambda c: F.greatest(F.when(known, c).otherwise(F.col("_g")), F.lit(0.0))
    return d.withColumns({"naive": clip(F.element_at(ys, -1)), "seasonal_naive7": clip(F.get(week, (F.col("h") - 1) % F.size(week))),
                          "moving_average28": clip(tail_mean(ys, 28))}).drop("ys", "_g")


def long_predictions(wide: DataFrame, models: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return wide.unpivot([F.col(k) for k in keys], [F.col(m) for m in models], "model", "pred")


def _indexed(ys: Column) -> Column:
    return F.zip_with(F.sequence(F.lit(0), F.size(ys) - 1), ys, lambda i, y: F.struct(i.alias("i"), y.alias("y")))


def sale_arrays(train: DataFrame, key: str = "unique_id", span: tuple | None = None, keys: DataFrame | None = None) -> DataFrame:
    """One row per series: its days with sales as `hits` (i: number of the day from 0, y) and its number of days `n`.

    Without `span` the rows of a series are its days, zeros included. With `span` (first and last day) every series of `keys` has each day of the span and `train`
    needs only days with sales: days without any never become rows, so the shuffle grows with the sales and not with products times days. Several rows of a day are
    added up; values below zero count as none.
    """
    if span is None:
        hits = F.filter(_indexed(F.col("ys")), lambda e: e["y"] > 0)
        return series_arrays(train, key).select(key, hits.alias("hits"), F.size("ys").alias("n"))
    lo, hi = (F.lit(d).cast("date") for d in span)
    sold = (train.filter(F.col("ds").between(lo, hi)).groupBy(key, F.datediff("ds", lo).alias("i")).agg(F.sum(F.col("y").cast("double")).alias("y")).filter("y > 0")
            .groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "y"))).alias("hits")))
    none = F.array().cast("array<struct<i:int,y:double>>")
    return keys.select(key).distinct().join(sold, key, "left").select(key, F.coalesce("hits", none).alias("hits"), (F.datediff(hi, lo) + 1).alias("n"))


def croston_fold(hits: Column, n: Column, alpha: float) -> Column:
    """(mean absolute in-sample error, level) of Croston smoothing with one alpha.

    Only days with sales change the state; the days between two of them share one fitted value, so their error is a product.
    """
    a = F.lit(float(alpha))
    rate = lambda s: F.coalesce(s["q"] / F.greatest(s["p"], F.lit(1.0)), F.lit(0.0))
    start = F.struct(F.lit(None).cast("double").alias("q"), F.lit(None).cast("double").alias("p"), F.lit(-1).alias("last"), F.lit(0.0).alias("err"))

    def step(s, e):
        first = s["q"].isNull()
        q = F.when(first, e["y"]).otherwise(a * e["y"] + (1 - a) * s["q"])
        p = F.when(first, (e["i"] + 1).cast("double")).otherwise(a * (e["i"] - s["last"]) + (1 - a) * s["p"])
        err = s["err"] + (e["i"] - s["last"] - 1) * rate(s) + F.abs(rate(s) - e["y"])
        return F.struct(q.alias("q"), p.alias("p"), e["i"].alias("last"), err.alias("err"))

    return F.aggregate(hits, start, step, lambda s: F.struct(((s["err"] + (n - 1 - s["last"]) * rate(s)) / n).alias("loss"), rate(s).alias("level")))


def best_of(candidates: Sequence[Column]) -> Column:
    """Candidate with the smallest loss, compared to nine decimals; the earliest on ties."""
    tagged = [F.struct(F.round(c["loss"], 9).alias("loss"), F.lit(i).alias("i"), c["level"].alias("level")) for i, c in enumerate(candidates)]
    return F.array_min(F.array(*tagged))


def croston_level(train: DataFrame, key: str = "unique_id", span: tuple | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Flat Croston level per series, alpha chosen on the in-sample error; 0 without sales. Arguments as in `sale_arrays`."""
    arrays = sale_arrays(train, key, span, keys)
    return (arrays.withColumn("_b", best_of([croston_fold(F.col("hits"), F.col("n"), a) for a in ALPHAS]))
            .select(key, F.greatest(F.col("_b.level"), F.lit(0.0)).alias("croston"), F.element_at(F.array(*[F.lit(a) for a in ALPHAS]), F.col("_b.i") + 1).alias("alpha"), F.col("_b.loss").alias("loss")))


def tsb_fold(hits: Column, n: Column, a: float, b: float) -> Column:
    """(mean absolute in-sample error, level) of smoothed size times smoothed probability.

    The probability decays geometrically over days without sales, so their fitted values add up in closed form.
    """
    start = F.struct(F.coalesce(F.get(hits, F.lit(0))["y"], F.lit(0.0)).alias("q"), F.lit(1.0).alias("p"), F.lit(-1).alias("last"), F.lit(0.0).alias("err"))
    fade = lambda k: F.pow(F.lit(1 - b), k)
    quiet = lambda s, k: s["q"] * s["p"] * (1 - fade(k)) / F.lit(b)

    def step(s, e):
        k = e["i"] - s["last"] - 1
        p = s["p"] * fade(k)
        err = s["err"] + quiet(s, k) + F.abs(s["q"] * p - e["y"])
        return F.struct((F.lit(a) * e["y"] + (1 - F.lit(a)) * s["q"]).alias("q"), (F.lit(b) + (1 - F.lit(b)) * p).alias("p"), e["i"].alias("last"), err.alias("err"))

    rest = lambda s: n - 1 - s["last"]
    return F.aggregate(hits, start, step, lambda s: F.struct(((s["err"] + quiet(s, rest(s))) / n).alias("loss"), (s["q"] * s["p"] * fade(rest(s))).alias("level")))


def tsb_level(train: DataFrame, key: str = "unique_id", span: tuple | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Flat level: smoothed size times smoothed probability, 3 x 3 grid on the in-sample error; 0 without sales. Arguments as in `sale_arrays`."""
    arrays = sale_arrays(train, key, span, keys)
    return (arrays.withColumn("_b", best_of([tsb_fold(F.col("hits"), F.col("n"), a, b) for a in SMOOTHING for b in SMOOTHING]))
            .select(key, F.greatest(F.col("_b.level"), F.lit(0.0)).alias("tsb"), F.col("_b.loss").alias("loss")))


def ets_state(ys: Column, a: float, b: float, c: float) -> Column:
    """Damped additive trend with weekly additive season. Start: first-week mean, week-over-week slope, first-week deviations."""
    mean = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / F.size(arr)
    w1, w2 = F.slice(ys, 1, 7), F.slice(ys, 8, 7)
    start = F.struct(mean(w1).alias("l"), ((mean(w2) - mean(w1)) / 7).alias("t"), F.transform(w1, lambda x: x - mean(w1)).alias("s"))

    def step(s, y):
        old = F.element_at(s["s"], 1)
        base = s["l"] + F.lit(DAMPING) * s["t"]
        level = F.lit(a) * (y - old) + (1 - F.lit(a)) * base
        trend = F.lit(b) * (level - s["l"]) + (1 - F.lit(b)) * F.lit(DAMPING) * s["t"]
        season = F.lit(c) * (y - level) + (1 - F.lit(c)) * old
        return F.struct(level.alias("l"), trend.alias("t"), F.concat(F.slice(s["s"], 2, 6), F.array(season)).alias("s"))
    return F.aggregate(ys, start, step)


def ets_path(state: Column, steps: Column) -> Column:
    """Forecasts for steps 1..n of a smoothing state."""
    damp = lambda h: F.lit(DAMPING) * (1 - F.pow(F.lit(DAMPING), h)) / (1 - F.lit(DAMPING))
    return F.transform(F.sequence(F.lit(1), steps), lambda h: state["l"] + damp(h) * state["t"] + F.get(state["s"], (h - 1) % 7))


def ets_forecast(train: DataFrame, horizon: int = 30, key: str = "unique_id") -> DataFrame:
    """Weekly damped smoothing, parameters chosen on the last 28 days; short series fall back to their mean."""
    arrays = series_arrays(train, key).withColumn("_n", F.size("ys")).withColumn("_split", F.greatest(F.lit(28), F.col("_n") - 28))
    enough = F.col("_n") >= 14
    ys, head, rest = F.col("ys"), F.slice("ys", F.lit(1), F.col("_split")), F.slice("ys", F.col("_split") + 1, F.greatest(F.col("_n") - F.col("_split"), F.lit(1)))
    held = F.col("_n") > F.col("_split")
    losses = {}
    for i, (a, b, c) in enumerate(ETS_SETS):
        path = ets_path(F.col(f"_h{i}"), F.size(F.col("_rest")))
        err = F.zip_with(path, F.col("_rest"), lambda p, y: F.abs(p - y))
        losses[f"_loss{i}"] = F.when(F.col("_held"), F.aggregate(err, F.lit(0.0), lambda s, x: s + x) / F.size("_rest")).otherwise(F.lit(0.0))
    d = arrays.withColumn("_held", held & enough).withColumn("_rest", rest)
    d = d.withColumns({f"_h{i}": F.when(enough, ets_state(head, *p)) for i, p in enumerate(ETS_SETS)}).withColumns(losses)
    pick = F.array_min(F.array(*[F.struct(F.round(f"_loss{i}", 9).alias("loss"), F.lit(i).alias("i")) for i in range(3)])).getField("i")
    d = d.withColumn("_i", pick).withColumns({f"_f{i}": F.when(enough & (F.col("_i") == i), ets_state(ys, *p)) for i, p in enumerate(ETS_SETS)})
    d = d.withColumn("_state", F.coalesce("_f0", "_f1", "_f2"))
    path = F.when(enough, ets_path(F.col("_state"), F.lit(horizon))).otherwise(F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: tail_mean(F.col("ys"), 10**6)))
    return (d.select(key, F.col("_i").alias("params"), F.posexplode(path).alias("h", "ets"))
            .select(key, "params", (F.col("h") + 1).alias("h"), F.greatest("ets", F.lit(0.0)).alias("ets")))


RECURSIVE = ("y_lag1", "y_lag7", "y_lag14", "y_lag28", "y_ma28")


def fit_linear(features: DataFrame, columns: Sequence[str] = RECURSIVE, label: str = "y") -> tuple[list[float], float]:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    ready = VectorAssembler(inputCols=list(columns), outputCol="features").transform(features.dropna(subset=list(columns)).select(F.col(label).cast("double").alias(label), *columns))
    model = LinearRegression(labelCol=label, featuresCol="features", regParam=0.01).fit(ready)
    return [float(x) for x in model.coefficients], float(model.intercept)


def recursive_forecast(train: DataFrame, horizon: int, coefficients: Sequence[float], intercept: float, key: str = "unique_id") -> DataFrame:
    """Day-by-day forecast of a linear lag model: every lag after the origin comes from earlier predictions.

    The last 28 days travel as an array through the fold; nothing is read again between two days.
    """
    overall = train.agg(F.avg(F.col("y").cast("double"))).scalar()
    arrays = series_arrays(train, key).withColumn("_g", overall)
    c = [F.lit(x) for x in coefficients]

    def step(h, _i):
        n = F.size(h)
        mean = F.aggregate(h, F.lit(0.0), lambda a, x: a + x) / n
        lag = lambda k: F.coalesce(F.get(h, n - k), mean)
        y = F.greatest(F.lit(intercept) + c[0] * lag(1) + c[1] * lag(7) + c[2] * lag(14) + c[3] * lag(28) + c[4] * tail_mean(h, 28), F.lit(0.0))
        return F.concat(h, F.array(y))
    tail = F.slice("ys", -F.least(F.lit(28), F.size("ys")), F.lit(28))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), tail, step)
    return (arrays.withColumn("_p", path).select(key, F.posexplode(F.slice("_p", -horizon, horizon)).alias("h", "pred"))
            .select(key, (F.col("h") + 1).alias("h"), "pred"))


def assemble(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    filled = df.select(*[c for c in df.columns if c not in columns], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(filled.withColumn(label, F.col(label).cast("double")))


def direct_frame(features: DataFrame, columns: Sequence[str], horizons: Sequence[int], key: str = "unique_id") -> DataFrame:
    """Each day as a cutoff: its features, and per horizon the target (`y_<h>`) and the planned discount (`plan_<h>`) of the day so far ahead.

    One window serves all horizons, and the result is written, so the models don't shuffle the series again. Series have a row for each day of their span.
    """
    w = series(key)
    ahead = {f"y_{h}": F.lead("y", h).over(w) for h in horizons} | {f"plan_{h}": F.lead("remise_pct", h).over(w) for h in horizons}
    return materialise(features.select(key, "ds", *columns, "y", "remise_pct").withColumns(ahead).drop(*{"y", "remise_pct"} - set(columns)))


def fit_horizon(frame: DataFrame, columns: Sequence[str], h: int, origin: Column, trees: int, depth: int, least: int = 60, key: str = "unique_id") -> DataFrame:
    """Forecast of the day `h` days after the origin, by boosted trees (leaves of `least` rows or more) fitted to the cutoffs whose target was known at the origin."""
    from pyspark.ml.regression import GBTRegressor
    day = F.date_add("ds", h)
    names = [*columns, "target_dow", "target_month", "target_week", "planned_discount"]
    rows = frame.select(key, "ds", *columns, F.weekday(day).alias("target_dow"), F.month(day).alias("target_month"), F.weekofyear(day).alias("target_week"),
                        F.col(f"plan_{h}").alias("planned_discount"), F.col(f"y_{h}").alias("target"), day.alias("target_ds"))
    train = assemble(rows.filter((F.col("target_ds") <= origin) & F.col("target").isNotNull()), names, "target")
    test = assemble(rows.filter(F.col("ds") == origin).withColumn("target", F.coalesce("target", F.lit(0))), names, "target")
    model = GBTRegressor(labelCol="target", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.85, featureSubsetStrategy="0.8", minInstancesPerNode=least, seed=42).fit(train)
    return model.transform(test).select(key, "target_ds", F.lit(h).alias("h"), F.col("target").alias("y"), F.greatest("prediction", F.lit(0.0)).alias("pred"))


def direct_forecast(features: DataFrame, columns: Sequence[str], origin, horizons: Sequence[int] = tuple(range(1, 31)), settings: Sequence[tuple[int, int]] = ((20, 4), (40, 3)),
                    tuning_horizons: Sequence[int] = (1, 7, 14, 30), gap: int = 31, at_once: int = 8, least: int = 60, key: str = "unique_id") -> DataFrame:
    """One boosted-tree model per horizon, each trained on targets known at the origin (a date, the last day of history), never fed with predictions.

    Trees and depth are those with the lowest relative error over `tuning_horizons` of the window before, whose origin lies `gap` days earlier: what it forecasts was
    known at the origin. `features`: key, ds, y, remise_pct (the planned discount) and `columns`, a row for each day. Fits are Spark jobs, `at_once` of them run side by side.
    """
    from concurrent.futures import ThreadPoolExecutor
    frame = direct_frame(features, columns, sorted({*horizons, *tuning_horizons}), key)
    day = F.lit(origin).cast("date")

    def forecasts(jobs: list[tuple[int, Column, tuple[int, int]]]) -> list[DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            return list(pool.map(lambda j: fit_horizon(frame, columns, j[0], j[1], *j[2], least, key), jobs))

    def union(parts: Sequence[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    best = settings[0]
    if len(settings) > 1:
        past = forecasts([(h, F.date_sub(day, gap), s) for s in settings for h in tuning_horizons])
        k = len(tuning_horizons)
        scores = union([union(past[i * k:i * k + k]).withColumn("_s", F.lit(i)) for i in range(len(settings))])
        error = F.sum(F.abs(F.col("pred") - F.col("y"))) / F.greatest(F.sum("y"), F.lit(1.0))
        found = scores.groupBy("_s").agg(error.alias("e")).orderBy("e", "_s").first()
        best = settings[found["_s"]] if found else best
    return union(forecasts([(h, day, best) for h in horizons]))


def stacked_horizon_frame(features: DataFrame, test_start: Column, horizons: Sequence[int] = tuple(range(1, 31)), stride: int = 14, key: str = "unique_id") -> DataFrame:
    """All horizons stacked with the horizon as a feature, every `stride`-th day, targets before the test only."""
    first = features.agg(F.min("ds")).scalar()
    rows = (features.filter(F.datediff("ds", first) % stride == 0).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
            .withColumn("target_ds", F.expr("date_add(ds, horizon)")).filter(F.col("target_ds") < test_start))
    targets = features.select(key, F.col("ds").alias("target_ds"), F.col("y").alias("target"), F.col("remise_pct").alias("planned_discount"))
    return rows.join(targets, [key, "target_ds"])


def stacked_forecast(features: DataFrame, columns: Sequence[str], origin, settings: Sequence[tuple[int, int]] = ((20, 3), (40, 3)), horizons: Sequence[int] = tuple(range(1, 31)), gap: int = 30, key: str = "unique_id") -> DataFrame:
    """All horizons by one boosted-tree model with the horizon as a feature, trained on targets known at the origin, the last day of history.

    The number of trees and their depth are those with the lowest relative error when the same is done `gap` days earlier.
    """
    from pyspark.ml.regression import GBTRegressor
    names = [*columns, "horizon", "target_dow", "target_month", "planned_discount"]
    day = F.lit(origin).cast("date")

    def dated(d: DataFrame) -> DataFrame:
        return d.withColumn("target_dow", F.weekday("target_ds")).withColumn("target_month", F.month("target_ds"))

    def scored(at: Column, trees: int, depth: int) -> DataFrame:
        train = assemble(dated(stacked_horizon_frame(features, F.date_add(at, 1), horizons, key=key)), names, "target")
        rows = features.filter(F.col("ds") == at).withColumn("horizon", F.explode(F.lit(list(horizons)))).withColumn("target_ds", F.expr("date_add(ds, horizon)"))
        targets = features.select(key, F.col("ds").alias("target_ds"), F.col("y").alias("target"), F.col("remise_pct").alias("planned_discount"))
        test = assemble(dated(rows.join(targets, [key, "target_ds"], "left").withColumn("target", F.coalesce("target", F.lit(0)))), names, "target")
        model = GBTRegressor(labelCol="target", featuresCol="features", maxIter=trees, maxDepth=depth, seed=42).fit(train)
        return model.transform(test).select(key, "target_ds", F.col("horizon").cast("int").alias("h"), F.col("target").alias("y"), F.greatest("prediction", F.lit(0.0)).alias("pred"))

    def error(setting: tuple[int, int]) -> float:
        past = scored(F.date_sub(day, gap), *setting)
        return past.agg(F.sum(F.abs(F.col("pred") - F.col("y"))) / F.greatest(F.sum("y"), F.lit(1.0))).first()[0]

    best = min(settings, key=error) if len(settings) > 1 else settings[0]
    return scored(day, *best)


def cumulative_model(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str = "target_sum_30", family: str = "tweedie") -> DataFrame:
    """Direct model of the 30-day total: Tweedie regression with log link, or boosted trees with absolute loss."""
    from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
    fit, score = assemble(train.filter(F.col(label).isNotNull()), columns, label), assemble(test, columns, label)
    if family == "tweedie":
        est = GeneralizedLinearRegression(family="tweedie", variancePower=1.3, linkPower=0.0, labelCol=label, featuresCol="features", regParam=0.01, maxIter=25)
    else:
        est = GBTRegressor(lossType="absolute", labelCol=label, featuresCol="features", maxIter=15, maxDepth=4, seed=42)
    return est.fit(fit).transform(score).withColumn("pred", F.greatest("prediction", F.lit(0.0)))


def hurdle(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Probability of a sale times the quantity expected when there is one."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import LinearRegression
    fit, score = assemble(train, columns, "y"), assemble(test, columns, "y")
    occurs = LogisticRegression(labelCol="_any", featuresCol="features", regParam=0.01, maxIter=25, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(
        fit.withColumn("_any", (F.col("y") > 0).cast("double")))
    size = LinearRegression(labelCol="y", featuresCol="features", regParam=0.1, predictionCol="_size").fit(fit.filter("y > 0"))
    out = size.transform(occurs.transform(score)).withColumn("prob", vector_to_array("_p")[1])
    return out.withColumn("pred", F.greatest(F.col("prob") * F.col("_size"), F.lit(0.0))).drop("features", "_p", "_r", "_c", "_size")


def probability_scores(df: DataFrame) -> DataFrame:
    """Brier score and log loss of `prob` against y > 0."""
    hit = (F.col("y") > 0).cast("double")
    p = F.greatest(F.least("prob", F.lit(1 - 1e-12)), F.lit(1e-12))
    return df.agg(F.avg(F.pow(p - hit, 2)).alias("brier"), F.avg(-(hit * F.log(p) + (1 - hit) * F.log(1 - p))).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def average_precision(df: DataFrame) -> DataFrame:
    """Area under the precision-recall curve: mean precision at the hits, by falling probability."""
    from marketlens.operators.ordered import running_totals
    levels = df.groupBy("prob").agg(F.count_if(F.col("y") > 0).alias("hits"), F.count(F.lit(1)).alias("n"))
    cum = running_totals(levels, [], [-F.col("prob")], {"_h": F.col("hits"), "_n": F.col("n")})
    return cum.agg((F.sum(F.col("hits") * F.col("_h") / F.col("_n")) / F.sum("hits")).alias("pr_auc"))


def decile_calibration(df: DataFrame) -> DataFrame:
    """Mean probability and observed rate in ten equal probability bands."""
    band = F.least(F.floor(F.col("prob") * 10), F.lit(9)).cast("int")
    return df.groupBy(band.alias("decile")).agg(F.avg("prob").alias("p_moyenne"), F.avg((F.col("y") > 0).cast("double")).alias("taux"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- selection on earlier windows

WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)


def cumulative_errors(frame: DataFrame, preds: dict[str, Column], keys: Sequence[str] = ("unique_id", "window")) -> DataFrame:
    """Per (series, window): total y and the absolute error of each total prediction."""
    g = frame.groupBy(*keys).agg(F.sum("y").alias("y"), *[F.sum(c).alias(n) for n, c in preds.items()])
    return g.select(*keys, "y", *[F.abs(F.col(n) - F.col("y")).alias(n) for n in preds])


def blend_weights(frame: DataFrame, default: float = 0.5, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Weight of model a per window: best 30-day WAPE over strictly earlier windows, the default for the first."""
    mix = {f"w{i}": F.greatest(w * F.col("pred_a") + (1 - w) * F.col("pred_b"), F.lit(0.0)) for i, w in enumerate(weights)}
    per = cumulative_errors(frame, mix).groupBy("window").agg(F.sum("y").alias("y"), *[F.sum(n).alias(n) for n in mix])
    past = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)  # a handful of windows
    scored = per.select("window", *[F.round(ratio(F.sum(n).over(past), F.sum("y").over(past)), 10).alias(n) for n in mix])
    best = F.array_min(F.filter(F.array(*[F.struct(F.col(f"w{i}").alias("s"), F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)]), lambda x: x["s"].isNotNull()))
    return scored.select("window", F.coalesce(best.getField("w"), F.lit(default)).alias("weight"), best.getField("s").alias("wape_passee"))


def blend(frame: DataFrame, chosen: DataFrame) -> DataFrame:
    w = F.col("weight")
    return frame.join(F.broadcast(chosen), "window").withColumn("y_pred", F.greatest(w * F.col("pred_a") + (1 - w) * F.col("pred_b"), F.lit(0.0)))


def select_b1(segments: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Preset rule: model b when the share of zero days is above the threshold."""
    return segments.select("unique_id", "window", F.when(F.col("taux_jours_sans_vente") > threshold, "b").otherwise("a").alias("choix"))


def select_b2(frame: DataFrame, segments: DataFrame, min_support: int = 30) -> DataFrame:
    """Best model of each ABC x profile segment over strictly earlier windows with enough support, else a."""
    per = cumulative_errors(frame, {"ea": F.col("pred_a"), "eb": F.col("pred_b")}).join(segments, ["unique_id", "window"])
    g = per.groupBy("classe_abc", "profil_demande", "window").agg(F.sum("ea").alias("ea"), F.sum("eb").alias("eb"), F.count(F.lit(1)).alias("n"))
    later = segments.select(F.col("window").alias("_for")).distinct()
    spread = g.join(F.broadcast(later), F.col("_for") > F.col("window"))
    rule = (spread.groupBy("classe_abc", "profil_demande", F.col("_for").alias("window")).agg(F.sum("ea").alias("ea"), F.sum("eb").alias("eb"), F.sum("n").alias("n"))
            .withColumn("choix", F.when((F.col("n") >= min_support) & (F.round("eb", 6) < F.round("ea", 6)), "b").otherwise("a")))
    return (segments.join(rule, ["classe_abc", "profil_demande", "window"], "left")
            .select("unique_id", "window", F.coalesce("choix", F.lit("a")).alias("choix")))


def select_b3(frame: DataFrame, min_windows: int = 2, margin: float = 0.1) -> DataFrame:
    """Per series: model b only with enough earlier windows and a relative gain of at least the margin."""
    per = cumulative_errors(frame, {"ea": F.col("pred_a"), "eb": F.col("pred_b")})
    past = Window.partitionBy("unique_id").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    ea, eb, n = F.sum("ea").over(past), F.sum("eb").over(past), F.count(F.lit(1)).over(past)
    gain = ratio(ea - eb, ea)
    return per.select("unique_id", "window", F.when((n >= min_windows) & (F.round(gain, 9) >= margin), "b").otherwise("a").alias("choix"))


def expanding_ensemble(frame: DataFrame, candidates: Sequence[str], default: tuple[str, float], weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Candidate and weight per window, by cumulated WAPE over strictly earlier windows. `frame` has pred_a and one column per candidate."""
    grid = [(c, w) for c in candidates for w in weights]
    mix = {f"g{i}": w * F.col("pred_a") + (1 - w) * F.col(c) for i, (c, w) in enumerate(grid)}
    per = cumulative_errors(frame, mix).groupBy("window").agg(F.sum("y").alias("y"), *[F.sum(n).alias(n) for n in mix])
    past = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    scored = per.select("window", *[F.round(ratio(F.sum(n).over(past), F.sum("y").over(past)), 10).alias(n) for n in mix])
    entries = [F.struct(F.col(f"g{i}").alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(float(w)).alias("w")) for i, (c, w) in enumerate(grid)]
    best = F.array_min(F.filter(F.array(*entries), lambda x: x["s"].isNotNull()))
    return scored.select("window", F.coalesce(best.getField("c"), F.lit(default[0])).alias("candidate"), F.coalesce(best.getField("w"), F.lit(float(default[1]))).alias("direct_weight"))


def fallback_classifier(raw: DataFrame, context: DataFrame, log: DataFrame) -> DataFrame:
    """Status and final value of raw predictions.

    `raw`: unique_id, ds, y, y_pred_raw, model, window; `context`: unique_id, window, train_observations, last_value,
    mean_value; `log`: model, window, unique_id, reason, exception. First match: cold start, exception, budget, silent
    non-finite value; else a valid prediction. Final values are never negative.
    """
    reasons = log.groupBy("model", "window", "unique_id").agg(F.bool_or(F.col("reason") == "exception_modele").alias("_exc"), F.bool_or(F.col("reason") == "budget_temps_depasse").alias("_bud"),
                                                              F.max("exception").alias("_text"))
    d = raw.join(context, ["unique_id", "window"], "left").join(reasons, ["model", "window", "unique_id"], "left")
    d = d.withColumn("train_observations", F.coalesce("train_observations", F.lit(0)))
    n, bad = F.col("train_observations"), F.col("y_pred_raw").isNull() | F.isnan("y_pred_raw") | (F.abs("y_pred_raw") == float("inf"))
    cold, exc, bud = n == 0, F.coalesce("_exc", F.lit(False)), F.coalesce("_bud", F.lit(False))
    last = F.coalesce("last_value", F.lit(0.0))
    average = bad & (F.col("model") == "WindowAverage28") & (n < 28) & F.col("mean_value").isNotNull()
    status = (F.when(cold, "cold_start_fallback").when(exc, "exception_fallback").when(bud, "budget_fallback").when(bad, "success_invalid_prediction_fallback")
              .otherwise("success_valid_prediction"))
    final = F.when(cold, 0.0).when(exc | bud, F.col("y_pred_raw")).when(average, F.col("mean_value")).when(bad, last).otherwise(F.col("y_pred_raw"))
    effective = (F.when(cold, "ColdStartZero").when(exc | bud, "Naive").when(average, "AvailableHistoryAverage").when(bad, "Naive").otherwise(F.col("model")))
    reason = (F.when(cold, "produit_absent_du_train").when(exc, F.concat(F.lit("exception: "), F.coalesce("_text", F.lit("?")))).when(bud, "budget_temps_depasse")
              .when(average, F.concat(F.lit("window_average_historique_insuffisant(n="), n.cast("string"), F.lit("<28)")))
              .when(bad & (F.col("model") == "SeasonalNaive7") & (n < 7), F.concat(F.lit("seasonal_naive_historique_insuffisant(n="), n.cast("string"), F.lit("<7)")))
              .when(bad, F.concat(F.lit("prediction_non_finie_repli_naive(n="), n.cast("string"), F.lit(")"))))
    return (d.withColumn("status", status).withColumn("model_effective", effective).withColumn("fallback_reason", reason)
            .withColumn("y_pred_final", F.greatest(F.coalesce(final, F.lit(0.0)), F.lit(0.0))).drop("_exc", "_bud", "_text"))


def cold_start_baselines(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Zero, category mean, category x weekday mean for products without history. `train`, `rows`: categorie, dow, y."""
    cat = train.groupBy("categorie").agg(F.avg("y").alias("moyenne_categorie"))
    dow = train.groupBy("categorie", "dow").agg(F.avg("y").alias("moyenne_categorie_jour"))
    return (rows.join(cat, "categorie", "left").join(dow, ["categorie", "dow"], "left").withColumn("zero", F.lit(0.0))
            .withColumn("moyenne_categorie_jour", F.coalesce("moyenne_categorie_jour", "moyenne_categorie")))


# fixed values: feature groups in the order they are added
ABLATION_GROUPS = {"calendrier": ("dow", "month", "weekend"), "lags": ("y_lag1", "y_lag7", "y_lag14", "y_lag28"), "tendance": ("y_ma28",),
                   "promotion": ("promo",), "stock": ("stock_cut",), "web": ("views_lag1", "cart_lag1", "views_ma7")}


def ablation_columns(level: int) -> list[str]:
    """Features kept at a level: the first `level` groups."""
    return [c for names in list(ABLATION_GROUPS.values())[:level] for c in names]


def stock_projection_audit(stock: DataFrame, horizon: int = 30, key: str = "produit_key") -> DataFrame:
    """Stock `horizon` days ahead over yesterday's stock: median, p10, p90, share off by more than 20 %."""
    w = series(key)
    r = stock.select(ratio(F.lead("niveau_stock", horizon).over(w), F.lag("niveau_stock", 1).over(w)).alias("r")).filter("r is not null")
    q = exact_quantiles(r, [], "r", {"p10": 0.1, "mediane": 0.5, "p90": 0.9}).select(F.struct("p10", "mediane", "p90")).scalar()
    return (r.agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs(F.col("r") - 1) > 0.2).cast("int")).alias("part_hors_20"))
            .withColumns({c: q.getField(c) for c in ("p10", "mediane", "p90")}))


def forecast_lookup(requests: DataFrame, forecasts: DataFrame, key: str = "unique_id") -> DataFrame:
    """Stored forecasts of the requested series up to a horizon; an unknown series gets the catalogue mean profile. `requests`: key, horizon."""
    profile = forecasts.groupBy("h").agg(F.avg("pred").alias("_mean"))
    known = forecasts.select(key).distinct().withColumn("_known", F.lit(True))
    days = requests.join(known, key, "left").withColumn("h", F.explode(F.sequence(F.lit(1), F.col("horizon"))))
    d = days.join(forecasts.select(key, "h", "pred"), [key, "h"], "left").join(profile, "h", "left")
    return (d.groupBy(key, "horizon").agg(F.sum(F.coalesce("pred", "_mean")).alias("total"), F.count(F.coalesce("pred", "_mean")).alias("n_jours"),
                                          F.max(F.when(F.col("_known"), "serie").otherwise("profil_moyen")).alias("source")))
