"""Metrics, time-ordered evaluation, intervals, resampling tests, selection gates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalar import horizon_bucket, ratio
from marketlens.operators.ordered import exact_quantiles, materialise, pick_rank, running_totals



def N() -> Column:
    return F.count(F.lit(1))



def error_metrics(y: str = "y", p: str = "pred", weight: Column | None = None) -> list[Column]:
    """All point metrics as aggregate columns; a volume of zero gives NULL instead of a ratio."""
    y, p = F.col(y).cast("double"), F.col(p).cast("double")
    e = p - y
    den = (F.abs(y) + F.abs(p)) / 2
    w = weight if weight is not None else F.abs(y)
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), ratio(F.sum(F.abs(e)), F.sum(F.abs(y))).alias("wape"),
            F.avg(F.when(den < 1e-9, 0.0).otherwise(F.abs(e) / F.when(den < 1e-9, 1.0).otherwise(den))).alias("smape"),
            F.avg(F.when(F.abs(y) > 1e-9, F.abs(e) / F.abs(F.when(F.abs(y) > 1e-9, y)))).alias("mape_positive"),
            F.avg(e).alias("bias"), ratio(F.sum(e), F.sum(F.abs(y))).alias("relative_bias"), F.avg((p < y).cast("int")).alias("under_rate"), F.avg((p > y).cast("int")).alias("over_rate"),
            F.avg(F.when(e < 0, -1.5 * e).otherwise(e)).alias("asym_cost_1_5"), F.avg(F.when(e < 0, -2.0 * e).otherwise(e)).alias("asym_cost_2"),
            ratio(F.sum(w * F.abs(e)), F.sum(w)).alias("weighted_mae"), N().alias("n")]


METRICS = ("mae", "rmse", "wape", "smape", "mape_positive", "bias", "relative_bias", "under_rate", "over_rate", "asym_cost_1_5", "asym_cost_2", "weighted_mae")


def metrics_by_group(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Metrics per group, a NULL group kept as a group."""
    return df.groupBy(*groups).agg(*error_metrics())


def scaled_errors(df: DataFrame, scales: DataFrame, key: str = "unique_id") -> DataFrame:
    """MASE and RMSSE per series; the scales come from the training rows only."""
    e = F.col("pred") - F.col("y")
    return (df.groupBy(key).agg(F.avg(F.abs(e)).alias("_mae"), F.sqrt(F.avg(e * e)).alias("_rmse")).join(scales, key)
            .select(key, ratio("_mae", "mae_scale").alias("mase"), ratio("_rmse", "rms_scale").alias("rmsse")))


def cumulative_wape(df: DataFrame, horizons: Sequence[int] = (7, 14, 30), keys: Sequence[str] = ("window",), key: str = "unique_id") -> DataFrame:
    """Sum of the first h days per series, then pooled WAPE."""
    g = df.groupBy(*keys, key).agg(*[F.sum(F.when(F.col("h") <= h, F.col(c))).alias(f"{c}_{h}") for h in horizons for c in ("y", "pred")])
    return g.groupBy(*keys).agg(*[ratio(F.sum(F.abs(F.col(f"pred_{h}") - F.col(f"y_{h}"))), F.sum(f"y_{h}")).alias(f"wape_cum_{h}") for h in horizons])


def evaluate_predictions(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Daily metrics overall and by each dimension in one pass over grouping sets."""
    sets = [[]] + [[F.col(d)] for d in dims]
    axis = F.lit("global")
    for d in dims:
        axis = F.when(F.grouping(d) == 0, d).otherwise(axis)
    g = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(axis.alias("axe"), *error_metrics())
    return g.withColumn("valeur", F.coalesce(*[F.col(d).cast("string") for d in dims], F.lit(""))).drop(*dims)


def stability(per_window: DataFrame, metric: str = "wape", by: str = "model") -> DataFrame:
    return per_window.groupBy(by).agg(F.avg(metric).alias("moyenne"), F.stddev_samp(metric).alias("ecart_type"), F.min(metric).alias("min"), F.max(metric).alias("max"))


def compare_to_reference(per_window: DataFrame, reference: str, metrics: Sequence[str] = ("wape", "bias")) -> DataFrame:
    """Mean delta of each metric against a reference model and the number of windows improved."""
    ref = per_window.filter(F.col("model") == reference).select("window", *[F.col(m).alias(f"_r_{m}") for m in metrics])
    d = per_window.filter(F.col("model") != reference).join(F.broadcast(ref), "window")
    return d.groupBy("model").agg(*[F.avg(F.col(m) - F.col(f"_r_{m}")).alias(f"delta_{m}") for m in metrics], F.count_if(F.col(metrics[0]) < F.col(f"_r_{metrics[0]}")).alias("fenetres_ameliorees"), N().alias("n_fenetres"))


def macro_wape(df: DataFrame, key: str = "produit_key") -> DataFrame:
    """Mean over products of the product WAPE."""
    per = df.groupBy(key).agg(ratio(F.sum(F.abs(F.col("pred") - F.col("y"))), F.sum("y")).alias("_w"))
    return per.agg(F.avg("_w").alias("macro_wape"), F.count("_w").alias("n_produits"))


def margin_metrics(df: DataFrame) -> DataFrame:
    """Margin error and guard rails: rows priced under cost, rows under the margin floor. Columns: y, pred, prix, cout."""
    m, mp = F.col("y") * (F.col("prix") - F.col("cout")), F.col("pred") * (F.col("prix") - F.col("cout"))
    return df.agg(ratio(F.sum(F.abs(mp - m)), F.sum(F.abs(m))).alias("wape_marge"), ratio(F.sum(mp - m), F.sum(F.abs(m))).alias("biais_marge"),
                  F.count_if(F.col("prix") < F.col("cout")).alias("sous_cout"), F.count_if(F.col("prix") - F.col("cout") < 0.05 * F.col("prix")).alias("sous_plancher"), N().alias("n"))


# ---------------------------------------------------------------- ranking metrics

def ranking_metrics(recs: DataFrame, truth: DataFrame, k: int = 10, user: str = "client_key", item: str = "produit_key") -> DataFrame:
    """Precision, recall, NDCG, MAP, MRR and hit rate at k; users without a target are left out."""
    t = truth.select(user, item).distinct()
    sizes = t.groupBy(user).agg(N().alias("_n"))
    hits = recs.filter(F.col("rang") <= k).join(t, [user, item], "left_semi")
    w = Window.partitionBy(user).orderBy("rang")  # at most k rows
    gains = hits.withColumn("_i", F.row_number().over(w)).groupBy(user).agg(
        N().alias("_h"), F.sum(1 / F.log2(F.col("rang") + 1)).alias("_dcg"), F.sum(F.col("_i") / F.col("rang")).alias("_ap"), F.min("rang").alias("_first"))
    d = sizes.join(gains, user, "left").na.fill(0, ["_h"]).na.fill(0.0, ["_dcg", "_ap"])
    top = F.least("_n", F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), top.cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return d.select(user, (F.col("_h") / k).alias("precision"), ratio("_h", "_n").alias("recall"), ratio(F.col("_dcg"), ideal).alias("ndcg"), ratio(F.col("_ap"), top).alias("ap"),
                    F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"), (F.col("_h") > 0).cast("int").alias("hit"))


def mean_metrics(per_user: DataFrame, columns: Sequence[str] = ("precision", "recall", "ndcg", "ap", "mrr", "hit")) -> DataFrame:
    return per_user.agg(*[F.avg(c).alias(c) for c in columns], N().alias("n_users"))


def masked_item_metrics(recs: DataFrame, targets: DataFrame, ks: Sequence[int] = (5, 10, 20), ctx: str = "order_id", item: str = "produit_key") -> DataFrame:
    """One hidden item per context: recall is the hit, NDCG is 1 / log2(rank + 1)."""
    hit = targets.select(ctx, F.col("target").alias(item)).join(recs.select(ctx, item, "rang"), [ctx, item], "left")
    cols = []
    for k in ks:
        inside = F.coalesce(F.col("rang") <= k, F.lit(False))
        cols += [inside.cast("int").alias(f"recall_{k}"), F.when(inside, 1 / F.log2(F.col("rang") + 1.0)).otherwise(0.0).alias(f"ndcg_{k}")]
    return hit.select(ctx, *cols, F.coalesce(1 / F.col("rang"), F.lit(0.0)).alias("mrr"))


def slate_metrics(slates: DataFrame, label: str, k: int = 5, slate: str = "session_id", order: str = "rang") -> DataFrame:
    """Hit, NDCG and reciprocal rank of the served (or re-scored) order of each slate that has a positive."""
    pos = F.col(label).cast("int")
    g = slates.filter(F.col(order) <= k).groupBy(slate).agg(F.sum(pos).alias("_n"), F.sum(F.when(pos == 1, 1 / F.log2(F.col(order) + 1.0))).alias("_dcg"), F.min(F.when(pos == 1, F.col(order))).alias("_f"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("_n").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return g.filter("_n > 0").select(slate, ratio(F.col("_dcg"), ideal).alias("ndcg"), (1 / F.col("_f")).alias("mrr"))


def beyond_accuracy(recs: DataFrame, products: DataFrame, popularity: DataFrame, k: int = 10, user: str = "client_key") -> DataFrame:
    """Catalogue coverage, mean categories per list, novelty, share of the ten most shown products. `popularity`: produit_key, n."""
    top = recs.filter(F.col("rang") <= k).join(products.select("produit_key", "categorie"), "produit_key")
    total = popularity.agg(F.sum("n")).scalar()
    catalogue = products.agg(F.count_distinct("produit_key")).scalar()
    shown = top.groupBy("produit_key").agg(N().alias("_s"))
    ten = shown.orderBy(F.desc("_s"), "produit_key").limit(10).agg(F.sum("_s")).scalar()
    novelty = top.join(popularity, "produit_key").agg(F.avg(-F.log2(F.col("n") / total))).scalar()
    per = top.groupBy(user).agg(F.count_distinct("categorie").alias("_c")).agg(F.avg("_c")).scalar()
    return shown.agg(ratio(N(), catalogue).alias("couverture"), ratio(ten, F.sum("_s")).alias("concentration_top10")).withColumn("diversite", per).withColumn("nouveaute", novelty)


def client_segments(train: DataFrame, clients: DataFrame) -> DataFrame:
    """Cold start, active (at or above the median number of purchases) or low."""
    n = train.groupBy("client_key").agg(N().alias("n"))
    median = exact_quantiles(n, [], "n", {"m": 0.5}).scalar()
    d = clients.select("client_key").join(n, "client_key", "left")
    return d.select("client_key", F.when(F.col("n").isNull(), "demarrage_a_froid").when(F.col("n") >= median, "actif").otherwise("peu_actif").alias("segment"))


# ---------------------------------------------------------------- resampling

def poisson_weight(unit: Column, draw: Column, seed: int = 42) -> Column:
    """Poisson(1) weight of a unit in a draw, from a hash: the same on every run and every partitioning."""
    u = F.pmod(F.xxhash64(unit, draw, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cuts, term, total = [], 0.36787944117144233, 0.0
    for i in range(8):
        total += term
        cuts.append(total)
        term /= i + 1
    return sum(((u >= c).cast("int") for c in cuts[1:]), (u >= cuts[0]).cast("int"))


def bootstrap_draws(units: DataFrame, unit: str, numerators: Sequence[str], denominator: str | None, draws: int = 200, seed: int = 42) -> DataFrame:
    """Resampled totals per draw. Units are first added up into unit rows; each unit row meets its draws by explode and
    is added up again on the map side, so the shuffle carries draws x partitions rows."""
    columns = [*numerators, *([denominator] if denominator else [])]
    per = units.groupBy(unit).agg(*[F.sum(c).alias(c) for c in columns], N().alias("_n"))
    d = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_w", poisson_weight(F.col(unit), F.col("draw"), seed))
    return d.groupBy("draw").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in columns], F.sum(F.col("_n") * F.col("_w")).alias("_n"))


def paired_bootstrap(units: DataFrame, unit: str, a: str, b: str, denominator: str | None = None, draws: int = 200, seed: int = 42) -> DataFrame:
    """Observed difference a - b (mean, or ratio of sums) with a percentile interval over resampled units."""
    den = denominator or "_n"
    d = bootstrap_draws(units, unit, [a, b], denominator, draws, seed).withColumn("diff", ratio(F.col(a) - F.col(b), F.col(den)))
    obs = units.agg(ratio(F.sum(a) - F.sum(b), F.sum(denominator) if denominator else N())).scalar()
    return d.agg(F.percentile("diff", F.lit(0.025)).alias("ci_low"), F.percentile("diff", F.lit(0.975)).alias("ci_high"), N().alias("draws")).withColumn("difference", obs)


def permutation_test(units: DataFrame, unit: str, a: str, b: str, draws: int = 200, seed: int = 42) -> DataFrame:
    """Two-sided paired test: labels swapped per unit by a hash bit; (extreme + 1) / (draws + 1)."""
    per = units.groupBy(unit).agg((F.sum(a) - F.sum(b)).alias("_d"))
    obs = per.agg(F.sum("_d")).scalar()
    sign = F.when(F.pmod(F.xxhash64(unit, "draw", F.lit(seed)), F.lit(2)) == 0, 1).otherwise(-1)
    d = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).groupBy("draw").agg(F.sum(F.col("_d") * sign).alias("_s"))
    return d.agg(((F.count_if(F.abs("_s") >= F.abs(obs) - 1e-12) + 1) / (N() + 1)).alias("p_value")).withColumn("total", obs)


def two_sample_test(units: DataFrame, treated: str, value: str, draws: int = 200, seed: int = 42) -> DataFrame:
    """Difference of means treated - control with bootstrap interval and permutation p value. `treated`: 0 / 1 column, one row per unit (`unit`)."""
    t, v = F.col(treated), F.col(value).cast("double")
    d = units.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    w = poisson_weight(F.col("unit"), F.col("draw"), seed)
    obs = units.agg((F.avg(F.when(t == 1, v)) - F.avg(F.when(t == 0, v)))).scalar()
    share = units.agg(F.avg(t)).scalar()
    label = (F.pmod(F.xxhash64("unit", "draw", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share).cast("int")
    g = d.withColumn("_w", w).withColumn("_l", label).groupBy("draw").agg(
        (ratio(F.sum(F.when(t == 1, v * F.col("_w"))), F.sum(F.when(t == 1, F.col("_w")))) - ratio(F.sum(F.when(t == 0, v * F.col("_w"))), F.sum(F.when(t == 0, F.col("_w"))))).alias("_b"),
        (F.avg(F.when(F.col("_l") == 1, v)) - F.avg(F.when(F.col("_l") == 0, v))).alias("_p"))
    return g.agg(F.percentile("_b", F.lit(0.025)).alias("ci_low"), F.percentile("_b", F.lit(0.975)).alias("ci_high"),
                 ((F.count_if(F.abs("_p") >= F.abs(obs)) + 1) / (N() + 1)).alias("p_value")).withColumn("difference", obs)


def holm(tests: DataFrame, family: str, p: str = "p_value", name: str = "test") -> DataFrame:
    """Step-down adjusted p values per family: running maximum of (m - rank + 1) x p, at most 1."""
    w = Window.partitionBy(family).orderBy(p, name)  # a family is a handful of tests
    m = N().over(Window.partitionBy(family))
    step = tests.withColumn("_s", (m - F.row_number().over(w) + 1) * F.col(p))
    return step.withColumn("p_holm", F.least(F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_s")


# ---------------------------------------------------------------- intervals

def conformal_quantile(residuals: DataFrame, level: float, keys: Sequence[str] = (), value: str = "residual", out: str = "q") -> DataFrame:
    """Absolute residual at rank ceil((n + 1) x level), at most n, per key."""
    d = residuals.filter(F.col(value).isNotNull()).select(*keys, F.abs(value).alias("_a"))
    rank = F.least(F.ceil((F.col("_total") + 1) * F.lit(level) - 1e-9), F.col("_total"))
    # the order statistic "higher" at probability r/n of n values sits at 0-based index ceil((n - 1) r / n)
    index = F.ceil((F.col("_total") - 1) * (rank / F.col("_total")) - 1e-9) + 1
    return pick_rank(d, list(keys), "_a", index, out)


def mondrian_intervals(current: DataFrame, previous: DataFrame, level: float, cells: Sequence[str] = ("h", "abc_a", "intermittent"), min_rows: int = 30) -> DataFrame:
    """Conformal intervals by cell, falling back to the horizon alone where a cell has under 30 residuals."""
    prev = previous.withColumn("residual", F.col("y") - F.col("pred"))
    fine = conformal_quantile(prev, level, cells, out="_qf").withColumnRenamed("n", "_nf")
    coarse = conformal_quantile(prev, level, [cells[0]], out="_qc").drop("n")
    d = current.join(fine, list(cells), "left").join(coarse, cells[0], "left")
    q = F.when(F.col("_nf") >= min_rows, F.col("_qf")).otherwise(F.col("_qc"))
    return d.withColumn("q", q).withColumn("borne_basse", F.greatest(F.col("pred") - F.col("q"), F.lit(0.0))).withColumn("borne_haute", F.col("pred") + F.col("q")).drop("_qf", "_qc", "_nf")


def union_quantiles(counts: DataFrame, regime: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of residuals (bucket, window, _v, _n copies; _v may be NULL) over the windows before each window, or over all but it: bucket, window, _n, quantiles.

    Every window has its own running count along one common order of the residuals, so a residual is one row however many windows use it.
    The driver sees the numbers of the evaluation windows only.
    """
    kind = counts.schema["window"].dataType
    windows = [F.lit(w).cast(kind) for w in sorted(r["window"] for r in counts.select("window").distinct().collect()) or [None]]
    used = [F.col("window") < w if regime == "prior" else F.col("window") != w for w in windows]
    share = [F.when(u, F.col("_n")).otherwise(0) for u in used]
    known = F.col("_v").isNotNull()
    sizes = counts.groupBy("bucket").agg(*[F.sum(s).alias(f"_all{i}") for i, s in enumerate(share)], *[F.sum(F.when(known, s).otherwise(0)).alias(f"_total{i}") for i, s in enumerate(share)])
    ranked = running_totals(counts.filter(known), ["bucket"], [F.col("_v"), F.col("window")], {f"_cum{i}": s for i, s in enumerate(share)}, write=False)
    placed, ends, limits = ranked.join(F.broadcast(sizes), "bucket"), [], []  # a row for each of the horizon buckets
    for i, (w, s) in enumerate(zip(windows, share)):
        fields = [w.alias("window"), F.col(f"_all{i}").alias("_n")]
        for name, p in probs.items():
            pos = (F.col(f"_total{i}") - 1) * F.lit(float(p))
            for end, at in (("low", F.floor(pos)), ("high", F.ceil(pos))):
                ends.append(F.max(F.when((at < F.col(f"_cum{i}")) & (at >= F.col(f"_cum{i}") - s), F.col("_v"))).cast("double").alias(f"_{end}_{name}{i}"))
            low, high = (F.col(f"_{end}_{name}{i}") for end in ("low", "high"))
            fields.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
        limits.append(F.struct(*fields))
    found = placed.groupBy("bucket").agg(*ends).join(F.broadcast(sizes), "bucket")
    return found.select("bucket", F.explode(F.array(*limits)).alias("_l")).select("bucket", "_l.*")


def bucket_intervals(df: DataFrame, level: float = 0.8, regime: str = "prior", min_rows: int = 30) -> DataFrame:
    """Residual quantiles by horizon bucket from earlier windows only ('prior') or all other windows ('leave_one_out').

    Lower bound at least 0, upper at least the lower; a window without calibration rows stays uncalibrated.
    """
    d = df.withColumn("bucket", horizon_bucket(F.col("h"))).withColumn("residual", F.col("y") - F.col("pred"))
    counts = materialise(d.filter("bucket is not null and window is not null").groupBy("bucket", "window", F.col("residual").alias("_v")).agg(N().alias("_n")))
    lim = union_quantiles(counts, regime, {"lo": (1 - level) / 2, "hi": 1 - (1 - level) / 2}).filter(F.col("_n") >= min_rows)
    out = d.join(F.broadcast(lim), ["window", "bucket"], "left").withColumn("calibrable", F.col("lo").isNotNull())
    low = F.when(F.col("calibrable"), F.greatest(F.col("pred") + F.col("lo"), F.lit(0.0)))
    out = out.withColumn("borne_basse", low)
    return out.withColumn("borne_haute", F.when(F.col("calibrable"), F.greatest(F.col("pred") + F.col("hi"), F.col("borne_basse")))).drop("lo", "hi", "_n")


def coverage_report(df: DataFrame) -> DataFrame:
    """Coverage and width of the calibrated points, and the share wider than three times the median."""
    c = df.filter("calibrable").withColumn("_w", F.col("borne_haute") - F.col("borne_basse"))
    median = exact_quantiles(c, [], "_w", {"m": 0.5}).scalar()
    total = df.agg(N()).scalar()
    return (c.agg(N().alias("n_calibrables"), F.avg(F.col("y").between(F.col("borne_basse"), F.col("borne_haute")).cast("int")).alias("couverture"), F.avg("_w").alias("largeur_moyenne"),
                  F.avg((F.col("_w") > 3 * median).cast("int")).alias("part_trop_larges")).withColumn("n_total", total).withColumn("largeur_mediane", median))


# ---------------------------------------------------------------- windows, selection, audits

def date_chunks(df: DataFrame, day: str, n: int) -> DataFrame:
    """Distinct days cut into n near-equal runs (a calendar)."""
    return df.select(day).distinct().withColumn("window", F.ntile(n).over(Window.orderBy(day)))


def window_rows(df: DataFrame, windows: DataFrame, day: str = "ds") -> DataFrame:
    """Rows tagged train (strictly before the start) or test per window; later rows are left out."""
    w = df.join(F.broadcast(windows), F.col(day) <= F.col("end"))
    return w.withColumn("part", F.when(F.col(day) < F.col("start"), "train").otherwise("test"))


def acceptance_gate(results: DataFrame, criteria: dict[str, Column]) -> DataFrame:
    """One boolean per criterion and the verdict; a criterion that cannot be evaluated is false."""
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in criteria.items()}
    out = results.withColumns(flags)
    verdict = F.lit(True)
    for n in criteria:
        verdict = verdict & F.col(n)
    return out.withColumn("accepte", verdict)


def select_model(summary: DataFrame, max_bias: float = 0.1) -> DataFrame:
    """Lowest mean WAPE among models with a small bias (ties by name)."""
    return summary.filter(F.abs("bias") <= max_bias).orderBy(F.round("wape", 9), "model").limit(1)


def select_ranker(per_window: DataFrame, baseline: str, intervals: DataFrame, min_gain: float = 0.05, max_recall_loss: float = 0.02, min_windows: int = 3) -> DataFrame:
    """Rankers with NDCG up 5 %, recall down 2 % at most, better in three windows and an interval above zero."""
    ref = per_window.filter(F.col("model") == baseline).select("window", F.col("ndcg").alias("_n"), F.col("recall").alias("_r"))
    g = (per_window.filter(F.col("model") != baseline).join(F.broadcast(ref), "window").groupBy("model")
         .agg(ratio(F.avg("ndcg") - F.avg("_n"), F.avg("_n")).alias("gain_ndcg"), ratio(F.avg("recall") - F.avg("_r"), F.avg("_r")).alias("gain_recall"), F.count_if(F.col("ndcg") > F.col("_n")).alias("fenetres")))
    d = g.join(intervals, "model", "left")
    return acceptance_gate(d, {"ndcg_ok": F.col("gain_ndcg") >= min_gain, "recall_ok": F.col("gain_recall") >= -max_recall_loss, "fenetres_ok": F.col("fenetres") >= min_windows, "ic_ok": F.col("ci_low") > 0})


def leak_audit(honest: DataFrame, leaky: DataFrame, unit: str = "order_id", metric: str = "recall_10", draws: int = 100) -> DataFrame:
    """The same metric with and without information on the hidden target, with a paired interval of the difference."""
    j = honest.select(unit, F.col(metric).alias("_h")).join(leaky.select(unit, F.col(metric).alias("_l")), unit)
    means = j.agg(F.struct(F.avg("_h").alias("h"), F.avg("_l").alias("l"))).scalar()
    return paired_bootstrap(j, unit, "_l", "_h", None, draws).withColumn("sans_fuite", means.getField("h")).withColumn("avec_fuite", means.getField("l"))


def end_to_end_vs_eligible(recs: DataFrame, truth: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """Recall of the same lists on all targets and on targets inside the candidate set, with the eligibility rate."""
    t = truth.select("client_key", "produit_key").distinct()
    on = [c for c in ("client_key", "produit_key") if c in candidates.columns]
    inside = t.join(candidates.select(*on).distinct(), on, "left_semi")
    rows = None
    for name, targets in (("bout_en_bout", t), ("eligible", inside)):
        part = mean_metrics(ranking_metrics(recs, targets, k), ("recall", "ndcg", "hit")).withColumn("perimetre", F.lit(name)).withColumn("n_cibles", targets.agg(N()).scalar())
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("taux_eligibilite", ratio(inside.agg(N()).scalar(), t.agg(N()).scalar()))


def average_popularity(recs: DataFrame, truth: DataFrame, popularity: DataFrame, k: int = 10) -> DataFrame:
    """Mean popularity of recommended items and mean number of targets per client. `popularity`: produit_key, n."""
    targets = truth.select("client_key", "produit_key").distinct().groupBy("client_key").agg(N().alias("_t")).agg(F.avg("_t")).scalar()
    return recs.filter(F.col("rang") <= k).join(popularity, "produit_key").agg(F.avg("n").alias("popularite_moyenne"), N().alias("n")).withColumn("cibles_par_client", targets)


def window_mean_vs_pooled(df: DataFrame) -> DataFrame:
    """WAPE averaged over windows against WAPE pooled over rows, per model."""
    g = df.groupBy("model", "window").agg(F.sum(F.abs(F.col("pred") - F.col("y"))).alias("_e"), F.sum("y").alias("_y"))
    return g.groupBy("model").agg(F.avg(ratio("_e", "_y")).alias("wape_moyenne_fenetres"), ratio(F.sum("_e"), F.sum("_y")).alias("wape_poolee"))


def experiment_analysis(units: DataFrame, outcomes: Sequence[str], control: str, draws: int = 100) -> DataFrame:
    """Each treated arm against control per outcome: means, difference, interval, p value, adjusted p value.

    `units`: unit, arm and the outcomes, one row per unit.
    """
    arms = sorted(r[0] for r in units.select("arm").distinct().collect() if r[0] != control)  # a handful of arms
    out = None
    for o in outcomes:
        for a in arms:
            pair = units.filter(F.col("arm").isin(control, a)).withColumn("_t", (F.col("arm") == a).cast("int"))
            means = pair.agg(F.struct(F.avg(F.when(F.col("_t") == 0, F.col(o))).alias("c"), F.avg(F.when(F.col("_t") == 1, F.col(o))).alias("t"))).scalar()
            row = (two_sample_test(pair, "_t", o, draws).withColumn("outcome", F.lit(o)).withColumn("test", F.lit(a))
                   .withColumn("moyenne_controle", means.getField("c")).withColumn("moyenne_traitement", means.getField("t")))
            out = row if out is None else out.unionByName(row)
    return holm(out, "outcome")


def recompute_counts(left: DataFrame, facts: DataFrame, key: str, ts: str, fact_ts: str) -> DataFrame:
    """Earlier facts per left row by a plain inequality join: the second opinion on the running-sum plan.

    Meant for a sample of left rows; each meets only its own key.
    """
    j = left.join(facts.select(F.col(key), F.col(fact_ts).cast("timestamp").alias("_f")), key, "left")
    return j.groupBy(*left.columns).agg(F.count_if(F.col("_f") < F.col(ts).cast("timestamp")).alias("n_direct"))


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    j = a.join(b, list(keys), "full_outer")
    return j.agg(N().alias("n"), F.count_if(~F.col(left).eqNullSafe(F.col(right))).alias("n_ecarts"))
