"""Ordered features without look-ahead.

Series windows run on one row per series and day (or week): a series has at most as many rows as the
calendar has days, because facts are added up per day before the window sees them. Event-level orders
(sessions, intents) go through time slices instead, see `ordered`.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.scalar import FUNNEL_STEPS, ratio, strip_accents_lower
from marketlens.operators.filters import exclude_bots
from marketlens.operators.grids import dense_days, explode_days
from marketlens.operators.ordered import CHUNK, carry_over, exact_quantiles, materialise, running_totals, time_chunk
from marketlens.operators.schema import require_columns


def series(key: Sequence[str] | str = "unique_id", day: str = "ds"):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(day)


def stat(value: Column, kind: str) -> Column:
    v = value.cast("double")
    if kind == "median":
        return F.percentile(v, F.lit(0.5))
    if kind == "zero_rate":
        return F.avg(F.when(v.isNotNull(), (v == 0).cast("int")))
    return {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}[kind](v)


def rolling(value: Column, kind: str, w, size: int, min_rows: int = 1, end: int = -1) -> Column:
    """Statistic over the `size` rows ending at offset `end` (-1: strictly before); NULL under `min_rows` values."""
    frame = w.rowsBetween(end - size + 1, end)
    full = F.count(value).over(frame) >= min_rows
    return F.when(full, stat(value, kind).over(frame))


def rolling_of(df: DataFrame, name: str, kind: str, w, size: int, min_rows: int = 1) -> Column:
    """`rolling` of a column up to the row before. Sums, means and zero rates of whole numbers are differences of running sums: the same values, at one step a row for any size."""
    value = F.col(name)
    if not isinstance(df.schema[name].dataType, T.IntegralType) or kind not in ("sum", "mean", "zero_rate"):
        return rolling(value, kind, w, size, min_rows)
    value = ((value == 0).cast("int") if kind == "zero_rate" else value).cast("long")
    now, old = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, -1 - size)
    total, n = (a.over(now) - F.coalesce(a.over(old), F.lit(0)) for a in (F.sum(value), F.count(value)))
    total = total.cast("double")
    return F.when(n >= F.lit(min_rows), total if kind == "sum" else total / F.when(n > 0, n))


# ---------------------------------------------------------------- sessions

def session_sequences(web: DataFrame, drop_bots: bool = True, seconds: int = 3600) -> DataFrame:
    """Events of each session in time order (event id on ties): rank, gaps, duration, funnel steps, conversion.

    Ranks and gaps are found inside time slices and completed with one carried row per slice, so a session of
    any length is spread over tasks.
    """
    require_columns(web, ("session_id", "event_timestamp", "event_type", "event_id"), "session sequences")
    d = (exclude_bots(web) if drop_bots else web).filter("session_id is not null and event_timestamp is not null")
    d = d.withColumn(CHUNK, time_chunk("event_timestamp", seconds)).withColumn("etape_entonnoir", map_step(F.col("event_type")))
    w = Window.partitionBy("session_id", CHUNK).orderBy("event_timestamp", "event_id")
    local = d.withColumn("_rank", F.row_number().over(w)).withColumn("_prev", F.lag("event_timestamp").over(w))
    before = carry_over(d, ["session_id"], {"_n": F.count(F.lit(1)), "_last": F.max("event_timestamp")},
                        lambda n: F.sum(n) if n == "_n" else F.max(n))
    first_client = F.min(F.when(F.col("client_key").isNotNull(), F.struct("event_timestamp", "event_id", "client_key"))).getField("client_key")
    stats = d.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_evenements_session"), F.min("event_timestamp").alias("_start"), F.max("event_timestamp").alias("_end"),
        F.max("etape_entonnoir").alias("etape_max_session"), first_client.alias("_client"))
    micros = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1000000.0)
    out = local.join(before, ["session_id", CHUNK], "left").join(stats, "session_id")
    prev = F.coalesce(F.col("_prev"), F.col("_last"))
    return (out.withColumn("rang_evenement", F.col("_rank") + F.coalesce(F.col("_n"), F.lit(0)))
            .withColumn("secondes_depuis_debut", micros(F.col("event_timestamp"), F.col("_start")))
            .withColumn("secondes_depuis_precedent", micros(F.col("event_timestamp"), prev))
            .withColumn("duree_session_secondes", micros(F.col("_end"), F.col("_start")))
            .withColumn("session_convertie", F.coalesce(F.col("etape_max_session") >= 4, F.lit(False)))
            .withColumn("session_authentifiee", F.col("_client").isNotNull())
            .withColumn("identite_effective", F.coalesce("_client", "anonymous_id"))
            .drop("_rank", "_prev", "_n", "_last", "_start", "_end", "_client", CHUNK))


def map_step(event_type: Column) -> Column:
    step = F.lit(None).cast("int")
    for name, rank in FUNNEL_STEPS.items():
        step = F.when(event_type == name, rank).otherwise(step)
    return step


def sessionize(events: DataFrame, key: str = "user_id", ts: str = "event_timestamp", tie: str = "event_id",
               gap_seconds: int = 1800, seconds: int = 86400) -> DataFrame:
    """Adds the running session number of each key: a session ends after an idle gap."""
    d = events.withColumn(CHUNK, time_chunk(ts, seconds))
    w = Window.partitionBy(key, CHUNK).orderBy(ts, tie)
    last = carry_over(d, [key], {"_last": F.max(ts)}, F.max)
    gaps = (d.withColumn("_prev", F.lag(ts).over(w)).join(last, [key, CHUNK], "left")
            .withColumn("_prev", F.coalesce("_prev", "_last")))
    idle = F.unix_micros(ts) - F.unix_micros("_prev") > gap_seconds * 1000000
    flagged = gaps.withColumn("_new", F.when(F.col("_prev").isNull() | idle, 1).otherwise(0)).drop("_last", "_prev", CHUNK)
    return (running_totals(flagged, [key], [F.col(ts), F.col(tie)], {"session_no": F.col("_new")}, seconds=seconds, ts=ts).drop("_new"))


def recent_intent(seq: DataFrame, cutoff: Column, hours: int = 24, k: int = 10) -> DataFrame:
    """Last k product events of each identity in [cutoff - hours, cutoff)."""
    w = Window.partitionBy("identite_effective").orderBy(F.desc("event_timestamp"), F.desc("event_id"))
    return (seq.filter((F.col("event_timestamp") < cutoff) & (F.col("event_timestamp") >= cutoff - F.expr(f"interval {hours} hours"))
                       & F.col("produit_key").isNotNull())
            .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
            .select("identite_effective", "produit_key", "event_timestamp", "event_type"))


# ---------------------------------------------------------------- series features

def lag_features(daily: DataFrame, key: str, lags: Sequence[int] = (1, 7, 14, 28), web: bool = True) -> DataFrame:
    w = series(key)
    cols = {f"y_lag{n}": F.lag("y", n).over(w) for n in lags}
    cols["y_ma28"] = rolling_of(daily, "y", "mean", w, 28, 7)
    cols |= {"dow": F.weekday("ds"), "month": F.month("ds"), "weekend": (F.weekday("ds") >= 5).cast("int"), "promo": F.col("remise_pct")}
    if web:
        cols |= {"stock_cut": F.lag("niveau_stock").over(w), "views_lag1": F.lag("view").over(w), "cart_lag1": F.lag("add_to_cart").over(w),
                 "views_ma7": rolling_of(daily, "view", "mean", w, 7)}
    return daily.withColumns(cols)


def rolling_features(daily: DataFrame, key: str = "unique_id", lags: Sequence[int] = (1, 2, 3, 7, 14, 21, 28, 56),
                     sizes: Sequence[int] = (7, 14, 28), diffs: Sequence[int] = (1, 7)) -> DataFrame:
    """Lags, differences and six statistics over several windows of the shifted series."""
    w = series(key)
    cols = {f"lag_{n}": F.lag("y", n).over(w) for n in lags}
    for size in sizes:
        for s in ("mean", "std", "min", "max", "median", "sum"):
            cols[f"roll_{s}_{size}"] = rolling(F.col("y"), s, w, size)
    for n in diffs:
        cols[f"diff_{n}"] = F.lag("y", 1).over(w) - F.lag("y", 1 + n).over(w)
    return daily.withColumns(cols)


def days_since_positive(df: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """Rows since the last positive value, the current one included; before the first one, row number."""
    w = series(key)
    d = df.withColumn("_rn", F.row_number().over(w))
    last = F.max(F.when(F.col(value) > 0, F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn(out, F.coalesce(F.col("_rn") - last, F.col("_rn"))).drop("_rn")


def running(w, measures: dict[str, Column]) -> dict[str, Column]:
    """Running sum and count of each measure, the current row included (columns _s_ and _c_)."""
    full = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {f"_{k}_{n}": (F.coalesce(F.sum(c).over(full), F.lit(0)) if k == "s" else F.count(c).over(full)) for n, c in measures.items() for k in "sc"}


def trailing(w, name: str, size: int) -> tuple[Column, Column]:
    """Sum and count of the last `size` rows of a measure, as differences of its running ones: one lag each instead of a frame."""
    return tuple(F.col(f"_{k}_{name}") - F.coalesce(F.lag(f"_{k}_{name}", size).over(w), F.lit(0)) for k in "sc")


def trailing_sums(daily: DataFrame, key: str, value: str, sizes: Sequence[int], prefix: str) -> DataFrame:
    """Mean, deviation and share of zeros of the last `size` rows, the current one included; null under max(3, size / 4) values.

    They come from running sums, which are exact for whole numbers.
    """
    w = series(key)
    y = F.col(value).cast("double")
    d = daily.withColumns(running(w, {"y1": y, "y2": y * y, "y0": (y == 0).cast("int")}))
    d = d.withColumns({f"_{m}{n}": trailing(w, m, n)[0] for n in sizes for m in ("y1", "y2", "y0")} | {f"_n{n}": trailing(w, "y1", n)[1] for n in sizes})
    stats = {}
    for n in sizes:
        count, total = F.col(f"_n{n}"), F.col(f"_y1{n}")
        variance = (F.col(f"_y2{n}") - total * total / count) / (count - 1)
        for s, c in {"mean": total / count, "std": F.when(count > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))), "zero_rate": F.col(f"_y0{n}") / count}.items():
            stats[f"{prefix}_{s}_{n}"] = F.when(count >= max(3, n // 4), c)
    return d.withColumns(stats).drop(*[f"_{k}_{m}" for k in "sc" for m in ("y1", "y2", "y0")], *[f"_{m}{n}" for n in sizes for m in ("y1", "y2", "y0", "n")])


def sales_at_cutoff(daily: DataFrame, key: str = "produit_key", lags: Sequence[int] = (1, 2, 3, 7, 14, 21, 28), sizes: Sequence[int] = (7, 28, 84)) -> DataFrame:
    """What the sales of a series alone tell at the end of each day: lags and trailing statistics, the current row included, and days per day with sales (`adi`)."""
    w = series(key)
    full = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = daily.withColumns({f"sales_lag_{n}": F.lag("y", n - 1).over(w) if n > 1 else F.col("y") for n in lags}
                          | {"observed_days": F.row_number().over(w), "adi": ratio(F.row_number().over(w), F.sum((F.col("y") > 0).cast("int")).over(full))})
    return trailing_sums(d, key, "y", sizes, "sales")


def with_order_statistics(batches: Iterator[pa.RecordBatch], key: int, value: int, sizes: Sequence[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Appends minimum, maximum and median of the last `size` rows of each series to rows that come by key and day.

    The ends of the series are windows into one array, in which each series is preceded by empty places; the last values of a batch are kept for the next one.
    """
    longest = max(sizes)
    tail, last = np.full(longest - 1, np.nan), None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, y = batch.column(key), batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
        new = np.r_[last is None or keys[0] != last, pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True).to_numpy(zero_copy_only=False).astype(bool)]
        part = np.cumsum(new) + (not new[0])
        at = np.arange(len(y)) + (longest - 1) * part
        padded = np.full(len(y) + (longest - 1) * part[-1], np.nan)
        padded[at] = y
        if not new[0]:
            padded[:longest - 1] = tail
        ends = np.lib.stride_tricks.sliding_window_view(padded, longest)[at - (longest - 1)]
        columns = []
        for n in sizes:
            order = np.sort(ends[:, longest - n:], axis=1)  # without a value, that is NaN, sorts last
            count = n - np.isnan(order).sum(axis=1)
            rows, few = np.arange(len(y)), count < max(3, n // 4)
            pick = lambda i: order[rows, np.maximum(i, 0)]
            columns += [pa.array(x, mask=few) for x in (order[:, 0], pick(count - 1), (pick((count - 1) // 2) + pick(count // 2)) / 2)]
        tail, last = padded[len(padded) - (longest - 1):], keys[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)


def trailing_statistics(daily: DataFrame, key: str, value: str, sizes: Sequence[int], prefix: str) -> DataFrame:
    """trailing_sums, and minimum, maximum and median of the same rows under the same rule.

    The order statistics need sorted windows, which as window functions would be sorted anew for each row and size by interpreted code; they are one pass of Arrow
    batches over rows that the window before has brought into order.
    """
    summed = trailing_sums(daily, key, value, sizes, prefix).sortWithinPartitions(key, "ds")
    fields = [T.StructField(f"{prefix}_{s}_{n}", T.DoubleType()) for n in sizes for s in ("min", "max", "median")]
    schema = T.StructType([*summed.schema.fields, *fields])
    at = [summed.columns.index(c) for c in (key, value)]
    made = summed.mapInArrow(lambda batches: with_order_statistics(batches, *at, sizes, schema.names), schema)
    kind = daily.schema[value].dataType
    return made.withColumns({f"{prefix}_{s}_{n}": F.col(f"{prefix}_{s}_{n}").cast(kind) for n in sizes for s in ("min", "max")})


def codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): number of each value in sorted order, from 0."""
    numbered = running_totals(df.select(column).filter(F.col(column).isNotNull()).distinct(), [], [F.col(column)], {out: F.lit(1)})
    return numbered.select(column, (F.col(out) - 1).cast("int").alias(out))


def cutoff_features(daily: DataFrame, key: str = "produit_key", lags: Sequence[int] = (1, 2, 3, 7, 14, 21, 28), sizes: Sequence[int] = (7, 14, 28, 56, 84),
                    web_lags: Sequence[int] = (1, 3, 7, 14, 28), products: DataFrame | None = None) -> DataFrame:
    """Features known at the end of each day: lags and windows include the current row.

    Category and brand means are computed on day totals of the group and joined back. Codes number products, categories and brands in sorted order. `products`
    (key, categorie, marque, valid_from), one row a product, gives the age of a product's version, and spares a pass over the days for the codes.
    """
    w = series(key)
    full = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = F.col("y")
    at = lambda c, n: F.lag(c, n - 1).over(w) if n > 1 else F.col(c)
    cols = {f"sales_lag_{n}": at("y", n) for n in lags} | {f"{p}_lag_{n}": at(c, n) for p, c in (("views", "view"), ("cart", "add_to_cart")) for n in web_lags}
    cols |= {"sales_cumulative": F.sum("y").over(full), "active_days_cumulative": F.sum((y > 0).cast("int")).over(full), "observed_days": F.row_number().over(w)}
    again = F.col("quantite_reapprovisionnee") > 0
    cols |= running(w, {"view": F.col("view"), "cart": F.col("add_to_cart"), "again": again.cast("int")})
    every = sorted({*sizes, 84})
    d = daily.repartition(key).withColumns(cols)
    last = {n: trailing(w, *n) for n in (("view", 28), ("view", 7), ("cart", 28), ("again", 84))}
    enough = lambda n, least, c: F.when(last[n][1] >= least, c)
    mean = lambda n, least: enough(n, least, last[n][0] / last[n][1])
    d = d.withColumns({"view_to_cart_28": ratio(enough(("cart", 28), 7, last["cart", 28][0]), enough(("view", 28), 7, last["view", 28][0])), "views_trend_7_28": mean(("view", 7), 3) - mean(("view", 28), 7),
                       "restock_frequency_84": mean(("again", 84), 14)}).drop(*[f"_{k}_{m}" for k in "sc" for m in ("view", "cart", "again")])
    d = days_since_positive(d, "quantite_reapprovisionnee", key, "days_since_restock")
    d = (d.withColumn("adi", ratio("observed_days", "active_days_cumulative"))
         .withColumn("intermittent", (F.coalesce(F.col("adi"), F.lit(0.0)) > 1.32).cast("int"))
         .withColumns({"stock_at_cutoff": F.col("niveau_stock"), "cutoff_dow": F.weekday("ds"), "cutoff_month": F.month("ds")}))
    d = trailing_statistics(d, key, "y", every, "sales")
    d = d.withColumn("cv2_84", F.pow(ratio("sales_std_84", "sales_mean_84"), 2))
    if 84 not in sizes:
        d = d.drop(*[f"sales_{s}_84" for s in ("mean", "std", "zero_rate", "min", "max", "median")])
    if products is not None:
        d = d.join(products.select(key, "valid_from"), key, "left").withColumn("version_age_days", F.greatest(F.datediff("ds", "valid_from"), F.lit(0))).drop("valid_from")
    for column, out in ((key, "product_code"), ("categorie", "category_code"), ("marque", "brand_code")):
        d = d.join(codes(daily if products is None else products, column, out), column, "left")
    # One pass over the days serves both groups.
    totals = materialise(daily.groupBy("categorie", "marque", "ds").agg(F.sum("y").alias("_t")))
    for group, prefix in (("categorie", "category"), ("marque", "brand")):
        total = totals.groupBy(group, "ds").agg(F.sum("_t").alias("_t"))
        gw = series(group)
        means = total.select(group, "ds", rolling(F.col("_t"), "mean", gw, 28, 7, end=0).alias(f"{prefix}_mean_28"),
                             F.avg("_t").over(gw.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"{prefix}_cumulative_mean"))
        d = d.join(means, [group, "ds"], "left")
    return d


def abc_rank_per_day(d: DataFrame, key: str = "produit_key") -> DataFrame:
    """Share of products ranked before each one on its day, by cumulated sales; top fifth flagged.

    The rank within a day runs over ranges of the sort key, so a day with very many products is split.
    """
    sizes = d.groupBy("ds").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(d, ["ds"], [-F.col("sales_cumulative"), F.col(key)], {"_pos": F.lit(1)})
    share = ratio(F.col("_pos") - 1, F.col("_n"))
    return (ranked.join(sizes, "ds").withColumn("abc_share_before", share)
            .withColumn("abc_a", (F.col("abc_share_before") < 0.2).cast("int")).drop("_pos", "_n"))


def horizon_frame(features: DataFrame, horizon: int, key: str = "unique_id") -> DataFrame:
    """Target and planned discount `horizon` days ahead with the calendar of the target day."""
    w = series(key)
    day = F.date_add("ds", horizon)
    return features.withColumns({
        "target": F.lead("y", horizon).over(w), "planned_discount": F.lead("remise_pct", horizon).over(w), "target_ds": day,
        "target_dow": F.weekday(day), "target_weekend": (F.weekday(day) >= 5).cast("int"), "target_month": F.month(day),
        "target_week": F.weekofyear(day), "target_month_start": (F.dayofmonth(day) == 1).cast("int"),
        "target_month_end": (F.last_day(day) == day).cast("int")})


def forward_sum(daily: DataFrame, key: str = "unique_id", size: int = 30) -> DataFrame:
    """Sum, mean and max over the next `size` rows; NULL when they are not all there."""
    frame = series(key).rowsBetween(1, size)
    full = F.count("y").over(frame) == size
    return daily.withColumns({f"{n}_{size}": F.when(full, f("y").over(frame)) for n, f in
                              (("target_sum", F.sum), ("target_mean", F.avg), ("target_max", F.max))})


def _since_flag(flag: Column, w) -> Column:
    """Days since the flag was last set before today; 0 on the day after it, NULL until then. Uses column _i."""
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    return F.col("_i") - 1 - F.max(F.when(flag, F.col("_i"))).over(earlier)


def stock_features(stock: DataFrame, key: str = "produit_key", rupture: float = 20, low: float = 50,
                   sizes: Sequence[int] = (7, 14, 28)) -> DataFrame:
    """Stock known before the sales of the day: yesterday's level and flags, ages and counts of past ruptures."""
    w = series(key)
    lag = F.lag("niveau_stock").over(w)
    d = stock.select(key, "ds", F.col("niveau_stock").alias("stock_fin_jour"), lag.alias("stock_disponible_lag1"), F.row_number().over(w).alias("_i"))
    d = d.withColumn("_out", F.col("stock_fin_jour") <= rupture)
    d = d.withColumn("_restock", F.coalesce(F.col("stock_fin_jour") > F.col("stock_disponible_lag1"), F.lit(False)))
    level = F.col("stock_disponible_lag1")
    return d.withColumns({
        "indicateur_rupture_lag1": (level <= rupture).cast("int"), "indicateur_stock_faible_lag1": (level <= low).cast("int"),
        "jours_depuis_derniere_rupture": _since_flag(F.col("_out"), w), "jours_depuis_dernier_reappro": _since_flag(F.col("_restock"), w),
        **{f"jours_rupture_lag_{n}": rolling(F.col("_out").cast("int"), "sum", w, n) for n in sizes}}).drop("_i", "_out", "_restock")


def stock_censorship(features: DataFrame) -> DataFrame:
    """1 when yesterday ended in rupture and nothing was sold today."""
    flag = (F.coalesce(F.col("indicateur_rupture_lag1"), F.lit(0)) == 1) & (F.col("y") == 0)
    return features.withColumn("jour_censure_stock", flag.cast("int"))


def stock_identity_residual(stock: DataFrame, key: str = "produit_key") -> DataFrame:
    prev = F.lag("niveau_stock").over(series(key))
    return stock.withColumn("residu", F.col("niveau_stock") - (prev - F.col("quantite_vendue") + F.col("quantite_reapprovisionnee")))


def daily_history(daily: DataFrame, measures: dict[str, str], key: str = "produit_key", lags: Sequence[int] = (1, 7, 28),
                  sizes: Sequence[int] = (7, 28, 84)) -> DataFrame:
    """Lags and means of each measure strictly before the day, ratios, restock frequency. `measures`: column -> prefix."""
    w = series(key)
    cols = {}
    for column, prefix in measures.items():
        cols |= {f"{prefix}_lag_{n}": F.lag(column, n).over(w) for n in lags}
        cols |= {f"{prefix}_mean_{n}": rolling_of(daily, column, "mean", w, n, max(3, n // 4)) for n in sizes}
    cols["historical_view_to_cart_28"] = ratio(rolling_of(daily, "add_to_cart", "sum", w, 28, 7), rolling_of(daily, "view", "sum", w, 28, 7))
    cols["stock_at_cutoff"] = F.lag("niveau_stock").over(w)
    daily = daily.withColumn("_restocked", (F.col("quantite_reapprovisionnee") > 0).cast("int"))
    cols["restock_frequency_84"] = rolling_of(daily, "_restocked", "mean", w, 84, 14)
    cols["sales_zero_rate_28"] = rolling_of(daily, "y", "zero_rate", w, 28, 7)
    return daily.withColumns(cols).drop("_restocked")


def segment_share(daily: DataFrame, segments: Sequence[str], key: str = "unique_id", size: int = 90, min_rows: int = 14) -> DataFrame:
    """Units of a loyalty segment over all units in the previous `size` rows."""
    w = series(key)
    total = sum((F.col(s) for s in segments[1:]), F.col(segments[0]))
    d = daily.withColumn("_total", total)
    den = rolling(F.col("_total"), "sum", w, size, min_rows)
    return d.withColumns({f"segment_share_{s}_{size}": ratio(rolling(F.col(s), "sum", w, size, min_rows), den) for s in segments}).drop("_total")


def promo_exposure(daily: DataFrame, promo_days: DataFrame, size: int = 90, min_rows: int = 14) -> DataFrame:
    """Scope flags, campaigns running in the category, and campaign days among the previous rows."""
    flags = promo_days.groupBy("produit_key", "ds").agg(
        F.max((F.col("portee") == "product").cast("int")).alias("product_campaign_active"),
        F.max((F.col("portee") == "category").cast("int")).alias("category_campaign_active"))
    concurrent = (promo_days.join(daily.select("produit_key", "categorie").distinct(), "produit_key")
                  .groupBy("categorie", "ds").agg(F.count_distinct("promo_key").alias("category_concurrent_promotions")))
    columns = ("product_campaign_active", "category_campaign_active", "category_concurrent_promotions")
    d = daily.join(flags, ["produit_key", "ds"], "left").join(concurrent, ["categorie", "ds"], "left")
    d = d.withColumns({c: F.coalesce(c, F.lit(0)) for c in columns})
    d = d.withColumn("campaign_active", F.greatest("product_campaign_active", "category_campaign_active"))
    return d.withColumn(f"past_campaign_exposure_{size}", rolling(F.col("campaign_active"), "sum", series("produit_key"), size, min_rows))


def prior_mean(df: DataFrame, keys: Sequence[str], prefix: str, value: str = "quantite") -> DataFrame:
    """Mean and count of all earlier days of the key; one row per key and day."""
    days = df.groupBy(*keys, "ds").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    w = series(keys).rowsBetween(Window.unboundedPreceding, -1)
    s, n = F.sum("_s").over(w), F.coalesce(F.sum("_n").over(w), F.lit(0))
    return days.select(*keys, "ds", ratio(s, n).alias(f"{prefix}_mean_before"), n.alias(f"{prefix}_n_before"))


def campaign_prior_features(sales: DataFrame, episodes: DataFrame, sizes: Sequence[int] = (7, 14, 28, 56, 84)) -> DataFrame:
    """Rolling quantity, orders and clients over the previous sale days (a row frame), looked up before the campaign start."""
    from marketlens.operators.ordered import asof_before
    daily = sales.groupBy("produit_key", "ds").agg(F.sum("quantite").alias("qty"), F.count_distinct("order_id").alias("orders"),
                                                   F.count_distinct("client_key").alias("clients"))
    w = series("produit_key")
    cols = {f"{c}_{n}d_before": rolling(F.col(c), "sum", w, n) for n in sizes for c in ("qty", "orders", "clients")}
    cols["last_sale_date"] = F.max(F.when(F.col("qty") > 0, F.col("ds"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    history = daily.withColumns(cols).withColumnRenamed("ds", "_seen")
    found = asof_before(episodes, history, ["produit_key"], "date_debut", "_seen", list(cols), seconds=86400 * 180)
    return (found.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols if c != "last_sale_date"})
            .withColumn("days_since_last_sale", F.coalesce(F.datediff("date_debut", "last_sale_date"), F.lit(999))).drop("_seen", "last_sale_date"))


def warmup_features(decisions: DataFrame, sales: DataFrame, span: DataFrame) -> DataFrame:
    """Mean over 28 and 84 days, lag 7 and zero rate, strictly before the decision day, on the dense day grid."""
    sold = sales.groupBy("produit_key", "ds").agg(F.sum("quantite").alias("y"))
    grid = dense_days(decisions.select("produit_key").distinct(), span, sold, ["produit_key"], {"y": 0})
    w = series("produit_key")
    y = F.col("y")
    d = grid.select("produit_key", "ds", rolling(y, "mean", w, 28, 7).alias("warmup_mean_28"), rolling(y, "mean", w, 84, 14).alias("warmup_mean_84"),
                    F.lag("y", 7).over(w).alias("warmup_lag_7"), rolling(y, "zero_rate", w, 28, 7).alias("warmup_zero_rate_28"))
    return decisions.join(d, ["produit_key", "ds"], "left")


def abc_class(df: DataFrame, key: str, value: str, a: float = 0.8, b: float = 0.95, share_before: bool = False) -> DataFrame:
    """A/B/C by cumulated share in descending order; `share_before` tests the share before the item (A only)."""
    total = df.agg(F.sum(value)).scalar()
    cum = running_totals(df, [], [-F.col(value), F.col(key)], {"_cum": F.col(value)})
    if share_before:
        share = ratio(F.col("_cum") - F.col(value), F.greatest(total, F.lit(1)))
        return cum.withColumn("share_before", share).withColumn("abc_a", F.col("share_before") < a).drop("_cum")
    share = ratio("_cum", total)
    return (cum.withColumn("part_cumulee", share)
            .withColumn("classe_abc", F.when(share <= a, "A").when(share <= b, "B").otherwise("C")).drop("_cum"))


def promo_runs(panel: DataFrame, key: str = "produit_key") -> DataFrame:
    """Runs of consecutive rows in promotion per product: start, end, length, first discount."""
    w = series(key)
    flag = F.col("en_promotion").cast("int")
    d = panel.withColumn("_change", F.coalesce((flag != F.lag(flag).over(w)).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return (d.filter("en_promotion").groupBy(key, "_run")
            .agg(F.min("ds").alias("debut"), F.max("ds").alias("fin"), F.count(F.lit(1)).alias("duree"), F.min_by("remise_pct", "ds").alias("remise"))
            .drop("_run"))


def rupture_runs(stock: DataFrame, threshold: float = 0, key: str = "produit_key") -> DataFrame:
    """Lengths of runs of consecutive rows at or under the threshold."""
    flagged = stock.withColumn("en_promotion", F.col("niveau_stock") <= threshold).withColumn("remise_pct", F.lit(0))
    return promo_runs(flagged, key).select(key, "debut", "duree")


def calendar_gaps(df: DataFrame, day: str = "ds", min_gap: int = 2) -> DataFrame:
    """Holes between distinct days (a calendar, not the rows)."""
    w = Window.orderBy(day)
    d = df.select(day).distinct().withColumn("debut_trou", F.lag(day).over(w)).withColumn("_gap", F.datediff(day, "debut_trou"))
    return d.filter(F.col("_gap") > min_gap).select("debut_trou", F.col(day).alias("fin_trou"), (F.col("_gap") - 1).alias("jours_sans_vente"))


def weekly_rolling_popularity(sales: DataFrame, products: DataFrame, span: DataFrame, size: int = 4) -> DataFrame:
    """Units of the previous `size` weeks, per product and Monday week, on the dense week grid."""
    sold = sales.groupBy("produit_key", F.trunc("ds", "week").alias("wk")).agg(F.sum("quantite").alias("u"))
    grid = dense_days(products.select("produit_key"), span, sold, ["produit_key"], {"u": 0}, day="wk", step_days=7)
    return grid.withColumn("popularite", F.coalesce(rolling(F.col("u"), "sum", series("produit_key", "wk"), size), F.lit(0.0))).drop("u")


def week_index(df: DataFrame, day: str = "ds", n_windows: int = 6) -> DataFrame:
    """Week number since the first day, its dense rank, and the evaluation window it falls in.

    Weeks are ranked on the distinct weeks (a calendar), then joined back.
    """
    first = df.agg(F.min(day)).scalar()
    d = df.withColumn("semaine_index", F.floor(F.datediff(day, first) / 7).cast("int"))
    weeks = d.select("semaine_index").distinct()
    w = Window.orderBy("semaine_index")
    ranked = weeks.select("semaine_index", F.dense_rank().over(w).alias("semaine_rang"), F.ntile(n_windows).over(w).alias("fenetre"))
    return d.join(F.broadcast(ranked), "semaine_index")


# fixed values: feasts with a commercial effect and the (accent-free) texts that name them
MAJOR_EVENTS = {"korite": ["korite"], "tabaski": ["tabaski"], "magal": ["magal"], "maouloud": ["maouloud"], "tamxarit": ["tamxarit"],
                "noel": ["noel"], "nouvel_an": ["jour de l'an"], "independance": ["independance"]}


def calendar_features(dates: DataFrame, holidays: DataFrame, before: int = 7, after: int = 3, ramadan_days: int = 30) -> DataFrame:
    """Date parts, month and quarter edges, cyclic codes, distances to holidays, feast windows, Ramadan.

    `holidays`: ds, nom_ferie, fete_estimee. Both inputs are calendars (a few thousand days at most), so the
    ordered windows and the broadcast of feast days stay small whatever the size of the facts.
    """
    d = dates.select("ds").filter("ds is not null").distinct()
    dow, dom, doy = F.weekday("ds"), F.dayofmonth("ds"), F.dayofyear("ds")
    last = F.dayofmonth(F.last_day("ds"))
    q_start = (F.trunc("ds", "quarter") == F.col("ds"))
    q_end = (F.last_day(F.add_months(F.trunc("ds", "quarter"), 2)) == F.col("ds"))
    two_pi = F.lit(2.0) * F.pi()
    d = d.withColumns({
        "jour_semaine": dow, "jour_mois": dom, "jour_annee": doy, "semaine": F.weekofyear("ds"), "mois": F.month("ds"), "trimestre": F.quarter("ds"),
        "annee": F.year("ds"), "est_weekend": (dow >= 5).cast("int"), "est_samedi": (dow == 5).cast("int"), "est_dimanche": (dow == 6).cast("int"),
        "debut_mois": (dom == 1).cast("int"), "fin_mois": (dom == last).cast("int"), "debut_trimestre": q_start.cast("int"), "fin_trimestre": q_end.cast("int"),
        "debut_mois_5j": (dom <= 5).cast("int"), "fin_mois_5j": (dom > last - 5).cast("int"),
        "sin_jour_semaine": F.sin(two_pi * dow / 7), "cos_jour_semaine": F.cos(two_pi * dow / 7),
        "sin_jour_annee": F.sin(two_pi * doy / 365.25), "cos_jour_annee": F.cos(two_pi * doy / 365.25)})
    named = holidays.withColumn("_norm", strip_accents_lower(F.regexp_replace("nom_ferie", "’", "'")))
    one = named.groupBy("ds").agg(F.min(F.struct("nom_ferie", "fete_estimee")).alias("_h"))
    d = (d.join(F.broadcast(one), "ds", "left").withColumn("est_ferie", F.col("_h").isNotNull().cast("int"))
         .withColumn("ferie_estime", F.coalesce(F.col("_h.fete_estimee"), F.lit(False)).cast("int"))
         .withColumn("nom_ferie", F.coalesce(F.col("_h.nom_ferie"), F.lit(""))).drop("_h"))
    days = named.agg(F.array_sort(F.collect_set("ds"))).scalar()
    gap = lambda arr, keep: F.filter(F.transform(arr, lambda h: F.datediff(F.col("ds"), h)), keep)
    d = d.withColumn("_days", days)
    d = (d.withColumn("jours_depuis_ferie", F.coalesce(F.array_min(gap(F.col("_days"), lambda g: g >= 0)), F.lit(999)))
         .withColumn("jours_avant_ferie", F.coalesce(-F.array_max(gap(F.col("_days"), lambda g: g <= 0)), F.lit(999))))
    is_event = {e: F.lit(False) for e in MAJOR_EVENTS}
    for e, texts in MAJOR_EVENTS.items():
        for text in texts:
            is_event[e] = is_event[e] | F.contains(F.col("_norm"), F.lit(text))
    feasts = named.agg(F.struct(*[F.collect_set(F.when(c, F.col("ds"))).alias(e) for e, c in is_event.items()])).scalar()
    d = d.withColumn("_feasts", feasts)
    out = {}
    for e in MAJOR_EVENTS:
        arr = F.col(f"_feasts.{e}")
        delta = F.transform(arr, lambda h: F.datediff(F.col("ds"), h))
        out[f"est_{e}"] = F.exists(delta, lambda x: x == 0).cast("int")
        out[f"avant_{e}"] = F.exists(delta, lambda x: (x < 0) & (x >= -before)).cast("int")
        out[f"apres_{e}"] = F.exists(delta, lambda x: (x > 0) & (x <= after)).cast("int")
    until = F.array_min(F.filter(F.transform(F.col("_feasts.korite"), lambda h: F.datediff(h, F.col("ds"))), lambda x: (x >= 1) & (x <= ramadan_days)))
    out["jour_ramadan"] = F.coalesce(ramadan_days + 1 - until, F.lit(0))
    d = d.withColumns(out)
    return (d.withColumn("est_ramadan", (F.col("jour_ramadan") > 0).cast("int"))
            .withColumn("fin_ramadan", (F.col("jour_ramadan") >= ramadan_days - 6).cast("int")).drop("_days", "_feasts"))


def best_promo_per_day(promo_days: DataFrame) -> DataFrame:
    """Largest discount of the day wins (ties: smallest key); the number of concurrent promotions is kept."""
    best = F.min(F.struct(-F.col("remise_pct"), F.col("promo_key"), F.col("portee")))
    return (promo_days.groupBy("produit_key", "ds").agg(best.alias("_b"), F.count(F.lit(1)).alias("n_promotions"), F.max("remise_pct").alias("remise_pct"))
            .select("produit_key", "ds", F.lit(1).alias("en_promotion"), "remise_pct", "n_promotions", F.col("_b.portee").alias("portee_promo")))


def weekly_panel(sales: DataFrame, products: DataFrame, pairs: DataFrame) -> DataFrame:
    """Product x Monday week on the full calendar: units, revenue, mean campaign discount, 4-week average of the past."""
    sold = sales.groupBy("produit_key", F.trunc("ds", "week").alias("wk")).agg(F.sum("quantite").alias("qty"), F.round(F.sum("montant_net"), 4).alias("ca"))
    span = sales.agg(F.trunc(F.min("ds"), "week").alias("lo"), F.max("ds").alias("hi"))
    grid = dense_days(products.select("produit_key"), span, sold, ["produit_key"], {"qty": 0, "ca": 0.0}, day="wk", step_days=7)
    weeks = explode_days(pairs, F.trunc("date_debut", "week"), F.trunc("date_fin", "week"), "wk", 7)
    promo = weeks.groupBy("produit_key", "wk").agg(F.avg("remise_pct").alias("remise_ponderee"))
    w = series("produit_key", "wk")
    return (grid.join(promo, ["produit_key", "wk"], "left").withColumn("remise_ponderee", F.coalesce("remise_ponderee", F.lit(0.0)))
            .withColumn("pred_ma4", F.coalesce(rolling(F.col("qty"), "mean", w, 4), F.lit(0.0))))


def tail_zero_run(daily: DataFrame, key: str = "unique_id") -> DataFrame:
    """Days after the last sale of each series up to the last day of the data."""
    end = daily.agg(F.max("ds")).scalar()
    return daily.groupBy(key).agg(F.max(F.when(F.col("y") > 0, F.col("ds"))).alias("derniere_vente")) \
        .withColumn("jours_sans_vente_fin", F.datediff(end, "derniere_vente"))


def robust_z_days(daily_total: DataFrame, value: str = "y", threshold: float = 3.0) -> DataFrame:
    """Days whose robust z score exceeds the threshold; the two medians are exact."""
    med = exact_quantiles(daily_total, [], value, {"m": 0.5}).scalar()
    dev = daily_total.withColumn("_dev", F.abs(F.col(value) - med))
    mad = exact_quantiles(dev, [], "_dev", {"m": 0.5}).scalar()
    z = ratio(F.lit(0.6745) * (F.col(value) - med), mad)
    return daily_total.withColumn("z_robuste", z).filter(F.abs("z_robuste") > threshold)
