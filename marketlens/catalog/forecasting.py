"""Demand forecasting."""
import datetime as dt

from pyspark.sql import functions as F

from marketlens.catalog.base import digest, digest_sql, query
from marketlens.catalog.windows import LAGF, features_sql  # noqa: F401
from marketlens.functions.scalar import r
from marketlens.operators import aggregates as A
from marketlens.operators import joins as J
from marketlens.operators import windows as W
from marketlens.plans import forecast as P

BACKS = (120, 90, 60, 30)


def windows(t):
    return P.backtest_windows(t.spark, t.sales_span.first()["hi"], BACKS)


def backtest(t):
    """Naive family on four 30-day windows of the brand-day grid."""
    return P.backtest_naive(t.brand_days, windows(t))


BT = """mx as (select max(ds) as m from brand_days), wn as (select i as "window", m - b + 1 as start from mx, (values (1, 120), (2, 90), (3, 60), (4, 30)) v(i, b)),
bt as (select b.unique_id, b.ds, b.y, "window", (b.ds - start + 1)::int as h, n.y::double as naive, s.y::double as seasonal_naive7, m.v as moving_average28 from wn join brand_days b on b.ds between start and start + 29
  join brand_days n on n.unique_id = b.unique_id and n.ds = start - 1 join brand_days s on s.unique_id = b.unique_id and s.ds = start - 7 + ((b.ds - start) % 7)::int
  join (select unique_id, "window" as w2, avg(y) as v from brand_days, wn where ds between start - 28 and start - 1 group by 1, 2) m on m.unique_id = b.unique_id and m.w2 = "window")"""


@query("for1_naive_family", """
with mx as (select max(ds) as m from daily), wn as (select i as "window", m - b + 1 as start from mx, (values (1, 120), (2, 90), (3, 60), (4, 30)) v(i, b)),
ma as (select produit_key, "window", avg(y) as v from daily, wn where ds between start - 28 and start - 1 group by 1, 2)
select b.produit_key, b.ds, b.y, wn."window", (b.ds - start + 1)::int as h, n.y::double as naive, s.y::double as seasonal_naive7, v as moving_average28
from wn join daily b on b.ds between start and start + 29 join daily n on n.produit_key = b.produit_key and n.ds = start - 1
  join daily s on s.produit_key = b.produit_key and s.ds = start - 7 + ((b.ds - start) % 7)::int join ma on ma.produit_key = b.produit_key and ma."window" = wn."window" """)
def _(t):
    days = t.product_days.select("produit_key", "ds", "y")
    return P.backtest_naive(days, P.backtest_windows(t.spark, t.stock.agg(F.max("ds")).first()[0], BACKS), "produit_key")


@query("for2_signal_baselines", """
with d as (select produit_key, ds, y, en_promotion, isodow(ds)::int - 1 as dow from panel), tr as (select * from d where ds < date '2001-01-01'), te as (select * from d where ds >= date '2001-01-01'), la as (select max(ds) as l from tr),
pm as (select produit_key, avg(y) m, arg_max(y, ds)::double as v, avg(y) filter (ds >= l - 27) as r from tr, la group by 1), pd2 as (select produit_key, dow, avg(y) m, max(y) filter (ds > l - 7) as w from tr, la group by 1, 2),
up as (select avg(y) filter (en_promotion) / avg(y) filter (not en_promotion) as u, avg(y) as g from tr)
select te.produit_key, ds, 0.0::double as zero, g as global, coalesce(pm.m, g) as product, coalesce(pd2.m, pm.m, g) as product_weekday, coalesce(pm.r, g) as mean28, coalesce(pm.v, 0)::double as naive, coalesce(pd2.w, pm.m, 0)::double as seasonal_naive7,
  coalesce(pd2.m, pm.m, g) * case when en_promotion then u else 1.0 end as weekday_promo
from te, up left join pm on pm.produit_key = te.produit_key left join pd2 on pd2.produit_key = te.produit_key and pd2.dow = te.dow""")
def _(t):
    from marketlens.plans.baselines import SIGNALS, signal_baselines
    d = t.panel.withColumn("dow", F.weekday("ds"))
    cut = F.lit("2001-01-01").cast("date")
    return signal_baselines(d.filter(F.col("ds") < cut), d.filter(F.col("ds") >= cut)).select("produit_key", "ds", *SIGNALS)


def _train(t):
    return t.brand_days.filter("ds < date '2001-06-01'")


def _levels(t, level):
    """Levels of all products over all days of the sales before June 2001."""
    lo = t.sales.agg(F.min("ds")).first()[0]
    return level(t.confirmed.select("produit_key", "ds", F.col("quantite").alias("y")), "produit_key", (lo, dt.date(2001, 5, 31)), t.products)


SOLD = """
with recursive lo as (select min(ds) as d from sales), sd as (select produit_key, (ds - d)::int as i, y::double as y, row_number() over (partition by produit_key order by ds) as k from pday, lo where ds < date '2001-06-01' and y > 0),
n as (select (date '2001-06-01' - d)::int as n from lo)"""


@query("for3_croston_level", SOLD + """,
f as (select produit_key, a, k, i as last, y as q, (i + 1)::double as p, y as err from sd, (values (0.1::double), (0.2), (0.3), (0.5), (0.7)) v(a) where k = 1
  union all select produit_key, a, k + 1, i, a * y + (1 - a) * q, a * (i - last) + (1 - a) * p, err + (i - last - 1) * fit + abs(fit - y)
  from (select f.*, sd.i, sd.y, q / greatest(p, 1) as fit from f join sd on sd.produit_key = f.produit_key and sd.k = f.k + 1)),
e as (select produit_key, a, last, q / greatest(p, 1) as level, err from f qualify k = max(k) over (partition by produit_key, a)),
b as (select produit_key, arg_min(level, (l, a)) as level, arg_min(a, (l, a)) as alpha, min(l) as loss from (select *, round((err + (n - 1 - last) * level) / n, 9) as l from e, n) group by 1)
select produit_key, coalesce(round(level, 6), 0.0) as croston, coalesce(alpha, 0.1) as alpha, coalesce(round(loss, 6), 0.0) as loss from products left join b using (produit_key)""")
def _(t):
    return _levels(t, P.croston_level).withColumns({c: F.round(c, 6) for c in ("croston", "loss")})


@query("for4_tsb_level", SOLD + """,
g as (select (row_number() over (order by a, b))::int as g, a, b from (values (0.1::double), (0.3), (0.5)) x(a), (values (0.1::double), (0.3), (0.5)) z(b)),
f as (select produit_key, g, a, b, 0::bigint as k, -1 as last, y as q, 1.0::double as p, 0.0::double as err from sd, g where k = 1
  union all select produit_key, g, a, b, k + 1, i, a * y + (1 - a) * q, b + (1 - b) * p * pow(1 - b, i - last - 1), err + q * p * (1 - pow(1 - b, i - last - 1)) / b + abs(q * p * pow(1 - b, i - last - 1) - y)
  from (select f.*, sd.i, sd.y from f join sd on sd.produit_key = f.produit_key and sd.k = f.k + 1)),
e as (select produit_key, g, q * p * pow(1 - b, n - 1 - last) as level, round((err + q * p * (1 - pow(1 - b, n - 1 - last)) / b) / n, 9) as l from f, n qualify k = max(k) over (partition by produit_key, g)),
c as (select produit_key, arg_min(level, (l, g)) as level, min(l) as loss from e group by 1)
select produit_key, coalesce(round(level, 6), 0.0) as tsb, coalesce(round(loss, 6), 0.0) as loss from products left join c using (produit_key)""")
def _(t):
    return _levels(t, P.tsb_level).withColumns({c: F.round(c, 6) for c in ("tsb", "loss")})


@query("for5_ets_damped", """
with recursive d as (select produit_key, y::double as y, (ds - date '2000-12-31')::int as k from daily where ds < date '2001-06-01'),
w as (select produit_key, avg(y) filter (k <= 7) as m1, avg(y) filter (k between 8 and 14) as m2, list(y order by k) filter (k <= 7) as ys from d group by 1),
s as (select produit_key, i, a, b, c, 0 as k, m1 as l, (m2 - m1) / 7 as t, list_transform(ys, lambda x : x - m1) as s from w, (values (0, 0.1::double, 0.05::double, 0.1::double), (1, 0.2, 0.1, 0.2), (2, 0.4, 0.1, 0.3)) v(i, a, b, c)
  union all select produit_key, i, a, b, c, k + 1, level, b * (level - l) + (1 - b) * 0.98::double * t, s[2:7] || [c * (y - level) + (1 - c) * s[1]]
  from (select s.*, d.y, a * (d.y - s[1]) + (1 - a) * (l + 0.98::double * t) as level from s join d on d.produit_key = s.produit_key and d.k = s.k + 1)),
pa as (select produit_key, i, s.k, h, l + 0.98::double * (1 - pow(0.98::double, h)) / (1 - 0.98::double) * t + s[1 + (h - 1) % 7] as f from s, range(1, 31) r(h) where s.k in (123, 151)),
ls as (select produit_key, i, round(avg(abs(f - y)), 9) as loss from pa join d using (produit_key) where pa.k = 123 and d.k = 123 + h group by 1, 2),
ch as (select produit_key, arg_min(i, (loss, i)) as i from ls group by 1)
select produit_key, i as params, h::int as h, round(greatest(f, 0), 6) as ets from ch join pa using (produit_key, i) where k = 151""")
def _(t):
    days = t.product_days.filter("ds < date '2001-06-01'").select("produit_key", "ds", "y")
    return P.ets_forecast(days, key="produit_key").withColumn("ets", F.round("ets", 6))


def _features(t):
    return W.lag_features(t.brand_days, "unique_id", web=False)


@query("for6_recursive_forecast")
def _(t):
    train = _train(t)
    coefficients, intercept = P.fit_linear(W.lag_features(train, "unique_id", web=False))
    return P.recursive_forecast(train, 30, coefficients, intercept)


AT_CUTOFF = [f"sales_lag_{n}" for n in (1, 2, 3, 7, 14, 28)] + [f"sales_{s}_{n}" for n in (7, 28, 84) for s in ("mean", "std", "zero_rate")] + ["adi", "observed_days"]


def _cutoffs(t):
    """Sales of each product known at the end of each day, and the discount of the promotion calendar: the discount of a sale would tell that there is one."""
    planned = W.best_promo_per_day(J.expand_promotions(t.promotions, t.products)).select("produit_key", "ds", "remise_pct")
    days = t.product_days.drop("remise_pct").join(planned, ["produit_key", "ds"], "left").withColumn("remise_pct", F.coalesce("remise_pct", F.lit(0)))
    return W.sales_at_cutoff(days)


@query("for7_direct_forecast")
def _(t):
    return P.direct_forecast(_cutoffs(t), AT_CUTOFF, dt.date(2001, 5, 30), settings=((10, 3), (10, 4)), key="produit_key")


@query("for8_stacked_forecast")
def _(t):
    return P.stacked_forecast(_features(t), ["y_lag1", "y_lag7", "y_ma28", "dow"], "2001-06-01")


@query("for8_stacked_horizon_frame", """
with f as (select * from brand_days where (ds - (select min(ds) from brand_days)) % 14 = 0), x as (select f.unique_id, f.ds, h as horizon, f.ds + h::int as target_ds from f, range(1, 31) r(h) where f.ds + h::int < date '2001-05-01')
select x.unique_id, horizon::int as horizon, count(*) as n, sum(b.y)::bigint as target, sum(b.remise_pct)::bigint as planned, min(x.ds) as first_ds, max(x.target_ds) as last_target from x join brand_days b on b.unique_id = x.unique_id and b.ds = x.target_ds group by 1, 2""")
def _(t):
    s = P.stacked_horizon_frame(t.brand_days.select("unique_id", "ds", "y", "remise_pct"), F.lit("2001-05-01").cast("date"))
    return s.groupBy("unique_id", "horizon").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("target"), F.sum("planned_discount").alias("planned"), F.min("ds").alias("first_ds"), F.max("target_ds").alias("last_target"))


@query("for9_cumulative_30d_model")
def _(t):
    f = W.forward_sum(_features(t))
    train = f.filter("date_add(ds, 30) < date '2001-05-01' and y_lag28 is not null")
    test = f.filter("ds = date '2001-05-01'").withColumn("target_sum_30", F.coalesce("target_sum_30", F.lit(0)))
    return P.cumulative_model(train, test, ["y_lag1", "y_lag7", "y_ma28", "month"]).select("unique_id", "ds", F.col("target_sum_30").alias("y"), "pred")


def _hurdle(t):
    f = _features(t).filter("y_lag28 is not null")
    return P.hurdle(f.filter("ds < date '2001-05-01'"), f.filter("ds >= date '2001-05-01'"), ["y_lag1", "y_lag7", "y_ma28", "dow", "promo"])


@query("for10_hurdle")
def _(t):
    return _hurdle(t).select("unique_id", "ds", "y", "prob", "pred")


@query("for10_hurdle_scores", """
with d as (select y, (1 + remise_pct) / 13.0::double as prob from brand_days), l as (select prob, count(case when y > 0 then 1 end) h, count(*) n from d group by 1), c as (select h, sum(h) over (order by prob desc) ch, sum(n) over (order by prob desc) cn from l)
select round(avg(pow(prob - (y > 0)::int, 2)), 8) as brier, round(avg(-((y > 0)::int * ln(prob) + (1 - (y > 0)::int) * ln(1 - prob))), 8) as log_loss, count(*) as n, (select round(sum(h * ch / cn) / sum(h), 8) from c) as pr_auc from d""")
def _(t):
    d = t.brand_days.withColumn("prob", (1 + F.col("remise_pct")) / F.lit(13.0))
    s = P.probability_scores(d)
    return s.select(F.round("brier", 8).alias("brier"), F.round("log_loss", 8).alias("log_loss"), "n").withColumn("pr_auc", F.round(P.average_precision(d).scalar(), 8))


@query("for10_decile_calibration", """
select least(floor((1 + remise_pct) / 13.0::double * 10), 9)::int as decile, round(avg((1 + remise_pct) / 13.0::double), 8) as p_moyenne, avg((y > 0)::int) as taux, count(*) as n from brand_days group by 1""")
def _(t):
    return P.decile_calibration(t.brand_days.withColumn("prob", (1 + F.col("remise_pct")) / F.lit(13.0))).withColumn("p_moyenne", F.round("p_moyenne", 8))


def pair(t):
    return backtest(t).withColumnRenamed("seasonal_naive7", "pred_a").withColumnRenamed("moving_average28", "pred_b")


GRID = "gw as (select unique_id, \"window\", w, sum(y) y, sum(greatest(w * seasonal_naive7 + (1 - w) * moving_average28, 0)) p from bt, (values (0.0::double), (0.25), (0.5), (0.75), (1.0)) v(w) group by all), ge as (select \"window\", w, sum(abs(p - y)) e, sum(y) y from gw group by 1, 2)"
CHOSEN = """ch as (select c."window", coalesce(arg_min(g.w, (g.s, g.w)), 0.5) as weight, min(g.s) as wape_passee from wn c left join (select c2."window" as cw, w, round(sum(e) / sum(y), 10) s from ge join wn c2 on ge."window" < c2."window" group by 1, 2) g on g.cw = c."window" group by 1)"""


@query("for11_blend_weights", f"with {BT}, {GRID}, {CHOSEN} select \"window\", weight, wape_passee from ch")
def _(t):
    return P.blend_weights(pair(t))


@query("for11_blend", f"""
with {BT}, {GRID}, {CHOSEN} select unique_id, ds, "window", y, round(greatest(weight * seasonal_naive7 + (1 - weight) * moving_average28, 0), 8) as y_pred from bt join ch using ("window")""")
def _(t):
    f = pair(t)
    return P.blend(f, P.blend_weights(f)).select("unique_id", "ds", "window", "y", F.round("y_pred", 8).alias("y_pred"))


def segments(t):
    """ABC class, demand profile and zero rate of each brand before each window."""
    out = None
    for i, start, _ in windows(t).collect():
        train = t.brand_days.filter(F.col("ds") < F.lit(start))
        f = A.series_features(train)
        c = A.classify_demand(f).select("unique_id", "classe_abc", "profil_demande", "taux_jours_sans_vente").withColumn("window", F.lit(i))
        out = c if out is None else out.unionByName(c)
    return out


SEG = """sx as (select unique_id, "window", 1 - count(case when y > 0 then 1 end) / count(*) as taux_jours_sans_vente, count(*) / count(case when y > 0 then 1 end) as adi, pow(stddev_samp(case when y > 0 then y end) / avg(case when y > 0 then y end), 2) as cv2, round(sum(ca), 4) as ca
  from brand_days, wn where ds < start group by 1, 2),
sg as (select *, case when adi < 1.32 and cv2 < 0.49 then 'regulier' when adi >= 1.32 and cv2 < 0.49 then 'intermittent' when adi < 1.32 then 'erratique' else 'grumeleux' end as profil_demande,
  case when sum(ca) over (partition by "window" order by ca desc, unique_id) / sum(ca) over (partition by "window") <= 0.8 then 'A' when sum(ca) over (partition by "window" order by ca desc, unique_id) / sum(ca) over (partition by "window") <= 0.95 then 'B' else 'C' end as classe_abc from sx),
ce as (select unique_id, "window", abs(sum(seasonal_naive7) - sum(y)) ea, abs(sum(moving_average28) - sum(y)) eb from bt group by 1, 2)"""


@query("for12_segment_b1", f"with {BT}, {SEG} select unique_id, \"window\", case when taux_jours_sans_vente > 0.45 then 'b' else 'a' end as choix from sg")
def _(t):
    return P.select_b1(segments(t), 0.45)


@query("for12_segment_b2", f"""
with {BT}, {SEG}, g as (select classe_abc, profil_demande, "window", sum(ea) ea, sum(eb) eb, count(*) n from ce join sg using (unique_id, "window") group by 1, 2, 3),
ru as (select classe_abc, profil_demande, w."window", case when sum(n) >= 10 and round(sum(eb), 6) < round(sum(ea), 6) then 'b' else 'a' end as choix from g join wn w on g."window" < w."window" group by 1, 2, 3)
select unique_id, "window", coalesce(choix, 'a') as choix from sg left join ru using (classe_abc, profil_demande, "window")""")
def _(t):
    return P.select_b2(pair(t), segments(t), 10)


@query("for12_segment_b3", f"""
with {BT}, {SEG}, c as (select *, sum(ea) over w sa, sum(eb) over w sb, count(*) over w n from ce window w as (partition by unique_id order by "window" rows between unbounded preceding and 1 preceding))
select unique_id, "window", case when n >= 2 and round((sa - sb) / sa, 9) >= 0.1 then 'b' else 'a' end as choix from c""")
def _(t):
    return P.select_b3(pair(t))


@query("for13_expanding_ensemble", f"""
with {BT}, g as (select unique_id, "window", c, w, sum(y) y, sum(w * seasonal_naive7 + (1 - w) * case c when 1 then naive else moving_average28 end) p from bt, (values (1), (2)) k(c), (values (0.0::double), (0.25), (0.5), (0.75), (1.0)) v(w) group by all),
e as (select "window", c, w, sum(abs(p - y)) e, sum(y) y from g group by 1, 2, 3), s as (select x."window", c, w, round(sum(e) / sum(y), 10) s from e join wn x on e."window" < x."window" group by 1, 2, 3),
b as (select "window", arg_min(c, (s, c, w)) c, arg_min(w, (s, c, w)) w from s group by 1)
select "window", case when c = 1 then 'naive' else 'pred_b' end as candidate, coalesce(w, 0.5) as direct_weight from wn left join b using ("window")""")
def _(t):
    return P.expanding_ensemble(pair(t), ["naive", "pred_b"], ("pred_b", 0.5))


@query("for14_fallback_classifier", f"""
with {BT}, raw as (select unique_id, ds, "window", 'WindowAverage28' as model, substr(unique_id, 7)::int as k, case when substr(unique_id, 7)::int % 4 = 1 then null else moving_average28 end as y_pred_raw from bt),
c as (select *, case when k % 7 = 0 then 0 when k % 4 = 1 and k % 3 = 0 then 20 else 100 end as n from raw),
d as (select *, n = 0 as cold, k % 5 = 2 and "window" = 2 as exc, k % 5 = 3 and "window" = 3 as bud from c)
select unique_id, ds, "window", case when cold then 'cold_start_fallback' when exc then 'exception_fallback' when bud then 'budget_fallback' when y_pred_raw is null then 'success_invalid_prediction_fallback' else 'success_valid_prediction' end as status,
  case when cold then 'ColdStartZero' when exc or bud then 'Naive' when y_pred_raw is null and n < 28 then 'AvailableHistoryAverage' when y_pred_raw is null then 'Naive' else model end as model_effective,
  case when cold then 0.0 when exc or bud then coalesce(y_pred_raw, 0.0) when y_pred_raw is null and n < 28 then 12.5 when y_pred_raw is null then 7.0 else y_pred_raw end::double as y_pred_final,
  case when cold then 'produit_absent_du_train' when exc then 'exception: boom' when bud then 'budget_temps_depasse' when y_pred_raw is null and n < 28 then 'window_average_historique_insuffisant(n=20<28)' when y_pred_raw is null then 'prediction_non_finie_repli_naive(n=100)' end as fallback_reason from d""")
def _(t):
    k = F.substring("unique_id", 7, 3).cast("int")
    bt = backtest(t)
    raw = bt.select("unique_id", "ds", "y", F.when(k % 4 != 1, F.col("moving_average28")).alias("y_pred_raw"), F.lit("WindowAverage28").alias("model"), "window")
    keys = bt.select("unique_id", "window").distinct()
    n = F.when(k % 7 == 0, 0).when((k % 4 == 1) & (k % 3 == 0), 20).otherwise(100)
    ctx = keys.select("unique_id", "window", n.alias("train_observations"), F.lit(7.0).alias("last_value"), F.lit(12.5).alias("mean_value"))
    log = keys.filter(((k % 5 == 2) & (F.col("window") == 2)) | ((k % 5 == 3) & (F.col("window") == 3))).select(
        F.lit("WindowAverage28").alias("model"), "window", "unique_id", F.when(k % 5 == 2, "exception_modele").otherwise("budget_temps_depasse").alias("reason"), F.lit("boom").alias("exception"))
    return P.fallback_classifier(raw, ctx, log).select("unique_id", "ds", "window", "status", "model_effective", "y_pred_final", "fallback_reason")


@query("for15_cold_start_baselines", """
with d as (select produit_key, ds, categorie, isodow(ds)::int - 1 as dow, y from panel), tr as (select * from d where ds < date '2001-01-01'), nw as (select produit_key, ds, categorie, dow from d where ds >= date '2001-01-01'),
c as (select categorie, avg(y) m from tr group by 1), w as (select categorie, dow, avg(y) m from tr group by 1, 2)
select produit_key, ds, 0.0::double as zero, c.m as moyenne_categorie, coalesce(w.m, c.m) as moyenne_categorie_jour from nw left join c using (categorie) left join w using (categorie, dow)""")
def _(t):
    d = t.panel.select("produit_key", "ds", "categorie", F.weekday("ds").alias("dow"), "y")
    cut = F.lit("2001-01-01").cast("date")
    return P.cold_start_baselines(d.filter(F.col("ds") < cut), d.filter(F.col("ds") >= cut).drop("y")).select("produit_key", "ds", "zero", "moyenne_categorie", "moyenne_categorie_jour")


@query("for16_ablation_columns", f"with {features_sql('daily', {c: LAGF[c] for c in ('dow', 'month', 'weekend', 'y_lag1', 'y_lag7', 'y_lag14', 'y_lag28', 'y_ma28')})} " + digest_sql("feats", ["produit_key"], ["dow", "month", "weekend", "y_lag1", "y_lag7", "y_lag14", "y_lag28", "y_ma28"]))
def _(t):
    return digest(W.lag_features(t.daily, "produit_key"), ["produit_key"], P.ablation_columns(3))


@query("for17_stock_projection_audit", """
with x as (select lead(niveau_stock, 30) over w / nullif(lag(niveau_stock) over w, 0) as r from stock window w as (partition by produit_key order by ds)), y as (select r from x where r is not null)
select count(*) as n, avg((abs(r - 1) > 0.2)::int) as part_hors_20, round(quantile_cont(r, 0.1), 8) as p10, round(quantile_cont(r, 0.5), 8) as mediane, round(quantile_cont(r, 0.9), 8) as p90 from y""")
def _(t):
    out = P.stock_projection_audit(t.stock)
    return out.withColumns({c: F.round(c, 8) for c in ("p10", "mediane", "p90")})


@query("for18_forecast_lookup", f"""
with {BT}, f as (select unique_id, h, moving_average28 as pred from bt where "window" = 4 and unique_id <> 'Brand#3'), m as (select h, avg(pred) a from f group by 1), rq as (select distinct unique_id, (substr(unique_id, 7)::int % 3 + 1) * 10 as horizon from brand_days)
select rq.unique_id, horizon, round(sum(coalesce(pred, a)), 6) as total, count(coalesce(pred, a)) as n_jours, case when rq.unique_id = 'Brand#3' then 'profil_moyen' else 'serie' end as source from rq join m on h <= horizon left join f on f.unique_id = rq.unique_id and f.h = m.h group by 1, 2""")
def _(t):
    f = backtest(t).filter("window = 4 and unique_id <> 'Brand#3'").select("unique_id", "h", F.col("moving_average28").alias("pred"))
    rq = t.brand_days.select("unique_id").distinct().withColumn("horizon", (F.substring("unique_id", 7, 3).cast("int") % 3 + 1) * 10)
    return P.forecast_lookup(rq, f).withColumn("total", r("total"))


@query("udf3_grouped_map")
def _(t):
    """Per-series smoothing as a grouped map: one series of days per group."""
    import pandas as pd

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        return pd.DataFrame({"unique_id": [pdf["unique_id"].iloc[0]], "level": [float(pdf["y"].ewm(alpha=0.2, adjust=False).mean().iloc[-1])]})
    return t.brand_days.select("unique_id", "ds", "y").groupBy("unique_id").applyInPandas(smooth, "unique_id string, level double")
