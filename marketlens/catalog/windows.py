"""Window and time-series functions."""
from pyspark.sql import functions as F

from marketlens.catalog.base import digest, digest_sql, query
from marketlens.catalog.joins import DECISIONS, PROMO_PAIRS, decisions
from marketlens.functions.scalar import r
from marketlens.operators import grids
from marketlens.operators import joins as J
from marketlens.operators import windows as W
from marketlens.plans import datasets

SEQ = """base as (select *, case event_type when 'view' then 1 when 'click' then 2 when 'add_to_cart' then 3 when 'purchase' then 4 end as etape_entonnoir from web where not est_bot),
sq as (select *, row_number() over w as rang_evenement, count(*) over (partition by session_id) as n_evenements_session,
  (epoch_us(event_timestamp) - epoch_us(min(event_timestamp) over (partition by session_id))) / 1000000.0::double as secondes_depuis_debut,
  (epoch_us(event_timestamp) - epoch_us(lag(event_timestamp) over w)) / 1000000.0::double as secondes_depuis_precedent,
  (epoch_us(max(event_timestamp) over (partition by session_id)) - epoch_us(min(event_timestamp) over (partition by session_id))) / 1000000.0::double as duree_session_secondes,
  max(etape_entonnoir) over (partition by session_id) as etape_max_session from base window w as (partition by session_id order by event_timestamp, event_id))"""


@query("win1_session_sequences", f"""
with {SEQ} select session_id, event_id, rang_evenement, n_evenements_session, secondes_depuis_debut, secondes_depuis_precedent, duree_session_secondes, etape_entonnoir, etape_max_session,
  coalesce(etape_max_session >= 4, false) as session_convertie from sq""")
def _(t):
    return W.session_sequences(t.web).select("session_id", "event_id", "rang_evenement", "n_evenements_session", "secondes_depuis_debut", "secondes_depuis_precedent",
                                             "duree_session_secondes", "etape_entonnoir", "etape_max_session", "session_convertie")


def _mixed(t):
    """Sessions that start anonymous and become authenticated at their second event."""
    return t.web.withColumn("client_key", F.when(F.col("event_id") % 2 == 0, F.col("client_key")))


@query("win2_session_identity", """
with w as (select *, case when event_id % 2 = 0 then client_key end as ck from web where not est_bot),
c as (select session_id, arg_min(ck, (event_timestamp, event_id)) filter (ck is not null) as c1 from w group by 1)
select event_id, coalesce(c1, anonymous_id) as identite_effective, c1 is not null as session_authentifiee from w left join c using (session_id)""")
def _(t):
    return W.session_sequences(_mixed(t)).select("event_id", "identite_effective", "session_authentifiee")


@query("win3_sessionize", """
with g as (select *, case when event_timestamp - lag(event_timestamp) over (partition by user_id order by event_timestamp, event_id) <= interval 12 hour then 0 else 1 end as nw from web)
select event_id, user_id, sum(nw) over (partition by user_id order by event_timestamp, event_id)::bigint as session_no from g""")
def _(t):
    return W.sessionize(t.web, gap_seconds=43200).select("event_id", "user_id", "session_no")


@query("win3_session_gaps_30min", """
with g as (select *, case when event_timestamp - lag(event_timestamp) over (partition by user_id order by event_timestamp, event_id) <= interval 30 minute then 0 else 1 end as nw from web),
s as (select user_id, event_timestamp, sum(nw) over (partition by user_id order by event_timestamp, event_id)::bigint as session_no from g)
select user_id, count(distinct session_no) as n_sessions, count(*) as n_events from s group by 1""")
def _(t):
    return W.sessionize(t.web).groupBy("user_id").agg(F.count_distinct("session_no").alias("n_sessions"), F.count(F.lit(1)).alias("n_events"))


@query("win4_recent_intent", """
with w as (select *, coalesce(client_key, anonymous_id) as identite_effective from web where not est_bot and event_timestamp < timestamp '2001-01-15' and event_timestamp >= timestamp '2001-01-12')
select identite_effective, produit_key, event_timestamp, event_type from w qualify row_number() over (partition by identite_effective order by event_timestamp desc, event_id desc) <= 4""")
def _(t):
    return W.recent_intent(W.session_sequences(t.web), F.lit("2001-01-15").cast("timestamp"), hours=72, k=4)


def frame(size, end=-1):
    lo, hi = end - size + 1, end
    p = lambda n: "current row" if n == 0 else (f"{-n} preceding" if n < 0 else f"{n} following")
    return f"rows between {p(lo)} and {p(hi)}"


def roll(col, kind, part, size, min_rows=1, end=-1):
    """SQL text of the rolling statistic."""
    over = f"over (partition by {part} order by ds {frame(size, end)})"
    fn = {"mean": f"avg({col})", "std": f"stddev_samp({col})", "min": f"min({col})", "max": f"max({col})", "median": f"median({col})", "sum": f"sum({col})",
          "zero_rate": f"avg(case when {col} is not null then ({col} = 0)::int end)"}[kind]
    return f"case when count({col}) {over} >= {min_rows} then {fn} {over} end"


def lag(col, n, part):
    return f"lag({col}, {n}) over (partition by {part} order by ds)"


LAGF = {**{f"y_lag{n}": lag("y", n, "produit_key") for n in (1, 7, 14, 28)}, "y_ma28": roll("y", "mean", "produit_key", 28, 7), "dow": "isodow(ds) - 1", "month": "month(ds)",
        "weekend": "(isodow(ds) >= 6)::int", "promo": "remise_pct", "stock_cut": lag("niveau_stock", 1, "produit_key"), "views_lag1": lag('"view"', 1, "produit_key"),
        "cart_lag1": lag("add_to_cart", 1, "produit_key"), "views_ma7": roll('"view"', "mean", "produit_key", 7)}


def features_sql(table, columns, keys=("produit_key", "ds")):
    body = ", ".join(f'{e} as "{n}"' for n, e in columns.items())
    return f"feats as (select {', '.join(keys)}, {body} from {table})"


@query("win5_lag_features", f"with {features_sql('daily', LAGF)} " + digest_sql("feats", ["produit_key"], list(LAGF)))
def _(t):
    return digest(W.lag_features(t.daily, "produit_key"), ["produit_key"], list(LAGF))


ROLLF = {**{f"lag_{n}": lag("y", n, "unique_id") for n in (1, 2, 3, 7, 14, 21, 28, 56)},
         **{f"roll_{s}_{n}": roll("y", s, "unique_id", n) for n in (7, 14, 28) for s in ("mean", "std", "min", "max", "median", "sum")},
         **{f"diff_{n}": f"{lag('y', 1, 'unique_id')} - {lag('y', 1 + n, 'unique_id')}" for n in (1, 7)}}


@query("win6_rolling_features", f"with {features_sql('brand_days', ROLLF, ('unique_id', 'ds'))} " + digest_sql("(select *, year(ds)::int as annee from feats)", ["unique_id", "annee"], list(ROLLF)))
def _(t):
    return digest(W.rolling_features(t.brand_days).withColumn("annee", F.year("ds")), ["unique_id", "annee"], list(ROLLF))


def unbounded(fn, part):
    return f"{fn} over (partition by {part} order by ds rows between unbounded preceding and current row)"


CUT = {**{f"sales_lag_{n}": (lag("y", n - 1, "produit_key") if n > 1 else "y") for n in (1, 2, 3, 7, 14, 21, 28)},
       **{f"sales_{s}_{n}": roll("y", s, "produit_key", n, max(3, n // 4), 0) for n in (7, 14, 28, 56, 84) for s in ("mean", "median", "std", "min", "max", "zero_rate")},
       "sales_cumulative": unbounded("sum(y)", "produit_key"), "active_days_cumulative": unbounded("sum((y > 0)::int)", "produit_key"), "observed_days": unbounded("count(*)", "produit_key"),
       **{f"{p}_lag_{n}": (lag(c, n - 1, "produit_key") if n > 1 else c) for p, c in (("views", '"view"'), ("cart", "add_to_cart")) for n in (1, 3, 7, 14, 28)},
       "view_to_cart_28": f"{roll('add_to_cart', 'sum', 'produit_key', 28, 7, 0)} / nullif({roll(chr(34) + 'view' + chr(34), 'sum', 'produit_key', 28, 7, 0)}, 0)",
       "stock_at_cutoff": "niveau_stock", "version_age_days": "greatest(ds - valid_from, 0)", "cutoff_dow": "isodow(ds) - 1", "cutoff_month": "month(ds)",
       "cv2_84": f"pow({roll('y', 'std', 'produit_key', 84, 21, 0)} / nullif({roll('y', 'mean', 'produit_key', 84, 21, 0)}, 0), 2)",
       **{c: c for c in ("product_code", "category_code", "brand_code")},
       "views_trend_7_28": f"{roll(chr(34) + 'view' + chr(34), 'mean', 'produit_key', 7, 3, 0)} - {roll(chr(34) + 'view' + chr(34), 'mean', 'produit_key', 28, 7, 0)}",
       "restock_frequency_84": roll("(quantite_reapprovisionnee > 0)::int", "mean", "produit_key", 84, 14, 0),
       "adi": f"{unbounded('count(*)', 'produit_key')} / nullif({unbounded('sum((y > 0)::int)', 'produit_key')}, 0)",
       "days_since_restock": f"coalesce({unbounded('count(*)', 'produit_key')} - {unbounded('max(case when quantite_reapprovisionnee > 0 then rn end)', 'produit_key')}, {unbounded('count(*)', 'produit_key')})",
       "category_mean_28": "category_mean_28", "category_cumulative_mean": "category_cumulative_mean", "brand_mean_28": "brand_mean_28", "brand_cumulative_mean": "brand_cumulative_mean"}
GROUPS = ", ".join(f"""g_{p} as (select {g}, ds, {roll('tt', 'mean', g, 28, 7, 0)} as {p}_mean_28, {unbounded('avg(tt)', g)} as {p}_cumulative_mean from (select {g}, ds, sum(y) as tt from daily group by 1, 2))"""
                   for g, p in (("categorie", "category"), ("marque", "brand")))
RICH = "rich as (select d.*, row_number() over (partition by produit_key order by ds) as rn, category_mean_28, category_cumulative_mean, brand_mean_28, brand_cumulative_mean, valid_from, product_code, dense_rank() over (order by categorie) - 1 as category_code, dense_rank() over (order by marque) - 1 as brand_code from daily d join g_category using (categorie, ds) join g_brand using (marque, ds) join (select produit_key, valid_from, dense_rank() over (order by produit_key) - 1 as product_code from products) using (produit_key))"


@query("win7_cutoff_features", f"with {GROUPS}, {RICH}, {features_sql('rich', CUT)} " + digest_sql("feats", ["produit_key"], list(CUT), 3))
def _(t):
    return digest(W.cutoff_features(t.daily, products=t.products), ["produit_key"], list(CUT), 3)


@query("win7_abc_rank_per_day", """
with c as (select produit_key, ds, sum(y) over (partition by produit_key order by ds) as cum from daily),
s as (select *, (row_number() over (partition by ds order by cum desc, produit_key) - 1) / count(*) over (partition by ds) as sh from c)
select produit_key, sum((sh < 0.2)::int)::bigint as days_a, round(sum(sh), 4) as s_share from s group by 1""")
def _(t):
    from pyspark.sql import Window
    cum = t.daily.withColumn("sales_cumulative", F.sum("y").over(W.series("produit_key").rowsBetween(Window.unboundedPreceding, 0)))
    return W.abc_rank_per_day(cum).groupBy("produit_key").agg(F.sum("abc_a").alias("days_a"), F.round(F.sum("abc_share_before"), 4).alias("s_share"))


@query("win8_days_since_positive", """
with x as (select unique_id, ds, y, row_number() over (partition by unique_id order by ds) rn from brand_days)
select unique_id, ds, coalesce(rn - max(case when y > 60 then rn end) over (partition by unique_id order by ds), rn)::int as depuis from x""")
def _(t):
    d = t.brand_days.withColumn("fort", F.when(F.col("y") > 60, 1).otherwise(0))
    return W.days_since_positive(d, "fort", "unique_id", "depuis").select("unique_id", "ds", "depuis")


@query("win9_horizon_frame", """
select unique_id, ds, lead(y, 7) over w as target, lead(remise_pct, 7) over w as planned_discount, ds + 7 as target_ds, isodow(ds + 7)::int - 1 as target_dow, (isodow(ds + 7) >= 6)::int as target_weekend, month(ds + 7)::int as target_month,
  weekofyear(ds + 7)::int as target_week, (day(ds + 7) = 1)::int as target_month_start, (last_day(ds + 7) = ds + 7)::int as target_month_end from brand_days window w as (partition by unique_id order by ds)""")
def _(t):
    return W.horizon_frame(t.brand_days.select("unique_id", "ds", "y", "remise_pct"), 7).drop("y", "remise_pct")


@query("win10_forward_sum", f"""
select unique_id, ds, case when count(y) over w = 30 then sum(y) over w end::bigint as target_sum_30, case when count(y) over w = 30 then avg(y) over w end as target_mean_30, case when count(y) over w = 30 then max(y) over w end as target_max_30
from brand_days window w as (partition by unique_id order by ds rows between 1 following and 30 following)""")
def _(t):
    return W.forward_sum(t.brand_days).select("unique_id", "ds", "target_sum_30", "target_mean_30", "target_max_30")


STOCKF = """sl as (select *, lag(niveau_stock) over (partition by produit_key order by ds) as l1, row_number() over (partition by produit_key order by ds) as i from stock),
sf as (select produit_key, ds, niveau_stock as stock_fin_jour, l1 as stock_disponible_lag1, (l1 <= 20)::int as indicateur_rupture_lag1, (l1 <= 50)::int as indicateur_stock_faible_lag1,
  i - 1 - max(case when niveau_stock <= 20 then i end) over p as jours_depuis_derniere_rupture, i - 1 - max(case when niveau_stock > l1 then i end) over p as jours_depuis_dernier_reappro, """ + ", ".join(
    f"case when count(niveau_stock) over (partition by produit_key order by ds {frame(n)}) >= 1 then sum((niveau_stock <= 20)::int) over (partition by produit_key order by ds {frame(n)}) end as jours_rupture_lag_{n}" for n in (7, 14, 28)) + """
  from sl window p as (partition by produit_key order by ds rows between unbounded preceding and 1 preceding))"""
STOCK_COLUMNS = ["stock_disponible_lag1", "indicateur_rupture_lag1", "indicateur_stock_faible_lag1", "jours_depuis_derniere_rupture", "jours_depuis_dernier_reappro",
                 "jours_rupture_lag_7", "jours_rupture_lag_14", "jours_rupture_lag_28"]


@query("win11_stock_features", f"with {STOCKF} " + digest_sql("sf", ["produit_key"], STOCK_COLUMNS))
def _(t):
    return digest(W.stock_features(t.stock), ["produit_key"], STOCK_COLUMNS)


@query("win12_stock_censorship", f"with {STOCKF} select produit_key, sum((coalesce(indicateur_rupture_lag1, 0) = 1 and y = 0)::int)::bigint as censored, count(*) as n from sf join daily using (produit_key, ds) group by 1")
def _(t):
    f = W.stock_features(t.stock).join(t.daily.select("produit_key", "ds", "y"), ["produit_key", "ds"])
    return W.stock_censorship(f).groupBy("produit_key").agg(F.sum("jour_censure_stock").alias("censored"), F.count(F.lit(1)).alias("n"))


@query("win13_stock_identity_residual", """
with x as (select produit_key, niveau_stock - (lag(niveau_stock) over (partition by produit_key order by ds) - quantite_vendue + quantite_reapprovisionnee) as residu from stock)
select produit_key, count(residu) as n, count(case when residu <> 0 then 1 end) as n_non_nul, sum(residu)::bigint as total from x group by 1""")
def _(t):
    return W.stock_identity_residual(t.stock).groupBy("produit_key").agg(F.count("residu").alias("n"), F.count_if(F.col("residu") != 0).alias("n_non_nul"), F.sum("residu").alias("total"))


HISTF = {}
for _c, _p in (("y", "sales"), ('"view"', "views"), ("add_to_cart", "carts")):
    HISTF |= {f"{_p}_lag_{n}": lag(_c, n, "produit_key") for n in (1, 7, 28)} | {f"{_p}_mean_{n}": roll(_c, "mean", "produit_key", n, max(3, n // 4)) for n in (7, 28, 84)}
HISTF |= {"historical_view_to_cart_28": f"({roll('add_to_cart', 'sum', 'produit_key', 28, 7)}) / nullif({roll(chr(34) + 'view' + chr(34), 'sum', 'produit_key', 28, 7)}, 0)",
          "stock_at_cutoff": lag("niveau_stock", 1, "produit_key"), "restock_frequency_84": roll("(quantite_reapprovisionnee > 0)::int", "mean", "produit_key", 84, 14),
          "sales_zero_rate_28": roll("y", "zero_rate", "produit_key", 28, 7)}


@query("win14_daily_history", f"with {features_sql('daily', HISTF)} " + digest_sql("feats", ["produit_key"], list(HISTF)))
def _(t):
    return digest(W.daily_history(t.daily, {"y": "sales", "view": "views", "add_to_cart": "carts"}), ["produit_key"], list(HISTF))


SEGS = ("AUTOMOBILE", "MACHINERY", "FURNITURE")
SEGD = """sg as (select unique_id, ds, """ + ", ".join(f"coalesce(sum(case when segment_fidelite = '{s}' then quantite end), 0) as \"{s}\"" for s in SEGS) + """
  from brand_days b left join (select marque as unique_id, ds, segment_fidelite, quantite from confirmed join products using (produit_key) join clients using (client_key)) using (unique_id, ds) group by 1, 2),
sh as (select unique_id, ds, """ + ", ".join(
    f"({roll(chr(34) + s + chr(34), 'sum', 'unique_id', 90, 14)}) / nullif({roll('(' + ' + '.join(chr(34) + x + chr(34) for x in SEGS) + ')', 'sum', 'unique_id', 90, 14)}, 0) as \"segment_share_{s}_90\"" for s in SEGS) + " from sg)"


@query("win15_segment_share_90", f"with {SEGD} " + digest_sql("sh", ["unique_id"], [f"segment_share_{s}_90" for s in SEGS]))
def _(t):
    rich = (t.confirmed.join(t.products.select("produit_key", F.col("marque").alias("unique_id")), "produit_key").join(t.clients.select("client_key", "segment_fidelite"), "client_key")
            .groupBy("unique_id", "ds").agg(*[F.sum(F.when(F.col("segment_fidelite") == s, F.col("quantite"))).alias(s) for s in SEGS]))
    base = t.brand_days.select("unique_id", "ds").join(rich, ["unique_id", "ds"], "left").na.fill(0, list(SEGS))
    return digest(W.segment_share(base, SEGS), ["unique_id"], [f"segment_share_{s}_90" for s in SEGS])


EXPO = ["product_campaign_active", "category_campaign_active", "category_concurrent_promotions", "campaign_active", "past_campaign_exposure_90"]


@query("win16_promo_exposure", f"""
with {PROMO_PAIRS}, fl as (select produit_key, ds, max((portee = 'product')::int) pa, max((portee = 'category')::int) ca2 from pd group by 1, 2),
cc as (select categorie, ds, count(distinct promo_key) nc from pd join products using (produit_key) group by 1, 2),
x as (select produit_key, ds, coalesce(pa, 0) as product_campaign_active, coalesce(ca2, 0) as category_campaign_active, coalesce(nc, 0) as category_concurrent_promotions, greatest(coalesce(pa, 0), coalesce(ca2, 0)) as campaign_active
  from daily left join fl using (produit_key, ds) left join cc using (categorie, ds)),
z as (select *, {roll('campaign_active', 'sum', 'produit_key', 90, 14)} as past_campaign_exposure_90 from x) """ + digest_sql("z", ["produit_key"], EXPO))
def _(t):
    # the calendar is shifted into the stock span so that campaigns are active there
    return digest(W.promo_exposure(t.daily.select("produit_key", "categorie", "ds"), J.expand_promotions(t.promotions, t.products)), ["produit_key"], EXPO)


@query("win17_prior_mean", """
with d as (select categorie, remise_pct, ds, sum(y) s, count(*) n from panel group by 1, 2, 3), w as (select categorie, remise_pct, ds, sum(s) over p ss, coalesce(sum(n) over p, 0)::bigint nn from d
  window p as (partition by categorie, remise_pct order by ds rows between unbounded preceding and 1 preceding))
select categorie, remise_pct, ds, ss / nn as cd_mean_before, nn as cd_n_before from w""")
def _(t):
    return W.prior_mean(t.panel, ["categorie", "remise_pct"], "cd", "y")


PRIOR = {f"{c}_{n}d_before": (c, n) for n in (7, 28) for c in ("qty", "orders", "clients")}


@query("win18_campaign_prior_features", f"""
with dd as (select produit_key, ds, sum(quantite) as qty, count(distinct order_id) as orders, count(distinct client_key) as clients from confirmed group by 1, 2),
h as (select produit_key, ds, {', '.join(f'{roll(c, "sum", "produit_key", n)} as {a}' for a, (c, n) in PRIOR.items())}, max(ds) over (partition by produit_key order by ds rows between unbounded preceding and 1 preceding) as last_sale from dd),
e as (select produit_key, promo_key, date_debut from promotions join products on cible = product_id where portee = 'product'),
m as (select e.produit_key, promo_key, date_debut, max(ds) as seen from e left join h on h.produit_key = e.produit_key and ds < date_debut group by 1, 2, 3)
select m.produit_key, promo_key, {', '.join(f'coalesce({a}, 0)::double as {a}' for a in PRIOR)}, coalesce(date_debut - last_sale, 999)::int as days_since_last_sale from m left join h on h.produit_key = m.produit_key and h.ds = m.seen""")
def _(t):
    episodes = J.promotion_products(t.promotions.filter("portee = 'product'"), t.products)
    return W.campaign_prior_features(t.confirmed, episodes, (7, 28)).select("produit_key", "promo_key", *PRIOR, "days_since_last_sale")


WARM = ["warmup_mean_28", "warmup_mean_84", "warmup_lag_7", "warmup_zero_rate_28"]


@query("win19_warmup_features", f"""
with {DECISIONS}, g as (select produit_key, ds, coalesce(y, 0) as y from (select produit_key, d::date as ds from products, (select unnest(generate_series(date '2000-10-01', (select max(ds) from stock), interval 1 day)) d)) left join pday using (produit_key, ds)),
f as (select produit_key, ds, {roll('y', 'mean', 'produit_key', 28, 7)} as warmup_mean_28, {roll('y', 'mean', 'produit_key', 84, 14)} as warmup_mean_84, {lag('y', 7, 'produit_key')} as warmup_lag_7, {roll('y', 'zero_rate', 'produit_key', 28, 7)} as warmup_zero_rate_28 from g),
x as (select produit_key, f.* exclude (produit_key, ds) from dec join f using (produit_key, ds)) """ + digest_sql("x", ["produit_key"], WARM))
def _(t):
    span = t.stock.agg(F.lit("2000-10-01").cast("date").alias("lo"), F.max("ds").alias("hi"))
    return digest(W.warmup_features(decisions(t), t.confirmed, span), ["produit_key"], WARM)


TOTALS = "tt as (select produit_key, sum(y)::bigint as v from pday group by 1)"


@query("win20_abc_class", f"""
with {TOTALS}, c as (select *, sum(v) over (order by v desc, produit_key) / sum(v) over () as part_cumulee from tt)
select *, case when part_cumulee <= 0.8 then 'A' when part_cumulee <= 0.95 then 'B' else 'C' end as classe_abc from c""")
def _(t):
    return W.abc_class(t.pday.groupBy("produit_key").agg(F.sum("y").alias("v")), "produit_key", "v")


@query("win20_abc_share_before", f"with {TOTALS}, c as (select *, (sum(v) over (order by v desc, produit_key) - v) / sum(v) over () as share_before from tt) select *, share_before < 0.8 as abc_a from c")
def _(t):
    return W.abc_class(t.pday.groupBy("produit_key").agg(F.sum("y").alias("v")), "produit_key", "v", share_before=True)


@query("win21_promo_runs", """
with f as (select *, coalesce((en_promotion <> lag(en_promotion) over (partition by produit_key order by ds))::int, 1) as ch from panel), g as (select *, sum(ch) over (partition by produit_key order by ds) as run from f)
select produit_key, min(ds) as debut, max(ds) as fin, count(*) as duree, arg_min(remise_pct, ds) as remise from g where en_promotion group by produit_key, run""")
def _(t):
    return W.promo_runs(t.panel)


@query("win22_rupture_runs", """
with f as (select produit_key, ds, niveau_stock <= 20 as r from stock), c as (select *, coalesce((r <> lag(r) over (partition by produit_key order by ds))::int, 1) as ch from f), g as (select *, sum(ch) over (partition by produit_key order by ds) as run from c)
select produit_key, min(ds) as debut, count(*) as duree from g where r group by produit_key, run""")
def _(t):
    return W.rupture_runs(t.stock, 20)


@query("win23_calendar_gaps", """
with d as (select ds, lag(ds) over (order by ds) p from (select distinct ds from sales where quantite >= 50 and remise_pct = 10)) select p as debut_trou, ds as fin_trou, (ds - p - 1)::int as jours_sans_vente from d where ds - p > 2""")
def _(t):
    return W.calendar_gaps(t.sales.filter("quantite >= 50 and remise_pct = 10"))


@query("win24_weekly_rolling_popularity", """
with s as (select produit_key, date_trunc('week', ds)::date as wk, sum(quantite) u from confirmed group by 1, 2), wks as (select unnest(generate_series((select date_trunc('week', min(ds)) from confirmed)::timestamp, (select date_trunc('week', max(ds)) from confirmed)::timestamp, interval 7 day))::date as wk),
g as (select p.produit_key, wks.wk, coalesce(u, 0) u from products p, wks left join s on s.produit_key = p.produit_key and s.wk = wks.wk),
x as (select produit_key, wk, coalesce(sum(u) over (partition by produit_key order by wk rows between 4 preceding and 1 preceding), 0)::double as popularite from g)
select produit_key, count(*) as n, sum(popularite) as total, max(popularite) as plus_haut, count(case when popularite = 0 then 1 end) as n_zero from x group by 1""")
def _(t):
    span = t.confirmed.agg(F.trunc(F.min("ds"), "week").alias("lo"), F.trunc(F.max("ds"), "week").alias("hi"))
    d = W.weekly_rolling_popularity(t.confirmed, t.products, span)
    return d.groupBy("produit_key").agg(F.count(F.lit(1)).alias("n"), F.sum("popularite").alias("total"), F.max("popularite").alias("plus_haut"), F.count_if(F.col("popularite") == 0).alias("n_zero"))


@query("win25_week_index", """
with s as (select ds, count(*) n, floor((ds - (select min(ds) from sales)) / 7)::int as semaine_index from sales group by 1), k as (select semaine_index, dense_rank() over (order by semaine_index)::int semaine_rang, ntile(6) over (order by semaine_index)::int fenetre from (select distinct semaine_index from s))
select ds, n, semaine_index, semaine_rang, fenetre from s join k using (semaine_index)""")
def _(t):
    return W.week_index(t.sales.groupBy("ds").agg(F.count(F.lit(1)).alias("n")))


def holidays(t):
    years = t.sales.select(F.year("ds").alias("y")).distinct()
    d = lambda m, k: F.make_date("y", F.lit(m), F.lit(k))
    h = lambda day, name, estimated=False: F.struct(day.alias("ds"), F.lit(name).alias("nom_ferie"), F.lit(estimated).alias("fete_estimee"))
    rows = F.array(h(d(1, 1), "Jour de l'an"), h(d(4, 4), "Fête de l'Indépendance"), h(F.date_add(d(1, 20), F.col("y") % 7 * 3), "Korité (estimé)", True),
                   h(F.date_add(d(4, 1), F.col("y") % 5 * 4), "Tabaski (estimé)", True), h(d(12, 25), "Noël"))
    return years.select(F.explode(rows).alias("h")).select("h.*")


HOL = """yy as (select distinct year(ds)::int y from sales), hol as (select make_date(y, 1, 1) as ds, 'Jour de l''an' as nom_ferie, false as fete_estimee, 'nouvel_an' as e from yy union all select make_date(y, 4, 4), 'Fête de l''Indépendance', false, 'independance' from yy
  union all select make_date(y, 1, 20) + y % 7 * 3, 'Korité (estimé)', true, 'korite' from yy union all select make_date(y, 4, 1) + y % 5 * 4, 'Tabaski (estimé)', true, 'tabaski' from yy union all select make_date(y, 12, 25), 'Noël', false, 'noel' from yy)"""


@query("win26_calendar_features", f"""
with {HOL}, h1 as (select ds, arg_min(nom_ferie, nom_ferie) nom_ferie, arg_min(fete_estimee, nom_ferie) fe from hol group by 1), d as (select distinct ds from sales)
select d.ds, isodow(d.ds)::int - 1 as jour_semaine, day(d.ds)::int as jour_mois, dayofyear(d.ds)::int as jour_annee, weekofyear(d.ds)::int as semaine, quarter(d.ds)::int as trimestre, (isodow(d.ds) >= 6)::int as est_weekend,
  (day(d.ds) = 1)::int as debut_mois, (last_day(d.ds) = d.ds)::int as fin_mois, (d.ds = date_trunc('quarter', d.ds))::int as debut_trimestre, (d.ds = last_day(date_trunc('quarter', d.ds)::date + interval 2 month))::int as fin_trimestre,
  (day(d.ds) <= 5)::int as debut_mois_5j, (day(d.ds) > day(last_day(d.ds)) - 5)::int as fin_mois_5j, round(sin(2 * pi() * dayofyear(d.ds) / 365.25), 8) as sin_jour_annee, round(cos(2 * pi() * (isodow(d.ds) - 1) / 7), 8) as cos_jour_semaine,
  (h1.ds is not null)::int as est_ferie, coalesce(fe, false)::int as ferie_estime, coalesce(h1.nom_ferie, '') as nom_ferie,
  coalesce((select min(d.ds - hol.ds) from hol where hol.ds <= d.ds), 999)::int as jours_depuis_ferie, coalesce((select min(hol.ds - d.ds) from hol where hol.ds >= d.ds), 999)::int as jours_avant_ferie,
  (exists (select 1 from hol where e = 'tabaski' and hol.ds = d.ds))::int as est_tabaski, (exists (select 1 from hol where e = 'tabaski' and hol.ds - d.ds between 1 and 7))::int as avant_tabaski,
  (exists (select 1 from hol where e = 'noel' and d.ds - hol.ds between 1 and 3))::int as apres_noel, (exists (select 1 from hol where e = 'magal' and hol.ds = d.ds))::int as est_magal,
  coalesce(31 - (select min(hol.ds - d.ds) from hol where e = 'korite' and hol.ds - d.ds between 1 and 30), 0)::int as jour_ramadan, (exists (select 1 from hol where e = 'korite' and hol.ds - d.ds between 1 and 30))::int as est_ramadan,
  (exists (select 1 from hol where e = 'korite' and hol.ds - d.ds between 1 and 7))::int as fin_ramadan from d left join h1 on h1.ds = d.ds""")
def _(t):
    c = W.calendar_features(t.sales, holidays(t))
    return c.select("ds", "jour_semaine", "jour_mois", "jour_annee", "semaine", "trimestre", "est_weekend", "debut_mois", "fin_mois", "debut_trimestre", "fin_trimestre", "debut_mois_5j", "fin_mois_5j",
                    r("sin_jour_annee", 8).alias("sin_jour_annee"), r("cos_jour_semaine", 8).alias("cos_jour_semaine"), "est_ferie", "ferie_estime", "nom_ferie", "jours_depuis_ferie", "jours_avant_ferie",
                    "est_tabaski", "avant_tabaski", "apres_noel", "est_magal", "jour_ramadan", "est_ramadan", "fin_ramadan")


@query("win27_active_grid", """
with f as (select produit_key, min(ds) as p from pday group by 1), b as (select produit_key, least(p, coalesce(greatest(valid_from, (select min(ds) from pday)), p)) as debut from f left join products using (produit_key))
select produit_key, debut, ((select max(ds) from pday) - debut + 1) as n_jours from b""")
def _(t):
    g = grids.active_grid(t.pday, t.products)
    return g.groupBy("produit_key").agg(F.min("ds").alias("debut"), F.count(F.lit(1)).alias("n_jours"))


ANA = ["y", "ca", "n_transactions", "age_produit_jours", "prix_catalogue", "en_promotion", "remise_pct", "n_promotions", "prix_attendu", "web_view", "web_total", "web_data_observed"]


@query("win28_analytical_table", f"""
with {PROMO_PAIRS}, best as (select produit_key, ds, max(remise_pct) as remise, count(*) as np from pd group by 1, 2),
g as (select produit_key, unnest(generate_series(debut, fin, interval 1 day))::date as ds from (select produit_key, least(p, coalesce(greatest(valid_from, lo), p)) as debut, hi as fin
  from (select produit_key, min(ds) as p from pday group by 1) left join products using (produit_key), (select min(ds) lo, max(ds) hi from pday))),
wd as (select produit_key, cast(event_timestamp as date) as ds, count(case when event_type = 'view' then 1 end) as v, count(*) as tot from web group by 1, 2), ws as (select produit_key, min(ds) a, max(ds) b from wd group by 1),
x as (select produit_key, ds, coalesce(y, 0) as y, coalesce(ca, 0.0) as ca, coalesce(n_transactions, 0) as n_transactions, greatest(ds - valid_from, 0) as age_produit_jours, prix_base as prix_catalogue, case when y > 0 then ca / y end as prix_realise,
  (remise is not null)::int as en_promotion, coalesce(remise, 0) as remise_pct, coalesce(np, 0) as n_promotions, prix_base * (1 - coalesce(remise, 0) / 100) as prix_attendu,
  case when ds between a and b then coalesce(v, 0) end as web_view, case when ds between a and b then coalesce(tot, 0) end as web_total, coalesce(ds between a and b, false)::int as web_data_observed
  from g left join (select produit_key, ds, y, ca, n_transactions from pday) using (produit_key, ds) join products using (produit_key) left join best using (produit_key, ds) left join wd using (produit_key, ds) left join ws using (produit_key)) """ + digest_sql("x", ["produit_key"], ANA))
def _(t):
    return digest(datasets.analytical_table(t.confirmed, t.products, t.promotions, t.web, ("view", "click", "add_to_cart", "purchase", "error")), ["produit_key"], ANA)


@query("win29_best_promo_per_day", f"""
with {PROMO_PAIRS}, b as (select produit_key, ds, max(remise_pct) as remise_pct, count(*) as n_promotions, arg_min(portee, (-remise_pct, promo_key)) as portee_promo from pd group by 1, 2)
select produit_key, sum(remise_pct)::bigint as s_remise, sum(n_promotions)::bigint as s_n, count(*) as n_jours, count(case when portee_promo = 'product' then 1 end) as n_product from b group by 1""")
def _(t):
    b = W.best_promo_per_day(J.expand_promotions(t.promotions, t.products))
    return b.groupBy("produit_key").agg(F.sum("remise_pct").alias("s_remise"), F.sum("n_promotions").alias("s_n"), F.count(F.lit(1)).alias("n_jours"), F.count_if(F.col("portee_promo") == "product").alias("n_product"))


@query("win30_weekly_panel", f"""
with {PROMO_PAIRS}, rc as (select * from confirmed), pw as (select produit_key, unnest(generate_series(date_trunc('week', date_debut)::date, date_trunc('week', date_fin)::date, interval 7 day))::date as wk, remise_pct from pp),
pa as (select produit_key, wk, avg(remise_pct) as m from pw group by 1, 2), s as (select produit_key, date_trunc('week', ds)::date as wk, sum(quantite) q, round(sum(montant_net), 4) ca from rc group by 1, 2),
wks as (select unnest(generate_series(date_trunc('week', lo)::timestamp, hi::timestamp, interval 7 day))::date as wk from (select min(ds) lo, max(ds) hi from rc)), g as (select produit_key, wk from products, wks),
x as (select produit_key, wk, coalesce(q, 0) as qty, coalesce(ca, 0.0) as ca, coalesce(m, 0.0) as remise_ponderee from g left join s using (produit_key, wk) left join pa using (produit_key, wk)),
y as (select *, coalesce(avg(qty) over (partition by produit_key order by wk rows between 4 preceding and 1 preceding), 0.0) as pred_ma4 from x) """ + digest_sql("y", ["produit_key"], ["qty", "ca", "remise_ponderee", "pred_ma4"]))
def _(t):
    d = W.weekly_panel(t.confirmed, t.products, J.promotion_products(t.promotions, t.products))
    return digest(d, ["produit_key"], ["qty", "ca", "remise_ponderee", "pred_ma4"])


@query("win31_tail_zero_run", "select produit_key as unique_id, max(case when y > 0 then ds end) as derniere_vente, ((select max(ds) from pday) - max(case when y > 0 then ds end))::int as jours_sans_vente_fin from pday group by 1")
def _(t):
    return W.tail_zero_run(t.pday.withColumnRenamed("produit_key", "unique_id"))


@query("win32_robust_z_days", """
with d as (select ds, sum(quantite)::bigint as y from confirmed group by 1), m as (select median(y) md from d), a as (select median(abs(y - md)) mad from d, m)
select ds, y, 0.6745::double * (y - md) / mad as z_robuste from d, m, a where abs(0.6745 * (y - md) / mad) > 1.5""")
def _(t):
    return W.robust_z_days(t.confirmed.groupBy("ds").agg(F.sum("quantite").alias("y")), threshold=1.5)
