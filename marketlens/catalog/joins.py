"""Joins: key resolution, interval, as-of, counting, semi/anti, pairs."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.catalog.base import query
from marketlens.operators import grids
from marketlens.operators import joins as J
from marketlens.operators.schema import require_columns


def impressions(t):
    """Product views taken as recommendation impressions."""
    return (t.web.filter(F.col("event_type") == "view")
            .select(F.col("event_id").alias("recommendation_id"), "session_id", "produit_key", "client_key", "anonymous_id",
                    F.col("event_timestamp").alias("impression_timestamp"))
            .join(t.products.select("produit_key", "categorie"), "produit_key", "left"))


IMPRESSIONS = """imp as (select event_id as recommendation_id, session_id, produit_key, client_key, anonymous_id, event_timestamp as impression_timestamp, categorie
  from web left join products using (produit_key) where event_type = 'view')"""


def decisions(t):
    """Every product on every Monday of the stock span, at 9 h."""
    days = t.stock.groupBy("produit_key").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    weeks = grids.explode_days(days, F.col("lo"), F.col("hi"), "ds", 7).select("produit_key", "ds")
    return weeks.withColumn("decision_timestamp", F.col("ds").cast("timestamp") + F.expr("interval 9 hours"))


DECISIONS = """dec as (select produit_key, ds, cast(ds as timestamp) + interval 9 hour as decision_timestamp
  from (select produit_key, unnest(generate_series(min(ds), max(ds), interval 7 day))::date as ds from stock group by 1))"""


@query("joi1_resolve_surrogate_keys", """
select vente_id, p.produit_key, c.client_key, m.promo_key, quantite from (select vente_id, quantite, promo_key as promotion_id,
  'P' || substr(produit_key, 4)::int as product_id, case when quantite = 50 then 'inconnu' else 'C' || substr(client_key, 4)::int end as customer_id from sales) s
left join products p using (product_id) left join (select customer_id, client_key from clients) c using (customer_id)
left join (select promo_key, promo_key as promotion_id from promotions) m using (promotion_id)""")
def _(t):
    fact = t.sales.select("vente_id", "quantite", F.col("promo_key").alias("promotion_id"),
                          F.concat(F.lit("P"), F.substring("produit_key", 4, 6).cast("int")).alias("product_id"),
                          F.when(F.col("quantite") == 50, "inconnu").otherwise(F.concat(F.lit("C"), F.substring("client_key", 4, 6).cast("int"))).alias("customer_id"))
    promos = t.promotions.select("promo_key", F.col("promo_key").alias("promotion_id"))
    return (J.resolve_surrogate_keys(fact, [(t.products, "product_id", "produit_key"), (t.clients, "customer_id", "client_key"),
                                            (promos, "promotion_id", "promo_key")])
            .select("vente_id", "produit_key", "client_key", "promo_key", "quantite"))


@query("joi2_star_join", """
select vente_id, produit_key, ds, categorie, coalesce(m.remise_pct, 0)::int as remise_pct from sales s join products using (produit_key)
left join promotions m on m.promo_key = s.promo_key where ds is not null""")
def _(t):
    span = t.sales.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))  # the calendar of all sales
    return (J.star_join(t.sales, span.select(F.explode(F.sequence("lo", "hi")).alias("ds")), t.products, t.promotions)
            .select("vente_id", "produit_key", "ds", "categorie", "remise_pct"))


PROMO_PAIRS = """pp as (select produit_key, promo_key, portee, remise_pct, date_debut, date_fin from promotions join products on cible = product_id where portee = 'product'
  union all select produit_key, promo_key, portee, remise_pct, date_debut, date_fin from promotions join products on cible = categorie where portee = 'category'),
pd as (select produit_key, promo_key, portee, remise_pct, unnest(generate_series(date_debut, date_fin, interval 1 day))::date as ds from pp)"""


@query("joi3_expand_promotions", f"""
with {PROMO_PAIRS} select ds, portee, remise_pct, count(*) as n, count(distinct produit_key) as n_products, min(promo_key) as first_promo from pd group by all""")
def _(t):
    return (J.expand_promotions(t.promotions, t.products).groupBy("ds", "portee", "remise_pct")
            .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("produit_key").alias("n_products"), F.min("promo_key").alias("first_promo")))


@query("joi4_interval_overlap", f"""
with {PROMO_PAIRS}, {DECISIONS} select produit_key, ds from dec d where exists (select 1 from pp where pp.produit_key = d.produit_key
  and date_debut <= ds + 7 and date_fin >= ds)""")
def _(t):
    return J.overlaps_promotion(decisions(t), J.expand_promotions(t.promotions, t.products)).select("produit_key", "ds")


@query("joi5_campaign_overlap_count", f"""
with {PROMO_PAIRS}, e as (select produit_key, promo_key, date_debut, date_fin + 10 as date_fin from pp)
select a.produit_key, a.promo_key, count(*) as overlap_count, case when count(*) > 1 then 'overlap' else 'non_overlapping' end as overlap_status
from e a join e b on a.produit_key = b.produit_key and b.date_debut <= a.date_fin and b.date_fin >= a.date_debut group by 1, 2""")
def _(t):
    episodes = J.promotion_products(t.promotions, t.products).withColumn("date_fin", F.date_add("date_fin", 10))
    return J.overlap_count(episodes).select("produit_key", "promo_key", "overlap_count", "overlap_status")


@query("joi6_asof_last_before", f"""
with {DECISIONS}, st as (select produit_key, cast(ds as timestamp) + interval 9 hour as vu_le, niveau_stock from stock)
select d.produit_key, d.decision_timestamp, max(vu_le) as vu_le, arg_max(niveau_stock, vu_le) as niveau_stock
from dec d left join st on st.produit_key = d.produit_key and st.vu_le < d.decision_timestamp group by 1, 2""")
def _(t):
    levels = t.stock.select("produit_key", (F.col("ds").cast("timestamp") + F.expr("interval 9 hours")).alias("vu_le"), "niveau_stock")
    left = decisions(t).select("produit_key", "decision_timestamp")
    return J.asof_before(left, levels, ["produit_key"], "decision_timestamp", "vu_le", ["niveau_stock"], seconds=86400 * 30)


@query("joi7_stock_available_at", """
select produit_key, arg_max(niveau_stock, ds) as niveau_stock, arg_max(niveau_stock, ds) > 0 as disponible from stock
where ds <= date '2001-03-15' group by 1""")
def _(t):
    return J.stock_available_at(t.stock, F.lit("2001-03-15").cast("date"))


@query("joi8_count_before", f"""
with {DECISIONS}, v as (select produit_key, event_timestamp from web where event_type = 'view')
select d.produit_key, d.decision_timestamp, count(event_timestamp) as vues,
  count(case when event_timestamp >= decision_timestamp - interval 28 day then 1 end) as vues_28j
from dec d left join v on v.produit_key = d.produit_key and event_timestamp < decision_timestamp group by 1, 2""")
def _(t):
    left = decisions(t).select("produit_key", "decision_timestamp")
    views = t.web.filter("event_type = 'view'")
    return J.counts_before(left, views, ["produit_key"], "decision_timestamp", "event_timestamp", {"vues": F.lit(1)}, {"28j": 28})


@query("joi9_client_history_asof", f"""
with {IMPRESSIONS}, buys as (select client_key, categorie, cast(ds as timestamp) as vu from confirmed join products using (produit_key))
select recommendation_id, count(vu) as n_achats, count(case when vu >= impression_timestamp - interval 90 day then 1 end) as n_achats_90j,
  count(case when b.categorie = i.categorie then 1 end) as affinite_categorie,
  coalesce((epoch_us(impression_timestamp) - epoch_us(max(vu))) / 86400000000.0, 9999.0) as recence_jours
from imp i left join buys b on b.client_key = i.client_key and vu < impression_timestamp group by recommendation_id, impression_timestamp""")
def _(t):
    buys = t.confirmed.join(t.products.select("produit_key", "categorie"), "produit_key").select("client_key", "categorie", "ds")
    return J.client_history_asof(impressions(t), buys).select("recommendation_id", "n_achats", "n_achats_90j", "affinite_categorie", "recence_jours")


@query("joi10_product_popularity_asof", f"""
with {IMPRESSIONS} select recommendation_id, coalesce(sum(quantite), 0)::bigint as popularite,
  coalesce(sum(case when cast(ds as timestamp) >= impression_timestamp - interval 28 day then quantite end), 0)::bigint as popularite_28j
from imp i left join confirmed c on c.produit_key = i.produit_key and cast(c.ds as timestamp) < impression_timestamp group by 1""")
def _(t):
    return J.product_popularity_asof(impressions(t), t.confirmed).select("recommendation_id", "popularite", "popularite_28j")


@query("joi11_session_context", f"""
with {IMPRESSIONS}, u as (select session_id, 'a' w, appareil v from web where not est_bot union all select session_id, 's', source_trafic from web where not est_bot
  union all select session_id, 'c', canal from web where not est_bot), n as (select session_id, w, v, count(*) n from u group by all),
m as (select session_id, arg_min(v, (-n, v)) filter (w = 'a') appareil, arg_min(v, (-n, v)) filter (w = 's') source_trafic, arg_min(v, (-n, v)) filter (w = 'c') canal from n group by 1)
select recommendation_id, appareil, source_trafic, canal from imp left join m using (session_id)""")
def _(t):
    return J.session_context(impressions(t), t.web).select("recommendation_id", "appareil", "source_trafic", "canal")


@query("joi12_orphans", """
with k as (select produit_key, count(*) n from sales group by 1), d as (select produit_key from products where prix_base < 990)
select count(*) as n_keys, count(case when d.produit_key is null then 1 end) as n_orphan_keys, coalesce(sum(case when d.produit_key is null then n end), 0)::bigint as n_orphan_rows,
  'critique' as status from k left join d using (produit_key)""")
def _(t):
    return J.orphans(t.sales, "produit_key", t.products.filter("prix_base < 990"), "produit_key")


@query("joi13_web_orders_without_line", "select distinct order_id from web where order_id is not null and order_id not in (select order_id from sales)")
def _(t):
    return J.web_orders_without_line(t.web, t.sales)


@query("joi14_reconcile_sales_purchases", """
with a as (select distinct produit_key, client_key, ds from confirmed), b as (select distinct produit_key, client_key, cast(event_timestamp as date) as ds from web where event_type = 'purchase' and client_key is not null),
m as (select count(*) n from a join b using (produit_key, client_key, ds))
select n as n_match, (select count(*) from a) - n as n_sale_only, (select count(*) from b) - n as n_purchase_only,
  n / (select count(*) from a) as recall, n / (select count(*) from b) as "precision" from m""")
def _(t):
    buys = t.web.filter("event_type = 'purchase' and client_key is not null").select("produit_key", "client_key", F.to_date("event_timestamp").alias("ds"))
    return J.reconcile(t.confirmed, buys)


@query("joi15_order_set_equality", """
with a as (select distinct order_id from web where order_id is not null), b as (select distinct order_id from sales)
select (select count(*) from a where order_id not in (select order_id from b)) as only_web, (select count(*) from b where order_id not in (select order_id from a)) as only_sales, false as equal""")
def _(t):
    return J.order_set_equality(t.web, t.sales)


@query("joi16_cooccurrence", """
with b as (select distinct order_id, produit_key from confirmed)
select x.produit_key as a, y.produit_key as b, count(*) as n_commandes from b x join b y on x.order_id = y.order_id and x.produit_key < y.produit_key group by 1, 2""")
def _(t):
    return J.cooccurrence(t.confirmed)


@query("joi16_cooccurrence_categories_min_support", """
with b as (select distinct order_id, categorie || marque as k from confirmed join products using (produit_key))
select x.k as a, y.k as b, count(*) as n_commandes from b x join b y on x.order_id = y.order_id and x.k < y.k group by 1, 2 having count(*) >= 3""")
def _(t):
    lines = t.confirmed.join(t.products.select("produit_key", F.concat("categorie", "marque").alias("k")), "produit_key")
    return J.cooccurrence(lines, item="k", min_support=3)


@query("joi17_dense_calendar", "select unique_id, ds, y, ca, remise_pct from brand_days")
def _(t):
    return t.brand_days


@query("joi18_validated_join", """
select produit_key, count(*) as n, sum(niveau_stock)::bigint as niveau, sum(coalesce(y, 0))::bigint as y from stock left join pday using (produit_key, ds) group by 1""")
def _(t):
    sold = t.stock.select("produit_key", "ds").join(t.pday, ["produit_key", "ds"], "left").select("produit_key", "ds", F.coalesce("y", F.lit(0)).alias("y"))
    merged = J.validated_join(t.stock.select("produit_key", "ds", "niveau_stock"), sold, ["produit_key", "ds"])
    return merged.groupBy("produit_key").agg(F.count(F.lit(1)).alias("n"), F.sum("niveau_stock").alias("niveau"), F.sum("y").alias("y"))


@query("joi19_fallback_lookup", """
with d as (select produit_key, categorie, isodow(ds)::int - 1 as dow, y, ds from pday join products using (produit_key)),
tr as (select * from d where ds < date '1996-01-01'), p as (select produit_key, dow, avg(y) m from tr group by all), c as (select categorie, dow, avg(y) m from tr group by all)
select produit_key, ds, coalesce(p.m, c.m, (select avg(y) from tr)) as baseline from d left join p using (produit_key, dow) left join c using (categorie, dow) where ds >= date '1996-01-01'""")
def _(t):
    daily = t.pday.join(t.products.select("produit_key", "categorie"), "produit_key").withColumn("dow", F.weekday("ds"))
    cut = F.lit("1996-01-01").cast("date")
    return J.fallback_lookup(daily.filter(F.col("ds") >= cut), daily.filter(F.col("ds") < cut)).select("produit_key", "ds", "baseline")


@query("joi20_impression_within_session", f"""
with {IMPRESSIONS}, b as (select session_id, min(event_timestamp) lo, max(event_timestamp) hi from web group by 1)
select recommendation_id from (select *, impression_timestamp + interval (recommendation_id % 5) hour as ts2 from imp) join b using (session_id) where ts2 < lo or ts2 > hi""")
def _(t):
    moved = impressions(t).withColumn("impression_timestamp", F.expr("impression_timestamp + make_dt_interval(0, cast(recommendation_id % 5 as int))"))
    return J.impressions_outside_session(moved, t.web).select("recommendation_id")


@query("joi21_resolve_sale_dates", "select vente_id, ds from sales union all select vente_id, ds from sales")
def _(t):
    dim = t.sales.select(F.date_format("ds", "yyyyMMdd").alias("date_key"), F.col("ds").alias("date_complete")).distinct()
    keyed = t.sales.select("vente_id", F.date_format("ds", "yyyyMMdd").alias("k"))
    iso = t.sales.select("vente_id", F.col("ds").cast("string").alias("k"))
    return (J.resolve_sale_dates(keyed, "k", dim).select("vente_id", "ds")
            .unionByName(J.resolve_sale_dates(iso, "k", dim).select("vente_id", "ds")))


@query("joi22_enrich_sales", """
select vente_id, produit_key, quantite, categorie, marque from sales left join products using (produit_key)""")
def _(t):
    lines = require_columns(t.sales, ["produit_key"]).select("vente_id", "produit_key", "quantite")
    return J.enrich_sales(lines, "produit_key", t.products, ["product_id", "produit_key", "categorie"], ["categorie", "marque"])
