"""Projections, filters, predicates."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.catalog.base import query
from marketlens.functions import scalar as S
from marketlens.operators import filters as O
from marketlens.sources.lake import canonical_category


@query("fil1_valid_lines", "select vente_id, produit_key, quantite, statut_commande from sales where statut_commande not in ('annulee', 'retournee')")
def _(t):
    return O.valid_lines(t.sales).select("vente_id", "produit_key", "quantite", "statut_commande")


@query("fil2_exclude_bots", "select event_id, event_type, produit_key from web where not est_bot")
def _(t):
    return O.exclude_bots(t.web).select("event_id", "event_type", "produit_key")


@query("fil3_exclude_bot_sessions", "select event_id, session_id from web where session_id not in (select session_id from web where est_bot or event_id % 97 = 0)")
def _(t):
    web = t.web.withColumn("est_bot", F.col("est_bot") | (F.col("event_id") % 97 == 0))
    return O.exclude_bot_sessions(web).select("event_id", "session_id")


@query("fil4_eligible_web_history", """
select event_id, client_key from web where client_key is not null and event_timestamp < timestamp '2001-01-20' and event_type <> 'purchase'""")
def _(t):
    inter = t.web.withColumn("type_identite", F.when(F.col("client_key").isNotNull(), "client").otherwise("anonyme"))
    return O.eligible_web_history(inter, F.lit("2001-01-20").cast("timestamp")).select("event_id", "client_key")


@query("fil5_canonical_category", """
with s as (select produit_key, case when substr(produit_key, 9, 1) = '7' then lower(categorie) else '  ' || categorie end as raw from products),
n as (select lower(trim(raw)) low, trim(raw) sp, count(*) n from s group by all), b as (select low, arg_min(sp, (-n, sp)) canon from n group by low)
select produit_key, canon as categorie from s join b on lower(trim(raw)) = low""")
def _(t):
    raw = t.products.select("produit_key", F.when(F.substring("produit_key", 9, 1) == "7", F.lower("categorie"))
                            .otherwise(F.concat(F.lit("  "), "categorie")).alias("categorie"))
    return canonical_category(raw, "categorie")


@query("fil6_default_unknown", """
select client_key, coalesce(case when region <> 'ASIA' then region end, 'Non renseigné') as region,
  coalesce(case when age_bracket <> 'A3' then age_bracket end, 'Non renseigné') as age_bracket from clients""")
def _(t):
    unknown = F.lit(S.UNKNOWN_LABEL)
    return t.clients.select("client_key", F.coalesce(F.when(F.col("region") != "ASIA", F.col("region")), unknown).alias("region"),
                            F.coalesce(F.when(F.col("age_bracket") != "A3", F.col("age_bracket")), unknown).alias("age_bracket"))


STAR = """lines as (select s.*, product_name, categorie, marque, region, age_bracket, segment_fidelite
from sales s left join products using (produit_key) left join clients using (client_key))"""


@query("fil7_filter_sales", f"""
with {STAR} select vente_id, produit_key, client_key, ds, quantite from lines
where categorie = 'ECONOMY' and year(ds) = 1999 and isodow(ds) < 6 and promo_key is not null and statut_commande = 'confirmee'
and contains(lower(concat_ws(' ', order_id, produit_key, product_name, categorie, marque, client_key, region)), 'red')""")
def _(t):
    lines = O.star(t.sales, t.products, t.clients)
    return (O.filter_sales(lines, category="ECONOMY", year=1999, weekend="no", promo="yes", status="confirmee", text="Red")
            .select("vente_id", "produit_key", "client_key", "ds", "quantite"))


@query("fil7_filter_sales_period", f"""
with {STAR}, f as (select * from lines where region = 'ASIA' and segment_fidelite = 'MACHINERY')
select vente_id, produit_key, ds from f where ds > (select max(ds) from f) - 183""")
def _(t):
    lines = O.star(t.sales, t.products, t.clients)
    return O.filter_sales(lines, region="ASIA", segment="MACHINERY", period="6m").select("vente_id", "produit_key", "ds")


@query("fil8_filter_stock", """
select case when niveau_stock <= 0 then 'rupture' when niveau_stock < 40 then 'faible' else 'ok' end as statut_stock, count(*) as n,
  sum(niveau_stock)::bigint as total from stock group by 1""")
def _(t):
    return O.filter_stock(t.stock).groupBy("statut_stock").agg(F.count(F.lit(1)).alias("n"), F.sum("niveau_stock").alias("total"))


@query("fil9_period_bounds", """
select p as period, max(ds) - (d - 1)::int as start, max(ds) as "end" from sales, (values ('30d', 30), ('3m', 92), ('6m', 183), ('1y', 365)) v(p, d) group by p, d""")
def _(t):
    out = None
    for period in O.PERIOD_DAYS:
        part = O.period_bounds(t.sales, period).withColumn("period", F.lit(period))
        out = part if out is None else out.union(part)
    return out


@query("fil10_net_quantity", """
select vente_id, produit_key, case statut_commande when 'annulee' then 0 when 'retournee' then -abs(quantite) else quantite end as net from sales""")
def _(t):
    return t.sales.select("vente_id", "produit_key", O.net_quantity(F.col("quantite"), F.col("statut_commande")).alias("net"))


@query("fil11_pricing_columns", """
with p as (select d.*, prix_base, cout, case when y > 0 then ca / y end as paid from pday d join products using (produit_key))
select produit_key, ds, paid as prix_paye, 100 * (1 - paid / prix_base) as remise_appliquee_pct, paid - cout as marge_unitaire,
  (paid - cout) * y as marge_totale, (paid - cout) / paid as taux_marge from p""")
def _(t):
    df = O.pricing_columns(t.pday.join(t.products.select("produit_key", "prix_base", "cout"), "produit_key"))
    return df.select("produit_key", "ds", "prix_paye", "remise_appliquee_pct", "marge_unitaire", "marge_totale", "taux_marge")


@query("fil12_realised_vs_expected", """
select produit_key, ds, case when y > 0 then ca / y end as prix_realise, prix_base * (1 - remise_pct / 100) as prix_attendu
from pday join products using (produit_key)""")
def _(t):
    df = O.realised_vs_expected(t.pday.join(t.products.select("produit_key", "prix_base"), "produit_key"))
    return df.select("produit_key", "ds", "prix_realise", "prix_attendu")


@query("fil13_price_is_eligible", """
select produit_key, d as remise_pct, prix_base * (1 - d / 100) >= cout and prix_base * (1 - d / 100) > 0
  and (prix_base * (1 - d / 100) - cout) / (prix_base * (1 - d / 100)) >= 0.05 as eligible
from products, (select distinct remise_pct as d from sales)""")
def _(t):
    levels = t.sales.agg(F.collect_set("remise_pct")).scalar()  # eleven discount levels
    grid = t.products.withColumn("remise_pct", F.explode(levels))
    return grid.select("produit_key", "remise_pct", S.price_is_eligible(F.col("prix_base"), F.col("cout"), F.col("remise_pct")).alias("eligible"))


@query("fil14_local_day", """
select event_id, cast(event_timestamp as date) as jour_dakar, cast(event_timestamp + interval 9 hour as date) as jour_tokyo from web""")
def _(t):
    return t.web.select("event_id", S.local_day(F.col("event_timestamp")).alias("jour_dakar"),
                        S.local_day(F.col("event_timestamp"), "Asia/Tokyo").alias("jour_tokyo"))


@query("fil15_identity_key", "select event_id, coalesce(client_key, 'ANON:' || anonymous_id) as identite from web")
def _(t):
    return t.web.select("event_id", S.identity_key(F.col("client_key"), F.col("anonymous_id")).alias("identite"))


@query("fil16_parse_date_key", "select vente_id, ds as from_key, ds as from_iso from sales")
def _(t):
    df = t.sales.select("vente_id", F.date_format("ds", "yyyyMMdd").alias("k"), F.date_format("ds", "yyyy-MM-dd").alias("iso"))
    return S.parse_date_key(S.parse_date_key(df, "k", "from_key"), "iso", "from_iso").select("vente_id", "from_key", "from_iso")


@query("fil17_require_tz_utc", "select event_id, date_trunc('second', event_timestamp) - interval 2 hour as instant from web")
def _(t):
    text = F.concat(F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return t.web.select("event_id", S.require_tz_utc(text).alias("instant"))
