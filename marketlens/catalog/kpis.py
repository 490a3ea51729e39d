"""Business indicators."""
from pyspark.sql import functions as F

from marketlens.catalog.base import query
from marketlens.operators import kpis as K
from marketlens.operators.filters import star


def lines(t):
    return star(t.confirmed, t.products, t.clients)


L = "ln as (select c.*, categorie, marque, prix_base, cout, region, age_bracket, segment_fidelite from confirmed c left join products using (produit_key) left join clients using (client_key))"


@query("agg14_funnel_counts", """
select 'type' as axe, event_type as valeur, count(*) as n from web where not est_bot group by 2 union all select 'device', appareil, count(*) from web where not est_bot group by 2
union all select 'source', source_trafic, count(*) from web where not est_bot group by 2""")
def _(t):
    return K.funnel_counts(t.web)


KPI = f"""{L}, e as (select count(case when event_type = 'view' then 1 end) v, count(case when event_type = 'add_to_cart' then 1 end) c, count(case when event_type = 'purchase' then 1 end) p from web where not est_bot),
m as (select count(*) n from (select order_id from ln group by 1 having count(distinct produit_key) > 1)),
a as (select round(sum(montant_net), 4) as ca, round(sum(montant_net - cout * quantite), 4) as profit, sum(quantite)::bigint as qty, count(distinct order_id) as commandes, count(distinct client_key) as acheteurs,
  count(distinct produit_key) as produits, count(distinct promo_key) as promos, round(sum(case when promo_key is not null then montant_net end), 4) as promo_ca from ln)"""


@query("agg15_commerce_kpis", f"""
with {KPI} select ca, profit, qty, commandes, acheteurs, produits, promos, round(profit / ca * 100, 4) as margin_pct, round(ca / acheteurs, 4) as arpu, round(ca / commandes, 4) as panier_moyen, round(ca / acheteurs, 4) as clv,
  round(promo_ca / ca * 100, 4) as promo_share, round(m.n / commandes * 100, 4) as multi_pct, e.v as visitors, round(e.p / e.v * 100, 4) as conversion, round((1 - e.p / e.c) * 100, 4) as abandon_pct from a, e, m""")
def _(t):
    return K.commerce_kpis(lines(t), t.web)


@query("agg16_kpi_month_delta", f"""
with {L}, m as (select strftime(ds, '%Y-%m') as mois, round(sum(montant_net), 4) ca, sum(quantite) qty, count(distinct order_id) cmd from ln group by 1),
d as (select *, lag(ca) over (order by mois) pca, lag(qty) over (order by mois) pq, lag(cmd) over (order by mois) pc from m)
select mois, round((ca - pca) / abs(pca) * 100, 4) as ca_delta, round((cmd - pc) / abs(pc) * 100, 4) as commandes_delta, round((qty - pq) / abs(pq) * 100, 4) as qty_delta from d order by mois desc limit 1""")
def _(t):
    return K.kpi_month_delta(lines(t))


@query("agg17_revenue_timeseries", f"with {L} select strftime(ds, '%Y-%m') as mois, ds, round(sum(montant_net), 4) as ca, sum(quantite)::bigint as qty from ln group by grouping sets ((strftime(ds, '%Y-%m'), ds), (strftime(ds, '%Y-%m')))")
def _(t):
    return K.revenue_timeseries(lines(t))


@query("agg18_category_breakdown", f"""
with {L}, m as (select categorie, strftime(ds, '%Y-%m') as mois, round(sum(montant_net), 4) ca from ln group by 1, 2), mm as (select distinct mois from m order by mois desc limit 2),
x as (select categorie, round(sum(ca), 4) as ca, sum(case when mois = (select max(mois) from mm) then ca end) n, sum(case when mois = (select min(mois) from mm) then ca end) p from m group by 1)
select categorie, ca, case when p is null or p = 0 then 0.0 else round((coalesce(n, 0) - p) / abs(p) * 100, 4) end as delta from x""")
def _(t):
    return K.category_breakdown(lines(t))


@query("agg19_region_top8", f"with {L} select region, round(sum(montant_net), 4) as ca from ln group by 1 order by 2 desc, 1 limit 8")
def _(t):
    return K.region_top(lines(t))


@query("agg19_segment_revenue", f"with {L} select segment_fidelite, round(sum(montant_net), 4) as ca, count(distinct client_key) as clients from ln group by 1")
def _(t):
    return K.segment_revenue(lines(t))


@query("agg20_product_detail", f"with {L} select produit_key, sum(quantite)::bigint as qty, round(sum(montant_net), 4) as ca, count(*) as lignes, count(distinct order_id) as commandes, min(ds) as premiere, max(ds) as derniere from ln group by 1")
def _(t):
    return K.product_detail(lines(t))


RHYTHM = """rh as (select *, round(n_cmd / (jours_actif / 30.0), 2) as freq_mois, case when n_cmd > 1 then round(jours_actif / (n_cmd - 1), 1) else jours_actif::double end as jours_entre, ca_total / n_cmd as panier_moyen
  from (select client_key, count(distinct order_id) as n_cmd, min(ds) as premiere, max(ds) as derniere, round(sum(montant_net), 4) as ca_total, greatest(max(ds) - min(ds), 1)::int as jours_actif from confirmed group by 1)),
cs as (select *, case when ji >= 730 then 'churn' when ji >= 180 then 'inactif' when n_cmd >= 2 and (freq_mois >= 1.5 or jours_entre <= 14) then 'vip' else 'loyal' end as statut
  from (select *, greatest((select max(ds) from confirmed) - derniere, 0)::int as ji from rh))"""


@query("agg21_client_detail", f"""
with {RHYTHM} select client_key, sum(quantite)::bigint as qty, round(sum(montant_net), 4) as ca, count(*) as lignes, count(distinct order_id) as commandes, any_value(n_cmd) as n_cmd, any_value(premiere) as premiere,
  any_value(derniere) as derniere, any_value(freq_mois) as freq_mois, any_value(jours_entre) as jours_entre, any_value(panier_moyen) as panier_moyen from confirmed join rh using (client_key) where year(ds) = 2000 group by 1""")
def _(t):
    return K.client_detail(t.confirmed.filter(F.year("ds") == 2000), t.confirmed)


@query("agg22_client_status", f"with {RHYTHM} select client_key, n_cmd, freq_mois, jours_entre, ji as jours_inactif, statut from cs")
def _(t):
    ref = t.confirmed.agg(F.max("ds")).scalar()
    return K.client_status(K.purchase_rhythm(t.confirmed), ref).select("client_key", "n_cmd", "freq_mois", "jours_entre", "jours_inactif", "statut")


STOCK = "lt as (select produit_key, arg_max(niveau_stock, ds) lvl from stock group by 1)"


@query("agg23_stock_kpis", f"""
with {STOCK}, s as (select sum(lvl)::bigint as total_stock, count(*) n, count(case when lvl <= 0 then 1 end) r from lt), q as (select sum(quantite) q, count(distinct ds) d from confirmed)
select total_stock, round(total_stock / (q / d), 4) as stock_cover_days, round(q / total_stock, 4) as stock_rotation, round(r / n * 100, 4) as rupture_pct from s, q""")
def _(t):
    return K.stock_kpis(t.stock, t.confirmed)


@query("agg23_stock_alerts", f"with {STOCK} select produit_key, lvl as stock from lt where lvl < 40 order by lvl, produit_key limit 8")
def _(t):
    return K.stock_alerts(t.stock)


@query("agg24_data_quality_score", """
select round((avg((region is not null)::int) + avg((categorie is not null)::int) + avg((montant_net is not null)::int) + avg((ds is not null)::int)) / 4 * 100, 4) as data_quality
from sales left join (from products where marque <> 'Brand#3') using (produit_key) left join (from clients where region <> 'ASIA') using (client_key)""")
def _(t):
    return K.data_quality_score(star(t.sales, t.products.filter("marque <> 'Brand#3'"), t.clients.filter("region <> 'ASIA'")))


@query("agg37_filter_options", """
select 'categorie' as dimension, string_agg(v, '|' order by v) as valeurs from (select distinct categorie v from products) union all select 'marque', string_agg(v, '|' order by v) from (select distinct marque v from products)
union all select 'region', string_agg(v, '|' order by v) from (select distinct region v from clients) union all select 'segment_fidelite', string_agg(v, '|' order by v) from (select distinct segment_fidelite v from clients)
union all select 'age_bracket', string_agg(v, '|' order by v) from (select distinct age_bracket v from clients)""")
def _(t):
    return K.filter_options(t.products, t.clients)


@query("agg37_products_by_category", "select categorie, produit_key, row_number() over (partition by categorie order by produit_key)::int as rang from products qualify rang <= 400")
def _(t):
    return K.dependent_options(t.products, "categorie", "produit_key", 400)


@query("agg37_clients_by_region", "select region, client_key, row_number() over (partition by region order by client_key)::int as rang from clients qualify rang <= 800")
def _(t):
    return K.dependent_options(t.clients, "region", "client_key", 800)


@query("agg38_kpi_sheet", f"""
with {KPI}, {STOCK}, s as (select sum(lvl) ts, count(*) n, count(case when lvl <= 0 then 1 end) r from lt), q as (select sum(quantite) q, count(distinct ds) d from confirmed), {RHYTHM},
vip as (select coalesce(sum(ca_total), 0) v from cs where statut = 'vip')
select bloc, indicateur, unite, valeur::double as valeur, statut from (
  select 'Marge, prix & ventes' as bloc, 'Taux de marge brute' as indicateur, '%' as unite, round(profit / ca * 100, 4) as valeur, 'calculable' as statut from a union all
  select 'Marge, prix & ventes', 'Chiffre d’affaires net', 'F', ca, 'calculable' from a union all select 'Marge, prix & ventes', 'Panier moyen', 'F', round(ca / commandes, 4), 'calculable' from a union all
  select 'Stock & demande', 'Rotation des stocks', 'x', round(q / ts, 4), 'calculable' from s, q union all select 'Stock & demande', 'Couverture de stock', 'j', round(ts / (q / d), 4), 'calculable' from s, q union all
  select 'Stock & demande', 'Taux de rupture', '%', round(r / n * 100, 4), 'calculable' from s union all select 'Parcours d’achat en ligne', 'Taux de conversion', '%', round(e.p / e.v * 100, 4), 'calculable' from e union all
  select 'Parcours d’achat en ligne', 'Taux d’abandon de panier', '%', round((1 - e.p / e.c) * 100, 4), 'calculable' from e union all
  select 'Recommandation & ventes croisées', 'Part des paniers multi-produits', '%', round(m.n / commandes * 100, 4), 'calculable' from a, m union all select 'Clients & fidélisation', 'Valeur vie client', 'F', round(ca / acheteurs, 4), 'calculable' from a union all
  select 'Clients & fidélisation', 'CA segment VIP', '%', round(v / ca * 100, 4), 'calculable' from a, vip union all select 'Valeur du projet & responsabilité', 'Retour sur investissement (ROI)', '%', null, 'modele' union all
  select 'Valeur du projet & responsabilité', 'Qualité des données', '%', 100.0, 'calculable')""")
def _(t):
    ln = lines(t)
    k = K.commerce_kpis(ln, t.web)
    s = K.stock_kpis(t.stock, t.confirmed).select(F.struct("stock_cover_days", "stock_rotation", "rupture_pct")).scalar()
    ref = t.confirmed.agg(F.max("ds")).scalar()
    vip = K.client_status(K.purchase_rhythm(t.confirmed), ref).filter("statut = 'vip'").agg(F.coalesce(F.sum("ca_total"), F.lit(0.0))).scalar()
    quality = K.data_quality_score(ln).scalar()
    row = (k.withColumns({c: s.getField(c) for c in ("stock_cover_days", "stock_rotation", "rupture_pct")})
           .withColumn("ca_vip_share", K.pct(vip, F.col("ca"), 4)).withColumn("data_quality", quality))
    return K.kpi_sheet(row)
