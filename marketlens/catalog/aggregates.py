"""Aggregations over sales, web events and product-day panels."""
from pyspark.sql import functions as F

from marketlens.catalog.base import digest, digest_sql, query
from marketlens.functions.scalar import r
from marketlens.operators import aggregates as A
from marketlens.operators import grids
from marketlens.operators import joins as J

TYPES = ("view", "click", "add_to_cart", "purchase", "error")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("agg1_daily_sales_by_product", """
select produit_key, ds as date, sum(quantite)::bigint as quantity, round(sum(montant_net), 4) as revenue
from sales group by produit_key, ds""")
def _(t):
    return A.daily_sales_by_product(t.sales)


@query("agg2_product_performance", """
select produit_key, sum(quantite)::bigint as total_qty, round(sum(montant_net), 4) as total_revenue, round(avg(montant_net / quantite), 6) as avg_price,
  count(*) as n_orders from sales group by 1""")
def _(t):
    return A.product_performance(t.sales)


@query("agg3_sales_daily", """
select client_key as unique_id, ds, sum(quantite)::bigint as y, round(sum(montant_net), 4) as ca, count(*) as n_transactions from sales group by 1, 2""")
def _(t):
    return A.sales_daily(t.sales, "client_key")


WEBD = """wd as (select produit_key, cast(event_timestamp as date) as ds, count(case when event_type = 'view' then 1 end) as web_view,
  count(case when event_type = 'click' then 1 end) as web_click, count(case when event_type = 'add_to_cart' then 1 end) as web_add_to_cart,
  count(case when event_type = 'purchase' then 1 end) as web_purchase, count(case when event_type = 'error' then 1 end) as web_error, count(*) as web_total from web group by 1, 2),
ws as (select produit_key, min(ds) as web_debut, max(ds) as web_fin from wd group by 1)"""


@query("agg4_web_daily", f"with {WEBD} select * from wd join ws using (produit_key)")
def _(t):
    return A.web_daily(t.web, TYPES)


FILLED = ["niveau_stock", "web_view", "web_total", "web_data_observed"]


@query("agg5_web_observed_fill", f"""
with {WEBD}, x as (select produit_key, niveau_stock, case when ds between web_debut and web_fin then coalesce(web_view, 0) end as web_view,
  case when ds between web_debut and web_fin then coalesce(web_total, 0) end as web_total, coalesce(ds between web_debut and web_fin, false)::int as web_data_observed
from stock left join wd using (produit_key, ds) left join ws using (produit_key)) """ + digest_sql("x", ["produit_key"], FILLED))
def _(t):
    return digest(A.web_observed_fill(t.stock.select("produit_key", "ds", "niveau_stock"), t.web, TYPES), ["produit_key"], FILLED)


@query("agg6_product_day_pricing", """
select produit_key, ds, categorie, marque, prix_base, cout, remise_pct, sum(quantite)::bigint as quantite, round(sum(montant_net), 4) as ca, count(*) as n_lignes,
  round(round(sum(montant_net), 4) - cout * sum(quantite), 4) as marge, round(sum(montant_net), 4) / sum(quantite) as prix_paye
from confirmed join products using (produit_key) group by produit_key, ds, categorie, marque, prix_base, cout, remise_pct""")
def _(t):
    return A.product_day_pricing(t.confirmed, t.products)


BASKETS = """bl as (select order_id, produit_key, sum(quantite)::bigint as quantite, round(sum(montant_net), 4) as montant_net, min(client_key) as client_key, min(ds) as date_commande
  from confirmed group by 1, 2), bt as (select order_id, count(*) as taille_panier_lignes, sum(quantite)::bigint as taille_panier_unites, round(sum(montant_net), 4) as montant_commande,
  count(distinct categorie) as n_categories_commande from bl join products using (produit_key) group by 1)"""


@query("agg7_order_baskets", f"""
with {BASKETS} select bl.*, categorie, taille_panier_lignes, taille_panier_unites, montant_commande, n_categories_commande, taille_panier_lignes > 1 as est_multi_produit
from bl join bt using (order_id) join products using (produit_key)""")
def _(t):
    return A.order_baskets(t.sales, t.products)


INTER = """it as (select coalesce(client_key, anonymous_id) as identite, case when client_key is not null then 'client' else 'anonyme' end as type_identite, produit_key, event_timestamp, event_type,
  case event_type when 'view' then 1.0 when 'click' then 2.0 when 'add_to_cart' then 3.0 when 'purchase' then 5.0 else 0.0 end::double as poids_base, 0.5::double * coalesce(quantity, 0) as poids_quantite,
  pow(0.5::double, greatest((epoch_us(timestamp '2001-01-20') - epoch_us(event_timestamp)) / 86400000000.0::double, 0.0::double) / 30.0::double) as poids_recence from web where not est_bot)"""


def _inter(t):
    return A.interactions(t.web, quantity_weight=0.5, half_life=30.0, reference=F.lit("2001-01-20").cast("timestamp"))


@query("agg8_interactions", f"""
with {INTER} select identite, type_identite, produit_key, event_timestamp, event_type, poids_base, poids_quantite, round(poids_recence, 8) as poids_recence,
  round((poids_base + poids_quantite) * poids_recence, 8) as poids_total from it""")
def _(t):
    return _inter(t).drop("quantity").withColumn("poids_recence", r("poids_recence", 8)).withColumn("poids_total", r("poids_total", 8))


@query("agg9_user_item_matrix", f"""
with {INTER} select identite, produit_key, round(sum((poids_base + poids_quantite) * poids_recence), 8) as poids_cumule, count(*) as n_interactions, max(event_timestamp) as derniere_interaction
from it group by 1, 2""")
def _(t):
    return A.user_item_matrix(_inter(t)).withColumn("poids_cumule", r("poids_cumule", 8))


FEATURES = """grid as (select unique_id, d::date as ds from (select produit_key as unique_id, unnest(generate_series(min(ds), (select max(ds) from pday), interval 1 day)) d from pday group by 1)),
full_grid as (select g.unique_id, g.ds, coalesce(y, 0) as y, coalesce(ca, 0.0) as ca from grid g left join pday p on p.produit_key = g.unique_id and p.ds = g.ds),
feat as (select unique_id, min(ds) as debut, max(ds) as fin, count(*)::int as n_jours, sum(y)::bigint as total, avg(y) as moyenne, stddev_samp(y) as ecart_type, max(y)::bigint as maximum,
  round(sum(ca), 4) as ca, count(case when y > 0 then 1 end) as n_jours_vente, avg(case when y > 0 then y end) as taille_demande_moy, stddev_samp(case when y > 0 then y end) as taille_demande_ecart,
  max(case when y > 0 then ds end) as derniere_vente from full_grid group by 1),
feats as (select *, 1 - n_jours_vente / n_jours as taux_jours_sans_vente, (fin - derniere_vente)::int as jours_inactivite, n_jours / nullif(n_jours_vente, 0) as adi,
  pow(taille_demande_ecart / nullif(taille_demande_moy, 0), 2) as cv2, ecart_type / nullif(moyenne, 0) as cv_serie from feat)"""


CLASSES = FEATURES + """,
prof as (select *, case when adi is null or cv2 is null then 'indetermine' when adi < 1.32 and cv2 < 0.49 then 'regulier' when adi >= 1.32 and cv2 < 0.49 then 'intermittent'
  when adi < 1.32 then 'erratique' else 'grumeleux' end as profil_demande, case when jours_inactivite > 60 then 'inactif' when n_jours < 90 then 'nouveau' when n_jours_vente < 12 then 'historique_insuffisant' else 'actif' end as statut,
  sum(ca) over (order by ca desc, unique_id) / sum(ca) over () as part_cumulee from feats),
cls as (select *, case when part_cumulee <= 0.8 then 'A' when part_cumulee <= 0.95 then 'B' else 'C' end as classe_abc, case when cv_serie <= 0.5 then 'X' when cv_serie <= 1.0 then 'Y' else 'Z' end as classe_xyz,
  case when statut in ('nouveau', 'historique_insuffisant') or n_jours < 90 then 'demarrage_a_froid' when profil_demande in ('intermittent', 'grumeleux') then 'intermittent' else 'standard' end as groupe_strategie from prof)"""


def _features(t):
    return A.series_features(t.pday.withColumnRenamed("produit_key", "unique_id"))


@query("agg10_series_features", f"""
with {FEATURES} select unique_id, debut, fin, n_jours, total, round(moyenne, 6) as moyenne, round(ecart_type, 6) as ecart_type, maximum, ca, n_jours_vente, round(taille_demande_moy, 6) as taille_demande_moy,
  round(taille_demande_ecart, 6) as taille_demande_ecart, derniere_vente, round(taux_jours_sans_vente, 6) as taux_jours_sans_vente, jours_inactivite, round(adi, 6) as adi, round(cv2, 6) as cv2, round(cv_serie, 6) as cv_serie from feats""")
def _(t):
    f = _features(t)
    return f.withColumns({c: r(c) for c in ("moyenne", "ecart_type", "taille_demande_moy", "taille_demande_ecart", "taux_jours_sans_vente", "adi", "cv2", "cv_serie")})


@query("agg11_series_profile", """
with p as (select produit_key as unique_id, min(ds) as premiere_vente, max(ds) as derniere_vente, count(distinct ds) as n_jours_avec_vente, sum(y)::bigint as total, avg(y) as moyenne, max(y)::bigint as maximum, min(y)::bigint as minimum,
  count(case when y > 0 then 1 end) as n_demandes, stddev_samp(case when y > 0 then y end) / avg(case when y > 0 then y end) as cv from pday group by 1),
s as (select *, (derniere_vente - premiere_vente + 1)::int as span_jours, ((select max(ds) from pday) - derniere_vente)::int as jours_depuis_derniere_vente from p),
c as (select *, 1 - n_jours_avec_vente / span_jours as taux_jours_sans_vente, span_jours / n_demandes as adi, pow(cv, 2) as cv2 from s),
l as (select *, case when adi is null or cv2 is null then 'indetermine' when adi < 1.32 and cv2 < 0.49 then 'regulier' when adi >= 1.32 and cv2 < 0.49 then 'intermittent' when adi < 1.32 then 'erratique' else 'grumeleux' end as profil_demande,
  case when span_jours < 90 then 'nouveau_ou_trop_court' when n_demandes < 12 then 'historique_insuffisant' when jours_depuis_derniere_vente > 60 then 'inactif_ou_abandonne' else 'actif' end as statut_cycle_vie from c)
select * exclude (cv, cv2), round(cv2, 6) as cv2, statut_cycle_vie = 'actif' and profil_demande <> 'indetermine' as modelisable_ml from l""")
def _(t):
    return A.series_profile(t.pday.withColumnRenamed("produit_key", "unique_id")).withColumn("cv2", r("cv2"))


@query("agg12_classify_demand", f"""
with {CLASSES} select unique_id, profil_demande, statut, round(part_cumulee, 8) as part_cumulee, classe_abc, classe_xyz, classe_abc || classe_xyz as classe_abc_xyz, groupe_strategie from cls""")
def _(t):
    return A.classify_demand(_features(t)).select("unique_id", "profil_demande", "statut", r("part_cumulee", 8).alias("part_cumulee"), "classe_abc", "classe_xyz", "classe_abc_xyz", "groupe_strategie")


@query("agg13_segmentation_summary", f"""
with {CLASSES}, u as (unpivot (select unique_id, total, ca, taux_jours_sans_vente, profil_demande, statut, classe_abc, classe_xyz, groupe_strategie from cls)
  on profil_demande, statut, classe_abc, classe_xyz, groupe_strategie into name axe value valeur)
select axe, valeur, count(*) as n_series, sum(total)::bigint as volume, round(sum(ca), 4) as ca, round(avg(taux_jours_sans_vente), 6) as taux_zero_moyen,
  count(*) / (select count(*) from cls) as part_series, sum(total) / (select sum(total) from cls) as part_volume from u group by all""")
def _(t):
    return A.segmentation_summary(A.classify_demand(_features(t))).withColumn("taux_zero_moyen", r("taux_zero_moyen"))


@query("agg13_abc_xyz_matrix", f"""
with {CLASSES} select classe_abc, count(case when classe_xyz = 'X' then 1 end) as "X", count(case when classe_xyz = 'Y' then 1 end) as "Y", count(case when classe_xyz = 'Z' then 1 end) as "Z" from cls group by 1""")
def _(t):
    return A.abc_xyz_matrix(A.classify_demand(_features(t)))


@query("agg25_most_frequent_discount", """
with n as (select produit_key, remise_pct, count(*) n from confirmed group by all) select produit_key, arg_min(remise_pct, (-n, remise_pct)) as remise from n group by 1""")
def _(t):
    return A.most_frequent(t.confirmed, ["produit_key"], "remise_pct", "remise")


@query("agg25_most_frequent_discount_category", """
with n as (select categorie, remise_pct, count(*) n from panel group by all) select categorie, arg_min(remise_pct, (-n, remise_pct)) as remise from n group by 1""")
def _(t):
    return A.most_frequent(t.panel, ["categorie"], "remise_pct", "remise")


BEST = """lv as (select produit_key, remise_pct, avg(y) m, count(*) n from panel group by all),
bd as (select produit_key, coalesce(arg_min(remise_pct, (-m, remise_pct)) filter (n >= 3), 0)::int as best_descriptive from lv group by 1)"""


@query("agg26_best_descriptive_discount", f"with {BEST} select * from bd")
def _(t):
    return A.best_descriptive_discount(t.panel, 3)


@query("agg27_all_baselines", f"""
with {BEST}, p as (select produit_key, arg_min(remise_pct, (-n, remise_pct)) as frequent_product from (select produit_key, remise_pct, count(*) n from panel group by all) group by 1),
c as (select categorie, arg_min(remise_pct, (-n, remise_pct)) as frequent_category from (select categorie, remise_pct, count(*) n from panel group by all) group by 1)
select produit_key, categorie, ds, remise_pct as observed, 0 as zero, frequent_product, frequent_category, best_descriptive
from panel join p using (produit_key) join c using (categorie) join bd using (produit_key)""")
def _(t):
    return A.all_baselines(t.panel, 3)


@query("agg28_observed_discount_grid", "select remise_pct as level, count(*) as n from panel where en_promotion group by 1 having count(*) >= 50")
def _(t):
    return A.observed_discount_grid(t.panel)


@query("agg29_pricing_panel", """
select produit_key, ds, remise_pct, y, stock_disponible_lag1, isodow(ds)::int - 1 as jour_semaine, month(ds)::int as mois, round(ln(1 + y), 8) as log1p_y
from panel left join (select produit_key, ds, lag(niveau_stock) over (partition by produit_key order by ds) as stock_disponible_lag1 from stock) using (produit_key, ds)""")
def _(t):
    from pyspark.sql import Window
    lag = t.stock.withColumn("stock_disponible_lag1", F.lag("niveau_stock").over(Window.partitionBy("produit_key").orderBy("ds")))
    return A.pricing_panel(t.panel, lag).select("produit_key", "ds", "remise_pct", "y", "stock_disponible_lag1", "jour_semaine", "mois", r("log1p_y", 8).alias("log1p_y"))


@query("agg30_discount_support_table", """
with pl as (select distinct produit_key from panel where not en_promotion)
select remise_pct, count(distinct produit_key) as produits_exposes, count(*) as jours, sum(y)::bigint as ventes_totales, count(distinct categorie) as n_categories,
  count(distinct date_trunc('month', ds)) as mois_couverts, count(distinct case when produit_key in (from pl) then produit_key end) as support_commun,
  count(distinct case when produit_key in (from pl) then produit_key end) / count(distinct produit_key) as pct_support_commun from panel where en_promotion group by 1""")
def _(t):
    return A.discount_support_table(t.panel)


@query("agg31_discount_eligibility", """
with g as (select produit_key, min(categorie) as categorie, count(case when en_promotion then 1 end) as jours_promo, count(case when not en_promotion then 1 end) as jours_hors_promo,
  count(distinct case when en_promotion then remise_pct end) as niveaux_reels, sum(y)::bigint as volume, coalesce(max(case when en_promotion then ds end) - min(case when en_promotion then ds end) + 1, 0)::int as etalement,
  count(distinct case when en_promotion then date_trunc('month', ds) end) as mois_couverts from panel group by 1),
f as (select *, concat_ws(', ', case when jours_promo < 10 then 'jours_promo' end, case when jours_hors_promo < 6 then 'jours_hors_promo' end, case when niveaux_reels < 2 then 'niveaux_reels' end,
  case when volume < 50 then 'volume' end, case when etalement < 60 then 'etalement' end, case when mois_couverts < 2 then 'mois_couverts' end) as failed from g)
select * exclude (failed), case when failed = '' then 'eligible_individuel' when jours_promo >= 1 and volume >= 20 then 'eligible_pooling_categorie' else 'non_eligible' end as groupe,
  case when failed = '' then 'tous les critères' when jours_promo = 0 then 'aucune promotion' else failed end as raison from f""")
def _(t):
    return A.discount_eligibility(t.panel, {**A.ELIGIBILITY, "jours_promo": 10, "jours_hors_promo": 6})


NEG = """neg as (select *, (ca / y - cout) as mu, ca - cout * y as mt, prix_base * (1 - remise_pct / 100) >= cout as bruit from panel where y > 0 and ca / y - cout < 0)"""


@query("agg32_negative_margin_report", f"""
with {NEG} select remise_pct, categorie, count(*) as n_lignes, count(distinct produit_key) as n_produits, round(sum(ca), 4) as ca, round(sum(mt), 4) as perte_totale, count(case when bruit then 1 end) as n_bruit,
  count(case when bruit then 1 end) / count(*) as part_bruit from neg group by grouping sets ((remise_pct), (categorie), ())""")
def _(t):
    return A.negative_margin_report(t.panel)


@query("agg32_negative_margin_campaigns", f"""
with {NEG}, pp as (select produit_key, promo_key, portee, date_debut, date_fin from promotions join products on cible = product_id where portee = 'product'
  union all select produit_key, promo_key, portee, date_debut, date_fin from promotions join products on cible = categorie where portee = 'category')
select promo_key, portee, count(*) as n_lignes, round(sum(mt), 4) as perte_totale from neg join pp on neg.produit_key = pp.produit_key and ds between date_debut and date_fin group by 1, 2""")
def _(t):
    return A.negative_margin_campaigns(t.panel, J.expand_promotions(t.promotions, t.products))


@query("agg33_level_support", "select remise_pct, count(*) as n_lignes, count(distinct produit_key) as n_produits, sum(y)::bigint as unites, count(*) / (select count(*) from panel) as part from panel group by 1")
def _(t):
    return A.level_support_audit(t.panel)


@query("agg33_grain_audit", """
select count(*) as n_lignes, count(distinct (produit_key, ds)) as n_cellules, count(distinct produit_key) as n_produits, count(distinct ds) as n_jours,
  count(distinct (produit_key, ds)) / (count(distinct produit_key) * count(distinct ds)) as taux_remplissage from panel""")
def _(t):
    return A.grain_audit(t.panel)


@query("agg33_support_quantiles", """
select quantile_cont(n, 0.1) as p10, quantile_cont(n, 0.5) as p50, quantile_cont(n, 0.9) as p90 from (select produit_key, remise_pct, count(*)::double as n from panel group by 1, 2)""")
def _(t):
    return A.support_quantiles(t.panel)


@query("agg33_monthly_promo_share", "select date_trunc('month', ds)::date as mois, count(*) as n, count(case when en_promotion then 1 end) as n_promo, count(case when en_promotion then 1 end) / count(*) as part_promo from panel group by 1")
def _(t):
    return A.monthly_promo_share(t.panel)


@query("agg34_uplift_stability", """
with p as (select *, case when ds < date '1998-06-01' then 'p1' else 'p2' end as periode from panel), b as (select periode, avg(y) base from p where not en_promotion group by 1),
l as (select periode, remise_pct, avg(y) / any_value(base) as uplift from p join b using (periode) where en_promotion group by 1, 2 having count(*) >= 30)
select remise_pct, max(case when periode = 'p1' then uplift end) as p1, max(case when periode = 'p2' then uplift end) as p2,
  abs(max(case when periode = 'p2' then uplift end) - max(case when periode = 'p1' then uplift end)) / max(case when periode = 'p1' then uplift end) as ecart_relatif from l group by 1""")
def _(t):
    return A.uplift_stability(t.panel, F.lit("1998-06-01").cast("date"))


@query("agg35_order_and_segment_daily", """
with b as (select order_id, sum(quantite) as basket from confirmed group by 1)
select produit_key, ds, count(distinct order_id) as order_count, count(distinct client_key) as distinct_clients, avg(basket) as avg_basket_quantity,
  sum(case when segment_fidelite = 'AUTOMOBILE' then quantite else 0 end)::bigint as q_automobile, sum(case when segment_fidelite = 'BUILDING' then quantite else 0 end)::bigint as q_building,
  sum(case when segment_fidelite = 'FURNITURE' then quantite else 0 end)::bigint as q_furniture, sum(case when segment_fidelite = 'HOUSEHOLD' then quantite else 0 end)::bigint as q_household,
  sum(case when segment_fidelite = 'MACHINERY' then quantite else 0 end)::bigint as q_machinery
from confirmed join b using (order_id) left join clients using (client_key) group by 1, 2""")
def _(t):
    return A.order_and_segment_daily(t.confirmed, t.clients, SEGMENTS)


@query("agg36_train_scales", """
with d as (select unique_id, y - lag(y, 7) over (partition by unique_id order by ds) as d from brand_days where ds < date '2001-01-01')
select unique_id, avg(abs(d)) as mae_scale, round(sqrt(avg(d * d)), 8) as rms_scale from d group by 1""")
def _(t):
    return A.train_scales(t.brand_days.filter("ds < date '2001-01-01'")).withColumn("rms_scale", r("rms_scale", 8))


@query("agg39_scd_versions", """
with v as (select product_id, valid_from, case when k = 0 then valid_from + 100 + (substr(product_id, 2)::int % 3 - 1) * 5 end as valid_to, k = 1 or substr(product_id, 2)::int % 11 = 0 as is_current from
  (select product_id, valid_from + 100 * k + k as valid_from, k from products, (values (0), (1)) t(k))),
n as (select *, lead(valid_from) over (partition by product_id order by valid_from, valid_to) nx from v),
g as (select product_id, count(*) nv, count(case when is_current then 1 end) nc, count(case when valid_to < valid_from then 1 end) ni, count(case when nx <= valid_to then 1 end) no, count(case when nx > valid_to + 1 then 1 end) ng from n group by 1)
select count(*) as n_ids, sum(nv)::bigint as n_versions, count(case when nv > 1 then 1 end) as ids_multi_version, count(case when nc > 1 then 1 end) as ids_multi_current, count(case when nc = 0 then 1 end) as ids_no_current,
  sum(ni)::bigint as n_inverted, sum(no)::bigint as n_overlaps, sum(ng)::bigint as n_gaps from g""")
def _(t):
    k = grids.repeat_per(t.products.select("product_id", "valid_from"), "k", [0, 1])
    num = F.substring("product_id", 2, 9).cast("int")
    v = (k.withColumn("valid_from", F.expr("date_add(valid_from, 101 * k)"))
         .withColumn("valid_to", F.when(F.col("k") == 0, F.date_add("valid_from", 100 + (num % 3 - 1) * 5)))
         .withColumn("is_current", (F.col("k") == 1) | (num % 11 == 0)))
    return A.scd_versions(v, "product_id")


@query("agg40_price_amplitude", """
with s as (select produit_key, ds, y::double as y, ca / y as p, en_promotion from panel where y > 0)
select produit_key, min(p) as prix_min, max(p) as prix_max, round(covar_pop(p, y) filter (not en_promotion) / nullif(stddev_pop(p) filter (not en_promotion) * stddev_pop(y) filter (not en_promotion), 0), 6) as corr, round(covar_pop(p, y) filter (not en_promotion and ds < date '1998-06-01') / nullif(stddev_pop(p) filter (not en_promotion and ds < date '1998-06-01') * stddev_pop(y) filter (not en_promotion and ds < date '1998-06-01'), 0), 6) as corr_p1,
  round(covar_pop(p, y) filter (not en_promotion and ds >= date '1998-06-01') / nullif(stddev_pop(p) filter (not en_promotion and ds >= date '1998-06-01') * stddev_pop(y) filter (not en_promotion and ds >= date '1998-06-01'), 0), 6) as corr_p2 from s group by 1""")
def _(t):
    return A.price_amplitude_and_correlation(t.panel, F.lit("1998-06-01").cast("date"))


@query("agg40_response_by_level", "select (round(remise_pct / 5.0, 0) * 5)::int as niveau, count(*) as n, avg(y) as q_moy from panel group by 1")
def _(t):
    return A.response_by_level(t.panel)


@query("agg41_interaction_density", """
with c as (select client_key, count(*)::double as n, count(distinct produit_key)::double as d from confirmed group by 1),
b as (select count(distinct client_key) as clients_actifs, count(distinct produit_key) as produits_vendus, count(distinct (client_key, produit_key)) as n_paires from confirmed)
select b.*, clients_actifs / (select count(*) from clients) as part_clients_actifs, produits_vendus / (select count(*) from products) as part_produits_vendus, 1 - n_paires / (clients_actifs * produits_vendus) as sparsite,
  (select quantile_cont(n, 0.1) from c) as lignes_p10, (select quantile_cont(n, 0.5) from c) as lignes_p50, (select quantile_cont(n, 0.9) from c) as lignes_p90, (select quantile_cont(d, 0.5) from c) as distincts_p50 from b""")
def _(t):
    return A.interaction_density(t.confirmed, t.clients, t.products)


@query("agg41_evaluable_clients", """
with w(fenetre, train_end, test_start, test_end) as (values (1, date '1999-12-31', date '2000-01-01', date '2000-02-29'), (2, date '2000-12-31', date '2001-01-01', date '2001-03-01'))
select fenetre, count(case when ds <= train_end then 1 end) as n_lignes_train, count(case when ds between test_start and test_end then 1 end) as n_lignes_test,
  count(distinct case when ds between test_start and test_end then client_key end) as n_evaluables, (select count(*) from clients) - count(distinct case when ds <= train_end then client_key end) as n_cold_start
from confirmed, w group by 1""")
def _(t):
    w = t.spark.sql("select * from values (1, date'1999-12-31', date'2000-01-01', date'2000-02-29'), (2, date'2000-12-31', date'2001-01-01', date'2001-03-01') v(fenetre, train_end, test_start, test_end)")
    return A.evaluable_clients(t.confirmed, t.clients, w)
