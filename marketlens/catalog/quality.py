"""Data-quality and audit checks."""
from pyspark.sql import functions as F

from marketlens.catalog.base import query
from marketlens.catalog.joins import DECISIONS, PROMO_PAIRS, decisions
from marketlens.catalog.lake import source_tables
from marketlens.functions import scalar as S
from marketlens.operators import grids
from marketlens.operators import joins as J
from marketlens.operators import quality as Q
from marketlens.sources import lake


@query("dq1_row_checks_transactions", """
with g as (select order_id, produit_key, client_key, promo_key, ds, quantite, montant_net, vente_id, statut_commande, count(*) as n from sales group by all)
select sum(n)::bigint as n_rows, sum(n - 1)::bigint as duplicates, sum(case when quantite < 3 then n else 0 end)::bigint as invalid_quantity, 0::bigint as orphan_product, sum(case when statut_commande = 'annulee' then n else 0 end)::bigint as invalid_status,
  sum(case when quantite < 3 or statut_commande = 'annulee' then n else n - 1 end)::bigint as n_rejected, sum(case when quantite < 3 or statut_commande = 'annulee' then n else n - 1 end) / sum(n) as error_rate from g""")
def _(t):
    tx = source_tables(t)["fact_transactions"].withColumn("quantity", F.col("quantity") - 2).withColumn(
        "order_status", F.when(F.col("order_status") == "annulee", "inconnu").otherwise(F.col("order_status")))
    return lake.row_check_counts(tx, "fact_transactions", t.products)


@query("dq1_row_checks_web", """
select count(*) as n_rows, 0::bigint as duplicates, count(case when substr(produit_key, 4)::int >= 50 then 1 end) as orphan_product, count(case when event_type not in ('view', 'add_to_cart', 'purchase') then 1 end) as invalid_event_type,
  count(case when substr(produit_key, 4)::int >= 50 or event_type not in ('view', 'add_to_cart', 'purchase') then 1 end) as n_rejected,
  count(case when substr(produit_key, 4)::int >= 50 or event_type not in ('view', 'add_to_cart', 'purchase') then 1 end) / count(*) as error_rate from web""")
def _(t):
    return lake.row_check_counts(source_tables(t)["web_events"], "web_events", t.products.filter("substring(produit_key, 4) < '000050'"))


@query("dq1_row_checks_stock", "select count(*) as n_rows, 0::bigint as duplicates, count(case when niveau_stock < 5 then 1 end) as negative_stock_level, 0::bigint as negative_quantite_vendue, 0::bigint as negative_quantite_reapprovisionnee, count(case when niveau_stock < 5 then 1 end) as n_rejected, count(case when niveau_stock < 5 then 1 end) / count(*) as error_rate from stock")
def _(t):
    return lake.row_check_counts(source_tables(t)["stock_daily"].withColumn("stock_level", F.col("stock_level") - 5), "stock_daily")


@query("dq2_expectations", """
with p as (select product_id, case when substr(produit_key, 9, 1) = '7' then lower(categorie) else categorie end as category from products)
select 'dim_products' as table_name, * from (values ('not_null', 'product_id', 0), ('unique', 'product_id', 0), ('not_null', 'category', 0)) v(rule, "column", unexpected), (select true as success)
union all select 'dim_products', 'not_match', 'category', count(*)::int, false from p where regexp_full_match(category, '[A-Z ]+')
union all select 'dim_customers', 'not_null', 'customer_id', 0, true union all select 'dim_customers', 'unique', 'customer_id', 0, true union all select 'dim_customers', 'not_null', 'region', 0, true
union all select 'dim_customers', 'not_null', 'age_bracket', count(*)::int, count(*) / (select count(*) from clients) <= 0.1 from clients where age_bracket = 'A3'
union all select 'promotions', 'not_null', 'promotion_id', 0, true union all select 'promotions', 'unique', 'promotion_id', 0, true union all select 'promotions', 'between', 'discount_pct', 0, true
union all select 'web_events', 'not_null', 'event_id', 0, true union all select 'web_events', 'unique', 'event_id', 0, true union all select 'web_events', 'in_set', 'event_type', count(*)::int, false from web where event_type in ('click', 'error')
union all select 'web_events', 'known_product', 'product_id', 0, true""".replace("unexpected), (select", "unexpected), (select").replace("count(*)::int", "count(*)"))
def _(t):
    src = source_tables(t)
    parts = [Q.expectations(src[n], n, t.products) for n in ("dim_products", "dim_customers", "promotions", "web_events")]
    return Q.union_all(parts)


@query("dq2_expectations_facts", """
with l as (select concat_ws('|', vente_id, produit_key, quantite, montant_net) as k, * from sales), u as (select coalesce(sum(n), 0)::bigint n from (select k, count(*) n from l group by 1 having count(*) > 1))
select 'fact_transactions' as table_name, rule, "column", unexpected::bigint as unexpected, unexpected = 0 as success from (
  select 'not_null' as rule, 'ligne_id_origine' as "column", 0 as unexpected union all select 'unique', 'ligne_id_origine', n from u union all select 'not_null', 'order_id', 0 union all select 'in_set', 'order_status', 0
  union all select 'not_null', 'customer_id', 0 union all select 'not_null', 'product_id', 0 union all select 'between', 'quantity', 0 union all select 'known_product', 'product_id', 0)
union all select 'stock_daily', r, c, 0, true from (values ('not_null', 'product_id'), ('not_null', 'date'), ('between', 'stock_level'), ('between', 'quantite_vendue'), ('between', 'quantite_reapprovisionnee')) v(r, c)""")
def _(t):
    src = source_tables(t)
    tx = src["fact_transactions"].withColumn("ligne_id_origine", F.concat_ws("|", F.element_at(F.split("ligne_id_origine", r"\|"), 1), F.substring_index("ligne_id_origine", "|", -3)))
    return Q.union_all([Q.expectations(tx, "fact_transactions", t.products), Q.expectations(src["stock_daily"], "stock_daily")])


@query("dq3_missing_values", """
with r as (select 'order_id' as colonne, 0.0::double as taux_na union all select 'client_key', avg((client_key is null)::int) from web union all select 'anonymous_id', avg((anonymous_id is null)::int) from web union all select 'quantity', avg((quantity is null)::int) from web union all select 'event_id', 0.0)
select colonne, case when colonne = 'order_id' then (select avg((order_id is null)::int) from web) else taux_na end as taux_na, case colonne when 'event_id' then 'ok' when 'client_key' then 'critique' when 'anonymous_id' then 'ok' else 'alerte' end as status,
  case colonne when 'client_key' then 'colonne obligatoire' when 'event_id' then 'colonne obligatoire' when 'anonymous_id' then 'vide attendu (clé optionnelle)' else '—' end as interpretation from r""")
def _(t):
    return Q.missing_values(t.web.select("event_id", "client_key", "anonymous_id", "quantity", "order_id"), ["event_id", "client_key"], ["anonymous_id"])


@query("dq4_duplicates", """
with f as (select order_id, produit_key, quantite, count(*) n from sales group by all), k as (select order_id, produit_key, sum(n) n, sum(n - 1) d from f group by 1, 2)
select sum(n)::bigint as n_lignes, sum(d)::bigint as doublons_ligne, sum(n - 1)::bigint as doublons_cle, 'critique' as status from k""")
def _(t):
    return Q.duplicates(t.sales.select("order_id", "produit_key", "quantite"), ["order_id", "produit_key"])


@query("dq5_date_coverage", """
select min(ds) as debut, max(ds) as fin, count(distinct ds) as n_jours, count(distinct ds) / (max(ds) - min(ds) + 1) as couverture, 1 as ecart_modal, 'ok' as status from sales""")
def _(t):
    return Q.date_coverage(t.sales)


@query("dq6_negatives_zeros", """
select 'q' as colonne, count(case when quantite - 2 < 0 then 1 end) as n_negatifs, count(case when quantite = 2 then 1 end) as n_zeros, 0::bigint as n_non_numerique, min(quantite - 2)::double as min, max(quantite - 2)::double as max, round(avg(quantite - 2), 6) as moyenne from sales
union all select 's', 0, 0, count(*), null, null, null from sales""")
def _(t):
    return Q.negatives_zeros(t.sales.select((F.col("quantite") - 2).alias("q"), F.col("statut_commande").alias("s")), ["q", "s"])


@query("dq7_returns_cancellations", "select statut_commande as valeur, count(*) as n, 0::bigint as n_negatifs, count(*) / (select count(*) from sales) as part from sales group by 1")
def _(t):
    return Q.returns_cancellations(t.sales)


AMT = """am as (select *, l_extendedprice / l_quantity as px, round(l_extendedprice * (1 - l_discount), 4) as m, l_discount as d from lineitem),
fo as (select 'quantite x prix' as formule, 0 as i, l_quantity * px as e, m from am union all select 'quantite x prix x (1 - remise)', 1, l_quantity * px * (1 - d), m from am union all select 'quantite x prix x (1 - remise/100)', 2, l_quantity * px * (1 - d / 100), m from am
  union all select 'quantite x prix - remise', 3, l_quantity * px - d, m from am)"""


def _amounts(t):
    return t.raw("lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
                                    F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("m"), F.col("l_discount").alias("d"))


@query("dq8_amount_consistency", f"""
with {AMT} select formule, round(avg((abs(e - m) / abs(m) <= 0.005)::int), 3) as t5, round(avg((abs(e - m) / abs(m) <= 0.01)::int), 3) as t10, round(avg((abs(e - m) / abs(m) <= 0.02)::int), 3) as t20, round(avg((abs(e - m) / abs(m) <= 0.05)::int), 3) as t50,
  round(avg((abs(e - m) / abs(m) <= 0.1)::int), 3) as t100, formule = 'quantite x prix x (1 - remise)' as meilleure from fo group by 1""")
def _(t):
    out = Q.amount_consistency(_amounts(t), "q", "px", "m", "d")
    return out.withColumns({c: F.round(c, 3) for c in ("t5", "t10", "t20", "t50", "t100")})


@query("dq8_amount_ratio_quantiles", f"""
with {AMT}, r as (select m / (l_quantity * px) as r from am) select round(quantile_cont(r, 0.001), 6) as p0_1, round(quantile_cont(r, 0.5), 6) as mediane, round(quantile_cont(r, 0.999), 6) as p99_9 from r""")
def _(t):
    out = Q.amount_ratio_quantiles(_amounts(t), F.col("q") * F.col("px"), "m")
    return out.select(*[S.r(c).alias(c) for c in out.columns])


@query("dq9_launch_dates", """
with j as (select produit_key, valid_from + 100 as l, min(ds) as f, count(*) n, count(case when ds < valid_from + 100 then 1 end) b from sales join products using (produit_key) group by 1, 2)
select sum(n)::bigint as n_ventes, sum(b)::bigint as n_avant, max(f - l)::int as delai_max, sum(b) / sum(n) as taux, median(f - l)::double as delai_median, 'critique' as status from j""")
def _(t):
    return Q.launch_dates(t.sales, t.products.withColumn("valid_from", F.date_add("valid_from", 100)))


@query("dq10_promotion_windows", """
with j as (select ds between date_debut and date_fin as ok from sales join promotions p using (promo_key)) select count(*) as n_ventes_promues, count(case when ok then 1 end) as n_dedans, count(case when ok then 1 end) / count(*) as taux, 'critique' as status from j""")
def _(t):
    return Q.promotion_windows(t.sales, t.promotions)


@query("dq10_promotion_coverage", """
select avg((promo_key is not null)::int) as part_lignes, (select avg(f::int) from (select bool_or(promo_key is not null) f from sales group by ds)) as part_jours, (select avg(f::int) from (select bool_or(promo_key is not null) f from sales group by produit_key)) as part_produits, 'ok' as status from sales""")
def _(t):
    return Q.promotion_coverage(t.sales)


@query("dq11_verify_promo_calendar", f"""
with {PROMO_PAIRS}, c as (select distinct produit_key, ds, 1 as c from pd), j as (select promo_key is not null as p, c.c is not null as k from sales left join c using (produit_key, ds))
select count(case when p then 1 end) as n_ventes_promues, count(case when p and k then 1 end) / count(case when p then 1 end) as rappel, count(case when k then 1 end) as n_couvertes, count(case when p and k then 1 end) / count(case when k then 1 end) as precision_apparente from j""")
def _(t):
    return Q.verify_promo_calendar(t.sales, J.expand_promotions(t.promotions, t.products))


@query("dq12_coverage", """
select 'order_id' as colonne, count(*) as n_perimetre, count(order_id) / count(*) as taux, 0.99::double as minimum, count(order_id) / count(*) >= 0.99 as passed from web where event_type = 'purchase' union all select 'quantity', count(*), count(quantity) / count(*), 0.95, true from web where event_type = 'purchase'""")
def _(t):
    return Q.coverage(t.web, {"order_id": 0.99, "quantity": 0.95}, F.col("event_type") == "purchase")


@query("dq12_coverage_empty_scope", "select 'order_id' as colonne, 0::bigint as n_perimetre, null::double as taux, 0.5::double as minimum, false as passed")
def _(t):
    return Q.coverage(t.web, {"order_id": 0.5}, F.col("event_type") == "absent")


@query("dq12_history_coverage", "select count(distinct case when ds between date '1995-01-01' and date '2001-12-31' then ds end) as jours_couverts, 2557 as jours_attendus, count(distinct case when ds between date '1995-01-01' and date '2001-12-31' then ds end) / 2557 as part, true as passed from sales")
def _(t):
    return Q.history_coverage(t.sales, "ds", F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date"), 0.9)


@query("dq13_uniqueness", "with r as (select order_id, produit_key, count(*) n from sales group by 1, 2 having count(*) > 1) select order_id, produit_key, n, (select sum(n) from r)::bigint as n_lignes_dupliquees from r order by 1, 2 limit 10")
def _(t):
    return Q.uniqueness(t.sales, ["order_id", "produit_key"])


@query("dq14_tz_aware", "select count(*) as n_examinees, count(case when event_id % 5 = 0 then 1 end) as n_sans_fuseau, false as passed from web")
def _(t):
    text = F.concat(F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 5 == 0, "").otherwise("+00:00"))
    return Q.tz_aware(t.web.select(text.alias("ts")), "ts")


@query("dq14_future_events", "select count(case when event_timestamp > timestamp '2001-01-25' then 1 end) as n_futurs, max(event_timestamp) as max_observe, false as passed from web")
def _(t):
    return Q.future_events(t.web, "event_timestamp", F.lit("2001-01-25").cast("timestamp"))


@query("dq15_session_order", """
with w as (select user_id::varchar as session_id, case when event_id % 50 = 0 then event_timestamp - interval 2 day else event_timestamp end as ts, event_id from web), d as (select *, lag(ts) over (partition by session_id order by event_id) p from w)
select count(case when ts < p then 1 end) as n_transitions, count(distinct case when ts < p then session_id end) as n_sessions, false as passed from d""")
def _(t):
    ts = F.when(F.col("event_id") % 50 == 0, F.col("event_timestamp") - F.expr("interval 2 days")).otherwise(F.col("event_timestamp"))
    return Q.session_order(t.web.select(F.col("user_id").cast("string").alias("session_id"), ts.alias("event_timestamp"), "event_id"))


@query("dq16_bots_and_tests", "select count(*) as n_lignes, count(case when est_bot then 1 end) as n_bots, count(case when event_id % 100 = 0 then 1 end) as n_tests, (count(case when est_bot then 1 end) + count(case when event_id % 100 = 0 then 1 end)) / count(*) as part_a_exclure, true as passed from web")
def _(t):
    return Q.bots_and_tests(t.web.withColumn("est_test", F.col("event_id") % 100 == 0), "est_bot", "est_test")


@query("dq17_purchase_without_order", "select count(case when event_type = 'purchase' then 1 end) as n_achats, count(case when event_type = 'purchase' and order_id is null then 1 end) as n_sans_order_id, false as passed from web")
def _(t):
    return Q.purchase_without_order(t.web)


@query("dq18_order_single", """
with o as (select order_id, count(distinct client_key) c, count(distinct ds) d, count(distinct statut_commande) s from sales group by 1)
select 'client_key' as colonne, count(case when c > 1 then 1 end) as n_violations, count(case when c > 1 then 1 end) = 0 as passed from o union all select 'ds', count(case when d > 1 then 1 end), count(case when d > 1 then 1 end) = 0 from o
union all select 'statut_commande', count(case when s > 1 then 1 end), count(case when s > 1 then 1 end) = 0 from o""")
def _(t):
    return Q.order_single(t.sales)


@query("dq19_returns_after_order", "select count(case when statut_commande = 'retournee' then 1 end) as n_retours, count(case when statut_commande = 'retournee' and l < ds then 1 end) as n_avant_commande, false as passed from (select *, date_add(ds, quantite % 30 - 3)::date as l from sales)".replace("date_add(ds, quantite % 30 - 3)::date", "ds + (quantite % 30 - 3)"))
def _(t):
    s = t.sales.withColumn("is_retour", F.col("statut_commande") == "retournee").withColumn("date_retour", F.expr("date_add(ds, quantite % 30 - 3)"))
    return Q.returns_after_order(s, "is_retour", "date_retour", "ds")


@query("dq20_closed_domain", "select event_type as valeur, count(*) as n from web where event_type not in ('view', 'add_to_cart', 'purchase') group by 1")
def _(t):
    return Q.closed_domain(t.web, "event_type", ("view", "add_to_cart", "purchase"))


def _contract_results(t):
    tables = {"web": t.web, "sales": t.sales, "products": t.products, "clients": t.clients}
    contract = {"required": [("web", "session_id"), ("sales", "is_retour"), ("refunds", "order_id")],
                "coverage": {"web": [("order_id", 0.99, "event_type = 'purchase'"), ("anonymous_id", 1.0, "client_key is null"), ("quantity", 0.9, "event_type = 'absent'")]},
                "unique": [("web", ["event_id"]), ("sales", ["vente_id"])], "foreign_keys": [("web", "produit_key", "products", "produit_key"), ("sales", "client_key", "clients", "client_key")],
                "domains": [("sales", "statut_commande", ["confirmee", "annulee", "retournee"]), ("web", "event_type", ["view", "add_to_cart", "purchase"])]}
    return Q.delivery_validation(tables, contract)


RESULTS = """res(name, severity, passed) as (select * from (values ('required::web.session_id', 'erreur', true), ('required::sales.is_retour', 'erreur', false), ('required::refunds.order_id', 'erreur', false), ('coverage::web.quantity', 'erreur', false)) v
union all select 'coverage::web.order_id', 'erreur', count(order_id) / count(*) >= 0.99 from web where event_type = 'purchase' union all select 'coverage::web.anonymous_id', 'erreur', count(anonymous_id) / count(*) >= 1.0 from web where client_key is null
union all select 'unique::web(event_id)', 'erreur', count(*) = count(distinct event_id) from web union all select 'unique::sales(vente_id)', 'erreur', count(*) = count(distinct vente_id) from sales
union all select 'fk::web.produit_key', 'erreur', count(*) = 0 from web where produit_key not in (select produit_key from products) union all select 'fk::sales.client_key', 'erreur', count(*) = 0 from sales where client_key not in (select client_key from clients)
union all select 'domain::sales.statut_commande', 'erreur', count(*) = 0 from sales where statut_commande not in ('confirmee', 'annulee', 'retournee') union all select 'domain::web.event_type', 'erreur', count(*) = 0 from web where event_type not in ('view', 'add_to_cart', 'purchase'))"""


@query("dq21_summary", f"with {RESULTS} select count(*) as n_controles, count(case when not passed and severity = 'erreur' then 1 end) as n_erreurs, 0::bigint as n_avertissements, count(case when not passed then 1 end) = 0 as passed from res")
def _(t):
    return Q.summary(_contract_results(t))


@query("dq22_final_build_checks", """
with ss as (select session_id, event_timestamp - lag(event_timestamp) over (partition by session_id order by event_timestamp, event_id) as g, event_timestamp, event_id from web),
sn as (select session_id, sum(case when g is null or g > interval 30 minute then 1 else 0 end) over (partition by session_id order by event_timestamp, event_id) as no from ss),
c(controle, n_defauts) as (select 'statuts', 0::bigint union all select 'pk_ventes', (select coalesce(sum(n), 0) from (select count(*) n from sales group by vente_id having count(*) > 1)) union all select 'pk_web', 0 union all select 'pk_stock', 0 union all select 'fk_ventes_produit', 0
  union all select 'fk_ventes_client', 0 union all select 'fk_web_produit', 0 union all select 'bots', 0 union all select 'purchase_order', (select count(*) from web where event_type = 'purchase' and order_id is null) union all select 'purchase_quantity', 0
  union all select 'price_formula', (select count(*) from sales join products using (produit_key) where abs(montant_net / (prix_base * quantite * (1 - remise_pct / 100)) - 1) > 0.021) union all select 'catalog_price_fixed', 0
  union all select 'stock_formula', (select count(*) from (select niveau_stock - (lag(niveau_stock) over (partition by produit_key order by ds) - quantite_vendue + quantite_reapprovisionnee) r from stock) where r <> 0)
  union all select 'sessions_timeout_30', (select count(*) from sn where no > 1))
select controle, n_defauts::bigint as n_defauts, n_defauts = 0 as ok from c""")
def _(t):
    return Q.final_build_checks(t.sales, t.products, t.clients, t.web, t.stock)


def _grid(t):
    return grids.filled_grid(t.pday, t.products, {"y": 0, "ca": 0.0})


@query("dq23_sales_conservation", "select 'total' as niveau, 1::bigint as n, 0::bigint as n_ecarts union all select 'produit', count(distinct produit_key), 0 from pday union all select 'mois', count(distinct date_trunc('month', ds)), 0 from pday")
def _(t):
    return Q.sales_conservation(t.pday.select("produit_key", "ds", "y", "ca"), _grid(t))


@query("dq23_zero_rows", """
with f as (select produit_key, min(ds) as p from pday group by 1), b as (select (select max(ds) from pday) - least(p, coalesce(greatest(valid_from, (select min(ds) from pday)), p)) + 1 as n from f left join products using (produit_key))
select sum(n)::bigint as n_lignes, (sum(n) - (select count(*) from pday))::bigint as n_zeros, 0::bigint as n_zeros_source, 0::bigint as n_repetes from b""")
def _(t):
    return Q.zero_rows_from_filling(t.pday, _grid(t))


@query("dq24_stock_coverage", """
with s as (select produit_key, min(ds) as debut, max(ds) as fin, count(distinct ds) as n_jours from stock where niveau_stock <> 44 group by 1), f as (select produit_key, min(ds) as first from pday where y > 0 group by 1),
r as (select produit_key, count(*) v from stock join pday using (produit_key, ds) where niveau_stock <= 0 and y > 0 group by 1)
select produit_key, debut, fin, n_jours, fin - debut + 1 - n_jours as n_trous, (debut - valid_from)::int as ecart_validite, (debut - first)::int as ecart_premiere_vente, coalesce(v, 0) as ventes_en_rupture from s left join products using (produit_key) left join f using (produit_key) left join r using (produit_key)""")
def _(t):
    return Q.stock_coverage(t.stock.filter("niveau_stock <> 44"), t.products, t.pday)


def price_journal(t):
    """Weekly decisions with planted defects, for the checks."""
    k = F.substring("produit_key", 4, 6).cast("int")
    d = decisions(t).join(t.products.select("produit_key", "prix_base"), "produit_key").join(t.stock.select("produit_key", F.date_add("ds", 1).alias("ds"), F.col("niveau_stock").alias("stock")), ["produit_key", "ds"], "left")
    pct = k % 4 * 5
    return (d.withColumn("decision_id", F.concat_ws("-", "produit_key", F.when(k % 97 == 0, F.lit("x")).otherwise(F.col("ds").cast("string"))))
            .withColumn("week", F.trunc("ds", "week")).withColumn("eligible", k % 3 != 0).withColumn("remise_appliquee", pct)
            .withColumn("prix_applique", F.round(F.col("prix_base") * (1 - pct / 100), 0) + F.when(k % 50 == 0, 1).otherwise(0))
            .withColumn("propensity", F.when(k % 200 == 0, 1.5).otherwise(0.25)).withColumn("impressions", F.when(k % 10 == 0, 7).otherwise(F.dayofmonth("ds"))))


@query("dq25_pricing_experiment_checks", f"""
with {DECISIONS}, {PROMO_PAIRS}, jr as (select d.produit_key, d.ds, substr(d.produit_key, 4)::int as k, s.niveau_stock as stock from dec d left join stock s on s.produit_key = d.produit_key and s.ds = d.ds - 1)
select 'remise_sans_eligibilite' as controle, count(case when k % 3 = 0 and k % 4 > 0 then 1 end) as n_defauts from jr union all select 'propension_hors_domaine', count(case when k % 200 = 0 then 1 end) from jr union all select 'prix_incoherent', count(case when k % 50 = 0 then 1 end) from jr
union all select 'decision_repetee', count(case when k % 97 = 0 then 1 end) from jr union all select 'plusieurs_par_semaine', 0 union all select 'impressions_constantes', count(distinct case when k % 10 = 0 then k end) from jr union all select 'stock_pas_de_la_veille', 0
union all select 'chevauche_promotion', count(*) from jr where exists (select 1 from pp where pp.produit_key = jr.produit_key and date_debut <= ds + 7 and date_fin >= ds)""")
def _(t):
    return Q.pricing_experiment_checks(price_journal(t), t.stock, J.expand_promotions(t.promotions, t.products))


def exposure_journal(t):
    """Web events read as slates of consecutive events, with planted defects."""
    i = F.col("event_id")
    return t.web.select(i.alias("recommendation_id"), F.floor(i / 5).alias("slate_id"), "session_id", "client_key", F.when((i % 40 == 0), None).otherwise(F.col("anonymous_id")).alias("anonymous_id"),
                        (i % 5 + 1).alias("rank"), (F.col("event_timestamp") + F.when(i % 30 == 0, F.expr("interval 2 days")).otherwise(F.expr("interval 0 days"))).alias("impression_timestamp"),
                        F.lit(0.2).alias("probability"), (i % 7 == 0).alias("added_to_cart"), (i % 14 == 0).alias("purchased"))


@query("dq26_exposure_checks", """
with e as (select *, case when event_id % 40 = 0 then null else anonymous_id end as an, event_id % 5 + 1 as rk, event_timestamp + case when event_id % 30 = 0 then interval 2 day else interval 0 day end as its from web),
s as (select event_id // 5 as slate, count(*) n, count(distinct rk) d, min(rk) lo, max(rk) hi from e group by 1), b as (select session_id, min(event_timestamp) lo, max(event_timestamp) hi from web group by 1)
select 'taille_slate' as controle, count(case when n <> 5 then 1 end) as n_defauts from s union all select 'rangs', count(case when lo <> 1 or hi <> n or d <> n then 1 end) from s union all select 'somme_softmax', count(case when abs(0.2 * n - 1) > 0.001 then 1 end) from s
union all select 'id_repete', 0 union all select 'identite_exclusive', count(*) from e where (client_key is not null) = (an is not null) union all select 'achat_sans_panier', count(*) from e where event_id % 14 = 0 and event_id % 7 <> 0
union all select 'session_bot', count(*) from e where session_id in (select session_id from web where est_bot) union all select 'hors_session', count(*) from e join b using (session_id) where its < lo or its > hi""")
def _(t):
    return Q.exposure_checks(exposure_journal(t), t.web)


@query("dq27_recommendation_output_checks", """
with r as (select client_key, case when quantite = 50 and remise_pct = 10 then 'PRD000000' else produit_key end as item, row_number() over (partition by client_key order by ds, order_id, produit_key, quantite, montant_net) as rang from sales), l as (select client_key, count(*) n, count(distinct item) i from r group by 1)
select count(*) as n_listes, count(case when i <> n then 1 end) as repetes, 0::bigint as scores_non_finis, count(case when n > 40 then 1 end) as listes_trop_longues, 0::bigint as rangs_non_consecutifs from l""")
def _(t):
    from pyspark.sql import Window
    w = Window.partitionBy("client_key").orderBy("ds", "order_id", "produit_key", "quantite", "montant_net")
    item = F.when((F.col("quantite") == 50) & (F.col("remise_pct") == 10), "PRD000000").otherwise(F.col("produit_key"))
    recs = t.sales.withColumn("rang", F.row_number().over(w)).select("client_key", item.alias("produit_key"), "rang", F.col("quantite").cast("double").alias("score"))
    return Q.recommendation_output_checks(recs, 40)


@query("dq28_prediction_checks", """
with p as (select 'naive' as model, year(ds)::int as "window", case when y > 150 then null when y = 0 then -1 else y end::double as pred from brand_days), e as (select year(ds)::int as "window", count(*) as n_expected from brand_days group by 1)
select model, "window", count(*) as n, count(case when pred is null then 1 end) as n_non_finis, count(case when pred < 0 then 1 end) as n_negatifs, any_value(n_expected) as n_expected, count(case when pred is null then 1 end) = 0 and count(case when pred < 0 then 1 end) = 0 as ok from p join e using ("window") group by 1, 2""")
def _(t):
    pred = F.when(F.col("y") > 150, None).when(F.col("y") == 0, -1).otherwise(F.col("y")).cast("double")
    preds = t.brand_days.select(F.lit("naive").alias("model"), F.year("ds").alias("window"), pred.alias("pred"))
    return Q.prediction_checks(preds, t.brand_days.groupBy(F.year("ds").alias("window")).agg(F.count(F.lit(1)).alias("n_expected")))


@query("dq29_delivery_validation", f"with {RESULTS} select * from res")
def _(t):
    return _contract_results(t)


@query("dq30_delivery_aggregates", "select count(*) as n_lignes, count(distinct event_id) as n_ids, count(distinct session_id) as n_sessions, count(*) - count(distinct event_id) as n_doublons from web")
def _(t):
    return Q.delivery_aggregates(t.web)
