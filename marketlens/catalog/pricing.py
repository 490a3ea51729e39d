"""Pricing and promotion analysis."""
from pyspark.sql import functions as F

from marketlens.catalog.base import digest, digest_sql, query
from marketlens.catalog.joins import PROMO_PAIRS
from marketlens.catalog.windows import roll
from marketlens.functions.scalar import r
from marketlens.operators import joins as J
from marketlens.plans import pricing as P


def panel(t):
    return t.panel.withColumn("dow", F.weekday("ds"))


CUT = "2000-10-01"


def split(t):
    d, cut = panel(t), F.lit(CUT).cast("date")
    return d.filter(F.col("ds") < cut), d.filter(F.col("ds") >= cut)


PN = f"pn as (select *, isodow(ds)::int - 1 as dow from panel), tr as (select * from pn where ds < date '{CUT}'), te as (select * from pn where ds >= date '{CUT}')"


@query("pri1_descriptive_uplift", f"""
with {PN}, b as (select produit_key, dow, avg(y) m from pn where not en_promotion group by 1, 2), j as (select p.*, m from pn p left join b using (produit_key, dow) where en_promotion and produit_key in (select produit_key from b))
select produit_key, remise_pct, count(*) as n_jours, round(avg(y - m), 8) as uplift_residuel, avg(y) as y_promo, round(avg(m), 8) as y_attendu from j group by 1, 2 having count(*) >= 2""")
def _(t):
    return P.descriptive_uplift(panel(t), 2).withColumn("uplift_residuel", r("uplift_residuel", 8)).withColumn("y_attendu", r("y_attendu", 8))


@query("pri2_panel_fixed_effects")
def _(t):
    from pyspark.sql import Window
    lag = t.stock.select("produit_key", "ds", F.lag("niveau_stock").over(Window.partitionBy("produit_key").orderBy("ds")).alias("stock_lag1"))
    return P.panel_fixed_effects(panel(t).join(lag, ["produit_key", "ds"], "left"))


POOL = """{src}_p as (select produit_key, min(categorie) as categorie, case when avg(y) filter (en_promotion) > 0 and avg(y) filter (not en_promotion) > 0 then ln(avg(y) filter (en_promotion)) - ln(avg(y) filter (not en_promotion)) end as ep, count(case when en_promotion then 1 end) as n from {src} group by 1),
{src}_c as (select categorie, case when avg(y) filter (en_promotion) > 0 and avg(y) filter (not en_promotion) > 0 then ln(avg(y) filter (en_promotion)) - ln(avg(y) filter (not en_promotion)) end as ec from {src} group by 1),
{src}_h as (select produit_key, categorie, ep, ec, n, n / (n + 30.0::double) as poids, n / (n + 30.0::double) * coalesce(ep, ec) + (1 - n / (n + 30.0::double)) * ec as es from {src}_p join {src}_c using (categorie))"""


@query("pri3_hierarchical_pooling", f"with {PN}, {POOL.format(src='pn')} select produit_key, categorie, n as n_jours_promo, round(ep, 8) as effet_produit, round(ec, 8) as effet_categorie, round(poids, 8) as poids, round(es, 8) as effet_shrinkage from pn_h")
def _(t):
    d = P.hierarchical_pooling(panel(t))
    return d.withColumns({c: r(c, 8) for c in ("effet_produit", "effet_categorie", "poids", "effet_shrinkage")})


BASE = """pl as (select * from tr where not en_promotion), bp as (select produit_key, dow, avg(y) m from pl group by 1, 2), bc as (select categorie, dow, avg(y) m from pl group by 1, 2),
bs as (select te.*, coalesce(bp.m, bc.m, (select avg(y) from pl)) as baseline from te left join bp using (produit_key, dow) left join bc on bc.categorie = te.categorie and bc.dow = te.dow)"""


@query("pri4_descriptive_predictor", f"""
with {PN}, {BASE}, pr as (select tr.*, y - coalesce(m, (select avg(y) from pl)) as e from tr left join bp using (produit_key, dow) where en_promotion),
rp as (select produit_key, remise_pct, avg(e) v from pr group by 1, 2), rc as (select categorie, remise_pct, avg(e) v from pr group by 1, 2)
select bs.produit_key, ds, round(case when bs.remise_pct <= 0 then baseline else greatest(baseline + coalesce(rp.v, rc.v, 0), 0) end, 8) as pred from bs left join rp on rp.produit_key = bs.produit_key and rp.remise_pct = bs.remise_pct left join rc on rc.categorie = bs.categorie and rc.remise_pct = bs.remise_pct""")
def _(t):
    return P.descriptive_predictor(*split(t)).select("produit_key", "ds", r("pred", 8).alias("pred"))


@query("pri4_hierarchical_predictor", f"""
with {PN}, {BASE}, {POOL.format(src='tr')}, dp as (select produit_key, avg(remise_pct) v from tr where en_promotion group by 1)
select produit_key, ds, round(greatest(exp(ln(1 + baseline) + coalesce(es / v, 0) * remise_pct) - 1, 0), 6) as pred from bs left join tr_h using (produit_key) left join dp using (produit_key)""")
def _(t):
    return P.hierarchical_predictor(*split(t)).select("produit_key", "ds", r("pred").alias("pred"))


@query("pri4_fe_predictor", f"""
with {PN}, m as (select produit_key, avg(ln(1 + y)) my, avg(remise_pct) mx from tr group by 1), o as (select avg(ln(1 + y)) oy, avg(remise_pct) ox from tr)
select produit_key, ds, round(greatest(exp(coalesce(my, oy) + 0.02::double * (remise_pct - coalesce(mx, ox))) - 1, 0), 6) as pred from te left join m using (produit_key), o""")
def _(t):
    return P.fe_predictor(*split(t), 0.02).select("produit_key", "ds", r("pred").alias("pred"))


@query("pri5_volume_glm_tweedie")
def _(t):
    return P.fit_volume(*split(t), "tweedie").select("produit_key", "ds", "y", "pred")


@query("pri5_volume_boosted_trees")
def _(t):
    return P.fit_volume(*split(t), "gbt", None).select("produit_key", "ds", "y", "pred")


@query("pri6_category_discount_shrinkage", f"""
with {PN}, c as (select categorie, remise_pct, avg(y) m, count(*) n from tr group by 1, 2), b as (select categorie, avg(y) v from tr group by 1) select categorie, remise_pct, n, (m * n + v * 20.0::double) / (n + 20.0::double) as pred from c join b using (categorie)""")
def _(t):
    return P.category_discount_shrinkage(split(t)[0])


@query("pri7_calibration_factors", """
with h as (select year(ds)::int as "window", categorie, y, prix_base / 40 as y_pred from panel), c as (select categorie, "window" as w, sum(y) y, sum(y_pred) p, count(*) n from h group by 1, 2), ws as (select distinct "window" from h),
k as (select ws."window", categorie, sum(y) y, sum(p) p, sum(n) n from ws join c on c.w < ws."window" group by 1, 2), g as (select ws."window", sum(y) gy, sum(p) gp from ws join c on c.w < ws."window" group by 1),
f as (select ws."window", categorie, n, case when gp is null then null else greatest(least(gy / gp, 2.0), 0.5) end as fg, greatest(least(y / p, 2.0), 0.5) as fc from ws left join k using ("window") left join g using ("window"))
select "window", categorie, case when fg is null then 1.0 else round(greatest(least(n / (n + 200.0::double) * fc + (1 - n / (n + 200.0::double)) * fg, 2.0), 0.5), 8) end::double as facteur, coalesce(n, 0)::bigint as support from f""")
def _(t):
    h = t.panel.select(F.year("ds").alias("window"), "categorie", "y", (F.col("prix_base") / 40).alias("y_pred"))
    return P.calibration_factors(h, h.select("window").distinct()).withColumn("facteur", r("facteur", 8))


@query("pri8_arm_learners")
def _(t):
    tr, te = split(t)
    return P.arm_learners(tr, te, (0, 5, 10))


@query("pri8_isotonic_arms", f"""
with {PN}, a as (select produit_key, remise_pct, count(*) as n, sum(y)::double as s from tr group by 1, 2),
c as (select *, sum(s) over w as cs, sum(n) over w as cn from a window w as (partition by produit_key order by remise_pct)),
p as (select x.produit_key, x.remise_pct as low, y.remise_pct as high, (y.cs - x.cs + x.s) / (y.cn - x.cn + x.n) as m from c x join c y on x.produit_key = y.produit_key and x.remise_pct <= y.remise_pct),
f as (select c.produit_key, c.remise_pct, p.low, min(p.m) as m from c join p on p.produit_key = c.produit_key and p.low <= c.remise_pct and p.high >= c.remise_pct group by 1, 2, 3)
select produit_key, remise_pct, round(max(m), 6) as y_croissant from f group by 1, 2""")
def _(t):
    """Mean quantity by discount of each product, made non-decreasing."""
    tr = split(t)[0].withColumn("n", F.lit(1))
    return P.isotonic(tr, ["produit_key"], "remise_pct", "y", "n", "y_croissant").withColumn("y_croissant", r("y_croissant"))


@query("pri9_baseline_mean", f"with {PN}, m as (select produit_key, avg(y) v from tr group by 1) select produit_key, ds, coalesce(v, (select avg(y) from tr)) as pred from te left join m using (produit_key)")
def _(t):
    return P.baseline_mean(*split(t)).select("produit_key", "ds", "pred")


@query("pri9_baseline_median", f"with {PN}, m as (select produit_key, median(y) v from tr group by 1) select produit_key, ds, coalesce(v, (select median(y) from tr))::double as pred from te left join m using (produit_key)")
def _(t):
    return P.baseline_median(*split(t)).select("produit_key", "ds", "pred")


@query("pri10_aipw")
def _(t):
    return P.aipw(*split(t))


@query("pri11_propensity_weights")
def _(t):
    level = F.when(F.col("remise_pct") == 0, 0).when(F.col("remise_pct") <= 6, 1).otherwise(2)
    tr, te = (d.withColumn("niveau", level) for d in split(t))
    return P.propensity_weights(tr, te, 3)


SCEN = """own as (select produit_key, remise_pct, avg(y) q, count(*) n from panel group by 1, 2), cq as (select categorie, remise_pct, avg(y) qc from panel group by 1, 2),
inf as (select produit_key, min(categorie) as categorie, max(prix_base) as prix_base, max(cout) as cout, avg(ca - cout * y) as ma from panel group by 1),
g0 as (select inf.*, d::int as remise_pct, prix_base * (1 - d / 100) as prix from inf, (values (0), (4), (6), (8), (10)) v(d)),
g1 as (select g0.*, n, case when n >= 10 then q else coalesce(qc, q) end as qq from g0 left join own using (produit_key, remise_pct) left join cq on cq.categorie = g0.categorie and cq.remise_pct = g0.remise_pct where prix >= cout * 1.05),
g2 as (select *, prix * qq as ca_prevu, (prix - cout) * qq as marge_prevue from g1 where qq is not null),
g3 as (select *, rank() over (partition by produit_key order by round(marge_prevue, 6)) + rank() over (partition by produit_key order by round(qq, 6)) as comp from g2),
g4 as (select *, 'marge' as objectif, round(marge_prevue, 6) as s from g3 union all select *, 'chiffre_affaires', round(ca_prevu, 6) from g3 union all select *, 'ecoulement_stock', round(qq, 6) from g3 union all select *, 'compromis_marge_volume', comp from g3),
best as (select * from g4 qualify row_number() over (partition by produit_key, objectif order by s desc, remise_pct) = 1)"""


@query("pri12_discount_scenario_grid", f"""
with {SCEN} select produit_key, objectif, remise_pct as remise_suggeree, prix as prix_simule, qq as quantite_prevue, greatest(qq * 0.5::double, 0) as q_basse, qq * 1.5::double as q_haute, ca_prevu, marge_prevue,
  n is not null as support_historique, marge_prevue < ma as marge_sous_actuelle, case when n is not null then 'moyenne' else 'faible' end as niveau_confiance, false as application_automatique from best""")
def _(t):
    return P.discount_scenario_grid(t.panel, (0, 4, 6, 8, 10))


@query("pri13_policy_comparison", f"""
with {SCEN} select 'observee' as politique, round(avg(y), 6) as quantite, round(avg(ca), 4) as ca, round(avg(ca - cout * y), 4) as marge, count(case when prix_base * (1 - remise_pct / 100) < cout * 1.05 then 1 end) as violations, round(stddev_samp(remise_pct), 6) as dispersion from panel
union all select objectif, round(avg(qq), 6), round(avg(ca_prevu), 4), round(avg(marge_prevue), 4), 0, round(stddev_samp(remise_pct), 6) from best group by 1""")
def _(t):
    d = P.policy_comparison(t.panel, P.discount_scenario_grid(t.panel, (0, 4, 6, 8, 10)))
    return d.withColumns({"quantite": r("quantite"), "ca": r("ca", 4), "marge": r("marge", 4), "dispersion": r("dispersion")})


@query("pri14_batch_price_scoring", """
with v as (select produit_key, max(y) as vol from panel group by 1), pc as (select produit_key, prix_base, floor(cout) as cout from products), sp as (select distinct produit_key, remise_pct from panel),
rq as (select produit_key, d::int as remise_pct from products, (values (0), (4), (10), (40), (95)) t(d) union all select 'PRDX' || produit_key, 0 from products where cout < 500),
s as (select rq.produit_key, rq.remise_pct, round(prix_base * (1 - rq.remise_pct / 100.0), 2) as px, cout, prix_base, coalesce(vol, 0)::double as vol, sp.produit_key as seen from rq left join pc p on p.produit_key = rq.produit_key left join v on v.produit_key = rq.produit_key left join sp on sp.produit_key = rq.produit_key and sp.remise_pct = rq.remise_pct),
c as (select *, case when prix_base is null then 'produit_inconnu' when remise_pct not between 0 and 90 then 'remise_hors_bornes' when px < cout then 'prix_sous_cout' when px - cout < 0.05::double * px then 'marge_sous_plancher' when seen is null then 'niveau_non_observe' end as refus from s)
select produit_key, remise_pct, px as prix_simule, refus, case when refus is null then vol end as volume, case when refus is null then round(vol * px, 2) end as chiffre_affaires, case when refus is null then round(vol * (px - cout), 2) end as marge, case when refus is null then vol = 0 end as volume_nul from c""")
def _(t):
    from marketlens.operators.grids import repeat_per
    rq = repeat_per(t.products.select("produit_key"), "remise_pct", [0, 4, 10, 40, 95]).unionByName(
        t.products.filter("cout < 500").select(F.concat(F.lit("PRDX"), "produit_key").alias("produit_key"), F.lit(0).alias("remise_pct")))
    vol = t.panel.groupBy("produit_key").agg(F.max("y").cast("double").alias("volume"))
    return P.batch_price_scoring(rq, t.products.withColumn("cout", F.floor("cout").cast("double")), vol, t.panel)


EPI = f"""{PROMO_PAIRS}, pe as (select pp.*, cout, (date_fin - date_debut + 1)::int as duree from pp join products using (produit_key)),
ov as (select a.produit_key, a.promo_key, count(*) n from pe a join pe b on a.produit_key = b.produit_key and b.date_debut <= a.date_fin and b.date_fin >= a.date_debut group by 1, 2),
dd as (select produit_key, ds, sum(quantite) as qty from confirmed group by 1, 2), h as (select produit_key, ds, {roll('qty', 'sum', 'produit_key', 28)} as q28 from dd),
dn as (select produit_key, ds, sum(quantite) as qty from confirmed where promo_key is null group by 1, 2), hn as (select produit_key, ds, {roll('qty', 'sum', 'produit_key', 28)} as q28 from dn),
ep0 as (select pe.produit_key, pe.promo_key, pe.date_debut, pe.date_fin, duree, cout, max(h.ds) as seen from pe left join h on h.produit_key = pe.produit_key and h.ds < pe.date_debut group by all),
ep1 as (select ep0.*, max(hn.ds) as seen_n from ep0 left join hn on hn.produit_key = ep0.produit_key and hn.ds < ep0.date_debut group by all),
oc as (select pe.produit_key, pe.promo_key, sum(quantite) q, count(distinct order_id) o, count(distinct client_key) c, round(sum(montant_net), 4) ca from pe join confirmed s on s.produit_key = pe.produit_key and s.ds between date_debut and date_fin group by 1, 2),
epi as (select e.produit_key, e.promo_key, date_debut, duree as duree_jours, ov.n as overlap_count, coalesce(q, 0)::bigint as qty_campaign, coalesce(o, 0) as orders_campaign, coalesce(c, 0) as clients_campaign, coalesce(ca, 0.0) as ca_campaign, coalesce(ca, 0.0) - coalesce(q, 0) * cout as margin_campaign,
  coalesce(h.q28, 0) * duree / 28 as qty_control_28d, coalesce(hn.q28, 0) * duree / 28 as qty_control_no_promo_28d from ep1 e join ov using (produit_key, promo_key) left join h on h.produit_key = e.produit_key and h.ds = seen left join hn on hn.produit_key = e.produit_key and hn.ds = seen_n left join oc on oc.produit_key = e.produit_key and oc.promo_key = e.promo_key)"""
EPC = ["duree_jours", "overlap_count", "qty_campaign", "orders_campaign", "clients_campaign", "ca_campaign", "margin_campaign", "qty_control_28d", "qty_control_no_promo_28d", "uplift_vs_control"]


@query("pri15_campaign_episodes", f"with {EPI}, x as (select *, (qty_campaign - qty_control_28d) / nullif(qty_control_28d, 0) as uplift_vs_control from epi) " + digest_sql("x", ["produit_key"], EPC))
def _(t):
    return digest(P.campaign_episodes(t.promotions, t.products, t.confirmed), ["produit_key"], EPC)


@query("pri16_campaign_baselines", f"""
with {EPI}, k as (select date_debut, ntile(3) over (order by date_debut) as w from (select distinct date_debut from epi)), d as (select epi.*, w from epi join k using (date_debut)), p as (select produit_key, w, sum(qty_campaign) s, count(*) n from d group by 1, 2),
j as (select d.*, (select sum(s) / sum(n) from p where p.produit_key = d.produit_key and p.w < d.w) as m from d)
select w::int as "window", count(*) as n, round(sum(abs(qty_campaign - qty_control_28d)) / sum(qty_campaign), 8) as wape_controle, round(sum(abs(qty_campaign - coalesce(m, 0))) / sum(qty_campaign), 8) as wape_moyenne_produit from j group by 1""")
def _(t):
    d = P.campaign_baselines(P.campaign_episodes(t.promotions, t.products, t.confirmed))
    return d.withColumns({c: r(c, 8) for c in ("wape_controle", "wape_moyenne_produit")})


@query("pri17_weekly_price_decisions", f"""
with {PROMO_PAIRS}, wk as (select d::date as ds from (select unnest(generate_series(date '2001-01-01', date '2001-06-29', interval 7 day)) d)), c as (select produit_key, ds from products, wk where valid_from <= ds),
f as (select c.produit_key, c.ds, niveau_stock as stock_veille from c join stock s on s.produit_key = c.produit_key and s.ds = c.ds - 1 where not exists (select 1 from pp where pp.produit_key = c.produit_key and date_debut <= c.ds + 7 and date_fin >= c.ds))
select f.produit_key, f.ds, stock_veille, count(w.event_id) as impressions from f left join web w on w.produit_key = f.produit_key and event_type = 'view' and event_timestamp < cast(f.ds as timestamp) group by 1, 2, 3""")
def _(t):
    span = t.stock.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    return P.weekly_price_decisions(t.products, t.stock, J.expand_promotions(t.promotions, t.products), t.web, span).select("produit_key", "ds", "stock_veille", "impressions")


@query("pri18_log_unit_slope", """
with d as (select remise_pct - avg(remise_pct) over (partition by categorie) as x, ln(1 + y) - avg(ln(1 + y)) over (partition by categorie) as l from panel) select round(sum(x * l) / sum(x * x), 8) as pente, count(*) as n from d""")
def _(t):
    return P.log_unit_slope(t.panel).withColumn("pente", r("pente", 8))


PF = ["discount_x_category", "planned_price", "margin_after", "sales_mean_28", "views_lag_1", "past_campaign_exposure_90", "product_mean_before", "product_discount_n_before", "category_discount_mean_before"]


@query("pri19_pricing_features", f"""
with {PROMO_PAIRS}, cc as (select v, (row_number() over (order by v) - 1)::int k from (select distinct categorie v from panel)), fl as (select produit_key, ds, 1 a from pd group by 1, 2),
dl as (select d.*, {roll('y', 'mean', 'produit_key', 28, 7)} as sales_mean_28, lag("view") over (partition by produit_key order by ds) as views_lag_1 from daily d),
ex as (select produit_key, ds, {roll('a', 'sum', 'produit_key', 90, 14)} as past_campaign_exposure_90 from (select produit_key, ds, coalesce(a, 0) a from daily left join fl using (produit_key, ds))),
p1 as (select produit_key, ds, avg(y) m from panel group by 1, 2), q1 as (select produit_key, ds, sum(y) over w / count(*) over w as product_mean_before from panel window w as (partition by produit_key order by ds rows between unbounded preceding and 1 preceding)),
q2 as (select produit_key, remise_pct, ds, count(*) over (partition by produit_key, remise_pct order by ds rows between unbounded preceding and 1 preceding) as product_discount_n_before from panel),
c2 as (select categorie, remise_pct, ds, sum(y) s, count(*) n from panel group by 1, 2, 3), q3 as (select categorie, remise_pct, ds, sum(s) over w / sum(n) over w as category_discount_mean_before from c2 window w as (partition by categorie, remise_pct order by ds rows between unbounded preceding and 1 preceding)),
x as (select p.produit_key, p.remise_pct * (k + 1) as discount_x_category, prix_base * (1 - p.remise_pct / 100) as planned_price, prix_base * (1 - p.remise_pct / 100) - cout as margin_after, sales_mean_28, views_lag_1, past_campaign_exposure_90, product_mean_before, product_discount_n_before, category_discount_mean_before
  from panel p join cc on cc.v = p.categorie left join dl on dl.produit_key = p.produit_key and dl.ds = p.ds left join ex on ex.produit_key = p.produit_key and ex.ds = p.ds left join q1 on q1.produit_key = p.produit_key and q1.ds = p.ds
  left join q2 on q2.produit_key = p.produit_key and q2.ds = p.ds left join q3 on q3.categorie = p.categorie and q3.remise_pct = p.remise_pct and q3.ds = p.ds) """ + digest_sql("x", ["produit_key"], PF))
def _(t):
    return digest(P.pricing_features(t.panel, t.daily, J.expand_promotions(t.promotions, t.products)), ["produit_key"], PF)


