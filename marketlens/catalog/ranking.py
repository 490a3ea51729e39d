"""Sorts, limits, top-k, fusion; set operations."""
from pyspark.sql import functions as F

from marketlens.catalog.base import query
from marketlens.operators import joins as J
from marketlens.operators import kpis as K
from marketlens.operators import ranking as R


def scores(t):
    return t.confirmed.groupBy("client_key", "produit_key").agg(F.sum("quantite").cast("double").alias("score"))


SC = "sc as (select client_key, produit_key, sum(quantite)::double as score from confirmed group by 1, 2)"
GLOBAL = "gp as (select produit_key, count(distinct client_key)::double as score from confirmed group by 1)"


def popularity(t):
    return t.confirmed.groupBy("produit_key").agg(F.count_distinct("client_key").cast("double").alias("score"))


@query("top1_top_k", f"""
with {SC}, x as (select client_key, produit_key from sales where remise_pct = 10)
select client_key, produit_key, score, row_number() over (partition by client_key order by score desc, produit_key)::int as rang from sc where (client_key, produit_key) not in (select (client_key, produit_key) from x) qualify rang <= 5""")
def _(t):
    return R.top_k(scores(t), 5, t.sales.filter("remise_pct = 10"))


@query("top2_rank_with_fallback", f"""
with {GLOBAL}, ctx as (select distinct client_key from sc), {SC}, ci as (select distinct client_key, produit_key from sales where remise_pct = 10),
a as (select sc.client_key, sc.produit_key, sc.score, 0 as tier, row_number() over (partition by sc.client_key order by sc.score desc, gp.score desc, sc.produit_key) as p from sc join gp using (produit_key)
  where sc.score > 60 and not exists (select 1 from ci where ci.client_key = sc.client_key and ci.produit_key = sc.produit_key)),
go as (select produit_key, row_number() over (order by score desc, produit_key) as p from gp),
f as (select c.client_key, go.produit_key, 0.0 as score, 1 as tier, go.p from ctx c, go where go.p <= 60 and not exists (select 1 from ci where ci.client_key = c.client_key and ci.produit_key = go.produit_key)
  and not exists (select 1 from a where a.client_key = c.client_key and a.produit_key = go.produit_key))
select client_key, produit_key, score, row_number() over (partition by client_key order by tier, p)::int as rang from (select * from a union all select * from f) qualify rang <= 10""".replace(
    f"with {GLOBAL}, ctx as (select distinct client_key from sc), {SC}", f"with {GLOBAL}, {SC}, ctx as (select distinct client_key from sc)"))
def _(t):
    strong = scores(t).withColumn("score", F.when(F.col("score") > 60, F.col("score")).otherwise(0.0))
    ctx_items = t.sales.filter("remise_pct = 10").select("client_key", "produit_key").distinct()
    return R.rank_with_fallback(strong, scores(t), popularity(t), 10, ctx_items, ctx="client_key", tie=F.col("produit_key"))


def groups(t):
    lines = t.confirmed.join(t.products.select("produit_key", "categorie", "marque"), "produit_key")
    return (lines.groupBy("client_key", F.concat_ws("/", "marque", "categorie").alias("produit_key"), "categorie").agg(F.sum("quantite").cast("double").alias("score")))


GR = "gr as (select client_key, marque || '/' || categorie as produit_key, categorie, sum(quantite)::double as score from confirmed join products using (produit_key) group by all)"
DIV = """ex as (select produit_key, count(distinct client_key) / (select count(distinct client_key) from gr) as exposure from gr group by 1),
pn as (select client_key, produit_key, categorie, case when exposure > 0.1 then score * (1 - 0.5::double * (exposure - 0.1::double) / (1 - 0.1::double)) else score end as score from gr join ex using (produit_key)),
r1 as (select *, row_number() over (partition by client_key order by score desc, produit_key) as r, row_number() over (partition by client_key, categorie order by score desc, produit_key) as c from pn),
r2 as (select *, case when c <= 3 then row_number() over (partition by client_key, c <= 3 order by r) end as s from r1),
r3 as (select *, coalesce(s <= 10, false) as inn from r2)"""


@query("top3_rerank_diversity", f"""
with {GR}, {DIV} select client_key, produit_key, categorie, round(score, 8) as score, row_number() over (partition by client_key order by case when inn then s else r + 10 end)::int as rang from r3 qualify rang <= 10""")
def _(t):
    g = groups(t)
    out = R.rerank_diversity(g, R.exposure_share(g), threshold=0.1)
    return out.withColumn("score", F.round("score", 8))


@query("top4_mix_recommendation", f"""
with {GLOBAL}, {SC}, b as (select client_key, produit_key, row_number() over (partition by client_key order by score desc, produit_key) as rang from sc),
p as (select client_key, produit_key, row_number() over (partition by client_key order by sc.score, produit_key) as rang from sc join products using (produit_key) where categorie in ('ECONOMY', 'PROMO')),
el as (select client_key from sc group by 1 having count(*) >= 20),
x as (select client_key, produit_key, case when client_key not in (from el) or rang <= 7 then 0 else 2 end as t, rang, case when client_key in (from el) then 'personnalise' else 'repli_v1' end as source from b
  union all select client_key, produit_key, 1, rang, 'personnalise' from p where client_key in (from el)),
m as (select client_key, produit_key, min((t, rang)) as k, min(source) as source from x group by 1, 2)
select client_key, produit_key, row_number() over (partition by client_key order by k, produit_key)::int as rang, source from m qualify rang <= 10""")
def _(t):
    from pyspark.sql import Window
    sc = scores(t)
    base = sc.withColumn("rang", F.row_number().over(Window.partitionBy("client_key").orderBy(F.desc("score"), "produit_key")))
    mine = sc.join(t.products.filter("categorie in ('ECONOMY', 'PROMO')").select("produit_key"), "produit_key")
    pref = mine.withColumn("rang", F.row_number().over(Window.partitionBy("client_key").orderBy("score", "produit_key")))
    eligible = sc.groupBy("client_key").count().filter("count >= 20")
    return R.mix_recommendation(base, pref, eligible, "7/3")


@query("top5_popularity_top", f"""
with {GLOBAL} select produit_key, score from gp where produit_key in (select produit_key from products where categorie = 'LARGE') and produit_key not in (select produit_key from web) order by score desc, produit_key limit 20""")
def _(t):
    return R.popularity_top(popularity(t), 20, t.products.filter("categorie = 'LARGE'"), t.web)


@query("top6_recent_sales", "select vente_id, ds, produit_key, quantite from sales order by ds desc, vente_id, produit_key, quantite, montant_net limit 200")
def _(t):
    return R.recent_sales(t.sales).select("vente_id", "ds", "produit_key", "quantite")


@query("top6_stock_ascending", "select produit_key, arg_max(niveau_stock, ds) as niveau_stock from stock group by 1 order by 2, 1 limit 100")
def _(t):
    return R.stock_ascending(t.stock, 100)


@query("top6_client_list", """
with h as (select client_key, count(distinct order_id) n, max(ds) d, round(sum(montant_net), 4) as ca_total, greatest(max(ds) - min(ds), 1)::int ja from confirmed group by 1),
s as (select client_key, ca_total, ((select max(ds) from confirmed) - d)::int as jours_inactif, n, round(n / (ja / 30.0), 2) f, case when n > 1 then round(ja / (n - 1), 1) else ja end e from h),
q as (select *, case when jours_inactif >= 730 then 'churn' when jours_inactif >= 180 then 'inactif' when n >= 2 and (f >= 1.5 or e <= 14) then 'vip' else 'loyal' end as statut from s)
select client_key, statut, jours_inactif, ca_total from q order by case statut when 'churn' then 0 when 'inactif' then 1 when 'vip' then 2 else 3 end, jours_inactif desc, ca_total desc, client_key limit 300""")
def _(t):
    ref = t.confirmed.agg(F.max("ds")).scalar()
    return R.client_list(K.client_status(K.purchase_rhythm(t.confirmed), ref), 300).select("client_key", "statut", "jours_inactif", "ca_total")


LISTS = """l2 as (select client_key, produit_key, count(*)::double as score from confirmed group by 1, 2), l3 as (select client_key, produit_key, sum(montant_net) as score from confirmed group by 1, 2)"""


def _lists(t):
    return [scores(t), t.confirmed.groupBy("client_key", "produit_key").agg(F.count(F.lit(1)).cast("double").alias("score")),
            t.confirmed.groupBy("client_key", "produit_key").agg(F.sum("montant_net").alias("score"))]


@query("top7_rrf", f"""
with {SC}, {LISTS}, u as (select client_key, produit_key, row_number() over (partition by client_key order by score desc, produit_key) r from sc union all select client_key, produit_key, row_number() over (partition by client_key order by score desc, produit_key) from l2
  union all select client_key, produit_key, row_number() over (partition by client_key order by score desc, produit_key) from l3)
select client_key, produit_key, round(sum(1.0::double / (60 + r)), 8) as score, count(*) as n_sources from u group by 1, 2""")
def _(t):
    return R.rrf(_lists(t)).withColumn("score", F.round("score", 8))


@query("top8_candidate_union", f"""
with {SC}, {LISTS}, u as (select 'qty' src, client_key, produit_key, row_number() over (partition by client_key order by score desc, produit_key) r from sc qualify r <= 10
  union all select 'n', client_key, produit_key, row_number() over (partition by client_key order by score desc, produit_key) r from l2 qualify r <= 10 union all select 'ca', client_key, produit_key, row_number() over (partition by client_key order by score desc, produit_key) r from l3 qualify r <= 10),
g as (select client_key, produit_key, sum(1.0::double / r) as score, count(*) as n_sources, max(case when src = 'qty' then 1.0::double / r end) as score_qty, max(case when src = 'n' then 1.0::double / r end) as score_n, max(case when src = 'ca' then 1.0::double / r end) as score_ca from u group by 1, 2)
select * exclude (score), round(score, 8) as score, row_number() over (partition by client_key order by round(score, 9) desc, produit_key)::int as rang from g qualify rang <= 12""")
def _(t):
    a, b, c = _lists(t)
    return R.candidate_union({"qty": a, "n": b, "ca": c}, 10, 12).withColumn("score", F.round("score", 8))


@query("set1_union_dates", "select min(d) as debut, max(d) as fin from (select ds d from sales union all select cast(event_timestamp as date) from web)")
def _(t):
    return R.union_dates(t.sales, t.web.select(F.to_date("event_timestamp").alias("ds")))


@query("set2_union_scopes", """
select produit_key, promo_key, remise_pct, 'product' as portee, null::varchar as categorie from promotions join products on cible = product_id where portee = 'product'
union all select produit_key, promo_key, remise_pct, 'category', categorie from promotions join products on cible = categorie where portee = 'category'""")
def _(t):
    one = J.promotion_products(t.promotions, t.products, {"product": "product_id"}).select("produit_key", "promo_key", "remise_pct", "portee")
    many = (J.promotion_products(t.promotions, t.products, {"category": "categorie"}).join(t.products.select("produit_key", "categorie"), "produit_key")
            .select("produit_key", "promo_key", "remise_pct", "portee", "categorie"))
    return R.union_scopes(one, many)


@query("set3_keep_first", "select client_key, ds, order_id, quantite from (select client_key, ds, order_id, produit_key, quantite, row_number() over (partition by client_key order by ds, order_id, produit_key, quantite) rn from sales) where rn = 1")
def _(t):
    return R.keep_first(t.sales.select("client_key", "ds", "order_id", "produit_key", "quantite"), ["client_key"], ["ds", "order_id", "produit_key", "quantite"]).drop("produit_key")


@query("set4_set_difference", "select distinct produit_key, client_key from sales where ds >= date '2000-01-01' except select produit_key, client_key from sales where ds < date '2000-01-01'")
def _(t):
    pick = t.sales.select("produit_key", "client_key", "ds")
    cut = F.lit("2000-01-01").cast("date")
    return R.set_difference(pick.filter(F.col("ds") >= cut).drop("ds"), pick.filter(F.col("ds") < cut).drop("ds"))


@query("set5_set_intersection", "select produit_key from panel where en_promotion intersect select produit_key from panel where not en_promotion")
def _(t):
    return R.set_intersection(t.panel.filter("en_promotion").select("produit_key"), t.panel.filter("not en_promotion").select("produit_key"))


@query("set5_list_hits", """
with a as (select client_key, list(distinct produit_key) l from confirmed where ds < date '2001-01-01' group by 1), b as (select client_key, list(distinct produit_key) l from confirmed where ds >= date '2001-01-01' group by 1)
select client_key, len(list_intersect(a.l, b.l))::int as hits from a join b using (client_key)""")
def _(t):
    cut = F.lit("2001-01-01").cast("date")
    pairs = t.confirmed.select("client_key", "produit_key", (F.col("ds") < cut).alias("before"))
    sides = pairs.groupBy("client_key", "produit_key").agg(F.bool_or("before").alias("a"), F.bool_or(~F.col("before")).alias("b"))
    per = sides.groupBy("client_key").agg(F.count_if("a").alias("na"), F.count_if("b").alias("nb"), F.count_if(F.col("a") & F.col("b")).cast("int").alias("hits"))
    return per.filter("na > 0 and nb > 0").select("client_key", "hits")


@query("set5_recommended_list_hits", """
with a as (select client_key, produit_key, row_number() over (partition by client_key order by sum(quantite)::double desc, produit_key) r from confirmed where ds < date '2001-01-01' group by 1, 2), l as (select client_key, list(produit_key) l from a where r <= 10 group by 1),
b as (select client_key, produit_key, row_number() over (partition by client_key order by sum(quantite)::double desc, produit_key) r from confirmed where ds >= date '2000-01-01' group by 1, 2), m as (select client_key, list(produit_key) m from b where r <= 10 group by 1)
select client_key, len(list_intersect(l, m))::int as hits from l join m using (client_key)""")
def _(t):
    def top(lines, name):
        best = R.top_k(lines.groupBy("client_key", "produit_key").agg(F.sum("quantite").cast("double").alias("score")), 10)
        return best.groupBy("client_key").agg(F.collect_list("produit_key").alias(name))  # ten items per list
    before = top(t.confirmed.filter("ds < date '2001-01-01'"), "a")
    after = top(t.confirmed.filter("ds >= date '2000-01-01'"), "b")
    return before.join(after, "client_key").select("client_key", R.list_hits(F.col("a"), F.col("b")).alias("hits"))
