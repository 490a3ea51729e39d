"""Recommendation."""
from types import SimpleNamespace

from pyspark.sql import functions as F

from marketlens.catalog.base import query
from marketlens.functions import scalar as S
from marketlens.functions.scalar import r
from marketlens.operators import aggregates as A
from marketlens.operators import filters as L
from marketlens.operators import joins as J
from marketlens.operators import ranking as K
from marketlens.operators.ordered import materialise
from marketlens.plans import factors as X
from marketlens.plans import rankers
from marketlens.plans import recsys as R

CUT = "2001-01-01"


def lines(t):
    return t.confirmed.join(t.products.select("produit_key", "categorie", "marque", "prix_base"), "produit_key")


def numbered_items(t):
    """Items of the orders with their windows, with products numbered in sorted order, and the numbers."""
    return R.coded(R.windowed_items(lines(t)))


def cutoff():
    return F.lit(CUT).cast("date")


def candidates_of(web):
    """Products a known client looked at on the web."""
    return web.filter("client_key is not null").select("client_key", "produit_key").distinct()


def candidates(t):
    return candidates_of(t.web)


LN = "ln as (select c.*, categorie, marque, prix_base from confirmed c join products using (produit_key)), cd as (select distinct client_key, produit_key from web where client_key is not null)"
BM = "bm as (select distinct client_key, produit_key from confirmed)"
PAIRS = "co as (select x.produit_key as a, y.produit_key as b, count(*) as n from bm x join bm y on x.client_key = y.client_key and x.produit_key < y.produit_key group by 1, 2)"


@query("rec1_popularity_global", "with s as (select produit_key, count(distinct client_key)::double as n from confirmed group by 1) select produit_key, n / (select max(n) from s) as score from s")
def _(t):
    return R.popularity(t.confirmed)


@query("rec1_popularity_recent", "with s as (select produit_key, count(distinct client_key)::double as n from confirmed where ds > (select max(ds) from confirmed) - 60 group by 1) select produit_key, n / (select max(n) from s) as score from s")
def _(t):
    return R.popularity(t.confirmed, F.date_sub(t.confirmed.agg(F.max("ds")).scalar(), 60))


@query("rec1_popularity_by_category", f"""
with {LN}, b as (select produit_key, categorie, count(distinct client_key)::double as n from ln group by 1, 2), i as (select *, n / max(n) over (partition by categorie) as inn, n / max(n) over () as al from b),
f as (select client_key, arg_min(categorie, (-n, categorie)) as fav from (select client_key, categorie, count(*) n from ln group by 1, 2) group by 1)
select cd.client_key, cd.produit_key, coalesce(case when fav is null then al when fav = categorie then inn else 0.1::double * al end, 0.0) as score from cd left join i using (produit_key) left join f using (client_key)""")
def _(t):
    return R.popularity_by_category(lines(t), candidates(t))


COS = f"{BM}, {PAIRS}, pn as (select produit_key, count(*) as p from bm group by 1), sm as (select a, b, n / (sqrt(pa.p) * sqrt(pb.p)) as sim from co join pn pa on pa.produit_key = a join pn pb on pb.produit_key = b)"


@query("rec2_item_item_cosine", f"with {COS} select a, count(*) as n, round(sum(sim), 6) as s, round(max(sim), 8) as m from sm group by 1")
def _(t):
    m, names = R.coded(R.binary_matrix(t.confirmed))
    return R.named(R.cosine(m).groupBy("a").agg(F.count(F.lit(1)).alias("n"), r(F.sum("sim")).alias("s"), r(F.max("sim"), 8).alias("m")), names, "a")


@query("rec2_item_item_scores", f"""
with {COS}, bw as (select a as src, b as dst, sim from sm union all select b, a, sim from sm), ow as (select client_key, count(*) n from bm group by 1),
rw as (select bm.client_key, dst, sum(sim) / any_value(ow.n) as s from bm join bw on bw.src = bm.produit_key join ow using (client_key) group by 1, 2), sc as (select client_key, dst, s / max(s) over (partition by client_key) as score from rw)
select client_key, count(*) as n, round(sum(score), 4) as s from sc group by 1""")
def _(t):
    m, _ = R.coded(R.binary_matrix(t.confirmed))
    return R.item_item_scores(m, R.cosine_lists(m)).groupBy("client_key").agg(F.count(F.lit(1)).alias("n"), r(F.sum("score"), 4).alias("s"))


@query("rec3_association_lift", f"with {BM}, {PAIRS}, pn as (select produit_key, count(*) as p from bm group by 1), u as (select count(distinct client_key) as k from bm) select a, count(*) as n, sum(co.n)::bigint as co, round(sum(co.n * k / (pa.p * pb.p)), 6) as lift from co join pn pa on pa.produit_key = a join pn pb on pb.produit_key = b, u group by 1")
def _(t):
    m, names = R.coded(R.binary_matrix(t.confirmed))
    return R.named(R.association_lift(t.confirmed, m).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("co").alias("co"), r(F.sum("lift")).alias("lift")), names, "a")


@query("rec4_content_score", f"""
with {LN}, sel as (select * from ln), wv as (select w.client_key, p.categorie from web w join products p using (produit_key) where event_type in ('view', 'add_to_cart') and client_key is not null and produit_key in (select produit_key from sel)),
sb as (select client_key, categorie, count(*) / sum(count(*)) over (partition by client_key) as v from sel group by 1, 2), sw as (select client_key, categorie, count(*) / sum(count(*)) over (partition by client_key) as v from wv group by 1, 2),
pr as (select client_key, avg(prix_base) as ref from sel group by 1), s as (select produit_key, count(distinct client_key)::double n from sel group by 1), gp as (select produit_key, n / (select max(n) from s) as pop from s)
select cd.client_key, cd.produit_key, round(coalesce(0.7::double * case when cd.client_key in (select client_key from sb) then coalesce(sb.v, 0) when cd.client_key in (select client_key from sw) then coalesce(sw.v, 0) end
  + 0.3::double * case when ref is not null then 1 / (1 + abs(p.prix_base - ref) / greatest(ref, 1)) else 0.5 end, pop, 0), 8) as score
from cd join products p using (produit_key) left join sb on sb.client_key = cd.client_key and sb.categorie = p.categorie left join sw on sw.client_key = cd.client_key and sw.categorie = p.categorie left join pr on pr.client_key = cd.client_key left join gp on gp.produit_key = cd.produit_key""")
def _(t):
    return R.content_score(t.confirmed, t.web, t.products, candidates(t)).withColumn("score", r("score", 8))


BM25 = """mx as (select client_key, produit_key, count(*)::double as v from confirmed group by 1, 2), ln2 as (select client_key, sum(v) as l from mx group by 1), st as (select avg(l) as av, count(*) as n from ln2), dfq as (select produit_key, count(*) as f from mx group by 1),
wt as (select client_key, produit_key, greatest(ln((n - f + 0.5::double) / (f + 0.5::double)), 0) * v * 2.2::double / (v + 1.2::double * (0.25::double + 0.75::double * l / av)) as v from mx join ln2 using (client_key) join dfq using (produit_key), st)"""


@query("rec5_bm25_matrix", f"with {BM25} select client_key, produit_key, round(v, 8) as v from wt")
def _(t):
    m = t.confirmed.groupBy("client_key", "produit_key").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return R.bm25_matrix(m).withColumn("v", r("v", 8))


@query("rec5_bm25_similarity", f"""
with {BM25}, nm as (select produit_key, sqrt(sum(v * v)) as q from wt group by 1), d as (select x.produit_key as a, y.produit_key as b, sum(x.v * y.v) as d from wt x join wt y on x.client_key = y.client_key and x.produit_key < y.produit_key group by 1, 2)
select a, count(*) as n, round(sum(d / (na.q * nb.q)), 6) as s from d join nm na on na.produit_key = a join nm nb on nb.produit_key = b group by 1""")
def _(t):
    m = t.confirmed.groupBy("client_key", "produit_key").agg(F.count(F.lit(1)).cast("double").alias("v"))
    d, names = R.coded(R.bm25_matrix(m))
    return R.named(R.cosine(d).groupBy("a").agg(F.count(F.lit(1)).alias("n"), r(F.sum("sim")).alias("s")), names, "a")


@query("rec6_implicit_factors")
def _(t):
    m = t.confirmed.groupBy("client_key", "produit_key").agg(F.sum("quantite").cast("double").alias("v"))
    return R.implicit_factors(m, rank=6, iterations=3)


def purchase_matrix(t):
    return t.confirmed.groupBy("client_key", "produit_key").agg(F.log1p(F.sum("quantite").cast("double")).alias("v"))


@query("rec6_svd_factors")
def _(t):
    users, items, values = X.truncated_svd(purchase_matrix(t), components=32)
    return X.factor_scores(candidates(t), users, items, len(values)).withColumn("score", r("score", 6))


@query("rec6_bpr_factors")
def _(t):
    users, items = X.bpr_factors(purchase_matrix(t), factors=24, epochs=8)
    return X.factor_scores(candidates(t), users, items, 24).withColumn("score", r("score", 6))


WEB_CUT = "2001-01-20"


@query("rec7_hybrid_purchase_web", f"""
with h as (select client_key, produit_key, sum(v) as v from (select client_key, produit_key, 1.0::double as v from confirmed where ds < date '{WEB_CUT}' union all select client_key, produit_key, case event_type when 'view' then 1.0 when 'click' then 2.0 when 'add_to_cart' then 3.0 else 0.0 end::double * 0.2::double from web
  where client_key is not null and not est_bot and event_type <> 'purchase' and event_timestamp < timestamp '{WEB_CUT}') group by 1, 2),
nm as (select produit_key, sqrt(sum(v * v)) as q from h group by 1), d as (select x.produit_key as a, y.produit_key as b, sum(x.v * y.v) as d from h x join h y on x.client_key = y.client_key and x.produit_key < y.produit_key group by 1, 2)
select a, count(*) as n, round(sum(d / nullif(na.q * nb.q, 0)), 6) as s from d join nm na on na.produit_key = a join nm nb on nb.produit_key = b group by 1""")
def _(t):
    m = R.hybrid_matrix(t.confirmed, A.interactions(t.web), F.lit(WEB_CUT).cast("timestamp"))
    d, names = R.coded(m)
    return R.named(R.cosine(d).groupBy("a").agg(F.count(F.lit(1)).alias("n"), r(F.sum("sim")).alias("s")), names, "a")


MASK = f"""{LN}, mo as (select order_id, min(ds) as ds from ln group by 1 having count(distinct produit_key) >= 2), dn as (select ds, count(*) as n from mo group by 1),
dw as (select ds, (floor((sum(n) over (order by ds) - n) * 4 / sum(n) over ()) + 1)::int as w from dn), oi as (select distinct ln.order_id, produit_key, categorie, w from ln join mo using (order_id) join dw on dw.ds = mo.ds),
tg as (select order_id, w, min(produit_key) as target, count(*) as n_items from oi group by 1, 2), cx as (select oi.* from oi join tg using (order_id) where produit_key <> target), kw as (select unnest([2, 3, 4])::int as w),
oc as (select kw.w, x.produit_key as src, y.produit_key as dst, count(*) as n from oi x join oi y on x.order_id = y.order_id and x.produit_key <> y.produit_key join kw on x.w < kw.w group by 1, 2, 3),
op as (select kw.w, produit_key, count(*) as pop from oi join kw on oi.w < kw.w group by 1, 2), cp as (select kw.w, categorie, produit_key, count(*) as cpop from oi join kw on oi.w < kw.w group by 1, 2, 3)"""


@query("rec8_complement_scores", f"""
with {MASK}, sc as (select order_id, cx.w, dst as produit_key, sum(n)::double as v from cx join oc on oc.src = cx.produit_key and oc.w = cx.w group by 1, 2, 3)
select order_id, sc.w as "window", count(*) as n, sum(v) as cooccurrence, round(sum(v / (1 + ln(1 + pop))), 6) as bm25, round(sum(v / greatest(pop, 1)), 6) as lift from sc join op on op.produit_key = sc.produit_key and op.w = sc.w group by 1, 2""")
def _(t):
    items, _ = numbered_items(t)
    s = R.complement_scores(R.masked_context(items, R.masked_target(items)), R.basket_statistics(items))
    return s.groupBy("order_id", "window").agg(F.count(F.lit(1)).alias("n"), F.sum("cooccurrence").alias("cooccurrence"), r(F.sum("bm25")).alias("bm25"), r(F.sum("lift")).alias("lift"))


@query("rec8_basket_statistics", f"with {MASK} select w as \"window\", categorie, count(*) as n_items, sum(cpop)::bigint as total, max(cpop) as best from cp group by 1, 2")
def _(t):
    return R.basket_statistics(lines(t))["category"].groupBy("window", "categorie").agg(F.count(F.lit(1)).alias("n_items"), F.sum("cpop").alias("total"), F.max("cpop").alias("best"))


@query("rec9_masked_target", f"with {MASK} select order_id, target, n_items from tg")
def _(t):
    return R.masked_target(t.confirmed)


@query("rec10_user_cooccurrence", f"""
with {LN}, {BM}, {PAIRS}, bw as (select a as src, b as dst, n from co union all select b, a, n from co), s as (select cd.client_key, cd.produit_key, sum(n) as v from cd join bm on bm.client_key = cd.client_key join bw on bw.src = bm.produit_key and bw.dst = cd.produit_key group by 1, 2),
pp as (select produit_key, count(*) p from bm group by 1)
select cd.client_key, cd.produit_key, case when cd.client_key in (select client_key from bm) then coalesce(v, 0) else coalesce(p, 0) end::double as score from cd left join s using (client_key, produit_key) left join pp using (produit_key)""")
def _(t):
    return R.user_cooccurrence(t.confirmed, candidates(t))


@query("rec11_weighted_blend", """
with a as (select client_key, produit_key, sum(quantite)::double s from confirmed group by 1, 2), b as (select client_key, produit_key, count(*)::double s from sales where remise_pct >= 5 group by 1, 2),
na as (select client_key, produit_key, coalesce((s - min(s) over w) / nullif(max(s) over w - min(s) over w, 0), 0) v from a window w as (partition by client_key)), nb as (select client_key, produit_key, coalesce((s - min(s) over w) / nullif(max(s) over w - min(s) over w, 0), 0) v from b window w as (partition by client_key))
select client_key, produit_key, 0.6::double * coalesce(na.v, 0) + (1 - 0.6::double) * coalesce(nb.v, 0) as score from na full join nb using (client_key, produit_key)""")
def _(t):
    a = t.confirmed.groupBy("client_key", "produit_key").agg(F.sum("quantite").cast("double").alias("score"))
    b = t.sales.filter("remise_pct >= 5").groupBy("client_key", "produit_key").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return R.blended_scores(a, b).withColumn("score", F.col("score"))


@query("rec11_category_mean_popularity", f"with {LN} select categorie, avg(q) as score from (select categorie, produit_key, sum(quantite) q from ln group by 1, 2) group by 1")
def _(t):
    return R.category_mean_popularity(lines(t))


@query("rec12_regularised_popularity", """
with g as (select produit_key, count(distinct client_key)::double n from confirmed group by 1), c as (select produit_key, count(distinct client_key)::double n from confirmed where ds > (select max(ds) from confirmed) - 180 group by 1)
select produit_key, w as alpha, w * (g.n / (select max(n) from g)) + (1 - w) * coalesce(c.n / (select max(n) from c), 0.0) as score from g left join c using (produit_key), (values (0.25::double), (0.75::double)) v(w)""")
def _(t):
    glob, rec = R.popularity(t.confirmed), R.popularity(t.confirmed, F.date_sub(t.confirmed.agg(F.max("ds")).scalar(), 180))
    out = None
    for a in (0.25, 0.75):
        part = R.regularised_popularity(glob, rec, a).withColumn("alpha", F.lit(a))
        out = part if out is None else out.unionByName(part)
    return out


@query("rec12_choose_alpha_on_past", """
with s as (select year(ds)::int as "window", (remise_pct % 5) / 4.0::double as alpha, avg(quantite) as v from sales group by 1, 2), w as (select distinct "window" from s), m as (select w."window", alpha, avg(v) m from s join w on s."window" < w."window" group by 1, 2)
select w."window", coalesce(arg_min(alpha, (-round(m, 10), alpha)), 0.5) as choix from w left join m using ("window") group by 1""")
def _(t):
    s = t.sales.groupBy(F.year("ds").alias("window"), ((F.col("remise_pct") % 5) / F.lit(4.0)).alias("alpha")).agg(F.avg("quantite").alias("v"))
    return R.choose_on_past(s, "alpha", "v", 0.5)


@query("rec13_client_profiles", f"""
with {LN}, sel as (select * from ln), n as (select client_key, categorie, count(*) c from sel group by 1, 2), tt as (select client_key, sum(c)::bigint as na, count(*) as nc from n group by 1),
d as (select n.*, na, nc, (sum(c) over (partition by client_key order by c desc, categorie) - c) / na < 0.6::double - 1e-12::double as dom from n join tt using (client_key)),
p as (select client_key, any_value(na) as n_achats, any_value(nc) as n_categories, count(case when dom then 1 end) as nd, string_agg(categorie, '|' order by categorie) filter (dom) as cats from d group by 1),
q as (select *, case when n_achats < 3 then 'moins_de_3_achats' when n_categories < 2 then 'moins_de_2_categories' when nd >= n_categories and n_categories > 2 then 'profil_trop_diffus' end as raison from p)
select client_key, n_achats, n_categories, raison is null as eligible, raison, case when raison is null then cats else '' end as dominantes from q""")
def _(t):
    return R.client_profiles(lines(t))


@query("rec14_candidate_policy", f"""
with {LN}, st as (select produit_key from stock where ds <= date '2001-03-15' group by 1 having arg_max(niveau_stock, ds) > 10) select client_key, produit_key from cd where (client_key, produit_key) not in (select (client_key, produit_key) from confirmed) and produit_key in (from st)""")
def _(t):
    avail = J.stock_available_at(t.stock, F.lit("2001-03-15").cast("date")).withColumn("disponible", F.col("niveau_stock") > 10)
    return R.candidate_policy(candidates(t), t.confirmed, avail)


@query("rec14_score_with_fallback", f"""
with {LN}, a as (select client_key, produit_key, sum(quantite)::double s from confirmed group by 1, 2), g as (select produit_key, count(distinct client_key)::double n from confirmed group by 1)
select client_key, produit_key, case when client_key in (select client_key from a) then coalesce(s, 0.0) else coalesce(n / (select max(n) from g), 0.0) end as score, case when client_key in (select client_key from a) then 'achats' else 'popularite' end as modele
from cd left join a using (client_key, produit_key) left join g using (produit_key)""")
def _(t):
    own = t.confirmed.groupBy("client_key", "produit_key").agg(F.sum("quantite").cast("double").alias("score"))
    return R.score_with_fallback(candidates(t), [("achats", own), ("popularite", R.popularity(t.confirmed))])


RF = f"""{LN}, pa as (select * from ln where ds < date '{CUT}'), af as (select client_key, categorie, count(*) v from pa group by 1, 2), la as (select client_key, (date '{CUT}' - max(ds))::int as rc, count(*) as fq from pa group by 1), po as (select produit_key, sum(quantite) v from pa group by 1),
sk as (select produit_key, arg_max(niveau_stock, ds) v from stock where ds <= date '{CUT}' group by 1),
rf as (select cd.client_key, cd.produit_key, coalesce(po.v, 0)::bigint as popularite, coalesce(af.v, 0) as affinite, coalesce(rc, 9999) as recence, coalesce(fq, 0) as frequence, coalesce(sk.v, 0) as stock, p.prix_base, p.prix_base - cout as marge
  from cd join products p using (produit_key) left join af on af.client_key = cd.client_key and af.categorie = p.categorie left join la on la.client_key = cd.client_key left join po on po.produit_key = cd.produit_key left join sk on sk.produit_key = cd.produit_key)"""


@query("rec15_ranker_features", f"with {RF} select * from rf")
def _(t):
    return R.ranker_features(candidates(t), t.confirmed, t.products, t.stock, cutoff())


def _labelled(t, cut):
    """Candidates seen before the cutoff; the label is a web purchase from the cutoff on."""
    at = F.lit(cut).cast("timestamp")
    seen = candidates_of(t.web.filter(F.col("event_timestamp") < at))
    f = R.ranker_features(seen, t.confirmed, t.products, t.stock, F.lit(cut).cast("date"))
    bought = t.web.filter("event_type = 'purchase' and client_key is not null").filter(F.col("event_timestamp") >= at).select("client_key", "produit_key").distinct().withColumn("y", F.lit(1))
    return f.join(bought, ["client_key", "produit_key"], "left").na.fill(0, ["y"])


@query("rec16_pointwise_ranker")
def _(t):
    known = t.web.filter(F.col("event_timestamp") < F.lit(WEB_CUT).cast("timestamp"))
    earlier = _labelled(SimpleNamespace(web=known, confirmed=t.confirmed, products=t.products, stock=t.stock), "2001-01-10")
    return R.pointwise_ranker(earlier, _labelled(t, WEB_CUT).drop("y"), ["popularite", "affinite", "recence", "stock", "prix_base", "marge"]).select("client_key", "produit_key", "score")


def ranked_events(t, cut):
    """Ten events in a row are a slate; of each row the features of client and product before the cutoff, and whether it is a purchase."""
    rows = t.web.filter("client_key is not null").select(F.floor(F.col("event_id") / 10).alias("slate"), "event_id", "event_timestamp", "client_key", "produit_key", (F.col("event_type") == "purchase").cast("int").alias("y"))
    known = R.ranker_features(rows.select("client_key", "produit_key").distinct(), t.confirmed, t.products, t.stock, F.lit(cut).cast("date"))
    return materialise(rows.join(known, ["client_key", "produit_key"]))


RANKED_BY = ["popularite", "affinite", "recence", "frequence", "stock", "prix_base", "marge"]


@query("rec16_lambda_ranker")
def _(t):
    rows = ranked_events(t, "2001-01-01")
    before = F.col("event_timestamp") < F.lit(WEB_CUT).cast("timestamp")
    scored = rankers.lambda_ranker(rows.filter(before), rows.filter(~before).drop("y"), RANKED_BY, "slate", "event_id")
    return scored.select("slate", "event_id", "produit_key", "score")


def slates(t):
    group = F.when(F.substring(F.coalesce("client_key", "anonymous_id"), -1, 1).isin("0", "2", "4", "6", "8"), "controle").otherwise("traitement")
    return R.weekly_slates(t.web, t.confirmed, t.products, group)


@query("rec17_weekly_slates", """
with cl as (select * from web where session_id not in (select session_id from web where est_bot)),
me as (select session_id, min(event_timestamp) as its, min(client_key) as client_key, min(anonymous_id) as anonymous_id from cl group by 1), mw as (select *, date_trunc('week', its)::date as wk, case when right(coalesce(client_key, anonymous_id), 1) in ('0', '2', '4', '6', '8') then 'controle' else 'traitement' end as groupe from me),
sw as (select produit_key, date_trunc('week', ds)::date as w, sum(quantite) q from confirmed group by 1, 2), pw as (select wk, produit_key, sum(q)::double as pop from (select distinct wk from mw) join sw on w < wk and w >= wk - 28 group by 1, 2),
af as (select k.wk, client_key, categorie, count(*) as a from (select distinct wk from mw) k join confirmed on date_trunc('week', ds)::date < k.wk and date_trunc('week', ds)::date >= k.wk - 28 join products using (produit_key) group by 1, 2, 3),
sc as (select session_id, mw.client_key, its, groupe, pw.produit_key, case when groupe = 'controle' then pop else coalesce(a, 0) * 100000.0::double + pop end as score from mw join pw using (wk) join products p on p.produit_key = pw.produit_key and cast(valid_from as timestamp) < its
  left join af on af.client_key = mw.client_key and af.categorie = p.categorie and af.wk = mw.wk),
tp as (select *, row_number() over (partition by session_id order by score desc, produit_key)::int as rang from sc qualify rang <= 5),
fe as (select session_id, produit_key, min(event_timestamp) filter (event_type = 'view') v, min(event_timestamp) filter (event_type = 'purchase') b from cl group by 1, 2)
select session_id, groupe, produit_key, rang, score, round(exp(score - max(score) over w) / sum(exp(score - m)) over w, 8) as probability, coalesce(v > its, false) as viewed_after, coalesce(b > its, false) as purchased_after
from (select *, max(score) over (partition by session_id) m from tp) left join fe using (session_id, produit_key) window w as (partition by session_id)""")
def _(t):
    return slates(t).select("session_id", "groupe", "produit_key", "rang", "score", r("probability", 8).alias("probability"), "viewed_after", "purchased_after")


@query("rec18_uniform_session_sample")
def _(t):
    s = L.exclude_bot_sessions(t.web).filter(S.hash_sample(F.col("session_id"), 0.25))
    return s.groupBy("event_type").agg(F.count_distinct("session_id").alias("n_sessions"), F.count(F.lit(1)).alias("n"))


@query("rec19_next_purchase_audit", f"""
with tr as (select * from confirmed where ds < date '{CUT}'), tt as (select distinct client_key, produit_key from confirmed where ds >= date '{CUT}'),
gp as (select produit_key, row_number() over (order by count(distinct client_key) desc, produit_key) r from tr group by 1 qualify r <= 200), ow as (select client_key, produit_key, row_number() over (partition by client_key order by sum(quantite) desc, produit_key) r from tr group by 1, 2 qualify r <= 50),
x as (select client_key, avg((produit_key in (select produit_key from gp))::int) a, avg(((client_key, produit_key) in (select (client_key, produit_key) from ow))::int) b from tt group by 1)
select 'popularite' as scenario, avg(a) as recall, count(*) as n from x union all select 'rachat', avg(b), count(*) from x""")
def _(t):
    from pyspark.sql import Window
    tr, te = t.confirmed.filter(F.col("ds") < cutoff()), t.confirmed.filter(F.col("ds") >= cutoff())
    pop = tr.groupBy("produit_key").agg(F.count_distinct("client_key").alias("score"))
    top = K.popularity_top(pop, 200)
    truth = te.select("client_key", "produit_key").distinct()
    cov = truth.join(top.select("produit_key"), "produit_key", "left_semi")
    own = K.top_k(tr.groupBy("client_key", "produit_key").agg(F.sum("quantite").cast("double").alias("score")), 50)
    return (R.recall_of(cov, truth).withColumn("scenario", F.lit("popularite")).unionByName(R.recall_of(own, truth).withColumn("scenario", F.lit("rachat"))))


@query("rec20_session_to_purchase", f"""
with {COS}, bw as (select a as src, b as dst, sim from sm union all select b, a, sim from sm), fp as (select user_id::varchar as s, arg_min(produit_key, (event_timestamp, event_id)) as target, min(event_timestamp) as tt from web where event_type = 'purchase' group by 1),
cx as (select distinct s, target, w.produit_key as src from web w join fp on fp.s = w.user_id::varchar where event_timestamp < tt and event_type <> 'purchase'), se as (select s, target, count(*) as n_contexte, bool_or(src = target) as deja_vu from cx group by 1, 2),
sc as (select s, dst, round(sum(sim), 9) as v from cx join bw using (src) group by 1, 2), tp as (select s, dst, row_number() over (partition by s order by v desc, dst)::int as rang from sc qualify rang <= 10)
select se.s as session_id, target, n_contexte, deja_vu, rang as rang_cible, rang is not null as hit from se left join tp on tp.s = se.s and dst = target""")
def _(t):
    web = t.web.withColumn("session_id", F.col("user_id").cast("string"))
    return R.session_to_purchase(web, R.binary_matrix(t.confirmed)).select("session_id", "target", "n_contexte", "deja_vu", "rang_cible", "hit")


@query("rec21_excluded_target_reasons", f"""
with tt as (select distinct client_key, produit_key from confirmed where ds >= date '{CUT}' union select client_key, 'PRDX' from confirmed where ds >= date '2001-07-20'), bo as (select distinct client_key, produit_key from confirmed where ds < date '{CUT}'),
av as (select produit_key, arg_max(niveau_stock, ds) > 20 as d from stock where ds <= date '2001-03-15' group by 1)
select tt.client_key, tt.produit_key, case when valid_from is null then 'produit_inconnu' when valid_from > date '1995-06-01' then 'pas_encore_disponible' when bo.client_key is not null then 'deja_achete' when not coalesce(d, false) then 'sans_stock' end as raison
from tt left join products using (produit_key) left join bo on bo.client_key = tt.client_key and bo.produit_key = tt.produit_key left join av on av.produit_key = tt.produit_key""")
def _(t):
    te = t.confirmed.filter(F.col("ds") >= cutoff()).select("client_key", "produit_key").union(
        t.confirmed.filter("ds >= date '2001-07-20'").select("client_key", F.lit("PRDX"))).distinct()
    avail = J.stock_available_at(t.stock, F.lit("2001-03-15").cast("date")).withColumn("disponible", F.col("niveau_stock") > 20)
    return R.excluded_target_reasons(te, t.confirmed.filter(F.col("ds") < cutoff()), avail, t.products, F.lit("1995-06-01").cast("date"))


@query("rec22_target_coverage", f"""
with tt as (select distinct client_key, produit_key from confirmed where ds >= date '{CUT}'), bo as (select distinct client_key, produit_key from confirmed where ds < date '{CUT}'), av as (select produit_key from stock where ds <= date '2001-03-15' group by 1 having arg_max(niveau_stock, ds) > 20)
select 'stock' as politique, avg((produit_key in (from av))::int) as couverture, count(*) as n_cibles from tt union all select 'rachat', avg(((client_key, produit_key) in (select (client_key, produit_key) from bo))::int), count(*) from tt""")
def _(t):
    te, tr = t.confirmed.filter(F.col("ds") >= cutoff()), t.confirmed.filter(F.col("ds") < cutoff())
    avail = J.stock_available_at(t.stock, F.lit("2001-03-15").cast("date")).filter("niveau_stock > 20")
    return R.target_coverage(te, {"stock": avail.select("produit_key"), "rachat": tr})


@query("rec22_repurchase_rate", f"with tt as (select distinct client_key, produit_key from confirmed where ds >= date '{CUT}') select avg(((client_key, produit_key) in (select (client_key, produit_key) from confirmed where ds < date '{CUT}'))::int) as taux_rachat, count(*) as n_cibles from tt")
def _(t):
    return R.repurchase_rate(t.confirmed.filter(F.col("ds") < cutoff()), t.confirmed.filter(F.col("ds") >= cutoff()))


@query("rec22_web_ablation", f"""
with tt as (select distinct client_key, produit_key from web where event_type = 'purchase' and client_key is not null), g as (select produit_key from (select produit_key, row_number() over (order by count(distinct client_key) desc, produit_key) r from confirmed group by 1) where r <= 50),
wv as (select distinct client_key, produit_key from web where event_type <> 'purchase' and client_key is not null)
select 'sans_web' as politique, avg((produit_key in (from g))::int) as couverture, count(*) as n_cibles from tt union all select 'avec_web', avg((produit_key in (from g) or (client_key, produit_key) in (select (client_key, produit_key) from wv))::int), count(*) from tt""")
def _(t):
    truth = t.web.filter("event_type = 'purchase' and client_key is not null").select("client_key", "produit_key").distinct()
    top = K.popularity_top(t.confirmed.groupBy("produit_key").agg(F.count_distinct("client_key").alias("score")), 50).select("produit_key")
    web = t.web.filter("event_type <> 'purchase' and client_key is not null").select("client_key", "produit_key")
    base = truth.join(top, "produit_key", "left_semi").select("client_key", "produit_key")
    return R.target_coverage(truth, {"sans_web": base, "avec_web": base.unionByName(web)})


@query("rec23_batch_candidate_scoring", f"""
with {RF}, g as (select client_key, produit_key, popularite, affinite from rf) select client_key, produit_key, case when affinite > 0 then affinite * 1000.0::double + popularite else popularite::double end as score, case when affinite > 0 then 'modele' else 'repli_popularite' end as source from g""")
def _(t):
    f = R.ranker_features(candidates(t), t.confirmed, t.products, t.stock, cutoff())
    known = F.col("affinite") > 0
    return f.select("client_key", "produit_key", F.when(known, F.col("affinite") * 1000.0 + F.col("popularite")).otherwise(F.col("popularite").cast("double")).alias("score"),
                    F.when(known, "modele").otherwise("repli_popularite").alias("source"))


RANKS = f"""sc as (select order_id, cx.w, dst as produit_key, sum(n)::double as v from cx join oc on oc.src = cx.produit_key and oc.w = cx.w group by 1, 2, 3),
cc as (select order_id, x.w, produit_key, sum(cpop)::double as v from (select distinct order_id, w, categorie from cx) x join cp using (w, categorie) group by 1, 2, 3),
al as (select order_id, tg.w, op.produit_key, pop from tg join op on op.w = tg.w where not exists (select 1 from cx where cx.order_id = tg.order_id and cx.produit_key = op.produit_key)),
gs as (select al.*, m, round(coalesce(case m when 'cooccurrence' then sc.v when 'bm25' then sc.v / (1 + ln(1 + pop)) when 'lift' then sc.v / greatest(pop, 1) when 'categorie_contexte' then cc.v else 0 end, 0), 9) as s
  from al left join sc using (order_id, produit_key) left join cc using (order_id, produit_key), (values ('cooccurrence'), ('bm25'), ('lift'), ('categorie_contexte'), ('popularite')) g(m)),
gr as (select order_id, w, m as model, produit_key, row_number() over (partition by order_id, m order by s desc, pop desc, produit_key)::int as rang from gs qualify rang <= 50),
fs as (select order_id, w, produit_key, round(sum(1 / (60 + rang)), 9) as v from gr group by 1, 2, 3), fu as (select order_id, w, 'rrf' as model, produit_key, row_number() over (partition by order_id order by v desc, produit_key)::int as rang from fs qualify rang <= 50)"""


@query("rec24_candidate_recall", f"""
with {MASK}, {RANKS}, ar as (select * from gr union all select * from fu) select tg.w as "window", m.model, count(*) as n, tg.w > 1 as evaluable, avg(coalesce((rang <= 20)::int, 0)) as recall_20, avg(coalesce((rang <= 50)::int, 0)) as recall_50
from tg, (select distinct model from ar) m left join ar on ar.order_id = tg.order_id and ar.model = m.model and ar.produit_key = target group by 1, 2""")
def _(t):
    items, _ = numbered_items(t)
    targets = R.masked_target(items)
    stats = {k: materialise(d) for k, d in R.basket_statistics(items).items()}
    ranks = materialise(R.candidate_ranks(materialise(R.masked_context(items, targets)), stats))
    return R.candidate_recall(targets.join(items.select("order_id", "window").distinct(), "order_id"), ranks.unionByName(R.fused_candidates(ranks)))


@query("rec25_leave_one_out_frame", f"""
with {MASK}, mi as (select order_id, w, produit_key from oi),
c as (select h.order_id, h.w, h.produit_key as target, x.produit_key as src, oc.dst, oc.n as v, ins.produit_key is not null as inn from mi h join mi x on x.order_id = h.order_id and x.produit_key <> h.produit_key join oc on oc.src = x.produit_key and oc.w = x.w left join mi ins on ins.order_id = h.order_id and ins.produit_key = oc.dst),
g as (select order_id, w, target, dst, sum(v) as cooccurrence, count(*) as n_sources from c where (not inn or dst = target) group by 1, 2, 3, 4),
q as (select *, row_number() over (partition by order_id, target order by cooccurrence desc, dst) as rang from g qualify rang <= 50)
select order_id, target, count(*) as n, sum(cooccurrence)::bigint as s, sum(n_sources)::bigint as n_sources, round(sum(cooccurrence / greatest(pop, 1)), 6) as lift, sum((dst = target)::int)::bigint as label from q join op on op.w = q.w and op.produit_key = q.dst group by 1, 2""")
def _(t):
    items, names = numbered_items(t)
    d = R.leave_one_out(items).groupBy("order_id", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("cooccurrence").alias("s"), F.sum("n_sources").alias("n_sources"), r(F.sum("lift")).alias("lift"), F.sum("label").alias("label"))
    return R.named(d, names, "target")
