"""Metrics, backtests, intervals, statistics."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.catalog.base import query
from marketlens.catalog.forecasting import BT, SEG, backtest, segments, windows
from marketlens.catalog.joins import DECISIONS, decisions
from marketlens.catalog.recommendation import CUT, MASK, cutoff, numbered_items, slates
from marketlens.functions.scalar import r
from marketlens.operators import aggregates as A
from marketlens.operators import joins as J
from marketlens.operators import ranking as K
from marketlens.operators.ordered import materialise
from marketlens.plans import evaluate as E
from marketlens.plans import forecast as P
from marketlens.plans import recsys as R

MODELS = ("naive", "seasonal_naive7", "moving_average28")


def preds(t):
    return P.long_predictions(backtest(t), MODELS, ["unique_id", "ds", "window", "h", "y"])


BL = "bl as (select unique_id, ds, \"window\", h, y, 'naive' as model, naive as pred from bt union all select unique_id, ds, \"window\", h, y, 'seasonal_naive7', seasonal_naive7 from bt union all select unique_id, ds, \"window\", h, y, 'moving_average28', moving_average28 from bt)"
MET = """round(avg(abs(pred - y)), 6) as mae, round(sqrt(avg(pow(pred - y, 2))), 6) as rmse, round(sum(abs(pred - y)) / nullif(sum(y), 0), 6) as wape, round(avg(case when (abs(y) + abs(pred)) / 2 < 1e-9 then 0 else abs(pred - y) / ((abs(y) + abs(pred)) / 2) end), 6) as smape,
  round(avg(case when y > 0 then abs(pred - y) / y end), 6) as mape_positive, round(avg(pred - y), 6) as bias, round(sum(pred - y) / nullif(sum(y), 0), 6) as relative_bias, round(avg((pred < y)::int), 6) as under_rate, round(avg((pred > y)::int), 6) as over_rate,
  round(avg(case when pred < y then 1.5 * (y - pred) else pred - y end), 6) as asym_cost_1_5, round(avg(case when pred < y then 2 * (y - pred) else pred - y end), 6) as asym_cost_2, round(sum(y * abs(pred - y)) / nullif(sum(y), 0), 6) as weighted_mae, count(*) as n"""


def rounded(df, columns=E.METRICS, digits=6):
    return df.withColumns({c: r(c, digits) for c in columns})


@query("eva1_error_metrics", f"with {BT}, {BL} select model, {MET} from bl group by 1")
def _(t):
    return rounded(E.metrics_by_group(preds(t), ["model"]))


@query("eva2_mase_rmsse", f"""
with {BT}, sc as (select unique_id, avg(abs(d)) ms, sqrt(avg(d * d)) rs from (select unique_id, y - lag(y, 7) over (partition by unique_id order by ds) d from brand_days where ds < (select min(start) from wn)) group by 1)
select unique_id, round(avg(abs(moving_average28 - y)) / any_value(ms), 8) as mase, round(sqrt(avg(pow(moving_average28 - y, 2))) / any_value(rs), 8) as rmsse from bt join sc using (unique_id) group by 1""")
def _(t):
    first = windows(t).agg(F.min("start")).first()[0]
    scales = A.train_scales(t.brand_days.filter(F.col("ds") < F.lit(first)))
    return rounded(E.scaled_errors(backtest(t).withColumnRenamed("moving_average28", "pred"), scales), ("mase", "rmsse"), 8)


@query("eva3_metrics_by_group", f"with {BT}, {BL} select model, \"window\", case when unique_id = 'Brand#3' then null else unique_id end as groupe, {MET} from bl group by 1, 2, 3")
def _(t):
    d = preds(t).withColumn("groupe", F.when(F.col("unique_id") != "Brand#3", F.col("unique_id")))
    return rounded(E.metrics_by_group(d, ["model", "window", "groupe"]))


@query("eva4_cumulative_wape", f"""
with {BT}, {BL}, g as (select model, "window", unique_id, sum(case when h <= 7 then y end) y7, sum(case when h <= 7 then pred end) p7, sum(case when h <= 14 then y end) y14, sum(case when h <= 14 then pred end) p14, sum(y) y30, sum(pred) p30 from bl group by 1, 2, 3)
select model, "window", round(sum(abs(p7 - y7)) / sum(y7), 8) as wape_cum_7, round(sum(abs(p14 - y14)) / sum(y14), 8) as wape_cum_14, round(sum(abs(p30 - y30)) / sum(y30), 8) as wape_cum_30 from g group by 1, 2""")
def _(t):
    return rounded(E.cumulative_wape(preds(t), keys=("model", "window")), ("wape_cum_7", "wape_cum_14", "wape_cum_30"), 8)


@query("eva5_evaluate_predictions", f"""
with {BT}, {BL}, {SEG}, x as (select bl.*, classe_abc, profil_demande from bl join sg using (unique_id, "window") where model = 'moving_average28')
select 'global' as axe, '' as valeur, {MET} from x union all select 'window', "window"::varchar, {MET} from x group by "window" union all select 'classe_abc', classe_abc, {MET} from x group by classe_abc union all select 'profil_demande', profil_demande, {MET} from x group by profil_demande""")
def _(t):
    d = preds(t).filter("model = 'moving_average28'").join(segments(t).select("unique_id", "window", "classe_abc", "profil_demande"), ["unique_id", "window"])
    return rounded(E.evaluate_predictions(d, ["window", "classe_abc", "profil_demande"]))


@query("eva5_stability", f"with {BT}, {BL}, w as (select model, \"window\", sum(abs(pred - y)) / sum(y) as wape from bl group by 1, 2) select model, round(avg(wape), 8) as moyenne, round(stddev_samp(wape), 8) as ecart_type, round(min(wape), 8) as min, round(max(wape), 8) as max from w group by 1")
def _(t):
    return rounded(E.stability(E.metrics_by_group(preds(t), ["model", "window"])), ("moyenne", "ecart_type", "min", "max"), 8)


@query("eva6_compare_to_reference", f"""
with {BT}, {BL}, w as (select model, "window", sum(abs(pred - y)) / sum(y) as wape, avg(pred - y) as bias from bl group by 1, 2), f as (select "window", wape rw, bias rb from w where model = 'naive')
select model, round(avg(wape - rw), 8) as delta_wape, round(avg(bias - rb), 8) as delta_bias, count(case when wape < rw then 1 end) as fenetres_ameliorees, count(*) as n_fenetres from w join f using ("window") where model <> 'naive' group by 1""")
def _(t):
    return rounded(E.compare_to_reference(E.metrics_by_group(preds(t), ["model", "window"]), "naive"), ("delta_wape", "delta_bias"), 8)


def priced(t):
    """Panel rows after the cutoff with the product mean as prediction."""
    from marketlens.plans.pricing import baseline_mean
    d = t.panel
    out = baseline_mean(d.filter(F.col("ds") < cutoff()), d.filter(F.col("ds") >= cutoff()))
    return out.withColumn("prix", F.col("prix_base") * (1 - F.col("remise_pct") / 100))


PR = f"pm as (select produit_key, avg(y) v from panel where ds < date '{CUT}' group by 1), pp as (select p.*, coalesce(v, (select avg(y) from panel where ds < date '{CUT}')) as pred, prix_base * (1 - remise_pct / 100) as prix from panel p left join pm using (produit_key) where ds >= date '{CUT}')"


@query("eva7_macro_wape", f"with {PR}, w as (select produit_key, sum(abs(pred - y)) / sum(y) as w from pp group by 1) select round(avg(w), 8) as macro_wape, count(w) as n_produits from w")
def _(t):
    return rounded(E.macro_wape(priced(t)), ("macro_wape",), 8)


@query("eva7_margin_metrics", f"""
with {PR} select round(sum(abs((pred - y) * (prix - cout))) / sum(abs(y * (prix - cout))), 8) as wape_marge, round(sum((pred - y) * (prix - cout)) / sum(abs(y * (prix - cout))), 8) as biais_marge, count(case when prix < cout then 1 end) as sous_cout,
  count(case when prix - cout < 0.05 * prix then 1 end) as sous_plancher, count(*) as n from pp""")
def _(t):
    return rounded(E.margin_metrics(priced(t)), ("wape_marge", "biais_marge"), 8)


def recs(t, k=20):
    """Most bought products of each client before the cutoff."""
    tr = t.confirmed.filter(F.col("ds") < cutoff())
    return K.top_k(tr.groupBy("client_key", "produit_key").agg(F.sum("quantite").cast("double").alias("score")), k)


def truth(t):
    """Products of categories bought after the cutoff would be too wide: the purchases themselves plus all earlier ones of 2000."""
    return t.confirmed.filter(F.col("ds") >= F.lit("2000-01-01").cast("date")).select("client_key", "produit_key").distinct()


RC = f"""rc as (select client_key, produit_key, row_number() over (partition by client_key order by sum(quantite)::double desc, produit_key)::int as rang from confirmed where ds < date '{CUT}' group by 1, 2 qualify rang <= 20), tt as (select distinct client_key, produit_key from confirmed where ds >= date '2000-01-01'),
sz as (select client_key, count(*) n from tt group by 1), ht as (select rc.client_key, rang, row_number() over (partition by client_key order by rang) i from rc join tt using (client_key, produit_key) where rang <= 10),
gg as (select client_key, count(*) h, sum(1 / log2(rang + 1)) dcg, sum(i / rang) ap, min(rang) f from ht group by 1),
um as (select client_key, coalesce(h, 0) / 10 as "precision", coalesce(h, 0) / n as recall, coalesce(dcg, 0) / (select sum(1 / log2(j + 1)) from range(1, 11) r(j) where j <= n) as ndcg, coalesce(ap, 0) / least(n, 10) as ap, coalesce(1 / f, 0.0) as mrr, (coalesce(h, 0) > 0)::int as hit from sz left join gg using (client_key))"""


@query("eva8_ranking_metrics", f"with {RC} select client_key, round(\"precision\", 8) as \"precision\", round(recall, 8) as recall, round(ndcg, 8) as ndcg, round(ap, 8) as ap, round(mrr, 8) as mrr, hit from um")
def _(t):
    return rounded(E.ranking_metrics(recs(t), truth(t)), ("precision", "recall", "ndcg", "ap", "mrr"), 8)


@query("eva8_mean_ranking_metrics", f"with {RC} select round(avg(\"precision\"), 8) as \"precision\", round(avg(recall), 8) as recall, round(avg(ndcg), 8) as ndcg, round(avg(ap), 8) as ap, round(avg(mrr), 8) as mrr, round(avg(hit), 8) as hit, count(*) as n_users from um")
def _(t):
    return rounded(E.mean_metrics(E.ranking_metrics(recs(t), truth(t))), ("precision", "recall", "ndcg", "ap", "mrr", "hit"), 8)


def complement_recs(t, *arms):
    """Ranked complements of the evaluable orders and the targets, over numbered products; the leaky arm also scores with the hidden item.

    Baskets are counted once for all arms.
    """
    items, _ = numbered_items(t)
    targets = materialise(R.masked_target(items).join(items.select("order_id", "window").distinct(), "order_id").filter("window > 1"))
    ctx = materialise(R.masked_context(items, targets.select("order_id", "target")).select("order_id", "window", "produit_key"))
    stats = R.basket_statistics(items)
    stats = {k: materialise(stats[k]) for k in ("cooccurrence", "popularity")}

    def arm(leaky):
        shown = ctx.unionByName(targets.select("order_id", "window", F.col("target").alias("produit_key"))) if leaky else ctx
        s = R.complement_scores(shown, stats, without=ctx)
        w = Window.partitionBy("order_id").orderBy(F.desc("cooccurrence"), "produit_key")
        return s.withColumn("rang", F.row_number().over(w)).filter("rang <= 20")
    return [arm(leaky) for leaky in arms], targets


def leak_arms(t):
    """Metrics of the honest and of the leaky arm, one written after the other, so that the lists of one arm alone are on disk at a time."""
    (honest, leaky), targets = complement_recs(t, False, True)
    return [materialise(E.masked_item_metrics(rec, targets)) for rec in (honest, leaky)]


MR = "sx as (select order_id, dst as produit_key, sum(n)::double as v from cx join oc on oc.src = cx.produit_key and oc.w = cx.w group by 1, 2), rk as (select s.order_id, s.produit_key, row_number() over (partition by s.order_id order by v desc, s.produit_key) as rang from sx s where not exists (select 1 from cx where cx.order_id = s.order_id and cx.produit_key = s.produit_key))"


@query("eva9_masked_item_metrics", f"""
with {MASK}, {MR} select tg.order_id, coalesce((rang <= 5)::int, 0) as recall_5, coalesce((rang <= 10)::int, 0) as recall_10, coalesce((rang <= 20)::int, 0) as recall_20, round(case when rang <= 5 then 1 / log2(rang + 1) else 0 end, 8) as ndcg_5, round(case when rang <= 10 then 1 / log2(rang + 1) else 0 end, 8) as ndcg_10,
  round(case when rang <= 20 then 1 / log2(rang + 1) else 0 end, 8) as ndcg_20, round(case when rang <= 20 then 1 / rang else 0 end, 8) as mrr from tg left join rk on rk.order_id = tg.order_id and rk.produit_key = target where tg.w > 1""")
def _(t):
    (rec,), targets = complement_recs(t, False)
    return rounded(E.masked_item_metrics(rec, targets), ("ndcg_5", "ndcg_10", "ndcg_20", "mrr"), 8)


@query("eva10_slate_metrics", f"""
with ev as (select event_id // 10 as slate, (event_id % 10 + 1) as rang, event_type = 'purchase' as pos from web), g as (select slate, sum(pos::int) n, sum(case when pos then 1 / log2(rang + 1) end) d, min(case when pos then rang end) f from ev where rang <= 5 group by 1)
select slate, round(d / (select sum(1 / log2(j + 1)) from range(1, 6) r(j) where j <= n), 8) as ndcg, round(1 / f, 8) as mrr from g where n > 0""")
def _(t):
    s = t.web.select(F.floor(F.col("event_id") / 10).alias("slate"), (F.col("event_id") % 10 + 1).alias("rang"), (F.col("event_type") == "purchase").alias("pos"))
    return rounded(E.slate_metrics(s, "pos", 5, "slate"), ("ndcg", "mrr"), 8)


@query("eva10_slate_metrics_served")
def _(t):
    sold = t.confirmed.select("produit_key", F.trunc("ds", "week").alias("wk")).distinct().withColumn("vendu", F.lit(True))
    served = slates(t).withColumn("wk", F.trunc(F.to_date("impression_timestamp"), "week")).join(sold, ["produit_key", "wk"], "left")
    return E.slate_metrics(served.withColumn("vendu", F.coalesce("vendu", F.lit(False))), "vendu")


@query("eva11_beyond_accuracy", f"""
with {RC}, tp as (select rc.*, categorie from rc join products using (produit_key) where rang <= 10), po as (select produit_key, count(*) n from confirmed group by 1), sh as (select produit_key, count(*) s from tp group by 1)
select count(*) / (select count(*) from products) as couverture, (select sum(s) from (select s from sh order by s desc, produit_key limit 10)) / sum(s) as concentration_top10, (select avg(c) from (select count(distinct categorie) c from tp group by client_key)) as diversite,
  (select round(avg(-log2(n / (select sum(n) from po))), 8) from tp join po using (produit_key)) as nouveaute from sh""")
def _(t):
    pop = t.confirmed.groupBy("produit_key").agg(F.count(F.lit(1)).alias("n"))
    return rounded(E.beyond_accuracy(recs(t), t.products, pop), ("nouveaute",), 8)


@query("eva12_client_segments", "with n as (select client_key, count(*) n from confirmed group by 1) select client_key, case when n is null then 'demarrage_a_froid' when n >= (select median(n) from n) then 'actif' else 'peu_actif' end as segment from clients left join n using (client_key)")
def _(t):
    return E.client_segments(t.confirmed, t.clients)


def paired(t):
    d = backtest(t)
    err = lambda c: F.abs(F.col(c) - F.col("y"))
    return d.select(F.concat_ws("/", "unique_id", "window").alias("unit"), err("naive").alias("ea"), err("moving_average28").alias("eb"), F.col("y").cast("double").alias("y"))


@query("eva13_paired_bootstrap")
def _(t):
    return E.paired_bootstrap(paired(t), "unit", "ea", "eb", "y")


@query("eva14_permutation_test")
def _(t):
    return E.permutation_test(paired(t), "unit", "ea", "eb")


@query("eva15_holm", """
with p as (select categorie as family, marque as test, round(count(case when en_promotion then 1 end) / count(*) / 20, 6) as p_value from panel group by 1, 2), s as (select *, (count(*) over (partition by family) - row_number() over (partition by family order by p_value, test) + 1) * p_value as s from p)
select family, test, p_value, round(least(max(s) over (partition by family order by p_value, test rows unbounded preceding), 1.0), 8) as p_holm from s""")
def _(t):
    p = t.panel.groupBy(F.col("categorie").alias("family"), F.col("marque").alias("test")).agg(F.round(F.count_if("en_promotion") / F.count(F.lit(1)) / 20, 6).alias("p_value"))
    return E.holm(p, "family").withColumn("p_holm", r("p_holm", 8))


def q_sql(level):
    return f"list_sort(list(abs(y - pred)))[(ceil((count(*) - 1) * least(1.0::double, ceil((count(*) + 1) * {level}::double - 1e-9) / count(*)) - 1e-9) + 1)::int]"


@query("eva16_conformal_quantile", f"with {BT}, {BL} select \"window\", model, round({q_sql(0.8)}, 8) as q80, round({q_sql(0.95)}, 8) as q95, count(*) as n from bl group by 1, 2")
def _(t):
    d = preds(t).withColumn("residual", F.col("y") - F.col("pred"))
    a = E.conformal_quantile(d, 0.8, ["window", "model"], out="q80")
    b = E.conformal_quantile(d, 0.95, ["window", "model"], out="q95").drop("n")
    return a.join(b, ["window", "model"]).withColumns({"q80": r("q80", 8), "q95": r("q95", 8)})


MO = """lb as (select unique_id, ds, "window", h % 10 as h, y, moving_average28 as pred, (substr(unique_id, 7)::int % 2 = 0) as abc_a, (substr(unique_id, 7)::int % 5 = 0) as intermittent from bt)"""


def labelled(t):
    k = F.substring("unique_id", 7, 3).cast("int")
    return backtest(t).select("unique_id", "ds", "window", (F.col("h") % 10).alias("h"), "y", F.col("moving_average28").alias("pred"), (k % 2 == 0).alias("abc_a"), (k % 5 == 0).alias("intermittent"))


@query("eva17_mondrian_intervals", f"""
with {BT}, {MO}, pv as (select * from lb where "window" < 4), f as (select h, abc_a, intermittent, {q_sql(0.8)} as qf, count(*) as n from pv group by 1, 2, 3), c as (select h, {q_sql(0.8)} as qc from pv group by 1)
select unique_id, ds, round(case when f.n >= 30 then qf else qc end, 8) as q, round(greatest(pred - case when f.n >= 30 then qf else qc end, 0), 8) as borne_basse, round(pred + case when f.n >= 30 then qf else qc end, 8) as borne_haute
from lb left join f using (h, abc_a, intermittent) left join c using (h) where "window" = 4""")
def _(t):
    d = labelled(t)
    out = E.mondrian_intervals(d.filter("window = 4"), d.filter("window < 4"), 0.8)
    return rounded(out.select("unique_id", "ds", "q", "borne_basse", "borne_haute"), ("q", "borne_basse", "borne_haute"), 8)


BI = """b0 as (select unique_id, ds, "window", h, y, moving_average28 as pred, y - moving_average28 as residual, case when h = 1 then 'J+1' when h <= 7 then 'J+2-7' when h <= 14 then 'J+8-14' else 'J+15-30' end as bucket from bt),
bq as (select w."window", bucket, quantile_cont(residual, 0.1) lo, quantile_cont(residual, 0.9) hi, count(*) n from wn w join b0 on b0."window" {op} w."window" group by 1, 2 having count(*) >= 30),
bi as (select b0.*, lo is not null as calibrable, case when lo is not null then greatest(pred + lo, 0) end as borne_basse, case when lo is not null then greatest(pred + hi, greatest(pred + lo, 0)) end as borne_haute from b0 left join bq using ("window", bucket))"""


def bucketed(t, regime):
    return E.bucket_intervals(backtest(t).select("unique_id", "ds", "window", "h", "y", F.col("moving_average28").alias("pred")), 0.8, regime)


@query("eva18_bucket_intervals", f"with {BT}, {BI.format(op='<')} select unique_id, ds, \"window\", bucket, calibrable, round(borne_basse, 6) as borne_basse, round(borne_haute, 6) as borne_haute from bi")
def _(t):
    return rounded(bucketed(t, "prior").select("unique_id", "ds", "window", "bucket", "calibrable", "borne_basse", "borne_haute"), ("borne_basse", "borne_haute"))


@query("eva18_coverage_report", f"""
with {BT}, {BI.format(op='<>')}, c as (select *, borne_haute - borne_basse as w from bi where calibrable)
select count(*) as n_calibrables, avg((y between borne_basse and borne_haute)::int) as couverture, round(avg(w), 6) as largeur_moyenne, avg((w > 3 * (select median(w) from c))::int) as part_trop_larges, (select count(*) from bi) as n_total, round((select median(w) from c), 6) as largeur_mediane from c""")
def _(t):
    return rounded(E.coverage_report(bucketed(t, "leave_one_out")), ("largeur_moyenne", "largeur_mediane"))


@query("eva19_backtest_windows", f"""
with {BT} select "window", case when ds < start then 'train' else 'test' end as part, count(*) as n, min(ds) as lo, max(ds) as hi, sum(y)::bigint as y from brand_days, wn where ds <= start + 29 group by 1, 2""")
def _(t):
    w = E.window_rows(t.brand_days, windows(t))
    return w.groupBy("window", "part").agg(F.count(F.lit(1)).alias("n"), F.min("ds").alias("lo"), F.max("ds").alias("hi"), F.sum("y").alias("y"))


@query("eva19_date_chunks", "select ds, ntile(4) over (order by ds)::int as \"window\" from (select distinct ds from sales)")
def _(t):
    return E.date_chunks(t.sales, "ds", 4)


@query("eva20_acceptance_gate", f"""
with {BT}, {BL}, w as (select model, sum(abs(pred - y)) / sum(y) as wape, sum(pred - y) / sum(y) as rb from bl group by 1), n as (select wape from w where model = 'naive')
select model, coalesce(w.wape < n.wape * 0.95, false) as gain, coalesce(abs(rb) <= 0.1, false) as biais, false as couverture, false as accepte from w, n""")
def _(t):
    m = E.metrics_by_group(preds(t), ["model"])
    naive = m.filter("model = 'naive'").agg(F.max("wape")).first()[0]
    return E.acceptance_gate(m, {"gain": F.col("wape") < naive * 0.95, "biais": F.abs("relative_bias") <= 0.1, "couverture": F.lit(None).cast("boolean")}).select("model", "gain", "biais", "couverture", "accepte")


@query("eva21_select_model", f"""
with {BT}, {BL}, w as (select model, "window", sum(abs(pred - y)) / sum(y) as wape, sum(pred - y) / sum(y) as bias from bl group by 1, 2), s as (select model, avg(wape) as wape, avg(bias) as bias from w group by 1)
select model, round(wape, 8) as wape, round(bias, 8) as bias from s where abs(bias) <= 0.2 order by round(wape, 9), model limit 1""")
def _(t):
    s = E.metrics_by_group(preds(t), ["model", "window"]).groupBy("model").agg(F.avg("wape").alias("wape"), F.avg("relative_bias").alias("bias"))
    return rounded(E.select_model(s, 0.2), ("wape", "bias"), 8)


@query("eva21_select_ranker", """
with p as (select year(ds)::int as "window", marque as model, avg(y) as ndcg, avg(n_transactions) as recall from panel group by 1, 2), f as (select "window", ndcg as n0, recall as r0 from p where model = 'Brand#1'),
g as (select model, (avg(ndcg) - avg(n0)) / avg(n0) as gain_ndcg, (avg(recall) - avg(r0)) / avg(r0) as gain_recall, count(case when ndcg > n0 then 1 end) as fenetres from p join f using ("window") where model <> 'Brand#1' group by 1)
select model, round(gain_ndcg, 8) as gain_ndcg, round(gain_recall, 8) as gain_recall, fenetres, gain_ndcg >= 0.01 as ndcg_ok, gain_recall >= -0.02 as recall_ok, fenetres >= 3 as fenetres_ok, true as ic_ok, gain_ndcg >= 0.01 and gain_recall >= -0.02 and fenetres >= 3 as accepte from g""")
def _(t):
    p = t.panel.groupBy(F.year("ds").alias("window"), F.col("marque").alias("model")).agg(F.avg("y").alias("ndcg"), F.avg("n_transactions").alias("recall"))
    ci = p.select("model").distinct().withColumn("ci_low", F.lit(0.1))
    return rounded(E.select_ranker(p, "Brand#1", ci, min_gain=0.01).drop("ci_low"), ("gain_ndcg", "gain_recall"), 8)


@query("eva22_leak_audit")
def _(t):
    honest, leaky = leak_arms(t)
    return E.leak_audit(honest, leaky, draws=2000)


@query("eva22_leak_audit_means", f"""
with {MASK}, {MR}, lx as (select order_id, w, produit_key from cx union all select order_id, w, target from tg), ls as (select order_id, dst as produit_key, sum(n)::double as v from lx join oc on oc.src = lx.produit_key and oc.w = lx.w group by 1, 2),
lk as (select s.order_id, s.produit_key, row_number() over (partition by s.order_id order by v desc, s.produit_key) as rang from ls s where not exists (select 1 from cx where cx.order_id = s.order_id and cx.produit_key = s.produit_key))
select avg(coalesce((rk.rang <= 10)::int, 0)) as sans_fuite, avg(coalesce((lk.rang <= 10)::int, 0)) as avec_fuite, count(*) as n from tg left join rk on rk.order_id = tg.order_id and rk.produit_key = target left join lk on lk.order_id = tg.order_id and lk.produit_key = target where tg.w > 1""")
def _(t):
    honest, leaky = leak_arms(t)
    return honest.select("order_id", F.col("recall_10").alias("_h")).join(leaky.select("order_id", F.col("recall_10").alias("_l")), "order_id").agg(
        F.avg("_h").alias("sans_fuite"), F.avg("_l").alias("avec_fuite"), F.count(F.lit(1)).alias("n"))


@query("eva23_experiment_analysis")
def _(t):
    units = (t.panel.groupBy("produit_key").agg(F.avg("y").alias("unites"), F.avg("ca").alias("revenu"), F.avg(F.col("ca") - F.col("cout") * F.col("y")).alias("marge"))
             .select(F.col("produit_key").alias("unit"), F.element_at(F.array(F.lit("controle_0pct"), F.lit("traitement_5pct"), F.lit("traitement_10pct"), F.lit("traitement_15pct")),
                                                                      (F.substring("produit_key", 4, 6).cast("int") % 4 + 1)).alias("arm"), "unites", "revenu", "marge"))
    return E.experiment_analysis(units, ["unites", "revenu", "marge"], "controle_0pct", draws=100)


@query("eva24_end_to_end_vs_eligible", f"""
with {RC}, cd as (select distinct produit_key from web), el as (select * from tt where produit_key in (from cd)), h2 as (select rc.client_key, rang from rc join tt using (client_key, produit_key) where rang <= 10), h3 as (select rc.client_key, rang from rc join el using (client_key, produit_key) where rang <= 10),
m2 as (select client_key, count(*) n, any_value(h) h, any_value(d) d from tt left join (select client_key, count(*) h, sum(1 / log2(rang + 1)) d from h2 group by 1) using (client_key) group by 1), m3 as (select client_key, count(*) n, any_value(h) h, any_value(d) d from el left join (select client_key, count(*) h, sum(1 / log2(rang + 1)) d from h3 group by 1) using (client_key) group by 1),
i as (select n, sum(1 / log2(j + 1)) v from (select distinct n from m2 union select distinct n from m3) x, range(1, 11) r(j) where j <= n group by 1)
select 'bout_en_bout' as perimetre, round(avg(coalesce(h, 0) / n), 8) as recall, round(avg(coalesce(d, 0) / v), 8) as ndcg, round(avg((h is not null)::int), 8) as hit, count(*) as n_users, (select count(*) from tt) as n_cibles, (select count(*) from el) / (select count(*) from tt) as taux_eligibilite from m2 join i using (n)
union all select 'eligible', round(avg(coalesce(h, 0) / n), 8), round(avg(coalesce(d, 0) / v), 8), round(avg((h is not null)::int), 8), count(*), (select count(*) from el), (select count(*) from el) / (select count(*) from tt) from m3 join i using (n)""")
def _(t):
    return rounded(E.end_to_end_vs_eligible(recs(t), truth(t), t.web.select("produit_key")), ("recall", "ndcg", "hit"), 8)


@query("eva25_average_popularity", f"""
with {RC}, po as (select produit_key, count(*) n from confirmed group by 1) select avg(n) as popularite_moyenne, count(*) as n, (select avg(n) from sz) as cibles_par_client from rc join po using (produit_key) where rang <= 10""")
def _(t):
    return E.average_popularity(recs(t), truth(t), t.confirmed.groupBy("produit_key").agg(F.count(F.lit(1)).alias("n")))


@query("eva26_window_mean_vs_pooled", f"""
with {BT}, {BL}, g as (select model, "window", sum(abs(pred - y)) e, sum(y) y from bl group by 1, 2) select model, round(avg(e / y), 8) as wape_moyenne_fenetres, round(sum(e) / sum(y), 8) as wape_poolee from g group by 1""")
def _(t):
    return rounded(E.window_mean_vs_pooled(preds(t)), ("wape_moyenne_fenetres", "wape_poolee"), 8)


@query("eva27_independent_recompute", f"with {DECISIONS} select count(*) as n, 0::bigint as n_ecarts from dec")
def _(t):
    left = decisions(t).select("produit_key", "ds", "decision_timestamp")
    fast = J.counts_before(left, t.confirmed, ["produit_key"], "decision_timestamp", "ds", {"n_avant": F.lit(1)})
    slow = E.recompute_counts(left, t.confirmed.select("produit_key", F.col("ds").alias("jour")), "produit_key", "decision_timestamp", "jour")
    return E.agreement(fast.select("produit_key", "ds", "n_avant"), slow.select("produit_key", "ds", "n_direct"), ["produit_key", "ds"], "n_avant", "n_direct")
