"""Scalar functions and native replacements of row-wise and group-wise user functions."""
from pyspark.sql import functions as F

from marketlens.catalog.base import query
from marketlens.functions import scalar as S
from marketlens.operators import aggregates as A
from marketlens.operators import grids
from marketlens.operators.ordered import running_totals
from marketlens.sources import lake


@query("sca1_strip_accents_lower", "select produit_key, lower(strip_accents('É' || product_name || ' Noël ÇÀ')) as norm from products")
def _(t):
    return t.products.select("produit_key", S.strip_accents_lower(F.concat(F.lit("É"), "product_name", F.lit(" Noël ÇÀ"))).alias("norm"))


@query("sca2_is_upper_category", "select produit_key, regexp_matches(raw, '^[A-Z\\s&\\-]+$') as majuscules from (select produit_key, case when substr(produit_key, 9, 1) in ('7', '8') then lower(categorie) else categorie || ' & CO' end raw from products)")
def _(t):
    raw = F.when(F.substring("produit_key", 9, 1).isin("7", "8"), F.lower("categorie")).otherwise(F.concat("categorie", F.lit(" & CO")))
    return t.products.select("produit_key", S.is_upper_category(raw).alias("majuscules"))


@query("sca3_zero_padded_keys", "select product_id, 'PRD' || lpad((row_number() over (order by product_id) - 1)::varchar, 6, '0') as cle from products")
def _(t):
    return lake.surrogate_keys(t.products.select("product_id"), "product_id", "cle", "PRD")


@query("sca4_assignment_id", "select distinct coalesce(client_key, anonymous_id) as identite, 'ASG' || substr(md5(coalesce(client_key, anonymous_id)), 1, 10) as assignment_id from web")
def _(t):
    i = F.coalesce("client_key", "anonymous_id")
    return t.web.select(i.alias("identite")).distinct().withColumn("assignment_id", S.assignment_id(F.col("identite")))


@query("sca5_persistent_group")
def _(t):
    return t.clients.select("client_key", S.persistent_group(F.col("client_key")).alias("groupe"))


@query("sca6_stratified_blocks")
def _(t):
    """Arms dealt in turn along a hash order inside each category x ABC stratum."""
    totals = t.pday.groupBy("produit_key").agg(F.sum("y").alias("v"))
    from marketlens.operators.windows import abc_class
    strata = abc_class(totals, "produit_key", "v").join(t.products.select("produit_key", "categorie"), "produit_key")
    dealt = running_totals(strata.withColumn("_h", F.xxhash64("produit_key", F.lit(42))), ["categorie", "classe_abc"], [F.col("_h"), F.col("produit_key")], {"_i": F.lit(1)})
    start = F.pmod(F.xxhash64("categorie", "classe_abc"), F.lit(4))
    return dealt.select("produit_key", "categorie", "classe_abc", F.element_at(F.array(*[F.lit(x) for x in (0, 5, 10, 15)]), (F.pmod(F.col("_i") + start, F.lit(4)) + 1).cast("int")).alias("remise_testee"))


@query("sca7_discount_decision", """
with g as (select produit_key, prix_base, cout, d, round(prix_base * (1 - d / 100), 0) as prix_test from products, (values (0), (5), (10), (15), (30)) v(d)),
e as (select *, prix_test >= cout and prix_test > 0 and prix_test - cout >= 0.05 * prix_test as eligible from g)
select produit_key, d as remise_pct, prix_test, eligible, case when eligible then d else 0 end as remise_appliquee, round(prix_base * (1 - case when eligible then d else 0 end / 100), 0) as prix_applique from e""")
def _(t):
    g = grids.repeat_per(t.products, "remise_pct", [0, 5, 10, 15, 30])
    cols = S.discount_decision(F.col("prix_base"), F.col("cout"), F.col("remise_pct"))
    return g.select("produit_key", "remise_pct", *[c.alias(n) for n, c in cols.items()])


@query("sca8_math_functions", """
select ds, unique_id, round(sin(2 * pi() * dayofyear(ds) / 365.25), 8) as s, round(cos(2 * pi() * dayofyear(ds) / 365.25), 8) as c, round(ln(1 + y), 8) as l, round(exp(ln(1 + y)) - 1, 4) as e, greatest(y - 60, 0) as clipped,
  round(exp(y - max(y) over (partition by ds)) / sum(exp(y - m)) over (partition by ds), 8) as softmax from (select *, max(y) over (partition by ds) m from brand_days)""")
def _(t):
    from pyspark.sql import Window
    w = Window.partitionBy("ds")  # 25 brands per day
    s, c = S.cyclic(F.dayofyear("ds"))
    ex = F.exp(F.col("y") - F.max("y").over(w))
    d = t.brand_days.withColumn("_e", ex)
    return d.select("ds", "unique_id", F.round(s, 8).alias("s"), F.round(c, 8).alias("c"), F.round(F.log1p("y"), 8).alias("l"), F.round(F.expm1(F.log1p("y")), 4).alias("e"),
                    F.greatest(F.col("y") - 60, F.lit(0)).alias("clipped"), F.round(F.col("_e") / F.sum("_e").over(w), 8).alias("softmax"))


@query("sca9_half_life_decay", "select vente_id, ds, round(pow(0.5::double, greatest((date '2001-01-01' - ds)::double, 0.0::double) / 90.0::double), 8) as poids from sales")
def _(t):
    age = F.datediff(F.lit("2001-01-01").cast("date"), "ds").cast("double")
    return t.sales.select("vente_id", "ds", F.round(S.half_life_decay(age, 90.0), 8).alias("poids"))


@query("sca10_category_codes", """
with c as (select v, (row_number() over (order by v) - 1)::int as code from (select distinct marque v from products where marque <> 'Brand#3')) select produit_key, coalesce(code, -1)::int as code from products left join c on c.v = case when marque <> 'Brand#3' then marque end""")
def _(t):
    return S.category_codes(t.products.select("produit_key", F.when(F.col("marque") != "Brand#3", F.col("marque")).alias("m")), "m", "code").select("produit_key", "code")


@query("sca11_horizon_bucket", "select ds, (ds - (select min(ds) from sales))::int % 30 + 1 as h, case when h = 1 then 'J+1' when h <= 7 then 'J+2-7' when h <= 14 then 'J+8-14' else 'J+15-30' end as bucket, count(*) as n from sales group by 1, 2, 3".replace("case when h", "case when (ds - (select min(ds) from sales))::int % 30 + 1").replace("when h <=", "when (ds - (select min(ds) from sales))::int % 30 + 1 <="))
def _(t):
    first = t.sales.agg(F.min("ds")).scalar()
    d = t.sales.withColumn("h", F.datediff("ds", first) % 30 + 1)
    return d.groupBy("ds", "h", S.horizon_bucket(F.col("h")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("sca12_interaction_features", """
with cc as (select v, (row_number() over (order by v) - 1)::int k from (select distinct categorie v from panel)), pc as (select v, (row_number() over (order by v) - 1)::int k from (select distinct produit_key v from panel))
select produit_key, ds, remise_pct * (cc.k + 1) as discount_x_category, remise_pct * (pc.k + 1) as discount_x_product, prix_base * (1 - remise_pct / 100) as planned_price, prix_base - cout as margin_before, prix_base * (1 - remise_pct / 100) - cout as margin_after
from panel join cc on cc.v = categorie join pc on pc.v = produit_key""")
def _(t):
    from marketlens.plans.pricing import interaction_features
    return interaction_features(t.panel).select("produit_key", "ds", "discount_x_category", "discount_x_product", "planned_price", "margin_before", "margin_after")


@query("sca13_map_lookup", "select event_id, case event_type when 'view' then 1.0 when 'click' then 2.0 when 'add_to_cart' then 3.0 when 'purchase' then 5.0 else 0.0 end::double as poids from web")
def _(t):
    return t.web.select("event_id", S.map_lookup(F.col("event_type"), S.EVENT_WEIGHTS, 0.0).alias("poids"))


@query("udf1_row_labels", "select produit_key, case when n < 20 then 'rare' when n < 30 then 'moyen' else 'frequent' end as label from (select produit_key, count(*) n from sales group by 1)")
def _(t):
    n = F.col("n")
    return t.sales.groupBy("produit_key").agg(F.count(F.lit(1)).alias("n")).select("produit_key", F.when(n < 20, "rare").when(n < 30, "moyen").otherwise("frequent").alias("label"))


@query("udf2_group_functions", """
with m as (select client_key, arg_min(statut_commande, (-n, statut_commande)) as mode from (select client_key, statut_commande, count(*) n from sales group by all) group by 1),
f as (select client_key, arg_min(promo_key, (ds, order_id, produit_key)) filter (promo_key is not null) as first_promo, avg((quantite < 5)::int) as low_rate from sales group by 1) select * from m join f using (client_key)""")
def _(t):
    mode = A.most_frequent(t.sales, ["client_key"], "statut_commande", "mode")
    first = F.min(F.when(F.col("promo_key").isNotNull(), F.struct("ds", "order_id", "produit_key", "promo_key"))).getField("promo_key")
    rest = t.sales.groupBy("client_key").agg(first.alias("first_promo"), F.avg((F.col("quantite") < 5).cast("int")).alias("low_rate"))
    return mode.join(rest, "client_key")


@query("udf4_row_generators", """
select promo_key, d::date as ds, (row_number() over (partition by promo_key order by d) - 1)::int as position from (select promo_key, unnest(generate_series(date_debut, date_fin, interval 1 day)) d from promotions)""")
def _(t):
    days = F.sequence("date_debut", "date_fin")
    return t.promotions.select("promo_key", F.posexplode(days).alias("position", "ds"))
