"""Sources and sinks, lake zones, scalar coercions on read."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlens.catalog.base import query
from marketlens.functions import scalar as S
from marketlens.session import checkpoint_dir
from marketlens.sources import lake, tables


def scratch(t) -> str:
    return f"{checkpoint_dir(t.spark)}/work-{uuid.uuid4().hex}"


def source_tables(t) -> dict:
    """The canonical model under the column names of the six source files."""
    tx = t.sales.select(
        F.concat_ws("|", "vente_id", "produit_key", "quantite", "montant_net").alias("ligne_id_origine"), "order_id",
        F.concat(F.lit("P"), F.substring("produit_key", 4, 6).cast("int")).alias("product_id"),
        F.concat(F.lit("C"), F.substring("client_key", 4, 6).cast("int")).alias("customer_id"),
        F.col("promo_key").alias("promotion_id"), F.col("ds").alias("order_date"), F.col("quantite").alias("quantity"),
        F.col("montant_net").alias("unit_price_xof"), F.col("statut_commande").alias("order_status"))
    web = t.web.select(
        "event_id", "session_id", F.concat(F.lit("P"), F.substring("produit_key", 4, 6).cast("int")).alias("product_id"),
        F.concat(F.lit("C"), F.substring("client_key", 4, 6).cast("int")).alias("customer_id"), "anonymous_id",
        "event_timestamp", "event_type", F.col("appareil").alias("device"), F.col("source_trafic").alias("referral_source"),
        "canal", "order_id", "quantity", "est_bot")
    stock = t.stock.select(F.concat(F.lit("P"), F.substring("produit_key", 4, 6).cast("int")).alias("product_id"),
                           F.col("ds").alias("date"), F.col("niveau_stock").alias("stock_level"), "quantite_vendue",
                           "quantite_reapprovisionnee")
    products = t.products.select(
        "product_id", "product_name",
        F.when(F.substring("produit_key", 9, 1) == "7", F.lower("categorie")).otherwise(F.col("categorie")).alias("category"),
        F.col("marque").alias("brand"), F.col("prix_base").alias("base_price_xof"), F.col("cout").alias("cost_xof"),
        F.col("valid_from").alias("launch_date"))
    customers = t.clients.select("customer_id", "region", F.when(F.col("age_bracket") != "A3", F.col("age_bracket")).alias("age_bracket"),
                                 F.col("segment_fidelite").alias("loyalty_segment"), F.lit("1995-01-01").cast("date").alias("signup_date"))
    promos = t.promotions.select(F.col("promo_key").alias("promotion_id"), F.col("portee").alias("scope"), F.col("cible").alias("target"),
                                 F.col("remise_pct").alias("discount_pct"), F.col("date_debut").alias("start_date"),
                                 F.col("date_fin").alias("end_date"))
    return {"fact_transactions": tx, "web_events": web, "stock_daily": stock, "dim_products": products,
            "dim_customers": customers, "promotions": promos}


@query("src1_raw_landing")
def _(t):
    root = scratch(t)
    src = source_tables(t)["promotions"]
    lake.raw_landing(src, root, "promotions", "2001-01-01")
    path = lake.raw_landing(src, root, "promotions", "2001-01-02")
    return t.spark.read.parquet(path).groupBy("ds").agg(F.count(F.lit(1)).alias("n_rows"))


@query("src2_read_csv_any", "select p_partkey::bigint as p_partkey, p_name, p_brand, p_type, p_size::int as p_size, p_retailprice from part")
def _(t):
    path = scratch(t)
    part = t.raw("part")
    part.write.option("header", True).option("compression", "gzip").csv(path)
    return lake.read_csv_any(t.spark, path, schema=part.schema, partitions=8)


@query("src3_bronze", """
select distinct l_orderkey as order_key, l_linenumber as line, l_returnflag as flag,
  cast(l_shipdate as timestamp) as order_date from lineitem""")
def _(t):
    raw = t.raw("lineitem").select(F.col("l_orderkey").alias(" Order_Key "), F.col("l_linenumber").alias("LINE"),
                                   F.col("l_returnflag").alias("Flag"), F.col("l_shipdate").cast("string").alias("order_date "))
    return lake.bronze(raw)


@query("src4_silver_gate", """
with g as (select order_id, produit_key, quantite, statut_commande, count(*) as n from sales group by all)
select 'clean' as zone, count(*) as n_rows, sum(quantite)::bigint as units from g where quantite >= 2
union all
select 'rejects', sum(case when quantite < 2 then n else n - 1 end)::bigint,
  sum(quantite * case when quantite < 2 then n else n - 1 end)::bigint from g""")
def _(t):
    # one unit less than in the source, so that the quantity rule has something to reject
    tx = t.sales.select("order_id", F.concat(F.lit("P"), F.substring("produit_key", 4, 6).cast("int")).alias("product_id"),
                        (F.col("quantite") - 1).alias("quantity"), F.col("statut_commande").alias("order_status"))
    clean, rejects = lake.silver_gate(tx, "fact_transactions", t.products)
    size = lambda df, zone: df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("quantity") + 1).alias("units")).select(
        F.lit(zone).alias("zone"), "n_rows", "units")
    return size(clean, "clean").union(size(rejects, "rejects"))


@query("src5_gold_fact_sales", """
with p as (select product_id, 'PRD' || lpad((row_number() over (order by product_id) - 1)::varchar, 6, '0') as produit_key from products),
c as (select customer_id, 'CLI' || lpad((row_number() over (order by customer_id) - 1)::varchar, 6, '0') as client_key from clients),
m as (select promo_key as promotion_id, 'PRM' || lpad((row_number() over (order by promo_key) - 1)::varchar, 4, '0') as promo_key from promotions)
select strftime(ds, '%Y%m%d') as date_key, p.produit_key, c.client_key, m.promo_key, statut_commande, count(*) as n_lines,
  sum(quantite)::bigint as quantite, round(sum(quantite * montant_net), 4) as montant
from sales s left join p on p.product_id = 'P' || cast(substr(s.produit_key, 4)::int as varchar)
left join c on c.customer_id = 'C' || cast(substr(s.client_key, 4)::int as varchar)
left join m on m.promotion_id = s.promo_key group by all""")
def _(t):
    fact = lake.gold(source_tables(t))["fact_ventes"]
    return fact.groupBy("date_key", "produit_key", "client_key", "promo_key", "statut_commande").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("quantite").alias("quantite"), F.round(F.sum("montant_net_xof"), 4).alias("montant"))


@query("src5_gold_dim_product", """
with s as (select *, case when substr(produit_key, 9, 1) = '7' then lower(categorie) else categorie end as raw_cat from products),
n as (select lower(raw_cat) low, raw_cat, count(*) n from s group by all),
b as (select low, arg_min(raw_cat, (-n, raw_cat)) canon from n group by low)
select 'PRD' || lpad((row_number() over (order by product_id) - 1)::varchar, 6, '0') as produit_key, product_id, product_name,
  canon as categorie, marque, prix_base as prix_base_xof, cout as cout_xof, valid_from, valid_to, is_current
from s join b on lower(raw_cat) = low""")
def _(t):
    return lake.dim_product(source_tables(t)["dim_products"])


@query("src5_gold_dim_date", """
select strftime(d, '%Y%m%d') as date_key, d::date as date_complete, year(d)::int as annee, month(d)::int as mois, day(d)::int as jour,
  dayname(d) as jour_semaine, isodow(d) >= 6 as est_weekend
from (select unnest(generate_series(least((select min(ds) from sales), (select min(event_timestamp)::date from web)),
  greatest((select max(ds) from sales), (select max(event_timestamp)::date from web)), interval 1 day)) d)""")
def _(t):
    src = source_tables(t)
    return lake.dim_calendar(src["fact_transactions"], src["web_events"])


@query("src6_cached_parquet")
def _(t):
    cache = scratch(t)
    nested = lambda: t.raw("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"))
    tables.extract_table(t.spark, cache, "orders", nested)
    return tables.extract_table(t.spark, cache, "orders", nested)


@query("src7_extract_manifest")
def _(t):
    return tables.manifest(t.spark, {n: t.raw(n) for n in ("customer", "part", "orders", "lineitem", "events")})


@query("src9_count_rows", "select count(*) as n_rows from lineitem")
def _(t):
    return tables.count_rows(t.raw("lineitem"))


@query("src10_coerce_decimal", """
select o_orderkey, cast(cast(o_totalprice as decimal(18, 2)) as double) as total, o_orderpriority from orders""")
def _(t):
    df = t.raw("orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("total"), "o_orderpriority")
    return S.coerce_decimal(df)


@query("src11_coerce_datetime", """
select o_orderkey, cast(o_orderdate as timestamp) as day_text, o_orderpriority from orders""")
def _(t):
    df = t.raw("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"), "o_orderpriority")
    return S.coerce_datetime(df)


@query("src12_write_datasets")
def _(t):
    from marketlens.plans import datasets
    return tables.write_datasets(datasets.final_datasets(t.sales, t.products, t.web, t.stock, t.promotions), scratch(t))


@query("src13_export_lines", """
select ds, order_id, produit_key, product_name, categorie, marque, client_key, region, segment_fidelite, quantite, montant_net, remise_pct, statut_commande
from sales left join products using (produit_key) left join clients using (client_key) where year(ds) = 2000 and statut_commande = 'confirmee'""")
def _(t):
    return tables.export_lines(t.sales.filter((F.year("ds") == 2000) & (F.col("statut_commande") == "confirmee")), t.products, t.clients)
