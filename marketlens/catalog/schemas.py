"""Schema and contract operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.catalog.base import query
from marketlens.operators import schema as S

KEYS = {"customer": ["c_custkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "nation": ["n_nationkey"],
        "region": ["r_regionkey"]}


@query("sch1_resolve_mapping", "select l_partkey as unique_id, l_quantity as y, l_extendedprice as ca from lineitem")
def _(t):
    return S.resolve_mapping(t.raw("lineitem"), [("l_partkey", "unique_id"), ("l_quantity", "y"), ("l_extendedprice", "ca"),
                                                 ("absent", "libelle")], ["l_partkey"])


@query("sch2_require_columns", "select order_id, produit_key, quantite from sales")
def _(t):
    return S.require_columns(t.sales, ["order_id", "produit_key", "quantite"]).select("order_id", "produit_key", "quantite")


@query("sch3_propose_roles")
def _(t):
    inv = S.column_inventory(t.spark, {"sales": t.sales, "products": t.products, "web": t.web})
    roles = t.spark.createDataFrame(
        [("product_key", "produit|product", 30, None), ("quantity", "quant|qty", 40, "numeric"), ("amount", "montant|amount|price|prix", 30, "numeric"),
         ("date", "^ds$|date|time", 30, "date"), ("category", "categ", 40, None), ("status", "statut|status", 40, None)],
        "role string, pattern string, weight int, wished string")
    scored = S.role_scores(inv, roles)
    sizes = t.sales.agg(F.count(F.lit(1)).alias("n")).scalar()
    return scored.withColumn("n_sales", sizes)


@query("sch4_best_join_column", """
with k as (select distinct l_partkey::varchar as v from lineitem),
h as (select 'p_partkey' as attribute, count(*) as n_hits from k where v in (select p_partkey::varchar from part)
  union all select 'p_size', count(*) from k where v in (select p_size::varchar from part)
  union all select 'p_brand', count(*) from k where v in (select p_brand from part))
select attribute, n_hits, n_hits / (select count(*) from k) as overlap from h
where n_hits / (select count(*) from k) >= 0.9 order by overlap desc, attribute limit 1""")
def _(t):
    return S.best_join_column(t.raw("lineitem"), "l_partkey", t.raw("part"), ["p_partkey", "p_size", "p_brand"])


@query("sch5_resolve_scopes", """
with tg as (select distinct portee as scope, cible as v from promotions),
n as (select scope, count(*) as n_targets from tg group by 1),
vals as (select distinct 'product_id' as attribute, product_id as v from products union all select distinct 'categorie', categorie from products
  union all select distinct 'marque', marque from products),
h as (select scope, attribute, count(*) as n_hits from tg join vals using (v) group by all)
select scope, attribute, n_targets, n_hits / n_targets as overlap from h join n using (scope)
where n_hits / n_targets >= 0.5 and (scope <> 'product' or attribute = 'product_id')
qualify row_number() over (partition by scope order by n_hits / n_targets desc, attribute) = 1""")
def _(t):
    return S.resolve_scopes(t.promotions, t.products, ["product_id", "categorie", "marque"])


@query("sch6_inspect_schema")
def _(t):
    return S.inspect_schema(t.spark, {n: t.raw(n) for n in ("customer", "part", "orders", "nation")}, KEYS)


@query("sch7_infer_relations", """
with c(table_name, column_name) as (values ('sales', 'client_key'), ('sales', 'produit_key'), ('web', 'client_key'), ('web', 'produit_key'), ('stock', 'produit_key'))
select table_name, column_name, case column_name when 'client_key' then 'clients' else 'products' end as target_table,
  case table_name when 'sales' then (select count(*) from sales) when 'web' then (select count(*) from web) else (select count(*) from stock) end as n_rows
from c""")
def _(t):
    data = {"sales": t.sales, "web": t.web, "stock": t.stock, "clients": t.clients, "products": t.products}
    inv = S.column_inventory(t.spark, data, {"clients": ["client_key"], "products": ["produit_key"]})
    sizes = None
    for name in ("sales", "web", "stock"):
        part = data[name].agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
        sizes = part if sizes is None else sizes.union(part)
    return S.infer_relations(inv).join(sizes, "table_name").select("table_name", "column_name", "target_table", "n_rows")


def _two_inventories(t):
    before = S.column_inventory(t.spark, {"orders": t.raw("orders"), "part": t.raw("part")}, {"orders": ["o_orderkey"], "part": ["p_partkey"]})
    new_orders = t.raw("orders").withColumnRenamed("o_totalprice", "total").drop("o_orderpriority").withColumn("channel", F.lit(None).cast("string"))
    new_part = t.raw("part").withColumn("p_size", F.col("p_size").cast("string"))
    after = S.column_inventory(t.spark, {"orders": new_orders, "part": new_part}, {"orders": ["o_orderkey"], "part": ["p_partkey", "p_brand"]})
    return before, after


CHANGES = """(values ('orders', 'total', 'renamed'), ('orders', 'o_orderpriority', 'dropped'), ('orders', 'channel', 'added'),
  ('part', 'p_size', 'type_changed'), ('part', 'p_brand', 'key_changed')) c(table_name, column_name, change)"""
COUNTED = "select table_name, column_name, change, case table_name when 'orders' then (select count(*) from orders) else (select count(*) from part) end as n_rows from "


def _with_rows(t, changes):
    sizes = (t.raw("orders").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit("orders"))
             .union(t.raw("part").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit("part"))))
    return changes.join(sizes, "table_name").select("table_name", "column_name", "change", "n_rows")


@query("sch8_compare_schemas", COUNTED + CHANGES)
def _(t):
    return _with_rows(t, S.compare_schemas(*_two_inventories(t), {"orders.o_totalprice": "total"}))


@query("sch9_blocking_changes", COUNTED + CHANGES + " where change in ('renamed', 'dropped', 'key_changed')")
def _(t):
    return _with_rows(t, S.blocking_changes(S.compare_schemas(*_two_inventories(t), {"orders.o_totalprice": "total"})))


@query("sch10_detect_validity_start", "select 'valid_from' as column_name, min(valid_from) as first_day, count(*) as n_rows from products")
def _(t):
    name = S.detect_validity_start(t.products)
    return t.products.agg(F.lit(name).alias("column_name"), F.min(name).alias("first_day"), F.count(F.lit(1)).alias("n_rows"))


@query("sch11_infer_frequency", """
with g as (select ds - lag(ds) over (order by ds) as gap from (select distinct ds from sales)),
n as (select gap, count(*) as n from g where gap is not null group by 1)
select arg_min(gap, (-n, gap))::int as modal_gap, sum(case when gap = 1 then n else 0 end) / sum(n) as daily_share, 'D' as frequency from n""")
def _(t):
    return S.infer_frequency(t.sales)


@query("sch12_validate_matrix", """
select produit_key, categorie, marque, prix_base as prix_base_xof, cout as cout_xof from products""")
def _(t):
    columns = ["produit_key", "categorie", "marque", "prix_base_xof", "cout_xof"]
    S.validate_matrix(columns)
    return t.products.withColumnsRenamed({"prix_base": "prix_base_xof", "cout": "cout_xof"}).select(*columns)


@query("sch13_no_forbidden_columns", "select produit_key, ds, remise_pct from sales")
def _(t):
    columns = ["produit_key", "ds", "remise_pct"]
    S.validate_no_forbidden_columns(columns)
    return t.sales.select(*columns)
