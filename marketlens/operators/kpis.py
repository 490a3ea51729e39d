"""Business indicators: each fact table is read once per indicator family."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalar import ratio
from marketlens.operators.filters import exclude_bots



def N() -> Column:
    return F.count(F.lit(1))



def funnel_counts(web: DataFrame) -> DataFrame:
    """Non-robot events by type, by device and by traffic source, in one pass."""
    axes = [F.col("event_type"), F.col("appareil"), F.col("source_trafic")]
    axis = (F.when(F.grouping("event_type") == 0, "type").when(F.grouping("appareil") == 0, "device").otherwise("source"))
    return (exclude_bots(web).groupingSets([[a] for a in axes], *axes).agg(axis.alias("axe"), N().alias("n"))
            .select("axe", F.coalesce("event_type", "appareil", "source_trafic").alias("valeur"), "n"))


def pct(num, den, digits: int = 1):
    return F.coalesce(F.round(ratio(num, den) * 100, digits), F.lit(0.0))


def commerce_kpis(lines: DataFrame, web: DataFrame) -> DataFrame:
    """One row of indicators. `lines`: confirmed lines with cout and promo_key."""
    orders = lines.groupBy("order_id").agg((F.count_distinct("produit_key") > 1).alias("multi"))
    multi = orders.agg(F.count_if("multi")).scalar()
    k = lines.agg(
        F.round(F.sum("montant_net"), 4).alias("ca"), F.round(F.sum(F.col("montant_net") - F.col("cout") * F.col("quantite")), 4).alias("profit"),
        F.sum("quantite").alias("qty"), F.count_distinct("order_id").alias("commandes"), F.count_distinct("client_key").alias("acheteurs"),
        F.count_distinct("produit_key").alias("produits"), F.count_distinct("promo_key").alias("promos"),
        F.round(F.sum(F.when(F.col("promo_key").isNotNull(), F.col("montant_net"))), 4).alias("promo_ca"))
    events = exclude_bots(web).agg(F.struct(*[F.count_if(F.col("event_type") == e).alias(e) for e in ("view", "add_to_cart", "purchase")])).scalar()
    view, cart, buy = (events.getField(e) for e in ("view", "add_to_cart", "purchase"))
    return (k.withColumn("margin_pct", pct("profit", "ca", 4)).withColumn("arpu", F.round(ratio("ca", "acheteurs"), 4))
            .withColumn("panier_moyen", F.round(ratio("ca", "commandes"), 4)).withColumn("clv", F.round(ratio("ca", "acheteurs"), 4))
            .withColumn("promo_share", pct("promo_ca", "ca", 4)).withColumn("multi_pct", pct(multi, F.col("commandes"), 4))
            .withColumn("visitors", view).withColumn("conversion", pct(buy, view, 4))
            .withColumn("abandon_pct", F.coalesce(F.round((1 - ratio(buy, cart)) * 100, 4), F.lit(0.0))).drop("promo_ca"))


def month_totals(lines: DataFrame, *keys: str) -> DataFrame:
    return lines.groupBy(*keys, F.date_format("ds", "yyyy-MM").alias("mois")).agg(
        F.round(F.sum("montant_net"), 4).alias("ca"), F.sum("quantite").alias("qty"), F.count_distinct("order_id").alias("commandes"))


def delta(now, before):
    """Change in percent of the absolute previous value; 0 without one."""
    return F.when(before.isNull() | (before == 0), F.lit(0.0)).otherwise(F.round((now - before) / F.abs(before) * 100, 4))


def kpi_month_delta(lines: DataFrame) -> DataFrame:
    """Last month against the previous month present, for revenue, orders and quantity."""
    w = Window.orderBy("mois")  # months of a calendar
    m = month_totals(lines)
    out = m.select("mois", *[delta(F.col(c).cast("double"), F.lag(c).over(w).cast("double")).alias(f"{c}_delta") for c in ("ca", "commandes", "qty")],
                   F.row_number().over(Window.orderBy(F.desc("mois"))).alias("_rn"))
    return out.filter("_rn = 1").drop("_rn")


def revenue_timeseries(lines: DataFrame) -> DataFrame:
    """Daily revenue and quantity with the monthly subtotals."""
    month = F.date_format("ds", "yyyy-MM")
    rows = lines.groupBy("ds").agg(F.sum("montant_net").alias("_ca"), F.sum("quantite").alias("_q")).withColumn("mois", month)
    return (rows.groupingSets([[F.col("mois"), F.col("ds")], [F.col("mois")]], F.col("mois"), F.col("ds"))
            .agg(F.round(F.sum("_ca"), 4).alias("ca"), F.sum("_q").alias("qty")))


def category_breakdown(lines: DataFrame) -> DataFrame:
    """Revenue by category, with the change of the last month against the one before it."""
    months = lines.select(F.date_format("ds", "yyyy-MM").alias("m")).distinct()
    last2 = months.agg(F.slice(F.sort_array(F.collect_list("m"), False), 1, 2)).scalar()
    m = month_totals(lines, "categorie").withColumn("_m", last2)
    now = F.sum(F.when(F.col("mois") == F.get("_m", F.lit(0)), F.col("ca")))
    before = F.sum(F.when(F.col("mois") == F.get("_m", F.lit(1)), F.col("ca")))
    return m.groupBy("categorie").agg(F.round(F.sum("ca"), 4).alias("ca"), delta(F.coalesce(now, F.lit(0.0)), before).alias("delta"))


def region_top(lines: DataFrame, k: int = 8) -> DataFrame:
    return (lines.groupBy("region").agg(F.round(F.sum("montant_net"), 4).alias("ca")).orderBy(F.desc("ca"), "region").limit(k))


def segment_revenue(lines: DataFrame) -> DataFrame:
    return lines.groupBy("segment_fidelite").agg(F.round(F.sum("montant_net"), 4).alias("ca"), F.count_distinct("client_key").alias("clients"))


def product_detail(lines: DataFrame) -> DataFrame:
    return lines.groupBy("produit_key").agg(
        F.sum("quantite").alias("qty"), F.round(F.sum("montant_net"), 4).alias("ca"), N().alias("lignes"),
        F.count_distinct("order_id").alias("commandes"), F.min("ds").alias("premiere"), F.max("ds").alias("derniere"))


def purchase_rhythm(history: DataFrame) -> DataFrame:
    """Orders, active days, orders per 30 days, days between orders and mean basket over the full history."""
    h = history.groupBy("client_key").agg(F.count_distinct("order_id").alias("n_cmd"), F.min("ds").alias("premiere"), F.max("ds").alias("derniere"),
                                          F.round(F.sum("montant_net"), 4).alias("ca_total"))
    days = F.greatest(F.datediff("derniere", "premiere"), F.lit(1))
    return (h.withColumn("jours_actif", days).withColumn("freq_mois", F.round(F.col("n_cmd") / (days / 30.0), 2))
            .withColumn("jours_entre", F.when(F.col("n_cmd") > 1, F.round(days / (F.col("n_cmd") - 1), 1)).otherwise(days.cast("double")))
            .withColumn("panier_moyen", ratio("ca_total", "n_cmd")))


def client_status(rhythm: DataFrame, reference) -> DataFrame:
    """churn from 730 idle days, inactif from 180, vip when buying often, else loyal."""
    idle = F.greatest(F.datediff(reference, "derniere"), F.lit(0))
    return (rhythm.withColumn("jours_inactif", idle)
            .withColumn("statut", F.when(idle >= 730, "churn").when(idle >= 180, "inactif")
                        .when((F.col("n_cmd") >= 2) & ((F.col("freq_mois") >= 1.5) | (F.col("jours_entre") <= 14)), "vip").otherwise("loyal")))


def client_detail(filtered: DataFrame, history: DataFrame) -> DataFrame:
    """Filtered quantity, revenue, lines and orders per client next to the rhythm over all history."""
    f = filtered.groupBy("client_key").agg(F.sum("quantite").alias("qty"), F.round(F.sum("montant_net"), 4).alias("ca"), N().alias("lignes"),
                                           F.count_distinct("order_id").alias("commandes"))
    return f.join(purchase_rhythm(history).select("client_key", "n_cmd", "premiere", "derniere", "freq_mois", "jours_entre", "panier_moyen"), "client_key")


def stock_kpis(stock: DataFrame, lines: DataFrame) -> DataFrame:
    """Cover days, rotation and rupture share from the latest level of each product."""
    latest = stock.groupBy("produit_key").agg(F.max_by("niveau_stock", "ds").alias("lvl"))
    s = latest.agg(F.sum("lvl").alias("total_stock"), N().alias("n_produits"), F.count_if(F.col("lvl") <= 0).alias("n_rupture"))
    q = lines.agg(F.struct(F.sum("quantite").alias("q"), F.count_distinct("ds").alias("d"))).scalar()
    qty, days = q.getField("q"), q.getField("d")
    return s.select("total_stock", F.round(ratio(F.col("total_stock"), ratio(qty, days)), 4).alias("stock_cover_days"),
                    F.round(ratio(qty, F.col("total_stock")), 4).alias("stock_rotation"), pct("n_rupture", "n_produits", 4).alias("rupture_pct"))


def stock_alerts(stock: DataFrame, k: int = 8, low: int = 40) -> DataFrame:
    latest = stock.groupBy("produit_key").agg(F.max_by("niveau_stock", "ds").alias("stock"))
    return latest.filter(F.col("stock") < low).orderBy("stock", "produit_key").limit(k)


def data_quality_score(star_lines: DataFrame) -> DataFrame:
    """Mean share of lines with a region, a product, an amount and a date."""
    ok = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    return star_lines.agg(F.round((ok("region") + ok("categorie") + ok("montant_net") + ok("ds")) / 4 * 100, 4).alias("data_quality"))


def filter_options(products: DataFrame, clients: DataFrame) -> DataFrame:
    """Distinct sorted values per filter dimension."""
    out = None
    for df, column in ((products, "categorie"), (products, "marque"), (clients, "region"), (clients, "segment_fidelite"), (clients, "age_bracket")):
        part = df.filter(F.col(column).isNotNull()).agg(F.concat_ws("|", F.array_sort(F.collect_set(column))).alias("valeurs")).withColumn("dimension", F.lit(column))
        out = part if out is None else out.unionByName(part)
    return out


def dependent_options(df: DataFrame, by: str, item: str, cap: int) -> DataFrame:
    """First `cap` items per value of a dimension, in key order: the menu of a filter that depends on another."""
    w = Window.partitionBy(by).orderBy(item)
    return df.filter("is_current" if "is_current" in df.columns else "true").select(by, item).distinct() \
        .withColumn("rang", F.row_number().over(w)).filter(F.col("rang") <= cap)


# fixed values: block, label, unit and source column of the indicator sheet
SHEET = [
    ("Marge, prix & ventes", "Taux de marge brute", "%", "margin_pct"), ("Marge, prix & ventes", "Chiffre d’affaires net", "F", "ca"),
    ("Marge, prix & ventes", "Panier moyen", "F", "panier_moyen"), ("Stock & demande", "Rotation des stocks", "x", "stock_rotation"),
    ("Stock & demande", "Couverture de stock", "j", "stock_cover_days"), ("Stock & demande", "Taux de rupture", "%", "rupture_pct"),
    ("Parcours d’achat en ligne", "Taux de conversion", "%", "conversion"), ("Parcours d’achat en ligne", "Taux d’abandon de panier", "%", "abandon_pct"),
    ("Recommandation & ventes croisées", "Part des paniers multi-produits", "%", "multi_pct"),
    ("Clients & fidélisation", "Valeur vie client", "F", "clv"), ("Clients & fidélisation", "CA segment VIP", "%", "ca_vip_share"),
    ("Valeur du projet & responsabilité", "Retour sur investissement (ROI)", "%", None), ("Valeur du projet & responsabilité", "Qualité des données", "%", "data_quality"),
]


def kpi_sheet(kpi_row: DataFrame) -> DataFrame:
    """Six titled blocks of indicator, value, unit and status, from one row of indicators."""
    spark = kpi_row.sparkSession
    names = [c for _, _, _, c in SHEET if c and c in kpi_row.columns]
    long = (kpi_row.select([F.col(c).cast("double").alias(c) for c in names])
            .unpivot([], [F.col(c) for c in names], "source", "valeur"))
    labels = spark.createDataFrame(SHEET, "bloc string, indicateur string, unite string, source string")
    return (labels.join(long, "source", "left")
            .withColumn("statut", F.when(F.col("source").isNull(), "modele").otherwise("calculable")).drop("source"))
