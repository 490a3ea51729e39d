"""Grouped aggregates over sales, web events and product-day panels."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalar import EVENT_WEIGHTS, half_life_decay, map_lookup, ratio
from marketlens.operators.filters import exclude_bots, valid_lines
from marketlens.operators.ordered import exact_quantiles, running_totals
from marketlens.operators.schema import require_columns



def N() -> Column:
    return F.count(F.lit(1))



def daily_sales_by_product(sales: DataFrame) -> DataFrame:
    """Quantity and revenue per product and day."""
    return sales.groupBy("produit_key", F.col("ds").alias("date")).agg(
        F.sum("quantite").alias("quantity"), F.round(F.sum("montant_net"), 4).alias("revenue"))


def product_performance(sales: DataFrame) -> DataFrame:
    return sales.groupBy("produit_key").agg(
        F.sum("quantite").alias("total_qty"), F.round(F.sum("montant_net"), 4).alias("total_revenue"),
        F.round(F.avg(ratio("montant_net", "quantite")), 6).alias("avg_price"), N().alias("n_orders"))


def sales_daily(sales: DataFrame, key: str = "produit_key") -> DataFrame:
    """y, ca, n_transactions per series and day; rows without a date are dropped, negative quantities kept."""
    return (sales.filter("ds is not null").groupBy(F.col(key).cast("string").alias("unique_id"), "ds")
            .agg(F.sum("quantite").alias("y"), F.round(F.sum("montant_net"), 4).alias("ca"), N().alias("n_transactions")))


def web_daily(web: DataFrame, types: Sequence[str]) -> DataFrame:
    """web_<type> and web_total per product and day, with the product's first and last tracked day."""
    dated = web.withColumn("ds", F.to_date("event_timestamp")).filter("ds is not null and produit_key is not null")
    counts = dated.groupBy("produit_key", "ds").agg(
        *[F.count_if(F.col("event_type") == x).alias(f"web_{x}") for x in types], N().alias("web_total"))
    spans = counts.groupBy("produit_key").agg(F.min("ds").alias("web_debut"), F.max("ds").alias("web_fin"))
    return counts.join(spans, "produit_key")


def web_observed_fill(table: DataFrame, web: DataFrame, types: Sequence[str]) -> DataFrame:
    """Counters joined on a grid: 0 inside the product's tracked span, NULL outside it."""
    columns = [f"web_{x}" for x in types] + ["web_total"]
    counts = web_daily(web, types)
    spans = counts.groupBy("produit_key").agg(F.min("web_debut").alias("web_debut"), F.max("web_fin").alias("web_fin"))
    joined = (table.join(counts.drop("web_debut", "web_fin"), ["produit_key", "ds"], "left").join(spans, "produit_key", "left"))
    inside = F.coalesce(F.col("ds").between(F.col("web_debut"), F.col("web_fin")), F.lit(False))
    return (joined.withColumns({c: F.when(inside, F.coalesce(c, F.lit(0))) for c in columns})
            .withColumn("web_data_observed", inside.cast("int")).drop("web_debut", "web_fin"))


def product_day_pricing(confirmed: DataFrame, products: DataFrame) -> DataFrame:
    """Quantity, revenue, margin and lines per product, day, price, cost and discount."""
    priced = confirmed.join(products.select("produit_key", "categorie", "marque", "prix_base", "cout"), "produit_key")
    out = (priced.groupBy("produit_key", "ds", "categorie", "marque", "prix_base", "cout", "remise_pct")
           .agg(F.sum("quantite").alias("quantite"), F.round(F.sum("montant_net"), 4).alias("ca"), N().alias("n_lignes")))
    return (out.withColumn("marge", F.round(F.col("ca") - F.col("cout") * F.col("quantite"), 4))
            .withColumn("prix_paye", ratio("ca", "quantite")))


def order_baskets(sales: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Order x product lines with the size, amount and category count of the order."""
    require_columns(sales, ("order_id", "produit_key", "client_key", "quantite", "montant_net"), "order baskets")
    kept = valid_lines(sales)
    lines = kept.groupBy("order_id", "produit_key").agg(
        F.sum("quantite").alias("quantite"), F.round(F.sum("montant_net"), 4).alias("montant_net"),
        F.min("client_key").alias("client_key"), F.min("ds").alias("date_commande"))
    orders = [F.count(F.lit(1)).alias("taille_panier_lignes"), F.sum("quantite").alias("taille_panier_unites"),
              F.round(F.sum("montant_net"), 4).alias("montant_commande")]
    if products is not None:
        lines = lines.join(products.select("produit_key", "categorie"), "produit_key", "left")
        orders.append(F.count_distinct("categorie").alias("n_categories_commande"))
    totals = lines.groupBy("order_id").agg(*orders)
    return lines.join(totals, "order_id").withColumn("est_multi_produit", F.col("taille_panier_lignes") > 1)


def interactions(web: DataFrame, weights: dict | None = None, quantity_weight: float = 0.0,
                 half_life: float | None = None, reference: Column | None = None) -> DataFrame:
    """Weighted interactions: (type weight + quantity weight x quantity) x 0.5^(age / half-life).

    Unknown types weigh 0, rows without an identity or product are dropped; the reference instant must be
    the cutoff of the evaluated window.
    """
    if half_life is not None and reference is None:
        raise ValueError("a recency decay needs a reference instant")
    d = (exclude_bots(web).filter("produit_key is not null and event_timestamp is not null")
         .withColumn("identite", F.coalesce("client_key", "anonymous_id")).filter("identite is not null")
         .withColumn("type_identite", F.when(F.col("client_key").isNotNull(), "client").otherwise("anonyme"))
         .withColumn("poids_base", map_lookup(F.col("event_type"), weights or EVENT_WEIGHTS, 0.0))
         .withColumn("poids_quantite", F.lit(quantity_weight) * F.coalesce(F.col("quantity"), F.lit(0))))
    age = (F.unix_micros(reference) - F.unix_micros("event_timestamp")) / F.lit(86400000000.0) if half_life else None
    decay = half_life_decay(age, half_life) if half_life else F.lit(1.0)
    return (d.withColumn("poids_recence", decay)
            .withColumn("poids_total", (F.col("poids_base") + F.col("poids_quantite")) * F.col("poids_recence"))
            .select("identite", "type_identite", "produit_key", "event_timestamp", "event_type", "quantity",
                    "poids_base", "poids_quantite", "poids_recence", "poids_total"))


def user_item_matrix(inter: DataFrame) -> DataFrame:
    return inter.groupBy("identite", "produit_key").agg(
        F.sum("poids_total").alias("poids_cumule"), N().alias("n_interactions"), F.max("event_timestamp").alias("derniere_interaction"))


def series_features(daily: DataFrame, key: str = "unique_id", last_day: Column | None = None) -> DataFrame:
    """Statistics of each series on its completed day grid (first day to the last day of the data).

    Days without a row are zeros; they are accounted for by the length of the grid, so it is never built.
    """
    end = last_day if last_day is not None else daily.agg(F.max("ds")).scalar()
    pos = F.col("y") > 0
    yd = F.col("y").cast("double")
    g = daily.groupBy(key).agg(
        F.min("ds").alias("debut"), F.sum("y").alias("total"), F.sum(yd * yd).alias("_sq"), F.max("y").alias("_max"),
        F.round(F.sum("ca"), 4).alias("ca"), F.count_if(pos).alias("n_jours_vente"), N().alias("_rows"),
        F.avg(F.when(pos, F.col("y"))).alias("taille_demande_moy"), F.stddev_samp(F.when(pos, F.col("y"))).alias("taille_demande_ecart"),
        F.max(F.when(pos, F.col("ds"))).alias("derniere_vente"))
    g = g.withColumn("fin", end).withColumn("n_jours", F.datediff("fin", "debut") + 1)
    mean = ratio("total", "n_jours")
    var = ratio(F.col("_sq") - F.col("n_jours") * mean * mean, F.col("n_jours") - 1)
    return (g.withColumn("moyenne", mean).withColumn("ecart_type", F.sqrt(F.greatest(var, F.lit(0.0))))
            .withColumn("maximum", F.when(F.col("_rows") < F.col("n_jours"), F.greatest("_max", F.lit(0))).otherwise(F.col("_max")))
            .withColumn("taux_jours_sans_vente", 1 - ratio("n_jours_vente", "n_jours"))
            .withColumn("jours_inactivite", F.datediff("fin", "derniere_vente"))
            .withColumn("adi", ratio("n_jours", "n_jours_vente"))
            .withColumn("cv2", F.pow(ratio("taille_demande_ecart", "taille_demande_moy"), 2))
            .withColumn("cv_serie", ratio("ecart_type", "moyenne")).drop("_sq", "_max", "_rows"))


def demand_profile(adi: Column, cv2: Column, adi_cut: float = 1.32, cv2_cut: float = 0.49) -> Column:
    return (F.when(adi.isNull() | cv2.isNull(), "indetermine").when((adi < adi_cut) & (cv2 < cv2_cut), "regulier")
            .when((adi >= adi_cut) & (cv2 < cv2_cut), "intermittent").when((adi < adi_cut), "erratique").otherwise("grumeleux"))


def series_profile(daily: DataFrame, key: str = "unique_id") -> DataFrame:
    """Profile on the observed days only: span-based interval, lifecycle, modelable flag."""
    last = daily.agg(F.max("ds")).scalar()
    pos = F.col("y") > 0
    p = daily.groupBy(key).agg(
        F.min("ds").alias("premiere_vente"), F.max("ds").alias("derniere_vente"), F.count_distinct("ds").alias("n_jours_avec_vente"),
        F.sum("y").alias("total"), F.avg("y").alias("moyenne"), F.max("y").alias("maximum"), F.min("y").alias("minimum"),
        F.count_if(pos).alias("n_demandes"), F.avg(F.when(pos, F.col("y"))).alias("_m"), F.stddev_samp(F.when(pos, F.col("y"))).alias("_s"))
    p = (p.withColumn("span_jours", F.datediff("derniere_vente", "premiere_vente") + 1)
         .withColumn("jours_depuis_derniere_vente", F.datediff(last, "derniere_vente"))
         .withColumn("taux_jours_sans_vente", 1 - ratio("n_jours_avec_vente", "span_jours"))
         .withColumn("adi", ratio("span_jours", "n_demandes")).withColumn("cv2", F.pow(ratio("_s", "_m"), 2)).drop("_m", "_s"))
    life = (F.when(F.col("span_jours") < 90, "nouveau_ou_trop_court").when(F.col("n_demandes") < 12, "historique_insuffisant")
            .when(F.col("jours_depuis_derniere_vente") > 60, "inactif_ou_abandonne").otherwise("actif"))
    return (p.withColumn("profil_demande", demand_profile(F.col("adi"), F.col("cv2"))).withColumn("statut_cycle_vie", life)
            .withColumn("modelisable_ml", (F.col("statut_cycle_vie") == "actif") & (F.col("profil_demande") != "indetermine")))


def classify_demand(features: DataFrame, key: str = "unique_id", value: str = "ca") -> DataFrame:
    """Demand profile, lifecycle status, ABC on cumulated share, XYZ on variation, strategy group."""
    total = features.agg(F.sum(value)).scalar()
    ranked = running_totals(features, [], [-F.col(value), F.col(key)], {"_cum": F.col(value)})
    share = ratio("_cum", total)
    cv = F.col("cv_serie")
    status = (F.when(F.col("jours_inactivite") > 60, "inactif").when(F.col("n_jours") < 90, "nouveau")
              .when(F.col("n_jours_vente") < 12, "historique_insuffisant").otherwise("actif"))
    out = (ranked.withColumn("profil_demande", demand_profile(F.col("adi"), F.col("cv2"))).withColumn("statut", status)
           .withColumn("part_cumulee", share)
           .withColumn("classe_abc", F.when(share <= 0.8, "A").when(share <= 0.95, "B").otherwise("C"))
           .withColumn("classe_xyz", F.when(cv <= 0.5, "X").when(cv <= 1.0, "Y").otherwise("Z")).drop("_cum"))
    cold = (F.col("statut").isin("nouveau", "historique_insuffisant")) | (F.col("n_jours") < 90)
    return (out.withColumn("classe_abc_xyz", F.concat("classe_abc", "classe_xyz"))
            .withColumn("groupe_strategie", F.when(cold, "demarrage_a_froid")
                        .when(F.col("profil_demande").isin("intermittent", "grumeleux"), "intermittent").otherwise("standard")))


SEGMENT_COLUMNS = ("profil_demande", "statut", "classe_abc", "classe_xyz", "groupe_strategie")


def segmentation_summary(classified: DataFrame) -> DataFrame:
    """Series, volume, revenue, mean zero rate and shares for the five groupings, in one pass."""
    cols = list(SEGMENT_COLUMNS)
    sets = [[F.col(c)] for c in cols]
    which = F.when(F.lit(False), "")
    for i, c in enumerate(cols):
        which = which.when(F.grouping(c) == 0, c)
    g = (classified.groupingSets(sets, *[F.col(c) for c in cols])
         .agg(which.alias("axe"), N().alias("n_series"), F.sum("total").alias("volume"), F.round(F.sum("ca"), 4).alias("ca"),
              F.avg("taux_jours_sans_vente").alias("taux_zero_moyen")))
    whole = classified.agg(F.struct(N().alias("n"), F.sum("total").alias("v"))).scalar()
    return (g.withColumn("valeur", F.coalesce(*cols)).withColumn("part_series", ratio("n_series", whole.getField("n")))
            .withColumn("part_volume", ratio("volume", whole.getField("v"))).drop(*cols))


def abc_xyz_matrix(classified: DataFrame) -> DataFrame:
    return (classified.groupBy("classe_abc").pivot("classe_xyz", ["X", "Y", "Z"]).agg(F.count(F.lit(1)))
            .na.fill(0).orderBy("classe_abc"))


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest. Values are counted before the winner is taken."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(N().alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), F.col(value))).getField(value).alias(out))


def best_descriptive_discount(panel: DataFrame, min_support: int = 20) -> DataFrame:
    """Discount level with the best mean quantity among levels with enough rows, else 0 (ties: smallest level)."""
    levels = panel.groupBy("produit_key", "remise_pct").agg(F.avg("y").alias("_m"), N().alias("_n"))
    best = F.min(F.when(F.col("_n") >= min_support, F.struct(-F.col("_m"), F.col("remise_pct")))).getField("remise_pct")
    return levels.groupBy("produit_key").agg(F.coalesce(best, F.lit(0)).alias("best_descriptive"))


def all_baselines(panel: DataFrame, min_support: int = 20) -> DataFrame:
    """Zero, product mode, category mode and best descriptive discount next to the observed one, per product-day."""
    by_product = most_frequent(panel, ["produit_key"], "remise_pct", "frequent_product")
    by_category = most_frequent(panel, ["categorie"], "remise_pct", "frequent_category")
    return (panel.select("produit_key", "categorie", "ds", F.col("remise_pct").alias("observed"))
            .withColumn("zero", F.lit(0)).join(by_product, "produit_key").join(by_category, "categorie")
            .join(best_descriptive_discount(panel, min_support), "produit_key"))


def observed_discount_grid(panel: DataFrame, min_support: int = 50) -> DataFrame:
    return (panel.filter("en_promotion").groupBy(F.col("remise_pct").alias("level")).agg(N().alias("n"))
            .filter(F.col("n") >= min_support))


def pricing_panel(panel: DataFrame, stock_lag: DataFrame) -> DataFrame:
    """Panel joined to yesterday's stock, with weekday, month and log1p(y)."""
    return (panel.join(stock_lag.select("produit_key", "ds", "stock_disponible_lag1"), ["produit_key", "ds"], "left")
            .withColumn("jour_semaine", F.weekday("ds")).withColumn("mois", F.month("ds")).withColumn("log1p_y", F.log1p("y")))


def discount_support_table(panel: DataFrame) -> DataFrame:
    """Per level: products, days, units, categories, months, products also seen without promotion."""
    plain = panel.filter("not en_promotion").select("produit_key").distinct().withColumn("_plain", F.lit(1))
    g = (panel.filter("en_promotion").join(plain, "produit_key", "left").groupBy("remise_pct")
         .agg(F.count_distinct("produit_key").alias("produits_exposes"), N().alias("jours"), F.sum("y").alias("ventes_totales"),
              F.count_distinct("categorie").alias("n_categories"), F.count_distinct(F.trunc("ds", "month")).alias("mois_couverts"),
              F.count_distinct(F.when(F.col("_plain") == 1, F.col("produit_key"))).alias("support_commun")))
    return g.withColumn("pct_support_commun", ratio("support_commun", "produits_exposes"))


# fixed values: minimal promo days, plain days, levels, units, spread days, months, pooling units
ELIGIBILITY = {"jours_promo": 30, "jours_hors_promo": 30, "niveaux_reels": 2, "volume": 50, "etalement": 60, "mois_couverts": 2, "pooling": 20}


def discount_eligibility(panel: DataFrame, limits: dict | None = None) -> DataFrame:
    """Individual study, category pooling or none, with the failed rules as the reason."""
    lim = limits or ELIGIBILITY
    promo = F.col("en_promotion")
    g = panel.groupBy("produit_key").agg(
        F.min("categorie").alias("categorie"), F.count_if(promo).alias("jours_promo"), F.count_if(~promo).alias("jours_hors_promo"),
        F.count_distinct(F.when(promo, F.col("remise_pct"))).alias("niveaux_reels"), F.sum("y").alias("volume"),
        F.coalesce(F.datediff(F.max(F.when(promo, F.col("ds"))), F.min(F.when(promo, F.col("ds")))) + 1, F.lit(0)).alias("etalement"),
        F.count_distinct(F.when(promo, F.trunc("ds", "month"))).alias("mois_couverts"))
    rules = ("jours_promo", "jours_hors_promo", "niveaux_reels", "volume", "etalement", "mois_couverts")
    failed = F.concat_ws(", ", *[F.when(F.col(r) < lim[r], F.lit(r)) for r in rules])
    out = g.withColumn("_failed", failed)
    return (out.withColumn("groupe", F.when(F.col("_failed") == "", "eligible_individuel")
                           .when((F.col("jours_promo") >= 1) & (F.col("volume") >= lim["pooling"]), "eligible_pooling_categorie")
                           .otherwise("non_eligible"))
            .withColumn("raison", F.when(F.col("_failed") == "", "tous les critères").when(F.col("jours_promo") == 0, "aucune promotion")
                        .otherwise(F.col("_failed"))).drop("_failed"))


def negative_margins(panel: DataFrame) -> DataFrame:
    """Sold rows under cost, and whether the planned discount alone would have stayed above cost."""
    paid = ratio("ca", "y")
    return (panel.filter("y > 0").withColumn("marge_unitaire", paid - F.col("cout")).filter("marge_unitaire < 0")
            .withColumn("marge_totale", F.col("ca") - F.col("cout") * F.col("y"))
            .withColumn("prix_plan", F.col("prix_base") * (1 - F.col("remise_pct") / 100))
            .withColumn("du_au_bruit", F.col("prix_plan") >= F.col("cout")))


def negative_margin_report(panel: DataFrame) -> DataFrame:
    """Negative-margin rows by discount level, by category and overall, in one pass over grouping sets."""
    neg = negative_margins(panel)
    return (neg.groupingSets([[F.col("remise_pct")], [F.col("categorie")], []], F.col("remise_pct"), F.col("categorie"))
            .agg(N().alias("n_lignes"), F.count_distinct("produit_key").alias("n_produits"), F.round(F.sum("ca"), 4).alias("ca"),
                 F.round(F.sum("marge_totale"), 4).alias("perte_totale"), F.count_if("du_au_bruit").alias("n_bruit"))
            .withColumn("part_bruit", ratio("n_bruit", "n_lignes")))


def negative_margin_campaigns(panel: DataFrame, promo_days: DataFrame) -> DataFrame:
    """Negative-margin rows that fall in a campaign of their product, per campaign."""
    return (negative_margins(panel).drop("remise_pct").join(promo_days.select("produit_key", "ds", "promo_key", "portee"), ["produit_key", "ds"])
            .groupBy("promo_key", "portee").agg(N().alias("n_lignes"), F.round(F.sum("marge_totale"), 4).alias("perte_totale")))


def level_support_audit(panel: DataFrame) -> DataFrame:
    """Rows, products and share of rows per discount level."""
    total = panel.agg(N()).scalar()
    return (panel.groupBy("remise_pct").agg(N().alias("n_lignes"), F.count_distinct("produit_key").alias("n_produits"),
                                            F.sum("y").alias("unites")).withColumn("part", ratio("n_lignes", total)))


def grain_audit(panel: DataFrame) -> DataFrame:
    """Product-day completeness of the panel: rows, distinct cells, cells of the full rectangle, fill rate."""
    g = panel.agg(N().alias("n_lignes"), F.count_distinct("produit_key", "ds").alias("n_cellules"),
                  F.count_distinct("produit_key").alias("n_produits"), F.count_distinct("ds").alias("n_jours"))
    return g.withColumn("taux_remplissage", ratio("n_cellules", F.col("n_produits") * F.col("n_jours")))


def support_quantiles(panel: DataFrame) -> DataFrame:
    """Quantiles of the number of rows per product x level cell."""
    cells = panel.groupBy("produit_key", "remise_pct").agg(N().alias("n"))
    return exact_quantiles(cells, [], "n", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def monthly_promo_share(panel: DataFrame) -> DataFrame:
    return (panel.groupBy(F.trunc("ds", "month").alias("mois")).agg(N().alias("n"), F.count_if("en_promotion").alias("n_promo"))
            .withColumn("part_promo", ratio("n_promo", "n")))


def uplift_stability(panel: DataFrame, split: Column, min_support: int = 30) -> DataFrame:
    """Promo mean over plain mean per level in two periods, and their relative gap."""
    p = panel.withColumn("periode", F.when(F.col("ds") < split, "p1").otherwise("p2"))
    base = p.filter("not en_promotion").groupBy("periode").agg(F.avg("y").alias("base"))
    levels = (p.filter("en_promotion").groupBy("periode", "remise_pct").agg(N().alias("n"), F.avg("y").alias("m"))
              .filter(F.col("n") >= min_support).join(base, "periode").withColumn("uplift", ratio("m", "base")))
    wide = levels.groupBy("remise_pct").pivot("periode", ["p1", "p2"]).agg(F.max("uplift"))
    return wide.withColumn("ecart_relatif", ratio(F.abs(F.col("p2") - F.col("p1")), "p1"))


def order_and_segment_daily(confirmed: DataFrame, clients: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Distinct orders and clients, mean basket units, and units by loyalty segment per product-day."""
    basket = confirmed.groupBy("order_id").agg(F.sum("quantite").alias("_basket"))
    rich = (confirmed.join(basket, "order_id").join(clients.select("client_key", "segment_fidelite"), "client_key", "left"))
    return rich.groupBy("produit_key", "ds").agg(
        F.count_distinct("order_id").alias("order_count"), F.count_distinct("client_key").alias("distinct_clients"),
        F.avg("_basket").alias("avg_basket_quantity"),
        *[F.sum(F.when(F.col("segment_fidelite") == s, F.col("quantite")).otherwise(0)).alias(f"q_{s.lower()}") for s in segments])


def train_scales(train: DataFrame, key: str = "unique_id", season: int = 7) -> DataFrame:
    """Mean absolute and root mean squared seasonal difference of each training series (one row per day)."""
    w = Window.partitionBy(key).orderBy("ds")
    diff = train.withColumn("_d", F.col("y") - F.lag("y", season).over(w))
    return diff.groupBy(key).agg(F.avg(F.abs("_d")).alias("mae_scale"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rms_scale"))


def scd_versions(dim: DataFrame, natural_id: str) -> DataFrame:
    """Version counts per natural id and the defects of a slowly changing dimension."""
    w = Window.partitionBy(natural_id).orderBy("valid_from", "valid_to")
    v = (dim.withColumn("_next", F.lead("valid_from").over(w))
         .groupBy(natural_id).agg(N().alias("n_versions"), F.count_if("is_current").alias("n_current"),
                                  F.count_if(F.col("valid_to") < F.col("valid_from")).alias("n_inverted"),
                                  F.count_if(F.col("_next") <= F.col("valid_to")).alias("n_overlaps"),
                                  F.count_if(F.col("_next") > F.date_add("valid_to", 1)).alias("n_gaps")))
    return v.agg(N().alias("n_ids"), F.sum("n_versions").alias("n_versions"), F.count_if(F.col("n_versions") > 1).alias("ids_multi_version"),
                 F.count_if(F.col("n_current") > 1).alias("ids_multi_current"), F.count_if(F.col("n_current") == 0).alias("ids_no_current"),
                 F.sum("n_inverted").alias("n_inverted"), F.sum("n_overlaps").alias("n_overlaps"), F.sum("n_gaps").alias("n_gaps"))


def price_amplitude_and_correlation(panel: DataFrame, split: Column) -> DataFrame:
    """Paid price range, and price-quantity correlation outside promotion: whole period and both halves."""
    sold = panel.filter("y > 0").withColumn("p", ratio("ca", "y"))
    plain = ~F.col("en_promotion")
    early, late = plain & (F.col("ds") < split), plain & (F.col("ds") >= split)
    def corr(cond):
        p, y = F.when(cond, F.col("p")), F.when(cond, F.col("y").cast("double"))
        return ratio(F.covar_pop(p, y), F.stddev_pop(p) * F.stddev_pop(y))
    return sold.groupBy("produit_key").agg(
        F.min("p").alias("prix_min"), F.max("p").alias("prix_max"), F.round(corr(plain), 6).alias("corr"),
        F.round(corr(early), 6).alias("corr_p1"), F.round(corr(late), 6).alias("corr_p2"))


def response_by_level(panel: DataFrame, step: int = 5) -> DataFrame:
    """Rows and mean quantity by discount rounded to a step."""
    return panel.groupBy((F.round(F.col("remise_pct") / step, 0) * step).cast("int").alias("niveau")).agg(N().alias("n"), F.avg("y").alias("q_moy"))


def interaction_density(lines: DataFrame, clients: DataFrame, products: DataFrame) -> DataFrame:
    """Active clients and products, pairs and sparsity, quantiles of lines and distinct products per client."""
    base = lines.agg(F.count_distinct("client_key").alias("clients_actifs"), F.count_distinct("produit_key").alias("produits_vendus"),
                     F.count_distinct("client_key", "produit_key").alias("n_paires"))
    per = lines.groupBy("client_key").agg(N().alias("lignes"), F.count_distinct("produit_key").alias("distincts"))
    q1 = exact_quantiles(per, [], "lignes", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).select(F.struct("p10", "p50", "p90")).scalar()
    q2 = exact_quantiles(per, [], "distincts", {"p50": 0.5}).scalar()
    return (base.withColumn("part_clients_actifs", ratio("clients_actifs", clients.agg(F.count_distinct("client_key")).scalar()))
            .withColumn("part_produits_vendus", ratio("produits_vendus", products.agg(F.count_distinct("produit_key")).scalar()))
            .withColumn("sparsite", 1 - ratio("n_paires", F.col("clients_actifs") * F.col("produits_vendus")))
            .withColumn("lignes_p10", q1.getField("p10")).withColumn("lignes_p50", q1.getField("p50"))
            .withColumn("lignes_p90", q1.getField("p90")).withColumn("distincts_p50", q2))


def evaluable_clients(lines: DataFrame, clients: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window (fenetre, train_end, test_start, test_end): rows, evaluable clients, clients without history."""
    n_clients = clients.agg(F.count_distinct("client_key")).scalar()
    daily = lines.groupBy("client_key", "ds").agg(N().alias("n"))
    tagged = daily.join(F.broadcast(windows), (F.col("ds") <= F.col("train_end")) | F.col("ds").between(F.col("test_start"), F.col("test_end")))
    train, test = F.col("ds") <= F.col("train_end"), F.col("ds").between(F.col("test_start"), F.col("test_end"))
    return (tagged.groupBy("fenetre").agg(
        F.sum(F.when(train, F.col("n")).otherwise(0)).alias("n_lignes_train"), F.sum(F.when(test, F.col("n")).otherwise(0)).alias("n_lignes_test"),
        F.count_distinct(F.when(test, F.col("client_key"))).alias("n_evaluables"),
        (n_clients - F.count_distinct(F.when(train, F.col("client_key")))).alias("n_cold_start")))
