"""Lake zones: raw landing, bronze cleaning, the silver gate, the gold star schema and marts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.scalar import UNKNOWN_LABEL, zero_padded
from marketlens.operators.grids import explode_days
from marketlens.operators.ordered import materialise, running_totals

# fixed values: the six source tables, date columns, closed domains
SOURCE_TABLES = ("dim_products", "dim_customers", "promotions", "fact_transactions", "stock_daily", "web_events")
DATE_COLUMNS = ("order_date", "event_timestamp", "date", "signup_date", "launch_date", "start_date", "end_date")
ORDER_STATUSES = ("confirmee", "annulee", "retournee")
WEB_EVENT_TYPES = ("view", "add_to_cart", "purchase")


def raw_landing(df: DataFrame, root: str, table: str, ds: str) -> str:
    """Copies a source table into its ds partition; a second run replaces that ds only."""
    if table not in SOURCE_TABLES:
        raise ValueError(f"unknown source table {table}")
    path = f"{root}/raw/{table}"
    (df.withColumn("ds", F.lit(ds)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("ds").parquet(path))
    return path


def read_csv_any(spark: SparkSession, path: str, schema=None, partitions: int | None = None) -> DataFrame:
    """CSV or gzip CSV with a header; a gzip file is one task, so it can be spread after the read."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return df.repartition(partitions) if partitions else df


def bronze(df: DataFrame, date_columns: Sequence[str] = DATE_COLUMNS) -> DataFrame:
    """Clean column names, exact rows once, known date columns parsed (unparseable to NULL). No business rule."""
    named = df.toDF(*[c.strip().lower() for c in df.columns])
    dates = {c: F.try_to_timestamp(F.col(c).cast("string")) for c in named.columns if c in date_columns}
    return named.distinct().withColumns(dates) if dates else named.distinct()


def row_flags(table: str, has: Sequence[str]) -> dict[str, Column]:
    """Row rules of a source table; `_known` tells that the product exists."""
    if table == "fact_transactions":
        return {"invalid_quantity": F.col("quantity") < 1, "orphan_product": ~F.col("_known"),
                "invalid_status": ~F.coalesce(F.col("order_status").isin(*ORDER_STATUSES), F.lit(False))}
    if table == "stock_daily":
        return {f"negative_{c}": F.col(c) < 0 for c in ("stock_level", "quantite_vendue", "quantite_reapprovisionnee")}
    if table == "web_events":
        return {"orphan_product": ~F.col("_known"),
                "invalid_event_type": ~F.coalesce(F.col("event_type").isin(*WEB_EVENT_TYPES), F.lit(False))}
    return {}


def row_notes(table: str) -> dict[str, Column]:
    """Findings that are counted but never reject a row."""
    if table == "dim_customers":
        return {"missing_region_or_age": F.col("age_bracket").isNull() | F.col("region").isNull()}
    if table == "dim_products":
        return {"uppercase_category": (F.upper("category") == F.col("category")) & (F.lower("category") != F.col("category"))}
    return {}


def checked_rows(df: DataFrame, table: str, products: DataFrame | None = None) -> DataFrame:
    """Distinct rows with their number of copies and one boolean per rule.

    Copies are counted with map-side partial sums, so a row repeated very often never meets in one task.
    """
    columns = df.columns
    rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    rules = row_flags(table, columns)
    if "orphan_product" in rules:
        known = products.select("product_id").distinct().withColumn("_hit", F.lit(True))
        rows = (rows.join(known, "product_id", "left")
                .withColumn("_known", F.coalesce("_hit", F.lit(False))).drop("_hit"))
    rows = rows.withColumns({f"_rule_{n}": F.coalesce(c, F.lit(False)) for n, c in rules.items()})
    rows = rows.withColumns({f"_note_{n}": F.coalesce(c, F.lit(False)) for n, c in row_notes(table).items()})
    bad = F.lit(False)
    for n in rules:
        bad = bad | F.col(f"_rule_{n}")
    kept = [c for c in rows.columns if c != "_known"]
    return rows.select(*kept).withColumn("_bad", bad)


def check_counts(rows: DataFrame) -> list[Column]:
    """Aggregates over checked rows: counts per rule, number of rejected rows and error rate."""
    named = [c for c in rows.columns if c.startswith(("_rule_", "_note_"))]
    rejected = F.sum(F.when(F.col("_bad"), F.col("_copies")).otherwise(F.col("_copies") - 1))
    total = F.sum("_copies")
    return [total.alias("n_rows"), F.sum(F.col("_copies") - 1).alias("duplicates"),
            *[F.sum(F.when(F.col(c), F.col("_copies")).otherwise(0)).alias(c.split("_", 2)[2]) for c in named],
            rejected.alias("n_rejected"), (rejected / total).alias("error_rate")]


def row_check_counts(df: DataFrame, table: str, products: DataFrame | None = None) -> DataFrame:
    """Counts per rule, number of rejected rows and error rate, in one aggregate."""
    rows = checked_rows(df, table, products)
    return rows.agg(*check_counts(rows))


def silver_gate(df: DataFrame, table: str, products: DataFrame | None = None,
                error_threshold: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """(clean, rejects); raises when the share of rejected rows is above the threshold.

    Rows are checked once: their counts are observed while they are written, and both results read the written rows.
    """
    columns, rows, seen = df.columns, checked_rows(df, table, products), Observation()
    rows = materialise(rows.observe(seen, *check_counts(rows)))
    rate = seen.get
    if rate["n_rows"] and rate["error_rate"] > error_threshold:
        raise ValueError(f"[{table}] error rate {rate['error_rate']:.1%} above {error_threshold:.0%}")
    clean = rows.filter(~F.col("_bad")).select(*columns)
    extra = F.when(F.col("_bad"), F.col("_copies")).otherwise(F.col("_copies") - 1).cast("int")
    rejects = (rows.filter(extra > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), extra))).select(*columns))
    return clean, rejects


def surrogate_keys(df: DataFrame, natural_id: str, key: str, prefix: str, width: int = 6) -> DataFrame:
    """Zero-based padded surrogate key in the order of the natural id, numbered without a single-task sort.

    A position is the place inside a range of ids plus the rows of the ranges before. Ranges and their counts come from the id column alone, and nothing is written.
    """
    numbered = running_totals(df, [], [F.col(natural_id)], {"_pos": F.lit(1)}, write=False)
    return numbered.withColumn(key, zero_padded(prefix, F.col("_pos") - 1, width)).drop("_pos")


def canonical_category(df: DataFrame, column: str) -> DataFrame:
    """Each spelling replaced by the most frequent one of its lower-case form (ties: smallest text)."""
    counts = (df.select(F.trim(column).alias("_spelling")).groupBy("_spelling").agg(F.count(F.lit(1)).alias("_n")))
    best = (counts.filter(F.col("_spelling").isNotNull()).groupBy(F.lower("_spelling").alias("_low"))
            .agg(F.min(F.struct(-F.col("_n"), F.col("_spelling"))).getField("_spelling").alias("_canon")))
    return (df.withColumn("_low", F.lower(F.trim(column))).join(best, "_low", "left")
            .withColumn(column, F.col("_canon")).drop("_low", "_canon"))


def dim_product(products: DataFrame) -> DataFrame:
    keyed = canonical_category(surrogate_keys(products, "product_id", "produit_key", "PRD"), "category")
    return keyed.select("produit_key", "product_id", "product_name", F.col("category").alias("categorie"), F.col("brand").alias("marque"),
                        F.col("base_price_xof").alias("prix_base_xof"), F.col("cost_xof").alias("cout_xof"), F.col("launch_date").alias("valid_from"),
                        F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))


def dim_customer(customers: DataFrame) -> DataFrame:
    return surrogate_keys(customers, "customer_id", "client_key", "CLI").select(
        "client_key", "customer_id", F.coalesce("region", F.lit(UNKNOWN_LABEL)).alias("region"),
        F.coalesce("age_bracket", F.lit(UNKNOWN_LABEL)).alias("age_bracket"),
        F.col("loyalty_segment").alias("segment_fidelite"), F.col("signup_date").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))


def dim_promotions(promotions: DataFrame) -> DataFrame:
    return surrogate_keys(promotions, "promotion_id", "promo_key", "PRM", 4).select(
        "promo_key", "promotion_id", F.col("scope").alias("portee"), F.col("target").alias("cible"),
        F.col("discount_pct").alias("remise_pct"), F.col("start_date").alias("date_debut"), F.col("end_date").alias("date_fin"))


def dim_calendar(transactions: DataFrame, web: DataFrame) -> DataFrame:
    """Every day from the first to the last date of both facts."""
    span = (transactions.select(F.to_date("order_date").alias("d"))
            .union(web.select(F.to_date("event_timestamp"))).agg(F.min("d").alias("lo"), F.max("d").alias("hi")))
    return explode_days(span, F.col("lo"), F.col("hi"), "date_complete").select(
        F.date_format("date_complete", "yyyyMMdd").alias("date_key"), "date_complete",
        F.year("date_complete").alias("annee"), F.month("date_complete").alias("mois"),
        F.dayofmonth("date_complete").alias("jour"), F.date_format("date_complete", "EEEE").alias("jour_semaine"),
        (F.weekday("date_complete") >= 5).alias("est_weekend"))


def star_schema(products: DataFrame, customers: DataFrame, promotions: DataFrame, transactions: DataFrame,
                stock: DataFrame, web: DataFrame) -> dict[str, DataFrame]:
    """Four dimensions and three facts; NULL promotion and NULL client are legal."""
    dim_produit, dim_client, dim_promotion = dim_product(products), dim_customer(customers), dim_promotions(promotions)
    dim_date = dim_calendar(transactions, web)
    p = dim_produit.select("product_id", "produit_key")
    c = dim_client.select("customer_id", "client_key")
    m = dim_promotion.select("promotion_id", "promo_key")
    fact_ventes = (transactions.join(p, "product_id", "left").join(c, "customer_id", "left").join(m, "promotion_id", "left")
                   .select(F.col("ligne_id_origine").alias("vente_id"), "produit_key", "client_key",
                           F.date_format("order_date", "yyyyMMdd").alias("date_key"), "promo_key",
                           F.col("quantity").alias("quantite"),
                           (F.col("quantity") * F.col("unit_price_xof")).alias("montant_net_xof"), "order_id",
                           F.col("order_status").alias("statut_commande")))
    fact_web = (web.join(p, "product_id", "left").join(c, "customer_id", "left")
                .select("event_id", "session_id", "produit_key", "client_key", "anonymous_id",
                        F.date_format("event_timestamp", "yyyyMMdd").alias("date_key"), "event_timestamp",
                        F.col("event_type").alias("type_event"), F.col("device").alias("appareil"),
                        F.col("referral_source").alias("source_trafic"), "canal", "order_id",
                        F.col("quantity").cast("int").alias("quantity"), "est_bot"))
    fact_stock = (stock.join(p, "product_id", "left")
                  .select("produit_key", F.date_format("date", "yyyyMMdd").alias("date_key"),
                          F.col("stock_level").alias("niveau_stock"), "quantite_vendue", "quantite_reapprovisionnee"))
    return {"dim_produit": dim_produit, "dim_client": dim_client, "dim_promotion": dim_promotion, "dim_date": dim_date,
            "fact_ventes": fact_ventes, "fact_evenements_web": fact_web, "fact_stock": fact_stock}


def marts(transactions: DataFrame) -> dict[str, DataFrame]:
    revenue = F.col("quantity") * F.col("unit_price_xof")
    return {"daily_sales_by_product": transactions.groupBy("product_id", F.to_date("order_date").alias("date"))
            .agg(F.sum("quantity").alias("quantity"), F.sum(revenue).alias("revenue_xof")),
            "product_performance": transactions.groupBy("product_id")
            .agg(F.sum("quantity").alias("total_qty"), F.sum(revenue).alias("total_revenue_xof"),
                 F.avg("unit_price_xof").alias("avg_price_xof"), F.count("order_id").alias("n_orders"))}


def gold(silver: dict[str, DataFrame]) -> dict[str, DataFrame]:
    star = star_schema(*[silver[t] for t in ("dim_products", "dim_customers", "promotions", "fact_transactions",
                                             "stock_daily", "web_events")])
    return {**star, **marts(silver["fact_transactions"])}
