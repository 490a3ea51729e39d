"""Row filters and derived row columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.scalar import ratio
from marketlens.operators.schema import require_columns

EXCLUDED_STATUSES = ("annulee", "retournee")
PERIOD_DAYS = {"30d": 30, "3m": 92, "6m": 183, "1y": 365}


def valid_lines(sales: DataFrame, excluded: Sequence[str] = EXCLUDED_STATUSES, drop_returns: bool = True) -> DataFrame:
    """Drops cancelled and returned lines; absent status columns exclude nothing."""
    out = sales
    if "statut_commande" in sales.columns:
        out = out.filter(~F.coalesce(F.col("statut_commande").isin(*excluded), F.lit(False)))
    if "is_annulee" in sales.columns:
        out = out.filter(~F.coalesce(F.col("is_annulee"), F.lit(False)))
    if drop_returns and "is_retour" in sales.columns:
        out = out.filter(~F.coalesce(F.col("is_retour"), F.lit(False)))
    return out


def exclude_bots(web: DataFrame) -> DataFrame:
    """Drops robot (and internal test) traffic; the robot flag is mandatory."""
    flag = "est_bot" if "est_bot" in web.columns else "is_bot"
    require_columns(web, [flag], "robot exclusion")
    out = web.filter(~F.coalesce(F.col(flag), F.lit(False)))
    if "is_internal_test" in web.columns:
        out = out.filter(~F.coalesce(F.col("is_internal_test"), F.lit(False)))
    return out


def exclude_bot_sessions(web: DataFrame, flag: str = "est_bot") -> DataFrame:
    """Drops every event of a session that holds a robot event."""
    bots = web.filter(F.col(flag)).select("session_id").distinct()
    return web.join(bots, "session_id", "left_anti")


def eligible_web_history(interactions: DataFrame, cutoff: Column) -> DataFrame:
    """Known clients, strictly before the cutoff, purchases left out."""
    return interactions.filter((F.col("event_timestamp") < cutoff) & (F.col("type_identite") == "client")
                               & (F.col("event_type") != "purchase"))


def period_bounds(dates: DataFrame, period: str, day: str = "ds") -> DataFrame:
    """(start, end) of the window of the period's length ending on the last date present."""
    return dates.agg(F.max(day).alias("end")).select(F.date_sub("end", PERIOD_DAYS[period] - 1).alias("start"), "end")


def within_period(df: DataFrame, period: str, day: str = "ds") -> DataFrame:
    last = df.agg(F.max(day)).scalar()
    return df.filter((F.col(day) <= last) & (F.col(day) > F.date_sub(last, PERIOD_DAYS[period])))


def star(sales: DataFrame, products: DataFrame, clients: DataFrame) -> DataFrame:
    return (sales.join(products.select("produit_key", "product_name", "categorie", "marque", "prix_base", "cout"), "produit_key", "left")
            .join(clients.select("client_key", "region", "age_bracket", "segment_fidelite"), "client_key", "left"))


def filter_sales(lines: DataFrame, *, category=None, brand=None, product=None, region=None, segment=None, age=None,
                 client=None, year=None, month=None, start=None, end=None, period=None, weekend=None, promo=None,
                 status=None, text=None) -> DataFrame:
    """Optional filters on star-joined lines, all combined with AND. `weekend`/`promo`: 'yes' or 'no'."""
    out = lines
    for column, value in (("categorie", category), ("marque", brand), ("produit_key", product), ("region", region),
                          ("segment_fidelite", segment), ("age_bracket", age), ("client_key", client), ("statut_commande", status)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if year is not None:
        out = out.filter(F.year("ds") == year)
    if month is not None:
        out = out.filter(F.month("ds") == month)
    if start is not None:
        out = out.filter(F.col("ds") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("ds") <= F.lit(end).cast("date"))
    if weekend is not None:
        on_weekend = F.weekday("ds") >= 5
        out = out.filter(on_weekend if weekend == "yes" else ~on_weekend)
    if promo is not None:
        out = out.filter(F.col("promo_key").isNotNull() if promo == "yes" else F.col("promo_key").isNull())
    if text:
        fields = ("order_id", "produit_key", "product_name", "categorie", "marque", "client_key", "region")
        out = out.filter(F.lower(F.concat_ws(" ", *fields)).contains(text.lower()))
    return within_period(out, period) if period else out


def stock_status(level: Column, low: int = 40) -> Column:
    return F.when(level <= 0, "rupture").when(level < low, "faible").otherwise("ok")


def filter_stock(stock: DataFrame, status: str | None = None, level: str = "niveau_stock") -> DataFrame:
    out = stock.withColumn("statut_stock", stock_status(F.col(level)))
    return out.filter(F.col("statut_stock") == status) if status else out


def net_quantity(quantity: Column, status: Column) -> Column:
    """Cancelled lines count 0, returned lines count negative, whatever the sign in the source."""
    return (F.when(F.lower(status).rlike("annul|cancel"), F.lit(0))
            .when(F.lower(status).rlike("retour|return|rembours|refund"), -F.abs(quantity)).otherwise(quantity))


def pricing_columns(daily: DataFrame) -> DataFrame:
    """Paid price (NULL without a sale), applied discount, unit and total margin, margin rate."""
    paid = F.when(F.col("y") > 0, ratio("ca", "y"))
    return (daily.withColumn("prix_paye", paid)
            .withColumn("remise_appliquee_pct", 100 * (1 - ratio("prix_paye", "prix_base")))
            .withColumn("marge_unitaire", F.col("prix_paye") - F.col("cout"))
            .withColumn("marge_totale", F.col("marge_unitaire") * F.col("y"))
            .withColumn("taux_marge", ratio("marge_unitaire", "prix_paye")))


def realised_vs_expected(daily: DataFrame) -> DataFrame:
    return (daily.withColumn("prix_realise", F.when(F.col("y") > 0, ratio("ca", "y")))
            .withColumn("prix_attendu", F.col("prix_base") * (1 - F.col("remise_pct") / 100)))
