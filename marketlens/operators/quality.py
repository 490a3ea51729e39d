"""Data-quality checks. Every check is a plan that yields result rows; checks of one table share one aggregate."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.scalar import has_offset, ratio
from marketlens.operators.ordered import CHUNK, carry_over, exact_quantiles, materialise, time_chunk



def N() -> Column:
    return F.count(F.lit(1))



def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def as_rows(one_row: DataFrame, names: Sequence[str], key: str = "name", value: str = "n") -> DataFrame:
    return one_row.select([F.col(c).cast("double").alias(c) for c in names]).unpivot([], [F.col(c) for c in names], key, value)


# fixed values: (table, rule, column, argument) of the delivery expectations
EXPECTATIONS = [
    ("dim_products", "not_null", "product_id", 1.0), ("dim_products", "unique", "product_id", None), ("dim_products", "not_null", "category", 1.0),
    ("dim_products", "not_match", "category", r"^[A-Z\s&\-]+$"),
    ("dim_customers", "not_null", "customer_id", 1.0), ("dim_customers", "unique", "customer_id", None), ("dim_customers", "not_null", "region", 0.90),
    ("dim_customers", "not_null", "age_bracket", 0.90),
    ("promotions", "not_null", "promotion_id", 1.0), ("promotions", "unique", "promotion_id", None), ("promotions", "between", "discount_pct", (0, 100)),
    ("fact_transactions", "not_null", "ligne_id_origine", 1.0), ("fact_transactions", "unique", "ligne_id_origine", None),
    ("fact_transactions", "not_null", "order_id", 1.0), ("fact_transactions", "in_set", "order_status", ("confirmee", "annulee", "retournee")),
    ("fact_transactions", "not_null", "customer_id", 1.0), ("fact_transactions", "not_null", "product_id", 1.0),
    ("fact_transactions", "between", "quantity", (1, None)), ("fact_transactions", "known_product", "product_id", None),
    ("stock_daily", "not_null", "product_id", 1.0), ("stock_daily", "not_null", "date", 1.0), ("stock_daily", "between", "stock_level", (0, None)),
    ("stock_daily", "between", "quantite_vendue", (0, None)), ("stock_daily", "between", "quantite_reapprovisionnee", (0, None)),
    ("web_events", "not_null", "event_id", 1.0), ("web_events", "unique", "event_id", None),
    ("web_events", "in_set", "event_type", ("view", "add_to_cart", "purchase")), ("web_events", "known_product", "product_id", None),
]


def expectations(df: DataFrame, table: str, products: DataFrame | None = None, rules=EXPECTATIONS) -> DataFrame:
    """Unexpected counts and verdicts of all rules of a table.

    Row rules are conditional counts of one aggregate. A repeated value counts all its rows, from counts per
    value, so no group is gathered.
    """
    mine = [r for r in rules if r[0] == table]
    if not mine:
        raise ValueError(f"no rules for table {table}")
    base = df
    if any(r[1] == "known_product" for r in mine):
        known = products.select("product_id").distinct().withColumn("_known", F.lit(True))
        base = df.join(known, "product_id", "left")
    aggs = [N().alias("_n")]
    for i, (_, rule, c, arg) in enumerate(mine):
        v = F.col(c)
        if rule == "not_null":
            bad = v.isNull()
        elif rule == "between":
            lo, hi = arg
            bad = (v < lo if lo is not None else F.lit(False)) | (v > hi if hi is not None else F.lit(False))
        elif rule == "in_set":
            bad = v.isNotNull() & ~v.isin(*arg)
        elif rule == "not_match":
            bad = v.rlike(arg)
        elif rule == "known_product":
            bad = v.isNotNull() & F.col("_known").isNull()
        else:
            continue
        aggs.append(F.count_if(F.coalesce(bad, F.lit(False))).alias(f"r{i}"))
    one = base.agg(*aggs)
    for i, (_, rule, c, _arg) in enumerate(mine):
        if rule == "unique":
            repeated = (df.filter(F.col(c).isNotNull()).groupBy(c).agg(N().alias("n")).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0))))
            one = one.withColumn(f"r{i}", repeated.scalar())
    rows = F.array(*[F.struct(F.lit(r[1]).alias("rule"), F.lit(r[2]).alias("column"), F.col(f"r{i}").cast("long").alias("unexpected"),
                              F.lit(float(r[3]) if r[1] == "not_null" else 1.0).alias("mostly")) for i, r in enumerate(mine)])
    out = one.select("_n", F.explode(rows).alias("e")).select(F.lit(table).alias("table_name"), "e.*", "_n")
    return out.withColumn("success", 1 - F.coalesce(ratio("unexpected", "_n"), F.lit(0.0)) >= F.col("mostly")).drop("_n", "mostly")


def missing_values(df: DataFrame, required: Sequence[str] = (), sparse: Sequence[str] = ()) -> DataFrame:
    """NULL rate per column with its reading; one pass."""
    long = as_rows(df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]), df.columns, "colonne", "taux_na")
    return long.withColumn("status", F.when(F.col("taux_na") == 0, "ok").when(F.col("colonne").isin(*required), "critique")
                           .when(F.col("colonne").isin(*sparse), "ok").otherwise("alerte")) \
        .withColumn("interpretation", F.when(F.col("colonne").isin(*required), "colonne obligatoire").when(F.col("colonne").isin(*sparse), "vide attendu (clé optionnelle)")
                    .when(F.col("taux_na") >= 1, "colonne entièrement vide (structurel)").otherwise("—"))


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Repeated rows (all but the first) on the whole row and on the key."""
    full = df.groupBy(*df.columns).agg(N().alias("n"))
    per_key = full.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("d"))
    return (per_key.agg(F.sum("n").alias("n_lignes"), F.sum("d").alias("doublons_ligne"), F.sum(F.col("n") - 1).alias("doublons_cle"))
            .withColumn("status", F.when(F.col("doublons_cle") > 0, "critique").when(F.col("doublons_ligne") > 0, "alerte").otherwise("ok")))


def date_coverage(df: DataFrame, day: str = "ds") -> DataFrame:
    from marketlens.operators.schema import infer_frequency
    g = df.filter(F.col(day).isNotNull()).agg(F.min(day).alias("debut"), F.max(day).alias("fin"), F.count_distinct(day).alias("n_jours"))
    gap = infer_frequency(df, day).select("modal_gap").scalar()
    span = F.datediff("fin", "debut") + 1
    return (g.withColumn("couverture", ratio(F.col("n_jours"), span)).withColumn("ecart_modal", gap)
            .withColumn("status", F.when(F.col("couverture") > 0.9, "ok").when(F.col("couverture") > 0.5, "alerte").otherwise("critique")))


def negatives_zeros(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative, zero and non-numeric counts with min, max, mean per column; one pass, then laid out as rows."""
    aggs = []
    for c in columns:
        v = F.col(c).try_cast("double")
        aggs.append(F.struct(F.lit(c).alias("colonne"), F.count_if(v < 0).alias("n_negatifs"), F.count_if(v == 0).alias("n_zeros"),
                             F.count_if(v.isNull() & F.col(c).isNotNull()).alias("n_non_numerique"), F.min(v).alias("min"), F.max(v).alias("max"),
                             F.round(F.avg(v), 6).alias("moyenne")).alias(c))
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(c) for c in columns])).alias("e")).select("e.*")


def returns_cancellations(df: DataFrame, status: str = "statut_commande", quantity: str = "quantite") -> DataFrame:
    total = df.agg(N()).scalar()
    return df.groupBy(F.col(status).alias("valeur")).agg(N().alias("n"), F.count_if(F.col(quantity) < 0).alias("n_negatifs")).withColumn("part", ratio("n", total))


def amount_formulas(qty: Column, price: Column, discount: Column) -> dict[str, Column]:
    gross = qty * price
    return {"quantite x prix": gross, "quantite x prix x (1 - remise)": gross * (1 - discount),
            "quantite x prix x (1 - remise/100)": gross * (1 - discount / 100), "quantite x prix - remise": gross - discount}


TOLERANCES = (0.005, 0.01, 0.02, 0.05, 0.10)


def amount_consistency(df: DataFrame, qty: str, price: str, amount: str, discount: str) -> DataFrame:
    """Share of lines within five tolerances for four formulas, and the best one at 5 %; one pass."""
    forms = amount_formulas(F.col(qty), F.col(price), F.coalesce(F.col(discount), F.lit(0)))
    structs = []
    for name, expected in forms.items():
        err = ratio(F.abs(expected - F.col(amount)), F.abs(amount))
        structs.append(F.struct(F.lit(name).alias("formule"), *[F.avg(F.coalesce(err <= tol, F.lit(False)).cast("int")).alias(f"t{int(tol * 1000)}") for tol in TOLERANCES]))
    rows = df.agg(F.array(*structs).alias("a")).select(F.posexplode("a").alias("_i", "e")).select("_i", "e.*")
    best = rows.agg(F.max_by("formule", F.struct("t50", -F.col("_i")))).scalar()
    return rows.drop("_i").withColumn("meilleure", F.col("formule") == best)


def amount_ratio_quantiles(df: DataFrame, expected: Column, amount: str) -> DataFrame:
    rated = df.select(ratio(F.col(amount), expected).alias("r"))
    return exact_quantiles(rated, [], "r", {"p0_1": 0.001, "mediane": 0.5, "p99_9": 0.999})


def launch_dates(sales: DataFrame, products: DataFrame, validity: str = "valid_from") -> DataFrame:
    """Sales before the declared launch, and the delay from launch to first sale."""
    joined = sales.join(products.select("produit_key", F.col(validity).alias("_launch")), "produit_key").filter("_launch is not null")
    per = joined.groupBy("produit_key", "_launch").agg(F.min("ds").alias("first"), N().alias("n"), F.count_if(F.col("ds") < F.col("_launch")).alias("before"))
    per = per.withColumn("delay", F.datediff("first", "_launch"))
    med = exact_quantiles(per, [], "delay", {"m": 0.5}).scalar()
    rate = ratio("n_avant", "n_ventes")
    return (per.agg(F.sum("n").alias("n_ventes"), F.sum("before").alias("n_avant"), F.max("delay").alias("delai_max"))
            .withColumn("taux", rate).withColumn("delai_median", med)
            .withColumn("status", F.when(F.col("n_avant") == 0, "ok").when(rate > 0.01, "critique").otherwise("alerte")))


def promotion_windows(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Share of promoted sales inside the declared window of their promotion."""
    promo = sales.filter("promo_key is not null").join(promotions.select("promo_key", "date_debut", "date_fin"), "promo_key", "left")
    inside = F.coalesce(F.col("ds").between(F.col("date_debut"), F.col("date_fin")), F.lit(False))
    return (promo.agg(N().alias("n_ventes_promues"), F.count_if(inside).alias("n_dedans")).withColumn("taux", ratio("n_dedans", "n_ventes_promues"))
            .withColumn("status", F.when(F.col("taux") > 0.99, "ok").when(F.col("taux") > 0.9, "alerte").otherwise("critique")))


def promotion_coverage(sales: DataFrame) -> DataFrame:
    """Share of lines, days and products touched by a promotion."""
    flag = F.col("promo_key").isNotNull()
    days = sales.groupBy("ds").agg(F.bool_or(flag).alias("f")).agg(F.avg(F.col("f").cast("int"))).scalar()
    items = sales.groupBy("produit_key").agg(F.bool_or(flag).alias("f")).agg(F.avg(F.col("f").cast("int"))).scalar()
    return (sales.agg(F.avg(flag.cast("int")).alias("part_lignes")).withColumn("part_jours", days).withColumn("part_produits", items)
            .withColumn("status", F.when(F.col("part_lignes") > 0.01, "ok").otherwise("alerte")))


def verify_promo_calendar(sales: DataFrame, calendar: DataFrame) -> DataFrame:
    """Recall of the rebuilt calendar on promoted sales and its apparent precision. `calendar`: produit_key, ds."""
    covered = calendar.select("produit_key", "ds").distinct().withColumn("_c", F.lit(1))
    j = sales.join(covered, ["produit_key", "ds"], "left")
    promo, in_cal = F.col("promo_key").isNotNull(), F.col("_c") == 1
    return j.agg(F.count_if(promo).alias("n_ventes_promues"), ratio(F.count_if(promo & in_cal), F.count_if(promo)).alias("rappel"),
                 F.count_if(in_cal).alias("n_couvertes"), ratio(F.count_if(promo & in_cal), F.count_if(in_cal)).alias("precision_apparente"))


class CalendarRecallTooLow(ValueError):
    """The rebuilt promotion calendar misses promoted sales."""


def require_recall(report: DataFrame, minimum: float = 0.999) -> DataFrame:
    recall = report.first()["rappel"]
    if recall is not None and recall < minimum:
        raise CalendarRecallTooLow(f"calendar recall {recall:.4f} under {minimum}")
    return report


def required_fields(columns_by_table: dict[str, Sequence[str]], required: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(t, c) for t, c in required if c not in set(columns_by_table.get(t, ()))]


def coverage(df: DataFrame, columns: dict[str, float], scope: Column | None = None) -> DataFrame:
    """Non-null share per column in a scope against its minimum; an empty scope fails. One pass."""
    inside = scope if scope is not None else F.lit(True)
    aggs = [F.count_if(inside).alias("_n")] + [F.count_if(inside & F.col(c).isNotNull()).alias(c) for c in columns]
    rows = F.array(*[F.struct(F.lit(c).alias("colonne"), F.col(c).alias("n_non_nul"), F.lit(float(m)).alias("minimum")) for c, m in columns.items()])
    out = df.agg(*aggs).select("_n", F.explode(rows).alias("e")).select("e.colonne", F.col("_n").alias("n_perimetre"), ratio("e.n_non_nul", "_n").alias("taux"), "e.minimum")
    return out.withColumn("passed", F.coalesce(F.col("taux") >= F.col("minimum"), F.lit(False)))


def history_coverage(df: DataFrame, day: str, start: Column, end: Column, minimum: float) -> DataFrame:
    """Days of the old period that the delivery still covers."""
    inside = F.col(day).between(start, end)
    return (df.agg(F.count_distinct(F.when(inside, F.col(day))).alias("jours_couverts"), (F.datediff(F.max(end), F.max(start)) + 1).alias("jours_attendus"))
            .withColumn("part", ratio("jours_couverts", "jours_attendus")).withColumn("passed", F.col("part") >= minimum))


def uniqueness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows involved in repeated keys and ten sample keys."""
    rep = df.groupBy(*columns).agg(N().alias("n")).filter("n > 1")
    total = rep.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return rep.orderBy(*columns).limit(10).withColumn("n_lignes_dupliquees", total)


def tz_aware(df: DataFrame, column: str) -> DataFrame:
    """Text timestamps without Z or an offset."""
    return (df.agg(F.count(column).alias("n_examinees"), F.count_if(F.col(column).isNotNull() & ~has_offset(F.col(column))).alias("n_sans_fuseau"))
            .withColumn("passed", F.col("n_sans_fuseau") == 0))


def future_events(df: DataFrame, column: str, reference: Column) -> DataFrame:
    return (df.agg(F.count_if(F.col(column) > reference).alias("n_futurs"), F.max(column).alias("max_observe"))
            .withColumn("passed", F.col("n_futurs") == 0))


def session_order(df: DataFrame, session: str = "session_id", ts: str = "event_timestamp", order: str = "event_id", width: int = 4096) -> DataFrame:
    """Backward time steps along the id order of each session (a warning). Long sessions are cut by id range."""
    from pyspark.sql import Window
    d = df.select(session, ts, order).dropna().withColumn(CHUNK, F.floor(F.col(order) / width))
    w = Window.partitionBy(session, CHUNK).orderBy(order)
    before = carry_over(d, [session], {"_last": F.max_by(ts, order)}, lambda n: F.last(n, ignorenulls=True))
    step = (d.withColumn("_p", F.lag(ts).over(w)).join(before, [session, CHUNK], "left").withColumn("_p", F.coalesce("_p", "_last")))
    back = F.col(ts) < F.col("_p")
    return (step.agg(F.count_if(back).alias("n_transitions"), F.count_distinct(F.when(back, F.col(session))).alias("n_sessions"))
            .withColumn("passed", F.col("n_transitions") == 0))


def bots_and_tests(df: DataFrame, bot: str = "est_bot", test: str | None = None) -> DataFrame:
    """Robot and test shares; a rate of exactly zero robots is suspicious."""
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    n_test = flag(test) if test else F.lit(0).cast("long")
    return (df.agg(N().alias("n_lignes"), flag(bot).alias("n_bots"), n_test.alias("n_tests"))
            .withColumn("part_a_exclure", ratio(F.col("n_bots") + F.col("n_tests"), F.col("n_lignes")))
            .withColumn("passed", ~((F.col("n_lignes") > 0) & (F.col("n_bots") == 0))))


def purchase_without_order(web: DataFrame) -> DataFrame:
    buy = F.col("event_type") == "purchase"
    return (web.agg(F.count_if(buy).alias("n_achats"), F.count_if(buy & F.col("order_id").isNull()).alias("n_sans_order_id"))
            .withColumn("passed", (F.col("n_achats") > 0) & (F.col("n_sans_order_id") == 0)))


def order_single(sales: DataFrame, columns: Sequence[str] = ("client_key", "ds", "statut_commande")) -> DataFrame:
    """Orders that carry more than one client, date or status."""
    per = sales.filter("order_id is not null").groupBy("order_id").agg(
        *[(F.min(c) != F.max(c)).alias(c) for c in columns])
    return as_rows(per.agg(*[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in columns]), columns, "colonne", "n_violations") \
        .withColumn("n_violations", F.col("n_violations").cast("long")).withColumn("passed", F.col("n_violations") == 0)


def returns_after_order(sales: DataFrame, flag: str, returned: str, ordered: str) -> DataFrame:
    is_back = F.coalesce(F.col(flag), F.lit(False))
    return (sales.agg(F.count_if(is_back).alias("n_retours"), F.count_if(is_back & (F.col(returned) < F.col(ordered))).alias("n_avant_commande"))
            .withColumn("passed", F.col("n_avant_commande") == 0))


def closed_domain(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside a closed list, with their number of rows."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("valeur")).agg(N().alias("n")).filter(~F.col("valeur").isin(*values))


def summary(results: DataFrame) -> DataFrame:
    """Checks, errors, warnings and the verdict. `results`: name, severity (erreur / avertissement), passed."""
    failed = ~F.coalesce(F.col("passed"), F.lit(False))
    return (results.agg(N().alias("n_controles"), F.count_if(failed & (F.col("severity") == "erreur")).alias("n_erreurs"),
                        F.count_if(failed & (F.col("severity") == "avertissement")).alias("n_avertissements"))
            .withColumn("passed", F.col("n_erreurs") == 0))


def repeated_keys(df: DataFrame, columns: Sequence[str]) -> Column:
    return df.groupBy(*columns).agg(N().alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))).scalar()


def missing_refs(fact: DataFrame, dim: DataFrame, key: str) -> Column:
    return fact.filter(F.col(key).isNotNull()).join(dim.select(key).distinct(), key, "left_anti").agg(N()).scalar()


def final_build_checks(sales: DataFrame, products: DataFrame, clients: DataFrame, web: DataFrame, stock: DataFrame) -> DataFrame:
    """Checks before the datasets are built, as rows (name, n defects, ok)."""
    from marketlens.operators.windows import sessionize, stock_identity_residual
    priced = sales.join(products.select("produit_key", "prix_base"), "produit_key")
    expected = F.col("prix_base") * F.col("quantite") * (1 - F.col("remise_pct") / 100)
    buy = F.col("event_type") == "purchase"
    one = sales.agg(
        F.count_if(~F.col("statut_commande").isin("confirmee", "annulee", "retournee")).alias("statuts"), N().alias("_n")).select(
        "statuts", repeated_keys(sales, ["vente_id"]).alias("pk_ventes"), repeated_keys(web, ["event_id"]).alias("pk_web"),
        repeated_keys(stock, ["produit_key", "ds"]).alias("pk_stock"), missing_refs(sales, products, "produit_key").alias("fk_ventes_produit"),
        missing_refs(sales, clients, "client_key").alias("fk_ventes_client"), missing_refs(web, products, "produit_key").alias("fk_web_produit"),
        web.agg(F.count_if(F.col("est_bot").isNull())).scalar().alias("bots"), web.agg(F.count_if(buy & F.col("order_id").isNull())).scalar().alias("purchase_order"),
        web.agg(F.count_if(buy & F.col("quantity").isNull())).scalar().alias("purchase_quantity"),
        priced.agg(F.count_if(F.abs(ratio(F.col("montant_net"), expected) - 1) > 0.021)).scalar().alias("price_formula"),
        products.groupBy("product_id").agg((F.min("prix_base") != F.max("prix_base")).alias("v")).agg(F.count_if("v")).scalar().alias("catalog_price_fixed"),
        stock_identity_residual(stock).agg(F.count_if(F.col("residu") != 0)).scalar().alias("stock_formula"),
        sessionize(web.filter("session_id is not null"), key="session_id").agg(F.count_if(F.col("session_no") > 1)).scalar().alias("sessions_timeout_30"))
    return as_rows(one, one.columns, "controle", "n_defauts").withColumn("n_defauts", F.col("n_defauts").cast("long")).withColumn("ok", F.col("n_defauts") == 0)


def sales_conservation(source: DataFrame, grid: DataFrame) -> DataFrame:
    """Units and revenue equal between the source and the built grid: in total, per product, per month; zero rows come from filling."""
    def totals(df):
        return df.groupingSets([[], [F.col("produit_key")], [F.col("mois")]], F.col("produit_key"), F.col("mois")).agg(F.sum("y").alias("y"), F.sum("ca").alias("ca"))
    a = totals(source.withColumn("mois", F.trunc("ds", "month")))
    b = totals(grid.withColumn("mois", F.trunc("ds", "month")))
    keys = [F.coalesce(F.col("produit_key"), F.lit("")).alias("p"), F.coalesce(F.col("mois").cast("string"), F.lit("")).alias("m")]
    both = (a.select(*keys, F.col("y").alias("ya"), F.col("ca").alias("ca_a")).join(b.select(*keys, F.col("y").alias("yb"), F.col("ca").alias("ca_b")), ["p", "m"], "full_outer"))
    same = (F.coalesce("ya", F.lit(0)) == F.coalesce("yb", F.lit(0))) & (F.abs(F.coalesce("ca_a", F.lit(0.0)) - F.coalesce("ca_b", F.lit(0.0))) < 0.01)
    level = F.when((F.col("p") == "") & (F.col("m") == ""), "total").when(F.col("m") == "", "produit").otherwise("mois")
    return both.groupBy(level.alias("niveau")).agg(N().alias("n"), F.count_if(~same).alias("n_ecarts"))


#: Days whose presence the bits of one long tell, and blocks looked at row by row that every task may hold.
BLOCK = 64
MOST_DOUBTFUL = 100_000


def day_block(day: str = "ds") -> Column:
    return F.floor(F.unix_date(day) / BLOCK)


def day_bits(day: str = "ds", where: Column | None = None) -> Column:
    """Aggregate within a block: the days that occur (on rows that meet `where`), as bits of a long."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.unix_date(day), F.lit(BLOCK)))
    return F.coalesce(F.bit_or(bit if where is None else F.when(where, bit)), F.lit(0).cast("long"))


def zero_rows_from_filling(source: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows and zero rows of the grid (joined with its source), defects: zero rows with a source row, rows of repeated keys.

    The grid is added up in blocks of days, whose bits tell whether a key may repeat or a zero row may have a source row. Only the rows
    of such blocks are looked at key by key, so the rows of a sound grid are neither shuffled nor sorted.
    """
    keys, zero, none = ["produit_key", "_block"], F.col("y") == 0, F.lit(0).cast("long")
    rows, facts = grid.withColumn("_block", day_block()), source.filter("ds is not null").select("produit_key", "ds", day_block().alias("_block"))
    sold = facts.groupBy(*keys).agg(day_bits().alias("_sold"), (N() > F.bit_count(day_bits())).alias("_twice"))
    blocks = rows.groupBy(*keys).agg(N().alias("_n"), F.count_if(zero).alias("_z"), F.bit_count(day_bits()).alias("_days"), day_bits(where=zero).alias("_zeros"))
    meets = F.col("_zeros").bitwiseAND(F.coalesce("_sold", none)) != 0
    doubt = meets | F.coalesce("_twice", F.lit(False)) | ((F.col("_n") > F.col("_days")) & (F.col("_n") > 1))
    judged = materialise(blocks.join(sold, keys, "left").withColumn("_doubt", doubt).select(*keys, "_n", "_z", "_doubt"))
    counts = judged.filter("not _doubt").select("_n", "_z", none.alias("_s"), none.alias("_r"))
    doubtful = judged.filter("_doubt").select(*[F.col(k).alias(f"_of{k}") for k in keys])
    n = doubtful.count()
    if n:
        near = rows.join(F.broadcast(doubtful) if n <= MOST_DOUBTFUL else doubtful, F.col("produit_key").eqNullSafe(F.col("_ofproduit_key")) & F.col("_block").eqNullSafe(F.col("_of_block")), "left_semi")
        per_key = near.groupBy("produit_key", "ds").agg(N().alias("_n"), F.count_if(zero).alias("_z"))
        hits = facts.groupBy("produit_key", "ds").agg(N().alias("_h"))
        times = F.coalesce("_h", F.lit(1))
        counts = counts.unionByName(per_key.join(hits, ["produit_key", "ds"], "left").select(
            (F.col("_n") * times).alias("_n"), (F.col("_z") * times).alias("_z"), (F.col("_z") * F.coalesce("_h", none)).alias("_s"),
            F.when(F.col("_n") > 1, F.col("_n")).otherwise(0).alias("_r")))
    total = lambda c: F.coalesce(F.sum(c), none)
    return counts.agg(total("_n").alias("n_lignes"), total("_z").alias("n_zeros"), total("_s").alias("n_zeros_source"), total("_r").alias("n_repetes"))


def distinct_days(df: DataFrame, key: str, day: str = "ds") -> DataFrame:
    """First, last and number of distinct days per key, counted in blocks of days."""
    blocks = df.groupBy(key, day_block(day).alias("_block")).agg(F.min(day).alias("debut"), F.max(day).alias("fin"), F.bit_count(day_bits(day)).alias("_days"))
    return blocks.groupBy(key).agg(F.min("debut").alias("debut"), F.max("fin").alias("fin"), F.sum("_days").cast("long").alias("n_jours"))


def stock_coverage(stock: DataFrame, products: DataFrame, daily: DataFrame) -> DataFrame:
    """Per product: first, last, days and gaps of the stock, offsets to validity and first sale, sales on rupture days."""
    s = distinct_days(stock, "produit_key")
    sold = stock.join(daily.select("produit_key", "ds", "y"), ["produit_key", "ds"])
    out = sold.filter("niveau_stock <= 0").groupBy("produit_key").agg(F.count_if(F.col("y") > 0).alias("_v"))
    first = daily.filter("y > 0").groupBy("produit_key").agg(F.min("ds").alias("_first"))
    return (s.join(products.select("produit_key", "valid_from"), "produit_key", "left").join(first, "produit_key", "left").join(out, "produit_key", "left")
            .select("produit_key", "debut", "fin", "n_jours", (F.datediff("fin", "debut") + 1 - F.col("n_jours")).alias("n_trous"),
                    F.datediff("debut", "valid_from").alias("ecart_validite"), F.datediff("debut", "_first").alias("ecart_premiere_vente"),
                    F.coalesce("_v", F.lit(0)).alias("ventes_en_rupture")))


def pricing_experiment_checks(decisions: DataFrame, stock: DataFrame, promo_days: DataFrame) -> DataFrame:
    """Defect counts of the price journal. `decisions`: decision_id, produit_key, ds, week, eligible, remise_appliquee, prix_base, prix_applique, propensity, stock, impressions."""
    from marketlens.operators.joins import overlaps_promotion
    from marketlens.operators.ordered import asof_before
    seen = asof_before(decisions.select("decision_id", "produit_key", "ds", "stock"), stock.select("produit_key", F.col("ds").alias("_seen"), "niveau_stock"),
                       ["produit_key"], "ds", "_seen", ["niveau_stock"], seconds=86400 * 30)
    implied = F.round(F.col("prix_base") * (1 - F.col("remise_appliquee") / 100), 0)
    per_product = decisions.groupBy("produit_key").agg((F.min("impressions") == F.max("impressions")).alias("flat"))
    one = decisions.agg(
        F.count_if(~F.col("eligible") & (F.col("remise_appliquee") > 0)).alias("remise_sans_eligibilite"),
        F.count_if(~F.col("propensity").between(0, 1) | F.col("propensity").isNull()).alias("propension_hors_domaine"),
        F.count_if(implied != F.col("prix_applique")).alias("prix_incoherent")).select(
        "*", repeated_keys(decisions, ["decision_id"]).alias("decision_repetee"), repeated_keys(decisions, ["produit_key", "week"]).alias("plusieurs_par_semaine"),
        per_product.agg(F.count_if("flat")).scalar().alias("impressions_constantes"),
        seen.agg(F.count_if(~F.col("stock").eqNullSafe(F.col("niveau_stock")))).scalar().alias("stock_pas_de_la_veille"),
        overlaps_promotion(decisions, promo_days).agg(N()).scalar().alias("chevauche_promotion"))
    return as_rows(one, one.columns, "controle", "n_defauts").withColumn("n_defauts", F.col("n_defauts").cast("long"))


def exposure_checks(expo: DataFrame, web: DataFrame, slate_size: int = 5) -> DataFrame:
    """Defect counts of the exposure journal. `expo`: recommendation_id, slate_id, session_id, client_key, anonymous_id, rank, impression_timestamp, probability, added_to_cart, purchased."""
    from marketlens.operators.joins import impressions_outside_session
    slates = expo.groupBy("slate_id").agg(N().alias("n"), F.count_distinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.sum("probability").alias("p"))
    bots = web.filter("est_bot").select("session_id").distinct()
    one = slates.agg(F.count_if(F.col("n") != slate_size).alias("taille_slate"),
                     F.count_if((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n"))).alias("rangs"),
                     F.count_if(F.abs(F.col("p") - 1) > 0.001).alias("somme_softmax")).select(
        "*", repeated_keys(expo, ["recommendation_id"]).alias("id_repete"),
        expo.agg(F.count_if(F.col("client_key").isNotNull() == F.col("anonymous_id").isNotNull())).scalar().alias("identite_exclusive"),
        expo.agg(F.count_if(F.col("purchased") & ~F.col("added_to_cart"))).scalar().alias("achat_sans_panier"),
        expo.join(bots, "session_id", "left_semi").agg(N()).scalar().alias("session_bot"),
        impressions_outside_session(expo, web).agg(N()).scalar().alias("hors_session"))
    return as_rows(one, one.columns, "controle", "n_defauts").withColumn("n_defauts", F.col("n_defauts").cast("long"))


def recommendation_output_checks(recs: DataFrame, k: int, user: str = "client_key", item: str = "produit_key") -> DataFrame:
    """Repeats, non-finite scores, wrong list sizes, broken ranks."""
    per = recs.groupBy(user).agg(N().alias("n"), F.count_distinct(item).alias("items"), F.min("rang").alias("lo"), F.max("rang").alias("hi"), F.count_distinct("rang").alias("ranks"),
                                 F.count_if(F.col("score").isNull() | F.isnan("score")).alias("bad"))
    return per.agg(N().alias("n_listes"), F.count_if(F.col("items") != F.col("n")).alias("repetes"), F.sum("bad").alias("scores_non_finis"), F.count_if(F.col("n") > k).alias("listes_trop_longues"),
                   F.count_if((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("ranks") != F.col("n"))).alias("rangs_non_consecutifs"))


def prediction_checks(preds: DataFrame, expected: DataFrame) -> DataFrame:
    """Per model and window: rows against the expected number, non-finite, negative. `expected`: window, n_expected."""
    bad = F.col("pred").isNull() | F.isnan("pred")
    g = preds.groupBy("model", "window").agg(N().alias("n"), F.count_if(bad).alias("n_non_finis"), F.count_if(F.col("pred") < 0).alias("n_negatifs"))
    return g.join(expected, "window").withColumn("ok", (F.col("n") == F.col("n_expected")) & (F.col("n_non_finis") == 0) & (F.col("n_negatifs") == 0))


def delivery_validation(tables: dict[str, DataFrame], contract: dict) -> DataFrame:
    """Runs the checks a contract asks for and returns them as rows (name, severity, passed).

    contract: required [(table, column)], coverage {table: [(column, min, scope sql or None)]}, unique [(table, columns)],
    foreign_keys [(table, column, dim, dim column)], domains [(table, column, values)]. A check that cannot be
    evaluated (missing table or column, empty scope) fails.
    """
    rows = [(f"required::{t}.{c}", "erreur", t in tables and c in tables[t].columns) for t, c in contract.get("required", [])]
    spark = next(iter(tables.values())).sparkSession
    schema = "name string, severity string, passed boolean"
    parts = [spark.createDataFrame(rows, schema)] if rows else []
    failed = lambda name: spark.createDataFrame([(name, "erreur", False)], schema)
    for table, rules in contract.get("coverage", {}).items():
        for column, minimum, scope in rules:
            name = f"coverage::{table}.{column}"
            if table not in tables or column not in tables[table].columns:
                parts.append(failed(name))
                continue
            c = coverage(tables[table], {column: minimum}, F.expr(scope) if scope else None)
            parts.append(c.select(F.lit(name).alias("name"), F.lit("erreur").alias("severity"), "passed"))
    for table, columns in contract.get("unique", []):
        name = f"unique::{table}({','.join(columns)})"
        if table not in tables or any(c not in tables[table].columns for c in columns):
            parts.append(failed(name))
            continue
        g = tables[table].groupBy(*columns).agg(N().alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("m"))
        parts.append(g.select(F.lit(name).alias("name"), F.lit("erreur").alias("severity"), (F.col("m") <= 1).alias("passed")))
    for table, column, dim, dim_column in contract.get("foreign_keys", []):
        name = f"fk::{table}.{column}"
        if table not in tables or dim not in tables or column not in tables[table].columns:
            parts.append(failed(name))
            continue
        known = tables[dim].select(F.col(dim_column).alias(column)).distinct()
        g = tables[table].filter(F.col(column).isNotNull()).join(known, column, "left_anti").agg(N().alias("n"))
        parts.append(g.select(F.lit(name).alias("name"), F.lit("erreur").alias("severity"), (F.col("n") == 0).alias("passed")))
    for table, column, values in contract.get("domains", []):
        g = tables[table].agg(F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(*values)).alias("n"))
        parts.append(g.select(F.lit(f"domain::{table}.{column}").alias("name"), F.lit("erreur").alias("severity"), (F.col("n") == 0).alias("passed")))
    return union_all(parts)


def delivery_aggregates(web: DataFrame) -> DataFrame:
    return (web.agg(N().alias("n_lignes"), F.count_distinct("event_id").alias("n_ids"), F.count_distinct("session_id").alias("n_sessions"))
            .withColumn("n_doublons", F.col("n_lignes") - F.col("n_ids")))
