"""Key resolution, interval, as-of and counting joins."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.scalar import ratio
from marketlens.operators.grids import explode_days
from marketlens.operators.ordered import asof_before, prefix_at


def days(n: int) -> Column:
    return F.expr(f"interval {n} days")


def resolve_surrogate_keys(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins natural -> surrogate for each (dimension, natural id, surrogate key)."""
    out = fact
    for dim, natural, key in dims:
        out = out.join(dim.select(natural, key), natural, "left")
    return out


def star_join(sales: DataFrame, dates: DataFrame, products: DataFrame, promotions: DataFrame) -> DataFrame:
    """Inner on date and product, left on promotion; a missing discount counts 0."""
    return (sales.drop("remise_pct").join(dates.select("ds"), "ds").join(products.select("produit_key", "categorie", "marque"), "produit_key")
            .join(promotions.select("promo_key", F.col("remise_pct").alias("_pct")), "promo_key", "left")
            .withColumn("remise_pct", F.coalesce("_pct", F.lit(0))).drop("_pct"))


def promotion_products(promotions: DataFrame, products: DataFrame, scope_map: dict[str, str] | None = None) -> DataFrame:
    """(promotion, product) pairs: each scope joined on the product attribute it targets."""
    out = None
    for scope, attribute in (scope_map or {"product": "product_id", "category": "categorie"}).items():
        part = (promotions.filter(F.col("portee") == scope)
                .join(products.select("produit_key", F.col(attribute).alias("cible")), "cible")
                .select("produit_key", "promo_key", "portee", "remise_pct", "date_debut", "date_fin"))
        out = part if out is None else out.unionByName(part)
    return out


def expand_promotions(promotions: DataFrame, products: DataFrame, scope_map: dict[str, str] | None = None) -> DataFrame:
    """One row per product, day and applicable promotion over its closed window.

    Pairs are dealt by product before the days: sums by product and day then need no shuffle of the days.
    """
    tasks = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = promotion_products(promotions, products, scope_map).repartition(tasks, "produit_key")
    return explode_days(pairs, F.col("date_debut"), F.col("date_fin")).select("produit_key", "ds", "promo_key", "remise_pct", "portee")


def overlaps_promotion(decisions: DataFrame, promo_days: DataFrame, day: str = "ds", span_days: int = 7,
                       negate: bool = False) -> DataFrame:
    """Decisions whose closed window [day, day + span] meets (or avoids) a promotion of their product.

    The window is laid out as days and met with promotion days by an equi join, so no range pairs are formed.
    """
    wanted = explode_days(decisions.select("produit_key", day).distinct(), F.col(day), F.date_add(day, span_days), "_day")
    busy = promo_days.select("produit_key", F.col("ds").alias("_day")).distinct()
    hit = wanted.join(busy, ["produit_key", "_day"], "left_semi").select("produit_key", day).distinct()
    return decisions.join(hit, ["produit_key", day], "left_anti" if negate else "left_semi")


def overlap_count(episodes: DataFrame, key: str = "produit_key", start: str = "date_debut", end: str = "date_fin") -> DataFrame:
    """Campaigns of the same product overlapping each one, itself included.

    Overlapping = started on or before its end, minus ended before its start: two running counts, no pairs.
    """
    starts = counts_before(episodes.withColumn("_e", F.date_add(end, 1)), episodes, [key], "_e", start, {"_n_started": F.lit(1)})
    both = counts_before(starts, episodes, [key], start, end, {"_n_ended": F.lit(1)})
    return (both.withColumn("overlap_count", F.col("_n_started") - F.col("_n_ended"))
            .withColumn("overlap_status", F.when(F.col("overlap_count") > 1, "overlap").otherwise("non_overlapping"))
            .drop("_e", "_n_started", "_n_ended"))


#: Slice for facts with one instant a day: a key has at most so many rows in a slice.
HALF_YEAR = 180 * 86400


def counts_before(left: DataFrame, facts: DataFrame, keys: Sequence[str], ts: str, fact_ts: str,
                  measures: dict[str, Column], trailing: dict[str, int] | None = None, seconds: int = 86400) -> DataFrame:
    """Adds sums of facts strictly before `ts`; `trailing` adds `<measure>_<suffix>` over [ts - days, ts).

    Rows with a NULL key or without earlier facts get 0. All instants that are asked for share one pass of running sums, over slices of
    `seconds`, and come back in one row per key and instant.
    """
    slots = {"": 0, **{f"_{suffix}": n for suffix, n in (trailing or {}).items()}}
    named = facts.select(*keys, F.col(fact_ts).cast("timestamp").alias("_t"), *[c.alias(n) for n, c in measures.items()])
    at = left.withColumn("_t", F.col(ts).cast("timestamp"))
    known = at.filter(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys, "_t").distinct()
    instants = F.array(*[F.struct(F.lit(i).alias("slot"), (F.col("_t") - days(n)).alias("at")) for i, n in enumerate(slots.values())])
    asked = known.select(*keys, "_t", F.explode(instants).alias("_a")).select(*keys, "_t", "_a.slot", "_a.at")
    sums = prefix_at(named, asked.select(*keys, F.col("at").alias("_t")), keys, "_t", {n: F.col(n) for n in measures}, seconds)
    found = asked.join(sums.withColumnRenamed("_t", "at"), [*keys, "at"], "left")
    wide = found.groupBy(*keys, "_t").agg(*[F.max(F.when(F.col("slot") == i, F.col(m))).alias(f"_{i}_{m}") for m in measures for i in range(len(slots))])
    out = at.join(wide, [*keys, "_t"], "left")
    value = {(i, m): F.coalesce(f"_{i}_{m}", F.lit(0)) for m in measures for i in range(len(slots))}
    added = {f"{m}{suffix}": value[0, m] if not i else value[0, m] - value[i, m] for i, suffix in enumerate(slots) for m in measures}
    return out.withColumns(added).drop("_t", *[f"_{i}_{m}" for i, m in value])


def stock_available_at(stock: DataFrame, cutoff: Column) -> DataFrame:
    """Last known level on or before the cutoff; available when above 0."""
    return (stock.filter(F.col("ds") <= cutoff).groupBy("produit_key")
            .agg(F.max_by("niveau_stock", "ds").alias("niveau_stock"))
            .withColumn("disponible", F.col("niveau_stock") > 0))


def client_history_asof(exposures: DataFrame, purchases: DataFrame, ts: str = "impression_timestamp") -> DataFrame:
    """Purchase count, recency (9999 if none), 90-day frequency and same-category count strictly before the impression."""
    counted = counts_before(exposures, purchases, ["client_key"], ts, "ds", {"n_achats": F.lit(1)}, {"90j": 90}, HALF_YEAR)
    by_cat = counts_before(counted, purchases, ["client_key", "categorie"], ts, "ds", {"affinite_categorie": F.lit(1)}, seconds=HALF_YEAR)
    last = asof_before(by_cat, purchases.select("client_key", F.col("ds").cast("timestamp").alias("_bought")),
                       ["client_key"], ts, "_bought", [], seconds=HALF_YEAR)
    age = (F.unix_micros(ts) - F.unix_micros("_bought")) / F.lit(86400000000.0)
    known = F.col("client_key").isNotNull() & F.col("_bought").isNotNull()
    return last.withColumn("recence_jours", F.when(known, age).otherwise(9999.0)).drop("_bought")


def product_popularity_asof(exposures: DataFrame, purchases: DataFrame, ts: str = "impression_timestamp") -> DataFrame:
    """Units sold before the impression, in total and over the previous 28 days."""
    return counts_before(exposures, purchases, ["produit_key"], ts, "ds", {"popularite": F.col("quantite")}, {"28j": 28}, HALF_YEAR)


def session_context(exposures: DataFrame, web: DataFrame, columns: Sequence[str] = ("appareil", "source_trafic", "canal")) -> DataFrame:
    """Most frequent device, source and channel of the non-robot session (ties: smallest), 'inconnu' if none.

    Values are counted before the winner is taken, so a long session costs its distinct values.
    """
    clean = web.filter(~F.coalesce("est_bot", F.lit(False)))
    counts = (clean.unpivot(["session_id"], [F.col(c) for c in columns], "what", "v").filter("v is not null")
              .groupBy("session_id", "what", "v").agg(F.count(F.lit(1)).alias("n")))
    modes = (counts.groupBy("session_id").agg(*[
        F.min(F.when(F.col("what") == c, F.struct(-F.col("n"), F.col("v")))).getField("v").alias(c) for c in columns]))
    seen = clean.select("session_id").distinct()
    context = seen.join(modes, "session_id", "left").select("session_id", *[F.coalesce(c, F.lit("inconnu")).alias(c) for c in columns])
    return exposures.join(context, "session_id", "left")


def orphans(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Orphan distinct keys and rows of a reference; NULL is not an orphan. Under 5 % of keys alert, else critical."""
    keys = fact.filter(F.col(fact_key).isNotNull()).groupBy(fact_key).agg(F.count(F.lit(1)).alias("n"))
    known = dim.select(F.col(dim_key).alias(fact_key)).distinct().withColumn("_hit", F.lit(1))
    out = (keys.join(known, fact_key, "left")
           .agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("_hit").isNull()).alias("n_orphan_keys"),
                F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("n"))), F.lit(0)).alias("n_orphan_rows")))
    rate = ratio("n_orphan_keys", "n_keys")
    return out.withColumn("status", F.when(F.col("n_orphan_keys") == 0, "ok").when(rate < 0.05, "alerte").otherwise("critique"))


def web_orders_without_line(web: DataFrame, sales: DataFrame) -> DataFrame:
    return (web.filter("order_id is not null").select("order_id").distinct()
            .join(sales.select("order_id").distinct(), "order_id", "left_anti"))


def reconcile(sales: DataFrame, web: DataFrame, keys: Sequence[str] = ("produit_key", "client_key", "ds")) -> DataFrame:
    """Full outer match of sale lines and web purchases on product, client and day."""
    a = sales.select(*keys).distinct().withColumn("_s", F.lit(1))
    b = web.select(*keys).distinct().withColumn("_w", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    n = both.agg(F.count_if(F.col("_s").isNotNull() & F.col("_w").isNotNull()).alias("n_match"),
                 F.count_if(F.col("_w").isNull()).alias("n_sale_only"), F.count_if(F.col("_s").isNull()).alias("n_purchase_only"))
    return (n.withColumn("recall", ratio(F.col("n_match"), F.col("n_match") + F.col("n_sale_only")))
            .withColumn("precision", ratio(F.col("n_match"), F.col("n_match") + F.col("n_purchase_only"))))


def order_set_equality(web: DataFrame, sales: DataFrame) -> DataFrame:
    a = web.filter("order_id is not null").select("order_id").distinct().withColumn("_w", F.lit(1))
    b = sales.select("order_id").distinct().withColumn("_s", F.lit(1))
    return (a.join(b, "order_id", "full_outer")
            .agg(F.count_if(F.col("_s").isNull()).alias("only_web"), F.count_if(F.col("_w").isNull()).alias("only_sales"))
            .withColumn("equal", (F.col("only_web") + F.col("only_sales")) == 0))


def pair_rows(baskets: DataFrame, basket: str, item: str, carry: Sequence[str] = (), part_size: int = 256) -> DataFrame:
    """Pairs a < b of items that share a basket, one row per basket and pair, with the carried columns of both sides.

    A basket above `part_size` items is cut into parts by item hash on the left side and met by every part's
    copy of the right side, so that no task holds all pairs of a big basket; results are the same.
    """
    sizes = (baskets.groupBy(basket).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
             .select(basket, F.ceil(F.col("_n") / part_size).cast("int").alias("_parts")))
    sized = baskets.join(sizes, basket)
    left = sized.select(basket, F.pmod(F.xxhash64(item), F.col("_parts")).cast("int").alias("_part"),
                        F.col(item).alias("a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    right = sized.select(basket, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"),
                         F.col(item).alias("b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return left.join(right, [basket, "_part"]).filter("a < b").drop("_part")


def dealt_pairs(baskets: DataFrame, basket: str, item: str, carry: Sequence[str], part_size: int, lists: int, both: bool, of: DataFrame | None) -> DataFrame:
    """Pairs of items that share a basket, a row per basket and pair, dealt by (a, _cut): a, _pop (baskets of a), b, carried columns of both sides.

    Pairs travel as lists: each item of a basket sends the items behind it (`both`: all others), a list a column, to the task that holds
    the item, and pairs are laid out there. A basket above `part_size` items is cut as in `pair_rows`; an item in more than `lists` baskets
    is dealt over several tasks by hash of b. `of` (item) leaves out other items as a. Numbers as items make short lists.
    """
    known = baskets.filter(F.col(basket).isNotNull() & F.col(item).isNotNull())
    sizes = known.groupBy(basket).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select(basket, F.ceil(F.col("_n") / part_size).cast("int").alias("_parts"))
    items = known.groupBy(item).agg(F.count(F.lit(1)).alias("_pop")).withColumns({"_cuts": F.ceil(F.col("_pop") / lists).cast("int"), "_of": F.lit(True)})
    if of is not None:
        items = items.drop("_of").join(of.select(item).distinct().withColumn("_of", F.lit(True)), item, "left")
    sized = known.join(items, item).join(sizes, basket).withColumn("_part", F.pmod(F.xxhash64(item), F.col("_parts")).cast("int"))
    parts = sized.groupBy(basket, "_parts", "_part").agg(F.collect_list(F.struct(F.col(item).alias("x"), "_pop", "_cuts", "_of", *carry)).alias("_cells"))
    left = parts.select(basket, "_part", F.filter("_cells", lambda y: y._of).alias("_left"))
    right = parts.select(basket, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.transform("_cells", lambda y: F.struct(y.x.alias("x"), *[y[c].alias(c) for c in carry])).alias("_right"))
    met = left.filter(F.size("_left") > 0).join(right, [basket, "_part"]).select(F.inline("_left"), "_right")
    cut = met.select("*", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)).alias("_cut"))

    def partner(y):
        kept = y.x != F.col("x") if both else y.x > F.col("x")
        return kept & ((F.col("_cuts") == 1) | (F.pmod(F.xxhash64(y.x), F.col("_cuts")) == F.col("_cut")))
    cut = cut.filter((F.col("_cuts") == 1) | F.exists("_right", partner)).withColumn("_right", F.filter("_right", partner))
    columns = [F.col(f"_right.{c}").alias(f"{c}_b") for c in carry]
    tasks = 4 * int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.select(F.col("x").alias("a"), "_cut", "_pop", *[F.col(c).alias(f"{c}_a") for c in carry], F.col("_right.x").alias("b"), *columns).repartition(tasks, "a", "_cut")
    return dealt.select("a", "_cut", "_pop", *[f"{c}_a" for c in carry], F.inline(F.arrays_zip("b", *[f"{c}_b" for c in carry])))


def pair_totals(baskets: DataFrame, basket: str, item: str, totals: dict[str, Column], carry: Sequence[str] = (), part_size: int = 256, lists: int = 16384,
                of: DataFrame | None = None) -> DataFrame:
    """`totals` over all baskets for each pair a < b of items that share one (with `of`: a from there, any other b): a, b, totals of the carried columns of both sides.

    Added up where `dealt_pairs` lays the pairs out, without another shuffle.
    """
    pairs = dealt_pairs(baskets, basket, item, carry, part_size, lists, of is not None, of)
    return pairs.groupBy("a", "_cut", "b").agg(*[c.alias(n) for n, c in totals.items()]).drop("_cut")


def pair_lists(baskets: DataFrame, basket: str, item: str, totals: dict[str, Column], carry: Sequence[str] = (), part_size: int = 256, lists: int = 16384,
               of: DataFrame | None = None, per_list: int = 64) -> DataFrame:
    """The same for each ordered pair, as lists: a, b and the totals, a list a column; one list of a for each `per_list` baskets that hold it."""
    pairs = dealt_pairs(baskets, basket, item, carry, part_size, lists, True, of)
    added = pairs.groupBy("a", "_cut", "b", F.ceil(F.col("_pop") / per_list).alias("_slots")).agg(*[c.alias(n) for n, c in totals.items()])
    slot = F.pmod(F.xxhash64("b", F.lit(7)), F.col("_slots")).alias("_slot")
    listed = added.groupBy("a", "_cut", slot).agg(F.collect_list(F.struct("b", *totals)).alias("_l"))
    return listed.select("a", *[F.col(f"_l.{c}").alias(c) for c in ("b", *totals)])


def cooccurrence(lines: DataFrame, basket: str = "order_id", item: str = "produit_key", min_support: int = 1) -> DataFrame:
    """Pairs a < b bought in one order, counted per distinct order.

    An item in fewer than `min_support` orders cannot be in a counted pair and is removed before pairing.
    """
    pairs_of = lines.select(basket, item).distinct()
    if min_support > 1:
        frequent = pairs_of.groupBy(item).agg(F.count(F.lit(1)).alias("_s")).filter(F.col("_s") >= min_support).select(item)
        pairs_of = pairs_of.join(frequent, item, "left_semi")
    counted = pair_rows(pairs_of, basket, item).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_commandes"))
    return counted.filter(F.col("n_commandes") >= min_support)


class JoinMismatch(ValueError):
    """A one-to-one join would lose or multiply rows."""


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """One-to-one join; raises when keys repeat or rows have no partner. One aggregate checks both sides."""
    tagged = (left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
              .unionByName(right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r"))))
    per_key = tagged.groupBy(*on).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    bad = per_key.agg(F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("dup"),
                      F.count_if(F.col("l") != F.col("r")).alias("lost")).first()
    if bad["dup"] or (how == "inner" and bad["lost"]):
        raise JoinMismatch(f"{bad['dup']} repeated key(s), {bad['lost']} unmatched key(s)")
    return left.join(right, list(on), how)


def weekday_means(train: DataFrame, value: str = "y") -> tuple[DataFrame, DataFrame, Column]:
    """Means by product x weekday, category x weekday, and overall (scalar)."""
    by_product = train.groupBy("produit_key", "dow").agg(F.avg(value).alias("_m_product"))
    by_category = train.groupBy("categorie", "dow").agg(F.avg(value).alias("_m_category"))
    return by_product, by_category, train.agg(F.avg(value)).scalar()


def fallback_lookup(rows: DataFrame, train: DataFrame, value: str = "y", out: str = "baseline") -> DataFrame:
    """Product x weekday mean, else category x weekday, else overall."""
    by_product, by_category, overall = weekday_means(train, value)
    return (rows.join(by_product, ["produit_key", "dow"], "left").join(by_category, ["categorie", "dow"], "left")
            .withColumn(out, F.coalesce("_m_product", "_m_category", overall)).drop("_m_product", "_m_category"))


def impressions_outside_session(exposures: DataFrame, web: DataFrame, ts: str = "impression_timestamp") -> DataFrame:
    bounds = web.groupBy("session_id").agg(F.min("event_timestamp").alias("lo"), F.max("event_timestamp").alias("hi"))
    return exposures.join(bounds, "session_id").filter(~F.col(ts).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


class UnresolvedDate(ValueError):
    """No usable date was found on the sales."""


def resolve_sale_dates(sales: DataFrame, column: str, dim_date: DataFrame, dim_key: str = "date_key",
                       dim_day: str = "date_complete", min_share: float = 0.95) -> DataFrame:
    """Adds `ds`: the column itself when it is not numeric and parses, else the date dimension's day, else an error."""
    text = F.col(column).cast("string")
    numeric = text.rlike(r"^\d+$")
    parsed = F.to_date(F.try_to_timestamp(text))
    share = sales.agg(F.avg((~numeric & parsed.isNotNull()).cast("int")).alias("s")).first()["s"]
    if share is not None and share > min_share:
        return sales.withColumn("ds", parsed)
    out = (sales.join(dim_date.select(F.col(dim_key).cast("string").alias("_k"), F.to_date(dim_day).alias("ds")),
                      text == F.col("_k"), "left").drop("_k"))
    if out.filter("ds is not null").limit(1).count() == 0:
        raise UnresolvedDate(f"{column} is neither a date nor a key of the date dimension")
    return out


def enrich_sales(sales: DataFrame, key: str, dim: DataFrame, candidates: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Dimension attributes joined on the column that covers the key best; one dimension row per key (smallest)."""
    from marketlens.operators.schema import best_join_column
    found = best_join_column(sales, key, dim, candidates).first()
    if found is None:
        raise JoinMismatch(f"no dimension column covers {key}")
    packed = F.min(F.struct(*attributes)).alias("_a")
    unique = dim.filter(F.col(found["attribute"]).isNotNull()).groupBy(F.col(found["attribute"]).alias("_k")).agg(packed)
    return (sales.join(unique, F.col(key) == F.col("_k"), "left")
            .select(*sales.columns, *[F.col(f"_a.{c}").alias(c) for c in attributes]))
