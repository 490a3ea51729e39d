"""Top-k lists, fusion and re-ranking. Ranks are cut with row_number <= k, which Spark also applies before the shuffle."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalar import ratio


def top_k(scores: DataFrame, k: int, exclude: DataFrame | None = None, user: str = "client_key", item: str = "produit_key") -> DataFrame:
    """Best k finite scores per user (ties by item), after removing excluded (user, item) pairs."""
    kept = scores.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    if exclude is not None:
        kept = kept.join(exclude.select(user, item).distinct(), [user, item], "left_anti")
    w = Window.partitionBy(user).orderBy(F.desc("score"), item)
    return kept.withColumn("rang", F.row_number().over(w)).filter(F.col("rang") <= k)


def tiebreak(item: str, seed: int = 42) -> Column:
    """Fixed order of items that does not follow their names."""
    return F.xxhash64(F.col(item), F.lit(seed))


def rank_with_fallback(scores: DataFrame, contexts: DataFrame, popularity: DataFrame, k: int, context_items: DataFrame | None = None,
                       ctx: str = "order_id", item: str = "produit_key", tie: Column | None = None) -> DataFrame:
    """Positive scores first (ties by popularity, then a fixed order), remaining places by overall popularity.

    The fallback of any context can only use the first k + (context size + scored items) popular products that
    are not excluded, so each context meets a popularity prefix of exactly the length it may need.
    """
    tie = tie if tie is not None else tiebreak(item)
    pop = popularity.select(item, F.col("score").alias("_pop"))
    scored = scores.filter("score > 0")
    if context_items is not None:
        scored = scored.join(context_items.select(ctx, item), [ctx, item], "left_anti")
    w = Window.partitionBy(ctx).orderBy(F.desc("score"), F.desc("_pop"), tie)
    ranked = (scored.join(pop, item, "left").na.fill(0, ["_pop"]).withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= k)
              .select(ctx, item, "score", F.lit(0).alias("_tier"), F.col("_p").cast("long").alias("_p")))
    have = ranked.groupBy(ctx).agg(F.count(F.lit(1)).alias("_have"))
    sizes = contexts.select(ctx).distinct().join(have, ctx, "left").na.fill(0, ["_have"])
    if context_items is not None:
        sizes = sizes.join(context_items.groupBy(ctx).agg(F.count(F.lit(1)).alias("_ctx")), ctx, "left").na.fill(0, ["_ctx"])
    else:
        sizes = sizes.withColumn("_ctx", F.lit(0))
    need = sizes.filter(F.col("_have") < k).withColumn("_len", F.lit(k) + F.col("_ctx"))
    places = need.withColumn("_p", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_len").cast("long")))).select(ctx, "_p")
    from marketlens.operators.ordered import running_totals
    order = running_totals(pop.withColumn("_tie", tie), [], [-F.col("_pop"), F.col("_tie")], {"_p": F.lit(1)}).select(item, F.col("_p").cast("long").alias("_p"))
    deepest = need.agg(F.max("_len")).scalar()
    fill = places.join(order.filter(F.col("_p") <= deepest), "_p").select(ctx, item, F.lit(0.0).alias("score"), F.lit(1).alias("_tier"), "_p")
    if context_items is not None:
        fill = fill.join(context_items.select(ctx, item), [ctx, item], "left_anti")
    fill = fill.join(ranked.select(ctx, item), [ctx, item], "left_anti")
    final = Window.partitionBy(ctx).orderBy("_tier", "_p")
    return (ranked.unionByName(fill).withColumn("rang", F.row_number().over(final)).filter(F.col("rang") <= k)
            .select(ctx, item, "score", "rang"))


def rerank_diversity(ranked: DataFrame, exposure: DataFrame, k: int = 10, max_per_category: int = 3, min_categories: int = 4,
                     threshold: float = 0.30, strength: float = 0.5, user: str = "client_key", item: str = "produit_key") -> DataFrame:
    """Scores damped for over-exposed items, at most 3 per category, at least 4 categories, then filled up.

    Everything is ranks: the greedy pass is "first k among the first 3 of each category", the forced entry is the
    best leader of an absent category taking the last place, the fill is the remaining order.
    """
    over = F.coalesce(F.col("exposure"), F.lit(0.0)) - threshold
    damped = F.when(over > 0, F.col("score") * (1 - strength * over / (1 - threshold))).otherwise(F.col("score"))
    pen = ranked.join(exposure.select(item, "exposure"), item, "left").withColumn("score", damped).drop("exposure")
    by_user = Window.partitionBy(user).orderBy(F.desc("score"), item)
    by_cat = Window.partitionBy(user, "categorie").orderBy(F.desc("score"), item)
    pen = pen.withColumn("_r", F.row_number().over(by_user)).withColumn("_c", F.row_number().over(by_cat))
    greedy = Window.partitionBy(user, F.col("_c") <= max_per_category).orderBy("_r")
    pen = pen.withColumn("_s", F.when(F.col("_c") <= max_per_category, F.row_number().over(greedy)))
    pen = pen.withColumn("_in", F.coalesce(F.col("_s") <= k, F.lit(False)))
    leaders = Window.partitionBy(user, (F.col("_c") == 1) & ~F.col("_in")).orderBy("_r")
    pen = pen.withColumn("_l", F.when((F.col("_c") == 1) & ~F.col("_in"), F.row_number().over(leaders)))
    facts = pen.groupBy(user).agg(F.count_if("_in").alias("_n"), F.count_if(F.col("_in") & (F.col("_c") == 1)).alias("_cats"),
                                  F.max("_l").alias("_maxl"))
    forced = F.least(F.greatest(F.lit(min_categories) - F.col("_cats"), F.lit(0)), F.coalesce(F.col("_maxl"), F.lit(0)))
    pen = pen.join(facts, user).withColumn("_forced", forced)
    place = (F.when(F.col("_in") & ((F.col("_forced") == 0) | (F.col("_s") < F.least("_n", F.lit(k)))), F.col("_s"))
             .when((F.col("_forced") > 0) & (F.col("_l") == F.col("_forced")), F.least("_n", F.lit(k)))
             .when(~F.col("_in"), F.col("_r") + k))
    final = Window.partitionBy(user).orderBy("_place")
    return (pen.withColumn("_place", place).filter("_place is not null").withColumn("rang", F.row_number().over(final))
            .filter(F.col("rang") <= k).select(user, item, "categorie", "score", "rang"))


MIXES = {"10/0": (10, 0), "5/5": (5, 5), "7/3": (7, 3)}


def mix_recommendation(base: DataFrame, preferred: DataFrame, eligible: DataFrame, mix: str, k: int = 10,
                       user: str = "client_key", item: str = "produit_key") -> DataFrame:
    """First places from the base list, then the preferred-category list, then the base again, without repeats.

    `base`, `preferred`: user, item, rang. Users that are not eligible keep the base list.
    """
    n_base, _ = MIXES[mix]
    ok = eligible.select(user).distinct().withColumn("_ok", F.lit(True))
    b = base.join(ok, user, "left")
    tiers = (b.select(user, item, F.when(F.col("_ok").isNull() | (F.col("rang") <= n_base), 0).otherwise(2).alias("_t"), "rang",
                      F.when(F.col("_ok").isNotNull(), "personnalise").otherwise("repli_v1").alias("source"))
             .unionByName(preferred.join(ok, user, "left_semi").select(user, item, F.lit(1).alias("_t"), "rang", F.lit("personnalise").alias("source"))))
    best = tiers.groupBy(user, item).agg(F.min(F.struct("_t", "rang")).alias("_p"), F.min("source").alias("source"))
    w = Window.partitionBy(user).orderBy("_p", item)
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(user, item, F.col("place").alias("rang"), "source")


def popularity_top(popularity: DataFrame, k: int, eligible: DataFrame | None = None, excluded: DataFrame | None = None, item: str = "produit_key") -> DataFrame:
    """First k of a popularity table inside a pool and outside an exclusion list."""
    out = popularity
    if eligible is not None:
        out = out.join(eligible.select(item), item, "left_semi")
    if excluded is not None:
        out = out.join(excluded.select(item), item, "left_anti")
    return out.orderBy(F.desc("score"), item).limit(k)


def recent_sales(lines: DataFrame, k: int = 200) -> DataFrame:
    return lines.orderBy(F.desc("ds"), "vente_id", "produit_key", "quantite", "montant_net").limit(k)


def stock_ascending(stock: DataFrame, k: int) -> DataFrame:
    latest = stock.groupBy("produit_key").agg(F.max_by("niveau_stock", "ds").alias("niveau_stock"))
    return latest.orderBy("niveau_stock", "produit_key").limit(k)


def client_list(status: DataFrame, k: int) -> DataFrame:
    """Clients at risk first: status, then idle days and revenue, descending."""
    order = F.when(F.col("statut") == "churn", 0).when(F.col("statut") == "inactif", 1).when(F.col("statut") == "vip", 2).otherwise(3)
    return status.orderBy(order, F.desc("jours_inactif"), F.desc("ca_total"), "client_key").limit(k)


def rrf(lists: Sequence[DataFrame], k: int = 60, user: str = "client_key", item: str = "produit_key", tie: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum over generators of 1 / (k + rank). Each list: user, item, score."""
    tie = tie if tie is not None else F.col(item)
    w = Window.partitionBy(user).orderBy(F.desc("score"), tie)
    parts = [d.select(user, item, F.row_number().over(w).alias("_rank")) for d in lists]
    return (reduce(DataFrame.unionByName, parts).groupBy(user, item)
            .agg(F.sum(F.lit(1.0) / (F.col("_rank") + k)).alias("score"), F.count(F.lit(1)).alias("n_sources")))


def candidate_union(sources: dict[str, DataFrame], per_source: int = 50, keep: int = 50, user: str = "client_key", item: str = "produit_key") -> DataFrame:
    """Union of the best candidates of each source, scored by the sum of 1 / rank; per-source scores kept."""
    w = Window.partitionBy(user).orderBy(F.desc("score"), item)
    parts = [d.select(user, item, "score").withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= per_source)
             .select(user, item, F.lit(name).alias("_src"), (F.lit(1.0) / F.col("_rank")).alias("_s")) for name, d in sources.items()]
    g = (reduce(DataFrame.unionByName, parts).groupBy(user, item)
         .agg(F.sum("_s").alias("score"), F.count(F.lit(1)).alias("n_sources"),
              *[F.max(F.when(F.col("_src") == n, F.col("_s"))).alias(f"score_{n}") for n in sources]))
    order = Window.partitionBy(user).orderBy(F.desc(F.round("score", 9)), item)
    return g.withColumn("rang", F.row_number().over(order)).filter(F.col("rang") <= keep)


# ---------------------------------------------------------------- sets

def union_dates(*frames: DataFrame) -> DataFrame:
    """First and last day over several facts (`ds`)."""
    days = reduce(DataFrame.union, [f.select("ds").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi")) for f in frames])
    return days.agg(F.min("lo").alias("debut"), F.max("hi").alias("fin"))


def union_scopes(*calendars: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), calendars)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a declared order, chosen with partial aggregation."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest] if c not in keys])


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def set_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def list_hits(recommended: Column, target: Column) -> Column:
    return F.size(F.array_intersect(recommended, target))


def exposure_share(lists: DataFrame, user: str = "client_key", item: str = "produit_key") -> DataFrame:
    """Share of users an item is shown to."""
    users = lists.agg(F.count_distinct(user)).scalar()
    return lists.groupBy(item).agg(F.count_distinct(user).alias("_n")).select(item, ratio("_n", users).alias("exposure"))
