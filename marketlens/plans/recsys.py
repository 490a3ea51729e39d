"""Recommendation: popularity, similarity, content, fusion inputs, profiles, slates, audits.

Matrices stay in long form (user, item, value). Similarities add up the pairs of items of a user with `pair_totals`,
which splits very long histories over tasks and sends pairs as lists; `coded` numbers the items, so that these are short.
"""
from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalar import ratio
from marketlens.operators import joins as J
from marketlens.operators.filters import eligible_web_history
from marketlens.operators.ordered import forget, materialise
from marketlens.operators.windows import codes
from marketlens.plans.factors import best_items



def N() -> Column:
    return F.count(F.lit(1))



def normalised(df: DataFrame, column: str = "score") -> DataFrame:
    """Score over its overall maximum."""
    return df.withColumn(column, ratio(F.col(column), df.agg(F.max(column)).scalar()))


def popularity(sales: DataFrame, since: Column | None = None) -> DataFrame:
    """Distinct buyers per product over the maximum; optionally only sales after `since` (exclusive)."""
    lines = sales.filter(F.col("ds") > since) if since is not None else sales
    return normalised(lines.groupBy("produit_key").agg(F.count_distinct("client_key").cast("double").alias("score")))


def favourite_category(sales: DataFrame) -> DataFrame:
    """Category with most lines per client (ties: smallest)."""
    counts = sales.groupBy("client_key", "categorie").agg(N().alias("_n"))
    return counts.groupBy("client_key").agg(F.min(F.struct(-F.col("_n"), "categorie")).getField("categorie").alias("favorite"))


def popularity_by_category(sales: DataFrame, candidates: DataFrame) -> DataFrame:
    """Popularity inside the favourite category for its products, 0.1 x overall popularity for the others.

    `sales` carries categorie; `candidates`: client_key, produit_key.
    """
    buyers = sales.groupBy("produit_key", "categorie").agg(F.count_distinct("client_key").cast("double").alias("_b"))
    top = buyers.groupBy("categorie").agg(F.max("_b").alias("_bc"))
    overall = buyers.agg(F.max("_b")).scalar()
    items = buyers.join(top, "categorie").select("produit_key", "categorie", ratio("_b", "_bc").alias("_in"), ratio(F.col("_b"), overall).alias("_all"))
    d = candidates.join(items, "produit_key", "left").join(favourite_category(sales), "client_key", "left")
    own = F.col("favorite") == F.col("categorie")
    score = F.when(F.col("favorite").isNull(), F.col("_all")).when(own, F.col("_in")).otherwise(0.1 * F.col("_all"))
    return d.select("client_key", "produit_key", F.coalesce(score, F.lit(0.0)).alias("score"))


def coded(matrix: DataFrame, item: str = "produit_key") -> tuple[DataFrame, DataFrame]:
    """A matrix with its items numbered in sorted order, from 0, and the numbers (item, _code); rows without item are left out. Both are written once."""
    m = materialise(matrix)
    names = materialise(codes(m, item, "_code"))
    numbered = materialise(m.join(names, item).withColumn(item, F.col("_code")).drop("_code"))
    forget(m)
    return numbered, names


def named(df: DataFrame, names: DataFrame, column: str, item: str = "produit_key") -> DataFrame:
    """Items instead of their numbers in a column."""
    back = names.select(F.col("_code").alias(column), F.col(item).alias("_item"))
    return df.join(back, column).select(*[F.col("_item").alias(c) if c == column else c for c in df.columns])


def unit_rows(matrix: DataFrame, user: str, item: str, value: str) -> DataFrame:
    """Values over the norm of their item, as _u."""
    norms = matrix.groupBy(item).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_n"))
    return matrix.join(norms, item).select(user, item, ratio(value, "_n").alias("_u"))


def cosine(matrix: DataFrame, user: str = "client_key", item: str = "produit_key", value: str = "v") -> DataFrame:
    """Item-item cosine of a long matrix, zero diagonal; pairs a < b, dealt by a."""
    return J.pair_totals(unit_rows(matrix, user, item, value), user, item, {"sim": F.sum(F.col("_u_a") * F.col("_u_b"))}, ["_u"])


def cosine_lists(matrix: DataFrame, of: DataFrame | None = None, user: str = "client_key", item: str = "produit_key", value: str = "v") -> DataFrame:
    """Item-item cosine in both directions as lists: a, b, sim; `of` (item): only for these items as a."""
    return J.pair_lists(unit_rows(matrix, user, item, value), user, item, {"sim": F.sum(F.col("_u_a") * F.col("_u_b"))}, ["_u"], of=of)


def binary_matrix(sales: DataFrame) -> DataFrame:
    return sales.select("client_key", "produit_key").distinct().withColumn("v", F.lit(1.0))


def item_item_scores(matrix: DataFrame, lists: DataFrame) -> DataFrame:
    """Mean similarity of each item to the items a user owns, over the user's best. `lists`: those of `cosine_lists`, which go to the users and are added up there."""
    known = matrix.filter(F.col("client_key").isNotNull())
    met = known.select("client_key", F.col("produit_key").alias("a")).join(lists, "a").select("client_key", "b", "sim")
    owned = known.select("client_key", F.lit(None).cast(met.schema["b"].dataType).alias("b"), F.lit(None).cast("array<double>").alias("sim"))
    cells = dealt_by(met.unionByName(owned), "client_key").select("client_key", F.inline_outer(F.arrays_zip("b", "sim")))
    sums = cells.groupBy("client_key", F.col("b").alias("produit_key")).agg(F.sum("sim").alias("_s"), N().alias("_k"))
    w = Window.partitionBy("client_key")
    raw = sums.withColumn("_s", F.col("_s") / F.max(F.when(F.col("produit_key").isNull(), F.col("_k"))).over(w)).withColumn("_m", F.max("_s").over(w))
    return raw.filter(F.col("produit_key").isNotNull()).select("client_key", "produit_key", ratio("_s", "_m").alias("score"))


def association_lift(sales: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """Joint buyers over the product of buyers by the number of users; pairs a < b, of the items of `matrix` (binary, of the sales) if given."""
    m = binary_matrix(sales) if matrix is None else matrix
    users = sales.agg(F.count_distinct("client_key")).scalar()
    pop = m.groupBy("produit_key").agg(N().alias("_p"))
    totals = {"co": N(), "_pa": F.max("_p_a"), "_pb": F.max("_p_b")}
    co = J.pair_totals(m.join(pop, "produit_key"), "client_key", "produit_key", totals, ["_p"])
    return co.select("a", "b", "co", ratio(F.col("co") * users, F.col("_pa") * F.col("_pb")).alias("lift"))


def content_score(sales: DataFrame, web: DataFrame, products: DataFrame, candidates: DataFrame) -> DataFrame:
    """0.7 x share of the category in the client's purchases (web views without purchase) + 0.3 / (1 + relative price gap)."""
    cat = products.select("produit_key", "categorie", "prix_base")
    bought = sales.join(cat, "produit_key")
    seen = web.filter(F.col("event_type").isin("view", "add_to_cart") & F.col("client_key").isNotNull()).join(cat.join(sales.select("produit_key").distinct(), "produit_key", "left_semi"), "produit_key")

    def shares(lines, name):
        n = lines.groupBy("client_key", "categorie").agg(N().alias("_n"))
        total = n.groupBy("client_key").agg(F.sum("_n").alias("_t"))
        return n.join(total, "client_key").select("client_key", "categorie", ratio("_n", "_t").alias(name)), total.select("client_key", F.lit(True).alias(f"_has{name}"))
    buy, has_buy = shares(bought, "_sb")
    look, has_look = shares(seen, "_sw")
    price = bought.groupBy("client_key").agg(F.avg("prix_base").alias("_ref"))
    d = (candidates.join(cat, "produit_key").join(has_buy, "client_key", "left").join(has_look, "client_key", "left").join(buy, ["client_key", "categorie"], "left")
         .join(look, ["client_key", "categorie"], "left").join(price, "client_key", "left").join(popularity(sales).withColumnRenamed("score", "_pop"), "produit_key", "left"))
    share = F.when(F.col("_has_sb"), F.coalesce("_sb", F.lit(0.0))).when(F.col("_has_sw"), F.coalesce("_sw", F.lit(0.0)))
    gap = F.abs(F.col("prix_base") - F.col("_ref")) / F.greatest("_ref", F.lit(1.0))
    near = F.when(F.col("_ref").isNotNull(), 1 / (1 + gap)).otherwise(0.5)
    return d.select("client_key", "produit_key", F.coalesce(0.7 * share + 0.3 * near, F.col("_pop"), F.lit(0.0)).alias("score"))


def bm25_matrix(matrix: DataFrame, k1: float = 1.2, b: float = 0.75, user: str = "client_key", item: str = "produit_key", value: str = "v") -> DataFrame:
    """BM25 weights of a user x item matrix: users are documents, items are terms, idf never negative."""
    sizes = matrix.groupBy(user).agg(F.sum(value).alias("_len"))
    stats = sizes.agg(F.struct(F.avg("_len").alias("avg"), N().alias("n"))).scalar()
    df = matrix.groupBy(item).agg(N().alias("_df"))
    d = matrix.join(sizes, user).join(df, item).withColumn("_st", stats)
    idf = F.greatest(F.log((F.col("_st.n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(0.0))
    tf = F.col(value) * (k1 + 1) / (F.col(value) + k1 * (1 - b + b * F.col("_len") / F.col("_st.avg")))
    return d.select(user, item, (idf * tf).alias(value))


def implicit_factors(inter: DataFrame, rank: int = 8, iterations: int = 5, k: int = 10, user: str = "client_key", item: str = "produit_key", value: str = "v") -> DataFrame:
    """Latent factor recommendations from implicit feedback (alternating least squares)."""
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.recommendation import ALS
    ui = StringIndexer(inputCol=user, outputCol="_u", stringOrderType="alphabetAsc").fit(inter)
    ii = StringIndexer(inputCol=item, outputCol="_i", stringOrderType="alphabetAsc").fit(inter)
    coded = ii.transform(ui.transform(inter))
    model = ALS(userCol="_u", itemCol="_i", ratingCol=value, implicitPrefs=True, rank=rank, maxIter=iterations, seed=42, coldStartStrategy="drop").fit(coded)
    recs = best_items(model.userFactors, model.itemFactors, k).select(F.col("id").alias("_u"), F.posexplode(F.arrays_zip("ids", "scores")).alias("rang", "r"))
    users, items = coded.select(user, "_u").distinct(), coded.select(item, "_i").distinct()
    return (recs.select(F.col("_u").cast("double").alias("_u"), (F.col("rang") + 1).alias("rang"), F.col("r.ids").cast("double").alias("_i"), F.col("r.scores").alias("score"))
            .join(users, "_u").join(items, "_i").select(user, item, "rang", "score"))


def hybrid_matrix(sales: DataFrame, inter: DataFrame, cutoff: Column, web_weight: float = 0.2) -> DataFrame:
    """Purchases plus a fraction of the web weight per (client, product), all before the cutoff; web purchases are left out, as the sales hold them."""
    buys = sales.filter(F.col("ds").cast("timestamp") < cutoff).select("client_key", "produit_key", F.lit(1.0).alias("v"))
    web = eligible_web_history(inter, cutoff).select(F.col("identite").alias("client_key"), "produit_key", (F.col("poids_total") * web_weight).alias("v"))
    return buys.unionByName(web).groupBy("client_key", "produit_key").agg(F.sum("v").alias("v"))


WINDOWS = 4


def order_windows(lines: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """(order_id, window) of orders with several items: `windows` blocks of dates with about as many orders each.

    An order belongs to the block of its first date, and a date to one block, so all orders of earlier blocks are strictly earlier.
    """
    orders = lines.groupBy("order_id").agg(F.min("ds").alias("ds"), F.count_distinct("produit_key").alias("_k")).filter("_k >= 2")
    days = orders.groupBy("ds").agg(N().alias("_n"))  # one row per calendar day
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("ds")) - F.col("_n")
    total = F.sum("_n").over(Window.partitionBy(F.lit(0)))
    return orders.join(days.select("ds", (F.floor(before * windows / total) + 1).cast("int").alias("window")), "ds").select("order_id", "window")


def windowed_items(lines: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """Items of each order with several ones, with its window; what has windows already stays as it is."""
    return lines if "window" in lines.columns else lines.select("order_id", "produit_key", "categorie").distinct().join(order_windows(lines, windows), "order_id")


def basket_statistics(lines: DataFrame, windows: int = WINDOWS) -> dict[str, DataFrame]:
    """Co-occurrence (a < b), popularity and category popularity for each window, learned on the orders of earlier windows only.

    The first window has none. Each window is counted once; its counts then go to all later ones.
    """
    items = lines if "window" in lines.columns else materialise(windowed_items(lines, windows))
    pairs = J.pair_rows(items.select("order_id", "produit_key", "window"), "order_id", "produit_key", carry=("window",))

    def later(counted: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        d = counted.filter(F.col("_w") < windows).select(*keys, "_n", F.explode(F.sequence(F.col("_w") + 1, F.lit(windows))).alias("window"))
        return d.groupBy("window", *keys).agg(F.sum("_n").alias(name))

    def counts(d: DataFrame, window: str, keys: Sequence[str], name: str) -> DataFrame:
        return later(d.groupBy(F.col(window).alias("_w"), *keys).agg(N().alias("_n")), keys, name)

    return {"cooccurrence": counts(pairs, "window_a", ["a", "b"], "n_commandes"), "popularity": counts(items, "window", ["produit_key"], "pop"),
            "category": counts(items, "window", ["categorie", "produit_key"], "cpop")}


def neighbours(stats: DataFrame, value: str) -> DataFrame:
    """Both directions of windowed pairs: window, src, dst, value."""
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return stats.select("window", F.inline(ways), value)


def packed_neighbours(stats: dict[str, DataFrame], part_size: int = 256) -> DataFrame:
    """Neighbours of each windowed item in lists of about `part_size`, a list a column: window, src, dst, n, pop.

    They go up by popularity, count and neighbour, so that equal values stand side by side and shuffled lists are small.
    """
    pop = stats["popularity"].select("window", F.col("produit_key").alias("dst"), "pop")
    known = neighbours(stats["cooccurrence"], "n_commandes").join(pop, ["window", "dst"], "left")
    parts = F.ceil(N().over(Window.partitionBy("window", "src")) / part_size)
    cell = F.struct("pop", F.col("n_commandes").alias("n"), "dst")
    lists = known.withColumn("_part", F.pmod(F.xxhash64("dst"), parts)).groupBy("window", "src", "_part").agg(F.array_sort(F.collect_list(cell)).alias("_l"))
    return lists.select("window", "src", *[F.col(f"_l.{c}").alias(c) for c in LIST])


#: Columns of a neighbour in `packed_neighbours`.
LIST = ("dst", "n", "pop")


def neighbour_lists(stats: dict[str, DataFrame], part_size: int = 256) -> DataFrame:
    """The same as one list of (dst, n, pop): window, src, liste."""
    return packed_neighbours(stats, part_size).select("window", "src", F.arrays_zip(*LIST).alias("liste"))


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key over many tasks, so that what is laid out afterwards stays small in each and needs no other shuffle."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def complement_cells(context: DataFrame, stats: dict[str, DataFrame], without: DataFrame | None = None) -> DataFrame:
    """Co-occurrence and popularity of the neighbours of a context: order_id, window, produit_key, cooccurrence, pop; dealt by order."""
    lists = context.select("order_id", "window", F.col("produit_key").alias("src")).distinct().join(materialise(packed_neighbours(stats)), ["window", "src"]).select("order_id", "window", *LIST)
    if without is not None:
        none = F.array(F.lit(None).cast("bigint"))
        lists = lists.unionByName(without.select("order_id", "window", F.array("produit_key").alias("dst"), none.alias("n"), none.alias("pop")))
    cells = dealt_by(lists, "order_id").select("order_id", "window", F.inline(F.arrays_zip(*LIST)))
    return (cells.groupBy("order_id", "window", F.col("dst").alias("produit_key"))
            .agg(F.sum("n").cast("double").alias("cooccurrence"), F.max("pop").alias("pop"), F.bool_or(F.col("n").isNull()).alias("_mark")).filter("not _mark").drop("_mark"))


def with_ratios(cells: DataFrame) -> DataFrame:
    """Adds what BM25 and lift make of the co-occurrence."""
    return cells.withColumns({"bm25": F.col("cooccurrence") / (1 + F.log1p(F.coalesce("pop", F.lit(0)).cast("double"))), "lift": F.col("cooccurrence") / F.greatest(F.coalesce("pop", F.lit(0)), F.lit(1))})


def complement_scores(context: DataFrame, stats: dict[str, DataFrame], context_categories: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """Scores of every generator for a context (order_id, window, produit_key): nothing but the context can be passed in.

    Columns: cooccurrence, bm25, lift and, when categories are given, category popularity. Contexts of the first window get no rows;
    items `without` (order_id, window, produit_key) get none either. Lists of neighbours go to the orders and are laid out there;
    they are written first, so that the shuffle files of the counts are gone by then. Numbers as items (`coded`) make short lists.
    """
    d = with_ratios(complement_cells(context, stats, without)).drop("pop")
    if context_categories is None:
        return d
    cat = (context_categories.select("order_id", "window", "categorie").distinct().join(stats["category"], ["window", "categorie"]).groupBy("order_id", "window", "produit_key").agg(F.sum("cpop").cast("double").alias("categorie_contexte")))
    return d.join(cat, ["order_id", "window", "produit_key"], "full_outer")


GENERATORS = ("cooccurrence", "bm25", "lift", "categorie_contexte", "popularite")


def leaders(scored: DataFrame, keys: Sequence[str], score: Column, most: int, name: str) -> DataFrame:
    """The `most` first items (produit_key, pop) of each group by score, then popularity, then item, as one list of (s, p, item) in that order."""
    cell = F.struct((-F.round(score, 9)).alias("s"), (-F.coalesce("pop", F.lit(0))).alias("p"), F.col("produit_key").alias("item"))
    first = scored.select(*keys, cell.alias("_c")).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_c"))).filter(F.col("_r") <= most)
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list("_c")).alias(name))


def missing(cells: Column, *items: Column) -> Column:
    """Cells whose item is in none of the lists of items."""
    return F.filter(cells, lambda c: ~functools.reduce(lambda a, b: a | b, [F.array_contains(i, c["item"]) for i in items]))


def candidate_ranks(context: DataFrame, stats: dict[str, DataFrame], k: int = 50) -> DataFrame:
    """Top k of each generator per context, without the context's own items, in the order of their ranks: order_id, window, model, liste.

    Only positive scores rank; the remaining places go to the most popular other items, and popularity, then the item, breaks ties.
    Category popularity is that of a set of categories, which many contexts share: it is ranked once for each window and set. A context lacks k of the k + (items of
    the context) first items of its set, and as many popular ones, so these alone go to the orders, where each list is made in the task that holds the order.
    """
    orders = materialise(context.groupBy("order_id", "window").agg(F.collect_set("produit_key").alias("_held"), F.array_sort(F.collect_set("categorie")).alias("_cats")))
    most = k + (orders.agg(F.max(F.size("_held"))).first()[0] or 0)
    popular = leaders(stats["popularity"], ["window"], F.lit(0.0), most, "_popular")
    sets = orders.select("window", "_cats").distinct().withColumn("categorie", F.explode("_cats"))
    in_sets = sets.join(stats["category"], ["window", "categorie"]).groupBy("window", "_cats", "produit_key").agg(F.sum("cpop").cast("double").alias("_s"))
    by_set = leaders(in_sets.join(stats["popularity"], ["window", "produit_key"], "left"), ["window", "_cats"], F.col("_s"), most, "_lead")
    lead = orders.join(by_set, ["window", "_cats"], "left").select("order_id", "window", "_held", F.slice(missing(F.coalesce("_lead", F.array().cast(by_set.schema["_lead"].dataType)), F.col("_held")), 1, k).alias("categorie_contexte"))
    # One row a window: at most k and the items of the largest context.
    base = lead.join(F.broadcast(popular), "window").withColumn("popularite", missing(F.col("_popular"), F.col("_held"))).drop("_popular", "_held")
    cells = with_ratios(complement_cells(context, stats, context))
    cell = lambda g: F.struct((-F.round(F.col(g), 9)).alias("s"), (-F.coalesce("pop", F.lit(0))).alias("p"), F.col("produit_key").alias("item"))
    scored = GENERATORS[:3]
    near = cells.groupBy("order_id").agg(*[F.collect_list(F.when(F.col(g) > 0, cell(g))).alias(g) for g in scored])
    none = {g: F.coalesce(g, F.array().cast(near.schema[g].dataType)) for g in scored}
    d = base.join(near, "order_id", "left").withColumns(none)

    def first(g: str) -> Column:
        own = F.array_sort(F.col(g)) if g in scored else F.col(g)
        if g == "popularite":
            return F.slice(own["item"], 1, k)
        filled = F.when(F.size(g) >= k, own).otherwise(F.array_sort(F.concat(own, missing(F.col("popularite"), F.col(g)["item"]))))
        return F.slice(filled["item"], 1, k)
    return d.select("order_id", "window", F.explode(F.array(*[F.struct(F.lit(g).alias("model"), first(g).alias("liste")) for g in GENERATORS])).alias("_m")).select("order_id", "window", "_m.*")


def fused_candidates(ranks: DataFrame, k: int = 50, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of the generators' completed lists, as the model `rrf`."""
    lists = ranks.groupBy("order_id", "window").agg(F.collect_list("liste").alias("_lists")).withColumn("_items", F.array_distinct(F.flatten("_lists")))
    places = lambda x: F.transform("_lists", lambda l: F.array_position(l, x))
    total = lambda x: F.aggregate(places(x), F.lit(0.0), lambda a, p: a + F.when(p > 0, 1 / (constant + p)).otherwise(0.0))
    cells = F.array_sort(F.transform("_items", lambda x: F.struct((-F.round(total(x), 9)).alias("s"), x.alias("item"))))
    return lists.select("order_id", "window", F.lit("rrf").alias("model"), F.slice(cells["item"], 1, k).alias("liste"))


def candidate_recall(targets: DataFrame, ranks: DataFrame, ks: Sequence[int] = (20, 50), models: Sequence[str] = (*GENERATORS, "rrf")) -> DataFrame:
    """Share of hidden items (order_id, window, target) among the first k candidates by window and model; the first window, without earlier orders, is not evaluable."""
    asked = targets.withColumn("model", F.explode(F.lit(list(models))))
    place = ranks.select("order_id", "model", "liste")
    hit = asked.join(place, ["order_id", "model"], "left").withColumn("rang", F.nullif(F.array_position("liste", F.col("target")), F.lit(0)))
    share = [F.avg(F.coalesce(F.col("rang") <= k, F.lit(False)).cast("int")).alias(f"recall_{k}") for k in ks]
    return hit.groupBy("window", "model").agg(N().alias("n"), *share).withColumn("evaluable", F.col("window") > 1)


def masked_target(lines: DataFrame) -> DataFrame:
    """First item in sorted order of each order with several items; the others are the context."""
    items = lines.select("order_id", "produit_key").distinct()
    return items.groupBy("order_id").agg(F.min("produit_key").alias("target"), N().alias("n_items")).filter("n_items >= 2")


def masked_context(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """Items of each order but the hidden one, with the order's window where lines have dates (or windows)."""
    dated = "ds" in lines.columns or "window" in lines.columns
    items = windowed_items(lines) if dated else lines.select("order_id", "produit_key", "categorie").distinct()
    return items.join(targets.select("order_id", "target"), "order_id").filter("produit_key <> target").select("order_id", *(["window"] if dated else []), "produit_key", "categorie")


def user_cooccurrence(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """Sum of co-purchases between the history and each candidate; popularity for users without any."""
    m = history.select("client_key", "produit_key").distinct()
    owned, names = coded(m)
    asked = candidates.join(names, "produit_key").select("client_key", "produit_key", F.col("_code").alias("a"))
    co = J.pair_totals(owned, "client_key", "produit_key", {"n": N()}, of=asked.select(F.col("a").alias("produit_key")))
    s = asked.join(owned.select("client_key", F.col("produit_key").alias("b")), "client_key").join(co, ["a", "b"])
    sums = s.groupBy("client_key", "produit_key").agg(F.sum("n").alias("_n"))
    pop = m.groupBy("produit_key").agg(N().alias("_pop"))
    known = m.select("client_key").distinct().withColumn("_k", F.lit(True))
    d = candidates.join(sums, ["client_key", "produit_key"], "left").join(known, "client_key", "left").join(pop, "produit_key", "left")
    return d.select("client_key", "produit_key", F.when(F.col("_k"), F.coalesce("_n", F.lit(0))).otherwise(F.coalesce("_pop", F.lit(0))).cast("double").alias("score"))


def blended_scores(a: DataFrame, b: DataFrame, weight: float = 0.6, keys: Sequence[str] = ("client_key", "produit_key")) -> DataFrame:
    """Min-max normalised scores per user, weight x a + (1 - weight) x b."""
    def norm(d, name):
        lim = d.groupBy(keys[0]).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        return d.join(lim, keys[0]).select(*keys, F.coalesce(ratio(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)).alias(name))
    d = norm(a, "_a").join(norm(b, "_b"), list(keys), "full_outer")
    return d.select(*keys, (weight * F.coalesce("_a", F.lit(0.0)) + (1 - weight) * F.coalesce("_b", F.lit(0.0))).alias("score"))


def category_mean_popularity(sales: DataFrame) -> DataFrame:
    """Mean units per product of a category."""
    per = sales.groupBy("categorie", "produit_key").agg(F.sum("quantite").alias("_q"))
    return per.groupBy("categorie").agg(F.avg("_q").alias("score"))


ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)


def regularised_popularity(overall: DataFrame, recent: DataFrame, alpha: float) -> DataFrame:
    d = overall.select("produit_key", F.col("score").alias("_g")).join(recent.select("produit_key", F.col("score").alias("_r")), "produit_key", "left")
    return d.select("produit_key", (alpha * F.col("_g") + (1 - alpha) * F.coalesce("_r", F.lit(0.0))).alias("score"))


def choose_on_past(scores: DataFrame, option: str, value: str, default) -> DataFrame:
    """Option with the best mean value over strictly earlier windows; the default for the first. `scores`: window, option, value."""
    windows = scores.select(F.col("window").alias("_for")).distinct()
    past = scores.join(F.broadcast(windows), F.col("window") < F.col("_for")).groupBy("_for", option).agg(F.avg(value).alias("_m"))
    best = past.groupBy("_for").agg(F.min(F.struct(-F.round("_m", 10), F.col(option))).getField(option).alias("choix"))
    return windows.join(best, "_for", "left").select(F.col("_for").alias("window"), F.coalesce("choix", F.lit(default)).alias("choix"))


def client_profiles(lines: DataFrame, min_purchases: int = 3, min_categories: int = 2, share: float = 0.6) -> DataFrame:
    """Dominant categories covering 60 % of a client's lines, and whether the profile is usable."""
    n = lines.groupBy("client_key", "categorie").agg(N().alias("_n"))
    w = Window.partitionBy("client_key").orderBy(F.desc("_n"), "categorie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = n.groupBy("client_key").agg(F.sum("_n").alias("n_achats"), N().alias("n_categories"))
    d = n.join(total, "client_key").withColumn("_cum", F.sum("_n").over(w) / F.col("n_achats"))
    dominant = F.col("_cum") - F.col("_n") / F.col("n_achats") < share - 1e-12
    p = d.groupBy("client_key", "n_achats", "n_categories").agg(F.count_if(dominant).alias("_nd"), F.array_sort(F.collect_list(F.when(dominant, F.col("categorie")))).alias("_cats"))
    few, narrow = F.col("n_achats") < min_purchases, F.col("n_categories") < min_categories
    diffuse = (F.col("_nd") >= F.col("n_categories")) & (F.col("n_categories") > 2)
    reason = F.when(few, "moins_de_3_achats").when(narrow, "moins_de_2_categories").when(diffuse, "profil_trop_diffus")
    return p.select("client_key", "n_achats", "n_categories", reason.isNull().alias("eligible"), reason.alias("raison"), F.when(reason.isNull(), F.concat_ws("|", "_cats")).otherwise("").alias("dominantes"))


def candidate_policy(candidates: DataFrame, purchased: DataFrame | None = None, available: DataFrame | None = None) -> DataFrame:
    """Candidates without already bought items and / or only with stock."""
    out = candidates
    if purchased is not None:
        out = out.join(purchased.select("client_key", "produit_key").distinct(), ["client_key", "produit_key"], "left_anti")
    if available is not None:
        out = out.join(available.filter("disponible").select("produit_key"), "produit_key", "left_semi")
    return out


def score_with_fallback(candidates: DataFrame, chain: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """First model of the chain that scores the client at all; the model used is the reason."""
    d = candidates
    score, model = F.lit(None).cast("double"), F.lit(None).cast("string")
    for i, (name, s) in reversed(list(enumerate(chain))):
        keyed = "client_key" in s.columns
        on = ["client_key", "produit_key"] if keyed else ["produit_key"]
        d = d.join(s.select(*on, F.col("score").alias(f"_s{i}")), on, "left")
        if keyed:
            d = d.join(s.select("client_key").distinct().withColumn(f"_k{i}", F.lit(True)), "client_key", "left")
        usable = F.col(f"_k{i}") if keyed else F.lit(True)
        score = F.when(usable, F.coalesce(f"_s{i}", F.lit(0.0))).otherwise(score)
        model = F.when(usable, F.lit(name)).otherwise(model)
    return d.select("client_key", "produit_key", score.alias("score"), model.alias("modele"))


def ranker_features(candidates: DataFrame, sales: DataFrame, products: DataFrame, stock: DataFrame, cutoff: Column) -> DataFrame:
    """Popularity, category affinity, recency, stock, price and margin of each candidate, before the cutoff."""
    past = sales.filter(F.col("ds") < cutoff)
    info = products.select("produit_key", "categorie", "prix_base", (F.col("prix_base") - F.col("cout")).alias("marge"))
    affinity = past.join(products.select("produit_key", "categorie"), "produit_key").groupBy("client_key", "categorie").agg(N().alias("_aff"))
    last = past.groupBy("client_key").agg(F.datediff(cutoff, F.max("ds")).alias("_rec"), N().alias("_freq"))
    pop = past.groupBy("produit_key").agg(F.sum("quantite").alias("_pop"))
    level = J.stock_available_at(stock, cutoff).select("produit_key", "niveau_stock")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (candidates.join(info, "produit_key").join(affinity, ["client_key", "categorie"], "left").join(last, "client_key", "left").join(pop, "produit_key", "left").join(level, "produit_key", "left")
            .select("client_key", "produit_key", zero("_pop").alias("popularite"), zero("_aff").alias("affinite"), F.coalesce("_rec", F.lit(9999)).alias("recence"), zero("_freq").alias("frequence"),
                    zero("niveau_stock").alias("stock"), "prix_base", "marge"))


def pointwise_ranker(train: DataFrame, score: DataFrame, columns: Sequence[str], label: str = "y") -> DataFrame:
    """Probability of the action as rank score (stands in for list-wise rankers, which MLlib does not have)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from marketlens.plans.forecast import assemble
    model = GBTClassifier(labelCol=label, featuresCol="features", maxIter=8, maxDepth=3, seed=42).fit(assemble(train, columns, label))
    return model.transform(assemble(score.withColumn(label, F.lit(0)), columns, label)).withColumn("score", vector_to_array("probability")[1]).drop("features", "probability", "rawPrediction", "prediction")


def weekly_popularity(sales: DataFrame, products: DataFrame, sessions: DataFrame) -> DataFrame:
    """Units of the four weeks before each session week, per product (sparse: only products sold).

    Every sale week feeds the four weeks after it, so no dense product x week grid is built.
    """
    sold = sales.groupBy("produit_key", F.trunc("ds", "week").alias("_w")).agg(F.sum("quantite").alias("_q"))
    fed = sold.withColumn("wk", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.date_add(F.col("_w"), i * 7))))
    weeks = sessions.select("wk").distinct()
    return fed.join(F.broadcast(weeks), "wk", "left_semi").groupBy("wk", "produit_key").agg(F.sum("_q").alias("pop"))


def weekly_slates(web: DataFrame, sales: DataFrame, products: DataFrame, group: Column, k: int = 5) -> DataFrame:
    """Session start = impression; popularity slate for control, client-category affinity before popularity for treatment.

    Only products launched before the impression compete. The slate of a control session is that of its week, so
    it is ranked once per week; treated sessions rank the leading products of their client's categories.
    """
    clean = web.join(web.filter("est_bot").select("session_id").distinct(), "session_id", "left_anti")
    meta = (clean.groupBy("session_id").agg(F.min("event_timestamp").alias("impression_timestamp"), F.min("client_key").alias("client_key"), F.min("anonymous_id").alias("anonymous_id"))
            .withColumn("wk", F.trunc(F.to_date("impression_timestamp"), "week").cast("date")).withColumn("groupe", group))
    pop = weekly_popularity(sales, products, meta)
    launched = products.select("produit_key", "categorie", "valid_from")
    base = pop.join(launched, "produit_key")
    depth = Window.partitionBy("wk").orderBy(F.desc("pop"), "produit_key")
    lead = base.withColumn("_r", F.row_number().over(depth))
    late = lead.filter(F.col("valid_from") >= F.col("wk")).groupBy("wk").agg(N().alias("_late"))
    room = lead.join(late, "wk", "left").filter(F.col("_r") <= k + F.coalesce("_late", F.lit(0)))
    control = meta.filter("groupe = 'controle'").join(room, "wk").filter(F.col("valid_from").cast("timestamp") < F.col("impression_timestamp")).withColumn("score", F.col("pop").cast("double"))
    by_cat = Window.partitionBy("wk", "categorie").orderBy(F.desc("pop"), "produit_key")
    leaders = base.withColumn("_r", F.row_number().over(by_cat))
    late_c = leaders.filter(F.col("valid_from") >= F.col("wk")).groupBy("wk", "categorie").agg(N().alias("_late"))
    room_c = leaders.join(late_c, ["wk", "categorie"], "left").filter(F.col("_r") <= k + F.coalesce("_late", F.lit(0)))
    treated = meta.filter("groupe <> 'controle'")
    bought = sales.join(launched.select("produit_key", "categorie"), "produit_key").groupBy("client_key", "categorie", F.trunc("ds", "week").alias("_w")).agg(N().alias("_n"))
    fed = bought.withColumn("wk", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.date_add(F.col("_w"), i * 7))))
    aff = fed.groupBy("client_key", "categorie", "wk").agg(F.sum("_n").alias("_aff"))
    chal = (treated.join(room_c, "wk").join(aff, ["client_key", "categorie", "wk"], "left").filter(F.col("valid_from").cast("timestamp") < F.col("impression_timestamp"))
            .withColumn("score", F.coalesce("_aff", F.lit(0)) * F.lit(100000.0) + F.col("pop")))
    cols = ["session_id", "client_key", "anonymous_id", "impression_timestamp", "groupe", "produit_key", "score"]
    w = Window.partitionBy("session_id").orderBy(F.desc("score"), "produit_key")
    ranked = control.select(*cols).unionByName(chal.select(*cols)).withColumn("rang", F.row_number().over(w)).filter(F.col("rang") <= k)
    slate = Window.partitionBy("session_id")  # at most k rows
    ex = F.exp(F.col("score") - F.max("score").over(slate))
    shown = ranked.withColumn("_e", ex).withColumn("probability", F.col("_e") / F.sum("_e").over(slate)).drop("_e")
    first = clean.groupBy("session_id", "produit_key").agg(*[F.min(F.when(F.col("event_type") == e, F.col("event_timestamp"))).alias(f"_{e}") for e in ("view", "add_to_cart", "purchase")])
    out = shown.join(first, ["session_id", "produit_key"], "left")
    return out.withColumns({f"{n}_after": F.coalesce(F.col(f"_{e}") > F.col("impression_timestamp"), F.lit(False)) for e, n in (("view", "viewed"), ("add_to_cart", "added"), ("purchase", "purchased"))}) \
        .drop("_view", "_add_to_cart", "_purchase")


def recall_of(candidates: DataFrame, truth: DataFrame, keys: Sequence[str] = ("client_key",), item: str = "produit_key") -> DataFrame:
    """Mean share of true items found among the candidates, over keys that have a truth."""
    t = truth.select(*keys, item).distinct()
    hit = t.join(candidates.select(*keys, item).distinct().withColumn("_h", F.lit(1)), [*keys, item], "left")
    return hit.groupBy(*keys).agg(ratio(F.count("_h"), N()).alias("_r")).agg(F.avg("_r").alias("recall"), N().alias("n"))


def session_to_purchase(web: DataFrame, matrix: DataFrame, k: int = 10) -> DataFrame:
    """For each session with a purchase: products seen before the first one score the others by sums of their similarity in `matrix` (client, product)."""
    buys = web.filter("event_type = 'purchase'").groupBy("session_id").agg(F.min(F.struct("event_timestamp", "event_id", "produit_key")).alias("_p"))
    target = buys.select("session_id", F.col("_p.event_timestamp").alias("_t"), F.col("_p.produit_key").alias("target"))
    context = materialise(web.join(target, "session_id").filter((F.col("event_timestamp") < F.col("_t")) & (F.col("event_type") != "purchase")).select("session_id", "target", F.col("produit_key").alias("src")).distinct())
    seen = context.groupBy("session_id", "target").agg(N().alias("n_contexte"), F.bool_or(F.col("src") == F.col("target")).alias("deja_vu"))
    owned, names = coded(matrix)
    asked = context.withColumnRenamed("src", "produit_key").join(names, "produit_key").select("session_id", F.col("_code").alias("a"))
    lists = asked.join(cosine_lists(owned, asked.select(F.col("a").alias("produit_key"))), "a").select("session_id", "b", "sim")
    scored = dealt_by(lists, "session_id").select("session_id", F.inline(F.arrays_zip("b", "sim"))).groupBy("session_id", "b").agg(F.sum("sim").alias("score"))
    w = Window.partitionBy("session_id").orderBy(F.desc(F.round("score", 9)), "b")  # numbers go up with the items
    top = named(scored.withColumn("rang", F.row_number().over(w)).filter(F.col("rang") <= k).select("session_id", F.col("b").alias("produit_key"), "rang"), names.withColumnRenamed("produit_key", "_name"), "produit_key", "_name")
    hit = top.join(target.select("session_id", "target"), "session_id").filter(F.col("produit_key") == F.col("target")).select("session_id", F.col("rang").alias("rang_cible"))
    return seen.join(hit, "session_id", "left").withColumn("hit", F.col("rang_cible").isNotNull())


def excluded_target_reasons(targets: DataFrame, purchased: DataFrame, available: DataFrame, products: DataFrame, cutoff: Column) -> DataFrame:
    """Why a test target was not a candidate: unknown, not yet available, already bought, no stock; NULL if it was one."""
    d = (targets.join(products.select("produit_key", "valid_from"), "produit_key", "left").join(purchased.select("client_key", "produit_key").distinct().withColumn("_b", F.lit(True)), ["client_key", "produit_key"], "left")
         .join(available.select("produit_key", "disponible"), "produit_key", "left"))
    why = (F.when(F.col("valid_from").isNull(), "produit_inconnu").when(F.col("valid_from") > cutoff, "pas_encore_disponible").when(F.col("_b"), "deja_achete")
           .when(~F.coalesce("disponible", F.lit(False)), "sans_stock"))
    return d.select("client_key", "produit_key", why.alias("raison"))


def target_coverage(targets: DataFrame, policies: dict[str, DataFrame]) -> DataFrame:
    """Share of targets among the candidates of each policy (client_key + produit_key, or produit_key only)."""
    t = targets.select("client_key", "produit_key").distinct()
    out = None
    for name, c in policies.items():
        on = [x for x in ("client_key", "produit_key") if x in c.columns]
        hit = t.join(c.select(*on).distinct().withColumn("_h", F.lit(1)), on, "left").agg(ratio(F.count("_h"), N()).alias("couverture"), N().alias("n_cibles")).withColumn("politique", F.lit(name))
        out = hit if out is None else out.unionByName(hit)
    return out


def repurchase_rate(train: DataFrame, test: DataFrame) -> DataFrame:
    """Share of test (client, product) pairs the client had already bought."""
    return target_coverage(test, {"rachat": train}).select(F.col("couverture").alias("taux_rachat"), "n_cibles")


def leave_one_out(lines: DataFrame, k: int = 50) -> DataFrame:
    """Every item of an order hidden in turn; candidates come from co-occurrence with the other items in earlier windows.

    Features of a candidate use the context only: co-occurrence, bm25, lift, popularity and context items that point to it. Lists of neighbours go
    to the orders, and all that follows stays in the task that holds the order.
    """
    items = lines if "window" in lines.columns else materialise(windowed_items(lines))
    multi = items.select("order_id", "window", F.col("produit_key").alias("src"))
    lists = multi.join(materialise(packed_neighbours(basket_statistics(items))), ["window", "src"]).select("order_id", "window", "src", *LIST)
    cells = dealt_by(lists, "order_id").select("order_id", "window", "src", F.inline(F.arrays_zip(*LIST)))
    per = cells.groupBy("order_id", "window", "dst").agg(F.sum("n").alias("_all"), N().alias("_sources"), F.max("pop").alias("pop"), F.collect_list(F.struct("src", "n")).alias("_from"))
    held = multi.groupBy("order_id").agg(F.collect_list(F.struct(F.col("src").alias("target"))).alias("_held"))
    # A candidate that the order holds counts for its own hiding only; an item that comes several times is hidden as often.
    times = F.size(F.filter("_held", lambda h: h["target"] == F.col("dst")))
    own = F.transform(F.filter("_from", lambda f: f["src"] == F.col("target")), lambda f: f["n"])
    d = per.join(held, "order_id").withColumn("target", F.explode(F.when(times == 0, F.col("_held")).otherwise(F.array_repeat(F.struct(F.col("dst").alias("target")), times * times))))
    d = d.select("order_id", "window", "dst", "_all", "_sources", "pop", "_from", "target.target").select("*", F.explode_outer(own).alias("_own"))
    d = d.select("order_id", "window", "target", "dst", "pop", (F.col("_all") - F.coalesce("_own", F.lit(0))).alias("cooccurrence"), (F.col("_sources") - F.col("_own").isNotNull().cast("int")).alias("n_sources"))
    w = Window.partitionBy("order_id", "target").orderBy(F.desc("cooccurrence"), "dst")
    d = d.filter("cooccurrence > 0").withColumn("rang", F.row_number().over(w)).filter(F.col("rang") <= k)
    n = F.col("cooccurrence").cast("double")
    return d.select("order_id", "window", "target", F.col("dst").alias("candidat"), "cooccurrence", (n / (1 + F.log1p(F.col("pop").cast("double")))).alias("bm25"), (n / F.greatest("pop", F.lit(1))).alias("lift"),
                    "pop", "n_sources", "rang", (F.col("dst") == F.col("target")).cast("int").alias("label"))
