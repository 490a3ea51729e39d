"""Steps that must not lay out, shuffle or hold more than their input: results against plain ones, and the plans."""
import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators import grids
from marketlens.operators import joins as J
from marketlens.operators import quality as Q
from marketlens.plans import recsys as R

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


SOLD = [("a", 3, 2, 5.0), ("a", 90, None, 1.0), ("a", 91, 1, None), ("b", 0, 1, 1.0), ("c", 120, 4, 4.0), (None, 7, 1, 1.0), ("a", None, 1, 1.0)]


def sold(spark):
    return spark.createDataFrame([(k, None if d is None else day(d), y, c) for k, d, y, c in SOLD], "produit_key string, ds date, y bigint, ca double")


def test_filled_grid_lays_out_days_without_shuffling_them(spark):
    d = sold(spark)
    p = spark.createDataFrame([("a", day(1)), ("a", day(10)), ("b", None), ("c", day(500))], "produit_key string, valid_from date")
    plain = grids.active_grid(d, p).join(d, ["produit_key", "ds"], "left").na.fill(0, ["y"]).na.fill(0.0, ["ca"])
    filled = grids.filled_grid(d, p, {"y": 0, "ca": 0.0})
    assert rows(filled) == rows(plain) and filled.count() > 300
    above = plan(filled).split("Generate")[0]
    assert "Exchange" not in above and "Join" not in above


def test_grid_defects_by_blocks_of_days(spark):
    source = spark.createDataFrame([("a", day(3)), ("a", day(3)), ("a", day(5)), ("b", day(64)), ("c", day(1)), (None, day(1)), ("c", None)], "produit_key string, ds date")
    cells = [("a", 3, 0), ("a", 4, 0), ("a", 5, 2), ("b", 64, 0), ("b", 65, 0), ("b", 65, 1), ("c", 1, 1), ("c", 200, 0), (None, 1, 0), (None, 1, 0), ("c", None, 0), ("c", None, 0), ("d", -70, None)]
    grid = spark.createDataFrame([(k, None if d is None else day(d), y) for k, d, y in cells], "produit_key string, ds date, y bigint")
    j = grid.join(source.withColumn("_s", F.lit(1)), ["produit_key", "ds"], "left")
    zero = F.col("y") == 0
    want = j.agg(F.count("*"), F.count_if(zero), F.count_if(zero & (F.col("_s") == 1))).first()
    repeated = Q.repeated_keys(grid, ["produit_key", "ds"])
    assert tuple(Q.zero_rows_from_filling(source, grid).first()) == (*want, spark.range(1).select(repeated).first()[0])
    sound = grid.filter("produit_key = 'c' and ds is not null")
    assert tuple(Q.zero_rows_from_filling(source, sound).first()) == (2, 1, 0, 0)


def test_distinct_days_keeps_blocks_not_days(spark):
    d = spark.createDataFrame([("a", day(i)) for i in (0, 0, 1, 63, 64, 200, -5)] + [("a", None), ("b", None), (None, day(1))], "produit_key string, ds date")
    got = Q.distinct_days(d, "produit_key")
    assert rows(got) == rows(d.groupBy("produit_key").agg(F.min("ds"), F.max("ds"), F.count_distinct("ds")))
    assert "distinct" not in plan(got)


def test_neighbours_go_to_orders_in_lists(spark):
    baskets = ["ab", "abc", "bcd", "ad", "abcd", "ac"]
    lines = spark.createDataFrame([(f"o{i}", p, p.upper(), day(i)) for i, b in enumerate(baskets) for p in b], "order_id string, produit_key string, categorie string, ds date")
    stats = R.basket_statistics(lines, 2)
    context = spark.createDataFrame([("o3", 2, "a"), ("o3", 2, "b"), ("o4", 2, "c"), ("o5", 1, "a")], "order_id string, window int, produit_key string")
    pairs = R.neighbours(stats["cooccurrence"], "n_commandes")
    plain = (context.withColumnRenamed("produit_key", "src").join(pairs, ["window", "src"]).groupBy("order_id", "window", F.col("dst").alias("produit_key")).agg(F.sum("n_commandes").cast("double").alias("s"))
             .join(stats["popularity"], ["window", "produit_key"]).select("order_id", "window", "produit_key", "s", F.col("s") / (1 + F.log1p("pop")), F.col("s") / F.col("pop")))
    scores = R.complement_scores(context, stats)
    assert rows(scores) == rows(plain) and scores.count() > 3
    assert rows(R.complement_scores(context, stats, without=context)) == rows(plain.join(context, ["order_id", "produit_key"], "left_anti").select(plain.columns))
    assert "Exchange" not in plan(scores).split("Generate")[0].replace("REPARTITION", "")
    cells = R.neighbour_lists(stats, 1)
    assert rows(cells.select("window", "src", F.inline("liste")).select("window", "src", "dst", "n")) == rows(pairs)


def test_pair_totals_travel_as_lists(spark):
    cells = [(f"c{u}", f"p{i:02d}", float(u + i)) for u in range(9) for i in range(12) if (u * 5 + i * 3) % 4] + [("c1", "hot", 2.0), (None, "p01", 1.0), (None, "p02", 1.0), ("c2", None, 1.0), ("c3", "p01", None), ("solo", "p03", 4.0)]
    m = spark.createDataFrame(cells + [(f"d{u}", "hot", 1.0) for u in range(30)] + [(f"d{u}", "p05", 3.0) for u in range(30)], "client_key string, produit_key string, v double")
    totals = {"n": F.count("*"), "d": F.sum(F.col("v_a") * F.col("v_b"))}
    want = rows(J.pair_rows(m, "client_key", "produit_key", ["v"]).groupBy("a", "b").agg(*[c.alias(n) for n, c in totals.items()]))
    for part_size, lists in ((256, 16384), (3, 4), (1, 1)):
        got = J.pair_totals(m, "client_key", "produit_key", totals, ["v"], part_size, lists)
        assert rows(got) == want and len(want) > 60
    assert plan(got).split("arrays_zip")[0].count("Exchange") == 0  # pairs are added up where they are laid out


def test_numbered_items_keep_similarity_and_lift(spark):
    s = spark.createDataFrame([(f"c{u}", f"p{i}") for u in range(7) for i in range(9) if (u * 5 + i * 3) % 4] + [(None, "p1"), ("c1", None), ("c9", None)], "client_key string, produit_key string")
    m, names = R.coded(R.binary_matrix(s))
    pairs = {(a, b): n for a, b, n in J.pair_rows(R.binary_matrix(s), "client_key", "produit_key").groupBy("a", "b").count().collect()}
    pop = {k: n for k, n in s.distinct().groupBy("produit_key").count().collect()}
    sims = {(a, b): v for a, b, v in R.named(R.named(R.cosine(m), names, "a"), names, "b").collect()}
    assert sims.keys() == pairs.keys() and all(abs(sims[k] - pairs[k] / (pop[k[0]] * pop[k[1]]) ** 0.5) < 1e-12 for k in sims)
    users = s.select("client_key").distinct().filter("client_key is not null").count()
    lift = {(a, b): (co, v) for a, b, co, v in R.named(R.named(R.association_lift(s, m), names, "a"), names, "b").collect()}
    assert lift == {k: (n, n * users / (pop[k[0]] * pop[k[1]])) for k, n in pairs.items()}


def both_ways(pairs, *columns):
    return pairs.select("a", "b", *columns).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *columns))


def test_pair_lists_hold_both_directions(spark):
    cells = [(f"c{u}", i) for u in range(9) for i in range(12) if (u * 5 + i * 3) % 4] + [(None, 1), ("c2", None), ("solo", 3)]
    m = spark.createDataFrame(cells + [(f"d{u}", i) for u in range(30) for i in (5, 40)], "client_key string, produit_key int")
    of = spark.createDataFrame([(5,), (5,), (7,), (99,), (None,)], "produit_key int")
    pairs = both_ways(J.pair_rows(m, "client_key", "produit_key").groupBy("a", "b").agg(F.count("*").alias("n")), "n")
    some = pairs.filter("a in (5, 7)")
    for part_size, lists, per_list in ((256, 16384, 64), (3, 4, 2)):
        got = J.pair_lists(m, "client_key", "produit_key", {"n": F.count("*")}, (), part_size, lists, None, per_list)
        assert rows(got.select("a", F.inline(F.arrays_zip("b", "n")))) == rows(pairs)
        assert rows(J.pair_totals(m, "client_key", "produit_key", {"n": F.count("*")}, (), part_size, lists, of)) == rows(some)


def test_scores_by_lists_match_plain_joins(spark):
    s = spark.createDataFrame([(f"c{u}", f"p{i}") for u in range(7) for i in range(9) if (u * 5 + i * 3) % 4] + [(None, "p1"), ("c1", None), ("c9", None), ("c8", "alone")], "client_key string, produit_key string")
    m, names = R.coded(R.binary_matrix(s))
    ways = both_ways(R.cosine(m), "sim")
    raw = m.filter("client_key is not null").withColumnRenamed("produit_key", "a").join(ways, "a").groupBy("client_key", "b").agg(F.sum("sim").alias("s"))
    best = {k: v for k, v in raw.groupBy("client_key").agg(F.max("s")).collect()}
    want = {(c, b): round(v / best[c], 9) for c, b, v in raw.collect()}
    scored = R.item_item_scores(m, R.cosine_lists(m))
    assert {(c, b): round(v, 9) for c, b, v in scored.collect()} == want and len(want) > 50
    below = plan(scored).split("arrays_zip")[0]
    assert "Exchange" not in below and "Join" not in below  # sums, best scores and ranks need no shuffle of scored rows
    asked = spark.createDataFrame([("c1", "p2"), ("c1", "p1"), ("c9", "p3"), ("new", "p3"), ("c0", "nowhere"), ("new", "nowhere"), ("c8", "alone"), ("c0", None)], "client_key string, produit_key string")
    co = both_ways(J.pair_rows(s.distinct(), "client_key", "produit_key").groupBy("a", "b").agg(F.count("*").alias("n")), "n")
    n = {(a, b): k for a, b, k in co.collect()}
    held = {c: [p for x, p in s.distinct().collect() if x == c] for c in ("c0", "c1", "c8", "c9")}
    pop = {p: k for p, k in s.distinct().groupBy("produit_key").count().collect() if p}
    got = {(c, p): v for c, p, v in R.user_cooccurrence(s, asked).collect()}
    assert got == {(c, p): float(sum(n.get((h, p), 0) for h in held[c]) if c in held else pop.get(p, 0)) for c, p in map(tuple, asked.collect())}
