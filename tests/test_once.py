"""Work that several steps share is done once."""
import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketlens.catalog.model import Tables
from marketlens.operators.ordered import dealt
from marketlens.plans import pricing as PR
from marketlens.plans import recsys as R

D0 = dt.date(2024, 1, 1)


def small_tables(spark, folder):
    """Three products of two brands, four orders; one line is cancelled, one names no product."""
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    rows = {
        "part": ([(1, "a", "Brand#1", "T", 1, 10.0), (2, "b", "Brand#1", "T", 1, 20.0), (3, "c", "Brand#2", "T", 1, 30.0)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(i, 1, "O", 1.0, day(d), "p") for i, d in ((1, 0), (2, 2), (3, 4), (4, 6))],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(1, 1, 1, 1, 2.0, 20.0, 0.0, 0.0, "N", "O", day(0)), (1, 2, 1, 2, 3.0, 60.0, 0.05, 0.0, "N", "O", day(0)), (2, 3, 1, 1, 1.0, 30.0, 0.1, 0.0, "N", "O", day(2)),
                      (3, 3, 1, 1, 9.0, 90.0, 0.0, 0.0, "A", "O", day(4)), (4, 99, 1, 1, 5.0, 50.0, 0.0, 0.0, "N", "O", day(6))],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                     "l_linestatus string, l_shipdate timestamp"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, str(folder))


def test_brand_days_are_read_from_one_pass_over_the_sales(spark, tmp_path):
    t = small_tables(spark, tmp_path)
    files = t.brand_days.inputFiles() + t.sales_span.inputFiles()
    assert files and not any("lineitem" in f or "orders" in f for f in files)
    sold = {(r["unique_id"], (r["ds"] - D0).days): (r["y"], r["ca"], r["remise_pct"]) for r in t.brand_days.filter("y > 0").collect()}
    assert sold == {("Brand#1", 0): (5, 77.0, 5), ("Brand#2", 2): (1, 27.0, 10)}
    # Cancelled lines and lines without a product sell nothing, but belong to the calendar.
    assert t.brand_days.count() == 2 * 7 and tuple(t.sales_span.first()) == (D0, D0 + dt.timedelta(days=6))


def panel(spark, seen):
    """Rows of four products over 120 days; each evaluation of a row is counted."""
    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rows = [(f"P{p}", D0 + dt.timedelta(days=i), i % 7, "C", f"M{p % 2}", (i + p) % 3 * 5, float(10 + p), float(5 + p), (3 * i + p) % 11 + 1) for i in range(120) for p in range(4)]
    d = spark.createDataFrame(rows, "produit_key string, ds date, dow int, categorie string, marque string, remise_pct int, prix_base double, cout double, y int")
    return d.withColumn("prix_base", counted.asNondeterministic()("prix_base")), len(rows)


@pytest.mark.parametrize("fit", [lambda a, b: PR.fit_volume(a, b, "tweedie"), lambda a, b: PR.fit_volume(a, b, "gbt", None), lambda a, b: PR.arm_learners(a, b, (0, 5, 10))], ids=["tweedie", "gbt", "arms"])
def test_models_compute_their_rows_once(spark, fit):
    seen = spark.sparkContext.accumulator(0)
    train, n = panel(spark, seen)
    test = panel(spark, spark.sparkContext.accumulator(0))[0].limit(20)
    assert fit(train, test).count() in (20, 60)
    assert n <= seen.value <= 2 * n


def test_dealt_rows_come_in_parts_of_bounded_size(spark):
    d = dealt(spark.range(0, 1000, 1, 2), rows=100)
    sizes = d.groupBy(F.spark_partition_id()).count().collect()
    assert d.count() == 1000 and d.agg(F.sum("id")).first()[0] == 499500
    assert len(sizes) == 10 and max(r["count"] for r in sizes) == 100
    same = spark.range(0, 1000, 1, 3)
    assert dealt(same, rows=400).rdd.glom().collect() == same.rdd.glom().collect()
    assert dealt(spark.range(0)).count() == 0


def test_hidden_items_are_ranked_where_their_order_is(spark):
    rng = random.Random(3)
    baskets = [(f"o{i:02}", D0 + dt.timedelta(days=i), rng.sample("abcdefg", rng.randint(1, 4))) for i in range(40)]
    # Item g has two categories, so it comes twice in each order.
    lines = [(o, p, c, d) for o, d, items in baskets for p in items for c in ("x", "y")[:2 if p == "g" else 1]]
    df = spark.createDataFrame(lines, "order_id string, produit_key string, categorie string, ds date")
    out = R.leave_one_out(df, k=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(order_id#\d+, (dst|target|window)", plan)

    window = {r["order_id"]: r["window"] for r in R.order_windows(df).collect()}
    held = {o: Counter({p: 2 if p == "g" else 1 for p in items}) for o, _, items in baskets if o in window}
    co = Counter()
    for row in R.basket_statistics(df)["cooccurrence"].collect():
        for a, b in ((row["a"], row["b"]), (row["b"], row["a"])):
            co[row["window"], a, b] += row["n_commandes"]
    want = []
    for o, items in held.items():
        for target, copies in items.items():
            found = []
            for dst in "abcdefg":
                if dst in items and dst != target:
                    continue
                sources = [(src, co[window[o], src, dst]) for src in items.elements() if co[window[o], src, dst]]
                own = [n for src, n in sources if src == target] or [None]
                rows = [(sum(n for _, n in sources) - (x or 0), len(sources) - (x is not None)) for x in own]
                found += [(-c, dst, n) for c, n in rows if c > 0 for _ in range(copies * (copies if dst == target else 1))]
            want += [(o, target, dst, -c, n) for c, dst, n in sorted(found)[:3]]
    got = [tuple(r) for r in out.select("order_id", "target", "candidat", "cooccurrence", "n_sources").collect()]
    assert sorted(got) == sorted(want) and len(got) > 50
