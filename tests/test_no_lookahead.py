"""Changing the future must not change any feature of the past."""
import datetime as dt
import random

from pyspark.sql import functions as F

from marketlens.operators import windows as W
from marketlens.operators.joins import client_history_asof
from marketlens.plans import forecast as P

D0 = dt.date(2024, 1, 1)


def daily(spark, future=0):
    rnd = random.Random(1)
    rows = []
    for p in ("A", "B"):
        for i in range(100):
            y, stock = rnd.choice([0, 0, 3, 8]), rnd.randrange(0, 90)
            if i >= 70:
                y, stock = y + future, stock + future
            rows.append((p, p, D0 + dt.timedelta(days=i), "c", "m", y, float(y), 0, stock, rnd.choice([0, 90]) + (future if i >= 70 else 0), y, y))
    return spark.createDataFrame(rows, "produit_key string, unique_id string, ds date, categorie string, marque string, y int, ca double, remise_pct int, niveau_stock int, "
                                       "quantite_reapprovisionnee int, view int, add_to_cart int")


def past(df, last):
    cut = F.lit(D0 + dt.timedelta(days=last))
    keep = [c for c in df.columns if c not in ("y", "ca", "niveau_stock", "quantite_reapprovisionnee", "view", "add_to_cart", "stock_fin_jour")]
    return sorted(map(str, df.filter(F.col("ds") <= cut).select(*keep).collect()))


def test_shifted_features_do_not_see_today(spark):
    a, b = daily(spark), daily(spark, 50)
    for fn in (lambda d: W.lag_features(d, "produit_key"), lambda d: W.rolling_features(d, "produit_key"), lambda d: W.stock_features(d),
               lambda d: W.daily_history(d, {"y": "sales", "view": "views"}), lambda d: W.prior_mean(d, ["produit_key"], "p", "y")):
        assert past(fn(a), 70) == past(fn(b), 70)  # day 70 itself is already changed


def test_cutoff_features_see_today_but_not_tomorrow(spark):
    a, b = W.cutoff_features(daily(spark), sizes=(7, 28)), W.cutoff_features(daily(spark, 50), sizes=(7, 28))
    assert past(a, 69) == past(b, 69)
    assert past(a, 75) != past(b, 75)


def test_client_history_is_strictly_before(spark):
    buys = spark.createDataFrame([("c", "x", D0), ("c", "x", D0 + dt.timedelta(days=5))], "client_key string, categorie string, ds date")
    at = dt.datetime(2024, 1, 6)  # the instant of the second purchase
    e = spark.createDataFrame([(1, "c", "x", at), (2, None, "x", at), (3, "new", "x", at)], "id int, client_key string, categorie string, impression_timestamp timestamp")
    got = {r["id"]: (r["n_achats"], r["recence_jours"], r["affinite_categorie"]) for r in client_history_asof(e, buys).collect()}
    assert got == {1: (1, 5.0, 1), 2: (0, 9999.0, 0), 3: (0, 9999.0, 0)}


def test_blend_weight_ignores_current_and_later_windows(spark):
    def frame(bump):
        rows = [("s", w, h, 10.0 + (bump if w >= 3 else 0), 10.0 if w == 1 else 0.0, 0.0 if w == 1 else 10.0) for w in (1, 2, 3, 4) for h in range(3)]
        return spark.createDataFrame(rows, "unique_id string, window int, h int, y double, pred_a double, pred_b double")
    pick = lambda d: {r["window"]: r["weight"] for r in P.blend_weights(d).collect()}
    a, b = pick(frame(0)), pick(frame(1000))
    assert a[1] == 0.5 and a[2] == 1.0
    assert {w: a[w] for w in (1, 2, 3)} == {w: b[w] for w in (1, 2, 3)}
