"""Chunked ordered computations against brute force, with one key or value holding most rows."""
import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.operators import ordered as O
from marketlens.operators.joins import cooccurrence, counts_before, overlap_count
from marketlens.operators.windows import session_sequences, sessionize

T0 = dt.datetime(2024, 1, 1)


def events(n, seed=0):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(4)}", T0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 6)), rnd.randrange(1, 5)) for _ in range(n)]


def test_counts_before_is_strict_and_handles_hot_keys(spark):
    facts, probes = events(400, 1), events(150, 2)
    f = spark.createDataFrame(facts, "k string, at timestamp, v int")
    left = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(probes)] + [(999, None, T0)] + [(1000 + i, facts[i][0], facts[i][1]) for i in range(20)], "id int, k string, ts timestamp")
    got = {r["id"]: (r["s"], r["s_2d"]) for r in counts_before(left, f, ["k"], "ts", "at", {"s": F.col("v")}, {"2d": 2}).collect()}
    for r in left.collect():
        mine = [(t, v) for k, t, v in facts if k == r["k"] and t < r["ts"]]
        assert got[r["id"]] == (sum(v for _, v in mine), sum(v for t, v in mine if t >= r["ts"] - dt.timedelta(days=2)))


@pytest.mark.parametrize("inclusive", [False, True])
def test_asof_matches_brute_force(spark, inclusive):
    facts, probes = events(300, 3), events(100, 4)
    right = spark.createDataFrame([(k, t, i) for i, (k, t, _) in enumerate(facts)], "k string, at timestamp, x int")
    left = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(probes)] + [(500 + i, k, t) for i, (k, t, _) in enumerate(facts[:30])], "id int, k string, ts timestamp")
    out = O.asof_before(left, right, ["k"], "ts", "at", ["x"], tie="x", inclusive=inclusive, seconds=3600)
    for r in out.collect():
        best = max(((t, i) for i, (k, t, _) in enumerate(facts) if k == r["k"] and (t <= r["ts"] if inclusive else t < r["ts"])), default=(None, None))
        assert (r["at"], r["x"]) == best


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.one_of(st.just(0.0), st.floats(-100, 100, width=32))), min_size=1, max_size=60))
def test_exact_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in O.exact_quantiles(df, ["g"], "v", {"p10": 0.1, "med": 0.5}).collect()}
    for g in {k for k, _ in rows}:
        vals = [v for k, v in rows if k == g]
        assert got[g]["p10"] == pytest.approx(np.quantile(vals, 0.1), abs=1e-9)
        assert got[g]["med"] == pytest.approx(np.median(vals), abs=1e-9)


def test_range_chunks_split_ties_and_keep_order(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("v"), F.format_string("i%05d", "id").alias("id"))
    cut = O.range_chunks(df, [F.col("v"), F.col("id")], chunks=8)
    stats = cut.groupBy(O.CHUNK).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("v", "id")).alias("lo"), F.max(F.struct("v", "id")).alias("hi")).orderBy(O.CHUNK).collect()
    assert len(stats) >= 7 and max(s["n"] for s in stats) < 1000
    assert all(a["hi"] < b["lo"] for a, b in zip(stats, stats[1:]))
    totals = O.running_totals(df, [], [F.col("v"), F.col("id")], {"pos": F.lit(1)})
    assert [r["pos"] for r in totals.orderBy("v", "id").collect()] == list(range(1, 3001))


def test_cooccurrence_with_a_giant_basket(spark):
    rows = [("big", f"p{i:03d}") for i in range(600)] + [("s1", "p001"), ("s1", "p002"), ("s2", "p002"), ("s2", "p001"), ("s3", "zz")]
    got = cooccurrence(spark.createDataFrame(rows, "order_id string, produit_key string"))
    assert got.count() == 600 * 599 // 2
    assert got.filter("a = 'p001' and b = 'p002'").first()["n_commandes"] == 3
    assert [tuple(r) for r in cooccurrence(spark.createDataFrame(rows, "order_id string, produit_key string"), min_support=2).collect()] == [("p001", "p002", 3)]


def test_overlap_count(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(80):
        start = dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(60))
        rows.append((i, f"p{rnd.randrange(3)}", start, start + dt.timedelta(days=rnd.randrange(10))))
    got = {r["i"]: r["overlap_count"] for r in overlap_count(spark.createDataFrame(rows, "i int, produit_key string, date_debut date, date_fin date")).collect()}
    for i, p, a, b in rows:
        assert got[i] == sum(q == p and c <= b and d >= a for _, q, c, d in rows)


def web_rows(seed=6, n=250):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = "hot" if rnd.random() < 0.7 else f"s{rnd.randrange(5)}"
        out.append((i, s, T0 + dt.timedelta(minutes=rnd.randrange(0, 3000)), rnd.choice(["view", "click", "add_to_cart", "purchase", "error"]), rnd.choice([None, "c1", "c2"]), "an", "p", False, 1))
    return out


WEB = "event_id long, session_id string, event_timestamp timestamp, event_type string, client_key string, anonymous_id string, produit_key string, est_bot boolean, user_id int"


def test_session_ranks_and_gaps_cross_slices(spark):
    rows = web_rows()
    got = {r["event_id"]: r for r in session_sequences(spark.createDataFrame(rows, WEB), seconds=600).collect()}
    for s in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))
        client = next((r[4] for r in mine if r[4]), None)
        for i, r in enumerate(mine):
            g = got[r[0]]
            assert g["rang_evenement"] == i + 1 and g["n_evenements_session"] == len(mine)
            assert g["secondes_depuis_precedent"] == (None if i == 0 else (r[2] - mine[i - 1][2]).total_seconds())
            assert g["identite_effective"] == (client or "an")


def test_sessionize_matches_brute_force(spark):
    rows = web_rows(7)
    got = {r["event_id"]: r["session_no"] for r in sessionize(spark.createDataFrame(rows, WEB), key="session_id", gap_seconds=1800, seconds=3600).collect()}
    for s in {r[1] for r in rows}:
        no, last = 0, None
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0])):
            no += last is None or (r[2] - last).total_seconds() > 1800
            last = r[2]
            assert got[r[0]] == no


def test_surrogate_keys_write_nothing(spark, tmp_path, monkeypatch):
    from marketlens.operators import ordered
    from marketlens.sources import lake
    monkeypatch.setattr(ordered, "materialise", None)
    df = spark.range(5000).select(F.format_string("p%07d", F.pmod(F.col("id") * 7919, F.lit(5000))).alias("product_id"))
    got = {r.product_id: r.cle for r in lake.surrogate_keys(df, "product_id", "cle", "PRD").collect()}
    assert got == {f"p{i:07d}": f"PRD{i:06d}" for i in range(5000)}
