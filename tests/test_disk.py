"""Results written on the way leave no shuffle files, and what goes to the orders is short."""
import datetime as dt
import functools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators.ordered import SHUFFLE_CLEANUP, forget, materialise
from marketlens.plans import factors as X
from marketlens.plans import recsys as R
from marketlens.session import checkpoint_dir
from marketlens.sources import tables

D0 = dt.date(2024, 1, 1)


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def rows(df):
    return sorted(map(repr, df.collect()))


def test_written_results_leave_no_shuffle_files(spark):
    before, mode = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    written = materialise(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count().repartition(3, "k"))
    assert not shuffle_files(spark) - before and written.count() == 7
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == mode
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written._stage)
    forget(written)
    assert not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def basket_lines(spark):
    baskets = ["ab", "abc", "bcd", "ad", "abcd", "ac", "bd", "a", "acd"]
    cells = [(f"o{i}", p, c, D0 + dt.timedelta(days=i)) for i, b in enumerate(baskets) for p in b for c in ("x", "y")[:2 if p == "d" else 1]]
    return spark.createDataFrame(cells + cells[:3] + [(None, "a", "x", D0)], "order_id string, produit_key string, categorie string, ds date")


def test_numbered_items_with_windows_give_the_same_scores(spark):
    lines = basket_lines(spark)
    items, names = R.coded(R.windowed_items(lines))
    assert items.schema["produit_key"].dataType.simpleString() == "int" and rows(R.windowed_items(items)) == rows(items)
    plain = R.complement_scores(R.masked_context(lines, R.masked_target(lines)), R.basket_statistics(lines))
    short = R.complement_scores(R.masked_context(items, R.masked_target(items)), R.basket_statistics(items))
    assert rows(R.named(short, names, "produit_key")) == rows(plain) and plain.count() > 5
    out = R.named(R.named(R.leave_one_out(items), names, "target"), names, "candidat")
    assert rows(out) == rows(R.leave_one_out(lines)) and out.count() > 10


def test_neighbours_travel_in_sorted_columns(spark):
    lists = R.packed_neighbours(R.basket_statistics(basket_lines(spark))).collect()
    assert lists and all(sorted(zip(r["pop"], r["n"], r["dst"])) == list(zip(r["pop"], r["n"], r["dst"])) for r in lists)


def stages(spark):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    names = [f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    return {n for n in names if n.startswith("stage-")}


@pytest.mark.parametrize("fit, kept", [(lambda m: X.bpr_factors(m, 4, 2, 2), 2), (lambda m: X.truncated_svd(m, 3, rounds=5, tolerance=0.0)[:2], 3)])
def test_steps_of_factors_are_deleted_when_the_next_is_there(spark, fit, kept):
    """Left are the results and what they read (entries or numbers of items), and the input of the numbering."""
    m = spark.createDataFrame([(f"c{u}", f"p{i}", float(1 + (u * i) % 5)) for u in range(12) for i in range(9) if (u * 5 + i * 3) % 4], "client_key string, produit_key string, v double")
    before = stages(spark)
    users, items = fit(m)
    assert len(stages(spark) - before) <= kept + 1
    assert users.count() == 12 and items.count() == 9


def test_ranks_by_sets_of_categories_match_plain_ranks(spark):
    """Every order's lists, made from the heads of shared lists, against scores of all items of all orders; item d has two categories."""
    lines = basket_lines(spark)
    k, stats = 3, R.basket_statistics(lines)
    context = R.masked_context(lines, R.masked_target(lines))
    pop = {(r["window"], r["produit_key"]): r["pop"] for r in stats["popularity"].collect()}
    cpop = {(r["window"], r["categorie"], r["produit_key"]): r["cpop"] for r in stats["category"].collect()}
    co = {}
    for r in stats["cooccurrence"].collect():
        co[r["window"], r["a"], r["b"]] = co[r["window"], r["b"], r["a"]] = r["n_commandes"]
    held = {}
    for r in context.collect():
        held.setdefault((r["order_id"], r["window"]), set()).add((r["produit_key"], r["categorie"]))
    want = {}
    for (o, w), own in held.items():
        inside, others = {p for p, _ in own}, [p for v, p in pop if v == w]
        n = {p: sum(co.get((w, x, p), 0) for x in inside) for p in others}
        score = {"cooccurrence": n, "bm25": {p: n[p] / (1 + math.log1p(pop[w, p])) for p in others}, "lift": {p: n[p] / pop[w, p] for p in others},
                 "categorie_contexte": {p: sum(cpop.get((w, c, p), 0) for c in {c for _, c in own}) for p in others}, "popularite": dict.fromkeys(others, 0)}
        lists = {g: sorted((p for p in others if p not in inside), key=lambda p: (-round(s[p], 9), -pop[w, p], p))[:k] for g, s in score.items()}
        if others:
            want |= {(o, g): x for g, x in lists.items()}
            total = {p: round(sum(1 / (60 + x.index(p) + 1) for x in lists.values() if p in x), 9) for x in lists.values() for p in x}
            want[o, "rrf"] = sorted(total, key=lambda p: (-total[p], p))[:k]
    ranks = R.candidate_ranks(context, stats, k)
    both = ranks.unionByName(R.fused_candidates(ranks, k))
    assert {(r["order_id"], r["model"]): r["liste"] for r in both.collect()} == want and len(want) > 20
    targets = R.masked_target(lines).join(R.order_windows(lines), "order_id")
    hits = [(r["window"], m, r["target"] in want.get((r["order_id"], m), [])[:2]) for r in targets.collect() for m in (*R.GENERATORS, "rrf")]
    for r in R.candidate_recall(targets, both, (2,)).collect():
        mine = [h for w, m, h in hits if (w, m) == (r["window"], r["model"])]
        assert r["n"] == len(mine) and abs(r["recall_2"] - sum(mine) / len(mine)) < 1e-12


def test_best_items_match_all_products(spark):
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(40, 3)).astype(np.float32), rng.normal(size=(60, 3)).astype(np.float32)
    v[7], u[3] = v[2], 0  # items alike, and a user who likes all the same
    frame = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, features array<float>")
    score = lambda a, b: functools.reduce(lambda s, j: s + a[j] * b[j], range(3), np.float32(0))
    for n, most, k in ((60, 1 << 20, 5), (60, 13, 5), (4, 2, 6)):
        want = {i: sorted((-score(u[i], v[j]), j) for j in range(n))[:k] for i in range(40)}
        got = {r["id"]: list(zip([-np.float32(s) for s in r["scores"]], r["ids"])) for r in X.best_items(frame(u), frame(v[:n]), k, most, 16).collect()}
        assert got == want
    scores, ids = np.full((40, 5), -np.inf, np.float32), np.zeros((40, 5), np.int32)
    order = np.argsort(-(v.astype(float) ** 2).sum(1))
    scores, ids = X.improved(u, scores, ids, v[order], order.astype(np.int32), block=8)  # several blocks
    assert all([(-s, i) for s, i in zip(scores[r], ids[r])] == sorted((-score(u[r], v[j]), j) for j in range(60))[:5] for r in range(40))


def test_written_datasets_leave_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    made = {n: spark.range(50).withColumn("k", F.col("id") % 3).repartition(3, "k") for n in ("a", "b")}
    out = tables.write_datasets(made, f"file://{tmp_path}")
    assert not shuffle_files(spark) - before and [r["dataset"] for r in out.select("dataset").collect()] == ["a", "b"]
