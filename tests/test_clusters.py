"""Mixed-type clustering and the bootstrap band against plain computations."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweek.operators import clusters, profile

COLUMNS = "item string, category string, colour string, log_qty double, a int, b int, c int"
FLAGS = ["a", "b", "c"]


def ingredients(n: int) -> list[tuple]:
    rng = random.Random(3)
    return [
        (f"i{k}", rng.choice(["root", "leaf", None]), rng.choice("rg"), rng.uniform(0, 5), *(rng.randrange(2) for _ in FLAGS))
        for k in range(n)
    ]


def found(spark, rows, parts: int, k: int = 4):
    df = spark.createDataFrame(rows, COLUMNS).repartition(parts)
    out, centres = clusters.cluster_items(df, ["category", "colour"], ["log_qty"], FLAGS, k)
    return {r.item: (r.cluster, list(r.features)) for r in out.collect()}, centres


def test_labels_do_not_depend_on_partitions(spark):
    rows = ingredients(150)
    one, centres = found(spark, rows, 1)
    many, again = found(spark, list(reversed(rows)), 7)
    assert one == many and centres == again and len(centres) == 4


def test_clusters_follow_the_rule(spark):
    out, centres = found(spark, ingredients(120), 3)
    items = sorted(out, key=lambda i: (hashlib.md5(i.encode()).hexdigest(), i))
    x = np.array([out[i][1] for i in items])
    # One-hot categories, then the number and the three flags.
    assert x.shape[1] == 3 + 2 + 1 + len(FLAGS) or x.shape[1] == 3 + 2 + 1 + len(FLAGS) + 2
    start = [x[0]]
    while len(start) < 4:
        away = np.round(np.min([((x - c) ** 2).sum(axis=1) for c in start], axis=0), 9)
        start.append(x[int(np.argmax(away))])
    c = np.array(start)
    for _ in range(100):
        label = np.argmin(np.round(((x[:, None] - c[None]) ** 2).sum(axis=2), 9), axis=1)
        moved = np.array([x[label == k].mean(axis=0) if (label == k).any() else c[k] for k in range(4)])
        if np.abs(moved - c).max() < 1e-9:
            break
        c = moved
    assert [out[i][0] for i in items] == label.tolist()
    assert np.abs(np.array(centres) - c).max() < 1e-6


def test_clusters_of_few_and_no_rows(spark):
    rows = [("x", "root", "r", 1.0, 0, 0, 1)] * 3 + [("y", None, None, 2.0, 1, 0, 1), ("z", "leaf", "g", None, 0, 0, 0)]
    out, centres = found(spark, rows, 2)
    assert set(out) == {"x", "y"} and len(centres) == 2
    none, no_centres = found(spark, [], 1)
    assert none == {} and no_centres == []


def test_rounds_read_equal_rows_once(spark, monkeypatch):
    kinds, kept = [("root", "r", 1.0, 0, 1, 0), ("leaf", "g", 2.0, 1, 0, 0), (None, "r", 4.0, 0, 0, 1)], []
    rows = [(f"i{k}", *kinds[k % 7 % 3]) for k in range(700)]
    whole = clusters.materialise
    monkeypatch.setattr(clusters, "materialise", lambda df: kept.append(df.count()) or whole(df))
    out, centres = found(spark, rows, 5, 2)
    assert kept == [700, 3] and len(out) == 700 and len(centres) == 2
    x = np.array([out[i][1] for i, *_ in rows])
    label = np.array([out[i][0] for i, *_ in rows])
    # Each row weighs as often as it is there.
    assert all(np.abs(x[label == k].mean(axis=0) - centres[k]).max() < 1e-6 for k in range(2))


@pytest.fixture(scope="module")
def prices(spark):
    rng = random.Random(5)
    rows = [(f"i{k}", g, rng.uniform(1, 9)) for k in range(60) for g in ("a", "b")] + [("n", "a", None), ("one", "c", 2.0)]
    return rows, spark.createDataFrame(rows, "item string, grp string, v double")


def test_band_by_hand(spark, prices):
    rows, df = prices
    key = F.concat("grp", F.lit("|"), "item")
    got = {r.grp: r for r in profile.bootstrap_band(df.repartition(5), ["grp"], "v", key, 24).collect()}
    again = {r.grp: r for r in profile.bootstrap_band(df.coalesce(1), ["grp"], "v", key, 24).collect()}
    assert got == again and set(got) == {"a", "b", "c"}
    for g in got:
        means, values = [], [(i, math.floor(v * 1e4 + 0.5)) for i, h, v in rows if h == g and v is not None]
        for r in range(24):
            total = count = 0
            for item, units in values:
                digest = hashlib.md5(f"{g}|{item}|{r // 8}".encode()).hexdigest()
                u = int(digest[r % 8 * 4 : r % 8 * 4 + 4], 16)
                draws = sum(u >= t for t in profile.POISSON)
                total, count = total + draws * units, count + draws
            if count:
                means.append(total / count / 1e4)
        low, high = np.quantile(means, [0.025, 0.975])
        assert got[g].n == len(values) and abs(got[g].low - low) < 1e-9 and abs(got[g].high - high) < 1e-9
        assert abs(got[g]["mean"] - sum(u for _, u in values) / len(values) / 1e4) < 1e-9
    assert profile.bootstrap_band(df.where("v < 0"), ["grp"], "v", key).count() == 0


def test_draws_are_poisson():
    share = [b - a for a, b in zip((0, *profile.POISSON), (*profile.POISSON, 65536))]
    for n, s in enumerate(share[:6]):
        assert abs(s / 65536 - math.exp(-1) / math.factorial(n)) < 2e-5


def test_cv_summary_is_the_mean_of_its_folds(spark):
    from marketweek.operators import gbm

    rows = [(1997, 0.5, 0.2, 3.0, 0.1), (1998, 0.7, 0.4, 5.0, 0.3)]
    folds = spark.createDataFrame(rows, "fold_year int, wape double, smape double, mae double, rmse_log double")
    out = gbm.cv_summary(folds).first()
    assert out.folds == 2 and out.mae == 4.0 and abs(out.wape - 0.6) < 1e-12 and abs(out.rmse_log - 0.2) < 1e-12
