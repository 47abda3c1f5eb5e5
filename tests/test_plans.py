from datetime import timedelta

import numpy as np
import pytest
from helpers import MONDAY
from pyspark.sql import functions as F

from marketweek.params import GbmParams, SubstituteParams
from marketweek.plans import weekly_batch as batch
from suite import catalog
from suite.adapters import transactions

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def test_batch_from_files(spark, tmp_path):
    """Mixed source files, weather and rule files to suggestions."""
    rng = np.random.default_rng(5)
    utf8, older, weather = ["거래일자,품목명,반입량,금액"], ["amount,품목,수량,date"], ["조회일자,tmax"]
    for i in range(150):
        day = MONDAY + timedelta(days=7 * i)
        weather.append(f"{day:%Y%m%d},{10 + i % 9}")
        for k in range(5):
            qty = int(rng.integers(2, 9))
            amount = round(qty * (10 + 6 * k) * (1 + 0.1 * np.sin(i / 8)), 2)
            name = "Onion" if k == 0 and i % 2 else f"양파{k}"
            if i % 3:
                utf8.append(f"{day:%Y-%m-%d},{name},{qty},{amount}")
            else:
                older.append(f"{amount},{name},{qty},{day:%Y%m%d}")
    for name, lines, encoding in (("a", utf8, "utf-8-sig"), ("b", older, "cp949"), ("w", weather, "utf-8")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.csv").write_bytes(("\n".join(lines) + "\n").encode(encoding))
    rules = {
        "params": '{"price_discount_threshold": 0.2, "top_k": 2}',
        "aliases": '{"alias": "Onion", "canonical": "양파0"}',
        "groups": "\n".join(f'{{"grp": "g", "item": "양파{k}"}}' for k in range(5)),
    }
    for name, text in rules.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    sources = batch.Sources(
        (str(tmp_path / "a"), str(tmp_path / "b")), *(str(tmp_path / f"{n}.json") for n in rules), str(tmp_path / "w")
    )
    out = tmp_path / "out"
    found = batch.run_from_files(
        spark, sources, str(out), "2020-03-31", ("2020-04-01", "2020-11-30"),
        model_params=GbmParams(rounds=2, min_child_samples=5, extra_features=("tmax",)),
    )
    weekly = spark.read.parquet(str(out / "weekly"))
    assert {r.item for r in weekly.select("item").distinct().collect()} == {f"양파{k}" for k in range(5)}
    assert weekly.count() == 5 * 150
    rows = found.collect()
    assert rows and max(r["rank"] for r in rows) <= 2 and min(r.saving_rate for r in rows) >= 0.2
    assert {"forecasts", "leaderboard", "val_metrics", "suggestions", "model"} <= {p.name for p in out.iterdir()}


def test_batch_without_transactions_fails_early(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text("date,item,qty_in,amount\n")
    for name, text in (("p", "{}"), ("l", '{"alias": "x", "canonical": "y"}'), ("g", '{"grp": "g", "item": "x"}')):
        (tmp_path / f"{name}.json").write_text(text)
    sources = batch.Sources((str(tmp_path / "a"),), *(str(tmp_path / f"{n}.json") for n in "plg"))
    with pytest.raises(ValueError, match="the transactions"):
        batch.run_from_files(spark, sources, str(tmp_path / "out"), "2020-01-01", ("2020-01-02", "2020-02-01"))


def test_whole_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(6):
        for i in range(160):
            for d in (0, 3):
                qty = float(rng.integers(1, 9))
                price = (10 + 6 * k) * (1 + 0.1 * np.sin(i / 8))
                rows.append((f"item{k}", MONDAY + timedelta(days=7 * i + d), qty, float(qty * price)))
    tx = spark.createDataFrame(rows, "item string, date date, qty_in double, amount double")
    aliases = spark.createDataFrame([("other", "item0")], "alias string, canonical string")
    weekly = batch.build_weekly(tx, str(tmp_path / "weekly"), aliases)
    assert weekly.count() == 6 * 160
    weather = tx.groupBy("date").agg(F.avg("amount").alias("tmax"))
    features = batch.build_features(weekly, str(tmp_path / "features"), weather)
    forecasts = batch.forecast_items(spark, weekly, str(tmp_path / "out"))
    assert forecasts.count() == 24
    groups = spark.createDataFrame([(f"item{k}", "g") for k in range(6)], "item string, grp string")
    found = batch.train_and_recommend(
        features, weekly, groups, str(tmp_path / "out"), "2020-06-30", ("2020-07-01", "2021-01-31"),
        GbmParams(rounds=2, min_child_samples=5, extra_features=("tmax",)), SubstituteParams(),
    )
    assert found.where("rank > 5").isEmpty()
    written = {p.name for p in (tmp_path / "out").iterdir()}
    assert {"forecasts", "leaderboard", "last_fold", "val_metrics", "improvement", "importances", "model", "suggestions"} <= written


CHEAP = sorted(set(catalog.QUERIES) - {n for n in catalog.QUERIES if n.startswith("gbm_") or n == "kmeans"})


@pytest.mark.parametrize("name", CHEAP)
def test_no_query_plans_pairs_or_row_functions(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in FORBIDDEN if f in plan]


def test_scan_reads_only_the_used_columns(spark):
    df = transactions(spark, SF).where("date >= '1999-01-01'").groupBy("item").agg(F.sum("amount"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan and "l_discount" not in plan


def test_weekly_sums_combine_before_the_exchange(spark):
    plan = catalog.QUERIES["weekly_agg"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    final, partial = plan.index("Exchange hashpartitioning(item"), plan.index("partial_sum")
    assert final < partial
