"""The corpus pipeline on a small folder."""

from __future__ import annotations

import random

import corpus_pipeline
from marketweek.llm import divergence, simhash, windows
from tests.llm.test_operators import prose


def test_stages_take_effect(spark, tmp_path):
    random.seed(1)
    shared = prose(500, 70)
    texts = [prose(k, 200) for k in range(10)]
    texts += [texts[0], "too short", None, prose(30, 90) + "\n" + shared, prose(31, 90) + "\n" + shared]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) == {*range(10), 13, 14}
    good = divergence.keep_good(docs)
    one = simhash.keep_one(good)
    left = windows.without_repeats(one)
    assert left.columns == docs.columns
    short = {r.doc_id: r.n_chars for r in left.collect()}
    assert short[14] < len(texts[14]) - len(shared) + 5 and short[13] == len(texts[13])
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "hilbert_packing" and corpus_pipeline.ORACLE_SQL is None


def test_stages_restore_the_setting_of_shuffle_files(spark):
    from pyspark.sql import functions as F

    from marketweek.llm import storage

    before = spark.conf.get(storage.CLEANUP)
    df = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    out = storage.staged(df, "counts")
    assert out.dtypes == df.dtypes and out.count() == 7 and spark.conf.get(storage.CLEANUP) == before
    again = storage.staged(out.join(df.select("k"), "k"), "joined")
    assert again.count() == 7
