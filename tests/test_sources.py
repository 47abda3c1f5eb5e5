from datetime import date

import pytest
from pyspark.errors import AnalysisException

from marketweek.sources import readers, sinks


def write(path, text, encoding):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_transactions_from_mixed_sources(spark, tmp_path):
    write(tmp_path / "a" / "1.csv", "거래일자,품목명,반입량,금액\n2024-01-01,양파,10,1000\n", "utf-8-sig")
    write(tmp_path / "a" / "2.csv", "거래일자,품목명,반입량,금액\n2024-01-02,마늘,2,x\n", "cp949")
    # Another header among the UTF-8 files of the same source.
    write(tmp_path / "a" / "3.csv", "금액,수량,품목,date\n9,3,무,2024-01-04\n", "utf-8")
    write(tmp_path / "b" / "1.csv", "amount,item,qty_in,date\n7,leek,1,20240103\n", "utf-8")
    df = readers.read_transactions(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert df.columns == ["date", "item", "qty_in", "amount"]
    assert sorted(tuple(r) for r in df.collect()) == [
        (date(2024, 1, 1), "양파", 10.0, 1000.0),
        (date(2024, 1, 2), "마늘", 2.0, None),
        (date(2024, 1, 3), "leek", 1.0, 7.0),
        (date(2024, 1, 4), "무", 3.0, 9.0),
    ]


def test_header_is_the_first_line_of_a_file_in_several_blocks(spark, tmp_path):
    body = "".join(f"{i},x{i}\n" for i in range(20000))
    write(tmp_path / "s" / "1.csv", "a,b\n" + body, "utf-8")
    write(tmp_path / "s" / "2.csv", "b,a\n" + body, "utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        assert [len(files) for _, files in readers.group_files(spark, [str(tmp_path / "s")])] == [1, 1]
        write(tmp_path / "s" / "2.csv", "a,b\n" + body, "utf-8")
        assert [len(files) for _, files in readers.group_files(spark, [str(tmp_path / "s")])] == [2]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_column_fails_before_any_job(spark):
    df = spark.createDataFrame([("2024-01-01", "a", "1")], "date string, item string, qty_in string")
    with pytest.raises(ValueError, match="amount"):
        readers.standardise_transactions(df)


def test_missing_path(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_csv(spark, str(tmp_path / "absent"), encoding="utf-8")


def test_weather_and_wide_files(spark, tmp_path):
    write(tmp_path / "w.csv", "조회일자,tmax,precip\n20240101,3.5,\n", "cp949")
    weather = readers.read_weather(spark, str(tmp_path / "w.csv"))
    assert [tuple(r) for r in weather.collect()] == [(date(2024, 1, 1), 3.5, None)]
    write(tmp_path / "p.csv", "거래일자,양파,마늘\n2024-01-01,5,-1\n", "utf-8")
    wide = readers.read_wide_prices(spark, str(tmp_path / "p.csv"))
    assert [tuple(r) for r in wide.collect()] == [(date(2024, 1, 1), 5.0, -1.0)]


def test_stage_report_and_rules(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", date(2023, 1, 2), 1.0), ("a", date(2024, 1, 1), 2.0)], "item string, week date, v double"
    )
    sinks.write_stage(df, str(tmp_path / "stage"), partition_by_year=True)
    again = readers.read_stage(spark, str(tmp_path / "stage"))
    assert again.count() == 2
    plan = again.where("week_year = 2024")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week_year" in plan
    assert sinks.write_report(df, str(tmp_path / "r1"), enabled=False) is False
    assert not (tmp_path / "r1").exists()
    sinks.write_report(df, str(tmp_path / "r2"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r2")).columns == df.columns

    for name, text in {
        "params": '{"price_discount_threshold": 0.2}',
        "aliases": '{"alias": "x", "canonical": "a"}',
        "groups": '{"grp": "g", "item": "a"}',
    }.items():
        write(tmp_path / f"{name}.json", text, "utf-8")
    params, aliases, groups = readers.read_rules(
        spark, *[str(tmp_path / f"{n}.json") for n in ("params", "aliases", "groups")]
    )
    from marketweek.operators.substitutes import rule_params

    rules = rule_params(params)
    assert rules.price_discount_threshold == 0.2 and rules.top_k == 5
    assert aliases.first().canonical == "a" and groups.first().grp == "g"


def test_fallback_encoding_needs_its_setting(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_bytes("품목명,값\n사과,1\n".encode("cp949"))
    spark.conf.set(readers.CHARSETS, "false")
    try:
        with pytest.raises(ValueError, match="javaCharsets"):
            readers.read_parts(spark, str(path))
    finally:
        spark.conf.set(readers.CHARSETS, "true")
    assert readers.read_csv(spark, str(path)).first()["품목명"] == "사과"


def test_file_facts_sort_no_lines(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("x,y\n" + "1,2\n" * 50)
    (tmp_path / "b.csv").write_bytes("y,x\n양파,2\n".encode("cp949"))
    facts = readers.file_facts(spark, [str(tmp_path)])
    facts.explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    found = {r.path.rsplit("/", 1)[1]: r for r in facts.collect()}
    assert found["a.csv"].utf8 and not found["b.csv"].utf8 and found["a.csv"].header != found["b.csv"].header
