"""Queries that start at files: the given tables rendered as source files, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweek.functions.scalar import iso_year, require_rows
from marketweek.operators import profile, wide
from marketweek.operators.substitutes import rule_params
from marketweek.operators.substitutes import substitutes as substitutes_of
from marketweek.session import ensure_checkpoint_dir
from marketweek.sources import readers
from marketweek.sources.sinks import write_report
from suite import sql
from suite.adapters import CENTS, rounded, table, transactions, wide_prices
from suite.forecasts import THRESHOLD, recommendation_inputs
from suite.panels import weekly_table
from suite.registry import query

TOP_K = 4


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def rendered(df: DataFrame, path: str, encoding: str = "utf-8") -> str:
    df.write.option("header", True).option("encoding", encoding).csv(path)
    return path


def source_files(spark: SparkSession, sf: str) -> list[str]:
    """The transactions as two sources: other names, date forms and encodings, no row in both."""
    # Files in older encodings need this setting; session.configured has it too.
    spark.conf.set(readers.CHARSETS, "true")
    rows = transactions(spark, sf).withColumn("item", F.concat(F.lit("양파 "), "item"))
    early = F.col("date") < F.lit("1995-01-01")
    one = rows.where(early).select(
        F.date_format("date", "yyyy-MM-dd").alias("거래일자"), F.col("item").alias("품목명"),
        F.col("qty_in").alias("반입량"), F.col("amount").alias("금액"),
    )
    two = rows.where(~early).select(
        "amount", F.col("item").alias("품목"), F.col("qty_in").alias("수량"), F.date_format("date", "yyyyMMdd").alias("date")
    )
    at = folder(spark, "sources")
    return [rendered(one, f"{at}/a"), rendered(two, f"{at}/b", readers.FALLBACK_ENCODING)]


@query("""SELECT '양파 ' || p_name AS item, count(*) AS rows, min(CAST(l_shipdate AS DATE)) AS first_day,
  max(CAST(l_shipdate AS DATE)) AS last_day, CAST(sum(l_quantity) AS DOUBLE) AS qty,
  CAST(sum(floor(l_extendedprice * 100 + 0.5)) AS BIGINT) AS cents
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def transactions_from_files(spark, sf):
    """Two kinds of source files in two encodings to one master table, by item."""
    master = readers.read_transactions(spark, source_files(spark, sf))
    return master.groupBy("item").agg(
        F.count("*").alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.sum("qty_in").alias("qty"), F.sum(F.floor(F.col("amount") * 10**CENTS + 0.5)).alias("cents"),
    )


@query(f"""WITH {sql.WIDE}, days AS (SELECT DISTINCT date FROM wide), names AS (SELECT DISTINCT grp FROM wide)
  SELECT d.date, n.grp AS item, {sql.r4('w.price', 'price')} FROM days d CROSS JOIN names n
  LEFT JOIN wide w ON w.date = d.date AND w.grp = n.grp""")
def wide_from_file(spark, sf):
    """The wide price file written, read back and turned long, its columns taken from the file."""
    prices = wide_prices(spark, sf).withColumn("date", F.date_format("date", "yyyyMMdd")).withColumnRenamed("date", "거래일자")
    path = folder(spark, "wide")
    write_report(prices, path)
    return rounded(wide.wide_to_long(readers.read_wide_prices(spark, path)), "price")


def rule_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The substitution rules, written as files of JSON lines and read back."""
    at = folder(spark, "rules")
    parts = table(spark, sf, "part").select(F.col("p_name").alias("item")).distinct()
    spark.range(1).select(F.lit(THRESHOLD).alias("price_discount_threshold"), F.lit(TOP_K).alias("top_k")).write.json(f"{at}/params")
    parts.select(F.upper("item").alias("alias"), F.col("item").alias("canonical")).write.json(f"{at}/aliases")
    parts.select(F.split_part("item", F.lit(" "), F.lit(2)).alias("grp"), "item").write.json(f"{at}/groups")
    return readers.read_rules(spark, f"{at}/params", f"{at}/aliases", f"{at}/groups")


@query(f"""SELECT {THRESHOLD}::DOUBLE AS price_discount_threshold, {TOP_K} AS top_k, grp, items, aliases FROM (
  SELECT split_part(p_name, ' ', 2) AS grp, count(DISTINCT p_name) AS items,
    count(DISTINCT upper(p_name)) AS aliases FROM part GROUP BY 1)""")
def rules_from_files(spark, sf):
    params, aliases, groups = rule_files(spark, sf)
    rules = rule_params(params)
    named = groups.join(aliases, F.col("item") == F.col("canonical"))
    return named.groupBy("grp").agg(F.count("item").alias("items"), F.count("alias").alias("aliases")).select(
        F.lit(rules.price_discount_threshold).alias("price_discount_threshold"), F.lit(rules.top_k).alias("top_k"),
        "grp", "items", "aliases",
    )


@query(f"""WITH {sql.STATE.format(threshold=THRESHOLD).replace('rank <= 5', f'rank <= {TOP_K}')}
  SELECT grp, item, CAST(rank AS INTEGER) AS rank, substitute, {sql.r4('saving_rate')},
  {sql.r4('price_vol_8')}, {sql.r4('own_vol_8')} FROM suggestions""")
def substitutes_from_rules(spark, sf):
    """Suggestions whose threshold, list length and groups come from the rule files."""
    params, _, groups = rule_files(spark, sf)
    grouped = recommendation_inputs(spark, sf, groups)
    return rounded(substitutes_of(grouped, rule_params(params)), "saving_rate", "price_vol_8", "own_vol_8")


@query(f"""WITH {sql.WEEKLY}, seen AS (
    SELECT p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
    ORDER BY min((l_orderkey, l_linenumber)), 1 LIMIT 6)
  SELECT item, CAST(isoyear(week) AS INTEGER) AS year, CAST(weekofyear(week) AS INTEGER) AS week_no,
  {sql.r4('unit_price_week', 'price')} FROM weekly JOIN seen USING (item) WHERE unit_price_week IS NOT NULL""")
def first_items_panel(spark, sf):
    """The cleaned series of the first six items in order of appearance; no rows are an error."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("item"))
    named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    seen = require_rows(profile.first_items(named, 6, ["l_orderkey", "l_linenumber"]).select("item"), "the first items")
    raw = weekly_table(spark, sf).select(
        "item", iso_year(F.col("week")).alias("y"), F.weekofyear("week").alias("w"), "unit_price_week"
    )
    panel = wide.clean_series(raw, seen, "item", "y", "w", "unit_price_week")
    return rounded(require_rows(panel, "the panel of the first items"), "price")
