"""Queries on weekly sums, cleaning, profiles, outside variables and features."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from marketweek.functions.scalar import (
    calendar,
    guarded_unit_price,
    iso_week_start,
    iso_year,
    positive_or_null,
    week_of,
)
from marketweek.operators import clusters, evaluation, features, profile, weekly, wide
from marketweek.operators.baselines import calendar_naive
from marketweek.params import FeatureParams
from suite import sql
from suite.adapters import (
    GROUPS,
    ingredients,
    item_groups,
    panel,
    r4,
    rounded,
    second_word,
    stored_weekly,
    table,
    transactions,
    wide_prices,
    weather_daily,
)
from suite.adapters import weekly as weekly_table
from suite.registry import query

P = FeatureParams()


@query(f"""WITH {sql.WEEKLY} SELECT item, week, qty_in_week, amount_week,
  {sql.r4('unit_price_week')} FROM weekly""")
def weekly_agg(spark, sf):
    return rounded(weekly_table(spark, sf), "unit_price_week")


@query("""SELECT l_orderkey, l_linenumber,
  CAST(isoyear(l_shipdate) AS INTEGER) AS iso_year, CAST(weekofyear(l_shipdate) AS INTEGER) AS iso_week,
  CAST(date_trunc('week', l_shipdate) AS DATE) AS week FROM lineitem""")
def iso_week_start_of_rows(spark, sf):
    day = F.col("l_shipdate").cast("date")
    parts = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", iso_year(day).alias("iso_year"), F.weekofyear(day).alias("iso_week")
    )
    return parts.withColumn("week", iso_week_start(F.col("iso_year"), F.col("iso_week")))


@query(f"""WITH {sql.WEEKLY} SELECT item, CAST(isoyear(week) AS INTEGER) AS iso_year,
  CAST(weekofyear(week) AS INTEGER) AS iso_week, week, {sql.r4('amount_week / qty_in_week', 'target')}
  FROM weekly WHERE qty_in_week <> 0""")
def panel_base(spark, sf):
    cols = weekly.PanelColumns(item="item", year="iso_year", week="iso_week", price="none",
                               amount="amount", qty="qty")
    week = F.col("week")
    raw = weekly_table(spark, sf).select(
        "item",
        iso_year(week).cast("string").alias("iso_year"),
        F.weekofyear(week).cast("string").alias("iso_week"),
        F.col("amount_week").cast("string").alias("amount"),
        F.col("qty_in_week").cast("string").alias("qty"),
    )
    base = weekly.panel_base(raw, cols)
    return base.select(
        "item", iso_year(week).alias("iso_year"), F.weekofyear(week).alias("iso_week"), "week", r4("target").alias("target")
    )


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 AND l_extendedprice > 0
  THEN l_extendedprice / l_quantity END AS unit_price FROM lineitem""")
def unit_price(spark, sf):
    price = guarded_unit_price(F.col("l_extendedprice"), F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", price.alias("unit_price"))


@query(f"""WITH {sql.TX} SELECT item, date, count(*) AS rows FROM tx
  WHERE isodow(date) <> 7 GROUP BY 1, 2""")
def sunday_filter(spark, sf):
    return wide.drop_sundays(transactions(spark, sf)).groupBy("item", "date").agg(F.count("*").alias("rows"))


@query(f"""WITH {sql.WEEKLY} SELECT item, week,
  {sql.r4('CASE WHEN unit_price_week - 2550 > 0 THEN unit_price_week - 2550 END', 'excess')} FROM weekly""")
def nonpositive_null(spark, sf):
    excess = positive_or_null(F.col("unit_price_week") - 2550)
    return weekly_table(spark, sf).select("item", "week", r4(excess).alias("excess"))


@query(f"""WITH {sql.WIDE}, days AS (SELECT DISTINCT date FROM wide),
  names AS (SELECT unnest({GROUPS}) AS grp)
  SELECT d.date, n.grp AS item, {sql.r4('w.price', 'price')} FROM days d CROSS JOIN names n
  LEFT JOIN wide w ON w.date = d.date AND w.grp = n.grp""")
def wide_to_long(spark, sf):
    return rounded(wide.wide_to_long(wide_prices(spark, sf)), "price")


@query(f"""WITH {sql.WIDE}, names AS (SELECT unnest({GROUPS[:6]}) AS grp, unnest([0, 1, 2, 0, 1, 2]) AS cluster),
  days AS (SELECT DISTINCT date FROM wide WHERE isodow(date) <> 7)
  SELECT n.cluster, n.grp AS item, d.date, {sql.r4('CASE WHEN w.price > 0 THEN w.price END', 'price')}
  FROM days d CROSS JOIN names n LEFT JOIN wide w ON w.date = d.date AND w.grp = n.grp""")
def cluster_series(spark, sf):
    place = F.array_position(F.array(*[F.lit(g) for g in GROUPS[:6]]), F.col("grp"))
    mapping = (
        item_groups(spark, sf)
        .select("grp", place.alias("place"))
        .distinct()
        .where("place > 0")
        .select(F.col("grp").alias("item"), ((F.col("place") - 1) % 3).cast("int").alias("cluster"))
    )
    series = wide.cluster_series(wide_prices(spark, sf), mapping)
    return rounded(series.select("cluster", "item", "date", "price"), "price")


@query(f"""WITH {sql.WEEKLY} SELECT item, CAST(isoyear(week) AS INTEGER) AS year,
  CAST(weekofyear(week) AS INTEGER) AS week_no, {sql.r4('unit_price_week', 'price')}
  FROM weekly WHERE unit_price_week IS NOT NULL""")
def clean_series(spark, sf):
    raw = weekly_table(spark, sf).select(
        "item", iso_year(F.col("week")).alias("y"), F.weekofyear("week").alias("w"), "unit_price_week"
    )
    return rounded(wide.clean_series(raw, None, "item", "y", "w", "unit_price_week"), "price")


@query("""SELECT p_name AS item, min_by(l_orderkey, (l_orderkey, l_linenumber)) AS first_order,
  min_by(l_linenumber, (l_orderkey, l_linenumber)) AS first_line
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
  ORDER BY min((l_orderkey, l_linenumber)), 1 LIMIT 6""")
def first_items(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("item"))
    named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    seen = profile.first_items(named, 6, ["l_orderkey", "l_linenumber"])
    return seen.select(
        "item", F.col("first_seen.l_orderkey").alias("first_order"), F.col("first_seen.l_linenumber").alias("first_line")
    )


@query(f"""WITH {sql.WEEKLY} SELECT item, {sql.r4('sum(amount_week)', 'total_amount')} FROM weekly
  GROUP BY 1 ORDER BY sum(amount_week) DESC, 1 LIMIT 40""")
def top_items(spark, sf):
    return rounded(profile.top_items(weekly_table(spark, sf), 40), "total_amount")


@query("""SELECT DISTINCT p_name AS item FROM part""")
def distinct_items(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_name").alias("item"))
    return profile.distinct_values(parts, "item")


@query(f"""WITH {sql.WEEKLY}, total AS (SELECT count(DISTINCT week) AS weeks_total FROM weekly)
  SELECT item, count(qty_in_week) AS weeks_traded, any_value(weeks_total) AS weeks_total,
    {sql.r4('count(qty_in_week) / any_value(weeks_total)', 'coverage')}
  FROM weekly, total GROUP BY 1""")
def coverage(spark, sf):
    return rounded(profile.coverage(stored_weekly(spark, sf)), "coverage")


@query(f"""WITH {sql.WEEKLY},
  top AS (SELECT item FROM weekly GROUP BY 1 ORDER BY sum(amount_week) DESC, 1 LIMIT 40),
  weeks AS (SELECT DISTINCT week FROM weekly)
  SELECT t.item, w.week, CAST(x.qty_in_week IS NOT NULL AS INTEGER) AS traded
  FROM top t CROSS JOIN weeks w LEFT JOIN weekly x ON x.item = t.item AND x.week = w.week""")
def coverage_grid(spark, sf):
    table_ = stored_weekly(spark, sf)
    return profile.coverage_grid(table_, profile.top_items(table_, 40))


_BOX = """box AS (SELECT item, count(unit_price_week) AS n, min(unit_price_week) AS min_price,
  quantile_cont(unit_price_week, 0.25) AS q1, quantile_cont(unit_price_week, 0.5) AS median,
  quantile_cont(unit_price_week, 0.75) AS q3, max(unit_price_week) AS max_price
  FROM weekly GROUP BY 1)"""
_BOX_VALUES = ["min_price", "q1", "median", "q3", "max_price"]


@query(f"""WITH {sql.WEEKLY}, {_BOX} SELECT item, n, {', '.join(sql.r4(c) for c in _BOX_VALUES)},
  {sql.r4('q1 - 1.5 * (q3 - q1)', 'low_fence')}, {sql.r4('q3 + 1.5 * (q3 - q1)', 'high_fence')} FROM box""")
def price_box(spark, sf):
    return rounded(profile.price_box(weekly_table(spark, sf)), *_BOX_VALUES, "low_fence", "high_fence")


@query(f"""WITH {sql.WEEKLY}, {_BOX},
  top AS (SELECT item FROM weekly GROUP BY 1 ORDER BY sum(amount_week) DESC, 1 LIMIT 30)
  SELECT w.item, w.week, {sql.r4('w.unit_price_week', 'unit_price_week')}
  FROM weekly w JOIN box USING (item) SEMI JOIN top USING (item)
  WHERE unit_price_week < q1 - 1.5 * (q3 - q1) OR unit_price_week > q3 + 1.5 * (q3 - q1)""")
def price_outliers(spark, sf):
    table_ = stored_weekly(spark, sf)
    found = profile.price_outliers(profile.restrict(table_, profile.top_items(table_, 30)))
    return rounded(found.select("item", "week", "unit_price_week"), "unit_price_week")


@query(f"""WITH {sql.WEEKLY}, {_BOX}
  SELECT w.item, w.week, {sql.r4('w.unit_price_week', 'unit_price_week')}
  FROM weekly w JOIN box USING (item)
  WHERE unit_price_week < q1 - 1.5 * (q3 - q1) OR unit_price_week > q3 + 1.5 * (q3 - q1)""")
def price_outliers_all(spark, sf):
    found = profile.price_outliers(stored_weekly(spark, sf))
    return rounded(found.select("item", "week", "unit_price_week"), "unit_price_week")


@query(f"""WITH {sql.WEEKLY} SELECT item, count(*) AS n, {sql.r4('corr(qty_in_week, unit_price_week)', 'corr')},
  {sql.r4('regr_slope(unit_price_week, qty_in_week)', 'slope')}, CAST(grouping(item) AS INTEGER) AS is_total
  FROM weekly WHERE unit_price_week IS NOT NULL GROUP BY GROUPING SETS ((item), ())""")
def qty_price_corr(spark, sf):
    return rounded(profile.qty_price_relation(weekly_table(spark, sf)), "corr", "slope")


@query(f"""WITH {sql.WEEKLY} SELECT item, count(*) AS weeks,
  count(*) FILTER (qty_in_week <= 0) AS nonpositive_qty, count(*) FILTER (amount_week <= 0) AS nonpositive_amount,
  count(*) FILTER (unit_price_week IS NULL) AS null_price,
  count(*) FILTER (year(week) <> year(week + 6)) AS boundary_weeks FROM weekly GROUP BY 1""")
def quality(spark, sf):
    return profile.quality(weekly_table(spark, sf))


@query(f"""WITH {sql.WEEKLY}, numbered AS (
    SELECT item, week, row_number() OVER (PARTITION BY item ORDER BY week) AS rn FROM weekly),
  runs AS (SELECT item, week - CAST(7 * rn AS INTEGER) AS island, count(*) AS weeks FROM numbered GROUP BY 1, 2)
  SELECT item, max(weeks) AS longest_run, count(*) AS runs FROM runs GROUP BY 1""")
def week_runs(spark, sf):
    return weekly.week_runs(weekly_table(spark, sf))


@query(f"""WITH {sql.WEEKLY}, spans AS (SELECT item, min(week) AS lo, max(week) AS hi FROM weekly GROUP BY 1),
  spine AS (SELECT item, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAYS)) AS DATE) AS week FROM spans)
  SELECT s.item, s.week,
    last_value(w.qty_in_week IGNORE NULLS) OVER o AS qty_in_week,
    {sql.r4('last_value(w.unit_price_week IGNORE NULLS) OVER o', 'unit_price_week')},
    w.item IS NULL AS is_filled
  FROM spine s LEFT JOIN weekly w ON w.item = s.item AND w.week = s.week
  WINDOW o AS (PARTITION BY s.item ORDER BY s.week)""")
def spine_fill(spark, sf):
    filled = weekly.fill_weeks(weekly_table(spark, sf), ("qty_in_week", "unit_price_week"))
    return rounded(filled, "unit_price_week")


@query(f"""WITH {sql.WEEKLY} SELECT item, CAST(isoyear(week) AS INTEGER) AS iso_year,
  CAST(weekofyear(week) AS INTEGER) AS iso_week, {sql.r4('avg(unit_price_week)', 'mean_price')}
  FROM weekly WHERE unit_price_week IS NOT NULL GROUP BY 1, 2, 3""")
def yearly_curves(spark, sf):
    return rounded(profile.yearly_curves(weekly_table(spark, sf)), "mean_price")


#: Replicates of the band of the yearly curve.
REPLICATES = 64


@query(f"""WITH {sql.WEEKLY},
  rows AS (SELECT item, week, CAST(isoyear(week) AS INTEGER) AS iso_year, CAST(weekofyear(week) AS INTEGER) AS iso_week,
    CAST(floor(unit_price_week * 10000 + 0.5) AS BIGINT) AS units FROM weekly WHERE unit_price_week IS NOT NULL),
  drawn AS (SELECT iso_year, iso_week, units, r, CAST('0x' || substr(
      md5(item || '|' || strftime(week, '%Y-%m-%d') || '|' || CAST(r // {profile.DRAWS} AS VARCHAR)),
      CAST(r % {profile.DRAWS} * 4 + 1 AS INTEGER), 4) AS INTEGER) AS u FROM rows CROSS JOIN range({REPLICATES}) AS x(r)),
  counted AS (SELECT *, {' + '.join(f'CAST(u >= {t} AS INTEGER)' for t in profile.POISSON)} AS draws FROM drawn),
  means AS (SELECT iso_year, iso_week, r, CAST(sum(units * draws) AS DOUBLE) / nullif(sum(draws), 0) / 10000 AS m
    FROM counted GROUP BY 1, 2, 3),
  bands AS (SELECT iso_year, iso_week, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY 1, 2),
  middle AS (SELECT iso_year, iso_week, count(*) AS n, CAST(sum(units) AS DOUBLE) / count(*) / 10000 AS mean FROM rows GROUP BY 1, 2)
  SELECT iso_year, iso_week, n, {sql.r4('mean')}, {sql.r4('low')}, {sql.r4('high')}
  FROM middle JOIN bands USING (iso_year, iso_week)""")
def yearly_band(spark, sf):
    """Mean price over the items by ISO year and week, with the band of its bootstrap means."""
    rows = weekly_table(spark, sf).select(
        "item", "week", "unit_price_week", iso_year(F.col("week")).alias("iso_year"), F.weekofyear("week").alias("iso_week")
    )
    key = F.concat("item", F.lit("|"), F.date_format("week", "yyyy-MM-dd"))
    band = profile.bootstrap_band(rows, ["iso_year", "iso_week"], "unit_price_week", key, REPLICATES)
    return rounded(band, "mean", "low", "high")


@query(f"""WITH {sql.DAILY} SELECT week, {sql.r4('precip')}, {sql.r4('tmax')} FROM weather""")
def weather_weekly(spark, sf):
    return rounded(weekly.weather_weekly(weather_daily(spark, sf)), "precip", "tmax")


@query(f"""WITH {sql.WEEKLY}, {sql.DAILY} SELECT item, week, qty_in_week, {sql.r4('precip')}, {sql.r4('tmax')}
  FROM weekly LEFT JOIN weather USING (week)""")
def weather_join(spark, sf):
    weather = weekly.weather_weekly(weather_daily(spark, sf))
    joined = weekly.join_weather(weekly_table(spark, sf), weather)
    return rounded(joined.select("item", "week", "qty_in_week", "precip", "tmax"), "precip", "tmax")


_LOGS = """logs AS (SELECT *, ln(1 + unit_price_week) AS log_price, ln(1 + qty_in_week) AS log_qty FROM weekly)"""
_ORDER = "WINDOW o AS (PARTITION BY item ORDER BY week)"


def _lag_sql() -> str:
    cols = [sql.r4(f"lag({c}, {k}) OVER o", f"{c}_lag{k}") for c in ("log_price", "log_qty") for k in P.lags]
    return f"WITH {sql.WEEKLY}, {_LOGS} SELECT item, week, {', '.join(cols)} FROM logs {_ORDER}"


@query(_lag_sql())
def lags(spark, sf):
    logs = features.with_logs(weekly_table(spark, sf))
    cols = features.lag_columns("log_price", P.lags) | features.lag_columns("log_qty", P.lags)
    return logs.select("item", "week", *[c.alias(n) for n, c in cols.items()]).withColumns(
        {n: r4(n) for n in cols}
    )


def _rolling_sql() -> str:
    cols = []
    for c in ("log_price", "log_qty"):
        for w in P.windows:
            frame = f"(o ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
            for fn, label in (("avg", "rollmean"), ("stddev_samp", "rollstd")):
                value = f"CASE WHEN count({c}) OVER {frame} = {w} THEN {fn}({c}) OVER {frame} END"
                cols.append(sql.r4(value, f"{c}_{label}{w}"))
    return f"WITH {sql.WEEKLY}, {_LOGS} SELECT item, week, {', '.join(cols)} FROM logs {_ORDER}"


@query(_rolling_sql())
def rolling(spark, sf):
    logs = features.with_logs(weekly_table(spark, sf))
    cols = features.rolling_columns("log_price", P.windows) | features.rolling_columns("log_qty", P.windows)
    return logs.select("item", "week", *[c.alias(n) for n, c in cols.items()]).withColumns(
        {n: r4(n) for n in cols}
    )


@query(f"""WITH {sql.WEEKLY}, {_LOGS} SELECT item, week,
  {sql.r4('log_price - lag(log_price, 52) OVER o', 'log_price_yoy_gap')},
  {sql.r4('log_qty - lag(log_qty, 52) OVER o', 'log_qty_yoy_gap')} FROM logs {_ORDER}""")
def yoy_gap(spark, sf):
    logs = features.with_logs(weekly_table(spark, sf))
    cols = features.yoy_columns("log_price") | features.yoy_columns("log_qty")
    return logs.select("item", "week", *[r4(c).alias(n) for n, c in cols.items()])


def _vol_sql() -> str:
    cols = []
    for w in P.vol_windows:
        frame = f"(o ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        value = f"CASE WHEN count(change) OVER {frame} = {w} THEN stddev_samp(change) OVER {frame} END"
        cols.append(sql.r4(value, f"price_vol_{w}"))
    return f"""WITH {sql.WEEKLY}, changed AS (
      SELECT item, week, unit_price_week / lag(unit_price_week) OVER o - 1 AS change FROM weekly {_ORDER})
      SELECT item, week, {', '.join(cols)} FROM changed {_ORDER}"""


@query(_vol_sql())
def price_vol(spark, sf):
    changed = features.with_price_change(weekly_table(spark, sf))
    cols = features.volatility_columns(P.vol_windows)
    return changed.select("item", "week", *[r4(c).alias(n) for n, c in cols.items()])


@query(f"""WITH {sql.WEEKLY}, {_LOGS} SELECT item, week,
  {sql.r4('lead(unit_price_week) OVER o', 'next_week_unit_price')},
  {sql.r4('lead(log_price) OVER o', 'next_week_log_price')} FROM logs {_ORDER}""")
def targets(spark, sf):
    logs = features.with_logs(weekly_table(spark, sf))
    cols = features.target_columns()
    return logs.select("item", "week", *[r4(c).alias(n) for n, c in cols.items()])


@query(f"""WITH {sql.WEEKLY} SELECT item, week, CAST(year(week) AS INTEGER) AS year,
  CAST(month(week) AS INTEGER) AS month, CAST(weekofyear(week) AS INTEGER) AS weekofyear FROM weekly""")
def calendar_features(spark, sf):
    return calendar(weekly_table(spark, sf).select("item", "week"))


@query(f"""WITH {sql.WEEKLY}, {sql.DAILY}, shifted AS (
    SELECT CAST(k AS INTEGER) AS lag, week + CAST(7 * k AS INTEGER) AS week, tmax FROM weather, range(0, 9) AS r(k)),
  pairs AS (SELECT lag, ln(1 + unit_price_week) AS y, tmax AS x FROM weekly JOIN shifted USING (week)
    WHERE unit_price_week IS NOT NULL AND tmax IS NOT NULL)
  SELECT lag, count(*) AS n, {sql.r4('corr(y, x)', 'corr')} FROM pairs GROUP BY 1""")
def lagged_corr(spark, sf):
    weather = weekly.weather_weekly(weather_daily(spark, sf))
    return rounded(profile.lagged_correlation(weekly_table(spark, sf), weather, "tmax"), "corr")


@query(f"""WITH {sql.WEEKLY} SELECT item, week,
  {sql.r4('avg(qty_in_week) OVER (o ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)', 'qty_rollmean4')}
  FROM weekly {_ORDER}""")
def recent_supply(spark, sf):
    supply = features.recent_supply(weekly_table(spark, sf))
    return rounded(supply.select("item", "week", "qty_rollmean4"), "qty_rollmean4")


@query(f"""WITH {sql.WEEKLY}, named AS (
    SELECT CASE WHEN item LIKE 'hot %' THEN 'warm ' || split_part(item, ' ', 2) ELSE item END AS item,
      week, qty_in_week, amount_week FROM weekly)
  SELECT item, week, round(sum(qty_in_week), 2) AS qty_in_week, round(sum(amount_week), 2) AS amount_week
  FROM named GROUP BY 1, 2""")
def aliased_weekly(spark, sf):
    aliases = (
        item_groups(spark, sf)
        .where(F.col("item").like("hot %"))
        .select(F.col("item").alias("alias"), F.concat(F.lit("warm "), "grp").alias("canonical"))
    )
    merged = weekly.apply_aliases(weekly_table(spark, sf), aliases)
    return merged.select("item", "week", F.round("qty_in_week", 2).alias("qty_in_week"),
                         F.round("amount_week", 2).alias("amount_week"))


@query("""SELECT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS cluster, count(*) AS items FROM part GROUP BY 1""")
def cluster_counts(spark, sf):
    return clusters.cluster_counts(ingredients(spark, sf))


def _mix_sql() -> str:
    cells = ", ".join(f"count(*) FILTER (p_type = '{t}') AS \"{t}\"" for t in TYPES)
    return f"SELECT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS cluster, {cells} FROM part GROUP BY 1"


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(_mix_sql())
def cluster_mix(spark, sf):
    return clusters.cluster_mix(ingredients(spark, sf))


@query("""SELECT p_partkey AS item FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""")
def known_ingredients(spark, sf):
    names = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"))
    return clusters.known_ingredients(ingredients(spark, sf), names).select("item")


@query(f"""SELECT p_partkey AS item, {clusters.CLUSTERS} AS centres, true AS nearest, true AS at_mean FROM part""")
def kmeans(spark, sf):
    """Every item's cluster, with what must hold of it: no other centre is nearer, and its own
    centre is the mean of its members, both worked out anew from the rows."""
    rows = ingredients(spark, sf).drop("cluster")
    found, centres = clusters.cluster_items(rows, ["category", "colour"], ["log_qty"], ["starchy", "eaten_raw", "spice"])
    means = found.groupBy("cluster").agg(vector_to_array(Summarizer.mean(array_to_vector("features"))).alias("mean"))
    centre = F.element_at(F.lit(centres), F.col("cluster") + 1)
    gaps = F.zip_with("mean", centre, lambda a, b: F.abs(a - b))
    off = means.select("cluster", F.array_max(gaps).alias("off"))
    away = F.array(*[clusters.squared_distance(F.col("features"), c) for c in centres])
    return found.join(off, "cluster").select(
        "item", F.lit(len(centres)).alias("centres"),
        (F.element_at(away, F.col("cluster") + 1) <= F.array_min(away) + 1e-6).alias("nearest"),
        (F.col("off") < 1e-6).alias("at_mean"),
    )


@query(f"""WITH {sql.SERIES} SELECT a.item, a.week, {sql.r4('a.target', 'y')}, {sql.r4('b.target', 'y_hat')}
  FROM base a JOIN base b ON a.item = b.item AND a.week = b.week + 364
  WHERE a.week BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""")
def snaive52_val(spark, sf):
    held = evaluation.between(calendar_naive(panel(spark, sf)), "2000-01-01", "2000-12-31")
    return rounded(held, "y", "y_hat")


@query(f"""WITH {sql.TX} SELECT item, date, CAST(date_trunc('week', date) AS DATE) AS week, count(*) AS rows
  FROM tx WHERE item = 'hot bolt' GROUP BY 1, 2, 3""")
def one_item(spark, sf):
    rows = transactions(spark, sf).where(F.col("item") == "hot bolt")
    return rows.groupBy("item", "date", week_of(F.col("date")).alias("week")).agg(F.count("*").alias("rows"))
