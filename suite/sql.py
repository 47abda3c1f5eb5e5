"""Common table expressions of the comparison SQL."""

from __future__ import annotations


def r4(expr: str, name: str | None = None) -> str:
    rounded = f"floor(({expr}) * 1e4 + 0.5013) / 1e4"
    return f"{rounded} AS {name or expr}"


TX = """
tx AS (
  SELECT p_name AS item, CAST(l_shipdate AS DATE) AS date,
         l_quantity AS qty_in, l_extendedprice AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

WEEKLY = (
    TX
    + """,
sums AS (
  SELECT item, CAST(date_trunc('week', date) AS DATE) AS week,
         CAST(sum(CAST(round(qty_in * 100) AS BIGINT)) AS DOUBLE) / 100 AS qty_in_week,
         CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / 100 AS amount_week
  FROM tx GROUP BY 1, 2
),
weekly AS (
  SELECT *, CASE WHEN qty_in_week > 0 AND amount_week > 0
                 THEN amount_week / qty_in_week END AS unit_price_week
  FROM sums
)"""
)

DAILY = """
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS precip,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS tmax
  FROM orders GROUP BY 1
),
weather AS (
  SELECT CAST(date_trunc('week', date) AS DATE) AS week,
         sum(precip) AS precip, avg(tmax) AS tmax
  FROM daily GROUP BY 1
)"""

WIDE = (
    TX
    + """,
wide AS (
  SELECT date, split_part(item, ' ', 2) AS grp, avg(amount / qty_in) AS price
  FROM tx GROUP BY 1, 2
)"""
)

SERIES = (
    WEEKLY
    + """,
base AS (SELECT item, week, unit_price_week AS target FROM weekly WHERE unit_price_week IS NOT NULL),
ser AS (
  SELECT item, week, target,
         row_number() OVER (PARTITION BY item ORDER BY week) AS rn,
         count(*) OVER (PARTITION BY item) AS n
  FROM base
)"""
)

FOLDS = (
    SERIES
    + """,
items AS (
  SELECT item, max(n) AS n, max(week) AS last_week FROM ser
  GROUP BY item HAVING max(n) >= greatest(52, max(n) // 2) + 4
),
folds AS (
  SELECT item, n, last_week, CAST(k AS INTEGER) AS fold, n - 4 * k AS train_n
  FROM items, range(0, 4) AS r(k)
  WHERE k = 0 OR n - 4 * k >= greatest(52, n // 2)
),
horizon AS (
  SELECT f.item, f.fold, f.train_n, g.h,
         CASE WHEN f.fold = 0 THEN f.last_week + CAST(7 * g.h AS INTEGER) ELSE s.week END AS week,
         CASE WHEN f.fold > 0 THEN s.target END AS actual
  FROM folds f CROSS JOIN range(1, 5) AS g(h)
  LEFT JOIN ser s ON s.item = f.item AND s.rn = f.train_n + g.h
)"""
)

MODELS = (
    FOLDS
    + """,
by_week AS (
  SELECT f.item, f.fold, weekofyear(s.week) AS wk, avg(s.target) AS m
  FROM folds f JOIN ser s ON s.item = f.item AND s.rn <= f.train_n GROUP BY 1, 2, 3
),
by_week_mean AS (SELECT item, fold, avg(m) AS m FROM by_week GROUP BY 1, 2),
recent AS (
  SELECT f.item, f.fold, avg(s.target) AS m
  FROM folds f JOIN ser s ON s.item = f.item AND s.rn <= f.train_n AND s.rn > f.train_n - 8
  GROUP BY 1, 2
),
preds AS (
  SELECT z.*, 'SeasonalNaive' AS model, s.target AS yhat
  FROM horizon z JOIN ser s ON s.item = z.item AND s.rn =
    CASE WHEN z.train_n >= 52 THEN z.train_n - 52 + ((z.h - 1) % 52) + 1 ELSE z.train_n END
  UNION ALL
  SELECT z.*, 'WeekMean' AS model, coalesce(w.m, d.m) AS yhat
  FROM horizon z JOIN by_week_mean d ON d.item = z.item AND d.fold = z.fold
  LEFT JOIN by_week w ON w.item = z.item AND w.fold = z.fold AND w.wk = weekofyear(z.week)
  UNION ALL
  SELECT z.*, 'RollMean(8w)' AS model, r.m AS yhat
  FROM horizon z JOIN recent r ON r.item = z.item AND r.fold = z.fold
)"""
)

SCORES = (
    MODELS
    + """,
fold_scores AS (
  SELECT item, fold, train_n, model,
         sqrt(avg((actual - yhat) * (actual - yhat) ORDER BY h)) AS rmse,
         avg(abs(actual - yhat) ORDER BY h) AS mae,
         avg(abs((actual - yhat) / greatest(actual, 1e-9)) ORDER BY h) * 100 AS mape,
         avg(2 * abs(actual - yhat) / (abs(actual) + abs(yhat) + 1e-9) ORDER BY h) * 100 AS smape
  FROM preds WHERE fold > 0 GROUP BY 1, 2, 3, 4
),
board AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY smape, mae, model) AS rank FROM (
    SELECT item, model, avg(rmse ORDER BY fold DESC) AS rmse, avg(mae ORDER BY fold DESC) AS mae,
           avg(mape ORDER BY fold DESC) AS mape, avg(smape ORDER BY fold DESC) AS smape,
           count(*) AS n_folds
    FROM fold_scores GROUP BY 1, 2
  )
)"""
)

STATE = (
    MODELS
    + """,
changed AS (
  SELECT *, unit_price_week / lag(unit_price_week) OVER o - 1 AS change FROM weekly
  WINDOW o AS (PARTITION BY item ORDER BY week)
),
stats AS (
  SELECT item, week, unit_price_week,
         avg(qty_in_week) OVER (o ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS qty_rollmean4,
         CASE WHEN count(change) OVER (o ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) = 8
              THEN stddev_samp(change) OVER (o ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)
         END AS price_vol_8
  FROM changed WINDOW o AS (PARTITION BY item ORDER BY week)
),
state AS (
  SELECT s.item, split_part(s.item, ' ', 2) AS grp, s.unit_price_week, s.qty_rollmean4,
         s.price_vol_8, p.yhat AS pred_price
  FROM stats s JOIN preds p ON p.item = s.item AND p.fold = 0 AND p.h = 1 AND p.model = 'RollMean(8w)'
  WHERE s.week = (SELECT max(week) FROM weekly)
),
limits AS (
  SELECT grp, quantile_cont(qty_rollmean4, 0.5) AS supply_median,
         quantile_cont(price_vol_8, 0.75) AS vol_q3
  FROM state GROUP BY 1
),
ranked AS (
  SELECT a.grp, a.item, c.item AS substitute,
         (a.pred_price - c.pred_price) / a.pred_price AS saving_rate,
         c.price_vol_8, a.price_vol_8 AS own_vol_8,
         c.unit_price_week < a.unit_price_week AS accepted,
         row_number() OVER (PARTITION BY a.item ORDER BY
           (a.pred_price - c.pred_price) / a.pred_price DESC, c.price_vol_8, c.item) AS rank
  FROM state a JOIN state c ON a.grp = c.grp AND a.item <> c.item
  JOIN limits l ON l.grp = c.grp
  WHERE (a.pred_price - c.pred_price) / a.pred_price >= {threshold}
    AND c.qty_rollmean4 >= l.supply_median AND c.price_vol_8 <= l.vol_q3
),
suggestions AS (SELECT * FROM ranked WHERE rank <= 5)"""
)
