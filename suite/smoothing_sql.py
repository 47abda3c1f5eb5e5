"""The smoothing models as recursive SQL, with the same parameter search.

A recursion walks over the weeks of every training series, once per parameter point; the
last 52 seasonal values travel along as a list, the current one first.
"""

from __future__ import annotations

from itertools import product

from marketweek.functions.smoothing import ALPHAS, BETAS, GAMMA_SHARES, REACH, REFINEMENTS
from marketweek.operators.baselines import HOLT_ALPHAS, HOLT_BETAS
from suite import sql

TRAIN = """
train AS (
  SELECT f.item, f.fold, f.train_n, s.rn, s.target
  FROM folds f JOIN ser s ON s.item = f.item AND s.rn <= f.train_n
)"""


def values(rows, columns: str) -> str:
    cells = ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {cells}) AS t({columns})"


def start_states(multiplicative: bool, name: str) -> str:
    """Level, trend and season before the first week, from the first two seasons."""
    detached = "target / line" if multiplicative else "target - line"
    centred = "x / list_avg(s)" if multiplicative else "x - list_avg(s)"
    guard = "AND min(target) > 0" if multiplicative else ""
    return f"""
{name}_means AS (
  SELECT item, fold, train_n, avg(target) FILTER (rn <= 52) AS m1,
         avg(target) FILTER (rn > 52 AND rn <= 104) AS m2
  FROM train GROUP BY ALL HAVING train_n >= 104 {guard}
),
{name}_lines AS (
  SELECT item, fold, train_n, (m2 - m1) / 52 AS trend, m1 - (m2 - m1) / 52 * 53 / 2 AS level
  FROM {name}_means
),
{name}_heads AS (
  SELECT item, fold, train_n, level, trend, (rn - 1) % 52 AS slot, avg({detached}) AS v FROM (
    SELECT l.*, t.rn, t.target, l.level + l.trend * t.rn AS line
    FROM {name}_lines l JOIN train t USING (item, fold, train_n) WHERE t.rn <= 104
  ) GROUP BY ALL
),
{name}_lists AS (
  SELECT item, fold, train_n, level, trend, list(v ORDER BY slot) AS s FROM {name}_heads GROUP BY ALL
),
{name}_start AS (
  SELECT item, fold, train_n, level, trend, list_transform(s, lambda x: {centred}) AS season
  FROM {name}_lists
)"""


def walk(multiplicative: bool, name: str, points: str, depth: int) -> str:
    """Run every parameter point of ``points(item, fold, alpha, beta, share)`` to the end."""
    if multiplicative:
        fitted, gain, season = "base * s1", "alpha * e / s1", "s1 + share * (1 - alpha) * e / base"
    else:
        fitted, gain, season = "base + s1", "alpha * e", "s1 + share * (1 - alpha) * e"
    return f"""
{name}_walk{depth}(item, fold, alpha, beta, share, train_n, rn, sse, level, trend, season) AS (
  SELECT item, fold, alpha, beta, share, train_n, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), level, trend, season
  FROM {name}_start JOIN ({points}) p USING (item, fold)
  UNION ALL
  SELECT item, fold, alpha, beta, share, train_n, rn, sse + e * e, base + {gain}, trend + beta * {gain},
         list_append(season[2:], {season})
  FROM (
    SELECT *, target - ({fitted}) AS e FROM (
      SELECT w.item, w.fold, w.alpha, w.beta, w.share, w.train_n, w.rn + 1 AS rn, w.sse, w.trend,
             w.season, t.target, w.level + w.trend AS base, w.season[1] AS s1
      FROM {name}_walk{depth} w JOIN train t
        ON t.item = w.item AND t.fold = w.fold AND t.rn = w.rn + 1
    )
  )
)"""


def searched(multiplicative: bool, name: str, refinements: int = REFINEMENTS) -> str:
    """Grid, then rounds of a halved neighbourhood around the best point so far."""
    grid = values(product(ALPHAS, BETAS, GAMMA_SHARES), "alpha, beta, share")
    offsets = values(product((-1.0, 0.0, 1.0), repeat=3), "da, db, ds")
    parts = [start_states(multiplicative, name)]
    points = f"SELECT item, fold, alpha, beta, share FROM {name}_start CROSS JOIN ({grid})"
    for depth in range(refinements + 1):
        parts.append(walk(multiplicative, name, points, depth))
        earlier = f"UNION ALL SELECT *, 0 AS age FROM {name}_best{depth - 1}" if depth else ""
        parts.append(f"""
{name}_best{depth} AS (
  SELECT * EXCLUDE (age, r) FROM (
    SELECT *, row_number() OVER (PARTITION BY item, fold ORDER BY sse, age) AS r FROM (
      SELECT *, 1 AS age FROM {name}_walk{depth} WHERE rn = train_n {earlier}
    )
  ) WHERE r = 1
)""")
        a, b, s = (r / 2**depth for r in REACH)
        points = f"""
      SELECT DISTINCT item, fold, greatest(1e-4, least(0.9999, alpha + da * {a!r})) AS alpha,
             greatest(0, least(1, beta + db * {b!r})) AS beta,
             greatest(0, least(1, share + ds * {s!r})) AS share
      FROM {name}_best{depth} CROSS JOIN ({offsets})"""
    return ",".join(parts)


def trend_only(name: str = "holt") -> str:
    """Trend without season for histories below two seasons."""
    grid = values(product(HOLT_ALPHAS, HOLT_BETAS), "alpha, beta")
    return f"""
{name}_walk(item, fold, alpha, beta, train_n, rn, sse, level, trend) AS (
  SELECT item, fold, alpha, beta, train_n, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), level, trend
  FROM (
    SELECT item, fold, train_n, regr_intercept(target, rn) FILTER (rn <= 10) AS level,
           regr_slope(target, rn) FILTER (rn <= 10) AS trend
    FROM train GROUP BY ALL HAVING train_n < 104
  ) CROSS JOIN ({grid})
  UNION ALL
  SELECT item, fold, alpha, beta, train_n, rn, sse + e * e, level + trend + alpha * e, trend + alpha * beta * e
  FROM (
    SELECT w.item, w.fold, w.alpha, w.beta, w.train_n, w.rn + 1 AS rn, w.sse, w.level, w.trend,
           t.target - w.level - w.trend AS e
    FROM {name}_walk w JOIN train t ON t.item = w.item AND t.fold = w.fold AND t.rn = w.rn + 1
  )
),
{name}_best AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY item, fold ORDER BY sse, alpha, beta) AS r
    FROM {name}_walk WHERE rn = train_n
  ) WHERE r = 1
)"""


def all_models() -> str:
    """``every`` holds the predictions of all five models for all folds."""
    return f"""RECURSIVE {sql.MODELS}, {TRAIN}, {searched(False, 'hwadd')}, {searched(True, 'hwmul')}, {trend_only()},
smoothed AS (
  SELECT z.*, coalesce(t.level + z.h * t.trend, a.level + z.h * a.trend + a.season[z.h]) AS y_add,
         coalesce(t.level + z.h * t.trend, (m.level + z.h * m.trend) * m.season[z.h]) AS y_mul
  FROM horizon z
  LEFT JOIN holt_best t ON t.item = z.item AND t.fold = z.fold
  LEFT JOIN hwadd_best{REFINEMENTS} a ON a.item = z.item AND a.fold = z.fold
  LEFT JOIN hwmul_best{REFINEMENTS} m ON m.item = z.item AND m.fold = z.fold
),
every AS (
  SELECT * FROM preds
  UNION ALL SELECT * EXCLUDE (y_add, y_mul), 'HW-Add' AS model, y_add AS yhat FROM smoothed
  UNION ALL SELECT * EXCLUDE (y_add, y_mul), 'HW-Mul' AS model, coalesce(y_mul, y_add) AS yhat FROM smoothed
)"""


def all_scores() -> str:
    """Fold scores and the ranked board over all five models."""
    scores = sql.SCORES.removeprefix(sql.MODELS).replace("FROM preds", "FROM every")
    return all_models() + scores
