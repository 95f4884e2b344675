"""DuckDB SQL for the derived views (same definitions as ``views.py``).

``with_views(sql, *names)`` prefixes a query with the CTEs it needs, in
dependency order.  The base tables are the driver's pre-registered views.
"""

from __future__ import annotations

CTE = {
    "hourly_agg": """
  SELECT date_trunc('hour', ts) AS hour_ts, count(*) AS n,
         count(*) FILTER (WHERE event_type IN ('view', 'click')) AS casual,
         avg(value) AS avg_value
  FROM events GROUP BY 1""",
    "hourly": """
  SELECT s.hour_ts, CAST(date_diff('hour', b.lo, s.hour_ts) AS BIGINT) AS hour_idx,
         coalesce(a.n, 0) AS n, coalesce(a.casual, 0) AS casual,
         coalesce(a.n, 0) - coalesce(a.casual, 0) AS registered, a.avg_value
  FROM (SELECT min(hour_ts) AS lo, max(hour_ts) AS hi FROM hourly_agg) b,
       LATERAL (SELECT unnest(generate_series(b.lo, b.hi, INTERVAL 1 HOUR)) AS hour_ts) s
  LEFT JOIN hourly_agg a ON a.hour_ts = s.hour_ts""",
    "hourly_nulls": """
  SELECT hour_ts, hour_idx, CASE WHEN hour_idx % 50 <> 0 THEN n END AS n, casual, registered, avg_value
  FROM hourly""",
    "events_dirty": """
  SELECT event_id, ts, event_type,
         CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 499 = 0 THEN value * 200 ELSE value / 1000 END AS v,
         CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 20 = 0 THEN value * 5 ELSE value / 1000 END AS w
  FROM events""",
    "events_dup": """
  SELECT event_id, ts, user_id, event_type, value FROM events
  UNION ALL
  SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_id % 10 = 0""",
    "events_text_date": """
  SELECT event_id, CASE WHEN event_id % 100 = 0 THEN 'bad' ELSE CAST(ts AS VARCHAR) END AS ts_txt, value
  FROM events""",
    "naive_forecast": """
  SELECT hour_ts, hour_idx, CAST(n AS DOUBLE) AS y,
         CAST(lag(n, 24) OVER (ORDER BY hour_idx) AS DOUBLE) AS pred
  FROM hourly""",
    "events_text_num": """
  SELECT event_id, replace(CAST(value AS VARCHAR), '.', ',') AS value_txt,
         CASE WHEN event_id = 7 THEN 'n/a' ELSE replace(CAST(value AS VARCHAR), '.', ',') END AS amount_txt,
         event_type
  FROM events""",
    "rentals_events": """
  SELECT event_id, CASE WHEN event_id % 100 = 0 THEN 'bad' ELSE CAST(ts AS VARCHAR) END AS fecha,
         CAST(hour(ts) AS DOUBLE) AS hora,
         CAST(event_type IN ('view', 'click') AS BIGINT) AS u_casuales,
         1 - CAST(event_type IN ('view', 'click') AS BIGINT) AS u_registrados,
         CASE WHEN event_id % 50 <> 0 THEN 1.0::DOUBLE END AS total_alquileres,
         v AS sensacion_termica, w AS velocidad_viento
  FROM events_dirty""",
    "forecasts_long": """
  SELECT m.model, f.hour_ts, CAST(f.n AS DOUBLE) AS y,
         CAST(CASE m.model WHEN 'naive_lag_1' THEN f.l1 WHEN 'naive_lag_24' THEN f.l24
              WHEN 'naive_lag_168' THEN f.l168 WHEN 'rolling_mean_24' THEN f.r24 ELSE f.l8760 END AS DOUBLE) AS pred
  FROM (SELECT hour_ts, n, lag(n, 1) OVER w AS l1, lag(n, 24) OVER w AS l24, lag(n, 168) OVER w AS l168,
               lag(n, 8760) OVER w AS l8760,
               avg(n) OVER (ORDER BY hour_idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS r24
        FROM hourly WINDOW w AS (ORDER BY hour_idx)) f,
       (VALUES ('naive_lag_1'), ('naive_lag_24'), ('naive_lag_168'), ('rolling_mean_24'), ('naive_lag_8760')) m(model)""",
    "forecaster_metrics": """
  SELECT c.model, coalesce(s.n, 0) AS n, s.rmse, s.mae
  FROM (VALUES ('naive_lag_1'), ('naive_lag_24'), ('naive_lag_168'), ('rolling_mean_24'), ('naive_lag_8760')) c(model)
  LEFT JOIN (SELECT model, count(*) AS n, sqrt(avg((y - pred) * (y - pred))) AS rmse, avg(abs(y - pred)) AS mae
             FROM forecasts_long WHERE y IS NOT NULL AND pred IS NOT NULL GROUP BY model) s USING (model)""",
}

DEPS = {
    "forecasts_long": ["hourly"],
    "forecaster_metrics": ["forecasts_long"],
    "rentals_events": ["events_dirty"],
    "hourly": ["hourly_agg"],
    "hourly_nulls": ["hourly"],
    "naive_forecast": ["hourly"],
}


def _expand(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def with_views(sql: str, *names: str, extra: dict | None = None) -> str:
    """Prefix ``sql`` with ``WITH`` clauses for the named views (and theirs)."""
    parts = []
    for n in _expand(names):
        parts.append(f"{n} AS ({CTE[n]}\n)")
    for n, body in (extra or {}).items():
        parts.append(f"{n} AS ({body}\n)")
    if not parts:
        return sql
    body = sql.lstrip()
    if body[:4].upper() == "WITH":  # merge with the query's own WITH list
        return "WITH " + ",\n".join(parts) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + sql
