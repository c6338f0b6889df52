"""Request-log queries."""

from pyspark.sql import functions as F

from routeloom.operators import reqlog
from routeloom.plans.registry import query


@query(
    "error_window",
    """SELECT event_id, round(rate, 6) AS rate, seen, seen >= 20 AND rate >= 0.30 AS flagged FROM (
  SELECT event_id, avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0.0 END) OVER w AS rate, count(*) OVER w AS seen
  FROM attempt WHERE NOT invalid
  WINDOW w AS (PARTITION BY route ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
    ("attempt",),
)
def error_window(v):
    got = reqlog.error_window(v.attempt.select("event_id", "ts", "route", "status", "invalid"))
    return got.select("event_id", F.round("rate", 6).alias("rate"), "seen", "flagged")


@query(
    "failure_runs",
    """WITH g AS (SELECT *, sum(CASE WHEN status = 'accepted' THEN 1 ELSE 0 END) OVER (PARTITION BY route
  ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island FROM attempt),
n AS (SELECT route, coalesce(island, 0) AS island, count(*) FILTER (WHERE status = 'failed') AS fails FROM g GROUP BY ALL)
SELECT event_id, least(fails, 10) AS failures_before FROM g JOIN n ON g.route = n.route AND coalesce(g.island, 0) = n.island
WHERE status = 'accepted'""",
    ("attempt",),
)
def failure_runs(v):
    return reqlog.failure_runs(v.attempt.select("event_id", "ts", "route", "status")).select("event_id", "failures_before")


@query(
    "latency_ewma",
    """WITH e AS (SELECT route, phase, count(*) AS samples,
  list_reduce(list(latency ORDER BY ts, event_id), lambda e, x: 0.8 * e + 0.2 * x) AS ewma
  FROM attempt WHERE status = 'accepted' GROUP BY route, phase),
b AS (SELECT phase, min(ewma) AS best FROM e WHERE samples >= 8 GROUP BY phase)
SELECT route, e.phase, samples, round(ewma, 6) AS ewma, coalesce(samples >= 8 AND ewma > 1.8 * best, false) AS slow
FROM e LEFT JOIN b ON b.phase = e.phase""",
    ("attempt",),
)
def latency_ewma(v):
    got = reqlog.latency_ewma(v.attempt.select("event_id", "ts", "route", "phase", "status", "latency"))
    return got.select("route", "phase", "samples", F.round("ewma", 6).alias("ewma"), "slow")


@query(
    "route_health_summary",
    """WITH r AS (SELECT route, avg(CASE WHEN status = 'accepted' THEN 1.0 ELSE 0.0 END) AS rate FROM (
  SELECT *, row_number() OVER (PARTITION BY route ORDER BY ts DESC, event_id DESC) AS n FROM attempt WHERE NOT invalid)
  WHERE n <= 20 GROUP BY route)
SELECT a.route, count(*) AS attempts, count(*) FILTER (WHERE status = 'accepted') AS successes,
  count(*) FILTER (WHERE status = 'failed') AS failures,
  arg_max(error, (ts, event_id)) FILTER (WHERE status = 'failed') AS last_failure,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS last_at, greatest(0.1, coalesce(any_value(rate), 1.0)) AS recent_success_rate
FROM attempt a LEFT JOIN r ON r.route = a.route GROUP BY a.route""",
    ("attempt",),
)
def route_health_summary(v):
    from routeloom.functions import text as tx

    return reqlog.route_health(v.attempt).withColumn("last_at", tx.utc_iso(F.col("last_at")))


@query(
    "attempt_history",
    """SELECT call_id, count(*) AS attempts, arg_max(status, attempt) AS last_status,
  CASE WHEN count(*) FILTER (WHERE status = 'accepted') = 0 THEN count(*) FILTER (WHERE status = 'failed')
    ELSE min(attempt) FILTER (WHERE status = 'accepted') - 1 END AS failures_before,
  count(*) FILTER (WHERE status = 'accepted') = 0 AND count(*) >= 3 AS gave_up FROM attempt GROUP BY call_id""",
    ("attempt",),
)
def attempt_history(v):
    return reqlog.attempt_history(v.attempt).select("call_id", "attempts", "last_status", "failures_before", "gave_up")


@query(
    "retry_candidates",
    """SELECT call_id, cap, n AS attempts, CASE WHEN n < cap THEN 'retry' ELSE 'exhausted' END AS state, CASE WHEN n < cap THEN coalesce(last_error, '') END AS feedback FROM (
  SELECT call_id, count(*) AS n, last(error ORDER BY attempt) AS last_error FROM attempt GROUP BY call_id HAVING count(*) FILTER (WHERE status = 'accepted') = 0),
  (SELECT unnest([3, 4]) AS cap)""",
    ("attempt",),
)
def retry_candidates(v):
    """All attempts of all calls, under a limit of three (calls with three are exhausted) and of four."""
    caps = [reqlog.retry_candidates(v.attempt, cap).withColumn("cap", F.lit(cap)) for cap in (3, 4)]
    return caps[0].unionByName(caps[1])


@query(
    "usage_rollup",
    """SELECT route, call_id, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(c)::DOUBLE, 4) AS cost, sum(n)::BIGINT AS attempts,
  round(avg(i), 6) AS mean_input_tokens, round(avg(o), 6) AS mean_output_tokens, round(avg(c::DOUBLE), 6) AS mean_cost FROM (
  SELECT route, call_id, sum(coalesce(tokens, 0)) AS i, sum(CASE WHEN status = 'accepted' THEN coalesce(tokens % 17, 0) ELSE 0 END) AS o,
    sum(coalesce(tokens, 0) * 0.0020::DECIMAL(10, 4)) AS c, count(*) AS n FROM attempt GROUP BY route, call_id)
GROUP BY ROLLUP (route, call_id)""",
    ("attempt",),
)
def usage_rollup(v):
    """Input tokens and cost of every attempt, output tokens of accepted ones; failed attempts report none."""
    output = F.when(F.col("status") == "accepted", F.col("tokens") % 17)
    cost = F.col("tokens").cast("decimal(10,0)") * F.lit("0.0020").cast("decimal(10,4)")
    log = v.attempt.withColumns({"input_tokens": F.col("tokens"), "output_tokens": output, "cost": cost})
    got = reqlog.usage_rollup(log)
    means = {f"mean_{m}": F.round(f"mean_{m}", 6) for m in reqlog.MEASURES}
    return got.withColumns({"cost": F.round(F.col("cost").cast("double"), 4), **means})
