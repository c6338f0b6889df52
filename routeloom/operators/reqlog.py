"""Request-log health: attempts, usage, error windows, failure runs, latency averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from routeloom.operators import ordered

ORDER = ["ts", "event_id"]


def outcomes(log: DataFrame) -> DataFrame:
    """Outcomes that count for health: a contract failure says nothing about the route."""
    return log.where(~F.col("invalid"))


def error_window(
    log: DataFrame, route: str = "route", window: int = 20, min_samples: int = 20, threshold: float = 0.30
) -> DataFrame:
    """Failure rate over the last ``window`` outcomes per route, flagged when high."""
    placed = ordered.positions(outcomes(log), [route], ORDER, "pos")
    failed = (F.col("status") == "failed").cast("double")
    got = ordered.trailing(
        placed, [route], "pos", window - 1, 0, {"rate": F.avg(failed), "seen": F.count(F.lit(1))}
    )
    return got.withColumn("flagged", (F.col("seen") >= min_samples) & (F.col("rate") >= threshold))


def failure_runs(log: DataFrame, route: str = "route", cap: int = 10) -> DataFrame:
    """Consecutive failures before each success (counted up to ``cap``)."""
    placed = ordered.positions(log, [route], ORDER, "pos")
    wins = placed.where("status = 'accepted'")
    prior = ordered.running(wins, [route], ["pos"], {"last_win": ("max", F.col("pos"), False)})
    run = F.col("pos") - F.coalesce("last_win", F.lit(0)) - 1
    return prior.withColumn("failures_before", F.least(run, F.lit(cap)))


def latency_ewma(
    log: DataFrame,
    keys: tuple[str, str] = ("route", "phase"),
    decay: float = 0.8,
    min_samples: int = 8,
    slow_ratio: float = 1.8,
) -> DataFrame:
    """Final moving average of accepted latencies per (route, phase).

    The recurrence ``e = decay*e + (1-decay)*x`` with ``e = x`` first is a weighted
    sum, so it is one mergeable aggregate over positions instead of an ordered fold.
    """
    wins = log.where("status = 'accepted'")
    placed = ordered.positions(wins, list(keys), ORDER, "pos")
    totals = wins.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    weight = F.pow(F.lit(decay), (F.col("samples") - F.col("pos")).cast("double")) * F.when(
        F.col("pos") == 1, 1.0
    ).otherwise(1.0 - decay)
    ewma = (
        placed.join(totals, list(keys))
        .groupBy(*keys)
        .agg(F.first("samples").alias("samples"), F.sum(weight * F.col("latency")).alias("ewma"))
    )
    best = ewma.where(F.col("samples") >= min_samples).groupBy(keys[1]).agg(F.min("ewma").alias("best"))
    slow = (F.col("samples") >= min_samples) & (F.col("ewma") > slow_ratio * F.col("best"))
    return ewma.join(best, keys[1], "left").withColumn("slow", F.coalesce(slow, F.lit(False)))


def route_health(log: DataFrame, recent: int = 20, floor: float = 0.1) -> DataFrame:
    """Per route: attempts, outcomes, recent success rate, last failure and last time."""
    totals = log.groupBy("route").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("status") == "accepted").alias("successes"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.max_by(
            F.when(F.col("status") == "failed", F.substring("error", 1, 500)),
            F.when(F.col("status") == "failed", F.struct("ts", "event_id")),
        ).alias("last_failure"),
        F.max("ts").alias("last_at"),
    )
    last = ordered.top_k(outcomes(log), ["route"], [F.desc("ts"), F.desc("event_id")], recent, "_n")
    rate = last.groupBy("route").agg(F.avg((F.col("status") == "accepted").cast("double")).alias("_rate"))
    return totals.join(rate, "route", "left").withColumn(
        "recent_success_rate", F.greatest(F.lit(floor), F.coalesce("_rate", F.lit(1.0)))
    ).drop("_rate")


def attempt_history(log: DataFrame, limit: int = 3) -> DataFrame:
    """Per call: attempts, last status, failures before the first accepted one, given up or not."""
    first_ok = F.min(F.when(F.col("status") == "accepted", F.col("attempt")))
    calls = log.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max_by("status", "attempt").alias("last_status"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        first_ok.alias("accepted_at"),
        F.max_by("error", "attempt").alias("last_error"),
    )
    return calls.withColumn(
        "gave_up", F.col("accepted_at").isNull() & (F.col("attempts") >= limit)
    ).withColumn("failures_before", F.coalesce(F.col("accepted_at") - 1, F.col("failures")))


def retry_candidates(log: DataFrame, limit: int = 3) -> DataFrame:
    """Calls never accepted: to be asked again with the last error as feedback, or given up at the limit."""
    calls = attempt_history(log, limit).where(F.col("accepted_at").isNull())
    state = F.when(F.col("attempts") < limit, "retry").otherwise("exhausted")
    return calls.select("call_id", "attempts", state.alias("state"), F.when(state == "retry", F.coalesce("last_error", F.lit(""))).alias("feedback"))


MEASURES = ("input_tokens", "output_tokens", "cost")


def usage_rollup(log: DataFrame, run: str = "route", call: str = "call_id") -> DataFrame:
    """Input and output tokens and cost of accepted and failed attempts: per call, per run and in all, with means per call.

    A missing measure counts as 0.  Cost is summed exactly where it is a decimal.
    """
    zero = lambda m: F.coalesce(F.col(m), F.lit(0).cast(log.schema[m].dataType))
    per_call = log.groupBy(run, call).agg(*[F.sum(zero(m)).alias(m) for m in MEASURES], F.count(F.lit(1)).alias("attempts"))
    sums = [F.sum(m).alias(m) for m in (*MEASURES, "attempts")]
    means = [F.avg(F.col(m).cast("double")).alias(f"mean_{m}") for m in MEASURES]
    return per_call.rollup(run, call).agg(F.count(F.lit(1)).alias("calls"), *sums, *means)


def compact_payload(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Text columns cut to the stated number of characters (0 empties a column); others stay."""
    cut = {c: F.substring(F.col(c), 1, n) if n else F.when(F.col(c).isNotNull(), F.lit("")) for c, n in limits.items()}
    return rows.withColumns(cut)
