"""Request health over a stream of attempts, with Spark's own stateful operator.

Attempts may arrive out of order.  They wait in the state of their key until the watermark
has passed them and are then taken in event order, so the rows are those of the batch
operators on the whole log.  What is kept per key is bounded: the waiting rows (those within
the watermark's delay), the last outcomes and a few numbers.  Results go to append-only
tables; after a restart the query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from routeloom.session import ship_package

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HEALTH = "event_id long, route string, ts timestamp, rate double, seen long, flagged boolean, failures_before int"
LATENCY = "route string, phase string, samples long, ewma double"
SLOW = "phase string, route string, turn long, samples long, ewma double, best double, slow boolean"


class _Ordered(StatefulProcessor):
    """Rows of a key in event order; ``take`` gets those that the watermark has passed, sorted by time and id."""

    WAITING = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.prepare(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for part in rows:
            if any(pd.isna(k) for k in key):
                continue
            part = part.dropna(subset=["ts", "event_id"])
            values = [v for r in part.itertuples(index=False) if (v := self.pack(r)) is not None]
            if values:
                self.waiting.appendList(values)
                newest = max(v[0] for v in values)
                last = newest if last is None else max(last, newest)
        if last is not None:
            # a timer is due once the watermark is past its time, in microseconds rounded up
            self.handle.registerTimer(-(-last // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] <= passed]
        rest = rows[len(due) :]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if due:
            yield self.take(key, due)

    def close(self) -> None:
        pass


def _micros(ts) -> int:
    return int(pd.Timestamp(ts).value // 1000)


class RouteHealth(_Ordered):
    """Failure rate over the last outcomes and failures before each success, per route."""

    WAITING = "ts long, event_id long, status string, invalid boolean"

    def __init__(self, window: int = 20, min_samples: int = 20, threshold: float = 0.30, cap: int = 10):
        self.window, self.min_samples, self.threshold, self.cap = window, min_samples, threshold, cap

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "failed boolean")
        self.run = handle.getValueState("run", "failures int")

    def pack(self, r) -> tuple:
        return _micros(r.ts), int(r.event_id), r.status, bool(r.invalid)

    def take(self, key, due: list[tuple]) -> pd.DataFrame:
        run = self.run.get()[0] if self.run.exists() else 0
        before = np.array([x[0] for x in self.recent.get()], bool) if self.recent.exists() else np.zeros(0, bool)
        counts = np.array([not invalid for *_, invalid in due])
        failed = np.array([status == "failed" for _, _, status, _ in due])
        # a contract failure says nothing about the route, but it is a failure before the next success
        outcomes = np.concatenate([before, failed[counts]])
        upto = np.concatenate([[0], np.cumsum(outcomes)])
        end = len(before) + np.cumsum(counts)
        start = np.maximum(end - self.window, 0)
        seen = end - start
        rate = np.divide(upto[end] - upto[start], seen, out=np.zeros(len(due)), where=seen > 0)
        runs: list[int | None] = []
        for _, _, status, _ in due:
            won = status == "accepted"
            runs.append(run if won else None)
            run = 0 if won else min(run + 1, self.cap)
        self.run.update((run,))
        kept = outcomes[-(self.window - 1) :] if self.window > 1 else outcomes[:0]
        if len(kept):
            self.recent.put([(bool(x),) for x in kept])
        flagged = (seen >= self.min_samples) & (rate >= self.threshold)
        out = pd.DataFrame({"event_id": [r[1] for r in due], "route": key[0], "ts": pd.to_datetime([r[0] for r in due], unit="us")})
        for name, values in (("rate", rate), ("seen", seen), ("flagged", flagged)):
            out[name] = [x if c else None for x, c in zip(values.tolist(), counts)]
        out["failures_before"] = runs
        return out.astype({"seen": "Int64", "flagged": "boolean", "failures_before": "Int32"})


class LatencyAverage(_Ordered):
    """Moving average of accepted latencies per (route, phase); one row per release."""

    WAITING = "ts long, event_id long, latency double"

    def __init__(self, decay: float = 0.8):
        self.decay = decay

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.average = handle.getValueState("average", "samples long, ewma double")

    def pack(self, r) -> tuple | None:
        won = r.status == "accepted" and not pd.isna(r.latency)
        return (_micros(r.ts), int(r.event_id), float(r.latency)) if won else None

    def take(self, key, due: list[tuple]) -> pd.DataFrame:
        samples, ewma = self.average.get() if self.average.exists() else (0, 0.0)
        for _, _, latency in due:
            ewma = latency if samples == 0 else self.decay * ewma + (1 - self.decay) * latency
            samples += 1
        self.average.update((samples, ewma))
        return pd.DataFrame({"route": [key[0]], "phase": [key[1]], "samples": [samples], "ewma": [ewma]})


class SlowRoutes(StatefulProcessor):
    """The latest averages of a phase, its best route and who is slow; one row per route at each change."""

    def __init__(self, min_samples: int = 8, slow_ratio: float = 1.8):
        self.min_samples, self.slow_ratio = min_samples, slow_ratio

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.routes = handle.getMapState("routes", "route string", "samples long, ewma double")
        self.turns = handle.getValueState("turns", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for r in part.itertuples(index=False):
                known = self.routes.getValue((r.route,)) if self.routes.containsKey((r.route,)) else None
                if known is None or known[0] < r.samples:
                    self.routes.updateValue((r.route,), (int(r.samples), float(r.ewma)))
        turn = 1 + (self.turns.get()[0] if self.turns.exists() else 0)
        self.turns.update((turn,))
        now = [(k[0], *v) for k, v in self.routes.iterator()]
        fit = [e for _, n, e in now if n >= self.min_samples]
        best = min(fit) if fit else None
        slow = [n >= self.min_samples and e > self.slow_ratio * best for _, n, e in now]
        yield pd.DataFrame(
            {"phase": key[0], "route": [r for r, _, _ in now], "turn": turn, "samples": [n for _, n, _ in now], "ewma": [e for _, _, e in now], "best": best, "slow": slow}
        ).astype({"best": "float64"})

    def close(self) -> None:
        pass


def route_health_stream(attempts: DataFrame, window: int = 20, min_samples: int = 20, threshold: float = 0.30, cap: int = 10) -> DataFrame:
    """``HEALTH`` rows of a stream with a watermark on ``ts``: the rows of ``error_window`` and ``failure_runs``.

    ``rate``, ``seen`` and ``flagged`` are null for contract failures, ``failures_before`` for
    all but successes.  Rows without a time, id or route are left out, but move the watermark
    on; they are dropped behind it, as a filter would be applied before it.
    """
    ship_package(attempts.sparkSession)
    rows = attempts.select("route", "ts", "event_id", "status", F.coalesce("invalid", F.lit(False)).alias("invalid"))
    return rows.groupBy("route").transformWithStateInPandas(RouteHealth(window, min_samples, threshold, cap), HEALTH, "Append", "EventTime")


def latency_stream(attempts: DataFrame, decay: float = 0.8, min_samples: int = 8, slow_ratio: float = 1.8) -> DataFrame:
    """``SLOW`` rows, in two stateful steps: averages per (route, phase), then their comparison per phase.

    At each change of a phase all of its routes are told again, with the next ``turn``; the
    last rows are those of ``latency_ewma``.  What a phase holds is one row per route.
    """
    ship_package(attempts.sparkSession)
    keyed = attempts.select("route", "phase", "ts", "event_id", "status", "latency").groupBy("route", "phase")
    averages = keyed.transformWithStateInPandas(LatencyAverage(decay), LATENCY, "Append", "EventTime")
    return averages.groupBy("phase").transformWithStateInPandas(SlowRoutes(min_samples, slow_ratio), SLOW, "Append", "None")


def start(rows: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the stream's rows to ``out``; the state lives in ``checkpoint``, from which a restart goes on."""
    spark = rows.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)  # a stream keeps the settings it was started with
    try:
        writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def latest(told: DataFrame) -> DataFrame:
    """The last row of each (phase, route) that ``latency_stream`` told."""
    last = told.groupBy("phase", "route").agg(F.max_by(F.struct("samples", "ewma", "best", "slow"), "turn").alias("r"))
    return last.select("phase", "route", "r.samples", "r.ewma", "r.best", "r.slow")
