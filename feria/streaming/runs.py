"""Runs and prices as keyed state of a stream: failures in a row with a rest that a timer ends, and a listing's last price
and running figures, which every price is judged by before it is added to them."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from feria.schemas import RULES, Rules

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN_STATE = "store_id long, run_id string, at timestamp, failures int, quarantined boolean, until timestamp, event string"


def _utc(at: datetime) -> datetime:
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


class Quarantine(StatefulProcessor):
    """State of a store: its failures in a row and until when it rests."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("store", "failures int, until timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        failures, until = self.state.get() or (0, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["finished_at", "run_id"]).itertuples(index=False):
            failures = 0 if r.ok else failures + 1
            rests = failures >= self.rules.quarantine_failures
            if rests:
                until = r.finished_at.to_pydatetime() + timedelta(hours=self.rules.quarantine_hours)
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(int(_utc(until).timestamp() * 1000))
            out.append((key[0], r.run_id, r.finished_at, failures, rests, until if rests else None, "run"))
        self.state.update((failures, until))
        yield pd.DataFrame(out, columns=["store_id", "run_id", "at", "failures", "quarantined", "until", "event"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        failures, until = self.state.get() or (0, None)
        yield pd.DataFrame([(key[0], None, until, failures, False, None, "released")], columns=["store_id", "run_id", "at", "failures", "quarantined", "until", "event"])

    def close(self) -> None:
        pass


def run_states(runs: DataFrame, rules: Rules = RULES, delay: str = "0 seconds") -> DataFrame:
    """A stream of runs (store_id long, run_id, finished_at, ok) as RUN_STATE: a row for each run with the failures in a
    row after it, and until when the store rests if they are too many; and a row `released` when the watermark passes the
    end of a rest. The state store must be RocksDB (ROCKS). Within a micro-batch a store's runs go by their end."""
    stream = runs.select("store_id", "run_id", "finished_at", "ok").withWatermark("finished_at", delay)
    return stream.groupBy("store_id").transformWithStateInPandas(Quarantine(rules), RUN_STATE, "Append", "EventTime")


def run_history(runs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The same as `run_states` says of runs, recomputed from all runs of a table at once."""
    order = Window.partitionBy("store_id").orderBy("finished_at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = runs.withColumn("good", F.count_if("ok").over(order))
    since = Window.partitionBy("store_id", "good").orderBy("finished_at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("failures", F.count_if(~F.col("ok")).over(since).cast("int"))
    rests = F.col("failures") >= rules.quarantine_failures
    until = F.when(rests, F.col("finished_at") + F.make_dt_interval(hours=F.lit(rules.quarantine_hours)))
    return rows.select("store_id", "run_id", F.col("finished_at").alias("at"), "failures", rests.alias("quarantined"), until.alias("until"))


PRICE_STATE = "sku_id long, captured_at timestamp, price long, previous long, n int, suspect boolean"


class Prices(StatefulProcessor):
    """State of a listing: its last unsuspected price, and number, mean and squared deviations of those so far."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("listing", "last long, n int, mean double, m2 double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        last, n, mean, m2 = self.state.get() or (None, 0, 0.0, 0.0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["captured_at", "price"]).itertuples(index=False):
            jump = bool(last) and abs(r.price - last) / last * 100 > self.rules.suspect_pct
            spread = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
            far = n >= self.rules.suspect_n and spread > 0 and abs(r.price - mean) / spread > self.rules.suspect_z
            other = None if pd.isna(r.median_other) else r.median_other
            ratio = max(r.price, other) / min(r.price, other) if other else 0.0
            apart = bool(other) and max(r.price, other) >= self.rules.outlier_min_ref * 100 and ratio > self.rules.outlier_ratio
            suspect = bool(jump or far or apart)
            out.append((key[0], r.captured_at, r.price, last, n, suspect))
            if not suspect:
                last, n = int(r.price), n + 1
                step = r.price - mean
                mean += step / n
                m2 += step * (r.price - mean)
        self.state.update((last, n, mean, m2))
        yield pd.DataFrame(out, columns=["sku_id", "captured_at", "price", "previous", "n", "suspect"])

    def close(self) -> None:
        pass


def judged_prices(prices: DataFrame, rules: Rules = RULES) -> DataFrame:
    """A stream of prices (sku_id long, captured_at, price long in cents, median_other double: of the product's other stores,
    or null) as PRICE_STATE: each price beside the last unsuspected one, and whether it is suspect, by a jump, by its distance
    from the listing's mean, or by the other stores. Unlike a run's check against what stood before it, state advances with
    every price. The state store must be RocksDB (ROCKS)."""
    stream = prices.select("sku_id", "captured_at", "price", "median_other")
    return stream.groupBy("sku_id").transformWithStateInPandas(Prices(rules), PRICE_STATE, "Append", "None")
