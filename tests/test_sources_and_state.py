"""Shops as data sources, runs and prices as state, the series by versions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feria.operators import prices, series
from feria.schemas import RULES
from feria.sources import adapter, model
from feria.streaming import runs


def test_shops(spark, tmp_path):
    """Pages of two shops in one table, a broken category beside good ones, a shop without a list, one without anything."""

    def page(category, n):
        if category == "bad" and n == 1:
            raise OSError("gone")
        return f"{category}{n}" if n < 2 else None

    def nowhere():
        raise OSError("no list")

    good, half = adapter.Shop("good", lambda: ["a", "b"], page), adapter.Shop("half", lambda: ["a", "bad"], page)
    rows = adapter.pages(spark, [good, half, adapter.Shop("empty", lambda: [], page), adapter.Shop("endless", lambda: ["z"], lambda c, n: "p", most_pages=3)])
    assert rows.where("store = 'good'").rdd.getNumPartitions() >= 2
    assert sorted(r.payload for r in rows.where("store = 'half' and error is null").collect()) == ["a0", "a1", "bad0"]
    got = {r.store: (r.pages, r.errors, r.broken) for r in adapter.arrivals(rows).collect()}
    assert got == {"good": (4, 0, []), "half": (3, 1, ["bad"]), "endless": (3, 0, [])}
    assert adapter.arrived(rows).count() == 10
    with pytest.raises(adapter.NothingArrived, match="lost: OSError"):
        adapter.arrived(adapter.pages(spark, [good, adapter.Shop("lost", nowhere, page)]))
    assert adapter.pages(spark, []).count() == 0


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, batches, schema, make):
    """Rows of a stream over files that come one after the other, in two queries over one checkpoint."""
    (tmp_path / "in").mkdir()
    out = tmp_path / "out"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = make(stream).writeStream.outputMode("append").format("parquet").option("path", str(out)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(out))


def test_quarantine_over_runs(rocks, tmp_path):
    """Failures in a row across two queries equal a recompute from all runs; a rest ends when time has passed it."""
    rng, start = random.Random(1), datetime(2026, 1, 1)
    rows = [(s, f"r{k:02}", start + timedelta(hours=k), rng.random() < (0.2 if s else 0.9)) for k in range(20) for s in range(3)]
    later = [(0, "z", start + timedelta(days=30), True)]
    schema = "store_id long, run_id string, finished_at timestamp, ok boolean"
    got = streamed(rocks, tmp_path, [rows[:24], rows[24:], later], schema, runs.run_states)
    want = runs.run_history(rocks.createDataFrame(rows + later, schema))
    told = lambda df: sorted((r.store_id, r.run_id, r.failures, r.quarantined, r.until) for r in df.collect())
    assert told(got.where("event = 'run'")) == told(want) and want.where("quarantined").count() > 3
    assert {r.store_id for r in got.where("event = 'released'").collect()} == {r.store_id for r in want.where("quarantined").collect()}


def test_prices_that_advance(rocks, tmp_path):
    """A listing's figures advance with every price, over two queries; jumps, distance and other stores make suspects."""
    at = lambda h: datetime(2026, 1, 1) + timedelta(hours=h)
    steady = [(1, at(h), 100_000 + 1000 * (h % 3), None) for h in range(8)]
    rows = [*steady, (2, at(0), 100_000, None), (2, at(1), 190_000, None), (3, at(0), 30_000_000, 5_000_000.0), (3, at(1), 5_000_000, 5_000_000.0)]
    more = [(1, at(9), 130_000, None), (1, at(10), 101_500, None), (2, at(2), 150_000, None)]
    got = streamed(rocks, tmp_path, [rows, more], "sku_id long, captured_at timestamp, price long, median_other double", runs.judged_prices).collect()
    told = {(r.sku_id, r.captured_at): (r.previous, r.n, r.suspect) for r in got}
    assert told[1, at(9)] == (101_000, 8, True) and told[1, at(10)] == (101_000, 8, False)
    assert told[2, at(1)] == (100_000, 1, True) and told[2, at(2)] == (100_000, 1, False)
    assert told[3, at(0)] == (None, 0, True) and told[3, at(1)] == (None, 0, False) and not any(told[1, at(h)][2] for h in range(8))


def test_series_by_versions(spark, tmp_path):
    """A late record brings its day back; other days keep their files; older versions can be read; a half one is not seen."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    home, start = f"file://{tmp_path}/series", datetime(2026, 1, 1, 10)
    rows = [(s, start + timedelta(days=d), False, 1000 * s + d, False) for s in (1, 2, 3) for d in range(5)]
    link = spark.createDataFrame([(s, 10 + s % 2, "auto") for s in (1, 2, 3)], "sku_id long, product_id long, status string")
    sku = spark.createDataFrame([(s, 7) for s in (1, 2, 3)], "sku_id long, store_id long")
    none = spark.createDataFrame([], "sku_id long, captured_at timestamp")

    def of(rows):
        price = spark.createDataFrame(rows, "sku_id long, captured_at timestamp, promo boolean, price long, suspect boolean")
        return model.Model(sku, sku, sku, sku, link, price, none, start + timedelta(days=9))

    told = lambda df: sorted((r.product_id, str(r.day), r.min_price, r.avg_price, r.records) for r in df.collect())
    assert series.read(spark, home).count() == 0 and series.refresh(of(rows), home) == 1
    assert told(series.read(spark, home)) == told(prices.daily_series(of(rows), RULES))
    late = [(1, start + timedelta(days=2, hours=3), False, 5, False), (2, start + timedelta(days=8), False, 6, False)]
    changed = spark.createDataFrame(late, "a long, captured_at timestamp, b boolean, c long, d boolean").select(F.to_date("captured_at").alias("day"))
    assert series.refresh(of(rows + late), home, changed) == 2
    assert told(series.read(spark, home)) == told(prices.daily_series(of(rows + late), RULES)) != told(series.read(spark, home, 1))
    assert {str(r.day): r.version for r in series.manifest(spark, home).collect()} == {"2026-01-01": 1, "2026-01-02": 1, "2026-01-03": 2, "2026-01-04": 1, "2026-01-05": 1, "2026-01-09": 2}
    assert sorted(p.name for p in (tmp_path / "series/data/version=2").glob("day=*")) == ["day=2026-01-03", "day=2026-01-09"]
    (tmp_path / "series/manifest/version=3").mkdir()
    assert series.versions(spark, home) == [1, 2]
    gone = [r for r in rows + late if r[1].day != 9]
    series.refresh(of(gone), home, changed)
    assert told(series.read(spark, home)) == told(prices.daily_series(of(gone), RULES))
