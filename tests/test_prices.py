"""Aggregates on a small scenario with known answers."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feria.operators import matching, prices, state
from feria.schemas import RULES
from feria.sources.model import Model

NOW = datetime(2026, 8, 24, 12)


@pytest.fixture(scope="module")
def model(spark):
    ago = lambda d=0, h=0: NOW - timedelta(days=d, hours=h)
    rows = [
        (11, ago(10), False, 200000, False),
        (11, ago(h=2), False, 150000, False),
        (12, ago(h=3), False, 160000, False),
        (12, ago(h=1), False, 120000, True),
        (13, ago(h=1), False, 10000, False),
        (21, ago(8), False, 900000, False),
        (32, ago(h=4), False, 180000, False),
        (32, ago(h=4), True, 170000, False),
        (41, ago(h=10), False, 180000, False),
        (41, ago(h=2), False, 150000, False),
        (41, ago(h=1), False, 60000, False),
    ]
    links = [(11, 1, "auto"), (12, 1, "auto"), (13, 1, "rejected"), (21, 2, "auto"), (32, 3, "auto"), (41, 4, "auto")]
    return Model(
        product=spark.createDataFrame([(i,) for i in range(1, 5)], "product_id bigint"),
        store=spark.createDataFrame([(1,), (2,), (3,)], "store_id bigint"),
        category=spark.createDataFrame([], "category_id int, path string"),
        sku=spark.createDataFrame([(s, s % 10) for s, _, _ in links], "sku_id bigint, store_id bigint"),
        link=spark.createDataFrame(links, "sku_id bigint, product_id bigint, status string"),
        price=spark.createDataFrame(rows, "sku_id bigint, captured_at timestamp, promo boolean, price bigint, suspect boolean"),
        correction=spark.createDataFrame([(41, ago(h=1))], "sku_id bigint, captured_at timestamp"),
        clock=NOW,
    )


def test_price_aggregate(model):
    got = {r.product_id: r for r in prices.price_aggregate(model).collect()}
    assert set(got) == {1, 3, 4}
    one, three, four = got[1], got[3], got[4]
    assert (one.best_price, one.best_store_id, one.stores) == (150000, 1, 2)
    assert (one.min_30d, one.avg_30d, one.pct_24h, one.pct_7d) == (150000, 170000, -25.0, -25.0)
    assert (three.best_price, three.avg_30d, three.pct_24h) == (170000, 175000, None)
    assert (four.min_all, four.avg_30d, four.pct_24h, four.pct_7d) == (150000, 165000, None, -16.67)


def test_refresh_is_idempotent(model):
    a = prices.price_aggregate(model)
    assert {r.change for r in prices.refresh(a, a).collect()} == {"same"}


def test_order_does_not_matter(model):
    shuffled = replace(model, price=model.price.repartition(5, F.rand(1)))
    assert sorted(map(tuple, prices.price_aggregate(shuffled).collect())) == sorted(map(tuple, prices.price_aggregate(model).collect()))


def test_daily_series_keeps_corrected(model):
    got = prices.daily_series(model).where("product_id = 4").collect()
    assert len(got) == 1 and got[0].min_price == 60000 and got[0].records == 3


@pytest.mark.parametrize(("best", "avg", "stores", "pct"), [(85000, 100000, 2, 15.0), (85100, 100000, 2, None), (20000, 100000, 2, None), (66700, 100000, 2, 33.3), (66700, 100000, 1, None)])
def test_deals(spark, best, avg, stores, pct):
    row = spark.createDataFrame([(1, best, avg, stores)], "product_id bigint, best_price bigint, avg_30d bigint, stores bigint")
    got = prices.deals(row).collect()
    assert [r.discount_pct for r in got] == ([pct] if pct else [])


def test_basket_fills_missing_with_reference(spark):
    offers = spark.createDataFrame([(1, 1, 100), (1, 2, 200), (2, 1, 50), (2, 2, 70), (3, 1, 999)], "product_id bigint, store_id bigint, price bigint")
    got = {r.store_id: r for r in prices.basket(offers, spark.createDataFrame([(1,), (2,), (3,)], "store_id bigint")).collect()}
    assert (got[1].items, got[1].missing, got[1].total) == (2, 0, 150)
    assert (got[3].missing, got[3].total, got[3].pct_vs_average) == (2, 210, 0.0)


def test_outlier_needs_a_large_reference(spark):
    new = spark.createDataFrame([(1, 128999900), (2, 12562200), (3, 100)], "sku_id bigint, price bigint")
    last = spark.createDataFrame([], "sku_id bigint, last_price bigint")
    stats = spark.createDataFrame([], "sku_id bigint, n bigint, mean double, sd double")
    others = spark.createDataFrame([(1, 7992000.0), (2, 569000.0)], "sku_id bigint, median_other double")
    assert {r.sku_id: r.suspect_new for r in prices.suspects(new, last, stats, others, RULES).collect()} == {1: True, 2: False, 3: False}


def test_state_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, t int")
    assert {(r.k, r.v) for r in state.upsert(old, new, ["k"], "t").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {(r.k, r.v) for r in state.insert_new(old, new, ["k"], "t").collect()} == {(1, "a"), (2, "b"), (3, "e")}


def test_components(spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8)], "a bigint, b bigint")
    got = {r.node: r.component for r in matching.min_labels(edges).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7}
