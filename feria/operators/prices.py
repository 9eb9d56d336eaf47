"""Price analytics: valid prices, latest offers, references, aggregates, series, baskets, deals."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feria.schemas import RULES, Rules
from feria.sources.model import Model, rank


def before(now: datetime, **age: float) -> Column:
    return F.lit(now - timedelta(**age))


def rounded_avg(total: Column, n: Column) -> Column:
    """Average of whole numbers, rounded half up, without leaving whole numbers (values are not negative)."""
    return F.floor((2 * total + n) / (2 * n)).cast("long")


def pct_change(new: Column, old: Column) -> Column:
    """Change in per cent to two places, half away from zero; null where the old value is null or not positive."""
    hundredths = (new - old) * 10_000
    half = F.floor((2 * F.abs(hundredths) + old) / (2 * old))
    return F.when(old > 0, F.when(hundredths < 0, -half).otherwise(half) / 100.0)


def valid_prices(m: Model, rules: Rules = RULES, *, drop_corrected: bool = True, min_price: bool = True) -> DataFrame:
    """Records of listings with a valid link, neither suspect nor corrected, at the minimum price or above."""
    rows = (m.price if m.listed is None else m.listed).where(~F.col("suspect"))
    if min_price:
        rows = rows.where(F.col("price") >= int(rules.min_price * 100))
    if m.listed is not None:
        rows = rows.where(F.col("status").isin(*rules.valid_status))
        return (rows.where(~F.col("corrected")) if drop_corrected else rows).select("sku_id", "captured_at", "promo", "price", "suspect", "product_id", "store_id")
    if drop_corrected:
        rows = rows.join(m.correction, ["sku_id", "captured_at"], "left_anti")
    links = m.link.where(F.col("status").isin(*rules.valid_status)).select("sku_id", "product_id")
    return rows.join(links, "sku_id").join(m.sku.select("sku_id", "store_id"), "sku_id")


def _lateness() -> Column:
    """What the last record of a group has most of: newest, promotions first, cheapest, then the least listing."""
    return F.struct("captured_at", F.col("promo").cast("int").alias("p"), (-F.col("price")).alias("c"), (-F.col("sku_id")).alias("s"))


def latest_offers(prices: DataFrame, by: tuple[str, ...] = ("product_id", "store_id")) -> DataFrame:
    """The last record of each group: newest, promotions first, cheapest, then the listing's id."""
    best = prices.groupBy(*by).agg(F.max(_lateness()).alias("_k"))
    return best.select(*by, F.col("_k.captured_at").alias("captured_at"), (F.col("_k.p") == 1).alias("promo"), (-F.col("_k.c")).alias("price"), (-F.col("_k.s")).alias("sku_id"))


def fresh_offers(prices: DataFrame, now: datetime, days: float) -> DataFrame:
    return latest_offers(prices).where(F.col("captured_at") >= before(now, days=days))


def history(prices: DataFrame, now: datetime) -> DataFrame:
    """All windowed figures of a product's records in one pass: minima, the 30-day average, and the 24-hour and 7-day
    references (the latter falls back to the oldest record). Equal times: the cheaper record."""
    ts = F.col("captured_at")
    d30, d90, d7, d1 = (ts >= before(now, days=30), ts >= before(now, days=90), ts <= before(now, days=7), ts <= before(now, days=1))
    newest = F.struct("captured_at", (-F.col("price")).alias("c"))
    got = prices.groupBy("product_id").agg(
        F.min(F.when(d30, F.col("price"))).alias("min_30d"), F.min(F.when(d90, F.col("price"))).alias("min_90d"), F.min("price").alias("min_all"),
        F.sum(F.when(d30, F.col("price"))).alias("s30"), F.count(F.when(d30, 1)).alias("n30"),
        F.max(F.when(d1, newest)).alias("r24"), F.max(F.when(d7, newest)).alias("r7"), F.min(F.struct("captured_at", "price")).alias("oldest"),
    )
    avg = F.when(F.col("n30") > 0, rounded_avg(F.col("s30"), F.col("n30")))
    return got.select("product_id", "min_30d", "min_90d", "min_all", avg.alias("avg_30d"), (-F.col("r24.c")).alias("ref_24h"), F.coalesce(-F.col("r7.c"), F.col("oldest.price")).alias("ref_7d"))


def best_offers(fresh: DataFrame) -> DataFrame:
    """Cheapest fresh offer of each product (newest, then least store among equals) and its number of stores."""
    return fresh.groupBy("product_id").agg(F.min(F.struct("price", (-F.unix_micros("captured_at")).alias("t"), "store_id", "captured_at")).alias("b"), F.count(F.lit(1)).alias("stores")).select(
        "product_id", F.col("b.store_id").alias("best_store_id"), F.col("b.price").alias("best_price"), F.col("b.captured_at").alias("best_captured_at"), "stores"
    )


def price_aggregate(m: Model, rules: Rules = RULES) -> DataFrame:
    """One row for each product with a fresh offer.

    The records are aggregated once by product and store, to the latest one and to partial figures of the history, and
    these by product.
    """
    now, ts = m.now, F.col("captured_at")
    d30, d90, d7, d1 = (ts >= before(now, days=30), ts >= before(now, days=90), ts <= before(now, days=7), ts <= before(now, days=1))
    newest, price = F.struct("captured_at", (-F.col("price")).alias("c")), F.col("price")
    per = valid_prices(m, rules).groupBy("product_id", "store_id").agg(
        F.max(_lateness()).alias("k"), F.min(F.when(d30, price)).alias("min_30d"), F.min(F.when(d90, price)).alias("min_90d"), F.min(price).alias("min_all"),
        F.sum(F.when(d30, price)).alias("s30"), F.count(F.when(d30, 1)).alias("n30"),
        F.max(F.when(d1, newest)).alias("r24"), F.max(F.when(d7, newest)).alias("r7"), F.min(F.struct("captured_at", "price")).alias("oldest"),
    )
    fresh = F.col("k.captured_at") >= before(now, days=rules.fresh_days)
    offer = F.when(fresh, F.struct((-F.col("k.c")).alias("price"), (-F.unix_micros("k.captured_at")).alias("t"), "store_id", F.col("k.captured_at").alias("captured_at")))
    got = per.groupBy("product_id").agg(
        F.min(offer).alias("b"), F.count(F.when(fresh, 1)).alias("stores"), *[F.min(c).alias(c) for c in ("min_30d", "min_90d", "min_all", "oldest")],
        F.sum("s30").alias("s30"), F.sum("n30").alias("n30"), F.max("r24").alias("r24"), F.max("r7").alias("r7"),
    ).where("stores > 0")
    avg = F.when(F.col("n30") > 0, rounded_avg(F.col("s30"), F.col("n30")))
    best = F.col("b.price")
    return got.select(
        "product_id", F.col("b.store_id").alias("best_store_id"), best.alias("best_price"), F.col("b.captured_at").alias("best_captured_at"), "stores", "min_30d", "min_90d", "min_all", avg.alias("avg_30d"),
        pct_change(best, -F.col("r24.c")).alias("pct_24h"), pct_change(best, F.coalesce(-F.col("r7.c"), F.col("oldest.price"))).alias("pct_7d"),
    )


def median_of_others(offers: DataFrame) -> DataFrame:
    """Adds median_other to offers, one a product and store: the median price of the product's other stores; products with
    one store have none. A product's prices, one a store, are sorted once, and each row leaves its own out by its place."""
    lists = offers.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("price", F.struct(*[c for c in offers.columns if c not in ("product_id", "price")]).alias("o")))).alias("l")).where("size(l) > 1")
    rows = lists.select("product_id", "l", F.posexplode("l").alias("at", "x"))
    rest = F.size("l") - 1
    other = lambda i: F.get("l", F.when(i < F.col("at"), i).otherwise(i + 1))["price"]
    median = (other(F.floor((rest - 1) / 2).cast("int")) + other(F.floor(rest / 2).cast("int"))) / 2
    return rows.select("product_id", F.col("x.price").alias("price"), "x.o.*", median.alias("median_other"))


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a refresh changes: product_id and change (inserted, updated, same or removed), by a full outer join."""
    cols = [c for c in new.columns if c != "product_id"]
    a = old.select("product_id", F.struct(*cols).alias("was"))
    b = new.select("product_id", F.struct(*cols).alias("now"))
    change = F.when(F.col("was").isNull(), "inserted").when(F.col("now").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("updated")
    return a.join(b, "product_id", "full").select("product_id", change.alias("change"))


def publishable(aggregate: DataFrame, rules: Rules = RULES) -> DataFrame:
    return aggregate.where((F.col("stores") >= rules.min_stores) & (F.col("best_price") >= int(rules.min_price * 100)))


def daily_series(m: Model, rules: Rules = RULES) -> DataFrame:
    """Minimum, rounded average and number of each product's records of a day; corrections and minimum do not count."""
    prices = valid_prices(m, rules, drop_corrected=False, min_price=False)
    got = prices.groupBy("product_id", F.to_date("captured_at").alias("day")).agg(F.min("price").alias("min_price"), F.sum("price").alias("s"), F.count(F.lit(1)).alias("records"))
    return got.select("product_id", "day", "min_price", rounded_avg(F.col("s"), F.col("records")).alias("avg_price"), "records")


def basket(offers: DataFrame, stores: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Each store's total for the products that at least two stores offer (or for the given ones): a missing price counts
    as the product's average. Columns store_id, items, missing, total, estimated, pct_vs_average."""
    per = offers.groupBy("product_id", "store_id").agg(F.min("price").alias("price"))
    if products is not None:
        per = per.join(products, "product_id", "left_semi")
    ref = per.groupBy("product_id").agg(F.sum("price").alias("s"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("store_id", "price")).alias("offers"))
    if products is None:
        ref = ref.where("n >= 2")
    # a product's offers travel with its reference, which counts once among all items: at its first offer
    rows = ref.select(rounded_avg(F.col("s"), F.col("n")).alias("ref"), F.posexplode("offers").alias("at", "offer"))
    own = rows.groupBy("offer.store_id").agg(F.count(F.lit(1)).alias("own"), F.sum("offer.price").alias("own_total"), F.sum("ref").alias("own_ref"), F.count_if(F.col("at") == 0).alias("n_first"), F.sum(F.when(F.col("at") == 0, F.col("ref"))).alias("first_ref"))
    whole = own.agg(F.coalesce(F.sum("n_first"), F.lit(0)).alias("items"), F.sum("first_ref").alias("ref_total"))  # one row, of a row a store
    # own prices are added up for each store, and the rest is what the references of the others come to
    got = stores.select("store_id").join(own, "store_id", "inner" if products is not None else "left").crossJoin(F.broadcast(whole))
    own_n, own_total, own_ref = (F.coalesce(F.col(c), F.lit(0)) for c in ("own", "own_total", "own_ref"))
    estimated = F.col("ref_total") - own_ref
    return got.select("store_id", "items", (F.col("items") - own_n).alias("missing"), (own_total + estimated).alias("total"), estimated.alias("estimated"), pct_change(own_total + estimated, F.col("ref_total")).alias("pct_vs_average"))


def deals(aggregate: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Products whose best price is at least the threshold and at most the maximum below the 30-day average."""
    ref, best = F.col("avg_30d"), F.col("best_price")
    cut = (ref - best) / ref
    ok = (ref > 0) & (F.col("stores") >= rules.min_stores) & (best >= int(rules.min_price * 100)) & (cut >= rules.deal_threshold) & (cut <= rules.deal_max)
    return aggregate.where(ok).withColumn("discount_pct", -pct_change(best, ref))


def price_stats(prices: DataFrame, now: datetime, days: int) -> DataFrame:
    """n, total, mean and sd of each listing's unsuspected prices of the last days."""
    rows = prices.where(~F.col("suspect") & (F.col("captured_at") >= before(now, days=days))).withColumn("x", F.col("price").cast("double"))
    return rows.groupBy("sku_id").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))


def is_outlier(price: Column, reference: Column, rules: Rules = RULES) -> Column:
    """Whether a price and the median of other stores are far apart, where the higher one is large; null without one."""
    high, low = F.greatest(price, reference), F.least(price, reference)
    return F.when(price.isNotNull() & reference.isNotNull(), (high > rules.outlier_min_ref) & (high / low > rules.outlier_ratio))


def is_near_low(price: Column, lowest: Column, rules: Rules = RULES) -> Column:
    return price <= lowest * rules.near_min


def price_days_ago(price: Column, change: Column) -> Column:
    """The price that a change in per cent since then leads back to, to two places; null after a fall by all of it."""
    return F.when(change > -100, F.round(price / (1 + change / 100), 2))


def hours_between(since: Column, now: Column) -> Column:
    """Hours to one place, not negative."""
    return F.floor(F.greatest(F.unix_timestamp(now) - F.unix_timestamp(since), F.lit(0)) / 360 + 0.5) / 10


def suspects(new: DataFrame, last: DataFrame, stats: DataFrame, others: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Adds suspect_new to prices (sku_id, price): far from the last price, from the listing's own mean, or from the
    median of other stores. `last` has sku_id, last_price; `stats` n, mean, sd; `others` sku_id, median_other."""
    price = F.col("price")
    jump = F.abs(price - F.col("last_price")) / F.col("last_price") * 100 > rules.suspect_pct
    z = (F.col("n") >= rules.suspect_n) & (F.col("sd") > 0) & (F.abs(price - F.col("mean")) / F.col("sd") > rules.suspect_z)
    wide = is_outlier(price / 100, F.col("median_other") / 100, rules)
    got = new.join(last, "sku_id", "left").join(stats, "sku_id", "left").join(others, "sku_id", "left")
    return got.withColumn("suspect_new", F.coalesce(jump, F.lit(False)) | F.coalesce(z, F.lit(False)) | F.coalesce(wide, F.lit(False)))


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def first_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order."""
    return rows.withColumn("_r", rank(by, order)).where("_r = 1").drop("_r")
