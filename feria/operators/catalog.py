"""The public questions: search, product card and price history, with the checks of their requests."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feria.functions import text
from feria.operators import prices
from feria.schemas import RULES, Rules
from feria.sources.model import Model

MOST_OFFSET = 2**53 - 1


class InvalidQuery(ValueError):
    """A request that breaks a rule; the message says which."""


@dataclass(frozen=True)
class Search:
    """A checked search request."""

    q: str
    limit: int = 8
    offset: int = 0
    category: str | None = None
    stores: tuple[str, ...] = ()


def cursor(offset: int) -> str:
    """An offset as an opaque text that a client hands back."""
    return base64.urlsafe_b64encode(json.dumps({"o": offset}, separators=(",", ":")).encode()).decode().rstrip("=")


def offset_of(cursor: str | None) -> int:
    if cursor is None:
        return 0
    try:
        at = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))["o"]
    except (ValueError, KeyError, TypeError):
        raise InvalidQuery("cursor") from None
    if not isinstance(at, int) or isinstance(at, bool) or not 0 <= at <= MOST_OFFSET:
        raise InvalidQuery("cursor")
    return at


def request(q: str | None, limit: int | str | None = None, category: str | None = None, stores: list[str] | None = None, at: str | None = None, *, lenient: bool = False) -> Search:
    """A search of 2 to 64 characters, a limit of 1 to 20 (`lenient`: taken to the nearest, else the default), a category of
    at most 200 and stores of at most 64 characters each; longer or empty stores are left out."""
    q = (q or "").strip()
    if not 2 <= len(q) <= 64:
        raise InvalidQuery("q")
    try:
        n = 8 if limit is None else int(limit)
    except ValueError:
        if not lenient:
            raise InvalidQuery("limit") from None
        n = 8
    if not 1 <= n <= 20:
        if not lenient:
            raise InvalidQuery("limit")
        n = min(max(n, 1), 20)
    if category is not None and not 1 <= len(category.strip()) <= 200:
        raise InvalidQuery("category")
    own = tuple(s.strip() for s in stores or [] if 0 < len(s.strip()) <= 64)
    return Search(q, n, offset_of(at), category.strip() if category is not None else None, own)


def relevance(name: Column, brand: Column, q: str) -> tuple[Column, Column]:
    """Whether a product answers a search (alike by trigrams above 0.3, or its name or brand holds it), and how well."""
    word = text.plain(F.lit(q))
    alike = text.trigram_similarity(text.plain(name), word)
    holds = lambda c: F.contains(text.plain(F.coalesce(c, F.lit(""))), word)
    return (alike > 0.3) | holds(name) | holds(brand), alike


def _found(m: Model, s: Search, rules: Rules) -> DataFrame:
    hit, score = relevance(F.col("name"), F.col("brand"), s.q)
    rows = m.product.where(hit).withColumn("score", score).join(m.category.select("category_id", F.col("path").alias("category")), "category_id", "left")
    if s.category is not None:
        path = m.category.where((F.col("slug") == s.category) | (F.col("path") == s.category))
        path = path.orderBy(F.col("path") != s.category, "category_id").limit(1).select(F.col("path").alias("root"))  # one row
        rows = rows.crossJoin(F.broadcast(path)).where((F.col("category") == F.col("root")) | F.startswith("category", F.concat("root", F.lit("/")))).drop("root")
    fresh = prices.fresh_offers(prices.valid_prices(m, rules), m.now, rules.fresh_days)
    if s.stores:
        fresh = fresh.join(m.store.where(F.col("slug").isin(*s.stores)).select("store_id"), "store_id", "left_semi")
    rows = rows.join(fresh.select("product_id"), "product_id", "left_semi")
    return rows.join(prices.publishable(prices.price_aggregate(m, rules), rules).select("product_id", "best_price", "stores", "best_captured_at"), "product_id")


def search_products(m: Model, s: Search, rules: Rules = RULES) -> DataFrame:
    """A page of published products that answer a search, sold fresh in one of its stores: most relevant, then cheapest,
    then by slug."""
    rows = _found(m, s, rules).orderBy(F.col("score").desc(), "best_price", "slug").offset(s.offset).limit(s.limit)
    return rows.select("slug", "name", "brand", "category", "best_price", "stores", "best_captured_at")


def search_total(m: Model, s: Search, rules: Rules = RULES) -> DataFrame:
    """One row: how many products a search has in all."""
    return _found(m, s, rules).agg(F.count(F.lit(1)).alias("total"))


def only(m: Model, products: DataFrame) -> Model:
    """The model with the prices of some products (product_id) only, so that no other is aggregated."""
    if m.listed is not None:
        return replace(m, listed=m.listed.join(products.select("product_id"), "product_id", "left_semi"))
    own = m.link.join(products.select("product_id"), "product_id", "left_semi")
    return replace(m, link=own, price=m.price.join(own.select("sku_id"), "sku_id", "left_semi"))


def product_detail(m: Model, slug: str, rules: Rules = RULES) -> DataFrame:
    """One nested row for a published product, else none: its data, aggregate, and the latest offers of active stores,
    cheapest first, whatever their age."""
    one = m.product.where(F.col("slug") == slug)
    m = only(m, one)
    card = one.join(prices.publishable(prices.price_aggregate(m, rules), rules), "product_id").join(m.category.select("category_id", F.col("path").alias("category")), "category_id", "left")
    valid = prices.valid_prices(m, rules, drop_corrected=False, min_price=False).join(one.select("product_id"), "product_id", "left_semi")
    offers = prices.latest_offers(valid).join(m.store.where("is_active").select("store_id", F.col("slug").alias("store"), F.col("name").alias("store_name")), "store_id")
    listed = offers.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("price", "store", "store_name", "promo", "captured_at"))).alias("offers"))
    figures = F.struct("best_price", "stores", "pct_7d", "pct_24h", "min_30d", "min_90d", "avg_30d").alias("aggregate")
    none = F.array().cast("array<struct<price: bigint, store: string, store_name: string, promo: boolean, captured_at: timestamp>>")
    return card.join(listed, "product_id", "left").select("slug", "name", "brand", "category", F.coalesce("offers", none).alias("offers"), figures)


WINDOWS = {"30": 30, "90": 90, "all": None}


def product_history(m: Model, slug: str, window: str = "30", rules: Rules = RULES) -> DataFrame:
    """One row for a product with a published price, else none: its daily series over the window (30, 90, all) by day, and
    the lowest and highest price in it."""
    if window not in WINDOWS:
        raise InvalidQuery("window")
    one = m.product.where(F.col("slug") == slug).select("product_id", "slug")
    m = only(m, one)
    one = one.join(prices.price_aggregate(m, rules).select("product_id"), "product_id", "left_semi")
    days = prices.daily_series(m, rules).join(one, "product_id", "left_semi")
    if WINDOWS[window] is not None:
        days = days.where(F.col("day") >= F.date_sub(F.to_date(F.lit(m.now)), WINDOWS[window]))
    series = days.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("day", "min_price", "avg_price"))).alias("series"), F.min("min_price").alias("low"), F.max("min_price").alias("high"))
    none = F.array().cast("array<struct<day: date, min_price: bigint, avg_price: bigint>>")
    return one.join(series, "product_id", "left").select("slug", F.lit(window).alias("window"), F.coalesce("series", none).alias("series"), "low", "high")


def home(m: Model, items: DataFrame, rules: Rules = RULES) -> DataFrame:
    """What a start page shows, as section, store_id, product_id, figure and value: the overview (products, active stores,
    prices of a day), every store's basket of all products that two stores offer (`basket`) and of the given items
    (`fixed`), and the items' offers (`detail`). items: product_id. Fresh offers are found once and checkpointed."""
    valid = prices.valid_prices(m, rules)
    offers = prices.fresh_offers(valid, m.now, rules.fresh_days).checkpoint()
    items = items.select("product_id").distinct()
    none = F.lit(None).cast("long")

    def shown(rows: DataFrame, section: str, figures: dict[str, Column], store: Column = none, product: Column = none) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("figure"), c.cast("double").alias("value")) for n, c in figures.items()]))
        return rows.select(F.lit(section).alias("section"), store.cast("long").alias("store_id"), product.cast("long").alias("product_id"), each.alias("f")).select("section", "store_id", "product_id", "f.*")

    one = lambda df, name: shown(df.agg(F.count(F.lit(1)).alias("n")), "overview", {name: F.col("n")})
    day = valid.where(F.col("captured_at") >= prices.before(m.now, days=1))
    figures = {c: F.col(c) for c in ("items", "missing", "total", "estimated", "pct_vs_average")}
    parts = [one(m.store.where("is_active"), "stores"), one(day, "prices_24h")]
    parts += [shown(prices.basket(offers, m.store), "basket", figures, F.col("store_id")), shown(prices.basket(offers, m.store, items), "fixed", figures, F.col("store_id"))]
    parts.append(shown(offers.join(items, "product_id", "left_semi"), "detail", {"price": F.col("price")}, F.col("store_id"), F.col("product_id")))
    got = one(m.product, "products")
    for p in parts:
        got = got.unionByName(p)
    return got
