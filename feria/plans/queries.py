"""Queries over the star-schema test tables, by inventory id, each beside the SQL that it is checked with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feria.functions import text
from feria.operators import matching, prices, state
from feria.schemas import RULES
from feria.sources import model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Windows and minimum that select something from the test tables; the defaults are those of RULES.
TEST = replace(RULES, fresh_days=180, min_price=5000.0)

_BASE = (
    model.SQL
    + """,
valid AS (
  SELECT p.*, l.product_id, k.store_id FROM price p JOIN link l USING (sku_id) JOIN sku k USING (sku_id)
  WHERE NOT p.suspect AND p.price >= 500000 AND l.status IN ('auto', 'confirmed')
    AND NOT EXISTS (SELECT 1 FROM correction c WHERE c.sku_id = p.sku_id AND c.captured_at = p.captured_at)),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY captured_at DESC, promo DESC, price, sku_id) AS rn FROM valid) WHERE rn = 1),
fresh AS (SELECT latest.* FROM latest, clock WHERE captured_at >= now - INTERVAL 180 DAY),
best AS (SELECT DISTINCT ON (product_id) product_id, store_id AS best_store_id, price AS best_price, captured_at AS best_captured_at FROM fresh ORDER BY product_id, price, captured_at DESC, store_id),
counts AS (SELECT product_id, count(DISTINCT store_id) AS stores FROM fresh GROUP BY product_id),
hist AS (
  SELECT product_id, min(price) FILTER (captured_at >= now - INTERVAL 30 DAY) AS min_30d, min(price) FILTER (captured_at >= now - INTERVAL 90 DAY) AS min_90d, min(price) AS min_all,
    ((2 * sum(price) FILTER (captured_at >= now - INTERVAL 30 DAY) + count(*) FILTER (captured_at >= now - INTERVAL 30 DAY)) // nullif(2 * count(*) FILTER (captured_at >= now - INTERVAL 30 DAY), 0))::BIGINT AS avg_30d
  FROM valid, clock GROUP BY product_id),
r24 AS (SELECT DISTINCT ON (product_id) product_id, price AS ref_24h FROM valid, clock WHERE captured_at <= now - INTERVAL 1 DAY ORDER BY product_id, captured_at DESC, price),
r7 AS (SELECT DISTINCT ON (product_id) product_id, price AS ref_7d FROM valid, clock ORDER BY product_id, CASE WHEN captured_at <= now - INTERVAL 7 DAY THEN captured_at END DESC NULLS LAST, captured_at, price),
agg AS (
  SELECT b.product_id, best_store_id, best_price, best_captured_at, stores, min_30d, min_90d, min_all, avg_30d,
    CASE WHEN ref_24h > 0 THEN (CASE WHEN best_price < ref_24h THEN -1 ELSE 1 END) * ((2 * abs(best_price - ref_24h) * 10000 + ref_24h) // (2 * ref_24h)) / 100.0 END AS pct_24h,
    CASE WHEN ref_7d > 0 THEN (CASE WHEN best_price < ref_7d THEN -1 ELSE 1 END) * ((2 * abs(best_price - ref_7d) * 10000 + ref_7d) // (2 * ref_7d)) / 100.0 END AS pct_7d
  FROM best b JOIN counts USING (product_id) LEFT JOIN hist USING (product_id) LEFT JOIN r24 USING (product_id) LEFT JOIN r7 USING (product_id))
"""
)


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    """Columns that may be null as doubles, which every reader shows alike."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def with_base(sql: str) -> str:
    """SQL behind the model's common table expressions; `+` continues their list."""
    head = "WITH RECURSIVE" if "RECURSIVE" in sql else "WITH"
    return f"{head} {_BASE}{',' if sql.lstrip().startswith('+') else ''} {sql.replace('RECURSIVE', '').lstrip().lstrip('+')}"


def query(name: str, sql: str | None = None, *, base: bool = True) -> Callable[[Query], Query]:
    """Register a query, and its SQL behind the model's common table expressions."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_base(sql) if base else sql
        return f

    return add


def on_model(name: str, sql: str | None = None) -> Callable:
    """The same for functions of the model alone."""

    def add(f: Callable[[model.Model], DataFrame]) -> Callable:
        query(name, sql)(lambda spark, sf_dir: f(model.from_star(spark, sf_dir)))
        return f

    return add


def checkpoints(spark: SparkSession) -> None:
    """Let checkpoints go to the folder that the session names; only a local session may have one of its own."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark))


def _agg(m: model.Model) -> DataFrame:
    return prices.price_aggregate(m, TEST)


def _fresh(m: model.Model) -> DataFrame:
    return prices.fresh_offers(prices.valid_prices(m, TEST), m.now, TEST.fresh_days)


# --- scans, filters, predicates


@on_model("S1_scan_listings", "SELECT sku_id, store_id FROM sku WHERE store_id <= 3")
def _s1(m):
    return m.sku.where("store_id <= 3").select("sku_id", "store_id")


@query("S2_parameter_sql", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag", base=False)
def _s2(spark, sf_dir):
    return spark.sql("SELECT l_returnflag, count(*) AS n FROM {lineitem} WHERE l_quantity > :least GROUP BY l_returnflag", args={"least": 25}, lineitem=model.read(spark, sf_dir, "lineitem"))


@query("S4_offer_pick", """SELECT o_orderkey, list_filter(list_sort(list(struct_pack(price := l_extendedprice, qty := l_quantity))), lambda x: x.qty > 40)[1].price AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""", base=False)
def _s4(spark, sf_dir):
    """First offer of a nested JSON payload with enough stock."""
    rows = model.read(spark, sf_dir, "lineitem").join(model.read(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    payload = rows.groupBy("o_orderkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))))).alias("json"))
    offers = payload.withColumn("o", F.from_json("json", "array<struct<price: double, qty: double>>"))
    return offers.select("o_orderkey", F.get(F.filter("o", lambda x: x["qty"] > 40), 0)["price"].alias("price"))
@on_model("S6_category_leaves", "SELECT category_id, path FROM category c WHERE NOT EXISTS (SELECT 1 FROM category d WHERE d.parent_id = c.category_id)")
def _s6(m):
    return m.category.join(m.category.select(F.col("parent_id").alias("category_id")).distinct(), "category_id", "left_anti").select("category_id", "path")


@query("S10_link_ids", """SELECT DISTINCT h FROM (SELECT unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS h FROM pages)""", base=False)
def _s10(spark, sf_dir):
    return model.read(spark, sf_dir, "pages").select(F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1))).alias("h")).distinct()


@on_model("S12_category_chain", "SELECT c.category_id, CASE WHEN p.name IS NULL THEN c.name ELSE p.name || ' > ' || c.name END AS chain FROM category c LEFT JOIN category p ON p.category_id = c.parent_id")
def _s12(m):
    """Names from the root down, by repeated joins to the parent (the tree's depth is small and known)."""
    up = m.category.select(F.col("category_id").alias("parent_id"), F.col("name").alias("above"))
    return m.category.join(F.broadcast(up), "parent_id", "left").select("category_id", F.concat_ws(" > ", "above", "name").alias("chain"))


@query("S13_comma_decimals", "SELECT p_partkey, try_cast(replace(replace(p_retailprice::VARCHAR, '.', ','), ',', '.') AS DOUBLE) AS price FROM part", base=False)
def _s13(spark, sf_dir):
    text_price = F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))
    return model.read(spark, sf_dir, "part").select("p_partkey", F.replace(text_price, F.lit(","), F.lit(".")).try_cast("double").alias("price"))


@query("S19_event_report", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2", base=False)
def _s19(spark, sf_dir):
    return model.read(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("S20_parameter_table", "SELECT k, n_name FROM (VALUES (1, 'a'), (3, 'b')) v(id, k) JOIN nation ON n_nationkey = id", base=False)
def _s20(spark, sf_dir):
    rows = spark.range(1).select(F.explode(F.from_json(F.lit('[{"id":1,"k":"a"},{"id":3,"k":"b"}]'), "array<struct<id: int, k: string>>")).alias("v"))
    return model.read(spark, sf_dir, "nation").join(F.broadcast(rows), F.col("n_nationkey") == F.col("v.id")).select("v.k", "n_name")


@on_model("F1_F5_valid_prices", "SELECT product_id, store_id, sku_id, captured_at, promo, price FROM valid")
def _f1(m):
    return prices.valid_prices(m, TEST).select("product_id", "store_id", "sku_id", "captured_at", "promo", "price")


@on_model("F6_publishable", "SELECT product_id, best_price, stores FROM agg WHERE stores >= 2 AND best_price >= 500000")
def _f6(m):
    return prices.publishable(_agg(m), TEST).select("product_id", "best_price", "stores")


@on_model("F7_without_subtree", "SELECT product_id FROM product LEFT JOIN category USING (category_id) WHERE category_id IS NULL OR path NOT LIKE 'europe%'")
def _f7(m):
    return m.product.join(F.broadcast(m.category.where(F.col("path").startswith("europe")).select("category_id")), "category_id", "left_anti").select("product_id")


@on_model("F8_subtree", "SELECT product_id, path FROM product JOIN category USING (category_id) WHERE path = 'asia' OR path LIKE 'asia/%'")
def _f8(m):
    return m.product.join(F.broadcast(m.category), "category_id").where((F.col("path") == "asia") | F.col("path").startswith("asia/")).select("product_id", "path")


@on_model("F9_category_token", "SELECT path FROM category WHERE slug IN ('nation_7', 'asia') OR path IN ('nation_7', 'asia') ORDER BY CASE WHEN path IN ('nation_7', 'asia') THEN 0 ELSE 1 END, category_id LIMIT 1")
def _f9(m):
    """The token is a path, else a slug."""
    token = ("nation_7", "asia")
    hit = m.category.where(F.col("slug").isin(*token) | F.col("path").isin(*token))
    return hit.orderBy(F.when(F.col("path").isin(*token), 0).otherwise(1), "category_id").limit(1).select("path")


@on_model("F10_store_list", "SELECT store_id, slug FROM store WHERE slug IN (SELECT slug FROM store WHERE store_id IN (1, 2))")
def _f10(m):
    return m.store.join(F.broadcast(m.store.where(F.col("store_id").isin(1, 2)).select("slug")), "slug", "left_semi").select("store_id", "slug")


@query("F11_accent_free_contains", "SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'este')", base=False)
def _f11(spark, sf_dir):
    return model.read(spark, sf_dir, "documents").where(F.contains(F.lower(text.strip_accents(F.col("text"))), F.lit("este"))).select("doc_id")


@query("F13_keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) > (100, 500) ORDER BY o_custkey, o_orderkey LIMIT 50", base=False)
def _f13(spark, sf_dir):
    rows = model.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rows.where(F.struct("o_custkey", "o_orderkey") > F.struct(F.lit(100).cast("long"), F.lit(500).cast("long"))).orderBy("o_custkey", "o_orderkey").limit(50)


@query("F14_snapshot_reasons", """SELECT page_id, CASE WHEN html IS NULL THEN 'invalid_snapshot' WHEN page_id % 5 = 0 THEN 'invalid_price' WHEN page_id % 7 = 0 THEN 'below_min_price'
  WHEN NOT (regexp_extract(url, '://([^/?#]*)', 1) = 'example.com' OR regexp_extract(url, '://([^/?#]*)', 1) LIKE '%.example.com') THEN 'invalid_source_url' END AS reason FROM pages""", base=False)
def _f14(spark, sf_dir):
    """Ordered reasons, and a host allow-list of equal hosts or subdomains (F15)."""
    host = F.expr("try_parse_url(url, 'HOST')")
    price = F.when(F.col("page_id") % 5 == 0, -1.0).when(F.col("page_id") % 7 == 0, 1.0).otherwise(1000.0)
    allowed = F.exists(F.array(F.lit("example.com")), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
    reason = F.when(F.col("html").isNull(), "invalid_snapshot").when(price <= 0, "invalid_price").when(price < 500, "below_min_price").when(~allowed, "invalid_source_url")
    return model.read(spark, sf_dir, "pages").select("page_id", reason.alias("reason"))


# --- joins


@on_model("J1_star_join", "SELECT p.name, s.name AS store, v.price, v.captured_at FROM valid v JOIN product p USING (product_id) JOIN store s USING (store_id) WHERE s.is_active")
def _j1(m):
    rows = prices.valid_prices(m, TEST).join(m.product.select("product_id", "name"), "product_id").join(m.store.where("is_active").select("store_id", F.col("name").alias("store")), "store_id")
    return rows.select("name", "store", "price", "captured_at")


@on_model("J3_orphan_listings", "SELECT sku_id FROM sku WHERE sku_id NOT IN (SELECT sku_id FROM link)")
def _j3(m):
    return m.sku.join(m.link, "sku_id", "left_anti").select("sku_id")


@on_model("J4_not_in_aggregate", "SELECT product_id FROM product p WHERE NOT EXISTS (SELECT 1 FROM agg a WHERE a.product_id = p.product_id)")
def _j4(m):
    return m.product.join(_agg(m), "product_id", "left_anti").select("product_id")


@on_model("J5_available_products", "SELECT product_id FROM product p WHERE EXISTS (SELECT 1 FROM fresh f WHERE f.product_id = p.product_id)")
def _j5(m):
    return m.product.join(_fresh(m), "product_id", "left_semi").select("product_id")


def _by_store(m: model.Model, products: DataFrame, offers: DataFrame) -> DataFrame:
    """product_id, store_id and price (null without an offer) of each product in every store: a product's offers are
    brought together first, so that the grid itself is never shuffled."""
    priced = offers.groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("store_id", "price"))).alias("by_store"))
    grid = products.join(priced, "product_id", "left").crossJoin(m.store.select("store_id"))
    return grid.select("product_id", "store_id", F.try_element_at("by_store", F.col("store_id")).alias("price"))


@on_model("J7_offers_of_every_store", "SELECT p.product_id, s.store_id, f.price::DOUBLE AS price FROM product p CROSS JOIN store s LEFT JOIN fresh f USING (product_id, store_id)")
def _j7(m):
    """Card grid of all products by all stores."""
    return _doubles(_by_store(m, m.product.select("product_id"), _fresh(m)), "price")
@on_model("J8_last_capture", "SELECT store_id, max(captured_at) AS last_at FROM store LEFT JOIN sku USING (store_id) LEFT JOIN price USING (sku_id) GROUP BY store_id")
def _j8(m):
    last = m.price.join(m.sku.select("sku_id", "store_id"), "sku_id").groupBy("store_id").agg(F.max("captured_at").alias("last_at"))
    return m.store.select("store_id").join(last, "store_id", "left")


@on_model("J12_root_names", "SELECT c.category_id, r.name AS root FROM category c JOIN category r ON r.path = split_part(c.path, '/', 1)")
def _j12(m):
    roots = m.category.select(F.col("path").alias("root_path"), F.col("name").alias("root"))
    return m.category.join(F.broadcast(roots), F.substring_index("path", "/", 1) == F.col("root_path")).select("category_id", "root")


@query("J14_padded_code_join", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON lpad(s_suppkey::VARCHAR, 13, '0') = lpad(p_partkey::VARCHAR, 13, '0')", base=False)
def _j14(spark, sf_dir):
    code = lambda c: F.lpad(F.col(c).cast("string"), 13, "0")
    return model.read(spark, sf_dir, "part").join(model.read(spark, sf_dir, "supplier"), code("p_partkey") == code("s_suppkey")).select("p_partkey", "s_suppkey")


@query("J17_blocked_pairs", "SELECT a.p_partkey AS id_a, b.p_partkey AS id_b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey", base=False)
def _j17(spark, sf_dir):
    return matching.blocked_pairs(model.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_name", "p_size"), ["p_brand", "p_name", "p_size"]).select("id_a", "id_b")


@query("J18_word_candidates", """WITH w AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name, ' ')) AS word FROM part)
  SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM w a JOIN w b USING (word) WHERE a.id < b.id AND length(word) >= 3""", base=False)
def _j18(spark, sf_dir):
    """Every pair of rows that share a word of their names; most pairs of a hot word are part of the result."""
    rows = model.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("tokens"))
    return matching.candidates(rows)
@on_model("J20_refresh_changes", "+ early AS (SELECT product_id, min(price) AS p FROM valid WHERE captured_at < TIMESTAMP '2001-01-01' GROUP BY 1), late AS (SELECT product_id, min(price) AS p FROM valid WHERE captured_at >= TIMESTAMP '1999-01-01' GROUP BY 1) SELECT product_id, CASE WHEN e.p IS NULL THEN 'inserted' WHEN l.p IS NULL THEN 'removed' WHEN e.p = l.p THEN 'same' ELSE 'updated' END AS change FROM early e FULL JOIN late l USING (product_id)")
def _j20(m):
    v = prices.valid_prices(m, TEST)
    low = lambda d: d.groupBy("product_id").agg(F.min("price").alias("p"))
    return prices.refresh(low(v.where("captured_at < timestamp'2001-01-01'")), low(v.where("captured_at >= timestamp'1999-01-01'")))


# --- aggregates, windows, sorts


@on_model("A1_latest_offers", "SELECT product_id, store_id, captured_at, promo, price, sku_id FROM latest")
def _a1(m):
    return prices.latest_offers(prices.valid_prices(m, TEST))


@on_model("A2_stores_per_product", "SELECT * FROM counts")
def _a2(m):
    return _fresh(m).groupBy("product_id").agg(F.count(F.lit(1)).alias("stores"))


@on_model("A3_best_offers", "SELECT * FROM best JOIN counts USING (product_id)")
def _a3(m):
    return prices.best_offers(_fresh(m))


@on_model("A4_A7_history", "SELECT product_id, min_30d::DOUBLE AS min_30d, min_90d::DOUBLE AS min_90d, min_all, avg_30d::DOUBLE AS avg_30d, ref_24h::DOUBLE AS ref_24h, ref_7d::DOUBLE AS ref_7d FROM hist h LEFT JOIN r24 USING (product_id) LEFT JOIN r7 USING (product_id)")
def _a4(m):
    return _doubles(prices.history(prices.valid_prices(m, TEST), m.now), "min_30d", "min_90d", "avg_30d", "ref_24h", "ref_7d")


@on_model("A5_price_aggregate", "SELECT * REPLACE (min_30d::DOUBLE AS min_30d, min_90d::DOUBLE AS min_90d, min_all::DOUBLE AS min_all, avg_30d::DOUBLE AS avg_30d) FROM agg")
def _a5(m):
    return _doubles(_agg(m), "min_30d", "min_90d", "min_all", "avg_30d")


@on_model("A9_daily_series", """SELECT product_id, strftime(captured_at, '%Y-%m-%d') AS day, min(price) AS min_price, ((2 * sum(price) + count(*)) // (2 * count(*)))::BIGINT AS avg_price, count(*) AS records
  FROM price JOIN link USING (sku_id) WHERE NOT suspect AND status IN ('auto', 'confirmed') GROUP BY 1, 2""")
def _a9(m):
    return prices.daily_series(m, TEST).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@on_model("A11_price_stats", "SELECT sku_id, count(*) AS n, sum(price)::BIGINT AS total, round(stddev_samp(price::DOUBLE), 3) AS sd FROM price, clock WHERE NOT suspect AND captured_at >= now - INTERVAL 365 DAY GROUP BY sku_id")
def _a11(m):
    return prices.price_stats(m.price, m.now, 365).select("sku_id", "n", "total", F.round("sd", 3).alias("sd"))


@on_model("A12_cross_store_median", "SELECT a.product_id, a.store_id, median(b.price) AS median_other FROM latest a JOIN latest b ON a.product_id = b.product_id AND a.store_id <> b.store_id GROUP BY 1, 2")
def _a12(m):
    """Median of the other stores' latest prices; a product's offers are one a store."""
    return prices.median_of_others(prices.latest_offers(prices.valid_prices(m, TEST))).select("product_id", "store_id", "median_other")


@on_model("A13_latest_listing_price", "SELECT DISTINCT ON (sku_id) sku_id, captured_at, promo, price FROM price WHERE NOT suspect ORDER BY sku_id, captured_at DESC, promo DESC, price")
def _a13(m):
    return prices.latest_offers(m.price.where("not suspect").withColumn("k", F.col("sku_id")), ("k",)).select("sku_id", "captured_at", "promo", "price")


_BASKET = """+ per AS (SELECT product_id, store_id, min(price) AS price FROM fresh GROUP BY 1, 2),
ref AS (SELECT product_id, ((2 * sum(price) + count(*)) // (2 * count(*)))::BIGINT AS ref FROM per GROUP BY 1 HAVING count(*) >= 2),
grid AS (SELECT s.store_id, r.product_id, r.ref, p.price FROM store s CROSS JOIN ref r LEFT JOIN per p ON p.store_id = s.store_id AND p.product_id = r.product_id),
tot AS (SELECT store_id, count(*) AS items, count(*) - count(price) AS missing, sum(coalesce(price, ref))::BIGINT AS total, coalesce(sum(ref) FILTER (price IS NULL), 0)::BIGINT AS estimated, sum(ref)::BIGINT AS rt FROM grid GROUP BY store_id)
SELECT store_id, items, missing, total, estimated, (CASE WHEN total < rt THEN -1 ELSE 1 END) * ((2 * abs(total - rt) * 10000 + rt) // (2 * rt)) / 100.0 AS pct_vs_average FROM tot"""


@on_model("A14_basket_by_store", _BASKET)
def _a14(m):
    return prices.basket(_fresh(m), m.store)


@on_model("A15_fixed_basket", _BASKET.replace("FROM fresh GROUP BY 1, 2", "FROM fresh WHERE product_id % 3 = 0 GROUP BY 1, 2").replace(" HAVING count(*) >= 2", "").replace("FROM store s CROSS", "FROM (SELECT DISTINCT store_id FROM per) s CROSS"))
def _a15(m):
    return prices.basket(_fresh(m), m.store, m.product.where("product_id % 3 = 0").select("product_id"))


@on_model("A16_basket_detail", "SELECT s.store_id, r.product_id, f.price::DOUBLE AS price, f.price IS NULL AS is_missing FROM store s CROSS JOIN (SELECT DISTINCT product_id FROM fresh) r LEFT JOIN fresh f USING (store_id, product_id)")
def _a16(m):
    offers = _fresh(m)
    got = _by_store(m, offers.select("product_id").distinct(), offers)
    return got.withColumns({"is_missing": F.col("price").isNull(), "price": F.col("price").cast("double")})
@on_model("A18_basket_items", """SELECT DISTINCT ON (item) item, product_id, name FROM (VALUES ('cold', '^cold'), ('gear', 'gear'), ('none', '^zzz')) i(item, pattern) JOIN product p ON regexp_matches(p.name, pattern) JOIN agg USING (product_id) ORDER BY item, stores DESC, best_price, length(name), product_id""")
def _a18(m):
    """Rules resolved to products: most stores, cheapest, shortest name; a rule without products gives no row."""
    items = m.product.sparkSession.createDataFrame([("cold", "^cold"), ("gear", "gear"), ("none", "^zzz")], "item string, pattern string")
    rows = m.product.join(F.broadcast(items), F.expr("name rlike pattern")).join(_agg(m), "product_id")
    return prices.first_of(rows, ["item"], [F.col("stores").desc(), F.col("best_price"), F.length("name"), F.col("product_id")]).select("item", "product_id", "name")


@on_model("A19_overview", "SELECT (SELECT count(*) FROM product) AS products, (SELECT count(*) FROM store WHERE is_active) AS stores, (SELECT count(*) FROM valid, clock WHERE captured_at >= now - INTERVAL 1 DAY) AS prices_24h")
def _a19(m):
    one = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))  # noqa: E731  one row each
    day = prices.valid_prices(m, TEST).where(F.col("captured_at") >= prices.before(m.now, days=1))
    return one(m.product, "products").crossJoin(one(m.store.where("is_active"), "stores")).crossJoin(one(day, "prices_24h"))


@on_model("A20_competitiveness", "SELECT best_store_id, count(*) AS wins, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share FROM agg GROUP BY 1")
def _a20(m):
    wins = _agg(m).groupBy("best_store_id").agg(F.count(F.lit(1)).alias("wins"))
    return wins.crossJoin(F.broadcast(wins.agg(F.sum("wins").alias("t")))).select("best_store_id", "wins", F.round(F.col("wins") * 100.0 / F.col("t"), 4).cast("double").alias("share"))


@on_model("A21_category_summary", "SELECT category_id, count(*) AS n, ((2 * sum(best_price) + count(*)) // (2 * count(*)))::BIGINT AS avg_best, min(best_price) AS cheapest, max(avg_30d - best_price)::DOUBLE AS saving FROM agg JOIN product USING (product_id) GROUP BY 1")
def _a21(m):
    rows = _agg(m).join(m.product.select("product_id", "category_id"), "product_id")
    got = rows.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.sum("best_price").alias("s"), F.min("best_price").alias("cheapest"), F.max(F.col("avg_30d") - F.col("best_price")).alias("saving"))
    return got.select("category_id", "n", prices.rounded_avg(F.col("s"), F.col("n")).alias("avg_best"), "cheapest", F.col("saving").cast("double").alias("saving"))


@on_model("A22_category_tree", "SELECT c.category_id, c.path, (SELECT count(*) FROM product p WHERE p.category_id = c.category_id) AS direct, (SELECT count(*) FROM product p JOIN category d USING (category_id) WHERE d.path = c.path OR starts_with(d.path, c.path || '/')) AS total FROM category c")
def _a22(m):
    """Direct counts, and totals by each path's own prefixes."""
    direct = m.product.groupBy("category_id").agg(F.count(F.lit(1)).alias("direct"))
    tree = m.category.join(direct, "category_id", "left").withColumn("direct", F.coalesce("direct", F.lit(0)))
    cut = F.split("path", "/")
    up = tree.select("direct", F.explode(F.transform(F.sequence(F.lit(1), F.size(cut)), lambda i: F.array_join(F.slice(cut, F.lit(1), i), "/"))).alias("path"))
    return tree.join(up.groupBy("path").agg(F.sum("direct").alias("total")), "path").select("category_id", "path", "direct", "total")


@on_model("A23_store_status", "SELECT store_id, CASE WHEN last_at IS NULL THEN 'no data' WHEN h < 72 THEN 'ok' WHEN h < 168 THEN 'late' ELSE 'stale' END AS status FROM (SELECT store_id, max(captured_at) AS last_at, floor(greatest(epoch(any_value(now)) - epoch(max(captured_at)), 0) / 3600) AS h FROM store LEFT JOIN sku USING (store_id) LEFT JOIN price USING (sku_id), clock GROUP BY store_id)")
def _a23(m):
    hours = F.floor(F.greatest(F.unix_timestamp(F.lit(m.now)) - F.unix_timestamp("last_at"), F.lit(0)) / 3600)
    status = F.when(F.col("last_at").isNull(), "no data").when(hours < TEST.stale_hours, "ok").when(hours < TEST.late_hours, "late").otherwise("stale")
    return _j8(m).select("store_id", status.alias("status"))


@on_model("A24_deals", "SELECT product_id, best_price, avg_30d, ((2 * (avg_30d - best_price) * 10000 + avg_30d) // (2 * avg_30d)) / 100.0 AS discount_pct FROM agg WHERE stores >= 2 AND best_price >= 500000 AND (avg_30d - best_price) / avg_30d::DOUBLE BETWEEN 0.15 AND 0.8")
def _a24(m):
    return prices.deals(_agg(m), TEST).select("product_id", "best_price", "avg_30d", "discount_pct")


@on_model("A25_orphan_prices", "SELECT k.sku_id, count(*) AS n, min(p.price) AS low, max(p.price) AS high FROM sku k LEFT JOIN link l USING (sku_id) JOIN price p USING (sku_id) WHERE l.sku_id IS NULL GROUP BY 1")
def _a25(m):
    return m.price.join(m.sku.join(m.link, "sku_id", "left_anti").select("sku_id"), "sku_id", "left_semi").groupBy("sku_id").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))


@on_model("A26_repeated_names", "SELECT name, brand, size, count(*) AS n, string_agg(product_id::VARCHAR, ',' ORDER BY product_id DESC) AS ids FROM product GROUP BY ALL HAVING count(*) > 1")
def _a26(m):
    got = m.product.groupBy("name", "brand", "size").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("product_id"), asc=False).alias("ids")).where("n > 1")
    return got.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@on_model("A27_link_summary", "SELECT coalesce(status, 'none') AS status, count(*) AS listings, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM sku LEFT JOIN link USING (sku_id) GROUP BY 1")
def _a27(m):
    n = m.sku.join(m.link, "sku_id", "left").groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("listings"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("listings").alias("t")))).select("status", "listings", F.round(F.col("listings") * 100.0 / F.col("t"), 4).cast("double").alias("pct"))


@on_model("A30_store_coverage", "SELECT store_id, count(*) AS listings, count(l.sku_id) AS matched FROM sku k LEFT JOIN link l ON l.sku_id = k.sku_id AND l.status IN ('auto', 'confirmed') GROUP BY 1")
def _a30(m):
    links = m.link.where(F.col("status").isin(*TEST.valid_status)).select("sku_id", F.lit(1).alias("hit"))
    return m.sku.join(links, "sku_id", "left").groupBy("store_id").agg(F.count(F.lit(1)).alias("listings"), F.count("hit").alias("matched"))


@query("A31_savings_total", "SELECT coalesce(round(sum(v), 0), 0) AS total, count(*) FILTER (user_id <> 0) AS devices FROM (SELECT user_id, max(value) AS v FROM events GROUP BY user_id)", base=False)
def _a31(spark, sf_dir):
    top = model.read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("v"))
    return top.agg(F.coalesce(F.round(F.sum("v"), 0), F.lit(0.0)).alias("total"), F.count_if(F.col("user_id") != 0).alias("devices"))


@on_model("A32_single_source", "SELECT product_id FROM product LEFT JOIN counts USING (product_id) WHERE coalesce(stores, 0) < 2")
def _a32(m):
    return m.product.join(_a2(m), "product_id", "left").where("coalesce(stores, 0) < 2").select("product_id")


@query("A33_longest_text", "SELECT DISTINCT ON (lang, source) lang, source, doc_id FROM documents ORDER BY lang, source, n_chars DESC, doc_id", base=False)
def _a33(spark, sf_dir):
    return model.read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))


@query("A35_modal_size", "SELECT DISTINCT ON (p_brand) p_brand, p_size FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) ORDER BY p_brand, n DESC, p_size DESC", base=False)
def _a35(spark, sf_dir):
    n = model.read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("p_brand").agg(F.max_by("p_size", F.struct("n", "p_size")).alias("p_size"))


@on_model("A36_list_totals", "+ o AS (SELECT product_id, list(DISTINCT price ORDER BY price) AS ps FROM fresh GROUP BY 1) SELECT product_id, ps[1] * 2 AS best, CASE WHEN len(ps) > 1 THEN round(list_sum(ps[2:]) * 2.0 / (len(ps) - 1), 3) ELSE ps[1] * 2.0 END AS others FROM o")
def _a36(m):
    """Products at quantity 2: the best price, and the average of the other distinct prices."""
    o = _fresh(m).groupBy("product_id").agg(F.sort_array(F.collect_set("price")).alias("ps"))
    rest = F.aggregate(F.slice("ps", 2, F.greatest(F.size("ps"), F.lit(1))), F.lit(0).cast("long"), lambda s, x: s + x)
    others = F.when(F.size("ps") > 1, F.round(rest * F.lit(2.0) / (F.size("ps") - 1), 3)).otherwise(F.get("ps", F.lit(0)) * F.lit(2.0))
    return o.select("product_id", (F.get("ps", F.lit(0)) * 2).alias("best"), others.alias("others"))
@on_model("A38_product_summary", "SELECT product_id, min(price) AS best, max(price) AS worst, round((max(price) - min(price)) * 100.0 / min(price), 3) AS spread, count(*) AS stores FROM fresh GROUP BY 1")
def _a38(m):
    spread = F.round((F.max("price") - F.min("price")) * F.lit(100.0).cast("double") / F.min("price"), 3)
    return _fresh(m).groupBy("product_id").agg(F.min("price").alias("best"), F.max("price").alias("worst"), spread.alias("spread"), F.count(F.lit(1)).alias("stores"))


@on_model("A39_history_window", """+ d AS (SELECT product_id, captured_at::DATE AS day, min(price) AS p FROM price JOIN link USING (sku_id) WHERE NOT suspect AND status IN ('auto', 'confirmed') GROUP BY 1, 2)
SELECT product_id, min(p) AS low, max(p) AS high, count(*) AS points, min(day) > (max(now)::DATE - 7) AS short FROM d, clock WHERE day >= now::DATE - 90 GROUP BY product_id""")
def _a39(m):
    days = prices.daily_series(m, TEST).where(F.col("day") >= F.lit((m.now - timedelta(days=90)).date()))
    return days.groupBy("product_id").agg(F.min("min_price").alias("low"), F.max("min_price").alias("high"), F.count(F.lit(1)).alias("points"), (F.min("day") > F.lit((m.now - timedelta(days=7)).date())).alias("short"))


@on_model("A43_sibling_rank", "SELECT category_id, row_number() OVER (PARTITION BY parent_id ORDER BY name, category_id) AS position FROM category")
def _a43(m):
    return m.category.select("category_id", model.rank(["parent_id"], [F.col("name"), F.col("category_id")]).cast("long").alias("position"))


@on_model("A44_rubrics", "SELECT split_part(path, '/', 1) AS root, count(*) AS n FROM product JOIN category USING (category_id) GROUP BY 1 ORDER BY 2 DESC, 1")
def _a44(m):
    return m.product.join(F.broadcast(m.category), "category_id").groupBy(F.substring_index("path", "/", 1).alias("root")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "root")


@query("A45_run_counters", "SELECT user_id, count(*) FILTER (event_type <> 'error') AS captured, count(*) FILTER (event_type = 'error') AS rejected, list_aggregate(list_sort(list(event_id))[1:3], 'string_agg', ',') AS sample FROM events GROUP BY 1", base=False)
def _a45(spark, sf_dir):
    ok = F.col("event_type") != "error"
    sample = F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("event_id")), 1, 3), lambda x: x.cast("string")), ",")
    return model.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(ok).alias("captured"), F.count_if(~ok).alias("rejected"), sample.alias("sample"))


@on_model("W3_last_two", "SELECT sku_id, captured_at, price FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY captured_at DESC, promo DESC) AS rn FROM price) WHERE rn <= 2")
def _w3(m):
    return m.price.withColumn("rn", model.rank(["sku_id"], [F.col("captured_at").desc(), F.col("promo").desc()])).where("rn <= 2").select("sku_id", "captured_at", "price")


@on_model("W10_first_value", "SELECT product_key, sku_id, first_value(sku_id) OVER (PARTITION BY product_key ORDER BY last_seen_at DESC NULLS LAST, sku_id) AS keeper FROM sku")
def _w10(m):
    w = Window.partitionBy("product_key").orderBy(F.col("last_seen_at").desc_nulls_last(), "sku_id")
    return m.sku.select("product_key", "sku_id", F.first_value("sku_id").over(w).alias("keeper"))


for _name, _where, _order in (
    ("O1_biggest_drops", "pct_7d < 0", "pct_7d ASC, product_id"),
    ("O2_biggest_rises", "pct_7d > 0", "pct_7d DESC, product_id"),
    ("O3_price_gaps", "avg_30d IS NOT NULL", "avg_30d - best_price DESC, product_id"),
    ("O4_near_low", "best_price * 100 <= min_90d * 105", "best_price ASC, product_id"),
    ("O5_most_volatile", "pct_7d IS NOT NULL", "abs(pct_7d) DESC, product_id"),
    ("O6_top_savings", "best_price < avg_30d", "avg_30d - best_price DESC, product_id"),
    ("A42_serving_deals", "best_price * 10 < avg_30d * 9", "best_price / avg_30d, product_id"),
):

    def _top(m, where=_where, order=_order):
        """A top-k report over the aggregate."""
        return _agg(m).where(where).orderBy(*[F.expr(o.strip().removesuffix(" DESC").removesuffix(" ASC")).desc() if o.endswith("DESC") else F.expr(o.strip().removesuffix(" ASC")) for o in order.split(", ")]).limit(20).select("product_id", "best_price", F.col("avg_30d").cast("double").alias("avg_30d"), "pct_7d")

    on_model(_name, f"SELECT product_id, best_price, avg_30d::DOUBLE AS avg_30d, pct_7d FROM agg WHERE {_where} ORDER BY {_order} LIMIT 20")(_top)


@on_model("O10_category_listing", "SELECT product_id, best_price::DOUBLE AS best_price FROM product LEFT JOIN agg USING (product_id) WHERE category_id = 3 ORDER BY best_price NULLS LAST, product_id LIMIT 15 OFFSET 15")
def _o10(m):
    rows = m.product.where("category_id = 3").join(_agg(m), "product_id", "left")
    return rows.orderBy(F.col("best_price").asc_nulls_last(), "product_id").offset(15).limit(15).select("product_id", F.col("best_price").cast("double").alias("best_price"))


@on_model("U1_table_sizes", "SELECT 'product' AS t, count(*) AS n FROM product UNION ALL SELECT 'store', count(*) FROM store UNION ALL SELECT 'sku', count(*) FROM sku")
def _u1(m):
    one = lambda d, n: d.agg(F.lit(n).alias("t"), F.count(F.lit(1)).alias("n"))
    return one(m.product, "product").unionByName(one(m.store, "store")).unionByName(one(m.sku, "sku"))


# --- scalar functions


@query("T1_T2_plain_text", "SELECT doc_id, md5(lower(strip_accents(trim(text)))) AS h FROM documents", base=False)
def _t1(spark, sf_dir):
    """The whole text of every document."""
    return model.read(spark, sf_dir, "documents").select("doc_id", F.md5(text.plain(F.col("text"))).alias("h"))
_EAN = "lpad(p_partkey::VARCHAR, 12, '0') || ((10 - (SELECT sum(substr(lpad(p_partkey::VARCHAR, 12, '0'), i, 1)::INTEGER * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) FROM range(1, 13) r(i)) % 10) % 10)::VARCHAR"


@query("T14_T15_ean", f"SELECT p_partkey, lpad(p_partkey::VARCHAR, 13, '0') AS padded, ({_EAN}) = lpad((p_partkey * 10 + p_partkey % 10)::VARCHAR, 13, '0') AS valid FROM part", base=False)
def _t14(spark, sf_dir):
    code = F.lpad((F.col("p_partkey") * 10 + F.col("p_partkey") % 10).cast("string"), 13, "0")
    return model.read(spark, sf_dir, "part").select("p_partkey", text.ean(F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("padded"), text.ean_valid(code).alias("valid"))


@query("T16_strip_html", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM pages", base=False)
def _t16(spark, sf_dir):
    return model.read(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("h"))


@query("T13_forge_slug", "SELECT p_partkey, left(replace(p_name, ' ', '-'), 60) || '-' || left(translate(to_base64(unhex(sha1(p_partkey::VARCHAR))), '+/', '-_'), 6) AS slug FROM part", base=False)
def _t13(spark, sf_dir):
    return model.read(spark, sf_dir, "part").select("p_partkey", text.forge_slug(F.col("p_name"), F.col("p_partkey").cast("string")).alias("slug"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_A, _B = _GRAMS.format("p_name"), _GRAMS.format("'cold gear'")


@query("T22_trigram_similarity", f"SELECT p_partkey, likeness FROM (SELECT p_partkey, len(list_intersect({_A}, {_B}))::DOUBLE / len(list_distinct(list_concat({_A}, {_B}))) AS likeness FROM part) WHERE likeness > 0.3", base=False)
def _t22(spark, sf_dir):
    """Names that are alike to a text by trigrams."""
    return model.read(spark, sf_dir, "part").select("p_partkey", text.trigram_similarity(F.col("p_name"), F.lit("cold gear")).alias("likeness")).where("likeness > 0.3")


@query("D1_D6_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate - INTERVAL 3 HOUR, '%Y-%m-%d') AS local_day, strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, '%Y-%m-%d') AS ahead FROM orders", base=False)
def _d1(spark, sf_dir):
    """Days in UTC and at a fixed three hours behind, months, months ahead."""
    ts = F.col("o_orderdate")
    return model.read(spark, sf_dir, "orders").select("o_orderkey", F.to_date(ts).cast("string").alias("day"), F.to_date(ts - F.make_dt_interval(hours=F.lit(3))).cast("string").alias("local_day"), F.date_format(ts, "yyyy-MM").alias("month"), F.add_months(F.trunc(ts, "month"), 2).cast("string").alias("ahead"))


@query("M1_M5_price_maths", "SELECT p_partkey, CASE WHEN p_retailprice > 1500 THEN round(p_retailprice, 2) END AS parsed, least(p_size, 25) AS low, greatest(p_size, 25) AS high FROM part", base=False)
def _m1(spark, sf_dir):
    written = F.replace(F.format_string("%.2f", F.when(F.col("p_retailprice") > 1500, F.col("p_retailprice"))), F.lit("."), F.lit(","))
    return model.read(spark, sf_dir, "part").select("p_partkey", text.parse_price(F.when(F.col("p_retailprice") > 1500, written)).alias("parsed"), F.least("p_size", F.lit(25)).alias("low"), F.greatest("p_size", F.lit(25)).alias("high"))


@query("M11_hamming", "SELECT p_partkey, bit_count(xor(p_partkey, 43690::BIGINT))::INTEGER AS bits FROM part", base=False)
def _m11(spark, sf_dir):
    return model.read(spark, sf_dir, "part").select("p_partkey", text.hamming(F.hex("p_partkey"), F.lit("AAAA")).alias("bits"))


@on_model("M13_suspects", """+ prev AS (SELECT DISTINCT ON (v.sku_id) v.sku_id, v.price AS last_price FROM valid v JOIN latest n ON n.sku_id = v.sku_id AND v.captured_at < n.captured_at ORDER BY v.sku_id, v.captured_at DESC, v.promo DESC, v.price),
stats AS (SELECT sku_id, count(*) AS n, avg(price) AS mean, stddev_samp(price) AS sd FROM price, clock WHERE NOT suspect AND captured_at >= now - INTERVAL 2000 DAY GROUP BY sku_id),
med AS (SELECT a.product_id, a.store_id, median(b.price) AS m FROM latest a JOIN latest b ON a.product_id = b.product_id AND a.store_id <> b.store_id GROUP BY 1, 2)
SELECT n.sku_id, n.price, coalesce(abs(n.price - last_price) / last_price::DOUBLE * 100 > 80, false) OR coalesce(n >= 2 AND sd > 0 AND abs(n.price - mean) / sd > 0.7, false)
  OR coalesce(greatest(n.price, m) > 4000000 AND greatest(n.price, m) / least(n.price, m)::DOUBLE > 1.8, false) AS suspect_new
FROM latest n LEFT JOIN prev USING (sku_id) LEFT JOIN stats USING (sku_id) LEFT JOIN med ON med.product_id = n.product_id AND med.store_id = n.store_id""")
def _m13(m):
    """The latest prices, against the listing's previous one, its own mean and the median of other stores; with thresholds
    that the test tables' few records a listing can meet."""
    v = prices.valid_prices(m, TEST)
    new = prices.latest_offers(v)
    old = v.join(new.select("sku_id", F.col("captured_at").alias("t")), "sku_id").where("captured_at < t").drop("t")
    last = prices.latest_offers(old.withColumn("k", F.col("sku_id")), ("k",)).select("sku_id", F.col("price").alias("last_price"))
    rules = replace(TEST, suspect_n=2, suspect_z=0.7, outlier_min_ref=40_000.0, outlier_ratio=1.8)
    stats = prices.price_stats(m.price, m.now, 2000)
    return prices.suspects(new.select("sku_id", "price"), last, stats, prices.median_of_others(new).select("sku_id", "median_other"), rules).select("sku_id", "price", "suspect_new")


@query("X1_X3_nested", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey) AS orders FROM orders GROUP BY 1", base=False)
def _x1(spark, sf_dir):
    """A list by an order of its own, through JSON and back."""
    rows = model.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k"))))).alias("j"))
    return rows.select("o_custkey", F.array_join(F.transform(F.from_json("j", "array<struct<p: double, k: bigint>>"), lambda x: x["k"].cast("string")), ",").alias("orders"))
@query("X4_json_field", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events", base=False)
def _x4(spark, sf_dir):
    return model.read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- matching and maintenance


@query("E1_dice", """WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, substr(p_name, i, 2) AS g, count(*) AS c FROM n, range(1, 60) r(i) WHERE i < length(p_name) GROUP BY 1, 2),
t AS (SELECT g, count(*) AS c FROM (SELECT substr('cold gear', i, 2) AS g FROM range(1, 9) r(i)) GROUP BY 1)
SELECT n.p_name, 2.0 * coalesce(sum(CASE WHEN t.c IS NOT NULL THEN least(g.c, t.c) END), 0)::DOUBLE / (length(n.p_name) - 1 + 8) AS dice FROM n LEFT JOIN g USING (p_name) LEFT JOIN t USING (g) GROUP BY n.p_name""", base=False)
def _e1(spark, sf_dir):
    return model.read(spark, sf_dir, "part").select("p_name").distinct().select("p_name", text.dice(F.col("p_name"), F.lit("cold gear")).alias("dice"))


@query("E4_E7_match_routing")
def _e4(spark, sf_dir):
    """Rows only: every listing by its code, else by the best score of all products, and routed. Listings
    have their product's texts; those whose link is by code have it."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark))
    m = model.from_star(spark, sf_dir)
    digits = F.lpad(F.col("product_id").cast("string"), 12, "0")
    odd = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda s, i: s + F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    described = F.concat_ws(" ", "name", "brand", F.concat(F.col("size").cast("string"), F.lit(" gr")))
    products = m.product.join(m.category.select("category_id", F.col("path").alias("context")), "category_id", "left")
    products = products.select(F.col("product_id").alias("id"), described.alias("t"), F.col("brand").alias("declared"), "context", F.concat(digits, ((10 - odd % 10) % 10).cast("string")).alias("ean"))
    coded = m.link.where("method = 'ean'").select("sku_id", F.lit(True).alias("coded"))
    listings = m.sku.join(coded, "sku_id", "left").join(products.withColumnRenamed("id", "product_key"), "product_key")
    return matching.match(listings.select(F.col("sku_id").alias("id"), "t", "declared", "context", F.when(F.col("coded"), F.col("ean")).alias("ean")), products)


@on_model("E12_merge_equal", "+ k AS (SELECT product_id, name, brand, size, count(l.sku_id) AS links FROM product LEFT JOIN link l USING (product_id) GROUP BY ALL) SELECT product_id, first_value(product_id) OVER (PARTITION BY name, brand, size ORDER BY links DESC, length(name) DESC, product_id) AS keep_id FROM k")
def _e12(m):
    """Products with equal name, brand and size: the one with most links stays."""
    rows = m.product.select("product_id", "name", F.struct("name", "brand", "size").alias("group"))
    return rows.join(matching.keepers(rows, m.link), "group").select("product_id", "keep_id")


@query("E14_components", "SELECT node, component FROM (SELECT p_partkey AS node, min(p_partkey) OVER w AS component, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand, p_name, p_size)) WHERE n > 1", base=False)
def _e14(spark, sf_dir):
    """Components of products that are linked by equal names within a brand and size."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark))
    pairs = QUERIES["J17_blocked_pairs"](spark, sf_dir)
    return matching.min_labels(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


def _local_folder(spark: SparkSession) -> str:
    import tempfile

    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="feria-")


@on_model("P1_upsert", "+ new AS (SELECT sku_id, store_id + 1000 AS store_id, last_seen_at FROM sku WHERE sku_id % 3 = 0) SELECT sku_id, store_id, last_seen_at FROM sku WHERE sku_id % 3 <> 0 UNION ALL SELECT * FROM new")
def _p1(m):
    old = m.sku.select("sku_id", "store_id", "last_seen_at")
    return state.upsert(old, old.where("sku_id % 3 = 0").withColumn("store_id", F.col("store_id") + 1000), ["sku_id"], "last_seen_at")


@on_model("P4_insert_new", "SELECT sku_id, store_id FROM sku")
def _p4(m):
    rows = m.sku.select("sku_id", "store_id")
    return state.insert_new(rows.where("sku_id % 2 = 0"), rows.unionByName(rows), ["sku_id"], "store_id")


@query("P13_monotone", "SELECT user_id, max(value) AS value FROM events GROUP BY 1", base=False)
def _p13(spark, sf_dir):
    rows = model.read(spark, sf_dir, "events")
    return state.monotone(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "value")


@on_model("P14_purge_cascade", "SELECT l.sku_id, l.product_id FROM link l LEFT JOIN counts c USING (product_id) WHERE coalesce(c.stores, 0) >= 2")
def _p14(m):
    return state.cascade({"link": (m.link, "product_id")}, _a32(m), "product_id")["link"].select("sku_id", "product_id")


@on_model("P18_retention", "SELECT sku_id, captured_at, strftime(captured_at, '%Y-%m') AS month FROM price, clock WHERE captured_at >= date_trunc('month', now) - INTERVAL 13 MONTH")
def _p18(m):
    return state.retained(m.price, m.now, TEST.retention_months).select("sku_id", "captured_at", "month")


@on_model("K2_snapshot_table", "SELECT DISTINCT ON (sku_id) sku_id, store_id, price, captured_at FROM price JOIN sku USING (sku_id) WHERE NOT suspect ORDER BY sku_id, captured_at DESC, promo DESC, price")
def _k2(m):
    return _a13(m).join(m.sku.select("sku_id", "store_id"), "sku_id").select("sku_id", "store_id", "price", "captured_at")


@on_model("K8_sitemap_page", "SELECT slug FROM product JOIN agg USING (product_id) WHERE stores >= 2 AND best_price >= 500000 AND slug > 'd' ORDER BY slug LIMIT 100")
def _k8(m):
    return prices.publishable(_agg(m), TEST).join(m.product.select("product_id", "slug"), "product_id").where("slug > 'd'").select("slug").orderBy("slug").limit(100)


@on_model("R10_alerts", """+ seen AS (SELECT store_id, max(captured_at) AS last_at FROM store LEFT JOIN sku USING (store_id) LEFT JOIN price USING (sku_id) GROUP BY 1),
runs AS (SELECT store_id, i, store_id % 4 <> 0 OR i < 1 AS ok, store_id % 3 * 20 AS rejected FROM store, range(4) r(i))
SELECT store_id, 'stale' AS alert FROM seen, clock WHERE last_at IS NULL OR epoch(now) - epoch(last_at) > 72 * 3600
UNION ALL SELECT store_id, 'quarantine' FROM store WHERE store_id % 4 = 0 UNION ALL SELECT store_id, 'failed' FROM store WHERE store_id % 4 = 0
UNION ALL SELECT store_id, 'rejection' FROM runs WHERE i = 3 AND rejected / (rejected + 100.0) > 0.2""")
def _r10(m):
    """Four runs a store, an hour apart: of each fourth store all but the first fail, and some reject a lot."""
    from feria.streaming import ingest

    runs = m.store.select("store_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    runs = runs.select("store_id", (F.lit(m.now) - F.make_dt_interval(hours=4 - F.col("i"))).alias("started_at"), ((F.col("store_id") % 4 != 0) | (F.col("i") < 1)).alias("ok"), F.lit(100).alias("captured"), (F.col("store_id") % 3 * 20).alias("rejected"))
    return ingest.alerts(_j8(m), runs, F.lit(m.now), TEST)


@on_model("C1_search", "SELECT product_id, best_price FROM product JOIN agg USING (product_id) JOIN category USING (category_id) WHERE contains(lower(product.name), 'gear') AND (path = 'asia' OR starts_with(path, 'asia/')) AND stores >= 2 ORDER BY best_price, product_id LIMIT 12")
def _c1(m):
    hit = m.product.where(F.contains(text.plain(F.col("name")), F.lit("gear"))).join(F.broadcast(m.category.where("path = 'asia' or path like 'asia/%'").select("category_id")), "category_id", "left_semi")
    return prices.publishable(_agg(m), TEST).join(hit, "product_id").orderBy("best_price", "product_id").limit(12).select("product_id", "best_price")
