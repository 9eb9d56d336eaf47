"""More queries of the inventory: deals, state changes, lookups, text rules, dates, views."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feria.functions import text
from feria.operators import prices, state
from feria.plans.queries import TEST, _a13, _agg, _fresh, on_model, query
from feria.sources import model

NOW = datetime(1999, 6, 1)
_DEAL = """deal AS (SELECT o_orderkey AS deal_id, o_custkey AS product_id, o_orderdate AS detected_at, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
  floor(o_totalprice % 60)::BIGINT AS discount, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_days((o_orderkey % 900)::INTEGER) END AS expires_at FROM orders)"""


def deals(spark, sf_dir) -> DataFrame:
    """Orders as deal candidates."""
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    expires = F.when(F.col("o_orderkey") % 3 != 0, F.timestamp_add("DAY", (F.col("o_orderkey") % 900).cast("int"), F.col("o_orderdate").cast("timestamp")))
    return model.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal_id"), F.col("o_custkey").alias("product_id"), F.col("o_orderdate").cast("timestamp").alias("detected_at"), status.alias("status"), F.floor(F.col("o_totalprice") % 60).cast("long").alias("discount"), expires.alias("expires_at"))


def on_deals(name: str, sql: str):
    return query(name, f"WITH {_DEAL} {sql}", base=False)


@on_deals("O7_published_deals", "SELECT deal_id, discount FROM deal WHERE status = 'published' AND (expires_at IS NULL OR expires_at > TIMESTAMP '1999-06-01') ORDER BY discount DESC, detected_at DESC, deal_id LIMIT 50")
def _o7(spark, sf_dir):
    live = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(NOW))
    return prices.top(deals(spark, sf_dir).where((F.col("status") == "published") & live), [F.col("discount").desc(), F.col("detected_at").desc(), F.col("deal_id")], 50).select("deal_id", "discount")


@on_deals("O8_one_deal_a_product", "SELECT * FROM (SELECT DISTINCT ON (product_id) product_id, deal_id, discount, CASE WHEN discount >= 25 THEN 'gold' ELSE 'green' END AS badge FROM deal WHERE status <> 'rejected' ORDER BY product_id, discount DESC, detected_at DESC, deal_id) ORDER BY product_id LIMIT 50")
def _o8(spark, sf_dir):
    rows = prices.first_of(deals(spark, sf_dir).where("status != 'rejected'"), ["product_id"], [F.col("discount").desc(), F.col("detected_at").desc(), F.col("deal_id")])
    return rows.orderBy("product_id").limit(50).select("product_id", "deal_id", "discount", F.when(F.col("discount") >= 25, "gold").otherwise("green").alias("badge"))


@on_deals("O9_daily_offers", ", d1 AS (SELECT * FROM deal WHERE detected_at > TIMESTAMP '1999-06-01' - INTERVAL 1 DAY AND detected_at <= TIMESTAMP '1999-06-01'), d7 AS (SELECT * FROM deal WHERE detected_at > TIMESTAMP '1999-06-01' - INTERVAL 7 DAY AND detected_at <= TIMESTAMP '1999-06-01') SELECT deal_id, discount FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d7 WHERE NOT EXISTS (SELECT 1 FROM d1)) ORDER BY discount DESC, deal_id LIMIT 200")
def _o9(spark, sf_dir):
    """The last day's deals, or the last week's if there are none: one scan, and one flag from one row."""
    week = deals(spark, sf_dir).where((F.col("detected_at") > F.lit(NOW - timedelta(days=7))) & (F.col("detected_at") <= F.lit(NOW))).withColumn("today", F.col("detected_at") > F.lit(NOW - timedelta(days=1)))
    some = week.agg(F.coalesce(F.max("today"), F.lit(False)).alias("some"))
    return week.crossJoin(F.broadcast(some)).where("today or not some").orderBy(F.col("discount").desc(), "deal_id").limit(200).select("deal_id", "discount")


@on_deals("O15_candidate_queue", "SELECT deal_id, status FROM deal ORDER BY CASE WHEN status = 'pending' THEN 0 ELSE 1 END, discount DESC, deal_id LIMIT 100")
def _o15(spark, sf_dir):
    return deals(spark, sf_dir).orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), F.col("discount").desc(), "deal_id").limit(100).select("deal_id", "status")


@on_deals("W8_last_rejection", "SELECT DISTINCT ON (product_id) product_id, strftime(detected_at + INTERVAL 14 DAY, '%Y-%m-%d') AS until FROM deal WHERE status = 'rejected' ORDER BY product_id, detected_at DESC")
def _w8(spark, sf_dir):
    last = deals(spark, sf_dir).where("status = 'rejected'").groupBy("product_id").agg(F.max("detected_at").alias("t"))
    return last.select("product_id", F.date_format(F.date_add("t", TEST.deal_cooldown_days), "yyyy-MM-dd").alias("until"))


@on_deals("P8_insert_deals", "SELECT product_id, strftime(detected_at, '%Y-%m-%d') AS day, min(deal_id) AS deal_id FROM deal GROUP BY 1, 2")
def _p8(spark, sf_dir):
    """New candidates of a product and day change nothing that is there."""
    rows = deals(spark, sf_dir).select("product_id", F.date_format("detected_at", "yyyy-MM-dd").alias("day"), "deal_id")
    return state.insert_new(rows.where("false"), rows, ["product_id", "day"], "deal_id")


@on_deals("P9_P10_transitions", "SELECT deal_id, CASE WHEN status = 'pending' AND discount >= 30 THEN 'published' WHEN status <> 'rejected' AND discount < 5 THEN 'rejected' ELSE status END AS status FROM deal")
def _p9(spark, sf_dir):
    """Pending ones above a cut are published, open ones below another rejected."""
    s, d = F.col("status"), F.col("discount")
    return deals(spark, sf_dir).select("deal_id", F.when((s == "pending") & (d >= 30), "published").when((s != "rejected") & (d < 5), "rejected").otherwise(s).alias("status"))


@on_deals("P15_close_stuck", "SELECT deal_id, CASE WHEN status = 'pending' AND detected_at < TIMESTAMP '1999-06-01' - INTERVAL 4 HOUR THEN 'failed' ELSE status END AS status FROM deal")
def _p15(spark, sf_dir):
    stuck = (F.col("status") == "pending") & (F.col("detected_at") < F.lit(NOW - timedelta(hours=4)))
    return deals(spark, sf_dir).select("deal_id", F.when(stuck, "failed").otherwise(F.col("status")).alias("status"))


@on_model("P3_insert_by_slug", "SELECT slug, min(product_id) AS product_id FROM product GROUP BY slug")
def _p3(m):
    rows = m.product.select("slug", "product_id")
    return state.insert_new(rows.where("product_id % 2 = 0"), rows, ["slug"], "product_id")


@query("P5_P6_first_of_batch", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2", base=False)
def _p5(spark, sf_dir):
    return prices.first_of(model.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id")])


@query("P21_padded_codes", "SELECT p_partkey, lpad(p_partkey::VARCHAR, 13, '0') AS ean FROM part", base=False)
def _p21(spark, sf_dir):
    return model.read(spark, sf_dir, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("ean"))


@query("A28_length_histogram", "SELECT length(p_partkey::VARCHAR)::INTEGER AS digits, count(*) AS n FROM part GROUP BY 1", base=False)
def _a28(spark, sf_dir):
    return model.read(spark, sf_dir, "part").groupBy(F.length(F.col("p_partkey").cast("string")).alias("digits")).agg(F.count(F.lit(1)).alias("n"))


@on_model("A37_list_by_store", "SELECT store_id, sum(price * (1 + product_id % 3))::BIGINT AS subtotal FROM fresh GROUP BY 1")
def _a37(m):
    return _fresh(m).groupBy("store_id").agg(F.sum(F.col("price") * (1 + F.col("product_id") % 3)).alias("subtotal"))
@on_model("A41_deals_from_history", """+ d AS (SELECT product_id, captured_at::DATE AS day, min(price) AS p FROM price JOIN link USING (sku_id) WHERE NOT suspect AND status IN ('auto', 'confirmed') GROUP BY 1, 2),
r AS (SELECT product_id, sum(p) AS s, count(*) AS n FROM d, clock WHERE day >= now::DATE - 365 GROUP BY 1 HAVING count(*) >= 5)
SELECT product_id, best_price, CASE WHEN (s - best_price * n) * 5 >= s THEN 'gold' ELSE 'green' END AS badge FROM agg JOIN r USING (product_id) WHERE best_price * n * 10 < s * 9 AND (s - best_price * n) * 10 <= s * 6 ORDER BY (best_price * n)::DOUBLE / s, product_id LIMIT 120""")
def _a41(m):
    """Best prices below nine tenths of a reference of at least five days; shares are compared as whole numbers."""
    days = prices.daily_series(m, TEST).where(F.col("day") >= F.lit((m.now - timedelta(days=365)).date()))
    ref = days.groupBy("product_id").agg(F.sum("min_price").alias("s"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    rows = _agg(m).join(ref, "product_id").where("best_price * n * 10 < s * 9 and (s - best_price * n) * 10 <= s * 6")
    badge = F.when(F.expr("(s - best_price * n) * 5 >= s"), "gold").otherwise("green")
    return rows.orderBy(F.expr("cast(best_price * n as double) / s"), "product_id").limit(120).select("product_id", "best_price", badge.alias("badge"))


@on_model("A46_match_statistics", "SELECT method, count(*) FILTER (status = 'auto') AS auto, count(*) FILTER (status = 'pending_review') AS pending, count(*) AS total FROM link GROUP BY 1")
def _a46(m):
    return m.link.groupBy("method").agg(F.count_if(F.col("status") == "auto").alias("auto"), F.count_if(F.col("status") == "pending_review").alias("pending"), F.count(F.lit(1)).alias("total"))


@on_model("J2_with_category", "SELECT product_id, coalesce(c.name, '-') AS category FROM product p LEFT JOIN category c ON c.category_id = p.category_id AND c.parent_id = 102")
def _j2(m):
    some = m.category.where("parent_id = 102").select("category_id", F.col("name").alias("c"))
    return m.product.join(F.broadcast(some), "category_id", "left").select("product_id", F.coalesce("c", F.lit("-")).alias("category"))


@on_model("J6_in_basket", "SELECT product_id, store_id, price FROM fresh WHERE product_id IN (SELECT product_id FROM counts WHERE stores >= 3)")
def _j6(m):
    offers = _fresh(m)
    wide = offers.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return offers.join(wide, "product_id", "left_semi").select("product_id", "store_id", "price")


@on_deals("J9_latest_publication", "SELECT c_custkey, (SELECT max(deal_id) FROM deal WHERE product_id = c_custkey AND status = 'published' AND detected_at = (SELECT max(detected_at) FROM deal WHERE product_id = c_custkey AND status = 'published'))::DOUBLE AS deal_id FROM customer")
def _j9(spark, sf_dir):
    last = deals(spark, sf_dir).where("status = 'published'").groupBy(F.col("product_id").alias("c_custkey")).agg(F.max(F.struct("detected_at", "deal_id")).alias("d"))
    return model.read(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.col("d.deal_id").cast("double").alias("deal_id"))


@on_model("J13_first_word", "SELECT a.product_id AS id_a, b.product_id AS id_b FROM product a JOIN product b ON split_part(a.name, ' ', 1) = split_part(b.name, ' ', 1) AND a.brand = b.brand AND a.size = b.size AND a.product_id < b.product_id")
def _j13(m):
    """Listings whose first words agree, blocked by brand and size too: an equal join in place of a pattern join."""
    from feria.operators import matching

    rows = m.product.select(F.col("product_id").alias("id"), "brand", "size", F.substring_index("name", " ", 1).alias("word"))
    return matching.blocked_pairs(rows, ["word", "brand", "size"]).select("id_a", "id_b")


@on_model("J16_state_lookups", "SELECT k.sku_id, l.price::DOUBLE AS last_price, s.is_active FROM sku k LEFT JOIN (SELECT DISTINCT ON (sku_id) sku_id, price FROM price WHERE NOT suspect ORDER BY sku_id, captured_at DESC, promo DESC, price) l USING (sku_id) JOIN store s USING (store_id)")
def _j16(m):
    last = _a13(m).select("sku_id", F.col("price").cast("double").alias("last_price"))
    return m.sku.join(last, "sku_id", "left").join(m.store.select("store_id", "is_active"), "store_id").select("sku_id", "last_price", "is_active")


@on_model("U2_stores_without_offer", "SELECT s.store_id, f.price::DOUBLE AS price FROM store s LEFT JOIN fresh f ON f.store_id = s.store_id AND f.product_id = 10")
def _u2(m):
    return m.store.select("store_id").join(_fresh(m).where("product_id = 10").select("store_id", "price"), "store_id", "left").select("store_id", F.col("price").cast("double").alias("price"))


@on_model("U3_difference", "SELECT sku_id FROM sku EXCEPT SELECT sku_id FROM valid")
def _u3(m):
    return m.sku.select("sku_id").distinct().join(prices.valid_prices(m, TEST).select("sku_id"), "sku_id", "left_anti")


@on_model("U4_disjoint_store_sets", "+ p AS (SELECT product_id, list(DISTINCT store_id) AS s FROM fresh GROUP BY 1) SELECT a.product_id AS id_a, b.product_id AS id_b FROM p a JOIN p b ON a.product_id + 4 = b.product_id WHERE NOT list_has_any(a.s, b.s)")
def _u4(m):
    p = _fresh(m).groupBy("product_id").agg(F.collect_set("store_id").alias("s"))
    a, b = p.select(F.col("product_id").alias("id_a"), F.col("s").alias("x"), (F.col("product_id") + 4).alias("id_b")), p.select(F.col("product_id").alias("id_b"), F.col("s").alias("y"))
    return a.join(b, "id_b").where(~F.arrays_overlap("x", "y")).select("id_a", "id_b")
@query("T3_units", "SELECT p_partkey, p_size::DOUBLE AS amount, 'g' AS unit FROM part", base=False)
def _t3(spark, sf_dir):
    u = text.unit(F.concat_ws(" ", "p_name", F.lit("x"), F.col("p_size").cast("string"), F.lit("gr")))
    return model.read(spark, sf_dir, "part").select("p_partkey", u["amount"].alias("amount"), u["unit"].alias("unit"))


@query("T4_packs", "SELECT p_partkey, (p_size % 12 + 1)::INTEGER AS n, p_size % 12 > 0 AS is_pack FROM part", base=False)
def _t4(spark, sf_dir):
    p = text.pack(F.concat_ws(" ", "p_name", F.concat((F.col("p_size") % 12 + 1).cast("string"), F.lit("x100ml"))))
    return model.read(spark, sf_dir, "part").select("p_partkey", p["count"].alias("n"), p["is_pack"].alias("is_pack"))


@query("T5_types", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'arroz,leche' ELSE 'yerba' END AS types FROM part", base=False)
def _t5(spark, sf_dir):
    name = F.concat_ws(" ", F.when(F.col("p_size") % 2 == 0, "Arroz con Leche").otherwise("YERBA"), F.lit("de"), F.col("p_size").cast("string"))
    return model.read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.types(name), ",").alias("types"))


@query("T6_tokens", "SELECT p_partkey, p_name AS name FROM part", base=False)
def _t6(spark, sf_dir):
    name = F.concat_ws(" ", F.lit("de la"), "p_name", F.lit("x"), F.col("p_size").cast("string"), F.lit("kg"))
    return model.read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.tokens(name), " ").alias("name"))


@query("T10_category_rules", "SELECT p_partkey, coalesce((SELECT path FROM (VALUES (1, 'cold', 'frozen'), (2, 'hot', 'warm'), (3, 'co', 'other')) r(i, prefix, path) WHERE starts_with(p_name, prefix) ORDER BY i LIMIT 1), 'general') AS path FROM part", base=False)
def _t10(spark, sf_dir):
    """First of ordered prefix rules; the rules are a table that the user gives."""
    rules = spark.createDataFrame([(1, "cold", "frozen"), (2, "hot", "warm"), (3, "co", "other")], "i int, prefix string, path string")
    hit = model.read(spark, sf_dir, "part").join(F.broadcast(rules), F.startswith("p_name", "prefix"), "left")
    return hit.groupBy("p_partkey").agg(F.coalesce(F.min_by("path", "i"), F.lit("general")).alias("path"))


@query("T19_title_case", "SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS name FROM part", base=False)
def _t19(spark, sf_dir):
    return model.read(spark, sf_dir, "part").select("p_partkey", text.title_case(F.col("p_name")).alias("name"))


@query("D2_local_day", "SELECT o_orderkey, strftime((o_orderdate::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'America/Argentina/Buenos_Aires', '%Y-%m-%d') AS day FROM orders", base=False)
def _d2(spark, sf_dir):
    """Days in the shops' own time zone, with its changes of summer time."""
    return model.read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "America/Argentina/Buenos_Aires"), "yyyy-MM-dd").alias("day"))


@query("D5_staleness", "SELECT o_orderkey, floor(greatest(epoch(TIMESTAMP '1999-06-01') - epoch(o_orderdate), 0) / 3600)::BIGINT AS hours, o_orderdate < TIMESTAMP '1999-06-01' - INTERVAL 7 DAY AS is_stale FROM orders", base=False)
def _d5(spark, sf_dir):
    ts = F.col("o_orderdate").cast("timestamp")
    age = F.greatest(F.unix_timestamp(F.lit(NOW)) - F.unix_timestamp(ts), F.lit(0))
    return model.read(spark, sf_dir, "orders").select("o_orderkey", F.floor(age / 3600).alias("hours"), (ts < F.lit(NOW - timedelta(days=7))).alias("is_stale"))


@query("M7_M10_flags", "SELECT p_partkey, greatest(p_retailprice * 300, p_size * 10000.0) > 250000 AND greatest(p_retailprice * 300, p_size * 10000.0) / least(p_retailprice * 300, p_size * 10000.0) > 5 AS outlier, p_retailprice <= 1000 * 1.05 AS near_low FROM part", base=False)
def _m7(spark, sf_dir):
    price = F.col("p_retailprice")
    outlier = prices.is_outlier(price * 300, F.col("p_size") * F.lit(10_000.0), TEST)
    return model.read(spark, sf_dir, "part").select("p_partkey", outlier.alias("outlier"), prices.is_near_low(price, F.lit(1000.0), TEST).alias("near_low"))


@query("M14_run_status", "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'success' WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 'partial' ELSE 'failed' END AS status FROM events GROUP BY 1", base=False)
def _m14(spark, sf_dir):
    bad = F.col("event_type") == "error"
    n = model.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(bad).alias("b"), F.count_if(~bad).alias("g"))
    return n.select("user_id", F.when(F.col("b") == 0, "success").when(F.col("g") > 0, "partial").otherwise("failed").alias("status"))


@query("X5_bigram_counts", "SELECT g, count(*) AS n FROM (SELECT substr(p_name, i, 2) AS g FROM part, range(1, 60) r(i) WHERE i < length(p_name)) GROUP BY 1", base=False)
def _x5(spark, sf_dir):
    return model.read(spark, sf_dir, "part").select(F.explode(text.bigrams(F.col("p_name"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@on_model("N6_offer_view", "SELECT p.slug, s.slug AS store, f.price, c.path FROM fresh f JOIN product p USING (product_id) JOIN store s USING (store_id) JOIN category c USING (category_id) WHERE s.is_active")
def _n6(m):
    rows = _fresh(m).join(m.product.select("product_id", "slug", "category_id"), "product_id").join(m.store.where("is_active").select("store_id", F.col("slug").alias("store")), "store_id")
    return rows.join(F.broadcast(m.category.select("category_id", "path")), "category_id").select("slug", "store", "price", "path")


@on_model("C3_product_card", "SELECT s.store_id, f.price::DOUBLE AS price, row_number() OVER (ORDER BY f.price IS NULL, f.price, s.name, s.store_id) AS position FROM store s LEFT JOIN fresh f ON f.store_id = s.store_id AND f.product_id = 31")
def _c3(m):
    """One product's offers in all stores: priced ones first, cheapest first, then by name (as many rows as stores)."""
    rows = m.store.join(_fresh(m).where("product_id = 31").select("store_id", "price"), "store_id", "left")
    order = Window.orderBy(F.col("price").isNull(), "price", "name", "store_id")
    return rows.select("store_id", F.col("price").cast("double").alias("price"), F.row_number().over(order).cast("long").alias("position"))


@on_model("C10_category_page", "SELECT category_id, count(*) AS n, min(best_price) AS cheapest, arg_min(product_id, best_price * 1000000 + product_id) AS product_id FROM agg JOIN product USING (product_id) WHERE stores >= 2 GROUP BY 1")
def _c10(m):
    rows = prices.publishable(_agg(m), TEST).join(m.product.select("product_id", "category_id"), "product_id")
    return rows.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.min("best_price").alias("cheapest"), F.min_by("product_id", F.struct("best_price", "product_id")).alias("product_id"))


