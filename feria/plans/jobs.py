"""Queries of the maintenance jobs, lists and scalars of the inventory, each beside its SQL."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce
from operator import add

from pyspark.sql import functions as F

from feria.functions import text
from feria.operators import catalog, jobs, prices
from feria.plans.more import NOW, deals, on_deals
from feria.plans.queries import TEST, _agg, _fresh, on_model, query
from feria.sources import model

#: A product's code: three products share one, and each tenth has a wrong check digit.
_DIGITS = "lpad((product_id // 3)::VARCHAR, 12, '0')"
_CHECK = f"(10 - (SELECT sum(substr({_DIGITS}, i, 1)::INTEGER * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) FROM range(1, 13) r(i)) % 10) % 10"
_CODES = f"codes AS (SELECT product_id, product_id % 10 <> 0 AS valid, {_DIGITS} || (({_CHECK} + CASE WHEN product_id % 10 = 0 THEN 1 ELSE 0 END) % 10)::VARCHAR AS ean FROM product)"


def code(product_id: F.Column) -> F.Column:
    def digits(n: F.Column) -> F.Column:
        odd = reduce(add, [F.floor(n / 10 ** (12 - i)) % 10 * (3 if i % 2 == 0 else 1) for i in range(1, 13)])
        return F.concat(F.lpad(n.cast("string"), 12, "0"), (((10 - odd % 10) % 10 + F.when(product_id % 10 == 0, 1).otherwise(0)) % 10).cast("string"))

    return F.get(F.transform(F.array(F.floor(product_id / 3)), digits), 0)


def _coded(m: model.Model):
    return m.product.withColumn("ean", code(F.col("product_id")))


@on_model("E6_match_by_code", f"+ {_CODES} SELECT k.sku_id AS left_id, (SELECT min(c.product_id) FROM codes c WHERE c.ean = o.ean) AS right_id FROM sku k JOIN codes o ON o.product_id = k.product_key")
def _e6(m):
    listings = m.sku.join(_coded(m).select(F.col("product_id").alias("product_key"), "ean"), "product_key").select(F.col("sku_id").alias("id"), "ean")
    return jobs.by_code(listings, _coded(m).select(F.col("product_id").alias("id"), "ean"))


@query("E9_bulk_status", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN (CASE WHEN (p_partkey % 101) / 100.0 < 0.75 OR p_size = 7 THEN 'pending_review' ELSE 'auto' END) WHEN (p_partkey % 101) / 100.0 >= 0.82 THEN 'auto' ELSE 'new' END AS status FROM part", base=False)
def _e9(spark, sf_dir):
    key = F.col("p_partkey")
    return model.read(spark, sf_dir, "part").select("p_partkey", jobs.bulk_status((key % 101) / 100, key % 3 == 0, F.col("p_size") == 7).alias("status"))


@query("E2_E3_presentation", """SELECT p_partkey, p_size % 5 <> p_size % 3 AS conflict, CASE WHEN p_size % 4 = 0 THEN 0.8 WHEN p_size % 4 = 1 THEN 0.6 WHEN p_size % 4 = 2 THEN (CASE WHEN least(p_size, 25) / greatest(p_size, 25)::DOUBLE >= 0.9 THEN 1.05 WHEN least(p_size, 25) / greatest(p_size, 25)::DOUBLE < 0.5 THEN 0.05 ELSE 0.5 END) END AS factor FROM part""", base=False)
def _e2(spark, sf_dir):
    """Packs of other counts, and sizes that are missing, of another kind, alike or far apart."""
    from feria.operators import matching

    size = F.col("p_size")
    pack = lambda n: F.struct((size % n).alias("count"), F.lit(True).alias("is_pack"))
    a = F.struct(F.when(size % 4 != 3, size.cast("double")).alias("amount"), F.when(size % 4 != 3, "g").alias("unit"))
    b = F.struct(F.when(size % 4 == 1, 1.0).when(size % 4 == 2, 0.025).alias("amount"), F.when(size % 4 == 1, "l").when(size % 4 == 2, "kg").alias("unit"))
    return model.read(spark, sf_dir, "part").select("p_partkey", matching.presentation_conflict(pack(5), pack(3)).alias("conflict"), matching.unit_factor(a, b).alias("factor"))


@query("E8_image_factor", "SELECT p_partkey, CASE WHEN bit_count(xor(p_partkey * 7919, 43690::BIGINT)) <= 5 THEN 1.05 WHEN bit_count(xor(p_partkey * 7919, 43690::BIGINT)) >= 32 THEN 0.5 ELSE 1.0 END AS factor FROM part", base=False)
def _e8(spark, sf_dir):
    return model.read(spark, sf_dir, "part").select("p_partkey", jobs.image_factor(F.hex(F.col("p_partkey") * 7919), F.lit("AAAA")).alias("factor"))


_MERGED = f"""{_CODES}, sold AS (SELECT DISTINCT l.product_id, k.store_id FROM link l JOIN sku k USING (sku_id)),
n AS (SELECT l.product_id, count(*) AS links, max(last_seen_at) AS seen FROM link l JOIN sku USING (sku_id) GROUP BY 1),
groups AS (SELECT ean FROM codes WHERE valid GROUP BY 1 HAVING count(*) > 1),
clash AS (SELECT ean, count(*) - count(DISTINCT store_id) AS c FROM codes JOIN sold USING (product_id) WHERE valid GROUP BY 1),
merged AS (SELECT product_id, first_value(product_id) OVER (PARTITION BY ean ORDER BY coalesce(links, 0) DESC, seen DESC NULLS LAST, product_id) AS keep_id
  FROM codes JOIN groups USING (ean) LEFT JOIN clash USING (ean) LEFT JOIN n USING (product_id) WHERE valid AND coalesce(c, 0) = 0)"""


def _merged(m):
    links = m.link.select("sku_id", "product_id").join(m.sku.select("sku_id", "store_id", "last_seen_at"), "sku_id")
    seen = links.groupBy("product_id").agg(F.max("last_seen_at").alias("updated_at"))
    return jobs.merged_by_code(_coded(m).join(seen, "product_id", "left").select("product_id", "ean", "updated_at"), links.select("product_id", "store_id"))


@on_model("E13_merge_by_code", f"+ {_MERGED} SELECT * FROM merged")
def _e13(m):
    return _merged(m)


@query("E13_moved_deals", f"+ {_MERGED}, deal AS (SELECT o_orderkey AS deal_id, o_custkey AS product_id, o_orderdate::TIMESTAMP AS detected_at FROM orders), after AS (SELECT deal_id, coalesce(keep_id, d.product_id) AS product_id, coalesce(keep_id <> d.product_id, false) AS moved, ((detected_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/Argentina/Buenos_Aires')::DATE AS day FROM deal d LEFT JOIN merged USING (product_id)) SELECT DISTINCT ON (product_id, day) product_id, strftime(day, '%Y-%m-%d') AS day, deal_id, moved FROM after ORDER BY product_id, day, moved, deal_id")
def _e13_deals(spark, sf_dir):
    got = jobs.moved_deals(deals(spark, sf_dir).select("deal_id", "product_id", "detected_at"), _merged(model.from_star(spark, sf_dir)))
    return got.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_WORDS = ("light", "zero", "de")


def _described(m):
    """Links with texts on both sides: variants and packs that depend on the keys."""
    word = lambda c, n: F.get(F.array(*[F.lit(w) for w in _WORDS]), (c % n).cast("int"))
    sku = text.normalized(F.concat_ws(" ", F.lit("galletitas"), word(F.col("sku_id"), 3), F.when(F.col("sku_id") % 5 == 0, "pack x 6")))
    product = text.normalized(F.concat_ws(" ", F.lit("galletitas"), word(F.col("product_id"), 2), F.when(F.col("product_id") % 5 == 0, "pack x 6")))
    return m.link.select("sku_id", "product_id", "status", sku.alias("sku_n"), product.alias("product_n"))


@on_model("E15_conflicting_links", "SELECT sku_id, product_id FROM link WHERE status IN ('auto', 'confirmed') AND ((sku_id % 3 < 2 AND sku_id % 3 <> product_id % 2) OR (sku_id % 5 = 0) <> (product_id % 5 = 0))")
def _e15(m):
    return jobs.conflicts(_described(m)).select("sku_id", "product_id")


@on_model("E16_other_sizes", """+ l AS (SELECT sku_id, product_id, CASE sku_id % 4 WHEN 0 THEN size * 1000.0 WHEN 1 THEN size * 1.0 WHEN 2 THEN size * 960.0 END AS base, sku_id % 8 = 5 AS ml, CASE WHEN sku_id % 9 = 0 THEN 'same' END AS ean FROM link JOIN product USING (product_id) WHERE status IN ('auto', 'confirmed')),
n AS (SELECT product_id FROM l GROUP BY 1 HAVING count(*) > 1)
SELECT sku_id, product_id, CASE WHEN ml THEN 'scale' ELSE 'size' END AS reason FROM l JOIN product USING (product_id) JOIN n USING (product_id)
WHERE base IS NOT NULL AND ean IS NULL AND (ml OR least(base, size * 1000.0) / greatest(base, size * 1000.0) < 0.95)""")
def _e16(m):
    """Products are of `size` kilograms; listings say so in kilograms, in grams, a little less, or nothing."""
    s, k = F.col("size").cast("double"), F.col("sku_id")
    unit = F.when(k % 4 == 0, F.struct(s.alias("amount"), F.lit("kg").alias("unit"))).when(k % 4 == 1, F.struct(s.alias("amount"), F.when(k % 8 == 5, "ml").otherwise("g").alias("unit"))).when(k % 4 == 2, F.struct((s * 0.96).alias("amount"), F.lit("kg").alias("unit")))
    links = m.link.where(F.col("status").isin(*TEST.valid_status)).join(m.product, "product_id").select("sku_id", "product_id", F.when(k % 9 == 0, "same").alias("ean"), unit.alias("unit"))
    return jobs.other_sizes(m.product.select("product_id", F.lit("same").alias("ean"), F.col("size").alias("unit_amount"), F.lit("kg").alias("unit_type")), links)


_RULES = [("cold", "asia/nation_8"), ("hot", "europe"), ("old", "nowhere")]


@on_model("E17_retagged", """+ texts AS (SELECT l.product_id, CASE WHEN sku_id % 2 = 0 THEN 'hot ' || name ELSE name END AS t FROM link l JOIN product p ON p.product_id = l.product_id WHERE l.status = 'auto'),
signal AS (SELECT p.product_id, category_id, coalesce((SELECT t FROM texts WHERE texts.product_id = p.product_id ORDER BY length(t) DESC, t LIMIT 1), name) AS s FROM product p),
tag AS (SELECT product_id, c.path AS old_path, CASE WHEN starts_with(s, 'cold') THEN 'asia/nation_8' WHEN starts_with(s, 'hot') THEN 'europe' WHEN starts_with(s, 'old') THEN 'nowhere' ELSE 'america' END AS new_path FROM signal LEFT JOIN category c USING (category_id))
SELECT product_id, old_path, new_path FROM tag WHERE NOT (old_path IS NOT NULL AND new_path = 'america') AND old_path IS DISTINCT FROM new_path AND new_path IN (SELECT path FROM category)""")
def _e17(m):
    texts = m.link.where("status = 'auto'").join(m.product.select("product_id", "name"), "product_id").select("product_id", F.when(F.col("sku_id") % 2 == 0, F.concat(F.lit("hot "), "name")).otherwise(F.col("name")).alias("text"))
    return jobs.retagged(jobs.longest_text(m.product, texts), m.category, _RULES, "america")


_ORPHANS = f"""{_CODES}, listing AS (SELECT sku_id, store_id, product_key, last_seen_at, sku_id % 13 <> 0 AS is_active, CASE WHEN sku_id % 2 = 0 THEN ean END AS ean, p.name AS text FROM sku JOIN product p ON p.product_id = product_key JOIN codes c ON c.product_id = product_key),
orphan AS (SELECT l.*, n.price_count FROM listing l JOIN (SELECT sku_id, count(*) AS price_count FROM price GROUP BY 1) n USING (sku_id) WHERE is_active AND NOT EXISTS (SELECT 1 FROM link WHERE link.sku_id = l.sku_id)),
by_code AS (SELECT sku_id, c.product_id FROM orphan JOIN codes c USING (ean)),
by_word AS (SELECT DISTINCT o.sku_id, p.product_id FROM (SELECT * FROM orphan WHERE ean IS NULL OR ean NOT IN (SELECT ean FROM codes)) o JOIN (SELECT product_id, unnest(list_distinct(string_split(lower(name), ' '))) AS word FROM product) p ON p.word = lower(split_part(o.text, ' ', 1))),
links AS (SELECT sku_id, min(product_id) AS product_id, 'ean' AS method, 'auto' AS status FROM by_code GROUP BY 1 UNION ALL
  SELECT sku_id, min(product_id), 'semantic', 'pending_review' FROM by_word WHERE sku_id NOT IN (SELECT sku_id FROM by_code) GROUP BY 1)"""


def _listings(m):
    own = _coded(m).select(F.col("product_id").alias("product_key"), "ean", F.col("name").alias("text"))
    k = F.col("sku_id")
    return m.sku.join(own, "product_key").select("sku_id", "store_id", "product_key", "last_seen_at", (k % 13 != 0).alias("is_active"), F.when(k % 2 == 0, F.col("ean")).alias("ean"), "text")


def _orphans(m):
    return jobs.orphans(_listings(m), m.link, m.price)


@on_model("N7_orphan_listings", f"+ {_ORPHANS} SELECT sku_id, store_id, price_count FROM orphan")
def _n7(m):
    return _orphans(m).select("sku_id", "store_id", "price_count")


@on_model("N7_orphans_by_code", f"+ {_ORPHANS} SELECT * FROM by_code")
def _n7_code(m):
    return jobs.orphans_by_code(_orphans(m), _coded(m))


@on_model("N7_orphans_by_word", f"+ {_ORPHANS} SELECT sku_id, count(*) AS products FROM by_word GROUP BY 1")
def _n7_word(m):
    """The products that an orphan's first word leads to, counted."""
    return jobs.first_by_word(_orphans(m), _coded(m)).select("sku_id", "products")


@on_model("N7_orphan_summary", f"+ {_ORPHANS} SELECT (SELECT count(*) FROM orphan) AS orphans, (SELECT count(DISTINCT sku_id) FROM by_code) AS by_code, (SELECT count(DISTINCT sku_id) FROM by_word) AS by_word, (SELECT count(*) FROM orphan WHERE sku_id NOT IN (SELECT sku_id FROM links)) AS unmatched, (SELECT sum(price_count)::BIGINT FROM orphan) AS prices")
def _n7_summary(m):
    """Counts of the orphan views: one row each."""
    rows, coded = _orphans(m), _coded(m)
    code, word = jobs.orphans_by_code(rows, coded).select("sku_id").distinct(), jobs.first_by_word(rows, coded).select("sku_id")
    got = rows.join(code.withColumn("c", F.lit(1)), "sku_id", "left").join(word.withColumn("w", F.lit(1)), "sku_id", "left")
    return got.agg(F.count(F.lit(1)).alias("orphans"), F.count("c").alias("by_code"), F.count("w").alias("by_word"), F.count_if(F.col("c").isNull() & F.col("w").isNull()).alias("unmatched"), F.sum("price_count").alias("prices"))


@on_model("E11_E18_orphan_links", f"+ {_ORPHANS} SELECT * FROM links")
def _e18(m):
    rows, coded = _orphans(m), _coded(m)
    return jobs.orphan_links(jobs.orphans_by_code(rows, coded), jobs.first_by_word(rows, coded)).select("sku_id", "product_id", "method", "status")


@on_model("W11_repeated_listings", f"+ {_ORPHANS} SELECT sku_id, store_id, product_key // 4 AS external_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_key // 4 ORDER BY last_seen_at DESC NULLS LAST, sku_id) AS rn FROM listing WHERE is_active) WHERE rn > 1")
def _w11(m):
    return jobs.repeated_listings(_listings(m).withColumn("external_id", F.expr("product_key div 4"))).withColumn("rn", F.col("rn").cast("long"))


@query("A34_modal_packs", """WITH t AS (SELECT l_partkey AS product_id, l_orderkey * 10 + l_linenumber AS place, l_suppkey % 4 AS k FROM lineitem),
d AS (SELECT product_id, k > 0 AS is_pack, CASE k WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 12 END AS n, count(*) AS c, min(place) AS f FROM t GROUP BY 1, 2, 3)
SELECT DISTINCT ON (product_id) product_id, n::DOUBLE AS count, is_pack FROM d ORDER BY product_id, is_pack DESC, c DESC, f""", base=False)
def _a34(spark, sf_dir):
    k = F.col("l_suppkey") % 4
    words = F.when(k == 0, "agua 1 unidad").when(k == 1, "agua 6 x 500 ml").when(k == 2, "agua pack de 12").otherwise("agua pack")
    rows = model.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), words.alias("text"))
    return jobs.modal_packs(rows).withColumn("count", F.col("count").cast("double"))


@query("T11_category_of_path", """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'bebidas/gaseosas' WHEN 1 THEN 'bebidas' WHEN 2 THEN 'almacen' WHEN 3 THEN 'bebidas/gaseosas' END AS path FROM part""", base=False)
def _t11(spark, sf_dir):
    """An equal segment, a segment with the word in it, one within the word, a deeper one; none."""
    aliases = [("gaseosas", "bebidas/gaseosas"), ("bebidas", "bebidas"), ("almacenes", "almacen")]
    path = [("Bebidas", "Gaseosas"), ("Otros", "Las bebidas frías"), ("Almacén",), ("Bebidas", "Bebidas", "Gaseosas"), ("Otros",)]
    cases = F.coalesce(*[F.when(F.col("p_size") % 5 == i, F.array(*[F.lit(s) for s in p])) for i, p in enumerate(path)])
    return model.read(spark, sf_dir, "part").select("p_partkey", text.category_of_path(cases, aliases).alias("path"))


@on_model("T12_resolved_category", "SELECT product_id, CASE WHEN product_id % 4 = 0 THEN path WHEN product_id % 4 = 1 THEN 'asia' WHEN product_id % 4 = 2 THEN split_part(path, '/', 1) ELSE NULL END AS path FROM product JOIN category USING (category_id)")
def _t12(m):
    """The deeper path; the name's if equally deep; the raw path's root; nothing."""
    known = m.category.agg(F.collect_set("path").alias("known"))  # one row: the categories
    k, path = F.col("product_id") % 4, F.col("path")
    store = F.when(k == 0, path).when(k == 1, "europe").otherwise("not/known")
    name = F.when(k < 2, "asia")
    raw = F.when(k == 2, F.concat("path", F.lit("/more"))).when(k == 3, "other/thing")
    raw = F.when(k == 2, F.concat(F.substring_index("path", "/", 1), F.lit("/unknown"))).otherwise(raw)
    return m.product.join(m.category.select("category_id", "path"), "category_id").crossJoin(F.broadcast(known)).select("product_id", jobs.resolved_category(store, name, raw, F.col("known")).alias("path"))


@query("T18_unit_label", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_size % 3 = 0 THEN NULL ELSE CASE p_size % 4 WHEN 0 THEN '1' WHEN 1 THEN '0,5' WHEN 2 THEN '2' ELSE '1,25' END || CASE WHEN p_size % 3 = 0 THEN ' un' ELSE ' kg' END END AS label FROM part", base=False)
def _t18(spark, sf_dir):
    size = F.col("p_size")
    many = F.when(size % 4 == 0, 1.0).when(size % 4 == 1, 0.5).when(size % 4 == 2, 2.0).otherwise(1.25)
    return model.read(spark, sf_dir, "part").select("p_partkey", text.unit_label(many, F.when(size % 3 == 0, "un").otherwise("kg")).alias("label"))


@query("D3_nightly_window", "SELECT o_orderkey, hour(o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400)) BETWEEN 3 AND 8 AS nightly FROM orders", base=False)
def _d3(spark, sf_dir):
    """Between midnight and six at three hours behind UTC."""
    ts = F.timestamp_add("SECOND", F.col("o_orderkey") % 86_400, F.col("o_orderdate").cast("timestamp"))
    local = ts - F.make_dt_interval(hours=F.lit(3))
    return model.read(spark, sf_dir, "orders").select("o_orderkey", (F.hour(local) < 6).alias("nightly"))


@query("D4_freshness_hours", "SELECT o_orderkey, floor(greatest(epoch(TIMESTAMP '1999-06-01') - epoch(o_orderdate::TIMESTAMP) - o_orderkey % 86400, 0) / 360 + 0.5) / 10 AS hours FROM orders", base=False)
def _d4(spark, sf_dir):
    ts = F.timestamp_add("SECOND", F.col("o_orderkey") % 86_400, F.col("o_orderdate").cast("timestamp"))
    return model.read(spark, sf_dir, "orders").select("o_orderkey", prices.hours_between(ts, F.lit(NOW)).alias("hours"))


@query("D8_day_edges", "SELECT o_orderkey, o_orderdate::DATE >= DATE '1999-06-01' - 90 AS by_day, o_orderdate::DATE >= TIMESTAMP '1999-06-01 12:00' - INTERVAL 90 DAY AS by_time FROM orders", base=False)
def _d8(spark, sf_dir):
    """A window from the start of its first day, and from the same time of that day."""
    day, noon = F.to_date("o_orderdate"), NOW + timedelta(hours=12)
    return model.read(spark, sf_dir, "orders").select("o_orderkey", (day >= F.date_sub(F.lit(noon.date()), 90)).alias("by_day"), (day.cast("timestamp") >= F.lit(noon - timedelta(days=90))).alias("by_time"))


@query("M3_money", "SELECT p_partkey, '$ ' || replace(format('{:,}', (round(p_retailprice * 100)::BIGINT * 37) // 100), ',', '.') || ',' || lpad(((round(p_retailprice * 100)::BIGINT * 37) % 100)::VARCHAR, 2, '0') AS shown FROM part", base=False)
def _m3(spark, sf_dir):
    return model.read(spark, sf_dir, "part").select("p_partkey", text.money(F.round(F.col("p_retailprice") * 100).cast("long") * 37).alias("shown"))


@query("M9_price_days_ago", "SELECT p_partkey, CASE WHEN p_size > 1 THEN round(p_retailprice / (1 + (p_size * 4 - 104) / 100.0::DOUBLE), 2) END AS earlier FROM part", base=False)
def _m9(spark, sf_dir):
    return model.read(spark, sf_dir, "part").select("p_partkey", prices.price_days_ago(F.col("p_retailprice"), (F.col("p_size") * 4 - 104).cast("double")).alias("earlier"))


@query("M12_difference_hash", """WITH g AS (SELECT p_partkey, list_transform(range(72), lambda i: (p_partkey * (i + 7) * 31 + i * i) % 251) AS px FROM part)
SELECT p_partkey, string_agg(format('{:x}', list_sum(list_transform(range(4), lambda b: CASE WHEN px[(d * 4 + b) // 8 * 9 + (d * 4 + b) % 8 + 1] >= px[(d * 4 + b) // 8 * 9 + (d * 4 + b) % 8 + 2] THEN (8 >> b) ELSE 0 END))::BIGINT), '' ORDER BY d) AS hash FROM g, range(16) r(d) GROUP BY 1""", base=False)
def _m12(spark, sf_dir):
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (F.col("p_partkey") * (i + 7) * 31 + i * i) % 251)
    rows = model.spread(model.read(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return rows.select("p_partkey", text.difference_hash(pixels).alias("hash"))


@on_deals("P11_decided", "SELECT deal_id AS sku_id, CASE WHEN status = 'pending' AND deal_id % 4 = 0 THEN 'confirmed' WHEN status = 'pending' AND deal_id % 4 = 1 THEN 'rejected' WHEN status = 'pending' THEN 'pending_review' ELSE status END AS status, CASE WHEN status = 'pending' AND deal_id % 4 < 2 THEN 'admin' END AS decided_by FROM deal")
def _p11(spark, sf_dir):
    rows = deals(spark, sf_dir).select(F.col("deal_id").alias("sku_id"), F.when(F.col("status") == "pending", "pending_review").otherwise(F.col("status")).alias("status"))
    said = rows.where("sku_id % 4 < 3").select("sku_id", F.when(F.col("sku_id") % 4 == 0, "confirmed").when(F.col("sku_id") % 4 == 1, "rejected").otherwise("later").alias("decision"), F.lit("admin").alias("by"))
    return jobs.decided(rows, said, F.lit(NOW)).drop("decided_at")


@on_model("P12_may_retry", "SELECT i AS store_id, CASE WHEN s.store_id IS NULL THEN 404 WHEN NOT is_active THEN 400 WHEN i % 3 = 0 THEN 409 ELSE 202 END AS answer FROM range(0, 200) r(i) LEFT JOIN store s ON s.store_id = i")
def _p12(m):
    asked = m.store.sparkSession.range(200).select(F.col("id").alias("store_id"))
    started = F.lit(NOW) - F.make_dt_interval(hours=F.when(F.col("store_id") % 3 == 0, 2).otherwise(5))
    runs = m.store.select("store_id", started.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))
    return jobs.may_retry(asked, m.store, runs, F.lit(NOW))


@on_model("P17_refined_images", "SELECT product_id, CASE WHEN product_id % 5 = 0 THEN 'old' WHEN product_id % 5 = 1 AND product_id % 2 = 0 THEN 'new' WHEN product_id % 5 = 1 THEN 'old' ELSE 'new' END AS image_url, CASE WHEN product_id % 5 = 0 THEN 'a' WHEN product_id % 5 = 1 AND product_id % 2 = 1 THEN 'a' ELSE 'b' END AS image_hash FROM product")
def _p17(m):
    """No later image; another one with a hash known or not; the same one; none before."""
    k = F.col("product_id")
    url = F.when(k % 5 < 2, "old").when(k % 5 == 2, "new")
    have = m.product.select("product_id", url.alias("image_url"), F.when((k % 5 == 0) | ((k % 5 == 1) & (k % 2 == 1)) | (k % 5 > 1), "a").alias("image_hash"))
    return jobs.refined_images(have, m.product.where("product_id % 5 != 0").select("product_id", F.lit("new").alias("image_url"), F.lit("b").alias("image_hash")))


@query("F18_anonymous_rows", "SELECT o_orderkey AS deal_id FROM orders WHERE o_orderstatus = 'F'", base=False)
def _f18_deals(spark, sf_dir):
    return jobs.may_read(model.from_star(spark, sf_dir).store, deals(spark, sf_dir))[1].select("deal_id")


@on_model("F18_anonymous_stores", "SELECT store_id FROM store WHERE is_active")
def _f18_stores(m):
    return jobs.may_read(m.store, m.store.sparkSession.createDataFrame([], "status string"))[0].select("store_id")


@on_model("O16_pending_matches", "SELECT sku_id, product_id, method FROM link JOIN product USING (product_id) WHERE status = 'pending_review' ORDER BY method, slug, sku_id LIMIT 200")
def _o16(m):
    rows = m.link.where("status = 'pending_review'").join(m.product.select("product_id", "slug"), "product_id")
    return rows.orderBy("method", "slug", "sku_id").limit(200).select("sku_id", "product_id", "method")


@query("O17_latest_runs", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100", base=False)
def _o17(spark, sf_dir):
    return model.read(spark, sf_dir, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100).select("event_id")


@on_model("O18_candidate_pool", "+ seen AS (SELECT product_key AS product_id, max(last_seen_at) AS seen_at FROM sku GROUP BY 1) SELECT product_id FROM product LEFT JOIN seen USING (product_id) ORDER BY seen_at DESC NULLS LAST, product_id LIMIT 100000")
def _o18(m):
    seen = m.sku.groupBy(F.col("product_key").alias("product_id")).agg(F.max("last_seen_at").alias("at"))
    return m.product.join(seen, "product_id", "left").orderBy(F.col("at").desc_nulls_last(), "product_id").limit(100_000).select("product_id")


@on_model("O13_missing_price_last", "SELECT product_id, best_price::DOUBLE AS best_price FROM product LEFT JOIN agg USING (product_id) ORDER BY best_price DESC NULLS LAST, product_id LIMIT 50")
def _o13(m):
    rows = m.product.select("product_id").join(_agg(m).select("product_id", "best_price"), "product_id", "left")
    return rows.orderBy(F.col("best_price").desc_nulls_last(), "product_id").limit(50).withColumn("best_price", F.col("best_price").cast("double"))


@query("J15_runs_by_text_key", "SELECT event_id, n_name FROM events LEFT JOIN nation ON n_nationkey::VARCHAR = json_extract_string(props, '$.k')", base=False)
def _j15(spark, sf_dir):
    """A left join of a number with a text key."""
    nation = model.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    return model.read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).join(nation, "k", "left").select("event_id", "n_name")


@on_model("W2_latest_without_price", "SELECT product_id, store_id, captured_at, promo FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY captured_at DESC, promo DESC) AS rn FROM valid) WHERE rn = 1")
def _w2(m):
    key = F.struct("captured_at", F.col("promo").cast("int").alias("p"))
    best = prices.valid_prices(m, TEST).groupBy("product_id", "store_id").agg(F.max(key).alias("k"))
    return best.select("product_id", "store_id", "k.captured_at", (F.col("k.p") == 1).alias("promo"))


@on_model("A17_basket_of_store", "SELECT r.product_id, f.price::DOUBLE AS price FROM (SELECT DISTINCT product_id FROM fresh) r LEFT JOIN fresh f ON f.product_id = r.product_id AND f.store_id = 3")
def _a17(m):
    offers = _fresh(m)
    return offers.groupBy("product_id").agg(F.max(F.when(F.col("store_id") == 3, F.col("price"))).cast("double").alias("price"))


@on_model("K3_full_history", "SELECT sku_id, captured_at, promo, price, store_id FROM price JOIN sku USING (sku_id)")
def _k3(m):
    """All records in the order of their export; sinks write them as they come."""
    return m.price.join(m.sku.select("sku_id", "store_id"), "sku_id").select("sku_id", "captured_at", "promo", "price", "store_id").orderBy("captured_at", "sku_id", "promo")


@on_model("K7_matched_copy", "SELECT sku_id, captured_at, promo, price FROM price JOIN link USING (sku_id) WHERE NOT suspect AND status IN ('auto', 'confirmed')")
def _k7(m):
    links = m.link.where(F.col("status").isin(*TEST.valid_status)).select("sku_id")
    return m.price.where("not suspect").join(links, "sku_id", "left_semi").select("sku_id", "captured_at", "promo", "price")


@query("K9_run_durations", "SELECT user_id, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS seconds, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'success' WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 'partial' ELSE 'failed' END AS status FROM events GROUP BY 1", base=False)
def _k9(spark, sf_dir):
    bad = F.col("event_type") == "error"
    n = model.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(bad).alias("b"), F.count_if(~bad).alias("g"), F.min("ts").alias("from"), F.max("ts").alias("to"))
    return n.select("user_id", (F.unix_timestamp("to") - F.unix_timestamp("from")).alias("seconds"), F.when(F.col("b") == 0, "success").when(F.col("g") > 0, "partial").otherwise("failed").alias("status"))


# --- the public functions

_Q = "small plate"


def _grams(t: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({t}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _alike(a: str, b: str) -> str:
    return f"len(list_intersect({_grams(a)}, {_grams(b)}))::DOUBLE / len(list_distinct(list_concat({_grams(a)}, {_grams(b)})))"


_FOUND = f"""+ sim AS (SELECT name, {_alike('name', repr(_Q))} AS score FROM (SELECT DISTINCT name FROM product)),
found AS (SELECT p.slug, p.name, p.brand, c.path AS category, a.best_price, a.stores, a.best_captured_at, score FROM product p JOIN sim USING (name) JOIN category c USING (category_id) JOIN agg a USING (product_id)
  WHERE (score > 0.3 OR contains(p.name, '{_Q}') OR contains(lower(p.brand), '{_Q}')) AND (c.path = 'asia' OR starts_with(c.path, 'asia/')) AND stores >= 2 AND best_price >= 500000
    AND product_id IN (SELECT product_id FROM fresh WHERE store_id BETWEEN 1 AND 60))"""


def _asked(m, limit: int, offset: int):
    stores = [f"supplier-{i:09d}" for i in range(1, 61)]
    return catalog.request(_Q, limit, "asia", stores, catalog.cursor(offset))


@on_model("N1_search_products", _FOUND + " SELECT * EXCLUDE (score) FROM found ORDER BY score DESC, best_price, slug LIMIT 20 OFFSET 3")
def _n1(m):
    """A page of a search by name within a category and some stores."""
    return catalog.search_products(m, _asked(m, 20, 3), TEST)


@on_model("O11_search_total", _FOUND + " SELECT count(*) AS total FROM found")
def _o11(m):
    return catalog.search_total(m, _asked(m, 12, 0), TEST)


_SLUG = "(SELECT slug FROM product WHERE product_id = (SELECT min(product_id) FROM agg WHERE stores >= 2))"


def _some_slug(m) -> str:
    least = prices.publishable(_agg(m), TEST).agg(F.min("product_id").alias("product_id"))
    return m.product.join(least, "product_id").select("slug").first()[0]  # one value, as a reader would ask for


@on_model("N2_product_detail", f"""+ one AS (SELECT * FROM product WHERE slug = {_SLUG}),
rec AS (SELECT p.*, l.product_id, k.store_id FROM price p JOIN link l USING (sku_id) JOIN sku k USING (sku_id) WHERE NOT p.suspect AND l.status IN ('auto', 'confirmed') AND l.product_id IN (SELECT product_id FROM one)),
offers AS (SELECT DISTINCT ON (store_id) store_id, price FROM rec ORDER BY store_id, captured_at DESC, promo DESC, price, sku_id)
SELECT slug, name, category, best_price, stores, (SELECT string_agg(s.slug || ':' || price, ',' ORDER BY price, s.slug) FROM offers JOIN store s USING (store_id) WHERE s.is_active) AS offers
FROM (SELECT o.slug, o.name, c.path AS category, a.best_price, a.stores FROM one o JOIN agg a USING (product_id) LEFT JOIN category c USING (category_id))""")
def _n2(m):
    """The card of the first published product."""
    got = catalog.product_detail(m, _some_slug(m), TEST)
    offers = F.array_join(F.transform("offers", lambda o: F.concat(o["store"], F.lit(":"), o["price"].cast("string"))), ",")
    return got.select("slug", "name", "category", "aggregate.best_price", "aggregate.stores", offers.alias("offers"))


@on_model("N3_product_history", f"""+ d AS (SELECT strftime(captured_at, '%Y-%m-%d') AS day, min(price) AS low FROM price JOIN link USING (sku_id) WHERE NOT suspect AND status IN ('auto', 'confirmed') AND product_id = (SELECT min(product_id) FROM agg WHERE stores >= 2) GROUP BY 1)
SELECT {_SLUG} AS slug, string_agg(day || ':' || low, ',' ORDER BY day) AS series, min(low)::DOUBLE AS low, max(low)::DOUBLE AS high FROM d""")
def _n3(m):
    got = catalog.product_history(m, _some_slug(m), "all", TEST)
    series = F.array_join(F.transform("series", lambda d: F.concat(d["day"].cast("string"), F.lit(":"), d["min_price"].cast("string"))), ",")
    return got.select("slug", series.alias("series"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))


@on_model("T20_sql_functions", "SELECT product_id, split_part(slug, '-', 1) AS first_part, left(name, 5) AS head, lpad(product_id::VARCHAR, 8, '0') AS padded, regexp_matches(name, '^[a-m]') AS early, coalesce(nullif(brand, 'Brand#11'), '-') AS brand FROM product")
def _t20(m):
    brand = F.coalesce(F.nullif("brand", F.lit("Brand#11")), F.lit("-"))
    return m.product.select("product_id", F.split_part("slug", F.lit("-"), F.lit(1)).alias("first_part"), F.left("name", F.lit(5)).alias("head"), F.lpad(F.col("product_id").cast("string"), 8, "0").alias("padded"), F.col("name").rlike("^[a-m]").alias("early"), brand.alias("brand"))


@on_model("A29_link_diagnosis", "SELECT store_id, count(*) AS listings, count(l.sku_id) AS linked, round(count(l.sku_id) * 100.0 / count(*), 4) AS pct, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share FROM sku k LEFT JOIN link l USING (sku_id) GROUP BY store_id")
def _a29(m):
    n = m.sku.join(m.link.select("sku_id", F.lit(1).alias("hit")), "sku_id", "left").groupBy("store_id").agg(F.count(F.lit(1)).alias("listings"), F.count("hit").alias("linked"))
    whole = n.agg(F.sum("listings").alias("t"))  # one row
    rate = lambda a, b: F.round(F.col(a) * 100.0 / F.col(b), 4).cast("double")
    return n.crossJoin(F.broadcast(whole)).select("store_id", "listings", "linked", rate("linked", "listings").alias("pct"), rate("listings", "t").alias("share"))


@query("P20_seeded", "SELECT n_nationkey AS id, n_name AS name FROM nation", base=False)
def _p20(spark, sf_dir):
    """A seed of all rows over some that are there, twice: what is there stays."""
    from feria.operators import state

    rows = model.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    once = state.insert_new(rows.where("id % 2 = 0"), rows, ["id"], "name")
    return state.insert_new(once, rows, ["id"], "name")
