"""Payloads of sources, written from products and suppliers in the form that sources send, beside SQL over the tables.

Pages hold 25 articles each. Prices, stock, references and names vary by key, so that each rule of a parser decides somewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feria.plans.queries import query
from feria.sources import model, parsers

def _key() -> Column:
    return F.col("p_partkey")


def _price() -> Column:
    return F.col("p_retailprice").cast("double")


def _code() -> Column:
    return F.when(_key() % 4 != 0, F.lpad(_key().cast("string"), 13, "7")).otherwise(_key().cast("string"))


def _unit() -> Column:
    return F.when(_key() % 5 == 0, "UN").when(_key() % 5 == 1, "KG")


def _times() -> Column:
    return F.when(_key() % 3 == 0, 1.0).when(_key() % 3 == 1, 0.5)


def _listed() -> Column:
    """A list price above the price, below it, or none."""
    return F.when(_key() % 3 == 0, _price() + 10).when(_key() % 3 == 1, _price() - 10)


_LABEL = "CASE WHEN k % 5 = 0 AND k % 3 = 1 THEN '0,5 un' WHEN k % 5 = 1 AND k % 3 = 1 THEN '0,5 kg' WHEN k % 5 = 1 THEN '1 kg' END"
_PARTS = "WITH part_k AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_size AS size, p_retailprice::DOUBLE AS price, CASE WHEN p_partkey % 4 <> 0 THEN lpad(p_partkey::VARCHAR, 13, '7') END AS ean FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.read(spark, sf_dir, "part")


def _pages(rows: DataFrame, article: Column) -> DataFrame:
    """Pages of 25 articles, as items."""
    return rows.groupBy(F.floor(F.col(rows.columns[0]) / 25).alias("page")).agg(F.collect_list(article).alias("items"))


def _paths(df: DataFrame) -> DataFrame:
    return df.withColumn("categoryPath", F.array_join("categoryPath", ">"))


def _flat_price(df: DataFrame) -> DataFrame:
    return _paths(df).select("*", "price.*").drop("price").withColumn("unitPrice", F.col("unitPrice").cast("double"))


@query("S4_search_records", f"""{_PARTS}
SELECT 'p' || k AS "productId", 'i' || k AS "externalId", name, 'about ' || k AS description, CASE WHEN k % 6 <> 0 THEN brand END AS brand, 'https://shop/l' || k || '%20x/p' AS url, price AS amount,
  CASE WHEN k % 3 = 0 THEN price + 10 ELSE price END AS list_price, CASE WHEN k % 3 = 0 THEN 'promo' ELSE 'list' END AS "listOrPromo", ean, {_LABEL} AS "unitLabel", CASE WHEN k % 5 = 0 THEN 'un' WHEN k % 5 = 1 THEN 'kg' END AS "measurementUnit",
  CASE WHEN k % 3 = 0 THEN 1.0::DOUBLE WHEN k % 3 = 1 THEN 0.5::DOUBLE END AS "unitMultiplier", 'https://shop/' || k || '.png' AS "imageUrl", 'All>' || brand AS "categoryPath" FROM part_k WHERE k % 7 <> 0""", base=False)
def _s4(spark, sf_dir):
    """Records of search pages: sellers without stock, unavailable ones, and prices as texts come before the offer that counts."""
    offer = lambda price, stock, ready: F.struct(F.struct(price.cast("string").alias("Price"), _listed().alias("ListPrice"), F.lit(stock).alias("AvailableQuantity"), F.lit(ready).alias("IsAvailable")).alias("commertialOffer"))
    last = F.when(_key() % 7 != 0, offer(_price(), 3, None)).otherwise(offer(F.lit(0), 3, None))
    item = F.struct(F.concat(F.lit("i"), _key().cast("string")).alias("itemId"), F.when(_key() % 2 == 0, " ").alias("nameComplete"), F.col("p_name").alias("name"), _code().alias("ean"), _unit().alias("measurementUnit"), _times().alias("unitMultiplier"), F.array(F.struct(F.concat(F.lit("~/"), _key().cast("string"), F.lit(".png")).alias("imageUrl"))).alias("images"), F.array(offer(F.lit(1), 0, True), offer(F.lit(2), 5, False), last, offer(F.lit(0), 9, True)).alias("sellers"))
    product = F.struct(F.concat(F.lit("p"), _key().cast("string")).alias("productId"), F.concat(F.lit("l"), _key().cast("string"), F.lit(" x")).alias("linkText"), F.when(_key() % 6 != 0, F.col("p_brand")).otherwise("").alias("brand"), F.concat(F.lit("<p>about  "), _key().cast("string"), F.lit("</p>")).alias("description"), F.array(F.concat(F.lit("/All/ "), "p_brand", F.lit("/"))).alias("categories"), F.array(item).alias("items"))
    return _paths(parsers.search(_pages(_parts(spark, sf_dir), product).select(F.to_json("items").alias("json")), "https://shop/"))


@query("S8_embedded_cache", f"""{_PARTS}, c AS (SELECT *, CASE WHEN k % 8 < 5 THEN price ELSE size::DOUBLE END AS amount, CASE WHEN k % 8 < 5 AND k % 3 = 0 THEN price + 10 WHEN k % 8 < 5 THEN price END AS listed FROM part_k)
SELECT 'i' || k AS "externalId", name, brand, 'https://shop/p' || k || '/p' AS url, amount, listed AS list_price, CASE WHEN listed > amount THEN 'promo' ELSE 'list' END AS "listOrPromo", ean, CASE WHEN k % 4 = 1 THEN size || ' g' ELSE {_LABEL} END AS "unitLabel" FROM c""", base=False)
def _s8(spark, sf_dir):
    """Articles of pages whose offers lie one to eight references deep: behind more than five the product's range counts."""
    k, ref = _key().cast("string"), lambda to: F.concat(F.lit('{"type":"id","id":"'), to, F.lit('"}'))
    depth = (_key() % 8 + 1).cast("int")
    entry = lambda key, value: F.concat(F.lit('"'), key, F.lit('":'), value)
    offer = F.to_json(F.struct(_price().alias("Price"), _listed().alias("ListPrice")))
    chain = F.transform(F.sequence(F.lit(1), depth), lambda i: entry(F.concat(F.lit("r"), i.cast("string")), F.when(i == depth, offer).otherwise(ref(F.concat(F.lit("r"), (i + 1).cast("string"))))))
    own = F.to_json(F.struct(F.col("p_name").alias("productName"), F.col("p_brand").alias("brand")))
    product = F.concat(F.rtrim(own, F.lit("}")), F.lit(',"priceRange":{"type":"id","id":"range"},"specificationGroups":[{"type":"id","id":"group"}]}'))
    sku = F.concat(F.rtrim(F.to_json(F.struct(F.concat(F.lit("i"), k).alias("itemId"), _code().alias("ean"), _unit().alias("measurementUnit"), _times().alias("unitMultiplier"))), F.lit("}")), F.lit(',"sellers":[{"commertialOffer":{"type":"id","id":"r1"}}]}'))
    spec = F.when(_key() % 4 == 1, F.concat(F.lit(f'{{"name":"{parsers.UNIT_SPEC}","values":{{"type":"json","json":["'), F.col("p_size").cast("string"), F.lit(' g"]}}'))).otherwise('{"name":"none"}')
    rest = F.array(entry(F.concat(F.lit("Product:p"), k), product), entry(F.concat(F.lit("Product:p"), k, F.lit(".items({}).0")), sku), entry(F.lit("range"), F.concat(F.lit('{"sellingPrice":{"lowPrice":'), F.col("p_size").cast("string"), F.lit("}}"))), entry(F.lit("group"), F.lit('{"specifications":[{"type":"id","id":"spec"}]}')), entry(F.lit("spec"), spec))
    html = F.concat(F.lit("<script>{}</script><script>x={"), F.array_join(F.concat(rest, chain), ","), F.lit("};</script>"))
    got = parsers.embedded_cache(_parts(spark, sf_dir).select(html.alias("html")), "https://shop")
    return got.select("externalId", "name", "brand", "url", "amount", F.col("list_price").cast("double").alias("list_price"), "listOrPromo", "ean", "unitLabel")


@query("S9_inline_products", f"""{_PARTS}
SELECT 'i' || k AS "externalId", 'https://shop/app/?action=detail&itemId=i' || k AS url, CASE WHEN k % 2 = 0 THEN name || ' of ' || size ELSE name END AS "rawDescription", CASE WHEN k % 2 = 0 THEN 'of ' || size END AS description, ean, brand,
  CASE WHEN k % 3 = 0 THEN 'All>Rest' WHEN k % 3 = 1 THEN 'All>' || brand ELSE 'Rest' END AS "categoryPath", NULL AS "unitLabel", price AS amount, CASE WHEN k % 5 = 0 THEN 'promo' ELSE 'list' END AS "listOrPromo", NULL AS "promoLabel", NULL::DOUBLE AS "unitPrice", 'https://shop/app/' || k || '.png' AS "imageUrl" FROM part_k WHERE k % 7 <> 0""", base=False)
def _s9(spark, sf_dir):
    """Snapshots of arrays in scripts."""
    k = _key().cast("string")
    article = F.struct(
        F.concat(F.lit("i"), k).alias("id"), F.when(_key() % 2 == 0, " ").alias("foreign_id"), _code().alias("ean"), F.concat(F.lit(" "), "p_name").alias("name"), F.when(_key() % 2 == 0, F.concat(F.lit("of "), F.col("p_size").cast("string"))).alias("extended_description"), F.col("p_brand").alias("brand"),
        F.when(_key() % 3 != 2, "All").alias("super"), F.when(_key() % 3 == 1, F.col("p_brand")).alias("category"), F.when(_key() % 7 != 0, _price().cast("string")).otherwise("0").alias("price"), F.when(_key() % 5 == 0, _price() + 1).otherwise(_price()).alias("originalPrice"), F.array(F.struct(F.lit("").alias("name")), F.struct(F.concat(k, F.lit(".png")).alias("name"))).alias("imagesList"),
    )
    pages = _pages(_parts(spark, sf_dir), article).select(F.concat(F.lit("<script>var aProducts = "), F.to_json("items"), F.lit(";</script>")).alias("html"))
    return _flat_price(parsers.inline_products(pages, "https://shop/app/", label="Rest"))


@query("S13_payload", f"""{_PARTS}
SELECT 'c' || k AS "externalId", 'https://shop/producto/' || replace(name, ' ', '-') || '/c' || k AS url, name || CASE WHEN k % 3 = 0 THEN ' ' || size || ',5 KG' ELSE '' END AS "rawDescription", brand || ' ' || name || CASE WHEN k % 3 = 0 THEN ' ' || size || ',5 KG' ELSE '' END AS description, NULL AS ean, brand,
  CASE WHEN k % 2 = 0 THEN 'A>C' ELSE 'B' END AS "categoryPath", CASE WHEN k % 3 = 0 THEN size || ',5 KG' END AS "unitLabel", size + 0.25::DOUBLE AS amount, CASE WHEN k % 4 < 2 THEN 'promo' ELSE 'list' END AS "listOrPromo", NULL AS "promoLabel", CASE WHEN k % 5 <> 0 THEN size + 0.5::DOUBLE END AS "unitPrice", NULL AS "imageUrl" FROM part_k""", base=False)
def _s13_payload(spark, sf_dir):
    """Snapshots of posted pages with decimal commas."""
    size = F.col("p_size").cast("string")
    flag = F.get(F.array(F.lit("1"), F.lit("TRUE"), F.lit("0"), F.lit(None).cast("string")), (_key() % 4).cast("int"))
    article = F.struct(
        F.concat(F.lit("c"), _key().cast("string")).alias("cod_interno"), F.replace(F.col("p_name"), F.lit(" "), F.lit("  ")).alias("descripcion"), F.col("p_brand").alias("marca_desc"), F.concat(size, F.lit(",25")).alias("precio"), flag.alias("existe_promo"), F.when(_key() % 5 != 0, F.concat(size, F.lit(",50"))).otherwise("0").alias("precio_unitario"),
        F.concat(size, F.lit(",5")).alias("gramaje"), F.when(_key() % 3 == 0, "KG").alias("unimed_desc"), F.lit("a.png").alias("imagen"), F.lit("B").alias("categoria_desc"), F.when(_key() % 2 == 0, "A").alias("categoria_inicial_desc"), F.lit(" ").alias("categoria_secundaria_desc"), F.when(_key() % 2 == 0, "C").alias("categoria_terciaria_desc"),
    )
    pages = _pages(_parts(spark, sf_dir), article).select(F.to_json(F.struct(F.struct(F.col("items").alias("articulos")).alias("datos"))).alias("json"))
    return _flat_price(parsers.decimal_commas(pages, "https://shop"))


@query("S14_catalogue", f"""{_PARTS}
SELECT k::VARCHAR AS "externalId", 'https://shop/' AS url, name AS "rawDescription", NULL AS description, ean, NULL AS brand, CASE WHEN k % 2 = 0 THEN brand END AS "categoryPath", size || ' g' AS "unitLabel", price AS amount, CASE WHEN k % 3 = 0 THEN 'promo' ELSE 'list' END AS "listOrPromo", CASE WHEN k % 3 = 0 THEN '2x1' END AS "promoLabel", NULL::DOUBLE AS "unitPrice", 'https://shop/' || k AS "imageUrl" FROM part_k WHERE k % 7 <> 0""", base=False)
def _s14(spark, sf_dir):
    """Snapshots of a catalogue in one object a page."""
    article = F.struct(_key().alias("id"), F.concat(F.lit(" "), "p_name").alias("name"), _code().alias("barcode"), F.concat(F.col("p_size").cast("string"), F.lit(" g")).alias("size"), F.when(_key() % 2 == 0, F.col("p_brand")).alias("category"), F.when(_key() % 7 != 0, _price()).otherwise(0.0).alias("price"), (_key() % 3 == 0).alias("isOffer"), F.when(_key() % 3 == 0, "2x1").otherwise("").alias("promotion"), F.concat(F.lit("/"), _key().cast("string")).alias("imageUrl"))
    return _flat_price(parsers.flat(_pages(_parts(spark, sf_dir), article).select(F.to_json(F.struct(F.col("items").alias("products"))).alias("json")), "https://shop"))


@query("S11_listing", f"""{_PARTS}
SELECT k::VARCHAR AS "externalId", 'https://shop/products/' || k AS url, name || ' ' || size || 'g' AS "rawDescription", brand || ' ' || name || ' ' || size || 'g' AS description, ean, brand, 'c' || k % 5 AS "categoryPath", size || 'g' AS "unitLabel", CASE WHEN k % 3 = 0 THEN size + 0.5::DOUBLE ELSE price END AS amount,
  CASE WHEN k % 3 = 0 THEN 'promo' ELSE 'list' END AS "listOrPromo", CASE WHEN k % 3 = 0 THEN '25% off' END AS "promoLabel", CASE WHEN k % 2 = 0 THEN price END AS "unitPrice", CASE WHEN k % 2 = 1 THEN 'http://i/' || k END AS "imageUrl" FROM part_k WHERE k % 7 <> 0""", base=False)
def _s11(spark, sf_dir):
    """Snapshots of search pages with promotions: one without a discount and one without a price come first."""
    promotion = lambda off, unit, total: F.struct(F.lit(total).cast("string").alias("totalPrice"), unit.cast("string").alias("unitPrice"), F.lit("25% off").alias("content"), F.lit(off).alias("percentageOff"))
    good = F.when(_key() % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(",5")))
    article = F.struct(
        _key().alias("id"), F.replace(F.col("p_name"), F.lit(" "), F.lit("  ")).alias("description"), F.concat(F.col("p_size").cast("string"), F.lit("g ")).alias("presentation"), F.col("p_brand").alias("brand"), _code().alias("barcode"), F.when((_key() % 7 != 0) & (_key() % 2 == 0), _price()).alias("price"), F.when((_key() % 7 != 0) & (_key() % 2 == 1), _price().cast("string")).alias("strPrice"),
        F.when(_key() % 2 == 0, _price()).otherwise(0.0).alias("priceByUnity"), F.array(promotion(0.0, F.lit("1"), None), promotion(25.0, F.lit(None), None), promotion(25.0, good, None)).alias("promotions"), F.struct(F.lit(1).alias("id"), F.concat(F.lit("c"), (_key() % 5).cast("string")).alias("description")).alias("category"),
        F.struct(F.when(_key() % 2 == 1, F.concat(F.lit("http://i/"), _key().cast("string"))).otherwise("/i").alias("path")).alias("featuredImage"),
    )
    pages = _pages(_parts(spark, sf_dir), article).select(F.to_json(F.struct(F.struct(F.col("items").alias("content"), F.lit(1).alias("totalPages")).alias("products"))).alias("json"))
    return _flat_price(parsers.listing(pages, "https://shop"))


@query("S18_merchants", """SELECT 's' || s_suppkey AS slug, 'Ñandú "' || s_name || '" \\ sons' AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'Food' ELSE 'Otro' END AS rubro, NULL AS description, 'nation ' || s_nationkey AS address, CASE WHEN s_suppkey % 2 = 0 THEN 'pro' ELSE 'gratis' END AS plan, s_suppkey % 2 = 0 AS offers_allowed, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey END::INTEGER AS product_count FROM supplier WHERE s_suppkey % 7 <> 0""", base=False)
def _s18(spark, sf_dir):
    """Merchants of pages with a dehydrated state."""
    k = F.col("s_suppkey")
    merchant = F.struct(
        F.when(k % 7 != 0, F.concat(F.lit("s"), k.cast("string"))).otherwise(" ").alias("slug"), F.concat(F.lit('Ñandú "'), "s_name", F.lit('" \\ sons ')).alias("name"), F.when(k % 3 == 0, "Food").alias("rubro"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("address"),
        F.when(k % 2 == 0, " PRO").alias("plan_slug"), F.when(k % 5 == 0, F.lit("many")).otherwise(k.cast("string")).alias("product_count"),
    )
    state = lambda data: F.struct(F.struct(data.alias("data")).alias("state"))
    pages = _pages(model.read(spark, sf_dir, "supplier"), merchant)
    inner = F.to_json(F.struct(F.array(state(F.struct(F.lit(None).cast(pages.schema["items"].dataType).alias("merchants"))), state(F.struct(F.col("items").alias("merchants")))).alias("queries")))
    quoted = F.to_json(F.struct(inner.alias("v")))
    html = F.concat(F.lit("<script>x={dehydratedData:$R["), F.col("page").cast("string"), F.lit("]={queryState:"), F.substring(quoted, F.lit(6), F.length(quoted) - 6), F.lit(',other:"y"}};</script>'))
    return parsers.dehydrated(pages.select(html.alias("html")), ["pro"])
