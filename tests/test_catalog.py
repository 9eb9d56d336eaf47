"""Requests, the public functions, the jobs' decisions and the page parsers on small tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feria.functions import text
from feria.operators import catalog, jobs
from feria.sources import parsers, sinks


def test_cursor():
    assert [catalog.offset_of(catalog.cursor(n)) for n in (0, 8, 2**40)] == [0, 8, 2**40] and catalog.offset_of(None) == 0
    for bad in ("", "x", catalog.cursor(-1), catalog.cursor(1.5), catalog.cursor(True), catalog.cursor(2**53)):
        with pytest.raises(catalog.InvalidQuery):
            catalog.offset_of(bad)


def test_requests():
    assert catalog.request(" yerba ", "20", "a", ["x" * 65, " dia ", ""], catalog.cursor(5)) == catalog.Search("yerba", 20, 5, "a", ("dia",))
    for bad in ({"q": "a"}, {"q": None}, {"q": "a" * 65}, {"q": "ab", "limit": 0}, {"q": "ab", "limit": "x"}, {"q": "ab", "category": " "}, {"q": "ab", "at": "?"}):
        with pytest.raises(catalog.InvalidQuery):
            catalog.request(**bad)
    assert [catalog.request("ab", n, lenient=True).limit for n in (0, 99, "x", None)] == [1, 20, 8, 8]


def test_rematch(spark):
    """A clear match takes a conflicting link over, others wait for review; equal articles are left alone."""
    n = lambda c: text.normalized(F.col(c))
    rows = spark.createDataFrame([(1, 10, "auto", "gaseosa cola zero", "gaseosa cola light"), (2, 10, "auto", "gaseosa cola light", "gaseosa cola light"), (3, 11, "confirmed", "agua pack x 6", "agua"), (4, 11, "rejected", "agua pack x 6", "agua")], "sku_id long, product_id long, status string, a string, b string")
    bad = jobs.conflicts(rows.withColumn("sku_n", n("a")).withColumn("product_n", n("b")))
    for found, becomes in (((13, "pending_review", False), (11, "pending_review")), ((13, "pending_review", True), (13, "auto")), ((11, "auto", True), (11, "pending_review"))):
        matches = spark.createDataFrame([(1, 12, "auto", False), (3, *found)], "left_id long, right_id long, status string, by_ean boolean")
        assert sorted(map(tuple, jobs.rematched(bad, matches).collect())) == [(1, 12, "auto"), (3, *becomes)]


def test_merge_by_code_skips_products_of_one_store(spark):
    good, other = "4006381333931", "7791234567898"
    products = spark.createDataFrame([(1, good, datetime(2020, 1, 1)), (2, good, datetime(2021, 1, 1)), (3, other, None), (4, other, None), (5, "123", None), (6, "123", None)], "product_id long, ean string, updated_at timestamp")
    links = spark.createDataFrame([(1, 7), (2, 8), (3, 7), (4, 7), (5, 1), (6, 2)], "product_id long, store_id long")
    assert sorted(map(tuple, jobs.merged_by_code(products, links).collect())) == [(1, 2), (2, 2)]


def test_other_sizes_by_mode(spark):
    products = spark.createDataFrame([(1, None, None, None), (2, "x", None, None)], "product_id long, ean string, unit_amount double, unit_type string")
    rows = [(1, 1, None, 1.0, "kg"), (2, 1, None, 1000.0, "g"), (3, 1, None, 500.0, "g"), (4, 1, None, None, None), (5, 2, "x", 1.0, "l"), (6, 2, None, 2.0, "l"), (7, 2, None, 2.0, "l")]
    links = spark.createDataFrame(rows, "sku_id long, product_id long, ean string, amount double, unit string").select("sku_id", "product_id", "ean", F.struct("amount", "unit").alias("unit"))
    assert sorted(map(tuple, jobs.other_sizes(products, links).collect())) == [(3, 1, "size")]


def test_embedded_cache(spark):
    cache = {
        "Product:rice": {"productName": "Rice", "priceRange": {"type": "id", "id": "$range"}, "categories": {"type": "json", "json": ["/Almacen/Arroz/"]}},
        "Product:rice.items({}).0": {"itemId": "9", "nameComplete": "Rice 1 kg", "ean": "4006381333931", "unitMultiplier": 0.5, "measurementUnit": "KG", "sellers": [{"type": "id", "id": "$seller"}], "images": [{"type": "id", "id": "$image"}]},
        "Product:rice.items({}).1": {"itemId": "8", "name": "Rice", "ean": "1", "sellers": [], "images": []},
        "Product:rice.items({}).2": {"itemId": "9", "name": "again"},
        "$seller": {"commertialOffer": {"type": "id", "id": "$offer"}}, "$offer": {"Price": 10.0, "ListPrice": 12.5}, "$image": {"imageUrl": "~/a.png"},
        "$range": {"sellingPrice": {"type": "id", "id": "$side"}}, "$side": {"lowPrice": 0, "highPrice": 7},
    }
    html = f'<script>{{"other": 1}}</script><script type="x">window.s = {json.dumps(cache)};</script>'
    got = {r.externalId: r for r in parsers.embedded_cache(spark.createDataFrame([(html,), ("none",), (None,)], "html string"), "https://shop").collect()}
    assert set(got) == {"9", "8"}
    nine = got["9"]
    assert (nine.name, nine.amount, nine.list_price, nine.listOrPromo, nine.ean, nine.unitLabel, nine.imageUrl, nine.categoryPath) == ("Rice 1 kg", 10.0, 12.5, "promo", "4006381333931", "0,5 kg", "https://shop/a.png", ["Almacen", "Arroz"])
    assert (got["8"].amount, got["8"].ean) == (7.0, None)


def test_references_of_a_cache(spark):
    """References at every depth: chains of up to five are followed, longer ones and circles give nothing, nor do entries that
    lack; specifications give the unit before the article does."""
    ref = lambda to: {"type": "id", "id": to}
    chain = lambda name, n, end: {f"{name}{i}": ref(f"{name}{i + 1}") for i in range(1, n)} | {f"{name}{n}": end}
    offer = {"Price": "10.5", "ListPrice": 9}
    cache = {
        "Product:tea": {"productId": "77", "productName": "Tea", "brand": "Own", "linkText": "tea-now", "description": " ", "metaTagDescription": "<b>Good</b>  tea", "specificationGroups": [ref("none"), ref("g1")], "priceRange": ref("range")},
        "g1": ref("g2"), "g2": {"specifications": [ref("s0"), ref("s1")]}, "s0": {"name": "Other", "values": {"type": "json", "json": ["x"]}}, "s1": {"name": parsers.UNIT_SPEC, "values": {"type": "json", "json": ["250 g"]}},
        "range": {"sellingPrice": {"lowPrice": 0, "highPrice": 8.5}, "listPrice": {"lowPrice": 9}},
        "Product:tea.items({\"f\":1}).0": {"itemId": "a", "name": "Tea a", "measurementUnit": "un", "sellers": [{"commertialOffer": {"Price": 0}}, ref("x1")], "images": [ref("i1")]},
        "Product:tea.items({\"f\":1}).1": {"itemId": "b", "name": "Tea b", "sellers": [ref("y1")]},
        "Product:tea.items({\"f\":1}).2": {"itemId": "c", "sellers": [ref("z1")], "images": [{"imageUrl": "http://i/c"}]},
        "Product:gone.items({}).0": {"itemId": "d", "name": "no product"}, "Product:tea.items({}).x": {"itemId": "e", "name": "no place"},
        **chain("x", 5, {"commertialOffer": ref("o1")}), **chain("o", 5, offer), **chain("y", 6, {"commertialOffer": offer}), "z1": ref("z2"), "z2": ref("z1"), **chain("i", 3, {"imageUrl": "~/a.png"}),
    }
    small = {"Product:other": {}, "Product:other.items({}).0": {"itemId": "z", "name": "in the smaller script"}}
    html = f"<script>{json.dumps(small)}</script><script>w={json.dumps(cache)};</script><script>{{broken {'x' * 9000}}}</script>"
    got = {r.externalId: r for r in parsers.embedded_cache(spark.createDataFrame([(html,)], "html string"), "https://shop/").collect()}
    assert set(got) == {"a", "b", "c"}
    assert [(got[k].amount, got[k].list_price, got[k].listOrPromo) for k in "abc"] == [(10.5, 10.5, "list"), (8.5, 9.0, "promo"), (8.5, 9.0, "promo")]
    a = got["a"]
    assert (a.productId, a.brand, a.url, a.description, a.unitLabel, a.imageUrl, a.name) == ("77", "Own", "https://shop/tea-now/p", "Good tea", "250 g", "https://shop/a.png", "Tea a")
    assert (got["c"].name, got["c"].imageUrl) == ("Tea", "http://i/c")


def test_dehydrated(spark):
    """The state as pages have it, under any number, with quotes and backslashes in names; pages without it, or with none."""
    data = {"queries": [{"state": {"data": {"user": 1}}}, {"state": {"data": {"merchants": [{"slug": "b", "name": "Ñandú \"el\" \\ dos", "plan_slug": "PRO", "product_count": 3}, {"slug": "a", "name": "Nadie"}, {"slug": "", "name": "x"}]}}}]}
    page = lambda n, d: f'<script>x={{dehydratedData:$R[{n}]={{queryState:{json.dumps(json.dumps(d))},other:"y"}}}};</script>'
    rows = [(page(4, data),), ("none",), (None,), (page(12, {"queries": []}),), ('dehydratedData:$R[1]={other:"a"}',)]
    got = parsers.dehydrated(spark.createDataFrame(rows, "html string"), ["pro"]).collect()
    assert [(r.slug, r.name, r.rubro, r.plan, r.offers_allowed, r.product_count) for r in got] == [("a", "Nadie", "Otro", "gratis", False, 0), ("b", 'Ñandú "el" \\ dos', "Otro", "pro", True, 3)]


def test_flat_and_listing_payloads(spark):
    articles = [{"id": 1, "name": " n ", "price": 2.5, "barcode": "12", "size": "1 kg", "category": "c", "isOffer": True, "promotion": "2x1", "imageUrl": "/i.png"}, {"id": "2", "name": "m", "price": 0.0}, {"id": "3", "name": "o", "price": 4, "barcode": "4006381333931", "imageUrl": "http://i"}]
    for payload in (articles, {"products": articles}):
        got = {r.externalId: r for r in parsers.flat(spark.createDataFrame([(json.dumps(payload),), ("{}",)], "json string"), "https://shop").collect()}
        assert {k: (r.rawDescription, r.ean, r.categoryPath, r.unitLabel, tuple(r.price)[:3], r.imageUrl) for k, r in got.items()} == {"1": ("n", None, ["c"], "1 kg", (2.5, "promo", "2x1"), "https://shop/i.png"), "3": ("o", "4006381333931", None, None, (4.0, "list", None), "http://i")}
    promo = [{"percentageOff": 0.0, "unitPrice": "1"}, {"percentageOff": 25.0, "unitPrice": "1762.50", "totalPrice": "3525", "content": "25% off"}]
    article = lambda i, name, shown, price, **more: {"id": i, "description": name, "presentation": shown, "brand": " LA  MARCA ", "barcode": "7790070431486", "price": price, "promotions": [], "category": {"id": 15040, "description": "LARGO FINO", "parentId": 10043}, "featuredImage": {"path": "https://img/x.png"}} | more
    content = [article(911205, "ARROZ  LARGO FINO", " 1kg", 2050, priceByUnity=2050), article(911208, "ARROZ PARBOIL", "1kg", 2350, promotions=promo), article(913471, "ARROZ", "500 grs", None, strPrice="900.50", barcode="1"), article(None, "x", "", 1), article(7, " ", "", 1), article(8, "y", "", 0)]
    page = json.dumps({"products": {"content": content, "totalPages": 1}})
    got = {r.externalId: r for r in parsers.listing(spark.createDataFrame([(page,), (None,), ("{}",)], "json string"), "https://shop.example/").collect()}
    assert set(got) == {"911205", "911208", "913471"}
    rice = got["911205"]
    assert (rice.url, rice.rawDescription, rice.description, rice.brand, rice.ean, rice.categoryPath, rice.unitLabel, rice.imageUrl) == ("https://shop.example/products/911205", "ARROZ LARGO FINO 1kg", "LA MARCA ARROZ LARGO FINO 1kg", "LA MARCA", "7790070431486", ["LARGO FINO"], "1kg", "https://img/x.png")
    assert tuple(rice.price) == (2050.0, "list", None, 2050.0) and tuple(got["911208"].price) == (1762.5, "promo", "25% off", None)
    assert (got["913471"].price.amount, got["913471"].ean) == (900.5, None)
    units = spark.createDataFrame([(r.externalId, r.rawDescription) for r in got.values()], "i string, t string").select("i", text.unit(F.col("t")).alias("u")).collect()
    assert {r.i: tuple(r.u) for r in units} == {"911205": (1.0, "kg"), "911208": (1.0, "kg"), "913471": (500.0, "g")}
    paths = spark.createDataFrame([(15040, ["Almacen", "Arroz"])], "category_id long, path array<string>")
    assert {tuple(r.categoryPath) for r in parsers.listing(spark.createDataFrame([(page,)], "json string"), "https://shop.example", paths=paths).collect()} == {("Almacen", "Arroz")}


def test_sync_modes(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "id int, price int, last_seen_at int")
    old, new = frame([(1, 5, 1), (2, 6, 1)]), frame([(2, 7, 2), (3, 8, 2)])
    run = lambda mode: sorted(r.id * 100 + r.price for r in sinks.synced(old, new, ["id"], mode, 2).collect())
    assert [run(m) for m in ("replace", "upsert", "close_offers")] == [[207, 308], [105, 207, 308], [207, 308]]
    sinks.csv(spark.createDataFrame([("a;b", 'c"d')], "x string, y string"), str(tmp_path / "c"))
    written = b"".join(p.read_bytes() for p in (tmp_path / "c").glob("*.csv")).decode()
    assert written.startswith("\ufeffx;y\r\n") and '"a;b";"c""d"\r\n' in written


def test_money_and_labels(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert [value(text.money(F.lit(n).cast("long"))) for n in (5, 159099, -1234567890)] == ["$ 0,05", "$ 1.590,99", "-$ 12.345.678,90"]
    assert value(text.difference_hash(F.array(*[F.lit(-(i % 9)) for i in range(72)]))) == "f" * 16
    assert value(text.difference_hash(F.array(*[F.lit(i % 9) for i in range(72)]))) == "0" * 16
    assert value(text.difference_hash(F.array(*[F.lit(7)] * 72))) == "f" * 16
    assert value(text.difference_hash(F.array(F.lit(1)))) is None
