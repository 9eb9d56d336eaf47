"""Ingest in batches and as a stream, and the payload parsers."""

import json

from pyspark.sql import functions as F

from feria.sources import parsers
from feria.streaming import ingest


def snapshot(i, amount=1000.0, url="https://shop.example.com/p", ean=None, kind="list"):
    return {"externalId": i, "url": url, "rawDescription": "Arroz 1 kg", "ean": ean, "price": {"amount": amount, "listOrPromo": kind}, "capturedAt": "2026-08-24T12:00:00+00:00"}


def test_stream_ingest(spark, tmp_path):
    rows = [snapshot("a"), snapshot("a"), snapshot("b", -5.0), snapshot("c", 100.0), snapshot("d", url="https://other.example.org/x"), snapshot(""), snapshot("e", ean="7791120037550"), snapshot("f", ean="4006381333931")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.json").write_text("\n".join(map(json.dumps, rows)))
    ingest.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), ["example.com"]).awaitTermination()
    got = {r.externalId: r for r in spark.read.parquet(str(tmp_path / "out/prices")).collect()}
    assert set(got) == {"a", "e", "f"} and got["e"].ean is None and got["f"].ean == "4006381333931"
    bad = {r.externalId: r.reason for r in spark.read.parquet(str(tmp_path / "out/rejected")).collect()}
    assert bad == {"b": "invalid_price", "c": "below_min_price", "d": "invalid_source_url", "": "invalid_snapshot"}
    again = spark.read.parquet(str(tmp_path / "out/prices")).drop("batch", "run", "day")
    assert ingest.not_yet(again, again).isEmpty()


def test_runs_meet_what_is_known(spark, tmp_path):
    """Two batches and a later run: the first of a run counts, a replay adds nothing, jumps are suspects of the later run
    only, and products made by one batch are found by the next."""
    (tmp_path / "in").mkdir()

    def at(i, amount, hour, text="Arroz Largo Fino 1 kg", ean=None, kind="list"):
        return {**snapshot(i, amount, ean=ean, kind=kind), "rawDescription": text, "capturedAt": f"2026-08-24T{hour:02}:00:00+00:00"}

    def ingest_files(name, *files):
        for k, rows in enumerate(files):
            (tmp_path / f"in/{name}-{k}.json").write_text("\n".join(map(json.dumps, rows)))
        ingest.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), ["example.com"], run_id=name, files=1, now=F.lit("2026-08-25").cast("timestamp")).awaitTermination()

    log = lambda t: ingest.log(spark, str(tmp_path / "out"), t)
    ingest_files("one", [at("a", 2000.0, 2), at("a", 1000.0, 1), at("b", 900.0, 1, ean="4006381333931")], [at("a", 1500.0, 3), at("c", 800.0, 1, "Otra cosa", "4006381333931")])
    assert sorted((r.externalId, r.price, r.is_suspect) for r in log("prices").collect()) == [("a", 100000, False), ("b", 90000, False), ("c", 80000, False)]
    links = {r.externalId: (r.method, r.slug) for r in log("links").collect()}
    assert links["c"] == ("ean", links["b"][1]) and links["a"][1] != links["b"][1] and log("products").count() == 2
    ingest_files("two", [at("a", 1000.0, 1), at("b", 9000.0, 5, ean="4006381333931"), at("c", 850.0, 5, "Otra cosa", "4006381333931")])
    two = log("prices").where("run = 'two'").collect()
    assert sorted((r.externalId, r.price, r.is_suspect) for r in two) == [("b", 900000, True), ("c", 85000, False)]
    assert log("links").count() == 3 and log("products").count() == 2
    assert ingest.current(log("listings"), "externalId", "last_seen_at").count() == 3


def test_run_beside_other_stores(spark, tmp_path):
    """A price far from what other stores ask is a suspect on its first day; days of the log that a batch lacks are pruned."""
    (tmp_path / "in").mkdir()
    rows = [snapshot("a", 300_000.0), snapshot("b", 300_000.0), {**snapshot("c", 900.0), "capturedAt": "2026-08-25T12:00:00+00:00"}]
    (tmp_path / "in/one.json").write_text("\n".join(map(json.dumps, rows)))
    others = spark.createDataFrame([("a", 5_000_000.0), ("b", 29_000_000.0)], "sku_id string, median_other double")
    ingest.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), ["example.com"], others=others).awaitTermination()
    log = ingest.log(spark, str(tmp_path / "out"), "prices")
    assert sorted((r.externalId, r.is_suspect, str(r.day)) for r in log.collect()) == [("a", True, "2026-08-24"), ("b", False, "2026-08-24"), ("c", False, "2026-08-25")]
    new = log.where("externalId = 'c'").select("captured_at")
    assert {r.externalId for r in ingest.of_days(log, new).collect()} == {"c"}


def test_alerts(spark):
    hour = lambda n: F.timestamp_seconds(F.lit(n * 3600))
    runs = spark.createDataFrame([(1, 1, False, 0, 0), (1, 2, False, 0, 0), (1, 3, False, 0, 9), (2, 3, True, 70, 30), (3, 3, True, 99, 1)], "store_id int, t int, ok boolean, captured int, rejected int").withColumn("started_at", F.timestamp_seconds(F.col("t") * 3600))
    stores = spark.createDataFrame([(1, 3), (2, 3), (3, 3), (4, None)], "store_id int, t int").withColumn("last_at", F.timestamp_seconds(F.col("t") * 3600))
    got = lambda now: sorted(map(tuple, ingest.alerts(stores, runs, hour(now)).collect()))
    assert got(4) == [(1, "failed"), (1, "quarantine"), (1, "rejection"), (2, "rejection"), (4, "stale")]
    assert got(90) == [(1, "failed"), (1, "rejection"), (1, "stale"), (2, "rejection"), (2, "stale"), (3, "stale"), (4, "stale")]


def test_quarantine(spark):
    runs = spark.createDataFrame([(1, 1, False), (1, 2, False), (1, 3, False), (2, 1, False), (2, 2, True), (2, 3, False)], "store_id int, t int, ok boolean")
    runs = runs.withColumn("started_at", F.timestamp_seconds(F.col("t") * 3600))
    assert [(r.store_id, r.failures) for r in ingest.quarantine(runs).collect()] == [(1, 3)]


def test_highest_by_user_as_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 1.0)], "user_id long, value double").write.parquet(str(tmp_path / "e"))
    q = ingest.highest(spark.readStream.schema("user_id long, value double").parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("top_values").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.user_id, r.value) for r in spark.table("top_values").collect()} == {(1, 7.0), (2, 1.0)}


def test_search_payload(spark):
    """As sources send it: offers by seller, numbers as numbers or texts, no word on availability, empty members."""
    offer = lambda price, stock, **more: {"commertialOffer": {"Price": price, "AvailableQuantity": stock, **more}}
    sellers = [{}, {"commertialOffer": None}, offer(10.0, 0, IsAvailable=True), offer(9, 4, IsAvailable=False), offer("11.5", "3", ListPrice="12"), offer(1, 5)]
    page = [
        {"productId": "1", "productName": "x", "linkText": "a b", "categories": ["/Almacen/ Arroz/"], "description": " ", "metaTagDescription": "<b>a</b>  b", "brand": "", "items": [{"itemId": "9", "nameComplete": " x 1 ", "ean": " 4006381333931 ", "measurementUnit": "KG", "unitMultiplier": "0.5", "images": [{"imageUrl": "~/i.png"}], "sellers": sellers}]},
        {"productId": "2", "productName": "y", "items": [{"itemId": "8", "ean": "123", "measurementUnit": "un", "sellers": [offer(5, 1, IsAvailable=None, ListPrice=4)]}, {"itemId": "7"}]},
        {"productId": "3", "productName": "y", "items": []}, {"productId": "4", "items": [{"itemId": "6", "sellers": [offer(5, 1)]}]}, {"productName": "no id", "items": [{"itemId": "5", "sellers": [offer(5, 1)]}]}, None,
    ]
    got = {r.externalId: r for r in parsers.search(spark.createDataFrame([(json.dumps(page),), ("broken",), (None,)], "json string"), "https://shop").collect()}
    assert set(got) == {"9", "8"}
    a, b = got["9"], got["8"]
    assert (a.productId, a.name, a.amount, a.list_price, a.listOrPromo, a.ean, a.unitLabel, a.unitMultiplier, a.imageUrl, a.categoryPath, a.description, a.brand, a.url) == ("1", "x 1", 11.5, 12.0, "promo", "4006381333931", "0,5 kg", 0.5, "https://shop/i.png", ["Almacen", "Arroz"], "a b", None, "https://shop/a%20b/p")
    assert (b.name, b.amount, b.list_price, b.listOrPromo, b.ean, b.unitLabel, b.categoryPath, b.url) == ("y", 5.0, 5.0, "list", None, None, None, "https://shop/2/p")


def test_decimal_commas_payload(spark):
    articles = [
        {"cod_interno": " 12 ", "descripcion": "Yerba  Ñandú, suave", "marca_desc": "La Marca", "precio": "1234,50", "existe_promo": "1", "precio_unitario": "2,5 x", "gramaje": "0,5", "unimed_desc": "KG", "imagen": "x.png", "categoria_inicial_desc": "A", "categoria_secundaria_desc": " ", "categoria_terciaria_desc": "C"},
        {"cod_interno": "13", "descripcion": "Agua", "precio": "7", "existe_promo": "no", "categoria_desc": "B", "gramaje": "1", "imagen": "http://i"},
        {"cod_interno": "14", "descripcion": "free", "precio": "0"}, {"cod_interno": None, "descripcion": "x", "precio": "1"}, {"cod_interno": "15", "precio": "1"},
    ]
    got = {r.externalId: r for r in parsers.decimal_commas(spark.createDataFrame([(json.dumps({"estado": 1, "datos": {"articulos": articles}}),), ("{}",), (None,)], "json string"), "https://shop").collect()}
    assert set(got) == {"12", "13"}
    a, b = got["12"], got["13"]
    assert (a.url, a.rawDescription, a.description, a.brand, a.categoryPath, a.unitLabel, tuple(a.price), a.imageUrl) == ("https://shop/producto/yerba-nandu-suave/12", "Yerba Ñandú, suave 0,5 KG", "La Marca Yerba Ñandú, suave 0,5 KG", "La Marca", ["A", "C"], "0,5 KG", (1234.5, "promo", None, 2.5), None)
    assert (b.rawDescription, b.categoryPath, b.unitLabel, tuple(b.price), b.imageUrl) == ("Agua", ["B"], None, (7.0, "list", None, None), "http://i")


def test_inline_products(spark):
    rows = [
        {"id": "1", "foreign_id": " ", "ean": "4006381333931", "name": " Arroz ", "extended_description": "largo  fino", "brand": "La  Marca", "super": "Almacen", "webItem": None, "category": "Arroz", "price": "989.26", "originalPrice": 1200, "imagesList": [{"name": ""}, {"name": "img/a.png"}]},
        {"id": "2", "foreign_id": "x 9", "name": "Sal", "price": 5, "originalPrice": 5, "imagesList": [{"name": "/i.png"}]}, {"id": "3", "name": "free", "price": "0"}, {"id": "4", "price": 1}, {"name": "no id", "price": 1},
    ]
    html = f"<script>var aProducts = {json.dumps(rows)};</script>"
    got = {r.externalId: r for r in parsers.inline_products(spark.createDataFrame([(html,), ("none",), (None,)], "html string"), "https://shop/app/", label="Todo").collect()}
    assert set(got) == {"1", "x 9"}
    a, b = got["1"], got["x 9"]
    assert (a.url, a.rawDescription, a.description, a.ean, a.brand, a.categoryPath, a.price.amount, a.price.listOrPromo, a.imageUrl) == ("https://shop/app/?action=detail&itemId=1", "Arroz largo fino", "largo  fino", "4006381333931", "La Marca", ["Almacen", "Arroz"], 989.26, "promo", "https://shop/app/img/a.png")
    assert (b.url, b.rawDescription, b.categoryPath, b.price.listOrPromo, b.imageUrl) == ("https://shop/app/?action=detail&itemId=x%209", "Sal", ["Todo"], "list", "https://shop/i.png")


def test_inline_array(spark):
    html = '<script>var aProducts = [{"id": "1", "name": "n", "price": 2.5}];</script>'
    assert [(r.id, r.price) for r in parsers.inline_array(spark.createDataFrame([(html,)], "html string"), "aProducts").collect()] == [("1", 2.5)]
