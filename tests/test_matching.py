"""Matching and candidates on small tables."""

import duckdb
from test_queries import SF, pytestmark  # noqa: F401

from feria.plans.queries import QUERIES


def test_hot_words_in_blocks(spark):
    from feria.operators import matching

    words = [(i, ["aaa", f"w{i % 7}x", "bb"][: 1 + i % 3]) for i in range(60)] + [(3, ["ccc"]), (61, ["ccc"]), (62, None)]
    df = spark.createDataFrame(words, "id long, tokens array<string>")
    has = {}
    for i, w in words:
        has.setdefault(i, set()).update(x for x in w or [] if len(x) >= 3)
    want = sorted((a, b) for a in has for b in has if has[a] & has[b])
    for block in (4, 1000):
        assert sorted((r.left_id, r.right_id) for r in matching.candidates(df, df, block=block).collect()) == want


def test_pairs_of_one_table(spark):
    """Pairs of one table are made once each, also of rows with equal words in many lists, and only lists of ids are dealt."""
    from feria.operators import matching

    words = [(i, ["aaa", f"w{i % 5}x"] if i % 3 else ["ccc", "bb"]) for i in range(50)]
    df = spark.createDataFrame(words, "id long, tokens array<string>")
    got = sorted((r.left_id, r.right_id) for r in matching.candidates(df, block=4).collect())
    assert got == [(a, b) for a, x in words for b, y in words if a < b and {w for w in x if len(w) > 2} & set(y)]


def test_match_of_descriptions(spark):
    """Descriptions give what their normalized texts give, by code, by text, with own products and among earlier ones."""
    from pyspark.sql import functions as F

    from feria.functions import text
    from feria.operators import matching

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    schema = "id long, t string, declared string, context string, ean string"
    code = "7790000000012"
    products = [(1, "yerba suave 500 g", "uno", "almacen", code), (2, "yerba suave 500 g", "dos", "almacen", None), (3, "yerba suave 1 kg", None, None, None), (4, None, "uno", None, None)]
    listings = [(10 + i, t, d, c, e) for i, (t, d, c, e) in enumerate((t, d, c, e) for t in ("yerba suave 500 g", "yerba suaves", "yerba suave pack x 6", None) for d in ("uno", None) for c in ("almacen", "bazar", None) for e in (code, None))]
    make = lambda rows: spark.createDataFrame(rows, schema)
    normal = lambda d: d.withColumn("n", text.normalized(F.col("t"))).drop("t")
    left, right = make(listings).withColumn("own_id", F.lit(1).cast("long")), make(products)
    got = sorted(matching.match(left, right).collect(), key=lambda r: r.left_id)
    assert got == sorted(matching.match(normal(left), normal(right)).collect(), key=lambda r: r.left_id)
    assert len(got) == len(listings) and all(r.own for r in got) and got[0].own_score == 1.0 and got[0].right_id == 1
    assert {r.by_ean for r in got if r.left_id % 2 == 0} == {True} and got[-1].own_score is None
    early = {r.left_id: r.text_id for r in matching.match(make(listings), make(listings), earlier=True).collect()}
    assert early[11] == 10 and early[10] is None


def test_match_routing(spark):
    """Every listing has one row; codes come first, in doubt where texts or packs differ; brands and variants block."""
    from pyspark.sql import functions as F

    from feria.functions import text
    from feria.operators import matching

    schema = "id long, t string, declared string, context string, ean string"
    products = [(1, "yerba suave 500 g", "uno", "almacen", "7790000000012"), (2, "yerba suave 500 g", "dos", "almacen", None), (3, "galletitas dulces 6 unidades", "tres", None, "7790000000036"), (4, "arroz largo fino 1 kg", None, "almacen", None)]
    listings = [(10, "yerba suave 500 g", "uno", "almacen", None), (11, "yerba suave 500 g", "dos", None, "7790000000012"), (12, "galletitas dulces", "tres", None, "7790000000036"), (13, "yerba fuerte 500 g", "dos", "almacen", None), (14, "arroz largo fino 1000 g", "cuatro", "almacen", None), (15, "nada", None, None, None), (16, "yerba suave 500 g", "uno", "almacen", None), (17, "arroz largo fino 1 kg", None, "bazar", None)]
    make = lambda rows: spark.createDataFrame(rows, schema).withColumn("n", text.normalized(F.col("t")))
    got = {r.left_id: r for r in matching.match(make(listings), make(products), block=2).collect()}
    assert set(got) == set(range(10, 18))
    assert [(got[i].right_id, got[i].by_ean, got[i].status) for i in (10, 11, 12, 14, 16)] == [(1, False, "auto"), (1, True, "auto"), (3, True, "pending_review"), (4, False, "auto"), (1, False, "auto")]
    assert got[13].status == "new" and got[15].right_id is None and got[17].score < got[14].score


def test_match_routing_of_all_listings(spark):
    every = QUERIES["E4_E7_match_routing"](spark, SF).toPandas()
    con = duckdb.connect()
    assert len(every) == con.sql(f"select count(distinct l_partkey * 100000 + l_suppkey) from '{SF}/lineitem.parquet'").fetchall()[0][0]
    assert every.left_id.is_unique and every.by_ean.any() and not every.by_ean.all()


def test_alike_names_loses_none(spark):
    """All pairs of names at or above a likeness, beside all pairs; names of one letter, none and null have none."""
    import random
    from collections import Counter

    from feria.operators import matching

    rng = random.Random(2)
    names = ["".join(rng.choice("aab c") for _ in range(rng.randint(1, 12))) for _ in range(120)] + ["a", "", "aaaaaaaa", "aaaaaaa"]
    left, right = sorted(set(names[:70] + ["aaaaaaaa", "a"])), sorted(set(names[50:]))
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    frame = lambda x: spark.createDataFrame([(n,) for n in [*x, None]], "name string")

    def dice(a, b):
        x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
        return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) if x and y else 0.0

    for least in (0.42, 0.8):
        got = {(r.left_name, r.right_name): r.alike for r in matching.alike_names(frame(left), frame(right), least, block=5).collect()}
        assert got == {(a, b): dice(a, b) for a in left for b in right if dice(a, b) >= least}


def test_score_blocks_and_caps(spark):
    """Other types, brands and variants leave little of a score; size alone may raise it above 1, type and brand may not."""
    from pyspark.sql import functions as F

    from feria.functions import text
    from feria.operators import matching

    pairs = [("arroz oro 1 kg", "harina oro 1 kg"), ("yerba max", "yerba fresh"), ("yerba max", "yerba"), ("oro negro 1 kg", "oro negro 1000 g"), ("arroz oro 1 kg", "arroz oro 1 kg"), ("oro x 1", "oro 2 kg")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = df.select("i", text.normalized(F.col("a")).alias("a"), text.normalized(F.col("b")).alias("b"))
    got = {r.i: r.s for r in df.select("i", matching.semantic_score(F.col("a"), F.col("b"), same_brand=F.lit(False)).alias("s")).collect()}
    assert (got[0], got[1], got[3], got[4], got[5]) == (0.06, 0.105, 1.05, 1.0, 1.0) and 0.5 < got[2] < 0.9


def test_repair_and_reconcile(spark):
    """Codes in doubt, slugs that exist, new products that stand for later ones; merges, rejections, repairs, removals."""
    from datetime import datetime

    from pyspark.sql import functions as F

    from feria.functions import text
    from feria.operators import repair

    schema = "id long, t string, declared string, context string, ean string"
    make = lambda rows: spark.createDataFrame(rows, schema).withColumn("n", text.normalized(F.col("t"))).drop("t")
    code, other = "7790000000012", "4006381333931"
    products = [(1, "yerba suave 500 g", "uno", None, code), (2, "arroz largo fino 1 kg", None, None, None), (3, "vino tinto", None, None, None)]
    slugs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, slug string")
    orphans = [(10, "yerba suave 500 g", None, None, code), (11, "yerba suave pack x 6", None, None, code), (12, "arroz largo fino 1000 g", None, None, None), (13, "arroz fina 1 kg", None, None, None), (14, "jabon blanco oro", None, None, None), (15, "jabon blanco oros", None, None, None), (16, "jabon blanco oro", None, None, None), (17, "nada", None, None, other)]
    links, created = repair.repaired(make(orphans), make(products).join(slugs, "id"))
    got = {r.sku_id: (r.product_id, r.product_slug and r.product_slug[:-7], r.method, r.status) for r in links.collect()}
    assert got[10] == (1, None, "ean", "auto") and got[11][3] == "pending_review" and got[12] == (2, None, "semantic", "auto")
    assert got[13][0] == 2 and got[13][3] == "pending_review"
    assert got[14] == got[15] == got[16] == (None, "jabon-blanco-oro", "semantic", "auto") and got[17] == (None, "nada", "semantic", "auto")
    assert {(r.slug[:-7], r.ean, r.first_id) for r in created.collect()} >= {("jabon-blanco-oro", None, 14), ("nada", other, 17)} and created.count() == len({g[1] for g in got.values() if g[1]})

    now = datetime(2026, 3, 1)
    dates = spark.createDataFrame([(1, datetime(2026, 1, 1), datetime(2025, 1, 1)), (2, datetime(2026, 2, 1), datetime(2025, 1, 1)), (3, datetime(2026, 1, 1), datetime(2025, 1, 1)), (4, datetime(2026, 1, 1), datetime(2026, 2, 20)), (5, datetime(2026, 1, 1), datetime(2025, 1, 1))], "product_id long, updated_at timestamp, created_at timestamp")
    products = make([(1, "yerba suave 500 g", None, None, code), (2, "yerba suave 500 g", None, None, code), (3, "arroz largo fino 1 kg", None, None, None), (4, "pan", None, None, None), (5, "sal", None, None, None)]).withColumnRenamed("id", "product_id").join(dates, "product_id")
    held = make([(20, "yerba suave 500 g", None, None, None), (21, "arroz largo fino 1 kg", None, None, None), (22, "yerba suave extra 500 g", None, None, None), (23, "arroz largo fino 1 kg", None, None, None)]).withColumnRenamed("id", "sku_id")
    state = spark.createDataFrame([(20, 1, "auto"), (21, 2, "pending_review"), (22, 2, "pending_review"), (23, 3, "pending_review")], "sku_id long, product_id long, status string")
    merges, decisions, removed = repair.reconciled(products, held.join(state, "sku_id"), spark.createDataFrame([], "product_id long"), now)
    assert [tuple(r) for r in merges.collect()] == [(1, 2, True)]
    assert [(r.sku_id, r.old_id, r.decision, r.product_id) for r in decisions.collect()] == [(21, 2, "rejected", None)]
    assert [r.product_id for r in removed.collect()] == [5]


def test_article_edges_connect_as_all_pairs_do(spark):
    """What first and last products connect, and those that share a store with them, beside all pairs."""
    import random

    from feria.operators import jobs, matching

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = random.Random(5)
    for stores in (3, 8):
        own = [(i, rng.randrange(4), sorted(rng.sample(range(stores), rng.randint(0, 2)))) for i in range(40)]
        pairs = [(a, b) for a in range(4) for b in range(4) if rng.random() < 0.3]
        edges = [(a, b) for a, x, p in own for b, y, q in own if a < b and (x, y) in pairs and not set(p) & set(q)]
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        few = jobs._article_edges(frame(own, "product_id long, no long, stores array<long>"), frame(pairs, "left long, right long"))
        groups = lambda df: sorted((r.node, r.component) for r in matching.min_labels(df).collect())
        assert groups(few) == groups(frame(edges, "a long, b long"))


def test_descriptions_are_normalized_once(spark):
    """Rows of one description share its normalized text; rows without one keep nulls."""
    from pyspark.sql import functions as F

    from feria.functions import text
    from feria.operators import matching

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = spark.createDataFrame([(i, ["Arroz Oro 1 kg", "Yerba pack x 6", None][i % 3]) for i in range(30)], "id long, t string")
    assert matching.described(rows.where("t is not null")).count() == 2
    got = {r.id: r.n for r in matching.with_described(rows).collect()}
    want = {r.id: r.n for r in rows.select("id", text.normalized(F.col("t")).alias("n")).where("id % 3 < 2").collect()}
    assert {i: n for i, n in got.items() if i % 3 < 2} == want and all(got[i] is None for i in range(2, 30, 3))
