"""Maintenance of links and products: codes, conflicts, categories, orphans. Tables in, tables of decisions out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feria.functions import text
from feria.operators import matching
from feria.schemas import RULES, Rules
from feria.sources.model import kept, rank


def by_code(listings: DataFrame, products: DataFrame) -> DataFrame:
    """left_id and right_id: the first product (least id) with exactly the listing's code. Both have id and ean."""
    first = products.where("ean is not null").groupBy("ean").agg(F.min("id").alias("right_id"))
    return listings.select(F.col("id").alias("left_id"), "ean").join(first, "ean").select("left_id", "right_id")


def bulk_status(score: Column, by_ean: Column, conflict: Column, rules: Rules = RULES) -> Column:
    """Status in a bulk import: as `matching.routed`, but what is below the automatic threshold is new, not reviewed."""
    return F.when(by_ean, F.when((score < rules.ean_conflict) | conflict, "pending_review").otherwise("auto")).when(score >= rules.auto_match, "auto").otherwise("new")


def merged_by_code(products: DataFrame, links: DataFrame) -> DataFrame:
    """product_id and keep_id of products that share a valid code: most links, then the newest, then the least id stays.

    `products` has product_id, ean and updated_at, `links` product_id and store_id, a row a link. A group in which two
    products are sold by one store is left alone: its code is doubtful.
    """
    own = products.where(text.ean_valid(text.ean(F.col("ean")))).select("product_id", text.ean(F.col("ean")).alias("ean"), "updated_at")
    n = links.groupBy("product_id").agg(F.count(F.lit(1)).alias("links"))
    stores = own.join(links.select("product_id", "store_id").distinct(), "product_id").groupBy("ean").agg((F.count(F.lit(1)) - F.count_distinct("store_id")).alias("clash"))
    groups = own.groupBy("ean").agg(F.count(F.lit(1)).alias("members")).where("members > 1").join(stores, "ean", "left").where("coalesce(clash, 0) = 0").select("ean")
    rows = own.join(groups, "ean").join(n, "product_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    order = F.struct("links", F.col("updated_at"), (-F.col("product_id")).alias("k"))
    keep = rows.groupBy("ean").agg((-F.max(order)["k"]).alias("keep_id"))
    return rows.join(keep, "ean").select("product_id", "keep_id")


def moved_deals(deals: DataFrame, merged: DataFrame, zone: str = "America/Argentina/Buenos_Aires") -> DataFrame:
    """Deals (deal_id, product_id, detected_at) after products were merged: one a product and local day stays, the keeper's
    own before moved ones, then the least deal_id."""
    got = deals.join(merged, "product_id", "left").withColumn("moved", F.coalesce(F.col("keep_id") != F.col("product_id"), F.lit(False)))
    got = got.withColumn("product_id", F.coalesce("keep_id", "product_id")).withColumn("day", F.to_date(F.from_utc_timestamp("detected_at", zone)))
    best = F.min(F.struct("moved", "deal_id", "detected_at"))
    return got.groupBy("product_id", "day").agg(best.alias("b")).select("product_id", "day", F.col("b.deal_id").alias("deal_id"), F.col("b.moved").alias("moved"))


def variant_conflict(a: Column, b: Column) -> Column:
    """Both declare exclusive variants and share none."""
    x, y = text.exclusive(a["variants"]), text.exclusive(b["variants"])
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def conflicts(links: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Valid links (sku_id, product_id, status, sku_n, product_n: `text.normalized`) whose sides cannot be one article."""
    rows = links.where(F.col("status").isin(*rules.valid_status))
    return rows.where(variant_conflict(F.col("sku_n"), F.col("product_n")) | matching.presentation_conflict(F.col("sku_n.pack"), F.col("product_n.pack")))


def rematched(conflicting: DataFrame, matches: DataFrame) -> DataFrame:
    """What becomes of conflicting links: sku_id, product_id and status. `matches` is of `matching.match`. Another product with
    the listing's code, or a clear match by text, takes the link over; else, and where the best product is the one that it
    conflicts with, it waits for review."""
    rows = conflicting.join(matches.select(F.col("left_id").alias("sku_id"), "right_id", (F.col("by_ean") | (F.col("status") == "auto")).alias("found")), "sku_id", "left")
    clear = F.coalesce(F.col("found") & (F.col("right_id") != F.col("product_id")), F.lit(False))
    return rows.select("sku_id", F.when(clear, F.col("right_id")).otherwise(F.col("product_id")).alias("product_id"), F.when(clear, "auto").otherwise("pending_review").alias("status"))


def consolidated(products: DataFrame, links: DataFrame, least_name: float = 0.86, least_score: float = 0.8, sure_name: float = 0.93) -> DataFrame:
    """product_id and keep_id of every product of a group of equal articles; the one that stays has most links, then the
    longest name, then the least id.

    `products` has product_id, n (`text.normalized`) or t (a description), declared (brand or null), context (or null),
    unit_amount and unit_type (or null); `links` product_id, store_id and status. Two products are one article if they have
    the same size of their own and the same brand (or none), no store sells both, their names are alike, the later one scores
    well as the earlier one's match, and sizes in both names are equal (in one name only: the names are nearly the same).
    Groups are what such pairs connect.

    Texts are compared once for each two of them. Of two texts that match, all products meet the first product of the one
    and the last of the other; these connect nearly all, and only products that share a store with one of the two meet all
    products of the other text. If the two share one themselves, all products meet.
    """
    live = links.where("status != 'rejected'").select("product_id", "store_id")
    sold = live.groupBy("product_id").agg(F.sort_array(F.collect_set("store_id")).alias("stores"))
    size = F.when(F.col("unit_amount") != 0, F.concat_ws(":", "unit_type", F.round(F.col("unit_amount") * 1000).cast("long").cast("string")))
    size = F.when(F.col("unit_type").isNotNull(), size)
    said = "t" if "t" in products.columns else "n"
    rows = products.select("product_id", said, "declared", "context", size.alias("size")).withColumn("key", F.to_json(F.struct(said, "declared", "context", "size")))
    texts = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in (said, "declared", "context", "size")], F.min("product_id").alias("lo"), F.max("product_id").alias("hi")).checkpoint()
    texts = (matching.with_described(texts) if said == "t" else texts).withColumn("bucket", F.to_json(F.struct("size", F.coalesce("declared", "n.brand").alias("brand"))))
    texts = texts.select("*", F.monotonically_increasing_id().alias("no")).checkpoint()
    pairs = _alike_texts(texts, least_name, least_score, sure_name).checkpoint()
    own = rows.join(texts.select("key", "no", F.col("n.name").alias("name")), "key").join(sold, "product_id", "left")
    own = kept(own.select("product_id", "no", "name", F.coalesce("stores", F.array().cast(sold.schema["stores"].dataType)).alias("stores")))
    nodes = matching.min_labels(_article_edges(own, pairs))
    members = own.select("product_id", "name").join(nodes.select(F.col("node").alias("product_id"), F.col("component").alias("group")), "product_id").checkpoint()
    return members.join(matching.keepers(members, live), "group").select("product_id", "keep_id")


def _alike_texts(texts: DataFrame, least_name: float, least_score: float, sure_name: float) -> DataFrame:
    """left and right: numbers of texts whose products may be one article, an earlier one of left and a later one of right."""
    names = texts.select(F.col("n.name").alias("name")).distinct().checkpoint()
    names = matching.alike_names(names, names, least_name)
    a, b = (texts.select(F.col("n.name").alias(f"{s}_name"), "bucket", matching.traits(F.col("n")).alias(f"{s}_traits"), *[F.col(c).alias(f"{s}_{c}") for c in ("no", "lo", "hi", "declared", "context", "size")], F.col("n.unit").alias(f"{s}_unit")) for s in ("left", "right"))
    pairs = a.join(names, "left_name").join(b, ["right_name", "bucket"]).where("left_lo < right_hi")
    unit_a, unit_b = F.col("left_unit"), F.col("right_unit")
    has_a, has_b = (u["unit"].isNotNull() | u["amount"].isNotNull() for u in (unit_a, unit_b))
    equal = F.coalesce((unit_a["unit"] == unit_b["unit"]) & (F.col("left_size") == F.col("right_size")) & (unit_a["amount"] == unit_b["amount"]) & (unit_a["amount"] != 0), F.lit(False))
    pairs = pairs.where(F.when(has_a & has_b, equal).when(has_a | has_b, F.col("alike") >= sure_name).otherwise(True))
    near = F.when(F.col("left_context").isNotNull() & F.col("right_context").isNotNull(), text.dice(F.col("left_context"), F.col("right_context")))
    x, y = F.col("left_traits"), F.col("right_traits")
    known = lambda c: F.coalesce(c, F.lit(False))
    other_type, other_line, same_type = matching.pair_blocks(x, y)
    score = matching.scored(
        matching.blended(F.col("alike"), near), matching.pair_size(x, y), other_type, other_line, same_type,
        known(F.col("left_declared") != F.col("right_declared")), known(F.col("left_declared") == F.coalesce("right_declared", "right_traits.brand")),
    )
    return pairs.where(score >= least_score).select(F.col("left_no").alias("left"), F.col("right_no").alias("right"))


def _article_edges(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """a and b: products (own: product_id, no, stores) that connect what all pairs of an earlier product of text left and a
    later one of text right without a common store would."""
    ends = own.groupBy("no").agg(F.min(F.struct("product_id", "stores")).alias("first"), F.max(F.struct("product_id", "stores")).alias("last")).checkpoint()
    met = pairs.join(ends.select(F.col("no").alias("left"), "first"), "left").join(ends.select(F.col("no").alias("right"), "last"), "right")
    met = met.withColumn("joined", F.expr("first.product_id < last.product_id and not arrays_overlap(first.stores, last.stores)")).checkpoint()
    apart = ~F.arrays_overlap("x_stores", "y_stores")
    side = lambda s: own.select(F.col("no").alias("left" if s == "x" else "right"), F.col("product_id").alias(f"{s}_id"), F.col("stores").alias(f"{s}_stores"))
    good = met.where("joined")
    later = good.join(side("y"), "right").select("left", F.col("first.product_id").alias("x_id"), F.col("first.stores").alias("x_stores"), "y_id", "y_stores").where("x_id < y_id")
    early = good.join(side("x"), "left").select("right", F.col("last.product_id").alias("y_id"), F.col("last.stores").alias("y_stores"), "x_id", "x_stores").where("x_id < y_id")
    stars = later.where(apart).select(F.col("x_id").alias("hub"), F.col("y_id").alias("v")).union(early.where(apart).select(F.col("y_id").alias("hub"), F.col("x_id").alias("v")))
    stars = stars.groupBy("v").agg(F.collect_set("hub").alias("hubs")).select("v", "hubs", F.array_min("hubs").alias("hub")).checkpoint()
    edges = stars.select(F.col("v").alias("a"), F.col("hub").alias("b")).union(stars.select("hub", F.explode("hubs").alias("b")).where("hub != b").distinct())
    rest = [
        later.where(~apart).select("left", "y_id", "y_stores").distinct().join(side("x"), "left"),
        early.where(~apart).select("right", "x_id", "x_stores").distinct().join(side("y"), "right"),
        met.where("not joined").select("left", "right").join(side("x"), "left").join(side("y"), "right"),
    ]
    for r in rest:
        edges = edges.union(r.where("x_id < y_id").where(apart).select("x_id", "y_id"))
    return edges.distinct()


def other_sizes(products: DataFrame, links: DataFrame, least: float = 0.95) -> DataFrame:
    """Links whose size is not their product's: sku_id, product_id and reason (scale or size).

    `products` has product_id, ean, unit_amount and unit_type; `links` sku_id, product_id, ean and unit (a struct of amount
    and unit), valid ones. The reference is the product's own size, else its listings' most frequent one (of equally
    frequent ones the largest). Products with one link, and links that declare their product's code, are left alone.
    """
    amount, kind = matching.base_amount(F.col("unit")), matching.base_kind(F.col("unit"))
    rows = links.select("sku_id", "product_id", F.col("ean").alias("sku_ean"), amount.alias("base"), kind.alias("kind"))
    own = F.struct(F.col("unit_amount").cast("double").alias("amount"), F.col("unit_type").alias("unit"))
    ref = products.select("product_id", F.col("ean").alias("product_ean"), matching.base_amount(own).alias("own_base"), matching.base_kind(own).alias("own_kind"))
    n = rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("base").alias("sizes")).where("links > 1")
    mode = rows.where("base is not null").groupBy("product_id", "base").agg(F.count(F.lit(1)).alias("c")).groupBy("product_id").agg(F.max(F.struct("c", "base")).alias("m")).select("product_id", F.col("m.base").alias("mode"))
    rows = rows.join(n, "product_id").join(ref, "product_id").join(mode, "product_id", "left")
    rows = rows.where("base is not null and not coalesce(sku_ean = product_ean, false)").where("own_base is not null or sizes > 1")
    against = F.coalesce("own_base", "mode")
    scale = F.coalesce(F.col("kind") != F.col("own_kind"), F.lit(False))
    ratio = F.least(F.col("base"), against) / F.greatest(F.col("base"), against)
    return rows.withColumn("reason", F.when(scale, "scale").when(ratio < least, "size")).where("reason is not null").select("sku_id", "product_id", "reason")


def longest_text(products: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds signal to products (product_id, name): the longest text of their listings (texts: product_id, text; of equally
    long ones the least), else the name."""
    best = texts.groupBy("product_id").agg(F.min(F.struct((-F.length("text")).alias("n"), "text")).alias("b")).select("product_id", F.col("b.text").alias("best"))
    return products.join(best, "product_id", "left").withColumn("signal", F.coalesce("best", "name")).drop("best")


def retagged(products: DataFrame, categories: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """product_id, old_path and new_path of products (product_id, signal, category_id) whose category changes: the first
    rule's path, if it is a category; the default does not replace a category that a product has."""
    paths = categories.select("category_id", F.col("path").alias("old_path"))
    known = categories.select(F.col("path").alias("new_path"))
    got = products.join(paths, "category_id", "left").withColumn("new_path", text.category_of(F.col("signal"), rules, default))
    keeps = F.col("old_path").isNotNull() & (F.col("new_path") == default)
    return got.where(~keeps & ~F.col("old_path").eqNullSafe(F.col("new_path"))).join(known, "new_path", "left_semi").select("product_id", "old_path", "new_path")


def resolved_category(store_path: Column, name_path: Column, raw_path: Column, known: Column) -> Column:
    """The deeper of the paths by the store's categories and by name (by name if equally deep), if it is in the array
    `known`; else the store's raw path, then its root, if they are."""
    depth = lambda p: F.size(F.split(p, "/"))
    deeper = F.when(name_path.isNull() | (depth(store_path) > depth(name_path)), store_path).otherwise(name_path)
    inside = lambda p: F.when(F.array_contains(known, p), p)
    return F.coalesce(inside(deeper), inside(raw_path), inside(F.substring_index(raw_path, "/", 1)))


def modal_packs(texts: DataFrame) -> DataFrame:
    """product_id, count and is_pack: the pack information that most listings of a product have; packs come before single
    articles, then by frequency, then by first place (texts: product_id, place, text)."""
    got = texts.withColumn("p", text.pack(F.col("text"))).where("p.declared").groupBy("product_id", "p.is_pack", "p.count").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    order = F.struct(F.col("is_pack").cast("int").alias("pack"), "n", (-F.col("first")).alias("place"), "count", "is_pack")
    return got.groupBy("product_id").agg(F.max(order).alias("m")).select("product_id", F.col("m.count").alias("count"), F.col("m.is_pack").alias("is_pack"))


def orphans(skus: DataFrame, links: DataFrame, prices: DataFrame) -> DataFrame:
    """Active listings without a link, with price_count, first_price_at and last_price_at; those without prices do not count.
    skus: sku_id, is_active and more."""
    n = prices.groupBy("sku_id").agg(F.count(F.lit(1)).alias("price_count"), F.min("captured_at").alias("first_price_at"), F.max("captured_at").alias("last_price_at"))
    return skus.where("is_active").join(links.select("sku_id"), "sku_id", "left_anti").join(n, "sku_id")


def orphans_by_code(rows: DataFrame, products: DataFrame) -> DataFrame:
    """sku_id and product_id of orphans (with ean) whose code of 13 digits a product has."""
    return rows.where(F.col("ean").rlike("^[0-9]{13}$")).select("sku_id", "ean").join(products.select("product_id", "ean"), "ean").select("sku_id", "product_id")


def orphans_by_word(rows: DataFrame, products: DataFrame) -> DataFrame:
    """sku_id and product_id of orphans (with ean and text) whose first word is a word of the product's name, where no
    product has their code; an equal join by word in place of a pattern join."""
    codes = products.where("ean is not null").select("ean").distinct()
    left = rows.join(codes, "ean", "left_anti").select("sku_id", text.plain(F.substring_index("text", " ", 1)).alias("word")).where("word != ''")
    return left.join(products.select("product_id", F.explode(F.array_distinct(F.split(text.plain(F.col("name")), " "))).alias("word")), "word").select("sku_id", "product_id")


def products_containing(rows: DataFrame, products: DataFrame) -> DataFrame:
    """sku_id, products and least_id of orphans (sku_id, text): how many products' names contain their first word, without
    accents and case, anywhere, and the least of them. Names are cut into all their parts of the words' lengths, which then
    meet the words by an equal join; parts are counted by product before they are joined, so a hot word is one row."""
    left = rows.select("sku_id", text.plain(F.substring_index("text", " ", 1)).alias("word")).where("word != ''")
    sizes = left.select(F.length("word").alias("n")).distinct()  # a few lengths
    names = products.select("product_id", text.plain(F.col("name")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_products"), F.min("product_id").alias("least_id"))
    parts = names.join(sizes, F.col("n") <= F.length("name")).withColumn("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - F.col("n") + 1), lambda i: F.substring("name", i, F.col("n"))))))
    by_word = parts.groupBy("word").agg(F.sum("n_products").alias("products"), F.min("least_id").alias("least_id"))
    return left.join(by_word, "word").select("sku_id", "products", "least_id")


def orphan_links(by_code_rows: DataFrame, by_word_rows: DataFrame) -> DataFrame:
    """Links for orphans: sku_id, product_id, method, score and status. By code at once (least product), by word for review
    (least product), and only where there is no code."""
    code = by_code_rows.groupBy("sku_id").agg(F.min("product_id").alias("product_id")).select("*", F.lit("ean").alias("method"), F.lit(1.0).alias("score"), F.lit("auto").alias("status"))
    word = by_word_rows.join(code, "sku_id", "left_anti").groupBy("sku_id").agg(F.min("product_id").alias("product_id"))
    return code.unionByName(word.select("*", F.lit("semantic").alias("method"), F.lit(0.85).alias("score"), F.lit("pending_review").alias("status")))


def diagnosis(skus: DataFrame, links: DataFrame, prices: DataFrame, products: DataFrame, top: int = 20) -> DataFrame:
    """Nine diagnoses of active listings as diagnosis, label, figure and value: 1 listings with and without a link and their
    prices, 2 and 3 those without whose code a product has, padded to 13 digits or as it is, 4 and 5 the `top` of those with
    and without a code of 13 digits or any code by their prices (then least id), 6 lengths of codes, 7 different codes, 8 the
    `top` codes by prices (then least), 9 listings and products with a link.

    skus: sku_id, is_active, ean; links: sku_id, product_id, one for a listing; prices: sku_id; products: ean. Listings,
    their links, prices and codes meet once, and this table is checkpointed; all counts come from one aggregation of it by
    grouping sets, and only codes, which that aggregation has reduced, are looked at again.
    """
    n = prices.groupBy("sku_id").agg(F.count(F.lit(1)).alias("prices"))
    codes = products.where("ean is not null").groupBy("ean").agg(F.count(F.lit(1)).alias("sold"))
    padded = codes.select(F.col("ean").alias("own"), F.col("sold").alias("padded"))
    rows = skus.where("is_active").select("sku_id", "ean", F.substring(F.lpad("ean", 13, "0"), 1, 13).alias("own")).join(links.select("sku_id", "product_id"), "sku_id", "left").join(n, "sku_id", "left")
    rows = rows.join(codes, "ean", "left").join(padded, "own", "left").withColumn("prices", F.coalesce("prices", F.lit(0)))
    rows = rows.select("sku_id", "product_id", "ean", "prices", F.col("product_id").isNull().alias("lost"), F.coalesce("sold", F.lit(0)).alias("sold"), F.coalesce("padded", F.lit(0)).alias("padded")).checkpoint()
    lost, coded = F.col("lost"), F.col("ean").isNotNull()
    count, total = lambda c: F.count_if(c), lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    figures = {
        (1, "listings"): F.count(F.lit(1)), (1, "linked"): count(~lost), (1, "orphans"): count(lost), (1, "with_code"): count(lost & coded), (1, "without_code"): count(lost & ~coded),
        (1, "with_13_digits"): count(lost & F.col("ean").rlike("^[0-9]{13}$")), (1, "prices"): total(lost, F.col("prices")), (2, "listings"): count(lost & (F.col("padded") > 0)), (2, "prices"): total(lost, F.col("prices") * F.col("padded")),
        (3, "listings"): count(lost & (F.col("sold") > 0)), (3, "prices"): total(lost, F.col("prices") * F.col("sold")), (9, "listings"): count(~lost), (9, "products"): F.count_distinct(F.when(~lost, F.col("product_id"))),
    }
    size = F.length("ean").alias("size")
    sets = rows.withColumn("size", size).groupingSets([[], ["size"], ["ean"]], "size", "ean").agg(F.grouping_id().alias("g"), count(lost & coded).alias("lost_codes"), total(lost & coded, F.col("prices")).alias("lost_prices"), F.array(*[F.struct(F.lit(d).alias("diagnosis"), F.lit(f).alias("figure"), v.cast("long").alias("value")) for (d, f), v in figures.items()]).alias("all")).checkpoint()
    shown = lambda df, d, label, figure, value: df.select(F.lit(d).alias("diagnosis"), label.cast("string").alias("label"), F.lit(figure).alias("figure"), value.cast("long").alias("value"))
    got = sets.where("g = 3").select(F.explode("all").alias("x")).select("x.diagnosis", F.lit(None).cast("string").alias("label"), "x.figure", "x.value")
    codes = sets.where("g = 2 and ean is not null and lost_codes > 0")
    best = codes.orderBy(F.col("lost_prices").desc(), "ean").limit(top)
    parts = [shown(sets.where("g = 1 and size is not null and lost_codes > 0"), 6, F.col("size"), "listings", F.col("lost_codes")), shown(codes.agg(F.count(F.lit(1)).alias("n")), 7, F.lit(None), "codes", F.col("n")), shown(best, 8, F.col("ean"), "listings", F.col("lost_codes")), shown(best, 8, F.col("ean"), "prices", F.col("lost_prices"))]
    for d, wanted in ((4, lost & F.col("ean").rlike("^[0-9]{13}$")), (5, lost & ~coded)):
        parts.append(shown(rows.where(wanted).orderBy(F.col("prices").desc(), "sku_id").limit(top), d, F.col("sku_id"), "prices", F.col("prices")))
    for p in parts:
        got = got.unionByName(p)
    return got


def first_by_word(rows: DataFrame, products: DataFrame) -> DataFrame:
    """As `orphans_by_word`, but only the least product and the number of products of each orphan: products are reduced to
    a row a word before orphans meet them."""
    codes = products.where("ean is not null").select("ean").distinct()
    left = rows.join(codes, "ean", "left_anti").select("sku_id", text.plain(F.substring_index("text", " ", 1)).alias("word")).where("word != ''")
    words = products.select("product_id", F.explode(F.array_distinct(F.split(text.plain(F.col("name")), " "))).alias("word")).groupBy("word").agg(F.min("product_id").alias("product_id"), F.count(F.lit(1)).alias("products"))
    return left.join(words, "word").select("sku_id", "product_id", "products")


def repeated_listings(skus: DataFrame) -> DataFrame:
    """Active listings (sku_id, store_id, external_id, last_seen_at) behind the newest of their store and external id: those
    to switch off; of equally new ones the least id stays."""
    order = [F.col("last_seen_at").desc_nulls_last(), F.col("sku_id")]
    return skus.where("is_active").withColumn("rn", rank(["store_id", "external_id"], order)).where("rn > 1").select("sku_id", "store_id", "external_id", "rn")


def decided(links: DataFrame, decisions: DataFrame, at: Column) -> DataFrame:
    """Links after decisions (sku_id, decision, by): only what waits for review changes, to confirmed or rejected."""
    got = links.join(decisions, "sku_id", "left")
    hit = (F.col("status") == "pending_review") & F.col("decision").isin("confirmed", "rejected")
    changed = F.coalesce(hit, F.lit(False))
    return got.withColumns({"status": F.when(changed, F.col("decision")).otherwise(F.col("status")), "decided_by": F.when(changed, F.col("by")), "decided_at": F.when(changed, at)}).drop("decision", "by")


def may_retry(asked: DataFrame, stores: DataFrame, runs: DataFrame, now: Column, hours: int = 4) -> DataFrame:
    """store_id and answer of each asked store: 404 if unknown, 400 if inactive, 409 if a run of the last hours is not
    finished, else 202. runs: store_id, started_at, finished_at."""
    busy = runs.where(F.col("finished_at").isNull() & (F.col("started_at") > now - F.make_dt_interval(hours=F.lit(hours)))).select("store_id").distinct().withColumn("busy", F.lit(True))
    got = asked.select("store_id").join(stores.select("store_id", "is_active"), "store_id", "left").join(busy, "store_id", "left")
    return got.select("store_id", F.when(F.col("is_active").isNull(), 404).when(~F.col("is_active"), 400).when(F.col("busy"), 409).otherwise(202).alias("answer"))


def refined_images(products: DataFrame, seen: DataFrame) -> DataFrame:
    """Products (product_id, image_url, image_hash) with the url and hash last seen, where they had no url, the same one, or
    no hash."""
    got = products.join(seen.select("product_id", F.col("image_url").alias("u"), F.col("image_hash").alias("h")), "product_id", "left")
    take = F.col("u").isNotNull() & (F.col("image_url").isNull() | (F.col("image_url") == F.col("u")) | F.col("image_hash").isNull())
    return got.select("product_id", F.when(take, F.col("u")).otherwise(F.col("image_url")).alias("image_url"), F.when(take, F.col("h")).otherwise(F.col("image_hash")).alias("image_hash"))


def image_factor(a: Column, b: Column, near: int = 5, far: int = 32) -> Column:
    """What two image hashes do to a score: alike ones raise it, unlike ones lower it, null says nothing."""
    d = text.hamming(a, b)
    return F.when(d <= near, 1.05).when(d >= far, 0.5).otherwise(1.0)


def may_read(stores: DataFrame, deals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an anonymous reader sees of stores and deals: active and published ones."""
    return stores.where("is_active"), deals.where("status = 'published'")
