"""Jobs that chain matching with changes: orphans repaired with new products, and the reconciliation of links."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feria.functions import text
from feria.operators import matching
from feria.schemas import RULES, Rules


def repaired(orphans: DataFrame, products: DataFrame, rules: Rules = RULES) -> tuple[DataFrame, DataFrame]:
    """A link for each orphan (sku_id, product_id or product_slug, method, score, status), and the products to create (slug,
    name, brand, ean, first_id). Both tables have id, n or t, declared, context and ean as for `matching.match`, products
    also slug.

    A product with the orphan's code is linked at once, unless names or packs leave it in doubt; then, and without one, the
    best product by text is: at once above the automatic threshold (but for review if a code was in doubt), for review
    above the review threshold. What is left is new: it goes to the product that has its slug, else to one that is created
    for all orphans with that slug. New products are candidates for those after them, in the order of their first orphan's
    id: one that matches an earlier one automatically is not created, and its orphans go to the best earlier one among
    those that match none themselves; if none of these matches, it is created after all.
    """
    m = matching.match(orphans, products, rules).select(F.col("left_id").alias("id"), "right_id", "by_ean", "status", "text_id", "text_score")
    said = "t" if "t" in orphans.columns else "n"
    known = lambda d: matching.with_described(d) if said == "t" else d
    rows = known(orphans).join(m, "id")
    coded, doubt = F.expr("by_ean and status = 'auto'"), F.expr("by_ean and status != 'auto'")
    found = F.when(coded, F.col("right_id")).otherwise(F.col("text_id"))
    clear = coded | (~doubt & (F.col("text_score") >= rules.auto_match))
    code = F.when(text.ean_valid(F.coalesce("ean", F.lit(""))), F.col("ean"))
    rows = rows.select("id", said, "declared", "context", code.alias("ean"), found.alias("product_id"), F.when(coded, "ean").otherwise("semantic").alias("method"), F.when(coded, 1.0).otherwise(F.col("text_score")).alias("score"), F.when(F.when(found.isNull(), ~doubt).otherwise(clear), "auto").otherwise("pending_review").alias("status"), text.forge_slug(F.col("n.name"), code).alias("slug")).checkpoint()
    slugs = products.groupBy("slug").agg(F.min("id").alias("slug_id"))
    rest = rows.where("product_id is null").join(slugs, "slug", "left").checkpoint()
    fresh = rest.where("slug_id is null").groupBy("slug").agg(F.min_by(F.struct("id", said, "declared", "context", "ean"), "id").alias("r")).select("slug", "r.*").checkpoint()
    plain = fresh.drop("slug")
    near = matching.match(plain, plain, rules, earlier=True, codes=False).where(F.col("text_score") >= rules.auto_match).select(F.col("left_id").alias("id"))
    later = fresh.join(near, "id", "left_semi").checkpoint()
    heads = fresh.join(later.select("id"), "id", "left_anti").checkpoint()
    to = matching.match(later.drop("slug"), heads.drop("slug"), rules, earlier=True, codes=False).where(F.col("text_score") >= rules.auto_match)
    to = to.select(F.col("left_id").alias("id"), F.col("text_id").alias("head"), "text_score").join(heads.select(F.col("id").alias("head"), F.col("slug").alias("head_slug")), "head")
    moved = later.select("id", "slug").join(to, "id").select("slug", "head_slug", "text_score").checkpoint()
    links = rows.where("product_id is not null").select(F.col("id").alias("sku_id"), "product_id", F.lit(None).cast("string").alias("product_slug"), "method", "score", "status")
    new = rest.join(moved, "slug", "left").select(F.col("id").alias("sku_id"), F.col("slug_id").alias("product_id"), F.when(F.col("slug_id").isNull(), F.coalesce("head_slug", "slug")).alias("product_slug"), "method", F.coalesce("text_score", F.lit(rules.auto_match)).alias("score"), "status")
    created = known(fresh.join(moved.select("slug"), "slug", "left_anti"))
    return links.unionByName(new), created.select("slug", F.col("n.name").alias("name"), F.coalesce("declared", "n.brand").alias("brand"), "ean", F.col("id").alias("first_id"))


def same_code(products: DataFrame, links: DataFrame, deals: DataFrame) -> DataFrame:
    """product_id, keep_id and deleted of products that share a code with another one that stays: most links, then the
    latest update, then the least id. One with deals is not deleted, though its links move."""
    n = links.groupBy("product_id").agg(F.count(F.lit(1)).alias("links"))
    rows = products.where("ean is not null").select("product_id", "ean", "updated_at").join(n, "product_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    best = F.max(F.struct("links", "updated_at", (-F.col("product_id")).alias("k")))["k"]
    keep = rows.groupBy("ean").agg((-best).alias("keep_id"))
    gone = rows.join(keep, "ean").where("product_id != keep_id").select("product_id", "keep_id")
    has = deals.select("product_id").distinct().withColumn("has", F.lit(True))
    return gone.join(has, "product_id", "left").select("product_id", "keep_id", F.col("has").isNull().alias("deleted"))


def reconciled(products: DataFrame, links: DataFrame, deals: DataFrame, now: datetime, rules: Rules = RULES, days: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What becomes of products and links, in three tables of decisions: merges by code (`same_code`), links that are
    rejected or repaired (sku_id, old_id, decision, product_id, method, score), and products to remove (product_id).

    `products` has product_id, n or t, declared, context, ean, updated_at and created_at; `links` sku_id, product_id, status
    and the listing's n or t, declared, context and ean; `deals` product_id. Links move with merges. A link that waits for review is
    scored with its own product and matched with all that are left: below `reject_below` it is rejected; if another product
    has its code, or is the best match above the automatic threshold, it is repaired; else it waits on. Products without a
    link or a deal that are older than `days` are removed.
    """
    merges = same_code(products, links, deals).checkpoint()
    left = products.join(merges.where("deleted").select("product_id"), "product_id", "left_anti").checkpoint()
    moved = links.join(merges.select("product_id", "keep_id"), "product_id", "left").withColumn("product_id", F.coalesce("keep_id", "product_id")).drop("keep_id")
    said = "t" if "t" in links.columns else "n"
    waiting = moved.where("status = 'pending_review'").select(F.col("sku_id").alias("id"), F.col("product_id").alias("own_id"), said, "declared", "context", "ean").checkpoint()
    best = matching.match(waiting, left.select(F.col("product_id").alias("id"), said, "declared", "context", "ean"), rules)
    rows = waiting.select(F.col("id").alias("sku_id"), F.col("own_id").alias("product_id")).join(best.where("own").select(F.col("left_id").alias("sku_id"), "right_id", "by_ean", "score", "own_score"), "sku_id")
    rejected = F.col("own_score") < rules.reject_below
    better = (F.col("right_id") != F.col("product_id")) & (F.col("by_ean") | (F.col("score") >= rules.auto_match))
    decision = F.when(rejected, "rejected").when(better, "repaired")
    pick = lambda c: F.when(decision == "repaired", c)
    decisions = rows.where(decision.isNotNull()).select("sku_id", F.col("product_id").alias("old_id"), decision.alias("decision"), pick(F.col("right_id")).alias("product_id"), pick(F.when(F.col("by_ean"), "ean").otherwise("semantic")).alias("method"), F.when(decision == "rejected", F.col("own_score")).otherwise(F.col("score")).alias("score"))
    old = left.where(F.col("created_at") <= F.lit(now) - F.make_dt_interval(days=F.lit(days)))
    removed = old.join(moved.select("product_id"), "product_id", "left_anti").join(deals.select("product_id"), "product_id", "left_anti").select("product_id")
    return merges, decisions, removed
