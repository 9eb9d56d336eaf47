"""Matching and repair of links, beside SQL that scores all pairs.

Listings carry their product's name altered by rule (a letter less at either end, words exchanged, a line, a pack), other
sizes, brands and contexts, or none, and some its code; so the best product is not known beforehand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feria.functions import text
from feria.operators import jobs, matching, repair
from feria.plans.jobs import _CODES, code
from feria.plans.queries import checkpoints, query
from feria.sources import model
from feria.streaming import runs


def _products(m: model.Model):
    described = F.concat_ws(" ", "name", F.concat(F.col("size").cast("string"), F.lit(" gr")))
    rows = m.product.join(m.category.select("category_id", F.col("path").alias("context")), "category_id", "left")
    return rows.select(F.col("product_id").alias("id"), described.alias("t"), F.col("brand").alias("declared"), "context", code(F.col("product_id")).alias("ean"), "slug", "name")


def _listings(m: model.Model):
    k = F.col("sku_id")
    first, second = F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
    name = F.when(k % 6 == 1, F.substring("name", F.lit(1), F.length("name") - 1)).when(k % 6 == 2, F.concat("name", F.lit(" light"))).when(k % 6 == 3, F.concat(second, F.lit(" "), first)).when(k % 6 == 4, F.concat("name", F.lit(" pack x 6"))).when(k % 6 == 5, F.substring("name", F.lit(2), F.length("name"))).otherwise(F.col("name"))
    size = F.when(k % 7 == 3, F.concat(F.col("size").cast("string"), F.lit(" kg"))).when(k % 7 != 5, F.concat(F.col("size").cast("string"), F.lit(" gr")))
    own = m.product.join(m.category.select("category_id", F.col("path").alias("context")), "category_id", "left").withColumnRenamed("product_id", "product_key")
    rows = m.sku.join(own, "product_key")
    declared = F.when(k % 17 == 0, "Brand#99").when(k % 5 != 0, F.col("brand"))
    return rows.select(k.alias("id"), "store_id", F.concat_ws(" ", name, size).alias("t"), declared.alias("declared"), F.when(k % 3 != 0, F.col("context")).alias("context"), F.when(k % 4 == 0, code(F.col("product_key"))).alias("ean"))


_TEXT = ["name", "declared", "amount", "pack", "light", "context", "valid"]


def _alike(left: str, right: str, p: str) -> str:
    """Table expressions that score all different texts of `left` against all of `right` (both id and _TEXT), as p_score with
    l_ and r_ columns, by counting letters' pairs; light and pack are variants, packs are of six, and a pack without a size counts articles."""
    return f"""
{p}said AS (SELECT name AS t FROM {left} UNION SELECT name FROM {right} UNION SELECT context FROM {left} WHERE context IS NOT NULL UNION SELECT context FROM {right} WHERE context IS NOT NULL),
{p}gram AS (SELECT t, substr(t, i, 2) AS g, count(*) AS c FROM {p}said, range(1, 80) r(i) WHERE i < length(t) GROUP BY ALL),
{p}a AS (SELECT DISTINCT name AS a, true AS named FROM {left} UNION ALL SELECT DISTINCT context, false FROM {left} WHERE context IS NOT NULL),
{p}b AS (SELECT DISTINCT name AS b, true AS named FROM {right} UNION ALL SELECT DISTINCT context, false FROM {right} WHERE context IS NOT NULL),
{p}common AS (SELECT x.t AS a, y.t AS b, sum(least(x.c, y.c)) AS n FROM {p}gram x JOIN {p}gram y USING (g) GROUP BY ALL),
{p}alike AS (SELECT a, b, named, CASE WHEN length(a) < 2 OR length(b) < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(n, 0)::DOUBLE / (length(a) - 1 + length(b) - 1) END AS d FROM {p}a JOIN {p}b USING (named) LEFT JOIN {p}common USING (a, b)),
{p}l AS (SELECT DISTINCT {', '.join(f'{c} AS l_{c}' for c in _TEXT)} FROM {left}), {p}r AS (SELECT DISTINCT {', '.join(f'{c} AS r_{c}' for c in _TEXT)} FROM {right}),
{p}base AS (
  SELECT l.*, r.*, n.d AS alike, CASE WHEN c.d IS NOT NULL THEN n.d * 0.75::DOUBLE + c.d * 0.25::DOUBLE ELSE n.d END AS base, least(l_amount, r_amount) / greatest(l_amount, r_amount) AS ratio
  FROM {p}l l JOIN {p}alike n ON n.named AND n.a = l_name JOIN {p}r r ON r_name = n.b LEFT JOIN {p}alike c ON NOT c.named AND c.a = l_context AND c.b = r_context),
{p}factor AS (SELECT *, base * (CASE WHEN l_pack <> r_pack THEN 0.05::DOUBLE WHEN l_pack AND (l_amount IS NULL OR r_amount IS NULL) THEN 1.0::DOUBLE WHEN l_amount IS NULL AND r_amount IS NULL THEN 1.0::DOUBLE WHEN l_amount IS NULL OR r_amount IS NULL THEN 0.8::DOUBLE WHEN ratio >= 0.9 THEN 1.05::DOUBLE WHEN ratio < 0.5 THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END) AS f FROM {p}base),
{p}score AS (
  SELECT *, floor((CASE WHEN l_declared <> r_declared THEN least(base, 0.2::DOUBLE) * 0.3::DOUBLE WHEN (l_light AND r_pack) OR (l_pack AND r_light) THEN least(base, 0.35::DOUBLE) * 0.3::DOUBLE WHEN l_declared = r_declared THEN least(f * 1.04::DOUBLE, 1.0::DOUBLE) ELSE f END) * 10000 + 0.5) / 10000 AS score FROM {p}factor)"""


def _is(alias: str, side: str) -> str:
    return " AND ".join(f"{alias}.{c} IS NOT DISTINCT FROM {side}_{c}" for c in _TEXT)


def _matched(left: str, right: str, p: str) -> str:
    """p_matched: what `matching.match` gives, from scores of all pairs; both tables also have ean."""
    return f"""{_alike(left, right, p)},
{p}text AS (SELECT l.id, max(struct_pack(score := score, r := -q.id)) AS best FROM {left} l JOIN {p}score s ON {_is('l', 's.l')} JOIN {right} q ON {_is('q', 's.r')} WHERE NOT (l.valid AND q.valid) AND score >= 0.65 GROUP BY l.id),
{p}hit AS (SELECT l.id, max(struct_pack(score := score, r := -q.id, alike := alike, odd := l.pack <> q.pack)) AS best FROM {left} l JOIN {right} q USING (ean) JOIN {p}score s ON {_is('l', 's.l')} AND {_is('q', 's.r')} GROUP BY l.id),
{p}matched AS (
  SELECT l.id AS left_id, CASE WHEN h.best IS NOT NULL THEN -h.best.r ELSE -t.best.r END AS right_id, CASE WHEN h.best IS NOT NULL THEN 1.0 ELSE t.best.score END AS score, h.best IS NOT NULL AS by_ean,
    CASE WHEN h.best IS NOT NULL THEN CASE WHEN h.best.alike < 0.75 OR h.best.odd THEN 'pending_review' ELSE 'auto' END WHEN t.best.score >= 0.82 THEN 'auto' WHEN t.best.score IS NOT NULL THEN 'pending_review' ELSE 'new' END AS status,
    -t.best.r AS text_id, t.best.score AS text_score
  FROM {left} l LEFT JOIN {p}hit h USING (id) LEFT JOIN {p}text t USING (id))"""


#: A slug as `text.forge_slug` makes it, of a name and a code or null.
_SLUG = lambda name, code: f"left(trim(regexp_replace({name}, '[^a-z0-9]+', '-', 'g'), '-'), 60) || '-' || left(translate(to_base64(unhex(sha1(coalesce({code}, {name})))), '+/', '-_'), 6)"
_SIDES = f"""{_CODES},
right_side AS (SELECT p.product_id AS id, p.name AS name, brand AS declared, size::DOUBLE AS amount, false AS pack, false AS light, c.path AS context, valid, ean FROM product p JOIN codes USING (product_id) LEFT JOIN category c USING (category_id)),
left_side AS (
  SELECT k.sku_id AS id, k.store_id, CASE k.sku_id % 6 WHEN 1 THEN left(name, length(name) - 1) WHEN 2 THEN name || ' light' WHEN 3 THEN split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1) WHEN 4 THEN name || ' pack' WHEN 5 THEN substr(name, 2) ELSE name END AS name,
    CASE WHEN k.sku_id % 17 = 0 THEN 'Brand#99' WHEN k.sku_id % 5 <> 0 THEN declared END AS declared, CASE WHEN k.sku_id % 7 = 3 THEN amount * 1000 WHEN k.sku_id % 7 <> 5 THEN amount END AS amount,
    k.sku_id % 6 = 4 AS pack, k.sku_id % 6 = 2 AS light, CASE WHEN k.sku_id % 3 <> 0 THEN context END AS context, CASE WHEN k.sku_id % 4 = 0 THEN ean END AS ean, k.sku_id % 4 = 0 AND valid AS valid
  FROM sku k JOIN right_side r ON r.id = k.product_key)"""


@query("E4_E7_match_altered", f"+ {_SIDES}, {_matched('left_side', 'right_side', 'm_')} SELECT * FROM m_matched")
def _altered(spark, sf_dir):
    """Every listing's best product by code and by text, of all products, and where it is routed."""
    checkpoints(spark)
    m = model.from_star(spark, sf_dir)
    return matching.match(_listings(m), _products(m).drop("slug", "name"))


_REPAIRED = f"""{_SIDES},
orphan AS (SELECT l.* FROM left_side l WHERE l.id NOT IN (SELECT sku_id FROM link)),
named AS (SELECT r.*, CASE WHEN id % 2 = 0 THEN {_SLUG('name', 'CASE WHEN valid THEN ean END')} ELSE 'own-' || id END AS slug FROM right_side r),
{_matched('orphan', 'right_side', 'm_')},
decided AS (
  SELECT o.*, by_ean AND m.status = 'auto' AS coded, by_ean AND m.status <> 'auto' AS doubt, right_id, text_id, text_score, {_SLUG('o.name', 'CASE WHEN o.valid THEN o.ean END')} AS slug
  FROM orphan o JOIN m_matched m ON m.left_id = o.id),
known AS (SELECT slug, min(id) AS slug_id FROM named GROUP BY slug),
rest AS (SELECT * FROM decided LEFT JOIN known USING (slug) WHERE NOT coded AND text_id IS NULL),
fresh_slug AS (SELECT DISTINCT ON (slug) slug, id, name, declared, amount, pack, light, context, valid, CASE WHEN valid THEN ean END AS ean FROM rest WHERE slug_id IS NULL ORDER BY slug, id),
{_alike('fresh_slug', 'fresh_slug', 'f_')},
link_of AS (SELECT l.id, q.id AS to_id, score FROM fresh_slug l JOIN f_score s ON {_is('l', 's.l')} JOIN fresh_slug q ON {_is('q', 's.r')} WHERE NOT (l.valid AND q.valid) AND score >= 0.82 AND q.id < l.id),
moved AS (SELECT DISTINCT ON (l.id) f.slug, h.slug AS head_slug, l.score FROM link_of l JOIN fresh_slug f ON f.id = l.id JOIN fresh_slug h ON h.id = l.to_id WHERE l.to_id NOT IN (SELECT id FROM link_of) ORDER BY l.id, l.score DESC, l.to_id)"""


def _repaired(spark, sf_dir):
    checkpoints(spark)
    m = model.from_star(spark, sf_dir)
    products = _products(m)
    valid = F.when(text.ean_valid(F.col("ean")), F.col("ean"))
    products = products.withColumn("slug", F.when(F.col("id") % 2 == 0, text.forge_slug(F.col("name"), valid)).otherwise(F.concat(F.lit("own-"), F.col("id").cast("string"))))
    orphans = _listings(m).join(m.link.select(F.col("sku_id").alias("id")), "id", "left_anti")
    return repair.repaired(orphans.drop("store_id"), products.drop("name"))


@query("E10_E11_repaired_links", f"""+ {_REPAIRED}
SELECT id AS sku_id, CASE WHEN coded THEN right_id ELSE text_id END AS product_id, NULL AS product_slug, CASE WHEN coded THEN 'ean' ELSE 'semantic' END AS method, CASE WHEN coded THEN 1.0 ELSE text_score END AS score,
  CASE WHEN coded OR (NOT doubt AND text_score >= 0.82) THEN 'auto' ELSE 'pending_review' END AS status FROM decided WHERE coded OR text_id IS NOT NULL
UNION ALL SELECT id, slug_id, CASE WHEN slug_id IS NULL THEN coalesce(head_slug, r.slug) END, 'semantic', coalesce(score, 0.82), CASE WHEN doubt THEN 'pending_review' ELSE 'auto' END FROM rest r LEFT JOIN moved USING (slug)""")
def _repaired_links(spark, sf_dir):
    """A link for each listing without one."""
    return _repaired(spark, sf_dir)[0]


@query("E10_E11_created_products", f"+ {_REPAIRED} SELECT slug, name, ean, id AS first_id FROM fresh_slug WHERE slug NOT IN (SELECT slug FROM moved)")
def _created(spark, sf_dir):
    """Products that are made for listings without a match."""
    return _repaired(spark, sf_dir)[1].drop("brand")


_RECONCILED = f"""{_SIDES},
deal AS (SELECT DISTINCT o_custkey AS product_id FROM orders WHERE o_orderkey % 200 = 0),
held AS (SELECT * FROM link WHERE product_id % 40 >= 10),
dated AS (SELECT r.*, n.links, now - to_days((id % 60)::INTEGER) AS created_at, now - to_days((id % 7)::INTEGER) AS updated_at FROM right_side r CROSS JOIN clock LEFT JOIN (SELECT product_id AS id, count(*) AS links FROM held GROUP BY 1) n USING (id)),
kept AS (SELECT id AS product_id, first_value(id) OVER (PARTITION BY ean ORDER BY coalesce(links, 0) DESC, updated_at DESC, id) AS keep_id FROM dated),
merged AS (SELECT *, product_id NOT IN (SELECT product_id FROM deal) AS deleted FROM kept WHERE product_id <> keep_id),
after AS (SELECT * FROM dated WHERE id NOT IN (SELECT product_id FROM merged WHERE deleted)),
moved AS (SELECT sku_id, coalesce(keep_id, h.product_id) AS product_id, status FROM held h LEFT JOIN merged g ON g.product_id = h.product_id),
waiting AS (SELECT l.*, m.product_id FROM left_side l JOIN moved m ON m.sku_id = l.id WHERE m.status = 'pending_review'),
{_matched('waiting', 'after', 'm_')},
own AS (SELECT w.id, w.product_id, score AS own_score FROM waiting w JOIN after q ON q.id = w.product_id JOIN m_score s ON {_is('w', 's.l')} AND {_is('q', 's.r')})"""


def _reconciled(spark, sf_dir):
    checkpoints(spark)
    m = model.from_star(spark, sf_dir)
    ago = lambda days: F.lit(m.now).cast("timestamp") - F.make_dt_interval(days=days.cast("int"))
    products = _products(m).withColumnRenamed("id", "product_id").withColumns({"created_at": ago(F.col("product_id") % 60), "updated_at": ago(F.col("product_id") % 7)})
    links = m.link.where("product_id % 40 >= 10").join(_listings(m).withColumnRenamed("id", "sku_id"), "sku_id").select("sku_id", "product_id", "status", "t", "declared", "context", "ean")
    deals = model.read(spark, sf_dir, "orders").where("o_orderkey % 200 = 0").select(F.col("o_custkey").alias("product_id")).distinct()
    return repair.reconciled(products, links, deals, m.now)


@query("E12_merges", f"+ {_RECONCILED} SELECT product_id, keep_id, deleted FROM merged")
def _merges(spark, sf_dir):
    """Products of a code that another one stands for; those with deals stay without links."""
    return _reconciled(spark, sf_dir)[0]


@query("E12_link_decisions", f"""+ {_RECONCILED}, d AS (SELECT o.*, right_id, by_ean, score, CASE WHEN own_score < 0.45 THEN 'rejected' WHEN right_id <> product_id AND (by_ean OR score >= 0.82) THEN 'repaired' END AS decision FROM own o JOIN m_matched m ON m.left_id = o.id)
SELECT id AS sku_id, product_id AS old_id, decision, CASE WHEN decision = 'repaired' THEN right_id END AS product_id, CASE WHEN decision = 'repaired' THEN CASE WHEN by_ean THEN 'ean' ELSE 'semantic' END END AS method, CASE WHEN decision = 'rejected' THEN own_score ELSE score END AS score FROM d WHERE decision IS NOT NULL""")
def _decisions(spark, sf_dir):
    """Links that wait for review and are rejected or get another product."""
    return _reconciled(spark, sf_dir)[1]


@query("E12_removed_products", f"+ {_RECONCILED} SELECT a.id AS product_id FROM after a, clock WHERE a.created_at <= now - INTERVAL 30 DAY AND a.id NOT IN (SELECT product_id FROM moved) AND a.id NOT IN (SELECT product_id FROM deal)")
def _removed(spark, sf_dir):
    """Old products without links and deals."""
    return _reconciled(spark, sf_dir)[2]


@query("A28_orphan_diagnoses", f"""+ {_CODES},
active AS (SELECT sku_id, CASE WHEN sku_id % 3 = 0 THEN ltrim(ean, '0') WHEN sku_id % 3 = 1 THEN ean END AS ean FROM sku JOIN codes ON codes.product_id = product_key WHERE sku_id % 13 <> 0),
counted AS (SELECT a.*, l.product_id, coalesce(n, 0) AS n FROM active a LEFT JOIN link l USING (sku_id) LEFT JOIN (SELECT sku_id, count(*) AS n FROM price GROUP BY 1) USING (sku_id)),
lost AS (SELECT *, (SELECT count(*) FROM codes c WHERE c.ean = x.ean) AS sold, (SELECT count(*) FROM codes c WHERE c.ean = lpad(x.ean, 13, '0')) AS padded FROM (SELECT * FROM counted WHERE product_id IS NULL) x),
code AS (SELECT ean, count(*) AS k, sum(n) AS n FROM lost WHERE ean IS NOT NULL GROUP BY 1), best_codes AS (SELECT * FROM code ORDER BY n DESC, ean LIMIT 20)
SELECT 1 AS diagnosis, NULL AS label, f.figure, f.value FROM (SELECT unnest([{{'figure': 'listings', 'value': count(*)}}, {{'figure': 'linked', 'value': count(product_id)}}, {{'figure': 'orphans', 'value': count(*) - count(product_id)}}, {{'figure': 'with_code', 'value': count(*) FILTER (product_id IS NULL AND ean IS NOT NULL)}},
  {{'figure': 'without_code', 'value': count(*) FILTER (product_id IS NULL AND ean IS NULL)}}, {{'figure': 'with_13_digits', 'value': count(*) FILTER (product_id IS NULL AND length(ean) = 13)}}, {{'figure': 'prices', 'value': coalesce(sum(n) FILTER (product_id IS NULL), 0)::BIGINT}}]) AS f FROM counted)
UNION ALL SELECT 2, NULL, 'listings', count(*) FILTER (padded > 0) FROM lost UNION ALL SELECT 2, NULL, 'prices', coalesce(sum(n * padded), 0)::BIGINT FROM lost
UNION ALL SELECT 3, NULL, 'listings', count(*) FILTER (sold > 0) FROM lost UNION ALL SELECT 3, NULL, 'prices', coalesce(sum(n * sold), 0)::BIGINT FROM lost
UNION ALL (SELECT 4, sku_id::VARCHAR, 'prices', n FROM lost WHERE length(ean) = 13 ORDER BY n DESC, sku_id LIMIT 20) UNION ALL (SELECT 5, sku_id::VARCHAR, 'prices', n FROM lost WHERE ean IS NULL ORDER BY n DESC, sku_id LIMIT 20)
UNION ALL SELECT 6, length(ean)::VARCHAR, 'listings', count(*) FROM lost WHERE ean IS NOT NULL GROUP BY length(ean) UNION ALL SELECT 7, NULL, 'codes', count(*) FROM code
UNION ALL SELECT 8, ean, 'listings', k FROM best_codes UNION ALL SELECT 8, ean, 'prices', n::BIGINT FROM best_codes
UNION ALL SELECT 9, NULL, 'listings', count(product_id) FROM counted UNION ALL SELECT 9, NULL, 'products', count(DISTINCT product_id) FROM counted""")
def _diagnoses(spark, sf_dir):
    """All nine, over active listings, of which a third has its product's code without leading zeros and a third none."""
    checkpoints(spark)
    m = model.from_star(spark, sf_dir)
    coded = m.product.select(F.col("product_id").alias("product_key"), code(F.col("product_id")).alias("ean"))
    k = F.col("sku_id")
    own = F.when(k % 3 == 0, F.ltrim("ean", F.lit("0"))).when(k % 3 == 1, F.col("ean"))
    skus = m.sku.join(coded, "product_key").select("sku_id", (k % 13 != 0).alias("is_active"), own.alias("ean"))
    return jobs.diagnosis(skus, m.link, m.price, coded)


@query("T7_T9_normalized", f"""+ {_SIDES}
SELECT id AS sku_id, name, CASE WHEN length(split_part(name, ' ', 1)) >= 3 THEN split_part(name, ' ', 1) ELSE split_part(name, ' ', 2) END AS brand, CASE WHEN id % 7 = 3 THEN amount / 1000 WHEN amount IS NULL AND pack THEN 6 ELSE amount END AS amount, CASE WHEN id % 7 = 3 THEN 'kg' WHEN amount IS NOT NULL THEN 'g' WHEN pack THEN 'un' END AS unit, CASE WHEN pack THEN 6 END::DOUBLE AS count, pack AS is_pack,
  CASE WHEN pack THEN 'pack' WHEN light THEN 'light' ELSE '' END AS variants, 0 AS types FROM left_side""")
def _normalized(spark, sf_dir):
    """The normalised text of every listing: name, guessed brand, size, pack, variants."""
    checkpoints(spark)
    rows = matching.with_described(_listings(model.from_star(spark, sf_dir)))
    return rows.select(F.col("id").alias("sku_id"), "n.name", "n.brand", "n.unit.amount", "n.unit.unit", F.col("n.pack.count").cast("double").alias("count"), "n.pack.is_pack", F.array_join("n.variants", ",").alias("variants"), F.size("n.types").alias("types"))


@query("J13_contained_word", f"""+ {_SIDES}, word AS (SELECT id, split_part(name, ' ', 1) AS w FROM left_side WHERE id NOT IN (SELECT sku_id FROM link))
SELECT id AS sku_id, count(*) AS products, min(product_id) AS least_id FROM word JOIN product p ON contains(p.name, w) GROUP BY id""")
def _contained(spark, sf_dir):
    """Products whose name contains the first word of a listing without a link, anywhere."""
    m = model.from_star(spark, sf_dir)
    checkpoints(spark)
    orphans = matching.with_described(_listings(m).join(m.link.select(F.col("sku_id").alias("id")), "id", "left_anti")).select(F.col("id").alias("sku_id"), F.col("n.name").alias("text"))
    return jobs.products_containing(orphans, m.product)


@query("P16_run_states", """WITH run AS (SELECT o_custkey % 50 AS store_id, o_orderkey::VARCHAR AS run_id, o_orderdate::TIMESTAMP AS finished_at, o_orderstatus <> 'F' AS ok FROM orders),
good AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY store_id ORDER BY finished_at, run_id ROWS UNBOUNDED PRECEDING) AS g FROM run),
failed AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY store_id, g ORDER BY finished_at, run_id ROWS UNBOUNDED PRECEDING) AS failures FROM good)
SELECT store_id, run_id, failures::INTEGER AS failures, failures >= 3 AS quarantined, strftime(CASE WHEN failures >= 3 THEN finished_at + INTERVAL 24 HOUR END, '%Y-%m-%d %H:%M:%S') AS until FROM failed""", base=False)
def _run_states(spark, sf_dir):
    """The failures in a row after every run, and until when its store rests; the stream's state says the same."""
    rows = model.read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("store_id"), F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("finished_at"), (F.col("o_orderstatus") != "F").alias("ok"))
    return runs.run_history(rows).drop("at").withColumn("until", F.date_format("until", "yyyy-MM-dd HH:mm:ss"))


#: Products with a letter less, without a size or brand of their own or in their text; links make the stores, each
#: of which has eight branches that a product's key tells.
_TWINS = """
side AS (SELECT product_id AS id, CASE WHEN product_id % 3 = 1 THEN left(name, length(name) - 1) ELSE name END AS name, CASE WHEN product_id % 5 <> 0 THEN 'b' || (product_id % 2) END AS declared, CASE WHEN product_id % 7 <> 5 THEN 100.0::DOUBLE END AS amount,
  false AS pack, false AS light, NULL::VARCHAR AS context, false AS valid, CASE WHEN product_id % 11 <> 0 THEN 100 END AS own FROM product),
at_store AS (SELECT l.product_id AS id, list(DISTINCT k.store_id * 8 + l.product_id % 8) AS stores, count(*) AS links FROM link l JOIN sku k USING (sku_id) WHERE l.status <> 'rejected' GROUP BY 1),
full_side AS (SELECT s.*, coalesce(declared, split_part(name, ' ', 1)) AS brand, coalesce(stores, []) AS stores, coalesce(links, 0) AS links FROM side s LEFT JOIN at_store USING (id))"""


@query("E14_consolidated", f"""+ RECURSIVE {_TWINS}, {_alike('side', 'side', 'c_')},
twin AS (SELECT a.id AS a, b.id AS b FROM full_side a JOIN c_score s ON {_is('a', 's.l')} JOIN full_side b ON {_is('b', 's.r')}
  WHERE a.id < b.id AND a.brand = b.brand AND a.own IS NOT DISTINCT FROM b.own AND NOT list_has_any(a.stores, b.stores) AND alike >= 0.86 AND score >= 0.8
    AND CASE WHEN a.amount IS NOT NULL AND b.amount IS NOT NULL THEN a.own IS NOT NULL AND a.amount = b.amount WHEN a.amount IS NULL AND b.amount IS NULL THEN true ELSE alike >= 0.93 END),
both_ways AS (SELECT a, b FROM twin UNION SELECT b, a FROM twin),
reach AS (SELECT a AS node, a AS top FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.top = both_ways.a),
family AS (SELECT node, min(top) AS family FROM reach GROUP BY node)
SELECT node AS product_id, first_value(node) OVER (PARTITION BY family ORDER BY links DESC, length(name) DESC, node) AS keep_id FROM family JOIN full_side ON id = node""")
def _consolidated(spark, sf_dir):
    """Products that are one article, and which of them stays."""
    checkpoints(spark)
    m = model.from_star(spark, sf_dir)
    k = F.col("product_id")
    name = F.when(k % 3 == 1, F.substring("name", F.lit(1), F.length("name") - 1)).otherwise(F.col("name"))
    rows = m.product.select(
        k, F.concat_ws(" ", name, F.when(k % 7 != 5, "100 gr")).alias("t"), F.when(k % 5 != 0, F.concat(F.lit("b"), (k % 2).cast("string"))).alias("declared"), F.lit(None).cast("string").alias("context"),
        F.when(k % 11 != 0, 100.0).alias("unit_amount"), F.when(k % 11 != 0, "g").alias("unit_type"),
    )
    return jobs.consolidated(rows, m.link.join(m.sku.select("sku_id", "store_id"), "sku_id").select("product_id", (F.col("store_id") * 8 + k % 8).alias("store_id"), "status"))


_PACKED = _SIDES.replace("p.name AS name, brand AS declared, size::DOUBLE AS amount, false AS pack", "CASE WHEN product_id % 3 = 0 THEN p.name || ' pack' ELSE p.name END AS name, p.name AS plain, brand AS declared, size::DOUBLE AS amount, product_id % 3 = 0 AS pack")
_PACKED = _PACKED[: _PACKED.index("left_side AS")] + _PACKED[_PACKED.index("left_side AS") :].replace("name", "plain").replace("AS plain,", "AS name,")


@query("E15_rematched", f"""+ {_PACKED},
odd AS (SELECT l.sku_id, l.product_id, s.* FROM link l JOIN left_side s ON s.id = l.sku_id JOIN right_side r ON r.id = l.product_id WHERE l.status IN ('auto', 'confirmed') AND s.pack <> r.pack),
{_matched('odd', 'right_side', 'o_')}
SELECT sku_id, CASE WHEN (by_ean OR status = 'auto') AND right_id <> product_id THEN right_id ELSE product_id END AS product_id, CASE WHEN (by_ean OR status = 'auto') AND right_id <> product_id THEN 'auto' ELSE 'pending_review' END AS status FROM odd JOIN o_matched ON left_id = id""")
def _rematched(spark, sf_dir):
    """Links between a pack and a single article: to another product, or to review."""
    checkpoints(spark)
    m = model.from_star(spark, sf_dir)
    described = F.concat_ws(" ", "name", F.when(F.col("id") % 3 == 0, "pack x 6"), F.concat(F.col("size").cast("string"), F.lit(" gr")))
    products = _products(m).drop("t", "slug", "name").join(m.product.select(F.col("product_id").alias("id"), "name", "size"), "id").withColumn("t", described).drop("name", "size")
    listings = _listings(m).drop("store_id")
    what = lambda rows, key, name: matching.with_described(rows.select(F.col("id").alias(key), "t")).select(key, F.struct("n.pack", "n.variants").alias(name))
    links = m.link.select("sku_id", "product_id", "status").join(what(listings, "sku_id", "sku_n"), "sku_id").join(what(products, "product_id", "product_n"), "product_id")
    odd = jobs.conflicts(links).select("sku_id", "product_id").checkpoint()
    return jobs.rematched(odd, matching.match(listings.join(odd.select(F.col("sku_id").alias("id")), "id", "left_semi"), products))
