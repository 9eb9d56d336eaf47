"""Entity matching: likeness of listings and products, blocking, routing, merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feria.functions import text
from feria.schemas import RULES, Rules
from feria.sources.model import kept, rank, spread

_SCALE = {"kg": 1000.0, "g": 1.0, "l": 1000.0, "ml": 1.0, "un": 1.0}
_KIND = {"kg": "mass", "g": "mass", "l": "volume", "ml": "volume", "un": "count"}


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def presentation_conflict(a: Column, b: Column) -> Column:
    """Packs against single articles, or known counts that differ."""
    return (a["is_pack"] != b["is_pack"]) | F.coalesce(a["count"] != b["count"], F.lit(False))


def base_amount(u: Column) -> Column:
    """The amount of a size (a struct of amount and unit) in grams, millilitres or articles."""
    return u["amount"] * _lookup(_SCALE, u["unit"])


def base_kind(u: Column) -> Column:
    return _lookup(_KIND, u["unit"])


def unit_factor(a: Column, b: Column) -> Column:
    """What the sizes of two presentations do to their score; null where they say nothing (none has one, or one counts
    articles)."""
    return _size_factor(_amounts(a), _amounts(b))


def _amounts(u: Column) -> dict[str, Column]:
    return {"no": u["unit"].isNull() | u["amount"].isNull(), "articles": F.coalesce(u["unit"] == "un", F.lit(False)), "base": base_amount(u), "kind": base_kind(u)}


def _size_factor(a: dict[str, Column] | Column, b: dict[str, Column] | Column) -> Column:
    ratio = F.least(a["base"], b["base"]) / F.greatest(a["base"], b["base"])
    silent = (a["no"] & b["no"]) | a["articles"] | b["articles"]
    return F.when(silent, F.lit(None)).when(a["no"] | b["no"], 0.8).when(a["kind"] != b["kind"], 0.6).when(ratio >= 0.9, 1.05).when(ratio < 0.5, 0.05).otherwise(0.5)


def traits(n: Column) -> Column:
    """What a score needs of a `text.normalized` struct besides its name, in a form that pairs compare without searching."""
    size = {k: v.alias(k) for k, v in _amounts(n["unit"]).items()}
    return F.struct(*size.values(), n["pack"].alias("pack"), n["types"].alias("types"), F.get(n["types"], F.lit(0)).alias("type"), n["variants"].alias("variants"), text.exclusive(n["variants"]).alias("exclusive"), n["brand"].alias("brand"))


def pair_size(a: Column, b: Column) -> Column:
    """The factor of packs and sizes of two `traits`."""
    return F.when(presentation_conflict(a["pack"], b["pack"]), 0.05).otherwise(F.coalesce(_size_factor(a, b), F.lit(1.0)))


def pair_blocks(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Of two `traits`: whether their types differ, whether their variants do, whether their first types are equal."""
    apart = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    other_line = apart(a["exclusive"], b["exclusive"]) | apart(a["variants"], b["variants"])
    return apart(a["types"], b["types"]), other_line, F.coalesce(a["type"] == b["type"], F.lit(False))


def blended(alike: Column, context: Column) -> Column:
    """The likeness of names with a quarter of that of the contexts, if both are known."""
    return F.coalesce(alike * (1 - CONTEXT) + context * CONTEXT, alike)


def scored(base: Column, size: Column, other_type: Column, other_line: Column, same_type: Column, other_brand: Column, same_brand: Column) -> Column:
    """The score of a pair from all that it is made of; four places."""
    score = base * size
    score = F.when(same_type, F.least(score * 1.05, F.lit(1.0))).otherwise(score)
    score = F.when(same_brand, F.least(score * 1.04, F.lit(1.0))).otherwise(score)
    blocked = F.when(other_type | other_brand, F.least(base, F.lit(0.2)) * 0.3).when(other_line, F.least(base, F.lit(0.35)) * 0.3)
    return F.floor(F.coalesce(blocked, score) * 10_000 + 0.5) / 10_000


#: The most that size, type and brand can raise a score by, and the share of the contexts.
BOOST, CONTEXT = 1.05 * 1.05 * 1.04, 0.25


def semantic_score(a: Column, b: Column, *, name: Column | None = None, context: Column | None = None, other_brand: Column | None = None, same_brand: Column | None = None) -> Column:
    """Score of two `text.normalized` structs: name likeness, with blocks by type, brand and variants, and factors for size,
    type and brand, of which the last two do not raise it above 1; four places. `name` is the names' likeness where it is
    known, `context` that of the contexts (null if one lacks), a quarter of the score; `other_brand` says that both declare
    a brand and not the same, `same_brand` that the first declares what the second has (not given: equal brands in texts).
    """
    base = text.dice(a["name"], b["name"]) if name is None else name
    if context is not None:
        base = blended(base, context)
    known = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    x, y = traits(a), traits(b)
    other_type, other_line, same_type = pair_blocks(x, y)
    return scored(base, pair_size(x, y), other_type, other_line, same_type, known(other_brand), known(a["brand"] == b["brand"] if same_brand is None else same_brand))


def _word_sets(rows: DataFrame, words: str, least: int) -> DataFrame:
    """id and words: the distinct words of `least` letters or more, in order, of rows that have any."""
    return rows.select("id", F.explode(F.filter(words, lambda t: F.length(t) >= least)).alias("word")).groupBy("id").agg(F.sort_array(F.collect_set("word")).alias("words"))


def _meetings(left: DataFrame, right: DataFrame, block: int, keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Distinct left_id and right_id of rows (id, words) that share a word and that `keep` wants, by an equal join on the word.

    The rows of a word are dealt to blocks of about `block` rows a side, and each pair of blocks is a join key of its own.
    A pair is made at its least shared word only.
    """

    def posted(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.col("id").alias(f"{side}_id"), F.col("words").alias(f"{side}_words"), F.explode("words").alias("word"))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("word").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    a, b = posted(left, "left"), posted(right, "right")
    cells = blocks(a, "n_left").join(blocks(b, "n_right"), "word")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.join(cells, "word").select("word", "left_id", "left_words", F.pmod(F.hash("left_id"), "n_left").alias("i"), every("n_right").alias("j"))
    b = b.join(cells, "word").select("word", "right_id", "right_words", every("n_left").alias("i"), F.pmod(F.hash("right_id"), "n_right").alias("j"))
    met = a.join(b, ["word", "i", "j"])
    if keep is not None:
        met = met.where(keep(F.col("left_id"), F.col("right_id")))
    return met.where(F.col("word") == F.array_min(F.array_intersect("left_words", "right_words"))).select("left_id", "right_id")


def candidates(left: DataFrame, right: DataFrame | None = None, words: str = "tokens", least: int = 3, block: int = 1000) -> DataFrame:
    """Distinct id pairs of rows that share a word of `least` letters or more; without `right` the pairs left_id < right_id
    of one table.

    Sets of words meet instead of rows, each two of them once (`_meetings`). The rows of a set are dealt to lists of about
    `block` ids, and only where two sets have met are two lists spread out to pairs, so that nothing but lists is shuffled
    and no pair is compared or made twice.
    """

    def lists(rows: DataFrame, side: str) -> DataFrame:
        n = rows.groupBy("words").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
        own = rows.join(n, "words").withColumn("part", F.pmod(F.hash("id"), "n")).groupBy("words", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        return own.select(*[F.col(c).alias(f"{side}_{c}") for c in ("words", "part", "ids")])

    a = _word_sets(left, words, least)
    b = a if right is None else _word_sets(right, words, least)
    sets = lambda d: d.select(F.col("words").alias("id"), "words").distinct()
    met = _meetings(sets(a), sets(b), block, None if right is not None else lambda x, y: x <= y)
    met = met.select(F.col("left_id").alias("left_words"), F.col("right_id").alias("right_words"))
    met = met.join(lists(a, "left"), "left_words").join(lists(b, "right"), "right_words")
    if right is None:
        met = met.where("left_words < right_words or left_part <= right_part")
    met = spread(met.withColumn("alone", F.expr("left_words = right_words and left_part = right_part")), "left_words", "left_part", "right_words", "right_part")
    pairs = met.select("alone", "right_ids", F.explode("left_ids").alias("x")).select("alone", "x", F.explode("right_ids").alias("y"))
    if right is not None:
        return pairs.select(F.col("x").alias("left_id"), F.col("y").alias("right_id"))
    return pairs.where("not alone or x < y").select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"))


def least_alike(score: float, *, context: bool = True) -> float:
    """The least likeness of names that a pair of this score can have, whatever its sizes, types, brands and contexts."""
    base = (score - 0.00005) / BOOST
    return max((base - CONTEXT) / (1 - CONTEXT), 0.0) if context else base


def alike_names(left: DataFrame, right: DataFrame, least: float, block: int = 1000) -> DataFrame:
    """left_name, right_name and alike of all pairs of names (columns name, distinct) whose Dice likeness is at least
    `least`, above zero. None is lost: two names that share enough pairs of letters share one among the rarest of each, as
    many as may not be shared and one more; and neither is much longer than the other. So only names that meet at a rare
    pair of letters are compared, in blocks where even that is hot. Rows with null or one letter have no pairs.
    """
    ratio = least / (2 - least)  # what the shorter of two alike names has of the longer one's pairs of letters
    numbered = F.expr("transform(g, (x, i) -> concat(x, '\x01', cast(size(filter(slice(g, 1, i + 1), y -> y = x)) as string)))")

    def grams(names: DataFrame) -> DataFrame:
        return names.select("name", text.bigrams(F.col("name")).alias("g")).where("size(g) > 0").select("name", F.size("g").alias("n"), F.explode(numbered).alias("token"))

    a, b = grams(left).checkpoint(), grams(right).checkpoint()
    often = a.select("token").unionAll(b.select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("often"))

    def rare(rows: DataFrame) -> DataFrame:
        own = rows.join(often, "token").groupBy("name", "n").agg(F.sort_array(F.collect_list(F.struct("often", "token")))["token"].alias("tokens"))
        shared = F.ceil(F.col("n") * F.lit(ratio) - 1e-9)
        return own.select(F.struct("name", "n").alias("id"), F.slice("tokens", F.lit(1), (F.col("n") - F.greatest(shared, F.lit(1)) + 1).cast("int")).alias("tokens"))

    fits = lambda x, y: (x["n"] >= y["n"] * ratio - 1e-9) & (y["n"] >= x["n"] * ratio - 1e-9)
    pairs = _meetings(_word_sets(rare(a), "tokens", 1), _word_sets(rare(b), "tokens", 1), block, fits).select(F.col("left_id.name").alias("left_name"), F.col("right_id.name").alias("right_name"))
    return pairs.withColumn("alike", text.dice(F.col("left_name"), F.col("right_name"))).where(F.col("alike") >= least)


def best_match(scored: DataFrame) -> DataFrame:
    """The best candidate of each left id: highest score, then least right id."""
    return scored.groupBy("left_id").agg(F.max(F.struct("score", (-F.col("right_id")).alias("r"))).alias("b")).select("left_id", (-F.col("b.r")).alias("right_id"), F.col("b.score").alias("score"))


def routed(score: Column, by_ean: Column, conflict: Column, rules: Rules = RULES) -> Column:
    """Status of a match: auto, pending_review or new."""
    doubtful = (score < rules.ean_conflict) | conflict
    return F.when(by_ean, F.when(doubtful, "pending_review").otherwise("auto")).when(score >= rules.auto_match, "auto").when(score >= rules.review_match, "pending_review").otherwise("new")


def _said(rows: DataFrame) -> DataFrame:
    """The rows with said: their description behind a sign, or a text of what is known of it; empty without any."""
    return rows.withColumn("said", F.coalesce(F.concat(F.lit("="), "t") if "t" in rows.columns else F.to_json("n"), F.lit("")))


def described(rows: DataFrame, non_brands: list[str] | None = None) -> DataFrame:
    """t and n (`text.normalized`) of the distinct descriptions t of rows: each is normalized once, in all tasks."""
    return spread(rows.select("t").distinct(), "t").select("t", text.normalized(F.col("t"), non_brands).alias("n"))


def with_described(rows: DataFrame) -> DataFrame:
    """The rows with n of their description t, which is normalized once for all rows that have it. Null has none."""
    return join_few(rows, described(rows.where("t is not null")).checkpoint(), ["t"], "left")


def join_few(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", most: int = 100_000) -> DataFrame:
    """A join with a checkpointed table, which is broadcast if it has no more than `most` (short) rows."""
    return rows.join(F.broadcast(few) if few.limit(most + 1).count() <= most else few, keys, how)


def _keyed(rows: DataFrame, alone: bool) -> DataFrame:
    """The rows, kept, with whether their code is valid, and 128 bits of all that a score is made of (`alone`: and of their
    id)."""
    rows = kept(_said(rows).select(*[c for c in rows.columns if c in ("id", "n", "declared", "context", "ean", "own_id")], "said"))
    rows = rows.withColumn("valid", text.ean_valid(F.coalesce("ean", F.lit(""))))
    return rows.withColumn("key", F.unhex(F.md5(F.to_json(F.struct("said", "declared", "context", "valid", *["id"] * alone)))))


def _grouped(rows: DataFrame, side: str, spoken: str) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of keyed rows (key, id: the least, said, declared, context, valid), and of their distinct descriptions
    a number, the name and the traits."""
    fields = [F.first(c).alias(c) for c in ("said", "declared", "context", "valid")]
    texts = rows.groupBy("key").agg(F.min("id").alias("id"), *fields)
    texts = kept(texts)
    if spoken == "t":
        forms = spread(texts.select("said").distinct(), "said").select("said", text.normalized(F.when(F.col("said") != "", F.substring("said", F.lit(2), F.length("said")))).alias("n"))
    else:
        forms = rows.groupBy("said").agg(F.first("n").alias("n"))
    forms = forms.select("said", F.monotonically_increasing_id().alias(f"{side}_no"), F.col("n.name").alias(f"{side}_name"), traits(F.col("n")).alias(f"{side}_traits")).checkpoint()
    texts = texts.join(forms.select("said", f"{side}_no"), "said").select("key", F.col("id").alias(f"{side}_id"), f"{side}_no", F.col("declared").alias(f"{side}_declared"), F.col("context").alias(f"{side}_context"), F.col("valid").alias(f"{side}_valid"))
    return texts.withColumnRenamed("key", f"{side}_key"), forms


def _near(pairs: DataFrame, left: DataFrame, right: DataFrame, most: int = 100_000) -> DataFrame:
    """Adds near, the Dice likeness of left_context and right_context, counted once for each two of them unless these are
    very many; null if one is."""
    a, b = (d.select(c).where(f"{c} is not null").distinct().checkpoint() for d, c in ((left, "left_context"), (right, "right_context")))
    dice = text.dice(F.col("left_context"), F.col("right_context"))
    if a.count() * b.count() > most:
        return pairs.withColumn("near", F.when(F.col("left_context").isNotNull() & F.col("right_context").isNotNull(), dice))
    return pairs.join(F.broadcast(a.crossJoin(b).withColumn("near", dice).checkpoint()), ["left_context", "right_context"], "left")


def _pair_score(left_brand: str = "left_declared", right_brand: str = "right_declared") -> Column:
    """The score of a row with alike, near, the factors of its descriptions and both sides' brands."""
    same = F.col(left_brand) == F.coalesce(F.col(right_brand), "right_brand")
    known = lambda c: F.coalesce(c, F.lit(False))
    return scored(blended(F.col("alike"), F.col("near")), F.col("size"), F.col("other_type"), F.col("other_line"), F.col("same_type"), known(F.col(left_brand) != F.col(right_brand)), known(same))


def _factors(pairs: DataFrame, least: float | None = None) -> DataFrame:
    """left_no, right_no, alike and the factors of pairs of descriptions with their traits; only those that can reach a score."""
    a, b = F.col("left_traits"), F.col("right_traits")
    rows = pairs.withColumn("size", pair_size(a, b))
    can = lambda *f: scored(blended(F.col("alike"), F.lit(1.0)), F.col("size"), *f, F.lit(False), F.lit(True))
    if least is not None:
        rows = rows.where(can(F.lit(False), F.lit(False), F.lit(True)) >= least)
    other_type, other_line, same_type = pair_blocks(a, b)
    rows = rows.select("left_no", "right_no", "alike", "size", other_type.alias("other_type"), other_line.alias("other_line"), same_type.alias("same_type"), F.col("right_traits.brand").alias("right_brand"))
    return rows if least is None else rows.where(can(F.col("other_type"), F.col("other_line"), F.col("same_type")) >= least)


def _best_by_text(x: DataFrame, y: DataFrame, forms: DataFrame, rules: Rules, earlier: bool) -> DataFrame:
    """left_key, right_id and score of the best product of each text. Texts meet the products of their own brand or of none
    (texts without a brand: all), and those with a valid code the products without one, by equal joins."""
    brand = F.when(F.col("left_declared").isNotNull(), F.array(F.concat(F.lit("="), "left_declared"), F.lit("-"))).otherwise(F.array(F.lit("*")))
    left = x.select("*", F.explode(brand).alias("brand_key"), F.when(F.col("left_valid"), "-").otherwise("*").alias("code_key"))
    own = F.coalesce(F.concat(F.lit("="), "right_declared"), F.lit("-"))
    groups = y.groupBy("right_no", "right_declared", "right_context", "right_valid").agg(F.min("right_id").alias("right_id"))
    right = groups.select("*", F.explode(F.array(own, F.lit("*"))).alias("brand_key")).select("*", F.explode(F.when(F.col("right_valid"), F.array(F.lit("*"))).otherwise(F.array(F.lit("*"), F.lit("-")))).alias("code_key")).drop("right_valid").checkpoint()
    pairs = join_few(left.join(forms, "left_no"), right, ["right_no", "brand_key", "code_key"])
    pairs = _near(pairs.where("left_id > right_id") if earlier else pairs, x, y)
    pairs = pairs.select("left_no", "left_key", "right_id", _pair_score().alias("score")).where(F.col("score") >= rules.review_match)
    best = pairs.groupBy("left_no", "left_key").agg(F.max(F.struct("score", (-F.col("right_id")).alias("r"))).alias("b"))
    return best.select(F.col("left_key").alias("key"), (-F.col("b.r")).alias("text_id"), F.col("b.score").alias("text_score"))


def pair_scores(pairs: DataFrame, x: DataFrame, y: DataFrame, left_forms: DataFrame, right_forms: DataFrame) -> DataFrame:
    """alike, conflict, score and named (both have names) of pairs of texts (left_key, right_key; distinct): names and
    factors are compared once for each two descriptions."""
    rows = pairs.join(x, "left_key").join(y, "right_key")
    met = rows.select("left_no", "right_no").distinct().join(left_forms.drop("said"), "left_no").join(right_forms.drop("said"), "right_no")
    names = met.where("left_name is not null and right_name is not null").select("left_name", "right_name").distinct()
    names = names.withColumn("alike", text.dice(F.col("left_name"), F.col("right_name")))
    met = met.join(names, ["left_name", "right_name"], "left").withColumn("alike", F.coalesce("alike", F.lit(0.0)))
    odd = met.select("left_no", "right_no", (F.col("left_name").isNotNull() & F.col("right_name").isNotNull()).alias("named"), presentation_conflict(F.col("left_traits.pack"), F.col("right_traits.pack")).alias("conflict"))
    rows = _near(rows.join(_factors(met).join(odd, ["left_no", "right_no"]), ["left_no", "right_no"]), x, y)
    return rows.select("left_key", "right_key", "alike", "conflict", "named", _pair_score().alias("score"))


def match(listings: DataFrame, products: DataFrame, rules: Rules = RULES, block: int = 1000, *, earlier: bool = False, codes: bool = True) -> DataFrame:
    """left_id, right_id, score, by_ean and status for each listing, and text_id and text_score, its best product by text;
    both tables have id (unique), n (`text.normalized`) or t (a description that is normalized here), declared (brand or
    null), context (or null) and ean (13 digits or null).

    A product with the listing's code comes first, the best scored of several. Listings are scored against all products
    that can reach the score of a review, which bounds on the names' likeness (`least_alike`) and on sizes, packs, types and
    variants tell, but for products with a valid code if their own is valid. Rows are reduced to distinct texts (of equal
    ones the least id counts), texts to distinct descriptions: names and sizes are compared once for each two descriptions,
    and rows carry 128 bits of their text. Of equal scores the least id wins. Without a product that reaches a review a
    listing is new and has neither product nor score. `earlier`: by text only products of a lesser id than the listing's
    count. Listings that have own_id also get own (whether that is a product's id) and own_score, their score with it. Rows,
    texts and descriptions are kept in the checkpoint folder, as they are read more than once. Without `codes` only left_id,
    text_id and text_score are returned, and no codes are compared.
    """
    left, right = _keyed(listings, earlier), _keyed(products, False)
    x, left_forms = _grouped(left, "left", "t" if "t" in listings.columns else "n")
    y, right_forms = _grouped(right, "right", "t" if "t" in products.columns else "n")
    names = lambda d, c: d.select(F.col(c).alias("name")).distinct()
    names = alike_names(names(left_forms, "left_name"), names(right_forms, "right_name"), least_alike(rules.review_match), block).checkpoint()
    met = left_forms.drop("said").join(names, "left_name").join(right_forms.drop("said"), "right_name")
    by_text = _best_by_text(x, y, kept(_factors(met, rules.review_match)), rules, earlier)
    rows = left.select(F.col("id").alias("left_id"), "key", "ean")
    if not codes:
        return rows.join(by_text, "key", "left").select("left_id", "text_id", "text_score")
    coded = rows.where("ean is not null").select("left_id", F.col("key").alias("left_key"), "ean")
    hits = coded.join(right.select(F.col("id").alias("right_id"), F.col("key").alias("right_key"), "ean"), "ean").drop("ean")
    asked = hits.select("left_key", "right_key")
    if owned := "own_id" in listings.columns:
        own = left.where("own_id is not null").select(F.col("id").alias("left_id"), F.col("key").alias("left_key"), "own_id").join(right.select(F.col("id").alias("own_id"), F.col("key").alias("right_key")), "own_id").drop("own_id")
        asked = asked.union(own.select("left_key", "right_key"))
    scores = kept(pair_scores(asked.distinct(), x, y, left_forms, right_forms))
    top = hits.join(scores, ["left_key", "right_key"]).groupBy("left_id").agg(F.max_by(F.struct("right_id", "alike", "conflict"), F.struct("score", -F.col("right_id"))).alias("h"))
    got = rows.drop("ean").join(by_text, "key", "left").join(top, "left_id", "left").withColumn("by_ean", F.col("h").isNotNull())
    status = routed(F.when(F.col("by_ean"), F.col("h.alike")).otherwise(F.coalesce("text_score", F.lit(0.0))), F.col("by_ean"), F.coalesce("h.conflict", F.lit(False)), rules)
    pick = lambda a, b: F.when(F.col("by_ean"), a).otherwise(F.col(b))
    more = []
    if owned:
        own = own.join(scores, ["left_key", "right_key"]).select("left_id", F.lit(True).alias("own"), F.when(F.col("named"), F.col("score")).alias("own_score"))
        got, more = got.join(own, "left_id", "left"), [F.col("own").isNotNull().alias("own"), "own_score"]
    return got.select("left_id", pick(F.col("h.right_id"), "text_id").alias("right_id"), pick(F.lit(1.0), "text_score").alias("score"), "by_ean", status.alias("status"), "text_id", "text_score", *more)


def blocked_pairs(rows: DataFrame, block: list[str]) -> DataFrame:
    """Pairs id_a < id_b of rows with equal block keys; nulls block nothing."""
    a, b = (rows.select(*block, *[F.col(c).alias(f"{c}_{s}") for c in rows.columns if c not in block]) for s in "ab")
    return a.join(b, block).where("id_a < id_b")


def min_labels(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint(), drop: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Connected components (node and component, its least node) of edges a, b.

    Each round takes the least label among a node's neighbours, combined before the shuffle, then follows labels to their
    own labels; the loop ends when no label changes. `keep` cuts a round's lineage (a checkpoint, or a written table), and
    `drop` removes what it kept once it is not read any more.
    """
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    kept = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")))
    labels = kept.select("a", "l")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, "a").select("a", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        up = labels.select(F.col("a").alias("l"), F.col("l").alias("top"))
        step = keep(step.join(up, "l").select("a", F.least("l", "top").alias("l"), "old"))
        if drop:
            drop(kept)
        kept, labels = step, step.select("a", "l")
        if step.where("l != old").isEmpty():
            if drop:
                drop(both)
            return labels.select(F.col("a").alias("node"), F.col("l").alias("component"))


def keepers(members: DataFrame, links: DataFrame) -> DataFrame:
    """The product of each group that stays: most links, then the longest name, then the least id."""
    n = links.groupBy("product_id").agg(F.count(F.lit(1)).alias("links"))
    got = members.join(n, "product_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    order = [F.col("links").desc(), F.length("name").desc(), F.col("product_id")]
    return got.withColumn("r", rank(["group"], order)).where("r = 1").select("group", F.col("product_id").alias("keep_id"))
