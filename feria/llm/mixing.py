"""Operator 8: sources mixed to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feria.llm import common

SEED = "mix-1"
#: A Poisson mean above this is drawn as a sum of equal parts, each with a hash of its own.
PART = 64.0
#: Sources whose rates are broadcast; of more, those with most documents are, and the others joined by a shuffle.
BROADCAST_SOURCES = 10_000
_HEX = 13


def draw(*parts: Column) -> Column:
    """A uniform whole number below 2**52 from a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _HEX), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, *, source_col: str = "source", text_col: str = "text", total: float | None = None) -> DataFrame:
    """source, size (characters of text), documents and rate: how often a document of the source is to appear on average.

    A source with weight w of all weights W gets w / W of `total` characters (the corpus's own size if not given). No
    weights: each source weighs the same. Sources without a weight get rate 0; a source without any text gets rate 1.
    """
    size = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.sum(F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("size"), F.count(F.lit(1)).alias("documents"))
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    one = size.withColumn("weight", weight)
    whole = one.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))  # one row
    got = one.crossJoin(F.broadcast(whole))
    share = F.col("weight") * (F.lit(float(total)) if total is not None else F.col("all_size").cast("double")) / F.col("all_weight")
    return got.select("source", "size", "documents", F.when(F.col("size") > 0, share / F.col("size")).otherwise(1.0).alias("rate"))


def with_steps(rate: DataFrame) -> DataFrame:
    """Adds the parts of each source's mean and the steps of the Poisson distribution function of one part."""
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("parts")
    top = F.sequence(F.lit(1), F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 40).cast("int"))
    first = F.exp(-F.col("mean"))
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("steps"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["steps"], F.array(s["c"] + p)).alias("steps"))

    return rate.withColumn("parts", parts).withColumn("mean", mean).withColumn("steps", F.aggregate(top, start, step)["steps"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", total: float | None = None) -> DataFrame:
    """Each document as often as its draw says, in one global random order.

    Columns doc (a struct of all columns of docs), rate, copy_no (from 0) and order_key, the number that the order goes
    by. The draw depends on the seed and the id only, so it is the same after a lost executor, and rows with equal ids (or
    null ids) are drawn alike. A null source is a source of its own, null texts count as empty, texts of any length are
    carried whole; an empty table stays empty. Columns of docs may have any names.
    """
    ident = F.col("ident")
    rate = with_steps(rates(docs, weights, source_col=source_col, text_col=text_col, total=total))
    rate = common.written(rate.select("source", "documents", "rate", "parts", "steps"), "source-rates")
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("ident"), F.col(f"`{source_col}`").alias("own_source"))
    if rate.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rate), F.col("own_source").eqNullSafe(F.col("source")))
    else:
        named = lambda df, c: df.withColumn("source_key", F.coalesce(F.col(c), F.lit("\x00")))
        joined = common.hot_join(named(rows, "own_source"), named(rate, "source"), ["source_key"], "documents")

    def count(part: Column) -> Column:
        u = draw(F.lit(seed), ident, part.cast("string")) / F.lit(float(16**_HEX))
        return F.size(F.filter("steps", lambda c: c <= u))

    n = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda s, part: s + count(part))
    copies = joined.withColumn("n", n).where("n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    keyed = copies.withColumn("order_key", draw(F.lit(seed), ident, F.lit("copy"), F.col("copy_no").cast("string")))
    return keyed.select("doc", "rate", "copy_no", "order_key").orderBy("order_key", f"doc.`{id_col}`", "copy_no")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: `documents` mixed so that each source has the same share of the characters."""
    got = mix(common.safe(common.load(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source", "n_chars"))
    return got.select("doc.*", "copy_no", "order_key")


ORACLE = """
WITH RECURSIVE sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
whole AS (SELECT count(*) AS w, sum(size) AS s FROM sizes),
rate AS (SELECT source, CASE WHEN size > 0 THEN (s::DOUBLE / w::DOUBLE) / size::DOUBLE ELSE 1.0 END AS r FROM sizes, whole),
steps AS (
  SELECT source, r, 0 AS k, exp(-r) AS p, exp(-r) AS c FROM rate
  UNION ALL SELECT source, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM steps WHERE k < ceil(r + 12 * sqrt(r) + 40)),
cdf AS (SELECT source, list(c ORDER BY k) AS cs FROM steps GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(cs, lambda x: x <= ('0x' || substr(md5('mix-1|' || doc_id || '|1'), 1, 13))::BIGINT / 4503599627370496.0)) AS n
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::INTEGER AS copy_no FROM drawn WHERE n > 0)
SELECT *, ('0x' || substr(md5('mix-1|' || doc_id || '|copy|' || copy_no), 1, 13))::BIGINT AS order_key FROM copies
"""
