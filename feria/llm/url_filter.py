"""Operator 9: URL verdicts by rules, and for the rest by a tree of path templates for each host.

Paths are cut into segments. Below each host, level by level, variable segments become wildcards (numbers by their
shape; others where a branch has many values that are each rare), and sibling branches whose labelled shares do not
differ by a two-sample test are merged. A template is rejected when its labelled purity, smoothed towards its host's
and that towards the whole table's, is below a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feria.llm import common

#: A branch with at least so many values, covering fewer than so many distinct URLs each on average, is variable.
MANY_VALUES, PER_VALUE = 20, 5.0
#: Sibling branches merge unless their shares differ by so many standard errors.
MERGE_Z = 1.96
#: Labels that a prior is worth, and the purity below which a template is rejected.
PRIOR, LEAST_PURITY = 4.0, 0.5
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged_by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and rule_verdict to distinct (host, path) rows: the longest rule whose host is the URL's or a parent
    domain of it and whose path starts the URL's path; of equally long ones the longer host's. No rule: null.

    Rules are found by equal keys: each URL offers its parent domains and, for each length of path that rules of that
    domain have, its path's start. So large rule lists need no cross join.
    """
    dots = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(dots)), lambda i: F.array_join(F.slice(dots, i, F.size(dots)), "."))
    hosts = urls.groupBy("host").agg(F.count(F.lit(1)).alias("urls")).withColumn("domain", F.explode(parents))
    lengths = rules.select(F.col("rule_host").alias("domain"), F.length("rule_path").alias("len")).distinct()
    asked = hosts.join(lengths, "domain").groupBy("host").agg(F.first("urls").alias("urls"), F.collect_list(F.struct("domain", "len")).alias("ask"))
    offers = common.hot_join(urls, common.written(asked, "asked-rules"), ["host"], "urls").withColumn("a", F.explode("ask"))
    offers = offers.select("host", "path", F.col("a.domain").alias("rule_host"), F.substring(F.col("path"), F.lit(1), F.col("a.len")).alias("rule_path"))
    name = F.concat("rule_host", "rule_path")
    best = offers.join(rules, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(F.struct(F.length(name), F.length("rule_host"), name.alias("rule"), F.col("rule_verdict"))).alias("b"))
    return urls.join(best.select("host", "path", "b.rule", "b.rule_verdict"), ["host", "path"], "left")


def shape(segment: Column) -> Column:
    """Runs of digits, and words of hexadecimal digits of 8 or more, as wildcards."""
    return F.regexp_replace(F.regexp_replace(segment, r"\b(?=[a-f]*[0-9])[0-9a-f]{8,}\b", "{x}"), "[0-9]+", "{n}")


def templates(urls: DataFrame) -> DataFrame:
    """host, path and template of each distinct (host, path), with its good and all labels (columns good, labels).

    Each round takes the URLs that have a segment at its level one level down; what has ended is put aside, as is a
    branch with a single URL, whose other segments stay as they are. So there are as many rounds as levels at which two
    URLs share a template, however deep, and each reads only what goes on.
    """
    spark = urls.sparkSession
    cut = F.split(F.ltrim(F.col("path"), F.lit("/")), "/")
    now = common.written(urls.withColumn("segs", F.transform(cut, shape)).withColumn("template", F.lit("")), "url-level")
    ended = common.shared_dir(spark, "url-templates")
    level = 0
    while True:
        now.where(F.size("segs") <= level).drop("segs").write.mode("append").parquet(ended)
        here = now.where(F.size("segs") > level).withColumn("seg", F.get("segs", F.lit(level)))
        values = common.written(here.groupBy("host", "template", "seg").agg(F.count(F.lit(1)).alias("urls"), F.sum("good").alias("g"), F.sum("labels").alias("n")), "url-values")
        if values.isEmpty():
            common.discard(now, values)
            return spark.read.schema(urls.withColumn("template", F.lit("")).schema).parquet(ended)
        branch = values.groupBy("host", "template").agg(F.count(F.lit(1)).alias("values"), F.sum("urls").alias("urls_all"), F.sum("g").alias("g_all"), F.sum("n").alias("n_all"))
        both = values.join(branch, ["host", "template"])
        rest_n, rest_g = F.col("n_all") - F.col("n"), F.col("g_all") - F.col("g")
        p = F.col("g_all") / F.col("n_all")
        error = F.sqrt(p * (1 - p) * (1 / F.col("n") + 1 / rest_n))
        differs = F.when((F.col("n") > 0) & (rest_n > 0), F.abs(F.col("g") / F.col("n") - rest_g / rest_n) > MERGE_Z * error).otherwise(F.lit(False))
        variable = (F.col("values") >= MANY_VALUES) & (F.col("urls_all") / F.col("values") < PER_VALUE)
        token = F.when(~variable & (differs | (F.col("values") == 1)), F.col("seg")).otherwise("*")
        tokens = common.written(both.select("host", "template", "seg", "urls", token.alias("token"), (F.col("urls_all") == 1).alias("alone")), "url-tokens")
        step = common.hot_join(here, tokens, ["host", "template", "seg"], "urls")
        rest = F.array_join(F.slice("segs", level + 1, F.greatest(F.size("segs") - level, F.lit(1))), "/")
        step = step.withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("alone"), rest).otherwise(F.col("token"))))
        step = step.withColumn("segs", F.when(F.col("alone"), F.slice("segs", 1, level + 1)).otherwise(F.col("segs")))
        done, now = now, common.written(step.select(*now.columns), "url-level")
        common.discard(done, values, tokens)
        level += 1


def judged_by_purity(urls: DataFrame) -> DataFrame:
    """Adds template, purity and verdict to distinct (host, path) rows with good and labels counts."""
    tree = templates(urls)
    t = tree.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("labels").alias("n"), F.count(F.lit(1)).alias("urls"))
    h = t.groupBy("host").agg(F.sum("g").alias("hg"), F.sum("n").alias("hn"), F.count(F.lit(1)).alias("templates"))
    whole = h.agg(((F.coalesce(F.sum("hg"), F.lit(0)) + 1) / (F.coalesce(F.sum("hn"), F.lit(0)) + 1)).alias("base"))  # one row
    h = h.crossJoin(F.broadcast(whole)).select("host", "templates", ((F.col("hg") + PRIOR * F.col("base")) / (F.col("hn") + PRIOR)).alias("host_purity"))
    t, h = common.written(t, "template-labels"), common.written(h, "host-purity")
    t = common.hot_join(t, h, ["host"], "templates").select("host", "template", "urls", ((F.col("g") + PRIOR * F.col("host_purity")) / (F.col("n") + PRIOR)).alias("purity"))
    t = common.written(t.withColumn("method_verdict", F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow")), "template-purity")
    return common.hot_join(tree, t, ["host", "template"], "urls").drop("urls")


def filter_urls(pages: DataFrame, rules: DataFrame, labels: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, template and purity for every row.

    `rules` has rule_host, rule_path and rule_verdict (allow or block); `labels` has id and good (1 or 0) for some
    rows, nulls ignored. A null URL or one without :// has empty host and path. Equal URLs get equal verdicts, an
    empty table gives no rows, and without labels every URL that no rule fits is allowed. URLs of any length and depth
    are judged whole.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    if labels is None:
        marked = rows.withColumn("good", F.lit(None).cast("int"))
    else:
        one = labels.where("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"))
        marked = rows.join(one, "id", "left")
    found = marked.groupBy("host", "path").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("good").alias("labels"), F.count(F.lit(1)).alias("rows"))
    found = common.written(found, "urls")
    urls = found.drop("rows")
    ruled = judged_by_rules(found.select("host", "path", "rows"), rules)
    scored = judged_by_purity(urls).select("host", "path", "template", "purity", "method_verdict")
    judged = ruled.join(scored, ["host", "path"]).withColumn("verdict", F.coalesce("rule_verdict", "method_verdict"))
    verdicts = common.written(judged.drop("rule_verdict", "method_verdict"), "url-verdicts")
    return common.hot_join(rows, verdicts, ["host", "path"], "rows").select("id", "host", "path", "rule", "verdict", "template", "purity")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: verdicts on the URLs of `pages`, labelled through `labels` by id (good: quality 1)."""
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, rule_verdict string")
    labels = common.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    return filter_urls(common.load(spark, sf_dir, "pages"), rules, labels).withColumnRenamed("id", "page_id")
