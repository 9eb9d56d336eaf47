"""Snapshot ingest: one function from snapshots to accepted and rejected rows, for batches and for streams.

A stream of JSON files is read with a fixed schema; each micro-batch is validated, deduplicated, compared with what is
known and written once under its run and batch, so a batch that runs again replaces its own output. Tables are logs of
changes: a key's last row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from feria.functions import text
from feria.operators import prices
from feria.schemas import RULES, SNAPSHOT, Rules


def reason(rules: Rules, hosts: list[str]) -> Column:
    """Why a snapshot is rejected, the first that applies; null: it is not."""
    host = F.regexp_replace(F.expr("try_parse_url(url, 'HOST')"), r"^www\.", "")
    amount = F.col("price.amount")
    allowed = F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
    broken = F.col("externalId").isNull() | (F.col("externalId") == "") | F.col("url").isNull() | F.col("rawDescription").isNull() | ~F.length("rawDescription").between(1, 500) | amount.isNull() | F.col("capturedAt").try_cast("timestamp").isNull()
    return F.when(broken, "invalid_snapshot").when(amount <= 0, "invalid_price").when(amount < rules.min_price, "below_min_price").when(~F.coalesce(allowed, F.lit(False)), "invalid_source_url")


def checked(snapshots: DataFrame, hosts: list[str], rules: Rules = RULES) -> DataFrame:
    """Adds reason, and nulls an EAN that does not check (ean_dropped tells so)."""
    code = text.ean(F.col("ean"))
    good = text.ean_valid(code)
    return snapshots.withColumns({"reason": reason(rules, hosts), "ean_dropped": F.col("ean").isNotNull() & ~good, "ean": F.when(good, code)})


def once(rows: DataFrame) -> DataFrame:
    """One row for each listing and kind of price: the first captured, of equal times the cheapest, then by text."""
    rows = rows.withColumn("kind", F.coalesce("price.listOrPromo", F.lit("list")))
    order = F.struct(F.col("capturedAt").cast("timestamp").alias("t"), "price.amount", "rawDescription", "url", F.struct(*rows.columns).alias("row"))
    return rows.groupBy("externalId", "kind").agg(F.min(order)["row"].alias("r")).select("r.*")


def as_prices(rows: DataFrame) -> DataFrame:
    """Accepted snapshots as price rows."""
    return rows.select("externalId", F.col("capturedAt").cast("timestamp").alias("captured_at"), F.col("kind").alias("list_or_promo"), F.round(F.col("price.amount") * 100).cast("long").alias("price"), "ean")


KEY = ["externalId", "captured_at", "list_or_promo"]


def not_yet(new: DataFrame, old: DataFrame) -> DataFrame:
    """New price rows whose key (listing, time, kind) is not there yet: a replay adds nothing. Of new rows with equal keys
    the cheapest stays, then the least code."""
    rest = [c for c in new.columns if c not in KEY]
    first = new.groupBy(*KEY).agg(F.min(F.struct("price", *[c for c in rest if c != "price"])).alias("r")).select(*KEY, "r.*")
    return first.select(*new.columns).join(old.select(*KEY), KEY, "left_anti")


_LOGS = {
    "prices": "externalId string, captured_at timestamp, list_or_promo string, price long, ean string, is_suspect boolean",
    "listings": "externalId string, text string, ean string, last_seen_at timestamp",
    "products": "slug string, name string, ean string, updated_at timestamp",
    "links": "externalId string, slug string, method string, status string",
    "rejected": "externalId string, reason string",
}


def log(spark: SparkSession, out: str, table: str) -> DataFrame:
    """All rows that runs have written to a table, with their run and batch."""
    schema = T.StructType.fromDDL(_LOGS[table] + (", day date" if table == "prices" else "")).add("run", "string").add("batch", "long")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{table}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{out}/{table}").parquet(f"{out}/{table}")


#: Days of a micro-batch by which the log of prices is pruned; a batch of more days is compared with the whole log.
MOST_DAYS = 400


def of_days(log: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of a log of prices that have a day of the new ones (captured_at): a price is only stored twice on its day."""
    days = [r.day for r in new.select(F.to_date("captured_at").alias("day")).distinct().limit(MOST_DAYS + 1).collect()]
    return log if len(days) > MOST_DAYS else log.where(F.col("day").isin(days))


def current(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of a log: the highest `order`, then the later run and batch."""
    cols = [c for c in rows.columns if c not in (key, "run", "batch")]
    best = F.max(F.struct(order, "run", "batch", F.struct(*cols).alias("row")))["row"]
    return rows.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def known_prices(old: DataFrame, now: Column | None = None, rules: Rules = RULES) -> tuple[DataFrame, DataFrame]:
    """What a run's prices are compared with, as it stood before the run: the last price of each listing, and the number,
    mean and spread of its unsuspected prices of the last days."""
    good = old.where(~F.col("is_suspect"))
    last = good.groupBy(F.col("externalId").alias("sku_id")).agg(F.max(F.struct("captured_at", (-F.col("price")).alias("c"))).alias("k")).select("sku_id", (-F.col("k.c")).alias("last_price"))
    edge = (F.current_timestamp() if now is None else now) - F.make_dt_interval(days=F.lit(rules.stats_days))
    stats = good.where(F.col("captured_at") >= edge).groupBy(F.col("externalId").alias("sku_id")).agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("sd"))
    return last, stats


def linked(fresh: DataFrame, links: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links for listings (externalId, text, ean, last_seen_at) that have none, and the products to create for them: by
    code, else by the slug that text and code give, which is a new product if there is none."""
    name = text.tokens(F.col("text"))
    slug = text.forge_slug(F.array_join(name, " "), F.col("ean"))
    rows = fresh.join(links.select("externalId"), "externalId", "left_anti").withColumn("slug", slug).withColumn("name", F.array_join(name, " "))
    codes = products.where("ean is not null").groupBy("ean").agg(F.min("slug").alias("known"))
    rows = rows.join(codes, "ean", "left")
    method = F.when(F.col("known").isNotNull(), "ean").otherwise("semantic")
    made = rows.select("externalId", F.coalesce("known", "slug").alias("slug"), method.alias("method"), F.lit("auto").alias("status"))
    new = rows.where("known is null").join(products.select("slug"), "slug", "left_anti")
    first = new.groupBy("slug").agg(F.min(F.struct("last_seen_at", "name", "ean")).alias("r"))
    return made, first.select("slug", "r.name", "r.ean", F.col("r.last_seen_at").alias("updated_at"))


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, hosts: list[str], rules: Rules = RULES, *, run_id: str = "run-1", files: int = 100, now: Column | None = None, others: DataFrame | None = None) -> StreamingQuery:
    """Ingest what the folder holds now, in micro-batches, into the logs of `out`: prices, listings, products, links,
    rejected snapshots and counts of each reason.

    A listing's price of a kind counts once a run, and a price that an earlier run or batch has is not stored again.
    Suspicion is judged by the prices before the run, and by `others` (sku_id, median_other in cents): for each listing the
    median of what other stores ask for its product, as `prices.median_of_others` finds it. A batch's new products are
    candidates for the next batches. Prices are stored by day, and a batch is compared with the days that it has.
    """
    last, stats = known_prices(log(spark, out, "prices").where(F.col("run") != run_id), now, rules)
    before = f"{out}/before/run={run_id}"
    last.write.mode("overwrite").parquet(f"{before}/last")
    stats.write.mode("overwrite").parquet(f"{before}/stats")
    last, stats = (spark.read.schema(d.schema).parquet(f"{before}/{n}") for d, n in ((last, "last"), (stats, "stats")))
    others = spark.createDataFrame([], "sku_id string, median_other double") if others is None else others.select("sku_id", "median_other")

    def batch(df: DataFrame, batch_id: int) -> None:
        earlier = ~((F.col("run") == run_id) & (F.col("batch") >= batch_id))
        old = {t: log(spark, out, t).where(earlier) for t in ("prices", "listings", "products", "links")}
        rows = checked(df, hosts, rules)

        def write(table: str, rows: DataFrame, *by: str) -> None:
            rows.write.mode("overwrite").partitionBy(*by).parquet(f"{out}/{table}/run={run_id}/batch={batch_id}")

        accepted = once(rows.where("reason is null"))
        mine = old["prices"].where(F.col("run") == run_id).select("externalId", F.col("list_or_promo").alias("kind"))
        accepted = accepted.join(mine, ["externalId", "kind"], "left_anti")
        priced = as_prices(accepted)
        new = not_yet(priced, of_days(old["prices"], priced)).withColumnRenamed("externalId", "sku_id")
        judged = prices.suspects(new, last, stats, others, rules)
        write("prices", judged.select(F.col("sku_id").alias("externalId"), "captured_at", "list_or_promo", "price", "ean", F.col("suspect_new").alias("is_suspect"), F.to_date("captured_at").alias("day")), "day")
        seen = accepted.groupBy("externalId").agg(F.max(F.struct(F.col("capturedAt").cast("timestamp").alias("t"), "rawDescription", "ean")).alias("r"))
        seen = seen.select("externalId", F.col("r.rawDescription").alias("text"), F.col("r.ean").alias("ean"), F.col("r.t").alias("last_seen_at"))
        write("listings", seen)
        links, products = linked(seen, old["links"], current(old["products"], "slug", "updated_at"))
        write("links", links)
        write("products", products)
        write("rejected", rows.where("reason is not null").select("externalId", "reason"))
        write("counts", rows.groupBy("reason").count())

    stream = spark.readStream.schema(SNAPSHOT).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", files).json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream without repeated events within the watermark (the watermark is an addition of this library)."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def highest(events: DataFrame) -> DataFrame:
    """Keyed state: the largest value of each user so far."""
    return events.groupBy("user_id").agg(F.max("value").alias("value"))


def quarantine(runs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Stores whose last `quarantine_failures` runs all failed, and until when they rest. runs: store_id, started_at, ok."""
    last = runs.groupBy("store_id").agg(F.max(F.when(F.col("ok"), F.col("started_at"))).alias("good_at"), F.max("started_at").alias("last_at"))
    bad = runs.join(last, "store_id").where(F.col("good_at").isNull() | (F.col("started_at") > F.col("good_at")))
    n = bad.groupBy("store_id").agg(F.count(F.lit(1)).alias("failures"), F.max("last_at").alias("last_at")).where(F.col("failures") >= rules.quarantine_failures)
    return n.select("store_id", "failures", (F.col("last_at") + F.make_dt_interval(hours=F.lit(rules.quarantine_hours))).alias("until"))


def alerts(stores: DataFrame, runs: DataFrame, now: Column, rules: Rules = RULES) -> DataFrame:
    """store_id and alert, one row each: a store in quarantine, a last run that rejected too much or failed, and data that is
    stale or missing. stores: store_id, last_at; runs: store_id, started_at, ok, captured, rejected."""
    resting = quarantine(runs, rules).where(F.col("until") > now).select("store_id", F.lit("quarantine").alias("alert"))
    last = runs.groupBy("store_id").agg(F.max(F.struct("started_at", "ok", "captured", "rejected")).alias("r"))
    share = F.col("r.rejected") / F.nullif(F.col("r.captured") + F.col("r.rejected"), F.lit(0))
    rejecting = last.where(share > rules.max_rejection).select("store_id", F.lit("rejection").alias("alert"))
    failed = last.where(~F.col("r.ok")).select("store_id", F.lit("failed").alias("alert"))
    old = F.col("last_at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_at") > rules.stale_hours * 3600)
    return resting.unionByName(rejecting).unionByName(failed).unionByName(stores.where(old).select("store_id", F.lit("stale").alias("alert")))
