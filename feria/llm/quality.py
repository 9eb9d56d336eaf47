"""Operator 5: a quality classifier from an interpolated modified Kneser-Ney model of trusted text.

The model is of characters, for each language. One pass over the documents counts, in chunks of documents, every run of
ORDER characters and how often trusted documents hold it. The counts of all orders, their contexts and discounts are
DataFrames, sharded by language and run; joins of the runs that occur with these tables give each run's probability, and
the probabilities go back to the chunks that hold the run, where they are added up for each document. Some trusted
documents are held out of the counts. A document is rejected if its perplexity is above its language's threshold: a high
quantile of the perplexities of those held out. Languages with few trusted documents share a model of all trusted text.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feria.llm import common

ORDER = 4
#: Stands before a document's first character.
START = "\x02"
#: Characters that each document's score is smoothed with, at the trusted mean; quantile of trusted documents that is
#: still accepted, and by how much (in log perplexity) a document must be above it.
PRIOR_CHARS, QUANTILE, MARGIN = 60, 0.995, 0.05
#: Of so many trusted texts one is held out of the counts, for thresholds (every second one of a language that shares the
#: pooled model). Trusted documents that a model of a language's own takes; the pooled model's name.
HELD_OUT, FEW_HELD_OUT, MIN_TRUSTED, POOL = 10, 2, 50, "\x00pool"
#: Characters counted at once, and different runs held before they are handed on.
PIECE, HELD = 500_000, 600_000


def zipped(docs: DataFrame, langs: DataFrame, chunks: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """chunk, id, lang, own (whether the language has a model of its own), lot (whether the text is held out if trusted;
    equal texts alike), key (common.text_key) and the compressed text. Chunks are dealt by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in common.pieces(batch, "t"):
                raw, at = common.text_bytes(part.column(6))
                flat = memoryview(raw)
                z = pa.array([c.compress(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:6], z], names=["chunk", "id", "lang", "own", "lot", "key", "z"])

    rows = _named(docs, id_col, text_col, lang_col).join(langs, "lang")
    lot = F.pmod(F.xxhash64("t"), F.when(F.col("own"), HELD_OUT).otherwise(FEW_HELD_OUT)) == 0
    rows = rows.select(F.pmod("key", F.lit(chunks)).alias("chunk"), "id", "lang", "own", lot.alias("lot"), "key", "t")
    return rows.mapInArrow(common.trimmed(run), "chunk long, id long, lang string, own boolean, lot boolean, key long, z binary")


def _named(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    ident, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(ident.alias("id"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"), common.text_key(ident, text).alias("key"), text.alias("t"))


def _opened(docs: pa.Table, trusted: np.ndarray, pooled: bool) -> Iterator[tuple[list[tuple], list[str]]]:
    """A chunk's documents in parts of about PIECE characters: columns (id, lang, model, trusted, held, extra, key) and texts.
    Held are trusted documents that are not counted; extra are second rows of held documents, for the pooled model if a
    language uses it."""
    d = zstandard.ZstdDecompressor()
    known = np.isin(docs["key"].to_numpy(), trusted).tolist()
    cols, texts, size = [], [], 0
    for good, i, lang, own, lot, key, z in zip(known, *(docs[c].to_pylist() for c in ("id", "lang", "own", "lot", "key", "z"))):
        texts.append(d.decompress(z).decode("utf-8", "surrogatepass"))
        cols.append((i, lang, lang if own else POOL, good, good and lot, False, key))
        if good and lot and own and pooled:
            cols.append((i, lang, POOL, True, True, True, key))
            texts.append(texts[-1])
        size += len(texts[-1])
        if size >= PIECE:
            yield cols, texts
            cols, texts, size = [], [], 0
    if cols:
        yield cols, texts


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts with ORDER - 1 start marks before each, the place in them of each run, a run for each
    character, and each text's number of runs."""
    pad = START * (ORDER - 1)
    codes = np.frombuffer("".join([pad + t for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return codes, at, sizes


def _hashes(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        h = (h + codes[at + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _chunk_counts(docs: pa.Table, marks: pa.Table, pooled: bool) -> pa.Table:
    """chunk, lang (the model's), run and its count in trusted documents (0: none) in one chunk of documents."""
    chunk, trusted = docs["chunk"][0].as_py() if len(docs) else 0, marks["key"].to_numpy()
    held: dict[str, list] = {}
    out: list[pa.RecordBatch] = []
    size = 0
    for cols, texts in _opened(docs, trusted, pooled):
        groups: dict[tuple, list] = {}
        for (_, _, lang, good, apart, _, _), text in zip(cols, texts):
            groups.setdefault((lang, good and not apart), []).append(text)
        for (lang, counted), part in groups.items():
            codes, at, _ = _runs(part)
            h, where, n = np.unique(_hashes(codes, at), return_index=True, return_counts=True)
            grams = codes[at[where][:, None] + np.arange(ORDER)]
            held.setdefault(lang, []).append((h, grams, n if counted else np.zeros(len(n), np.int64)))
            size += len(h)
        if size > HELD:
            held = {k: [_merged(v)] for k, v in held.items()}
            size = sum(len(v[0][0]) for v in held.values())
            if size > HELD // 2:
                out += _counted(chunk, held)
                held, size = {}, 0
    out += _counted(chunk, held)
    return pa.Table.from_batches(out, _RUNS)


_RUNS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])


def _merged(parts: list[tuple]) -> tuple:
    h = np.concatenate([p[0] for p in parts])
    h, where, back = np.unique(h, return_index=True, return_inverse=True)
    return h, np.concatenate([p[1] for p in parts])[where], np.bincount(back, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)


def _counted(chunk: int, held: dict) -> Iterator[pa.RecordBatch]:
    for lang, parts in held.items():
        h, grams, n = _merged(parts)
        flat = np.ascontiguousarray(grams).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        text = pa.array([flat[i : i + ORDER] for i in range(0, len(flat), ORDER)], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk)), pa.array([lang] * len(h), pa.string()), text, pa.array(n)], schema=_RUNS)


def probabilities(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, gram and p for each of `grams`, from the trusted `counts` (lang, gram, n) of the highest order; a written step.

    Lower orders count the different characters before a run. Discounts are Chen and Goodman's, from each order's and
    language's runs that were seen once to four times. Each order's runs and probabilities are written before the next
    ones are planned: the driver never holds the plan of all orders, which grows with their product.
    """
    key, c = ["lang", "gram"], F.col("c")
    both = grams.select(*key, F.lit(None).cast("long").alias("c"), F.lit(True).alias("asked"))
    both = both.unionByName(counts.select(*key, F.col("n").alias("c"), F.lit(False).alias("asked")))
    runs = {ORDER: common.written(both.groupBy(*key).agg(F.max("c").alias("c"), F.max("asked").alias("asked")), f"runs-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        shorter = runs[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram"))
        runs[k] = common.written(shorter.agg(F.nullif(F.count("c"), F.lit(0)).alias("c"), F.max("asked").alias("asked")), f"runs-{k}")
    letters = F.when(F.count("c") > 0, 1.0 / (F.count("c") + 1)).otherwise(1e-3)
    lower = runs[1].groupBy("lang").agg(letters.alias("p")).select("lang", F.lit("").alias("gram"), "p")
    for k in range(1, ORDER + 1):
        seen, below = runs[k].where("c is not null"), lower
        ns = seen.groupBy("lang").agg(*[F.count(F.when(c == i, 1)).cast("double").alias(f"n{i}") for i in range(1, 5)])
        y = F.coalesce(F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0)), F.lit(0.5))
        part = [F.greatest(F.lit(0.05), F.least(F.lit(float(i)) - 0.05, F.coalesce(i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)), F.lit(0.5 * i)))).alias(f"d{i}") for i in (1, 2, 3)]
        cut = ns.select("lang", *part)
        context = F.substring("gram", 1, k - 1) if k > 1 else F.lit("")
        ctx = seen.groupBy("lang", context.alias("ctx")).agg(F.sum("c").alias("total"), *[F.count(F.when((c == i) if i < 3 else (c >= 3), 1)).alias(f"t{i}") for i in (1, 2, 3)])
        suffix = F.substring("gram", 2, k - 1) if k > 1 else F.lit("")
        rows = runs[k].where("asked").withColumn("ctx", context).withColumn("suffix", suffix)
        rows = rows.join(ctx, ["lang", "ctx"], "left").join(cut, "lang", "left")
        rows = rows.join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        discount = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        gamma = (F.col("d1") * F.col("t1") + F.col("d2") * F.col("t2") + F.col("d3") * F.col("t3")) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise(F.coalesce((c - discount) / F.col("total"), F.lit(0.0)) + gamma * F.col("below"))
        lower = common.written(rows.select("lang", "gram", p.alias("p")), f"run-probabilities-{k}")
        common.discard(runs[k], *([below] if k > 1 else []))
    return lower


class _Lookup:
    """Open addressing from 64-bit hashes to numbers, for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 2).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.slots, self.values = np.full(1 << bits, -1, np.int64), values
        left, at = np.arange(len(keys)), self._at(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several keys for a slot one stays
            off = self.slots[at] != left
            left, at = left[off], (at[off] + 1) & self.mask
        self.keys = keys

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (common.mix64(keys) & np.uint64(self.mask)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of known keys; an unknown key is an error of the caller's."""
        at = self._at(keys)
        got = self.slots[at]
        off = np.flatnonzero(self.keys[got] != keys)
        while len(off):
            at[off] = (at[off] + 1) & self.mask
            got[off] = self.slots[at[off]]
            if (got[off] < 0).any():
                raise KeyError("a run without a probability")
            off = off[self.keys[got[off]] != keys[off]]
        return self.values[got]


def _scored(docs: pa.Table, side: pa.Table, pooled: bool) -> pa.Table:
    """Scores of a chunk; `side` has the keys of its trusted documents (no run) and the costs of its runs."""
    marks = side.filter(pa.compute.is_null(side["gram"]))
    model = side.filter(pa.compute.is_valid(side["gram"]))
    rows: list[tuple] = []
    tables: dict[str, _Lookup] = {}
    for cols, texts in _opened(docs, marks["key"].to_numpy(), pooled):
        by: dict[str, list] = {}
        for c, text in zip(cols, texts):
            by.setdefault(c[2], []).append((c, text))
        for part in by.values():
            rows += _sums(part, tables, model)
    kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())
    cols = list(zip(*rows)) or [()] * 9
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "lang", "model", "trusted", "held", "extra", "key", "n_runs", "minus_log"])


def _sums(part: list, tables: dict, model: pa.Table) -> list[tuple]:
    lang = part[0][0][2]
    if lang not in tables:
        own = model.filter(pa.compute.equal(model["lang"], lang))
        codes = np.frombuffer("".join(own["gram"].to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
        tables[lang] = _Lookup(_hashes(codes, np.arange(0, len(codes), ORDER)), own["cost"].to_numpy())
    codes, at, sizes = _runs([t for _, t in part])
    if not len(at):
        return [(*key, 0, 0.0) for key, _ in part]
    cost = np.concatenate([[0.0], np.cumsum(tables[lang].get(_hashes(codes, at)))])
    ends = np.cumsum(sizes)
    total = cost[ends] - cost[ends - sizes]
    return [(*key, int(n), float(s)) for (key, _), n, s in zip(part, sizes, total)]


def perplexities(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chunks: int | None = None) -> DataFrame:
    """id, lang, model, trusted, held, extra, key (text_key of id and text), n_runs (characters) and minus_log (their summed
    costs) for each row; `judged` reads the extra rows and leaves them out.

    `labels` has id and good (1: trusted), nulls ignored; of several labels the lowest counts. Null texts count as
    empty and have no runs, a null language is one of its own, and a language with fewer than MIN_TRUSTED trusted
    texts gets the pooled model. Rows with equal ids or texts are scored one by one, texts of any length whole; an empty
    table gives no rows.
    """
    n = chunks or common.text_chunks(docs, text_col)
    good = labels.where("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good")).where("good = 1").select("id")
    named = _named(docs, id_col, text_col, lang_col).select("id", "lang", "key", (F.col("t") != "").alias("some"))
    marked = common.written(named.join(good.withColumn("trusted", F.lit(True)), "id", "left"), "trusted-rows")
    langs = common.written(marked.groupBy("lang").agg((F.count_if(F.col("trusted") & F.col("some")) >= MIN_TRUSTED).alias("own")), "languages")
    marks = common.written(marked.where("trusted").select(F.pmod("key", F.lit(n)).alias("chunk"), "key").distinct(), "trusted-keys")
    common.discard(marked)
    pooled = not langs.where("not own").isEmpty()
    parts = zipped(docs, langs, n, id_col, text_col, lang_col)
    counts = common.written(parts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(common.trimmed(lambda docs, marks: _chunk_counts(docs, marks, pooled)), "chunk long, lang string, gram string, n long"), "runs")
    common.release(docs.sparkSession)
    known = common.written(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "run-counts")
    common.release(docs.sparkSession)
    seen = known.where("n > 0")
    if not known.where(F.col("lang") == POOL).isEmpty():
        seen = seen.where(F.col("lang") != POOL).unionByName(seen.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(POOL).alias("lang"), "gram", "n"))
    p = probabilities(known, seen)
    common.discard(known)
    model = counts.join(p, ["lang", "gram"]).select("chunk", F.lit(None).cast("long").alias("key"), "lang", "gram", (-F.log("p")).alias("cost"))
    side = model.unionByName(marks, allowMissingColumns=True)
    got = parts.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(common.trimmed(lambda docs, side: _scored(docs, side, pooled)), "id long, lang string, model string, trusted boolean, held boolean, extra boolean, key long, n_runs long, minus_log double")
    scores = common.written(got, "scores")
    common.discard(langs, marks, counts, p)
    return scores


def judged(scores: DataFrame, *, quantile: float = QUANTILE, margin: float = MARGIN, prior: float = PRIOR_CHARS) -> DataFrame:
    """Adds log_perplexity (smoothed), threshold and rejected. Empty texts have the mean score, so they are kept.

    Thresholds are of held-out documents: their quantile where they are enough to have one, else that of a normal
    distribution with their mean and spread, as the highest of a few is often an outlier. In the pooled model a language also has no less than its own held-out mean and the pool's
    spread give. A language without held-out documents has no threshold and nothing is rejected.
    """
    enough, z = 1 / (1 - quantile), NormalDist().inv_cdf(quantile)
    held = scores.where("held and n_runs > 0")
    of_own = (F.col("held")) & (F.col("n_runs") > 0)
    mean = F.sum(F.when(of_own, F.col("minus_log"))) / F.sum(F.when(of_own, F.col("n_runs")))
    langs = common.written(scores.where("not extra").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), mean.alias("mean")), "language-means")
    pooled = held.where(F.col("model") == POOL).agg((F.sum("minus_log") / F.sum("n_runs")).alias("mean_all"))  # one row
    smooth = (F.col("minus_log") + prior * F.coalesce("mean", "mean_all", F.lit(0.0))) / (F.col("n_runs") + prior)

    def smoothed(rows: DataFrame, one: DataFrame) -> DataFrame:
        return common.hot_join(rows, one, ["lang"], "documents").crossJoin(F.broadcast(pooled)).withColumn("log_perplexity", smooth)

    # the pool's documents are smoothed at their own language's mean in the pool
    there = held.where(F.col("model") == POOL)
    there = there.join(there.groupBy("lang").agg((F.sum("minus_log") / F.sum("n_runs")).alias("mean")), "lang")
    there = there.withColumn("log_perplexity", (F.col("minus_log") + prior * F.col("mean")) / (F.col("n_runs") + prior))
    x = F.col("log_perplexity")
    stats = [F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("s"), F.percentile_approx(x, quantile, 10_000).alias("q")]

    def line(n: Column, m: Column, s: Column, q: Column) -> Column:
        return F.when(n >= enough, q).otherwise(m + z * s * F.sqrt(1 + 1 / n))

    own = smoothed(held.where("not extra"), langs).groupBy("lang", "model").agg(*stats)
    pool = there.agg(*[c.alias(f"pool_{k}") for c, k in zip(stats, "nmsq")])  # one row
    shared = line(*(F.col(f"pool_{k}") for k in "nmsq"))
    few = F.greatest(shared, F.col("m") + z * F.greatest("s", "pool_s") * F.sqrt(1 + 1 / F.col("n")))
    own = own.crossJoin(F.broadcast(pool)).select("lang", (F.when(F.col("model") == POOL, few).otherwise(line(*(F.col(k) for k in "nmsq"))) + margin).alias("threshold"))
    every = common.written(langs.join(own, "lang", "left"), "language-thresholds")
    got = smoothed(scores.where("not extra"), every)
    return got.withColumn("rejected", F.coalesce(F.col("log_perplexity") > F.col("threshold"), F.lit(False))).select("id", "key", "lang", "trusted", "held", "n_runs", "log_perplexity", "threshold", "rejected")


def trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang and more) that are not rejected, all columns as they were."""
    out = judged(perplexities(docs, labels)).where("rejected").select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct()
    out = common.written(out, "rejected")
    key = common.text_key(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    return docs.join(out, (key == F.col("_key")) & docs["doc_id"].eqNullSafe(F.col("_id")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: perplexity and verdict for each of `documents`, by a model of those labelled as good."""
    common.tune(spark)
    scores = perplexities(common.load(spark, sf_dir, "documents"), trusted_labels(spark, sf_dir))
    return judged(scores).select(F.col("id").alias("doc_id"), "lang", F.exp("log_perplexity").alias("perplexity"), F.exp("threshold").alias("threshold"), (~F.col("rejected")).alias("kept"))
