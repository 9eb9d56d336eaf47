"""Operator 11: spelling variants grouped by tries and Levenshtein automata.

Words are counted over all texts. The vocabulary is sorted into shards of bounded size, each a compact trie that is
broadcast by itself; every word's automaton of distance one is intersected with every shard's trie, depth first, and the
accepted words are its neighbours. What shards find for a word is summed, and its form is the most frequent neighbour.
Forms are followed to their roots by pointer jumping.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feria.llm import common

#: Code points of the words of a shard: what a broadcast trie can have nodes.
SHARD_CHARS = 4_000_000
#: Words of so many code points or more are not in the tries; they meet by hashes of their deletions.
LONG = 256
#: Words in a block that goes through a trie at once, and different words that a task counts before it hands them on.
BLOCK, COUNTED = 2048, 300_000
LETTERS = "a-zÀ-ÿ"
_LABEL = 21  # bits of a code point in a trie's edge


def word_counts(docs: DataFrame, *, least_chars: int = 5, least: int = 3, letters: str = LETTERS, thin: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: runs of letters, A-Z lower-cased, with at least so many code points and occurrences.

    With `thin` one occurrence in so many, by the checksum of `id:run`, lacks the code point at checksum modulo length, as
    a slip would have it. Null texts have no words; a null id counts as empty; repeated rows count again; texts are read
    whole; an empty table gives no words; other columns are not read. A task hands its counts on whenever it holds COUNTED
    different words, so that nothing grows with a partition.
    """
    runs = re.compile(f"[{letters}]{{{least_chars},}}")
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return got

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = runs.findall(t.encode().lower().decode())
                held.update(own)
                if thin:
                    start = zlib.crc32(f"{i}:".encode())
                    for word in set(own):
                        h = zlib.crc32(word.encode(), start)
                        if h % thin == 0:
                            at, n = h % len(word), own.count(word)
                            held[word] -= n
                            if len(word) > least_chars:
                                held[word[:at] + word[at + 1 :]] += n
                if len(held) > COUNTED:
                    yield out()
        yield out()

    counts = rows.mapInArrow(common.trimmed(run), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


@dataclass
class Trie:
    """Sorted words as nodes in breadth-first order. Node k + 1 hangs on edge k, a number of its parent and label, so edges
    are sorted and a child is found by bisection. `first` has each node's first edge, `word` the word that ends there."""

    edges: np.ndarray
    first: np.ndarray
    word: np.ndarray
    counts: np.ndarray
    text: bytes
    at: np.ndarray

    @classmethod
    def of(cls, words: list[str], counts: np.ndarray) -> Trie:
        """From different words in code-point order."""
        codes, start = coded(words)
        size = np.diff(start)
        node, edges, ends, made = np.zeros(len(words), np.int64), [], [np.full(1, -1)], 1
        for depth in range(int(size.max(initial=0))):
            alive = np.flatnonzero(size > depth)
            key = node[alive] << _LABEL | codes[start[alive] + depth]
            new = np.append(True, key[1:] != key[:-1])
            node[alive] = made - 1 + np.cumsum(new)
            edges.append(key[new])
            ended = np.full(int(new.sum()), -1)
            last = alive[size[alive] == depth + 1]
            ended[node[last] - made] = last
            ends.append(ended)
            made += len(ended)
        keys = np.concatenate(edges) if edges else np.empty(0, np.int64)
        raw = [w.encode() for w in words]
        at = np.cumsum([0, *map(len, raw)])
        return cls(keys, np.searchsorted(keys, np.arange(made + 1) << _LABEL).astype(np.int32), np.concatenate(ends).astype(np.int32), counts, b"".join(raw), at)

    def get(self, k: int) -> str:
        return self.text[self.at[k] : self.at[k + 1]].decode()

    def near(self, codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word (its place among those given) and a word of the trie that is one edit away, each pair once.

        Along a word's own path through the trie every node's children are tried as an inserted or replaced letter and the
        next letter as a deleted one; each such state then has to read the rest of the word. Of equal letters side by side
        only the first is deleted, and a letter is only inserted before its equals.
        """
        size = np.diff(start)
        who, at = np.arange(len(size)), np.zeros(len(size), np.int64)  # words still on their path, and their nodes
        found: list[tuple[np.ndarray, np.ndarray]] = []
        pos = 0
        while len(who):
            inside = size[who] > pos
            here = np.where(inside, codes[np.minimum(start[who] + pos, len(codes) - 1)], 0)
            before = codes[start[who] + pos - 1] if pos else np.full(len(who), -1)
            lo, n = self.first[at], self.first[at + 1] - self.first[at]
            ends = np.cumsum(n)
            edge = np.repeat(lo - (ends - n), n) + np.arange(ends[-1])
            label, src = self.edges[edge] & ((1 << _LABEL) - 1), np.repeat(np.arange(len(who)), n)
            put = label != before[src]
            swap = inside[src] & (label != here[src])
            cut = inside & (here != before)
            w = np.concatenate([who[src[put]], who[src[swap]], who[cut]])
            node = np.concatenate([edge[put] + 1, edge[swap] + 1, at[cut]])
            rest = np.concatenate([np.full(int(put.sum()), pos), np.full(int(swap.sum() + cut.sum()), pos + 1)])
            while len(w):
                over = rest == size[w]
                hit = over & (self.word[node] >= 0)
                found.append((w[hit], self.word[node[hit]]))
                w, node, rest = w[~over], node[~over], rest[~over]
                child, has = self.child(node, codes[start[w] + rest])
                w, node, rest = w[has], child[has], rest[has] + 1
            who, at, here = who[inside], at[inside], here[inside]
            at, has = self.child(at, here)
            who, at = who[has], at[has]
            pos += 1
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def child(self, node: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The child of each node by a label, and whether there is one."""
        key = node << _LABEL | label
        k = np.searchsorted(self.edges, key)
        return k + 1, self.edges[np.minimum(k, len(self.edges) - 1)] == key if len(self.edges) else np.zeros(len(k), bool)


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and each word's start, with the end after the last."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    return codes, np.cumsum([0, *map(len, words)])


_FOUND = "word string, n_near long, form string, form_n long"


def _searched(words: DataFrame, tries: DataFrame, shard: int, long: int) -> DataFrame:
    """What one shard has for each word: n_near, and the best neighbour (form, form_n)."""
    spark = words.sparkSession
    row = tries.where(F.col("shard") == shard).first()
    sent = spark.sparkContext.broadcast({c: bytes(row[c]) if c == "text" else np.frombuffer(row[c], kind) for c, kind in _ARRAYS.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = None
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                trie = trie or Trie(**sent.value)
                own = batch.column(0).slice(low, BLOCK).to_pylist()
                w, k = trie.near(*coded(own))
                if not len(w):
                    continue
                n = trie.counts[k]
                order = np.lexsort((k, -n, w))
                w, k, n = w[order], k[order], n[order]
                head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                many = np.diff(np.append(head, len(w)))
                yield pa.RecordBatch.from_arrays([pa.array([own[x] for x in w[head].tolist()], pa.string()), pa.array(many, pa.int64()), pa.array([trie.get(x) for x in k[head].tolist()], pa.string()), pa.array(n[head], pa.int64())], names=["word", "n_near", "form", "form_n"])

    got = common.written(words.where(F.length("word") <= long).select("word").mapInArrow(common.trimmed(run), _FOUND), "near")
    sent.destroy()
    return got


_ARRAYS = {"edges": np.int64, "first": np.int32, "word": np.int32, "counts": np.int64, "text": bytes, "at": np.int64}


def _sharded(words: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The words (word, n, part) with their shards, and the number of shards; none has over `most` code points.

    Neighbouring ranges share a shard as long as they fit; should a range be larger, all are cut by a hash too.
    """
    spark, cut = words.sparkSession, 1
    while True:
        cell = words.withColumn("cell", F.pmod(F.xxhash64("word"), F.lit(cut)))
        sizes = cell.groupBy("part", "cell").agg(F.sum(F.length("word")).alias("chars")).orderBy("part", "cell").collect()  # a row for each range
        if all(r.chars <= most for r in sizes):
            break
        cut *= 2
    shard, filled, rows = -1, most, []
    for r in sizes:
        if filled + r.chars > most:
            shard, filled = shard + 1, 0
        filled += r.chars
        rows.append((r.part, r.cell, shard))
    places = spark.createDataFrame(rows, "part int, cell long, shard int")
    return cell.join(F.broadcast(places), ["part", "cell"]).select("shard", "word", "n"), shard + 1


def _tries(words: DataFrame) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")  # by bytes of UTF-8, which is the order of code points
        trie = Trie.of(table["word"].to_pylist(), table["n"].to_numpy())
        return pa.table({"shard": table["shard"].slice(0, 1), **{c: pa.array([getattr(trie, c) if c == "text" else getattr(trie, c).astype(kind).tobytes()], pa.binary()) for c, kind in _ARRAYS.items()}})

    return words.groupBy("shard").applyInArrow(build, "shard int, " + ", ".join(f"{c} binary" for c in _ARRAYS))


def _long_pairs(words: DataFrame, long: int) -> DataFrame:
    """word and near of pairs of which one has over `long` code points: two words that are equal without a code point at
    the same place, or one that is the other without one. A word has as many deletions as code points, so rows grow with
    the text of such words, and a key can be shared by few words: those that differ in one letter of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
                n = len(codes)
                cut = np.arange(n)
                up, _ = common.powers(n + 1)
                keys = []
                for salt in (1, 1 << 32):
                    values = common.mix64(codes + np.uint64(salt))
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:n])])
                    moved = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[1:] * up[: n - 1])])  # one place to the left
                    keys.append(np.append(sums[cut] + (moved[n - 1] - moved[cut]), sums[n]).view(np.int64))
                place = np.append(cut, -1)  # -1: the whole word
                for low in range(0, n + 1, 4096):
                    part = slice(low, low + 4096)
                    many = len(place[part])
                    yield pa.RecordBatch.from_arrays([pa.array([ident] * many), pa.array(np.full(many, n), pa.int64()), pa.array(place[part], pa.int64()), *(pa.array(k[part]) for k in keys)], names=["id", "size", "place", "x", "y"])

    own = words.where(F.length("word") >= long).select(F.sha2("word", 256).alias("id"), "word")
    hashed = own.mapInArrow(common.trimmed(run), "id string, size long, place long, x long, y long")
    other = hashed.select(F.col("id").alias("near_id"), F.col("size").alias("near_size"), F.col("place").alias("near_place"), "x", "y")
    met = hashed.join(other, ["x", "y"]).where("id != near_id and greatest(size, near_size) > " + str(long))
    met = met.where("(place >= 0 and near_place = place and size = near_size) or (place = -1 and near_place >= 0 and near_size = size + 1) or (place >= 0 and near_place = -1 and size = near_size + 1)")
    pairs = met.select("id", "near_id").distinct()
    return pairs.join(own, "id").join(own.select(F.col("id").alias("near_id"), F.col("word").alias("near")), "near_id").select("word", "near")


def neighbours(words: DataFrame, *, shard_chars: int = SHARD_CHARS, long: int = LONG) -> DataFrame:
    """word, n, n_near, form and form_n for each of `words` (word: different, not null, and n): the number of words that
    differ by exactly one inserted, deleted or replaced code point, and the one of largest n (of equal ones the first in
    code-point order); without neighbours 0 and nulls. An empty table stays empty. Returns a written step."""
    spark = words.sparkSession
    spread = words.select("word", "n").repartitionByRange(common.shuffle_parts(spark), "word").sortWithinPartitions("word")
    words = common.written(spread.withColumn("part", F.spark_partition_id()), "vocabulary")
    placed, shards = _sharded(words.where(F.length("word") <= long), shard_chars)
    tries = common.written(_tries(placed), "tries")
    found = [_searched(words, tries, k, long) for k in range(shards)]
    lone = words.groupBy().agg(F.max(F.length("word")).alias("m")).first()["m"] or 0
    every = spark.createDataFrame([], _FOUND)
    for f in found:
        every = every.unionByName(f)
    if lone > long:
        counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
        far = _long_pairs(words, long).join(counts, "near")
        every = every.unionByName(far.select("word", F.lit(1).cast("long").alias("n_near"), F.col("near").alias("form"), F.col("near_n").alias("form_n")))
    best = every.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("b"))
    got = words.select("word", "n").join(best, "word", "left")
    got = common.written(got.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("b.form").alias("form"), (-F.col("b.m")).alias("form_n")), "neighbours")
    common.discard(words, tries, *found)
    return got


def grouped(words: DataFrame, *, times: int = 2, **how: int) -> DataFrame:
    """word, form, root, n, n_near and form_n: `neighbours` with a form only if it has at least `times` the word's n, and
    root, what forms lead to in the end (the word itself without a form). A form's n at least doubles, so there are no
    cycles and few rounds; words that share a hot root find it by a broadcast of hot keys."""
    near = neighbours(words, **how)
    good = F.col("form_n") >= times * F.col("n")
    rows = near.select("word", "n", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    links = common.written(rows.where("form is not null").select("word", F.col("form").alias("to")), "links")
    while True:
        fan = links.groupBy("to").agg(F.count(F.lit(1)).alias("fan"))
        over = common.written(fan.join(links.select(F.col("word").alias("to"), F.col("to").alias("next")), "to", "left").withColumn("next", F.coalesce("next", "to")), "targets")
        if over.where("next != to").isEmpty():
            common.discard(over)
            break
        step = common.written(common.hot_join(links, over, ["to"], "fan").select("word", F.col("next").alias("to")), "links")
        common.discard(links, over)
        links = step
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the words of all `documents`, of which one occurrence in 97 has a slip, and their forms."""
    common.tune(spark)
    return grouped(word_counts(common.load(spark, sf_dir, "documents"), thin=97))


#: The same over deletions of every word; the unsigned crc32 is folded over bytes by its table, which is made from its bits.
ORACLE = """
WITH RECURSIVE bits AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(256) t(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents WHERE text IS NOT NULL),
told AS (SELECT w, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs WHERE length(w) >= 5 GROUP BY doc_id, w),
hashed AS (
  SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda s, b: xor(tab[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) AS h
  FROM told, bits),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, c FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word)))::INTEGER AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON b.d = a.d AND b.i = a.i AND b.word <> a.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON b.word = a.d UNION SELECT b.word, a.word FROM cut a JOIN words b ON b.word = a.d),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -n, other := other)) AS b FROM near JOIN (SELECT word AS other, n FROM words) USING (other) GROUP BY word),
formed AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * n THEN b.other END AS form, CASE WHEN -b.m >= 2 * n THEN -b.m END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM formed UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk ON walk.word = f.word WHERE walk.at IN (SELECT word FROM formed WHERE form IS NULL)
"""
