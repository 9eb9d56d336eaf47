"""Operator 13: the prefix trie of conversations, rolled up by pointer jumping.

A node is a distinct sequence of first turns. Its key is a digest of that sequence: the exclusive or of a hash of each
turn with its place, so a prefix's digest follows from its parent's and whole prefixes are never written down. Nodes and
their parent edges come from one aggregation over turns. Sums over subtrees (leaves, savings) are then taken in doubling
rounds: after round k a node holds the sum over its descendants nearer than 2**k and points to its ancestor 2**k above, so
a trie of depth d takes log2(d) rounds of joins, not d.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feria.llm import common

#: Turns of a conversation that are digested in one group; a longer conversation has several.
SEGMENT = 1000
#: Conversations listed in a row, of those that end at one node.
ENDS = 4096
_KEY = ["a", "b"]
_UP = ["up_a", "up_b"]


def positioned(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), digest (of role and text) and chars (code points of the text), a row for each turn.

    Turns go by number, null first; those with equal numbers by the digest of role and text. Null roles and texts count
    as empty; rows without a conversation are left out; repeated rows are turns of their own; an empty table stays empty;
    other columns are not read. Turns are dealt by ranges of conversation and turn, so that one conversation may be of
    any length, and each range gets the number of turns before it. Returns a written step.
    """
    spark = rows.sparkSession
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    own = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("digest"), F.col("row")]
    own = own.where("conv is not null").repartitionByRange(common.shuffle_parts(spark), *order).sortWithinPartitions(*order)
    own = common.written(own.select("conv", "digest", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "turns")
    runs = own.groupBy("conv", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv", "part", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))  # a row for each conversation and range
    got = common.written(own.join(runs, ["conv", "part"]).select("conv", (F.col("place") + F.col("shift")).alias("pos"), "digest", "chars"), "places")
    common.discard(own)
    return got


def _digested(turns: DataFrame) -> DataFrame:
    """Adds each turn's node (a, b) and its parent (up_a, up_b); the root is (0, 0)."""
    rows = turns.withColumns({"x": F.xxhash64(F.lit(1), "pos", "digest"), "y": F.xxhash64(F.lit(2), "pos", "digest"), "segment": F.floor((F.col("pos") - 1) / SEGMENT)})
    so_far = Window.partitionBy("conv", "segment").orderBy("pos")
    rows = rows.withColumns({"a": F.bit_xor("x").over(so_far), "b": F.bit_xor("y").over(so_far)})
    whole = turns.where(F.col("pos") > SEGMENT).select("conv").distinct()
    totals = rows.join(whole, "conv", "left_semi").groupBy("conv", "segment").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = Window.partitionBy("conv").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "segment", F.bit_xor("x").over(earlier).alias("before_a"), F.bit_xor("y").over(earlier).alias("before_b"))
    rows = rows.join(totals, ["conv", "segment"], "left")
    rows = rows.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0).cast("long"))) for c in _KEY})
    return rows.select("conv", "pos", "chars", *_KEY, F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b"))


def _ends(members: DataFrame) -> DataFrame:
    """a, b and ends_sha256 from members (a, b, conv): the digest of a node's ids in numeric order, joined by commas.

    Ids are sorted by ranges of node and id and listed ENDS to a row; a node's lists then meet in one task in order, which
    holds one of them at a time: the bytes of a SHA-256 follow each other.
    """
    parts = common.shuffle_parts(members.sparkSession)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, own = None, 0, []
        for batch in batches:
            out: list[tuple] = []
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at or len(own) >= ENDS:
                    if own:
                        out.append((*at, first, ",".join(own)))
                    at, first, own = key, conv, []
                own.append(str(conv))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["a", "b", "first", "ids"])
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, first, ",".join(own))], names=["a", "b", "first", "ids"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for batch in batches:
            out: list[tuple] = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key == at:
                    h.update(b"," + ids.encode())
                    continue
                if at:
                    out.append((*at, h.hexdigest()))
                at, h = key, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["a", "b", "ends_sha256"])
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, h.hexdigest())], names=["a", "b", "ends_sha256"])

    ranged = members.select(*_KEY, "conv").repartitionByRange(parts, *_KEY, "conv").sortWithinPartitions(*_KEY, "conv")
    listed = ranged.mapInArrow(common.trimmed(lists), "a long, b long, first long, ids string")
    return listed.repartition(parts, *_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(common.trimmed(folded), "a long, b long, ends_sha256 string")


def _matches(x: str, y: str = "") -> Column:
    return F.expr(" and ".join(f"{x}{p} <=> {y}{q}" for p, q in zip(_KEY, _UP)))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node: a and b (its key), conv (its least member), depth, up_conv (the parent's, null for the root),
    n_convs, n_children, n_leaves, saved (over its subtree, members but one times characters of a node's text) and
    ends_sha256.

    `turns` has conv, pos, digest and chars, as `positioned` gives them, `convs` all conversations (conv), those without
    turns too, which are members of the root only. Nodes are told apart by 128 bits of digest. Without conversations there
    is no node. Hot nodes (a first turn that a third of all share) are combined before the shuffle, and their children
    find them by a broadcast of hot keys.
    """
    spark = turns.sparkSession
    common.tune(spark)
    rows = common.written(_digested(turns), "digests")
    zero = F.lit(0).cast("long")
    root = convs.groupBy().agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("up_a"), F.lit(None).cast("long").alias("up_b"), zero.alias("depth"), "conv", "n_convs", zero.alias("chars"))
    nodes = rows.groupBy(*_KEY).agg(*[F.first(c).alias(c) for c in _UP], F.first("pos").alias("depth"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.first("chars").alias("chars"))
    nodes = common.written(nodes.unionByName(root), "nodes")
    last = rows.groupBy("conv").agg(F.max("pos").alias("pos"))
    ended = rows.join(last, ["conv", "pos"], "left_semi").select(*_KEY, "conv")
    turnless = convs.join(last, "conv", "left_anti").select(zero.alias("a"), zero.alias("b"), "conv")
    ends = common.written(_ends(ended.unionByName(turnless)), "ends")
    children = nodes.where("up_a is not null").groupBy(*[F.col(u).alias(k) for u, k in zip(_UP, _KEY)]).agg(F.count(F.lit(1)).alias("n_children"))
    state = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    state = common.written(state.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars"), "up_conv": F.lit(None).cast("long")}), "round")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    common.discard(rows, nodes)
    for k in range(int(deepest).bit_length()):
        # what the nodes 2**k below have, a row for each node that is pointed to, beside where that node points itself
        below = state.where("up_a is not null").groupBy(*_UP).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("fan"))
        below = below.select(*[F.col(u).alias(x) for u, x in zip(_UP, _KEY)], "more_leaves", "more_saved", "fan")
        summed = state.join(below, _KEY, "left")
        summed = summed.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", zero), "saved": F.col("saved") + F.coalesce("more_saved", zero)}).drop("more_leaves", "more_saved")
        summed = common.written(summed, "summed")
        over = summed.where("fan is not null").select(*[F.col(x).alias(u) for x, u in zip(_KEY, _UP)], *[F.col(u).alias(f"next_{u}") for u in _UP], F.col("conv").alias("over_conv"), "fan")
        climbing = summed.where("up_a is not null").drop("fan")
        jumped = common.hot_join(climbing, over, _UP, "fan").drop("fan")
        if k == 0:
            jumped = jumped.withColumn("up_conv", F.col("over_conv"))
        jumped = jumped.withColumns({u: F.col(f"next_{u}") for u in _UP}).select(*state.columns)
        done = summed.where("up_a is null").select(*state.columns)
        step = common.written(jumped.unionByName(done), "round")
        common.discard(summed, state)
        state = step
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return state.join(ends, _KEY, "left").select(*_KEY, "conv", "depth", "up_conv", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def prefix_trie(rows: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations as they are; see `positioned` for columns and odd tables and `trie` for the result."""
    turns = positioned(rows, **columns)
    return trie(turns, turns.select("conv").distinct())


#: The query's rebuilt conversations: the block whose first one lends its turns, and the most turns that it lends.
BLOCK, MOST = 100, 5


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations in which each conversation begins with the first h turns of its block's first one in place of
    its own; h is a hash of the id, up to MOST."""
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    h = lambda c: F.crc32(F.encode(F.col(c).cast("string"), "utf-8")) % (MOST + 1)
    convs = common.written(convs.select("conv", "n", (F.col("conv") - F.col("conv") % BLOCK).alias("lender"), h("conv").alias("h")), "conversations")
    lent = turns.where((F.col("conv") % BLOCK == 0) & (F.col("pos") <= MOST)).withColumnRenamed("conv", "lender")
    have = convs.select(F.col("conv").alias("lender"), F.least("n", F.lit(MOST)).alias("has"))
    moved = convs.join(have, "lender", "left").select("conv", "n", "h", (F.col("h") - F.least("h", F.coalesce("has", F.lit(0)))).alias("lacks"))
    own = common.hot_join(turns, moved, ["conv"], "n").where(F.col("pos") > F.col("h")).withColumn("pos", F.col("pos") - F.col("lacks"))
    got = convs.join(lent, "lender").where(F.col("pos") <= F.col("h")).select("conv", "pos", "digest", "chars")
    return common.written(got.unionByName(own.select("conv", "pos", "digest", "chars")), "rebuilt"), convs.select("conv")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the trie of rebuilt `conversations`."""
    turns, convs = rebuilt(positioned(common.load(spark, sf_dir, "conversations")))
    got = trie(turns, convs)
    return got.select(F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


#: The same, with each prefix as a list of its turns; the unsigned crc32 is folded over bytes and bits.
ORACLE = """
WITH ordered AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295) % 6 AS h
  FROM ordered),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM hashed a LEFT JOIN ordered b ON b.conv_id = a.conv_id - a.conv_id % 100),
members AS (SELECT conv_id, turns AS whole, unnest(range(len(turns) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT whole[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(whole) = depth), '')) AS ends_sha256
  FROM members GROUP BY ALL),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
valued AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.path[n.depth].text) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN children c ON c.path = n.path),
raised AS (SELECT path AS own, saved, n_children, unnest(range(depth + 1)) AS d FROM valued),
summed AS (SELECT own[1:d] AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM raised GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM valued v JOIN summed s ON s.path = v.path LEFT JOIN valued p ON v.depth > 0 AND p.path = v.path[1:v.depth - 1]
"""
