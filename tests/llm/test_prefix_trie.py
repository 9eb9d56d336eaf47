"""Operator 13 beside a plain trie."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from feria.llm import prefix_trie


def turn_key(t):
    role, text = t[1] or "", t[2] or ""
    return (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest())


def plain(convs):
    """conv -> list of (role, text); rows of the contract."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    own = {p: (len(m) - 1) * (len(p[-1][1]) if p else 0) for p, m in nodes.items()}
    out = []
    for p, m in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes) for q in below)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children), leaves, sum(own[q] for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    """Shared starts, copies, a turnless start, null and equal turn numbers, null roles and texts, repeated rows, a long one."""
    rng = random.Random(9)
    out = []
    for c in [*range(0, 40), 100, 101, 102, 207, -3]:
        for k in range(rng.randint(1, 5)):
            out.append((c, k, rng.choice(["user", "bot", None]), rng.choice(["hi", "hé", "", None, "long " * 5])))
    out += [(50, None, "user", "first"), (50, 3, "a", "x"), (50, 3, "b", "y"), (50, 3, "a", "x"), (None, 1, "user", "nobody")]
    out += [(60, k, "u", "t") for k in range(70)] + [(61, k, "u", "t") for k in range(65)] + [(61, 70, "u", "end")]
    out += [(c, 0, "user", "hot") for c in range(300, 340)]
    return out


def frame(spark, rows):
    extra = ["conv", "pos", "part", "a", "b", "chars", "n", "depth", "fan"]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({x: F.lit("x") for x in extra}).repartition(3)


def as_turns(rows):
    convs = {}
    for c, *t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], turn_key(r[1:]))):
        convs.setdefault(c, []).append((t[1] or "", t[2] or ""))
    return convs


def got_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_trie(spark, rows, monkeypatch):
    """As it is, and with segments and lists of ids so short that conversations and nodes have several."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", 7)
    monkeypatch.setattr(prefix_trie, "ENDS", 3)
    got = prefix_trie.prefix_trie(frame(spark, rows))
    assert got_of(got.select("conv", "depth", "up_conv", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")) == plain(as_turns(rows))
    assert prefix_trie.prefix_trie(frame(spark, rows).where("false")).count() == 0


def test_query(spark, rows, tmp_path):
    frame(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    convs = as_turns(rows)
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        lender = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = convs.get(lender, [])[:h] + turns[h:]
    assert [] in rebuilt.values() or min(map(len, rebuilt.values())) > 0
    assert got_of(prefix_trie.query(spark, str(tmp_path))) == plain(rebuilt)
