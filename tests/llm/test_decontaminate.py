"""Operator 12 beside a plain scan."""

import random
import re

import pytest

from feria.llm import decontaminate


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [(m[0], m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)]


def plain(doc, bench, n=10):
    """Hit words of a text, and the items found."""
    own, hit, items = [w for w, _ in words(doc)], set(), set()
    for ident, text in bench:
        w = [x for x, _ in words(text)]
        size = min(n, len(w))
        known = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(own) - size + 1 if size else 0):
            if tuple(own[i : i + size]) in known:
                hit |= set(range(i, i + size))
                items.add("" if ident is None else str(ident))
    return len(own), hit, sorted(items)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["ab", "cd", "éf", "ß", "12", "x9", "Gh"]) for _ in range(n))
    long = prose(25)
    bench = [(1, prose(14)), (2, long), (3, "Só few"), (4, ""), (5, None), (6, "..., !"), (12, long), (None, prose(11)), (2, prose(12)), (7, "x" * 70000 + " y"), (2, long)]
    texts = [t for _, t in bench] + [None, "", prose(40), long.upper().replace(" ", " -- "), "a" + long + "b", long + " " + long, " ".join(long.split()[3:14]), prose(5000) + " SÓ, few? " + bench[0][1], "sÓ few SÓ\nFew", "xyz " * 8 + bench[7][1]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (3, texts[3]), (1, texts[1])]
    extra = ["row", "id", "key", "t", "item", "hash", "runs", "shard", "n_words"]
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} long, text string").withColumns({x: F.lit("x") for x in extra}).repartition(3)
    return docs, bench, frame(docs, "doc_id"), frame(bench, "item_id")


@pytest.mark.parametrize("shard_bytes", [decontaminate.SHARD_BYTES, 700])
def test_report(tables, shard_bytes):
    """One broadcast shard, and many."""
    docs, bench, left, right = tables
    got = decontaminate.report(left, right, shard_bytes=shard_bytes, keep_text=True).collect()
    assert len(got) == len(docs)
    key = lambda r: (str(r[0]), r[1] or "")
    for r, (i, t) in zip(sorted(got, key=lambda r: key((r.id, r.text))), sorted(docs, key=key), strict=True):
        n, hit, items = plain(t, bench)
        assert (r.id, r.n_words, r.n_hit, r["items"]) == (i, n, len(hit), items)
        assert {k for x in r.runs for k in range(x.begin, x.end)} == hit


def test_removal(tables, spark):
    docs, bench, left, right = tables
    got = sorted((str(r.id), r.text, r.n_hit) for r in decontaminate.without_spans(left, right).collect())
    want = []
    for i, t in docs:
        _, hit, _ = plain(t, bench)
        at, out, done = [s for _, s in words(t)], "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                out += t[done : at[k][0]]
            done = at[k][1]
        want.append((str(i), out + (t or "")[done:], len(hit)))
    assert got == sorted(want)
    left_over = decontaminate.without_documents(left, right)
    assert left_over.columns == left.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left_over.collect()) == sorted((str(i), t or "") for i, t in docs if not plain(t, bench)[1])
    assert decontaminate.without_documents(left, right, most=1.0).count() == len(docs)
    assert decontaminate.report(left.where("false"), right).count() == 0
    assert {r.n_hit for r in decontaminate.report(left, right.where("false")).collect()} == {0}
