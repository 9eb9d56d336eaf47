"""Operator 11 beside brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from feria.llm import spelling


def edits(w, letters):
    for i in range(len(w) + 1):
        for c in letters:
            yield w[:i] + c + w[i:]
    for i in range(len(w)):
        yield w[:i] + w[i + 1 :]
        for c in letters:
            yield w[:i] + c + w[i + 1 :]


def plain(counts, times=2):
    letters = sorted(set("".join(counts)))
    out = {}
    for w, n in counts.items():
        near = {v for v in edits(w, letters) if v in counts and v != w}
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        good = best is not None and counts[best] >= times * n
        out[w] = [w, best if good else None, w, n, len(near), counts[best] if good else None]
    for row in out.values():
        while out[row[2]][1]:
            row[2] = out[row[2]][1]
    return sorted(map(tuple, out.values()), key=str)


def counted(rows, thin=None, least_chars=5, least=3):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if thin and h % thin == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least}


@pytest.fixture(scope="module")
def vocabulary():
    """Dense words, so that most have neighbours; runs of equal letters, accents, ties, and words beyond the tries."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))): rng.choice([3, 3, 4, 7, 20, 90]) for _ in range(900)}
    words |= {"aaaaa": 5, "aaaaaa": 5, "aaaa": 11, "ÿz": 3, "zÿ": 3, "zz": 3, "×a÷": 9}
    long = "".join(rng.choice("ab") for _ in range(300))
    words |= {long: 50, long[:100] + long[101:]: 7, long[:-1]: 7, "c" + long[1:]: 3, long + "a": 50, long[:256]: 8, long[:255]: 9, long[:257]: 3, long[:254] + "c" + long[255:]: 3}
    return words


def got_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_chars,long", [(4_000_000, 256), (300, 256), (300, 5)])
def test_forms(spark, vocabulary, shard_chars, long):
    """One shard, many small shards, and nearly all words by their deletions, give what all edits give."""
    df = spark.createDataFrame([(w, n, "x") for w, n in vocabulary.items()], "word string, n long, shard string").repartition(3)
    got = got_of(spelling.grouped(df, shard_chars=shard_chars, long=long).select("word", "form", "root", "n", "n_near", "form_n"))
    assert got == plain(vocabulary)


def test_counts(spark, docs, rows, none, monkeypatch):
    want = counted([(i, t) for i, t, *_ in rows], thin=7, least_chars=2, least=2)
    assert {r.word: r.n for r in spelling.word_counts(docs, thin=7, least_chars=2, least=2).collect()} == want
    assert spelling.grouped(spelling.word_counts(none)).count() == 0
    texts = ["Grüße GRÜSSE größer× ÷größer", None, "", "größer×" * 3, "a" * 100_000 + " " + "A" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(df, least=2).collect()} == counted([*enumerate(texts), (None, texts[0])], least=2)


def test_query(spark, tmp_path):
    rng = random.Random(8)
    base = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(4, 7))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(base).title() for _ in range(rng.randint(0, 300)))) for i in range(200)] + [(200, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = got_of(spelling.query(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n"))
    want = plain(counted(rows, thin=97))
    assert got == want and sum(r[1] is not None for r in want) > 5
