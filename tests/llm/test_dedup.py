"""Operators 1, 2 and 10 beside brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from feria.llm import common, fm_index, near_dedup, probminhash, stream_dedup, substring_dedup


def lower_az(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact(docs, rows, none):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower_az(t)].append(i)
    got = stream_dedup.dedup(docs, carry=["doc_id", "row"], files_per_batch=1).collect()
    assert len(got) == len(rows)
    for r in got:
        own = groups[lower_az(r.text)]
        assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)
    kept = Counter(lower_az(r.text) for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert stream_dedup.dedup(none).count() == 0


def test_exact_with_colliding_digests(docs, rows):
    """A digest of a few values: contents are compared in full and grouped by themselves."""
    got = stream_dedup.dedup(docs, digest=lambda b: bytes([len(b) % 3])).collect()
    want = Counter(lower_az(t) for _, t, *_ in rows)
    assert all(r.group_size == want[lower_az(r.text)] for r in got)
    assert sum(r.kept for r in got) == len(want)


def test_exact_over_calls(spark):
    """A second call meets the state and contents of the first, also where digests collide."""
    home = common.shared_dir(spark, "state")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda b: bytes([len(b)])
    first = {r.id: r for r in stream_dedup.dedup(frame([(1, "a"), (2, "A"), (3, "bb")]), home=home, digest=weak).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in first.items()} == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}
    second = {r.id: r for r in stream_dedup.dedup(frame([(0, "a"), (9, "BB"), (7, "cc"), (8, None)]), home=home, digest=weak).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in second.items()} == {0: (2, 3, False), 9: (9, 2, True), 7: (7, 1, True), 8: (8, 1, True)}


def test_exact_keeps_rows_whole(docs, rows):
    got = stream_dedup.distinct(docs)
    assert got.columns == docs.columns and got.count() == len({lower_az(t) for _, t, *_ in rows})
    assert {(r.doc_id, r.text) for r in got.collect()} <= {r[:2] for r in rows}


def shingles(t):
    w = (t or "").lower().encode().split()
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def likeness(x, y):
    every = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in x if i in y)


def near_classes(rows):
    s = [shingles(t) for _, t, *_ in rows]
    top = list(range(len(s)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if (not s[a] and not s[b]) or (s[a] and s[b] and likeness(s[a], s[b]) >= 0.8):
                top[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for k in range(len(s)):
        groups[find(k)].append(rows[k][0])
    return sorted(sorted(g, key=str) for g in groups.values())


def test_near(docs, rows, none):
    got = near_dedup.classes(docs).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.class_row].append(r.id)
    assert sorted(sorted(g, key=str) for g in groups.values()) == near_classes(rows)
    assert all(r.class_size == len(groups[r.class_row]) for r in got)
    assert near_dedup.classes(none).count() == 0
    one = near_dedup.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len(groups)


def test_star_of_near_copies(spark):
    """A base and copies that are like the base but hardly like each other: one class, through the base."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(200)]
    out = [(0, " ".join(base))]
    for k in range(1, 80):
        w = list(base)
        for j in rng.choice(200, 4, replace=False):
            w[j] = f"n{k}_{j}"
        out.append((k, " ".join(w)))
    df = spark.createDataFrame([(99 - i, t) for i, t in out], "doc_id long, text string")
    assert {r.class_id for r in near_dedup.classes(df).collect()} == {20}


def test_signature_agreement():
    """Registers agree as often as the exact weighted likeness says."""
    a, b = Counter({i: 1 + i % 3 for i in range(300)}), Counter({i: 1 + (i + i // 100) % 3 for i in range(60, 380)})
    h = np.array([*a, *b], np.uint64)
    row = np.array([0] * len(a) + [1] * len(b))
    w = np.array([*a.values(), *b.values()])
    from feria.llm.common import mix64

    kept = probminhash.signatures(mix64(h), row, w, 2, 4096)
    assert abs((kept[0] == kept[1]).mean() - likeness(a, b)) < 0.03
    exact = probminhash.likeness(np.sort(np.array(list(a), np.uint64)), np.array(list(a.values())), np.sort(np.array(list(b), np.uint64)), np.array(list(b.values())))
    assert abs(exact - likeness(a, b)) < 1e-9


def removed(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (i, *_), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"width": 8, "gram": 3}, {"width": 8, "gram": 3, "hot": 1}, {"width": 12, "gram": 5, "index_words": 200}])
def test_substrings(docs, rows, options):
    got = substring_dedup.remove_repeats(docs, **options).collect()
    assert sorted((str(r.id), r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == removed(rows, options.get("width", 35))
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_anchors_in_long_texts():
    """Anchors of a passage are the same wherever it stands, also beyond 2**22 words and with small gram hashes."""
    rng = np.random.default_rng(12)
    passage = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    text = np.concatenate([passage, np.arange((1 << 22) + 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), passage])
    row, place, size, anchor, content = substring_dedup._segments(text, np.array([0, len(text)]), 35, 6)
    lone = substring_dedup._segments(passage, np.array([0, 300]), 35, 6)
    inner = set(zip(lone[3].tolist()[1:-1], lone[4].tolist()[1:-1]))  # segments whose bounds lie in the passage
    late = set(zip(anchor[place > 1 << 22].tolist(), content[place > 1 << 22].tolist()))
    early = set(zip(anchor[place < 300].tolist(), content[place < 300].tolist()))
    assert inner and inner <= late and inner <= early
    grams = substring_dedup.common.span_hashes(passage, np.arange(295), np.arange(6, 301))
    for a, n, p in zip(lone[3].tolist(), lone[2].tolist(), lone[1].tolist()):
        assert all(a == int(grams[k : k + 30].min()) for k in range(p, p + n))


def test_substrings_of_nothing(none):
    assert substring_dedup.remove_repeats(none).count() == 0


def test_backward_search_counts():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 400)
    text[::50] = 0
    index = fm_index.FMIndex(text, 5)
    for _ in range(100):
        a, n = rng.integers(0, 380), rng.integers(1, 12)
        p = text[a : a + n]
        if (p == 0).any():
            continue
        lo, hi = index.single(p[-1:])
        for c in p[-2::-1]:
            lo, hi = index.extend(lo, hi, np.array([c]))
        assert hi[0] - lo[0] == sum((text[i : i + n] == p).all() for i in range(len(text) - n + 1))


def test_texts_are_sent_once_for_all_segments(docs, monkeypatch):
    """Windows of hot anchors come from the coded segments: the texts meet their segments once, and their spans once."""
    read, write = [], common.written

    def counted(df, name):
        read.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("z#") > 0))
        return write(df, name)

    monkeypatch.setattr(common, "written", counted)
    substring_dedup.remove_repeats(docs, hot=2).count()
    names = [name for name, _ in read]
    assert "hot-windows" in names  # the hot way is taken
    assert [name for name, texts in read if texts and name not in ("texts", "segments")] == ["coded-segments"]
