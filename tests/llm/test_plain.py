"""Operators beside plain Python versions of their methods."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from feria.llm import common, quality, url_filter, winnow


class KneserNey:
    """Interpolated modified Kneser-Ney over characters, written down as in its definition."""

    def __init__(self, texts):
        n = quality.ORDER
        pad = quality.START * (n - 1)
        self.c = {n: Counter((pad + t)[i : i + n] for t in texts for i in range(len(t)))}
        for k in range(n - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.floor = 1 / (len(self.c[1]) + 1) if self.c[1] else 1e-3
        self.d, self.by_context = {}, {}
        for k, counts in self.c.items():
            many = Counter(counts.values())
            y = many[1] / (many[1] + 2 * many[2]) if many[1] + 2 * many[2] else 0.5
            self.d[k] = [min(max(i - (i + 1) * y * many[i + 1] / many[i] if many[i] else 0.5 * i, 0.05), i - 0.05) for i in (1, 2, 3)]
            groups = defaultdict(list)
            for g, c in counts.items():
                groups[g[:-1]].append(c)
            self.by_context[k] = groups

    def p(self, gram):
        if not gram:
            return self.floor
        k, below = len(gram), self.p(gram[1:])
        after = self.by_context[k].get(gram[:-1])
        if not after:
            return below
        d, c = self.d[k], self.c[k][gram]
        gamma = sum(d[min(x, 3) - 1] for x in after)
        return ((c - d[min(c, 3) - 1] if c else 0) + gamma * below) / sum(after)


def test_kneser_ney(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("aeioustnré "), rng.integers(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, prose(rng.integers(1, 40)), "en") for i in range(90)] + [(90, "zz %% new", "en"), (91, "", "en"), (92, None, "en"), (93, prose(3000), "en"), (5, "a second row", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(70)], "id long, good int")
    got = quality.perplexities(docs, labels, chunks=3).collect()
    assert len(got) == len(rows) and {r.model for r in got} == {"en"} and any(r.held for r in got)
    held = {r.key for r in got if r.held}
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), common.text_key(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("k")).collect()
    plain = KneserNey([r.t for r in keyed if r.doc_id < 70 and r.k not in held])
    text = {r.k: r.t for r in keyed}
    pad = quality.START * (quality.ORDER - 1)
    for r in got:
        t = text[r.key]
        want = -sum(math.log(plain.p((pad + t)[i : i + quality.ORDER])) for i in range(len(t)))
        assert r.n_runs == len(t) and abs(r.minus_log - want) <= 1e-9 * max(1, want)


def plain_tree(urls):
    """Template, purity and verdict of each (host, path), level by level; urls: (host, path) to (good, labels)."""
    shape = lambda s: re.sub("[0-9]+", "{n}", re.sub(r"\b(?=[a-f]*[0-9])[0-9a-f]{8,}\b", "{x}", s))
    segs = {u: [shape(s) for s in u[1].lstrip("/").split("/")] for u in urls}
    template = dict.fromkeys(urls, "")
    for level in range(max(map(len, segs.values()), default=0)):
        branches = defaultdict(lambda: defaultdict(list))
        for u in urls:
            if len(segs[u]) > level:
                branches[u[0], template[u]][segs[u][level]].append(u)
        for (_, prefix), values in branches.items():
            every = [u for us in values.values() for u in us]
            g_all, n_all = (sum(urls[u][k] for u in every) for k in (0, 1))
            variable = len(values) >= url_filter.MANY_VALUES and len(every) / len(values) < url_filter.PER_VALUE
            for seg, us in values.items():
                g, n = (sum(urls[u][k] for u in us) for k in (0, 1))
                differs = False
                if n and n_all - n:
                    p = g_all / n_all
                    error = math.sqrt(p * (1 - p) * (1 / n + 1 / (n_all - n)))
                    differs = abs(g / n - (g_all - g) / (n_all - n)) > url_filter.MERGE_Z * error
                token = seg if not variable and (differs or len(values) == 1) else "*"
                for u in us:
                    template[u] = f"{prefix}/{token}"
    base = (sum(g for g, _ in urls.values()) + 1) / (sum(n for _, n in urls.values()) + 1)
    host, tree = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for u, (g, n) in urls.items():
        for sums in (host[u[0]], tree[u[0], template[u]]):
            sums[0] += g
            sums[1] += n
    prior = url_filter.PRIOR
    out = {}
    for u in urls:
        of_host = (host[u[0]][0] + prior * base) / (host[u[0]][1] + prior)
        g, n = tree[u[0], template[u]]
        out[u] = (template[u], (g + prior * of_host) / (n + prior))
    return out


def test_url_tree(spark):
    """Many and few values, labelled branches that differ, numbers and hashes, deep paths, repeated and lone URLs."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(500):
        host = ("a.com", "b.org", "c.net")[i % 3]
        section = ("news", "spam", f"u{rng.integers(0, 60)}", "shop")[rng.integers(0, 4)]
        tail = (f"{rng.integers(0, 9)}", f"item-{rng.integers(0, 30)}.html", "/".join("xyz"[rng.integers(0, 3)] for _ in range(rng.integers(1, 14))), f"{rng.integers(0, 1 << 40):x}")[rng.integers(0, 4)]
        rows.append((i, f"http://{host}/{section}/{tail}", int(section != "spam") if rng.random() < 0.6 else None))
    rows += [(600 + i, rows[i][1], 1) for i in range(9)] + [(700, "http://lone.com/a/b/c/d/e/f/g/h/i/j/k/1", None), (701, "http://a.com", 0), (702, None, 1), (703, "http://a.com/" + "deep/" * 40 + "x", 0), (704, "http://a.com/" + "deep/" * 40 + "y", 0)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if g is not None], "id long, good int")
    rules = spark.createDataFrame([], "rule_host string, rule_path string, rule_verdict string")
    urls = defaultdict(lambda: [0, 0])
    at = {}
    for i, url, g in rows:
        m = re.search("://([^/?#]*)([^?#]*)", url or "")
        at[i] = (m[1].lower(), m[2]) if m else ("", "")
        sums = urls[at[i]]
        if g is not None:
            sums[0] += g
            sums[1] += 1
    want = plain_tree(dict(urls))
    got = url_filter.filter_urls(pages, rules, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        template, purity = want[at[r.id]]
        assert r.template == template and abs(r.purity - purity) < 1e-12 and r.verdict == ("block" if purity < url_filter.LEAST_PURITY else "allow")
    assert {r.verdict for r in got} == {"allow", "block"}


def plain_winnow(text, k, w):
    """Positions and run texts of a winnowed text: in each window the least run by hash, the rightmost of equal ones."""
    runs = [text[i : i + k] for i in range(len(text) - k + 1)] or ([text] if text else [])
    if not runs:
        return []
    h = {r: int(winnow.fingerprints([r], len(r), 1)[0][0][0]) for r in set(runs)}
    chosen = []
    for s in range(max(len(runs) - w + 1, 1)):
        window = range(s, min(s + w, len(runs)))
        best = min(window, key=lambda i: (h[runs[i]], -i))
        if not chosen or chosen[-1] != best:
            chosen.append(best)
    return [(i, h[runs[i]]) for i in chosen]


def test_winnow_beside_plain():
    """Random and repetitive texts, shorter than a run, than a window, and longer."""
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list("abé\U0001f600"), n)) for n in (0, 1, 3, 4, 5, 9, 30, 200, 900)] + ["ab" * 90, "a" * 120, "x" * 7]
    for k, w in ((4, 5), (3, 1), (5, 16)):
        for t, (hashes, positions) in zip(texts, winnow.fingerprints(texts, k, w)):
            want = plain_winnow(t, k, w)
            assert [int(p) for p in positions] == [p for p, _ in want]
            if len(t) >= k:
                assert [int(x) for x in hashes] == [x for _, x in want]
    a, b = (set(map(int, winnow.fingerprints([t], 4, 5)[0][0])) for t in (texts[7], texts[8]))
    got = winnow.likeness(*(winnow.fingerprints([t], 4, 5)[0][0] for t in (texts[7], texts[8])))
    assert abs(got - len(a & b) / len(a | b)) < 1e-12


def test_probabilities_keep_plans_small(spark, monkeypatch):
    """No plan holds all orders: the driver's memory goes with the largest plan."""
    plans, write = [], common.written
    tree = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(common, "written", lambda df, name: plans.append(tree(df)) or write(df, name))
    grams = spark.createDataFrame([("en", "abab", 2), ("en", "baba", 1), ("de", "aaaa", 0)], "lang string, gram string, n long")
    plans.append(tree(quality.probabilities(grams, grams.where("n > 0"))))
    assert max(p.count("Aggregate") for p in plans) <= 4 and max(p.count("Join") for p in plans) <= 3
