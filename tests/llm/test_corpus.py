"""Operators 3 to 9 and the pipeline beside libraries, brute force and held-out labels."""

import hashlib
import itertools
import random
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feria.llm import common, licenses, mixing, pieces, quality, simple8b, token_files, url_filter, winnow

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 4096, 4097, 20_000):
        v = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64)
        v[rng.random(n) < 0.3] = 0
        v[: n // 4] = 0
        words, per = simple8b.pack(v)
        assert (simple8b.unpack(words, per, np.minimum(simple8b.BLOCK, n - simple8b.BLOCK * np.arange(len(per)))) == v).all()


def test_token_files(spark, docs, rows, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_files.read(spark, token_files.write(docs, path, common.shared_dir(spark, "t"))).orderBy("start").collect()
    tok, start = Tokenizer.from_file(path), 0
    for (i, t, *_), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), got, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, start, len(ids), ids)
        start += len(ids)
    assert token_files.read(spark, token_files.write(none, path, common.shared_dir(spark, "t"))).count() == 0


def test_tokens_of_odd_words():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["it's don't <|endoftext|> A<|ENDOFTEXT|>b", "foo--bar... x1y2 ÉCOLE—école,", " a b \x1c c", "ǅ İ ß ﬁ é a!b'ss ''s"]
    tok = Tokenizer.from_file(path)
    for t, ids in zip(texts, token_files._ids_of([t.encode() for t in texts], path)):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids


def test_tokens_of_marks_and_random_texts():
    """Capitals with every combining mark, and random texts of letters, marks, signs and white space."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, rng = Tokenizer.from_file(path), np.random.default_rng(9)
    texts = [chr(c) + chr(m) + " x" + chr(c) + "y" for c in range(65, 91) for m in range(0x300, 0x370)]
    signs = list("abcXYZ 0129'.,<|>-_\t\n\u00a0ÉßİǅΣςﬁé日本") + [chr(c) for c in (0x300, 0x308, 0x301, 0x323, 0x344, 0x5B0, 0x1DC4, 0x20DD, 0x212A)]
    texts += ["".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(20_000)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    got = token_files._ids_of([t.encode() for t in texts], path)
    assert [t for t, a, b in zip(texts, got, want) if a.tolist() != b] == []


def test_words_of_letters_are_encoded_together(monkeypatch):
    """Few calls for many words, and the library's ids, also where a letter's lower case has a mark or a sign follows."""
    path = public_tokenizers.path("word_bpe_49k.json")
    known, rng = token_files._Words(path), random.Random(3)
    lib, asked = known.tok, []

    class Counting:
        def encode(self, text, **kw):
            return asked.append(1) or lib.encode(text, **kw)

        def encode_batch_fast(self, texts, **kw):
            return asked.extend(texts) or lib.encode_batch(texts, **kw)

    Counting.encode_batch = Counting.encode_batch_fast
    known.tok = Counting()
    monkeypatch.setattr(token_files, "_state", {"path": path, "words": known})
    plain = ["".join(rng.choices("abcdeéñßŉĳǆɐжж中", k=rng.randint(1, 9))) + rng.choice(["", "", ",", "...", "!?"]) for _ in range(4000)]
    odd = ["İ,", "İstanbul", "aİb", "é»,", "×,", "é×,", "a÷b", "ﬁn", "ª", "ˇ", "x\u0338=", "é\u0301,", "l'été,", "ΣΑΣ", "ΣΑΣ.", "\U0001d538b", "٣٤", "ǅ.", "ɿ;", "Éa,É"]
    for words in (plain, odd, plain[:5] + odd):
        asked.clear()
        ids = token_files._ids_of([" ".join(words).encode(), b"", *(w.encode() for w in odd)], path)
        assert [x.tolist() for x in ids] == [e.ids for e in lib.encode_batch([" ".join(words), "", *odd], add_special_tokens=False)]
        assert words is not plain or len(asked) < 2500


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  words", "A\u0308 x", ""]
    got = token_files._ids_of([t.encode() for t in texts], path)
    assert [g.tolist() for g in got] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces(docs, rows, none, spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load_pieces(path)
    rng = np.random.default_rng(3)
    long = ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in (62, 63, 500, 1_000_000)] + ["ab" * 40 + "é﷽" * 30 + "ab" * 40]
    odd = [(i, t) for i, t in enumerate([*long, "", " ", "  a   b" + " " * 37 + "c", "a\n\n b\t\tc\r\n", "x" * 300, "é﷽\x00x ▁ ▁▁b", "https://www.example.com/a_b?c=d" * 4])]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    encoded = common.written(pieces.encode(both, model), "e")
    want = sorted((str(i), sp.encode(t or "")) for i, t in [r[:2] for r in rows] + odd)
    assert sorted((str(r.id), np.frombuffer(r.piece_ids, "<u4").tolist()) for r in encoded.collect()) == want
    texts = sorted((str(r.id), r.text) for r in pieces.decode(encoded, model).collect())
    assert texts == sorted((str(i), (t or "").replace("▁", " ")) for i, t in [r[:2] for r in rows] + odd)
    assert pieces.encode(none, model).count() == 0


def test_pieces_of_rows_in_changing_order(spark):
    """Documents that come in another order, cut into other batches, whenever they are read; and texts that change."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load_pieces(path)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 9))) for _ in range(rng.integers(0, 200)))) for i in range(300)]

    def mixed(tables):
        for batch in tables:
            own = np.random.default_rng().permutation(batch.num_rows)
            for part in np.array_split(own, np.random.default_rng().integers(1, 5)):
                yield batch.take(part)

    def changed(tables):
        for batch in tables:
            yield batch.set_column(1, "text", pa.array(["".join(np.random.default_rng().choice(list("etaoinshrdlu"), 15))] * batch.num_rows))

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pieces.encode(docs.mapInArrow(mixed, docs.schema), model, chunks=4).collect()
    assert sorted((r.id, np.frombuffer(r.piece_ids, "<u4").tolist()) for r in got) == [(i, sp.encode(t)) for i, t in rows]
    with pytest.raises(Exception, match="changed while they were read"):
        pieces.encode(docs.mapInArrow(changed, docs.schema), model, chunks=1).collect()


def test_unigram_viterbi(spark):
    """Best sums of scores beside all cuts of a unit."""
    table = (("a", 1, -2.0), ("b", 2, -2.5), ("ab", 3, -3.0), ("ba", 4, -3.5), ("aab", 5, -4.6), ("▁", 6, -1.0), ("▁a", 7, -2.2))
    model = pieces.Pieces(table, (), 0, unigram=True)
    score = {p: s for p, _, s in table}
    ids = {p: i for p, i, _ in table}
    units = ["".join(u) for n in range(1, 7) for u in itertools.product("ab", repeat=n)] + ["▁aab", "▁ba"]
    got = {r.unit: r.ids for r in pieces.encoded_units(spark.createDataFrame([(u,) for u in units], "unit string"), model).collect()}
    for u in units:
        cuts = [[u[a:b] for a, b in zip((0, *c), (*c, len(u)))] for k in range(len(u)) for c in itertools.combinations(range(1, len(u)), k)]
        best = max(sum(score[p] for p in c) for c in cuts if all(p in score for p in c))
        back = {i: p for p, i in ids.items()}
        assert abs(sum(score[back[i]] for i in got[u]) - best) < 1e-9


def test_kneser_ney_sums_to_one(spark):
    """Probabilities of all letters after a context add up to one, seen contexts and others."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcd "), 60)) for _ in range(40)]
    pad = quality.START * (quality.ORDER - 1)
    grams = [("en", (pad + t)[i : i + quality.ORDER]) for t in texts for i in range(len(t))]
    counts = spark.createDataFrame(grams, "lang string, gram string").groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = [("en", c + x) for c in ("abc", "zzz", "a b", "ddd") for x in "abcd "]
    p = quality.probabilities(spark.createDataFrame(asked, "lang string, gram string"), counts).toPandas()
    total = p.groupby(p.gram.str[:3]).p.sum()
    letters = 5
    assert (total < 1).all() and (total > 1 - 1 / letters).all()  # the rest is for letters never seen


def test_quality_on_held_out(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("aeiourstnl"), rng.integers(2, 7))) for _ in range(300)]
    good = [" ".join(rng.choice(words, 80)) for _ in range(120)]
    bad = ["%% ".join(rng.choice(words, 80)).upper() for _ in range(20)]
    rows = [(i, t, "en") for i, t in enumerate(good + bad)] + [(900, None, "en"), (901, "", None), (None, good[0], "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("key", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 100)] + [(None, 1), (5, None)], "id long, good int")
    got = {r.id: r.rejected for r in quality.judged(common.written(quality.perplexities(docs, labels, chunks=3), "s")).collect()}
    assert not any(got[i] for i in range(100, 120)) and all(got[i] for i in range(120, 140))
    assert not got[900] and not got[901] and len(got) == len(rows)
    kept = quality.without_rejected(docs, labels)
    assert kept.count() == len(rows) - len([1 for v in got.values() if v]) and kept.columns == docs.columns
    assert quality.perplexities(docs.where("false"), labels).count() == 0
    assert quality.without_rejected(docs, labels.where("false")).count() == len(rows)


def test_quality_without_and_with_few_trusted(spark):
    """Languages without trusted text, or with little of it, keep their clean documents; thresholds are of held-out texts."""
    rng = np.random.default_rng(8)
    make = lambda letters: ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(300)]
    words = {"en": make("aeiourstnl"), "el": make("αβγδεζηικλ"), "xx": make("бвгдежзикл")}
    prose = lambda lang, n: [" ".join(rng.choice(words[lang], 80)) for _ in range(n)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in prose("en", 260)] + [(t, "el") for t in prose("el", 30)] + [(t, "xx") for t in prose("xx", 10)] + [(None, None), (prose("xx", 1)[0], None)])]
    rows += [(900 + i, t.upper().replace(" ", "%% "), "en") for i, t in enumerate(prose("en", 5))] + [(950, rows[0][1], "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in [*range(200), *range(260, 272)]], "id long, good int")
    scores = common.written(quality.perplexities(docs, labels, chunks=2), "s")
    got = {r.id: r for r in quality.judged(scores).collect()}
    assert len(got) == len(rows) and {r.model for r in scores.collect()} == {"en", quality.POOL}
    assert not any(got[i].rejected for i in range(302)) and not got[950].rejected
    assert all(got[900 + i].rejected for i in range(5))
    assert all(got[i].threshold is None for i in [*range(290, 302), 950]) and got[280].threshold is not None
    held = [r.log_perplexity for r in got.values() if r.lang == "en" and r.held]
    assert held and got[0].threshold > max(held)
    kept = {r.doc_id for r in quality.without_rejected(docs, labels).collect()}
    assert kept == {i for i, *_ in rows if not 900 <= i < 905}


def test_licences(spark, none):
    mit = licenses.KNOWN[0][1]
    texts = [mit, "/* Copyright (c) 2020 Someone */\n" + mit.upper().replace(",", " ,"), mit.replace("license", "licence"), mit + " more", "Released under the MIT License.\nx", None, "", "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit(0))
    got = {r.id: (r.license, r.notices) for r in licenses.scan(docs).collect()}
    assert [got[i][0] for i in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, None]
    assert got[4][1] == ["MIT"]
    assert licenses.scan(none).count() == 0


def test_licences_however_they_are_wrapped(spark):
    """Every known full text, wrapped at 60 to 100 characters, below each kind of notice."""
    full = [(name, t) for name, t in licenses.KNOWN if "\n" in t]
    heads = ["", "Copyright (c) 2001-2020, The Someone\n", "Copyright 2019 Someone. All rights reserved.\n", " * Copyright Jane Doe\n", "(c) 2020 Someone\nAll rights reserved.\n\n", "© 1999 A\n"]
    heads += ["Copyright The Kubernetes Authors.\n", "Copyright the original author or authors.\n", "Portions Copyright (c) 2001 X Corp\n", "(c) Jane Doe\n", "// Copyright and Sons Ltd\n", "Copyright Holding AG\n", "Parts are copyrighted by of the People Inc.\n"]
    rows = []
    for width in range(60, 101):
        for k, (name, t) in enumerate(full):
            wrapped = "\n\n".join(textwrap.fill(part, width) for part in t.split("\n\n"))
            rows += [(name, heads[(width + k + j) % len(heads)] + wrapped) for j in (0, 5)]
    rows += [(None, heads[3] + full[0][1].replace("hereby", "never")), (None, "Copyright notice\n" + full[0][1])]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.id: r.license for r in licenses.scan(docs).collect()}
    assert [rows[i][0] for i in sorted(got) if got[i] != rows[i][0]] == []


def test_a_licence_with_lettered_clauses(spark):
    """"(c)" before a known clause is a letter of a list, before a name a sign; a very long text is read whole."""
    clauses = [("L-1", "You may copy:\n(a) for free;\n(b) for a fee;\n(c) for both at once, if the copyright law\nsays so.")]
    texts = [clauses[0][1].replace("\n", " ").replace(" (c)", "\n(c)"), clauses[0][1].replace("if the copyright", "if the\ncopyright"), "(c) Jane\n" + clauses[0][1], clauses[0][1].replace("(c)", "(d)"), "word " * 400_000, "word " * 400_000 + "\n" + clauses[0][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "digest", "license", "lines", "id")})
    assert [r.license for r in licenses.scan(docs, clauses).orderBy("id").collect()] == ["L-1", "L-1", "L-1", None, None, None]


def test_licences_from_files(spark, tmp_path):
    """Known texts of the user's own, with a notice that no built-in mark fits."""
    (tmp_path / "Own-1.0.txt").write_text("You may do\nas you like.\n")
    (tmp_path / "Short-2.txt").write_text("Free for everybody!\n")
    known = licenses.known_from_files(spark, str(tmp_path))
    with pytest.raises(ValueError, match="more than 1 files"):
        licenses.known_from_files(spark, str(tmp_path), most=1)
    docs = spark.createDataFrame([(1, "Copyright 2020 Me\nYou may do as\nyou like"), (2, "x\n# free for EVERYBODY\ny"), (3, "free for everybody"), (4, None)], "doc_id long, text string")
    got = {r.id: (r.license, r.notices) for r in licenses.scan(docs, known).collect()}
    assert got == {1: ("Own-1.0", []), 2: (None, ["Short-2"]), 3: ("Short-2", ["Short-2"]), 4: (None, [])}


def test_winnowing(docs, rows, none):
    got = winnow.compare_edits(docs, parts=4).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = []
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for i, t, *_ in rows:
        prints = {r.fingerprint for r in got if r.doc_id == i} if i is not None else set()
        if len(prints) == 1:
            assert by_text.setdefault(t or "", prints) == prints
    assert winnow.compare_edits(none, parts=4).count() == 0
    assert winnow.compare_edits(none.sparkSession.createDataFrame([(1, "abcd" * 30)], "doc_id long, text string"), parts=4).count() == 1


def test_winnowing_guarantee():
    """A shared passage of K + W - 1 characters gives a shared entry."""
    rng = np.random.default_rng(6)
    letters = list("abcdefghij é\U0001f600")
    text = lambda n: "".join(rng.choice(letters, n))
    for _ in range(30):
        shared = text(winnow.K + winnow.W - 1)
        (a, pa_), (b, _) = winnow.fingerprints([text(rng.integers(0, 200)) + shared + text(90), text(rng.integers(0, 200)) + shared])
        assert set(a.tolist()) & set(b.tolist()) and (np.diff(pa_) > 0).all()


def test_mixing(docs, rows, none):
    got = mixing.mix(docs, {"a": 3.0, "b": 1.0}, total=200_000.0)
    out = got.toPandas()
    assert set(out.doc.map(lambda d: d["source"])) <= {"a", "b"}
    size = out.doc.map(lambda d: d["n_chars"]).groupby(out.doc.map(lambda d: d["source"])).sum()
    assert 0.4 < size["a"] / 150_000 < 1.6 and 0.4 < size["b"] / 50_000 < 1.6
    assert (out.order_key.diff().dropna() >= 0).all()
    again = mixing.mix(docs.repartition(7), {"a": 3.0, "b": 1.0}, total=200_000.0).toPandas()
    assert out.order_key.tolist() == again.order_key.tolist()
    assert mixing.mix(none).count() == 0
    big = mixing.with_steps(none.sparkSession.createDataFrame([("s", 1, 1000.0)], "source string, size long, rate double")).first()
    assert big.parts == 16 and abs(big.steps[-1] - 1) < 1e-9


def test_mixing_of_many_sources(docs, monkeypatch):
    """Beyond the bound of what is broadcast the result is the same."""
    want = mixing.mix(docs, total=90_000.0).toPandas()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    got = mixing.mix(docs, total=90_000.0).toPandas()
    assert len(got) and got.order_key.tolist() == want.order_key.tolist()


def test_urls(spark):
    urls = ["http://a.com/en/1", "http://EXAMPLE.com/en/70", "https://x.example.com/en/7", "ftp://example.net/de/8?q", "http://b.net/de/9#x", "http://c.org/es/", "http://xcom/en/1", "no scheme", None, "http://h", "http://q.dev/" + "/".join("abcdefghijkl")]
    urls += [f"http://spam.dev/buy/{i}" for i in range(40)] + [f"http://spam.dev/news/{i}" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i >= 51)) for i in range(11, 91) if i % 2] + [(None, 1)], "id long, good int")
    rules = spark.createDataFrame(url_filter.RULES, "rule_host string, rule_path string, rule_verdict string")
    got = {r.id: r for r in url_filter.filter_urls(pages, rules, labels).collect()}
    assert [got[i].rule for i in range(11)] == ["com/en/", "example.com/en/7", "example.com/en/7", "example.net/de/8", "net/de/", "org/es/", None, None, None, None, None]
    assert [got[i].verdict for i in range(7)] == ["block", "allow", "allow", "block", "allow", "block", "allow"]
    assert (got[8].host, got[8].path, got[9].path) == ("", "", "")
    assert {got[i].verdict for i in range(11, 51)} == {"block"} and {got[i].verdict for i in range(51, 91)} == {"allow"}
    assert url_filter.filter_urls(pages.where("false"), rules, labels).count() == 0
    assert url_filter.filter_urls(pages, rules).where("rule is null and verdict = 'block'").count() == 0


def test_pipeline(spark, rows, tmp_path):
    rows = [r for r in rows if r[0] is not None][:94]
    pd.DataFrame(rows, columns=corpus_pipeline.COLUMNS).astype({"doc_id": "int64"}).to_parquet(tmp_path / "documents.parquet")
    duckdb.sql(f"COPY (SELECT i AS doc_id, 1::INT AS quality, 0::INT AS toxic FROM range(40) r(i)) TO '{tmp_path}/labels.parquet'")
    docs = common.load(spark, str(tmp_path), "documents")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), "stage")
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert sizes[0] >= sizes[1] >= sizes[2] and sizes[3] == sizes[4]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
    texts = {r[0]: r[1] or "" for r in rows}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in docs.collect())
    assert zlib.crc32(b"") == 0


def test_pipeline_stages_on_odd_tables(spark, docs, none, rows, tmp_path):
    """Null ids, texts and languages, repeated rows and extra columns; and an empty table."""
    duckdb.sql(f"COPY (SELECT i AS doc_id, 1::INT AS quality, 0::INT AS toxic FROM range(40) r(i)) TO '{tmp_path}/labels.parquet'")
    few = docs.where("doc_id is null or doc_id < 12 or doc_id between 60 and 64 or doc_id >= 85").where("n_chars < 9000")
    now = few
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()}
        got = common.written(stage(spark, now, str(tmp_path)), "odd-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == corpus_pipeline.COLUMNS
            assert {(r.doc_id, r.text) for r in got.select("doc_id", "text").collect()} <= before
        else:
            assert got.count() == now.count()
        now = got
        assert stage(spark, none, str(tmp_path)).count() == 0
