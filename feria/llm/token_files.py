"""Operator 3: texts to token ids in Simple-8b files, and the files back to rows."""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feria.llm import common, simple8b

END_ID = 2
#: Words whose ids a worker remembers; then it starts afresh.
CACHE_WORDS = 1_200_000
#: The rules of a tokenizer file under which a text's ids are those of its words one after the other, and
#: under which ASCII letters may be lower-cased first. A file with other rules gets its texts whole.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Letters (lower-case ASCII, and those from U+00C0 to U+027F but U+0130, whose lower case has a mark) and ASCII signs but the
#: apostrophe: those rules part them in any case.
_SPLIT = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc9][\x80-\xbf])+)([!-&(-/:-@[-`{-~]+)")
_state: dict = {}


def by_words(rules: dict) -> bool:
    """Whether a tokenizer file's texts may be encoded word by word (words between ASCII white space)."""
    own = [(rules.get(k) or {}).get(part) for k, part in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    plain = all(a["content"].isascii() and "<|" in a["content"] and not re.search(r"\s", a["content"]) and not (a["lstrip"] or a["rstrip"] or a["single_word"]) for a in rules.get("added_tokens", []))
    return own == [NORMALIZERS, PRE_TOKENIZERS] and plain and rules.get("model", {}).get("type") == "BPE" and not rules.get("truncation") and not rules.get("padding")


def case_matters(text: bytes) -> bool:
    """Whether ASCII capitals may not be lower-cased before encoding: where a special token's string may stand, and where
    combining marks (U+0300 to U+036F, the bytes CC and CD) may first be composed with the letter before them."""
    return b"<|" in text or b"\xcc" in text or b"\xcd" in text


class _Index(dict):
    """Numbers of words in the order in which they are first asked for; `new` lists those whose ids are not known yet."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class _Words:
    """Ids of words, each encoded once: word i has ids flat[first[i]:first[i] + size[i]]."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            self.by_word = by_words(json.load(f))
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.first, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _set(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the words with these numbers, one after the other. Arrays double, so that each id moves a few times at most."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.index) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[at], self.size[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, one after the other, and how many each has."""
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.first[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has. Words of letters only go as one text with blanks between
        them: no part of the tokenizer's crosses a blank, so there are as many parts as words only if each word is one; if
        there are more, as where a letter's lower case has a mark, the words are encoded one by one."""
        if len(words) > 1 and all(map(str.isalpha, words)):
            e = self.tok.encode(" ".join(words), add_special_tokens=False)
            of = e.word_ids
            if of and None not in of and of[-1] == len(words) - 1:
                return np.array(e.ids, np.uint32), np.bincount(np.array(of, np.int64), minlength=len(words))
        encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        ids = [e.ids for e in encode(words, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def learn(self) -> None:
        """Encode the words that are new in the index."""
        index, cut, letters, other = self.index, [], [], []
        for w in index.new:  # parts that are new are added at its end
            if m := _SPLIT.fullmatch(w):
                cut.append((index[w], index[m[1]], index[m[2]]))
            else:
                (letters if (t := w.decode()).isalpha() else other).append((index[w], t))
        index.new = []
        for kind, most in ((letters, 1_000), (other, 20_000)):
            for i in range(0, len(kind), most):
                at, words = zip(*kind[i : i + most])
                self._set(np.array(at, np.int64), *self._encoded(list(words)))
        if cut:
            at = np.array(cut, np.int64)
            ids, sizes = self.gather(at[:, 1:].ravel())
            self._set(at[:, 0], ids, sizes.reshape(-1, 2).sum(axis=1))


def _ids_of(texts: list[bytes], path: str) -> list[np.ndarray]:
    """Token ids of each text, those of its words in order where the tokenizer's rules allow it: they never join
    characters over ASCII white space."""
    if _state.get("path") != path:
        _state.update(path=path, words=_Words(path))
    known: _Words = _state["words"]
    if not known.by_word:
        return [np.array(e.ids, np.uint32) for e in known.tok.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
    if len(known.index) > CACHE_WORDS:
        known.clear()
    split = [(t if case_matters(t) else t.lower()).split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    at = np.fromiter(map(known.index.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(counts.sum()))
    if known.index.new:
        known.learn()
    ids, sizes = known.gather(at)
    bounds = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)[:-1]] if len(counts) else []
    return np.split(ids, bounds)


def write(docs: DataFrame, tokenizer: str, out_dir: str, *, end_id: int = END_ID, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text (null counts as empty), append `end_id`, and write the ids in ascending `id_col` order.

    File i holds the i-th range of ids. Returns the manifest: file_no, path, n_docs, n_ids and first_id, the number of
    ids in the files before. A task that runs again writes another file; only files in the manifest count. Rows with
    equal ids come in text order, rows with a null id first, texts of any length are encoded whole, and an empty table
    gives an empty manifest.
    """
    spark = docs.sparkSession
    n = files or common.shuffle_parts(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(n, F.col("i").asc_nulls_first()).sortWithinPartitions(F.col("i").asc_nulls_first(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(out_dir)
        path = f"{out_dir}/ids-{no:06d}-{uuid.uuid4().hex[:8]}.s8b"
        out = None
        for batch in batches:
            for part in common.pieces(batch, "t"):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(base + path[len(out_dir) :])
                    out = simple8b.Writer(sink)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                for doc_id, ids in zip(part.column(0).to_pylist(), _ids_of(texts, tokenizer)):
                    out.add(doc_id, np.append(ids, np.uint32(end_id)))
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file_no": [no], "path": [path], "n_docs": [len(out.ids)], "n_ids": [out.total]})

    made = rows.mapInArrow(common.trimmed(run), "file_no long, path string, n_docs long, n_ids long")
    manifest = common.written(made, "token-manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(spark: SparkSession, manifest: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned
    32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, p = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(p) as f:
                    for doc_id, ids in simple8b.read(f, f.size()):
                        rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                        start, held = start + len(ids), held + len(ids)
                        if held > 500_000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    few = manifest.select("path", "first_id", "file_no").repartitionByRange(tasks or common.shuffle_parts(spark), "file_no").select("path", "first_id")
    return few.mapInArrow(common.trimmed(run), "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: token ids of `documents` through the files, with a checksum of each document's ids."""
    import public_tokenizers

    common.tune(spark)
    manifest = write(common.load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), common.shared_dir(spark, "token-files"))
    return read(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
