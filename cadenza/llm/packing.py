"""Lexical retrieval packing: documents fill fixed windows with their BM25 neighbours.

Every task cuts its documents into shards of SHARD_DOCS and keeps a BM25 inverted index of the shard
over token ids, with document frequencies and the mean length of the whole corpus (counted first, over a
table of all documents' ids; the vocabulary bounds what is broadcast). A seed document opens a window; the index returns its unused
neighbours by score, which fill the window greedily, the last one being cut at the end of the window.
What is left of it seeds the next window. A window still open at the end of a shard is filled from the
next one; what is open at the end of a task becomes sequences whose lengths are powers of two, which
need no padding. No shuffle moves documents, and a lost task is simply run again over the same rows.

Cases: null text is empty: such a document is its end token alone. Documents of any length are cut
freely; each token lies in exactly one piece. Ties go to the earlier row. Repeated rows are packed one
by one. An empty table gives no pieces. Columns other than the id and the text are not used.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from . import common

WINDOW, END = 4096, 2
SHARD_DOCS, SHARD_TOKENS = 512, 1 << 21
K1, B = 1.2, 0.75
#: Distinct words whose ids a worker remembers.
CACHE = 350_000


#: The stages before the model that the fast way below stands for; a tokenizer with others is asked for whole texts.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Texts of these characters alone are normal already but for case, and classes of letters and digits are plain.
_PLAIN = re.compile(r"[ -~\t\n\rÀ-ÖØ-öø-ÿ]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Texts of plain Latin letters are split here as the tokenizer splits them, and its model encodes only
    words that the worker has not met yet. Any other text, or one that may hold a special token, goes
    through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.path, self.known = path, {}
        self.words = Tokenizer.from_file(path)
        self.size = self.words.get_vocab_size()
        self.special = [x.content for x in self.words.get_added_tokens_decoder().values()]
        stages = [json.loads(x.__getstate__()) if x else None for x in (self.words.normalizer, self.words.pre_tokenizer)]
        split = {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
        pieces = (stages[1] or {}).get("pretokenizers", [])
        self.fast = stages[0] == {"type": "Sequence", "normalizers": _NORMALIZERS} and len(pieces) == 2 and pieces[0] == split and pieces[1]["type"] == "ByteLevel"
        if self.fast:
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The whole tokenizer, once a text needs it."""
        return Tokenizer.from_file(self.path)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.fast or not _PLAIN.fullmatch(text) or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = _WORDS.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            pass
        if len(self.known) > CACHE:
            self.known.clear()
        new = list({x for x in parts if x not in self.known})
        found = self.words.encode(" ".join(new), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        ends = np.cumsum(np.bincount(np.array(found.word_ids), minlength=len(new))).tolist()
        self.known.update(zip(new, (ids[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        return b"".join(map(self.known.__getitem__, parts))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@dataclass(frozen=True)
class Corpus:
    """docs, mean tokens of a document, and the inverse document frequency of every id."""

    docs: int
    mean: float
    idf: np.ndarray


def tokenize(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids, the whole text's ids without an end token (little-endian; 16 bits where the vocabulary allows, else 32)."""
    common.bound_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = _width(encode.size)
        for batch in batches:
            ids = [np.frombuffer(encode(t), "<u4").astype(width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        encode.known.clear()  # the worker lives on, and other stages need its memory

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(common.frugal(run), f"doc_id {kind}, ids binary")


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def corpus(tokens: DataFrame, size: int) -> Corpus:
    """Document frequencies over all documents; what comes to the driver is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            own = [np.frombuffer(x, _width(size)) for x in batch.column(0).to_pylist()]
            for at in range(0, len(own), 64):
                part = own[at : at + 64]
                seen = np.zeros((len(part), size), bool)
                seen[np.repeat(np.arange(len(part)), [len(x) for x in part]), np.concatenate(part)] = True
                counts += seen.sum(axis=0)
            n, total = n + len(own), total + sum(map(len, own)) + len(own)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]).astype(np.int32)), pa.array(np.append(counts[at], [n, total]))], names=["id", "n"])

    got = tokens.select("ids").mapInArrow(common.frugal(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n, total = (int(got.n[got.id == k].sum()) for k in (-1, -2))
    df = np.zeros(size)
    own = got[got.id >= 0]
    df[own.id] = own.n
    return Corpus(n, total / max(n, 1), np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32))


class Index:
    """BM25 over one shard: for each id the documents that hold it, with their weights."""

    def __init__(self, ids: list[np.ndarray], of: Corpus) -> None:
        self.size = len(ids)
        lengths = np.array([len(x) for x in ids], np.int64)
        width = len(of.idf)
        keys, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64) * self.size + np.repeat(np.arange(self.size), lengths), return_counts=True)
        term, self.docs = np.divmod(keys, self.size)
        norm = K1 * (1 - B + B * (lengths + 1) / max(of.mean, 1))
        self.weights = of.idf[term] * tf * (K1 + 1) / (tf + norm[self.docs])
        self.starts = np.searchsorted(term, np.arange(width + 1))

    def scores(self, terms: np.ndarray) -> np.ndarray:
        lo, hi = self.starts[terms], self.starts[terms + 1]
        sizes = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        return np.bincount(self.docs[at], self.weights[at], self.size)

    def neighbours(self, terms: np.ndarray, unused: np.ndarray) -> np.ndarray:
        """Unused documents by falling score, then by row."""
        at = np.flatnonzero(unused)
        return at[np.argsort(-self.scores(terms)[at], kind="stable")]


class _Packer:
    """Fills windows; rows: (doc, start, length, ids, doc tokens, sequence, offset)."""

    def __init__(self, of: Corpus, first: int, window: int) -> None:
        self.of, self.sequence, self.window = of, first, window
        self.open: list[tuple] = []  # (doc_id, start, ids, doc tokens) of the open window
        self.filled, self.seed = 0, None
        self.rows: list[tuple] = []

    def put(self, doc: object, ids: np.ndarray) -> None:
        """The whole document, over as many windows as it takes; in the last it is the seed if it opened it."""
        at = 0
        while at < len(ids):
            n = min(self.window - self.filled, len(ids) - at)
            if not self.filled:
                self.seed = np.unique(ids[:-1])
            self.open.append((doc, at, ids[at : at + n], len(ids)))
            self.filled += n
            at += n
            if self.filled == self.window:
                self.close(self.window)

    def close(self, length: int) -> None:
        """The first tokens of what is open become a sequence."""
        offset, rest = 0, []
        for doc, start, ids, tokens in self.open:
            n = min(len(ids), length - offset)
            if n:
                self.rows.append((doc, start, n, ids[:n].tobytes(), tokens, self.sequence, offset))
            if n < len(ids):
                rest.append((doc, start + n, ids[n:], tokens))
            offset += n
        self.open, self.filled, self.sequence = rest, self.filled - length, self.sequence + 1

    def shard(self, docs: list, ids: list[np.ndarray]) -> None:
        index, unused = Index([x[:-1] for x in ids], self.of), np.ones(len(ids), bool)
        head = 0
        while True:
            if not self.filled:
                while head < len(ids) and not unused[head]:
                    head += 1
                if head == len(ids):
                    return
                unused[head] = False
                self.put(docs[head], ids[head])
                if not self.filled:
                    continue
            near = index.neighbours(self.seed, unused)
            if not len(near):
                return
            window = self.sequence
            for k in near:
                unused[k] = False
                self.put(docs[k], ids[k])
                if self.sequence != window:
                    break

    def finish(self) -> None:
        while self.filled:
            self.close(1 << (self.filled.bit_length() - 1))


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    tokens, _ = common.materialize(tokenize(docs, tokenizer, doc_id, text), "tokens")
    size = encoder(tokenizer).size
    shared = spark.sparkContext.broadcast(corpus(tokens, size))
    schema = f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(size)
        packer = _Packer(shared.value, TaskContext.get().partitionId() << 33, window)
        held: tuple[list, list] = ([], [])
        tokens, id_type = 0, None

        def rows() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [()] * 7
            packer.rows = []
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(np.frombuffer(raw, width), end).astype("<u4")
                held[0].append(doc)
                held[1].append(ids)
                tokens += len(ids)
                if len(held[0]) == SHARD_DOCS or tokens > SHARD_TOKENS:
                    packer.shard(*held)
                    held, tokens = ([], []), 0
                    yield rows()
        if id_type is not None:
            if held[0]:
                packer.shard(*held)
            packer.finish()
            yield rows()

    return tokens.mapInArrow(common.frugal(run), schema)
