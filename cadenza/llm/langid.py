"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of lower-cased code points per language; every non-letter
counts as a space. Prediction broadcasts the matrix of log-probabilities (languages x buckets,
bounded by MAX_LANGS and BUCKETS) and scores batches of texts sparsely in numpy: the buckets of
all n-grams of a batch index the matrix, and segment sums give one row of scores per text.

Cases: null text, empty text or text without a letter -> 'und', score 0. No labelled rows -> 'und'
for all. Ties go to the first language in code point order. Repeated rows get equal results. Very
long texts are scored whole, in pieces of bounded size. Other columns pass through; a column of the
input that has the name of an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 15
BUCKETS = 1 << BITS
#: The most languages that a model may hold: the matrix then stays under 128 MB.
MAX_LANGS = 512
#: Rows to learn from, spread over the languages: the documented bound of the training sample.
MAX_TRAIN_ROWS = 10_000
_STEP = 1 << 18
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


@dataclass(frozen=True)
class Model:
    """log_probs: one row per bucket and one column per language; the last row, for n-grams without a letter, is zero."""

    langs: tuple[str, ...]
    priors: np.ndarray
    log_probs: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that start at each place (BUCKETS where a gram has no letter), and which places are letters.

    No gram starts at the last two places of a piece: those only end grams.
    """
    letter = _letters()[code]
    c = np.where(letter, code, 32).astype(np.uint32)
    c1, c2 = np.append(c[1:], c[:1]), np.append(c[2:], c[:2])
    any2 = letter | np.append(letter[1:], False)
    any3 = any2 | np.append(letter[2:], [False, False])
    h1 = c * _M1
    h2 = (h1 ^ c1) * _M2
    h3 = (h2 ^ c2) * _M3
    out = np.empty((3, len(c)), np.int32)
    ends = np.append(starts[1:], len(code))
    for row, h, ok in zip(out, (h1, h2, h3), (letter, any2, any3), strict=True):
        row[:] = np.where(ok, h >> np.uint32(32 - BITS), BUCKETS)
        row[ends - 1] = row[ends - 2] = BUCKETS
    return out, letter


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, each between spaces, as pieces of code points: (the text's number of each piece, the pieces' starts, code points).

    A long text makes several pieces that overlap by two places, so that each gram starts in exactly one.
    """
    numbers, parts, starts, total = [], [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        padded = f" {t.lower()}  "
        for at in range(0, len(padded) - 2, _STEP):
            piece = padded[at : at + _STEP + 2]
            if total + len(piece) > 2 * _STEP:
                yield np.array(numbers), np.array(starts), np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
                numbers, parts, starts, total = [], [], [], 0
            numbers.append(i)
            starts.append(total)
            parts.append(piece)
            total += len(piece)
    if parts:
        yield np.array(numbers), np.array(starts), np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _count_partitions(langs: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), BUCKETS), np.int64)
        docs = np.zeros(len(langs), np.int64)
        for batch in batches:
            texts, labels = (batch.column(k).to_pylist() for k in (0, 1))
            lang = np.array([langs[x] for x in labels], np.int64)
            docs += np.bincount(lang, minlength=len(langs))
            for numbers, starts, code in _pieces(texts):
                grams, _ = _grams(code, starts)
                owner = np.repeat(lang[numbers], np.diff(np.append(starts, len(code))))
                for row in grams:
                    both = np.bincount(owner * (BUCKETS + 1) + row, minlength=len(langs) * (BUCKETS + 1))
                    counts += both.reshape(len(langs), BUCKETS + 1)[:, :BUCKETS]
        for k in range(len(langs)):
            at = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, k, np.int32)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[k][at], docs[k]))], names=["lang", "bucket", "n"])

    return run


def hash_bound(share: float, n: int) -> int:
    """The signed 64-bit hash up to which rows are taken, so that `share` of n are expected (all, if there are no more)."""
    return (1 << 63) - 1 if share >= n else int(share * (1 << 64) / n) - (1 << 63)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None, max_rows: int = MAX_TRAIN_ROWS, alpha: float = 0.1) -> Model:
    """Fit on rows with a non-null language.

    max_rows bounds the sample: of each language at most max_rows / languages rows are expected,
    chosen by a hash of key (default: of the text), so that the sample is the same on every run.
    """
    spark = labelled.sparkSession
    common.bound_batches(spark)
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.xxhash64((F.col(text) if key is None else key).cast("string"), F.lit("sample")).alias("k")).where("l is not null")
    sizes = {r.l: r["count"] for r in rows.groupBy("l").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.zeros(0), np.zeros((BUCKETS + 1, 0)))
    bounds = F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, hash_bound(max_rows / len(langs), n))])
    sample = rows.where(F.col("k") <= F.element_at(bounds, F.col("l"))).select("t", "l")
    counted = sample.repartition(8).mapInArrow(_count_partitions({l: k for k, l in enumerate(langs)}), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts, docs = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    own = counted[counted.bucket >= 0]
    counts[own.bucket, own.lang] = own.n
    rest = counted[counted.bucket < 0]
    docs[rest.lang] = rest.n
    log_probs = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * BUCKETS))
    return Model(langs, np.log((docs + 1) / (docs.sum() + len(langs))), np.vstack([log_probs, np.zeros(len(langs))]))


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    n, langs = len(texts), len(model.langs)
    sums, lettered = np.zeros((n, langs)), np.zeros(n, bool)
    for numbers, starts, code in _pieces(texts):
        grams, letter = _grams(code, starts)
        lettered[numbers[np.add.reduceat(letter, starts, dtype=np.int64) > 0]] = True
        for row in grams:
            for at in range(langs):  # a column at a time keeps the working set small
                np.add.at(sums[:, at], numbers, np.add.reduceat(model.log_probs[row, at], starts))
    if not langs:
        return ["und"] * n, np.zeros(n)
    total = sums + model.priors
    best = total.argmax(axis=1)
    top = total[np.arange(n), best]
    score = np.where(lettered, 1 / np.exp(total - top[:, None]).sum(axis=1), 0.0)
    return [model.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], score


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    shared = spark.sparkContext.broadcast(Model(model.langs, model.priors, np.asfortranarray(model.log_probs)))

    @F.arrow_udf("lang_pred string, score double")
    def scored(texts: pa.Array) -> pa.Array:
        langs, score = score_texts(shared.value, texts.to_pylist())
        common.release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score)], names=["lang_pred", "score"])

    out = common.without(docs, "lang_pred", "score")
    return out.withColumn("__s", scored(F.col(text))).select(*[f"`{c}`" for c in out.columns], "__s.lang_pred", "__s.score")
