"""Quality scores: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

A word stands for three tokens: a bucket of its hash, its shape (case, digits, symbols, length), and its step from the word before (a bucket of both
shapes, and whether it is the same word again). Every token has a sparse random index vector; a token's word vector is its index vector plus the
mean of the index vectors of its neighbours' tokens of that kind in all documents. A document is the mean of its words' vectors, one mean for each kind
of token, and nothing else.

The network is fitted on at most `most` labelled rows (a parameter), balanced by class, outside the held-out fold; then its logits are
scaled by a temperature that is set on a fifth of them, and moved to the labels' own prior. Every row is scored by its whole text.

Defined cases: null and empty texts get the score of a text without words. Without labels of both classes every score is the prior
(0.5 without labels). Rows with equal ids are scored each by its text. Extra columns are ignored; lang, source and id are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._fit import Constant, Network, fold, sample
from ._words import U64, chunks, hashes, mix, spans

WORDS, SHAPES, STEPS, DIM = 8192, 1024, 1024, 32
TOKENS = WORDS + SHAPES + STEPS
#: Rows of each label that the model is fitted on at most.
MOST = 3000
#: Bytes of text taken at a time: whole rows, whose arrays of 8 bytes a byte and of DIM numbers a word stay in the processor's cache.
BLOCK = 1 << 16


def _index() -> np.ndarray:
    """Index vectors: four entries of +1 or -1 for each token."""
    rng = np.random.default_rng(11)
    out = np.zeros((TOKENS, DIM), np.float32)
    at = rng.integers(0, DIM, (TOKENS, 4))
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (TOKENS, 4)), 1)
    return out


def _class(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], np.int32)


UPPER, DIGIT = _class(lambda b: 65 <= b <= 90), _class(lambda b: 48 <= b <= 57)
SYMBOL = _class(lambda b: 33 <= b <= 126 and not chr(b).isalnum())


#: The three in one number, so that one prefix sum counts them all.
BITS = 21
CLASSES = UPPER.astype(np.int64) | DIGIT.astype(np.int64) << BITS | SYMBOL.astype(np.int64) << 2 * BITS
#: Steps of a word's length.
LENGTHS = np.minimum(np.log2(np.arange(64) + 1).astype(int), 6)


def _sums(table: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[data], out=sums[1:])
    return sums[end] - sums[start]


def _counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, together: int = 1 << BITS):
    """Upper-case letters, digits and symbols of each word. Prefix sums may run over; the sum of a word may not, so longer data is counted by class."""
    if len(data) >= together:
        return tuple(_sums(t, data, start, end) for t in (UPPER, DIGIT, SYMBOL))
    sums = _sums(CLASSES, data, start, end)
    low = (1 << BITS) - 1
    return sums & low, sums >> BITS & low, sums >> 2 * BITS


def _features(data: np.ndarray, offs: np.ndarray):
    """(tokens of each word by kind, words of each row)."""
    start, end = spans(data, offs)
    word, counts = hashes(data, offs, edges=(start, end))
    if len(start) != len(word):  # words of very long rows are hashed in parts, with the same edges
        raise AssertionError("word edges differ")
    size = end - start
    upper, digit, symbol = _counts(data, start, end)
    letters = size - digit - symbol
    case = np.where(upper == 0, 0, np.where((upper >= 2) & (2 * upper >= letters), 2, 1))
    shape = ((case * 4 + np.minimum(symbol, 3)) * 3 + np.where(digit == 0, 0, np.where(digit < letters, 1, 2))) * 7 + LENGTHS[np.minimum(size, 63)]
    ends = np.cumsum(counts)
    before, again = np.full(len(word), SHAPES), np.zeros(len(word), np.int64)
    before[1:], again[1:] = shape[:-1], word[1:] == word[:-1]
    first = (ends - counts)[counts > 0]
    before[first], again[first] = SHAPES, 0
    half = STEPS // 2
    step = (mix((before * 2 * SHAPES + shape).astype(np.uint64)) % U64(half)).astype(np.int64) + again * half
    return ((mix(word) % U64(WORDS)).astype(np.int64), WORDS + shape % SHAPES, WORDS + SHAPES + step), counts


def _pool(vectors: np.ndarray, kinds, counts) -> np.ndarray:
    out = np.zeros((len(counts), len(kinds) * DIM))
    some = np.flatnonzero(counts)
    if len(some):
        first = (np.cumsum(counts) - counts)[some]
        for k, tokens in enumerate(kinds):
            out[some, k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors[tokens], first, axis=0) / counts[some, None]
    return out


def _contexts(batches):
    """Sums of neighbours' index vectors by token, of one task; all are whole numbers, so their order doesn't matter."""
    index = _index()
    place = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :4]  # an index vector has four entries at most
    value = np.take_along_axis(index, place, axis=1).astype(np.float64)
    sums, seen = np.zeros((TOKENS, DIM)), np.zeros(TOKENS)
    pairs = [(WORDS, np.zeros((SHAPES, SHAPES), np.int64)), (WORDS + SHAPES, np.zeros((STEPS, STEPS), np.int64))]

    def meet(left, right, times):
        for k in range(0, len(left), BLOCK):
            part = slice(k, k + BLOCK)
            for a, b in ((left[part], right[part]), (right[part], left[part])):
                np.add.at(sums.reshape(-1), ((a * DIM)[:, None] + place.take(b, axis=0)).ravel(), (value.take(b, axis=0) * times[part, None]).ravel())
                np.add.at(seen, a, times[part])

    for batch in batches:
        for _, data, offs in chunks(batch.column(1), BLOCK):
            (word, *others), counts = _features(data, offs)
            inside = np.ones(len(word) + 1, bool)
            inside[np.cumsum(counts)] = inside[0] = False
            near = np.flatnonzero(inside[:-1])  # words with one before them in their row
            meet(word[near - 1], word[near], np.ones(len(near)))
            # shapes and steps are few: their pairs are counted, and meet once
            for tokens, (first, met) in zip(others, pairs, strict=True):
                np.add.at(met.reshape(-1), (tokens[near - 1] - first) * len(met) + (tokens[near] - first), 1)
    for first, met in pairs:
        left, right = np.nonzero(met)
        meet(first + left, first + right, met[left, right].astype(np.float64))
    if seen.any():
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["token", "seen", "sums"])


def _inputs(vectors):
    def inputs(batches):
        for batch in batches:
            out = []
            for _, data, offs in chunks(batch.column(1), BLOCK):
                out += list(_pool(vectors.value, *_features(data, offs)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["label", "x"])

    return inputs


def _score(shared):
    def score(batches):
        vectors, model = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for _, data, offs in chunks(batch.column(1), BLOCK):
                out.append(model.probability(_pool(vectors, *_features(data, offs))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(out))], names=["id", "held_out", "score"])

    return score


def fit(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, allowed, most: int, seed: int):
    """(word vectors of all documents, model from at most `most` rows of each label); docs has columns id and text."""
    spark = docs.sparkSession
    picked, totals = sample(labels, id_col, label_col, allowed, {0: most, 1: most}, seed)
    zero = np.zeros((TOKENS, DIM), np.float32)
    if len({label for _, label in picked}) < 2:
        n = sum(totals.values())
        return zero, Constant(totals.get(1, 0) / n if n else 0.5)
    kind = docs.schema["id"].dataType.simpleString()
    ids = spark.createDataFrame(picked, f"_id {kind}, label int")
    rows = docs.join(F.broadcast(ids), F.col("id") == F.col("_id")).select("label", "text")
    sums, seen = np.zeros((TOKENS, DIM)), np.zeros(TOKENS)
    # neighbours need no labels: they are counted over all documents, the network is fitted on the sample
    parts = docs.select("id", "text").mapInArrow(_contexts, "token int, seen double, sums array<double>").groupBy("token").agg(F.sum("seen").alias("seen"), F.array(*[F.sum(F.col("sums")[k]) for k in range(DIM)]).alias("sums"))
    for r in parts.collect():
        sums[r.token], seen[r.token] = r.sums, r.seen
    vectors = _index() + sums / np.maximum(seen, 1)[:, None]
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]).astype(np.float32)
    # in an order of their own, as the network takes rows by place; Spark's sort would compute them twice to find its ranges
    got = sorted(rows.mapInArrow(_inputs(spark.sparkContext.broadcast(vectors)), "label int, x array<double>").collect())
    y, x = np.array([r.label for r in got]), np.array([r.x for r in got])
    if len(set(y.tolist())) < 2:
        return zero, Constant(float(totals.get(1, 0) / sum(totals.values())))
    model = Network().fit(x, y)
    had, true = y.mean(), totals[1] / (totals[0] + totals[1])
    model.shift = float(np.log(true / (1 - true)) - np.log(had / (1 - had)))
    return vectors, model


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3, most: int = MOST, seed: int = 5) -> DataFrame:
    """One row for each of `df`'s: id, held_out, score (probability of label 1), predicted (1 if score >= threshold)."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, label_col, fold(F.col(id_col), folds) != held, most, seed))
    kind = docs.schema["id"].dataType.simpleString()
    out = docs.select("id", "text", (fold(F.col("id"), folds) == held).alias("held_out")).mapInArrow(_score(shared), f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
