"""Quality by votes of nearest neighbours among labelled latent-semantic vectors.

A text becomes a sparse vector of hashed terms: its words, the shapes of its tokens (case, and the marks at their ends), and
its repetitions (tokens that repeat the one before, words on lines that occurred before). Weights are square roots of term
shares times inverse document frequencies that one pass counts over all documents. A truncated singular value decomposition of
a bounded labelled sample gives the latent directions; the sample's latent vectors and labels are sent to every task, which
takes the exact cosine of each document with all of them, block by block, and lets the nearest vote by similarity.

Defined cases: a null or empty text has no vector and gets the share of good labels; so does every text if no row is labelled;
equal similarities count by the order of the sample, which is that of doc_id; repeated rows get equal scores; a labelled doc_id
with several texts votes with the least of them; a null doc_id has no label; an empty table gives no rows; further columns are
kept by scored(), whatever their names, and not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import batches_of, small_batches, table, unused
from .sampling import fold, labelled_sample

FOLDS, HELD_OUT = 3, 1
#: At most so many labelled rows of either class vote.
SAMPLE_PER_CLASS = 2048
#: Hashed terms: the first SHAPES are shapes and repetitions, the rest words.
SHAPES, DIMENSIONS = 1024, 4096
LATENT = 64
NEIGHBOURS = 31
#: Similarity counts to this power.
SHARPNESS = 8
#: Documents scored at a time.
BLOCK = 256

_MEMO = 200_000
#: Only lines of fewer characters can count as short.
_SHORT_LINE = 200
_SHAPE = re.compile(r"([^\W\d_]+)|(\d+)|([\W_]+)")


def _slot(name: str, low: int, high: int) -> int:
    return low + zlib.crc32(name.encode()) % (high - low)


def shape(token: str) -> str:
    """Case of letter runs, digits as 0, and other characters with longer runs cut to three."""
    out = []
    for letters, digits, rest in _SHAPE.findall(token):
        if letters:
            out.append("X" if len(letters) == 1 and letters.isupper() else "XX" if letters.isupper() else "a" if letters.islower() else "Aa" if letters.istitle() else "aA")
        else:
            out.append("0" if digits else rest[:3])
    return "".join(out[:6])


class Reader:
    """Sparse term counts of one text after another."""

    def __init__(self):
        #: Of a token, the slots of its shape and of its word in one number; DIMENSIONS stands for no word.
        self.memo: dict[str, int] = {}
        self.repeat, self.again, self.short = (_slot(x, 0, SHAPES) for x in ("repeated token", "repeated line", "short line"))

    def slots(self, token: str) -> int:
        word = "".join(c for c in token.lower() if c.isalnum())
        return _slot(shape(token), 0, SHAPES) << 16 | (_slot(word, SHAPES, DIMENSIONS) if word else DIMENSIONS)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Slots, their counts, and how many tokens there are."""
        tokens = text.split()
        found, memo = Counter(tokens), self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for token in found:
            if token not in memo:
                memo[token] = self.slots(token)
        at = np.fromiter(map(memo.__getitem__, found), dtype=np.int64, count=len(found))
        n = np.fromiter(found.values(), dtype=np.float64, count=len(found))
        total = np.bincount(at >> 16, n, DIMENSIONS) + np.bincount(at & 0xFFFF, n, DIMENSIONS + 1)[:DIMENSIONS]
        total[self.repeat] += 2 * sum(map(str.__eq__, tokens, tokens[1:]))
        lines = Counter(line for line in text.split("\n") if line.strip())
        for line, times in lines.items():
            if times > 1 or len(line) < _SHORT_LINE:
                size = len(line.split())
                total[self.again] += 2 * (times - 1) * size
                if size < 4:
                    total[self.short] += times * size
        at = np.flatnonzero(total)
        return at, total[at], len(tokens)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have each term, and how many there are, over all documents."""
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64())])

    def run(batches):
        reader, total = Reader(), np.zeros(DIMENSIONS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[reader.counts(text.as_py() or "")[0]] += 1
                total[-1] += 1
        return batches_of(((int(i), int(total[i])) for i in np.flatnonzero(total)), schema)

    out = np.zeros(DIMENSIONS + 1)
    sums = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # DIMENSIONS + 1 rows at most
        out[r["slot"]] = r["n"]
    return out[:-1], int(out[-1])


def _rows(found: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray) -> np.ndarray:
    """Unit rows of weights; a row without terms stays zero."""
    out = np.zeros((len(found), DIMENSIONS), dtype=np.float32)
    for k, (at, n, size) in enumerate(found):
        out[k, at] = np.sqrt(n / max(size, 1)) * idf[at]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def truncated_svd(x: np.ndarray, k: int, seed: int = 7, rounds: int = 4) -> np.ndarray:
    """Right singular directions by subspace iteration, as columns."""
    k = min(k, *x.shape)
    basis = np.linalg.qr(x.T @ (x @ np.random.default_rng(seed).standard_normal((x.shape[1], min(k + 8, x.shape[1]))).astype(np.float32)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ right.T[:, :k]).astype(np.float32)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest values of each row, in their order; equal ones go to the first columns."""
    near = np.sort(np.argpartition(-cosine, k - 1, axis=1)[:, :k], axis=1)
    least = np.take_along_axis(cosine, near, axis=1).min(axis=1)
    for row in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k):
        near[row] = np.sort(np.argsort(-cosine[row], kind="stable")[:k])
    return near


class Model:
    def __init__(self, idf: np.ndarray | None, directions: np.ndarray | None, vectors: np.ndarray | None, votes: np.ndarray | None, weights: np.ndarray | None, prior: float):
        self.idf, self.directions, self.vectors, self.votes, self.weights, self.prior = idf, directions, vectors, votes, weights, prior

    def latent(self, found) -> np.ndarray:
        z = _rows(found, self.idf).astype(np.float64) @ self.directions
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, found) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(found), self.prior)
        # The last digits of a product hang on the rows beside it, so they are rounded away: equal texts get equal scores.
        cosine = np.round(self.latent(found) @ self.vectors.T, 9)
        k = min(NEIGHBOURS, cosine.shape[1])
        near = nearest(cosine, k)
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS * self.weights[near]
        total = weight.sum(axis=1)
        return np.where(total > 1e-9, (weight * self.votes[near]).sum(axis=1) / np.maximum(total, 1e-9), self.prior)


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    small_batches(docs.sparkSession)
    sample, stands_for = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, sample_per_class)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.float64())), ("size", pa.int64())])

    def read(batches):
        reader = Reader()
        rows = (
            (doc, label, *reader.counts(text.as_py() or ""))
            for batch in batches
            for doc, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
        )
        return batches_of(rows, schema, 256)

    got = sample.select("doc_id", "label", "text").mapInArrow(read, "doc_id long, label int, at array<int>, n array<double>, size long").orderBy("doc_id").collect()
    weights = np.array([stands_for[r["label"]] for r in got])
    votes = np.array([float(r["label"]) for r in got])
    if not len(got):
        return Model(None, None, None, None, None, 0.0)
    prior = float((weights * votes).sum() / weights.sum())
    frequency, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    idf[:SHAPES] += 1.0  # shapes and repetitions speak of quality more than words do
    found = [(np.array(r["at"], dtype=np.int64), np.array(r["n"]), r["size"]) for r in got]
    x = _rows(found, idf)
    directions = truncated_svd(x, LATENT).astype(np.float64)
    model = Model(idf, directions, None, votes, weights, prior)
    model.vectors = model.latent(found)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with the column quality__ (quality___ where docs has that), from 0 to 1. The model is at most 2 * SAMPLE_PER_CLASS vectors of LATENT
    numbers and DIMENSIONS * LATENT directions, about four megabytes, so it is sent to every task."""
    small_batches(docs.sparkSession)
    name = unused(docs.columns, "quality__")[0]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader, model = Reader(), sent.value
        for batch in batches:
            score: list[float] = []
            for a in range(0, batch.num_rows, BLOCK):
                score += model.scores([reader.counts(x.as_py() or "") for x in batch.column("text").slice(a, BLOCK)]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        F.col("quality__").alias("score"),
        F.when(F.col("quality__") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
