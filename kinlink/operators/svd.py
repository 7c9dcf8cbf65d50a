"""Truncated singular value decomposition of sparse postings, with explained variance.

The matrix of records and grams is cut into blocks of some thousand records by some thousand grams, each one row of a table. A
random subspace of the grams' side is multiplied with the matrix and back (subspace iteration), made orthonormal by the sums of
its blocks' small Gram matrices, and turned at the end to the directions of largest variance. Products meet by joins of blocks
with the matching piece of the thin matrix and are added up by key, so neither the matrix nor a thin factor is ever whole in one
task or in the driver; the driver sees square matrices of the subspace's size only.

Defined cases: grams outside the fitted ones are dropped; a record without any of them has no row; more components than the
matrix has rank give singular values of zero and no direction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_shuffle, cut_lineage
from .dense import unit

#: Records, or grams, of one block on average.
SIDE = 2048
#: Partial sums that a task holds at a time, and records that are multiplied at a time.
_SUMS, _ROWS = 16, 512


def _placed(keys: DataFrame, columns: list[str], name: str, sides: int) -> DataFrame:
    """Distinct keys with the block they are dealt to, their place in it, and its size."""
    block = F.pmod(F.xxhash64(*columns), F.lit(sides)).cast("int")
    own = Window.partitionBy(name)
    rows = keys.withColumn(name, block).withColumn(f"{name}_at", (F.row_number().over(own.orderBy(*columns)) - 1).cast("int"))
    return rows.withColumn(f"{name}_size", F.count("*").over(own).cast("int"))


def _blocks(postings: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(records with their places, blocks of the matrix, into how many the records are dealt)."""
    known = postings.join(features, "gram")
    ids = cut_lineage(known.select("country", "id").distinct())
    sides = max(1, -(-ids.count() // SIDE))
    rows = cut_lineage(_placed(ids, ["country", "id"], "block", sides))
    entry = F.struct("block_at", "chunk_at", "weight")
    blocks = known.join(by_shuffle(rows), ["country", "id"]).groupBy("block", "block_size", "chunk", "chunk_size").agg(F.collect_list(entry).alias("entries"))
    return rows, cut_lineage(blocks), sides


def _matrix(data: pa.Scalar | bytes, width: int) -> np.ndarray:
    return np.frombuffer(data.as_buffer() if isinstance(data, pa.Scalar) else data, dtype=np.float64).reshape(-1, width)


def _added(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(key, matrix): the sum of the matrices of each key, one in memory at a time."""

    def run(batches):
        now, total = None, None
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k == now:
                    total += _matrix(data, width)
                    continue
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=[key, "matrix"])
                now, total = k, _matrix(data, width).copy()
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=[key, "matrix"])

    return rows.select(key, "matrix").repartition(key).sortWithinPartitions(key).mapInArrow(run, f"{key} int, matrix binary")


def _times(blocks: DataFrame, thin: DataFrame, key: str, out: str, width: int, pieces: int) -> DataFrame:
    """The product of the matrix (key chunk) or of its transpose (key block) with a thin one (key, matrix) of so many pieces, by
    the other key."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}

        def flushed():
            for k, total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=[out, "matrix"])
            sums.clear()

        for batch in batches:
            names, sizes, other = (batch.column(c).to_pylist() for c in (out, f"{out}_size", f"{key}_size"))
            for k, size, span, entries, data in zip(names, sizes, other, batch.column("entries"), batch.column("matrix"), strict=True):
                flat = entries.values
                row, column, weight = (flat.field(c).to_numpy() for c in (f"{out}_at", f"{key}_at", "weight"))
                if k not in sums:
                    if len(sums) >= _SUMS:
                        yield from flushed()
                    sums[k] = np.zeros((size, width))
                thin_part, order = _matrix(data, width), np.argsort(row, kind="stable")
                row, column, weight = row[order], column[order], weight[order]
                for at in range(0, size, _ROWS):
                    a, b = np.searchsorted(row, [at, at + _ROWS])
                    if a < b:
                        piece = np.zeros((min(_ROWS, size - at), span))
                        piece[row[a:b] - at, column[a:b]] = weight[a:b]
                        sums[k][at : at + _ROWS] += piece @ thin_part
        yield from flushed()

    # A thin matrix grows with the table, and Spark's estimates know nothing of what mapInArrow() made, so it is never sent
    # through the driver. Where it has few pieces, each goes to several lanes, as very many blocks share it.
    lanes = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")) // pieces)
    dealt = blocks.withColumn("lane", F.pmod(F.xxhash64(out), F.lit(lanes)).cast("int"))
    copies = thin.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    met = dealt.join(by_shuffle(copies), [key, "lane"]).select(out, f"{out}_size", f"{key}_size", "entries", "matrix")
    return _added(met.mapInArrow(run, f"{out} int, matrix binary"), out, width)


def _turned(thin: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    """A thin matrix times a small one."""
    width = by.shape[0]

    def run(batches):
        for batch in batches:
            found = [(_matrix(data, width) @ by).tobytes() for data in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=[key, "matrix"])

    return thin.select(key, "matrix").mapInArrow(run, f"{key} int, matrix binary")


def _gram(thin: DataFrame, width: int) -> np.ndarray:
    """The inner products of a thin matrix's columns and of a column of ones: partitions add theirs up, then one task those."""

    def run(batches):
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            for data in batch.column(0):
                part = _matrix(data, width)
                part = np.concatenate([part, np.ones((len(part), 1))], axis=1)
                total += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["one", "matrix"])

    found = _added(thin.select("matrix").mapInArrow(run, "one int, matrix binary"), "one", width + 1).first()
    return _matrix(bytes(found["matrix"]), width + 1).copy() if found else np.zeros((width + 1, width + 1))


def _whitening(gram: np.ndarray) -> np.ndarray:
    """What makes columns with these inner products orthonormal; directions without any length go."""
    values, vectors = np.linalg.eigh(gram)
    kept = values > max(values.max(initial=0), 0) * 1e-13
    return vectors[:, kept] / np.sqrt(values[kept])


@dataclass(frozen=True)
class Decomposition:
    #: (gram, chunk, chunk_at, chunk_size), and the right singular vectors by chunk.
    features: DataFrame
    right: DataFrame
    singular_values: np.ndarray
    #: The share of the records' variance that each component has.
    explained: np.ndarray

    @property
    def components(self) -> int:
        return len(self.singular_values)

    def transform(self, postings: DataFrame, unit_length: bool = True) -> DataFrame:
        """(country, id, vector) for the records of postings (country, id, gram, weight), of any table."""
        rows, blocks, _ = _blocks(postings, self.features)
        chunks = max(1, self.features.select("chunk").distinct().count())
        return self.vectors(rows, _times(blocks, self.right, "chunk", "block", self.components, chunks), unit_length)

    def vectors(self, rows: DataFrame, thin: DataFrame, unit_length: bool = True) -> DataFrame:
        width = self.components

        def run(batches):
            for batch in batches:
                for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    part = _matrix(data, width)
                    at = pa.array(np.arange(len(part), dtype=np.int32))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, dtype=np.int32)), at, flat], names=["block", "block_at", "vector"])

        told = thin.select("block", "matrix").mapInArrow(run, "block int, block_at int, vector array<double>")
        found = rows.join(by_shuffle(told), ["block", "block_at"]).select("country", "id", "vector")
        return found.withColumn("vector", unit(F.col("vector"))) if unit_length else found


def truncated_svd(postings: DataFrame, components: int = 128, iterations: int = 6, oversample: int = 32, seed: int = 42) -> Decomposition:
    """Fits on postings (country, id, gram, weight); a sample of the records fits as well, and transform() takes all."""
    grams = cut_lineage(postings.select("gram").distinct())
    chunks = max(1, -(-grams.count() // SIDE))
    features = cut_lineage(_placed(grams, ["gram"], "chunk", chunks))
    rows, blocks, sides = _blocks(postings, features)
    width = components + oversample

    def start(batches):
        for batch in batches:
            found = [np.random.default_rng([seed, k]).standard_normal((n, width)).tobytes() for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["chunk", "matrix"])

    right = features.select("chunk", "chunk_size").distinct().mapInArrow(start, "chunk int, matrix binary")
    for _ in range(iterations):
        back = cut_lineage(_times(blocks, _times(blocks, right, "chunk", "block", width, chunks), "block", "chunk", width, sides))
        by = _whitening(_gram(back, width)[:-1, :-1])
        right, width = _turned(back, "chunk", by), by.shape[1]
        if not width:
            return Decomposition(features, right, np.zeros(0), np.zeros(0))
    left = cut_lineage(_times(blocks, right, "chunk", "block", width, chunks))
    gram = _gram(left, width)
    n, sums = gram[-1, -1], gram[-1, :-1]
    values, turn = np.linalg.eigh(gram[:-1, :-1])
    order = np.argsort(-values)[:components]
    values, turn = np.maximum(values[order], 0), turn[:, order]
    turn = turn * np.where(turn[np.abs(turn).argmax(axis=0), np.arange(turn.shape[1])] < 0, -1.0, 1.0)
    variance = values / n - (sums @ turn / n) ** 2
    by_gram = postings.groupBy("gram").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
    total = by_gram.agg(F.sum(F.col("q") / n - (F.col("s") / n) ** 2)).first()[0]
    return Decomposition(features, cut_lineage(_turned(right, "chunk", turn)), np.sqrt(values), variance / total if total else variance * 0)
