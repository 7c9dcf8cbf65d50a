"""Top-k by inner product of dense vectors (id, vector, country)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .topk import top_k

#: Dense scores are rounded to so many places before they are ranked.
PLACES = 5
#: Candidates of one block of the exact search, and of one part of a cell.
BLOCK = 8192
#: Cells at most, and bytes of the sample that their centres are fitted on.
MOST_CELLS, SAMPLE_BYTES = 1024, 1 << 26
#: Cells that a query meets before bounds decide.
_FIRST = 2
#: Vectors that meet all centroids, or a block, at once.
_ROWS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def dense_top_k(queries: DataFrame, candidates: DataFrame, k: int = 30) -> DataFrame:
    """Exact: every query meets every candidate of its country (a stated query set against all rows). The candidates of a country
    are dealt to blocks of BLOCK rows; a query goes to each block of its country, and a task multiplies the queries with one
    block after another and keeps the k best of each."""
    c = candidates.select("country", "id", unit(F.col("vector")).alias("v"))
    q = queries.select("country", "id", unit(F.col("vector")).alias("v"))
    blocks = c.groupBy("country").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    filed = c.join(blocks, "country").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("kind", F.lit(0))
    asked = q.join(blocks, "country").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("kind", F.lit(1))
    columns = ("country", "block", "kind", "id", "v")
    rows = filed.select(*columns).union(asked.select(*columns)).repartition("country", "block").sortWithinPartitions("country", "block", "kind")
    return top_k(rows.mapInArrow(_block_top(k), _PAIRS), k)


_PAIRS = "country string, source1_entity_id string, candidate_entity_id string, similarity_score double"


def _block_top(k: int):
    """The k best of each query and block, of rows sorted by country, block and kind: candidates before queries."""

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)

    def run(batches):
        key, ids, parts, vectors = None, [], [], None
        for batch in batches:
            country, block, kind = (batch.column(c).to_pylist() for c in ("country", "block", "kind"))
            starts = [i for i in range(batch.num_rows) if not i or (country[i], block[i], kind[i]) != (country[i - 1], block[i - 1], kind[i - 1])]
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if (country[a], block[a]) != key:
                    key, ids, parts, vectors = (country[a], block[a]), [], [], None
                name, v = batch.column("id").slice(a, b - a).to_pylist(), matrix(batch.column("v").slice(a, b - a))
                if kind[a] == 0:
                    ids += name
                    parts.append(v)
                    continue
                if not ids:
                    continue
                vectors = np.concatenate(parts) if vectors is None else vectors
                for at in range(0, len(v), _ROWS):
                    score = np.round(v[at : at + _ROWS] @ vectors.T, PLACES)
                    m = min(k, score.shape[1])
                    least = np.partition(score, score.shape[1] - m, axis=1)[:, score.shape[1] - m]
                    out = []
                    for i, asked in enumerate(name[at : at + _ROWS]):
                        best = sorted(np.flatnonzero(score[i] >= least[i]).tolist(), key=lambda j: (-score[i, j], ids[j]))[:m]
                        out += [(country[a], asked, ids[j], float(score[i, j])) for j in best]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["country", "source1_entity_id", "candidate_entity_id", "similarity_score"])

    return run


def cells_for(n: int) -> int:
    return max(1, min(MOST_CELLS, int(4 * n**0.5)))


def _centres(x: np.ndarray, n: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centres of up to n cells of vectors; a cell that loses all its vectors keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([_nearest(x[k : k + 4096], centres)[0] for k in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        held, start = np.unique(own[order], return_index=True)
        centres[held] = np.add.reduceat(x[order], start) / np.diff(np.append(start, len(x)))[:, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T, 0))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _distances(x, centres)
    return d.argmin(axis=1), d.min(axis=1)


def _bound(distance: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest inner product that a unit vector can have with one within the radius of a point at this distance: by the
    triangle inequality it is at least the difference away. A zero vector, whose products are all zero, has a bound of zero or
    more as well."""
    return np.maximum(1 - 0.5 * np.maximum(distance - radius, 0) ** 2, 0) + 1.5 * 10**-PLACES


def _stacked(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


class _Cell:
    """Candidates of one part of a cell, in finer cells of their own with a centre and a radius each."""

    def __init__(self, ids: list[str], x: np.ndarray):
        own, distance = _nearest(x, centres := _centres(x, max(1, int(len(x) ** 0.5)), 1, 2))
        order = np.argsort(own, kind="stable")
        held, start = np.unique(own[order], return_index=True)
        self.ids, self.x, self.centres = np.array(ids, dtype=object)[order], x[order], centres[held]
        self.cuts, self.radius = np.append(start, len(x)), np.maximum.reduceat(distance[order], start)
        self.met = 0

    def hits(self, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score), by place, of the k best of each query that reach its least score. The finer cells come in
        the order of the best bound any query has for them, and a query's k-th best score passes on to the next."""
        bound, least = _bound(_distances(q, self.centres), self.radius), least.copy()
        at, row, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for cell in np.argsort(-bound.max(axis=0), kind="stable"):
            asked = np.flatnonzero(bound[:, cell] >= least)
            if not len(asked):
                continue
            a, b = self.cuts[cell], self.cuts[cell + 1]
            self.met += len(asked) * int(b - a)
            found = np.round(q[asked] @ self.x[a:b].T, PLACES)
            i, j = np.nonzero(found >= least[asked][:, None])
            at, row, score = np.concatenate([at, asked[i]]), np.concatenate([row, a + j]), np.concatenate([score, found[i, j]])
            order = np.lexsort((-score, at))
            at, row, score = at[order], row[order], score[order]
            last = np.arange(len(at)) - np.searchsorted(at, at) == k - 1
            least[at[last]] = score[last]
            kept = score >= least[at]
            at, row, score = at[kept], row[kept], score[kept]
        return at, row, score


def _cell_top(k: int, met=None):
    """The best of each query and part of a cell, of rows sorted by country, cell, part and kind: candidates before queries."""

    def run(batches):
        key, held, cell = None, [], None
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("country", "cell", "part", "kind")), strict=True))
            starts = [i for i in range(len(marks)) if not i or marks[i] != marks[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(marks)], strict=True):
                if marks[a][:3] != key:
                    key, held, cell = marks[a][:3], [], None
                some = batch.slice(a, b - a)
                if marks[a][3] == 0:
                    held.append(some)
                    continue
                if cell is None and held:
                    cell = _Cell([x for h in held for x in h.column("id").to_pylist()], np.concatenate([_stacked(h.column("v")) for h in held]))
                    held = []
                if cell is None:
                    continue
                names, least = some.column("id").to_pylist(), some.column("least").to_numpy()
                for at in range(0, len(names), _ROWS):
                    i, j, score = cell.hits(_stacked(some.column("v").slice(at, _ROWS)), least[at : at + _ROWS], k)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(i), pa.string()), pa.array([names[at + x] for x in i], pa.string()), pa.array(cell.ids[j], pa.string()), pa.array(score)], schema=_PAIR)
                if met is not None:
                    met.add(cell.met)
                    cell.met = 0

    return run


_PAIR = pa.schema([("country", pa.string()), ("source1_entity_id", pa.string()), ("candidate_entity_id", pa.string()), ("similarity_score", pa.float64())])


def cell_top_k(queries: DataFrame, candidates: DataFrame, k: int = 30, probes: int | None = None, cells: int | None = None, train_per_cell: int = 40, seed: int = 42, met=None) -> DataFrame:
    """Top-k by cells with bounds. Candidates lie in cells around centres, fitted on a bounded sample and small enough for a
    closure (MOST_CELLS vectors); a cell knows its radius. A query first meets its nearest cells, which gives it a score that its
    k-th best reaches at least; then it meets every other cell that can hold a better one by the triangle inequality, and in
    there only such finer cells. So nothing is lost: the result is that of dense_top_k(), for less work where vectors cluster. With
    probes a query meets its so many nearest cells only, and results are approximate. A cell of many candidates, such as
    copies, is dealt to parts. met: an accumulator for the pairs that were scored."""
    c = cut_lineage(candidates.select("country", "id", unit(F.col("vector")).alias("v")))
    q = queries.select("country", "id", unit(F.col("vector")).alias("v"))
    total, width = c.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return top_k(c.limit(0).select("country", F.col("id").alias("source1_entity_id"), F.col("id").alias("candidate_entity_id"), F.lit(0.0).alias("similarity_score")), k)
    cells = cells or cells_for(total)
    some = max(cells, min(cells * train_per_cell, SAMPLE_BYTES // (8 * width)))
    sample = c.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(some).select("v").toArrow().column(0).combine_chunks()
    centres = _centres(_stacked(sample), cells, seed)

    @F.pandas_udf("cell int, away double")
    def own(vectors: pd.Series) -> pd.DataFrame:
        found = [_nearest(np.stack(vectors.iloc[at : at + _ROWS].to_list()), centres) for at in range(0, len(vectors), _ROWS)]
        return pd.DataFrame({"cell": np.concatenate([f[0] for f in found]).astype(np.int32), "away": np.concatenate([f[1] for f in found])})

    filed = cut_lineage(c.withColumn("own", own("v")).select("country", "id", "v", "own.cell", "own.away"))
    radius = np.full(len(centres), -np.inf)  # an empty cell is met by none
    for r in filed.groupBy("cell").agg(F.max("away").alias("away")).collect():
        radius[r["cell"]] = r["away"] + 1e-9
    parts = filed.groupBy("country", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))

    def visited(first: bool):
        @F.pandas_udf("array<int>")
        def cells_of(vectors: pd.Series, least: pd.Series) -> pd.Series:
            out = []
            for at in range(0, len(vectors), _ROWS):
                d = _distances(np.stack(vectors.iloc[at : at + _ROWS].to_list()), centres)
                order = np.argsort(np.where(np.isfinite(radius), d, np.inf), axis=1, kind="stable")
                if first:
                    out += order[:, : probes or _FIRST].tolist()
                    continue
                can = _bound(d, radius) >= least.iloc[at : at + _ROWS].to_numpy()[:, None]
                can &= np.isfinite(radius)
                np.put_along_axis(can, order[:, :_FIRST], False, axis=1)
                out += [np.flatnonzero(x).tolist() for x in can]
            return pd.Series(out)

        return cells_of

    columns = ("country", "cell", "part", "kind", "id", "v", "least")

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        mine = filed.join(parts, ["country", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumns({"kind": F.lit(0), "least": F.lit(0.0)})
        to = asked.withColumn("cell", F.explode(visited(first)("v", "least"))).join(parts, ["country", "cell"])
        to = to.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(1))
        rows = mine.select(*columns).union(to.select(*columns)).repartition("country", "cell", "part").sortWithinPartitions("country", "cell", "part", "kind")
        return rows.mapInArrow(_cell_top(k, met), _PAIRS)

    near = top_k(searched(q.withColumn("least", F.lit(float("-inf"))), True), k)
    if probes:
        return near
    near = cut_lineage(near)
    least = near.where(F.col("rank") == k).select(F.col("source1_entity_id").alias("id"), "country", F.col("similarity_score").alias("least"))
    asked = q.join(least, ["country", "id"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return top_k(near.drop("rank").unionByName(searched(asked, False)), k)


def random_projection(postings: DataFrame, dimensions: int = 128, seed: int = 42) -> DataFrame:
    """(country, id, vector): unit postings projected to a few dimensions by signs of a hash of each gram, at length one."""
    weight = F.col("weight")
    sums = [F.sum(F.when(F.xxhash64("gram", F.lit(seed * 1000 + j)) % 2 == 0, weight).otherwise(-weight)).alias(f"x{j}") for j in range(dimensions)]
    vectors = postings.groupBy("country", "id").agg(*sums)  # a row for each record, not for each of its grams and dimensions
    return vectors.select("country", "id", unit(F.array(*(f"x{j}" for j in range(dimensions)))).alias("vector"))


def encode(texts: DataFrame, encoder, schema: str = "country string, id string, vector array<float>") -> DataFrame:
    """Vectors of (country, id, text) by a caller's encoder, a function from a list of texts to a matrix; it runs on Arrow
    batches in the workers."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"country": pdf["country"], "id": pdf["id"], "vector": list(np.asarray(encoder(pdf["text"].tolist()), dtype=np.float32))})

    return texts.select("country", "id", "text").mapInPandas(run, schema)
