"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, and each half is quantised by its own codebook, so the pairs of centroids are the cells of a
fine grid. Every distinct vector is an entry of its cell. A query walks the pairs of centroids in order of their summed
distances to its halves, by a heap over the two sorted lists, until the cells it has visited hold enough entries; the entries of
these cells are ranked by their exact inner products. For the cells, an entry has one more coordinate that brings all to the
length of the longest, and a query has 0 there: the order of distances is then that of inner products.

How many entries are enough is measured on the table itself: a bounded sample of the queries is searched exactly against all
entries, and the traversal goes on for as long as the share RECALL of their nearest neighbours needs. On clustered vectors that
is a small part of the entries, on isotropic ones of many dimensions it is a large one.

Entries are dealt to blocks of bounded bytes in the order of their cells; a frequent cell has several blocks. A query is sent
to the blocks of its cells with the radius of its traversal, which tells there what it has visited. Equal vectors are one entry
with their smallest ids: no more of them can be among the nearest, so copies need no pairs of their own, and equal queries are
searched once.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those whose
dimension differs from that of the smallest valid id; ties go to the smaller id; an id that repeats is one candidate and one
query, with the least of its vectors in order of their components; a query with fewer candidates gets all it finds; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, record_batch, small_batches, table

TOP = 20
QUERY_STEP = 20
#: Share of the nearest neighbours of the measured queries that the traversal has to reach, and how many are measured at most.
RECALL, MEASURED = 0.96, 256
#: Entries that a traversal holds at least, where the table has as many: less than a block's product, so fewer save nothing.
LEAST_ENTRIES = 512
#: Distinct vectors that the codebooks are fitted on, at most; every vector is indexed.
SAMPLE = 16384
ROUNDS = 12
#: Bytes of the vectors of one block, at most; entries of one block, at least.
BLOCK_BYTES, LEAST_BLOCK = 1 << 24, 256
#: Queries that meet a block at once.
QUERIES = 128


def centroids_for(entries: int) -> int:
    """Centroids of a half: 4 n^(1/4), within 64 and 1024, so a cell table has 2^20 counts at most."""
    return int(min(1024, max(64, 4 * entries**0.25)))


def kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """At most k centroids of the points."""
    points = np.unique(points, axis=0)
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        sizes = np.bincount(own, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.split = first.shape[1]
        self.counts = np.zeros((len(first), len(second)), dtype=np.int64)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return nearest(vectors[:, : self.split], self.first) * len(self.second) + nearest(vectors[:, self.split :], self.second)

    def distances(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a query's halves to the centroids."""
        return ((self.first - query[: self.split]) ** 2).sum(axis=1), ((self.second - query[self.split :]) ** 2).sum(axis=1)

    def visit(self, query: np.ndarray, enough: int) -> list[int]:
        """Cells in order of summed distance until they hold enough entries, by a heap over the two sorted lists: a pair is
        pushed once both its predecessors in the grid have been taken."""
        a, b = self.distances(query)
        ia, ib = a.argsort(), b.argsort()
        da, db, ia, ib = a[ia].tolist(), b[ib].tolist(), ia.tolist(), ib.tolist()
        counts, width = self.counts, len(ib)
        heap, reached, out, held = [(da[0] + db[0], 0, 0)], [0] * len(ia), [], 0
        # reached[x]: how many of row x have been taken; (x, y) may follow once (x - 1, y) and (x, y - 1) have.
        while heap and held < enough:
            _, x, y = heapq.heappop(heap)
            reached[x] = y + 1
            n = int(counts[ia[x], ib[y]])
            if n:
                out.append(ia[x] * width + ib[y])
                held += n
            if y + 1 < width and (x == 0 or reached[x - 1] > y + 1):
                heapq.heappush(heap, (da[x] + db[y + 1], x, y + 1))
            if x + 1 < len(ia) and reached[x + 1] == y:
                heapq.heappush(heap, (da[x + 1] + db[y], x + 1, y))
        return out

    def needed(self, query: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For each cell how many entries the traversal holds once it has visited that cell."""
        a, b = self.distances(query)
        sums = (a[:, None] + b[None, :]).ravel()
        order = sums.argsort(kind="stable")
        held = np.empty(len(order), dtype=np.int64)
        held[order] = self.counts.ravel()[order].cumsum()
        return held[cells]


def completed(vectors: np.ndarray, most: float) -> np.ndarray:
    """Vectors with a further coordinate that brings their squared lengths to `most`."""
    return np.hstack([vectors, np.sqrt(np.maximum(0.0, most - (vectors * vectors).sum(axis=1)))[:, None]])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    good = embeddings.where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        & F.exists("embedding", lambda x: x.cast("double") != 0)
    ).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    size = good.agg(F.min_by(F.size("embedding"), "vec_id")).first()[0]
    return good.where(F.size("embedding") == F.lit(size if size is not None else -1))


@dataclass
class Fitted:
    index: MultiIndex
    #: Squared length to which vectors are completed; distinct vectors; how many of them a traversal has to hold.
    most: float
    entries: int
    enough: int


def _one_vector_an_id(rows: DataFrame) -> DataFrame:
    prints = rows.groupBy("vec_id").agg(F.min(F.xxhash64("embedding")).alias("a"), F.max(F.xxhash64("embedding")).alias("b"))
    twice = cut_lineage(prints.where("a <> b").select("vec_id"))
    if twice.isEmpty():
        return rows
    least = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows.join(twice, "vec_id", "left_anti").unionByName(least)


def fitted(entries: DataFrame, asked: DataFrame, top: int = TOP, recall: float = RECALL) -> tuple[Fitted | None, DataFrame]:
    """The index of entries (embedding, ids, entry), fitted and measured, and the entries with their cells; None for an empty
    table. asked has the entries that queries stand at."""
    n = entries.count()
    if not n:
        return None, entries.withColumn("cell", F.lit(0).cast("long"))
    sample = entries.select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE).collect()
    points = np.array([r["embedding"] for r in sample])
    split = points.shape[1] // 2
    most = entries.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    points = completed(points, most)
    k = centroids_for(n)
    index = MultiIndex(kmeans(points[:, :split], k), kmeans(points[:, split:], k))
    width = len(index.second)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                cell = index.cells(completed(_matrix(batch.column("embedding")), most))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=[*batch.schema.names, "cell"])

    celled = cut_lineage(entries.mapInArrow(assign, "embedding array<double>, ids array<long>, entry long, cell long"))
    for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect():  # 2^20 cells at most
        index.counts[r["cell"] // width, r["cell"] % width] = r["n"]

    # The sample of queries, searched exactly.
    chosen = celled.join(F.broadcast(asked.select("entry").distinct().orderBy(F.xxhash64("entry")).limit(MEASURED)), "entry").select("entry", "embedding").collect()
    if not chosen:
        return Fitted(index, most, n, n), celled
    own, queries = [r["entry"] for r in chosen], np.array([r["embedding"] for r in chosen])

    def exact(batches):
        best = np.full((len(queries), top + 1), -np.inf)
        where, whose = np.zeros(best.shape, dtype=np.int64), np.zeros(best.shape, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            score = np.hstack([best, queries @ _matrix(batch.column("embedding")).T])
            at = np.argpartition(-score, top, axis=1)[:, : top + 1]
            best = np.take_along_axis(score, at, axis=1)
            every = np.broadcast_to(batch.column("cell").to_numpy(), (len(queries), batch.num_rows))
            where = np.take_along_axis(np.hstack([where, every]), at, axis=1)
            every = np.broadcast_to(batch.column("entry").to_numpy(), (len(queries), batch.num_rows))
            whose = np.take_along_axis(np.hstack([whose, every]), at, axis=1)
        q, j = np.nonzero(best > -np.inf)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, j]), pa.array(where[q, j]), pa.array(whose[q, j])], names=["q", "score", "cell", "entry"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "entry")
    true = celled.mapInArrow(exact, "q int, score double, cell long, entry long")
    true = true.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top + 1).collect()  # MEASURED * (top + 1) rows
    needed: list[np.ndarray] = []
    for q, vector in enumerate(queries):
        cells = np.array([r["cell"] for r in true if r["q"] == q and r["entry"] != own[q]][:top], dtype=np.int64)
        needed.append(index.needed(np.append(vector, 0.0), cells))
    needed = np.sort(np.concatenate(needed))
    enough = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else n
    return Fitted(index, most, n, max(enough, LEAST_ENTRIES)), celled


def search(embeddings: DataFrame, query_step: int = QUERY_STEP, top: int = TOP, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) for every valid row whose vec_id is divisible by query_step, against all others."""
    spark = embeddings.sparkSession
    small_batches(spark, 2048)
    rows = _one_vector_an_id(valid(embeddings))
    keep = top + 1  # one may be the query itself
    # The smallest ids of every distinct vector; the limit on the rank is taken before the shuffle too.
    ranked = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= keep)
    entries = ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.col("ids")[0])
    entries = cut_lineage(entries)
    asked = rows.where(F.col("vec_id") % query_step == 0).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    asked = cut_lineage(asked.join(entries.select("embedding", "entry"), "embedding").select("query_id", "entry"))
    out_type = "query_id long, rank int, vec_id long, score double"
    fit, celled = fitted(entries, asked, top, recall)
    if fit is None:
        return spark.createDataFrame([], out_type)
    index, enough, width = fit.index, fit.enough, len(fit.index.second)
    # Entries in the order of their cells fill blocks; small tables have as many blocks as keep all cores busy.
    size = max(1, len(celled.first()["embedding"]))
    block = min(max(1024, BLOCK_BYTES // (8 * size)), max(LEAST_BLOCK, -(-fit.entries // (2 * spark.sparkContext.defaultParallelism))))
    ends = index.counts.ravel().cumsum()
    sent = spark.sparkContext.broadcast((index, ends))

    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("cell", pa.int64()), ("vector", pa.list_(pa.float64())), ("radius", pa.float64()), ("ids", pa.list_(pa.int64()))])
    ddl = "block long, kind int, id long, cell long, vector array<double>, radius double, ids array<long>"

    def deal(batches):
        index, ends = sent.value
        sizes = index.counts.ravel()
        for batch in batches:
            m = batch.num_rows
            cell, entry = batch.column("cell").to_numpy(), batch.column("entry").to_numpy()
            mixed = (entry.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            at = (ends[cell] - sizes[cell] + (mixed % np.maximum(sizes[cell], 1).astype(np.uint64)).astype(np.int64)) // block
            columns = [pa.array(at), pa.array(np.zeros(m, np.int32)), batch.column("entry"), batch.column("cell"), batch.column("embedding"), pa.nulls(m, pa.float64()), batch.column("ids")]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def probe(batches):
        index, ends = sent.value
        sizes = index.counts.ravel()
        for batch in batches:
            for entry, vector in zip(batch.column("entry").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                query = np.array([*vector, 0.0])
                cells = np.array(index.visit(query, enough), dtype=np.int64)
                near, far = index.distances(query)
                radius = near[cells[-1] // width] + far[cells[-1] % width]  # of the last cell, the farthest one
                first, last = (ends[cells] - sizes[cells]) // block, (ends[cells] - 1) // block
                blocks = np.unique(np.concatenate([first, last, *(np.arange(a, b) for a, b in zip(first, last, strict=True) if b - a > 1)]))
                m = len(blocks)
                yield record_batch(schema, [blocks, np.ones(m, np.int32), np.full(m, entry), np.full(m, -1), [vector] * m, np.full(m, radius), [None] * m])

    searched = asked.select("entry").distinct().join(celled, "entry")
    dealt = celled.mapInArrow(deal, ddl).union(searched.select("entry", "embedding").mapInArrow(probe, ddl))
    dealt = dealt.repartition(int((ends[-1] - 1) // block) + 1, "block").sortWithinPartitions("block", "kind")
    found_schema = pa.schema([("entry", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def rank(batches):
        index, _ = sent.value
        held, parts = None, []
        vectors = cells = ids = None
        for batch in batches:
            at_block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(at_block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at_block)], strict=True):
                if a == b:
                    continue
                if at_block[a] != held:
                    held, parts, vectors = int(at_block[a]), [], None
                piece = batch.slice(a, b - a)
                if kind[a] == 0:
                    parts.append(piece)
                    continue
                if not parts and vectors is None:
                    continue
                if parts:
                    vectors = np.concatenate([_matrix(p.column("vector")) for p in parts])
                    cells = np.concatenate([p.column("cell").to_numpy() for p in parts])
                    ids = [x for p in parts for x in p.column("ids").to_pylist()]
                    parts = []
                for at in range(0, piece.num_rows, QUERIES):
                    some = piece.slice(at, QUERIES)
                    asking, radius = _matrix(some.column("vector")), some.column("radius").to_numpy()
                    score = asking @ vectors.T
                    for q in range(len(score)):
                        near, far = index.distances(np.append(asking[q], 0.0))
                        score[q, near[cells // width] + far[cells % width] > radius[q]] = -np.inf
                    m = min(keep, score.shape[1])
                    # Ties at the cut are settled by the smallest id, so all that reach it stay.
                    least = np.partition(score, score.shape[1] - m, axis=1)[:, score.shape[1] - m]
                    out = []
                    for q, entry in enumerate(some.column("id").to_pylist()):
                        best = np.flatnonzero((score[q] >= least[q]) & (score[q] > -np.inf))
                        best = sorted(best.tolist(), key=lambda e: (-score[q, e], ids[e][0]))[:keep]
                        out += [(entry, float(score[q, e]), ids[e]) for e in best]
                    if out:
                        yield record_batch(found_schema, list(zip(*out, strict=True)))

    found = dealt.mapInArrow(rank, "entry long, score double, ids array<long>").select("entry", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    lists = best.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    return (
        asked.join(lists, "entry")
        .select("query_id", F.posexplode(others).alias("at", "x"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
