"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into three segments. Two fingerprints that differ in at most four bits differ in at most one bit of the
first or of the second segment, or in none of the third (1 + 1, 1 + 1 and 0 + 1 sum to 4 + 1). So every distinct fingerprint
enumerates those small Hamming balls within its segments, fetches the fingerprints that have such a segment, and verifies the
complete distance. From WIDE_FROM fingerprints on there are two segments, with balls of two bits and of one (2 + 1 + 1 + 1).
Equal fingerprints count once. A bucket of the table that is hot is dealt to several tasks, and a bucket
returns the edges of a spanning forest instead of all its pairs.

Defined cases: a null or empty text has fingerprint 0 and links like any other; fewer words than a shingle make one shingle;
repeated rows share a fingerprint; a null doc_id is never the smallest of its group unless all are null; an empty table gives
no rows; further columns are kept by deduplicate() and not read otherwise.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, record_batch, small_batches, spread_join, table
from .components import Forest, connected_components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: (lowest bit, bits, radius) of each segment; the radii, each plus one, sum to DISTANCE + 1.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
#: Segments for tables whose fingerprints would fill the buckets of 21 bits: fewer, wider ones and larger balls.
WIDE_SEGMENTS = ((0, 32, 2), (32, 32, 1))
#: Distinct fingerprints from which on the wide segments are used; 512 fingerprints to a bucket of 21 bits.
WIDE_FROM = 1 << 30
#: Fingerprints of one bucket that a task holds; a larger bucket is dealt to several.
BUCKET_ROWS = 4096
#: Shingles hashed at a time; bounds memory for very long texts.
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit value: a bit is set if it is in over half of the shingles' XXH64 values."""
    found = text.lower().split()
    if not found:
        return 0
    run = b" ".join(found)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: max(1, len(found) - shingle + 1)]
    ends = ends[min(shingle, len(found)) - 1 :]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), _CHUNK):
        pairs = zip(starts[k : k + _CHUNK].tolist(), ends[k : k + _CHUNK].tolist(), strict=True)
        hashes = np.array([digest(run[a:b], SEED) for a, b in pairs], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            fps = [fingerprint(x.as_buffer().to_pybytes(), shingle) if x.is_valid else 0 for x in text]
            yield record_batch(schema, [batch.column(0), fps])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _segment(low: int, bits: int):
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints (a column fp, each once) of at most DISTANCE differing bits. They connect exactly what
    all such pairs connect."""
    entries, probes = [], []
    for k, (low, bits, radius) in enumerate(SEGMENTS if distinct.count() < WIDE_FROM else WIDE_SEGMENTS):
        masks = [sum(1 << i for i in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)]
        value = _segment(low, bits)
        name = F.lit(k << 32)
        entries.append(distinct.select((value + name).alias("bucket"), "fp"))
        probes.append(distinct.select(F.explode(F.array(*[(value.bitwiseXOR(F.lit(m).cast("long")) + name) for m in masks])).alias("bucket"), "fp"))
    entry, probe = reduce(DataFrame.union, entries), reduce(DataFrame.union, probes)
    # How many tasks share a bucket; one for nearly all, which the table of the others leaves out.
    hot = entry.groupBy("bucket").count().where(F.col("count") > BUCKET_ROWS).select("bucket", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("parts"))
    hot = cut_lineage(hot)
    part = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    table_rows = entry.join(hot, "bucket", "left").select("bucket", part.alias("part"), F.lit(0).alias("kind"), "fp")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    probe_rows = probe.join(hot, "bucket", "left").select("bucket", every.alias("part"), F.lit(1).alias("kind"), "fp")
    rows = table_rows.union(probe_rows).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    return rows.mapInArrow(_verify, "a long, b long")


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Pairs compared at a time.
_PAIRS = 1 << 20
#: From this many pairs on a bucket's probes stop comparing once the bucket is known to be connected.
_LARGE = 1 << 14


def _verify(batches):
    """Edges of the buckets of a partition, whose rows come sorted by bucket, part and kind: table entries before probes."""
    key, held = None, np.zeros(0, dtype=np.int64)
    forest: Forest | None = None  # of a large bucket's entries
    for batch in batches:
        bucket, part, kind, fp = (batch.column(i).to_numpy() for i in range(4))
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(part) != 0)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
        tables = np.add.reduceat(kind == 0, starts) if len(bucket) else np.zeros(0, dtype=np.int64)
        found: list[np.ndarray] = []
        for k in np.flatnonzero((tables > 0) & (ends - starts > 1) | (starts == 0) | (ends == len(bucket))):
            a, n, b = int(starts[k]), int(tables[k]), int(ends[k])
            if (now := (int(bucket[a]), int(part[a]))) != key:
                key, held, forest = now, held[:0], None
            held = np.concatenate([held, fp[a : a + n]]) if n else held
            probes = fp[a + n : b]
            if not len(held) or not len(probes):
                continue
            if len(held) * (len(probes) + 64) >= _LARGE:
                forest = forest or Forest()
                found.append(_connect(held, probes, forest))
            else:
                near = np.bitwise_count((held[:, None] ^ probes[None, :]).view(np.uint64)) <= DISTANCE
                x, y = np.nonzero(near & (held[:, None] != probes[None, :]))
                if len(x):
                    found.append(np.stack([held[x], probes[y]]))
        if found:
            pairs = np.concatenate(found, axis=1)
            pairs = np.unique(np.sort(pairs, axis=0), axis=1)
            yield record_batch(_EDGE, [pairs[0], pairs[1]])


def _connect(held: np.ndarray, probes: np.ndarray, forest: Forest) -> np.ndarray:
    """Edges that connect what the pairs of entries and probes within the distance connect: one to each probe that has a
    partner, and one for each time that a probe joins two parts of the entries."""
    out: list[tuple[int, int]] = []
    step = max(1, _PAIRS // 256)
    roots = {forest.root(x) for x in held.tolist()}
    for k in range(0, len(probes), step):
        left, first = probes[k : k + step], {}
        for at in range(0, len(held), 256):
            some = held[at : at + 256]
            near = np.bitwise_count((left[:, None] ^ some[None, :]).view(np.uint64)) <= DISTANCE
            near &= left[:, None] != some[None, :]
            done = near.any(axis=1)
            for i in np.flatnonzero(done).tolist():
                p, partners = int(left[i]), some[near[i]].tolist()
                if p not in first:
                    first[p] = partners[0]
                    out.append((p, partners[0]))
                if len(roots) > 1:
                    for q in partners:
                        if forest.join(first[p], q):
                            out.append((p, q))
            if len(roots) > 1:
                roots = {forest.root(x) for x in roots}
            if len(roots) == 1:  # one partner connects a probe to all entries
                left = left[[int(x) not in first for x in left]]
                if not len(left):
                    break
    return np.array(out, dtype=np.int64).reshape(-1, 2).T


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    prints = cut_lineage(fingerprints(docs))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(links(distinct.select("fp")))
    linked = roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = cut_lineage(linked)
    named = spread_join(linked, smallest, ["root"], linked.groupBy("root").agg(F.count("*").alias("n")), "fp").select("fp", "component_id")
    named = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return spread_join(prints, named, ["fp"], distinct, "doc_id").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    return keep_smallest(docs, groups(docs))


def keep_smallest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their group in found (doc_id, component_id); of rows that repeat such
    an id, one. Rows without an id stay, as nothing tells them apart."""
    found = cut_lineage(found)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    twice = cut_lineage(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
