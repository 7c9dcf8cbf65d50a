"""What the operators share: words, Arrow batches, session settings and tables cut from their lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that holds whole texts; bounds a Python worker's memory when texts are long.
TEXT_BATCH_ROWS = 256

# Fixed values of the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over UTF-8 after lower-casing A-Z: digits, letters and all
# bytes from 0x80 stay, every other byte separates words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


#: The same words as a regular expression over characters, upper case included.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def word_count(text: str = "text") -> Column:
    """How many words a text column has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def words(text: bytes) -> list[bytes]:
    """Lower-cased alphanumeric words of a UTF-8 text."""
    return text.translate(_WORD_BYTES).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Sets how many rows reach a Python worker at once, unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def wide_batches(spark: SparkSession, rows: int = 10_000) -> Iterator[None]:
    """Within it, actions over rows without whole texts send so many at once to a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints, which all executors share. Where the session names none, a local one
    in local mode (tests); a cluster has to name one."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "kinlink-checkpoints")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder, so that later steps read them again instead of computing them and survive
    lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame) -> str:
    """Writes the rows as Parquet in the shared folder, for tables with whole texts; gives the path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return path


def remove_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(taken: list[str], *wanted: str) -> list[str]:
    """Column names like those wanted that none of the taken names equals in any case."""
    have, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


#: Rows of a key from which on spread_join() may deal them to several tasks.
HOT_ROWS = 1024


def spread_join(rows: DataFrame, told: DataFrame, keys: list[str], sizes: DataFrame, by: str, how: str = "left") -> DataFrame:
    """rows joined with told, which has a key (no nulls) at most once, where a key may hold a large part of the rows. sizes has
    the keys with n, their number of rows. A key of over a thousandth of all rows, so one of a thousand at most, has its rows
    dealt by the column `by` and its row of told repeated."""
    part, parts = unused([*rows.columns, *told.columns], "part", "parts")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_ROWS, total // 1000)
    hot = F.broadcast(cut_lineage(sizes.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias(parts))))
    dealt = rows.join(hot, keys, "left").withColumn(part, F.pmod(F.xxhash64(by), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))
    repeated = told.join(hot, keys, "left").withColumn(part, every).drop(parts)
    return dealt.join(repeated, [*keys, part], how).select(*rows.columns, *(c for c in told.columns if c not in keys))


#: Odd multiplier of the rolling hash, modulo 2^64.
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """Finisher that spreads a rolling hash over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Hashes of runs of words by prefix sums."""

    def __init__(self):
        self.powers = np.ones(1, dtype=np.uint64)

    @staticmethod
    def words(found: list[bytes]) -> np.ndarray:
        """One hash for each word."""
        return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), dtype=np.uint64)

    def _power(self, n: int) -> np.ndarray:
        """The powers 0 to n - 1 of the base, in rising order."""
        if len(self.powers) < n:
            grown = np.full(max(n, 2 * len(self.powers)), _BASE, dtype=np.uint64)
            grown[0] = 1
            self.powers = np.multiply.accumulate(grown)
        return self.powers[:n]

    def runs(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """The hash of every run of `size` words, by its start: the sum of hash times base^(words to the run's end)."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, dtype=np.uint64)
        # Terms h[i] * base^(n - i): a run's sum, taken out of the prefix sums, is scaled to the run's own place by a power
        # of the base's inverse.
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        falling = self._power(n)[::-1]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * falling, dtype=np.uint64)])
        run = sums[size:] - sums[:-size]  # base^(n - 1 - start - j) for the word j of the run
        scale = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - size, inverse, dtype=np.uint64)]))[::-1]
        return _mix(run * scale)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows, gathered into batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield record_batch(schema, list(zip(*held, strict=True)))
            held = []
    if held:
        yield record_batch(schema, list(zip(*held, strict=True)))
