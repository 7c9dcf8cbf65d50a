"""Exact histogram of encoded document lengths, answering totals, quantiles and truncated totals for every context limit.

Each task counts its documents by encoded length and emits one row for each length it met; those partial counts are summed by
length. Suffix sums over the histogram (taken in blocks of lengths, so that no task sorts the whole of it) then answer, for any
limit, how many documents exceed it and how many tokens remain if each document is cut to it.

Defined cases: a null or empty text has length 0 and is counted; repeated rows count each time; an empty table gives the asked
limits with zero counts and null quantiles; further columns are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordbpe
from .common import batches_of, cut_lineage, small_batches, table

#: Context limits that are answered beside every length that occurs.
LIMITS = tuple(1 << k for k in range(7, 21))
#: Lengths in a block of the suffix sums.
BLOCK = 4096


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(length, n_docs) of the column text."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("length", pa.int64()), ("n_docs", pa.int64())])

    def run(batches):
        encoder, counts = wordbpe.loaded(tokenizer), Counter()
        for batch in batches:
            counts.update(encoder.count(text.as_py() or "") for text in batch.column(0))
        return batches_of(iter(counts.items()), schema)

    parts = docs.select("text").mapInArrow(run, "length long, n_docs long")
    # Read several times by limit_table(); a row for each length that occurs.
    return cut_lineage(parts.groupBy("length").agg(F.sum("n_docs").alias("n_docs")))


def limit_table(histogram: DataFrame, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """A row for each asked limit and each length that occurs, taken as a context limit: documents of exactly that length,
    at most that long and longer, the tokens of the documents that fit, all tokens left when every document is cut to the
    limit, all tokens, and the share of documents that fit (the limit is the quantile at that share)."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "length long").withColumn("n_docs", F.lit(0).cast("long"))
    # A block's rows are lengths, 4096 at most, however many documents have them.
    points = (
        histogram.unionByName(asked)
        .groupBy("length")
        .agg(F.sum("n_docs").alias("n_docs"))
        .withColumn("block", F.floor(F.col("length") / BLOCK))
        .withColumn("tokens", F.col("length") * F.col("n_docs"))
    )
    above = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (
        points.groupBy("block")
        .agg(F.sum("n_docs").alias("n"), F.sum("tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("n").over(above), F.lit(0)).alias("docs_above"),
            F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
            F.sum("n").over(everything).alias("all_docs"),
            F.sum("t").over(everything).alias("total_tokens"),
        )
    )
    longer = Window.partitionBy("block").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    return (
        points.join(blocks, "block")
        .withColumn("docs_over", F.col("docs_above") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0)))
        .withColumn("tokens_over", F.col("tokens_above") + F.coalesce(F.sum("tokens").over(longer), F.lit(0)))
        .select(
            F.col("length").alias("context_limit"),
            "n_docs",
            (F.col("all_docs") - F.col("docs_over")).alias("docs_at_most"),
            "docs_over",
            (F.col("total_tokens") - F.col("tokens_over")).alias("tokens_at_most"),
            (F.col("total_tokens") - F.col("tokens_over") + F.col("length") * F.col("docs_over")).alias("truncated_tokens"),
            "total_tokens",
            F.when(F.col("all_docs") > 0, (F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
        )
    )


def lengths_at(histogram: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(share, length): the smallest length that at least such a share of the documents does not exceed, null for an empty
    table; a share of 0 gives the smallest length."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in shares], "share double")
    reached = limit_table(histogram, ()).select("context_limit", "quantile").join(F.broadcast(asked), F.col("quantile") >= F.col("share"))
    return asked.join(reached.groupBy("share").agg(F.min("context_limit").alias("length")), "share", "left")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_table(length_histogram(table(spark, sf_dir, "documents")))
