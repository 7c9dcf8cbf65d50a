"""Bounded, reproducible samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def fold(column: str, modulus: int):
    """crc32 of an id as text, modulo a number of folds."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, label, text) of at most per_class documents of each class, the first by a hash of their id, none of them of the
    held-out fold; and for each class how many labelled documents one of the sample stands for. A document labelled twice
    counts as its higher label; of several texts of a document the least is taken."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label"))
    )
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = known.where("label = 0").orderBy(order, "doc_id").limit(per_class).union(known.where("label = 1").orderBy(order, "doc_id").limit(per_class))
    # Bounded by 2 * per_class rows of two numbers, so it is sent to every task.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = cut_lineage(rows)
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return rows, {c: totals[c] / n for c, n in found.items()}
