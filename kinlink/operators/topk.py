"""Ranks, top-k and merges of candidate pairs (source1_entity_id, candidate_entity_id, similarity_score, country)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_shuffle

#: Scores are rounded to so many places before they are ranked, so that equal texts tie and the smaller id wins.
PLACES = 6


def by_score():
    return Window.partitionBy("source1_entity_id").orderBy(F.desc("similarity_score"), "candidate_entity_id")


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query with their rank from 1. The limit on the rank is also taken before the shuffle."""
    return pairs.withColumn("rank", F.row_number().over(by_score())).where(F.col("rank") <= k)


def merge(legs: list[DataFrame], k: int) -> DataFrame:
    """The k best of several legs; a pair that several legs have counts with its best score."""
    every = reduce(DataFrame.unionByName, [leg.select("source1_entity_id", "candidate_entity_id", "similarity_score", "country") for leg in legs])
    best = every.groupBy("source1_entity_id", "candidate_entity_id", "country").agg(F.max("similarity_score").alias("similarity_score"))
    return top_k(best, k)


def accept(pairs: DataFrame, tau: float) -> DataFrame:
    return pairs.where(F.col("similarity_score") >= tau)


def id_lists(reference: DataFrame, pairs: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """A row for each reference id with its candidates in order of rank, empty where it has none."""
    lists = pairs.groupBy("source1_entity_id").agg(F.sort_array(F.collect_list(F.struct("rank", "candidate_entity_id"))).alias("found"))
    ids = F.transform("found", lambda x: x["candidate_entity_id"])
    row = ["row"] if "row" in reference.columns else []  # the order of the input, where it is known
    joined = reference.select(F.col("entity_id").alias("source1_entity_id"), *row).join(by_shuffle(lists), "source1_entity_id", "left")
    return joined.select(*row, "source1_entity_id", F.coalesce(F.array_join(F.array_distinct(ids), ","), F.lit("")).alias(name))


def scored_lists(pairs: DataFrame) -> DataFrame:
    """Each query's candidates as one text, id:score with four decimals, in order of rank."""
    lists = pairs.groupBy("source1_entity_id").agg(F.sort_array(F.collect_list(F.struct("rank", "candidate_entity_id", "similarity_score"))).alias("found"))
    text = F.array_join(F.transform("found", lambda x: F.concat(x["candidate_entity_id"], F.lit(":"), F.format_string("%.4f", x["similarity_score"]))), ";")
    return lists.select("source1_entity_id", text.alias("candidates_with_scores"))


def two_lists(pairs: DataFrame) -> DataFrame:
    """Each query's candidate ids and scores as two comma-joined columns."""
    lists = pairs.groupBy("source1_entity_id").agg(F.sort_array(F.collect_list(F.struct("rank", "candidate_entity_id", "similarity_score"))).alias("found"))
    return lists.select(
        "source1_entity_id",
        F.array_join(F.transform("found", lambda x: x["candidate_entity_id"]), ",").alias("candidate_entity_ids"),
        F.array_join(F.transform("found", lambda x: F.format_string("%.4f", x["similarity_score"])), ",").alias("scores"),
    )


def parse_scored_lists(lists: DataFrame) -> DataFrame:
    """Pairs with ranks from the text of scored_lists(); items without a colon are skipped."""
    items = F.filter(F.split("candidates_with_scores", ";"), lambda x: x.contains(":"))
    return lists.select("source1_entity_id", F.posexplode(items).alias("at", "item")).select(
        "source1_entity_id",
        F.expr("substring_index(item, ':', size(split(item, ':')) - 1)").alias("candidate_entity_id"),
        F.substring_index("item", ":", -1).cast("double").alias("similarity_score"),
        (F.col("at") + 1).alias("rank"),
    )
