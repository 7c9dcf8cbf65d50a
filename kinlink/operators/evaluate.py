"""Pair completeness, per-entity precision, recall and F-beta, sweeps and comparisons.

Truth is (source1_entity_id, matched_entity_ids) with comma lists, or its exploded form (source1_entity_id,
candidate_entity_id). Predictions are ranked pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_shuffle

BETA = 0.5


def truth_pairs(truth: DataFrame) -> DataFrame:
    """Distinct true pairs; blanks, empty items and nan are dropped."""
    items = F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = truth.select("source1_entity_id", F.explode(items).alias("candidate_entity_id"))
    return rows.where((F.col("candidate_entity_id") != "") & (F.lower("candidate_entity_id") != "nan")).distinct()


def f_beta(p: Column, r: Column, beta: float = BETA) -> Column:
    below = beta * beta * p + r
    return F.when(below > 0, (1 + beta * beta) * p * r / below).otherwise(0.0)


def pair_completeness(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true links, those among the pairs, and their share (1 if there are no true links)."""
    found = pairs.select("source1_entity_id", "candidate_entity_id").distinct().withColumn("hit", F.lit(1))
    joined = truth.join(by_shuffle(found), ["source1_entity_id", "candidate_entity_id"], "left")
    return joined.agg(F.count("*").alias("true_links"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits")).withColumn(
        "pair_completeness", F.when(F.col("true_links") > 0, F.col("hits") / F.col("true_links")).otherwise(1.0)
    )


def completeness_at(pairs: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """Pair completeness for each cut of the ranks. The list of cuts is small and explodes the hits, not the pairs."""
    hits = truth.join(by_shuffle(pairs.select("source1_entity_id", "candidate_entity_id", "rank")), ["source1_entity_id", "candidate_entity_id"])
    cuts = F.explode(F.array(*map(F.lit, ks))).alias("k")
    at = hits.select("rank", cuts).where("rank <= k").groupBy("k").agg(F.count("*").alias("hits"))
    spark = pairs.sparkSession
    total = truth.agg(F.count("*").alias("true_links"))
    rows = spark.createDataFrame([(k,) for k in ks], "k int").join(at, "k", "left").join(F.broadcast(total))
    hits_ = F.coalesce("hits", F.lit(0))
    return rows.select("k", "true_links", hits_.alias("hits"), F.when(F.col("true_links") > 0, hits_ / F.col("true_links")).otherwise(1.0).alias("pair_completeness"))


def entity_scores(ids: DataFrame, truth: DataFrame, pairs: DataFrame, beta: float = BETA, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall and F-beta of each reference id (a column source1_entity_id and any further ones); an id without true
    links scores 1 if nothing is predicted and 0 otherwise. `by` names columns of ids and pairs that hold a sweep's setting."""
    n_true = truth.groupBy("source1_entity_id").agg(F.count("*").alias("n_true"))
    hit = truth.withColumn("hit", F.lit(1))
    predicted = pairs.select(*by, "source1_entity_id", "candidate_entity_id").distinct().join(by_shuffle(hit), ["source1_entity_id", "candidate_entity_id"], "left")
    predicted = predicted.groupBy(*by, "source1_entity_id").agg(F.count("*").alias("n_pred"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hit"))
    rows = ids.join(by_shuffle(n_true), "source1_entity_id", "left").join(by_shuffle(predicted), [*by, "source1_entity_id"], "left").na.fill(0, ["n_true", "n_pred", "n_hit"])
    none = (F.col("n_true") == 0) & (F.col("n_pred") == 0)
    p = F.when(none, 1.0).when(F.col("n_pred") > 0, F.col("n_hit") / F.col("n_pred")).otherwise(0.0)
    r = F.when(none, 1.0).when(F.col("n_true") > 0, F.col("n_hit") / F.col("n_true")).otherwise(0.0)
    rows = rows.withColumn("precision", p).withColumn("recall", r)
    return rows.withColumn("f_beta", f_beta(F.col("precision"), F.col("recall"), beta))


def macro(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over entities, and counts of entities, singletons, singletons predicted empty, links and hits."""
    single = F.col("n_true") == 0
    return scores.groupBy(*by).agg(
        F.count("*").alias("entities"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f_beta").alias("macro_f"),
        F.sum(single.cast("long")).alias("singletons"),
        F.sum((single & (F.col("n_pred") == 0)).cast("long")).alias("singletons_empty"),
        F.sum("n_true").alias("true_links"),
        F.sum("n_hit").alias("hits"),
    )


def list_metrics(scores: DataFrame) -> DataFrame:
    """One row of all measures of a result: means, pair completeness (1 without true links), counts, singletons left alone and
    wrongly merged, and the sums behind the means, so that parts of a job add up."""
    single, merged = F.col("n_true") == 0, F.col("n_pred") > 0
    sums = {"precision": "sum_precision", "recall": "sum_recall", "f_beta": "sum_f"}
    row = scores.agg(
        F.count("*").alias("entities"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("n_true", "true_links"), ("n_hit", "hits"))),
        F.count_if(single).alias("singletons"),
        F.count_if(single & ~merged).alias("singletons_empty"),
        F.count_if(single & merged).alias("singletons_merged"),
        *(F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for c, n in sums.items()),
    )
    most = F.greatest("entities", F.lit(1))
    return row.select(
        "*",
        *((F.col(f"sum_{c}") / most).alias(f"macro_{c}") for c in ("precision", "recall", "f")),
        F.when(F.col("true_links") > 0, F.col("hits") / F.col("true_links")).otherwise(1.0).alias("pair_completeness"),
    )


def macro_by_country(scores: DataFrame) -> DataFrame:
    """The macro means of each country and, with a null country, of all."""
    single = F.col("n_true") == 0
    return scores.rollup("country").agg(
        F.count("*").alias("entities"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f_beta").alias("macro_f"),
        F.sum(single.cast("long")).alias("singletons"),
    )


def sweep_tau(ids: DataFrame, truth: DataFrame, pairs: DataFrame, taus: list[float], beta: float = BETA) -> DataFrame:
    """Macro scores for each acceptance threshold."""
    grid = F.explode(F.array(*map(F.lit, taus))).alias("tau")
    accepted = pairs.select("*", grid).where("similarity_score >= tau")
    return macro(entity_scores(ids.select("source1_entity_id", grid), truth, accepted, beta, ("tau",)), ("tau",))


def sweep_k(ids: DataFrame, truth: DataFrame, pairs: DataFrame, ks: list[int], beta: float = BETA) -> DataFrame:
    """Macro scores for each cut of the ranks."""
    grid = F.explode(F.array(*map(F.lit, ks))).alias("k")
    cut = pairs.select("*", grid).where("rank <= k")
    return macro(entity_scores(ids.select("source1_entity_id", grid), truth, cut, beta, ("k",)), ("k",))


def best(sweep: DataFrame, setting: str = "tau") -> DataFrame:
    """The setting of the best macro score, the smaller of equal ones."""
    return sweep.orderBy(F.desc(F.round("macro_f", 12)), setting).limit(1)


def reduction_ratio(pairs: DataFrame, reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: the share of comparisons that blocking saves."""
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((pairs, "pairs"), (reference, "n_reference"), (candidates, "n_candidates"))]
    row = counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))
    return row.withColumn("reduction_ratio", F.when(F.col("n_reference") * F.col("n_candidates") > 0, 1 - F.col("pairs") / (F.col("n_reference") * F.col("n_candidates"))))


def compare(metrics: list[tuple[str, DataFrame]], metric: str, tolerance: float = 0.005) -> DataFrame:
    """Two or more configurations on the same sample: the metric of each, its distance to the best, and whether it is within
    the tolerance of it."""
    rows = None
    for name, df in metrics:
        one = df.select(F.lit(name).alias("config"), F.col(metric).alias(metric))
        rows = one if rows is None else rows.unionByName(one)
    top = F.max(metric).over(Window.partitionBy())
    return rows.withColumn("delta", F.col(metric) - top).withColumn("good_enough", F.col("delta") >= -tolerance)
