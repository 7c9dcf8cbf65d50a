"""Profiles of sources, texts, truth and blocking keys: the aggregates behind the usual tables and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_shuffle
from ..functions.text import dominant_script, without_repeats, word_tokens


def country_by_source(entities: DataFrame) -> DataFrame:
    """Records of each country in each source, the row total, and the source's share of the country in percent."""
    source = F.substring("entity_id", 1, 2)
    counts = entities.withColumn("source", source).groupBy("country").pivot("source", ["S1", "S2", "S3"]).count().na.fill(0, ["S1", "S2", "S3"])
    whole = Window.partitionBy()  # one row for each country
    share = [F.round(100 * F.col(s) / F.greatest(F.sum(s).over(whole), F.lit(1)), 2).alias(f"{s}_percent") for s in ("S1", "S2", "S3")]
    return counts.select("country", "S1", "S2", "S3", (F.col("S1") + F.col("S2") + F.col("S3")).alias("total"), *share)


def script_profile(entities: DataFrame, column: str = "business_name") -> DataFrame:
    rows = entities.groupBy(dominant_script(F.col(column)).alias("script")).agg(F.count("*").alias("n"))
    return rows.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def match_cardinality(ids: DataFrame, truth: DataFrame, most: int = 6) -> DataFrame:
    """How many reference ids have 0, 1, ... matches; `most` stands for that many or more."""
    n = truth.groupBy("source1_entity_id").agg(F.count("*").alias("n"))
    rows = ids.select("source1_entity_id").join(by_shuffle(n), "source1_entity_id", "left").select(F.least(F.coalesce("n", F.lit(0)), F.lit(most)).alias("matches"))
    return rows.groupBy("matches").agg(F.count("*").alias("ids"))


def score_histogram(pairs: DataFrame, bins: int = 20) -> DataFrame:
    """Pairs in equal bins of the score from 0 to 1; a score of 1 falls into the last."""
    slot = F.least(F.floor(F.col("similarity_score") * bins), F.lit(bins - 1)).cast("int")
    return pairs.groupBy(slot.alias("bin")).agg(F.count("*").alias("pairs"), F.min("similarity_score").alias("least"), F.max("similarity_score").alias("most"))


def address_pairs(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """Addresses of both sides of every true pair."""
    address = entities.select("entity_id", "business_address")
    a = address.select(F.col("entity_id").alias("source1_entity_id"), F.col("business_address").alias("address1"))
    b = address.select(F.col("entity_id").alias("candidate_entity_id"), F.col("business_address").alias("address2"))
    return truth.join(by_shuffle(a), "source1_entity_id").join(by_shuffle(b), "candidate_entity_id")


def group_address_pairs(entities: DataFrame) -> DataFrame:
    """(address1, address2, n) of (group, asked, business_address): a pair is true if both sides, one of them asked, are of one
    group. n pairs have these two addresses, so that no pair makes a row."""
    sides = entities.groupBy("group", "asked", "business_address").agg(F.count("*").alias("n"))
    a = sides.where("asked").select("group", F.col("business_address").alias("address1"), F.col("n").alias("n1"))
    b = sides.where("not asked").select("group", F.col("business_address").alias("address2"), F.col("n").alias("n2"))
    return a.join(by_shuffle(b), "group").groupBy("address1", "address2").agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))


def token_changes(pairs: DataFrame) -> DataFrame:
    """For each pair of addresses: the share of either side's tokens that the other lacks, and whether the common tokens come in
    another order. Pairs with an empty side are left out. A column n, which says how many pairs a row stands for, is kept."""
    one, two = word_tokens(F.col("address1")), word_tokens(F.col("address2"))
    rows = pairs.withColumn("t1", one).withColumn("t2", two).where((F.size("t1") > 0) & (F.size("t2") > 0))
    rows = rows.withColumn("common", F.array_intersect("t1", "t2"))
    n = F.size("common")

    def order(t: str) -> Column:
        return without_repeats(F.filter(t, lambda x: F.array_contains("common", x)))

    return rows.select(
        *(c for c in ("source1_entity_id", "candidate_entity_id", "n") if c in pairs.columns),
        (1 - n / F.size(F.array_distinct("t1"))).alias("omitted1"),
        (1 - n / F.size(F.array_distinct("t2"))).alias("omitted2"),
        (order("t1") != order("t2")).alias("reordered"),
    )


def token_change_rates(pairs: DataFrame) -> DataFrame:
    changes = token_changes(pairs)
    n = F.col("n") if "n" in pairs.columns else F.lit(1).cast("long")

    def mean(c: Column) -> Column:
        return F.sum(c * n) / F.sum(n)

    return changes.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("pairs"),
        mean(F.col("omitted1")).alias("omission1"),
        mean(F.col("omitted2")).alias("omission2"),
        mean(F.col("reordered").cast("double")).alias("reorder_rate"),
    )


def field_presence(entities: DataFrame, extractors: dict[str, Column]) -> DataFrame:
    """For each extractor the share of records on which it returns a value."""
    stacked = F.explode(F.create_map(*(x for k, v in extractors.items() for x in (F.lit(k), v)))).alias("field", "value")
    return entities.select(stacked).groupBy("field").agg(F.avg(F.when(F.col("value") != "", 1.0).otherwise(0.0)).alias("presence"))


def block_profile(keys: DataFrame) -> DataFrame:
    """Of (id, strategy, key): blocks, the largest and the median block, and the share of comparisons they save; missing keys
    share one block."""
    blocks = keys.groupBy("strategy", F.when(F.col("key") == "", "__MISSING__").otherwise(F.col("key")).alias("key")).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return blocks.groupBy("strategy").agg(
        F.count("*").alias("blocks"),
        F.max("n").alias("largest"),
        F.median("n").alias("median_block"),
        (1 - F.sum(F.col("n") * F.col("n")) / (total * total)).alias("reduction_ratio"),
    )


def key_retention(truth: DataFrame, keys: DataFrame) -> DataFrame:
    """Of (id, strategy, key): the share of true pairs whose keys agree and are present, for each strategy."""
    a = keys.select(F.col("id").alias("source1_entity_id"), "strategy", F.col("key").alias("k1"))
    b = keys.select(F.col("id").alias("candidate_entity_id"), "strategy", F.col("key").alias("k2"))
    hit = (F.col("k1") == F.col("k2")) & (F.col("k1") != "")
    rows = truth.join(by_shuffle(a), "source1_entity_id").join(by_shuffle(b), ["candidate_entity_id", "strategy"])
    return rows.groupBy("strategy").agg(F.count("*").alias("pairs"), F.sum(hit.cast("long")).alias("kept")).withColumn("retention", F.col("kept") / F.col("pairs"))


def set_retention(truth: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (id, scheme, keys): the share of true pairs that share any key, for each scheme."""
    a = sets.select(F.col("id").alias("source1_entity_id"), "scheme", F.col("keys").alias("k1"))
    b = sets.select(F.col("id").alias("candidate_entity_id"), "scheme", F.col("keys").alias("k2"))
    rows = truth.join(by_shuffle(a), "source1_entity_id").join(by_shuffle(b), ["candidate_entity_id", "scheme"])
    kept = F.sum(F.arrays_overlap("k1", "k2").cast("long"))
    return rows.groupBy("scheme").agg(F.count("*").alias("pairs"), kept.alias("kept")).withColumn("retention", F.col("kept") / F.col("pairs"))


def group_key_retention(keys: DataFrame) -> DataFrame:
    """key_retention() of (group, asked, strategy, key): a pair is true if both sides, one of them asked, are of one group. Pairs
    are counted by products of the sides' numbers and never made."""
    asked = F.col("asked").cast("long")
    each = keys.groupBy("group", "strategy", "key").agg(F.sum(asked).alias("a"), F.sum(1 - asked).alias("b"))
    kept = F.sum(F.when(F.col("key") != "", F.col("a") * F.col("b")).otherwise(0))
    sums = each.groupBy("group", "strategy").agg((F.sum("a") * F.sum("b")).alias("pairs"), kept.alias("kept")).where("pairs > 0")
    rows = sums.groupBy("strategy").agg(F.sum("pairs").alias("pairs"), F.sum("kept").alias("kept"))
    return rows.withColumn("retention", F.col("kept") / F.col("pairs"))


def group_set_retention(sets: DataFrame) -> DataFrame:
    """set_retention() of (group, asked, scheme, keys): each two sets that a group has are compared once, for all its pairs with
    these sets."""
    asked = F.col("asked").cast("long")
    each = sets.groupBy("group", "scheme", "keys").agg(F.sum(asked).alias("a"), F.sum(1 - asked).alias("b"))
    a = each.where("a > 0").select("group", "scheme", F.col("keys").alias("k1"), "a")
    b = each.where("b > 0").select("group", "scheme", F.col("keys").alias("k2"), "b")
    n = F.col("a") * F.col("b")
    kept = F.sum(F.when(F.arrays_overlap("k1", "k2"), n).otherwise(0))
    rows = a.join(by_shuffle(b), ["group", "scheme"]).groupBy("scheme").agg(F.sum(n).alias("pairs"), kept.alias("kept"))
    return rows.withColumn("retention", F.col("kept") / F.col("pairs"))


def stratified_sample(entities: DataFrame, per_country: int, seed: int = 7) -> DataFrame:
    """At most so many records of each country, the first by a hash of the id."""
    order = Window.partitionBy("country").orderBy(F.xxhash64("entity_id", F.lit(seed)), "entity_id")
    return entities.withColumn("n__", F.row_number().over(order)).where(F.col("n__") <= per_country).drop("n__")


def sample_pairs(entities: DataFrame, truth: DataFrame, n: int = 10, seed: int = 7) -> DataFrame:
    """Some true pairs with the names and addresses of both sides, the first by a hash of their ids."""
    few = truth.orderBy(F.xxhash64("source1_entity_id", "candidate_entity_id", F.lit(seed)), "source1_entity_id", "candidate_entity_id").limit(n)
    sides = [entities.select(F.col("entity_id").alias(c), F.col("business_name").alias(f"name{k}"), F.col("business_address").alias(f"address{k}")) for k, c in ((1, "source1_entity_id"), (2, "candidate_entity_id"))]
    return few.join(sides[0], "source1_entity_id").join(sides[1], "candidate_entity_id")
