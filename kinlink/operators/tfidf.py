"""Vocabulary fit and unit TF-IDF postings.

The country is an ordinary key column: every aggregation and join carries it, so no partition is handled by a driver loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_shuffle, cut_lineage, drop_shuffles
from .counts import asked, asked_of, chunked, counted, frequencies, packed_units, unit_arrays


@dataclass(frozen=True)
class TfIdf:
    min_df: int = 2
    max_df: float = 1.0
    max_features: int | None = None
    sublinear_tf: bool = True
    #: Records of each country that fit the vocabulary at most, by a hash of their id; None for all.
    fit_sample: int | None = None


#: Tells texts apart: what it makes of equal texts is equal.
def text_id(text: str = "text") -> Column:
    return F.md5(text)


def term_frequencies(texts: DataFrame, grams: Column) -> DataFrame:
    """(country, id, gram, tf) from (country, id, ...). The texts are dealt by record, so that their grams need no shuffle."""
    return texts.repartition("country", "id").select("country", "id", F.explode(grams).alias("gram")).groupBy("country", "id", "gram").agg(F.count("*").alias("tf"))


def sampled(texts: DataFrame, per_country: int, seed: int = 42, by: Column | None = None) -> DataFrame:
    """At most so many records of each country, the first by a column or by a hash of the id."""
    order = Window.partitionBy("country").orderBy(F.xxhash64("id", F.lit(seed)) if by is None else by, "id")
    return texts.withColumn("n__", F.row_number().over(order)).where(F.col("n__") <= per_country).drop("n__")


def vocabulary(tf: DataFrame, sizes: DataFrame, config: TfIdf = TfIdf()) -> DataFrame:
    """(country, gram, df, cf, idf); sizes has (country, n) with the number of records that tf was counted over, among them
    those without any gram. A column copies of tf says for how many records a row stands."""
    copies = F.col("copies") if "copies" in tf.columns else F.lit(1)
    found = tf.groupBy("country", "gram").agg(F.sum(copies).cast("long").alias("df"), F.sum(F.col("tf") * copies).cast("long").alias("cf"))
    found = found.join(sizes, "country")
    found = found.where((F.col("df") >= config.min_df) & (F.col("df") <= config.max_df * F.col("n")))
    if config.max_features is not None:
        order = Window.partitionBy("country").orderBy(F.desc("cf"), "gram")
        found = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= config.max_features)
    return found.select("country", "gram", "df", "cf", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def unit_postings(tf: DataFrame, vocab: DataFrame, config: TfIdf = TfIdf()) -> DataFrame:
    """(country, id, gram, weight) of unit length for each record; grams outside the vocabulary are dropped."""
    weight = (1 + F.log("tf") if config.sublinear_tf else F.col("tf")) * F.col("idf")
    raw = tf.join(by_shuffle(vocab.select("country", "gram", "idf")), ["country", "gram"]).withColumn("w", weight)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("country", "id")))
    return raw.select("country", "id", "gram", (F.col("w") / norm).alias("weight"))


def sizes_of(texts: DataFrame) -> DataFrame:
    return texts.groupBy("country").agg(F.count("*").alias("n"))


def _fitted(tf: DataFrame, texts: DataFrame, config: TfIdf, fit_on: Column | None) -> DataFrame:
    """The vocabulary of the records that fit it."""
    if fit_on is None and config.fit_sample is None:
        return vocabulary(tf, sizes_of(texts), config)
    chosen = texts if fit_on is None else texts.where(fit_on)
    chosen = chosen if config.fit_sample is None else sampled(chosen, config.fit_sample)
    return vocabulary(tf.join(chosen.select("country", "id"), ["country", "id"], "left_semi"), sizes_of(chosen), config)


def fit_transform(texts: DataFrame, grams: Column, config: TfIdf = TfIdf(), fit_on: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, unit postings of all texts); fit_on says which records the vocabulary is fitted on. The grams are counted
    again for each of the two; fit_vectors() keeps the counts."""
    tf = term_frequencies(texts, grams)
    vocab = _fitted(tf, texts, config, fit_on)
    return vocab, unit_postings(tf, vocab, config)


def text_postings(texts: DataFrame, grams: Column, config: TfIdf = TfIdf()) -> tuple[DataFrame, DataFrame]:
    """(records with the text_id of their text, unit postings of each distinct text of a country by its text_id as id); the
    vocabulary is that of all records."""
    rows = texts.withColumn("text_id", text_id())
    distinct = rows.groupBy("country", "text_id").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    tf = distinct.select("country", F.col("text_id").alias("id"), "copies", F.explode(grams).alias("gram")).groupBy("country", "id", "copies", "gram").agg(F.count("*").alias("tf"))
    return rows.select("country", "id", "text_id"), unit_postings(tf, vocabulary(tf, sizes_of(texts), config), config)


def text_vectors(texts: DataFrame, grams: Column, config: TfIdf = TfIdf(), fit_on: Column | None = None, pack: bool = False) -> DataFrame:
    """(country, text_id, vector) with the unit vector of each distinct text of a country as one array of (gram, weight). A text
    counts in the vocabulary as often as records have it, but its grams are made and kept once. Grams are 64-bit hashes: two of a
    million grams fall together with a probability of 3 in 100 million. Counts are arrays by text, are written once, and meet the
    vocabulary by chunks of texts (counts.py), so no row is made for a gram of a text. If pack, (country, text_id,
    vector, terms, n) for a search as counts.packed_units() makes it, which is a tenth of that and less is written on the way; not with
    max_features."""
    rows = texts.withColumn("text_id", text_id())
    chosen = F.lit(True) if fit_on is None else fit_on
    distinct = rows.groupBy("country", "text_id").agg(F.first("text").alias("text"), F.count_if(chosen).alias("copies"))
    fitting = texts if fit_on is None else texts.where(fit_on)
    if config.fit_sample is not None:
        fitting = sampled(fitting, config.fit_sample)
        copies = fitting.select("country", text_id().alias("text_id")).groupBy("country", "text_id").agg(F.count("*").alias("copies"))
        distinct = distinct.drop("copies").join(by_shuffle(copies), ["country", "text_id"], "left").na.fill(0, ["copies"])
    if pack and config.max_features is None:
        kept = cut_lineage(chunked(distinct, "text_id"))
        drop_shuffles(kept.sparkSession)
        found = cut_lineage(frequencies(asked_of(kept, grams), sizes_of(fitting), config.min_df, config.max_df, pack=True))
        drop_shuffles(kept.sparkSession)
        made = cut_lineage(packed_units(kept, grams, found, "text_id"))
        del kept, found
        drop_shuffles(made.sparkSession)
        return made
    if config.max_features is None:  # else ties of counts go by the gram itself
        kept = cut_lineage(counted(distinct, "text_id", grams))
        found = frequencies(asked(kept), sizes_of(fitting), config.min_df, config.max_df)
        return cut_lineage(unit_arrays(kept, found, "text_id", config.sublinear_tf))
    tf = distinct.select("country", "text_id", "copies", F.explode(grams).alias("gram")).groupBy("country", "text_id", "copies", "gram").agg(F.count("*").alias("tf"))
    kept = cut_lineage(tf.groupBy("country", "text_id", "copies").agg(F.collect_list(F.struct("gram", "tf")).alias("terms")))
    tf = kept.select("country", "text_id", "copies", F.explode("terms").alias("t")).select("country", "text_id", "copies", "t.gram", "t.tf")
    vocab = vocabulary(tf.where("copies > 0"), sizes_of(fitting), config)
    weight = (1 + F.log("tf") if config.sublinear_tf else F.col("tf")) * F.col("idf")
    known = tf.join(by_shuffle(vocab.select("country", "gram", "idf")), ["country", "gram"])
    found = known.select("country", "text_id", F.struct(F.xxhash64("gram").alias("gram"), weight.alias("weight")).alias("x")).groupBy("country", "text_id").agg(F.collect_list("x").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]))
    unit = F.transform("v", lambda x: F.struct(x["gram"].alias("gram"), (x["weight"] / F.col("norm")).alias("weight")))
    return cut_lineage(found.withColumn("norm", norm).select("country", "text_id", unit.alias("vector")))


def fit_vectors(texts: DataFrame, grams: Column, config: TfIdf = TfIdf(), fit_on: Column | None = None) -> DataFrame:
    """(country, id, vector): text_vectors() for each record."""
    rows = texts.select("country", "id", text_id().alias("text_id"))
    return rows.join(by_shuffle(text_vectors(texts, grams, config, fit_on)), ["country", "text_id"]).select("country", "id", "vector")
