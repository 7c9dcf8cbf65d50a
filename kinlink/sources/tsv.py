"""TAB-separated tables of entities, truth and result lists, and checkpoints of whole partitions."""

from __future__ import annotations

import os
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import ENTITY, TRUTH


def read_table(spark: SparkSession, path: str, schema: StructType, null_words: tuple[str, ...] = ()) -> DataFrame:
    """A table with a header, columns taken by name, further columns ignored, short rows filled, nulls as empty strings. A word
    such as NA stays text unless null_words names it. Quotes have no meaning."""
    head = spark.read.text(path).first()
    names = head[0].split("\t") if head else []
    wide = StructType([StructField(n, StringType()) for n in names])
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("enforceSchema", True).schema(wide).csv(path)

    def value(f: StructField):
        if f.name not in names:
            return F.lit("").alias(f.name)
        c = F.coalesce(F.col(f"`{f.name}`"), F.lit(""))
        return (F.when(c.isin(*null_words), "").otherwise(c) if null_words else c).alias(f.name)

    return rows.select(*(value(f) for f in schema.fields))


def numbered(rows: DataFrame, first: str | None = None) -> DataFrame:
    """The rows of files with their place in all of them from 0, as the column row that lists and written files keep. Files come
    in the order of a column `first`, such as the number of their table, and then of their paths. Spark cuts files to blocks and
    packs these in an order of its own, so the blocks are counted, added up in the files' order, and a row's place in its block
    comes on top."""
    block = {"file__": F.col("_metadata.file_path"), "start__": F.col("_metadata.file_block_start"), "first__": F.lit(0) if first is None else F.col(first)}
    tagged = rows.withColumns({**block, "at__": F.monotonically_increasing_id()})
    keys = ["first__", "file__", "start__"]
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # over a row for each block
    blocks = tagged.groupBy(*keys).agg(F.count("*").alias("n"), F.min("at__").alias("least__"))
    blocks = blocks.withColumn("before__", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.col("before__") + F.col("at__") - F.col("least__")
    return tagged.join(blocks, keys).select(*rows.columns, place.alias("row"))


def read_entities(spark: SparkSession, path: str, country: str | None = None, limit: int | None = None, null_words: tuple[str, ...] = ()) -> DataFrame:
    """Entity records with the country stripped; of one country, or the first of the files, if asked for."""
    rows = read_table(spark, path, ENTITY, null_words).withColumn("country", F.regexp_replace("country", r"^\s+|\s+$", ""))
    if limit is not None:
        rows = numbered(rows)
    rows = rows if country is None else rows.where(F.col("country") == country)
    return rows if limit is None else rows.orderBy("row").limit(limit).drop("row")


def read_in_order(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The entity records of several tables, numbered table by table."""
    tables = [read_entities(spark, p).withColumn("table__", F.lit(i)) for i, p in enumerate(paths)]
    rows = [numbered(t) for t in tables]
    sizes = [t.agg(F.count("*")).first()[0] for t in rows[:-1]]
    out = rows[0]
    for i, more in enumerate(rows[1:]):
        out = out.unionByName(more.withColumn("row", F.col("row") + sum(sizes[: i + 1])))
    return out.drop("table__")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return read_entities(spark, path).select(F.regexp_replace("entity_id", r"^\s+|\s+$", "").alias("entity_id")).distinct()


def fetch(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of some ids."""
    return entities.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, TRUTH)


def discover(roots: list[str], files: list[str]) -> str | None:
    """The first of the folders, or of the folders below them, that has all the files."""
    for root in roots:
        for folder, _, names in sorted(os.walk(root)):
            if set(files) <= set(names):
                return folder
    return None


def sizes(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """The bytes of files or folders by their paths; a missing one has -1."""
    folders, conf, out = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), {}
    for p in paths:
        at = folders.Path(p)
        files = at.getFileSystem(conf)
        out[p] = files.getContentSummary(at).getLength() if files.exists(at) else -1
    return out


def countries(entities: DataFrame) -> DataFrame:
    """The distinct countries (country) that records have; records without one have no part in it."""
    return entities.where(F.col("country").isNotNull()).select("country").distinct()


def write_lists(rows: DataFrame, path: str, order: str | None = None) -> None:
    """Two or three text columns as a table with a header; empty lists stay empty. Written by Spark's committer, so that a
    reader sees a complete folder or none; rows are range-sorted by `order` if given, or by a column row, which isn't written."""
    order = "row" if "row" in rows.columns else order
    rows = (rows.orderBy(order) if order else rows).drop("row")
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").csv(path)


def read_lists(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    return read_table(spark, path, StructType([StructField(c, StringType()) for c in columns]))


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """Ranked pairs of all files that match the path, with the columns source1_entity_id, candidate_entity_ids and scores."""
    rows = read_lists(spark, path, ("source1_entity_id", "candidate_entity_ids", "scores")).where("candidate_entity_ids <> ''")
    items = F.arrays_zip(F.split("candidate_entity_ids", ",").alias("id"), F.split("scores", ",").alias("score"))
    return rows.select("source1_entity_id", F.posexplode(items).alias("at", "x")).select(
        "source1_entity_id",
        F.col("x.id").alias("candidate_entity_id"),
        F.col("x.score").cast("double").alias("similarity_score"),
        (F.col("at") + 1).alias("rank"),
    )


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a folder has been written to its end. A storage error is raised, not taken for absence."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def checkpoint(pairs: DataFrame, path: str) -> DataFrame:
    """The pairs, written once by country and read again. Each country has a folder of its own, and one that is finished is taken
    as it is, so a job that is started again does what is left. All countries that are left are one write, so that the pairs are
    computed once; each folder is then moved to its place and marked. A write that is stopped leaves no country half done."""
    spark = pairs.sparkSession
    folders = spark._jvm.org.apache.hadoop.fs
    files = folders.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    name = F.when(F.col("country").isNull(), "none").otherwise(F.concat(F.lit("is-"), F.url_encode("country")))
    done = [p for p in _names(files, folders, path) if finished(spark, f"{path}/{p}")]
    left = pairs.withColumn("folder__", F.regexp_replace(name, r"\+", "%20"))
    if done:
        left = left.join(spark.createDataFrame([(d,) for d in done], "folder__ string"), "folder__", "left_anti")
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    left.repartition("folder__").write.partitionBy("folder__").parquet(staging)
    for folder in _names(files, folders, staging):  # file operations, no jobs
        target = folders.Path(f"{path}/{unquote(folder.removeprefix('folder__='))}")
        files.delete(target, True)
        files.rename(folders.Path(f"{staging}/{folder}"), target)
        files.create(folders.Path(target, "_SUCCESS"), True).close()
    files.delete(folders.Path(staging), True)
    names = [p for p in ("none", "is-*") if _any(spark, f"{path}/{p}")]
    return spark.read.parquet(*(f"{path}/{p}" for p in names)) if names else spark.createDataFrame([], pairs.schema)


def _names(files, folders, path: str) -> list[str]:
    """The folders in a folder, but those that start with a dot or a line."""
    at = folders.Path(path)
    found = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()] if files.exists(at) else []
    return sorted(n for n in found if n[0] not in "._")


def _any(spark: SparkSession, pattern: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A written file or folder at a second place, for a validator that looks there; nothing happens if both are the same."""
    files, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    here, there = (files.Path(p).getFileSystem(conf).makeQualified(files.Path(p)) for p in (source, target))
    if here.equals(there):
        return
    there.getFileSystem(conf).delete(there, True)
    files.FileUtil.copy(here.getFileSystem(conf), here, there.getFileSystem(conf), there, False, conf)


def write_vectors(vectors: DataFrame, path: str, key: str) -> DataFrame:
    """The vectors (country, id, vector), written once under a key that names how they were made, and read again."""
    if not finished(vectors.sparkSession, f"{path}/{quote(key, safe='')}"):
        vectors.write.mode("overwrite").parquet(f"{path}/{quote(key, safe='')}")
    return read_vectors(vectors.sparkSession, path, key)


def read_vectors(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Vectors that were written under the key, or None."""
    folder = f"{path}/{quote(key, safe='')}"
    return spark.read.parquet(folder) if finished(spark, folder) else None
