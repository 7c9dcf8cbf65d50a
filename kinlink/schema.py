"""Entity tables and the views of other tables as entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ENTITY = StructType([StructField(c, StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def role_id(key: Column) -> Column:
    """Every tenth record is of the reference table, the others of the two noisy tables."""
    role = F.when(key % 10 == 0, "S1-").when(key % 2 == 1, "S2-").otherwise("S3-")
    return F.concat(role, key.cast("string"))


def part_entities(part: DataFrame) -> DataFrame:
    return part.select(
        role_id(F.col("p_partkey")).alias("entity_id"),
        F.col("p_name").alias("business_name"),
        F.concat_ws(" ", "p_brand", F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("business_address"),
        F.col("p_type").alias("country"),
    )


def document_entities(documents: DataFrame) -> DataFrame:
    """The first line is the name, the rest the address."""
    return documents.select(
        role_id(F.col("doc_id")).alias("entity_id"),
        F.substring_index("text", "\n", 1).alias("business_name"),
        F.expr("substr(text, length(substring_index(text, '\n', 1)) + 2)").alias("business_address"),
        F.col("lang").alias("country"),
    )


#: Places of the postal view: city and state as an address writes them; a blank one is left out.
PLACES = (
    ("Pune", "Maharashtra"), ("Navi Mumbai", "MAHARASHTRA"), ("Bangalore", "Karnataka"), ("", "Tamil Nadu"), ("New Delhi", ""), ("Kochi", "Kerala"), ("Cochin", "KERALA"),
    ("Jammu", "Jammu & Kashmir"), ("", ""), ("Gurugram", "Haryana"), ("Mysuru", "Karnataka"), ("Kolkata", "West Bengal"), ("Surat", "Gujrat"),
)


def postal_entities(part: DataFrame) -> DataFrame:
    """Parts with an address that has a city, a state and a PIN code, or lacks some of them, by their key."""
    key = F.col("p_partkey")
    place = F.array(*(F.struct(F.lit(c).alias("city"), F.lit(s).alias("state")) for c, s in PLACES))[(key % len(PLACES)).cast("int")]
    pin = F.when(key % 7 == 3, "").when(key % 7 == 4, F.concat(F.lit("0"), (key % 90000 + 10000).cast("string"))).otherwise((key * 7919 % 800000 + 110001).cast("string"))
    parts = F.filter(F.array(F.concat(F.lit("Plot "), F.col("p_size").cast("string")), place["city"], F.trim(F.concat_ws(" ", place["state"], pin))), lambda x: x != "")
    return part.select(
        role_id(key).alias("entity_id"),
        F.when(key % 11 == 5, F.concat(F.lit("The "), F.col("p_name"))).when(key % 11 == 6, "").otherwise(F.col("p_name")).alias("business_name"),
        F.when(key % 23 != 0, F.array_join(parts, ", ")).alias("business_address"),
        F.lit("India").alias("country"),
    )


def is_reference(entity_id: Column) -> Column:
    return entity_id.startswith("S1-")


def split_roles(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference records and candidates."""
    return entities.where(is_reference(F.col("entity_id"))), entities.where(~is_reference(F.col("entity_id")))
