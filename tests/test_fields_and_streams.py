import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.functions import keys as K
from kinlink.functions.grams import word_ngrams
from kinlink.operators import dense, profile, tfidf
from kinlink.schema import postal_entities
from kinlink.sources import tsv
from kinlink.streaming.match import match_stream, rate_of

SCHEMA = "entity_id string, business_name string, business_address string, country string"


@pytest.mark.parametrize(
    ("address", "pin", "state", "short", "city"),
    [
        ("MG Road, Bangalore, Karnataka 560001", "560001", "KA", "KA", "bengaluru"), ("Sector 15, Navi Mumbai, Maharashtra 400703", "400703", "MH", "MH", "mumbai"),
        ("Jammu & Kashmir 012345", "", "JK", "", "jammu"), ("New Delhi 110001", "110001", "DL", "DL", "delhi"), ("TG 500001 and 500002", "500001", "", "TS", ""),
        ("Gurugram, Cochin", "", "", "", "kochi"), ("1234567", "", "", "", ""), ("", "", "", "", ""), (None, "", "", "", ""),
    ],
)
def test_fields_of_an_address(spark, address, pin, state, short, city):
    a = F.col("a")
    row = spark.createDataFrame([(address,)], "a string").select(K.pincode(a), K.state(a), K.state_short(a), K.city(a)).first()
    assert tuple(row) == (pin, state, short, city)


def test_presence_of_fields(spark):
    rows = [("S1-1", "n", "Pune 411001", "x"), ("S1-2", "n", "Pune", "x"), ("S1-3", "n", None, "x"), ("S1-4", "n", "", "x")]
    a = F.col("business_address")
    got = profile.field_presence(spark.createDataFrame(rows, SCHEMA), {"pin": K.pincode(a), "city": K.city(a), "state": K.state(a)})
    assert {r.field: r.presence for r in got.collect()} == {"pin": 0.25, "city": 0.5, "state": 0.0}


def test_postal_view_has_every_case(spark):
    part = spark.range(2000).select(F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.lit(3).alias("p_size"))
    got = postal_entities(part).collect()
    assert {bool(r.business_name) for r in got} == {True, False} and any(r.business_address is None for r in got)
    assert any(r.business_address == "Plot 3" for r in got) and any(r.business_address and r.business_address.endswith(" 010004") or " 0" in (r.business_address or "") for r in got)


def test_encoding_by_a_function(spark):
    def encoder(texts):
        return np.array([[len(t), t.count("a")] for t in texts])

    texts = spark.createDataFrame([("x", f"i{n}", "a" * n + "b") for n in range(50)], "country string, id string, text string").repartition(3)
    got = {r.id: r.vector for r in dense.encode(texts, encoder).collect()}
    assert got == {f"i{n}": [n + 1.0, float(n)] for n in range(50)}
    assert dense.encode(texts.limit(0), encoder).count() == 0


def test_a_stream_meets_a_static_index(spark, tmp_path):
    texts = spark.createDataFrame([("x", "S2-1", "red bolt"), ("x", "S2-2", "blue gear"), ("y", "S2-3", "red bolt")], "country string, id string, text string")
    vocab, postings = tfidf.fit_transform(texts, word_ngrams(F.col("text"), 1, 1), tfidf.TfIdf(min_df=1))
    spark.createDataFrame([("x", "S1-1", "red bolt"), ("x", "S1-2", "gear"), ("z", "S1-3", "red")], texts.schema).write.parquet(f"{tmp_path}/in")
    found, rates = [], []

    def sink(pairs, number):
        found.extend(pairs.collect())
        rates.append(rate_of(pairs).first())

    stream = spark.readStream.schema(texts.schema).parquet(f"{tmp_path}/in")
    query = match_stream(stream, vocab, postings, word_ngrams(F.col("text"), 1, 1), sink, tfidf.TfIdf(min_df=1))
    query.option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.source1_entity_id, r.candidate_entity_id, r["rank"]) for r in found} == {("S1-1", "S2-1", 1), ("S1-2", "S2-2", 1)}
    assert sum(r.pairs for r in rates) == 2


def test_finding_and_reading_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for f in ("x.tsv", "y.tsv"):
        (tmp_path / "a" / "b" / f).write_text("source1_entity_id\tcandidate_entity_ids\tscores\nS1-1\tS2-1,S3-2\t0.5,0.25\nS1-2\t\t\n")
    assert tsv.discover([str(tmp_path)], ["x.tsv", "y.tsv"]) == f"{tmp_path}/a/b" and tsv.discover([str(tmp_path)], ["z.tsv"]) is None
    got = sorted(map(tuple, tsv.read_partials(spark, f"{tmp_path}/a/b/x.tsv").collect()))
    assert got == [("S1-1", "S2-1", 0.5, 1), ("S1-1", "S3-2", 0.25, 2)]
    rows = spark.createDataFrame([("S1-1", "n", "a", "x"), ("S1-2", "n", "a", "x")], SCHEMA)
    assert [r.entity_id for r in tsv.fetch(rows, rows.limit(1).union(rows.limit(1))).collect()] == ["S1-1"]
