import pytest

from kinlink.operators import validate
from kinlink.sources import tsv

PAIR = "source1_entity_id string, matched_entity_ids string"


def lists(spark, rows, name):
    return spark.createDataFrame(rows, f"source1_entity_id string, {name} string")


@pytest.mark.parametrize(
    ("matches", "candidates", "error"),
    [
        (["S2-1", ""], ["S2-1, S3-1", None], None),
        (["S2-1,S2-1", "S9-9"], ["S2-1", ""], "S1-1: duplicate ids in the matches"),
        (["", ""], ["S2-1,S2-1", "S2-1,S2-1"], "S1-1: duplicate ids in the candidates"),
        (["S3-1", ""], ["S2-1", ""], "S1-1: a match outside the candidates: S3-1"),
        (["", ""], ["S2-1", "S2-1,S1-1,S2-9"], "S1-2: a candidate without the prefix S2- or S3-: S1-1"),
        (["", ""], ["S2-1", "S2-1,S2-9,S1-1"], "S1-2: a candidate that the sources don't have: S2-9"),
        (["", ""], ["S2-8", "S2-1,S2-1"], "S1-1: a candidate that the sources don't have: S2-8"),
    ],
)
def test_the_first_fault_is_told(spark, matches, candidates, error):
    need = spark.createDataFrame([("S1-1", 0), ("S1-2", 1)], "entity_id string, row long")
    known = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    m = lists(spark, [(f"S1-{i + 1}", x) for i, x in enumerate(matches)], "matched_entity_ids")
    c = lists(spark, [(f"S1-{i + 1}", x) for i, x in enumerate(candidates)], "candidate_entity_ids")
    assert validate.validate_lists(m, c, need, known) == ([error] if error else [])


def test_rows_and_columns_are_counted(spark):
    need = spark.createDataFrame([("S1-1", 0), ("S1-2", 1)], "entity_id string, row long")
    m, c = lists(spark, [("S1-1", "")], "matched_entity_ids"), lists(spark, [("S1-1", ""), ("S1-2", "")], "candidate_entity_ids")
    assert validate.validate_lists(m, c, need, need) == ["matched_entity_ids: 1 rows, expected 2"]
    assert "columns are" in validate.validate_lists(m.withColumnRenamed("matched_entity_ids", "x"), c, need, need)[-1]


def test_sizes_and_countries(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("12345")
    assert tsv.sizes(spark, [f"{tmp_path}/a.tsv", f"{tmp_path}/b.tsv", str(tmp_path)]) == {f"{tmp_path}/a.tsv": 5, f"{tmp_path}/b.tsv": -1, str(tmp_path): 5}
    rows = spark.createDataFrame([("x",), ("y",), (None,), ("x",)], "country string")
    assert {r.country for r in tsv.countries(rows).collect()} == {"x", "y"}
