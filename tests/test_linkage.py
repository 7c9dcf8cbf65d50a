import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.functions.grams import char_wb
from kinlink.operators import dense, evaluate, profile, similarity, topk, validate
from kinlink.operators.tfidf import TfIdf
from kinlink.plans.linkage import Linkage, link
from kinlink.sources import tsv

ROWS = [
    ("S1-1", "red bolt", "brand 1", "A"), ("S1-2", "blue gear", "brand 2", "A"), ("S1-3", "odd", None, "B"),
    ("S2-1", "red bolt", "brand 1", "A"), ("S2-2", "red bolts", "brand 3", "A"), ("S3-1", "blue gears", "brand 2", "A"),
    ("S3-2", "blue rod", "brand 9", "C"), ("S3-3", None, "", "A"),
]
SCHEMA = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture
def entities(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def parts(entities):
    ref = F.col("entity_id").startswith("S1-")
    return entities.where(ref), entities.where(~ref)


def text():
    return F.lower(F.concat_ws(" ", F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))))


def grams_of(t):
    return [g for w in t.split() for n in (3, 4) for p in [f" {w} "] if len(p) >= n for g in (p[i : i + n] for i in range(len(p) - n + 1))]


def brute(country="A", min_df=1):
    docs = {r[0]: Counter(grams_of(f"{r[1] or ''} {r[2] or ''}".lower())) for r in ROWS if r[3] == country}
    df = Counter(g for d in docs.values() for g in d)
    unit = {}
    for k, d in docs.items():
        w = {g: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, n in d.items() if df[g] >= min_df}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1
        unit[k] = {g: x / norm for g, x in w.items()}
    return {(a, b): round(sum(x * unit[b].get(g, 0) for g, x in unit[a].items()), 6) for a in docs for b in docs if a.startswith("S1") and not b.startswith("S1")}


def test_sparse_top_k_against_brute_force(entities):
    got = similarity.sparse_top_k(*parts(entities), text(), lambda c: char_wb(c, 3, 4), TfIdf(min_df=1), k=5, floor=0.0).collect()
    assert {(r.source1_entity_id, r.candidate_entity_id): r.similarity_score for r in got} == pytest.approx({k: v for k, v in brute().items() if v > 0}, abs=1e-6)
    for q in {r.source1_entity_id for r in got}:
        mine = sorted((r for r in got if r.source1_entity_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert all(a.similarity_score >= b.similarity_score for a, b in zip(mine, mine[1:], strict=False))


def test_two_passes_equal_one(entities):
    ref, cand = parts(entities)
    sources = [cand.where(F.col("entity_id").startswith(s)) for s in ("S2-", "S3-")]
    options = {"config": TfIdf(min_df=1), "k": 2, "floor": 0.05}
    one = similarity.sparse_top_k(ref, cand, text(), lambda c: char_wb(c, 3, 4), **options)
    two = similarity.two_pass_top_k(ref, sources, text(), lambda c: char_wb(c, 3, 4), **options)
    columns = ["source1_entity_id", "candidate_entity_id", "similarity_score", "rank"]
    assert sorted(one.select(columns).collect()) == sorted(two.select(columns).collect())


def test_two_stage_and_keys(entities):
    ref, cand = parts(entities)
    got = similarity.two_stage_top_k(ref, cand, text(), lambda c: F.split(c, " "), lambda c: char_wb(c, 3, 4), TfIdf(min_df=1), TfIdf(min_df=1), k=1).collect()
    assert {(r.source1_entity_id, r.candidate_entity_id) for r in got} == {("S1-1", "S2-1"), ("S1-2", "S3-1")}
    keyed = similarity.keyed_top_k(ref, cand, text(), F.array(F.substring("business_name", 1, 1)), lambda c: char_wb(c, 3, 4), TfIdf(min_df=1), floor=0.0).collect()
    assert {r.candidate_entity_id for r in keyed if r.source1_entity_id == "S1-1"} == {"S2-1", "S2-2"}


@pytest.mark.parametrize(
    ("truth", "pred", "p", "r", "f"),
    [("", "", 1, 1, 1), ("", "a", 0, 0, 0), ("a", "", 0, 0, 0), ("a", "b", 0, 0, 0), ("a,c", "a,b,c", 2 / 3, 1, 0.714286), ("a,b", "a", 1, 0.5, 0.833333)],
)
def test_metric_table(spark, truth, pred, p, r, f):
    ids = spark.createDataFrame([("S1-1",)], "source1_entity_id string")
    true = evaluate.truth_pairs(spark.createDataFrame([("S1-1", truth)], "source1_entity_id string, matched_entity_ids string"))
    pairs = spark.createDataFrame([("S1-1", x) for x in pred.split(",") if x], "source1_entity_id string, candidate_entity_id string")
    row = evaluate.entity_scores(ids, true, pairs).first()
    assert (row.precision, row.recall, row.f_beta) == pytest.approx((p, r, f), abs=1e-6)


def test_truth_parsing_and_completeness(spark):
    rows = [("S1-1", " S2-1 ,S3-1,"), ("S1-2", "nan"), ("S1-3", None)]
    true = evaluate.truth_pairs(spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string"))
    assert sorted(map(tuple, true.collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-1")]
    pairs = spark.createDataFrame([("S1-1", "S3-1", 2)], "source1_entity_id string, candidate_entity_id string, rank int")
    assert [r.pair_completeness for r in evaluate.completeness_at(pairs, true, [1, 2]).orderBy("k").collect()] == [0.0, 0.5]
    assert evaluate.pair_completeness(pairs, true.limit(0)).first().pair_completeness == 1.0


def test_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\textra\nS1-1\tNA\t5" pipe\t US \tx\nS1-2\tshort\n', encoding="utf-8")
    got = {r.entity_id: r for r in tsv.read_entities(spark, str(path)).collect()}
    assert (got["S1-1"].business_name, got["S1-1"].business_address, got["S1-1"].country) == ("NA", '5" pipe', "US")
    assert got["S1-2"].business_address == ""
    rows = spark.createDataFrame([("S1-3", ""), ("S1-1", "S2-1,S3-4")], "source1_entity_id string, matched_entity_ids string")
    tsv.write_lists(rows, str(tmp_path / "out"), "source1_entity_id")
    back = tsv.read_lists(spark, str(tmp_path / "out"), ("source1_entity_id", "matched_entity_ids"))
    assert sorted(map(tuple, back.collect())) == [("S1-1", "S2-1,S3-4"), ("S1-3", "")]


def test_lists_round_trip(spark):
    pairs = spark.createDataFrame([("S1-1", "S2:9", 0.5, 1), ("S1-1", "S3-1", 0.25, 2)], "source1_entity_id string, candidate_entity_id string, similarity_score double, rank int")
    assert sorted(map(tuple, topk.parse_scored_lists(topk.scored_lists(pairs)).collect())) == [("S1-1", "S2:9", 0.5, 1), ("S1-1", "S3-1", 0.25, 2)]


def test_job_files_are_valid(spark, entities, tmp_path):
    ref, cand = parts(entities)
    job = link(ref, [cand], Linkage(tfidf=TfIdf(min_df=1), fit_prefix=None, tau=0.9))
    job.write(str(tmp_path))
    report = validate.validate_files(spark, f"{tmp_path}/matching_results.tsv", f"{tmp_path}/candidate_pairs.tsv", ref, cand)
    assert report.ok and not report.warnings and report.rows == 3 and report.empty == 2


@pytest.mark.parametrize(
    ("body", "issue"),
    [
        ("source1_entity_id,matched_entity_ids\n", "COMMA"), ("a\tb\n", "header"), ("", "empty"), ("H\nS1-1\t\nS1-2 S2-1\n", "no TAB"),
        ("H\nS1-1\t\nS1-1\t\n", "duplicate row"), ("H\nS1-1\tS2-1,S2-1\n", "duplicate id"), ("H\nS1-1\tS1-2\n", "self match"),
        ("H\nS1-1\tX9-1\n", "bad prefix"), ("H\nS1-1\tS2-9\n", "id not in the sources"), ("H\n", "missing id"), ("H\nS1-1 \t\n", "unknown id"),
    ],
)
def test_validator_finds(spark, tmp_path, body, issue):
    path = tmp_path / "m.tsv"
    path.write_text(body.replace("H\n", "source1_entity_id\tmatched_entity_ids\n"), encoding="utf-8")
    need = spark.createDataFrame([("S1-1",)], "entity_id string")
    known = spark.createDataFrame([("S2-1",)], "entity_id string")
    report = validate.validate_files(spark, str(path), None, need, known)
    assert any(issue in e for e in report.errors) and report.warnings


def test_dense(spark):
    rows = [(f"{'S1' if i % 4 == 0 else 'S2'}-{i}", [math.cos(i), math.sin(i), 0.1], "x") for i in range(40)]
    v = spark.createDataFrame(rows, "id string, vector array<float>, country string")
    q, c = v.where(F.col("id").startswith("S1")), v.where(F.col("id").startswith("S2"))
    exact, near = dense.dense_top_k(q, c, 3), dense.cell_top_k(q, c, 3, probes=8, cells=8)
    key = ["source1_entity_id", "candidate_entity_id", "rank"]
    assert sorted(exact.select(key).collect()) == sorted(near.select(key).collect())


def test_dense_cells_recall(spark, monkeypatch):
    monkeypatch.setattr(dense, "LEAST_ENTRIES", 100, raising=False)
    rng = np.random.default_rng(0)
    rows = [(f"{'S1' if i % 40 == 0 else 'S2'}-{i}", [float(y) for y in v], "x" if i % 3 else "y") for i, v in enumerate(rng.standard_normal((4000, 32)))]
    v = spark.createDataFrame(rows, "id string, vector array<float>, country string")
    q, c = v.where(F.col("id").startswith("S1")), v.where(F.col("id").startswith("S2"))
    key = ["source1_entity_id", "candidate_entity_id"]
    exact, near = (set(map(tuple, x.select(key).collect())) for x in (dense.dense_top_k(q, c, 10), dense.cell_top_k(q, c, 10)))
    assert len(near) == len(exact) == 1000 and len(exact & near) >= 0.9 * len(exact)


def test_profiles(spark, entities):
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S3-1")], "source1_entity_id string, candidate_entity_id string")
    assert {r.matches: r.ids for r in profile.match_cardinality(spark.createDataFrame([("S1-1",), ("S1-3",)], "source1_entity_id string"), truth).collect()} == {0: 1, 1: 1}
    keys = spark.createDataFrame([("S1-1", "s", "a"), ("S2-1", "s", "a"), ("S1-2", "s", ""), ("S3-1", "s", "")], "id string, strategy string, key string")
    assert profile.key_retention(truth, keys).first().retention == 0.5
    row = profile.block_profile(keys).first()
    assert (row.blocks, row.largest, row.reduction_ratio) == (2, 2, 0.5)
    assert {r.country: r.total for r in profile.country_by_source(entities).collect()} == {"A": 6, "B": 1, "C": 1}
