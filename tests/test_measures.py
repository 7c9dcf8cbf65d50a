import pytest

from kinlink.operators import evaluate, profile, topk

PAIR = "source1_entity_id string, candidate_entity_id string"


@pytest.fixture(scope="module")
def tables(spark):
    ids = spark.createDataFrame([(f"S1-{i}",) for i in range(9)], "source1_entity_id string")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{j}") for i in range(8) for j in range(i)], PAIR)
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{j}", j // 2 + 1, 0.9 - j / 10) for i in range(1, 9) for j in range(0, 8, 2)], f"{PAIR}, rank int, similarity_score double")
    return ids, truth, pairs


def final_plan(df):
    """The rows, and the plan as they were made: at run time Spark may change a shuffled join to one that sends a side to all."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


MEASURES = {
    "entity_scores": lambda i, t, p: evaluate.entity_scores(i, t, p),
    "sweep_tau": lambda i, t, p: evaluate.sweep_tau(i, t, p, [0.5, 0.8]),
    "sweep_k": lambda i, t, p: evaluate.sweep_k(i, t, p, [1, 2]),
    "pair_completeness": lambda i, t, p: evaluate.pair_completeness(p, t),
    "match_cardinality": lambda i, t, p: profile.match_cardinality(i, t),
    "id_lists": lambda i, t, p: topk.id_lists(i.withColumnRenamed("source1_entity_id", "entity_id"), p),
}


@pytest.mark.parametrize("name", MEASURES)
def test_measures_send_no_table_through_the_driver(tables, name):
    rows, plan = final_plan(MEASURES[name](*tables))
    assert rows and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_completeness_sends_only_the_cuts(tables):
    ids, truth, pairs = tables
    rows, plan = final_plan(evaluate.completeness_at(pairs, truth, [1, 3]))
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") <= 1  # the counts by cut
    found, true = pairs.collect(), {tuple(r) for r in truth.collect()}
    assert {r.k: r.hits for r in rows} == {k: sum((r[0], r[1]) in true and r.rank <= k for r in found) for k in (1, 3)}
