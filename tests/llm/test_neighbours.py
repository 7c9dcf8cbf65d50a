"""The inverted multi-index on tables that it doesn't search whole, against exact inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.llm import neighbours

N, STEP = 20_000, 400


def vectors(kind, seed=4):
    rng = np.random.default_rng(seed)
    if kind == "clustered":  # of unequal lengths
        centres = rng.standard_normal((400, 48))
        return (centres[rng.integers(0, 400, N)] + 0.25 * rng.standard_normal((N, 48))) * np.exp(0.3 * rng.standard_normal((N, 1)))
    x = rng.standard_normal((N, 16))
    return x / np.linalg.norm(x, axis=1)[:, None] * np.exp(0.5 * rng.standard_normal((N, 1))) ** (kind == "unequal")


def table_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)


@pytest.mark.parametrize(("kind", "most"), [("unit", 0.5), ("unequal", 0.5), ("clustered", 0.2)])
def test_recall_and_share(spark, kind, most):
    x = vectors(kind)
    df = table_of(spark, x)
    found = {(r.query_id, r.vec_id) for r in neighbours.search(df, STEP).collect()}
    asked = range(0, N, STEP)
    score = x[::STEP] @ x.T
    best = {(q, int(i)) for k, q in enumerate(asked) for i in [i for i in np.argsort(-score[k])[:21] if i != q][:20]}
    assert len(found) == 20 * len(asked) and len(found & best) >= 0.9 * len(best)
    entries = df.select("embedding", F.array("vec_id").alias("ids"), F.col("vec_id").alias("entry"))
    fit, celled = neighbours.fitted(entries, entries.where(F.col("entry") % STEP == 0))
    assert fit.entries == celled.count() == N and fit.enough < most * N


def test_repeated_ids_are_one_candidate_and_one_query(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(0, [9.0] * 6), (1, [-9.0] * 6), (1, [-9.0] * 6), (20, rows[20][1]), (40, [float("nan")] * 6)]
    one = {}
    for i, v in rows:
        if not any(np.isnan(v)):
            one[i] = min(one.get(i, v), v)
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == {0, 20, 40}
    for q, found in got.items():
        best = sorted((i for i in one if i != q), key=lambda i: (-np.dot(one[i], one[q]), i))[:20]
        assert [v for _, v in sorted(found)] == best and [n for n, _ in sorted(found)] == list(range(1, 21))
