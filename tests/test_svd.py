import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.operators import svd

SCHEMA = "country string, id string, gram string, weight double"


def matrix(n, m, seed=0, density=0.08):
    rng = np.random.default_rng(seed)
    topic = rng.integers(0, 20, n)  # twenty groups of records, each with grams of its own
    own = rng.random((20, m)) < 0.2
    return np.where((rng.random((n, m)) < 0.7) & own[topic], 1 + topic[:, None] / 5, 0) + np.where(rng.random((n, m)) < density / 10, 0.2, 0)


def rows_of(x):
    return [("c", f"r{i}", f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]


def dense(x, k):
    u, s, v = np.linalg.svd(x, full_matrices=False)
    t = x @ v[:k].T
    return s[:k], t, t.var(axis=0) / x.var(axis=0).sum()


@pytest.mark.parametrize("side", [svd.SIDE, 70])
def test_against_a_dense_decomposition(spark, monkeypatch, side):
    monkeypatch.setattr(svd, "SIDE", side)
    x = matrix(400, 250)
    values, t, explained = dense(x, 20)
    found = svd.truncated_svd(spark.createDataFrame(rows_of(x), SCHEMA), 20, iterations=8)
    assert found.singular_values == pytest.approx(values, rel=1e-3) and found.explained == pytest.approx(explained, abs=1e-3)
    got = {r.id: np.array(r.vector) for r in found.transform(spark.createDataFrame(rows_of(x), SCHEMA)).collect()}
    unit = t / np.linalg.norm(t, axis=1, keepdims=True)
    mine = np.stack([got[f"r{i}"] for i in range(400)])
    assert np.abs(mine @ mine.T - unit @ unit.T).max() < 1e-3


def test_other_records_and_unknown_grams(spark):
    x, y = matrix(300, 80, 1), matrix(40, 80, 2)
    found = svd.truncated_svd(spark.createDataFrame(rows_of(x), SCHEMA), 12, iterations=12)
    more = [*rows_of(y), ("c", "r1", "strange", 9.0), ("c", "lone", "strange", 1.0)]
    got = {r.id: np.array(r.vector) for r in found.transform(spark.createDataFrame(more, SCHEMA), unit_length=False).collect()}
    _, _, v = np.linalg.svd(x, full_matrices=False)
    want = y @ v[:12].T
    assert set(got) == {f"r{i}" for i in range(40) if y[i].any()}
    assert np.abs(np.abs(np.stack([got[f"r{i}"] for i in range(40)])) - np.abs(want)).max() < 1e-3


def test_more_components_than_rank_and_no_rows(spark):
    rows = [("c", f"r{i}", f"g{j}", float((i + 1) * (j + 2))) for i in range(5) for j in range(4)]
    found = svd.truncated_svd(spark.createDataFrame(rows, SCHEMA), 8)
    assert found.components == 1 and found.explained == pytest.approx([1.0])
    empty = spark.createDataFrame([], SCHEMA)
    none = svd.truncated_svd(empty, 8)
    assert none.components == 0 and none.transform(empty).count() == 0


def test_128_dimensions_of_the_parts(spark):
    """The sample parts as one table: cosines and variance as a dense decomposition has them."""
    from kinlink.functions.grams import char_wb
    from kinlink.operators import tfidf

    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    texts = part.select(F.lit("all").alias("country"), F.col("p_partkey").cast("string").alias("id"), F.lower("p_name").alias("text"))
    _, postings = tfidf.fit_transform(texts, char_wb(F.col("text"), 3, 4), tfidf.TfIdf(min_df=2, max_df=0.5))
    found = svd.truncated_svd(postings, 128)
    p = postings.toPandas()
    ids, grams = {x: i for i, x in enumerate(sorted(p["id"].unique()))}, {x: i for i, x in enumerate(sorted(p["gram"].unique()))}
    x = np.zeros((len(ids), len(grams)))
    x[p["id"].map(ids), p["gram"].map(grams)] = p["weight"]
    values, t, explained = dense(x, 128)
    k = found.components
    assert abs(found.explained.sum() - explained.sum()) < 1e-3 and found.singular_values == pytest.approx(values[:k], abs=1e-3)
    got = {r.id: np.array(r.vector) for r in found.transform(postings).collect()}
    mine = np.stack([got[i] for i in ids])
    unit = t / np.linalg.norm(t, axis=1, keepdims=True)
    assert np.abs(mine @ mine.T - unit @ unit.T).max() < 1e-3


def test_thin_matrices_are_not_sent_through_the_driver(spark):
    """Pieces of some MB each look like rows of some bytes to Spark's estimates."""
    x = matrix(60, 40)
    met, real = [], svd._added
    postings = spark.createDataFrame(rows_of(x), SCHEMA)

    def kept(rows, *rest):
        met.append(rows._jdf.queryExecution().sparkPlan().toString())
        return real(rows, *rest)

    svd._added = kept
    try:
        found = svd.truncated_svd(postings, 5, iterations=1).transform(postings)
    finally:
        svd._added = real
    plans = [p for p in met if "Join" in p] + [found._jdf.queryExecution().sparkPlan().toString()]
    assert len(plans) >= 4 and not any("BroadcastHashJoin" in p for p in plans)
