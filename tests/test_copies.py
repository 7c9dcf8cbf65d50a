import random

import numpy as np
from pyspark.sql import functions as F

from kinlink.functions.grams import word_ngrams
from kinlink.operators import dense, profile, similarity, tfidf

ENTITY = "entity_id string, business_name string, business_address string, country string"


def entities(spark, texts, copies):
    rows = [(f"S{1 + i % 3}-{i + len(texts) * 3 * c}", t, "", "A") for i, t in enumerate(texts) for c in range(copies)]
    table = spark.createDataFrame(rows, ENTITY)
    return table.where("entity_id like 'S1-%'"), table.where("entity_id not like 'S1-%'")


def test_copies_are_searched_once_and_ranked_by_id(spark, monkeypatch):
    r = random.Random(1)
    words = ["red", "blue", "bolt", "ring", "nut", "cog", "old", "new"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(30)]
    reference, candidates = entities(spark, texts, 5)
    met, real = [], similarity.block_pairs

    def counted(queries, found, *rest):
        met.append((queries.count(), found.count()))
        return real(queries, found, *rest)

    monkeypatch.setattr(similarity, "block_pairs", counted)
    grams = lambda t: word_ngrams(t, 1, 1)
    got = similarity.sparse_top_k(reference, candidates, F.col("business_name"), grams, tfidf.TfIdf(min_df=2), k=7, floor=0.1)
    got = {(x.source1_entity_id, x.rank): (x.candidate_entity_id, x.similarity_score) for x in got.collect()}
    assert met == [(len(set(texts[::3])), len({t for i, t in enumerate(texts) if i % 3}))]
    # Each record by itself, without classes of texts.
    rows = [(x.entity_id, x.business_name.split()) for x in reference.union(candidates).collect()]
    names = sorted(set(words) & {w for _, t in rows for w in t})
    tf = np.array([[t.count(w) for w in names] for _, t in rows], dtype=float)
    idf = np.log((1 + len(rows)) / (1 + (tf > 0).sum(axis=0))) + 1
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    score = np.floor(x @ x.T * 10**6 + 0.5) / 10**6
    want = {}
    for q, (name, _) in enumerate(rows):
        if name.startswith("S1-"):
            best = sorted((-score[q, c], other) for c, (other, _) in enumerate(rows) if not other.startswith("S1-") and score[q, c] > 0.1)
            want |= {(name, k): (other, -s) for k, (s, other) in enumerate(best[:7], 1)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_large_tables_are_not_sent_through_the_driver(spark):
    """The joins of a search are shuffled, whatever the size of the files lets Spark estimate."""
    reference, candidates = entities(spark, ["red bolt", "old ring", "new cog"] * 4, 3)
    found = similarity.sparse_top_k(reference, candidates, F.col("business_name"), lambda t: word_ngrams(t, 1, 1), tfidf.TfIdf(min_df=1))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 4 and plan.count("BroadcastHashJoin") <= 2  # the sizes of countries alone are sent


def test_retention_by_groups_equals_that_of_pairs(spark):
    r = random.Random(2)
    records = [(f"S{r.choice([1, 1, 2, 3])}-{i}", f"g{r.randrange(6)}", r.choice(["a b", "b a", "a c d", "", None])) for i in range(60)]
    ids = spark.createDataFrame(records, "id string, group string, business_address string").withColumn("asked", F.col("id").startswith("S1-"))
    a = ids.where("asked").select(F.col("id").alias("source1_entity_id"), "group")
    truth = a.join(ids.where("not asked").select(F.col("id").alias("candidate_entity_id"), "group"), "group").drop("group")
    keys = [(i, s, r.choice(["", "x", "y"])) for i, *_ in records for s in ("one", "two")]
    keys = spark.createDataFrame(keys, "id string, strategy string, key string")
    want = sorted(profile.key_retention(truth, keys).collect())
    assert sorted(profile.group_key_retention(keys.join(ids, "id")).collect()) == want and want
    sets = [(i, s, r.choice([[], ["x"], ["x", "y"], ["z"]])) for i, *_ in records for s in ("one", "two")]
    sets = spark.createDataFrame(sets, "id string, scheme string, keys array<string>")
    assert sorted(profile.group_set_retention(sets.join(ids, "id")).collect()) == sorted(profile.set_retention(truth, sets).collect())
    one = profile.token_change_rates(profile.address_pairs(ids.withColumnRenamed("id", "entity_id"), truth)).first()
    pairs = profile.group_address_pairs(ids)
    two = profile.token_change_rates(pairs).first()
    assert np.allclose(one, two, atol=1e-12) and one.pairs > pairs.count()


def test_projection_makes_no_row_for_a_gram_and_dimension(spark):
    postings = spark.createDataFrame([("A", f"r{i}", f"g{(i * j) % 7}", 0.1 * j) for i in range(6) for j in range(1, 4)], "country string, id string, gram string, weight double")
    got = dense.random_projection(postings, 16)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    signs = F.array(*[F.when(F.xxhash64("gram", F.lit(42_000 + j)) % 2 == 0, F.col("weight")).otherwise(-F.col("weight")) for j in range(16)])
    sums = {}
    for x in postings.select("id", signs.alias("x")).collect():
        sums[x.id] = sums.get(x.id, 0) + np.array(x.x)
    assert all(np.allclose(x.vector, sums[x.id] / np.linalg.norm(sums[x.id])) for x in got.collect())


def test_search_sends_no_vectors_through_the_driver(spark):
    """Groups are told from each other without a join by which Spark may send the vectors to all at run time."""
    rows = "country string, id string, vector array<struct<gram:bigint,weight:double>>"
    table = spark.createDataFrame([("A", f"{i}", [(1, 1.0)]) for i in range(9)], rows)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = similarity.block_pairs(table, table, 3, 0.1)
        plan = found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 2 and all("BroadcastHashJoin" in line and "BuildRight" in line and "LeftOuter" in line for line in joins)


def test_groups_of_all_sizes_are_searched_whole(spark, monkeypatch):
    """Groups of one block and of many, without queries or without candidates; a missing country or key meets nothing."""
    monkeypatch.setattr(similarity, "BLOCK", 4)
    monkeypatch.setattr(similarity, "PART", 3)
    monkeypatch.setattr(similarity, "LANE", 2)
    r = random.Random(3)
    sides = []
    for side, sizes in (("q", {"A": 11, "B": 2, "C": 0, "D": 5, None: 3}), ("c", {"A": 30, "B": 3, "C": 6, "D": 0, None: 3})):
        sides.append([(c, k, f"{side}{c}{k}{i}", [(g, r.random()) for g in sorted(r.sample(range(6), 3))]) for c, n in sizes.items() for k in ("x", None) for i in range(n)])
    ddl = "country string, key string, id string, vector array<struct<gram:bigint,weight:double>>"
    found = similarity.block_top_k(*(spark.createDataFrame(side, ddl) for side in sides), 4, 0.1).collect()
    want = {}
    for c, k, q, v in sides[0]:
        scores = [(-np.floor(sum(w * dict(u).get(g, 0) for g, w in v) * 10**6 + 0.5) / 10**6, other) for d, m, other, u in sides[1] if c and k and (c, k) == (d, m)]
        want |= {(q, i): (other, -s) for i, (s, other) in enumerate(sorted(x for x in scores if x[0] < -0.1)[:4], 1)}
    got = {(x.source1_entity_id, x["rank"]): (x.candidate_entity_id, x.similarity_score) for x in found}
    assert len({q for q, _ in want}) > 10 and got.keys() == want.keys()
    assert all(abs(got[x][1] - want[x][1]) < 2e-6 for x in want)
