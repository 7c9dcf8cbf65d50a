import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.functions.grams import word_ngrams
from kinlink.functions.text import romanised_word
from kinlink.operators import dense, evaluate, profile, similarity, sizing, topk, validate
from kinlink.operators.tfidf import TfIdf, fit_transform
from kinlink.schema import split_roles
from kinlink.sources import tsv

PAIRS = "country string, source1_entity_id string, candidate_entity_id string, similarity_score double, rank int"


@pytest.mark.parametrize(
    ("word", "plain"),
    [("Москва", "Moskva"), ("щука", "shchuka"), ("Ελλάδα", "Ellada"), ("Αθήνα", "Athina"), ("서울", "seoul"), ("ひらがな", "hiragana"), ("كتاب", "ktab"), ("Łódź", "Lodz"), ("東京", "東京")],
)
def test_other_scripts(word, plain):
    assert romanised_word(word) == plain


@pytest.mark.parametrize("block", [dense.BLOCK, 16])
def test_dense_blocks_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dense, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 12))
    x[50:90] = x[50]  # ties go to the smaller id
    x[7] = 0
    rows = [(f"{'q' if i % 8 == 0 else 'c'}{i:03d}", x[i].tolist(), "a" if i % 3 else "b") for i in range(200)]
    df = spark.createDataFrame([*rows, ("q999", x[1].tolist(), "alone")], "id string, vector array<double>, country string")
    got = {}
    for r in dense.dense_top_k(df.where("id like 'q%'"), df.where("id like 'c%'"), 5).collect():
        got.setdefault(r.source1_entity_id, []).append((r["rank"], r.candidate_entity_id, r.similarity_score))
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v, _ in rows}
    for i, _, c in rows:
        if i[0] == "q":
            best = sorted(((-round(float(unit[i] @ unit[j]), 5) + 0.0, j) for j, _, d in rows if j[0] == "c" and d == c))[:5]
            assert [(n, j) for n, j, _ in sorted(got[i])] == [(k + 1, j) for k, (_, j) in enumerate(best)]
    assert "q999" not in got


def test_checkpoint_goes_on_by_country(spark, tmp_path):
    path = f"{tmp_path}/pairs"
    first = spark.createDataFrame([("A b/c", "S1-1", "S2-1", 0.5, 1), (None, "S1-2", "S2-2", 0.4, 1), ("", "S1-3", "S2-3", 0.3, 1)], PAIRS)
    assert sorted(r.source1_entity_id for r in tsv.checkpoint(first, path).collect()) == ["S1-1", "S1-2", "S1-3"]
    shutil.rmtree(f"{path}/none")  # as if the job had been stopped before
    again = tsv.checkpoint(first.withColumn("rank", first["rank"] + 1), path)
    assert {(r.source1_entity_id, r["rank"]) for r in again.collect()} == {("S1-1", 1), ("S1-2", 2), ("S1-3", 1)}
    assert tsv.checkpoint(first.limit(0), f"{tmp_path}/empty").count() == 0


def test_vectors_are_kept_under_their_key(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", [1.0, 2.0])], "country string, id string, vector array<double>")
    assert tsv.read_vectors(spark, str(tmp_path), "model 1") is None
    assert tsv.write_vectors(rows, str(tmp_path), "model 1").collect() == rows.collect()
    assert tsv.write_vectors(rows.limit(0), str(tmp_path), "model 1").count() == 1


def test_lists_keep_the_order_of_the_input(spark, tmp_path):
    ids = [f"S1-{i}" for i in (5, 3, 9, 1)]
    (tmp_path / "in.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"{i}\tn\ta\tX\n" for i in ids))
    reference = tsv.numbered(tsv.read_entities(spark, f"{tmp_path}/in.tsv"))
    pairs = spark.createDataFrame([("X", "S1-3", "S2-1", 0.5, 1)], PAIRS)
    tsv.write_lists(topk.id_lists(reference, pairs), f"{tmp_path}/out")
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines() if not x.startswith("source1")]
    assert lines == [f"{i}\tS2-1" if i == "S1-3" else f"{i}\t" for i in ids]


def test_a_repeated_header_is_reported(spark, tmp_path):
    head = "source1_entity_id\tmatched_entity_ids\n"
    (tmp_path / "m.tsv").write_text(head + "S1-1\tS2-1\n" + head)
    report = validate.validate_files(spark, f"{tmp_path}/m.tsv")
    assert any("repeated header (1)" in e for e in report.errors) and report.exit_code == 1


def test_sample_of_true_pairs(spark):
    entities = spark.createDataFrame([(f"S{s}-{i}", f"n{s}{i}", f"a{s}{i}", "X") for s in (1, 2) for i in range(9)], "entity_id string, business_name string, business_address string, country string")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(9)], "source1_entity_id string, candidate_entity_id string")
    rows = profile.sample_pairs(entities, truth, 4).collect()
    assert len(rows) == 4 and all((r.name1, r.address2) == (f"n1{r.source1_entity_id[3:]}", f"a2{r.source1_entity_id[3:]}") for r in rows)


def test_blocked_search_equals_all_pairs(spark, monkeypatch):
    # Small blocks, parts and chunks; many equal texts, so that ties decide; records without a gram; a country without queries.
    r = random.Random(3)
    texts = [" ".join(r.choice(("ab", "cd", "ef", "gh", "ij", "kl")) for _ in range(r.randrange(5))) for _ in range(150)]
    rows = [(f"{'S1' if i % 4 == 0 and i < 120 else 'S2'}-{i}", t, "", "XY"[i % 3 == 0] if i < 120 else "Z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    monkeypatch.setattr(similarity, "BLOCK", 7)
    monkeypatch.setattr(similarity, "PART", 5)
    reference, candidates = split_roles(docs)
    everything = similarity.texts_of(docs, F.col("business_name"))
    _, postings = fit_transform(everything, word_ngrams(F.col("text"), 1, 2), TfIdf(min_df=1))
    weights = {}
    for p in postings.collect():
        weights.setdefault((p.country, p.id), {})[p.gram] = p.weight
    want = []
    for (country, a), x in weights.items():
        near = [(-round(sum(w * y.get(g, 0) for g, w in x.items()), 6), b) for (other, b), y in weights.items() if other == country and b.startswith("S2")]
        if a.startswith("S1"):
            want += [(a, b, -s, n + 1) for n, (s, b) in enumerate(sorted(p for p in near if -p[0] > 0.2)[:4])]
    got = similarity.sparse_top_k(reference, candidates, F.col("business_name"), lambda c: word_ngrams(c, 1, 2), TfIdf(min_df=1), 4, 0.2)
    assert want and sorted((p.source1_entity_id, p.candidate_entity_id, p.similarity_score, p["rank"]) for p in got.collect()) == sorted(want)
    assert similarity.sparse_top_k(reference, candidates.limit(0), F.col("business_name"), lambda c: word_ngrams(c, 1, 2), TfIdf(min_df=1), 4, 0.2).count() == 0


def test_block_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    dense_rows = rng.integers(0, 3, (40, 30)) * (rng.random((40, 30)) < 0.3) / 7.0

    def entries(rows):
        at = [np.flatnonzero(x) for x in rows]
        return [f"{i:02d}" for i in range(len(rows))], np.array([len(a) for a in at]), np.concatenate(at), np.concatenate([x[a] for x, a in zip(rows, at, strict=True)])

    block = similarity.Block(*entries(dense_rows[:25]))
    whole = list(block.best(*entries(dense_rows[25:]), 5, 0.01))
    want = []
    for i, row in enumerate((dense_rows[25:] @ dense_rows[:25].T).tolist()):
        near = sorted((-round(s, 6), j) for j, s in enumerate(row))[:5]
        want += [(f"{i:02d}", f"{j:02d}", -s) for s, j in near if -s > 0.01]
    assert [(q, c) for q, c, _ in whole] == [(q, c) for q, c, _ in want] and np.allclose([s for *_, s in whole], [s for *_, s in want], atol=2e-6)
    monkeypatch.setattr(similarity, "_SCORES", 60)
    monkeypatch.setattr(similarity, "_PRODUCTS", 9)
    assert list(block.best(*entries(dense_rows[25:]), 5, 0.01)) == whole


def test_list_metrics(spark):
    ids = spark.createDataFrame([(f"S1-{i}",) for i in range(5)], "source1_entity_id string")
    pair = "source1_entity_id string, candidate_entity_id string"
    truth = spark.createDataFrame([("S1-0", "S2-0"), ("S1-0", "S2-1"), ("S1-1", "S2-2")], pair)
    pairs = spark.createDataFrame([("S1-0", "S2-0"), ("S1-0", "S2-9"), ("S1-2", "S2-3")], pair)
    row = evaluate.list_metrics(evaluate.entity_scores(ids, truth, pairs)).first()
    # Precision and recall: 1/2 and 1/2; nothing predicted; wrongly merged; two singletons left alone.
    assert (row.entities, row.true_links, row.hits, row.singletons, row.singletons_empty, row.singletons_merged) == (5, 3, 1, 3, 2, 1)
    assert (row.sum_precision, row.sum_recall, row.sum_f) == (2.5, 2.5, 2.5) and row.macro_f == 0.5 and row.pair_completeness == pytest.approx(1 / 3)
    row = evaluate.list_metrics(evaluate.entity_scores(ids.limit(0), truth.limit(0), pairs.limit(0))).first()
    assert (row.entities, row.macro_f, row.true_links, row.pair_completeness) == (0, 0, 0, 1)


def test_copies_of_results(spark, tmp_path):
    rows = spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, matched_entity_ids string")
    tsv.write_lists(rows, f"{tmp_path}/out")
    for _ in range(2):  # a second copy takes the place of the first
        tsv.copy(spark, f"{tmp_path}/out", f"{tmp_path}/else/where")
    tsv.copy(spark, f"{tmp_path}/out", f"file:{tmp_path}/out")
    for p in ("out", "else/where"):
        assert tsv.read_lists(spark, f"{tmp_path}/{p}", ("source1_entity_id", "matched_entity_ids")).collect() == rows.collect()


def test_sizes_of_an_index():
    assert sizing.index_mb(1 << 20, 128) == 512 + 450
    assert sizing.shard_count(10, 8, 1 << 30, 4) == 1
    # 2 * ceil(4e6 / n) - 500,000 vectors of 256 bytes in 0.8 GB: 3.5e6 of them at two holders are 0.9 GB, 2.2e6 at three 0.55.
    assert [sizing.shard_count(4_000_000, 128, 8 * 10**8, most) for most in (2, 3, 8)] == [2, 3, 3]


def _sparse(rng, n, m, copied=None):
    """Rows of 25 grams, few of which are common and most rare, weighted by rarity, at length one; copied: rows to start from."""
    chance = 1 / (3 + np.arange(m))
    x = np.zeros((n, m)) if copied is None else copied.copy()
    for row in x:
        row[np.flatnonzero(row)[::4]] = 0
        fresh = rng.choice(m, 25 - np.count_nonzero(row), replace=False, p=chance / chance.sum())
        row[fresh] = np.log(1 + (3 + fresh))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _entries(x, name):
    at = [np.flatnonzero(r) for r in x]
    return [f"{name}{i:05d}" for i in range(len(x))], np.array([len(a) for a in at]), np.concatenate(at), np.concatenate([r[a] for r, a in zip(x, at, strict=True)])


@pytest.mark.parametrize(("k", "floor"), [(5, 0.2), (1, 0.0), (30, 0.5)])
def test_bounds_lose_nothing_and_read_less(k, floor):
    rng = np.random.default_rng(7)
    c = _sparse(rng, 500, 3000)
    c = np.concatenate([c, _sparse(rng, 500, 3000, c), _sparse(rng, 1000, 3000)])
    q = np.concatenate([_sparse(rng, 60, 3000, c[::33][:60]), _sparse(rng, 40, 3000)])
    queries = similarity.Queries(_entries(q, "q"), k, floor)
    read = shared = 0
    for a in range(0, 2000, 250):
        names, *rest = _entries(c[a : a + 250], "")
        block = similarity.Block([f"c{a + i:05d}" for i in range(len(names))], *rest)
        queries.meet(block)
        read, shared = read + block.read, shared + block.shared
    found = {}
    for r in queries.found("x").to_pylist():
        found.setdefault(r["source1_entity_id"], []).append((-r["similarity_score"], r["candidate_entity_id"]))
    score = np.floor(q @ c.T * 1e6 + 0.5) / 1e6
    for i in range(100):
        want = sorted((-s, f"c{j:05d}") for j, s in enumerate(score[i].tolist()) if s > floor)[:k]
        got = sorted(found.get(f"q{i:05d}", []))[:k]
        assert [n for _, n in got] == [n for _, n in want] and np.allclose([s for s, _ in got], [s for s, _ in want], atol=2e-6)
    assert read < {0.0: 0.7, 0.2: 0.7, 0.5: 0.2}[floor] * shared


@pytest.mark.parametrize("scope", ["country", "block"])
def test_a_hot_key_is_searched_in_tiles(spark, monkeypatch, scope):
    """Most records share one key. Tiles are small here; the pairs are those of all records with a common key."""
    monkeypatch.setattr(similarity, "BLOCK", 40)
    monkeypatch.setattr(similarity, "PART", 30)
    monkeypatch.setattr(similarity, "LANE", 2)
    r = random.Random(5)
    rows = [(f"{'S1' if i % 3 == 0 else 'S2'}-{i}", " ".join(r.choice(("ab", "cd", "ef", "gh", "ij", "kl")) for _ in range(4)), "UNK" if i % 5 else f"k{i % 7}", "X") for i in range(300)]
    docs = spark.createDataFrame([*rows, ("S1-900", "ab cd", None, "X")], "entity_id string, business_name string, business_address string, country string")
    reference, candidates = split_roles(docs)
    keys = F.array("business_address", F.substring("business_name", 1, 1), F.col("business_address"))
    got = similarity.keyed_top_k(reference, candidates, F.col("business_name"), keys, lambda c: word_ngrams(c, 1, 1), TfIdf(min_df=1), 5, 0.1, idf_scope=scope).collect()
    texts = {i: t.split() for i, t, _, _ in rows}
    kept = {i: {k, t[0]} for i, t, k, _ in rows}

    def unit(group):
        df = {}
        for i in group:
            for g in set(texts[i]):
                df[g] = df.get(g, 0) + 1
        out = {}
        for i in group:
            v = {g: (1 + np.log(texts[i].count(g))) * (np.log((1 + len(group)) / (1 + df[g])) + 1) for g in set(texts[i])}
            norm = np.sqrt(sum(x * x for x in v.values()))
            out[i] = {g: x / norm for g, x in v.items()}
        return out

    best = {}
    texts["S1-900"], kept["S1-900"] = ["ab", "cd"], {"a"}
    every = unit(list(texts))
    for key in set().union(*kept.values()):
        group = [i for i in texts if key in kept[i]]
        units = every if scope == "country" else unit(group)
        for a in group:
            for b in group:
                if a.startswith("S1") and b.startswith("S2"):
                    score = round(sum(x * units[b].get(g, 0) for g, x in units[a].items()), 6)
                    best[a, b] = max(best.get((a, b), 0), score)
    want = {}
    for (a, b), score in best.items():
        if score > 0.1:
            want.setdefault(a, []).append((-score, b))
    assert {(x.source1_entity_id, x.candidate_entity_id, x["rank"]) for x in got} == {(a, b, n) for a, v in want.items() for n, (_, b) in enumerate(sorted(v)[:5], 1)}


@pytest.mark.parametrize("block", [dense.BLOCK, 30])
def test_cells_with_bounds_give_the_exact_result(spark, monkeypatch, block):
    """Clustered vectors of unequal length, copies, a zero vector, countries of their own; under a fifth of all pairs is scored."""
    monkeypatch.setattr(dense, "BLOCK", block)
    rng = np.random.default_rng(11)
    middle = rng.standard_normal((60, 24))
    x = (middle[rng.integers(0, 60, 3000)] + 0.15 * rng.standard_normal((3000, 24))) * rng.lognormal(0, 1, 3000)[:, None]
    x[100:400] = x[100]
    x[7] = x[40] = 0
    rows = [(f"{'q' if i % 40 == 0 else 'c'}{i:04d}", x[i].tolist(), "a" if i % 11 else "b") for i in range(3000)]
    df = spark.createDataFrame([*rows, ("q9999", x[1].tolist(), "alone")], "id string, vector array<double>, country string")
    q, c = df.where("id like 'q%'"), df.where("id like 'c%'")
    key = ["country", "source1_entity_id", "candidate_entity_id", "rank", "similarity_score"]
    met = spark.sparkContext.accumulator(0)
    got = sorted(dense.cell_top_k(q, c, 10, met=met).select(key).collect())
    assert got == sorted(dense.dense_top_k(q, c, 10).select(key).collect()) and len(got) == 750
    assert met.value < 0.2 * 75 * 2925
    assert dense.cell_top_k(q, c.limit(0), 10).count() == 0 == dense.cell_top_k(q.limit(0), c, 10).count()
