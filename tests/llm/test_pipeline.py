import random

import corpus_pipeline
from kinlink.llm import toxicity
from kinlink.llm.common import words

from .test_minhash import components as alike
from .test_operators import brute_contamination, brute_repeats, prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(200):
        toxic = i % 5 == 1
        docs.append((i, prose(80, i) + (f" idiot scum moron vilex{i % 3}" if toxic else "")))
        labels.append((i, 1, int(toxic)))
    base = prose(400, 900).split()
    docs += [(300, " ".join(base)), (301, " ".join(base)), (302, " ".join(base[:200] + ["new"] + base[201:]))]
    passage = prose(60, 901)
    docs += [(310 + k, prose(100, 910 + k) + " " + passage + " " + prose(40, 920 + k)) for k in range(3)]
    item = prose(30, 902)
    docs += [(320, prose(50, 930) + " " + item), (321, prose(900, 931) + " " + item), (330, None), (331, ""), (332, prose(15_000, 940))]
    r.shuffle(docs)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(docs), item


def test_every_stage(spark, tmp_path):
    texts, item = tables(spark, str(tmp_path))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
            at[name] = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.n_chars == len(r.text or "") for r in docs.collect() if r.text is not None)
    toxic = {i for i in range(200) if i % 5 == 1}
    assert set(at["toxicity"]) == set(texts) - toxic
    rows = sorted(at["toxicity"].items())
    label = alike(rows)  # five words, a similarity of four fifths
    gone = {i for k, (i, _) in enumerate(rows) if label[k] != k}
    assert set(at["near_duplicates"]) == set(at["toxicity"]) - gone and {301, 302, 331} <= gone
    before = at["near_duplicates"]
    for i, covered in brute_repeats(sorted(before.items())):
        w = words((before[i] or "").encode())
        left = [x for k, x in enumerate(w) if k not in set(covered)]
        assert words((at["repeated_passages"].get(i) or "").encode()) == left
    before = at["repeated_passages"]
    clean = {i for i, t in before.items() for n, hit, _ in [brute_contamination(t, [(7, item)])] if not (hit and 20 * hit >= n)}
    assert set(at["decontamination"]) == clean and 320 not in clean and 321 in clean
    kept = {r.doc_id for r in docs.collect()}
    assert kept == clean and sum(r.length for r in docs.collect()) == sum({r.doc_id: r.doc_tokens for r in docs.collect()}.values())


def test_run_gives_the_packed_rows(spark, tmp_path):
    tables(spark, str(tmp_path))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(len(r.ids) == r.length for r in rows)


def test_scores_ignore_other_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.train(docs, labels)
    a = {r.doc_id: r["toxicity__"] for r in toxicity.scored(docs, model).collect()}
    b = {r.doc_id: r["toxicity__"] for r in toxicity.scored(docs.select("doc_id", "text"), model).collect()}
    assert a == b
