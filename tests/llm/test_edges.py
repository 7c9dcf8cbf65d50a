"""Names that operators use inside, empty tables, ties and odd keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinlink.llm import chat, components, decontamination, licenses, passages, quality, simhash, token_counts, toxicity

from .test_operators import labelled, prose

TAKEN = ("spans__", "n_words__", "items__", "toxicity__", "quality__", "text_key", "Text_More", "least", "copies", "spans", "part", "parts", "n", "node", "row", "empty", "n_cut")


def clashing(docs):
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in TAKEN if c not in docs.columns})


def kept_whole(docs, out):
    """Whether the rows of out are rows of docs in all columns but the text."""
    columns = [c for c in docs.columns if c != "text"]
    assert out.columns == docs.columns
    have = {tuple(r) for r in docs.select(*columns).collect()}
    return all(tuple(r) in have for r in out.select(*columns).collect())


def test_columns_of_any_name_stay(spark):
    docs, labels = labelled(spark, 60)
    docs = clashing(docs.drop("n_words", "least"))
    bench = spark.createDataFrame([(1, prose(20, 3, 300))], "item_id long, text string")
    for out in (decontamination.decontaminate(docs, bench), passages.cut_repeats(docs), toxicity.without_toxic(docs, labels), simhash.deduplicate(docs)):
        assert kept_whole(docs, out) and out.count() > 0
    found = decontamination.contamination(docs, bench, shard_words=5)
    assert found.columns == [*docs.columns, "n_words___", "spans___", "items___"] and found.where("spans__ = concat('spans__', doc_id)").count() == found.count()
    assert decontamination.cut_spans(docs, bench).columns == [*docs.columns, "n_cut_"]
    assert quality.scored(docs, quality.train(docs, labels)).columns == [*docs.columns, "quality___"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, tmp_path, name):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_stages_follow_their_rules(spark, tmp_path):
    """Toxicity, near-duplicates of five words and four fifths, repeated passages and decontamination, one after another."""
    from .test_minhash import components as alike
    from .test_operators import brute_contamination, brute_repeats
    from .test_pipeline import tables

    texts, item = tables(spark, str(tmp_path))
    docs, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(at["toxicity"]) == set(texts) - {i for i in range(200) if i % 5 == 1}
    rows = sorted(at["toxicity"].items())
    label = alike(rows)
    assert set(at["near_duplicates"]) == {i for k, (i, _) in enumerate(rows) if label[k] == k} and not {301, 302, 331} & set(at["near_duplicates"])
    for i, covered in brute_repeats(sorted(at["near_duplicates"].items())):
        w, covered = (at["near_duplicates"][i] or "").split(), set(covered)
        assert (at["repeated_passages"].get(i) or "").split() == [x for k, x in enumerate(w) if k not in covered]
    clean = {i for i, t in at["repeated_passages"].items() for n, hit, _ in [brute_contamination(t, [(7, item)])] if not (hit and 20 * hit >= n)}
    assert set(at["decontamination"]) == clean


def test_repeated_rows_and_null_keys_of_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, "first"), (None, 1, "user", "x"), (None, 2, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.canonical(df, "conv_id").collect()}
    assert got == {1: [("user", "first"), ("user", "a"), ("user", "a"), ("assistant", "b")], None: [("user", "x"), ("user", "")]}


def test_rows_of_several_layouts(spark):
    schema = "id long, messages array<struct<role:string,content:string>>, prompt string, completion string, instruction string, input string, output string"
    rows = [(1, [("user", "q")], None, None, None, None, None), (2, None, "p", "c", None, None, None), (3, None, None, None, "i", "", "o")]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.canonical(spark.createDataFrame(rows, schema), "id").collect()}
    assert got == {1: [("user", "q")], 2: [("user", "p"), ("assistant", "c")], 3: [("user", "i"), ("assistant", "o")]}


def test_lengths_at_shares(spark):
    sizes = [3, 3, 5, 9, 5000, 9000]
    histogram = spark.createDataFrame([(n, sizes.count(n)) for n in set(sizes)], "length long, n_docs long")
    shares = (0.0, 0.3, 0.5, 0.9, 1.0)
    got = {r.share: r.length for r in token_counts.lengths_at(histogram, shares).collect()}
    assert got == {s: min(n for n in sizes if sum(x <= n for x in sizes) >= s * len(sizes)) for s in shares}
    assert {r.length for r in token_counts.lengths_at(histogram.limit(0), shares).collect()} == {None}


@pytest.mark.parametrize(
    ("line", "run", "labels"),
    [
        ("MIT and this is prose about iscsi", "mit and this", "mit"), ("mitigation of risks", "mitigation", ""), ("gplayer", "gplayer", ""), ("GPLv3", "gplv3", "gpl"),
        ("Apache-2.0. See the file", "apache-2.0", "apache"), ("(MIT OR BSD-3-Clause) */", "( mit or bsd-3-clause )", "bsd,mit"), ("MIT) or gpl", "mit", "mit"), ("MIT, gpl", "mit", "mit"), ("", None, ""),
    ],
)
def test_where_an_expression_ends(line, run, labels):
    r = licenses.scan(f"x SPDX-License-Identifier: {line}\nbsd-3-clause".encode())
    assert r[6] == ([run] if run else []) and r[5] == labels


def test_wide_segments_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE_FROM", 0)
    rng = np.random.default_rng(3)
    prints = {int(x) for x in rng.integers(-(2**62), 2**62, 60)}
    for x in list(prints):
        for n in (3, 4, 5):
            prints.add(int(np.bitwise_xor(np.int64(x), np.int64(sum(1 << int(b) for b in rng.choice(62, n, replace=False))))))
    forest = components.Forest()
    for a in prints:
        for b in prints:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                forest.join(a, b)
    got = {r.node: r.root for r in components.connected_components(simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"))).collect()}
    assert got == {x: forest.root(x) for x in list(forest.up)}


def test_ties_of_neighbours():
    cosine = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2]], dtype=np.float32)
    assert quality.nearest(cosine, 3).tolist() == [[0, 1, 2], [0, 1, 2]]


def test_a_document_with_several_texts_trains_on_the_least(spark):
    docs, labels = labelled(spark, 60)
    more = docs.union(docs.where("doc_id < 30").withColumn("text", F.concat(F.lit("zz "), "text"))).repartition(5)
    twice = more.union(docs).repartition(3)
    for module, name in ((toxicity, "toxicity__"), (quality, "quality__")):
        a, b = ({(r.doc_id, r.text): round(r[name], 9) for r in module.scored(docs, module.train(d, labels)).collect()} for d in (more, more.repartition(2)))
        assert a == b
        scores = {}
        for r in module.scored(twice, module.train(twice, labels)).collect():
            assert scores.setdefault((r.doc_id, r.text), r[name]) == r[name]
