from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.functions.grams import word_ngrams
from kinlink.operators import counts, tfidf

TEXTS = [("A", "red bolt red"), ("A", "red nut"), ("A", "red nut"), ("B", "red bolt"), ("B", "old bolt"), ("A", ""), ("A", None), (None, "red red"), ("A", "old nut ring"), ("B", "x")]


def grams(text):
    words = [w for w in (text or "").split() if len(w) > 1]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@pytest.mark.parametrize("chunk", [counts.CHUNK, 3])
def test_vectors_from_arrays(spark, monkeypatch, chunk):
    """The plan of the former way made a row for each gram of a text."""
    monkeypatch.setattr(counts, "CHUNK", chunk)
    made, real = [], tfidf.cut_lineage
    monkeypatch.setattr(tfidf, "cut_lineage", lambda df: made.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    rows = [(c, f"r{i}", t) for i, (c, t) in enumerate(TEXTS)]
    table = spark.createDataFrame(rows, "country string, id string, text string")
    got = tfidf.fit_vectors(table, word_ngrams(F.col("text")), tfidf.TfIdf(min_df=2, max_df=0.9)).collect()
    assert made and not any("Generate" in plan for plan in made)
    want = {}
    for country in ("A", "B"):
        mine = [(name, Counter(grams(t))) for c, name, t in rows if c == country]
        df = Counter(g for _, tf in mine for g in tf)
        idf = {g: log((1 + len(mine)) / (1 + n)) + 1 for g, n in df.items() if 2 <= n <= 0.9 * len(mine)}
        for name, tf in mine:
            v = [(1 + log(n)) * idf[g] for g, n in tf.items() if g in idf]
            if v:
                want[name] = np.sort(np.array(v) / np.linalg.norm(v))
    assert {r.id for r in got} == set(want)
    assert all(np.allclose(np.sort([x.weight for x in r.vector]), want[r.id]) for r in got)


def test_word_grams_copy_no_array(spark):
    made = spark.createDataFrame([("a",)], "t string").select(word_ngrams(F.col("t"), 1, 3))
    assert "slice" not in made._jdf.queryExecution().optimizedPlan().toString()
    text = "one two three four"
    got = spark.createDataFrame([(text,)], "t string").select(word_ngrams(F.col("t"), 1, 3).alias("g")).first().g
    assert got == ["one", "two", "three", "four", "one two", "two three", "three four", "one two three", "two three four"]


@pytest.mark.parametrize("records", [counts.RECORDS, 2])
def test_vocabulary_shuffles_no_row_for_a_gram(spark, monkeypatch, records):
    monkeypatch.setattr(counts, "RECORDS", records)
    rows = [(c, f"r{i % 8}", t) for i, (c, t) in enumerate(TEXTS)]  # two rows of r0, in one country, are one record
    table = spark.createDataFrame(rows, "country string, id string, text string")
    config = tfidf.TfIdf(min_df=2, max_df=0.9)
    found = counts.gram_vocabulary(table, word_ngrams, tfidf.sizes_of(table), config.min_df, config.max_df)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = tfidf.vocabulary(tfidf.term_frequencies(table, word_ngrams(F.col("text"))), tfidf.sizes_of(table), config)
    assert sorted((r.country, r.gram, r.df, r.cf) for r in found.collect()) == sorted((r.country, r.gram, r.df, r.cf) for r in want.collect()) != []


@pytest.mark.parametrize("size", [counts.CHUNK_BYTES, 12])
@pytest.mark.parametrize("sublinear", [True, False])
def test_packed_vectors_are_those_of_arrays_in_fewer_bytes(spark, monkeypatch, size, sublinear):
    monkeypatch.setattr(counts, "CHUNK_BYTES", size)
    rng = np.random.default_rng(3)
    long = [("A", " ".join(f"w{i}" for i in rng.integers(0, 400, 300))) for _ in range(40)]
    rows = [(c, f"r{i}", t) for i, (c, t) in enumerate(TEXTS + [("C", None), ("D", "é ü ß"), *long])]
    table = spark.createDataFrame(rows, "country string, id string, text string").repartition(3).cache()
    config = tfidf.TfIdf(min_df=2, max_df=0.9, sublinear_tf=sublinear)
    made = [tfidf.text_vectors(table, word_ngrams(F.col("text")), config, fit_on=F.col("id") != "r1", pack=pack) for pack in (False, True)]
    arrays, packs = ({(r.country, r.text_id): r for r in df.collect()} for df in made)
    assert arrays and set(arrays) == set(packs)
    codes = {}
    for key, r in packs.items():
        code, weight = counts.unpacked([bytes(r.vector)], np.array([r.terms]), np.array([r.n]), sublinear)
        assert np.array_equal(weight, [x.weight for x in arrays[key].vector])  # to the last bit
        for c, x in zip(code.tolist(), arrays[key].vector, strict=True):
            assert codes.setdefault((key[0], c), x.gram) == x.gram
    assert len({(c, g) for (c, _), g in codes.items()}) == len(codes)
    assert sum(len(r.vector) for r in packs.values()) < sum(32 * len(r.vector) for r in arrays.values()) / 4
    table.unpersist()
