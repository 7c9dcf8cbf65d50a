import numpy as np

from kinlink.llm import quality

from .test_operators import labelled


def test_votes_against_brute_force(spark):
    """Scores of a trained model as the rule states them: a plain loop over the labelled vectors, nearest first."""
    docs, labels = labelled(spark, 120)
    model = quality.train(docs, labels)
    reader = quality.Reader()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    got = {r.doc_id: r["quality__"] for r in quality.scored(docs, model).collect()}
    for doc, text in list(texts.items())[::7] + [(1000, None), (1001, "")]:
        z = model.latent([reader.counts(text or "")])[0].astype(np.float64)
        near = sorted(((float(np.float32(z @ v)), -i) for i, v in enumerate(model.vectors.astype(np.float64))), reverse=True)[: quality.NEIGHBOURS]
        total = sum(max(c, 0) ** quality.SHARPNESS * model.weights[-i] for c, i in near)
        want = sum(max(c, 0) ** quality.SHARPNESS * model.weights[-i] * model.votes[-i] for c, i in near) / total if total > 1e-9 else model.prior
        assert abs(got[doc] - want) < 1e-3, doc


def test_empty_and_repeated_documents(spark):
    docs, labels = labelled(spark, 60)
    model = quality.train(docs, labels)
    assert quality.scored(docs.limit(0), model).count() == 0
    none = quality.train(docs.limit(0), labels)
    assert none.vectors is None and quality.scored(docs.limit(0), none).count() == 0
    twice = quality.scored(docs.union(docs), model).groupBy("doc_id").agg({"quality__": "min", "*": "count"}).collect()
    assert twice and all(r["count(1)"] == 2 for r in twice)
    one_class = quality.train(docs, labels.where("quality = 1"))
    assert {round(r["quality__"], 9) for r in quality.scored(docs, one_class).collect()} == {1.0}
