import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinlink.llm import collocations

DOCS = "doc_id long, lang string, text string, n long, rank long, phrase string"


def brute(docs, least=30, share=80, best=2000, max_n=4):
    f, n = Counter(), Counter()
    for lang, text in docs:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, max_n + 1):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i : i + m])] += 1
    found = defaultdict(list)
    frequent = {k: v for k, v in f.items() if v >= least}
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        inside = any(lang == x and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in frequent.items())
        if not inside:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, r, p.decode(), -a, l, rest, n[lang], -s) for lang, rows in found.items() for r, (s, a, p, l, rest) in enumerate(sorted(rows)[:best], 1)}


def texts(seed):
    r = random.Random(seed)
    out = []
    for i in range(60):
        parts = []
        for _ in range(80):
            parts.append(r.choice(["new york city hall", "new york", "Red  Cross", "a b", "b a", "a b a b a", "é ü", "漢 字 x", f"w{r.randrange(300)}", "the", "x\x00y z"]))
            parts.append(r.choice([" ", " ", " ", ". ", "\n", "\t", "\r", ";", ":!"]))
        out.append((r.choice(["en", "fr", None, "und"]), "".join(parts)))
    return out + [("en", None), ("en", ""), ("en", " \t\n"), ("xx", "lone"), *out[:2]]


@pytest.mark.parametrize("sent", [collocations.SENT, 0])
@pytest.mark.parametrize("held", [collocations._HELD, 100])
def test_against_brute_force(spark, sent, held, monkeypatch):
    monkeypatch.setattr(collocations, "_HELD", held)
    monkeypatch.setattr(collocations, "_HELD_AGAIN", held)
    monkeypatch.setattr(collocations, "_KNOWN", held)
    monkeypatch.setattr(collocations, "frequent_grams", lambda d, max_n, least, f=collocations.frequent_grams: f(d, max_n, least, sent))
    docs = texts(1)
    df = spark.createDataFrame([(i, lang, t, 1, 2, "p") for i, (lang, t) in enumerate(docs)], DOCS).repartition(3)
    got = [tuple(r) for r in collocations.collocations(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs) and len({r[0] for r in got}) == 3


def test_best_and_ties(spark):
    docs = [("en", f"p{i} q{i}. " * 40) for i in range(30)]
    df = spark.createDataFrame(docs, "lang string, text string")
    got = [tuple(r) for r in collocations.collocations(df, best=7).orderBy("rank").collect()]
    assert set(got) == brute(docs, best=7) and [r[1] for r in got] == list(range(1, 8))


def test_shared_hashes_only_cost_time(spark, monkeypatch):
    """With two bits all grams share hashes; the second pass tells them apart."""
    import numpy as np

    monkeypatch.setattr(collocations, "_BITS", np.uint64(24))
    docs = texts(2)
    assert {tuple(r) for r in collocations.collocations(spark.createDataFrame(docs, "lang string, text string")).collect()} == brute(docs)


def test_scores_beyond_64_bits(spark):
    a = 6_000_000_000_000_000
    rows = [("en", 1, "x", 8 * a // 6), ("en", 1, "y", a), ("en", 2, "x y", a - 7)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, n long")).collect()
    assert [(r.l, r.r, r.score) for r in got] == [(8 * a // 6, a, 2_000_000 * (a - 7) // (8 * a // 6 + a))]


def test_empty_tables(spark):
    for docs in ([], [(None, None)], [("en", "one two")]):
        assert collocations.collocations(spark.createDataFrame(docs, "lang string, text string")).count() == 0


def test_hashes_travel_as_arrays(spark):
    """A shuffled row has all hashes of a task that share their high bits, and what they add up to is what rows would."""
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(200)) for _ in range(20)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(2)
    rows = collocations.gram_hashes(docs)
    assert rows.columns == ["bucket", "low", "counts"] and all(len(x.low) >= len(x.counts) > -1 for x in rows.collect())
    grams = collocations.Grams(4)
    for t in texts:
        grams.add("en", t.encode())
    every = np.concatenate([found for _, _, found in grams.hashed()]) >> np.uint64(18)
    hashes, n = np.unique(every, return_counts=True)
    for least in (1, 2, 30):
        got = sorted(x.hash for x in collocations.frequent_hashes(rows, 5, least).collect())
        assert got == hashes[n >= least].tolist()


def test_more_hashes_than_are_sent_shuffle_no_rare_gram(spark):
    r = random.Random(5)
    docs = [("en", " ".join(r.choice([f"w{r.randrange(10**6)}", "red cross", "a b c"]) for _ in range(300))) for _ in range(40)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3).cache()
    hashes = collocations.frequent_hashes(collocations.gram_hashes(df), 4, 30)
    hashed = sorted(x.hash for x in hashes.collect())
    bits = collocations.table_bits(hashes, len(hashed))
    high = [h >> (46 - (8 * len(bits) - 1).bit_length()) for h in hashed]
    assert sorted(set(high)) == np.flatnonzero(np.unpackbits(bits)).tolist()
    by = ["lang", "words", "phrase"]
    every = collocations._kept_grams(df, 4, np.full(1 << 14, 255, dtype=np.uint8)).select(by).distinct().count()
    passed = collocations._kept_grams(df, 4, bits).select(by).distinct()
    assert every > 100 * len(hashed) and passed.count() <= len(hashed) + every / 8
    exact = sorted((x.phrase, x.n) for x in collocations.frequent_grams(df, 4, 30, len(hashed)).collect())
    assert exact and sorted((x.phrase, x.n) for x in collocations.frequent_grams(df, 4, 30, 0).collect()) == exact
    df.unpersist()
