import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinlink.llm import chat, components, decontamination, licenses, neighbours, packing, passages, quality, simhash, token_counts, toxicity, wordbpe
from kinlink.llm.common import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, least string, n_words string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(n, seed=0, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def table_of(spark, texts):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in texts], DOCS)


ODD = [(0, None), (1, ""), (2, " \n\t"), (3, "Straße É ünï 漢字 ٣"), (3, "Straße É ünï 漢字 ٣"), (None, "no id"), (4, prose(30_000, 9)), (5, "a" * 70_000)]


def test_words():
    for _, t in ODD:
        assert [w.decode() for w in words((t or "").encode())] == WORD.findall(low(t))


# op1
def test_licenses_against_brute_force(spark):
    texts = ODD + [(9, "CC BY cc-by/4.0 CC BY."), (10, "MIT License, the Apache License; mit licenses. GNU General Public License " * 3), (11, prose(50) + " cc by")]
    got = licenses.scan_licenses(table_of(spark, texts)).collect()
    assert len(got) == len(texts)
    for (i, t), r in zip(texts, got, strict=True):
        w = WORD.findall(low(t))
        places = sorted((k, label) for phrase, label in licenses.BASE_PHRASES.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p)
        assert (r.doc_id, r.n_words, r.n_base) == (i, len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("expression", "level"),
    [("mit", 1), ("mit or gpl-3.0", 1), ("mit and gpl-3.0", 3), ("mit and (gpl-2.0 or apache-2.0)", 1), ("gpl-2.0 with classpath-exception-2.0", 2), ("mit or bsd-3-clause and agpl-3.0", 1), ("strange", None), ("mit or strange", 1)],
)
def test_expressions(expression, level):
    assert licenses.evaluate(licenses.postfix(expression)) == level


@pytest.mark.parametrize("expression", ["", "mit or", "(mit", "mit)", "mit apache-2.0", "and mit"])
def test_malformed_expressions(expression):
    assert licenses.postfix(expression) is None


def test_tags():
    r = licenses.scan(b"// SPDX-License-Identifier: MIT OR Apache-2.0\ncode")
    assert r[5] == "apache,mit" and r[7] == 1 and r[8] == 1.0


def test_long_expressions():
    run = " and ".join(["bsd-3-clause"] * 45 + ["agpl-3.0-only"])
    r = licenses.scan(f"SPDX-License-Identifier: {run}\nMIT".encode())
    assert len(run) > 512 and r[6] == [run] and r[5] == "agpl,bsd" and r[7] == 3 and r[8] == 1.0


# op2
def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8))
    x[50:120] = x[7]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [float("nan")] * 8), (1080, [1.0, None] + [0.0] * 6), (1100, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, entry string")
    got = {}
    for r in neighbours.search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(300), -np.round(score, 12))) if i != q][:20]
        assert [v for _, v, _ in sorted(found)] == best
        assert np.allclose([s for _, _, s in sorted(found)], score[best], atol=1e-12)
    assert neighbours.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("sigma", [0.0, 0.5, 1.0])
def test_recall_on_unequal_norms(spark, monkeypatch, sigma):
    monkeypatch.setattr(neighbours, "LEAST_ENTRIES", 100)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 32))
    x *= np.exp(sigma * rng.standard_normal((4000, 1))) / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in neighbours.search(df, 80).collect()}
    best = {(q, int(i)) for q in range(0, 4000, 80) for i in [i for i in np.argsort(-(x @ x[q])) if i != q][:20]}
    assert len(found & best) >= 0.9 * len(best)


def test_traversal_is_in_order():
    index = neighbours.MultiIndex(np.array([[0.0], [3.0], [4.0]]), np.array([[0.0], [1.0], [9.0]]))
    index.counts[:] = 1
    order = index.visit(np.array([0.2, 0.3]), 9)
    a, b = (index.first[:, 0] - 0.2) ** 2, (index.second[:, 0] - 0.3) ** 2
    sums = [a[c // 3] + b[c % 3] for c in order]
    assert sorted(order) == list(range(9)) and sums == sorted(sums)


# op3
def brute_contamination(text, items, window=13):
    w, hit, found = WORD.findall(low(text)), set(), set()
    for i, t in items:
        x = WORD.findall(low(t))
        size = min(window, len(x))
        runs = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if x else set()
        for k in range(len(w) - size + 1):
            if runs and tuple(w[k : k + size]) in runs:
                hit.update(range(k, k + size))
                found.add(i)
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("shard", [decontamination.SHARD_WORDS, 20])
def test_contamination_against_brute_force(spark, shard):
    items = [(1, prose(20, 1)), (2, prose(13, 2)), (3, "w1 w2 w3 w4"), (4, None), (5, ""), (6, prose(20, 1)), (7, prose(40, 3, 3)), (10, "w9")]
    texts = ODD + [(20, prose(100, 5) + " " + prose(20, 1)), (21, prose(20, 1)[3:]), (22, prose(13, 2).upper() + ", " + prose(20, 1)), (23, "w1 w2, w3 W4 w1 w2 w3 w4"), (24, prose(400, 4, 3)), (25, prose(300, 8) + " w9")]
    bench = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, spans__x string")
    got = decontamination.contamination(table_of(spark, texts), bench, shard_words=shard).collect()
    for (i, t), r in zip(sorted(texts, key=str), sorted(got, key=lambda r: str((r.doc_id, r.text))), strict=True):
        n, hits, found = brute_contamination(t, items)
        assert (r.doc_id, r["n_words__"], sum(s.b - s.a for s in r["spans__"]), r["items__"]) == (i, n, hits, found)


def test_contamination_report(spark):
    bench = spark.createDataFrame([(1, prose(20, 1)), (12, prose(15, 2))], "item_id long, text string")
    docs = table_of(spark, [(1, prose(400, 7) + " " + prose(20, 1)), (2, prose(200, 7) + " " + prose(15, 2) + " " + prose(20, 1)), (3, None)])
    got = {r.doc_id: r for r in decontamination.report(docs, bench).collect()}
    assert not got[1].contaminated and got[1].n_hit == 20 and got[2].contaminated and got[2].n_items == 2
    assert got[2].items_sha256 == hashlib.sha256(b"1,12").hexdigest() and got[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()} == {1, 3}
    cut = {r.doc_id: r for r in decontamination.cut_spans(docs, bench).collect()}
    assert cut[1].text.split() == prose(400, 7).split() and cut[1].n_cut == 20 and cut[3].text is None
    assert decontamination.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.report(docs.limit(0), bench).count() == 0


# op4
def test_token_counts(spark):
    encoder = wordbpe.WordBpe()
    lengths = [len(encoder.whole.encode(t or "", add_special_tokens=False).ids) for _, t in ODD]
    rows = {r.context_limit: r for r in token_counts.limit_table(token_counts.length_histogram(table_of(spark, ODD))).collect()}
    assert set(rows) == set(lengths) | set(token_counts.LIMITS)
    for limit, r in rows.items():
        assert r.n_docs == lengths.count(limit) and r.docs_over == sum(x > limit for x in lengths)
        assert r.truncated_tokens == sum(min(x, limit) for x in lengths) and r.total_tokens == sum(lengths)
        assert r.quantile == sum(x <= limit for x in lengths) / len(lengths)
    empty = token_counts.limit_table(token_counts.length_histogram(table_of(spark, ODD).limit(0))).collect()
    assert len(empty) == len(token_counts.LIMITS) and all(r.quantile is None and r.truncated_tokens == 0 for r in empty)


def test_encoder_equals_tokenizer():
    encoder = wordbpe.WordBpe(memo_chunks=50)
    r = random.Random(3)
    letters = "aAbB zZéÉßñ 09'.,!?_-#%|\n\t\xa0\x85\x1cǅΣς漢😀½²ª" + "st're"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(800)] + ["it's WE'LL don't", "<|endoftext|> x", "é é", ""]
    for t in texts:
        ids = encoder.whole.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t).tolist() == ids and encoder.count(t) == len(ids), t


# op5
def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    runs = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, monkeypatch):
    base = prose(300, 4).split()
    near = [(100 + k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(0, 300, 5)]
    texts = ODD + near + [(900, " ".join(base)), (901, " ".join(base).upper())]
    for rows in (simhash.BUCKET_ROWS, 8):
        monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)
        got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.groups(table_of(spark, texts)).collect()), key=str)
        f = [brute_fingerprint(t) for _, t in texts]
        label = list(range(len(texts)))
        changed = True
        while changed:
            changed = False
            for a in range(len(f)):
                for b in range(len(f)):
                    if (f[a] ^ f[b]).bit_count() <= 4 and label[b] < label[a]:
                        label[a], changed = label[b], True
        least = {}
        for (i, _), k in zip(texts, label, strict=True):
            least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
        assert got == sorted(((i, x, least[k]) for (i, _), x, k in zip(texts, f, label, strict=True)), key=str)
    kept = simhash.deduplicate(table_of(spark, texts))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "lang", "least", "n_words"] and sorted(i for i in ids if i is not None) == sorted({x for x in least.values() if x is not None})
    assert simhash.groups(table_of(spark, texts).limit(0)).count() == 0


def test_connected_buckets_lose_no_link():
    rng = np.random.default_rng(1)
    held = np.unique(rng.integers(0, 2**10, 300)).astype(np.int64)
    probes = np.unique(rng.integers(0, 2**10, 300)).astype(np.int64)

    def parts(edges):
        forest = components.Forest()
        for a, b in edges:
            forest.join(int(a), int(b))
        return {x: forest.root(x) for x in {*held.tolist(), *probes.tolist()}}

    every = [(a, b) for a in held for b in probes if a != b and int(a ^ b).bit_count() <= 4]
    assert parts(simhash._connect(held, probes, components.Forest()).T) == parts(every)


def test_components(spark):
    r = random.Random(0)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)] + [(1000, 1000 + i) for i in range(80)]
    forest = components.Forest()
    for a, b in edges:
        forest.join(a, b)
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {x: forest.root(x) for a, b in edges if a != b for x in (a, b)}


# op6 and op9
def labelled(spark, n=400):
    docs, rows = [], []
    for i in range(n):
        bad, toxic = i % 3 == 0, i % 5 == 1
        t = prose(60, i, 300)
        t = " ".join(w.upper() + "!!" for w in t.split()) if bad else t
        docs.append((i, t + (" you idiot scum " + f"vilex{i % 4}" if toxic else "")))
        rows.append((i, int(not bad), int(toxic)))
    return table_of(spark, docs + [(1000, None), (1001, ""), (1002, prose(20_000, 1, 300))]), spark.createDataFrame([*rows, (0, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r["toxicity__"] for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == (i % 5 == 1) for i in held) and got[1000] < 0.5 and got[1001] < 0.5
    assert {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()} == {i for i, s in got.items() if s < 0.5}
    plain = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r["toxicity__"] for r in toxicity.scored(docs, plain).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_label_model_recovers_rates():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.2
    rate1, rate0 = np.array([0.8, 0.7, 0.6, 0.75, 0.65]), np.array([0.05, 0.1, 0.02, 0.08, 0.04])
    v = (rng.random((len(y), 5)) < np.where(y[:, None], rate1, rate0)).astype(float)
    v = np.column_stack([v, v[:, 0]])  # the last voter repeats the first
    full = np.column_stack([v, np.ones(len(y))])
    model = toxicity.LabelModel(full.T @ full, 0.2)
    assert np.allclose(model.toxic[1:5], rate1[1:], atol=0.12) and np.allclose(model.clean[1:5], rate0[1:], atol=0.04)
    assert model.correlation[0, 5] > 0.3 and model.weight[0] < 0.8
    assert ((model.logit(v.astype(bool)) > 0) == y).mean() > 0.95


def test_quality(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r["quality__"] for r in quality.scored(docs, quality.train(docs, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in held]) > 0.97 and got[1000] == got[1001]
    none = quality.train(docs, labels.limit(0))
    assert {r["quality__"] for r in quality.scored(docs, none).collect()} == {0.0}


# op7
def turns_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_chat_round_trip(spark):
    odd = ["", "\\", "\\\\ </turn>\n", "### user: a", ": :: ", "a\\### Assistant: </turn> ok\n", None, "x" * 50_000, "é漢😀 </turn>\n### "]
    rows = [(i, j, role, t, "z") for i, t in enumerate(odd) for j, role in enumerate(["user", "assistant", "a: #b", None])]
    df = turns_of(spark, rows, "conv_id long, turn long, role string, text string, extra string")
    out = chat.format_chats(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert back == {i: [(role or "user", t or "") for role in ["user", "assistant", "a: #b", None]] for i, t in enumerate(odd)}
    for r in chat.digests(out).collect():
        t = odd[r.conv_id] or ""
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (4, len(t), hashlib.sha256(t.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in back[r.conv_id]).encode()).hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("schema", "row", "turns"),
    [
        ("id long, messages array<struct<role:string,content:string>>", (1, [("user", "q"), ("assistant", "a")]), [("user", "q"), ("assistant", "a")]),
        ("id long, conversations array<struct<from:string,value:string>>", (1, [("human", "q"), ("gpt", "a")]), [("user", "q"), ("assistant", "a")]),
        ("id long, prompt string, completion string", (1, "q", "a"), [("user", "q"), ("assistant", "a")]),
        ("id long, instruction string, input string, output string", (1, "do", "", "a"), [("user", "do"), ("assistant", "a")]),
        ("id long, instruction string, input string, output string, more int", (1, "do", "x", "a", 3), [("user", "do\n\nx"), ("assistant", "a")]),
        ("id long, system string, prompt string, response string", (1, "s", "q", None), [("system", "s"), ("user", "q"), ("assistant", "")]),
        ("id long, messages array<struct<role:string,content:string>>", (1, None), []),
    ],
)
def test_layouts(spark, schema, row, turns):
    got = chat.canonical(spark.createDataFrame([row], schema), "id").first().turns
    assert [(t.role, t.text) for t in got] == turns


def test_unknown_layout(spark):
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical(spark.createDataFrame([(1, "x")], "id long, story string"), "id")


# op8
def brute_repeats(texts, length=50):
    first, seen, out = set(), {}, []
    for i, t in texts:
        w = WORD.findall(low(t))
        covered = set()
        if len(w) >= length and t in seen and seen[t] != i:
            covered = set(range(len(w)))
        elif (t, i) not in out:
            seen.setdefault(t, i)
            for s in range(len(w) - length + 1):
                k = tuple(w[s : s + length])
                if k in first:
                    covered.update(range(s, s + length))
                first.add(k)
        out.append((i, sorted(covered)))
    return out


def test_passages_against_brute_force(spark):
    shared, edge = prose(70, 50), prose(50, 51)
    texts = [
        (1, prose(200, 1) + " " + shared), (2, shared + " " + prose(90, 2)), (3, prose(20, 3) + " " + edge + " " + prose(20, 4)),
        (4, edge), (5, prose(300, 5)), (6, prose(300, 5)), (7, "der " * 130), (8, prose(49, 51)), (9, prose(30, 6) + " " + shared.upper().replace(" ", ", ") + "!"),
        (10, " ".join(shared.split()[5:65]) + " " + edge), (11, None), (12, ""), (13, prose(20_000, 7) + " " + edge),
    ]
    got = {r.doc_id: r for r in passages.report(table_of(spark, texts)).collect()}
    for i, covered in brute_repeats(texts):
        spans = [k for s in got[i].spans for k in range(s.a, s.b)]
        assert spans == covered, i
    assert got[2].originals == [1] and got[1].holds_original and got[6].originals == [5] and got[5].holds_original
    cut = passages.cut_repeats(table_of(spark, texts))
    left = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == ["doc_id", "text", "lang", "least", "n_words"]
    assert set(left) == {1, 2, 3, 5, 7, 8, 9, 10, 11, 12, 13} - {10} and left[11] is None and left[1] == texts[0][1]
    assert left[2].split() == prose(90, 2).split() and left[9] == prose(30, 6) + " !" and left[13].split() == prose(20_000, 7).split()
    assert passages.report(table_of(spark, texts).limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    got = passages.report(table_of(spark, [(1, prose(100, 1)), (1, prose(100, 1)), (None, prose(100, 1)), (None, prose(80, 2))])).collect()
    assert sorted((str(r.doc_id), r.n_repeated) for r in got) == [("1", 0), ("1", 0), ("None", 0), ("None", 100)]


# op10
def test_packing(spark):
    texts = ODD + [(100 + i, prose(20 * i + 5, i)) for i in range(120)]
    encoder = wordbpe.WordBpe()
    docs = table_of(spark, texts).repartition(3)
    rows = packing.pack(docs, with_ids=True).collect()
    ids = sorted([*encoder.whole.encode(t or "", add_special_tokens=False).ids, 2] for _, t in texts)
    pieces = {}
    for r in rows:
        assert len(r.ids) == r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    rebuilt = []
    for own in pieces.values():
        own.sort(key=lambda r: r.start)
        copies = [[] for r in own if r.start == 0]
        for r in own:
            next(c for c in copies if len(c) == r.start).extend(r.ids)
        rebuilt += copies
    assert sorted(rebuilt) == ids
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == 4096 or at < 4096 and at & (at - 1) == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_balance_evens_costs():
    r = random.Random(1)
    pieces = [(i, 0, np.zeros(n, dtype="<u4"), n) for i, n in enumerate([2048] * 6 + [r.randrange(1, 400) for _ in range(200)])]
    full, rest = packing.balance(pieces, 4096)
    costs = [sum(packing.cost(len(p[2])) for p in s) for s in full]
    assert all(sum(len(p[2]) for p in s) == 4096 for s in full) and sum(len(p[2]) for p in rest) < 4096
    assert max(costs) < 1.2 * min(costs)


def test_moments_against_brute_force(spark):
    docs, labels = labelled(spark, 60)
    terms = [b"vil*", b"vilex1", b"idiot", b"w12*", b"w22", b"mor*", b"moron"]
    texts = [(r.text or "").encode() for r in docs.collect()]
    reader = toxicity.Reader(terms)
    votes = []
    for t in texts:
        found = {w for w in words(t)}
        row = [False] * toxicity.VOTERS
        for i, term in enumerate(terms):
            stem = term.decode().rstrip("*")[: toxicity.STEM]
            number = list(dict.fromkeys(x.decode().rstrip("*")[: toxicity.STEM] for x in terms)).index(stem)
            row[number] |= any(w.startswith(term[:-1]) and len(w) > len(term) - 1 if term.endswith(b"*") else w == term for w in found)
        for k, lexicon in enumerate(toxicity.LEXICONS):
            row[toxicity.TERM_VOTERS + k] = bool({w.decode() for w in found} & set(lexicon.split()))
        for k, pattern in enumerate(toxicity.PATTERNS):
            row[toxicity.TERM_VOTERS + len(toxicity.LEXICONS) + k] = bool(pattern.search(t))
        votes.append([*row, True])
    v = np.array(votes, dtype=np.int64)
    assert (toxicity.moments(docs.repartition(3), terms) == v.T @ v).all() and v[:, :4].any() and len(set(reader.voter)) == 5


def test_families_and_patterns_of_each_language():
    many = [f"{a}{b}x".encode() for a in "abcdef" for b in "ghijk"]
    assert toxicity.families([b"abc*", b"abd", b"abcd", b"abc"]) == [0, 1, 0, 0] and max(toxicity.families(many)) == toxicity.TERM_VOTERS - 1
    for text in ("You are an idiot", "du bist ein Trottel", "tu es un crétin", "espèce d'abruti", "eres un imbécil", "m**on", "what!!!"):
        assert sum(bool(p.search(text.encode())) for p in toxicity.PATTERNS) == 1, text


def test_the_weight_of_a_known_label_is_chosen_by_the_data():
    rng = np.random.default_rng(0)
    truth = rng.random(600) < 0.4
    x = np.column_stack([truth + 0.1 * rng.standard_normal(600), np.ones(600)])
    half, weight = np.arange(600) % 2, np.ones(600)
    misled = np.where(truth, -5.0, 5.0)  # a label model that has it wrong
    assert toxicity.chosen_accuracy(x, misled, truth.astype(float), weight, half) == toxicity.LABEL_ACCURACIES[-1]
    told = np.where(rng.random(600) < 0.5, ~truth, truth).astype(float)  # labels that say nothing about x
    assert toxicity.chosen_accuracy(x, np.zeros(600), told, weight, half) == toxicity.LABEL_ACCURACIES[0]
    assert toxicity.chosen_accuracy(x, misled, np.zeros(600), weight, half) == toxicity.LABEL_ACCURACIES[1]
