"""Toxicity by weak supervision.

Voters are lexicons and patterns: fixed lists of insults and of threats in four languages, ways to address someone in each, word
shapes, and families of words that the labelled rows tie to toxic documents, a family being the words of one beginning. One pass over all documents gathers how often each voter and each pair of voters
fires. A generative label model explains the covariances of voters by one hidden label (a median over triplets gives every voter's rate
on either class); what the label leaves unexplained are correlations, which lessen the weight of voters that repeat each other.
The model's posterior labels, with the known labels as one more voter, train a logistic regression on the counts of the mined
words, and that scores every whole text. How much a known label weighs is chosen on the sample: fits on either half of it are
judged by the known labels of the other half.

Defined cases: a null or empty text fires no voter and gets the score of a text without any known word; without labelled rows
of both classes the score is the share of toxic labels (0 without any); terms that are equally telling go by their bytes, and a
score of exactly the threshold is toxic; repeated rows get equal scores; a labelled doc_id with several texts trains on the
least of them; a null doc_id has no label; an empty table gives no rows; further columns are kept by scored(), whatever their
names, and not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import batches_of, small_batches, table, unused, words
from .sampling import fold, labelled_sample

FOLDS, HELD_OUT = 5, 0
#: At most so many labelled rows of either class train the classifier.
SAMPLE_PER_CLASS = 4096
#: Words and word beginnings mined from the sample.
TERMS = 512
#: Voters of families of mined terms: the most telling families, and one for all others.
TERM_VOTERS = 24
#: Letters that the terms of a family begin with.
STEM = 3
#: Lengths of the word beginnings that can be terms, in characters.
PREFIXES = (3, 4, 5, 6)
#: Accuracies of a known label as a voter, of which the sample chooses one.
LABEL_ACCURACIES = (0.9, 0.98, 0.999, 0.999999)

# General lexicons of English, German, French and Spanish, in lower case: insults, then threats.
LEXICONS = (
    "idiot idiots idiotic moron morons stupid dumb fool loser losers scum trash garbage clown pathetic worthless disgusting filthy vermin coward liar imbecile lunatic pig rat",
    "idioten dumm dummkopf trottel depp versager abschaum müll widerlich ekelhaft dreckig ungeziefer feigling lügner schwein ratte wertlos erbärmlich",
    "idiote idiots stupide imbécile crétin abruti débile ordure déchet dégoûtant vermine lâche menteur porc clown minable pathétique",
    "idiota idiotas estúpido estúpida imbécil tonto basura escoria asqueroso alimaña cobarde mentiroso cerdo rata payaso patético inútil",
    "kill die hurt destroy beat hang shoot burn punish suffer",
    "töten sterben umbringen zerstören schlagen hängen erschießen verbrennen bestrafen leiden",
    "tuer mourir crever détruire frapper pendre brûler punir souffrir",
    "matar morir muere destruir golpear colgar quemar castigar sufrir",
)
# Patterns over the raw text: someone is called something, in each language; letters replaced by signs; shouting.
PATTERNS = (
    re.compile(rb"(?i)\byou(?:'re| are)? (?:an? )?(?:idiot|moron|fool|loser|clown|liar)"),
    re.compile("(?i)\\bdu (?:bist )?(?:ein(?:e)? )?(?:idiot|trottel|depp|versager|l\u00fcgner|schwein)".encode()),
    re.compile("(?i)\\b(?:tu es|t'es|esp\u00e8ce d['e]) ?(?:une? )?(?:idiot|cr\u00e9tin|abruti|menteur|porc)".encode()),
    re.compile("(?i)\\b(?:eres|t\u00fa) (?:una? )?(?:idiota|imb\u00e9cil|tonto|mentiroso|cerdo)".encode()),
    re.compile(rb"(?i)\b[a-z]+[*@#$]{2,}[a-z]+\b"),
    re.compile(rb"[!?]{3,}"),
)
VOTERS = TERM_VOTERS + len(LEXICONS) + len(PATTERNS)

#: Counts are taken per so many words in longer texts, so that length alone gathers no weight.
PER_WORDS = 200

_MEMO = 200_000


def beginnings(word: bytes) -> list[bytes]:
    """A word and its beginnings, marked by a star."""
    letters = word.decode("utf-8", "ignore")
    return [word, *(letters[:k].encode() + b"*" for k in PREFIXES if len(letters) > k)]


def mine(sample: DataFrame, terms: int = TERMS) -> list[bytes]:
    """The terms that most raise the odds of the label, from (label, text)."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    schema = pa.schema([("term", pa.binary()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def flush(counts) -> Iterator[pa.RecordBatch]:
        names = set(counts[0]) | set(counts[1])
        yield from batches_of(((t, counts[1][t], counts[0][t]) for t in names), schema)
        counts[0].clear()
        counts[1].clear()

    def run(batches):
        counts = [Counter(), Counter()]
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                counts[label].update({t for w in set(words(text or b"")) for t in beginnings(w)})
            if len(counts[0]) + len(counts[1]) > _MEMO:
                yield from flush(counts)
        yield from flush(counts)

    found = sample.select("label", "text").mapInArrow(run, "term binary, toxic long, clean long")
    found = found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = F.log(((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1)))
    best = found.where(F.col("toxic") >= max(3, toxic // 100)).withColumn("lift", lift).where(F.col("lift") > math.log(4))
    rows = best.orderBy(F.desc(F.col("toxic") * F.col("lift")), "term").limit(terms).collect()
    return [bytes(r["term"]) for r in rows]


def families(terms: list[bytes]) -> list[int]:
    """The voter of each term: one for each beginning, in the order of the terms, and the last for all that come after."""
    number: dict[str, int] = {}
    return [min(number.setdefault(t.decode("utf-8", "ignore").rstrip("*")[:STEM], len(number)), TERM_VOTERS - 1) for t in terms]


class Reader:
    """Counts terms and casts votes on one text after another."""

    def __init__(self, terms: list[bytes]):
        self.index = {t: i for i, t in enumerate(terms)}
        self.voter, self.lexicons = families(terms), [{x.encode() for x in words.split()} for words in LEXICONS]
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def of(self, word: bytes) -> tuple[int, ...]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > _MEMO:
                self.memo.clear()
            found = self.memo[word] = tuple(self.index[t] for t in beginnings(word) if t in self.index)
        return found

    def counts(self, found: Counter) -> dict[int, int]:
        out: dict[int, int] = {}
        for word, n in found.items():
            for i in self.of(word):
                out[i] = out.get(i, 0) + n
        return out

    def votes(self, text: bytes, found: Counter, counts: dict[int, int]) -> np.ndarray:
        out = np.zeros(VOTERS, dtype=bool)
        for i in counts:
            out[self.voter[i]] = True
        for k, lexicon in enumerate(self.lexicons):
            out[TERM_VOTERS + k] = not lexicon.isdisjoint(found)
        for k, pattern in enumerate(PATTERNS):
            out[TERM_VOTERS + len(LEXICONS) + k] = pattern.search(text) is not None
        return out


def _texts(batches, column: str = "text"):
    for batch in batches:
        for text in batch.column(column).cast(pa.binary()):
            yield text.as_buffer().to_pybytes() if text.is_valid else b""


def moments(docs: DataFrame, terms: list[bytes]) -> np.ndarray:
    """How many documents each pair of voters fires on together; the last row and column count all documents."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())])

    def run(batches):
        reader, total = Reader(terms), np.zeros((VOTERS + 1, VOTERS + 1), dtype=np.int64)
        votes: list[np.ndarray] = []

        def add():
            if votes:
                v = np.column_stack([np.array(votes, dtype=np.int64), np.ones(len(votes), dtype=np.int64)])
                total[:] += v.T @ v
                votes.clear()

        for text in _texts(batches):
            found = Counter(words(text))
            votes.append(reader.votes(text, found, reader.counts(found)))
            if len(votes) >= 4096:
                add()
        add()
        return batches_of(((i, j, int(total[i, j])) for i, j in zip(*np.nonzero(total), strict=True)), schema)

    out = np.zeros((VOTERS + 1, VOTERS + 1))
    sums = docs.select("text").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # (VOTERS + 1)^2 rows at most
        out[r["i"], r["j"]] = r["n"]
    return out


class LabelModel:
    """Rates of every voter on either class, and weights that discount correlated voters."""

    def __init__(self, sums: np.ndarray, prior: float):
        n = max(sums[-1, -1], 1.0)
        mean = sums[-1, :-1] / n
        cov = sums[:-1, :-1] / n - np.outer(mean, mean)
        m = len(mean)
        # The hidden label makes cov[i, j] = s[i] s[j], so each pair (j, k) gives s[i]^2 = cov[i, j] cov[i, k] / cov[j, k]; the
        # median over all pairs is not moved by the few voters that are correlated beside the label.
        s = np.zeros(m)
        for i in range(m):
            j, k = np.triu_indices(m, 1)
            good = (j != i) & (k != i) & (np.abs(cov[j, k]) > 1e-9)
            if good.any():
                s[i] = math.sqrt(max(0.0, float(np.median(cov[i, j[good]] * cov[i, k[good]] / cov[j[good], k[good]]))))
        s *= np.where(cov.sum(axis=1) >= 0, 1.0, -1.0)
        spread = np.clip(s / math.sqrt(prior * (1 - prior)), -1, 1)
        self.toxic = np.clip(mean + (1 - prior) * spread, 1e-4, 1 - 1e-4)
        self.clean = np.clip(mean - prior * spread, 1e-4, 1 - 1e-4)
        own = np.sqrt(np.maximum(np.diag(cov) - s * s, 1e-9))
        self.correlation = np.clip((cov - np.outer(s, s)) / np.outer(own, own), -1, 1) * (1.0 - np.eye(m))
        self.weight = 1.0 / (1.0 + np.maximum(self.correlation, 0).sum(axis=1))
        self.base = math.log(prior / (1 - prior))

    def logit(self, votes: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.toxic / self.clean), np.log((1 - self.toxic) / (1 - self.clean))
        return self.base + np.where(votes, yes, no) @ self.weight


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.2, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - target)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def with_labels(logit: np.ndarray, y: np.ndarray, accuracy: float) -> np.ndarray:
    """Posteriors with the known labels as one more voter of this accuracy."""
    told = math.log(accuracy / (1 - accuracy))
    return sigmoid(logit + np.where(y > 0, told, -told))


def chosen_accuracy(x: np.ndarray, logit: np.ndarray, y: np.ndarray, weight: np.ndarray, half: np.ndarray) -> float:
    """The accuracy whose fits on one half tell the known labels of the other half best (the least mean loss of both classes);
    of equals the first."""
    best, least = LABEL_ACCURACIES[1], math.inf
    if all(len(set(y[half == h])) == 2 for h in (0, 1)):
        for accuracy in LABEL_ACCURACIES:
            target, loss = with_labels(logit, y, accuracy), 0.0
            for h in (0, 1):
                p = np.clip(sigmoid(x[half != h] @ fit_linear(x[half == h], target[half == h], weight[half == h], rounds=8)), 1e-6, 1 - 1e-6)
                known = y[half != h]
                loss -= np.log(p[known > 0]).mean() + np.log(1 - p[known == 0]).mean()
            if loss < least:
                best, least = accuracy, loss
    return best


def weight_of(count, n_words: int):
    """What a term's count is worth in a text of so many words."""
    return np.log1p(np.asarray(count, dtype=float) * (PER_WORDS / max(n_words, PER_WORDS)))


class Model:
    def __init__(self, terms: list[bytes], weights: np.ndarray | None, constant: float):
        self.terms, self.weights, self.constant = terms, weights, constant

    def scores(self, texts: Iterator[bytes], reader: Reader) -> list[float]:
        if self.weights is None:
            return [self.constant for _ in texts]
        out = []
        for text in texts:
            found = words(text)
            counts = reader.counts(Counter(found))
            at, n = list(counts), list(counts.values())
            # Exact sums and scalars: a text's score doesn't hang on where it stands in a batch.
            logit = math.fsum([float(self.weights[-1]), *(self.weights[at] * weight_of(n, len(found))).tolist()])
            out.append(1.0 / (1.0 + math.exp(-min(max(logit, -40.0), 40.0))))
        return out


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    small_batches(docs.sparkSession)
    sample, stands_for = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, sample_per_class)
    rows = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    everything = sum(stands_for[c] * n for c, n in rows.items())
    prior = stands_for.get(1, 0) * rows.get(1, 0) / everything if everything else 0.0
    terms = mine(sample) if 0 < prior < 1 else []
    if not terms:
        return Model([], None, prior)
    label_model = LabelModel(moments(docs, terms), prior)
    schema = pa.schema([("label", pa.int32()), ("votes", pa.list_(pa.bool_())), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("size", pa.int64())])

    def read(batches):
        reader = Reader(terms)
        for batch in batches:
            out = []
            for label, text in zip(batch.column(0).to_pylist(), _texts([batch]), strict=True):
                every = words(text)
                found = Counter(every)
                counts = reader.counts(found)
                out.append((label, reader.votes(text, found, counts), list(counts), list(counts.values()), len(every)))
            yield from batches_of(iter(out), schema)

    got = sample.select("label", "text").mapInArrow(read, "label int, votes array<boolean>, at array<int>, n array<int>, size long").collect()
    y = np.array([r["label"] for r in got], dtype=float)
    x = np.zeros((len(got), len(terms) + 1))
    x[:, -1] = 1.0
    for k, r in enumerate(got):
        x[k, r["at"]] = weight_of(r["n"], r["size"])
    weight = np.array([stands_for[int(c)] for c in y])
    logit = label_model.logit(np.array([r["votes"] for r in got], dtype=bool))
    half = np.array([zlib.crc32(repr((sorted(zip(r["at"], r["n"], strict=True)), r["size"])).encode()) % 2 for r in got])
    posterior = with_labels(logit, y, chosen_accuracy(x, logit, y, weight / weight.mean(), half))
    return Model(terms, fit_linear(x, posterior, weight / weight.mean()), prior)


def score_name(docs: DataFrame) -> str:
    return unused(docs.columns, "toxicity__")[0]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with the column toxicity__ (or what score_name() calls it), from 0 to 1."""
    small_batches(docs.sparkSession)
    name = score_name(docs)

    def run(batches):
        reader = Reader(model.terms)
        for batch in batches:
            score = pa.array(model.scores(_texts([batch]), reader), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored(docs, train(docs, labels)).where(F.col(score_name(docs)) < threshold).select(docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        F.col("toxicity__").alias("score"),
        F.when(F.col("toxicity__") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
