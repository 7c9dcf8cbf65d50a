"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the normalised test items. A document's words are streamed through it, tracking the
longest run that ends at each word; a word is hit if a window of an item covers it (13 words, or a whole shorter item). Most
words are never streamed: a window always contains one of the short probes taken at a fixed stride, so only the surroundings
of probes that occur in the items can hold a window.

The items are cut into shards of bounded size; each shard's automaton reaches the workers by a broadcast, and the documents
are read once for each shard (one, unless the benchmark is very large). What the passes of several shards find comes out of them
by row number, for rows with hits alone, and is merged.

Defined cases: null has no words; an item without words has no window; a document without words is clean; repeated items and
rows each count; an empty benchmark leaves every document clean; an empty table gives no rows; further columns of either table
are not read, whatever their names, and stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import _WORD_BYTES, cut_lineage, small_batches, table, unused, word_count, words, write_table

WINDOW = 13
#: Words of one shard of the benchmark: about 700 bytes each in a worker.
SHARD_WORDS = 100_000
#: A document counts as contaminated from this share of hit words: n_hit * SHARE >= n_words.
SHARE = 20


class SuffixAutomaton:
    """Over the words of many sequences; `window` words, or a whole shorter sequence, make a window."""

    def __init__(self, sequences: Iterable[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set] = {}  # of states whose runs of window words occur in items
        self.ends: dict[int, tuple[int, set]] = {}  # of states that hold a whole shorter item: (its words, items)
        shortest, whole = window, []
        for item, seq in sequences:
            if not seq:
                continue
            shortest = min(shortest, len(seq))
            whole.append((item, seq))
            last = 0
            for word in seq:
                last = self._extend(last, word)
        self.shortest = shortest if whole else 0
        for item, seq in whole:
            state = n = 0
            for word in seq:
                state, n = self.step(state, n, word)
                if len(seq) >= window and n >= window:
                    self.items.setdefault(self.holding(state, window), set()).add(item)
            if len(seq) < window:
                self.ends.setdefault(self.holding(state, len(seq)), (len(seq), set()))[1].add(item)
        # Probes: every window of at least `shortest` words contains one that starts at a multiple of the stride.
        self.probe = min(3, self.shortest)
        self.stride = self.shortest - self.probe + 1
        self.probes = {tuple(seq[i : i + self.probe]) for _, seq in whole for i in range(len(seq) - self.probe + 1)}

    def _clone(self, state: int, n: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(n)
        self.link[state] = len(self.next) - 1
        return len(self.next) - 1

    def _redirect(self, p: int, word: bytes, old: int, new: int) -> None:
        while p >= 0 and self.next[p].get(word) == old:
            self.next[p][word] = new
            p = self.link[p]

    def _extend(self, last: int, word: bytes) -> int:
        if (q := self.next[last].get(word)) is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            clone = self._clone(q, self.length[last] + 1)
            self._redirect(last, word, q, clone)
            return clone
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        new, p = len(self.next) - 1, last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                clone = self._clone(q, self.length[p] + 1)
                self._redirect(p, word, q, clone)
                self.link[new] = clone
        return new

    def step(self, state: int, n: int, word: bytes) -> tuple[int, int]:
        """The state and length of the longest run that ends with this word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, n + 1)

    def holding(self, state: int, n: int) -> int:
        """The state that holds the last n words of a run at this state."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def regions(self, seq: list[bytes]) -> Iterator[tuple[int, int]]:
        """Ranges outside of which no window lies."""
        if not self.shortest:
            return
        start = end = -1
        probe, probes, longest = self.probe, self.probes, self.window
        for at in range(0, len(seq) - probe + 1, self.stride):
            if tuple(seq[at : at + probe]) in probes:
                a, b = max(0, at - longest + probe), at + longest
                if a > end:
                    if end >= 0:
                        yield start, min(end, len(seq))
                    start = a
                end = b
        if end >= 0:
            yield start, min(end, len(seq))

    def hits(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged ranges of hit words, and the items whose windows occur."""
        spans: list[list[int]] = []
        found: set = set()

        def hit(a: int, b: int) -> None:
            while spans and spans[-1][1] >= a:
                a = min(a, spans.pop()[0])
            spans.append([a, b])

        for begin, end in self.regions(seq):
            state = n = 0
            for i in range(begin, end):
                state, n = self.step(state, n, seq[i])
                if n >= self.window:
                    found |= self.items.get(self.holding(state, self.window), set())
                    hit(i + 1 - self.window, i + 1)
                if self.ends:
                    at, bound = state, n
                    while at > 0:
                        if (short := self.ends.get(at)) and short[0] <= bound:
                            found |= short[1]
                            hit(i + 1 - short[0], i + 1)
                        at = self.link[at]
                        bound = self.length[at] if at > 0 else 0
        return [(a, b) for a, b in spans], found


def _shards(bench: DataFrame, shard_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items, a bounded number of words at a time; the driver holds one shard and what is read ahead of it."""
    shard, size = [], 0
    for row in bench.select("item_id", F.encode("text", "UTF-8").alias("text")).toLocalIterator():
        seq = words(bytes(row["text"] or b""))
        if size and size + len(seq) > shard_words:
            yield shard
            shard, size = [], 0
        shard.append((row["item_id"], seq))
        size += len(seq)
    yield shard


#: The columns that contamination() adds, unless docs has them already.
_FOUND = ("n_words__", "spans__", "items__")
_SPANS = "array<struct<a:bigint,b:bigint>>"
_SPANS_ARROW = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def added(docs: DataFrame) -> list[str]:
    """The names of the columns that contamination() adds to docs: those of _FOUND, longer where docs has such a column."""
    return unused(docs.columns, *_FOUND)


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs (a column text and any others) with n_words__, spans__ (ranges of hit words, from and to) and items__
    (ids of the items with occurring windows, as sorted strings), or what added() names them. bench has item_id and text."""
    spark = docs.sparkSession
    small_batches(spark)
    shards = _shards(bench, shard_words)
    first, second = next(shards), next(shards, None)
    n_words, spans, items = added(docs)
    if second is None:
        found = _streamed(docs, spark.sparkContext.broadcast(SuffixAutomaton(first, window)), docs.columns, [spans, items])
        return found.withColumn(n_words, word_count()).select(*docs.columns, n_words, spans, items)
    # A pass for each shard; only the rows with hits, by number, come out of it.
    row = unused([*docs.columns, n_words, spans, items], "row")[0]
    rows = spark.read.parquet(write_table(docs.withColumn(row, F.monotonically_increasing_id())))
    passes = []
    for shard in chain([first, second], shards):
        sent = spark.sparkContext.broadcast(SuffixAutomaton(shard, window))
        passes.append(cut_lineage(_streamed(rows.select(row, "text"), sent, [row], [spans, items]).where(F.size(spans) > 0)))
        sent.unpersist()
    every = reduce(DataFrame.unionAll, passes).groupBy(row).agg(F.flatten(F.collect_list(spans)).alias(spans), F.flatten(F.collect_list(items)).alias(items))
    found = _merged(every, row, spans, items)
    joined = rows.join(found, row, "left").withColumns({n_words: word_count(), spans: F.coalesce(spans, F.array().cast(_SPANS)), items: F.coalesce(items, F.array().cast("array<string>"))})
    return joined.select(*docs.columns, n_words, spans, items)


def _merged(found: DataFrame, row: str, spans: str, items: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            ranges = [[{"a": a, "b": b} for a, b in _union([(x["a"], x["b"]) for x in many])] for many in batch.column(spans).to_pylist()]
            known = [sorted(set(x)) for x in batch.column(items).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(row), pa.array(ranges, _SPANS_ARROW), pa.array(known, pa.list_(pa.string()))], names=[row, spans, items])

    return found.select(row, spans, items).mapInArrow(run, f"`{row}` bigint, `{spans}` {_SPANS}, `{items}` array<string>")


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _streamed(docs: DataFrame, sent, keep: list[str], names: list[str]) -> DataFrame:
    """The columns keep of docs with the spans and items that one automaton finds in the column text."""
    schema = StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL(f"`{names[0]}` {_SPANS}, `{names[1]}` array<string>").fields])

    def run(batches):
        automaton = sent.value
        for batch in batches:
            spans, items = [], []
            for text in batch.column("text").cast(pa.binary()):
                hit, found = automaton.hits(words(text.as_buffer().to_pybytes())) if text.is_valid else ([], ())
                spans.append([{"a": a, "b": b} for a, b in hit])
                items.append(sorted(map(str, found)))
            own = [pa.array(spans, _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *own], names=schema.names)

    return docs.mapInArrow(run, schema)


def _n_hit(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])


def is_contaminated(n_words: str = _FOUND[0], spans: str = _FOUND[1]) -> Column:
    return (_n_hit(spans) > 0) & (_n_hit(spans) * SHARE >= F.col(n_words))


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs that the rule leaves: those whose hit words reach the coverage limit go, all others stay unchanged."""
    n_words, spans, _ = added(docs)
    return contamination(docs, bench).where(~is_contaminated(n_words, spans)).select(docs.columns)


def cut_spans(docs: DataFrame, bench: DataFrame, longest: int = WINDOW) -> DataFrame:
    """The rows of docs with every range of at least `longest` hit words cut out of the text, from the first byte of its first
    word to the last of its last; n_cut (or n_cut_, where docs has that) counts the words that went."""
    spans, columns = added(docs)[1], docs.columns
    n_cut = unused(columns, "n_cut")[0]
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"`{n_cut}` bigint").fields])

    def run(batches):
        for batch in batches:
            out, cut = [], []
            for text, ranges in zip(batch.column("text").cast(pa.binary()), batch.column(spans).to_pylist(), strict=True):
                raw, n = (text.as_buffer().to_pybytes() if text.is_valid else None), 0
                wide = [(x["a"], x["b"]) for x in ranges if x["b"] - x["a"] >= longest]
                if wide:
                    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_WORD_BYTES))]
                    for a, b in reversed(wide):
                        raw, n = raw[: at[a][0]] + raw[at[b - 1][1] :], n + b - a
                out.append(raw)
                cut.append(n)
            text = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(text if c == "text" else batch.column(c) for c in columns), pa.array(cut, pa.int64())], names=schema.names)

    return contamination(docs, bench).select(*columns, spans).mapInArrow(run, schema)


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Counts of each document of docs (doc_id, text)."""
    n_words, spans, items = _FOUND
    return contamination(docs.select("doc_id", "text"), bench).select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        _n_hit(spans).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# A brute-force statement of the same rule: every window of every item against every run of words of every document.
OP3_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, len(w) AS n, least(len(w), 13) AS size, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), size AS (SELECT DISTINCT size FROM win),
run AS (
  SELECT doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') AS run
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM doc, size WHERE len(w) >= size)
), hit AS (SELECT DISTINCT r.doc_id, r.s, r.size, x.item_id FROM run r JOIN win x ON r.run = x.run AND r.size = x.size),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN pos ON pos.doc_id = doc.doc_id LEFT JOIN ids ON ids.doc_id = doc.doc_id
"""
