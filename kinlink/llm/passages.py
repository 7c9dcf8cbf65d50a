"""Repeated passages by sparse suffix arrays.

A text is a sequence of lower-cased alphanumeric words. Only suffixes at content-selected positions are kept: the minimisers of
the hashes of K words among the W first starts of each window of LENGTH words, so equal windows keep the same position.
The kept suffixes of all texts are sorted by their words over ranges, and neighbours are compared by their common prefix. A
suffix that has PREFIX words in common with a neighbour is a match, and is extended to the left and to the right: to all windows
of LENGTH words that keep it. These windows are sorted in turn, and neighbours that are equal are a repeated passage. PREFIX
words from the kept position lie inside each of its windows, so no repeated passage of LENGTH words is missed.

Suffixes are sorted and compared by the words themselves, windows by a digest of 128 bits of their words, and texts are told
apart by two hashes of 64 bits. Of equal windows the one of the smallest (doc_id, text, place) is the original; the words that
the others cover are repeated. Ranges are cut between rows, not between keys, so a passage that very many documents share is
dealt to many tasks; what a run of equal keys continues across ranges is settled by two rows for each range. A task holds a
batch of rows at a time. Equal texts are searched once and their copies count as repeated from end to end; copies of a frequent
text are dealt to several tasks wherever they meet what was found for it.

Defined cases: a null, empty or shorter text has no passage; a passage that overlaps its own copy counts (a run of one word);
rows that agree in doc_id and text are one document; rows without an id come last, so they are originals only among themselves;
an empty table gives no rows; further columns are kept by cut_repeats(), whatever their names, and not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _WORD_BYTES, Hasher, cut_lineage, record_batch, small_batches, spread_join, table, unused, word_count, words

LENGTH = 50
#: Words of a hash whose minima select positions; starts among which a minimum is taken.
K, W = 8, 35
#: Words by which suffixes are sorted: what is left of a window from the last start that can be its first kept one.
PREFIX = LENGTH - (W - 1)
#: Rows of a range that are compared at a time.
COMPARED = 1 << 15

#: Stands for a missing doc_id and sorts last.
_NO_ID = (1 << 63) - 1


def selected(found: list[bytes], hasher: Hasher) -> np.ndarray:
    """For every window of LENGTH words the kept position that stands for it: the start of the smallest hash of K words among
    the W first starts of the window, the last of equal ones. It depends on the window's own words alone."""
    count = len(found) - LENGTH + 1
    if count < 1:
        return np.zeros(0, dtype=np.int64)
    least = hasher.runs(hasher.words(found), K)[: count + W - 1]
    at = np.arange(len(least))
    size = 1
    while size < W:  # minima of runs of twice as many starts, the last run overlapping itself
        step = min(size, W - size)
        right = least[step:] <= least[:-step]
        least = np.where(right, least[step:], least[:-step])
        at = np.where(right, at[step:], at[:-step])
        size += step
    return at


class Runs:
    """The words of a text joined by blanks, and runs of them."""

    def __init__(self, found: list[bytes]):
        self.text = b" ".join(found)
        self.ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])

    def of(self, at: np.ndarray, size: int):
        """The runs of `size` words from the places `at`."""
        text = self.text
        return (text[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + size - 1].tolist(), strict=True))


def _texts(batch: pa.RecordBatch, column: str = "text"):
    for text in batch.column(column).cast(pa.binary()):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


_SUFFIX = ("prefix", "text_key", "text_more", "at")
_WINDOW = ("one", "two", "doc_id", "text_key", "text_more", "at")


def suffixes(docs: DataFrame) -> DataFrame:
    """(prefix, text_key, text_more, at) of every kept suffix of docs (text, text_key, text_more)."""
    schema = pa.schema([("prefix", pa.binary()), *((c, pa.int64()) for c in _SUFFIX[1:])])

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            prefixes, parts = [], []  # of a batch: few large batches go out
            for key, more, text in zip(batch.column("text_key").to_pylist(), batch.column("text_more").to_pylist(), _texts(batch), strict=True):
                found = words(text)
                if len(found) >= LENGTH:
                    at = np.unique(selected(found, hasher))
                    prefixes += Runs(found).of(at, PREFIX)
                    parts.append((np.full(len(at), key), np.full(len(at), more), at))
            if parts:
                yield record_batch(schema, [prefixes, *(np.concatenate(c) for c in zip(*parts, strict=True))])

    return docs.select("text", "text_key", "text_more").mapInArrow(run, "prefix binary, text_key long, text_more long, at long")


def windows(docs: DataFrame) -> DataFrame:
    """(one, two, doc_id, text_key, text_more, at) of the windows that extend the shared suffixes of docs (doc_id, text_key,
    text_more, text, places); one and two are the digest of a window's words."""
    schema = pa.schema([(c, pa.int64()) for c in _WINDOW])

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            rest = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text_more", "places")), strict=True)
            parts = []
            for text, (doc, key, more, places) in zip(_texts(batch), rest, strict=True):
                found = words(text)
                at = np.flatnonzero(np.isin(selected(found, hasher), places))
                if len(at):
                    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, Runs(found).of(at, LENGTH))), dtype=np.int64).reshape(-1, 2)
                    parts.append((digest[:, 0], digest[:, 1], *(np.full(len(at), x) for x in (doc, key, more)), at))
            if parts:
                yield record_batch(schema, [np.concatenate(c) for c in zip(*parts, strict=True)])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in _WINDOW))


class Range:
    """The sorted rows of one range, each compared with its neighbours; rows that agree in everything count once. The last row
    is held back until the one after it has come."""

    def __init__(self, key: list[str], owner: str):
        self.key, self.owner = key, owner
        self.held: pa.Table | None = None
        self.begins = True  # whether the held row is the first of its run
        self.original = 0  # the owner of the first row of the held row's run
        self.in_head = True  # whether the held row belongs to the range's first run
        self.head: tuple | None = None  # key and owner of the first run

    def values(self, rows: pa.Table, k: int) -> tuple:
        return tuple(rows.column(c)[k].as_py() for c in self.key)

    def add(self, rows: pa.Table | None) -> pa.Table:
        """The rows that came before the last one of these, so far as they share their key or lie in the first run; without
        rows, what was held back, as the range ends there."""
        last = rows is None
        rows = self.held if last else rows if self.held is None else pa.concat_tables([self.held, rows])
        arrays = {c: rows.column(c).combine_chunks() for c in rows.schema.names}
        new = {c: pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False) for c, a in arrays.items()}
        differs = np.append(True, np.logical_or.reduce(list(new.values())))
        begins = np.append(self.begins, np.logical_or.reduce([new[c] for c in self.key]))[differs]
        rows = rows.filter(pa.array(differs))
        n, owners = rows.num_rows, rows.column(self.owner).to_numpy()
        if self.head is None:
            self.head = (self.values(rows, 0), int(owners[0]))
        run = np.cumsum(begins)
        starts = np.append(0, np.flatnonzero(begins))  # of each run; the first stands for one that began before these rows
        originals = np.where(run > 0, owners[starts[run]], self.original)
        head = (run == run[0]) & self.in_head
        shared = ~begins | np.append(~begins[1:], False)
        edge = head.astype(np.int32)
        if last:
            edge[-1] += 2
        done = n if last else n - 1
        self.held, self.begins, self.original, self.in_head = rows.slice(n - 1), bool(begins[-1]), int(originals[-1]), bool(head[-1])
        out = rows.slice(0, done)
        for name, column in (("original", originals), ("first", begins), ("shared", shared), ("edge", edge)):
            out = out.append_column(name, pa.array(column[:done]))
        return out.filter(pa.array((shared | (edge > 0))[:done]))


def neighbours(rows: DataFrame, key: list[str], owner: str) -> DataFrame:
    """The rows whose key another row shares, sorted and compared with their neighbours. Adds first (the first row of its key)
    and original (that row's owner, a column of longs)."""
    columns = rows.columns
    ordered = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields]
    extra = [("original", "bigint"), ("first", "boolean"), ("shared", "boolean"), ("edge", "int"), ("range", "int"), ("head", "boolean"), ("whole", "boolean")]
    ddl = ", ".join(f"`{n}` {k}" for n, k in kinds + extra)
    arrow = {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32()}
    schema = pa.schema([(n, arrow[k]) for n, k in kinds + extra])

    def compare(batches):
        here, part = Range(key, owner), TaskContext.get().partitionId()

        def said(rows: pa.Table | None):
            out = here.add(rows)
            m = out.num_rows
            for name, column in (("range", pa.array(np.full(m, part, dtype=np.int32))), ("head", pa.nulls(m, pa.bool_())), ("whole", pa.nulls(m, pa.bool_()))):
                out = out.append_column(name, column)
            return out.cast(schema).to_batches(max_chunksize=1 << 14)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= COMPARED:
                yield from said(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from said(pa.Table.from_batches(held))
        if here.held is None:
            return
        tail = (here.values(here.held, 0), here.original)
        yield from said(None)
        for is_head, (values, original) in ((True, here.head), (False, tail)):
            ends = dict(zip(key, values, strict=True)) | {"original": original, "range": part, "head": is_head, "whole": here.in_head}
            yield record_batch(schema, [[ends.get(n)] for n in schema.names])

    found = cut_lineage(ordered.mapInArrow(compare, ddl))
    ends: dict[int, dict] = {}
    for r in found.where("head IS NOT NULL").collect():  # two rows for each range
        ends.setdefault(r["range"], {})[r["head"]] = r
    settled, before, before_original = [], None, None
    for part in sorted(ends):
        head, tail = ends[part][True], ends[part][False]
        goes_on = before is not None and all(before[c] == head[c] for c in key)
        if goes_on:
            settled[-1][3] = True
        settled.append([part, goes_on, before_original if goes_on else None, False])
        before, before_original = tail, before_original if goes_on and head["whole"] else tail["original"]
    told = rows.sparkSession.createDataFrame([tuple(s) for s in settled], "range int, goes_on boolean, head_original long, followed boolean")
    in_head = (F.col("edge").bitwiseAND(1) != 0) & F.col("goes_on")
    return (
        found.where("head IS NULL")
        .join(F.broadcast(told), "range")
        .where(F.col("shared") | in_head | ((F.col("edge").bitwiseAND(2) != 0) & F.col("followed")))
        .select(*columns, F.when(in_head, F.col("head_original")).otherwise(F.col("original")).alias("original"), (F.col("first") & ~in_head).alias("first"))
    )


def _ranges(starts: np.ndarray, size: int = LENGTH) -> list[dict]:
    """Merged ranges of the words that windows at these starts cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    new = np.flatnonzero(np.diff(starts) > size)
    return [{"a": int(a), "b": int(b) + size} for a, b in zip(starts[np.append(0, new + 1)], starts[np.append(new, len(starts) - 1)], strict=True)]


_SPANS = "array<struct<a:bigint,b:bigint>>"
_TEXT = ["text_key", "text_more"]


def _merged(found: DataFrame) -> DataFrame:
    """(text_key, text_more, spans, originals, holds) of texts with the starts of their repeated windows."""
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        for batch in batches:
            spans = [_ranges(np.array(x, dtype=np.int64)) for x in batch.column("starts").to_pylist()]
            names = [c for c in batch.schema.names if c != "starts"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(spans, kind)], names=[*names, "spans"])

    return found.select(*_TEXT, "originals", "holds", "starts").mapInArrow(run, f"text_key long, text_more long, originals array<long>, holds boolean, spans {_SPANS}")


def _id(column: str | Column = "doc_id") -> Column:
    return F.coalesce(column, F.lit(_NO_ID))


def _keys(text: str = "text") -> list[Column]:
    return [F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(1), text).alias("text_more")]


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For every distinct text of docs (doc_id, text) that repeats a passage or holds an original of one: (text_key, text_more,
    least, spans, originals, holds), where least is its smallest doc_id, whose row has the spans; other rows of the text repeat it
    from end to end, if copies says so. And (text_key, text_more, n) of all texts, with how many rows have them."""
    small_batches(docs.sparkSession)
    rows = docs.select(_id().alias("doc_id"), "text", *_keys())
    texts = rows.select("doc_id", *_TEXT, word_count().alias("n_words")).groupBy(*_TEXT).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("n_words").alias("n_words"), F.count("*").alias("n"))
    texts = cut_lineage(texts)
    shared = neighbours(suffixes(rows), ["prefix"], "at")
    places = shared.groupBy(*_TEXT).agg(F.sort_array(F.collect_set("at")).alias("places"))
    places = places.join(texts.select(*_TEXT, "least"), _TEXT)
    to_extend = spread_join(rows, places, _TEXT, texts, "doc_id", how="inner").where("doc_id = least").select("doc_id", *_TEXT, "text", "places")
    # Rows that repeat a document give the same windows, which count once.
    equal = neighbours(windows(to_extend), ["one", "two"], "doc_id")
    found = equal.groupBy(*_TEXT).agg(
        F.collect_list(F.when(~F.col("first"), F.col("at"))).alias("starts"),
        F.sort_array(F.collect_set(F.when(~F.col("first") & (F.col("original") != _NO_ID), F.col("original")))).alias("originals"),
        F.max("first").alias("holds"),
    )
    copied = (F.col("most") != F.col("least")) & (F.col("n_words") >= LENGTH)
    told = texts.select(*_TEXT, "least", "n_words", copied.alias("copies")).join(_merged(found), _TEXT, "left").where(F.col("copies") | F.col("spans").isNotNull())
    return cut_lineage(told), texts


def report(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): its words, how many of them repeat, their ranges, the documents that hold the
    originals, and whether it holds an original itself."""
    docs = docs.select("doc_id", "text")
    told, texts = repeats(docs)
    told = told.select(*_TEXT, "least", "copies", "spans", "originals", "holds")
    # The texts stay behind: their number of words comes with their key.
    sized = texts.select(*_TEXT, "n_words").join(told, _TEXT, "left")
    rows = spread_join(docs.select("doc_id", *_keys()), sized, _TEXT, texts, "doc_id")
    copy = F.coalesce(F.col("copies") & (_id() != F.col("least")), F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_words").alias("b")))
    spans = F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast(_SPANS)))
    found = rows.select(
        "doc_id",
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        spans.alias("spans"),
        F.when(copy, F.array("least")).otherwise(F.coalesce("originals", F.array().cast("array<long>"))).alias("originals"),
        (~copy & (F.coalesce("holds", F.lit(False)) | F.coalesce("copies", F.lit(False)))).alias("holds_original"),
    )
    return found.withColumn("n_repeated", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])).select(
        "doc_id", "n_words", "n_repeated", "spans", "originals", "holds_original"
    )


def _without(text: bytes, spans: list[dict]) -> bytes:
    """A text without some ranges of its words, from the first byte of a range to the last."""
    raw = text.translate(_WORD_BYTES)
    edges = np.flatnonzero(np.diff(np.frombuffer(b" " + raw, dtype=np.uint8) != 0x20, prepend=False).astype(bool)) - 1
    # Edges alternate: a word's first byte, the byte after its last.
    begins, ends = edges[0::2], np.append(edges[1::2], len(raw))
    for x in reversed(spans):
        text = text[: begins[x["a"]]] + text[ends[x["b"] - 1] :]
    return text


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with the repeated words cut out of the text, from the first byte of a range to the last; a text of which
    nothing is left goes, and so do the copies of a text of LENGTH words or more."""
    told, texts = repeats(docs.select("doc_id", "text"))
    own = unused(docs.columns, "text_key", "text_more", "least", "copies", "spans")
    key, more, least, copies, spans = own
    told = told.select(*(F.col(c).alias(n) for c, n in zip(("text_key", "text_more", "least", "copies", "spans"), own, strict=True)))
    texts = texts.select(F.col("text_key").alias(key), F.col("text_more").alias(more), "n")
    rows = docs.withColumns({key: F.xxhash64("text"), more: F.xxhash64(F.lit(1), "text")})
    rows = spread_join(rows, told, [key, more], texts, "doc_id")
    rows = rows.where(~F.coalesce(F.col(copies) & (_id() != F.col(least)), F.lit(False))).select(*docs.columns, spans)
    empty = unused(rows.columns, "empty")[0]
    names = [*docs.columns, empty]

    def run(batches):
        for batch in batches:
            text, gone = batch.column("text"), np.zeros(batch.num_rows, dtype=bool)
            ranges = batch.column(spans).to_pylist()
            if any(ranges):
                out = text.cast(pa.binary()).to_pylist()
                for k in (k for k, x in enumerate(ranges) if x):
                    out[k] = _without(out[k], ranges[k])
                    gone[k] = not words(out[k])
                text = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(text if c == "text" else batch.column(c) for c in docs_columns), pa.array(gone)], names=names)

    docs_columns = docs.columns
    schema = docs.select("*", F.lit(False).alias(empty)).schema
    return rows.mapInArrow(run, schema).where(~F.col(empty)).select(docs_columns)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["a"].cast("string"), x["b"].cast("string"))), " ")
    return found.select(
        "doc_id", "n_words", "n_repeated", spans.alias("spans"), F.get("originals", F.lit(0)).alias("first_original"), F.size("originals").cast("long").alias("n_originals"), "holds_original"
    )


# Every window of 50 words of every text, compared by its words.
OP8_SQL = r"""
WITH doc AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), txt AS (SELECT text, min(doc_id) AS least, max(doc_id) AS most FROM doc WHERE len(w) >= 50 GROUP BY text),
own AS (SELECT DISTINCT d.doc_id, d.text, d.w FROM doc d JOIN txt t ON t.text = d.text AND t.least = d.doc_id),
win AS (SELECT doc_id, text, s, array_to_string(w[s : s + 49], ' ') AS run FROM (SELECT doc_id, text, w, unnest(range(1, len(w) - 48)) AS s FROM own)),
seen AS (SELECT doc_id, text, s, row_number() OVER o AS k, first_value(doc_id) OVER o AS original, count(*) OVER (PARTITION BY run) AS n FROM win WINDOW o AS (PARTITION BY run ORDER BY doc_id, text, s)),
holds AS (SELECT DISTINCT doc_id, text FROM seen WHERE n > 1 AND k = 1),
starts AS (SELECT doc_id, text, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id, text ORDER BY s) <= 50 THEN 0 ELSE 1 END AS opens FROM seen WHERE k > 1),
span AS (SELECT doc_id, text, min(s) - 1 AS a, max(s) + 49 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id, text ORDER BY s) AS g FROM starts) GROUP BY doc_id, text, g),
spans AS (SELECT doc_id, text, sum(b - a) AS n, string_agg(CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR), ' ' ORDER BY a) AS spans FROM span GROUP BY doc_id, text),
origs AS (SELECT doc_id, text, min(original) AS one, count(DISTINCT original) AS n FROM seen WHERE k > 1 GROUP BY doc_id, text)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(CASE WHEN d.doc_id <> t.least THEN len(w) ELSE coalesce(x.n, 0) END AS BIGINT) AS n_repeated,
  CASE WHEN d.doc_id <> t.least THEN '0-' || CAST(len(w) AS VARCHAR) ELSE coalesce(x.spans, '') END AS spans,
  CASE WHEN d.doc_id <> t.least THEN t.least ELSE o.one END AS first_original,
  CAST(CASE WHEN d.doc_id <> t.least THEN 1 ELSE coalesce(o.n, 0) END AS BIGINT) AS n_originals,
  CASE WHEN d.doc_id <> t.least THEN FALSE ELSE coalesce(h.doc_id IS NOT NULL OR t.most <> t.least, FALSE) END AS holds_original
FROM doc d LEFT JOIN txt t ON t.text = d.text LEFT JOIN spans x ON x.doc_id = d.doc_id AND x.text = d.text
LEFT JOIN origs o ON o.doc_id = d.doc_id AND o.text = d.text LEFT JOIN holds h ON h.doc_id = d.doc_id AND h.text = d.text
"""
