"""Collocations: phrases whose parts stand together more often than alone, the best of each language.

Two passes over the texts. The first explodes all grams of one to max_n words into hashes with counts, counted within a task
before, and adds them up by hash; a hash keeps 46 bits of a gram's language and words, so grams that share one only add to each
other and no frequent gram is lost. On their way the hashes of a task that share their 14 high bits are one row, with an array of
the other 32 bits, so a hash takes about four bytes and not a row; they are exploded again where they are added up. The second explodes the grams again, keeps those whose hash is frequent, and adds them up by
language and words; what only shared a hash goes then, so counts are exact. The hashes are sent to the tasks as an array where
they are at most SENT, which is counted before. Beyond it a table of bits by their high bits is sent, of 64 MB at most, and what
it lets through besides goes by its exact count. Grams that can't be frequent are in no case shuffled with their words.

A candidate is cut after each of its words, the counts of both parts are joined, and the lowest score counts, in decimals. A
candidate inside a longer gram that is nearly as frequent goes: of two such grams any between is as frequent as the longer one,
so extensions by one word tell. Ranks come from two windows: the best of parts of each language, then the best of those.

Defined cases: a null text counts as empty, a null lang as und; repeated rows count again; ties go to the smaller phrase by bytes;
pieces without words have no grams; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, table

MAX_N = 4
#: Occurrences of a candidate at least.
LEAST = 30
#: Hundredths of a candidate's count from which on a longer gram takes its place.
COVERED = 80
#: Phrases of each language.
BEST = 2000
#: Bits of a hash that tells grams apart in the first pass.
_BITS = np.uint64(46)
#: Of these, the bits that are kept once for all hashes of a row.
_LOW = np.uint64(32)
#: Bytes of text for each task that adds up hashes, which holds those of about so much text.
_TASK_BYTES = 6 << 20
#: Frequent hashes that are sent to the tasks at most: 32 MB.
SENT = 1 << 22
#: High bits of a hash that the table of bits for more hashes goes by: at least those of a bucket and three, at most (64 MB).
_LEAST_TABLE, _TABLE = 17, 29
#: Words of a task that are counted together in the first pass and in the second, and different words that it remembers.
_HELD, _HELD_AGAIN, _KNOWN = 1 << 22, 1 << 20, 1 << 20
#: Rows of a batch that goes back to Spark.
_ROWS = 1 << 16
#: Parts that the candidates of a language are ranked in first.
_PARTS = 64

# A-Z go to lower case, these bytes end a piece, and blanks and tabs end a word.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TURNED = bytes(0x0A if b in _ENDS else 0x20 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Grams:
    """The words of several texts, one after another, and the hashes of their grams."""

    def __init__(self, max_n: int):
        self.max_n = max_n
        self.known: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.langs: list[tuple[str, int, int]] = []
        if len(self.known) > _KNOWN:
            self.known = {}

    def __len__(self) -> int:
        return len(self.ids)

    def add(self, lang: str, text: bytes) -> None:
        known, ids, sizes, before, pieces = self.known, self.ids, self.sizes, len(self.ids), len(self.sizes)
        for piece in text.translate(_TURNED).split(b"\n"):
            if found := [w for w in piece.split(b" ") if w]:
                sizes.append(len(found))
                for w in found:
                    if (k := known.get(w)) is None:
                        k = known[w] = len(known)
                    ids.append(k)
        if len(ids) > before:
            self.langs.append((lang, len(ids) - before, len(sizes) - pieces))

    def hashed(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size: the starts of its grams, and their hashes."""
        own = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, self.known)), dtype=np.uint64)
        self.flat = np.array(self.ids, dtype=np.int64)
        words = own[self.flat]
        langs = np.array([xxhash.xxh3_64_intdigest(lang, seed=7) for lang, _, _ in self.langs], dtype=np.uint64)
        so_far = np.repeat(langs, [n for _, n, _ in self.langs])
        ends = np.repeat(np.cumsum(self.sizes), self.sizes)  # where the piece of each word ends
        starts = np.arange(len(words))
        for n in range(1, self.max_n + 1):
            fits = ends[starts] >= starts + n
            starts, so_far = starts[fits], so_far[fits]
            so_far = (so_far ^ words[starts + n - 1]) * _MIX[0]
            so_far = (so_far ^ (so_far >> np.uint64(29))) * _MIX[1]
            so_far ^= so_far >> np.uint64(32)
            yield n, starts, so_far


def _texts(batches, grams: Grams, held: int) -> Iterator[None]:
    """Fills grams from the rows (lang, text), and says when enough are held or all are read."""
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            if text.is_valid:
                grams.add(lang, text.as_buffer().to_pybytes())
            if len(grams) >= held:
                yield
                grams.clear()
    if len(grams):
        yield


def gram_hashes(docs: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """(bucket, low, counts) for the grams of a task's texts, each hash once for some millions of words: bucket has the high bits
    of the hashes and low the others, as signed numbers; the last have counts, those before occur once."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("low", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches):
        grams = Grams(max_n)
        for _ in _texts(batches, grams, _HELD):
            for _, _, found in grams.hashed():
                hashes, n = np.unique(found >> (np.uint64(64) - _BITS), return_counts=True)
                high = (hashes >> _LOW).astype(np.int32)
                order = np.argsort((high << 1 | (n > 1)).astype(np.uint16), kind="stable")
                hashes, n, high = hashes[order], n[order], high[order]
                for k in range(0, len(hashes), 1 << 20):
                    part, times = high[k : k + (1 << 20)], n[k : k + (1 << 20)]
                    starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
                    low = lists(hashes[k : k + (1 << 20)].astype(np.uint32).view(np.int32), np.diff([*starts, len(part)]))
                    counts = lists(times[times > 1], np.add.reduceat(times > 1, starts, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(part[starts]), low, counts], schema=schema)

    return _by_language(docs).mapInArrow(run, "bucket int, low array<int>, counts array<int>")


def frequent_hashes(rows: DataFrame, parts: int, least: int) -> DataFrame:
    """(hash) of the hashes of gram_hashes() that occur `least` times."""
    once = F.size("low") - F.size("counts")
    each = rows.repartition(parts, "bucket").select("bucket", once.alias("once"), "counts", F.posexplode("low").alias("at", "low"))
    n = F.when(F.col("at") < F.col("once"), F.lit(1)).otherwise(F.get("counts", F.col("at") - F.col("once")))
    found = each.select("bucket", "low", n.cast("long").alias("n")).groupBy("bucket", "low").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return found.select((F.shiftleft(F.col("bucket").cast("long"), 32) + F.pmod(F.col("low").cast("long"), F.lit(1 << 32))).alias("hash"))


def _by_language(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def table_bits(hashes: DataFrame, count: int) -> np.ndarray:
    """A bit for each value of the high bits of hashes, set where one of the hashes has it; about one in 16 is, or more where that
    takes a larger table than is sent. Tasks make the bits of their buckets, so no hash goes through the driver."""
    bits = min(max((16 * max(count, 1) - 1).bit_length(), _LEAST_TABLE), _TABLE)
    within = np.uint64(bits) - (_BITS - _LOW)

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            high = np.sort(batch.column(0).to_numpy().astype(np.uint64) >> (_BITS - np.uint64(bits)))
            buckets, starts = np.unique(high >> within, return_index=True)
            for bucket, own in zip(buckets.tolist(), np.split(high, starts[1:]), strict=True):
                if bucket not in found:
                    found[bucket] = np.zeros(1 << int(within), dtype=bool)
                found[bucket][own & np.uint64((1 << int(within)) - 1)] = True
        for bucket, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["bucket", "bits"])

    out = np.zeros((1 << bits) >> 3, dtype=np.uint8)
    size = 1 << int(within) >> 3
    for row in hashes.coalesce(16).mapInArrow(run, "bucket int, bits binary").toLocalIterator():
        out[row.bucket * size : (row.bucket + 1) * size] |= np.frombuffer(row.bits, dtype=np.uint8)
    return out


def _kept_grams(docs: DataFrame, max_n: int, kept: np.ndarray) -> DataFrame:
    """(lang, words, phrase, n) for the grams of a task's texts of the hashes kept (in rising order), or that table_bits() has."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(kept)
    shift = np.uint64(64) - _BITS
    names = ["lang", "words", "phrase", "n"]

    def run(batches):
        grams, kept = Grams(max_n), sent.value
        table = kept.dtype == np.uint8
        if table:
            high = _BITS - np.uint64((8 * len(kept) - 1).bit_length())
        else:
            # A table of the high bits of the hashes sorts out most grams before the search.
            some = np.zeros(1 << 24, dtype=bool)
            some[kept >> (_BITS - np.uint64(24))] = True
        for _ in _texts(batches, grams, _HELD_AGAIN):
            spelled = None
            for n, starts, found in grams.hashed():
                short = found >> shift
                if table:
                    at = short >> high
                    near = np.flatnonzero(kept[at >> np.uint64(3)] << (at & np.uint64(7)).astype(np.uint8) & np.uint8(128))
                else:
                    near = np.flatnonzero(some[short >> (_BITS - np.uint64(24))])
                    at = np.searchsorted(kept, short[near])
                    near = near[kept[np.minimum(at, len(kept) - 1)] == short[near]]
                starts, found = starts[near], found[near]
                if not len(starts):
                    continue
                if spelled is None:
                    spelled = pa.array(list(grams.known), pa.binary()).cast(pa.string())
                    of = np.repeat(np.arange(len(grams.langs)), [k for _, k, _ in grams.langs])
                    langs = pa.array([lang for lang, _, _ in grams.langs])
                    names_of, codes = np.unique([lang for lang, _, _ in grams.langs], return_inverse=True)
                # One row for grams of a hash of 64 bits, if their words and languages are those of its first.
                _, first, group, counts = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
                same = codes[of[starts]] == codes[of[starts[first[group]]]]
                for k in range(n):
                    same &= grams.flat[starts + k] == grams.flat[starts[first[group]] + k]
                if not same.all():
                    counts = np.bincount(group[same], minlength=len(first))
                    first, counts = np.concatenate([first, np.flatnonzero(~same)]), np.concatenate([counts, np.ones((~same).sum(), dtype=np.int64)])
                for k in range(0, len(first), _ROWS):
                    at = starts[first[k : k + _ROWS]]
                    parts = [spelled.take(pa.array(grams.flat[at + j])) for j in range(n)]
                    phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(of[at])), pa.array(np.full(len(at), n, dtype=np.int32)), phrase, pa.array(counts[k : k + _ROWS].astype(np.int64))], names=names)

    return _by_language(docs).mapInArrow(run, "lang string, words int, phrase string, n long")


def frequent_grams(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, sent: int = SENT) -> DataFrame:
    """(lang, words, phrase, n): all grams of docs (lang, text) of one to max_n words that occur `least` times in a language."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // _TASK_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashes = cut_lineage(frequent_hashes(gram_hashes(docs, max_n), parts, least))
    count = hashes.count()
    kept = np.sort(hashes.toArrow().column(0).to_numpy()).astype(np.uint64) if count <= sent else table_bits(hashes, count)
    found = _kept_grams(docs if count else docs.limit(0), max_n, kept)
    return found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def word_totals(docs: DataFrame) -> DataFrame:
    """(lang, n): how many words each language has."""
    words = F.regexp_count(F.regexp_replace(F.coalesce("text", F.lit("")), r"[.,;:!?\x0A-\x0D]", " "), F.lit(r"[^\x20\x09]+"))
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), words.cast("long").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))


def scored(grams: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) for the grams (lang, words, phrase, n) of two words or more, at their lowest cut."""
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = grams.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), cut)
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, F.col("words")), " ").alias("right"))
    parts = grams.select("lang", F.col("phrase").alias("part"), "n")
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    low = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return low.select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def covered(grams: DataFrame, share: int = COVERED) -> DataFrame:
    """(lang, phrase) of grams inside one that is longer by a word and occurs `share` hundredths as often."""
    words = F.split("phrase", " ")
    longer = grams.where("words > 2").select("lang", F.col("n").alias("longer"), F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = grams.select("lang", "phrase", "n").join(longer, ["lang", "phrase"])
    return kept.where(F.col("longer").cast("decimal(20,0)") * 100 >= F.col("n").cast("decimal(20,0)") * share).select("lang", "phrase")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = COVERED, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), the best of each language of docs (lang, text)."""
    grams = cut_lineage(frequent_grams(docs, max_n, least))
    found = scored(grams).join(covered(grams, share), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    totals = word_totals(docs)
    return found.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, string_split(regexp_replace(trim(regexp_replace(piece, '[\x20\x09]+', ' ', 'g'), ' '), '^$', ''), ' ') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), words AS (
  SELECT lang, w, len(w) AS size FROM pieces WHERE w[1] <> ''
), totals AS (
  SELECT lang, sum(size) AS n FROM words GROUP BY 1
), grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, size, m, unnest(range(1, size - m + 2)) AS i FROM words, range(1, 5) r(m) WHERE size >= m)
  GROUP BY ALL HAVING count(*) >= 30
), split AS (
  SELECT lang, phrase, m, f, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS a, array_to_string(string_split(phrase, ' ')[k + 1 : m], ' ') AS b
  FROM grams, range(1, 4) r(k) WHERE k < m
), cuts AS (
  SELECT s.lang, s.phrase, s.m, s.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * s.f) // (x.f::HUGEINT + y.f) AS score
  FROM split s JOIN grams x ON x.lang = s.lang AND x.phrase = s.a JOIN grams y ON y.lang = s.lang AND y.phrase = s.b
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT g.lang, array_to_string(string_split(phrase, ' ')[i : i + p - 1], ' ') AS phrase, max(f) AS longer
  FROM grams g, range(2, 4) q(p), range(1, 4) r(i) WHERE p < m AND i + p - 1 <= m GROUP BY ALL
), kept AS (
  SELECT w.* FROM lowest w LEFT JOIN inner_parts p USING (lang, phrase) WHERE p.longer IS NULL OR 100::HUGEINT * p.longer < 80::HUGEINT * w.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
