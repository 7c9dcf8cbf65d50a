"""Grams of texts as arrays of 64-bit hashes: counted by text, counted by country for the vocabulary, and turned to unit vectors.

Texts are held in chunks of some million grams. A chunk asks once for each of its distinct grams; the askers of a gram meet by
country and its high bits, where its document frequency is the sum of theirs, and each gets it back if the vocabulary keeps the
gram. So what is shuffled is a chunk's distinct grams, not a row for each gram of a text, and nothing is sorted or hashed as
rows of grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grams of texts in a chunk, at least until the batch ends in which so many are met.
CHUNK = 1 << 21
#: Bytes of text in a chunk of chunked().
CHUNK_BYTES = 8 << 20
_BITS = 56
#: Bits of a gram's place in its code.
_PLACE = 40
_ASKED = "country string, bucket int, chunk long, gram array<long>, df array<long>, cf array<long>"


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """values cut at ends, which begin with 0."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, and the list that each belongs to."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change, with 0 in front if there are any."""
    new = np.zeros(max(len(keys[0]) - 1, 0), dtype=bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1]) if len(keys[0]) else np.zeros(0, dtype=np.int64)


def counted(texts: DataFrame, name: str, grams: Column) -> DataFrame:
    """(chunk, country, name, copies, gram, tf) from (country, name, copies, ...): the distinct grams of each text, as hashes in
    rising order, and how often it has them. To be written before it is used: chunks go by what a task meets."""
    ddl = f"chunk long, country string, {name} string, copies long, gram array<long>, tf array<long>"

    def run(batches):
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            gram, row = _flat(batch.column(3))
            gram, tf, ends = _text_grams(gram, row, batch.num_rows)
            columns = [pa.array(np.full(batch.num_rows, chunk)), *(batch.column(i) for i in range(3)), _lists(gram, ends), _lists(tf, ends)]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "country", name, "copies", "gram", "tf"])
            held += len(gram)
            if held >= CHUNK:
                chunk, held = chunk + 1, 0

    hashes = F.transform(grams, lambda g: F.xxhash64(g))
    return texts.where("country is not null").select("country", name, F.col("copies").cast("long").alias("copies"), hashes.alias("gram")).mapInArrow(run, ddl)


def chunked(texts: DataFrame, name: str) -> DataFrame:
    """(chunk, country, name, copies, text) from (country, name, copies, text): the texts of a task in chunks by their bytes. To be
    written before it is used."""

    def run(batches):
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            number = chunk + (held + ends) // CHUNK_BYTES
            held += int(ends[-1]) if len(ends) else 0
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int64)), *batch.columns], names=["chunk", *batch.schema.names])

    rows = texts.where("country is not null").select("country", name, F.col("copies").cast("long").alias("copies"), "text")
    return rows.mapInArrow(run, f"chunk long, country string, {name} string, copies long, text string")


def _text_grams(gram: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams of each text in rising order, how often it has them, and where texts end, beginning with 0."""
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    first = _starts(row, gram)
    return gram[first], np.diff(np.append(first, len(gram))), np.searchsorted(row[first], np.arange(rows + 1))


def asked_of(texts: DataFrame, grams) -> DataFrame:
    """asked() of chunked() texts; grams maps a column to an array."""

    def counts(batches):
        for batch in batches:
            gram, tf, ends = _text_grams(*_flat(batch.column("gram")), batch.num_rows)
            columns = [*(batch.column(c) for c in ("chunk", "country", "copies")), _lists(gram, ends), _lists(tf, ends)]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "country", "copies", "gram", "tf"])

    hashes = F.transform(grams, lambda g: F.xxhash64(g))
    return texts.select("chunk", "country", "copies", hashes.alias("gram")).mapInArrow(lambda batches: _asked(counts(batches)), _ASKED)


def _asked(batches):
    """(country, bucket, chunk, gram, df, cf) of rows of chunks that are together: a chunk's distinct grams by country and high bits."""
    chunk, held = None, []

    def over():
        countries = [x for b in held for x in b.column("country").to_pylist()]
        names = sorted(set(countries))
        code = np.searchsorted(np.array(names, dtype=object), np.array(countries, dtype=object))
        copies = np.concatenate([b.column("copies").to_numpy() for b in held])
        parts, at = [], 0
        for b in held:
            gram, row = _flat(b.column("gram"))
            parts.append((gram, row + at, b.column("tf").flatten().to_numpy()))
            at += b.num_rows
        gram, row, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((gram, code[row]))
        gram, of, copies, tf = gram[order], code[row][order], copies[row][order], tf[order]
        first = _starts(of, gram)
        if not len(first):
            return
        df, cf, gram, of = np.add.reduceat(copies, first), np.add.reduceat(copies * tf, first), gram[first], of[first]
        cut = _starts(of, gram >> _BITS)
        ends = np.append(cut, len(gram))
        country = pa.array([names[i] for i in of[cut]], pa.string())
        columns = [country, pa.array((gram[cut] >> _BITS).astype(np.int32)), pa.array(np.full(len(cut), chunk)), *(_lists(x, ends) for x in (gram, df, cf))]
        yield pa.RecordBatch.from_arrays(columns, names=["country", "bucket", "chunk", "gram", "df", "cf"])

    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        cuts = _starts(chunks)
        for a, b in zip(cuts, [*cuts[1:], len(chunks)], strict=True):
            if held and chunks[a] != chunk:
                yield from over()
                held.clear()
            chunk = chunks[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield from over()


def asked(kept: DataFrame) -> DataFrame:
    """The distinct grams of each chunk of counted(), for frequencies()."""
    return kept.mapInArrow(_asked, _ASKED)


def frequencies(asked: DataFrame, sizes: DataFrame, min_df: int, max_df: float, once: bool = False, pack: bool = False) -> DataFrame:
    """(chunk, country, gram, df, cf, n): what the vocabulary keeps of the grams of each chunk, or if once, each gram for one
    of the chunks alone. sizes has (country, n); the frequencies of a gram are the sums over all chunks. If pack, (chunk, country, bucket, terms,
    found, n): of so many kept grams of a row of asked, as
    packed() makes it, their codes, steps of places in the row, and df. Codes number the grams of a country in their order."""

    def run(batches):
        key, held = None, []

        def over():
            gram, row = (np.concatenate(x) for x in zip(*((g, np.full(len(g), i)) for i, (_, g, *_) in enumerate(held)), strict=True))
            order = np.lexsort((row, gram))
            first = _starts(gram[order])
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(gram))))
            df, cf = (np.add.reduceat(np.concatenate([h[i] for h in held])[order], first) for i in (2, 3))
            good = (df > 0) & (df >= min_df) & (df <= max_df * key[2])
            code = (key[1] + (1 << (63 - _BITS)) << _PLACE) + np.cumsum(good) - 1
            pick = good[of]
            if once:
                pick &= np.isin(np.arange(len(of)), first)
            place, of = order[pick], of[pick]
            back = np.argsort(place, kind="stable")
            place, of = place[back], of[back]
            ends = np.searchsorted(row[place], np.arange(len(held) + 1))
            n = len(held)
            if pack:
                begins = np.cumsum([0, *(len(h[1]) for h in held)])
                told = [packed(code[of[i:j]], np.diff(place[i:j] - begins[r], prepend=0), df[of[i:j]]) for r, (i, j) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False))]
                columns = [pa.array([h[0] for h in held], pa.int64()), pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int32()), pa.array(np.diff(ends), pa.int32()), pa.array(told, pa.binary()), pa.array(np.full(n, key[2]))]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "country", "bucket", "terms", "found", "n"])
                return
            columns = [pa.array([h[0] for h in held], pa.int64()), pa.array([key[0]] * n, pa.string()), *(_lists(x, ends) for x in (gram[place], df[of], cf[of])), pa.array(np.full(n, key[2]))]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "country", "gram", "df", "cf", "n"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("country", "bucket", "n")), strict=True)
            lists = [batch.column(c) for c in ("gram", "df", "cf")]
            for i, (k, chunk) in enumerate(zip(keys, batch.column("chunk").to_pylist(), strict=True)):
                if held and k != key:
                    yield from over()
                    held.clear()
                key = k
                held.append((chunk, *(x[i].values.to_numpy() for x in lists)))
        if held:
            yield from over()

    rows = asked.join(F.broadcast(sizes), "country").repartition("country", "bucket").sortWithinPartitions("country", "bucket")
    if pack:
        return rows.mapInArrow(run, "chunk long, country string, bucket int, terms int, found binary, n long").where("terms > 0")
    return rows.mapInArrow(run, "chunk long, country string, gram array<long>, df array<long>, cf array<long>, n long").where(F.size("gram") > 0)


def weights(tf: np.ndarray, df: np.ndarray, n, row: np.ndarray, rows: int, sublinear: bool) -> np.ndarray:
    """The weights of grams at unit length of each row: of n records df have the gram, and the row has it tf times."""
    weight = (1 + np.log(tf) if sublinear else tf) * (np.log((1 + n) / (1 + df)) + 1)
    return weight / np.sqrt(np.bincount(row, weight * weight, rows))[row]


def packed(code: np.ndarray, tf: np.ndarray, df: np.ndarray) -> bytes:
    """The grams of a text, in rising order of their codes, in few bytes: steps of codes, tf and df, byte by byte of all grams."""
    rows = np.array([np.diff(code, prepend=0), tf, df], dtype="<i8")
    return pa.compress(rows.view(np.uint8).reshape(3, len(code), 8).transpose(0, 2, 1).tobytes(), "zstd", asbytes=True)


def _unpack(vectors: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Three rows: what packed() was given, one after another."""
    flat = np.empty((3, sizes.sum()), dtype=np.int64)
    for vector, size, end in zip(vectors, sizes.tolist(), np.cumsum(sizes).tolist(), strict=True):
        raw = np.frombuffer(pa.decompress(vector, 24 * size, "zstd"), dtype=np.uint8)
        flat[:, end - size : end] = np.ascontiguousarray(raw.reshape(3, 8, size).transpose(0, 2, 1)).view("<i8")[:, :, 0]
        np.cumsum(flat[0, end - size : end], out=flat[0, end - size : end])
    return flat


def unpacked(vectors: list[bytes], sizes: np.ndarray, n: np.ndarray, sublinear: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of what packed() made of texts of so many grams."""
    code, tf, df = _unpack(vectors, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return code, weights(tf, df, n[row], row, len(sizes), sublinear)


def unit_arrays(kept: DataFrame, found: DataFrame, name: str, sublinear: bool) -> DataFrame:
    """(country, name, vector): arrays of (gram, weight) at unit length of the texts of counted(), with what frequencies() gave for
    their chunks; texts without any gram of the vocabulary have no row."""
    none = F.lit(None).cast("string")
    rows = found.select("chunk", F.lit(0).alias("kind"), "country", none.alias(name), "gram", F.col("df").alias("x"), "n")
    rows = rows.unionByName(kept.select("chunk", F.lit(1).alias("kind"), "country", name, "gram", F.col("tf").alias("x"), F.lit(0).cast("long").alias("n")))

    def run(batches):
        chunk, told, ready = None, {}, {}

        def lookup(country):
            if country not in ready:
                found = [np.concatenate(x) for x in zip(*told[country], strict=True)] if country in told else [np.zeros(0, dtype=np.int64)] * 3
                order = np.argsort(found[0])
                ready[country] = [x[order] for x in found]
            return ready[country]

        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "country")), strict=True))
            cuts = [i for i in range(len(marks)) if not i or marks[i] != marks[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(marks)], strict=True):
                part = batch.slice(a, b - a)
                if marks[a][0] != chunk:
                    chunk = marks[a][0]
                    told.clear()
                    ready.clear()
                country = marks[a][2]
                gram, row = _flat(part.column("gram"))
                x = part.column("x").flatten().to_numpy()
                if marks[a][1] == 0:
                    told.setdefault(country, []).append((gram, x, part.column("n").to_numpy()[row]))
                    continue
                known, df, n = lookup(country)
                at = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
                there = known[at] == gram if len(known) else np.zeros(len(gram), dtype=bool)
                row, at, x = row[there], at[there], x[there]
                weight = weights(x, df[at], n[at], row, part.num_rows, sublinear)
                full = np.flatnonzero(np.bincount(row, minlength=part.num_rows))
                ends = np.append(np.searchsorted(row, full), len(row)).astype(np.int32)
                vector = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(known[at]), pa.array(weight)], names=["gram", "weight"]))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(full)) for c in ("country", name)), vector], names=["country", name, "vector"])

    return rows.repartition("chunk").sortWithinPartitions("chunk", "kind", "country").mapInArrow(run, f"country string, {name} string, vector array<struct<gram:bigint,weight:double>>")


def packed_units(texts: DataFrame, grams, found: DataFrame, name: str) -> DataFrame:
    """(country, name, vector, terms, n) of chunked() texts, with what frequencies() packed for their chunks: vectors as packed() makes
    them, how many grams they have, and of how many records their frequencies are; texts without any gram of the vocabulary have
    no row. The grams are made again from the texts, as these are shorter than their grams; grams maps a column to an array."""
    none = F.lit(None)
    rows = found.select("chunk", "country", F.lit(0).alias("kind"), none.cast("string").alias(name), "bucket", "terms", "found", "n", none.cast("string").alias("text"))
    blank = [none.cast(t).alias(c) for c, t in (("bucket", "int"), ("terms", "int"), ("found", "binary"), ("n", "long"))]
    rows = rows.unionByName(texts.select("chunk", "country", F.lit(1).alias("kind"), name, *blank, "text"))
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk", "country", "kind")
    hashes = F.when(F.col("kind") == 1, F.transform(grams, lambda g: F.xxhash64(g)))
    out = ["country", name, "vector", "terms", "n"]

    def run(batches):
        key, told, held = None, [], []

        def over():
            """The vectors of the texts of a chunk and country."""
            if not told or not held:
                return
            gram, tf = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            known, at = np.unique(gram, return_inverse=True)
            df, code = np.zeros(len(known), dtype=np.int64), np.zeros(len(known), dtype=np.int64)
            for bucket, terms, found, _ in told:
                codes, steps, dfs = _unpack([found], np.array([terms]))
                place = np.searchsorted(known, bucket << _BITS) + np.cumsum(steps)
                code[place], df[place] = codes, dfs
            done = 0
            for names, _, _, ends in held:
                own, times = at[done : done + ends[-1]], tf[done : done + ends[-1]]
                done += ends[-1]
                there = df[own] > 0
                row = np.repeat(np.arange(len(names)), np.diff(ends))[there]
                own, times, cuts = own[there], times[there], np.searchsorted(row, np.arange(len(names) + 1)).tolist()
                full = np.flatnonzero(np.diff(cuts))
                vectors = [packed(code[own[cuts[i] : cuts[i + 1]]], times[cuts[i] : cuts[i + 1]], df[own[cuts[i] : cuts[i + 1]]]) for i in full.tolist()]
                sizes = np.diff(cuts)[full].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(full), pa.string()), names.take(pa.array(full)), pa.array(vectors, pa.binary()), pa.array(sizes), pa.array(np.full(len(full), told[0][3], dtype=np.int64))], names=out)

        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("chunk", "country", "kind")), strict=True))
            cuts = [i for i in range(len(marks)) if not i or marks[i] != marks[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(marks)], strict=True):
                part = batch.slice(a, b - a)
                if marks[a][:2] != key:
                    yield from over()
                    key = marks[a][:2]
                    told.clear()
                    held.clear()
                if marks[a][2] == 0:
                    told.extend(zip(*(part.column(c).to_pylist() for c in ("bucket", "terms", "found", "n")), strict=True))
                else:
                    held.append((part.column(name), *_text_grams(*_flat(part.column("gram")), part.num_rows)))
        yield from over()

    made = dealt.select("chunk", "country", "kind", name, "bucket", "terms", "found", "n", hashes.alias("gram"))
    return made.mapInArrow(run, f"country string, {name} string, vector binary, terms int, n long")


#: Records of a chunk of gram_vocabulary(), on average.
RECORDS = 8192


def _summed(batches):
    """The rows of _asked() of rows (chunk, country, id, gram) sorted by these, with grams as often as a record has them; rows of
    one id are one record."""
    chunk, held, record, last = None, [], 0, None

    def over():
        gram, country, row = (np.concatenate(x) for x in zip(*held, strict=True))
        names = sorted(set(country.tolist()))
        code = np.searchsorted(np.array(names, dtype=object), country)
        order = np.lexsort((row, gram, code))
        gram, code, row = gram[order], code[order], row[order]
        first = _starts(code, gram)
        if not len(first):
            return
        new = np.zeros(len(gram), dtype=np.int64)
        new[_starts(code, gram, row)] = 1
        df, cf = np.add.reduceat(new, first), np.diff(np.append(first, len(gram)))
        gram, code = gram[first], code[first]
        cut = _starts(code, gram >> _BITS)
        ends = np.append(cut, len(gram))
        columns = [pa.array([names[i] for i in code[cut]], pa.string()), pa.array((gram[cut] >> _BITS).astype(np.int32)), pa.array(np.full(len(cut), chunk)), *(_lists(x, ends) for x in (gram, df, cf))]
        yield pa.RecordBatch.from_arrays(columns, names=["country", "bucket", "chunk", "gram", "df", "cf"])

    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        marks = list(zip(*(batch.column(c).to_pylist() for c in ("country", "id")), strict=True))
        cuts = _starts(chunks)
        for a, b in zip(cuts, [*cuts[1:], len(chunks)], strict=True):
            if held and chunks[a] != chunk:
                yield from over()
                held.clear()
            if chunks[a] != chunk:
                chunk, last = chunks[a], None
            numbers = np.zeros(b - a, dtype=np.int64)
            for i in range(a, b):
                record += marks[i] != last
                numbers[i - a], last = record, marks[i]
            gram, row = _flat(batch.column("gram").slice(a, b - a))
            held.append((gram, np.array([c for c, _ in marks[a:b]], dtype=object)[row], numbers[row]))
    if held:
        yield from over()


def _spelt(batches):
    """(country, gram, df, cf, n) with the gram itself, of rows (chunk, kind, country, hash, gram, df, cf, n) sorted by the first
    three: those of kind 0 ask for hashes, of kind 1 have the grams of a text with their hashes."""
    chunk, told = None, {}
    for batch in batches:
        marks = list(zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "country")), strict=True))
        cuts = [i for i in range(len(marks)) if not i or marks[i] != marks[i - 1]]
        for a, b in zip(cuts, [*cuts[1:], len(marks)], strict=True):
            part = batch.slice(a, b - a)
            if marks[a][0] != chunk:
                chunk = marks[a][0]
                told.clear()
            country = marks[a][2]
            found, row = _flat(part.column("hash"))
            if marks[a][1] == 0:
                new = [found, *(part.column(c).flatten().to_numpy() for c in ("df", "cf")), part.column("n").to_numpy()[row]]
                new = [np.concatenate(x) for x in zip(told[country], new, strict=True)] if country in told else new
                order = np.argsort(new[0])
                told[country] = [x[order] for x in new]
                continue
            if country not in told or not len(told[country][0]):
                continue
            wanted = told[country]
            at = np.minimum(np.searchsorted(wanted[0], found), len(wanted[0]) - 1)
            there = np.flatnonzero(wanted[0][at] == found)
            which, first = np.unique(at[there], return_index=True)
            if len(which):
                gram = part.column("gram").flatten().take(pa.array(there[first]))
                yield pa.RecordBatch.from_arrays([pa.array([country] * len(which), pa.string()), gram, *(pa.array(x[which]) for x in wanted[1:])], names=["country", "gram", "df", "cf", "n"])
                told[country] = [np.delete(x, which) for x in wanted]


def gram_vocabulary(texts: DataFrame, grams, sizes: DataFrame, min_df: int, max_df: float) -> DataFrame:
    """(country, gram, df, cf, n): the grams of (country, id, text) that so many records have; grams maps a column to an array.
    Grams are counted as 64-bit hashes; one of the chunks that have a kept gram tells its letters. So a text is shuffled twice, a
    distinct gram of a chunk once as some bytes, and only grams that are kept come out as text."""
    chunks = max(1, -(-texts.count() // RECORDS))
    rows = texts.where("country is not null").select(F.pmod(F.xxhash64("country", "id"), F.lit(chunks)).cast("long").alias("chunk"), "country", "id", "text")
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk", "country", "id")
    hashes = F.transform(grams(F.col("text")), lambda g: F.xxhash64(g))
    found = frequencies(dealt.select("chunk", "country", "id", hashes.alias("gram")).mapInArrow(_summed, _ASKED), sizes, min_df, max_df, once=True)
    none, empty = F.lit(None), F.array().cast("array<long>")
    asks = found.select("chunk", F.lit(0).alias("kind"), "country", none.cast("string").alias("text"), F.col("gram").alias("hash"), "df", "cf", "n")
    have = rows.select("chunk", F.lit(1).alias("kind"), "country", "text", empty.alias("hash"), empty.alias("df"), empty.alias("cf"), F.lit(0).cast("long").alias("n"))
    met = asks.unionByName(have).repartition("chunk").sortWithinPartitions("chunk", "kind", "country")
    met = met.withColumn("gram", F.when(F.col("kind") == 1, grams(F.col("text"))))
    own = F.when(F.col("kind") == 0, F.col("hash")).otherwise(F.transform("gram", lambda g: F.xxhash64(g)))
    told = met.select("chunk", "kind", "country", own.alias("hash"), "gram", "df", "cf", "n")
    return told.mapInArrow(_spelt, "country string, gram string, df long, cf long, n long")
