"""Cost-balanced packing of tokenised documents into training sequences.

Every task packs the documents of its own partition, so there is no shuffle: documents are tokenised, cut into whole sequences
where they are longer than one, and their rests are dealt in descending length to the sequence that costs least so far among
those with room. A piece costs a linear share for its tokens and a quadratic one for the attention inside it. What fills no
whole sequence is carried to the task's next block, and at the end it becomes sequences whose lengths are powers of two, which
need no padding.

Defined cases: a null or empty text has only the end id; a document of any length is cut freely, each id lies in exactly one
piece; repeated rows and repeated ids of documents are packed as often as they occur; a null doc_id stays null; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import wordbpe
from .common import batches_of, small_batches, table

CAPACITY = 4096
END_ID = 2
#: A task packs about so many tokens at a time; bounds its memory and the cost of finding the cheapest sequence.
BLOCK_TOKENS = 2_000_000
#: Cost of a piece of n tokens: n * LINEAR + n * n * QUADRATIC. The ratio is that of a decoder layer's dense products to its
#: attention products at a width of 4096 (12 width^2 n against 2 width n^2).
LINEAR, QUADRATIC = 1.0, 1.0 / 24576
#: Sequences of one partition are numbered from its number times this.
_PARTITION_STEP = 1 << 33

FIELDS = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("sequence_cost", pa.float64()),
]
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"

#: A run of a document's ids that isn't placed yet: (doc_id, start, ids, doc_tokens).
Piece = tuple[int | None, int, np.ndarray, int]


def cost(tokens):
    return tokens * LINEAR + tokens * tokens * QUADRATIC


def balance(pieces: list[Piece], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Whole sequences made of pieces shorter than the capacity, and the pieces that fill none."""
    count = sum(len(p[2]) for p in pieces) // capacity
    if not count:
        return [], pieces
    room, spent = np.full(count, capacity), np.zeros(count)
    out: list[list[Piece]] = [[] for _ in range(count)]
    rest: list[Piece] = []
    left = count * capacity
    for piece in sorted(pieces, key=lambda p: -len(p[2])):
        while len(piece[2]) and left:
            n = len(piece[2])
            fits = room >= n
            k = int(np.where(fits if fits.any() else room > 0, spent, np.inf).argmin())
            take = min(n, int(room[k]))
            out[k].append((piece[0], piece[1], piece[2][:take], piece[3]))
            room[k] -= take
            left -= take
            spent[k] += cost(take)
            piece = (piece[0], piece[1] + take, piece[2][take:], piece[3])
        if len(piece[2]):
            rest.append(piece)
    return out, rest


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Sequences whose lengths are the powers of two that sum to what is left, largest first."""
    left = sum(len(p[2]) for p in pieces)
    queue = list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        sequence = []
        while room:
            doc, start, ids, total = queue.pop()
            sequence.append((doc, start, ids[:room], total))
            if len(ids) > room:
                queue.append((doc, start + room, ids[room:], total))
            room -= len(sequence[-1][2])
        yield sequence


def pack_documents(documents: Iterator[tuple[int | None, np.ndarray]], capacity: int = CAPACITY, block: int = BLOCK_TOKENS) -> Iterator[list[Piece]]:
    """Sequences of pieces, from (doc_id, ids) in any number."""
    held: list[Piece] = []
    tokens = 0
    for doc, ids in documents:
        n = len(ids)
        whole = n - n % capacity
        for start in range(0, whole, capacity):
            yield [(doc, start, ids[start : start + capacity], n)]
        if whole < n:
            held.append((doc, whole, ids[whole:], n))
            tokens += n - whole
        if tokens >= block:
            full, held = balance(held, capacity)
            yield from full
            tokens = sum(len(p[2]) for p in held)
    full, held = balance(held, capacity)
    yield from full
    yield from powers_of_two(held)


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of a document: where it lies in its document and in its sequence, and the checksum of its ids;
    with_ids adds the ids themselves. docs has doc_id and text."""
    small_batches(docs.sparkSession)
    schema = pa.schema(FIELDS + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def documents(batches):
        encoder = wordbpe.loaded(tokenizer)
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield doc, np.concatenate([encoder.encode(text.as_py() or ""), end])

    def rows(batches):
        number = TaskContext.get().partitionId() * _PARTITION_STEP
        for sequence in pack_documents(documents(batches), capacity):
            at, spent = 0, sum(cost(len(p[2])) for p in sequence)
            for doc, start, ids, total in sequence:
                row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), total, number, at, spent)
                yield (*row, ids.astype(np.int32)) if with_ids else row
                at += len(ids)
            number += 1

    def run(batches):
        return batches_of(rows(batches), schema, 1024)

    return docs.select("doc_id", "text").mapInArrow(run, _DDL + ", ids array<int>" * with_ids)


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
