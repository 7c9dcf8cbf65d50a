"""Streaming queries against a static index of unit postings: an addition, the batch operators define the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.similarity import sparse_pairs
from ..operators.tfidf import TfIdf, term_frequencies, unit_postings
from ..operators.topk import top_k


def match_stream(queries: DataFrame, vocab: DataFrame, postings: DataFrame, grams: Column, sink, config: TfIdf = TfIdf(), k: int = 30, floor: float = 0.1):
    """Starts a stream of (country, id, text) records; each micro-batch is vectorised with the index's vocabulary, joined with
    its postings and handed to sink(pairs, batch id)."""

    def one(batch: DataFrame, number: int) -> None:
        asked = unit_postings(term_frequencies(batch, grams), vocab, config)
        sink(top_k(sparse_pairs(asked, postings, floor), k), number)

    return queries.writeStream.foreachBatch(one)


def rate_of(pairs: DataFrame) -> DataFrame:
    """Queries and pairs of a micro-batch."""
    return pairs.agg(F.count_distinct("source1_entity_id").alias("queries"), F.count("*").alias("pairs"))
