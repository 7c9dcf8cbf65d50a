"""The whole linkage job: normalise, vectorise, retrieve by source, merge, accept, write, measure."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grams import char_wb, word_ngrams
from ..functions.text import norm_legal, norm_library, norm_production, norm_universal
from ..operators import evaluate
from ..operators.similarity import two_pass_top_k
from ..operators.tfidf import TfIdf
from ..operators.topk import accept, id_lists
from ..session import cut_lineage
from ..sources import tsv

NORMALISERS = {
    "library": norm_library,
    "production": norm_production,
    "universal": norm_universal,
    "legal": norm_legal,
    "legal_romanised": lambda name, address: norm_legal(name, address, romanised=True),
}


@dataclass(frozen=True)
class Linkage:
    k: int = 30
    floor: float = 0.2
    tau: float = 0.7
    normaliser: str = "production"
    #: "char" or "word", with the shortest and longest gram.
    grams: tuple[str, int, int] = ("char", 3, 4)
    tfidf: TfIdf = field(default_factory=lambda: TfIdf(min_df=5, max_df=0.05))
    #: Prefix of the ids that fit the vocabulary, or None for all records.
    fit_prefix: str | None = "S2-"
    #: Decimals of a score before it is accepted; None for all.
    score_scale: int | None = None

    def text(self) -> Column:
        return NORMALISERS[self.normaliser](F.col("business_name"), F.col("business_address"))

    def gram_array(self, text: Column) -> Column:
        kind, shortest, longest = self.grams
        return (char_wb if kind == "char" else word_ngrams)(text, shortest, longest)


@dataclass
class Linked:
    reference: DataFrame
    pairs: DataFrame
    accepted: DataFrame

    def matches(self) -> DataFrame:
        return id_lists(self.reference, self.accepted, "matched_entity_ids")

    def candidates(self) -> DataFrame:
        return id_lists(self.reference, self.pairs, "candidate_entity_ids")

    def write(self, folder: str) -> None:
        tsv.write_lists(self.matches(), f"{folder}/matching_results.tsv", "source1_entity_id")
        tsv.write_lists(self.candidates(), f"{folder}/candidate_pairs.tsv", "source1_entity_id")

    def measure(self, truth: DataFrame) -> DataFrame:
        pairs = evaluate.truth_pairs(truth)
        ids = self.reference.select(F.col("entity_id").alias("source1_entity_id"), "country")
        return evaluate.macro_by_country(evaluate.entity_scores(ids, pairs, self.accepted))


def link(reference: DataFrame, sources: list[DataFrame], config: Linkage = Linkage()) -> Linked:
    """Candidates of all sources for each reference record, and those that are accepted."""
    fit_on = None if config.fit_prefix is None else F.col("id").startswith(config.fit_prefix)
    pairs = two_pass_top_k(reference, sources, config.text(), config.gram_array, config.tfidf, config.k, config.floor, fit_on)
    if config.score_scale is not None:
        pairs = pairs.withColumn("similarity_score", F.round("similarity_score", config.score_scale))
    pairs = cut_lineage(pairs)  # for the lists, the acceptance and the measures
    return Linked(reference, pairs, accept(pairs, config.tau))
