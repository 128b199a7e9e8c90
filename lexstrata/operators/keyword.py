"""Keyword retrieval in one call, and how much of a query stands in a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.functions.text import words
from lexstrata.operators import keyword_index
from lexstrata.sources.scratch import shared_folder


def bm25_top_k(
    queries: DataFrame,
    docs: DataFrame,
    fields: dict[str, str],
    boosts: dict[str, float],
    k: int = 20,
    id_col: str = "doc_id",
    exact: dict[str, str] | None = None,
    collection_col: str | None = None,
    collections: list[str] | None = None,
) -> DataFrame:
    """Index ``docs`` in a new shared folder and search it once, see ``keyword_index``; who searches again keeps the index."""
    path = keyword_index.build(docs, shared_folder(docs.sparkSession, "keyword-index"), fields, exact, collection_col, id_col)
    hits = keyword_index.search(docs.sparkSession, path, queries, boosts, k, collections)
    return hits.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def term_overlap(query: str, text: str, prior: str | None = None):
    """0.85 * share of the query's words that stand in the text + 0.15 * the prior, cut to 0..1."""
    asked = F.array_distinct(words(F.col(query)))
    # The text stands in a list of one, so that it is lowered once and not for each word.
    found = F.transform(F.array(F.lower(F.col(text))), lambda low: F.size(F.filter(asked, lambda w: F.contains(low, w))))[0]
    share = F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(found / F.size(asked))
    before = F.lit(0.0) if prior is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(prior), F.lit(0.0))))
    return F.round(0.85 * share + 0.15 * before, 6)
