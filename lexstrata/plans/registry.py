"""Collects the queries of every family module.

A family module exposes ``QUERIES`` (name -> callable) and ``ORACLES``
(name -> SQL).
"""

from __future__ import annotations

from lexstrata.plans import (
    chunk_plans,
    conversation_plans,
    dashboard_plans,
    evaluation_plans,
    quality_plans,
    ranking_plans,
    retrieval_plans,
    selection_plans,
    source_plans,
    streaming_plans,
    structure_plans,
    text_plans,
)
from lexstrata.plans.base import Tables

FAMILIES = (
    text_plans,
    source_plans,
    structure_plans,
    chunk_plans,
    quality_plans,
    retrieval_plans,
    ranking_plans,
    evaluation_plans,
    dashboard_plans,
    conversation_plans,
    selection_plans,
    streaming_plans,
)


def queries():
    found = {}
    for family in FAMILIES:
        clash = found.keys() & family.QUERIES.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        found.update(family.QUERIES)
    return found


def oracle_sql():
    found = {}
    for family in FAMILIES:
        found.update(family.ORACLES)
    return found


def flagship(spark, sf_dir):
    return ranking_plans.flagship(Tables(spark, sf_dir))
