"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.  A stage sets the session to small
batches for Python workers, so that executors need no more for long texts.
"""

from __future__ import annotations

import functools
import os
import sys
import uuid


_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from lexstrata.llm.common import in_small_batches, shared_dir  # noqa: E402
from lexstrata.llm.exact_dedup import drop_exact_duplicates, drop_repeated_rows  # noqa: E402
from lexstrata.llm.jaccard_join import keep_one_of_each_group  # noqa: E402
from lexstrata.llm.language import keep_identified  # noqa: E402
from lexstrata.llm.packing import pack, with_checksums  # noqa: E402
from lexstrata.llm.suffix_dedup import replace_texts  # noqa: E402

#: Passages of over 50 words that stand elsewhere too leave the texts.
PASSAGE_WORDS = 51
#: A source's share of a window grows as this power of its tokens.
MIXTURE_POWER = 0.7


def small_batches(stage):
    """A stage whose Python workers get texts by bytes, not by rows."""

    @functools.wraps(stage)
    def bounded(spark, docs, sf_dir):
        in_small_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@small_batches
def language_id(spark, docs, sf_dir):
    """Rows whose text has no letter, or is like no language, go."""
    return keep_identified(docs)


@small_batches
def exact_dedup(spark, docs, sf_dir):
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_duplicates(docs)


@small_batches
def near_dedup(spark, docs, sf_dir):
    """Of each group linked by five-word shingles at a similarity of 0.8 the smallest doc_id stays, with one row of a text.

    Rows that repeat a doc_id with its text have one decision in the exact
    stage; here all but one of them go.
    """
    return keep_one_of_each_group(drop_repeated_rows(docs), words=5, share=(80, 100))


@small_batches
def substring_dedup(spark, docs, sf_dir):
    """Runs of 51 words, and strings of 400 bytes, that start anywhere else too leave the texts; every row stays."""
    return replace_texts(docs, words=PASSAGE_WORDS)


@small_batches
def packing(spark, docs, sf_dir):
    """Windows of 4096 tokens, with more of small sources than the corpus has as long as they last."""
    return with_checksums(pack(docs, power=MIXTURE_POWER, shared=True))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Neither the language profiles nor the tokenizer can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for at, (name, stage) in enumerate(STAGES):
        path = f"{base}/{at}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
