"""Every query against its SQL twin, on the smallest tables where they are given."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexstrata.plans import registry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = (
    "txt04_line_elements", "txt10_term_mapping", "src02_csv_documents", "src05_table_records", "str05_clauses", "str09_outline_paths", "qlt03_duplicate_groups",
    "qlt11_signal_upsert", "ret02_exact_top_k", "ret16_tree_paths", "pst05_coverage_top_up", "evl04_compound_metrics", "agg07_quality_trend", "cnv08_trim_candidates",
    "ret17_ambiguous_by_question", "cnv12_pointer_ends", "agg15_rolling_sketches", "str01_metadata", "str02_section_filter", "str04_chinese_lines", "txt11_sub_questions", "txt19_anchor_terms", "snk01_replace_artefacts", "snk06_reindex", "pst02_fusion",
    "ret05_bm25_top_k", "ret06_dictionary_words", "ret13_intent_scores", "evl03_basic_metrics", "evl05_report", "cnv04_between_summaries", "qlt06_coverage_by_spans", "evl12_criterion_verdicts", "cnv17_extraction_state", "stm04_base_cleanup", "qlt09_enumeration_gaps",
    "cnv14_evictions", "sel07_condition_tree", "aud01_json_changes", "stm01_feedback_state", "flagship_cited_evidence",
)


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return repr(v) if isinstance(v, float) else str(v)


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = registry.queries()[name](spark, FOLDER)
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
