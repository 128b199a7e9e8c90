"""Patterns of lines, and token counts."""

import re

from pyspark.sql import functions as F

from lexstrata.functions import text
from lexstrata.operators import structure


def test_patterns_that_are_tried_at_the_start_alone_fit_the_same_texts(spark):
    assert all(structure._at_start(getattr(structure.Patterns(), name)) for name in structure.LINE_KINDS)
    others = ["^a|b", "b", "^(a|b)|c", r"^\(a|b\)", "^[|(]a|b", "^*a", "(^a)"]
    assert not any(map(structure._at_start, others))
    texts = ["", "a", "xb", "ab", "第二章 总则", "x 第二章", "1.2.3", "5.1.1～5.1.4 一般", "（一）项", "12 应当", "6检查要求", "附录B 表格", "Chapter 3 of", "条文说明", "1.2 a\nb", "a\n1.2 b", None, "(a", "|b", "(ab"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    for pattern in [*(getattr(structure.Patterns(), name) for name in structure.LINE_KINDS), *others[:-2]]:
        assert rows.filter(~structure.fits(F.col("text"), pattern).eqNullSafe(F.col("text").rlike(pattern))).count() == 0, pattern


def test_a_long_body_is_no_heading(spark):
    rows = spark.createDataFrame([("总则",), ("总则。",), ("应当登记",), ("总" * 31,), ("总" * 30,), ("",), (None,)], "body string")
    assert [r[0] for r in rows.select(structure.like_heading(F.col("body"))).collect()] == [True, False, False, False, True, False, None]


def test_token_counts_of_runs():
    one = re.compile(f"[{text.CJK.encode().decode('unicode_escape')}]")
    for x in ["", "  \n", "abc", "abcde f", "第二章 总则", "ab第二cd章é ü", "é", "、（）", "\U0001f600 a", "カナ한글 x"]:
        solid = "".join(x.split())
        a, c = sum(k < "\x80" for k in solid), len(one.findall(solid))
        assert text.token_count(x) == (max(1, -(-a // 4) + c + -(-(len(solid) - a - c) // 2)) if solid else 0)


def test_a_pattern_is_tried_once_for_a_line(spark):
    rows = spark.createDataFrame([(1, 0, "第一条 总则"), (1, 1, "（一）项")], "doc_id long, line_index long, line string")
    found = structure.classified(rows)
    assert [(r["line_type"], r["number"], r["body"]) for r in found.orderBy("line_index").collect()] == [("article", "第一条", "总则"), ("item", "（一）", "项")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("用词说明") == 3  # to choose the kind, for the number, and for the body
