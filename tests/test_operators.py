import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import chunking, conversations, evaluation, quality, ranking, selection, structure, vectors
from lexstrata.sources import parsers, sinks, tables
from lexstrata.streaming import feedback


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_csv_rules():
    header, body = parsers.csv_table('﻿a,b,c\r\n\r\n1,"x, ""y""",3\r\n2,"line\nfeed"\r\n')
    assert header == ["a", "b", "c"]
    assert body == [["1", 'x, "y"', "3"], ["2", "line\nfeed", ""]]


def test_markdown_kinds():
    found = parsers.markdown_blocks("# T\n\npara\nmore\n\n- a\n- b\n\n1. x\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n```py\ncode\n```\n\n![alt](u.png)\n\n    indented\n\n<table><tr><td>1</td></tr></table>")
    assert [b["kind"] for b in found] == ["heading", "paragraph", "list", "list", "table", "code", "image", "code", "html_table"]
    assert found[3]["ordered"] and not found[2]["ordered"] and found[4]["rows"] == [["1", "2"]]


def test_chunks_keep_outline_and_budget(spark):
    body = "# A\n\nintro:\n\n" + "\n".join(f"- item {i}" for i in range(200)) + "\n\n## B\n\n" + "word " * 1500
    docs = spark.createDataFrame([(1, body), (2, ""), (3, None)], "doc_id long, text string")
    chunks = chunking.chunk_documents(docs).orderBy("chunk_index").collect()
    budget = chunking.Budget()
    assert {c["doc_id"] for c in chunks} == {1}
    assert all(c["content"].strip() and len(c["content"]) <= budget.tolerance for c in chunks)
    assert chunks[0]["outline"] == ["A"] and chunks[-1]["outline"] == ["A", "B"]


def test_outline_column_matches_function(spark):
    df = spark.createDataFrame([(["a", "b"], "has b"), (["a", "b"], "a"), (["a"], "none")], "o array<string>, t string")
    got = [r["x"] for r in df.select(chunking.embedding_text(F.col("o"), F.col("t")).alias("x")).collect()]
    assert got == [chunking.with_outline(["a", "b"], "has b"), chunking.with_outline(["a", "b"], "a"), chunking.with_outline(["a"], "none")]


def test_embedding_contract(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "id long, t string")
    with pytest.raises(Exception, match="another count or dimension"):
        chunking.embedded(df, ["id"], "t", model=lambda texts: [[1.0]] * len(texts)).collect()
    assert {len(r["embedding"]) for r in chunking.embedded(df, ["id"], "t").collect()} == {64}


def test_clauses_open_and_close(spark):
    lines = ["Chapter 1 Scope", "1.1.1 First", "(1) item", "plain", "Section 2 More", "lost", "1.2.1 Second", "Commentary", "1.3.1 Third"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_index long, line string")
    found = structure.clauses(structure.classified(df))
    assert rows(found.select("clause_no", "chapter_no", "section_no", "role", "n_lines", "n_items"), "clause_no") == [
        ("1.1.1", "Chapter 1", None, "NORMATIVE", 3, 1),
        ("1.2.1", "Chapter 1", "Section 2", "NORMATIVE", 1, 0),
        ("1.3.1", "Chapter 1", "Section 2", "COMMENTARY", 1, 0),
    ]


REGULATION = (
    "第一章 总则", "第二章", "第三节 范围", "第十二条 应当登记。", "第四条", "1.1.1 应当登记。", "1.2 基本规定", "1.3 应当检查", "1.4", "3.2.1.4 细则。", "A.1.2 附表不得遗失。", "1.1.1～1.1.3 说明。", "1.1.4-1.1.5",
    "5 检查", "120 检查", "7 应当检查", "8 一个很长的标题一个很长的标题一个很长的标题", "6检查要求", "6必须检查", "（一）项目", "二、项目", "3）数字项", "(4) 项目", "5. 项目", "附录", "附录A 表格", "附录 二 记录", "条文说明", "条文解释",
    "本规范用词说明", "普通文字", "封面", "12项。", "", "第三条文字说明",
)


def walked(lines):
    """Line by line with the state of one document: kind, number, whether a clause is open, region."""
    cn, dec = "[一二三四五六七八九十百零〇两]+", r"(?:[A-Za-z]\.)?\d+(?:\.\d+){1,4}"
    rule = lambda x: any(v in x for v in ("应当", "应 ", "必须", "不得", "宜 ")) or x.startswith(("应", "为在", "为加强", "为规范"))
    title = lambda x, n: 0 < len(x) <= n and not re.search("[。！？；;:]$", x) and not rule(x)
    opened, region, out = False, "FRONT_MATTER", []

    def boundary(any_region=True):
        return "NORMATIVE" if region == "FRONT_MATTER" or (any_region and region == "APPENDIX") else region

    for line in lines:
        kind, number, m = "text", None, None
        if re.fullmatch("本(?:标准|规范|规程)用词说明", line):
            kind, number, opened, region = "role", line, False, "SUPPLEMENTARY"
        elif line in ("条文说明", "条文解释"):
            kind, number, opened, region = "role", line, False, "COMMENTARY"
        elif m := re.fullmatch(rf"(附录\s*(?:[A-Za-z]|{cn})?)\s*(.*)", line):
            kind, number, opened, region = "appendix", m[1].strip(), False, "APPENDIX"
        elif m := re.fullmatch(f"(第{cn}[章节])\\s*(.*)", line):
            kind, number, opened, region = "chapter" if "章" in m[1] else "section", m[1], False, boundary()
        elif m := re.fullmatch(f"(第{cn}条)\\s*(.*)", line):
            kind, number, opened, region = "article", m[1], True, boundary(False)
        elif (m := re.fullmatch(rf"({dec})\s*[、～~-]\s*({dec})\s*(.*)", line)) or (m := re.fullmatch(rf"({dec})()\s*(.*)", line)):
            levels = m[1].count(".") + 1
            if m[3]:
                number = m[1] + ("~" + m[2] if m[2] else "")
                if not m[2] and levels == 2 and title(m[3], 30):
                    kind, opened, region = "section", False, boundary()
                else:
                    kind, opened, region = "subclause" if levels >= 4 and not m[2] else "clause", True, boundary(False)
        elif m := re.fullmatch(r"(\d{1,3})\s+(.+)", line):
            if title(m[2], 20) and (not opened or len(m[1]) <= 2):
                kind, number, region, opened = "chapter", m[1], boundary(opened), False
            elif opened:
                kind, number = "item", m[1]
        elif not opened and (m := re.fullmatch(r"(\d{1,2})([\u4e00-\u9fff]{1,20})", line)) and title(m[2], 20):
            kind, number, region = "chapter", m[1], boundary(False)
        elif opened and (m := re.fullmatch(rf"([（(]?(?:{cn}[)）、]|\d{{1,3}}[)）、.]))\s*(.*)", line)):
            kind, number = "item", m[1]
        out.append((kind, number, opened and kind not in ("chapter", "section", "appendix", "role"), region))
    return out


def test_regulation_lines_against_a_walk(spark):
    r = random.Random(5)
    docs = [[r.choice(REGULATION) for _ in range(120)] for _ in range(25)] + [list(REGULATION)]
    df = spark.createDataFrame([(d, i, x) for d, lines in enumerate(docs) for i, x in enumerate(lines)], "doc_id long, line_index long, line string")
    found = {}
    for x in structure.classified(df).orderBy("doc_id", "line_index").collect():
        found.setdefault(x["doc_id"], []).append((x["line_type"], x["number"], x["in_clause"], x["region"]))
    for d, lines in enumerate(docs):
        for got, want, line in zip(found[d], walked(lines), lines, strict=True):
            assert got == want, line
    opened = sum(k in ("article", "clause", "subclause") for lines in docs for k, *_ in walked(lines))
    assert structure.clauses(structure.classified(df)).count() == opened


def test_section_filter_keeps_an_uncertain_body(spark):
    kept = lambda lines: [(x["section"], x["kept"]) for x in structure.section_filter(spark.createDataFrame([(1, i, t, h) for i, (t, h) in enumerate(lines)], "doc_id long, line_index long, line string, is_heading boolean")).orderBy("line_index").collect()]
    body, gone = ("BODY", True), lambda s: (s, False)
    assert kept([("2.1 某条", False), ("总则 ..... 3", False), ("文字", False)]) == [body, gone("BODY"), body]
    assert kept([("前言", False), ("文字", False), ("第一章 总则", True)]) == [body] * 3
    assert kept([("前言", True), ("文字", False), ("第一章 总则", True), ("总则 ..... 3", False)]) == [gone("PREFACE")] * 2 + [body] * 2
    assert kept([("目 录", True), ("附录A 表 ..... 9", False), ("附录A 表", True), ("第一条 文字", False), ("附录A 表", True), ("前言", True), ("文字", False)]) == [gone("CHINESE_TOC")] * 3 + [body] + [gone("APPENDIX")] * 3
    assert kept([("CONTENTS", True), ("x ..... 1", False), ("封面", True), ("文字", False)])[2:] == [gone("ENGLISH_TOC")] * 2
    assert kept([("1 范围", True), ("引用标准名录", True), ("GB 1", False), ("本规范用词说明", True), ("词", False)]) == [body] + [gone("REFERENCED_STANDARDS")] * 2 + [gone("TERMINOLOGY_NOTE")] * 2


@pytest.mark.parametrize(
    "raw, want",
    [("GB50011-2010", "GB 50011-2010"), ("gb/t 12345", "GB/T 12345"), ("GBT50012010x", "GB/T 5001-2010"), ("JGJ／T 59—2011", "JGJ/T 59-2011"), ("CJJ T7", "CJJ/T 7"), ("CECS 111111", "CECS 111111"), ("GA 1", "GA 1"), ("none", None), (None, None)],
)
def test_standard_numbers(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(structure.standard_number(F.col("t")).alias("x")).first()["x"] == want


def test_packed_drafts():
    draft = lambda n, path=(), **more: chunking.Draft(more.pop("kind", "paragraph"), tuple(path), "x" * n, "x" * n, **more)
    sizes = lambda drafts, most=100: [len(d.content) for d in chunking.packed_drafts(drafts, chunking.Budget(most))]
    assert sizes([]) == [] and sizes([draft(500)]) == [500]
    head = lambda n=5, *path: draft(n, path, heading=True, kind="heading")
    assert sizes([head(), draft(30), head(), draft(40)]) == [5 + 2 + 30 + 2 + 5 + 2 + 40]  # both sections fit
    assert sizes([head(), draft(60), head(), draft(60)]) == [67, 67]
    assert sizes([draft(10), head(), draft(150)]) == [10 + 2 + 5 + 2 + 150]  # little is held: up to the tolerance
    assert sizes([head(), draft(60), head(), draft(10)]) == [67 + 2 + 17]
    assert sizes([head(), draft(95), draft(10)]) == [5 + 2 + 95 + 2 + 10]  # a section within the tolerance is not cut
    assert sizes([draft(80), draft(80), draft(80), draft(80)]) == [80] * 4
    pieces = [draft(90, piece=True) for _ in range(4)]
    assert sizes([draft(40), *pieces]) == [40 + 2 + 90, 90, 90, 90]  # the lead-in goes with the first piece
    assert sizes([*pieces, draft(10)]) == [90, 90, 90, 90 + 2 + 10]  # a rest of little joins the one before
    merged = chunking.packed_drafts([head(5, "A"), draft(30, "A"), head(5, "A", "B"), draft(30, "AB")], chunking.Budget(100))
    assert [(d.kind, d.outline, d.heading) for d in merged] == [("paragraph", ("A",), True)]


def test_html_tables():
    budget = chunking.Budget(100, rows_per_chunk=2)
    row = "<tr><td>1</td></tr>"
    table = "<table class='c'><tr><th colspan=\"1\" ROWSPAN = '1' colspan=\"12\">h</th></tr>" + row * 5 + "</table>"
    head = "<table class='c'><tr><th colspan=\"12\">h</th></tr>"
    assert chunking.html_table_groups(table, budget) == [head + row * n + "</table>" for n in (2, 2, 1)]
    assert chunking.html_table_groups(table, chunking.Budget(1000, 50)) == [head + row * 5 + "</table>"]
    assert chunking.html_table_groups("<table><tr><td rowspan=1>x</td></tr></table>", budget) == ["<table><tr><td>x</td></tr></table>"]


def test_clause_chunks(spark):
    lines = ["第一章 总则", "第一条 " + "每句十个字应当登记。" * 60, "（一）版本1.2的说明。", "（二）" + "甲" * 500, "第二条 短。"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_index long, line string")
    clauses = structure.clauses(structure.classified(df)).withColumns({"title": F.lit("规范"), "standard_no": F.lit(None).cast("string")})
    found = chunking.clause_chunks(clauses).orderBy("clause_id", "part").collect()
    assert [(x["clause_no"], x["part"], x["n_parts"], x["marks"]) for x in found] == [("第一条", 0, 3, None), ("第一条", 1, 3, "（一）"), ("第一条", 2, 3, "（二）"), ("第二条", 0, 1, None)]
    assert all(x["content"].startswith("《规范》\n第一章 总则 / 第") for x in found)
    assert "（一） 版本1.2的说明。" in found[1]["content"] and found[3]["content"].endswith("第二条\n短。")
    body = "".join(x["content"].split("\n", 2)[2] for x in found[:3]).replace("\n", "")
    assert body == "每句十个字应当登记。" * 60 + "（一） 版本1.2的说明。（二） " + "甲" * 500


def test_gap_detectors(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 5), (2, 3)], "g long, n long")
    assert rows(quality.sequence_gaps(df, ["g"], "n"), "g") == [(1, 5, 3)]
    items = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 4, 4)], "g long, i long, m int")
    assert rows(quality.first_enumeration_gaps(items, ["g"], "i", "m"), "g") == [(1, 4, 4, 3)]


def test_quota(spark):
    cases = [(20, 0.25, True, 2, 5), (1, 0.5, True, 2, 0), (20, 0.01, True, 1, 1), (20, 0.99, True, 1, 19), (20, 0.5, False, 1, 0), (20, 0.5, True, 0, 0), (0, 0.5, True, 1, 0)]
    df = spark.createDataFrame(cases, "b int, r double, d boolean, n int, want int")
    assert all(r["got"] == r["want"] for r in df.select("want", vectors.scope_quota(F.col("b"), F.col("r"), F.col("d"), F.col("n")).alias("got")).collect())


def test_fusion_and_gate(spark):
    hits = spark.createDataFrame([(1, "vector", 1, "a", 0.9), (1, "keyword", 1, "b", 3.0), (1, "keyword", 2, "a", 2.0)], "query_id long, channel string, rank int, key string, score double")
    fused = ranking.fused(hits, {"vector": 1.0, "keyword": 1.0})
    assert [r["key"] for r in fused.orderBy("place").collect()] == ["a", "b"]
    assert rows(ranking.deduplicated(hits).select("key", "channel"), "key") == [("a", "vector"), ("b", "keyword")]
    scored = spark.createDataFrame([(1, 0.1), (1, float("nan")), (2, 0.2), (3, None)], "query_id long, rerank_score double")
    assert sorted({r["query_id"] for r in ranking.evidence_gate(scored).collect()}) == [2, 3]


def test_condition_tree_fails_closed(spark):
    df = spark.createDataFrame([("7", " x "), (None, "y"), ("inf", "z")], "n string, s string")
    run = lambda tree: [r["s"].strip() for r in df.filter(selection.condition(json.dumps(tree) if not isinstance(tree, str) else tree, df.columns)).collect()]
    assert run({"field": "n", "operator": "gte", "value": "7"}) == ["x"]
    assert run({"field": "s", "operator": "eq", "value": "x"}) == ["x"]
    assert run({"not": {"field": "n", "operator": "exists"}}) == ["y"]
    assert run({"not": {"field": "n", "operator": "bogus", "value": 1}}) == []
    assert run({"not": {"field": "n", "operator": "gt", "value": "many"}}) == []
    assert run("{broken") == [] and run({"all": []}) == ["x", "y", "z"] and run({"any": []}) == []


def test_metrics_count_missing_cases(spark):
    cases = spark.createDataFrame([(1, True), (2, True), (3, False)], "case_id long, answerable boolean")
    stages = spark.createDataFrame([(1, "S")], "place int, stage string")
    ranks = spark.createDataFrame([(1, "S", 10, 2)], "case_id long, stage string, chunk_id long, rank int")
    gold = spark.createDataFrame([(1, 10), (2, 20)], "case_id long, chunk_id long")
    r = evaluation.basic_metrics(cases, stages, ranks, gold, ["stage"]).first()
    assert (r["cases"], r["hit_1"], r["hit_5"], r["mrr_5"]) == (2, 0.0, 0.5, 0.25)


def test_history_starts_with_a_question(spark):
    m = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b [1](#cite-1)"), (1, 2, "assistant", "c"), (1, 3, "user", "d")], "conv_id long, turn long, role string, text string")
    assert rows(conversations.prompt_history(m, 1).select("turn", "text"), "turn") == [(3, "d")]
    assert rows(conversations.question_answers(m, 5).select("asked", "answer"), "asked") == [(0, "c")]


def test_feedback_order_does_not_matter(spark):
    schema = "message_id long, user_id long, vote int, submitted long, event_id long"
    events = [(1, 1, 1, 10, 1), (1, 1, None, 20, 2), (1, 1, -1, 15, 3), (2, 1, 3, 5, 4), (2, 2, -1, 5, 5)]
    empty = spark.createDataFrame([], schema)
    want = rows(feedback.latest_feedback(spark.createDataFrame(events, schema)), "message_id", "user_id")
    state = empty
    for e in reversed(events):
        batch = spark.createDataFrame([e], schema)
        state = feedback.merged_feedback(feedback.merged_feedback(state, batch), batch)
    assert rows(state, "message_id", "user_id") == want == [(1, 1, None, 20, 2), (2, 2, -1, 5, 5)]


def test_replacement_and_routing(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, x string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "doc_id long, x string")
    assert rows(sinks.replaced(old, new), "doc_id") == [(1, "a"), (2, "c"), (3, "d")]
    path = str(tmp_path / "table")
    sinks.write_replaced(path, old)
    sinks.write_replaced(path, new)
    sinks.write_replaced(path, new)
    assert rows(spark.read.parquet(path).select("doc_id", "x"), "doc_id") == [(1, "a"), (2, "c"), (3, "d")]
    routes = spark.createDataFrame([("md", "*", "a"), ("md", "legal", "b"), ("csv", "*", "x"), ("csv", "*", "y")], "kind string, profile string, parser string")
    files = spark.createDataFrame([(1, "md", "legal"), (2, "md", "other"), (3, "csv", "q"), (4, "bin", "q")], "id long, kind string, profile string")
    assert [r["parser"] for r in tables.routed(files, routes).orderBy("id").collect()] == ["b", "a", "conflict", "unroutable"]


def test_tables_have_a_row_for_each_word(spark):
    from lexstrata.plans import chunk_plans

    words = [f"w{i}" for i in range(130)]
    docs = spark.createDataFrame([(1, "one\n" + " ".join(words) + "\nthree", "s")], "doc_id long, text string, source string")
    body = chunk_plans._markdown(lambda name: docs).first()["text"]
    assert [f"| {w} | {len(w)} |" for w in words] == [x for x in body.split("\n") if x.startswith("| w") and x[3].isdigit()]


def test_state_survives_replays_and_restarts(spark, tmp_path):
    """A batch that runs twice, and a query that starts again, end in the same state."""
    empty = spark.createDataFrame([], "k long, x string")
    batch = lambda rows: spark.createDataFrame(rows, "k long, x string")
    put = lambda old, new: old.join(new.select("k").distinct(), "k", "left_anti").unionByName(new)
    drop = lambda old, new: old.join(new.select("k").distinct(), "k", "left_anti")
    state = feedback.VersionedState(spark, str(tmp_path / "s"), "k", empty, buckets=3)
    assert rows(state.read(), "k") == []
    state.apply(batch([(1, "a"), (2, "a"), (3, "a")]), 0, put)
    state.apply(batch([(2, "b"), (4, "b")]), 1, put)
    want = [(1, "a"), (2, "b"), (3, "a"), (4, "b")]
    assert rows(state.read(), "k") == want
    again = feedback.VersionedState(spark, str(tmp_path / "s"), "k", empty, buckets=3)  # a new process
    again.apply(batch([(2, "b"), (4, "b")]), 1, put)
    assert rows(again.read(), "k") == want and rows(again.read(before=1), "k") == [(1, "a"), (2, "a"), (3, "a")]
    again.apply(batch([]), 2, put)
    again.apply(batch([(k, "") for k in (1, 2, 3, 4)]), 3, drop)
    assert rows(again.read(), "k") == []
    full = feedback.VersionedState(spark, str(tmp_path / "i"), "k", batch([(1, "i"), (2, "i")]), buckets=64)
    full.apply(batch([(2, "n")]), 0, put)
    assert rows(full.read(), "k") == [(1, "i"), (2, "n")]


def test_feedback_stream_restarts_from_its_checkpoint(spark, tmp_path):
    kinds = "message_id long, user_id long, vote int, submitted timestamp, event_id long"
    send = lambda rows: spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    at = lambda n: datetime.datetime(2024, 1, 1, 0, n)
    schema = spark.createDataFrame([], kinds).schema

    def run():
        state = feedback.VersionedState(spark, str(tmp_path / "state"), "message_id", spark.createDataFrame([], kinds))
        feedback.run_once(feedback.file_stream(spark, str(tmp_path / "in"), schema), lambda b, n: state.apply(b, n, feedback.merged_feedback), str(tmp_path / "ck"))
        return rows(state.read().select("message_id", "vote"), "message_id")

    send([(1, 1, 1, at(1), 1), (2, 1, -1, at(1), 2)])
    assert run() == [(1, 1), (2, -1)]
    send([(1, 1, None, at(5), 3), (3, 1, 1, at(2), 4)])
    send([(1, 1, -1, at(4), 5)])  # older than the cancellation
    assert run() == [(1, None), (2, -1), (3, 1)]
    assert run() == [(1, None), (2, -1), (3, 1)]


def test_keyword_hits_against_a_loop(spark):
    import math

    from lexstrata.operators import keyword

    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(r.choice(vocabulary[: r.randint(2, 30)]) for _ in range(r.randint(0, 40))), r.choice(["w1 w2", "w3", None])) for i in range(80)] + [(100, None, None), (101, "w1", "w1 w1 w1")]
    asked = [(q, " ".join(r.choice([*vocabulary, "none"]) for _ in range(r.randint(0, 6)))) for q in range(12)] + [(50, None)]
    got = keyword.bm25_top_k(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5), {"a": "text", "b": "source"}, {"a": 1.0, "b": 2.0}, 7)
    found = {}
    for x in got.orderBy("query_id", "rank").collect():
        found.setdefault(x["query_id"], []).append((x["doc_id"], x["score"]))
    for q, t in asked:
        best = {}
        for f, boost in ((1, 1.0), (2, 2.0)):
            terms = {d[0]: d[f].split() for d in docs if d[f] is not None}
            mean = sum(map(len, terms.values())) / len(terms)
            for d, ws in terms.items():
                score = 0.0
                for w in set((t or "").split()):
                    n = sum(w in x for x in terms.values())
                    if w in ws:
                        score += math.log(1 + (len(terms) - n + 0.5) / (n + 0.5)) * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                if score:
                    best[d] = max(best.get(d, 0), round(boost * score, 6))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [d for d, _ in found.get(q, [])] == [d for d, _ in want]
        assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(found.get(q, []), want, strict=True))


def test_numbered_blocks_against_a_loop(spark):
    r = random.Random(9)
    docs = [[(r.choice(["clause", "clause", "text", "section"]), f"{r.randint(1, 4)}.{r.randint(1, 3)}.{i}") for i in range(60)] for _ in range(6)]
    df = spark.createDataFrame([(d, i, k, n) for d, lines in enumerate(docs) for i, (k, n) in enumerate(lines)], "doc_id long, line_index long, line_type string, number string")
    got = {(x["doc_id"], x["line_index"]): (x["clause_no"], x["technical"]) for x in structure.numbered_blocks(df, look_ahead=5).collect()}
    for d, lines in enumerate(docs):
        chapter, count = 0, 0
        for i, (k, n) in enumerate(lines):
            head = int(n.split(".")[0]) if k == "clause" else None
            ahead = [int(m.split(".")[0]) for j, m in lines[i + 1 : i + 6] if j == "clause"]
            if head is not None and (head == chapter or (head == chapter + 1 and head in ahead)):
                chapter = head
                assert got[d, i] == (n, False)
            else:
                count += head is not None or count == 0
                assert got[d, i] == (f"T{count}", True)


def test_list_and_code_groups():
    budget = chunking.Budget(50)
    items = [f"item {i} " + "x" * (i % 17) for i in range(60)]
    for ordered in (True, False):
        pieces = chunking.list_groups(items, ordered, budget)
        lines = [f"{i}. {x}" if ordered else f"- {x}" for i, x in enumerate(items, 1)]
        assert "\n".join(pieces).split("\n") == lines and all(len(p) <= 50 for p in pieces)
        at = 0
        for piece, after in zip(pieces, [*pieces[1:], None], strict=True):  # the next line would not have fitted
            at += piece.count("\n") + 1
            assert after is None or len(piece) + 1 + len(lines[at]) > 50
    code = "\n".join(f"line {i}" + "y" * (i % 9) for i in range(80))
    pieces = chunking.code_groups(code, "py", budget)
    assert all(p.startswith("```py\n") and p.endswith("\n```") for p in pieces)
    assert "\n".join(p[6:-4] for p in pieces) == code and len(pieces) > 10
    assert chunking.code_groups("a\nb", None, budget) == ["```\na\nb\n```"]


def test_blocks_and_batches(spark):
    texts = [(i, t) for i, t in enumerate(["# A\n\npara\n\n- x\n- y", None, "", "| a | b |\n| --- | --- |\n| 1 | 2 |", "```\ncode\n```\n\n![i](u)"])]
    blocks = parsers.document_blocks(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    got = {}
    for x in blocks.collect():
        got.setdefault(x["doc_id"], []).append((x["block_index"], x["kind"]))
    assert {d: [k for _, k in sorted(b)] for d, b in got.items()} == {d: [b["kind"] for b in parsers.markdown_blocks(t)] for d, t in texts if t}
    chunks = [(d, i, d % 3 != 0, i % 4 != 1, d == 7) for d in range(12) for i in range(9)]
    df = spark.createDataFrame(chunks, "doc_id long, chunk_index int, index_eligible boolean, enabled boolean, deleted boolean").repartition(5)
    parts = sinks.index_batches(df, 4).withColumn("part", F.spark_partition_id()).collect()
    assert sorted((x["doc_id"], x["chunk_index"]) for x in parts) == sorted((d, i) for d, i, a, b, c in chunks if a and b and not c)
    where = {}
    for x in parts:
        where.setdefault(x["doc_id"], []).append((x["part"], x["chunk_index"]))
    assert all(len({p for p, _ in w}) == 1 and [i for _, i in w] == sorted(i for _, i in w) for w in where.values())
