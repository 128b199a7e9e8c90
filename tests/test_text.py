import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexstrata.functions import splitting, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, tokens", [("", 0), ("  \n", 0), ("abcd", 1), ("abcde", 2), ("火", 1), ("é", 1), ("ab 火火", 3), (None, 0)])
def test_token_estimate(spark, raw, tokens):
    assert one(spark, raw, text.token_estimate) == tokens


def test_cleaning(spark):
    assert one(spark, "﻿a  \nb\n\n\n\nc ", text.cleaned) == "a\nb\n\nc"
    assert one(spark, " a\t\tb　c ", text.whitespace) == "a b c"
    assert one(spark, "1 . 2 . 3 text 4 . 5", text.joined_numbers) == "1.2.3 text 4 . 5"


def test_sentences_and_questions(spark):
    assert one(spark, "一。二！three；", text.sentences) == ["一。", "二！", "three；"]
    assert one(spark, "What is A? And B;\nC", text.split_questions) == ["What is A？", "And B？", "C？"]
    assert one(spark, "脚手架检查时，连墙件和立杆应分别怎样验收？", text.split_questions) == ["脚手架检查时，连墙件应怎样验收？", "脚手架检查时，立杆应怎样验收？"]
    assert one(spark, "现场同时存在积水且临边无防护，应分别怎样处理", text.split_questions) == ["积水应怎样处理？", "临边无防护应怎样处理？"]
    assert one(spark, "工地上，材料分别存放", text.split_questions) == ["工地上，材料分别存放？"]
    assert one(spark, "？；", text.split_questions) == ["？；"] and one(spark, None, text.split_questions) is None


def test_term_mapping_is_idempotent(spark):
    rules = [("fire", "fire safety", 1), ("fire safety exit", "egress", 5)]
    mapped = one(spark, "fire and fire safety exit and fire safety", lambda c: text.mapped_terms(c, rules))
    assert mapped == "fire safety and egress and fire safety"
    assert one(spark, mapped, lambda c: text.mapped_terms(c, rules)) == mapped


def test_json_payload_and_citations(spark):
    assert one(spark, 'Sure:\n```json\n{"a": {"b": 1}}\n```', text.json_payload) == '{"a": {"b": 1}}'
    assert one(spark, "none", text.json_payload) is None
    assert one(spark, 'Here: ["a", "b]"] done', text.json_payload) == '["a", "b]"]'
    assert one(spark, 'Here: ["a", "b]"] done', text.json_list) == ["a", "b]"]
    assert one(spark, '{"a": ["b"]}', text.json_list) == one(spark, "no", text.json_list) == one(spark, None, text.json_list) == []
    assert one(spark, "Yes [1](#cite-1), no [12](#cite-12).", text.without_citations) == "Yes, no."


def test_nfkc_against_unicodedata(spark):
    raw = ["ｆｕｌｌ　１２", "ﬁ ½ ①", "e\u0301", "\ufeffx", "", None, "㎏ ㍿ ｶﾞ"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, t string").select("i", text.nfkc("t").alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [None if x is None else unicodedata.normalize("NFKC", x).replace("\ufeff", "") for x in raw]


def test_words_mix_scripts(spark):
    assert one(spark, "Rule 12 消防法 x", text.words) == ["rule", "12", "x", "消防", "防法"]


def test_soft_breaks():
    join = splitting.join_soft_breaks
    assert join("消防\r\n安全\n- 项") == "消防安全\n- 项"
    assert join("消防，\n安全") == "消防，\n安全" and join("消防\n\n安全") == "消防\n\n安全" and join("ＡＢ\n１") == "ＡＢ１"
    assert join("见 https://a.b/c/\nd/e.html\nnext") == "见 https://a.b/c/d/e.html\nnext"
    assert join("https://a.b/c\n/d?x=\n 1") == "https://a.b/c/d?x=1"
    assert join("https://a.\nb c") == "https://a.b c" and join("https://a.\n1 c") == "https://a.\n1 c"
    assert join("https://a/\n\nb") == "https://a/\n\nb" and join("https://a/\n 2. b") == "https://a/\n 2. b"
    assert join("a/\nb") == "a/\nb" and join("") == ""


def slow_pieces(text, most, overlap):
    """The rule character by character."""
    if not text.strip():
        return []
    text = splitting.join_soft_breaks(text)
    if len(text) <= most:
        return [text]
    out, start, last = [], 0, -1
    while True:
        target = min(start + most, len(text))
        end = target
        near = [p for p in range(target - 1, target - min(overlap, target - start) - 2, -1) if p > start]
        fits = (
            lambda p: text[p] == "\n",
            lambda p: text[p] in "。！？",
            lambda p: text[p] in ".!?" and (p + 1 == len(text) or text[p + 1].isspace()),
        )
        for fit in fits:
            hits = [p for p in near if fit(p)]
            if hits:
                end = hits[0] + 1
                break
        if end <= start or end <= last:
            end = target
        if text[start:end].strip():
            out.append(text[start:end])
        if end >= len(text):
            return out
        last = end
        start = end - overlap if end - overlap > start else end


@pytest.mark.parametrize("most, overlap", [(1024, 128), (40, 9), (10, 9), (7, 0), (1, 5)])
def test_pieces_against_the_slow_rule(most, overlap):
    r = random.Random(3)
    fixed = ["", " \n ", "short", "x" * 5000, "a b. " * 900, "line\n" * 700, "一二。" * 900, " " * 3000 + "x", "see https://a.b/c. " * 200]
    mixed = ["".join(r.choice("ab. \n。！?！；;https://火\r") for _ in range(r.randint(1, 400))) for _ in range(300)]
    for raw in fixed + mixed:
        assert splitting.cut_pieces(raw, most, overlap) == slow_pieces(raw, max(1, most), min(max(0, overlap), max(1, most) - 1))


@pytest.mark.parametrize("n", [1024, 1025, 3072, 3073])
def test_paragraphs_keep_what_the_tolerance_takes(n):
    from lexstrata.operators import chunking

    budget = chunking.Budget()
    text = "x" * (n - 20) + " https://a.b/c/\nd.ef"
    joined = text.replace("\n", "")
    assert len(text) == n
    want = [joined] if n - 1 <= budget.tolerance else splitting.cut_pieces(joined, 1024, 128)
    assert chunking.paragraph_groups(text, budget) == want
    assert chunking.paragraph_groups(" \n", budget) == []
    assert len(chunking.paragraph_groups("y" * 3073, budget)) == 4
