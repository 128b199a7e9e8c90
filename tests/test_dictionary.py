"""Dictionary words against every way through short runs, and in the keyword index."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import dictionary, keyword_index
from lexstrata.sources.scratch import shared_folder


def every_way(run, known, unknown):
    """The best of all 2^(n-1) splits, where single characters may stand outside the dictionary."""
    best = None
    for cuts in itertools.product([False, True], repeat=max(0, len(run) - 1)):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        steps, cost = [], 0
        for a, b in itertools.pairwise(edges):
            lone = unknown if b - a == 1 else None
            word = known.get(run[a:b])
            if lone is None and word is None:
                break
            is_word = word is not None and (lone is None or word <= lone)
            cost += word if is_word else lone
            steps.append((a, b, is_word))
        else:
            way = (cost, len(steps), [a for a, _, _ in reversed(steps)], steps)
            if best is None or way[:3] < best[:3]:
                best = way
    out, lone = [], ""
    for a, b, is_word in [*best[3], (0, 0, True)]:
        if is_word:
            out += [lone] if len(lone) == 1 else [lone[i : i + 2] for i in range(len(lone) - 1)]
            lone = ""
            out += [run[a:b]] if b else []
        else:
            lone += run[a:b]
    return out


def test_against_every_way():
    draw = random.Random(3)
    for _ in range(300):
        known = {"".join(draw.choice("甲乙丙丁") for _ in range(draw.randint(1, 4))): draw.choice([1, 2, 3, 5]) * 1_000_000 for _ in range(draw.randint(0, 9))}
        unknown = max(known.values(), default=0) + draw.choice([1, 10_000_000])
        run = "".join(draw.choice("甲乙丙丁戊") for _ in range(draw.randint(1, 9)))
        assert dictionary.best_words(run, dictionary.trie(known), unknown) == every_way(run, known, unknown), (run, known)


def test_long_run_is_linear():
    root = dictionary.trie({"安全": 1, "安全生产": 1, "生产": 1})
    assert dictionary.best_words("安全生产" * 50_000, root, 20) == ["安全生产"] * 50_000


@pytest.fixture(scope="module")
def chinese(spark):
    rows = [("安全", 900), ("生产", 800), ("安全生产", 700), ("法", 300), ("产法", 1), ("单位", 500), ("安全", 100), ("", 5), (None, 5), ("坏", 0), ("坏词", None), ("ABC", 4)]
    return dictionary.analyser(spark.createDataFrame(rows, "word string, weight long"))


def test_words_of_texts(spark, chinese):
    texts = ["《安全生产法》第2条", "Safety 安全 单位x", "未知词安全", "坏", "", None, "no script", "安全" * 3]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", chinese(F.col("text")).alias("w")).collect()
    by = {r["i"]: r["w"] for r in got}
    assert by[0] == ["2", "安全生产", "法", "第", "条"]
    assert by[1] == ["safety", "x", "安全", "单位"]
    assert by[2] == ["未知", "知词", "安全"]
    assert by[3] == ["坏"] and by[4] == [] and by[5] is None and by[6] == ["no", "script"] and by[7] == ["安全"] * 3


def test_empty_and_too_large_dictionaries(spark, monkeypatch):
    none = dictionary.analyser(spark.createDataFrame([], "word string, weight long"))
    assert spark.range(1).select(none(F.lit("安全法 a")).alias("w")).first()["w"] == ["a", "安全", "全法"]
    monkeypatch.setattr(dictionary, "MOST_WORDS", 1)
    with pytest.raises(ValueError, match="2 words"):
        dictionary.analyser(spark.createDataFrame([("a", 1), ("b", 1)], "word string, weight long"))


def test_index_with_a_dictionary(spark, chinese):
    """``生产`` finds the word alone, not inside a longer word; the bigram across two words finds nothing."""
    docs = spark.createDataFrame([(1, "安全生产法"), (2, "生产单位"), (3, "单位安全"), (4, None)], "doc_id long, text string")
    path = keyword_index.build(docs, shared_folder(spark, "dictionary-index"), {"text": "text"}, analyser=chinese)
    asked = spark.createDataFrame([(1, "生产"), (2, "产单"), (3, "单位")], "query_id long, text string")
    hits = keyword_index.search(spark, path, asked, {"text": 1.0}, 10, analyser=chinese).collect()
    assert {(r["query_id"], r["doc_id"]) for r in hits} == {(1, 2), (3, 2), (3, 3)}
