"""The inverted index: exact hits against a loop, collections, exact fields, and what a search reads."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import keyword_index
from lexstrata.sources.scratch import shared_folder

DOCS = "doc_id long, text string, source string, number string, base string, term string, bucket int"


def loop(docs, asked, k, collections=None):
    out = {}
    for q, text in asked:
        best = {}
        for column, boost, exact in ((1, 1.0, False), (2, 2.0, False), (3, 4.0, True)):
            terms = {d[0]: [d[column]] if exact else re.findall(r"\w+", d[column].lower()) for d in docs if d[column] is not None and d[0] is not None}
            mean = sum(map(len, terms.values())) / len(terms)
            for d in docs:
                if d[0] not in terms or collections is not None and d[4] not in collections:
                    continue
                score = 0.0
                for w in {text or ""} if exact else set(re.findall(r"\w+", (text or "").lower())):
                    own = terms[d[0]]
                    if w and w in own:
                        n = sum(w in x for x in terms.values())
                        tf = own.count(w)
                        part = 1.0 if exact else tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
                        score += math.log(1 + (len(terms) - n + 0.5) / (n + 0.5)) * part
                if score:
                    best[d[0]] = max(best.get(d[0], 0), boost * score)
        out[q] = sorted(((d, round(s, 6)) for d, s in best.items()), key=lambda x: (-x[1], x[0]))[:k]
    return {q: hits for q, hits in out.items() if hits}


@pytest.fixture(scope="module")
def table():
    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(200)]
    pick = lambda: vocabulary[min(199, int(r.expovariate(0.05)))]
    docs = [(i, " ".join(pick() for _ in range(r.randint(0, 60))), r.choice(["w1 w2", "w3", None]), r.choice(["4.1.2", "W1 w2", None]), r.choice(["a", "b", None]), "t", 1) for i in range(900)]
    docs += [(1000, None, None, None, None, "t", 1), (1001, "", "", "", "a", "t", 1), (None, "w1", "w1", "4.1.2", "a", "t", 1), (1002, "w1 " * 5000, None, None, "b", "t", 1)]
    asked = [(q, " ".join([pick(), *(r.choice(["w1", "W2", pick(), "none"]) for _ in range(r.randint(0, 6)))])) for q in range(40)] + [(50, None), (51, "4.1.2"), (52, "W1 w2"), (53, "")]
    return docs, asked


@pytest.mark.parametrize("shard_docs,most_asked,k,collections", [(4096, 200_000, 7, None), (50, 100, 7, ["a", "none"]), (64, 200_000, 30, None)])
def test_search_against_a_loop(spark, table, shard_docs, most_asked, k, collections, monkeypatch):
    monkeypatch.setattr(keyword_index, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(keyword_index, "MOST_ASKED", most_asked)
    docs, asked = table
    path = keyword_index.build(
        spark.createDataFrame(docs, DOCS).repartition(3), shared_folder(spark, "index"), {"content": "text", "title": "source"}, {"number": "number"}, "base"
    )
    got = {}
    found = keyword_index.search(spark, path, spark.createDataFrame(asked, "query_id long, text string"), {"title": 2.0, "number": 4.0}, k, collections)
    for x in found.orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["doc_id"], x["score"]))
    want = loop(docs, asked, k, collections)
    assert got.keys() == want.keys()
    for q, hits in want.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in hits], abs=2e-6)
        edge = hits[-1][1] + 3e-6  # beside rounding the same documents; at the last score any of those that tie within it
        assert {d for d, s in got[q] if s > edge} == {d for d, s in hits if s > edge}


def test_a_search_reads_the_partitions_of_its_words(spark, table):
    docs, _ = table
    path = keyword_index.build(spark.createDataFrame(docs, DOCS), shared_folder(spark, "index"), {"content": "text"}, buckets=64)
    every = spark.read.parquet(f"{path}/blocks").inputFiles()
    few = keyword_index.blocks_of(spark, path, ["w1", "w30"], 64)
    wanted = _buckets(spark, ["w1", "w30"])
    read = {r["f"] for r in few.select(F.input_file_name().alias("f")).distinct().collect()}
    assert all(any(f"bucket={b}/" in f for b in wanted) for f in read) and len(read) <= 2 * 4 < len(every) / 4
    assert {r["term"] for r in few.select("term").distinct().collect()} == {"w1", "w30"}


def _buckets(spark, terms):
    return {r[0] for r in spark.createDataFrame([(x,) for x in terms], "term string").select(keyword_index.bucket_of("term", 64)).collect()}


def test_an_index_of_no_documents(spark):
    path = keyword_index.build(spark.createDataFrame([], DOCS), shared_folder(spark, "index"), {"content": "text"}, {"number": "number"})
    assert keyword_index.search(spark, path, spark.createDataFrame([(1, "w1")], "query_id long, text string"), {}).count() == 0
