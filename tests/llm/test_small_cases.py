"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexstrata.llm import balltree, byte_bpe, exact_dedup, gear_chunks, jaccard_join, language, packing, quotes, suffix_dedup, token_counts
from lexstrata.llm.components import connected_components

DOCS = "doc_id long, text string, source string, lang string, n_chars long, sid string, _text int, n int, digest string, hash long"


def make(spark, texts, schema=DOCS):
    """Rows with columns whose names the operators use inside."""
    rows = [(i, t, f"s{(i or 0) % 3}" if (i or 0) % 5 else None, "en", 0, "x", 1, 2, "d", 3) for i, t in texts]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = prose(130), prose(300)
    out = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "two words"), (6, "zz " * 700)]
    out += [(10 + i, prose(r.randint(3, 150))) for i in range(20)]
    out += [(40 + i, base) for i in range(4)]
    for i in range(12):  # near copies
        words = base.split()
        for _ in range(r.randint(1, 6)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append((60 + i, " ".join(words)))
    out += [(80 + i, prose(40) + "\n" + passage + "\n" + prose(40)) for i in range(5)]
    out += [(90, prose(9000)), (90, out[8][1]), (95, passage + " " + passage), (60, out[30][1]), (None, "no id"), (None, None)]
    return out


def test_exact_duplicates(spark, texts):
    found = exact_dedup.exact_duplicates(make(spark, texts)).collect()
    assert len(found) == len(texts)
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    low = lambda i: -1 if i is None else i
    want = sorted((low(i), low(max(groups[t or ""], key=low)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    assert sorted((low(r["doc_id"]), low(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in found) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found)
    kept = exact_dedup.drop_exact_duplicates(make(spark, texts))
    assert kept.columns == make(spark, texts).columns
    assert sorted({t or "" for t in [r["text"] for r in kept.collect()]}) == sorted(groups)


def brute_repeats(texts, size):
    data = [(t or "").encode() for _, t in texts]
    seen = {}
    for d in data:
        for p in range(len(d) - size + 1):
            seen[d[p : p + size]] = seen.get(d[p : p + size], 0) + 1
    out = []
    for (i, _), d in zip(texts, data, strict=True):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - size + 1):
            if seen[d[p : p + size]] > 1:
                gone[p : p + size] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((-1 if i is None else i, len(d), int(gone.sum()), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("limit", [1500, 3])
def test_suffix_dedup(spark, texts, limit, monkeypatch):
    """The second round deals the contexts of an anchor over many shards."""
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", limit)
    found = suffix_dedup.remove_repeats(make(spark, texts)).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found)
    assert got == brute_repeats(texts, 400)


def test_suffix_dedup_in_the_pipeline(spark, texts):
    docs = make(spark, texts)
    out = suffix_dedup.replace_texts(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    want = {i: k for i, _, _, _, k in brute_repeats(texts, 400)}
    for r in out.filter("doc_id between 40 and 89").collect():
        assert r["text"] == want[r["doc_id"]].decode(errors="ignore")
        assert r["n_chars"] in (0, len(r["text"]))


def brute_components(texts, words, num, den):
    """For each row the size of its set and its component."""

    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([b" ".join(w)] if w else [])

    rows = [(i, grams(t)) for i, t in texts]
    least = {}
    for i, s in rows:
        if s and i is not None:
            least[s] = min(i, least.get(s, i))
    root = {i: i for i in least.values()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in least:
        for y in least:
            if den * len(x & y) >= num * len(x | y):
                a, b = sorted((find(least[x]), find(least[y])))
                root[b] = a
    return [(i, len(s), (find(least[s]) if s in least else None) if s else i) for i, s in rows]


@pytest.mark.parametrize("words, share, block", [(3, (90, 100), 512), (5, (80, 100), 512), (3, (90, 100), 3), (2, (60, 100), 2)])
def test_near_duplicates(spark, texts, words, share, block, monkeypatch):
    """Small blocks make every shared n-gram a hot one."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    found = jaccard_join.near_duplicates(make(spark, texts), words=words, share=share).collect()
    assert sorted(key((r["doc_id"], r["n_shingles"], r["component_id"])) for r in found) == sorted(map(key, brute_components(texts, words, *share)))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(80)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}


@pytest.mark.parametrize("power", [None, 0.7])
def test_packing(spark, texts, power):
    texts = [*texts, (700, "a <|endoftext|> b"), (701, "x<|startoftext|>y<|ENDOFTEXT|> <|endoftext|"), (702, "<|endoftext|><|startoftext|>")]
    docs = make(spark, texts)
    path = packing.default_tokenizer_path()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    pieces = packing.with_checksums(packing.pack(docs, window=256, power=power)).collect()
    by_window, by_doc = {}, {}
    for p in pieces:
        by_window.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault(p["doc_id"], []).append(p)
    total = sum(p["length"] for p in pieces)
    for w, parts in by_window.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == min(256, total - 256 * w)
    assert total == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    for i, t in texts:
        if [x for x, _ in texts].count(i) == 1:
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(ids)


def test_mixture_follows_targets():
    schedule = packing.Schedule({"a": 100_000, "b": 50_000, "c": 10_000}, {"a": 0.5, "b": 0.3, "c": 0.2})
    for w in range(1, 40):
        shares = [schedule.had(j, w * 1000) - schedule.had(j, (w - 1) * 1000) for j in range(3)]
        assert sum(shares) == 1000 and all(abs(s - x) <= 1 for s, x in zip(shares, (500, 300, 200), strict=True))
    assert [schedule.had(j, 160_000) for j in range(3)] == [100_000, 50_000, 10_000]


def test_smoothed_mixture():
    """Small queues get more than their part of the corpus, windows stay full, and nothing is left over."""
    totals = {"a": 700_001, "b": 90_000, "c": 4_321, "d": 1}
    schedule = packing.Schedule(totals, packing.smoothed(totals, 0.7))
    assert len(schedule.phases) <= 4
    first = [schedule.had(j, 4096) for j in range(4)]
    assert sum(first) == 4096 and first[1] / 4096 > 1.3 * 90_000 / sum(totals.values()) and first[2] / 4096 > 2 * 4_321 / sum(totals.values())
    weights = packing.smoothed(totals, 0.7)
    live = sum(weights.values())
    assert all(abs(x - 4096 * weights[q] / live) <= 2 for x, q in zip(first[:3], "abc", strict=True))
    assert [schedule.had(j, sum(totals.values())) for j in range(4)] == list(totals.values())


def test_byte_bpe_equals_the_library(spark, texts):
    import public_tokenizers
    import tiktoken

    path = byte_bpe.default_ranks_path()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    odd = ["".join(r.choice("ab \n\t'sé漢🙂0.,!\x1c\xa0") for _ in range(r.randint(0, 90))) for _ in range(300)]
    odd += ["a" * 3000, "".join(r.choice("tionaer") for _ in range(6000)), "\n\n  x", "x  \n\n", "漢字" * 500]
    rows = [*texts, *((1000 + i, t) for i, t in enumerate(odd))]
    want = sorted((-1 if i is None else i, hashlib.sha256(np.array(library.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    got = byte_bpe.round_trip(make(spark, rows)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(make(spark, rows)))
    assert sorted(bytes(r["data"]) for r in back.collect()) == sorted((t or "").encode() for _, t in rows)


def test_token_counts_equal_a_unigram_model(spark, texts):
    from tokenizers import Tokenizer, models

    model = token_counts.PieceModel(token_counts.default_model_path())
    got = {(r["doc_id"], r["n_words"]): r["n_tokens"] for r in token_counts.token_counts(make(spark, texts)).collect()}
    cost = model.cost
    for i, t in texts:
        total = 0
        for w in (t or "").split():
            s = token_counts.MARK + w
            best = [(0, 0)]
            for end in range(1, len(s) + 1):
                size = len(s[end - 1].encode())
                ways = [(best[end - 1][0] + size * model.byte, best[end - 1][1] + size)]
                ways += [(best[k][0] + cost[s[k:end]], best[k][1] + 1) for k in range(end) if s[k:end] in cost]
                best.append(min(ways))
            total += best[-1][1]
        assert got[i, len((t or "").split())] == total
    library = Tokenizer(models.Unigram([("<unk>", -1e6), *((p, -float(c)) for p, c in cost.items())], unk_id=0, byte_fallback=False))
    for w in ("▁" + x for x in ("the", "question", "answering", "information")):
        ids = library.encode(w).ids
        assert len(ids) == model.counts([w[1:]])[w[1:]]


def test_token_counts_of_joined_and_long_words(spark, monkeypatch):
    """Hardly any word known to the tasks, words beyond the shared length, rows that repeat without an id, small tries: all give the same counts."""
    r = random.Random(8)
    words = ["".join(r.choice("abst▁é漢") for _ in range(r.randint(1, 9))) for _ in range(300)] + ["x" * n for n in (64, 65, 66, 30_000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [(None, "same words same"), (None, "same words same"), (7, "x" * 30_000 + " x"), (8, None), (9, "\t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model = token_counts.PieceModel(token_counts.default_model_path())
    alone = {w: token_counts.Trie(model).insert(w) for _, t in rows for w in (t or "").split()}
    want = sorted(((i, len((t or "").split()), sum(alone[w] for w in (t or "").split())) for i, t in rows), key=repr)
    for common in (0, 5, 100_000):
        got = token_counts.token_counts(docs.withColumn("word", F.lit("w")), common=common).collect()
        assert sorted(map(tuple, got), key=repr) == want
    monkeypatch.setattr(token_counts, "GROWN", 20)
    assert model.counts(sorted(alone)) == alone


def test_trie_scores_a_shared_prefix_once():
    model = token_counts.PieceModel(token_counts.default_model_path())
    trie = token_counts.Trie(model)
    for word in ("token", "tokens", "tokenizer", "tone", "token"):
        trie.insert(word)
    prefixes = {token_counts.MARK + w[:n] for w in ("tokens", "tokenizer", "tone") for n in range(len(w) + 1)}
    assert len(trie.score) == len(prefixes) + 1


def test_language_profiles(spark):
    r = random.Random(3)
    parts = {"en": ["the", "ing", "tion", "and"], "de": ["ung", "sch", "keit", "der"], "fr": ["eau", "que", "ment", "é"]}
    rows = []
    for i in range(300):
        lang = r.choice(list(parts))
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(40)), "s", lang, 0, "x", 1, 2, "d", 3))
    rows += [(900, None, "s", "en", 0, "x", 1, 2, "d", 3), (901, "12 34 !", "s", "de", 0, "x", 1, 2, "d", 3), (902, "", "s", None, 0, "x", 1, 2, "d", 3), (903, "漢字 кириллица", "s", None, 0, "x", 1, 2, "d", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r for r in language.predict_languages(docs).collect()}
    assert len(found) == len(rows)
    right = [found[x[0]]["lang_pred"] == x[3] for x in rows[:300] if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert sum(right) >= 0.98 * len(right)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in found.items())
    assert [found[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and found[903]["lang_pred"] in parts
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {x[0] for x in rows} - {900, 901, 902}
    empty = language.predict_languages(docs.limit(0))
    assert empty.count() == 0
    assert {r["lang_pred"] for r in language.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gear_chunks(spark, texts):
    for _, t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        ends = gear_chunks.cuts(data)
        h, slow = 0, []
        for b in data.tolist():
            h = (h << 1) + int(gear_chunks.GEAR[b]) & 0xFFFFFFFF
            slow.append(h)
        assert gear_chunks.gear_hash(data).tolist() == slow if len(data) else not ends
        assert not ends or (ends[-1] == len(data) and all(0 < b - a <= gear_chunks.MOST for a, b in zip([0, *ends], ends, strict=False)))
        for a, b in zip([0, *ends], ends, strict=False):
            data[a:b].tobytes().decode()
    assert_gear(spark, texts)
    late = [r for r in gear_chunks.substring_dedup(make(spark, texts)).collect() if r["doc_id"] in (81, 82, 83, 84)]
    assert all(r["n_removed"] > 200 for r in late)


def assert_gear(spark, texts):
    """Row by row: chunks and their first places in the order of id, print and place, runs, equal bytes around them."""
    found = gear_chunks.substring_dedup(make(spark, texts)).collect()
    assert len(found) == len(texts)
    first, data = {}, {}
    docs = make(spark, texts).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("p")).collect()
    places = {}
    for r in sorted(docs, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["p"])):
        key = (r["doc_id"], r["p"])
        data[key], start, places[key] = (r["text"] or "").encode(), 0, []
        for end in gear_chunks.cuts(np.frombuffer(data[key], np.uint8)):
            first.setdefault(data[key][start:end], (key, start))
            places[key].append((start, end))
            start = end
    want = []
    for r in docs:
        key = (r["doc_id"], r["p"])
        d, runs = data[key], []
        for start, end in places[key]:
            f, at = first[d[start:end]]
            if (f, at) == (key, start):
                continue
            if runs and runs[-1][1] == start and runs[-1][2] == f and runs[-1][3] + start - runs[-1][0] == at:
                runs[-1][1] = end
            else:
                runs.append([start, end, f, at])
        gone = np.zeros(len(d) + 1, bool)
        joints = set()
        for begin, end, f, at in runs:
            o, a, b, far = data[f], begin, end, at + end - begin
            while a > 0 and begin - a < gear_chunks.REACH and at - (begin - a) > 0 and d[a - 1] == o[at - (begin - a) - 1]:
                a -= 1
            while b < len(d) and b - end < gear_chunks.REACH and far + b - end < len(o) and d[b] == o[far + b - end]:
                b += 1
            while a < begin and d[a] & 0xC0 == 0x80:
                a += 1
            while end < b < len(d) and d[b] & 0xC0 == 0x80:
                b -= 1
            gone[a:b] = True
            joints.add((a, b))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)))
        spans = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= gear_chunks.MIN_BYTES or len(d[a:b].split()) >= gear_chunks.MIN_WORDS]
        kept = bytes(d)
        for a, b in reversed(spans):
            kept = kept[:a] + kept[b:]
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(d), sum(b - a for a, b in spans), len(spans), kept))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found) == sorted(want)


def test_ball_tree(spark, monkeypatch):
    monkeypatch.setattr(balltree, "SHARD_ROWS", 64)
    monkeypatch.setattr(balltree, "LEAF_ROWS", 8)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(150)]  # ties
    rows += [(600, None), (601, [1.0, None, *[0.0] * 6]), (602, [float("nan"), *[0.0] * 7]), (603, []), (604, [float("inf")] * 8), (None, rows[0][1]), (0, rows[0][1])]
    points = balltree.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    ints = {x["vec_id"]: np.array(x["v"], np.int64) for x in points.collect()}
    got = {}
    for x in balltree.top_k_inner_product(points, points.filter("vec_id % 50 = 0")).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    for q in [i for i in ints if i % 50 == 0]:
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert not got
    assert balltree.top_k_inner_product(points.limit(0), points.limit(0)).count() == 0
    mixed = [(i, [float(x) for x in r.normal(size=3 if i % 3 else 2 if i % 2 else 7)]) for i in range(300)]
    other = balltree.integer_vectors(spark.createDataFrame([(*x, 1, 2.0, "c") for x in mixed], "vec_id long, embedding array<float>, cell int, far double, part string"))
    ints = {x["vec_id"]: np.array(x["v"], np.int64) for x in other.collect()}
    got = {}
    for x in balltree.top_k_inner_product(other, other.filter("vec_id % 10 = 0")).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    for q in range(0, 300, 10):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    few = points.filter("vec_id in (0, 1, 2)")
    assert balltree.top_k_inner_product(few, few.filter("vec_id = 0")).count() == 2


def test_quotation_threads(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"),
        (1, 1, "assistant", "> how are  YOU?\nFine."),
        (1, 2, "user", "> Fine.\n>> How are you?\nGood to hear."),
        (1, 3, "assistant", "No quote here."),
        (1, 4, "user", "> never said\nodd"),
        (1, 5, "user", "> Hello there.\n> How are you?\nBoth lines"),
        (2, 0, "user", "Fine."),
        (2, 1, "user", None),
        (2, None, "user", "> Fine."),
        (None, 0, "user", "> Fine."),
    ]
    got = quotes.reply_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("said", F.lit(1)))
    by = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert len(by) == len(rows)
    see = lambda k: (by[k]["reply_to"], by[k]["thread_root"], by[k]["reply_depth"], by[k]["text"])
    assert see((1, 0)) == (None, 0, 0, "Hello there.\nHow are you?")
    assert see((1, 1)) == (0, 0, 1, "Fine.")
    assert see((1, 2)) == (1, 0, 2, "Good to hear.")
    assert by[1, 2]["quote_depth"] == 2 and by[1, 2]["n_quoted"] == 2
    assert see((1, 3)) == (None, 3, 0, "No quote here.")
    assert see((1, 4)) == (None, 4, 0, "odd")
    assert see((1, 5)) == (0, 0, 1, "Both lines")
    assert see((2, 1)) == (None, 1, 0, "")
    assert [by[1, turn]["reply_order"] for turn in range(6)] == [0, 1, 2, 4, 5, 3]
    assert by[2, None]["reply_order"] is None and by[None, 0]["reply_order"] is None


def slow_threads(rows):
    """Row by row: quoted lines, blocks and levels against what earlier turns of the conversation said first."""
    marks = re.compile(r"^[ \t]*(>[ \t>]*)")
    split = lambda t: re.split(r"\r\n|\r|\n", t or "")
    level = lambda x: (m := marks.match(x)) and m[1].count(">") or 0
    clean = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower()).strip(" ")
    useful = lambda u: any(c.isalnum() for c in u)
    own = lambda t: "\n".join(x for x in split(t) if not level(x)).strip(" ")
    said = {}
    for conv, turn, _, t in sorted(rows, key=lambda r: (r[0], r[1])):
        mine = own(t)
        for u in {clean(x) for x in [*mine.split("\n"), *re.split(r"\n[ \t]*\n", mine), *re.split(r"(?<=[.!?。！？])\s+", mine), mine]}:
            if useful(u):
                said.setdefault((conv, u), turn)
    up = {}
    for conv, turn, _, t in rows:
        lines = [(i, level(x), marks.sub("", x)) for i, x in enumerate(split(t))]
        for depth in sorted({n for _, n, _ in lines} - {0}):
            mine = [(i, b) for i, n, b in lines if n == depth]
            blocks, last = [], None
            for i, b in mine:
                if last != i - 1:
                    blocks.append([])
                blocks[-1].append(b)
                last = i
            votes = {}
            for u in {clean(b) for _, b in mine} | {clean(" ".join(b)) for b in blocks} | {clean(" ".join(b for _, b in mine))}:
                if useful(u) and said.get((conv, u), turn) < turn:
                    votes[said[conv, u]] = votes.get(said[conv, u], 0) + len(u)
            if votes and (conv, turn) not in up:
                up[conv, turn] = max(votes, key=lambda k: (votes[k], k))
    out = []
    for conv, turn, role, t in rows:
        at, n = turn, 0
        while (conv, at) in up:
            at, n = up[conv, at], n + 1
        depths = [level(x) for x in split(t)]
        out.append((conv, turn, role, own(t), sum(d > 0 for d in depths), max(depths), up.get((conv, turn)), at, n))
    order = {conv: sorted({(x[7], x[1]) for x in out if x[0] == conv}) for conv in {x[0] for x in out}}
    return sorted(((*x, order[x[0]].index((x[7], x[1]))) for x in out), key=repr)


def test_threads_against_a_loop(spark):
    """Nested, wrapped and interleaved quotations, one long conversation, repeated rows, and many messages that quote one line."""
    r = random.Random(21)
    words = [f"w{i}" for i in range(60)]
    sentence = lambda: " ".join(r.choice(words) for _ in range(r.randint(2, 7))) + r.choice(".!? ")
    rows = []
    for conv, size in [(1, 300), (2, 25), (3, 1), (4, 40), (5, 12)]:
        texts = []
        for turn in range(size):
            parts = []
            for _ in range(r.randint(0, 3)):
                if texts and r.random() < 0.8:
                    old = r.choice(texts)
                    kind = r.random()
                    if kind < 0.4:
                        parts += ["> " + x for x in old.split("\n")]
                    elif kind < 0.7:  # one sentence, wrapped anew
                        some = r.choice(re.split(r"(?<=[.!?])\s+", old)).split()
                        parts += ["> " + " ".join(some[k : k + 3]).upper() for k in range(0, len(some), 3)]
                    else:
                        parts.append(">> " + r.choice(old.split("\n")))
                if r.random() < 0.9:
                    parts.append(" ".join(sentence() for _ in range(r.randint(1, 3))))
                if r.random() < 0.3:
                    parts += ["", sentence()]
            if turn % 7 == 3 and texts:
                parts = ["> " + texts[0].split("\n")[0], "again"]
            texts.append("\n".join(parts))
            rows.append((conv, turn, r.choice(["user", "assistant"]), texts[-1]))
    rows += [(6, 0, "user", None), (6, 1, "user", ""), (6, 2, "user", "> ...\n>"), (7, 0, "user", "long " * 20_000 + "end."), (7, 1, "user", "> " + "long " * 20_000 + "end.\nyes")]
    rows += [rows[10], rows[-1]]
    got = quotes.reply_threads(spark.createDataFrame([(*x, "h", 1) for x in rows], "conv_id long, turn long, role string, text string, hash string, level int")).collect()
    assert sorted(map(tuple, got), key=repr) == slow_threads(rows)
    assert sum(x["reply_to"] is not None for x in got) > 150 and max(x["reply_depth"] for x in got) > 3


def test_one_hot_conversation_of_many_turns(spark):
    """5,000 turns that nearly all quote the first one, repeated rows, and gaps in the turns: threads, depths and places."""
    rows = [(1, 0, "user", "The first word."), *((1, i, "user", "> The first word.\nmine") for i in range(1, 4000)), *((1, i * 7, "user", f"alone {i}") for i in range(600, 1600))]
    rows += [rows[0]] * 50 + [rows[5]] * 50 + [(2, -3, "user", "a start"), (2, -1, "user", "> a start\nb")]
    got = quotes.reply_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == slow_threads(rows)


def test_language_profiles_against_a_loop(spark):
    """Bundles summed letter by letter, and cosines of each text with each prototype."""
    r = random.Random(6)
    parts = {"en": ["the", "ing", "Tion", "and"], "de": ["ung", "sch", "ß", "der"], "ru": ["ого", "ить", "ста"], "zh": ["漢", "字", "是"]}
    rows = []
    for i in range(80):
        lang = r.choice(list(parts))
        rows.append((i, r.choice([" ", "\n", ", 12 "]).join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 25))), lang if i % 9 else None))
    rows += [(200, "the " * 3000, "en"), (201, None, "en"), (202, "1 2", "de"), (203, "", None), (None, "und der schung", "de"), (5, rows[5][1], rows[5][2])]
    letters = language.letter_vectors().astype(np.float64)

    def bundle(text):
        row = [1 + ord(c) % (language.LETTERS - 1) if c.isalpha() else 0 for c in (text or "").lower()]
        row = [0] + [x for k, x in enumerate(row) if x or k == 0 or row[k - 1]] + [0]
        out = np.zeros(letters.shape[1])
        for a, b, c in zip(row, row[1:], row[2:], strict=False):
            if b:
                out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    sums = {}
    for i, t, lang in rows:
        if lang and not held(i) and any(c.isalpha() for c in t or ""):
            sums[lang] = sums.get(lang, 0) + bundle(t)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    docs = spark.createDataFrame([(*x, "x", 1.5) for x in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    want = {}
    for i, t, _ in rows:
        v = unit(bundle(t))
        cosines = {k: float(unit(p) @ v) for k, p in sums.items()} if any(c.isalpha() for c in t or "") else {}
        want[i] = cosines
    found = language.predict_languages(docs).collect()
    assert len(found) == len(rows)
    for x in found:
        cosines = want[x["doc_id"]]
        assert x["held_out"] == held(x["doc_id"])
        assert (x["lang_pred"] in cosines and abs(cosines[x["lang_pred"]] - max(cosines.values())) < 1e-5) if cosines else x["lang_pred"] == "und"
        assert abs(x["score"] - max(0.0, cosines[x["lang_pred"]] if cosines else 0.0)) < 1e-5


def test_long_runs_are_encoded_soon():
    import tiktoken

    import public_tokenizers

    path = byte_bpe.default_ranks_path()
    own = byte_bpe.TreeBpe(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in ("a" * 20_000, "ab" * 9_000, "é" * 5_000, " " * 8_000, "=" * 7_001 + "-" * 4_000, "漢字" * 3_000, "xyz" * 2_001):
        began = time.process_time()
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text) and time.process_time() - began < 5
        data = text[:400].encode()
        assert own.queued(data) == own.merged(data)


def test_empty_tables(spark):
    docs = make(spark, [(1, "x")]).limit(0)
    for run in (exact_dedup.exact_duplicates, suffix_dedup.remove_repeats, jaccard_join.near_duplicates, packing.pack, byte_bpe.round_trip, token_counts.token_counts, gear_chunks.substring_dedup):
        assert run(docs).count() == 0
    chat = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.reply_threads(chat).count() == 0


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline

    docs = make(spark, [(i, t) for i, t in texts if i is not None]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{at}"))
        now = spark.read.parquet(str(tmp_path / f"out{at}"))
        counts.append(now.count())
        if at < 4:
            assert now.columns == docs.columns
        if at == 2:
            left = [(r["doc_id"], r["text"]) for r in now.collect()]
    # Row 6 is one word 700 times, which is like no language.
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if any(c.isalpha() for c in r["text"] or "") and r["doc_id"] != 6]
    assert counts[0] == len(rows)
    keep = {}
    for i, t in rows:
        keep[t] = max(i, keep.get(t, -1))
    unique = [(i, t) for i, t in rows if keep[t] == i]
    assert counts[1] == len(unique)
    assert sorted(i for i, _ in left) == sorted(i for i, _, c in brute_components(unique, 5, 80, 100) if c == i)
    assert counts[3] == counts[2]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[4]


@pytest.mark.parametrize("limit", [1500, 1])
def test_passages_of_51_words(spark, limit, monkeypatch):
    """The pipeline's stage takes out shared passages of over 50 words, however short or wrapped; 50 words stay."""
    import corpus_pipeline

    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", limit)
    r = random.Random(11)
    fresh = iter(range(10**9))
    prose = lambda n: " ".join(f"{next(fresh):x}é" for _ in range(n))
    passage = " ".join(r.choice("abcdefghij") + r.choice("klmnopé") for _ in range(51))
    assert len(passage.encode()) < 240
    edges = [(prose(60), prose(70)) for _ in range(4)]
    rows = [(i, f"{a}\n{passage}\n{b}") for i, (a, b) in enumerate(edges)]
    a, b, c, short, long = prose(30), prose(80), prose(30), prose(50), "x" + "".join(r.choice("0123456789") for _ in range(450))
    rows += [(10, a + " " + passage.replace(" ", "\n ") + " " + b), (11, c + " " + short), (12, short), (13, f"{a[:9]} {long}"), (14, long + " end"), (15, None), (16, "")]
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.substring_dedup(spark, make(spark, rows), None).collect()}
    assert len(got) == len(rows)
    for i, (x, y) in enumerate(edges):
        assert got[i] == f"{x}\n\n{y}"
    assert got[10] == a + "  " + b
    assert got[11] == c + " " + short and got[12] == short
    assert got[13] == a[:9] + " " and got[14] == " end" and got[15] is None and got[16] == ""


def test_repeated_rows_stand_once(spark, tmp_path):
    """Rows that repeat an id with its text, null ids and nulls among them, leave one row with its whole text."""
    import corpus_pipeline

    r = random.Random(12)
    prose = lambda n: " ".join("".join(r.choice("abcdefghi") for _ in range(r.randint(2, 8))) for _ in range(n))
    twice, once, no_id = prose(120), prose(130), prose(90)
    rows = [(1, twice), (1, twice), (1, twice), (2, once), (1, once[:200]), (None, no_id), (None, no_id)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    now = spark.read.parquet(path)
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{at}"))
        now = spark.read.parquet(str(tmp_path / f"out{at}"))
    left = now.collect()
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["text"]) for x in left) == sorted([(1, twice), (2, once), (1, once[:200]), (-1, no_id)])
    assert {x["source"] for x in left} == {"s0", "s3", "s4", "s5"}
    single = docs.filter("doc_id = 2")
    assert exact_dedup.drop_repeated_rows(single).collect() == single.collect()


def test_gear_passages_are_whole(spark):
    """A later passage of over 50 words goes to its ends, although whole chunks do not cover it; the first stays."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghijklmnopé漢") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, passages = [], []
    for i in range(40):
        passages.append(f"§{prose(51)}§")
        rows += [(i, prose(20) + "à" + passages[i] + "b" + prose(20)), (100 + i, prose(25) + "á" + passages[i] + "c" + prose(15))]
    short = [prose(40) for _ in range(10)]
    rows += [(300 + i, f"{prose(20)} x{x}y {prose(20)}") for i, x in enumerate(short)] + [(400 + i, f"{prose(20)} z{x}w {prose(20)}") for i, x in enumerate(short)]
    rows += [(200, None), (201, ""), (202, passages[0] * 12), (203, passages[0] * 12), (204, "é" * 40_000), (205, prose(8000)), (205, prose(5)), (206, "b" + "ab " * 9000)]
    found = {x["doc_id"]: x for x in gear_chunks.substring_dedup(make(spark, rows)).collect()}
    texts = dict(rows)
    for i, passage in enumerate(passages):
        assert bytes(found[i]["kept"]).decode() == texts[i]
        assert bytes(found[100 + i]["kept"]).decode() == texts[100 + i].replace(passage, "")
    assert all(found[i]["n_removed"] == 0 for i in range(300, 310)) and all(found[i]["n_removed"] == 0 for i in range(400, 410))
    assert bytes(found[203]["kept"]) == b"" and found[200]["n_bytes"] == found[201]["n_bytes"] == 0
    assert_gear(spark, rows)


def test_pipeline_of_an_empty_table_and_of_clashing_columns(spark, tmp_path):
    """No rows go through all stages; columns named as the operators' own stay as they are until packing."""
    import corpus_pipeline

    r = random.Random(31)
    prose = lambda n: " ".join("".join(r.choice("abcdefghiklmnorstu") for _ in range(r.randint(2, 8))) for _ in range(n))
    rows = [(i, prose(90), "en", None if i % 4 == 0 else f"s{i % 3}", None) for i in range(12)] + [(50, None, None, None, None), (51, "", None, "s1", 0)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["sid", "vec", "label", "digest", "hash", "lo", "hi", "unit", "spans", "runs", "block", "start", "n", "queue", "begin", "end", "_salt", "print", "kept", "group"]
    wide = base.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    for at, now in enumerate((base.limit(0), wide)):
        kept = now.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{at}-{k}")
            stage(spark, now, str(tmp_path)).write.parquet(path)
            now = spark.read.parquet(path)
            if k < 4:
                assert now.columns == kept
                assert now.count() == 12 * at and now.filter(" or ".join(f"`{c}` <> {i}" for i, c in enumerate(names)) if at else "true").count() == 0
        assert now.select("doc_id").distinct().count() == 12 * at


def test_points_bound_the_overlap_and_chance_fills_no_pair():
    """Long sets that share next to nothing survived 128 groups, in pairs that grew with the square of a block."""
    import numpy as np

    from lexstrata.llm import jaccard_join

    r = np.random.default_rng(5)
    drawn = lambda n: np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
    sets = [drawn(n) for n in (1, 5, 300, 4000, 4100, 8000, 8200, 9000)]
    sets += [np.unique(np.concatenate([sets[5][: 8000 * k // 100], drawn(8000 - 80 * k)])) for k in (50, 75, 90)]
    sets.append(np.full(700_00, 3 << 11, np.uint64) + (np.arange(70_000, dtype=np.uint64) << np.uint64(40)))  # all in one group
    packed, sizes = [jaccard_join.point(x) for x in sets], np.array([len(x) for x in sets])
    for x, p in zip(sets, packed, strict=True):
        assert jaccard_join.counts_of(p).sum() == len(x)
    points = jaccard_join.Points(packed)
    i, j = np.triu_indices(len(sets), 1)
    shared = points.shared(i, j)
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert (shared >= both).all() and (shared <= np.minimum(points.coarse[i], points.coarse[j]).sum(axis=1)).all()
    fit = {(int(a), int(b)) for x, y, m in jaccard_join.RTree(points.coarse, sizes, points).survivors((80, 100), np.arange(len(sets))) for a, b in zip(x[np.nonzero(m)[0]], y[np.nonzero(m)[1]], strict=True)}
    assert {tuple(sorted(p)) for p in fit} == {(5, 10)}
    assert {tuple(sorted(p)) for p in jaccard_join.forest(points.coarse, sizes, (80, 100), points)} == {(5, 10)}


def test_word_ids_in_two_generations(monkeypatch):
    """Frequent words were merged anew whenever the memo was full; a special token's string in capitals was taken for the token."""
    from lexstrata.llm import packing

    monkeypatch.setattr(packing, "MEMO", 20)
    words = packing.WordIds(packing.default_tokenizer_path(), "<u2")
    merged, plain = [], words.merged
    words.merged = lambda word: (merged.append(word), plain(word))[1]
    texts = [f"The and, of {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}x Straße «É»." for i in range(100)]
    texts += ["a<|STARTOFTEXT|>b <|endoftext|> İX Ünï,\tq", "Tab\x0bA.B., It's 3,4 ﬁ Ⅷ e\u0301", "ΣΑΣ ss. 日本 x", ""]
    for text in texts:
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert list(memoryview(words.text(text)).cast("H")) == want, text
    assert len(words) <= 21 and len(words.older) <= 21
    assert max(merged.count(x) for x in ("the", "and,", "of", "Straße")) == 1


def test_pipeline_deals_texts_by_bytes(spark):
    import corpus_pipeline
    from lexstrata.llm.common import BATCH_BYTES, BATCH_KEY

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "rows"])

    before = spark.conf.get(BATCH_KEY)
    texts = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word', id, ' '), 1200)").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    texts = texts.withColumn("n_chars", F.length("text").cast("long"))
    try:
        for stage in (corpus_pipeline.language_id, corpus_pipeline.packing):
            spark.conf.set(BATCH_KEY, before)
            stage(spark, texts.limit(20), None)
            got = texts.mapInArrow(sizes, "size long, rows long").collect()
            assert sum(x["rows"] for x in got) == 1500 and max(x["size"] for x in got) <= BATCH_BYTES + (1 << 16)
    finally:
        spark.conf.set(BATCH_KEY, before)


def test_workers_keep_no_words_after_the_pipeline(spark):
    import corpus_pipeline

    rows = [(i, " ".join(f"v{i}x{k}" for k in range(300)) + (" again" * (i % 3))) for i in range(200)]
    docs = make(spark, rows).repartition(4)
    got = {(x["doc_id"], x["start"]): x for x in corpus_pipeline.packing(spark, docs, None).collect()}

    def held(batches):
        import pyarrow as pa

        for batch in batches:
            kept = [len(w) + len(w.older) for w in packing._LOADED.values()]
            yield pa.RecordBatch.from_arrays([pa.array([max(kept, default=0)], pa.int64())], names=["n"])

    assert max(x["n"] for x in spark.range(0, 8, 1, 4).mapInArrow(held, "n long").collect()) <= 1
    words = packing.WordIds(packing.default_tokenizer_path(), "<u2")
    for i, text in rows:
        assert sum(x["length"] for (d, _), x in got.items() if d == i) == len(words.text(text)) // 2 + 1
