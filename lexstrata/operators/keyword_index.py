"""A persisted inverted index, and BM25 over it.

The index is three Parquet tables below one folder.  ``blocks`` has a row for
each word, field, collection and shard, where a shard is a bounded number of
documents that one task has read: the documents' ids, counts of the word and
lengths of the field, with the highest impact in the block.  ``terms`` is the
dictionary, ``fields`` has the counts that BM25 needs.  ``blocks`` and
``terms`` are partitioned by a hash of the word, so a search reads the
partitions of the words that are asked for, whatever the corpus holds
otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexstrata.functions.text import words
from lexstrata.operators.vectors import spread

K1, B = 1.2, 0.75
#: Documents, and words, of a shard at most.
SHARD_DOCS, SHARD_WORDS = 4096, 2_000_000
#: Words of queries that meet the index together.
MOST_ASKED = 200_000
#: A block knows the impact that so many of its documents reach; searches for more hits do without that bound.
SEEDED = 20
#: Words in a partition of the index, about.
PARTITION_WORDS = 4_000_000
#: What rounding to six digits may move.
SLACK = 2e-6

BLOCKS = "field string, term string, collection string, shard long, ids array<long>, tfs array<int>, lengths array<int>, n int, top double, kth double"


def impact(tf, length, mean):
    """What a word adds to a document's score, before its rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _field_rows(docs: DataFrame, id_col: str, fields: dict[str, str], exact: dict[str, str], collection_col: str | None, analyser: Callable) -> DataFrame:
    """``doc_id, collection`` and for each field its words; an exact field is one word, its whole value."""
    whole = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string")))
    collection = F.col(collection_col).cast("string") if collection_col else F.lit(None).cast("string")
    return docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"),
        collection.alias("collection"),
        *(analyser(F.col(c)).alias(f"f{i}") for i, c in enumerate(fields.values())),
        *(whole(c).alias(f"f{len(fields) + i}") for i, c in enumerate(exact.values())),
    )


def _block_batch(names: list[str], means: list[float], exact: set[str], shard: int, ids: np.ndarray, collections: list, field: int, terms):
    """The blocks of one field of a shard, as an Arrow batch; ``terms`` is its list array."""
    import pyarrow as pa

    sizes = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = terms.flatten().dictionary_encode()
    codes, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    groups = {c: i for i, c in enumerate(dict.fromkeys(collections))}
    group = np.array([groups[c] for c in collections], np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # documents of a block stand by id
    back = np.argsort(place)
    keys = (codes * len(groups) + group[owner]) * len(sizes) + place[owner]
    keys, tf = np.unique(keys, return_counts=True)
    row = back[keys % max(1, len(sizes))]
    block = keys // max(1, len(sizes))
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(block))
    part = np.ones(len(tf)) if names[field] in exact else impact(tf, sizes[row], means[field])
    top = np.maximum.reduceat(part, starts) if len(starts) else np.empty(0)
    kth = np.zeros(len(starts))
    for i in np.flatnonzero(ends - starts >= SEEDED).tolist():
        kth[i] = np.partition(part[starts[i] : ends[i]], -SEEDED)[-SEEDED]
    offsets = pa.array(np.append(starts, len(block)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids[row], tf.astype(np.int32), sizes[row].astype(np.int32))]
    code, which = block[starts] // len(groups), block[starts] % len(groups)
    order = list(groups)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([names[field]] * len(starts), pa.string()),
            vocabulary.take(pa.array(code)).cast(pa.string()),
            pa.array([order[i] for i in which.tolist()], pa.string()),
            pa.array(np.full(len(starts), shard, np.int64)),
            *lists,
            pa.array((ends - starts).astype(np.int32)),
            pa.array(top),
            pa.array(kth),
        ],
        names=[x.split()[0] for x in BLOCKS.split(", ")],
    )


def build(
    docs: DataFrame,
    path: str,
    fields: dict[str, str],
    exact: dict[str, str] | None = None,
    collection_col: str | None = None,
    id_col: str = "doc_id",
    analyser: Callable[[Column], Column] = words,
    buckets: int | None = None,
) -> str:
    """Write the index of ``docs`` below ``path``, which must be new, and return ``path``.

    ``fields`` and ``exact`` name fields and their columns; an ``exact``
    field matches only a query that equals its whole value.  Ids are whole
    numbers, each once; rows without one are left out.  A null field has no
    words and does not count into the field's mean length.  Texts are read
    twice and never move: a task cuts its own documents into shards and turns
    these into blocks, and only blocks are shuffled to their partitions, a
    frequent word's blocks over several tasks.
    """
    exact = exact or {}
    names, plain = [*fields, *exact], len(fields)
    rows = _field_rows(spread(docs.select(*dict.fromkeys([id_col, *fields.values(), *exact.values(), *([collection_col] if collection_col else [])]))), id_col, fields, exact, collection_col, analyser)
    each = [x for i in range(len(names)) for x in (F.count(f"f{i}"), F.sum(F.size(f"f{i}")))]
    sums = rows.agg(*(x.alias(f"s{i}") for i, x in enumerate(each))).first()
    count = [sums[2 * i] for i in range(len(names))]
    total = [sums[2 * i + 1] or 0 if sums[2 * i] else 0 for i in range(len(names))]
    means = [t / n if n and t else 1.0 for t, n in zip(total, count, strict=True)]
    buckets = buckets or max(8, sum(total) // PARTITION_WORDS)
    shard_docs, shard_words, exact_names = SHARD_DOCS, SHARD_WORDS, set(exact)

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, held, n, size = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            ids, collections = table.column("doc_id").to_numpy(), table.column("collection").to_pylist()
            for i in range(len(names)):
                column = table.column(f"f{i}").combine_chunks()
                out = _block_batch(names, means, exact_names, shard, ids, collections, i, column)
                if out.num_rows:
                    yield out

        for batch in batches:
            for at in range(0, batch.num_rows, shard_docs):
                some = batch.slice(at, shard_docs)
                held.append(some)
                n, size = n + some.num_rows, size + sum(len(some.column(f"f{i}").flatten()) for i in range(len(names)))
                if n >= shard_docs or size >= shard_words:
                    yield from flush()
                    shard, held, n, size = shard + 1, [], 0, 0
        if n:
            yield from flush()

    placed = rows.mapInArrow(blocks, BLOCKS).withColumn("bucket", bucket_of(F.col("term"), buckets))
    placed.repartition("bucket", F.pmod("shard", F.lit(4))).sortWithinPartitions("bucket", "term", "field").write.partitionBy("bucket").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    seen = spark.read.schema(f"{BLOCKS}, bucket int").parquet(f"{path}/blocks")
    terms = seen.groupBy("bucket", "field", "term").agg(F.sum("n").alias("df"), F.max("top").alias("top"), F.max("kth").alias("kth"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    facts = [(names[i], count[i], float(means[i]), i >= plain, buckets) for i in range(len(names))]
    spark.createDataFrame(facts, "field string, n long, mean double, exact boolean, buckets int").coalesce(1).write.parquet(f"{path}/fields")
    return path


def blocks_of(spark: SparkSession, path: str, terms: list[str], buckets: int, collections: list[str] | None = None) -> DataFrame:
    """The blocks of ``terms`` with ``word``, the place of the term in that list: only their partitions are read."""
    named = spark.createDataFrame(list(enumerate(terms)), "word long, term string")
    wanted = sorted(r["bucket"] for r in named.select(bucket_of(F.col("term"), buckets).alias("bucket")).distinct().collect())
    rows = spark.read.schema(f"{BLOCKS}, bucket int").parquet(f"{path}/blocks").filter(F.col("bucket").isin(wanted))
    if collections is not None:
        rows = rows.filter(F.col("collection").isin(list(collections)))
    return rows.join(F.broadcast(named), "term")


def _terms_of(spark: SparkSession, path: str, terms: list[str], buckets: int) -> list:
    named = spark.createDataFrame([(x,) for x in terms], "term string").withColumn("bucket", bucket_of(F.col("term"), buckets))
    wanted = sorted(r["bucket"] for r in named.select("bucket").distinct().collect())
    seen = spark.read.schema("field string, term string, df long, top double, kth double, bucket int").parquet(f"{path}/terms")
    return seen.filter(F.col("bucket").isin(wanted)).join(F.broadcast(named.select("term")), "term").collect()


def _parts(queries: DataFrame, most: int) -> list[DataFrame]:
    """Queries, as ``query_id, terms, whole, size``, in parts of ``most`` words at most; a longer query is a part of its own."""
    sizes = queries.agg(F.sum("size").alias("n"), F.count("*").alias("q")).first()
    parts = (sizes["n"] or 0) // most + 1
    while True:
        dealt = queries.withColumn("_part", F.pmod(F.xxhash64("query_id", F.lit(parts)), F.lit(parts)))
        if parts == 1 or dealt.groupBy("_part").agg(F.sum("size").alias("n"), F.count("*").alias("q")).filter((F.col("n") > most) & (F.col("q") > 1)).isEmpty():
            return [dealt.filter(F.col("_part") == p) for p in range(parts)]
        parts *= 2


def search(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    boosts: dict[str, float],
    k: int = 20,
    collections: list[str] | None = None,
    analyser: Callable[[Column], Column] = words,
) -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``k`` documents with the best boosted field of each query ``query_id, text``.

    A field's score is the sum over the query's distinct words of ln(1 + (N -
    df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length /
    mean length)), with N, df and mean length of all collections; an exact
    field scores its rarity if it equals the whole query.  ``collections``
    keeps documents of these.  Ties go to the smaller id; a null query has no
    hits.

    For each query the dictionary gives a score that ``k`` documents reach at
    least.  A shard is passed over where the highest impacts of its blocks
    cannot reach it, and a field's weakest words that cannot reach it by
    themselves bring up no documents, they are only looked up for those that
    other words bring.  What is left is exact.
    """
    facts = {r["field"]: r for r in spark.read.parquet(f"{path}/fields").collect()}
    names = list(facts)
    buckets = facts[names[0]]["buckets"]
    text = F.coalesce(F.col("text"), F.lit(""))
    asked = queries.select("query_id", F.array_distinct(analyser(text)).alias("terms"), text.alias("whole")).withColumn("size", F.size("terms") + 1)
    kind = queries.schema["query_id"].dataType.simpleString()
    out = None
    for part in _parts(asked, MOST_ASKED):
        hits = _part_hits(spark, path, part, facts, names, buckets, boosts, k, collections, kind)
        out = hits if out is None else out.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return out.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k)


def _part_hits(spark, path, part, facts, names, buckets, boosts, k, collections, kind) -> DataFrame:
    rows = [(r["query_id"], r["terms"] or [], r["whole"]) for r in part.collect()]
    tokenised = [i for i, f in enumerate(names) if not facts[f]["exact"]]
    exact = [i for i, f in enumerate(names) if facts[f]["exact"]]
    vocabulary = {x: i for i, x in enumerate(dict.fromkeys(x for _, terms, whole in rows for x in ([*terms, whole] if exact else terms)))}
    idf, kth = np.zeros((len(names), len(vocabulary))), np.zeros((len(names), len(vocabulary)))
    for r in _terms_of(spark, path, list(vocabulary), buckets) if vocabulary else []:
        f, w, n = names.index(r["field"]), vocabulary[r["term"]], facts[r["field"]]["n"]
        idf[f, w] = np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
        kth[f, w] = r["kth"]
    boost = np.array([float(boosts.get(f, 1.0)) for f in names])
    mean = np.array([facts[f]["mean"] for f in names])
    asked: list[tuple[int, list[tuple[int, np.ndarray]], float]] = []
    for q, (_, terms, whole) in enumerate(rows):
        own = np.array([vocabulary[x] for x in terms], np.int64)
        by_field = [(f, own) for f in tokenised if len(own)] + [(f, np.array([vocabulary[whole]], np.int64)) for f in exact if whole]
        # Blocks know their twentieth best without regard to collections, so a filter leaves no bound.
        least = max((float((boost[f] * idf[f, w] * kth[f, w]).max()) for f, w in by_field), default=0.0) if k <= SEEDED and collections is None else 0.0
        if by_field:
            asked.append((q, by_field, least - SLACK))
    ids_of = [q for q, _, _ in rows]
    empty = f"query_id {kind}, doc_id long, score double"
    if not asked:
        return spark.createDataFrame([], empty)
    blocks = blocks_of(spark, path, list(vocabulary), buckets, collections)
    place = F.create_map(*(x for i, f in enumerate(names) for x in (F.lit(f), F.lit(i))))
    slim = blocks.select("shard", place[F.col("field")].alias("f"), "word", "ids", "tfs", "lengths", "top")
    is_exact = np.array([facts[f]["exact"] for f in names])

    def scored(table):
        import pyarrow as pa

        f, w, top = (table.column(c).to_numpy() for c in ("f", "word", "top"))
        lists = [table.column(c).combine_chunks() for c in ("ids", "tfs", "lengths")]
        sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False)
        ids, tf, length = (x.flatten().to_numpy() for x in lists)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        fs, ws = np.repeat(f, sizes), np.repeat(w, sizes)
        weight = idf[fs, ws] * np.where(is_exact[fs], 1.0, impact(tf, length, mean[fs]))
        docs, local = np.unique(ids, return_inverse=True)
        rows_of: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(zip(f.tolist(), w.tolist(), strict=True)):
            rows_of.setdefault(key, []).append(i)
        bound = idf[f, w] * top
        found_q, found_d, found_s = [], [], []
        for q, by_field, least in asked:
            best = np.zeros(len(docs))
            for field, own in by_field:
                # One row for each collection; the documents of these differ.
                groups = [g for x in own.tolist() if (g := rows_of.get((field, x)))]
                groups.sort(key=lambda g: max(bound[i] for i in g))
                sums = np.cumsum([max(bound[i] for i in g) for g in groups]) * boost[field]
                if not len(sums) or sums[-1] < least:
                    continue
                score = np.zeros(len(docs))
                first = int(np.searchsorted(sums, least, side="left"))  # the words before it cannot reach the bound together
                for g in groups[first:]:
                    for i in g:
                        score[local[edges[i] : edges[i + 1]]] += weight[edges[i] : edges[i + 1]]
                brought = np.flatnonzero(score) if first else None
                for g in groups[:first]:
                    for i in g:
                        at = local[edges[i] : edges[i + 1]]
                        if len(brought) * 8 < len(at):
                            spot = np.minimum(np.searchsorted(at, brought), len(at) - 1)
                            hit = at[spot] == brought
                            score[brought[hit]] += weight[edges[i] : edges[i + 1]][spot[hit]]
                        else:
                            known = score[at] > 0
                            score[at[known]] += weight[edges[i] : edges[i + 1]][known]
                best = np.maximum(best, score * boost[field])
            hit = np.flatnonzero((best > 0) & (best >= least))
            value = np.round(best[hit], 6)
            if len(hit) > k:
                near = np.flatnonzero(value >= np.partition(value, -k)[-k])
                near = near[np.lexsort((docs[hit[near]], -value[near]))[:k]]
                hit, value = hit[near], value[near]
            found_q += [ids_of[q]] * len(hit)
            found_d.append(docs[hit])
            found_s.append(value)
        return pa.table(
            [pa.array(found_q, kind_of_query), pa.array(np.concatenate(found_d), pa.int64()), pa.array(np.concatenate(found_s), pa.float64())], names=["query_id", "doc_id", "score"]
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kind_of_query = to_arrow_type(part.schema["query_id"].dataType)
    return slim.groupBy("shard").applyInArrow(scored, empty)
