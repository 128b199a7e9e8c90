"""Vector retrieval for whole tables of queries."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def top_k(scored: DataFrame, groups: list[str], k: int, score: str = "score", tie: str = "vec_id") -> DataFrame:
    """The ``k`` best rows of each group; ties go to the smaller ``tie``."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _matrix(lists) -> np.ndarray:
    """An Arrow array of lists of one length as the rows of a matrix."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(set(sizes.tolist())) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(set(sizes.tolist()))[:5]}")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1 if sizes.sum() else 0)


def _first(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row, by score, then id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[keep], scores[keep]


def _best(q: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, digits: int, at_once: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, id, score`` of the ``k`` best points of each row of ``q``; only what may be among them is rounded and sorted."""
    found = []
    for begin in range(0, len(q), at_once):
        scores = q[begin : begin + at_once] @ p.T
        if len(p_ids) > k:
            kth = np.partition(np.where(np.isnan(scores), -np.inf, scores), -k, axis=1)[:, -k, None]
            near = ~(scores < kth - 2 * 10.0**-digits)  # rounding may bring up what lies so near
        else:
            near = np.ones(scores.shape, bool)
        row, at = np.nonzero(near)
        found.append(_first(row + begin, p_ids[at], np.round(scores[row, at], digits), k))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: Rows that a task holds of the best so far.
HELD = 2_000_000


def exact_top_k(queries: DataFrame, points: DataFrame, k: int, collection: str | None = None, digits: int = 6, batch_rows: int = 2048, n_points: int | None = None) -> DataFrame:
    """Exact cosine top-k of each query: ``query_id, vec_id, score, rank``.

    Queries are ``query_id, v``, points ``vec_id, v``, all of length 1; a row
    without a vector has no score.  With ``collection`` the k best of each
    query in each collection are kept.  Queries and points are packed into
    batches, a batch of queries meets a batch of points in one matrix
    product, and only the k best of a batch of queries in a task are
    shuffled.  Batches of queries are repeated for every group of points, so
    they are joined by a shuffle and never sent out by the driver.
    ``n_points``, about how many points there are, saves working them out
    twice.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q_parts = max(1, queries.count() // batch_rows + 1)
    p_parts = max(1, (points.count() if n_points is None else n_points) // (batch_rows * parts) + 1)
    packed = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(q_parts)).alias("_s")).agg(F.sort_array(F.collect_list(F.struct("query_id", "v"))).alias("q"))
    packed = packed.select("_s", F.col("q")["query_id"].alias("q_ids"), F.col("q")["v"].alias("q_vs")).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    named = points.withColumn("_k", F.col(collection).cast("string") if collection else F.lit(""))
    batches = named.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("_g"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(p_parts)).alias("_c"), "_k").agg(
        F.collect_list(F.struct("vec_id", "v")).alias("p")
    )
    batches = batches.select("_g", "_k", F.col("p")["vec_id"].alias("p_ids"), F.col("p")["v"].alias("p_vs"))

    def scored(rows):
        import pyarrow as pa

        held: dict = {}

        def flush():
            for (_, name), (q_ids, (row, point, score)) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(point), pa.array(score), pa.array([name] * len(row), pa.string())], names=["query_id", "vec_id", "score", "collection"])
            held.clear()

        def packed_in(batch, r, side):
            ids, lists = batch.column(f"{side}_ids")[r].values, batch.column(f"{side}_vs")[r].values
            if ids.null_count:
                raise ValueError("an id is null")
            return ids.filter(lists.is_valid()).to_numpy(), _matrix(lists.drop_null())

        for batch in rows:
            for r in range(batch.num_rows):
                (q_ids, q), (p_ids, p) = packed_in(batch, r, "q"), packed_in(batch, r, "p")
                if not len(q_ids) or not len(p_ids):
                    continue
                new = _best(q, p, p_ids, k, digits)
                key = (batch.column("_s")[r].as_py(), batch.column("_k")[r].as_py())
                if key in held:
                    new = _first(*(np.concatenate(x) for x in zip(held[key][1], new, strict=True)), k)
                held[key] = (q_ids, new)
                if sum(len(x[1][0]) for x in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    # Without the hint the small table of batches would be sent to all, with all its copies.
    pairs = packed.hint("merge").join(batches, "_g").select("_s", "q_ids", "q_vs", "_k", "p_ids", "p_vs")
    found = pairs.mapInArrow(scored, "query_id long, vec_id long, score double, collection string")
    return top_k(found, ["query_id", "collection"], k) if collection else top_k(found.drop("collection"), ["query_id"], k)


def spread(df: DataFrame) -> DataFrame:
    """A table that a few tasks would scan, dealt over all cores; a larger one as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def hashed_vectors(rows: DataFrame, id_col: str, terms: Column, dimensions: int = 256) -> DataFrame:
    """``id_col, v``: ln(1 + count) of a text's words by the first two hex digits of their MD5, with length 1; a text without words has no row."""
    some = spread(rows).select(id_col, terms.alias("_terms"))

    def hashed(batches):
        import pyarrow as pa

        places: dict[str, int] = {}

        def place(word):
            if word not in places:
                places[word] = int(hashlib.md5(word.encode()).hexdigest()[:2], 16) % dimensions
            return places[word]

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                if len(places) > 200_000:
                    places.clear()
                terms = batch.column("_terms")
                sizes = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                coded = terms.flatten().dictionary_encode()
                of_word = np.array([place(w) for w in coded.dictionary.to_pylist()], np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                counts = np.bincount(owner * dimensions + of_word[coded.indices.to_numpy()], minlength=len(sizes) * dimensions)
                v = np.log1p(counts.reshape(-1, dimensions)[sizes > 0])
                v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dimensions, pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(id_col).filter(pa.array(sizes > 0)), lists], names=[id_col, "v"])

    return some.mapInArrow(hashed, f"{id_col} {some.schema[id_col].dataType.simpleString()}, v array<double>")


def _nearest(points: DataFrame, centres: np.ndarray, n: int, id_col: str) -> DataFrame:
    """``id_col, v, cell`` for the ``n`` nearest cells of each row."""

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                cells = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(at), batch.column("v").take(at), pa.array(cells.ravel().astype(np.int32))], names=[id_col, "v", "cell"])

    return points.select(id_col, "v").mapInArrow(near, f"{id_col} {points.schema[id_col].dataType.simpleString()}, v array<double>, cell int")


def fit_cells(points: DataFrame, k: int = 10, recall: float = 0.95, rounds: int = 8, sample: int = 4096, most_cells: int = 1024) -> tuple[np.ndarray, int]:
    """Centres of an inverted-file index by k-means, and how many cells a query must look into.

    Both are fitted on ``sample`` rows at most, chosen by a hash of their id:
    about as many cells as the square root of the number of rows, and the
    fewest probes that find ``recall`` of the exact ``k`` best for rows of
    the sample.
    """
    n = points.count()
    x = np.array([r["v"] for r in points.select("v").orderBy(F.xxhash64("vec_id")).limit(sample).collect()], np.float64)
    cells = max(1, min(int(n**0.5), most_cells, len(x) // 8))
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        centres = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    asked = x[:: max(1, len(x) // 256)]
    own = (x @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # of each cell, for each query
    best = np.argsort(-(asked @ x.T), axis=1)[:, 1 : k + 1]
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel()) + 1
    return centres, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def cell_top_k(queries: DataFrame, points: DataFrame, k: int, recall: float = 0.95) -> DataFrame:
    """Approximate top-k: every point lies in one cell, and a query looks into the nearest cells, see ``fit_cells``."""
    if points.isEmpty():
        return top_k(queries.select("query_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).limit(0), ["query_id"], k)
    centres, probes = fit_cells(points, k, recall)
    q = _nearest(queries, centres, probes, "query_id").withColumnRenamed("v", "qv")
    p = _nearest(points, centres, 1, "vec_id").withColumnRenamed("v", "pv")
    scored = q.join(p, "cell").select("query_id", "vec_id", F.round(dot(F.col("qv"), F.col("pv")), 6).alias("score"))
    return top_k(scored, ["query_id"], k)


def every_pair(left: DataFrame, right: DataFrame, most: int = 10_000) -> DataFrame:
    """Each row of ``left`` with each of ``right``, which is repeated where it has ``most`` rows at most, else met in blocks."""
    if right.limit(most + 1).count() <= most:
        return left.crossJoin(F.broadcast(right))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = right.withColumn("_g", F.pmod(F.xxhash64(*right.columns), F.lit(parts)).cast("int"))
    return left.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(blocks, "_g").drop("_g")


def scope_quota(budget: Column, ratio: Column, directed: Column, n_supplement: Column) -> Column:
    """Places for the supplement of a directed search: between 1 and budget - 1; 0 when global, empty or without ratio."""
    share = F.least(budget - 1, F.greatest(F.lit(1), F.floor(budget * ratio + 0.5).cast("int")))
    return F.when(~directed | (n_supplement == 0) | (ratio <= 0) | (budget <= 0), F.lit(0)).otherwise(F.greatest(F.lit(0), share))


def finite_first(score: Column) -> Column:
    """A sort value: the score, or lowest of all where it is null, NaN or infinite."""
    return F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), F.lit(float("-inf"))).otherwise(score)
