"""Approximate vector search by several tables of random projections.

A table gives a vector the signs of its products with some random
directions.  A query looks into the buckets whose signs differ from its own
where the products are smallest, in every table, and what it finds there is
scored exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.operators.vectors import top_k

#: Signs that a query may turn over, which bounds its buckets in a table by 2 to this power.
TURNED = 6
#: Points, and queries, of a bucket that meet in one matrix product at most, about.
PIECE = 4096
#: Asked buckets that are repeated to the points at most; more are shuffled.
MOST_BUCKETS = 200_000


@dataclass(frozen=True)
class Projections:
    """``planes`` are tables x bits x dimensions; a query looks into ``probes`` buckets of each table."""

    planes: np.ndarray
    probes: int
    recall: float
    scored: float

    def products(self, v: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tbd->ntb", v, self.planes)

    def codes(self, v: np.ndarray) -> np.ndarray:
        """rows x tables."""
        return _packed(self.products(v) > 0)

    def probed(self, v: np.ndarray) -> np.ndarray:
        """rows x tables x probes, the likeliest first."""
        return _sequence(self.products(v))[:, :, : self.probes]


def _packed(signs: np.ndarray) -> np.ndarray:
    return (signs.astype(np.int64) << np.arange(signs.shape[-1])).sum(axis=-1)


def _sequence(products: np.ndarray) -> np.ndarray:
    """All buckets that differ in some of the weakest signs, by the sum of the squares that are turned over."""
    bits = products.shape[-1]
    turned = min(TURNED, bits)
    own = _packed(products > 0)
    weak = np.argsort(np.abs(products), axis=-1, kind="stable")[..., :turned]
    subsets = np.arange(1 << turned)[:, None] >> np.arange(turned) & 1
    cost = np.take_along_axis(products, weak, axis=-1) ** 2 @ subsets.T
    masks = (1 << weak.astype(np.int64)) @ subsets.T
    order = np.argsort(cost, axis=-1, kind="stable")
    return own[..., None] ^ np.take_along_axis(masks, order, axis=-1)


def fit(points: DataFrame, k: int, recall: float = 0.95, sample: int = 4096, bucket: int = 64, most_tables: int = 16, seed: int = 5) -> Projections:
    """Tables for unit vectors ``vec_id, v``: about ``bucket`` points in a bucket, and as few tables and probes as find ``recall``.

    Numbers are chosen on ``sample`` rows at most, taken by a hash of their
    id; of all that find the share of the ``k`` best there, the one that
    scores the fewest rows.  Neighbours in a sample are farther than in the
    whole, so the share of the whole is higher.
    """
    n = points.count()
    x = np.array([r["v"] for r in points.select("v").orderBy(F.xxhash64("vec_id")).limit(sample).collect()], np.float64)
    if not len(x):
        return Projections(np.zeros((1, 0, 0)), 1, 1.0, 1.0)
    bits = int(np.clip(round(np.log2(max(1, n / bucket))), 0, 30))
    planes = np.random.default_rng(seed).standard_normal((most_tables, bits, x.shape[1]))
    all_tables = Projections(planes, 1 << min(TURNED, bits), 0.0, 0.0)
    asked = np.arange(0, len(x), max(1, len(x) // 256))
    codes, probed = all_tables.codes(x), all_tables.probed(x[asked])
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    hit = np.zeros((most_tables, probed.shape[2], *best.shape), bool)  # by table and number of probes
    size = np.zeros((most_tables, probed.shape[2]))
    for t in range(most_tables):
        kinds, counts = np.unique(codes[:, t], return_counts=True)
        at = np.minimum(np.searchsorted(kinds, probed[:, t]), len(kinds) - 1)
        size[t] = np.where(kinds[at] == probed[:, t], counts[at], 0).mean(axis=0).cumsum() / len(x)
        same = codes[best, t][:, None, :] == probed[:, t][:, :, None]
        hit[t] = np.logical_or.accumulate(same, axis=1).transpose(1, 0, 2)
    found = np.logical_or.accumulate(hit, axis=0).mean(axis=(2, 3)) if best.size else np.ones(size.shape)
    cost = size.cumsum(axis=0)
    good = np.where(found >= recall, cost, np.inf)
    tables, probes = np.unravel_index(good.argmin(), good.shape) if np.isfinite(good).any() else (most_tables - 1, probed.shape[2] - 1)
    return Projections(planes[: tables + 1], int(probes) + 1, float(found[tables, probes]), float(cost[tables, probes]))


def _placed(rows: DataFrame, id_col: str, model: Projections, asking: bool) -> DataFrame:
    """``id_col, v, table, code`` for each table (and probe)."""

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            codes = model.probed(v) if asking else model.codes(v)[:, :, None]
            tables = np.broadcast_to(np.arange(codes.shape[1])[None, :, None], codes.shape)
            at = pa.array(np.repeat(np.arange(batch.num_rows), codes.shape[1] * codes.shape[2]))
            columns = [batch.column(id_col).take(at), batch.column("v").take(at), pa.array(tables.ravel().astype(np.int32)), pa.array(codes.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "v", "table", "code"])

    return rows.select(id_col, "v").mapInArrow(placed, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, v array<double>, table int, code long")


def projected_top_k(queries: DataFrame, points: DataFrame, k: int, recall: float = 0.95, model: Projections | None = None) -> DataFrame:
    """``query_id, vec_id, score, rank``: nearly the ``k`` nearest points of each query, scored exactly.

    Queries are ``query_id, v``, points ``vec_id, v``, of length 1, with whole
    numbers as ids.  Only points in asked buckets move.  A bucket of many
    points or queries is cut into pieces on both sides, so one that holds a
    third of all points is dealt over many tasks; each piece gives the ``k``
    best of its queries.
    """
    model = model or fit(points, k, recall)
    if not model.planes.shape[2]:
        return top_k(queries.select("query_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).limit(0), ["query_id"], k)
    asks, stands = _placed(queries, "query_id", model, True), _placed(points, "vec_id", model, False)
    keys = ["table", "code"]
    wanted = asks.groupBy(*keys).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("q_pieces"))
    if wanted.limit(MOST_BUCKETS + 1).count() <= MOST_BUCKETS:
        wanted = F.broadcast(wanted)
    met = stands.join(wanted, keys)
    sizes = met.groupBy(*keys).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"), F.max("q_pieces").alias("q_pieces"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    p = met.drop("q_pieces").join(sizes, keys).withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int")).withColumn("q_piece", each("q_pieces"))
    q = asks.join(sizes, keys).withColumn("q_piece", F.pmod(F.xxhash64("query_id"), F.col("q_pieces")).cast("int")).withColumn("piece", each("pieces"))
    keys = [*keys, "piece", "q_piece"]
    kind = queries.schema["query_id"].dataType.simpleString()

    def scored(left, right):
        import pyarrow as pa

        ids = right.column("vec_id").to_numpy().astype(np.int64)
        if not left.num_rows or not len(ids):
            return pa.table([left.column("query_id").slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        a, b = (t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (left, right))
        scores = np.round(a @ b.T, 6)
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
        at = pa.array(np.repeat(np.arange(left.num_rows), order.shape[1]))
        return pa.table([left.column("query_id").take(at), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(scores, order, axis=1).ravel())], names=["query_id", "vec_id", "score"])

    slim = lambda d, i: d.select(i, "v", *keys).groupBy(*keys)
    found = slim(q, "query_id").cogroup(slim(p, "vec_id")).applyInArrow(scored, f"query_id {kind}, vec_id long, score double")
    # A point may stand in several tables.
    return top_k(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), ["query_id"], k)
