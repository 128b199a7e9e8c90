"""Exact top-k search by inner product: ball trees for shards of the vectors.

Vectors are cut into shards of bounded size around pivots, and each shard is
a ball tree.  A ball with centre c and radius r holds no vector whose inner
product with q exceeds q.c + r|q|, so a search takes the balls by that bound
and leaves out all that can't reach the k-th score found so far.  That score
is shared: every query first searches the shard of its own pivot, then goes
to the shards of those cells that can reach the score it has, and shards that
a task searches one after another pass on what they raised it to.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import cut_lineage

SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK = 4096, 64, 256
#: Pivots come from so many rows at most, those with the smallest hash of their id.
PIVOTS, PIVOT_SAMPLE = 64, 4096
#: Scores up to here are exact in double precision.
EXACT = 2.0**52


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, v array<double>``: floor(scale * x) of each component, x as double.

    Vectors that are null, empty or hold a null or non-finite component are
    left out, and so are rows without an id.
    """
    x = F.transform(F.col(vector_col), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"))
    fine = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), x.alias("v")
    )


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class BallTree:
    """Nodes in preorder: centre, radius, smallest id, row range and the node behind the subtree."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.centre, self.radius, self.low, self.span, self.children = [], [], [], [], []
        self._build(0, len(ids))
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _build(self, a: int, b: int) -> int:
        at, part = len(self.low), self.rows[a:b]
        centre = part.mean(axis=0)
        far = np.sqrt(((part - centre) ** 2).sum(axis=1))
        self.centre.append(centre)
        self.radius.append(float(far.max()) * (1 + 1e-9) + 1e-6)
        self.low.append(int(self.ids[a:b].min()))
        self.span.append((a, b))
        self.children.append(None)
        if b - a > LEAF_ROWS and far.max() > 0:
            one = part[far.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            order = np.argsort(part @ (other - one), kind="stable")
            self.ids[a:b], self.rows[a:b] = self.ids[a:b][order], part[order]
            middle = (a + b) // 2
            left = self._build(a, middle)
            self.children[at] = (left, self._build(middle, b))
        return at

    def search(self, own: np.ndarray, queries: np.ndarray, top: "Top") -> None:
        """Raise ``top`` for a block of queries; a query never meets its own id."""
        norms = np.sqrt((queries**2).sum(axis=1))
        bounds = queries @ self.centre.T + norms[:, None] * self.radius * (1 + 1e-9) + 1e-3
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, some = stack.pop()
            some = some[top.reachable(some, bounds[some, node], self.low[node])]
            if not len(some):
                continue
            if self.children[node] is None:
                a, b = self.span[node]
                top.offer(some, self.ids[a:b], inner(queries[some], self.rows[a:b]), own)
            else:
                one, other = self.children[node]
                if bounds[some, one].mean() > bounds[some, other].mean():
                    one, other = other, one
                stack += [(one, some), (other, some)]  # the higher bound is taken first


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as int64; beyond double precision they are taken in whole numbers."""
    if len(a) and len(b) and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= EXACT:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.rint(a @ b.T).astype(np.int64)


class Top:
    """The k best (score, id) of each query of a block."""

    def __init__(self, n: int, k: int, floor: np.ndarray, floor_id: np.ndarray):
        self.k, self.floor, self.floor_id = k, floor.copy(), floor_id.copy()
        self.score = [np.empty(0, np.int64)] * n
        self.id = [np.empty(0, np.int64)] * n

    def reachable(self, some: np.ndarray, bound: np.ndarray, low: int) -> np.ndarray:
        return (bound > self.floor[some]) | ((bound + 1 > self.floor[some]) & (low <= self.floor_id[some]))

    def offer(self, some: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
        for i, q in enumerate(some.tolist()):
            fit = (scores[i] > self.floor[q]) | ((scores[i] == self.floor[q]) & (ids <= self.floor_id[q]))
            fit &= ids != own[q]
            if not fit.any():
                continue
            s, v = np.concatenate([self.score[q], scores[i][fit]]), np.concatenate([self.id[q], ids[fit]])
            best = np.lexsort((v, -s))[: self.k]
            self.score[q], self.id[q] = s[best], v[best]
            if len(best) == self.k and (s[best[-1]], -v[best[-1]]) > (self.floor[q], -self.floor_id[q]):
                self.floor[q], self.floor_id[q] = s[best[-1]], v[best[-1]]


def _pivots(points: DataFrame) -> dict[int, np.ndarray]:
    """For each length of a bounded sample far-apart rows of it, chosen greedily."""
    sample = points.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    out = {}
    for width in {len(r["v"]) for r in sample}:
        rows = np.array([r["v"] for r in sample if len(r["v"]) == width], np.float64)
        chosen, far = [0], ((rows - rows[0]) ** 2).sum(axis=1)
        while len(chosen) < PIVOTS and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        out[width] = rows[chosen]
    return out


def _pivots_of(pivots: dict[int, np.ndarray], width: int) -> np.ndarray:
    """A length that the sample does not hold has one cell around the origin."""
    return pivots.get(width, np.zeros((1, width)))


def _with_cell(points: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vec_id, v, cell, far``: the cell of the nearest pivot of the same length, and the distance to it."""

    def nearest(batches):
        import pyarrow as pa

        for batch in batches:
            widths = batch.column("v").value_lengths().to_numpy()
            for width in np.unique(widths).tolist():
                mine = batch.take(pa.array(np.flatnonzero(widths == width)))
                v, own = _matrix(mine.column("v")), _pivots_of(pivots, width)
                at = (v @ own.T - (own**2).sum(axis=1) / 2).argmax(axis=1)
                far = np.sqrt(((v - own[at]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [mine.column("vec_id"), mine.column("v"), pa.array(at + width * PIVOTS), pa.array(far)], names=["vec_id", "v", "cell", "far"]
                )

    return points.mapInArrow(nearest, "vec_id long, v array<double>, cell long, far double")


def _with_reachable(queries: DataFrame, pivots: dict[int, np.ndarray], cells: dict[int, tuple[float, int]]) -> DataFrame:
    """``queries`` with ``cells``, those of the same length that can hold a vector as good as the score they have.

    ``cells`` has the radius around the pivot and the smallest id of each.
    """

    def reached(batches):
        import pyarrow as pa

        for batch in batches:
            widths = batch.column("v").value_lengths().to_numpy()
            for width in np.unique(widths).tolist():
                mine = batch.take(pa.array(np.flatnonzero(widths == width)))
                own = np.array([c for c in cells if c // PIVOTS == width], np.int64)
                v, floor, floor_id = _matrix(mine.column("v")), mine.column("floor").to_numpy(), mine.column("floor_id").to_numpy()
                if not len(own):
                    continue
                centre, (radius, low) = _pivots_of(pivots, width)[own % PIVOTS], np.array([cells[c] for c in own.tolist()]).T
                bound = v @ centre.T + np.sqrt((v**2).sum(axis=1))[:, None] * (radius * (1 + 1e-9) + 1e-6) * (1 + 1e-9) + 1e-3
                fit = (bound > floor[:, None]) | ((bound + 1 > floor[:, None]) & (low <= floor_id[:, None]))
                lists = pa.array([own[f].tolist() for f in fit], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*mine.columns, lists], names=[*mine.schema.names, "cells"])

    return queries.mapInArrow(reached, "vec_id long, v array<double>, floor double, floor_id long, cells array<long>")


def _shards(points: DataFrame) -> DataFrame:
    """One row for each shard: its cell, its part and packed ids and rows.

    A cell is dealt by a hash of the id into as many parts as keep a part
    near ``SHARD_ROWS`` rows, so copies of one vector never meet in one task.
    """
    sizes = points.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / SHARD_ROWS)).cast("int").alias("parts"))
    dealt = points.join(sizes, "cell")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def packed(batches):
        import pyarrow as pa

        def row(key, ids, rows):
            ids, rows = np.concatenate(ids), np.concatenate(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([rows.astype("<f8").tobytes()])],
                names=["cell", "part", "ids", "rows"],
            )

        key, ids, rows = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, parts = batch.column("cell").to_numpy(), batch.column("part").to_numpy()
            v, n = batch.column("v"), batch.column("vec_id").to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(parts) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if key is not None and key != (cells[a], parts[a]):
                    yield row(key, ids, rows)
                    ids, rows = [], []
                key = (int(cells[a]), int(parts[a]))
                ids.append(n[a:b])
                rows.append(_matrix(v.slice(a, b - a)))
        if key is not None:
            yield row(key, ids, rows)

    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(
        packed, "cell long, part int, ids binary, rows binary"
    )


def _blocks(queries: DataFrame, key: str) -> DataFrame:
    """Queries packed into rows of at most ``QUERY_BLOCK``, by cell and a hash of the id."""

    def packed(batches):
        import pyarrow as pa

        held: dict = {}

        def row(k):
            own, v, floor, floor_id = (np.concatenate(x) for x in held.pop(k))
            return pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int64()), *(pa.array([x.astype(t).tobytes()]) for x, t in ((own, "<i8"), (v, "<f8"), (floor, "<f8"), (floor_id, "<i8")))],
                names=["cell", "own", "v", "floor", "floor_id"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(key).to_numpy()
            for k in np.unique(cells).tolist():
                mine = batch.take(pa.array(np.flatnonzero(cells == k)))
                cols = [mine.column("vec_id").to_numpy(), _matrix(mine.column("v")), mine.column("floor").to_numpy(), mine.column("floor_id").to_numpy()]
                for at in range(0, len(cols[0]), QUERY_BLOCK):
                    for lists, x in zip(held.setdefault(k, ([], [], [], [])), cols, strict=True):
                        lists.append(x[at : at + QUERY_BLOCK])
                    if sum(map(len, held[k][0])) >= QUERY_BLOCK:
                        yield row(k)
        for k in list(held):
            yield row(k)

    return queries.mapInArrow(packed, "cell long, own binary, v binary, floor binary, floor_id binary")


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score`` for rows that hold a block of queries and a shard."""

    def found(batches):
        import pyarrow as pa

        shared: dict[bytes, Top] = {}
        built: tuple = (None, None)
        for batch in batches:
            for r in range(batch.num_rows):
                own_raw, shard = batch.column("own")[r].as_py(), batch.column("ids")[r].as_py()
                own = np.frombuffer(own_raw, "<i8")
                queries = np.frombuffer(batch.column("v")[r].as_py(), "<f8").reshape(len(own), -1)
                if built[0] != shard:
                    ids = np.frombuffer(shard, "<i8")
                    rows = np.frombuffer(batch.column("rows")[r].as_py(), "<f8").reshape(len(ids), -1)
                    built = (shard, BallTree(ids, rows) if rows.shape[1] == queries.shape[1] else None)
                if built[1] is None or built[1].rows.shape[1] != queries.shape[1]:
                    continue
                floor, floor_id = np.frombuffer(batch.column("floor")[r].as_py(), "<f8"), np.frombuffer(batch.column("floor_id")[r].as_py(), "<i8")
                last = shared.get(own_raw)
                top = Top(len(own), k, floor if last is None else last.floor, floor_id if last is None else last.floor_id)
                built[1].search(own, queries, top)
                if len(shared) > 64:
                    shared.clear()
                shared[own_raw] = top
                n = [len(x) for x in top.id]
                if sum(n):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(own, n)), pa.array(np.concatenate(top.id)), pa.array(np.concatenate(top.score))],
                        names=["query_id", "vec_id", "score"],
                    )

    return pairs.mapInArrow(found, "query_id long, vec_id long, score long")


def _one_of_each(rows: DataFrame) -> DataFrame:
    """One vector for each id, the largest as an array, so that the choice is the same in every run."""
    return rows.groupBy("vec_id").agg(F.max("v").alias("v"))


def top_k_inner_product(points: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Each query's ``k`` highest inner products: ``query_id, rank, vec_id, score``.

    Both sides are ``vec_id, v`` with whole-number components, as made by
    ``integer_vectors``.  A query never finds its own id; ties go to the
    smaller ``vec_id``; with fewer candidates all are returned; vectors of
    another length than the query's are no candidates.  Of rows that repeat an
    id the largest vector counts, compared as an array from its first
    component on.  Scores must fit a long.  Empty sides give an empty result.
    """
    points = cut_lineage(_one_of_each(points))
    pivots = _pivots(points)
    placed = _with_cell(points, pivots)
    shards = cut_lineage(_shards(placed))
    # PIVOTS cells for each length of vectors.
    cells = {r["cell"]: (r["radius"], r["low"]) for r in placed.groupBy("cell").agg(F.max("far").alias("radius"), F.min("vec_id").alias("low")).collect()}
    asked = _with_cell(_one_of_each(queries), pivots)
    asked = cut_lineage(asked.withColumns({"floor": F.lit(float("-inf")), "floor_id": F.lit(-1).cast("long")}))

    ranked = lambda hits: hits.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))), 1, k).alias("best")
    )
    # First the shards of the query's own cell: only part 0 is needed for a good k-th score.
    first = _search(_blocks(asked, "cell").join(shards.filter("part = 0"), "cell"), k)
    seeded = ranked(first).filter(F.size("best") == k).select(
        F.col("query_id").alias("vec_id"),
        (-F.element_at("best", -1)["s"]).cast("double").alias("seed"),
        F.element_at("best", -1)["v"].alias("seed_id"),
    )
    raised = asked.join(seeded, "vec_id", "left").select(
        "vec_id", "v", F.coalesce("seed", "floor").alias("floor"), F.coalesce("seed_id", "floor_id").alias("floor_id")
    )
    # Then a query meets the shards of the cells that its score leaves; a block is repeated for each group of shards, not for each row.
    groups = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grouped = shards.withColumn("_group", F.pmod(F.xxhash64("cell", "part"), F.lit(groups)).cast("int"))
    asks = _with_reachable(raised, pivots, cells).withColumn("cell", F.explode("cells")).drop("cells").repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    # At most PIVOTS times ``groups`` rows for each length of vectors.
    where = grouped.select("cell", "_group").distinct()
    blocks = _blocks(asks, "cell").join(where, "cell")
    hits = _search(blocks.join(grouped, ["cell", "_group"]).sortWithinPartitions("cell", "part"), k)
    best = ranked(hits)
    return best.select("query_id", F.posexplode("best").alias("_at", "_hit")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_hit")["v"].alias("vec_id"), (-F.col("_hit")["s"]).alias("score")
    )
