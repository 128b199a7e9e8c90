"""Near-duplicate links by exact Jaccard similarity of word n-grams.

The n-grams of a text are hashed into groups, and the counts of its groups
are a point.  Two sets share at most the sum of the smaller coordinates of
their points, and an R-tree over points bounds this for whole boxes: boxes
that can't reach the overlap that the similarity asks for are left out, and
the pairs that survive are verified on the sets themselves.  Larger sets have
more groups, a number that doubles with their size, so that chance fills no
pair up to the overlap; what survives the tree is bounded again by the most
groups that both sets of a pair have.

Points meet in blocks.  Similar sets share an n-gram among the first few of
each in any common order, so a block holds the sets with one such n-gram.
N-grams found in very many sets come last in the order.  A set whose size and
place of the n-gram leave no partner in the block is left out of it.  Within
a block first a forest of the surviving pairs is verified; pairs inside a
component need no check then, and all surviving pairs between components are
verified in later rounds, so that no link between components is lost.

N-grams travel in arrays by part of their hash, not in rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import cut_lineage, dealt_arrays, forget, in_few_tasks, packed, salted_join, trimmed, unpacked, weighted_join, written
from lexstrata.llm.components import connected_components
from lexstrata.llm.grams import gram_sets

#: Least coordinates of a point, n-grams of a coordinate at most, sets of a block, and points of an R-tree leaf.
GROUPS, FILL, BLOCK, LEAF = 128, 2, 512, 24
#: Counts of pairs that are compared together.
COMPARED = 1 << 20
#: An n-gram found in more than ``BLOCK`` sets, and in more than one in ``SHARE`` of all leading places, is dealt into
#: parts.  There are fewer than ``SHARE`` of these, whatever the input, and no other is more than one in ``SHARE`` of the rows.
SHARE = 1 << 20
#: Leading n-grams that a task gathers before it deals them out, and that a part holds.
GATHERED, PART = 400_000, 200_000
#: Texts that are verified together.
ROWS = 500


def set_name(grams: np.ndarray) -> bytes:
    """96 bits that name a set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=12).digest()


def point(grams: np.ndarray) -> bytes:
    """The bits of a count, and the counts of the groups; there are ``GROUPS``, doubled until at most ``FILL`` n-grams fall on one."""
    groups = GROUPS
    while groups * FILL < len(grams):
        groups *= 2
    counts = np.bincount(((grams >> np.uint64(11)) % np.uint64(groups)).astype(np.int64), minlength=groups)
    if counts.max() < 1 << 4:
        return bytes([4]) + (counts[::2] + 16 * counts[1::2]).astype("<u1").tobytes()
    bits = 8 if counts.max() < 1 << 8 else 16 if counts.max() < 1 << 16 else 32
    return bytes([bits]) + counts.astype(f"<u{bits // 8}").tobytes()


def counts_of(packed: bytes) -> np.ndarray:
    bits = packed[0]
    if bits > 4:
        return np.frombuffer(packed, f"<u{bits // 8}", offset=1)
    two = np.frombuffer(packed, "<u1", offset=1)
    return np.stack([two & 15, two >> 4], axis=1).ravel()


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The counts of fewer groups."""
    return counts.reshape(-1, groups).sum(axis=0, dtype=np.int32)


class Points:
    """Points of a block: all with ``GROUPS`` groups for the tree, and in pairs with the most that both have."""

    def __init__(self, packed: list[bytes]):
        self.own = [counts_of(x) for x in packed]
        self.groups = np.array([len(x) for x in self.own])
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.coarse = self._table(GROUPS)[1].astype(np.int64)

    def _table(self, groups: int) -> tuple[np.ndarray, np.ndarray]:
        if groups not in self.tables:
            rows = np.flatnonzero(self.groups >= groups)
            table = np.array([folded(self.own[i], groups) for i in rows.tolist()])
            self.tables[groups] = rows, table.astype(np.uint8) if table.max() < 1 << 8 else table
        return self.tables[groups]

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair the sum of its smaller coordinates."""
        out, both = np.zeros(len(i), np.int64), np.minimum(self.groups[i], self.groups[j])
        for groups in np.unique(both).tolist():
            rows, table = self._table(groups)
            at = np.flatnonzero(both == groups)
            for some in (at[k : k + COMPARED // groups + 1] for k in range(0, len(at), COMPARED // groups + 1)):
                one, other = np.searchsorted(rows, i[some]), np.searchsorted(rows, j[some])
                out[some] = np.minimum(table[one], table[other]).sum(axis=1, dtype=np.int64)
        return out


def leading_size(n: int, share: tuple[int, int]) -> int:
    """So many first n-grams of a set of ``n`` must be looked at; none if only the same set is similar."""
    num, den = share
    return 0 if n * den // num <= n else n - -(-num * n // den) + 1


def leading(grams: np.ndarray, share: tuple[int, int], last: np.ndarray) -> np.ndarray:
    """The first n-grams of a set, one of which any other similar set has among its own first."""
    size = leading_size(len(grams), share)
    if size and len(last):
        late = last[np.minimum(np.searchsorted(last, grams), len(last) - 1)] == grams
        if late.any():
            grams = np.concatenate([grams[~late], grams[late]])
    return grams[:size]


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, print, n, sid, name, vec`` of each row; ``sid`` and ``name``, its first 8 bytes, are null for a text without words."""
    docs = docs.withColumn("print", F.xxhash64("text"))

    def found(batches):
        import pyarrow as pa

        for batch in batches:
            n, sid, vec = [], [], []
            for grams in gram_sets(batch.column("text"), words):
                n.append(len(grams))
                sid.append(set_name(grams) if len(grams) else None)
                vec.append(point(grams) if len(grams) else None)
            name = [None if s is None else int.from_bytes(s[:8], "little", signed=True) for s in sid]
            columns = [batch.column("doc_id"), batch.column("print"), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(name, pa.int64()), pa.array(vec, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "print", "n", "sid", "name", "vec"])

    return docs.mapInArrow(trimmed(found), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print long, n long, sid binary, name long, vec binary")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _counts(docs: DataFrame, words: int, share: tuple[int, int], last: np.ndarray, parts: int, changed: bool) -> DataFrame:
    """``key, c``: the leading n-grams found in more than ``BLOCK`` sets; equal sets that one task gathers count once.

    With ``changed`` only sets whose leading n-grams ``last`` has changed are counted.
    """

    def gathered(batches):
        keys, seen, held = [], set(), 0

        def send():
            found, counts = np.unique(np.concatenate(keys), return_counts=True)
            return dealt_arrays((_mix(found) % np.uint64(parts)).astype(np.int32), found.view(np.int64), counts)

        for batch in batches:
            for grams in gram_sets(batch.column("text"), words):
                size = leading_size(len(grams), share)
                if not size:
                    continue
                first = leading(grams, share, last)
                if changed and first[-1] == grams[size - 1]:
                    continue
                name = hash(grams.tobytes())
                if name in seen:
                    continue
                seen.add(name)
                keys.append(first)
                held += size
                if held >= GATHERED:
                    yield send()
                    keys, seen, held = [], set(), 0
        if keys:
            yield send()

    def summed(batches):
        import pyarrow as pa

        found = [(b.column("c0").flatten().to_numpy(), b.column("c1").flatten().to_numpy()) for b in batches if b.num_rows]
        if not found:
            return
        keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(counts, edges)
        often = total > BLOCK
        yield pa.RecordBatch.from_arrays([pa.array(keys[edges][often]), pa.array(total[often], pa.int64())], names=["key", "c"])

    dealt = docs.select("text").mapInArrow(trimmed(gathered), "part int, c0 array<long>, c1 array<long>")
    return dealt.repartition(parts, "part").mapInArrow(trimmed(summed), "key long, c long")


def _blocks(docs: DataFrame, words: int, share: tuple[int, int], last: np.ndarray, dealt: dict[int, int], parts: int) -> DataFrame:
    """``key, hot, gid, members``: names of the sets with one leading n-gram, in blocks of at most ``BLOCK``.

    Blocks with the same members have the same ``gid``.  ``hot`` marks the
    blocks of an n-gram that has or may have several; other blocks hold only
    sets that size and place leave a partner.
    """
    num, den = share
    split = np.array(sorted(dealt), np.uint64)
    split_to = np.array([dealt[k] for k in sorted(dealt)], np.int64)

    def gathered(batches):
        keys, names, places, seen, held = [], [], [], set(), 0

        def send():
            key, size = np.concatenate(keys), np.array([len(k) for k in keys])
            name, place = np.repeat(np.array(names, np.int64), size), np.concatenate(places)
            sub = np.full(len(key), -1, np.int64)
            if len(split):
                at = np.minimum(np.searchsorted(split, key), len(split) - 1)
                hot = split[at] == key
                sub[hot] = (name[hot].view(np.uint64) >> np.uint64(16)).astype(np.int64) % split_to[at[hot]]
            part = (_mix(key + sub.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            return dealt_arrays(part, key.view(np.int64), sub, name, place)

        for batch in batches:
            for grams in gram_sets(batch.column("text"), words):
                first = leading(grams, share, last)
                if not len(first):
                    continue
                name = int.from_bytes(set_name(grams)[:8], "little", signed=True)
                if name in seen:
                    continue
                seen.add(name)
                keys.append(first)
                names.append(name)
                places.append((len(grams) << 32) + np.arange(len(first), dtype=np.int64))
                held += len(first)
                if held >= GATHERED:
                    yield send()
                    keys, names, places, seen, held = [], [], [], set(), 0
        if keys:
            yield send()

    def met(batches):
        import pyarrow as pa

        got = [[b.column(f"c{i}").flatten().to_numpy() for i in range(4)] for b in batches if b.num_rows]
        if not got:
            return
        key, sub, name, place = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.lexsort((name, sub, key))
        key, sub, name, place = key[order], sub[order], name[order], place[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
        once = new | np.concatenate([[True], name[1:] != name[:-1]])
        key, sub, name, place = key[once], sub[once], name[once], place[once]
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])]))
        sizes = np.diff(np.append(edges, len(key)))
        n, left = place >> 32, (place >> 32) - (place & 0xFFFFFFFF)
        hot = (sub[edges] >= 0) | (sizes > BLOCK)
        room = np.repeat(np.where(hot, 0, sizes), sizes)  # of the block, 0 for a hot one
        reach = np.repeat(edges, sizes) + room
        kept = room == 0
        live = np.flatnonzero(room > 1)
        for d in range(1, BLOCK):
            live = live[live + d < reach[live]]
            if not len(live):
                break
            other = live + d
            fit = (num + den) * np.minimum(left[live], left[other]) >= num * (n[live] + n[other])
            kept[live[fit]] = True
            kept[other[fit]] = True
        rows, seen = [], set()
        for at, size, many in zip(edges.tolist(), sizes.tolist(), hot.tolist(), strict=True):
            if size < 2 and not many:
                continue
            some = name[at : at + size][kept[at : at + size]]
            for a in range(0, len(some), BLOCK):
                block = some[a : a + BLOCK]
                if len(block) < 2 and not many:
                    continue
                gid = hashlib.blake2b(block.tobytes() + (key[at : at + 1].tobytes() if many else b""), digest_size=12).digest()
                if gid not in seen:
                    seen.add(gid)
                    rows.append((int(key[at]), many, gid, block))
            if len(rows) > 2000:
                yield send_blocks(pa, rows)
                rows = []
        if rows:
            yield send_blocks(pa, rows)

    def send_blocks(pa, rows):
        k, h, g, m = zip(*rows, strict=True)
        members = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in m])), pa.int32()), pa.array(np.concatenate(m)))
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(h, pa.bool_()), pa.array(g, pa.binary()), members], names=["key", "hot", "gid", "members"])

    rows = docs.select("text").mapInArrow(trimmed(gathered), "part int, c0 array<long>, c1 array<long>, c2 array<long>, c3 array<long>")
    return rows.repartition(parts, "part").mapInArrow(trimmed(met), "key long, hot boolean, gid binary, members array<long>")


class RTree:
    """Points with their set sizes, in leaves of neighbours under boxes of largest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, finer: Points | None = None):
        self.points, self.sizes, self.finer = points, sizes, finer
        self.nodes: list[tuple[np.ndarray, int, np.ndarray | None, int, int]] = []
        self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        part = self.points[rows]
        high, least = part.max(axis=0), int(self.sizes[rows].min())
        self.nodes.append((high, least, rows, -1, -1))
        if len(rows) > LEAF:
            axis = int((high - part.min(axis=0)).argmax())
            order = rows[np.argsort(part[:, axis], kind="stable")]
            half = len(order) // 2
            one, other = self._build(order[:half]), self._build(order[half:])
            self.nodes[at] = (high, least, None, one, other)
        return at

    def survivors(self, share: tuple[int, int], labels: np.ndarray):
        """Leaf pairs with a mask of the pairs whose shared coordinates reach the overlap; equal labels are left out.

        ``labels`` may change between two steps.
        """
        num, den = share
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            high_a, least_a, rows_a, a1, a2 = self.nodes[a]
            high_b, least_b, rows_b, b1, b2 = self.nodes[b]
            if a != b and (num + den) * int(np.minimum(high_a, high_b).sum()) < num * (least_a + least_b):
                continue
            if rows_a is None and (rows_b is None or a == b):
                stack += [(a1, a1), (a1, a2), (a2, a2)] if a == b else [(a1, b1), (a1, b2), (a2, b1), (a2, b2)]
            elif rows_a is None:
                stack += [(a1, b), (a2, b)]
            elif rows_b is None:
                stack += [(a, b1), (a, b2)]
            else:
                differ = labels[rows_a][:, None] != labels[rows_b][None, :]
                if differ.any():
                    shared = np.minimum(self.points[rows_a][:, None, :], self.points[rows_b][None, :, :]).sum(axis=2, dtype=np.int64)
                    fit = (num + den) * shared >= num * (self.sizes[rows_a][:, None] + self.sizes[rows_b][None, :])
                    if a == b:
                        fit &= np.triu(np.ones(fit.shape, bool), 1)
                    fit &= differ
                    if self.finer is not None and fit.any():
                        i, j = np.nonzero(fit)
                        x, y = rows_a[i], rows_b[j]
                        fit[i, j] = (num + den) * self.finer.shared(x, y) >= num * (self.sizes[x] + self.sizes[y])
                    yield rows_a, rows_b, fit


def forest(points: np.ndarray, sizes: np.ndarray, share: tuple[int, int], finer: Points | None = None) -> list[tuple[int, int]]:
    """Surviving pairs that connect all that the surviving pairs of a block connect."""
    num, den = share
    labels = np.arange(len(points))
    star = (num + den) * np.minimum(points, points[0]).sum(axis=1, dtype=np.int64) >= num * (sizes + sizes[0])
    if finer is not None:
        some = np.flatnonzero(star)
        star[some] = (num + den) * finer.shared(np.zeros_like(some), some) >= num * (sizes[some] + sizes[0])
    out = [(0, i) for i in np.flatnonzero(star).tolist() if i]
    labels[star] = 0
    if star.all():
        return out
    for rows_a, rows_b, fit in RTree(points, sizes, finer).survivors(share, labels):
        while fit.any():
            i, j = np.unravel_index(int(fit.argmax()), fit.shape)
            a, b = int(rows_a[i]), int(rows_b[j])
            out.append((a, b))
            labels[labels == labels[b]] = labels[a]
            fit &= labels[rows_a][:, None] != labels[rows_b][None, :]
    return out


def _candidate_pairs(members: DataFrame, share: tuple[int, int], mode: str) -> DataFrame:
    """``a, b, near`` from blocks ``gid, sid, n, vec, label``: surviving pairs and the similarity that their points allow.

    ``forest``: pairs that connect what survives in a block; ``best``: the
    nearest pair of each two labels of a block; ``all``: all pairs between
    labels.
    """

    def found(batches):
        import pyarrow as pa

        def pairs(rows):
            sids, sizes, vecs, labels = zip(*sorted({r[0]: r for r in rows}.values()), strict=True)  # a repeated row has its set twice
            points = Points(vecs)
            sizes = np.array(sizes, np.int64)

            def near(i, j):
                shared = points.shared(i, j)
                return shared / (sizes[i] + sizes[j] - shared)

            if mode == "forest":
                found = np.array(forest(points.coarse, sizes, share, points), np.int64).reshape(-1, 2)
                chosen = zip(*found.T.tolist(), near(*found.T).tolist(), strict=True)
            else:
                names = {x: i for i, x in enumerate(dict.fromkeys(labels))}
                kinds = np.array([names[x] for x in labels])
                chosen, best = [], {}
                for rows_a, rows_b, fit in RTree(points.coarse, sizes, points).survivors(share, kinds):
                    at = np.nonzero(fit)
                    i, j = rows_a[at[0]], rows_b[at[1]]
                    if not len(i):
                        continue
                    score = near(i, j)
                    if mode == "all":
                        chosen += zip(i.tolist(), j.tolist(), score.tolist(), strict=True)
                        continue
                    low, high = np.minimum(kinds[i], kinds[j]), np.maximum(kinds[i], kinds[j])
                    order = np.lexsort((-score, high, low))
                    head = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
                    for k in order[head].tolist():
                        name = (int(low[k]), int(high[k]))
                        if name not in best or best[name][2] < score[k]:
                            best[name] = (int(i[k]), int(j[k]), float(score[k]))
                chosen = chosen or best.values()
            for i, j, score in chosen:
                yield (*sorted((sids[i], sids[j])), score)

        def send(rows):
            a, b, score = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(score, pa.float64())], names=["a", "b", "near"])

        gid, rows, out = None, [], []
        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("gid", "sid", "n", "vec", "label")), strict=True):
                if g != gid:
                    if len(rows) > 1:
                        out += pairs(rows)
                    if len(out) > 20_000:
                        yield send(out)
                        out = []
                    gid, rows = g, []
                rows.append(tuple(row))
        if len(rows) > 1:
            out += pairs(rows)
        if out:
            yield send(out)

    dealt = members.select("gid", "sid", "n", "vec", "label").repartition("gid").sortWithinPartitions("gid")
    return dealt.mapInArrow(trimmed(found), "a binary, b binary, near double").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """The pairs whose sets are similar; ``texts`` are packed and ``a`` may be in very many pairs and is then dealt over tasks."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("_parts"), F.count("*").alias("_n"))
    asks = cut_lineage(weighted_join(pairs, counts, ["a"], F.col("b"), "inner", "_n").withColumn("part", F.pmod(F.xxhash64("b"), F.col("_parts"))))
    own = asks.select("a", "part", F.col("a").alias("sid"), F.lit(None).cast("binary").alias("b")).distinct()
    rows = own.unionByName(asks.select("a", "part", F.col("b").alias("sid"), "b")).join(texts, "sid").select("a", "part", "b", "text")

    def found(batches):
        import pyarrow as pa

        num, den = share
        key, base = None, np.empty(0, np.uint64)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out = []
            texts = pa.array([x.decode("utf-8", "surrogatepass") for x in unpacked(batch.column("text"))], pa.large_string())
            for a, part, b, grams in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b")), gram_sets(texts, words), strict=True):
                if set_name(grams) != (a if b is None else b):
                    continue  # another text of a repeated id
                if b is None:
                    key, base = (a, part), grams
                elif key == (a, part):
                    both = int((base[np.minimum(np.searchsorted(base, grams), len(base) - 1)] == grams).sum())
                    if den * both >= num * (len(base) + len(grams) - both):
                        out.append((a, b))
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(trimmed(found), "a binary, b binary")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (80, 100)
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row.

    Two documents link when ``den * intersection >= num * union`` of their
    sets of distinct word n-grams, ``share = (num, den)``; a component is
    what links reach, named by its smallest id.  A null, empty or blank text
    has no n-grams and links with nothing, not even its like.  Each row of
    a repeated id gets the component of its own set; two sets with the same
    smallest id count as linked.  A row without an id gets the component of
    its set, null if it is alone.  Other columns are ignored.
    """
    return _components(docs, id_col, text_col, words, share).drop("print")


def _often(counts: DataFrame, total: int) -> dict[int, int]:
    """The counts of fewer than ``SHARE`` n-grams, see there."""
    return {r["key"] % (1 << 64): r["c"] for r in counts.filter(F.col("c") > max(BLOCK, total // SHARE)).collect()}


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, share: tuple[int, int]) -> DataFrame:
    """``near_duplicates`` with ``print``, the hash of the row's text."""
    num, den = share
    if not 0 < num <= den:
        raise ValueError("share must lie in (0, 1]")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = written(_prints(docs, words), "jaccard-prints")
    known = docs.filter("doc_id is not null")
    classes = prints.filter("n > 0 and doc_id is not null").groupBy("sid", "name").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    classes = written(classes, "jaccard-classes")

    leads = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    total = prints.filter("n > 0 and doc_id is not null").agg(F.sum(leads).alias("n")).first()["n"] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(total) // PART)
    hot = _often(_counts(known, words, share, np.empty(0, np.uint64), parts, False), total)
    last = np.array(sorted(hot), np.uint64)
    # Other n-grams lead where those have gone to the end.
    hot = hot | (_often(_counts(known, words, share, last, parts, True), total) if len(last) else {})
    blocks = written(_blocks(known, words, share, last, {k: -(-2 * c // BLOCK) for k, c in hot.items()}, parts), "jaccard-blocks")

    members = blocks.groupBy("gid").agg(F.first("members").alias("m")).select("gid", F.explode("m").alias("name"))
    # Sets in blocks, with their points; other sets are alone.
    met = members.select("name").distinct()
    named = classes.join(met, "name", "left_semi").select("sid", "rep")
    sized = prints.select("doc_id", "sid", "name", "n", "vec").join(named.withColumnRenamed("rep", "doc_id"), ["sid", "doc_id"]).select("sid", "name", "n", "vec")
    sized = written(sized, "jaccard-points")
    inside = written(members.join(sized.select("name", "sid"), "name").select("gid", "sid").distinct(), "jaccard-members")
    rows_inside = inside.count()
    few = lambda df: in_few_tasks(df, rows_inside)
    inside, blocks = few(inside), few(blocks)
    points = sized.select("sid", "n", "vec")
    pairs = _candidate_pairs(inside.join(points, "sid").withColumn("label", F.lit(None).cast("binary")), share, "forest")
    # The blocks of one n-gram meet in the first set of all.
    ids = few(sized.select("name", "sid").distinct())
    heads = few(blocks.filter("hot").select("key", F.element_at("members", 1).alias("name")).join(ids, "name")).select("key", F.col("sid").alias("b"))
    hubs = few(heads.groupBy("key").agg(F.min("b").alias("a")))
    joined = few(heads.join(hubs, "key")).filter("a < b").select("a", "b", F.lit(0.0).alias("near"))
    pairs = cut_lineage(few(pairs.unionByName(joined).distinct()))
    # A set outside of this forest has no surviving pair in its blocks, but may have one across the blocks of an n-gram.
    across = few(few(blocks.filter("hot").select("gid").distinct()).join(inside, "gid")).select("sid")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(across).distinct().join(classes, "sid").select("sid", F.col("rep").alias("doc_id"))
    texts = written(packed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).join(wanted, "doc_id").select("sid", "text"), "jaccard-texts")

    # Each set is first checked with its nearest and its first partner.  Later rounds see to all that still lies between components.
    picked = few(pairs.groupBy("b").agg(F.max_by("a", "near").alias("x"), F.min("a").alias("y")))
    tested = cut_lineage(picked.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), "b"))
    same = classes.groupBy("rep").agg(F.min("sid").alias("a"), F.count("*").alias("_k")).filter("_k > 1").join(classes, "rep").select("a", F.col("sid").alias("b"))
    links = cut_lineage(_verified(tested, texts, words, share).unionByName(same))
    parts_of = connected_components(links, "a", "b")
    for mode in ("best", "all"):
        labelled = few(inside.join(parts_of.withColumnRenamed("node", "sid"), "sid", "left")).select("gid", "sid", F.coalesce("component", "sid").alias("label"))
        labelled = written(labelled, "jaccard-labels")
        mixed = few(labelled.groupBy("gid").agg(F.min("label").alias("_x"), F.max("label").alias("_y"))).filter("_x <> _y").select("gid")
        rest = _candidate_pairs(few(few(labelled.join(mixed, "gid", "left_semi")).join(points, "sid")), share, mode)
        rest = few(rest).unionByName(few(_across_blocks(blocks, labelled, hubs, points, share, mode, few))).select("a", "b").distinct()
        rest = cut_lineage(few(few(rest).join(tested, ["a", "b"], "left_anti")))
        forget(labelled)
        if rest.isEmpty():
            continue
        more = cut_lineage(_verified(rest, texts, words, share))
        tested = tested.unionByName(rest)
        if not more.isEmpty():
            links = links.unionByName(more)
            parts_of = connected_components(links, "a", "b")

    linked = classes.select("sid", "rep", "rows").join(parts_of.withColumnRenamed("node", "sid"), "sid").select("sid", "rep", "rows", F.col("component").alias("_top"))
    least = linked.groupBy("_top").agg(F.min("rep").alias("_c"), F.count("*").alias("_k"))
    found = weighted_join(linked, least, ["_top"], F.col("sid"), "inner", "_k").select("sid", "_c")
    named = classes.select("sid", "rep", "rows").join(found, "sid", "left").select("sid", "rows", F.coalesce("_c", "rep").alias("_c"))
    rows = prints.select("doc_id", "print", "n", "sid")
    with_set = weighted_join(rows.filter("sid is not null"), named, ["sid"], F.col("doc_id"), "left", "rows")
    alone = rows.filter("sid is null").withColumn("_c", F.col("doc_id"))
    return with_set.unionByName(alone).select("doc_id", "print", F.col("n").alias("n_shingles"), F.col("_c").alias("component_id"))


def _across_blocks(blocks: DataFrame, labelled: DataFrame, hubs: DataFrame, points: DataFrame, share: tuple[int, int], mode: str, few) -> DataFrame:
    """Surviving pairs between the blocks of one n-gram.

    Most sets of such an n-gram are in the component of its first set by now.
    The others, in blocks of their own, meet every block.
    """
    hot = few(blocks.filter("hot").select("key", "gid").distinct())
    rows = few(hot.join(labelled, "gid"))
    first = few(hubs.join(rows, (hubs["key"] == rows["key"]) & (hubs["a"] == rows["sid"]))).select(hubs["key"], F.col("label").alias("_hub"))
    marked = cut_lineage(few(salted_join(rows, first.distinct(), ["key"], F.col("sid"), "inner")))
    open_rows = few(marked.filter("label <> _hub").select("key", "sid", "label").distinct())
    sizes = few(open_rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_parts")))
    open_rows = few(salted_join(open_rows, sizes, ["key"], F.col("sid"), "inner")).withColumn("_part", F.pmod(F.xxhash64("sid"), F.col("_parts")).cast("int"))
    every = few(salted_join(marked, sizes, ["key"], F.col("sid"), "inner")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    name = lambda: F.concat("gid", F.col("_part").cast("string").cast("binary"))
    gids = few(marked.select("key", "gid").distinct())
    queries = salted_join(open_rows, gids, ["key"], F.col("sid"), "inner").select(name().alias("gid"), "sid", "label")
    meet = every.select(name().alias("gid"), "sid", "label").unionByName(queries).distinct()
    return _candidate_pairs(meet.join(points, "sid"), share, mode)


def keep_one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (80, 100)
) -> DataFrame:
    """The rows of ``docs`` whose id names their component, and those without an id, with all their columns."""
    found = _components(docs, id_col, text_col, words, share)
    lost = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_lost"), F.col("print").alias("_print")).distinct()
    return docs.join(lost, (docs[id_col] == lost["_lost"]) & (F.xxhash64(docs[text_col]) == lost["_print"]), "left_anti")
