"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text and cuts where its low bits are
zero, so the cuts follow the content and an insertion moves none behind the
next cut.  Chunks are deduplicated by digest: the first place of a digest, by
document and position, keeps its chunk.  Runs of later copies take all bytes
around them that equal those around their first place, and go where they are
long enough.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import cut_lineage, dealt_arrays, packed, trimmed, unpacked, weighted_join, written

#: Bytes of a chunk: least, most, and the cut mask (one place in 32 behind the least).
LEAST, MOST, MASK = 32, 256, np.uint32(31)
#: Shorter passages stay: phrases repeat by chance.
MIN_WORDS, MIN_BYTES = 51, 400
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
_BLOCK = 1 << 20
#: The halves of a digest.
NAME = np.dtype([("low", "<i8"), ("high", "<i4")])
#: Bytes on each side of a run that are compared: a neighbour that is not shared ends within them.
REACH = MOST
#: Digests that a task gathers before it deals them out, and texts that are cut together.
GATHERED, ROWS = 400_000, 500


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]] mod 2^32, which sees the last 32 bytes."""
    h, reach = GEAR[data], 1
    while reach < 32:
        older = h[:-reach] << np.uint32(reach)
        h = h.copy()
        h[reach:] += older
        reach *= 2
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of UTF-8 bytes; no cut falls within a character."""
    n = len(data)
    if not n:
        return []
    places = []
    for at in range(0, n, _BLOCK):  # 31 earlier bytes give each block the hash it would have in the whole
        begin = max(0, at - 31)
        h = gear_hash(data[begin : at + _BLOCK])[at - begin :]
        places.append(np.flatnonzero((h & MASK) == 0) + at + 1)
    found = np.concatenate(places)
    found = found[found < n]
    found = found[(data[found] & 0xC0) != 0x80].tolist()
    out, start = [], 0
    for end in found:
        if end - start < LEAST:
            continue
        while end - start > MOST:
            forced = start + MOST
            while data[forced] & 0xC0 == 0x80:
                forced -= 1
            out.append(forced)
            start = forced
        if end - start >= LEAST:
            out.append(end)
            start = end
    while n - start > MOST:
        forced = start + MOST
        while data[forced] & 0xC0 == 0x80:
            forced -= 1
        out.append(forced)
        start = forced
    out.append(n)
    return out


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=12).digest()


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pos, size, digest``: the chunks of every whole text, by byte position; null text has none."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def chunked(batches):
        import pyarrow as pa

        for batch in batches:
            owner, pos, size, digest = [], [], [], []

            def flush():
                columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(pos, pa.int64()), pa.array(size, pa.int32()), pa.array(digest, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "pos", "size", "digest"])

            for i, x in enumerate(batch.column("text")):
                data = (x.as_py() or "").encode("utf-8", "surrogatepass")
                start = 0
                for end in cuts(np.frombuffer(data, np.uint8)):
                    owner.append(i)
                    pos.append(start)
                    size.append(end - start)
                    digest.append(_digest(data[start:end]))
                    start = end
                if len(owner) >= 50_000:
                    yield flush()
                    for part in (owner, pos, size, digest):
                        part.clear()
            if owner:
                yield flush()

    return rows.mapInArrow(trimmed(chunked), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pos long, size int, digest binary")


def _summed(low: np.ndarray, high: np.ndarray, counts: np.ndarray):
    """Each name once, with the sum of its counts."""
    order = np.lexsort((high, low))
    low, high, counts = low[order], high[order], counts[order]
    edges = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
    return low[edges], high[edges], np.add.reduceat(counts, edges)


def _repeated_digests(docs: DataFrame, parts: int) -> DataFrame:
    """``digest, n`` of the chunks that stand more than once; digests travel in arrays by part, with their counts."""

    def send(found):
        low, high, counts = _summed(*(np.ascontiguousarray(np.frombuffer(b"".join(found), NAME)[x]) for x in ("low", "high")), np.ones(len(found), np.int64))
        return dealt_arrays((low.view(np.uint64) % np.uint64(parts)).astype(np.int32), low, high, counts)

    def gathered(batches):
        found: list[bytes] = []
        for batch in batches:
            for x in batch.column("text"):
                data = (x.as_py() or "").encode("utf-8", "surrogatepass")
                start = 0
                for end in cuts(np.frombuffer(data, np.uint8)):
                    found.append(_digest(data[start:end]))
                    start = end
                if len(found) >= GATHERED:
                    yield send(found)
                    found = []
        if found:
            yield send(found)

    def summed(batches):
        import pyarrow as pa

        got = [[b.column(f"c{i}").flatten().to_numpy() for i in range(3)] for b in batches if b.num_rows]
        if not got:
            return
        low, high, counts = _summed(*(np.concatenate(x) for x in zip(*got, strict=True)))
        many = counts > 1
        names = np.empty(many.sum(), NAME)
        names["low"], names["high"] = low[many], high[many]
        data = names.tobytes()
        digests = pa.array([data[i : i + 12] for i in range(0, len(data), 12)], pa.binary())
        yield pa.RecordBatch.from_arrays([digests, pa.array(counts[many])], names=["digest", "n"])

    dealt = docs.select("text").mapInArrow(trimmed(gathered), "part int, c0 array<long>, c1 array<int>, c2 array<long>")
    return dealt.repartition(parts, "part").mapInArrow(trimmed(summed), "digest binary, n long")


def _runs(later: DataFrame) -> DataFrame:
    """``doc_id, begin, end, fdoc, fbegin``: neighbouring chunks whose first places are neighbours too, joined."""
    kind = later.schema["doc_id"].dataType.simpleString()
    place = F.struct(F.col("pos").alias("begin"), "size", F.col("_first")["doc_id"].alias("fdoc"), F.col("_first")["pos"].alias("fbegin"))
    ordered = later.groupBy("doc_id").agg(F.array_sort(F.collect_set(place)).alias("_c"))

    def joined(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("_c")
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            begin, size, fbegin = (flat.field(x).to_numpy() for x in ("begin", "size", "fbegin"))
            fdoc = flat.field("fdoc").to_pylist()
            other = np.array([a != b for a, b in zip(fdoc, fdoc[1:], strict=False)], bool)
            end = begin + size
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (begin[1:] != end[:-1]) | (fbegin[1:] != fbegin[:-1] + size[:-1]) | other])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(new)) - 1
            columns = [batch.column("doc_id").take(pa.array(owner[head])), pa.array(begin[head]), pa.array(end[tail]), flat.field("fdoc").take(pa.array(head)), pa.array(fbegin[head])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "begin", "end", "fdoc", "fbegin"])

    return ordered.mapInArrow(trimmed(joined), f"doc_id {kind}, begin long, end long, fdoc {kind}, fbegin long")


def equal_bytes(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _edges(small: DataFrame, asks: DataFrame) -> DataFrame:
    """``asks``, ``fdoc, fbegin, fend, _n``, with ``before, behind``: the bytes around each first place, up to ``REACH`` on a side."""
    kind = small.schema["doc_id"].dataType.simpleString()
    per_doc = asks.groupBy(F.col("fdoc").alias("doc_id")).agg(F.collect_list(F.struct("fbegin", "fend", "_n")).alias("_w"))

    def sliced(batches):
        import pyarrow as pa

        last = None
        for batch in batches:
            owner, columns = [], [[] for _ in range(5)]
            for r, (key, data) in enumerate(zip(batch.column("doc_id").to_pylist(), unpacked(batch.column("text")), strict=True)):
                if key == last:
                    continue  # rows that repeat an id and its text come one behind another
                last = key
                for x in batch.column("_w")[r].as_py():
                    a, b = x["fbegin"], x["fend"]
                    owner.append(r)
                    for column, value in zip(columns, (a, b, x["_n"], data[max(0, a - REACH) : a], data[b : b + REACH]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            arrays = [batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["fdoc", "fbegin", "fend", "_n", "before", "behind"])

    joined = small.join(per_doc, "doc_id").select("doc_id", "text", "_w")
    return joined.mapInArrow(trimmed(sliced), f"fdoc {kind}, fbegin long, fend long, _n long, before binary, behind binary")


def whole_passages(data: bytes, runs: list[tuple[int, int, bytes, bytes]], min_words: int, min_bytes: int) -> list[tuple[int, int]]:
    """Ranges of ``data`` to take out: runs with all bytes that equal those around their first place, joined where they touch.

    A run is ``begin, end, before, behind``; the last two are the bytes around
    its first place.  A range counts if it touches ``min_words`` words or has
    ``min_bytes`` bytes; none ends within a character.
    """
    ranges = []
    for begin, end, before, behind in runs:
        a = begin - equal_bytes(data[max(0, begin - len(before)) : begin][::-1], before[::-1])
        b = end + equal_bytes(data[end : end + len(behind)], behind)
        while a < begin and data[a] & 0xC0 == 0x80:
            a += 1
        while end < b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        ranges.append((a, b))
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= min_bytes or len(data[a:b].split()) >= min_words]


def cut_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: each text's bytes without its spans.

    ``spans`` has ``doc_id, spans array<struct<begin,end>>`` with ordered,
    separate byte ranges.  Null text counts as empty.  Rows that repeat an id
    get their own row.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_data"))
    s = spans.select(F.col("doc_id").alias("_doc"), "spans")
    joined = d.join(s, d["doc_id"] == s["_doc"], "left")
    n = F.octet_length("_data").cast("long")
    count = F.size("spans")
    ends = F.transform("spans", lambda x: x["end"])
    begins = F.transform("spans", lambda x: x["begin"])
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), ends), F.concat(begins, F.array(n)), lambda a, b: F.substring(F.col("_data"), a.cast("int") + 1, (b - a).cast("int"))
    )
    kept = F.when(F.col("spans").isNull(), F.col("_data")).otherwise(F.unhex(F.array_join(F.transform(gaps, F.hex), "")))
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["begin"]), F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        n.alias("n_bytes"),
        removed.alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(count).cast("long").alias("n_spans"),
        kept.alias("kept"),
    )


def keyed_by_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` with a fingerprint of the text in the id, so that rows with one id and two texts stay apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("print")).alias("doc_id"), text.alias("text"))


def unkeyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("doc_id")["id"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Each text without the passages that stand at an earlier place.

    A passage is a run of shared chunks with all bytes, up to ``REACH`` on
    each side, that equal those around its first place; it goes if it touches
    ``min_words`` words or has ``min_bytes`` bytes.

    Returns one row for each input row: ``doc_id, n_bytes, n_removed, n_spans,
    kept`` (bytes).  Null text counts as empty; other columns are ignored; of
    rows that repeat an id and a text the copies lose theirs by position only.
    """
    docs = keyed_by_text(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = 4 * max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    often = _repeated_digests(docs, parts)
    shared = written(weighted_join(chunk_rows(docs), often, ["digest"], F.struct("doc_id", "pos"), "left_semi", "n"), "gear-shared")
    firsts = shared.groupBy("digest").agg(F.count("*").alias("_n"), F.min(F.struct("doc_id", "pos")).alias("_first"))
    copies = weighted_join(shared, firsts, ["digest"], F.struct("doc_id", "pos"), "inner", "_n")
    runs = written(_runs(copies.filter(~F.struct("doc_id", "pos").eqNullSafe(F.col("_first")))), "gear-runs")
    runs = runs.withColumn("fend", F.col("fbegin") + F.col("end") - F.col("begin"))
    asks = cut_lineage(runs.groupBy("fdoc", "fbegin", "fend").agg(F.count("*").alias("_n")))
    # The texts are shuffled once, for the bytes around first places and for the cuts.
    small = packed(docs)
    both = weighted_join(runs, _edges(small, asks), ["fdoc", "fbegin", "fend"], F.struct("doc_id", "begin"), "inner", "_n", weights=asks)
    per_doc = both.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end", "before", "behind")).alias("_r"))

    def cut(batches):
        import pyarrow as pa

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            sizes, removed, spans, kept = [], [], [], []
            for data, runs in zip(unpacked(batch.column("text")), batch.column("_r"), strict=True):
                gone = whole_passages(data, [(x["begin"], x["end"], x["before"], x["behind"]) for x in runs.as_py() or ()], min_words, min_bytes)
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in gone))
                spans.append(len(gone))
                kept.append(b"".join(data[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(data)], strict=True)))
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = small.join(per_doc, "doc_id", "left").select("doc_id", "text", "_r")
    return unkeyed(joined.mapInArrow(trimmed(cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"))
