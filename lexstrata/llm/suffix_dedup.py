"""Removal of long repeated strings by suffix sorting, over all documents at once.

Two equal strings of L bytes have the same minimiser, the k-gram of least
hash in them, at the same offset.  So each start of an L-byte string belongs
to one anchor, and equal strings meet under the hash of their anchor:
anchors whose hash stands once are done.  The bytes around the other anchors
are the contexts; equal contexts of an anchor are one context with a count.
Contexts under one hash that differ are sorted in shards by a two-stage
suffix sort, and neighbours in that order with a common prefix of L bytes
are repeated strings.

The contexts of a hash that has very many are first cut into pieces of
neighbouring starts.  All strings of a piece hold the same part of the text,
so only pieces that agree on it can share a string: pieces meet by its
digest, equal pieces are one with a count, and the others are sorted.

Counted in words, a text is the row of the 8-byte hashes of its words, and the
same anchors and contexts serve runs of words in place of runs of bytes; in a
shard these are sorted by a hash of the run.  Both kinds of repeats go through
the same stages together.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import forget, packed, trimmed, unpacked, weighted_join, written
from lexstrata.llm.gear_chunks import keyed_by_text, unkeyed
from lexstrata.llm.grams import PLAIN, finished, joined_texts, powers, word_edges, word_hashes
from lexstrata.llm.suffix_array import common_prefixes, two_stage_order, words_at

REPEAT_BYTES, GRAM = 400, 101
#: Words of a gram, where repeats are counted in words; 8 bytes name a word.
GRAM_WORDS, WORD = 8, 8
#: Window starts that are looked at together, contexts of a shard, pieces of a context, texts that are cut together.
BLOCK, SHARD_CONTEXTS, PIECES, ROWS = 1 << 19, 1500, 8, 500
_PLACE = np.uint64((1 << 20) - 1)


def gram_hashes(data: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of the ``gram`` bytes, or words, from each place, and the running sums behind it."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((PLAIN[data] if data.dtype == np.uint8 else data) * up[:n], out=sums[1:])
    return finished((sums[gram:] - sums[:-gram]) * down[: n - gram + 1]), sums


def anchors(data: np.ndarray, offsets: np.ndarray, repeat: int, gram: int):
    """The anchors of the texts in ``data``, parted by ``offsets``, some at a time.

    Arrays ``first, last, hash, ctx``: the starts from first to last have one
    anchor with this hash, and see the bytes or words that ``ctx`` names.  The
    leftmost of equal grams is the anchor.
    """
    reach, n = repeat - gram + 1, len(data)
    behind = np.repeat(offsets[1:], np.diff(offsets))
    for at in range(0, n - repeat + 1, BLOCK):
        part = data[at : at + BLOCK + repeat - 1]
        h, sums = gram_hashes(part, gram)
        m = len(h)
        ranked = (h & ~_PLACE) | np.arange(m, dtype=np.uint64)
        folded = np.concatenate([ranked, np.full(-m % reach, np.uint64(2**64 - 1))]).reshape(-1, reach)
        ahead = np.minimum.accumulate(folded, axis=1).ravel()
        back = np.minimum.accumulate(folded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: m - reach + 1], ahead[reach - 1 : m])
        starts = np.flatnonzero(behind[at : at + len(least)] - np.arange(at, at + len(least)) >= repeat)
        if not len(starts):
            continue
        spot = least[starts]
        head = np.concatenate([[True], (spot[1:] != spot[:-1]) | (starts[1:] != starts[:-1] + 1)])
        first = starts[head]
        last = starts[np.append(np.flatnonzero(head)[1:], len(starts)) - 1]
        _, down = powers(len(sums))
        seen = (sums[last + repeat] - sums[first]) * down[first] + (last - first).astype(np.uint64)
        yield at + first, at + last, h[(spot[head] & _PLACE).astype(np.int64)].view(np.int64), finished(seen).view(np.int64)


def _units(data: np.ndarray, offsets: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts, or the hashes of their words, with the offsets of the texts."""
    if unit == 1:
        return data, offsets
    first, behind, bounds = word_edges(data, offsets)
    return word_hashes(data, first, behind, PLAIN), bounds


def anchor_rows(docs: DataFrame, kinds: list[tuple[int, int, int]]) -> DataFrame:
    """``doc_id, unit, hash, lo, hi, ctx``: starts ``lo..hi`` of one anchor, for each ``(repeat, gram, unit)`` of ``kinds``."""

    def found(batches):
        import pyarrow as pa

        for batch in batches:
            base = 0
            for data, offsets in joined_texts(batch.column("text")):
                for repeat, gram, unit in kinds:
                    units, bounds = _units(data, offsets, unit)
                    for first, last, hashes, ctx in anchors(units, bounds, repeat, gram):
                        owner = np.searchsorted(bounds, first, side="right") - 1
                        columns = [batch.column("doc_id").take(pa.array(base + owner)), pa.array(np.full(len(first), unit, np.int32))]
                        columns += [pa.array(x) for x in (hashes, first - bounds[owner], last - bounds[owner], ctx)]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "unit", "hash", "lo", "hi", "ctx"])
                base += len(offsets) - 1

    return docs.mapInArrow(trimmed(found), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, unit int, hash long, lo long, hi long, ctx long")


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _pieces(data: bytes, value: int, repeat: int, gram: int, unit: int):
    """The pieces of a context with the anchor ``value``: ``group, first start, sub, bytes``."""
    h, _ = gram_hashes(np.frombuffer(data, np.uint8 if unit == 1 else "<u8"), gram)
    reach, starts = repeat - gram + 1, len(data) // unit - repeat + 1
    spot = int((h.view(np.int64)[: starts - 1 + reach] == value).argmax())
    wide = -(-reach // PIECES)
    for k in range(PIECES):
        near, far = spot - k * wide, spot - (k + 1) * wide + 1  # the starts of this piece, in any context
        a, b = max(far, 0), min(near, starts - 1)
        if a <= b:
            held = data[near * unit : (far + repeat) * unit]  # what all its strings hold
            some = data[a * unit : (b + repeat) * unit]
            yield _digest(held + b"%d %d %d" % (value, k, unit)), a, _digest(some + b"%d" % (a - far)), some


def _sliced(small: DataFrame, wanted: DataFrame, kinds: list[tuple[int, int, int]]) -> DataFrame:
    """The wanted contexts as pieces ``unit, hash, ctx, hot, group, start, sub, bytes``.

    A context of a hash with at most ``SHARD_CONTEXTS`` is one piece, its
    group is the hash.  ``small`` has packed texts.
    """
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("unit", "hash", "ctx", "hot", "lo", "hi")).alias("_w"))
    joined = small.join(per_doc, "doc_id").select("doc_id", "text", "_w")
    of = {unit: (repeat, gram) for repeat, gram, unit in kinds}
    names = ["unit", "hash", "ctx", "hot", "group", "start", "sub", "bytes"]

    def sliced(batches):
        import pyarrow as pa

        types = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def send(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        last, rows, held = None, [], 0
        for batch in batches:
            for key, text, wants in zip(batch.column("doc_id").to_pylist(), unpacked(batch.column("text")), batch.column("_w"), strict=True):
                if key == last:
                    continue  # rows that repeat an id and its text come one behind another
                last, views = key, {1: text}
                for x in wants.as_py():
                    unit, value = x["unit"], x["hash"]
                    if unit not in views:
                        whole = np.frombuffer(text, np.uint8)
                        views[unit] = _units(whole, np.array([0, len(whole)]), unit)[0].tobytes()
                    repeat, gram = of[unit]
                    cut = views[unit][x["lo"] * unit : (x["hi"] + repeat) * unit]
                    if len(cut) != (x["hi"] - x["lo"] + repeat) * unit:
                        raise ValueError("the documents changed while they were read")
                    if x["hot"]:
                        rows += [(unit, value, x["ctx"], True, *p) for p in _pieces(cut, value, repeat, gram, unit)]
                    else:
                        rows.append((unit, value, x["ctx"], False, value, 0, x["ctx"], cut))
                    held += len(cut)
                    if held > 1 << 22:
                        yield send(rows)
                        rows, held = [], 0
        if rows:
            yield send(rows)

    return joined.mapInArrow(trimmed(sliced), "unit int, hash long, ctx long, hot boolean, group long, start long, sub long, bytes binary")


def repeated_starts(contexts: list[bytes], repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix-sort the ``repeat``-byte strings of some contexts.

    Returns the first place of each context in the joined text, the sorted
    starts, and for each the number of its class of equal strings.
    """
    sizes = np.array([len(c) + 1 for c in contexts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    symbols = data.astype(np.int16) + 1
    symbols[begin + sizes - 1] = 0
    words = words_at(data)
    counts = sizes - repeat  # starts of each context
    wanted = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    same = np.arange(len(data)).astype(np.uint64) | np.uint64(1 << 63)
    whole = gram_hashes(data, repeat)[0] if len(data) >= repeat else np.empty(0, np.uint64)
    same[wanted] = whole[wanted] >> np.uint64(1)
    order = two_stage_order(symbols, wanted, words, repeat, same)
    prefix = common_prefixes(order, words, repeat)
    return begin, order, np.cumsum(prefix < repeat)


def repeated_windows(contexts: list[bytes], repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``repeated_starts`` for runs of words, in the order of the hashes of the runs; neighbours are compared word by word."""
    names = [np.frombuffer(c, "<u8") for c in contexts]
    sizes = np.array([len(x) for x in names])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.concatenate(names)
    counts = sizes - repeat + 1
    starts = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    whole = gram_hashes(data, repeat)[0][starts]
    order = np.argsort(whole, kind="stable")
    starts, whole = starts[order], whole[order]
    new = np.concatenate([[True], whole[1:] != whole[:-1]])
    near = np.flatnonzero(~new)
    for k in range(repeat):
        near = near[data[starts[near] + k] == data[starts[near - 1] + k]]
    new[:] = True
    new[near] = False
    return begin, starts, np.cumsum(new)


def _sorted_shards(parts: DataFrame, kinds: list[tuple[int, int, int]]) -> DataFrame:
    """``group, sub, first, last``: the starts of each piece that repeat in its shard ``part``."""
    of = {unit: repeat for repeat, _, unit in kinds}

    def found(batches):
        import pyarrow as pa

        def shard(rows, unit):
            groups, subs, texts = zip(*rows, strict=True)
            begin, order, classes = repeated_starts(list(texts), of[unit]) if unit == 1 else repeated_windows(list(texts), of[unit])
            if not len(order):
                return
            edges = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
            sizes = np.diff(np.append(edges, len(classes)))
            pick = np.flatnonzero(np.repeat(sizes > 1, sizes))
            if not len(pick):
                return
            context = np.searchsorted(begin, order, side="right") - 1
            offset = order - begin[context]
            pick = pick[np.lexsort((offset[pick], context[pick]))]
            # Starts of a piece that follow one another are one range.
            c, o = context[pick], offset[pick]
            head = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (o[1:] != o[:-1] + 1)]))
            tail = np.append(head[1:], len(pick)) - 1
            owner = c[head]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(groups, np.int64)[owner]), pa.array(np.array(subs, np.int64)[owner]), pa.array(o[head]), pa.array(o[tail])], names=["group", "sub", "first", "last"]
            )

        key, rows = None, []
        for batch in batches:
            for p, u, *row in zip(*(batch.column(n).to_pylist() for n in ("part", "unit", "group", "sub", "bytes")), strict=True):
                if key is not None and key != (p, u):
                    yield from shard(rows, key[1])
                    rows = []
                key = (p, u)
                rows.append(row)
        if rows:
            yield from shard(rows, key[1])

    dealt = parts.repartition("part").sortWithinPartitions("part", "unit")
    return dealt.select("part", "unit", "group", "sub", "bytes").mapInArrow(trimmed(found), "group long, sub long, first long, last long")


def _string_digests(pieces: DataFrame, kinds: list[tuple[int, int, int]]) -> DataFrame:
    """``group, sub, first, low, high``: 128 bits of each string of the pieces."""
    of = {unit: repeat for repeat, _, unit in kinds}

    def found(batches):
        import pyarrow as pa

        for batch in batches:
            for group, sub, unit, data in zip(*(batch.column(n).to_pylist() for n in ("group", "sub", "unit", "bytes")), strict=True):
                size = of[unit] * unit
                names = np.frombuffer(b"".join(hashlib.blake2b(data[x : x + size], digest_size=16).digest() for x in range(0, len(data) - size + 1, unit)), "<i8").reshape(-1, 2)
                n = len(names)
                columns = [np.full(n, group, np.int64), np.full(n, sub, np.int64), np.arange(n), names[:, 0].copy(), names[:, 1].copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["group", "sub", "first", "low", "high"])

    return pieces.select("group", "sub", "unit", "bytes").mapInArrow(trimmed(found), "group long, sub long, first long, low long, high long")


def repeated_spans(docs: DataFrame, kinds: list[tuple[int, int, int]]) -> DataFrame:
    """``doc_id, unit, spans``: maximal ranges covered by strings that start elsewhere too.

    ``docs`` has ``doc_id, text`` without nulls.  ``kinds`` has ``(repeat,
    gram, unit)``: strings of so many bytes, or words with a unit of 8; the
    ranges count these.
    """
    if any((repeat * unit) % 8 or not 0 < gram < repeat for repeat, gram, unit in kinds):
        raise ValueError("repeat must be a multiple of 8 bytes and longer than gram")
    found = written(anchor_rows(docs, kinds), "suffix-anchors")
    often = found.groupBy("hash", "unit").agg(F.count("*").alias("_n")).filter("_n > 1")
    shared = written(weighted_join(found, often, ["hash", "unit"], F.struct("doc_id", "lo"), "left_semi", "_n"), "suffix-shared")
    forget(found)
    place = F.min(F.struct("doc_id", "lo", "hi")).alias("at")
    contexts = written(shared.groupBy("hash", "unit", "ctx").agg(F.count("*").alias("n"), place).select("hash", "unit", "ctx", "n", "at.*"), "suffix-contexts")
    several = contexts.groupBy("hash", "unit").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    wanted = weighted_join(contexts, several.withColumn("_n", F.col("kinds")), ["hash", "unit"], F.col("ctx"), "inner", "_n")
    wanted = wanted.withColumn("hot", F.col("kinds") > SHARD_CONTEXTS)
    pieces = written(_sliced(packed(docs), wanted, kinds), "suffix-pieces")

    # Pieces of one group and the same bytes are one; groups of several pieces are sorted.
    subs = pieces.groupBy("group", "sub").agg(F.count("*").alias("c"))
    groups = subs.groupBy("group").agg(F.count("*").alias("k")).filter("k > 1")
    single = pieces.filter("not hot").unionByName(pieces.filter("hot").dropDuplicates(["group", "sub"]))
    sorts = weighted_join(single, groups.withColumn("_n", F.col("k")), ["group"], F.col("sub"), "inner", "_n")
    shards = max(1, contexts.count() // SHARD_CONTEXTS)
    parts = sorts.filter(F.col("k") <= SHARD_CONTEXTS).withColumn("part", F.pmod(F.xxhash64("group"), F.lit(shards)))
    inside = _sorted_shards(parts, kinds)
    # Where even pieces that agree on all but their edges are very many, each string meets its like.
    strings = _string_digests(sorts.filter(F.col("k") > SHARD_CONTEXTS), kinds)
    met = strings.groupBy("low", "high").agg(F.count("*").alias("_n")).filter("_n > 1")
    across = weighted_join(strings, met, ["low", "high"], F.struct("group", "sub"), "left_semi", "_n").select("group", "sub", "first", F.col("first").alias("last"))
    size = lambda: F.octet_length("bytes") / F.col("unit")
    repeat = F.coalesce(*(F.when(F.col("unit") == unit, F.lit(repeat)) for repeat, _, unit in kinds))
    equal = weighted_join(pieces.filter("hot").select("group", "sub", "unit", "bytes"), subs.filter("c > 1"), ["group", "sub"], F.col("group"), "inner", "c")
    equal = equal.dropDuplicates(["group", "sub"]).select("group", "sub", F.lit(0).cast("long").alias("first"), (size() - repeat).cast("long").alias("last"))
    starts = inside.unionByName(across).unionByName(equal).groupBy("group", "sub").agg(F.collect_list(F.struct("first", "last")).alias("_s"))
    placed = pieces.select("hash", "unit", "ctx", "group", "sub", "start").join(starts, ["group", "sub"])
    moved = F.transform("_s", lambda x: F.struct((x["first"] + F.col("start")).alias("first"), (x["last"] + F.col("start")).alias("last")))
    copies = contexts.filter("n > 1").select("hash", "unit", "ctx", F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("hi") - F.col("lo")).alias("last"))).alias("_s"))
    named = placed.select("hash", "unit", "ctx", moved.alias("_s")).unionByName(copies).groupBy("hash", "unit", "ctx").agg(F.flatten(F.collect_list("_s")).alias("_s"))
    named = named.join(contexts.select("hash", "unit", "ctx", "n"), ["hash", "unit", "ctx"])
    ranges = weighted_join(shared, named, ["hash", "unit", "ctx"], F.struct("doc_id", "lo"), "inner", "n")
    ranges = ranges.select("doc_id", "unit", F.explode(F.transform("_s", lambda x: F.struct((x["first"] + F.col("lo")).alias("begin"), (x["last"] + F.col("lo") + repeat).alias("end")))).alias("r"))
    ordered = ranges.groupBy("doc_id", "unit").agg(F.array_sort(F.collect_set("r")).alias("_r"))
    kind = ordered.schema["doc_id"].dataType.simpleString()

    def merged(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("_r")
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            begin, end = flat.field("begin").to_numpy(), flat.field("end").to_numpy()
            far = int(end.max(initial=0)) + 1
            so_far = np.maximum.accumulate(end + owner * far)
            new = np.concatenate([[True], (begin + owner * far)[1:] > so_far[:-1]]) if len(begin) else np.empty(0, bool)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(new)) - 1 if len(head) else head
            found = pa.StructArray.from_arrays([pa.array(begin[head]), pa.array((so_far - owner * far)[tail])], names=["begin", "end"])
            offsets = pa.array(np.searchsorted(owner[head], np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("unit"), pa.ListArray.from_arrays(offsets, found)], names=["doc_id", "unit", "spans"])

    return ordered.mapInArrow(trimmed(merged), f"doc_id {kind}, unit int, spans array<struct<begin:bigint,end:bigint>>")


def _kinds(repeat: int, words: int | None) -> list[tuple[int, int, int]]:
    return [(repeat, min(GRAM, repeat - 1), 1)] + ([] if words is None else [(words, min(GRAM_WORDS, words - 1), WORD)])


def _per_doc(found: DataFrame) -> DataFrame:
    """``doc_id, spans, runs``: the ranges of bytes and of words."""
    of = lambda unit: F.first(F.when(F.col("unit") == unit, F.col("spans")), True)
    return found.groupBy("doc_id").agg(of(1).alias("spans"), of(WORD).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: int = REPEAT_BYTES, words: int | None = None) -> DataFrame:
    """Each text without the bytes of long strings that start anywhere else too.

    Returns one row for each input row: ``doc_id, n_bytes, n_removed, n_spans,
    kept`` (bytes).  Every occurrence goes, and what is repeated is judged on
    the input.  Null text counts as empty; texts shorter than ``repeat`` stay
    whole; matches never cross documents.  Rows that repeat an id and its
    text repeat each other and lose the same ranges.

    With ``words`` there is ``n_passage_words`` too: the words in runs of so
    many that start elsewhere too, which stay in the text.
    """
    docs = keyed_by_text(docs, id_col, text_col)
    found = _per_doc(repeated_spans(docs, _kinds(repeat, words)))
    joined = packed(docs).join(found, "doc_id", "left").select("doc_id", "text", "spans", "runs")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *(["n_passage_words"] if words is not None else [])]

    def cut(batches):
        import pyarrow as pa

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            sizes, removed, count, kept, passages = [], [], [], [], []
            for data, spans, runs in zip(unpacked(batch.column("text")), batch.column("spans"), batch.column("runs"), strict=True):
                gone = [(x["begin"], x["end"]) for x in spans.as_py() or ()]
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in gone))
                count.append(len(gone))
                kept.append(b"".join(data[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(data)], strict=True)))
                passages.append(sum(x["end"] - x["begin"] for x in runs.as_py() or ()))
            numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, count)]
            columns = [batch.column("doc_id"), *numbers, pa.array(kept, pa.binary()), pa.array(passages, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return unkeyed(joined.mapInArrow(trimmed(cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary" + (", n_passage_words long" if words is not None else "")))


def replace_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: int = REPEAT_BYTES, count_col: str | None = "n_chars", words: int | None = None
) -> DataFrame:
    """``docs`` with the long repeated strings out of their texts, all rows and columns kept.

    With ``words``, runs of so many whole words that start elsewhere too go
    as well, however short they are and whatever white space parts them.
    A character goes if all its bytes are repeated.  ``count_col``, where it
    is a column, gets the length of a text that changed.  Null texts stay
    null.
    """
    keyed = keyed_by_text(docs, id_col, text_col)
    spans = _per_doc(repeated_spans(keyed, _kinds(repeat, words)))
    named = (F.col("doc_id")["id"].alias("_lexstrata_id"), F.col("doc_id")["print"].alias("_lexstrata_print"))
    spans = spans.select(*named, F.col("spans").alias("_lexstrata_spans"), F.col("runs").alias("_lexstrata_runs"))
    fits = docs[id_col].eqNullSafe(spans["_lexstrata_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == spans["_lexstrata_print"])
    joined = docs.join(spans, fits, "left").select(*(docs[c] for c in docs.columns), "_lexstrata_spans", "_lexstrata_runs")
    counts = count_col in docs.columns if count_col else False
    schema = docs.schema

    def cut(batches):
        import pyarrow as pa

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts, sizes = batch.column(text_col).to_pylist(), batch.column(count_col).to_pylist() if counts else None
            for r, found in enumerate(zip(batch.column("_lexstrata_spans"), batch.column("_lexstrata_runs"), strict=True)):
                found, runs = (x.as_py() or [] for x in found)
                if not found and not runs:
                    continue
                data, kept, begin = texts[r].encode("utf-8", "surrogatepass"), [], 0
                ranges = [(x["begin"], x["end"]) for x in found]
                if runs:
                    first, behind, _ = word_edges(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                    ranges += [(int(first[x["begin"]]), int(behind[x["end"] - 1])) for x in runs]
                for a, b in sorted(ranges):
                    a = max(a, begin)  # ranges of bytes and of words may overlap
                    if a >= b:
                        continue
                    while a < b and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                    kept.append(data[begin:a])
                    begin = b
                kept.append(data[begin:])
                texts[r] = b"".join(kept).decode("utf-8", "surrogatepass")
                if counts:
                    sizes[r] = len(texts[r])
            columns = []
            for name in schema.names:
                column = batch.column(name)
                columns.append(pa.array(texts, column.type) if name == text_col else pa.array(sizes, column.type) if counts and name == count_col else column)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(trimmed(cut), schema)
