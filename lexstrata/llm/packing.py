"""Mixture-controlled packing of token streams into windows of fixed length.

Every source is a queue of tokens.  Deficit round-robin serves the queues:
each window owes a queue its share of the window, serves whole tokens, and
carries the unserved fraction on to the next window.  The deficits have a
closed form - behind X tokens in all, the first j queues together have had
floor(X * C_j / T) - so every window can be laid out on its own, whatever
task holds the tokens, and the deficits carry across windows and partitions.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from fractions import Fraction

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import cut_lineage, trimmed, written

WINDOW, END_ID = 4096, 2
#: Queues by name up to here; a corpus with more sources shares so many queues by hash.
MOST_QUEUES = 4096
#: Words whose ids a worker keeps in each of two generations, and rows of the offset table that are broadcast at most.
MEMO, BROADCAST_ROWS = 250_000, 200_000
#: The same where the workers have other steps to do as well; these words go when a task ends.
SHARED_MEMO = 100_000


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """Ids of words, as packed bytes.  The tokenizer drops white space, and no token spans it.

    A word of Latin letters is one pre-token, so it goes to the merge table
    directly; any other word goes through the whole tokenizer.  When the memo
    is full it becomes the older generation; a word that is met again there
    comes back, so frequent words are never merged anew.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.merge, self.characters = self.tokenizer.model.tokenize, byte_characters()
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = next(c for c in "HIL" if array(c).itemsize == np.dtype(kind).itemsize)
        self.older: dict[str, bytes] = {}
        self.most: int | None = None
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.merged(word)
        if len(self) >= (self.most or MEMO):
            self.older = dict(self)
            self.clear()
            self[""] = b""
        self[word] = ids
        return ids

    def let_go(self) -> None:
        """Forget all words, so that a worker that lives on holds none beside its next step."""
        self.clear()
        self.older = {}
        self[""] = b""

    def merged(self, word: str) -> bytes:
        latin = word.isascii() or (max(word) < "\u0250" and "\u0130" not in word and unicodedata.is_normalized("NFC", word))
        if latin and (low := word.lower()) != word:
            return self[low]
        if latin and word.isalpha():
            return array(self.code, [x.id for x in self.merge(word if word.isascii() else word.encode().decode("latin-1").translate(self.characters))]).tobytes()
        if latin and len(word) > 1 and word[-1] in ",." and word[-2].isalpha():  # a mark behind a letter is a token of its own
            return self[word[:-1]] + self[word[-1]]
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def text(self, text: str) -> bytes:
        low = text.lower()
        if any(s in low for s in self.special):  # a special token's string may stand within a word, and is none in capitals
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.__getitem__, (low if text.isascii() else text).replace("\n", " ").split(" ")))


_LOADED: dict[tuple[str, str], WordIds] = {}


def _word_ids(path: str, kind: str) -> WordIds:
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = WordIds(path, kind)
    return _LOADED[path, kind]


def id_width(path: str) -> str:
    """numpy type of packed ids: two bytes where the vocabulary allows."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, kind: str, id_col: str, text_col: str, source_col: str, end_id: int, shared: bool = False) -> DataFrame:
    """``doc_id, queue, block, start, n, ids``: a document's ids and its place in its queue.

    A block is a scan task, and ``start`` counts the tokens of the same queue
    before the document in that task; written to a table, both are fixed.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue")
    )
    end = np.array([end_id], kind).tobytes()

    def encoded(batches):
        import pyarrow as pa

        words, block, behind = _word_ids(path, kind), TaskContext.get().partitionId(), {}
        words.most = SHARED_MEMO if shared else None
        try:
            for batch in batches:
                ids, start, n = [], [], []
                for text, queue in zip(batch.column("text"), batch.column("queue").to_pylist(), strict=True):
                    own = words.text(text.as_py()) + end
                    ids.append(own)
                    n.append(len(own) // len(end))
                    start.append(behind.get(queue, 0))
                    behind[queue] = start[-1] + n[-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("queue"), pa.array([block] * len(n), pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "queue", "block", "start", "n", "ids"],
                )
        finally:
            if shared:
                words.let_go()

    kind_of_id = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(encoded), f"doc_id {kind_of_id}, queue string, block int, start long, n long, ids binary")


class Schedule:
    """What each queue has had behind X tokens in all.

    ``totals`` are tokens by queue.  Without targets the proportions are
    those of the corpus and all queues end together.  With targets the
    proportions hold until a queue ends; the others then share its part in
    their own proportions, one phase after another.
    """

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None):
        self.queues = sorted(totals)
        self.place = {q: i for i, q in enumerate(self.queues)}
        self.total = sum(totals.values())
        left = [totals[q] for q in self.queues]
        exact = lambda x: Fraction(x).limit_denominator(10**6) if isinstance(x, float) else Fraction(x)
        weight = [exact(targets.get(q, 0)) if targets else Fraction(n) for q, n in zip(self.queues, left, strict=True)]
        if any(w < 0 for w in weight):
            raise ValueError("a target is negative")
        #: For each phase: tokens before it, its tokens, tokens of each queue before it, running sums of its queues.
        self.phases: list[tuple[int, int, list[int], list[int]]] = []
        before, had = 0, [0] * len(left)
        while any(left):
            live = [i for i, n in enumerate(left) if n and weight[i]] or [i for i, n in enumerate(left) if n]
            share = {i: weight[i] or Fraction(1) for i in live}
            step = min(left[i] / share[i] for i in live)
            part = [int(share[i] * step) if i in share else 0 for i in range(len(left))]
            sums = np.cumsum(part, dtype=object).tolist()
            self.phases.append((before, sums[-1], list(had), sums))
            before += sums[-1]
            had = [a + b for a, b in zip(had, part, strict=True)]
            left = [a - b for a, b in zip(left, part, strict=True)]

    def first(self, j: int, x: int) -> int:
        """Tokens that queues 0..j have had together behind ``x`` tokens."""
        for before, size, had, sums in reversed(self.phases):
            if x > before:
                return sum(had[: j + 1]) + min(x - before, size) * sums[j] // size
        return 0

    def had(self, j: int, x: int) -> int:
        return self.first(j, x) - (self.first(j - 1, x) if j else 0)

    def windows(self, j: int, a: int, b: int, window: int):
        """Pieces of the tokens ``a`` to ``b`` of queue ``j``: window, offset in it, first token, tokens."""
        low, high = 0, -(-self.total // window)
        while high - low > 1:  # the last window that has begun by token a
            middle = (low + high) // 2
            low, high = (middle, high) if self.had(j, middle * window) <= a else (low, middle)
        w, x0 = low, low * window
        done, below = self.had(j, x0), self.first(j - 1, x0) if j else 0
        while a < b:
            x1 = min(self.total, (w + 1) * window)
            upto, above = self.had(j, x1), self.first(j - 1, x1) if j else 0
            if upto > a:
                end = min(b, upto)
                yield w, above - below + a - done, a, end - a
                a = end
            w, done, below = w + 1, upto, above


def smoothed(totals: dict[str, int], power: float) -> dict[str, Fraction]:
    """Targets that grow about as the ``power`` of a queue's tokens, so that small queues last as long as large ones.

    Queues whose tokens have the same binary logarithm, rounded down, keep
    their own proportions and end together, so there are at most some sixty
    phases, however many queues there are.
    """
    return {q: Fraction(n) * Fraction(round(2.0 ** (40 + (power - 1) * (n.bit_length() - 1))), 1 << 40) for q, n in totals.items()}


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokenizer_path: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    targets: dict[str, float] | None = None,
    power: float | None = None,
    shared: bool = False,
) -> DataFrame:
    """Pieces of documents in windows of ``window`` tokens.

    Returns one row for each piece: ``doc_id, start, length, ids`` (packed
    little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset,
    queue``.  A document is its ids and ``end_id``; null text is empty and
    has that id alone.  A null source is the queue with the empty name.  All
    windows but the last are full, so less than one window of padding is
    needed in all.  Windows hold the queues in the proportions ``targets``, or
    ``smoothed`` by ``power``, until a queue ends; without either in those of
    the corpus.  The strings of special tokens in a text are those tokens, as
    the tokenizer has them by itself.  Repeated rows are packed as often as they stand there.
    ``shared``: the Python workers do other steps of a job too, so they keep
    fewer words and none after a task, which takes more time and no other result.
    """
    path = tokenizer_path or default_tokenizer_path()
    kind = id_width(path)
    docs = docs.select(id_col, text_col, source_col)
    tokens = written(tokenised(docs, path, kind, id_col, text_col, source_col, end_id, shared), "packing-ids")
    blocks = tokens.groupBy("queue", "block").agg(F.sum("n").alias("n"))
    queue = F.col("queue")
    if blocks.select("queue").distinct().limit(MOST_QUEUES + 1).count() > MOST_QUEUES:
        queue = F.pmod(F.xxhash64("queue"), F.lit(MOST_QUEUES)).cast("string")
    # In a queue the blocks stand one behind another, and in a block the sources that share the queue.
    from pyspark.sql import Window

    order = Window.partitionBy("lane").orderBy("block", "queue")
    offsets = cut_lineage(blocks.withColumn("lane", queue).withColumn("base", F.sum("n").over(order) - F.col("n")))
    totals = {r["lane"]: int(r["n"]) for r in offsets.groupBy("lane").agg(F.sum("n").alias("n")).collect()}  # MOST_QUEUES rows at most
    schedule = Schedule(totals, targets if targets or power is None else smoothed(totals, power))
    small = offsets.select("queue", "block", "lane", "base")
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    placed = tokens.join(small, ["queue", "block"]).select("doc_id", "lane", (F.col("base") + F.col("start")).alias("at"), "n", "ids")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            docs_at, ids = batch.column("doc_id"), batch.column("ids")
            lanes, at, sizes = batch.column("lane").to_pylist(), batch.column("at").to_pylist(), batch.column("n").to_pylist()
            row, out = [], [[] for _ in range(6)]
            held = 0

            def flush():
                n = pa.array(row, pa.int64())
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                cols = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
                queue = pa.array([lanes[i] for i in row], pa.string())
                return pa.RecordBatch.from_arrays([docs_at.take(n), *cols, queue], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "queue"])

            for i, lane in enumerate(lanes):
                own = np.frombuffer(ids[i].as_py(), kind).astype("<u4")
                g = at[i]
                for w, offset, a, length in schedule.windows(schedule.place[lane], g, g + sizes[i], window):
                    row.append(i)
                    for x, v in zip(out, (a - g, length, own[a - g : a - g + length].tobytes(), sizes[i], w, offset), strict=True):
                        x.append(v)
                    held += length
                if held > 1 << 22:
                    yield flush()
                    row.clear()
                    held = 0
                    for x in out:
                        x.clear()
            if row:
                yield flush()

    kind_of_id = tokens.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(trimmed(cut), f"doc_id {kind_of_id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, queue string"
    )


def with_checksums(pieces: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` in the place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


def checksum(ids: bytes) -> int:
    return zlib.crc32(ids)
