"""Byte-level BPE by monoid tree reduction.

A piece of text is encoded in halves.  Two encodings are joined by encoding
a window around their boundary again and growing it until both pairs at its
ends are stable, that is, until each pair of neighbouring tokens is what the
merge rules give for the bytes of that pair.  A token sequence whose
neighbouring pairs are all stable is the encoding of its bytes, so the tokens
outside the window can no longer change.  Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of so many bytes are merged directly; longer ones by halves.
LEAF_BYTES = 24
#: Longer windows keep their pairs in a heap.
QUEUE_BYTES = 96
#: Entries of each memo table before it starts anew.
MEMO = 300_000
_NONE = 1 << 60


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class _Memo(dict):
    """A dict that fills itself and starts anew when it holds too much."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        value = self[key] = self.make(key)
        return value


class TreeBpe:
    """Encoder and decoder for one table of ranks and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.stable = _Memo(lambda pair: self.merged(self.tokens[pair[0]] + self.tokens[pair[1]]) == list(pair))
        self.pieces = _Memo(self._piece)
        self.first = _Memo(self._packed)
        self.spaced = _Memo(lambda word: self._packed(" " + word))

    def merged(self, data: bytes) -> list[int]:
        """The merge rules applied to a few bytes: lowest rank first, leftmost among equals."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while pairs:
            low = min(pairs)
            if low == _NONE:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        return [ranks[p] for p in parts]

    def queued(self, data: bytes) -> list[int]:
        """``merged`` for many bytes: the pairs wait in a heap, and parts are a linked list."""
        ranks, n = self.ranks, len(data)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if end[i] < 0 or j >= n or ranks.get(data[i : end[j]]) != rank:
                continue  # one of the two parts has changed
            end[i], end[j], after[i] = end[j], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h : end[i]])) is not None:
                heapq.heappush(heap, (r, h))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = after[i]
        return out

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, one after the other."""
        if not left or not right:
            return left or right
        reach, tokens = 1, self.tokens
        if self.stable[left[-1], right[0]]:
            return left + right
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self.direct(b"".join([tokens[t] for t in left[i:] + right[:j]]))
            if (i == 0 or self.stable[left[i - 1], window[0]]) and (j == len(right) or self.stable[window[-1], right[j]]):
                return left[:i] + window + right[j:]
            reach *= 2

    def direct(self, data: bytes) -> list[int]:
        return self.merged(data) if len(data) <= QUEUE_BYTES else self.queued(data)

    def reduced(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.reduced(data[:half]), self.reduced(data[half:]))

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(data)
        return np.array([rank] if rank is not None else self.reduced(data), "<u4").tobytes()

    def _packed(self, text: str) -> bytes:
        return b"".join([self.pieces[p] if len(p) < 64 else self._piece(p) for p in self.find(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        White space only ever stands before the other characters of a
        pre-token, so a text with single spaces and line feeds splits there;
        any other text is matched as a whole.
        """
        lines = [line.split(" ") for line in text.split("\n")]
        if sum(map(len, lines)) != len(text.split()):
            return self._packed(text)
        out = []
        for k, words in enumerate(lines):
            if k:
                out.append(self.first["\n"])
            out.append(self.first[words[0]])
            out.extend(map(self.spaced.__getitem__, words[1:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids, joined by halves."""
        if len(ids) <= 1 << 16:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        half = len(ids) // 8 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


_LOADED: dict[tuple[str, str], TreeBpe] = {}


def tree_bpe(path: str, pattern: str) -> TreeBpe:
    """One encoder for each worker process; its memo tables outlive a task."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = TreeBpe(path, pattern)
    return _LOADED[key]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids``: whole texts as packed little-endian unsigned 32-bit ids; null counts as empty.

    Ordinary text only: there are no special tokens.  Each row gets one row;
    other columns are ignored.
    """
    import public_tokenizers

    path, pattern = ranks_path or default_ranks_path(), pattern or public_tokenizers.PATTERN
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encoded(batches):
        import pyarrow as pa

        bpe = tree_bpe(path, pattern)
        for batch in batches:
            ids = pa.array([bpe.encode(x.as_py()) for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return rows.mapInArrow(encoded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """``doc_id, data``: the bytes of packed ids; null ids give no bytes."""
    import public_tokenizers

    path, pattern = ranks_path or default_ranks_path(), public_tokenizers.PATTERN
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def decoded(batches):
        import pyarrow as pa

        bpe = tree_bpe(path, pattern)
        for batch in batches:
            data = pa.array([bpe.decode(x.as_py() or b"") for x in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data], names=["doc_id", "data"])

    return rows.mapInArrow(decoded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode each whole text in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    import public_tokenizers

    path, pattern = ranks_path or default_ranks_path(), pattern or public_tokenizers.PATTERN
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def digests(batches):
        import pyarrow as pa

        bpe = tree_bpe(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for x in batch.column("text"):
                ids = bpe.encode(x.as_py())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
