"""Token counts under a unigram model, with forward scores shared in a trie.

The model is a public vocabulary: the piece at rank r costs ln(r + 2), a Zipf
rule, so nothing is trained.  A pre-token is a word-start mark followed by a
run of characters without white space; its best segmentation has the lowest
cost, and the fewest pieces among equals.  The state behind a prefix is the
same for all pre-tokens that share it, so the distinct pre-tokens of the whole
corpus go into tries, a range of the alphabet to each task, and each prefix is
scored once.  The counts at their ends are stored in a table, and documents
look their words up there.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.common import forget, trimmed, written

#: Costs are whole numbers of millionths, so that ties are exact.
UNIT = 1_000_000
#: Characters after which a trie is begun anew, and distinct words after which a task passes its counts on.
GROWN, HELD = 1 << 22, 500_000
#: Longer words share hardly a prefix; each is scored where it stands.
LONGEST_SHARED = 64
#: So many of the most frequent words are known to every task that reads documents; all others are joined.
COMMON = 100_000
MARK = "▁"


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Piece costs and the cost of a byte, for characters that no piece covers."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cost: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
                self.cost[sp.id_to_piece(i)] = round(UNIT * math.log(i + 2))
        self.byte = round(UNIT * math.log(sp.get_piece_size() + 2))
        self.longest = max(map(len, self.cost), default=1)

    def counts(self, words: list[str]) -> dict[str, int]:
        """Pieces of the best segmentation of each word."""
        trie, out = Trie(self), {}
        for word in words:
            if len(trie.score) > GROWN:
                trie = Trie(self)
            out[word] = trie.insert(word)
        return out


class Trie:
    """Prefixes of pre-tokens as nodes; each node has the cost and the pieces of the best way to it, found when it is made."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.child: dict[tuple[int, str], int] = {}
        self.score: list[tuple[int, int]] = [(0, 0)]

    def insert(self, word: str) -> int:
        """The terminal count of ``word``; only nodes that are not there yet are scored."""
        text, child, score = MARK + word, self.child, self.score
        cost, longest, byte = self.model.cost.get, self.model.longest, self.model.byte
        path = [0]
        for end, letter in enumerate(text, 1):
            key = (path[-1], letter)
            node = child.get(key)
            if node is None:
                size = len(letter.encode("utf-8", "surrogatepass"))
                before = score[path[-1]]
                best = (before[0] + size * byte, before[1] + size)
                for start in range(max(0, end - longest), end):
                    c = cost(text[start:end])
                    if c is not None:
                        s = score[path[start]]
                        way = (s[0] + c, s[1] + 1)
                        if way < best:
                            best = way
                node = child[key] = len(score)
                score.append(best)
            path.append(node)
        return score[path[-1]][1]


_LOADED: dict[str, PieceModel] = {}


def _loaded(path: str) -> PieceModel:
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def distinct_words(texts: DataFrame) -> DataFrame:
    """``word, n``: each word of up to ``LONGEST_SHARED`` characters in a table of one text column, and how many texts have it."""

    def counted(batches):
        import pyarrow as pa

        def batch(seen):
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for texts in batches:
            for x in texts.column(0):
                seen.update({w for w in x.as_py().split() if len(w) <= LONGEST_SHARED})
                if len(seen) >= HELD:
                    yield batch(seen)
                    seen.clear()
        yield batch(seen)

    return texts.mapInArrow(trimmed(counted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def terminal_counts(words: DataFrame, model_path: str) -> DataFrame:
    """``word, n, tokens`` from distinct ``word, n``: neighbours of the alphabet share a task and its trie."""

    def scored(batches):
        import pyarrow as pa

        model = _loaded(model_path)
        trie = Trie(model)
        for batch in batches:
            tokens = []
            for x in batch.column("word"):
                if len(trie.score) > GROWN:
                    trie = Trie(model)
                tokens.append(trie.insert(x.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(tokens, pa.int64())], names=["word", "n", "tokens"])

    return words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(trimmed(scored), "word string, n long, tokens long")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, common: int = COMMON) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of each whole text.

    Null, empty and blank texts have no words and no tokens.  Each row gets
    one row, repeated rows too; other columns are ignored.  ``common`` is how
    many of the most frequent words, of ``LONGEST_SHARED`` characters at
    most, are sent to the tasks; it changes what is moved, not the result.
    """
    spark, path = docs.sparkSession, model_path or default_model_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = written(distinct_words(rows.select("text")), "token-words")
    table = written(terminal_counts(words, path), "token-counts")
    forget(words)
    known = spark.sparkContext.broadcast({r["word"]: r["tokens"] for r in table.orderBy(F.desc("n"), "word").select("word", "tokens").limit(common).collect()})

    def summed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        model, tokens = _loaded(path), known.value
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            n_words, n_tokens, rare = [], [], []
            for x in batch.column("text"):
                times = Counter(x.as_py().split())
                sure, other = 0, []
                for word, k in times.items():
                    n = tokens.get(word)
                    if n is not None:
                        sure += k * n
                    elif len(word) > LONGEST_SHARED:
                        sure += k * Trie(model).insert(word)
                    else:
                        other.append({"word": word, "k": k})
                n_words.append(times.total())
                n_tokens.append(sure)
                rare.append(other)
            places = pa.array(range(at, at + len(rare)), pa.int64())
            at += len(rare)
            pairs = pa.array(rare, pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())])))
            yield pa.RecordBatch.from_arrays([places, batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pairs], names=["at", "doc_id", "n_words", "sure", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"at long, doc_id {kind}, n_words long, sure long, rare array<struct<word: string, k: long>>"
    # Rows are named by their place in a task, so they are written before anything is shuffled by that name.
    base = written(rows.mapInArrow(trimmed(summed), schema), "token-sums")
    asked = base.select("at", F.explode("rare").alias("r")).select("at", F.col("r.word").alias("word"), F.col("r.k").alias("k"))
    found = asked.join(table.select("word", "tokens"), "word").groupBy("at").agg(F.sum(F.col("k") * F.col("tokens")).alias("more"))
    return base.join(found, "at", "left").select("doc_id", "n_words", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
