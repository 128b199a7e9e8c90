"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter trigram is bound by
rotating the vectors of its letters by their place and multiplying them; a
text is the bundle (sum) of its trigram vectors; a language prototype is the
bundle of its texts.  A text gets the language whose prototype has the
highest cosine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexstrata.llm.common import trimmed

#: Rows of the letter table: the word break, then letters by code point.
LETTERS = 128
DIMENSIONS = 1024
UNKNOWN = "und"
#: Rows of trigram vectors that a task keeps at once.
CACHED_ROWS = 16384


def letter_vectors(seed: int = 7, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, dimensions))


def trigram_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes ``(a * LETTERS + b) * LETTERS + c``."""
    a, b, c = codes // (LETTERS * LETTERS), codes // LETTERS % LETTERS, codes % LETTERS
    return (np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]).astype(np.float32)


def _letter_table() -> np.ndarray:
    """Letter row of each code point of the first two planes' start; 0 is a word break."""
    table = np.zeros(0x3400, np.uint8)
    for point in range(len(table)):
        if chr(point).isalpha():
            table[point] = 1 + point % (LETTERS - 1)
    return table


def trigram_counts(text: str | None, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of a text and their counts; empty without a letter."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = table[np.minimum(points, len(table) - 1)]
    far = points >= len(table)
    if far.any():  # other scripts: by character
        rows = rows.copy()
        rows[far] = [1 + int(p) % (LETTERS - 1) if chr(p).isalpha() else 0 for p in points[far]]
    if not rows.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = np.ones(len(rows), bool)  # runs of breaks count once
    keep[1:] = (rows[1:] != 0) | (rows[:-1] != 0)
    x = np.concatenate([[0], rows[keep], [0]]).astype(np.int32)
    codes = (x[:-2] * LETTERS + x[1:-1]) * LETTERS + x[2:]
    codes = codes[x[1:-1] != 0]
    codes.sort()
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts].astype(np.int64), np.diff(np.append(starts, len(codes)))


def held_out(doc_id: Column) -> Column:
    """True where the crc32 of the id, as text, leaves 1 when divided by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit_prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", seed: int = 7, dimensions: int = DIMENSIONS) -> DataFrame:
    """``lang, vector``: one prototype for each language, from every labelled row.

    Rows whose label is null or whose text has no letter teach nothing.
    Each task sums trigram counts and emits one vector for each language it
    saw; the sums of those are small.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")

    def bundled(batches):
        import pyarrow as pa

        table, letters, sums = _letter_table(), letter_vectors(seed, dimensions), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                codes, n = trigram_counts(text, table)
                if len(codes):
                    if lang not in sums:
                        sums[lang] = np.zeros(LETTERS**3, np.int64) if len(sums) < 8 else {}
                    if isinstance(sums[lang], dict):  # many languages: sparse counts
                        own = sums[lang]
                        for k, v in zip(codes.tolist(), n.tolist(), strict=True):
                            own[k] = own.get(k, 0) + v
                    else:
                        sums[lang][codes] += n
        for lang, own in sums.items():
            codes = np.fromiter(own.keys(), np.int64, len(own)) if isinstance(own, dict) else np.flatnonzero(own)
            n = np.fromiter(own.values(), np.float64, len(own)) if isinstance(own, dict) else own[codes].astype(np.float64)
            vector = np.zeros(dimensions)
            for at in range(0, len(codes), 4096):
                vector += n[at : at + 4096] @ trigram_vectors(codes[at : at + 4096], letters)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector)], names=["lang", "axis", "x"]
            )

    parts = rows.mapInArrow(trimmed(bundled), "lang string, axis int, x double")
    summed = parts.groupBy("lang", "axis").agg(F.sum("x").alias("x"))
    return summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("axis", "x"))).alias("_v")).select(
        "lang", F.transform("_v", lambda s: s["x"]).alias("vector")
    )


def with_language(
    docs: DataFrame, prototypes: dict[str, list[float]], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", seed: int = 7
) -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language and its cosine, cut to 0..1.

    Null text and text without a letter get ``und`` and score 0, as does
    every text where nothing was learned.  Ties go to the language that sorts
    first.  Whole texts are read.  The two new columns must not be there yet.
    """
    clash = {pred_col, score_col} & set(docs.columns)
    if clash:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    langs = sorted(prototypes)
    dimensions = len(prototypes[langs[0]]) if langs else DIMENSIONS
    profile = np.array([prototypes[k] for k in langs], np.float32).reshape(len(langs), dimensions)
    if langs:
        profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def scored(batches):
        import pyarrow as pa

        table, letters = _letter_table(), letter_vectors(seed, dimensions)
        place, used = np.full(LETTERS**3, -1, np.int32), 0
        known = np.zeros((CACHED_ROWS, dimensions), np.float32)
        for batch in batches:
            preds, scores = [], []
            for x in batch.column(text_col):
                codes, n = trigram_counts(x.as_py(), table)
                if not len(codes) or not langs:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                bundle = np.zeros(dimensions, np.float32)
                for at in range(0, len(codes), 2048):
                    some, weight = codes[at : at + 2048], n[at : at + 2048].astype(np.float32)
                    new = some[place[some] < 0]
                    if used + len(new) > CACHED_ROWS:
                        place.fill(-1)
                        used, new = 0, some
                    if len(new):
                        place[new] = np.arange(used, used + len(new))
                        known[used : used + len(new)] = trigram_vectors(new, letters)
                        used += len(new)
                    bundle += weight @ known[place[some]]
                cosines = profile @ bundle / max(float(np.linalg.norm(bundle)), 1e-9)
                best = int(cosines.argmax())
                preds.append(langs[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, pred_col, score_col]
            )

    return docs.mapInArrow(trimmed(scored), schema)


def collect_prototypes(prototypes: DataFrame, most: int = 1000) -> dict[str, list[float]]:
    """The fitted model on the driver: ``most`` languages of ``DIMENSIONS`` numbers at most."""
    got = prototypes.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} languages")
    return {r["lang"]: list(r["vector"]) for r in got}


def _learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[float]]:
    return collect_prototypes(fit_prototypes(docs.filter(~F.coalesce(held_out(F.col(id_col)), F.lit(False))), lang_col, text_col))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict every row: ``doc_id, held_out, lang_pred, score``.

    A null id is not held out.  Repeated rows each get their row; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_language(rows, _learned(docs, id_col, text_col, lang_col))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.1, least_chars: int = 400
) -> DataFrame:
    """The rows of ``docs`` in some language, with their columns.

    A row goes if its text is null or has no letter, or if it has
    ``least_chars`` characters and is like no language (a cosine under
    ``least_score``); in a shorter text a low cosine says little.  Without
    any labelled row only texts without a letter go.
    """
    model = _learned(docs, id_col, text_col, lang_col)
    found = with_language(docs, model, text_col, "_lexstrata_lang", "_lexstrata_score")
    if model:
        kept = found.filter((F.col("_lexstrata_lang") != UNKNOWN) & ((F.col("_lexstrata_score") >= least_score) | (F.length(text_col) < least_chars)))
    else:
        kept = found.filter(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    return kept.drop("_lexstrata_lang", "_lexstrata_score")
