"""Words of scripts without spaces, by a dictionary: the best way through the lattice of its words.

Runs of the chosen script are split where the words of least total cost meet;
a word's cost is minus the logarithm of its share of all weights.  Characters
that no word on the way covers stay together as a run and are split into
bigrams, as the analyser without a dictionary splits every run.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.functions.text import CJK, words

#: Words that a dictionary may have, since each worker holds all of them; and their characters together.
MOST_WORDS, MOST_CHARACTERS = 1_000_000, 8_000_000
#: Costs are whole numbers of millionths, so that ties are exact.
UNIT = 1_000_000
#: What a character outside the dictionary costs beyond the rarest possible word.
UNKNOWN = 10.0


def costs(vocabulary: DataFrame, word_col: str = "word", weight_col: str = "weight") -> tuple[dict[str, int], int]:
    """The cost of each word, lower-cased, and that of a character outside the dictionary.

    Weights of a repeated word add up; words that are null or empty, or whose
    weights are not above zero, are left out.  A dictionary beyond
    ``MOST_WORDS`` words or ``MOST_CHARACTERS`` characters is an error, found
    before any of it is fetched.
    """
    rows = vocabulary.groupBy(F.lower(word_col).alias("word")).agg(F.sum(F.col(weight_col).cast("double")).alias("weight"))
    rows = rows.filter("word <> '' and weight > 0 and weight < double('infinity')")
    n, characters, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    if n > MOST_WORDS or characters > MOST_CHARACTERS:
        raise ValueError(f"a dictionary of {n} words with {characters} characters; {MOST_WORDS} and {MOST_CHARACTERS} are held at most")
    known = {r["word"]: round(UNIT * math.log(total / r["weight"])) for r in rows.collect()}
    return known, max(known.values(), default=0) + round(UNIT * UNKNOWN)


def trie(known: dict[str, int]) -> dict:
    """Nested maps by character; the cost of a word stands under the empty string."""
    root: dict = {}
    for word, cost in known.items():
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = cost
    return root


def best_words(run: str, root: dict, unknown: int) -> list[str]:
    """The words on the cheapest way through ``run``, of equal ones that with fewest words, then with the longest last words."""
    n = len(run)
    ways: list = [None] * (n + 1)  # cost, steps, where the last step begins, whether it is a word
    ways[0] = (0, 0, 0, True)
    for at in range(n):
        cost, steps = ways[at][:2]
        lone = (cost + unknown, steps + 1, at, False)
        if ways[at + 1] is None or lone < ways[at + 1]:
            ways[at + 1] = lone
        node, end = root.get(run[at]), at + 1
        while node is not None:
            if "" in node:
                way = (cost + node[""], steps + 1, at, True)
                if ways[end] is None or way < ways[end]:
                    ways[end] = way
            node = node.get(run[end]) if end < n else None
            end += 1
    out, end, open_until = [], n, None
    pairs = lambda s: [s] if len(s) < 2 else [s[i : i + 2] for i in range(len(s) - 1)]
    while end:
        _, _, start, is_word = ways[end]
        if is_word:
            if open_until is not None:
                out.append(pairs(run[end:open_until]))
                open_until = None
            out.append([run[start:end]])
        elif open_until is None:
            open_until = end
        end = start
    if open_until is not None:
        out.append(pairs(run[:open_until]))
    return [w for part in reversed(out) for w in part]


def analyser(vocabulary: DataFrame, word_col: str = "word", weight_col: str = "weight", script: str = CJK) -> Callable[[Column], Column]:
    """An analyser for the keyword index, in place of ``words``: letters and digits outside the script as there, then the words of its runs.

    ``script`` is the inside of a character class.  Texts that are null have
    null words; empty ones have none.  The dictionary is read when the
    analyser is made, and documents and questions must share one analyser.
    """
    known, unknown = costs(vocabulary, word_col, weight_col)
    shared = vocabulary.sparkSession.sparkContext.broadcast((known, unknown))
    runs_of = re.compile(f"[{script}]+")
    built: list = []

    @F.pandas_udf("array<string>")
    def of_runs(texts):
        import pandas as pd

        if not built:
            held, lone = shared.value
            built.append((trie(held), lone))
        root, lone = built[0]
        return pd.Series([None if t is None else [w for run in runs_of.findall(t) for w in best_words(run, root, lone)] for t in texts])

    def analysed(text: Column) -> Column:
        low = F.lower(text)
        if script == CJK:
            others = F.regexp_extract_all(low, F.lit(f"[\\p{{L}}\\p{{N}}&&[^{script}]]+"), F.lit(0))
        else:
            others = words(F.regexp_replace(low, f"[{script}]+", " "))
        return F.concat(others, of_runs(low))

    return analysed
