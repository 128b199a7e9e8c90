"""Cleaning and scalar text functions, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce
from string import ascii_letters, digits

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Han, kana and Hangul.
CJK = "\\u2E80-\\u2FDF\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF\\uF900-\\uFAFF"
CJK_STOPS, LATIN_STOPS = "。！？!?；;", ".!?;"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition without a byte order mark; Spark has no built-in for it."""
    return texts.str.normalize("NFKC").str.replace("﻿", "", regex=False)


def whitespace(text: Column) -> Column:
    """Tabs and space separators as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, "[\\t \\u00A0\\u3000]+", " "))


def joined_numbers(text: Column, depth: int = 4) -> Column:
    """``1 . 2 . 3 text`` as ``1.2.3 text`` at the start of a line, up to ``depth`` dots."""
    return reduce(lambda c, _: F.regexp_replace(c, r"^(\d+(?:\.\d+)*)\s*\.\s+(\d+)|^(\d+(?:\.\d+)*)\s+\.(\d+)", "$1$3.$2$4"), range(depth), text)


def cleaned(text: Column) -> Column:
    """No byte order mark, no blanks before a line feed, two line feeds at most together, trimmed."""
    steps = (("\\uFEFF", ""), ("[ \\t]+\\n", "\n"), ("\\n{3,}", "\n\n"))
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, text))


def token_estimate(text: Column) -> Column:
    """A quarter token for an ASCII character, one for a CJK character, a half for any other; at least 1, 0 for blank."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    ascii_n = F.length(F.regexp_replace(solid, r"[^\x00-\x7F]", ""))
    cjk_n = F.length(F.regexp_replace(solid, f"[^{CJK}]", ""))
    other = F.length(solid) - ascii_n - cjk_n
    total = F.ceil(ascii_n / 4) + cjk_n + F.ceil(other / 2)
    return F.when(F.length(solid) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), total)).cast("long")


_CJK_RUNS = re.compile(f"[{CJK.encode().decode('unicode_escape')}]+")


def token_count(text: str) -> int:
    """``token_estimate`` of one text."""
    solid = "".join(text.split())
    if solid.isascii():
        return -(-len(solid) // 4)
    ascii_n, cjk_n = len(solid.encode("ascii", "ignore")), sum(map(len, _CJK_RUNS.findall(solid)))
    return max(1, -(-ascii_n // 4) + cjk_n + -(-(len(solid) - ascii_n - cjk_n) // 2))


def sentences(text: Column, stops: str = CJK_STOPS) -> Column:
    """Sentences, each with its stop, without empty ones."""
    return F.filter(F.transform(F.split(text, f"(?<=[{stops}])"), lambda x: F.trim(x)), lambda s: s != "")


def mapped_terms(text: Column, rules: list[tuple[str, str, int]]) -> Column:
    """Synonym rewriting: rules (source, target, priority), high priority and long sources first.

    A place where the target stands already is left alone, so a rule can be
    applied twice.
    """
    hold = "\u0001"
    for source, target, _ in sorted(rules, key=lambda r: (-r[2], -len(r[0]), r[0])):
        if source and target:
            text = F.replace(text, F.lit(target), F.lit(hold)) if source in target else text
            text = F.replace(F.replace(text, F.lit(source), F.lit(target)), F.lit(hold), F.lit(target))
    return text


#: Fixed values of compound questions: words for "each", what joins subjects, what joins conditions, the word before
#: conditions, the modal that an "each" may follow, what ends a question.
EACH_OF_SUBJECTS, EACH_OF_CONDITIONS = "分别|各自", "分别"
SUBJECT_JOINTS, CONDITION_JOINTS = "和|与|及|、", "且|和|与|及|、"
BOTH_PRESENT, SHOULD, QUESTION_ENDS = "同时存在", "应?", "[?？。;；\\n]+"


def split_questions(text: Column) -> Column:
    """The parts of a compound question, each with a question mark.

    A frame has a place that lists several things, and the word "each": every
    thing is asked for by itself in the rest of the frame.  Without a frame
    that lists two things at least, stops and line feeds part the text.  A
    text of stops alone stays as it is.
    """
    whole = F.regexp_replace(F.trim(text), "[？?]$", "")
    listed = lambda x, joints: F.filter(F.transform(F.split(x, joints), lambda p: F.trim(p)), lambda p: p != "")

    def framed(pattern: str, place: int, joints: str, lead: str = "") -> tuple[Column, Column]:
        """Whether the frame fits and lists two things; the questions. ``place`` is the listing group, the others stand around it."""
        group = lambda n: F.trim(F.regexp_extract(whole, pattern, n))
        things = listed(F.regexp_replace(group(place), lead, "") if lead else group(place), joints)
        before = [x for n in range(1, place) for x in (group(n), F.lit("，"))]
        behind = [group(place + 1), group(place + 2), F.lit("？")]
        return whole.rlike(pattern) & (F.size(things) > 1), F.transform(things, lambda x: F.concat(*before, x, *behind))

    subjects = framed(f"^(.+?)[，,](.+?)({SHOULD})(?:{EACH_OF_SUBJECTS})(.+)$", 2, SUBJECT_JOINTS)
    conditions = framed(f"^(.+?)[，,]\\s*({SHOULD})(?:{EACH_OF_CONDITIONS})(.+)$", 1, CONDITION_JOINTS, f"^.*?{BOTH_PRESENT}")
    parts = listed(text, QUESTION_ENDS)
    plain = F.when(F.size(parts) > 0, F.transform(parts, lambda p: F.concat(p, F.lit("？")))).otherwise(F.array(text))
    out = F.when(text.isNull(), None)
    for fits, questions in (subjects, conditions):
        out = out.when(fits, questions)
    return out.otherwise(plain)


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*\[\d+\]\(#cite-\d+\)", "")


def json_payload(text: Column) -> Column:
    """The outermost object or list of an answer that may be fenced; null without one."""
    bare = F.regexp_replace(text, r"(?m)^\s*```[a-zA-Z]*\s*$", "")
    found = lambda pattern: F.nullif(F.regexp_extract(bare, pattern, 1), F.lit(""))
    return F.coalesce(found(r"(?s)([{\[].*[}\]])"), found(r"(?s)([{\[].*)"))


def json_list(text: Column) -> Column:
    """The strings of an answer that is a list; empty for anything else."""
    payload = json_payload(text)
    listed = F.when(payload.startswith("["), F.from_json(payload, "array<string>"))
    return F.coalesce(listed, F.array().cast("array<string>"))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` slots filled from columns; null fills nothing, unknown slots stay."""
    return reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), F.lit(template))


def row_text(pairs: list[tuple[str, Column]]) -> Column:
    """``header: value; ...`` without empty cells; line feeds become spaces."""
    cells = [F.when(F.length(F.trim(v.cast("string"))) > 0, F.concat(F.lit(h + ": "), F.regexp_replace(v.cast("string"), r"[\r\n]+", " "))) for h, v in pairs]
    return F.array_join(F.array_compact(F.array(*cells)), "; ")


def markdown_row(cells: list[Column]) -> Column:
    body = [F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *body), F.lit(" |"))


def excerpt(text: Column, size: int = 100) -> Column:
    """Trimmed text of ``size`` characters at most; a cut ends in three dots."""
    t = F.trim(text)
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size - 3), F.lit("..."))).otherwise(t)


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters that do not overlap, without white space and punctuation."""
    solid = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    return F.when(F.length(solid) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(solid) - 1, F.lit(2)), lambda i: F.substring(solid, i, F.lit(2)))
    )


def covers(question: Column, answer: Column) -> Column:
    """An answer covers a question with enough of its bigrams: two, or fewer for a short question."""
    asked = bigrams(question)
    need = F.least(F.lit(2), F.greatest(F.lit(1), F.floor(F.size(asked) * 2 / 4)))
    low = F.lower(answer)
    return F.size(F.filter(asked, lambda b: F.contains(low, b))) >= need


def anchor_count(anchors: list[str], one: Column, other: Column) -> Column:
    """How many of the terms stand in both texts."""
    both = [(F.contains(one, F.lit(a)) & F.contains(other, F.lit(a))).cast("long") for a in anchors]
    return reduce(lambda x, y: x + y, both, F.lit(0).cast("long"))


def first_match(text: Column, ladder: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The name of the first rung of which a keyword stands in the text."""
    low, out = F.lower(text), None
    for name, words in ladder:
        hit = reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


#: ``[\\p{L}\\p{N}&&[^CJK]]+`` and ``[CJK]+``, written so that Java decides most characters by one test: ASCII letters and
#: digits stand singly, and what is no ASCII, or lies outside the CJK blocks, is told by one range before it is looked up.
_PLAIN_RUN = f"[{ascii_letters}{digits}[\\x{{80}}-\\x{{10FFFF}}&&[\\p{{L}}\\p{{N}}]&&[^{CJK}]]]+"
_CJK_RUN = f"[\\u2E80-\\uFAFF&&[{CJK}]]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, and bigrams of CJK runs."""
    low = F.lower(text)
    plain = F.regexp_extract_all(low, F.lit(_PLAIN_RUN), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(_CJK_RUN), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(plain, pairs)


def round6(x: Column) -> Column:
    return F.round(x, 6)


def half_up(x: Column, digits: int = 1) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits, towards plus infinity for ties."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale
