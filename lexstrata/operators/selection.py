"""Row selection: optional filters, keyword search, samples, pages and condition trees."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(df: DataFrame, equals: dict | None = None, any_of: dict | None = None, contains: dict | None = None, since: dict | None = None, until: dict | None = None) -> DataFrame:
    """Only the conditions that are given; a null value leaves its condition out."""
    conditions = [F.col(c) == v for c, v in (equals or {}).items() if v is not None]
    conditions += [F.col(c).isin(list(v)) for c, v in (any_of or {}).items() if v]
    conditions += [F.contains(F.col(c), F.lit(v)) for c, v in (contains or {}).items() if v]
    conditions += [F.col(c) >= F.lit(v) for c, v in (since or {}).items() if v is not None]
    conditions += [F.col(c) < F.lit(v) for c, v in (until or {}).items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def due(schedules: DataFrame, now: str) -> DataFrame:
    """Enabled work whose time has come and that nothing holds: a lock that is null or over counts as none."""
    t = F.lit(now).cast("timestamp")
    return schedules.filter(F.col("enabled") & (F.col("next_run").isNull() | (F.col("next_run") <= t)) & (F.col("locked_until").isNull() | (F.col("locked_until") < t)))


def keyword_search(df: DataFrame, columns: list[str], keyword: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(keyword.strip().lower())) for c in columns]))


def repeatable_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows, 1 to 20, in the order of a hash of the key; the same rows every time."""
    return df.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(min(20, max(1, n)))


def page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """One page, with the number of all rows in ``total``."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total))  # one row: a count


def first_seen(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Distinct values with the place where they come first."""
    return df.groupBy(*by, value).agg(F.min(order).alias("first_at"))



def condition(tree: str | dict | bool | None, columns: list[str]) -> Column:
    """A Column from a tree of ``all``, ``any``, ``not`` and leaves ``field, operator, value``.

    Malformed parts are false, also inside ``not``.  Text is trimmed; the
    order operators compare as doubles and need finite numbers on both sides.
    """
    if isinstance(tree, str):
        try:
            tree = json.loads(tree)
        except ValueError:
            return F.lit(False)
    made = _condition(tree, columns)
    return F.lit(False) if made is None else F.coalesce(made, F.lit(False))


def _condition(tree, columns: list[str]) -> Column | None:
    """None marks a malformed tree, so that ``not`` can't turn it into true."""
    if isinstance(tree, bool):
        return F.lit(tree)
    if not isinstance(tree, dict):
        return None
    if "all" in tree or "any" in tree:
        name = "all" if "all" in tree else "any"
        if not isinstance(tree[name], list):
            return None
        parts = [_condition(x, columns) for x in tree[name]]
        known = [F.lit(False) if p is None else F.coalesce(p, F.lit(False)) for p in parts]
        if name == "all":
            return reduce(lambda a, b: a & b, known, F.lit(True))
        return reduce(lambda a, b: a | b, known, F.lit(False))
    if "not" in tree:
        inner = _condition(tree["not"], columns)
        return None if inner is None else ~F.coalesce(inner, F.lit(False))
    return _leaf(tree, columns)


def _leaf(leaf: dict, columns: list[str]) -> Column | None:
    field, operator, value = leaf.get("field"), leaf.get("operator"), leaf.get("value")
    if not isinstance(field, str) or not isinstance(operator, str):
        return None
    here = field in columns
    if operator in ("exists", "not_exists"):
        there = F.col(field).isNotNull() if here else F.lit(False)
        return there if operator == "exists" else ~there
    if not here:
        return F.lit(False) if operator != "ne" else F.lit(value is not None)
    text = F.trim(F.col(field).cast("string"))
    if operator in ("eq", "ne"):
        same = F.coalesce(text == F.lit(str(value).strip()), F.lit(False)) if value is not None else F.col(field).isNull()
        return same if operator == "eq" else ~same
    if operator == "in":
        return text.isin([str(v).strip() for v in value]) if isinstance(value, list) and value else None
    if operator == "contains":
        return F.contains(text, F.lit(str(value).strip())) if value is not None else None
    if operator == "regex":
        return text.rlike(str(value)) if value else None
    if operator in ("gt", "gte", "lt", "lte"):
        try:
            limit = float(str(value).strip())
        except ValueError:
            return None
        if not math.isfinite(limit):
            return None
        n = F.expr(f"try_cast(`{field}` as double)")
        finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
        compared = {"gt": n > limit, "gte": n >= limit, "lt": n < limit, "lte": n <= limit}[operator]
        return finite & compared
    return None
