"""Chains and trees of any depth: pointers are doubled, so a chain of n links takes about log2(n) joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.sources.scratch import materialised


def _rounds(rows: int) -> int:
    """Doublings that reach the end of every chain among so many rows; what still moves then goes round."""
    return max(1, rows).bit_length() + 1


def chain_ends(links: DataFrame, id_col: str, next_col: str) -> DataFrame:
    """``id, end, steps, cyclic``: where the chain of each row of ``links`` ends, and how many links there are.

    Ids are unique and not null.  A chain ends with a null, or with an id
    that no row has; a row that leads into a cycle has null end and steps.
    A pointer that a third of all rows share is a skewed key of a join that
    Spark splits by itself (both sides come from shuffles).
    """
    named = links.select(F.col(id_col).alias("id"), F.col(next_col).alias("_next"))
    rows = materialised(named.select("id", F.coalesce("_next", "id").alias("end"), F.col("_next").isNotNull().cast("long").alias("steps"), F.col("_next").isNotNull().alias("_open")), "chain")
    for _ in range(_rounds(rows.count())):
        if rows.filter("_open").isEmpty():
            break
        ahead = rows.select(F.col("id").alias("end"), F.col("end").alias("_far"), F.col("steps").alias("_more"), F.col("_open").alias("_still"))
        moved = rows.filter("_open").join(ahead, "end", "left").select(
            "id", F.coalesce("_far", "end").alias("end"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), F.coalesce("_still", F.lit(False)).alias("_open")
        )
        rows = materialised(rows.filter("not _open").unionByName(moved), "chain")
    found = lambda c: F.when(~F.col("_open"), F.col(c)).alias(c)
    return rows.select("id", found("end"), found("steps"), F.col("_open").alias("cyclic"))


def root_paths(nodes: DataFrame) -> DataFrame:
    """``id, path, ids`` for each node of a forest ``id, parent, name`` that a root (null parent) has below it; both from the root down.

    Nodes on a cycle, below one, or below a parent that no row has are left
    out; ``chain_ends`` tells which these are.  A path has as many entries as
    the node is deep.
    """
    start = nodes.select("id", F.col("parent").alias("_up"), F.array("name").alias("path"), F.array("id").alias("ids"))
    rows = materialised(start, "paths")
    for _ in range(_rounds(rows.count())):
        if rows.filter("_up is not null").isEmpty():
            break
        above = rows.select(F.col("id").alias("_up"), F.col("_up").alias("_far"), F.col("path").alias("_path"), F.col("ids").alias("_ids"))
        moved = rows.filter("_up is not null").join(above, "_up")
        moved = moved.select("id", F.col("_far").alias("_up"), F.concat("_path", "path").alias("path"), F.concat("_ids", "ids").alias("ids"))
        moving = rows.filter("_up is null").unionByName(moved)
        # What has gone round has met itself; it ends here, so that paths do not grow without end.
        rows = materialised(moving.filter(F.col("_up").isNull() | ~F.array_contains("ids", F.col("_up"))), "paths")
    return rows.filter("_up is null").select("id", "path", "ids")
