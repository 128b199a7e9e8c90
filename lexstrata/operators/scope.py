"""Intents: scores, scopes, caps, trees and ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexstrata.operators.closure import root_paths
from lexstrata.operators.vectors import dot, every_pair


def intent_scores(queries: DataFrame, nodes: DataFrame, least: float = 0.35, most: int = 3) -> DataFrame:
    """``query_id, node, score, rank``: cosine of query and node vectors."""
    pairs = every_pair(queries, nodes.select("node", F.col("v").alias("_nv")))
    scored = pairs.select("query_id", "node", F.round(dot(F.col("v"), F.col("_nv")), 6).alias("score")).filter(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most)


def retrieval_scope(intents: DataFrame, active: list[str], direct_at: float = 0.6, ignore_under: float = 0.4) -> DataFrame:
    """Directed search of a query's own collections if its best intent is strong and they are active, else global.

    ``intents`` are ``query_id, node, collection, score``.  Returns
    ``query_id, mode, primary, supplement`` with sorted collection lists.
    """
    strong = intents.filter(F.col("score") >= ignore_under).groupBy("query_id", "node", "collection").agg(F.max("score").alias("score"))
    all_ = F.array(*[F.lit(c) for c in sorted(active)])
    per = intents.select("query_id").distinct().join(
        strong.groupBy("query_id").agg(F.max("score").alias("best"), F.array_sort(F.collect_set("collection")).alias("mine")), "query_id", "left"
    )
    own = F.array_intersect(F.coalesce("mine", F.array().cast("array<string>")), all_)
    directed = (F.coalesce("best", F.lit(0.0)) >= direct_at) & (F.size(own) > 0)
    return per.select(
        "query_id",
        F.when(directed, "DIRECTED").otherwise("GLOBAL").alias("mode"),
        F.when(directed, F.array_sort(own)).otherwise(all_).alias("primary"),
        F.when(directed, F.array_except(all_, own)).otherwise(F.array().cast("array<string>")).alias("supplement"),
    )


def directed_depth(intents: DataFrame, group: str, depth: str, default: int, limit: int) -> DataFrame:
    """The largest depth that an intent of the group asks for, the default without one, cut at the limit."""
    return intents.groupBy(group).agg(F.least(F.lit(limit), F.max(F.coalesce(F.col(depth), F.lit(default)))).alias("depth"))


def capped_intents(intents: DataFrame, most: int = 3) -> DataFrame:
    """At most ``most`` intents of a question: the best of each sub-question first, then the best of the rest.

    ``intents`` are ``question, sub, node, score``; ties go to the smaller
    sub-question and node.
    """
    first = F.row_number().over(Window.partitionBy("question", "sub").orderBy(F.desc("score"), "node"))
    order = Window.partitionBy("question").orderBy(F.when(F.col("_r") == 1, 0).otherwise(1), F.desc("score"), "sub", "node")
    return intents.withColumn("_r", first).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("_r")


def fitting_actions(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """(question, action) pairs whose verb pattern fits and whose negation does not."""
    pairs = every_pair(questions, rules).filter("text rlike pattern and not (length(negation) > 0 and text rlike negation)")
    return pairs.select(*[c for c in questions.columns if c != "text"], "action")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """``id, path array, ids array, depth, leaf`` of a forest ``id, parent, name`` of any depth.

    Nodes that no root has below it (on a cycle, or under a missing parent)
    have no path and are left out.
    """
    inner = nodes.filter("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("_inner", F.lit(True))
    found = root_paths(nodes).join(inner, "id", "left")
    return found.select("id", "path", "ids", (F.size("ids") - 1).alias("depth"), F.col("_inner").isNull().alias("leaf"))


def closure_offenders(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Enabled descendants outside of a chosen set, by chosen node: ``target, offenders``; none means the set may go."""
    live = nodes.filter("enabled").select("id").join(chosen.select("id"), "id", "left_anti")
    above = root_paths(nodes).join(live, "id").select(F.col("id").alias("below"), F.explode("ids").alias("id")).filter("below <> id")
    return above.join(chosen.select("id"), "id").groupBy(F.col("id").alias("target")).agg(F.array_sort(F.collect_list("below")).alias("offenders"))


def plain_name(name: Column) -> Column:
    """A name without case and outer or inner white space, by which names are compared."""
    return F.regexp_replace(F.lower(name), r"\s+", "")


def ambiguous(ranked: DataFrame, paths: DataFrame, most: int = 6, questions: DataFrame | None = None) -> DataFrame:
    """Intents that may be mistaken for a query's best one.

    Another node is one if its last name is the same, or, with ``questions``
    (``query_id, question``), if behind the nodes that both paths have in
    common a name stands in both of them and in the question.  ``ranked`` are
    ``query_id, id, score``; the best of each node counts once; empty names
    are not compared.
    """
    per = ranked.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    per = per.join(paths.select("id", "ids", F.transform("path", plain_name).alias("names"), F.array_join("path", " > ").alias("full_path")), "id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    first = per.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("query_id", F.col("id").alias("_id"), F.col("ids").alias("_ids"), F.col("names").alias("_names"))
    asked = first if questions is None else first.join(questions.select("query_id", plain_name(F.col("question")).alias("_question")), "query_id", "left")
    both = per.join(asked, "query_id")
    leaf = F.element_at("names", -1)
    same = (leaf != "") & (leaf == F.element_at("_names", -1))
    if questions is not None:
        pairs = F.arrays_zip(F.col("ids").alias("a"), F.col("_ids").alias("b"))
        parted = F.array_position(F.transform(pairs, lambda p: ~p["a"].eqNullSafe(p["b"])), True)  # the first place where the paths part
        behind = lambda names: F.slice(names, parted.cast("int"), F.size(names))
        shared = F.array_intersect(behind("names"), behind("_names"))
        named = F.exists(shared, lambda x: (x != "") & F.contains(F.coalesce(F.col("_question"), F.lit("")), x))
        same = same | F.when(parted > 0, named).otherwise(F.lit(False))
    options = both.filter((F.col("id") == F.col("_id")) | same).withColumn("option", F.row_number().over(order))
    many = options.groupBy("query_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    return options.filter(F.col("option") <= most).join(many, "query_id", "left_semi").select("query_id", "option", "id", "full_path", "score")


def external_results(items: DataFrame, group: str, order: str, parts: list[Column], most: int = 10) -> DataFrame:
    """Hits of an outside search, read as a table: text of their parts, score 1 / (rank + 1), cut at ``most``."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    ranked = items.withColumn("_p", place).filter(F.col("_p") < most)
    return ranked.select(F.col(group).alias("query_id"), F.col(order).alias("item"), F.concat_ws("\n", *parts).alias("text"), F.col("_p").alias("rank"), F.round(1 / (F.col("_p") + 1), 6).alias("score"))
