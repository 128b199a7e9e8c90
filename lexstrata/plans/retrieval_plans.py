"""Retrieval channels: vectors, keywords, outside results and intents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexstrata.functions.text import words
from lexstrata.operators import dictionary, keyword, projections, scope, vectors
from lexstrata.plans.base import Family

family = Family()
QUERIES, ORACLES = family.QUERIES, family.ORACLES

#: Unit vectors of the embeddings.
UNIT = """
    d AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM d),
    u AS (SELECT vec_id, label, list_transform(e, lambda x: x / n) AS v FROM n)"""
PAIRS = f"WITH {UNIT}, p AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, round(list_inner_product(q.v, c.v), 6) AS score FROM u q JOIN u c ON true WHERE q.vec_id % 50 = 0)"


def unit(t):
    return t("embeddings").select("vec_id", "label", vectors.normalised(F.col("embedding")).alias("v"))


def asked(t):
    return unit(t).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")


@family.query("ret01_normalise", f"WITH {UNIT} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS length, round(v[1], 6) AS first FROM u")
def _(t):
    return unit(t).select("vec_id", F.round(vectors.norm(F.col("v")) * vectors.norm(F.col("v")), 6).alias("length"), F.round(F.col("v")[0], 6).alias("first"))


@family.query(
    "ret02_exact_top_k",
    PAIRS + ", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10",
)
def _(t):
    return vectors.exact_top_k(asked(t), unit(t).select("vec_id", "v"), 10)


@family.query("ret03_cells_top_k")
def _(t):
    return vectors.cell_top_k(asked(t), unit(t).select("vec_id", "v"), 10)


@family.query("ret03_projection_tables")
def _(t):
    return projections.projected_top_k(asked(t), unit(t).select("vec_id", "v"), 10)


@family.query(
    "ret04_per_collection",
    PAIRS + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS r FROM p),
    m AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM r WHERE r <= 3)
    SELECT query_id, CAST(label AS VARCHAR) AS collection, vec_id, score, rank FROM m WHERE rank <= 10""",
)
def _(t):
    each = vectors.exact_top_k(asked(t), unit(t), 3, collection="label").drop("rank")
    return vectors.top_k(each, ["query_id"], 10).select("query_id", "collection", "vec_id", "score", "rank")


BM25 = r"""
    f AS (SELECT doc_id, 'content' AS field, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents UNION ALL SELECT doc_id, 'source', regexp_extract_all(lower(source), '[\p{L}\p{N}]+') FROM documents),
    st AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM f GROUP BY 1),
    tf AS (SELECT doc_id, field, any_value(length) AS length, term, count(*) AS tf FROM (SELECT doc_id, field, len(w) AS length, unnest(w) AS term FROM f) GROUP BY doc_id, field, term),
    df AS (SELECT term, field, count(*) AS df FROM tf GROUP BY 1, 2),
    qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
    sc AS (SELECT query_id, doc_id, field, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS s
           FROM qt JOIN tf USING (term) JOIN df USING (term, field) JOIN st USING (field) GROUP BY 1, 2, 3),
    bm AS (SELECT query_id, doc_id, round(max(s * CASE field WHEN 'source' THEN 2.0 ELSE 1.0 END), 6) AS score FROM sc GROUP BY 1, 2),
    kw AS (SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm) WHERE rank <= 20)"""


def keyword_hits(t, k: int = 20):
    questions = t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return keyword.bm25_top_k(questions, t("documents"), {"content": "text", "source": "source"}, {"content": 1.0, "source": 2.0}, k)


@family.query("ret05_bm25_top_k", f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM kw")
def _(t):
    return keyword_hits(t)


@family.query(
    "ret05_collections_and_exact_fields",
    r"""
    WITH f AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
    st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM f),
    tf AS (SELECT doc_id, lang, term, any_value(length) AS length, count(*) AS tf FROM (SELECT doc_id, lang, len(w) AS length, unnest(w) AS term FROM f) GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    qs AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT DISTINCT 1000000 + CAST(substr(source, 4) AS BIGINT), source FROM documents),
    qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM qs),
    sc AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS s
           FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN st ON true WHERE lang IN ('en', 'fr') GROUP BY 1, 2),
    ex AS (SELECT source, count(*) AS df FROM documents GROUP BY 1),
    xs AS (SELECT query_id, doc_id, 4.0 * ln(1 + ((SELECT count(source) FROM documents) - df + 0.5) / (df + 0.5)) AS s
           FROM qs JOIN documents d ON d.source = qs.text JOIN ex ON ex.source = d.source WHERE lang IN ('en', 'fr')),
    bs AS (SELECT query_id, doc_id, round(max(s), 6) AS score FROM (SELECT * FROM sc UNION ALL SELECT * FROM xs) GROUP BY 1, 2)
    SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bs) WHERE rank <= 20""",
)
def _(t):
    """Sources as untokenised numbers, languages as collections; sources are asked for beside the items."""
    sources = t("documents").select((1000000 + F.substring("source", 4, 20).cast("long")).alias("query_id"), F.col("source").alias("text")).distinct()
    questions = t("benchmark").select(F.col("item_id").alias("query_id"), "text").unionByName(sources)
    return keyword.bm25_top_k(questions, t("documents"), {"content": "text"}, {"content": 1.0, "number": 4.0}, exact={"number": "source"}, collection_col="lang", collections=["en", "fr"])


@family.query(
    "ret06_tokens",
    r"WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2",
)
def _(t):
    return t("documents").select("lang", F.explode(words(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))


@family.query("ret06_dictionary_words", "SELECT p_partkey, lower(p_name) AS words, true AS whole FROM part")
def _(t):
    """Names of parts without their spaces, split by the words that the names have.

    No two ways through these words spell one name, so all come back as they were, and ``whole`` says so.
    """
    named = t("part").select("p_partkey", F.lower("p_name").alias("name"))
    vocabulary = named.select(F.explode(F.split("name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("weight"))
    split = dictionary.analyser(vocabulary, script="a-z")(F.replace("name", F.lit(" "), F.lit("")))
    return named.withColumn("words", F.array_join(split, " ")).select("p_partkey", "words", (F.col("words") == F.col("name")).alias("whole"))


@family.query(
    "ret07_outside_results",
    """WITH h AS (SELECT page_id, url, page_id % 20 AS q, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id) - 1 AS rank FROM pages)
    SELECT q AS query_id, page_id AS item, concat('Page ', page_id, chr(10), url) AS text, CAST(rank AS INTEGER) AS rank, round(1 / (rank + 1), 6) AS score FROM h WHERE rank < 10""",
)
def _(t):
    hits = t("pages").withColumn("q", F.col("page_id") % 20)
    return scope.external_results(hits, "q", "page_id", [F.concat(F.lit("Page "), F.col("page_id")), F.col("url")])


#: Users as questions, event types as intent nodes, each with a collection of its name.
INTENTS = "i AS (SELECT user_id AS query_id, event_type AS node, round(least(1.0, max(value) / 200), 6) AS score FROM events GROUP BY 1, 2)"


def intents(t):
    return t("events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("node")).agg(F.round(F.least(F.lit(1.0), F.max("value") / 200), 6).alias("score"))


@family.query(
    "ret08_scope",
    f"""WITH {INTENTS},
    s AS (SELECT query_id, max(score) AS best, list_sort(list(node)) AS mine FROM i WHERE score >= 0.4 GROUP BY 1),
    o AS (SELECT DISTINCT i.query_id, best, list_filter(coalesce(mine, []), lambda x: x IN ('click', 'error', 'view')) AS own FROM i LEFT JOIN s USING (query_id))
    SELECT query_id, CASE WHEN best >= 0.6 AND len(own) > 0 THEN 'DIRECTED' ELSE 'GLOBAL' END AS mode,
        CASE WHEN best >= 0.6 AND len(own) > 0 THEN own ELSE ['click', 'error', 'view'] END AS primary,
        CASE WHEN best >= 0.6 AND len(own) > 0 THEN list_filter(['click', 'error', 'view'], lambda x: NOT list_contains(own, x)) ELSE [] END AS supplement FROM o""",
)
def _(t):
    return scope.retrieval_scope(intents(t).withColumn("collection", F.col("node")), ["view", "click", "error"])


@family.query(
    "ret09_quota",
    """SELECT p_partkey, CAST(CASE WHEN p_partkey % 7 = 0 OR p_partkey % 4 = 0 OR p_partkey % 5 = 0 OR p_size <= 0 THEN 0
        ELSE greatest(0, least(p_size - 1, greatest(1, floor(p_size * (p_partkey % 4) / 10.0 + 0.5)))) END AS INTEGER) AS supplement FROM part""",
)
def _(t):
    key = F.col("p_partkey")
    q = vectors.scope_quota(F.col("p_size"), (key % 4) / F.lit(10.0), key % 7 != 0, key % 5)
    return t("part").select("p_partkey", q.cast("int").alias("supplement"))


@family.query(
    "ret10_merge_by_score",
    """WITH s AS (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('inf' AS DOUBLE) ELSE value END AS score FROM events)
    SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN score IS NULL OR isnan(score) OR isinf(score) THEN CAST('-inf' AS DOUBLE) ELSE score END DESC, event_id) AS INTEGER) AS place FROM s""",
)
def _(t):
    turn = F.col("event_id") % 5
    score = F.when(turn == 1, float("nan")).when(turn == 2, float("inf")).when(turn > 2, F.col("value"))
    w = Window.partitionBy("user_id").orderBy(F.desc(vectors.finite_first(score)), "event_id")
    return t("events").select("user_id", "event_id", F.row_number().over(w).alias("place"))


@family.query("ret11_directed_depth", "SELECT p_brand, least(40, max(CASE WHEN p_partkey % 3 = 0 THEN 20 ELSE p_size END)) AS depth FROM part GROUP BY 1")
def _(t):
    rows = t("part").select("p_brand", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("top_k"))
    return scope.directed_depth(rows, "p_brand", "top_k", 20, 40)


@family.query(
    "ret13_intent_scores",
    f"""WITH {UNIT}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), a AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2),
    c AS (SELECT label, list(x ORDER BY i) AS c FROM a GROUP BY label), k AS (SELECT label, list_transform(c, lambda y: y / sqrt(list_sum(list_transform(c, lambda z: z * z)))) AS c FROM c),
    s AS (SELECT vec_id AS query_id, k.label AS node, round(list_inner_product(v, c), 6) AS score FROM u JOIN k ON true WHERE vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS INTEGER) AS rank FROM s WHERE score >= 0.1) SELECT * FROM r WHERE rank <= 3""",
)
def _(t):
    axes = unit(t).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centre = axes.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
    nodes = centre.select(F.col("label").alias("node"), vectors.normalised(F.transform("c", lambda s: s["x"])).alias("v"))
    return scope.intent_scores(asked(t), nodes, least=0.1)  # the given vectors are far from their labels' means


@family.query(
    "ret14_capped_intents",
    """
    WITH i AS (SELECT user_id AS question, CAST(hour(ts) // 12 AS INTEGER) AS sub, event_type AS node, max(value) AS score FROM events GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY question, sub ORDER BY score DESC, node) AS r FROM i),
    p AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, score DESC, sub, node) AS INTEGER) AS place FROM r)
    SELECT question, sub, node, score, place FROM p WHERE place <= 3""",
)
def _(t):
    rows = t("events").groupBy(F.col("user_id").alias("question"), F.floor(F.hour("ts") / 12).cast("int").alias("sub"), F.col("event_type").alias("node")).agg(F.max("value").alias("score"))
    return scope.capped_intents(rows)


ACTIONS = [("create", "(?i)(^| )the ", "(?i) of "), ("list", "(?i)(^| )que ", ""), ("delete", "(?i) und ", "(?i) die ")]


@family.query(
    "ret15_fitting_actions",
    r"""
    SELECT conv_id, turn, 'create' AS action FROM conversations WHERE regexp_matches(text, '(?i)(^| )the ') AND NOT regexp_matches(text, '(?i) of ')
    UNION ALL SELECT conv_id, turn, 'list' FROM conversations WHERE regexp_matches(text, '(?i)(^| )que ')
    UNION ALL SELECT conv_id, turn, 'delete' FROM conversations WHERE regexp_matches(text, '(?i) und ') AND NOT regexp_matches(text, '(?i) die ')""",
)
def _(t):
    rules = t.spark.createDataFrame(ACTIONS, "action string, pattern string, negation string")
    return scope.fitting_actions(t("conversations").select("conv_id", "turn", "text"), rules)


def tree(t):
    """Regions, their nations, and the suppliers of those; names end in a digit of the key, so that they repeat."""
    r = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.lit(True).alias("enabled"))
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name", F.lit(True))
    s = t("supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("supplier "), F.col("s_suppkey") % 10), F.col("s_suppkey") % 3 != 0)
    return r.union(n).union(s)


TREE = """
    t AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name, true AS enabled FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, true FROM nation
          UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'supplier ' || (s_suppkey % 10), s_suppkey % 3 <> 0 FROM supplier),
    w AS (SELECT id, [name] AS path, [id] AS ids, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.id, list_append(w.path, t.name), list_append(w.ids, t.id), w.depth + 1 FROM w JOIN t ON t.parent = w.id)"""


@family.query("ret16_tree_paths", f"WITH RECURSIVE {TREE} SELECT id, array_to_string(path, ' > ') AS full_path, depth, id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) AS leaf FROM w")
def _(t):
    return scope.tree_paths(tree(t)).select("id", F.array_join("path", " > ").alias("full_path"), "depth", "leaf")


@family.query(
    "ret17_ambiguous",
    f"""WITH RECURSIVE {TREE},
    k AS (SELECT o_custkey AS query_id, 's' || (o_orderkey % (SELECT count(*) FROM supplier)) AS id, max(o_totalprice) AS score FROM orders GROUP BY 1, 2),
    p AS (SELECT query_id, k.id, score, path[-1] AS leaf, array_to_string(path, ' > ') AS full_path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k.id) AS r FROM k JOIN w ON w.id = k.id),
    o AS (SELECT p.*, CAST(row_number() OVER (PARTITION BY p.query_id ORDER BY p.score DESC, p.id) AS INTEGER) AS option FROM p JOIN p f ON f.query_id = p.query_id AND f.r = 1 AND f.leaf = p.leaf),
    m AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM o WHERE option <= 6)
    SELECT query_id, option, id, full_path, score FROM m WHERE n > 1""",
)
def _(t):
    n = t("supplier").agg(F.count("*").alias("n"))
    ranked = t("orders").crossJoin(F.broadcast(n)).select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("s"), F.col("o_orderkey") % F.col("n")).alias("id"), F.col("o_totalprice").alias("score"))  # one row: a count
    return scope.ambiguous(ranked, scope.tree_paths(tree(t)))


@family.query(
    "ret17_ambiguous_by_question",
    f"""WITH RECURSIVE {TREE},
    k AS (SELECT c_custkey AS query_id, 's' || s_suppkey AS id, max(l_extendedprice) AS score FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
    q AS (SELECT c_custkey AS query_id, replace(lower('which of them in ' || n_name || ' is it'), ' ', '') AS question FROM customer JOIN nation ON n_nationkey = c_nationkey),
    p AS (SELECT query_id, k.id, score, path, array_to_string(path, ' > ') AS full_path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k.id) AS r FROM k JOIN (SELECT id, [path[1], path[2] || ' site', path[2], path[3]] AS path FROM w WHERE id LIKE 's%') w ON w.id = k.id),
    o AS (SELECT p.*, CAST(row_number() OVER (PARTITION BY p.query_id ORDER BY p.score DESC, p.id) AS INTEGER) AS option FROM p JOIN p f ON f.query_id = p.query_id AND f.r = 1 JOIN q ON q.query_id = p.query_id
          WHERE p.id = f.id OR p.path[4] = f.path[4] OR (p.path[3] = f.path[3] AND (contains(question, replace(lower(p.path[3]), ' ', '')) OR contains(question, replace(lower(p.path[2]), ' ', ''))))),
    m AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM o)
    SELECT query_id, option, id, full_path, score FROM m WHERE n > 1 AND option <= 6""",
)
def _(t):
    """Each supplier below a site and a nation of its own, so that paths part above nodes with the same names."""
    names = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = F.col("s_suppkey").cast("string")
    level = lambda i, up, name: names.select(i.alias("id"), up.alias("parent"), name.alias("name"))
    nodes = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nodes = nodes.unionByName(level(F.concat(F.lit("x"), s), F.concat(F.lit("r"), "r_regionkey"), F.concat("n_name", F.lit(" site"))))
    nodes = nodes.unionByName(level(F.concat(F.lit("n"), s), F.concat(F.lit("x"), s), F.col("n_name"))).unionByName(level(F.concat(F.lit("s"), s), F.concat(F.lit("n"), s), F.concat(F.lit("supplier "), F.col("s_suppkey") % 10)))
    bought = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("s"), "l_suppkey").alias("id"), F.col("l_extendedprice").alias("score"))
    question = F.concat(F.lit("Which of them in "), "n_name", F.lit(" is it"))
    questions = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("query_id"), question.alias("question"))
    return scope.ambiguous(bought, scope.tree_paths(nodes), questions=questions)


@family.query(
    "ret18_subtree_closure",
    f"""WITH RECURSIVE {TREE},
    c AS (SELECT id FROM t WHERE id LIKE 'n%' OR (id LIKE 's%' AND CAST(substr(id, 2) AS BIGINT) % 2 = 0)),
    x AS (SELECT id AS below, unnest(ids) AS target FROM w)
    SELECT target, list_sort(list(below)) AS offenders FROM x JOIN t ON t.id = below WHERE below <> target AND enabled AND target IN (SELECT id FROM c) AND below NOT IN (SELECT id FROM c) GROUP BY target""",
)
def _(t):
    nodes = tree(t)
    chosen = nodes.filter("id like 'n%' or (id like 's%' and cast(substr(id, 2) as bigint) % 2 = 0)")
    return scope.closure_offenders(nodes, chosen)
