"""Text and scalar functions over documents, questions and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexstrata.functions import splitting, text
from lexstrata.plans.base import Family
from lexstrata.plans.retrieval_plans import BM25, keyword_hits

family = Family()
QUERIES, ORACLES = family.QUERIES, family.ORACLES

RULES = [("tion", "tional", 5), ("the", "THE", 3), ("and", "plus", 3), ("of", "from", 1)]
LADDER = [("secret", ["token =", "password", "secret"]), ("contact", ["@", "555-"]), ("license", ["all rights reserved", "license"])]
ANCHORS = ["the", "tion", "ing", "und", "que"]


@family.query("txt01_nfkc")
def _(t):
    return t("documents").select("doc_id", text.nfkc("text").alias("clean"))


@family.query(
    "txt02_whitespace",
    r"""SELECT doc_id, trim(regexp_replace(text, '[\t \x{00A0}\x{3000}]+', ' ', 'g')) AS clean FROM documents""",
)
def _(t):
    return t("documents").select("doc_id", text.whitespace(F.col("text")).alias("clean"))


@family.query(
    "txt03_joined_numbers",
    """SELECT l_orderkey, l_linenumber, concat(l_orderkey, '.', l_linenumber, '.', l_suppkey, ' item') AS line FROM lineitem""",
)
def _(t):
    raw = F.concat_ws("", "l_orderkey", F.lit(" . "), "l_linenumber", F.lit(" . "), "l_suppkey", F.lit(" item"))
    return t("lineitem").select("l_orderkey", "l_linenumber", text.joined_numbers(raw).alias("line"))


@family.query(
    "txt04_line_elements",
    r"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS raw,
               generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS n
        FROM documents
    ), c AS (SELECT doc_id, n, trim(regexp_replace(raw, '[\t \x{00A0}\x{3000}]+', ' ', 'g')) AS line FROM l),
    k AS (SELECT * FROM c WHERE line <> '')
    SELECT doc_id, row_number() OVER w - 1 AS element_index, line,
           CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset
    FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)""",
)
def _(t):
    return splitting.line_elements(t("documents"), [text.whitespace])


@family.query(
    "txt05_cleanup",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(65279), ''), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS clean
    FROM documents""",
)
def _(t):
    return t("documents").select("doc_id", text.cleaned(F.col("text")).alias("clean"))


@family.query("txt06_url_safe_lines")
def _(t):
    return t("documents").select("doc_id", splitting.joined_lines("text").alias("joined"))


@family.query(
    "txt07_token_estimate",
    r"""
    WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS s FROM documents),
    c AS (SELECT doc_id, length(s) AS n, length(regexp_replace(s, '[^\x00-\x7F]', '', 'g')) AS a,
                 length(regexp_replace(s, '[^\x{2E80}-\x{2FDF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]', '', 'g')) AS k FROM s)
    SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(1, ceil(a / 4) + k + ceil((n - a - k) / 2)) END AS BIGINT) AS tokens FROM c""",
)
def _(t):
    return t("documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@family.query("txt08_bounded_split")
def _(t):
    return t("documents").select("doc_id", F.posexplode(splitting.bounded_pieces("text")).alias("piece_index", "piece"))


@family.query(
    "txt09_sentences",
    r"""
    WITH s AS (SELECT item_id, string_split(regexp_replace(text, '([.!?;])', '\1' || chr(1), 'g'), chr(1)) AS p FROM benchmark),
    f AS (SELECT item_id, list_filter(list_transform(p, lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM s)
    SELECT item_id, CAST(unnest(range(0, len(p))) AS INTEGER) AS sentence_index, unnest(p) AS sentence FROM f""",
)
def _(t):
    return t("benchmark").select("item_id", F.posexplode(text.sentences(F.col("text"), text.LATIN_STOPS)).alias("sentence_index", "sentence"))


@family.query(
    "txt10_term_mapping",
    """SELECT item_id, replace(replace(replace(replace(replace(replace(text, 'tional', chr(1)), 'tion', 'tional'), chr(1), 'tional'), 'and', 'plus'), 'the', 'THE'), 'of', 'from') AS rewritten
    FROM benchmark""",
)
def _(t):
    return t("benchmark").select("item_id", text.mapped_terms(F.col("text"), RULES).alias("rewritten"))


@family.query(
    "txt11_sub_questions",
    r"""
    WITH p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[?？。;；\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p
               FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, CAST(unnest(range(0, len(p))) AS INTEGER) AS part, unnest(p) || '？' AS question FROM p""",
)
def _(t):
    users = t("conversations").filter("role = 'user'")
    return users.select("conv_id", "turn", F.posexplode(text.split_questions(F.col("text"))).alias("part", "question"))


@family.query("txt12_citation_strip", "SELECT conv_id, turn, text AS answer FROM conversations WHERE role = 'assistant'")
def _(t):
    marked = F.concat("text", F.lit(" ["), "turn", F.lit("](#cite-"), "turn", F.lit(")"))
    return t("conversations").filter("role = 'assistant'").select("conv_id", "turn", text.without_citations(marked).alias("answer"))


@family.query("txt13_json_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\n"))
    return t("events").select("event_id", F.from_json(text.json_payload(fenced), "k bigint")["k"].alias("k"))


@family.query(
    "txt14_template",
    "SELECT doc_id, concat('Document ', doc_id, ' from ', source, ' in ', lang, ': {body}') AS prompt FROM documents",
)
def _(t):
    slots = {"id": F.col("doc_id"), "source": F.col("source"), "lang": F.col("lang")}
    return t("documents").select("doc_id", text.rendered("Document {id} from {source} in {lang}: {body}", slots).alias("prompt"))


@family.query(
    "txt15_row_text",
    """SELECT p_partkey, concat('name: ', p_name, '; brand: ', p_brand, '; size: ', p_size) AS as_text,
        concat('| ', p_name, ' | ', replace(p_brand, '#', '#'), ' | ', p_size, ' |') AS as_markdown FROM part""",
)
def _(t):
    cells = [("name", F.col("p_name")), ("brand", F.col("p_brand")), ("note", F.lit(" ")), ("size", F.col("p_size"))]
    return t("part").select(
        "p_partkey", text.row_text(cells).alias("as_text"), text.markdown_row([F.col("p_name"), F.col("p_brand"), F.col("p_size")]).alias("as_markdown")
    )


@family.query(
    "txt16_excerpt",
    "SELECT doc_id, CASE WHEN length(trim(text, ' ')) > 100 THEN substr(trim(text, ' '), 1, 97) || '...' ELSE trim(text, ' ') END AS excerpt FROM documents",
)
def _(t):
    return t("documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@family.query(
    "txt18_bigram_coverage",
    r"""
    WITH q AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS answer_role FROM conversations
               WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS s, lower(answer) AS a FROM q WHERE role = 'user' AND answer_role = 'assistant'),
    b AS (SELECT *, CASE WHEN length(s) < 2 THEN [] ELSE list_transform(range(1, length(s), 2), lambda i: substr(s, i, 2)) END AS b FROM s)
    SELECT conv_id, turn, len(list_filter(b, lambda x: contains(a, x))) >= least(2, greatest(1, floor(len(b) * 2 / 4))) AS covered FROM b""",
)
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = t("conversations").withColumns({"answer": F.lead("text").over(w), "answer_role": F.lead("role").over(w)})
    return pairs.filter("role = 'user' and answer_role = 'assistant'").select(
        "conv_id", "turn", text.covers(F.col("text"), F.col("answer")).alias("covered")
    )


@family.query(
    "txt19_anchor_terms",
    f"""
    WITH {BM25}, a AS (SELECT unnest(['the', 'tion', 'ing', 'und', 'que']) AS a)
    SELECT b.item_id, d.doc_id, CAST(count(*) FILTER (contains(b.text, a) AND contains(d.text, a)) AS BIGINT) AS shared
    FROM kw JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) CROSS JOIN a GROUP BY 1, 2""",
)
def _(t):
    """Anchors shared by each question and its keyword hits over all documents."""
    b = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    pairs = keyword_hits(t).select("query_id", "doc_id").join(b, "query_id").join(t("documents").select("doc_id", "text"), "doc_id")
    return pairs.select(F.col("query_id").alias("item_id"), "doc_id", text.anchor_count(ANCHORS, F.col("question"), F.col("text")).alias("shared"))


@family.query(
    "txt20_keyword_ladder",
    """SELECT doc_id, CASE
        WHEN contains(lower(text), 'token =') OR contains(lower(text), 'password') OR contains(lower(text), 'secret') THEN 'secret'
        WHEN contains(lower(text), '@') OR contains(lower(text), '555-') THEN 'contact'
        WHEN contains(lower(text), 'all rights reserved') OR contains(lower(text), 'license') THEN 'license'
        ELSE 'plain' END AS category FROM documents""",
)
def _(t):
    return t("documents").select("doc_id", text.first_match(F.col("text"), LADDER, "plain").alias("category"))
