"""Regulation structure over derived line tables, and token distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexstrata.functions import text
from lexstrata.operators import structure
from lexstrata.plans.base import Family

family = Family()
QUERIES, ORACLES = family.QUERIES, family.ORACLES

#: Each supplier is a document, and each of its line items a line of it.
LINES = """
    o AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, l_partkey AS p FROM lineitem),
    lines AS (
        SELECT doc_id, i AS line_index, CASE
            WHEN i % 23 = 0 AND i > 0 THEN concat('Chapter ', i // 23, ' General rules')
            WHEN i % 23 = 7 THEN concat('Section ', i // 23, ' Scope')
            WHEN i % 69 = 22 THEN 'Commentary'
            WHEN i % 92 = 20 THEN 'Appendix A Tables'
            WHEN i % 4 = 1 THEN concat(i // 23 + 1, '.', (i % 23) // 2, ' The part ', p, ' 应当 be kept.')
            WHEN i % 4 = 2 THEN concat('(', i % 5 + 1, ') item ', p)
            ELSE concat('plain line ', p) END AS line FROM o),
    kinds AS (
        SELECT *, CASE WHEN line = 'Commentary' THEN 'role' WHEN line LIKE 'Appendix %' THEN 'appendix' WHEN line LIKE 'Chapter %' THEN 'chapter' WHEN line LIKE 'Section %' THEN 'section'
                       WHEN regexp_matches(line, '^\\d+\\.\\d+ ') THEN 'clause' WHEN line LIKE '(%' THEN 'item' ELSE 'text' END AS k FROM lines),
    befores AS (
        SELECT *, coalesce(last_value(CASE WHEN k = 'clause' THEN 1 WHEN k IN ('chapter', 'section', 'appendix', 'role') THEN 0 END IGNORE NULLS)
            OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM kinds),
    named AS (SELECT *, CASE WHEN k = 'item' AND before = 0 THEN 'text' ELSE k END AS line_type FROM befores),
    marked AS (
        SELECT *, last_value(CASE k WHEN 'role' THEN 'COMMENTARY' WHEN 'appendix' THEN 'APPENDIX' END IGNORE NULLS) OVER w AS put,
            max(CASE WHEN k IN ('role', 'appendix') THEN line_index END) OVER w AS put_at, max(CASE WHEN k IN ('chapter', 'section') THEN line_index END) OVER w AS lifted,
            max(CASE WHEN k IN ('chapter', 'section', 'clause') THEN line_index END) OVER w AS begun
        FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY line_index)),
    typed AS (
        SELECT *, CASE line_type WHEN 'role' THEN line WHEN 'appendix' THEN 'Appendix A' WHEN 'chapter' THEN 'Chapter ' || string_split(line, ' ')[2] WHEN 'section' THEN 'Section ' || string_split(line, ' ')[2]
                  WHEN 'clause' THEN string_split(line, ' ')[1] WHEN 'item' THEN string_split(line, ' ')[1] END AS number,
               CASE line_type WHEN 'role' THEN '' WHEN 'appendix' THEN 'Tables' WHEN 'chapter' THEN 'General rules' WHEN 'section' THEN 'Scope' WHEN 'text' THEN line
                  ELSE substr(line, instr(line, ' ') + 1) END AS body,
               line_type = 'clause' OR (before = 1 AND line_type IN ('item', 'text')) AS in_clause,
               CASE WHEN put IS NULL THEN CASE WHEN begun IS NULL THEN 'FRONT_MATTER' ELSE 'NORMATIVE' END WHEN put = 'APPENDIX' AND lifted > put_at THEN 'NORMATIVE' ELSE put END AS region FROM marked)"""


def _numbered(t):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return t("lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.row_number().over(order) - 1).cast("long").alias("line_index"), F.col("l_partkey").alias("p"))


def regulation_lines(t):
    i = F.col("line_index")
    block = F.floor(i / 23)
    line = (
        F.when((i % 23 == 0) & (i > 0), F.concat(F.lit("Chapter "), block, F.lit(" General rules")))
        .when(i % 23 == 7, F.concat(F.lit("Section "), block, F.lit(" Scope")))
        .when(i % 69 == 22, "Commentary")
        .when(i % 92 == 20, "Appendix A Tables")
        .when(i % 4 == 1, F.concat(block + 1, F.lit("."), F.floor((i % 23) / 2), F.lit(" The part "), "p", F.lit(" 应当 be kept.")))
        .when(i % 4 == 2, F.concat(F.lit("("), i % 5 + 1, F.lit(") item "), "p"))
        .otherwise(F.concat(F.lit("plain line "), "p"))
    )
    return _numbered(t).select("doc_id", "line_index", line.alias("line"))


#: One line of each form that a Chinese regulation has, by its place in a cycle: line, line_type, number, body; ``{p}`` is the part.
FORMS = [
    ("第二章 总则", "chapter", "第二章", "总则"),
    ("封面文字 {p}", "text", None, "封面文字 {p}"),
    ("第一节 范围", "section", "第一节", "范围"),
    ("第十二条 零件{p}应当登记。", "article", "第十二条", "零件{p}应当登记。"),
    ("（一）第{p}项", "item", "（一）", "第{p}项"),
    ("二、第{p}项", "item", "二、", "第{p}项"),
    ("3）数字项{p}", "item", "3）", "数字项{p}"),
    ("续行 {p}", "text", None, "续行 {p}"),
    ("1.2.3", "text", None, "1.2.3"),
    ("A.1.{p} 附表零件不得遗失。", "clause", "A.1.{p}", "附表零件不得遗失。"),
    ("12 应当记录{p}", "item", "12", "应当记录{p}"),
    ("3.1.2.{p} 细则。", "subclause", "3.1.2.{p}", "细则。"),
    ("5.1 基本规定", "section", "5.1", "基本规定"),
    ("（二）散项{p}", "text", None, "（二）散项{p}"),
    ("7 试验应 记录", "text", None, "7 试验应 记录"),
    ("6检查要求", "chapter", "6", "检查要求"),
    ("5.1.1～5.1.{p} 一般说明。", "clause", "5.1.1~5.1.{p}", "一般说明。"),
    ("5.1.4~5.1.5", "text", None, "5.1.4~5.1.5"),
    ("8 附加要求", "chapter", "8", "附加要求"),
    ("附录B 表格", "appendix", "附录B", "表格"),
    ("B.0.1 记录{p}必须保存。", "clause", "B.0.1", "记录{p}必须保存。"),
    ("条文说明", "role", "条文说明", ""),
    ("5.1.1 说明{p}。", "clause", "5.1.1", "说明{p}。"),
    ("本规范用词说明", "role", "本规范用词说明", ""),
]


def _form_sql(at: int) -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("{p}", "' || p || '") + "'"
    return f"CASE i % {len(FORMS)} " + " ".join(f"WHEN {n} THEN {quoted(f[at])}" for n, f in enumerate(FORMS)) + " END"


def chinese_lines(t):
    i = F.col("line_index") % len(FORMS)
    line = F.coalesce(*(F.when(i == n, F.replace(F.lit(f[0]), F.lit("{p}"), F.col("p").cast("string"))) for n, f in enumerate(FORMS)))
    return _numbered(t).select("doc_id", "line_index", line.alias("line"))


@family.query(
    "str01_metadata",
    """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '规则' || o_orderpriority WHEN 1 THEN '安全规范' ELSE 'GB 99' END AS title,
        CASE o_orderkey % 3 WHEN 0 THEN 'GB/T ' || (1000 + o_orderkey % 9000) || '-2010' WHEN 1 THEN 'JGJ 59-2011' ELSE 'GB 99' END AS standard_no,
        CASE o_orderkey % 3 WHEN 0 THEN 'ENGINEERING_STANDARD' WHEN 1 THEN 'LAW_REGULATION' END AS doc_type, CASE WHEN o_orderkey % 3 = 0 THEN '建设部' END AS authority,
        CASE WHEN o_orderkey % 3 = 0 THEN DATE '2010-08-01' END AS published, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2010-12-01' END AS effective, o_orderkey % 3 = 2 AS conflict
    FROM orders""",
)
def _(t):
    number = (F.col("o_orderkey") % 9000 + 1000).cast("string")
    kind = F.col("o_orderkey") % 3
    standard = F.concat(F.lit("《规则"), "o_orderpriority", F.lit("[附条文说明]》\nGB／T "), number, F.lit("—2010\n批准部门：建设部\n2010年13月40日\n2010年8月1日发布 自2010年12月1日起施行\n1.0.1 范围"))
    law, other = F.lit("第一条 为了安全"), F.lit("GB 98\n其他文字")
    text = F.when(kind == 0, standard).when(kind == 1, law).otherwise(other)
    name = F.when(kind == 0, F.concat(F.lit("《规则"), "o_orderpriority", F.lit("》.pdf"))).when(kind == 1, "安全规范JGJ592011.txt").otherwise("《GB 99》.PDF")
    columns = ("title", "standard_no", "doc_type", "authority", "published", "effective", "conflict")
    return structure.document_metadata(t("orders").select("o_orderkey", text.alias("text"), name.alias("file_name"))).select("o_orderkey", *columns)


@family.query(
    "str02_section_filter",
    """
    WITH o AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i FROM lineitem),
    s AS (SELECT doc_id, i AS line_index, CASE
        WHEN doc_id % 5 = 0 THEN 'BODY'
        WHEN i < 3 THEN 'PREFACE' WHEN i < 7 THEN 'CHINESE_TOC' WHEN i < 200 THEN 'BODY' WHEN i < 250 THEN 'REFERENCED_STANDARDS' ELSE 'APPENDIX' END AS section FROM o)
    SELECT doc_id, line_index, section, section = 'BODY' AND NOT (doc_id % 5 = 0 AND line_index % 7 = 3) AS kept FROM s""",
)
def _(t):
    """Every fifth document has no body start, and keeps all but its contents entries."""
    rows, i, p = _numbered(t), F.col("line_index"), F.col("p").cast("string")
    plain = F.when(i % 7 == 3, F.concat(F.lit("总则 ........ "), p)).otherwise(F.concat(F.lit("正文 "), p))
    line = (
        F.when(F.col("doc_id") % 5 == 0, plain)
        .when(i == 0, "前 言").when(i == 3, "目　次").when((i > 3) & (i < 7), F.concat(F.lit("附录A 表格 ...... "), p)).when(i == 7, "第一章 总则")
        .when(i == 200, "引用标准名录").when(i == 250, "附录A 表格").when(i < 3, F.concat(F.lit("说明 "), p)).otherwise(plain)
    )
    lines = rows.select("doc_id", "line_index", line.alias("line"), i.isin(0, 3, 7, 200, 250).alias("is_heading"))
    return structure.section_filter(lines).select("doc_id", "line_index", "section", "kept")


@family.query("str03_toc_lines", "SELECT o_orderkey, o_orderkey % 3 = 0 AS is_toc, o_orderkey % 3 = 0 AS is_toc_block FROM orders")
def _(t):
    toc = F.col("o_orderkey") % 3 == 0
    line = F.when(toc, F.concat("o_orderpriority", F.lit(" ........ "), "o_custkey")).otherwise(F.concat("o_orderpriority", F.lit(" "), "o_custkey"))
    lines = t("orders").select("o_orderkey", line.alias("line"))
    return lines.select("o_orderkey", structure.toc_line(F.col("line")).alias("is_toc"), structure.toc_block(F.concat_ws("\n", "line", F.lit("note"), "line")).alias("is_toc_block"))


@family.query("str04_line_types", f"WITH {LINES} SELECT doc_id, line_index, line_type, number, body, in_clause, region FROM typed")
def _(t):
    return structure.classified(regulation_lines(t)).select("doc_id", "line_index", "line_type", "number", "body", "in_clause", "region")


@family.query(
    "str04_chinese_lines",
    f"""
    WITH o AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, l_partkey AS p FROM lineitem)
    SELECT doc_id, i AS line_index, {_form_sql(1)} AS line_type, {_form_sql(2)} AS number, {_form_sql(3)} AS body FROM o""",
)
def _(t):
    return structure.classified(chinese_lines(t)).select("doc_id", "line_index", "line_type", "number", "body")


CLAUSES = f"""WITH {LINES},
    f AS (SELECT *, sum(CASE WHEN line_type = 'clause' THEN 1 ELSE 0 END) OVER w AS c,
            last_value(CASE WHEN line_type IN ('chapter', 'appendix') THEN number END IGNORE NULLS) OVER w AS chapter,
            last_value(CASE WHEN line_type IN ('chapter', 'appendix') THEN concat_ws(' ', number, nullif(body, '')) END IGNORE NULLS) OVER w AS chapter_path,
            last_value(CASE WHEN line_type = 'section' THEN number WHEN line_type IN ('chapter', 'appendix') THEN '' END IGNORE NULLS) OVER w AS section,
            last_value(CASE WHEN line_type = 'section' THEN concat_ws(' ', number, nullif(body, '')) WHEN line_type IN ('chapter', 'appendix') THEN '' END IGNORE NULLS) OVER w AS section_path
          FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY line_index)),
    c AS (SELECT doc_id, CAST(c AS BIGINT) AS clause_id, max(CASE WHEN line_type = 'clause' THEN number END) AS clause_no, 'clause' AS structure_type, any_value(chapter) AS chapter_no,
            nullif(any_value(section), '') AS section_no, max(CASE WHEN line_type = 'clause' THEN region END) AS role, count(*) AS n_lines, count(*) FILTER (line_type = 'item') AS n_items,
            min(line_index) AS first_line, max(line_index) AS last_line, string_agg(body, chr(10) ORDER BY line_index) AS text,
            concat_ws(' / ', any_value(chapter_path), nullif(any_value(section_path), ''), max(CASE WHEN line_type = 'clause' THEN number END)) AS path
          FROM f WHERE in_clause GROUP BY doc_id, f.c)"""


@family.query(
    "str05_clauses",
    CLAUSES + """
    SELECT doc_id, clause_id, clause_no, structure_type, chapter_no, section_no, role, n_lines, n_items, first_line, last_line, path, text FROM c""",
)
def _(t):
    return structure.clauses(structure.classified(regulation_lines(t))).drop("children")


@family.query(
    "str06_inline_roles",
    CLAUSES + """,
    s AS (SELECT *, CASE WHEN clause_no = lag(clause_no) OVER (PARTITION BY doc_id ORDER BY clause_id) THEN 0 ELSE 1 END AS start FROM c),
    r AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY clause_id) AS run FROM s)
    SELECT doc_id, clause_id, clause_no, CASE WHEN row_number() OVER (PARTITION BY doc_id, run ORDER BY clause_id) % 2 = 1 THEN 'NORMATIVE' ELSE 'COMMENTARY' END AS inline_role FROM r""",
)
def _(t):
    return structure.inline_roles(structure.clauses(structure.classified(regulation_lines(t)))).select("doc_id", "clause_id", "clause_no", "inline_role")


@family.query("str07_numbered_blocks")
def _(t):
    return structure.numbered_blocks(structure.classified(regulation_lines(t)))


@family.query("str08_canonical_number", "SELECT l_orderkey, l_linenumber, concat(l_orderkey % 9, '.', l_linenumber, '.1') AS number FROM lineitem")
def _(t):
    raw = F.concat(F.col("l_orderkey") % 9, F.lit(" ．"), "l_linenumber", F.lit("。 １"))
    return t("lineitem").select("l_orderkey", "l_linenumber", structure.canonical_number(raw).alias("number"))


@family.query(
    "str09_outline_paths",
    f"""WITH {LINES},
    h AS (SELECT doc_id, line_index, line AS title, CASE line_type WHEN 'chapter' THEN 1 WHEN 'section' THEN 2 ELSE 3 END AS level FROM typed WHERE line_type IN ('chapter', 'section', 'clause')),
    w AS (SELECT *, max(CASE WHEN level = 1 THEN line_index END) OVER p AS a, max(CASE WHEN level = 2 THEN line_index END) OVER p AS b FROM h WINDOW p AS (PARTITION BY doc_id ORDER BY line_index))
    SELECT w.doc_id, w.line_index, w.level,
        list_filter([x.title, CASE WHEN w.level >= 2 AND w.b > coalesce(w.a, -1) THEN y.title END, CASE WHEN w.level = 3 THEN w.title END], lambda z: z IS NOT NULL) AS path
    FROM w LEFT JOIN h x ON x.doc_id = w.doc_id AND x.line_index = w.a LEFT JOIN h y ON y.doc_id = w.doc_id AND y.line_index = w.b""",
)
def _(t):
    lines = structure.classified(regulation_lines(t)).filter(F.col("line_type").isin("chapter", "section", "clause"))
    level = F.when(F.col("line_type") == "chapter", 1).when(F.col("line_type") == "section", 2).otherwise(3)
    heads = lines.select("doc_id", "line_index", level.alias("level"), F.col("line").alias("title"))
    return structure.outline_paths(heads, 3).select("doc_id", "line_index", "level", "path")


@family.query(
    "str10_token_distribution",
    r"""
    WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS s FROM documents),
    c AS (SELECT doc_id, length(s) AS n, length(regexp_replace(s, '[^\x00-\x7F]', '', 'g')) AS a FROM s),
    k AS (SELECT CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(1, ceil(a / 4) + ceil((n - a) / 2)) END AS BIGINT) AS t FROM c)
    SELECT count(*) AS n, min(t) AS least, round(avg(t), 4) AS mean, quantile_disc(t, 0.5) AS median, quantile_disc(t, 0.9) AS p90, quantile_disc(t, 0.95) AS p95,
        quantile_disc(t, 0.99) AS p99, max(t) AS most, count(*) FILTER (t <= 450) AS up_to_low, count(*) FILTER (t > 450 AND t <= 600) AS between, count(*) FILTER (t > 600) AS over_high FROM k""",
)
def _(t):
    return structure.token_distribution(t("documents").select(text.token_estimate(F.col("text")).alias("tokens")), "tokens")
