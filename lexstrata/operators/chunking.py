"""Chunks of documents under a budget, from block rows or plain texts."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexstrata.functions.splitting import cut_pieces
from lexstrata.functions.text import token_count, words
from lexstrata.sources.parsers import markdown_blocks


@dataclass(frozen=True)
class Budget:
    max_chars: int = 1024
    rows_per_chunk: int = 50

    @property
    def overlap(self) -> int:
        return self.max_chars // 8

    @property
    def tolerance(self) -> int:
        return min(3 * self.max_chars, 8192)


CHUNK_SCHEMA = "doc_id long, chunk_index int, kind string, outline array<string>, content string, embedding_text string"


def paragraph_chunks(docs: DataFrame, budget: Budget = Budget(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, chunk_index, content``: each text as one paragraph, see ``paragraph_groups``; null and empty texts have none."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.fillna("").map(lambda x: paragraph_groups(x, budget))

    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces(F.col(text_col))).alias("chunk_index", "content"))


def runs(sizes: list[int], most: int, joint: int = 0, parts: int | None = None) -> list[tuple[int, int]]:
    """The longest runs of neighbours, from the left, whose sizes with a joint between them stay within ``most``; a larger one is alone."""
    before = [0, *accumulate(n + joint for n in sizes)]
    out, at = [], 0
    while at < len(sizes):
        end = bisect_right(before, before[at] + most + joint, at + 1) - 1
        end = max(at + 1, end if parts is None else min(end, at + parts))
        out.append((at, end))
        at = end
    return out


def greedy(parts: list[str], most: int, joint: str = "\n") -> list[list[str]]:
    """Groups of neighbours whose joined length stays within ``most``; a longer part stands alone."""
    return [parts[a:b] for a, b in runs([len(p) for p in parts], most, len(joint))]


def list_groups(items: list[str], ordered: bool, budget: Budget) -> list[str]:
    """Rendered list pieces; numbers go on from piece to piece."""
    lines = [f"{i}. {x}" if ordered else f"- {x}" for i, x in enumerate(items, 1)]
    return ["\n".join(g) for g in greedy(lines, budget.max_chars)]


def table_groups(headers: list[str], rows: list[list[str]], budget: Budget) -> list[tuple[str, str]]:
    """(Markdown piece with its header, key-value text) for groups of rows under both limits."""
    cell = lambda c: (c or "").replace("|", "\\|").replace("\n", "<br>")
    head = "| " + " | ".join(map(cell, headers)) + " |\n|" + " --- |" * len(headers)
    texts = ["; ".join(f"{h}: {' '.join(v.split())}" for h, v in zip(headers, r, strict=False) if v and v.strip()) for r in rows]
    shown = ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
    groups = runs([len(x) for x in texts], budget.max_chars, 1, budget.rows_per_chunk)
    return [("\n".join([head, *shown[a:b]]), "\n".join(texts[a:b])) for a, b in groups]


def html_table_groups(html: str, budget: Budget) -> list[str]:
    """Pieces of an HTML table by rows, each with its opening tag and the first row again.

    Spans of one cell go.  A table within the tolerance and the row limit
    stays whole, and so does one of fewer than two rows.
    """
    html = re.sub(r"""(?i)\s+(?:colspan|rowspan)\s*=\s*(["']?)1\1(?=[\s/>])""", "", html)
    rows = re.findall(r"(?is)<tr\b[^>]*>.*?</tr>", html)
    if len(rows) < 2:
        return [html]
    opening = html[: html.index(">") + 1]
    whole = len(rows) - 1 <= budget.rows_per_chunk and len(html) <= budget.tolerance
    room = (budget.tolerance if whole else budget.max_chars) - len(opening) - len("</table>") - len(rows[0])
    body = rows[1:]
    groups = runs([len(x) for x in body], room, 0, budget.rows_per_chunk)
    return [f"{opening}{rows[0]}{''.join(body[a:b])}</table>" for a, b in groups]


def code_groups(code: str, language: str | None, budget: Budget) -> list[str]:
    fence = f"```{language or ''}\n"
    whole = fence + code + "\n```"
    if len(whole) <= budget.tolerance:
        return [whole]
    return [fence + "\n".join(g) + "\n```" for g in greedy(code.split("\n"), budget.max_chars)]


def paragraph_groups(text: str, budget: Budget) -> list[str]:
    """A text that the tolerance does not cut, else its pieces under the budget; a blank one has none."""
    whole = cut_pieces(text, budget.tolerance, budget.overlap)
    return whole if len(whole) < 2 else cut_pieces(text, budget.max_chars, budget.overlap)


def block_pieces(block: dict, budget: Budget) -> list[tuple[str, str]]:
    """(content, embedding text) of one block, by its kind."""
    kind = block["kind"]
    if kind == "heading":
        return [("#" * int(block["level"]) + " " + block["text"], block["text"])]
    if kind == "list":
        return [(x, x) for x in list_groups(list(block["items"]), bool(block["ordered"]), budget)]
    if kind == "table":
        return table_groups(list(block["headers"]), [list(r) for r in block["rows"]], budget)
    if kind == "html_table":
        return [(x, re.sub(r"<[^>]+>", " ", x)) for x in html_table_groups(block["text"], budget)]
    if kind == "code":
        return [(x, x) for x in code_groups(block["text"], block["language"], budget)]
    if kind == "image":
        return [(f"{block['text']}\n![{block['text']}]({block['items'][0]})", block["text"] or block["items"][0])]
    return [(x, x) for x in paragraph_groups(block["text"], budget)]


def outline_after(outline: list[tuple[int, str]], level: int, title: str) -> list[tuple[int, str]]:
    return [x for x in outline if x[0] < level] + [(level, title)]


@dataclass(frozen=True)
class Draft:
    """A part of a document before packing; ``piece`` tells that its block was cut."""

    kind: str
    outline: tuple[str, ...]
    content: str
    embed: str
    heading: bool = False
    piece: bool = False


JOINT = "\n\n"


def _merged(parts: list[Draft]) -> Draft:
    """Parts as one, under the outline that all of them have in common."""
    if len(parts) == 1:
        return parts[0]
    shared = parts[0].outline
    for d in parts:
        n = next((i for i, (a, b) in enumerate(zip(shared, d.outline, strict=False)) if a != b), min(len(shared), len(d.outline)))
        shared = shared[:n]
    kind = next((d.kind for d in parts if d.kind != "heading"), "heading")
    return Draft(kind, shared, JOINT.join(d.content for d in parts), JOINT.join(d.embed for d in parts), any(d.heading for d in parts))


def chunk_edges(sizes: list[int], heads: list[bool], alone: list[bool], budget: Budget) -> list[int]:
    """Where chunks begin in a row of drafts, and its end.

    Every chunk is a run of drafts, so all lengths are differences of one
    running sum.  ``heads`` begin sections.  A section that fits the
    tolerance stays in one chunk: it joins what stands open before it if both
    fit the budget (the tolerance, where less than a quarter of the budget is
    open), and closes what is longer than the budget.  In a longer section
    drafts join up to the budget, and one that is ``alone`` makes a chunk
    with as many open drafts before it as the budget takes, if these and it
    fit the tolerance.  What is closed with less than a quarter of the budget
    joins the chunk before it, within the tolerance.
    """
    most, tolerance, least, joint = budget.max_chars, budget.tolerance, max(1, budget.max_chars // 4), len(JOINT)
    sums = [0, *accumulate(n + joint for n in sizes)]
    edges = [0]

    def length(a: int, b: int) -> int:
        return sums[b] - sums[a] - joint

    def close(end: int) -> None:
        if end > edges[-1]:
            small = len(edges) > 1 and length(edges[-1], end) < least and length(edges[-2], end) <= tolerance
            edges[-1:] = [end] if small else [edges[-1], end]

    bounds = [*(i for i in range(len(sizes)) if i == 0 or heads[i]), len(sizes)]
    for a, b in pairwise(bounds):
        if length(a, b) <= tolerance:
            begin = edges[-1]
            if begin < a and length(begin, b) > (tolerance if length(begin, a) < least else most):
                close(a)
            if length(edges[-1], b) > most:
                close(b)
            continue
        for i in range(a, b):
            begin = edges[-1]
            if alone[i]:
                lead = bisect_left(sums, sums[i] - most, begin, i)
                close(lead if length(lead, i + 1) <= tolerance else i)
                edges.append(i + 1)
            elif begin < i and length(begin, i + 1) > most:
                close(i)
    close(len(sizes))
    return edges


def packed_drafts(drafts: list[Draft], budget: Budget) -> list[Draft]:
    """Drafts joined to chunks, see ``chunk_edges``; a piece of a cut block, or a draft as long as the budget, is alone."""
    alone = [d.piece or len(d.content) >= budget.max_chars for d in drafts]
    edges = chunk_edges([len(d.content) for d in drafts], [d.heading for d in drafts], alone, budget)
    return [_merged(drafts[a:b]) for a, b in pairwise(edges)]


def pack_blocks(blocks: list[dict], budget: Budget) -> list[Draft]:
    """Chunks of one document's blocks; blank pieces go."""
    drafts, outline = [], []
    for block in blocks:
        heading = block["kind"] == "heading"
        if heading:
            outline = outline_after(outline, int(block["level"]), block["text"])
        pieces = block_pieces(block, budget)
        path = tuple(x for _, x in outline)
        drafts += [Draft(block["kind"], path, content, embed, heading, len(pieces) > 1) for content, embed in pieces if content.strip()]
    return packed_drafts(drafts, budget)


def chunk_documents(docs: DataFrame, budget: Budget = Budget(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of every Markdown or plain text, in ``CHUNK_SCHEMA``: parsed and packed in one pass, without a shuffle."""
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    empty = dict.fromkeys(("level", "text", "items", "ordered", "headers", "rows", "language"))

    def packed(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                chunks = pack_blocks([empty | b for b in markdown_blocks(text or "")], budget)
                out += [(doc, i, c.kind, list(c.outline), c.content, with_outline(list(c.outline), c.embed)) for i, c in enumerate(chunks)]
            yield pd.DataFrame(out, columns=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(packed, CHUNK_SCHEMA)


def with_outline(outline: list[str], body: str) -> str:
    """The body under the first outline entries that it does not hold itself."""
    missing = []
    for entry in outline:
        if entry in body:
            break
        missing.append(entry)
    return "\n".join([*missing, body])


def embedding_text(outline: Column, body: Column) -> Column:
    """Column form of ``with_outline``."""
    stop = F.array_position(F.transform(outline, lambda e: F.contains(body, e)), True)
    head = F.when(stop > 0, F.slice(outline, F.lit(1), (stop - 1).cast("int"))).otherwise(outline)
    return F.concat_ws("\n", head, body)


def table_chunks(rows: DataFrame, table_col: str, order: list[str], text: Column, rows_per_chunk: int = 50) -> DataFrame:
    """Row groups of every table: ``table_id, chunk_index, n_rows, content``."""
    place = F.row_number().over(Window.partitionBy(table_col).orderBy(*order)) - 1
    numbered = rows.select(F.col(table_col).alias("table_id"), place.alias("_at"), text.alias("_text"))
    grouped = numbered.groupBy("table_id", F.floor(F.col("_at") / rows_per_chunk).cast("int").alias("chunk_index")).agg(
        F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_r")
    )
    return grouped.select("table_id", "chunk_index", "n_rows", F.array_join(F.transform("_r", lambda r: r["_text"]), "\n").alias("content"))


def heading_chunk(level: Column, title: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title)


def image_chunk(description: Column, alt: Column, url: Column) -> Column:
    return F.concat_ws("\n", description, F.concat(F.lit("!["), alt, F.lit("]("), url, F.lit(")")))


def range_label(markers: Column) -> Column:
    """``first~last`` of the distinct markers; one marker stands alone."""
    d = F.array_distinct(markers)
    return F.when(F.size(d) == 0, F.lit("")).when(F.size(d) == 1, d[0]).otherwise(F.concat(d[0], F.lit("~"), F.element_at(d, -1)))


CLAUSE_CHUNKS = "doc_id long, clause_id long, clause_no string, part int, n_parts int, marks string, content string, chunk_id string"
_SENTENCE = re.compile("(?<=[。！？!?；;])")


def clause_units(children: list[tuple[str | None, str]], most_tokens: int) -> list[tuple[str | None, str]]:
    """``marker, text`` of a clause's lines; a line over the limit is one unit for each sentence, with its marker."""

    def shown(marker, text):
        return f"{marker} {text.strip()}" if (marker or "").strip() else text.strip()

    def pieces(marker, text):
        if token_count(shown(marker, text)) <= most_tokens:
            return [text]
        return [x for x in map(str.strip, _SENTENCE.split(text)) if x] or [text]

    return [(marker, shown(marker, x)) for marker, text in children for x in pieces(marker, text)]


def packed_units(units: list[tuple[str | None, str]], most_tokens: int) -> list[list[tuple[str | None, str]]]:
    """Units joined up to the limit; one over the limit is a group of its own."""
    return [units[a:b] for a, b in runs([token_count(text) for _, text in units], most_tokens)]


def clause_chunks(clauses: DataFrame, most_tokens: int = 450) -> DataFrame:
    """Chunks of clauses as ``structure.clauses`` gives them, with ``title`` and ``standard_no`` of their documents.

    A clause within the limit is one chunk, a longer one is cut between its
    lines, and a line over the limit between its sentences.  Every chunk
    begins with the document and the path; ``marks`` names the items in it.
    """

    def packed(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                children = [(x["marker"], x["body"]) for x in r["children"]]
                if not r["text"].strip():
                    continue
                short = token_count(r["text"]) <= most_tokens
                units = clause_units(children, 1 << 62 if short else most_tokens)
                groups = [units] if short else packed_units(units, most_tokens)
                title = f"《{r['title']}》" if r["title"] else ""
                head = [x for x in (" ".join(filter(None, (title, r["standard_no"]))), r["path"]) if x]
                for i, group in enumerate(groups):
                    body = "\n".join(x for _, x in group)
                    marks = list(dict.fromkeys(m for m, _ in group if m and m.strip())) if not short else []
                    shown = body if (r["path"] or "").endswith(r["clause_no"]) else f"{r['clause_no']} {body}"
                    name = hashlib.sha256(f"{r['doc_id']}:c:{r['clause_id']}:part:{i}".encode()).hexdigest()[:20]
                    out.append((r["doc_id"], r["clause_id"], r["clause_no"], i, len(groups), "~".join(dict.fromkeys([*marks[:1], *marks[-1:]])) or None, "\n".join([*head, shown]), name))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CLAUSE_CHUNKS.split(", ")])

    return clauses.select("doc_id", "clause_id", "clause_no", "title", "standard_no", "path", "text", "children").mapInPandas(packed, CLAUSE_CHUNKS)


def enriched(chunks: DataFrame, text_col: str, tasks: dict[str, Callable[[list[str]], list]], retries: int = 2) -> DataFrame:
    """``chunks`` with a string column for each of ``tasks`` and ``enrich_error``: the hook for models.

    A task maps a list of texts to as many answers, on Arrow batches.  What
    raises, or answers with another count, is tried again ``retries`` times
    and then text by text; a text that still fails has a null answer and the
    error, and the others keep theirs.  Null texts are empty.
    """
    names = list(tasks)
    schema = T.StructType([*chunks.schema.fields, *(T.StructField(n, T.StringType()) for n in names), T.StructField("enrich_error", T.StringType())])

    def asked(model, texts):
        answers = list(model(texts))
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
        return [None if x is None else str(x) for x in answers]

    def answered(model, texts):
        for _ in range(retries + 1):
            try:
                return [(x, None) for x in asked(model, texts)]
            except Exception as error:  # whatever a model raises
                last = f"{type(error).__name__}: {error}"[:300]
        if len(texts) == 1:
            return [(None, last)]
        return [answered(model, [x])[0] for x in texts]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            results = [answered(tasks[n], texts) if texts else [] for n in names]
            errors = [next((f"{n}: {r[i][1]}" for n, r in zip(names, results, strict=True) if r[i][1]), None) for i in range(len(texts))]
            columns = [pa.array([x for x, _ in r], pa.string()) for r in results]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(errors, pa.string())], names=[*batch.schema.names, *names, "enrich_error"])

    return chunks.mapInArrow(run, schema)


def embedded(chunks: DataFrame, id_cols: list[str], text_col: str, model=None, dimensions: int = 64) -> DataFrame:
    """``id_cols, embedding``: a pluggable model on Arrow batches, checked for count and dimension.

    ``model`` maps a list of texts to a list of vectors; without one a
    hashing embedder is used.
    """
    import numpy as np

    def default(texts: list[str]):
        out = np.zeros((len(texts), dimensions))
        for r, text in enumerate(texts):
            for w in re.findall(r"\w+", text.lower()):
                d = hashlib.blake2b(w.encode(), digest_size=8).digest()
                out[r, int.from_bytes(d[:4], "little") % dimensions] += 1 if d[4] & 1 else -1
            out[r] /= max(1e-12, float(np.linalg.norm(out[r])))
        return out.tolist()

    use = model or default

    def run(batches):
        for batch in batches:
            vectors = list(use([x or "" for x in batch[text_col]]))
            if len(vectors) != len(batch) or any(len(v) != dimensions for v in vectors):
                raise ValueError("the model returned another count or dimension")
            out = batch[id_cols].copy()
            out["embedding"] = vectors
            yield out

    rows = chunks.select(*id_cols, text_col)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in id_cols)
    return rows.mapInPandas(run, f"{kinds}, embedding array<double>")


def top_terms(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, rank, term, weight``: the stand-in for model keywords, by tf * ln((1 + N) / (1 + df))."""
    tf = docs.select(F.col(id_col).alias("doc_id"), F.explode(words(F.col(text_col))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    weight = F.round(F.col("tf") * F.ln((F.col("n") + 1) / (F.col("df") + 1)), 6)
    scored = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("weight", weight)  # one row: the size of the corpus
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("doc_id", "rank", "term", "weight")


def with_metadata(metadata: Column, fields: dict[str, Column], allowed: list[str] | None = None) -> Column:
    """Pipeline fields added to a metadata map, which win over its own, then an optional allow list."""
    added = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])
    own = F.map_filter(metadata, lambda k, v: ~k.isin(list(fields)))
    both = F.map_concat(own, added)
    return both if allowed is None else F.map_filter(both, lambda k, v: k.isin(allowed))
