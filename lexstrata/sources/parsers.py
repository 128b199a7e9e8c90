"""Files as block rows: CSV, Markdown and plain text."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SCHEMA = (
    "doc_id long, block_index int, kind string, level int, text string, language string, ordered boolean, "
    "items array<string>, headers array<string>, rows array<array<string>>"
)
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"\s*(```+|~~~+)\s*(\w*)\s*$")
_ITEM = re.compile(r"\s*(?:([-*+])|(\d+)[.)])\s+(.*)$")
_IMAGE = re.compile(r"\s*!\[([^\]]*)\]\(([^)]+)\)\s*$")
_RULE = re.compile(r"\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$")


def csv_table(content: str) -> tuple[list[str], list[list[str]]]:
    """Header and records of a CSV file: quotes, doubled quotes, any line end, no byte order mark.

    Blank records go, short ones are filled up with empty cells.
    """
    records = [r for r in csv.reader(io.StringIO(content.lstrip("﻿"), newline="")) if any(c.strip() for c in r)]
    if not records:
        return [], []
    header, body = records[0], records[1:]
    width = len(header)
    return header, [(r + [""] * width)[:max(width, len(r))] for r in body]


def csv_rows(files: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """``doc_id, row_index, cells map<header,value>``: each file with a header of its own."""
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(content_col).alias("content"))

    def parsed(batches):
        import pandas as pd

        for batch in batches:
            out = [
                (doc, i, dict(zip(header, record, strict=False)))
                for doc, content in zip(batch["doc_id"], batch["content"], strict=True)
                if content
                for header, records in [csv_table(content)]
                for i, record in enumerate(records)
            ]
            yield pd.DataFrame(out, columns=["doc_id", "row_index", "cells"])

    return rows.mapInPandas(parsed, "doc_id long, row_index int, cells map<string,string>")


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def markdown_blocks(text: str) -> list[dict]:
    """The blocks of a Markdown text in order: heading, paragraph, list, code, table, html and image."""
    lines, out, i = text.replace("\r\n", "\n").split("\n"), [], 0

    def add(kind, **more):
        out.append({"kind": kind, **more})

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif fence := _FENCE.match(line):
            end = i + 1
            while end < len(lines) and not lines[end].strip().startswith(fence[1]):
                end += 1
            add("code", text="\n".join(lines[i + 1 : end]), language=fence[2] or None)
            i = end + 1
        elif head := _HEADING.match(line):
            add("heading", level=len(head[1]), text=head[2])
            i += 1
        elif image := _IMAGE.match(line):
            add("image", text=image[1], items=[image[2]])
            i += 1
        elif line.startswith("    ") or line.startswith("\t"):
            end = i
            while end < len(lines) and (lines[end].startswith(("    ", "\t")) or not lines[end].strip()):
                end += 1
            add("code", text="\n".join(x.removeprefix("    ").removeprefix("\t") for x in lines[i:end]).rstrip("\n"))
            i = end
        elif "|" in line and i + 1 < len(lines) and _RULE.match(lines[i + 1]) and "-" in lines[i + 1]:
            end = i + 2
            while end < len(lines) and "|" in lines[end]:
                end += 1
            add("table", headers=_cells(line), rows=[_cells(x) for x in lines[i + 2 : end]])
            i = end
        elif item := _ITEM.match(line):
            items = []
            while i < len(lines) and lines[i].strip():
                more = _ITEM.match(lines[i])
                if more:
                    items.append(more[3])
                else:
                    items[-1] += "\n" + lines[i].strip()
                i += 1
            add("list", ordered=item[2] is not None, items=items)
        elif re.match(r"\s*<(table|div|p|ul|ol)\b", line, re.I):
            end = i
            while end < len(lines) and lines[end].strip():
                end += 1
            add("html_table" if "<table" in line.lower() else "paragraph", text="\n".join(lines[i:end]))
            i = end
        else:
            end = i + 1
            while end < len(lines) and lines[end].strip() and not (_HEADING.match(lines[end]) or _FENCE.match(lines[end]) or _ITEM.match(lines[end])):
                end += 1
            add("paragraph", text="\n".join(lines[i:end]))
            i = end
    return out


def document_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of each Markdown or plain text, in ``BLOCK_SCHEMA``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]

    def parsed(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                out += [{"doc_id": doc, "block_index": i, **b} for i, b in enumerate(markdown_blocks(text or ""))]
            frame = pd.DataFrame(out, columns=names).astype(object)
            yield frame.where(frame.notna(), None)

    return rows.mapInPandas(parsed, BLOCK_SCHEMA)
