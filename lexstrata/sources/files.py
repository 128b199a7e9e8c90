"""Folders of files as block rows: a binary scan, routing by kind and profile, and a table function over registered parsers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable
from html.parser import HTMLParser
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexstrata.sources.parsers import csv_table, markdown_blocks
from lexstrata.sources.scratch import dealt
from lexstrata.sources.tables import routed

FIELDS = {
    "block_index": "int", "kind": "string", "level": "int", "text": "string", "language": "string", "ordered": "boolean",
    "items": "array<string>", "headers": "array<string>", "rows": "array<array<string>>", "error": "string",
}
BLOCKS = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
#: A parser gets a file's bytes and gives blocks as dictionaries of some of ``FIELDS``.
Parser = Callable[[bytes], Iterable[dict]]


def decoded(content: bytes) -> str:
    """UTF-8 with or without a byte order mark, nothing else."""
    return content.decode("utf-8-sig")


def csv_blocks(content: bytes) -> list[dict]:
    """One table block; a file without any record has none."""
    headers, rows = csv_table(decoded(content))
    return [{"kind": "table", "headers": headers, "rows": rows}] if headers else []


def text_blocks(content: bytes) -> list[dict]:
    """A paragraph for each run of lines that are not blank."""
    parts = "\n".join(x.rstrip() for x in decoded(content).splitlines()).split("\n\n")
    return [{"kind": "paragraph", "text": p.strip("\n")} for p in parts if p.strip()]


class _Page(HTMLParser):
    """Headings, list and plain texts, and tables of a page; what scripts and styles hold is none."""

    APART = {"p", "div", "br", "article", "section", "nav", "footer", "header", "main", "title", "body", "ul", "ol", "li", "table", "tr", "td", "th", *(f"h{i}" for i in range(1, 7))}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.words, self.level, self.items, self.table, self.silent = [], [], 0, None, None, 0

    def text(self) -> str:
        out, self.words = " ".join("".join(self.words).split()), []
        return out

    def flush(self) -> None:
        text = self.text()
        if not text:
            return
        if self.table is not None and self.table:
            self.table[-1].append(text)
        elif self.items is not None:
            self.items.append(text)
        elif self.level:
            self.blocks.append({"kind": "heading", "level": self.level, "text": text})
        else:
            self.blocks.append({"kind": "paragraph", "text": text})

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        if tag not in self.APART:
            return
        self.flush()
        if tag == "table":
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("ul", "ol") and self.items is None:
            self.items, self.ordered = [], tag == "ol"
        elif tag[0] == "h" and tag[1:].isdigit():
            self.level = int(tag[1:])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        if tag in ("td", "th") and self.table:
            self.table[-1].append(self.text())
        elif tag in self.APART:
            self.flush()
        if tag == "table" and self.table is not None:
            rows = [r for r in self.table if any(r)]
            if rows:
                self.blocks.append({"kind": "table", "headers": rows[0], "rows": rows[1:]})
            self.table = None
        elif tag in ("ul", "ol") and self.items is not None:
            if self.items:
                self.blocks.append({"kind": "list", "items": self.items, "ordered": self.ordered})
            self.items = None
        elif tag[0] == "h" and tag[1:].isdigit():
            self.level = 0

    def handle_data(self, data):
        if not self.silent:
            self.words.append(data)


def html_blocks(content: bytes) -> list[dict]:
    """Headings, paragraphs, lists and tables in the order of the page; entities of any form are characters."""
    page = _Page()
    page.feed(decoded(content))
    page.close()
    page.flush()
    return page.blocks


PARSERS: dict[str, Parser] = {"csv": csv_blocks, "markdown": lambda content: markdown_blocks(decoded(content)), "text": text_blocks, "html": html_blocks}
#: Kinds of files, by the end of their names, and their parsers for any profile.
ROUTES = [("csv", "*", "csv"), ("md", "*", "markdown"), ("markdown", "*", "markdown"), ("txt", "*", "text"), ("html", "*", "html"), ("htm", "*", "html")]


def block_function(parsers: dict[str, Parser]):
    """A table function of a parser's name and a file's bytes; a name without a parser, or what a parser raises, is a row with the error."""

    @F.udtf(returnType=BLOCKS)
    class Blocks:
        def eval(self, parser: str, content: bytes):
            if parser not in parsers:
                yield (None,) * (len(FIELDS) - 1) + (parser,)
                return
            try:
                found = list(parsers[parser](bytes(content or b"")))
            except Exception as error:  # a bad file is a row, whatever its parser says
                yield (None,) * (len(FIELDS) - 1) + (f"{type(error).__name__}: {error}"[:500],)
                return
            for i, block in enumerate(found):
                yield (i, *(block.get(name) for name in list(FIELDS)[1:-1]), None)

    return Blocks


#: Tasks for a core that list folders; Spark's own setting has a task for each folder, up to 10,000.
LISTING_TASKS = 4


def write_files(texts: DataFrame, folder: str, key: str = "doc_id") -> None:
    """A folder ``key=value`` for each key of ``texts``, which has the key and a text, with a file of its texts, a line feed behind each.

    A file costs the same however short it is, so keys are dealt over all
    tasks.  In a mounted folder Hadoop starts two processes for every file to
    set its rights, so there tasks write the files of whole-number keys by
    themselves, under another name first; elsewhere Spark's writer does.
    """
    (value,) = (c for c in texts.columns if c != key)
    context = texts.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(folder)
    mounted = place.getFileSystem(context._jsc.hadoopConfiguration()).getScheme() == "file"
    if not mounted or not isinstance(texts.schema[key].dataType, IntegralType):
        writer = dealt(texts, key).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.partitionBy(key).text(folder)
        return
    top = place.toUri().getPath()

    def written(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        n, task = 0, TaskContext.get().partitionId()
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for k, own in groupby(rows, key=lambda row: row[0]):
            of_key = f"{top}/{key}={'__HIVE_DEFAULT_PARTITION__' if k is None else k}"
            os.makedirs(of_key, exist_ok=True)
            staged = f"{of_key}/.{uuid.uuid4().hex}"
            with open(staged, "wb") as out:
                out.writelines(f"{text or ''}\n".encode() for _, text in own)
            os.replace(staged, f"{of_key}/part-{task:05d}.txt")
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    dealt(texts.select(key, value), key).sortWithinPartitions(key).mapInArrow(written, "n long").agg(F.sum("n")).collect()


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size, modified, kind, content`` of every file below ``folder``; the kind is the end of the name."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), LISTING_TASKS * spark.sparkContext.defaultParallelism)))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    finally:
        spark.conf.set(name, before)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"), "content")


def file_blocks(files: DataFrame, parsers: dict[str, Parser] | None = None, routes: list[tuple[str, str, str]] | None = None, profile: Column | None = None) -> DataFrame:
    """``path`` and the columns of ``FIELDS`` for files ``path, kind, content``.

    ``routes`` (kind, profile, parser) choose a parser by kind and profile;
    ``parsers`` adds or replaces parsers by name.  A file that no route or
    more than one fits, or whose parser is not there, is a row with that
    error; so is one that its parser cannot read.  A file without blocks has
    no row.  The files are read once: one table function, joined laterally,
    calls the parser that the route names.
    """
    table = files.sparkSession.createDataFrame(routes or ROUTES, "kind string, profile string, parser string")
    rows = files.select("path", "kind", (profile if profile is not None else F.lit("*")).alias("profile"), "content")
    chosen = routed(rows, table).select("path", "content", "parser")
    blocks = block_function(PARSERS | (parsers or {}))
    return chosen.lateralJoin(blocks(F.col("parser").outer(), F.col("content").outer())).select("path", *FIELDS)
