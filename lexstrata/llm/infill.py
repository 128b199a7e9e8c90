"""Fill-in-middle by secondary sort.

Each text is cut into pieces of a bounded number of code points, keyed by its
row and by the place that they have in the output.  One shuffle brings the
pieces of a row together in output order, where they stream into a digest;
what is restored from that stream, by its marks alone, is sorted again inside
the task and streams into a second digest.  A task holds a batch of pieces,
never a text of many pieces.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexstrata.llm.common import trimmed, written
from lexstrata.llm.copies import COPIES, PRINT, apart, together
from lexstrata.llm.pieces import batches_of, rows_of

#: Code points of a piece at most.
UNIT = 1 << 16
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many stay plain; of 100 others so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Order of the parts in the output of a form, and in the text.
LAID = {"psm": "PSM", "spm": "SPM"}
TEXT_ORDER = "PMS"


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def plan(id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> dict[str, Column]:
    """Columns ``text, n, form, prefix_chars, middle_chars``: which form a text gets, and where it is cut."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.length(text).cast("long")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    h1, h2, h3, h4 = draws(key, seed)
    plain = (text == "") | (h3 % 100 >= 100 - PLAIN)
    for mark in MARKS:
        plain = plain | text.contains(mark)
    a, b = h1 % (n + 1), h2 % (n + 1)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    prefix, middle = F.when(~plain, F.least(a, b)), F.when(~plain, F.greatest(a, b) - F.least(a, b))
    return {"text": text, "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle}


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """``doc_id`` and the columns of ``plan`` for each row."""
    return docs.select(F.col(id_col).alias("doc_id"), *(c.alias(name) for name, c in plan(id_col, text_col, seed).items()))


def _spans(n: int, form: str, prefix: int | None, middle: int | None) -> list[tuple[str, int, int]]:
    """Mark, begin and end in the text of each part of an output, in output order."""
    if form == "plain":
        return [("", 0, n)]
    parts = {"P": ("<P>", 0, prefix), "M": ("<M>", prefix, prefix + middle), "S": ("<S>", prefix + middle, n)}
    return [parts[k] for k in LAID[form]]


def output_pieces(plans: DataFrame, unit: int = UNIT) -> DataFrame:
    """``at, data`` for each piece of the outputs of ``planned`` texts, beside all other columns but the text.

    ``at`` is the piece's place in the output in code points.  A mark is a
    piece of its own; an empty output has one empty piece.  ``data`` is UTF-8,
    compressed, as it moves.
    """
    kept = [f for f in plans.schema.fields if f.name != "text"]
    schema = StructType([*kept, *StructType.fromDDL("at long, data binary").fields])
    made, names = batches_of(schema), [f.name for f in kept]
    n, form, prefix, middle = (names.index(c) for c in ("n", "form", "prefix_chars", "middle_chars"))

    def cut(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        out, held = [], 0
        for *r, text in rows_of(batches, [*names, "text"]):
            at = 0
            for mark, begin, end in _spans(r[n], r[form], r[prefix], r[middle]):
                for k in range(begin - unit if mark or not text else begin, end, unit):
                    piece = mark if k < begin else text[k : min(k + unit, end)]
                    out.append((*r, at, squeeze(piece.encode("utf-8", "surrogatepass"))))
                    at, held = at + len(piece), held + len(piece)
                    if held >= 16 * UNIT:
                        yield made(out)
                        out, held = [], 0
        yield made(out)

    return plans.mapInArrow(trimmed(cut), schema)


class Restorer:
    """Finds the parts of an output that comes in pieces, by its marks alone."""

    def __init__(self, form: str):
        self.plain, self.part, self.held = form == "plain", None, ""

    def feed(self, piece: str, last: bool = False) -> list[tuple[str, str]]:
        """Part and text of what is certain by now; a mark may lie across pieces."""
        if self.plain:
            return [("P", piece)] if piece else []
        text, out = self.held + piece, []
        while True:
            found = [(at, m) for m in MARKS if (at := text.find(m)) >= 0]
            if not found:
                break
            at, mark = min(found)
            out.append((self.part, text[:at]))
            self.part, text = mark[1], text[at + len(mark) :]
        sure = len(text)
        if not last and (at := text.rfind("<", -2)) >= 0:
            sure = at
        out.append((self.part, text[:sure]))
        self.held = text[sure:]
        return [(part, s) for part, s in out if s]


def assembled(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """From ``output_pieces``: every column but ``at, data`` once for each key, with ``output_sha256`` and ``restored_sha256``."""
    kept = [f for f in pieces.schema.fields if f.name not in ("at", "data")]
    names = [f.name for f in kept]
    at_key, form = [names.index(k) for k in keys], names.index("form")
    between = StructType([*kept, *StructType.fromDDL("place int, nr long, piece string, output_sha256 string").fields])
    done = StructType([*kept, StructField("output_sha256", between["output_sha256"].dataType), StructField("restored_sha256", between["output_sha256"].dataType)])
    made_between, made_done = batches_of(between), batches_of(done)

    def read(batches):
        """Digest of each output; its text in pieces that know their part, and a last row that knows the digest."""
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        now, digest, restorer, nr, out, held = None, None, None, 0, [], 0

        def restored(piece, last=False):
            nonlocal nr
            for part, text in restorer.feed(piece, last):
                yield (*now, TEXT_ORDER.index(part), nr, text, None)
                nr += 1

        def ended():
            yield from restored("", True)
            yield (*now, len(TEXT_ORDER), nr, None, digest.hexdigest())

        for *row, data in rows_of(batches, [*names, "data"]):
            if now is None or any(row[k] != now[k] for k in at_key):
                if now is not None:
                    out += ended()
                now, digest, restorer, nr = row, hashlib.sha256(), Restorer(row[form]), 0
            piece = expand(data)
            digest.update(piece)
            out += restored(piece.decode("utf-8", "surrogatepass"))
            held += len(piece)
            if held >= 16 * UNIT:
                yield made_between(out)
                out, held = [], 0
        if now is not None:
            out += ended()
        yield made_between(out)

    def rebuilt(batches):
        digest, out = hashlib.sha256(), []
        for *row, piece, output in rows_of(batches, [*names, "piece", "output_sha256"]):
            if output is None:
                digest.update(piece.encode("utf-8", "surrogatepass"))
                continue
            out.append((*row, output, digest.hexdigest()))
            digest = hashlib.sha256()
            if len(out) >= 4096:
                yield made_done(out)
                out = []
        yield made_done(out)

    outputs = pieces.repartition(*keys).sortWithinPartitions(*keys, "at").mapInArrow(trimmed(read), between)
    # A row's pieces lie in one task already: sorting them again needs no shuffle.
    return outputs.sortWithinPartitions(*keys, "place", "nr").mapInArrow(trimmed(rebuilt), done)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """The fill-in-middle form of each text, checked by restoring it.

    Returns one row for each input row: ``doc_id, n, form, prefix_chars,
    middle_chars, output_sha256, restored_sha256``.  Null text is empty, and
    an empty text is plain; a null id draws as the empty string.  Rows that
    are alike are worked on once and counted.  Other columns are ignored,
    whatever their names.  An empty table gives an empty result.
    """
    rows, repeated = together(planned(docs, id_col, text_col, seed))
    done = assembled(output_pieces(rows), PRINT)
    return apart(written(done, "infill") if repeated else done, repeated).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """``docs`` with the outputs in place of the texts, for writing; each row by itself, so nothing moves."""
    text, n, form, prefix, middle = plan(id_col, text_col, seed).values()
    part = {"P": F.substring(text, F.lit(1), prefix), "M": F.substring(text, prefix + 1, middle), "S": F.substring(text, prefix + middle + 1, n)}
    laid = {name: F.concat(*(x for k in order for x in (F.lit(f"<{k}>"), part[k]))) for name, order in LAID.items()}
    return docs.withColumn(text_col, F.when(form == "plain", text).when(form == "psm", laid["psm"]).otherwise(laid["spm"]))
