"""Pieces of long values, streamed in order into digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from lexstrata.llm.common import trimmed


def rows_of(batches, columns: list[str]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of the named columns, a batch at a time."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def piece_digests(pieces: DataFrame, keys: list[str], order: list[str], data: str, between: bytes = b"") -> DataFrame:
    """``keys`` and ``sha256`` of each key's pieces, in order and with ``between`` between them.

    A secondary sort brings the pieces of a key together; a task holds one
    batch of pieces and one digest, however long a key's value is.
    """
    schema = StructType([f for f in pieces.schema.fields if f.name in keys] + [StructField("sha256", StringType())])
    names = [f.name for f in schema.fields[:-1]]
    out = batches_of(schema)

    def digests(batches):
        now, digest, done = None, None, []
        for *key, piece in rows_of(batches, [*names, data]):
            piece = piece.encode() if isinstance(piece, str) else piece
            if digest is None or key != now:
                if digest is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(piece)
            else:
                digest.update(between)
                digest.update(piece)
            if len(done) >= 4096:
                yield out(done)
                done = []
        if digest is not None:
            done.append((*now, digest.hexdigest()))
        yield out(done)

    sorted_pieces = pieces.select(*names, *order, data).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_pieces.mapInArrow(trimmed(digests), schema)


def batches_of(schema: StructType):
    """A function that makes an Arrow batch of rows given as tuples."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def made(rows: list[tuple]):
        import pyarrow as pa

        columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return made


