"""Alignment of a sentence with its repaired version, and the editing phrase between reparandum and repair."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"


def edits(original: str, repaired: str) -> list[tuple[str, int, int, int, int]]:
    """Longest-block alignment of white-space tokens: (tag, from, to, from, to); tags are equal, insert, replace and delete."""
    return SequenceMatcher(None, original.split(), repaired.split()).get_opcodes()


def with_phrase(original: str | None, repaired: str | None, phrase: str = "I mean,") -> str:
    """The repaired sentence with the phrase after the first comma token of each inserted or replaced stretch.

    An inserted stretch without a comma takes it at its end, a replaced one doesn't take it. Empty if a side is null or the repaired one blank.
    """
    if original is None or repaired is None or not repaired.strip():
        return ""
    words, out = repaired.split(), []
    for tag, _, _, begin, end in edits(original, repaired):
        part = words[begin:end]
        if tag in ("insert", "replace"):
            comma = next((i for i, w in enumerate(part) if "," in w), None)
            if comma is not None:
                part.insert(comma + 1, phrase)
            elif tag == "insert":
                part.append(phrase)
        out += part
    return " ".join(out)


def _with_column(df: DataFrame, original: str, repaired: str, name: str, kind: str, arrow: pa.DataType, make) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for batch in batches:
            made = [make(a, b) for a, b in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(made, arrow)], [*batch.schema.names[:-2], name])

    texts = df.select("*", F.col(original).cast("string").alias("_original"), F.col(repaired).cast("string").alias("_repaired"))
    return texts.mapInArrow(run, f"{schema}, `{name}` {kind}")


def with_edits(df: DataFrame, original: str, repaired: str, name: str = "edits") -> DataFrame:
    """df with the alignment of two text columns; null if either is null."""
    one = pa.struct([("tag", pa.string()), *((c, pa.int32()) for c in ("i1", "i2", "j1", "j2"))])
    make = lambda a, b: None if a is None or b is None else [dict(zip(("tag", "i1", "i2", "j1", "j2"), e)) for e in edits(a, b)]
    return _with_column(df, original, repaired, name, OPS, pa.list_(one), make)


def with_interregnum(df: DataFrame, original: str, repaired: str, name: str = "with_phrase", phrase: str = "I mean,") -> DataFrame:
    """df with the repaired text that holds the phrase."""
    return _with_column(df, original, repaired, name, "string", pa.string(), lambda a, b: with_phrase(a, b, phrase))
