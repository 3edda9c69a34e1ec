"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two that sum to n, 1024
at most, longest first. Each piece is a sequence of its own; pieces of equal length form a bucket
from which batches of one shape are drawn, so nothing is padded and no sequence crosses documents.
The work is one pass without a shuffle.

Null or empty text: the document holds its end id only, one piece of length 1. Null and repeated ids
are kept, each row as its own document. Very long texts give more pieces. Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy
from .tokens import PieceEncoder, default_path


def decompose(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n tokens, longest first; `longest` is a power of two."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_length: int = 1024, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Rows (id, start, length, ids binary, doc_tokens, bucket, sequence_id, offset), one for each piece.

    ids: little-endian unsigned 32-bit token ids. bucket: log2 of the length.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    path = tokenizer or default_path()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches):
        coder = PieceEncoder.shared(path)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 4_000_000):
                doc, start, length, ids, total = [], [], [], [], []
                for i, coded in enumerate(coder.encode(texts[a:b]), a):
                    coded += end
                    n, at = len(coded) // 4, 0
                    for k in decompose(n, max_length):
                        doc.append(i)
                        start.append(at)
                        length.append(k)
                        ids.append(coded[4 * at : 4 * (at + k)])
                        total.append(n)
                        at += k
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                    ["id", "start", "length", "ids", "doc_tokens"],
                )

    pieces = rows.mapInArrow(tidy(run, "pieces"), f"id {id_type}, start long, length long, ids binary, doc_tokens long")
    return pieces.select(
        F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens",
        F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces so that each bucket of equal lengths has a folder of its own."""
    pieces.write.partitionBy("bucket").parquet(path)
