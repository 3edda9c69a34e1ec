"""All-pairs work inside groups of any size, without emitting pairs and without unbounded tasks.

A group of n members is cut into blocks of at most `block` on average; block pair (i, j), i <= j, is a unit
of its own, to which the members of blocks i and j are sent. Units are packed many to a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, unsent


def to_units(members: DataFrame, key: str, spread: str, block: int) -> DataFrame:
    """members with columns (key, unit, side, diagonal): each row once for every block pair it belongs to.

    Rows of groups of one member are left out. Counting the groups combines before the shuffle; group
    sizes are joined back, which AQE splits where a key is hot.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    cut = members.join(unsent(sizes), key).withColumn("_blocks", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
    cut = cut.withColumn("_own", F.pmod(F.xxhash64(spread, F.lit(11)), F.col("_blocks")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return cut.withColumns({"unit": F.xxhash64(key, low, high), "side": (F.col("_own") == high).cast("int"), "diagonal": F.col("_own") == F.col("_other")}).drop("_n", "_blocks", "_own", "_other")


def by_unit(units: DataFrame, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, parts: int, chunk: int = 20_000) -> DataFrame:
    """Calls run() with tables of whole units, sorted by unit; small units share a table of about `chunk` rows."""

    def process(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                table = pa.Table.from_batches(held).combine_chunks()
                unit = table.column("unit").to_numpy()
                cut = int(np.searchsorted(unit, unit[-1], "left"))  # sorted: the last unit may go on
                if cut:
                    yield from run(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows = sum(x.num_rows for x in held)
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks())

    return units.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(tidy(process), schema)


def unit_ranges(unit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    return list(zip(edge.tolist(), [*edge[1:].tolist(), len(unit)]))


class Forest:
    """Union-find over positions; roots are the smallest positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link positions pairwise, by repeated hooking of larger roots onto smaller ones."""
        up = self.up
        while len(a):
            a, b = self.root(a), self.root(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            x = self.up[y]
