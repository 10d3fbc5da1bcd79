"""Vector columns as matrices inside tasks, bounded samples, and blocks that meet chunks of queries.

Rows of a cell go to pieces of bounded size, dealt by a hash, so a cell that holds a third of all rows is many pieces. A
piece is held by one task while the chunks of queries that visit it stream past.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import unpack
from .ranges import partitions


def finite(vector: Column) -> Column:
    """The components as doubles, or null where the vector or a component is null or a component is not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    return F.when(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), x)


def of_common_width(rows: DataFrame, vector: str = "vector") -> tuple[DataFrame, int]:
    """The rows whose vector has the commonest length (of equally common ones the smallest), and it; 0 if there are none."""
    most = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = most["n"] if most else 0
    return rows.where(F.size(vector) == width), width


def sample(rows: DataFrame, size: int, total: int, key: str = "vector") -> DataFrame:
    """At most `size` of `total` rows, by the smallest hashes of the key; about as many travel as are taken."""
    name, whole = F.xxhash64(F.lit(5), key), 1 << 40
    share = min(whole, int(whole * 1.5 * size / max(total, 1)) + whole * 64 // max(total, 1))
    return rows.where(F.pmod(name, F.lit(whole)) < share).orderBy(name, key).limit(size)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equally long lists as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def in_pieces(rows: DataFrame, cell: str, key: str, limit: int) -> tuple[DataFrame, dict[int, range]]:
    """Add `piece`, and the pieces of each cell: as many as hold `limit` rows each, dealt by a hash of the key.

    The number of cells must be bounded; each is one row on the driver.
    """
    counts = {r[0]: -(-r[1] // limit) for r in rows.groupBy(cell).count().orderBy(cell).collect()}
    pieces, first = {}, 0
    for name, n in counts.items():
        pieces[name] = range(first, first + n)
        first += n
    table = rows.sparkSession.createDataFrame([(c, p.start, len(p)) for c, p in pieces.items()], f"`{cell}` int, __first int, __parts int")
    dealt = rows.join(F.broadcast(table), cell)
    piece = (F.col("__first") + F.pmod(F.xxhash64(F.lit(6), key), F.col("__parts"))).cast("int")
    return dealt.withColumn("piece", piece).drop("__first", "__parts"), pieces


def meet(held: DataFrame, passing: DataFrame, opened: Callable, answer: Callable, schema: str) -> DataFrame:
    """Chunks of queries meet the pieces that they visit: answer(opened(*arrays of the piece), *arrays of the chunk).

    Both sides are (piece int, blob binary), blobs are made by `pack`. A piece is read once and held while its chunks
    pass, one after the other.
    """
    n = max(1, partitions(held.sparkSession))
    rows = held.select("piece", F.lit(0).alias("kind"), "blob").unionAll(passing.select("piece", F.lit(1).alias("kind"), "blob"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for b in batches:
            for i in range(b.num_rows):
                piece, kind, blob = (b.column(c)[i].as_py() for c in range(3))
                if not kind:
                    at, mine = piece, opened(*unpack(blob))
                elif piece == at:
                    yield answer(mine, *unpack(blob))

    return rows.repartition(n, "piece").sortWithinPartitions("piece", "kind").mapInArrow(run, schema)
