"""What the operators on repeated passages share: which of a block's keys occur more than once in the corpus.

A block sends each distinct key as one row, with its count, so a key that is in every document is one row a block.
Rows are dealt by key over as many partitions as the input needs; only repeated keys go back, gathered by block. Work
and rows follow the input's size, whatever the number of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most partitions of an exchange; beyond, partitions hold several blocks.
PARTITIONS = 1 << 16


def distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs, the place of each input in them, and their counts."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], place, np.diff(np.append(np.flatnonzero(new), len(a)))


#: A row's place: the block in the upper bits, then the number of the key among the block's sorted distinct ones.
PLACE_BITS = 26
PLACED, WIDE = "at long, key long", "at long, key long, key2 int"


def placed_rows(block: int, key: np.ndarray, key2: np.ndarray | None = None) -> pa.Table:
    """at, key (64 bits) and maybe key2 (32 bits more): a block's sorted distinct keys."""
    if len(key) >> PLACE_BITS:
        raise ValueError(f"a block has over 2^{PLACE_BITS} distinct keys: one of its texts is too long")
    at = (block << PLACE_BITS) + np.arange(len(key), dtype=np.int64)
    cols = {"at": pa.array(at), "key": pa.array(key.view(np.int64))}
    return pa.table(cols if key2 is None else cols | {"key2": pa.array(key2.view(np.int32))})


def shared(rows: DataFrame, parts: int) -> DataFrame:
    """Of rows (at, key, maybe key2): block and found, the numbers of its keys that other blocks have, too."""
    key = [c for c in ("key", "key2") if c in rows.columns]
    blocks = F.count(F.lit(1)).over(Window.partitionBy(*key))
    again = rows.repartition(min(parts, PARTITIONS), *key).withColumn("blocks", blocks).where("blocks > 1")
    number = F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
    return again.groupBy(F.shiftright("at", PLACE_BITS).alias("block")).agg(F.collect_list(number).alias("found"))


def flags(counts: np.ndarray, back: pa.Table) -> np.ndarray:
    """Whether each of a block's sorted distinct keys occurs more than once, here or elsewhere."""
    out = counts > 1
    for c in back["found"].chunks if len(back) else ():
        out[c.flatten().to_numpy(zero_copy_only=False)] = True
    return out


def key_rows(block: int, counts: np.ndarray, key: np.ndarray) -> pa.Table:
    """block, n, key: a block's distinct keys with their counts."""
    return pa.table({"block": pa.array(np.full(len(counts), block), pa.int64()), "n": pa.array(counts, pa.int64()), "key": pa.array(key.view(np.int64))})


KEYS = "block long, n long, key long"


def repeated(rows: DataFrame, parts: int, *more: str) -> DataFrame:
    """Of rows (block, n, key, maybe key2, *more): those whose key occurs more than once in all, with that number as total."""
    key = [c for c in ("key", "key2") if c in rows.columns]
    total = F.sum("n").over(Window.partitionBy(*key))
    return rows.repartition(min(parts, PARTITIONS), *key).withColumn("total", total).where("total > 1").select("block", *key, "total", *more)


def by_block(rows: DataFrame, *columns: str) -> DataFrame:
    """block, keys (array of structs of the columns): what goes back to a block."""
    return rows.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("keys"))


def field(back: pa.Table, name: str) -> np.ndarray:
    """A block's values of a field of `keys`."""
    parts = [c.flatten().field(name).to_numpy(zero_copy_only=False) for c in back["keys"].chunks if len(c)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
