"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the white space of every contract here.
SPACE = r"[\x20\x09-\x0D]+"

# A table is broadcast by hint only when its measured size is within this.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def whole(text: str) -> Column:
    """The text, a missing one read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key's text by ``modulus``; -1 where the key is missing."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(-1))


def hashed(*parts: Column | str, digits: int = 13) -> Column:
    """The first hex digits of the md5 of the parts joined by colons, as a long."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, digits), 16, 10).cast("long")


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """Names for helper columns that no column of ``taken`` has, in any case."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def small_join(left: DataFrame, right: DataFrame, on: Column, right_bytes: int, how: str) -> DataFrame:
    """Broadcast ``right`` if its measured size allows, else leave the join to skew splitting."""
    return left.join(F.broadcast(right) if right_bytes <= BROADCAST_BYTES else right, on, how)


# Bytes of one slice of rows that Python code handles at once; a longer row is a slice of its own.
SLICE_BYTES = 4 << 20


def arrow_batches(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes, so that what is made of them stays small.

    After the last slice the worker gives back what its buffers took: it may go on to other
    stages, or wait beside them.
    """
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
