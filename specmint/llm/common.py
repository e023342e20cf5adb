"""What the text operators share: column sets, lower-casing, vector sums over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words as the contracts define them: runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII values take the JVM's byte loop."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow for functions of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let no more than `rows` texts reach Python at once; a session that asks for fewer keeps its number.

    Spark holds a batch in direct memory and Python holds it again, beside the heap that executors
    are sized by: ten thousand texts are too many there where texts are long.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def slices(batch: pa.RecordBatch, text: int = 1, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have about `most` bytes together; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(first, k - first)
            first, total = k, 0
        total += int(size)
    if first < batch.num_rows:
        yield batch.slice(first)


def held_out(doc_id: Column) -> Column:
    """True for the rows no label may be learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sum_vectors(parts: DataFrame, n_parts: int, fan_in: int = 16) -> DataFrame:
    """Add float64 vectors (key string, part int, vec binary) over their parts by a tree.

    `n_parts` says how many parts to expect and so how deep the tree is: no group holds over
    `fan_in` rows then. The last level takes all that is left of a key, so there is one row a key
    even where the parts were more.
    """
    import numpy as np

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["vec"].iloc[0]) // 8)
        for v in pdf["vec"]:
            total += np.frombuffer(v, dtype="<f8")
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "part": [int(pdf["part"].iloc[0]) // fan_in], "vec": [total.tobytes()]})

    left = n_parts
    while left > fan_in:
        parts = parts.groupBy("key", F.floor(F.col("part") / fan_in).alias("g")).applyInPandas(add, "key string, part int, vec binary")
        left = -(-left // fan_in)
    return parts.groupBy("key").applyInPandas(add, "key string, part int, vec binary").select("key", "vec")
