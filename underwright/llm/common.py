"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from underwright.session import materialise

#: Rows that may be broadcast; beyond it the same join is shuffled with a salt.
BROADCAST_ROWS = 10_000
#: Parts into which the rows of every key are dealt in a salted join.
SALTS = 32
#: A group is hot if it has more than one in so many rows.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to and read from the shared folder: cuts the lineage and fixes row numbers."""
    return materialise(df, f"llm-{label}")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def left_join_small(df: DataFrame, small: DataFrame, small_rows: int, on: list[str], how: str = "left") -> DataFrame:
    """Join with a table of one row per key that is small as a rule.

    Up to ``BROADCAST_ROWS`` rows it is broadcast. Beyond that its rows are copied ``SALTS`` times and the
    rows of ``df`` are dealt over the copies, so a key with a third of all rows meets its row in many tasks.
    """
    if small_rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*on, "_salt"], how).drop("_salt")


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], n_rows: int) -> DataFrame:
    """Left join with one row per key that has ``group_size``, the number of its rows.

    Of groups with more than one in ``HOT_SHARE`` rows there are ``HOT_SHARE`` at most: those are broadcast. What is left has no
    large key and is joined by key.
    """
    hot = F.broadcast(groups.where(F.col("group_size") * HOT_SHARE > F.lit(n_rows)))
    keys = hot.select(*on)
    warm = rows.join(keys, on, "left_anti").join(groups.join(keys, on, "left_anti"), on, "left")
    return rows.join(hot, on).unionByName(warm)


def pieces(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    lengths = pc.binary_length(batch.column(text)).to_pylist()
    start = total = 0
    for k, n in enumerate(lengths):
        if total and total + (n or 0) > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n or 0
    if start < len(lengths):
        yield batch.slice(start)
