"""Sharding with a permutation-filled lookup table.

Every shard has an own permutation of the slots of a table of prime size (an offset and a step from hashes of its
name). The shards take turns, each claims the next free slot of its permutation, until the table is full: slot counts
differ by one at most, and adding or removing a shard moves few slots. The table has ``slots`` rows whatever the
data, so it is broadcast; a row's shard is one lookup of its key's hash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwright.session import scratch_path

#: Size limit of the broadcast table.
MOST_SLOTS = 1 << 20
#: Writing tasks for each partition of the input, and parts of shards that a task writes.
TASKS_PER_SPLIT, PARTS_PER_TASK = 4, 8


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_slots(shards: list[str], slots: int) -> list[int]:
    """Position of the shard that owns each slot."""
    if not is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime below {MOST_SLOTS}, not {slots}")
    if not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("shards must be different names, one at least and one per slot at most")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8]) % slots for d in digests]
    step = [int.from_bytes(d[8:16]) % (slots - 1) + 1 for d in digests]
    owner, filled = [-1] * slots, 0
    while True:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            owner[at[shard]] = shard
            filled += 1
            if filled == slots:
                return owner


def slot_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    rows = [(slot, shards[owner]) for slot, owner in enumerate(fill_slots(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard string")


def place(df: DataFrame, key_cols: list[str], shards: list[str], slots: int = 65_537) -> DataFrame:
    """``row`` (all columns of ``df``, whatever their names), ``slot`` and ``shard`` of every row; no shuffle.

    Equal keys share a shard; a null in a key is a value like others. Repeated rows are all placed, an empty table stays
    empty. Texts aren't read unless they are keys.
    """
    placed = df.select(F.struct("*").alias("row"), F.pmod(F.xxhash64(*key_cols), F.lit(slots)).cast("int").alias("slot"))
    return placed.join(F.broadcast(slot_table(df.sparkSession, shards, slots)), "slot")


def write_shards(df: DataFrame, key_cols: list[str], shards: list[str], path: str, slots: int = 65_537) -> DataFrame:
    """Write the placed rows as one folder per shard and return them as read back.

    The rows of a shard are dealt by a hash of the whole row into parts, whose number grows with the number of partitions that the
    input is read in: one shard isn't one task, and a key that many rows share isn't either. Nulls and repeated rows are placed as in
    ``place``; an empty table gives an empty folder and an empty result.
    """
    spark = df.sparkSession
    placed = place(df, key_cols, shards, slots)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_SPLIT * df.rdd.getNumPartitions())
    parts = -(-PARTS_PER_TASK * tasks // len(shards))
    dealt = placed.withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    dealt.repartition(tasks, "shard", "_part").sortWithinPartitions("shard").drop("_part").write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 64) -> DataFrame:
    """Write every document to its shard and return doc_id, n_chars, slot, shard from the files."""
    path = scratch_path(docs.sparkSession, "llm-shards")
    written = write_shards(docs, ["doc_id"], [f"shard-{k:03d}" for k in range(n_shards)], path)
    return written.select("row.doc_id", F.char_length(F.coalesce("row.text", F.lit(""))).cast("long").alias("n_chars"), "slot", "shard")
