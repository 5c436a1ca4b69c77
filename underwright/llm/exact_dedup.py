"""Exact deduplication with an extendible-hash index on shared files.

Keys are 64-bit hashes of the normalised text. The index starts with a directory of 2^depth slots (the top bits
of the key); while a slot holds more than ``bucket_keys`` different keys, the directory doubles and only overfull
slots are split. Copies of a text are one key, so a text that a third of all rows share can't overfill a
slot. The texts are gathered by (slot, key, bytes) after partial aggregation in the map tasks: different texts of one
key become a chain, told apart by their bytes. Owner tasks then take contiguous key ranges of the directory, number the
chains and write the bucket files; a chain carries the size of its group and the id that stays. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from underwright.llm.common import join_groups, stored, text_or_empty

#: A bucket holds as many more keys as it takes to keep the directory, which is broadcast, near this size.
MOST_BUCKETS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text_col: str) -> Column:
    """The text with A-Z in lower case, null as empty. Texts of ASCII alone take the faster ``lower``, which gives the same."""
    text = text_or_empty(text_col)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def slot_of(depth: int) -> Column:
    """Directory slot of column ``key``: its top bits."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def grow_directory(keys: DataFrame, n_keys: int, bucket_keys: int) -> tuple[DataFrame, int]:
    """Double the directory until no slot is overfull; returns (prefix, local_depth, n_keys) and the global depth."""
    depth = max(0, math.ceil(math.log2(max(1, n_keys) / bucket_keys)))
    buckets, pending = None, keys.select("key").distinct()
    while True:
        level = stored(pending.groupBy(slot_of(depth).alias("prefix")).agg(F.count("*").alias("n_keys")), "directory")
        full = (F.col("n_keys") > bucket_keys) & F.lit(depth < 64)
        done = level.where(~full).select("prefix", F.lit(depth).alias("local_depth"), "n_keys")
        buckets = done if buckets is None else buckets.unionByName(done)
        overfull = level.where(full).select("prefix")
        if overfull.isEmpty():
            return buckets, depth
        pending = pending.withColumn("prefix", slot_of(depth)).join(overfull, "prefix", "left_semi").select("key")
        depth += 1


def placed(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """``rows`` with the bucket that column ``key`` falls in: slot (its prefix) and local_depth.

    The directory has a row per bucket and is broadcast; what is in no bucket of a lower depth is in one of the highest.
    """
    *lower, highest = sorted(r["local_depth"] for r in directory.select("local_depth").distinct().collect()) or [0]
    slot, local_depth = slot_of(highest), F.lit(highest)
    for depth in reversed(lower):
        entries = directory.where(F.col("local_depth") == depth).select(F.col("prefix").alias(f"_at{depth}"))
        rows = rows.join(F.broadcast(entries), slot_of(depth) == F.col(f"_at{depth}"), "left")
        local_depth = F.when(F.col(f"_at{depth}").isNull(), local_depth).otherwise(F.lit(depth))
        slot = F.coalesce(F.col(f"_at{depth}"), slot)
    return rows.withColumns({"slot": slot, "local_depth": local_depth}).drop(*[f"_at{depth}" for depth in lower])


def build_index(docs: DataFrame, log: DataFrame, bucket_keys: int) -> DataFrame:
    """One row per different text, written by owner tasks in key order: slot, local_depth, key, chain, text_sha256, group_size, keep_id."""
    spark = docs.sparkSession
    n_rows = log.count()
    directory, _ = grow_directory(log, n_rows, max(bucket_keys, n_rows // MOST_BUCKETS))
    texts = docs.select(F.xxhash64("norm").alias("key"), "norm", "doc_id")
    chains = texts.groupBy("key", "norm").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    chains = placed(chains.select("key", F.sha2("norm", 256).alias("text_sha256"), "group_size", "keep_id"), directory)
    # keys are uniform, so equal spans of the key space, in which every bucket has its place, are equal shares of the keys
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owner = F.floor(F.col("slot") / F.pow(F.lit(2.0), "local_depth") * owners).cast("int")
    chain = F.row_number().over(Window.partitionBy("owner", "slot", "local_depth", "key").orderBy("text_sha256"))
    owned = chains.withColumn("owner", owner).repartition(owners, "owner").withColumn("chain", chain)
    return stored(owned.sortWithinPartitions(F.col("slot") / F.pow(F.lit(2.0), "local_depth"), "key", "chain"), "buckets")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 4096) -> DataFrame:
    """Decide for every row whether it stays: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z; of equal texts the row with the largest id
    stays. Null texts count as empty, and empty texts are equal to each other. Null ids sort below all others. If a row with
    the largest id is repeated, one of its rows stays. Other columns of ``docs``, whatever their names, are not read. An
    empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    log = stored(docs.select("doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "log")
    index = build_index(docs, log, bucket_keys)
    group = ["key", "text_sha256"]
    copies = stored(index.where("group_size > 1").select(*group, "group_size", "keep_id"), "copies")
    n_rows = log.count()
    decided = join_groups(log, copies, group, n_rows).withColumnRenamed("group_size", "n")
    # of rows with one id and one text, one may stay
    twin = F.struct("key", "text_sha256", "doc_id").alias("_twin")
    twins = log.select(twin, "row").groupBy("_twin").agg(F.min("row").alias("first"), F.count("*").alias("group_size")).where("group_size > 1")
    decided = join_groups(decided.select("*", twin), stored(twins, "twins"), ["_twin"], n_rows)
    alone = F.col("n").isNull()
    return decided.select(
        F.col("doc_id").alias(id_col),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.coalesce("first", "row")))).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of repeated ones.

    Of rows with one id and one text that differ in other columns, or in the case of A-Z, the one with the smallest hash of all its
    columns stays, so a recomputed task chooses the same. Nulls, empty texts and tables are as in ``exact_dedup``.
    """
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"))
    rows = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.sha2(normalised(text_col), 256).alias("_sha"))
    joined = rows.join(kept, rows["_id"].eqNullSafe(kept["_id"]) & (rows["_sha"] == kept["_sha"]), "left_semi")
    one = F.row_number().over(Window.partitionBy("_id", "_sha").orderBy(F.xxhash64("_doc")))
    return joined.withColumn("_n", one).where("_n = 1").select("_doc.*")
