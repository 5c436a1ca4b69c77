"""Near-duplicate detection with BagMinHash signatures.

A document is a bag of shingles of five words, weighed by their counts. The weight axis of every shingle is cut into blocks at
powers of two, and each block runs a Poisson process whose points have a time, a place on the axis and a signature
component, all drawn from hashes of the shingle. A point counts for a document if its place is below the shingle's weight
there; the earliest point of each component is its signature. Two documents agree in a component with the
probability of their weighted Jaccard similarity, without bias. Points are generated in order of time and a shingle stops
once its next point is later than all minima of its document.

Bands of the signature give candidates; the overlap of the bags is then counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from underwright.llm.common import join_groups, pieces, stored, text_or_empty
from underwright.llm.components import components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: A pair with similarity 0.8 shares no band with probability (1 - 0.8^5)^28 < 1.5e-5.
BANDS, ROWS = 28, 5
COMPONENTS = BANDS * ROWS
#: Bytes of text that are hashed at once, points that are drawn in one round, and those of them that are held at once.
AT_ONCE, MOST_POINTS, HELD_POINTS = 1 << 20, 2_000_000, 1 << 18
#: How many of the central documents of its buckets a document is first compared with.
TRIED = 4

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
SIGNATURES = "uid long, weight long, bands array<long>, parities array<long>"
#: Classes of shingles whose counts' parities are kept as bits.
CLASSES = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a UTF-8 buffer, and the number of the text that each is in.

    A word is a run of bytes other than ASCII white space; its hash is a polynomial of its bytes, from differences of one running sum.
    """
    data = data[: offsets[-1]]
    inside = ~WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(np.concatenate((inside[:-1] & (~inside[1:] | first[1:]), inside[-1:]))) + 1
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), dtype=np.uint64)))
    inverse = powers(pow(BASE, -1, 2**64), len(data) + 1)
    hashes = mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, sorted by text and hash with repeats, and the number of each's text.

    A text with fewer than five words has one shingle of what it has, one without words none.
    """
    words, text = word_hashes(data, offsets)
    n_words = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(n_words) - n_words
    n_shingles = np.where(n_words > 0, np.maximum(n_words - SHINGLE_WORDS + 1, 1), 0)
    owner = np.repeat(np.arange(len(n_words)), n_shingles)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + first[owner]
    end = (first + n_words)[owner]
    hashes = np.zeros(len(owner), np.uint64)
    padded = np.concatenate((words, np.zeros(SHINGLE_WORDS, np.uint64)))
    for k in range(SHINGLE_WORDS):
        hashes = mix(hashes * np.uint64(BASE) + np.where(at + k < end, padded[at + k], np.uint64(k + 1)))
    order = np.lexsort((hashes, owner))
    return hashes[order], owner[order]


def signatures(hashes: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """BagMinHash signature of each text (the point that won each component) from sorted shingles; without shingles all zero."""
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(hashes)))
    hashes, owner = hashes[at], owner[at]
    # block 0 is (0, 1], block j is (2^(j-1), 2^j]; the last that a weight reaches may count in part
    n_blocks = np.ceil(np.log2(weight)).astype(np.int64) + 1
    stream = np.repeat(np.arange(len(hashes)), n_blocks)
    block = np.arange(len(stream)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    width = np.maximum(low, 1).astype(np.float64)
    seed, owner, above = mix(hashes[stream] + block.astype(np.uint64) * np.uint64(BASE)), owner[stream], weight[stream] - low
    times = np.full((n_texts, COMPONENTS), np.inf)
    winners = np.zeros((n_texts, COMPONENTS), np.uint64)
    now = np.zeros(len(seed))
    count, drawn = 1, 0
    while len(seed):
        steps = np.arange(drawn + 1, drawn + count + 1, dtype=np.uint64)
        best = times.reshape(-1)
        rows = max(1, HELD_POINTS // count)
        for start in range(0, len(seed), rows):
            here = slice(start, start + rows)
            point = mix(seed[here, None] + steps * np.uint64(0xD1342543DE82EF95))
            wait = -np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            time = now[here, None] + np.cumsum(wait, axis=1) / width[here, None]
            other = mix(point ^ np.uint64(0xA0761D6478BD642F))
            place = (other >> np.uint64(32)).astype(np.float64) * 2.0**-32 * width[here, None]
            counts = place < above[here, None]
            component = (other & np.uint64(0xFFFFFFFF)) % np.uint64(COMPONENTS)
            cell = (owner[here, None] * COMPONENTS + component.astype(np.int64))[counts]
            t, p = time[counts], point[counts]
            np.minimum.at(best, cell, t)
            won = best[cell] == t
            winners.reshape(-1)[cell[won]] = p[won]
            now[here] = time[:, -1]
        active = now <= times.max(axis=1)[owner]
        seed, owner, above, width, now = seed[active], owner[active], above[active], width[active], now[active]
        drawn += count
        count = min(2 * count, 64, max(1, MOST_POINTS // max(1, len(seed))))
    return winners


def bands(signature: np.ndarray) -> np.ndarray:
    out = np.zeros((len(signature), BANDS), np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(BASE) + signature[:, k::ROWS])
    return out


def parities(hashes: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """One bit for each class of shingles and text: whether their count is odd, as 64-bit numbers.

    Where the bits of two texts differ, their bags do: the bags differ by as many shingles at least.
    """
    kind = (hashes % np.uint64(CLASSES)).astype(np.int64)
    odd = np.bincount(owner * CLASSES + kind, minlength=n_texts * CLASSES).reshape(n_texts, CLASSES) & 1
    return np.packbits(odd.astype(bool), axis=1).view(np.int64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column."""
    column = column.cast(pa.large_string())
    column = pa.concat_arrays([column]) if not column.offset else pa.array(column.to_pylist(), pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[: ends[-1]], ends


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", AT_ONCE):
            hashes, owner = shingles(*buffers(part.column("text")))
            found = bands(signatures(hashes, owner, len(part))).view(np.int64)
            weight = np.bincount(owner, minlength=len(part))
            lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1)) for x in (found, parities(hashes, owner, len(part)))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "key", "uid")), pa.array(weight, pa.int64()), *lists], ["doc_id", "key", "uid", "weight", "bands", "parities"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", AT_ONCE):
            hashes, owner = shingles(*buffers(part.column("text")))
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(part))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("uid"), pa.ListArray.from_arrays(ends, hashes.view(np.int64))], ["uid", "bag"])


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags, given as unsigned-sorted arrays with repeats; two empty bags are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    # the k-th repeat of a value in one bag meets the k-th in the other: count values by the smaller of both counts
    values, counts = np.unique(both, return_counts=True)
    in_a = np.searchsorted(a, values, "right") - np.searchsorted(a, values, "left")
    common = int(np.minimum(in_a, counts - in_a).sum())
    return common / max(1, len(a) + len(b) - common)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = []
        for side in ("bag_a", "bag_b"):
            column = batch.column(side)
            values, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
            bags.append((values, ends))
        (x, ex), (y, ey) = bags
        found = [overlap(x[ex[k] : ex[k + 1]], y[ey[k] : ey[k + 1]]) for k in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def verify(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bags overlap by ``SIMILARITY`` or more. A similarity can't be above the ratio of the weights."""
    joined = pairs.join(bags.select(F.col("uid").alias("a"), F.col("bag").alias("bag_a")), "a").join(bags.select(F.col("uid").alias("b"), F.col("bag").alias("bag_b")), "b")
    possible = F.least(F.size("bag_a"), F.size("bag_b")) >= SIMILARITY * F.greatest(F.size("bag_a"), F.size("bag_b"))
    return joined.where(possible).select("a", "b", "bag_a", "bag_b").mapInArrow(_verified, "a long, b long, similarity double").where(F.col("similarity") >= SIMILARITY)


def text_key(text_col: str) -> Column:
    """128 bits that copies of a text share, whatever their case."""
    return F.substring(F.sha2(F.lower(text_or_empty(text_col)), 256), 1, 32)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (smallest id of its class), class_size, kept (one row per class).

    Classes are the connected parts of the links: pairs of documents whose bags of five-word shingles (words are what white
    space separates, in lower case) have a weighted Jaccard similarity of 0.8 or more. Null texts count as empty; texts
    without words form one class. Texts with fewer than five words have one shingle. Null ids sort after all others, repeated rows
    are in one class and one of them is kept. Empty tables give empty results; other columns aren't read.

    Copies are one vertex. Members of a bucket are first compared with its two central documents, found by partial
    aggregation; each tries those with which it shares the most bands. The links so found join most of every group. Then
    every pair of one bucket that isn't joined yet is compared, so no link between classes is lost, but the pairs
    inside a class are never listed. Pairs whose parity bits show that they differ too much don't leave that join.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_or_empty(text_col)).alias("text"), text_key(text_col).alias("key"))
    signed = keyed.withColumn("uid", F.monotonically_increasing_id()).select("doc_id", "key", "uid", "text")
    rows = stored(signed.mapInArrow(_signed, "doc_id long, key string, " + SIGNATURES), "signed")
    vertices = stored(rows.groupBy("key").agg(F.min("uid").alias("uid"), F.min_by("doc_id", "uid").alias("doc"), F.min_by(F.struct("weight", "bands", "parities"), "uid").alias("s"), F.count("*").alias("group_size")).select("uid", "key", "doc", "group_size", "s.*"), "vertices")

    cells = vertices.select("uid", F.posexplode("bands").alias("band", "bucket"))
    shared = cells.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(cells.join(shared, ["band", "bucket"]), "members")
    # a central document is one that meets many others; each bucket has its most central one, and one by hash
    central = members.groupBy("uid").agg(F.sum("n").alias("met"))
    chosen = members.join(central, "uid").groupBy("band", "bucket").agg(F.max(F.struct("met", "uid"))["uid"].alias("p"), F.min(F.struct(F.xxhash64("uid", "band"), "uid"))["uid"].alias("q"))
    members = members.join(chosen.select("band", "bucket", F.array_distinct(F.array("p", "q")).alias("pivots")), ["band", "bucket"])
    near = members.select("uid", F.explode("pivots").alias("pivot")).where("uid <> pivot").groupBy("uid", "pivot").agg(F.count("*").alias("shared"))
    tried = near.withColumn("n", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("shared"), "pivot"))).where(F.col("n") <= TRIED)
    first = stored(tried.select(F.least("uid", "pivot").alias("a"), F.greatest("uid", "pivot").alias("b")).distinct(), "first-pairs")

    # all copies of a text have its key, but it is needed once
    wanted = members.select("uid").distinct().join(vertices.select("uid", F.struct("key", "doc").alias("one")), "uid")
    texts = keyed.select(F.struct("key", F.col("doc_id").alias("doc")).alias("one"), "text").join(wanted, "one")
    bags = stored(texts.groupBy("uid").agg(F.first("text").alias("text")).mapInArrow(_bags, "uid long, bag array<long>"), "bags")
    links = stored(verify(first, bags).select("a", "b"), "first-links")

    roots = components(links)
    joined = members.select("uid", "band", "bucket").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    joined = stored(joined, "joined")
    parts = joined.groupBy("band", "bucket", "root").agg(F.count("*").alias("n"))
    # the largest part of a bucket is compared with, all others ask
    main = parts.groupBy("band", "bucket").agg(F.count("*").alias("parts"), F.max(F.struct("n", "root"))["root"].alias("main")).where("parts > 1")
    asking = joined.join(main, ["band", "bucket"]).join(vertices.select("uid", "weight", "parities", "bands"), "uid")
    side_of = lambda side, *more: asking.select(*(F.col(c).alias(f"{c}_{side}") for c in ("band", "bucket", "uid", "root", "weight", "parities", "bands")), *more)
    # with N shingles in both bags and D of them in one only, the similarity is (N - D) / (N + D): 0.8 or more needs 9 D <= N
    differ = sum((F.bit_count(F.col("parities_x")[k].bitwiseXOR(F.col("parities_y")[k])) for k in range(CLASSES // 64)), F.lit(0))
    limit = (1 - SIMILARITY) / (1 + SIMILARITY) * (F.col("weight_x") + F.col("weight_y")) + 1e-6
    left, right = side_of("x", "main").where("root_x <> main"), side_of("y")
    wanted_pair = F.expr("root_x <> root_y AND (root_y = main OR uid_x < uid_y)") & (F.greatest(differ, F.abs(F.col("weight_x") - F.col("weight_y"))) <= limit)
    # a pair that shares several buckets leaves the join in the first of them only
    for k in range(BANDS):
        wanted_pair &= (F.col("band_x") <= k) | (F.col("bands_x")[k] != F.col("bands_y")[k])
    bucket = (F.col("band_x") == F.col("band_y")) & (F.col("bucket_x") == F.col("bucket_y"))
    rest = left.join(right, bucket & wanted_pair).select(F.least("uid_x", "uid_y").alias("a"), F.greatest("uid_x", "uid_y").alias("b")).distinct()
    rest = rest.join(first, ["a", "b"], "left_anti")
    more = stored(verify(rest, bags).select("a", "b"), "more-links")

    classes = components(links.unionByName(more)).withColumnRenamed("node", "uid")
    # a text or a class may have a third of all rows: large ones are broadcast, the others joined by key
    n_rows = rows.count()
    roots = stored(vertices.join(classes, "uid", "left").select("key", "group_size", F.coalesce("root", "uid").alias("root")), "roots")
    named = stored(join_groups(rows.select("doc_id", "key", F.col("uid").alias("row")), roots, ["key"], n_rows).drop("group_size"), "named")
    by_class = named.groupBy("root").agg(F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m"))
    by_class = stored(by_class.select("root", "group_size", F.col("m.doc_id").alias("class_id"), F.col("m.row").alias("keep_row")), "classes")
    out = join_groups(named, by_class, ["root"], n_rows)
    return out.select(F.col("doc_id").alias(id_col), "class_id", F.col("group_size").alias("class_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("key").alias("text_key"))


def keep_one_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, one of each class, with all their columns.

    Of rows with one id and copies of one text, the one with the smallest hash of all its columns is kept, so a recomputed task
    chooses the same. Nulls, empty texts and tables are as in ``near_duplicates``.
    """
    kept = near_duplicates(docs, id_col, text_col).where("kept").select(F.struct(id_col, "text_key").alias("_one")).distinct()
    rows = docs.select(F.struct("*").alias("_doc"), F.struct(F.col(id_col).cast("long").alias(id_col), text_key(text_col).alias("text_key")).alias("_one"))
    one = F.row_number().over(Window.partitionBy("_one").orderBy(F.xxhash64("_doc")))
    return rows.join(kept, "_one", "left_semi").withColumn("_n", one).where("_n = 1").select("_doc.*")
