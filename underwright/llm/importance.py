"""Importance resampling towards a target distribution, with hashed n-gram features.

The texts of a batch go through NumPy as bytes: words are found by a byte table, and every run of one to three words is an
occurrence. Occurrences are interned in an open-addressed table: the xxhash64 of the bytes says where to look, the bytes say whether it is
the same n-gram. The table's slots hold the n-gram's bucket and count. A first pass adds counts up by bucket, for the documents and for the
target; from both come the gains of the buckets. A second pass interns again, and each occurrence fetches its gain by the number of its
slot. Scores get Gumbel noise from a hash of the id, so taking the highest is a draw without replacement.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from underwright.llm.common import stored, text_or_empty

#: Bytes that a word has after A-Z became a-z: digits, a-z, and all of other characters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[0x80:] = True
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
LONGEST = 3  # words
#: Bytes of text that are interned at once.
AT_ONCE = 1 << 18
#: Fixed values of xxhash64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Texts of so many bytes are hashed by the library, shorter ones in NumPy.
STRIPE = 32
#: Intervals of the highest scores within which rows are ranked, and copies of one row that are numbered at once.
INTERVALS, RUN = 256, 100_000
FEATURES = "doc_id long, n_words long, n_features long, weight long"


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def lanes_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a little-endian number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)).copy()


def xxhash64(data: np.ndarray, lanes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of the slices of ``data``."""
    h = P5 + length.astype(np.uint64)
    for k in range(STRIPE // 8 - 1):
        own = np.flatnonzero(length >= 8 * (k + 1))
        h[own] = turned(h[own] ^ turned(lanes[start[own] + 8 * k] * P2, 31) * P1, 27) * P1 + P4
    own = np.flatnonzero(length & 4)
    h[own] = turned(h[own] ^ (lanes[start[own] + (length[own] & ~7)] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
    for k in range(3):
        own = np.flatnonzero((length & 3) > k)
        h[own] = turned(h[own] ^ (lanes[start[own] + (length[own] & ~3) + k] & np.uint64(0xFF)) * P5, 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(length >= STRIPE):
        h[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + length[k]].tobytes())
    return h


def same_bytes(lanes: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the slices of equal ``length`` at a and at b are equal, eight bytes at a time."""
    same, left = np.ones(len(a), bool), np.arange(len(a))
    for k in range(0, int(length.max(initial=0)), 8):
        rest = np.minimum(length[left] - k, 8).astype(np.uint64)
        beyond = np.uint64(64) - rest * np.uint64(8)
        differs = ((lanes[a[left] + k] ^ lanes[b[left] + k]) << beyond) != 0
        same[left[differs]] = False
        left = left[~differs & (length[left] > k + 8)]
    return same


def intern(keys: np.ndarray, lanes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence that owns each slot or -1, slot of each occurrence) of an open-addressed table with linear probing.

    All occurrences probe together: of those that meet an empty slot one takes it. Those whose key and bytes are the owner's are
    done, the others go on. Equal occurrences stay side by side, so they end in one slot.
    """
    size = 1 << max(1, 2 * len(keys)).bit_length()
    owner, slot = np.full(size, -1, np.int32), np.empty(len(keys), np.int64)
    at, left = (keys & np.uint64(size - 1)).astype(np.int64), np.arange(len(keys))
    while len(left):
        free = owner[at] < 0
        owner[at[free]] = left[free]
        held = owner[at]
        same = held == left
        alike = np.flatnonzero(~same & (keys[held] == keys[left]) & (length[held] == length[left]))
        same[alike] = same_bytes(lanes, start[held[alike]], start[left[alike]], length[left[alike]])
        slot[left[same]] = at[same]
        left, at = left[~same], (at[~same] + 1) & (size - 1)
    return owner, slot


@cache
def shift_tables() -> np.ndarray:
    """What 0 to ``STRIPE`` further bytes make of a CRC-32, for each of its four bytes: a linear map, so the parts are combined by xor."""
    value, tables = np.arange(256), np.zeros((STRIPE + 1, 4, 256), np.uint32)
    for length in range(STRIPE + 1):
        zeros = bytes(length)
        for k in range(32):
            tables[length, k // 8] ^= np.where(value >> k % 8 & 1, zlib.crc32(zeros, 1 << k) ^ zlib.crc32(zeros), 0).astype(np.uint32)
    return tables.reshape(-1)


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts from those of their first and second parts; ``length`` is that of the second part in bytes."""
    tables, out = shift_tables(), second.copy()
    base = np.minimum(length, STRIPE).astype(np.uint32) << np.uint32(10)
    for part in range(4):
        out ^= tables[base + (part << 8) + (first >> np.uint32(8 * part) & np.uint32(255))]
    for k in np.flatnonzero(length > STRIPE):
        zeros = bytes(int(length[k]))
        out[k] = second[k] ^ zlib.crc32(zeros, int(first[k])) ^ zlib.crc32(zeros)
    return out


class Grams:
    """The n-grams of a run of text segments: owner and bucket of each slot, slot and segment of each occurrence."""

    def __init__(self, segments: list[tuple[int, bytes, int]], buckets: int):
        """``segments`` have a document's number, bytes, and the number of leading words that were there before."""
        raw = np.frombuffer(b"\0".join(s[1] for s in segments) + b"\0", np.uint8)
        low = LOWER[raw]
        inside = IN_WORD[low]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends = np.cumsum([len(s[1]) + 1 for s in segments])
        segment = np.searchsorted(ends, begin, side="right")
        known = np.array([s[2] for s in segments], np.int64)
        nth = np.arange(len(begin)) - np.searchsorted(segment, segment)  # place of the word in its segment
        new = nth >= known[segment]
        self.words = np.bincount(segment[new], minlength=len(segments))
        # the words with one space after each
        inside[end] = True
        low[end] = ord(" ")
        data = low[inside]
        length = end - begin
        start = np.cumsum(length + 1) - (length + 1)
        last = [np.flatnonzero(new & (nth >= n)) for n in range(LONGEST)]
        first = np.concatenate([k - n for n, k in enumerate(last)])
        final = np.concatenate(last)
        n_words = np.repeat(np.arange(LONGEST), [len(k) for k in last])
        at, size = start[first], start[final] + length[final] - start[first]
        lanes = lanes_of(data)
        self.owner, self.slot = intern(xxhash64(data, lanes, at, size), lanes, at, size)
        self.segment = segment[final]
        self.filled = np.flatnonzero(self.owner >= 0)
        self.bucket = np.zeros(len(self.owner), np.int32)
        self.bucket[self.filled] = self.checksums(self.owner[self.filled], first, final, n_words, data, start, length) % buckets

    def checksums(self, owners: np.ndarray, first: np.ndarray, final: np.ndarray, n_words: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC-32 of each owner's bytes. Those of single words are computed from their bytes, the others from their words'."""
        crc, out = np.zeros(len(start), np.uint32), np.zeros(len(owners), np.uint32)
        alone = np.flatnonzero(n_words[owners] == 0)
        spelled = data.tobytes()
        words = first[owners[alone]]
        own = np.zeros(len(self.owner), np.uint32)
        own[self.slot[owners[alone]]] = [zlib.crc32(spelled[a : a + n]) for a, n in zip(start[words].tolist(), length[words].tolist(), strict=True)]
        singles = n_words == 0
        crc[first[singles]] = own[self.slot[singles]]
        unseen = np.setdiff1d(np.arange(len(start)), first[singles], assume_unique=True)  # leading words of a segment
        crc[unseen] = [zlib.crc32(spelled[a : a + n]) for a, n in zip(start[unseen].tolist(), length[unseen].tolist(), strict=True)]
        spaced = joined_crc(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, length)
        out = crc[first[owners]]
        for n in range(1, LONGEST):
            more = np.flatnonzero(n_words[owners] >= n)
            word = first[owners[more]] + n
            out[more] = joined_crc(out[more], spaced[word], length[word] + 1)
        return out


def last_words(data: bytes, end: int, least: int, count: int) -> tuple[int, int]:
    """Where the last ``count`` words before ``end`` begin, not before ``least``, and how many there are."""
    found = 0
    while found < count:
        at = end
        while at > least and not IN_WORD[LOWER[data[at - 1]]]:
            at -= 1
        if at == least:
            break
        while at > least and IN_WORD[LOWER[data[at - 1]]]:
            at -= 1
        end, found = at, found + 1
    return end, found


def segment_runs(texts: list[bytes], at_once: int = AT_ONCE) -> Iterator[list[tuple[int, bytes, int]]]:
    """Segments of about ``at_once`` bytes in all. A longer text is cut between words, and what follows begins with the last words before the cut."""
    held, size = [], 0
    for number, data in enumerate(texts):
        start, done, known = 0, 0, 0
        while done < len(data):
            gap = GAP.search(data, done + at_once)
            end = gap.start() if gap else len(data)
            held.append((number, data[start:end], known))
            size += end - start
            if size >= at_once:
                yield held
                held, size = [], 0
            start, known = last_words(data, end, start, LONGEST - 1)
            done = end
    if held:
        yield held


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> dict[int, int]:
    """Features per bucket over whole texts. Each task adds up its own counts; the driver gets ``buckets`` rows at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for run in segment_runs(_bytes(batch)):
                grams = Grams(run, buckets)
                count = np.bincount(grams.slot, minlength=len(grams.owner))[grams.filled]
                total += np.bincount(grams.bucket[grams.filled], count, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    parts = texts.select(text_or_empty(text_col).alias("text")).mapInArrow(counted, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def bucket_gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln) of the target's smoothed share of each bucket over the corpus's."""
    s, t = sum(corpus.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((corpus.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, id_col: str, text_col: str, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of a text's features."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = np.zeros((3, batch.num_rows), np.int64)
            for run in segment_runs(_bytes(batch)):
                grams = Grams(run, len(gains))
                number = np.array([s[0] for s in run])
                np.add.at(words, number, grams.words)
                np.add.at(features, number, np.bincount(grams.segment, minlength=len(run)))
                np.add.at(weight, number, np.bincount(grams.segment, gains[grams.bucket][grams.slot], len(run)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, features, weight))], [c.split()[0] for c in FEATURES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(weighed, FEATURES)


def ranked(rows: DataFrame, eligible: str, percent: int) -> DataFrame:
    """Append rank 1, 2, 3 ... to the highest ``percent`` of the eligible rows by score, then smaller doc_id; null to the others.

    Equal rows are one row with a count ``m``. Quantiles of the highest scores cut them into intervals; sums per interval say how many rows
    are above, so only rows within an interval are sorted together, and only in those that the draw reaches.
    """
    groups = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("m")), "importance-scores")
    may = groups.where(eligible)
    n = may.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    drawn = percent * n // 100
    lowest = max(0.0, 1 - 1.2 * percent / 100)
    shares = [lowest + (1 - lowest) * k / INTERVALS for k in range(INTERVALS)]
    edges = may.select(F.percentile_approx("score", shares, 16 * INTERVALS)).first()[0] or [0]
    above = F.size(F.filter(F.lit(edges), lambda e: e > F.col("score")))
    placed = may.withColumn("_interval", F.when(F.col("score") < min(edges), len(edges)).otherwise(above))
    sums = placed.groupBy("_interval").agg(F.sum("m").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_interval").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per interval
    reached = sums.withColumn("_before", before).where(F.col("_before") < drawn).drop("_n")
    inside = Window.partitionBy("_interval").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), *[c for c in rows.columns if c not in ("score", "doc_id")])
    upto = F.col("_before") + F.sum("m").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = placed.join(F.broadcast(reached), "_interval").withColumn("_first", upto - F.col("m") + 1).where(F.col("_first") <= drawn).select(*rows.columns, "_first")
    keys = [F.struct(*rows.columns).alias("_row")]
    known = taken.select(*keys, "_first")
    out = groups.select(*keys, *rows.columns, "m").join(known, "_row", "left").drop("_row")
    copies = out.withColumn("_run", F.explode(F.expr(f"sequence(0L, (m - 1) div {RUN})"))).withColumn("_k", F.explode(F.expr(f"sequence(_run * {RUN}, least(m, (_run + 1) * {RUN}) - 1)")))
    rank = F.col("_first") + F.col("_k")
    return copies.select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; those with a rank are the draw.

    Words are runs of digits, letters and characters beyond ASCII, with A-Z in lower case; features are all runs of one to three words,
    repeats counted; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``. Whole texts count, null ones have no words. Without
    features the weight is 0, and texts under ``least_words`` words are never drawn. An empty target, or an empty table, leaves the
    smoothing alone. The noise hashes ``seed`` and the id, a null id as empty text; null ids come last in ties. Repeated rows have ranks of
    their own. Other columns aren't read. Memory is bounded by Arrow's batch size and the longest text; runs of 256 KB of text are interned at once.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = weigh(docs, id_col, text_col, gains).withColumn("score", F.col("weight") + noise)
    return ranked(rows, f"n_words >= {least_words}", percent).select("doc_id", "n_features", "weight", "score", "rank")
