"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: each phrase is the shortest text at that place that isn't a phrase yet. The hashes
of the phrase set are reduced to ``PERMUTATIONS`` minimum hashes; the share of equal minima of two texts estimates the
overlap of their dictionaries, which behaves like a compression distance.

The minima of a union are the smaller of both, and a parse doesn't look ahead. So a text and its edited text share
the parse of the part they have in common.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwright.llm.common import text_or_empty

#: Minimum hashes per fingerprint, of 16 bits each (standard error of a likeness 0.044 at most).
PERMUTATIONS = 128
_NUMBERS = np.random.default_rng(20240607)
MULTIPLY = _NUMBERS.integers(0, 2**31, (PERMUTATIONS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _NUMBERS.integers(0, 2**32, (PERMUTATIONS, 1), dtype=np.uint32)
#: The minima of no phrase at all.
NOTHING = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, dtype=np.uint32)


def new_phrases(text: str, known: set[str], phrase: str = "") -> tuple[list[str], str]:
    """Parse ``text`` after an unfinished ``phrase``; adds to ``known`` and returns the new phrases and the unfinished last one."""
    found = []
    for char in text:
        phrase += char
        if phrase not in known:
            known.add(phrase)
            found.append(phrase)
            phrase = ""
    return found, phrase


def minima(phrases: list[str]) -> np.ndarray:
    """Smallest value of each hash function over the phrases."""
    least = NOTHING
    hashes = np.fromiter(map(xxhash.xxh32_intdigest, phrases), np.uint32, len(phrases))
    for k in range(0, len(hashes), 2048):
        least = np.minimum(least, (MULTIPLY * hashes[k : k + 2048] + ADD).min(axis=1))
    return least


def packed(least: np.ndarray) -> str:
    """The fingerprint: 16 bits of every minimum in hex."""
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes().hex()


def fingerprint(text: str) -> str:
    """Of a whole text. A last phrase that isn't new still counts."""
    phrases, rest = new_phrases(text, set())
    return packed(minima(phrases + [rest] * bool(rest)))


def likeness(a: str, b: str) -> float:
    """Share of equal minima of two fingerprints."""
    return float(np.mean(np.frombuffer(bytes.fromhex(a), ">u2") == np.frombuffer(bytes.fromhex(b), ">u2")))


def fingerprint_both(text: str, head: str) -> tuple[str, str, str]:
    """Fingerprint of ``text``, the edited text (its last third replaced by as much of ``head``), and its fingerprint."""
    third = len(text) // 3
    cut = len(text) - third
    edited = text[:cut] + head[:third]
    known: set[str] = set()
    common, unfinished = new_phrases(text[:cut], known)
    shared = minima(common)
    prints = []
    for whole in (text, edited):
        more, rest = new_phrases(whole[cut:], known, unfinished)
        prints.append(packed(np.minimum(shared, minima(more + [rest] * bool(rest)))))
        known.difference_update(more)
    return prints[0], edited, prints[1]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Documents whose fingerprints are held at once.
FLUSH = 500


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block and place; within a block the next row is the next document. A marked row only serves as next."""
    last, pairs = None, []
    for batch in batches:
        for block, doc_id, text, ghost in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "text", "ghost")), strict=True):
            if last and last[0] == block:
                pairs.append((last[1], last[2], text))
            last = None if ghost else (block, doc_id, text)
            if len(pairs) >= FLUSH:
                yield _rows(pairs)
                pairs = []
        if pairs:
            yield _rows(pairs)
            pairs = []


def _rows(pairs: list[tuple[int, str, str]]) -> pa.RecordBatch:
    prints = [fingerprint_both(text, head) for _, text, head in pairs]
    out = []
    for k, (doc_id, text, head) in enumerate(pairs):
        own, edited, edited_print = prints[k]
        # as a rule the next document has the next pair, and so its fingerprint is there
        following = prints[k + 1][0] if k + 1 < len(pairs) and pairs[k + 1][1] is head else fingerprint(head)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc_id, len(text), digest, own, edited_print, likeness(own, edited_print), likeness(own, following)))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)


def block_heads(docs: DataFrame, blocks: int) -> list[int]:
    """Ids, largest first, at which the blocks of the descending order begin: the largest, then ids near the quantiles."""
    shares = F.array(*[F.lit(k / blocks) for k in range(1, max(blocks, 2))])
    found = docs.agg(F.max("doc_id").alias("most"), F.percentile_approx("doc_id", shares, 100 * blocks).alias("cuts")).first()
    return sorted({found["most"], *(found["cuts"] or [])} - {None}, reverse=True)


def block_of(heads: list[int]) -> Column:
    """Position of the last head that isn't below ``doc_id``, found in two steps of about the square root."""
    run = max(1, math.isqrt(len(heads)))
    runs = [heads[k : k + run] for k in range(0, len(heads), run)]
    not_below = lambda ids: F.size(F.filter(ids, lambda h: h >= F.col("doc_id")))
    first = not_below(F.array(*[F.lit(r[0]) for r in runs])) - 1
    inside = not_below(F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in runs]), first + 1)) - 1
    return first * run + inside


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The next document is the one with the next smaller id; after the smallest comes the largest. Rows with one id are
    ordered by text. Null ids sort below all others (as -2^63), null texts count as empty. The fingerprint of an empty
    text holds the values for no phrase; it is like another empty one (1.0). One row alone is its own next. Empty tables
    give empty results; other columns aren't read.

    Texts move once: blocks of the id order are dealt by the block and sorted there, and the few documents that
    begin a block also go to the block before as its last row. The driver holds only the ids that begin blocks.
    """
    least = F.lit(-(2**63)).cast("long")
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), least).alias("doc_id"), text_or_empty(text_col).alias("text"))
    heads = block_heads(docs, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) or [0]
    own = docs.withColumn("block", block_of(heads)).withColumn("is_head", F.col("doc_id").isin(heads))
    places = F.array(F.struct("block", F.lit(False).alias("ghost")))
    before = F.array(F.struct(F.pmod(F.col("block") - 1, F.lit(len(heads))).alias("block"), F.lit(True).alias("ghost")))
    placed = own.withColumn("at", F.explode(F.when(F.col("is_head"), F.concat(places, before)).otherwise(places)))
    ordered = placed.select("at.block", "at.ghost", "doc_id", "text").repartition("block").sortWithinPartitions("block", "ghost", F.desc("doc_id"), "text")
    out = ordered.mapInArrow(_fingerprints, SCHEMA)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))
