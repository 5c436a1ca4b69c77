"""Importance resampling against a brute-force version in plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from underwright.llm import importance, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STRANGE = ["", " ", "É日本 x 😀y", "A" * 100 + " bb " + "C" * 40, "a-b_c A B\x00C", "one", "1 2\t3\n4", "ab" * 20 + " " + "ab" * 20]


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)], len(words)


def brute(docs, target, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    s, t = (collections.Counter(zlib.crc32(f.encode()) % 10_000 for text in texts for f in features(text)[0]) for texts in ([d[1] for d in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        own, words = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, row in enumerate(may[: percent * len(may) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_whole_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    target = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    got = found(queries.all_queries()["op13_importance_resample"](spark, SF))
    assert got == brute(docs, target) and sum(r[4] is not None for r in got) > 30


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_odd_rows(spark, percent):
    long = " ".join(f"word{k % 977} É{k % 13}" for k in range(40_000))
    texts = [long, None, *STRANGE, "short text", *[" ".join(f"w{k * j % 31}" for k in range(30)) for j in range(40)]]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, long), (None, None), (7, texts[7]), *[(60, texts[20])] * 9]
    frame = spark.createDataFrame([(*d, 1, "clash", 2) for d in docs], "doc_id long, text string, rank int, score string, m int")
    target = spark.createDataFrame([("w1 w2 w3", 1), (None, 2), ("", 3), (long, 4)], "text string, bucket int")
    assert found(importance.resample(frame, target, percent=percent)) == brute(docs, ["w1 w2 w3", None, "", long], percent)
    assert found(importance.resample(frame, target.limit(0), percent=percent)) == brute(docs, [], percent)
    assert importance.resample(frame.limit(0), target).count() == 0


@pytest.mark.parametrize("at_once", [1, 50, 1 << 18])
def test_cut_texts_keep_their_features(at_once):
    texts = [*STRANGE, " ".join(f"word{k % 37}" for k in range(300)), "x" * 400 + " y " + " " * 300 + "z"]
    count, words, size = collections.Counter(), collections.Counter(), collections.Counter()
    for run in importance.segment_runs([t.encode() for t in texts], at_once):
        grams = importance.Grams(run, 10_000)
        for occurrence in grams.slot.tolist():
            count[int(grams.bucket[occurrence])] += 1
        for segment, n in zip(run, grams.words, strict=True):
            words[segment[0]] += int(n)
        for segment in grams.segment.tolist():
            size[run[segment][0]] += 1
    assert count == collections.Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)[0])
    assert all((size[k], words[k]) == (len(features(t)[0]), features(t)[1]) for k, t in enumerate(texts))


def test_keys_are_xxhash64():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start, length = rng.integers(0, 4900, 2000), rng.integers(0, 90, 2000)
    keys = importance.xxhash64(data, importance.lanes_of(data), start, length)
    assert keys.tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes()) for a, n in zip(start, length, strict=True)]


@pytest.mark.parametrize("keys", [0, 1, 3, 2**64 - 1])
def test_bytes_tell_equal_keys_apart(keys):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    start, length = rng.integers(0, 560, 400), rng.integers(1, 40, 400)
    weak = length % 3 if keys == 3 else np.full(400, keys, np.uint64)  # equal texts have equal keys, others often too
    owner, slot = importance.intern(weak.astype(np.uint64), importance.lanes_of(data), start, length)
    texts = [data[a : a + n].tobytes() for a, n in zip(start, length, strict=True)]
    assert all(texts[owner[s]] == t for s, t in zip(slot, texts, strict=True)) and (owner >= 0).sum() == len(set(texts)) == len(set(slot.tolist()))


def test_joined_checksums():
    parts = [(b"abc", b" d"), (b"", b"x"), (b"x", b""), (b"abc" * 30, b"long" * 40), (bytes(5), bytes(32)), (b"q", b"r" * 33)]
    got = importance.joined_crc(*(np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1)), np.array([len(p[1]) for p in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]
