"""Bounded runs of words give the library's ids, and memory doesn't follow the different words of a text."""

from __future__ import annotations

import random
import tracemalloc

import duckdb
import pytest

from underwright.llm import sentencepiece_codec as codec

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v():
    return codec.vocabulary(open(codec.MODEL, "rb").read())


def ids_per_text(v, texts, words=None):
    ids, count = (words or codec.Words(v)).encode(texts)
    ends = [0, *count.cumsum()]
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def test_small_runs_and_a_table_that_starts_anew(v, monkeypatch):
    monkeypatch.setattr(codec, "RUN_CHARS", 40)
    monkeypatch.setattr(codec, "AT_ONCE_WORDS", 7)
    monkeypatch.setattr(codec, "MOST_WORDS", 30)
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE length(text) < 300 LIMIT 12").fetchall()] + ["", " ", "a\n\nb", "x" * 90, "日本語 é 😀"]
    words = codec.Words(v)
    assert ids_per_text(v, texts, words) == v.processor.encode(texts) == ids_per_text(v, texts, words) and len(words.number) <= 37
    assert [codec.decode(v, ids) for ids in ids_per_text(v, texts)] == texts


def test_many_different_words(v):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß日本", k=rng.randint(3, 14))) for _ in range(250_000))
    tracemalloc.start()
    ids = ids_per_text(v, [text])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == v.processor.encode(text) and most < 300 << 20
    assert codec.decode(v, ids) == text
