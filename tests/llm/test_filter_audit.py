"""The filter audit against SQL on the whole table and against sets on odd rows."""

from __future__ import annotations

import collections
import re
from itertools import permutations

import numpy as np
import pytest

from underwright.llm import filter_audit


def test_lists_against_sets():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 3000):
        lists = [np.sort(rng.choice(20_000, rng.integers(0, n + 1), replace=False)) for _ in range(5)]
        good, toxic = (np.sort(rng.choice(20_000, n, replace=False)) for _ in range(2))
        for subset, sizes in enumerate(filter_audit.union_sizes(lists, good, toxic)):
            union = set().union(*(lists[k].tolist() for k in range(5) if subset >> k & 1))
            assert sizes == (len(union), len(union & set(good.tolist())), len(union & set(toxic.tolist())))
            assert filter_audit.united(lists[0], lists[1]).tolist() == sorted({*lists[0].tolist(), *lists[1].tolist()})
    far = np.arange(0, 1 << 20, 3)
    assert filter_audit.places(far, np.array([0, 1, 3, 999_999, 1 << 20])).tolist() == [0, 1, 1, 333_333, len(far)]


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = collections.defaultdict(list)
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        parts[source or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = {}, collections.Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                earlier = sum(f in r[0] and bool(r[0] & set(order[: step - 1])) for r in rows)
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), earlier, sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(frame):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in frame.collect()}


@pytest.mark.parametrize("bits", [13, 1])
def test_odd_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(filter_audit, "SPAN_BITS", bits)
    words = " ".join(f"w{k}" for k in range(60))
    docs = [
        (1, words, "a"), (2, words, "a"), (2, words, "a"), (3, None, None), (4, "", ""), (5, "x " * 80, "b"), (None, words, "b"), (None, "", None), (6, words + " #", "a"),
        (7, words.upper(), "a"), (8, "É" * 300_000, "c"), (9, (words + " ") * 4000, "c"), (10, " \t\n\x0b ", "c"), (0, words + " ", "b"), (11, words + "|$", None), (12, words + "|$", "a"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (7, 1, 1), (6, None, 1), (99, 1, 1), (11, 1, 1), (12, 1, 0)]
    frame = spark.createDataFrame([(*d, "clash", 1, True) for d in docs], "doc_id long, text string, source string, part string, seq int, good boolean")
    marks = spark.createDataFrame([(*m, "clash") for m in labels], "doc_id long, quality int, toxic int, part string")
    assert found(filter_audit.audit(frame, marks)) == brute(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    assert found(filter_audit.audit(frame, marks.limit(0))) == brute(docs, [])


def test_postings_are_sorted_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SPAN_BITS", 4)
    docs = spark.range(500).selectExpr("id AS doc_id", "'same short text' AS text", "IF(id % 3 = 0, 'hot', CAST(id % 2 AS STRING)) AS source")
    labels = spark.range(0, 500, 7).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    lists = filter_audit.posting_lists(filter_audit.failures(docs, labels, "doc_id", "text", "source")).collect()
    assert sum(r["n"] for r in lists) == 500 and max(r["n"] for r in lists) <= 16
    assert all(list(r[c]) == sorted(set(r[c])) for r in lists for c in filter_audit.LISTS) and sum(len(r["E"]) for r in lists) == 499
