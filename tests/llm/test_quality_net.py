"""The quality network: gradient, pooling against brute force, held-out accuracy, odd rows."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest

from underwright.llm import quality_net, queries
from underwright.llm.quality_net import CHUNK, HOP, NONE, WIDTH, Network

SF = "/root/testdata/sf0.01"


def plain_score(network, data):
    """Probability of one text, a window after the other."""
    w, n = network.weights, len(data)
    codes = [*data, *[NONE] * (WIDTH - 1)]
    answers = [np.concatenate([w["embed"][c] for c in codes[k : k + WIDTH]]) @ w["filter"] for k in range(n)]
    odds = []
    for start in range(0, max(1, n - HOP), HOP):
        inside = answers[start : min(n, start + CHUNK)]
        highest = np.max(inside, axis=0) if inside else np.full(w["filter"].shape[1], np.finfo(np.float32).min)
        odds.append((network.log_odds(highest[None])[2][0], max(1, min(CHUNK, n - start))))
    mean = sum(o * size for o, size in odds) / sum(size for _, size in odds)
    return 1 / (1 + np.exp(-(mean + network.shift)))


def test_scores_against_brute_force():
    rng, network = np.random.default_rng(2), Network()
    network.shift = 0.7
    sizes = [0, 1, 3, HOP - 4, HOP - 1, HOP, HOP + 1, CHUNK - 2, CHUNK, CHUNK + 1, CHUNK + HOP, 3 * HOP + 5, 5000, 0, 40]
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in sizes]
    assert network.scores(texts) == pytest.approx([plain_score(network, t) for t in texts], rel=1e-4)
    assert network.scores([b""]) == pytest.approx(network.scores(texts)[:1]) and len(network.scores([])) == 0


def test_gradient():
    network = Network()
    chunks = [b"some text of a chunk", b"A|B|C" * 40, b""]
    codes, labels = quality_net.codes_of(chunks)[:, : 200 + WIDTH - 1], np.array([1, 0, 1], np.float32)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    gradient = network.gradient(codes, labels)

    def loss():
        answers = network.answers(codes)[1]
        answers[codes[:, : answers.shape[1]] == NONE] = -np.inf
        odds = network.log_odds(np.maximum(answers.max(axis=1), np.finfo(np.float32).min))[2]
        return float(np.mean(np.log1p(np.exp(odds)) - labels * odds))

    rng = np.random.default_rng(1)
    for name, g in gradient.items():
        for _ in range(6):
            at = (int(rng.choice(list(b"some text of a chunk|ABC"))), int(rng.integers(0, g.shape[1]))) if name == "embed" else tuple(int(rng.integers(0, n)) for n in g.shape)
            kept, step = network.weights[name][at], 1e-6
            network.weights[name][at] = kept + step
            up = loss()
            network.weights[name][at] = kept - step
            down = loss()
            network.weights[name][at] = kept
            assert g[at] == pytest.approx((up - down) / 2 / step, abs=2e-6), name


def area(scores, truth):
    """Area under the ROC curve by pairs."""
    good, bad = np.array(scores)[np.array(truth) == 1], np.array(scores)[np.array(truth) == 0]
    return float(((good[:, None] > bad).mean() + (good[:, None] >= bad).mean()) / 2)


def test_held_out_accuracy(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    rows = queries.all_queries()["op11_quality_net"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert {r["doc_id"] for r in rows if r["held_out"]} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert area([r["score"] for r in held], [truth[r["doc_id"]] for r in held]) >= 0.95
    clean = [r["predicted"] for r in held if truth[r["doc_id"]] == 1]
    assert sum(clean) >= 0.97 * len(clean)


def small(spark):
    clean, junk = "some words of plain prose that anyone may read at ease", "x|#|%|Q|$|" * 8
    docs = [(k, (junk if k % 3 == 0 else clean) + f" {k}") for k in range(60)]
    labels = [(k, 0 if k % 3 == 0 else 1) for k in range(60)]
    return docs, labels


def test_labels_of_held_out_rows_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(Network.train, "__defaults__", (5, 12))
    docs, labels = small(spark)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q) for k, q in labels]
    models = [quality_net.learn(frame, spark.createDataFrame(x, "doc_id long, quality int"), "doc_id", "text") for x in (labels, turned, labels[::-1])]
    assert all(np.array_equal(models[0].weights[k], m.weights[k]) for m in models[1:] for k in m.weights) and models[0].shift == models[1].shift


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(Network.train, "__defaults__", (80, 12))
    docs, labels = small(spark)
    long = "x|#|%|Q|$|" * 60_000
    docs = [*docs, (100, None), (101, ""), (102, long), (103, docs[1][1]), (103, docs[1][1]), (None, long), (None, None), (104, "é"), (1, docs[1][1])]
    labels = [*labels, (None, 0), (2, None), (4, 0), (4, 1), (500, 0), (100, 0), (5, 7)]
    frame = spark.createDataFrame([(*d, 1.5, "clash", 3) for d in docs], "doc_id long, text string, score double, held_out string, quality int")
    marks = spark.createDataFrame([(*m, 0, "clash") for m in labels], "doc_id long, quality int, toxic int, text string")
    rows = quality_net.score_documents(frame, marks).collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == len(docs) and score[100] == score[101] and score[103] > 0.6 and score[102] < 0.4 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert quality_net.score_documents(frame.limit(0), marks).count() == 0
    assert {r["score"] for r in quality_net.score_documents(frame, marks.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality_net.score_documents(frame, marks.where("quality = 1")).collect()} == {1.0}


def test_the_whole_text_counts():
    network = Network().train([[b"x|#|%|Q|$|" * 50], [b"some words of plain prose " * 19]], 60)
    clean, junk = b"some words of plain prose " * 400, b"x|#|%|Q|$|" * 1000
    first, last, middle = network.scores([junk + clean, clean + junk, clean + junk + clean])
    alone = network.scores([clean])[0]
    assert max(first, last, middle) < alone and first == pytest.approx(last, rel=0.2)
