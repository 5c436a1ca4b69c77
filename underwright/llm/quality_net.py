"""Quality classifier: a byte-level convolutional network in NumPy.

A text's bytes are embedded, and learned filters look at every window of ``WIDTH`` bytes. Each filter's highest answer within a chunk is kept
(max-pooling), a small hidden layer makes the chunk's log-odds from them, and the chunks' log-odds, weighed by their
bytes, combine into the text's one probability. Chunks overlap by half and cover the whole text: answers are pooled per half
chunk once, and two neighbours make a chunk.

The network is trained on the driver by Adam on chunks of a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from underwright.llm.common import pieces, text_or_empty

#: Bytes of a chunk; the next one begins half a chunk later.
CHUNK, HOP = 512, 256
#: Bytes of a window, numbers per byte, filters, hidden units.
WIDTH, DEPTH, FILTERS, HIDDEN = 8, 6, 48, 16
#: Stands where no byte is.
NONE = 256
#: Bounds of the fit: rows per label, chunks per row (spread evenly over the whole text), steps and chunks per step.
FIT_ROWS, FIT_CHUNKS, STEPS, AT_STEP = 2000, 8, 900, 64
LEARNING_RATE, DECAY = 0.01, 1e-4
#: Least length in bytes that chunks are cut to in training.
SHORTEST = 16
#: Scores from here on are predicted 1.
THRESHOLD = 0.3
#: Bytes of text that are scored at once, and half chunks that the filters see at once.
AT_ONCE, BLOCK = 1 << 20, 16
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from; a null id counts as empty text, and has no label."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


class Network:
    """Weights by name, and ``shift``: the log-odds of the labels in the corpus, as training sees both labels equally often."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda spread, *shape: (spread * rng.standard_normal(shape)).astype(np.float32)
        self.weights = {
            "embed": draw(0.5, NONE + 1, DEPTH), "filter": draw((WIDTH * DEPTH) ** -0.5, WIDTH * DEPTH, FILTERS), "filter_bias": np.zeros(FILTERS, np.float32),
            "hidden": draw(FILTERS**-0.5, FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN**-0.5, HIDDEN), "out_bias": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def answers(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, answers of the filters) at every place of ``codes`` but the last ``WIDTH`` - 1."""
        embedded = self.weights["embed"][codes]
        shape = (*codes.shape[:-1], codes.shape[-1] - WIDTH + 1, WIDTH * DEPTH)
        windows = np.lib.stride_tricks.as_strided(embedded, shape, (*embedded.strides[:-2], embedded.strides[-2], embedded.strides[-1]))
        windows = np.ascontiguousarray(windows)
        return windows, windows @ self.weights["filter"]

    def log_odds(self, highest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pooled, hidden, log-odds) of chunks from the highest answer of each filter."""
        pooled = np.maximum(highest + self.weights["filter_bias"], 0)
        hidden = np.tanh(pooled @ self.weights["hidden"] + self.weights["hidden_bias"])
        return pooled, hidden, hidden @ self.weights["out"] + self.weights["out_bias"]

    def gradient(self, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss over chunks (rows of ``codes``); only the windows that won the pooling get any."""
        w, n = self.weights, len(codes)
        windows, answers = self.answers(codes)
        answers[codes[:, : answers.shape[1]] == NONE] = -np.inf
        at = answers.argmax(axis=1)
        highest = np.take_along_axis(answers, at[:, None, :], axis=1)[:, 0]
        pooled, hidden, odds = self.log_odds(np.maximum(highest, np.finfo(np.float32).min))
        d_odds = ((1 / (1 + np.exp(-odds)) - labels) / n).astype(np.float32)
        d_hidden = d_odds[:, None] * w["out"] * (1 - hidden**2)
        d_pooled = (d_hidden @ w["hidden"].T) * (pooled > 0)
        won = windows[np.arange(n)[:, None], at]
        d_window = d_pooled[:, :, None] * w["filter"].T
        bytes_won = codes[np.arange(n)[:, None, None], at[:, :, None] + np.arange(WIDTH)]
        d_embed = np.zeros_like(w["embed"])
        np.add.at(d_embed, bytes_won.reshape(-1), d_window.reshape(-1, DEPTH))
        return {
            "embed": d_embed, "filter": np.einsum("nfk,nf->kf", won, d_pooled), "filter_bias": d_pooled.sum(axis=0),
            "hidden": pooled.T @ d_hidden, "hidden_bias": d_hidden.sum(axis=0), "out": hidden.T @ d_odds, "out_bias": d_odds.sum(keepdims=True),
        }

    def train(self, chunks: list[list[bytes]], steps: int = STEPS, seed: int = 12) -> Network:
        """Adam over chunks drawn anew for each step, half of either label, half of them cut to some length, as there are short texts too; ``chunks`` has the chunks of label 0 and of label 1."""
        rng = np.random.default_rng(seed)
        coded = [codes_of(c) for c in chunks]
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        labels = np.repeat(np.array([0, 1], np.float32), AT_STEP // 2)
        for step in range(1, steps + 1):
            batch = np.concatenate([c[rng.integers(0, len(c), AT_STEP // 2)] for c in coded])
            length = np.where(rng.random(AT_STEP) < 0.5, CHUNK * (SHORTEST / CHUNK) ** rng.random(AT_STEP), batch.shape[1])
            batch[np.arange(batch.shape[1]) >= length[:, None]] = NONE
            rate = LEARNING_RATE * (1 - (step - 1) / steps)
            for k, g in self.gradient(batch, labels).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + DECAY * self.weights[k])
        return self

    def half_chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(highest answer of each filter per half chunk, first half chunk of each text); every text is followed by ``WIDTH`` - 1 places without bytes at least."""
        room = np.array([max(1, -(-(len(t) + WIDTH - 1) // HOP)) for t in texts], np.int64)
        begin = np.cumsum(room) - room
        codes = np.full(int(room.sum()) * HOP + WIDTH - 1, NONE, np.uint16)
        for text, at in zip(texts, (begin * HOP).tolist(), strict=True):
            codes[at : at + len(text)] = np.frombuffer(text, np.uint8)
        highest = np.empty((int(room.sum()), FILTERS), np.float32)
        for k in range(0, len(highest), BLOCK):
            some = codes[k * HOP : (k + BLOCK) * HOP + WIDTH - 1]
            answers = self.answers(some)[1]
            answers[some[: len(answers)] == NONE] = -np.inf
            highest[k : k + BLOCK] = answers.reshape(-1, HOP, FILTERS).max(axis=1)
        return highest, begin

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for whole texts; an empty text is one chunk without any byte."""
        highest, begin = self.half_chunks(texts)
        size = np.array([len(t) for t in texts], np.int64)
        chunks = np.maximum(1, -(-size // HOP) - 1)
        text = np.repeat(np.arange(len(texts)), chunks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        left = begin[text] + nth
        right = np.where(size[text] > HOP, left + 1, left)
        odds = self.log_odds(np.maximum(np.maximum(highest[left], highest[right]), np.finfo(np.float32).min))[2].astype(np.float64)
        weight = np.clip(size[text] - nth * HOP, 1, CHUNK)
        mean = np.bincount(text, odds * weight, len(texts)) / np.bincount(text, weight, len(texts))
        return 1 / (1 + np.exp(-np.clip(mean + self.shift, -500, 500)))


def codes_of(chunks: list[bytes]) -> np.ndarray:
    """A row per chunk: its places' bytes, and those that the last windows reach beyond it."""
    codes = np.full((len(chunks), CHUNK + WIDTH - 1), NONE, np.uint16)
    for k, chunk in enumerate(chunks):
        codes[k, : len(chunk)] = np.frombuffer(chunk, np.uint8)
    return codes


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int = FIT_ROWS) -> Network | float:
    """A trained network; where only one label is known that label, and 0.5 where none is.

    Learns from ids that aren't held out, have a text, and whose label rows agree: of about 2 x ``rows`` per label, drawn by a hash, the ``rows``
    with the smallest hashes of their ids. Each gives ``FIT_CHUNKS`` chunks at most, the first at its begin and the last at its end, so the driver gets
    at most 2 x ``rows`` x ``FIT_CHUNKS`` chunks. Of several rows with one id, one text is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)").where(~held_out("_id"))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most").drop("_most")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.encode(F.col(text_col), "utf-8").alias("_text")).where("_id IS NOT NULL AND _text IS NOT NULL")
    known = known.join(texts.select("_id").distinct(), "_id", "left_semi").persist()
    try:
        size = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
        if len(size) < 2:
            return float(next(iter(size))) if size else 0.5
        order = Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id")
        # what may be chosen at all: few more rows than wanted, so that a label's rows needn't meet in one task
        some = F.expr(f"pmod(xxhash64(_id, 'sample'), 1000000) < CASE _label WHEN 1 THEN {2e6 * rows / size[1]} ELSE {2e6 * rows / size[0]} END")
        chosen = known.where(some).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows).drop("_n")
        count = f"greatest(1, least({FIT_CHUNKS}, CAST(ceil(octet_length(_text) / {HOP}) AS INT)))"
        begin = f"CAST(CAST(k AS BIGINT) * greatest(octet_length(_text) - {CHUNK}, 0) div greatest(_chunks - 1, 1) AS INT)"
        cut = F.expr(f"transform(sequence(0, _chunks - 1), k -> substring(_text, {begin} + 1, {CHUNK + WIDTH - 1}))")
        sample = texts.join(F.broadcast(chosen), "_id").withColumn("_chunks", F.expr(count))
        sample = sample.groupBy("_id", "_label").agg(F.min_by(cut, F.xxhash64("_text")).alias("_cut")).orderBy("_id").collect()
    finally:
        known.unpersist()
    chunks: list[list[bytes]] = [[], []]
    for row in sample:
        chunks[row["_label"]].extend(map(bytes, row["_cut"]))
    network = Network().train(chunks)
    network.shift = float(np.log(size[1] / size[0]))
    return network


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; the score is the probability of quality 1, from the text alone.

    Null texts count as empty and are scored too: as one chunk that no filter answers. With only one label known every score is that label, without any
    0.5. Repeated rows and null ids stay; other columns aren't read; an empty table gives an empty result. No shuffle of texts; memory is
    bounded by Arrow's batch size and the longest text. Of equal texts in different batches scores may differ in the last digits, so they are
    rounded to 6.
    """
    model = learn(docs, labels, id_col, text_col, rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", AT_ONCE):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                score = np.round(model.scores(texts), 6) if isinstance(model, Network) else np.full(len(texts), model)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    return rows_in.mapInArrow(scored, SCHEMA)
