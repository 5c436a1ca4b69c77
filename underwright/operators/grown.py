"""Forests and boosted trees that tasks grow by themselves over binned rows.

Spark's own trees are grown level by level by all tasks together: a job or more per level, and all nodes of all trees as objects on
the driver. Here the rows are written once in the shared folder, a byte per number (its bin of at most ``BINS``, cut like Spark's own). A
task reads them and grows a tree of a forest, or all trees of a boosted fit. The trees of a forest go from task to task through the
shared folder; the driver holds none of them. Splits, leaves, weights and the first rounds of boosting follow Spark's rules; only the random draws are others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from underwright.functions.scalars import name
from underwright.session import materialise, scratch_path
from underwright.sources.contract import ID

BINS = 32
#: Spark cuts the bins on so many rows, drawn at random; here those with the smallest hashes.
CUT_ROWS = 10_000
#: Rows of a file of binned rows, rows that a task scores at once, and nodes whose histograms it holds at once.
FILE_ROWS, SCORE_ROWS, NODES_AT_ONCE = 100_000, 200_000, 4_096
#: Nodes beyond which a forest is grown by tasks; on the driver each is an object of some hundred bytes.
DRIVER_NODES = 4_000_000
#: A boosted fit of more rows isn't left to one task: it holds about 150 bytes a row.
TASK_ROWS = 5_000_000
#: Smaller gains are rounding.
GAIN = 1e-12
LEAF = 255

# --- binned rows ----------------------------------------------------------------------------------


def edges_of(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between the values as Spark places them: between all where they are few, else after about equal weights."""
    found, places = np.unique(values, return_inverse=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) <= bins - 1:
        return middles
    before = np.cumsum(np.bincount(places, weights))
    stride, target, out = before[-1] / bins, before[-1] / bins, []
    for i in range(1, len(found)):
        if abs(before[i - 1] - target) < abs(before[i] - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out[:bins - 1])


def bin_edges(rows: DataFrame) -> list[np.ndarray]:
    """The cuts of every feature of (id, weight, x) from ``CUT_ROWS`` rows, all where there are fewer."""
    share = min(1.0, (2 * CUT_ROWS + 64) / max(1, rows.count()))
    hashed = rows.select("weight", "x", F.xxhash64("id", "x").alias("h"))
    # the hash cuts the sample before it is ordered, so no task orders more than some thousand rows
    drawn = hashed.filter(f"h <= {int(-(2**63) + share * (2**64 - 1))}L") if share < 1 else hashed
    drawn = drawn.orderBy("h", "weight").limit(CUT_ROWS).select("weight", "x").toPandas()
    x, weights = np.stack(drawn["x"]), drawn["weight"].to_numpy()
    return [edges_of(x[:, j], weights) for j in range(x.shape[1])]


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every number: a row is left of cut k where its bin is at most k."""
    return np.stack([np.searchsorted(cuts, x[:, j], side="left") for j, cuts in enumerate(edges)], axis=1).astype(np.uint8)


def rows_of(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


@dataclass(frozen=True)
class Binned:
    """Rows (label, weight, held, bins) in the shared folder, and the cuts of their features."""

    path: str
    edges: list[np.ndarray]


def binned(df: DataFrame, weight: str | None = None, held: str = "false") -> Binned:
    """The rows of ``df`` binned; the cuts come from those that are not ``held``. The files are in an order that a rerun gives again."""
    key = name(ID) if ID in df.columns else "0"
    plain = df.withColumn("x", vector_to_array("features")).selectExpr(
        f"{key} AS id", "label", f"{f'CAST({name(weight)} AS DOUBLE)' if weight else '1D'} AS weight", f"{held} AS held", "x")
    edges = bin_edges(plain.filter("NOT held"))
    kind = dict(plain.dtypes)["id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = to_bins(rows_of(batch.column("x"), batch.num_rows), edges)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([b.tobytes() for b in bins], pa.binary())], ["id", "label", "weight", "held", "bins"])

    table = plain.mapInArrow(cut, f"id {kind}, label double, weight double, held boolean, bins binary")
    path = scratch_path(df.sparkSession, "binned")
    keys = ["id", "label", "weight", "held", "bins"]
    table.repartition(-(-df.count() // FILE_ROWS) or 1, "id").sortWithinPartitions(*keys).drop("id").write.parquet(path)
    return Binned(path, edges)


def stored(path: str) -> Iterator[pa.RecordBatch]:
    """The batches of a Parquet folder in the shared folder, in the order of its files."""
    system, place = pafs.FileSystem.from_uri(path)
    files = sorted(f.path for f in system.get_file_info(pafs.FileSelector(place)) if f.path.endswith(".parquet"))
    for file in files:
        yield from pads.dataset(file, filesystem=system, format="parquet").to_batches(batch_readahead=1, fragment_readahead=1)


def load(table: Binned) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins (rows x features), labels, weights and marks of the held rows."""
    bins, rest = [], []
    for batch in stored(table.path):
        if batch.num_rows:
            bins.append(np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            rest.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight", "held")])
    label, weight, held = (np.concatenate(c) for c in zip(*rest))
    return np.concatenate(bins), label, weight, held.astype(bool)


# --- one tree of a forest -------------------------------------------------------------------------


def best_of(hist: Sequence[np.ndarray], totals: Sequence[np.ndarray], least: float, score: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Best cut and its score per node from histograms (nodes x bins); -inf where no cut leaves ``least`` weight on both sides."""
    left = [h.cumsum(axis=1)[:, :-1] for h in hist]
    right = [t[:, None] - h for t, h in zip(totals, left)]
    with np.errstate(divide="ignore", invalid="ignore"):
        found = score(left, right)
    found[(sum(left) < least) | (sum(right) < least)] = -np.inf
    cut = found.argmax(axis=1)
    return cut, found[np.arange(len(cut)), cut]


def gini_score(left: Sequence[np.ndarray], right: Sequence[np.ndarray]) -> np.ndarray:
    return (left[0] ** 2 + left[1] ** 2) / (left[0] + left[1]) + (right[0] ** 2 + right[1] ** 2) / (right[0] + right[1])


def class_tree(x: np.ndarray, label: np.ndarray, weight: np.ndarray, max_depth: int, tried: int, rng: np.random.RandomState) -> dict[str, np.ndarray]:
    """A Gini tree on weighted rows, ``tried`` random features per node, as arrays by node: feature (``LEAF`` for a leaf), cut, left child (the
    right one follows it) and share of class 1."""
    width, flat = x.shape[1], x.ravel()
    rows = np.flatnonzero(weight > 0)
    w1, w0 = weight[rows] * label[rows], weight[rows] * (1 - label[rows])
    least = weight[rows].min() / 2
    node = np.zeros(len(rows), np.int64)
    total1, total0 = np.array([w1.sum()]), np.array([w0.sum()])
    levels, first = [], 0
    while True:
        n = len(total1)
        feature, cut, left = np.full(n, LEAF, np.uint8), np.zeros(n, np.uint8), np.full(n, -1, np.int32)
        p = total1 / (total1 + total0)
        levels.append([feature, cut, left, p])
        grows = np.minimum(total1, total0) >= least
        if len(levels) > max_depth or not grows.any():
            break
        keep = grows[node]
        rows, node, w1, w0 = rows[keep], node[keep], w1[keep], w0[keep]
        open_ = np.flatnonzero(grows)
        starts = np.searchsorted(node, open_)  # rows are in the order of their nodes
        child1, child0 = np.zeros((n, 2)), np.zeros((n, 2))
        for at in range(0, len(open_), NODES_AT_ONCE):
            some = open_[at:at + NODES_AT_ONCE]
            part = slice(starts[at], starts[at + NODES_AT_ONCE] if at + NODES_AT_ONCE < len(open_) else len(rows))
            slot = np.searchsorted(some, node[part])
            base = rows[part] * width
            a1, a0 = w1[part], w0[part]
            t1, t0 = total1[some], total0[some]
            features = rng.random_sample((len(some), width)).argpartition(tried - 1, axis=1)[:, :tried] if tried < width else np.tile(np.arange(width), (len(some), 1))
            best, best_f, best_c = (t1**2 + t0**2) / (t1 + t0) + GAIN * (t1 + t0), np.full(len(some), LEAF, np.uint8), np.zeros(len(some), np.uint8)
            l1, l0 = np.zeros(len(some)), np.zeros(len(some))
            for j in range(features.shape[1]):
                f = features[:, j]
                cell = slot * BINS + flat[base + f[slot]]
                hist = [np.bincount(cell, a, len(some) * BINS).reshape(-1, BINS) for a in (a1, a0)]
                c, gain = best_of(hist, (t1, t0), least, gini_score)
                better = np.flatnonzero(gain > best)
                best[better], best_f[better], best_c[better] = gain[better], f[better], c[better]
                for out, h in ((l1, hist[0]), (l0, hist[1])):
                    out[better] = h[better].cumsum(axis=1)[np.arange(len(better)), c[better]]
            feature[some], cut[some] = best_f, best_c
            child1[some], child0[some] = np.stack((l1, t1 - l1), 1), np.stack((l0, t0 - l0), 1)
        split = feature != LEAF
        if not split.any():
            break
        rank = np.cumsum(split) - 1
        left[split] = first + n + 2 * rank[split]
        keep = split[node]
        rows, node, w1, w0 = rows[keep], node[keep], w1[keep], w0[keep]
        node = 2 * rank[node] + (flat[rows * width + feature[node]] > cut[node])
        order = np.argsort(node, kind="stable")
        rows, node, w1, w0 = rows[order], node[order], w1[order], w0[order]
        # what is left over beside a side without a class is rounding
        total1, total0 = (np.where(t < least, 0.0, t) for t in (child1[split].ravel(), child0[split].ravel()))
        first += n
    return pruned(levels)


def pruned(levels: Sequence[Sequence[np.ndarray]]) -> dict[str, np.ndarray]:
    """The levels as one tree in which two leaves that decide the same are their parent, as in Spark's trees."""
    sizes = np.cumsum([0, *(len(level[0]) for level in levels)])
    feature, cut, left, p = (np.concatenate(c) for c in zip(*levels))
    for a, b in reversed(list(zip(sizes[:-1], sizes[1:]))):
        inner = a + np.flatnonzero(feature[a:b] != LEAF)
        l, r = left[inner], left[inner] + 1
        feature[inner[(feature[l] == LEAF) & (feature[r] == LEAF) & ((p[l] > 0.5) == (p[r] > 0.5))]] = LEAF
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    for a, b in zip(sizes[:-1], sizes[1:]):
        inner = a + np.flatnonzero((feature[a:b] != LEAF) & kept[a:b])
        kept[left[inner]] = kept[left[inner] + 1] = True
    place = np.cumsum(kept) - 1
    left = np.where(feature != LEAF, place[left], -1).astype(np.int32)
    return {"feature": feature[kept], "cut": cut[kept], "left": left[kept], "p": p[kept]}


def tree_scores(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The share of class 1 in the leaf of every row."""
    node, live, flat = np.zeros(len(x), np.int32), np.arange(len(x)), x.ravel()
    while len(live):
        f = tree["feature"][node[live]]
        live, f = live[f != LEAF], f[f != LEAF]
        at = node[live]
        node[live] = tree["left"][at] + (flat[live * x.shape[1] + f] > tree["cut"][at])
    return tree["p"][node]


# --- forests --------------------------------------------------------------------------------------

TREE = {"feature": np.uint8, "cut": np.uint8, "left": np.int32, "p": np.float64}


@dataclass(frozen=True)
class GrownForest:
    """A fitted forest: its trees in the shared folder, and the cuts of the features."""

    path: str
    edges: list[np.ndarray]
    trees: int

    def load(self) -> Iterator[dict[str, np.ndarray]]:
        for batch in stored(self.path):
            for row in range(batch.num_rows):
                yield {c: np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in TREE.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows without their vectors, and ``p``, the mean over all trees; a task reads one tree after the other for ``SCORE_ROWS`` rows."""
        plain = [f for f in df.schema.fields if not isinstance(f.dataType, VectorUDT)]
        rows = df.select(*[name(f.name) for f in plain], vector_to_array("features").alias("_x"))
        schema = StructType([*plain, StructField("p", DoubleType())])
        names = [f.name for f in schema.fields]

        def scored(held: list[tuple[pa.RecordBatch, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            x = np.concatenate([bins for _, bins in held])
            p = sum(tree_scores(tree, x) for tree in self.load()) / self.trees
            at = 0
            for batch, bins in held:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p[at:at + len(bins)])], names)
                at += len(bins)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                if batch.num_rows:
                    held.append((batch, to_bins(rows_of(batch.column("_x"), batch.num_rows), self.edges)))
                    n += batch.num_rows
                if n >= SCORE_ROWS:
                    yield from scored(held)
                    held, n = [], 0
            if held:
                yield from scored(held)

        return rows.mapInArrow(score, schema)


def grow_forest(estimator: RandomForestClassifier, rows: DataFrame) -> GrownForest:
    """The forest with the estimator's settings, a task per tree, each on its own Poisson draw of the rows."""
    spark, trees, depth, seed = rows.sparkSession, estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed()
    table = binned(rows, estimator.getWeightCol() if estimator.isSet("weightCol") else None)
    width = len(table.edges)
    tried = math.ceil(math.sqrt(width)) if trees > 1 else width

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for batch in batches:
            for number in batch.column("id").to_pylist():
                if x is None:
                    x, label, weight, _ = load(table)
                rng = np.random.RandomState([seed % 2**32, number])
                tree = class_tree(x, label, weight * rng.poisson(1.0, len(x)), depth, tried, rng)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), *(pa.array([np.ascontiguousarray(tree[c], kind).tobytes()], pa.binary()) for c, kind in TREE.items())], ["tree", *TREE])

    path = scratch_path(spark, "forest")
    spark.range(0, trees, 1, trees).mapInArrow(grow, "tree bigint, " + ", ".join(f"{c} binary" for c in TREE)).write.parquet(path)
    return GrownForest(path, table.edges, trees)


def on_driver(estimator: RandomForestClassifier, n_rows: int) -> bool:
    """Whether the driver can hold a forest's nodes: two per row and tree at most."""
    return estimator.getNumTrees() * min(2 ** (estimator.getMaxDepth() + 1), 2 * n_rows) <= DRIVER_NODES


def fit(estimator, rows: DataFrame):
    """The fitted estimator; forests whose nodes the driver can't hold are grown by tasks."""
    if isinstance(estimator, RandomForestClassifier) and not on_driver(estimator, rows.count()):
        return grow_forest(estimator, rows)
    return estimator.fit(rows)


# --- boosted trees --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Boost:
    """The settings of a boosted fit."""

    rounds: int
    depth: int
    step: float
    subsample: float
    tried: float
    min_rows: int
    weight: str | None
    seed: int

    @classmethod
    def of(cls, estimator: GBTClassifier) -> Boost:
        columns = estimator.getFeatureSubsetStrategy()
        return cls(estimator.getMaxIter(), estimator.getMaxDepth(), estimator.getStepSize(), estimator.getSubsamplingRate(), 1.0 if columns == "all" else float(columns),
                   estimator.getMinInstancesPerNode(), estimator.getWeightCol() if estimator.isSet("weightCol") else None, estimator.getSeed())


class Histograms:
    """Sums by node, feature and bin. Features of two bins share a column: five of them make 32 codes."""

    def __init__(self, x: np.ndarray) -> None:
        self.width = x.shape[1]
        top = x.max(axis=0, initial=0)
        self.many = np.flatnonzero(top > 1)
        few = np.flatnonzero(top <= 1)
        self.few = [few[i:i + 5] for i in range(0, len(few), 5)]
        self.columns = [np.ascontiguousarray(x[:, f]) for f in self.many]
        self.columns += [(x[:, part] << np.arange(len(part), dtype=np.uint8)).sum(axis=1).astype(np.uint8) for part in self.few]
        self.bits = (np.arange(BINS)[:, None] >> np.arange(5)) & 1

    def sums(self, rows: np.ndarray | None, node: np.ndarray | None, nodes: int, values: Sequence[np.ndarray]) -> np.ndarray:
        """(values, nodes, features, bins) of the given rows, or of all as one node."""
        out = np.zeros((len(values), nodes, self.width, BINS))
        if rows is not None:
            values, base = [v[rows] for v in values], node * BINS
        for j, column in enumerate(self.columns):
            cell = column if rows is None else base + column[rows]
            for s, v in enumerate(values):
                hist = np.bincount(cell, v, nodes * BINS).reshape(nodes, BINS)
                if j < len(self.many):
                    out[s, :, self.many[j]] = hist
                else:
                    part = self.few[j - len(self.many)]
                    ones = hist @ self.bits[:, :len(part)]
                    out[s, :, part, 1] = ones.T
                    out[s, :, part, 0] = (hist.sum(axis=1)[:, None] - ones).T
        return out


def value_tree(hists: Histograms, flat: np.ndarray, target: np.ndarray, weight: np.ndarray, boost: Boost, rng: np.random.RandomState) -> np.ndarray:
    """The value that a variance tree on the rows with weight gives every row, those without included."""
    n, width = len(target), hists.width
    counted = boost.min_rows > 1
    values = [weight, weight * target, *([(weight > 0).astype(float)] if counted else [])]
    least = weight[weight > 0].min() / 2
    tried = min(width, math.ceil(boost.tried * width))
    out = np.empty(n)
    live, slot = np.arange(n), np.zeros(n, np.int64)
    hist = hists.sums(None, None, 1, values)
    for depth in range(boost.depth + 1):
        total = hist[:, :, 0].sum(axis=2)
        mean = total[1] / total[0]
        if depth == boost.depth:
            out[live] = mean[slot]
            break
        left = hist.cumsum(axis=3)[..., :-1]
        right = total[:, :, None, None] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            found = left[1] ** 2 / left[0] + right[1] ** 2 / right[0]
        found[(left[0] < least) | (right[0] < least)] = -np.inf
        if counted:
            found[(left[2] < boost.min_rows - 0.5) | (right[2] < boost.min_rows - 0.5)] = -np.inf
        if tried < width:
            left_out = rng.random_sample((len(mean), width)).argpartition(tried - 1, axis=1)[:, tried:]
            found[np.arange(len(mean))[:, None], left_out] = -np.inf
        best = found.reshape(len(mean), -1).argmax(axis=1)
        feature, cut = best // (BINS - 1), best % (BINS - 1)
        gain = found.reshape(len(mean), -1)[np.arange(len(mean)), best] - total[1] * mean
        split = gain > GAIN * total[0]
        if not split.all():
            ends = ~split[slot]
            out[live[ends]] = mean[slot[ends]]
            live, slot = live[~ends], slot[~ends]
        if not split.any():
            break
        rank = np.cumsum(split) - 1
        goes = flat[live * width + feature[slot]] > cut[slot]
        parent, slot = rank[slot], 2 * rank[slot] + goes
        if depth + 1 < boost.depth:
            # the child with fewer rows is counted, the other is what is left of the parent
            sizes = np.bincount(slot, minlength=2 * int(split.sum())).reshape(-1, 2)
            smaller = sizes.argmin(axis=1)
            some = np.flatnonzero(goes == smaller[parent])
            small = hists.sums(live[some], parent[some], len(sizes), values)
            large = hist[:, split] - small
            large[np.abs(large) < GAIN * np.abs(hist[:, split])] = 0.0
            first = (smaller == 0)[None, :, None, None]
            hist = np.stack((np.where(first, small, large), np.where(first, large, small)), axis=2).reshape(len(values), -1, width, BINS)
        else:
            sums = [np.bincount(slot, v[live], 2 * int(split.sum())) for v in values]
            hist = np.stack(sums)[:, :, None, None]
    return out


def boosted_margins(x: np.ndarray, label: np.ndarray, weight: np.ndarray, held: np.ndarray, boost: Boost, patience: int | None = None) -> tuple[np.ndarray, list[float]]:
    """Margin of every row by a fit on those not ``held``, and with ``patience`` the loss on the held ones after each round.

    With patience the rounds end once the loss hasn't fallen for so many, and the margins are those of the best round. The rules are those of
    ``GBTClassifier``: the first tree is fitted to the signs at full weight, the later ones to the gradient of the log loss.
    """
    hists, flat = Histograms(x), x.ravel()
    sign = 2 * label - 1
    fit = np.where(held, 0.0, weight)
    margin, target, step = np.zeros(len(x)), sign, 1.0
    losses: list[float] = []
    best = margin
    for number in range(boost.rounds):
        rng = np.random.RandomState([boost.seed % 2**32, number])
        drawn = fit * (rng.random_sample(len(x)) < boost.subsample) if boost.subsample < 1 else fit
        margin = margin + step * value_tree(hists, flat, target, drawn if drawn.any() else fit, boost, rng)
        target, step = 4 * sign / (1 + np.exp(2 * sign * margin)), boost.step
        if patience is not None:
            losses.append(float(np.average(2 * np.logaddexp(0, -2 * sign[held] * margin[held]), weights=weight[held])))
            at = int(np.argmin(losses))
            best = margin if at == number else best
            if number - at >= patience:
                break
    return (margin if patience is None else best), losses


def by_tasks(estimators: Sequence, n_rows: int) -> bool:
    """Whether all are boosted trees whose rows fit in a task."""
    return all(isinstance(e, GBTClassifier) for e in estimators) and n_rows <= TASK_ROWS


def boosted_scores(spark: SparkSession, tables: Sequence[Binned], tasks: Sequence[tuple[int, Boost]]) -> DataFrame:
    """Scores of the held rows of a table by a fit on its others, a Spark task per (table, settings), as (task, y, p); the longest fits start first."""
    order = sorted(range(len(tasks)), key=lambda i: (-tasks[i][1].rounds * tasks[i][1].depth, i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("id").to_pylist():
                table, boost = tasks[order[at]]
                x, label, weight, held = load(tables[table])
                margin = boosted_margins(x, label, weight if boost.weight else np.ones(len(x)), held, boost)[0][held]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(margin), order[at], np.int32)), pa.array(label[held].astype(np.int32)), pa.array(1 / (1 + np.exp(-2 * margin)))], ["task", "y", "p"])

    return spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, "task int, y int, p double")


def boosted_until(rows: DataFrame, held: str, estimator: GBTClassifier, patience: int) -> tuple[list[float], DataFrame]:
    """The loss on the held rows after each round until ``patience`` rounds haven't lowered it, and the held scores (y, p) of the best round."""
    boost = Boost.of(estimator)
    table = binned(rows, boost.weight, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, label, weight, out = load(table)
                margin, losses = boosted_margins(x, label, weight, out, boost, patience)
                names = ["round", "loss", "y", "p"]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(losses), dtype=np.int32)), pa.array(losses), pa.nulls(len(losses), pa.int32()), pa.nulls(len(losses), pa.float64())], names)
                n = int(out.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64()), pa.array(label[out].astype(np.int32)), pa.array(1 / (1 + np.exp(-2 * margin[out])))], names)

    found = materialise(rows.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "round int, loss double, y int, p double"), "boosted")
    losses = [r["loss"] for r in found.filter("round IS NOT NULL").orderBy("round").select("loss").collect()]  # a number per round
    return losses, found.filter("round IS NULL").select("y", "p")
