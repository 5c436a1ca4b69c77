"""Feature selection on the transformed training matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.functions.quantiles import exact_quantiles
from underwright.functions.ranking import window
from underwright.functions.scalars import long_rows, name, number, text, unpivot, with_exprs
from underwright.operators import grown
from underwright.operators.eda import pearson_pairs
from underwright.operators.explain import permutation_importance
from underwright.operators.models import SEED, forest, logistic, positive_scores
from underwright.operators.splits import holdout_80_20
from underwright.operators.transforms import class_weights, with_class_weight
from underwright.session import materialise
from underwright.sources.contract import ID, TARGET

CORRELATION_LIMIT = 0.9
VARIANCE_LIMIT = 0.01
VIF_LIMIT = 10.0
TOP_K = 25
MIN_VOTES = 2
MI_BINS = 20
SELECTION_REPEATS = 5


def corr_pairs(df: DataFrame, columns: Sequence[str], limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Column pairs above the limit with their absolute correlation (3 digits); the earlier column is the drop candidate."""
    pairs = pearson_pairs(df, columns).filter(f"abs(r) > {number(limit)}")
    return pairs.selectExpr("a", "b", "round(abs(r), 3) AS r", "a AS drop_candidate")


def variance_filter(df: DataFrame, columns: Sequence[str], limit: float = VARIANCE_LIMIT) -> DataFrame:
    """Population variance per column, smallest first, and whether it is below the limit."""
    row = df.selectExpr(*[f"var_pop({name(c)}) AS {name(c)}" for c in columns])
    return long_rows(row, [
        {"feature": text(c), "variance": name(c), "low": f"{name(c)} < {number(limit)}"} for c in columns]).orderBy(
        "variance", "feature")


def vif(df: DataFrame, columns: Sequence[str], singular: float = 0.9999) -> DataFrame:
    """Variance inflation of each column on all others.

    One distributed pass gives the correlation matrix (columns x columns); each R^2 is a small least
    squares on it, which also handles the exact dependence between one-hot columns. A constant column
    gets 1, R^2 of 0.9999 or more gives infinity.
    """
    columns = list(columns)
    index = {c: i for i, c in enumerate(columns)}
    size = len(columns)
    matrix, varies = np.eye(size), np.zeros(size, dtype=bool)
    for row in pearson_pairs(df, columns).collect():
        if row["r"] is not None:
            i, j = index[row["a"]], index[row["b"]]
            matrix[i, j] = matrix[j, i] = row["r"]
            varies[i] = varies[j] = True
    rows = []
    for i, c in enumerate(columns):
        others = [j for j in range(size) if j != i and varies[j]]
        if not varies[i] or not others:
            rows.append((c, 1.0))
            continue
        beta = np.linalg.lstsq(matrix[np.ix_(others, others)], matrix[others, i], rcond=1e-10)[0]
        r2 = float(beta @ matrix[others, i])
        rows.append((c, float("inf") if r2 >= singular else 1.0 / (1.0 - r2)))
    table = df.sparkSession.createDataFrame(rows, "feature string, vif double")
    return table.orderBy(F.desc("vif"), "feature")

def sweep(matrix: np.ndarray, k: int) -> np.ndarray:
    """The sweep operator: moves variable k between the explained and the explaining ones; a second sweep takes it back."""
    pivot = matrix[k, k]
    out = matrix - np.outer(matrix[:, k], matrix[k]) / pivot
    out[k], out[:, k] = matrix[k] / pivot, matrix[:, k] / pivot
    out[k, k] = -1 / pivot
    return out


def vif_prune(df: DataFrame, columns: Sequence[str], limit: float = VIF_LIMIT, singular: float = 1e-4) -> tuple[list[str], DataFrame]:
    """Survivors of dropping the column with the largest VIF until none exceeds ``limit``, and a row per column.

    One distributed pass gives the correlation matrix. All columns are swept into it, so the negated diagonal holds the VIFs; dropping a
    column is one more sweep, without another scan. A column that those before it explain up to 1 - ``singular`` can't be
    swept: it is dropped first, with an infinite VIF. Constant columns have no correlations and VIF 1. Ties go to the later column. Rows: feature, dropped (1, 2 ..
    in that order, null for survivors), vif (when dropped, or at the end).
    """
    columns = list(columns)
    index = {c: i for i, c in enumerate(columns)}
    matrix = np.eye(len(columns))
    for row in pearson_pairs(df, columns).collect():
        if row["r"] is not None:
            i, j = index[row["a"]], index[row["b"]]
            matrix[i, j] = matrix[j, i] = row["r"]
    dropped, swept = [], []
    for k, c in enumerate(columns):
        if matrix[k, k] <= singular:
            dropped.append((c, float("inf")))
        else:
            matrix = sweep(matrix, k)
            swept.append(k)
    while swept:
        worst = max(swept, key=lambda k: (round(-matrix[k, k], 9), k))
        if -matrix[worst, worst] <= limit:
            break
        dropped.append((columns[worst], float(-matrix[worst, worst])))
        matrix = sweep(matrix, worst)
        swept.remove(worst)
    rows = [(c, k, v) for k, (c, v) in enumerate(dropped, 1)] + [(columns[k], None, float(-matrix[k, k])) for k in swept]
    table = df.sparkSession.createDataFrame(rows, "feature string, dropped int, vif double")
    return [columns[k] for k in swept], table


def pruned_scorecard(df: DataFrame, columns: Sequence[str], limit: float = VIF_LIMIT, target: str = TARGET) -> DataFrame:
    """``vif_prune`` with the weights of a balanced logistic fit on the survivors: feature, dropped, vif, weight (null for dropped ones)."""
    survivors, table = vif_prune(df, columns, limit)
    sizes = {r[target]: r["count"] for r in df.groupBy(target).count().collect()}
    total = sum(sizes.values())
    balanced = " ".join(f"WHEN {c} THEN {number(total / (len(sizes) * n))}" for c, n in sizes.items())
    rows = VectorAssembler(inputCols=survivors, outputCol="features").transform(df.selectExpr(*map(name, survivors), f"CAST({target} AS DOUBLE) AS label", f"CASE {target} {balanced} END AS weight"))
    fitted = logistic(total).fit(rows.select("features", "label", "weight"))
    weights = df.sparkSession.createDataFrame([(c, float(w)) for c, w in zip(survivors, fitted.coefficients, strict=True)], "feature string, weight double")
    return table.join(F.broadcast(weights), "feature", "left").orderBy("dropped", "feature")


def mutual_information(df: DataFrame, columns: Sequence[str], target: str = TARGET, bins: int = MI_BINS) -> DataFrame:
    """Mutual information in nats between each binned column and the target, largest first.

    Columns are cut at their own quantiles, so a column with few values keeps them apart where they are
    frequent; missing values are left out.
    """
    columns = list(columns)
    edges = exact_quantiles(df, columns, [i / bins for i in range(1, bins)])
    lists = ", ".join(
        f"{text(c)}, array({', '.join(number(v) for v in edges[c])})" for c in columns if edges[c][0] is not None)
    long = unpivot(df, [target], columns, "double", "feature").filter("value IS NOT NULL")
    binned = long.selectExpr(f"CAST({target} AS INT) AS y", "feature",
                             f"size(filter(map({lists})[feature], e -> e < value)) AS bin")
    cells = binned.groupBy("feature", "bin", "y").agg(F.expr("count(*) AS n"))  # at most 20 x 2 per column
    shares = cells.selectExpr(
        "feature", "CAST(n AS DOUBLE) AS n", f"CAST(sum(n) {window(['feature', 'bin'], [])} AS DOUBLE) AS nb",
        f"CAST(sum(n) {window(['feature', 'y'], [])} AS DOUBLE) AS ny", f"CAST(sum(n) {window(['feature'], [])} AS DOUBLE) AS t")
    return shares.groupBy("feature").agg(F.expr("sum(n / t * ln(n * t / (nb * ny))) AS mi")).orderBy(F.desc("mi"), "feature")


def _assembled(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def rfe(df: DataFrame, columns: Sequence[str], keep: int = TOP_K, target: str = TARGET, max_iter: int = 100,
        step: int = 1) -> list[str]:
    """Recursive elimination: refit a logistic regression without its smallest coefficient until ``keep`` remain."""
    left = list(columns)
    weighted = with_class_weight(df, target, class_weights(df, target))
    rows = with_exprs(weighted, {"label": f"CAST({target} AS DOUBLE)"}).select("label", "weight", *columns)
    n = rows.count()
    while len(left) > keep:
        model = LogisticRegression(labelCol="label", weightCol="weight", standardization=False, regParam=1.0 / n, maxIter=max_iter).fit(
            _assembled(rows, left))
        order = sorted(zip(np.abs(model.coefficients.toArray()), left))
        dropped = {c for _, c in order[:min(step, len(left) - keep)]}
        left = [c for c in left if c not in dropped]
    return left


def permutation_select(df: DataFrame, columns: Sequence[str], trees: int = 200, repeats: int = SELECTION_REPEATS,
                       seed: int = SEED, target: str = TARGET, max_depth: int = 30) -> DataFrame:
    """Permutation importance of a balanced forest fitted on 80% of the rows, measured on the other 20%.

    ``max_depth`` is the largest that Spark's forests allow.
    """
    columns = list(columns)
    rows = holdout_80_20(df.select(ID, target, *columns), seed, ID, target)
    weights = class_weights(rows.filter("split = 'train'"), target)
    labelled = with_class_weight(with_exprs(rows, {"label": f"CAST({target} AS DOUBLE)"}), target, weights)
    fitted = grown.fit(forest(trees, max_depth, seed), _assembled(labelled.filter("split = 'train'"), columns))

    def score(part: DataFrame) -> DataFrame:
        scored = fitted.transform(part.withColumns({"features": array_to_vector("x"), "label": F.col("y").cast("double")}).drop("x"))
        # written, since the plan of every later stage would carry the forest
        return materialise(positive_scores(scored, [c for c in part.columns if c in ("repeat", "feature")]), "scores")

    held = _assembled(labelled.filter("split = 'test'"), columns).select(ID, F.col(target).alias("y"), vector_to_array("features").alias("x"))
    # a forest of 200 deep trees has over a million nodes, which every scoring task loads anew
    return permutation_importance(materialise(held, "held"), columns, score, repeats, seed, packed="x", per_core=1)


# --- consensus ------------------------------------------------------------------------------------


def top_features(scores: DataFrame, score: str, k: int = TOP_K, method: str = "") -> DataFrame:
    """(method, feature) of the k best rows of a score table."""
    return scores.orderBy(F.desc(score), "feature").limit(k).selectExpr(f"{text(method)} AS method", "feature")


def vote_consensus(*lists: DataFrame, votes: int = MIN_VOTES) -> DataFrame:
    """Features named by at least ``votes`` of the (method, feature) lists."""
    union = lists[0]
    for part in lists[1:]:
        union = union.unionByName(part)
    return union.groupBy("feature").agg(F.expr("count(DISTINCT method) AS votes")).filter(f"votes >= {votes}")


def redundancy_prune(pairs: DataFrame, consensus: DataFrame, mi: DataFrame) -> DataFrame:
    """Of each correlated pair inside the consensus, the feature with less mutual information (tie: a, the earlier one)."""
    kept = F.broadcast(consensus.select("feature"))  # one row per column of the matrix
    inside = pairs.join(kept.withColumnRenamed("feature", "a"), "a", "left_semi").join(
        kept.withColumnRenamed("feature", "b"), "b", "left_semi")
    known = F.broadcast(mi.select("feature", "mi"))
    left = inside.join(known.withColumnsRenamed({"feature": "a", "mi": "mi_a"}), "a", "left")
    both = left.join(known.withColumnsRenamed({"feature": "b", "mi": "mi_b"}), "b", "left")
    return both.selectExpr("IF(coalesce(mi_b, 0D) < coalesce(mi_a, 0D), b, a) AS feature").distinct()


def final_selected(consensus: DataFrame, pruned: DataFrame, variances: DataFrame) -> DataFrame:
    """Consensus without the pruned and the nearly constant features, sorted."""
    kept = consensus.select("feature").join(pruned, "feature", "left_anti")
    return kept.join(variances.filter("low"), "feature", "left_anti").orderBy("feature")


def importance_align(features: DataFrame, tables: dict[str, tuple[DataFrame, str, object]]) -> DataFrame:
    """One row per feature with every score table joined by name; ``tables`` maps output column to
    (table, its column, default)."""
    out = features.select("feature")
    for column, (table, source, default) in tables.items():
        out = out.join(F.broadcast(table.select("feature", F.col(source).alias(column))), "feature", "left")
        out = out.withColumn(column, F.coalesce(column, F.lit(default)))
    return out


def selection_table(features: DataFrame, mi: DataFrame, permutation: DataFrame, kept_by_rfe: DataFrame, votes: DataFrame,
                    vifs: DataFrame, final: DataFrame) -> DataFrame:
    """Every feature with all its scores, by votes then mutual information."""
    yes = F.lit(True)
    aligned = importance_align(features, {
        "mutual_info": (mi, "mi", 0.0),
        "perm_imp": (permutation, "importance", 0.0),
        "rfe_kept": (kept_by_rfe.select("feature").withColumn("k", yes), "k", False),
        "votes": (votes, "votes", 0),
        "vif": (vifs, "vif", 0.0),
        "final_keep": (final.select("feature").withColumn("k", yes), "k", False),
    })
    return aligned.selectExpr(
        "feature", "round(mutual_info, 4) AS mutual_info", "round(perm_imp, 4) AS perm_imp", "rfe_kept", "votes",
        "round(vif, 1) AS vif", f"vif > {number(VIF_LIMIT)} AS high_vif", "final_keep").orderBy(
        F.desc("votes"), F.desc("mutual_info"), "feature")


def run_selection(df: DataFrame, columns: Sequence[str], top_k: int = TOP_K, trees: int = 200,
                  repeats: int = SELECTION_REPEATS, seed: int = SEED, target: str = TARGET, rfe_step: int = 1) -> dict[str, DataFrame]:
    """All methods on a training matrix with (id, target, columns...), and their consensus."""
    spark = df.sparkSession
    pairs = corr_pairs(df, columns)
    variances = variance_filter(df, columns)
    mi = materialise(mutual_information(df, columns, target), "mi")
    kept = spark.createDataFrame([("rfe", c) for c in rfe(df, columns, top_k, target, step=rfe_step)], "method string, feature string")
    permutation = materialise(permutation_select(df, columns, trees, repeats, seed, target), "permutation")
    lists = (top_features(mi, "mi", top_k, "mutual_info"), kept, top_features(permutation, "importance", top_k, "permutation"))
    consensus = vote_consensus(*lists)
    pruned = redundancy_prune(pairs, consensus, mi)
    final = final_selected(consensus, pruned, variances)
    features = spark.createDataFrame([(c,) for c in columns], "feature string")
    table = selection_table(features, mi, permutation, kept, vote_consensus(*lists, votes=1), vif(df, columns), final)
    return {"pairs": pairs, "variances": variances, "mi": mi, "rfe": kept, "permutation": permutation,
            "consensus": consensus, "pruned": pruned, "final": final, "table": table}
