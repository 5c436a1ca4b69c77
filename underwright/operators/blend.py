"""Champion against challenger: two stacked score sets, joined by id, and their best linear blend.

The weights solve the normal equations of a least-squares fit of the label on both scores, without intercept: five sums of one
aggregate. Scores of fitted models should be out-of-fold scores, so that neither is judged on rows it has seen.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from underwright.functions.scalars import number
from underwright.operators.metrics import rank_metrics
from underwright.operators.models import out_of_fold_scores

ID = "customer_id"


def paired_scores(champion: DataFrame, challenger: DataFrame, id_col: str = ID) -> DataFrame:
    """(id, y, champion, challenger) of the ids that both have scored; ids must be distinct in each."""
    other = challenger.selectExpr(id_col, "p AS challenger").filter("challenger IS NOT NULL")
    return champion.selectExpr(id_col, "y", "p AS champion").filter("champion IS NOT NULL AND y IS NOT NULL").join(other, id_col)


def blend_weights(pairs: DataFrame) -> tuple[float, float]:
    """Weights of champion and challenger. Where the equations are singular, as with proportional scores, the champion alone is weighed."""
    row = pairs.selectExpr(
        "sum(champion * champion) AS aa", "sum(champion * challenger) AS ab", "sum(challenger * challenger) AS bb", "sum(champion * y) AS ay", "sum(challenger * y) AS by").first()
    if row["aa"] is None:
        return 1.0, 0.0
    determinant = row["aa"] * row["bb"] - row["ab"] ** 2
    if determinant <= 1e-12 * row["aa"] * row["bb"]:
        return (row["ay"] / row["aa"] if row["aa"] else 0.0), 0.0
    return (row["bb"] * row["ay"] - row["ab"] * row["by"]) / determinant, (row["aa"] * row["by"] - row["ab"] * row["ay"]) / determinant


def blended(pairs: DataFrame, weights: tuple[float, float], id_col: str = ID) -> DataFrame:
    """(id, y, p) of the blend, cut to [0, 1] and rounded to 6 digits."""
    a, b = weights
    return pairs.selectExpr(id_col, "y", f"round(greatest(0D, least(1D, {number(a)} * champion + {number(b)} * challenger)), 6) + 0D AS p")


def champion_challenger(champion: DataFrame, challenger: DataFrame, id_col: str = ID) -> DataFrame:
    """(model, weight, roc_auc, ks, brier) of champion, challenger and blend on the ids that both have; the blend's weight is the sum."""
    pairs = paired_scores(champion, challenger, id_col)
    weights = blend_weights(pairs)
    kinds = {"champion": pairs.selectExpr("y", "champion AS p"), "challenger": pairs.selectExpr("y", "challenger AS p"), "blend": blended(pairs, weights, id_col).select("y", "p")}
    stacked = None
    for model, scores in kinds.items():
        part = scores.selectExpr(f"'{model}' AS model", "y", "p")
        stacked = part if stacked is None else stacked.unionByName(part)
    weight = f"CASE model WHEN 'champion' THEN {number(weights[0])} WHEN 'challenger' THEN {number(weights[1])} ELSE {number(sum(weights))} END"
    return rank_metrics(stacked, ["model"]).selectExpr("model", f"round({weight}, 6) + 0D AS weight", "roc_auc", "ks", "brier")


def model_challenge(folds: Sequence[DataFrame], champion: Callable, challenger: Callable, id_col: str = ID) -> DataFrame:
    """``champion_challenger`` of two model factories on the out-of-fold scores of the same folds."""
    return champion_challenger(out_of_fold_scores(folds, champion), out_of_fold_scores(folds, challenger), id_col)
