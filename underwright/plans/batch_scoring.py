"""Batch scoring: validate, score, decide, explain. One projection-only plan per output."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwright.functions.scalars import with_exprs
from underwright.operators.scoring import DEFAULT_THRESHOLD, InvalidInputError, reason_codes, score_applicants, validate
from underwright.sources.contract import APPLICANT_DDL, ID
from underwright.sources.files import CORRUPT, scan_csv, sink_csv, text_ddl
from underwright.sources.scorecard import TERM_INPUTS, TERM_NAMES, probability, term_contribution

Score = Callable[[DataFrame], DataFrame]


def card_score(df: DataFrame) -> DataFrame:
    """Scoring step of the fixed scorecard: appends its terms and ``p``."""
    return with_exprs(with_exprs(df, TERM_INPUTS), {"p": probability(digits=None)})


CARD_REASONS = {t: term_contribution(t) for t in TERM_NAMES}


def model_score(model: PipelineModel) -> Score:
    """Scoring step of a fitted model on raw contract columns: appends ``p`` and keeps the input columns."""

    def score(df: DataFrame) -> DataFrame:
        p = F.element_at(vector_to_array("probability"), 2).alias("p")
        return model.transform(df).select(*df.columns, p)

    return score


def predict_batch(df: DataFrame, score: Score, threshold: float = DEFAULT_THRESHOLD, strict: bool = True,
                  reasons: Mapping[str, str] | None = None, top_k: int = 5,
                  keep: tuple[str, ...] = (ID,)) -> tuple[DataFrame, DataFrame]:
    """(decisions, rejected rows). ``score`` appends ``p``; ``reasons`` maps features to contributions.

    ``strict`` fails the whole batch on any broken rule, otherwise broken rows go to the second frame.
    An empty batch gives an empty decision table.
    """
    valid, rejected = validate(df, strict)
    scored = score(valid)
    if reasons is not None:
        scored = with_exprs(scored, {"reasons": reason_codes(reasons, top_k)})
        keep = (*keep, "reasons")
    return score_applicants(scored, "p", threshold, keep), rejected


def csv_batch_score(spark: SparkSession, source: str, target: str, score: Score, threshold: float = DEFAULT_THRESHOLD,
                    ddl: str = APPLICANT_DDL, rejects: str | None = None) -> None:
    """Score a CSV file into another one.

    All columns are read as text, so a value that isn't a number breaks the contract instead of being missing. Without
    ``rejects`` any broken row or line fails the batch. With it, those are written there as they were read, with their
    violations, and decisions and rejects together have every line of the source.
    """
    rows = scan_csv(spark, source, text_ddl(ddl), keep_corrupt=True)
    whole, unreadable = rows.filter(f"{CORRUPT} IS NULL").drop(CORRUPT), rows.filter(f"{CORRUPT} IS NOT NULL")
    if rejects is None and (line := unreadable.first()):  # all columns: Spark reads no CSV for this one alone
        raise InvalidInputError(f"unreadable line: {line[CORRUPT]}")
    decisions, rejected = predict_batch(whole, score, threshold, strict=rejects is None)
    sink_csv(decisions, target)
    if rejects is not None:
        broken = rejected.withColumn("violations", F.concat_ws("; ", "violations"))
        sink_csv(broken.unionByName(unreadable.withColumn("violations", F.concat(F.lit("unreadable line: "), CORRUPT)).drop(CORRUPT)), rejects)
