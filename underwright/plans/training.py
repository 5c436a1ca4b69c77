"""The training chain: clean, split, select, fit the final model, save it with its metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from underwright.operators.cleaning import clean_applicants
from underwright.operators.models import TUNED_C, Matrix
from underwright.operators.selection import run_selection
from underwright.operators.splits import stratified_split
from underwright.operators.tuning import final_fit
from underwright.session import materialise
from underwright.sources.contract import ID, TARGET
from underwright.sources.files import model_metadata, save_model


@dataclass(frozen=True)
class Trained:
    """Result of the chain; ``model`` takes cleaned applicant rows and appends probabilities."""

    model: PipelineModel
    threshold: float
    selected: list[str]
    metadata: DataFrame


def select_columns(train: DataFrame, top_k: int = 25, trees: int = 200, repeats: int = 5, rfe_step: int = 1) -> list[str]:
    """Consensus features of the training rows only."""
    matrix = Matrix(train)
    rows = materialise(matrix.columns(train, [ID, TARGET]), "selection")
    final = run_selection(rows, matrix.names, top_k, trees, repeats, rfe_step=rfe_step)["final"]
    return [r["feature"] for r in final.collect()]


def train_final(raw: DataFrame, selected: list[str] | None = None, c: float = TUNED_C, path: str | None = None,
                **selection) -> Trained:
    """Run the chain on a raw applicant table and save the result under ``path`` where one is given."""
    rows = materialise(stratified_split(materialise(clean_applicants(raw), "cleaned")), "split")
    train, validation, test = (rows.filter(f"split = '{s}'") for s in ("train", "validation", "test"))
    names = selected or select_columns(train, **selection)
    found = final_fit(train, validation, test, c, names)
    matrix: Matrix = found["matrix"]
    model = PipelineModel(stages=[*matrix.prep.stages, matrix.assembler(), found["model"]])
    metadata = model_metadata(
        rows.sparkSession, "Logistic Regression", found["threshold"],
        {part: found[part] for part in ("validation", "test")}, matrix.names, {"C": c},
        {"test_cost_at_validation_threshold": found["test_cost_at_validation_threshold"]})
    if path:
        save_model(model, path, metadata)
    return Trained(model, found["threshold"], matrix.names, metadata)
